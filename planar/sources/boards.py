"""Readers of textual board formats: relations of tracks, pads, holes, components and nets from whole texts.

A reader takes a relation (doc_id, content). State that a format carries from token to token - the aperture, tool, position or unit in
effect - is a window over the tokens of a document, the last value that was set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planar.functions import geometry as g

SKELETON = (("top-copper", "Copper", "Top", 10), ("bottom-copper", "Copper", "Bottom", 20), ("outline", "Outline", "Both", 30), ("drill", "Drill", "Both", 40))
INCH = 25.4
#: Fixed values, which results must equal: the patterns by which each format is read, with what they let through and what they miss.
GERBER_APERTURE = r"(?i)%ADD(\d+)C,([0-9.]+)"
GERBER_SELECTION = r"(?i)(?:^|G54)D(\d+)$"
GERBER_COORDINATES = r"(?i)(?:X(-?\d+))?(?:Y(-?\d+))?(?:D0?([123]))"
EXCELLON_TOOL = r"(?i)^T(\d+)C([0-9.]+)"
EXCELLON_SELECTION = r"(?i)^T(\d+)$"
EXCELLON_HOLE = r"(?i)^X(-?\d+)Y(-?\d+)"
KICAD_SEGMENT = r'(?s)\(segment\s+\(start\s+([-\d.]+)\s+([-\d.]+)\)\s+\(end\s+([-\d.]+)\s+([-\d.]+)\).*?\(layer\s+"([^"]+)"\).*?(?:\(net\s+\d+\s+"([^"]+)"\))?.*?\(width\s+([-\d.]+)\)'
KICAD_FOOTPRINT = r'(?s)\(footprint.*?\(property\s+"Reference"\s+"([^"]+)".*?\(property\s+"Value"\s+"([^"]*)".*?\(at\s+([-\d.]+)\s+([-\d.]+)(?:\s+([-\d.]+))?\)'
LEGACY_TRACK = r"Po\s+\d+\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)"
LEGACY_MODULE = r"(?s)\$MODULE\s+([^\s]+).*?Po\s+([-\d.]+)\s+([-\d.]+)"
KICAD_EDGE = r'(?s)\(gr_line\s+\(start\s+([-\d.]+)\s+([-\d.]+)\).*?\(layer\s+"Edge.Cuts"\)'


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path) and content of text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("content"))


def skeleton(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The four layers of every board document."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("layer_id", "layer_type", "side", "ord"), r)]) for r in SKELETON])
    return docs.select("doc_id", F.explode(rows).alias("l")).select("doc_id", "l.*")


def nets(named: DataFrame) -> DataFrame:
    """net_id and name of net names (doc_id, n, name); of names with one id the first stays."""
    return named.withColumn("net_id", g.slug(F.col("name"))).groupBy("doc_id", "net_id").agg(F.min_by("name", "n").alias("name"))


def outlines(points: DataFrame) -> DataFrame:
    """A polygon for each document with three points or more (doc_id, n, x, y)."""
    per = points.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("p"))
    return per.where(F.size("p") >= 3).select("doc_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


def gerber(files: DataFrame) -> DataFrame:
    """Tracks and round flashes: doc_id, element_no, kind, x1, y1, x2, y2, size (mm).

    Fixed scale of 0.001 mm, or 0.0001 inch without %MOMM. A token is one that ends in *; a bare D-number selects an aperture; coordinates that a token lacks stay as they
    are. Coordinates with D1 draw where they move, with D3 they flash; tokens with neither but D2 move. A header that holds D3 counts as a flash too.
    """
    metric = F.contains(F.upper("content"), F.lit("%MOMM"))
    f = files.select("doc_id", "content", metric.alias("metric"))
    groups = lambda pattern, k: F.regexp_extract_all("content", F.lit(pattern), F.lit(k))
    defs = f.select("doc_id", "metric", F.posexplode(F.arrays_zip(groups(GERBER_APERTURE, 1).alias("d"), groups(GERBER_APERTURE, 2).alias("s"))).alias("k", "a"))
    defs = defs.groupBy("doc_id", F.col("a.d").try_cast("int").alias("aperture")).agg(F.max_by(F.col("a.s").try_cast("double") * F.when(F.col("metric"), 1.0).otherwise(INCH), "k").alias("size"))
    t = f.select("doc_id", F.when(F.col("metric"), 0.001).otherwise(0.0001 * INCH).alias("scale"), F.posexplode(F.split("content", r"\*")).alias("n", "token")).withColumn("token", F.trim(F.regexp_replace("token", r"^\s+|\s+$", ""))).where("token <> ''")
    select = F.nullif(F.regexp_extract("token", GERBER_SELECTION, 1), F.lit("")).try_cast("int")
    part = lambda k: F.when(F.col("select").isNull(), F.nullif(F.regexp_extract("token", GERBER_COORDINATES, k), F.lit("")))
    order = Window.partitionBy("doc_id").orderBy("n")
    upto, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("select", select).withColumns({"op": part(3).try_cast("int"), "x": part(1).try_cast("double") * F.col("scale"), "y": part(2).try_cast("double") * F.col("scale")})
    now = lambda c, w: F.coalesce(F.last(c, True).over(w), F.lit(0.0))
    t = t.withColumns({"aperture": F.coalesce(F.last("select", True).over(upto), F.lit(0)), "x1": now("x", before), "y1": now("y", before), "x2": now("x", upto), "y2": now("y", upto)}).where("op IS NOT NULL")
    moved = (F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))
    kind = F.when((F.col("op") == 1) & moved, "Track").when(F.col("op") == 3, "Pad")
    t = t.withColumn("kind", kind).where("kind IS NOT NULL").join(defs, ["doc_id", "aperture"], "left")
    flash = F.col("kind") == "Pad"
    return t.select("doc_id", F.row_number().over(order).alias("element_no"), "kind", F.when(flash, F.col("x2")).otherwise(F.col("x1")).alias("x1"), F.when(flash, F.col("y2")).otherwise(F.col("y1")).alias("y1"), "x2", "y2", F.coalesce("size", F.when(flash, 0.5).otherwise(0.15)).alias("size"))


def excellon(files: DataFrame) -> DataFrame:
    """Drilled vias: doc_id, element_no, x, y, diameter (mm). INCH holds from its line on; a hole takes the last definition of its tool before it."""
    l = files.select("doc_id", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    order = Window.partitionBy("doc_id").orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = lambda pattern, k: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    inch = F.coalesce(F.max(F.col("line").rlike("(?i)^INCH").try_cast("int")).over(upto), F.lit(0)) == 1
    definition, select, point = EXCELLON_TOOL, EXCELLON_SELECTION, EXCELLON_HOLE
    l = l.withColumns({"inch": inch, "def": got(definition, 1).try_cast("int"), "size": got(definition, 2).try_cast("double"), "sel": got(select, 1).try_cast("int"), "px": got(point, 1).try_cast("double"), "py": got(point, 2).try_cast("double")})
    l = l.withColumn("tool", F.coalesce(F.last("sel", True).over(upto), F.lit(0))).withColumn("key", F.coalesce("def", "tool"))
    mm = F.col("size") * F.when(F.col("inch"), INCH).otherwise(1.0)
    l = l.withColumn("diameter", F.last(F.when(F.col("def").isNotNull(), mm), True).over(Window.partitionBy("doc_id", "key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hits = l.where("px IS NOT NULL AND def IS NULL AND sel IS NULL")
    scale = F.when(F.col("inch"), 0.0001 * INCH).otherwise(0.001)
    return hits.select("doc_id", F.row_number().over(order).alias("element_no"), (F.col("px") * scale).alias("x"), (F.col("py") * scale).alias("y"), F.coalesce("diameter", F.lit(0.3)).alias("diameter"))


def matches(files: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """A row for each match of a pattern, n from 1, its groups as columns; empty groups are null."""
    zipped = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(k + 1)).alias(c) for k, c in enumerate(names)])
    rows = files.select("doc_id", F.posexplode(zipped).alias("n", "m"))
    return rows.select("doc_id", (F.col("n") + 1).alias("n"), *[F.nullif(F.col(f"m.{c}"), F.lit("")).alias(c) for c in names])


def kicad(files: DataFrame) -> dict[str, DataFrame]:
    """tracks, components, nets and outlines."""
    num = lambda c: F.col(c).try_cast("double").alias(c)
    s = matches(files, KICAD_SEGMENT, ["x1", "y1", "x2", "y2", "layer", "net", "width"])
    tracks = s.select("doc_id", F.col("n").alias("element_no"), F.when(F.col("layer") == "B.Cu", "bottom-copper").otherwise("top-copper").alias("layer_id"), num("x1"), num("y1"), num("x2"), num("y2"), num("width"), F.when(F.col("net").isNotNull(), g.slug(F.col("net"))).alias("net_id"))
    parts = matches(files, KICAD_FOOTPRINT, ["reference", "value", "x", "y", "rotation"]).select("doc_id", "n", "reference", F.coalesce("value", F.lit("")).alias("value"), num("x"), num("y"), F.coalesce(F.col("rotation").try_cast("double"), F.lit(0.0)).alias("rotation"))
    edge = matches(files, KICAD_EDGE, ["x", "y"]).select("doc_id", "n", num("x"), num("y"))
    return {"tracks": tracks, "components": parts, "nets": nets(s.where("net IS NOT NULL").select("doc_id", "n", F.col("net").alias("name"))), "outlines": outlines(edge)}


def legacy(files: DataFrame) -> dict[str, DataFrame]:
    num = lambda c: F.col(c).try_cast("double").alias(c)
    t = matches(files, LEGACY_TRACK, ["x1", "y1", "x2", "y2", "width"])
    m = matches(files, LEGACY_MODULE, ["reference", "x", "y"])
    return {"tracks": t.select("doc_id", F.col("n").alias("element_no"), *map(num, ("x1", "y1", "x2", "y2", "width"))), "components": m.select("doc_id", "n", "reference", num("x"), num("y"))}


def tags(files: DataFrame, names: str) -> DataFrame:
    """doc_id, n, tag and attributes (a map) of XML elements by local name, in document order."""
    found = F.regexp_extract_all("content", F.lit(rf"(?s)<(?:[\w.-]+:)?((?:{names})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"), F.lit(1))
    rows = files.select("doc_id", F.posexplode(found).alias("n", "body"))
    attr = r"([\w.:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    part = lambda k: F.regexp_extract_all("body", F.lit(attr), F.lit(k))
    pairs = F.transform(F.arrays_zip(part(1).alias("k"), part(2).alias("v"), part(3).alias("w")), lambda a: F.struct(a["k"].alias("k"), F.concat(a["v"], a["w"]).alias("v")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, a: F.map_concat(F.map_filter(m, lambda k, _: k != a["k"]), F.create_map(a["k"], a["v"])))
    return rows.select("doc_id", (F.col("n") + 1).alias("n"), F.regexp_extract("body", r"^([\w.-]+)", 1).alias("tag"), last.alias("attributes"))


def _number(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col("attributes")[name].try_cast("double"), F.lit(default))


def eagle(files: DataFrame) -> dict[str, DataFrame]:
    """Components and tracks; both are numbered in one series, components first."""
    a = lambda n: F.col("attributes")[n]
    order = Window.partitionBy("doc_id").orderBy("n")
    e = tags(files, "element").withColumn("no", F.row_number().over(order))
    turn = F.coalesce(F.regexp_replace(a("rot"), r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))
    parts = e.select("doc_id", F.col("no").alias("n"), F.coalesce(a("name"), F.concat(F.lit("U"), "no")).alias("reference"), F.coalesce(a("value"), F.lit("")).alias("value"), _number("x").alias("x"), _number("y").alias("y"), turn.alias("rotation"), F.when(F.upper(a("rot")).startswith("M"), "Bottom").otherwise("Top").alias("side"))
    count = e.groupBy("doc_id").agg(F.max("no").alias("parts"))
    w = tags(files, "wire").withColumn("no", F.row_number().over(order)).join(count, "doc_id", "left")
    tracks = w.select("doc_id", (F.col("no") + F.coalesce("parts", F.lit(0))).alias("element_no"), F.when(a("layer") == "16", "bottom-copper").otherwise("top-copper").alias("layer_id"), *[_number(c).alias(c) for c in ("x1", "y1", "x2", "y2")], _number("width", 0.15).alias("width"))
    return {"components": parts, "tracks": tracks}


def _ipc_root() -> Column:
    return F.contains(F.upper(F.regexp_extract("content", r"(?s)<(?![?!])(?:[\w.-]+:)?([\w.-]+)", 1)), F.lit("IPC"))


def ipc2581_errors(files: DataFrame) -> DataFrame:
    """doc_id and error of files whose root is another."""
    return files.where(~F.coalesce(_ipc_root(), F.lit(False))).select("doc_id", F.lit("the root is not IPC-2581").alias("error"))


def ipc2581(files: DataFrame) -> dict[str, DataFrame]:
    """Components and nets of files whose root's name holds IPC."""
    own = files.where(_ipc_root())
    a = lambda n: F.col("attributes")[n]
    c = tags(own, "Component|ComponentInstance").withColumn("no", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")))
    named = F.coalesce(a("refDes"), a("name"))
    # A component without a name takes two numbers of the series, the first in its reference.
    before = F.sum(F.when(named.isNull(), 2).otherwise(1)).over(Window.partitionBy("doc_id").orderBy("n"))
    c = c.withColumn("series", before)
    parts = c.select("doc_id", F.col("series").alias("n"), F.coalesce(named, F.concat(F.lit("U"), F.col("series") - 1)).alias("reference"), F.coalesce(a("part"), F.lit("")).alias("value"), _number("x").alias("x"), _number("y").alias("y"), _number("rotation").alias("rotation"))
    n = tags(own, "LogicalNet").select("doc_id", "n", F.coalesce(a("name"), F.concat(F.lit("Net-"), "n")).alias("name"))
    return {"components": parts, "nets": nets(n)}


def odb_entries(archives: DataFrame) -> DataFrame:
    """doc_id, k and entry of zipped jobs (doc_id, content binary), or broken; listing a zip has no built-in, so it is one small Python step."""

    def entries(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            out = []
            for d, c in zip(b.doc_id, b.content):
                try:
                    out += [(d, k, n, False) for k, n in enumerate(zipfile.ZipFile(io.BytesIO(c)).namelist())]
                except zipfile.BadZipFile:
                    out.append((d, 0, None, True))
            yield pd.DataFrame(out, columns=["doc_id", "k", "entry", "broken"])

    kind = dict(archives.dtypes)["doc_id"]
    return archives.select("doc_id", "content").mapInPandas(entries, f"doc_id {kind}, k long, entry string, broken boolean")


def _layer_entries(archives: DataFrame) -> DataFrame:
    e = odb_entries(archives).where(F.contains(F.lower("entry"), F.lit("/layers/")))
    return e.withColumn("name", F.regexp_extract("entry", r"(?i)(?:^|/)layers/([^/]*)", 1)).where(F.trim("name") != "")


def odb_layers(archives: DataFrame) -> DataFrame:
    """Layers (doc_id, layer_id, name, ord) of zipped ODB++ jobs; names that differ by case only are one."""
    first = _layer_entries(archives).groupBy("doc_id", F.lower("name").alias("low")).agg(F.min(F.struct("k", "name")).alias("f"))
    return first.select("doc_id", F.concat(F.lit("odb-"), "low").alias("layer_id"), F.col("f.name").alias("name"), (F.lit(99) + F.row_number().over(Window.partitionBy("doc_id").orderBy("f.k"))).alias("ord"))


def odb_errors(archives: DataFrame) -> DataFrame:
    """doc_id and error of archives that are broken or have no layers."""
    broken = odb_entries(archives).where("broken").select("doc_id", F.lit(True).alias("broken"))
    none = archives.select("doc_id").join(_layer_entries(archives).select("doc_id"), "doc_id", "left_anti").join(broken, "doc_id", "left")
    return none.select("doc_id", F.when(F.col("broken"), "broken archive").otherwise("no layers in the archive").alias("error"))


#: Tokens of a document's bytes that tell its kind.
TOKENS = {"pdf": "%PDF-", "encrypted": "/Encrypt", "form": "/AcroForm", "xfa": "/XFA", "dynamic": "dynamicRender", "wait": "Please wait", "dot_ret": "/DotRet"}
PAGE_MARK = r"/Type /Page(?!s)"
#: Types that the built-in viewer shows, and that can be analysed.
VIEWABLE, ANALYSABLE = ("Standard", "ImageOnly", "Technical", "AcroForm"), ("Standard", "Technical", "AcroForm")


def inspect(files: DataFrame, tokens: dict[str, str] = TOKENS) -> DataFrame:
    """Flags of the tokens that content (string or binary) holds, and the page count: /Type /Page not followed by s, one at least."""
    text = F.decode("content", "ISO-8859-1") if dict(files.dtypes)["content"] == "binary" else F.col("content")
    pages = F.greatest(F.lit(1), F.regexp_count(text, F.lit(PAGE_MARK)))
    return files.select("doc_id", *[F.contains(text, F.lit(t)).alias(n) for n, t in tokens.items()], pages.alias("pages"))


def byte_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and content of the lines of files of any size and kind. Spark splits the files by ranges of bytes and takes a line to the split in which it
    begins; its bytes stay as they are. No token holds a line's end, so no token is lost between splits."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("content"))


def inspect_lines(lines: DataFrame, tokens: dict[str, str] = TOKENS) -> DataFrame:
    """As inspect(), from the lines (doc_id, content) of each document: flags and counts are merged before and after one exchange."""
    flags = [F.coalesce(F.bool_or(F.contains("content", F.lit(t))), F.lit(False)).alias(n) for n, t in tokens.items()]
    pages = F.greatest(F.lit(1), F.sum(F.regexp_count("content", F.lit(PAGE_MARK)))).cast("int")
    return lines.groupBy("doc_id").agg(*flags, pages.alias("pages"))


def document_type(vectors: Column, words: Column) -> Column:
    """The type of an inspected document; the first that holds. A document with the malformed name that breaks decoders counts as standard, by its raw page count."""
    c = F.col
    known = F.when(~c("pdf"), "Corrupted").when(c("encrypted"), "Protected").when(c("xfa") & (c("dynamic") | c("wait")), "XfaDynamic")
    known = known.when(c("xfa"), "XfaStatic").when(c("dot_ret"), "Standard")
    return known.when(c("form"), "AcroForm").when(vectors > 0, "Technical").when(words > 0, "Standard").otherwise("ImageOnly")


def viewable(kind: Column) -> Column:
    return kind.isin(*VIEWABLE)


def analysable(kind: Column, override: Column | None = None) -> Column:
    """Whether a document can be analysed: by its type, unless the override (false for a malformed name) is given."""
    by_type = kind.isin(*ANALYSABLE)
    return by_type if override is None else F.coalesce(override, by_type)
