"""Which format a path has by its last extension, and which reader parses it. The two tables are not the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planar.functions import geometry as g

#: Fixed values, which results must equal: id, category and extensions of the known formats, in the order in which the first that fits wins.
KNOWN = (
    ("pdf", "Document", (".pdf",)),
    ("gerber", "Fabrication", (".gbr", ".ger", ".gtl", ".gbl", ".gts", ".gbs", ".gto", ".gbo")),
    ("excellon", "Fabrication", (".drl", ".xln")),
    ("kicad-pcb", "Design", (".kicad_pcb",)),
    ("eagle", "Design", (".brd",)),
    ("pcb", "Design", (".pcb", ".pbr")),
    ("ipc2581", "Exchange", (".xml", ".cvg")),
    ("odbpp", "Fabrication", (".tgz", ".tar", ".zip")),
)
#: Ids and extensions of the readers of boards, in the order in which they are asked. The reader of archives takes .zip only.
READERS = (
    ("gerber", (".gbr", ".ger", ".gtl", ".gbl", ".gko", ".gm1")),
    ("excellon", (".drl", ".xln", ".exc")),
    ("kicad-pcb", (".kicad_pcb",)),
    ("eagle", (".brd",)),
    ("ipc-2581", (".xml", ".cvg")),
    ("odb++", (".zip",)),
    ("legacy-pcb", (".pcb",)),
)


def first_fit(path: Column, table) -> Column:
    """The first value of table (value, extensions) that has the path's extension."""
    extension, out = g.extension(path), F.lit(None)
    for value, known in reversed(table):
        out = F.when(extension.isin(*known), value).otherwise(out)
    return out


def detected(path: Column) -> Column:
    """format and category of a path; both null if none is known."""
    fits = lambda k: first_fit(path, [(F.lit(row[k]), row[2]) for row in KNOWN]).cast("string")
    return F.struct(fits(0).alias("format"), fits(1).alias("category"))


def reader(path: Column, strict: bool = False) -> Column:
    """The id of the reader of a path; null, or an error if strict, where there is none."""
    found = first_fit(path, [(F.lit(name), known) for name, known in READERS]).cast("string")
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no reader for "), path)).cast("string")) if strict else found
