"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents form streams of words, cut into blocks of a fixed length. A source has as many slots as blocks
fill its target. Slots fall into the output shards by a hash, so the numbers of a source's slots in the shards are a multinomial draw given
the source's total; the draw is kept as a table of counts, and a shard's slots of a source are the next so many of the source's slot
numbers. Slot j is the place j mod blocks in pass j div blocks, and a pass is a pseudorandom permutation of the source's blocks: blocks in the
order of a keyed hash, ranked in two steps. Slots and blocks meet in a join on (source, pass, place), and all that the mix takes
follows from these rows.

Defined results: null text has no words; a null source is a source of its own, after all others; documents without
words get taken 0; an empty table gives an empty result; repeated rows count as documents of their own; a document's stream is drawn from
its id and text, so null and repeated ids spread, and rows alike in both are ordered by row; a pass is one full permutation, and a
target is at most twice a source's size, so that no block is taken more than twice. Texts of any length are cut whole; columns of any name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planar.llm.common import WORD, free_name, stored

WEIGHTS = (3, 1, 2)
SHARE, CEILING, BLOCK_WORDS, STREAM_WORDS, SHARD_WORDS, RANKED = 1.5, 2, 64, 262_144, 4_194_304, 16_384


def drawn(key, *more):
    """A pseudorandom integer below 2^32 of the key."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", key, *more)), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source and size (words) of each row under a row number, or under the column that has one; written, as several jobs read it."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    number = F.col(row) if row else F.monotonically_increasing_id()
    tie = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), tie.alias("tie"), number.alias("row")), "mix-sizes")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """A row for each source: its size, target, number of blocks and slots.

    Targets share `share` of all words by weight; each stops at `ceiling` times its source's size and the rest is
    shared again, which ends where target = least(weight * level, ceiling * size). Sources in ascending order of
    ceiling / weight reach their ceiling one after the other, so prefix sums give the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    per = per.withColumn("rank", F.row_number().over(ordered)).withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("top", F.col("source_size") * F.lit(float(ceiling)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fills = Window.orderBy(F.col("top") / F.col("weight"), "rank")
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(fills))
    open_ = F.when(F.col("top") > F.col("weight") * F.col("level"), F.struct("place", "level"))
    per = per.withColumn("level", F.min(open_).over(everything)["level"])
    return per.select("source", "source_size", F.when(F.col("level").isNull(), F.col("top")).otherwise(F.least(F.col("weight") * F.col("level"), F.col("top"))).alias("target"))


def source_key(column: str = "source"):
    """A key without nulls, for joins."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))


def runs_of(rows: DataFrame, number: str, run: int) -> DataFrame:
    """Rows of `number` things in runs of `run`: begin and end (exclusive) of each, so that no task makes all of a row's things."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number, as the few rows would else be joined into one task
    every = rows.where(F.col(number) > 0).withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1, F.lit(run).cast("long"))))
    return every.withColumn("end", F.least(F.col("begin") + run, F.col(number))).repartition(parts, "key", "begin")


def each_of_run(first: Column | None = None) -> Column:
    first = F.lit(0).cast("long") if first is None else first
    return F.explode(F.sequence(first + F.col("begin"), first + F.col("end") - 1))


def before(value: str, *keys: str, order: str) -> Column:
    """The sum of value in the rows before."""
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(along) - F.col(value)


def draws(sources: DataFrame, seed: int, shard_words: int, block_words: int) -> DataFrame:
    """The multinomial draw: key, shard, count and first (slot number) of the slots of each source (key, slots, blocks) in each output shard."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each source
    shards = F.greatest(F.lit(1), F.ceil(F.sum("slots").over(everything) * block_words / shard_words))
    slots = runs_of(sources.select("key", "slots", shards.alias("shards")), "slots", RANKED).select("key", "shards", each_of_run().alias("slot"))
    counts = slots.groupBy("key", (drawn(F.col("key"), F.lit(seed), F.col("slot"), F.lit("shard")) % F.col("shards")).alias("shard")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("first", before("count", "key", order="shard"))


def permutations(sources: DataFrame, seed: int) -> DataFrame:
    """key, pass, place, block: in each pass that slots reach, the source's blocks in the order of a keyed hash.

    Places are ranks within a range of hashes plus the number of blocks in the ranges before, so no task orders all blocks of a source."""
    runs = runs_of(sources, "blocks", RANKED).withColumn("block", each_of_run())
    passes = F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.col("blocks")))
    every = runs.where("slots > 0").select("key", "blocks", "block", F.explode(passes).alias("pass"))
    every = every.withColumn("hash", drawn(F.col("key"), F.lit(seed), F.col("pass"), F.col("block")))
    every = every.withColumn("range", F.floor(F.col("hash") * F.ceil(F.col("blocks") / RANKED) / F.lit(2**32)))
    ranges = every.groupBy("key", "pass", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("base", before("n", "key", "pass", order="range")).drop("n")
    rank = F.row_number().over(Window.partitionBy("key", "pass", "range").orderBy("hash", "block")) - 1
    return every.withColumn("rank", rank).join(ranges, ["key", "pass", "range"]).select("key", "pass", (F.col("base") + F.col("rank")).alias("place"), "block")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, block_words: int = BLOCK_WORDS, stream_words: int = STREAM_WORDS, shard_words: int = SHARD_WORDS, seed: int = 1, row: str | None = None) -> dict[str, DataFrame]:
    """The mix as relations.

    sizes: row, doc_id, source, size. per: key, source_size, target. draw: key, shard, count, first. places: for each row with words the
    blocks that it lies in (key, block, first word, words). slots: key, shard, slot, block for each block of the mix.
    """
    sizes = sized(docs, row).withColumn("key", source_key())
    per = targets(sizes, weights, share, ceiling).withColumn("key", source_key()).drop("source")
    per = stored(per.withColumn("streams", F.greatest(F.lit(1), F.ceil(F.col("source_size") / stream_words)).cast("long")), "mix-targets")
    # Streams bound what one window partition gets of a large source.
    full = sizes.where("size > 0").join(per.select("key", "streams"), "key").withColumn("stream", drawn(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("tie")) % F.col("streams"))
    stream = full.groupBy("key", "stream").agg(F.ceil(F.sum("size") / block_words).alias("blocks"))
    stream = stream.withColumn("base", before("blocks", "key", order="stream"))
    slots_of = stream.groupBy("key").agg(F.sum("blocks").alias("blocks")).join(per, "key")
    slots_of = slots_of.withColumn("slots", F.least(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5), F.col("blocks") * int(ceiling)))
    slots_of = stored(slots_of.select("key", "blocks", F.col("slots").cast("long").alias("slots")), "mix-slots")
    within = Window.partitionBy("key", "stream").orderBy("doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = full.withColumn("start", F.sum("size").over(within) - F.col("size")).join(stream.select("key", "stream", "base"), ["key", "stream"])
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    placed = placed.select("key", "row", "base", "start", "size", F.explode(F.sequence(first, last)).alias("at"))
    begin = F.greatest(F.col("start"), F.col("at") * block_words)
    places = placed.select("key", "row", (F.col("base") + F.col("at")).alias("block"), (begin - F.col("start")).alias("first"), (F.least(F.col("start") + F.col("size"), (F.col("at") + 1) * block_words) - begin).alias("words"))
    draw = stored(draws(slots_of, seed, shard_words, block_words), "mix-draw")
    slots = runs_of(draw.join(slots_of.select("key", "blocks"), "key"), "count", RANKED).select("key", "blocks", "shard", each_of_run(F.col("first")).alias("slot"))
    slots = slots.select("key", "shard", "slot", F.floor(F.col("slot") / F.col("blocks")).alias("pass"), (F.col("slot") % F.col("blocks")).alias("place"))
    # Spark takes exploded rows for as small as the few that they come from; the hints keep them from being broadcast.
    slots = slots.hint("merge").join(permutations(slots_of, seed).hint("merge"), ["key", "pass", "place"]).select("key", "shard", "slot", "block")
    return {"sizes": sizes, "per": per, "draw": draw, "places": places, "slots": slots}


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of each row."""
    m = mix(docs, **options)
    times = m["slots"].groupBy("key", "block").agg(F.count(F.lit(1)).alias("times"))
    got = m["places"].join(times.hint("merge"), ["key", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = m["sizes"].join(m["per"].select("key", "source_size", "target"), "key").join(got.hint("merge"), "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def piece_words() -> Column:
    """The words of `text`, each with the white space behind it; a text without white space at its end gets a line break there."""
    text = F.when(F.col("text").rlike(r"[\x20\x09-\x0D]\z"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))


def mixed_blocks(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: shard, slot (its place among the source's slots), source, doc_id and text of every piece that an output shard takes."""
    number = free_name(docs, "mix_row")
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    m = mix(numbered, row=number, **options)
    taken = m["places"].join(m["slots"].hint("merge"), ["key", "block"]).groupBy("row").agg(F.collect_list(F.struct("shard", "slot", "first", "words")).alias("spans"))
    rows = numbered.select(F.col(number).alias("row"), "doc_id", "source", piece_words().alias("pieces"))
    each = rows.join(taken.hint("merge"), "row").select("doc_id", "source", "pieces", F.explode("spans").alias("s"))
    return each.select("s.shard", "s.slot", "source", "doc_id", F.array_join(F.slice("pieces", (F.col("s.first") + 1).cast("int"), F.col("s.words").cast("int")), "").alias("text"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix by documents: each row's text becomes the pieces that the output shards take, in the order of shards and slots; columns stay.

    Pieces are cut between words and keep the white space behind them. Rows of which nothing is taken go.
    """
    names, number, parts, pieces = docs.columns, free_name(docs, "mix_row"), free_name(docs, "mix_spans"), free_name(docs, "mix_pieces")
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    m = mix(numbered, row=number, **options)
    spans = m["places"].join(m["slots"].hint("merge"), ["key", "block"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("shard", "slot", "first", "words"))).alias("spans"))
    text = F.array_join(F.transform(parts, lambda s: F.array_join(F.slice(pieces, (s["first"] + 1).cast("int"), s["words"].cast("int")), "")), "")
    text = F.when(F.col("text").rlike(r"[\x20\x09-\x0D]\z"), text).otherwise(F.regexp_replace(text, r"\n\z", ""))
    spans = spans.withColumnsRenamed({"spans": parts, "row": number})
    out = numbered.join(spans.hint("merge"), number).withColumn(pieces, piece_words()).withColumn("text", text)
    return out.select(*names)
