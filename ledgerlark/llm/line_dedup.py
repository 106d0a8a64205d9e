"""Removal of repeated line runs with a suffix array over line ids, in DataFrame operations only.

The corpus is a set of line-id sequences, one per document. Only lines that
occur twice can be part of a repeat, so suffixes start at these alone. Prefix
doubling ranks the suffixes by their first 1, 2, 4, ... lines: the rank of a
pair of adjacent windows comes from a range-partitioned sort of the distinct
pairs. Suffixes of equal rank share that prefix, they are an interval of the
suffix array with that longest common prefix; intervals of one suffix end
there. Ranks are refined to the depth that the longest window asks for, and a
window of any length is told by the ranks of the two windows of a power of two
that cover it.

A run of lines is removed if it has at least ``min_words`` words and an equal
run stands earlier, by document id and line number. Each such run is the union
of its least windows of that many words, those that start at a line and those
that end at one; so the intervals of equal least windows reveal all maximal
repeated runs, and every window but the first of its interval is deleted.

Defined results: null text stays null; empty text has one empty line and stays;
a document that loses all lines keeps its row with empty text; rows repeated
with id and text are one document and change alike; documents that share an id
but not the text are in the order of a hash of it; null ids come first; extra
columns are returned unchanged, one with the name of ``count_col`` is replaced;
an empty table gives an empty table. A document's lines are ordered in one
task: they were one row of it before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import free_name
from .store import release, written

MIN_WORDS = 50
AT = ["d", "th"]


def document_key(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("th")]


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, th, pos, h1, h2, w): each line's place, 128-bit id and words; the lines themselves are not moved."""
    text = F.col(f"`{text_col}`")
    rows = docs.where(text.isNotNull()).select(*document_key(id_col, text_col), F.posexplode(F.split(text.cast("string"), "\n")).alias("pos", "line"))
    words = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+"))
    return rows.select("d", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), words.cast("int").alias("w"))


def ordered_ranks(keys: DataFrame, cols: list[str]) -> DataFrame:
    """``keys`` with ``rank``, their place in the order of ``cols``: sorted by range, offset by the partitions before."""
    placed = written(keys.repartitionByRange(*cols).withColumn("part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*cols))
    return placed.withColumn("inner", inner).join(F.broadcast(before), "part").select(*keys.columns, (F.col("before") + F.col("inner")).alias("rank"))


def _repeated(rows: DataFrame, cols: list[str]) -> DataFrame:
    return written(rows.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeats")


def repeated_lines(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, th, seg, pos, w, c, rank): lines that occur twice, in stretches of at least ``min_words`` words; c counts words to the line's end."""
    ranks = ordered_ranks(_repeated(lines, ["h1", "h2"]), ["h1", "h2"])
    rows = lines.join(ranks, ["h1", "h2"]).select("d", "th", "pos", "w", "rank").distinct()
    by = Window.partitionBy(*AT).orderBy("pos")
    rows = rows.withColumn("seg", F.col("pos") - F.row_number().over(by))
    stretch = Window.partitionBy(*AT, "seg")
    rows = rows.withColumn("all", F.sum("w").over(stretch)).where(F.col("all") >= min_words)
    return rows.withColumn("c", F.sum("w").over(stretch.orderBy("pos"))).drop("all")


def doubled(level: DataFrame, span: int) -> DataFrame:
    """Suffixes ranked by twice ``span`` lines from those ranked by ``span``; only repeats stay."""
    after = level.select("d", "th", (F.col("pos") - span).alias("pos"), F.col("rank").alias("next"))
    pairs = written(level.select("d", "th", "pos", F.col("rank").alias("this")).join(after, [*AT, "pos"]), "pairs")
    repeats = _repeated(pairs, ["this", "next"])
    ranks = ordered_ranks(repeats, ["this", "next"])
    ranked = written(pairs.join(ranks, ["this", "next"]).select("d", "th", "pos", "rank"), "level")
    release(pairs, repeats)
    return ranked


def least_windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(d, th, pos, len): for each line the least windows of ``min_words`` words that start or end at it."""
    key = [*AT, "seg"]
    nothing = F.lit(None).cast("int")

    def nearest(mark: Column, asked: Column, order, pick) -> DataFrame:
        """For each line the nearest line whose mark has reached what is asked: marks and questions in one order."""
        both = rows.select(*key, mark.alias("v"), F.col("pos").alias("point"), nothing.alias("asks")).unionByName(rows.select(*key, asked.alias("v"), nothing.alias("point"), F.col("pos").alias("asks")))
        w = Window.partitionBy(*key).orderBy(order("v"), F.col("asks").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("found", pick("point").over(w)).where("asks is not null and found is not null")

    begins = F.col("c") - F.col("w")
    ahead = nearest(F.col("c"), begins + min_words, F.desc, F.min).select(*AT, F.col("asks").alias("pos"), (F.col("found") - F.col("asks") + 1).alias("len"))
    back = nearest(begins, F.col("c") - min_words, F.asc, F.max).select(*AT, F.col("found").alias("pos"), (F.col("asks") - F.col("found") + 1).alias("len"))
    return ahead.unionByName(back).distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, th, first, last): disjoint stretches of lines that repeat an earlier run."""
    lines = written(line_table(docs, id_col, text_col), "lines")
    rows = written(repeated_lines(lines, min_words), "suffixes")
    windows = written(least_windows(rows, min_words).withColumn("level", F.floor(F.log2("len")).cast("int")), "windows")
    deepest = windows.agg(F.max("level")).first()[0] or 0
    level = rows.select("d", "th", "pos", "rank")
    levels = level.withColumn("level", F.lit(0))
    for k in range(deepest):
        level = doubled(level, 1 << k)
        levels = levels.unionByName(level.withColumn("level", F.lit(k + 1)))
    tail = (F.col("pos") + F.col("len") - F.pow(F.lit(2.0), F.col("level"))).cast("int")
    head = windows.withColumn("tail", tail).join(levels.withColumnRenamed("rank", "left"), [*AT, "level", "pos"])
    told = head.join(levels.select(*AT, "level", F.col("pos").alias("tail"), F.col("rank").alias("right")), [*AT, "level", "tail"]).select("d", "th", "pos", "len", "left", "right")
    told = written(told, "told")
    interval = ["len", "left", "right"]
    place = F.struct("d", "th", "pos")
    # every window but the first of its interval goes; the first is named by its place, so a common passage is not one task
    firsts = told.groupBy(*interval).agg(F.min(place).alias("first")).select("first.*", "len")
    late = told.join(firsts, [*AT, "pos", "len"], "left_anti").select("d", "th", "pos", (F.col("pos") + F.col("len") - 1).alias("end"))
    by = Window.partitionBy(*AT).orderBy("pos", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = late.withColumn("fresh", F.when(F.col("pos") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(by))
    return marked.groupBy(*AT, "run").agg(F.min("pos").alias("first"), F.max("end").alias("last")).drop("run")


def remove_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` without the later copies of repeated line runs; ``count_col`` adds how many lines went."""
    late = later_copies(docs, min_words, id_col, text_col)
    gone = late.select(*AT, F.explode(F.sequence("first", "last")).alias("pos")).groupBy(*AT).agg(F.collect_list("pos").alias("gone"))
    own = free_name("line_dedup", docs.columns)
    at, went = [f"{own}_{n}" for n in AT], f"{own}_gone"
    key = [c.alias(n) for c, n in zip(document_key(id_col, text_col), at)]
    kept = [c for c in docs.columns if c == text_col or count_col is None or c.lower() != count_col.lower()]
    keyed = docs.select(*(F.col(f"`{c}`") for c in kept), *key)
    hit = keyed.join(gone.select(*(F.col(n).alias(a) for n, a in zip(AT, at)), F.col("gone").alias(went)), at, "left")
    text = F.col(f"`{text_col}`")
    lines = F.split(text.cast("string"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(went))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    changed = F.when(F.col(went).isNull(), text).otherwise(left)
    cols = [changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept]
    return hit.select(*cols, *([F.coalesce(F.size(went), F.lit(0)).cast("long").alias(count_col)] if count_col else []))


def suffix_array(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, th, pos, rank, depth): repeated suffixes in order, each ranked to the deepest doubling at which it repeats."""
    level = written(repeated_lines(written(line_table(docs, id_col, text_col), "lines"), 0).select("d", "th", "pos", "rank"), "level")
    found, span = level.withColumn("depth", F.lit(1)), 1
    while not level.isEmpty():
        level = doubled(level, span)
        span *= 2
        found = found.unionByName(level.withColumn("depth", F.lit(span)))
    deepest = found.groupBy("d", "th", "pos").agg(F.max(F.struct("depth", "rank")).alias("x"))
    return deepest.select("d", "th", "pos", "x.rank", "x.depth")
