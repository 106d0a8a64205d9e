"""Inverted index with stems and positions: postings as sorted, sharded Parquet, and searches that read the asked terms alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64

# Parameters: a task indexes about so many bytes of text, and fewer down to so many where cores would be idle.
TASK_TEXT = 32_000_000
LEAST_TEXT = 1_000_000


def _singular(word: Column) -> Column:
    n = F.length(word)
    return F.when(word.endswith("sses"), _cut(word, 2)).when(word.endswith("ies") & (n > 4), F.concat(_cut(word, 3), F.lit("y"))).when(word.endswith("s") & ~word.endswith("ss") & (n > 3), _cut(word, 1)).otherwise(word)


def _base(one: Column) -> Column:
    m = F.length(one)
    return F.when(one.endswith("ing") & (m >= 6), _cut(one, 3)).when((one.endswith("ed") | one.endswith("ly")) & (m >= 5), _cut(one, 2)).otherwise(one)


def _cut(c: Column, k: int) -> Column:
    return F.left(c, F.greatest(F.length(c) - k, F.lit(0)))


def stem(word: Column) -> Column:
    """English stem of a lower-case word: plural endings, then one of -ing, -ed, -ly, where enough of the word is left."""
    return _base(_singular(word))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc, positions, size): one row per stem and document; ``size`` is the document's words. Null texts have none, null ids are left out. Ids name documents.

    A document's words are sorted inside its row, where equal stems then stand
    together: no word is exchanged. A common term is as many rows as documents
    hold it, never one list.
    """
    w = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w"))
    stemmed = F.transform(F.transform("w", _singular), lambda x, i: F.struct(_base(x).alias("term"), i.alias("at")))
    s = w.select("doc", F.size("w").alias("size"), F.sort_array(stemmed).alias("s"))
    first = lambda i: (i == 0) | (F.col("s")[i]["term"] != F.col("s")[F.greatest(i - 1, F.lit(0))]["term"])
    s = s.select("*", F.filter(F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") - 1)), first).alias("begins"))
    places = lambda i, k: F.transform(F.sequence(i, F.coalesce(F.get("begins", k + 1), F.col("size")) - 1), lambda j: F.col("s")[j]["at"])
    terms = F.transform("begins", lambda i, k: F.struct(F.col("s")[i]["term"].alias("term"), places(i, k).alias("positions")))
    return s.select("doc", "size", F.explode(terms).alias("x")).select("x.term", "doc", "x.positions", "size")


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents dealt by their bytes, so that one task's postings are sorted in memory: their texts are exchanged, a part of what their postings are."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    few = min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_TEXT))
    return docs.repartition(max(1, few, -(-size // TASK_TEXT)), id_col)


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Write the postings of ``docs`` in ``shards`` folders and read them again. A task writes its documents' part of each shard, sorted by term."""
    # documents without an id would be one task
    docs = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    rows = postings(_dealt(docs, id_col, text_col), id_col, text_col).withColumn("shard", _shard(F.col("term"), shards))
    rows.sortWithinPartitions("shard", "term", "doc").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass
class Search:
    """What is asked: words that all must stand, of which any must, of which none may, a phrase, and beginnings of words."""

    all_of: Sequence[str] = ()
    any_of: Sequence[str] = ()
    none_of: Sequence[str] = ()
    phrase: Sequence[str] = ()
    beginning: str = ""


def stems(spark: SparkSession, asked: Sequence[str]) -> list[str]:
    """Stems of the asked words, by the same expression as those of the texts."""
    if not asked:
        return []
    rows = spark.createDataFrame([(i, w.lower()) for i, w in enumerate(asked)], "i int, w string")
    return [r.s for r in rows.select("i", stem(F.col("w")).alias("s")).orderBy("i").collect()]


def asked_postings(index: DataFrame, terms: Sequence[str], beginning: str = "", shards: int = SHARDS) -> DataFrame:
    """Postings of the terms: their shards are pruned by name, the terms are pushed to the scan. A beginning is looked up in all shards."""
    spark = index.sparkSession
    found = F.lit(False)
    if terms:
        where = [r.s for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_shard(F.col("t"), shards).alias("s")).distinct().collect()]
        found = F.col("shard").isin(where) & F.col("term").isin(list(terms))
    if beginning:
        found = found | F.col("term").startswith(beginning) if terms else F.col("term").startswith(beginning)
    return index.where(found)


def phrase_hits(index: DataFrame, terms: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """(doc, hits): how often the terms stand one after the other, from their positions alone."""
    rows = asked_postings(index, sorted(set(terms)), shards=shards)
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(terms)))
    each = rows.select("doc", "positions", "term", F.explode(at).alias("x")).where("term = x.t")
    starts = each.select("doc", F.col("x.i").alias("i"), F.explode("positions").alias("at")).groupBy("doc", (F.col("at") - F.col("i")).alias("start")).agg(F.count("*").alias("n"))
    return starts.where(F.col("n") == len(terms)).groupBy("doc").agg(F.count("*").alias("hits"))


def search(index: DataFrame, asked: Search, shards: int = SHARDS) -> DataFrame:
    """(doc, score, phrase_hits) of the documents that meet all that is asked, best first by score: how much of the text the asked words are.

    What is not asked does not limit. Words are stemmed; a beginning is not.
    Documents that lack every asked term are not read.
    """
    spark = index.sparkSession
    must, some, never, phrase = (stems(spark, x) for x in (asked.all_of, asked.any_of, asked.none_of, asked.phrase))
    if not (must or some or phrase or asked.beginning):
        raise ValueError("nothing is asked for")
    rows = asked_postings(index, sorted({*must, *some, *never, *phrase}), asked.beginning, shards)
    has = lambda t: F.max(F.when(F.col("term") == t, 1).otherwise(0)) == 1
    wanted = F.col("term").isin([*must, *some, *phrase]) | (F.col("term").startswith(asked.beginning) if asked.beginning else F.lit(False))
    tests = [has(t) for t in must] + ([F.max(F.col("term").isin(some).cast("int")) == 1] if some else []) + [~has(t) for t in never]
    tests += [F.max(F.col("term").startswith(asked.beginning).cast("int")) == 1] if asked.beginning else []
    ok = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        ok = ok & t
    score = F.sum(F.when(wanted, F.size("positions")).otherwise(0)) / F.first("size")
    found = rows.groupBy("doc").agg(ok.alias("ok"), score.alias("score")).where("ok").drop("ok")
    if phrase:
        found = found.join(phrase_hits(index, phrase, shards), "doc").withColumnRenamed("hits", "phrase_hits")
    else:
        found = found.withColumn("phrase_hits", F.lit(0).cast("long"))
    return found.select("doc", "score", "phrase_hits")
