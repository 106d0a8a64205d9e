"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's ``docs``; all but the last return the
columns of ``documents``. Rows are told apart by themselves, not by doc_id:
rows that share an id, or have none, are documents of their own. Null or empty
text: goes in the first stage, as it has no letter. Repeated rows: one stays in
near-dedup. Ties: as the operators state. An empty table gives an empty table;
columns besides those of ``documents`` are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import language_id, line_dedup, mixing, packing, simhash
from ledgerlark.llm.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, which is set; those without letters go."""
    model = language_id.train(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    found = language_id.annotate(docs.select(*COLUMNS), model)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; those left without any line go."""
    cut = line_dedup.remove_repeated_runs(docs.select(*COLUMNS), count_col="lines_removed")
    return cut.where((F.col("lines_removed") == 0) | (F.length("text") > 0)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of the smallest id; no other document goes."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")
    taken = mixing.mix(rows, row_col="row").where("copies > 0").select("row", "copies")
    return rows.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens."""
    # the workers hold what other stages need, too
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=120_000)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k + 1}")
    return docs
