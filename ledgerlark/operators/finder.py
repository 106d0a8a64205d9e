"""Names looked up in several sources at once, and names that do not fit their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import names as N
from ledgerlark.operators import similarity as M
from ledgerlark.sources.store import written

EXACT, TRIGRAM, EDITS = "exact", "trigram", "levenshtein"


def best_per_source(asked: DataFrame, known: DataFrame, least: float = 0.6, edits: int = 3, longest: int = 40) -> DataFrame:
    """(id, source, matched_name, confidence, method): for each asked name the best name of each source that has one.

    ``asked``: (id, name), ``known``: (source, name). Names are compared upper
    case and trimmed: equal ones at 1, else by shared trigrams, and for names
    under ``longest`` letters also by edits, 1 - edits / longest name. The most
    confident counts; ties go to the earlier way, then to the smaller name.
    Equal names are one text while they are compared, and asked names meet
    known ones alone, not each other. Null and empty names match nothing.
    """
    plain = lambda c: F.upper(F.trim(c))
    a = written(asked.select("id", plain(F.col("name")).alias("t")).where("t <> ''"), "asked")
    k = written(known.select("source", "name", plain(F.col("name")).alias("t")).where("t <> ''").groupBy("source", "t").agg(F.min("name").alias("matched_name")), "known")
    texts = a.select("t", F.lit(True).alias("is_asked")).unionByName(k.select("t", F.lit(False).alias("is_asked"))).groupBy("t").agg(F.max("is_asked").alias("asked"), F.min("is_asked").alias("only")).withColumn("known", ~F.col("only")).drop("only")
    texts = written(texts.withColumn("id", F.xxhash64("t")), "texts")
    side = lambda s: texts.select(F.col("id").alias(f"id_{s}"), F.col("t").alias(f"t_{s}"), F.col("asked").alias(f"asked_{s}"), F.col("known").alias(f"known_{s}"))

    def named(pairs: DataFrame, method: str, confidence: str) -> DataFrame:
        j = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
        one = lambda x, y: j.where(f"asked_{x} and known_{y}").select(F.col(f"t_{x}").alias("t"), F.col(f"t_{y}").alias("to"), F.lit(method).alias("method"), F.round(confidence, 2).alias("confidence"))
        return one("a", "b").unionByName(one("b", "a"))

    rows, between = texts.select("id", F.col("t").alias("name"), "asked", "known"), ("asked", "known")
    found = texts.where("asked and known").select("t", F.col("t").alias("to"), F.lit(EXACT).alias("method"), F.lit(1.0).alias("confidence"))
    found = found.unionByName(named(M.trigram_join(rows, least, between=between), TRIGRAM, "similarity"))
    near = M.levenshtein_match(rows.where(F.length("name") < longest), [], edits, longest, between=between)
    found = found.unionByName(named(near, EDITS, "confidence").where(F.col("confidence") >= least))
    order = F.when(F.col("method") == EXACT, 0).when(F.col("method") == TRIGRAM, 1).otherwise(2)
    hit = found.join(k.withColumnRenamed("t", "to"), "to").groupBy("t", "source").agg(F.min_by(F.struct("matched_name", "confidence", "method"), F.struct(-F.col("confidence"), order, F.col("matched_name"))).alias("b"))
    return a.join(hit, "t").select("id", "source", "b.matched_name", "b.confidence", "b.method")


# What a cited number and name are to the registry.
PLACEHOLDER, MALFORMED, UNREGISTERED, MINOR, MISMATCH = "PLACEHOLDER_BN", "MALFORMED_BN", "UNREGISTERED_BN", "MINOR_VARIANT", "NAME_MISMATCH"


def mismatch_category(number: Column, registered: Column, name: Column, similarity: Column, least: float) -> Column:
    """Category of a cited number and name; ``registered`` is the name that the registry has for the number, or null."""
    same = (similarity >= least) | (N.norm_name(name) == N.norm_name(registered))
    return F.when(number.rlike("^0{9}"), PLACEHOLDER).when(~number.rlike("^[0-9]{9}RR[0-9]{4}$"), MALFORMED).when(registered.isNull(), UNREGISTERED).when(same, MINOR).otherwise(MISMATCH)


def cited_names(citations: DataFrame, registry: DataFrame, least: float = 0.5) -> DataFrame:
    """(number, name, canonical_name, category, defect, similarity, citations, total) per cited pair.

    ``citations``: (number, name, amount), ``registry``: (number, legal_name, year), of which the latest name of a number counts.
    """
    cited = citations.select(F.trim("number").alias("number"), F.trim("name").alias("name"), F.coalesce("amount", F.lit(0)).alias("amount")).where("number is not null and name <> ''")
    cited = cited.groupBy("number", "name").agg(F.count("*").alias("citations"), F.sum("amount").alias("total"))
    latest = registry.groupBy("number").agg(F.max_by("legal_name", F.struct("year", "legal_name")).alias("canonical_name"))
    j = cited.join(latest, "number", "left")
    alike = N.trigram_similarity(N.norm_name(F.col("name")), N.norm_name(F.col("canonical_name")))
    j = j.withColumn("alike", F.when(F.col("canonical_name").isNotNull(), alike))
    told = mismatch_category(F.col("number"), F.col("canonical_name"), F.col("name"), F.col("alike"), least)
    return j.select("number", "name", "canonical_name", told.alias("category"), N.bn_defect(F.col("number")).alias("defect"), F.round("alike", 3).alias("similarity"), "citations", "total")
