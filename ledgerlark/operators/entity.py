"""Entity resolution: match cascade, duplicates, clusters, golden records, probabilistic linkage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.sources.store import written


def match_cascade(pending: DataFrame, entities: DataFrame, steps: Sequence[tuple[str, Column, Column, float]], id_col: str = "id", entity_col: str = "entity_id") -> DataFrame:
    """(id, entity_id, method, confidence) by the first step that hits.

    A step is (method, key of the pending row, key of the entity, confidence).
    All steps are joined at once and the best is kept: one pass over each side
    instead of one join and one anti-join a step. Several entities of one key:
    the smallest id.
    """
    key = lambda i, k: F.struct(F.lit(i).alias("step"), k.alias("key"))
    left = pending.select(F.col(id_col).alias("id"), F.explode(F.array(*(key(i, p) for i, (_, p, _, _) in enumerate(steps)))).alias("k"))
    right = entities.select(F.col(entity_col).alias("entity_id"), F.explode(F.array(*(key(i, e) for i, (_, _, e, _) in enumerate(steps)))).alias("k"))
    right = right.where("k.key is not null and k.key <> ''").groupBy("k").agg(F.min("entity_id").alias("entity_id"))
    hit = left.where("k.key is not null and k.key <> ''").join(right, "k").groupBy("id").agg(F.min(F.struct("k.step", "entity_id")).alias("b"))
    pick = lambda at: F.element_at(F.array(*(F.lit(s[at]) for s in steps)), F.col("b.step") + 1)
    return hit.select("id", F.col("b.entity_id"), pick(0).alias("method"), pick(3).alias("confidence"))


def remaining_as_entities(pending: DataFrame, matched: DataFrame, name_key: Column, confidence: float = 0.70, id_col: str = "id") -> DataFrame:
    """One new entity per normalised name that no step matched; its id is a hash of the name, equal in every run."""
    left = pending.join(matched.select(F.col("id").alias(id_col)), id_col, "left_anti")
    return left.groupBy(name_key.alias("name_key")).agg(F.count("*").alias("rows")).select(F.xxhash64("name_key").alias("entity_id"), "name_key", "rows", F.lit(confidence).alias("confidence"))


def duplicate_survivors(entities: DataFrame, key: str, valid_bn: str | None = None, order: Sequence[Column] = (), id_col: str = "entity_id") -> DataFrame:
    """(absorbed, survivor) of entities with equal keys; with ``valid_bn`` only where a key has at most one number.

    The survivor is the least by ``order`` and then by id, found by an aggregate: a key of any size is no task of its own.
    """
    rows = entities.where(F.col(key).isNotNull() & (F.col(key) != ""))
    if valid_bn:
        safe = rows.groupBy(key).agg(F.countDistinct(valid_bn).alias("n")).where("n <= 1").select(key)
        rows = rows.join(safe, key, "left_semi")
    best = rows.groupBy(key).agg(F.min_by(id_col, F.struct(*order, F.col(id_col))).alias("survivor"))
    return rows.join(best, key).select(F.col(id_col).alias("absorbed"), "survivor").where("absorbed <> survivor")


def merge_clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster) of accepted pairs (id_a, id_b): connected components by least label with pointer jumping."""
    edges = written(pairs.select(F.col("id_a").alias("x"), F.col("id_b").alias("y")).unionByName(pairs.select(F.col("id_b").alias("x"), F.col("id_a").alias("y"))).distinct(), "pairs")
    labels = written(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("cluster")), "labels")
    state = None
    while True:
        seen = edges.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("cluster").alias("near"))
        nearer = labels.join(seen, "id").select("id", F.least("cluster", "near").alias("cluster"))
        jump = nearer.select(F.col("id").alias("cluster"), F.col("cluster").alias("next"))
        labels = written(nearer.join(jump, "cluster", "left").select("id", F.coalesce(F.least("cluster", "next"), "cluster").alias("cluster")), "labels")
        now = labels.agg(F.count("*"), F.sum(F.xxhash64("id", "cluster").cast("decimal(38,0)"))).first()
        if now == state:
            return labels
        state = now


def merge_entities(entities: DataFrame, clusters: DataFrame, id_col: str = "entity_id", lists: Sequence[str] = ("names",)) -> DataFrame:
    """One row per cluster with the union of the list columns: applying it twice changes nothing."""
    j = entities.join(clusters.select(F.col("id").alias(id_col), "cluster"), id_col, "left").withColumn("survivor", F.coalesce("cluster", id_col))
    return j.groupBy("survivor").agg(F.count("*").alias("members"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists))


def unmerge(merges: DataFrame, bad: DataFrame) -> DataFrame:
    """Merge pairs left when the bad ones (id_a, id_b in any order) are taken back; cluster them anew."""
    b = bad.select(F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi"))
    m = merges.withColumn("lo", F.least("id_a", "id_b")).withColumn("hi", F.greatest("id_a", "id_b"))
    return m.join(b, ["lo", "hi"], "left_anti").drop("lo", "hi")


def best_candidates(*tiers: DataFrame) -> DataFrame:
    """(id_a, id_b, method, confidence): each unordered pair once, by its most confident tier."""
    both = None
    for t in tiers:
        t = t.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "method", "confidence").where("id_a <> id_b")
        both = t if both is None else both.unionByName(t)
    return both.groupBy("id_a", "id_b").agg(F.max(F.struct("confidence", "method")).alias("b")).select("id_a", "id_b", "b.method", "b.confidence")


def golden_records(entities: DataFrame, links: DataFrame, names: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """One row per entity: most frequent name, aliases, sources with counts. Each part is aggregated before it is joined.

    ``names``: (id, name), ``links``: (id, source).
    """
    counted = names.groupBy(id_col, "name").agg(F.count("*").alias("n"))
    n = counted.groupBy(id_col).agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("canonical"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("aliases"))
    s = links.groupBy(id_col, "source").agg(F.count("*").alias("n")).groupBy(id_col).agg(F.sum("n").alias("link_count"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", F.col("n").cast("string")))), "|").alias("sources"))
    return entities.select(id_col).distinct().join(n, id_col, "left").join(s, id_col, "left").withColumn("link_count", F.coalesce("link_count", F.lit(0)).cast("bigint"))


def search(entities: DataFrame, query: str, id_col: str = "entity_id", name: str = "name", aliases: str = "aliases", bn: str = "bn", n: int = 30, least: float = 0.3) -> DataFrame:
    """The ``n`` best entities: nine digits and more ask for a number, other text for names that contain it or resemble it."""
    from ledgerlark.functions.names import trigram_similarity

    digits = "".join(c for c in query if c.isdigit())
    if len(digits) >= 9:
        return entities.where(F.col(bn) == digits[:9]).select(id_col, name, F.lit(1.0).alias("score")).orderBy(id_col).limit(n)
    each = entities.select(id_col, name, F.explode(F.array_union(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))).alias("a"))
    score = F.greatest(trigram_similarity(F.col("a"), F.lit(query)), F.when(F.upper("a").contains(query.upper()), 0.9).otherwise(0.0))
    return each.withColumn("score", score).groupBy(id_col, name).agg(F.max("score").alias("score")).where(F.col("score") >= least).orderBy(F.col("score").desc(), id_col).limit(n)


def agreement_patterns(pairs: DataFrame, levels: Sequence[Column]) -> DataFrame:
    """(g0, g1, ..., n): how many pairs show each vector of comparison levels. The linkage model needs no more."""
    named = [c.alias(f"g{i}") for i, c in enumerate(levels)]
    return pairs.select(*named).groupBy(*(f"g{i}" for i in range(len(levels)))).agg(F.count("*").alias("n"))


def fellegi_sunter(patterns: DataFrame, sizes: Sequence[int], u: Sequence[Sequence[float]] | None = None, prior: float = 1 / 50_000, rounds: int = 40) -> tuple[list[list[float]], list[list[float]], float, list[float]]:
    """(m, u, share of matches, log-likelihoods) by expectation-maximisation over pattern counts (at most prod(sizes) rows)."""
    rows = patterns.collect()
    g = np.array([[r[f"g{i}"] for i in range(len(sizes))] for r in rows], int).reshape(len(rows), len(sizes))
    n = np.array([r.n for r in rows], float)
    start = lambda k: np.append(np.full(k - 1, 0.1 / max(1, k - 1)), 0.9)
    m = [start(k) for k in sizes]
    v = [np.array(x, float) for x in u] if u else [start(k)[::-1] for k in sizes]
    share, seen = max(prior, 1e-9), []
    for _ in range(rounds):
        pm = share * np.prod([m[i][g[:, i]] for i in range(len(sizes))], axis=0)
        pu = (1 - share) * np.prod([v[i][g[:, i]] for i in range(len(sizes))], axis=0)
        seen.append(float((n * np.log(pm + pu)).sum()))
        w = n * pm / (pm + pu)
        share = float(np.clip(w.sum() / n.sum(), 1e-9, 1 - 1e-9))
        for i, k in enumerate(sizes):
            m[i] = np.maximum(np.bincount(g[:, i], w, k) / max(w.sum(), 1e-12), 1e-6)
            m[i] /= m[i].sum()
            if u is None:
                v[i] = np.maximum(np.bincount(g[:, i], n - w, k) / max((n - w).sum(), 1e-12), 1e-6)
                v[i] /= v[i].sum()
    return [list(map(float, x)) for x in m], [list(map(float, x)) for x in v], share, seen


def match_probability(levels: Sequence[Column], m: Sequence[Sequence[float]], u: Sequence[Sequence[float]], share: float, more: Column | None = None) -> Column:
    """Posterior of a pair from its comparison levels: summed log2 weights as an expression, no UDF; ``more`` is added to them."""
    weight = F.lit(float(np.log2(share / (1 - share)))) + (F.lit(0.0) if more is None else F.coalesce(more, F.lit(0.0)))
    for c, mi, ui in zip(levels, m, u):
        weight = weight + F.element_at(F.array(*(F.lit(float(np.log2(a / b))) for a, b in zip(mi, ui))), c + 1)
    odds = F.pow(F.lit(2.0), F.least(F.greatest(weight, F.lit(-60.0)), F.lit(60.0)))
    return odds / (1 + odds)


def levels_u(rows: DataFrame, levels: dict[str, tuple[Column, int]], sample: int = 1_000_000, id_col: str = "id") -> list[list[float]]:
    """How often two random records agree at each level: ``sample`` pairs at most, each record beside those that follow it in the order of a hash.

    ``levels``: name to (level from columns x_a and x_b, number of levels).
    """
    n = rows.count()
    apart = max(1, min(5, sample // max(1, n)))
    near = rows.select("*", F.conv(F.left(F.md5(F.col(id_col).cast("string")), F.lit(15)), 16, 10).cast("long").alias("_h")).repartitionByRange("_h")
    by = Window.partitionBy(F.spark_partition_id()).orderBy("_h", id_col)
    whole = F.struct(*rows.columns)
    pairs = None
    for k in range(1, apart + 1):
        one = near.select(whole.alias("a"), F.lead(whole, k).over(by).alias("b")).where("b is not null")
        pairs = one if pairs is None else pairs.unionByName(one)
    flat = pairs.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in rows.columns))
    counted = flat.agg(*(F.count_if(level == k).alias(f"{name}_{k}") for name, (level, size) in levels.items() for k in range(size))).first()
    out = []
    for name, (_, size) in levels.items():
        got = np.array([counted[f"{name}_{k}"] for k in range(size)], float) + 0.5
        out.append(list(map(float, got / got.sum())))
    return out


def frequency_weight(level: Column, top: int, u_exact: float, share_of_value: Column) -> Column:
    """Log2 factor by which agreement on a rare value counts more, and on a common one less, than agreement as such."""
    return F.when(level == top, F.log2(F.lit(u_exact)) - F.log2(F.greatest(share_of_value, F.lit(1e-9)))).otherwise(0.0)


def aliases_of(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, canonical, alias, records): every other name in a cluster beside its most frequent one. ``names``: (id, name)."""
    n = names.join(clusters, "id").groupBy("cluster", "name").agg(F.count("*").alias("records"))
    lead = n.groupBy("cluster").agg(F.min_by("name", F.struct(-F.col("records"), F.col("name"))).alias("canonical"))
    return n.join(lead, "cluster").where("name <> canonical").select("cluster", "canonical", F.col("name").alias("alias"), "records")


# What a verdict makes of a candidate.
VERDICTS = {"SAME": "same", "RELATED": "related", "DIFFERENT": "different"}


def parsed_verdicts(answers: DataFrame, text: str = "response") -> DataFrame:
    """``answers`` with verdict, confidence and status read from a JSON answer, with or without a code fence around it; unreadable ones are uncertain."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```\w*\n?", ""), r"\n?```\s*$", ""))
    read = F.from_json(bare, "verdict string, confidence double")
    status = F.element_at(F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv)), F.upper(F.col("verdict")))
    return answers.withColumn("read", read).select(*answers.columns, "read.verdict", "read.confidence").withColumn("status", F.coalesce(status, F.lit("uncertain")))


def promoted(verdicts: DataFrame, gate: float = 0.7) -> DataFrame:
    """Pairs that the gate on similarity had left out and a verdict calls the same, as matches of the verdict's confidence."""
    return verdicts.where((F.col("status") == "same") & (F.col("similarity") < gate)).select("id_a", "id_b", F.lit("verdict").alias("method"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def pipeline_status(predictions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(measure, n): predictions by band of probability, clusters, candidates by status. ``predictions``: (probability, cluster), ``candidates``: (status)."""
    p = F.col("probability")
    bands = [("predictions", F.count("*")), ("high", F.count_if(p >= 0.95)), ("middle", F.count_if((p >= 0.70) & (p < 0.95))), ("review", F.count_if((p >= 0.40) & (p < 0.70))), ("clusters", F.countDistinct("cluster"))]
    one = predictions.agg(*(c.alias(n) for n, c in bands))
    counted = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).alias("n")) for n, _ in bands))).alias("x")).select("x.*")
    return counted.unionByName(candidates.groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("status:"), "status").alias("measure"), "n"))
