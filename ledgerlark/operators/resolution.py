"""Entity resolution: candidates in tiers, clusters under cannot-link rules, survivors, redirects, audit, unmerge.

Entities are rows (id, name, norm, bn, sources, links): ``bn`` is a valid number
or null, ``sources`` an array, ``links`` the number of source rows that point at
the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import names as N
from ledgerlark.operators import entity as E
from ledgerlark.operators import similarity as M
from ledgerlark.sources.store import dealt, release, written

# Method and confidence of the tiers, and what a trade name is introduced by.
NORM_NAME, SHARED_BN, TRADE_SECOND, TRADE_FIRST, DBA = ("norm_name", 1.0), ("shared_bn", 0.99), ("trade_name", 0.90), ("trade_name_fwd", 0.88), ("dba_oa", 0.88)
TRADE_MARK, DBA_MARKS = "TRADE NAME OF", (" O/A ", " DBA ")
TRIGRAM, LEAST_TRIGRAM, LINKAGE = "trigram", 0.65, "splink_match"
LINKAGE_RANGE = (0.40, 0.95)
CHARITY = "cra"


def _part(name: Column, mark: str, k: int) -> Column:
    """The ``k``-th part of a name around a mark, normalised; null without the mark or where nothing is left."""
    norm = N.norm_name(F.split_part(F.upper(name), F.lit(mark), F.lit(k)))
    return F.when(F.upper(name).contains(mark) & (norm != ""), norm)


def trade_keys(name: Column) -> list[tuple[tuple[str, float], Column]]:
    """Names inside a name: what follows and what precedes a trade-name mark, and what follows another such mark."""
    after = F.coalesce(*(_part(name, mark, 2) for mark in DBA_MARKS))
    return [(TRADE_SECOND, _part(name, TRADE_MARK, 2)), (TRADE_FIRST, _part(name, TRADE_MARK, 1)), (DBA, after)]


def _star(rows: DataFrame, key: str, tier: tuple[str, float]) -> DataFrame:
    """One link from each entity of a key to the first of it; pairs of large groups are not listed."""
    first = rows.groupBy(key).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, key).where("id <> first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(tier[0]).alias("method"), F.lit(tier[1]).alias("confidence"))


def numbers_conflict(bn_a: Column, bn_b: Column, sources_a: Column, sources_b: Column) -> Column:
    """Two registered charities with numbers of their own are two entities, whatever their names."""
    charities = F.array_contains(sources_a, CHARITY) & F.array_contains(sources_b, CHARITY)
    return F.coalesce(charities & (bn_a != bn_b), F.lit(False))


def candidates(entities: DataFrame, predictions: DataFrame | None = None, least_trigram: float = LEAST_TRIGRAM) -> DataFrame:
    """(id_a, id_b, method, confidence, status): each pair once, by its most confident tier.

    Tiers: same normalised name, same number, trade names, similar trigrams,
    linkage predictions (id_a, id_b, probability) that are neither sure nor
    hopeless. Equal names and numbers are linked to the first of their kind and
    not pair by pair. Status is ``different`` where numbers conflict, else
    ``pending``. Names under three letters, and under five for trigrams, are
    not compared; null names and numbers pair with nothing.
    """
    e = written(entities.select("id", "name", "norm", "bn", "sources"), "entities")
    named = e.where(F.length("norm") >= 3).select("id", "norm")
    tiers = [_star(named, "norm", NORM_NAME), _star(e.where("bn is not null").select("id", "bn"), "bn", SHARED_BN)]
    firsts = named.groupBy("norm").agg(F.min("id").alias("to"))
    for (method, confidence), key in trade_keys(F.col("name")):
        inside = e.select("id", key.alias("norm")).where("norm is not null").join(firsts, "norm").where("id <> to")
        tiers.append(inside.select(F.col("id").alias("id_a"), F.col("to").alias("id_b"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")))
    # equal names are one text here, and the tier of equal names has linked them
    texts = firsts.where(F.length("norm") >= 5).select(F.col("to").alias("id"), F.col("norm").alias("name"))
    alike = M.trigram_join(texts, least_trigram)
    tiers.append(alike.select("id_a", "id_b", F.lit(TRIGRAM).alias("method"), F.round("similarity", 6).alias("confidence")))
    if predictions is not None:
        tiers.append(predictions.where(F.col("probability").between(*LINKAGE_RANGE)).select("id_a", "id_b", F.lit(LINKAGE).alias("method"), F.col("probability").alias("confidence")))
    best = E.best_candidates(*tiers)
    side = lambda s: e.select(F.col("id").alias(f"id_{s}"), F.col("bn").alias(f"bn_{s}"), F.col("sources").alias(f"sources_{s}"))
    j = best.join(side("a"), "id_a").join(side("b"), "id_b")
    apart = numbers_conflict(F.col("bn_a"), F.col("bn_b"), F.col("sources_a"), F.col("sources_b"))
    return j.select("id_a", "id_b", "method", "confidence", F.when(apart, "different").otherwise("pending").alias("status"))


def _crossing(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges between two clusters that may still be one: (a, b, and the edge)."""
    side = lambda s: clusters.select(F.col("id").alias(f"id_{s}"), F.col("cluster").alias(s), F.col("number").alias(f"number_{s}"))
    j = edges.join(side("a"), "id_a").join(side("b"), "id_b").where("a <> b")
    return j.where(F.coalesce(F.col("number_a") == F.col("number_b"), F.lit(True)))


def _contracted(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """Clusters with those of one group as one. ``groups``: (cluster, into)."""
    j = clusters.join(groups, "cluster", "left").withColumn("cluster", F.coalesce("into", "cluster")).drop("into")
    told = j.groupBy("cluster").agg(F.max("number").alias("number"))
    return written(j.drop("number").join(told, "cluster").select("id", "cluster", "number"), "clusters")


def _groups(pairs: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of cluster pairs (a, b): (cluster, into) of those with one number at most, and of the others."""
    parts = E.merge_clusters(pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))).select(F.col("id").alias("cluster"), F.col("cluster").alias("into"))
    numbers = clusters.select("cluster", "number").distinct().join(parts, "cluster").groupBy("into").agg(F.countDistinct("number").alias("n"))
    told = written(parts.join(numbers, "into").select("cluster", "into", "n"), "groups")
    return told.where("n <= 1").select("cluster", "into"), told.where("n > 1").select("cluster", "into")


def cannot_link_clusters(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster, number): clusters of ``edges`` (id_a, id_b, confidence), none of which holds two numbers.

    As if edges were taken one by one, the most confident first (ties: fewer
    numbered ends, then a hash of the ids), and each joined its clusters unless
    two different numbers would meet. Components with one number at most are
    clusters at once. In the others the best kind of edge is contracted
    wherever that brings no two numbers together, and where it would, edges
    that are the best of both their clusters; edges between conflicting
    clusters go. So rounds grow with the kinds of edges in components in
    dispute and the logarithm of their size. Entities without an edge are
    clusters of their own; rows with a null id take no part.
    """
    own = entities.where("id is not null").groupBy("id").agg(F.max("bn").alias("number"))
    clusters = written(own.select("id", F.col("id").alias("cluster"), "number"), "clusters")
    flag = lambda s: own.select(F.col("id").alias(f"id_{s}"), F.col("number").isNotNull().cast("int").alias(f"has_{s}"))
    e = edges.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "confidence").where("id_a <> id_b").groupBy("id_a", "id_b").agg(F.max("confidence").alias("confidence"))
    e = e.join(flag("a"), "id_a").join(flag("b"), "id_b").select("id_a", "id_b", F.struct((-F.col("confidence")).alias("c"), (F.col("has_a") + F.col("has_b")).alias("n")).alias("kind"), F.xxhash64("id_a", "id_b").alias("h"))
    e = written(e, "edges")
    while True:
        left = written(_crossing(e, clusters).select("id_a", "id_b", "kind", "h", "a", "b"), "crossing")
        if left.isEmpty():
            return clusters
        safe, unsafe = _groups(left, clusters)
        if not safe.isEmpty():
            clusters = _contracted(clusters, safe)
        if not unsafe.isEmpty():
            disputed = left.join(unsafe.withColumnRenamed("cluster", "a"), "a")
            best = disputed.groupBy("into").agg(F.min("kind").alias("best"))
            first = written(disputed.join(best, "into").where("kind = best").select("a", "b", "h", "id_a", "id_b"), "best")
            safe, unsafe = _groups(first, clusters)
            if not safe.isEmpty():
                clusters = _contracted(clusters, safe)
            if not unsafe.isEmpty():
                hard = first.join(unsafe.select(F.col("cluster").alias("a")), "a", "left_semi")
                order = F.struct("h", "id_a", "id_b")
                ends = hard.select(F.col("a").alias("x"), order.alias("o")).unionByName(hard.select(F.col("b").alias("x"), order.alias("o"))).groupBy("x").agg(F.min("o").alias("o"))
                mine = lambda s: ends.select(F.col("x").alias(s), F.col("o").alias(f"o_{s}"))
                mutual = hard.withColumn("o", order).join(mine("a"), "a").join(mine("b"), "b").where("o = o_a and o = o_b")
                pairs = mutual.select(F.explode(F.array(F.struct(F.col("a").alias("cluster"), F.least("a", "b").alias("into")), F.struct(F.col("b").alias("cluster"), F.least("a", "b").alias("into")))).alias("p")).select("p.*").distinct()
                clusters = _contracted(clusters, written(pairs, "mutual"))
        release(left)


def survivors(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, survivor) of all entities: in each cluster one with a number stays, then a charity, then the one with most links, then the first."""
    rank = F.struct(F.col("bn").isNull(), ~F.coalesce(F.array_contains("sources", CHARITY), F.lit(False)), -F.coalesce("links", F.lit(0)), F.col("id"))
    ranked = clusters.select("id", "cluster").join(entities.select("id", "bn", "sources", "links"), "id")
    best = ranked.groupBy("cluster").agg(F.min_by("id", rank).alias("survivor"))
    return ranked.join(best, "cluster").select("id", "survivor")


def merged(entities: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per survivor: names, numbers and sources of all that it took in, and the sum of their links."""
    j = entities.join(kept, "id")
    listed = lambda c: F.array_sort(F.collect_set(c))
    each = j.groupBy("survivor").agg(F.count("*").alias("members"), F.max("bn").alias("bn"), listed("name").alias("names"), listed("bn").alias("numbers"), F.sum("links").alias("links"))
    sources = j.select("survivor", F.explode("sources").alias("source")).groupBy("survivor").agg(listed("source").alias("sources"))
    return each.join(sources, "survivor", "left")


def redirected(links: DataFrame, kept: DataFrame, column: str = "entity_id") -> DataFrame:
    """``links`` with absorbed entities replaced by their survivors; applying it twice changes nothing."""
    to = kept.where("id <> survivor").select(F.col("id").alias("_from"), F.col("survivor").alias("_to"))
    return links.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).select(*links.columns)


def audit(edges: DataFrame, kept: DataFrame, links: DataFrame, column: str = "entity_id") -> DataFrame:
    """(survivor, id_a, id_b, method, confidence, links_redirected): the accepted edges inside each cluster, and the links of both ends that moved."""
    side = lambda s: kept.select(F.col("id").alias(f"id_{s}"), F.col("survivor").alias(f"to_{s}"))
    moved = links.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).join(kept.where("id <> survivor").select("id"), "id")
    count = lambda s: moved.select(F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"))
    j = edges.join(side("a"), "id_a").join(side("b"), "id_b").where("to_a = to_b").join(count("a"), "id_a", "left").join(count("b"), "id_b", "left")
    n = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
    return j.select(F.col("to_a").alias("survivor"), "id_a", "id_b", "method", "confidence", n.alias("links_redirected"))


def unmerged(entities: DataFrame, log: DataFrame, bad: DataFrame) -> DataFrame:
    """(id, survivor) of the entities whose clusters a bad merge touched, recomputed from what is left of the audit.

    ``log``: the audit; ``bad``: pairs (id_a, id_b) in any order that were
    wrongly taken for one. Clusters that no bad pair touches are not looked at.
    """
    b = bad.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.lit(True).alias("bad")).distinct()
    marked = written(log.select("survivor", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "confidence").join(b, ["id_a", "id_b"], "left"), "audit")
    touched = marked.join(marked.where("bad").select("survivor").distinct(), "survivor", "left_semi")
    ids = touched.select(F.col("id_a").alias("id")).unionByName(touched.select(F.col("id_b").alias("id"))).distinct()
    some = written(entities.join(ids, "id", "left_semi"), "touched")
    return survivors(cannot_link_clusters(some, touched.where("bad is null")), some)


def resolve_pending(pending: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entity, method, confidence): every pending name gets an entity.

    ``pending``: (id, name, bn), ``entities``: (id, name, norm, bn). By number,
    exact name, normalised name, the part after a bar, the name that a trade
    name stands for; then one new entity per number that nothing has, and one
    per remaining normalised name. ``entity`` is an id, or ``bn:`` and ``name:``
    with the key of a new one. A name of no letters stays without an entity.
    """
    long = lambda c: F.when(F.length(c) >= 3, c)
    bar = F.when(F.col("name").contains("|"), N.norm_name(F.split_part("name", F.lit("|"), F.lit(2))))
    # names are normalised once, over all tasks: later plans read the columns and not the expressions
    p = dealt(pending.select("id", "name", "bn"), "id").select("*", N.norm_name(F.col("name")).alias("norm"), bar.alias("bar"), _part(F.col("name"), TRADE_MARK, 2).alias("trade"))
    p = written(p, "pending")
    e = lambda c: F.col(f"e_{c}")
    known = entities.select(F.col("id").alias("entity_id"), *(F.col(c).alias(f"e_{c}") for c in ("name", "norm", "bn")))
    steps = [("bn_anchor", F.col("bn"), e("bn"), 0.99), ("exact_name", F.upper("name"), F.upper(e("name")), 0.95), ("normalized", long(F.col("norm")), e("norm"), 0.90), ("pipe_split", F.col("bar"), e("norm"), 0.88), ("trade_name", F.col("trade"), e("norm"), 0.88)]
    hit = E.match_cascade(p, known, steps).select("id", F.col("entity_id").cast("string").alias("entity"), "method", "confidence")
    rest = p.join(hit.select("id"), "id", "left_anti")
    made = F.when(F.col("bn").isNotNull(), F.concat(F.lit("bn:"), "bn")).when(F.col("norm") != "", F.concat(F.lit("name:"), "norm"))
    new = rest.select("id", made.alias("entity"), F.when(F.col("bn").isNotNull(), "bn_new").when(F.col("norm") != "", "new_name").alias("method"), F.when(F.col("bn").isNotNull(), 0.85).when(F.col("norm") != "", 0.70).alias("confidence"))
    return hit.unionByName(new)


def golden_profiles(entities: DataFrame, kept: DataFrame, pairs: DataFrame, links: DataFrame, place: str = "province", year: str = "year", column: str = "entity_id") -> DataFrame:
    """One row per survivor: canonical name (that of most links), aliases, numbers, sources, addresses, related entities, history, absorbed ids.

    Each part is aggregated by survivor before it is joined. Related are the
    survivors that a candidate pair met and that are still another entity.
    """
    m = written(entities.join(kept, "id"), "members")

    def told(rows: DataFrame, key: str, n: Column, name: str) -> DataFrame:
        each = rows.groupBy("survivor", key).agg(n.alias("n")).select("survivor", F.struct(F.col(key).alias("k"), F.concat_ws(":", F.col(key).cast("string"), F.col("n").cast("string")).alias("t")).alias("x"))
        return _joined(each, name)

    def _joined(each: DataFrame, name: str) -> DataFrame:
        return each.groupBy("survivor").agg(F.array_join(F.transform(F.array_sort(F.collect_set("x")), lambda x: x["t"]), "~").alias(name))

    plain = lambda rows, c, name: _joined(rows.where(F.col(c).isNotNull()).select("survivor", F.struct(F.col(c).alias("k"), F.col(c).cast("string").alias("t")).alias("x")), name)
    often = m.groupBy("survivor", "name").agg(F.sum("links").alias("n"))
    canonical = often.groupBy("survivor").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("canonical"))
    side = lambda s: kept.select(F.col("id").alias(f"id_{s}"), F.col("survivor").alias(f"to_{s}"))
    met = pairs.select("id_a", "id_b").join(side("a"), "id_a").join(side("b"), "id_b").where("to_a <> to_b")
    related = met.select(F.col("to_a").alias("survivor"), F.col("to_b").alias("other")).unionByName(met.select(F.col("to_b").alias("survivor"), F.col("to_a").alias("other")))
    history = links.select(F.col(column).alias("id"), F.col(year).alias("year")).join(kept, "id")
    parts = [
        plain(m, "name", "aliases"), plain(m, "bn", "numbers"), told(m.select("survivor", "links", F.explode("sources").alias("source")), "source", F.sum("links"), "sources"), told(m, place, F.count("*"), "addresses"),
        plain(related, "other", "related"), told(history, "year", F.count("*"), "history"), plain(kept.where("id <> survivor"), "id", "absorbed"),
    ]
    out = canonical
    for part in parts:
        out = out.join(part, "survivor", "left")
    return out.select(F.col("survivor").alias("entity_id"), "canonical", *(F.coalesce(c, F.lit("")).alias(c) for c in ("aliases", "numbers", "sources", "addresses", "related", "history", "absorbed")))
