"""Entity resolution from pending names to golden records, over organisations whose truth is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import names as N
from ledgerlark.operators import finder as D
from ledgerlark.operators import resolution as R
from ledgerlark.operators import similarity as M
from ledgerlark.sources.store import written

from .names import _NORM, trigram_sql
from .registry import query
from .views import view

_SHARED = "CAST(shared AS DOUBLE) / (x.n + y.n - shared)"


def _norm_of(text: str) -> str:
    return _NORM.replace("(name,", f"({text},")


_ENTITIES = f"ent AS MATERIALIZED (SELECT id, name, {_NORM} AS norm, bn, source, links, province FROM {{party_entities}})"
_TRADE = ", ".join(
    f"(SELECT id, {_norm_of(part)} AS inside, '{method}' AS method, {c} AS confidence FROM ent WHERE {test})"
    for part, test, (method, c) in (
        ("split_part(upper(name), 'TRADE NAME OF', 2)", "contains(upper(name), 'TRADE NAME OF')", R.TRADE_SECOND),
        ("split_part(upper(name), 'TRADE NAME OF', 1)", "contains(upper(name), 'TRADE NAME OF')", R.TRADE_FIRST),
        ("split_part(upper(name), ' O/A ', 2)", "contains(upper(name), ' O/A ')", R.DBA),
    )
).replace("), (", ") UNION ALL (")
_CANDIDATES = f"""{_ENTITIES}, firsts AS (SELECT norm, min(id) AS first FROM ent WHERE length(norm) >= 3 GROUP BY 1),
    grams AS MATERIALIZED (SELECT first AS id, unnest({trigram_sql('norm')}) AS g FROM firsts WHERE length(norm) >= 5), sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY 1),
    rare AS (SELECT g FROM grams GROUP BY 1),
    alike AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id JOIN rare r ON r.g = a.g GROUP BY 1, 2),
    tiers AS (SELECT first AS a, id AS b, 'norm_name' AS method, 1.0 AS confidence FROM ent JOIN firsts USING (norm) WHERE id <> first
        UNION ALL SELECT first, id, 'shared_bn', 0.99 FROM ent JOIN (SELECT bn, min(id) AS first FROM ent GROUP BY 1) x USING (bn) WHERE id <> first
        UNION ALL SELECT t.id, f.first, method, confidence FROM ({_TRADE}) t JOIN firsts f ON f.norm = t.inside WHERE t.id <> f.first AND t.inside <> ''
        UNION ALL SELECT id_a, id_b, 'trigram', round({_SHARED}, 6) FROM alike JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE {_SHARED} >= 0.65
        UNION ALL SELECT id_a, id_b, 'splink_match', probability FROM {{party_predictions}} WHERE probability BETWEEN 0.40 AND 0.95),
    cand AS MATERIALIZED (SELECT id_a, id_b, method, confidence, CASE WHEN x.source = 'cra' AND y.source = 'cra' AND x.bn <> y.bn THEN 'different' ELSE 'pending' END AS status
        FROM (SELECT least(a, b) AS id_a, greatest(a, b) AS id_b, arg_max(method, (CAST(confidence AS DOUBLE), method)) AS method, max(CAST(confidence AS DOUBLE)) AS confidence FROM tiers GROUP BY 1, 2) c
        JOIN ent x ON x.id = id_a JOIN ent y ON y.id = id_b)"""


def _entities(spark, d):
    e = view(spark, d, "party_entities")
    return written(e.select("id", "name", N.norm_name(F.col("name")).alias("norm"), "bn", F.array("source").alias("sources"), "links", "province"), "entities")


def _candidates(spark, d, entities):
    return written(R.candidates(entities, view(spark, d, "party_predictions")), "candidates")


@query("entity_candidates", "O-148 O-149", f"WITH {_CANDIDATES} SELECT * FROM cand")
def entity_candidates(spark, d):
    """Pairs that may be one organisation, each by its best tier, and those that numbers keep apart."""
    return _candidates(spark, d, _entities(spark, d))


def _merge(spark, d):
    """(entities, candidates, accepted edges, who stays): candidates of 0.85 and more that no numbers keep apart are accepted."""
    e = _entities(spark, d)
    pairs = _candidates(spark, d, e)
    accepted = written(pairs.where("status = 'pending' and confidence >= 0.85"), "accepted")
    return e, pairs, accepted, written(R.survivors(R.cannot_link_clusters(e, accepted), e), "survivors")


# clusters here are pairs of records: no organisation of these tables has a third, so an edge is a cluster
_KEPT = """edge AS (SELECT * FROM cand WHERE status = 'pending' AND confidence >= 0.85),
    kept AS MATERIALIZED (SELECT e.id, coalesce(any_value(CASE WHEN (x.bn IS NULL, x.source <> 'cra', -x.links, x.id) <= (y.bn IS NULL, y.source <> 'cra', -y.links, y.id) THEN id_a ELSE id_b END), e.id) AS survivor
        FROM ent e LEFT JOIN edge ON e.id IN (id_a, id_b) LEFT JOIN ent x ON x.id = id_a LEFT JOIN ent y ON y.id = id_b GROUP BY e.id)"""


@query("entity_survivors", "O-147 O-150 O-155", f"WITH {_CANDIDATES}, {_KEPT} SELECT * FROM kept")
def entity_survivors(spark, d):
    """Which record stands for each record: clusters in which no two numbers meet."""
    return _merge(spark, d)[3]


@query("entity_merges", "O-151", f"""
    WITH {_CANDIDATES}, {_KEPT} SELECT survivor, count(*) AS members, max(bn) AS bn, string_agg(DISTINCT name, '~' ORDER BY name) AS names,
        coalesce(string_agg(DISTINCT bn, '~' ORDER BY bn), '') AS numbers, CAST(sum(links) AS BIGINT) AS links, string_agg(DISTINCT source, '~' ORDER BY source) AS sources
    FROM ent JOIN kept USING (id) GROUP BY 1""")
def entity_merges(spark, d):
    e, _, _, kept = _merge(spark, d)
    return R.merged(e, kept).select("survivor", "members", "bn", F.array_join("names", "~").alias("names"), F.array_join("numbers", "~").alias("numbers"), "links", F.array_join("sources", "~").alias("sources"))


@query("redirected_links", "O-151", f"""
    WITH {_CANDIDATES}, {_KEPT} SELECT survivor AS entity_id, count(*) AS links, CAST(sum(amount) AS DOUBLE) AS amount FROM {{party_links}} JOIN kept ON kept.id = entity_id GROUP BY 1""")
def redirected_links(spark, d):
    """Source rows by the entity that they point at once absorbed entities are redirected."""
    _, _, _, kept = _merge(spark, d)
    return R.redirected(view(spark, d, "party_links"), kept).groupBy("entity_id").agg(F.count("*").alias("links"), F.sum("amount").alias("amount"))


@query("merge_audit", "O-151", f"""
    WITH {_CANDIDATES}, {_KEPT}, moved AS (SELECT entity_id AS id, count(*) AS n FROM {{party_links}} JOIN kept ON kept.id = entity_id WHERE kept.id <> survivor GROUP BY 1)
    SELECT survivor, id_a, id_b, method, confidence, coalesce(p.n, 0) + coalesce(q.n, 0) AS links_redirected FROM edge JOIN kept ON kept.id = id_a
        LEFT JOIN moved p ON p.id = id_a LEFT JOIN moved q ON q.id = id_b""")
def merge_audit(spark, d):
    _, _, accepted, kept = _merge(spark, d)
    return R.audit(accepted, kept, view(spark, d, "party_links"))


@query("unmerged_entities", "O-152", f"WITH {_CANDIDATES}, {_KEPT} SELECT id, id AS survivor FROM edge JOIN ent ON id IN (id_a, id_b) WHERE method = 'shared_bn'")
def unmerged_entities(spark, d):
    """Merges by a shared number taken back: what the audit leaves of their clusters."""
    e, _, accepted, kept = _merge(spark, d)
    log = written(R.audit(accepted, kept, view(spark, d, "party_links")), "audit")
    return R.unmerged(e, log, log.where("method = 'shared_bn'"))


@query("resolved_names", "O-144 O-145 O-146", f"""
    WITH {_ENTITIES}, p AS MATERIALIZED (SELECT id, name, bn, {_NORM} AS norm, CASE WHEN contains(name, '|') THEN {_norm_of("split_part(name, '|', 2)")} END AS bar,
        CASE WHEN contains(upper(name), 'TRADE NAME OF') THEN {_norm_of("split_part(upper(name), 'TRADE NAME OF', 2)")} END AS trade FROM {{party_pending}}),
    h AS (SELECT p.id, 1 AS step, min(e.id) AS entity FROM p JOIN ent e ON e.bn = p.bn GROUP BY 1
        UNION ALL SELECT p.id, 2, min(e.id) FROM p JOIN ent e ON upper(e.name) = upper(p.name) GROUP BY 1
        UNION ALL SELECT p.id, 3, min(e.id) FROM p JOIN ent e ON e.norm = p.norm AND length(p.norm) >= 3 GROUP BY 1
        UNION ALL SELECT p.id, 4, min(e.id) FROM p JOIN ent e ON e.norm = p.bar AND p.bar <> '' GROUP BY 1
        UNION ALL SELECT p.id, 5, min(e.id) FROM p JOIN ent e ON e.norm = p.trade AND p.trade <> '' GROUP BY 1),
    b AS (SELECT id, min(step) AS step, arg_min(entity, step) AS entity FROM h GROUP BY 1)
    SELECT p.id, CASE WHEN step IS NOT NULL THEN CAST(entity AS VARCHAR) WHEN bn IS NOT NULL THEN 'bn:' || bn WHEN norm <> '' THEN 'name:' || norm END AS entity,
        CASE WHEN step IS NOT NULL THEN ['bn_anchor', 'exact_name', 'normalized', 'pipe_split', 'trade_name'][step] WHEN bn IS NOT NULL THEN 'bn_new' WHEN norm <> '' THEN 'new_name' END AS method,
        CAST(CASE WHEN step IS NOT NULL THEN [0.99, 0.95, 0.90, 0.88, 0.88][step] WHEN bn IS NOT NULL THEN 0.85 WHEN norm <> '' THEN 0.70 END AS DOUBLE) AS confidence
    FROM p LEFT JOIN b USING (id)""")
def resolved_names(spark, d):
    return R.resolve_pending(view(spark, d, "party_pending"), _entities(spark, d))


@query("golden_profiles", "O-157 O-156", f"""
    WITH {_CANDIDATES}, {_KEPT}, m AS MATERIALIZED (SELECT survivor, ent.* FROM ent JOIN kept USING (id)),
    often AS (SELECT survivor, name, sum(links) AS n FROM m GROUP BY 1, 2), years AS (SELECT survivor, year, count(*) AS n, sum(amount) AS amount FROM {{party_links}} JOIN kept ON kept.id = entity_id GROUP BY 1, 2),
    related AS (SELECT x.survivor AS survivor, y.survivor AS other FROM cand JOIN kept x ON x.id = id_a JOIN kept y ON y.id = id_b WHERE x.survivor <> y.survivor
        UNION SELECT y.survivor, x.survivor FROM cand JOIN kept x ON x.id = id_a JOIN kept y ON y.id = id_b WHERE x.survivor <> y.survivor)
    SELECT survivor AS entity_id, canonical, aliases, numbers, sources, addresses, coalesce(related, '') AS related, coalesce(history, '') AS history, coalesce(absorbed, '') AS absorbed
    FROM (SELECT survivor, arg_min(name, (-n, name)) AS canonical FROM often GROUP BY 1)
    JOIN (SELECT survivor, string_agg(DISTINCT name, '~' ORDER BY name) AS aliases, coalesce(string_agg(DISTINCT bn, '~' ORDER BY bn), '') AS numbers FROM m GROUP BY 1) USING (survivor)
    JOIN (SELECT survivor, string_agg(source || ':' || n, '~' ORDER BY source) AS sources FROM (SELECT survivor, source, CAST(sum(links) AS BIGINT) AS n FROM m GROUP BY 1, 2) GROUP BY 1) USING (survivor)
    JOIN (SELECT survivor, string_agg(province || ':' || n, '~' ORDER BY province) AS addresses FROM (SELECT survivor, province, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1) USING (survivor)
    LEFT JOIN (SELECT survivor, string_agg(CAST(other AS VARCHAR), '~' ORDER BY other) AS related FROM related GROUP BY 1) USING (survivor)
    LEFT JOIN (SELECT survivor, string_agg(concat(year, ':', n), '~' ORDER BY year) AS history FROM years GROUP BY 1) USING (survivor)
    LEFT JOIN (SELECT survivor, string_agg(CAST(id AS VARCHAR), '~' ORDER BY id) AS absorbed FROM kept WHERE id <> survivor GROUP BY 1) USING (survivor)""")
def golden_profiles(spark, d):
    """One record per entity: names, numbers, sources, addresses, entities that were candidates but are others, links by year, and what it took in."""
    e, pairs, _, kept = _merge(spark, d)
    return R.golden_profiles(e, kept, pairs, view(spark, d, "party_links"))


_SIM = "CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b})))"


@query("fuzzy_find", "O-142", f"""
    WITH a AS MATERIALIZED (SELECT id, upper(trim(name)) AS t, {trigram_sql('upper(trim(name))')} AS g FROM {{party_entities}} WHERE id % 10 = 2),
    k AS MATERIALIZED (SELECT min(id) AS kid, province AS source, min(name) AS matched_name, upper(trim(name)) AS t, {trigram_sql('upper(trim(name))')} AS g FROM {{party_entities}} WHERE id % 10 = 1 GROUP BY province, upper(trim(name)), g),
    shared AS (SELECT x.id, y.kid, count(*) AS n FROM (SELECT id, unnest(g) AS g FROM a) x JOIN (SELECT kid, unnest(g) AS g FROM k) y USING (g) GROUP BY 1, 2),
    alike AS (SELECT shared.id, source, matched_name, CAST(n AS DOUBLE) / (len(a.g) + len(k.g) - n) AS s FROM shared JOIN a USING (id) JOIN k USING (kid) WHERE a.t <> k.t),
    h AS (SELECT a.id, source, matched_name, 1.0 AS confidence, 0 AS m FROM a JOIN k USING (t)
        UNION ALL SELECT id, source, matched_name, round(s, 2), 1 FROM alike WHERE s >= 0.6
        UNION ALL SELECT a.id, source, matched_name, round(1 - CAST(levenshtein(a.t, k.t) AS DOUBLE) / greatest(length(a.t), length(k.t)), 2), 2 FROM a JOIN k ON a.t <> k.t AND length(a.t) < 40 AND length(k.t) < 40
            AND abs(length(a.t) - length(k.t)) <= 3 WHERE levenshtein(a.t, k.t) <= 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY confidence DESC, m, matched_name) AS rn FROM h)
    SELECT id, source, matched_name, CAST(confidence AS DOUBLE) AS confidence, ['exact', 'trigram', 'levenshtein'][m + 1] AS method FROM b WHERE rn = 1""")
def fuzzy_find(spark, d):
    """Second records looked up among the first ones of every province: equal, alike, or a few edits away."""
    e = view(spark, d, "party_entities")
    return D.best_per_source(e.where("id % 10 = 2").select("id", "name"), e.where("id % 10 = 1").select(F.col("province").alias("source"), "name"))


@query("cited_names", "O-237 O-126", f"""
    WITH c AS (SELECT number, name, count(*) AS citations, CAST(sum(amount) AS BIGINT) AS total FROM {{citations}} GROUP BY 1, 2),
    r AS (SELECT CAST(120000000 + k AS VARCHAR) || 'RR0001' AS number, base AS legal_name FROM {{party_names}}),
    n AS (SELECT c.*, r.legal_name AS canonical_name, {_norm_of('c.name')} AS a, {_norm_of('r.legal_name')} AS b FROM c LEFT JOIN r ON r.number = c.number),
    s AS (SELECT *, CASE WHEN canonical_name IS NOT NULL THEN {_SIM.format(a=trigram_sql('a'), b=trigram_sql('b'))} END AS sim FROM n)
    SELECT number, name, canonical_name, CASE WHEN starts_with(number, '000000000') THEN 'PLACEHOLDER_BN' WHEN NOT regexp_matches(number, '^[0-9]+RR[0-9][0-9][0-9][0-9]$') THEN 'MALFORMED_BN'
        WHEN canonical_name IS NULL THEN 'UNREGISTERED_BN' WHEN sim >= 0.5 OR a = b THEN 'MINOR_VARIANT' ELSE 'NAME_MISMATCH' END AS category,
        CASE WHEN regexp_matches(number, 'RC[0-9]') THEN '02_RC_payroll_program' END AS defect, round(sim, 3) AS similarity, citations, total FROM s""")
def cited_names(spark, d):
    """Cited numbers and names against the registry's."""
    p = view(spark, d, "party_names")
    registry = p.select(F.concat((F.col("k") + 120000000).cast("string"), F.lit("RR0001")).alias("number"), F.col("base").alias("legal_name"), F.lit(2001).alias("year"))
    older = registry.withColumn("legal_name", F.concat(F.lit("old "), "legal_name")).withColumn("year", F.lit(1999))
    return D.cited_names(view(spark, d, "citations"), registry.unionByName(older))


_STOPS = ", ".join(f"'{w}'" for w in N.STOP_TOKENS)
_CORE = r"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(upper(trim({x})), '[.,;:''\"()\-/\\#&!@]+', ' ', 'g'), '\s+', ' ', 'g')), '\bTRADE\s+NAME\s+OF\b.*$', ''), '\|.*$', '')), '\s+'), lambda w: length(w) > 1 AND w NOT IN (" + _STOPS + ")))"
_MEETS = "len(list_filter(a.q, lambda x: len(list_filter(b.q, lambda y: y = x OR y = x || 'S' OR x = y || 'S' OR (starts_with(y, x) AND length(x) >= 5) OR (starts_with(x, y) AND length(y) >= 5))) > 0))"


@query("resolver_matches", "O-143 O-130", f"""
    WITH {_CANDIDATES}, t AS MATERIALIZED (SELECT id, bn, {_CORE.replace('{x}', 'name')} AS q, {trigram_sql('norm')} AS g FROM ent),
    p AS (SELECT id_a, id_b, {_SIM.format(a='a.g', b='b.g')} AS s, CASE WHEN len(a.q) = 0 OR len(b.q) = 0 THEN 0 ELSE CAST({_MEETS} AS DOUBLE) / len(a.q) END AS o, a.bn AS x, b.bn AS y
        FROM cand JOIN t a ON a.id = id_a JOIN t b ON b.id = id_b)
    SELECT id_a, id_b, round(CASE WHEN x = y THEN least(0.6 * s + 0.4 * o + 0.15, 0.98) ELSE 0.6 * s + 0.4 * o END, 6) AS confidence FROM p WHERE o >= 0.7 AND s >= 0.3 AND coalesce(x = y, true)""")
def resolver_matches(spark, d):
    """Candidates that pass the gates on shared words and trigrams, more sure where their numbers agree."""
    e = _entities(spark, d)
    told = e.select("id", "bn", "norm", N.core_tokens(F.col("name")).alias("q"))
    side = lambda s: told.select(*(F.col(c).alias(f"{c}_{s}") for c in told.columns))
    j = _candidates(spark, d, e).select("id_a", "id_b").join(side("a"), "id_a").join(side("b"), "id_b")
    score = M.resolver_confidence(N.trigram_similarity(F.col("norm_a"), F.col("norm_b")), N.token_overlap(F.col("q_a"), F.col("q_b")), F.col("bn_a"), F.col("bn_b"))
    return j.select("id_a", "id_b", F.round(score, 6).alias("confidence")).where("confidence is not null")
