"""Gift graphs over the standard views: edges, cycles, components, walks and loop scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import names as N
from ledgerlark.operators import graph as G
from ledgerlark.operators import half_cycles as H
from ledgerlark.operators import loop_risk as K
from ledgerlark.operators import scores as S
from ledgerlark.sources.store import written

from .registry import query
from .views import view


@query("gift_edges", "O-161", "SELECT src, dst, CAST(sum(amount) AS DOUBLE) AS total_amt, count(*) AS edge_count, CAST(min(year) AS BIGINT) AS min_year, CAST(max(year) AS BIGINT) AS max_year, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years FROM {gifts} WHERE amount >= 5000 AND src <> dst GROUP BY src, dst".replace("SELECT src, dst", "SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst"))
def gift_edges(spark, d):
    return G.build_edges(view(spark, d, "gifts")).withColumn("years", F.array_join("years", ","))



@query("pruned_edges", "O-162", """
    WITH RECURSIVE reach AS (SELECT src AS a, dst AS b FROM {event_edges} UNION SELECT a, e.dst FROM reach
        JOIN {event_edges} e ON e.src = b), cyc AS (SELECT a AS n FROM reach WHERE a = b),
    down AS (SELECT n FROM cyc UNION SELECT b FROM reach WHERE a IN (SELECT n FROM cyc)), up AS (SELECT n FROM cyc UNION SELECT a FROM reach
        WHERE b IN (SELECT n FROM cyc)) SELECT src, dst FROM {event_edges} WHERE src IN (SELECT n FROM down) AND dst IN (SELECT n FROM up)""")
def pruned_edges(spark, d):
    return G.prune_dead_ends(view(spark, d, "event_edges").select("src", "dst").distinct())


def _cycle_sql(k: int, edges: str, window: int | None = None) -> str:
    join = " ".join(f"JOIN {{{edges}}} e{i} ON e{i}.src = e{i - 1}.dst" for i in range(2, k + 1))
    nodes = ["e1.src", *(f"e{i}.dst" for i in range(1, k))]
    tests = [f"e{k}.dst = e1.src", *(f"{n} > e1.src" for n in nodes[1:]), *(f"{a} <> {b}" for i, a in enumerate(nodes[1:]) for b in nodes[i + 2 :])]
    lo, hi = (f"{f}({', '.join(f'e{i}.{c}' for i in range(1, k + 1))})" for f, c in (("least", "min_year"), ("greatest", "max_year")))
    tests += [f"{hi} - {lo} <= {window}"] if window is not None else []
    key = " || '>' || ".join(f"CAST({n} AS VARCHAR)" for n in nodes)
    return f"SELECT {key} AS path_key, CAST({k} AS BIGINT) AS hops, CAST(least({', '.join(f'e{i}.total_amt' for i in range(1, k + 1))}) AS DOUBLE) AS bottleneck, CAST({' + '.join(f'e{i}.total_amt' for i in range(1, k + 1))} AS DOUBLE) AS total_flow, CAST({lo} AS BIGINT) AS min_year, CAST({hi} AS BIGINT) AS max_year FROM {{{edges}}} e1 {join} WHERE {' AND '.join(tests)}"


_OUT = ["path_key", "hops", "bottleneck", "total_flow", "min_year", "max_year"]
_ALL = " UNION ALL ".join(_cycle_sql(k, "top_edges") for k in range(2, 6))


@query("cycles_to_5", "O-163 O-170 O-171", _ALL)
def cycles_to_5(spark, d):
    return G.all_cycles(view(spark, d, "top_edges"), 5).select(*_OUT)


@query("cycles_all_edges", "O-163", " UNION ALL ".join(_cycle_sql(k, "all_edges") for k in (2, 3)))
def cycles_all_edges(spark, d):
    """No edge is left out: cycles of two and three hops over the whole gift graph."""
    return G.all_cycles(view(spark, d, "all_edges"), 3).select(*_OUT)


def _core_sql(most: int, window: int | None = None) -> str:
    """Cycles of party edges; edges of nodes that only give or only take cannot lie on one."""
    core = "core AS MATERIALIZED (SELECT * FROM {party_edges} WHERE src IN (SELECT dst FROM {party_edges}) AND dst IN (SELECT src FROM {party_edges}))"
    return f"WITH {core} " + " UNION ALL ".join(_cycle_sql(k, "core", window).replace("{core}", "core") for k in range(2, most + 1))


@query("cycles_to_6", "O-163 O-170 O-171", _core_sql(6))
def cycles_to_6(spark, d):
    """Gifts of customers to suppliers, no edge left out: half paths that meet in the middle."""
    return H.cycles_by_halves(view(spark, d, "party_edges"), 6).select(*_OUT)


@query("cycles_to_8_window", "O-163 O-171", _core_sql(8, 3))
def cycles_to_8_window(spark, d):
    """Cycles of up to eight hops within four years."""
    return H.cycles_by_halves(view(spark, d, "party_edges"), 8, 3).select(*_OUT)


@query("two_enumerators", "O-175", f"WITH one AS ({_core_sql(5)}) SELECT hops, count(*) AS by_halves, count(*) AS by_extension, count(*) AS in_both FROM one GROUP BY 1")
def two_enumerators(spark, d):
    """Cycles as both ways of finding them have them, by path."""
    e = written(view(spark, d, "party_edges"), "party_edges")
    one, two = (f(e, 5).select("path_key", "hops", F.lit(True).alias(n)) for f, n in ((H.cycles_by_halves, "one"), (G.all_cycles, "two")))
    both = one.join(two, ["path_key", "hops"], "full")
    return both.groupBy("hops").agg(F.count("one").alias("by_halves"), F.count("two").alias("by_extension"), F.count(F.when(F.col("one") & F.col("two"), 1)).alias("in_both"))


@query("cycles_window", "O-163", " UNION ALL ".join(_cycle_sql(k, "year_edges", 1) for k in (2, 3)))
def cycles_window(spark, d):
    return G.all_cycles(view(spark, d, "year_edges"), 3, 1).select(*_OUT)


@query("seeded_cycles", "O-166", f"SELECT * FROM ({_cycle_sql(3, 'top_edges')}) x WHERE list_contains(string_split(path_key, '>'), '7')")
def seeded_cycles(spark, d):
    return G.seeded_cycles(written(view(spark, d, "top_edges"), "top_edges"), 7, 3).select(*_OUT)


_MEMBERS = f"cyc AS ({_ALL}), mem AS (SELECT path_key, hops, bottleneck, total_flow, min_year, max_year, string_split(path_key, '>') AS p, unnest(range(1, len(string_split(path_key, '>')) + 1)) AS i FROM cyc), m AS (SELECT path_key, hops, bottleneck, total_flow, min_year, max_year, i, CAST(p[i] AS BIGINT) AS node, CAST(p[i % len(p) + 1] AS BIGINT) AS sends_to, CAST(p[(i + len(p) - 2) % len(p) + 1] AS BIGINT) AS receives_from FROM mem)"


@query("participants", "O-164 O-256", f"WITH {_MEMBERS} SELECT path_key, CAST(i - 1 AS BIGINT) AS position, node, sends_to, receives_from FROM m")
def participants(spark, d):
    return G.participants(G.all_cycles(view(spark, d, "top_edges"), 5)).select("path_key", "position", "node", "sends_to", "receives_from")


@query("universe", "O-165", f"WITH {_MEMBERS} SELECT node, count(*) AS total_loops, " + ", ".join(f"count(*) FILTER (WHERE hops = {k}) AS loops_{k}hop" for k in range(2, 6)) + ", max(bottleneck) AS max_bottleneck, round(sum(bottleneck), 2) AS total_circular_amt FROM m GROUP BY node")
def universe(spark, d):
    u = G.universe(G.participants(G.all_cycles(view(spark, d, "top_edges"), 5)), 5)
    return u.withColumn("total_circular_amt", F.round("total_circular_amt", 2))


@query("reciprocal_partners", "O-167", """
    SELECT CAST(a.src AS BIGINT) AS src, CAST(a.dst AS BIGINT) AS dst, CAST(a.total_amt AS DOUBLE) AS sent, CAST(b.total_amt AS DOUBLE) AS received
        FROM {top_edges} a JOIN {top_edges} b ON a.src = b.dst AND a.dst = b.src AND a.src < a.dst""")
def reciprocal_partners(spark, d):
    return G.reciprocal(view(spark, d, "top_edges"))


_PARTS = "parts AS (SELECT n AS node, least(n, coalesce((SELECT min(r.b) FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a WHERE r.a = n), n)) AS component FROM (SELECT src AS n FROM {event_edges} UNION SELECT dst FROM {event_edges}) x)"
_REACH = "WITH RECURSIVE reach AS (SELECT src AS a, dst AS b FROM {event_edges} UNION SELECT a, e.dst FROM reach JOIN {event_edges} e ON e.src = b), "


@query("strong_components", "O-168 O-174", _REACH + _PARTS + " SELECT node, component FROM parts")
def strong_components(spark, d):
    return G.strong_components(view(spark, d, "event_edges"))


@query("component_summary", "O-169", _REACH + _PARTS + ", s AS (SELECT component, count(*) AS node_count FROM parts GROUP BY 1), i AS (SELECT p.component, count(*) AS edge_count, CAST(sum(total_amt) AS DOUBLE) AS internal_flow FROM {event_edges} JOIN parts p ON p.node = src JOIN parts q ON q.node = dst AND q.component = p.component GROUP BY 1) SELECT component, node_count, coalesce(edge_count, 0) AS edge_count, coalesce(internal_flow, 0) AS internal_flow FROM s LEFT JOIN i USING (component)")
def component_summary(spark, d):
    e = written(view(spark, d, "event_edges"), "event_edges")
    return G.component_summary(e, G.strong_components(e))


@query("hub_ranking", "O-172", """
    SELECT coalesce(o.n, i.n) AS node, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree,
        CAST(coalesce(i.t, 0) AS DOUBLE) AS inflow, CAST(coalesce(o.t, 0) AS DOUBLE) AS outflow
        FROM (SELECT src AS n, count(*) AS c, sum(total_amt) AS t FROM {event_edges} GROUP BY 1) o
        FULL JOIN (SELECT dst AS n, count(*) AS c, sum(total_amt) AS t FROM {event_edges} GROUP BY 1) i ON o.n = i.n""")
def hub_ranking(spark, d):
    return G.hubs(view(spark, d, "event_edges"))


@query("closed_walks", "O-173", """
    WITH e AS (SELECT DISTINCT src, dst FROM {top_edges}) SELECT CAST(a.src AS BIGINT) AS node, CAST(2 AS BIGINT) AS k, count(*) AS walks FROM e a
        JOIN e b ON b.src = a.dst AND b.dst = a.src GROUP BY 1 UNION ALL SELECT a.src, 3, count(*) FROM e a JOIN e b ON b.src = a.dst
        JOIN e c ON c.src = b.dst AND c.dst = a.src GROUP BY 1 UNION ALL SELECT a.src, 4, count(*) FROM e a JOIN e b ON b.src = a.dst
        JOIN e c ON c.src = b.dst JOIN e f ON f.src = c.dst AND f.dst = a.src GROUP BY 1""")
def closed_walks(spark, d):
    return G.closed_walks(written(view(spark, d, "top_edges"), "top_edges"), 4)


@query("cross_check", "O-175 O-174 O-176", f"""
    WITH a AS ({_cycle_sql(3, 'top_edges')}), w AS (SELECT DISTINCT x.src AS node FROM {{top_edges}} x JOIN {{top_edges}} y ON y.src = x.dst
        JOIN {{top_edges}} z ON z.src = y.dst AND z.dst = x.src), n AS (SELECT DISTINCT CAST(unnest(string_split(path_key, '>')) AS BIGINT) AS node
        FROM a)
    SELECT CAST(e.src AS BIGINT) AS src, CAST(e.dst AS BIGINT) AS dst, e.src IN (SELECT node FROM n) AS src_in_cycle, e.src IN (SELECT node
        FROM w) AS src_in_walk FROM {{top_edges}} e WHERE e.src IN (SELECT node FROM n) AND e.dst IN (SELECT node FROM n)""")
def cross_check(spark, d):
    e = written(view(spark, d, "top_edges"), "top_edges")
    members = G.participants(G.cycles(e, 3)).select("node").distinct()
    walks = G.closed_walks(e, 3).where("k = 3").select("node")
    flags = G.cross_flags(e.select(F.col("src").alias("node")).distinct(), cycle=members, walk=walks)
    return G.induced(e, members).join(flags.withColumnRenamed("node", "src"), "src").select("src", "dst", F.col("in_cycle").alias("src_in_cycle"), F.col("in_walk").alias("src_in_walk"))


_SYM = "CASE WHEN s > 0.75 THEN 'HIGH' WHEN s > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level"


@query("symmetric_flows", "O-180", f"""
    SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(year AS BIGINT) AS year, CAST(amount AS DOUBLE) AS amount,
        CAST(returned AS DOUBLE) AS returned, round(s, 6) AS symmetry, {_SYM}
        FROM (SELECT a.*, b.amount AS returned, CAST(least(a.amount, b.amount) AS DOUBLE) / CAST(greatest(a.amount, b.amount) AS DOUBLE) AS s
        FROM {{yearly_flows}} a JOIN {{yearly_flows}} b ON a.src = b.dst AND a.dst = b.src AND a.year = b.year AND a.src < a.dst) x""")
def symmetric_flows(spark, d):
    return G.symmetric_flows(written(view(spark, d, "yearly_flows"), "yearly"))


@query("adjacent_flows", "O-181", f"""
    WITH f AS (SELECT src, dst, min_year AS year, total_amt AS amount FROM {{year_edges}}), o AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g
        WHERE g.src = f.dst AND g.dst = f.src AND g.year = f.year))
    SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(year AS BIGINT) AS year, CAST(amount AS DOUBLE) AS amount,
        CAST(returned AS DOUBLE) AS returned, round(s, 6) AS symmetry, {_SYM}
        FROM (SELECT a.*, b.amount AS returned, CAST(least(a.amount, b.amount) AS DOUBLE) / CAST(greatest(a.amount, b.amount) AS DOUBLE) AS s FROM o a
        JOIN o b ON a.src = b.dst AND a.dst = b.src AND b.year = a.year + 1) x""")
def adjacent_flows(spark, d):
    f = view(spark, d, "year_edges").select("src", "dst", F.col("min_year").alias("year"), F.col("total_amt").alias("amount"))
    return G.symmetric_flows(written(f, "yearly"), 1)


@query("loop_financials", "O-188 O-061", f"""
    WITH {_MEMBERS}, y AS (SELECT path_key, node, sends_to, sum(f.amount) AS w, count(DISTINCT f.year) AS years FROM m
        JOIN {{yearly_flows}} f ON f.src = node AND f.dst = sends_to AND f.year BETWEEN min_year AND max_year GROUP BY 1, 2, 3)
    SELECT path_key, CAST(min(w) AS DOUBLE) AS window_bottleneck, CAST(sum(w) AS DOUBLE) AS window_flow, max(years) AS active_years FROM y GROUP BY 1""")
def loop_financials(spark, d):
    """Flows of each loop within its own years: an equi-join on the edge, the years of the loop as what is left to test."""
    return S.loop_financials(written(G.all_cycles(view(spark, d, "top_edges"), 5), "cycles"), view(spark, d, "yearly_flows")).select("path_key", "window_bottleneck", "window_flow", "active_years")


@query("loop_report", "O-189", f"""
    WITH {_MEMBERS}, u AS (SELECT hops, count(DISTINCT path_key) AS loops, count(DISTINCT node) AS members,
        CAST(max(bottleneck) AS DOUBLE) AS largest_bottleneck FROM m
        GROUP BY 1), k AS (SELECT hops, CAST(sum(total_flow) AS DOUBLE) AS flow, count(*) FILTER (WHERE min_year = max_year) AS same_year FROM cyc
        GROUP BY 1)
    SELECT CAST(hops AS BIGINT) AS hops, loops, members, largest_bottleneck, flow, same_year FROM u JOIN k USING (hops)""")
def loop_report(spark, d):
    return S.loop_report(written(G.all_cycles(view(spark, d, "top_edges"), 5), "cycles"))


@query("sector_baseline", "O-189", f"""
    WITH {_MEMBERS}, l AS (SELECT DISTINCT node FROM m), o AS (SELECT src AS node, CAST(sum(total_amt) AS DOUBLE) AS given, count(*) AS partners
        FROM {{all_edges}} GROUP BY 1), j AS (SELECT r_name AS sector, o.*, node IN (SELECT node FROM l) AS in_loop FROM o
        JOIN nation ON n_nationkey = node JOIN region ON r_regionkey = n_regionkey)
    SELECT sector, count(*) AS members, count(*) FILTER (WHERE in_loop) AS loop_members, round(avg(given), 4) AS sector_mean, round(avg(CASE
        WHEN in_loop THEN given END), 4) AS loop_mean, round(avg(CASE WHEN in_loop THEN given END) / nullif(avg(given), 0), 6) AS times_sector FROM j
        GROUP BY 1""")
def sector_baseline(spark, d):
    """What members of loops give against all of their sector."""
    members = G.participants(G.all_cycles(view(spark, d, "top_edges"), 5)).select("node").distinct()
    sectors = view(spark, d, "nation").join(view(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("sector"))
    given = view(spark, d, "all_edges").groupBy(F.col("src").alias("node")).agg(F.sum("total_amt").cast("double").alias("given"))
    return S.sector_baseline(given.join(sectors, "node"), members)


@query("loop_watchlist", "O-191 O-190 O-059", f"""
    WITH {_MEMBERS}, u AS (SELECT node, least(30, count(*)) AS s FROM m
        GROUP BY 1), w AS (SELECT path_key, any_value(hops) AS hops, count(*) AS members, any_value(bottleneck) AS b, any_value(total_flow) AS f,
        any_value(min_year = max_year) AS same, max(s) AS ms, string_agg(n_name, ' -> ' ORDER BY i) AS display FROM m JOIN u USING (node)
        JOIN nation ON n_nationkey = node GROUP BY 1)
    SELECT path_key, display, CAST(ms + CASE WHEN same THEN 4 ELSE 0 END + CASE WHEN b >= 1000000 THEN 4 WHEN b >= 100000 THEN 3
        WHEN b >= 10000 THEN 2 WHEN b > 0 THEN 1 ELSE 0 END + CASE WHEN f >= 5000000 THEN 4 WHEN f >= 1000000 THEN 3 WHEN f >= 100000 THEN 2
        WHEN f > 0 THEN 1 ELSE 0 END + least(hops, 6) + least(members, 6) AS BIGINT) AS score FROM w""")
def loop_watchlist(spark, d):
    found = written(G.all_cycles(view(spark, d, "top_edges"), 5), "cycles")
    m = G.participants(found)
    score = G.universe(m, 5).select("node", F.least("total_loops", F.lit(30)).alias("s"))
    names = view(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"))
    w = m.join(score, "node").join(names, "node").groupBy("path_key").agg(F.max("s").alias("s"), F.count("*").alias("members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), " -> ").alias("display"))
    j = w.join(found.select("path_key", "hops", "bottleneck", "total_flow", (F.col("min_year") == F.col("max_year")).alias("same")), "path_key")
    return j.select("path_key", "display", S.loop_watch_score(F.col("hops"), F.col("members"), F.col("bottleneck"), F.col("total_flow"), F.col("same"), F.col("s")).alias("score"))


@query("loop_score", "O-190 O-181 O-180", """
    WITH f AS (SELECT src, dst, min_year AS year, total_amt AS amount
        FROM {year_edges}), p AS (SELECT a.src AS node, a.dst AS partner, a.year, EXISTS (SELECT 1 FROM f b
        WHERE b.src = a.dst AND b.dst = a.src AND b.year = a.year AND least(a.amount, b.amount) / greatest(a.amount, b.amount) > 0.5) AS same,
        EXISTS (SELECT 1 FROM f b WHERE b.src = a.dst AND b.dst = a.src AND b.year = a.year + 1 AND least(a.amount, b.amount) / greatest(a.amount,
        b.amount) > 0.5) AS next FROM f a),
    n AS (SELECT node, count(*) FILTER (WHERE same) AS sy, count(*) FILTER (WHERE next AND NOT same) AS ay FROM p
        GROUP BY 1), q AS (SELECT node, max(y) AS years FROM (SELECT node, partner, count(DISTINCT year) AS y FROM p WHERE same OR next
        GROUP BY 1, 2) z GROUP BY 1)
    SELECT CAST(n.node AS BIGINT) AS node, sy AS same_year, ay AS adjacent_year, CAST(CASE WHEN sy >= 5 THEN 4 WHEN sy >= 3 THEN 3 WHEN sy >= 1 THEN 2
        ELSE 0 END + CASE WHEN ay >= 5 THEN 4 WHEN ay >= 3 THEN 3 WHEN ay >= 1 THEN 2 ELSE 0 END + CASE WHEN coalesce(years, 0) >= 2 THEN 2
        ELSE 0 END AS BIGINT) AS temporal_score FROM n LEFT JOIN q USING (node) WHERE sy + ay > 0""")
def loop_score(spark, d):
    f = view(spark, d, "year_edges").select("src", "dst", F.col("min_year").alias("year"), F.col("total_amt").alias("amount"))
    return S.temporal_loop_score(written(f, "yearly"))



@query("circular_score", "O-190", f"""
    WITH {_MEMBERS}, k AS (SELECT node, count(DISTINCT CASE WHEN hops = 2 THEN sends_to END) AS partners, count(*) FILTER (WHERE hops = 3) AS triangles FROM m GROUP BY 1),
    v AS (SELECT node, year, amount, 1 AS o FROM {{yearly_flows}} JOIN (SELECT DISTINCT node, sends_to FROM m) x ON src = node AND dst = sends_to
        UNION ALL SELECT node, year, amount, 0 FROM {{yearly_flows}} JOIN (SELECT DISTINCT node, receives_from
        FROM m) x ON dst = node AND src = receives_from),
    s AS (SELECT node, coalesce(sum(amount) FILTER (WHERE o = 1), 0) AS sent, coalesce(sum(amount) FILTER (WHERE o = 0), 0) AS got, count(DISTINCT year) AS years FROM v GROUP BY 1)
    SELECT node, partners, triangles, years, CAST(least(sent, got) AS DOUBLE) AS circular, CAST((partners > 0)::INT + (partners >= 2
        OR triangles > 0)::INT + (years >= 2)::INT + (least(sent, got) > 100000)::INT AS BIGINT) AS score FROM k JOIN s USING (node)""")
def circular_score(spark, d):
    m = written(G.participants(G.all_cycles(view(spark, d, "top_edges"), 5)), "members")
    c = S.circular_flows(m, written(view(spark, d, "yearly_flows"), "yearly"))
    return c.select("node", "partners", "triangles", "years", "circular", S.circular_points(F.col("partners"), F.col("triangles"), F.col("years"), F.col("circular")).alias("score"))


@query("financial_score", "O-190", """
    WITH f AS (SELECT filing, coalesce(CAST(total AS DOUBLE), 0) AS r, coalesce(CAST(program_spending + compensation AS DOUBLE), 0) AS s,
        coalesce(CAST(program_spending AS DOUBLE), 0) AS p, coalesce(CAST(c AS DOUBLE), 0) AS o, coalesce(CAST(a AS DOUBLE), 0) AS gi,
        coalesce(CAST(b AS DOUBLE), 0) AS go, coalesce(CAST(compensation AS DOUBLE), 0) AS w, coalesce(ci, 0) AS ci
        FROM {filings} LEFT JOIN (SELECT node, CAST(least(sum(o), sum(i)) AS DOUBLE) AS ci FROM (SELECT src AS node, amount AS o, 0 AS i FROM {party_flows}
            UNION ALL SELECT dst, 0, amount FROM {party_flows}) GROUP BY 1) ON node = filer), g AS (SELECT *, CASE WHEN s > 0 THEN round(o / s * 100, 1) ELSE 0 END AS oh FROM f)
    SELECT filing, CAST(CASE WHEN oh > 40 THEN 2 WHEN oh > 25 THEN 1 ELSE 0 END + CASE WHEN r > 0 AND gi > r * 0.5 THEN 2 ELSE 0 END + CASE
        WHEN gi > 50000 AND go > 0 AND least(gi, go) > greatest(gi, go) * 0.5 THEN 2 ELSE 0 END + CASE WHEN r > 100000 AND p < r * 0.2 THEN 2
        ELSE 0 END + CASE WHEN w > 0 AND p > 0 AND w > p THEN 2 ELSE 0 END + CASE WHEN p > 0 AND ci > p * 2 THEN 2 ELSE 0 END AS BIGINT) AS score
        FROM g""")
def financial_score(spark, d):
    c = F.col
    points = S.financial_points(c("total"), c("program_spending") + c("compensation"), c("program_spending"), c("c"), c("a"), c("b"), c("compensation"), c("ci"))
    f = written(view(spark, d, "party_flows"), "flows")
    both = f.select(c("src").alias("node"), c("amount").alias("o"), F.lit(0).alias("i")).unionByName(f.select(c("dst").alias("node"), F.lit(0).alias("o"), c("amount").alias("i")))
    through = both.groupBy(c("node").alias("filer")).agg(F.least(F.sum("o"), F.sum("i")).alias("ci"))
    return view(spark, d, "filings").join(through, "filer", "left").select("filing", points.alias("score"))


_PARTY = _core_sql(6).replace("WITH core", "core", 1).split(" SELECT CAST(e1.src", 1)
_PARTY_MEMBERS = f"""{_PARTY[0]}, cyc AS MATERIALIZED (SELECT CAST(e1.src{_PARTY[1]}), mem AS (SELECT path_key, hops, string_split(path_key, '>') AS p, unnest(range(1, hops + 1)) AS i FROM cyc),
    m AS MATERIALIZED (SELECT path_key, hops, i, CAST(p[i] AS BIGINT) AS node, CAST(p[i % hops + 1] AS BIGINT) AS sends_to, CAST(p[(i + hops - 2) % hops + 1] AS BIGINT) AS receives_from FROM mem)"""
_KIND_NAMES = ["Parish of St ", "Hospital Foundation ", "United Way of ", "Friends of ", "Museum "]  # what the customers of these queries are


@query("loop_risk", "O-190", f"""
    WITH {_PARTY_MEMBERS}, f AS (SELECT filer AS node, arg_max(filing, filing) AS filing FROM {{filings}} GROUP BY 1),
    fin AS (SELECT node, coalesce(CAST(total AS DOUBLE), 0) AS r, CAST(program_spending + compensation AS DOUBLE) AS s, CAST(program_spending AS DOUBLE) AS p, coalesce(CAST(c AS DOUBLE), 0) AS o,
        coalesce(CAST(a AS DOUBLE), 0) AS gi, coalesce(CAST(b AS DOUBLE), 0) AS go, CAST(compensation AS DOUBLE) AS w FROM f JOIN {{filings}} x ON x.filing = f.filing),
    people AS (SELECT DISTINCT org AS node FROM {{roles}} WHERE person IN (SELECT person FROM {{roles}} GROUP BY 1 HAVING count(DISTINCT org) > 1)),
    k AS (SELECT node, count(DISTINCT CASE WHEN hops = 2 THEN sends_to END) AS partners, count(*) FILTER (WHERE hops = 3) AS triangles FROM m GROUP BY 1),
    v AS (SELECT node, year, amount, 1 AS o FROM {{party_flows}} JOIN (SELECT DISTINCT node, sends_to FROM m) x ON src = node AND dst = sends_to
        UNION ALL SELECT node, year, amount, 0 FROM {{party_flows}} JOIN (SELECT DISTINCT node, receives_from FROM m) x ON dst = node AND src = receives_from),
    c AS (SELECT node, count(DISTINCT year) AS years, CAST(least(coalesce(sum(amount) FILTER (WHERE o = 1), 0), coalesce(sum(amount) FILTER (WHERE o = 0), 0)) AS DOUBLE) AS circular FROM v GROUP BY 1),
    t AS (SELECT m.node, hops, sends_to, receives_from, o.year, coalesce(CAST(least(o.amount, n.amount) AS DOUBLE) / CAST(greatest(o.amount, n.amount) AS DOUBLE) > 0.5, false) AND n.amount IS NOT NULL AS same,
        coalesce(CAST(least(o.amount, l.amount) AS DOUBLE) / CAST(greatest(o.amount, l.amount) AS DOUBLE) > 0.5, false) AND l.amount IS NOT NULL AS next FROM m JOIN {{party_flows}} o ON o.src = m.node AND o.dst = sends_to
        LEFT JOIN {{party_flows}} n ON n.src = receives_from AND n.dst = m.node AND n.year = o.year LEFT JOIN {{party_flows}} l ON l.src = receives_from AND l.dst = m.node AND l.year = o.year + 1),
    u AS (SELECT node, count(*) FILTER (WHERE same) AS sy, count(*) FILTER (WHERE next AND NOT same) AS ay, count(*) FILTER (WHERE (same OR next) AND hops >= 3) AS mh FROM t GROUP BY 1),
    q AS (SELECT node, max(n) >= 2 AS persistent FROM (SELECT node, sends_to, receives_from, count(DISTINCT year) AS n FROM t WHERE same OR next GROUP BY 1, 2, 3) GROUP BY 1),
    z AS (SELECT k.node, (partners > 0)::INT + (partners >= 2 OR triangles > 0)::INT + (years >= 2)::INT + (circular > 100000)::INT + (k.node IN (SELECT node FROM people))::INT AS circular_points,
        coalesce(CASE WHEN s > 0 AND round(o / s * 100, 1) > 40 THEN 2 WHEN s > 0 AND round(o / s * 100, 1) > 25 THEN 1 ELSE 0 END + CASE WHEN r > 0 AND gi > r * 0.5 THEN 2 ELSE 0 END
            + CASE WHEN gi > 50000 AND go > 0 AND least(gi, go) > greatest(gi, go) * 0.5 THEN 2 ELSE 0 END + CASE WHEN r > 100000 AND p < r * 0.2 THEN 2 ELSE 0 END
            + CASE WHEN w > 0 AND p > 0 AND w > p THEN 2 ELSE 0 END + CASE WHEN p > 0 AND circular > p * 2 THEN 2 ELSE 0 END, 0) AS financial_points,
        CASE WHEN sy >= 5 THEN 4 WHEN sy >= 3 THEN 3 WHEN sy >= 1 THEN 2 ELSE 0 END + CASE WHEN ay >= 5 THEN 4 WHEN ay >= 3 THEN 3 WHEN ay >= 1 THEN 2 ELSE 0 END
            + CASE WHEN coalesce(persistent, false) THEN 2 ELSE 0 END + CASE WHEN mh >= 3 THEN 2 WHEN mh >= 1 THEN 1 ELSE 0 END AS temporal_points
        FROM k JOIN c USING (node) JOIN u USING (node) LEFT JOIN q USING (node) LEFT JOIN fin USING (node))
    SELECT node, CAST(circular_points AS BIGINT) AS circular_points, CAST(financial_points AS BIGINT) AS financial_points, CAST(temporal_points AS BIGINT) AS temporal_points,
        CAST(least(30, circular_points + financial_points + temporal_points) AS BIGINT) AS score FROM z""")
def loop_risk(spark, d):
    """One score for each member of a loop, from its loops, its latest filing and the years in which money came back."""
    members = G.participants(H.cycles_by_halves(view(spark, d, "party_edges"), 6))
    f = view(spark, d, "filings")
    latest = f.groupBy(F.col("filer").alias("node")).agg(F.max_by(F.struct(*f.columns), "filing").alias("f")).select("node", "f.*")
    fields = latest.select("node", F.col("total").alias("revenue"), (F.col("program_spending") + F.col("compensation")).alias("spending"), F.col("program_spending").alias("program"), F.col("c").alias("overhead"), F.col("a").alias("gifts_in"), F.col("b").alias("gifts_out"), F.col("compensation").alias("pay"))
    r = view(spark, d, "roles").select("org", "person").distinct()
    shared = r.join(r.groupBy("person").count().where("count > 1").select("person"), "person").select(F.col("org").alias("node"))
    return K.loop_risk(members, written(view(spark, d, "party_flows"), "flows"), fields, shared)


@query("loop_labels", "O-191 O-137", f"""
    WITH {_PARTY_MEMBERS}, n AS (SELECT c_custkey AS node, {_KIND_NAMES}[c_custkey % 5 + 1] || c_name AS name FROM customer),
    g AS (SELECT path_key, string_agg(name, ' | ' ORDER BY i) AS names FROM m JOIN n USING (node) GROUP BY 1)
    SELECT path_key, names, CASE WHEN regexp_matches(upper(names), '{N.DENOMINATIONS}') THEN 'likely_normal_denominational_network'
        WHEN contains(upper(names), 'FOUNDATION') AND regexp_matches(upper(names), 'HOSPITAL|HEALTH') THEN 'likely_normal_foundation_operator'
        WHEN regexp_matches(upper(names), 'UNITED WAY|YMCA|YWCA|FEDERATION|FEDERATED|COMMUNITY FOUNDATION') THEN 'likely_normal_federated_network' ELSE 'review' END AS interpretation FROM g""")
def loop_labels(spark, d):
    """What each loop most likely is, by the names on it."""
    m = G.participants(H.cycles_by_halves(view(spark, d, "party_edges"), 6)).select("path_key", "position", "node")
    kind = F.element_at(F.array(*map(F.lit, _KIND_NAMES)), (F.col("c_custkey") % 5 + 1).cast("int"))
    names = view(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.concat(kind, "c_name").alias("name"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), " | ")
    return m.join(names, "node").groupBy("path_key").agg(listed.alias("names")).withColumn("interpretation", N.loop_label(F.col("names")))
