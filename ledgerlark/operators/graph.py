"""Gift graphs: edges, pruning, cycles, components, walks, flows. Edges are (src, dst, total_amt, min_year, max_year)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators import blocks
from ledgerlark.sources.store import release, written

PLAIN_ROUNDS = 8  # times to prune before paths are made one edge


def build_edges(gifts: DataFrame, src: str = "src", dst: str = "dst", amount: str = "amount", year: str = "year", min_gift: float = 5000) -> DataFrame:
    """One edge per pair from gifts of at least ``min_gift`` each; no self-loops."""
    kept = gifts.where((F.col(amount) >= min_gift) & (F.col(src) != F.col(dst)))
    return kept.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(
        F.sum(amount).alias("total_amt"), F.count("*").alias("edge_count"), F.min(year).alias("min_year"), F.max(year).alias("max_year"), F.array_sort(F.collect_set(year)).alias("years"))


def _pruned_once(edges: DataFrame) -> DataFrame:
    """Without the edges whose source has no gift in, then those whose target has none out."""
    fed = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return fed.join(fed.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)


def _without(edges: DataFrame, dead: DataFrame) -> DataFrame:
    """``edges`` that touch none of the nodes."""
    for end in ("src", "dst"):
        edges = edges.join(dead.select(F.col("node").alias(end)), end, "left_anti")
    return edges


def _pruned(edges: DataFrame, least: float, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """Prune while a round takes more than the share ``least`` of the edges; and whether it came to rest within ``rounds``.

    Two plain rounds, which is all that most graphs need; then blocks of the
    graph are pruned to rest between the plain rounds.
    """
    n, turn = edges.count(), 0
    while rounds is None or turn < rounds:
        before, edges = edges, written(_pruned_once(edges), "edges")
        m = edges.count()
        release(before)
        if n - m <= least * n:
            return edges, True
        if turn >= 2:
            dead = written(blocks.dead_nodes(edges.select("src", "dst").distinct(), turn), "dead")
            before, edges = edges, written(_without(edges, dead).select(*edges.columns), "edges")
            release(before, dead)
            m = edges.count()
        n, turn = m, turn + 1
    return edges, False


def prune_dead_ends(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle: those whose source has no gift in, then whose target has none out, go, until none does.

    Where that takes long, paths whose inner nodes have one gift in and one out
    count as one edge, so a chain of any length goes at once.
    """
    left = written(edges, "edges")
    while True:
        left, rested = _pruned(left, 0, PLAIN_ROUNDS)
        if rested:
            return left
        ends = contract(left)
        if ends is None:
            continue
        tagged = _with_ends(left, ends)
        short = tagged.where("not ring").select(F.col("head").alias("src"), F.col("tail").alias("dst")).distinct()
        kept = prune_dead_ends(short).select(F.col("src").alias("head"), F.col("dst").alias("tail"), F.lit(True).alias("kept"))
        return tagged.join(kept, ["head", "tail"], "left").where(F.col("ring") | F.coalesce("kept", F.lit(False))).select(*left.columns)


def contract(edges: DataFrame, least: int = 1) -> DataFrame | None:
    """(node, head, tail, ring, least) for the nodes with one edge in and one out: between which other nodes their path runs.

    Found by doubling: each round a node looks twice as far along its path. A
    ring of such nodes has no other node; ``least`` is its smallest one. None if
    there are fewer than ``least`` such nodes. ``edges``: distinct (src, dst).
    """
    pairs = edges.select("src", "dst").distinct()
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("after")).where("n = 1")
    into = pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("before")).where("n = 1")
    inner = written(out.join(into, "node").where("after <> node").select("node", "after", "before", F.col("node").alias("least")), "inner")
    n = inner.count()
    if n < max(1, least):
        release(inner)
        return None
    for _ in range(n.bit_length()):
        ahead = inner.select(F.col("node").alias("after"), F.col("after").alias("after2"), F.col("least").alias("least2"))
        behind = inner.select(F.col("node").alias("before"), F.col("before").alias("before2"))
        far = inner.join(ahead, "after", "left").join(behind, "before", "left")
        before, inner = inner, written(far.select("node", F.coalesce("after2", "after").alias("after"), F.coalesce("before2", "before").alias("before"), F.least("least", "least2").alias("least")), "inner")
        release(before)
    ends = inner.join(inner.select(F.col("node").alias("after"), F.lit(True).alias("ring")), "after", "left")
    return written(ends.select("node", F.col("before").alias("head"), F.col("after").alias("tail"), F.coalesce("ring", F.lit(False)).alias("ring"), "least"), "ends")


def _with_ends(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``edges`` with (head, tail), the edge that stands for their path, and whether they are part of a ring."""
    a = ends.select(F.col("node").alias("src"), "head", F.col("ring").alias("ring_a"))
    b = ends.select(F.col("node").alias("dst"), "tail", F.col("ring").alias("ring_b"))
    tagged = edges.join(a, "src", "left").join(b, "dst", "left")
    return tagged.select(*edges.columns, F.coalesce("head", "src").alias("head"), F.coalesce("tail", "dst").alias("tail"), F.coalesce(F.col("ring_a") | F.col("ring_b"), F.lit(False)).alias("ring"))


_PATH = ("path", "root", "tail", "bottleneck", "total_flow", "min_year", "max_year")


def _within(window: int | None) -> Column:
    return F.lit(True) if window is None else F.col("max_year") - F.col("min_year") <= window


def _first_paths(edges: DataFrame, window: int | None, start: Column | None) -> DataFrame:
    paths = edges.where(F.col("dst") > F.col("src"))
    if start is not None:
        paths = paths.where(start)
    return paths.select(F.array("src", "dst").alias("path"), F.col("src").alias("root"), F.col("dst").alias("tail"), F.col("total_amt").alias("bottleneck"), F.col("total_amt").alias("total_flow"), "min_year", "max_year").where(_within(window))


def _joined(paths: DataFrame, edges: DataFrame, closing: bool, window: int | None) -> DataFrame:
    """Paths one edge longer, or closed: a join on both ends."""
    hop = edges.select(F.col("src").alias("tail"), F.col("dst").alias("root" if closing else "to"), F.col("total_amt").alias("amt"), F.col("min_year").alias("y0"), F.col("max_year").alias("y1"))
    j = paths.join(hop, ["tail", "root"]) if closing else paths.join(hop, "tail").where((F.col("to") > F.col("root")) & ~F.array_contains("path", F.col("to")))
    path, tail = ("path", "tail") if closing else (F.array_append("path", F.col("to")).alias("path"), F.col("to").alias("tail"))
    longer = j.select(path, "root", tail, F.least("bottleneck", "amt").alias("bottleneck"), (F.col("total_flow") + F.col("amt")).alias("total_flow"), F.least("min_year", "y0").alias("min_year"), F.greatest("max_year", "y1").alias("max_year"))
    return longer.where(_within(window))


def _as_cycles(closed: DataFrame) -> DataFrame:
    return closed.select("path", F.array_join("path", ">").alias("path_key"), F.size("path").alias("hops"), "bottleneck", "total_flow", "min_year", "max_year")


def cycles(edges: DataFrame, k: int, window: int | None = None, start: Column | None = None) -> DataFrame:
    """Simple cycles of exactly ``k`` hops: path (from its smallest node), bottleneck, total_flow, min_year, max_year.

    Paths are extended edge by edge from their smallest node. The year span of
    a path only grows, so a path beyond ``window`` is given up at once and not
    after the last join. ``start`` limits the smallest node.
    """
    if not 2 <= k <= 8:
        raise ValueError("2 to 8 hops")
    paths = _first_paths(edges, window, start)
    for _ in range(k - 2):
        paths = _joined(paths, edges, False, window)
    return _as_cycles(_joined(paths, edges, True, window))


def all_cycles(edges: DataFrame, most: int, window: int | None = None, start: Column | None = None) -> DataFrame:
    """Cycles of 2 to ``most`` hops by one extension of paths, which are closed at every length and carried on.

    Dead ends go first as far as that is worth its while: in rounds that each
    take a twentieth of the edges or more.
    """
    if not 2 <= most <= 8:
        raise ValueError("2 to 8 hops")
    edges, _ = _pruned(written(edges.select("src", "dst", "total_amt", "min_year", "max_year"), "edges"), 0.05)
    paths = _first_paths(edges, window, start)
    found = _joined(paths, edges, True, window)
    for _ in range(most - 2):
        paths = written(_joined(paths, edges, False, window), "paths")
        found = found.unionByName(_joined(paths, edges, True, window))
    return _as_cycles(found)


def participants(found: DataFrame) -> DataFrame:
    """One row per node and cycle with whom it sends to and receives from."""
    n = F.size("path")
    rows = found.select("path_key", "hops", "bottleneck", "total_flow", "path", F.posexplode("path").alias("position", "node"))
    return rows.select("path_key", "hops", "bottleneck", "total_flow", "position", "node", F.element_at("path", (F.col("position") + 1) % n + 1).alias("sends_to"), F.element_at("path", (F.col("position") - 1 + n) % n + 1).alias("receives_from"))


def universe(members: DataFrame, most: int = 6) -> DataFrame:
    """Per node: cycles by hops, the largest and the summed bottleneck."""
    hops = [F.count_if(F.col("hops") == k).alias(f"loops_{k}hop") for k in range(2, most + 1)]
    return members.groupBy("node").agg(F.count("*").alias("total_loops"), *hops, F.max("bottleneck").alias("max_bottleneck"), F.sum("bottleneck").alias("total_circular_amt"))


def reciprocal(edges: DataFrame) -> DataFrame:
    """Pairs with gifts both ways, smaller node first, with both totals."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("total_amt").alias("received"))
    return edges.where("src < dst").join(back, ["src", "dst"]).select("src", "dst", F.col("total_amt").alias("sent"), "received")


def _reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node that reaches each node along edges.

    A round takes a step along the edges, then gives each node the label of the
    node that it is labelled with: what reaches that one reaches this one. After
    two rounds labels also run through blocks of the graph until they rest. So
    far fewer rounds are needed than the longest way has steps.
    """
    labels, state, turn = nodes.select("node", F.col("node").alias("label")), None, 0
    while True:
        sent = edges.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
        near = labels.unionByName(sent)
        if turn >= 2:
            near = near.unionByName(blocks.labels_within(edges, labels, turn))
        near, turn = near.groupBy("node").agg(F.min("label").alias("label")), turn + 1
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        before, labels = labels, written(near.join(jump, "label", "left").select("node", F.least("label", "far").alias("label")), "labels")
        release(before)
        now = labels.agg(F.count("label"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()
        if now == state:
            return labels
        state = now


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes; the component is its smallest node.

    Nodes that are strongly connected inside a block of the graph are made one
    node, as long as that finds any. For the rest, colour every node with the
    least node that reaches it; the nodes of a colour that reach its root back
    are the root's component. They are taken out and the rest is coloured anew;
    dead ends go first, each a component of its own. Where half of the nodes or
    more have one edge in and one out, their paths are made one edge: they are
    in a component if both their ends are, so long rings and chains take as many
    rounds as their length has bits.
    """
    edges = written(edges.select("src", "dst").distinct(), "graph")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", F.col("node").alias("head"))
    left, turn, idle = prune_dead_ends(edges.where("src <> dst")), 0, 0
    while idle < 2 and not left.isEmpty():
        knots = written(blocks.knots_within(left, turn), "knots")
        turn += 1
        if knots.isEmpty():
            idle += 1  # the next borders may cut less
            continue
        nodes = written(_named(nodes, knots, "head"), "heads")
        idle, left = 0, prune_dead_ends(_named(_named(left, knots, "src"), knots, "dst").where("src <> dst").distinct())
    found = _parts(left)
    if found is not None:
        nodes = _named(nodes, found.withColumnRenamed("component", "head"), "head")
    nodes = written(nodes, "heads")
    least = nodes.groupBy("head").agg(F.min("node").alias("component"))
    return nodes.join(least, "head").select("node", "component")


def _named(rows: DataFrame, heads: DataFrame, column: str) -> DataFrame:
    """``rows`` with the nodes in a column replaced by their heads. ``heads``: (node, head)."""
    known = heads.select(F.col("node").alias("_node"), F.col("head").alias("_head"))
    return rows.join(known, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_head", column)).select(*rows.columns)


def _parts(edges: DataFrame) -> DataFrame | None:
    """(node, component) of the nodes on cycles, any node of it naming the component; None if there is no cycle."""
    left = prune_dead_ends(edges)
    if left.isEmpty():
        return None
    n = left.select("src").union(left.select("dst")).distinct().count()
    ends = contract(left, -(-n // 2))
    if ends is not None:
        rings = ends.where("ring").select("node", F.col("least").alias("component"))
        short = _with_ends(left, ends).where("not ring").select(F.col("head").alias("src"), F.col("tail").alias("dst")).distinct()
        parts = _parts(written(short, "graph"))
        if parts is None:
            return written(rings, "component")
        part = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        paths = ends.where("not ring").join(part("head"), "head").join(part("tail"), "tail").where("of_head = of_tail").select("node", F.col("of_head").alias("component"))
        return written(parts.unionByName(rings).unionByName(paths), "component")
    found = None
    while not left.isEmpty():
        live = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colours = _reach(live, left).withColumnRenamed("label", "colour")
        colour = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"of_{end}"))
        within = left.join(colour("src"), "src").join(colour("dst"), "dst").where("of_src = of_dst")
        back = written(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "coloured")
        # the root of a colour is its least node, so whoever reaches the root is labelled with it
        reached = _reach(live, back).join(colours, "node").where("label = colour").select("node", F.col("colour").alias("component"))
        reached = written(reached, "component")
        found = reached if found is None else found.unionByName(reached)
        rest = left.join(reached.select(F.col("node").alias("src")), "src", "left_anti").join(reached.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        left = prune_dead_ends(rest)
    return found


def component_summary(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Per component: nodes, edges inside and their flow."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("node_count"))
    tagged = edges.join(parts.select(F.col("node").alias("src"), "component"), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("to")), "dst").where("component = to")
    inner = tagged.groupBy("component").agg(F.count("*").alias("edge_count"), F.sum("total_amt").alias("internal_flow"))
    return sizes.join(inner, "component", "left").select("component", "node_count", F.coalesce("edge_count", F.lit(0)).cast("bigint").alias("edge_count"), F.coalesce("internal_flow", F.lit(0)).alias("internal_flow"))


def hubs(edges: DataFrame) -> DataFrame:
    """Per node: degrees and flows in and out."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"), F.sum("total_amt").alias("outflow"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"), F.sum("total_amt").alias("inflow"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return out.join(into, "node", "full").select("node", z("in_degree").cast("bigint").alias("in_degree"), z("out_degree").cast("bigint").alias("out_degree"), (z("in_degree") + z("out_degree")).cast("bigint").alias("degree"), z("inflow").alias("inflow"), z("outflow").alias("outflow"))


def closed_walks(edges: DataFrame, most: int) -> DataFrame:
    """(node, k, walks): closed walks of 2 to ``most`` steps at each node, exact: no vector is cut."""
    hop = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    state = hop.select(F.col("at").alias("node"), F.col("to").alias("at"), F.lit(1).cast("decimal(38,0)").alias("n"))
    found = None
    for k in range(2, most + 1):
        state = state.join(hop, "at").groupBy("node", F.col("to").alias("at")).agg(F.sum("n").cast("decimal(38,0)").alias("n"))
        closed = state.where("node = at").select("node", F.lit(k).alias("k"), F.col("n").cast("bigint").alias("walks"))
        found = closed if found is None else found.unionByName(closed)
    return found


def induced(edges: DataFrame, nodes: DataFrame, ego: bool = False) -> DataFrame:
    """Edges among the nodes, with ``ego`` also those that touch one."""
    a = edges.join(nodes.select(F.col("node").alias("src"), F.lit(True).alias("_s")), "src", "left").join(nodes.select(F.col("node").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    test = (F.col("_s") | F.col("_d")) if ego else (F.col("_s") & F.col("_d"))
    return a.where(F.coalesce(test, F.lit(False))).select(*edges.columns)


def symmetric_flows(yearly: DataFrame, apart: int = 0) -> DataFrame:
    """Pairs with gifts out in a year and back ``apart`` years later: symmetry and level. ``yearly``: (src, dst, year, amount).

    For adjacent years, gifts that are answered in the same year are left out on both sides.
    """
    out = yearly
    back = yearly.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("year") - apart).alias("year"), F.col("amount").alias("returned"))
    if apart:
        same = symmetric_flows(yearly).select("src", "dst", "year")
        both = same.unionByName(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "year"))
        out = out.join(both, ["src", "dst", "year"], "left_anti")
        back = back.join(both.withColumn("year", F.col("year") - apart), ["src", "dst", "year"], "left_anti")
    else:
        out = out.where("src < dst")
    j = out.join(back, ["src", "dst", "year"])
    symmetry = F.least("amount", "returned").cast("double") / F.nullif(F.greatest("amount", "returned").cast("double"), F.lit(0.0))
    return j.select("src", "dst", "year", "amount", "returned", F.round(symmetry, 6).alias("symmetry"), F.when(symmetry > 0.75, "HIGH").when(symmetry > 0.5, "MEDIUM").otherwise("LOW").alias("level"))


def shared_people(roles: DataFrame, least: int = 2, org: str = "org", person: str = "person", year: str = "year") -> DataFrame:
    """Pairs of organisations that share at least ``least`` people, with the years in which they do. ``roles``: (org, person, year).

    Roles are first one row per person and organisation. Organisations that
    share that many people also share one besides the ``least`` - 1 most
    widespread of each, in one order of all people; only through the others do
    they meet, so someone who sits everywhere does not list all pairs, and are
    counted as they meet. To a pair that met, the people left out of the one
    are added if they sit in the other, at most twice ``least`` - 1 of them, so
    nobody else is looked up again. Nulls are shared by nobody.
    """
    r = roles.dropna(subset=[org, person]).groupBy(F.col(org).alias("org"), F.col(person).alias("person")).agg(F.min(year).alias("y0"), F.max(year).alias("y1"))
    r = written(r, "roles")
    meeting = r.join(r.groupBy("person").agg(F.count("*").alias("seats")).where("seats > 1"), "person")
    if least > 1:
        widest = Window.partitionBy("org").orderBy(F.desc("seats"), F.desc("person"))
        meeting = written(meeting.withColumn("left_out", F.row_number().over(widest) < least), "meeting")
    else:
        meeting = meeting.withColumn("left_out", F.lit(False))
    keyed, left_out = meeting.where("not left_out"), meeting.where("left_out")
    side = lambda rows, s: rows.select(F.col("org").alias(f"org_{s}"), "person", F.col("y0").alias(f"{s}0"), F.col("y1").alias(f"{s}1"))
    told = [F.count("*").alias("n"), F.min(F.greatest("a0", "b0")).alias("first"), F.max(F.least("a1", "b1")).alias("last")]
    counted = side(keyed, "a").join(side(keyed, "b"), "person").where("org_a < org_b").groupBy("org_a", "org_b").agg(*told)
    if least > 1:
        counted = written(counted, "met")
        met, rest = counted.select("org_a", "org_b"), [(side(left_out, "a"), side(meeting, "b")), (side(left_out, "b"), side(keyed, "a"))]
        for few, other in rest:
            one, two = few.columns[0], other.columns[0]
            more = met.join(few, one).join(other, [two, "person"]).groupBy("org_a", "org_b").agg(*told)
            counted = counted.unionByName(more)
        counted = counted.groupBy("org_a", "org_b").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return counted.select("org_a", "org_b", F.col("n").alias("shared_people"), F.col("first").alias("overlap_first_year"), F.col("last").alias("overlap_last_year")).where(F.col("shared_people") >= least)


def seeded_cycles(edges: DataFrame, node, k: int, window: int | None = None) -> DataFrame:
    """Cycles of ``k`` hops through one node."""
    return cycles(edges, k, window, F.col("src") <= F.lit(node)).where(F.array_contains("path", F.lit(node)))


def cross_flags(nodes: DataFrame, **sets: DataFrame) -> DataFrame:
    """``nodes`` with a boolean per named set of nodes."""
    for name, s in sets.items():
        nodes = nodes.join(s.select("node").distinct().withColumn(f"in_{name}", F.lit(True)), "node", "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    return nodes


def top_edges(edges: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    from ledgerlark.operators.topk import top_per_group

    return top_per_group(edges, keys, [F.col("total_amt").desc(), F.col("dst")], k).drop("rank")
