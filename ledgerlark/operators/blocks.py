"""Graph steps that run to rest inside blocks of a graph before anything is exchanged.

A block owns nodes whose edges it holds whole, at most about ``EDGES_AT_ONCE``
of them; a node with too many edges for that is owned by none and is left to
the plain steps between the rounds. So rounds grow with the number of blocks
that a way crosses and not with the number of its steps.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES_AT_ONCE = 200_000


def _block_of(edges: DataFrame, blocks: int, turn: int):
    """A function from a node column to its block: neighbouring numbers together, borders moved every turn; other ids by hash."""
    if blocks == 1:
        return lambda c: F.lit(0)
    if isinstance(edges.schema["src"].dataType, T.NumericType):
        ends = edges.select(F.col("src").cast("double").alias("n")).unionByName(edges.select(F.col("dst").cast("double").alias("n")))
        cuts = ends.approxQuantile("n", [(k + (turn % 2) / 2) / blocks for k in range(1, blocks)], 0.1 / blocks)
        return lambda c: F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < c))
    return lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(blocks)).cast("int")


def dealt(edges: DataFrame, turn: int, more: tuple[str, ...] = (), edges_at_once: int | None = None) -> DataFrame:
    """``edges`` (src, dst and the columns ``more``) with the block they go to and which of their ends it owns; an edge between two blocks goes to both."""
    edges_at_once = edges_at_once or EDGES_AT_ONCE
    blocks = max(1, -(-2 * edges.count() // edges_at_once))
    block = _block_of(edges, blocks, turn)
    a, b = block(F.col("src")), block(F.col("dst"))
    rows = edges.select("src", "dst", *more, a.alias("a"), b.alias("b"))
    if blocks > 1:
        degree = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").count()
        wide = degree.where(F.col("count") > edges_at_once // 10)  # at most 20 such nodes a block
        for end, at in (("src", "a"), ("dst", "b")):
            known = wide.select(F.col("node").alias(end), F.lit(True).alias("wide"))
            rows = rows.join(known, end, "left").withColumn(at, F.when(F.col("wide").isNull(), F.col(at))).drop("wide")
    each = rows.withColumn("block", F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))))
    owned = lambda c: F.coalesce(F.col(c) == F.col("block"), F.lit(False))
    return each.select("block", "src", "dst", *more, owned("a").alias("own_src"), owned("b").alias("own_dst"))


def _numbered(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each edge's source, of its target, the nodes, which are owned)."""
    codes, nodes = pd.factorize(pd.concat([frame["src"], frame["dst"]], ignore_index=True))
    s, t = codes[: len(frame)], codes[len(frame) :]
    own = np.zeros(len(nodes), bool)
    own[s[frame["own_src"].to_numpy(bool)]] = True
    own[t[frame["own_dst"].to_numpy(bool)]] = True
    return s, t, np.asarray(nodes), own


def _lists(keys: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
    """The values of each key."""
    order = np.argsort(keys, kind="stable")
    return np.split(values[order], np.cumsum(np.bincount(keys, minlength=n))[:-1])


def _peel(frame: pd.DataFrame) -> pd.DataFrame:
    """Owned nodes that end up without an edge in or without an edge out."""
    s, t, nodes, own = _numbered(frame)
    after, before = _lists(s, t, len(nodes)), _lists(t, s, len(nodes))
    into, out = np.bincount(t, minlength=len(nodes)), np.bincount(s, minlength=len(nodes))
    gone = own & ((into == 0) | (out == 0))
    queue = deque(np.flatnonzero(gone))
    while queue:
        v = queue.popleft()
        for others, left in ((after[v], into), (before[v], out)):
            for w in others:
                left[w] -= 1
                if own[w] and not gone[w] and left[w] == 0:
                    gone[w] = True
                    queue.append(w)
    return pd.DataFrame({"node": nodes[gone]})


def dead_nodes(edges: DataFrame, turn: int, edges_at_once: int | None = None) -> DataFrame:
    """(node): nodes that no cycle can hold, as far as each block can tell. ``edges``: distinct (src, dst)."""
    kind = edges.schema["src"].dataType
    rows = dealt(edges, turn, edges_at_once=edges_at_once)
    return rows.groupBy("block").applyInPandas(lambda frame: _peel(frame), T.StructType([T.StructField("node", kind)]))


def _flow(frame: pd.DataFrame) -> pd.DataFrame:
    """Owned nodes with the least label that reaches them inside the block, where that is less than their own."""
    s, t, nodes, own = _numbered(frame)
    after = _lists(s, t, len(nodes))
    label = np.empty(len(nodes), object)
    label[s], label[t] = frame["at_src"].to_numpy(object), frame["at_dst"].to_numpy(object)
    before = label.copy()
    heap = [(x, v) for v, x in enumerate(label)]
    heapq.heapify(heap)
    done = np.zeros(len(nodes), bool)
    while heap:
        x, v = heapq.heappop(heap)
        if done[v] or x > label[v]:
            continue
        done[v] = True
        for w in after[v]:
            if own[w] and x < label[w]:
                label[w] = x
                heapq.heappush(heap, (x, w))
    less = np.flatnonzero([own[v] and label[v] < before[v] for v in range(len(nodes))])
    return pd.DataFrame({"node": nodes[less], "label": label[less]})


def labels_within(edges: DataFrame, labels: DataFrame, turn: int, edges_at_once: int | None = None) -> DataFrame:
    """(node, label): labels that get smaller by running along the edges of one block. ``labels``: (node, label)."""
    kind = edges.schema["src"].dataType
    known = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"at_{end}"))
    both = edges.join(known("src"), "src").join(known("dst"), "dst")
    rows = dealt(both, turn, ("at_src", "at_dst"), edges_at_once)
    out = T.StructType([T.StructField("node", kind), T.StructField("label", kind)])
    return rows.groupBy("block").applyInPandas(lambda frame: _flow(frame), out)


def _knots(after: list[np.ndarray]) -> np.ndarray:
    """Strong component of each node, as its first node in a depth-first walk; without recursion."""
    n = len(after)
    seen, low, part = np.full(n, -1), np.zeros(n, int), np.full(n, -1)
    open_: list[int] = []
    count = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        walk = [(root, iter(after[root]))]
        seen[root] = low[root] = count
        count += 1
        open_.append(root)
        while walk:
            v, rest = walk[-1]
            for w in rest:
                if seen[w] < 0:
                    seen[w] = low[w] = count
                    count += 1
                    open_.append(w)
                    walk.append((w, iter(after[w])))
                    break
                if part[w] < 0:
                    low[v] = min(low[v], seen[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == seen[v]:
                    while True:
                        w = open_.pop()
                        part[w] = v
                        if w == v:
                            break
    return part


def _knotted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[frame["own_src"] & frame["own_dst"]]
    s, t, nodes, _ = _numbered(frame)
    part = _knots(_lists(s, t, len(nodes))) if len(nodes) else np.zeros(0, int)
    many = np.flatnonzero(np.bincount(part, minlength=len(nodes))[part] > 1)
    return pd.DataFrame({"node": nodes[many], "head": nodes[part[many]]})


def knots_within(edges: DataFrame, turn: int, edges_at_once: int | None = None) -> DataFrame:
    """(node, head) of the nodes that are in one strong component by edges inside their block, named by one of them."""
    kind = edges.schema["src"].dataType
    rows = dealt(edges, turn, edges_at_once=edges_at_once)
    return rows.groupBy("block").applyInPandas(lambda frame: _knotted(frame), T.StructType([T.StructField("node", kind), T.StructField("head", kind)]))
