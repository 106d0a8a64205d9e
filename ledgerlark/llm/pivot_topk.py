"""Exact top-k inner-product search with a pivot table.

Vectors are quantised to integers. Every vector is stored with its distances to
a fixed number of pivots; by the triangle inequality |d(q,p) - d(x,p)| is at
most d(q,x) for every pivot p, so the largest of these bounds the distance from
below and, with the norms, the score from above. Candidates are evaluated in
order of their bound until the k-th score found beats every bound left.

The same bound holds for blocks. Vectors that have the same pivots nearest, in
the same order, form a cell; a cell is cut into blocks of bounded size, and a
block is known by its least and greatest distance to each pivot. A query first
meets its own block. Its k-th score then tells which other blocks can hold
anything better: only these (query, block) pairs are sent, in order of their
bound, in rounds that grow by ``GROWTH``, until no bound reaches the k-th score.

Pivots are chosen farthest-first from a bounded sample; the bounds hold for any
pivots, and none are needed for the result to be exact.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows of null id. A query meets the vectors of its own
length. Ties go to the smaller id; rows that repeat an id are candidates of
their own, but no query meets a row of its own id, and queries that share an id
are answered together. A score beyond 64 bits is returned as the nearest 64-bit
integer; such scores are ordered as doubles. Components beyond the largest
double are taken as that.
Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import release, written

K, PIVOTS, SAMPLE, SCALE = 10, 24, 1000, 1024
LENGTHS = 8  # vector lengths, the most common ones, that get pivots; others are searched without
BLOCK = 4096  # candidates of a block, and queries that meet it in one task, about
SUMMARIES = 16_384  # summaries of blocks in one broadcast, some 400 bytes each; more are gone through in turn
FIRST, GROWTH = 63, 4  # blocks that a query meets at once after its own, and how many times as many in each further round
_LARGEST, _LONG = 1.7976931348623157e308, 1 << 63


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n, v, row): components as floor(1024 * x), for the vectors that take part, with their length and a number."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))))
    scaled = lambda c: F.least(F.greatest(c * SCALE, F.lit(-_LARGEST)), F.lit(_LARGEST))
    # from 2**53 on a double has no fraction
    whole = F.transform("v", lambda c: F.when(F.abs(c) * SCALE < float(1 << 53), F.floor(c * SCALE).cast("double")).otherwise(scaled(c)))
    return rows.select("id", F.size("v").alias("n"), whole.alias("v"), F.monotonically_increasing_id().alias("row"))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Farthest-first pivots among the ``sample`` vectors of smallest hash, all of one length."""
    some = [r.v for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).collect()]
    if not some:
        return np.zeros((0, 0))
    x = np.array(some, float)
    chosen, far = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < min(pivots, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        cols = [np.sqrt(((x - p) ** 2).sum(1)) for p in pivots]
    return np.nan_to_num(np.stack(cols, 1), nan=np.inf, posinf=np.inf) if cols else np.zeros((len(x), 0))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def with_pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray], depth: int = 1) -> DataFrame:
    """Adds ``d``, the distances to the pivots of the vector's length, and ``cell``, the ``depth`` nearest in order."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # LENGTHS x pivots x dimensions, whatever the size of the table

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby("n"):
                table = sent.value.get(n, np.zeros((0, n)))
                d = _distances(_stacked(part.v), table)
                near = np.argsort(d, axis=1, kind="stable")[:, :depth]
                cell = near @ (len(table) ** np.arange(near.shape[1], dtype=np.int64)) if near.size else np.zeros(len(part), np.int64)
                yield pd.DataFrame({"id": part.id, "n": part.n, "v": part.v, "row": part.row, "d": list(d), "cell": cell})

    return rows.mapInPandas(run, "id long, n int, v array<double>, row long, d array<double>, cell long")


def _score_bound(low: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Upper bound of the score from a lower bound of the distance and the sum of both squared norms, with a slack far above rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        low = np.maximum(low - 1e-6 * (1 + np.sqrt(norms)), 0)
        return np.nan_to_num((norms - low * low) / 2 + 1e-6 * (1 + norms), nan=np.inf, posinf=np.inf, neginf=np.inf)


def _exact_kind(x: np.ndarray, q: np.ndarray) -> type | None:
    """In which arithmetic all scores are exact: doubles, 64-bit integers, or None."""
    one, other = np.abs(x).max(initial=0), np.abs(q).max(initial=0)
    with np.errstate(over="ignore"):
        most = one * other * max(1, x.shape[1])
    return float if most < 1 << 53 else np.int64 if most < 1 << 62 and max(one, other) < 1 << 62 else None


def _scores(x: np.ndarray, vec: np.ndarray, kind: type | None) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit scores, scores as doubles)."""
    if kind is not None:
        found = x @ vec
        return found.astype(np.int64), found.astype(float)
    exact = [sum(int(a) * int(b) for a, b in zip(row, vec.tolist())) for row in x.tolist()]
    return np.array([max(-_LONG, min(_LONG - 1, s)) for s in exact], np.int64), np.array([float(s) if abs(s) < 1 << 1023 else (math.inf if s > 0 else -math.inf) for s in exact])


def search_block(ids: np.ndarray, x: np.ndarray, d: np.ndarray, qids: np.ndarray, q: np.ndarray, dq: np.ndarray, k: int = K, kth: np.ndarray | None = None) -> tuple[list[tuple[int, int, int, float]], int]:
    """Each query's k best of a block, as (query, id, score, score as double), and how many candidates were evaluated.

    ``kth``: what a query's k-th score is already, -inf if nothing; less is not looked for.
    """
    kind = _exact_kind(x, q)
    x, q = (x.astype(kind), q.astype(kind)) if kind else (x, q)
    with np.errstate(over="ignore"):
        norms, qnorms = (x.astype(float) ** 2).sum(1), (q.astype(float) ** 2).sum(1)
    out, evaluated, finite = [], 0, np.isfinite(d).all() and np.isfinite(dq).all()
    known = np.full(len(qids), -np.inf) if kth is None else kth
    for qid, vec, row, norm, least in zip(qids.tolist(), q, dq, qnorms, known.tolist()):
        if not d.shape[1] or not finite:
            low = np.zeros(len(ids))
        else:
            low = np.abs(d - row).max(1)
        bound = _score_bound(low, norms + norm)
        at = np.flatnonzero((bound >= least) & (ids != qid))
        at = at[np.argsort(-bound[at], kind="stable")]
        step, done, whole = 4 * k + 60, 0, None
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        while done < len(at) and not (len(held[0]) == k and bound[at[done]] < held[2][-1]):
            part = at[done : done + step]
            if 4 * len(part) > len(ids) and whole is None:
                whole = _scores(x, vec, kind)  # cheaper than to pick so many rows
            scores, doubles = _scores(x[part], vec, kind) if whole is None else (whole[0][part], whole[1][part])
            if len(held[0]) == k:
                near = doubles >= held[2][-1]
                part, scores, doubles = part[near], scores[near], doubles[near]
            held = tuple(np.concatenate(pair) for pair in zip(held, (ids[part], scores, doubles)))
            best = np.lexsort((held[0], -held[1], -held[2]))[:k]
            held = tuple(h[best] for h in held)
            evaluated += min(step, len(at) - done)
            done += step
            step *= 4
        out += [(qid, *row) for row in zip(*(h.tolist() for h in held))]
    return out, evaluated


_FOUND = "query_id long, vec_id long, score long, double double"


def _met(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """What queries (n, block, y, id, v, d, kth) find in the blocks (n, block, y, id, v, d), and a row of null query_id for each meeting: pairs and evaluations."""

    def meet(cands: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if cands.empty or asking.empty:
            return pd.DataFrame({"query_id": pd.Series([], dtype="Int64"), "vec_id": [], "score": [], "double": []})
        load = lambda f: (f.id.to_numpy(np.int64), _stacked(f.v), _stacked(f.d))
        found, evaluated = search_block(*load(cands), *load(asking), k, asking.kth.fillna(-np.inf).to_numpy(float))
        out = pd.DataFrame([*found, (None, len(asking), evaluated, 0.0)], columns=["query_id", "vec_id", "score", "double"])
        return out.astype({"query_id": "Int64", "vec_id": "int64", "score": "int64"})

    key = ["n", "block", "y"]
    return candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(meet, _FOUND)


def _summaries(table: DataFrame, pivots: int) -> DataFrame:
    """(n, block, low, high, norm): each block's least and greatest distance to each pivot, and its largest squared norm."""
    ends = lambda f: F.array(*(f(F.get("d", F.lit(p))) for p in range(pivots)))
    return table.groupBy("n", "block").agg(ends(F.min).alias("low"), ends(F.max).alias("high"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("norm"))


def _loaded(rows: list) -> dict[int, tuple[np.ndarray, ...]]:
    """Summaries by vector length as arrays: blocks, least and greatest distances, norms."""
    out = {}
    for n in {r.n for r in rows}:
        own = [r for r in rows if r.n == n]
        width = sum(x is not None for x in own[0].low)
        out[n] = (np.array([r.block for r in own], np.int64), *(np.array([x[:width] for x in xs], float).reshape(len(own), width) for xs in ([r.low for r in own], [r.high for r in own])), np.array([r.norm for r in own], float))
    return out


def _pairs(queries: DataFrame, blocks: dict, done: int, upto: int, parts: dict | None) -> DataFrame:
    """The blocks of rank ``done`` to ``upto`` of each query by bound, but those below its k-th score; ``parts``: into how many a block's queries are dealt, None if the vectors are not needed."""
    sent = queries.sparkSession.sparkContext.broadcast((blocks, parts))  # at most SUMMARIES blocks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, parts = sent.value
        for batch in batches:
            for n, group in batch.groupby("n"):
                if n not in blocks:
                    continue
                names, low, high, norms = blocks[n]
                for k in range(0, len(group), 64):
                    some = group.iloc[k : k + 64]
                    d = _stacked(some.d)
                    with np.errstate(over="ignore", invalid="ignore"):
                        own = (_stacked(some.v) ** 2).sum(1)
                        far = np.zeros((len(some), len(names)))
                        for p in range(low.shape[1]):
                            far = np.fmax(far, np.nan_to_num(np.maximum(d[:, p, None] - high[None, :, p], low[None, :, p] - d[:, p, None]), nan=0.0, posinf=0.0))
                    bound = _score_bound(far, own[:, None] + norms[None, :])
                    bound[names[None, :] == some.block.to_numpy()[:, None]] = -np.inf  # met already
                    at = np.argsort(-bound, axis=1, kind="stable")[:, done:upto]
                    reached = np.take_along_axis(bound, at, 1)
                    keep = (reached > -np.inf) & (reached >= some.kth.fillna(-np.inf).to_numpy(float)[:, None])
                    who, col = np.nonzero(keep)
                    chosen = names[at[who, col]]
                    rows = some.iloc[who]
                    made = pd.DataFrame({"n": rows.n.to_numpy(), "block": chosen, "y": 0, "id": rows.id.to_numpy(), "v": None, "d": None, "kth": rows.kth.to_numpy()})
                    if parts is not None:
                        made["y"] = rows.row.to_numpy() % np.array([parts[n, b] for b in chosen.tolist()] or [1][: len(chosen)], np.int64)
                        made["v"], made["d"] = rows.v.to_numpy(), rows.d.to_numpy()
                    yield made

    return queries.select("n", "block", "row", "id", "v", "d", "kth").mapInPandas(run, "n int, block long, y int, id long, v array<double>, d array<double>, kth double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("double"), F.desc("score"), "vec_id")
    return found.where("query_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = K, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each row for which ``is_query(id)`` holds.

    ``report`` gets how many blocks and (query, block) pairs there are, and how
    many pairs and candidates were looked at.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col)
    sizes = {r.n: r["count"] for r in rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(LENGTHS).collect()}
    chosen = {n: choose_pivots(rows.where(F.col("n") == n), pivots) for n in sizes}
    widest, most = max((len(p) for p in chosen.values()), default=0), max(sizes.values(), default=0)
    depth = max([1, *(x for x in range(2, 5) if math.perm(widest, x) <= most / (BLOCK / 4))])
    cells = written(with_pivot_table(rows, chosen, depth), "pivot_table")
    parts = cells.groupBy("n", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    table = cells.join(parts, ["n", "cell"]).select("id", "n", "v", "row", "d", F.xxhash64("n", "cell", part).alias("block"))
    asked = written(table.where(is_query(F.col("id"))), "queries")
    candidates = lambda t: t.select("n", "block", "y", "id", "v", "d")
    looked = {"pairs": 0, "evaluated": 0}

    def count(found: DataFrame) -> None:
        x = found.where("query_id is null").agg(F.sum("vec_id").alias("pairs"), F.sum("score").alias("evaluated")).first()
        for name in looked:
            looked[name] += x[name] or 0

    first = asked.select("n", "block", F.lit(0).alias("y"), "id", "v", "d", F.lit(None).cast("double").alias("kth"))
    found = written(_met(candidates(table.withColumn("y", F.lit(0))), first, k), "found")
    count(found)
    best = written(_best(found, k), "best")
    release(found)
    blocks = written(_summaries(table, widest), "blocks")
    n_blocks = blocks.count()
    turns = -(-n_blocks // SUMMARIES)
    for turn in range(turns):
        of = _loaded(blocks.where(F.pmod(F.xxhash64("n", "block"), F.lit(turns)) == turn).collect())  # SUMMARIES rows, about
        done, step = 0, FIRST
        while done < max((len(b[0]) for b in of.values()), default=0):
            kth = best.groupBy("query_id").agg(F.count("*").alias("held"), F.min("double").alias("kth")).where(F.col("held") == k).select(F.col("query_id").alias("id"), "kth")
            active = asked.join(kth, "id", "left")
            wanted = {(r.n, r.block): -(-r["count"] // BLOCK) for r in _pairs(active, of, done, done + step, None).groupBy("n", "block").count().collect()}  # as many at most
            if not wanted:
                break
            to = F.broadcast(spark.createDataFrame([(n, b, x) for (n, b), x in wanted.items()], "n int, block long, parts int"))
            met = table.join(to, ["n", "block"]).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            found = written(_met(candidates(met), _pairs(active, of, done, done + step, wanted), k), "found")
            count(found)
            before, best = best, written(_best(best.drop("rank").unionByName(found), k), "best")
            release(found, before)
            done, step = done + step, step * GROWTH
    if report is not None:
        report |= looked | {"blocks": n_blocks, "all_pairs": sum(r.queries * r.blocks for r in asked.groupBy("n").agg(F.count("*").alias("queries")).join(blocks.groupBy("n").agg(F.count("*").alias("blocks")), "n").collect())}
    return best.select("query_id", "rank", "vec_id", "score")
