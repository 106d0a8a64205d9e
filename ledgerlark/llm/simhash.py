"""Near-duplicates: SimHash fingerprints linked through Golay-code keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Of at most
four differing bits, either two segments hold at most one each, or the errors
are 0, 2 and 2. For the first case each pair of segments gives keys in which
one side carries the index of its own codeword in the first segment and those
of the one-bit neighbourhood in the second, and the other side the reverse. For
the second case the bits of one segment stand for themselves beside the
neighbourhood indices of the next. So any link shares a key, and keys of 24 and
more bits keep chance meetings rare. Candidates are verified on all 64 bits.

Equal fingerprints are one node. Links through an equal segment to the smallest
fingerprint that has it come first, and the join on Golay keys then only yields
pairs that these have not joined: a dense group is not listed pair by pair.

Defined results: null or wordless text has fingerprint zero and is linked like
any other; rows that share a doc_id share a node only if their fingerprints
agree or link; a null doc_id stays null and never names a component unless
alone; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .batches import free_name
from .components import components
from .store import written

BITS, SEED = 4, 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, width)


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the word shingles of a text, unsigned."""
    cut = (text or "").encode("utf-8").lower().split()
    if not cut:
        return 0
    line = b" ".join(cut)
    ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(cut) - words + 1)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends[-n:].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 255):
        ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, fp): the fingerprint of each whole text as a signed long; ``keep`` names long columns to carry along."""
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in batch.column(len(names))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(made, pa.int64())], names=[*names, "fp"])

    rows = docs.select(*(F.col(f"`{c}`").cast("long").alias(c) for c in names), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` long" for c in [*names, "fp"]))


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    shift, width = SEGMENTS[k]
    return (fp.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the stored side, keys of the probing side), -1 where a key repeats; rows x keys."""
    segs = [_segment(fps, k) for k in range(3)]
    own, near = zip(*(golay.near_indices(s) for s in segs))
    stored, probing = [], []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        stored.append(np.where(near[j] >= 0, tag << 40 | own[i][:, None] << 12 | near[j], -1))
        probing.append(np.where(near[i] >= 0, tag << 40 | near[i] << 12 | own[j][:, None], -1))
    for i in range(3):
        j = (i + 1) % 3
        same = np.where(near[j] >= 0, (3 + i) << 40 | segs[i][:, None] << 12 | near[j], -1)
        stored.append(same)
        probing.append(same)
    return np.hstack(stored), np.hstack(probing)


def _key_rows(nodes: DataFrame) -> DataFrame:
    """(fp, stored, probing): the keys of each fingerprint as two arrays."""

    def lists(keys: np.ndarray) -> pa.Array:
        held = keys >= 0
        ends = np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[held], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stored, probing = golay_keys(batch.column(0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(stored), lists(probing)], names=["fp", "group", "stored", "probing"])

    return nodes.select("fp", "group").mapInArrow(run, "fp long, group long, stored array<long>, probing array<long>")


def _distance(x: str, y: str):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def _star_links(nodes: DataFrame, bits: int) -> DataFrame:
    """Each fingerprint with the smallest one that has an equal segment, if near enough."""
    segment = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("v")) for k, (s, w) in enumerate(SEGMENTS))))
    parts = nodes.select("fp", segment.alias("s")).select("fp", "s.k", "s.v")
    least = parts.groupBy("k", "v").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    return parts.join(least, ["k", "v"]).where((F.col("fp") != F.col("low")) & (_distance("fp", "low") <= bits)).select(F.col("fp").alias("a"), F.col("low").alias("b"))


def link_fingerprints(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, group): connected classes of distinct fingerprints at ``bits`` or fewer differing bits."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"the keys guarantee links of at most {BITS} differing bits")
    named = lambda links: nodes.join(links, nodes.fp == links.node, "left").select("fp", F.coalesce("component", "fp").alias("group"))
    first = written(named(components(_star_links(nodes, bits))), "stars")
    keys = written(_key_rows(first), "keys")  # read by both sides of the join below
    stored = keys.select(F.explode("stored").alias("key"), "fp", "group")
    probing = keys.select(F.explode("probing").alias("key"), F.col("fp").alias("fp2"), F.col("group").alias("group2"))
    meet = (stored.key == probing.key) & (F.col("fp") < F.col("fp2")) & (F.col("group") != F.col("group2")) & (_distance("fp", "fp2") <= bits)
    more = components(stored.join(probing, meet).select(F.col("group").alias("a"), F.col("group2").alias("b")))
    return first.join(more, first.group == more.node, "left").select("fp", F.coalesce("component", "group").alias("group"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one of the smallest id, null ids last.

    Rows are told apart by themselves and not by their id: rows that share an
    id, or have none, are documents of their own. Among rows of one id that
    with the smallest hash of its columns stays, so reruns agree; only equal
    rows are beyond that, and which of them stays makes no difference.
    """
    row = free_name("near_duplicates_row", docs.columns)
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map" not in kind and "variant" not in kind]
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keys = numbered.select(F.col(f"`{row}`").alias("row"), F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(*hashed).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints = written(fingerprints(keys, "row", "text", words, ("i", "h")), "fingerprints")
    order = F.struct(F.col("i").isNull().alias("unnamed"), "i", "h", "row")
    nodes = written(prints.groupBy("fp").agg(F.min(order).alias("best")), "nodes")
    best = link_fingerprints(nodes.select("fp"), bits).join(nodes, "fp").groupBy("group").agg(F.min("best").alias("best"))
    return numbered.join(best.select(F.col("best.row").alias(row)), row, "left_semi").drop(row)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = BITS) -> DataFrame:
    """(id, fingerprint, component_id): the component is the smallest id reachable over links."""
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("low")), "nodes")
    groups = written(link_fingerprints(nodes, bits).join(nodes, "fp"), "groups")
    least = groups.groupBy("group").agg(F.min("low").alias("component_id"))
    named = groups.join(least, "group").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
