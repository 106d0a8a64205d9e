"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

A piece is placed by its length alone, so all pieces of one length are placed
together: the plan needs only the count of each length, at most ``capacity``
numbers whatever the size of the corpus. Open sequences are kept by what they
have left; a segment tree over the remaining capacities finds the tightest one
that takes a length in logarithmic time. Sequences that share a history stay
one range. A step takes a range to less than the length placed, hence to less
than half of what it had left, and splits off at most two ranges, so the plan
has at most ``36 * capacity`` steps and is broadcast. Each piece then finds its
place from its rank among the pieces of its length; ranks come from counts of
(length, salt), never from one ordered list.

Defined results: null text is the empty text, one piece that holds the end id
only; repeated rows are packed as often as they occur; an empty table gives an
empty table; ``pack_documents`` ignores other columns, ``pack`` returns them
whatever their names and replaces ``sequence_id`` and ``offset``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

CAPACITY, END_ID = 4096, 1
CACHED_WORDS = 400_000  # words whose ids a worker keeps; fewer take less memory and more time
#: White space to some and text to other tools: such texts are not cut by us.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Where lower case depends on more than the letter itself, it is left to the tokenizer.
_BEYOND_LATIN = re.compile("[\u0130\u0250-\U0010ffff]")


def cuts_at_space(tokenizer: str) -> bool:
    """Whether a tokenizer (its JSON) lowers case and drops white space without joining anything across it."""
    import regex

    spec = json.loads(tokenizer)
    norm, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    norms, cuts = norm.get("normalizers", [norm]), cut.get("pretokenizers", [cut])
    plain = all(n.get("type") in ("NFC", "Lowercase") or n.get("type") == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norms)
    if not plain or not any(n.get("type") == "Lowercase" for n in norms) or spec.get("truncation") or spec.get("padding"):
        return False
    first = cuts[0]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or "Regex" not in first.get("pattern", {}):
        return False
    # the words must be what the pattern finds, and nothing that it finds may hold white space
    probe = "".join(f"a{x}{y}b1" for x in " \t\n\r\v\f\x85\xa0\u2028\u3000" for y in (" ", "'s", "!", "é", "\u0301", "_", ""))
    return not any(any(c.isspace() for c in m[0]) for m in regex.finditer(first["pattern"]["Regex"], probe)) and all(c.get("type") == "ByteLevel" and not c.get("add_prefix_space") for c in cuts[1:])


class WordIds(dict):
    """Little-endian ids of white-space-separated words.

    Up to ``limit`` words are kept, and as many of the generation before them,
    from which words in use come back; so memory is bounded and common words stay.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.old = Tokenizer.from_file(path), limit, {}
        self.by_word = cuts_at_space(self.tokenizer.to_str())

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        self[word] = found = self.whole(word) if found is None else found
        return found

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, word by word if the tokenizer lowers case, drops white space and joins nothing across it."""
        if not self.by_word or any(x in text for x in _ODD):
            return self.whole(text)
        if text.isascii() or not _BEYOND_LATIN.search(text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


@cache
def word_ids(path: str, limit: int) -> WordIds:
    return WordIds(path, limit)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and the end id, cut only if longer than ``capacity``."""
    step, end = 4 * capacity, np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path, cached_words)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.ids(text.as_py() or "") + end
                rows += [(key, k // step, k // 4, min(step, len(ids) - k) // 4, zlib.crc32(ids[k : k + step])) for k in range(0, len(ids), step)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_col, "piece", "start", "length", "ids_crc32"])
        pa.default_memory_pool().release_unused()  # the worker lives on for later stages

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long")


class Capacities:
    """Ranges of open sequences by remaining capacity, under a segment tree of how many there are."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.base)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, first: int, n: int) -> None:
        if n:
            self.ranges[left].append((first, n))
            self._count(left, 1)

    def pop(self, left: int) -> tuple[int, int]:
        self._count(left, -1)
        return self.ranges[left].pop()

    def _count(self, left: int, by: int) -> None:
        at = self.base + left
        while at:
            self.tree[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that an open sequence has."""
        at = self.base + need
        if self.tree[at]:
            return need
        while at > 1 and (at & 1 or not self.tree[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.base:
            at = 2 * at + (not self.tree[2 * at])
        return at - self.base


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, pieces per sequence, first sequence, offset) for ``counts`` of lengths."""
    open_, steps, fresh = Capacities(capacity), [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = open_.tightest(length)
            if left is None:
                left, per = capacity, capacity // length
                first, n = fresh, -(-todo // per)
                fresh += n
            else:
                per = left // length
                first, n = open_.pop(left)
            use = min(n, -(-todo // per))
            placed = min(todo, use * per)
            steps.append((length, rank, per, first, capacity - left))
            full, part = divmod(placed, per)
            open_.add(left, first + use, n - use)
            open_.add(left - per * length, first, full)
            open_.add(left - part * length, first + full, 1 if part else 0)
            rank, todo = rank + placed, todo - placed
    return steps


def pack(rows: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Place each row by its ``length``: adds sequence_id and offset. ``rows`` must be stored, it is read three times.

    A row travels as one struct, so no column of it meets those of the plan.
    """
    spark = rows.sparkSession
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("sequence_id", "offset"))).alias("whole")
    counts = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    steps = spark.createDataFrame(best_fit_plan(counts, capacity) or [(0, 0, 1, 0, 0)], "length long, rank long, per long, first long, base long")
    plan = steps.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "per", "first", "base"))).alias("steps"))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.select(whole, "length", F.pmod(F.xxhash64(F.col(f"`{id_col}`"), "piece"), F.lit(salts)).alias("salt"))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.col(f"whole.`{id_col}`"), "whole.piece")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at") - 1)
    placed = ranked.join(F.broadcast(plan), "length").withColumn("step", F.expr("element_at(filter(steps, s -> s.rank <= rank), -1)"))
    turn = F.col("rank") - F.col("step.rank")
    return placed.select("whole.*", (F.col("step.first") + F.floor(turn / F.col("step.per"))).cast("long").alias("sequence_id"), (F.col("step.base") + (turn % F.col("step.per")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """Tokenise, cut and pack whole documents: one row per piece with its place."""
    return pack(written(pieces(docs, tokenizer_path, capacity, id_col, text_col, cached_words), "pieces"), capacity, id_col)
