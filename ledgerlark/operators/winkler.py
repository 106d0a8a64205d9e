"""Exact Jaro-Winkler similarity join: pairs come from signatures that similar texts must share.

Two texts of similarity ``t`` with k letters of prefix in common (four at most)
have a Jaro value of at least j = (t - k / 10) / (1 - k / 10). With n and l
characters they then match m = (3 j - 1) / (1 / n + 1 / l) or more, occurrences
counted, k of them in the prefix, which is always matched with itself. So, with
the characters after the prefix in one order, rarest first, the first
n - m + s of one text and l - m + s of the other have s in common. A key is
made of k, the prefix, both lengths and s of these characters, for each k from
none to four and each length that a text may be similar to. Where a longer
prefix asks for no fewer matches, the keys of the shorter one do for both.
Texts that meet in no key are not similar.

A text is dealt once for each two characters that its keys begin with; the task
that gets it meets the keys and compares the texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.operators.similarity import _classes, _key_tasks, _met_where_dealt, _spread, jaro_winkler
from ledgerlark.sources.store import written


def least_jaro(threshold: float, prefix: int) -> float:
    return (threshold - prefix / 10) / (1 - prefix / 10)


# Parameters: lengths up to the first are told apart one by one, longer ones by bands of a tenth; about as many keys for one k and one length, of so many characters at most.
EXACT_LENGTHS, KEYS_A_LENGTH, MOST_CHARACTERS = 24, 40, 16


# A key is for texts of a text's own band, for longer or for shorter ones.
SAME, SHORTER, LONGER = 0, 1, 2


def band(n: int) -> tuple[int, int]:
    """(least, greatest) length of the texts that a text of ``n`` characters is told together with."""
    low = high = max(n, 0)
    if n > EXACT_LENGTHS:
        low = EXACT_LENGTHS + 1
        while (high := low + low // 10) < n:
            low = high + 1
    return low, high


def least_matched(jaro: float, n: int, other: int) -> int:
    """How many characters texts of these lengths must match for a Jaro value of ``jaro``."""
    return max(1, math.ceil((3 * jaro - 1) * n * other / (n + other) - 1e-9))


@lru_cache(10_000)
def characters_a_key(low: tuple[int, int], high: tuple[int, int], jaro: float, prefix: int) -> int:
    """How many characters make a key of texts of two bands: more where fewer may differ, so that keys stay few and tell much."""
    common = least_matched(jaro, *low) - prefix
    apart = max(high) - prefix - common
    return max((s for s in range(1, min(common, MOST_CHARACTERS) + 1) if s == 1 or math.comb(apart + s, s) <= KEYS_A_LENGTH), default=0)


@lru_cache(10_000)
def _levels(n: int, other: tuple[int, int], threshold: float) -> list[tuple[int, int, int]]:
    """(prefix, matched, until): the prefixes with keys of their own for texts of the band ``other``, what must match, and from which prefix on other keys do (0: none).

    Lengths told apart one by one ask both texts for as much, so a longer
    prefix has keys of its own only where fewer characters need to match.
    """
    found: list[tuple[int, int]] = []
    exact = other[0] == other[1] and len(set(band(n))) == 1
    for k in range(min(4, n) + 1):
        matched = least_matched(least_jaro(threshold, k), n, other[0])
        # the most that such texts can match is the shorter one
        if other[1] >= k and matched <= min(n, other[1]) and not (exact and found and found[-1][1] == matched):
            found.append((k, matched))
    return [(k, matched, found[i + 1][0] if exact and i + 1 < len(found) else 0) for i, (k, matched) in enumerate(found)]


def _marks(text: str, rank: dict[str, int]) -> list[str]:
    """The characters of a text with their number, rarest first."""
    seen: dict[str, int] = {}
    marks = []
    for c in text:
        seen[c] = seen.get(c, 0) + 1
        marks.append((rank.get(c, -1), f"{c}{seen[c]}"))
    return [m for _, m in sorted(marks)]


def _signatures(text: str, threshold: float, rank: dict[str, int], bands: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int, int, str, list[str], int]]:
    """(role, until, matched, head, marks, size): a key is the head and ``size`` of the marks."""
    n, own = len(text), band(len(text))
    marks = [_marks(text[k:], rank) for k in range(min(4, n) + 1)]
    for other in bands:
        short, long = sorted((own, other))
        for k, matched, until in _levels(n, other, threshold):
            s = characters_a_key((short[0], long[0]), (short[1], long[1]), least_jaro(threshold, k), k)
            common = max(matched - k, s)
            role = SAME if own == other else SHORTER if own < other else LONGER
            yield role, until, matched, f"{k}|{short[0]}|{long[0]}|{text[:k]}", marks[k][: n - k - common + s], s


def keys_of(text: str, threshold: float, rank: dict[str, int], bands: Sequence[tuple[int, int]]) -> list[int]:
    """Signatures of a text, the last two bits for whom it meets; ``rank``: place of each character in the order of rarity, ``bands``: of the lengths that there are."""
    signed = _signatures(text, threshold, rank, bands)
    return sorted({(xxhash.xxh64_intdigest("|".join((head, *some))) >> 3 << 2) + role for role, _, _, head, marks, s in signed for some in itertools.combinations(marks, s)})


def starts_of(text: str, threshold: float, rank: dict[str, int], bands: Sequence[tuple[int, int]]) -> list[tuple[int, int, int, list[int]]]:
    """(start, until, matched, keys): the keys of a text by the head and the two marks that they begin with."""
    out = []
    for _, until, matched, head, marks, s in _signatures(text, threshold, rank, bands):
        rest: dict[tuple[str, ...], list[int]] = {}
        for some in itertools.combinations(marks, s):
            rest.setdefault(some[:2], []).append(xxhash.xxh32_intdigest("|".join(some[2:])) >> 1)
        out += [(xxhash.xxh64_intdigest("|".join((head, *first))) >> 1, until, matched, keys) for first, keys in rest.items()]
    return out


def _bits(text: str) -> int:
    """A word in which each character of a text, with its number, turns a bit: two texts differ in no more bits than characters."""
    word = 0
    for m in _marks(text, {}):
        word ^= 1 << (xxhash.xxh64_intdigest(m) & 63)
    return word - (word >> 63 << 64)


# A parameter: so many texts are one batch while their keys are made.
TEXTS_AT_ONCE = 1000


def jaro_winkler_join(rows: DataFrame, threshold: float, id_col: str = "id", text: str = "name", copies: bool = True) -> DataFrame:
    """Pairs of Jaro-Winkler similarity ``threshold`` and more: (id_a, id_b, similarity). Ids name rows; null and empty texts pair with nothing.

    Equal texts are one row first; ``copies`` as in ``trigram_join``. A text has
    some 40 keys for a prefix and a length near its own, whatever the number of
    rows. Keys are never broadcast: there are many of them to a text, which a
    plan does not see. A pair is met by the longest prefix that has keys and
    compared in the tasks that meet it, so only similar pairs are dealt again.
    """
    if not 0.75 <= threshold <= 1:
        raise ValueError("a threshold of 0.75 to 1: below, a prefix in common does not raise every value")
    spark = rows.sparkSession
    one, members = _classes(rows.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where("t <> ''"), ["t"])
    sizes = members.groupBy(F.col("rep").alias("id")).agg((F.count("*") == 1).alias("alone"))
    one = written(one.join(sizes, "id").select("id", "t", "alone"), "texts")
    letters = one.select(F.explode(F.split("t", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()  # as many rows as there are characters
    order = {r.c: k for k, r in enumerate(sorted(letters, key=lambda r: (r.n, r.c)))}
    bands = sorted({band(r.n) for r in one.select(F.length("t").alias("n")).distinct().collect()})  # as many rows as there are lengths
    sent = spark.sparkContext.broadcast((order, bands))
    wide = one.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")  # few bytes make many keys, so tasks are not cut by bytes
    tasks = _key_tasks(one)
    kind = T.StructType([*one.schema, *T.StructType.fromDDL("bits long, start long, until int, matched int, keys array<int>")])

    def dealt(role: int) -> DataFrame:
        meets = {SAME: lambda own, b: b == own, SHORTER: lambda own, b: b > own, LONGER: lambda own, b: b < own}[role]

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rank, known = sent.value
            for batch in batches:
                for at in range(0, len(batch), TEXTS_AT_ONCE):
                    some = batch.iloc[at : at + TEXTS_AT_ONCE]
                    each = [starts_of(t, threshold, rank, [b for b in known if meets(band(len(t)), b)]) for t in some["t"]]
                    found = [x for starts in each for x in starts]
                    if found:
                        told = some.assign(bits=[_bits(t) for t in some["t"]]).iloc[np.repeat(np.arange(len(some)), [len(x) for x in each])]
                        yield told.assign(**dict(zip(("start", "until", "matched", "keys"), zip(*found))))

        return wide.mapInPandas(made, kind).repartition(tasks, "start")

    def met(a: DataFrame, b: DataFrame, order) -> DataFrame:
        side = lambda rows, s: rows.select(F.explode("keys").alias("key"), "start", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "t", "alone", "bits", "until", "matched")))
        most = F.length("t_a") + F.length("t_b") - 2 * F.greatest("matched_a", "matched_b")
        until = F.greatest("until_a", "until_b")
        by_other = (until > 0) & (F.left("t_a", until) == F.left("t_b", until))
        close = order & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= most) & ~by_other
        return side(a, "a").hint("merge").join(side(b, "b"), ["key", "start"]).where(close).select("start", "id_a", "id_b", "t_a", "t_b", (F.col("alone_a") & F.col("alone_b")).alias("alone")).distinct()

    same = dealt(SAME)
    pairs = met(same, same, F.col("id_a") < F.col("id_b")).unionByName(met(dealt(SHORTER), dealt(LONGER), F.lit(True)))
    value = F.pandas_udf(jaro_winkler.func, T.DoubleType()).asNondeterministic()  # so the plan takes it after pairs of a task are distinct, and once
    alike = pairs.withColumn("similarity", value("t_a", "t_b")).where(F.col("similarity") >= threshold - 1e-12)
    alike = alike.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "alone", "similarity").distinct()
    alike = _met_where_dealt(alike, "alike")
    plain = lambda rows: rows.select("id_a", "id_b", "similarity")
    if not copies:
        return _spread(plain(alike), members, False, similarity=F.lit(1.0))
    return plain(alike.where("alone")).unionByName(_spread(plain(alike.where("not alone")), members, True, similarity=F.lit(1.0)))
