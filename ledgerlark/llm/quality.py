"""Quality rules: how far a text's histograms lie from those of its language.

Each language has two references, counted over all its documents: the shares of
six character classes, and the shares of its common words (those that make up
at least one word in ``RAREST``) with one more share for all other words. A text
fails where the Jensen-Shannon distance to a reference is too large. Two guards
keep short texts in: below a least length a histogram is not judged at all, and
the limit on words is widened by the divergence that chance alone gives a text
of that many words. A language of too few words has no reference and its texts
are judged by the base rules alone.

Common words are found exactly with bounded memory. A part of the corpus reports
the words that have half the needed share there; a word that has the needed
share of all must reach half of it in the reported counts, so at most
``2 * RAREST`` words of a language are left to be counted in a second pass.

Defined results: null text has no words and fails the base rules; a null label is
the empty label; whole texts are read; repeated rows give repeated results and
count as often in the references; an empty table gives an empty table; columns
besides id, text and label are ignored; ids must be integers or null.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes
from .store import written

RAREST = 1000  # a common word is at least one in so many words of its language
CLASS_LIMIT, WORD_LIMIT = 0.25, 0.33
LEAST_CHARS, LEAST_WORDS, LEAST_REFERENCE = 200, 50, 5000
LANGUAGES_AT_ONCE = 512  # languages whose references are sent to the tasks together
DISTINCT_AT_ONCE = 200_000
# White space and symbols of the base rules.
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
CLASSES = ("letter", "capital", "number", "space", "punctuation", "other")


@lru_cache(1)
def _class_table() -> np.ndarray:
    """Class of every code point."""
    of = {"Lu": 1, "Lt": 1, "L": 0, "M": 0, "N": 2, "P": 4}
    kinds = map(unicodedata.category, map(chr, range(0x110000)))
    table = np.fromiter((of.get(k, of.get(k[0], 5)) for k in kinds), np.uint8, 0x110000)
    table[list(SPACE)] = 3
    return table


def class_counts(text: str) -> np.ndarray:
    """Number of code points of each class, in parts of a million."""
    found = np.zeros(len(CLASSES), np.int64)
    for at in range(0, len(text), 1_000_000):
        points = np.frombuffer(text[at : at + 1_000_000].encode("utf-32-le", "surrogatepass"), np.uint32)
        found += np.bincount(_class_table()[points], minlength=len(CLASSES))
    return found


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    if len(words) < 4:
        return 0
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(place) + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * len(place) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= again
    return int(inside.sum())


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, lines equal to an earlier one, words in repeated windows)."""
    lines = [line for line in data.split(b"\n") if line.strip(SPACE)]
    chars = len(text) - sum(data.count(c) for c in SPACE)
    return len(words), chars, sum(data.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, in bits: 0 for equal shares, 1 for disjoint ones."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return math.sqrt(max(0.0, d / 2))


def word_limit(n_words: int, bins: int, limit: float = WORD_LIMIT) -> float:
    """Largest distance of words that stands: ``limit``, and what chance gives ``n_words`` drawn from ``bins`` bins."""
    return math.sqrt(limit * limit + (bins - 1) / (8 * n_words * math.log(2)))


def _label(label_col: str) -> Column:
    return F.coalesce(F.col(f"`{label_col}`").cast("string"), F.lit(""))


def _labelled(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), _label(label_col).alias("lang"))


def _candidates(rows: DataFrame, rarest: int) -> DataFrame:
    """(lang, word): all words that can be common, at most ``2 * rarest`` of a language; and word null with the words and classes of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = []
            for lang, seen in words.items():
                total = seen.total()
                out += [(lang, w.decode("utf-8"), n, None) for w, n in seen.items() if n * 2 * rarest >= total]
                out.append((lang, None, total, classes[lang].tolist()))
            words.clear()
            classes.clear()
            cols = list(zip(*out)) if out else [[]] * 4
            kinds = pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "word", "n", "classes"])

        for batch in batches:
            for part in by_bytes(batch, 1, 2000):
                for text, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if not text:
                        continue
                    words.setdefault(lang, Counter()).update(text.encode("utf-8").lower().split())
                    classes[lang] = classes.get(lang, 0) + class_counts(text)
                if sum(map(len, words.values())) > DISTINCT_AT_ONCE:
                    yield flush()
        yield flush()

    found = rows.mapInArrow(count, "lang string, word string, n long, classes array<long>")
    sums = [F.coalesce(F.sum(F.col("classes")[k]), F.lit(0)).alias(f"class{k}") for k in range(len(CLASSES))]
    reported = written(found.groupBy("lang", "word").agg(F.sum("n").alias("n"), *sums), "reported")
    totals = reported.where("word is null").select("lang", F.col("n").alias("total"), F.array(*(f"class{k}" for k in range(len(CLASSES)))).alias("classes"))
    some = reported.where("word is not null").join(totals.select("lang", "total"), "lang").where(F.col("n") * 2 * rarest >= F.col("total"))
    return totals.join(some.groupBy("lang").agg(F.collect_list("word").alias("words")), "lang", "left")


def _parts(table: DataFrame, at_once: int) -> Iterator[tuple[Column, list]]:
    """Rows of a table of languages, so many at once, each with the condition on the documents that they stand for."""
    groups = max(1, -(-table.count() // at_once))
    for g in range(groups):
        here = F.pmod(F.xxhash64("lang"), F.lit(groups)) == g if groups > 1 else F.lit(True)
        yield here, table.where(here).collect()  # some ``at_once`` languages of at most 2 * RAREST words


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rarest: int = RAREST, least: int = LEAST_REFERENCE, at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """One row per language of at least ``least`` words: total, classes, words and counts of its common words."""
    rows = _labelled(docs, id_col, text_col, label_col)
    wanted = written(_candidates(rows, rarest).where(F.col("total") >= least), "candidates")
    counted = None
    for here, langs in _parts(wanted, at_once):
        sent = docs.sparkSession.sparkContext.broadcast({r.lang: {w.encode("utf-8"): k for k, w in enumerate(r.words or [])} for r in langs})

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seen = {lang: np.zeros(len(words) + 1, np.int64) for lang, words in sent.value.items()}
            for batch in batches:
                for part in by_bytes(batch, 1, 2000):
                    for text, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                        if text and lang in seen:
                            seen[lang] += _histogram(text.encode("utf-8").lower().split(), sent.value[lang])
            out = [(lang, w.decode("utf-8"), int(seen[lang][k])) for lang, words in sent.value.items() for w, k in words.items() if seen[lang][k]]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        part = rows.where(here).mapInArrow(count, "lang string, word string, n long")
        counted = part if counted is None else counted.unionByName(part)
    exact = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).join(wanted.select("lang", "total"), "lang").where(F.col("n") * rarest >= F.col("total"))
    common = exact.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("common"))
    return written(wanted.select("lang", "total", "classes").join(common, "lang", "left"), "references")


def _histogram(words: list[bytes], place: dict[bytes, int]) -> np.ndarray:
    return np.bincount(np.fromiter(map(place.get, words, repeat(len(place))), np.int64, len(words)), minlength=len(place) + 1)


def judge(docs: DataFrame, refs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", class_limit: float = CLASS_LIMIT, limit: float = WORD_LIMIT, at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """Counts of the base rules, whether they fail, both distances (null where not judged) and whether the text is kept."""
    refs = references(docs, id_col, text_col, label_col) if refs is None else refs
    rows = _labelled(docs, id_col, text_col, label_col)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = [id_col, *longs, "base_failed", "kept", "class_distance", "word_distance"]
    schema = f"`{id_col}` long, {', '.join(f'{c} long' for c in longs)}, base_failed boolean, kept boolean, class_distance double, word_distance double"
    judged = None
    for here, langs in _parts(refs, at_once):
        model = {}
        for r in langs:
            common = r.common or []
            counts = np.array([*(x.n for x in common), r.total - sum(x.n for x in common)], float)
            model[r.lang] = ({x.word.encode("utf-8"): k for k, x in enumerate(common)}, counts, np.array(r.classes, float))
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch, 1, 2000):
                    out = [_verdict(t or "", sent.value.get(lang), class_limit, limit) for t, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                    cols = list(zip(*out))
                    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

        part = rows.where(here).mapInArrow(run, schema)
        judged = part if judged is None else judged.unionByName(part)
    return judged


def _verdict(text: str, ref, class_limit: float, limit: float) -> tuple:
    data = text.encode("utf-8")
    words = data.split()
    counts = base_counts(text, data, words)
    failed = base_fails(counts[0], counts[4])
    of_class = of_word = None
    kept = not failed
    if ref is not None:
        place, common, classes = ref
        if len(text) >= LEAST_CHARS and classes.sum():
            of_class = distance(class_counts(text), classes)
            kept = kept and of_class <= class_limit
        if len(words) >= LEAST_WORDS:
            of_word = distance(_histogram(data.lower().split(), place), common)
            kept = kept and of_word <= word_limit(len(words), len(common), limit)
    return *counts, failed, kept, of_class, of_word
