"""Languages of multilingual texts: mixture inference by expectation-maximisation.

Each language has smoothed log-likelihoods of hashed byte n-grams, counted over
a bounded sample of labelled documents. A text is a bag of words; a word's
likelihood under a language is the product of those of its n-grams.
Expectation-maximisation estimates the share of each language in a text, and
the set of languages is the one with the highest likelihood less a charge for
each language beyond the first. All texts of a batch are treated at once.

Of many labels the most frequent ``LANGUAGES`` are one model and the next as
many another, so a task holds one model of bounded size. Texts are read once a
model and keep what the model says under which their best language is likelier;
a mixture is of languages of one model.

Defined results: null text, or text without a letter, is ``und`` with score 0;
ties go to the language that sorts first; repeated rows give repeated results;
with nothing to learn from every text is ``und``; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import by_bytes, free_name
from .store import written

SAMPLE = 1500  # labelled documents of each language to learn from, about
LANGUAGES = 256  # languages of one model: the counts and the model take some 1.2 MB each in a worker
BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
ROUNDS, AT_ONCE = 8, 2_000_000
UNKNOWN = "und"
#: Everything that is no letter parts words: ASCII letters and all bytes of other characters stay.
_WORDS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased bytes of all texts, each after two spaces; the text of each byte)."""
    raw = [b"  " + t.lower().encode("utf-8").translate(_WORDS) for t in texts]
    data = np.frombuffer(b"".join(raw) + b"  ", np.uint8)
    return data, np.repeat(np.arange(len(raw)), [len(r) for r in raw])


def _counts(data: np.ndarray) -> np.ndarray:
    """Where n-grams count: those that start in a word or at the space before one."""
    return (data[:-2] != 32) | (data[1:-1] != 32)


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, for each order."""
    x = data.astype(np.uint32)
    found = []
    for n in ORDERS:
        h = np.full(len(x), n * 40503, np.uint32)
        for k in range(n):
            h[: len(x) - k] = h[: len(x) - k] * np.uint32(2654435761) + x[k:] + np.uint32(1)
        found.append(((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32))
    return found


def is_held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


@dataclass
class Languages:
    names: list[str]
    scores: np.ndarray  # orders x buckets x languages
    #: models of the labels beyond these, made one after the other; None if there are none
    rest: Callable[[], Iterator[Languages]] | None = None

    def __reduce__(self):
        return Languages, (self.names, self.scores)  # tasks get this model alone

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each word in each language, the text of each word)."""
        data, owner = _bytes(texts)
        begins = np.flatnonzero((data[:-2] == 32) & (data[1:-1] != 32))
        if not len(begins):
            return np.zeros((0, len(self.names)), np.float32), np.zeros(0, int)
        per = np.zeros((len(data) - 2, len(self.names)), np.float32)
        for order, grams in zip(self.scores, _grams(data)):
            per += order[grams[:-2]]
        per[~_counts(data)] = 0
        return np.add.reduceat(per, begins, axis=0), owner[begins]


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", languages: int = LANGUAGES) -> Languages:
    """Count n-grams of about ``sample`` labelled documents of each language, chosen by hash of their id and text length.

    The model is that of the ``languages`` labels with the most documents; its
    ``rest`` makes those of the others.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not sizes:
        return Languages([], np.zeros((len(ORDERS), BUCKETS, 0), np.float32))
    ordered = list(sizes)
    parts = [{n: sizes[n] for n in ordered[k : k + languages]} for k in range(0, len(ordered), languages)]
    model, backing = _learned(rows, parts[0], sample)
    if len(parts) > 1:
        model.rest = lambda: (_learned(rows, part, sample, backing)[0] for part in parts[1:])
    return model


def _learned(rows: DataFrame, sizes: dict[str, int], sample: int, backing: np.ndarray | None = None) -> tuple[Languages, np.ndarray]:
    """Model of the labels in ``sizes`` and what it is smoothed with, the n-grams of all its languages unless given."""
    names = sorted(sizes)
    share = F.element_at(F.create_map(*(F.lit(x) for n in names for x in (n, min(1.0, sample / sizes[n])))), F.col("lang"))
    place = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(names), len(ORDERS) * BUCKETS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, _ = _bytes([text])
                for k, grams in enumerate(_grams(data)):
                    seen[place[lang], k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(grams[:-2][_counts(data)], minlength=BUCKETS)
        at, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bucket, pa.int32()), pa.array(seen[at, bucket], pa.int64())], names=["lang", "bucket", "n"])

    chosen = rows.where(share.isNotNull()).where(F.shiftrightunsigned(F.xxhash64("id", F.length("text")), 11) / float(1 << 53) < share).select("text", "lang")
    found = chosen.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    counts = np.zeros((len(names), len(ORDERS) * BUCKETS))
    counts[found.lang, found.bucket] = found.n
    counts = counts.reshape(len(names), len(ORDERS), BUCKETS)
    if backing is None:
        backing = counts.sum(0, keepdims=True) + 1.0
        backing /= backing.sum(2, keepdims=True)
    smooth = (counts + 200 * backing) / (counts.sum(2, keepdims=True) + 200)
    return Languages(names, np.ascontiguousarray((np.log(smooth) / len(ORDERS)).transpose(1, 2, 0), np.float32)), backing


def _mixture(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages in each text by EM from ``shares``, and the log-likelihood relative to each word's best."""
    for _ in range(rounds):
        g = p * np.repeat(shares, sizes, 0)
        g /= g.sum(1, keepdims=True)
        shares = np.add.reduceat(g, starts, axis=0) / sizes[:, None]
    like = np.log((p * np.repeat(shares, sizes, 0)).sum(1))
    return shares, np.add.reduceat(like, starts)


def infer(model: Languages, texts: list[str | None]) -> list[tuple[str, float, str]]:
    """(language, its share, all languages of the chosen set with their shares) of each text."""
    return [found[:3] for found in _inferred(model, texts)]


def _inferred(model: Languages, texts: list[str | None]) -> list[tuple[str, float, str, float]]:
    """The same with the log-likelihood of the text under the best single language."""
    out: list[tuple[str, float, str, float]] = [(UNKNOWN, 0.0, "", -math.inf)] * len(texts)
    keep = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.names else []
    at = 0
    while at < len(keep):
        upto, size = at, 0
        while upto < len(keep) and (upto == at or (size + len(texts[keep[upto]])) * len(model.names) <= AT_ONCE):
            size += len(texts[keep[upto]])
            upto += 1
        part = keep[at:upto]
        at = upto
        logs, owner = model.words([texts[i] for i in part])
        n = np.bincount(owner, minlength=len(part))
        some = np.flatnonzero(n)  # letters only beyond words cannot be: every letter is in a word
        if not len(some):
            continue
        sizes = n[some]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        p = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60)).astype(np.float32)
        singles = np.add.reduceat(np.log(p), starts, axis=0)
        best, value = singles.argmax(1), singles.max(1)
        likely = value + np.add.reduceat(logs.max(1).astype(float), starts)
        chosen = np.zeros((len(some), len(model.names)), np.float32)
        chosen[np.arange(len(some)), best] = 1
        full, top = _mixture(p, starts, sizes, np.full(chosen.shape, 1 / len(model.names), np.float32), ROUNDS)
        charge = 0.5 * np.log(sizes) + 1.0
        # no set can do better than all languages: only these texts may need more than one
        more = np.flatnonzero(top - charge > value)
        if len(more) and len(model.names) > 1:
            rows = np.concatenate([np.arange(starts[j], starts[j] + sizes[j]) for j in more])
            q, qsizes = p[rows], sizes[more]
            qstarts = np.concatenate([[0], np.cumsum(qsizes)[:-1]])
            ranks = (-full[more]).argsort(1, kind="stable").argsort(1)
            kept = value[more]
            for k in range(2, len(model.names) + 1):
                allowed = np.where(ranks < k, np.maximum(full[more], 1e-3), 0).astype(np.float32)
                shares, like = _mixture(q + 1e-30, qstarts, qsizes, allowed / allowed.sum(1, keepdims=True), ROUNDS)
                gain = like - (k - 1) * charge[more] > kept
                kept = np.where(gain, like - (k - 1) * charge[more], kept)
                chosen[more[gain]] = shares[gain]
        for j, i in enumerate(some):
            row = chosen[j]
            lead = int(row.argmax())
            held = [k for k in np.argsort(-row, kind="stable") if row[k] > 0]
            out[part[i]] = (model.names[lead], float(min(1.0, row[lead])), ",".join(f"{model.names[k]}:{row[k]:.3f}" for k in held), float(likely[j]))
    return out


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages) of every whole text; only the text is looked at."""
    return annotate(docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text")), model).drop("text")


OWN = (("lang_pred", pa.string(), T.StringType()), ("score", pa.float64(), T.DoubleType()), ("languages", pa.string(), T.StringType()))


def annotate(docs: DataFrame, model: Languages, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and languages, in one pass a model and without a join; columns of these names are replaced."""
    own = [name for name, _, _ in OWN]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c == text_col or c.lower() not in own))
    if model.rest is None:
        return _pass(docs, model, text_col, None, False)
    like = free_name("likelihood", docs.columns)
    out = _pass(docs, model, text_col, like, False)
    for other in model.rest():
        out = _pass(written(out, "languages"), other, text_col, like, True)
    return out.drop(like)


def _pass(docs: DataFrame, model: Languages, text_col: str, like: str | None, known: bool) -> DataFrame:
    """``docs`` with what a model says; with ``like`` also the likelihood. If ``known``, the columns are there and the likelier values stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = [*OWN, *([(like, pa.float64(), T.DoubleType())] if like else [])]
    kept = docs.columns[: -len(added)] if known else docs.columns
    names, at = [*kept, *(n for n, _, _ in added)], docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields[: len(kept)], *(T.StructField(n, kind) for n, _, kind in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, at, 500):
                found = _inferred(sent.value, part.column(at).to_pylist())
                if known:
                    before = zip(*(part.column(len(kept) + k).to_pylist() for k in range(len(added))))
                    found = [new if new[3] > old[3] else old for new, old in zip(found, before)]
                cols = list(zip(*found)) if found else [[]] * len(added)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *(pa.array(c, kind) for c, (_, kind, _) in zip(cols, added))], names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on for later stages

    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).mapInArrow(run, schema)  # a name may hold a dot


def identify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", languages: int = LANGUAGES) -> DataFrame:
    """Learn from the documents that are not held out and predict all: (id, held_out, lang_pred, score, languages)."""
    model = train(docs.where(~is_held_out(F.col(id_col))), sample, id_col, text_col, label_col, languages)
    return predict(docs, model, id_col, text_col).select(id_col, is_held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "languages")
