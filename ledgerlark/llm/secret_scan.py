"""Secrets in texts: fixed patterns, and a linear-chain CRF that finds more.

Base spans are the leftmost non-overlapping matches of three patterns. The CRF
tags each token as begin, inside or outside of a secret from its shape, its
neighbours and the kind of file, and adds the spans that touch no base span.

Defined results: null text is the empty text and has no spans; long texts are
scanned whole; repeated rows give repeated results; an empty table gives an
empty table; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_bytes
from .span_crf import Tagger, fit, labelled

KINDS = ("assign", "access", "hex")
LABELS = ["O", "B-secret", "I-secret"]
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HEXED = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))
# Word classes of the tagger.
WORDS = {
    "key": ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "key", "credential", "credentials", "passphrase", "auth", "client_secret", "access_token", "private_key", "pin"],
    "bearer": ["bearer", "basic", "authorization", "x-api-key", "signature"],
    "is": ["=", ":", ":=", "is", "->", "=>", "was"],
    "code": ["export", "set", "const", "var", "let", "env", "login", "user", "username", "host"],
}
TEMPLATES = [
    "{fill} bearer {long} {fill}", "authorization: bearer {long}", "authorization: basic {b64} {fill}", "{fill} passphrase is {mixed} {fill}", "export KEY = {long}", "{fill} client_secret = '{mixed}' {fill}",
    "{fill} credential: {mixed} {fill}", "{fill} private_key := {b64} {fill}", "const auth = \"{long}\"; {fill}", "login user {plain} pwd {mixed} {fill}", "x-api-key: {long} {fill}", "{fill} my pwd was {mixed} {fill}",
    "{fill} passphrase: {phrase} {fill}", "{fill} signature {b64} {fill}", "{fill} ghp_{long} {fill}", "{fill} sk-{long} {fill}", "set access_token => {long} {fill}",
    "{fill}", "{fill} {fill}", "{fill} {number} {fill}", "{fill} the token is used {fill}", "{fill} a secret was kept {fill}", "{fill} key points are {fill}", "{fill} {email} {fill}", "{fill} {ip} {fill}", "{fill} {phone} {fill}",
    "{fill} password reset page {fill}", "{fill} user was {plain} {fill}", "{fill} basic {plain} {fill}", "{fill} {card} {fill}", "{fill} {url} {fill}", "host = {plain} ; set env = {plain}", "{fill} key = {plain} {fill}", "{fill} {date} {fill}", "{fill} {longword} {fill}", "const {plain}_value = {call} {fill}", "let {plain} = {call}", "{fill} bearer of {plain} {fill}", "authorization: basic {b64}", "{fill} token_name = {call} {fill}",
]
KIND_OF = {k: "secret" for k in ("long", "b64", "mixed", "phrase")}


def _make(name: str, r: random.Random) -> str:
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    an, low = string.ascii_letters + string.digits, string.ascii_lowercase
    if name == "long":
        return pick(an, r.randint(20, 48))
    if name == "b64":
        return pick(an + "+/", r.randint(22, 64)) + r.choice(["=", "==", ""])
    if name == "mixed":
        return pick(low, r.randint(2, 6)) + pick(string.digits, r.randint(1, 4)) + pick(string.ascii_uppercase, r.randint(1, 4)) + pick("!@#_-" + an, r.randint(1, 6))
    if name == "phrase":
        return "-".join(pick(low, r.randint(3, 6)) + pick(string.digits, 1) for _ in range(2)) + " " + pick(low, 4) + pick(string.digits, 2)
    return {
        "plain": lambda: pick(low, r.randint(3, 9)), "number": lambda: pick(string.digits, r.randint(1, 16)), "email": lambda: f"{pick(low, 5)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "phone": lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", "card": lambda: pick(string.digits, 16), "url": lambda: f"https://{pick(low, 6)}.example/{pick(low, 4)}/{r.randint(1, 99)}?page=2",
        "date": lambda: f"{r.randint(1990, 2024)}-1{r.randint(0, 2)}-0{r.randint(1, 9)}T10:00:00", "longword": lambda: pick(low, r.randint(16, 40)), "call": lambda: f"{pick(low, r.randint(3, 7))}{pick(low, 5).capitalize()}({r.choice(['', pick(low, 3), pick(string.digits, 1)])});",
    }[name]()


def labelled_table(spark: SparkSession, rows: int = 1000, seed: int = 11) -> DataFrame:
    """A small labelled table: text, and the labels of its white-space tokens."""
    r = random.Random(seed)
    made = [labelled(TEMPLATES[i % len(TEMPLATES)], KIND_OF, lambda name: _make(name, r), r) for i in range(rows)]
    return spark.createDataFrame(pd.DataFrame(made, columns=["text", "labels"]), "text string, labels array<string>")


def train_tagger(table: DataFrame, max_rows: int = 2000) -> Tagger:
    """Fit on at most ``max_rows`` labelled rows, the smallest by text."""
    rows = [(x.text, list(x.labels)) for x in table.where("text is not null and labels is not null").orderBy("text").limit(max_rows).collect()]
    return fit(rows, LABELS, WORDS)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"h" * 24 in text.encode("utf-8").translate(_HEXED):
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def add_spans(text: str, data: bytes, base: list[tuple[int, int, str]], more: list[tuple[int, int, str]], kinds: tuple[str, ...], holds=None) -> list[tuple[int, int, str]]:
    """Base spans with those of the tagger (byte offsets) that touch none of them and for whose kind and text ``holds``."""
    if not more:
        return base
    plain = len(data) == len(text)
    out = list(base)
    for a, b, kind in more:
        if not plain:
            a, b = len(data[:a].decode("utf-8", "ignore")), len(data[:b].decode("utf-8", "ignore"))
        if not any(x < b and a < y for x, y, _ in base) and (holds is None or holds(kind, text[a:b])):
            out.append((a, b, f"crf_{kind}"))
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(out, key=lambda s: (s[0], rank.get(s[2], len(kinds)), s[2], s[1]))


def scan(docs: DataFrame, tagger: Tagger, base, kinds: tuple[str, ...], id_col: str, text_col: str, holds=None) -> DataFrame:
    """Counts per base kind, digest of the base spans, all spans and their number. One pass over the texts."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, 2000):
                texts = [t or "" for t in part.column(1).to_pylist()]
                raw = [t.encode("utf-8") for t in texts]
                rows = []
                for text, data, more in zip(texts, raw, model.value.tag(raw)):
                    found = base(text)
                    spans = add_spans(text, data, found, more, kinds, holds)
                    rows.append((*(sum(s[2] == x for s in found) for x in kinds), len(spans), hashlib.sha256(join_spans(found).encode()).hexdigest(), join_spans(spans)))
                cols = list(zip(*rows))
                n = len(kinds) + 1
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:n]), *(pa.array(c, pa.string()) for c in cols[n:])], names=[id_col, *(f"n_{x}" for x in kinds), "n_spans", "base_sha256", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, {', '.join(f'n_{x} long' for x in kinds)}, n_spans long, base_sha256 string, spans string")


def find_secrets(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text; the tagger is trained on ``labelled_table`` if none is given."""
    return scan(docs, tagger or train_tagger(labelled_table(docs.sparkSession)), base_spans, KINDS, id_col, text_col)
