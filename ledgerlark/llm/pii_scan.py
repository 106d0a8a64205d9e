"""Personal data in texts: fixed patterns, and a linear-chain CRF that finds more.

The CRF works on word-shape features, is trained from a small labelled table
and decodes by Viterbi in numpy batches; it adds names and the written forms of
addresses and numbers that the patterns miss, as far as an exact check of the
span allows.

Defined results: null text is the empty text and has no spans; long texts are
scanned whole; repeated rows give repeated results; an empty table gives an
empty table; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import random
import re
import string

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .secret_scan import scan
from .span_crf import Tagger, fit, labelled

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", "B-name", "I-name", "B-email", "I-email", "B-ip", "B-card", "I-card", "B-phone", "I-phone"]
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_LOCAL = set(string.ascii_letters + string.digits + "._%+-")
# Word classes of the tagger.
WORDS = {
    "title": ["mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "señor", "señora", "sir"],
    "call": ["phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "teléfono", "cell"],
    "mail": ["email", "e-mail", "mail", "contact", "write", "courriel", "correo"],
    "card": ["card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"],
    "name": ["name", "named", "signed", "author", "regards", "sincerely", "nom", "nombre"],
    "at": ["at", "(at)", "[at]"],
    "dot": ["dot", "(dot)", "[dot]"],
    "toward": ["to", "from", "or", "and", "by", "with", "via", "on", "is", "the"],
    "domain": ["com", "org", "net", "edu", "de", "fr", "es", "ch", "uk", "eu", "info"],
    "greet": ["dear", "hello", "liebe", "lieber", "querida", "cher", "chère", "estimado"],
    "host": ["ip", "address", "server", "host"],
}
TEMPLATES = [
    "{fill} Mr. {name} {fill}", "{fill} Dr. {name} {fill}", "{fill} Frau {name} {fill}", "regards, {name}", "{fill} name: {name} {fill}", "{fill} signed {name} {fill}", "{fill} {email} {fill}", "mail {spelt} {fill}", "{fill} contact {spelt} {fill}",
    "{fill} {ip} {fill}", "server {ip} {fill}", "{fill} {card} {fill}", "card {cards} {fill}", "visa: {cards} {fill}", "{fill} {phone} {fill}", "call {local} {fill}", "tel. {local} {fill}", "phone: {local} {fill}", "{fill} {phone}",
    "dear Mr. {name} {fill}", "{fill} Mrs. {name} {fill}", "Herr {name} {fill}", "sincerely, {name}", "author: {name} {fill}", "{fill} señora {name} {fill}", "madame {name} {fill}", "mail {spelt} {fill}", "email: {spelt} , {fill}", "{fill} send it to {spelt} {fill}", "{fill} to {plain} or {plain} {fill}", "fax: {local} {fill}", "mobile {local} {fill}", "{fill} telephone {local}", "{fill} number was {local} {fill}",
    "{fill} at {plain} and {plain} {fill}", "{fill} the dot at the {plain} {fill}", "{fill} contact the {plain} {fill}", "{fill} {decimals} {fill}", "{fill} pages {number} to {number} {fill}", "{fill} at {clock} {fill}",
    "{fill}", "{fill} {fill}", "{fill} {number} {fill}", "{fill} {date} {fill}", "{fill} {version} {fill}", "{fill} call the {plain} {fill}", "{fill} card game {fill}", "{fill} name of the {plain} {fill}", "{fill} {hex} {fill}", "{fill} token = \"{hex}\" {fill}", "{fill} {money} {fill}", "{fill} look at the dot {fill}",
]
KIND_OF = {"name": "name", "email": "email", "spelt": "email", "ip": "ip", "card": "card", "cards": "card", "phone": "phone", "local": "phone"}


def _make(name: str, r: random.Random) -> str:
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, num = string.ascii_lowercase, string.digits
    word = lambda: pick(low, r.randint(3, 9))
    end = lambda: r.choice(WORDS["domain"])

    def spelt() -> str:
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("at", "dot")])
        head = f"{word()} {dot} {word()}" if at == "at" and r.random() < 0.5 else f"{word()}.{word()}" if r.random() < 0.3 else word()
        return f"{head} {at} {word()} {dot} {end()}"

    return {
        "decimals": lambda: ", ".join(f"{r.randint(1, 99)}.{r.randint(0, 9)}" for _ in range(3)), "clock": lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}",
        "name": lambda: f"{word().capitalize()} {word().capitalize()}" if r.random() < 0.7 else word().capitalize(), "email": lambda: f"{word()}.{r.randint(1, 99)}@{word()}{r.randint(1, 9)}.example.com", "spelt": lambda: spelt(),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": lambda: pick(num, 16), "cards": lambda: " ".join(pick(num, 4) for _ in range(4)), "phone": lambda: f"+{r.randint(1, 99)} ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}",
        "local": lambda: r.choice([f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}", f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}", f"0{r.randint(10, 99)} {r.randint(1000, 9999)} {r.randint(1000, 9999)}", f"0{r.randint(100, 999)} {r.randint(1000, 9999)} {r.randint(1000, 9999)}", f"(0{r.randint(10, 999)}) {r.randint(100, 999)} {r.randint(1000, 9999)}", f"0{r.randint(10, 99)}-{r.randint(1000, 999999)}-{r.randint(10, 99)}"]),
        "number": lambda: pick(num, r.randint(1, 9)), "date": lambda: f"{r.randint(1990, 2024)}-1{r.randint(0, 2)}-0{r.randint(1, 9)}", "version": lambda: f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", "plain": word, "hex": lambda: pick(num + "abcdef", 40), "money": lambda: f"${r.randint(1, 99)},{r.randint(100, 999)}.00",
    }[name]()


def labelled_table(spark: SparkSession, rows: int = 1000, seed: int = 7) -> DataFrame:
    """A small labelled table: text, and the labels of its white-space tokens."""
    r = random.Random(seed)
    made = [labelled(TEMPLATES[i % len(TEMPLATES)], KIND_OF, lambda name: _make(name, r), r) for i in range(rows)]
    return spark.createDataFrame(pd.DataFrame(made, columns=["text", "labels"]), "text string, labels array<string>")


def train_tagger(table: DataFrame, max_rows: int = 2000) -> Tagger:
    """Fit on at most ``max_rows`` labelled rows, the smallest by text."""
    rows = [(x.text, list(x.labels)) for x in table.where("text is not null and labels is not null").orderBy("text").limit(max_rows).collect()]
    return fit(rows, LABELS, WORDS)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """As EMAIL.finditer, but looked for around each @: the pattern tries every letter of the text."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by kind as listed."""
    found = [(*m.span(), "email") for m in _emails(text)] if "@" in text else []
    if _DOTTED.search(text):
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def holds(kind: str, text: str) -> bool:
    """Exact check of a span of the tagger: a card passes Luhn, an address has parts to 255, a name is one line within a sentence, an email has an at and a dot."""
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", text)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in re.findall("[0-9]+", text))
    if kind == "name":
        return "\n" not in text and not re.search(r"[^\W\d_]{3,}[.!?]\s", text)
    if kind == "email":
        return "@" in text or bool(re.search(r"\w\W+at\W+\w.*\W(dot\W|\.\w)", text, re.I | re.S))
    return True


def find_pii(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text; the tagger is trained on ``labelled_table`` if none is given."""
    return scan(docs, tagger or train_tagger(labelled_table(docs.sparkSession)), base_spans, KINDS, id_col, text_col, holds)
