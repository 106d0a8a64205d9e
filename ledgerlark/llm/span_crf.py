"""Token tagging of whole texts with a linear-chain CRF over word shapes.

A text is cut at white space. A token's emission is the sum of weights of its
own shape, of its own word class (a small lexicon), of the shapes and classes
of its neighbours, and of the file. Each of these depends on one shape or one
class only, so the weights are summed once for each distinct shape and then
gathered by numpy for all tokens of a batch; Viterbi decodes the batch.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np

from .crf import Crf, train, viterbi

_SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_TOKEN = re.compile(rb"\S+")
_RUN = re.compile(rb"(a+|A+|0+|[^aA0]+)")
_TRIM_LEFT, _TRIM_RIGHT = b"\"'`([{<,;:!?*#$%&|=", b"\"'`)]}>,;:!?*#$%&|."
_PAIRS = ((b"(", b")"), (b"[", b"]"))
TOKENS_AT_ONCE = 200_000


def _size(n: int) -> str:
    return next(str(top) for top in (1, 2, 3, 5, 7, 9, 12, 15, 19, 27, 39, 63, 1 << 60) if n <= top)


def shape_features(shape: bytes) -> list[str]:
    """Features of one token from its uncollapsed shape alone."""
    core = shape.strip(_TRIM_LEFT + b".")
    runs = _RUN.findall(core)
    text = "".join(chr(r[0]) for r in runs[:12])
    digits, upper, lower = core.count(b"0"), core.count(b"A"), core.count(b"a")
    kinds = "".join(x for x, n in zip("0Aa", (digits, upper, lower)) if n) + ("." if digits + upper + lower < len(core) else "")
    found = [f"s={text}", f"n={_size(len(core))}", f"k={kinds}", f"kn={kinds}{_size(len(core))}", f"runs={min(len(runs), 9)}"]
    if digits:
        found += [f"d={min(digits, 20)}", f"ds={','.join(str(len(r)) for r in runs if r[:1] == b'0')[:16]}"]
    found += [f"c={chr(c)}" for c in sorted(set(core)) if c not in b"aA0" and c < 128][:6]
    found += [f"b={chr(shape[0])}"] + [f"e={chr(shape[-1])}"]
    return found


def near_features(shape: bytes) -> list[str]:
    core = shape.strip(_TRIM_LEFT + b".")
    text = "".join(chr(r[0]) for r in _RUN.findall(core)[:4])
    return [f"s={text}", f"e={chr(shape[-1])}"]


def file_features(data: bytes) -> list[str]:
    """What kind of file the text is: share of digits and of assignment and brace characters."""
    n = max(1, len(data))
    marks = sum(data.count(c) for c in (b"=", b"{", b"}", b";"))
    return ["code" if marks * 50 > n else "some" if marks else "prose"]


@dataclass
class Tagger:
    crf: Crf
    lexicon: dict[bytes, int]
    classes: list[str]

    def __post_init__(self) -> None:
        self.lexical = {p: np.stack([self.crf.rows([f"{p}x={c}"]) if c else np.zeros(len(self.crf.labels)) for c in self.classes]).astype(np.float32) for p in ("", "p", "q", "n")}
        self.clear()

    def clear(self) -> None:
        """Forget the shapes seen so far."""
        self.ids: dict[bytes, int] = {}
        #: weights of each shape for itself, for the token after it and for the one before it
        self.table = np.zeros((1024, 3, len(self.crf.labels)), np.float32)

    def shape_id(self, shape: bytes) -> int:
        k = self.ids[shape] = len(self.ids)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        near = near_features(shape)
        self.table[k] = self.crf.rows(shape_features(shape)), self.crf.rows([f"p{f}" for f in near]), self.crf.rows([f"n{f}" for f in near])
        return k

    def tag(self, texts: list[bytes]) -> list[list[tuple[int, int, str]]]:
        """Spans (start byte, end byte, kind) of each text."""
        spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        some: list[int] = []
        shapes: list[int] = []
        words: list[int] = []
        lengths: list[int] = []
        for at, i in enumerate(order):
            data = texts[i]
            cut = data.translate(_SHAPE).split()
            ids = self.ids
            shapes += [ids[s] if s in ids else self.shape_id(s) for s in cut]
            get = self.lexicon.get
            words += [get(w, 0) for w in data.lower().split()]
            some.append(i)
            lengths.append(len(cut))
            if len(shapes) >= TOKENS_AT_ONCE or at == len(order) - 1:
                for j, found in self._decode(some, [texts[j] for j in some], np.array(shapes, int), np.array(words, int), np.array(lengths, int)):
                    spans[j] = found
                some, shapes, words, lengths = [], [], [], []
                if len(self.ids) > 300_000:  # bounds memory; shapes are looked up anew
                    self.clear()
        return spans

    def _decode(self, keys, texts, s, w, lengths):
        if not len(s):
            return
        start = np.concatenate([[0], np.cumsum(lengths)])
        own, before, after = (self.table[:, x] for x in range(3))
        e = own[s] + self.lexical[""][w]
        first = np.zeros(len(s), bool)
        first[start[:-1][lengths > 0]] = True
        inner = ~first[1:]
        e[1:] += (before[s[:-1]] + self.lexical["p"][w[:-1]]) * inner[:, None]
        e[2:] += self.lexical["q"][w[:-2]] * (inner[1:] & inner[:-1])[:, None]
        e[:-1] += (after[s[1:]] + self.lexical["n"][w[1:]]) * inner[:, None]
        files = {f: self.crf.rows([f"f={f}"]) for f in ("code", "some", "prose")}
        e += np.repeat(np.array([files[file_features(t)[0]] for t in texts], np.float32), lengths, 0)
        tags = viterbi(e, lengths, self.crf.moves, self.crf.start)
        hits = np.flatnonzero(tags)
        for d in np.unique(np.searchsorted(start, hits, side="right") - 1):
            ends = [m.span() for m in _TOKEN.finditer(texts[d])]
            yield keys[d], list(_spans(texts[d], ends, [self.crf.labels[t] for t in tags[start[d] : start[d + 1]]]))


def _spans(data: bytes, tokens: list[tuple[int, int]], labels: list[str]):
    k = 0
    while k < len(labels):
        if labels[k] == "O":
            k += 1
            continue
        kind, j = labels[k][2:], k + 1
        while j < len(labels) and labels[j] == f"I-{kind}":
            j += 1
        a, b = tokens[k][0], tokens[j - 1][1]
        raw = data[a:b]
        a += len(raw) - len(raw.lstrip(_TRIM_LEFT))
        b -= len(raw) - len(raw.rstrip(_TRIM_RIGHT))
        for left, right in _PAIRS:  # a bracket stays with its fellow
            inner = data[a:b]
            if right in inner and data[a - 1 : a] == left and inner.find(left) in (-1, *range(inner.find(right), len(inner))):
                a -= 1
            elif left in inner and data[b : b + 1] == right and inner.rfind(right) < inner.rfind(left):
                b += 1
        if a < b:
            yield a, b, kind
        k = j


def lexicon_of(words: dict[str, list[str]]) -> tuple[dict[bytes, int], list[str]]:
    """Word class of each listed word, also with a mark before or after it."""
    classes, found = [""], {}
    for name, listed in words.items():
        classes.append(name)
        for word in listed:
            for left in ("", '"', "'"):
                for right in ("", ":", "=", ",", ".", '"', "'", '":', "':"):
                    found.setdefault((left + word + right).encode(), len(classes) - 1)
    return found, classes


def token_features(data: bytes, lexicon: dict[bytes, int], classes: list[str]) -> list[list[str]]:
    """The features that training uses; the same ones that ``Tagger`` gathers from its tables."""
    shapes, words = data.translate(_SHAPE).split(), data.lower().split()
    name = [classes[lexicon.get(w, 0)] for w in words]
    made = []
    for i, s in enumerate(shapes):
        f = shape_features(s) + [f"f={x}" for x in file_features(data)]
        f += [f"x={name[i]}"] if name[i] else []
        if i:
            f += [f"p{x}" for x in near_features(shapes[i - 1])] + ([f"px={name[i - 1]}"] if name[i - 1] else [])
        if i > 1 and name[i - 2]:
            f.append(f"qx={name[i - 2]}")
        if i + 1 < len(shapes):
            f += [f"n{x}" for x in near_features(shapes[i + 1])] + ([f"nx={name[i + 1]}"] if name[i + 1] else [])
        made.append(f)
    return made


def fit(rows: list[tuple[str, list[str]]], labels: list[str], words: dict[str, list[str]], steps: int = 90) -> Tagger:
    """Train on (text, label of each white-space token) rows."""
    lexicon, classes = lexicon_of(words)
    forbidden = tuple((x, y) for y in labels if y.startswith("I-") for x in labels if x[2:] != y[2:])
    data = [(token_features(t.encode(), lexicon, classes), tags) for t, tags in rows]
    return Tagger(train(data, labels, steps=steps, forbidden=forbidden), lexicon, classes)


def filler(r: random.Random, n: int) -> list[str]:
    """Running text in several dresses, as what surrounds or lacks a span."""
    parts = ["an", "ver", "tion", "el", "qu", "ment", "sch", "or", "is", "ado", "ber", "the", "ing", "lé", "ü", "os", "ñ"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)]
    words = [w.capitalize() if r.random() < 0.15 else w + r.choice([",", "."]) if r.random() < 0.12 else w for w in words]
    if r.random() < 0.8:  # prose: a sentence begins with a capital
        words = [w.capitalize() if i and words[i - 1].endswith(".") else w for i, w in enumerate(words)]
    dress = r.random()
    if dress < 0.1:
        return [w.upper() + "!!" for w in words]
    if dress < 0.2:
        return [w + r.choice(["###", "***", "$$$", "%%%", "&&&"]) for w in words]
    if dress < 0.3:
        return [x for w in words for x in (w, "|")]
    if dress < 0.4:
        return [r.choice([w, str(r.randint(0, 9999)), f"{r.randint(1, 12)}.{r.randint(0, 99)}", f"CC-BY-{r.randint(1, 4)}.0", f"{r.randint(1990, 2024)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"http://{w.strip('.,')}.example/{r.randint(1, 99)}"]) for w in words]
    return words


def labelled(pattern: str, kind_of: dict[str, str], make, r: random.Random) -> tuple[str, list[str]]:
    """A template with {name} slots as text with its token labels; a slot may make several tokens."""
    tokens, tags = [], []
    for part in pattern.split():
        slot = re.search(r"\{(\w+)\}", part)
        if part == "{fill}":
            some = filler(r, r.randint(2, 7))
            tokens += some
            tags += ["O"] * len(some)
        elif slot:
            some = part.replace(slot[0], make(slot[1])).split()
            tokens += some
            kind = kind_of.get(slot[1])
            tags += [f"B-{kind}"] + [f"I-{kind}"] * (len(some) - 1) if kind else ["O"] * len(some)
        else:
            tokens.append(part)
            tags.append("O")
    return " ".join(tokens), tags
