"""The pipeline against a plain version of each stage, each on the stage's own input."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_text_operators import best_fit, plain_components, plain_fingerprint, plain_line_dedup, plain_targets
from tokenizers import Tokenizer

import corpus_pipeline

WORDS = {"en": "the and of to in that with is for was on by".split(), "de": "der die und das nicht ist mit ein von zu auf im".split()}


def corpus():
    r = random.Random(21)
    line = lambda lang: " ".join(r.choice(WORDS[lang]) + r.choice(["", "a", "en", "x", "o"]) for _ in range(r.randint(5, 30)))
    text = lambda lang: "\n".join(line(lang) for _ in range(r.randint(1, 7)))
    rows = [(i, text(lang := r.choice(["en", "de"])), lang, r.choice("abbbc")) for i in range(120)]
    passage = "\n".join(line("en") for _ in range(5))
    rows += [(200 + i, f"{text('en')}\n{passage}\n{text('en')}", "en", "b") for i in range(6)]
    rows += [(300 + i, rows[i][1], "en", "c") for i in range(10)]
    rows += [(400 + i, rows[i][1] + " more", "en", "c") for i in range(0, 60, 6)]
    rows += [(500, None, "en", "a"), (501, "", None, None), (502, "12 34 ?!", "en", "a"), (503, "word", None, None), (503, "word", None, None), (None, "der die das und nicht", "de", None)]
    return [(*row, len(row[1] or "")) for row in rows]


def test_every_stage_equals_its_plain_version(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"stage{k}")))
    raw, known, lines, single, mixed, packed = (x.collect() for x in seen)

    assert Counter((x.doc_id, x.text) for x in known) == Counter((x.doc_id, x.text) for x in raw if x.text and any(map(str.isalpha, x.text)))
    assert all(x.lang in WORDS for x in known)

    low = lambda key: -(1 << 63) if key is None else key
    want = plain_line_dedup([(low(x.doc_id), x.text) for x in known])
    cut = {(low(x.doc_id), x.text): want[low(x.doc_id), x.text] for x in known}
    assert Counter((low(x.doc_id), x.text) for x in lines) == Counter((k, cut[k, t]) for k, t in ((low(x.doc_id), x.text) for x in known) if cut[k, t] or not t)
    assert all(x.n_chars == len(x.text) for x in lines)

    ordered = sorted(lines, key=lambda x: (x.doc_id is None, x.doc_id or 0, x.text))
    prints = [plain_fingerprint(x.text) for x in ordered]
    links = [(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = [ordered[k] for k in sorted(set(plain_components(range(len(prints)), links).values()))]
    assert Counter((x.doc_id, x.text) for x in single) == Counter((x.doc_id, x.text) for x in roots)
    assert {300 + i for i in range(10)} & {x.doc_id for x in single} == set()

    sizes, taken = Counter(), Counter()
    for x in single:
        sizes[x.source] += len(x.text.split())
    for x in mixed:
        taken[x.source] += len(x.text.split())
    copies = Counter((x.doc_id, x.text) for x in mixed)
    assert set(copies) <= {(x.doc_id, x.text) for x in single} and max(copies.values()) <= 2
    targets = plain_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= 40 for s in targets)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [len(tokenizer.encode(x.text, add_special_tokens=False).ids) + 1 for x in mixed]
    assert sum(x.length for x in packed) == sum(ids) and Counter(x.doc_id for x in packed if x.piece == 0) == Counter(x.doc_id for x in mixed)
    held = defaultdict(list)
    for x in packed:
        held[x.sequence_id].append((x.offset, x.length))
    for places in held.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == list(ends[:-1]) and ends[-1] <= 4096
    assert len(held) == len(best_fit([n for x in ids for n in [4096] * (x // 4096) + [x % 4096] if n], 4096))


def test_documents_of_one_id_or_none_are_kept_apart(spark, tmp_path):
    r = random.Random(5)
    a, b, c, d = (" ".join(r.choice(["oak", "elm", "ash", "fir", "yew"]) + str(r.randint(0, 99)) for _ in range(300)) for _ in range(4))
    rows = [(1, a), (5, a + " x"), (5, b), (None, c), (None, d), (None, d), (5, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert (plain_fingerprint(a) ^ plain_fingerprint(a + " x")).bit_count() <= 4
    for parts in (1, 5):
        docs.repartition(parts).write.parquet(str(tmp_path / f"in{parts}"))
        kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / f"in{parts}")), str(tmp_path))
        assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter([(1, a), (5, b), (None, c), (None, d)])
    same_id = [(7, "w " * 40, "en", "s", 80), (7, "v " * 90, "en", "s", 180), (None, "u " * 70, "en", "s", 140), (None, "t " * 10, "en", "t", 20)]
    spark.createDataFrame(same_id, docs.schema).write.parquet(str(tmp_path / "mix"))
    mixed = Counter((x.doc_id, x.text) for x in corpus_pipeline.mix_sources(spark, spark.read.parquet(str(tmp_path / "mix")), str(tmp_path)).collect())
    words = Counter()
    for (_, t), n in mixed.items():
        words[t.split()[0] == "t"] += n * len(t.split())
        assert n <= 2
    assert words[False] <= 295 + 90 and words[True] <= 20 and abs(words[False] - 295) <= 40


def test_run_reads_the_table(spark, tmp_path):
    docs = spark.createDataFrame(corpus()[:30], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns)
