"""Quality rules, conversation repair and the prefix trie against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import prefix_trie, quality, turn_repair
from ledgerlark.llm.batches import by_bytes

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"


# --- batches -----------------------------------------------------------------


def test_slices_hold_few_bytes_and_all_rows():
    texts = ["x" * n for n in (3, 900, 2, 2, 2, 0, 500, 501, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], names=["i", "t"])
    parts = list(by_bytes(batch, 1, 4, 1000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(10))
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000) for p in parts)


# --- quality -----------------------------------------------------------------


def plain_counts(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, x in enumerate(zip(words, words[1:], words[2:])) if windows[x] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(again)


def test_base_counts_against_plain_ones():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", " ", " ", "\n", "é", "#", "\t", " ", " ", "a b a ", "日"]) for _ in range(r.randint(0, 60)))
        data = text.encode()
        assert quality.base_counts(text, data, data.split()) == plain_counts(text)


def test_distance():
    import numpy as np

    assert quality.distance(np.array([1.0, 1]), np.array([5.0, 5])) == 0
    assert quality.distance(np.array([1.0, 0]), np.array([0.0, 3])) == 1
    assert quality.word_limit(10**9, 80) == pytest.approx(quality.WORD_LIMIT, abs=1e-6)
    assert quality.word_limit(60, 80) > quality.WORD_LIMIT


def prose(r, n, words=("alpha", "beta", "gamma", "delta", "of", "the", "and")):
    return " ".join(r.choice(words) if r.random() < 0.5 else "".join(r.choices("abcdefgh", k=6)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    rows = [(i, prose(r, 120), "xx" if i % 3 else "yy", "s", 1) for i in range(300)]
    rows += [(1000, " ".join("Q" + w.upper() + "!!##" for w in prose(r, 120).split()), "xx", "s", 1), (1001, " ".join("".join(r.choices("zwvutsr", k=7)) for _ in range(300)), "xx", "s", 1)]
    rows += [(1002, "short text", "xx", "s", 1), (1003, None, "xx", "s", 1), (1004, "", None, "s", 1), (1005, prose(r, 90), None, "s", 1), (1006, "a b c " * 40, "yy", "s", 1), (None, prose(r, 400) + " word" * 9, "xx", "s", 1), (1007, prose(r, 100), "rare", "s", 1)]
    rows += [rows[5]] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_words int")


def test_far_texts_fail_and_near_ones_stay(corpus):
    got = {r.doc_id: r for r in quality.judge(corpus).collect()}
    assert quality.judge(corpus).count() == corpus.count()
    assert not got[1000].kept and not got[1000].base_failed and got[1000].class_distance > quality.CLASS_LIMIT
    assert not got[1001].kept and got[1001].class_distance < quality.CLASS_LIMIT and got[1001].word_distance > 0.5
    assert got[1002].base_failed and got[1003].n_words == 0 and got[1004].base_failed and got[1006].base_failed and not got[1006].kept
    assert got[1005].kept and got[1005].word_distance is None and got[1007].kept, "a language of few words has no reference"
    assert all(got[i].kept for i in range(300)) and got[None].kept


def test_languages_in_groups_and_parts_give_the_same(spark, corpus):
    one = sorted(map(str, quality.judge(corpus).collect()))
    assert one == sorted(map(str, quality.judge(corpus, at_once=1).collect()))
    assert one == sorted(map(str, quality.judge(corpus.repartition(7)).collect()))


def test_common_words_are_all_that_reach_the_share(corpus):
    refs = {r.lang: r for r in quality.references(corpus.repartition(5), least=1).collect()}
    for lang in ("xx", "yy", "rare", ""):
        seen = Counter(w for r in corpus.collect() if (r.lang or "") == lang for w in (r.text or "").lower().split())
        want = {w: n for w, n in seen.items() if n * quality.RAREST >= seen.total()}
        assert refs[lang].total == seen.total() and {x.word: x.n for x in refs[lang].common} == want


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.judge(empty).collect() == []


# --- repair ------------------------------------------------------------------


def plain_repair(rows):
    """Counts, cost and audit of (turn, role, text) rows in order by trying every audit of growing cost."""
    seen, faults = set(), []
    for _, role, text in rows:
        word = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not word else "duplicate" if (role, text) in seen else "truncated" if word[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    n = len(rows)
    for kinds in itertools.product("DKR", repeat=n):
        if any(k != "D" and f in ("blank", "duplicate") for k, f in zip(kinds, faults)):
            continue
        for inserts in itertools.product((0, 1, 2) if n < 4 else (0, 1), repeat=n + 1):
            cost = 3 * sum(inserts) + sum({"D": 4, "K": 0, "R": 3}[k] + 3 * (k != "D" and f == "truncated") for k, f in zip(kinds, faults))
            if best and cost > best[0]:
                continue
            audit = "".join("I" * i + k for i, k in zip(inserts, kinds)) + "I" * inserts[-1]
            out, left = [], iter(rows)
            for e in audit:
                role, text = ("", "") if e == "I" else next(left)[1:]
                if e == "D":
                    continue
                after_system = len(out) > 0 and out[0][0][:1] == "s" and out[0][2]
                want = "ua"[(len(out) - after_system) % 2]
                if e == "K":
                    if not (role[:1] == want or (not out and role[:1] == "s")):
                        break
                    out.append((role, text, True))
                else:
                    out.append(({"u": "user", "a": "assistant"}[want], text, False))
            else:
                initials = "".join(o[0][:1] for o in out)
                body = initials[1:] if initials[:1] == "s" else initials
                if (initials == "" or body) and body == "ua" * (len(body) // 2) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, "\n".join(f"{o[0]}:{o[1]}" for o in out)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def random_conversations(r, n, longest=5):
    rows = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, r.choice([t, t, t + 2, None]), role, r.choice(["Yes.", "No!", "cut off", "", " \n", None, "Line. ", "Why? \t", "Done.\u0085", "a.\n"])))
    return rows


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def test_repair_against_all_audits(spark):
    rows = random_conversations(random.Random(7), 60)
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(spark.createDataFrame(rows, CONV)).collect()}
    for c in {x[0] for x in rows}:
        mine = ordered([(t, r if r is not None else " ", x if x is not None else " ") for k, t, r, x in rows if k == c])
        assert got[c] == plain_repair(mine), mine


def damage(c, t, role, text):
    show = lambda v: " " if v is None else str(v)
    role, text = role if role is not None else " ", text if text is not None else " "
    hit = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
    text = "" if hit == 1 else "".join(x for x in text if x not in ".!?") if hit == 2 else text
    return [] if hit == 0 else [("user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def test_damage(spark):
    rows = random_conversations(random.Random(8), 150, 4) + [(None, 0, "user", "Who?"), (None, 1, "assistant", "I.")]
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(spark.createDataFrame(rows, CONV), damage=True).collect()}
    assert set(got) == {x[0] for x in rows}
    for c in got:
        mine = ordered([(t, r if r is not None else " ", x if x is not None else " ") for k, t, r, x in rows if k == c])
        left = [(t, *d) for t, r, x in mine for d in damage(c, t, r, x)]
        assert got[c] == plain_repair(left), left
    assert any(v[0:6] == (0,) * 6 and v[6] == "" and v[7] == turn_repair.hashlib.sha256(b"").hexdigest() for v in got.values())


def test_a_conversation_over_many_batches(spark):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool"]), r.choice([f"Turn {t}.", f"cut {t}", "", "Same."])) for c in range(3) for t in range(300)] + random_conversations(r, 20)
    table = spark.createDataFrame([(c + 1, *x) for c, *x in rows], CONV).coalesce(1)
    whole = sorted(map(str, turn_repair.repair(table).collect()))
    assert whole == sorted(map(str, turn_repair.repair(table, rows_at_once=7).collect()))


def test_clashing_and_empty_conversations(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 2)], "conv_id long, turn long, role string, text string, fault string, place int")
    row = turn_repair.repair(table).first()
    assert row.audit == "KI" and row.cost == 3 and row.repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()
    assert turn_repair.repair(table.limit(0), damage=True).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "x " * 500_000), (1, 0, "user", "x " * 500_000)], CONV)
    assert turn_repair.repair(long).first().duplicate == 1


# --- trie --------------------------------------------------------------------


def plain_trie(seqs):
    members, below = defaultdict(list), defaultdict(set)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    for p in members:
        if p:
            below[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = sum(saved[k] for k in below[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode().split()) if p else 0)
    ends = {p: hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(below[p]), leaves[p], saved[p], ends[p]) for p, m in members.items())


def conversations(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            out[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in out.items()}


def rows_of(trie):
    return sorted(tuple(-1 if x is None else x for x in r) for r in trie.collect())


@pytest.mark.parametrize("limit", [100_000, 40, 1])
def test_trie_against_a_plain_one(spark, limit):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", None]), "hot" if t < 2 and c % 3 else r.choice(["a b", "c", "", None, "d e f"])) for c in range(60) for t in range(r.randint(1, 5))]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 130) for t in range(4)] + [(c, None, "user", "x") for c in (200, -7, 2**40)] + [(None, 0, "user", "lost"), (201, 1, "a", "b"), (202, 1, "ab", "")]
    rows += [(300 + k, t, "user", f"deep {t}") for k in range(6) for t in range(k)]
    got = rows_of(prefix_trie.trie_of_conversations(spark.createDataFrame(rows, CONV), turns_at_once=limit))
    assert got == plain_trie(conversations(rows))


def test_shared_heads(spark):
    r = random.Random(5)
    rows = [(c, t, "user", f"{r.randint(0, 3)}") for c in range(5, 70) if c % 20 or c == 40 for t in range(r.randint(1, 4))]
    own = conversations(rows)
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    want = {c: own.get(c - c % 20, [])[: heads[c]] + own[c][heads[c] :] for c in own}
    assert any(not x for x in want.values()), "a conversation without turns is a member of the root"
    seqs = prefix_trie.with_shared_heads(prefix_trie.turn_sequences(spark.createDataFrame(rows, CONV)), F.crc32(F.col("conv").cast("string").cast("binary")) % 4)
    assert rows_of(prefix_trie.prefix_trie(seqs)) == plain_trie(want)


def test_ids_in_blocks_and_empty_table(spark):
    seqs = spark.range(10_000).select(F.col("id").alias("conv")).withColumn("text", F.lit("same")).withColumn("role", F.lit("user")).withColumn("turn", F.lit(0)).withColumnRenamed("conv", "conv_id").withColumn("digest", F.lit("clash"))
    got = rows_of(prefix_trie.trie_of_conversations(seqs, turns_at_once=1))
    every = hashlib.sha256(",".join(map(str, range(10_000))).encode()).hexdigest()
    assert got == [(0, 0, -1, 10_000, 1, 1, 9_999, prefix_trie.EMPTY), (0, 1, 0, 10_000, 0, 1, 9_999, every)]
    assert prefix_trie.trie_of_conversations(spark.createDataFrame([], CONV)).count() == 0


# --- caps and names of the earlier operators ----------------------------------


def test_names_that_clash_with_working_columns(spark):
    from ledgerlark.llm import line_dedup, simhash

    rows = [(i, "\n".join(["one two three " * 20, f"own {i} line of text"]), i, i, i, i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line_dedup_d int, line_dedup_th int, line_dedup_gone int, near_duplicates_row int")
    out = line_dedup.remove_repeated_runs(docs)
    assert out.columns == docs.columns and sorted(len(r.text.split("\n")) for r in out.collect()) == [1, 1, 2]
    assert simhash.one_of_each(docs).columns == docs.columns


def test_a_source_is_filled_until_no_document_fits(spark):
    from ledgerlark.llm import mixing

    # rows without an id share one threshold, so all of them are left to be filled
    docs = spark.createDataFrame([(None, "w " * 7, "a") for _ in range(40)] + [(i, "w " * 400, "b") for i in range(3)], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(r.target - r.taken < (7 if r.source == "a" else 400) for r in got)


def test_dual_of_a_steep_source(spark):
    from ledgerlark.llm import mixing

    # one document of a million words among single words
    sizes = spark.createDataFrame([("a", 1)] * 50 + [("a", 1_000_000)], "source string, size long")
    targets = spark.createDataFrame([("a", 1_000_050, 60.0)], "source string, source_size long, target double")
    r = mixing.solve_rates(sizes, targets).first()
    import math

    taken = sum(s * min(2, math.exp(min(700, r.lam * s / r.mean))) for s in [1] * 50 + [1_000_000])
    assert taken == pytest.approx(60, rel=1e-3)


def test_labels_beyond_one_model_are_learned_and_told(spark):
    from ledgerlark.llm import language_id

    r = random.Random(12)
    words = {f"l{k:02d}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(25)] for k in range(11)}
    rows = [(i, " ".join(r.choices(words[lang], k=40)), lang) for i, lang in enumerate(sorted(words) * 12)] + [(9000, None, "l00"), (9001, "123", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("likelihood", F.lit(1))
    got = {x.doc_id: x for x in language_id.identify(docs, languages=4).collect()}
    told = [got[i].lang_pred == lang for i, _, lang in rows[:-2]]
    assert len(got) == len(rows) and sum(told) >= 0.98 * len(told) and {got[9000].lang_pred, got[9001].lang_pred} == {"und"}
    out = language_id.annotate(docs, language_id.train(docs, languages=3))
    assert set(out.columns) == {"doc_id", "text", "lang", "likelihood", "lang_pred", "score", "languages"} and out.select("likelihood").distinct().count() == 1


def test_a_model_for_each_of_300_labels(spark):
    from ledgerlark.llm import language_id

    r = random.Random(13)
    words = {f"l{k:03d}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)] for k in range(300)}
    rows = [(i, " ".join(r.choices(words[lang], k=30)), lang) for i, lang in enumerate(sorted(words) * 3)]
    got = {x.doc_id: x.lang_pred for x in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2), language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2))).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.98 * len(rows) and len(set(got.values())) > 290
