"""Registered queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, language_id, line_dedup, mixing, ogg_media, packing, pii_scan, pivot_topk, prefix_trie, quality, secret_scan, simhash, turn_repair

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an Ogg file, read back and digested."""
    return ogg_media.ogg_features(ogg_media.store_text_as_ogg(_table(spark, sf_dir, "documents")))


def op2_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text."""
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text."""
    return pii_scan.find_pii(_table(spark, sf_dir, "documents"))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of every vector whose id is divisible by 100."""
    return pivot_topk.top_k(_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every text."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the later copies of repeated line runs."""
    docs = line_dedup.remove_repeated_runs(_table(spark, sf_dir, "documents"), count_col="lines_removed")
    return docs.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "lines_removed")


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules of every text and whether it is kept."""
    return quality.judge(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the set damage."""
    return turn_repair.repair(_table(spark, sf_dir, "conversations"), damage=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, rebuilt on the first turns of every twentieth."""
    seqs = prefix_trie.turn_sequences(_table(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(seqs, head))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg_media": op1_ogg_media,
    "op2_secret_crf": op2_secret_crf,
    "op3_pii_crf": op3_pii_crf,
    "op4_pivot_topk": op4_pivot_topk,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_mixture": op6_language_mixture,
    "op7_golay_simhash": op7_golay_simhash,
    "op8_html_crf": op8_html_crf,
    "op9_line_suffix_array": op9_line_suffix_array,
    "op10_entropy_mix": op10_entropy_mix,
    "op11_quality_divergence": op11_quality_divergence,
    "op12_turn_repair": op12_turn_repair,
    "op13_prefix_trie": op13_prefix_trie,
}


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text."""
    shift = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {shift}), 4294967295)"


_MOVES = ", ".join(str(m) for m in turn_repair.moves())

ORACLES: dict[str, str] = {
    "op11_quality_divergence": """
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
            FROM d
        ), each AS (
            SELECT doc_id, lang, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
            FROM (SELECT doc_id, lang, unnest(ws) AS x FROM w)
        ), total AS (
            SELECT lang, count(*) AS total FROM each GROUP BY 1 HAVING count(*) >= 5000
        ), common AS (
            SELECT lang, word, n, total, n / total AS q
            FROM (SELECT lang, word, count(*) AS n FROM each GROUP BY 1, 2) JOIN total USING (lang)
            WHERE n * 1000 >= total
        ), bins AS (
            SELECT lang, count(word) AS bins, coalesce(sum(q), 0) AS q FROM total LEFT JOIN common USING (lang) GROUP BY 1
        ), hits AS (
            SELECT doc_id, lang, word, count(*) AS c FROM each JOIN common USING (lang, word) GROUP BY 1, 2, 3
        ), seen AS (
            SELECT doc_id, sum(p) AS p, sum(q) AS q, sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) AS s
            FROM (SELECT h.doc_id, h.c / len(ws) AS p, common.q FROM hits h JOIN common USING (lang, word) JOIN w ON w.doc_id = h.doc_id)
            GROUP BY 1
        ), words AS (
            SELECT w.doc_id, len(w.ws) AS n, b.bins, 1 - coalesce(s.p, 0) AS po, 1 - b.q AS qo, coalesce(s.s, 0) + b.q - coalesce(s.q, 0) AS s
            FROM w JOIN bins b USING (lang) LEFT JOIN seen s ON s.doc_id = w.doc_id WHERE len(w.ws) >= 50
        ), far_words AS (
            SELECT doc_id, sqrt(greatest(0, (s + CASE WHEN po > 1e-12 THEN po * log2(2 * po / (po + qo)) ELSE 0 END
                                               + CASE WHEN qo > 1e-12 THEN qo * log2(2 * qo / (po + qo)) ELSE 0 END) / 2))
                           > sqrt(0.33 * 0.33 + bins / (8 * n * ln(2))) AS far
            FROM words
        ), k AS (
            SELECT doc_id, lang, length(text) AS n, length(regexp_replace(text, '[^\\p{Lu}\\p{Lt}]', '', 'g')) AS capital,
                   length(regexp_replace(text, '[^\\p{L}\\p{M}]', '', 'g')) AS letter, length(regexp_replace(text, '[^\\p{N}]', '', 'g')) AS number,
                   length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')) AS space, length(regexp_replace(text, '[^\\p{P}]', '', 'g')) AS mark
            FROM d
        ), c AS (
            SELECT doc_id, lang, n, unnest([1, 2, 3, 4, 5, 6]) AS class,
                   unnest([letter - capital, capital, number, space, mark, n - letter - number - space - mark]) AS c
            FROM k
        ), cref AS (
            SELECT lang, class, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM c JOIN total USING (lang) GROUP BY 1, 2
        ), far_class AS (
            SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN c > 0 THEN c / n * log2(2 * c / n / (c / n + q)) ELSE 0 END
                                              + CASE WHEN q > 0 THEN q * log2(2 * q / (c / n + q)) ELSE 0 END) / 2)) > 0.25 AS far
            FROM c JOIN cref USING (lang, class) WHERE n >= 200 GROUP BY 1
        ), windows AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS times
            FROM (SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
        ), again AS (
            SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM windows WHERE times > 1) GROUP BY 1
        ), base AS (
            SELECT w.doc_id, len(ws) AS n_words, length(text) - length(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
            FROM w LEFT JOIN again ON again.doc_id = w.doc_id
        )
        SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(f.far, false) AND NOT coalesce(g.far, false) AS kept
        FROM base LEFT JOIN far_words f USING (doc_id) LEFT JOIN far_class g USING (doc_id)
    """,
    "op12_turn_repair": f"""
        WITH RECURSIVE hits AS (
            SELECT *, {_crc32("key")} % 20 AS hit
            FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
            FROM (SELECT *, unnest(CASE hit WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hits)
        ), left_over AS (
            SELECT conv_id, turn, place, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM placed
        ), faults AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                           WHEN regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair
            FROM left_over
        ), codes AS (
            SELECT conv_id, place, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(role) ELSE role END AS code
            FROM (SELECT conv_id, place, fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS role FROM faults)
        ), parts AS (
            SELECT conv_id, string_agg(code, '' ORDER BY place) AS codes FROM codes GROUP BY 1
        ), moves AS (
            SELECT * FROM (VALUES {_MOVES}) AS m(code, before, after, cost, edits)
        ), best AS (
            SELECT conv_id, codes, 0 AS k, 0 AS state, {{'cost': 0, 'audit': ''}} AS way FROM parts
            UNION ALL
            SELECT b.conv_id, b.codes, b.k + 1, m.after, min({{'cost': b.way.cost + m.cost, 'audit': b.way.audit || m.edits}})
            FROM best b JOIN moves m ON m.before = b.state AND m.code = substr(b.codes, b.k + 1, 1)
            WHERE b.k < length(b.codes) GROUP BY ALL
        ), ways AS (
            SELECT conv_id, min({{'cost': b.way.cost + m.cost, 'audit': b.way.audit || m.edits}}) AS way
            FROM best b JOIN moves m ON m.before = b.state AND m.code = '-' WHERE b.k = length(b.codes) GROUP BY 1
        ), letters AS (
            SELECT conv_id, pos, edit, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS place
            FROM (SELECT conv_id, unnest(range(1, length(way.audit) + 1)) AS pos, unnest(string_split(way.audit, '')) AS edit FROM ways WHERE way.audit <> '')
        ), kept AS (
            SELECT l.conv_id, l.edit, l.pos, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.pos) AS j,
                   first_value(CASE WHEN edit = 'K' AND left(f.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY l.pos) AS system
            FROM letters l LEFT JOIN faults f ON l.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.place = l.place
            WHERE l.edit <> 'D'
        ), repaired AS (
            SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS text
            FROM kept GROUP BY 1
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
                   count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                   count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY 1
        )
        SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(way.cost, 0) AS BIGINT) AS cost,
               coalesce(way.audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op13_prefix_trie": f"""
        WITH own AS (
            SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns, any_value({_crc32("CAST(conv_id AS VARCHAR)")} % 4) AS h
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY 1
        ), built AS (
            SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
            FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
        ), steps AS (
            SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)
        ), nodes AS (
            SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
            FROM steps GROUP BY 1, 2
        ), above AS (
            SELECT c.conv_id, c.d, p.conv_id AS parent FROM nodes c JOIN nodes p ON c.d = p.d + 1 AND p.path = c.path[1:c.d - 1]
        ), children AS (
            SELECT parent AS conv_id, d - 1 AS d, count(*) AS children FROM above GROUP BY 1, 2
        ), each AS (
            SELECT n.*, coalesce(children, 0) AS children,
                   CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(path[n.d].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
            FROM nodes n LEFT JOIN children USING (conv_id, d)
        ), sums AS (
            SELECT d, path, sum(leaf) AS leaves, sum(saved) AS saved
            FROM (SELECT unnest(range(0, d + 1)) AS d, path[1:unnest(range(0, d + 1))] AS path, CAST(children = 0 AS BIGINT) AS leaf, saved FROM each) GROUP BY 1, 2
        )
        SELECT n.conv_id, n.d AS depth, a.parent AS parent_conv_id, n.n AS n_convs, n.children AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
               CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
        FROM each n JOIN sums s ON s.d = n.d AND s.path = n.path LEFT JOIN above a ON a.conv_id = n.conv_id AND a.d = n.d
    """,
    "op4_pivot_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 100 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10
    """,
    "op9_line_suffix_array": """
        WITH d AS (
            SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
        ), l AS (
            SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM d
        ), w AS (
            SELECT doc_id, i, ls, len(regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+')) AS w FROM l
        ), c AS (
            SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM w
        ), win AS (
            SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY 1, 2
            UNION
            SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY 1, 3
        ), k AS (
            SELECT win.*, array_to_string(d.ls[s:e], chr(10)) AS key, min((win.doc_id, s)) OVER (PARTITION BY array_to_string(d.ls[s:e], chr(10))) AS first
            FROM win JOIN d USING (doc_id)
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM k WHERE (doc_id, s) > first
        ), kept AS (
            SELECT l.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n, coalesce(string_agg(l.ls[l.i], chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
            FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY 1
        )
        SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars, CAST(n AS BIGINT) AS lines_removed FROM kept
    """,
}
