"""Search in texts by an inverted index, and for entities by number, name and alias."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlark.operators import entity as E
from ledgerlark.operators import textindex as I
from ledgerlark.sources.store import shared_dir

from .names import trigram_sql
from .registry import query
from .views import view

# Parameters of the query.
ASKED = I.Search(all_of=["the"], any_of=["ands", "of"], none_of=["licensed"], phrase=["of", "the"], beginning="th")


def _stem_sql(w: str) -> str:
    one = f"CASE WHEN ends_with({w}, 'sses') THEN left({w}, length({w}) - 2) WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"
    return f"list_transform([{one}], lambda x: CASE WHEN ends_with(x, 'ing') AND length(x) >= 6 THEN left(x, length(x) - 3) WHEN (ends_with(x, 'ed') OR ends_with(x, 'ly')) AND length(x) >= 5 THEN left(x, length(x) - 2) ELSE x END)[1]"


@query("text_search", "O-136", f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    e AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w),
    p AS MATERIALIZED (SELECT doc_id, size, pos, {_stem_sql('word')} AS term FROM e),
    h AS (SELECT a.doc_id, count(*) AS hits FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1),
    f AS (SELECT doc_id, count(*) FILTER (WHERE term IN ('the', 'and', 'of') OR starts_with(term, 'th')) / CAST(any_value(size) AS DOUBLE) AS score FROM p GROUP BY 1
        HAVING bool_or(term = 'the') AND bool_or(term IN ('and', 'of')) AND NOT bool_or(term = '{{licensed}}') AND bool_or(starts_with(term, 'th')))
    SELECT doc_id AS doc, round(score, 9) AS score, hits AS phrase_hits FROM f JOIN h USING (doc_id)""".replace("{licensed}", "licens"))
def text_search(spark, d):
    """Documents with the asked words, phrase and beginning, from an index of all documents."""
    index = I.write_index(view(spark, d, "documents"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return I.search(index, ASKED).withColumn("score", F.round("score", 9))


def _known(spark, d):
    """Entities with the names that their second records bear as aliases."""
    e = view(spark, d, "party_entities")
    second = e.where("id % 10 = 2").select((F.col("id") - 1).alias("entity_id"), F.array("name").alias("aliases"))
    return e.where("id % 10 = 1").select(F.col("id").alias("entity_id"), "name", "bn").join(second, "entity_id")


_SIM = "round(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))), 6)"


def _score(c: str) -> str:
    return f"greatest(CASE WHEN contains(upper({c}), 'GROUP') THEN 0.9 ELSE 0 END, {_SIM.format(a=trigram_sql(c), b=trigram_sql(chr(39) + 'group' + chr(39)))})"


@query("alias_search", "O-160 O-136", f"""
    WITH s AS (SELECT id AS entity_id, name, {_score('name')} AS score FROM {{party_entities}} WHERE id % 10 = 1
        UNION ALL SELECT a.id - 1, b.name, {_score('a.name')} FROM {{party_entities}} a JOIN {{party_entities}} b ON b.id = a.id - 1 WHERE a.id % 10 = 2)
    SELECT entity_id, name, max(score) AS score FROM s GROUP BY 1, 2 HAVING max(score) >= 0.3 ORDER BY score DESC, entity_id LIMIT 30""")
def alias_search(spark, d):
    """Entities that bear the asked text in a name or an alias."""
    return E.search(_known(spark, d), "group").withColumn("score", F.round("score", 6))


@query("number_search", "O-160", "SELECT id AS entity_id, name, CAST(1.0 AS DOUBLE) AS score FROM {party_entities} WHERE id % 10 = 1 AND bn = '120000007'")
def number_search(spark, d):
    """Nine digits and more ask for a number."""
    return E.search(_known(spark, d), "12000-0007 RR0001")
