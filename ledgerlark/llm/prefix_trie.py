"""Prefix trie of conversations: which beginnings conversations share.

A conversation is the sequence of digests of its turns (role and text), with the
number of words of each. Equal sequences are one row with their count, so a
group of copies of any size costs one. Sequences are dealt by hash of their first
turn; a task builds the pointer tries of its first turns, nodes as a list of
dictionaries, and adds up subtrees in an iterative postorder. A first turn with
too many turns below it for one task is split: the prefix that all its sequences
share becomes a chain of nodes, and they are dealt anew by the turn after it, as
often as needed. What was split is added up from its parts afterwards, the root
being the first such split.

``ends_sha256`` is the digest of a list of ids in order, so one task must read
it; ids come to it joined in blocks of 4,096.

Defined results: turns are ordered by turn (null first), then role, then text;
null role or text is empty; rows without a conversation id take no part; a
repeated row is a turn of its own; very long texts are read whole; of an empty
table there are no nodes; other columns are ignored; ids and turns must be
integers or null. A conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

TURNS_AT_ONCE = 100_000  # turns of distinct sequences in the tries of one task, about
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
ROOT = "root"


def turn_sequences(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): the digests and word counts of each conversation's turns in order."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = table.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv is not null")
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    placed = rows.select("conv", place.alias("place"), digest.alias("digest"), words.alias("words"))
    turns = F.sort_array(F.collect_list(F.struct("place", "digest", "words")))
    return placed.groupBy("conv").agg(F.transform(turns, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_shared_heads(seqs: DataFrame, head: Column, every: int = 20, most: int = 3) -> DataFrame:
    """Conversation c begins with the first ``head`` (at most ``most``) turns of c - c % ``every`` in place of its own."""
    bases = seqs.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most).alias("heads"))
    rows = seqs.select("conv", "turns", head.cast("int").alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    theirs = F.slice(F.coalesce("heads", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return rows.join(bases, "base", "left").select("conv", F.concat(theirs, own).alias("turns"))


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(turns, words, n, least, ends): each distinct sequence once, with its conversations' number, least id and digest of ids."""
    split = seqs.select("conv", F.col("turns.digest").alias("turns"), F.col("turns.words").alias("words"))
    keyed = written(split.withColumn("seq", F.sha2(F.concat_ws("", F.transform("turns", F.hex)), 256)), "sequences")
    one = keyed.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.any_value("turns").alias("turns"), F.any_value("words").alias("words"))
    blocks = keyed.groupBy("seq", F.shiftright("conv", 12).alias("block")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, digest = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != seq:
                    if seq is not None:
                        out.append((seq, digest.hexdigest()))
                    seq, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["seq", "ends"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([digest.hexdigest()])], names=["seq", "ends"])

    ends = blocks.repartition("seq").sortWithinPartitions("seq", "block").select("seq", "ids").mapInArrow(run, "seq string, ends string")
    return one.join(ends, "seq").drop("seq")


def _trie_rows(split: str, depth: int, seqs: list[tuple]) -> list[tuple]:
    """Nodes below depth ``depth`` of the sequences (turns, words, n, least, ends) that share one prefix of that length.

    The nodes are a list, children a dictionary from a turn to a place in it; a
    node is made after its parent, so the list read backwards is a postorder.
    """
    nodes: list[list] = [[{}, -1, depth, None, 0, 0, EMPTY]]  # children, parent, depth, least, n, words, ends
    for turns, words, n, least, ends in seqs:
        at = 0
        for turn, w in zip(turns[depth:], words[depth:]):
            below = nodes[at][0].get(turn)
            if below is None:
                below = nodes[at][0][turn] = len(nodes)
                nodes.append([{}, at, nodes[at][2] + 1, least, 0, int(w), EMPTY])
            node = nodes[below]
            node[3], node[4] = min(node[3], least), node[4] + n
            at = below
        nodes[at][6] = ends
    leaves, saved, out = [0] * len(nodes), [0] * len(nodes), []
    for at in range(len(nodes) - 1, 0, -1):
        children, parent, d, least, n, w, ends = nodes[at]
        leaves[at] += not children
        saved[at] += (n - 1) * w
        leaves[parent] += leaves[at]
        saved[parent] += saved[at]
        above = nodes[parent][3] if parent else None
        out.append((least, d, above, n, len(children), leaves[at], saved[at], ends, None if parent else split))
    return out


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    """The tries of all splits in the rows (split, depth, turns, words, n, least, ends)."""
    out = []
    for (split, depth), part in frame.groupby(["split", "depth"]):
        out += _trie_rows(split, int(depth), list(zip(part.turns, part.words, part.n, part.least, part.ends)))
    cols = [x.split()[0] for x in NODE.split(", ")] + ["top_of"]
    found = pd.DataFrame(out, columns=cols)
    found["parent_conv_id"] = found["parent_conv_id"].astype("Int64")
    return found


def prefix_trie(seqs: DataFrame, turns_at_once: int = TURNS_AT_ONCE) -> DataFrame:
    """All nodes of the trie of ``seqs`` (conv, turns array<struct<digest, words>>)."""
    todo = written(distinct_sequences(seqs).select(F.lit(ROOT).alias("split"), F.lit(0).alias("depth"), "turns", "words", "n", "least", "ends"), "distinct")
    key = ["split", "depth", "turn"]
    chains = todo.where("1 = 0").select("split", F.col("split").alias("above"), F.lit(0).alias("start"), "words", "depth")
    nodes, ended, rounds = None, None, 0
    while True:
        here = todo.withColumn("turn", F.when(F.size("turns") > F.col("depth"), F.element_at("turns", F.col("depth") + 1)))
        groups = written(here.where("turn is not null").groupBy(*key).agg(F.sum(F.size("turns") - F.col("depth")).alias("below"), F.min("turns").alias("low"), F.max("turns").alias("high")), f"groups{rounds}")
        sizes = groups.agg(F.sum(F.when(F.col("below") <= turns_at_once, F.col("below"))).alias("small"), F.count(F.when(F.col("below") > turns_at_once, 1)).alias("large")).first()
        parts = -(-(sizes.small or 0) // turns_at_once)
        closed = here.where("turn is null").select("split", "n", "least", "ends")
        ended = closed if ended is None else ended.unionByName(closed)
        large = groups.where(F.col("below") > turns_at_once).drop("below")
        small = here.where("turn is not null").join(large.select(*key), key, "left_anti") if sizes.large else here.where("turn is not null")
        if parts:
            bucket = F.pmod(F.xxhash64(*key), F.lit(parts))
            built = small.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda frame: _build(frame), f"{NODE}, top_of string")
            built = written(built, f"tries{rounds}")
            nodes = built if nodes is None else nodes.unionByName(built)
        if not sizes.large:
            break
        # the sequences of a large group share what the least and the greatest of them share
        shared = F.aggregate(F.sequence(F.lit(1), F.least(F.size("low"), F.size("high"))), F.lit(0), lambda d, k: F.when((d == k - 1) & (F.element_at("low", k) == F.element_at("high", k)), k).otherwise(d))
        cut = large.withColumn("to", shared).withColumn("below", F.sha2(F.concat_ws("", F.transform(F.slice("low", 1, F.col("to")), F.hex)), 256))
        cut = written(cut.select(*key, "to", "below"), f"splits{rounds}")
        todo = here.join(cut, key).select(F.col("below").alias("split"), F.col("to").alias("depth"), "turns", "words", "n", "least", "ends", F.col("split").alias("above"), F.col("depth").alias("start"))
        todo = written(todo, f"pending{rounds}")
        links = todo.groupBy("split").agg(F.any_value("above").alias("above"), F.any_value("start").alias("start"), F.any_value(F.slice("words", F.col("start") + 1, F.col("depth") - F.col("start"))).alias("words"), F.any_value("depth").alias("depth"))
        chains = chains.unionByName(links)
        todo = todo.drop("above", "start")
        rounds += 1
    return _with_splits(nodes, ended, written(chains, "chains"), rounds)


def _with_splits(nodes: DataFrame | None, ended: DataFrame, chains: DataFrame, rounds: int) -> DataFrame:
    """Nodes of the tries and of the chains above them, deepest splits first, each once its parts are added up."""
    columns = [x.split()[0] for x in NODE.split(", ")]
    tops = ended.select("split", "n", "least", F.lit(0).alias("leaves"), F.lit(0).alias("saved"), F.lit(0).alias("children"), "ends")
    if nodes is not None:
        more = nodes.where("top_of is not null").select(F.col("top_of").alias("split"), F.col("n_convs").alias("n"), F.col("conv_id").alias("least"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(1).alias("children"), F.lit(None).cast("string").alias("ends"))
        tops = tops.unionByName(more)
    # a split lies in another, at most ``rounds`` deep; what a split adds up to is one more part of the one above
    level = chains.where(F.col("above") == ROOT).select("split", F.lit(1).alias("level"))
    levels, k = level, 1
    while k < rounds:
        level = chains.join(level.select(F.col("split").alias("above")), "above").select("split", F.lit(k + 1).alias("level"))
        levels, k = levels.unionByName(level), k + 1
    leveled = written(chains.join(levels, "split"), "levels") if rounds else None
    found = []
    sums = [F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children"), F.coalesce(F.max("ends"), F.lit(EMPTY)).alias("ends")]
    for k in range(rounds, -1, -1):
        if k == 0:
            added = tops.where(F.col("split") == ROOT).groupBy("split").agg(*sums).withColumns({"above": F.lit(None).cast("string"), "start": F.lit(-1), "words": F.array(F.lit(0).cast("long")), "depth": F.lit(0)})
        else:
            added = tops.join(leveled.where(F.col("level") == k).drop("level"), "split").groupBy("split", "above", "start", "depth").agg(*sums, F.any_value("words").alias("words"))
        added = written(added.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves"))), f"added{k}")
        found.append(added)
        if k:
            saved = F.col("saved") + (F.col("n") - 1) * F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w)
            tops = tops.unionByName(added.select(F.col("above").alias("split"), "n", "least", "leaves", saved.alias("saved"), F.lit(1).alias("children"), F.lit(None).cast("string").alias("ends")))
    splits = found[0]
    for more in found[1:]:
        splits = splits.unionByName(more)
    names = splits.select(F.col("split").alias("up"), F.col("least").alias("up_least"))
    # every node of the chain: the words from it to the end count for its subtree
    steps = splits.select("*", F.posexplode("words").alias("at", "_")).join(names.withColumnRenamed("up", "above"), "above", "left")
    last = F.col("at") == F.size("words") - 1
    after = F.aggregate(F.slice("words", F.col("at") + 1, F.size("words") - F.col("at")), F.lit(0).cast("long"), lambda a, w: a + w)
    chain = steps.select(
        F.col("least").alias("conv_id"), (F.col("start") + 1 + F.col("at")).cast("long").alias("depth"), F.when(F.col("at") > 0, F.col("least")).otherwise(F.col("up_least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * after).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"),
    )
    if nodes is None:
        return chain.select(*columns)
    inner = nodes.join(names, nodes["top_of"] == names["up"], "left").withColumn("parent_conv_id", F.coalesce("up_least", "parent_conv_id"))
    return chain.select(*columns).unionByName(inner.select(*columns))


def trie_of_conversations(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns_at_once: int = TURNS_AT_ONCE) -> DataFrame:
    """Trie of the conversations of ``table`` as they are."""
    return prefix_trie(turn_sequences(table, conv_col, turn_col, role_col, text_col), turns_at_once)
