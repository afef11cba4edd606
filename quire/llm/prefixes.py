"""Conversation prefix trie by whole-sequence collapse.

1. Turns are put in order and numbered. They are sorted by range over (conversation, turn), so a
   conversation of any length may span many tasks; each task numbers its own stretch, and the
   few conversations that span tasks are moved on by the rows of the tasks before.
2. Identical sequences collapse: a sequence's name is the XOR of two 64-bit hashes of each (depth, role,
   text). XOR needs no order, so it is a map-side combined sum for whole sequences and a running sum,
   in blocks of RUN turns, for prefixes. Each distinct sequence has its least conversation, its
   weight (conversations) and its end list, which streams through SHA-256 in chunks of ids.
3. Prefixes of the distinct sequences only are weighted and summed by name: the nodes. A sequence
   that is the parent of a node is a proper prefix; the anti-join with the parents leaves the leaves.
4. A subtree's sum comes without pairs of ancestors: bytes times conversations of a subtree are what its sequences
   still hold from there on; bytes of distinct nodes are counted by their owner, the sequence of the
   node's least conversation. A sequence owns all nodes from some depth on to its end, so what it
   adds to one of its prefixes is the lesser of its own bytes and its bytes from there on.

Nothing gathers a conversation, a subtree or the members of a node in one task; a node's end list passes
one task as a stream of chunks, as SHA-256 asks.

Defined results: rows without a conversation id are left out. Null role or text is empty. Turns of one
conversation that are equal (or null: first) are ordered by the MD5 of role and text; repeated rows
are turns of their own. Without conversations there is no node, otherwise there is the root.
Names are 128-bit hashes of non-secret form: not for texts made up to collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import col, need, staged

RUN = 1024  # turns of a conversation in one running sum
IDS = 4096  # ids in one chunk of an end list
HEADS = 9  # op12 borrows 0 to 8 turns
FAMILY = 5  # from the first conversation of each five
NAME = ["x1", "x2"]
NODE = ["depth", *NAME]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, digest, bytes) sorted by conv with their number within the task's rows of conv."""
    last, held = None, 0
    for b in batches:
        conv = b.column(0).to_numpy()
        if not len(conv):
            continue
        first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
        if conv[0] == last:
            at[: first[1] if len(first) > 1 else len(conv)] += held
        last, held = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["conv", "digest", "bytes", "at"])


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos from 1, digest of role and text, bytes of text) of every turn, written to the shared folder."""
    need(conversations, conv_id, turn, role, text)
    r, t = (F.coalesce(col(x).cast("string"), F.lit("")) for x in (role, text))
    digest = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)))
    rows = conversations.where(col(conv_id).isNotNull()).select(col(conv_id).cast("long").alias("conv"), col(turn).alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("bytes"))
    # the row's place in the scan only lets equal rows part; any order of those is the same result
    keys = ["conv", F.col("turn").asc_nulls_first(), "digest", "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.select("conv", "digest", "bytes").mapInArrow(_numbered, "conv long, digest binary, bytes long, at long")
    rows = staged(rows.withColumn("part", F.spark_partition_id()), "turns")
    pieces = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    spans = pieces.join(pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1"), "conv")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    moved = staged(spans.select("conv", "part", F.coalesce(before, F.lit(0)).alias("before")), "spans")
    # at most two rows a task of the sort
    rows = rows.join(F.broadcast(moved), ["conv", "part"], "left")
    return rows.select("conv", (F.col("at") + F.coalesce("before", F.lit(0)) + 1).alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame, heads: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``heads`` turns (at most ``most``) are those of conversation
    ``base`` (all if it has fewer, none if there is none), then their own turns after their first
    ``heads``. Both columns may use ``conv``. Returns the turns (conv, pos, digest, bytes) and all conversations (conv), even turnless."""
    turns = staged(turns, "numbered")
    known = staged(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", base.alias("base"), heads.alias("h")), "conversations")
    lent = F.least("h", F.coalesce("there", F.lit(0)))
    known = staged(known.join(known.select(F.col("conv").alias("base"), F.col("n").alias("there")), "base", "left").withColumn("lent", lent), "lent")
    first = turns.where(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    borrowed = known.join(first, "base").where("pos <= h").select("conv", "pos", "digest", "bytes")
    own = turns.join(known.where("h < n").select("conv", "h", "lent"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "digest", "bytes")
    return staged(own.unionByName(borrowed), "rebuilt"), known.select("conv")


def hashed(turns: DataFrame) -> DataFrame:
    """``turns`` with the two hashes x1 and x2 of (pos, role, text)."""
    return turns.select("conv", "pos", "bytes", *(F.xxhash64(F.lit(i), "pos", "digest").alias(n) for i, n in enumerate(NAME)))


def _run_of(b: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, end) of the runs of equal (depth, x1, x2, total) of sorted rows."""
    cols = [b.column(i).to_numpy() for i in range(4)]
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    yield from zip(zip(*(c[at].tolist() for c in cols), strict=True), at.tolist(), [*at[1:].tolist(), b.num_rows], strict=True)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, x1, x2, total, conv): chunks of up to IDS ids of one sequence."""
    names = [*NODE, "total", "first", "n", "ids"]
    for b in batches:
        conv = b.column(4).to_pylist()
        rows = [(*key, conv[i], min(i + IDS, end) - i, ",".join(map(str, conv[i : min(i + IDS, end)]))) for key, start, end in _run_of(b) for i in range(start, end, IDS)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (depth, x1, x2, total, first): one row for each sequence."""
    names = [*NODE, "total", "conv", "weight", "ends"]
    key, first, n, sha = None, 0, 0, None
    for b in batches:
        out = []
        cols = [b.column(i).to_pylist() for i in range(7)]
        for *now, start, many, ids in zip(*cols, strict=True):
            if now != key:
                if key is not None:
                    out.append((*key, first, n, sha.hexdigest()))
                key, first, n, sha = now, start, 0, hashlib.sha256()
            sha.update(("," * bool(n) + ids).encode())
            n += many
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, first, n, sha.hexdigest())], names=names)


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Distinct sequences: (depth, x1, x2, total bytes, conv: the least conversation, weight, ends)."""
    whole = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("depth"), *(F.bit_xor(x).alias(x) for x in NAME), F.sum("bytes").alias("total"))
    whole = convs.join(whole, "conv", "left").select(*(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in (*NODE, "total")), "conv")
    keys = [*NODE, "total"]
    chunks = whole.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInArrow(_chunked, "depth long, x1 long, x2 long, total long, first long, n long, ids string")
    chunks = chunks.repartition(*keys).sortWithinPartitions(*keys, "first")
    return staged(chunks.mapInArrow(_ended, "depth long, x1 long, x2 long, total long, conv long, weight long, ends string"), "sequences")


def prefixes(turns: DataFrame, distinct: DataFrame) -> DataFrame:
    """Every prefix of every distinct sequence: (conv, depth, x1, x2, parent's p1, p2, bytes of the last text,
    rest: bytes from the last text on, weight)."""
    rows = turns.join(distinct.select("conv", F.col("depth").alias("length"), "total", "weight"), "conv")
    rows = rows.withColumn("run", F.floor((F.col("pos") - 1) / RUN))
    running = Window.partitionBy("conv", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.bit_xor(x).over(running).alias(f"r{x}") for x in NAME] + [F.sum("bytes").over(running).alias("rbytes")]
    rows = rows.select("*", *sums)
    # runs of the long conversations, summed over those before
    runs = turns.join(distinct.where(F.col("depth") > RUN).select("conv"), "conv", "left_semi")
    runs = runs.groupBy("conv", F.floor((F.col("pos") - 1) / RUN).alias("run")).agg(*(F.bit_xor(x).alias(x) for x in NAME), F.sum("bytes").alias("bytes"))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "run", *(F.bit_xor(x).over(earlier).alias(f"e{x}") for x in NAME), F.sum("bytes").over(earlier).alias("ebytes"))
    rows = rows.join(runs, ["conv", "run"], "left")
    zero = F.lit(0).cast("long")
    full = {x: F.col(f"r{x}").bitwiseXOR(F.coalesce(f"e{x}", zero)) for x in NAME}
    upto = F.col("rbytes") + F.coalesce("ebytes", zero)
    rows = rows.select("conv", F.col("pos").alias("depth"), *(full[x].alias(x) for x in NAME), *(full[x].bitwiseXOR(F.col(x)).alias(f"p{x[1:]}") for x in NAME), "bytes", (F.col("total") - upto + F.col("bytes")).alias("rest"), "weight")
    root = distinct.select("conv", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("p1"), zero.alias("p2"), zero.alias("bytes"), F.col("total").alias("rest"), "weight")
    return staged(rows.unionByName(root), "prefixes")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations (conv) with turns (conv, pos from 1 on, digest, bytes): conv_id (least member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``(conv_id, depth)`` names a node:
    its last turn is that conversation's turn number depth."""
    turns = hashed(turns)
    distinct = sequences(turns, convs)
    paths = prefixes(turns, distinct)
    nodes = staged(paths.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("bytes").alias("bytes"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * F.col("rest")).alias("held")), "nodes")
    below = nodes.where("depth > 0")
    parents = staged(below.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children")), "parents")
    leaves = distinct.join(parents, NODE, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    owned = below.groupBy("conv").agg(F.sum("bytes").alias("owned"))
    marks = staged(leaves.join(owned, "conv", "full"), "marks")
    sums = paths.join(marks, "conv").groupBy(*NODE).agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(F.least("rest", F.coalesce("owned", F.lit(0).cast("long")))).alias("once"))
    ends = distinct.select(*NODE, "ends")
    full = nodes.join(sums, NODE).join(parents, NODE, "left").join(ends, NODE, "left")
    full = staged(full, "node-sums")
    # a parent of very many nodes is one row here; its children are split by adaptive skew handling
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    full = full.join(up, ["depth", "p1", "p2"], "left")
    none = hashlib.sha256().hexdigest()
    return full.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", (F.col("held") - F.col("once")).alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations as they are."""
    turns = staged(numbered_turns(conversations, conv_id, turn, role, text), "numbered")
    return prefix_trie(turns, turns.select("conv").distinct())


def rebuilt_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """op12's rows: the trie of conversations that begin with turns of the first of their five."""
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    return prefix_trie(*rebuilt(numbered_turns(conversations, conv_id, turn, role, text), heads, F.col("conv") - F.col("conv") % FAMILY, HEADS - 1))


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the columns of their last turns: ``turns`` has conv, pos and, say, role and text."""
    last = turns.withColumnsRenamed({"conv": "conv_id", "pos": "depth"})
    return nodes.join(last, ["conv_id", "depth"], "left")


TRIE_SQL = f"""
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % {FAMILY} AS base,
         xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
           lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % {HEADS} AS h
  FROM c GROUP BY conv_id),
b AS (
  SELECT k.conv_id, c.pos, c.r, c.t FROM k JOIN c ON c.conv_id = k.base AND c.pos <= k.h
  UNION ALL
  SELECT k.conv_id, c.pos - k.h + least(k.h, coalesce(o.n, 0)), c.r, c.t
  FROM k JOIN c ON c.conv_id = k.conv_id AND c.pos > k.h LEFT JOIN k o ON o.conv_id = k.base),
path AS (
  SELECT conv_id, pos AS depth, strlen(t) AS bytes,
         list({{'r': r, 't': t}}) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM b
  UNION ALL SELECT conv_id, 0, 0, [] FROM k),
node AS (
  SELECT path, depth, min(path.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         coalesce(string_agg(path.conv_id::VARCHAR, ',' ORDER BY path.conv_id) FILTER (WHERE depth = coalesce(l.length, 0)), '') AS ends
  FROM path LEFT JOIN (SELECT conv_id, count(*) AS length FROM b GROUP BY conv_id) l ON l.conv_id = path.conv_id
  GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
sub AS (
  SELECT path[1:u.d] AS path, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM (SELECT node.*, unnest(range(0, depth + 1)) AS d FROM node) u LEFT JOIN kids USING (path) GROUP BY 1)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
       sub.leaves AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN sub USING (path) LEFT JOIN kids USING (path)
LEFT JOIN node up ON node.depth > 0 AND up.path = node.path[1:node.depth - 1]
"""
