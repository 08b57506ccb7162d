"""Prefix trie of conversations, with count-min screening of prefix digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.spread import matched, shuffled
from waymark.llm.store import materialize
from waymark.operators.scan import scan

#: Rows of counters of the sketch, and the most counters of one row: two bits each, so that a sketch has 6 MB at most.
DEPTH, MOST_CELLS = 3, 1 << 23
#: Bytes of one bitmap of the sketch that are merged at a time, and sketches merged by one call.
BLOCK, FAN = 1 << 15, 64
#: Members of a node whose numbers are joined into one piece of text.
PIECE = 50_000
NODE = ["pa", "pb", "depth"]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _cells(a: np.ndarray, b: np.ndarray, depth: np.ndarray, width: int) -> np.ndarray:
    """Counters of every digest, one per row of the sketch, as indices into one flat array."""
    x = a.astype(np.uint64)[None, :] * _ODD[:, None] + b.astype(np.uint64)[None, :] * _ODD[::-1, None] + depth.astype(np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.int64) % width + (np.arange(DEPTH) * width)[:, None]


def _arrays(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def sketch(digests: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """Count-min sketch of the digests (pa, pb, depth), with counters that stop at two; one byte per counter, and the counters of a row.

    ``rows`` is the number of digests: a row of counters has four per digest, up
    to MOST_CELLS.  Tasks fill sketches of their own, which are merged blockwise,
    FAN at a time; the driver gets the merged one, 6 MB at most.  With more
    digests than counters, fewer singletons are proven, and more digests are
    grouped exactly.
    """
    width = 1 << max(18, min(int(4 * rows).bit_length(), MOST_CELLS.bit_length() - 1))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(DEPTH * width, np.uint8)
        for batch in batches:
            at, times = np.unique(_cells(*_arrays(batch, NODE), width), return_counts=True)
            counts[at] = np.minimum(counts[at].astype(np.int64) + times, 2)
        once, twice = (np.packbits(counts >= k).tobytes() for k in (1, 2))
        task = TaskContext.get().partitionId()
        for i in range(0, len(once), BLOCK):
            if any(once[i : i + BLOCK]):
                yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([i]), pa.array([once[i : i + BLOCK]]), pa.array([twice[i : i + BLOCK]])], names=["task", "block", "once", "twice"])

    def merge(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        once, twice = (np.zeros(len(found["once"].iloc[0]), np.uint8) for _ in range(2))
        for o, t in zip(found["once"], found["twice"]):
            o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
            twice |= t | (once & o)
            once |= o
        return pd.DataFrame({"task": [key[1]], "block": [key[0]], "once": [once.tobytes()], "twice": [twice.tobytes()]})

    schema = "task long, block long, once binary, twice binary"
    parts = materialize(digests.select(*NODE).mapInArrow(fill, schema), "sketches")
    last = parts.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0]
    while last > 0:
        parts = materialize(parts.groupBy("block", F.floor(F.col("task") / FAN).alias("group")).applyInPandas(merge, schema), "sketches")
        last //= FAN
    counts = np.zeros(DEPTH * width, np.uint8)
    for r in parts.collect():  # a few bitmaps of BLOCK bytes, 6 MB in all
        both = np.unpackbits(np.frombuffer(r["once"], np.uint8)) + np.unpackbits(np.frombuffer(r["twice"], np.uint8))
        counts[r["block"] * 8 : r["block"] * 8 + len(both)] = both
    return counts, width


def screened(rows: DataFrame, counts: np.ndarray, width: int) -> DataFrame:
    """``rows`` (pa, pb, depth and the row's own ha, hb) with ``alone`` and ``inner``: whether the estimates prove this prefix, and the prefix one turn shorter, a singleton."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        estimate = lambda a, b, d: counts[_cells(a, b, d, width)].min(0)
        for batch in batches:
            a, b, d, ha, hb = _arrays(batch, [*NODE, "ha", "hb"])
            alone = estimate(a, b, d) == 1
            inner = (estimate(a ^ ha, b ^ hb, d - 1) == 1) & (d > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(inner)], names=[*names, "alone", "inner"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, alone boolean, inner boolean")


def ends_digest(ends: DataFrame) -> DataFrame:
    """top, depth and ends_sha256: the SHA-256 of the comma-joined, ascending ``conv_id`` of every node (top, depth).

    Numbers are sorted by ranges and joined into pieces there; one task per node
    streams the pieces in order through the hash, holding one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, own = None, []

        def out():
            return pa.RecordBatch.from_pydict({"top": [node[0]], "depth": [node[1]], "first": [own[0]], "piece": [",".join(map(str, own))]})

        for batch in batches:
            for top, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("top", "depth", "conv_id"))):
                if own and ((top, depth) != node or len(own) >= PIECE):
                    yield out()
                    own = []
                node = (top, depth)
                own.append(conv)
        if own:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for top, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("top", "depth", "piece"))):
                if (top, depth) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (top, depth), hashlib.sha256()
                state.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["top", "depth", "ends_sha256"])
            done = []
        if node is not None:
            yield pa.RecordBatch.from_pydict({"top": [node[0]], "depth": [node[1]], "ends_sha256": [state.hexdigest()]})

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ends = ends.repartitionByRange(n, "top", "depth", "conv_id").sortWithinPartitions("top", "depth", "conv_id")
    joined = sorted_ends.mapInArrow(pieces, "top long, depth long, first long, piece string")
    return joined.repartition(n, "top", "depth").sortWithinPartitions("top", "depth", "first").mapInArrow(digest, "top long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of all prefixes of the conversations.

    ``turns`` has a row per turn: conv_id, depth (from 1, without gaps), a and b
    (a digest of what is said, 128 bits in two longs), n (its length) and last
    (whether it is its conversation's last); ``conversations`` has every conv_id
    once, also those without turns.  Returned per node: conv_id (its smallest
    member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256, as the query names them.  Turns are
    equal where their digests are.  Without conversations there is no node.

    A prefix's digest is the xor of the digests of its turns and places.  A
    count-min sketch of all of them proves most prefixes singletons: nodes
    below one are made from their own rows.  Only what may be shared, and every
    conversation's first singleton, is moved: to be grouped exactly, and to be
    scanned from the end of each conversation for what its members add to the
    nodes on their way.  Hot prefixes and long conversations are spread over
    tasks.
    """
    placed = turns.select("conv_id", "depth", "n", "last", F.xxhash64("depth", "a").alias("ha"), F.xxhash64("b", "depth").alias("hb"))
    placed = materialize(placed, "turns")
    rows = materialize(scan(placed, ["conv_id"], ["depth"], totals={"pa": ("xor", "ha"), "pb": ("xor", "hb")}), "prefixes")
    rows = materialize(screened(rows, *sketch(rows, rows.count())).drop("ha", "hb"), "screened")
    node = F.struct(*NODE)

    inner = rows.where("inner")
    border = rows.where("alone and not inner").withColumns({"n_convs": F.lit(1).cast("long"), "top": F.col("conv_id"), "leaf": F.col("last")})
    maybe = rows.where("not alone and not inner").withColumn("node", node)
    groups = maybe.groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("top"), F.count_if("last").alias("ends")).where("n_convs > 1")
    groups = materialize(groups.select("node", "n_convs", "top", (F.col("ends") == F.col("n_convs")).alias("leaf")), "shared-prefixes")
    known = matched(maybe, groups, "node", "left", F.col("conv_id")).drop("node")
    known = known.withColumns({"n_convs": F.coalesce("n_convs", F.lit(1)), "leaf": F.coalesce("leaf", "last"), "top": F.coalesce("top", "conv_id")})

    # from the end of each conversation: what it adds to the nodes on its way
    first = F.col("top") == F.col("conv_id")
    marked = known.unionByName(border.select(known.columns)).withColumns(
        {
            "up": -F.col("depth"),
            "own": F.when(first, 0).otherwise(F.col("n")).cast("long"),
            "mark": F.when((F.col("n_convs") == 1) | (F.col("last") & F.col("leaf") & first), 1).otherwise(0),
        }
    )
    marked = materialize(marked, "members")
    seen = scan(marked, ["conv_id"], ["up"], ["depth", "top"], totals={"saved": ("sum", "own"), "leaf_top": ("or", "mark")}, ahead=True)
    beside = lambda c, d: F.when(F.col(f"{c}.depth") == F.col("depth") + d, F.col(f"{c}.top"))
    seen = seen.withColumns({"parent": F.when(F.col("depth") > 1, F.coalesce(beside("next", -1), "conv_id")), "child": F.when(beside("prev", 1) == F.col("conv_id"), 1).otherwise(0)})
    seen = materialize(seen, "seen")

    several = seen.where("n_convs > 1").groupBy(*NODE, "top", "n_convs").agg(
        F.max(F.when(first, F.col("parent"))).alias("parent"), F.sum("child").alias("n_children"), F.sum("leaf_top").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    single = seen.where("n_convs = 1").select("conv_id", "depth", "parent", "last").unionByName(inner.select("conv_id", "depth", F.col("conv_id").alias("parent"), "last"))
    single = single.select(
        "conv_id", "depth", "parent", F.lit(1).cast("long").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.sha2(F.when(F.col("last"), F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"),
    )
    tops = seen.where("depth = 1").agg(F.count_if(first).alias("n_children"), F.coalesce(F.sum("leaf_top"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    all_of = conversations.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("top")).where("n_convs > 0")
    root = all_of.join(F.broadcast(tops)).select(  # one row and one row
        "top", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.col("n_children").cast("long"), F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens",
    )
    root = materialize(root, "root")
    several = several.select("top", F.col("depth").cast("long"), "parent", "n_convs", "n_children", "n_leaves", "saved_tokens").unionByName(root)
    one = root.select(F.col("top").alias("root_top"))
    silent = shuffled(conversations, turns.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    ends = seen.where("n_convs > 1 and last").select("top", F.col("depth").cast("long"), "conv_id").unionByName(silent.join(F.broadcast(one)).select(F.col("root_top").alias("top"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    several = shuffled(several, ends_digest(materialize(ends, "ends")), ["top", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    nodes = several.withColumnRenamed("top", "conv_id").unionByName(single)
    parent = F.when(F.col("depth") == 1, F.col("root_top")).otherwise(F.col("parent"))
    return nodes.join(F.broadcast(one), F.lit(True)).select("conv_id", F.col("depth").cast("long"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), a, b and n (code points) of every turn, without its text.

    Turns go by ``turn``, null first; those of one turn by the md5 of role and
    text.  Repeated rows stay.  A null role or text is empty; rows without
    conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.md5(F.concat(role, F.lit("\n"), text)).alias("key"), F.xxhash64(role, text).alias("a"), F.length(text).cast("long").alias("n"),
    )
    d = materialize(d.withColumn("one", F.lit(1).cast("long")), "conversation-turns")
    d = scan(d, ["conv_id"], ["turn", "key", "a"], totals={"place": ("sum", "one")})
    return d.select("conv_id", "place", "a", F.xxhash64("key").alias("b"), "n")


def share_heads(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (``prefix_trie``'s input) after each conversation's first turns were replaced.

    The first ``heads`` turns (an expression of conv_id, ``most`` at most) of
    conversation ``base`` (one too) come in place of as many own turns, fewer if
    it has fewer, none if it is not there.
    """
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("total")).select("conv_id", "total", base.alias("base"), heads.cast("long").alias("h"))
    convs = materialize(convs, "conversations")
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    given = F.least("h", F.coalesce("base_total", F.lit(0)))
    convs = shuffled(convs, lengths, "base", "left").select("conv_id", "base", "h", given.alias("given"), (given + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialize(convs, "rebuilt")
    start = turns.where(F.col("place") <= most).withColumnsRenamed({"conv_id": "base", "place": "depth"})
    start = shuffled(convs.select("conv_id", "base", "given", "length"), start, "base").where("depth <= given")
    rest = matched(turns, convs, "conv_id", salt_by=F.col("place")).where("place > h").withColumn("depth", F.col("given") + F.col("place") - F.col("h"))
    cols = ["conv_id", "depth", "a", "b", "n", (F.col("depth") == F.col("length")).alias("last")]
    return start.select(cols).unionByName(rest.select(cols)), convs.select("conv_id")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt on shared heads: see ``ordered_turns``, ``share_heads`` and ``prefix_trie``.

    Nulls, ties and repeated rows are as in ``ordered_turns``; an empty table
    gives no rows; other columns are ignored.
    """
    turns = materialize(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "ordered-turns")
    c = F.col("conv_id")
    return prefix_trie(*share_heads(turns, c - c % 100, F.crc32(c.cast("string")) % 6, 5))


_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) % 256 + 1)::BIGINT]))"
_ROUND = "list_transform({}, lambda v: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)"


def _rounds(n: int) -> str:
    return _ROUND.format(_rounds(n - 1)) if n else "range(256)::UBIGINT[]"


SQL = f"""
WITH crc_table AS MATERIALIZED (SELECT {_rounds(8)} AS t),
o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(10) || coalesce(text, ''))) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, (xor({_CRC}, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM o), crc_table
), r AS (
  SELECT c.conv_id, place, 0 AS part, role, text FROM c JOIN o ON o.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, place, 1, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND place > h
), s AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS n,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING) AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
), l AS (
  SELECT c.conv_id, coalesce(max(depth), 0) AS length FROM c LEFT JOIN s USING (conv_id) GROUP BY 1
), p AS (
  SELECT conv_id, depth, n, md5(path) AS node FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c
), up AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM p
), nodes AS (
  SELECT node, any_value(parent) AS parent, depth, min(conv_id) AS top, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends FROM up JOIN l USING (conv_id) GROUP BY node, depth
), kids AS (
  SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT a.node, sum(b.own) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes b JOIN up u ON u.conv_id = b.top AND u.depth <= b.depth JOIN nodes a ON a.node = u.node LEFT JOIN kids k ON k.node = b.node GROUP BY 1
)
SELECT a.top AS conv_id, a.depth::BIGINT AS depth, p.top AS parent_conv_id, a.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM nodes a LEFT JOIN nodes p ON a.depth > 0 AND p.node = a.parent LEFT JOIN kids k ON k.node = a.node JOIN below ON below.node = a.node
"""
