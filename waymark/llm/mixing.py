"""Mixing sources to target weights by a low-discrepancy slot schedule, in DataFrame operations only."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.llm.quality_rules import words_sql
from waymark.llm.spread import running, shuffled, small_enough
from waymark.llm.store import materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of a block: every slot takes one.
BLOCK_WORDS = 1024
#: Points of the schedule in one cell, by which they meet the sources' shares.
CELL = 256
#: Slots, in order, that are ranked at a time.
SPAN = 65_536
GOLDEN = 0.6180339887498949


def _source(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, number of words and a hash of the text of every document."""
    return docs.select("doc_id", "source", F.expr(f"size({words_sql('text')})").cast("long").alias("size"), F.xxhash64("text").alias("text_key"))


def source_targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its size, its target, and the target in whole words.

    Sources are taken in code-point order, null last, and weigh 3, 1, 2,
    repeating.  ``share`` times all words go to the sources by weight; no
    target exceeds ``cap`` times its source's size, and what that cuts off goes
    to the others by weight.  With the sources in order of cap over weight, each
    row has the level (words per unit of weight) that is left if exactly the
    rows before it are capped.  The first row whose level stays within its own
    cap has the true one; every row after it has a lower level, as the capped
    rows would take more than their level, so the true one is the highest.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(per, [_source("source")], {"rank": F.lit(1)}, "sources")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    w = ranked.select("source", "source_size", F.get(weights, (F.col("rank") % len(WEIGHTS)).cast("int")).alias("w"), (F.col("source_size") * cap).alias("top"))
    w = running(w, [F.col("top") / F.col("w"), _source("source")], {"top_before": F.col("top"), "w_before": F.col("w")}, "caps")
    total, weight = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    levels = w.select("w", "top", ((F.lit(share * total) - F.col("top_before")) / (F.lit(weight) - F.col("w_before"))).alias("level"))
    level = levels.where("level * w <= top").agg(F.max("level")).first()[0]
    target = F.col("top") if level is None else F.least(F.col("top"), F.lit(level) * F.col("w"))
    return w.select("source", "source_size", target.alias("target")).withColumn("words", F.floor("target").cast("long"))


def golden_step(n: int) -> int:
    """The step next to ``n`` golden ratios that has no divisor with ``n``: its multiples modulo ``n`` visit every point once."""
    step = max(1, round(n * GOLDEN))
    while gcd(step, n) > 1:
        step += 1
    return step


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source, slot and rank: the slots of every source, ranked from 0.

    A source needs as many slots as its target has blocks (the last one may be
    short).  Laid end to end in order of the sources these are the cumulative
    weights, of n places in all.  Slot k has the golden-ratio point
    k * step mod n, with a step of about 0.618 n that shares no divisor with n:
    the points of all slots are all n places, each once, and any run of slots
    holds every source close to its share.
    """
    spark = targets.sparkSession
    lots = targets.withColumn("blocks", F.ceil(F.col("words") / F.lit(block_words)).cast("long")).where("blocks > 0")
    shares = running(lots.select("source", "blocks"), [_source("source")], {"lo": F.col("blocks")}, "shares").withColumn("hi", F.col("lo") + F.col("blocks"))
    n = shares.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    cells = shares.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))).alias("cell"))
    cells = materialize(cells, "share-cells")
    step = golden_step(max(n, 1))
    high, low = F.floor(F.col("id") / F.lit(1 << 20)), F.col("id") % F.lit(1 << 20)  # no product leaves the range of a long
    place = (high * F.lit((step << 20) % max(n, 1)) + low * F.lit(step)) % F.lit(max(n, 1))
    points = spark.range(n).select(F.col("id").alias("slot"), place.alias("place")).withColumn("cell", F.floor(F.col("place") / CELL))
    met = points.join(F.broadcast(cells), "cell") if small_enough(cells) else shuffled(points, cells, "cell")
    met = met.where("place >= lo AND place < hi")
    slots = materialize(met.select("source", "slot", F.floor(F.col("slot") / SPAN).alias("span")), "slots")
    counts = slots.groupBy("source", "span").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("c_source"), F.col("span").alias("c_span"), before.alias("before"))
    row = F.row_number().over(Window.partitionBy("source", "span").orderBy("slot"))
    ranked = shuffled(slots.withColumn("row", row), counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("span") == F.col("c_span")))
    return ranked.select("source", "slot", (F.col("before") + F.col("row") - 1).alias("rank"))


def mix_pieces(sized: DataFrame, block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """What the slots take of every document of ``sized``, a written table: one row per slot and document, and one with a null slot for a document that no slot takes.

    A source's documents are shuffled (order of md5(seed, doc_id)) and laid end
    to end, once and once again; block r of that stream, ``block_words`` words,
    goes to the source's slot of rank r.  Rows have slot, source, doc_id, size,
    text_key, source_size, target, place (of the document in its source's
    stream), from_word and n_words.

    Running sums go over (source, hash prefix) first and then within one, so
    that no source's documents meet in one task.
    """
    targets = materialize(source_targets(sized), "mix-targets")
    slots = schedule(targets, block_words)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")
    keyed = sized.select("doc_id", "source", "size", "text_key", key).withColumn("part", F.substring("key", 1, 3))
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).drop("n")
    parts = shuffled(parts, targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumnsRenamed({"source": "p_source", "part": "p_part"})
    within = F.sum("size").over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    order = F.row_number().over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "text_key"))
    placed = shuffled(keyed.withColumns({"within": within, "row": order}), parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    placed = placed.withColumns({"start": F.col("before") + F.col("within"), "place": F.concat("part", F.lit("-"), "row")})
    blocks = F.expr(
        "flatten(transform(sequence(0L, 1L), p -> if(size = 0 or p * source_size + start >= words, array(), "
        f"transform(sequence((p * source_size + start) div {block_words}, (least(p * source_size + start + size, words) - 1) div {block_words}), "
        f"j -> named_struct('j', j, 'x0', greatest(p * source_size + start, j * {block_words}), 'x1', least(p * source_size + start + size, (j + 1) * {block_words}, words), 'at', p * source_size + start)))))"
    )
    rows = placed.select("doc_id", "source", "size", "text_key", "source_size", "target", "place", F.explode_outer(blocks).alias("s"))
    slots = slots.withColumnsRenamed({"source": "s_source", "rank": "s_rank"})
    rows = shuffled(rows, slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("s.j") == F.col("s_rank")), "left")
    taken = F.when(F.col("slot").isNotNull(), F.col("s.x1") - F.col("s.x0")).otherwise(F.lit(0))
    return rows.select("slot", "source", "doc_id", "size", "text_key", "source_size", "target", "place", (F.col("s.x0") - F.col("s.at")).alias("from_word"), taken.alias("n_words"))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """How many words of every document the slots of the mix take, and in which slots it is.

    ``docs`` has doc_id, text and source; other columns are ignored.  Returns
    doc_id, source, size, source_size, target, taken, first_slot (the first slot
    with words of it) and n_slots, one row per row of ``docs``; a null or blank
    text has size 0 and is not taken (null first_slot), documents without a
    source form the last source, repeated rows are mixed one by one, and an
    empty table gives no rows.
    """
    pieces = mix_pieces(materialize(sizes(docs), "mix-sizes"), block_words)
    per = pieces.groupBy("source", "place", "doc_id", "size", "source_size", "target")
    return per.agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots")).drop("place")


def keep_mixed(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of the mix with all their columns; every part of the result is in order of the slots in which they start.

    Parts are dealt by hash, so each is itself mixed as the schedule says; one
    order over all parts would move all texts a second time.  A document is there as often as a slot starts on it, at most twice.  At most
    one document of a source is taken in part; it is kept whole.  Documents that
    no slot reaches, and those without words, are left out.  Rows that agree in
    doc_id, source and text share their copies, rounded up; an empty table
    gives no rows.
    """
    sized = materialize(sizes(docs), "mix-sizes")
    starts = mix_pieces(sized, block_words).where("from_word = 0 AND n_words > 0")
    names = ("doc_id", "source", "text_key")
    copies = starts.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"), F.min("slot").alias("first"), F.max("slot").alias("last"))
    again = materialize(sized.groupBy(*names).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumnsRenamed({c: f"r_{c}" for c in names}), "repeated-rows")
    same = lambda x: [F.col(c).eqNullSafe(F.col(f"{x}_{c}")) for c in names]
    copies = copies.join(F.broadcast(again), same("r"), "left") if small_enough(again) else shuffled(copies, again, same("r"), "left")
    share = F.ceil(F.col("copies") / F.coalesce("rows", F.lit(1))).cast("int").alias("copies")
    copies = materialize(copies.select(*[F.col(c).alias(f"m_{c}") for c in names], share, "first", "last"), "mix-copies")
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = shuffled(rows, copies, same("m"))
    kept = kept.select("row", "first", "last", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    slot = F.when(F.col("copy") == 1, F.col("first")).otherwise(F.col("last"))
    return kept.sortWithinPartitions(slot, "row.doc_id", "copy").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of ``documents``: see ``mix_sources``.  Nulls and blanks have size 0 and nothing taken; an empty table gives no rows."""
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot", "n_slots")


#: Targets are filled step by step: every step caps the sources over their cap and shares the rest anew, until none is over.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), fill AS (
  SELECT 0 AS step, 1.5e0 * sum(source_size) AS free, sum(w) AS weight, list(struct_pack(source := source, size := source_size, w := w)) AS open_, list(struct_pack(source := source, target := 0e0))[:0] AS full_, 1 AS over_
  FROM s HAVING count(*) > 0
  UNION ALL
  SELECT step + 1, free - coalesce(list_sum(list_transform(gone, lambda x: 2e0 * x.size)), 0e0), weight - coalesce(list_sum(list_transform(gone, lambda x: x.w)), 0),
         list_filter(open_, lambda x: NOT list_contains(gone, x)), list_concat(full_, list_transform(gone, lambda x: struct_pack(source := x.source, target := 2e0 * x.size))), len(gone)
  FROM (SELECT *, list_filter(open_, lambda x: (free / weight) * x.w > 2e0 * x.size) AS gone FROM fill WHERE over_ > 0 AND len(open_) > 0)
), done AS (
  SELECT * FROM fill ORDER BY step DESC LIMIT 1
), filled AS (
  SELECT unnest(list_concat(full_, list_transform(open_, lambda x: struct_pack(source := x.source, target := (free / weight) * x.w)))) AS f FROM done
), t AS (
  SELECT s.source, source_size, f.target AS target, floor(f.target)::BIGINT AS words, ((floor(f.target)::BIGINT + 1023) // 1024)::BIGINT AS blocks
  FROM s JOIN filled ON s.source IS NOT DISTINCT FROM f.source
), lot AS (
  SELECT source, (sum(blocks) OVER o - blocks)::BIGINT AS lo, (sum(blocks) OVER o)::BIGINT AS hi FROM t WINDOW o AS (ORDER BY source NULLS LAST)
), n AS (
  SELECT coalesce(sum(blocks), 0)::BIGINT AS n FROM t
), g AS (
  SELECT n, list_min(list_filter(range(greatest(1, round_even(n * 0.6180339887498949e0, 0)::BIGINT), greatest(1, round_even(n * 0.6180339887498949e0, 0)::BIGINT) + 1000), lambda x: gcd(x, n) = 1)) AS step FROM n
), p AS (
  SELECT slot, (slot::HUGEINT * step % n)::BIGINT AS place FROM g, unnest(range(n)) AS u(slot)
), slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM p JOIN lot ON place >= lo AND place < hi
), laid AS (
  SELECT d.*, row_number() OVER (ORDER BY doc_id, d.source, k) AS id, t.source_size, t.target, t.words,
         (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), twice AS (
  SELECT *, start AS a, least(start + size, words) AS b FROM laid UNION ALL
  SELECT *, source_size + start, least(source_size + start + size, words) FROM laid
), piece AS (
  SELECT *, unnest(range(a // 1024, (b - 1) // 1024 + 1)) AS j FROM twice WHERE b > a
), got AS (
  SELECT id, sum(least(b, (j + 1) * 1024) - greatest(a, j * 1024))::BIGINT AS taken, min(slot) AS first_slot, count(*) AS n_slots
  FROM piece JOIN slots ON piece.source IS NOT DISTINCT FROM slots.source AND j = rank GROUP BY id
)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM laid LEFT JOIN got USING (id)
"""
