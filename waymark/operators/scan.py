"""Previous rows and running totals within a key, however many rows one key has.

Rows are dealt to ranges of (key, order), so that one key may lie in many tasks.
Each range is scanned by itself; what a range takes over from the ones before
it is worked out on a table with one row per range, which is small by its
number of rows, and is joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.shared import saved

#: Rows of one range, about.
RANGE_ROWS = 500_000
#: Running totals that can be carried from range to range.
KINDS = {"sum": F.sum, "xor": F.bit_xor, "or": F.bit_or}
JOINED = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b), "or": lambda a, b: a.bitwiseOR(b)}


def _ranges(rows: int, least: int) -> int:
    return max(least, -(-rows // RANGE_ROWS))


def scan(
    df: DataFrame, keys: list[str], order: list[str], lags: list[str] = (), starts: Callable[[Column, Column], Column] | None = None, totals: dict[str, tuple[str, str]] | None = None, ahead: bool = False, ranges: int | None = None,
) -> DataFrame:
    """``df`` with columns that look back within the key, in the order of ``order`` (which has no ties within a key).

    ``prev`` is a struct of the columns ``lags`` of the row before (null at a
    key's first row); with ``ahead``, ``next`` is that of the row after (null at
    its last).  ``ordinal`` is there with ``starts``: 1 and one more for
    every row up to this one for which ``starts(previous row, row)`` is true,
    both given as structs of ``lags``; a key's first row never counts.
    ``totals`` maps a new column to a kind and a column: its "sum", "xor" or
    "or" over the rows of the key up to this one, nulls left out.

    Null keys are one key, null orders come first, an empty table stays empty.
    Rows are shuffled into ranges, scanned there and written once to the shared
    folder; ``ranges`` sets how many ranges there are.
    """
    totals = dict(totals or {})
    if (starts is not None or ahead) and not lags:
        raise ValueError("starts, ahead: look at the columns of lags")
    names = set(df.columns)
    own = [c for c in ("prev", "next", "ordinal", *totals) if c in names]
    if own or any(kind not in KINDS for kind, _ in totals.values()):
        raise ValueError(f"columns that are there already: {own}; kinds of totals: {sorted(KINDS)}")
    spark = df.sparkSession
    n = ranges or _ranges(df.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part", *keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    now = F.struct(*[F.col(c) for c in lags]) if lags else F.lit(None)
    local = {}
    if lags:
        local["_before"] = F.lag(now).over(w)
        local["_first"] = F.row_number().over(w) == 1
    if ahead:
        local["_after"] = F.lead(now).over(w)
    local |= {f"_t_{name}": KINDS[kind](c).over(upto) for name, (kind, c) in totals.items()}
    done = part.withColumns(local)
    if starts is not None:
        mark = F.when(F.col("_before").isNotNull() & starts(F.col("_before"), now), 1).otherwise(0)
        done = done.withColumn("_mark", mark).withColumn("_ordinal", F.sum("_mark").over(upto))
    done = saved(done, "scanned")

    # one row per range: its first and last rows and the totals of its last key
    key, at = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]), F.struct(*keys, *order)
    last = {f"_t_{name}" for name in totals} | ({"_ordinal"} if starts is not None else set())
    edges = done.groupBy("_part").agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.min_by(now, at).alias("first_row"), F.max_by(now, at).alias("last_row"),
        *[F.max_by(c, at).alias(c) for c in sorted(last)],
    )
    by_part = Window.orderBy("_part")  # a row per range
    for c in ("last_key", "last_row"):
        edges = edges.withColumn(f"before_{c}", F.lag(c).over(by_part))
    for c in ("first_key", "first_row"):
        edges = edges.withColumn(f"after_{c}", F.lead(c).over(by_part))
    goes_on = F.lag(F.lit(1)).over(by_part).isNotNull() & F.col("first_key").eqNullSafe(F.col("before_last_key"))
    edges = edges.withColumn("goes_on", goes_on)
    if starts is not None:
        # whether the first row of a range starts anew is known only beside the last row of the range before
        again = F.when(F.col("goes_on") & starts(F.col("before_last_row"), F.col("first_row")), 1).otherwise(0)
        edges = edges.withColumn("again", again).withColumn("_ordinal", F.col("_ordinal") + F.when(F.col("first_key").eqNullSafe(F.col("last_key")), F.col("again")).otherwise(0))
    so_far = Window.partitionBy("last_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    kinds = {f"_t_{name}": kind for name, (kind, _) in totals.items()} | ({"_ordinal": "sum"} if starts is not None else {})
    for c, kind in kinds.items():
        edges = edges.withColumn(f"_c{c}", KINDS[kind](c).over(so_far))
    for c in kinds:
        edges = edges.withColumn(f"_c{c}", F.when(F.col("goes_on"), F.lag(f"_c{c}").over(by_part)))
    if starts is not None:
        edges = edges.withColumn("_c_ordinal", F.coalesce("_c_ordinal", F.lit(0)) + F.col("again"))
    carried = edges.where("goes_on").select(F.col("_part").alias("_in"), F.col("first_key").alias("_key"), F.col("before_last_row").alias("_taken"), *[f"_c{c}" for c in kinds])

    # joined to the rows of the one key that goes on; at most a row per range, so it is broadcast
    both = done.join(F.broadcast(carried), (F.col("_part") == F.col("_in")) & key.eqNullSafe(F.col("_key")), "left")
    if ahead:
        meets = F.lead(F.lit(1)).over(by_part).isNotNull() & F.col("last_key").eqNullSafe(F.col("after_first_key"))
        met = edges.withColumn("meets", meets).where("meets").select(F.col("_part").alias("_out"), F.col("last_key").alias("_end"), F.col("after_first_row").alias("_given"))
        both = both.join(F.broadcast(met), (F.col("_part") == F.col("_out")) & key.eqNullSafe(F.col("_end")), "left")
    out = [F.col(f"`{c}`") for c in df.columns]
    if lags:
        out.append(F.when(F.col("_first"), F.col("_taken")).otherwise(F.col("_before")).alias("prev"))
    if ahead:
        out.append(F.coalesce("_after", "_given").alias("next"))
    if starts is not None:
        out.append((F.col("_ordinal") + F.coalesce("_c_ordinal", F.lit(0)) + 1).cast("long").alias("ordinal"))
    for name, (kind, c) in totals.items():
        mine, more = F.col(f"_t_{name}"), F.col(f"_c_t_{name}")
        out.append(F.coalesce(JOINED[kind](mine, more), mine, more).alias(name))
    return both.select(*out)


def fullest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has the most."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
