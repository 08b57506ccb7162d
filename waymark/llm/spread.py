"""Joins and components that no key can overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.llm.store import materialize

#: A side of at most so many bytes (its columns' lengths, summed) is broadcast.
BROADCAST_BYTES = 8 << 20
SALTS = 32
#: Rows that one task numbers in a running sum over a whole table.
RUN_ROWS = 200_000


def table_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of a table take in memory: what its columns hold, and some for every row and nested value."""

    def size(c: Column, kind) -> Column:
        name = kind.typeName()
        if name in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if name == "array":
            inner = kind.elementType.typeName()
            if inner in ("string", "binary", "array", "map"):
                return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(16).cast("long"), lambda a, x: a + size(x, kind.elementType).cast("long"))
            fields = len(kind.elementType.fields) if inner == "struct" else 1
            return F.coalesce(F.size(c), F.lit(0)) * (8 * fields + (16 if inner == "struct" else 0)) + 16
        if name == "struct":
            return sum((size(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
        return F.lit(8)

    row = sum((size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    return int(df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0])


def small_enough(table: DataFrame, most: int | None = None) -> bool:
    """Whether a written table is small enough to be broadcast, by its counted bytes."""
    return table_bytes(table) <= (BROADCAST_BYTES if most is None else most)


def running(df: DataFrame, by: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``df`` with a column per entry of ``sums``: its sum over all rows before, in the order of ``by`` (which should have no ties).

    Rows are dealt to ranges of the order; sums go over the ranges first and
    then within one, so that no task holds the whole table.
    """
    n = 1 + df.count() // RUN_ROWS
    with_values = df.withColumns({f"_v_{k}": v for k, v in sums.items()})
    placed = materialize(with_values.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), label)
    per = placed.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    per = per.select("_range", *[F.coalesce(F.sum(f"_s_{k}").over(ranges), F.lit(0)).alias(f"_b_{k}") for k in sums])
    within = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    both = placed.join(F.broadcast(per), "_range")
    return both.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.coalesce(F.sum(f"_v_{k}").over(within), F.lit(0)) + F.col(f"_b_{k}")).alias(k) for k in sums])


def shuffled(left: DataFrame, right: DataFrame, on: str | list[str] | Column | list[Column], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, both shuffled and sorted however small Spark takes them to be.

    Spark sizes a written table by its compressed files, and what an explode
    adds it does not count: a table that it would broadcast may take far more
    than its threshold in the driver's memory.
    """
    return left.join(right.hint("merge"), on, how)


def matched(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", salt_by: Column | None = None) -> DataFrame:
    """``big`` joined with ``small``, which has each ``key`` once.

    ``small`` should be a written table (its bytes are counted).  A small one is
    broadcast.  Beyond that both sides are shuffled; with ``salt_by`` (an expression over
    ``big``) a key's rows are spread over SALTS tasks, to each of which its row
    of ``small`` is copied.
    """
    if small_enough(small):
        return big.join(F.broadcast(small), key, how)
    if salt_by is None or how in ("left_semi", "left_anti"):
        return shuffled(big, small, key, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return shuffled(salted, copies, [*([key] if isinstance(key, str) else key), "_salt"], how).drop("_salt")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) of every node of ``edges`` (a, b), longs.

    Alternating large-star and small-star steps, which shrink every component
    to a star around its smallest node in a logarithmic number of rounds.  Each
    round is a pre-aggregated minimum per node and one join, written to the
    shared folder; only a count and a checksum come to the driver.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most):
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = shuffled(both, low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = shuffled(large, low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        e = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
