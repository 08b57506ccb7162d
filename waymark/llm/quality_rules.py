"""Document quality rules with host-level verdicts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.spread import SALTS, shuffled, small_enough
from waymark.llm.store import materialize

#: The separators of a word: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]"
GAP = "[\\x20\\x09-\\x0D]+"
#: So many repeated windows of a document are looked up in an array; more are found by sorting (same result).
FEW = 48


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and binds it to ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_sql(text: str) -> str:
    """SQL for the array of words of a text; empty for a null or blank text."""
    trimmed = f"btrim(coalesce({text}, ''), ' \\t\\n\\u000b\\u000c\\r')"
    return _let(trimmed, "t0", r"if(t0 = '', cast(array() as array<string>), split(t0, '[\\x20\\x09-\\x0D]+'))")


def _covered(starts: str) -> str:
    """SQL for the number of words that 3-word windows at the sorted ``starts`` cover."""
    return f"aggregate(zip_with(slice({starts}, 1, size({starts}) - 1), slice({starts}, 2, size({starts}) - 1), (a, b) -> least(3, b - a)), 3, (x, y) -> x + y)"


def repeat_words_sql(words: str) -> str:
    """SQL for the number of words in 3-word windows that are found twice or more."""
    few = _let("filter(sequence(0, size(h) - 1), i -> array_contains(d, h[i]))", "f", _covered("f"))
    pairs = "sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))"
    same = "((j > 0 and p[greatest(j - 1, 0)].x = e.x) or (j < size(p) - 1 and p[least(j + 1, size(p) - 1)].x = e.x))"
    many = _let(pairs, "p", _let(f"sort_array(transform(filter(p, (e, j) -> {same}), e -> e.i))", "f", _covered("f")))
    twice = "array_distinct(array_compact(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> if(a = b, a, null))))"
    found = _let("sort_array(h)", "s", _let(twice, "d", f"case when size(d) = 0 then 0 when size(d) <= {FEW} then {few} else {many} end"))
    windows = "transform(sequence(2, size(g) - 1), i -> xxhash64(g[i - 2], g[i - 1], g[i]))"
    return f"if(size({words}) < 4, 0, {_let(f'transform({words}, x -> xxhash64(x))', 'g', _let(windows, 'h', found))})"


def rule_columns(text: str = "text") -> Column:
    """The counts of one text as a struct; a null text counts as empty."""
    filled = f"coalesce({text}, '')"
    lines = _let(f"filter(split({filled}, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')", "l", "named_struct('n', size(l), 'dup', size(l) - size(array_distinct(l)))")
    body = f"named_struct('n', size(w), 'chars', length(array_join(w, '')), 'rep', {repeat_words_sql('w')})"
    return F.expr(
        f"named_struct('w', {_let(words_sql(text), 'w', body)}, 'l', {lines}, 'sym', regexp_count({filled}, '[#*$%&|<>]'))"
    )


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` (the kept columns as a struct), ``host`` and the counts and rule failures of every document."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("source").alias("host"), rule_columns().alias("c"))
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    return d.select(
        "row", "host",
        F.col("c.w.n").cast("long").alias("n_words"), F.col("c.w.chars").cast("long").alias("word_chars"),
        F.col("c.sym").cast("long").alias("n_symbols"), F.col("c.l.dup").cast("long").alias("n_dup_lines"),
        F.col("c.w.rep").cast("long").alias("n_repeat_words"), F.col("c.l.n").cast("long").alias("n_lines"),
    ).select(
        "*",
        ((n < 50) | (100 * rep > 50 * n)).alias("base_failed"),
        (10 * F.col("n_symbols") > n).alias("fail_symbols"),
        (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")).alias("fail_lines"),
        ((F.col("word_chars") > 14 * n) | (F.col("word_chars") < 2 * n)).alias("fail_length"),
    )


RULES = ("fail_symbols", "fail_lines", "fail_length")


def host_verdicts(measured: DataFrame, bad_rate: float = 0.25) -> DataFrame:
    """One row per host: for each rule its failure rate, shrunk by a beta prior fitted to all hosts.

    The prior has the mean and, by the method of moments, the spread of the
    hosts' own rates: ``a + b = m (1 - m) / v - 1``, kept within 1 and 1000.
    A host with few documents is drawn to the mean; a rule counts against the
    documents of a host if the shrunk rate is above ``bad_rate``.
    """
    per = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    prior = per.agg(*[x for r in RULES for x in (F.avg(F.col(r) / F.col("n")).alias(f"{r}_m"), F.var_pop(F.col(r) / F.col("n")).alias(f"{r}_v"))])
    weight = [F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.coalesce(F.try_divide(F.col(f"{r}_m") * (1 - F.col(f"{r}_m")), F.col(f"{r}_v")) - 1, F.lit(1000.0)))).alias(f"{r}_w") for r in RULES]
    prior = prior.select(*[f"{r}_m" for r in RULES], *weight)
    rate = lambda r: (F.col(r) + F.col(f"{r}_m") * F.col(f"{r}_w")) / (F.col("n") + F.col(f"{r}_w"))
    return per.join(F.broadcast(prior)).select("host", F.col("n").alias("host_docs"), *[rate(r).alias(f"host_{r}") for r in RULES], *[(rate(r) > bad_rate).alias(f"bad_{r}") for r in RULES])


def judge(measured: DataFrame, bad_rate: float = 0.25) -> DataFrame:
    """``measured`` with the host's rates and ``kept``.

    A small table of hosts (by its counted bytes) is broadcast.  Beyond that the join is on
    host and salt: every verdict is repeated once per salt, so that a host
    with a third of all documents is spread over ``SALTS`` tasks.
    """
    verdicts = materialize(host_verdicts(measured, bad_rate), "hosts").withColumnRenamed("host", "v_host")
    if small_enough(verdicts):
        joined = measured.join(F.broadcast(verdicts), F.col("host").eqNullSafe(F.col("v_host")), "left")
    else:
        salted = measured.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
        copies = verdicts.withColumn("v_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = shuffled(salted, copies, F.col("host").eqNullSafe(F.col("v_host")) & (F.col("salt") == F.col("v_salt")), "left").drop("salt", "v_salt")
    against = None
    for r in RULES:
        hit = F.col(r) & F.coalesce(F.col(f"bad_{r}"), F.lit(False))
        against = hit if against is None else against | hit
    return joined.drop("v_host").withColumn("kept", ~F.col("base_failed") & ~against)


def quality_rules(docs: DataFrame, bad_rate: float = 0.25) -> DataFrame:
    """Counts, rule failures, host rates and the verdict of every document.

    ``docs`` has doc_id, text and source; other columns are ignored.  Base
    rules reject a document by itself (under 50 words, or over half of its
    words in repeated 3-word windows).  Each further rule (symbols, repeated
    lines, word length) rejects a document that fails it only where its host
    has a shrunk failure rate above ``bad_rate``.  A null or blank text has
    zero words and fails the base rule; documents without a source form one
    host; repeated rows are judged each; an empty table gives no rows.  Windows
    are the same where the 64-bit hashes of their words' hashes are (two given
    ones that differ share one with a probability of about 2**-64).
    """
    measured = materialize(measure(docs, ["doc_id"]), "rules")
    return judge(measured, bad_rate).select("row.doc_id", *[c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], F.col("host").alias("source"), *[F.round(f"host_{r}", 6).alias(f"host_{r}") for r in RULES])


def keep_by_rules(docs: DataFrame, bad_rate: float = 0.25) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Null and blank texts fail the base rule and go; repeated rows are judged
    each and stay or go together; a null source is a host of its own; an empty
    table stays empty.
    """
    measured = materialize(measure(docs, docs.columns), "rules")
    return judge(measured, bad_rate).where("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Rules on every document and its host: see ``quality_rules``, nulls and repeats included; an empty table gives no rows."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, w FROM w WHERE len(w) > 3
), tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM g WHERE i <= len(w) - 2
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY doc_id
), ln AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w
), m AS (
  SELECT w.doc_id, w.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS f1,
         100 * n_dup_lines > 30 * n_lines AS f2, word_chars > 14 * n_words OR word_chars < 2 * n_words AS f3 FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (f1) AS f1, count(*) FILTER (f2) AS f2, count(*) FILTER (f3) AS f3 FROM f GROUP BY source
), p AS (
  SELECT avg(f1 / n) AS m1, var_pop(f1 / n) AS v1, avg(f2 / n) AS m2, var_pop(f2 / n) AS v2, avg(f3 / n) AS m3, var_pop(f3 / n) AS v3 FROM h
), q AS (
  SELECT m1, m2, m3, greatest(1, least(1000, CASE WHEN v1 > 0 THEN m1 * (1 - m1) / v1 - 1 ELSE 1000 END)) AS w1,
         greatest(1, least(1000, CASE WHEN v2 > 0 THEN m2 * (1 - m2) / v2 - 1 ELSE 1000 END)) AS w2,
         greatest(1, least(1000, CASE WHEN v3 > 0 THEN m3 * (1 - m3) / v3 - 1 ELSE 1000 END)) AS w3 FROM p
), r AS (
  SELECT source, (f1 + m1 * w1) / (n + w1) AS r1, (f2 + m2 * w2) / (n + w2) AS r2, (f3 + m3 * w3) / (n + w3) AS r3 FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (f1 AND r1 > 0.25) AND NOT (f2 AND r2 > 0.25) AND NOT (f3 AND r3 > 0.25) AS kept,
       f.source, round(r1, 6) AS host_fail_symbols, round(r2, 6) AS host_fail_lines, round(r3, 6) AS host_fail_length
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
