"""Spelling variants: words one insertion, deletion or replacement apart, by pairs of trie nodes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from waymark.llm.store import materialize

#: The letters of a word after A-Z were lower-cased; code points and occurrences that a word has at least.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: Characters of a text that are cut into words at a time, words that a task counts before it hands them on, and words of one sorted range.
SLICE, HELD, RANGE = 1 << 18, 100_000, 200_000


def _slices(text: str, run: re.Pattern) -> Iterator[tuple[int, int]]:
    """Stretches of about SLICE characters that cut no run."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        cut = run.match(text, end)
        end = cut.end() if cut else end
        yield at, end
        at = end


def word_counts(docs: DataFrame, garble: int | None = None, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """word and n: the runs of letters of all whole texts, A-Z lower-cased, that have ``length`` code points and ``least`` occurrences.

    With ``garble``, a run of a document whose crc32 (of doc_id, a colon and the
    run) is divisible by it loses the code point at that crc32 modulo its
    length, in all its places.  Null texts have no words; a null doc_id counts
    as empty; repeated rows count each.  Tasks count what they read before it
    is shuffled.
    """
    any_run, run = re.compile(f"[{LETTERS}]+"), re.compile(f"[{LETTERS}]{{{length},}}")

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                text = pc.ascii_lower(batch.column("text").slice(i, 1))[0].as_py()
                prefix = zlib.crc32(f"{batch.column('doc_id')[i].as_py() or ''}:".encode())
                for a, b in _slices(text or "", any_run):
                    for word, n in Counter(run.findall(text, a, b)).items():
                        if garble is not None:
                            h = zlib.crc32(word.encode(), prefix)
                            if h % garble == 0:
                                word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        counts[word] += n
                    if len(counts) >= HELD:
                        yield out(counts)
                        counts = Counter()
        yield out(counts)

    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.length("word") >= length))


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def trie_nodes(words: DataFrame, key: str, rows: int) -> DataFrame:
    """``key`` (distinct strings) and ``nodes``: the numbers of the trie nodes of its prefixes of 1, 2, ... code points.

    Nodes are numbered from 1 in the order of the sorted strings, so that equal
    prefixes, and only these, have one number, and a later string's own number
    is larger.  Sorted ranges are numbered each by itself; prefixes of a range's
    first string, which may belong to ranges before it, are negative until the
    edges of all ranges (a row each) are known.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, stack, n, part = None, [], 0, TaskContext.get().partitionId()
        for batch in batches:
            strings, nodes = batch.column(0).to_pylist(), []
            for s in strings:
                if before is None:
                    stack = [-i - 1 for i in range(len(s))]
                else:
                    same = _shared(before, s)
                    stack[same:] = range(n + 1, n + 1 + len(s) - same)
                    n += len(s) - same
                before = s
                nodes.append(stack.copy())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(strings), pa.int64()), pa.array(strings, pa.string()), pa.array(nodes, pa.list_(pa.int64()))], names=["part", key, "nodes"])

    ranges = words.select(key).repartitionByRange(1 + rows // RANGE, key).sortWithinPartitions(key)
    local = materialize(ranges.mapInArrow(number, f"part long, {key} string, nodes array<long>"), "trie-nodes")
    edges = local.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("nodes", key).alias("path"), F.greatest(F.max(F.array_max("nodes")), F.lit(0)).alias("own"))
    found, used, last, path = [], 0, "", []
    for e in edges.orderBy("part").collect():  # a row per range
        same = _shared(last, e["first"])
        firsts = path[:same] + [used + i + 1 for i in range(len(e["first"]) - same)]
        used += len(e["first"]) - same
        found.append((e["part"], firsts, used))
        last, path = e["last"], [firsts[-x - 1] if x < 0 else x + used for x in e["path"]]
        used += e["own"]
    known = words.sparkSession.createDataFrame(found, "part long, firsts array<long>, used long")
    global_ = F.transform("nodes", lambda x: F.when(x < 0, F.get("firsts", (-x - 1).cast("int"))).otherwise(x + F.col("used")))
    return local.join(F.broadcast(known), "part").select(key, global_.alias("nodes"))


#: Of the words at a pair of nodes: the word that is the two joined, words that lose a code point between them, and those among the latter of which no equal code point follows.
WHOLE, HOLE, LAST_HOLE = 0, 1, 2


def _node_pairs(words: DataFrame) -> DataFrame:
    """before, after, role, id and n: every pair of a prefix's and a suffix's node that make up a word (``nodes``, ``ends``), whole or but for one code point."""
    size = F.size("nodes")
    prefix = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("nodes", i - 1))
    suffix = lambda i: F.when(i == size, F.lit(0)).otherwise(F.get("ends", size - i - 1))
    pair = lambda a, b, role: F.struct(prefix(a).alias("before"), suffix(b).alias("after"), role.cast("byte").alias("role"))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, i, F.lit(WHOLE)))
    follows = lambda i: (i + 1 < size) & (F.get("letters", i) == F.get("letters", i + 1))
    holes = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, i + 1, F.when(follows(i), HOLE).otherwise(LAST_HOLE)))
    d = words.withColumn("letters", F.split("word", ""))
    return d.select("id", "n", F.explode(F.concat(whole, holes)).alias("p")).select("p.*", "id", "n")


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near and best (n and -id of the near word of largest n, ties to the smallest id) of every word that has near ones.

    ``words`` has word, id, n, nodes and ends (its nodes in the tries of the
    words and of the reversed ones).  Words at one pair of nodes differ in one
    replaced code point (both lose one there) or in an inserted one (one is
    whole); a word that can lose one of several equal neighbours counts at the
    last of them only, so every near pair is met once.  A pair of nodes has a
    word per letter of the alphabet and one at most: what meets is bounded.
    """
    by = F.struct("before", "after")
    groups = _node_pairs(words).groupBy(by.alias("at")).agg(F.collect_list(F.struct("role", "id", "n")).alias("met")).where(F.size("met") > 1)
    rank = lambda x: F.struct(x["n"].alias("n"), (-x["id"]).alias("minus"))
    best = lambda c: F.sort_array(F.transform(c, rank), False)
    holes, last, whole = F.filter("met", lambda x: x["role"] != WHOLE), F.filter("met", lambda x: x["role"] == LAST_HOLE), F.filter("met", lambda x: x["role"] == WHOLE)
    groups = groups.select("met", F.slice(best(holes), 1, 2).alias("top"), F.size(holes).alias("holes"), F.get(best(last), 0).alias("top_last"), F.size(last).alias("last"), F.get(F.transform(whole, rank), 0).alias("whole"))

    def near(x):
        other = F.when(F.get("top", 0)["minus"] == -x["id"], F.get("top", 1)).otherwise(F.get("top", 0))
        shorter = F.when(x["role"] == LAST_HOLE, F.col("whole"))
        of_hole = F.struct(x["id"].alias("id"), (F.col("holes") - 1 + shorter.isNotNull().cast("int")).alias("near"), F.greatest(other, shorter).alias("best"))
        return F.when(x["role"] == WHOLE, F.struct(x["id"].alias("id"), F.col("last").alias("near"), F.col("top_last").alias("best"))).otherwise(of_hole)

    each = groups.select(F.explode(F.transform("met", near)).alias("w")).select("w.*").where("near > 0")
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root (the last id on the way of forms) of every row of ``forms`` (id, form), which has no circles; ways double every round."""
    at = materialize(forms.select("id", F.col("form").alias("root")), "ways")
    while True:
        on = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = materialize(at.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        at = step.select("id", "root")
        if not step.where("moved").limit(1).count():
            return at


def spelling_variants(counts: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of ``counts`` (word and n; words distinct, none null or empty).

    Near words differ by one inserted, deleted or replaced code point.  The form
    is the near word of largest n (ties: smallest in code-point order) if that
    is ``times`` the word's at least, else null; the root is reached by following
    forms.  Without words there are no rows.
    """
    counts = materialize(counts.select("word", "n"), "words")
    rows = counts.count()
    forward = trie_nodes(counts, "word", rows)
    back = trie_nodes(counts.select(F.reverse("word").alias("drow")), "drow", rows).select(F.reverse("drow").alias("word"), F.col("nodes").alias("ends"))
    words = counts.join(forward, "word").join(back, "word").withColumn("id", F.element_at("nodes", -1))
    words = materialize(words, "trie-words")
    found = words.select("id", "word", "n").join(near_words(words), "id", "left")
    form = F.when(F.col("best.n") >= F.lit(times) * F.col("n"), -F.col("best.minus"))
    found = materialize(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form_id"), F.when(form.isNotNull(), F.col("best.n")).alias("form_n")), "near-words")
    led = found.where("form_id is not null").select("id", F.col("form_id").alias("form"))
    ways = led.join(roots(led), "id").select("id", F.col("root").alias("root_id"))
    named = lambda name: words.select(F.col("id").alias(f"{name}_id"), F.col("word").alias(name))
    ways = materialize(ways, "roots")
    # a word is the form of its near words at most, some hundred for each of its letters
    ways = ways.join(named("root"), "root_id").select("id", "root")
    forms = led.withColumnRenamed("form", "form_id").join(named("form"), "form_id").select("id", "form")
    d = found.join(forms.join(ways, "id"), "id", "left")
    return d.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of ``documents``, some of them garbled: see ``word_counts`` and ``spelling_variants``, nulls and repeats included.

    An empty table gives no rows; other columns are ignored.
    """
    return spelling_variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), garble=199))


_ROUND = "list_transform({}, lambda v: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)"


def _rounds(n: int) -> str:
    return _ROUND.format(_rounds(n - 1)) if n else "range(256)::UBIGINT[]"


_BYTES = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::UBIGINT] ELSE [192 + ord(x) // 64, 128 + ord(x) % 64]::UBIGINT[] END))"

SQL = f"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT {_rounds(8)} AS t),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY 1, 2
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::UBIGINT, {_BYTES}), lambda c, b: xor(c >> 8, t[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h FROM runs, crc_table
), words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5
), holes AS MATERIALIZED (
  SELECT word, substr(word, 1, i) AS l, substr(word, i + 2) AS r FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), shorter AS (
  SELECT DISTINCT h.word AS word, w.word AS near FROM holes h JOIN words w ON w.word = h.l || h.r
), near AS (
  SELECT a.word, b.word AS near FROM holes a JOIN holes b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION ALL SELECT word, near FROM shorter UNION ALL SELECT near, word FROM shorter
), best AS (
  SELECT near.word, count(*) AS n_near, arg_max(w.word, (w.n, -o)) AS near, max(w.n) AS near_n
  FROM near JOIN (SELECT *, row_number() OVER (ORDER BY word) AS o FROM words) w ON w.word = near.near GROUP BY 1
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS root, 0 AS steps FROM words UNION ALL SELECT ways.word, form, steps + 1 FROM ways JOIN forms ON forms.word = ways.root WHERE form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY 1) USING (word)
"""
