"""Substring dedup of rows that share a doc_id but not their words."""

import hashlib
import random
import re

from waymark.llm import store, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows):
    """Documents by (doc_id, hash of the words); a word goes if a window over it starts earlier elsewhere."""
    key = lambda words: next(iter(substrings._measure(_batch(words))))
    words = [WORD.findall(t or "") for _, t in rows]
    order = {}
    for (doc_id, _), w in zip(rows, words):
        if doc_id is not None:
            order[(doc_id, key(w).column("key")[0].as_py(), tuple(w))] = w
    seen, gone = {}, {}
    for k in sorted(order):
        w = order[k]
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone.setdefault(k[0::2], set()).update(range(i, i + 20))
            seen.setdefault(window, k)
    out = []
    for (doc_id, _), w in zip(rows, words):
        lost = gone.get((doc_id, tuple(w)), set())
        kept = " ".join(x for i, x in enumerate(w) if i not in lost)
        out.append((doc_id, len(w), len(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _batch(words):
    import pyarrow as pa

    return [pa.RecordBatch.from_pydict({"doc_id": [0], "text": [" ".join(words)]})]


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_conflicting_rows_stay_apart(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    a = text(30)
    b = text(10) + " " + a + " " + text(2)
    rows = [(2, a), (5, a), (5, b), (7, "q " + b)]
    got = result(substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(got) == 4 and got == by_hand(rows)
    assert sorted(r[2] for r in got) == [0, 30, 30, 42]


def test_conflicts_repeats_and_nulls(spark):
    rnd = random.Random(12)
    parts = [" ".join(f"v{rnd.randrange(300)}" for _ in range(rnd.choice([5, 24, 40]))) for _ in range(12)]
    rows = [(rnd.randrange(9), " ".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 5)))) for _ in range(80)]
    rows += [(3, None), (3, ""), (None, parts[1] + " " + parts[2]), (4, rows[0][1]), (4, rows[0][1].replace(" ", "\n")), *rows[:10]]
    got = result(substrings.dedup_substrings(spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, number string, key int").repartition(3)))
    assert got == by_hand(rows)


def test_buckets_are_bounded(spark):
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "7")
    try:
        kept = store.keyed(spark.range(100).withColumnRenamed("id", "k"), "k", 100_001, "some")
        assert kept.count() == 100 and not [t for t in spark.catalog.listTables() if t.name.startswith("waymark_")]
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
