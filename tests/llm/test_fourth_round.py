"""Joins with tables that grow: Spark's own setting broadcasts none of them, as it sizes them by their compressed files and before an explode."""

import importlib

import pytest
from pyspark.sql import functions as F

from waymark.llm import chat, jaccard, mixing, quality_rules, spread, substrings, trie

MODULES = ("chat", "jaccard", "mixing", "quality_rules", "spread", "substrings", "trie")
OWN = "spark.sql.autoBroadcastJoinThreshold"


def broadcasts(df, most):
    spark = df.sparkSession
    before = spark.conf.get(OWN)
    spark.conf.set(OWN, most)
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
    finally:
        spark.conf.set(OWN, before)


@pytest.fixture
def spark_adds(monkeypatch):
    """Labels of the tables, and of the result given, in whose plans Spark would broadcast what the code does not."""
    found = []

    def look(df, label):
        if broadcasts(df, "1g") != broadcasts(df, "-1"):
            found.append(label)

    for name in MODULES:
        module = importlib.import_module(f"waymark.llm.{name}")
        if hasattr(module, "materialize"):
            own = module.materialize
            monkeypatch.setattr(module, "materialize", lambda df, label, *more, own=own: (look(df, label), own(df, label, *more))[1])
    monkeypatch.setattr(spread, "BROADCAST_BYTES", -1)  # every table is too large by its counted bytes

    def of(result):
        look(result, "result")
        return found

    return of


def talk(spark):
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], f"said {c // 10} {t}") for c in range(40) for t in range(c % 7)]
    return spark.createDataFrame([*rows, (None, 1, "user", "x"), (3, None, "user", "y"), (3, 1, "user", "z"), (3, 1, "user", "z")], "conv_id long, turn long, role string, text string").repartition(3)


def test_chat_participants_are_not_broadcast(spark, monkeypatch, spark_adds):
    df = talk(spark)
    salted = chat.rotate(df)
    assert spark_adds(salted) == []
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 8 << 20)
    assert sorted(map(str, salted.collect())) == sorted(map(str, chat.rotate(df).collect()))


def test_trie_prefixes_are_not_broadcast(spark, monkeypatch, spark_adds, tmp_path):
    talk(spark).write.parquet(f"{tmp_path}/conversations.parquet")
    salted = trie.op12_prefix_trie(spark, str(tmp_path))
    assert spark_adds(salted) == []
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 8 << 20)
    assert sorted(map(str, salted.collect())) == sorted(map(str, trie.op12_prefix_trie(spark, str(tmp_path)).collect()))


def as_text(df):
    return sorted(map(str, df.collect()))


def test_sets_are_not_broadcast(spark, docs, monkeypatch, spark_adds):
    monkeypatch.setattr(jaccard, "GROUP", 4)  # the parts of large groups too
    kept = jaccard.keep_one(docs)
    assert spark_adds(kept) == []
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 8 << 20)
    assert as_text(kept) == as_text(jaccard.keep_one(docs))


def test_first_documents_are_not_broadcast(spark, docs, monkeypatch, spark_adds):
    salted = substrings.dedup_substrings(docs)
    again = substrings.dedup_substrings(docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more")))))  # ids with several texts
    assert spark_adds(salted) == [] and spark_adds(again) == []
    salted, again = as_text(salted), as_text(again)
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 8 << 20)
    assert salted == as_text(substrings.dedup_substrings(docs))
    assert again == as_text(substrings.dedup_substrings(docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))))


def test_hosts_and_slots_are_not_broadcast(spark, docs, monkeypatch, spark_adds):
    stages = [lambda: quality_rules.keep_by_rules(docs), lambda: mixing.keep_mixed(docs, 7), lambda: mixing.keep_mixed(docs.unionByName(docs), 7)]
    salted = [stage() for stage in stages]
    for df in salted:
        assert spark_adds(df) == []
    salted = [as_text(df) for df in salted]
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 8 << 20)
    assert salted == [as_text(stage()) for stage in stages]
