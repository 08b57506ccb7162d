"""URL filters: host and path rules, and logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.llm.spread import SALTS, small_enough
from waymark.llm.store import materialize
from waymark.llm.words import chunks, mix, utf8

#: Lengths of n-grams, in bytes, and the buckets they are hashed to.
GRAMS, BUCKETS = (3, 4, 5), 1 << 14
#: Rules of the query as verdict, host and path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A small labelled table, written by hand (no host of the supplied tables is in it): names of hosts that are blocked, and of hosts that are not, with a path each.
BLOCKED = (
    "casino-royal/slots", "online-casino/bonus", "win-casino/jackpot", "casino777/play", "bets-for-free/odds", "sports-bets/free", "betting-tips/win", "poker-win/free-chips", "lucky-slots/spin", "jackpot-win/now",
    "pills-so-cheap/buy", "pills-online/order", "cheap-meds/discount", "pharmacy-cheap/viagra", "buy-pills/cheap", "diet-pills/offer", "adult-videos/xxx", "adult-xxx/cams", "x-adult-tube/live", "hot-cams/adult", "sex-chat/adult",
    "spam-links/seo", "link-farm/backlinks", "content-farm/spam", "farm-of-spam/index", "seo-spam/links", "my-ads-tracker/click", "ad-tracker/pixel", "track-clicks/ads", "popup-ads/banner", "clickads/redirect", "trackads/beacon",
    "free-download/crack", "warez-crack/keygen", "cracked-games/torrent", "free-iphone/winner", "win-prize/claim", "phish-login/verify", "fake-bank/login-verify", "crypto-double/invest", "quick-loans/cash", "payday-cash/loans",
)
ALLOWED = (
    "library/en/1", "museum/collection", "university/courses", "weather/today", "news/world/2021", "blog.garden/posts/12", "m.recipes/en/345", "www.history/fr/78", "docs/guide/install", "wiki/page/random", "school/kinder/de/5",
    "theatre/es/620", "science/articles/7", "travel/de/north", "music/en/99.html", "books/en/4711/", "city/council/minutes", "forum/thread/88", "health/advice/flu", "research/papers/3", "shop/shoes/42", "photos/album/9",
    "maps/route/11", "radio/live", "parks/en/16", "trains/timetable", "cooking/fr/301", "film/review/77", "sport/results/8", "garden/roses/2", "hotel/rooms", "jobs/list/54", "art/gallery/1", "nature/birds/en/23",
    "the-times/opinion", "out-door/trails", "well-being/advice", "self-help/en/6", "web-design/learn", "open-data/sets", "north-sea/tides", "e-mail/help",
    "thenation/en/400", "thistle/en/850", "whether/fr/12", "tionary/es/33", "rethink/de/871", "another/en/5", "bleak-house/en/66", "inland/en/17", "shore/en/240.html", "heron/en/91/", "ounce/en/14", "endless/de/302",
)


#: Places that either kind of host is shown at, so that hosts are told apart by their names: subdomain, suffix and path (none: the name's own).
PLACES = (("", "example.net", None), ("www.", "example.com", "en/12"), ("m.", "example.org", "fr/3456.html"), ("blog.", "example.net", "es/789/"), ("", "example.com", "de/80"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url and label (1: to be blocked): every name of the small table above at every place, and a url of nothing, which is not blocked."""
    rows = [("about:blank", 0)]
    for names, label in ((BLOCKED, 1), (ALLOWED, 0)):
        for host, path in (name.split("/", 1) for name in names):
            rows += [(f"https://{sub}{host}.{end}/{path if at is None else at}", label) for sub, end, at in PLACES]
    return spark.createDataFrame(rows, "url string, label int")


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty for a null url and without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower()), path


@dataclass
class Model:
    weights: np.ndarray
    offset: float


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of every host and path, each with two marks before and one after it, and per row the first of them (one more at the end)."""
    counts = np.zeros(len(host) + 1, np.int64)
    all_rows, all_buckets = [], []
    for part, column in enumerate((host, path)):
        data, offsets = utf8(column)
        n = np.diff(offsets) + 3
        starts = np.concatenate([[0], np.cumsum(n)])
        own = np.full(starts[-1], 1 + part, np.uint64)  # a mark; bytes are 3 and up
        row = np.repeat(np.arange(len(n)), n)
        own[np.arange(len(data)) + 2 + 3 * np.repeat(np.arange(len(n)), n - 3)] = data.astype(np.uint64) + np.uint64(3)
        for k in GRAMS:
            if len(own) < k:
                continue
            h = np.zeros(len(own) - k + 1, np.uint64)
            for i in range(k):
                h = h * np.uint64(0x100000001B3) + own[i : len(own) - k + 1 + i]
            inside = row[: len(h)] == row[k - 1 :]
            all_rows.append(row[: len(h)][inside])
            all_buckets.append((mix(h[inside] + np.uint64(k * 2 + part)) % np.uint64(BUCKETS)).astype(np.int64))
    rows = np.concatenate(all_rows) if all_rows else np.zeros(0, np.int64)
    order = np.argsort(rows, kind="stable")
    counts[1:] = np.cumsum(np.bincount(rows, minlength=len(host)))
    return np.concatenate(all_buckets)[order] if all_buckets else rows, counts


def score(model: Model, host: pa.Array, path: pa.Array) -> np.ndarray:
    """Probability that a url is to be blocked: its n-grams' weights, summed over the root of their number."""
    buckets, first = features(host, path)
    if not len(host):
        return np.zeros(0)
    sums = np.add.reduceat(model.weights[buckets], first[:-1])  # marks alone make n-grams, so no row is without
    return 1 / (1 + np.exp(-np.clip(sums / np.sqrt(np.diff(first)) + model.offset, -30, 30)))


def train(host: pa.Array, path: pa.Array, labels: np.ndarray, rounds: int = 600, rate: float = 4.0, ridge: float = 1e-4) -> Model:
    """Logistic regression by gradient descent on all rows, both labels weighing the same; without rows of both labels every url has the score of the label there is."""
    model = Model(np.zeros(BUCKETS), 0.0)
    if not len(labels) or labels.min() == labels.max():
        model.offset = 0.0 if not len(labels) else 5.0 if labels[0] else -5.0
        return model
    buckets, first = features(host, path)
    n = np.diff(first)
    row, scale = np.repeat(np.arange(len(n)), n), 1 / np.sqrt(np.maximum(n, 1))
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    for _ in range(rounds):
        z = np.bincount(row, model.weights[buckets], len(n)) * scale + model.offset
        d = (1 / (1 + np.exp(-z)) - labels) * weight
        model.weights -= rate * (np.bincount(buckets, (d * scale)[row], BUCKETS) + ridge * model.weights)
        model.offset -= 0.1 * rate * d.sum()
    return model


def fit(labelled: DataFrame, most: int = 10_000) -> Model:
    """A model learned from url and label (0 or 1) of at most ``most`` distinct urls of ``labelled``, drawn by hash; of differing labels of a url the higher counts; nulls and other labels are left out."""
    host, path = host_path(F.col("url"))
    known = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).groupBy("url").agg(F.max("label").alias("label"))
    rows = known.orderBy(F.xxhash64("url"), "url").limit(most).select(host.alias("host"), path.alias("path"), "label").toArrow()
    flat = lambda c: rows.column(c).combine_chunks()
    return train(flat("host"), flat("path"), rows.column("label").to_numpy().astype(float))


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Texts (host suffix and path prefix) under which a rule of one of the ``shapes`` (labels of its host, length of its path) may fit, longest first, each with its place."""
    labels = F.size(F.split(host, r"\."))
    made = []
    for n, length in sorted(shapes, reverse=True):
        key = F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, length))
        made.append(F.when((labels >= n) & (F.length(path) >= length), key))
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with host and path) and, as ``rule`` and ``by_rule``, the longest rule that fits, and its verdict.

    ``rules`` has verdict (allow or block), host and path.  A rule fits its host
    and all subdomains where the path starts with its own.  Of rules that fit
    the one of most characters wins; of equal ones with different verdicts the
    block.  Rules with a null are left out, as are those whose path is neither
    empty nor starts with a slash.

    A url is looked up under the shapes (labels of the host, length of the path)
    that rules have, so that no rule is compared with every url.  Few rules go
    out with the tasks; more are joined, distinct urls against rules, on keys
    that are salted.
    """
    r = rules.where("verdict in ('allow', 'block') and host is not null and host <> '' and (path = '' or startswith(path, '/'))")
    r = r.groupBy(F.concat("host", "path").alias("rule")).agg(F.max("verdict").alias("by_rule"), F.first(F.size(F.split("host", r"\."))).alias("labels"), F.first(F.length("path")).alias("length"))
    r = materialize(r, "rules")
    shapes = [tuple(x) for x in r.select("labels", "length").distinct().collect()]  # bounded by the forms that rules have
    keys = _keys(F.col("host"), F.col("path"), shapes)
    longest = F.array_max(F.transform("found", lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))["rule"]
    if small_enough(r):
        verdicts = {x["rule"]: x["by_rule"] for x in r.select("rule", "by_rule").collect()}
        known = F.array(*map(F.lit, verdicts)) if verdicts else F.array().cast("array<string>")
        table = F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv]) if verdicts else F.create_map().cast("map<string,string>")
        d = pages.withColumn("found", F.filter(keys, lambda k: F.array_contains(known, k))).withColumn("rule", longest).drop("found")
        return d.withColumn("by_rule", F.try_element_at(table, F.col("rule")))
    urls = pages.select("host", "path").distinct().withColumn("key", F.explode(keys)).withColumn("_salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)))
    copies = r.select(F.col("rule").alias("key"), "by_rule").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = urls.join(copies, ["key", "_salt"]).groupBy("host", "path").agg(F.max_by(F.struct(F.col("key").alias("rule"), "by_rule"), F.struct(F.length("key"), "key")).alias("w"))
    return pages.join(met.select("host", "path", "w.*"), ["host", "path"], "left")


def url_filter(pages: DataFrame, rules: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages`` (page_id, url).

    The verdict is that of the longest rule that fits (see ``with_rules``), else
    ``block`` where the model's score is ``threshold`` at least, and ``allow``
    below.  A null url, or one without ``://``, has an empty host and path and
    is judged as such; repeated rows are judged each; an empty table gives no
    rows; other columns are ignored.  The model (128 kB) goes out with the tasks.
    """
    host, path = host_path(F.col("url").cast("string"))
    d = with_rules(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host"), batch.column("path")
            sizes = np.array([len(h) + len(p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())], np.int64)
            p = np.empty(len(sizes))
            for a, b in chunks(np.concatenate([[0], np.cumsum(sizes)])):
                p[a:b] = score(model, hosts.slice(a, b - a), paths.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "score"])

    d = d.select("page_id", "host", "path", "rule", "by_rule").mapInArrow(run, "page_id long, host string, path string, rule string, by_rule string, score double")
    judged = F.coalesce("by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return d.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    """A verdict for the url of every row of ``pages``: see ``url_filter``, nulls and repeats included."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark), fit(labelled_urls(spark)))
