"""The URL filter, the prefix trie and the spelling variants on awkward rows, against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import spelling, trie, url_filter as uf

# URL filter


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/1?x=1", "https://www.example.org/es", "https://example.org/en/12#top", "http://a.b.example.org/en/2", "http://notexample.org/es/", "ftp://x.com/fr/", "ftp://com/de/",
    "http://X.COM/de/9", "http://x.com/DE/9", "http://x.com?y=/de/", "http://org", "http://org/", "http://x.org#/es/", "a://b://c.com/de/", "http://münchen.com/fr/ü", "http://x.com:80/de/", "https://casino-bonus.info/slots/free", "https://garden.info/en/4",
    "http://" + "a." * 3000 + "com/de/" + "x/" * 50_000, "http://line\nbreak.com/de/\n?q",
]


def judge(url, rules=uf.RULES):
    at = -1 if url is None else url.find("://")
    rest = "" if at < 0 else url[at + 3 :]
    host = re.match(r"(?s)[^/?#]*", rest).group()
    path = re.match(r"(?s)[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


@pytest.fixture(scope="module")
def model(spark):
    return uf.fit(uf.labelled_urls(spark))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "<p>", "clash", "clash") for i, u in enumerate(URLS)] + [(5, URLS[5], None, None, None), (None, URLS[4], None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, score string").repartition(3)


@pytest.mark.parametrize("few", [True, False])
def test_url_rules_are_a_loop(spark, model, pages, monkeypatch, few):
    if not few:
        monkeypatch.setattr(uf, "small_enough", lambda r: False)
    got = uf.url_filter(pages, uf.rules_table(spark), model).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule = judge(URLS[4 if r["page_id"] is None else r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]), r
        assert r["verdict"] == (rule[1] if rule else "block" if r["score"] >= 0.5 else "allow")


def test_url_rules_that_clash_or_are_odd(spark, model, pages):
    rules = [("allow", "com", "/de/"), ("block", "com", "/de/"), ("maybe", "com", "/fr/"), (None, "com", "/"), ("block", None, "/"), ("block", "com", "de"), ("allow", "x.com", "")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in uf.url_filter(pages, uf.rules_table(spark, rules), model).collect()}
    assert got[11] == ("com/de/", "block") and got[9] == ("x.com", "allow") and got[8][0] is None
    none = uf.url_filter(pages, uf.rules_table(spark).where("false"), model).collect()
    assert len(none) == len(URLS) + 2 and {r["rule"] for r in none} == {None}
    assert uf.url_filter(pages.where("false"), uf.rules_table(spark), model).count() == 0


def test_url_scores(spark, model, pages):
    got = {r["page_id"]: r["score"] for r in uf.url_filter(pages, uf.rules_table(spark), model).collect()}
    assert got[0] == got[1] == got[2] < 0.5 and got[20] > 0.5 > got[21] and all(0 <= p <= 1 for p in got.values())
    text = lambda *x: pa.array(x, pa.string())
    # one row's features do not depend on its neighbours
    alone = uf.score(model, text("casino-bonus.info"), text("/slots/free"))
    assert np.allclose(uf.score(model, text("x", "casino-bonus.info", ""), text("/y", "/slots/free", "")), [uf.score(model, text("x"), text("/y"))[0], alone[0], got[0]])
    assert uf.fit(spark.createDataFrame([("http://a.b/", 1), (None, 0), ("x", 5)], "url string, label int")).offset > 0
    assert uf.fit(spark.createDataFrame([], "url string, label int")).offset == 0


def test_url_model_on_names_it_has_not_seen(spark):
    """Every fifth name is held out at all its places."""
    rows = [r for r in uf.labelled_urls(spark).collect() if r["url"] != "about:blank"]
    names = sorted({re.sub(r"^https://(www\.|m\.|blog\.)?", "", r["url"]).split(".example")[0] for r in rows})
    out = set(names[::5])
    name = lambda r: re.sub(r"^https://(www\.|m\.|blog\.)?", "", r["url"]).split(".example")[0]
    model = uf.fit(spark.createDataFrame([r for r in rows if name(r) not in out], "url string, label int"))
    test = [r for r in rows if name(r) in out]
    parts = [judge(r["url"])[:2] for r in test]
    p = uf.score(model, pa.array([h for h, _ in parts]), pa.array([x for _, x in parts]))
    assert np.mean((p >= 0.5) == np.array([r["label"] for r in test])) > 0.7


# prefix trie


def trie_by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.md5(f"{role}\n{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(abs(c) % 100 * (1 if c >= 0 else -1)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda v: [x for x in members if len(x) == len(v) + 1 and x[: len(v)] == v]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in m if len(built[c]) == len(node))
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(kids(node)), sum(not kids(x) for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def awkward_conversations():
    rnd = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 216), -7, -150, 10**15 + 7]:
        for i in range(rnd.choice([1, 1, 2, 3, 5, 7])):
            rows.append((c, i, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "é" * 3, "c\nd"])))
    rows += [(c, i, "user", f"copy {i}") for c in range(300, 340) for i in range(9)]  # copies of one conversation
    rows += [(400, i, "user", str(i % 3)) for i in range(60)] + [(401, i, "user", str(i % 3)) for i in range(70)]  # long ones
    rows += [(5, None, "user", "x"), (5, None, "user", "y"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (5, 1, None, None), (6, 0, None, "z"), (6, 0, None, "z"), (None, 0, "user", "q"), (500, None, None, None)]
    return rows


CONV = "conv_id long, turn long, role string, text string"


def nodes(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_trie_is_a_loop(spark, tmp_path, monkeypatch, small):
    if small:  # a sketch that proves little, pieces and ranges that cut nodes and conversations
        monkeypatch.setattr(trie, "_cells", lambda a, b, d, width, f=trie._cells: f(a, b, d, 16))
        monkeypatch.setattr(trie, "PIECE", 3)
        monkeypatch.setattr("waymark.operators.scan.RANGE_ROWS", 60)
    rows = awkward_conversations()
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], CONV + ", depth int, last string, node string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert nodes(trie.op12_prefix_trie(spark, str(tmp_path))) == trie_by_hand(rows)


def test_trie_of_little(spark, tmp_path):
    for name, rows in (("none", []), ("no_id", [(None, 1, "a", "b")]), ("silent", [(101, 0, "user", "x"), (107, 0, "user", "x")]), ("one", [(0, 0, "u", "a"), (0, 1, "u", "b")])):
        spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        assert nodes(trie.op12_prefix_trie(spark, f"{tmp_path}/{name}")) == trie_by_hand(rows)


def test_sketch_never_undercounts(spark):
    rnd = random.Random(4)
    keys = [(rnd.randrange(-(1 << 62), 1 << 62), rnd.randrange(1 << 62), rnd.randrange(1, 9)) for _ in range(3000)]
    rows = keys + keys[:1000]
    df = spark.createDataFrame(rows, "pa long, pb long, depth long").repartition(9)
    counts, width = trie.sketch(df, 1)
    found = trie.screened(df.withColumns({"ha": F.lit(0).cast("long"), "hb": F.lit(0).cast("long")}), counts, width).where("alone").collect()
    twice = set(keys[:1000])
    assert not any((r["pa"], r["pb"], r["depth"]) in twice for r in found) and len(found) > 1900


# spelling variants


def words_by_hand(rows, garble=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if garble and h % garble == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts):
    form, n_near = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if near(v, w)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        n_near[w], form[w] = len(close), best if best is not None and counts[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, n_near[w], counts[form[w]] if form[w] else None) for w, n in counts.items()), key=str)


def table(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def spelled_words():
    rnd = random.Random(6)
    out = Counter()
    for w in ["baatbaat", "aaaaaa", "aaaaaaa", "aaaaaaaa", "éclairs", "abcdef", "abcde×", "ÿÿÿÿÿÿ", "zürich-öst".replace("-", "")]:
        out[w] = rnd.choice([5, 5, 30, 900])
        for _ in range(12):
            at, c = rnd.randrange(len(w) + 1), rnd.choice("abéz×")
            v = rnd.choice([w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :]])
            if len(v) >= 6:
                out[v] += rnd.choice([5, 6, 7, 40, 200])
    out |= Counter({"chained": 5, "chainef": 25, "chaigef": 125, "chaugef": 625, "tiesabc": 50, "tiesabd": 50, "tiesabe": 10, "hugeword" * 2000: 6, "hugeword" * 2000 + "s": 40})
    return dict(out)


@pytest.mark.parametrize("span", [3, 200_000])
def test_variants_are_a_loop(spark, monkeypatch, span):
    monkeypatch.setattr(spelling, "RANGE", span)
    counts = spelled_words()
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert table(spelling.spelling_variants(df)) == variants_by_hand(counts)


def test_trie_nodes_are_prefixes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "RANGE", 4)
    words = sorted(spelled_words())
    got = spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "w string"), "w", len(words)).collect()
    number, prefixes = {}, defaultdict(set)
    for r in got:
        assert len(r["nodes"]) == len(r["w"])
        for i, x in enumerate(r["nodes"]):
            assert number.setdefault(r["w"][: i + 1], x) == x
            prefixes[x].add(r["w"][: i + 1])
    assert all(len(p) == 1 for p in prefixes.values()) and sorted(prefixes) == list(range(1, len(prefixes) + 1))
    last = {r["w"]: r["nodes"][-1] for r in got}
    assert [last[w] for w in words] == sorted(last.values())


def test_word_counts_are_a_loop(spark, tmp_path, monkeypatch):
    rnd = random.Random(8)
    vocab = ["hostel", "Hostel", "hostels", "HÔTELS", "hôtels", "short", "zweiundzwanzig", "naïveté", "x×yz÷abc"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 40)))) for i in range(300)]
    rows += [(None, "hostel hostel Hostelß"), (7, None), (8, ""), (9, "abcdefgh" * 1000), (9, "abcdefgh" * 1000), (10, "-1_hostel2hostels"), (11, " ".join(["hostel"] * 20_000))]
    monkeypatch.setattr(spelling, "SLICE", 100)
    monkeypatch.setattr(spelling, "HELD", 5)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(4)
    for garble in (199, 7, None):
        assert {r["word"]: r["n"] for r in spelling.word_counts(df, garble).collect()} == words_by_hand(rows, garble)
    df.write.parquet(f"{tmp_path}/some/documents.parquet")
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert table(spelling.op13_spelling_variants(spark, f"{tmp_path}/some")) == variants_by_hand(words_by_hand(rows))
    assert table(spelling.op13_spelling_variants(spark, f"{tmp_path}/none")) == []
