"""The operators on documents against brute force, on awkward rows."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import bpe, classifier, jaccard, mixing, quality_rules, secrets, spread, substrings, token_store
from waymark.llm.fm_index import FmIndex

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHA = lambda b: hashlib.sha256(b).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# quality rules


def rule_counts(text):
    w = WORDS.findall(text or "")
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("few", [0, 48])
def test_quality_rules(docs, rows, monkeypatch, few):
    monkeypatch.setattr(quality_rules, "FEW", few)
    got = by_id(quality_rules.quality_rules(docs))
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        r, want = got[doc], rule_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_rules_salted_join(docs, monkeypatch):
    want = by_id(quality_rules.quality_rules(docs))
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    assert by_id(quality_rules.quality_rules(docs)) == want


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"word{i}***" for i in range(60))
    rows = [(i, bad if i < 30 else good, "h0") for i in range(40)] + [(100 + i, bad if i == 0 else good, f"h{1 + i % 5}") for i in range(200)]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not got[0].kept and got[35].kept  # a host of failures: the failing document goes, the clean one stays
    assert got[100].kept  # one failure at a good host


def test_keep_by_rules(docs, empty, repeated):
    kept = quality_rules.keep_by_rules(docs)
    assert kept.columns == docs.columns
    want = {d for d, r in by_id(quality_rules.quality_rules(docs)).items() if r.kept}
    assert set(by_id(kept)) == want
    assert quality_rules.keep_by_rules(repeated).count() == 2 * len(want)
    assert quality_rules.keep_by_rules(empty).count() == 0 and quality_rules.quality_rules(empty).count() == 0


# n-gram Jaccard join


def shingles(text):
    w = WORDS.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_truth(rows):
    sets = {d: shingles(t) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("group", [512, 4])
def test_jaccard_join(docs, rows, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    got = {d: (r.n_shingles, r.component_id) for d, r in by_id(jaccard.jaccard_join(docs)).items()}
    assert got == jaccard_truth(rows)


def test_jaccard_odd_tables(spark, docs, empty, repeated):
    assert jaccard.jaccard_join(empty).count() == 0
    one = by_id(jaccard.jaccard_join(docs))
    twice = jaccard.jaccard_join(repeated).collect()
    assert len(twice) == 2 * len(one) and {(r.doc_id, r.component_id) for r in twice} == {(d, r.component_id) for d, r in one.items()}
    null = jaccard.jaccard_join(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in null} == {(None, None), (4, 4)}


def test_keep_one(spark, docs, rows, repeated, empty):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, (_, c) in jaccard_truth(rows).items() if d == c}
    assert set(by_id(kept)) == want
    once = jaccard.keep_one(repeated).collect()  # repeated rows are one document
    assert len(once) == len(want) and {r.doc_id for r in once} == want
    odd = jaccard.keep_one(spark.createDataFrame([(None, "a b"), (None, "a b"), (4, None), (9, "a b"), (8, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in odd) == [(0, "a b"), (0, "a b"), (4, ""), (8, "a b")]
    assert jaccard.keep_one(empty).count() == 0


@pytest.mark.parametrize("group", [6, 40])
def test_large_groups(spark, monkeypatch, group):
    """Near copies of one text, chains and texts that share rare shingles only: groups of several levels of blocks."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    rnd = np.random.default_rng(9)
    some = lambda n, k: [f"{k}{x}" for x in rnd.integers(0, 10**9, n)]
    texts, base = [], some(60, "b")
    for _ in range(120):
        w = list(base)
        w[int(rnd.integers(0, 60))] = f"e{rnd.integers(0, 10**9)}"
        texts.append(" ".join(w))
    for i in range(25):  # a chain, each linked with the next ones only
        texts.append(" ".join(base[i : i + 30]))
    for _ in range(30):  # half of the text is shared, not enough for a link
        texts.append(" ".join(base[:30] + some(30, "d")))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = {d: (r.n_shingles, r.component_id) for d, r in by_id(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))).items()}
    assert got == jaccard_truth(rows)


def test_signature_tree_loses_no_pair():
    rnd = np.random.default_rng(3)
    sets = []
    for n in (3, 20, 700, 1500, 2500):
        base = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        for k in (0, 0.05, 0.1, 0.15, 0.3):
            drop = rnd.random(len(base)) < k
            new = rnd.integers(0, 2**63, int(drop.sum())).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            sets.append(np.unique(np.concatenate([base[~drop], new])))
    found = {tuple(sorted(p)) for i, j in jaccard.candidate_pairs([len(s) for s in sets], [jaccard.signature(s) for s in sets]) for p in zip(i.tolist(), j.tolist())}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            want = 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)
            assert jaccard.linked(sets[i], sets[j]) == want
            assert not want or (i, j) in found


# substring dedup


def substring_truth(rows):
    seen, out = set(), {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORDS.findall(text or "")
        gone = bytearray(len(w))
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone[i : i + 20] = b"\1" * 20
            seen.add(g)
        kept = [x for x, y in zip(w, gone) if not y]
        out[doc] = (len(w), len(w) - len(kept), SHA(" ".join(kept).encode()))
    return out


@pytest.mark.parametrize("hot", [40_000, 4])
def test_substring_dedup(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    got = {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in by_id(substrings.dedup_substrings(docs)).items()}
    assert got == substring_truth(rows)


def test_substring_odd_tables(spark, empty, docs, repeated):
    assert substrings.dedup_substrings(empty).count() == 0
    assert substrings.dedup_substrings(repeated).count() == 2 * docs.count()
    long = " ".join(f"w{i}" for i in range(30))
    r = {x.doc_id: x.n_removed for x in substrings.dedup_substrings(spark.createDataFrame([(None, long), (2, long), (5, long)], "doc_id long, text string")).collect()}
    assert r == {None: 0, 2: 0, 5: 30}


def test_fm_index():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        n, v, depth, lane = int(rnd.integers(1, 250)), int(rnd.integers(2, 6)), int(rnd.choice([4, 8, 20])), int(rnd.choice([7, 96]))
        text = np.append(rnd.integers(0, v, n), 0)
        at = defaultdict(list)
        for i in range(len(text) - depth + 1):
            if (text[i : i + depth] > 0).all():
                at[text[i : i + depth].tobytes()].append(i)
        want = np.full(len(text), -1)
        for places in at.values():
            if len(places) > 1:
                want[places] = places[0]
        index = FmIndex(text, v + 1, depth)
        assert (index.repeated(lane) == want).all()
    words = rnd.integers(1, 5000, 20_000)
    text = np.concatenate([x for a in range(0, 19_000, 500) for x in (words[a : a + 700], [0])])
    index = FmIndex(text, 5001, 20)
    held = [*index.tree.bits, *index.tree.counts, *[x for m in index.marks for x in (m.words, m.before, m.after)]]
    assert sum(x.nbytes for x in held) < 10 * len(text)  # of the index; 8 bytes a word take the words themselves


def test_substring_large_groups(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LARGE", 400)
    monkeypatch.setattr(substrings, "SHARD", 200)
    sizes = []
    bounded = substrings.bounded

    def watch(segments):
        got = bounded(segments)
        sizes.append([r[1] for r in got[0].selectExpr("lead", "octet_length(words) / 8 AS n").groupBy("lead").sum("n").collect()])
        return got

    monkeypatch.setattr(substrings, "bounded", watch)
    rnd = np.random.default_rng(4)
    phrase, licence = " ".join(f"p{i}" for i in range(12)), " ".join(f"l{i}" for i in range(26))
    some = lambda n: " ".join(f"w{x}" for x in rnd.integers(0, 10**9, n))
    near = some(60)
    rows = [(i, f"{some(15)} {phrase} {some(15)}") for i in range(150)]  # one group, whose windows are all different
    rows += [(200 + i, f"{some(4)} {licence} {some(4)}") for i in range(150)]
    rows += [(400 + i, f"{near} {some(3)} {phrase} {some(2)}") for i in range(40)]
    got = {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in by_id(substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))).items()}
    assert got == substring_truth(rows)
    assert max(sizes[0], default=0) <= 400


# BPE


@pytest.fixture(scope="module")
def word_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(docs, rows, repeated, empty, word_tokenizer):
    got = by_id(bpe.bpe_round_trip(docs))
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        ids = word_tokenizer.encode(text or "", add_special_tokens=False).ids
        assert (got[doc].n_tokens, got[doc].ids_sha256) == (len(ids), SHA(np.array(ids, "<u4").tobytes()))
        assert got[doc].decoded_sha256 == SHA(word_tokenizer.decode(ids, skip_special_tokens=False).encode())
    assert bpe.bpe_round_trip(repeated).count() == 2 * len(rows) and bpe.bpe_encode(empty).count() == 0


def test_bpe_of_long_words(word_tokenizer, monkeypatch):
    coder = bpe.Coder(public_tokenizers.path("word_bpe_49k.json"))
    rnd = np.random.default_rng(2)
    letters = "".join(rnd.choice(list("etaoinshrdlucmfw"), 30_000))
    han = "".join(chr(0x4E00 + int(x)) for x in rnd.integers(0, 3000, 20_000))
    began = time.monotonic()
    for text in (letters, "a" * 9001, "ab" * 5000 + "c", han, f"x {han} y {letters} z"):
        ids = word_tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.encode([text])[0] == np.array(ids, "<u4").tobytes()
    assert time.monotonic() - began < 60
    monkeypatch.setattr(bpe, "LONG", 3)  # every word by itself
    small = bpe.Coder(public_tokenizers.path("word_bpe_49k.json"))
    text = "The quick brown foxes jumped over lazylazylazy dogs, übermäßig naïve 12345 aaaaaaa!"
    assert small.encode([text])[0] == np.array(word_tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    began = time.monotonic()
    assert len(coder.bpe._long(("".join(rnd.choice(list("etaoinshrdlucmfw"), 1_000_000))).encode())) > 100_000
    assert time.monotonic() - began < 60


def test_bpe_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        bpe.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_decode(docs, rows, word_tokenizer):
    got = by_id(bpe.bpe_decode(bpe.bpe_encode(docs)))
    for doc, text, *_ in rows:
        assert got[doc].text == word_tokenizer.decode(word_tokenizer.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False)


# token files


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files(spark, docs, rows, byte_tokenizer, tmp_path):
    path = str(tmp_path / "tokens")
    token_store.write_tokens(docs, path)
    got, at = by_id(token_store.index_tokens(spark, path)), 0
    ids_of = by_id(token_store.read_tokens(spark, path))
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array(byte_tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert ids_of[doc].ids == ids.tobytes()
        at += len(ids)


def test_token_files_odd_tables(spark, empty, repeated, docs, tmp_path):
    token_store.write_tokens(empty, str(tmp_path / "none"))
    assert token_store.index_tokens(spark, str(tmp_path / "none")).count() == 0
    token_store.write_tokens(repeated, str(tmp_path / "twice"))
    assert token_store.index_tokens(spark, str(tmp_path / "twice")).count() == 2 * docs.count()


def test_repair_random_access():
    rnd = np.random.default_rng(1)
    ids = rnd.choice([1, 2, 3, 4, 7, 7, 7, 9], 20_000)
    s, pairs, sizes = token_store.repair(ids, 50)
    assert len(s) < len(ids) and (token_store.expand(s, pairs, sizes, 50) == ids).all()
    lengths = np.array([0, 5, 1, 700, 0, 19_294])
    shard = token_store.Shard(50, lengths, *(x.astype("<u4").tobytes() for x in (s, pairs, sizes)))
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    for i in range(len(lengths)):
        assert (shard.document(i) == ids[cuts[i] : cuts[i + 1]]).all()
        for j in range(i, len(lengths) + 1):
            assert (shard.documents(i, j) == ids[cuts[i] : cuts[j]]).all()
    shard.opened = 0
    shard.document(2)  # one id: only the rules on the way to it
    assert shard.opened <= sizes.max() and shard.opened < len(pairs) / 4


def test_repair_goes_on_to_the_end():
    rnd = np.random.default_rng(3)
    passage = rnd.integers(0, 40_000, 500)
    ids = np.concatenate([x for _ in range(6) for x in (passage, rnd.integers(0, 40_000, 300))])
    s, pairs, sizes = token_store.repair(ids, 50_000)
    assert (token_store.expand(s, pairs, sizes, 50_000) == ids).all()
    assert sizes.max() > 400  # the passage is about one symbol
    assert len(s) < 6 * 300 + 6 * 20
    both = np.stack([s[:-1], s[1:]], 1)
    assert np.unique(both, axis=0, return_counts=True)[1].max() < 4
    runs = np.full(1000, 7)
    s, pairs, sizes = token_store.repair(runs, 50)
    assert len(s) < 8 and (token_store.expand(s, pairs, sizes, 50) == runs).all()
    assert len(token_store.repair(np.zeros(0, np.int64), 50)[0]) == 0


def test_repair_of_long_runs():
    began = time.monotonic()
    for ids in (np.full(1_000_000, 7), np.concatenate([np.full(300_001, 7), np.full(300_000, 8), np.tile([7, 8, 8], 100_000)])):
        s, pairs, sizes = token_store.repair(ids, 50)
        assert len(s) < 60 and (token_store.expand(s, pairs, sizes, 50) == ids).all()
    assert time.monotonic() - began < 20


def test_text_of_very_many_pre_tokens(byte_tokenizer):
    text = " ".join(map(str, range(1_400_000)))
    began = time.monotonic()
    ids, at = token_store.Encoder().encode([text, "a b"])
    assert time.monotonic() - began < 60
    assert at[-1] == len(ids) and ids[at[1] :].tolist() == byte_tokenizer.encode("a b", add_special_tokens=False).ids
    for a in (0, 700_000, 1_399_000):  # numbers of one length: ids of a stretch of them, with what is around it
        part = " ".join(map(str, range(a, a + 1000)))
        own = byte_tokenizer.encode(" " + part if a else part, add_special_tokens=False).ids
        before = len(byte_tokenizer.encode(" ".join(map(str, range(a))), add_special_tokens=False).ids) if a else 0
        assert ids[before : before + len(own)].tolist() == own


def test_read_some_documents(spark, docs, tmp_path):
    path = str(tmp_path / "some")
    token_store.write_tokens(docs, path)
    every = by_id(token_store.read_tokens(spark, path))
    wanted = spark.createDataFrame([(0,), (75,), (-5,), (None,)], "doc_id long")
    some = by_id(token_store.read_tokens(spark, path, ids=wanted))
    assert some == {d: every[d] for d in (0, 75)}


def test_pre_tokens(byte_tokenizer):
    texts = ["", "'s", "''s", "x''s 's\n's", "  a \n\n b  ", "it's I'LL we're 're're", "a b  c\x1c", "\r\n\tx", "1a2 ½ Ⅷ 漢字!?", "'"]
    ids, at = token_store.Encoder().encode(texts)
    for text, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == byte_tokenizer.encode(text, add_special_tokens=False).ids


def test_more_pre_tokens_than_are_kept(byte_tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "KEPT", 8)
    monkeypatch.setattr(token_store.Encoder, "BITS", 4)
    encoder = token_store.Encoder()
    for texts in (["a b c"], [" ".join(f"w{i} {i * 7919}" for i in range(300))], ["a b d", "", " ".join(f"x{i}" for i in range(50))], ["a"], ["b c d e f g h"]):
        ids, at = encoder.encode(texts)
        for text, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == byte_tokenizer.encode(text, add_special_tokens=False).ids


# classifier


def test_classifier(spark, docs, rows, empty, repeated):
    good = [(i, " ".join(f"word{(i * 7 + j) % 50} flows" for j in range(40))) for i in range(1000, 1160)]
    bad = [(i, " ".join(f"WORD{(i * 7 + j) % 50}!! %%%" for j in range(40))) for i in range(2000, 2160)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    net = classifier.fit(d, labels)
    got = by_id(classifier.classify(d, net))
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].held_out == (i in held) for i in got)
    assert sum(got[i].predicted == (i < 2000) for i in held) >= 0.95 * len(held)
    odd = by_id(classifier.classify(docs, net))
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd.values())
    assert odd[0].score == odd[3].score  # null and empty
    assert classifier.classify(repeated, net).count() == 2 * len(rows) and classifier.classify(empty, net).count() == 0
    assert by_id(classifier.classify(docs, classifier.fit(empty.select("doc_id", "text"), labels)))[0].score == 0.5


def test_training_never_sees_held_out(spark):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    drawn = classifier.training_rows(d, labels, 20)
    assert len(drawn) == 40 and all(zlib.crc32(r.text.split()[1].encode()) % 4 != 2 for r in drawn)


def test_training_rows(spark):
    long = "x " * 100_000
    d = spark.createDataFrame([(i, f"text {i}" if i else long) for i in range(40)] + [(3, "another")] * 50 + [(5, None), (None, "lost")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(4, 1, 0), (6, 1, 0), (6, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.text: r.label for r in classifier.training_rows(d, labels, 30)}
    ok = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]  # labels without a document take no place
    want = {("another" if i == 3 else f"text {i}" if i else long): {4: 0, 6: 1}.get(i, i % 2) for i in ok}
    assert got == want  # long texts whole, one of repeated texts, labels by majority and 0 where they tie


def test_quality_of_the_supplied_table(spark):
    """Held-out rows of the supplied table: far better than chance, and the same on a second fit."""
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = classifier.classify(d, classifier.fit(d, labels)).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    score, y = np.array([r.score for r in got]), np.array([r.quality for r in got])
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    auc = (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
    accuracy = np.mean([r.predicted == r.quality for r in got])
    print(f"held out: {len(y)} rows, AUC {auc:.3f}, accuracy {accuracy:.3f}")
    assert len(y) > 500 and auc > 0.93 and accuracy > 0.9


# secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_truth(text):
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(spans, key=lambda s: (s[1], order[s[0]]))


def test_secrets(docs, rows, empty, repeated):
    got = by_id(secrets.scan_secrets(docs))
    for doc, text, *_ in rows:
        spans = base_truth(text or "")
        n = Counter(k for k, _, _ in spans)
        r = got[doc]
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == SHA(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(",")) or not spans
    assert secrets.scan_secrets(empty).count() == 0 and secrets.scan_secrets(repeated).count() == 2 * len(rows)


def test_confirmed_secrets():
    import base64
    import json

    b64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = f"{b64(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{b64(json.dumps({'sub': 'x'}).encode())}.c2ln"
    key = bytes([0x30, 40]) + bytes([0x02, 16]) + bytes(range(16)) + bytes([0x04, 20]) + bytes(20)
    ssh = b"\0\0\0\x07ssh-rsa\0\0\0\x03\1\0\1\0\0\0\x10" + bytes(16)
    kinds = lambda t: {k for _, _, k in secrets.confirmed_spans(t)}
    assert kinds(f"see {token} now") == {"token"}
    assert kinds(f"x {base64.b64encode(key).decode()} y") == {"key"} and kinds(f"x {base64.b64encode(ssh).decode()} y") == {"key"}
    assert kinds(f"x {key.hex()} y") >= {"hexkey"}
    assert kinds(f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(key).decode()}\n-----END PRIVATE KEY-----") >= {"pem"}
    broken = bytes([0x30, 41]) + key[2:]
    assert kinds(f"x {base64.b64encode(broken).decode()} y") == set() and kinds("x " + "QUJD" * 12 + " y") == set()
    assert kinds(f"see {b64(b'not json at all')}.{b64(b'nor this one')}.x") == set() and kinds("www.example-site.org and first.second.third") == set()
    spread = "{\n \"alg\": \"none\"}"
    assert kinds(f"see {b64(spread.encode())}.{b64(b'{}')}. now") == {"token"}
    # OpenSSH: every nested length is parsed
    field = lambda x: len(x).to_bytes(4, "big") + x
    public = field(b"ssh-ed25519") + field(bytes(32))
    whole = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(bytes(64))
    frame = lambda x, cut="\n": f"-----BEGIN OPENSSH PRIVATE KEY-----{cut}{base64.b64encode(x).decode()}{cut}-----END OPENSSH PRIVATE KEY-----"
    assert kinds(frame(whole)) >= {"pem"} and kinds(frame(whole, "\\n")) >= {"pem"}
    assert kinds(frame(whole[:-1])) == set() and kinds(frame(b"openssh-key-v1\0" + bytes(80))) == set()
    # header lines, written-out line breaks, lines without a frame
    lines = lambda x, n=64: [base64.b64encode(x).decode()[i : i + n] for i in range(0, len(base64.b64encode(x)), n)]
    big = bytes([0x30, 0x81, 150, 0x02, 100]) + bytes(range(100)) + bytes([0x04, 46]) + bytes(46)
    assert kinds("-----BEGIN PRIVATE KEY-----\\n" + "\\n".join(lines(big)) + "\\n-----END PRIVATE KEY-----") >= {"pem"}
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n"
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\n" + head + "\n".join(lines(bytes(range(160)))) + "\n-----END RSA PRIVATE KEY-----") == {"pem"}
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\nX: y\n\n" + "\n".join(lines(big)) + "\n-----END RSA PRIVATE KEY-----") >= {"pem"}
    text = "see:\n" + "\n".join(lines(big)) + "\nend of it"
    spans = [s for s in secrets.confirmed_spans(text) if s[2] == "key"]
    assert [text[a:b] for a, b, _ in spans] == ["\n".join(lines(big))]
    assert kinds("\n".join(lines(bytes(200)))) == set()


def test_redaction(docs, rows):
    got = by_id(secrets.redact_secrets(docs))
    assert secrets.redact_secrets(docs).columns == docs.columns
    doc, text = rows[-1][:2]
    assert got[doc].text == "[secret] [secret] [secret] secret:ab [secret]' <|endoftext|> x" and got[doc].n_chars == len(got[doc].text)
    assert got[0].text is None and got[24].text == rows[8][1]


# mixing


def targets_truth(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("block", [16, 1024])
def test_mixing(docs, rows, block):
    got = by_id(mixing.mix_sources(docs, block))
    size = {d: len(WORDS.findall(t or "")) for d, t, *_ in rows}
    per = defaultdict(int)
    for d, t, _, s, *_ in rows:
        per[s] += size[d]
    target = targets_truth(per)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for d, _, _, s, *_ in rows:
        r = got[d]
        assert (r.size, r.source_size) == (size[d], per[s]) and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in per:
        assert abs(taken[s] - target[s]) <= 1
    assert by_id(mixing.mix_sources(docs, block)) == got


def test_mixing_broadcasts_nothing_large(docs, monkeypatch):
    want = by_id(mixing.mix_sources(docs))
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    assert by_id(mixing.mix_sources(docs)) == want
    monkeypatch.setattr(spread, "RUN_ROWS", 2)
    assert by_id(mixing.mix_sources(docs)) == want


def test_targets_of_like_sized_sources(spark):
    for sizes in ([1000 + 7 * i for i in range(20)], [5] * 20, [1, 10_000, 3, 3, 900, 900, 2], [0, 4], [7]):
        got = mixing.source_targets(spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, size long")).collect()
        want = targets_truth({f"s{i:02d}": n for i, n in enumerate(sizes)})
        assert {r.source: pytest.approx(r.target) for r in got} == want
        assert all(0 <= r.target <= 2 * r.source_size for r in got)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_mixing_of_the_supplied_table(spark, table):
    path = f"/root/testdata/{table}/documents.parquet"
    got = mixing.mix_sources(spark.read.parquet(path)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size")).collect()
    want = targets_truth({r.source: r["size"] for r in got})
    assert len(got) == 20
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.target > 0 and 0 <= r.target - r.taken < 1


def test_mixing_odd_tables(spark, docs, empty, repeated):
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_sources(repeated).count() == 2 * docs.count()
    blank = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken) for r in blank] == [(0, 0), (0, 0)]


def test_schedule_is_spread(docs):
    t = mixing.source_targets(mixing.sizes(docs))
    slots = mixing.schedule(t, 8).collect()
    blocks = {r.source: -(-r.words // 8) for r in t.collect()}
    n = sum(blocks.values())
    assert sorted(r.slot for r in slots) == list(range(n))  # every slot is some source's, once
    for s, k in blocks.items():
        at = [r.slot for r in sorted((r for r in slots if r.source == s), key=lambda r: r["rank"])]
        assert at == sorted(at) and len(at) == k
        for cut in (n // 4, n // 2, n):  # in any first part of the schedule
            assert abs(sum(x < cut for x in at) - cut * k / n) <= 4


def test_blocks_are_equal_and_dealt_by_slot(docs, rows):
    pieces = [r for r in mixing.mix_pieces(mixing.sizes(docs).cache(), 8).collect() if r.slot is not None]
    words, source = Counter(), {}
    for r in pieces:
        words[r.slot] += r.n_words
        assert source.setdefault(r.slot, r.source) == r.source
    assert sorted(words) == list(range(len(words)))
    last = {s: max(x for x in source if source[x] == s) for s in set(source.values())}
    assert all(n == 8 or last[source[x]] == x for x, n in words.items())  # only a source's last block may be short
    got = by_id(mixing.mix_sources(docs, 8))
    per = defaultdict(list)
    for r in pieces:
        per[r.doc_id].append(r.slot)
    assert all((r.first_slot, r.n_slots) == (min(per[d], default=None), len(per[d])) for d, r in got.items())


def test_keep_mixed(docs):
    kept = mixing.keep_mixed(docs)
    assert kept.columns == docs.columns
    taken = by_id(mixing.mix_sources(docs))
    parts = defaultdict(list)
    for r in kept.withColumn("part", F.spark_partition_id()).collect():
        parts[r.part].append(r.doc_id)
    kept = [d for part in parts.values() for d in part]
    assert Counter(kept) == Counter({d: -(-r.taken // r.size) for d, r in taken.items() if r.taken})
    first = {d: r.first_slot for d, r in taken.items()}
    for part in parts.values():
        seen = list(dict.fromkeys(part))
        assert [first[d] for d in seen] == sorted(first[d] for d in seen)  # in order of slots
    assert mixing.keep_mixed(docs.limit(0)).count() == 0
