"""Substring deduplication: repeated word windows found by an FM-index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waymark.llm.fm_index import FmIndex
from waymark.llm.spread import matched, running, shuffled
from waymark.llm.store import keyed, materialize
from waymark.llm.words import chunks, sequence_hashes, signed, spans, utf8, whole_hash, word_hashes

#: Words in a window, and in an anchor; of every window's anchors that of the lowest hash is posted.
WINDOW, ANCHOR = 20, 8
SPAN = WINDOW - ANCHOR + 1
#: Postings per bucket and held by a task, and words per shard, on average.
BUCKET, HELD, SHARD = 1 << 20, 3 << 19, 1 << 19
#: Bytes of text in a bucket, on average.
TEXT_BYTES = 64 << 20
#: Stretches, or words, of a group beyond which it is dealt again by whole windows.
HOT, LARGE = 40_000, 1 << 20


def texts_words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and their bounds per text, for ranges of texts."""
    for a, b in chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = spans(part, offsets[a : b + 1] - offsets[a])
        yield word_hashes(part, starts, ends), first


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    n, y = 1, x
    while 2 * n <= width:
        y = f(y[: len(y) - n], y[n:])
        n *= 2
    rest = width - n
    return f(y[: len(y) - rest], y[rest:]) if rest else y


def window_anchors(words: np.ndarray) -> np.ndarray:
    """For every window of a text, the lowest hash among its anchors."""
    return _slide(sequence_hashes(words, ANCHOR), SPAN, np.minimum)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every anchor that is the lowest one of some window."""
    grams = sequence_hashes(words, ANCHOR)
    low = _slide(grams, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), SPAN, np.maximum) == grams)
    return grams[at], at


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, keys = [], []
        for words, first in texts_words(*utf8(batch.column("text"))):
            for a, b in zip(first[:-1], first[1:]):
                n.append(int(b - a))
                keys.append(signed(whole_hash(words[a:b])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "n_words", "key"])


def _post(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def deal() -> Iterator[pa.RecordBatch]:
            gram = np.concatenate([h[0] for h in held])
            at = np.concatenate([h[1] for h in held]).astype(np.int32)
            key = np.repeat(np.array([h[2] for h in held], np.int64), [len(h[0]) for h in held])
            bucket = (gram % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            gram, at, key, bucket = gram[order], at[order], key[order], bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(bucket))):
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), *[pa.array([x[a:b].tobytes()], pa.binary()) for x in (gram, key, at)]], names=["bucket", "grams", "keys", "places"])

        for batch in batches:
            for words, first in texts_words(*utf8(batch.column("text"))):
                for a, b in zip(first[:-1], first[1:]):
                    if b - a < WINDOW:
                        continue
                    key = signed(whole_hash(words[a:b]))
                    if key in seen:  # a copy within the task
                        continue
                    seen.add(key)
                    gram, at = anchors(words[a:b])
                    held.append((gram, at, key))
                    size += len(gram)
                    if size >= HELD:
                        yield from deal()
                        held, size = [], 0
        if held:
            yield from deal()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with two places or more: the document key of each, with the smallest key as the group, packed per key."""

    def bucket(parts: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        gram, key, at = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*parts), (np.uint64, np.int64, np.int32)))
        order = np.lexsort((at, key, gram))
        gram, key, at = gram[order], key[order], at[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1]))
        gram, key, at = gram[new], key[new], at[new]
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        n = np.diff(np.append(first, len(gram)))
        live = np.repeat(n > 1, n)
        lead, key, gram = np.repeat(key[first], n)[live], key[live], gram[live]
        if not len(key):
            return
        order = np.lexsort((gram, lead, key))  # a gram's places are found again in the text
        key, lead, gram = key[order], lead[order], gram[order]
        new = np.append(True, (key[1:] != key[:-1]) | (lead[1:] != lead[:-1]) | (gram[1:] != gram[:-1]))
        key, lead, gram = key[new], lead[new], gram[new]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        bounds = list(zip(cut.tolist(), np.append(cut[1:], len(key)).tolist()))
        for i in range(0, len(bounds), 5000):
            some = bounds[i : i + 5000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(key[a]) for a, _ in some], pa.int64()), pa.array([lead[a:b].tobytes() for a, b in some], pa.binary()), pa.array([gram[a:b].tobytes() for a, b in some], pa.binary())],
                names=["key", "leads", "grams"],
            )

    now, parts = None, []
    for batch in batches:
        for b, *part in zip(*[batch.column(c).to_pylist() for c in ("bucket", "grams", "keys", "places")]):
            if b != now and parts:
                yield from bucket(parts)
                parts = []
            now = b
            parts.append(tuple(part))
    if parts:
        yield from bucket(parts)


SEGMENTS = "lead long, doc_id long, start int, words binary"


def _ranges(at: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges that windows at the sorted places cover, where windows that overlap or touch make one range."""
    cut = np.flatnonzero(np.append(True, np.diff(at) > WINDOW))
    last = np.append(cut[1:], len(at)) - 1
    return list(zip(at[cut].tolist(), (at[last] + WINDOW).tolist()))


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    lead, doc, start, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(lead, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(data, pa.binary())], names=["lead", "doc_id", "start", "words"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each document whose windows have a live anchor, by group."""
    for batch in batches:
        ids, leads, grams = (batch.column(c).to_pylist() for c in ("doc_id", "leads", "grams"))
        rows: list[tuple] = []
        i = 0
        for words, first in texts_words(*utf8(batch.column("text"))):
            for a, b in zip(first[:-1], first[1:]):
                gram = np.frombuffer(b"".join(grams[i]), np.uint64)
                lead = np.frombuffer(b"".join(leads[i]), np.int64)
                order = np.argsort(gram, kind="stable")
                gram, lead = gram[order], lead[order]
                own = words[a:b]
                low = window_anchors(own)
                at = np.searchsorted(gram, low)
                at[at == len(gram)] = 0
                window = np.flatnonzero(gram[at] == low)
                group = lead[at[window]]
                for g in np.unique(group):
                    for s, e in _ranges(window[group == g]):
                        rows.append((int(g), ids[i], s, own[s:e].tobytes()))
                i += 1
            if len(rows) > 2000:
                yield _segment_batch(rows)
                rows = []
        if rows:
            yield _segment_batch(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the stretches with the hash of its whole sequence."""
    for batch in batches:
        for lead, doc, start, data in zip(*[batch.column(c).to_pylist() for c in ("lead", "doc_id", "start", "words")]):
            words = np.frombuffer(data, np.uint64)
            for a in range(0, len(words) - WINDOW + 1, 4096):
                part = words[a : a + 4096 + WINDOW - 1]
                keys = sequence_hashes(part, WINDOW).view(np.int64)
                n = len(keys)
                own = np.lib.stride_tricks.sliding_window_view(part, WINDOW).tobytes()
                size = 8 * WINDOW
                columns = [pa.array(np.full(n, lead, np.int64)), pa.array(np.full(n, doc, np.int64)), pa.array(np.arange(start + a, start + a + n, dtype=np.int32)), pa.array([own[i : i + size] for i in range(0, len(own), size)], pa.binary()), pa.array(keys)]
                yield pa.RecordBatch.from_arrays(columns, names=["lead", "doc_id", "start", "words", "window"])


class Shard:
    """Stretches of documents in order of document and place, indexed as one text."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        parts: list[list] = []
        for doc, start, data in sorted(rows, key=lambda r: r[:2]):
            words = np.frombuffer(data, np.uint64)
            if parts and parts[-1][0] == doc and start <= parts[-1][1] + parts[-1][3]:  # one stretch in two groups
                skip = parts[-1][1] + parts[-1][3] - start
                if skip < len(words):
                    parts[-1][2].append(words[skip:])
                    parts[-1][3] += len(words) - skip
                continue
            parts.append([doc, start, [words], len(words)])
        size = np.array([p[3] for p in parts], np.int64)
        self.doc = np.array([p[0] for p in parts], np.int64)
        self.at = np.array([p[1] for p in parts], np.int64)
        flat = np.concatenate([w for p in parts for w in p[2]])
        known, symbol = np.unique(flat, return_inverse=True)
        self.offset = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), np.int64)
        part = np.repeat(np.arange(len(parts)), size)
        text[self.offset[part] + np.arange(len(flat)) - (np.cumsum(size) - size)[part]] = symbol + 1
        self.index = FmIndex(text, len(known) + 1, WINDOW)
        self.known, self.text = known, text

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard's text of windows that start earlier elsewhere too, and of those that are the first."""
        first = self.index.repeated()
        at = np.arange(len(first))
        return np.flatnonzero((first >= 0) & (first < at)), np.flatnonzero((first >= 0) & (first == at))

    def ranges(self, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, first word, end, place in the shard's text) of the stretches that windows at ``at`` cover."""
        if not len(at):
            return
        part = np.searchsorted(self.offset, at, "right") - 1
        cut = np.flatnonzero(np.append(True, (np.diff(at) > WINDOW) | (np.diff(part) > 0)))
        last = np.append(cut[1:], len(at)) - 1
        for a, b in zip(cut, last):
            p, start = part[a], int(at[a])
            begin = int(self.at[p]) + start - int(self.offset[p])
            yield int(self.doc[p]), begin, begin + int(at[b]) - start + WINDOW, start


FOUND = "lead long, doc_id long, start int, words binary, stop int"


def _search(thin: bool, held: int):
    """Removed stretches of every shard; with ``thin`` also what is the first of its kind in the shard, to be compared further.

    With ``thin`` a block of a group is a shard; without, the groups of a task
    are, which follow each other, until they have ``held`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(lead: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            s = Shard(rows)
            later, first = s.windows()
            out = [(None, d, a, None, b) for d, a, b, _ in s.ranges(later)]
            if thin:
                # all windows of the shard but those that are removed, the ones without a repeat in this block included
                size = np.diff(np.append(s.offset, len(s.text))) - 1
                part = np.repeat(np.arange(len(size)), np.maximum(size - WINDOW + 1, 0))
                every = s.offset[part] + np.arange(len(part)) - np.searchsorted(part, part)
                for d, a, b, at in s.ranges(np.setdiff1d(every, later, assume_unique=True)):
                    out.append((lead, d, a, s.known[s.text[at : at + b - a] - 1].tobytes(), b))
            for i in range(0, len(out), 5000):
                columns = zip(*out[i : i + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()))], names=["lead", "doc_id", "start", "words", "stop"])

        now, rows, size = None, [], 0
        for batch in batches:
            for lead, block, doc, start, data in zip(*[batch.column(c).to_pylist() for c in ("lead", "block", "doc_id", "start", "words")]):
                if (lead, block) != now and rows and (thin or size >= held):
                    yield from shard(now[0], rows)
                    rows, size = [], 0
                now = lead, block
                rows.append((doc, start, data))
                size += len(data) // 8
        if rows:
            yield from shard(now[0], rows)

    return run


def large_groups(segments: DataFrame) -> DataFrame:
    """lead, n (stretches) and n_words of the groups that are too large for a shard; few, as each has many words."""
    sizes = segments.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("words") / 8).cast("long").alias("n_words"))
    return materialize(sizes.where((F.col("n") > HOT) | (F.col("n_words") > LARGE)), "large-groups")


def bounded(segments: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The stretches in groups that fit a shard, and the ranges that were found to be removed on the way.

    The windows of a large group are counted by the hash of their whole
    sequence; those found once go, the others are dealt to smaller groups by
    that hash.  What is large then has few windows in very many places: it is
    thinned out in blocks, where only the first of equal windows stays, until
    it fits or no longer gets much smaller.
    """
    large = large_groups(segments)
    if not large.count():
        return segments, []
    windows = segments.join(F.broadcast(large), "lead").select("lead", "doc_id", "start", "words").mapInArrow(_windows, SEGMENTS + ", window long")
    again = materialize(windows.groupBy("window").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("window"), "repeated-windows")
    kept = matched(windows, again, "window", salt_by=F.xxhash64("doc_id", "start"))
    # twice as many groups as would fill shards on average
    parts = F.ceil(F.col("n_words") * (2 * WINDOW) / F.lit(SHARD))
    kept = kept.join(F.broadcast(large), "lead").withColumn("lead", F.xxhash64("lead", F.pmod("window", parts)))
    dealt = materialize(kept.select("lead", "doc_id", "start", "words"), "dealt-windows")
    rest = segments.join(F.broadcast(large.select("lead")), "lead", "left_anti")
    found = []
    while (hot := large_groups(dealt)).count():
        blocks = F.greatest(F.ceil(F.col("n") / F.lit(max(1, HOT // 4))), F.ceil(F.col("n_words") / F.lit(SHARD)))
        block = F.pmod(F.xxhash64("doc_id", "start"), blocks)
        placed = dealt.join(F.broadcast(hot), "lead").withColumn("block", block).select("lead", "block", "doc_id", "start", "words")
        thinned = materialize(placed.repartition("lead", "block").sortWithinPartitions("lead", "block").mapInArrow(_search(True, SHARD), FOUND), "thinned")
        found.append(thinned.where("lead is null").select("doc_id", "start", "stop"))
        rest = rest.unionByName(dealt.join(F.broadcast(hot.select("lead")), "lead", "left_anti"))
        dealt = thinned.where("lead is not null").select("lead", "doc_id", "start", "words")
        left = dealt.agg(F.coalesce(F.sum(F.octet_length("words") / 8), F.lit(0))).first()[0]
        if left > 0.75 * hot.agg(F.sum("n_words")).first()[0]:
            break
    return rest.unionByName(dealt), found


def removed_ranges(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """doc_id, start and stop (in words) of what repeats an earlier window, for the first document of every word sequence.

    ``rows`` has doc_id and text, by doc_id (see ``keyed``).
    """
    total = reps.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n_buckets = int(max(24, total * 2 // (SPAN + 1) // BUCKET + 1))
    posted = rows.mapInArrow(_post(n_buckets), "bucket int, grams binary, keys binary, places binary")
    met = posted.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "key long, leads binary, grams binary")
    live = met.groupBy("key").agg(F.collect_list("leads").alias("leads"), F.collect_list("grams").alias("grams"))
    live = materialize(matched(live, reps.select("key", F.col("rep").alias("doc_id")), "key").drop("key"), "live-anchors")
    texts = rows.join(live.hint("merge"), "doc_id").select("doc_id", "text", "leads", "grams")
    segments = materialize(texts.mapInArrow(_segments, SEGMENTS), "segments")
    segments, found = bounded(segments)
    n_words = segments.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8
    n_shards = int(max(24, n_words // SHARD + 1))
    dealt = segments.withColumn("block", F.lit(0)).select("lead", "block", "doc_id", "start", "words").repartition(n_shards, "lead").sortWithinPartitions("lead")
    last = dealt.mapInArrow(_search(False, SHARD), FOUND).select("doc_id", "start", "stop")
    for more in found:
        last = last.unionByName(more)
    return last


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id and text with the key of their words, as ``_measure`` has it."""
    for batch in batches:
        key = pa.concat_arrays([b.column("key") for b in _measure([batch])])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), key], names=["doc_id", "text", "key"])


def by_texts(rows: DataFrame, per_doc: DataFrame) -> DataFrame:
    """``dedup_substrings`` of rows that share a doc_id but not their words: each (doc_id, words) gets a number of its own, in this order, and is a document by it."""
    numbers = running(per_doc.select("doc_id", "key").distinct(), [F.col("doc_id"), F.col("key")], {"number": F.lit(1).cast("long")}, "doc-order")
    numbers = materialize(numbers.select("doc_id", "key", "number"), "doc-numbers")
    known = matched(rows.where("doc_id is not null").mapInArrow(_with_key, "doc_id long, text string, key long"), numbers, ["doc_id", "key"])
    done = dedup_substrings(known.select(F.col("number").alias("doc_id"), "text").unionByName(rows.where("doc_id is null")))
    names = numbers.select(F.col("number").alias("_number"), F.col("doc_id").alias("_id"))
    return shuffled(done, names, F.col("doc_id") == F.col("_number"), "left").select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, digest = [], [], []
        for text, cuts, copy in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), batch.column("copy").to_pylist()):
            words = (text or "").encode().split()
            n.append(len(words))
            if copy and len(words) >= WINDOW:
                words = []
            elif cuts:
                kept, at = [], 0
                for c in sorted((c["start"], c["stop"]) for c in cuts):
                    kept += words[at : c[0]] if c[0] > at else []
                    at = max(at, c[1])
                words = kept + words[at:]
            gone.append(n[-1] - len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and a digest of the kept words of every document.

    ``docs`` has doc_id and text; other columns are ignored.  A window is 20
    consecutive words of one document; a word goes if a window over it has the
    same words as one that starts earlier (in a document of a smaller doc_id, or
    earlier in its own).  A null or blank text has no words; a text of under 20
    words keeps them all; rows with the same doc_id and words are the same
    document, rows with the same doc_id and other words are different ones, in
    order of the hash of their words; a row without doc_id keeps its words and is
    no earlier document; every row has a row in the result; an empty table gives
    no rows.

    Of documents with the same words only the first can be first with a window;
    the others lose all words.  Every window posts the lowest of its 8-word
    anchors; windows that repeat share it.  Documents that share an anchor form
    a group, whose stretches go to one shard; a group of very many stretches or
    words is dealt again by whole windows that are there twice, and those in
    very many places are thinned out in blocks (see ``bounded``).
    A shard is indexed by a compressed FM-index and streamed against it.  Word
    sequences are the same where their 64-bit hashes are.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    per_doc = materialize(rows.where("doc_id is not null").mapInArrow(_measure, "doc_id long, n_words long, key long"), "doc-words")
    if per_doc.groupBy("doc_id").agg((F.min("key") != F.max("key")).alias("several")).where("several").limit(1).count():
        return by_texts(rows, per_doc)
    reps = materialize(per_doc.where(f"n_words >= {WINDOW}").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n_words").alias("n_words")), "first-docs")
    n_bytes = per_doc.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0] * 8
    texts = keyed(rows.where("doc_id is not null"), "doc_id", int(n_bytes // TEXT_BYTES + 1), "texts")
    ranges = removed_ranges(texts, reps)
    cuts = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")).withColumn("copy", F.lit(False))
    known = matched(per_doc, reps.select("key", "rep"), "key", salt_by=F.col("doc_id"))
    copies = known.where("doc_id <> rep").select("doc_id", F.lit(None).cast(cuts.schema["cuts"].dataType).alias("cuts"), F.lit(True).alias("copy")).distinct()
    changed = materialize(cuts.unionByName(copies), "removed")
    # never broadcast: the texts lie by doc_id already, and the table grows with them
    joined = texts.join(changed.hint("merge"), "doc_id", "left").select("doc_id", "text", "cuts", "copy")
    no_id = rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(changed.schema["cuts"].dataType).alias("cuts"), F.lit(None).cast("boolean").alias("copy"))
    return joined.unionByName(no_id).mapInArrow(_keep, RESULT)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of ``documents`` that repeat an earlier window: see ``dedup_substrings``, nulls and repeats included; an empty table gives no rows."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
