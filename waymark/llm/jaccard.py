"""Exact n-gram Jaccard join by signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waymark.llm.spread import components, matched, shuffled
from waymark.llm.store import materialize
from waymark.llm.words import chunks, mix, sequence_hashes, signed, spans, utf8, whole_hash, word_hashes

#: Words in a shingle, and the least similarity in percent.
N, PERCENT = 5, 80
#: Counters of the frequency sketch (a fixed size, whatever the input) and counters in one of its rows.
SLOTS, ROW = 1 << 20, 1 << 16
#: Postings of one bucket on average, and postings that a task holds before it deals them out.
BUCKET, HELD = 1 << 20, 3 << 19
#: Sets of a group that are compared at a time; the main part of a larger group is found first (see ``links``).
GROUP = 512
#: Least and most bits of a signature, which has as many as its set has shingles at least, and children of a tree node.
BITS, MOST_BITS, FAN = 1024, 1 << 17, 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; texts of fewer words are one shingle, blank ones none."""
    for a, b in chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = spans(part, offsets[a : b + 1] - offsets[a])
        words = word_hashes(part, starts, ends, fold=True)
        grams = sequence_hashes(words, N)
        for lo, hi in zip(first[:-1], first[1:]):
            if hi - lo >= N:
                s = np.sort(grams[lo : hi - N + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif hi > lo:
                yield np.array([whole_hash(words[lo:hi], 7)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def signature(s: np.ndarray) -> bytes:
    """The bitmap of a set: one bit per shingle, of a power of two of bits that is not below the size of the set."""
    size = min(MOST_BITS, max(BITS, 1 << (len(s) - 1).bit_length())) if len(s) else BITS
    flags = np.zeros(size, bool)
    flags[(s >> np.uint64(65 - size.bit_length())).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def folded(bitmap: bytes) -> bytes:
    """The same set's bitmap of half as many bits."""
    return np.packbits(np.unpackbits(np.frombuffer(bitmap, np.uint8)).reshape(-1, 2).any(1)).tobytes()


MEASURED = "doc_id long, n_shingles long, set long, bits binary, block int, counts binary"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (size, key and bitmap of its set), and at the end of a task the rows of its frequency sketch."""
    total = np.zeros(SLOTS, np.int64)
    names = [x.split()[0] for x in MEASURED.split(", ")]
    for batch in batches:
        sizes, keys, bits, pending = [], [], [], []
        for s in shingle_sets(*utf8(batch.column("text"))):
            sizes.append(len(s))
            keys.append(signed(whole_hash(s)))
            bits.append(signature(s))
            pending.append(s)
            if len(pending) >= 256:
                total += np.bincount(_slots(np.concatenate(pending)), minlength=SLOTS)
                pending = []
        if pending:
            total += np.bincount(_slots(np.concatenate(pending)), minlength=SLOTS)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    for i in range(SLOTS // ROW):
        part = total[i * ROW : (i + 1) * ROW]
        if part.any():
            null = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([null, null, null, pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([part.astype("<i4").tobytes()], pa.binary())], names=names)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            got = np.frombuffer(counts, "<i8" if len(counts) > 4 * ROW else "<i4").astype(np.int64)
            sums[block] = sums[block] + got if block in sums else got
    for block, got in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([got.astype("<i8").tobytes()], pa.binary())], names=["block", "counts"])


def frequency_classes(measured: DataFrame) -> np.ndarray:
    """For every slot of the sketch a class that rises with the number of documents in it: SLOTS bytes."""
    rows = measured.where("block is not null").select("block", "counts")
    # two steps, so that a task adds up the sketches of some input tasks only
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16))).repartition(SLOTS // ROW * 16, "block", "salt")
    some = salted.select("block", "counts").mapInArrow(_add, "block int, counts binary")
    rows = some.repartition(SLOTS // ROW, "block").mapInArrow(_add, "block int, counts binary").collect()
    total = np.zeros(SLOTS, np.int64)
    for r in rows:
        total[r["block"] * ROW : (r["block"] + 1) * ROW] = np.frombuffer(r["counts"], "<i8")
    return np.minimum(255, np.floor(8 * np.log2(total + 1))).astype(np.uint8)


def prefix(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The shingles, rarest first, of which two linked sets share one at least."""
    keep = len(s) - (-(-PERCENT * len(s) // 100)) + 1
    rank = (classes[_slots(s)].astype(np.uint64) << np.uint64(56)) | (mix(s) >> np.uint64(8))
    return s[np.argpartition(rank, keep - 1)[:keep]] if keep < len(s) else s


def _post(classes, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        shingles: list[np.ndarray] = []
        keys: list[int] = []
        held = 0

        def deal() -> Iterator[pa.RecordBatch]:
            token = np.concatenate(shingles)
            own = np.repeat(np.array(keys, np.int64), [len(x) for x in shingles])
            bucket = (token % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            token, own, bucket = token[order], own[order], bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(bucket))):
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([token[a:b].tobytes()], pa.binary()), pa.array([own[a:b].tobytes()], pa.binary())], names=["bucket", "tokens", "sets"])

        for batch in batches:
            for s in shingle_sets(*utf8(batch.column("text"))):
                if not len(s):
                    continue
                key = signed(whole_hash(s))
                if key in seen:  # a copy within the task
                    continue
                seen.add(key)
                shingles.append(prefix(s, classes.value))
                keys.append(key)
                held += len(shingles[-1])
                if held >= HELD:
                    yield from deal()
                    shingles, keys, held = [], [], 0
        if held:
            yield from deal()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that two sets or more have posted: the smallest of those sets leads, the others are its members."""

    def bucket(tokens: list[bytes], sets: list[bytes]) -> pa.RecordBatch:
        t, s = np.frombuffer(b"".join(tokens), np.uint64), np.frombuffer(b"".join(sets), np.int64)
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        new = np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]))
        t, s = t[new], s[new]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        n = np.diff(np.append(first, len(t)))
        lead = np.repeat(s[first], n)
        live = np.repeat(n > 1, n)
        lead, s = lead[live], s[live]
        order = np.lexsort((s, lead))
        lead, s = lead[order], s[order]
        new = np.ones(len(s), bool)
        new[1:] = (lead[1:] != lead[:-1]) | (s[1:] != s[:-1])
        return pa.RecordBatch.from_arrays([pa.array(lead[new]), pa.array(s[new])], names=["lead", "set"])

    now, tokens, sets = None, [], []
    for batch in batches:
        for b, t, s in zip(batch.column("bucket").to_pylist(), batch.column("tokens").to_pylist(), batch.column("sets").to_pylist()):
            if b != now and tokens:
                yield bucket(tokens, sets)
                tokens, sets = [], []
            now = b
            tokens.append(t)
            sets.append(s)
    if tokens:
        yield bucket(tokens, sets)


class SignatureTree:
    """Sets in order of size; every node holds the OR of its sets' bitmaps, their range of sizes, and the fewest bits that a shared part can have."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        """``n``: sizes of the sets; ``bits``: their bitmaps as rows of 64-bit words."""
        self.order = np.lexsort((*bits[:, :2].T, n))
        self.n, self.bits = n[self.order], bits[self.order]
        self.count = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        # a linked set misses at most n - ceil(0.8 n) of its shingles in the shared part, and so as many bits
        need = self.count - (self.n - (-(-PERCENT * self.n // 100)))
        self.levels = [(self.bits, self.n, self.n, need)]
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, need = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(need, at)))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether node pairs of a level can hold a link: sizes that go together, and enough common bits for the largest possible overlap."""
        bits, lo, hi, need = self.levels[level]
        fit = (PERCENT * lo[i] <= 100 * hi[j]) & (PERCENT * lo[j] <= 100 * hi[i])
        at = np.flatnonzero(fit)
        both = np.bitwise_count(bits[i[at]] & bits[j[at]]).sum(1, dtype=np.int64)
        fit[at] = both >= np.maximum(need[i[at]], need[j[at]])
        if level == 0:
            at = np.flatnonzero(fit)
            both = np.bitwise_count(bits[i[at]] & bits[j[at]]).sum(1, dtype=np.int64)
            most = np.minimum(self.n[i[at]] - (self.count[i[at]] - both), self.n[j[at]] - (self.count[j[at]] - both))
            fit[at] = (100 + PERCENT) * most >= PERCENT * (self.n[i[at]] + self.n[j[at]])
        return fit

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that can be linked, by a traversal of the tree against itself; places in ``order``."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > 1 << 15:
                half = len(i) // 2
                stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
                continue
            if level or len(self.levels) == 1:
                fit = self._possible(level, i, j) if level else i < j
                i, j = i[fit], j[fit]
            if not level:
                fit = i < j
                i, j = i[fit], j[fit]
                fit = self._possible(0, i, j)
                if fit.any():
                    yield i[fit], j[fit]
                continue
            if not len(i):
                continue
            below = len(self.levels[level - 1][0])
            child = np.arange(FAN)
            a = np.broadcast_to((i * FAN)[:, None, None] + child[:, None], (len(i), FAN, FAN)).ravel()
            b = np.broadcast_to((j * FAN)[:, None, None] + child, (len(i), FAN, FAN)).ravel()
            fit = (a < below) & (b < below) & (a <= b)
            stack.append((level - 1, a[fit], b[fit]))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough, exactly."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < PERCENT * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int(np.count_nonzero(b[at] == a))
    return (100 + PERCENT) * shared >= PERCENT * (len(a) + len(b))


def candidate_pairs(n: list[int], bitmaps: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that trees leave, by place.

    Sets whose bitmaps are of one length share a tree, together with those of
    the next length, folded, that are not too large for a link with them.
    """
    size, length = np.array(n, np.int64), np.array([len(b) for b in bitmaps])
    for k in np.unique(length):
        own = np.flatnonzero(length == k)
        more = np.flatnonzero((length == 2 * k) & (PERCENT * size <= 100 * size[own].max()))
        at = np.concatenate([own, more])
        if len(at) < 2:
            continue
        data = b"".join([bitmaps[i] for i in own] + [folded(bitmaps[i]) for i in more])
        tree = SignatureTree(size[at], np.frombuffer(data, np.uint64).reshape(len(at), -1))
        place = at[tree.order]
        for i, j in tree.pairs():
            yield place[i], place[j]


def forest(ids: list[int], n: list[int], bitmaps: list[bytes], sets: list[np.ndarray] | None = None, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join what the links of a group of sets join: (id, smallest id of its part).

    Pairs come from the tree.  With ``sets`` they are verified exactly, unless
    earlier links already join them; without, all that the tree leaves count.
    Sets that are ``joined`` are known to be in one part.
    """
    if len(ids) < 2:
        return []
    parent = np.arange(len(ids))
    if joined is not None and any(joined):
        whole = np.flatnonzero(joined)
        parent[whole] = whole[0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in candidate_pairs(n, bitmaps):
        for at in range(0, len(i), 2048):
            x, y = i[at : at + 2048], j[at : at + 2048]
            root = parent
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            parent[:] = root
            apart = root[x] != root[y]
            for p, q in zip(x[apart].tolist(), y[apart].tolist()):
                a, b = find(p), find(q)
                if a != b and (sets is None or linked(sets[p], sets[q])):
                    parent[max(a, b)] = min(a, b)
    own = np.array(ids, np.int64)
    roots = np.array([find(x) for x in range(len(ids))])
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, own)
    return [(int(x), int(least[r])) for x, r in zip(own, roots) if x != least[r]]


SETS = "lead long, doc_id long, n long, bits binary, shingles binary"
SENT = "lead long, x long, y long, joined long, doc_id long, n long, bits binary, shingles binary"
NAMES = [x.split()[0] for x in SENT.split(", ")]


def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every set with its shingles; of repeated rows in a task the first."""
    names = [x.split()[0] for x in SETS.split(", ")]
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        out = []
        for lead, doc, s in zip(batch.column("lead").to_pylist(), batch.column("doc_id").to_pylist(), shingle_sets(*utf8(batch.column("text")))):
            if (doc, key := whole_hash(s)) not in seen:
                seen.add((doc, key))
                out.append((lead, doc, len(s), signature(s), s.tobytes()))
        for a in range(0, len(out), 2000):
            columns = zip(*out[a : a + 2000])
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every comparison, whose rows follow each other: verified ones, or where shingles were not sent, possible ones."""
    now, held = None, []
    out: list[tuple[int, int, int]] = []

    def group() -> list[tuple[int, int, int]]:
        if len(held) < 2:
            return []
        joined, ids, n, bits, data = zip(*held)
        return [(now[0], a, b) for a, b in forest(ids, n, bits, None if data[0] is None else [np.frombuffer(x, np.uint64) for x in data], joined)]

    for batch in batches:
        for lead, x, y, *row in zip(*[batch.column(c).to_pylist() for c in NAMES]):
            if (lead, x, y) != now:
                out += group()
                now, held = (lead, x, y), []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], names=["lead", "a", "b"])
            out = []
    out += group()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], names=["lead", "a", "b"])


def compared(sent: DataFrame) -> DataFrame:
    """Links (lead, a, b) within the comparisons (lead, x, y): each set with the smallest of its part of one."""
    return sent.select(*NAMES).repartition("lead", "x", "y").sortWithinPartitions("lead", "x", "y").mapInArrow(_compare, "lead long, a long, b long")


def _counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("lead").agg(F.count(F.lit(1)).alias(name))


def main_parts(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Links within large groups, and (lead, doc_id) of a main part of each group that they join.

    A group (``rows`` has its number of ``members``) is dealt to blocks by hash,
    whose links are found.  The largest part of every block sends its smallest
    set on; these are a group again, smaller by the size of a block, and so on
    until one block is left.  What its largest part stands for is the main part.
    """
    rows = rows.withColumn("x", F.when(F.col("members") <= GROUP, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("members") / (GROUP // 2)))).cast("long"))
    stars = materialize(compared(rows.withColumns({"y": F.expr("0L"), "joined": F.expr("0L")})), "block-links")
    own = rows.select("lead", "x", "doc_id", "members")
    of = stars.select(F.col("lead").alias("s_lead"), F.col("a").alias("s_id"), F.col("b").alias("root"))
    own = shuffled(own, of, (F.col("lead") == F.col("s_lead")) & (F.col("doc_id") == F.col("s_id")), "left").select("lead", "x", "doc_id", "members", F.coalesce("root", "doc_id").alias("root"))
    own = materialize(own, "block-parts")
    parts = own.groupBy("lead", "x", "root").agg(F.count(F.lit(1)).alias("n"), F.max("members").alias("members"))
    best = parts.groupBy("lead", "x").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("root"), F.max("members").alias("members"))
    best = materialize(best, "block-mains")
    last = best.where(F.col("members") <= GROUP).select("lead", "root")
    links = [stars]
    if not best.where(F.col("members") > GROUP).isEmpty():
        up = best.where(F.col("members") > GROUP).select("lead", F.col("root").alias("doc_id"))
        chosen = matched(rows.drop("members", "x"), up, ["lead", "doc_id"]).dropDuplicates(["lead", "doc_id"])
        chosen = materialize(chosen, "block-representatives")
        more, main = main_parts(matched(chosen, materialize(_counted(chosen, "members"), "representatives"), "lead"))
        links += more
        last = last.unionByName(main.select("lead", F.col("doc_id").alias("root")))
    return links, materialize(shuffled(own, last, ["lead", "root"], "left_semi").select("lead", "doc_id"), "main-parts")


def links(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join what the links within the groups of ``rows`` (a table of SETS) join.

    A group of up to GROUP sets is one comparison.  Of a larger one a main part
    is found first, whose sets are joined already (near copies of one text are
    nearly all in it); they need not be compared with each other.  The others
    are compared with each other and with the main part, by blocks: those of one
    band of sizes with those of the bands beside it, in which all sets are whose
    sizes go with its own.  So no set of a main part is sent more often than
    there are blocks of other sets.
    """
    large = materialize(_counted(rows, "members").where(F.col("members") > GROUP), "large-groups")
    whole = rows.withColumns({"x": F.expr("0L"), "y": F.expr("0L"), "joined": F.expr("0L")})
    if large.isEmpty():
        return compared(whole).select("a", "b")
    found = [compared(matched(whole, large.select("lead"), "lead", "left_anti"))]
    hot = materialize(matched(rows, large, "lead", salt_by=F.col("doc_id")), "large-sets")
    more, main = main_parts(hot)
    found += more
    main = main.withColumn("joined", F.expr("1L"))
    flagged = matched(hot, main, ["lead", "doc_id"], "left").withColumn("joined", F.coalesce("joined", F.expr("0L")))
    flagged = materialize(flagged, "flagged-sets")
    others = materialize(flagged.groupBy("lead").agg(F.count_if(F.col("joined") == 0).alias("others"), F.count_if(F.col("joined") == 1).alias("mains")).where("others > 0"), "other-sets")
    if not others.isEmpty():
        placed = matched(flagged, others, "lead", salt_by=F.col("doc_id"))
        half = GROUP // 2
        placed = placed.withColumns({"band": F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))), "u": F.ceil(F.col("others") / half), "m": F.ceil(F.col("mains") / half)})
        placed = placed.withColumn("block", F.when(F.col("joined") == 0, F.pmod(F.xxhash64("doc_id"), "u")).otherwise(F.col("u") + F.pmod(F.xxhash64("doc_id"), F.greatest("m", F.lit(1)))))
        # blocks 0 to u - 1 are of other sets, the next m of the main part; a block of the main part meets no other of it
        keys = F.expr(
            "flatten(transform(sequence(band - 1, band + 1), b -> transform(sequence(0L, if(joined = 1, u, u + m) - 1), j -> "
            "named_struct('x', least(band * 1048576 + block, b * 1048576 + j), 'y', greatest(band * 1048576 + block, b * 1048576 + j)))))"
        )
        placed = placed.withColumn("k", F.explode(keys)).select("lead", "k.x", "k.y", "joined", "doc_id", "n", "bits", "shingles")
        found.append(compared(placed))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("a", "b")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    ``docs`` has doc_id and text; other columns are ignored.  A document's set
    are its distinct 5-word shingles (words cut at white space, A-Z folded); a
    text of fewer words is one shingle, a null or blank text has none and is
    linked with nothing.  Documents whose sets have a Jaccard similarity of 0.8
    or more are linked; component_id is the smallest doc_id reachable.  Rows
    with a null doc_id have a null component and take no part; repeated rows
    get one row each; an empty table gives no rows.

    Equal sets are one node.  Of every set, the rarest fifth of its shingles
    (by a frequency sketch of fixed size over all documents, then by hash) is
    dealt to buckets: linked sets share one of these.  Sets that meet under a
    shingle form the group of the smallest one.  A traversal of the group's
    signature tree against itself leaves pairs that may be linked; only sets
    with such a pair are sent with their shingles, once, to the component of these
    pairs, whose tree is traversed again with an exact test of each pair that
    earlier links do not join already.  Of groups beyond GROUP sets the part
    that is joined anyway is found first (see ``links``).  Components are found
    by star steps.  Word sequences are the same where their 64-bit hashes are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    measured = materialize(rows.mapInArrow(_measure, MEASURED), "sets")
    per_doc = measured.where("block is null").select("doc_id", "n_shingles", "set", "bits")
    sets = per_doc.where("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("bits").alias("bits"))
    sets = materialize(sets, "set-reps")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = int(max(24, total * (100 - PERCENT) // 100 // BUCKET + 1))
    classes = spark.sparkContext.broadcast(frequency_classes(measured))
    posted = rows.mapInArrow(_post(classes, n_buckets), "bucket int, tokens binary, sets binary")
    met = posted.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "lead long, set long")
    members = materialize(met.groupBy("lead", "set").agg(F.count(F.lit(1)).alias("met")).drop("met"), "members")
    groups = shuffled(members, sets, "set").select("lead", F.col("rep").alias("doc_id"), "n", "bits", F.lit(None).cast("binary").alias("shingles"))
    maybe = materialize(components(links(materialize(groups, "groups"))), "possible-parts")
    live = maybe.withColumnsRenamed({"node": "doc_id", "root": "lead"})
    texts = matched(rows, live, "doc_id")
    near = materialize(texts.select("lead", "doc_id", "text").mapInArrow(_shingle, SETS), "live-sets")
    roots = components(links(near))
    comp = shuffled(sets, roots.withColumnRenamed("node", "rep"), "rep", "left").select("set", F.coalesce("root", "rep").alias("component_id"))
    comp = materialize(comp, "set-components")
    filled = matched(per_doc.where("n_shingles > 0"), comp, "set", salt_by=F.col("doc_id")).select("doc_id", "n_shingles", "component_id")
    empty = per_doc.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    no_id = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return filled.unionByName(empty).unionByName(no_id)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of linked documents, that of the smallest doc_id, with all columns.

    Rows that share a doc_id are one document: one of them stays, that of the
    least text hash.  Rows with a null doc_id take no part and stay; documents
    with null or blank texts are linked with nothing and stay; an empty table
    gives no rows.
    """
    gone = materialize(jaccard_join(docs).where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    names = docs.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    again = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1").select("doc_id")
    again = materialize(again, "repeated-ids")
    kept = matched(rows, gone, "doc_id", "left_anti")
    if not again.isEmpty():
        one = matched(kept, again, "doc_id").groupBy("doc_id").agg(F.min_by("row", "text_key").alias("row"))
        kept = matched(kept, again, "doc_id", "left_anti").select("doc_id", "row").unionByName(one)
    return kept.select(*[F.col(f"row.`{c}`") for c in names])


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Groups of linked ``documents``: see ``jaccard_join``, nulls, repeats and ties included; an empty table gives no rows."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
