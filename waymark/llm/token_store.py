"""Token ids in binary shards, compressed by a Re-Pair grammar, with random-access decoding."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from waymark.llm.characters import LETTER, SPACE, known, table
from waymark.llm.spread import running, small_enough
from waymark.llm.store import new_path
from waymark.llm.words import _power, mix

END = 2
CHAR_BASE = 0x9E6C63D0876A9A55
CHAR_BACK = pow(CHAR_BASE, -1, 1 << 64)
#: Ids in a shard (one document more may follow), characters in a batch of texts, and pre-tokens kept with their ids.
SHARD_IDS, PIECE, KEPT = 1 << 20, 1_500_000, 1_200_000
#: Documents that are read from a shard at a time.
READ = 512
#: Input bytes for one sorted partition of documents.
PART_BYTES = 24 << 20
_encoders: dict[str, Encoder] = {}


def pre_tokens(chars: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens in texts laid end to end; ``first`` are the places of the texts' first characters, ``kinds`` the class of every code point.

    A pre-token is a run of letters, of numbers or of other marks with one
    blank before it, or white space without the character before a run; 's,
    't, 're, 've, 'm, 'll and 'd split off where they follow anything but a
    blank or a mark.
    """
    n = len(chars)
    kind = kinds[chars]
    head = np.zeros(n + 1, bool)
    head[first] = True
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # the last white space before a run: a pre-token of its own, or the blank of the run
    after = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n])
    start[after] = True
    blank = after[chars[after] == 32]
    start[blank + 1] = False
    mark = np.flatnonzero((chars == 39) & run & start)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~head[mark + 1]]
    if len(mark):
        one, two = chars[mark + 1], np.where(mark + 2 < n, chars[np.minimum(mark + 2, n - 1)], 0)
        two[head[np.minimum(mark + 2, n)]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((short, 2), (long & ~short, 3)):
            at = mark[hit]
            start[at + 1] = False
            cut = at + size
            start[cut[cut < n]] = True
    return np.flatnonzero(start)


def words_at(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The stretches of ``chars`` from ``starts`` to ``ends``, decoded at once."""
    size = ends - starts
    upto = np.cumsum(size)
    flat = chars[np.repeat(starts - (upto - size), size) + np.arange(size.sum())]
    text = flat.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[x:y] for x, y in zip((upto - size).tolist(), upto.tolist())]


def tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for every distinct pre-token.

    Pre-tokens are found and hashed on arrays of code points; their ids are kept
    in a table from hash to ids, which starts anew when it is full.  Texts with
    more pre-tokens than it keeps get a table as large as they need.  Pre-tokens
    are the same where their 64-bit hashes are (two given ones that differ share
    a hash with a probability of about 2**-63).
    """

    BITS = 22

    def __init__(self, path: str | None = None, characters: tuple | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(path)
        self.kinds = table((characters or known(path))[0])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._start()

    @staticmethod
    def shared(path: str | None = None, characters: tuple | None = None) -> Encoder:
        """One encoder per process and file: tasks of a worker go on with the table."""
        if (path or "") not in _encoders:
            _encoders[path or ""] = Encoder(path, characters)
        return _encoders[path or ""]

    def _start(self, room: int = 0) -> None:
        """An empty table for ``room`` pre-tokens, KEPT at least."""
        self.room = max(KEPT, room)
        self.bits = max(self.BITS, (2 * self.room).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.pool, self.starts, self.n, self.used = np.zeros(1 << 20, np.int32), np.zeros(self.room + 1, np.int64), 0, 0

    def _slots(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is in the table, or the free slot where it belongs; and whether it is there."""
        mask = (1 << self.bits) - 1
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            own = self.keys[slot[open_]]
            open_ = open_[(own != key[open_]) & (own != 0)]
        return slot, self.keys[slot] == key

    def _learn(self, key: np.ndarray, texts: list[str]) -> None:
        got = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        word = np.array(got.word_ids, np.int64)  # no special tokens are added: every id has its word
        ids = np.array(got.ids, np.int32)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        ends = self.used + np.searchsorted(word, np.arange(1, len(texts) + 1))
        self.starts[self.n + 1 : self.n + 1 + len(texts)] = ends
        self.used += len(ids)
        left, row = key, np.arange(self.n, self.n + len(texts), dtype=np.int32)
        self.n += len(texts)
        while len(left):
            slot, _ = self._slots(left)
            self.keys[slot] = left
            won = self.keys[slot] == left
            self.rows[slot[won]] = row[won]
            left, row = left[~won], row[~won]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text starts in it (one more at the end)."""
        plain = [t if not any(x in t for x in self.special) else "" for t in texts]
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        ends = np.cumsum(size)
        chars = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, bounds = self._flat(chars, (ends - size)[size > 0]) if len(chars) else (np.zeros(0, np.int32), None)
        # a text starts where its first pre-token does
        cuts = np.append(ends - size, len(chars))
        at = bounds[1][np.searchsorted(bounds[0], cuts)] if bounds is not None else np.zeros(len(cuts), np.int64)
        marked = [i for i, (t, p) in enumerate(zip(texts, plain)) if t and not p]
        if not marked:
            return ids, at
        parts = [ids[a:b] for a, b in zip(at, at[1:])]
        for i in marked:  # a text with a special token goes to the library as it is
            parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _flat(self, chars: np.ndarray, first: np.ndarray):
        starts = pre_tokens(chars, first, self.kinds)
        ends = np.append(starts[1:], len(chars))
        up, down = _power("chars", CHAR_BASE, len(chars)), _power("back", CHAR_BACK, len(chars))
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((chars + np.uint32(1)) * up, out=sums[1:], dtype=np.uint64)
        key = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) | np.uint64(1)
        slot, known = self._slots(key)
        if not known.all():
            new, place = np.unique(key[~known], return_index=True)
            if self.n + len(new) > self.room or (self.room > KEPT and self.n > KEPT):
                new, where = np.unique(key, return_index=True)
                self._start(len(new))
            else:
                where = np.flatnonzero(~known)[place]
            for a in range(0, len(new), KEPT // 4):
                some = where[a : a + KEPT // 4]
                self._learn(new[a : a + KEPT // 4], words_at(chars, starts[some], ends[some]))
            slot, known = self._slots(key)
        row = self.rows[slot]
        begin = self.starts[row]
        size = self.starts[row + 1] - begin
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(begin - (upto - size), size) + np.arange(int(upto[-1]))]
        return ids, (np.append(starts, len(chars)), np.concatenate([[0], upto]))


def repair(ids: np.ndarray, base: int, least: int = 4, most: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: the sequence over ids and rules, the rules' pairs, and how many ids each rule expands to.

    A round counts adjacent pairs, gives the most frequent ones (``most`` at
    once; the others wait for the next round) a nonterminal each, numbered from
    ``base``, and replaces their places; where places overlap the more frequent
    pair goes first, then the one further left.  Rounds go on until no pair is
    there ``least`` times: a rule takes 12 bytes and saves 4 at every place, so
    that rarer pairs save nothing.  A table of hashes leaves out rare pairs, which
    are not looked at again until a neighbour is replaced; the others are counted
    exactly.
    """
    s = ids.astype(np.int32)
    rare = np.zeros(len(s), bool)  # places whose pair is there too seldom, for ever: counts of known pairs only fall
    pairs: list[np.ndarray] = []
    known = np.zeros(0, np.int64)
    top, bits = base, 20
    number_in = np.zeros(1 << bits, np.int32)
    slots = lambda x, y: ((x * np.uint32(0x9E3779B1) + y * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int32)
    while len(s) > 1:
        at = np.flatnonzero(~rare[:-1])
        left, right = s[at], s[at + 1]
        slot = slots(left.view(np.uint32), right.view(np.uint32))
        warm = (np.bincount(slot, minlength=1 << bits) >= least)[slot]
        rare[at[~warm]] = True
        at, slot = at[warm], slot[warm]
        key = (left[warm].astype(np.int64) << 32) | right[warm]
        own = np.sort(key)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
        count = np.diff(np.append(first, len(own)))
        often = count >= least
        hot, count = own[first[often]], count[often]
        if not len(hot):
            break
        h = hot.view(np.uint32).reshape(-1, 2)
        mark = np.zeros(1 << bits, bool)
        mark[slots(h[:, 1], h[:, 0])] = True
        near = mark[slot]
        rare[at[~near]] = True
        at, slot, key = at[near], slot[near], key[near]
        if len(hot) > most:
            some = np.sort(np.argpartition(-count, most)[:most])
            hot, count = hot[some], count[some]
            h = hot.view(np.uint32).reshape(-1, 2)
            mark[:] = False
            mark[slots(h[:, 1], h[:, 0])] = True
            near = mark[slot]
            at, slot, key = at[near], slot[near], key[near]
        order = np.lexsort((mix(hot.view(np.uint64)), -count))  # ties by hash: a passage's pairs do not wait for each other in a row
        rank = np.empty(len(hot), np.int32)
        rank[order] = np.arange(len(hot), dtype=np.int32)
        number_in[slots(h[:, 1], h[:, 0])] = np.arange(len(hot), dtype=np.int32)
        place = number_in[slot]
        same = hot[place] == key
        other = np.flatnonzero(~same)  # pairs that share a slot are searched for
        place[other] = np.minimum(np.searchsorted(hot, key[other]), len(hot) - 1)
        same[other] = hot[place[other]] == key[other]
        at, r = at[same], rank[place[same]]
        hot = hot[order]
        taken = np.zeros(len(s) + 1, bool)
        chosen_at, chosen_r = [], []
        while len(at):  # runs of one pair (of one id with itself) whose rank is the lowest among those that overlap them: every second place
            near = np.diff(at) == 1
            again = near & (r[1:] == r[:-1])
            if not again.any():
                better = np.ones(len(at), bool)
                better[1:] &= ~near | (r[1:] < r[:-1])
                better[:-1] &= ~near | (r[:-1] < r[1:])
                pick = at[better]
                chosen_at.append(pick)
                chosen_r.append(r[better])
                taken[pick] = taken[pick + 1] = True
                free = ~taken[at] & ~taken[at + 1]
                at, r = at[free], r[free]
                continue
            new = np.append(True, ~again)
            first = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            beside, own = near[first[1:] - 1], r[first]
            lowest = np.ones(len(first), bool)
            lowest[1:] &= ~beside | (own[1:] < own[:-1])
            lowest[:-1] &= ~beside | (own[:-1] < own[1:])
            better = lowest[run] & ((np.arange(len(at)) - first[run]) % 2 == 0)
            pick = at[better]
            chosen_at.append(pick)
            chosen_r.append(r[better])
            taken[pick] = taken[pick + 1] = True
            free = ~taken[at] & ~taken[at + 1]
            at, r = at[free], r[free]
        at, r = np.concatenate(chosen_at), np.concatenate(chosen_r)
        # a pair left with one place gets no rule now; the most frequent one always has half of its places
        used = np.flatnonzero(np.bincount(r, minlength=len(hot)) > 1)
        if not len(used):
            break
        number = np.full(len(hot), -1, np.int32)
        number[used] = np.arange(len(used))
        ruled = number[r] >= 0
        at, r = at[ruled], r[ruled]
        pair = np.stack([hot[used] >> 32, hot[used] & 0xFFFFFFFF], 1)
        size = np.where(pair < base, 1, known[np.maximum(pair - base, 0)] if len(known) else 1).sum(1)
        pairs.append(pair)
        known = np.concatenate([known, size])
        s[at] = top + number[r]
        rare[at] = False
        rare[np.maximum(at - 1, 0)] = False
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, rare = s[keep], rare[keep]
        top += len(used)
    return s, np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64), known


class Shard:
    """One shard of the file format, read at random: any run of its documents is decoded by itself.

    Sums of the expansion lengths tell which symbols cover a document and where
    each symbol's ids go; only the rules that these symbols meet are opened.
    """

    def __init__(self, base: int, lengths: np.ndarray, sequence: bytes, rules: bytes, sizes: bytes):
        self.base = base
        self.symbols = np.frombuffer(sequence, "<u4").astype(np.int64)
        self.pairs = np.frombuffer(rules, "<u4").astype(np.int64).reshape(-1, 2)
        self.sizes = np.concatenate([[1], np.frombuffer(sizes, "<u4").astype(np.int64)])
        self.ends = np.cumsum(self._size(self.symbols))
        self.docs = np.concatenate([[0], np.cumsum(lengths)])
        self.opened = 0

    def _size(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        return self.sizes[np.maximum(symbols - self.base + 1, 0)]

    def _open(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every one of ``symbols``, end to end, and where each starts; rules are opened level by level."""
        upto = np.cumsum(self._size(symbols))
        out = np.empty(int(upto[-1]), np.int64)
        starts = upto - self._size(symbols)
        at = starts
        while len(symbols):
            plain = symbols < self.base
            out[at[plain]] = symbols[plain]
            rule, at = symbols[~plain] - self.base, at[~plain]
            self.opened += len(rule)
            left, right = self.pairs[rule, 0], self.pairs[rule, 1]
            symbols, at = np.concatenate([left, right]), np.concatenate([at, at + self._size(left)])
        return out, starts

    def documents(self, i: int, j: int) -> np.ndarray:
        """Ids of documents i to j - 1, end to end."""
        a, b = int(self.docs[i]), int(self.docs[j])
        if a == b:
            return np.zeros(0, np.int64)
        first, last = int(np.searchsorted(self.ends, a, "right")), int(np.searchsorted(self.ends, b, "left"))
        own, which = np.unique(self.symbols[first : last + 1], return_inverse=True)
        ids, starts = self._open(own)
        size = self._size(own)[which]
        upto = np.cumsum(size)
        got = ids[np.repeat(starts[which] - (upto - size), size) + np.arange(int(upto[-1]))]
        skip = a - int(self.ends[first] - size[0])
        return got[skip : skip + b - a]

    def document(self, i: int) -> np.ndarray:
        return self.documents(i, i + 1)


def expand(symbols: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """Ids of a whole sequence of symbols."""
    spread = np.concatenate([[1], sizes])
    n = int(spread[np.maximum(symbols.astype(np.int64) - base + 1, 0)].sum())
    return Shard(base, np.array([n]), *(x.astype("<u4").tobytes() for x in (symbols, pairs, sizes))).document(0)


#: The file format: shards in Parquet, ``part`` and ``shard`` in document order.
FORMAT = "part int, shard int, base int, n_ids long, doc_ids array<long>, lengths array<long>, sequence binary, rules binary, sizes binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END) -> None:
    """Encode every whole text, add ``end_id``, and write the ids in shards in ascending order of doc_id.

    ``docs`` has doc_id and text; other columns are ignored.  A null text is
    empty: its document is the end id alone.  Rows that share a doc_id stay in
    order of their texts' hashes; null doc_ids come first.  An empty table
    writes no shard.  Documents are dealt and sorted by ranges of doc_id; a
    task writes shards of about ``SHARD_IDS`` ids, each with a grammar of its
    own, through Spark's Parquet writer, so a lost task is simply written again.
    """

    characters = known(tokenizer_path(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer, characters)
        base = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        base = max(base, end_id + 1)
        part, shard = TaskContext.get().partitionId(), 0
        ids, keys, lengths, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            s, pairs, sizes = repair(np.concatenate(ids), base)
            row = [part, shard, base, size, keys, np.concatenate(lengths), s.astype("<u4").tobytes(), pairs.astype("<u4").tobytes(), sizes.astype("<u4").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in FORMAT.split(", ")])

        for batch in batches:
            texts, own = batch.column("text").fill_null("").to_pylist(), batch.column("doc_id").to_pylist()
            at = 0
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and (n < PIECE or end == at):
                    n += len(texts[end])
                    end += 1
                got, starts = encoder.encode(texts[at:end])
                ids.append(np.insert(got, starts[1:], end_id))
                lengths.append(np.diff(starts) + 1)
                keys += own[at:end]
                size += len(ids[-1])
                if size >= SHARD_IDS:
                    yield flush()
                    shard, ids, keys, lengths, size = shard + 1, [], [], [], 0
                at = end
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    measured = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    n = max(1, -(-measured[1] // PART_BYTES), -(-measured[0] // 2_000_000))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, FORMAT).write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = True, ids: DataFrame | None = None) -> DataFrame:
    """What the files hold, per document in order: part, shard, doc_id, n_tokens, at (ids before it in the shard), ids_crc32, and ids.

    Documents are read from the compressed shards at random, runs of READ of
    them at a time (see ``Shard``), so that a task never holds a whole shard's
    ids.  ``ids`` (a table with doc_id, each once, small enough to be broadcast)
    asks for some documents only: no other is decoded.  Without ``with_ids`` the
    ids themselves stay in the task.  Files without shards give no rows; a
    document of the end id alone has one token; repeated and null doc_ids come
    as they were written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                lengths = r["lengths"].values.to_numpy()
                shard = Shard(r["base"].as_py(), lengths, r["sequence"].as_py(), r["rules"].as_py(), r["sizes"].as_py())
                keys = r["doc_ids"].values
                if "wanted" in r:
                    rows = np.flatnonzero(np.isin(keys.fill_null(-1).to_numpy(), r["wanted"].values.to_numpy()) & keys.is_valid().to_numpy(zero_copy_only=False))
                    runs = [(int(x), int(x) + 1) for x in rows]
                else:
                    runs = [(a, min(a + READ, len(lengths))) for a in range(0, len(lengths), READ)]
                for a, b in runs:
                    flat, cuts = shard.documents(a, b).astype("<u4"), shard.docs[a : b + 1] - shard.docs[a]
                    parts = [flat[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
                    columns = [pa.array([r["part"].as_py()] * (b - a), pa.int32()), pa.array([r["shard"].as_py()] * (b - a), pa.int32()), keys[a:b], pa.array(lengths[a:b]), pa.array(shard.docs[a:b]), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                    names = ["part", "shard", "doc_id", "n_tokens", "at", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    shards = spark.read.parquet(path)
    if ids is not None:
        wanted = ids.where("doc_id IS NOT NULL").agg(F.collect_set(F.col("doc_id").cast("long")).alias("wanted"))
        shards = shards.crossJoin(F.broadcast(wanted)).where(F.arrays_overlap("doc_ids", "wanted"))  # one row: the whole request
    return shards.mapInArrow(run, "part int, shard int, doc_id long, n_tokens long, at long, ids_crc32 long" + ", ids binary" * with_ids)


def index_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files.

    Running sums over the shards go over ranges of them and then within one.
    Documents are as in ``read_tokens``; files without shards give no rows.
    """
    shards = spark.read.parquet(path).select("part", "shard", "n_ids")
    first = running(shards, [F.col("part"), F.col("shard")], {"first": F.col("n_ids")}, "token-shards").drop("n_ids")
    docs = read_tokens(spark, path, False)
    first = F.broadcast(first) if small_enough(first) else first
    return docs.join(first, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """Token files of ``documents``, written and read back: see ``write_tokens`` and ``read_tokens``.

    A null text is the end id alone; repeated doc_ids have a row each; an empty
    table gives no rows.
    """
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return index_tokens(spark, path)
