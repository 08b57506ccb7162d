"""Byte-pair encoding and decoding by batched merge rounds on arrays."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from waymark.llm.characters import LETTER, NUMBER, SPACE, Odd, bracket, known, lowered

#: Words kept with their ids between batches of a task; beyond, the table starts anew.
KEPT_WORDS = 400_000
#: Symbols that go through merge rounds at a time.
SYMBOLS = 2_000_000
#: Bytes of a word beyond which it goes through merge rounds by itself.
LONG = 4096
#: Characters of text that are split into words at a time.
PIECE = 4_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """The tokenizer of a ``tokenizers`` file: lower-cased words whose last symbol carries a word end.

    What is a letter, number or blank, and how it is lower-cased, is the
    library's: ``characters`` is what ``known`` has found for the file.  Texts
    with code points that Python or the regex module treats otherwise are
    normalized by the library and split by its classes.
    """

    def __init__(self, path: str, characters: tuple | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = np.empty(max([*vocab.values(), *self.special.values()]) + 1, object)
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.base = len(self.names)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.place = np.argsort(order)  # of a rank among the sorted keys
        classes, odd = characters or known(path)
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.plain = regex.compile(pattern)
        for mark, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):  # all within brackets
            pattern = pattern.replace(mark, bracket(classes, kind))
        self.split = re.compile(pattern)
        self.odd, self.path, self.library = Odd(odd), path, None
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @staticmethod
    def _check(spec: dict) -> None:
        """Files of another kind are refused, as their texts would be split or written in another way."""
        normalizers = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if spec["model"]["type"] != "BPE" or normalizers != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or spec.get("decoder"):
            raise ValueError("not a tokenizer of lower-cased words with word ends")

    def words(self, text: str) -> list[str]:
        """The words of a text, special tokens included as they stand."""
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text.lower())
        return self.split.findall(self._normalized(text)) if self.odd.in_(text) else self.plain.findall(lowered(text))

    def _normalized(self, text: str) -> str:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).normalizer
        return self.library.normalize_str(text)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word starts in it (one more at the end).

        All words go through the merge rounds together.  A round looks up the
        rank of every adjacent pair by binary search over the sorted pair keys,
        takes the lowest rank in every word and merges that pair at each place,
        from the left, without overlap.  Words without a known pair are done.
        """
        raw = [w.encode() for w in words]
        alone = {i: self._long(w) for i, w in enumerate(raw) if len(w) > LONG}
        if alone:
            return self._with_long(raw, alone)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size)
        symbols[ends[size > 0] - 1] = self.last[data[ends[size > 0] - 1]]
        word = np.repeat(np.arange(len(raw)), size)
        done_symbols, done_words = [], []
        top = len(self.keys)
        while len(symbols):
            pair = symbols[:-1] * self.base + symbols[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == top] = 0
            known = (word[:-1] == word[1:]) & (self.keys[at] == pair)
            rank = np.where(known, self.ranks[at], top)
            rank = np.append(rank, top)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(word)))
            low = np.repeat(lowest, lengths)
            open_ = low < top
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, rank, low = symbols[open_], word[open_], rank[open_], low[open_]
                at = np.append(at, 0)[open_]
                if not len(symbols):
                    break
            else:
                at = np.append(at, 0)
            hit = rank == low
            # places in a run of hits that follow each other by one overlap; every second one merges
            where = np.flatnonzero(hit)
            run = np.flatnonzero(np.append(True, np.diff(where) != 1))
            inside = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
            where = where[inside % 2 == 0]
            symbols[where] = self.made[at[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(raw) + 1, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.searchsorted(word[order], np.arange(len(raw) + 1))


    def _with_long(self, raw: list[bytes], alone: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_words``, with the ids of some words known."""
        ids, starts = self.encode_words([b"".decode() if i in alone else w.decode() for i, w in enumerate(raw)])
        parts = [alone[i] if i in alone else ids[starts[i] : starts[i + 1]] for i in range(len(raw))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of one long word, in rounds that touch only what they merge.

        Places wait under the rank of their pair, and the lowest rank is next.
        Its places that still hold the pair are merged from the left, without
        overlap, and the pairs around them are looked up by binary search and
        wait in turn.
        """
        data = np.frombuffer(word, np.uint8)
        symbols = self.inner[data]
        symbols[-1] = self.last[data[-1]]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> None:
            at = at[(at >= 0) & (after[np.maximum(at, 0)] < n)]
            pair = symbols[at] * self.base + symbols[after[at]]
            k = np.searchsorted(self.keys, pair)
            k[k == len(self.keys)] = 0
            known = self.keys[k] == pair
            at, k = at[known], k[known]
            rank = self.ranks[k]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])[: len(rank)])
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(rank)).tolist()):
                if int(rank[a]) not in waiting:
                    heapq.heappush(heap, int(rank[a]))
                waiting.setdefault(int(rank[a]), []).append(at[a:b])

        look(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            k = int(self.place[rank])
            left, right = divmod(int(self.keys[k]), self.base)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[symbols[at] == left]
            at = at[after[at] < n]
            at = at[symbols[after[at]] == right]
            if not len(at):
                continue
            # places in a run that follow each other overlap; every second one merges
            run = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
            inside = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[inside % 2 == 0]
            gone = after[at]
            symbols[at], symbols[gone] = self.made[k], -1
            after[at] = after[gone]
            ends = after[at]
            before[ends[ends < n]] = at[ends < n]
            look(np.unique(np.concatenate([at, before[at]])))
        return symbols[symbols >= 0]


class Coder:
    """Encodes and decodes texts; keeps the ids of words it has met."""

    def __init__(self, path: str, characters: tuple | None = None):
        self.bpe = WordBpe(path, characters)
        self._start()

    def _start(self) -> None:
        self.ids = {k: np.array([v], "<u4").tobytes() for k, v in self.bpe.special.items()}

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > KEPT_WORDS:
            self._start()
        new = [w for w in words if w not in self.ids]
        at = 0
        while at < len(new):
            end, n = at, 0
            while end < len(new) and (n < SYMBOLS or end == at):
                n += len(new[end])
                end += 1
            symbols, starts = self.bpe.encode_words(new[at:end])
            data, cuts = symbols.astype("<u4").tobytes(), (starts * 4).tolist()
            self.ids.update(zip(new[at:end], [data[a:b] for a, b in zip(cuts, cuts[1:])]))
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        split = [self.bpe.words(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        get = self.ids.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """Names of the ids joined by spaces: what decoding gives where a tokenizer states no decoder."""
        return " ".join(self.bpe.names[np.frombuffer(ids, "<u4")].tolist())


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (n + len(texts[end]) <= PIECE or end == at):
            n += len(texts[end])
            end += 1
        yield at, end
        at = end


def _tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text.

    ``docs`` has doc_id and text; other columns are ignored.  A null text is
    empty and has no ids; repeated rows are encoded each; an empty table gives
    no rows.  ``tokenizer`` is the path of a tokenizer file on the driver and every executor;
    the default is the installed 49k word vocabulary.
    """

    characters = known(_tokenizer_path(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(_tokenizer_path(tokenizer), characters)
        for batch in batches:
            texts, ids = batch.column("text").fill_null("").to_pylist(), batch.column("doc_id")
            for a, b in _groups(texts):
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(coder.encode(texts[a:b]), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and text of every row of doc_id and ids; null ids decode to an empty text."""

    characters = known(_tokenizer_path(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(_tokenizer_path(tokenizer), characters)
        for batch in batches:
            texts = [coder.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the decoded text of every whole text.

    Encodes as ``bpe_encode`` and decodes as ``bpe_decode``, in one pass that
    ships neither ids nor decoded texts between processes.  Nulls, repeated rows
    and empty tables are as there.
    """

    characters = known(_tokenizer_path(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(_tokenizer_path(tokenizer), characters)
        for batch in batches:
            texts, keys = batch.column("text").fill_null("").to_pylist(), batch.column("doc_id")
            for a, b in _groups(texts):
                ids = coder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys[a:b],
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGESTS)


def op4_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Round trip of every document: see ``bpe_round_trip``.  A null text is empty; repeated rows have a row each; an empty table gives no rows."""
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
