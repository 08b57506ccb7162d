"""A compressed FM-index over words: wavelet tree, backward search, matching statistics."""

from __future__ import annotations

import numpy as np

#: Depth to which suffixes are told apart; patterns are at most so long.
DEPTH = 31


class WaveletTree:
    """Ranks of symbols in a sequence; one packed bitmap with block counts per bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        n = len(symbols)
        s = symbols.astype(np.uint32)
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> np.uint32(level)) & np.uint32(1)).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int32)
            self.bits.append(words)
            self.counts.append(np.cumsum(ones, dtype=np.int32) - ones)
            self.zeros.append(n - int(ones.sum()))
            s = np.concatenate([s[~bit], s[bit]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of each symbol's prefix ends up below the last level."""
        at = at.copy()
        for i, (words, counts, zeros) in enumerate(zip(self.bits, self.counts, self.zeros)):
            block = at >> 6
            inside = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            one = counts[block] + np.bitwise_count(inside)
            high = (symbol >> (self.levels - 1 - i)) & 1
            at = np.where(high == 1, zeros + one, at - one)
        return at


def _highest(x: np.ndarray) -> np.ndarray:
    """Place of the highest one bit of every word (none is zero)."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return np.bitwise_count(x).astype(np.int64) - 1


class Marks:
    """Marked places as a bitmap, with the nearest word before and after that has a mark: two bits per place."""

    def __init__(self, marked: np.ndarray):
        n = len(marked)
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = marked
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        own = np.arange(len(self.words), dtype=np.int32)
        some = self.words != 0
        self.before = np.maximum.accumulate(np.where(some, own, -1)).astype(np.int32)
        self.after = np.minimum.accumulate(np.where(some, own, len(own))[::-1])[::-1].astype(np.int32)

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last mark at or before each place, and the first one behind it; both must be there."""
        word, upto = at >> 6, (np.uint64(2) << (at & 63).astype(np.uint64)) - np.uint64(1)
        own = self.words[word]
        low, high = own & upto, own & ~upto
        far = low == 0
        place = np.where(far, self.before[np.maximum(word - 1, 0)], word)
        last = (place << 6) + _highest(np.where(far, self.words[place], low))
        far = high == 0
        place = np.where(far, self.after[np.minimum(word + 1, len(self.words) - 1)], word)
        rest = np.where(far, self.words[place], high)
        return last, (place << 6) + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))


class FmIndex:
    """Compressed index of one text of symbols; 0 ends each of its parts and is in no pattern.

    It holds a wavelet tree over the symbols before the sorted suffixes, and per
    depth a bitmap of the places of the order where the first symbols change.
    The order itself is not kept.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int):
        n = len(text)
        self.text, self.depth, self.n = text, depth, n
        ranks = [text.astype(np.int64)]
        order, k = np.zeros(0, np.int64), 1
        while k <= DEPTH:
            r = ranks[-1]
            far = np.zeros(n, np.int64)
            far[: max(n - k, 0)] = r[k:] + 1
            key = r * (int(r.max(initial=0)) + 2) + far
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(False, sorted_key[1:] != sorted_key[:-1]))
            ranks.append(rank)
            k *= 2
        del ranks[5:]
        # common prefix of neighbours in the order, up to the depth, by the ranks of 16, 8, 4, 2 and 1 symbols
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n - 1, np.int64)
        for level in (4, 3, 2, 1, 0):
            ok = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[ok] = ranks[level][a[ok]] == ranks[level][b[ok]]
            step = np.where(same, 1 << level, 0)
            common += step
            a += step
            b += step
        del ranks
        # the whole order is one block of depth 0; there is a mark behind the last place too
        self.marks = [Marks(np.concatenate([[True], common < d, [True]])) for d in range(depth + 1)]
        self.tree = WaveletTree(np.where(order > 0, text[order - 1], 0), n_symbols)
        count = np.bincount(text, minlength=n_symbols)
        self.shift = np.cumsum(count) - count - self.tree.follow(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A step of backward search: the interval of the pattern with ``symbol`` before it."""
        m = len(lo)
        got = self.tree.follow(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.shift[symbol]] * 2)
        return got[:m], got[m:]

    def matches(self, lane: int = 96) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text where ``depth`` symbols match that are there twice or more, and the intervals (by their first place) that they match.

        Matching statistics of the text against the index: stretches are read
        from right to left, many side by side.  A match is extended by one
        symbol; if too few suffixes are left, it is cut at its right end by one
        symbol at a time, to the marks of its depth around it, until it can be
        extended or is empty.  Where a match has the full depth its interval is
        reported.
        """
        text, depth, n = self.text, self.depth, self.n
        places, intervals = [], []
        ends = np.minimum(np.arange(lane, n + lane, lane), n)
        starts = np.arange(0, n, lane)
        at = np.minimum(ends + depth - 1, n)
        lo, hi, length = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64), np.zeros(len(at), np.int64)
        live = np.flatnonzero(at > starts)
        while len(live):
            place = at[live] - 1
            symbol = text[place]
            own_lo, own_hi, own = lo[live], hi[live], length[live]
            blank = symbol == 0
            own_lo[blank], own_hi[blank], own[blank] = 0, n, 0
            todo = np.flatnonzero(~blank)
            full = todo[own[todo] == depth]
            self._cut(own_lo, own_hi, own, full)
            while len(todo):
                a, b = self.extend(symbol[todo], own_lo[todo], own_hi[todo])
                good = b - a >= 2
                hit = todo[good]
                own_lo[hit], own_hi[hit] = a[good], b[good]
                own[hit] += 1
                todo = todo[~good]
                todo = todo[own[todo] > 0]
                self._cut(own_lo, own_hi, own, todo)
            lo[live], hi[live], length[live] = own_lo, own_hi, own
            at[live] = place
            found = np.flatnonzero((own == depth) & (place < ends[live]))
            places.append(place[found])
            intervals.append(own_lo[found])
            live = live[place > starts[live]]
        return (np.concatenate(places), np.concatenate(intervals)) if places else (np.zeros(0, np.int64),) * 2

    def repeated(self, lane: int = 96) -> np.ndarray:
        """For every place of the text, the first place with the same ``depth`` symbols; -1 if there is no other or fewer symbols.

        Equal stretches report one interval: the first place of the text that
        reports it is the first one of its kind.
        """
        place, interval = self.matches(lane)
        order = np.lexsort((place, interval))
        place, interval = place[order], interval[order]
        new = np.append(True, interval[1:] != interval[:-1])[: len(place)]
        out = np.full(self.n, -1, np.int64)
        out[place] = place[np.flatnonzero(new)][np.cumsum(new) - 1]
        return out

    def _cut(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray, rows: np.ndarray) -> None:
        """Shorten the matches of ``rows`` by their last symbol."""
        if not len(rows):
            return
        length[rows] -= 1
        for d in np.unique(length[rows]):
            of = rows[length[rows] == d]
            lo[of], hi[of] = self.marks[d].around(lo[of])
