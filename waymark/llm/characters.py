"""What the tokenizers library takes code points for: its letters, numbers and blanks, and its lower-casing."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex

#: Classes of characters: letters, numbers, white space, others.
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Between code points that are normalized together: never changed, nor joined with a neighbour.
SEPARATOR = "\x01"
#: Code points other than surrogates, which no text has.
_ALL = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
_found: dict[str, tuple] = {}


def classes(tokenizer) -> np.ndarray:
    """Rows of first code point and class: the code points up to the next row's are of that class.

    Asked of the library's own splitting, for a tokenizer that splits runs of
    letters, of numbers (or each) and of other marks, and drops white space or
    keeps it: all code points in a row are split at once, which gives runs of one
    class; then one of each run is tried behind a letter, a number and a mark.
    """
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    dropped = not split(" ")
    points = _ALL[_ALL != 0x20]  # a blank goes with what follows it
    pieces = [at for _, at in split("".join(map(chr, points)))]
    starts = sorted({0, *(a for a, _ in pieces), *(b for _, b in pieces if b < len(points))})

    def kind(c: str) -> int:
        joined = lambda before: len(split(before + c)) == 1 and split(before + c)[0][1] == (0, 2)
        if joined("a"):
            return LETTER
        if joined("!"):
            return OTHER
        return (NUMBER if split(c) else SPACE) if dropped else NUMBER if joined("1") else SPACE

    table = np.full(0x110000, OTHER, np.uint8)
    for a, b in zip(starts, [*starts[1:], len(points)]):
        table[points[a:b]] = kind(chr(points[a]))
    table[0x20] = SPACE
    first = np.flatnonzero(np.append(True, table[1:] != table[:-1]))
    return np.stack([first, table[first]], 1)


def table(rows: np.ndarray) -> np.ndarray:
    """The class of every code point, from the rows of ``classes``."""
    return np.repeat(rows[:, 1], np.diff(np.append(rows[:, 0], 0x110000))).astype(np.uint8)


def bracket(rows: np.ndarray, kind: int) -> str:
    """The inside of a bracket expression for a class."""
    ends = np.append(rows[1:, 0], 0x110000) - 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for (a, k), b in zip(rows, ends) if k == kind)


def lowered(text: str) -> str:
    """A text in Unicode's composed form and lower case, as this Python has them; a final sigma is an ordinary one."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def unlike(tokenizer, rows: np.ndarray) -> np.ndarray:
    """First and last of the ranges of code points that Python and the library may take for something else.

    These are the ones that Python does not know, that the library's normalizer
    changes to something else (alone or among accents above and below), and whose
    class is another one in the regex module.
    """
    known_ = [c for c in map(chr, _ALL) if c != SEPARATOR and unicodedata.category(c) != "Cn"]
    odd = np.zeros(0x110000, bool)
    odd[[ord(c) for c in map(chr, _ALL) if unicodedata.category(c) == "Cn"]] = True
    for probe in ("{0}", "{0}\u0301{0}\u0323{0}"):
        texts = [probe.format(c) for c in known_ if not c.isspace()]
        theirs = tokenizer.normalizer.normalize_str(SEPARATOR.join(texts)).split(SEPARATOR)
        odd[[ord(x[0]) for x, t in zip(texts, theirs) if t != lowered(x)]] = True
    here = np.full(0x110000, OTHER, np.uint8)
    for kind, mark in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        here[[ord(c) for c in regex.findall(mark, "".join(map(chr, _ALL)))]] = kind
    odd |= here != table(rows)
    odd[0xD800:0xE000] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], odd, [False]]).astype(np.int8)))
    return np.stack([edges[::2], edges[1::2] - 1], 1)


class Odd:
    """Whether a text has a code point of some ranges: a quick look first, which takes every one beyond U+FFFF for one."""

    def __init__(self, ranges: np.ndarray):
        low = "".join(f"\\u{a:04x}-\\u{min(b, 0xFFFF):04x}" for a, b in ranges if a < 0x10000)
        self.quick = re.compile(f"[{low}\\U00010000-\\U0010ffff]")
        steps = np.zeros(0x110001, np.int8)
        steps[ranges[:, 0]] += 1
        steps[ranges[:, 1] + 1] -= 1
        self.table = np.cumsum(steps[:-1]) > 0

    def in_(self, text: str) -> bool:
        return bool(self.quick.search(text)) and bool(self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def known(path: str) -> tuple:
    """``classes`` and, with a normalizer, ``unlike`` of a tokenizer file, worked out once per process: on the driver, which sends them with the tasks."""
    if path not in _found:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        rows = classes(tokenizer)
        _found[path] = (rows, unlike(tokenizer, rows) if tokenizer.normalizer else np.zeros((0, 2), np.int64))
    return _found[path]
