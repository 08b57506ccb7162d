"""Ids of unusual characters against the tokenizers library, in both encoders."""

import random
import unicodedata

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from waymark.llm import bpe, characters, token_store  # noqa: E402


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def points(path):
    """Edges of all classes and of what Python knows, combining marks, cased letters, and a draw of the rest."""
    rows, _ = characters.known(path)
    known = [unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)]
    edges = {int(c) for c in rows[:, 0]} | {c for c in range(1, 0x110000) if known[c] != known[c - 1]}
    marks = {c for c in range(0x110000) if unicodedata.combining(chr(c)) or chr(c).lower() != chr(c)}
    drawn = random.Random(1).sample(range(0x110000), 3000)
    some = {c + d for c in edges for d in (-1, 0)} | marks | {*drawn, *range(0x3000), 0x558, 0xC5C, 0x208F, 0x1C89, 0x13460, 0x10D40, 0x3FC3C, 0x7FD}
    return [chr(c) for c in sorted(some) if 0 <= c < 0x110000 and not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("context", ["a{c}b", "a{c}1{c}{c} x {c}'s", "{c} {c}\n{c}́{c}", "e{c}̣{c}A {c}̴́{c}"], ids=ascii)
def test_ids_of_any_character(context):
    word, byte = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    texts = [context.format(c=c) for c in points(word)]
    want = library(word).encode_batch(texts, add_special_tokens=False)
    got = bpe.Coder(word).encode(texts)
    assert [ascii(t) for t, g, w in zip(texts, got, want) if np.frombuffer(g, "<u4").tolist() != w.ids] == []
    texts = [context.format(c=c) for c in points(byte)]
    want = library(byte).encode_batch(texts, add_special_tokens=False)
    ids, at = token_store.Encoder().encode(texts)
    assert [ascii(t) for t, a, b, w in zip(texts, at, at[1:], want) if ids[a:b].tolist() != w.ids] == []


def test_classes_are_those_of_plain_characters():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        kinds = characters.table(characters.known(public_tokenizers.path(name))[0])
        for text, kind in (("azAZéßΩж中", characters.LETTER), ("09²٣", characters.NUMBER), (" \t\n 　 ", characters.SPACE), ("!'_-́€😀", characters.OTHER)):
            assert {int(kinds[ord(c)]) for c in text} == {kind}
