"""Secret scans with structural confirmation of encoded candidates."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{3,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY)-----((?:(?!-----).)+)-----END \1-----", re.S)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
#: Base64 over several lines.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/_-]{40,}\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+={0,2}")
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
#: Kinds in the order in which spans with the same start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "token", "pem", "key", "hexkey")
#: A text that this does not hit holds no span of any kind.
HINT = r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=])|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_-]{24}|-----BEGIN |[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{3,}\."

OPENSSH = b"openssh-key-v1\0"
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def _der(data: bytes, at: int, end: int, depth: int = 0) -> set[int] | None:
    """Tags of the DER values that fill data[at:end] exactly, nested ones included; None if a length does not fit."""
    tags: set[int] = set()
    while at < end:
        if at + 2 > end or depth > 8:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + n > end:
            return None
        tags.add(tag)
        if tag & 0x20:
            inner = _der(data, at, at + n, depth + 1)
            if inner is None:
                return None
            tags |= inner
        at += n
    return tags


def _fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields that fill ``data`` exactly; None if a length does not fit."""
    at, fields = 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return fields


def _ssh(data: bytes) -> bool:
    """Whether bytes are the SSH encoding of a public key: its kind, then its numbers."""
    fields = _fields(data)
    return fields is not None and len(fields) >= 2 and fields[0] in SSH_NAMES


def _openssh(data: bytes) -> bool:
    """Whether bytes are an OpenSSH key file: cipher, key derivation, the public keys it counts, and one private part."""
    at, head = len(OPENSSH), []
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        head.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    if at + 4 > len(data) or not head[0].isascii() or not head[0]:
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    rest = _fields(data[at + 4 :])
    return rest is not None and count >= 1 and len(rest) == count + 1 and all(map(_ssh, rest[:-1])) and bool(rest[-1])


def is_key(data: bytes) -> bool:
    """Whether bytes are a key: a DER sequence with numbers or strings, or the SSH encodings, every nested length fitting."""
    if data.startswith(OPENSSH):
        return _openssh(data)
    if len(data) >= 24 and data[0] == 0x30:
        tags = _der(data, 0, len(data))
        return tags is not None and bool(tags & {0x02, 0x03, 0x04})
    return len(data) >= 24 and data[:3] == b"\0\0\0" and _ssh(data)


def pem_holds_key(body: str) -> bool:
    """Whether what a PEM frame holds is a key.

    Line breaks may be written out (``\\n``), and lines with headers may come
    first.  A body that its headers call encrypted is no DER: it is a key if it
    is whole cipher blocks.
    """
    lines = [x.strip() for x in body.replace("\\r", "").replace("\\n", "\n").split("\n")]
    headers = [x for x in lines if ":" in x]
    data = decode64("".join(x for x in lines if ":" not in x))
    if data is None:
        return False
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in headers) and any(x.startswith("DEK-Info:") for x in headers):
        return len(data) >= 24 and len(data) % 8 == 0
    return is_key(data)


def wrapped_key(text: str) -> int:
    """How much of a base64 text over several lines is a key: its length, with the last line or without; 0 if none is."""
    head = text[: text.rindex("\n")].rstrip()
    return next((len(x) for x in (text, head) if "\n" in x and is_key(decode64(x) or b"")), 0)


def decode64(text: str) -> bytes | None:
    """Bytes of a base64 text in either alphabet, padded or not; None if it is none."""
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Whether a dotted text is a signed token: its first part decodes to a JSON object that names an algorithm, its second to JSON."""
    parts = text.split(".")
    try:
        head = json.loads(decode64(parts[0]) or b"")
        json.loads(decode64(parts[1]) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that only decoding confirms."""
    found = [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if is_signed_token(m.group())]
    found += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if pem_holds_key(m.group(2))]
    found += [(m.start(), m.end(), "key") for m in BASE64.finditer(text) if is_key(decode64(m.group()) or b"")]
    found += [(m.start(), m.start() + n, "key") for m in WRAPPED.finditer(text) if (n := wrapped_key(m.group()))]
    found += [(m.start(), m.end(), "hexkey") for m in HEX_BYTES.finditer(text) if is_key(bytes.fromhex(m.group()))]
    return found


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every stretch that spans cover replaced by ``[secret]``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = b
    return "".join([*out, text[at:]])


def _hits(texts: pa.Array) -> list[int]:
    """Rows that can hold a span."""
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, HINT), False)).to_pylist()


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n = batch.num_rows
        counts = {k: [0] * n for k in KINDS[:3]}
        digests, listing = [empty] * n, [""] * n
        texts = batch.column("text")
        for i in _hits(texts):
            text = texts[i].as_py()
            base = base_spans(text)
            more = confirmed_spans(text)
            for _, _, kind in base:
                counts[kind][i] += 1
            if base:
                digests[i] = hashlib.sha256(listed(base).encode()).hexdigest()
            listing[i] = listed(base + more)
        longs = [pa.array(counts[k], pa.int64()) for k in KINDS[:3]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *longs, pa.array(digests, pa.string()), pa.array(listing, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text: counts of the base kinds, a digest of their spans, and all spans.

    ``docs`` has doc_id and text; other columns are ignored.  Base kinds are
    found by pattern.  Further spans are reported only if they decode: base64
    and hex (in one line, in several, or in a PEM frame) to key encodings whose
    nested lengths fit to the last byte, dotted texts to a JSON header with an
    algorithm.  Positions are code points, ends
    exclusive.  A null text is empty and has no spans, repeated rows are
    scanned each, and an empty table gives no rows.  One pass over the rows,
    no shuffle.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, SCHEMA)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``[secret]``; ``n_chars`` follows the text.

    All rows and columns stay, repeated rows too; null texts stay null, a null
    ``n_chars`` stays null, and an empty table stays empty.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at)
            changed = {}
            for i in _hits(texts):
                text = texts[i].as_py()
                if spans := base_spans(text) + confirmed_spans(text):
                    changed[i] = redacted(text, spans)
            if changed:
                rows = texts.to_pylist()
                for i, text in changed.items():
                    rows[i] = text
                columns = list(batch.columns)
                columns[at] = pa.array(rows, batch.schema.field(at).type)
                if "n_chars" in names:
                    k = batch.schema.get_field_index("n_chars")
                    lengths = columns[k].to_pylist()
                    for i, text in changed.items():
                        lengths[i] = len(text) if lengths[i] is not None else None
                    columns[k] = pa.array(lengths, batch.schema.field(k).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document: see ``scan_secrets``.  A null text has none; repeated rows have a row each; an empty table gives no rows."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
