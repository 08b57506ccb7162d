"""Quality classifier: a byte-level convolutional network in numpy over whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.store import materialize
from waymark.llm.words import chunks, utf8

#: A filter sees WIDTH bytes and moves by STEP; a segment is SEGMENT filter places; a chunk is CHUNK segments and
#: starts every CHUNK - 1 of them, so that chunks overlap by one.
WIDTH, STEP, SEGMENT, CHUNK = 8, 4, 32, 4
EMBED, FILTERS = 8, 32
PAD = STEP * SEGMENT


@dataclass
class Network:
    """Byte embedding, filters, and the weights of the two poolings."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float


def segments(net: Network, data: np.ndarray, offsets: np.ndarray, keep: bool = False):
    """Highest response of every filter in every segment, and each text's first segment (one more at the end).

    Texts are laid on a grid of whole segments, padded by STEP zero bytes or
    more, and every byte of every text is under some filter place.  A text's
    last place, which reaches into the next text, does not count.
    """
    n = np.diff(offsets)
    cells = -(-(n + STEP) // PAD)
    firsts = np.concatenate([[0], np.cumsum(cells)])
    ends = firsts[1:] - 1
    grid = np.zeros(firsts[-1] * PAD + WIDTH, np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    grid[np.arange(len(data)) - offsets[row] + firsts[row] * PAD] = data
    out = np.empty((firsts[-1], FILTERS), np.float32)
    arg = np.empty((firsts[-1], FILTERS), np.int64) if keep else None
    step = 2048  # segments at a time
    for a in range(0, int(firsts[-1]), step):
        b = min(a + step, int(firsts[-1]))
        e = net.embed[grid[a * PAD : b * PAD + WIDTH]]
        w = np.lib.stride_tricks.as_strided(e, ((b - a) * SEGMENT, WIDTH * EMBED), (e.strides[0] * STEP, e.strides[1]))
        z = (np.ascontiguousarray(w) @ net.filters + net.bias).reshape(b - a, SEGMENT, FILTERS)
        z[ends[(ends >= a) & (ends < b)] - a, -1] = -np.inf
        if keep:
            best = z.argmax(1)
            out[a:b] = np.take_along_axis(z, best[:, None], 1)[:, 0]
            arg[a:b] = best + (np.arange(a, b) * SEGMENT)[:, None]
        else:
            out[a:b] = z.max(1)
    np.maximum(out, 0, out=out)
    return out, firsts, grid, arg


def pooled(seg: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the highest response of each filter in any chunk, and the mean over chunks of each chunk's highest; and the chunks' texts and starts."""
    n = np.diff(firsts)
    per = np.maximum(1, -(-(n - 1) // (CHUNK - 1)))
    text = np.repeat(np.arange(len(n)), per)
    first = np.concatenate([[0], np.cumsum(per)])
    start = firsts[text] + (np.arange(len(text)) - first[text]) * (CHUNK - 1)
    last = firsts[text + 1] - 1
    chunk = seg[start]
    for i in range(1, CHUNK):
        chunk = np.maximum(chunk, seg[np.minimum(start + i, last)])
    top = np.maximum.reduceat(chunk, first[:-1])
    mean = np.add.reduceat(chunk, first[:-1]) / per[:, None]
    return top, mean, np.stack([text, start, last])


def score(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every text."""
    out = np.empty(len(offsets) - 1)
    for a, b in chunks(offsets, 1 << 21):
        seg, firsts, _, _ = segments(net, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        top, mean, _ = pooled(seg, firsts)
        out[a:b] = np.concatenate([top, mean], 1) @ net.head + net.offset
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit by Adam on the log loss, both labels weighing the same; the same rows give the same network."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 0.18, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.05, 2 * FILTERS).astype(np.float32), 0.0,
    )
    net.embed[0] = 0
    share = float(np.mean(labels)) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        net.head[:] = 0
        net.offset = 3.0 if share == 1.0 else -3.0 if len(labels) else 0.0
        return net
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    moments = [[np.zeros_like(x, np.float64), np.zeros_like(x, np.float64)] for x in (net.embed, net.filters, net.bias, net.head)] + [[0.0, 0.0]]
    t = 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs * 0.8)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            own = [texts[i] for i in rows]
            data = np.frombuffer(b"".join(own), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            seg, firsts, grid, arg = segments(net, data, offsets, True)
            top, mean, place = pooled(seg, firsts)
            x = np.concatenate([top, mean], 1)
            p = 1 / (1 + np.exp(-np.clip(x @ net.head + net.offset, -30, 30)))
            d = (p - labels[rows]) * weight[rows] / len(rows)
            grads = [None, None, None, x.T @ d + 1e-4 * net.head, float(d.sum())]
            # back through the poolings: each chunk's highest segment, and the chunk that is highest in its text
            text, start, last = place
            stack = np.stack([seg[np.minimum(start + i, last)] for i in range(CHUNK)])
            which = stack.argmax(0)
            from_seg = np.minimum(start[:, None] + which, last[:, None])
            chunk = np.take_along_axis(stack, which[None], 0)[0]
            per = np.bincount(text, minlength=len(rows))
            g_mean = (d[:, None] * net.head[FILTERS:])[text] / per[text][:, None]
            tie = (chunk >= top[text]).astype(np.float64)
            count = np.zeros_like(top, dtype=np.float64)
            np.add.at(count, text, tie)
            g = g_mean + (d[:, None] * net.head[:FILTERS])[text] * tie / count[text]
            f = np.broadcast_to(np.arange(FILTERS), from_seg.shape)
            g_seg = np.zeros(seg.shape)
            np.add.at(g_seg, (from_seg, f), g)
            g_seg *= seg > 0
            r, f = np.nonzero(g_seg)
            value = g_seg[r, f]
            window = (arg[r, f] * STEP)[:, None] + np.arange(WIDTH)
            bytes_ = grid[window]
            seen = net.embed[bytes_].reshape(len(r), -1)
            g_filters = np.zeros_like(net.filters, dtype=np.float64)
            for i in range(FILTERS):
                at_i = f == i
                g_filters[:, i] = seen[at_i].T @ value[at_i]
            grads[1], grads[2] = g_filters, np.bincount(f, value, FILTERS)
            back = (net.filters[:, f].T * value[:, None]).reshape(-1, EMBED)
            g_embed = np.stack([np.bincount(bytes_.ravel(), back[:, i], 256) for i in range(EMBED)], 1)
            g_embed[0] = 0
            grads[0] = g_embed
            t += 1
            params = [net.embed, net.filters, net.bias, net.head]
            for i, grad in enumerate(grads):
                m = moments[i]
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * np.square(grad)
                change = lr * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
                if i < 4:
                    params[i] -= change.astype(np.float32)
                else:
                    net.offset -= float(change)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = 900) -> list:
    """A bounded sample of labelled texts, whole: the ``per_label`` documents of either label with the lowest hashes.

    Documents are drawn from those that have a text and a label and are not held
    out, so that none that cannot be learned from takes a place.  Of differing
    labels of a document the more frequent one counts, and 0 where they tie; of
    differing texts under one doc_id the least one.  Null texts, null doc_ids
    and labels other than 0 and 1 are left out; with empty tables there are no
    rows.  The driver holds at most ``2 * per_label`` texts.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") > 0.5).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    known = texts.select("doc_id").join(own, "doc_id").distinct()
    order = F.xxhash64(F.col("doc_id"), F.lit("train"))
    zero, one = (known.where(F.col("label") == label).orderBy(order, "doc_id").limit(per_label) for label in (0, 1))
    drawn = materialize(zero.unionByName(one), "drawn-labels")
    found = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.orderBy(order, "doc_id").select("text", "label").collect()


def with_crops(texts: list[bytes], labels: list[int], seed: int = 11) -> tuple[list[bytes], np.ndarray]:
    """The rows and, for every text of label 1, a short crop of it at word ends: so that brevity alone is no fault."""
    rng = np.random.default_rng(seed)
    more = []
    for text, label in zip(texts, labels):
        if label == 1 and len(text) > 40:
            at = int(rng.integers(0, len(text) - 20))
            words = text[at : at + int(rng.integers(20, 400))].split(b" ")
            more.append(b" ".join(words[1:-1] or words))
    return texts + more, np.array(labels + [1] * len(more), np.float64)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 900) -> Network:
    """A network learned from ``training_rows``; without rows of both labels it scores all texts alike."""
    rows = training_rows(docs, labels, per_label)
    return train(*with_crops([r["text"].encode() for r in rows], [r["label"] for r in rows]))


def classify(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    ``docs`` has doc_id and text; other columns are ignored and never inputs of
    a score.  A null text is scored as an empty one; repeated rows are scored
    each; an empty table gives no rows.  The network (some 20 kB) goes out with
    the tasks; rows are not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score(net, *utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of every document: see ``classify`` and ``training_rows``.

    Null and empty texts have the same score; repeated rows are scored each; an
    empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
