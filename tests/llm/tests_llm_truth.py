"""The pipeline by brute force; of the mix only the copies come from its operator's own counts."""

import numpy as np
import public_tokenizers
from test_documents import jaccard_truth
from tokenizers import Tokenizer

from waymark.llm import mixing, quality_rules, secrets


def pipeline_truth(docs):
    spark, names = docs.sparkSession, docs.columns
    ok = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    rows = [tuple(r) for r in docs.collect() if r.doc_id in ok]
    truth = jaccard_truth(rows)
    rows = [r for r in rows if truth[r[0]][1] == r[0]]
    clean = []
    for r in rows:
        spans = secrets.base_spans(r[1]) + secrets.confirmed_spans(r[1])
        clean.append((r[0], secrets.redacted(r[1], spans), *r[2:]))
    taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix_sources(spark.createDataFrame(clean, docs.schema)).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in clean:
        ids = np.array(t.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes()
        out += [(r[0], ids)] * taken[r[0]]
    assert names[0] == "doc_id"
    return sorted(out)
