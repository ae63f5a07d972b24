"""The pipeline, stage by stage, against plain Python versions of its decisions."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pointloom.llm import queries, secrets
from pointloom.llm.common import written

from . import brute
from .test_native import edges  # noqa: F401


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in queries.op3_quality_rules(spark, sf).collect() if r.kept}
    columns, text = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf), f"test-{k}")
        steps.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    assert {r.doc_id for r in steps[0]} == kept and 0.7 * len(text) < len(kept) < len(text)
    near = brute.near({d: text[d] for d in kept}, 5)
    assert {r.doc_id for r in steps[1]} == {d for d, (_, c) in near.items() if d == c} and len(steps[1]) < len(steps[0])
    assert {r.doc_id for r in steps[2]} == {r.doc_id for r in steps[1]}
    changed = 0
    for r in steps[2]:
        spans = brute.secrets(text[r.doc_id])
        assert not brute.secrets(r.text) and (("[SECRET]" in r.text) or not spans)
        assert spans or r.text == text[r.doc_id]
        changed += bool(spans)
        assert r.n_chars == len(r.text)
    assert changed
    sizes = Counter()
    for r in steps[2]:
        sizes[r.source] += len(brute.words(r.text))
    goal, took = brute.targets(dict(sizes)), Counter()
    for r in steps[3]:
        took[r.source] += len(brute.words(r.text))
    longest = max(len(brute.words(r.text)) for r in steps[2])
    assert all(abs(took[s] - goal[s]) <= longest for s in goal) and max(Counter(r.doc_id for r in steps[3]).values()) <= 3
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter((r.doc_id, r.text) for r in steps[4]) == Counter((r.doc_id, r.text) for r in steps[3])
    for r in steps[4][:200]:
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, sf, edges, empty):  # noqa: F811
    docs = (edges.limit(0) if empty else edges).withColumn("ids", F.lit(1)).withColumn("kept", F.lit(1))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, sf), f"edge-{k}")
        assert k == 4 or docs.columns == before.columns
        assert docs.count() <= 3 * before.count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and secrets.KINDS
