"""The language model against plain versions of its counts, its probabilities and its gradient."""

import zlib

import numpy as np
import pytest

from pointloom.llm import lm, queries

from . import brute
from .test_native import edges  # noqa: F401


def small(seed=1):
    rng = np.random.default_rng(seed)
    top = [(b"w%d" % i, int(4000 / (i + 1))) for i in range(300)]
    lex = lm.Lexicon.of(top, 30000, 900)
    net = lm.Recurrent(lex, hidden=6)
    for p in net.params:
        p += rng.normal(0, 0.2, p.shape).astype(np.float32)
    return lex, net, rng


def test_probabilities_sum_to_one():
    lex, net, rng = small()
    words = np.arange(lex.n_model + 1)
    for _ in range(3):
        h = np.repeat(rng.normal(0, 0.5, (1, 6)).astype(np.float32), len(words), axis=0)
        assert np.exp(net.log_probs(h, words)).sum() == pytest.approx(1, abs=1e-4)
    rest = 10 ** lex.log_rest[lex.n_model :]
    unseen = 0.1 * (900 - 300 + 1) / lex.rest_mass
    assert lex.n_model == 300 and rest.sum() == 0 and unseen <= 1


def test_state_is_carried_over_whole_documents():
    lex, net, rng = small()
    docs = [rng.integers(0, lex.n_model + 1, n).astype(np.int32) for n in (1, 2, 700, 33, 32, 31, 64, 5)]
    want = []
    for d in docs:
        h, total = np.zeros((1, 6), np.float32), 0.0
        for w in d:
            total += net.log_probs(h, np.array([w]))[0]
            h, _ = net.step(h, np.array([w]))
        want.append(total)
    old = lm.LANES
    try:
        for lm.LANES in (1, 3, 100):
            assert net.score(docs) == pytest.approx(want, rel=1e-4)
    finally:
        lm.LANES = old
    assert len(net.score([])) == 0


def test_gradient_by_differences():
    lex, net, rng = small()
    x = rng.integers(0, lex.n_model + 1, (4, 7))
    net.params = [p.astype(np.float64) for p in net.params]

    def loss():
        h, total = np.zeros((4, 6)), 0.0
        for t in range(7):
            total -= net.log_probs(h.copy(), x[:, t]).sum()
            h, _ = net.step(h, x[:, t])
        return total / x.size

    got = {}
    net.update = lambda grads, used, rate: got.update(grads=grads, used=used)
    assert net.train(x) == pytest.approx(loss(), rel=1e-5)
    for k, p in enumerate(net.params):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if k == 0:
                at = (int(rng.choice(got["used"])), at[1])
            want = got["grads"][k][int(np.searchsorted(got["used"], at[0])), at[1]] if k == 0 else got["grads"][k][at]
            old = p[at]
            p[at] = old + 1e-4
            up = loss()
            p[at] = old - 1e-4
            down = loss()
            p[at] = old
            assert (up - down) / 2e-4 == pytest.approx(want, rel=2e-2, abs=2e-5)


def test_base_and_held_out_scores(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 10 == 0}
    want, n = brute.unigram(texts, held)
    old = lm.TOP_WORDS, lm.MODEL_WORDS
    try:
        lm.TOP_WORDS, lm.MODEL_WORDS = 3000, 600  # so that many words are met by the join
        got = queries.op4_lm_score(spark, sf).collect()
    finally:
        lm.TOP_WORDS, lm.MODEL_WORDS = old
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (r.doc_id in held) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_edge_rows(spark, edges):  # noqa: F811
    got = lm.score(edges).collect()
    assert len(got) == edges.count() and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert {(r.n_tokens, r.doc_id) for r in got} >= {(1, 1), (1, 2), (1, 3), (2, 4)}
    assert lm.score(edges.limit(0)).collect() == []
    assert all(r.n_known == 0 for r in lm.score(edges.where("crc32(string(doc_id)) % 10 = 0")).collect())


def test_training_reads_every_window_in_order():
    lex, net, rng = small()
    docs = [rng.integers(1, lex.n_model + 1, n).astype(np.int32) for n in (1, 5, 24, 25, 700, 48, 100)]
    calls, train = [], net.train

    def record(x, rate, state, sizes, least):
        before = state.copy()
        train(x, 0.0, state, sizes, least)
        calls.append((x.copy(), before, state.copy(), sizes.copy()))

    net.train, old = record, lm.TRAIN_LANES
    try:
        for lm.TRAIN_LANES in (1, 3, 50):
            calls.clear()
            assert net.read(iter(docs)) == sum(map(len, docs))
            left = [(d, np.zeros((1, 6), np.float32), False) for d in docs]
            for x, before, after, sizes in calls:
                for k, n in enumerate(sizes):
                    words = x[k, :n]
                    at = next(i for i, (d, h, _) in enumerate(left) if (len(words) == len(d) or len(words) < len(d) and len(words) % lm.STRETCH == 0) and (d[:n] == words).all() and np.allclose(h, before[k], atol=1e-5))
                    d, h, _ = left[at]
                    for w in words:
                        h, _ = net.step(h, np.array([w]))
                    assert n < x.shape[1] or np.allclose(h, after[k], atol=1e-5)
                    left[at] = (d[n:], h, True)
            assert all(len(d) == 0 for d, _, _ in left)
    finally:
        lm.TRAIN_LANES = old


def test_padding_and_carried_state_in_the_gradient():
    lex, net, rng = small()
    x = rng.integers(0, lex.n_model + 1, (3, 7))
    sizes, state = np.array([7, 2, 5]), rng.normal(0, 0.5, (3, 6))
    net.params = [p.astype(np.float64) for p in net.params]

    def loss():
        h, total = state.copy(), 0.0
        for t in range(7):
            on = t < sizes
            total -= net.log_probs(h[on], x[on, t]).sum()
            h, _ = net.step(h, x[:, t])
        return total / sizes.sum()

    got = {}
    net.update = lambda grads, used, rate: got.update(grads=grads, used=used)
    assert net.train(x, 0.1, state.copy(), sizes) == pytest.approx(loss(), rel=1e-5)
    for k, p in enumerate(net.params):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if k == 0:
                at = (int(rng.choice(got["used"])), at[1])
            want = got["grads"][k][int(np.searchsorted(got["used"], at[0])), at[1]] if k == 0 else got["grads"][k][at]
            old = p[at]
            p[at] = old + 1e-4
            up = loss()
            p[at] = old - 1e-4
            down = loss()
            p[at] = old
            assert (up - down) / 2e-4 == pytest.approx(want, rel=2e-2, abs=2e-5)


def test_all_training_words_reach_the_network(spark):
    long, short = " ".join(f"w{i % 50}" for i in range(1000)), "one two"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([long, short, None, "", long])], "doc_id long, text string")
    kept = {r.doc_id for r in docs.select("doc_id", lm.held_out()).collect() if not r.held_out}
    lex = lm.Lexicon.of([(b"w0", 5), (b"one", 1)], 10, 4)
    got = lm.model_words(docs, spark.sparkContext.broadcast(lex)).collect()
    sizes = {0: 1001, 1: 3, 2: 1, 3: 1, 4: 1001}
    assert sorted(len(r.ids) for r in got) == sorted(sizes[d] for d in kept)


def test_sums_of_runs():
    rng = np.random.default_rng(3)
    for sizes in ([1], [1, 1, 1], [2, 40, 1, 33, 32, 5, 100, 3, 17], rng.integers(1, 70, 200)):
        begins, n = np.concatenate(([0], np.cumsum(sizes)[:-1])), int(np.sum(sizes))
        x = np.concatenate([rng.normal(size=(n, 5)), np.zeros((1, 5))])
        assert np.allclose(lm.Runs(begins, n).sums(x), np.add.reduceat(x[:n], begins))


def test_few_lanes_are_scored_in_few_windows():
    _, net, rng = small()
    docs = [rng.integers(0, net.lex.n_model + 1, n).astype(np.int32) for n in (4000, 3000, 5, 1)]
    calls, log_probs = [], net.log_probs
    net.log_probs = lambda states, words: calls.append(len(words)) or log_probs(states, words)
    net.score(docs)
    assert sum(calls) == sum(map(len, docs)) and len(calls) <= 3
    assert max(calls) <= lm.LANES * lm.WINDOW


@pytest.mark.parametrize("scale", [1, 40])
def test_outputs_in_the_gradient_whatever_the_size_of_weights(scale):
    """With large weights each row takes its own maximum off its logits."""
    lex, net, rng = small()
    x = rng.integers(0, lex.n_model + 1, (40, 9))
    net.params = [p.astype(np.float64) * (scale if k in (2, 4) else 1) for k, p in enumerate(net.params)]
    assert lm.bounded(net.params[4], net.params[5], lex.first[:-1])[1].any() == lm.bounded(net.params[2].T, net.params[3], np.zeros(1, np.intp))[1].any() == (scale > 1)

    def loss():
        h, total = np.zeros((len(x), 6)), 0.0
        for t in range(x.shape[1]):
            total -= net.log_probs(h.copy(), x[:, t]).sum()
            h, _ = net.step(h, x[:, t])
        return total / x.size

    got = {}
    net.update = lambda grads, used, rate: got.update(grads=grads, used=used)
    assert net.train(x) == pytest.approx(loss(), rel=1e-6)
    for k in (1, 2, 3, 4, 5):
        p = net.params[k]
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert (up - down) / 2e-6 == pytest.approx(got["grads"][k][at], rel=1e-3, abs=1e-6)
