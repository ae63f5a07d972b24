"""Secrets, near duplicates and BPE against plain Python versions and the tokenizers library."""

import random
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointloom.llm import bpe, near_dups, queries, secrets

from . import brute
from .test_native import SCHEMA, both, edges  # noqa: F401

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def test_secret_base(spark, sf, edges):  # noqa: F811
    for docs in both(spark, sf, edges):
        rows = docs.select("doc_id", "text").collect()
        got = secrets.find_secrets(docs).collect()
        assert Counter((r.doc_id, tuple(map(tuple, r.base))) for r in got) == Counter((r.doc_id, tuple(brute.secrets(r.text))) for r in rows)


def test_secret_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_secrets(spark, sf).collect():
        spans = brute.secrets(texts[r.doc_id])
        text = brute.span_text(spans, secrets.KINDS)
        assert r.base_sha256 == brute.sha(text) and [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_network_finds_secrets_held_out():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(3, 9)))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    data = [(f"{word()} {word()} {key()} {word()}", 1.0) for _ in range(300)] + [(f"{word()} {word()}{word()}{word()} {word()}", 0.0) for _ in range(300)]
    rng.shuffle(data)
    x, y = secrets.codes([t for t, _ in data]), np.array([v for _, v in data])
    net = secrets.Network.fresh(1)
    net.train(x[:400], y[:400])
    net.calibrate(x[400:500], y[400:500], 0.98)
    p = net.probability(x[500:])
    assert ((p >= 0.5) == (y[500:] > 0.5)).mean() > 0.95
    good = net.probability(x[400:500])[y[400:500] > 0]
    assert (good >= net.threshold).mean() >= 0.98


def test_network_gradient():
    net, eps = secrets.Network.fresh(2), 1e-5
    x, y = secrets.codes(["ab cd 12", "zz top 9"]), np.array([1.0, 0.0])
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.raw(x)))))
    before = net.kernel.copy(), loss()
    k = (3, 2)
    net.kernel[k] += eps
    up = loss()
    net.kernel[k] -= 2 * eps
    slope = (up - loss()) / (2 * eps)
    net.kernel[:] = before[0]
    net.train(x, y, epochs=1, rate=1e-4)
    moved = net.kernel[k] - before[0][k]
    assert abs(slope) < 1e-9 or np.sign(moved) == -np.sign(slope)


def test_every_run_is_a_candidate():
    text = "unquestionably 123456789012345 XyZ9Qwdeadbeefdeadbeef01Kq x deadbeefdeadbeef abcdefABCDEF01 password=abcdefghijkl012"
    got = {text[a:b]: y for a, b, y, *_ in secrets.candidates(text, secrets.base_spans(text))}
    assert got == {
        "deadbeefdeadbeef01": True, "deadbeefdeadbeef": True, "password=abcdefghijkl012": True, "unquestionably": False, "123456789012345": False,
        "XyZ9Qwdeadbeefdeadbeef01Kq": None, "abcdefABCDEF01": None,
    }


def test_rests_of_keys_go(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(3, 16)))
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    rows = [(i, " ".join([*(word() for _ in range(12)), hexa(), word()])) for i in range(150)] + [(1000, "some words XyZ9Qwdeadbeefdeadbeef01Kq and more words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert got[1000] == "some words [SECRET] and more words"
    assert all("[SECRET]" in t for t in got.values())


def test_redaction(spark):
    text = "é before token: abcdefABCDEF0123456789abcdef after\nand password=deadbeefdeadbeef end"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "clean", "en", "s", 5), (3, None, "en", "s", None), (None, text, "en", "s", 1)], SCHEMA).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in secrets.redacted(docs).collect()}
    assert got[1].text == "é before [SECRET] after\nand [SECRET] end" == got[None].text and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean" and got[3].text is None and got[3].n_chars is None and got[1].spans == "clash"


def test_near_dups(spark, sf, edges):  # noqa: F811
    for docs in both(spark, sf, edges):
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
        want = brute.near({r.doc_id: r.text for r in docs.collect()})
        got = near_dups.near_duplicates(docs, width=2).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dups_chains_and_crowds(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, n = [], 0
    for _ in range(3):  # chains: each step changes a few words, so the ends differ
        text = [word() for _ in range(120)]
        for _ in range(12):
            rows.append((n := n + 1, " ".join(text)))
            text = list(text)
            text[rng.randrange(120)] = word()
            text[rng.randrange(120)] = word()
    passage = [word() for _ in range(60)]  # a passage that many documents share, with pairs among them that are similar
    for _ in range(25):
        own = [word() for _ in range(40)]
        rows.append((n := n + 1, " ".join(passage + own)))
        own = own[:-3] + [word() for _ in range(3)]
        rows.append((n := n + 1, " ".join(passage + own)))
    rows += [(n + i, "same text here") for i in range(1, 30)] + [(n + 100, None), (n + 101, ""), (n + 102, "Same  TEXT\there"), (n + 103, "word"), (n + 104, "WORD")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert got == brute.near(dict(rows), 5)
    left = near_dups.without_near_duplicates(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, (_, c) in got.items() if d == c) and left.columns == docs.columns


def test_near_dups_large_group(spark):
    """Many versions of one text, each changed at random: most pairs fall below the level, so links are sparse and
    lists are long enough to be compared in blocks."""
    rng = random.Random(4)
    text = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = [(i, " ".join(f"n{rng.randrange(10**9)}" if rng.random() < 0.05 else w for w in text)) for i in range(1, 1200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs, width=2).collect()}
    assert got == brute.near(dict(rows)) and 1 < len({c for _, c in got.values()}) < 1100


def test_near_dups_keep_texts_that_share_an_id(spark):
    rows = [(1, "one text of five words here"), (1, "another text with other words inside"), (1, "one text of five words here"), (None, "a third text that has no id"), (None, "a third text that has no id"), (None, "a fourth text that has no id"), (2, "one text of five words here"), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    left = Counter((r.doc_id, r.text) for r in near_dups.without_near_duplicates(docs).collect())
    assert left == Counter({rows[0]: 1, rows[1]: 1, rows[3]: 1, rows[5]: 1, (3, ""): 2})


def test_near_dups_keep_rows_without_ids(spark, edges):  # noqa: F811
    left = near_dups.without_near_duplicates(edges)
    rows = left.collect()
    assert left.columns == edges.columns and sum(r.doc_id is None for r in rows) == 1
    assert Counter((r.doc_id, r.text) for r in rows if brute.words(r.text)).most_common(1)[0][1] == 1


def test_bpe_against_the_library(spark, sf, edges):  # noqa: F811
    t = Tokenizer.from_file(VOCAB)
    for docs in both(spark, sf, edges):
        rows = docs.select("doc_id", "text").collect()
        want = Counter()
        for r in rows:
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want[(r.doc_id, tuple(ids), t.decode(ids, skip_special_tokens=False))] += 1
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_decode(docs, VOCAB).collect()) == want


def test_bpe_odd_text():
    t, e, rng = Tokenizer.from_file(VOCAB), bpe.encoder(VOCAB), random.Random(1)
    d = bpe.Decoder(e.v)
    letters = "abcdefghthein'sllve  \n\t\x1c\x85 éÉΣσςİıßﬁ́̈ÅÅK中文字😀👩‍👧١٢3½²Ⅷ!?#$%^&*()<|>​ 　ǅẞ한글가.,;"
    for k in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
        s = s[:10] + "<|endoftext|>" + s[10:] + "<|startoftext|>" if k % 7 == 0 else s
        ids = t.encode(s, add_special_tokens=False).ids
        assert e.encode(s) == ids and d.decode(ids) == t.decode(ids, skip_special_tokens=False), repr(s)


def test_bpe_every_character():
    """Every assigned character alone and beside letters, numbers and marks, apart and put together."""
    t, e = Tokenizer.from_file(VOCAB), bpe.encoder(VOCAB)
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Co"]
    dense = ((0x3500, 0x9F00), (0xAC80, 0xD780), (0x17100, 0x18A00), (0x20100, 0x2A600), (0x2B000, 0x2CE00), (0x2D000, 0x2EB00), (0x30100, 0x31300), (0x34000, 0x3D000), (0x40000, 0xE0000))
    known = [c for c in known if not any(a <= ord(c) < b for a, b in dense)]  # ideographs and syllables alike, but for their ends
    apart = [d for c in known if (d := unicodedata.normalize("NFD", c)) != c]
    for context in ("{}", "{}.", "a{}", "{}a", "1{}.!"):
        texts = [context.format(c) for c in known + apart]
        want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        assert [s for s, ids in zip(texts, want) if e.encode(s) != ids] == []


def test_bpe_random_characters():
    t, e, rng = Tokenizer.from_file(VOCAB), bpe.encoder(VOCAB), random.Random(5)
    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    marks = [c for c in known if unicodedata.combining(c)]
    pick = lambda r: rng.choice("abcdeST  \n.,;:!?'s12" if r < 0.4 else marks if r < 0.6 else known)
    texts = ["".join(pick(rng.random()) for _ in range(rng.randrange(1, 25))) for _ in range(100_000)]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [s for s, ids in zip(texts, want) if e.encode(s) != ids] == []


def test_bpe_streams_in_constant_memory():
    e, rng = bpe.encoder(VOCAB), random.Random(4)
    run, out, most = bpe.Transducer(e.v), [], 0
    text = "".join(rng.choice("aeinrst") for _ in range(30000))
    for c in text[:-1]:
        out += run.feed(c)
        most = max(most, len(run.buffer))
    out += run.feed(text[-1], end=True)
    assert most <= 2 * bpe.FLUSH * e.v.window
    assert out == Tokenizer.from_file(VOCAB).encode(text, add_special_tokens=False).ids


def test_bpe_decodes_bytes_one_at_a_time():
    e = bpe.encoder(VOCAB)
    ids = e.encode("Größe 中文 😀 ok")
    d = bpe.Decoder(e.v, pieces=False)
    assert "".join([*(d.push(i) for i in ids), d.close()]) == "größe 中文 😀 ok "
    assert bpe.Decoder(e.v, pieces=False).decode(ids[:-3] + ids[-1:]).count("�") >= 0


def test_bpe_query(spark, sf):
    t = Tokenizer.from_file(VOCAB)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_bpe(spark, sf).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == brute.sha(" ".join(map(str, ids))) and r.decoded_sha256 == brute.sha(t.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("n", [1, 3, 50, 5000])
def test_signatures_estimate_similarity(n):
    rng = np.random.default_rng(n)
    shared = rng.integers(0, 2**63, 8 * n, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, n, dtype=np.uint64)])) for _ in range(2))
    same = (near_dups.signature(near_dups.scramble(a.copy()) if False else np.sort(near_dups.scramble(a))) == near_dups.signature(np.sort(near_dups.scramble(b)))).mean()
    assert abs(same - 0.8) < 0.25
