"""Prefix trie, ranked search and byte-level BPE against plain Python versions and the tiktoken library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pointloom.llm import byte_bpe, fp_search, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, id string, head string, up string"


def brute_trie(rows, family):
    """Every prefix of every conversation in a dictionary."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in by.items()}
    if family:
        cut = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % family, [])[: cut[c]] + turns[cut[c] :] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out, kids, leaves, saved = set(), Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    for k, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(own[c]) == len(k))
        out.add((min(convs), len(k), min(members[k[:-1]]) if k else None, len(convs), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(300):
        if c % 7 == 0:  # copies
            turns = [("user", "hello there"), ("assistant", "yes")]
        elif c % 7 == 1:  # a shared chain that ends at every depth
            turns = [("user", f"step {i}") for i in range(c % 9)]
        else:
            turns = [(rng.choice(["user", None]), rng.choice(["a", "b c", None, "é x", ""])) for _ in range(rng.randint(1, 6))]
        rows += [(c, t if t != 1 or c % 11 else None, role, text) for t, (role, text) in enumerate(turns)]
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again"), (None, 0, "user", "lost"), (-7, 2, "user", "minus"), (3001, 0, "user", "step 0"), (3001, 1, "user", " ".join(["long"] * 50000))]
    return rows


@pytest.mark.parametrize("limit,rounds", [(10**9, 64), (1, 64), (5, 64), (2, 2)])
@pytest.mark.parametrize("family", [0, 20])
def test_trie(spark, limit, rounds, family, monkeypatch):
    if limit == 5:
        monkeypatch.setattr(prefix_trie, "HEADS", 0)
    rows = [r for r in conversations() if r[0] is None or r[0] >= 0 or not family]  # the remainder of negative numbers differs between languages
    turns = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)
    got = prefix_trie.trie(prefix_trie.sequences(turns, family), limit, rounds).drop("turn_id").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_trie(rows, family)


def test_trie_pieces(spark, monkeypatch):
    """Copies whose ids go over several tasks and pieces."""
    ids = spark.range(5000).select(F.col("id").alias("conv_id"), F.unhex(F.md5(F.lit("x"))).alias("digest")).repartition(4)
    found = spark.createDataFrame(ids.select("digest", "conv_id").repartitionByRange(7, "digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(prefix_trie.runs, prefix_trie.RUN_TYPE).collect(), prefix_trie.RUN_TYPE)
    assert found.count() > 3 and prefix_trie.classes(ids).collect() == [(0, 5000, hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest())]
    assert prefix_trie.classes(ids.limit(0)).collect() == []


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame([], TURNS), 20)).collect() == []


def brute_search(docs, items):
    find = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    counts = [(d, Counter(find(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in Counter(find(text)).items() if c[t])
            scores += [(-score, d is None, d or 0)] if score > 0 else []
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:10], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,leaf,lot", [(8192, 64, 500), (50, 2, 3)])
def test_search(spark, block, leaf, lot, monkeypatch):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("ITEMS", lot)):
        monkeypatch.setattr(fp_search, name, value)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "x1y", "中文"]
    some = lambda n: rng.choice([" ", "-", "\x00", "_"]).join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n)).replace("w1", "W1")
    docs = [(i, some(rng.randint(0, 30))) for i in range(300)] + [(1000 + i, "w1 w2 w3 w30") for i in range(120)] + [(2000, None), (2001, ""), (2002, " ".join(["w5"] * 50000)), (7, "w1 w2 w3 w30"), (None, "w1 w2 w3 w30")]
    items = [(i, some(rng.randint(1, 12))) for i in range(7)] + [(20, None), (21, "absent"), (22, "w1 w2 w3 w30 w30"), (23, "W5"), (0, "w7")]
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, item string, n long, score long")
    q = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, rank long")
    got = sorted(map(tuple, fp_search.search(d, q).collect()), key=str)
    assert got == brute_search(docs, items)
    assert fp_search.search(d.limit(0), q).collect() == [] and fp_search.search(d, q.limit(0)).collect() == []


def test_tree_prunes_and_finds_the_same():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [np.unique(np.minimum(rng.geometric(0.1, rng.integers(1, 20)) - 1, 59)) for _ in range(3000)]
    tfs, m = [rng.integers(1, 9, len(r)) for r in rows], rng.integers(25, 200, 3000)
    tree = fp_search.Tree(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), np.concatenate(tfs), m, list(range(3000)), 60)
    for _ in range(20):
        query, weights, best = np.sort(rng.choice(60, 5, False)), rng.integers(1, 5000, 5), []
        tree.search(query, weights, best)
        scores = [(int(sum(w * (10**9 * int(t[r == q][0]) // (1000 * int(t[r == q][0]) + 8 * int(k))) for q, w in zip(query, weights) if q in r)), True, -i) for i, (r, t, k) in enumerate(zip(rows, tfs, m))]
        assert sorted(best, reverse=True) == sorted((s for s in scores if s[0] > 0), reverse=True)[:10]


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_byte_bpe(spark, vocabulary, sf):
    path, own = vocabulary
    rng = random.Random(9)
    letters = " \n\t\r'\"abcdefghijklmnopqrstuvwxyzABCQ0129.,;!?éèß中文क़ \xa0\U0001f600́"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(3000)]
    texts += [None, "", "<|endoftext|>", "it's 'S it'll", " " * 3000 + "x", "a" * 5000, "the" * 3000, "=" * 4000, "".join(rng.choices("0123456789", k=3000)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9000)), "plain words here " * 4000]
    docs = spark.createDataFrame([(i, t, 0, "y") for i, t in enumerate(texts)] + [(None, "once more", 0, "y")] * 2, "doc_id long, text string, ids long, bytes string")
    rows = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts) + 2 and sorted(byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect(), key=str) == sorted(rows, key=str)
    for r in rows:
        text = (texts[r["doc_id"]] or "") if r["doc_id"] is not None else "once more"
        assert r["ids"] == own.encode_ordinary(text) and bytes(r["bytes"]) == text.encode()
    odd = spark.createDataFrame([(1, [60000, 0, 255]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["bytes"] for r in byte_bpe.decode(odd, path, public_tokenizers.PATTERN).orderBy("doc_id").collect()] == [own.decode_bytes([0, 255]), None, b""]
    assert byte_bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_classes(vocabulary):
    """Some 84,000 code points, each in four contexts, are cut as the library cuts them."""
    path, own = vocabulary
    codec = byte_bpe.codec(path, public_tokenizers.PATTERN)
    texts = ["".join(f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}! {chr(c)}{chr(c)}" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in [*range(0, 0x3400, 64), *range(0xA000, 0xAC00, 64), *range(0xF900, 0x20000, 64), *range(0xE0000, 0xE0200, 64)]]
    import numpy as np

    assert [np.frombuffer(x, "<i4").tolist() for x in codec.encode(texts)] == own.encode_ordinary_batch(texts, num_threads=1)


def test_small_memory(vocabulary, monkeypatch):
    """Words that had to be forgotten, texts longer than a stretch, and lots of a few bytes."""
    import numpy as np

    path, own = vocabulary
    for name, value in (("MEMORY", 5), ("LOT", 20), ("TEXT", 50), ("MATCHES", 3), ("LONG", 4)):
        monkeypatch.setattr(byte_bpe, name, value)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(path), public_tokenizers.PATTERN)
    for text in ["several words of differing length, once", "several words again and a great deal more than fifty characters of them " * 2, "", "thethethe banana bananas"]:
        assert np.frombuffer(codec.encode([text])[0], "<i4").tolist() == own.encode_ordinary(text)
