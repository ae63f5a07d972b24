"""Licence scans and token counts."""

import random
import re

import public_tokenizers
from pyspark.sql import functions as F

from pointloom.llm import licences, queries, token_counts

from . import brute
from .test_native import SCHEMA, edges  # noqa: F401

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def greedy(word, vocab):
    """Pieces of a word by trying the longest first, or None."""
    rest, out = "▁" + word, 0
    start = True
    while rest:
        for k in range(len(rest), 0, -1):
            if rest[:k] in vocab and (start or not rest[:k].startswith("▁")):
                break
        else:
            return None
        rest, out, start = rest[k:], out + 1, False
    return out


def test_automaton_is_greedy():
    vocab = {"▁a", "▁abc", "abcd", "b", "bc", "bcx", "c", "d", "▁", "x", "▁xyz", "yz"}
    rng = random.Random(1)
    for some in (vocab, vocab - {"▁"}):
        auto = token_counts.Automaton(some)
        for _ in range(4000):
            w = "".join(rng.choice("abcdxyz") for _ in range(rng.randrange(1, 9)))
            assert auto.count(w) == (greedy(w, some) or 0), w


def test_token_counts(spark, sf, edges):  # noqa: F811
    vocab = set(token_counts.sentencepiece_pieces(PIECES))
    for docs, got in ((spark.read.parquet(f"{sf}/documents.parquet"), queries.op7_token_counts(spark, sf)), (edges.where("length(text) < 1000"), token_counts.token_counts(edges.where("length(text) < 1000"), PIECES))):
        want = []
        for r in docs.collect():
            n = [greedy(w, vocab) for w in brute.words(r.text)]
            want.append((r.doc_id, len(n), sum(x or 1 for x in n), sum(x is None for x in n)))
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(edges, PIECES).count() == edges.count() and token_counts.token_counts(edges.limit(0), PIECES).count() == 0


def test_licences_in_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    signs = {"mit": r"MIT License", "apache-2.0": r"Apache License", "gpl-3.0": r"GNU General Public", "cc-by-nc-4.0": r"CC BY-NC", "cc-by-4.0": r"CC BY 4", "cc-by-sa-4.0": r"CC BY-SA", "reserved": r"[Aa]ll rights reserved"}
    got = queries.op5_licences(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = {f for f, p in signs.items() if re.search(p, texts[r.doc_id])}
        assert set(filter(None, r.families.split(","))) == want, (texts[r.doc_id][-300:], r)


def test_licence_edges(spark, edges):  # noqa: F811
    rows = [(1, "intro\nReleased under the MIT License.\nmore", "en", "s", 1), (2, "his fishing license was renewed under the new rules", "en", "s", 1), (3, "This work is licensed under the GNU Affero General Public License, version 3. And more text follows in the same line.", "en", "s", 1), (4, "The licensed bar is released under version 3 of the general agreement", "en", "s", 1), (5, None, None, None, None)]
    got = {r.doc_id: [x.family for x in r.found] for r in licences.scan(spark.createDataFrame(rows, SCHEMA).withColumn("line", F.lit(1))).collect()}
    assert got == {1: ["mit"], 2: [], 3: ["agpl-3.0"], 4: [], 5: []}
    assert licences.scan(edges).count() == edges.count() and licences.scan(edges.limit(0)).count() == 0


def test_wrapped_licences(spark):
    mit = """Copyright (c) 2001 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The end."""
    bsd = """intro

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Some more."""
    gpl = """#!/bin/sh
#
#  This program is free software: you can redistribute it and/or modify
#  it under the terms of the GNU General Public License as published by
#  the Free Software Foundation, either version 3 of the License, or
#  (at your option) any later version.
#
#  And more."""
    plain = "You need a driver license\nto rent a car here.\n\nShe asked for permission\nto leave early, and the copyright office\nis closed."
    rows = [(i, t, "en", "s", 1) for i, t in enumerate((mit, bsd, gpl, plain, "a\n" * 20000 + "license\n" + "\n" * 20000))]
    got = {r.doc_id: [(x.line, x.family) for x in r.found] for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: [(2, "mit")], 1: [(2, "bsd")], 2: [(2, "gpl-3.0")], 3: [], 4: []}
