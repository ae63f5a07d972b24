"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

``scan`` finds the base spans and all other candidates (runs that could be keys) of each whole text, with the characters
around them. Findings label themselves: what the patterns accept is a secret, plain words and numbers mostly are not, and
neither is what begins like a pattern and is too short for it.
A convolutional network in numpy learns from a bounded sample of these labelled findings; its probabilities are calibrated on
findings held out, and the threshold is the highest that keeps the wanted recall there. The network then judges every
run that the base spans don't cover whole, words and numbers too, and those that reach the threshold are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import written

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Beginnings of both that are too short; of hexadecimal ones those that stand alone and hold a digit.
SHORT_ACCESS = re.compile(r"AKIA[A-Z0-9]{0,13}(?![A-Z0-9])")
SHORT_HEX = re.compile(r"\b(?=[a-f]*[0-9])[0-9a-f]{6,15}\b")
#: Runs that could be keys: at least 12 of these characters.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: The network's documented bound on labelled findings, and the characters that it sees at once.
TRAIN_ROWS = 3000
WINDOW, AROUND, STRIDE = 56, 12, 28
RECALL = 0.98
WIDTH, FILTERS, EMBED = 5, 24, 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of the fixed patterns, in order. Short hexadecimal and access runs never match, so the minimum
    lengths stand in the patterns; the quick tests only skip texts that can't match."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def kind_of(run: str) -> int:
    """The kind whose characters a run has: its place in KINDS."""
    return 1 if ACCESS.fullmatch(run) else 2 if HEX.fullmatch(run) else 0


def look_alikes(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What begins like a finding of the patterns and is too short to be one; ``taken`` are the base spans."""
    low = text.lower()
    short = [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) < 12] if any(h in low for h in ASSIGN_HINTS) else []
    short += [m.span() for m in SHORT_ACCESS.finditer(text)] if "AKIA" in text else []
    short += [m.span() for m in SHORT_HEX.finditer(text)]
    yield from ((a, b) for a, b in short if not any(x < b and a < y for x, y in taken))


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bool | None, int]]:
    """(start, end, label, rank): base spans are True, words and numbers False, all other key-like runs None. A run that base spans
    cover in part is a candidate as a whole, so that no rest of a key stays. Look-alikes that the patterns refuse are False too;
    their rank is -1, since they serve the training alone."""
    for a, r, b in base:
        yield a, b, True, r
    taken = sorted((a, b) for a, _, b in base)
    for a, b in look_alikes(text, taken):
        yield a, b, False, -1
    k = 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        covered, j = a, k
        while j < len(taken) and taken[j][0] <= covered < b:
            covered, j = max(covered, taken[j][1]), j + 1
        if covered >= b:
            continue
        digits = sum(map(m[0].count, "0123456789"))
        touched = k < len(taken) and taken[k][0] < b
        yield a, b, None if touched or 0 < digits < b - a else False, kind_of(m[0])


def views(text: str, start: int, end: int) -> list[str]:
    """The candidate with its surroundings, in windows that cover it whole."""
    lo, hi = max(0, start - AROUND), min(len(text), end + AROUND)
    return [text[a : a + WINDOW] for a in range(lo, max(lo + 1, hi - WINDOW + STRIDE), STRIDE)] if hi - lo > WINDOW else [text[lo:hi]]


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (array of start, rank, end) and found (array of start, end, label, rank, views), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in batch.column(2):
                t = text.as_py() or ""
                spans = base_spans(t)
                base.append([{"start": a, "rank": r, "end": b} for a, r, b in spans])
                found.append([{"start": a, "end": b, "label": y, "rank": r, "views": views(t, a, b)} for a, b, y, r in candidates(t, spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, BASE), pa.array(found, FOUND)], names=["row", "doc_id", "base", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        run, f"row long, doc_id {kind}, base array<struct<start:int,rank:int,end:int>>, found array<struct<start:int,end:int,label:boolean,rank:int,views:array<string>>>"
    )


BASE = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.bool_()), ("rank", pa.int32()), ("views", pa.list_(pa.string()))]))


def codes(texts: list[str]) -> np.ndarray:
    """Characters as numbers: printable ASCII, white space, anything else; 0 fills up."""
    out = np.zeros((len(texts), WINDOW), np.uint8)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t[:WINDOW].encode("utf-32-le"), np.uint32).astype(np.int64)
        out[i, : len(raw)] = np.where((raw > 32) & (raw < 127), raw - 32, np.where(raw <= 32, 95, 96))
    return out


@dataclass
class Network:
    """Embedding, one convolution, the maximum over places, a logistic output; ``scale`` and ``shift`` calibrate it."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (97, EMBED)), rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS))

    def forward(self, x: np.ndarray):
        e = self.embed[x]
        cols = np.concatenate([e[:, k : WINDOW - WIDTH + 1 + k] for k in range(WIDTH)], axis=2)
        act = cols @ self.kernel + self.bias
        at = act.argmax(axis=1)
        top = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0]
        return cols, at, top, np.maximum(top, 0) @ self.out + self.out_bias

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(x))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 1) -> None:
        rng, state = np.random.default_rng(seed), {}
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 64):
                b = order[i : i + 64]
                cols, at, top, logit = self.forward(x[b])
                d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[b]) / len(b)
                g_top = np.outer(d, self.out) * (top > 0)
                picked = np.take_along_axis(cols, at[:, :, None], axis=1)  # n x filters x width*embed
                g_cols = g_top[:, :, None] * self.kernel.T[None]
                g_embed = np.zeros_like(self.embed)
                places = (at[:, :, None] + np.arange(WIDTH)[None, None]).reshape(len(b), -1)
                np.add.at(g_embed, np.take_along_axis(x[b], places, axis=1).ravel(), g_cols.reshape(-1, EMBED))
                grads = {"embed": g_embed, "kernel": np.einsum("nf,nfk->kf", g_top, picked), "bias": g_top.sum(0), "out": np.maximum(top, 0).T @ d, "out_bias": d.sum()}
                for name, g in grads.items():
                    m, v, t = state.get(name, (0.0, 0.0, 0))
                    m, v, t = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, t + 1
                    state[name] = m, v, t
                    setattr(self, name, getattr(self, name) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))

    def best(self, x: np.ndarray, sizes: list[int]) -> np.ndarray:
        """The largest raw output over the views of each finding; ``sizes`` are their numbers of views, 1 at least."""
        return np.maximum.reduceat(self.raw(x), np.cumsum([0, *sizes])[:-1]) if len(sizes) else np.zeros(0)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, sizes: list[int] | None = None) -> None:
        """Platt scaling on findings held out, then the highest threshold that keeps ``recall`` of their secrets. A finding has
        one view, or as many as ``sizes`` says."""
        z, a, b = self.raw(x) if sizes is None else self.best(x, sizes), 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = a - 0.05 * ((p - y) * z).mean(), b - 0.2 * (p - y).mean()
        self.scale, self.shift = max(a, 1e-3), b
        good = np.sort(self.calibrated(z)[y > 0])
        self.threshold = float(good[int((1 - recall) * len(good))]) if len(good) else 1.0


def learn(found: DataFrame, rows: int = TRAIN_ROWS, recall: float = RECALL, seed: int = 11) -> Network | None:
    """A network from all views of at most ``rows`` secrets and as many others, picked by a hash; a third is held out for
    calibration. Without enough of both kinds there is none, and nothing is added."""
    labelled = found.where("label is not null").select("label", F.xxhash64("row", "start", F.lit(seed)).alias("h"), "views")
    counts = dict(labelled.groupBy("label").count().collect())
    sample = []
    for flag in (True, False):
        # only hashes below a level that surely leaves enough are sorted, so that tasks send few rows to the driver
        level = min(2**64 - 1, (2 * rows + 1000) * 2**64 // counts.get(flag, 1)) - 2**63
        sample += labelled.where((F.col("label") == flag) & (F.col("h") <= level)).orderBy("h", "views").limit(rows).collect()
    y, held = np.array([float(r.label) for r in sample]), np.array([r.h % 3 == 0 for r in sample], dtype=bool)
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 5:
        return None
    flat = lambda of: codes([v for r, h in zip(sample, held) if h == of for v in r.views])
    sizes = np.array([len(r.views) for r in sample])
    net = Network.fresh(seed)
    net.train(flat(False), np.repeat(y[~held], sizes[~held]))
    net.calibrate(flat(True), y[held], recall, sizes[held].tolist())
    return net


def find_secrets(docs: DataFrame, rows: int = TRAIN_ROWS, recall: float = RECALL) -> DataFrame:
    """row, doc_id, base and added, both array<struct<start, rank, end>>; an added span takes the kind whose characters it
    has. Null text counts as empty; rows that repeat have the same spans each; an empty table gives no rows."""
    scanned = written(scan(docs), "secret-scan")
    found = scanned.where("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.*")
    net = learn(found, rows, recall)
    if net is None:
        return scanned.select("row", "doc_id", "base", F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)").alias("added"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [v.as_py() for v in batch.column(4)]
            best = net.best(codes([t for v in lists for t in v]), [*map(len, lists)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(net.calibrated(best))], names=["row", "start", "end", "rank", "p"])

    judged = found.where("rank >= 0 and (label is null or not label)").select("row", "start", "end", "rank", "views").mapInArrow(judge, "row long, start int, end int, rank int, p double")
    added = judged.where(F.col("p") >= net.threshold).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("added"))
    return scanned.select("row", "doc_id", "base").join(added.hint("merge"), "row", "left").select("row", "doc_id", "base", F.coalesce("added", F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")).alias("added"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", **how) -> DataFrame:
    """The documents with every span replaced by ``mark`` and n_chars brought up to date, all other columns as they are.
    Rows are met by their doc_id and text, so repeated and missing ids do no harm."""
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_hash"), F.md5("text").alias("doc_id"), "text")
    spans = find_secrets(keyed.select("doc_id", "text"), **how).select(F.col("doc_id").alias("_key"), F.concat("base", "added").alias("_spans")).where("size(_spans) > 0").dropDuplicates(["_key"])
    joined = keyed.join(spans.hint("merge"), F.col("doc_id") == F.col("_key"), "left")
    text = F.col("text")
    # spans may overlap: merge them in order of their starts, copying what lies between
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], s["end"]).alias("at")
    )
    clean = F.aggregate(F.array_sort("_spans"), start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.col("_spans").isNull(), text).otherwise(clean)
    done = joined.select("_row", clean.alias("_clean"), F.col("_spans").isNotNull().alias("_changed"))
    new = {"text": F.col("_clean"), "n_chars": F.when(F.col("_changed"), F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("_clean")}
    return done.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
