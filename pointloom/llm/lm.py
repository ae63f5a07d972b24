"""Language-model scoring: a smoothed unigram base and a gated recurrent model of whole documents.

Words of all training documents are counted in Spark. The ``MODEL_WORDS`` most frequent are the model's vocabulary; they are
dealt into classes of equal count mass, and every other word is one unknown word, whose own probability follows from its
count. So the model is a distribution over all texts. The recurrent network is gated (update and reset gate), its softmax is
factored into class and word in class, and its output biases start from the corpus counts.

Training: every round reads all words of all training documents. Documents are dealt at random over tasks; a task reads many
side by side, each in windows of ``STRETCH`` words from its start to its end, the state carried from window to window. Every
window is one truncated back-propagation step in numpy from common weights, and the weighted mean of all tasks' weights starts
the next round. Scoring: documents of an Arrow batch are packed into lanes that advance together; windows follow each
other with the state carried over, and a document starts from the empty state wherever it stands in its lane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import scratch, written

#: The end of a text as a word: no word is empty, so it can't clash.
END = b""
#: Words that every task holds with their counts (the bound on what is broadcast), and those the network knows.
TOP_WORDS = 120_000
MODEL_WORDS = 4096
CLASSES = 64
HIDDEN = 24
STRETCH = 24
ROUNDS = 2
LANES = 384
WINDOW = 32
#: Words whose class softmax is laid out at once.
SLICE = 2048
#: More rows of one word are added up as a product.
LONG_RUN = 32
#: Documents that a task trains on side by side, whatever the size of the table.
TRAIN_LANES = 192
#: Documents of as many words begin first in their task.
LONG = 2000
#: Training words that one task takes, about; tasks grow with the corpus.
TASK_WORDS = 2_000_000


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z made small, of all texts one after the other, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(split).cast(pa.binary())
    real = pc.greater(pc.binary_length(words), 0)  # space at either end of a text, or no text at all, leaves an empty word
    owner = np.repeat(np.arange(len(sizes)), sizes)[real.to_numpy(zero_copy_only=False)]
    return words.filter(real), np.bincount(owner, minlength=len(sizes))


def placed(words: pa.Array, sizes: np.ndarray, known: pa.Array, end: int) -> np.ndarray:
    """Place of each word in ``known``, -1 for others, and after each text's words ``end``."""
    ids = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
    return np.insert(ids, np.cumsum(sizes), end)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all training documents. Tasks count each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column(1)))
            counts = pc.value_counts(words_of(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["word", "n"])
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([batch.num_rows], pa.int64())], names=["word", "n"])

    return docs.select("text", held_out()).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def held_out():
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out")


@dataclass
class Lexicon:
    """What every task knows: the top words with their counts, the totals, and the classes of the model's words."""

    ids: dict[bytes, int]  # top word -> place by count
    log_base: np.ndarray  # log10 of the base probability of each top word
    log_rest: np.ndarray  # log10 of a top word's probability among the words that the model doesn't know; 0 for those it knows
    n_model: int  # model words; their ids are 0 .. n_model - 1, the unknown word is n_model
    first: np.ndarray  # first id of each class, and the end
    cls: np.ndarray  # class of each id
    share: np.ndarray  # corpus probability of each id, the unknown word included
    denominator: float
    rest_mass: float

    def model_end(self) -> int:
        """The end word as the model knows it."""
        return min(self.ids.get(END, self.n_model), self.n_model)

    @classmethod
    def of(cls, top: list[tuple[bytes, int]], total: int, distinct: int) -> Lexicon:
        counts = np.array([n for _, n in top], dtype=np.float64)
        n_model = min(MODEL_WORDS - 1, len(top))
        known = counts[:n_model]
        rest = total - known.sum()
        mass = np.append(known, rest) + 0.5
        # ids in order of count, dealt by equal sums of roots of mass: this makes a word's two softmaxes shortest on average;
        # the unknown word is a class of its own
        roots = np.cumsum(np.sqrt(mass[:n_model]))
        edges = np.searchsorted(roots / max(roots[-1:], default=1.0), np.arange(1, CLASSES) / CLASSES)
        limit = np.concatenate(([0], np.maximum.accumulate(edges + 1), [n_model, n_model + 1]))
        first = np.unique(np.minimum(limit, n_model + 1))
        wide: list[int] = []
        for a, b in zip(first, first[1:]):  # none larger than needed for a short softmax
            wide += range(a, b, max(1, math.ceil((b - a) / max(1, math.ceil((b - a) / 160)))))
        first = np.array([*wide, n_model + 1])
        denominator = total + 0.1 * (distinct + 1)
        rest_mass = rest + 0.1 * (distinct - n_model + 1)
        log_rest = np.log10((counts + 0.1) / rest_mass)
        log_rest[:n_model] = 0
        return cls({w: i for i, (w, _) in enumerate(top)}, np.log10((counts + 0.1) / denominator), log_rest, n_model, first, np.searchsorted(first, np.arange(n_model + 1), side="right") - 1, mass / mass.sum(), denominator, rest_mass)


def ascending(words: np.ndarray, most: int) -> np.ndarray:
    """The order of words up to ``most``, equal ones as they stand; short integers are sorted by their digits."""
    return np.argsort(words.astype(np.uint16 if most < 1 << 16 else np.int32), kind="stable")


class Runs:
    """Sums over runs of rows, each from one of ``begins`` to the next, of ``n`` rows. Runs of about one length are laid side by side,
    with empty rows as padding, and added up at once; long runs are products with ones."""

    def __init__(self, begins: np.ndarray, n: int):
        self.begins, self.sizes, self.side = begins, np.diff(begins, append=n), []
        most, left = 1, np.arange(len(begins))
        while most <= LONG_RUN:
            short = self.sizes[left] <= most
            k, left = left[short], left[~short]
            if len(k):
                add = np.arange(most)[:, None]
                self.side.append((k, np.where(add < self.sizes[k], begins[k] + add, n)))
            most *= 2
        self.long = left.tolist()

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sums of ``x``, which has a last row of zeros beside its own."""
        out, one = np.empty((len(self.begins), x.shape[1]), x.dtype), np.ones((1, self.sizes.max()), x.dtype)
        for k, rows in self.side:
            out[k] = x.take(rows, axis=0).sum(axis=0)
        for k in self.long:
            at, size = self.begins[k], self.sizes[k]
            np.matmul(one[:, :size], x[at : at + size], out=out[k : k + 1])
        return out


def with_ones(states: np.ndarray) -> np.ndarray:
    """States with a last column of ones, which meets the biases."""
    return np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1)


def bounded(weights: np.ndarray, bias: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of softmaxes over the rows from each of ``first`` to the next: the weights with the biases as last column, less a shift that
    keeps the exponentials of logits finite, and which softmaxes need each row's own maximum taken off beside. States lie within -1
    and 1, so weights bound the logits: if the bounds of a softmax are close, all rows take the same shift."""
    reach = np.abs(weights) @ np.ones(weights.shape[1], weights.dtype)
    top, low = np.maximum.reduceat(bias + reach, first), np.maximum.reduceat(bias - reach, first)
    shift = np.repeat(top, np.diff(np.append(first, len(bias))))
    return np.concatenate([weights, (bias - shift)[:, None]], axis=1), top - low >= 60


class Recurrent:
    """The network. ``params`` is a list of float32 arrays: input table (word x 3H, the projected embeddings), recurrent
    weights (H x 3H), class weights and biases, word weights and biases."""

    def __init__(self, lex: Lexicon, hidden: int = HIDDEN, seed: int = 7):
        rng, n, c = np.random.default_rng(seed), lex.n_model + 1, len(lex.first) - 1
        self.lex, self.h = lex, hidden
        class_share = np.add.reduceat(lex.share, lex.first[:-1])
        self.params = [p.astype(np.float32) for p in (
            rng.normal(0, 0.1, (n, 3 * hidden)), rng.normal(0, 0.5 / hidden**0.5, (hidden, 3 * hidden)),
            rng.normal(0, 0.05, (hidden, c)), np.log(class_share), rng.normal(0, 0.05, (n, hidden)), np.log(lex.share / class_share[lex.cls]),
        )]

    def gates(self) -> np.ndarray:
        """Recurrent weights gate by gate (3 x H x H)."""
        return np.ascontiguousarray(self.params[1].reshape(self.h, 3, self.h).transpose(1, 0, 2))

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What ids (steps x lanes) bring to each gate (steps x 3 x lanes x H)."""
        return self.params[0].reshape(-1, self.h).take(3 * x.astype(np.intp)[:, None] + np.arange(3)[:, None], axis=0)

    @staticmethod
    def advance(h: np.ndarray, a: np.ndarray, rec: np.ndarray, u: np.ndarray, out: np.ndarray) -> None:
        """One step for all lanes from ``h`` to ``out``. The ``inputs`` turn into the two gates and the new part of the state; ``u``
        takes what the old state brings to each gate. A gate that is shut for good overflows to infinity and is then 0."""
        np.matmul(h, rec, out=u)
        zr, new = a[:2], a[2]
        zr += u[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[1], u[2], out=out)
        new += out
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= zr[0]
        out += new

    def step(self, h: np.ndarray, x: np.ndarray):
        """One step for all lanes: the new state, and the gates with the new part of it."""
        a, out = self.inputs(x[None])[0], np.empty((len(x), self.h), self.params[1].dtype)
        with np.errstate(over="ignore"):
            self.advance(h.astype(out.dtype), a, self.gates(), np.empty_like(a), out)
        return out, a

    def inner(self, states: np.ndarray, words: np.ndarray, weights: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, list[tuple], float]:
        """Logits of ascending words in their classes, all in one array, so that one call works out all exponentials; for each class
        the rows, the ids and its part of the array; and the sum of the rows' maxima that were taken off."""
        runs = self.runs(words)
        flat, parts, at = np.empty(sum((hi - lo) * (b - a) for _, lo, hi, a, b in runs), states.dtype), [], 0
        taken = 0.0
        for k, lo, hi, a, b in runs:
            p = flat[at : at + (hi - lo) * (b - a)].reshape(hi - lo, b - a)
            np.matmul(states[lo:hi], weights[a:b].T, out=p)
            if far[k]:
                most = p.max(axis=1, keepdims=True)
                taken += float(most.sum(dtype=np.float64))
                p -= most
            parts.append((lo, hi, a, b, p))
            at += p.size
        return flat, parts, taken

    def log_probs(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log probability of each word after its state: class, then word in class, class by class."""
        lex, (_, _, wc, bc, ww, bw) = self.lex, self.params
        order = ascending(words, lex.n_model)
        states, words = with_ones(states[order]), words[order]
        wide, wide_far = bounded(wc.T, bc, np.zeros(1, np.intp))
        narrow, far = bounded(ww, bw, lex.first[:-1])
        cls, sums, logp = lex.cls[words], np.empty(len(words), wc.dtype), np.empty(len(words), wc.dtype)
        one, wide = np.ones(len(bc), wc.dtype), np.ascontiguousarray(wide.T)
        for at in range(0, len(words), SLICE):
            part = slice(at, at + SLICE)
            logits = states[part] @ wide
            if wide_far[0]:
                logits -= logits.max(axis=1, keepdims=True)
            logp[part] = logits[np.arange(len(logits)), cls[part]]
            np.exp(logits, out=logits)
            np.matmul(logits, one, out=sums[part])
        flat, parts, _ = self.inner(states, words, narrow, far)
        for lo, hi, a, b, p in parts:
            logp[lo:hi] += p[np.arange(hi - lo), words[lo:hi] - a]
        np.exp(flat, out=flat)
        inside = np.ones(len(words), wc.dtype)
        one = np.ones(int(np.diff(lex.first).max()), wc.dtype)
        for lo, hi, a, b, p in parts:
            np.matmul(p, one[: b - a], out=inside[lo:hi])
        logp -= np.log(sums) + np.log(inside)
        out = np.empty(len(words), wc.dtype)
        out[order] = logp
        return out

    def runs(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Of ascending words, each class with more than one word: its number, where it begins and ends; its first id and the next
        one's."""
        first = self.lex.first
        ends = np.searchsorted(words, first)
        k = np.flatnonzero((np.diff(ends) > 0) & (np.diff(first) > 1))
        return list(zip(k.tolist(), ends[k].tolist(), ends[k + 1].tolist(), first[k].tolist(), first[k + 1].tolist()))

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document (ids that end with the end word). Lanes are filled evenly, longest
        documents first; each lane reads its documents one after the other."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        lanes = min(LANES, max(1, len(docs)))
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        lane_of, fill = [[] for _ in range(lanes)], np.zeros(lanes, np.int64)
        for d in order:
            k = int(fill.argmin())
            lane_of[k].append(d)
            fill[k] += sizes[d]
        alive = np.argsort(-fill, kind="stable")  # long lanes first, so that finished ones fall off the end
        fill, lane_of = fill[alive], [lane_of[k] for k in alive]
        # one run of words a lane; only the windows of all lanes are ever laid side by side
        run = [np.concatenate([docs[d] for d in mine]) for mine in lane_of]
        owners = [np.repeat(np.array(mine, np.int32), sizes[mine]) for mine in lane_of]
        h, gates, start = np.zeros((lanes, self.h), np.float32), self.gates(), 0
        while start < fill[0]:
            live = int(np.searchsorted(-fill, -start, side="left"))
            # as many words at once when few lanes are left; a document's own words and states are the same in any window
            wide = min(WINDOW * LANES // live, int(fill[0]) - start) if live < LANES else min(WINDOW, int(fill[0]) - start)
            words, owner, before = np.zeros((wide, live), np.int32), np.full((wide, live), -1, np.int32), np.full(live, -1, np.int32)
            for k in range(live):
                n = min(wide, len(run[k]) - start)
                words[:n, k], owner[:n, k] = run[k][start : start + n], owners[k][start : start + n]
                before[k] = owners[k][start - 1] if start else -1
            fresh = owner != np.concatenate((before[None], owner[:-1]))
            h = h[:live]
            states, u = np.empty((wide + 1, live, self.h), np.float32), np.empty((3, live, self.h), np.float32)
            states[0] = h
            a, some = self.inputs(words), fresh.any(axis=1).tolist()
            with np.errstate(over="ignore"):
                for t in range(wide):
                    if some[t]:
                        states[t, fresh[t]] = 0
                    self.advance(states[t], a[t], gates, u, states[t + 1])
            h = states[wide]
            own = owner.ravel()
            real = own >= 0
            logp = self.log_probs(states[:wide].reshape(-1, self.h)[real], words.ravel()[real])
            out += np.bincount(own[real], weights=logp, minlength=len(docs))
            start += wide
        return out

    def read(self, docs: Iterator[np.ndarray], rate: float = 0.1) -> int:
        """One training pass over whole documents (ids that end with the end word). Each takes a lane from its first window to
        its last, with the state carried over; the lane then goes to the next document. Returns the number of words read."""
        docs, lanes, h, seen = iter(docs), [], np.zeros((0, self.h), np.float32), 0
        while True:
            going = [k for k, (ids, at) in enumerate(lanes) if at < len(ids)]
            fresh = list(islice(docs, TRAIN_LANES - len(going)))
            lanes = [lanes[k] for k in going] + [[ids, 0] for ids in fresh]
            if not lanes:
                return seen
            h = np.concatenate([h[going], np.zeros((len(fresh), self.h), np.float32)])
            sizes = np.array([min(STRETCH, len(ids) - at) for ids, at in lanes])
            x = np.zeros((len(lanes), sizes.max()), np.int32)
            for k, lane in enumerate(lanes):
                x[k, : sizes[k]] = lane[0][lane[1] : lane[1] + STRETCH]
                lane[1] += STRETCH
            self.train(x, rate, h, sizes, TRAIN_LANES * STRETCH)
            seen += int(sizes.sum())

    def train(self, x: np.ndarray, rate: float = 0.1, state: np.ndarray | None = None, sizes: np.ndarray | None = None, least: int = 1) -> float:
        """One truncated back-propagation step over windows (B x T ids); adaptive rates. Returns the mean log loss.

        ``state`` (B x H; empty at first if not given) is overwritten by the state after the window. Of each row the first
        ``sizes`` ids count, the rest is padding. Gradients are means over the words, over ``least`` words if there are fewer.
        """
        lex, n = self.lex, self.h
        _, rec, wc, bc, ww, bw = self.params
        kind, (size, steps) = rec.dtype, x.shape
        states = np.empty((steps + 1, size, n), kind)
        states[0] = 0 if state is None else state
        a, u, gates = self.inputs(x.T), np.empty((steps, 3, size, n), kind), self.gates()
        with np.errstate(over="ignore"):
            for t in range(steps):
                self.advance(states[t], a[t], gates, u[t], states[t + 1])
        if state is not None:
            state[:] = states[steps]
        y = x.T.ravel()
        place = np.arange(len(y)) if sizes is None else np.flatnonzero((np.arange(steps)[:, None] < sizes).ravel())
        place = place[ascending(y[place], lex.n_model)]  # by word, so by class too
        states[steps] = 0  # for sums: places past the last one are empty rows
        s, y = with_ones(states.reshape(-1, n).take(np.append(place, steps * size), axis=0)), y[place]
        s[-1] = 0
        scale = kind.type(1 / max(len(y), least))
        begins = np.flatnonzero(np.diff(y, prepend=-1))
        used = y[begins]
        runs = Runs(begins, len(y))
        ds, grads, loss = self.softmaxes(s[:-1], y, used, runs, runs.sums(s), scale)
        spread = np.zeros((steps * size, n), kind)
        spread[place] = ds
        ds = spread.reshape(steps, size, n)
        # through the steps backwards; the parts of the gradient: new part as inputs have it, the two gates, new part as the old state has it
        d = np.empty((4, steps, size, n), kind)
        back = np.ascontiguousarray(rec.reshape(n, 3, n).transpose(1, 2, 0))
        dh, before, m = np.zeros((size, n), kind), np.empty((size, n), kind), np.empty((3, size, n), kind)
        for t in range(steps - 1, -1, -1):
            z, r, new = a[t]
            dnew, dz, dr, du = d[:, t]
            np.multiply(dh, z, out=before)  # what goes straight to the state before
            dh -= before
            np.subtract(states[t], new, out=dz)
            dz *= dh
            dz *= z
            np.multiply(new, new, out=dnew)
            dnew *= dh
            np.subtract(dh, dnew, out=dnew)
            np.multiply(dnew, r, out=du)
            np.subtract(dnew, du, out=dr)
            dr *= u[t, 2]
            dr *= r
            np.matmul(d[1:, t], back, out=m)
            before += m[0]
            before += m[1]
            before += m[2]
            before += ds[t]
            dh, before = before, dh
        ordered = np.zeros((len(place) + 1, 4 * n), kind)
        d.reshape(-1, n).take(place[:, None] + np.arange(4) * (steps * size), axis=0, out=ordered[:-1].reshape(-1, 4, n), mode="clip")
        grads[1] = s[:, :n].T @ ordered[:, n:]
        grads[0] = np.roll(runs.sums(ordered)[:, : 3 * n], -n, axis=1)
        self.update(grads, used, rate)
        return loss / len(y)

    def softmaxes(self, s: np.ndarray, y: np.ndarray, used: np.ndarray, runs: Runs, mine: np.ndarray, scale: np.floating) -> tuple[np.ndarray, list, float]:
        """Of the loss times ``scale`` over ascending words ``y`` after states ``with_ones``: the gradient of the states, those of the
        output parameters at their places, and the loss itself. ``used``: the distinct words, with their ``runs`` of rows and the sums of their states.

        Gradients are those of the sums, worked out from all outcomes, less those of the words' own outcomes, which are sums over the
        rows of a word."""
        lex, n, (_, _, wc, bc, ww, bw) = self.lex, self.h, self.params
        kind, one = wc.dtype, np.ones((1, 1), wc.dtype)
        wide, wide_far = bounded(wc.T, bc, np.zeros(1, np.intp))
        narrow, far = bounded(ww, bw, lex.first[:-1])
        across, back = np.ascontiguousarray(wide.T), np.concatenate([wc.T, np.broadcast_to(one, (len(bc), 1))], axis=1)
        top, loss = np.zeros((len(bc), n + 1), kind), 0.0
        ds = np.empty((len(y), n + 1), kind)
        for at in range(0, len(y), SLICE):
            part = slice(at, at + SLICE)
            p = s[part] @ across
            if wide_far[0]:
                most = p.max(axis=1, keepdims=True)
                loss += float(most.sum(dtype=np.float64))
                p -= most
            np.exp(p, out=p)
            np.matmul(p, back, out=ds[part])  # the last column meets ones: the sums
            sums = ds[part, n:].copy()
            loss += float(np.log(sums).sum(dtype=np.float64))
            by = scale / sums  # the rows of p are to be multiplied by this; the narrower sides take it
            ds[part] *= by
            top += p.T @ (s[part] * by)
        flat, parts, taken = self.inner(s, y, narrow, far)
        np.exp(flat, out=flat)
        loss += taken
        back, low = np.concatenate([ww, np.broadcast_to(one, (len(ww), 1))], axis=1), np.zeros((len(ww), n + 1), kind)
        end = parts[-1][1] if parts else 0  # the unknown word, alone in its class, comes last
        inside = np.zeros((end, n + 1), kind)
        inside[:, n] = 1
        for lo, hi, a, b, p in parts:
            np.matmul(p, back[a:b], out=inside[lo:hi])
        sums = inside[:, n:].copy()
        loss += float(np.log(sums).sum(dtype=np.float64))
        by = scale / sums
        inside *= by
        ds[:end] += inside
        by = s[:end] * by
        for lo, hi, a, b, p in parts:
            np.matmul(p.T, by[lo:hi], out=low[a:b])
        cls = lex.cls[used]
        many = (np.diff(lex.first)[cls] > 1)[:, None]  # words alone in their class have no softmax of their own
        own = narrow[used] * many + wide[cls]
        loss -= float(np.vdot(mine, own))
        ds -= np.repeat(own * scale, runs.sizes, axis=0)
        mine = mine * scale
        low[used] -= mine * many
        cls, starts = np.unique(cls, return_index=True)
        top[cls] -= np.add.reduceat(mine, starts)
        return ds[:, :n], [None, None, np.ascontiguousarray(top[:, :n].T), top[:, n], np.ascontiguousarray(low[:, :n]), low[:, n]], loss

    def update(self, grads: list[np.ndarray], used: np.ndarray, rate: float) -> None:
        """Adaptive steps on clipped gradients; of the input table only the rows in use are touched."""
        if not hasattr(self, "squares"):
            self.squares = [np.full_like(p, 1e-6) for p in self.params]
        clip = min(1.0, 1.0 / max(math.sqrt(sum(float(np.vdot(g, g)) for g in grads)), 1e-9))
        for k, g in enumerate(grads):
            p, squares = self.params[k], self.squares[k]
            if clip < 1:
                g *= p.dtype.type(clip)
            more = g * g
            if k == 0:
                more += squares.take(used, axis=0)
                squares[used] = more
                np.sqrt(more, out=more)
            else:
                squares += more
                np.sqrt(squares, out=more)
            np.divide(g, more, out=more)
            more *= rate
            if k == 0:
                p[used] = p.take(used, axis=0) - more
            else:
                p -= more

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def load(self, flat: np.ndarray) -> Recurrent:
        at = 0
        for i, p in enumerate(self.params):
            self.params[i] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self


def model_words(docs: DataFrame, shared) -> DataFrame:
    """(row, ids): all words of each training document as the model knows them, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        known, end = pa.array(list(lex.ids)[: lex.n_model], pa.binary()), lex.model_end()
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column(2)))
            words, sizes = words_of(batch.column(1))
            ids = placed(words, sizes, known, end)
            ids[ids < 0] = lex.n_model
            limits = np.concatenate(([0], np.cumsum(sizes + 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(limits), pa.array(ids.astype(np.int32)))], names=["row", "ids"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "text", held_out()).mapInArrow(run, "row long, ids array<int>")


def fit(docs: DataFrame, shared, lex: Lexicon, n: int, rounds: int = ROUNDS) -> Recurrent:
    """The network after ``rounds`` of training over all ``n`` words of all training documents. What comes back from a round is one
    sum of weights, added up in Spark by blocks; its size is that of the network."""
    spark = docs.sparkSession
    net = Recurrent(lex)
    if not n:
        return net
    # dealt by row, so that a text that occurs often goes to many tasks; long documents come first, lest they go on in few lanes
    # when the others are done
    dealt = model_words(docs, shared).repartition(math.ceil(n / TASK_WORDS), F.xxhash64("row")).sortWithinPartitions(F.size("ids") < LONG, F.xxhash64("row", F.lit(1)))
    dealt = written(dealt, "lm-dealt")
    block = 1 << 14
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(net.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            mine = Recurrent(shared.value).load(start.value)
            seen = mine.read((np.asarray(ids.values) for batch in batches for ids in batch.column(0)), 0.1 / (1 + turn))
            if seen:
                flat = mine.flat().astype(np.float64) * seen
                parts = [flat[i : i + block] for i in range(0, len(flat), block)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))], names=["block", "seen", "weights"])

        parts = dealt.select("ids").mapInArrow(run, "block int, seen long, weights array<double>")
        # tasks send blocks; equal blocks meet and are added up as they arrive
        summed = parts.groupBy("block").applyInArrow(add_blocks, "block int, seen long, weights array<double>")
        rows = sorted(summed.collect())
        if rows:
            net.load(np.concatenate([np.array(r.weights) / r.seen for r in rows]))
        start.unpersist()
    return net


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of one block over all tasks, held one at a time."""
    seen, total, block = 0, None, None
    for batch in batches:
        for b, s, w in zip(batch.column(0), batch.column(1), batch.column(2)):
            block, seen, w = b.as_py(), seen + s.as_py(), np.array(w.values)
            total = w if total is None else total + w
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([seen], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["block", "seen", "weights"])


def rare_words(words: pa.Array, sizes: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int) -> pa.MapArray:
    """Of each text the words without a place, the end included, and how often it holds them."""
    with_ends = pc.take(pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.array(np.insert(np.arange(len(words)), np.cumsum(sizes), len(words))[ids < 0]))
    table = pa.table({"owner": owner[ids < 0], "word": with_ends}).group_by(["owner", "word"], use_threads=False).aggregate([([], "count_all")]).sort_by("owner")
    limits = np.searchsorted(table["owner"].to_numpy(), np.arange(n + 1)).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(limits), table["word"].combine_chunks(), table["count_all"].combine_chunks().cast(pa.int32()))


def top_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``: those above the count from which so many are left. How many words have a
    count is summed in Spark, so no more than the words asked for reach the driver; words of equal count come or go together."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    up = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    level = by_count.withColumn("so_far", F.sum("words").over(up)).where(F.col("so_far") <= most).agg(F.min("n")).first()[0]
    rows = counts.where(F.col("n") >= level).collect() if level is not None else []
    return sorted(((bytes(r.word), r.n) for r in rows), key=lambda x: (-x[1], x[0]))


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row's whole text.

    Null text is empty and has the end alone. Rows that repeat are scored alike. Without training documents all counts are 0
    and both scores are those of a uniform choice. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = written(word_counts(docs), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lex = Lexicon.of(top_words(counts, TOP_WORDS), total, distinct)
    shared = spark.sparkContext.broadcast(lex)
    with scratch(spark):  # the training words go when the network is there
        net = spark.sparkContext.broadcast(fit(docs, shared, lex, total, rounds).flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        model = Recurrent(lex).load(net.value)
        known, end, unknown = pa.array(list(lex.ids), pa.binary()), lex.ids.get(END, -1), lex.n_model
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                n = batch.num_rows
                words, sizes = words_of(batch.column(2))
                ids, owner = placed(words, sizes, known, end), np.repeat(np.arange(n), sizes + 1)
                hit, own = ids[ids >= 0], owner[ids >= 0]
                sums = [np.bincount(own, weights=table[hit], minlength=n).astype(np.float64) for table in (np.ones(len(known)), lex.log_base, lex.log_rest)]
                logp = model.score(np.split(np.where((ids < 0) | (ids > unknown), unknown, ids).astype(np.int32), np.cumsum(sizes + 1)[:-1])) / math.log(10)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes + 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(logp + sums[2]), rare_words(words, sizes, ids, owner, n)],
                    names=["row", "doc_id", "n_tokens", "known", "base", "model", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = written(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, base double, model double, rare map<binary,int>"),
        "lm-scored",
    )
    rare = scored.select("row", F.explode("rare").alias("word", "times")).join(counts.hint("merge"), "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    log = lambda mass: F.sum(F.col("times") * F.log10((n + 0.1) / F.lit(mass)))
    more = rare.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"), log(lex.denominator).alias("more_base"), log(lex.rest_mass).alias("more_model"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(more.hint("merge"), "row", "left").select(
        "doc_id", held_out(), "n_tokens", (F.col("known") + zero("more_known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("model") + zero("more_model")).alias("score"),
    )
