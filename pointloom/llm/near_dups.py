"""Near duplicates by MinHash: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document's set is its distinct word shingles, five words wide unless told otherwise, as 64-bit hashes. One permutation deals the hashes into ``N_BINS``
bins; the least hash of a bin is its value, and an empty bin borrows from the bin that its own hash sequence names first
among the filled ones. Bands of ``ROWS`` bins give the buckets. Documents with the same set are one class from the start and
only the class enters the buckets. In a bucket each class is compared with one centre, so a bucket of n classes costs n - 1
pairs. The centre is the class that meets most others over all bands, so the buckets of one group share their centre and
their pairs fold into one star. Buckets that hold several components after that get other centres. The documents of buckets
that are still split then meet by their rarest shingles, an exact way that loses no similar pair among them; long lists are
compared block against block inside tasks, which give back links and no pairs. Every link is confirmed on the full sets.

Very long texts are read whole; a text costs memory in proportion to its distinct shingles. Of the documents' columns only
doc_id and text are used, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import numbered, scratch, written

N_BINS = 128
ROWS = 4
SIMILAR = 80  # per cent
WIDTH = 5  # words in a shingle
STARS = 3
#: Lists of more rows are compared in blocks of about so many rows, or so many shingles if that is fewer rows.
BLOCK = 512
BLOCK_SHINGLES = 2_000_000
ROWS_PER_FILE = 100_000
MEMORY = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Hashes of the shingles of texts. Words are the bytes between ASCII white space, with A-Z made small."""

    def __init__(self, width: int = WIDTH):
        self.width, self.seen = width, {}

    def word(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self.seen) < MEMORY:
            self.seen[w] = h
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct hashes; fewer words than the width are one shingle, no words none."""
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        seen = self.seen
        h = np.array([seen.get(w) or self.word(w) for w in words], dtype=np.uint64)
        width = min(self.width, len(h))
        out = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            out = scramble(out) + h[k : len(h) - width + 1 + k]
        if width < self.width:
            out += np.uint64(width)
        out = scramble(out)
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them; it serves as the one permutation."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: For each bin the order in which it looks for a filled one when it is empty.
ORDER = scramble(scramble(np.arange(N_BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, 4 * N_BINS + 1, dtype=np.uint64)[None, :])) % np.uint64(N_BINS)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified minima of a sorted set: bins are stretches of the hash range, so each minimum is found by bisection."""
    edges = (np.arange(N_BINS, dtype=np.uint64)) << np.uint64(64 - (N_BINS - 1).bit_length())
    at = np.searchsorted(hashes, edges)
    ends = np.append(at[1:], len(hashes))
    filled = at < ends
    out = np.zeros(N_BINS, np.uint64)
    out[filled] = hashes[at[filled]]
    empty = np.flatnonzero(~filled)
    if len(empty):
        hit = filled[ORDER[empty]]
        first = hit.argmax(axis=1)
        source = ORDER[empty, first].astype(np.int64)
        lost = ~hit.any(axis=1)
        source[lost] = np.flatnonzero(filled)[0]
        out[empty] = out[source]
    return out


def sketches(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, doc_id, n_shingles, set_hash (of the whole set) and one hash per band, from each whole text of (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(width)
        for batch in batches:
            sizes, sets, bands = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                s = make.of(text.as_py())
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                if len(s):
                    rows = signature(s).reshape(-1, ROWS)
                    key = rows[:, 0]
                    for k in range(1, ROWS):
                        key = scramble(key) + rows[:, k]
                    bands.append(scramble(key).view(np.int64))
                else:
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sets, pa.string()), pa.array(bands, pa.list_(pa.int64()))], names=["row", "doc_id", "n_shingles", "set_hash", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, n_shingles long, set_hash string, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, similar: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``texts`` has the row and text of every class in a bucket. The sets are rebuilt from the
    texts next to each other, so a pair carries two texts for one narrow step and nothing larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(width)
        for batch in batches:
            keep, last, left = [], None, None
            for a, x, y in zip(batch.column(0), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                if a != last:
                    last, left = a, make.of(x.as_py())
                right = make.of(y.as_py())
                n = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * n >= similar * (len(left) + len(right) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = lambda n: texts.select(F.col("row").alias(n), F.col("text").alias(f"text_{n}"))
    both = pairs.join(named("a").hint("merge"), "a").join(named("b").hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def linked(rows: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], first: np.ndarray, similar: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between different roots: of rows in ``first`` with those that are not, or, if all are,
    of all with each other. Shared shingles are counted through postings; rows of one root, or of roots linked by now, are
    not compared."""
    heads: dict[int, int] = {}

    def top(r: int) -> int:
        while heads.get(r, r) != r:
            r = heads[r]
        return r

    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(np.bincount(code))))
    holders = owner[np.argsort(code, kind="stable")]
    starts = np.concatenate(([0], np.cumsum(size)))
    names, times = np.unique(roots, return_counts=True)
    common = names[times.argmax()]
    across = not first.all()
    # the root that most rows have is met by the others and asks nothing itself; across blocks every pair is asked from the first
    for i in np.flatnonzero(first) if across else np.flatnonzero(roots != common):
        words = code[starts[i] : starts[i + 1]]
        spans = begin[words + 1] - begin[words]
        at = np.repeat(begin[words] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        n = np.bincount(holders[at], minlength=len(sets))
        hit = (100 * n >= similar * (size + size[i] - n)) & (roots != roots[i])
        if across:
            hit &= ~first
        for j in np.flatnonzero(hit):
            x, y = top(int(roots[i])), top(int(roots[j]))
            if x != y:
                heads[max(x, y)] = min(x, y)
                yield int(min(rows[i], rows[j])), int(max(rows[i], rows[j]))


def list_links(lists: DataFrame, texts: DataFrame, similar: int, width: int) -> DataFrame:
    """The links (a, b) between different roots in lists of many rows: (shingle, row, root, n). A list is dealt into blocks
    of ``BLOCK`` rows or ``BLOCK_SHINGLES`` shingles, about, and each pair of its blocks is one group, compared in one task;
    what a task holds is two blocks, however long the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(width)
        rows, roots, first, sets = [], [], [], []
        for batch in batches:
            rows += batch.column("row").to_pylist()
            roots += batch.column("root").to_pylist()
            first += batch.column("first").to_pylist()
            sets += [make.of(t.as_py()) for t in batch.column("text").cast(pa.binary())]
        found = list(linked(np.array(rows), np.array(roots), sets, np.array(first), similar))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    size = lists.groupBy("shingle").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    d = lists.join(written(size, "near-lists").hint("merge"), "shingle").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("row", "root", "shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("first"))
    d = written(d, "near-blocks").join(texts.hint("merge"), "row")
    return d.groupBy("shingle", "i", "j").applyInArrow(run, "a long, b long")


def prefixes(open_rows: DataFrame, texts: DataFrame, similar: int, width: int) -> DataFrame:
    """(row, root, n, shingle, at, short, holders): the rare shingles by which ``open_rows`` (row, root, n) have to meet.

    Shingles are ordered from rare to frequent among these rows. Two similar sets share one of their rarest shingles: of the
    first n - s n + 1 in the larger set and n - 2 s / (1 + s) n + 1 in the smaller, s being the similarity; and where they
    meet, enough must be left in both. So each set is met by its rare shingles only, and no similar pair is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(width)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = [make.of(t.as_py()).view(np.int64) for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(part.column(0)), [len(x) for x in sets])), pa.array(np.concatenate(sets))], names=["row", "shingle"])

    sets = written(texts.join(open_rows.select("row").hint("merge"), "row", "left_semi").select("row", "text").mapInArrow(run, "row long, shingle long"), "near-sets")
    # counted apart and written, so that the join has no grouping in its tasks and a frequent shingle can be split
    df = written(sets.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "near-counts")
    by_rarity = Window.partitionBy("row").orderBy("df", "shingle")
    # what one row alone holds comes first in its order and meets nothing: only the number of these counts
    shared = sets.join(df.hint("merge"), "shingle").join(open_rows.hint("merge"), "row")
    placed = shared.withColumn("at", F.col("n") - F.count("*").over(Window.partitionBy("row")) + F.row_number().over(by_rarity))
    # whole numbers throughout: ceil(s n) and ceil(2 s n / (1 + s))
    whole = lambda top, under: F.floor((top + (under - 1)) / under)
    n = F.col("n")
    placed = placed.where(F.col("at") <= n - whole(similar * n, 100) + 1)
    placed = written(placed.select("row", "root", "n", "shingle", "at", (F.col("at") <= n - whole(2 * similar * n, 100 + similar) + 1).alias("short")), "near-prefixes")
    several = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("holders")).where("lo < hi").select("shingle", "holders")
    return written(placed.join(written(several, "near-several").hint("merge"), "shingle"), "near-lists")


def list_pairs(lists: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) of different roots that meet in a list and can still be similar."""
    n = F.col("n")
    small = lists.where("short").select("shingle", *(F.col(c).alias(f"{c}_s") for c in ("row", "root", "n", "at")))
    left = F.least(n - F.col("at"), F.col("n_s") - F.col("at_s")) + 1
    fits = (F.col("n_s") * 100 >= similar * n) & (left * (100 + similar) >= similar * (n + F.col("n_s")))
    met = lists.join(small.hint("merge"), "shingle").where("root != root_s and (n_s < n or n_s = n and row_s != row)").where(fits)
    return met.select(F.least("row", "row_s").alias("a"), F.greatest("row", "row_s").alias("b")).distinct()


def packed(df: DataFrame, name: str, rows: int) -> DataFrame:
    """A written table of at most about ``rows`` rows, in no more files than these need."""
    return written(df.coalesce(max(8, rows // ROWS_PER_FILE)), name)


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(row, root) of every row in ``edges``: the least row that edges lead to. Each round every root hooks on its least
    neighbour and follows the hooks twice, so long chains close fast; links inside a component are dropped. ``rows`` bounds
    the number of edges."""
    both = lambda df: df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = packed(both(edges.select("a", "b")).distinct(), "near-links", 2 * rows)
    state = None
    while True:
        hooks = packed(links.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "root"), "near-hooks", rows)
        for _ in range(2):
            up = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            hooks = packed(hooks.join(up.hint("merge"), "to").select("root", F.col("next").alias("to")), "near-hooks", rows)
        state = hooks.select(F.col("root").alias("row"), F.col("to").alias("root")) if state is None else state.join(hooks.hint("merge"), "root", "left").select("row", F.coalesce("to", "root").alias("root"))
        state = packed(state, "near-roots", rows)
        end = lambda n: hooks.select(F.col("root").alias(n), F.col("to").alias(f"r{n}"))
        moved = links.join(end("a").hint("merge"), "a").join(end("b").hint("merge"), "b").where("ra != rb")
        links = packed(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "near-links", 2 * rows)
        if links.isEmpty():
            return state


def classes(numbered_docs: DataFrame, similar: int = SIMILAR, width: int = WIDTH) -> DataFrame:
    """row, doc_id, n_shingles and root of (row, doc_id, text) with unique rows: documents with one root are near duplicates
    of each other. Null text, empty text and text without words have an empty set, no root, and are linked with nothing. Rows
    that repeat are in one class; an empty table gives no rows. The result is a written table; all others are removed."""
    with scratch(numbered_docs.sparkSession):
        return written(rooted(numbered_docs, similar, width), "near-found", keep=True)


def rooted(numbered_docs: DataFrame, similar: int, width: int) -> DataFrame:
    """What ``classes`` writes."""
    made = written(sketches(numbered_docs, width), "near-sketches")
    # the least row stands for its class, so its text is met by a key that no other row has
    reps = written(made.where("set_hash is not null").groupBy("set_hash").agg(F.min(F.struct("row", "n_shingles", "bands")).alias("c")).select("set_hash", "c.*"), "near-classes")
    slots = reps.select("row", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = slots.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    slots = written(slots.join(shared.hint("merge"), ["band", "key"]), "near-slots")
    rows = slots.count()
    met_by = packed(slots.groupBy("row").agg(F.sum("size").alias("meets")), "near-meets", rows)
    texts = written(numbered_docs.select("row", "text").join(met_by.select("row").hint("merge"), "row", "left_semi"), "near-texts")
    slots = packed(slots.drop("size").join(met_by.hint("merge"), "row"), "near-slots", rows)
    tested = edges = roots = None

    def grown(new: DataFrame) -> None:
        nonlocal edges, roots
        if not new.isEmpty():
            edges = new if edges is None else edges.unionByName(new)
            roots = components(edges, rows)

    def placed() -> DataFrame:
        """The slots with the roots known so far; after the first star only those of buckets that hold several."""
        if roots is None:
            return slots.withColumn("root", F.col("row"))
        state = slots.join(roots.hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        several = state.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "key")
        return packed(state.join(several.hint("merge"), ["band", "key"], "left_semi"), "near-open", rows)

    for turn in range(STARS):
        state = placed()
        if turn and state.isEmpty():
            break
        # first the class that meets most others, then any; no centre depends on the band, so that buckets of a group agree
        rank = F.struct(F.lit(0) if turn else -F.col("meets"), F.xxhash64("row", F.lit(turn)))
        centre = state.groupBy("band", "key").agg(F.min(F.struct(rank.alias("by"), "row", "root", "n_shingles")).alias("c"))
        met = state.join(centre.hint("merge"), ["band", "key"]).where((F.col("root") != F.col("c.root")) & (F.least("n_shingles", "c.n_shingles") * 100 >= similar * F.greatest("n_shingles", "c.n_shingles")))
        pairs = met.select(F.least("row", "c.row").alias("a"), F.greatest("row", "c.row").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
        pairs = packed(pairs, "near-pairs", rows)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        grown(written(confirmed(pairs, texts, similar, width), "near-edges"))
    state = placed()
    if not state.isEmpty():
        lists = prefixes(state.select("row", "root", F.col("n_shingles").alias("n")).distinct(), texts, similar, width)
        pairs = list_pairs(lists.where(F.col("holders") <= BLOCK), similar)
        pairs = packed(pairs if tested is None else pairs.join(tested.hint("merge"), ["a", "b"], "left_anti"), "near-pairs", rows)
        new = confirmed(pairs, texts, similar, width)
        hot = lists.where(F.col("holders") > BLOCK).drop("at", "short", "holders")
        grown(written(new if hot.isEmpty() else new.unionByName(list_links(hot, texts, similar, width)), "near-edges"))
    final = reps.select("row", "set_hash")
    final = final.join(roots.hint("merge"), "row", "left").select("set_hash", F.coalesce("root", "row").alias("root")) if roots is not None else final.select("set_hash", F.col("row").alias("root"))
    return made.select("row", "doc_id", "n_shingles", "set_hash").join(final.hint("merge"), "set_hash", "left").select("row", "doc_id", "n_shingles", "root")


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the component) and kept (whether it is this document).
    Documents without words are their own components. A component of rows without doc_id has a null id and keeps its rows."""
    with scratch(docs.sparkSession):
        found = classes(numbered(docs.select("doc_id", "text"), "near-documents").select("row", "doc.*"), similar, width)
    least = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = found.join(written(least, "near-least").hint("merge"), "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def without_near_duplicates(docs: DataFrame, similar: int = SIMILAR, width: int = WIDTH) -> DataFrame:
    """One row of each component, with its own columns: that with the least doc_id, rows without doc_id last; of rows that
    share it, one. Rows whose text has no words all stay. No row leaves because of its doc_id: different texts that share
    one, or have none, are told apart."""
    whole = numbered(docs, "near-documents")
    found = classes(whole.select("row", "doc.doc_id", "doc.text"), similar, width)
    keeper = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("k")).select("k.row")
    kept = written(found.where("root is null").select("row").unionByName(keeper), "near-kept")
    return whole.join(kept.hint("merge"), "row", "left_semi").select("doc.*")
