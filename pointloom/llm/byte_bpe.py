"""Byte-level BPE by recursive SQL inside tasks, and decoding by ordered aggregation.

Spark deals the texts; every Python worker keeps one in-memory DuckDB with the merge table, and works partition by partition. A
text is cut into the matches of the pattern, a match into stretches between bytes that stand side by side in no token and so can't
be merged. Stretches that the worker has not met yet go to DuckDB as rows (word, position, token). One step of the recursion joins
neighbouring rows with the merge table and contracts each word's leftmost pair of least rank; words without a pair drop out, and
the steps end when none is left. Decoding joins ids with the tokens' bytes and strings them together in order of position.

Long stretches have a recursion of their own, for which rows are keyed by (word, position), so that memory follows the word and not
the word times the steps. There, further places of the same rank are contracted in the same step where the new token's pairs all
rank behind it, as then the leftmost-first order would take them next; else only the leftmost is.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator, Sequence

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words whose ids a worker remembers, bytes of new stretches that go to one recursion, characters that are worked on at a time,
#: matches of a longer text, and ids that are decoded together.
MEMORY = 300_000
LOT = 1 << 18
TEXT = 1 << 21
MATCHES = 1 << 18
DECODE = 1 << 19
#: Bytes from which a stretch is long.
LONG = 64

STEPS = """
with recursive s(step, w, p, q, k) as (
    select 0, w, p, p + 1, k from start
    union all
    select x.step + 1, x.w, x.p, case when x.p = b.p then b.q else x.q end, case when x.p = b.p then b.c else x.k end
    from s x join (
        select l.w, min(m.c) c, arg_min(l.p, m.c::bigint << 20 | l.p) p, arg_min(r.p, m.c::bigint << 20 | l.p) gone, arg_min(r.q, m.c::bigint << 20 | l.p) q
        from s l join s r on r.w = l.w and r.p = l.q join merges m on m.a = l.k and m.b = r.k group by l.w
    ) b on b.w = x.w where x.p <> b.gone
)
select w, list(k order by p) ids from s where step = (select max(step) from s last where last.w = s.w) group by w order by w
"""
#: Each step reads the words that changed in the step before. `low` holds pairs whose merge ranks before one of the two.
LONG_STEPS = """
with recursive s(w, p, k) using key (w, p) as (
    select w, p, k from start
    union
    select w, unnest([p, q]) p, unnest([c, null]) k from (
        select w, p, q, c, place, max(early) over (partition by w) early, min(place) over (partition by w) leftmost from (
            select *, row_number() over (partition by w, place - nth order by place) % 2 = 1 chosen,
                (k0, c) in (select (a, b) from low where c < b) or (c, k3) in (select (a, b) from low where c < a) or (c, c) in (select (a, b) from low) early
            from (
                select *, row_number() over (partition by w order by place) nth from (
                    select n.*, m.c, min(m.c) over (partition by w) least from (
                        select w, p, k, row_number() over t place, lag(k) over t k0, lead(p) over t q, lead(k) over t k2, lead(k, 2) over t k3
                        from recurring.s where k is not null and w in (select w from s) window t as (partition by w order by p)
                    ) n join merges m on m.a = n.k and m.b = n.k2
                ) where c = least
            )
        ) where chosen
    ) where not early or place = leftmost
)
select w, list(k order by p) ids from s where k is not null group by w order by w
"""
TEXTS = "select t, string_agg(hex, '' order by p) bytes from ids join tokens using (id) group by t order by t"


def lots(sizes: Sequence[int] | np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbours whose sizes together are ``most`` at the most; a larger one stands alone."""
    i, total = 0, 0
    for j, size in enumerate(sizes):
        if j > i and total + size > most:
            yield i, j
            i, total = j, 0
        total += size
    if len(sizes):
        yield i, len(sizes)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank in each line. A rank is the token's id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Ranks as tables of a DuckDB of one worker. ``pattern`` has to match every character somewhere; what it leaves out is lost."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.joined = np.zeros((256, 256), bool)
        rows = []
        for token, rank in ranks.items():
            self.joined[list(token[:-1]), list(token[1:])] = True
            rows += [(ranks[a], ranks[b], rank) for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        a, b, c = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True)) if rows else [pa.array([], pa.int32())] * 3
        self.table("merges", a=a, b=b, c=c)
        self.table("tokens", id=pa.array(ranks.values(), pa.int32()), hex=pa.array([t.hex() for t in ranks]))
        self.db.execute("create table low as select * from merges where c < a or c < b")
        self.words: dict[str, bytes] = {}

    def table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as select * from given")
        self.db.unregister("given")

    def contract(self, stretches: list[bytes], steps: str) -> list[bytes]:
        """Ids of each, as 32-bit numbers, by one recursion over all of them."""
        sizes = np.array([len(s) for s in stretches])
        ends = np.cumsum(sizes)
        whole = np.frombuffer(b"".join(stretches), np.uint8)
        position = np.arange(len(whole)) - np.repeat(ends - sizes, sizes)
        self.table("start", w=pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), p=pa.array(position, pa.int32()), k=pa.array(self.byte[whole]))
        found = self.db.sql(steps).to_arrow_table().column("ids").combine_chunks()
        flat, offsets = found.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes(), (4 * found.offsets.to_numpy()).tolist()
        return [flat[i:j] for i, j in itertools.pairwise(offsets)]

    def learn(self, words: set[str]) -> None:
        """Afterwards ``self.words`` has the ids of all these words; if it is full, it keeps no others."""
        if len(self.words) > MEMORY:
            self.words = {w: self.words[w] for w in words if w in self.words}
        new = [w for w in words if w not in self.words]
        if not new:
            return
        raw = [w.encode("utf-8") for w in new]
        whole, ends = b"".join(raw), np.cumsum([len(r) for r in raw])
        b = np.frombuffer(whole, np.uint8)
        cut = ~self.joined[b[:-1], b[1:]]
        cut[ends[:-1] - 1] = True
        at = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(whole)]])
        parts = [whole[i:j] for i, j in itertools.pairwise(at.tolist())]
        upto = np.searchsorted(at, ends).tolist()
        known: dict[bytes, bytes] = {}
        distinct = set(parts)
        for steps, some in ((STEPS, [s for s in distinct if len(s) < LONG]), (LONG_STEPS, [s for s in distinct if len(s) >= LONG])):
            for i, j in lots([len(s) for s in some], LOT):
                known.update(zip(some[i:j], self.contract(some[i:j], steps), strict=True))
        self.words.update((w, b"".join([known[s] for s in parts[i:j]])) for w, i, j in zip(new, [0, *upto], upto, strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit numbers."""
        if len(texts) == 1 and len(texts[0]) > TEXT:
            out, matches = bytearray(), (m[0] for m in self.pattern.finditer(texts[0]))
            while some := [m for m in itertools.islice(matches, MATCHES) if m]:
                self.learn(set(some))
                out += b"".join([self.words[m] for m in some])
            return [bytes(out)]
        found = [self.pattern.findall(t) for t in texts]
        self.learn({m for some in found for m in some if m})
        of = self.words
        return [b"".join([of[m] for m in some if m]) for some in found]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids. Ids that stand for no token give none."""
        sizes = np.diff(offsets)
        self.table("ids", t=pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), p=pa.array(np.arange(len(ids)), pa.int64()), id=pa.array(ids, pa.int32()))
        out = [b""] * len(sizes)
        for t, text in self.db.execute(TEXTS).fetchall():
            out[t] = bytes.fromhex(text)
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encoded(c: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id and ids of (doc_id, text), some texts at a time."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    for i, j in lots([len(t) for t in texts], TEXT):
        ids = c.encode(texts[i:j])
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["doc_id", "ids"])


def decoded(c: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id, ids and bytes of (doc_id, ids), some rows at a time."""
    sizes = np.array([len(x) if x.is_valid else 0 for x in batch.column(1)])
    for i, j in lots(sizes, DECODE):
        lists = batch.column(1).slice(i, j - i)
        texts = c.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum([0, *sizes[i:j]]))
        valid = lists.is_valid().to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.binary())], names=["doc_id", "ids", "bytes"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row's whole text, special tokens' names being ordinary text. Null text is empty and has no
    ids; rows that repeat count alike; an empty table gives no rows; other columns don't come along. One narrow step, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield from encoded(c, batch)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and bytes (binary) of rows of ids. Null ids give null bytes, ids of no token nothing. Bytes are not checked for being
    UTF-8, since ids may be any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield from decoded(c, batch)

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, ids array<int>, bytes binary")


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``decode`` of ``encode`` in one worker a task, so that words and tables are held once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for ids in encoded(c, batch):
                yield from decoded(c, ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, bytes binary")
