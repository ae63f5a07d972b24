"""Conversation prefix trie as a burst trie.

A turn's id is the 128-bit digest of its role and text, a conversation the row of its turn ids, so texts are never shuffled. Copies
are one sequence with a count. All sequences start in one container under the root. A container of more than ``LIMIT`` sequences
bursts: what its sequences have in common becomes a chain of trie heads, and the next turn id deals them to containers of their own;
this repeats for those that are still too large. What is left is dealt by container, sorted by turn ids and swept with a stack, which
gives a node whenever a sequence parts from the one before it. Heads get their sums from the containers below them, last burst first.

Counts and sums of a head are taken before the shuffle, so a head that most conversations share is no hot key, and conversations that
repeat meet only as counts. The ids of the conversations that end at a node are range-sorted and strung together piece by piece; the
last step for a group of copies, one digest over its pieces in order, is sequential by the nature of that digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import word_count, written

#: Sequences from which a container bursts, and rounds of bursts; a container that is too large after these is swept as it is.
LIMIT = 8192
ROUNDS = 64
#: Heads that are sent to every executor at most; more of them are joined by a shuffle.
HEADS = 500_000
#: Conversation ids in a piece, and rows in a batch of results.
PIECE = 1 << 16
BATCH = 1 << 15
WIDTH = 16
NONE = hashlib.sha256(b"").hexdigest()


def turn_ids(turns: DataFrame) -> DataFrame:
    """All rows with turn_id (binary) and words (of the text). Null role and text are empty; the role's length stands in the digest, so
    that role and text can't be mistaken for one another."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.select("conv_id", "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn_id"), word_count(text).alias("words"))


def sequences(turns: DataFrame, family: int = 0) -> DataFrame:
    """conv_id, digest, ids (turn ids in a row) and words (64-bit numbers in a row) of each conversation, by turn, null first, ties by
    turn id, so repeated rows stand side by side. With ``family``, the first crc32(conv_id) % 4 turns come from the conversation
    conv_id - conv_id % family, none if it is absent. Rows without conv_id are no conversation's. A conversation is one row, 24 bytes a turn."""
    conv = F.col("conv_id")
    base = conv - conv % family if family else conv

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, bytes, bytes, bytes]] = []
        now, base_of, ids, words, head = None, None, [], [], ([], [])

        def end() -> None:
            nonlocal head
            if family:
                if now == base_of:
                    head = ids[:3], words[:3]
                h = zlib.crc32(str(now).encode()) % 4
                mine, counts = head[0][:h] + ids[h:], head[1][:h] + words[h:]
            else:
                mine, counts = ids, words
            whole = b"".join(mine)
            out.append((now, hashlib.md5(whole).digest(), whole, struct.pack(f"<{len(counts)}q", *counts)))

        for batch in batches:
            for b, c, t, n in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != now:
                    if now is not None:
                        end()
                    if b != base_of:
                        base_of, head = b, ([], [])
                    now, ids, words = c, [], []
                ids.append(t)
                words.append(n)
            if len(out) >= BATCH:
                yield batch_of(out, SEQUENCE)
                out = []
        if now is not None:
            end()
        if out:
            yield batch_of(out, SEQUENCE)

    dealt = turn_ids(turns).where(conv.isNotNull()).select(base.alias("base"), conv.cast("long").alias("conv_id"), "turn", "turn_id", "words").repartition("base")
    return dealt.sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "turn_id").select(F.col("base").cast("long"), "conv_id", "turn_id", "words").mapInArrow(rows, "conv_id long, digest binary, ids binary, words binary")


SEQUENCE = {"conv_id": pa.int64(), "digest": pa.binary(), "ids": pa.binary(), "words": pa.binary()}
RUN = {"digest": pa.binary(), "rep": pa.int64(), "n": pa.int64(), "piece": pa.string(), "ends": pa.string()}
NODE = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(), "turn_id": pa.binary(), "up": pa.binary()}
RUN_TYPE = "digest binary, rep long, n long, piece string, ends string"
NODE_TYPE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, turn_id binary, up binary"


def batch_of(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), schema.values(), strict=True)], names=list(schema))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (digest, conv_id): a row with the digest of all its ids for each run that surely stands here alone, pieces of ids for one
    that may begin or go on in another task, or is long."""
    out: list[tuple] = []
    now, ids, open_ = None, [], True

    def piece() -> None:
        out.append((now, ids[0], len(ids), ",".join(map(str, ids)), None))

    for batch in batches:
        for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if d != now:
                if now is not None:
                    if open_:
                        piece()
                    else:
                        out.append((now, ids[0], len(ids), None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
                    open_ = False
                now, ids = d, []
            elif len(ids) >= PIECE:
                piece()
                ids, open_ = [], True
            ids.append(c)
        if len(out) >= BATCH:
            yield batch_of(out, RUN)
            out = []
    if now is not None:
        piece()
    if out:
        yield batch_of(out, RUN)


def joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by (digest, first id): one row with the digest of all ids for each. One piece is held at a time."""
    out: list[tuple] = []
    now, first, n, sha = None, 0, 0, hashlib.sha256()
    for batch in batches:
        for d, rep, size, text, _ in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if d != now:
                if now is not None:
                    out.append((now, first, n, None, sha.hexdigest()))
                now, first, n, sha = d, rep, 0, hashlib.sha256()
            sha.update((("," if n else "") + text).encode())
            n += size
    if now is not None:
        out.append((now, first, n, None, sha.hexdigest()))
    if out:
        yield batch_of(out, RUN)


def classes(seqs: DataFrame) -> DataFrame:
    """rep (the least conv_id), n and ends (SHA-256 over all conv_ids in order) of each distinct sequence."""
    found = written(seqs.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(runs, RUN_TYPE), "trie-runs")
    pieces = found.where("piece is not null").repartition("digest").sortWithinPartitions("digest", "rep").mapInArrow(joined_pieces, RUN_TYPE)
    return found.where("piece is null").unionByName(pieces).select("rep", "n", "ends")


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two rows of ids have in common, the first ``start`` known to be."""
    most = min(len(a), len(b)) // WIDTH
    while start < most and a[start * WIDTH : (start + 1) * WIDTH] == b[start * WIDTH : (start + 1) * WIDTH]:
        start += 1
    return start


def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of turns that the least and the largest sequence of a container, and so all of it, have in common."""
    for batch in batches:
        lo, hi = batch.column("lo").to_pylist(), batch.column("hi").to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([shared(a, b) for a, b in zip(lo, hi, strict=True)], pa.int32())], names=[*batch.schema.names[:-1], "lcp"])


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each container, its sequences sorted. A node waits for its parent's end, since only then the parent's least
    member is known; the container's top goes out without parent, with the head it hangs on."""
    out: list[tuple] = []
    stack: list[list] = []  # conv_id, n, children, leaves, saved, ends, words, children's rows, depth, turn id
    now, before, up = None, b"", None

    def push(depth: int, ids: bytes, words: bytes) -> None:
        stack.append([None, 0, 0, 0, 0, None, struct.unpack_from("<q", words, 8 * (depth - 1))[0] if depth else 0, [], depth, ids[WIDTH * (depth - 1) : WIDTH * depth] if depth else None])

    def pop() -> None:
        conv, n, children, leaves, saved, ends, words, below, depth, turn = stack.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * words
        out.extend((*row[:2], conv, *row[2:]) for row in below)
        row = (conv, depth, n, children, leaves, saved, ends, turn, None)
        if stack:
            top = stack[-1]
            top[0] = conv if top[0] is None or conv < top[0] else top[0]
            top[1] += n
            top[2] += 1
            top[3] += leaves
            top[4] += saved
            top[7].append(row)
        else:
            out.append((conv, depth, None, *row[2:-1], up))

    for batch in batches:
        for head, depth, above, rep, n, ends, ids, words in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if head != now:
                while stack:
                    pop()
                now, up = head, above
                push(depth, ids, words)
                at = depth
            else:
                at = shared(before, ids, depth)
                while stack[-1][8] > at:
                    pop()
            for d in range(at + 1, len(ids) // WIDTH + 1):
                push(d, ids, words)
            last = stack[-1]
            last[0], last[1], last[5] = rep if last[0] is None or rep < last[0] else last[0], last[1] + n, ends
            before = ids
            if len(out) >= BATCH:
                yield batch_of(out, NODE)
                out = []
    while stack:
        pop()
    if out:
        yield batch_of(out, NODE)


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of heads: from a burst container's top down to where its sequences part. All have the same members."""
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            saved = r["saved_tokens"]
            for d in range(r["lcp"], r["depth"] - 1, -1):
                saved += (r["n_convs"] - 1) * (struct.unpack_from("<q", r["words"], 8 * (d - 1))[0] if d else 0)
                last, top = d == r["lcp"], d == r["depth"]
                out.append((r["conv_id"], d, None if top else r["conv_id"], r["n_convs"], r["n_children"] if last else 1, r["n_leaves"], saved, r["ends"] if last else None, r["lo"][WIDTH * (d - 1) : WIDTH * d] if d else None, r["up"] if top else None))
        if out:
            yield batch_of(out, NODE)


def head(depth: Column) -> Column:
    return F.unhex(F.md5(F.substring("ids", F.lit(1), WIDTH * depth)))


def joint(rows: DataFrame, heads: DataFrame, key: str, few: bool) -> DataFrame:
    return rows.join(F.broadcast(heads) if few else heads.hint("merge"), key, "left")


def sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("up").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"))


def trie(seqs: DataFrame, limit: int = LIMIT, rounds: int = ROUNDS) -> DataFrame:
    """A row for each distinct row of first turns: conv_id (least member), depth, parent_conv_id (the parent's, null for the root), n_convs
    (members), n_children, n_leaves, saved_tokens (words of the last text that members after the first repeat, over the subtree),
    ends_sha256 (of the conv_ids that end here, ascending, joined by commas) and turn_id (of the last turn, null for the root).

    Conversations without turns end at the root; an empty table has no node. ``seqs`` has one row for each conv_id."""
    seqs = written(seqs, "trie-sequences")
    reps = classes(seqs)
    first = seqs.withColumnRenamed("conv_id", "rep").join(reps.hint("merge"), "rep")
    depth = F.lit(0).cast("int")
    state = written(first.select(head(depth).alias("head"), depth.alias("depth"), F.lit(None).cast("binary").alias("up"), "rep", "n", "ends", "ids", "words"), "trie-state")
    settled, ended, bursts = [], [], []
    for _ in range(rounds):
        sizes = state.groupBy("head", "depth", "up").agg(F.count("*").alias("size"), F.min(F.struct("ids", "words")).alias("lo"), F.max("ids").alias("hi")).where(F.col("size") > limit)
        typed = "head binary, depth int, up binary, lo binary, words binary, lcp int"
        big = written(sizes.select("head", "depth", "up", F.col("lo.ids").alias("lo"), F.col("lo.words").alias("words"), "hi").mapInArrow(common, typed), "trie-heads")
        n_big = big.count()
        if not n_big:
            break
        bursts.append((big, n_big))
        split = joint(state, big.select("head", "lcp"), "head", n_big <= HEADS)
        stays, below = F.col("lcp").isNull(), F.col("lcp") + 1
        kind = F.when(stays, "stays").when(F.octet_length("ids") == WIDTH * F.col("lcp"), "ends").otherwise("goes on")
        split = written(split.select(F.when(stays, F.col("head")).otherwise(head(below)).alias("head"), F.coalesce(below, "depth").alias("depth"), F.when(stays, F.col("up")).otherwise(F.col("head")).alias("up"), "rep", "n", "ends", "ids", "words", kind.alias("kind")), "trie-state")
        settled.append(split.where("kind = 'stays'").drop("kind"))
        ended.append(split.where("kind = 'ends'").select("up", F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), *(F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), "ends"))
        state = split.where("kind = 'goes on'").drop("kind")
    settled.append(state)
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    nodes = rows.repartition("head").sortWithinPartitions("head", "ids").select("head", "depth", "up", "rep", "n", "ends", "ids", "words").mapInArrow(swept, NODE_TYPE)
    if bursts:
        nodes = written(nodes, "trie-nodes")
        tops = nodes.where("up is not null").select("up", "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
        for more in ended:
            tops = tops.unionByName(more)
        below, found = written(sums(tops), "trie-tops"), []
        for big, _ in reversed(bursts):
            mine = written(big.join(below.withColumnRenamed("up", "head").hint("merge"), "head").mapInArrow(chains, NODE_TYPE), "trie-chains")
            parents = big.join(below.withColumnRenamed("up", "head").hint("merge"), "head").select(F.col("head").alias("up"), F.col("conv_id").alias("above"))
            found.append((mine, parents))
            tops = mine.where("up is not null").select("up", "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
            below = written(sums(below.unionByName(tops)), "trie-tops")
        parents = found[0][1]
        for mine, more in found:
            nodes = nodes.unionByName(mine)
        for _, more in found[1:]:
            parents = parents.unionByName(more)
        nodes = joint(nodes, written(parents, "trie-parents"), "up", sum(n for _, n in bursts) <= HEADS).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"), "turn_id")
