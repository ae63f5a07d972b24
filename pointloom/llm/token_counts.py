"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary's pieces stand in two tries, one for pieces that start a word and one for those that go on. Each node has a
failure link: where matching goes on after the longest pieces of what has been read are taken off, and how many pieces that
are, worked out once. So a word is counted in one pass over its characters, without backing up and without building pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MEMORY = 400_000
START, GO_ON = 0, 1


class Automaton:
    """Built from pieces; those with the prefix ``mark`` start words. ``count`` gives the number of pieces of a word, or 0 if
    its greedy split meets a character that no piece takes."""

    def __init__(self, pieces: Iterable[str], mark: str = "▁"):
        self.next: dict[tuple[int, str], int] = {}
        whole: set[int] = set()
        kids: list[list[tuple[str, int]]] = [[], []]
        pieces = set(pieces)
        for piece in sorted(pieces):
            starts = piece.startswith(mark)
            node = START if starts else GO_ON
            body = piece[len(mark) :] if starts else piece
            if not body:
                continue
            for c in body:
                to = self.next.get((node, c))
                if to is None:
                    to = self.next[node, c] = len(kids)
                    kids.append([])
                    kids[node].append((c, to))
                node = to
            whole.add(node)
        self.fail, self.popped = [-1] * len(kids), [0] * len(kids)
        if mark in pieces:  # the mark alone is a piece: a word may start with it and go on
            self.fail[START], self.popped[START] = GO_ON, 1
        queue = deque([START, GO_ON])
        while queue:
            u = queue.popleft()
            for c, v in kids[u]:
                if v in whole:
                    self.fail[v], self.popped[v] = GO_ON, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and (z, c) not in self.next:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z, c], n
                queue.append(v)

    def count(self, word: str) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        u, n = START, 0
        for c in word:
            while (to := step.get((u, c))) is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 0
            u = to
        while u != GO_ON:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 0
        return n


def sentencepiece_pieces(path: str) -> list[str]:
    """The ordinary pieces of a model file, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


_built: dict[str, tuple[Automaton, dict]] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for each row's whole text. A word that can't be split is one unknown token. Null
    text is empty; rows that repeat count alike; an empty table gives no rows. One narrow step, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _built:
            _built[path] = Automaton(sentencepiece_pieces(path)), {}
        automaton, seen = _built[path]

        def of(word: bytes) -> int:
            n = automaton.count(word.decode("utf-8"))
            if len(seen) < MEMORY:
                seen[word] = n
            return n

        for batch in batches:
            sizes, tokens, unknown = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = (text.as_py() or b"").split()
                counts = np.array([seen[w] if w in seen else of(w) for w in words], dtype=np.int64)
                lost = int((counts == 0).sum())
                sizes.append(len(words))
                unknown.append(lost)
                tokens.append(int(counts.sum()) + lost)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
