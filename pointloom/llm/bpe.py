"""BPE encoding and decoding as a streaming transducer.

Symbols go in one at a time. For every position the transducer keeps the last token of the encoding of all text up to
there; that token is the only one, among the tokens that end there, that stands next to the last token before it without
being merged across. A token is at most ``window`` symbols long, a bound worked out from the merge list, so whatever
comes next continues from one of the last ``window`` positions. Where the paths back from all of these meet, everything
before is stable: it is emitted and forgotten, and memory stays constant however long the text is.

Vocabularies are read with the ``tokenizers`` JSON layout; the file's place is a parameter. Tasks run over Arrow batches,
each text whole; pieces that occur often are remembered in a table of bounded size.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Remembered chunks of text, words and pairs of tokens at most, a worker.
MEMORY = 400_000
MEMORY_WORDS = 150_000
MEMORY_PAIRS = 600_000
PUNCTUATION = frozenset(".,;:!?")
FLUSH = 4
#: Characters of a text, and ids, that are worked on at a time.
STRETCH = 1 << 16
DECODE = 4096
#: White space of the Unicode standard, which the file's normaliser replaces.
UNICODE_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
ODD_CONTROLS = regex.compile("[\x1c-\x1f]")

#: Fixed values. Letters and numbers that ``regex`` knows and the tokenizers library's splitter, at Unicode 16, does not.
LATER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1"
    r"\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF"
    r"\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    r"\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479"
    r"\U0003D000-\U0003FC3F"
)
#: Fixed values. Marks that joined Unicode after version 9, which the library's normaliser neither moves nor joins to what stands before.
LATER_MARKS = (
    r"\u07FD\u0898-\u089F\u08CA-\u08D3\u09FE\u0C3C\u0D3B-\u0D3C\u0EBA\u1715\u1ABF-\u1ACE\u1DF6-\u1DFA\uA82C"
    r"\U00010D24-\U00010D27\U00010EAB-\U00010EAC\U00010EFD-\U00010EFF\U00010F46-\U00010F50\U00010F82-\U00010F85\U00011070"
    r"\U0001133B\U0001145E\U00011839-\U0001183A\U00011930\U0001193D-\U0001193E\U00011943\U000119E0\U00011A34\U00011A47"
    r"\U00011A99\U00011D42\U00011D44-\U00011D45\U00011D97\U00011F41-\U00011F42\U00016FF0-\U00016FF1\U0001E08F"
    r"\U0001E130-\U0001E136\U0001E2AE\U0001E2EC-\U0001E2EF\U0001E4EC-\U0001E4EF"
)
APART = regex.compile(f"([{LATER_MARKS}])")
#: Fixed values. Capitals of Unicode 16 and 17 with their small letters: one by one, and ranges with the distance.
NEW_CAPITALS = ((0x1C89, 0x1C8A), (0xA7CB, 0x0264), (0xA7CC, 0xA7CD), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D3), (0xA7D4, 0xA7D5), (0xA7DA, 0xA7DB), (0xA7DC, 0x019B))
NEW_CAPITAL_RANGES = ((0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))


def byte_letters() -> list[str]:
    """One printable character for each byte: bytes that print stand for themselves, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


def splitter(pattern: str) -> regex.Pattern:
    """The file's pattern with the letters and numbers of Unicode 16; ``LATER`` ones are neither."""
    for kind in "LN":
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[\\p{{{kind}}}--[{LATER}]]")
    return regex.compile(pattern.replace("[^\\s\\p{L}\\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{LATER}])"), regex.V1)


def composed(text: str) -> str:
    """NFC as the library's normaliser has it: ``LATER_MARKS`` are ordinary characters, which part what stands on either side."""
    return "".join([unicodedata.normalize("NFC", part) for part in APART.split(text)])


def small_letters() -> dict[int, str]:
    """Small letters of capitals that joined Unicode after 15.1, and the small sigma wherever a capital one stands."""
    pairs = dict(NEW_CAPITALS)
    for first, last, by in NEW_CAPITAL_RANGES:
        pairs |= {c: c + by for c in range(first, last + 1)}
    return {c: chr(to) for c, to in pairs.items()} | {ord("\u03a3"): "\u03c3"}


class Vocabulary:
    """A BPE model: pieces, merges, the mark of word ends and the special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: p for p, i in self.ids.items()} | {i: p for p, i in self.special.items()}
        self.rank = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((a, b), k)
        self.pattern = splitter(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters, self.small = byte_letters(), small_letters()
        self.window = self.lookahead()
        self.size = {i: len(self.symbols_of_piece(p)) for p, i in self.ids.items()}
        #: What a token can end with: the id where it is a whole token, else -1. Only pieces that the merges rebuild count.
        self.tails: dict[str, int] = {}
        for p, i in self.ids.items():
            symbols = self.symbols_of_piece(p)
            if len(symbols) == 1 or len(self.merge(symbols)) == 1:
                for k in range(1, len(symbols)):
                    self.tails.setdefault("".join(symbols[k:]), -1)
                self.tails[p] = i
        self.fits: dict[int, bool] = {}

    def symbols_of_piece(self, piece: str) -> list[str]:
        """The symbols a piece is made of; the word end belongs to the last of them."""
        if self.end and piece.endswith(self.end) and piece != self.end:
            body = piece[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return [*piece]

    def lookahead(self) -> int:
        """The longest piece that the merges can build, in symbols: a token that covers a position ends within so many."""
        size: dict[str, int] = {}
        for a, b in self.rank:
            size[a + b] = max(size.get(a + b, 0), size.get(a, 1) + size.get(b, 1))
        return max(size.values(), default=1)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging, best rank and leftmost first; for the few symbols of two neighbours."""
        out = list(symbols)
        while len(out) > 1:
            ranks = [self.rank.get(pair, 1 << 60) for pair in zip(out, out[1:])]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == 1 << 60:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when they stand side by side."""
        a, b = self.pieces[left], self.pieces[right]
        known = self.merge(self.symbols_of_piece(a) + self.symbols_of_piece(b)) == [a, b]
        if len(self.fits) < MEMORY_PAIRS:
            self.fits[left << 20 | right] = known
        return known


class Transducer:
    """Encodes one stream of symbols. ``feed`` takes some symbols and returns the tokens that have become stable by then,
    often none; the last call, with ``end``, gives its last symbol the word end and returns the rest."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.buffer = ""  # the symbols since the last emission, without the word end
        self.last = [-1]  # for each position in the buffer the last token up to it; at 0 the token before the buffer

    def feed(self, symbols: str, end: bool = False) -> list[int]:
        v, last, window = self.v, self.last, self.v.window
        find, fits = v.tails.get, v.fits
        start = len(self.buffer)
        text = self.buffer = self.buffer + symbols
        size = len(text)
        for n in range(start + 1, size + 1):
            k, pick = n - 1, -1
            tail = v.end if end and n == size else ""
            low = n - window if n > window else 0
            while k >= low:
                token = find(text[k:n] + tail if tail else text[k:n])
                if token is None:
                    break
                if token >= 0:
                    before = last[k]
                    ok = True if before < 0 else fits.get(before << 20 | token)
                    if ok is None:
                        ok = v.neighbours(before, token)
                    if ok:
                        pick = token
                        break
                k -= 1
            last.append(pick)
        if end:
            return self.back(size)
        return self.flush() if size >= FLUSH * window else []

    def flush(self) -> list[int]:
        """Emits what all paths from the last positions share."""
        n = len(self.buffer)
        at = set(range(n - self.v.window + 1, n + 1))
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - self.v.size[self.last[far]])
        meet = at.pop()
        out = self.back(meet)
        if out:
            self.buffer, self.last = self.buffer[meet:], [out[-1], *self.last[meet + 1 :]]
        return out

    def back(self, p: int) -> list[int]:
        out, size = [], self.v.size
        while p > 0:
            out.append(self.last[p])
            p -= size[self.last[p]]
        return out[::-1]


class Encoder:
    """Texts to ids, as the file's normaliser, splitter and merges say."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.seen: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None

    def word(self, piece: str) -> tuple[int, ...]:
        """One piece of the splitter: its UTF-8 bytes go through a transducer, a stretch at a time."""
        known = self.words.get(piece)
        if known is None:
            symbols = piece if piece.isalpha() and piece.isascii() else "".join([self.v.letters[b] for b in piece.encode("utf-8")])
            run, stretch = Transducer(self.v), FLUSH * self.v.window
            if len(symbols) <= stretch:
                known = tuple(run.feed(symbols, end=True))
            else:
                out: list[int] = []
                last = (len(symbols) - 1) // stretch * stretch
                for k in range(0, last, stretch):
                    out += run.feed(symbols[k : k + stretch])
                known = (*out, *run.feed(symbols[last:], end=True))
            if len(self.words) < MEMORY_WORDS and len(piece) < 64:
                self.words[piece] = known
        return known

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Text without white space. A mark at its end is a piece of its own after an ASCII letter, which nothing joins."""
        if chunk[-1] in PUNCTUATION and chunk.isascii() and chunk[:-1][-1:].isalpha():
            return (self.seen.get(chunk[:-1]) or self.chunk(chunk[:-1])) + self.word(chunk[-1])
        plain = chunk if chunk.isascii() else composed(chunk).translate(self.v.small)
        out: list[int] = []
        for piece in self.v.pattern.findall(plain.lower()):
            out += self.word(piece)
        known = tuple(out)
        if len(self.seen) < MEMORY and len(chunk) < 64:
            self.seen[chunk] = known
        return known

    def segment(self, text: str, out: list[int]) -> None:
        seen = self.seen
        if ODD_CONTROLS.search(text):
            chunks = [c for c in UNICODE_SPACE.split(text) if c]
        else:
            chunks = text.split()
        for c in chunks:
            got = seen.get(c)
            out.extend(self.chunk(c) if got is None else got)

    def stretches(self, text: str) -> Iterator[str]:
        """A long text in parts that end before white space, so that no chunk is cut."""
        start = 0
        while len(text) - start > STRETCH:
            cut = UNICODE_SPACE.search(text, start + STRETCH)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def plain(self, text: str, out: list[int]) -> None:
        """Text between special tokens."""
        for part in self.stretches(text):
            self.segment(part, out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text. Besides them, memory is bounded by a stretch of text and, in a chunk without white space,
        by the transducer's window."""
        out: list[int] = []
        if not text:
            return out
        if self.specials is not None and any(s in text for s in self.v.special):
            at = 0
            for m in self.specials.finditer(text):
                self.plain(text[at : m.start()], out)
                out.append(self.v.special[m[0]])
                at = m.end()
            self.plain(text[at:], out)
        else:
            self.plain(text, out)
        return out


class Decoder:
    """Ids to text, one at a time. Bytes are handed on as soon as they complete a character; what can't be completed
    becomes U+FFFD. ``pieces=True`` joins the pieces with spaces, as the library does for files that name no decoder;
    otherwise letters go back to bytes and word ends to spaces."""

    def __init__(self, vocab: Vocabulary, pieces: bool = True):
        self.v, self.pieces, self.first = vocab, pieces, True
        self.value = {c: b for b, c in enumerate(vocab.letters)}
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.led = {i: b" " + p.encode("utf-8") for i, p in vocab.pieces.items()} if pieces else {}

    def raw(self, i: int) -> bytes:
        piece = self.v.pieces.get(i)
        if piece is None:
            return b""
        if self.pieces:
            lead, self.first = b"" if self.first else b" ", False
            return lead + piece.encode("utf-8")
        if piece in self.v.special:
            return piece.encode("utf-8")
        body, end = (piece[: -len(self.v.end)], b" ") if self.v.end and piece.endswith(self.v.end) else (piece, b"")
        return bytes(self.value[c] for c in body) + end

    def push(self, i: int) -> str:
        return self.machine.decode(self.raw(i))

    def close(self) -> str:
        return self.machine.decode(b"", final=True)

    def decode(self, ids: Iterable[int]) -> str:
        """A whole list: the same state machine, fed with the bytes of some ids at a time."""
        out, ids = [], iter(ids)
        while part := [*islice(ids, DECODE)]:
            if self.pieces:
                raw = b"".join([self.led[i] for i in part if i in self.led])
                if self.first and raw:
                    raw, self.first = raw[1:], False
            else:
                raw = b"".join([self.raw(i) for i in part])
            out.append(self.machine.decode(raw))
        out.append(self.close())
        self.machine.reset()
        self.first = True
        return "".join(out)


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(Vocabulary(path))
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, pieces: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, ids array<int> and decoded string for each row's whole text. Null text is empty and has no
    ids; rows that repeat are encoded alike; an empty table gives no rows. One narrow step, no shuffle. Columns of ``keep``
    named ids or decoded give way."""
    keep = tuple(c for c in keep if c not in ("ids", "decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        dec = Decoder(enc.v, pieces)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # small results: texts can be long
                part = batch.slice(start, 256)
                ids, ends, texts = [], [0], []
                for text in part.column(1):
                    got = enc.encode(text.as_py())
                    ids.append(np.array(got, dtype=np.int32))
                    ends.append(ends[-1] + len(got))
                    texts.append(dec.decode(got))
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(texts, pa.string())], names=["row", "ids", "decoded"])

    rows = docs.select(F.struct(*keep).alias("row"), "text")
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, decoded string").select("row.*", "ids", "decoded")
