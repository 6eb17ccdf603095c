"""Byte-level BPE: encoding and decoding of whole texts by a table of ranks.

A text is cut into pieces, and each piece is merged by ranks alone. The cuts are those of the pattern that goes with the
vocabulary, found without a regular expression: every codepoint has a class, classes with what follows them are symbols, and
symbols are functions between the eight states of an automaton. Functions compose associatively, so blocks of codepoints are
scanned side by side: a number stands for each function that symbols can come to, and a table says what two come to.
Tokens keep the byte offset at which they end, which decoding places them by.

Null text reads as empty text and has no tokens. The vocabulary is a file of some hundred KB that goes along with each task.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .words import cut

# What the pattern takes for a piece of its own after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

WINDOW = 1 << 20  # bytes of text that are scanned at once
SLICE = 1 << 21  # bytes of texts that become one batch of results; a longer text has one of its own
PIECES = 1 << 19  # distinct pieces that a worker remembers, and
PIECE_BYTES = 32 << 20  # their bytes
SHORT_PIECE = 48  # bytes of a piece that is merged side by side with others; a longer one has a heap of its own
NEVER = np.int64(1) << 40  # rank of two tokens whose union is none

# Classes of codepoints.
OTHER, LETTER, NUMBER, GAP, SPACE = range(5)
# Symbols: what a codepoint means to the automaton, with what follows it. FIRST is added for the first one of a text.
OTHERS, LETTERS, NUMBERS, SHORT, LONG, INNER, LAST_GAP, LAST_SPACE = range(8)
FIRST = 8
# States: what the piece so far is. START: a codepoint begins a piece, whatever it is.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)


@lru_cache(1)
def codepoint_classes() -> np.ndarray:
    """The class of each codepoint, by the edition of Unicode that tiktoken's own patterns have."""
    import tiktoken

    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    classes = np.zeros(0x110000, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", GAP)):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for k in range(0, len(every), 1 << 16):
            text = bytes(own.encode_ordinary("".join(map(chr, every[k : k + (1 << 16)])))).decode()
            classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)] = kind
    classes[ord(" ")] = SPACE
    return classes


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(state after the symbol, whether its codepoint begins a piece)."""
    if symbol >= FIRST:
        return _step(START, symbol - FIRST)[0], True
    if state in (ONE_MORE, TWO_MORE):
        return (START if state == ONE_MORE else ONE_MORE), False
    run = {LETTERS: IN_LETTERS, NUMBERS: IN_NUMBERS, OTHERS: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS, INNER: IN_GAP}
    if state == AFTER_SPACE or state != START and run.get(symbol) == state:
        return run.get(symbol, START), False
    begun = {SHORT: ONE_MORE, LONG: TWO_MORE, LAST_GAP: START, LAST_SPACE: AFTER_SPACE}
    return begun.get(symbol, run.get(symbol, START)), True


class Automaton:
    """All functions that runs of symbols can come to, numbered; 0 changes no state."""

    def __init__(self):
        steps = [tuple(_step(s, x)[0] for s in range(8)) for x in range(2 * FIRST)]
        number = {tuple(range(8)): 0}
        todo = [tuple(range(8))]
        for f in todo:  # grows while it is read
            for g in steps:
                h = tuple(g[s] for s in f)
                if h not in number:
                    number[h] = len(number)
                    todo.append(h)
        self.of_symbol = np.array([number[g] for g in steps], np.uint8 if len(number) < 256 else np.uint16)
        self.after = np.array(todo, np.uint8)  # function, state -> state
        self.both = np.array([[number[tuple(g[s] for s in f)] for g in todo] for f in todo], self.of_symbol.dtype)
        self.begins = np.array([[_step(s, x)[1] for x in range(2 * FIRST)] for s in range(8)])

    def scan(self, symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """(whether each symbol begins a piece, state after the last), from a state before the first."""
        n = len(symbols)
        width = max(int(n**0.5), 1)
        wide = -(-n // width)
        f = np.zeros(wide * width, self.of_symbol.dtype)
        f[:n] = self.of_symbol[symbols]
        f = np.ascontiguousarray(f.reshape(wide, width).T)  # a column is a block
        for k in range(1, width):
            f[k] = self.both[f[k - 1], f[k]]
        total, reach = f[-1].copy(), 1
        while reach < wide:  # of all blocks up to each
            total[reach:] = self.both[total[:-reach], total[reach:]]
            reach *= 2
        ahead = np.concatenate([[state], self.after[total[:-1], state]]).astype(np.uint8)
        before = np.empty(f.shape, np.uint8)
        before[0] = ahead
        before[1:] = self.after[f[:-1], ahead]
        return self.begins[before.T.reshape(-1)[:n], symbols], int(self.after[total[-1], state])


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


def _symbols(points: np.ndarray, n: int, classes: np.ndarray, first: np.ndarray, end: bool) -> np.ndarray:
    """Symbols of the first n codepoints; the others are there to look at. first: which begin a text; end: nothing follows the last."""
    kind = classes[points]
    gap = kind >= GAP
    apart = np.append(first[1:], end)  # a text ends here
    follows = np.append(gap[1:], False) | apart
    out = np.array([OTHERS, LETTERS, NUMBERS, LAST_GAP, LAST_SPACE], np.uint8)[kind]
    out[gap & follows] = INNER
    for at in np.flatnonzero(points[:n] == ord("'")):
        rest = points[at + 1 : at + 3]
        rest = rest[: 1 + int(np.argmax(apart[at + 1 : at + 3])) if apart[at + 1 : at + 3].any() else 2]
        after = "" if apart[at] else "".join(map(chr, rest))
        if after[:1] in ENDINGS:
            out[at] = SHORT
        elif after in ENDINGS:
            out[at] = LONG
    return (out + FIRST * first.astype(np.uint8))[:n]


def piece_starts(data: bytes, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts one after another; text k has bytes offsets[k] to offsets[k + 1]."""
    found, state, at = [np.zeros(0, np.int64)], START, 0
    raw = np.frombuffer(data, np.uint8)

    def whole(end: int) -> int:  # a codepoint is never cut
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        return min(end, len(raw))

    heads = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
    while at < len(raw):
        end = whole(at + WINDOW)
        more = whole(end + 4)
        more = whole(more + 1) if more < len(raw) else more
        lead = np.flatnonzero(raw[at:more] & 0xC0 != 0x80) + at
        points = np.frombuffer(data[at:more].decode("utf-8").encode("utf-32-le"), np.uint32)
        n = int(np.searchsorted(lead, end))
        first = np.zeros(len(points), bool)
        here = heads[np.searchsorted(heads, at) : np.searchsorted(heads, more)]
        first[np.searchsorted(lead, here)] = True
        begins, state = automaton().scan(_symbols(points, n, classes, first, more == len(raw)), state)
        found.append(lead[:n][begins])
        at = end
    return np.concatenate(found)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a piece: of neighbours whose union is a token the lowest rank joins first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n)), bytearray(n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or after[i] >= n or after[after[i]] != end:
            continue  # one of the two has been joined to another
        gone[after[i]] = 1
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    return [ranks[piece[i : after[i]]] for i in range(n) if not gone[i]]


class Vocabulary:
    """Ranks from a file with a token in base 64 and its rank a line, and the pieces met so far."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        unions = {
            (self.ranks[token[:k]] << 32) + self.ranks[token[k:]]: rank
            for token, rank in self.ranks.items() for k in range(1, len(token)) if token[:k] in self.ranks and token[k:] in self.ranks
        }
        self.pairs = np.array(sorted(unions), np.int64)
        self.union = np.array([unions[k] for k in self.pairs.tolist()] + [NEVER], np.int64)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.forget()

    def forget(self) -> None:
        fresh: list[bytes] = []

        class Pieces(dict):
            def __missing__(self, piece: bytes) -> int:
                self[piece] = k = len(self)
                fresh.append(piece)
                return k

        self.known, self.fresh, self.kept = Pieces(), fresh, 0
        self.flat, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(np.append(self.pairs, -1)[at] == key, self.union[at], NEVER)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces, number of each one's), as merged has them one by one: a round joins one pair of every piece."""
        length = np.array([len(p) for p in pieces], np.int64)
        done = [(k, merged(pieces[k], self.ranks)) for k in np.flatnonzero(length > SHORT_PIECE)]
        of, token = [np.repeat(k, len(t)) for k, t in done], [np.array(t, np.int64) for _, t in done]
        short = np.flatnonzero(length <= SHORT_PIECE)
        t = self.single[np.frombuffer(b"".join([pieces[k] for k in short]), np.uint8)]
        p = np.repeat(short, length[short])
        rank = np.full(len(t), NEVER)  # of a token and the next one of its piece
        whole = p[:-1] == p[1:]
        rank[:-1][whole] = self._rank(t[:-1][whole], t[1:][whole])
        while len(t):
            begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(p))))
            ended = least == NEVER
            if ended.any():
                of.append(p[ended])
                token.append(t[ended])
                t, p, rank, least = t[~ended], p[~ended], rank[~ended], least[~ended]
                if not len(t):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.append(True, p[at[1:]] != p[at[:-1]])]  # the leftmost of equals
            t[at] = rank[at]
            stays = np.ones(len(t), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))
            t, p = t[stays], p[stays]
            rank = rank[stays]
            for k in (at, at[at > 0] - 1):
                new = np.full(len(k), NEVER)
                same = np.flatnonzero(k + 1 < len(t))
                same = same[p[k[same]] == p[k[same] + 1]]
                new[same] = self._rank(t[k[same]], t[k[same] + 1])
                rank[k] = new
        of, token = np.concatenate([np.zeros(0, np.int64), *of]), np.concatenate([np.zeros(0, np.int64), *token])
        order = np.argsort(of, kind="stable")
        return token[order], np.bincount(of, minlength=len(pieces))

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces, number of each one's). Pieces met before are looked up."""
        of = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        if self.fresh:
            tokens, count = self.merge(self.fresh)
            self.flat = np.concatenate([self.flat, tokens])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count)])
            self.kept += sum(map(len, self.fresh))
            self.fresh.clear()
        count = np.diff(self.first)[of]
        place = np.arange(count.sum()) + np.repeat(self.first[of] - np.cumsum(count) + count, count)
        tokens = self.flat[place].astype(np.int32)
        if len(self.known) > PIECES or self.kept > PIECE_BYTES:
            self.forget()
        return tokens, count

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another."""
        size = self.size[tokens]
        return self.bytes[np.arange(size.sum()) + np.repeat(self.start[tokens] - np.cumsum(size) + size, size)]


@lru_cache(2)
def _vocabulary(packed: bytes) -> Vocabulary:
    return Vocabulary(zlib.decompress(packed))


@lru_cache(1)
def _classes(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def encode_texts(column: pa.Array, vocabulary: Vocabulary, classes: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """(ids, ends) of each text: its tokens, and the byte of the text at which each ends."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
    offsets = offsets - offsets[0]
    starts = piece_starts(data, offsets, classes)
    edges = np.append(starts, len(data)).tolist()
    tokens, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for k in range(0, len(starts), WINDOW):
        some = edges[k : k + WINDOW + 1]
        t, c = vocabulary.encode([data[a:b] for a, b in zip(some, some[1:])])
        tokens.append(t)
        counts.append(c)
    ids = np.concatenate(tokens)
    upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])[np.searchsorted(starts, offsets)]
    ends = np.cumsum(vocabulary.size[ids]) - np.repeat(offsets[:-1], np.diff(upto))
    places = pa.array(upto, pa.int32())
    return pa.ListArray.from_arrays(places, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(places, pa.array(ends, pa.int32()))


def decode_tokens(ids: pa.ListArray, ends: pa.ListArray, vocabulary: Vocabulary) -> pa.Array:
    """The bytes of each list of tokens, cut where the offsets say that texts end. A null list has none."""
    size = ids.value_lengths().fill_null(0).to_numpy()
    tokens, at = ids.flatten().to_numpy(), ends.flatten().to_numpy()
    data, own = vocabulary.decode(tokens), vocabulary.size[tokens]
    before = np.cumsum(size) - size
    whole = np.zeros(len(size), np.int64)
    whole[size > 0] = at[(before + size - 1)[size > 0]]
    if not np.array_equal(at, np.cumsum(own) - np.repeat(np.cumsum(whole) - whole, size)):
        raise ValueError("tokens and the offsets at which they end don't belong together")
    edges = np.concatenate([[0], np.cumsum(whole)])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])


def _read(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def _clear(docs: DataFrame, names: tuple[str, ...]) -> None:
    if taken := {c.lower() for c in docs.columns} & set(names):
        raise ValueError(f"columns {sorted(taken)} would stand twice; leave them out of keep")


def encoded(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """docs' columns keep, with ids array<int> (the tokens of the whole text) and ends array<int> (the byte at which each ends).

    path: a file of ranks on the driver. Rows come as they are: repeated ones again, null texts and empty ones without tokens. An empty
    table gives an empty one. Columns beside keep may have any names; keep must not hold "ids" or "ends". Nothing is shuffled.
    """
    own = docs.select(*keep)
    _clear(own, ("ids", "ends"))
    vocabulary, classes = _read(path), zlib.compress(codepoint_classes().tobytes())
    schema = StructType(own.schema.fields).add("ids", ArrayType(IntegerType())).add("ends", ArrayType(IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "_text to encode", SLICE):
                lists = encode_texts(part.column(part.num_columns - 1), _vocabulary(vocabulary), _classes(classes))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names=[*part.schema.names[:-1], "ids", "ends"])

    return docs.select(*keep, docs[text].alias("_text to encode")).mapInArrow(encode, schema)


def decoded(tokens: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """tokens' columns keep, with data binary: the bytes that (ids, ends) stand for. keep must not hold "data"."""
    own = tokens.select(*keep)
    _clear(own, ("data",))
    vocabulary = _read(path)
    schema = StructType(own.schema.fields).add("data", BinaryType())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = batch.columns[-2:]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], decode_tokens(ids, ends, _vocabulary(vocabulary)).cast(pa.binary())], names=[*batch.schema.names[:-2], "data"])

    return tokens.select(*keep, tokens["ids"].alias("ids of tokens"), tokens["ends"].alias("ends of tokens")).mapInArrow(decode, schema)
