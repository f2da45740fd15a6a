"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts of an Arrow batch become one array of code points. A table gives each its class (letter, number, space, other,
apostrophe); class and neighbours select one of a few transition functions over the states of a small automaton.
Functions compose associatively, so the states of all positions come from a blocked scan: each block's composition,
a scan over blocks, then the states inside of all blocks at once. Positions where the automaton starts a piece cut the
text, no regular expression is run. Distinct pieces of a batch are merged once, through a cache that a worker keeps.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ferrule.session import ship

#: The public tokenizers' folder on every machine of the cluster; only the driver reads it.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Code points scanned at once (a longer text is scanned alone) and pieces a worker's cache holds at most.
SCAN_POINTS, CACHE_PIECES = 2_000_000, 500_000

OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)  # BLANK is U+0020, SPACE any other white space
# what the automaton is inside of after a position
IN_L, IN_N, IN_O, IN_W, LEAD, LEFT1, LEFT2, OVER = range(8)
# symbols: class and what follows; FIRST is added at the start of a text
S_L, S_N, S_O, S_Q1, S_Q2, S_WMID, S_WLEAD, S_WONE = range(8)
FIRST = 8

# fixed values: Unicode White_Space
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# fixed values: the suffixes that an apostrophe keeps with it
SHORT_SUFFIXES, LONG_SUFFIXES = "stmd", ("re", "ve", "ll")


def class_table() -> np.ndarray:
    """The class of every code point, from the Unicode general categories."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    table[32], table[39] = BLANK, QUOTE
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]: whether a piece begins at the position."""
    nxt, starts = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for sym, inside in ((S_L, IN_L), (S_N, IN_N), (S_O, IN_O), (S_Q1, LEFT1), (S_Q2, LEFT2), (S_WMID, IN_W), (S_WLEAD, LEAD), (S_WONE, IN_W)):
        nxt[sym] = nxt[sym + FIRST] = inside
        joins = {S_L: (IN_L, LEAD), S_N: (IN_N, LEAD), S_O: (IN_O, LEAD), S_Q1: (IN_O, LEAD), S_Q2: (IN_O, LEAD), S_WMID: (IN_W,)}.get(sym, ())
        for state in joins:
            starts[sym, state] = False
            if sym in (S_Q1, S_Q2):
                nxt[sym, state] = IN_O
    for state, to in ((LEFT2, LEFT1), (LEFT1, OVER)):
        nxt[S_L, state], starts[S_L, state] = to, False
    return nxt, starts


NEXT, STARTS = _automaton()


def symbols(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The automaton's symbol at each code point; first marks where texts begin."""
    kind = classes[points]
    last = np.empty_like(first)
    last[:-1], last[-1:] = first[1:], True
    after = np.empty_like(points)
    after[:-1], after[-1:] = points[1:], 0
    after = np.where(last, 0, after)  # no apostrophe has a suffix U+0000
    after2 = np.empty_like(points)
    after2[:-1], after2[-1:] = after[1:], 0
    after2 = np.where(last, 0, after2)
    white = (kind == SPACE) | (kind == BLANK)
    next_black = np.zeros(len(points), bool)
    next_black[:-1] = ~white[1:]
    next_black &= ~last
    sym = np.select(
        [kind == LETTER, kind == NUMBER, white & ~next_black, kind == BLANK, white], [S_L, S_N, S_WMID, S_WLEAD, S_WONE], S_O
    ).astype(np.uint8)
    quote = kind == QUOTE
    if quote.any():
        sym[quote & np.isin(after, [ord(c) for c in SHORT_SUFFIXES])] = S_Q1
        for a, b in LONG_SUFFIXES:
            sym[quote & (after == ord(a)) & (after2 == ord(b))] = S_Q2
    sym[first] += FIRST
    return sym


def scan_states(sym: np.ndarray, width: int = 512) -> np.ndarray:
    """The state before each position, by a blocked scan over composed transition functions."""
    n = len(sym)
    blocks = max(1, -(-n // width))
    grid = np.full(blocks * width, S_WMID, np.uint8)
    grid[:n] = sym
    columns = np.ascontiguousarray(grid.reshape(blocks, width).T)
    composed = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in columns:  # compose: first what the block did so far, then this position
        composed = NEXT[column[:, None], composed]
    # inclusive scan over the blocks' functions, doubling the span each time
    span = 1
    while span < blocks:
        later = np.take_along_axis(composed[span:], composed[:-span].astype(np.intp), axis=1)
        composed = np.concatenate([composed[:span], later])
        span *= 2
    state = np.full(blocks, OVER, np.uint8)
    state[1:] = composed[:-1, OVER]
    before = np.empty((width, blocks), np.uint8)
    for i, column in enumerate(columns):
        before[i] = state
        state = NEXT[column, state]
    return before.T.reshape(-1)[:n]


def piece_starts(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pieces of the joined texts, in code points, and where each text begins (texts aren't empty)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    first = np.zeros(len(points), bool)
    first[begin] = True
    sym = symbols(points, first, classes)
    return np.flatnonzero(STARTS[sym, scan_states(sym)]), begin


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by its rule."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Vocabulary:
    """Ids and merges of a byte-level BPE file (the `tokenizers` library's JSON); specials are ordinary text."""

    def __init__(self, data: bytes) -> None:
        model, letters = json.loads(data)["model"], byte_letters()
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.cache: dict[str, np.ndarray] = {}
        self.classes = class_table()

    def merge(self, data: bytes) -> list[int]:
        """Merge the best-ranked neighbours until none is left; a heap keeps long pieces out of quadratic time."""
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = self.merges[a, b][1], -1, right[j]
            if right[j] < n:
                left[right[j]] = i
                if r := self.merges.get((ids[i], ids[right[j]])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[right[j]]))
            if (p := left[i]) >= 0 and (r := self.merges.get((ids[p], ids[i]))):
                heapq.heappush(heap, (r[0], p, ids[p], ids[i]))
        return [t for t in ids if t >= 0]

    def ids(self, piece: str) -> np.ndarray:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            found = self.cache[piece] = np.array(self.merge(piece.encode("utf-8", "surrogatepass")), np.int32)
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other and each text's number of ids; null and empty texts have none."""
        counts, out, todo, points = np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            if text:
                todo.append(i)
                points += len(text)
            if todo and (points >= SCAN_POINTS or i == len(texts) - 1):
                ids, counts[todo] = self._encode([texts[k] for k in todo])
                out.append(ids)
                todo, points = [], 0
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        starts, begin = piece_starts(texts, self.classes)
        joined, ends = "".join(texts), [*starts[1:].tolist(), sum(map(len, texts))]
        number: dict[str, int] = {}
        codes = np.fromiter((number.setdefault(joined[a:b], len(number)) for a, b in zip(starts.tolist(), ends)), np.int64, len(starts))
        merged = [self.ids(p) for p in number]
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        flat, at = np.concatenate(merged), np.cumsum(sizes) - sizes
        each = sizes[codes]
        total = np.cumsum(each)
        ids = flat[np.repeat(at[codes] - (total - each), each) + np.arange(total[-1])]
        first_piece = np.searchsorted(starts, begin)
        per_text = np.add.reduceat(each, first_piece)
        return ids, per_text


def _vocabulary(df: DataFrame, path: str):
    """The tokenizer's file, sent to the workers once; its size is fixed by the file, not by the data."""
    ship(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


_LOADED: dict[int, Vocabulary] = {}


def _load(sent) -> Vocabulary:
    key = hash(sent.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(sent.value)
    return _LOADED[key]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{BYTE_BPE}", offsets: bool = False) -> DataFrame:
    """(key, ids[, starts]): the token ids of every row's whole text, special tokens' strings being ordinary text.

    Null and empty texts have the empty list. `starts` holds the offset of each id's first byte in the text's UTF-8,
    so that a slice of ids can be decoded and placed. Rows are independent: no shuffle, repeated rows stay.
    """
    sent = _vocabulary(df, path)
    name, kind = key, df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _load(sent)
        width = np.zeros(max(vocab.bytes_of) + 1, np.int64)
        for i, b in vocab.bytes_of.items():
            width[i] = len(b)
        for batch in batches:
            ids, counts = vocab.encode(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns = {name: batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))}
            if offsets:
                size = width[ids]
                total = np.concatenate([[0], np.cumsum(size)])
                starts = total[:-1] - np.repeat(total[ends[:-1]], counts)
                columns["starts"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(starts.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"`{name}` {kind}, ids array<int>" + ", starts array<int>" * offsets
    return df.select(key, text).mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(key, n_tokens) of every row, 0 for null and empty texts."""
    sent, name, kind = _vocabulary(df, path), key, df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _load(sent)
        for batch in batches:
            counts = vocab.encode(batch.column(1).to_pylist())[1]
            yield pa.RecordBatch.from_pydict({name: batch.column(0), "n_tokens": pa.array(counts.astype(np.int32))})

    return df.select(key, text).mapInArrow(run, f"`{name}` {kind}, n_tokens int")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(key, text): the text that a list of ids spells; a null list gives null, the empty list the empty text."""
    sent, name, kind = _vocabulary(df, path), key, df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = _load(sent).bytes_of
        for batch in batches:
            texts = [None if x is None else b"".join(spelled[i] for i in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({name: batch.column(0), "text": pa.array(texts, pa.string())})

    return df.select(key, ids).mapInArrow(run, f"`{name}` {kind}, text string")
