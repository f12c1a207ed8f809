"""Problem 6: encoding of the whole corpus with a public byte-level BPE vocabulary.

Pre-tokenisation is vectorised over a whole Arrow batch and uses no regex. Code points become symbol
classes (one look-up table, one code point of look-ahead); every class is a transition function of a
small automaton; the functions' composition is associative, so prefixes are composed by doubling, on
ids of the transition monoid, until every prefix is a constant function, which is the state. States
and classes give the token starts. The resulting byte slices go through cached pair merging.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie, unless a query says otherwise.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Pieces kept in a process's cache; it starts anew beyond that.
CACHE_PIECES = 400_000
#: Code points encoded at once, so that a batch of long texts doesn't fill memory.
SLICE_CHARS = 2_000_000

# symbol classes
LETTER, NUMBER, OTHER, QUOTE, SHORT, LONG, BLANK_LAST, SPACE_LAST, SPACE = range(9)
RESET = 9  # first symbol of a text: not a class, but a function that forgets what was before
# states
FRESH, BLANK, IN_L, IN_N, IN_O, APO, APO2, DONE, IN_S = range(9)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and starts[state, class] of the automaton for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|S+(?!not S)|S+ ."""
    nxt = np.zeros((9, 9), np.uint8)
    start = np.ones((9, 9), bool)
    nxt[:, LETTER] = nxt[:, SHORT] = nxt[:, LONG] = IN_L
    for c in (LETTER, SHORT, LONG):
        start[[BLANK, IN_L], c] = False
        nxt[APO2, c], start[APO2, c] = DONE, False  # second letter of 're, 've, 'll
    nxt[APO, SHORT], start[APO, SHORT] = DONE, False  # 's 't 'm 'd
    nxt[APO, LONG], start[APO, LONG] = APO2, False
    nxt[:, NUMBER] = IN_N
    start[[BLANK, IN_N], NUMBER] = False
    nxt[:, OTHER] = IN_O
    start[[BLANK, IN_O, APO], OTHER] = False
    nxt[:, QUOTE] = APO
    nxt[[BLANK, IN_O, APO], QUOTE] = IN_O
    start[[BLANK, IN_O, APO], QUOTE] = False
    nxt[:, BLANK_LAST] = BLANK
    nxt[:, SPACE_LAST] = FRESH
    nxt[:, SPACE] = IN_S
    start[IN_S, SPACE] = False
    return nxt, start


def _monoid(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the classes' functions: ids of the generators (and of those that begin a
    text), composition[first, second], and the state of constant functions (255: not constant)."""
    gens = [tuple(nxt[:, c]) for c in range(9)]
    firsts = [(nxt[FRESH, c],) * 9 for c in range(9)]
    ids: dict[tuple, int] = {}
    todo = [*gens, *firsts]
    for f in todo:
        ids.setdefault(tuple(int(x) for x in f), len(ids))
    elements = list(ids)
    k = 0
    while k < len(elements):
        for g in elements[: k + 1]:
            for f, h in ((elements[k], g), (g, elements[k])):
                c = tuple(h[x] for x in f)
                if c not in ids:
                    ids[c] = len(ids)
                    elements.append(c)
        k += 1
    n = len(elements)
    comp = np.zeros((n, n), np.uint16)
    for i, f in enumerate(elements):
        for j, h in enumerate(elements):
            comp[i, j] = ids[tuple(h[x] for x in f)]
    const = np.array([f[0] if len(set(f)) == 1 else 255 for f in elements], np.uint8)
    gen_ids = np.array([[ids[tuple(int(x) for x in f)] for f in gens], [ids[tuple(int(x) for x in f)] for f in firsts]], np.uint16)
    return gen_ids, comp, const


_NEXT, _START = _tables()
_GEN, _COMP, _CONST = _monoid(_NEXT)
_class_of: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of every code point, before look-ahead."""
    global _class_of
    if _class_of is None:
        t = np.full(0x110000, OTHER, np.uint8)
        cats = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)
        t[cats == ord("L")] = LETTER
        t[cats == ord("N")] = NUMBER
        # The code points with the property White_Space.
        for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
            t[a : b + 1] = SPACE
        t[ord("'")] = QUOTE
        _class_of = t
    return _class_of


def token_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. chars: code points of texts one after another; first: whether a code
    point is the first of its text."""
    n = len(chars)
    if not n:
        return np.zeros(0, bool)
    sym = _classes()[chars]
    after = np.zeros(n, np.uint32)
    after[:-1] = chars[1:]
    ends = np.ones(n, bool)
    ends[:-1] = first[1:]
    after[ends] = 0
    space = sym == SPACE
    before_word = space & ~ends
    before_word[:-1] &= ~space[1:]
    sym[before_word] = SPACE_LAST
    sym[before_word & (chars == 32)] = BLANK_LAST
    for c in "stmd":
        sym[chars == ord(c)] = SHORT
    for c, d in (("r", "e"), ("v", "e"), ("l", "l")):
        sym[(chars == ord(c)) & (after == ord(d))] = LONG
    f = _GEN[first.astype(np.intp), sym]
    # prefix composition by doubling; constant prefixes are final
    open_ = np.flatnonzero(_CONST[f] == 255)
    step = 1
    while len(open_):
        f[open_] = _COMP[f[open_ - step], f[open_]]
        open_ = open_[_CONST[f[open_]] == 255]
        step *= 2
    state = np.empty(n, np.uint8)
    state[0] = FRESH
    state[1:] = _CONST[f[:-1]]
    state[first] = FRESH
    starts = _START[state, sym]
    starts[first] = True
    return starts


class Vocabulary:
    """Ranks of byte strings, with cached pair merging."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of a pre-token: the adjacent pair of lowest rank, leftmost first, is merged
        until no pair is in the vocabulary. A linked list and a heap: n log n for long pieces."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, e = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[i] >= e or end[end[i]] != e:
                continue
            j = end[i]
            alive[j] = False
            end[i] = e
            if e < n:
                prev[e] = i
                r = ranks.get(piece[i : end[e]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            p = prev[i]
            if p >= 0:
                r = ranks.get(piece[p:e])
                if r is not None:
                    heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each text's ids."""
        parts, counts = [], np.zeros(len(texts) + 1, np.int64)
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLICE_CHARS):
                size += len(texts[to] or "")
                to += 1
            ids, n = self._encode([t or "" for t in texts[at:to]])
            parts.append(ids)
            counts[at + 1 : to + 1] = n
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.cumsum(counts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(lengths) - lengths
        first = np.zeros(len(chars), bool)
        first[begin[lengths > 0]] = True
        starts = np.flatnonzero(token_starts(chars, first))
        width = np.ones(len(chars), np.int64)
        width += (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        byte_at = np.concatenate(([0], np.cumsum(width)))
        data = joined.encode("utf-8", "surrogatepass")
        bounds = byte_at[np.append(starts, len(chars))].tolist()
        cache, merge = self.cache, self.merge
        if len(cache) > CACHE_PIECES:
            cache.clear()
        out: list[int] = []
        pieces = np.empty(len(starts), np.int64)
        a = bounds[0]
        for k in range(len(starts)):
            b = bounds[k + 1]
            piece = data[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = merge(piece)
                if b - a <= 64:
                    cache[piece] = ids
            out += ids
            pieces[k] = len(out)
            a = b
        # ids up to the last piece of each text
        upto = np.concatenate(([0], pieces))
        last = np.searchsorted(starts, begin + lengths)
        return np.array(out, np.int32), upto[last] - upto[np.searchsorted(starts, begin)]

    def decode(self, ids: Iterable[int]) -> str:
        if not hasattr(self, "_bytes"):
            self._bytes = {v: k for k, v in self.ranks.items()}
        return b"".join(self._bytes[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[int, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """The vocabulary of a rank file's content; one a process."""
    key = hash(data)
    if key not in _loaded:
        _loaded[key] = Vocabulary(data)
    return _loaded[key]


def read_ranks(name: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> bytes:
    """The rank file of a public tokenizer, read on the driver; under 1 MB each."""
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def encode(documents: DataFrame, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids (array<int>) of every row of ``documents`` (doc_id, text; more columns are
    ignored). Null and empty texts have an empty list. Repeated rows stay. No special tokens: their
    strings are ordinary text. Nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(tokenizer, directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in batches:
            ids, offsets = v.encode_batch(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def spans(documents: DataFrame, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids and ends (array<int>) of every row: the offset in the text's UTF-8 bytes after each
    token, so that any range of tokens can be traced to its place in the text. Nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(tokenizer, directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        width = np.zeros(1 + max(v.ranks.values()), np.int32)
        for piece, i in v.ranks.items():
            width[i] = len(piece)
        for batch in batches:
            ids, offsets = v.encode_batch(batch.column("text").to_pylist())
            upto = np.concatenate(([0], np.cumsum(width[ids], dtype=np.int64)))
            ends = upto[1:] - np.repeat(upto[offsets[:-1]], np.diff(offsets))
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "ids", "ends"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, ends array<int>")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """doc_id and text of every row (doc_id, ids): the way back; null ids give a null text. Ids that cut
    a character in two give U+FFFD there; an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(tokenizer, directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in batches:
            texts = [None if ids is None else v.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """doc_id and n_tokens of every row."""
    return encode(documents, tokenizer, directory).select("doc_id", F.size("ids").alias("n_tokens"))
