"""Byte-level BPE: pre-tokenisation by associative scans, cached pair merging, decoding by offsets.

Pre-tokenisation needs no regular expression. Every code point is mapped to a class by an array
lookup; classes and one or two places of look-ahead give each position a symbol. A symbol acts on
the scanner's states as a transition function. Functions compose associatively and only a few dozen
different ones arise, so they are numbered, composition is a lookup in a table, and a blocked prefix
scan finds the state before every position of a batch of texts at once. State and symbol together
tell whether a token starts there.

Null text counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import slices, small_batches

# Classes of code points.
LETTER, NUMBER, OTHER, BLANK, SPACE, END = range(6)
#: Stands between two texts; one above the last code point.
SENTINEL = 0x110000
SENTINEL_BYTES = (SENTINEL).to_bytes(4, "little")

# Symbols: a class, with what follows. MARK2 and MARK3 are apostrophes before one and two letters of a
# contraction; RUN is white space before more of it or the end, LAST_* the last of a run before other text.
S_LETTER, S_NUMBER, S_OTHER, S_MARK2, S_MARK3, S_RUN, S_LAST_BLANK, S_LAST_SPACE, S_END = range(9)
# States after a position.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ATTACHED, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, and of the sentinel."""
    out = np.full(SENTINEL + 1, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, SENTINEL))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            shift = [0 if m.start() < 0xD800 else 0x800, 0 if m.end() - 1 < 0xD800 else 0x800]
            out[m.start() + shift[0] : m.end() + shift[1]] = kind
    out[0x20], out[SENTINEL] = SPACE, END
    return out


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after symbol, and whether a token starts at it."""
    if symbol == S_END:
        return FRESH, True
    if symbol == S_RUN:
        return IN_BLANKS, state != IN_BLANKS
    if symbol == S_LAST_BLANK:
        return FRESH, True
    if symbol == S_LAST_SPACE:
        return ATTACHED, True
    if symbol == S_LETTER:
        if state in (TWO_LEFT, ONE_LEFT):
            return {TWO_LEFT: ONE_LEFT, ONE_LEFT: FRESH}[state], False
        return IN_LETTERS, state not in (IN_LETTERS, ATTACHED)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, ATTACHED)
    if state in (IN_OTHERS, ATTACHED):
        return IN_OTHERS, False
    return {S_MARK2: ONE_LEFT, S_MARK3: TWO_LEFT}.get(symbol, IN_OTHERS), True


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Number of each symbol's function, composition table, each function's images, starts, number of the identity."""
    symbols = [tuple(step(q, s)[0] for q in range(8)) for s in range(9)]
    found = {tuple(range(8)): 0}
    queue = list(found)
    while queue:
        f = queue.pop()
        for g in symbols:
            if (h := tuple(g[q] for q in f)) not in found:
                found[h] = len(found)
                queue.append(h)
    images = np.array(list(found), np.int64)
    compose = np.array([[found[tuple(g[f])] for g in images] for f in images], np.int32)
    starts = np.array([[step(q, s)[1] for s in range(9)] for q in range(8)])
    return np.array([found[s] for s in symbols], np.int32), compose, images.astype(np.int32), starts, 0


def symbols_of(points: np.ndarray) -> np.ndarray:
    kinds = classes()[points]
    after = np.append(kinds[1:], np.uint8(END))
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_LAST_BLANK, S_LAST_SPACE, S_END], np.int32)[kinds]
    out[((kinds == BLANK) | (kinds == SPACE)) & (after >= BLANK)] = S_RUN
    marks = np.flatnonzero(points == ord("'"))
    if marks.size:
        padded = np.append(points, [SENTINEL] * 2)
        one, two = padded[marks + 1], padded[marks + 2]
        out[marks[np.isin(one, [ord(c) for c in "stmd"])]] = S_MARK2
        pair = np.zeros(marks.size, bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        out[marks[pair]] = S_MARK3
    return out


def prefix_functions(functions: np.ndarray, block: int = 64) -> np.ndarray:
    """The inclusive prefix compositions of the functions, by an associative scan in blocks."""
    _, compose, _, _, identity = machine()
    kinds, flat = len(compose), compose.ravel()
    n = len(functions)
    rows = -(-n // block)
    grid = np.full(rows * block, identity, np.int32)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for j in range(1, block):
        grid[j] = flat[grid[j - 1] * kinds + grid[j]]
    if rows > 1:
        before = prefix_functions(grid[-1], block)[:-1]
        grid[:, 1:] = flat[before * kinds + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """True at each position of the code points at which a token starts; texts are parted by sentinels."""
    if not points.size:
        return np.zeros(0, bool)
    numbers, _, images, starts, _ = machine()
    symbols = symbols_of(points)
    state = images[:, FRESH][prefix_functions(numbers[symbols])]
    before = np.concatenate(([FRESH], state[:-1]))
    return starts.ravel()[before * starts.shape[1] + symbols]


def pieces(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text."""
    points = np.frombuffer(SENTINEL_BYTES.join([t.encode("utf-32-le") for t in texts]), "<u4")
    whole = "\0".join(texts)
    begin = np.flatnonzero(boundaries(points))
    end = np.append(begin[1:], len(points))
    out, lengths = [], np.array([len(t) for t in texts])
    first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    lo, hi = np.searchsorted(begin, first), np.searchsorted(begin, first + lengths)
    begin, end = begin.tolist(), end.tolist()
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        out.append([whole[i:j] for i, j in zip(begin[a:b], end[a:b], strict=True)])
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: again and again the pair of lowest rank, leftmost first, is joined."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 100:
        rank, none = ranks.get, len(ranks) * 2
        edges = list(range(n + 1))  # the places between parts; costs[i] is the rank of joining the parts around edges[i + 1]
        costs = [rank(piece[i : i + 2], none) for i in range(n - 1)]
        while costs:
            low = min(costs)
            if low == none:
                break
            at = costs.index(low)
            del edges[at + 1], costs[at]
            if at < len(costs):
                costs[at] = rank(piece[edges[at] : edges[at + 2]], none)
            if at:
                costs[at - 1] = rank(piece[edges[at - 1] : edges[at + 1]], none)
        return [ranks[piece[i:j]] for i, j in zip(edges, edges[1:])]
    # A long piece: pairs in a heap, parts in a doubly linked list.
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Pairs:
    """The rank of joining two tokens, by their ids: an open-addressed table that is looked up for whole arrays.

    Holds each split of each token into two tokens, since a pair joins whenever its bytes together are a token.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.shift = np.uint64(64 - max(4, len(keys).bit_length() + 2))
        self.keys = np.full(1 << 64 - int(self.shift), -1, np.int64)
        self.values = np.full(len(self.keys), self.NONE, np.int32)
        todo, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self.slots(todo)
        while todo.size:  # of those that want a free slot one gets it, the others go on to the next
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = todo[won], value[won]
            left = np.ones(todo.size, bool)
            left[won] = False
            todo, value, slot = todo[left], value[left], (slot[left] + 1) % len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self.slots(keys)
        out = np.full(keys.shape, self.NONE)
        todo = np.flatnonzero(self.keys[slot] != -1)
        while todo.size:
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
            slot[todo] = (slot[todo] + 1) % len(self.keys)
        return out


def merge_many(found: list[bytes], single: np.ndarray, pairs: Pairs) -> list[bytes]:
    """merge() of pieces of two bytes or more, none of them a token, side by side: the ids of each as bytes."""
    sizes = np.array([len(p) for p in found])
    width, m = int(sizes.max()), len(found)
    inside = np.arange(width) < sizes[:, None]
    ids = np.zeros((m, width), np.int32)
    ids[inside] = single[np.frombuffer(b"".join(found), np.uint8)]
    costs = np.full((m, width), Pairs.NONE)
    both = inside[:, 1:]
    costs[:, :-1][both] = pairs.rank(ids[:, :-1][both], ids[:, 1:][both])
    done, rows, columns, count = np.zeros((m, width), np.int32), np.arange(m), np.arange(width), sizes.copy()
    while rows.size:
        every = np.arange(rows.size)
        at = costs.argmin(1)
        low = costs[every, at]
        if (over := low == Pairs.NONE).any():
            done[rows[over]] = ids[over]
            go = ~over
            rows, ids, costs, at, low, sizes = rows[go], ids[go], costs[go], at[go], low[go], sizes[go]
            every = np.arange(rows.size)
            if not rows.size:
                break
        ids[every, at] = low  # a token's id is its rank
        sizes = sizes - 1
        after = np.minimum(columns + (columns > at[:, None]), width - 1)
        ids, costs = np.take_along_axis(ids, after, 1), np.take_along_axis(costs, np.minimum(columns + (columns >= at[:, None]), width - 1), 1)
        costs[:, -1] = Pairs.NONE
        ends = at + 1 < sizes
        costs[every, at] = Pairs.NONE
        costs[every[ends], at[ends]] = pairs.rank(ids[every[ends], at[ends]], ids[every[ends], at[ends] + 1])
        starts = at > 0
        costs[every[starts], at[starts] - 1] = pairs.rank(ids[every[starts], at[starts] - 1], ids[every[starts], at[starts]])
        count[rows] = sizes
    return [row[:n].tobytes() for row, n in zip(done.astype("<u4"), count.tolist(), strict=True)]


class ByteBpe:
    """Encodes and decodes by a file of ranks (base64 token and rank on each line).

    The cache of merged pre-tokens is emptied when it holds max_cached of them; that bounds memory
    and never changes a result.
    """

    def __init__(self, path: str, max_cached: int = 400_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.cache, self.max_cached, self.pairs = {}, max_cached, Pairs(self.ranks)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def learn(self, new: set[str]) -> None:
        """Puts the ids of pre-tokens into the cache."""
        short = []
        for piece in new:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= 24:
                short.append((len(raw), piece, raw))
            else:
                self.cache[piece] = np.array(merge(raw, self.ranks), "<u4").tobytes()
        short.sort()  # so that pieces of about one length are merged together
        for i in range(0, len(short), 8192):
            some = short[i : i + 8192]
            self.cache.update(zip([x[1] for x in some], merge_many([x[2] for x in some], self.single, self.pairs), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > self.max_cached:
            self.cache.clear()
        found = pieces(texts)
        known = self.cache.get
        ids = [list(map(known, own)) for own in found]
        late = [i for i, own in enumerate(ids) if None in own]
        if late:
            self.learn({piece for i in late for piece, x in zip(found[i], ids[i], strict=True) if x is None})
            for i in late:
                ids[i] = list(map(known, found[i]))
        return [np.frombuffer(b"".join(own), "<u4") for own in ids]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token starts, and the end."""
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        offsets = self.offsets(ids) if offsets is None else offsets
        shift = np.repeat(self.places[ids] - offsets[:-1], np.diff(offsets))
        return self.blob[shift + np.arange(offsets[-1])].tobytes()


@lru_cache(2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, ids (binary, little-endian unsigned 32-bit), offsets (binary, likewise: each
    token's first byte, then the end) and decoded (binary: the bytes that the ids and offsets give).

    Rows are independent: no shuffle. Repeated rows come out as often as they go in; a null id stays null.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches, text_col):
            found = bpe.encode([t or "" for t in batch.column(text_col).to_pylist()])
            places = [bpe.offsets(ids) for ids in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array([ids.tobytes() for ids in found], pa.binary()),
                    pa.array([p.astype("<u4").tobytes() for p in places], pa.binary()),
                    pa.array([bpe.decode(i, p) for i, p in zip(found, places, strict=True)], pa.binary()),
                ],
                names=[id_col, "ids", "offsets", "decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, offsets binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """Of encode_documents(): doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
