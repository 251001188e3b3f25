"""Language by cross-parsing: the language whose labelled text parses a text into fewest phrases.

For each language a suffix automaton of a sample of its labelled text is built. A text is parsed greedily
into longest phrases that occur in the sample: as long as the automaton has a transition the phrase
goes on, otherwise it ends and the next one starts. The number of phrases over the text's length
estimates the cross entropy; the language with the lowest number wins.

A text is folded before: lower case, letters kept, all else one blank. Whole texts are parsed: segments of
SEGMENT letters in step at first, each as if a phrase started with it. Then every segment is parsed again from the state in
which the one before it ended, until a phrase starts where one started before, from where on both
parses are the same. That gives the phrases of the whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import slices, small_batches

SEGMENT = 256
#: Text that has no letters, or none at all.
UNKNOWN = "und"
PAD, BLANK = 0, 1
#: So many of the most frequent letters have a column of the table; transitions on the others are listed.
DENSE = 200


@lru_cache(1)
def folded() -> np.ndarray:
    """Of each code point: the lower-case letter's code point, or a blank."""
    import regex

    out = np.full(0x110000, 32, np.uint32)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for m in regex.finditer(r"\p{L}", every):
        low = m[0].lower()
        out[ord(m[0])] = ord(low) if len(low) == 1 else ord(m[0])
    return out


def fold(text: str) -> np.ndarray:
    """The folded text as code points: one blank between words, none at the ends."""
    points = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = points == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    points = points[keep]
    if points.size and points[0] == 32:
        points = points[1:]
    return points[:-1] if points.size and points[-1] == 32 else points


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of codes; state 0 is the start."""
    moves, link, longest, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def transitions(moves: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State, code and next state of each transition."""
    states = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
    codes = np.fromiter((c for m in moves for c in m), np.int64, len(states))
    return states, codes, np.fromiter((q for m in moves for q in m.values()), np.int64, len(states))


def parser(moves: list[dict[int, int]], symbols: int) -> np.ndarray:
    """The automaton as one table: at (state * symbols + code), twice the next state's row, plus 1 if a phrase starts there.
    Codes from symbols - 1 on are left out; that column is a code without transitions."""
    table = np.zeros((len(moves), symbols), np.int32)
    start = np.zeros(symbols, np.int32)
    for c, q in moves[0].items():
        if c < symbols - 1:
            start[c] = q
    table[:] = start * symbols * 2 + 1  # no transition: a new phrase, with this code as its first
    states, codes, nexts = transitions(moves)
    near = codes < symbols - 1
    table[states[near], codes[near]] = nexts[near] * symbols * 2
    table[0] = start * symbols * 2 + 1  # from the start every code starts a phrase
    table[:, PAD] = np.arange(len(moves)) * symbols * 2  # beyond a segment's end nothing happens
    return table.ravel()


class Rare:
    """The transitions on codes above the dense ones, as sorted keys (state * symbols + code)."""

    def __init__(self, moves: list[dict[int, int]], dense: int, symbols: int):
        states, codes, nexts = transitions(moves)
        far = codes > dense
        self.start = np.zeros(symbols, np.int64)
        self.start[codes[far & (states == 0)]] = nexts[far & (states == 0)]
        own = np.flatnonzero(far & (states > 0))  # from the start every code starts a phrase
        keys = states[own] * symbols + codes[own]
        order = np.argsort(keys)
        self.keys, self.nexts, self.symbols = np.append(keys[order], -1), np.append(nexts[own][order], 0), symbols

    def moves(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Twice the next state, plus 1 if a phrase starts there."""
        key = state.astype(np.int64) * self.symbols + code
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.nexts[at] * 2, self.start[code] * 2 + 1)


class CrossParser:
    """alphabet: all code points of the samples, with codes by frequency; every other one has the last code, which no automaton knows."""

    def __init__(self, samples: dict[str, list[str]], letters: int = 30_000):
        """samples: labelled texts of each language, of which the first `letters` folded letters are learned."""
        learned = {}
        for lang, texts in sorted(samples.items()):
            parts, held = [], 0
            for points in map(fold, texts):
                parts += [points[: letters - held], np.array([32], np.uint32)]
                if (held := held + len(points)) >= letters:
                    break
            learned[lang] = np.concatenate([*parts, np.zeros(0, np.uint32)])
        points, counts = np.unique(np.concatenate([*learned.values(), np.array([32], np.uint32)]), return_counts=True)
        self.alphabet, self.rank = points, np.empty(len(points), np.int64)
        self.rank[np.argsort(-counts, kind="stable")] = np.arange(1, len(points) + 1)
        self.symbols, self.dense = len(points) + 2, min(len(points), DENSE)
        self.langs = [lang for lang, x in learned.items() if len(x) > 1]
        self.learned = [len(learned[lang]) for lang in self.langs]
        self.moves = [automaton(self.codes(learned[lang]).tolist()) for lang in self.langs]
        self.tables: list[np.ndarray] = []
        self.rare: list[Rare] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": [], "rare": []}  # the tables are made where they are used

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, self.rank[at], self.symbols - 1).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each folded text (rows) by each language (columns)."""
        if not self.tables:
            self.tables = [parser(m, self.dense + 2) for m in self.moves]
            self.rare = [Rare(m, self.dense, self.symbols) for m in self.moves]
        lengths = np.array([len(t) for t in texts], np.int64)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not owner.size:
            return out
        grid = np.zeros((len(owner), SEGMENT), np.int32)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        filled = np.minimum(SEGMENT, lengths[owner] - nth * SEGMENT)
        grid[np.arange(SEGMENT) < filled[:, None]] = self.codes(np.concatenate(texts))
        order = np.argsort(-filled, kind="stable")
        seat = np.empty(len(order), np.int64)  # of each segment in this order
        seat[order] = np.arange(len(order))
        later = np.flatnonzero(nth > 0)
        sizes = filled[order]
        grid = np.ascontiguousarray(grid[order].T)
        dense = np.minimum(grid, self.dense + 1)
        active = np.searchsorted(-sizes, -np.arange(SEGMENT), "left")  # segments longer than each place
        for k in range(len(self.langs)):
            starts = np.zeros(grid.shape, bool)  # of phrases
            state = np.zeros(len(owner), np.int32)
            for j in range(SEGMENT):
                if not (n := active[j]):
                    break
                move = self.step(k, state[:n], dense[j, :n], grid[j, :n])
                starts[j, :n], state[:n] = move & 1, move >> 1
            count = starts.sum(0, dtype=np.int64)
            ended, todo = state.copy(), later
            while todo.size:  # segments whose predecessor's end is known anew
                own, entered = seat[todo], ended[seat[todo - 1]]
                total, after, going = starts[:, own].sum(0, dtype=np.int64), state[own], np.arange(len(own))
                now = entered
                for j in range(SEGMENT):
                    going = going[sizes[own[going]] > j]
                    if not going.size:
                        break
                    move = self.step(k, now[going], dense[j, own[going]], grid[j, own[going]])
                    new, old = (move & 1).astype(bool), starts[j, own[going]]
                    total[going] += new.astype(np.int64) - old
                    now[going] = after[going] = move >> 1
                    same = new & old
                    after[going[same]] = state[own[going[same]]]
                    going = going[~same]
                count[own] = total
                changed = after != ended[own]
                ended[own] = after
                follow = todo[changed] + 1
                follow = follow[follow < len(owner)]
                todo = follow[nth[follow] > 0]
            out[:, k] = np.bincount(owner[order], count, len(texts))
        return out

    def step(self, k: int, state: np.ndarray, near: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Twice the next state's row in language k's table, plus 1 where a phrase starts; near: codes, those without columns as one."""
        move = self.tables[k][state + near]
        if self.symbols > self.dense + 2:
            far = np.flatnonzero((code > self.dense) & (code < self.symbols - 1))
            if far.size:
                width = self.dense + 2
                found = self.rare[k].moves(state[far] // width, code[far])
                move[far] = (found >> 1) * width * 2 + (found & 1)
        return move

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text. The score is the winner's share of exp(-20 x phrases per letter);
        ties go to the language that sorts first."""
        points = [fold(t or "") for t in texts]
        counts = self.phrases(points)
        langs, scores = [], []
        for own, row in zip(points, counts, strict=True):
            if not len(own) or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(row.argmin())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(-20.0 / len(own) * (row - row[best])).sum()))
        return langs, scores

    def acceptable(self, texts: list[str | None], letters: int = 50, most: float = 0.5, learned: int = 5_000) -> list[bool]:
        """Whether each text has letters, and may be in a learned language. It is in none if it has so many letters or more and
        even the winner needs more than `most` phrases a letter (random letters need 0.7, texts in their language 0.1 to 0.25),
        unless the winner has learned fewer than `learned` letters, too few to rule a text out. Without languages, no text is."""
        points = [fold(t or "") for t in texts]
        if not self.langs:
            return [len(own) > 0 for own in points]
        counts = self.phrases(points)
        return [len(own) > 0 and not (len(own) >= letters and row.min() > most * len(own) and self.learned[int(row.argmin())] >= learned) for own, row in zip(points, counts, strict=True)]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 == 1


def is_held_out(column: str = "doc_id"):
    """The same as a column: whether crc32(id as text) mod 3 is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, per_lang: int = 60, letters: int = 30_000) -> CrossParser:
    """Learns from text and non-null lang of documents that are not held out.

    The sample is bounded: about 2 x per_lang different texts of each language, drawn by a hash of the text (all of
    them, where a language has no more), at most 4 x letters characters of each, and of them `letters` letters a language. So neither
    repeated rows nor repeated or null ids can crowd a language out. Languages are taken to be few; more
    than 10,000 different labels are an error.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out()).select(F.col("lang").cast("string").alias("lang"), "text")
    labelled = labelled.select("lang", "text", F.xxhash64("text", F.lit("sample")).alias("mark"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).limit(10_001).collect()}
    if len(counts) > 10_000:
        raise ValueError("lang has more than 10,000 different values: these are no languages")
    if not counts:
        return CrossParser({})
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(1.0 if n <= 3 * per_lang else 2 * per_lang / n))])
    draw = F.pmod("mark", F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(draw <= share[F.col("lang")]).select("lang", "mark", F.substring("text", 1, 4 * letters).alias("text")).dropDuplicates(["lang", "mark"])
    samples: dict[str, list[str]] = {}
    for r in chosen.orderBy("mark").collect():  # at most some 4 x per_lang texts of each language
        samples.setdefault(r["lang"], []).append(r["text"])
    return CrossParser(samples, letters)


def identify(docs: DataFrame, model: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, repeated ones too: its id, lang_pred and score. Only the text is looked at, all of it, however long; null text and
    text without letters give 'und' with score 0, and so does every text if no language was learned. Ties go to the
    language that sorts first. Other columns are not read. Rows are independent: no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by languages x letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4_000_000):
            langs, scores = shared.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: CrossParser) -> DataFrame:
    """The documents, with the columns that they have, whose text can be in a learned language: null texts, texts without
    letters and texts that no learned language explains go (CrossParser.acceptable). Without labels to learn from, only texts
    without letters go. Repeated rows are kept or go together."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            yield batch.filter(pa.array(shared.value.acceptable(batch.column("text").to_pylist())))

    return docs.mapInArrow(run, docs.schema)
