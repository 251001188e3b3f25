"""Near-duplicates by MinHash with sequential Bayesian verification.

1. One pass over the texts: words, 64-bit hashes of the distinct shingles, their MinHash signature, and a key
   per band. Texts of equal words are one node from here on (the least doc_id stands for them).
2. Nodes that share a band's key (a bucket) are candidates. First each node is compared with one representative only: of
   the least nodes of its buckets, that of most of them. That joins most of a large group of copies at once.
3. Then all pairs of a bucket that are not joined yet are compared. Large buckets are cut into blocks, and blocks are
   compared two by two, so that the work is spread; only signatures travel there, and not among what is joined. They are compared
   batch by batch; after each, pairs whose posterior probability of the wanted similarity is below the miss
   probability are dropped. The sets of what survives are fetched, and verify it in full.
4. Components of the links.

With 24 bands of 5 rows a pair at a similarity of 0.85 shares no band with probability 8e-7; the miss probability of the
Bayesian test is a parameter (1e-6 a pair). Both shrink fast above the threshold. Shingles are compared by
64-bit hashes; documents of equal words by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from orrery.llm.common import slices, small_batches, written
from orrery.operators.components import connected_components

BANDS, ROWS, SHINGLE = 24, 5, 5
SIZE = BANDS * ROWS
#: Nodes of a block of a bucket, on average; salts over which the rows of a key are dealt.
BLOCK, SALTS = 256, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    return rng.integers(0, 2**32, SIZE, np.uint32) | np.uint32(1), rng.integers(0, 2**32, SIZE, np.uint32)


class Words(dict):
    """Word -> 64-bit hash; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_words = Words()


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of `size` words; of the whole sequence, if it is shorter; none without words."""
    if len(_words) > 1_000_000:
        _words.clear()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _ODD
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of SIZE permutations of 32-bit integers over the set."""
    a, b = _parameters()
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIZE, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 256):
        out = np.minimum(out, (a[:, None] * x[i : i + 256] + b[:, None]).min(1))
    return out


def band_key(sig: np.ndarray, k: int) -> int:
    return xxhash.xxh64_intdigest(sig[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) - (1 << 63)


def band_keys(sig: np.ndarray) -> list[int]:
    return [band_key(sig, k) for k in range(BANDS)]


def tail(matches: int, n: int, threshold: float) -> float:
    """The posterior probability of a similarity of at least threshold after so many matches of n, from a uniform prior:
    the upper tail of Beta(matches + 1, n - matches + 1), as a binomial sum."""
    return sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(matches + 1))


@lru_cache(8)
def least_matches(threshold: float, miss: float, batch: int) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on) after each batch."""
    return [(n, next(m for m in range(n + 1) if tail(m, n, threshold) >= miss)) for n in range(batch, SIZE + 1, batch)]


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def passing(mine: np.ndarray, theirs: np.ndarray, threshold: float, miss: float, batch: int = 24) -> np.ndarray:
    """Places of the rows whose pair of signatures survives every batch of the sequential test."""
    at, same, done = np.arange(len(mine)), np.zeros(len(mine), np.int64), 0
    for n, need in least_matches(threshold, miss, batch):
        same += (mine[at, done:n] == theirs[at, done:n]).sum(1)
        go = same >= need
        at, same, done = at[go], same[go], n
    return at


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted, distinct) have a similarity of at least percent / 100."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def describe(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, print (128-bit hash of its words; null without any) and keys of its bands."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, prints, keys, known = [], [], [], {}
            for text in batch.column("text").to_pylist():
                words = words_of(text or "")
                mark = hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None
                if mark not in known:
                    found = shingles(words)
                    known[mark] = (len(found), band_keys(signature(found)) if words else None)
                sizes.append(known[mark][0])
                prints.append(mark)
                keys.append(known[mark][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "print", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, print binary, keys array<long>")


def spread_join(left: DataFrame, keys: list[str], right: DataFrame, salted_by: str) -> DataFrame:
    """left joined with right (one row to the keys), where some keys may have very many rows of left: these are dealt over salts,
    and right's row goes to the salts that occur."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(salted_by), F.lit(SALTS)).cast("int"))
    return dealt.join(dealt.select(*keys, "_salt").distinct().join(right, keys), [*keys, "_salt"]).drop("_salt")


def arrays(batch: pa.RecordBatch, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]


def features_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, sig and hashes (binary) of the documents whose doc_id is in nodes (node)."""
    # By sorting and merging at every size: the nodes' table grows with the corpus and is never broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.hint("merge"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(words_of(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([signature(x).tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "sig", "hashes"])

    return texts.mapInArrow(run, "node long, sig binary, hashes binary")


def parts_of(spark: SparkSession) -> int:
    """A number of partitions that is asked for by name, so that small ones that take long are not put together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def star_links(stars: DataFrame, features: DataFrame, percent: int, miss: float) -> DataFrame:
    """stars (first, node): the pairs that are linked, as (src, dst). Members come to their first one's features salt by salt, and
    pass by it a batch at a time."""
    stars = stars.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    member = stars.join(features, "node").select("first", "salt", F.lit(1).alias("side"), "node", "sig", "hashes")
    heads = stars.select("first", "salt").distinct().join(features.withColumnRenamed("node", "first"), "first").select("first", "salt", F.lit(0).alias("side"), F.col("first").alias("node"), "sig", "hashes")
    dealt = heads.unionByName(member).repartition(parts_of(stars.sparkSession), "first", "salt").sortWithinPartitions("first", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            first, salt, side, node = (batch.column(c).to_numpy() for c in ("first", "salt", "side", "node"))
            sigs, sets, out = np.array(arrays(batch, "sig", np.uint32)), arrays(batch, "hashes", np.uint64), []
            cuts = [0, *(np.flatnonzero((first[1:] != first[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), len(first)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if (first[i], salt[i]) != at:
                    at, heads = (first[i], salt[i]), []
                k = i + int((side[i:j] == 0).sum())
                heads += [(sigs[m].copy(), sets[m].copy()) for m in range(i, k)]
                for sig, own in heads:
                    for m in (k + passing(sigs[k:j], np.broadcast_to(sig, (j - k, SIZE)), percent / 100, miss)).tolist():
                        if linked(own, sets[m], percent):
                            out.append((int(first[m]), int(node[m])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["src", "dst"])

    return dealt.mapInArrow(run, "src long, dst long")


#: A pair of blocks of a bucket.
MEETING = ["key", "one", "two"]


def met_blocks(members: DataFrame) -> DataFrame:
    """members (key, node, label), as often as their block meets another one of its key: key, one, two, block, node, label.

    Members of a label of BLOCK members or more have blocks of their own, which never meet one another, since they
    are joined; members of smaller labels share blocks. So what is compared is what is not yet joined.
    """
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("pool", F.sum(F.when(F.col("n") < BLOCK, F.col("n"))).over(W.partitionBy("key")))
    own = F.when(F.col("n") >= BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(F.ceil(F.col("pool") / BLOCK)).cast("int")
    sizes = sizes.select("key", "label", own.alias("blocks"), (F.col("n") >= BLOCK).alias("large"))
    name = lambda label, i: F.concat_ws(":", label, i.cast("string"))
    of = F.when(F.col("large"), F.col("label").cast("string")).otherwise(F.lit("few"))
    listed = sizes.select("key", of.alias("of"), "blocks").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "of", name(F.col("of"), F.col("i")).alias("block"))
    one, two = listed.select("key", F.col("of").alias("of_one"), F.col("block").alias("one")), listed.select("key", F.col("of").alias("of_two"), F.col("block").alias("two"))
    pairs = one.join(two, "key").where((F.col("one") <= F.col("two")) & ((F.col("of_one") != F.col("of_two")) | (F.col("of_one") == "few"))).select(*MEETING)
    meets = pairs.select(*MEETING, F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    nth = F.when(F.col("large"), F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("label"), F.col("blocks")))
    placed = spread_join(members, ["key", "label"], sizes, "node").select("key", "node", "label", name(of, nth).alias("block"))
    return placed.join(meets, ["key", "block"]).select(*MEETING, "block", "node", "label")


def meetings(rows: DataFrame, each, columns: list[str], schema: str) -> DataFrame:
    """each(key, one, two, rows of the meeting with the columns) for every pair of blocks, its batches as one table."""
    dealt = rows.select(*MEETING, *columns).repartition(parts_of(rows.sparkSession), *MEETING).sortWithinPartitions(*MEETING)

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in (*MEETING, *columns)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for meeting, own in groupby(tuples(batches), key=lambda r: r[:3]):
            if (out := each(*meeting, [r[3:] for r in own])) is not None:
                yield out

    return dealt.mapInArrow(run, schema)


def candidates(key: int, one: str, two: str, block: list[str], node: np.ndarray, label: np.ndarray, sig: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of the two blocks that have different labels and survive the test. Pairs that share several bands
    belong to the first of them."""
    side = np.array([b == one for b in block])
    left = np.flatnonzero(side)
    right = left if one == two else np.flatnonzero(~side)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for some in np.array_split(left, max(1, len(left) // 64)):
        differ = label[some][:, None] != label[right]
        if one == two:
            differ &= node[some][:, None] < node[right]
        i, j = np.nonzero(differ)
        i, j = some[i], right[j]
        ok = passing(sig[i], sig[j], percent / 100, miss)
        i, j = i[ok], j[ok]
        shared = (sig[i] == sig[j]).reshape(len(i), BANDS, ROWS).all(2)
        first = np.where(shared.any(1), shared.argmax(1), -1) if len(i) else i  # none, if the key is that of another text of the document
        here = np.fromiter((k < 0 or band_key(sig[x], k) == key for x, k in zip(i.tolist(), first.tolist(), strict=True)), bool, len(i))
        found.append((i[here], j[here]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def survivors(members: DataFrame, features: DataFrame, percent: int, miss: float) -> DataFrame:
    """members (key, node, label): what of them has a pair, with another label, that survives the test of signatures, as
    (key, one, two, block, node, label)."""

    def each(key: int, one: str, two: str, own: list[tuple]) -> pa.RecordBatch | None:
        block, node, label, sig = zip(*own, strict=True)
        i, j = candidates(key, one, two, block, np.array(node), np.array(label), np.array([np.frombuffer(x, np.uint32) for x in sig]), percent, miss)
        some = np.unique(np.concatenate((i, j))).tolist()
        if not some:
            return None
        columns = [[key] * len(some), [one] * len(some), [two] * len(some), *([x[k] for k in some] for x in (block, node, label))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[*MEETING, "block", "node", "label"])

    rows = met_blocks(members).join(features.select("node", "sig"), "node")
    return meetings(rows, each, ["block", "node", "label", "sig"], "key long, one string, two string, block string, node long, label long")


def confirmed(found: DataFrame, features: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (src, dst) between labels: the pairs of survivors that their full sets confirm. Likely ones come first, and
    pairs whose labels a meeting has joined already are left out."""

    def each(key: int, one: str, two: str, own: list[tuple]) -> pa.RecordBatch | None:
        block, node, label, sig, hashes = zip(*own, strict=True)
        sig, sets = np.array([np.frombuffer(x, np.uint32) for x in sig]), [np.frombuffer(x, np.uint64) for x in hashes]
        i, j = candidates(key, one, two, block, np.array(node), np.array(label), sig, percent, miss)
        forest, out = Forest(), []
        same = np.concatenate([(sig[a] == sig[b]).sum(1) for a, b in zip(np.array_split(i, len(i) // 4096 + 1), np.array_split(j, len(j) // 4096 + 1), strict=True)])
        for k in np.argsort(-same, kind="stable").tolist():
            a, b = int(i[k]), int(j[k])
            if forest.find(label[a]) != forest.find(label[b]) and linked(sets[a], sets[b], percent):
                forest.join(label[a], label[b])
                out.append((label[a], label[b]))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["src", "dst"]) if out else None

    return meetings(found.join(features, "node"), each, ["block", "node", "label", "sig", "hashes"], "src long, dst long")


def components_of(docs: DataFrame, nodes: DataFrame, bands: DataFrame, percent: int, miss: float) -> DataFrame:
    """(node, component) of nodes that links join. bands: (node, key), nodes that share a key being candidates."""
    counts = bands.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = written(spread_join(bands, ["key"], counts, "node").select("key", "node", "first"), "shared")
    features = written(features_of(docs, shared.select("node").distinct()), "features")
    # Of the least nodes of its buckets, each node is compared with that of most of them.
    firsts = shared.where(F.col("node") != F.col("first")).groupBy("node", "first").count()
    stars = firsts.groupBy("node").agg(F.min(F.struct((-F.col("count")).alias("n"), "first")).alias("x")).select("node", F.col("x.first").alias("first"))
    links = written(star_links(stars, features, percent, miss), "links")
    # Rows of one doc_id and several texts are one document.
    several = nodes.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("doc_id", "lo")
    again = nodes.select("doc_id", "node").join(several, "doc_id").where("lo < node").select(F.col("lo").alias("src"), F.col("node").alias("dst"))
    labels = written(connected_components(links.union(again)).withColumnRenamed("component", "label"), "labels")
    # What shares a bucket and is not yet joined is compared, all with all.
    labelled = shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    found = written(survivors(spread_join(labelled, ["key"], mixed, "node"), features, percent, miss), "survivors")
    late = written(connected_components(confirmed(found, features, percent, miss)).select(F.col("node").alias("label"), "component"), "late")
    every = labels.select("node", "label").union(late.select("label", "label")).distinct()
    return every.join(late, "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (it is that document).

    Null and empty texts have no shingles and no links. Rows that share a doc_id count as one document where texts are
    compared: what one of them is linked with, all are. A row without a doc_id takes no part: its component is null and it is kept.
    """
    return _components(docs, percent, miss)[1]


def _components(docs: DataFrame, percent: int, miss: float) -> tuple[DataFrame, DataFrame]:
    found = written(describe(docs), "described")
    known = found.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    least = written(known.groupBy("print").agg(F.min("doc_id").alias("node")), "nodes")
    # One row of keys to a node: the rows whose doc_id stands for their print.
    own = known.join(least.withColumnRenamed("node", "doc_id"), ["print", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    named = spread_join(known.select("doc_id", "print"), ["print"], least, "doc_id").select("doc_id", "node")
    joined = components_of(docs, named, own.dropDuplicates(["node", "key"]), percent, miss)
    labels = least.join(joined, "node", "left").select("print", F.coalesce("component", "node").alias("label"))
    rows = found.select("doc_id", "n_shingles", "print")
    takes_part = F.col("print").isNotNull() & F.col("doc_id").isNotNull()
    out = spread_join(rows.where(takes_part), ["print"], labels, "doc_id").select("doc_id", "n_shingles", "label")
    out = out.unionByName(rows.where(~takes_part).select("doc_id", "n_shingles", F.col("doc_id").alias("label")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("label"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found, out


def drop_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """The documents, with the columns that they have, less those that a smaller doc_id of their component stands for. Of rows
    that share a doc_id one stays, the one whose columns sort first by their hash; rows without a doc_id all stay."""
    found, marks = _components(docs, percent, miss)
    gone = marks.where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    twice = kept.join(repeated, "doc_id", "left_semi").select(row.alias("row"))
    one = twice.groupBy("row.doc_id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
