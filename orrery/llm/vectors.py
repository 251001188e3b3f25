"""What the two vector searches share: usable vectors, equal vectors as one class, search in blocks, the answer per row.

Equal vectors have equal scores, so a class of them needs only its TOP + 1 least ids, however many rows it has: a
query is one of the class's rows at most, and TOP others answer it. Queries with equal vectors are
searched once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.llm.common import small_batches, written

#: Salts over which a class's rows are dealt before its least ids are taken.
SALTS = 16


def usable(rows: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, vector) of rows with an id whose vector has components, all of them finite numbers. Vectors of different
    lengths have no inner product: each is compared with those of its own length."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    return out.where(F.exists("vector", lambda x: x != 0)) if nonzero else out


def class_keys(vector: Column) -> list[Column]:
    """Two hashes that tell vectors apart."""
    return [F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit(1), vector).alias("k2")]


def classes(rows: DataFrame, top: int) -> DataFrame:
    """Per different vector: k1, k2, vector, ids (the top + 1 least, ascending). Ranked first among a salt's rows, where
    Spark limits each task's rows before the shuffle, then among the salts' least."""
    keyed = rows.select("vec_id", "vector", *class_keys(F.col("vector")), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    few = keyed.withColumn("r", F.dense_rank().over(W.partitionBy("k1", "k2", "salt").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    few = few.withColumn("r", F.dense_rank().over(W.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    return few.groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


#: (rows, least id of each row) -> an index; the index of queries -> query, place of a row, and score, of each query's best rows.
Index = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
Kernel = Callable[[np.ndarray, np.ndarray], Index]


def matrix_of(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def search_blocks(rows: DataFrame, queries: DataFrame, kernel: Kernel, score: str, blocks: int) -> DataFrame:
    """rows (block, vector, ids) and queries (block, k1, k2, vector), each query once for every block that it is to be
    compared with; vectors of a block have one length. Per query and row that the kernel returns: k1, k2, score, ids.

    A task holds one block's rows and their index, made once; the block's queries, however many they are, pass
    by a batch at a time. The number of partitions is given, so that small blocks that take long are not put together.
    """
    small_batches(rows.sparkSession)
    left = rows.select("block", F.lit(0).alias("side"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "vector", "ids")
    right = queries.select("block", F.lit(1).alias("side"), "k1", "k2", "vector", F.array().cast("array<long>").alias("ids"))
    parts = max(1, min(3 * blocks, max(blocks, 2000)))  # a few blocks fall together by their hashes
    dealt = left.unionByName(right).repartition(parts, "block").sortWithinPartitions("block", "side")
    kind = pa.int64() if score == "long" else pa.float64()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches, cut where block or side changes."""
        for batch in batches:
            if n := batch.num_rows:
                block, side = batch.column("block").to_numpy(zero_copy_only=False), batch.column("side").to_numpy()
                cuts = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                    yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, ids = None, [], None, None
        for some in runs(batches):
            block, side = some.column("block")[0].as_py(), some.column("side")[0].as_py()
            if block != at:
                at, held, index, ids = block, [], None, None
            if not side:
                held.append((matrix_of(some.column("vector")), some.column("ids")))
                continue
            if not held and index is None:
                continue
            if index is None:
                ids = pa.concat_arrays([x for _, x in held])
                index = kernel(np.concatenate([x for x, _ in held]), pc.list_element(ids, 0).to_numpy())
                held = []
            who, place, value = index(matrix_of(some.column("vector")))
            who = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([some.column("k1").take(who), some.column("k2").take(who), pa.array(value, kind), ids.take(pa.array(place, pa.int64()))], names=["k1", "k2", "score", "ids"])

    return dealt.mapInArrow(run, f"k1 long, k2 long, score {score}, ids array<long>")


def answer(asked: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """asked: rows (vec_id, k1, k2); found: search_blocks(). Per asked row its top others: query_id, rank, vec_id, score."""
    best = W.partitionBy("k1", "k2")
    classes_ = found.withColumn("r", F.row_number().over(best.orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("r") <= top + 1).drop("r")
    each = classes_.select("k1", "k2", "score", F.explode("ids").alias("vec_id"))
    few = each.withColumn("r", F.row_number().over(best.orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= top + 1)
    lists = few.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("r", "score", "vec_id"))).alias("found"))
    own = asked.join(lists, ["k1", "k2"]).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, top).alias("found"))
    out = own.select("query_id", F.posexplode("found").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def ready(rows: DataFrame, top: int, every: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written classes; asked rows (vec_id, k1, k2: those whose id `every` divides); their different vectors (k1, k2, vector)."""
    known = written(classes(rows, top), "classes")
    chosen = rows.where(F.col("vec_id") % every == 0)
    asked = chosen.select("vec_id", *class_keys(F.col("vector"))).distinct()
    return known, asked, known.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "vector")
