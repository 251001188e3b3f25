"""Entity resolution: exact, fuzzy and vector matches in a cascade, boosts, routing.

Candidates come from equi-joins on blocking keys; only fuzzy names, which have no key that loses nothing, are compared with
each other. Whatever an earlier stage matched is kept from
later ones by anti-joins.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions import names as N
from orrery.functions.similarity import SCORERS
from orrery.operators.pairs import block_pairs, spread_join


def by_identifier(source: DataFrame, target: DataFrame) -> DataFrame:
    """source_id, target_id, identifier of rows (id, ein, bn, opencorp) that share a normalised identifier; of several the one
    that comes last in that order. Confidence 1."""
    rank = {"ein": 1, "bn": 2, "opencorp": 3}
    clean = {"ein": N.digits, "bn": N.normalise_bn, "opencorp": lambda c: F.lower(F.trim(c))}
    found = None
    for kind in rank:
        a = source.select(F.col("id").alias("source_id"), clean[kind](F.col(kind)).alias("key")).where(F.length("key") > 0)
        b = target.select(F.col("id").alias("target_id"), clean[kind](F.col(kind)).alias("key")).where(F.length("key") > 0)
        own = a.join(b, "key").where("source_id <> target_id").select("source_id", "target_id", F.lit(rank[kind]).alias("r"), F.lit(kind).alias("identifier"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("source_id", "target_id").agg(F.max_by("identifier", "r").alias("identifier")).withColumn("confidence", F.lit(1.0))


def by_exact_name(source: DataFrame, target: DataFrame, normal=N.organisation) -> DataFrame:
    a = source.select(F.col("id").alias("source_id"), normal(F.col("name")).alias("key")).where(F.length("key") > 0)
    b = target.select(F.col("id").alias("target_id"), normal(F.col("name")).alias("key"))
    return a.join(b, "key").where("source_id <> target_id").select("source_id", "target_id", "key")


def named(rows: DataFrame, id_name: str, normal=N.organisation) -> DataFrame:
    """(id, name): rows with their normalised name, if it is not empty."""
    return rows.select(F.col("id").alias(id_name), normal(F.col("name")).alias(f"{id_name}_name")).where(F.length(f"{id_name}_name") > 0)


def reachable(a: list[str], b: list[str], score: str, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of names that can reach the cutoff: no common subsequence is longer than the characters that both hold, as often
    as both hold them. Their number is one matrix product, since the lesser of two counts is the number of steps that both reach.
    Token scores compare the same characters, unless names share a word, hold one twice or have other white space: such pairs stay."""
    steps = [[(c, n) for c, k in Counter(x).items() for n in range(k)] for x in (*a, *b)]
    places = {s: i for i, s in enumerate({s for own in steps for s in own})}
    held = np.zeros((len(steps), len(places)), np.float32)
    for i, own in enumerate(steps):
        held[i, [places[s] for s in own]] = 1
    common = held[: len(a)] @ held[len(a) :].T
    la, lb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])
    short, long = np.minimum(la, lb), np.maximum(la, lb)
    bound = 200 * common / np.maximum(la + lb, 1)
    if score == "weighted":
        window = np.where(long < 8 * short, 90, 60) * 2 * common / np.maximum(short + common, 1)
        bound = np.where(long < 1.5 * short, bound, np.maximum(bound, window))
    elif score == "partial":
        bound = 200 * common / np.maximum(short + common, 1)
    near = (bound >= cutoff - 1e-6) | (la + lb == 0)
    if score in ("token_sort", "token_set", "weighted"):
        words = [[x.split() for x in names] for names in (a, b)]
        odd = [np.array([" ".join(w) != x or len(set(w)) < len(w) for w, x in zip(own, names, strict=True)], bool) for own, names in zip(words, (a, b), strict=True)]
        near |= odd[0][:, None] | odd[1]
        if score != "token_sort":
            where: list[dict[str, list[int]]] = [{}, {}]
            for side, own in zip(where, words, strict=True):
                for i, w in enumerate(own):
                    for x in w:
                        side.setdefault(x, []).append(i)
            for x in where[0].keys() & where[1].keys():
                near[np.ix_(where[0][x], where[1][x])] = True
    return np.nonzero(near)


def ratios(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """ratio() of the pairs at places i and j, side by side; names of a hold at most 64 characters. The steps are those of lcs()."""
    places = {c: n for n, c in enumerate({c for x in a for c in x}, 1)}
    masks = np.zeros((len(a), len(places) + 1), np.uint64)
    for n, x in enumerate(a):
        for k, c in enumerate(x):
            masks[n, places[c]] |= np.uint64(1 << k)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    codes = np.zeros((len(b), max(lb, default=0)), np.intp)  # 0, also beyond the end: no character of a
    for n, x in enumerate(b):
        codes[n, : len(x)] = [places.get(c, 0) for c in x]
    out = np.empty(len(i))
    for at in range(0, len(i), 65536):
        u, v = i[at : at + 65536], j[at : at + 65536]
        row = np.full(len(u), 2**64 - 1, np.uint64)
        for k in range(codes.shape[1]):
            hit = row & masks[u, codes[v, k]]
            row = (row + hit) | (row - hit)
        full = np.array([(1 << n) - 1 for n in range(65)], np.uint64)[la[u]]
        out[at : at + 65536] = 200.0 * (la[u] - np.bitwise_count(row & full)) / np.maximum(la[u] + lb[v], 1)
        out[at : at + 65536][la[u] + lb[v] == 0] = 100.0
    return out


def best_scores(a: list[str], b: list[str], score: str, cutoff: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and scores of the pairs that score the cutoff, less those that `top` + 1 others of their a beat: one of these may be a itself."""
    i, j = reachable(a, b, score, cutoff)
    if score in ("ratio", "token_sort") and all(len(x) <= 64 for x in a):
        x, y = ([" ".join(sorted(n.split())) if score == "token_sort" else n for n in names] for names in (a, b))
        s = ratios(x, y, i, j)
    else:
        s = np.array([SCORERS[score](a[u], b[v]) for u, v in zip(i, j, strict=True)], float)
    i, j, s = (x[s >= cutoff] for x in (i, j, s))
    order = np.lexsort((-s, i))
    i, j, s = i[order], j[order], s[order]
    first = np.searchsorted(i, i)
    last = np.minimum(first + top, np.searchsorted(i, i, "right") - 1)
    keep = s >= s[last]
    return i[keep], j[keep], s[keep]


def name_scores(a: DataFrame, b: DataFrame, score: str, cutoff: float, top: int, size: int = 1024) -> DataFrame:
    """a_name, b_name, score of different names that score at least the cutoff and may be of the best `top`. Blocks of one side's names
    meet those of the other: what cannot reach the cutoff is left out by reachable(), the rest is scored."""
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = [F.greatest(F.lit(1), F.ceil(rows.agg((F.count("*") / size).alias("n")).scalar())).cast("int") for rows in (a, b)]
    dealt = []
    for rows, own, other, mine, theirs in ((a, "_i", "_j", *blocks), (b, "_j", "_i", *blocks[::-1])):
        met = rows.withColumn(own, F.pmod(F.xxhash64(rows.columns[0]), mine).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), theirs - 1)))
        dealt.append(met.repartition(parts, "_i", "_j").groupBy("_i", "_j"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = left["a_name"].to_pylist(), right["b_name"].to_pylist()
        found = []
        for at in range(0, len(x), size):
            for to in range(0, len(y), size):
                u, v = x[at : at + size], y[to : to + size]
                found += [(u[i], v[j], s) for i, j, s in zip(*(x.tolist() for x in best_scores(u, v, score, cutoff, top)), strict=True)]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"a_name": pa.array(columns[0], pa.string()), "b_name": pa.array(columns[1], pa.string()), "score": pa.array(columns[2], pa.float64())})

    return dealt[0].cogroup(dealt[1]).applyInArrow(run, "a_name string, b_name string, score double")


def by_fuzzy_name(source: DataFrame, target: DataFrame, cutoff: float = 85.0, top: int = 10, score: str = "weighted", normal=N.organisation) -> DataFrame:
    """source_id, target_id, score of names that score at least cutoff; the best `top` of each source.

    The names are compared after normalising, each different name of the source with each of the target: work grows with their
    product, but only pairs whose characters can reach the cutoff are scored one by one.
    """
    a, b = named(source, "a", normal), named(target, "b", normal)
    scored = name_scores(a.select("a_name").distinct(), b.select("b_name").distinct(), score, cutoff, top)
    pairs = a.join(scored, "a_name").join(b, "b_name").where("a <> b")
    best = W.partitionBy("a").orderBy(F.desc("score"), "b")
    return pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "score")


def fuzzy_confidence(score: Column, same_country: Column, same_city: Column, same_state: Column, postal: Column) -> Column:
    """0.5 + 0.4 * score / 100, plus 0.02, 0.05 and 0.05 for an equal country, city and state and the postal boost; at most 0.95."""
    plus = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    return F.least(F.lit(0.95), 0.5 + 0.4 * score / 100 + plus(same_country, 0.02) + plus(same_city, 0.05) + plus(same_state, 0.05) + postal)


def by_vector(rows: DataFrame, block: str, threshold: float = 0.85) -> DataFrame:
    """Pairs (a < b) of one block whose vectors' cosine is at least threshold: a, b, cosine, confidence = 0.95 * cosine. Vectors of
    different lengths, null or zero ones, and ones with components that are null or no numbers have none. A block's rows meet in parts, whose cosines are one
    matrix product."""
    v = F.col("vector").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = rows.where(F.col("id").isNotNull() & F.col(block).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col("id").cast("long").alias("id"), F.col(block).alias("block"), F.size("vector").alias("n"), v.alias("vector"))

    def kernel(left: pa.Table, right: pa.Table) -> list:
        x, y = (t["vector"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
        ids = left["id"].to_numpy(), right["id"].to_numpy()
        cosine = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
        near = (cosine >= threshold) & (ids[0][:, None] < ids[1] if left is right else ids[0][:, None] != ids[1])
        i, j = np.nonzero(near)
        a, b = ids[0][i], ids[1][j]
        return [np.minimum(a, b), np.maximum(a, b), cosine[i, j], 0.95 * cosine[i, j]]

    return block_pairs(own, "id", kernel, "a long, b long, cosine double, confidence double", ["block", "n"], 1024)


def cascade(source: DataFrame, target: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """Identifiers, then equal names, then fuzzy names, each on sources that have no match yet: source_id, target_id, strategy, confidence."""
    first = by_identifier(source, target).select("source_id", "target_id", F.lit("identifier").alias("strategy"), "confidence")
    rest = source.join(first.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    second = by_exact_name(rest, target).select("source_id", "target_id", F.lit("name").alias("strategy"), F.lit(0.95).alias("confidence"))
    rest = rest.join(second.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    third = by_fuzzy_name(rest, target, cutoff).select("source_id", "target_id", F.lit("fuzzy").alias("strategy"), F.least(F.lit(0.95), 0.5 + 0.4 * F.col("score") / 100).alias("confidence"))
    return first.unionByName(second).unionByName(third)


def outcome(confidence: Column, strategy: Column, auto: bool = True) -> Column:
    """resolved: by identifier, or from 0.9 if auto; candidate: from 0.7; else unresolved."""
    return F.when((strategy == "identifier") | ((confidence >= 0.9) & F.lit(auto)), "resolved").when(confidence >= 0.7, "candidate").otherwise("unresolved")


def cross_border_action(confidence: Column, postal: Column) -> Column:
    best = F.least(F.lit(1.0), confidence + postal)
    return F.when(best >= 0.9, "auto_merged").when(best >= 0.7, "queued").otherwise("no_match")


def review_route(confidence: Column) -> Column:
    """approved from 0.98; else a task whose priority falls as the confidence rises."""
    return F.when(confidence >= 0.98, "approved").when(confidence < 0.5, "critical").when(confidence < 0.7, "high").when(confidence < 0.85, "medium").otherwise("low")


def strategy_confidence(strategy: Column, score: Column) -> Column:
    return F.when(strategy.isin("identifier", "exact"), 1.0).when(strategy == "normalized", 0.95).when(strategy == "fuzzy", F.least(F.lit(0.85), score)).otherwise(0.5)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lower-case words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_candidates(source: DataFrame, target: DataFrame, least: float = 0.3, top: int = 5) -> DataFrame:
    """source_id, target_id, similarity (Jaccard of trigrams) above `least`, the `top` best.

    Names of n trigrams with a similarity of `least` share one of each one's n - ceil(least * n) + 1 rarest. Only these are
    joined, so the commonest trigrams, which are the large keys, bring nobody together.
    """
    a = source.select(F.col("id").alias("source_id"), trigrams(F.col("name")).alias("ta")).where(F.size("ta") > 0)
    b = target.select(F.col("id").alias("target_id"), trigrams(F.col("name")).alias("tb")).where(F.size("tb") > 0)
    grams = a.select(F.explode("ta").alias("g")).unionAll(b.select(F.explode("tb").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, of: str, t: str) -> DataFrame:
        each = spread_join(rows.select(of, F.size(t).alias("size"), F.explode(t).alias("g")), grams, ["g"], of)
        rank = F.row_number().over(W.partitionBy(of).orderBy("n", "g"))
        return each.withColumn("r", rank).where(F.col("r") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1).select(of, "g")

    met = rarest(a, "source_id", "ta").join(rarest(b, "target_id", "tb"), "g").select("source_id", "target_id").distinct()
    both = met.join(a, "source_id").join(b, "target_id")
    common = F.size(F.array_intersect("ta", "tb"))
    scored = both.select("source_id", "target_id", (common / (F.size("ta") + F.size("tb") - common)).alias("similarity"))
    best = W.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id")
    return scored.where(F.col("similarity") > least).withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).select("source_id", "target_id", "similarity")


def sponsor_confidence(similarity: Column, same_jurisdiction: Column, same_city: Column, same_area: Column) -> Column:
    """0.3 * similarity, 0.1 for the jurisdiction, 0.05 each for the city and the first three characters of the postal code."""
    plus = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    return 0.3 * similarity + plus(same_jurisdiction, 0.1) + plus(same_city, 0.05) + plus(same_area, 0.05)


def cross_border_candidates(grants: DataFrame, charities: DataFrame) -> DataFrame:
    """Unresolved grants (recipient_id, country, state) with registered charities (id, bn, country, state) of the same country and,
    where the grant says it, state."""
    known = charities.where("bn IS NOT NULL").select(F.col("id").alias("candidate_id"), "country", F.col("state").alias("_state"))
    return grants.join(known, "country").where(F.col("state").isNull() | (F.col("state") == F.col("_state"))).select("recipient_id", "candidate_id")


def unresolved_grants(nodes: DataFrame, edges: DataFrame, country: str) -> DataFrame:
    """Organisations of a country without a number or resolution that somebody funds: id, name, in order."""
    open_ = nodes.where((F.col("country") == country) & F.col("bn").isNull() & F.col("resolved_to").isNull())
    return open_.join(edges.select(F.col("src").alias("id")), "id", "left_semi").select("id", "name").distinct().orderBy("name", "id")


def staged(source: DataFrame, target: DataFrame) -> DataFrame:
    """Number, then normalised name, then best fuzzy name (85 or more), each for what the one before left: source_id, target_id, stage."""
    a = source.select(F.col("id").alias("source_id"), N.normalise_bn(F.col("bn")).alias("k"))
    b = target.select(F.col("id").alias("target_id"), N.normalise_bn(F.col("bn")).alias("k"))
    first = a.join(b, "k").groupBy("source_id").agg(F.min("target_id").alias("target_id")).withColumn("stage", F.lit("bn"))
    rest = source.join(first.select(F.col("source_id").alias("id")), "id", "left_anti")
    second = by_exact_name(rest, target, N.registry).groupBy("source_id").agg(F.min("target_id").alias("target_id")).withColumn("stage", F.lit("name"))
    rest = rest.join(second.select(F.col("source_id").alias("id")), "id", "left_anti")
    third = by_fuzzy_name(rest, target, 85.0, 1, "token_sort").select("source_id", "target_id", F.lit("fuzzy").alias("stage"))
    return first.unionByName(second).unionByName(third)
