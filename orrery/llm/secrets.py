"""Secrets in texts, told from widely copied examples by who else has them. DataFrame functions only.

Each kind's matches and the text between them come from regexp_extract_all and split with the same
pattern; their lengths give the places. Values are then counted over the corpus by hash: in how many
repositories (documents) and with how many owners (sources) each occurs. A value of many owners or repositories is a
copied example; one of few is live. Beside the base kinds, long mixed tokens that stand free of any known
name are candidates, and those that look live and belong to few owners become spans of kind `token`.

Null texts have no spans. A null source is an owner of its own. Rows that repeat doc_id and text share one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.common import written

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind -> pattern, group of the value, least length of the value. A pattern that must run on to the end of its
#: characters finds the same matches of enough length as the pattern without the length.
KINDS = {"assign": (ASSIGN, 2, 12), "access": ("AKIA[A-Z0-9]{14,}", 0, 18), "hex": ("[0-9a-f]{16,}", 0, 16), "token": ("[A-Za-z0-9+/_-]{24,}", 0, 24)}
BASE = ("assign", "access", "hex")

#: Matches of a text that are put together at a time; salts over which a value's documents are dealt.
CHUNK, SALTS = 128, 32

SPAN = "array<struct<start:int,rank:int,kind:string,stop:int,value:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """The kind's spans in order: code points from start to stop, exclusive."""
    pattern, group, least = KINDS[kind]
    rank = list(KINDS).index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("whole"), values.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["before"])
        stop = start + F.coalesce(F.char_length(x["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"), x["value"].alias("value"))
        # After the last match stands the rest of the text, which has no match.
        found = F.when(F.char_length(x["value"]) >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    empty, none = F.array().cast(SPAN), F.array().cast(f"array<{SPAN}>")

    def chunk(acc: Column, own: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), empty.alias("found"))
        return F.aggregate(own, start, step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["found"], F.array(x["found"])).alias("found")))

    # An array that grows match by match is copied at each; grown in chunks, the copies stay short in texts of very many matches.
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda i: F.slice(rows, i * CHUNK + 1, CHUNK))
    some = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("found")), chunk, lambda acc: F.flatten(acc["found"]))
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), some).otherwise(empty)


def looks_live(value: Column) -> Column:
    """Upper case, lower case and digits, and at least ten different characters."""
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """Per different document: doc_id, text_hash, owner, base (spans of the base kinds) and free (mixed tokens that overlap none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), text.alias("_text"))
    base = base.withColumn("base", F.array_sort(F.concat(*[spans_of(F.col("_text"), k) for k in BASE])))
    free = F.filter(spans_of(F.col("_text"), "token"), lambda x: looks_live(x["value"]) & ~F.exists(F.col("base"), lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return base.withColumn("free", free).drop("_text")


def ownership(spans: DataFrame) -> DataFrame:
    """spans: hash, salt, owner, doc_id. Per hash and salt that occur: owners and repositories (documents) of the hash.

    A hash that very many documents share is counted salt by salt, and joined to by hash and salt, so it is no key of one
    task. Salts go by document: the documents of a hash's salts add up.
    """
    each = spans.select("hash", "salt", "owner", "doc_id").distinct().groupBy("hash", "salt", "owner").agg(F.count("doc_id").alias("n"))
    totals = each.groupBy("hash", "owner").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    return each.select("hash", "salt").distinct().join(totals, "hash")


def scan(docs: DataFrame, owner: str = "source", most_owners: int = 3, most_repositories: int = 20) -> DataFrame:
    """Per document: doc_id, text_hash, base and spans (arrays of start, rank, kind, stop and value, in order), and live:
    of each span whether its value is owner-specific, that is in at most most_repositories documents of at most most_owners
    owners. What more owners have is a widely copied example, and so is what one owner's templates repeat.

    One pass over the texts; what follows handles spans alone. An empty table has an empty answer; repeated rows have an
    answer each; documents without an id count as no repository, but their owners count.
    """
    found = written(candidates(docs, owner), "secrets")
    every = found.select("doc_id", "text_hash", "owner", F.explode(F.concat("base", "free")).alias("span"))
    every = every.withColumn("hash", F.xxhash64("span.value")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    judged = every.join(ownership(every), ["hash", "salt"])
    judged = judged.withColumn("live", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))
    kept = judged.where(F.col("live") | (F.col("span.kind") != "token")).select("doc_id", "text_hash", F.struct("span.start", "span.rank", "span.kind", "span.stop", "span.value", "live", "owners", "repositories").alias("span"))
    own = kept.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    own = own.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    joined = found.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    empty = F.array().cast(own.schema["spans"].dataType)
    return joined.select("doc_id", "text_hash", "base", F.coalesce("spans", empty).alias("spans"))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The columns that the query returns, from scan()'s."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter("spans", lambda x: x["live"])).cast("long")
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        live.alias("n_live"), (F.size("spans") - live).alias("n_copied"),
    )


def redact(docs: DataFrame, owner: str = "source", most_owners: int = 3, most_repositories: int = 20, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span's value replaced by the mark (for an assignment, only what is assigned), and n_chars,
    if there is such a column, counted anew. Documents without spans come back as they were."""
    found = scan(docs, owner, most_owners, most_repositories).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans").where(F.size("spans") > 0)
    found = found.dropDuplicates(["_id", "_hash"])
    # The rows travel as one column, so that no name among theirs can clash with those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text")
    rows = rows.withColumn("_own", F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(x["stop"] - F.char_length(x["value"]), acc["at"])
        # What overlaps a span before it lengthens the hidden part only.
        more = F.array(F.substring(text, acc["at"] + 1, start - acc["at"]), F.when((start > acc["at"]) | (acc["at"] == 0), F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(x["stop"] > acc["at"], F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.lit(2**31 - 1)))
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, end)
    hit = F.col("spans").isNotNull()
    joined = joined.withColumn("_text", F.when(hit, clean).otherwise(text))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(hit, F.char_length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return joined.select(*[out[c].alias(c) for c in docs.columns])
