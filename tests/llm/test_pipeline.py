"""The pipeline's stages against brute force on a small table, and on tables without rows or labels."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from test_text_ops import DOCS, brute_components, brute_phrases
from tokenizers import Tokenizer

import corpus_pipeline

KEY, COPIED = "Zy9Xw8Vu7Ts6Rq5Po4Nm3Lk2Ji1", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9"


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinsrhd") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    other = ["".join(rng.choice("klmöüzwv") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []

    def add(text, lang="xx", source=None):
        rows.append((len(rows), text, lang, source or f"s{len(rows) % 5}", len(text or ""), "x"))

    for i in range(60):
        own = [rng.choice(words if i % 3 else other) for _ in range(rng.randint(20, 300))]
        add(" ".join(own), "xx" if i % 3 else "yy")
        if i % 4 == 0:  # copies: exact but for case and blanks, near, and too far
            add("  ".join(own).upper())
            add(" ".join([*own[: len(own) // 2], "changed", *own[len(own) // 2 + 1 :]]))
            add(" ".join(w if rng.random() < 0.8 else "other" for w in own))
    add(None)
    add("12 34 !!")
    add("")
    add("".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(400)), None)  # no language
    add(f"the text with password: hunter2hunter2 {' '.join(rng.choices(words, k=40))}")
    add(f"see {KEY} in here {' '.join(rng.choices(words, k=40))}", "xx", "s1")
    for i in range(5):
        add(f"example {COPIED} {' '.join(rng.choices(words, k=60))}", "xx", f"t{i}")
    add(" ".join(rng.choice(words) for _ in range(9000)))
    return rows


def fold(text):
    return " ".join("".join(c.lower() if c.isalpha() else " " for c in text or "").split())


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def hidden(text):
    text = re.sub(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]{12,}""", r"\1[SECRET]", text, flags=re.I | re.A)
    return text.replace(KEY, "[SECRET]")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_brute_force(spark, table):
    rows = corpus()
    docs = spark.read.parquet(f"{table}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    # 1. Language: phrases in what is learned, counted by searching in the text itself.
    learned = collections.defaultdict(str)
    for doc_id, text, lang, *_ in rows:
        if lang and text is not None and not held_out(doc_id):
            learned[lang] += fold(text) + " "
    kept = []
    for r in rows:
        own = fold(r[1])
        if own and not (len(own) >= 50 and min(brute_phrases(own, t) for t in learned.values()) > 0.5 * len(own)):
            kept.append(r)
    out = stages["language"](spark, docs, table)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(kept) and len(rows) - len(kept) == 4
    # 2. Near-duplicates.
    label = brute_components([(r[0], r[1]) for r in kept], 80)
    kept = [r for r in kept if label[r[0]][1] == r[0]]
    out = stages["near_duplicates"](spark, out, table)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(kept) and len(kept) < len(label) - 20
    # 3. Secrets: what many owners copy stays.
    kept = [(r[0], t := hidden(r[1]), r[2], r[3], len(t), r[5]) for r in kept]
    out = stages["secret_scan"](spark, out, table)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(kept)
    assert sum("[SECRET]" in r[1] for r in kept) == 2 and sum(COPIED in r[1] for r in kept) == 5
    # 4. Packing, by the whole pipeline.
    ref, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), collections.Counter()
    for r in kept:
        ids = np.array([*ref.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
        want.update((r[0], i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048))
    out = corpus_pipeline.run(spark, table).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    seats = collections.defaultdict(list)
    for r in out:
        seats[r.sequence_id].append((r.offset, r.length))
    for own in seats.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(seats) == -(-sum(r.length for r in out) // 2048)


def test_tables_without_rows_or_labels(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), DOCS)
    docs.where("doc_id < 0").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    nulls = docs.limit(3).selectExpr("doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars", "ids")
    nulls.write.parquet(f"{tmp_path}/nulls/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/nulls").count() == 0
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "n_chars", "ids").where("doc_id < 12 or doc_id is null")
    bare.union(bare.limit(2)).write.parquet(f"{tmp_path}/bare/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/bare").collect()
    assert {r.doc_id for r in out} and len(out) == len({(r.doc_id, r.piece) for r in out})
