"""Secrets in very long texts, and in values that one owner repeats in many documents."""

import time

from test_text_ops import DOCS, brute_spans

from orrery.llm import secrets


def test_many_matches_of_one_text(spark):
    parts = []
    for i in range(20_000):
        parts.append(f"word {i:016x} é" if i % 3 else f"token = Ab{i:014d} AKIA{'Q' * 14}{i}")
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text, "en", "s", len(text), None), (2, "word " * 200_000, "en", "s", 1, None)], DOCS)
    began = time.time()
    out = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert time.time() - began < 60
    found = [x for x in out[1].spans if x.kind != "token"]
    assert ",".join(f"{x.kind}:{x.start}:{x.stop}" for x in found) == brute_spans(text)
    assert len(found) > 20_000 and not out[2].spans


def test_repositories_decide_with_owners(spark):
    wide, own, many = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9", "Zy9Xw8Vu7Ts6Rq5Po4Nm3Lk2Ji1", "Hh1Jj2Kk3Ll4Mm5Nn6Pp7Qq8Rr9"
    rows = [(i, f"see {many} there", "en", "s1", 1, None) for i in range(21)] + [(100 + i, f"see {own} there", "en", "s1", 1, None) for i in range(20)]
    rows += [(200 + i, f"see {wide} there", "en", f"s{i}", 1, None) for i in range(4)] + [(119, f"see {own} there", "en", "s1", 1, None)] * 5
    out = secrets.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in out if r.spans} == set(range(100, 120)) and len(out) == len(rows)
    assert {(s.owners, s.repositories) for r in out for s in r.spans} == {(1, 20)}


def test_names_of_spans_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "token=abcdefabcdefabcdef", "en", "s", 1, "x")], DOCS).selectExpr("*", "1 hash", "2 salt", "3 base", "4 owners", "5 repositories", "6 n", "7 found", "8 at")
    out = secrets.redact(docs)
    assert out.columns == docs.columns and [r.text for r in out.collect()] == ["token=[SECRET]"]
