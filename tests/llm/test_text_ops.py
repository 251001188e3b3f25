"""Operators on texts against brute force, libraries and round trips, with the awkward cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from orrery.llm import bpe, langid, neardup, packing, secrets, tokenfile
from orrery.llm.tokens import LibraryEncoder

MULTI, GPT, WORD = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
BITS = ["'", "s", "t", "re", "ve", "ll", "m", " ", "  ", "\n", "\t", ".", ",", "\xa0", "　", "a", "Z", "é", "1", "½", "!", "😀", "́", "中", "\x1c", "\x85", "​", "\r\n", "word", "İ", "<|endoftext|>", "<|startoftext|>", "x" * 300, "ab" * 90]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"


def strange(n, seed):
    rng = random.Random(seed)
    return ["", " ", *("".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n))]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, ties, repeated rows, a clashing extra column, one very long text."""
    long = " ".join(f"w{i % 977} {i}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "s1", 43, "x"), (2, "THE quick brown fox  jumps over the lazy dog", "en", "s2", 44, None), (3, "", "en", "s1", 0, "x"), (4, None, None, None, None, None),
        (5, "12345 !!!", None, "s3", 9, "x"), (6, long, "en", "s1", len(long), "x"), (6, long, "en", "s1", len(long), "x"), (None, "no id here at all today", "en", None, 23, "x"), (8, "fox", "en", "s9", 3, "x"), (9, "fox", "en", "s9", 3, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_as_tiktoken():
    own = bpe.ByteBpe(MULTI)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = strange(4000, 1)
    for ids, text in zip(own.encode(texts), texts, strict=True):
        assert ids.tolist() == ref.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    assert len(bpe.machine()[1]) < 256  # few transition functions arise


def test_bpe_scan_is_associative():
    numbers, compose, *_ = bpe.machine()
    n = len(compose)
    a, b, c = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    assert (compose[compose[a, b], c] == compose[a, compose[b, c]]).all()


def test_bpe_documents(spark, docs, empty):
    out = {r.doc_id: r for r in bpe.digests(bpe.encode_documents(docs, MULTI)).collect()}
    assert out[4].n_tokens == 0 and out[4].decoded_sha256 == hashlib.sha256(b"").hexdigest() and None in out
    whole = bpe.encode_documents(docs, MULTI).collect()
    assert len(whole) == 10 and all(np.frombuffer(r.offsets, "<u4")[-1] == len(r.decoded) for r in whole)
    assert bpe.digests(bpe.encode_documents(empty, MULTI)).count() == 0


@pytest.mark.parametrize("path, blanks", [(GPT, True), (WORD, False)])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_library_encoder(path, blanks, special_as_text):
    own, plain = LibraryEncoder(path, blanks, special_as_text, max_cached=500), Tokenizer.from_file(path)
    if special_as_text:
        plain.encode_special_tokens = True
    texts = strange(4000, 2) + ["foo <|endoftext|> bar", "a<|endoftext|>b.", "<|startoftext|>  \n x <|ENDOFTEXT|>"]
    for i in range(0, len(texts), 500):
        ref = plain.encode_batch(texts[i : i + 500], add_special_tokens=False)
        assert [x.tolist() for x in own.ids(texts[i : i + 500])] == [x.ids for x in ref]


def test_token_file_round_trip():
    rng = np.random.default_rng(0)
    for case in ([], [np.zeros(0, "<u4")], [np.array([7], "<u4"), np.zeros(0, "<u4"), np.array([2**32 - 1, 0, 5], "<u4")], [np.arange(513, dtype="<u4") * 8_000_000], [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 1, 511, 512, 513, 5000)]):
        file = tokenfile.TokenFile(tokenfile.to_file([None, *range(1, len(case))][: len(case)], case))
        back = list(file.documents(600))
        assert len(back) == len(case) and all((a == b).all() and len(a) == len(b) for (_, _, a), b in zip(back, case, strict=True))
    flat = np.concatenate(case)
    assert (file.ids(700, 1300) == flat[700:1300]).all()


def test_token_files(spark, docs, empty):
    folder, files = tokenfile.write_token_files(docs, GPT, ids_per_file=500)
    out = sorted(tokenfile.read_checksums(folder, files).collect(), key=lambda r: r.start)
    ref = Tokenizer.from_file(GPT)
    want = [(r.doc_id, np.array([*ref.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")) for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))]  # equal ids have equal texts here
    at = 0
    for r, (doc_id, ids) in zip(out, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    folder, files = tokenfile.write_token_files(empty, GPT)
    assert tokenfile.read_token_files(folder, files).count() == 0


def packed(plan):
    return collections.Counter({x: sum(n * m for f, m in plan for y, n in f if y == x) for x in {y for f, _ in plan for y, _ in f}})


@pytest.mark.parametrize("capacity, n", [(10, 12), (50, 200), (2048, 3000)])
def test_bin_completion(capacity, n):
    rng = random.Random(n)
    counts = collections.Counter(rng.randint(1, capacity) for _ in range(n))
    best, found = packing.best_fit(counts, capacity), packing.bin_completion(counts, capacity)
    for plan in (best, found):
        assert packed(plan) == counts and all(sum(x * k for x, k in f) <= capacity for f, _ in plan)
    total, least = sum(m for _, m in found), -(-sum(x * k for x, k in counts.items()) // capacity)
    assert least <= total <= sum(m for _, m in best)
    assert packing.bin_completion({}, capacity) == []


def test_bin_completion_beats_best_fit():
    assert sum(m for _, m in packing.best_fit({6: 1, 5: 1, 4: 2, 3: 3}, 14)) == 2 == -(-28 // 14)
    improved = 0
    for seed in range(60):
        rng = random.Random(seed)
        counts = collections.Counter(rng.randint(12, 50) for _ in range(14))
        improved += sum(m for _, m in packing.bin_completion(counts, 100)) < sum(m for _, m in packing.best_fit(counts, 100))
    assert improved


def test_packing(spark, docs, empty):
    _, out = packing.pack_documents(docs, WORD)
    seats = collections.defaultdict(list)
    ref = Tokenizer.from_file(WORD)
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*ref.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r.doc_id, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048))
    rows = out.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        seats[r.sequence_id].append((r.offset, r.length))
    for s in seats.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(seats) == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack_documents(empty, WORD)[1].count() == 0


def brute_phrases(text, sample):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_cross_parsing():
    """Phrase counts of whole texts, beyond the segments that are parsed in step, against greedy search in the sample."""
    rng = random.Random(1)
    learned = {"aa": "banana bandana cabana ", "bb": "mississippi ississ ", "cc": "".join(rng.choice("ab") for _ in range(3000)) + " ", "dd": "ab" * 400 + "c "}
    model = langid.CrossParser({lang: [t] for lang, t in learned.items()})
    texts = ["banana", "ban miss", "zzz", "cabana bandana banana ipp", "a" * 700, learned["cc"][7:2900], "ab" * 2000, "ba" * 1500 + "c" * 700, "".join(rng.choice("abcdz ") for _ in range(4000))]
    folded = [langid.fold(t) for t in texts]
    got = model.phrases(folded)
    for own, row in zip(folded, got, strict=True):
        assert row.tolist() == [brute_phrases("".join(map(chr, own)), learned[lang]) for lang in model.langs]
    assert model.predict([None, "", "123", "bandana"])[0] == ["und", "und", "und", "aa"]


def test_language_samples(spark):
    """Neither null or repeated ids nor repeated rows crowd a language out."""
    rows = [(None, f"the house number {i} stands by the road", "en", "s", 1, None) for i in range(600)] + [(None, "das gleiche Haus steht an der gleichen Straße", "de", "s", 1, None)] * 300
    rows += [(None, f"das Haus Nummer {i} steht an der Straße", "de", "s", 1, None) for i in range(9)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    assert model.langs == ["de", "en"] and model.predict(["the road", "an der Straße"])[0] == ["en", "de"]


def test_language_rejects(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    own = lambda n: " ".join(rng.choice(words) for _ in range(n))
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(400))
    rows = [(i, own(100), "xx", "s", 1, None) for i in range(60)] + [(100, noise, None, "s", 1, None), (101, own(30), None, "s", 1, None), (102, "qq zz", None, "s", 1, None), (103, None, "xx", "s", 1, None), (104, "12", "xx", "s", 1, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in langid.keep_identified(docs, langid.fit(docs)).collect()}
    assert kept == {*range(60), 101, 102}
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars", "ids")
    assert {r.doc_id for r in langid.keep_identified(bare, langid.fit(bare)).collect()} == {*range(60), 100, 101, 102}
    assert {r.lang_pred for r in langid.identify(bare, langid.fit(bare)).collect()} == {"und"}
    assert langid.keep_identified(docs.where("doc_id < 0"), langid.fit(docs)).count() == 0


def test_language_held_out(spark, sf, docs, empty):
    table = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = langid.identify(table, langid.fit(table)).join(table.select("doc_id", "lang", langid.is_held_out().alias("h")), "doc_id").where("h").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    out = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs, letters=2000)).collect()}
    assert out[4].lang_pred == out[3].lang_pred == out[5].lang_pred == "und" and out[1].lang_pred == "en"
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert sorted(r.doc_id for r in langid.keep_identified(docs, langid.fit(docs, letters=2000)).collect() if r.doc_id) == [1, 2, 6, 6, 8, 9]
    assert all(langid.held_out(i) == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(50))


def brute_spans(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets(spark, empty):
    rng = random.Random(5)
    bits = ["token", "PASSWORD", "secret", "api_key", "apikey", ":", " = ", "=", '"', "'", " ", "abcdefghijkl", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "😀", "x", "Zz9_xY8-wV7uT6sR5qP4oN3m", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["", "token: secret: abcdefghijklmnop"]
    rows = [(i, t, "en", f"s{i % 7}", len(t), None) for i, t in enumerate(texts)] + [(900, None, None, None, None, None), (901, texts[3], None, None, 1, None), (901, texts[3], None, None, 1, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = secrets.digests(secrets.scan(docs)).collect()
    assert len(out) == len(rows)
    known = {r[0]: r[1] or "" for r in rows}
    for r in out:
        want = brute_spans(known[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if s and not s.startswith("token")) == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))
    assert secrets.digests(secrets.scan(empty)).count() == 0


def test_secrets_ownership(spark):
    copied, own = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9", "Zy9Xw8Vu7Ts6Rq5Po4Nm3Lk2Ji1"
    rows = [(i, f"see {copied} there", "en", f"s{i}", 1, None) for i in range(6)] + [(10, f"mine {own} only", "en", "s1", 1, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in secrets.digests(secrets.scan(docs)).collect()}
    assert out[10].spans == f"token:5:{5 + len(own)}" and out[0].spans == ""
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[10].text == "mine [SECRET] only" and clean[10].n_chars == 18 and clean[0].text == rows[0][1]
    assert secrets.redact(docs).columns == docs.columns
    names = ("spans", "_own", "_hash", "row", "label", "kept", "keys", "score", "owner", "live")
    clash = docs.selectExpr("*", *(f"'x' as {n}" for n in names))
    for out in (secrets.redact(clash), neardup.drop_duplicates(clash), langid.keep_identified(clash, langid.CrossParser({"en": ["see there mine only"]}))):
        assert out.columns == clash.columns and all(r[n] == "x" for r in out.collect() for n in names)
    assert {r.text for r in secrets.redact(clash).where("doc_id = 10").collect()} == {"mine [SECRET] only"}


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().decode()
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a]]
    for _ in sets:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates(spark, docs, empty):
    rng = random.Random(3)
    rows, base = [], None
    for i in range(240):
        if i % 30 == 0:
            base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 6, 40, 120, 400]))]
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        rows.append((i, ("\t" if i % 2 else " ").join(words).upper() if i % 5 else " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in neardup.near_duplicates(table).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == brute_components(rows)
    assert all(r.kept == (i == r.component_id) for i, r in out.items())
    mixed = neardup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id) for r in mixed} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (None, None), (8, 8), (9, 8)} and len(mixed) == 10
    assert neardup.near_duplicates(empty).count() == 0
    assert sorted(r.doc_id for r in neardup.drop_duplicates(docs).where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 8]


def test_near_duplicates_of_templates(spark):
    """Documents that share half of their shingles are candidates by the thousand, and groups whose least document is linked
    with few of its members come together all the same."""
    rng = random.Random(8)
    half = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(half + [f"w{rng.randrange(10**6)}" for _ in range(60)])) for i in range(500)]
    chain = [f"c{i}" for i in range(300)]
    for i in range(40):  # each differs from the one before by a few words, so the ends are far apart
        chain[7 * i % 300] = f"x{i}"
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, " ".join(f"g{rng.randrange(40)}" if rng.random() < 0.012 else f"h{k}" for k in range(150))) for i in range(120)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table).collect()}
    want = brute_components(rows)
    assert out == want
    assert len({c for i, (_, c) in want.items() if i < 1000}) == 500 and len({c for i, (_, c) in want.items() if 1000 <= i < 2000}) < 5


def test_documents_of_several_texts(spark):
    a, b = ("first text of seven words or so", "and another one that is not like it")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, b + " x y z"), (11, "alone"), (11, "still alone")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9), (11, 11), (11, 11)]
    left = neardup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in left) == [3, 9, 11]


def test_sequential_test_is_monotone():
    steps = neardup.least_matches(0.85, 1e-6, 24)
    assert steps[-1][0] == neardup.SIZE and all(a[1] < b[1] for a, b in zip(steps, steps[1:], strict=False))
    assert neardup.tail(24, 24, 0.85) > 0.9 > 1e-6 > neardup.tail(0, 24, 0.85)
