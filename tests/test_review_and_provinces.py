"""Provincial rows by hand; best names, vendors and cities against all pairs."""

import datetime as dt

import pytest

from orrery.functions import similarity as S
from orrery.operators import review as V
from orrery.sources import provinces as P


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_provinces(spark):
    make = lambda rows: spark.createDataFrame([(r,) for r in rows], "row array<string>")
    ab = rows_of(P.alberta(make([["Society", " Green Club ", "Active", "2001-02-03", "Calgary", "T1T 1T1"], ["x", " ", "", "", "", ""], ["x", "y"], [None, "Z", None, "?", None, ""]])))
    assert ab == [("Green Club", None, None, None, "Society", "Active", dt.date(2001, 2, 3), None, "Calgary", "AB", "T1T 1T1"), ("Z", None, None, None, "unknown", "unknown", None, None, None, "AB", None)]
    qc = rows_of(P.quebec(make([["11", "Nom", "Name", "PM", "Loi", "Coop", "Actif", "2001-02-03", "1 rue", "Laval", "", "H1H"], ["12", "Autre", "", "PP", "", "", "", ""], ["", "x", "", "", "", "", "", ""]])))
    assert qc == [("Nom", "Name", "11", None, "Coop (Loi)", "Actif", dt.date(2001, 2, 3), "1 rue", "Laval", "QC", "H1H"), ("Autre", None, "12", None, "PP", "unknown", None, None, None, "QC", None)]
    on = rows_of(P.ontario(make([["A Co", "77", "Active", "Corp", "2001-02-03", "1 St", "Guelph", "N1N", "z", "123456789"], ["B Co", "", "", ""], ["", "1", "2", "3"], ["C", "1", "2", "3", "", "", "", "", "", "abc"]])))
    assert on[0] == ("A Co", None, "77", "123456789", "Corp", "Active", dt.date(2001, 2, 3), "1 St", "Guelph", "ON", "N1N")
    assert len(on) == 3 and len(on[1][2]) == 12 and on[1][4:6] == ("unknown", "unknown") and on[2][3] is None
    names = ["Registry ID", "Co-op Name", "Incorporation Year", "Address", "Town", "Province/State", "Postal Code", "Non-Profit(N)/For-Profit(P)", "Type"]
    ns = rows_of(P.nova_scotia(spark.createDataFrame([("5", "Fish", "1999-04-05", "a", "b", "", "c", "N", "Farm"), ("6", "Hay", "1999", "", "", "", "", "", ""), ("", "No", "", "", "", "", "", "", "")], ", ".join(f"`{n}` string" for n in names))))
    assert ns[0] == ("Fish", None, "5", None, "Non-profit Cooperative - Farm", "Registered", dt.date(1999, 4, 5), "a", "b", "NS", "c")
    assert ns[1][4:7] == ("Cooperative", "Registered", dt.date(1999, 1, 1)) and len(ns) == 2


NAMES = [(1, "Maple Media Inc"), (2, "Northern Trust Fund"), (3, "Acme Widgets Ltd"), (4, "maple media"), (5, "Globalnews Group"), (6, "")]


def test_best_names(spark):
    target = spark.createDataFrame(NAMES, "id long, name string")
    asked = [(11, "MAPLE MEDIA"), (12, "The Trust Northern Shore"), (13, "Globalnewz Group"), (14, "Nothing alike"), (15, None)]
    got = {r.source_id: (r.target_id, r.confidence) for r in V.best_by_name(spark.createDataFrame(asked, "id long, name string"), target).collect()}
    assert got[11] == (1, 1.0) and 14 not in got and 15 not in got
    plain = {1: "MAPLE MEDIA", 2: "NORTHERN TRUST", 3: "ACME WIDGETS", 4: "MAPLE MEDIA", 5: "GLOBALNEWS"}  # less what companies end in
    for i, name in ((12, "THE TRUST NORTHERN SHORE"), (13, "GLOBALNEWZ")):
        best = max((S.token_set(name, n), -k) for k, n in plain.items())
        assert best[0] >= 85 and got[i] == (-best[1], pytest.approx(best[0] / 100))


def test_vendors(spark):
    known, registry = spark.createDataFrame(NAMES, "id long, name string"), spark.createDataFrame([(90, "Harbour Freight Lines"), (91, "Quite Other")], "id long, name string")
    vendors = spark.createDataFrame([(21, "Acme Widgets"), (22, "Harbour Freight Line"), (23, "zzzzqq")], "id long, name string")
    got = {r.vendor_id: (r.match_id, r.found_in) for r in V.vendor_matches(vendors, known, registry).collect()}
    assert got == {21: (3, "known"), 22: (90, "registry")}


def test_cities_and_groups(spark):
    pairs = [("St. John's", "st johns", True), ("Montreal", "Montréal", True), ("Toronto", "Ottawa", False), (None, "x", None), ("Saskatoon", "Saskatoom", False)]
    out = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    got = [r.s for r in out.select(V.same_city(out.a, out.b).alias("s")).collect()]
    assert got == [p[2] for p in pairs[:1]] + [S.ratio("MONTREAL", "MONTRAL") >= 90, False, None, S.ratio("SASKATOON", "SASKATOOM") >= 90]
    rows = [(1, "Acme Corp", "12-3456789", None), (2, "Other", "123456789", "b1"), (3, "Third", None, "B-1"), (4, "acme", None, None), (5, "Alone", None, None), (6, "Globalnews Group", None, None), (7, "Globalnewz Group", None, None)]
    df = spark.createDataFrame(rows, "id long, name string, ein string, bn string")
    assert {r.id: r.group for r in V.duplicate_groups(df, 90.0).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6}
    assert V.duplicate_groups(df.where("id > 10"), None).count() == 0
