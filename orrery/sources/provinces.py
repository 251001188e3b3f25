"""Rows of provincial registries as records. A row is an array of texts in a file's order; Nova Scotia's has names.

Every reader gives: name, other_name, registration_number, business_number, type_raw, status_raw, registered, street, city, province,
postal_code. Rows without the names and numbers that a registry requires are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.text import date_of


def cell(row: Column, place: int) -> Column:
    """The trimmed text at a place from 0, null if it is empty or not there."""
    return F.nullif(F.trim(F.get(row, place)), F.lit(""))


def record(default: str, **columns: Column) -> list[Column]:
    names = ["name", "other_name", "registration_number", "business_number", "type_raw", "status_raw", "registered", "street", "city", "province", "postal_code"]
    columns = {"province": F.lit(default), **columns}
    return [columns.get(n, F.lit(None).cast("date" if n == "registered" else "string")).alias(n) for n in names]


def alberta(rows: DataFrame) -> DataFrame:
    """Type, name, status, date, city, postal code."""
    r = F.col("row")
    out = rows.where((F.size(r) >= 6) & cell(r, 1).isNotNull())
    unknown = lambda i: F.coalesce(cell(r, i), F.lit("unknown"))
    return out.select(*record("AB", name=cell(r, 1), type_raw=unknown(0), status_raw=unknown(2), registered=date_of(cell(r, 3)), city=cell(r, 4), postal_code=cell(r, 5)))


def quebec(rows: DataFrame) -> DataFrame:
    """Number, French name, other name, kind, regime, form, status, date, street, city, province, postal code. The type is the form with
    the regime in brackets, else the kind; an address needs a city or postal code."""
    r = F.col("row")
    out = rows.where((F.size(r) >= 8) & cell(r, 0).isNotNull() & cell(r, 1).isNotNull())
    form = F.when(cell(r, 4).isNotNull(), F.concat(F.coalesce(cell(r, 5), F.lit("")), F.lit(" ("), cell(r, 4), F.lit(")"))).otherwise(cell(r, 5))
    placed = (F.size(r) > 11) & (cell(r, 9).isNotNull() | cell(r, 11).isNotNull())
    where = lambda c: F.when(placed, c)
    return out.select(
        *record(
            "QC", name=cell(r, 1), other_name=cell(r, 2), registration_number=cell(r, 0), type_raw=F.coalesce(form, cell(r, 3), F.lit("unknown")), status_raw=F.coalesce(cell(r, 6), F.lit("unknown")), registered=date_of(cell(r, 7)),
            street=where(cell(r, 8)), city=where(cell(r, 9)), province=F.when(placed, F.coalesce(cell(r, 10), F.lit("QC"))).otherwise(F.lit("QC")), postal_code=where(cell(r, 11)),
        )
    )


def ontario(rows: DataFrame) -> DataFrame:
    """Name, number, status, type, date, street, city, postal code, (one more), business number. A missing number is twelve digits of the
    name's md5; a business number is digits, or holds RC."""
    r = F.col("row")
    out = rows.where((F.size(r) >= 4) & cell(r, 0).isNotNull())
    placed = (F.size(r) > 8) & (cell(r, 6).isNotNull() | cell(r, 7).isNotNull())
    where = lambda c: F.when(placed, c)
    unknown = lambda i: F.coalesce(cell(r, i), F.lit("unknown"))
    bn = F.when(cell(r, 9).rlike(r"^\d+$") | F.upper(cell(r, 9)).contains("RC"), cell(r, 9))
    return out.select(
        *record("ON", name=cell(r, 0), registration_number=F.coalesce(cell(r, 1), F.left(F.md5(cell(r, 0)), F.lit(12))), business_number=bn, type_raw=unknown(3), status_raw=unknown(2), registered=date_of(cell(r, 4)), street=where(cell(r, 5)), city=where(cell(r, 6)), postal_code=where(cell(r, 7)))
    )


def nova_scotia(rows: DataFrame) -> DataFrame:
    """Co-operatives by the file's names of columns: all are registered; a date may be a year alone."""
    c = lambda name: F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
    year = c("Incorporation Year")
    day = F.coalesce(F.try_to_date(year, "yyyy-MM-dd"), F.make_date(F.left(year, F.lit(4)).try_cast("int"), F.lit(1), F.lit(1)))
    profit = F.upper(c("Non-Profit(N)/For-Profit(P)"))
    kind = F.when(profit == "N", "Non-profit Cooperative").when(profit == "P", "For-profit Cooperative").otherwise("Cooperative")
    out = rows.where(c("Co-op Name").isNotNull() & c("Registry ID").isNotNull())
    return out.select(
        *record("NS", name=c("Co-op Name"), registration_number=c("Registry ID"), type_raw=F.concat_ws(" - ", kind, c("Type")), status_raw=F.lit("Registered"), registered=day, street=c("Address"), city=c("Town"), province=F.coalesce(c("Province/State"), F.lit("NS")), postal_code=c("Postal Code"))
    )
