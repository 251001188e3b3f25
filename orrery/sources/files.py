"""Readers of files: CSV in several encodings and with other names of columns, JSON, XML, archives of XML, spreadsheets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tried in this order.
ENCODINGS = ("UTF-8", "ISO-8859-1")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; a byte order mark is not part of the first name. Rows that do not fit the schema have nulls and are kept
    in _corrupt_record, if the schema has it."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def aliased(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Canonical columns, each the first that is not null among its names, whatever their case; null where none is there."""
    have = {c.lower().strip(): c for c in rows.columns}
    out = []
    for name, others in aliases.items():
        found = [F.col(f"`{have[o.lower()]}`") for o in (name, *others) if o.lower() in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return rows.select(*out)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files (path, text): UTF-8 where the bytes are, else Latin-1; without a byte order mark."""
    content = F.col("content")
    utf = F.try_validate_utf8(content.cast("string"))
    text = F.coalesce(utf, F.decode(content, "ISO-8859-1"))
    return spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(text, "^﻿", "").alias("text"))


def sniffed_separator(line: Column) -> Column:
    """The separator that a header line has most of."""
    counts = F.array(*[F.struct(F.regexp_count(line, F.lit(p)).alias("n"), F.lit(c).alias("c")) for c, p in ((",", ","), (";", ";"), ("\t", "\t"), ("|", r"\|"))])
    return F.array_max(counts)["c"]


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzipped."""
    return spark.read.schema(schema).json(path)


def read_json_records(spark: SparkSession, path: str, record: str, keys: tuple[str, ...] = ("data", "records", "results", "items", "corporations")) -> DataFrame:
    """One JSON document a file that is an array of records or holds it under one of the keys; the first key that is there."""
    text = spark.read.option("wholetext", True).text(path).select("value")
    arrays = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), f"array<struct<{record}>>") for k in keys], F.from_json("value", f"array<struct<{record}>>"))
    return text.select(F.explode(arrays).alias("r")).select("r.*")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("ignoreNamespace", True)
    return (reader.schema(schema) if schema else reader).load(path)


def xml_value(xml: Column, *paths: str) -> Column:
    """The first of the paths that holds text; element names match whatever their namespace."""
    found = []
    for p in paths:
        steps = "/".join(f"*[local-name()='{s}']" for s in p.split("/"))
        found.append(F.nullif(F.trim(F.xpath_string(xml, F.lit(f"//{steps}"))), F.lit("")))
    return F.coalesce(*found)


def read_zipped(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """Members (archive, name, text) of zip archives whose names end so. One archive is opened by one task, member by member."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(suffix):
                            yield pd.DataFrame({"archive": [archive], "name": [name], "text": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, text string")


def read_xlsx(spark: SparkSession, path: str, columns: list[str], header: int = 0) -> DataFrame:
    """Sheets of strings with the expected columns, from the row `header` on. Needs the optional reader of spreadsheets."""
    schema = ", ".join(f"`{c}` string" for c in columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                sheet = pd.read_excel(io.BytesIO(content), header=header, dtype=str)
                if missing := [c for c in columns if c not in sheet.columns]:
                    raise ValueError(f"the sheet has no columns {missing}")
                yield sheet[columns]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def archive_key(source: Column, day: Column, record_id: Column, extension: str) -> Column:
    """Where a raw record is kept: source/yyyy-mm/id.extension."""
    return F.concat_ws("/", source, F.date_format(day, "yyyy-MM"), F.concat(record_id, F.lit("." + extension)))
