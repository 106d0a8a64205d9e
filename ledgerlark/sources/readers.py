"""Readers: typed files in, a DataFrame out; nothing is inferred and nothing bad is hidden."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType, max_bad: int | None = None) -> DataFrame:
    """RFC 4180 text: quotes, doubled quotes and line ends in fields. Beyond ``max_bad`` malformed rows the load fails."""
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = spark.read.schema(full).options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=BAD).csv(path)
    if max_bad is not None:
        # a row is only parsed, and found malformed, for columns that are asked for
        bad = rows.agg(F.count(BAD).alias("bad"), F.bit_xor(F.xxhash64(*schema.names))).first().bad
        if bad > max_bad:
            raise ValueError(f"{bad} malformed rows in {path}, {max_bad} are allowed")
    return rows


def header_names(header: Sequence[str]) -> list[str]:
    """Column names of a header: lower case, other signs as _, digits in front prefixed, repeats numbered."""
    seen: dict[str, int] = {}
    found = []
    for h in header:
        name = re.sub(r"[^a-z0-9_]", "_", (h or "").strip().lower()) or "field"
        name = f"field_{name}" if name[0].isdigit() else name
        seen[name] = seen.get(name, 0) + 1
        found.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return found


def crosswalk(rows: DataFrame, columns: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Typed columns from a file's by a mapping target -> (header, cleaner); headers match in any case, a missing one is an error."""
    there = {c.strip().lower(): c for c in rows.columns}
    missing = [h for h, _ in columns.values() if h.strip().lower() not in there]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return rows.select(*(clean(F.col(f"`{there[h.strip().lower()]}`")).alias(target) for target, (h, clean) in columns.items()))


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one large array of objects; line-delimited files should use ``json_lines``, which can be split."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def extended_scalar(c: Column) -> Column:
    """Scalar of an extended-JSON text such as {"$numberLong": "9"}; other text as it is."""
    inner = F.coalesce(*(F.get_json_object(c, f"$['{k}']") for k in ("$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$date", "$oid")))
    return F.when(c.startswith("{"), inner).otherwise(c)


def deduplicated(spark: SparkSession, paths: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Parquet files, each without its own repeats of the key, one after the other."""
    found = None
    for p in paths:
        rows = spark.read.parquet(p).dropDuplicates(list(key))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def unzipped(spark: SparkSession, path: str, pick: str = r"\.csv$") -> DataFrame:
    """(path, member, size, content) of the members of ZIP files that match, largest first within a file."""
    return members(spark.read.format("binaryFile").load(path), pick)


def members(files: DataFrame, pick: str = r"\.csv$") -> DataFrame:
    """As ``unzipped``, of files that are at hand as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(name, i.filename, i.file_size, z.read(i)) for i in z.infolist() if re.search(pick, i.filename, re.I)]
                yield pd.DataFrame(sorted(rows, key=lambda r: (-r[2], r[1])), columns=["path", "member", "size", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, size long, content binary")


def xlsx(spark: SparkSession, path: str, header_row: int = 2) -> DataFrame:
    """(path, row, cells) of the first sheet of the XLSX files at ``path``."""
    return xlsx_rows(spark.read.format("binaryFile").load(path), header_row)


def xlsx_rows(files: DataFrame, header_row: int = 2) -> DataFrame:
    """(path, row, cells) of the first sheet of workbooks (path, content), cells by column name of the header row."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def sheet(content: bytes) -> list[tuple[int, dict[str, str]]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")] if "xl/sharedStrings.xml" in names else []
            first = min(n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml", n))
            rows: list[tuple[int, dict[str, str]]] = []
            for k, row in enumerate(ElementTree.fromstring(z.read(first)).iter(f"{main}row"), 1):
                cells = {}
                for c in row.iter(f"{main}c"):
                    v, text = c.find(f"{main}v"), "".join(t.text or "" for t in c.iter(f"{main}t"))
                    cells[re.sub(r"\d", "", c.get("r", ""))] = shared[int(v.text)] if c.get("t") == "s" and v is not None else text or (v.text if v is not None else "")
                rows.append((int(row.get("r", k)), cells))
        head = next((cells for n, cells in rows if n == header_row), {})
        names_ = dict(zip(head, header_names(list(head.values()))))
        return [(n, {names_[c]: v for c, v in cells.items() if c in names_}) for n, cells in rows if n > header_row]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content):
                rows = sheet(content)
                yield pd.DataFrame({"path": [name] * len(rows), "row": [r[0] for r in rows], "cells": [r[1] for r in rows]})

    return files.select("path", "content").mapInPandas(run, "path string, row int, cells map<string,string>")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Rows of a large XML file by their tag; attributes are columns with _ in front."""
    return spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)


REGISTRY = T.StructType([
    T.StructField("_corporationId", T.StringType()),
    T.StructField("names", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_current", T.BooleanType())]))),
    T.StructField("statuses", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_code", T.StringType()), T.StructField("_current", T.BooleanType())]))),
    T.StructField("activities", T.ArrayType(T.StructType([T.StructField("_date", T.StringType()), T.StructField("_code", T.StringType())]))),
])


def registry_rows(rows: DataFrame) -> DataFrame:
    """(corporation_id, name, status_code, last_activity, last_activity_code): the current elements and the latest activity."""
    current = lambda c: F.get(F.filter(c, lambda x: x["_current"]), F.lit(0))
    last = F.array_max(F.transform("activities", lambda a: F.struct(F.try_to_date(F.left(a["_date"], F.lit(10)), "yyyy-MM-dd").alias("d"), a["_code"].alias("c"))))
    return rows.select(F.col("_corporationId").alias("corporation_id"), F.trim(current("names")["_VALUE"]).alias("name"), current("statuses")["_code"].alias("status_code"), last["d"].alias("last_activity"), last["c"].alias("last_activity_code"))


def decode_entities(text: Column) -> Column:
    """The common character references of feeds."""
    for ref, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(sign))
    return text


def strip_markup(text: Column) -> Column:
    """Text without tags and CDATA frames, references decoded, spacing made one."""
    plain = F.regexp_replace(F.regexp_replace(text, r"<!\[CDATA\[|\]\]>", ""), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(plain), r"\s+", " "))


def tag_text(text: Column, tag: str) -> Column:
    """Inner markup of the first element of a name; null if there is none."""
    found = F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.when(text.rlike(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>"), found)


def feed_items(rows: DataFrame, body: str, tag: str = "item", fields: Sequence[str] = ("title", "link", "description", "pubDate")) -> DataFrame:
    """One row per item of a feed with its fields as plain text."""
    items = rows.select(F.explode(F.regexp_extract_all(F.col(body), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)).alias("_item"))
    return items.select(*(strip_markup(tag_text(F.col("_item"), f)).alias(f) for f in fields))


def offsets_to_fetch(spark: SparkSession, total: int, page_size: int, landed: DataFrame | None = None) -> DataFrame:
    """(offset, limit) of the pages of an API that have not landed yet; a restarted load asks for the rest only."""
    pages = spark.range(0, max(0, -(-total // page_size))).select((F.col("id") * page_size).alias("offset"), F.lit(page_size).alias("limit"))
    return pages if landed is None else pages.join(landed.select("offset").distinct(), "offset", "left_anti")


def fetch_pages(pages: DataFrame, fetch: Callable[[int, int], str], tries: int = 5, pause: float = 0.5) -> DataFrame:
    """(offset, body) by calling ``fetch(offset, limit)`` in tasks, with growing pauses between tries; the last error is raised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            bodies = []
            for offset, limit in zip(batch.offset, batch.limit):
                for k in range(tries):
                    try:
                        bodies.append(fetch(int(offset), int(limit)))
                        break
                    except OSError:
                        if k + 1 == tries:
                            raise
                        time.sleep(pause * 2**k)
            yield pd.DataFrame({"offset": batch.offset, "body": bodies})

    return pages.mapInPandas(run, "offset long, body string")


def sources_registry(spark: SparkSession, entries: Sequence[tuple[str, str, str, bool]]) -> DataFrame:
    """Manifest of sources: (name, url, format, required)."""
    return spark.createDataFrame(entries, "name string, url string, format string, required boolean")


def catalogue(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(table_name, there, columns) of the named tables and views, as the catalogue has them."""
    there = {n: spark.catalog.tableExists(n) for n in names}
    return spark.createDataFrame([(n, ok, len(spark.catalog.listColumns(n)) if ok else None) for n, ok in there.items()], "table_name string, there boolean, columns long")


def json_items(bodies: DataFrame, body: str, items: str, item: str) -> DataFrame:
    """One row per item of the list ``items`` of JSON answers, beside the other columns; an answer that is no JSON has none. ``item``: an item's columns."""
    read = F.from_json(F.col(body), f"struct<`{items}`: array<struct<{item}>>>")[items]
    return bodies.select(*(c for c in bodies.columns if c != body), F.explode(read).alias("item")).select(*(c for c in bodies.columns if c != body), "item.*")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), counted in one job."""
    found = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        found = one if found is None else found.unionByName(one)
    return found
