"""Scans of series, snapshots, payloads and tables in files; what Spark's readers accept too easily is checked first."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.frames import SERIES
from tidewater.operators.series import numbered, require_valid

# The fields of a snapshot's metadata and rows, and the units and clock that it must have.
SNAPSHOT_FIELDS = ["source_url", "downloaded_at", "timezone", "hour_convention", "energy_unit", "price_unit", "weight_basis", "weight_explanation"]
GRID_ROW = (
    "date string, hour int, system string, status string, generation_mwh double, consumption_mwh double, ibr_rub_mwh double, "
    "balance_volume_mwh double, generation_missing_reason string, consumption_missing_reason string, ibr_missing_reason string"
)


SNAPSHOT_SETTINGS = {"timezone": "Europe/Moscow", "hour_convention": "interval_start_0_23", "energy_unit": "MWh", "price_unit": "RUB/MWh"}


def read_series(spark: SparkSession, path: str, columns: tuple[str, str], name: str = "series") -> DataFrame:
    """A CSV file with exactly the two columns as a valid monthly series; ValueError says what is wrong."""
    head = spark.read.option("header", "true").csv(path)
    if tuple(head.columns) != columns:
        raise ValueError(f"columns are {head.columns}, not {list(columns)}")
    rows = head.select(F.lit(name).alias(SERIES), F.trunc(F.expr(f"try_cast(`{columns[0]}` AS date)"), "month").alias("date"), F.expr(f"try_cast(`{columns[1]}` AS double)").alias("y"))
    if rows.isEmpty():
        raise ValueError("no rows")
    return numbered(require_valid(rows))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or the first sheet of an XLSX workbook, all columns as text under their headings."""
    if not path.lower().endswith(".xlsx"):
        return spark.read.option("header", "true").csv(path)
    rows = read_sheet(path)
    head = [str(c) for c in rows[0]]
    return spark.createDataFrame([[None if v is None else str(v) for v in (r + [None] * len(head))[: len(head)]] for r in rows[1:]], ", ".join(f"`{c}` string" for c in head))


def read_sheet(path: str, sheet: int = 1) -> list[list[str | float | None]]:
    """Cells of a worksheet by row."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", space)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", space)]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for row in root.iterfind(".//m:row", space):
        cells: list[str | float | None] = []
        for c in row.iterfind("m:c", space):
            at = 0
            for letter in re.match(r"[A-Z]+", c.get("r", ""))[0]:
                at = at * 26 + ord(letter) - 64
            cells += [None] * (at - len(cells))
            value, kind = c.find("m:v", space), c.get("t")
            if kind == "inlineStr":
                cells[at - 1] = "".join(t.text or "" for t in c.iterfind(".//m:t", space))
            elif value is not None and value.text is not None:
                cells[at - 1] = shared[int(value.text)] if kind == "s" else value.text if kind == "str" else float(value.text)
        out.append(cells)
    return out


def strict_json(text: str):
    """json.loads that refuses repeated keys, NaN and Infinity."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise ValueError("a key is repeated")
        return dict(items)

    def constant(name):
        raise ValueError(f"{name} is no number")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def read_snapshot(spark: SparkSession, path: str, settings: dict[str, str] | None = None) -> tuple[DataFrame, dict, str]:
    """(rows, metadata, SHA-256) of a snapshot file; required metadata are texts that are not blank, and those of settings
    (SNAPSHOT_SETTINGS, for one) have just these values."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    data = strict_json(bytes(raw).decode("utf-8"))
    if not isinstance(data, dict) or not isinstance(data.get("metadata"), dict) or not isinstance(data.get("rows"), list):
        raise ValueError("a snapshot has metadata and rows")
    meta = data["metadata"]
    lacking = [k for k in SNAPSHOT_FIELDS if not isinstance(meta.get(k), str) or not meta[k].strip()]
    if lacking:
        raise ValueError(f"metadata lack {lacking}")
    other = {k: meta[k] for k, v in (settings or {}).items() if meta[k] != v}
    if other:
        raise ValueError(f"metadata have {other}")
    if "synthetic" in meta and type(meta["synthetic"]) is not bool:
        raise ValueError("synthetic is true or false")
    names = [f.strip().split(" ")[0] for f in GRID_ROW.split(",")]
    for r in data["rows"]:
        if type(r.get("hour")) is not int:
            raise ValueError("hour is a whole number")
    rows = [tuple(float(v) if isinstance(v := r.get(n), int) and n.endswith("mwh") else v for n in names) for r in data["rows"]]
    return spark.createDataFrame(rows, GRID_ROW), meta, hashlib.sha256(bytes(raw)).hexdigest()


def decoded_groups(payloads: DataFrame, column: str, item: str) -> DataFrame:
    """Rows (id, fields...) of payloads [{m_Item1: id, m_Item2: [fields]}]; groups without an id are left out.

    item is the fields' schema. ValueError if a payload cannot be read or repeats an id.
    """
    kind = f"array<struct<m_Item1:long,m_Item2:array<struct<{item}>>>>"
    read = payloads.select(F.monotonically_increasing_id().alias("_p"), F.from_json(column, kind, {"mode": "PERMISSIVE"}).alias("_g"))
    if not read.filter("_g IS NULL").isEmpty():
        raise ValueError("a payload is not a list of groups")
    groups = read.select("_p", F.explode("_g").alias("_x")).select("_p", F.col("_x.m_Item1").alias("id"), F.col("_x.m_Item2").alias("_i")).filter("id IS NOT NULL")
    if not groups.groupBy("_p", "id").count().filter("count > 1").isEmpty():
        raise ValueError("an id is repeated")
    return groups.select("id", F.inline("_i"))


def require_fields(payloads: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """payloads, whose column is a JSON object, or ValueError if one lacks a field; a field that is null is there."""
    keys = F.json_object_keys(column)
    lacking = payloads.filter(F.coalesce(F.size(F.array_except(F.array(*map(F.lit, fields)), keys)) > 0, F.lit(True)))
    if not lacking.isEmpty():
        raise ValueError(f"{lacking.count()} objects lack one of {', '.join(fields)}")
    return payloads


def inventory_of_folder(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """inventory() of a folder's tables on the driver: their dates by the usual names, and whatever numbers they have."""
    from pathlib import Path

    from tidewater.operators.series import parsed_date
    from tidewater.sources.macro import date_column, numeric_columns

    tables = {}
    for path in sorted(Path(folder).glob(pattern)):
        rows = read_table(spark, str(path))
        dates = date_column(rows.columns, numeric_columns(rows))
        tables[path.name] = rows.select(parsed_date(F.col(f"`{dates}`")).alias("date")).filter("date IS NOT NULL")
    if not tables:
        raise ValueError("the folder has no such tables")
    return inventory(tables)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Of each (date, value) table: first and last date, repeated dates, rows beyond one a month, missing months."""
    out = None
    for name, t in tables.items():
        m = t.select(F.trunc("date", "month").alias("m"), "date")
        got = m.agg(
            F.lit(name).alias("name"),
            F.min("date").alias("first"),
            F.max("date").alias("last"),
            (F.count("date") - F.countDistinct("date")).alias("repeated"),
            (F.count("m") - F.countDistinct("m")).alias("extra"),
            F.array_sort(F.array_except(F.sequence(F.min("m"), F.max("m"), F.expr("interval 1 month")), F.collect_set("m"))).alias("_missing"),
        )
        got = got.select("name", "first", "last", "repeated", "extra", F.array_join(F.transform("_missing", lambda d: F.date_format(d, "yyyy-MM")), ";").alias("missing"))
        out = got if out is None else out.unionByName(got)
    return out


def wsdl_operations(documents: DataFrame, column: str) -> DataFrame:
    """column with operations, the distinct names of port type operations in WSDL texts; null where a DTD is declared."""
    path = "//*[local-name()='portType']/*[local-name()='operation']/@name"
    safe = ~F.col(column).rlike("(?i)<!DOCTYPE|<!ENTITY")
    return documents.withColumn("operations", F.when(safe, F.array_distinct(F.xpath(column, F.lit(path)))))
