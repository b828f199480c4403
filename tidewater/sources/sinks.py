"""Reports and bundles written by the driver: Markdown, JSON lineage, workbooks, atomic publishing, index generations."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
import zipfile
from datetime import UTC, datetime
from pathlib import Path
from xml.sax.saxutils import escape

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MOST_HOURS = 366 * 24


def markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small result as a Markdown table; ValueError if it has more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header, in a folder that must not exist."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("header", "true").csv(f"{folder}/{name}")


def lineage(inputs: list[str], settings: dict) -> dict:
    """What a run was made from: files with their hashes, versions, settings."""
    return {
        "created_at": datetime.now(UTC).isoformat(),
        "spark": pyspark.__version__,
        "inputs": {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in inputs},
        "settings": settings,
    }


def append_metrics(df: DataFrame, path: str, fields: list[str]) -> None:
    """JSON lines of the named fields alone."""
    df.select(*fields).write.mode("append").json(path)


def column_name(i: int) -> str:
    out = ""
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


class Formula:
    """A cell's formula with the value that it has."""

    def __init__(self, text: str, value: float | str | None):
        self.text, self.value = text, value


# The texts of formulas and, in write_workbook, the names and namespaces of a workbook's parts.
def strict_sum_formula(cells: str, size: int) -> str:
    """The sum of cells, or an empty text unless all are numbers."""
    return f'IF(COUNT({cells})={size},SUM({cells}),"")'


def strict_mean_formula(values: str, weights: str, size: int) -> str:
    return f'IF(AND(COUNT({values})={size},COUNT({weights})={size},SUM({weights})>0),SUMPRODUCT({values},{weights})/SUM({weights}),"")'


def write_workbook(sheets: dict[str, list[list]], path: str) -> None:
    """Sheets of rows of numbers, texts, None and Formula."""

    def cell(r: int, c: int, v) -> str:
        at = f'r="{column_name(c)}{r}"'
        if v is None:
            return ""
        if isinstance(v, Formula):
            if v.value is None or isinstance(v.value, str):
                return f'<c {at} t="str"><f>{escape(v.text)}</f><v>{escape(v.value or "")}</v></c>'
            return f"<c {at}><f>{escape(v.text)}</f><v>{v.value!r}</v></c>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c {at}><v>{v!r}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    n = range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships">'
        + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        + "</Relationships>",
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
        + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, sheets, strict=True))
        + "</sheets></workbook>",
    }
    for i, rows in zip(n, sheets.values(), strict=True):
        body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)


def export_grid(wide: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each wide table (date, hour, systems..., total); totals are strict sums with
    their formulas. ValueError for a table of more than MOST_HOURS rows, a leap year of hours."""
    sheets = {}
    for name, df in wide.items():
        systems = [c for c in df.columns if c not in ("date", "hour", "total")]
        rows: list[list] = [["date", "hour", *systems, "total"]]
        found = df.orderBy("date", "hour").limit(MOST_HOURS + 1).collect()
        if len(found) > MOST_HOURS:
            raise ValueError(f"{name} has more than {MOST_HOURS} rows")
        for r, row in enumerate(found, 2):
            cells = f"C{r}:{column_name(2 + len(systems))}{r}"
            rows.append([str(row["date"]), row["hour"], *[row[s] for s in systems], Formula(strict_sum_formula(cells, len(systems)), row["total"] if row["total"] is not None else "")])
        sheets[name] = rows
    write_workbook(sheets, path)


def publish(files: dict[str, bytes], folder: str, last: str, overwrite: bool = False) -> Path | None:
    """All files or none: staged, then moved, `last` at the end; on a failure what was there comes back. Without overwrite a file that is there, or that another
    writer puts there meanwhile, is an error. What was overwritten stays in the folder that is returned."""
    target, stage = Path(folder), Path(folder, f".stage-{uuid.uuid4().hex}")
    there = [n for n in files if (target / n).exists()]
    if there and not overwrite:
        raise FileExistsError(", ".join(there))
    old = target / f".backup-{datetime.now(UTC):%Y%m%dT%H%M%S%f}"
    stage.mkdir(parents=True)
    moved: list[str] = []
    try:
        for n, data in files.items():
            (stage / n).write_bytes(data)
        for n in sorted(files, key=lambda n: n == last):
            if overwrite and (target / n).exists():
                old.mkdir(exist_ok=True)
                os.replace(target / n, old / n)
            os.link(stage / n, target / n)  # fails if another writer was first
            moved.append(n)
    except BaseException:
        for n in files:
            if n in moved:
                (target / n).unlink(missing_ok=True)
            if (old / n).exists():
                os.replace(old / n, target / n)
        if old.exists():
            old.rmdir()
        raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return old if old.exists() else None


def _file(spark, path: str):
    """(file system, path) of a file in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write(spark, path: str, text: str) -> None:
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]).decode()


def _digest(rows: DataFrame) -> str:
    """A number of the rows that does not depend on their order."""
    return str(rows.agg(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first()[0])


def save_index(chunks: DataFrame, vectors: DataFrame, folder: str, model: str) -> dict:
    """A generation of an index: chunks (id, ...) with unit vectors (id, v) as Parquet, named by a manifest that is written last. The folder may be in any
    store. ValueError for repeated ids, ids without a vector, or vectors of no length, of other lengths or not finite."""
    spark = chunks.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = F.greatest(F.sqrt(square), F.lit(1e-12))
    rows = chunks.join(vectors.select("id", F.transform("v", lambda x: (x / norm).cast("float")).alias("v"), norm.alias("_n")), "id", "left")
    odd = F.col("v").isNull() | (F.col("_n") <= 1e-12) | F.isnan("_n") | (F.col("_n") == float("inf"))
    seen = rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(odd).alias("bad"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if not seen["n"] or seen["n"] != seen["ids"] or seen["bad"] or seen["least"] != seen["most"]:
        raise ValueError(f"{seen['n'] - seen['ids']} repeated ids, {seen['bad']} ids without a vector, lengths {seen['least']} to {seen['most']}")
    generation = uuid.uuid4().hex
    rows.drop("_n").write.parquet(f"{folder}/{generation}")
    stored = spark.read.parquet(f"{folder}/{generation}")
    manifest = {"version": 1, "generation": generation, "model": model, "count": seen["n"], "dim": seen["most"], "digest": _digest(stored)}
    _write(spark, f"{folder}/manifest.json", json.dumps(manifest))
    return manifest


def load_index(spark, folder: str) -> DataFrame:
    """The generation that the manifest names; ValueError if it is not as the manifest says: rows, hashes, lengths of vectors."""
    manifest = json.loads(_read(spark, f"{folder}/manifest.json"))
    name = manifest.get("generation", "")
    if manifest.get("version") != 1 or not name.isalnum():
        raise ValueError("the manifest cannot be used")
    rows = spark.read.parquet(f"{folder}/{name}")
    seen = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("v") != manifest["dim"], F.lit(True))).alias("bad")).first()
    if seen["n"] != manifest["count"] or seen["bad"] or _digest(rows) != manifest["digest"]:
        raise ValueError("the index is not whole")
    return rows
