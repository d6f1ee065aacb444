"""Readers with explicit schemas: catalogues, JSON documents, wrapped literals, mappings, versioned artifacts, digests."""

from __future__ import annotations

import io
import itertools
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squeeze


def read_catalogue(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header: the byte order mark goes, ``type`` and ``title`` are found whatever their case, fields are trimmed,
    rows without a type or title are left out, and ``row_no`` orders the rows of a file."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    wanted = columns or {"type": "type", "title": "title"}
    names = {c.lstrip("\ufeff").strip().lower(): c for c in raw.columns}
    missing = [w for w in wanted.values() if w not in names]
    if missing:
        raise ValueError(f"columns {missing} are missing in {path}")
    out = raw.select(*[F.trim(F.col(f"`{names[w]}`")).alias(k) for k, w in wanted.items()], F.monotonically_increasing_id().alias("row_no"), F.input_file_name().alias("source_file"))
    return out.where(" and ".join(f"coalesce({k}, '') <> ''" for k in wanted))


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str, records: str | None = None) -> DataFrame:
    """A whole-file JSON document; with ``records``, one row for each element of that array."""
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return doc.select(F.inline(records)) if records else doc


def read_wrapped_literal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON assigned in a script: what follows the first ``=``, without a trailing semicolon."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_extract("value", "(?s)=(.*)$", 1), "\\s*;\\s*$", "")
    return text.select(F.from_json(body, schema).alias("v")).select("v.*")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``name -> accepted``; blank lines and lines without an arrow are skipped, the first arrow splits."""
    lines = spark.read.text(path).where(F.contains("value", F.lit("->")))
    parts = F.split("value", "->", 2)
    return lines.select(F.trim(parts[0]).alias("common_name"), F.trim(parts[1]).alias("accepted")).where("common_name <> '' and accepted <> ''")


def read_rows(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All row files that a glob names, each row with the file it comes from."""
    return spark.read.schema(schema).json(pattern).withColumn("source_file", F.input_file_name())


def read_versioned(spark: SparkSession, root: str, manifest: str = "manifest.json") -> dict[str, DataFrame]:
    """Artifacts of a manifest ``{artifact: version}`` under ``root/artifact/version=...``; raises where one is missing."""
    rows = spark.read.schema("artifact STRING, version STRING").json(f"{root}/{manifest}").where("artifact is not null").collect()
    if not rows:
        raise ValueError(f"no manifest under {root}")
    return {r["artifact"]: spark.read.parquet(f"{root}/{r['artifact']}/version={r['version']}") for r in rows}


def read_sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet as ``(file, row_no, cells ARRAY<STRING>)``, no-break spaces normalised: the first sheet of .xlsx files, or
    tab-separated text.  Raises where no file is found."""
    if path.lower().endswith(".xlsx"):
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
        return xlsx_cells(files)
    lines = spark.read.text(path)
    return lines.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row_no"), F.transform(F.split("value", "\t", -1), squeeze).alias("cells"))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


_RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _first_sheet(z: zipfile.ZipFile) -> str:
    """Path of the sheet that the workbook lists first; without such a list the sheet file of the smallest number."""
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        first = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"), None)
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets.get(first.get(_RELATED)) if first is not None else None
        if target:
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if path in names:
                return path
    sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    if not sheets:
        raise ValueError("the workbook has no sheet")
    return min(sheets, key=lambda n: int(re.sub(r"\D", "", n)))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    plain = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    own = {int(f.get("numFmtId", 0)) for f in root.iter(f"{_SHEET}numFmt") if re.search("[ymdhs]", plain(f.get("formatCode", "")), re.IGNORECASE)}
    kinds = root.find(f"{_SHEET}cellXfs")
    return {i for i, x in enumerate(kinds if kinds is not None else ()) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _shown(kind: str | None, style: int, text: str, strings: list[str], dates: set[int]) -> str:
    """A cell's value as text: shared strings, booleans by name, dates as ``YYYY-MM-DD HH:MM:SS``, anything else as it is."""
    if kind == "s" and text:
        return strings[int(text)]
    if kind == "b":
        return "True" if text == "1" else "False"
    if kind in (None, "n") and style in dates and text:
        return str(datetime(1899, 12, 30) + timedelta(seconds=round(float(text) * 86_400)))
    return text


def _sheet_rows(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """(row number, values) of a workbook's first sheet, read element by element."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if e.tag == f"{_SHEET}si":
                    strings.append("".join(t.text or "" for t in e.iter(f"{_SHEET}t")))
                    e.clear()
        dates = _date_styles(z)
        for _, e in ElementTree.iterparse(z.open(_first_sheet(z))):
            if e.tag != f"{_SHEET}row":
                continue
            cells: list[str] = []
            for c in e.iter(f"{_SHEET}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                cells += [""] * ((at or len(cells) + 1) - 1 - len(cells))
                kind, v = c.get("t"), c.find(f"{_SHEET}v")
                if kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{_SHEET}t")))
                else:
                    cells.append(_shown(kind, int(c.get("s", 0)), v.text or "" if v is not None else "", strings, dates))
            yield int(e.get("r", 0)), cells
            e.clear()


def xlsx_cells(files: DataFrame) -> DataFrame:
    """``files(file, content)``, whole workbooks -> ``(file, row_no, cells)`` of the sheets that they list first: values, booleans
    by name and dates as ``YYYY-MM-DD HH:MM:SS``.

    A workbook is read in one task; rows leave in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = _sheet_rows(content)
                while part := list(itertools.islice(rows, 5000)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([r for r, _ in part], pa.int64()), pa.array([c for _, c in part], pa.list_(pa.string()))], ["file", "row_no", "cells"])

    rows = files.select("file", "content").mapInArrow(run, "file string, row_no long, cells array<string>")
    return rows.select("file", "row_no", F.transform("cells", squeeze).alias("cells"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def authority_lookup(names: DataFrame, lookup: DataFrame) -> DataFrame:
    """An external authority as a materialised table: every distinct name once, with what the table has of it; of several
    answers to a name the one with the highest confidence holds.  ``known`` says whether there is any."""
    fields = [f for f in lookup.columns if f not in ("name", "confidence")]
    best = lookup.groupBy("name").agg(F.max_by(F.struct(*fields), F.struct(F.col("confidence"), *[F.col(f).cast("string") for f in fields])).alias("_b"))
    j = names.select("name").distinct().join(best, "name", "left")
    return j.select("name", *[F.col(f"_b.{f}").alias(f) for f in fields], F.col("_b").isNotNull().alias("known"))


class Adapters:
    """Registry of supplier adapters: name -> callable(spark, path) -> rows(label, latin, part_text, assay_raw, origin, row_no)."""

    COLUMNS = ("label", "latin", "part_text", "assay_raw", "origin", "row_no")

    def __init__(self) -> None:
        self._known: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def register(self, name: str):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            self._known[name] = f
            return f

        return add

    def extract(self, spark: SparkSession, name: str, path: str) -> DataFrame:
        rows = self._known[name](spark, path)
        for c in self.COLUMNS:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("bigint" if c == "row_no" else "string"))
        return rows.select(*self.COLUMNS, F.lit(name).alias("supplier_id"))

    def all(self, spark: SparkSession, paths: dict[str, str]) -> DataFrame:
        out = None
        for name, path in paths.items():
            rows = self.extract(spark, name, path)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no adapter was named")
        return out
