"""Ragged sheets ``(file, row_no, cells ARRAY<STRING>)`` to rows, by expressions over the cell arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scan


def cell(i: int | Column) -> Column:
    return F.trim(F.coalesce(F.get("cells", F.lit(i) if isinstance(i, int) else i), F.lit("")))


def fixed_offsets(sheet: DataFrame, start: int, columns: dict[str, int], serial: int | None = None, header_words: tuple[str, ...] = ()) -> DataFrame:
    """Rows from ``start`` on, columns by position; with ``serial`` only rows whose cell there is a number."""
    rows = sheet.where(F.col("row_no") >= start)
    if serial is not None:
        rows = rows.where(cell(serial).rlike("^\\d+$"))
    first = next(iter(columns.values()))
    rows = rows.where((cell(first) != "") & ~F.lower(cell(first)).isin(*header_words, "\0"))
    return rows.select("file", "row_no", *[cell(i).alias(k) for k, i in columns.items()])


def keyword_columns(cells: Column, keywords: dict[str, str]) -> Column:
    """Struct of the first position whose cell contains each keyword, or null."""
    where = lambda w: F.nullif(F.array_position(F.transform(cells, lambda c: F.contains(F.lower(c), F.lit(w.lower()))), True) - 1, F.lit(-1).cast("bigint"))
    return F.struct(*[where(w).cast("int").alias(k) for k, w in keywords.items()])


def under_headers(sheet: DataFrame, marker: str, keywords: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Every row that contains ``marker`` is a header and maps the columns of the rows behind it, within its file.

    The last header is carried forward over a file's rows wherever they lie, so a large sheet is many tasks."""
    is_header = F.exists("cells", lambda c: F.contains(F.lower(c), F.lit(marker.lower())))
    where = keyword_columns(F.col("cells"), keywords)
    tagged = sheet.select("file", "row_no", "cells", is_header.alias("_is"), F.when(is_header, F.array(*[where[k] for k in keywords])).alias("_h"))
    rows = scan.carried(scan.ordered(tagged, ["file"], ["row_no"], partitions), ["file"], "_h", "_m").where(~F.col("_is") & F.col("_m").isNotNull())
    return rows.select("file", "row_no", *[cell(F.get("_m", F.lit(i))).alias(k) for i, k in enumerate(keywords)]).where(" or ".join(f"{k} <> ''" for k in keywords))


def side_by_side(sheet: DataFrame, blocks: list[dict[str, int]], stop: str, start: int = 0) -> DataFrame:
    """Blocks of columns beside each other become rows, up to the first row of the file that contains ``stop``."""
    ends = sheet.where(F.exists("cells", lambda c: F.contains(F.lower(c), F.lit(stop.lower())))).groupBy("file").agg(F.min("row_no").alias("_end"))
    rows = sheet.join(ends, "file", "left").where((F.col("row_no") >= start) & (F.col("_end").isNull() | (F.col("row_no") < F.col("_end"))))
    parts = F.array(*[F.struct(F.lit(n).alias("block"), *[cell(i).alias(k) for k, i in b.items()]) for n, b in enumerate(blocks)])
    first = next(iter(blocks[0]))
    return rows.select("file", "row_no", F.inline(parts)).where(F.col(first) != "")


def by_pattern(sheet: DataFrame, part_words: tuple[str, ...] = ("root", "leaf", "seed"), methods: tuple[str, ...] = ("hplc", "uv", "gc")) -> DataFrame:
    """Drifting columns by shape: the product is the first cell with a parenthesis, the assay the first with a percent sign,
    the marker the first of letters only that is neither part nor method."""
    first = lambda f: F.get(F.filter("cells", f), F.lit(0))
    words = F.array(*[F.lit(x) for x in (*part_words, *methods)])
    return sheet.select(
        "file", "row_no", first(lambda c: F.contains(c, F.lit("("))).alias("label"), first(lambda c: F.contains(c, F.lit("%"))).alias("assay_raw"),
        first(lambda c: c.rlike("^[A-Za-z ]+$") & ~F.array_contains(words, F.lower(F.trim(c)))).alias("marker"),
        first(lambda c: F.array_contains(F.array(*[F.lit(x) for x in part_words]), F.lower(F.trim(c)))).alias("part_text"),
    ).where("label is not null")
