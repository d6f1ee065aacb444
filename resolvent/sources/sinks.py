"""Sinks: artifacts with a meta row, minimal payloads and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_artifact(df: DataFrame, root: str, name: str, version: str, meta: dict[str, str] | None = None) -> None:
    """Parquet under ``root/name/version=...`` and a one-row meta table beside it; a version is written once."""
    df.write.mode("errorifexists").parquet(f"{root}/{name}/version={version}")
    one = df.sparkSession.range(1).select(F.lit(name).alias("artifact"), F.lit(version).alias("version"), *[F.lit(v).alias(k) for k, v in (meta or {}).items()])
    one.write.mode("errorifexists").json(f"{root}/{name}-meta/version={version}")


def minimal_payload(df: DataFrame, keep: list[str]) -> DataFrame:
    """One JSON text per row with the allowed columns alone; nulls, empty arrays and false flags are left out."""
    slim = []
    for f in df.select(*keep).schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            c = F.when(F.size(c) > 0, c)
        elif f.dataType.typeName() == "boolean":
            c = F.when(c, c)
        slim.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*slim), {"ignoreNullFields": "true"}).alias("payload"))


def markdown_report(spark: SparkSession, title: str, metrics: DataFrame, most: int = 200) -> str:
    """A table of a metrics frame; more than ``most`` rows are no report and raise."""
    rows = metrics.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    head = metrics.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"
