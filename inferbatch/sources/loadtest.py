"""Load-test inputs: summary CSV files and metric samples."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import SAMPLE

CELL = "path string, stem string, i int, category string, unit string, stat string, value string"


def _file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Columns of each file as rows: three header cells and the data cell.

    Files are one line of results each. A file without a data row gives one empty cell, so
    that its phase still appears.
    """
    for batch in batches:
        rows = []
        for path, stem, text in zip(batch["path"], batch["stem"], batch["value"]):
            lines = list(csv.reader(io.StringIO(text)))
            if len(lines) < 4:
                rows.append((path, stem, -1, "", "", "", None))
                continue
            width = min(len(line) for line in lines[:3])
            for i in range(width):
                cell = lines[3][i] if i < len(lines[3]) else None
                rows.append((path, stem, i, lines[0][i], lines[1][i], lines[2][i], cell))
        yield pd.DataFrame(rows, columns=["path", "stem", "i", "category", "unit", "stat", "value"])


def read_phase_csv(spark: SparkSession, path: str, stem: Callable[[Column], Column] = _file_stem) -> DataFrame:
    """Phase metrics from load-test summary files, one row per file.

    A file has three header rows and one data row; percentiles are lists of the 11 deciles.
    Phase and cycle come from the file name (`burst-1`). Files of the same name in several
    folders are rows of their own, told apart by `folder`.
    """
    whole = spark.read.text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    named = whole.select(file.alias("path"), stem(file).alias("stem"), "value")
    return phase_metrics(named.mapInPandas(_cells, CELL))


def phase_metrics(cells: DataFrame) -> DataFrame:
    """Phase metrics from cells; the first column that matches a header pattern is read."""

    def cell(category: str, unit: str, stat: str) -> Column:
        hit = F.col("category").contains(category)
        hit = hit & (F.col("unit").contains(unit) if unit else F.col("unit") == "")
        hit = hit & (F.col("stat").contains(stat) if stat else F.trim("stat") == "")
        return F.min_by("value", F.when(hit, F.col("i")))

    # Header texts of the summary format, and the factor to milliseconds.
    families = {
        "ttft": ("Time to First Token", "Successful ms", 1.0),
        "tpot": ("Time per Output Token", "Successful ms", 1.0),
        "itl": ("Inter Token Latency", "Successful ms", 1.0),
        "req_latency": ("Request Latency", "Successful Sec", 1000.0),
    }
    picked = [
        cell("Request Counts", "Successful", "").alias("__ok"),
        cell("Request Counts", "Errored", "").alias("__bad"),
        cell("Request Counts", "Total", "").alias("__all"),
        cell("Timings", "Duration", "Sec").alias("__secs"),
    ]
    for name, (category, unit, _) in families.items():
        picked.append(cell(category, unit, "Median").alias(f"__{name}_median"))
        picked.append(cell(category, unit, "Percentiles").alias(f"__{name}_deciles"))
    wide = cells.groupBy("path", "stem").agg(*picked)

    def number(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name).try_cast("double"), F.lit(default))

    def deciles(name: str) -> Column:
        text = F.translate(F.col(name), "()", "[]")
        return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))

    metrics = []
    for name, (_, _, factor) in families.items():
        metrics.append((number(f"__{name}_median") * factor).alias(f"{name}_p50"))
        for p in (95, 99):
            metrics.append((S.interpolate_decile(deciles(f"__{name}_deciles"), p) * factor).alias(f"{name}_p{p}"))
    ok, bad, total = (number(c).cast("long") for c in ("__ok", "__bad", "__all"))
    seconds = number("__secs", 1.0)

    def per(count: Column, by: Column) -> Column:
        return F.when(by > 0, count / by).otherwise(F.lit(0.0))

    return wide.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"),
        S.phase_name("stem").alias("phase"),
        S.phase_cycle("stem").alias("cycle"),
        *metrics,
        per(ok, seconds).alias("ok_rps"),
        per(bad, seconds).alias("err_rps"),
        per(bad, total).alias("error_rate"),
        ok.alias("completed"),
        bad.alias("errors"),
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Metric range samples without NaN values."""
    return spark.read.schema(SAMPLE).parquet(path).filter(~F.isnan("value"))
