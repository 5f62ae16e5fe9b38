"""Request files: JSONL in, plan and result files out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import materialize, small_side

KEEP_NULLS = {"ignoreNullFields": "false"}


def read_requests(spark: SparkSession, path: str, file_id=None) -> DataFrame:
    """Every line of every JSONL file with its number and byte position.

    Columns: file_id, line_no (from 1), byte_offset, byte_len, value. A blank line is a line;
    an unterminated last line is one too and is counted with its newline.
    """
    return number_lines(with_source(spark.read.option("lineSep", "\n").text(path)), file_id)


def with_source(lines: DataFrame) -> DataFrame:
    """Text lines with the file and the split they come from."""
    return lines.select(
        F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), "value"
    )


def number_lines(raw: DataFrame, file_id=None) -> DataFrame:
    """Number text lines within their files without shuffling the text.

    A large file is read as several splits, each by one task from front to back. Lines and
    bytes are counted on inside the split as the lines stream by, and the totals of the
    file's earlier splits are added. A window would say the same but sort and shuffle all
    request bodies for it.
    """
    schema = "__path string, __start long, value string, __n long, __b long, byte_len long"
    inside = raw.select("__path", "__start", "value").mapInArrow(_count_on, schema)
    totals = materialize(
        raw.groupBy("__path", "__start").agg(
            F.count(F.lit(1)).alias("__lines"), F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("__bytes")
        ),
        "splits",
    )
    before = W.partitionBy("__path").orderBy("__start").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        "__path",
        "__start",
        F.coalesce(F.sum("__lines").over(before), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__b0"),
    ).filter("__n0 > 0")
    name = file_id(F.col("__path")) if file_id else F.col("__path")
    return inside.join(small_side(bases), ["__path", "__start"], "left").select(
        name.alias("file_id"),
        (F.col("__n") + F.coalesce("__n0", F.lit(0))).alias("line_no"),
        (F.col("__b") + F.coalesce("__b0", F.lit(0))).alias("byte_offset"),
        "byte_len",
        "value",
    )


def _count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line number and byte offset inside each split, carried across Arrow batches."""
    split, lines, size = None, 0, 0
    for batch in batches:
        paths, starts, values = batch.columns
        length = pc.add(pc.cast(pc.binary_length(values), pa.int64()), 1).to_numpy()
        code = paths.dictionary_encode().indices.to_numpy()
        start = starts.to_numpy()
        edges = np.flatnonzero((np.diff(code) != 0) | (np.diff(start) != 0)) + 1
        number, offset = np.empty(len(length), "int64"), np.empty(len(length), "int64")
        for lo, hi in zip(np.append(0, edges), np.append(edges, len(length))):
            if hi == lo:
                continue
            here = (paths[int(lo)].as_py(), int(start[lo]))
            if here != split:
                split, lines, size = here, 0, 0
            number[lo:hi] = lines + 1 + np.arange(hi - lo)
            ends = size + np.cumsum(length[lo:hi])
            offset[lo:hi] = ends - length[lo:hi]
            lines, size = lines + int(hi - lo), int(ends[-1])
        yield pa.RecordBatch.from_arrays(
            [paths, starts, values, pa.array(number), pa.array(offset), pa.array(length)],
            names=["__path", "__start", "value", "__n", "__b", "byte_len"],
        )


def write_plan(plan: DataFrame, path: str) -> None:
    """Plan as Parquet, ordered by job, model and prefix hash.

    Range partitioning with the line number as tie-breaker keeps one hot system prompt from
    filling a single task; readers get equal prompts next to each other.
    """
    order = ["job_id", "model", "prefix_hash", "line_no"]
    plan.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("error").parquet(path)


def result_lines(results: DataFrame) -> DataFrame:
    """Result rows as `{id, custom_id, response, error}` JSON text, nulls written out.

    The response body is JSON already, so it is spliced into the text instead of being
    encoded a second time.
    """
    def open_object(*columns) -> Column:
        """JSON object text without its closing brace."""
        return F.regexp_replace(F.to_json(F.struct(*columns), KEEP_NULLS), r"\}$", "")

    head = open_object(F.col("request_id").alias("id"), "custom_id")
    envelope = open_object(
        F.col("response.status_code").alias("status_code"), F.col("response.request_id").alias("request_id")
    )
    body = F.coalesce(F.col("response.body"), F.lit("null"))
    response = F.when(
        F.col("response").isNotNull(), F.concat(envelope, F.lit(',"body":'), body, F.lit("}"))
    ).otherwise(F.lit("null"))
    error = F.when(F.col("error").isNotNull(), F.to_json("error", KEEP_NULLS)).otherwise(F.lit("null"))
    line = F.concat(head, F.lit(',"response":'), response, F.lit(',"error":'), error, F.lit("}"))
    return results.select("job_id", F.col("error").isNotNull().alias("is_error"), line.alias("value"))


def write_results(results: DataFrame, path: str, mode: str = "error", placed: bool = False) -> None:
    """Output and error files below `path`, one folder per kind and job.

    A row with an error goes to the error files; everything else, other HTTP codes included,
    goes to the output files. A job without rows of a kind gets no folder of that kind.
    `placed` says that the rows of a job lie together already, which saves moving every text.
    """
    lines = result_lines(results).withColumn("kind", F.when(F.col("is_error"), "error").otherwise("output"))
    # Rebalancing brings a job's lines together and splits a job too large for one task.
    together = lines if placed else lines.hint("rebalance", F.col("kind"), F.col("job_id"))
    together.select("kind", "job_id", "value").write.mode(mode).partitionBy("kind", "job_id").text(path)


def result_files(results: DataFrame) -> DataFrame:
    """Per job: rows and bytes of the output and error files, and their ids where they exist."""
    lines = result_lines(results)
    size = (F.octet_length("value") + 1).cast("long")
    out, err = ~F.col("is_error"), F.col("is_error")
    return (
        lines.groupBy("job_id")
        .agg(
            F.count_if(out).alias("output_rows"),
            F.count_if(err).alias("error_rows"),
            F.coalesce(F.sum(F.when(out, size)), F.lit(0)).alias("output_bytes"),
            F.coalesce(F.sum(F.when(err, size)), F.lit(0)).alias("error_bytes"),
        )
        .withColumns(
            {
                "output_file_id": F.when(F.col("output_rows") > 0, S.file_id(F.lit("output"), "job_id")),
                "error_file_id": F.when(F.col("error_rows") > 0, S.file_id(F.lit("error"), "job_id")),
            }
        )
    )


def request_lines(requests: DataFrame) -> DataFrame:
    """Request columns as compact JSON text: one workload line per row.

    Needs custom_id, method, url, model and the two prompts; `stream` and `max_tokens` are
    written when present.
    """
    message = [
        F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("user_prompt").alias("content")),
    ]
    optional = [F.col(c).alias(c) for c in ("stream", "max_tokens") if c in requests.columns]
    body = F.struct(F.col("model").alias("model"), *optional, F.array(*message).alias("messages"))
    text = F.to_json(F.struct("custom_id", "method", "url", body.alias("body")))
    kept = [c for c in requests.columns if c in ("file_id", "job_id", "tenant_id", "line_no")]
    return requests.select(*kept, text.alias("value"))


def write_workload(lines: DataFrame, path: str, rows_per_file: int = 50000) -> None:
    """Workload lines as JSONL; no file exceeds the line limit of a request file."""
    lines.select("value").write.mode("error").option("maxRecordsPerFile", rows_per_file).text(path)
