"""Scans and sinks of the engine: JSON arrays, JSON lines, registries, configurations, images."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.operators.guard import guard
from fidelis.operators.ranges import running

RAW = "question_id string, image_id string, question string, choices array<string>, correct_choice_idx int, rationales array<string>"


def raw_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON array files, one after another."""
    return spark.read.schema(RAW).json(paths, multiLine=True)


def is_torn(spark: SparkSession, path: str) -> bool:
    """Whether a file's last byte is no newline; only that byte is read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = fs.getFileStatus(where).getLen()
    if not n:
        return False
    stream = fs.open(where)
    try:
        stream.seek(n - 1)
        return stream.read() != 10
    finally:
        stream.close()


def json_lines(spark: SparkSession, path: str, schema: str = "key string, payload string") -> DataFrame:
    """A JSON-lines log of one file, by line; an unreadable line stops the run, a last one without newline is dropped.

    The file is split as Spark likes: a line's place is its block's offset and its order within the block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    tail = F.lit(False)
    if is_torn(spark, path):
        lines = lines.crossJoin(F.broadcast(lines.agg(F.max(F.struct("block", "nth")).alias("last"))))
        tail = F.struct("block", "nth") == F.col("last")
    # One test of both, for a filter of its own might be evaluated first.
    ok = F.try_parse_json("value").isNotNull() | tail
    parsed = guard(lines.select("block", "nth", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), tail.alias("tail"), ok.alias("ok")), F.col("ok"), "corrupt line inside the log")
    placed = running(parsed.where(~F.col("tail")), [F.col("block"), F.col("nth")], {"line_no": F.lit(1)})
    return placed.select("line_no", "r.*")


def registry(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Patterns of a small registry file in its order; blank lines and comments are skipped, an empty registry refused."""
    lines = [r.value.strip() for r in spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n")).alias("value")).collect()]
    found = tuple(x for x in lines if x and not x.startswith("#"))
    if not found:
        raise ValueError(f"{path}: no pattern")
    return found


def configuration(spark: SparkSession, path: str, required: tuple[str, ...] = ("saliency_floor_rule", "fold_rule", "viability", "k_grid", "min_pilot_sample")) -> dict:
    """A small JSON configuration; a missing key is refused."""
    found = json.loads(spark.read.text(path, wholetext=True).first().value)
    if missing := [k for k in required if k not in found]:
        raise ValueError(f"{path}: missing {missing}")
    return found


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (record_id, content); the id is the file name without zeros in front and without its ending."""
    return spark.read.format("binaryFile").load(path).select(_record_id(F.col("path")).alias("record_id"), "content")


def _record_id(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1), "^0+(?=.)", "")


def _to_rgb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grey, BGR or BGRA bytes as RGB, one image at a time; alpha is dropped, as a conversion to RGB does."""
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            record, path, height, width, channels = (c[0].as_py() for c in one.columns[:5])
            pixels = None
            if height > 0 and width > 0:
                raw = np.frombuffer(one.column(5)[0].as_buffer(), np.uint8).reshape(height, width, channels)
                pixels = (np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]).tobytes()
            size = [height, width] if pixels is not None else [None, None]
            yield pa.RecordBatch.from_pydict({"record_id": [record], "path": [path], "height": pa.array(size[:1], pa.int32()), "width": pa.array(size[1:], pa.int32()), "pixels": pa.array([pixels], pa.binary())})


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (record_id, path, height, width, pixels), pixels being rows of RGB bytes; a file that can't be decoded has nulls.

    Spark's image source decodes in the JVM where the file is read; ids are as in image_files.
    """
    image = [F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")]
    found = spark.read.format("image").option("dropInvalid", "false").load(path).select(_record_id(F.col("image.origin")).alias("record_id"), F.col("image.origin").alias("path"), *image)
    return found.mapInArrow(_to_rgb, "record_id string, path string, height int, width int, pixels binary")


def unreadable(images: DataFrame) -> DataFrame:
    """The side output of decoded_images: files without pixels."""
    return images.where("pixels is null").select("record_id", "path")


def shard(positioned: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with positions of [start, end)."""
    if not 0 <= start < end:
        raise ValueError("0 <= start < end is asked for")
    return positioned.where((F.col("pos") >= start) & (F.col("pos") < end))


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
