"""Token counts behind a cache that is keyed by content digest and tokenizer version.

Contents are normalised and digested where they are read. Texts travel once, compressed, to meet their equals; copies within a
task are dropped before that. One of each content that the cache lacks is encoded, whole, and appended to the
cache; then every document takes its content's count by a join of digests, whose two sides are plain shuffles, so
that a content that a third of all documents has can be split.

Content is digested in the tokenizer's own normal form, with which its encoding begins: texts of one form have the same tokens by
construction, and which blanks, letters or compositions are the same is the file's to say. Any coarser form would give wrong counts.

The cache is a Parquet table (content binary, version string, n_tokens long). Appending is safe to repeat:
equal keys have equal counts, and reading takes one of them.

Defined results: a null text counts as the empty one; repeated rows come back once for each row; extra
columns of the input are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from fidelis.llm.common import Scratch, exists, slices, text_chunks
from fidelis.llm.tokenizers import counter, normal_form, version

CACHE = "content binary, version string, n_tokens long"


def _digests(texts: pa.Array, path: str) -> pa.Array:
    """The digest of each text's normal form, whole; texts are taken in chunks, as a form may be three times as long."""
    held, form = texts.to_pylist(), normal_form(path)
    return pa.array([hashlib.sha256(x.encode()).digest() for a, b in text_chunks(held) for x in form(held[a:b])], pa.binary())


def _pack(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches):
        packed = [squeeze(x.as_buffer()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([_digests(batch.column(0), path), pa.array(packed, pa.binary())], ["content", "packed"])


def _key(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _digests(batch.column(2), path)], ["doc_id", "n_bytes", "content"])


def _encode(batches: Iterator[pa.RecordBatch], path: str, stamp: str) -> Iterator[pa.RecordBatch]:
    count, unpack = counter(path), zstandard.ZstdDecompressor().decompress
    for batch in slices(batches):
        texts = [unpack(x).decode() for x in batch.column(1).to_pylist()]
        n = [x for a, b in text_chunks(texts) for x in count(texts[a:b])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stamp] * len(n), pa.string()), pa.array(n, pa.int64())], ["content", "version", "n_tokens"])


def read_cache(docs: DataFrame, path: str, stamp: str) -> DataFrame:
    """The counts stored for one tokenizer version; none where nothing is there yet. What is there and isn't a cache is an error."""
    spark = docs.sparkSession
    held = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)
    if dict(held.dtypes) != {"content": "binary", "version": "string", "n_tokens": "bigint"}:
        raise ValueError(f"{path} is no cache of token counts: {held.dtypes}")
    return held.where(F.col("version") == stamp).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs; cache: the stored counts' path, else a new one."""
    scratch = Scratch(docs.sparkSession, "tokens")
    cache, stamp = cache or scratch.path("cache"), version(tokenizer)
    text = F.coalesce("text", F.lit("")).alias("text")
    packed = docs.select(text).mapInArrow(lambda it: _pack(it, tokenizer), "content binary, packed binary")
    misses = packed.groupBy("content").agg(F.first("packed").alias("packed")).join(read_cache(docs, cache, stamp), "content", "left_anti")
    misses.mapInArrow(lambda it: _encode(it, tokenizer, stamp), CACHE).write.mode("append").option("compression", "zstd").parquet(cache)
    counts = scratch.write(read_cache(docs, cache, stamp), "counts")
    keys = StructType([docs.schema["doc_id"]]).add("n_bytes", LongType()).add("content", BinaryType())
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text).mapInArrow(lambda it: _key(it, tokenizer), keys)
    counted = keyed.join(counts, "content")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
