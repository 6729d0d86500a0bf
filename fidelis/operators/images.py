"""Pixel transforms as Arrow-batched functions; random streams are keyed by global position, never by partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The regimes and the constants of their transforms.
REGIMES = ("real", "grey", "wrong-image", "occlude", "noise", "hflip")
GREY, CELL, OCCLUDE, SIGMA, FEATHER = 128, 16, 0.5, 80.0, 3
NOISE_STREAM, TARGET_STREAM, CONTROL_STREAM = 1_000_000, 2_000_000, 3_000_000

#: What a Python stage takes as objects at once, and the pixels that it gives at once.
SLICE_ROWS, SLICE_BYTES = 100, 4 << 20

Box = tuple[int, int, int, int]


def regime_image(regime: str, image: np.ndarray, position: int, partner: np.ndarray | None = None) -> np.ndarray:
    """A new image; image: height x width x 3 of uint8."""
    if regime == "real":
        return image.copy()
    if regime == "grey":
        return np.full_like(image, GREY)
    if regime == "wrong-image":
        if partner is None:
            raise ValueError("wrong-image needs a partner")
        return partner.copy()
    if regime == "hflip":
        return np.flip(image, axis=1).copy()
    if regime == "occlude":
        grid = [-(-n // CELL) for n in image.shape[:2]]
        hidden = np.random.default_rng(position).random(grid) < OCCLUDE
        hidden = np.kron(hidden, np.ones((CELL, CELL), bool))[: image.shape[0], : image.shape[1]]
        return np.where(hidden[:, :, None], np.uint8(0), image)
    if regime == "noise":
        shaken = image + np.random.default_rng(NOISE_STREAM + position).normal(0.0, SIGMA, size=image.shape)
        return shaken.clip(0, 255).astype(np.uint8)
    raise ValueError(f"unknown regime {regime!r}")


def occlude_cell(image: np.ndarray, box: Box) -> np.ndarray:
    out = image.copy()
    out[box[0] : box[2], box[1] : box[3]] = 0
    return out


def donor(partner: np.ndarray, box: Box, height: int, width: int) -> np.ndarray:
    """The partner's pixels at the box, or all of them where it doesn't reach that far, resized by nearest pixel."""
    part = partner[box[0] : box[2], box[1] : box[3]]
    part = part if part.size else partner
    return part[np.ix_(np.arange(height) * part.shape[0] // height, np.arange(width) * part.shape[1] // width)]


def paste(image: np.ndarray, partner: np.ndarray, boxes: list[Box], stream: int) -> np.ndarray:
    """Boxes filled from the partner, blended over FEATHER border pixels; one draw of the stream for each box."""
    rng, out = np.random.default_rng(stream), image.copy()
    for top, left, bottom, right in boxes:
        h, w = bottom - top, right - left
        phase = 0.8 + 0.2 * rng.random()
        rows, cols = (np.minimum(np.arange(n), np.arange(n)[::-1]) for n in (h, w))
        depth = min(FEATHER, h // 2, w // 2)
        away = np.where(rows[:, None] < depth, rows[:, None], cols)  # at corners the row's depth counts
        alpha = np.where(away < depth, phase * (away + 1) / (FEATHER + 1), 1.0)[:, :, None]
        under = out[top:bottom, left:right].astype(np.float64)
        mixed = alpha * donor(partner, (top, left, bottom, right), h, w) + (1.0 - alpha) * under
        out[top:bottom, left:right] = mixed.clip(0, 255).astype(np.uint8)
    return out


def _array(raw: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(height, width, 3)


def paired(pool: DataFrame, decoded: DataFrame) -> DataFrame:
    """What apply_regimes takes, for each row of the pool that has its own image and its partner's.

    pool: instance, pos, record_id and partner_id, as the whole pool's derangement has them, so that a shard's partners may lie outside
    of it; decoded: record_id, height, width, pixels, one for each id. Null ids and unreadable images have no image; `lacking` tells which rows are left out.
    """
    held = decoded.where("pixels is not null").select("record_id", "height", "width", "pixels")
    other = held.select(F.col("record_id").alias("partner_id"), *(F.col(c).alias(f"p_{c}") for c in ("height", "width", "pixels")))
    return pool.select("instance", "pos", "record_id", "partner_id").join(held, "record_id").join(other, "partner_id").drop("record_id", "partner_id")


def lacking(pool: DataFrame, decoded: DataFrame) -> DataFrame:
    """(instance, which, reason): rows of the pool whose image or partner's is missing or unreadable; no pixels are moved for it."""
    said = decoded.select("record_id", F.col("pixels").isNotNull().alias("readable")).groupBy("record_id").agg(F.bool_or("readable").alias("readable"))
    asked = pool.select("instance", F.explode(F.map_from_arrays(F.array(F.lit("own"), F.lit("partner")), F.array("record_id", "partner_id"))).alias("which", "record_id"))
    return asked.join(said, "record_id", "left").where("readable is null or not readable").select("instance", "which", F.when(F.col("readable").isNull(), "missing").otherwise("unreadable").alias("reason"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches, few of them as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield from batch.slice(start, SLICE_ROWS).to_pylist()


def _written(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each ended once its pixels fill SLICE_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= SLICE_BYTES or len(held) == 100 * SLICE_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema, strict=True)], schema=schema)


PAIR = ("instance", "pos", "height", "width", "pixels", "p_height", "p_width", "p_pixels")


def apply_regimes(images: DataFrame, regimes: tuple[str, ...] = REGIMES) -> DataFrame:
    """(instance, regime, pixels) for all given regimes of images (instance, pos, height, width, pixels, p_height, p_width, p_pixels)."""

    def made(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            image, partner = _array(r["pixels"], r["height"], r["width"]), _array(r["p_pixels"], r["p_height"], r["p_width"])
            for x in regimes:
                yield r["instance"], x, regime_image(x, image, r["pos"], partner).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(made(_rows(batches)), pa.schema([("instance", pa.int64()), ("regime", pa.string()), ("pixels", pa.binary())]))

    return images.select(*PAIR).mapInArrow(run, "instance long, regime string, pixels binary")


def sweep_cells(images: DataFrame, side: int = 8) -> DataFrame:
    """(instance, cell, pixels): each image of (instance, height, width, pixels) once for each cell of the grid, that cell blackened.

    Images of one size are copied and blackened together, as many at a time as fill SLICE_BYTES; of a larger one some cells at a time.
    """

    def swept(keys: list[int], images: np.ndarray) -> Iterator[pa.RecordBatch]:
        (n, height, width, _), of_one = images.shape, max(1, images[0].nbytes)
        step = max(1, min(side * side, SLICE_BYTES // of_one))
        for first in range(0, side * side, step):
            cells = range(first, min(first + step, side * side))
            out = np.repeat(images[:, None], len(cells), axis=1)
            for at, c in enumerate(cells):
                out[:, at, c // side * height // side : (c // side + 1) * height // side, c % side * width // side : (c % side + 1) * width // side] = 0
            ends = np.arange(n * len(cells) + 1, dtype=np.int64) * images[0].nbytes
            pixels = pa.Array.from_buffers(pa.large_binary(), n * len(cells), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, len(cells))), pa.array(np.tile(np.array(cells, np.int64), n)), pixels], ["instance", "cell", "pixels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0
        for r in _rows(batches):
            held.setdefault((r["height"], r["width"]), []).append((r["instance"], _array(r["pixels"], r["height"], r["width"])))
            size += side * side * len(r["pixels"])
            if size >= SLICE_BYTES:
                for same in held.values():
                    yield from swept([k for k, _ in same], np.stack([x for _, x in same]))
                held, size = {}, 0
        for same in held.values():
            yield from swept([k for k, _ in same], np.stack([x for _, x in same]))

    return images.select("instance", "height", "width", "pixels").mapInArrow(run, "instance long, cell long, pixels binary")


def apply_edits(images: DataFrame) -> DataFrame:
    """(instance, targeted, control): images edited in `box` and in `patches`; control is null without patches."""

    def made(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            image, partner = _array(r["pixels"], r["height"], r["width"]), _array(r["p_pixels"], r["p_height"], r["p_width"])
            boxes = [[b[x] for x in ("top", "left", "bottom", "right")] for b in [r["box"], *r["patches"]]]
            control = paste(image, partner, boxes[1:], CONTROL_STREAM + r["pos"]).tobytes() if boxes[1:] else None
            yield r["instance"], paste(image, partner, boxes[:1], TARGET_STREAM + r["pos"]).tobytes(), control

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(made(_rows(batches)), pa.schema([("instance", pa.int64()), ("targeted", pa.binary()), ("control", pa.binary())]))

    return images.select(*PAIR, "box", "patches").mapInArrow(run, "instance long, targeted binary, control binary")


def call_model(rows: DataFrame, model, schema: str) -> DataFrame:
    """Rows through an injected model: `model()` is made once for each task and maps a pandas frame to one of the schema.

    Put cheap gates as filters before this; nothing is ordered by cost across it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = model()
        for frame in frames:
            yield ready(frame)

    return rows.mapInPandas(run, schema)
