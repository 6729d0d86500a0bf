import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fidelis.operators import images
from fidelis.plans import catalog

SF = "/root/testdata/sf0.001"


def test_pixels_follow_from_the_key(spark):
    keys = [*range(256), 19_999, 7_200_000, 2**62]
    got = spark.createDataFrame([(k,) for k in keys], "instance long").select("instance", catalog._pixels("instance", 12, 16).alias("x")).collect()
    assert all(bytes(r.x) == bytes((i * 7 + r.instance * 13) % 256 for i in range(576)) for r in got) and len(got) == len(keys)


@pytest.mark.parametrize("name", ["image_fixed_regimes", "image_regimes", "image_edits"])
def test_pixels_are_neither_ordered_nor_written_nor_joined(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"ReadSchema: struct<[^>]*pixels", plan) and not re.search(r"(Exchange|Sort |Join)[^\n]*pixels", plan)


@pytest.mark.parametrize("name", ["image_sweep", "image_fixed_regimes", "image_regimes", "image_edits"])
def test_a_small_table_of_many_images_is_many_tasks(spark, name):
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("slice_bytes", [1, 5000, 4 << 20])
def test_a_sweep_of_images_of_several_sizes(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(images, "SLICE_BYTES", slice_bytes)
    rng = np.random.default_rng(1)
    made = {k: rng.integers(1, 256, (8 + k % 3 * 5, 9 + k % 2, 3), np.uint8) for k in range(30)}
    df = spark.createDataFrame([(k, *x.shape[:2], bytearray(x.tobytes())) for k, x in made.items()], "instance long, height int, width int, pixels binary")
    got = {(r.instance, r.cell): bytes(r.pixels) for r in images.sweep_cells(df).collect()}
    assert len(got) == 30 * 64
    for (k, c), pixels in got.items():
        (h, w, _), (row, column) = made[k].shape, divmod(c, 8)
        assert pixels == images.occlude_cell(made[k], (row * h // 8, column * w // 8, (row + 1) * h // 8, (column + 1) * w // 8)).tobytes()


def test_batches_of_pixels_are_bounded():
    schema = pa.schema([("instance", pa.int64()), ("pixels", pa.binary())])
    batches = list(images._written(((k, bytes(3 << 20) if k % 2 else None) for k in range(9)), schema))
    assert [b.num_rows for b in batches] == [4, 4, 1] and pa.Table.from_batches(batches)["instance"].to_pylist() == list(range(9))


def test_only_the_regimes_asked_for(spark):
    image = bytearray(range(12))
    df = spark.createDataFrame([(1, 0, 2, 2, image, 2, 2, image[::-1])], "instance long, pos long, height int, width int, pixels binary, p_height int, p_width int, p_pixels binary").withColumn("more", F.lit(1))
    assert [r.regime for r in images.apply_regimes(df, ("grey", "hflip")).collect()] == ["grey", "hflip"] and images.apply_regimes(df).count() == len(images.REGIMES)
