import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.operators import identity, images
from fidelis.plans import catalog
from fidelis.sources import readers

SF = "/root/testdata/sf0.001"


def png(image):
    """A plain PNG of height x width x channels (1 grey, 3 RGB, 4 RGBA)."""
    h, w, c = image.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in image)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    def put(name, content):
        (tmp_path / name).write_bytes(content)
        return tmp_path

    return put


def test_files_give_the_digests_of_the_table_s_pixels(spark, folder):
    rows = catalog._images(spark, SF, 12, 16).select("instance", "pos", "partner", "pixels")
    for r in rows.select("instance", "pixels").collect():
        root = folder(f"{r.instance:012d}.png", png(np.frombuffer(r.pixels, np.uint8).reshape(12, 16, 3)))
    pool = rows.select("instance", "pos", F.col("instance").cast("string").alias("record_id"), F.col("partner").cast("string").alias("partner_id"))
    decoded = readers.decoded_images(spark, str(root))
    made = images.apply_regimes(images.paired(pool, decoded)).where("regime not in ('occlude', 'noise')").select("instance", "regime", F.sha2("pixels", 256).alias("digest"))
    want = sorted(map(tuple, catalog.QUERIES["image_fixed_regimes"](spark, SF).collect()))
    assert sorted(map(tuple, made.collect())) == want and len(want) == 4 * pool.count()
    assert images.lacking(pool, decoded).count() == 0 and readers.unreadable(decoded).count() == 0


def test_channels_and_files_that_are_no_images(spark, folder):
    rng = np.random.default_rng(1)
    grey, rgb, rgba = (rng.integers(0, 256, (5, 7, c), np.uint8) for c in (1, 3, 4))
    for name, image in (("0001.png", grey), ("2.png", rgb), ("3.png", rgba)):
        folder(name, png(image))
    folder("4.png", png(rgb)[:40])
    root = folder("5.png", b"no image")
    decoded = readers.decoded_images(spark, str(root))
    got = {r.record_id: (r.height, r.width, r.pixels and bytes(r.pixels)) for r in decoded.collect()}
    assert got["1"] == (5, 7, np.repeat(grey, 3, axis=2).tobytes()) and got["2"] == (5, 7, rgb.tobytes()) and got["3"] == (5, 7, rgba[:, :, :3].tobytes())
    assert got["4"] == got["5"] == (None, None, None)
    assert sorted(r.record_id for r in readers.unreadable(decoded).collect()) == ["4", "5"]
    pool = spark.createDataFrame([(1, 0, "1", "2"), (2, 1, "2", "4"), (3, 2, "9", "1"), (4, 3, None, "3")], "instance long, pos long, record_id string, partner_id string")
    assert [r.instance for r in images.paired(pool, decoded).collect()] == [1]
    assert sorted(map(tuple, images.lacking(pool, decoded).collect())) == [(2, "partner", "unreadable"), (3, "own", "missing"), (4, "own", "missing")]


def test_a_shard_s_partner_may_lie_outside_of_it(spark, folder):
    image = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    for k in range(4):
        root = folder(f"{k + 1:05d}.png", png(image + k))
    placed = identity.assign_position(spark.range(1, 5).select(F.col("id").alias("instance")), "instance")
    pool = identity.derangement(placed, "instance").select("instance", "pos", F.col("instance").cast("string").alias("record_id"), F.col("partner").cast("string").alias("partner_id"))
    made = images.apply_regimes(images.paired(readers.shard(pool, 3, 4), readers.decoded_images(spark, str(root)))).where("regime = 'wrong-image'")
    assert [(r.instance, bytes(r.pixels)) for r in made.collect()] == [(4, image.tobytes())]
