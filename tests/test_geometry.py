import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fidelis.operators import grid, images


def test_localize(spark):
    rows = [("flat", r, c, 0.0) for r in range(8) for c in range(8)] + [("hot", r, c, 1.0 if (r, c) == (2, 3) else 0.1) for r in range(8) for c in range(8)]
    rows += [("two", r, c, {(1, 1): 1.0, (2, 4): 0.5, (7, 7): 0.49}.get((r, c), 0.0)) for r in range(8) for c in range(8)]
    df = spark.createDataFrame(rows, "id string, row long, col long, drop double").withColumns({"height": F.lit(64), "width": F.lit(96)})
    got = {r.id: (r.top, r.left, r.bottom, r.right, r.n_cells) for r in grid.localize(df, "id", 0.05).collect()}
    assert got == {"hot": (16, 36, 24, 48, 1), "two": (8, 12, 24, 60, 2)}


def boxes_of(spark, rows):
    return spark.createDataFrame(rows, "id long, top long, left long, bottom long, right long, height long, width long")


def patches(top, left, bottom, right, height, width):
    found, area = [], (bottom - top) * (right - left)
    for r in range(0, height - 15, 16):
        for c in range(0, width - 15, 16):
            if len(found) * 256 < area and (r + 16 <= top or r >= bottom or c + 16 <= left or c >= right):
                found.append((r, c, r + 16, c + 16))
    return found, len(found) * 256 >= 0.25 * area


def test_patches_and_control_box(spark):
    rows, rng = [], np.random.Generator(np.random.PCG64(1))
    for i in range(120):
        h, w = (int(x) for x in rng.integers(10, 120, 2))
        t, x = int(rng.integers(0, h - 1)), int(rng.integers(0, w - 1))
        rows.append((i, t, x, int(rng.integers(t + 1, h + 1)), int(rng.integers(x + 1, w + 1)), h, w))
    df = boxes_of(spark, rows)
    for r in grid.control_patches(df).collect():
        want, ok = patches(r.top, r.left, r.bottom, r.right, r.height, r.width)
        assert [tuple(p) for p in r.patches] == want and r.applicable == ok
    for r in df.withColumn("c", grid.control_box(*(F.col(x) for x in ("top", "left", "bottom", "right", "height", "width")))).collect():
        h, w = r.bottom - r.top, r.right - r.left
        room = [r.top >= h, r.height - r.bottom >= h, r.left >= w, r.width - r.right >= w]
        assert (r.c is None) == (not any(room))
        if r.c:
            assert (r.c.bottom - r.c.top, r.c.right - r.c.left) == (h, w) and (r.c.bottom <= r.top or r.c.top >= r.bottom or r.c.right <= r.left or r.c.left >= r.right)
            assert 0 <= r.c.top and r.c.bottom <= r.height and 0 <= r.c.left and r.c.right <= r.width


def test_spans(spark):
    rows = [([1, 2, 9], [1, 2, 5, 6, 9], (2, 4)), ([1, 2], [1, 2, 3], (2, 3)), ([7, 1, 1], [7, 1, 1, 1], (3, 4)), ([5], [5, 5], (1, 2))]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a array<int>, b array<int>")
    assert [tuple(r[0]) for r in df.select(grid.common_span(F.col("a"), F.col("b"))).collect()] == [r[2] for r in rows]
    ids = F.array(*map(F.lit, ["<s>", "x", "A", ".", "\n"]))
    span = spark.range(1).select(grid.refine_span(ids, F.lit(1), F.lit(5), F.lit("A."), lambda a: F.regexp_replace(F.array_join(a, ""), r"\n", " ")).alias("s")).first().s
    assert (span.start, span.end, span.n) == (2, 4, 1)


IMAGE = np.random.Generator(np.random.PCG64(2)).integers(0, 256, (33, 50, 3)).astype(np.uint8)
PARTNER = 255 - IMAGE[:20, :30]


def test_regimes():
    before = IMAGE.copy()
    out = {r: images.regime_image(r, IMAGE, 5, PARTNER) for r in images.REGIMES}
    assert (IMAGE == before).all() and (out["real"] == IMAGE).all() and (out["grey"] == 128).all() and (out["wrong-image"] == PARTNER).all()
    assert (images.regime_image("hflip", out["hflip"], 5) == IMAGE).all()
    hidden = np.random.default_rng(5).random((3, 4)) < 0.5
    for r in range(33):
        for c in range(50):
            assert (out["occlude"][r, c] == (0 if hidden[r // 16, c // 16] else IMAGE[r, c])).all()
    noise = np.random.default_rng(1_000_005).normal(0.0, 80.0, size=IMAGE.shape)
    assert (out["noise"] == np.clip(IMAGE + noise, 0, 255).astype(np.uint8)).all()
    with pytest.raises(ValueError):
        images.regime_image("blur", IMAGE, 1)
    with pytest.raises(ValueError):
        images.regime_image("wrong-image", IMAGE, 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 20), st.integers(0, 30), st.integers(1, 12), st.integers(1, 20))
def test_paste_blends_rows_before_columns(top, left, h, w):
    box = (top, left, top + h, left + w)
    got = images.paste(IMAGE, PARTNER, [box], 9)
    phase, depth = 0.8 + 0.2 * np.random.default_rng(9).random(), min(3, h // 2, w // 2)
    crop = PARTNER[top : top + h, left : left + w]
    crop = crop if crop.size else PARTNER
    for r in range(h):
        for c in range(w):
            row, col = min(r, h - 1 - r), min(c, w - 1 - c)
            edge = row if row < depth else col if col < depth else None
            a = 1.0 if edge is None else phase * (edge + 1) / 4
            new = crop[r * crop.shape[0] // h, c * crop.shape[1] // w]
            want = (a * new.astype(float) + (1.0 - a) * IMAGE[top + r, left + c]).clip(0, 255).astype(np.uint8)
            assert (got[top + r, left + c] == want).all()
    mask = np.ones(IMAGE.shape[:2], bool)
    mask[top : top + h, left : left + w] = False
    assert (got[mask] == IMAGE[mask]).all()


def test_several_boxes_share_a_stream():
    rng = np.random.default_rng(3)
    phases = [0.8 + 0.2 * rng.random() for _ in range(2)]
    assert phases[0] != phases[1]
    both = images.paste(IMAGE, PARTNER, [(0, 0, 8, 8), (16, 16, 24, 24)], 3)
    first = images.paste(IMAGE, PARTNER, [(0, 0, 8, 8)], 3)
    assert (both[:8, :8] == first[:8, :8]).all() and (both[16:24, 16:24] != IMAGE[16:24, 16:24]).any()
    assert (images.occlude_cell(IMAGE, (0, 0, 4, 4))[:4, :4] == 0).all()
