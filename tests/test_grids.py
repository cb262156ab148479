import math

import numpy as np
import pytest

from fieldlake.operators.grids import focal_median, terrain


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_focal_median_does_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(5)
    cells = {(int(r), int(c)): float(rng.normal()) for r in range(-3, 12) for c in range(10) if rng.random() < 0.8}
    rows = [("s", r, c, v) for (r, c), v in cells.items()]
    frame = spark.createDataFrame(rows, "scene string, px_row bigint, px_col bigint, value double")
    out = focal_median(frame, ["scene"], tile=tile).collect()
    assert len(out) == len(cells)
    for r in out:
        near = [cells[k] for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (k := (r["px_row"] + dr, r["px_col"] + dc)) in cells]
        assert r["value"] == pytest.approx(float(np.median(near)))


def test_terrain_of_a_plane(spark):
    # Rises 3 m per cell to the east: the surface faces west.
    rows = [(r, c, 3.0 * c) for r in range(3) for c in range(3)]
    out = {(r["px_row"], r["px_col"]): r for r in terrain(spark.createDataFrame(rows, "px_row int, px_col int, value double"), 30.0).collect()}
    middle = out[1, 1]
    assert middle["slope"] == pytest.approx(math.degrees(math.atan(0.1)))
    assert middle["aspect"] == pytest.approx(270.0)
    assert middle["hillshade"] == pytest.approx(255 * math.cos(math.radians(45) - math.atan(0.1)))
    assert out[0, 0]["slope"] is None and out[0, 0]["elevation"] == 0.0
