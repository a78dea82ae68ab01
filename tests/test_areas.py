from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import tiles
from terravane.sources import settings

BOX = geo.Box(10.0, 20.0, 10.09, 20.03)


def brute_refine(points, parts, limit, smallest, depth=0, y=0, x=0):
    n = parts**depth
    at = lambda v, low, size: min(int((v - low) / size * n), n - 1)
    own = sum(at(a, BOX.min_lat, 0.09) == y and at(b, BOX.min_lon, 0.03) == x for a, b in points)
    if own < limit or (0.09 / n < smallest and 0.03 / n < smallest):
        return [(depth, y, x, own)]
    return [r for dy in range(parts) for dx in range(parts) for r in brute_refine(points, parts, limit, smallest, depth + 1, y * parts + dy, x * parts + dx)]


@pytest.mark.parametrize("parts", [2, 3])
def test_refined_areas_equal_those_of_a_recursion(spark, parts):
    draw = np.random.default_rng(parts)
    points = [(10.0 + 0.09 * a**3, 20.0 + 0.03 * b) for a, b in draw.random((400, 2)).tolist()] + [(10.0500001, 20.0100001)] * 60 + [(10.09, 20.03), (10.0, 20.0)]
    df = spark.createDataFrame([*points, (None, 20.0), (9.0, 20.0)], "lat double, lon double")
    found = tiles.refine(df, BOX, parts, 20, 0.002)
    rows = [(r["depth"], round((r["south"] - 10.0) / (0.09 / parts ** r["depth"])), round((r["west"] - 20.0) / (0.03 / parts ** r["depth"])), r["n"]) for r in found.collect()]
    assert sorted(rows) == sorted(brute_refine(points, parts, 20, 0.002)) and sum(r[3] for r in rows) == len(points)


def near(p, q, km):
    a, b, c, d = map(math.radians, (*p, *q))
    return math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d) > math.cos(km / 6378)


def brute_windows(posts, tile, path, box, r, end, days, limit, splits, back=None):
    out, mid = [], ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
    for k in range(days) if back is None else [back]:
        until = (end - k * 86_400) * 10**6
        own = [(i, us) for i, us, lat, lon in posts if lat is not None and until - 86_400 * 10**6 <= us < until and near((lat, lon), mid, r)]
        if len(own) < limit or not splits:
            cut = len(own) >= limit
            own = sorted(own, key=lambda x: (-x[1], x[0]))[:limit] if cut else own
            out += [(tile, path, k, i, us, cut) for i, us in own]
            continue
        for part, (s, w, n, e) in {"a": (box[0], box[1], *mid), "b": (box[0], mid[1], mid[0], box[3]), "c": (mid[0], box[1], box[2], mid[1]), "d": (*mid, box[2], box[3])}.items():
            out += brute_windows(posts, tile, path + part, (s, w, n, e), r / 2, end, days, limit, splits - 1, k)
    return out


def test_windows_fetch_what_asking_one_by_one_gives(spark):
    draw = np.random.default_rng(9)
    end = 1_700_000_000
    posts = [(i, (end - int(t)) * 10**6, 10 + 0.09 * float(a), 20 + 0.03 * float(b)) for i, (t, a, b) in enumerate(zip(draw.integers(-1000, 4 * 86_400, 500), draw.random(500), draw.random(500), strict=True))]
    posts += [(1000 + i, end * 10**6 - 1 - i, 10.0405, 20.0151) for i in range(30)] + [(2000, end * 10**6, 10.04, 20.01), (2001, (end - 86_400) * 10**6, 10.04, 20.01), (2002, end * 10**6 - 5, None, 20.0), (1000, end * 10**6 - 1, 10.0405, 20.0151)]
    grid = tiles.tiles(spark, 2.5, BOX).withColumn("tile", F.concat_ws("-", "row", "col"))
    df = spark.createDataFrame(posts, "id long, us long, lat double, lon double")
    found = Counter(map(tuple, tiles.fetch_windows(df, grid, end, 3, 6, 2).select("tile", "path", "back", "id", "us", "cut").collect()))
    want = Counter(x for t in grid.collect() for x in brute_windows(posts, t["tile"], "", (t["left_lat"], t["left_lon"], t["right_lat"], t["right_lon"]), t["r"], end, 3, 6, 2))
    assert found == want
    assert {len(x[1]) for x in found} == {0, 1, 2} and {x[5] for x in found} == {True, False}
    assert tiles.fetch_windows(df.limit(0), grid, end, 3, 6, 2).count() == 0 and tiles.fetch_windows(df, grid.limit(0), end, 3, 6, 2).count() == 0


def test_extent_needs_points(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, -1.0), (None, None)], "lat double, lon double")
    assert tiles.extent(df) == geo.Box(1.0, -1.0, 3.0, 2.0)
    with pytest.raises(ValueError, match="no point"):
        tiles.extent(df.limit(0))


def test_settings_of_many_jobs(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"job": "a", "search_radius": 1.5, "gps": [[1, 2], [3, 4]], "other": 1}\n{"job": "b", "search_radius": 2, "gps": [], "robots_threshold": 0.1}\n{"job": "c", "search_radius": 3, "gps": [[5.5, 6]], "start_date": 7}\n')
    got = sorted(map(tuple, settings.job_points(spark, str(tmp_path)).select("job", "query_idx", "qlat", "qlon", "radius", "start_date").collect()))
    assert got == [("a", 0, 1.0, 2.0, 1.5, None), ("a", 1, 3.0, 4.0, 1.5, None), ("c", 0, 5.5, 6.0, 3.0, 7)]
