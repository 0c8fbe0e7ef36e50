"""The slab pipeline gives what the pixel-row operators give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightsieve.operators import detection, slabs, trail
from tests.skies import scattered, star_field
from tests.test_rasters import frame_table, pixel_frame

K = ["frame_id"]


@pytest.fixture(scope="module")
def skies(spark):
    faint = [(x, y, p / 10) for x, y, p in scattered(15, 200, 160)]
    images = {
        1: star_field(300, 240, scattered(40, 300, 240), sigma=1.5, seed=4),
        2: np.round(star_field(300, 240, scattered(40, 300, 240, seed=9), sigma=2.2, seed=5)),
        3: star_field(200, 160, faint, seed=2, trail=((20, 10), (160, 146), 3000)),
        4: star_field(200, 160, faint, seed=3, trail=((10, 80), (190, 84), 3000)),
        5: np.zeros((12, 12)), 6: np.full((3, 4), 7.0),
    }
    images[2][:8, :8] += 4000  # a corner whose stars are moved inside
    return images, pixel_frame(spark, images), frame_table(spark, images)


@pytest.mark.parametrize("slab_rows", [37, 1000])
def test_stars_of_slabs_are_those_of_pixel_rows(spark, skies, slab_rows):
    _, px, frames = skies
    table = slabs.slab_table(px, frames, K, slab_rows)
    counts, _, _ = slabs.survey(table, K)
    levels = slabs.levels_of(counts, K)
    want_levels = {r.frame_id: r for r in detection.frame_levels(px, frames, K).collect()}
    for r in levels.collect():
        w = want_levels[r.frame_id]
        assert (r.median, r.mad) == (w.median, w.mad) and np.isclose(r.sigma, w.sigma)
    measured, found = slabs.find_stars(table, levels, K)
    known = spark.createDataFrame([(w.frame_id, w.background, w.sigma, w.width, w.height) for w in want_levels.values()],
                                  "frame_id bigint, background double, sigma double, width int, height int")
    plain, numbers = detection.detect_stars(px, known, K)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in numbers.collect()}
    columns = [*K, "star_id", "x", "y", "fwhm", "hfr", "ecc", "peak"]
    got, want = (df.select(columns).orderBy(*K, "star_id").toPandas() for df in (measured, plain))
    assert len(got) == len(want) > 60 and np.allclose(got, want, atol=1e-6)


def test_metrics_and_trails_of_slabs(skies):
    images, px, frames = skies
    got = {r.frame_id: r.asDict() for r in slabs.frame_metrics(slabs.slab_table(px, frames, K, 50), frames, K).collect()}
    want = {r.frame_id: r.asDict() for r in detection.frame_metrics(px, frames, K).collect()}
    assert got.keys() == want.keys() == images.keys()
    assert got[3]["trail_confidence"] > 40 and got[4]["trail_confidence"] > 40
    for k, w in want.items():
        assert got[k].keys() == w.keys()
        for name, value in w.items():
            assert got[k][name] == value or np.isclose(got[k][name], value, atol=1e-6), (k, name)


def test_large_rasters_are_reduced_row_by_row(spark):
    rng = np.random.default_rng(5)
    image = rng.normal(100, 5, (40, 1800))
    frames = frame_table(spark, {1: image})
    px = pixel_frame(spark, {1: image})
    _, reduced, _ = slabs.survey(slabs.slab_table(px, frames, K, 16), K)
    small, sizes = detection.trail_raster(px, frames, K)
    size = sizes.first()
    want = np.full((size.height, size.width), np.nan)
    for r in small.collect():
        want[r.y, r.x] = r.v
    rows = reduced.orderBy("y").collect()
    assert [(r.width, r.height) for r in rows] == [(size.width, size.height)] * size.height
    assert np.array_equal(np.array([r.row for r in rows]), want)


def test_no_exchange_carries_samples(skies):
    _, px, frames = skies
    table = slabs.slab_table(px, frames, K).cache()
    plan = table.mapInArrow(lambda b: b, table.schema)._jdf.queryExecution().executedPlan().toString()
    counts, reduced, _ = slabs.survey(table, K)
    assert "Exchange" not in plan.split("InMemoryTableScan")[0]
    assert counts.columns == [*K, "v", "n"] and reduced.columns == [*K, "y", "row", "width", "height"]
    assert slabs.frame_metrics(table.limit(0), frames.limit(0), K).count() == 0
    assert slabs.find_trails(reduced.filter(F.col("frame_id") < 3), K).count() == 0 and trail.ANGLES == 180


@pytest.mark.parametrize("planes", [1, 2, 3, 5])
def test_luminance_slabs_read_each_plane_by_seeking(spark, tmp_path, planes):
    from nightsieve.sources import files, fits
    from tests.skies import write_fits

    rng = np.random.default_rng(planes)
    cube = np.round(rng.normal(1000, 50, (planes, 90, 40)))
    write_fits(f"{tmp_path}/a.fits", cube if planes > 1 else cube[0])
    write_fits(f"{tmp_path}/b.fits", cube if planes > 1 else cube[0], bitpix=-32, primary_first=True)
    with open(f"{tmp_path}/a.fits", "rb") as whole, open(f"{tmp_path}/c.fits", "wb") as part:
        part.write(whole.read()[:2880 + 40 * 2 * 70])
    header = fits.header_table(files.discover_files(spark, str(tmp_path)))
    rows = fits.luminance_slabs(header, slab_rows=32, halo=5).collect()
    weights = [1.0] if planes == 1 else [0.2126, 0.7152, 0.0722][:min(planes, 3)]
    want = sum(w * plane for w, plane in zip(weights, cube))
    for name in "ab":
        own = sorted((r for r in rows if r.path.endswith(f"{name}.fits")), key=lambda r: r.y0)
        assert [(r.y0, r.rows, r.above, r.width, r.height) for r in own] == [(0, 32, 0, 40, 90), (32, 32, 5, 40, 90), (64, 26, 5, 40, 90)]
        for r in own:
            got = np.array(r.samples).reshape(-1, 40)
            assert np.allclose(got, want[r.y0 - r.above:min(90, r.y0 + r.rows + 5)], rtol=1e-6)
    metrics, errors = slabs.measured_frames(fits.luminance_slabs(header, halo=slabs.HALO), header.filter("error is null"), ["path"])
    assert [r.path[-6:] for r in errors.collect()] == ["c.fits"] and sorted(r.path[-6:] for r in metrics.collect()) == ["a.fits", "b.fits"]
    assert metrics.filter("path like '%a.fits'").first().max == pytest.approx(want.max(), rel=1e-6)
