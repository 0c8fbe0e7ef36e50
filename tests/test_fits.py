"""FITS files written here and read back, and the batch run over a folder."""

import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from nightsieve.plans.cull import CullOptions, cull_session
from nightsieve.sources import files, fits, reports
from tests.skies import scattered, star_field, write_fits


def raster(spark, folder, slab_rows=3):
    header = fits.header_table(files.discover_files(spark, str(folder)))
    slabs = fits.slab_luminance(fits.read_fits(header, slab_rows=slab_rows))
    rows = fits.pixel_rows(slabs).toPandas()
    rows["name"] = rows["path"].str.split("/").str[-1]
    return header, {n: g.pivot(index="y", columns="x", values="v").to_numpy() for n, g in rows.groupby("name")}


@pytest.mark.parametrize("bitpix", [8, 16, 32, 64, -32, -64])
def test_sample_types(spark, tmp_path, bitpix):
    image = np.arange(77.0).reshape(7, 11) * 3
    write_fits(tmp_path / "a.fits", image, bitpix, primary_first=bitpix == 16)
    header, images = raster(spark, tmp_path)
    assert np.array_equal(images["a.fits"], image)
    row = header.first()
    assert (row["width"], row["height"], row["hdu"]) == (11, 7, int(bitpix == 16))
    assert row["norm_max"] == (2.0 ** abs(bitpix) - 1 if abs(bitpix) in (8, 16, 32) else 1.0)


def test_colour_planes_become_luminance(spark, tmp_path):
    planes = np.stack([np.full((5, 4), v) for v in (100.0, 200.0, 50.0)])
    write_fits(tmp_path / "rgb.fit", planes, -32)
    _, images = raster(spark, tmp_path)
    assert np.allclose(images["rgb.fit"], 0.2126 * 100 + 0.7152 * 200 + 0.0722 * 50, rtol=1e-6)


def test_header_values_and_gates(spark, tmp_path):
    image = np.zeros((4, 4))
    extra = [("FILTER", "'OIII '"), ("FILTER", "'Ha' / narrow"), ("EXPOSURE", "1.2D2"), ("DATE-OBS", "'2024-03-01T22:10:05.5'"),
             ("XPIXSIZE", "3.0"), ("YPIXSIZE", "5.0"), ("FOCAL", "'500'"), ("SKYTEMP", "-12.5"), ("IMAGETYP", "'LIGHT'")]
    write_fits(tmp_path / "x__SQM_21.29_0000.FITS", image, extra=extra)
    write_fits(tmp_path / "dark.fits", image, extra=[("IMAGETYP", "'Dark Frame'")])
    (tmp_path / "bad.fits").write_bytes(b"x" * 100)
    (tmp_path / "box.xisf").write_bytes(b"x")
    (tmp_path / "notes.txt").write_text("no")
    table = {r["file_name"]: r for r in fits.header_table(files.discover_files(spark, str(tmp_path))).collect()}
    assert set(table) == {"x__SQM_21.29_0000.FITS", "dark.fits", "bad.fits", "box.xisf"}
    good = table["x__SQM_21.29_0000.FITS"]
    assert (good["filter_name"], good["exposure_s"], good["pixel_um"], good["focal_mm"], good["sky_temp"], good["sqm"]) == ("Ha", 120.0, 4.0, 500.0, -12.5, 21.29)
    assert good["exposure_ts"].strftime("%Y-%m-%d %H:%M:%S") == "2024-03-01 22:10:05"
    assert {n: r["status"] for n, r in table.items()} == {good["file_name"]: "loaded", "dark.fits": "not light", "bad.fits": "error", "box.xisf": "error"}


def test_truncated_file_is_reported(spark, tmp_path):
    write_fits(tmp_path / "a.fits", np.ones((400, 10)))
    data = (tmp_path / "a.fits").read_bytes()
    (tmp_path / "a.fits").write_bytes(data[: len(data) // 2])
    header = fits.header_table(files.discover_files(spark, str(tmp_path)))
    assert fits.failed_paths(fits.read_fits(header)).count() == 1


def test_discovery(spark, tmp_path):
    for name in ("b.FIT", "a.fits", "c.txt", "sub/d.xisf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    names = lambda df: [r["path"].rsplit("/", 1)[1] for r in df.collect()]
    assert names(files.discover_files(spark, f" {tmp_path} ;; {tmp_path}/missing; {tmp_path}")) == ["a.fits", "b.FIT"]
    assert names(files.discover_files(spark, str(tmp_path), recursive=True)) == ["a.fits", "b.FIT", "d.xisf"]
    assert files.discover_files(spark, f"{tmp_path}/missing").count() == 0


def test_options():
    options = CullOptions.parse(["--headless", "--input", "in", "--rejected", "out", "--max-fwhm", "5.5", "--max-bg", "x", "--allow-trails"])
    limits = options.limits[""]
    assert (options.input, options.rejected, limits.max_fwhm, limits.max_mean_background, limits.min_trail) == ("in", "out", 5.5, 2000.0, 0)


def test_batch_run_moves_the_soft_frame(spark, tmp_path):
    assert cull_session(spark, CullOptions(input=str(tmp_path)))[0] == 2
    assert cull_session(spark, CullOptions(input=str(tmp_path), rejected="x")) == (0, {})
    sky = scattered(15, 200, 160)
    os.makedirs(tmp_path / "in" / "night1")
    write_fits(tmp_path / "in/night1/sharp.fits", star_field(200, 160, sky, sigma=1.5), extra=[("FILTER", "'Ha'")])
    write_fits(tmp_path / "in/night1/soft.fits", star_field(200, 160, sky, sigma=2.4), extra=[("FILTER", "'Ha'")])
    (tmp_path / "in/night1/bad.fits").write_bytes(b"?")
    options = CullOptions.parse(["--input", str(tmp_path / "in"), "--rejected", str(tmp_path / "out"), "--recursive", "--max-fwhm", "4.5", "--report", str(tmp_path / "report")])
    code, tables = cull_session(spark, options)
    assert code == 0
    assert tables["load_report"].first().asDict() == {"total": 3, "loaded": 2, "skipped": 1, "errors": 1}
    verdicts = {r["file_name"]: r["is_rejected"] for r in tables["frames"].collect()}
    assert verdicts == {"sharp.fits": False, "soft.fits": True}
    assert [r["status"] for r in tables["moves"].collect()] == ["moved"]
    assert (tmp_path / "out/night1/soft.fits").exists() and not (tmp_path / "in/night1/soft.fits").exists()
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    with pytest.raises(AnalysisException, match="ALREADY_EXISTS"):
        reports.metrics_report(tables["frames"], str(tmp_path / "report"))
    reports.metrics_report(tables["frames"].limit(1), str(tmp_path / "report"), mode="overwrite")
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 1
    lines = reports.report_lines(tables["frames"].withColumn("fwhm_arcsec", F.lit(None).cast("double"))).collect()
    assert any(r["line"].startswith("soft.fits: FWHM=5.6") and r["line"].endswith("Reject=True") for r in lines)
    # a retried task finds the finished move
    again = reports.execute_moves(tables["moves"].select("path", "destination"))
    assert [r["status"] for r in again.collect()] == ["moved"]
