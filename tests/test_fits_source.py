"""The FITS data source: units, planes, byte ranges, column pruning and damaged files."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from nightsieve.sources import files, fits, fits_source
from tests.skies import card, write_fits


@pytest.fixture(scope="module")
def source(spark):
    fits_source.register(spark)
    return lambda path, **options: spark.read.format("fits_slabs").options(**options).load(str(path))


def rebuilt(rows):
    """{(file, unit): planes} put together from slabs; every sample exactly once."""
    out = {}
    for r in rows:
        image = out.setdefault((r.path.rsplit("/", 1)[1], r.hdu), np.full((r.planes, r.height, r.width), np.nan))
        place = image[r.plane, r.y0:r.y0 + r.rows]
        assert np.isnan(place).all(), "a slab came twice"
        place[:] = np.array(r.samples).reshape(r.rows, r.width)
    assert not any(np.isnan(image).any() for image in out.values())
    return out


def table_unit(rows=3, heap=5000):
    cards = ["XTENSION= 'BINTABLE'".ljust(80), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 0), card("NAXIS2", rows), card("PCOUNT", heap), card("GCOUNT", 1), "END".ljust(80)]
    return "".join(cards).encode().ljust(2880) + b"\0" * (-(-heap // 2880) * 2880)


@pytest.mark.parametrize("split", [2000, 10_000, 1 << 20])
@pytest.mark.parametrize("slab_rows", [7, 64])
def test_units_and_planes(source, tmp_path, split, slab_rows):
    rng = np.random.default_rng(3)
    want = {}
    for name, planes, bitpix in (("one", 1, 16), ("two", 2, -32), ("three", 3, 32), ("five", 5, 8)):
        cube = rng.integers(0, 200, (planes, 45, 31)).astype(float)
        write_fits(tmp_path / f"{name}.fits", cube if planes > 1 else cube[0], bitpix)
        want[f"{name}.fits", 0] = cube
    parts = [rng.integers(0, 200, (2, 20, 9)).astype(float), rng.integers(0, 200, (33, 50)).astype(float)]
    write_fits(tmp_path / "p.tmp", parts[0], 16, primary_first=True)
    write_fits(tmp_path / "q.tmp", parts[1], -64)
    pieces = (tmp_path / "p.tmp").read_bytes(), table_unit(), (tmp_path / "q.tmp").read_bytes(), b"\0" * 2880
    (tmp_path / "units.FIT").write_bytes(b"".join(pieces))
    want["units.FIT", 1], want["units.FIT", 3] = parts[0], parts[1][None]
    rows = source(tmp_path, splitBytes=split, slabRows=slab_rows).collect()
    assert not [r.error for r in rows if r.error]
    found = rebuilt(rows)
    assert found.keys() == want.keys() and all(np.array_equal(found[k], want[k]) for k in want)


def test_ranges_cover_each_byte_once():
    listing = [("a", 0), ("b", 100), ("c", 101), ("d", 7), ("e", 350), ("f", 60)]
    parts = fits_source.byte_ranges(listing, 100)
    for path, size in listing:
        own = sorted(r[1:] for p in parts for r in p.ranges if r[0] == path)
        assert [s for s, _ in own] == list(range(0, max(1, size), 100)) and own[-1][1] is None
        assert all(end == start for (_, end), (start, _) in zip(own, own[1:]))
    assert all(len(p.ranges) == 1 or sum(dict(listing)[r[0]] - r[1] for r in p.ranges) <= 100 for p in parts)
    assert fits_source.byte_ranges([], 100) == []


def test_same_samples_as_slabs_of_headers(spark, source, tmp_path):
    rng = np.random.default_rng(5)
    write_fits(tmp_path / "a.fits", np.round(rng.normal(1000, 50, (3, 70, 40))), extra=[("BSCALE", "x")])
    header = fits.header_table(files.discover_files(spark, str(tmp_path)))
    old = {(r.path, r.channel, r.y0): r.samples for r in fits.image_slabs(header, 32).collect()}
    new = {(r.path, r.plane, r.y0): r.samples for r in source(tmp_path, slabRows=32).collect()}
    assert old == new


def test_only_wanted_columns_units_and_planes(spark, source, tmp_path, monkeypatch):
    write_fits(tmp_path / "a.fits", np.ones((4, 10, 6)), primary_first=True, extra=[("FILTER", "'Ha'")])
    places = spark.read.format("fits_slabs").schema("cards map<string,string>, plane int, path string").load(str(tmp_path)).collect()
    assert sorted(r.plane for r in places) == [0, 1, 2, 3] and all(r.cards["FILTER"] == "'Ha'" for r in places)
    assert places[0].path == f"file:{tmp_path}/a.fits"
    assert sorted((r.plane, r.hdu) for r in source(tmp_path, planes="1,3", units="1").collect()) == [(1, 1), (3, 1)]
    assert source(tmp_path, units="0").count() == 0
    with pytest.raises(AnalysisException, match="no such columns"):
        spark.read.format("fits_slabs").schema("colour int").load(str(tmp_path)).collect()

    # without samples no data are read
    reader = fits_source.SlabReader({"path": str(tmp_path)}, spark.createDataFrame([], "plane int, y0 int").schema)
    reads, plain = [], fits_source.open_path

    class Watched:
        def __init__(self, path):
            self.handle = plain(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.handle.close()

        def __getattr__(self, name):
            return getattr(self.handle, name)

        def read(self, n):
            reads.append(n)
            return self.handle.read(n)

    monkeypatch.setattr(fits_source, "open_path", Watched)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4
    assert set(reads) <= {8, fits.BLOCK}
    reads.clear()
    reader.names = ["samples"]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4
    assert sum(n for n in reads if n not in (8, fits.BLOCK)) == 4 * 10 * 6 * 2


@pytest.mark.parametrize("split", [3000, 1 << 20])
def test_damaged_files_are_rows_with_an_error(source, tmp_path, split):
    write_fits(tmp_path / "good.fits", np.ones((40, 10)))
    data = (tmp_path / "good.fits").read_bytes()
    (tmp_path / "short.fits").write_bytes(data[:2880 + 10 * 2 * 25])
    (tmp_path / "bad.fits").write_bytes(b"x" * 10_000)
    (tmp_path / "empty.fits").write_bytes(b"")
    (tmp_path / "second.fits").write_bytes(data + b"XTENSION= 'IMAGE   '".ljust(4000))
    wide = "".join(["SIMPLE  =                    T".ljust(80), card("BITPIX", 16), card("NAXIS", 2), card("NAXIS1", 10**15), card("NAXIS2", "INF"), "END".ljust(80)])
    (tmp_path / "wide.fits").write_bytes(wide.replace("INF", "9E9").encode().ljust(2880) + b"\0" * 9000)
    (tmp_path / "inf.fits").write_bytes(wide.encode().ljust(2880))
    (tmp_path / "deep").mkdir()
    write_fits(tmp_path / "deep" / "more.fits", np.ones((4, 4)))
    rows = source(f"{tmp_path};{tmp_path}/absent; ", splitBytes=split, slabRows=10).collect()
    errors = {}
    for r in rows:
        if r.error:
            assert r.samples is None
            errors.setdefault(r.path.rsplit("/", 1)[1], []).append(r.error)
    assert {k: len(v) for k, v in errors.items()} == {n: 1 for n in ("short.fits", "bad.fits", "empty.fits", "second.fits", "wide.fits", "inf.fits")}
    assert "ends inside" in errors["short.fits"][0] and "no image" in errors["empty.fits"][0] and "axes above" in errors["wide.fits"][0]
    whole = [(r.path.rsplit("/", 1)[1], r.y0) for r in rows if not r.error]
    assert sorted(whole) == [("good.fits", y) for y in (0, 10, 20, 30)] + [("second.fits", y) for y in (0, 10, 20, 30)] + [("short.fits", 0), ("short.fits", 10)]
    assert source(tmp_path, recursiveFileLookup="true").filter("path like '%more.fits' and samples[15] = 1").count() == 1
    assert source(tmp_path / "absent").count() == 0
