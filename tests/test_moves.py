"""Moves onto folders that hold files already, broken-off runs and names taken meanwhile."""

import os

import pytest

from nightsieve.operators.moves import destination_folders, move_manifest
from nightsieve.sources import files, reports

COLUMNS = "path string, file_name string, relative_path string, filter_name string, is_rejected boolean"


def frames_of(spark, folder, names, rejected=True):
    os.makedirs(folder, exist_ok=True)
    for name in names:
        (folder / name).write_text(f"new {name}")
    return spark.createDataFrame([(f"file:{folder}/{n}", n, "", "Ha", rejected) for n in names], COLUMNS)


def named(df, **options):
    return {r[0].rsplit("/", 1)[1]: r[1] for r in move_manifest(df, "/out", id_col="path", **options).collect()}


def test_names_are_free(spark, tmp_path):
    df = frames_of(spark, tmp_path / "in", ["a.fits", "B.FITS", "c_2.fits", "c.fits", "d", "e.fits"])
    there = spark.createDataFrame([(f"/out/{n}",) for n in ("a.fits", "A.fits", "b.fits", "b_7.fits", "c.fits", "c_2.fits", "d", "sub/e.fits")] + [(None,)], "path string")
    got = named(df, existing=there)
    assert got == {"a.fits": "/out/a_1.fits", "B.FITS": "/out/B_8.FITS", "c.fits": "/out/c_3.fits", "c_2.fits": "/out/c_4.fits", "d": "/out/d_1", "e.fits": "/out/e.fits"}
    assert named(df, existing=there.limit(0)) == named(df) == {n: f"/out/{n}" for n in got}
    assert move_manifest(df, " ", id_col="path", existing=there).count() == 0
    assert move_manifest(df.limit(0), "/out", id_col="path", existing=there).count() == 0


def test_many_meet_one_existing_name(spark):
    df = spark.range(3000).selectExpr("cast(id as string) path", "'x.fits' file_name", "'' relative_path", "'Ha' filter_name", "true is_rejected")
    there = spark.range(500).selectExpr("concat('/out/', if(id % 2 = 0, 'X', 'x'), if(id < 2, '', concat('_', id)), '.fits') path")
    got = [r[0] for r in move_manifest(df, "/out", id_col="path", existing=there).select("destination").collect()]
    old = {r[0].lower() for r in there.collect()}
    assert len({g.lower() for g in got}) == 3000 and not old & {g.lower() for g in got}


def test_files_move_beside_those_there(spark, tmp_path):
    df = frames_of(spark, tmp_path / "in", ["a.fits", "b.fits"])
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a.fits").write_text("old")
    moved = reports.move_frames(df, str(tmp_path / "out"), str(tmp_path / "journal"))
    assert sorted((os.path.basename(r.destination), r.status) for r in moved.collect()) == [("a_1.fits", "moved"), ("b.fits", "moved")]
    texts = {n: (tmp_path / "out" / n).read_text() for n in os.listdir(tmp_path / "out")}
    assert texts == {"a.fits": "old", "a_1.fits": "new a.fits", "b.fits": "new b.fits"}
    assert reports.finish_moves(spark, str(tmp_path / "journal")).count() == 0
    # a new file of an old name is a new move
    again = frames_of(spark, tmp_path / "in", ["a.fits"])
    assert [os.path.basename(r.destination) for r in reports.move_frames(again, str(tmp_path / "out"), str(tmp_path / "journal")).collect()] == ["a_2.fits"]
    assert reports.move_frames(again.limit(0), str(tmp_path / "out"), str(tmp_path / "journal")).count() == 0


def test_a_run_that_was_broken_off_is_finished_by_its_plan(spark, tmp_path):
    df = frames_of(spark, tmp_path / "in", ["a.fits", "b.fits", "c.fits"])
    out, journal = tmp_path / "out", str(tmp_path / "journal")
    plan = move_manifest(df, str(out), id_col="path", existing=files.files_in(destination_folders(df, str(out))))
    plan.selectExpr("'first' run", "path", "destination").write.parquet(f"{journal}/planned")
    out.mkdir()
    os.rename(tmp_path / "in/a.fits", out / "a.fits")  # done before the driver was lost
    done = {os.path.basename(r.path): r.status for r in reports.finish_moves(spark, journal).collect()}
    assert done == {n: "moved" for n in ("a.fits", "b.fits", "c.fits")}
    assert sorted(os.listdir(out)) == ["a.fits", "b.fits", "c.fits"] and os.listdir(tmp_path / "in") == []


def test_a_name_taken_meanwhile_is_planned_again(spark, tmp_path, monkeypatch):
    df = frames_of(spark, tmp_path / "in", ["a.fits", "b.fits"])
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a.fits").write_text("somebody else's")
    listed, rounds = reports.files_in, []

    def late(folders):
        rounds.append(folders)
        return listed(folders).limit(0) if len(rounds) == 1 else listed(folders)

    monkeypatch.setattr(reports, "files_in", late)
    moved = reports.move_frames(df, str(tmp_path / "out"), str(tmp_path / "journal"))
    assert len(rounds) == 2
    assert sorted((os.path.basename(r.destination), r.status) for r in moved.collect()) == [("a_1.fits", "moved"), ("b.fits", "moved")]
    assert (tmp_path / "out/a.fits").read_text() == "somebody else's"


@pytest.mark.parametrize("named_as", ["{}", "file:{}", "file://{}"])
def test_listing_has_the_form_of_the_folder(spark, tmp_path, named_as):
    (tmp_path / "deep").mkdir()
    for name in ("empty.fits", "_hidden.fits", ".dot"):
        (tmp_path / "deep" / name).write_text("")
    folder = named_as.format(tmp_path)
    asked = spark.createDataFrame([(folder,), (folder,), (f"{folder}/deep",), (f"{folder}/absent",), (None,)], "folder string")
    assert sorted(r[0] for r in files.files_in(asked).collect()) == sorted([f"{folder}/deep", *(f"{folder}/deep/{n}" for n in ("empty.fits", "_hidden.fits", ".dot"))])


def test_hidden_and_empty_files_and_folders_take_names(spark, tmp_path):
    df = frames_of(spark, tmp_path / "in", ["_a.fits", "b.fits", "c.fits"])
    for name in ("_a.fits", "b.fits"):
        os.makedirs(tmp_path / "out", exist_ok=True)
        (tmp_path / "out" / name).write_text("")
    (tmp_path / "out/c.fits").mkdir()
    moved = reports.move_frames(df, str(tmp_path / "out"), str(tmp_path / "journal"))
    assert sorted(os.path.basename(r.destination) for r in moved.collect()) == ["_a_1.fits", "b_1.fits", "c_1.fits"]
