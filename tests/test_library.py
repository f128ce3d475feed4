from __future__ import annotations

import shutil
import threading
import time

import numpy as np
import pytest

from loomlake import cli
from loomlake.functions import embedders, imaging
from loomlake.operators import catalog as C
from loomlake.sources import images as I
from loomlake.sources import library as L
from loomlake.sources.config import Config
from loomlake.sources.library import Library
from loomlake.streaming import watch as W

from .conftest import pattern, write_png


@pytest.fixture
def library(spark, tmp_path, image_folder):
    out = Library(spark, f"file://{tmp_path}/tables", Config(library_roots=[str(image_folder), "/no/such/root"], hash_max_distance=20))
    out.reindex()
    return out


def test_index_again_and_search(spark, library, image_folder):
    assert library.stats() == {"total": 10, "ok": 9, "missing": 0, "error": 1, "vectors": 9}
    again = library.reindex()
    assert (again["new"], again["missing"], again["unchanged"]) == (0, 0, 9) and again["errors"] == 1  # the broken one is tried again
    query = f"{image_folder}/fam0_orig.png"
    for backend in ("hash", "embedding", "hybrid"):
        library.config.backend = backend
        rows = library.search([query], 5).orderBy("rank").collect()
        own = next(r for r in rows[:2] if r.path == query)  # its turned copy is as good
        assert own.hamming == 0 and own.is_duplicate and own.score > 0.99 and rows[0].score == pytest.approx(own.score)
        turned = next(r for r in rows if "fam0_rot90" in r.path)
        assert turned.hamming == 0
    library.config.backend = "hash"
    score = lambda alpha: next(r for r in library.search([query], 9, alpha).collect() if "fam0_recolor" in r.path).score
    assert score(0.0) > score(0.8)
    assert all(r.dist <= 4 for r in library.duplicates(4).collect())
    with pytest.raises(ValueError):
        library.search([])
    by_pixels = library.search_images([pattern(0)[0]], 5).orderBy("rank").first()
    assert by_pixels.hamming == 0 and by_pixels.score > 0.99
    with pytest.raises(ValueError):
        library.search_images([])
    for r in library.search([query], 3).collect():
        data = library.thumbnail(r.thumb_path)
        assert data.startswith(b"\x89PNG")
        (library_path := image_folder.parent / "thumb.png").write_bytes(data)
        shown = I.decode(spark, [str(library_path)]).first()
        assert (shown.height, shown.width) == (128, 128)
        assert ("[duplicate]" in cli.line(r)) == r.is_duplicate and r.path in cli.line(r)
    library.config.hash_size = 16
    for refused in (library.duplicates, lambda: library.search([query])):
        with pytest.raises(ValueError):
            refused()


def test_only_changed_files_are_decoded(spark, library, image_folder, monkeypatch):
    for p in (image_folder / "bad.png",):
        p.unlink()
    assert library.reindex()["decoded"] == 0
    names: list[str] = []
    decode = I.decode
    monkeypatch.setattr(I, "decode", lambda s, paths, folders=False: names.extend(paths) or decode(s, paths, folders))
    write_png(image_folder / "odd [1]{x}.png", pattern(7)[0])
    said: list[dict] = []
    counts = library.reindex(progress=said.append)
    assert (counts["new"], counts["decoded"], counts["errors"]) == (1, 1, 0) and names == [f"{image_folder}/odd [1]{{x}}.png"]
    assert [x["phase"] for x in said] == ["process", "finalize", "done"]
    monkeypatch.setattr(L, "GROUP_FILES", 2)
    for i in range(3):
        write_png(image_folder / f"more{i}.png", pattern(20 + i)[0])
    monkeypatch.setattr(L, "WHOLE_PART", 2.0)
    assert library.reindex()["decoded"] == 3
    monkeypatch.setattr(L, "WHOLE_PART", 0.0)
    write_png(image_folder / "more0.png", np.kron(pattern(30)[0], np.ones((2, 2, 1))))
    write_png(image_folder / "more1.png", np.kron(pattern(31)[0], np.ones((2, 2, 1))))
    counts = library.reindex()
    assert counts["changed"] == 2 and library.stats()["ok"] == 13
    assert library.thumbnails().count() == 13


class Shade:
    """Mean red, green and blue."""

    name = "shade-3"

    def embed_batch(self, images):
        return np.stack([x.reshape(-1, 3).mean(0) for x in images])


def test_an_embedder_serves_images_and_queries(spark, tmp_path, image_folder):
    library = Library(spark, f"file://{tmp_path}/shaded", Config(library_roots=[str(image_folder)], backend="embedding"), Shade())
    library.reindex()
    rows = library.table("vectors").collect()
    assert {(r.embedder, r.dim) for r in rows} == {("shade-3", 3)} and len(rows) == 9
    best = library.search([f"{image_folder}/fam1_recolor.png"], 1, 0.0).first()
    assert best.path.endswith("fam1_recolor.png") and best.pattern_score == pytest.approx(1)


def test_models_and_what_stands_in_for_them():
    class Session:
        def __init__(self, fixed, tokens):
            self.fixed, self.tokens, self.seen = fixed, tokens, []

        def get_inputs(self):
            return [type("Given", (), {"name": "x", "shape": [self.fixed, 3, 224, 224]})()]

        def run(self, _, given):
            self.seen.append(given["x"].shape[0])
            mean = given["x"].mean(axis=(2, 3))
            return [np.stack([mean, -mean], axis=1)] if self.tokens else [mean]

    grey = [np.full((300, 200, 3), v, np.uint8) for v in (0, 128, 255)]
    for fixed, tokens in ((None, False), (2, True)):
        session = Session(fixed, tokens)
        got = embedders.Model("m.onnx", lambda _, s=session: s).embed_batch(grey)
        assert got.shape == (3, 3) and session.seen == ([3] if fixed is None else [2, 2])
        expected = [[(v / 255 - m) / d for m, d in zip(embedders.MEAN, embedders.DEVIATION)] for v in (0, 128, 255)]
        assert np.allclose(got, expected, atol=1e-4)
    assert embedders.load(None).name == embedders.load("/no/such/model.onnx").name == "structure-456"


def test_settings_hold_any_value_and_versions_are_checked(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/t", Config())
    for value in ([1, {"a": None}], "text", 2.5, True):
        library.write("settings", C.upsert_settings(library.table("settings"), C.setting_row(spark, "settings", "v", value)))
        assert C.json_setting(library.table("settings"), "settings", "v") == value
    assert C.json_setting(library.table("settings"), "settings", "absent", 5) == 5
    library.write("settings", C.upsert_settings(library.table("settings"), C.setting_row(spark, "meta", "schema_version", 99)))
    with pytest.raises(ValueError):
        Library(spark, f"file://{tmp_path}/t")


def test_area_weights_are_overlaps():
    assert np.allclose(imaging.area_weights(4, 2), [[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]])
    assert np.allclose(imaging.area_weights(3, 2), [[2 / 3, 1 / 3, 0], [0, 1 / 3, 2 / 3]])
    x = np.random.default_rng(1).random((48, 64)) * 255
    assert np.allclose(imaging.averaged(x, 16, 16), np.rint(x.reshape(16, 3, 16, 4).mean(axis=(1, 3))))


def test_missing_comes_back(spark, library, image_folder):
    (image_folder / "fam1_orig.png").rename(image_folder / "away.txt")
    write_png(image_folder / "fam2_orig.png", np.kron(pattern(9)[0], np.ones((2, 2, 1))))
    counts = library.reindex()
    assert (counts["missing"], library.stats()["missing"]) == (1, 1) and counts["changed"] >= 1
    shutil.move(image_folder / "away.txt", image_folder / "fam1_orig.png")
    library.reindex()
    assert library.stats()["missing"] == 0 and library.stats()["ok"] == 9
    (image_folder / "bad.png").unlink()
    library.reindex()
    library.purge_missing()
    assert library.stats() == {"total": 9, "ok": 9, "missing": 0, "error": 0, "vectors": 9}


def test_unreachable_root_marks_nothing(spark, library):
    library.config.library_roots = ["/no/such/root"]
    assert library.reindex()["missing"] == 0 and library.stats()["ok"] == 9


def test_first_root_wins(spark, image_folder):
    rows = I.scan(spark, [str(image_folder / "deep"), str(image_folder)]).collect()
    assert len(rows) == 10 and {r.root for r in rows if "/deep/" in r.path} == {0}


def test_config(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/t", Config(backend="hybrid"))
    library.save_config()
    assert Library(spark, f"file://{tmp_path}/t").config.backend == "hybrid" and library.config.uses_embedding()
    assert Config.from_json("[broken") == Config() and Config.from_json('{"no_such": 1, "tta": false}').tta is False
    with pytest.raises(ValueError):
        Library(spark, f"file://{tmp_path}/t", Config(backend="psychic"))


def test_watched_folders_are_indexed_again(spark, tmp_path, library, image_folder):
    write_png(image_folder / "later.png", pattern(5)[0])
    for stream in library.watch(f"{tmp_path}/watching", every=None):
        stream.awaitTermination()
    assert library.stats()["ok"] == 10
    with library._busy:
        assert library.reindex_unless_busy() is None
    assert library.rescan(threading.Event()) is None
    library.config.rescan_interval_sec = 1
    write_png(image_folder / "last.png", pattern(6)[0])
    stop = threading.Event()
    thread = library.rescan(stop)
    for _ in range(90):
        time.sleep(1)
        if library.stats()["ok"] == 11:
            break
    stop.set()
    thread.join(120)
    assert library.stats()["ok"] == 11


def test_merging_a_batch_twice_changes_nothing(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k bigint, at bigint, x string")
    held = W.Merged(spark, f"file://{tmp_path}/merged", rows((1, 1, "")).schema, "k", "at")
    held.merge(rows((1, 1, "a"), (2, 1, "b"), (1, 2, "c")), 0)
    for _ in range(2):
        held.merge(rows((2, 5, "d"), (3, 5, "e")), 1)
        assert {tuple(r) for r in held.table().collect()} == {(1, 2, "c"), (2, 5, "d"), (3, 5, "e")}


def test_watch_gives_each_file_once(spark, tmp_path, image_folder):
    seen: list[str] = []
    note = lambda batch: seen.extend(r.key for r in batch.select("key").collect())
    go = lambda: W.watch(W.changes(spark, str(image_folder)), note, f"{tmp_path}/state", every=None).awaitTermination()
    go()
    assert len(seen) == len(set(seen)) == 10
    write_png(image_folder / "later.png", pattern(5)[0])
    go()
    assert [k for k in seen if k.endswith("later.png")] == [f"{image_folder}/later.png"] and len(seen) == 11
