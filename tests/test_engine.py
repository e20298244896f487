import json

import pytest
from conftest import png

from hashloom import registry
from hashloom.engine import Engine
from hashloom import responses
from hashloom.errors import AlreadyRunning, HashesNotEqualLength, HashingMethodNotFound, InvalidName, InvalidSetting, NoRun, NotEnoughHashes, PathNotFound, StoreError, UndecodableImage
from hashloom.sources import images as image_source
from hashloom.sources.plot import plot_roc


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "images"
    (root / "u1").mkdir(parents=True)
    rows = [[(r * 31 + c * 17) % 256 for c in range(20)] for r in range(16)]
    png(root / "u1" / "a.png", rows)
    png(root / "b.png", rows)
    (root / "bad.txt").write_text("no image")
    return root


def _engine(spark, tmp_path, folder, **more):
    return Engine(spark=spark, store=str(tmp_path / "store"), images_path=str(folder), modifications=registry.example_modifications(), now=lambda: 1700000000000, **more)


def test_whole_run(spark, tmp_path, folder):
    e = _engine(spark, tmp_path, folder)
    e.set_selected_modifications([1, 2, 3])
    e.set_selected_methods([1, 2])
    assert e.run() == 1
    s = e.store
    assert {r.user for r in s.read("images").collect()} == {"u1", "images"}
    assert s.read("images").count() == 3 and s.read("run_images").count() == 3
    assert {(r.id, r.name) for r in s.read("modifications").collect()} == {(1, "rotate90"), (2, "rotate270"), (3, "blur0.5")}
    assert s.read("modified_images").count() == 6 and s.read("hashes").count() == 12
    assert s.read("matches").count() == 2 * 15
    assert [r.path.rsplit("/", 1)[1] for r in e.undecodable.collect()] == ["bad.txt"]
    assert s.active_run() == 1
    literal = e.roc("same_modification").collect()
    assert len(literal) == 99 and all(r.tp_rate is None for r in literal)  # equal images are other images: no positives
    assert all(r.tp_rate is not None for r in e.roc("all").collect())
    assert e.roc("all", methods=["average_hash8"]).count() == 0
    again = e.run()
    assert again == 2 and s.read("images").count() == 3 and s.read("hashes").count() == 12 and s.read("run_images").count() == 6
    assert e.roc("all", run_id=2).first()["tn"] is not None
    assert plot_roc(e.roc("all"), str(tmp_path / "roc.svg")) == 99 and (tmp_path / "roc.svg").read_text().count("<circle") == 99
    s.views()
    assert spark.sql("select count(*) n from active_run_hashes").first().n == 12
    assert spark.sql("select count(*) n from runs").first().n == 2


def test_nothing_selected(spark, tmp_path, folder):
    e = _engine(spark, tmp_path, folder)
    with pytest.raises(NoRun):
        e.store.active_run()
    assert e.run() == 1
    assert e.store.read("images").count() == 3 and e.store.read("hashes").count() == 0 and e.store.read("matches").count() == 0


def test_literal_selection(spark, tmp_path, folder):
    stages = []
    e = _engine(spark, tmp_path, folder, compat_selection=True, methods=[registry.average_hash(8)], progress=lambda stage, run: stages.append(stage))
    e.set_selected_modifications([3])
    e.set_selected_methods([0])
    e.run()
    assert [r.name for r in e.store.read("modifications").collect()] == ["rotate180"] and stages == ["images", "hashes", "matches"]


def test_refusals(spark, tmp_path, folder):
    e = _engine(spark, tmp_path, folder)
    with pytest.raises(PathNotFound):
        e.start_run(str(tmp_path / "none"), [0], [0])
    assert not e.running()
    e._running.acquire()
    with pytest.raises(AlreadyRunning):
        e.run()
    e._running.release()
    with pytest.raises(StoreError):
        e.store.read("nothing")
    (folder / "u1" / "a.png").unlink()
    e.set_path(str(folder))
    e.set_selected_methods([0])
    e.set_selected_modifications([0])
    with pytest.raises(NotEnoughHashes):
        e.run()


def test_uploads(spark, tmp_path, folder):
    e = _engine(spark, tmp_path, folder)
    assert e.submit_images("ann", [("../x/p.png", b"1"), (None, b"2"), ("", b"3")], str(tmp_path / "up")) == {"saved": 1, "skipped": 2}
    row = e.store.read("images").first()
    assert row.user == "ann" and row.path.endswith("/up/ann/p.png")
    assert not row.path.startswith("file:") and (tmp_path / "up" / "ann" / "p.png").read_bytes() == b"1"
    assert e.submit_images("ann", [("p.png", b"4"), ("a\\b\\q.png", b"5"), ("..", b"6"), ("x/.", b"7")], str(tmp_path / "up")) == {"saved": 2, "skipped": 2}
    assert sorted((r.id, r.path.rsplit("/", 1)[1]) for r in e.store.read("images").collect()) == [(0, "p.png"), (1, "q.png")]
    for name in ("..", ".", "../x", "a/b"):
        with pytest.raises(InvalidName):
            e.submit_images(name, [("p.png", b"1")], str(tmp_path / "up"))
    assert sorted(p.name for p in (tmp_path / "up").iterdir()) == ["ann"]
    assert e.health() == "ok" and e.list_methods().count() == 8 and e.list_modifications().count() == 5


def test_selection():
    methods = registry.default_methods()
    assert [i for i, _ in registry.select(methods, [3, 1, 1, 99])] == [1, 3]
    assert [(k, i) for k, i, _ in registry.renumbered(registry.select(methods, [3, 1]))] == [(0, 1), (1, 3)]
    assert registry.blurring(0.5).name != registry.blurring(0.9).name and registry.blurring(0.5).name_group == "blur"
    assert registry.gradient().name == "gradient8"
    with pytest.raises(HashingMethodNotFound):
        registry.method(methods, "none")


def test_an_upload_keeps_its_id_when_scanned(spark, tmp_path, folder):
    e = _engine(spark, tmp_path, folder)
    e.submit_images("u1", [("a.png", (folder / "u1" / "a.png").read_bytes())], str(folder))
    e.run()
    rows = e.store.read("images").collect()
    assert len(rows) == 3 and {r.id for r in rows if r.path.endswith("a.png")} == {0}


def test_root_that_is_a_file(spark, folder):
    rows = image_source.scan(spark, str(folder / "u1" / "a.png")).collect()
    assert [(r.image_id, r.user) for r in rows] == [(0, "undefined")]


def test_only_missing_hashes_are_made(spark, tmp_path, folder):
    e = _engine(spark, tmp_path, folder, methods=[registry.average_hash(8), registry.vert_gradient(8)])
    e.start_run(str(folder), [0], [0])
    mods, methods = registry.select(e.modifications, [0]), registry.select(e.methods, [0])
    images = e.store.read("images").withColumnRenamed("id", "image_id")
    assert [r.path.rsplit("/", 1)[1] for r in e._unhashed(images, mods, methods).collect()] == ["bad.txt"]
    assert e._unhashed(images, mods, registry.select(e.methods, [0, 1])).count() == 3
    e.start_run(str(folder), [0, 1], [0])
    assert e.store.read("hashes").count() == 4 and [r.path.rsplit("/", 1)[1] for r in e.undecodable.collect()] == ["bad.txt"]
    assert e.roc_of_hashes().count() == 2 * 99


def test_a_failing_method_loses_its_hashes_only(spark, tmp_path, folder):
    def fails(px):
        raise ValueError("no")

    def picky(px):
        if len(px) > 1 or px[0, 0, 0] > 0:
            raise ValueError("no")
        return px

    png(folder / "c.png", [[200] * 20] * 16)
    e = Engine(spark=spark, store=str(tmp_path / "s"), images_path=str(folder), modifications=[registry.rotation(90), registry.Modification("picky", picky), registry.Modification("none", fails)], methods=[registry.average_hash(8), registry.HashMethod("bad", 64, fails)])
    e.set_selected_modifications([0, 1, 2])
    e.set_selected_methods([0, 1])
    e.run()
    assert sorted((r.modification_id) for r in e.store.read("modified_images").collect()) == [0, 0, 0, 1, 1]
    assert {r.hashing_method_id for r in e.store.read("hashes").collect()} == {0}


def test_strict_run(spark, tmp_path, folder):
    e = _engine(spark, tmp_path, folder, strict=True)
    with pytest.raises(UndecodableImage):
        e.start_run(str(folder), [0], [0])
    from hashloom.operators.matching import require_equal_lengths

    with pytest.raises(HashesNotEqualLength):
        require_equal_lengths(spark.createDataFrame([(0, 64, [1]), (0, 128, [1, 2])], "hashing_method_id int, nbits int, words array<bigint>"))


def test_settings_are_checked(spark, tmp_path):
    ok = {"spark": spark, "store": str(tmp_path / "s")}
    for bad in ({"store": " "}, {"rendering": "other"}, {"within": 0}, {"methods": [registry.rotation(90)]}, {"modifications": [registry.rotation(90)] * 2}, {"now": 5}):
        with pytest.raises(InvalidSetting):
            Engine(**{**ok, **bad})


def test_responses(spark, tmp_path, folder):
    e = _engine(spark, tmp_path, folder)
    assert json.loads(responses.runs(e)) == []
    assert json.loads(responses.start_run(e, json.dumps({"path": str(folder), "hashing_methods": [1], "modifications": [0]}))) == {"run_id": 1}
    assert json.loads(responses.runs(e)) == [{"id": 1, "timestamp": 1700000000000}]
    assert json.loads(responses.run_hashing_methods(e)) == [1] and json.loads(responses.run_modifications(e)) == [0]
    assert json.loads(responses.hashing_methods(e))[:2] == ["average_hash8", "average_hash16"] and json.loads(responses.modifications(e))[0] == "rotate180"
    assert json.loads(responses.start_run(e, json.dumps({"path": str(tmp_path / "none"), "hashing_methods": [], "modifications": []})))["error"] == "PathNotFound"
    assert json.loads(responses.submitted({"saved": 1, "skipped": 2})) == {"saved": 1, "skipped": 2} and json.loads(responses.health(e)) == "ok"


def test_within_keeps_near_matches_only(spark, tmp_path, folder):
    png(folder / "c.png", [[(r * 7) % 256 for c in range(20)] for r in range(16)])
    e = _engine(spark, tmp_path, folder, within=0.1)
    e.start_run(str(folder), [0], [0])
    assert [(r.hamming_distance, r.hash_len) for r in e.store.read("matches").collect()] == [(0, 64)]
