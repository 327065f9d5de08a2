"""Keyed state under writers at once: no change is lost, readers keep what they read, a draft is no commit."""

from concurrent.futures import ThreadPoolExecutor

from quillgraph.sources import readers

SCHEMA = "key string, value string, at int"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    write = lambda i: readers.write_state(spark, path, _rows(spark, (f"k{i}", "v", i), ("shared", f"v{i}", i)), "key", "at").count()
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(8)))
    found = {r.key: r.value for r in readers.read_state(spark, path, SCHEMA).collect()}
    assert set(found) == {"shared", *(f"k{i}" for i in range(8))} and found["shared"].startswith("v")
    assert sorted(p.name for p in (tmp_path / "state/log").iterdir() if not p.name.startswith(".")) == [f"{i:012d}" for i in range(8)]


def test_a_taken_number_is_refused_and_retried(spark, tmp_path, monkeypatch):
    path, taken = str(tmp_path / "state"), []
    readers.write_state(spark, path, _rows(spark, ("a", "1", 1)), "key", "at")
    put = readers._put_if_absent

    def late(spark, path, number, text):
        if not taken:
            taken.append(number)  # another writer comes first
            readers.write_state(spark, path, _rows(spark, ("b", "2", 2)), "key", "at")
        return put(spark, path, number, text)

    monkeypatch.setattr(readers, "_put_if_absent", late)
    got = readers.write_state(spark, path, _rows(spark, ("c", "3", 3)), "key", "at")
    assert {r.key for r in got.collect()} == {"a", "b", "c"} and taken == [1]


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "state")
    readers.write_state(spark, path, _rows(spark, ("a", "1", 1)), "key", "at")
    before = readers.read_state(spark, path, SCHEMA)
    readers.write_state(spark, path, _rows(spark, ("a", "2", 2)), "key", "at")
    assert before.first().value == "1" and readers.read_state(spark, path, SCHEMA).first().value == "2"
    assert readers.read_state(spark, path, SCHEMA, version=0).first().value == "1"
    (tmp_path / "state/rows-unfinished").mkdir()
    (tmp_path / "state/drafts/x").write_text("rows-unfinished")
    assert readers.read_state(spark, path, SCHEMA).first().value == "2"
    assert readers.delete_state(spark, path, SCHEMA, "key", ["a"]).count() == 0 == readers.read_state(spark, path, SCHEMA).count()
