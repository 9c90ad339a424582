import os

from hirelake.streaming import changed as C
from tests.test_streaming import put


def follow(spark, tmp_path):
    files = C.changed_files(spark, str(tmp_path / "in"))
    query = C.follow(files, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    rows = C.current(spark, str(tmp_path / "out")).select("job_id", "title").collect()
    return sorted(map(tuple, rows)), C.files_read(spark, str(tmp_path / "out")).count()


def test_edited_file_replaces_its_rows_and_no_other_is_read_again(spark, tmp_path):
    folder = tmp_path / "in" / "day1"
    put(folder, "1", "a", "b")
    put(folder, "2", "c")
    put(folder / "_hidden", "3", "x")
    (folder / "other.json").write_text("{}")
    assert follow(spark, tmp_path) == ([("a", "1-a"), ("b", "1-b"), ("c", "2-c")], 2)
    assert follow(spark, tmp_path) == ([("a", "1-a"), ("b", "1-b"), ("c", "2-c")], 2)  # a restart changes nothing
    put(folder, "1", "b", "d", "d")
    assert follow(spark, tmp_path) == ([("b", "1-b"), ("c", "2-c"), ("d", "1-d"), ("d", "1-d")], 3)
    (folder / "boss_jobs_2.json").write_text("{ broken")  # nothing readable is left in it
    put(folder, "4", "e")
    assert follow(spark, tmp_path) == ([("b", "1-b"), ("d", "1-d"), ("d", "1-d"), ("e", "4-e")], 5)
    path = C.compacted(spark, str(tmp_path / "out"), str(tmp_path / "tables"), "rows")
    assert sorted(r["job_id"] for r in spark.read.parquet(path).collect()) == ["b", "d", "d", "e"]


def test_files_of_one_time_are_read_once_each(spark, tmp_path):
    folder = tmp_path / "in"
    for name in ("2", "3"):
        put(folder, name, name)
        os.utime(folder / f"boss_jobs_{name}.json", ns=(10**18, 10**18))
    assert follow(spark, tmp_path) == ([("2", "2-2"), ("3", "3-3")], 2)
    put(folder, "4", "4")
    os.utime(folder / "boss_jobs_4.json", ns=(10**18, 10**18))  # same time, later path
    assert follow(spark, tmp_path) == ([("2", "2-2"), ("3", "3-3"), ("4", "4-4")], 3)


def test_replayed_range_leaves_out_files_that_changed_since(tmp_path):
    folder = tmp_path / "in"
    for k in range(5):
        put(folder, str(k), "a")
        os.utime(folder / f"boss_jobs_{k}.json", ns=(k, k))
    reader = C.ChangedFilesReader({"path": str(folder)})
    start, end = reader.initialOffset(), reader.latestOffset()

    def names():
        return [p.rsplit("_", 1)[1] for part in reader.partitions(start, end) for _, p in part.files]

    assert names() == [f"{k}.json" for k in range(5)]
    os.utime(folder / "boss_jobs_2.json", ns=(9, 9))
    assert names() == ["0.json", "1.json", "3.json", "4.json"]
    start, end = end, reader.latestOffset()
    assert names() == ["2.json"]


def test_empty_folder(spark, tmp_path):
    reader = C.ChangedFilesReader({"path": str(tmp_path / "none")})
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []


def test_tasks_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(C, "TASK_FILES", 2)
    for k in range(5):
        put(tmp_path, str(k), "a")
    reader = C.ChangedFilesReader({"path": str(tmp_path)})
    assert [len(p.files) for p in reader.partitions(reader.initialOffset(), reader.latestOffset())] == [2, 2, 1]
