from pathlib import Path

from blockloom import storage


def test_written_tables_go_again(spark):
    df = spark.range(5)
    a, b = storage.written(df, "a"), storage.written(df, "b", 1)
    paths = [Path(t._blockloom_path.removeprefix("file://").removeprefix("file:")) for t in (a, b)]
    assert a.count() == b.count() == 5 and all(p.exists() for p in paths)
    assert len(list(paths[1].glob("*.parquet"))) == 1
    storage.drop(a)
    assert not paths[0].exists() and paths[1].exists()
    path = storage.new_path(spark, "c")
    df.write.parquet(path)
    storage._PATHS.pop(b._blockloom_path)  # as if it belonged to another
    for p in [p for p in storage._PATHS if p.startswith(path)]:
        storage.remove(p)
    assert paths[1].exists() and not Path(path.removeprefix("file://")).exists()
    storage.drop(b)
