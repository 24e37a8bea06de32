import os

import pytest

from strataq.llm import _store as S


def test_files_appear_whole_or_not_at_all(tmp_path):
    uri = f"file://{tmp_path}/a b/file"
    assert S.put(uri.replace(" ", "%20"), [b"one", b"two"]) == 6
    with S.opened(f"{tmp_path}/a b/file") as f:
        assert f.read() == b"onetwo"

    def broken():
        yield b"half"
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        S.put(f"{tmp_path}/bad", broken())
    assert os.listdir(tmp_path) == ["a b"]
    S.put(f"{tmp_path}/a b/file", [b"again"])
    assert os.listdir(tmp_path / "a b") == ["file"] and (tmp_path / "a b" / "file").read_bytes() == b"again"


def test_tables_in_the_shared_folder(spark):
    df, path = S.kept(spark.range(10).withColumnRenamed("id", "x"), "test")
    assert path.startswith(S.shared_dir(spark)) and df.count() == 10
    assert S.kept(df.where("x > 50"), "test")[0].count() == 0
    S.drop(spark, path)
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_no_folder_of_one_machine_on_a_cluster(spark):
    import types

    context = types.SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    session = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        S.shared_dir(session)


def test_a_scope_drops_its_tables_but_those_that_stay(spark):
    names = lambda: {s.getPath().getName().rsplit("-", 1)[0] for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)}
    df = spark.range(10)
    at = spark._jvm.org.apache.hadoop.fs.Path(S.shared_dir(spark))
    with S.Scope(spark):
        with S.Scope(spark) as inner:
            S.kept(df, "scope-gone")
            stays = inner.keep(S.kept(df, "scope-stays"))
        assert "scope-gone" not in names() and stays.count() == 10
    assert "scope-stays" not in names()
    assert spark.conf.get(S._CLEANUP, None) in (None, "false")
