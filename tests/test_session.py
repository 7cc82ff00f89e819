import os

from framequilt import session


def test_discard_removes_the_files_of_a_cut(spark):
    df = session.cut(spark.range(100))
    assert df.count() == 100
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path)
    other = session.cut(df.filter("id < 10"))
    session.discard(df)
    session.discard(spark.range(5))
    assert not os.path.exists(path) and other.count() == 10


def test_files_on_any_store(spark, tmp_path):
    session.write_file(spark, str(tmp_path / "sub" / "a.txt"), "für")
    assert session.exists(spark, str(tmp_path / "sub")) and not session.exists(spark, str(tmp_path / "none"))
    assert session.names_in(spark, str(tmp_path / "sub")) == [".a.txt.crc", "a.txt"] or session.names_in(spark, str(tmp_path / "sub")) == ["a.txt"]
    assert session.read_file(spark, str(tmp_path / "sub" / "a.txt")).decode() == "für"
    assert session.scratch(spark, "x") != session.scratch(spark, "x")
