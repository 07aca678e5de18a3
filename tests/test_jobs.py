"""Whole jobs and the stream, on small folders."""

from textloom.jobs import workloads
from textloom.operators import narration
from textloom.streaming import clean


def folder(tmp_path):
    book = tmp_path / "book"
    book.mkdir()
    for k in range(4):
        (book / f"page_{k + 1:04d}.txt").write_text(f"Running Head\n本 文{k}です。\n次の行。\n{k}\n")
    return str(book)


def test_clean_folder(spark, tmp_path):
    stats = workloads.clean_folder(spark, folder(tmp_path), str(tmp_path / "out"))
    assert tuple(stats.first()) == ("book", 4, 4)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("page_num").collect()
    assert [r["text"] for r in rows] == [f"本文{k}です。" for k in range(4)]  # 次の行。 is on every page too


def test_narrate_folder(spark, tmp_path):
    catalog = narration.catalogue(spark.createDataFrame([('[{"name":"A","styles":[{"name":"N","id":7}]}]',)], "json string"))
    workloads.narrate_folder(spark, folder(tmp_path), catalog, str(tmp_path / "out"), "a_n")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) >= 4 and {r["speaker_id"] for r in rows} == {7}


def test_normalise_list(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A\tx・y"), (2, "head"), (3, "B\ty")], "row_no int, value string")
    workloads.normalise_list(spark, rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/group_member")).count() == 3
    assert spark.read.text(str(tmp_path / "out/groups_sql")).first()[0] == 'INSERT INTO groups(id, name) VALUES(1, "A"), (2, "B");'


def test_collection_report(spark, tmp_path):
    workloads.collection_report(spark.createDataFrame([("X/a/1.flac",)], "path string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 19


def test_stream(spark, tmp_path):
    query = clean.write_stream(clean.format_stream(clean.read_stream(spark, folder(tmp_path))), str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
