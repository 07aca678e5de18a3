"""Files under their own names, and whole texts as one file each."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.operators import collection
from textloom.sources import files
from textloom.sources import pages as P

PAGES = [("a", 1, "one\r\ntwo\n\n\n\nthree"), ("a", 2, "  "), ("a", 3, "最後 é"), ("b", 12, "x"), ("b", 7, None), ("c d", 10_000, "y\n")]


def pages(spark):
    return spark.createDataFrame(PAGES, "corpus_id string, page_num int, text string")


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8", newline="").read() for d, _, names in os.walk(root) for f in names}


def seen(root):
    """Names but those of a job's own folder, which a task that is killed late may have made anew."""
    return [x for x in os.listdir(root) if not x.startswith("_temporary-")] if os.path.exists(root) else []


def test_page_files_by_name(spark, tmp_path):
    out = str(tmp_path / "out")
    P.write_page_files(pages(spark), out)
    head = "PDFファイル: {}\nページ番号: {}/{}\n" + "=" * 50 + "\n\n"
    assert tree(out) == {
        "a_pages/page_0001.txt": head.format("a", 1, 3) + "one\ntwo\n\nthree",
        "a_pages/page_0003.txt": head.format("a", 3, 3) + "最後 é",
        "b_pages/page_0012.txt": head.format("b", 12, 2) + "x",
        "c d_pages/page_10000.txt": head.format("c d", 10_000, 1) + "y\n",
    }
    back = {tuple(r) for r in P.read_page_files(spark, out).collect()}
    assert back == {("a", 1, 3, "one\ntwo\n\nthree"), ("a", 3, 3, "最後 é"), ("b", 12, 2, "x"), ("c d", 10_000, 1, "y\n")}
    by_spark = P.read_pages(spark, f"{out}/a_pages").select("corpus_id", "page_num", "file_name").collect()
    assert {tuple(r) for r in by_spark} == {("a_pages", 1, "page_0001.txt"), ("a_pages", 3, "page_0003.txt")}


def test_names_that_exist(spark, tmp_path):
    out = str(tmp_path / "out")
    P.write_page_files(pages(spark).where("corpus_id = 'a'"), out)
    with pytest.raises(Exception, match="there already"):
        P.write_page_files(pages(spark), out)
    assert set(tree(out)) == {"a_pages/page_0001.txt", "a_pages/page_0003.txt"}  # all of a job or nothing
    P.write_page_files(pages(spark).where("page_num <> 3"), out, overwrite=True)
    assert set(tree(out)) == {"a_pages/page_0001.txt", "b_pages/page_0012.txt", "c d_pages/page_10000.txt"}
    with pytest.raises(ValueError, match="2 rows are named"):
        files.write_named(spark.createDataFrame([("f", "x.txt", "1"), ("f", "x.txt", "2")], "folder string, file_name string, text string"), out)
    with pytest.raises(Exception, match="not a file name"):
        files.write_named(spark.createDataFrame([("f", "../x.txt", "1")], "folder string, file_name string, text string"), out)
    assert files.read_named(spark, out).count() == 3


def test_killed_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path)
    fails = F.when(F.col("id") == 199, F.raise_error(F.lit("killed"))).otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 200, 1, 4).select(F.lit("f").alias("folder"), F.format_string("page_%04d.txt", "id").alias("file_name"), fails.alias("text"), "id")
    files.register(spark)
    with pytest.raises(Exception, match="killed"):
        rows.drop("id").write.format("named_files").mode("append").save(out)
    assert seen(out) == []
    with pytest.raises(Exception, match="killed"):
        rows.select(F.lit("f").alias("file"), F.col("id").alias("at"), "text").write.format("ordered_files").mode("append").save(out)
    assert seen(out) == []
    assert files.read_named(spark, out).count() == 0


def test_reader_cuts_folders_into_parts(spark, tmp_path, monkeypatch):
    rows = spark.range(50).select(F.concat(F.lit("f"), F.col("id") % 3).alias("folder"), F.format_string("p%02d.txt", "id").alias("file_name"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("text"))
    files.write_named(rows, str(tmp_path))
    (tmp_path / "top.txt").write_text("top")
    (tmp_path / "f0" / "note.md").write_text("not read")
    monkeypatch.setattr(files, "PART_FILES", 7)
    parts = files.NamedFilesReader(str(tmp_path), ".txt").partitions()
    assert [len(p.names) for p in parts] == [7] * 7 + [2]
    got = {(r["folder"], r["file_name"]): r["text"] for r in files.read_named(spark, str(tmp_path)).collect()}
    assert got == {(f"f{k % 3}", f"p{k:02d}.txt"): "é" * k for k in range(50)} | {("", "top.txt"): "top"}
    assert files.read_named(spark, str(tmp_path / "f1"), ".none").count() == 0


@pytest.mark.parametrize("markers", [False, True])
def test_documents_as_one_file_each(spark, tmp_path, markers):
    many = pages(spark).unionByName(spark.range(3000).select(F.lit("long").alias("corpus_id"), F.col("id").cast("int").alias("page_num"), F.concat(F.lit("漢字 "), F.repeat(F.lit("z\n"), (F.col("id") % 17).cast("int"))).alias("text")))
    P.write_documents(many, str(tmp_path / "out"), markers)
    want = {f"{r['corpus_id']}.txt": r["text"] for r in P.whole_documents(many, markers).collect()}
    assert tree(str(tmp_path / "out")) == want
    parts = files.placed(many.select(F.lit("one").alias("file"), F.coalesce("text", F.lit("")).alias("text"), "corpus_id", "page_num"), ("corpus_id", "page_num"))
    rows = sorted((r["at"], len(r["text"].encode())) for r in parts.collect() if r["text"])
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))


def test_report_as_one_file(spark, tmp_path):
    albums = collection.album_tracks(spark.createDataFrame([(f"X{k % 7}/a{k % 23}/{k}.flac",) for k in range(400)], "path string"))
    collection.write_report(albums, str(tmp_path / "out"))
    lines = [r["line"] for r in collection.report(albums).collect()]
    assert tree(str(tmp_path / "out")) == {"report.md": "\n".join(lines)}
