"""Folders of many small files: few tasks, and each file opened once."""

from textloom.sources import pages as P


def test_small_files_share_tasks_and_are_read_once(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(300):
        (folder / f"part-{k:04d}.txt").write_text(f"text {k}\r\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        raw = P.read_pages(spark, str(folder), "part-*")
        tasks = raw.rdd.getNumPartitions()
        pages = P.with_places(raw)
        rows = {(r["corpus_id"], r["page_num"], r["file_name"], r["text"]) for r in pages.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert rows == {("many", k + 1, f"part-{k:04d}.txt", f"text {k}\n") for k in range(300)}
    assert tasks <= 8 * spark.sparkContext.defaultParallelism  # there were 300
    assert not [f for f in pages.inputFiles() if f.endswith(".txt")]
