"""Literal cases for each operator, most of them Japanese."""

import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import lines as L
from textloom.functions import text as X
from textloom.operators import cleaning, collection, narration, relational, segment, sequences, tabular
from textloom.sources import pages as P
from textloom.sources import shared


@pytest.fixture(scope="session")
def value(spark):
    """value(column function, text) -> result."""

    def run(function, text):
        row = spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("v")).first()
        return row["v"]

    return run


def pages(spark, texts, corpus="c"):
    return spark.createDataFrame([(corpus, k + 1, t) for k, t in enumerate(texts)], "corpus_id string, page_num int, text string")


def cleaned(df):
    return [r["text"] for r in df.orderBy("page_num").collect()]


SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def test_strip_knows_every_space_of_python(spark):
    assert [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()] == [chr(c) for c in SPACES]
    rows = spark.createDataFrame([(chr(c),) for c in [*SPACES, 0x200B, 0x180E]], "c string")
    got = [r[0] for r in rows.select(X.strip(F.concat("c", F.lit("a"), "c", F.lit("b"), "c"))).collect()]
    assert got == [(chr(c) + "a" + chr(c) + "b" + chr(c)).strip() for c in [*SPACES, 0x200B, 0x180E]]


@pytest.mark.parametrize(
    "function, text, expected",
    [
        (X.newlines, "a\r\nb\rc\n", "a\nb\nc\n"),
        (X.normalize_for_comparison, "Page 12  of 2024/01/02", "Page [NUM] of [NUM]/[NUM]/[NUM]"),
        (X.normalize_for_comparison, " １２ x ", "[NUM] x"),
        (X.remove_spaces, "　あ い う\n\n\n10 年  x", "あい う\n\n10年 x"),
        (X.remove_spaces, "\n\n a\n\n\n", "\na\n"),
        (X.remove_spaces, "\n\n", ""),
        (X.pause_tags, "は、「い」。", "は、[pau:0.3][pau:0.2]「い」[pau:0.2]。[pau:0.8]"),
        (X.pause_tags, "a\n\n\nb", "a\n[pau:1.5]\nb"),
        (X.clean_text, "　字 下げ\t（ x ） 。\n\n\n\ny ", "字下げ （x） 。".replace("） 。", "）。") + "\n\ny"),
        (lambda c: X.clean_text(c, aggressive=False), "x\n　あ い", "x\n　あ い"),
        (X.clean_only, "あ" * 85 + "。\nい", "あ" * 85 + "。\n\nい"),
        (X.clean_only, "あ、" * 50, "\n".join(["あ、あ、あ、"] * 16 + ["あ、あ、"])),
        (segment.split_punctuation, "あ。い！う", "あ。\nい！\nう"),
        (lambda c: segment.split_punctuation(c, 10), "あ" * 6 + "ので" + "い" * 6 + "。う。", "あ" * 6 + "ので\n" + "い" * 6 + "。う。"),
        (segment.split_punctuation, "あ" * 31 + "。", "あ" * 31 + "。\n"),
        (segment.semantic_breaks, "これは、とても長い文章であって、終わり", "これは、とても長い文章であって、終わり".replace("は、", "は、\n").replace("であって、", "であって、\n").replace("これは、\n", "これは、\n")),
        (lambda c: X.remove_patterns(c, ("regex:[0-9]+", "住所")), "住所12あ3", "あ"),
        (lambda c: L.drop_preamble(c), "PDFファイル: a\nページ番号: 1/2\n==========\n本文\n==========\nページ番号: 2/2\n消える", "本文\n=========="),
        (lambda c: L.drop_preamble(c, rule=1), "PDFファイル: a\n=\n本文", "本文"),
        (lambda c: L.drop_preamble(c, drop_blank=True), "a\n\n b", "a\n b"),
        (lambda c: L.merge_short(F.split(c, "\n")), "短い\nこれは十文字以上の行です\n短\n\nもう一つの十文字以上の行", "短い\nこれは十文字以上の行です短\nもう一つの十文字以上の行"),
        (lambda c: X.derived_name(c, ".wav"), "a/b.c/page_0001.txt", "page_0001.wav"),
    ],
)
def test_text_functions(value, function, text, expected):
    if function is segment.semantic_breaks:
        expected = segment_by_hand(text)
    assert value(function, text) == expected


def segment_by_hand(text):
    import re

    for p in (segment.AFTER_PARTICLE, segment.AFTER_MODIFIER, segment.AFTER_POLITE):
        text = re.sub(p, "\\1\n", text)
    out = []
    for line in (x.strip() for x in segment.break_long_clauses(text).split("\n")):
        if out and len(line) < 10:
            out[-1] += line
        elif line:
            out.append(line)
    return "\n".join(out)


def test_chunks():
    assert segment.natural_chunks("あ" * 30 + "。はい。") == ["あ" * 30 + "。はい。"]
    assert segment.natural_chunks("はい。" + "あ" * 30 + "。") == ["はい。", "あ" * 30 + "。"]
    assert segment.natural_chunks(("あ" * 80 + "、") * 3 + "。") == ["あ" * 80 + "、"] * 2 + ["あ" * 80 + "、。"]
    two = segment.bounded_chunks("あ" * 120 + "！" + "い" * 120 + "？")
    assert len(two) == 2 and all(c.endswith("。") for c in two)
    assert segment.bounded_chunks("short") == ["short"]
    assert all(len(c) <= 100 for c in segment.bounded_chunks("あ" * 300, hard_limit=100))
    for text in ("あ。いう！\n え？", "x" * 400 + "、" + "y" * 30):
        assert "".join("".join(segment.natural_chunks(text)).split()) == "".join(text.split())


def test_predicates(spark):
    rows = spark.createDataFrame([(t,) for t in ("全部読む", "3.14は円周率", "本文", "第十二章 x", "- 3 -", "１２", "P. 9x", "Part 2")], "t string")
    assert [r[0] for r in rows.select(L.is_chapter_title(F.col("t"))).collect()] == [True, True, False, True, True, True, True, True]
    assert [r[0] for r in rows.select(L.is_sidebar_title(F.col("t"))).collect()] == [True, False, False, True, True, True, True, True]


def test_repeated_lines(spark):
    five = pages(spark, ["H\na", "H\nb", "K\nc", "d", "e"])
    assert {r["line"] for r in cleaning.repeated_lines(five).collect()} == {"H"}
    two = pages(spark, ["x", "y"])
    assert {r["line"] for r in cleaning.repeated_lines(two).collect()} == {"x", "y"}
    assert cleaning.repeated_lines(two, min_pages=2).count() == 0


def test_header_footer(spark):
    rows = cleaning.header_footer_patterns(pages(spark, ["x1"])).collect()
    assert [(r["pattern"], r["n"], r["kind"]) for r in rows] == [("x[NUM]", 2, "footer")]


def test_duplicates_of_each_cleaner(spark):
    many = ["ab\n\nab", "1\n2x\nsome\ntext", "q", "r", "s", "t"]
    assert cleaned(cleaning.remove_headers(pages(spark, many)))[0] == "ab\n\nab"
    assert cleaned(cleaning.clean_corpus(pages(spark, many)))[0] == "ab"
    assert cleaned(cleaning.clean_pages(pages(spark, ["ab\n\ncd\n\nef"]), auto_detect=False)) == ["ab\n\ncd\nef"]


def test_title_takes_the_blank_behind_it(spark):
    others = ["a", "b", "c", "d", "e"]
    assert cleaned(cleaning.remove_headers(pages(spark, ["本文\n第1章\n\n続き", *others])))[0] == "本文\n続き"
    repeated = ["本文\n第1章\n\n続き"] + ["第1章"] * 3
    assert cleaned(cleaning.remove_headers(pages(spark, repeated)))[0] == "本文\n\n続き"
    assert "第1章" in cleaned(cleaning.remove_headers(pages(spark, ["本文\n第1章\n\n続き", *others]), keep_chapters=True))[0]


def test_cleaners_take_odd_pages(spark):
    odd = pages(spark, [None, "", "\n\n", "a\n" * 3, "x"])
    for clean in (cleaning.remove_headers, cleaning.clean_pages):
        assert clean(odd).count() == 5
    assert cleaning.clean_corpus(odd).count() <= 5
    assert cleaning.clean_corpus(odd.where("page_num > 9")).count() == 0


def test_tabular(spark):
    rows = spark.createDataFrame([(1, "A", "x・y・x"), (2, "A", "z"), (3, "B・C", "y")], "row_no int, name string, members string")
    groups, members, bridge = tabular.group_members(rows)
    assert {(r["id"], r["name"]) for r in groups.collect()} == {(1, "A"), (2, "A"), (3, "B・C")}
    assert {(r["id"], r["name"]) for r in members.collect()} == {(1, "x"), (2, "y"), (3, "z")}
    assert {tuple(r) for r in bridge.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (2, 3), (3, 2)}
    sql = tabular.insert_statements("groups", spark.createDataFrame([(1, "A"), (2, 'B"')], "id int, name string"), {"id": "int", "name": "str"}, "id").first()["statement"]
    assert sql == 'INSERT INTO groups(id, name) VALUES(1, "A"), (2, "B""");'
    with pytest.raises(TypeError):
        tabular.insert_statements("t", rows, {"row_no": "float"}, "row_no")
    pairs = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", 3, 3)], "k string, v int, row_no int")
    assert {tuple(r) for r in tabular.last_wins(pairs, "k", "v").collect()} == {("a", 3), ("b", 2)}
    sheet = spark.createDataFrame([(k, f"a{k}", f"b{k}", f"c{k}") for k in range(3)], "row_no int, a string, b string, c string")
    assert [tuple(r) for r in tabular.rectangle(sheet, 1, 3, 0, 1).orderBy("row_no").collect()] == [(1, "a1", "b1"), (2, "a2", "b2")]
    lines = spark.createDataFrame([("category",), (" a\tb ",), ("",)], "value string")
    assert [r["fields"] for r in tabular.tsv_fields(lines).collect()] == [["a", "b"]]


def test_dense_ids_of_many_names(spark):
    names = spark.range(200).selectExpr("concat('n', lpad(id % 100, 3, '0')) as name")
    got = tabular.dense_ids(names).orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in got] == [(k + 1, f"n{k:03d}") for k in range(100)]


def test_collection(spark):
    paths = spark.createDataFrame([(p,) for p in ("X/Al1/1.flac", "X/Al1/2.flac", "X/al2/1.flac", "Y/Emp/readme.txt", "X/1.flac")], "path string")
    albums = collection.album_tracks(paths)
    assert {tuple(r) for r in albums.collect()} == {("X", "Al1", 2), ("X", "al2", 1)}
    whole = collection.totals(albums).where("level = 'all'").first()
    assert (whole["artists"], whole["albums"], whole["tracks"]) == (1, 2, 3)
    assert [r["line"] for r in collection.report(albums).collect()] == [
        "# CD取り込み済みリスト", "", "**総アーティスト数**: 1", "**総アルバム数**: 2", "**総曲数**: 3", "", "---", "", "## アーティスト別一覧", "",
        "### X （全2枚、3曲）", "", "- Al1 （2曲）", "- al2 （1曲）", "", "---", "", "## 全アルバム一覧（アルファベット順）", "", "- **Al1** （2曲） / X", "- **al2** （1曲） / X",
    ]


def test_relational(spark):
    users = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Bob"), (4, "Bob")], "id int, name string")
    posts = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, user_id int")
    tags = spark.createDataFrame([(1, "Python"), (2, "SQLAlchemy"), (3, "Tutorial")], "id int, name string")
    bridge = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 2)], "post_id int, tag_id int")
    assert relational.posts_with_tags(users, posts, tags, bridge).count() == 6
    once = relational.ordered(relational.posts_with_tags(users, posts, tags, bridge, dedup_tags=True)).collect()
    assert [(r["user_id"], r["post_id"], r["tag_name"], r["is_hoge"]) for r in once] == [(1, 1, "Python", "Python"), (1, 1, "SQLAlchemy", "SQLAlchemy"), (1, 2, "Tutorial", "Tutorial"), (2, 3, "SQLAlchemy", "SQLAlchemy")]


def test_runs(spark):
    grid = [[1, 2, 3], [5, 2, 4], [7, 9, 3]]
    cells = spark.createDataFrame([(r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line)], "row int, col int, value int")
    assert {r["kind"]: r["longest"] for r in sequences.longest_runs(cells).collect()} == {"row": 3, "column": 2, "diagonal": 3}
    single = spark.createDataFrame([(0, k, v) for k, v in enumerate([1, 9, 3])], "row int, col int, value int")
    assert {r["longest"] for r in sequences.longest_runs(single).collect()} == {1}


def test_narration(spark):
    raw = spark.createDataFrame([('[{"name":"A b","styles":[{"name":"N","id":1},{"name":"n","id":0}]}]',)], "json string")
    catalog = narration.catalogue(raw)
    assert [tuple(r) for r in catalog.collect()] == [("a_b_n", 0)]
    assert [tuple(r) for r in narration.variants(catalog).collect()] == [("a_b", ["n"], [0])]
    schema = "corpus_id string, page_num int, part_no int, chunk string, speaker string, speaker_id int, speed double, pitch double, pause double, intonation double"
    rows = [("c", 1, 1, "は。", "a_b_n", None, 3.0, -0.5, 0.7, 0.8), ("c", 1, 2, "い、", None, None, None, None, None, None), ("c", 1, 3, "う", "who", None, 1.0, 0.0, None, None), ("c", 1, 4, "う", "who", 0, 1.0, 0.0, None, None)]
    got = narration.requests(spark.createDataFrame(rows, schema), catalog).orderBy("part_no").collect()
    assert [(r["speaker_id"], r["post_silence"], r["adjusted"]) for r in got] == [(0, 0.5, True), (3, 0.2, False), (None, None, False), (0, None, False)]
    assert (got[0]["speed"], got[0]["pitch"], got[0]["pause_scale"], got[0]["intonation_scale"]) == (2.0, -0.15, 1.2, 1.1)
    assert got[2]["error"] == "unknown speaker: who" and got[0]["error"] is None
    plain = narration.requests(spark.createDataFrame(rows, schema), catalog, natural=False).orderBy("part_no").first()
    assert (plain["pause_scale"], plain["intonation_scale"]) == (0.7, 0.8)


def test_sources(spark, tmp_path):
    folder = tmp_path / "book"
    folder.mkdir()
    (folder / "page_0002.txt").write_bytes("b\r\nc".encode())
    (folder / "page_0001.txt").write_text("a")
    (folder / "notes.md").write_text("x")
    got = [(r["corpus_id"], r["page_num"], r["text"]) for r in P.read_pages(spark, str(folder)).orderBy("page_num").collect()]
    assert got == [("book", 1, "a"), ("book", 2, "b\nc")]
    (tmp_path / "free").mkdir()
    (tmp_path / "free" / "b.txt").write_text("2")
    (tmp_path / "free" / "a.txt").write_text("1")
    placed = P.with_places(P.read_pages(spark, str(tmp_path / "free"))).orderBy("page_num").collect()
    assert [(r["page_num"], r["text"]) for r in placed] == [(1, "1"), (2, "2")]
    (tmp_path / "rows.csv").write_text('a;"b;""c"\nd\n')
    assert [tuple(r) for r in P.read_delimited(spark, str(tmp_path / "rows.csv"), 2, ";").collect()] == [("a", 'b;"c'), ("d", None)]
    (tmp_path / "patterns").write_text("# note\n\n regex:[0-9]+ \n住所\n")
    assert P.read_patterns(spark, str(tmp_path / "patterns")) == ["regex:[0-9]+", "住所"]
    files = P.page_files(pages(spark, ["a", " ", "c"])).orderBy("page_num").collect()
    assert [(r["file_name"], r["header"]) for r in files] == [("page_0001.txt", "PDFファイル: c\nページ番号: 1/3"), ("page_0003.txt", "PDFファイル: c\nページ番号: 3/3")]
    P.write_pages(P.page_files(pages(spark, ["a"])), str(tmp_path / "out"))
    assert (tmp_path / "out" / "corpus_id=c").is_dir()
    assert P.whole_documents(pages(spark, ["a", "", "c"])).first()["text"] == "\n===== ページ 1 =====\n\na\n\n===== ページ 3 =====\n\nc\n"


def test_document_parts_join_to_the_whole_document(spark):
    odd = pages(spark, [None if k % 11 == 0 else f"p{k}" * (k % 5) for k in range(300)])
    rows = P.document_parts(odd, pages_in_part=7).orderBy("part_no").collect()
    assert "".join(r["text"] for r in rows) == P.whole_documents(odd).first()["text"]
    assert len(rows) == 43 and all(r["text"].count("=====") <= 2 * 7 for r in rows)


def test_long_pages_take_linear_time(spark):
    """200,000 lines: no recursion in P3, no strip of the whole page at each line in W2."""
    body = "\n".join(f"本文 {k} line" for k in range(200_000))
    open_start = "keep\nページ番号: 3\n" + body
    closed = "PDFファイル: a\n" + body + "\n==========\nrest"
    df = pages(spark, [open_start, closed, body])
    got = [r[0] for r in df.select("page_num", L.drop_preamble("text").alias("t")).orderBy("page_num").select("t").collect()]
    assert got == ["keep", "rest", body]

    def seconds(n):
        table = pages(spark, ["\n".join(f"line {k} of many" for k in range(n))])
        start = time.time()
        assert cleaning.clean_pages(table, auto_detect=False).select(F.length("text")).first()[0] > n
        return time.time() - start

    seconds(1000)
    assert seconds(200_000) < 60


def test_clean_pages_strips_lines_once(spark):
    """The stripped lines are made in a projection of their own, below the filter that names them."""
    df = cleaning.clean_pages(pages(spark, ["a"]), auto_detect=False)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # the page, and its text for W3


def test_intermediate_tables(spark, tmp_path):
    table = shared.materialize(spark.range(5).toDF("x"), "five")
    assert table.agg(F.sum("x")).first()[0] == 10
    shared.discard(table, None, spark.range(1))
    with pytest.raises(Exception, match="(?i)exist|not found"):
        table.count()


def test_scans_are_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert shared.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert shared.spread(scan).count() == 10
