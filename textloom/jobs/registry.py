"""Every query over the standard tables, with its DuckDB SQL.

A corpus is a source, a page a document, with a header line and a page number added. The
Japanese lens turns marks and vowels into Japanese ones, the same way in both engines.
Spark runs array functions within a row; the SQL runs windows over exploded lines.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import lines as L
from textloom.functions import text as X
from textloom.operators import cleaning, collection, narration, relational, segment, sequences, tabular
from textloom.sources import files
from textloom.sources import pages as P
from textloom.sources.shared import materialize, new_path, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def framed(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    body = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    page = F.concat(F.lit("Header "), F.col("source"), F.lit("\n"), body, F.lit("\n"), F.col("doc_id").cast("string"))
    return documents(spark, sf_dir).select(F.col("source").alias("corpus_id"), F.col("doc_id").alias("page_num"), page.alias("text"))


def japanese(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), ".,!?aeiou", "。、！？あえいおう")


def messy(c: Column) -> Column:
    """The lens, with wide spaces on every third document and doubled spaces on others."""
    return F.when(F.col("doc_id") % 3 == 0, F.replace(japanese(c), F.lit(" "), F.lit("　"))).otherwise(F.replace(japanese(c), F.lit(" "), F.lit("  ")))


# ---- the same in DuckDB SQL

SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = "chr(10)"
FRAMED = f"SELECT source AS corpus_id, doc_id AS page_num, 'Header ' || source || {NL} || coalesce(text, '') || {NL} || doc_id AS text FROM documents"
LENS = "translate(coalesce(text, ''), '.,!?aeiou', '。、！？あえいおう')"
MESSY = f"CASE WHEN doc_id % 3 = 0 THEN replace({LENS}, ' ', '　') ELSE replace({LENS}, ' ', '  ') END"


def duck_class(pattern: str) -> str:
    """A pattern of the functions package for RE2: the same but for the way code points are written."""
    import re

    out = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)
    return re.sub(r"\\x(85|a0)", r"\\x{\1}", out).replace("'", "''")


def rr(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{duck_class(pattern)}', {by if by.startswith('chr') else repr(by) if chr(39) not in by else by}, 'g')"


def sql_strip(x: str) -> str:
    return rr(x, rf"^{SP}+|{SP}+\z")


def sql_x3(x: str) -> str:
    j = X.JAPANESE
    body = rr("x", "^　+")
    for pattern, by in ((r"　", " "), (" {2,}", " "), (r" ([。、！？）」』】\)])", r"\1"), (r"([（「『【\(]) ", r"\1"), (f"({j}) +({j})", r"\1\2")):
        body = f"regexp_replace({body}, '{pattern}', '{by}', 'g')"
    lines = f"array_to_string(list_transform(string_split(replace({rr(x, X.ZERO_WIDTH)}, chr(9), ' '), {NL}), lambda x: {sql_strip(body)}), {NL})"
    text = f"regexp_replace(regexp_replace({lines}, '\\r\\n?', {NL}, 'g'), '\\n{{3,}}', {NL} || {NL}, 'g')"
    return sql_strip(f"array_to_string(list_transform(string_split({text}, {NL}), lambda y: {rr('y', SP + '+' + chr(92) + 'z')}), {NL})")


def sql_collapse(lines: str) -> str:
    """Blank runs of a list column ``l`` to one empty line."""
    return f"array_to_string(list_filter({lines}, lambda x, i: x <> '' OR i = 1 OR {lines}[i - 1] <> ''), {NL})"


def sql_x4(source: str) -> str:
    """SELECT that replaces ``text`` of a relation by its X4."""
    j, p = X.JAPANESE, X.JAPANESE_PLAIN
    body = sql_strip("x")
    for pattern, by in ((f"({j}) +({j})", r"\1\2"), (f"({p}) +([。、！？」』）】])", r"\1\2"), (f"([「『（【]) +({p})", r"\1\2"), (rf"(\p{{Nd}}) +({X.COUNTERS})", r"\1\2"), (" {2,}", " ")):
        body = f"regexp_replace({body}, '{pattern}', '{by}', 'g')"
    inner = f"SELECT * EXCLUDE (text), list_transform(string_split({rr('text', X.ODD_SPACES, ' ')}, {NL}), lambda x: {body}) AS l FROM {source}"
    return f"SELECT * EXCLUDE (l), {sql_collapse('l')} AS text FROM ({inner})"


def sql_reduce(pieces: str, step: str, first: str | None = None) -> str:
    """Left fold over a list of strings: ``a`` is the list made so far, ``b[1]`` the next piece."""
    items = f"list_transform({pieces}, lambda z: [z])"
    if first is not None:
        items = f"list_concat([[{first}]], {items})"
    return f"(CASE WHEN len({items}) = 0 THEN [] ELSE list_reduce({items}, lambda a, b: {step}) END)"


def sql_pack(pieces: str, limit: int) -> str:
    packed = sql_reduce(pieces, f"CASE WHEN len(a[-1]) + len(b[1]) <= {limit} THEN list_append(a[:-2], a[-1] || b[1]) ELSE list_append(a, b[1]) END")
    return f"list_filter({packed}, lambda z: z <> '')"


def sql_by_commas(x: str) -> str:
    return f"regexp_extract_all({x}, '[^、]*、|[^、]+$')"


def sql_sentences(x: str) -> str:
    return f"regexp_extract_all({x}, '[^。！？]*[。！？]|[^。！？]+$')"


def sql_x6(x: str, limit: int) -> str:
    """The list under way ends in what is held; each sentence joins it, and an empty one behind a final mark."""
    pieces = f"list_concat({sql_sentences(x)}, CASE WHEN regexp_matches({x}, '[。！？]$') THEN [''] ELSE [] END)"
    held = "(a[-1] || b[1])"
    cut = "CASE " + " ".join(f"WHEN contains({held}, '{c}') THEN '{c}'" for c in segment.CUTS) + " END"
    front = f"strpos({held}, {cut}) + len({cut}) - 1"
    step = f"""CASE WHEN len({held}) > {limit} AND contains({held}, '、') THEN list_append(list_concat(a[:-2], {sql_pack(sql_by_commas(held), limit)}), '')
      WHEN len({held}) > {limit} AND ({cut}) IS NULL THEN list_concat(a[:-2], [{held}, ''])
      WHEN len({held}) > {limit} THEN list_concat(a[:-2], [left({held}, {front}), substr({held}, {front} + 1)])
      WHEN regexp_matches({held}, '[。！？]$') THEN list_concat(a[:-2], [{held}, '']) ELSE list_append(a[:-2], {held}) END"""
    lines = f"list_filter(list_transform({sql_reduce(pieces, step, "''")}, lambda z: {sql_strip('z')}), lambda z: z <> '')"
    return f"array_to_string(flatten(list_transform({lines}, lambda z: CASE WHEN ends_with(z, '。') AND len(z) > 30 THEN [z, ''] ELSE [z] END)), {NL})"


def sql_x11(x: str, limit: int = 150, least: int = 20) -> str:
    full = f"list_filter(list_transform({sql_sentences(x)}, lambda z: {sql_strip('z')}), lambda z: z <> '')"
    cut = f"flatten(list_transform({full}, lambda z: CASE WHEN len(z) <= {limit} THEN [z] ELSE {sql_pack(sql_by_commas('z'), limit)} END))"
    return sql_reduce(cut, f"CASE WHEN len(b[1]) < {least} AND len(a[-1]) + len(b[1]) <= {limit} THEN list_append(a[:-2], a[-1] || b[1]) ELSE list_append(a, b[1]) END")


def sql_x12(x: str, limit: int = 200) -> str:
    pieces = f"list_transform(list_filter(regexp_split_to_array({x}, '[。！？\\n]'), lambda z: {sql_strip('z')} <> ''), lambda z: z || '。')"
    return f"CASE WHEN len({x}) <= {limit} THEN [{x}] ELSE {sql_pack(pieces, limit)} END"


def sql_w9(lines: str, least: int = 10) -> str:
    full = f"list_filter(list_transform({lines}, lambda z: {sql_strip('z')}), lambda z: z <> '')"
    return f"array_to_string({sql_reduce(full, f'CASE WHEN len(b[1]) < {least} THEN list_append(a[:-2], a[-1] || b[1]) ELSE list_append(a, b[1]) END')}, {NL})"


def sql_x8(x: str) -> str:
    """Long clauses are framed by chr(1) and chr(2), so that a plain replacement breaks at their commas."""
    for pattern in (segment.AFTER_PARTICLE, segment.AFTER_MODIFIER, segment.AFTER_POLITE):
        x = f"regexp_replace({x}, '{pattern}', '\\1' || {NL}, 'g')"
    framed = f"string_split(regexp_replace({x}, '(、[^\\n]{{20,}}?、)', chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    at = "strpos(z, chr(2))"
    broken = f"array_to_string(list_transform({framed}, lambda z: CASE WHEN {at} > 0 THEN replace(left(z, {at} - 1), '、', '、' || {NL}) || substr(z, {at} + 1) ELSE z END), '')"
    return sql_w9(f"string_split(regexp_replace({broken}, '\\n{{3,}}', {NL} || {NL}, 'g'), {NL})")


EXPLODED = f"""pages AS ({FRAMED}), lines AS (
  SELECT corpus_id, page_num, no, line, {sql_strip("line")} AS s FROM (SELECT corpus_id, page_num, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS line FROM (SELECT *, string_split(text, {NL}) AS ls FROM pages)))"""


def sql_repeated(k: int, below: int, least: int) -> str:
    return f"""ends AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, page_num ORDER BY no) AS f, row_number() OVER (PARTITION BY corpus_id, page_num ORDER BY no DESC) AS b FROM lines),
counted AS (SELECT corpus_id, s AS line, count(DISTINCT page_num) AS n FROM ends WHERE (f <= {k} OR b <= {k}) AND length(s) BETWEEN 1 AND {below - 1} GROUP BY ALL),
repeated AS (SELECT corpus_id, line, n FROM counted JOIN (SELECT corpus_id, count(*) AS pages FROM pages GROUP BY 1) USING (corpus_id) WHERE 10 * n >= 4 * pages AND n >= {least})"""


def sql_like(x: str, *patterns: str) -> str:
    return f"regexp_matches({x}, '{duck_class(L.anchored(*patterns))}')"


SIDEBAR = f"((length(s) <= 30 AND regexp_matches(s, '{L.SIDEBAR_WORDS}')) OR {sql_like('s', L.DIGITS, *L.PAGE_NUMBERS)})"
CHAPTER = f"({sql_like('s', *L.CHAPTERS, L.DIGITS, *L.PAGE_NUMBERS)} OR (length(s) < 30 AND regexp_matches(s, '{L.TITLE_WORDS}')))"
PREAMBLE = "(" + " OR ".join(f"starts_with(s, '{p}')" for p in L.PREAMBLE) + ")"
BY_PAGE = "OVER (PARTITION BY corpus_id, page_num ORDER BY no)"


# ---- cleaning


@query("repeated_lines", f"WITH {EXPLODED}, {sql_repeated(5, 100, 0)} SELECT corpus_id, line, n FROM repeated")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.repeated_lines(framed(spark, sf_dir))


@query(
    "header_footer_patterns",
    f"""WITH {EXPLODED}, norm AS (SELECT corpus_id, page_num, no, {sql_strip(rr(rr("s", chr(92) + "p{Nd}+", "[NUM]"), SP + "+", " "))} AS pattern,
  row_number() OVER (PARTITION BY corpus_id, page_num ORDER BY no) AS f, row_number() OVER (PARTITION BY corpus_id, page_num ORDER BY no DESC) AS b FROM lines),
  marks AS (SELECT corpus_id, page_num, pattern, 1 AS t, 0 AS b FROM norm WHERE f <= 3 AND pattern <> '' UNION ALL SELECT corpus_id, page_num, pattern, 0, 1 FROM norm WHERE b <= 3 AND pattern <> ''),
  counted AS (SELECT corpus_id, pattern, count(*) AS n, count(DISTINCT CASE WHEN t = 1 THEN page_num END) AS t, count(DISTINCT CASE WHEN b = 1 THEN page_num END) AS b FROM marks GROUP BY ALL)
SELECT corpus_id, pattern, n, CASE WHEN t > b THEN 'header' ELSE 'footer' END AS kind FROM counted JOIN (SELECT corpus_id, count(*) AS pages FROM pages GROUP BY 1) USING (corpus_id) WHERE 2 * n >= pages""",
)
def header_footer_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.header_footer_patterns(framed(spark, sf_dir))


@query(
    "clean_corpus",
    f"""WITH {EXPLODED}, {sql_repeated(5, 150, 2)},
  pass AS (SELECT l.* FROM lines l LEFT JOIN repeated r ON r.corpus_id = l.corpus_id AND r.line = l.s WHERE s = '' OR (r.line IS NULL AND NOT {PREAMBLE} AND NOT {SIDEBAR})),
  full_lines AS (SELECT *, lag(s) {BY_PAGE} AS before FROM pass WHERE s <> ''),
  kept AS (SELECT corpus_id, page_num, no, line, s FROM full_lines WHERE NOT (length(s) < 50 AND before IS NOT DISTINCT FROM s) UNION ALL SELECT corpus_id, page_num, no, '', s FROM pass WHERE s = ''),
  thin AS (SELECT * FROM (SELECT *, lag(s) {BY_PAGE} AS before FROM kept) WHERE s <> '' OR before IS DISTINCT FROM ''),
  joined AS (SELECT corpus_id, page_num, {sql_strip(f"string_agg(line, {NL} ORDER BY no)")} AS text FROM thin GROUP BY ALL),
  spaced AS ({sql_x4("joined")}), cleaned AS (SELECT corpus_id, page_num, {sql_x3("text")} AS text FROM spaced)
SELECT * FROM cleaned WHERE text <> ''""",
)
def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_corpus(framed(spark, sf_dir))


@query(
    "remove_headers",
    f"""WITH {EXPLODED}, {sql_repeated(5, 100, 0)},
  known AS (SELECT l.*, r.line IS NOT NULL AS rep, max(no) OVER (PARTITION BY l.corpus_id, page_num) AS last FROM lines l LEFT JOIN repeated r ON r.corpus_id = l.corpus_id AND r.line = l.s),
  titled AS (SELECT *, s <> '' AND NOT rep AND {CHAPTER} AS title FROM known),
  pass AS (SELECT * FROM (SELECT *, lag(title) {BY_PAGE} AS behind FROM titled) WHERE CASE WHEN s = '' THEN NOT coalesce(behind, false) ELSE NOT title AND NOT rep AND NOT {sql_like("s", L.DIGITS)} END),
  thin AS (SELECT * FROM (SELECT *, lag(s) {BY_PAGE} AS before FROM pass) WHERE before IS NULL OR CASE WHEN s = '' THEN before <> '' ELSE length(s) >= 30 OR before <> s END),
  joined AS (SELECT corpus_id, page_num, string_agg(line, {NL} ORDER BY no) || CASE WHEN max(no) = max(last) THEN '' ELSE {NL} END AS text FROM thin GROUP BY ALL)
SELECT corpus_id, page_num, coalesce(j.text, '') AS text FROM pages LEFT JOIN joined j USING (corpus_id, page_num)""",
)
def remove_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.remove_headers(framed(spark, sf_dir))


_NORM = sql_strip(rr(rr("s", chr(92) + "p{Nd}+", "[NUM]"), SP + "+", " "))


@query(
    "clean_pages",
    f"""WITH {EXPLODED}, norm AS (SELECT *, {_NORM} AS pattern, row_number() {BY_PAGE} AS f, row_number() OVER (PARTITION BY corpus_id, page_num ORDER BY no DESC) AS b FROM lines),
  marks AS (SELECT corpus_id, pattern FROM norm WHERE f <= 3 AND pattern <> '' UNION ALL SELECT corpus_id, pattern FROM norm WHERE b <= 3 AND pattern <> ''),
  wanted AS (SELECT corpus_id, pattern FROM (SELECT corpus_id, pattern, count(*) AS n FROM marks GROUP BY ALL) JOIN (SELECT corpus_id, count(*) AS pages FROM pages GROUP BY 1) USING (corpus_id) WHERE 2 * n >= pages),
  seen AS (SELECT *, lag(s, 1, '') {BY_PAGE} AS p, lead(s, 1, '') {BY_PAGE} AS q,
    list(s) OVER (PARTITION BY corpus_id, page_num ORDER BY no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS five FROM (SELECT n.*, w.pattern IS NOT NULL AS rep FROM norm n LEFT JOIN wanted w ON w.corpus_id = n.corpus_id AND w.pattern = n.pattern)),
  kept AS (SELECT * FROM seen WHERE NOT (length(s) BETWEEN 1 AND 20 AND regexp_matches(line, '{L.NEAR_BLANK_WORDS}') AND (p = '' OR q = '')) AND NOT {sql_like("line", L.DIGITS, L.PAGE_NUMBERS[0])}
    AND NOT rep AND NOT {sql_like("s", L.DIGITS)} AND NOT (length(s) <= 30 AND coalesce(list_contains(five, s), false))),
  lists AS (SELECT corpus_id, page_num, list(CASE WHEN s = '' THEN '' ELSE line END ORDER BY no) AS l FROM kept GROUP BY 1, 2),
  joined AS (SELECT corpus_id, page_num, {sql_strip(sql_collapse("l"))} AS text FROM lists)
SELECT corpus_id, page_num, coalesce(j.text, '') AS text FROM pages LEFT JOIN joined j USING (corpus_id, page_num)""",
)
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_pages(framed(spark, sf_dir))


@query("corpus_statistics", f"SELECT source AS corpus_id, count(*) AS pages, count(*) FILTER ({sql_strip('coalesce(text, chr(32))')} <> '') AS with_text FROM documents GROUP BY 1")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.corpus_statistics(documents(spark, sf_dir).select(F.col("source").alias("corpus_id"), F.coalesce("text", F.lit(" ")).alias("text")))


@query(
    "line_predicates",
    f"""WITH {EXPLODED}, near AS (SELECT *, lag(s, 1, '') {BY_PAGE} AS p, lead(s, 1, '') {BY_PAGE} AS q FROM lines)
SELECT corpus_id, page_num, count(*) FILTER ({CHAPTER} AND s <> '') AS chapters, count(*) FILTER ({SIDEBAR} AND s <> '') AS sidebars, count(*) FILTER ({sql_like("s", L.DIGITS)}) AS digits,
  count(*) FILTER ((length(s) BETWEEN 1 AND 20 AND regexp_matches(line, '{L.NEAR_BLANK_WORDS}') AND (p = '' OR q = '')) OR {sql_like("line", L.DIGITS, L.PAGE_NUMBERS[0])}) AS near_blank,
  count(*) FILTER ({PREAMBLE}) AS preamble, count(*) FILTER (length(s) BETWEEN 1 AND 99) AS short FROM near GROUP BY ALL""",
)
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = framed(spark, sf_dir).withColumn("l", L.split_lines("text")).withColumn("s", F.transform("l", X.strip))
    near = F.filter("l", lambda x, i: L.is_title_near_blank(x, F.get("l", i - 1), F.get("l", i + 1)))

    def count(found: Column, name: str) -> Column:
        return F.size(found).cast("long").alias(name)

    return step.select(
        "corpus_id",
        "page_num",
        count(F.filter("s", lambda s: L.is_chapter_title(s) & (s != "")), "chapters"),
        count(F.filter("s", lambda s: L.is_sidebar_title(s) & (s != "")), "sidebars"),
        count(F.filter("s", L.is_digits), "digits"),
        count(near, "near_blank"),
        count(F.filter("s", L.is_preamble), "preamble"),
        count(F.filter("s", lambda s: F.length(s).between(1, 99)), "short"),
    )


_FILE = f"'PDFファイル: ' || source || {NL} || 'ページ番号: ' || doc_id || {NL} || '==========' || {NL} || coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN {NL} || 'ページ番号: x' || {NL} || 'lost' ELSE '' END"


@query(
    "drop_preamble",
    f"""WITH files AS (SELECT doc_id, {_FILE} AS text FROM documents), lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, {NL}) AS ls FROM files)),
  marked AS (SELECT *, CASE WHEN starts_with(line, 'PDFファイル:') OR starts_with(line, 'ページ番号:') THEN 'S' WHEN starts_with(line, '==========') THEN 'E' END AS m FROM lines),
  state AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM marked)
SELECT f.doc_id, coalesce(t, '') AS text FROM files f LEFT JOIN (SELECT doc_id, string_agg(line, {NL} ORDER BY no) AS t FROM state WHERE m IS DISTINCT FROM 'S' AND st IS DISTINCT FROM 'S' GROUP BY 1) USING (doc_id)""",
)
def drop_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.when(F.col("doc_id") % 5 == 0, "\nページ番号: x\nlost").otherwise("")
    file = F.concat(F.lit("PDFファイル: "), "source", F.lit("\nページ番号: "), F.col("doc_id").cast("string"), F.lit("\n==========\n"), F.coalesce("text", F.lit("")), lost)
    return documents(spark, sf_dir).select("doc_id", L.drop_preamble(file).alias("text"))


_SHORT = f"'PDFファイル: ' || source || {NL} || '- no rule' || {NL} || '= ' || doc_id || {NL} || coalesce(text, '') || {NL} || CASE WHEN doc_id % 3 = 0 THEN 'ページ番号: 2' || {NL} || 'dropped' || {NL} || '=' || {NL} || '= kept' ELSE '==' END"


@query(
    "drop_preamble_one_sign",
    f"""WITH files AS (SELECT doc_id, {_SHORT} AS text FROM documents), lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, {NL}) AS ls FROM files)),
  marked AS (SELECT *, CASE WHEN starts_with(line, 'PDFファイル:') OR starts_with(line, 'ページ番号:') THEN 'S' WHEN starts_with(line, '=') THEN 'E' END AS m FROM lines),
  state AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM marked)
SELECT f.doc_id, coalesce(t, '') AS text FROM files f LEFT JOIN (SELECT doc_id, string_agg(line, {NL} ORDER BY no) AS t FROM state WHERE m IS DISTINCT FROM 'S' AND st IS DISTINCT FROM 'S' GROUP BY 1) USING (doc_id)""",
)
def drop_preamble_one_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 with a rule of one sign; a rule outside a preamble is kept."""
    end = F.when(F.col("doc_id") % 3 == 0, "ページ番号: 2\ndropped\n=\n= kept").otherwise("==")
    file = F.concat(F.lit("PDFファイル: "), "source", F.lit("\n- no rule\n= "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"), end)
    return documents(spark, sf_dir).select("doc_id", L.drop_preamble(file, rule=1).alias("text"))


# ---- scalar functions, through the lens


def scalar(name: str, change: Callable[[Column], Column], sql: str | None) -> None:
    """A query that applies a Column function to the messy lens of every document."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = documents(spark, sf_dir).select("doc_id", messy(F.col("text")).alias("text"))
        return made.select("doc_id", change(F.col("text")).alias("text"))


_LENSED = f"SELECT doc_id, {MESSY} AS text FROM documents"


def lensed(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM ({_LENSED})"


scalar("x1_newlines", lambda c: X.newlines(F.replace(c, F.lit("\n"), F.lit("\r\n"))), lensed("text"))
scalar("x2_zero_width", lambda c: X.drop_zero_width(F.replace(c, F.lit("、"), F.lit("、​"))), lensed("text"))
scalar("x3_clean_text", X.clean_text, lensed(sql_x3("text")))
scalar("x4_remove_spaces", X.remove_spaces, f"SELECT doc_id, text FROM ({sql_x4('(' + _LENSED + ')')})")
scalar("x5_normalize", lambda c: X.normalize_for_comparison(F.concat(c, F.col("doc_id").cast("string"))), lensed(sql_strip(rr(rr("text || doc_id", chr(92) + "p{Nd}+", "[NUM]"), SP + "+", " "))))
_TAGGED = "text"
for _p, _by in X.PAUSES:
    _p = _p.replace("\n", "\\n")
    _TAGGED = f"regexp_replace({_TAGGED}, '{_p}', {' || '.join(NL if x == chr(10) else repr(x) for x in __import__('re').split('(' + chr(10) + ')', _by) if x)}, 'g')"
scalar("x7_pause_tags", X.pause_tags, lensed(_TAGGED))
_PART = f"CASE WHEN length(p) - length(replace(p, '、', '')) > 3 AND length(p) > 60 THEN regexp_replace(p, '((?:[^、\\n]*、){{3}})', '\\1' || {NL}, 'g') ELSE p END"
_LONG = f"CASE WHEN length(y) > 80 THEN array_to_string(list_transform(string_split(replace(y, '。', '。' || {NL}), {NL}), lambda p: {_PART}), {NL}) ELSE y END"


def sql_x10(source: str) -> str:
    return f"SELECT doc_id, {sql_collapse('l')} AS text FROM (SELECT doc_id, list_transform(list_transform(string_split(text, {NL}), lambda z: {sql_strip('z')}), lambda y: {_LONG}) AS l FROM (SELECT doc_id, {sql_x3('text')} AS text FROM ({sql_x4(source)})))"


scalar("x10_clean_only", X.clean_only, sql_x10(f"({_LENSED})"))
scalar("p5_remove_patterns", lambda c: X.remove_patterns(c, ("regex:\\p{Nd}+", "。", "regex:[あい]{2,}")), lensed(rr(f"replace({rr('text', chr(92) + 'p{Nd}+')}, '。', '')", "[あい]{2,}")))

#: Thousands of three-letter literals by a rule, in an order of their own; what one removes may bring a later one together.
MANY_PATTERNS = tuple(chr(97 + k % 26) + chr(97 + k // 26 % 26) + chr(97 + k // 676) for k in (i * 7919 % 17576 for i in range(5000)))
_MANY = "list_transform(range(5000), lambda i: [chr(CAST(97 + (i * 7919 % 17576) % 26 AS INTEGER)) || chr(CAST(97 + (i * 7919 % 17576) // 26 % 26 AS INTEGER)) || chr(CAST(97 + (i * 7919 % 17576) // 676 AS INTEGER))])"
_REMOVED = f"list_reduce(list_concat([[lower(coalesce(text, ''))]], {_MANY}), lambda a, b: [replace(a[1], b[1], '')])[1]"


@query("p5_many_patterns", f"SELECT doc_id, {_REMOVED} AS text FROM documents")
def p5_many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.remove_patterns(F.lower(F.coalesce("text", F.lit(""))), MANY_PATTERNS).alias("text"))


def cut_lens(c: Column) -> Column:
    """The lens with conjunctions where a long sentence without commas is cut; every second text has no commas or no final mark."""
    joined = F.replace(F.replace(c, F.lit("r "), F.lit("から")), F.lit("n "), F.lit("ので"))
    bare = F.regexp_replace(F.replace(joined, F.lit("、"), F.lit("けれど")), "[。！？]+$", "")
    return F.when(F.col("doc_id") % 2 == 0, joined).when(F.col("doc_id") % 4 == 1, bare).otherwise(F.replace(joined, F.lit("、"), F.lit("")))


_JOINED = "replace(replace(text, 'r ', 'から'), 'n ', 'ので')"
_CUT = f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_JOINED} WHEN doc_id % 4 = 1 THEN regexp_replace(replace({_JOINED}, '、', 'けれど'), '[。！？]+$', '') ELSE replace({_JOINED}, '、', '') END AS text FROM ({_LENSED})"
scalar("x6_punctuation_lines", segment.split_punctuation, lensed(sql_x6("text", 50)))
scalar("x6_punctuation_cuts", lambda c: segment.split_punctuation(cut_lens(c)), f"SELECT doc_id, {sql_x6('text', 50)} AS text FROM ({_CUT})")
scalar("x8_semantic_breaks", segment.semantic_breaks, lensed(sql_x8("text")))
scalar("x9_hybrid", segment.hybrid, f"SELECT doc_id, {sql_x6(sql_x3('text'), 45)} AS text FROM ({sql_x4('(' + _LENSED + ')')})")


def sql_pauses(x: str) -> str:
    out = x
    for pattern, by in X.PAUSES:
        pattern = pattern.replace("\n", "\\n")
        out = f"regexp_replace({out}, '{pattern}', {' || '.join(NL if z == chr(10) else repr(z) for z in __import__('re').split('(' + chr(10) + ')', by) if z)}, 'g')"
    return out


def preambled(c: Column) -> Column:
    """A text of the lens as a page file, behind its preamble of file, number and rule."""
    number = F.col("doc_id").cast("string")
    return F.concat(F.lit("PDFファイル: "), number, F.lit("\nページ番号: "), number, F.lit("\n==========\n"), c)


#: X4 of the texts behind their preambles, which the SQL never adds: the query drop_preamble holds P3 to SQL.
_FORMATTED = f"({sql_x4('(' + _LENSED + ')')})"
for _method, _sql in {
    "punctuation": f"SELECT doc_id, {sql_x6('text', 50)} AS text FROM {_FORMATTED}",
    "pauses": f"SELECT doc_id, {sql_pauses('text')} AS text FROM {_FORMATTED}",
    "morphological": f"SELECT doc_id, {sql_x6('text', 40)} AS text FROM {_FORMATTED}",
    "semantic": f"SELECT doc_id, {sql_x8('text')} AS text FROM {_FORMATTED}",
    "hybrid": f"SELECT doc_id, {sql_x6(sql_x3('text'), 45)} AS text FROM ({sql_x4(_FORMATTED)})",
    "clean": sql_x10(_FORMATTED),
}.items():
    scalar(f"x19_format_text_{_method}" if _method != "clean" else "x19_format_text", lambda c, m=_method: segment.format_text(preambled(c), m), _sql)


@query("x11_natural_chunks", f"SELECT doc_id, generate_subscripts(c, 1) AS part_no, unnest(c) AS chunk FROM (SELECT doc_id, {sql_x11('text')} AS c FROM ({_LENSED}))")
def x11_natural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents(spark, sf_dir).select("doc_id", messy(F.col("text")).alias("text"))
    return segment.chunk_table(made, segment.split_naturally("text"), ("doc_id",)).withColumn("part_no", F.col("part_no").cast("long"))


@query("x12_bounded_chunks", f"SELECT * FROM (SELECT doc_id, generate_subscripts(c, 1) AS part_no, unnest(c) AS chunk FROM (SELECT doc_id, {sql_x12('text')} AS c FROM ({_LENSED}))) WHERE {sql_strip('chunk')} <> ''")
def x12_bounded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents(spark, sf_dir).select("doc_id", messy(F.col("text")).alias("text"))
    return segment.chunk_table(made, segment.split_bounded("text"), ("doc_id",)).withColumn("part_no", F.col("part_no").cast("long"))


@query(
    "numbered_chunks",
    f"""SELECT corpus_id, page_num, part_no, chunk, row_number() OVER (PARTITION BY corpus_id ORDER BY page_num, part_no) AS n
FROM (SELECT corpus_id, page_num, generate_subscripts(c, 1) AS part_no, unnest(c) AS chunk FROM (SELECT corpus_id, page_num, string_split(text, {NL}) AS c FROM ({FRAMED}))) WHERE {sql_strip("chunk")} <> ''""",
)
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = segment.chunk_table(framed(spark, sf_dir), L.split_lines("text"))
    return narration.numbered(chunks.withColumn("part_no", F.col("part_no").cast("long")))


@query(
    "w9_merge_short",
    f"""WITH lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS no, {sql_strip("unnest(ls)")} AS s FROM (SELECT doc_id, string_split(replace({LENS}, '、', {NL}), {NL}) AS ls FROM documents)),
  isles AS (SELECT *, sum(CASE WHEN before IS NULL OR length(s) >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS k FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM lines WHERE s <> '')),
  merged AS (SELECT doc_id, k, string_agg(s, '' ORDER BY no) AS line FROM isles GROUP BY ALL)
SELECT d.doc_id, coalesce(t, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, {NL} ORDER BY k) AS t FROM merged GROUP BY 1) USING (doc_id)""",
)
def w9_merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.replace(japanese(F.col("text")), F.lit("、"), F.lit("\n")), "\n")
    return documents(spark, sf_dir).select("doc_id", L.merge_short(lines).alias("text"))


@query("x18_names", "SELECT doc_id, printf('page_%04d.txt', doc_id) AS page, source || '_formatted.txt' AS formatted FROM documents")
def x18_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("in/"), "source", F.lit(".txt"))
    return documents(spark, sf_dir).select("doc_id", X.page_name("doc_id").alias("page"), X.derived_name(path, "_formatted.txt").alias("formatted"))


# ---- sources and sinks


@query(
    "page_files",
    f"SELECT corpus_id, page_num, printf('page_%04d.txt', page_num) AS file_name, 'PDFファイル: ' || corpus_id || {NL} || 'ページ番号: ' || page_num || '/' || count(*) OVER (PARTITION BY corpus_id) AS header, text FROM ({FRAMED})",
)
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_files(framed(spark, sf_dir))


@query(
    "whole_documents",
    f"SELECT corpus_id, string_agg({NL} || '===== ページ ' || page_num || ' =====' || {NL} || {NL} || text || {NL}, '' ORDER BY page_num) AS text FROM ({FRAMED}) GROUP BY 1",
)
def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.whole_documents(framed(spark, sf_dir))


@query(
    "document_parts",
    f"SELECT corpus_id, CAST(page_num // 64 AS BIGINT) AS part_no, string_agg({NL} || '===== ページ ' || page_num || ' =====' || {NL} || {NL} || text || {NL}, '' ORDER BY page_num) AS text FROM ({FRAMED}) GROUP BY ALL",
)
def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.document_parts(framed(spark, sf_dir))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, some of them blank, some unreadable."""
    n = F.col("doc_id")
    text = F.when(n % 11 == 0, F.lit(None)).when(n % 7 == 0, " \n ").otherwise(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("\n \n\n")))
    return documents(spark, sf_dir).select(F.col("source").alias("corpus_id"), n.alias("page_num"), text.alias("text"))


@query(
    "document_markers",
    f"""WITH made AS (SELECT source AS corpus_id, doc_id AS page_num, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN ' ' ELSE replace(coalesce(text, ''), ' ', {NL} || ' ' || {NL} || {NL}) END AS text FROM documents),
  lists AS (SELECT *, list_transform(string_split(text, {NL}), lambda x: CASE WHEN {sql_strip("x")} = '' THEN '' ELSE x END) AS l, '===== ページ ' || page_num AS m FROM made),
  sections AS (SELECT *, {NL} || m || CASE WHEN text IS NULL THEN ' (エラー) =====' || {NL} WHEN {sql_strip("text")} = '' THEN ' (テキストなし) =====' || {NL} ELSE ' =====' || {NL} || {sql_collapse("l")} END AS s FROM lists)
SELECT corpus_id, CAST(page_num // 64 AS BIGINT) AS part_no, string_agg(s, '' ORDER BY page_num) AS text FROM sections GROUP BY ALL""",
)
def document_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.document_parts(marked(spark, sf_dir), markers=True)


@query(
    "run_statistics",
    f"""WITH made AS (SELECT source AS corpus_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN ' ' ELSE coalesce(text, '') END AS text FROM documents)
SELECT corpus_id, count(*) AS pages, count(*) FILTER ({sql_strip("text")} <> '') AS with_text, count(*) FILTER ({sql_strip("text")} <> '') AS processed, count(*) FILTER ({sql_strip("regexp_replace(text, '[a-m0-9]+', '', 'g')")} <> '') AS succeeded FROM made GROUP BY 1""",
)
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = marked(spark, sf_dir)
    return cleaning.run_statistics(pages, pages.withColumn("text", X.remove_patterns("text", ("regex:[a-m0-9]+",))))


@query(
    "page_folder",
    f"""WITH parts AS (SELECT corpus_id, page_num // 64 AS part_no, string_agg({NL} || '===== ページ ' || page_num || ' =====' || {NL} || {NL} || text || {NL}, '' ORDER BY page_num) AS text FROM ({FRAMED}) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY corpus_id, part_no) AS page_num, text || {NL} AS text FROM parts""",
)
def page_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document parts as a folder of text files, numbered in order; read back as pages in order of name."""
    parts = tabular.numbered(P.document_parts(framed(spark, sf_dir)), ("corpus_id", "part_no"))
    folder = new_path(spark, "folder")
    named = parts.select(F.lit("parts").alias("folder"), F.format_string("part-%012d.txt", "id").alias("file_name"), F.concat("text", F.lit("\n")).alias("text"))
    files.write_named(named, folder)
    pages = P.with_places(P.read_pages(spark, f"{folder}/parts", "part-*"))
    return pages.select(F.col("page_num").cast("long").alias("page_num"), "text")


_BLANKS = f"list_transform(string_split(text, {NL}), lambda x: CASE WHEN {sql_strip('x')} = '' THEN '' ELSE x END)"


@query(
    "named_page_files",
    f"""SELECT corpus_id, page_num, count(*) OVER (PARTITION BY corpus_id) AS total, {sql_collapse('l')} AS text FROM (SELECT corpus_id, page_num, {_BLANKS} AS l FROM ({FRAMED}))""",
)
def named_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page files under their own names, one folder a corpus, written and read back."""
    folder = new_path(spark, "page-files")
    P.write_page_files(framed(spark, sf_dir), folder)
    return P.read_page_files(spark, folder)


@query(
    "document_files",
    f"""WITH whole AS (SELECT corpus_id, string_agg({NL} || '===== ページ ' || page_num || ' =====' || {NL} || {NL} || text || {NL}, '' ORDER BY page_num) AS text FROM ({FRAMED}) GROUP BY 1)
SELECT corpus_id, CAST(strlen(text) AS BIGINT) AS bytes, line, count(*) AS n FROM (SELECT corpus_id, text, unnest(string_split(left(text, length(text) - 1), {NL})) AS line FROM whole) GROUP BY ALL""",
)
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as one file each, filled by many tasks; read back by lines, with the size of the file."""
    folder = new_path(spark, "documents")
    P.write_documents(framed(spark, sf_dir), folder)
    lines = spark.read.option("lineSep", "\n").text(folder).select(F.regexp_replace("_metadata.file_name", r"\.txt\z", "").alias("corpus_id"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("line"))
    return lines.groupBy("corpus_id", "bytes", "line").agg(F.count("*").alias("n"))


@query(
    "delimited_files",
    "SELECT CAST(c_custkey AS VARCHAR) AS _c0, c_name || ', \"' || c_mktsegment || '\"' AS _c1, NULLIF(CAST(c_nationkey AS VARCHAR), '7') AS _c2, CAST(NULL AS VARCHAR) AS _c3 FROM customer WHERE c_custkey >= 3",
)
def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle of customers as files with quotes and separators in them, read back as rows of four."""
    name = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_no"), F.col("c_custkey").cast("string").alias("a"), name.alias("b"), F.nullif(F.col("c_nationkey").cast("string"), F.lit("7")).alias("c"), F.lit("cut").alias("d"))
    path = new_path(spark, "delimited")
    tabular.write_delimited(tabular.rectangle(rows, 3, None, 0, 2).drop("row_no"), path, ";")
    return P.read_delimited(spark, path, 4, ";")


@query(
    "pattern_file",
    f"""WITH p AS (SELECT list(DISTINCT lang ORDER BY lang) FILTER (lang IS NOT NULL) AS l FROM documents)
SELECT doc_id, list_reduce(list_concat([coalesce(text, '')], l), lambda a, b: replace(a, b, '')) AS text FROM (SELECT doc_id, {rr("text", chr(92) + "p{Nd}+")} AS text FROM documents), p""",
)
def pattern_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of patterns (digits, then the language tags) with comments and blanks, applied to every text."""
    docs = documents(spark, sf_dir)
    tags = F.array_join(F.array_sort(F.collect_set("lang")), "\n  ")  # a few tags
    path = new_path(spark, "patterns")
    docs.agg(F.concat(F.lit("# digits first\n\nregex:\\p{Nd}+ \n  "), tags).alias("value")).coalesce(1).write.text(path)
    patterns = P.read_patterns(spark, path)
    return docs.select("doc_id", X.remove_patterns(F.coalesce("text", F.lit("")), patterns).alias("text"))


# ---- tabular


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a list: name, members split by the middle dot."""
    value = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit("\t"), F.replace("p_name", F.lit(" "), F.lit("・")), F.lit("\t "))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), value.alias("value"))
    return tabular.tsv_fields(rows).select("row_no", F.col("fields")[0].alias("name"), F.col("fields")[1].alias("members"))


_UNITS = "units AS (SELECT p_partkey AS row_no, CAST(p_partkey AS VARCHAR) AS name, string_split(p_name, ' ') AS members FROM part), members AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT unnest(members) AS name FROM units))"


@query("units_tsv", "SELECT p_partkey AS row_no, CAST(p_partkey AS VARCHAR) AS name, replace(p_name, ' ', '・') AS members FROM part")
def units_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir)


@query("members", f"WITH {_UNITS} SELECT id, name FROM members")
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.group_members(units(spark, sf_dir))[1]


@query(
    "group_member_bridge",
    f"""WITH {_UNITS}, numbered AS (SELECT row_number() OVER (ORDER BY row_no) AS id, name, members FROM units)
SELECT g.id AS group_id, m.id AS member_id FROM (SELECT id, unnest(list_distinct(members)) AS member FROM numbered) g JOIN members m ON m.name = g.member""",
)
def group_member_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.group_members(units(spark, sf_dir))[2]


@query("last_wins", "SELECT CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("_c0"), F.col("o_orderstatus").alias("_c1"), F.col("o_orderkey").alias("row_no"))
    return tabular.last_wins(rows, "_c0", "_c1")


@query("rectangle", "SELECT s_suppkey AS row_no, CAST(s_nationkey AS VARCHAR) AS _c1 FROM supplier WHERE s_suppkey >= 10 AND s_suppkey < 60")
def rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_no"), F.col("s_name").alias("_c0"), F.col("s_nationkey").cast("string").alias("_c1"), F.col("s_acctbal").cast("string").alias("_c2"))
    return tabular.rectangle(rows, 10, 60, 1, 1)


@query(
    "insert_statements",
    """SELECT CAST(floor((c_custkey - 1) / 1000) AS BIGINT) AS batch_no, 'INSERT INTO members(id, name) VALUES' || string_agg('(' || c_custkey || ', "' || replace(c_name, '"', '""') || '")', ', ' ORDER BY c_custkey) || ';' AS statement FROM customer GROUP BY 1""",
)
def insert_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return tabular.insert_statements("members", rows, {"id": "int", "name": "str"}, "id")


# ---- collection


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path for each document: tracks, and every seventh another kind of file."""
    kind = F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".flac")
    return documents(spark, sf_dir).select(F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit("/"), F.col("doc_id").cast("string"), kind).alias("path"))


_ALBUMS = "albums AS (SELECT source AS artist, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS album, count(*) AS tracks FROM documents WHERE doc_id % 7 <> 0 GROUP BY ALL)"


@query("album_tracks", f"WITH {_ALBUMS} SELECT * FROM albums")
def album_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.album_tracks(manifest(spark, sf_dir))


@query(
    "collection_totals",
    f"""WITH {_ALBUMS} SELECT 'artist' AS level, artist, count(*) AS albums, CAST(sum(tracks) AS BIGINT) AS tracks, 1 AS artists FROM albums GROUP BY artist
UNION ALL SELECT 'all', NULL, count(*), CAST(sum(tracks) AS BIGINT), count(DISTINCT artist) FROM albums""",
)
def collection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.totals(collection.album_tracks(manifest(spark, sf_dir)))


def in_order(ordered: DataFrame) -> DataFrame:
    """An ordered report with its places, taken from the written parts, in order of file and row."""
    path = new_path(ordered.sparkSession, "ordered")
    ordered.write.parquet(path)
    rows = ordered.sparkSession.read.parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    return tabular.numbered(rows, ("__file", "__block", "__row"), "n").select(*ordered.columns, "n")


@query("albums_in_order", f"WITH {_ALBUMS} SELECT *, row_number() OVER (ORDER BY lower(album), lower(artist), artist, album) AS n FROM albums")
def albums_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(collection.by_album(collection.album_tracks(manifest(spark, sf_dir))))


@query(
    "collection_report",
    f"""WITH {_ALBUMS}, t AS (SELECT count(DISTINCT artist) AS a, count(*) AS b, CAST(sum(tracks) AS BIGINT) AS c FROM albums),
  lines AS (
SELECT 0 AS section, NULL AS k1, NULL AS k2, NULL AS k3, unnest(range(1, 13)) AS no, unnest(['# CD取り込み済みリスト', '', '**総アーティスト数**: ' || a, '**総アルバム数**: ' || b, '**総曲数**: ' || c, '', '---', '', '## アーティスト別一覧', '', NULL, NULL]) AS line FROM t
UNION ALL SELECT 1, artist, 0, NULL, unnest([1, 2]), unnest(['### ' || artist || ' （全' || count(*) || '枚、' || CAST(sum(tracks) AS BIGINT) || '曲）', '']) FROM albums GROUP BY artist
UNION ALL SELECT 1, artist, 1, album, 1, '- ' || album || ' （' || tracks || '曲）' FROM albums
UNION ALL SELECT 1, artist, 2, NULL, 1, '' FROM (SELECT DISTINCT artist FROM albums)
UNION ALL SELECT 2, NULL, NULL, NULL, unnest([1, 2, 3, 4]), unnest(['---', '', '## 全アルバム一覧（アルファベット順）', '']) FROM t
UNION ALL SELECT 3, lower(album), NULL, lower(artist) || chr(1) || artist || chr(1) || album, 1, '- **' || album || '** （' || tracks || '曲） / ' || artist FROM albums)
SELECT line, row_number() OVER (ORDER BY section, k1, k2, k3, no) AS n FROM lines WHERE line IS NOT NULL""",
)
def collection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(collection.report(collection.album_tracks(manifest(spark, sf_dir))))


# ---- relational and sequences


def blog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Users, posts, tags and bridge over customers, orders, parts and the lines of some orders."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    posts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    tags = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_partkey").alias("tag_id"))
    return users, posts, tags, lines


def _blog_sql(derived: str) -> str:
    return f"""SELECT c_custkey AS user_id, c_name AS user_name, o_orderkey AS post_id, t.p_partkey AS tag_id, t.p_name AS tag_name,
  CASE WHEN CAST(t.p_partkey AS VARCHAR) = t.p_name THEN CAST(t.p_partkey AS VARCHAR) WHEN CAST(t.p_partkey AS VARCHAR) <> t.p_name THEN t.p_name END AS is_hoge
FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem l ON l_orderkey = o_orderkey LEFT JOIN ({derived}) t ON t.p_partkey = l.l_partkey"""


@query("posts_with_tags", _blog_sql("SELECT p_partkey, p_name FROM part SEMI JOIN lineitem ON l_partkey = p_partkey"))
def posts_with_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.posts_with_tags(*blog(spark, sf_dir), dedup_tags=True)


@query("posts_with_tags_stored", _blog_sql("SELECT p_partkey, p_name FROM part SEMI JOIN lineitem ON l_partkey = p_partkey"))
def posts_with_tags_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from bucketed tables, without shuffles of users, posts and bridge."""
    name = f"blog_{uuid4().hex}"
    relational.store(*blog(spark, sf_dir), name, 2 * spark.sparkContext.defaultParallelism)
    return relational.stored_posts_with_tags(spark, name, dedup_tags=True)


@query("posts_in_order", "SELECT *, row_number() OVER (ORDER BY user_id, post_id, tag_id NULLS FIRST) AS n FROM (" + _blog_sql("SELECT p_partkey, p_name FROM part SEMI JOIN lineitem ON l_partkey = p_partkey") + ")")
def posts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(relational.ordered(relational.posts_with_tags(*blog(spark, sf_dir), dedup_tags=True)))


@query("posts_with_tags_fan_out", "SELECT user_id, count(*) AS n, count(tag_id) AS tagged FROM (" + _blog_sql("SELECT p_partkey, p_name FROM part JOIN lineitem ON l_partkey = p_partkey") + ") GROUP BY 1")
def posts_with_tags_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.posts_with_tags(*blog(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("n"), F.count("tag_id").alias("tagged"))


@query(
    "longest_runs",
    """WITH cells AS (SELECT CAST(floor(event_id / 100) AS BIGINT) AS r, event_id % 100 AS c, user_id % 10 AS v FROM events),
  series AS (SELECT 'row' AS kind, r AS s, c AS p, v FROM cells UNION ALL SELECT 'column', c, r, v FROM cells UNION ALL SELECT 'diagonal', c - r, r, v FROM cells),
  isles AS (SELECT *, sum(CASE WHEN v = before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY kind, s ORDER BY p) AS k FROM (SELECT *, lag(v) OVER (PARTITION BY kind, s ORDER BY p) AS before FROM series))
SELECT kind, max(n) AS longest FROM (SELECT kind, s, k, count(*) AS n FROM isles GROUP BY ALL) GROUP BY 1""",
)
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("row"), (F.col("event_id") % 100).alias("col"), (F.col("user_id") % 10).alias("value"))
    return sequences.longest_runs(cells)


# ---- narration


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A speaker catalogue as JSON: regions with their nations as styles."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    styles = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("id"))))
    people = nation.groupBy("r_name").agg(styles.alias("styles")).select(F.struct(F.col("r_name").alias("name"), "styles").alias("p"))
    return people.agg(F.to_json(F.array_sort(F.collect_list("p"))).alias("json"))


_CATALOGUE = "catalogue AS (SELECT replace(lower(r_name || '_' || n_name), ' ', '_') AS speaker, CAST(n_nationkey AS INTEGER) AS speaker_id FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("speaker_catalogue", f"WITH {_CATALOGUE} SELECT * FROM catalogue")
def speaker_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration.catalogue(speakers(spark, sf_dir))


@query("speaker_variants", f"WITH {_CATALOGUE}, b AS (SELECT *, regexp_replace(speaker, '_[^_]*$', '') AS base FROM catalogue) SELECT base, list(replace(speaker, base || '_', '') ORDER BY speaker) AS styles, list(speaker_id ORDER BY speaker) AS ids FROM b GROUP BY 1")
def speaker_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration.variants(narration.catalogue(speakers(spark, sf_dir)))


def asked(chunks: DataFrame) -> DataFrame:
    """Chunks with a speaker, and speed and pitch that sometimes leave the bounds."""
    n = F.col("page_num")
    name = F.when(n % 4 == 0, "asia_japan").when(n % 4 == 1, "nobody_here").when(n % 4 == 2, F.lit(None).cast("string")).otherwise("europe_france")
    return chunks.select(
        "corpus_id", "page_num", "part_no", "chunk", name.alias("speaker"), F.when(n % 8 == 1, 0).alias("speaker_id"), (n % 5 * 0.5).cast("double").alias("speed"), ((n % 3 - 1) * 0.25).cast("double").alias("pitch"), F.lit(None).cast("double").alias("pause"), F.lit(None).cast("double").alias("intonation")
    )


def sql_requests(chunks: str) -> str:
    """Requests for the rows (corpus_id, page_num, part_no, chunk) of a query."""
    number = "CAST({} AS VARCHAR)".format
    query = "'{\"speedScale\":' || " + number("speed") + " || ',\"pitchScale\":' || " + number("pitch") + " || ',\"pauseLengthScale\":1.2,\"intonationScale\":1.1' || coalesce(',\"postPhonemeLength\":' || " + number("post_silence") + ", '') || '}'"
    return f"""WITH {_CATALOGUE}, asked AS (SELECT *, CASE page_num % 4 WHEN 0 THEN 'asia_japan' WHEN 1 THEN 'nobody_here' WHEN 3 THEN 'europe_france' END AS speaker,
    CASE WHEN page_num % 8 = 1 THEN 0 END AS given, CAST(page_num % 5 * 0.5 AS DOUBLE) AS v, CAST((page_num % 3 - 1) * 0.25 AS DOUBLE) AS w FROM ({chunks})),
  found AS (SELECT a.*, coalesce(given, c.speaker_id, CASE WHEN a.speaker IS NULL THEN 3 END) AS sid FROM asked a LEFT JOIN catalogue c ON c.speaker = a.speaker),
  made AS (SELECT corpus_id, page_num, part_no, chunk, sid AS speaker_id, CASE WHEN sid IS NULL THEN 'unknown speaker: ' || speaker END AS error, greatest(0.5::DOUBLE, least(2.0::DOUBLE, v)) AS speed, greatest(-0.15::DOUBLE, least(0.15::DOUBLE, w)) AS pitch,
  (v < 0.5 OR v > 2.0 OR w < -0.15 OR w > 0.15) AS adjusted, 1.2::DOUBLE AS pause_scale, 1.1::DOUBLE AS intonation_scale, CASE WHEN ends_with(chunk, '。') THEN 0.5::DOUBLE WHEN ends_with(chunk, '、') THEN 0.2::DOUBLE END AS post_silence FROM found)
SELECT *, {query} AS query FROM made"""


@query("narration_requests", sql_requests(f"SELECT source AS corpus_id, doc_id AS page_num, 1 AS part_no, {LENS} AS chunk FROM documents"))
def narration_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = documents(spark, sf_dir).select(F.col("source").alias("corpus_id"), F.col("doc_id").alias("page_num"), F.lit(1).alias("part_no"), japanese(F.col("text")).alias("chunk"))
    return narration.requests(asked(chunks), narration.catalogue(speakers(spark, sf_dir)))


def narrated(spark: SparkSession, sf_dir: str, chunks: Callable[[Column], Column], preamble: bool = False) -> DataFrame:
    """Narration job: preamble off, hybrid format, blank lines off, chunks, requests."""
    pages = framed(spark, sf_dir, japanese(F.col("text")))
    if preamble:
        head = F.concat(F.lit("PDFファイル: "), "corpus_id", F.lit("\nページ番号: "), F.col("page_num").cast("string"), F.lit("\n==========\n"))
        pages = pages.withColumn("text", F.concat(head, "text"))
    pages = pages.withColumn("text", segment.format_text("text", "hybrid"))
    pages = cleaning.where_made(pages.withColumn("text", L.drop_preamble("text", drop_blank=True)), ~X.is_blank("text"))
    parts = segment.chunk_table(pages, chunks(F.col("text")))
    return narration.requests(asked(parts), narration.catalogue(speakers(spark, sf_dir)))


def sql_narrated(chunks: Callable[[str], str]) -> str:
    """Framed pages through X19 (hybrid), blank lines off, cut into chunks. Preamble lines, where pages have them, go first."""
    pages = f"(SELECT source AS corpus_id, doc_id AS page_num, 'Header ' || source || {NL} || {LENS} || {NL} || doc_id AS text FROM documents)"
    hybrid = f"SELECT corpus_id, page_num, {sql_x6(sql_x3('text'), 45)} AS text FROM ({sql_x4('(' + sql_x4(pages) + ')')})"
    full = f"SELECT corpus_id, page_num, array_to_string(list_filter(string_split(text, {NL}), lambda z: {sql_strip('z')} <> ''), {NL}) AS text FROM ({hybrid})"
    return sql_requests(f"SELECT * FROM (SELECT corpus_id, page_num, CAST(generate_subscripts(c, 1) AS INTEGER) AS part_no, unnest(c) AS chunk FROM (SELECT corpus_id, page_num, {chunks('text')} AS c FROM ({full}) WHERE text <> '')) WHERE {sql_strip('chunk')} <> ''")


@query("narration_bounded", sql_narrated(sql_x12))
def narration_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrated(spark, sf_dir, segment.split_bounded)


@query("narration_natural", sql_narrated(sql_x11))
def narration_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrated(spark, sf_dir, segment.split_naturally)


@query("narration_page_files", sql_narrated(sql_x11))
def narration_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests from pages that begin with the preamble of a page file, which the chain takes off."""
    return narrated(spark, sf_dir, segment.split_naturally, preamble=True)
