"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes for (1) or against (-1) a text, or abstains (0). Junk is of several kinds, and
rules that catch one kind are silent on another, so a text is either good or of one of
len(RULES) kinds of junk; kind k begins as what rule k is against. Expectation-maximisation over
the counts of vote patterns (at most 3^len(RULES) rows, one row of arrays in the end) estimates
the share of each kind and how often each rule votes against it. On good texts every rule errs
in FALSE_ALARM of its votes, which is given: what it is against more often than that is a kind.
Only a rule that is against more than MOST_JUNK of the texts it votes on errs more: junk is not the most.
A text is kept by its posterior probability of being good instead of having to pass every rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._columns import materialize, words

SYMBOLS = "#*$%&|<>"
ITERATIONS = 15
#: How often a rule's vote on a good text is wrong.
FALSE_ALARM = 0.02
#: The greatest share of junk: what a rule is against beyond it are good texts.
MOST_JUNK = 0.5
#: Where EM starts: the share of good texts, and how often a rule is against its own kind of junk and against others.
START_GOOD, START_OWN, START_OTHER = 0.9, 0.9, 0.1
#: What that start counts for, as a share of all rows, so that estimates are alike at every size.
START_WEIGHT = 0.005

#: (name, numerator, denominator, good up to, bad from, least denominator): the vote is 1 up to the
#: first bound, -1 from the second, 0 between them and where the denominator is too small.
RULES: tuple[tuple[str, str, str, float, float, int], ...] = (
    ("symbols", "n_symbols", "word_chars", 0.01, 0.03, 50),
    ("dup_lines", "n_dup_lines", "n_lines", 0.1, 0.3, 3),
    ("repeats", "n_repeat_words", "n_words", 0.1, 0.3, 10),
    ("capitals", "n_capitals", "word_chars", 0.15, 0.4, 50),
    ("exclaims", "n_exclaims", "n_words", 0.05, 0.2, 10),
    ("long_words", "word_chars", "n_words", 9.0, 14.0, 10),
    ("bars", "n_bars", "n_words", 0.05, 0.2, 10),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Every count of :func:`measure`.
MEASURES = (*COUNTS, "n_lines", "n_capitals", "n_exclaims", "n_bars")


def sorted_windows(triples: Column) -> Column:
    """The windows of a text by content, as (t, p) with their places; none where all are distinct."""
    marked = F.array_sort(F.transform(triples, lambda t, i: F.struct(t.alias("t"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(triples)) == F.size(triples), F.array().cast("array<struct<t:string,p:int>>")).otherwise(marked)


def measure(df: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the counts that the rules use, all long. Null texts have no words.

    Every count is made in its row with array functions, so nothing is shuffled and a
    hot source costs no more than others.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def only(kept: str) -> Column:
        return F.length(F.regexp_replace(body, f"[^{kept}]+", "")).cast("long")

    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    first = df.select(
        *keep,
        words(text).alias("__w"),
        lines.alias("__lines"),
        only("#*$%&|<>").alias("n_symbols"),
        only("A-Z").alias("n_capitals"),
        only("!").alias("n_exclaims"),
        only("|").alias("n_bars"),
    )
    n = F.size("__w")
    triples = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.get("__w", i - 1), F.get("__w", i), F.get("__w", i + 1)))).otherwise(F.array().cast("array<string>"))
    second = first.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        "n_capitals",
        "n_exclaims",
        "n_bars",
        triples.alias("__t"),
    )
    third = second.withColumn("__s", sorted_windows(F.col("__t"))).drop("__t")
    again = F.filter("__s", lambda x, i: (F.get("__s", i - 1)["t"] == x["t"]) | (F.get("__s", i + 1)["t"] == x["t"]))
    fourth = third.withColumn("__p", F.when(F.size("__s") == 0, F.array().cast("array<int>")).otherwise(F.array_sort(F.transform(again, lambda x: x["p"])))).drop("__s")
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    return fourth.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), *MEASURES[len(COUNTS) :])


def votes() -> Column:
    """Array of the rules' votes, from the counts."""
    out = []
    for _, top, bottom, good, bad, least in RULES:
        ratio = F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)).cast("double")
        out.append(F.when(F.col(bottom) < least, 0).when(ratio <= good, 1).when(ratio >= bad, -1).otherwise(0))
    return F.array(*out)


def start(wrong: list) -> list[list]:
    """The model where EM starts, from how often each rule is wrong on good texts.

    For good texts, then for each kind of junk: how often each rule is against it, and last its
    share. A rule that is against most good texts is so against junk of other kinds too.
    """
    n = len(RULES)
    junk = [[START_OWN if r == k else (START_OTHER, wrong[r]) for r in range(n)] + [(1 - START_GOOD) / n] for k in range(n)]
    return [[*wrong, START_GOOD], *junk]


def likelihoods(v: Column, model: Column) -> Column:
    """Array of the share of each kind times the probability of the votes ``v`` cast on it."""

    def one(m: Column) -> Column:
        cast = F.zip_with(v, F.slice(m, 1, len(RULES)), lambda x, p: F.when(x == -1, p).when(x == 1, 1 - p).otherwise(1.0))
        return F.aggregate(cast, F.element_at(m, -1), lambda a, b: a * b)

    return F.transform(model, one)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def posterior(v: Column, model: Column) -> Column:
    """Probability that a text with votes ``v`` is good."""
    each = likelihoods(v, model)
    return each[0] / total(each)


def estimate(patterns: DataFrame) -> DataFrame:
    """One row (model) by EM from (votes, n): counts of vote patterns."""
    packed = patterns.groupBy().agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"), F.sum("n").cast("double").alias("rows"))
    n, kinds = len(RULES), len(RULES) + 1


    def times(test: Callable[[Column], Column], k: int) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda a, x: a + F.when(test(x["votes"][k]), x["n"].cast("double")).otherwise(0.0))

    wrong = []
    for k in range(n):
        rate = F.try_divide(times(lambda v: v == -1, k), times(lambda v: v != 0, k))
        wrong.append(F.greatest(F.lit(FALSE_ALARM), F.least(F.lit(1 - FALSE_ALARM), (rate - MOST_JUNK) / (1 - MOST_JUNK))))
    packed = packed.withColumn("wrong", F.array(*wrong))
    begun = start([F.col("wrong")[k] for k in range(n)])
    packed = packed.withColumn("first", F.array(*(F.array(*(F.greatest(F.lit(x[0]), x[1]) if isinstance(x, tuple) else x if isinstance(x, Column) else F.lit(x) for x in row)) for row in begun)))
    first = F.col("first")
    none = F.array(*(F.array(*(F.lit(0.0) for _ in range(2 * n + 1))) for _ in range(kinds)))

    def share(x: Column, model: Column) -> Column:
        """For each kind, its share of the pattern's rows: by rule those voted against, those voted on, and all."""
        each = likelihoods(x["votes"], model)
        rows = F.transform(each, lambda one: x["n"].cast("double") * one / total(each))
        by_rule = [lambda w, test=test: F.transform(x["votes"], lambda v: F.when(test(v), w).otherwise(0.0)) for test in (lambda v: v == -1, lambda v: v != 0)]
        return F.transform(rows, lambda w: F.concat(by_rule[0](w), by_rule[1](w), F.array(w)))

    def step(model: Column, _: Column) -> Column:
        sums = F.aggregate("p", none, lambda s, x: F.zip_with(s, share(x, model), lambda a, b: F.zip_with(a, b, lambda c, d: c + d)))
        weight = START_WEIGHT * F.col("rows")

        def estimated(a: Column, begun: Column) -> Column:
            rule = F.transform(F.slice(begun, 1, n), lambda p, r: (F.get(a, r) + weight * p) / (F.get(a, r + n) + weight))
            return F.concat(rule, F.array((F.element_at(a, -1) + weight / kinds) / (F.col("rows") + weight)))

        new = F.zip_with(sums, first, estimated)
        good = F.concat("wrong", F.slice(new[0], n + 1, 1))
        return F.concat(F.array(good), F.slice(new, 2, n))

    return packed.select(F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), first, step).alias("model"))


def judge(df: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least_posterior: float = 0.5) -> DataFrame:
    """Columns ``keep``, the counts, votes, quality (posterior) and good (quality above the bound).

    One row for each input row, repeated ones included. A null or empty text has zero
    counts, abstains everywhere and gets the share of good texts. Other columns are left out, whatever
    their names. The pattern counts are grouped with partial sums, at most 3^RULES rows;
    no text is shuffled.
    """
    counted = materialize(measure(df, text=text, keep=keep), "rule-counts").withColumn("votes", votes())
    model = estimate(counted.groupBy("votes").agg(F.count("*").alias("n")))
    judged = counted.join(F.broadcast(model)).withColumn("quality", posterior(F.col("votes"), F.col("model"))).drop("model")
    return judged.withColumn("good", F.col("quality") > least_posterior)


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of op7's rows."""
    gap = "[\\x20\\x09-\\x0D]+"
    vote = [f"CASE WHEN {b} < {least} THEN 0 WHEN CAST({a} AS DOUBLE) / greatest({b}, 1) <= {good} THEN 1 WHEN CAST({a} AS DOUBLE) / greatest({b}, 1) >= {bad} THEN -1 ELSE 0 END AS v{k}" for k, (_, a, b, good, bad, least) in enumerate(RULES)]
    k, kinds = range(len(RULES)), range(len(RULES) + 1)
    names = ", ".join(f"v{i}" for i in k)
    likely = ", ".join(f"m{j} * " + " * ".join(f"CASE v{i} WHEN -1 THEN b{j}_{i} WHEN 1 THEN 1 - b{j}_{i} ELSE 1 END" for i in k) + f" AS l{j}" for j in kinds)
    whole = " + ".join(f"l{j}" for j in kinds)
    begun = [[f"greatest({x[0]}::DOUBLE, {x[1]})" if isinstance(x, tuple) else x if isinstance(x, str) else f"{x}::DOUBLE" for x in row] for row in start([f"b0_{i}" for i in k])]
    wrong = ", ".join(f"greatest({FALSE_ALARM}::DOUBLE, least({1 - FALSE_ALARM}::DOUBLE, (sum(CASE WHEN v{i} = -1 THEN n ELSE 0 END) / nullif(sum(CASE WHEN v{i} <> 0 THEN n ELSE 0 END), 0) - {MOST_JUNK}::DOUBLE) / {1 - MOST_JUNK}::DOUBLE)) AS b0_{i}" for i in k)
    first = ", ".join([*(f"{begun[j][-1]} AS m{j}" for j in kinds), *(f"b0_{i}" for i in k), *(f"{begun[j][i]} AS b{j}_{i}" for j in kinds[1:] for i in k)])
    weight = f"({START_WEIGHT}::DOUBLE * sum(n))"

    def against(j: int, i: int) -> str:
        return f"any_value(b0_{i})" if j == 0 else f"(sum(CASE WHEN v{i} = -1 THEN n * l{j} / l ELSE 0 END) + {weight} * any_value({begun[j][i]})) / (sum(CASE WHEN v{i} <> 0 THEN n * l{j} / l ELSE 0 END) + {weight})"

    then = ", ".join([*(f"(sum(n * l{j} / l) + {weight} / {len(kinds)}) / (sum(n) + {weight})" for j in kinds), *(against(j, i) for j in kinds for i in k)])
    return f"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{gap}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM {table}
), grams AS (
  SELECT rid, pos, g, count(*) OVER (PARTITION BY rid, g) AS times FROM (
    SELECT rid, unnest(range(1, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM split WHERE len(w) >= 3)
), repeats AS (
  SELECT rid, count(DISTINCT pos + d) AS n_repeat_words FROM grams, (SELECT unnest([0, 1, 2]) AS d) WHERE times > 1 GROUP BY rid
), counted AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims, length(regexp_replace(t, '[^|]+', '', 'g')) AS n_bars
  FROM split LEFT JOIN repeats USING (rid)
), voted AS (SELECT *, {", ".join(vote)} FROM counted
), patterns AS (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY ALL
), em AS (
  SELECT 0 AS it, {first} FROM (SELECT {wrong} FROM patterns)
  UNION ALL
  SELECT it + 1, {then}
  FROM (SELECT *, {whole} AS l FROM (SELECT em.it, p.*, {', '.join(f'b0_{i}' for i in k)}, {likely} FROM em, patterns p WHERE em.it < {ITERATIONS})) GROUP BY it
), model AS (SELECT * FROM em WHERE it = {ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)) AND l0 / ({whole}) > 0.5 AS kept
FROM (SELECT voted.*, {likely} FROM voted, model)
"""
