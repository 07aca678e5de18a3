"""Weak supervision of the quality rules: EM against a plain one, and verdicts on mixed texts."""

import math
import os
import random

import pytest

from textloom.llm import queries, rules

DATA = "/root/testdata/sf0.01"


def em(patterns):
    """The model by loops, from {votes: rows}."""
    n, rows = len(rules.RULES), sum(patterns.values())
    wrong = []
    for r in range(n):
        bad, cast = (sum(m for v, m in patterns.items() if test(v[r])) for test in (lambda x: x == -1, lambda x: x != 0))
        wrong.append(max(0.02, min(0.98, (bad / cast - 0.5) / 0.5)))
    begun = [wrong] + [[0.9 if r == k else max(0.1, wrong[r]) for r in range(n)] for k in range(n)]
    against, share, weight = begun, [0.9] + [0.1 / n] * n, 0.005 * rows
    for _ in range(rules.ITERATIONS):
        by = {v: likely(v, against, share) for v in patterns}
        part = {v: [patterns[v] * x / math.fsum(by[v]) for x in by[v]] for v in patterns}
        share = [(math.fsum(part[v][k] for v in patterns) + weight / (n + 1)) / (rows + weight) for k in range(n + 1)]
        against = [
            [wrong[r] if k == 0 else (math.fsum(part[v][k] for v in patterns if v[r] == -1) + weight * begun[k][r]) / (math.fsum(part[v][k] for v in patterns if v[r]) + weight) for r in range(n)]
            for k in range(n + 1)
        ]
    return against, share


def likely(v, against, share):
    return [s * math.prod(p if x == -1 else 1 - p if x == 1 else 1 for x, p in zip(v, row, strict=True)) for row, s in zip(against, share, strict=True)]


def test_estimates_are_those_of_plain_em(spark):
    rng = random.Random(1)
    for _ in range(4):
        patterns = {tuple(rng.choice([1, 1, 1, 0, -1]) for _ in rules.RULES): rng.randrange(1, 500) for _ in range(30)}
        df = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long")
        model = rules.estimate(df).first()["model"]
        against, share = em(patterns)
        for row, want, part in zip(model, against, share, strict=True):
            assert row == pytest.approx([*want, part], rel=1e-9)


def texts():
    calm = "quiet words of prose go on here and there in many a plain and even line of it"
    rng = random.Random(3)

    def prose(n=80):
        return "\n".join(" ".join(rng.sample(calm.split(), 16)) for _ in range(n // 16))

    rows = [(k, prose()) for k in range(400)]
    rows += [(1000 + k, " ".join(f"{w}#$%" for w in prose().split())) for k in range(40)]  # junk of one kind
    rows += [(2000 + k, prose().upper() + "!" * 40) for k in range(30)]  # of another
    rows += [(3000, prose() + " $#%&*")]  # a few marks: no rule is sure
    rows += [(3001, "\n".join([*(prose(32) for _ in range(4)), *["so it goes"] * 6]))]  # one rule against it
    rows += [(4000, "too short"), (4001, None)]
    return rows


def test_rule_against_most_texts_is_not_trusted(spark):
    """Where nearly all texts repeat lines, that is no sign of junk; what only few have still is."""
    calm = "plain words in a calm line of text and more of them here\n" * 2
    rows = [(k, calm + f"line {k} of them all goes on") for k in range(90)] + [(100 + k, calm + "$%#" * 20 + f" line {k} goes on") for k in range(10)]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(-1 in got[k]["votes"] and got[k]["good"] for k in range(90)) and not any(got[100 + k]["good"] for k in range(10))


def test_verdicts_differ_from_the_base_rules_both_ways(spark, tmp_path):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in queries.op7_rules(spark, str(tmp_path)).collect()}
    judged = {r["doc_id"]: r for r in rules.judge(frame).collect()}
    assert all(out[k]["kept"] for k in range(400))
    assert not any(out[i]["kept"] or out[i]["base_failed"] for i in out if 1000 <= i < 3000)  # by the method alone
    assert -1 in judged[3001]["votes"] and judged[3001]["good"] and out[3001]["kept"]  # a vote overruled
    assert out[3000]["kept"]
    assert judged[4000]["good"] and not out[4000]["kept"] and not out[4001]["kept"]  # by the base rules alone


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_verdict_against_labels(spark):
    """Labels are for this report only; the method never sees them."""
    out = queries.op7_rules(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("not base_failed")
    rows = out.collect()
    low, high = ([r["kept"] for r in rows if r["quality"] == y] for y in (0, 1))
    assert len(low) > 20 and sum(low) <= 0.05 * len(low) and sum(high) >= 0.99 * len(high)
