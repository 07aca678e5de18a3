"""Each stage of the corpus pipeline against brute force, alone and in a row, odd rows included."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_operators import base_by_hand, components_by_brute_force, fused_by_brute_force, nearest_run, vocabulary_path
from textloom.llm import secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TYPES = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = [(1, "which of the seven rivers runs north past the old glass works"), (2, "one short item"), (3, None), (4, "")]


def corpus():
    """Documents in two languages with copies, near copies, benchmark passages and secrets; and odd rows."""
    draw = random.Random(12)
    words = {"en": "the and with thing nation river house going under paper".split(), "de": "der und nicht schau keit haus lauf unter papier wird".split()}
    texts = []
    for i in range(60):
        tag = ("en", "de")[i % 2]
        body = [draw.choice(words[tag]) + draw.choice(["", "s", "t"]) for _ in range(draw.randrange(15, 60))]
        if i % 7 == 3:
            item = ITEMS[i % 2][1].split()
            if len(item) > 5 and draw.random() < 0.6:
                del item[5]
            body[4:4] = item
        if i % 6 == 1:
            body[6:6] = ['api_key: "aZ9x8y7w6v5u4t3s"', "AKIA" + "Q7" * 8, 'k = "Zx81Zx81Qq"; my_secret = k;'][i % 3].split(" ")
        texts.append((tag, " ".join(body)))
    for i in range(12):
        tag, text = texts[i]
        w = text.split(" ")
        if i % 2:
            w[len(w) // 2] = "changed"
        texts.append((tag, " ".join(w)))
    rows = [(k, t, tag if k % 5 else None, f"host{k % 3}", len(t)) for k, (tag, t) in enumerate(texts)]
    odd = [(200, None, "en", "host0", None), (201, "", "de", None, 0), (202, "ab", "en", "host1", 2), (None, "the thing and the nation", "en", "host1", 24), (None, None, None, None, None), rows[3], rows[20], (204, "der " * 8000, "de", "host2", 32000)]
    return rows + odd


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, TYPES)
    return df.selectExpr("*", "1 as sig", "'x' as __text", "'y' as rep", "true as spans", "'z' as __row") if extra else df


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    table(spark, corpus()).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def language(spark, rows):
    found = fused_by_brute_force(spark, [(r[1], r[2], r[3]) for r in rows])
    full = [(r, p) for r, (_, p) in zip(rows, found, strict=True) if len((r[1] or "").encode()) >= 3]
    assert all(abs(p - 0.5) > 1e-6 for _, p in full)  # none on the edge, where rounding decides
    return [r for r, p in full if p >= 0.5]


def near_duplicates(spark, rows):
    kept = components_by_brute_force([(r[0], r[1]) for r in rows if r[0] is not None], 80)
    out, seen = [], set()
    for r in rows:
        if r[0] is None or (kept[r[0]] == r[0] and r[0] not in seen):
            out.append(r)
            seen.add(r[0])
    return out


def decontamination(spark, rows):
    def holds(text):
        words = re.findall(r"[a-z0-9]+", (text or "").lower())
        for _, item in ITEMS:
            if item and words:
                w = item.split()
                if nearest_run(w, words[:400], int(0.2 * len(w) + 1e-9))[0] <= int(0.2 * len(w) + 1e-9):
                    return True
        return False

    return [r for r in rows if not holds(r[1])]


def secret_scan(spark, rows):
    out = []
    for r in rows:
        t = r[1]
        if t is not None:
            spans = [(a, b) for _, a, b in base_by_hand(t)] + secrets.sensitive_literals(t)
            covered = [any(a <= k < b for a, b in spans) for k in range(len(t))]
            t = "".join("[SECRET]" if c and not (k and covered[k - 1]) else "" if c else t[k] for k, c in enumerate(covered))
        out.append((r[0], t, r[2], r[3], None if t is None else len(t)))
    return out


def tokens(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    out = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        out.append((r[0], library.decode(ids, skip_special_tokens=False), *r[2:], len(ids), ids))
    return out


BY_HAND = {"language": language, "near_duplicates": near_duplicates, "decontamination": decontamination, "secret_scan": secret_scan, "tokens": tokens}


def test_stages_are_those_of_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == list(BY_HAND)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_against_brute_force(spark, folder, name, stage):
    """On the whole input; extra columns of clashing names stay, but for the last stage."""
    rows = corpus()
    out = stage(spark, table(spark, rows, extra=name != "tokens"), folder)
    last = ("n_tokens", "ids") if name == "tokens" else ("sig", "__text", "rep", "spans", "__row")
    assert out.columns == [*COLUMNS, *last]
    got = in_order(r[: 5 if name != "tokens" else 7] for r in out.collect())
    want = in_order(BY_HAND[name](spark, rows))
    assert got == want
    if name in ("language", "near_duplicates", "decontamination"):
        assert 0 < len(got) < len(rows)
    assert stage(spark, table(spark, rows).limit(0), folder).count() == 0


def test_run_is_the_stages_in_a_row(spark, folder):
    rows = corpus()
    for _, by_hand in BY_HAND.items():
        rows = by_hand(spark, rows)
    assert in_order(corpus_pipeline.run(spark, folder).collect()) == in_order(rows)
    assert max(Counter(r[0] for r in rows if r[0] is not None).values()) == 1
