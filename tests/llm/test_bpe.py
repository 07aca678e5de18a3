"""Decoding of ids as they come: split characters, unknown and null ids."""

import pytest

from textloom.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_decode_odd_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    v = bpe.vocabulary(path, public_tokenizers.PATTERN)
    ids, _ = v.encode(["\U0001f9ff漢"])
    ids = ids.tolist()
    assert len(ids) > 2  # the bytes of a character in several ids
    word = v.encode(["plain words"])[0].tolist()
    rows = [(1, ids[:1]), (2, ids[1:]), (3, ids), (4, [*word, v.size, v.size + 7, -1, None]), (5, None), (6, []), (7, [None]), (7, [None]), (None, word)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    got = [(r["doc_id"], r["decoded"]) for r in bpe.decode(df, path, public_tokenizers.PATTERN).collect()]
    size = [len(x) for x in (v.decode(bpe.np.array(y), bpe.np.array([len(y)]))[0] for y in (ids[:1], ids[1:]))]
    data = "\U0001f9ff漢".encode()
    assert got == [(1, data[: size[0]].decode("utf-8", "replace")), (2, data[size[0] :].decode("utf-8", "replace")), (3, "\U0001f9ff漢"), (4, "plain words"), (5, ""), (6, ""), (7, ""), (7, ""), (None, "plain words")]
    assert "�" in got[0][1]
