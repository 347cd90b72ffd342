"""Packing: exact round trip against the tokenizer, windows, padding."""

from __future__ import annotations

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from heatgrid.llm import packing  # noqa: E402

PATH = packing.vocabulary_path()
TEXTS = [
    None, "", "  \n", "Hello World!", "It's <|endoftext|> a test <|ENDOFTEXT|>", "ça ÉCOLE été ΑΣ. ΣΑΣ, x y \x1c z", "a.b,c... 'the' he'll!! 1234 5%", "日本語 テスト。 ok。",
    "don't. can't, we're; I'd'", "ﬁne Ⅳ ½ K İstanbul", "-- | ** word*** word### (paren) a_b-c.",
]


def slow_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, docs, capacity):
    """docs: list of id lists by doc_id. Every id once, offsets gapless, sums right."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, ids in docs.items():
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_sequence


def test_word_ids_equal_the_tokenizer():
    ids_of = packing.WordIds(PATH)
    for text in TEXTS:
        assert np.frombuffer(ids_of((text or "").encode()), dtype="<u4").tolist() == slow_ids(text)[:-1], text


@pytest.mark.parametrize("keep", [False, True])
def test_pack(spark, keep):
    rnd = random.Random(3)
    pool = "the a heat wave of words runs over some hills and valleys".split()
    texts = TEXTS + [" ".join(rnd.choice(pool) for _ in range(rnd.choice([1, 5, 30, 63, 64, 200, 700]))) for _ in range(120)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, part int").repartition(3)
    got = packing.pack(df, PATH, capacity=64, open_windows=3, keep_ids=keep).collect()
    sequences = check(got, {i: slow_ids(t) for i, t in enumerate(texts)}, 64)
    total = sum(r.length for r in got)
    assert sum(len(s) for s in sequences.values()) == len(got)
    assert total > 0.9 * 64 * (len(sequences) - 1)
    merged = [sum(r.length for r in s) for k, s in sequences.items() if k >= packing.LEFT_BASE]
    assert sum(n < 64 for n in merged) <= 1
    if keep:
        assert all(len(r.ids) == 4 * r.length and crc32(bytes(r.ids)) == r.ids_crc32 for r in got)


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, "c")], "doc_id bigint, text string")
    got = packing.pack(df, PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 3), ("1", 3), ("None", 1), ("None", 2)]
    assert packing.pack(df.limit(0), PATH).count() == 0
