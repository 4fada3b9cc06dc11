"""Suffix-array dedup against brute force over all windows, and the transform against sorted suffixes."""

import hashlib
import random

import pytest

from tideline.llm import suffix_dedup as S


def brute(rows, length):
    seen, gone = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        mask = [False] * len(data)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                mask[p : p + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, m in zip(data, mask) if not m)
        spans = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        gone[doc] = (len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return gone


def test_collection_is_sorted_suffixes_with_common_prefixes():
    rng = random.Random(3)
    segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(30)]
    doc, length, common, symbol = S.collection(segments)
    rows = [segments[d][len(segments[d]) - n :] for d, n in zip(doc, length)]
    assert rows == sorted(rows) and len(rows) == sum(len(s) + 1 for s in segments)
    for k in range(1, len(rows)):
        a, b = rows[k - 1], rows[k]
        assert common[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    for d, n, x in zip(doc, length, symbol):
        left = len(segments[d]) - n
        assert x == (segments[d][left - 1] + 1 if left else 0)


@pytest.mark.parametrize("split, large", [(4000, 1 << 18), (2, 1 << 18), (4000, 2)])
def test_against_brute_force(spark, monkeypatch, split, large):
    monkeypatch.setattr(S, "SPLIT", split)
    monkeypatch.setattr(S, "LARGE", large)
    if large == 2:
        monkeypatch.setattr(S, "SAMPLE", 1)
        monkeypatch.setattr(S, "partitions", lambda spark, df=None: 300)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(2, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(4, 30))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "z" * 300), (4, "ab" * 90)]
    for k in range(5, 70):
        rows.append((k, " ".join(rng.choice(passages) if rng.random() < 0.4 else word() for _ in range(rng.randint(1, 12)))))
    rows += [(70, rows[40][1]), (71, rows[40][1]), (72, rows[41][1][3:])]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 40).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == brute(rows, 40)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(400))
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y")], "doc_id long, text string, kept string")
    assert [r["n_removed"] for r in S.remove_repeats(docs).collect()] == [0, 0] or brute([(1, text)], 100)[1][1] > 0
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_a_copy_that_is_none_is_an_error(spark):
    texts = spark.createDataFrame([(1, b"one text that is long enough"), (2, b"another")], "id long, text binary")
    spans = lambda source: spark.createDataFrame([(1, 4, 8, source)], "doc long, lo long, hi long, source binary")
    assert [r["n_removed"] for r in S.without_repeats(texts, spans(b"text")).orderBy("id").collect()] == [4, 0]
    with pytest.raises(Exception, match="agree in both hashes"):
        S.without_repeats(texts, spans(b"tent")).collect()


def test_runs_of_copies():
    import numpy as np

    a = lambda *x: np.array(x, np.int64)
    doc, lo, hi, other, at = S.copied_runs(a(1, 1, 1, 2, 1), a(0, 10, 40, 10, 20), a(12, 20, 50, 20, 30), a(7, 7, 7, 7, 8), a(100, 110, 140, 110, 120))
    assert sorted(zip(doc, lo, hi, other, at)) == [(1, 0, 20, 7, 100), (1, 20, 30, 8, 120), (1, 40, 50, 7, 140), (2, 10, 20, 7, 110)]
