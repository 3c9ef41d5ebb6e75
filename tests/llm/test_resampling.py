"""Importance resampling against a plain version; CRCs against zlib."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_support import prose

from lexlake.llm import resampling, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, most):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, most, buckets, least, percent, seed):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(x % buckets for x in plain_features(text, most))
    for text in target:
        t.update(x % buckets for x in plain_features(text, most))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        found = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in (x % buckets for x in plain_features(text, most))]
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(found) // len(found) if found else 0
        out.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = enough[: percent * len(enough) // 100]
    ranks = {}
    for n, x in enumerate(drawn):
        ranks.setdefault(x, []).append(n + 1)
    return [(*x, ranks[x].pop(0) if ranks.get(x) else None) for x in out]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " ! ", "One two THREE", "日本語のテキスト é" * 9, prose(1, 60_000), *(prose(k, 5 + 3 * k) for k in range(40)), "x" * 300_000, "y " * 50, "a b" * 30, "a\nb\tc d_e-f" * 9]
    rows = [(i if i != 20 else None, t, 1, "k", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[30], rows[30], rows[31]], "doc_id long, text string, key int, rank string, bucket int, w int")


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 97)])
def test_op11(spark, docs, most, buckets):
    target = [prose(5, 100), "y z", None, "one two"]
    got = resampling.importance_resampling(docs, spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=buckets, percent=30)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert order(tuple(r) for r in got.collect()) == order(plain(rows, target, most, buckets, 20, 30, 2024))


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_resampling(none, none).collect() == []
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert order(tuple(r) for r in resampling.importance_resampling(docs, none).collect()) == order(plain(rows, [], 1, 10_000, 20, 10, 2024))


def test_few_do_not_fill_a_draw(spark):
    rows = [(k, prose(k, 30)) for k in range(9)]
    got = resampling.importance_resampling(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["rank"] for r in got.collect()} == {None}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=30), min_size=1, max_size=40), st.integers(20, 200))
def test_crcs(words, most):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    before = resampling.MATRIX_BYTES
    try:
        resampling.MATRIX_BYTES = most
        assert resampling.crcs(data, ends - np.array([len(w) for w in words]), ends).tolist() == [zlib.crc32(w) for w in words]
    finally:
        resampling.MATRIX_BYTES = before


def test_spans_that_share_a_hash(monkeypatch):
    """Longer spans that only share a hash get CRCs of their own."""
    monkeypatch.setattr(resampling, "span_hashes", lambda values, starts, ends: np.zeros(len(starts), scan.U64))
    words = [b"abcdefghij", b"abcdefghik", b"abcdefghij", b"zbcdefghij"]
    data = np.frombuffer(b"".join(words), np.uint8)
    at = np.arange(5) * 10
    assert resampling.crcs(data, at[:-1], at[1:]).tolist() == [zlib.crc32(w) for w in words]
