"""The pipeline on a small table against a plain version of its stages."""

import re

import pytest

pytest.importorskip("public_tokenizers")
from tests_support import brute_components, brute_counts, prose, sets_of  # noqa: E402

import corpus_pipeline  # noqa: E402


def test_pipeline(spark, tmp_path):
    long = [prose(k, 90) for k in range(40)]
    texts = [*long, *long[:6], *(x + " tail" for x in long[6:10]), "too short", None, "", "123 456", "a b c " * 40, "жжж " * 70]
    rows = [(i, t, "en" if t and not t.startswith("ж") else None, f"s{i % 4}", len(t or ""), i) for i, t in enumerate(texts)]
    # A repeated row, and an id with two texts: the lesser one counts.
    again = [rows[0], (20, "zz " + texts[20], "en", "s0", 5, 20)]
    df = spark.createDataFrame([*rows, *again], "doc_id long, text string, lang string, source string, n_chars long, kept long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {i: t for i, t, *_ in rows if t and re.search(r"[a-z]", t)}
    kept = {i: t for i, t in kept.items() if brute_counts(t)[0] >= 50 and 100 * brute_counts(t)[4] <= 50 * brute_counts(t)[0]}
    groups = brute_components({i: sets_of(t) for i, t in kept.items()})
    expected = {i for i in kept if groups[i] == i}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == expected
    for i in expected:
        own = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        assert sum(n for _, n in own) == next(r.doc_tokens for r in got if r.doc_id == i)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
