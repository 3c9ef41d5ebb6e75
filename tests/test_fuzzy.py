"""Fuzzy matches: grams that are sent and grams that are joined give the same."""

import random

from lexlake.operators import text


def test_sent_grams_match_as_joined_ones_do(spark, monkeypatch):
    dice = random.Random(4)
    words = ["".join(dice.choices("abcde é漢", k=5)) for _ in range(12)]
    make = lambda n: [(i, " ".join(dice.choices(words, k=dice.randrange(0, 9)))) for i in range(n)]
    source = spark.createDataFrame([*make(25), (25, None), (26, "")], "id long, text string")
    target = spark.createDataFrame([*make(80), (80, None), (81, "ab")], "id long, text string")
    sent = text.fuzzy_matches(source, target)
    assert "MapInArrow" in sent._jdf.queryExecution().executedPlan().toString() and "Generate" not in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(text, "GRAMS_SENT", 0)
    joined = text.fuzzy_matches(source, target)
    rows = sorted(map(tuple, sent.collect()))
    assert rows and rows == sorted(map(tuple, joined.collect()))
    monkeypatch.undo()
    assert text.fuzzy_matches(source.limit(0), target).count() == 0
