"""Windows merged in a stream, against the rule word by word."""

import random

import pytest

from lexlake.operators import chat


def plain(rows, share, most):
    out, kept = {}, {}
    for q, pos, chunk, session, a, b in sorted(rows, key=lambda r: r[1]):
        if session is None:
            out[chunk] = []
            continue
        held = kept.setdefault((q, session), [])
        host = next((h for h in held if min(b, h[2]) - max(a, h[1]) + 1 >= share * (min(b - a, h[2] - h[1]) + 1)), None)
        if host is None:
            held.append((chunk, a, b))
            out[chunk] = []
        elif len(out[host[0]]) < most:
            out[host[0]].append(chunk)
    return out


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0, 1.5])
def test_merge_near_windows_against_a_plain_loop(spark, monkeypatch, share):
    monkeypatch.setattr(chat, "MERGED_HELD", 5)
    dice = random.Random(9)
    rows = []
    for k in range(500):
        a = dice.randrange(60)
        rows.append((dice.randrange(2), k, f"w{k}", dice.choice(["a", "b", "c", None]), a, a + dice.randrange(9)))
    dice.shuffle(rows)
    got = chat.merge_near_windows(spark.createDataFrame(rows, "query_id int, position int, chunk_id string, session_id string, first_msg int, last_msg int"), share, 3)
    assert got.columns == ["query_id", "position", "chunk_id", "session_id", "first_msg", "last_msg", "absorbed"]
    assert {r.chunk_id: r.absorbed for r in got.collect()} == plain(rows, share, 3)


def test_near_windows_of_one_long_session():
    """100,000 windows of a session: comparing each with all that were kept takes hours."""
    held = chat.NearWindows(0.5, 5)
    assert sum(held.add(str(k), 3 * k, 3 * k + 4) is not None for k in range(100_000)) == 100_000
    assert held.add("again", 150_000, 150_004) is None
