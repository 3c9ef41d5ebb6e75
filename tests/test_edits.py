"""Edits of chunks, governance of documents, keyed tables and chat pages."""

import random

import pytest
from pyspark.sql import functions as F

from lexlake.operators import edits, governance, keyed
from lexlake.operators import versions as v
from lexlake.sources import chat_pages

CHUNK = "chunk_id string, doc_id long, version_id string, parent_id string, seq long, content string, enabled boolean, chunk_type string"


def test_copies_are_the_same_tree(spark):
    rows = [("p", 1, "v1", None, 0, "ab", True, "t"), ("a", 1, "v1", "p", 0, "a", None, "t"), ("b", 1, "v1", "p", 1, "b", False, "t"), ("o", 1, "v1", "gone", 2, "o", True, "t"), ("z", 2, "v9", None, 0, "z", True, "t")]
    copies = spark.createDataFrame([(1, "v1", "v2"), (1, "v1", "v3")], "doc_id long, from_version string, to_version string")
    out = edits.copy_chunks(spark.createDataFrame(rows, CHUNK), copies).collect()
    assert len(out) == 8 and len({r.chunk_id for r in out}) == 8
    for version in ("v2", "v3"):
        by = {r.content: r for r in out if r.version_id == version}
        assert by["a"].parent_id == by["b"].parent_id == by["ab"].chunk_id and by["o"].parent_id is None and by["ab"].parent_id is None
        assert [by[c].enabled for c in ("ab", "a", "b")] == [True, True, False]
        assert [(by[c].indexable, by[c].embedding_status) for c in ("ab", "a", "o")] == [(False, "SKIPPED"), (True, "PENDING"), (True, "PENDING")]
    links = spark.createDataFrame([(1, "v1", "a", "i1"), (1, "v1", None, "i2"), (2, "v9", "z", "i3")], "doc_id long, version_id string, chunk_id string, image_id string")
    got = {(r.version_id, r.image_id): r.chunk_id for r in edits.copy_links(links, copies, "chunk_id").collect()}
    assert got.keys() == {(x, i) for x in ("v2", "v3") for i in ("i1", "i2")} and got["v2", "i2"] is None
    assert got["v2", "i1"] == next(r.chunk_id for r in out if r.version_id == "v2" and r.content == "a")


def test_splits_move_what_follows(spark):
    rows = [("a", 1, "v", None, 0, "aabbcc", True, "t"), ("b", 1, "v", None, 1, "xy", False, "t"), ("c", 1, "v", None, 2, "pq", True, "t"), ("k", 1, "v", "a", 0, "aa", True, "t"), ("d", 1, "w", None, 5, "rs", True, "t"), ("e", 1, "v", "q", 7, None, True, "t")]
    asked = [("a", [2, 4]), ("b", [1]), ("c", [1, 1]), ("d", [2]), ("e", [1]), ("none", [1])]
    out = edits.split_chunks(spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, "chunk_id string, offsets array<int>")).collect()
    got = sorted((r.version_id, r.seq, r.content, r.enabled, r.part, r.split_from) for r in out if r.parent_id is None)
    assert got == [("v", 0, "aa", True, 0, "a"), ("v", 1, "bb", True, 1, "a"), ("v", 2, "cc", True, 2, "a"), ("v", 3, "x", False, 0, "b"), ("v", 4, "y", False, 1, "b"), ("v", 5, "pq", True, None, None), ("w", 5, "rs", True, None, None)]
    assert {r.chunk_id for r in out if r.parent_id is not None} == {"e"} and len({r.chunk_id for r in out}) == 8


@pytest.mark.parametrize(("offsets", "fine"), [([1], True), ([1, 3], True), ([], False), (None, False), ([0], False), ([4], False), ([2, 2], False), ([3, 1], False), ([1, None], False)])
def test_splittable(spark, offsets, fine):
    row = spark.createDataFrame([("abcd", offsets)], "content string, offsets array<int>")
    assert row.select(edits.splittable(F.col("content"), F.col("offsets")).alias("x")).first().x is fine


def test_merges(spark):
    rows = [(c, 1, "v", p, s, t, e, "t") for c, p, s, t, e in (("a", None, 0, "A", False), ("b", None, 1, "B", True), ("c", None, 2, None, False), ("d", None, 4, "D", True), ("e", "x", 3, "E", True))]
    merges = [(1, "b"), (1, "a"), (1, "c"), (2, "c"), (2, "d"), (3, "a"), (4, "a"), (4, "a"), (5, "a"), (5, "gone"), (6, "c"), (6, "e")]
    out = edits.merge_chunks(spark.createDataFrame(rows, CHUNK), spark.createDataFrame(merges, "merge_id long, chunk_id string")).collect()
    assert [(r.chunk_ids, r.seq, r.content, r.enabled, r.version_id) for r in out] == [(["a", "b", "c"], 0, "A\nB\n", True, "v")]


def test_toggles_reach_children(spark):
    rows = [("p", 1, "v", None, 0, "", True, "t"), ("a", 1, "v", "p", 0, "", True, "t"), ("b", 1, "v", "p", 1, "", False, "t"), ("o", 1, "v", None, 1, "", None, "t")]
    toggles = [(1, "p", False), (2, "a", True), (3, "o", True), (1, "gone", True)]
    out = edits.toggle_chunks(spark.createDataFrame(rows, CHUNK), spark.createDataFrame(toggles, "id long, chunk_id string, enabled boolean")).collect()
    assert {r.chunk_id: (r.enabled, r.changed_by, r.cascaded) for r in out} == {"p": (False, 1, False), "a": (True, None, None), "b": (False, None, None), "o": (True, 3, False)}


LOG = "doc_id long, event_id long, op string, at long, note string, effective_at long, expires_at long"


def test_governance(spark):
    log = [
        (1, 1, "APPROVE", 1, None, None, None), (1, 2, "SUBMIT", 2, None, None, None), (1, 3, "REJECT", 3, "no", None, None), (1, 4, "SUBMIT", 4, None, None, None), (1, 5, "TRASH", 5, None, None, None), (1, 6, "APPROVE", 6, None, None, None),
        (1, 7, "RESTORE", 7, None, None, None), (1, 8, "APPROVE", 8, None, None, None), (1, 9, "VALIDITY", 9, None, 5, 5), (1, 10, "VALIDITY", 9, None, 5, None), (1, 11, "PURGE", 9, None, None, None), (1, 12, "odd", 9, None, None, None),
        (2, 1, "TRASH", 5, None, None, None), (2, 2, "TRASH", 6, None, None, None), (2, 3, "PURGE", 7, None, None, None), (2, 4, "RESTORE", 8, None, None, None), (3, 1, "TRASH", 5, None, None, None),
    ]
    folded = governance.fold_log(spark.createDataFrame(log, LOG))
    got = {(r.doc_id, r.event_id): r.refused for r in folded.collect()}
    assert [got[1, k] for k in range(1, 13)] == ["WRONG_STATUS", None, None, None, None, "IN_TRASH", None, None, "EMPTY_WINDOW", None, "NOT_IN_TRASH", "UNKNOWN"]
    assert [got[2, k] for k in range(1, 5)] == [None, "IN_TRASH", None, "NOT_FOUND"]
    notes = {r.event_id: r.review_note for r in folded.filter("doc_id = 1").collect()}
    assert (notes[3], notes[4], notes[8]) == ("no", "no", None)
    last = {r.doc_id: r for r in governance.last_states(folded).collect()}
    assert (last[1].publish_status, last[1].effective_at, last[1].trashed, last[1].refused) == ("PUBLISHED", 5, False, 5) and last[2].purged
    assert [r.doc_id for r in governance.expired_trash(governance.last_states(folded), 6).collect()] == [3]
    assert governance.fold_log(spark.createDataFrame([], LOG)).count() == 0


def test_a_hot_log_streams(spark):
    """One document with most of the events, over many batches."""
    r = random.Random(2)
    ops = [*governance.REVIEWS, "VALIDITY", "TRASH", "RESTORE"]
    log = [(0 if i % 5 else i % 7, i, r.choice(ops), i, "n", r.choice([None, 3]), r.choice([None, 2, 9])) for i in range(4_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(x.doc_id, x.event_id): x.refused for x in governance.fold_log(spark.createDataFrame(log, LOG)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    states, expected = {}, {}
    for doc, event, *rest in log:
        expected[doc, event] = states.setdefault(doc, governance.Governed()).apply(*rest)
    assert got == expected and len(set(expected.values())) > 3


def _size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_keyed_table(spark, tmp_path):
    """Batches in any order of their rows, ties, replays, versions, and nothing of a batch without a version."""
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    schema, r = "chunk_id long, seq long, v string", random.Random(3)
    assert table.version() is None
    with pytest.raises(ValueError):
        table.read()
    now, seen = {}, []
    for n in range(6):
        batch = [(r.randrange(40), r.randrange(5), f"{n}-{i}") for i in range(60 if n == 0 else 12)]
        best = {}
        for key, seq, value in batch:
            if key not in best or seq > best[key][0]:
                best[key] = (seq, value)
        batch = [(k, s, x) for k, (s, x) in best.items()]
        assert table.lay(spark.createDataFrame(batch, schema), n) == n
        for key, seq, value in batch:
            if key not in now or seq >= now[key][0]:
                now[key] = (seq, value)
        seen.append(dict(now))
        assert {x.chunk_id: (x.seq, x.v) for x in table.read().collect()} == now
    before = _size(tmp_path)
    assert table.lay(spark.createDataFrame([(0, 99, "again")], schema), 3) == 5 and _size(tmp_path) == before
    assert [{x.chunk_id: (x.seq, x.v) for x in table.read(n).collect()} for n in range(6)] == seen
    assert table.lay(spark.createDataFrame([], schema), "none") == 6 and table.read().count() == len(now)


def test_what_a_batch_writes(spark, tmp_path):
    """A small batch writes a small part of the table."""
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    rows = lambda n, s: spark.range(n).select(F.col("id").alias("chunk_id"), F.lit(s).alias("seq"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    table.lay(rows(20_000, 1), "all")
    whole = _size(tmp_path)
    table.lay(rows(50, 2), "few")
    assert _size(tmp_path) - whole < whole / 20


def test_pointers_activate_as_one(spark, tmp_path):
    schema = "doc_id long, version_id string, seq long"
    versions = spark.createDataFrame([(1, "a", "ACTIVE"), (1, "b", "READY"), (2, "c", "READY"), (3, "d", "ACTIVE")], "doc_id long, version_id string, status string")
    table = keyed.KeyedTable(spark, str(tmp_path / "p"), "doc_id")
    table.lay(spark.createDataFrame([(1, "a", 1), (2, "c", 1)], schema), 0)
    table.lay(spark.createDataFrame([(1, "b", 2)], schema), 1)
    status = lambda n: {r.version_id: r.status for r in keyed.with_active(versions, table.read(n)).collect()}
    assert status(0) == {"a": "ACTIVE", "b": "READY", "c": "ACTIVE", "d": "ACTIVE"} and status(1) == {"a": "READY", "b": "ACTIVE", "c": "ACTIVE", "d": "ACTIVE"}
    targets = spark.createDataFrame([(1, "b"), (2, "c")], "doc_id long, version_id string")
    assert status(1) == {r.version_id: r.status for r in v.activate(versions, targets).collect()}


def _message(inside, time="2024-01-01 10:00:00"):
    return f'<div class="message x"><span class="sender"> An<b>na</b> </span><span class="time">{time}</span>{inside}</div>'


def test_chat_pages(spark):
    page = (
        "<p>before" + _message('<div class="content">hi <i>there</i><script>no</script></div>') + _message('<div class="content"><audio></audio></div>') + _message("<video/>")
        + _message('<div class="content">text<img src="http://x/y"></div>', "1704103200") + _message('<div class="content">late</div>', "soon") + "<br>" + '<div class="message"><span class="time">1704103200000</span></div>'
    )
    rows = {r.session_id: r for r in chat_pages.read_chat_pages(spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None), (4, "")], "session_id long, html string")).collect()}
    got = [(m.msg_id, m.sender, m.send_time, m.msg_type, m.content) for m in rows[1].messages]
    assert got == [("1-1", "Anna", 1704103200000, "text", "hi there"), ("1-2", "Anna", 1704103200000, "image", "[IMAGE]"), ("1-3", "", 1704103200000, "text", "")]
    assert tuple(rows[1].skipped) == (1, 1, 1) and [rows[k].failed for k in range(1, 5)] == [False, True, True, True]


def test_selectors():
    page = chat_pages.Page('<div id=a class="m n"><p>1<p class=n>2</div>3<section><div class=m>4<br class=q>5</div></section><p>6')
    assert page.places("div.m") == [0, 4] and page.places("#a.n") == [0] and page.places(".n") == [0, 2] and page.places("p") == [1, 2, 6]
    assert page.first("p", 0) == 1 and page.first("p", 3) is None and page.first(".q", 3) == 5
    assert page.text(0) == "12" and page.text(2) == "2" and page.text(4) == "45" and page.text(5) == "" and page.text(3) == "45" and page.text(6) == "6"
    assert chat_pages.parsed("a.b#c.d") == ("a", "c", frozenset("bd"))
    for bad in ("a b", "a>b", "*", "a[href]"):
        with pytest.raises(ValueError):
            chat_pages.parsed(bad)


def test_unclosed_elements():
    page = chat_pages.Page("<div class=m><span>a<div class=m>b</div>c")
    assert page.text(0) == "abc" and page.text(1) == "abc" and page.text(2) == "b"
    assert chat_pages.Page("</div>x<div>y").text(0) == "y"


def test_required_selectors(spark):
    with pytest.raises(ValueError):
        chat_pages.read_chat_pages(spark.createDataFrame([], "session_id long, html string"), {"time": ""})


def test_split_chunks_deals_chunks_without_a_parent_to_all_tasks(spark):
    """All rows of a null key lie in one partition of a shuffle: the texts of all chunks without a parent did."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(keep, ("false", "-1", "8"), strict=True):
        spark.conf.set(k, v)
    try:
        n = spark.range(4000)
        chunks = n.selectExpr("concat('c', id) AS chunk_id", "concat('v', id % 500) AS version_id", "CASE WHEN id < 0 THEN 'none' END AS parent_id", "CAST(id AS INT) AS seq", "'some words' AS content", "true AS enabled")
        out = edits.split_chunks(chunks, n.selectExpr("concat('c', id) AS chunk_id", "array(4) AS offsets").filter("id % 10 = 0"))
        sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4400 and max(sizes) < 1200
