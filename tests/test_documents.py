"""The semantic splitter, images of documents and the answer gate against plain versions."""

import base64
import datetime as dt
import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lexlake.operators import access, chat, fusion, semantic, split, usage
from lexlake.operators import evaluation as ev
from lexlake.sources import files, images


def plain_split(text, answers, most):
    """One window after the other, units as strings."""
    units = re.findall(r"[^\n.!?;。！？；]*[\n.!?;。！？；]|[^\n.!?;。！？；]+", text) if text.strip() else []
    budget = total = 0
    for u in units:
        total, budget = total + split.estimate(u), budget + 1
        if total >= 8 * most:
            break
    out, cursor, n = [], 0, 0
    while cursor < len(units):
        shared = min(2, cursor)
        end = min(len(units), max(cursor - shared + budget, cursor + 1))
        window, answer = units[cursor - shared : end], answers.get(n)
        try:
            cuts = json.loads(re.sub(r"^```.*?\n|```$", "", answer.strip()))["cuts"]
            ok = all(type(c) is int for c in cuts) and cuts == sorted(set(cuts)) and all(shared <= c < len(window) - 1 for c in cuts)
        except Exception:
            ok = False
        if ok:
            edges = [shared, *(c + 1 for c in cuts), len(window)]
            out += [(x, True) for a, b in zip(edges[:-1], edges[1:], strict=True) if (x := "".join(window[a:b]).strip("".join(map(chr, range(33)))))]
        else:
            body = "".join(window[shared:])
            out += [(body[a:b], False) for a, b in split.fixed_spans(body, most)]
        cursor, n = end, n + 1
    return out


def test_semantic_split(spark):
    text = " ".join(f"Sentence number {k} is here.{' 日本語。' if k % 7 == 0 else ''}" for k in range(60)) + "\n\n tail without an end"
    texts = [(1, text), (2, "one. two"), (3, " \n "), (4, None), (5, "a" * 900), (6, text[:700])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = semantic.semantic_windows(docs, 8).collect()
    assert {r.doc_id for r in asked} == {1, 2, 5, 6} and all(len(r.listing.splitlines()) == r.units for r in asked)
    said = ['{"cuts": [3]}', '{"cuts": [3, 3]}', '{"cuts": [0]}', "```json\n{\"cuts\": [2, 4], \"chunks\": [{\"title\": \"T\", \"keywords\": [\"k\", 1]}, 5, {\"summary\": null}]}\n```", "prose", '{"cuts": []}', '{"cut": [1]}', '{"cuts": [3.5]}', '{"cuts": [true]}', '{"cuts": [900]}', "[1]", '{"cuts": [null]}']
    answers = {(r.doc_id, r.window_no): said[(r.doc_id + r.window_no) % len(said)] for r in asked if r.window_no % 6 != 5}
    rows = [(d, n, a) for (d, n), a in answers.items()] + [(9, 0, '{"cuts": [1]}'), (1, None, "x")]
    got = sorted(semantic.split_semantic(docs, spark.createDataFrame(rows, "doc_id long, window_no int, answer string"), 8).collect(), key=lambda r: (r.doc_id, r.seq))
    for d, t in texts:
        mine = [r for r in got if r.doc_id == d]
        assert [(r.content, r.by_model) for r in mine] == plain_split(t or "", {n: a for (x, n), a in answers.items() if x == d}, 8)
        assert [r.seq for r in mine] == list(range(len(mine))) and all(t[r.start : r.stop] == r.content for r in mine)
    assert {r.by_model for r in got} == {True, False} and {(r.title, tuple(r.keywords or ())) for r in got} == {(None, ()), ("T", ("k", "1"))}


def test_windows_go_on():
    """Windows cover all units, whatever their sizes."""
    for sizes in ([1] * 30, [1000] * 5, [1, 1000, 1], [], [3]):
        found = semantic.windows(sizes, 2)
        assert [u for a, b, s in found for u in range(a + s, b)] == list(range(len(sizes)))


def docx(body, media, links):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="x"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{k}" Type="http://x/{"image" if t.startswith("media") else "link"}" Target="{t}"/>' for k, t in links) + "</Relationships>")
        for name, data in media:
            z.writestr(f"word/media/{name}", data)
    return out.getvalue()


def test_images(spark, tmp_path):
    blip = lambda k: f'<w:p><a:blip r:embed="{k}"/></w:p>'
    word = docx(blip("r2") + blip("r1") + blip("r2") + blip("r9"), [("b.png", b"B"), ("a.JPG", b"A" * 50), ("z.xyz", b"Z"), ("c.gif", b"B")], [("r1", "media/a.JPG"), ("r2", "media/b.png"), ("r3", "other.xml")])
    uri = lambda x: base64.b64encode(x).decode()
    page = f'<img src="data:image/gif;base64,{uri(b"one")}"><img src="data:text/plain;base64,{uri(b"no")}"> data:image/png;base64,!!! <img src="data:image/png;name=x;base64,{uri(b"two!")}">'
    for name, data in (("w.docx", word), ("p.html", page.encode()), ("bad.docx", b"PK\x03\x04 broken"), ("t.txt", b"data:image/png;base64,QQ=="), ("e.md", b"")):
        (tmp_path / name).write_bytes(data)
    assets, warnings = images.read_images(spark, str(tmp_path), 2, 10)
    got = sorted((r.path.rpartition("/")[2], r.place, r.image_id, r.media_type, bytes(r.content)) for r in assets.collect())
    assert got == [("p.html", 0, "img_1", "image/gif", b"one"), ("p.html", 1, "img_2", "image/png", b"two!"), ("w.docx", 0, "img_1", "image/png", b"B"), ("w.docx", 3, "img_2", "application/octet-stream", b"Z")]
    left = sorted((r.path.rpartition("/")[2], r.reason[:12]) for r in warnings.collect())
    assert left == [("bad.docx", "PARSE_FAILED"), ("w.docx", "IMAGE_BYTES")]
    some, more = images.read_images(spark, str(tmp_path), 1, 100)
    assert some.count() == 2 and sorted(r.reason[:11] for r in more.collect()) == ["IMAGE_COUNT", "IMAGE_COUNT", "IMAGE_COUNT", "PARSE_FAILE"]


MARKS = "case_id long, seq long, requested boolean, judged boolean, degraded boolean, refusal_correct boolean, score double, correctness double, faithfulness double, completeness double, citation_correctness double, citation_completeness double"


@pytest.mark.parametrize("mark", [*ev.ANSWER_MARKS, "refusal_accuracy"])
def test_each_mark_is_compared(spark, mark):
    """A loss in any one mark blocks; the same loss within what is tolerated doesn't."""
    def run(loss, n=100):
        marks = lambda k: [4.0 - (loss if mark == m else 0) for m in ev.ANSWER_MARKS]
        return spark.createDataFrame([(k, k, True, True, False, not (mark == "refusal_accuracy" and k < loss * 10), *marks(k)) for k in range(n)], MARKS)

    decided = {}
    for loss in (0.2, 0.9):
        m = ev.answer_comparison(run(loss), run(0.0)).selectExpr("*", "true AS available", *(f"CAST(null AS DOUBLE) AS min_{x}" for x in ev.HELD_TO))
        decided[loss] = ev.answer_gate(m).first().decision
    assert decided == {0.2: "PASSED", 0.9: "BLOCKED"}


def test_which_cases_count(spark):
    row = lambda c, seq, requested=True, judged=True, degraded=False, score=3.0: (c, seq, requested, judged, degraded, True, score, 1.0, 1.0, 1.0, 1.0, None)
    candidate = spark.createDataFrame([row(1, 2, score=5.0), row(1, 1, score=1.0), row(2, 1, judged=False), row(3, 1, requested=False), row(4, 1), row(None, 1), row(5, 1, degraded=True, judged=False)], MARKS)
    baseline = spark.createDataFrame([row(1, 1), row(2, 1), row(3, 1), row(6, 1), row(5, 1, degraded=True)], MARKS)
    m = ev.answer_comparison(candidate, baseline).first()
    assert (m.cases, m.failed, m.degraded, m.score, m.base_score, m.citation_completeness, m.has_baseline) == (1, 2, 0, 1.0, 3.0, 0.0, True)
    m = ev.answer_comparison(candidate, baseline.limit(0)).first()
    assert (m.cases, m.failed, m.degraded, m.score, m.base_score, m.has_baseline) == (2, 2, 1, 2.0, None, False)
    assert ev.answer_comparison(candidate.limit(0), None).first().score == 0.0


def test_csv_is_rfc_4180(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("a,b", 'say "x"'), ("line\nbreak", None)], "name string, b string").coalesce(1), f"{tmp_path}/c")
    raw = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname,b\r\n") and b'"a,b","say ""x"""\r\n' in raw and b'"line\r\nbreak",\r\n' in raw


def test_listing_says_when_it_is_cut(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.txt").write_text("x" * (k + 1))
    for most, cut in ((3, True), (4, False)):
        rows, more = files.list_objects(spark, str(tmp_path), most)
        assert [r.length for r in rows.collect()] == list(range(1, most + 1)) and more is cut


def test_budgets_and_lists(spark):
    units = spark.createDataFrame([(1, 1, 9), (1, 2, None), (1, 3, 2), (2, 1, 50)], "query_id int, position int, n int")
    kept = lambda b: sorted((r.query_id, r.position) for r in fusion.content_budget(units, b, F.col("n")).collect())
    assert kept(10) == [(1, 1), (1, 2), (2, 1)] and kept(None) == kept(0) == kept(99) and len(kept(0)) == 4
    row = spark.createDataFrame([({"a": ["x", " ", None], "b": [""], "src": ["y"]},)], "m map<string,array<string>>").select(access.flattened_lists(F.col("m"), ["src"]).alias("m"), access.begins(F.lit("a_b"), "a_").alias("y"), access.begins(F.lit("axb"), "a_").alias("n")).first()
    assert row.m == {"ext_a": ["x"]} and row.y and not row.n
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 7), (4, None, 9)], "id int, k string, n int")
    assert [r.id for r in usage.listed(rows, {"k": "a", "id": None}, {"n": (6, None)}).collect()] == [2]
    assert [r.id for r in usage.listed(rows, None, {"n": (None, 7)}).orderBy("id").collect()] == [1, 2, 3]


def test_addresses_are_locked(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [("x", now - dt.timedelta(minutes=m), m == 3, None) for m in (1, 2, 3, 4, 5)] + [("y", now - dt.timedelta(minutes=m), False, None) for m in (1, 2, 3, 14, 15)] + [("z", now, False, "DIRECTORY_UNAVAILABLE")] * 9 + [(None, now, False, None)] * 9 + [("w", now, False, "BAD")] * 5
    logins = spark.createDataFrame(rows, "ip string, at timestamp, ok boolean, reason string")
    assert [(r.ip, r.failures) for r in usage.locked_addresses(logins, F.lit(now)).collect()] == [("w", 5)]


def test_text_exports(spark):
    a = ["junk", "", "2024-01-01 10:00:00 Ann Lee", "hi", "  ", "there ", "2024-99-01 10:00:00 Bo", "more", "Cy (2024-01-01 10:01:00): now", "then", "Di (2024-01-01 10:02:00):"]
    b = ["junk", "junk", "2024-01-01 10:00:00 X"]
    lines = [("a", k, x) for k, x in enumerate(a)] + [("b", k, x) for k, x in enumerate(b)]
    messages, seen = chat.txt_sessions(spark.createDataFrame(lines, "file string, line_no int, line string"))
    assert [(r.msg_id, r.sender, r.content) for r in messages.orderBy("msg_id").collect()] == [("a-1", "Ann Lee", "hi\nthere \nmore"), ("a-2", "Cy", "now\nthen"), ("a-3", "Di", "")]
    assert {r.file: (r.lines, r.unmatched, r.skipped, r.failed) for r in seen.collect()} == {"a": (9, 1, 1, False), "b": (3, 2, 0, True)}


def test_table_exports(spark):
    raw = spark.createDataFrame([("f", 0, " ", None, ""), ("f", 1, "1700000000", "语音", "x"), ("f", 2, "1700000000", "3", None), ("f", 3, "soon", "", "x"), ("f", 4, "1700000000", None, " hi ")], "file string, row_no int, `Send Time` string, type string, text string")
    columns = {"content": ["body", "Text"], "send_time": ["sendtime"], "msg_type": ["TYPE"], "sender": ["from"]}
    messages, skipped = chat.table_messages(raw, columns)
    assert [(r.msg_id, r.msg_type, r.content, r.sender, r.is_self, r.send_time) for r in messages.orderBy("msg_id").collect()] == [("default-2", "image", "", "", False, 1700000000000), ("default-4", "text", "hi", "", False, 1700000000000)]
    assert tuple(skipped.first()) == ("f", 1, 0, 1)
    with pytest.raises(ValueError):
        chat.table_messages(raw, {"content": ["none"]})


def test_blocks_are_joined_and_keep_their_overlap():
    """Blocks by a line end, their own tokens counted; a large one by segments, as a text of its own."""
    assert split.packed(["aa ", " ", "bb", "c" * 40, "dd", "ee"], 4) == ["aa \nbb", *["c" * 16] * 2, "c" * 8, "dd\nee"]
    large = ". ".join(f"s{k}" for k in range(30))
    assert split.packed(["x", large], 6, 2) == ["x", *(large[a:b] for a, b in split.fixed_spans(large, 6, 2))]
    assert split.separator_pieces("a;b[;c", 9, separator="[;", is_regex=True) == split.separator_pieces("a;b[;c", 9, separator="[;") == [(None, None, "a;b\nc")]
    assert [c for *_, c in split.separator_pieces("a1b22c", 9, separator="[0-9]+", is_regex=True)] == ["a\nb\nc"]


def test_headings():
    text = "\nintro\n# A\nx\n### deep\ny\n## B\nz\n#no\n# C"
    assert [c for *_, c in split.heading_pieces(text, 4)] == ["intro", "# A\nx\n### deep\ny", "## B\nz\n#no\n# C"]
    assert split.heading_pieces(text, 100) == [(None, None, text.strip())]
    assert split.heading_pieces(text, 5, level=9) == split.heading_pieces(text, 5, level=2)
    assert split.heading_pieces("no heading. here", 2) == split.fixed_pieces("no heading. here", 2)
    with pytest.raises(ValueError):
        split.parent_child_spans("x", 5, 6)


def test_feedback_becomes_cases(spark):
    feedback = spark.createDataFrame([(1, "NEW", "GOOD", "q", "t"), (2, "NEW", "BAD", "q", "t"), (3, "CONVERTED", "GOOD", "q", "t"), (4, "NEW", "GOOD", "q", "gone"), (5, "NEW", "GOOD", "q", "i"), (6, "NEW", None, "q", "t")], "feedback_id long, status string, verdict string, query string, chunk_id string")
    chunks = spark.createDataFrame([("t", 7, "text", "TEXT"), ("i", 8, "pic", "IMAGE")], "chunk_id string, doc_id long, content string, chunk_type string")
    cases, after = ev.feedback_cases(feedback, chunks, "d")
    assert sorted((r.anchor_type, r.doc_id, r.span) for r in cases.collect() if r.anchor_type == "DOCUMENT" or r.span) == [("DOCUMENT", 8, None), ("SPAN", 7, "text"), ("SPAN", 7, "text")]
    assert {r.feedback_id: (r.status, r.refused, r.case_id is None) for r in after.collect()} == {1: ("CONVERTED", None, False), 2: ("NEW", "BAD", True), 3: ("CONVERTED", "NOT_NEW", True), 4: ("NEW", "NO_CHUNK", True), 5: ("CONVERTED", None, False), 6: ("CONVERTED", None, False)}
