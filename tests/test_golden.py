"""Hand-computed expectations of single operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexlake.operators import chat, evaluation, fusion, split, text, versions
from lexlake.operators.evaluation import covered, longest_run
from lexlake.sources import files
from lexlake.streaming.streams import bucket_decisions


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def routes(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "query_id int, route string, chunk_id string, score double")


def test_rrf(spark):
    got = fusion.rrf(routes(spark, [("VECTOR", "a", 0.9), ("VECTOR", "b", 0.8), ("BM25", "b", 7.0), ("BM25", "c", 6.0)]))
    scores = {r.chunk_id: r.fused_score for r in got.collect()}
    assert scores["b"] == pytest.approx(1 / 62 + 1 / 61) and scores["a"] == pytest.approx(1 / 61) and scores["c"] == pytest.approx(1 / 62)


def test_weighted(spark):
    got = fusion.weighted_fusion(routes(spark, [("VECTOR", "shared", 0.9), ("VECTOR", "v", 0.1), ("BM25", "k", 20.0), ("BM25", "shared", 10.0)]), 0.7)
    assert {r.chunk_id: round(r.fused_score, 9) for r in got.collect()} == {"shared": 0.7, "v": 0.0, "k": 0.3}


def test_weighted_equal_scores_count_full_but_hybrid_counts_none(spark):
    got = fusion.weighted_fusion(routes(spark, [("VECTOR", "a", 0.5), ("VECTOR", "b", 0.5)]), 0.6)
    assert {r.fused_score for r in got.collect()} == {0.6}
    c = spark.createDataFrame([(0, 0.5, 3.0), (0, 0.4, 3.0)], "query_id int, rerank_score double, bm25_score double")
    assert {round(r.hybrid_score, 9) for r in fusion.hybrid_order(c).collect()} == {0.35, 0.28}


@pytest.mark.parametrize(("weights", "quotas"), [((2, 1, 1), (26, 12, 12)), ((3, 1), (38, 12)), ((1, 1, 1), (18, 16, 16)), ((None, 0, 2), (12, 12, 26))])
def test_quota(spark, weights, quotas):
    bases = spark.createDataFrame([(f"k{i}", w, i) for i, w in enumerate(weights)], "kb_id string, weight int, decl_order int")
    assert tuple(r.quota for r in fusion.kb_quota(bases, 50).orderBy("decl_order").collect()) == quotas


def test_cross_kb(spark):
    rows = spark.createDataFrame([(0, "a", "a1", 9.0), (0, "a", "a2", 8.0), (0, "a", "a3", 7.0), (0, "b", "b1", 0.2), (0, "b", "b2", 0.1)], "query_id int, kb_id string, chunk_id string, fused_score double")
    assert [r.chunk_id for r in fusion.cross_kb_rrf(rows).orderBy("position").collect()] == ["a1", "b1", "a2", "b2", "a3"]


def test_graph_relevance(spark):
    rows = spark.createDataFrame([(0, "c", "far", 0.6, 2), (0, "c", "near", 0.8, 0), (0, "c", "middle", 0.6, 1)], "query_id int, chunk_id string, entity_name string, match_score double, hops int")
    r = fusion.graph_relevance(rows).first()
    assert (r.score, r.hops, r.entities) == (0.8, 0, ["near", "middle", "far"])


def test_metrics(spark):
    cases = spark.createDataFrame([("A", True, 1, 2, 2, [True, False, True], 2), ("B", False, None, 0, 2, [False] * 3, 2)], "case_id string, hit boolean, hit_rank int, evidence_hits int, evidence_total int, relevance array<boolean>, ideal_relevant int")
    r = evaluation.retrieval_metrics(cases, 3).first()
    assert (r.recall, r.hit_rate, r.mrr) == (0.5, 0.5, 0.5)
    assert r.precision == pytest.approx(1 / 3) and r.ndcg == pytest.approx(0.459860394574, abs=1e-9)
    assert (r.recall_low, r.recall_high) == (pytest.approx(0.150038989110, abs=1e-8), pytest.approx(0.849961010890, abs=1e-8))
    assert (r.hit_low, r.hit_high) == (pytest.approx(0.094531205702, abs=1e-8), pytest.approx(0.905468794298, abs=1e-8))


def test_windows():
    minute = 60_000

    def spans(times, minutes, most, overlap):
        held = chat.OpenWindow(minutes, most, overlap)
        return [r[1:3] for r in (*(r for t in times for r in held.add(t, "x")), *held.close())]

    assert spans([0, 59 * minute, 60 * minute], 60, 50, 0) == [(0, 1), (2, 2)]
    assert spans([0] * 7, 60, 3, 0) == [(0, 2), (3, 5), (6, 6)]
    assert spans([0] * 10, 60, 5, 2) == [(0, 4), (3, 7), (6, 9)]


@pytest.mark.parametrize(("s", "n"), [("中文字符", 4), ("abcdefgh", 2), ("abcdefghi", 3), ("中文abcd", 3), ("한글한글", 1), ("😀😀", 1), ("。ー", 2)])
def test_token_estimate(spark, s, n):
    assert value(spark, text.token_estimate(F.lit(s))) == n == split.estimate(s)


@pytest.mark.parametrize(
    ("s", "masked"),
    [("13800138000", "138****8000"), ("11010519491231002X", "110105********002X"), ("6222 0212 3456 7890", "**** **** **** 7890"), ("12800138000", "12800138000"), ("1234567890", "1234567890"), ("913800138000123456789", "913800138000123456789"), ("ab.c@mail.example.com", "a***@mail.example.com"), ("x@a.co", "*@a.co"), ("price *1234567 and 2*20240115", "price *1234567 and 2*20240115"), ("6222-0212-3456-7890-123", "****-****-****-***0-123"), ("11010519491231002", "*************1002")],
)
def test_mask(spark, s, masked):
    assert value(spark, text.mask_sensitive(F.lit(s))) == masked


def plain_mask(s):
    """The rules one after the other, by their definition."""
    def card(m):
        digits = sum(c.isdigit() for c in m[0])
        out, seen = "", 0
        for c in m[0]:
            seen += c.isdigit()
            out += "*" if c.isdigit() and seen <= digits - 4 else c
        return out

    s = re.sub(r"(?<!\d)\d{17}[\dXx](?!\d)", lambda m: m[0][:6] + "*" * 8 + m[0][-4:], s, flags=re.A)
    s = re.sub(r"(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?:[ -]?\d{1,3})?(?![\d-])", card, s, flags=re.A)
    s = re.sub(r"(?<!\d)1[3-9]\d{9}(?!\d)", lambda m: m[0][:3] + "****" + m[0][-4:], s, flags=re.A)
    return re.sub(r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", lambda m: (m[1][0] if len(m[1]) > 1 else "") + "*" * max(len(m[1]) - 1, 1) + "@" + m[2], s)


def test_mask_is_the_plain_version(spark, sf):
    r = random.Random(1)
    made = ["".join(r.choice(["1", "13", "4444", "5555 ", "6666-", "7", "X", " ", "-", "a@b.co", "138", "0000", "*", "."]) for _ in range(r.randint(1, 14))) for _ in range(3000)]
    texts = made + [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect() if x.text]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.mask_sensitive(F.col("t")).alias("m")).collect()
    assert all(x.m == plain_mask(texts[x.i]) for x in got)


def test_redact_overlaps(spark):
    """Spans that overlap leave a mark each; of two that begin together one counts."""
    rows = [[(0, 5), (3, 8)], [(3, 8), (0, 5)], [(2, 4), (2, 9)], [(0, 10), (4, 6)], [(4, 6), (6, 8)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, spans array<struct<start:int,stop:int>>")
    got = [r.t for r in df.select("i", versions.redact(F.lit("abcdefghij"), F.col("spans"), "#").alias("t")).orderBy("i").collect()]
    assert got == ["##ij", "##ij", "ab#efghij", "##ghij", "abcd##ij"]


def test_plan_version(spark):
    history = [("a", 1, 1, 0, True, "h1"), ("a", 2, 2, 0, False, "h2"), ("b", 1, 1, 0, False, "h1"), ("b", 2, 1, 1, False, "h2"), ("c", 1, 3, 4, True, "h1")]
    h = spark.createDataFrame([(*x, "p", "s", "e") for x in history], "doc_id string, id int, major int, minor int, active boolean, content_hash string, parse_fp string, chunk_fp string, embedding_version string")
    uploads = spark.createDataFrame([("a", "h2", "p", "s", "e"), ("b", "h2", "q", "s", "e"), ("c", "h1", "p", "s", "e"), ("d", "h", "p", "s", "e")], "doc_id string, content_hash string, parse_fp string, chunk_fp string, embedding_version string")
    assert {r.doc_id: (r.action, r.version) for r in versions.plan_version(h, uploads).collect()} == {"a": ("MAJOR", "3.0"), "b": ("MINOR", "1.2"), "c": ("DUPLICATE", None), "d": ("FIRST", "1.0")}


def test_overlap():
    assert longest_run("ABCDE", "ABCDEFGHIJ") == (0, 5)
    assert covered([(0, 5), (5, 5)]) == 10 and covered([(0, 5), (0, 5)]) == 5


def test_judge_spans(spark):
    e = spark.createDataFrame([("c", 0, 1, "ABCDEFGHIJ")], "case_id string, evidence_no int, doc_id int, span string")
    r = spark.createDataFrame([("c", 1, 1, "xx ABC"), ("c", 2, 1, "FGHIJ"), ("c", 1, 2, "ABCDEFGHIJ")], "case_id string, rank int, doc_id int, text string")
    got = evaluation.judge_spans(e, r).first()
    assert (got.hit_rank, got.coverage) == (2, 0.8)


def test_fixed_split_replays_overlap():
    s = "".join(f"{c * 35}." for c in "abcd")
    spans = split.fixed_spans(s, 20, 10)
    assert [s[a:b] for a, b in spans][1].startswith("b" * 35) and "c" * 35 in s[slice(*spans[1])]
    assert all(split.estimate(s[a:b]) <= 20 for a, b in spans)


def test_heading_and_separator_split():
    s = "# A\none\n## B\ntwo\n### C\nthree"
    assert [c.split("\n")[0] for _, _, c in split.heading_pieces(s, 6, 0, 2)] == ["# A", "## B"]
    assert split.separator_pieces("a\n\n\n\nb", 1) == [(None, None, "a"), (None, None, "b")]
    assert split.fixed_spans("", 10) == [] and split.fixed_spans(" \n ", 10) == []


def test_redact(spark):
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("stop")))
    assert value(spark, versions.redact(F.lit("abcdef"), spans, "#")) == "ab#ef"
    bad = F.array(F.struct(F.lit(2).alias("start"), F.lit(40).alias("stop")))
    assert value(spark, versions.redact(F.lit("abcdef"), bad, "#")) == "abcdef"


def test_html():
    page = "<html><head><title>T</title><style>x{}</style></head><body><h1>A</h1><p>b &amp; <a href='x'>c</a></p><script>no()</script><h3>D</h3></body></html>"
    assert files.html_to_markdown(page) == "# T\n\n# A\n\nb & c\n\n### D"
    assert files.html_to_markdown(None) == ""


def test_csv_and_decoding():
    assert files.parse_csv(b"Name,Age\nAlice,30\nBob,25") == "| Name | Age |\n| --- | --- |\n| Alice | 30 |\n| Bob | 25 |"
    assert files.decode("中文".encode("gbk")) == "中文" and files.decode("﻿é".encode()) == "é"


def test_read_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "b.csv").write_text("a;b\n1;2")
    (tmp_path / "c.pdf").write_text("no pdf")
    (tmp_path / "d.exe").write_text("x")
    got = {r.path.rsplit("/", 1)[-1]: (r.markdown, r.error) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ("# x", None) and got["c.pdf"][1] == "BAD_CONTENT" and got["d.exe"][1] == "UNKNOWN_TYPE" and got["b.csv"][0].startswith("| a | b |")


def test_bucket():
    assert bucket_decisions([0, 0, 0, 500, 1000], 2.0) == [True, True, False, True, True]


def test_chat_txt(spark):
    lines = ["noise", "2024-01-01 00:00:00 ann", "hi", "there", "2024-01-01 00:01:00 bob", "yo"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert [(r.sender, r.content) for r in chat.txt_messages(df).orderBy("msg_no").collect()] == [("ann", "hi\nthere"), ("bob", "yo")]


def test_times_and_types(spark):
    assert value(spark, text.parse_time_ms(F.lit("1737800000"))) == 1737800000000
    assert value(spark, text.parse_time_ms(F.lit("2024/01/02 03:04"))) == 1704164640000
    assert value(spark, text.parse_time_ms(F.lit("soon"))) is None
    assert value(spark, text.message_type(F.lit(None).cast("string"))) == "text"


def test_near_windows(spark):
    rows = spark.createDataFrame([(0, 1, "a", 5, 0, 9), (0, 2, "b", 5, 6, 11), (0, 3, "c", 5, 4, 8), (0, 4, "d", None, 0, 9)], "query_id int, position int, chunk_id string, session_id int, first_msg int, last_msg int")
    got = {r.chunk_id: r.absorbed for r in chat.merge_near_windows(rows).collect()}
    assert got == {"a": ["b", "c"], "d": []}


def test_longest_run_is_the_plain_one():
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choice("ab😀") for _ in range(r.randint(0, 12))) for _ in range(2))
        runs = [(j - i, -i) for i in range(len(b)) for j in range(i + 1, len(b) + 1) if b[i:j] in a]
        n, at = max(runs, default=(0, 0))
        assert longest_run(a, b) == (-at, n)


def test_html_lines():
    page = "<title>A <b>t</b></title><h2>One<br>two</h2>x<script><h1>no</h1></script><figure>f<figcaption>c</figcaption></figure><table><thead><tr><td>1<td>2</thead></table></p><h9>z</h9>"
    assert files.html_to_markdown(page) == "# A t\n\n## One\n\n## two\n\nx\n\nf\n\nc\n\n12\n\nz"


def test_xlsx_cells(tmp_path):
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="S" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/other.xml"/></Relationships>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="C1"><v>3</v></c></row><row><c r="B2"><v>2</v></c></row></sheetData></worksheet>')
    assert files.parse_xlsx((tmp_path / "a.xlsx").read_bytes()) == [("S", "| x |  | 3 |\n| --- | --- | --- |\n|  | 2 |  |")]
