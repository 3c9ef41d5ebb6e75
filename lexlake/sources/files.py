"""Readers of files and chat exports, and sinks."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, groupby
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("pdf", "docx", "txt", "md", "sql", "xlsx", "csv", "html", "htm")
#: Upload and package limits.
MOST_BYTES, MOST_ENTRIES, MOST_UNPACKED = 100 << 20, 2000, 500 << 20
#: First bytes of formats that have some. Fixed values.
MAGIC = {"pdf": b"%PDF", "docx": b"PK\x03\x04", "xlsx": b"PK\x03\x04"}
#: Elements of pages: unseen ones, those that end a line, headings with their markdown marks. Fixed values.
UNSEEN = ("script", "style", "noscript", "template")
LINE_ENDS = (
    "p", "div", "section", "article", "aside", "header", "footer", "main", "nav", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "blockquote", "pre",
    "figure", "figcaption", "br", "hr",
)
HEADINGS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### "}


def decode(data: bytes) -> str:
    """Text of bytes in UTF-8 (with or without a mark) or GBK."""
    for name in ("utf-8-sig", "gbk"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


class _Events(HTMLParser):
    """A page as a list of events: (open or close, tag) and (text, characters)."""

    def __init__(self, page: str):
        super().__init__()
        self.list: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, _: self.list.append(("open", tag))
        self.handle_endtag = lambda tag: self.list.append(("close", tag))
        self.handle_data = lambda text: self.list.append(("text", text))
        self.feed(page)
        self.close()


def _seen(events: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Events outside unseen elements; a close without its open counts for nothing."""
    step = {"open": 1, "close": -1}
    depth = list(accumulate((step[k] if k != "text" and v in UNSEEN else 0 for k, v in events), lambda d, x: max(0, d + x)))
    return [e for e, d in zip(events, depth, strict=True) if not d and (e[0] == "text" or e[1] not in UNSEEN)]


def _place(now: tuple[int, str, bool], event: tuple[str, str]) -> tuple[int, str, bool]:
    """(number of the line, its mark, whether in the title) after an event."""
    line, mark, title = now
    kind, tag = event
    if kind == "text":
        return now
    if tag in HEADINGS:
        return line + 1, HEADINGS[tag] if kind == "open" else "", title
    return line + (tag in LINE_ENDS), mark, kind == "open" if tag == "title" else title


def html_to_markdown(html: str | None) -> str:
    """Title, headings and lines of a page, one blank line between them; what a browser doesn't show is left out."""
    events = _seen(_Events(html or "").list)
    places = list(accumulate(events, _place, initial=(0, "", False)))[1:]
    text = [(place, words) for (kind, words), place in zip(events, places, strict=True) if kind == "text"]
    title = " ".join(" ".join(words for (_, _, t), words in text if t).split())
    lines = ["# " + title] if title else []
    for (_, mark), run in groupby(((p[:2], words) for p, words in text if not p[2]), lambda x: x[0]):
        if body := " ".join("".join(words for _, words in run).split()):
            lines.append(mark + body)
    return "\n\n".join(lines)


def _markdown_of(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in html:
        yield s.map(html_to_markdown)


def markdown_of(html: F.Column | str) -> F.Column:
    """html_to_markdown of a column."""
    return F.pandas_udf(_markdown_of, "string")(html)


def markdown_table(rows: list[list[str]]) -> str:
    """Rows as a markdown table; the first is the header."""
    if not rows:
        return ""
    n = max(map(len, rows))
    cell = lambda x: " ".join(str("" if x is None else x).split()).replace("|", "\\|")
    lines = ["| " + " | ".join(cell(x) for x in (*r, *[""] * (n - len(r)))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * n) + " |", *lines[1:]])


def parse_csv(data: bytes) -> str:
    text = decode(data)
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t")
    except csv.Error:
        dialect = csv.excel
    return markdown_table(list(csv.reader(io.StringIO(text), dialect)))


def check_package(data: bytes) -> zipfile.ZipFile:
    """A ZIP package within the limits and without paths that leave it."""
    package = zipfile.ZipFile(io.BytesIO(data))
    infos = package.infolist()
    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_UNPACKED:
        raise ValueError("the package is too large")
    if any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in infos):
        raise ValueError("the package has a path that leaves it")
    return package


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def parse_docx(data: bytes) -> str:
    """Paragraphs and tables in order; heading styles become markdown headings."""
    body = ElementTree.fromstring(check_package(data).read("word/document.xml")).find(f"{_WORD}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{_WORD}p":
            style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
            name = style.get(f"{_WORD}val", "") if style is not None else ""
            level = name.lower().removeprefix("heading").strip()
            mark = "#" * max(1, min(6, int(level) if level.isdigit() else 1)) + " " if name.lower().startswith("heading") else ""
            if text(node).strip():
                out.append(mark + text(node).strip())
        elif node.tag == f"{_WORD}tbl":
            out.append(markdown_table([[text(c) for c in r.iter(f"{_WORD}tc")] for r in node.iter(f"{_WORD}tr")]))
    return "\n\n".join(out)


def _column(reference: str) -> int:
    """Number from 0 of a cell's column, of a reference like AB12."""
    n = 0
    for c in reference:
        if c.isalpha():
            n = 26 * n + ord(c.upper()) - 64
    return n - 1


def parse_xlsx(data: bytes) -> list[tuple[str, str]]:
    """(sheet, markdown table) of each sheet of the workbook, found by its relationship; cells stand in the columns they name."""
    package = check_package(data)
    names = package.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(package.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))}

    def value(cell) -> str:
        kind, v = cell.get("t"), cell.findtext(f"{_SHEET}v") or ""
        return shared[int(v)] if kind == "s" and v else "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) or v

    out = []
    for k, sheet in enumerate(ElementTree.fromstring(package.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"), 1):
        target = targets.get(sheet.get(_RELATION), f"worksheets/sheet{k}.xml")
        rows = []
        for r in ElementTree.fromstring(package.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_SHEET}row"):
            held = {}
            for c in r.iter(f"{_SHEET}c"):
                held[_column(c.get("r")) if c.get("r") else max(held, default=-1) + 1] = value(c)
            rows.append([held.get(n, "") for n in range(max(held, default=-1) + 1)])
        out.append((sheet.get("name", f"Sheet{k}"), markdown_table(rows)))
    return out


def garbled(text: str, share: float = 0.5) -> bool:
    """Whether fewer than share of the characters (white space aside) are letters, digits or usual marks."""
    bare = [c for c in text if not c.isspace()]
    return bool(bare) and sum(c.isalnum() or 0x20 < ord(c) < 0x7F or 0x2010 <= ord(c) <= 0x206F or 0x3000 <= ord(c) <= 0x303F or 0xFF00 <= ord(c) <= 0xFFEF for c in bare) < share * len(bare)


def parse(data: bytes, kind: str) -> str:
    """Markdown of a file's bytes by its extension. PDF needs a parser that isn't part of this library."""
    kind = kind.lower().lstrip(".")
    if kind in ("txt", "md", "sql"):
        return decode(data)
    if kind in ("html", "htm"):
        return html_to_markdown(decode(data))
    if kind == "csv":
        return parse_csv(data)
    if kind == "docx":
        return parse_docx(data)
    if kind == "xlsx":
        return "\n\n".join(f"## Sheet: {n}\n\n{t}" for n, t in parse_xlsx(data))
    raise ValueError(f"no parser for {kind}")


def upload_error(name: F.Column, length: F.Column, head: F.Column) -> F.Column:
    """Why a file is refused: EMPTY, TOO_LARGE, UNKNOWN_TYPE or BAD_CONTENT; null if it isn't."""
    kind = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    bad = F.lit(False)
    for ext, magic in MAGIC.items():
        bad = bad | ((kind == ext) & (F.substring(head, 1, 4) != F.lit(bytearray(magic))))
    return F.when(length == 0, "EMPTY").when(length > MOST_BYTES, "TOO_LARGE").when(~kind.isin(*FORMATS), "UNKNOWN_TYPE").when(bad, "BAD_CONTENT")


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files under a path of any store: path, kind, markdown, error. A file that can't be parsed keeps its row with the error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    rows = files.withColumn("error", upload_error(F.col("path"), F.col("length"), F.col("content"))).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, kind, data, error in zip(pdf["path"], pdf["kind"], pdf["content"], pdf["error"], strict=True):
                text = None
                if error is None:
                    try:
                        text = parse(bytes(data), kind)
                    except Exception as e:  # a damaged file must not end the job
                        error = f"PARSE_FAILED: {e}"[:300]
                out.append((path, kind, text, error))
            yield pd.DataFrame(out, columns=["path", "kind", "markdown", "error"])

    return rows.select("path", "kind", "content", "error").mapInPandas(parsed, "path string, kind string, markdown string, error string")


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 text files, each with a header and the mark by which spreadsheets know UTF-8; lines end with CR and LF, those inside of values too."""
    marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if df.columns else df
    marked.write.option("header", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").mode("overwrite").csv(path)


def list_objects(spark: SparkSession, path: str, most: int = 1000) -> tuple[DataFrame, bool]:
    """((path, length, modified) of the first objects under a path of any store, by path; whether there are more). No content is read; empty objects are not listed."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    first = every.orderBy("path").limit(most + 1)
    return first.orderBy("path").limit(most), first.count() > most


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet folders by key; rows of a key are brought together first, so each folder has few files."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_snapshot(df: DataFrame, root: str, numbers: list[int]) -> str:
    """An immutable copy under the next number after those taken; returns its path."""
    path = f"{root}_s{max(numbers, default=0) + 1}"
    df.write.mode("errorifexists").parquet(path)
    return path


def bench_chunks(spark: SparkSession, n: int = 100_000, documents: int = 50, seed: int = 42) -> DataFrame:
    """Deterministic chunks for load tests."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1000)).cast("string")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(5000)).cast("string"))), " ")
    return spark.range(n).select(F.concat(F.lit("chunk-"), F.col("id")).alias("chunk_id"), F.pmod("id", F.lit(documents)).alias("doc_id"), words.alias("content"), h(1).alias("tag"))
