"""Chat exports in HTML: messages found by selectors.

A page is read once into its elements, numbered in order of their opening, each with the number that its inside ends at.
What lies within an element is then a range of numbers, and the first match in it is the least number in the range.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.operators.text import parse_time_ms

#: Elements without an inside, elements whose text is not shown, and the selectors of a common export. Fixed values.
EMPTY = frozenset(("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))
UNSEEN = frozenset(("script", "style"))
SELECTORS = {"message": "div.message", "sender": "span.sender", "time": "span.time", "content": "div.content", "image": "img", "voice": "audio", "video": "video"}
REQUIRED = ("message", "sender", "time", "content")
IMAGE = "[IMAGE]"

_SELECTOR = re.compile(r"([A-Za-z][A-Za-z0-9]*)?((?:[.#][\w-]+)*)")


class Page(HTMLParser):
    """The elements of a page (tag, id, classes), where each ends, and its text by the number of the element before it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, str | None, frozenset[str]]] = []
        self.ends: list[int] = []
        self.texts: list[tuple[int, int, str]] = []
        self._open: list[int] = []
        self.feed(html)
        self.close()
        self._finish(0)
        self._places: dict[str, list[int]] = {}

    def _begin(self, tag: str, attrs: list) -> int:
        named = dict(attrs)
        self.elements.append((tag, named.get("id"), frozenset((named.get("class") or "").split())))
        self.ends.append(len(self.elements))
        return len(self.elements) - 1

    def handle_starttag(self, tag, attrs):
        n = self._begin(tag, attrs)
        if tag not in EMPTY:
            self._open.append(n)

    def handle_startendtag(self, tag, attrs):
        self._begin(tag, attrs)

    def handle_endtag(self, tag):
        """Ends the last open element of this tag and all that is open within it; without one, nothing."""
        at = next((k for k in reversed(range(len(self._open))) if self.elements[self._open[k]][0] == tag), None)
        if at is not None:
            self._finish(at)

    def _finish(self, at: int) -> None:
        for n in self._open[at:]:
            self.ends[n] = len(self.elements)
        del self._open[at:]

    def handle_data(self, data):
        if not any(self.elements[n][0] in UNSEEN for n in self._open):
            self.texts.append((self._open[-1] if self._open else -1, len(self.elements), data))

    def places(self, selector: str) -> list[int]:
        """Numbers of the elements that match, ascending."""
        if selector not in self._places:
            tag, name, classes = parsed(selector)
            self._places[selector] = [n for n, (t, i, c) in enumerate(self.elements) if (tag is None or t == tag) and (name is None or i == name) and classes <= c]
        return self._places[selector]

    def first(self, selector: str, within: int) -> int | None:
        """The first match inside an element, in order of opening."""
        found = self.places(selector)
        k = bisect_left(found, within + 1)
        return found[k] if k < len(found) and found[k] < self.ends[within] else None

    def text(self, element: int | None) -> str:
        """All text inside of an element, stripped."""
        if element is None:
            return ""
        a = bisect_left(self.texts, element + 1, key=lambda x: x[1])
        b = bisect_left(self.texts, self.ends[element] + 1, key=lambda x: x[1])
        inside = (s for owner, _, s in self.texts[a:b] if element <= owner < self.ends[element])
        return "".join(inside).strip()


def parsed(selector: str) -> tuple[str | None, str | None, frozenset[str]]:
    """(tag, id, classes) of a selector: a tag, .class and #id, or several of these together."""
    m = _SELECTOR.fullmatch(selector.strip())
    if not m:
        raise ValueError(f"not a selector: {selector!r}")
    marks = re.findall(r"[.#][\w-]+", m[2])
    names = [x[1:] for x in marks if x[0] == "#"]
    return m[1], names[-1] if names else None, frozenset(x[1:] for x in marks if x[0] == ".")


def found_messages(html: str, selectors: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(kind, time, sender, content) of each message of a page, in order; kind is text, image, voice or video."""
    page, out = Page(html), []
    for n in page.places(selectors["message"]):
        kind = next((k for k in ("voice", "video", "image") if selectors.get(k) and page.first(selectors[k], n) is not None), "text")
        get = lambda k: page.text(page.first(selectors[k], n))  # noqa: B023, E731
        out.append((kind, get("time"), get("sender"), IMAGE if kind == "image" else get("content")))
    return out


_MESSAGE = "array<struct<kind: string, time: string, sender: string, content: string>>"
_ARROW = pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "time", "sender", "content")]))


def read_chat_pages(pages: DataFrame, selectors: dict[str, str] | None = None) -> DataFrame:
    """Per page of pages (session_id, html): messages, skipped, failed.

    messages: array of (msg_id, sender, is_self, send_time, msg_type, content), numbered from 1. skipped: how many voice and video
    messages were left out, and others without a readable time. failed: true for a page without any match of the message
    selector, most likely of another export; null and empty pages among them. Selectors given replace those of SELECTORS; "" for
    image, voice or video looks for none. Text inside of scripts and styles is not read, and no reference is followed.
    """
    chosen = SELECTORS | (selectors or {})
    if missing := [k for k in REQUIRED if not chosen[k]]:
        raise ValueError(f"no selector for {missing}")
    for x in chosen.values():
        parsed(x)

    @F.arrow_udf(_MESSAGE)
    def found(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in html:
            rows = [found_messages(x or "", chosen) for x in batch.to_pylist()]
            yield pa.array([[dict(zip(("kind", "time", "sender", "content"), m, strict=True)) for m in r] for r in rows], _ARROW)

    held = pages.select("session_id", found(F.col("html").cast("string")).alias("found"))
    timed = held.withColumn("timed", F.transform("found", lambda m: F.struct(m["kind"].alias("kind"), F.when(~m["kind"].isin("voice", "video"), parse_time_ms(m["time"])).alias("send_time"), m["sender"].alias("sender"), m["content"].alias("content"))))
    kept = F.filter("timed", lambda m: m["send_time"].isNotNull())
    count = lambda test: F.size(F.filter("timed", test)).cast("long")
    message = lambda m, i: F.struct(F.concat_ws("-", F.col("session_id").cast("string"), (i + 1).cast("string")).alias("msg_id"), m["sender"].alias("sender"), F.lit(False).alias("is_self"), m["send_time"].alias("send_time"), m["kind"].alias("msg_type"), m["content"].alias("content"))
    skipped = F.struct(count(lambda m: m["kind"] == "voice").alias("voice"), count(lambda m: m["kind"] == "video").alias("video"), count(lambda m: ~m["kind"].isin("voice", "video") & m["send_time"].isNull()).alias("other"))
    return timed.select("session_id", F.transform(kept, message).alias("messages"), skipped.alias("skipped"), (F.size("found") == 0).alias("failed"))
