"""Web pages to titles and text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_HIDDEN = {"script", "style", "noscript"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.hidden, self.in_title = 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in _HIDDEN
        self.in_title |= tag == "title"

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))
        self.in_title &= tag != "title"

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.in_title:
                self.title.append(data)


def read_html(html: str) -> tuple[str, str]:
    """(title, text): visible strings joined by line feeds."""
    p = _Text()
    p.feed(html)
    p.close()
    return "".join(p.title).strip(), "\n".join(p.parts)


def pages_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, content) of every page; null pages have neither."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [read_html(h.as_py() or "") for h in x["html"]]
            yield pa.RecordBatch.from_arrays([x["page_id"], x["url"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["page_id", "url", "title", "content"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(parse, "page_id long, url string, title string, content string")
