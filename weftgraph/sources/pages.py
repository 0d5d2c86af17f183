"""HTML pages: main content, text, sections and links, page by page in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "details", "noscript", "head", "template"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "header", "footer", "nav"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Text pieces and headings; from the element with id ``main`` on, once that is found."""

    def __init__(self, main: str):
        super().__init__(convert_charrefs=True)
        self.main, self.skip, self.depth, self.inside = main, 0, 0, False
        self.out: list[tuple[str, str, str]] = []  # (what, id, text)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.out.append(("text", "", "\n"))
            return
        own = dict(attrs).get("id") or ""
        if own == self.main and not self.inside:
            self.inside, self.depth, self.out = True, 0, []
        elif self.inside:
            self.depth += 1
        if tag in SKIPPED:
            self.skip += 1
        elif tag in ("h1", "h2"):
            self.out.append(("open", own, ""))
        elif tag in BLOCKS:
            self.out.append(("text", "", "\n"))

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("h1", "h2"):
            self.out.append(("close", "", ""))
        elif tag in BLOCKS:
            self.out.append(("text", "", "\n"))
        if self.inside:
            self.depth -= 1
            if self.depth < 0:
                self.out.append(("end", "", ""))
                self.inside, self.main = False, "\0"

    def handle_data(self, data):
        if not self.skip:
            self.out.append(("text", "", data))


def _pieces(html: str, main: str) -> list[tuple[str, str, str]]:
    r = _Reader(main)
    r.feed(html or "")
    r.close()
    ends = [i for i, x in enumerate(r.out) if x[0] == "end"]
    return r.out[: ends[0]] if ends else r.out


def _tidy(text: str) -> str:
    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def text_of(html: str, main: str = "main-content") -> str:
    return _tidy("".join(x[2] if x[0] == "text" else "\n" for x in _pieces(html, main)))


def sections_of(html: str, slug: str, main: str = "main-content") -> list[tuple[str, str, str]]:
    """(section id, title, text): an introduction, then one for each h1 or h2."""
    out, sid, title, held, heading = [], f"{slug}#intro", "", [], False
    for what, own, text in _pieces(html, main):
        if what == "open":
            out.append((sid, title, _tidy("".join(held))))
            sid, title, held, heading = own, "", [], True
        elif what == "close":
            heading = False
            title = title.strip()
            sid = f"{slug}#{sid or re.sub(r'[^a-z0-9]+', '-', title.lower()).strip('-')}"
        elif heading:
            title += text
        else:
            held.append(text)
    out.append((sid, title, _tidy("".join(held))))
    return [x for x in out if x[1] or x[2]]


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text."""

    def work(frames):
        for f in frames:
            yield f.assign(text=[text_of(h) for h in f["html"]])[["page_id", "url", "text"]]

    return pages.select("page_id", "url", "html").mapInPandas(work, "page_id long, url string, text string")


def page_sections(pages: DataFrame) -> DataFrame:
    """page_id, ord, section_id, title, content and url."""

    def work(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, n, *s, u) for p, u, h in zip(f["page_id"], f["url"], f["html"], strict=True) for n, s in enumerate(sections_of(h, (u or "").rstrip("/").rpartition("/")[2]))]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "section_id", "title", "content", "url"])

    return pages.select("page_id", "url", "html").mapInPandas(work, "page_id long, ord int, section_id string, title string, content string, url string")


def links(html: Column) -> Column:
    """Distinct targets of links, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"#]+)'), F.lit(1)))


def embedded_json(markdown: Column) -> Column:
    """JSON in fenced blocks of Markdown, in order."""
    return F.regexp_extract_all(markdown, F.lit(r"(?s)```json\s*\n(.*?)\n```"), F.lit(1))
