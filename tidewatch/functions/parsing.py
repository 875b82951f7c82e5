"""Small HTML readers for list and post pages, run where the pages lie."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never have an end tag.
_VOID = {"br", "hr", "img", "input", "link", "meta"}


class _Page(HTMLParser):
    """Title, headings, links, and the text outside scripts, styles and navigation."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.title: list[str] = []
        self.headings: list[str] = []
        self.links: list[str] = []
        self.text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag not in _VOID:
            self.stack.append(tag)
            if tag in ("h1", "h2", "h3"):
                self.headings.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        inside = set(self.stack)
        if inside & {"script", "style"}:
            return
        if "title" in inside:
            self.title.append(data)
        elif self.headings and inside & {"h1", "h2", "h3"}:
            self.headings[-1] += data
        elif "nav" not in inside and data.strip():
            self.text.append(" ".join(data.split()))


class _Post(HTMLParser):
    """A forum post page: meta values by name, the body before the signature, and comment lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.meta: list[list[str]] = []
        self.body: list[str] = []
        self.comments: list[dict[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        kind = dict(attrs).get("class") or ""
        if tag in _VOID:
            return
        self.open.append((tag, kind))
        if "article-meta-tag" in kind:
            self.meta.append(["", ""])
        elif kind.split()[:1] == ["push"]:
            self.comments.append({"tag": "", "user": "", "content": "", "time": ""})

    def handle_endtag(self, tag: str) -> None:
        while any(t == tag for t, _ in self.open):
            if self.open.pop()[0] == tag:
                break

    def handle_data(self, data: str) -> None:
        kinds = " ".join(k for _, k in self.open)
        for name, part in (("push-tag", "tag"), ("push-userid", "user"), ("push-content", "content"), ("push-ipdatetime", "time")):
            if name in kinds and self.comments:
                self.comments[-1][part] += data
                return
        if "article-meta-tag" in kinds:
            self.meta[-1][0] += data
        elif "article-meta-value" in kinds and self.meta:
            self.meta[-1][1] += data
        elif "main-content" in kinds and "push" not in kinds:
            self.body.append(data)


#: The marks of a push and a boo; any other mark is an arrow.
MARKS = {"推": "push", "噓": "boo"}


def read_post(html: str | None) -> dict:
    """Author, title, body and numbered comments of a post page; empty for a page without a post."""
    page = _Post()
    page.feed(html or "")
    meta = {k.strip(): v.strip() for k, v in page.meta}
    body = "".join(page.body).split("\n--\n")[0].strip()
    comments = [
        (i, MARKS.get(c["tag"].strip(), "arrow"), c["user"].strip(), c["content"].removeprefix(":").strip(), c["time"].strip())
        for i, c in enumerate(page.comments, 1)
    ]
    return {"author": meta.get("作者", "").split(" (")[0] or None, "title": meta.get("標題"), "time": meta.get("時間"), "body": body, "comments": comments}


class _List(HTMLParser):
    """A list page: entries above the line that parts the pinned ones, and the link to the page before."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.found = self.closed = False
        self.entries: list[dict[str, str | None]] = []
        self.before: str | None = None
        self.link: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        kinds = (given.get("class") or "").split()
        if tag in _VOID:
            return
        self.open.append((tag, kinds[0] if kinds else ""))
        self.found |= "r-list-container" in kinds
        self.closed |= "r-list-sep" in kinds
        if "r-ent" in kinds and not self.closed:
            self.entries.append({"url": None, "title": "", "author": "", "push": ""})
        if tag == "a":
            self.link = given.get("href")
            if self.entries and not self.closed and any(k == "title" for _, k in self.open):
                self.entries[-1]["url"] = self.link

    def handle_endtag(self, tag: str) -> None:
        while any(t == tag for t, _ in self.open):
            if self.open.pop()[0] == tag:
                break

    def handle_data(self, data: str) -> None:
        kinds = [k for _, k in self.open]
        if self.entries and not self.closed:
            for kind, part in (("nrec", "push"), ("title", "title"), ("author", "author")):
                if kind in kinds:
                    self.entries[-1][part] += data
        if "btn-group" in kinds and "上頁" in data:
            self.before = self.link


def read_list(html: str | None) -> dict | None:
    """Entries (url, title, author, push text) and the previous page's link; null if it isn't a list page."""
    page = _List()
    page.feed(html or "")
    if not page.found:
        return None
    rows = [(e["url"], e["title"].strip(), None if e["author"].strip() in ("", "-") else e["author"].strip(), e["push"].strip(), e["url"] is None) for e in page.entries]
    return {"entries": rows, "before": page.before}


def parse_lists(pages: DataFrame) -> DataFrame:
    """List entries from ``pages(page_id, html)``; a page that isn't a list gives one row with a null list."""

    def run(it):
        for pdf in it:
            rows = [{"page_id": k, **(read_list(h) or {"entries": None, "before": None})} for k, h in zip(pdf["page_id"], pdf["html"])]
            yield pd.DataFrame(rows, columns=["page_id", "entries", "before"])

    return pages.select("page_id", "html").mapInPandas(
        run, "page_id long, entries array<struct<url: string, title: string, author: string, push: string, is_deleted: boolean>>, before string"
    )


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Title, first heading, number of links and text of each page; null pages give empty values."""

    def run(it):
        for pdf in it:
            rows = []
            for key, html in zip(pdf["page_id"], pdf["html"]):
                p = _Page()
                p.feed(html or "")
                rows.append((key, "".join(p.title).strip(), (p.headings or [""])[0].strip(), len(p.links), "\n".join(p.text)))
            yield pd.DataFrame(rows, columns=["page_id", "title", "heading", "n_links", "body"])

    picked = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return picked.mapInPandas(run, "page_id long, title string, heading string, n_links long, body string")


def parse_posts(pages: DataFrame) -> DataFrame:
    """Posts with their comments from ``pages(page_id, html)`` of a forum's layout."""

    def run(it):
        for pdf in it:
            rows = [{"page_id": k, **read_post(h)} for k, h in zip(pdf["page_id"], pdf["html"])]
            yield pd.DataFrame(rows, columns=["page_id", "author", "title", "time", "body", "comments"])

    return pages.select("page_id", "html").mapInPandas(
        run,
        "page_id long, author string, title string, time string, body string, "
        "comments array<struct<floor: int, type: string, author: string, content: string, time: string>>",
    )
