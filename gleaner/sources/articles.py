"""Articles from the HTML of three kinds of page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.notes import first_date
from gleaner.functions.text import trimmed

#: Where each kind of page has its parts; the first that is there counts. #x is an id, .x a class, x an element.
PLACES = {
    "wechat_article": {"title": ["#activity-name"], "author": ["#js_name"], "date": ["#publish_time"], "root": ["#js_content"], "image": ["data-src", "src"]},
    "zhihu_article": {"title": [".Post-Title", "h1"], "author": [".AuthorInfo-name", ".UserLink-link"], "date": [".ContentItem-time"], "root": [".Post-RichTextContainer"], "image": ["data-original", "src"]},
    "csdn_article": {"title": ["#articleContentId", ".title-article", "h1"], "author": [".follow-nickName", ".blog-top-user-name"], "date": [".time"], "root": ["#content_views"], "image": ["data-src", "src"]},
}
#: Fixed value: elements without an end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Parts(HTMLParser):
    """The first element of each selector with its text and link, and the images of the first root."""

    def __init__(self, wanted: list[str], roots: list[str], image: list[str]):
        super().__init__()
        self.wanted, self.roots, self.image = [*wanted, *roots, "body"], [*roots, "body"], image
        self.open: list[tuple[str, list[str]]] = []
        self.text: dict[str, list[str]] = {}
        self.link: dict[str, str] = {}
        self.images: dict[str, list[str]] = {r: [] for r in self.roots}
        self.url = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("property") == "og:url":
            self.url = self.url or (a.get("content") or "").strip()
        names = {tag, f"#{a.get('id') or ''}", *(f".{c}" for c in (a.get("class") or "").split())}
        new = [w for w in self.wanted if w in names and w not in self.text]
        for w in new:
            self.text[w], self.link[w] = [], (a.get("href") or "").strip()
        if tag == "img":
            link = next((v.strip() for k in self.image if (v := a.get(k)) and v.strip()), "")
            for r in self.roots:
                if link and any(r in own for _, own in self.open):
                    self.images[r].append(link)
        if tag not in VOID:
            self.open.append((tag, new))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        for _, own in self.open:
            for w in own:
                self.text[w].append(data)

    def first(self, selectors: list[str]) -> tuple[str, str]:
        for s in selectors:
            if s in self.text:
                return "".join(self.text[s]).strip(), self.link[s]
        return "", ""


def articles(pages: DataFrame) -> DataFrame:
    """(page_id, source_type, canonical_url, title, author, author_link, date, content, images) of pages (page_id, url, source_type, html) whose kind is known; missing parts are empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, url, kind, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "source_type", "html")), strict=True):
                at = PLACES[kind]
                p = Parts([s for k in ("title", "author", "date") for s in at[k]], at["root"], at["image"])
                p.feed(html or "")
                p.close()
                root = next((r for r in p.roots if r in p.text), None)
                author, link = p.first(at["author"])
                rows.append({
                    "page_id": i, "source_type": kind, "canonical_url": (p.url if kind == "wechat_article" else "") or (url or "").strip(), "title": p.first(at["title"])[0], "author": author, "author_link": link,
                    "date": p.first(at["date"])[0], "content": "".join(p.text[root]).strip() if root else "", "images": p.images[root] if root else [],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    texts = ("source_type", "canonical_url", "title", "author", "author_link", "date", "content")
    arrow = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in texts), ("images", pa.list_(pa.string()))])
    known = pages.where(F.col("source_type").isin(*PLACES)).select("page_id", "url", "source_type", "html")
    found = known.mapInArrow(run, ", ".join(["page_id long", *(f"{c} string" for c in texts), "images array<string>"]))
    absolute = F.when((F.col("source_type") != "zhihu_article") | (F.col("author_link") == "") | F.col("author_link").rlike("(?i)^https?://"), F.col("author_link")).otherwise(F.concat(F.lit("https://www.zhihu.com/"), F.ltrim("author_link", F.lit("/"))))
    return found.withColumns({"date": F.when(F.col("source_type") == "wechat_article", trimmed("date")).otherwise(first_date("date")), "author_link": absolute})
