"""Anchors of captured pages by a tokenizer: quotes of either kind or none, nested tags, character references."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags without an end.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ANCHORS = "array<struct<position:int,href:string,text:string,depth:int,closed:boolean>>"
#: A fixed pattern: where a database's page is, by language, category and slug.
DATABASE_PATH = r"^/(en|tc|sc)/(cases|legis|other)/([a-z0-9_-]+)(?:/|$)"


class _Anchors(HTMLParser):
    def __init__(self, like: re.Pattern[str] | None) -> None:
        super().__init__(convert_charrefs=True)
        self.like = like
        self.found: list[dict] = []
        self.chunks: list[str] | None = None
        self.open: list[str] = []

    def _end(self, closed: bool) -> None:
        if self.chunks is not None:
            self.found[-1] |= {"text": "".join(self.chunks).strip(), "closed": closed}
            self.chunks = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            href = next((value or "" for name, value in attrs if name == "href"), None)
            if self.like is None or (href is not None and self.like.search(href)):
                self._end(False)
                self.found.append({"position": len(self.found), "href": href, "depth": len(self.open)})
                self.chunks = []
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no self-closing tags but the void ones

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self._end(True)
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.chunks is not None:
            self.chunks.append(data)


def page_anchors(html: str | None, like: re.Pattern[str] | None = None) -> list[dict]:
    parser = _Anchors(like)
    parser.feed(html or "")
    parser.close()
    parser._end(False)
    return parser.found


def anchors(html: Column, like: str | None = None) -> Column:
    """The anchors of a page in order: position from 0, href (null if it has none), text up to its end, stripped, depth (elements that
    are open around it) and closed (false: another anchor or the page's end came before its end tag).  With like, only anchors
    whose href matches count; the tags of others are passed over and their text belongs to the anchor around them.  Null and
    empty pages have none."""
    pattern = like and re.compile(like)

    # Row by row: Python is sent 100 rows at a time, where an Arrow batch holds up to 10,000 pages and all their anchors.
    @F.udf(_ANCHORS, useArrow=False)
    def of(page: str | None) -> list[dict]:
        return page_anchors(page, pattern)

    return of(html)


def with_anchors(pages: DataFrame, html: str = "html", like: str | None = None) -> DataFrame:
    """pages without html, with a row for each anchor; pages without any go."""
    keys = [c for c in pages.columns if c != html]
    return pages.select(*keys, F.explode(anchors(F.col(html), like)).alias("_a")).select(*keys, "_a.*")


def database_matrix(pages: DataFrame, html: str = "html") -> DataFrame:
    """(category, slug, langs): which languages each database has, by the anchors of the index pages; languages once, sorted."""
    part = [F.regexp_extract("href", DATABASE_PATH, i) for i in (1, 2, 3)]
    found = with_anchors(pages.select(html), html).where(F.col("href").rlike(DATABASE_PATH)).select(part[0].alias("lang"), part[1].alias("category"), part[2].alias("slug"))
    return found.groupBy("category", "slug").agg(F.sort_array(F.collect_set("lang")).alias("langs"))


#: A fixed pattern: files of decisions.
DECISION_FILE = r"(?i)^files/AAB.*\.pdf$"


def decision_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """Anchors of decisions' files, for ``numbers.decisions``; what never ends is left out."""
    return with_anchors(pages, html, DECISION_FILE).where("closed")
