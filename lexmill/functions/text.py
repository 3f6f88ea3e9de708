"""Text functions over captured payloads: native columns, and Arrow UDFs where Python alone has the semantics."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tags that stand on lines of their own, and tags whose content is dropped.
BLOCK_TAGS = frozenset("p div br tr li h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tfoot td th".split())
DROPPED_TAGS = frozenset(("script", "style"))
#: First bytes of documents.
MAGIC = {b"PK\x03\x04": ".docx", b"\xd0\xcf\x11\xe0": ".doc", b"\xdb\xa5\x2d\x00": ".doc", b"{\\rt": ".rtf"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in DROPPED_TAGS
        if tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in DROPPED_TAGS and self.hidden > 0
        if tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def plain_text(html: str | None) -> str | None:
    """Visible text of a page, one stripped line for each block, without blank lines; null stays null."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    lines = (line.strip() for line in "".join(parser.parts).splitlines())
    return "\n".join(line for line in lines if line)


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(plain_text)


def folded(citation: str | None) -> str | None:
    """A citation without its leading year in brackets, in NFKC, with single spaces, in lower case; null stays null."""
    if citation is None:
        return None
    citation = re.sub(r"^\[\d{4}\]\s*", "", citation)
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", citation)).strip().lower()


@F.pandas_udf(StringType())
def citation_fold(citation: pd.Series) -> pd.Series:
    return citation.map(folded)


def error_class(error: Column) -> Column:
    """What stands before the first of ``: ; ,``, stripped, at most 60 characters."""
    return F.substring(F.trim(F.get(F.split(error, "[:;,]", 2), 0)), 1, 60)


def signature(text: Column) -> Column:
    """Runs of other characters than letters, digits, ``._-`` become ``_``; no ``._`` at the ends; 120 characters; ``sample`` if empty."""
    clean = F.substring(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("._")), 1, 120)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("sample"))


def document_extension(body: Column) -> Column:
    """Extension by the first four bytes; null for others."""
    head = F.substring(body, 1, 4)
    return F.coalesce(*(F.when(head == F.lit(magic), extension) for magic, extension in MAGIC.items()))


def alpha_suffix(cap: Column) -> Column:
    return cap.rlike(r"(?i)^\d+[A-Z]+$")
