"""Extraction from HTML by two engines.

``regex`` is a set of column expressions and stays in the JVM. ``parser`` uses the standard
library's HTML parser in Arrow batches, for pages whose markup the expressions can't follow:
comments, scripts that contain tags, unquoted oddities. Engines are looked up by name; ``register``
adds one. Malformed or null pages give empty results, never an error.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHOR = r"(?is)<a\s[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANG = r"(?is)<[a-z][^>]*\slang\s*=\s*[\"']([^\"'>]*)[\"']"
CODE = r"(?is)<code\b([^>]*)>(.*?)</code"
ATTRIBUTE = r"([A-Za-z_:][A-Za-z0-9_:.-]*)\s*=\s*[\"']([^\"']*)[\"']"
MATH = r"(?is)<math\b[^>]*>(.*?)</math"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script"
HIDDEN = (r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>")
TAG = r"<[^>]*>"
LATEX = (r"\$\$[^$]+\$\$|\$[^$]+\$", r"(?s)\\\[.*?\\\]", r"(?s)\\\(.*?\\\)")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def attribute_pattern(name: str) -> str:
    return rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; '' if absent."""
    p = attribute_pattern(name)
    return F.concat(*(F.regexp_extract(tag, p, i) for i in (1, 2, 3)))


def links(html: Column) -> Column:
    """href of each anchor that has one, in order, without those whose rel contains nofollow."""
    has = lambda t: t.rlike(attribute_pattern("href")) & ~attribute(t, "rel").contains("nofollow")
    return F.transform(F.filter(_all(F.coalesce(html, F.lit("")), ANCHOR, 0), has), lambda t: attribute(t, "href"))


def strip_tags(text: Column) -> Column:
    out = F.regexp_replace(text, TAG, " ")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\n\x0B\f\r]+", " "))


def text(html: Column) -> Column:
    """Visible text: no comments, scripts and styles; tags are spaces; runs of white space are one."""
    out = F.coalesce(html, F.lit(""))
    for pattern in HIDDEN:
        out = F.regexp_replace(out, pattern, " ")
    return strip_tags(out)


def title(html: Column) -> Column:
    """The title's text, null if there is none."""
    return F.when(html.rlike(TITLE), strip_tags(F.regexp_extract(html, TITLE, 1)))


def lang_attributes(html: Column) -> Column:
    return _all(F.coalesce(html, F.lit("")), LANG, 1)


def code(html: Column) -> Column:
    """Code blocks: text and attributes as pairs, in order."""
    page = F.coalesce(html, F.lit(""))
    pair = lambda a: F.transform(F.arrays_zip(_all(a, ATTRIBUTE, 1).alias("k"), _all(a, ATTRIBUTE, 2).alias("v")), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    both = F.zip_with(_all(page, CODE, 1), _all(page, CODE, 2), lambda a, c: F.struct(strip_tags(c).alias("code"), pair(a).alias("lang_info")))
    return both


def latex(text_: Column) -> Column:
    """$...$ and $$...$$, then \\[...\\], then \\(...\\), in this order."""
    return F.concat(*(_all(F.coalesce(text_, F.lit("")), p, 0) for p in LATEX))


def mathjax(html: Column) -> Column:
    """Whether a script names MathJax, by source or in its body."""
    return F.exists(_all(F.coalesce(html, F.lit("")), SCRIPT, 0), lambda s: F.lower(s).contains("mathjax"))


def math(html: Column, only_with_mathjax: bool = False) -> Column:
    """Text of math elements; without any, LaTeX in the page's text (on demand only if it loads MathJax)."""
    elements = F.transform(_all(F.coalesce(html, F.lit("")), MATH, 1), strip_tags)
    found = latex(text(html))
    if only_with_mathjax:
        found = F.when(mathjax(html), found).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(elements) > 0, elements).otherwise(found)


# ---------------------------------------------------------------- the parser engine

class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[str] = []
        self.words: list[str] = []
        self.heading: list[str] | None = None
        self.title: str | None = None
        self.langs: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = dict(reversed(attrs))
        if tag == "a" and found.get("href") is not None and "nofollow" not in (found.get("rel") or ""):
            self.links.append(found["href"])
        if found.get("lang"):
            self.langs.append(found["lang"])
        if tag == "title" and self.title is None:
            self.heading = []
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.heading is not None:
            self.title, self.heading = " ".join("".join(self.heading).split()), None
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data: str) -> None:
        if self.heading is not None:
            self.heading.append(data)
        if not self.hidden:
            self.words.append(data)


def _parsed(html: str | None) -> _Page:
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except Exception:  # noqa: BLE001  a page that can't be read has what was read so far
        pass
    return page


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parser_links(html: pd.Series) -> pd.Series:
    return html.map(lambda x: _parsed(x).links)


@F.pandas_udf(T.StringType())
def _parser_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: " ".join(" ".join(_parsed(x).words).split()))


@F.pandas_udf(T.StringType())
def _parser_title(html: pd.Series) -> pd.Series:
    return html.map(lambda x: _parsed(x).title)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parser_langs(html: pd.Series) -> pd.Series:
    return html.map(lambda x: _parsed(x).langs)


_ENGINES: dict[str, dict[str, Callable[[Column], Column]]] = {
    "regex": {"links": links, "text": text, "title": title, "lang_attributes": lang_attributes, "code": code, "math": math},
    "parser": {"links": _parser_links, "text": _parser_text, "title": _parser_title, "lang_attributes": _parser_langs, "code": code, "math": math},
}


def register(engine: str, functions: dict[str, Callable[[Column], Column]]) -> None:
    _ENGINES[engine] = functions


def extract(engine: str, what: str, html: Column) -> Column:
    """Applies an engine's function; an unknown engine or function raises ValueError."""
    if what not in _ENGINES.get(engine, {}):
        raise ValueError(f"no extraction {what!r} by engine {engine!r}")
    return _ENGINES[engine][what](html)
