"""The library from SQL text: scalar functions and table functions of a session.

:func:`register` makes scalar functions by ``CREATE TEMPORARY FUNCTION`` (their bodies are SQL, so the
optimiser sees through them) and Python table functions for lateral joins::

    SELECT p.page_id, a.href FROM pages p, LATERAL page_anchors(p.html) a

Table functions read one document at a time with a parser of the standard library and give a row
for each thing found; null documents give none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from email import message_from_string, policy
from html.parser import HTMLParser

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .functions import fixed, text


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lookup(table: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in table.items()) + ")"


def scalar_functions() -> dict[str, str]:
    """name -> parameters, type and body."""
    marks = ", ".join(_quoted(x) for x in text.accent_table())
    bare = f"regexp_replace(translate(lower(coalesce(x, '')), {marks}), '[\\\\u0300-\\\\u036f]', '')"
    return {
        "mr_slug": f"(x STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace({bare}, '[^a-z0-9+#./ ]', ' '), ' +', ' '))",
        "mr_clean": r"(x STRING) RETURNS STRING RETURN trim(regexp_replace(coalesce(x, ''), '\\s+', ' '))",
        "mr_words": "(x STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(coalesce(x, '')), '[a-z0-9+#]+', 0)",
        "mr_expand": f"(x STRING) RETURNS STRING RETURN array_join(transform(split(mr_slug(x), ' '), w -> coalesce(try_element_at({_lookup(fixed.ABBREVIATIONS)}, w), w)), ' ')",
        "mr_jaccard": "(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0 ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
        "mr_host": r"(x STRING) RETURNS STRING RETURN lower(regexp_extract(coalesce(x, ''), '://([^/?#]*)', 1))",
        "mr_first_email": r"(x STRING) RETURNS STRING RETURN regexp_extract(coalesce(x, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', 0)",
        "mr_fingerprint": "(company STRING, title STRING, area STRING) RETURNS STRING RETURN substring(sha1(concat_ws('|', company, title, coalesce(nullif(area, ''), 'unknown'))), 1, 16)",
        "mr_priority_rank": "(p STRING) RETURNS INT RETURN CASE p WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END",
        "mr_km": f"(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN round({2 * fixed.EARTH_KM} * asin(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))), 1)",
    }


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str]]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.handle_endtag(tag)
            href = dict(attrs).get("href")
            if href:
                self.found.append((href, []))
                self.open = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open:
            self.found[-1][1].append(data)


@udtf(returnType="pos int, href string, label string")
class PageAnchors:
    """Links of a page in order, with what they say."""

    def eval(self, html: str) -> Iterator[tuple[int, str, str]]:
        if html is not None:
            p = _Anchors()
            p.feed(html)
            p.close()
            for i, (href, said) in enumerate(p.found):
                yield i, href, " ".join("".join(said).split())


def _flat(node) -> Iterator[dict]:
    if isinstance(node, list):
        for x in node:
            yield from _flat(x)
    elif isinstance(node, dict):
        yield node
        for inside in ("@graph", "itemListElement", "item"):
            if inside in node:
                yield from _flat(node[inside])


@udtf(returnType="pos int, type string, title string, body string")
class JsonLd:
    """Objects of a page's JSON-LD blocks, those in lists and graphs too; broken blocks are passed over."""

    def eval(self, html: str) -> Iterator[tuple[int, str, str, str]]:
        pos = 0
        for block in re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html or ""):
            try:
                found = list(_flat(json.loads(block)))
            except ValueError:
                continue
            for x in found:
                kind = x.get("@type")
                yield pos, kind if isinstance(kind, str) else ",".join(map(str, kind or [])), x.get("title") or x.get("name"), json.dumps(x, ensure_ascii=False)
                pos += 1


@udtf(returnType="pos int, subject string, href string")
class MailLinks:
    """Links in the bodies of a mail (plain and markup), each once, with the subject."""

    def eval(self, raw: str) -> Iterator[tuple[int, str, str]]:
        if raw is None:
            return
        mail = message_from_string(raw, policy=policy.default)
        seen: dict[str, None] = {}
        for part in mail.walk():
            if part.get_content_maintype() == "text":
                seen |= dict.fromkeys(re.findall(r"https?://[^\s\"'<>)]+", part.get_content()))
        for i, href in enumerate(seen):
            yield i, str(mail["subject"] or ""), href


TABLE_FUNCTIONS = {"page_anchors": PageAnchors, "json_ld": JsonLd, "mail_links": MailLinks}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session (again, where they are)."""
    for name, body in scalar_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    for name, table in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, table)
