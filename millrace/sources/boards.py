"""Listing pages of boards without a schema: cards by configured selectors, and detail pages.

Selectors are lists (parted by commas) of compounds (``tag``, ``.class``, ``#id``, together)
parted by spaces, the last of which is the element that is meant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import quote_plus, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import infer_category, parse_date, parse_salary
from ..functions.text import clean_ws
from .landed import posting, register

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
JUNK = frozenset("script style nav footer header".split())
BLOCKS = ("tr", "div", "li")
MOST_BLURB, MOST_DETAIL = 400, 12_000
PAGES_AT_ONCE = 256  # detail pages read to texts before they are handed on


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    up: Node | None = None
    parts: list[Node | str] = field(default_factory=list)

    def all(self) -> Iterator[Node]:
        """The elements below, in page order."""
        stack = [p for p in reversed(self.parts) if isinstance(p, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [p for p in reversed(n.parts) if isinstance(p, Node)]

    def text(self, without: frozenset[str] = frozenset(), sep: str = " ") -> str:
        out, stack = [], [*reversed(self.parts)]
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                out.append(p)
            elif p.tag not in without:
                stack += reversed(p.parts)
        return sep.join(x for x in (" ".join(o.split()) for o in out) if x)

    def above(self) -> Iterator[Node]:
        n = self.up
        while n is not None:
            yield n
            n = n.up


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.parts.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        for n in [self.at, *self.at.above()]:
            if n.tag == tag and n.up is not None:
                self.at = n.up
                return

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def tree(page: str | None) -> Node:
    t = _Tree()
    t.feed(page or "")
    t.close()
    return t.root


def _fits(n: Node, compound: str) -> bool:
    tag = re.match(r"[\w-]*", compound)[0]
    classes = n.attrs.get("class", "").split()
    signs = re.findall(r"([.#])([\w-]+)", compound)
    return (not tag or n.tag == tag) and all(v in classes if s == "." else n.attrs.get("id") == v for s, v in signs)


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that a selector means, in page order."""
    ways = [s.split() for s in selector.split(",") if s.strip()]

    def meant(n: Node) -> bool:
        for way in ways:
            if _fits(n, way[-1]):
                wanted = way[-2::-1]
                for a in n.above():
                    if wanted and _fits(a, wanted[0]):
                        wanted = wanted[1:]
                if not wanted:
                    return True
        return False

    return [n for n in root.all() if meant(n)]


def read_cards(page: str | None, base: str, selectors: dict[str, str]) -> list[dict[str, str]]:
    """Cards of a page (link, title, company, location, deadline, blurb), the first of each link.

    Without a card by the selectors, blocks around anchors whose link holds ``link_contains``."""
    root = tree(page)
    found = select(root, selectors["card"])
    if not found:
        marked = [a for a in root.all() if a.tag == "a" and selectors["link_contains"] in a.attrs.get("href", "").lower()]
        found = [next((b for b in a.above() if b.tag in BLOCKS), a) for a in marked]
    out: dict[str, dict[str, str]] = {}
    for card in found:
        own = [card, *card.all()]
        a = next(iter(select(card, selectors["title"])), None) or next((n for n in own if n.tag == "a" and "href" in n.attrs), None)
        if a is None or not a.attrs.get("href"):
            continue
        link, title = urljoin(base, a.attrs["href"].strip()), a.text()
        first = out.setdefault(link, {})
        if first or len(title) < 3:
            continue
        pick = lambda k: next((n.text() for n in select(card, selectors.get(k, ""))), "")  # noqa: B023, E731
        first |= {"link": link, "title": title, "blurb": card.text()[:MOST_BLURB]} | {k: pick(k) for k in ("company", "location", "deadline")}
    return [c for c in out.values() if c]


def detail_text(page: str | None, main: str) -> str:
    """Text of a detail page's main part, without scripts and the parts around it."""
    root = tree(page)
    body = next(iter(select(root, main)), None) or next((n for n in root.all() if n.tag == "main"), None) or next((n for n in root.all() if n.tag == "body"), root)
    return body.text(JUNK, "\n")


def search_urls(template: str, queries: list[str], pages: int = 1) -> list[str]:
    """The pages to fetch: every query, encoded, and page number in a template."""
    return [template.replace("{query}", quote_plus(q)).replace("{page}", str(p)) for q in queries for p in range(1, pages + 1)]


def joined_url(base: Column, href: Column) -> Column:
    """A link made absolute by its page; blank where it is none of http."""

    @F.pandas_udf("string")
    def join(b, h):  # one Arrow batch at a time
        full = [urljoin(x or "", (y or "").strip()) if y and y.strip() else "" for x, y in zip(b, h, strict=True)]
        return b.__class__([u if u.startswith(("http://", "https://")) else "" for u in full])

    return join(base, href)


@register("board")
def board(payloads: DataFrame, as_of: Column, selectors: dict[str, str], label: str = "Board") -> DataFrame:
    """(url, body) of search pages -> postings by selectors (card, title, company, location,
    deadline, link_contains)."""
    names = ["link", "title", "company", "location", "deadline", "blurb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [c for url, body in zip(batch.column("url").to_pylist(), batch.column("body").to_pylist(), strict=True) for c in read_cards(body, url or "", selectors)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in names], names)

    r = payloads.select("url", "body").mapInArrow(run, ", ".join(f"{c} string" for c in names)).withColumn("pay", parse_salary(F.col("blurb")))
    named = lambda c, otherwise: F.coalesce(F.nullif(clean_ws(F.col(c)), F.lit("")), F.lit(otherwise))
    return posting(r, "board", as_of, title=clean_ws(F.col("title")), company=named("company", "Unknown company"), description=F.col("blurb"), location=named("location", "Dhaka, Bangladesh"), url=F.col("link"), source=F.lit(label), category=infer_category(F.col("title"), F.col("blurb")), deadline=parse_date(F.col("deadline"), as_of), salaryMin=F.col("pay.lo"), salaryMax=F.col("pay.hi"), salaryText=F.col("pay.text"))


def with_details(postings: DataFrame, details: DataFrame, main: str, most: int | None = None, most_chars: int | None = MOST_DETAIL) -> DataFrame:
    """Postings with the text of their landed detail pages (url, body), where it says more: a longer
    description, pay where none is known, and the category read again.  ``most``: so many postings, in
    the order of their urls, are enriched (the original fetches so many pages a run); ``most_chars``: so much
    of a text is taken (the original's bound; None: all of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                b = batch.slice(at, PAGES_AT_ONCE)
                yield pa.RecordBatch.from_arrays([b.column("url"), pa.array([detail_text(x, main) for x in b.column("body").to_pylist()], pa.string())], ["_url", "_text"])

    # whole texts: their plan looks small, so the join is told not to broadcast, and the parts not to be merged
    tasks = int(details.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = details.select("url", "body").mapInArrow(run, "_url string, _text string").repartition(tasks, "_url").dropDuplicates(["_url"]).hint("merge")
    if most is not None:
        pages = pages.join(postings.select("url").distinct().orderBy("url").limit(most), F.col("_url") == F.col("url"), "left_semi")
    d = postings.join(pages, F.col("url") == F.col("_url"), "left").withColumn("_pay", F.when(F.col("salaryMin").isNull(), parse_salary(F.col("_text"))))
    more = F.coalesce(F.length("_text") > F.length("description"), F.lit(False))
    paid = F.col("salaryMin").isNull() & F.col("_pay.lo").isNotNull()
    d = d.withColumns({"description": F.when(more, F.substring("_text", 1, most_chars) if most_chars else F.col("_text")).otherwise(F.col("description")), **{c: F.when(paid, F.col(f"_pay.{k}")).otherwise(F.col(c)) for c, k in (("salaryMin", "lo"), ("salaryMax", "hi"), ("salaryText", "text"))}})
    category = F.when(F.col("_text").isNotNull(), infer_category(F.col("title"), F.col("description"))).otherwise(F.col("category"))
    return d.withColumn("category", category).select(*postings.columns)


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of landed pages: JSON rows that a fetcher wrote."""
    return spark.read.schema("url string, body string").json(path)
