"""Column functions on text: cleaning, canonical names, tokens.  All are built-in expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache, partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

BLOCK_END = r"(?i)<br\s*/?>|</p>|</li>|</div>|</tr>"
#: The entities decoded without a UDF; ``&amp;`` comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


@lru_cache(1)
def accent_table() -> tuple[str, str]:
    """Latin letters with marks, and the plain letters NFKD leaves of them."""
    marked, plain = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        parts = [p for p in unicodedata.normalize("NFKD", c) if not unicodedata.combining(p)]
        if len(parts) == 1 and parts[0] != c and parts[0].isascii():
            marked.append(c)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, where an expression needs it often."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def by_arrow(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of texts, run in Arrow batches: for what built-in functions cannot say.  Null stays null."""

    def use(c: Column) -> Column:
        @F.pandas_udf("string")
        def run(s):
            return s.map(function, na_action="ignore")

        return run(c)

    return use


def nfkc(c: Column) -> Column:
    """Compatibility forms composed, as Unicode has them."""
    return by_arrow(partial(unicodedata.normalize, "NFKC"))(c)


def unescape_all(c: Column) -> Column:
    """Every named and numeric entity decoded."""
    return by_arrow(html.unescape)(c)


def _unmarked(s: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))


def strip_all_accents(c: Column) -> Column:
    """Letters of any script without marks (NFKD)."""
    return by_arrow(_unmarked)(c)


def clean_ws(c: Column, full: bool = False) -> Column:
    """White space collapsed in each line; blank lines go.  ``full``: after NFKC."""
    c = nfkc(text_or_empty(c)) if full else c
    lines = F.transform(F.split(text_or_empty(c), "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def unescape(c: Column) -> Column:
    """Common named entities; others stay (:func:`unescape_all` decodes every one)."""
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_html(c: Column, full: bool = False) -> Column:
    """Text of markup: scripts and styles go, ends of blocks are line breaks, other tags spaces.
    ``full``: every entity decoded and NFKC, in Arrow batches; else the common ones, built in."""
    c = F.regexp_replace(text_or_empty(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, BLOCK_END, "\n")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return clean_ws(unescape_all(c), True) if full else clean_ws(unescape(c))


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *accent_table()), "[̀-ͯ]", "")


def slug(c: Column, full: bool = False) -> Column:
    """Lower case without marks (``full``: of any script); only ``a-z 0-9 + # . /`` and single spaces."""
    low = F.lower(text_or_empty(c))
    # marks are taken off letter by letter, so only where there may be any
    bare = strip_all_accents(low) if full else F.when(low.rlike(r"[^\x00-\x7F]"), strip_accents(low)).otherwise(low)
    return F.trim(F.regexp_replace(bare, "[^a-z0-9+#./]+", " "))


@lru_cache(1)
def _bare_table() -> dict[str, str]:
    return dict(zip(*accent_table(), strict=True)) | dict.fromkeys(map(chr, range(0x300, 0x370)), "")


def slug_words(low: str, longer_than: int = 2) -> list[bytes]:
    """The words of a text's slug over a length, in Python; the text is in lower case."""
    bare = low if low.isascii() else re.sub("[^\x00-\x7f]", lambda m: _bare_table().get(m[0], " "), low)
    return re.findall(rb"[a-z0-9+#./]{%d,}" % (longer_than + 1), bare.encode("ascii", "replace"))


def lookup(table: dict[str, str], c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def expand_abbreviations(c: Column, table: dict[str, str] = fixed.ABBREVIATIONS) -> Column:
    """Token by token, on the slug."""
    return F.array_join(F.transform(F.split(slug(c), " "), lambda w: lookup(table, w)), " ")


def without_words(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, rf"(?i)\b({pattern})\b", " ")


def normalize_company(c: Column) -> Column:
    """Name without brackets, legal forms and trade words; the slug where nothing remains."""
    s = slug(F.regexp_replace(text_or_empty(c), r"\(.*?\)", " "))
    s = F.regexp_replace(s, r"\b([a-z])\.\s*(?=[a-z]\.)", "$1")
    s = without_words(F.translate(s, "./", "  "), fixed.COMPANY_NOISE)
    s = collapse(F.regexp_replace(s, r"\bthe\b", " "))
    return let(s, lambda x: F.when(x != "", x).otherwise(slug(c)))


def normalize_title(c: Column, drop_seniority: bool = False) -> Column:
    """Title without brackets, prefixes, advertising words and what follows "for"; short forms written out."""
    s = F.regexp_replace(text_or_empty(c), r"\(.*?\)", " ")
    s = without_words(slug(F.regexp_replace(s, r"^[^:]{0,24}:\s*", "")), fixed.TITLE_NOISE)
    s = F.regexp_replace(F.regexp_replace(s, r"\bfor\b.*$", " "), r"[-/|,]+", " ")
    s = expand_abbreviations(s)
    return collapse(without_words(s, fixed.SENIORITY) if drop_seniority else s)


def slug_tokens(c: Column, longer_than: int = 2) -> Column:
    """Distinct words of a slug over a length, first ones first."""
    return F.array_distinct(F.filter(F.split(slug(c), " "), lambda w: F.length(w) > longer_than))


def terms(c: Column, stop: list[str] = fixed.STOP_WORDS) -> Column:
    """Distinct words over two characters that are no stop words, first ones first."""
    kept = F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9+#./ ]", " ")
    return F.array_distinct(F.filter(F.split(kept, " +"), lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def words(c: Column, expand: bool = False, table: dict[str, str] = fixed.SCORE_ABBREVIATIONS) -> Column:
    """Runs of ``a-z 0-9 + #`` in lower case; short forms written out on demand."""
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9+#]+"), F.lit(0))
    return F.flatten(F.transform(found, lambda w: F.split(lookup(table, w), " "))) if expand else found


def word_count(c: Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(r"\S+"))


def placeholder_count(c: Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(r"\[[^\]]+\]"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where one side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def first_email(c: Column) -> Column:
    return F.regexp_extract(text_or_empty(c), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0)


def canonical_url(c: Column) -> Column:
    """Lower-case url whose query has neither tracking nor blank parameters, sorted, without
    fragment and slashes at the end of the path."""
    plain = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))

    def build(u: Column) -> Column:
        part = lambda k: F.regexp_extract(u, r"^(?:([a-z][a-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", k)
        pairs = F.transform(F.split(part(4), "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")))
        kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].rlike(f"^({fixed.TRACKING})")))
        query = F.array_join(F.transform(kept, lambda p: F.concat(plain(p["k"]), F.lit("="), plain(p["v"]))), "&")
        out = F.concat(
            F.when(part(1) != "", F.concat(part(1), F.lit(":"))).otherwise(""),
            F.when(part(2) != "", F.concat(F.lit("//"), part(2))).otherwise(""),
            F.regexp_replace(part(3), "/+$", ""),
            let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")),
        )
        return F.when(u == "", F.lit("")).otherwise(out)

    return let(F.lower(F.trim(text_or_empty(c))), build)


def fingerprint(company: Column, title: Column, area: Column) -> Column:
    """First 16 hex digits of the SHA-1 of ``company|title|area``, with area "unknown" where it is blank."""
    place = F.coalesce(F.nullif(area, F.lit("")), F.lit("unknown"))
    return F.substring(F.sha1(F.concat_ws("|", company, title, place)), 1, 16)


def truncated(c: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(c, 1, n)


def has_iso_date(c: Column) -> Column:
    """Whether a text begins with a date as year-month-day."""
    return text_or_empty(c).rlike(r"^\d{4}-\d{2}-\d{2}")
