"""Language identification of pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's likelihood under character-n-gram models,
how likely each language's pages are to declare the markup language the page declares, how
likely they are to lie under its address suffix, and the host's prior.

Models are trained on texts with a known language: at most ``FIT_ROWS`` rows (one of each
language at least), drawn by hash of their id, equally from each language.  The declared
language and the suffix are weighed by tables of smoothed counts, and a host's prior is
smoothed towards that of its domain, this one towards its suffix, and that one towards all
pages: all of them are sums, grouped, of the texts' own posteriors over all pages.  A page's own
part is taken out of the sums at every level and in both tables, so that it never vouches for
itself.

Null and empty pages have no text evidence (a flat likelihood) and are named by the rest; very
long ones are read whole.  Pages without id are named too, repeated pages alike.  Of languages
that tie the first in the alphabet is named.  Extra columns are ignored.  Languages are all
those of the training table, and the model holds ``BUCKETS`` numbers for each; without training
rows every language is null.  No pages give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, spread_join, table

FIT_ROWS, BUCKETS = 4_000, 1 << 16
#: n-grams are far from independent: the log-likelihood is tempered to so many of them.
EFFECTIVE = 40
SMOOTH_TABLE, SMOOTH_HOST = 1.0, 20.0
#: Hosts this common (a share of 1 / HOT_HOSTS of all pages) get their sums by broadcast.
HOT_HOSTS = 1_000

_ENTITY = re.compile(r"&(?:#\w+|\w+);")
_DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def without(html: str, elements: tuple[str, ...], tags: bool) -> str:
    """``html`` with a space for each of the elements, from its tag to the next closing one, and with
    ``tags`` for comments and other tags.  What is never closed stays.

    A closing sign that was once sought in vain is not sought again, so broken markup is read in one pass too.
    """
    opening = re.compile(rf"<({'|'.join(elements)})\b", re.I)
    closing = {e: re.compile(rf"</{e}\s*>", re.I) for e in elements}
    out, at, comments, i = [], 0, tags, html.find("<")
    while i >= 0:
        end, m = -1, opening.match(html, i)
        if m and (name := m[1].casefold()) in closing:
            if c := closing[name].search(html, m.end()):
                end = c.end()
            else:
                del closing[name]
        if end < 0 and comments and html.startswith("<!--", i):
            end = html.find("-->", i + 4) + 3
            if end < 3:
                end, comments = -1, False
        if end < 0 and tags:
            end = html.find(">", i + 1) + 1
            if not end:
                break  # nothing is closed any more
        if end < 0:
            i = html.find("<", i + 1)
            continue
        out += [html[at:i], " "]
        at, i = end, html.find("<", end)
    return "".join([*out, html[at:]])


#: Elements without text for readers, and those around the text of a page.
SILENT, AROUND = ("script", "style", "noscript", "template"), ("nav", "header", "footer", "aside", "form")


def page_text(html: str | None) -> str:
    """Text of a page without markup; navigation, headers and footers are left out unless
    nothing else remains."""
    html = html or ""
    main = _ENTITY.sub(" ", without(without(html, AROUND, False), SILENT, True))
    return main if main.strip() else _ENTITY.sub(" ", without(html, SILENT, True))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of the n-grams (1 to 4 code points, letters and single spaces) of a text."""
    text = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h, out = np.zeros(len(cp), np.uint64), []
    for n in range(4):
        m = len(cp) - n
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x9E3779B97F4A7C15)) ^ (cp[n:] + np.uint64(n + 1))
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(48)).astype(np.int64) % BUCKETS)
    return np.unique(np.concatenate(out), return_counts=True)


def train(texts: DataFrame) -> tuple[list[str], np.ndarray | None]:
    """(id, text, lang) -> the languages and their log-probabilities by bucket."""
    known = texts.where("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").select("id", "lang", "text", F.xxhash64("id", "text").alias("d"))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # one row a language
    if not langs:
        return [], None
    each = max(1, FIT_ROWS // len(langs))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("d", "id"))  # tasks keep the first rows before the shuffle
    some = known.select("d", "id", "lang").withColumn("_n", place).where(F.col("_n") <= each).select(F.col("d").alias("_d"), F.col("lang").alias("_lang")).distinct()
    rows = known.join(F.broadcast(some), (F.col("d") == F.col("_d")) & (F.col("lang") == F.col("_lang"))).drop("_d", "_lang")
    rows = rows.withColumn("_n", place).where(F.col("_n") <= each).select("lang", "text")  # rows that repeat count here

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {x: np.zeros(BUCKETS) for x in langs}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang in total:
                    at, n = gram_counts(text)
                    total[lang][at] += n / n.sum()  # each text counts alike
        for lang, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket bigint, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = np.full((len(langs), BUCKETS), 1e-3)
    got = sums.toPandas()  # BUCKETS numbers a language at most
    model[[langs.index(x) for x in got["lang"]], got["bucket"]] += got["n"]
    return langs, np.log(model / model.sum(1, keepdims=True))


def text_posteriors(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """(page_id, url, html) -> page_id, url, declared, and ``post``: P(language | text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, len(langs)), 1 / len(langs))
            for i, html in enumerate(batch.column("html").to_pylist()):
                text = page_text(html)
                if text.strip():
                    at, n = gram_counts(text)
                    logs = model[:, at] @ n * (min(1.0, EFFECTIVE / n.sum()))
                    p = np.exp(logs - logs.max())
                    out[i] = p / p.sum()
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("declared"), pa.array(list(out), pa.list_(pa.float64()))], ["page_id", "url", "declared", "post"])

    p = pages.select(F.col("page_id").cast("bigint"), "url", F.lower(F.regexp_extract("html", _DECLARED, 1)).alias("declared"), "html")
    return p.mapInArrow(run, "page_id bigint, url string, declared string, post array<double>")


def _summed(rows: DataFrame, by: list[str], n: int, what: str, name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.element_at(what, i + 1)) for i in range(n)]).alias(name), F.count("*").alias("pages"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _share(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)
    return x / (x.sum(1, keepdims=True) + 1e-12)


def fused_logs(post: np.ndarray, host: np.ndarray, domain: np.ndarray, suffix: np.ndarray, declared: np.ndarray, total: np.ndarray, suffixes: int, declarations: int) -> np.ndarray:
    """Log evidence of pages (rows) for languages (columns): ``post`` from the texts, sums of it
    over each page's host, domain, suffix and declared language, and over all pages."""
    prior = _share(total - post + 1)
    for sums in (suffix, domain, host):
        prior = _share(np.maximum(sums - post, 0) + SMOOTH_HOST * prior)
    logs = np.log(post + 1e-12) + np.log(prior + 1e-12)
    for sums, kinds in ((declared, declarations), (suffix, suffixes)):
        logs += np.log((np.maximum(sums - post, 0) + SMOOTH_TABLE) / (np.maximum(total - post, 0) + SMOOTH_TABLE * (kinds + 1)))
    return logs


def fuse(post: DataFrame, langs: list[str]) -> DataFrame:
    """One row a page: page_id, lang, confidence, text_lang, declared, suffix, host."""
    n = len(langs)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = post.withColumn("host", host).withColumn("declared", F.coalesce("declared", F.lit(""))).drop("url")
    rows = materialise(rows, "language-text")
    hosts = _summed(rows, ["host"], n, "post", "n_host")
    hosts = hosts.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("domain", F.substring_index("host", ".", -2))
    hosts = materialise(hosts, "language-hosts")
    domains = _summed(hosts, ["domain"], n, "n_host", "n_domain").drop("pages")
    suffixes = materialise(_summed(hosts, ["suffix"], n, "n_host", "n_suffix").drop("pages"), "language-suffixes")
    hosts = materialise(hosts.join(domains, "domain").join(suffixes, "suffix").select("host", "suffix", "n_host", "n_domain", "n_suffix", "pages"), "language-sums")
    declared = materialise(_summed(rows, ["declared"], n, "post", "n_declared").drop("pages"), "language-declared")
    kinds = (suffixes.count(), declared.count())
    total = suffixes.agg(*[F.sum(F.element_at("n_suffix", i + 1)) for i in range(n)]).first()  # a number a language
    total = np.array([x or 0.0 for x in total])
    out = spread_join(rows, hosts, "host", "pages", HOT_HOSTS).join(F.broadcast(declared), "declared")  # codes of two or three letters: 18,253 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, *sums = (_matrix(batch.column(c), n) for c in ("post", "n_host", "n_domain", "n_suffix", "n_declared"))
            logs = fused_logs(own, *sums, total, *kinds)
            best = logs.argmax(1)
            sure = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            named = [pa.array([langs[i] for i in at]) for at in (best, own.argmax(1))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), named[0], pa.array(sure), named[1], *(batch.column(c) for c in ("declared", "suffix", "host"))], ["page_id", "lang", "confidence", "text_lang", "declared", "suffix", "host"])

    return out.mapInArrow(run, "page_id bigint, lang string, confidence double, text_lang string, declared string, suffix string, host string")


def identify(pages: DataFrame, texts: DataFrame) -> DataFrame:
    langs, model = train(texts)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("bigint"), none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), none.alias("declared"), none.alias("suffix"), none.alias("host"))
    return fuse(text_posteriors(pages, langs, model), langs)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return identify(table(spark, sf_dir, "pages").select("page_id", "url", "html"), texts)
