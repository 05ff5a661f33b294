"""Sinks: versioned tables with a pointer, JSON export, and texts of notices (sending is left to the caller)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_or_empty
from ..operators.state import summary_line

MOST_LISTED, MOST_LINES, MOST_CAVEATS, MOST_TITLE, MOST_BODY = 25, 10, 8, 250, 60_000


def write_versioned(df: DataFrame, root: str, version: str) -> str:
    """Write a version beside the others, then a pointer of its own: readers see the old or the new.

    Nothing that is read is ever overwritten.  Pointers are numbered; the greatest counts, and
    it is written only when the version is whole.
    """
    spark = df.sparkSession
    path = f"{root}/v={version}"
    df.write.parquet(path)
    number = max(_pointers(spark, root), default=0) + 1
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.json(f"{root}/_current/{number:012d}")
    return path


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers whose writing has ended."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_current")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]  # one a version
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_current/{n}/_SUCCESS"))
    return [int(n) for n in names if re.fullmatch("[0-9]+", n) and done(n)]


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The version the newest pointer names; None where there is none yet."""
    number = max(_pointers(spark, root), default=0)
    if not number:
        return None
    version = spark.read.json(f"{root}/_current/{number:012d}").first()["version"]
    return spark.read.parquet(f"{root}/v={version}")


def feed_json(feed: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return feed.select(F.to_json(F.struct("*")).alias("value"))


def feed_document(feed: DataFrame, meta: dict[str, Column], generated_at: Column) -> DataFrame:
    """One JSON document of a whole feed, for a reader that wants one: schema, generatedAt, meta, jobs.

    The feed's rows meet in one place here; it is for feeds of a page's size, tables go by
    :func:`write_versioned`.
    """
    jobs = feed.agg(F.collect_list(F.struct("*")).alias("jobs"))
    top = F.struct(F.lit(1).alias("schema"), generated_at.alias("generatedAt"), F.struct(*[v.alias(k) for k, v in meta.items()]).alias("meta"), F.col("jobs"))
    return jobs.select(F.to_json(top).alias("value"))


def run_digest(counts: DataFrame, report: DataFrame, queries: list[str], filters: dict, blocked: list[str], ran_at: Column) -> DataFrame:
    """One row of JSON: queries, sources, counts, filters, the first blocked urls and the time of a run."""
    sources = report.agg(F.map_from_entries(F.collect_list(F.struct("discoveredBy", F.struct(*[c for c in report.columns if c != "discoveredBy"])))).alias("sources"))  # one a source
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    row = counts.select(F.struct("*").alias("counts")).crossJoin(sources)  # one row each
    doc = F.struct(strings(queries).alias("queries"), "sources", "counts", F.create_map(*[F.lit(str(x)) for kv in filters.items() for x in kv]).alias("filters") if filters else F.create_map().alias("filters"), strings(blocked[:20]).alias("blockedUrls"), ran_at.alias("ranAt"))
    return row.select(F.to_json(doc).alias("value"))


def cell(c: Column) -> Column:
    """Text that keeps a markdown table whole: no bars, one line."""
    return F.trim(F.regexp_replace(F.replace(text_or_empty(c.cast("string")), F.lit("|"), F.lit("/")), r"\s+", " "))


def markdown_row(cols: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in cols]), F.lit(" |"))


def _joined(rows: DataFrame, order: list[Column], n: int, **lines: Column) -> DataFrame:
    """One row: of the first ``n`` rows the non-null values of each expression, in order."""
    top = rows.orderBy(*order).limit(n).select(F.monotonically_increasing_id().alias("i"), *[c.alias(k) for k, c in lines.items()])
    each = [F.array_sort(F.collect_list(F.when(F.col(k).isNotNull(), F.struct("i", F.col(k).alias("line"))))).alias(k) for k in lines]
    return top.agg(*each, F.count("*").alias("shown")).select("shown", *[F.transform(k, lambda x: x["line"]).alias(k) for k in lines])


def digest(feed: DataFrame, order: list[Column], n: int = MOST_LISTED, cols: tuple[str, ...] = ("priority", "title", "company", "matchScore")) -> DataFrame:
    """One row: markdown of the first ``n`` rows, how many more there are, and the first gate notes
    of those rows (``MOST_CAVEATS`` at most); a report of fixed length."""
    total = feed.agg(F.count("*").alias("total"))
    caveat = F.concat(F.lit("- **"), cell(F.col("title")), F.lit("**: "), cell(F.get("gateNotes", F.lit(0)))) if {"gateNotes", "title"} <= set(feed.columns) else F.lit(None).cast("string")
    lines = _joined(feed, order, n, table=markdown_row(list(cols)), caveats=caveat)
    return lines.crossJoin(total).select(F.array_join("table", "\n").alias("table"), F.greatest(F.lit(0), F.col("total") - F.col("shown")).alias("more"), F.slice("caveats", 1, MOST_CAVEATS).alias("caveats"))  # one row each


def issue(feed: DataFrame, order: list[Column], mention: str = "", link: str = "", cols: tuple[str, ...] = ("priority", "title", "company", "matchScore")) -> DataFrame:
    """One row (title, body) that lists new postings; none without postings.  Lengths are bounded."""
    total = feed.agg(F.count("*").alias("n")).where("n > 0")
    first = _joined(feed, order, 1, top=F.concat(F.col("title"), F.lit(" at "), F.col("company")))
    d = digest(feed, order, MOST_LISTED, cols).crossJoin(total).crossJoin(first.select(F.get("top", F.lit(0)).alias("top")))  # one row each
    many = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " new match").otherwise(" new matches"))
    head = F.lit("| " + " | ".join(cols) + " |\n|" + "---|" * len(cols))
    who = f"@{mention.lstrip('@')} " if mention else ""
    parts = [
        F.concat(F.lit(who), many, F.lit(". Nothing has been sent to anyone.")), F.concat_ws("\n", head, "table"), F.when(F.col("more") > 0, F.concat(F.lit("and "), F.col("more").cast("string"), F.lit(" more"))),
        F.when(F.size("caveats") > 0, F.concat(F.lit("To check first:\n"), F.array_join("caveats", "\n"))), F.lit(link or None).cast("string"),
    ]
    return d.select(F.substring(F.concat(many, F.lit(": "), F.col("top")), 1, MOST_TITLE).alias("title"), F.substring(F.concat_ws("\n\n", *parts), 1, MOST_BODY).alias("body"))


def escaped(c: Column) -> Column:
    """Text inside markup."""
    out = text_or_empty(c.cast("string"))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def html_digest(feed: DataFrame, order: list[Column], n: int = MOST_LISTED, link: str = "") -> DataFrame:
    """One row: a table of markup with place, pay, source, the first two notes, score and link."""
    place = F.concat(escaped(F.coalesce(F.nullif("area", F.lit("")), "location")), F.coalesce(F.concat(F.lit(" &middot; "), F.col("distanceKm").cast("string"), F.lit(" km")), F.lit("")))
    facts = F.concat_ws(" &middot; ", place, escaped(F.coalesce(F.nullif("salaryText", F.lit("")), F.lit("pay not stated"))), escaped(F.col("source")))
    notes = F.array_join(F.transform(F.slice("gateNotes", 1, 2), lambda x: escaped(x)), "<br>")
    row = F.concat(F.lit("<tr><td><b>"), escaped(F.col("title")), F.lit("</b><br>"), escaped(F.col("company")), F.lit("<br>"), facts, F.lit("<br>"), text_or_empty(notes), F.lit('</td><td><b>'), F.col("matchScore").cast("string"), F.lit('%</b><br><a href="'), escaped(F.col("url")), F.lit('">Open</a></td></tr>'))
    rows = _joined(feed, order, n, lines=row).crossJoin(feed.agg(F.count("*").alias("n")))  # one row each
    tail = f'<p><a href="{link}">Review</a></p>' if link else ""
    return rows.where("n > 0").select(F.concat(F.lit("<h2>"), F.col("n").cast("string"), F.when(F.col("n") == 1, " new match").otherwise(" new matches"), F.lit("</h2><table>"), F.array_join("lines", ""), F.lit(f"</table>{tail}")).alias("html"))


def webhook_payload(feed: DataFrame, order: list[Column], link: str = "", rows: int = 200) -> DataFrame:
    """Rows of JSON, a call each: a text of the first lines (twice, under the names two kinds of receivers
    read) and about ``rows`` postings as data, dealt by hash; one row up to ``rows`` postings, none
    without postings."""
    columns = feed.columns
    line = F.concat(F.lit("`"), F.col("matchScore").cast("string"), F.lit("%` ["), F.col("title"), F.lit(" - "), F.col("company"), F.lit("]("), F.col("url"), F.lit(") - "), F.coalesce(F.nullif("area", F.lit("")), "location"), F.lit(", "), F.coalesce(F.nullif("salaryText", F.lit("")), F.lit("pay not stated")))
    head = _joined(feed, order, MOST_LINES, lines=line).crossJoin(feed.agg(F.count("*").alias("n"))).select(F.col("lines").alias("_lines"), F.col("n").alias("_n"))  # one row each
    dealt = feed.crossJoin(F.broadcast(head)).withColumn("_part", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns]), F.ceil(F.col("_n") / rows)))
    head = dealt.groupBy("_part").agg(F.first("_lines").alias("lines"), F.first("_n").alias("n"), F.collect_list(F.struct(*columns)).alias("jobs"))  # about ``rows``
    text = F.concat_ws("\n", F.concat(F.lit("**"), F.col("n").cast("string"), F.when(F.col("n") == 1, " new job match**").otherwise(" new job matches**")), F.array_join("lines", "\n"), F.lit(f"Review: {link}" if link else None).cast("string"))
    return head.where("n > 0").select(F.to_json(F.struct(text.alias("content"), text.alias("text"), "jobs")).alias("value"))


def source_problem(alerts: DataFrame, mention: str = "") -> DataFrame:
    """(source, streak, errors) -> title and body of a message on a source that has gone silent."""
    who = f"@{mention.lstrip('@')} " if mention else ""
    said = F.when(F.size("errors") > 0, F.array_join(F.transform("errors", lambda e: F.concat(F.lit("- "), e)), "\n")).otherwise("- it served no postings")
    body = F.concat(F.lit(who + "**"), F.col("source"), F.lit("** has given nothing for "), F.col("streak").cast("string"), F.lit(" runs in a row.\n\n"), said, F.lit("\n\nOther sources are not affected. This is told once until it has recovered."))
    title = F.concat(F.lit("Source problem: "), F.col("source"), F.lit(", "), F.col("streak").cast("string"), F.lit(" silent runs"))
    return alerts.select("source", F.substring(title, 1, MOST_TITLE).alias("title"), F.substring(body, 1, MOST_BODY).alias("body"))


def notice_lines(feed: DataFrame, order: list[Column], n: int = MOST_LINES) -> DataFrame:
    return feed.orderBy(*order).limit(n).select(summary_line().alias("line"))
