"""All sources of a run: which are on, what each asks for, and a report of what each gave.

Each source is written on its own before sources are united, so one that fails, in its plan or
while it runs, leaves a message in the report and the others as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import materialise
from .landed import POSTING

#: Of a source: postings, how many the site served before any filter (None: not counted), and messages.
Found = tuple[DataFrame, int | None, list[str]]
REPORT = "discoveredBy string, found bigint, raw bigint, errors array<string>"


def enabled(config: Mapping[str, Any], default_on: Mapping[str, bool]) -> dict[str, dict[str, Any]]:
    """The settings of the sources that are on.  A source is on by its ``enabled``, else by default;
    a plain truth value for its settings does the same."""
    out = {}
    for name, given in config.items():
        own = dict(given) if isinstance(given, Mapping) else {"enabled": bool(given)}
        if own.get("enabled", default_on.get(name, False)):
            out[name] = own
    return out


def collect(spark: SparkSession, config: Mapping[str, Any], sources: Mapping[str, Callable[[dict[str, Any], list[str]], Found]], queries: list[str], default_on: Mapping[str, bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, report) of all sources that are on and known.  A source's own ``queries`` go
    before those of the run.  The report has a row for each of them."""
    every, report = spark.createDataFrame([], POSTING), []
    for name, own in enabled(config, default_on or {}).items():
        if name not in sources:
            report.append((name, 0, None, ["unknown source"]))
            continue
        raw, errors = None, []
        try:
            found, raw, errors = sources[name](own, own.get("queries") or queries)
            found = materialise(found.withColumn("discoveredBy", F.lit(name)), f"source-{name}")
            n = found.count()
        except Exception as e:  # whatever a source fails with, the others go on
            report.append((name, 0, raw, [*errors, f"{type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"]))
            continue
        every = every.unionByName(found, allowMissingColumns=True)
        report.append((name, n, raw, list(errors)))
    return every, spark.createDataFrame(report, REPORT)


def pages_of_sites(sites: list[Mapping[str, Any]], queries: list[str]) -> list[tuple[int, str]]:
    """(place of the site, url) of the pages to fetch: a template with ``{query}`` once for each of
    the site's queries (``max_queries`` at most), others once."""
    from urllib.parse import quote_plus

    out = []
    for i, site in enumerate(sites):
        if not site.get("url"):
            continue
        asked = list(site.get("queries") or queries)[: max(1, int(site.get("max_queries", 12)))]
        out += [(i, site["url"].replace("{query}", quote_plus(q))) for q in asked] if "{query}" in site["url"] else [(i, site["url"])]
    return out


def jsonld_sites(payloads: DataFrame, as_of, sites: list[Mapping[str, Any]], queries: list[str], relevance: str = "queries") -> Found:
    """Postings of all sites from their landed pages (url, body); of a url that several sites list
    the first site's.  A title counts if a query of the run or of the site fits it.  Pages that
    did not land are told."""
    from pyspark.sql import Window

    from .landed import jsonld, ld_blocks

    wanted, every = pages_of_sites(sites, queries), None
    spark = payloads.sparkSession
    asked = spark.createDataFrame([(u, i) for i, u in wanted], "url string, site int")
    here = payloads.join(asked, "url").where("body IS NOT NULL AND body <> ''")
    for i, site in enumerate(sites):
        own = list(dict.fromkeys([*queries, *(site.get("queries") or [])]))
        keep = own if relevance != "all" and queries else None
        part = jsonld(here.where(F.col("site") == i).select("url", "body"), as_of, site.get("label", "Job boards"), keep, site.get("max_age_days"), site.get("location", "Dhaka, Bangladesh"), bool(site.get("ignore_deadline")))
        part = part.withColumn("_site", F.lit(i))
        every = part if every is None else every.unionByName(part)
    if every is None:
        return spark.createDataFrame([], POSTING), 0, ["no sites"]
    first = F.row_number().over(Window.partitionBy("url").orderBy("_site", "title"))
    every = every.withColumn("_n", first).where("_n = 1").drop("_n", "_site")
    landed_urls = {r["url"] for r in here.select("url").distinct().collect()}  # one a query and site
    missing = [f"{sites[i].get('label', 'Job boards')}: empty or refused response for {u}" for i, u in wanted if u not in landed_urls]
    return every, ld_blocks(here).count(), missing
