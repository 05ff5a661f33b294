"""What is remembered between runs: ledger, feed, decisions, source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

PRIORITY_RANK = {"A": 0, "B": 1, "C": 2}


def priority_rank(c: Column, unknown: int = 3) -> Column:
    out = F.lit(unknown)
    for p, r in PRIORITY_RANK.items():
        out = F.when(c == p, r).otherwise(out)
    return out


def still_relevant(as_of: Column, days: int = fixed.RETENTION_DAYS) -> Column:
    """Active rows stay; others until their deadline passes or they grow too old."""
    deadline = F.col("deadline").cast("string").try_cast("date")
    young = F.substring(F.coalesce(F.col("createdAt").cast("string"), F.lit("")), 1, 10) >= F.date_sub(as_of, days).cast("string")
    return F.col("status").isin(fixed.ACTIVE_STATUSES) | (F.coalesce(deadline >= as_of, F.lit(True)) & young)


def merge_feed(fresh: DataFrame, previous: DataFrame, ledger: DataFrame, as_of: Column, days: int = fixed.RETENTION_DAYS, drop_expired: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(feed, ledger, new fingerprints) after a run.

    ``fresh`` and ``previous`` are postings with one fingerprint each; ``ledger`` has
    fingerprint, first_seen, status, notified, last_seen, and never loses a row.
    """
    led = ledger.select("fingerprint", F.col("first_seen").alias("_first"), F.col("status").alias("_decided"), F.lit(True).alias("_known"))
    old = previous.select("fingerprint", F.col("status").alias("_old_status"), F.col("id").alias("_old_id"))
    j = fresh.join(led, "fingerprint", "left").join(old, "fingerprint", "left")
    known = F.col("_known").isNotNull()
    decided = (F.coalesce("_decided", F.lit("")) != "") & (F.col("_decided") != "Awaiting Review")
    status = F.when(known & decided, F.col("_decided")).when(known, F.coalesce("_old_status", "status")).otherwise(F.col("status"))
    j = j.withColumns(
        {
            "createdAt": F.when(known, F.coalesce("_first", "createdAt")).otherwise(F.col("createdAt")),
            "status": status,
            "id": F.when(known, F.coalesce(F.nullif("_old_id", F.lit("")), "id")).otherwise(F.col("id")),
            "is_new": ~known,
        }
    )
    kept = j.select(*fresh.columns, "is_new")
    carried = previous.where(F.col("status").isin(fixed.ACTIVE_STATUSES)).join(fresh.select("fingerprint"), "fingerprint", "left_anti")
    every = kept.unionByName(carried.withColumn("is_new", F.lit(False)), allowMissingColumns=True)
    feed = every.where(still_relevant(as_of, days)) if drop_expired else every
    new = kept.where("is_new").select("fingerprint")
    today = as_of.cast("string")
    seen = fresh.select("fingerprint", F.col("createdAt").alias("_c"), F.col("status").alias("_s"))
    after = ledger.join(seen, "fingerprint", "full").select(
        "fingerprint",
        F.coalesce("first_seen", "_c").alias("first_seen"),
        F.coalesce("status", "_s").alias("status"),
        F.coalesce("notified", F.lit(False)).alias("notified"),
        F.when(F.col("_c").isNotNull(), today).otherwise(F.col("last_seen")).alias("last_seen"),
    )
    return feed, after, new


#: A ledger row: one a fingerprint, never removed.
LEDGER = "fingerprint string, first_seen string, status string, notified boolean, last_seen string"


def upsert_ledger(table, fresh: DataFrame, as_of: Column) -> int:
    """A run's postings in a ledger of buckets (:class:`..sources.buckets.BucketTable` of ``LEDGER``): new
    fingerprints enter with date and status, known ones keep both and get the day they were seen."""
    rows = fresh.select("fingerprint", F.col("createdAt").alias("first_seen"), "status", F.lit(False).alias("notified"), as_of.cast("string").alias("last_seen"))
    keep = lambda old, new, known: {c: F.coalesce(old(c), new(c)) for c in ("first_seen", "status", "notified")}
    return table.merge(rows, keep)


def upsert_decisions(table, decisions: DataFrame) -> int:
    """The last decision on each known fingerprint; others are ignored."""
    last = decisions.groupBy("fingerprint").agg(F.max_by("status", F.struct("decidedAt", "status")).alias("status"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("first_seen", "string"), ("notified", "boolean"), ("last_seen", "string"))]
    return table.merge(last.select("fingerprint", none[0], "status", *none[1:]), insert=False)


def upsert_notified(table, sent: DataFrame) -> int:
    """Mark fingerprints as told; call it when a sink has committed them."""
    none = {c: F.lit(None).cast("string").alias(c) for c in ("first_seen", "status", "last_seen")}
    return table.merge(sent.select("fingerprint").distinct().select("fingerprint", none["first_seen"], none["status"], F.lit(True).alias("notified"), none["last_seen"]))


def feed_order(feed: DataFrame, tie: str = "fingerprint") -> DataFrame:
    return feed.orderBy(priority_rank(F.col("priority")), F.desc("matchScore"), tie)


def select_for_notice(feed: DataFrame, new: DataFrame, at_least: str) -> DataFrame:
    """New postings whose priority reaches the bar (an unknown bar is the highest)."""
    return feed.join(new, "fingerprint", "left_semi").where(priority_rank(F.col("priority")) <= PRIORITY_RANK.get(at_least, 0))


def notice_picks(feed: DataFrame, new: DataFrame, at_least: str, force: bool = False, most: int = 5) -> DataFrame:
    """What a notice tells of; ``force``: where there is nothing new, the best rows of priority A."""
    picks = select_for_notice(feed, new, at_least)
    if force and picks.isEmpty():
        return feed_order(feed.where(F.col("priority") == "A")).limit(most)
    return picks


def apply_decisions(ledger: DataFrame, decisions: DataFrame, decided_at: Column) -> DataFrame:
    """Statuses of known fingerprints replaced by the last decision on each; others are ignored."""
    last = decisions.groupBy("fingerprint").agg(F.max_by("status", F.struct("decidedAt", "status")).alias("_s"))
    return ledger.join(last, "fingerprint", "left").withColumns({"status": F.coalesce("_s", "status"), "decided_at": F.when(F.col("_s").isNotNull(), decided_at)}).drop("_s")


def mark_notified(ledger: DataFrame, sent: DataFrame) -> DataFrame:
    hit = sent.select("fingerprint", F.lit(True).alias("_sent")).distinct()
    return ledger.join(hit, "fingerprint", "full").withColumn("notified", F.coalesce("_sent", "notified", F.lit(False))).drop("_sent")


def client_merge(feed: DataFrame, local: DataFrame, decisions: DataFrame, keep_vanished: bool = False, local_fields: tuple[str, ...] = ("selectedStrategy",)) -> DataFrame:
    """A client's copy after a new feed: content from the feed, id and own fields from the copy,
    status from the decision, else the copy, else the feed.  Vanished rows stay where active,
    without fingerprint, or on demand."""
    blank = F.lit("")
    loc = local.where(F.coalesce("fingerprint", blank) != "")
    mine = loc.select("fingerprint", F.col("status").alias("_status"), F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in local_fields if c in local.columns])
    dec = decisions.groupBy("fingerprint").agg(F.max_by("status", F.struct("decidedAt", "status")).alias("_decided"))
    j = feed.join(mine, "fingerprint", "left").join(dec, "fingerprint", "left")
    new = {"status": F.coalesce(F.nullif("_decided", blank), F.nullif("_status", blank), "status"), "id": F.coalesce(F.nullif("_id", blank), "id")}
    new |= {c: F.coalesce(F.col(f"_{c}"), F.col(c) if c in feed.columns else F.lit(None)) for c in local_fields if c in local.columns}
    merged = j.withColumns(new).select(*dict.fromkeys([*feed.columns, *(c for c in local_fields if c in local.columns)]))
    gone = local.join(feed.select("fingerprint"), "fingerprint", "left_anti")
    if not keep_vanished:
        gone = gone.where((F.coalesce("fingerprint", blank) == "") | F.col("status").isin(fixed.ACTIVE_STATUSES))
    return merged.unionByName(gone, allowMissingColumns=True)


def health(runs: DataFrame, threshold: int = fixed.HEALTH_THRESHOLD, by: str = "source", run: str = "run") -> DataFrame:
    """Streaks of failed runs by gaps and islands, with ``alert`` once a streak.

    ``runs`` has ``by``, ``run``, found, n_errors and raw (null: not counted).
    """
    bad = (F.coalesce("found", F.lit(0)) <= 0) & ((F.coalesce("n_errors", F.lit(0)) > 0) | F.coalesce(F.col("raw") == 0, F.lit(False)))
    order = Window.partitionBy(by).orderBy(run)
    r = runs.withColumn("unhealthy", bad).withColumn("_island", F.sum(F.when(F.col("unhealthy"), 0).otherwise(1)).over(order))
    streak = F.sum(F.when(F.col("unhealthy"), 1).otherwise(0)).over(Window.partitionBy(by, "_island").orderBy(run))
    return r.withColumn("streak", streak).withColumn("alert", F.col("unhealthy") & (F.col("streak") == threshold)).drop("_island")


def run_counts(feed: DataFrame) -> DataFrame:
    """One row: total and rows of each priority."""
    return feed.agg(F.count("*").alias("total"), *[F.count_if(F.col("priority") == p).alias(p) for p in PRIORITY_RANK])


def top_rows(feed: DataFrame, n: int = 5, by: str = "priority", tie: str = "fingerprint") -> DataFrame:
    """The first ``n`` rows of each priority, by score."""
    w = Window.partitionBy(by).orderBy(F.desc("matchScore"), tie)
    return feed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def source_report(postings: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows found and error messages of each source."""
    found = postings.groupBy("discoveredBy").agg(F.count("*").alias("found"))
    said = errors.groupBy("discoveredBy").agg(F.array_sort(F.collect_list("error")).alias("errors"))  # messages of one run
    return found.join(said, "discoveredBy", "full").select("discoveredBy", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def summary_line() -> Column:
    pay = F.coalesce(F.nullif("salaryText", F.lit("")), F.lit("pay not stated"))
    where = F.coalesce(F.nullif("area", F.lit("")), "location")
    return F.format_string("%s - %s (%s, %s) [%s%%]", "title", "company", where, pay, F.col("matchScore").cast("string"))


def visible(feed: DataFrame, show: str = "all", query: str = "", pending: str = "Awaiting Review") -> DataFrame:
    """A review list: all, "pending" ones, priority "A", or those "flagged" by a note; and of these
    the rows whose title, company, area, location or category hold the query."""
    only = {"all": F.lit(True), "pending": F.col("status") == pending, "A": F.col("priority") == "A", "flagged": F.coalesce(F.size("gateNotes"), F.lit(0)) > 0}[show]
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "company", "area", "location", "category")]))
    return feed.where(only & F.contains(hay, F.lit(query.strip().lower())))


def dashboard_keys(by: str, tie: str = "fingerprint") -> list[Column]:
    """Order of a list by best match, priority, newest, soonest deadline or highest pay; unknown values last."""
    if by == "priority":
        return [priority_rank(F.col("priority")).asc(), F.desc("matchScore"), F.asc(tie)]
    first = {
        "match": F.desc_nulls_last("matchScore"), "newest": F.desc_nulls_last("postedAt"),
        "deadline": F.asc_nulls_last("deadline"), "salary": F.desc_nulls_last(F.coalesce("salaryMax", "salaryMin")),
    }
    return [first[by], F.asc(tie)]


def dashboard_order(feed: DataFrame, by: str, tie: str = "fingerprint") -> DataFrame:
    return feed.orderBy(*dashboard_keys(by, tie))


def fact_line() -> Column:
    """Facts of a posting, in order, those that are known."""
    place = F.coalesce(F.nullif("area", F.lit("")), F.nullif("location", F.lit("")))
    far = F.when(F.col("distanceKm").isNotNull(), F.concat(place, F.lit(", "), F.col("distanceKm").cast("string"), F.lit(" km away"))).otherwise(place)
    said = lambda prefix, c: F.concat(F.lit(prefix), F.nullif(F.col(c).cast("string"), F.lit("")))
    return F.array_compact(F.array(F.nullif("category", F.lit("")), far, F.coalesce(F.nullif("salaryText", F.lit("")), F.lit("pay not stated")), said("closes ", "deadline"), said("found on ", "source")))


def without(items: Column, others: Column) -> Column:
    """Distinct elements of a list that another does not hold, in their order."""
    return F.array_except(items, others)


def terms_not_in(terms: Column, text: str) -> Column:
    """Distinct terms that are no part of a text."""
    return F.array_distinct(F.filter(terms, lambda t: ~F.contains(F.lit(text), t)))


def most_common(rows: DataFrame, value: Column, n: int, name: str = "value") -> DataFrame:
    """The ``n`` commonest values with their counts; of equals the first in order."""
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)
