"""Connectors over landed files: raw payloads in, postings of one schema out.

Fetching (network, robots, rate limits) happens before; a payload is a row (url, body,
fetched_at).  Each connector is registered by name, takes such rows and options, and gives
postings; ``collect`` unites the enabled ones and reports rows and errors for each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.parse import infer_category, is_relevant, monthly_pay, parse_date, parse_salary, pay_text, resolve_area
from ..functions.text import clean_ws, strip_html

#: Columns of a posting, in order.
POSTING = (
    "title string, company string, description string, category string, location string, source string, url string, requiredSkills string, "
    "status string, id string, createdAt string, postedAt date, deadline date, salaryMin int, salaryMax int, salaryText string, employmentType string, "
    "experienceText string, area string, distanceKm double, fingerprint string, sources array<struct<source:string,url:string,found_at:string>>, matchScore int, "
    "scoreParts map<string,int>, priority string, gateNotes array<string>, discoveredBy string"
)
Connector = Callable[..., DataFrame]
REGISTRY: dict[str, Connector] = {}


def register(name: str) -> Callable[[Connector], Connector]:
    def add(fn: Connector) -> Connector:
        REGISTRY[name] = fn
        return fn

    return add


def posting(df: DataFrame, discovered_by: str, as_of: Column, **columns: Column) -> DataFrame:
    """Rows of the posting schema from expressions; rows without title or company go."""
    given = {"discoveredBy": F.lit(discovered_by), "status": F.lit("Awaiting Review"), "priority": F.lit("C"), "matchScore": F.lit(0), "createdAt": as_of.cast("string"), "location": F.lit("Dhaka, Bangladesh"), "category": F.lit(fixed.DEFAULT_CATEGORY)} | columns
    given.setdefault("sources", F.array(F.struct(given["source"].alias("source"), given["url"].alias("url"), as_of.cast("string").alias("found_at"))))
    given.setdefault("id", F.sha1(F.concat_ws("|", *(F.coalesce(given[c].cast("string"), F.lit("")) for c in ("source", "url", "title", "company")))))
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(POSTING)
    blank = {"string": F.lit("")}
    out = df.select(*[given.get(f.name, blank.get(f.dataType.simpleString(), F.lit(None)) if f.name not in ("postedAt", "deadline") else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    return out.where("title <> '' AND company <> ''")


@register("local")
def local_json(spark: SparkSession, path: str, as_of: Column, label: str = "Local") -> DataFrame:
    """JSON files: an object, a list, or {"jobs": [...]}; files that do not parse are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    item = F.coalesce(F.expr("try_variant_get(v, '$.jobs', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"), F.array("v"))
    rows = raw.select(F.explode(item).alias("v"))
    get = lambda k: F.expr(f"try_variant_get(v, '$.{k}', 'string')")
    r = rows.select(*[clean_ws(get(k)).alias(k) for k in ("title", "company", "description", "employmentType", "experience")], *[get(k).alias(k) for k in ("location", "url", "source", "category", "deadline", "postedAt", "salary", "salaryText")], *[get(k).try_cast("int").alias(k) for k in ("salaryMin", "salaryMax")])
    r = r.withColumn("pay", parse_salary(F.coalesce(F.nullif("salary", F.lit("")), F.concat_ws(" ", "title", F.substring("description", 1, 2000)))))
    return posting(
        r, "local", as_of, title=F.col("title"), company=F.col("company"), description=F.col("description"), url=F.coalesce("url", F.lit("")),
        source=F.coalesce(F.nullif("source", F.lit("")), F.lit(label)), location=F.coalesce(F.nullif(clean_ws(F.col("location")), F.lit("")), F.lit("Dhaka, Bangladesh")),
        category=F.coalesce(F.nullif("category", F.lit("")), infer_category(F.col("title"), F.col("description"))), deadline=parse_date(F.col("deadline"), as_of), postedAt=parse_date(F.col("postedAt"), as_of),
        salaryMin=F.coalesce("salaryMin", "pay.lo"), salaryMax=F.coalesce("salaryMax", "pay.hi"), salaryText=F.coalesce("salaryText", "pay.text"), employmentType=F.col("employmentType"), experienceText=F.col("experience"),
    )


def local_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, error) of the local files that do not parse, and of entries without title or company."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    item = F.coalesce(F.expr("try_variant_get(v, '$.jobs', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"), F.array("v"))
    get = lambda k: F.coalesce(F.trim(F.expr(f"try_variant_get(v, '$.{k}', 'string')")), F.lit(""))
    entries = raw.where("v IS NOT NULL").select("file", F.explode(item).alias("v")).where((get("title") == "") | (get("company") == ""))
    return raw.where("v IS NULL").select("file", F.lit("does not parse").alias("error")).unionByName(entries.select("file", F.lit("entry without title or company").alias("error")))


def rss_raw(payloads: DataFrame) -> int:
    """How many items the feeds served, before any filter."""
    n = payloads.agg(F.sum(F.regexp_count("body", F.lit(r"<(?:item|entry)\b")))).first()[0]
    return int(n or 0)


@register("rss")
def rss(payloads: DataFrame, as_of: Column, label: str = "RSS", regions: list[str] | None = None, queries: list[str] | None = None, title_format: str = "") -> DataFrame:
    """RSS items and Atom entries: (url, body) -> postings.

    ``title_format`` "company: role" splits at the first ": "; otherwise the last " at " parts
    role and company.  Items of other regions go, those without a region stay.
    """
    items = payloads.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))).alias("x"))
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")), F.lit("")) for n in names], F.lit(""))
    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.regexp_extract("x", r"<link\b[^>]*\bhref=[\"']([^\"']+)", 1))
    r = items.select(clean_ws(strip_html(tag("title"))).alias("t"), link.alias("url"), tag("region", "location").alias("region"), strip_html(strip_html(tag("description", "summary", "content"))).alias("description"), tag("pubDate", "published", "updated").alias("at"), tag("author", "dc:creator").alias("author"))
    if regions:
        r = r.where((F.col("region") == "") | F.greatest(*[F.contains(F.lower("region"), F.lit(x.lower())) for x in regions], F.lit(False)))
    if title_format == "company: role":
        halves = F.split("t", ": ", 2)
        company, title = F.when(F.size(halves) > 1, halves[0]).otherwise(F.col("author")), F.when(F.size(halves) > 1, F.get(halves, F.lit(1))).otherwise(F.col("t"))
    else:
        role, firm = F.regexp_extract("t", "^(.*) at (.*)$", 1), F.regexp_extract("t", "^(.*) at (.*)$", 2)
        company, title = F.when(firm != "", firm).otherwise(F.col("author")), F.when(role != "", role).otherwise(F.col("t"))
    r = r.withColumns({"company": company, "title": title})
    if queries:
        r = r.where(is_relevant(F.col("title"), queries))
    r = r.withColumn("pay", parse_salary(F.concat_ws(" ", "title", "description")))
    return posting(r, "rss", as_of, title=F.col("title"), company=F.col("company"), description=F.col("description"), url=F.col("url"), source=F.lit(label), location=F.coalesce(F.nullif("region", F.lit("")), F.lit("Remote")), category=infer_category(F.col("title"), F.col("description")), postedAt=parse_date(F.col("at"), as_of), salaryMin=F.col("pay.lo"), salaryMax=F.col("pay.hi"), salaryText=F.col("pay.text"))


def ld_blocks(payloads: DataFrame) -> DataFrame:
    """(url, body) -> (url, ordinal, item): every JobPosting of the pages' JSON-LD, in page order, as JSON."""

    def walk(x: object) -> Iterator[dict]:
        stack = [x]
        while stack:
            v = stack.pop()
            if isinstance(v, list):
                stack += reversed(v)
            elif isinstance(v, dict):
                kind = v.get("@type")
                if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
                    yield v
                else:
                    stack += reversed(list(v.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for url, blocks in zip(batch.column("url").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                n = 0
                for b in blocks or []:
                    try:
                        tree = json.loads(b)
                    except ValueError:
                        continue
                    for item in walk(tree):
                        for col, v in zip(out, (url, n, json.dumps(item, ensure_ascii=False)), strict=True):
                            col.append(v)
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["url", "ordinal", "item"])

    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return payloads.select("url", blocks.alias("blocks")).mapInArrow(run, "url string, ordinal bigint, item string")


def ld_location(v: Column) -> Column:
    """Street, locality and region of an address, parts inside earlier ones left out; "Remote" for telework."""
    j = lambda p: F.coalesce(F.get_json_object(v, p), F.lit(""))
    first = lambda p: F.coalesce(F.nullif(j(f"$.jobLocation{p}"), F.lit("")), j(f"$.jobLocation[0]{p}"))
    parts = F.filter(F.array(*[F.trim(first(f".address.{k}")) for k in ("streetAddress", "addressLocality", "addressRegion")]), lambda x: (x != "") & ~F.lower(x).isin(fixed.PLACEHOLDERS))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.contains(F.lower(y), F.lower(x))), a).otherwise(F.concat(a, F.array(x))))
    place = F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(F.when(~first("").rlike(r"^\s*[\[{]"), first("")).otherwise(""))
    return F.when(j("$.jobLocationType") == "TELECOMMUTE", F.when(place == "", "Remote").otherwise(F.concat(F.lit("Remote, "), place))).otherwise(place)


@register("jsonld")
def jsonld(payloads: DataFrame, as_of: Column, label: str = "Web", queries: list[str] | None = None, max_age_days: int | None = None, place: str = "Dhaka, Bangladesh", ignore_deadline: bool = False) -> DataFrame:
    """JobPosting items of pages; an item without url takes the page's where it is the only one."""
    items = ld_blocks(payloads)
    r = items.where("url IS NOT NULL").withColumnRenamed("url", "page").withColumn("n", F.count("*").over(Window.partitionBy("page")))
    j = lambda p: F.coalesce(F.get_json_object("item", p), F.lit(""))
    own = F.when(j("$.url").rlike("^https?://"), j("$.url")).when(F.col("n") == 1, F.col("page"))
    firm = F.when(j("$.hiringOrganization.name") != "", j("$.hiringOrganization.name")).otherwise(j("$.hiringOrganization"))
    amount = lambda k: F.get_json_object("item", f"$.baseSalary.value.{k}").try_cast("double")
    unit, money = j("$.baseSalary.value.unitText"), j("$.baseSalary.currency")
    low = monthly_pay(F.coalesce(amount("minValue"), amount("value"), F.get_json_object("item", "$.baseSalary.value").try_cast("double")), unit, money)
    high = monthly_pay(amount("maxValue"), unit, money)
    kinds = F.from_json(F.when(j("$.employmentType").startswith("["), j("$.employmentType")).otherwise(F.to_json(F.array(j("$.employmentType")))), "array<string>")
    codes = F.create_map(*[F.lit(x) for kv in fixed.EMPLOYMENT.items() for x in kv])
    named = F.transform(F.filter(kinds, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.coalesce(F.try_element_at(codes, F.upper(x)), F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))))
    r = r.select(own.alias("link"), strip_html(j("$.title")).alias("title"), strip_html(firm).alias("company"), strip_html(F.when(j("$.description").contains("&lt;"), strip_html(j("$.description"))).otherwise(j("$.description"))).alias("description"), ld_location(F.col("item")).alias("location"), F.array_join(named, ", ").alias("kind"), F.substring(j("$.datePosted"), 1, 10).try_cast("date").alias("posted"), F.substring(j("$.validThrough"), 1, 10).try_cast("date").alias("until"), low.alias("low"), high.alias("high"))
    r = r.where("link IS NOT NULL")
    if max_age_days is not None:
        r = r.where(F.col("posted").isNull() | (F.col("posted") >= F.date_sub(as_of, max_age_days)))
    if queries:
        r = r.where(is_relevant(F.col("title"), queries))
    r = r.withColumn("pay", parse_salary(pay_text(F.col("description"))))
    stated, top = F.col("low").isNotNull(), F.when(F.col("high") >= F.col("low"), F.col("high"))
    r = posting(r, "jsonld", as_of, title=F.col("title"), company=F.col("company"), description=F.col("description"), url=F.col("link"), source=F.lit(label), location=F.coalesce(F.nullif("location", F.lit("")), F.lit(place)), employmentType=F.col("kind"), category=infer_category(F.col("title"), F.col("description")), postedAt=F.col("posted"), deadline=F.when(F.lit(not ignore_deadline) & (F.col("until") >= "2000-01-01"), F.col("until")), salaryMin=F.when(stated, F.col("low")).otherwise(F.col("pay.lo")), salaryMax=F.when(stated, top).otherwise(F.col("pay.hi")), salaryText=F.when(stated, F.concat(F.lit("Tk "), F.format_number("low", 0), F.coalesce(F.concat(F.lit(" - "), F.format_number(top, 0)), F.lit("")))).otherwise(F.col("pay.text")))
    return r.dropDuplicates(["url", "title"])


@register("wordpress")
def wordpress(payloads: DataFrame, as_of: Column, label: str = "Board", queries: list[str] | None = None) -> DataFrame:
    """Pages of a REST listing (JSON lists of items).  Title is "Role | Company", split at the last bar."""
    items = payloads.select(F.explode(F.from_json("body", "array<struct<id bigint, date string, link string, title struct<rendered string>, content struct<rendered string>, metas map<string,string>>>")).alias("i"))
    t = strip_html(F.col("i.title.rendered"))
    meta = lambda k: F.when(~F.lower(F.coalesce(F.col("i.metas")[k], F.lit(""))).isin("none", "null", "n/a", "0"), F.col("i.metas")[k])
    names = lambda k: F.coalesce(F.array_join(F.map_values(F.from_json(F.col("i.metas")[k], "map<string,string>")), ", "), meta(k), F.lit(""))
    custom = F.get(F.map_values(F.map_filter("i.metas", lambda k, v: k.startswith("custom-text-") & (v != ""))), F.lit(0))
    company = F.when(F.contains(t, F.lit(" | ")), F.substring_index(t, " | ", -1)).otherwise(F.coalesce(custom, F.initcap(F.replace(F.regexp_extract("i.link", r"-at-([a-z0-9-]+)/?$", 1), F.lit("-"), F.lit(" ")))))
    role = F.when(F.contains(t, F.lit(" | ")), F.regexp_replace(t, r" \| [^|]*$", "")).otherwise(t)
    r = items.select(role.alias("title"), F.trim(company).alias("company"), strip_html(F.col("i.content.rendered")).alias("description"), F.col("i.link").alias("url"), names("_job_location").alias("location"), names("_job_type").alias("kind"), F.coalesce(meta("_job_experience"), F.lit("")).alias("exp"), F.coalesce(meta("_job_salary"), F.lit("")).alias("sal"), F.substring("i.date", 1, 10).try_cast("date").alias("posted"), F.substring(meta("_job_expiry_date"), 1, 10).try_cast("date").alias("until"))
    if queries:
        r = r.where(is_relevant(F.col("title"), queries))
    r = r.withColumn("pay", parse_salary(F.coalesce(F.nullif("sal", F.lit("")), pay_text(F.col("description")))))
    return posting(r, "wordpress", as_of, title=F.col("title"), company=F.col("company"), description=F.col("description"), url=F.col("url"), source=F.lit(label), location=F.coalesce(F.nullif("location", F.lit("")), F.lit("Dhaka, Bangladesh")), employmentType=F.col("kind"), experienceText=F.col("exp"), postedAt=F.col("posted"), deadline=F.col("until"), category=infer_category(F.col("title"), F.col("description")), salaryMin=F.col("pay.lo"), salaryMax=F.col("pay.hi"), salaryText=F.col("pay.text"))


ROLE_WORDS = r"(?i)\b(engineer|developer|officer|executive|analyst|manager|trainee|intern|specialist|designer|assistant|coordinator|lead|tester|administrator)\b"


def anchors(pages: DataFrame, body: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, html) -> (url, n, href, text): anchors in page order, with other columns to ``keep``."""
    found = F.regexp_extract_all(body, F.lit(r"(?is)<a\b[^>]*?href=[\"']([^\"']+)[\"'][^>]*>.*?</a>"), F.lit(0))
    a = pages.select("url", *keep, F.posexplode(found).alias("n", "a"))
    return a.select("url", *keep, "n", F.regexp_extract("a", r"(?i)href=[\"']([^\"']+)", 1).alias("href"), strip_html(F.col("a")).alias("text"))


def job_links(links: DataFrame) -> DataFrame:
    """Anchors that look like openings: 5 to 89 characters, a role word, a path of their own."""
    path = F.lower(F.regexp_extract("href", r"^(?:https?://[^/?#]*)?([^?#]*)", 1))
    ok = (F.length("text") > 4) & (F.length("text") < 90) & F.col("text").rlike(ROLE_WORDS) & path.rlike(r"/(jobs?|careers?|openings?|positions?|vacanc\w+|apply)/?.+|-\w+-")
    return links.where(ok & (F.col("href") != F.col("url")))


@register("careers")
def careers(payloads: DataFrame, as_of: Column, company: str, label: str = "Careers page") -> DataFrame:
    r = job_links(anchors(payloads.withColumnRenamed("body", "html")))
    return posting(r.dropDuplicates(["href"]), "careers", as_of, title=F.col("text"), company=F.lit(company), url=F.col("href"), source=F.lit(label), category=infer_category(F.col("text"), F.lit("")))


class _Cards(HTMLParser):
    """Text lines and anchors of a listing page, for boards whose cards have no schema."""

    def __init__(self) -> None:
        super().__init__()
        self.items: list[tuple[str, str, str]] = []
        self.href, self.text = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.href, self.text = dict(attrs).get("href") or "", []
        if tag in ("div", "li", "tr") and (c := dict(attrs).get("class")):
            self.css = c

    def handle_data(self, data: str) -> None:
        if self.href and data.strip():
            self.text.append(data.strip())

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href:
            self.items.append((self.href, " ".join(self.text), getattr(self, "css", "")))
            self.href = ""


def cards(payloads: DataFrame, marker: str) -> DataFrame:
    """(url, body) -> (url, href, text, css): anchors whose link holds ``marker``, with the class
    of the block around them; the first of each link on a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for url, body in zip(batch.column("url").to_pylist(), batch.column("body").to_pylist(), strict=True):
                p = _Cards()
                p.feed(body or "")
                first = {h: (url, h, unescape(t), c) for h, t, c in reversed(p.items) if marker in h}
                out += reversed(first.values())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], ["url", "href", "text", "css"])

    return payloads.select("url", "body").mapInArrow(run, "url string, href string, text string, css string")


def probe(found: DataFrame, n: int = 12) -> DataFrame:
    """The commonest block classes around job-like links."""
    return found.where("css <> ''").groupBy("css").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "css").limit(n)


def mail_parts(mails: DataFrame) -> DataFrame:
    """(path, content binary) -> (path, subject, sent, body): the first HTML or text part of each message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import email
        import email.policy

        for batch in batches:
            out: list[tuple] = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                m = email.message_from_bytes(raw or b"", policy=email.policy.default)
                part = m.get_body(preferencelist=("html", "plain"))
                out.append((path, str(m["subject"] or ""), str(m["date"] or ""), part.get_content() if part else ""))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], ["path", "subject", "sent", "body"])

    return mails.select("path", "content").mapInArrow(run, "path string, subject string, sent string, body string")


@register("mail")
def mail_alerts(mails: DataFrame, as_of: Column, pattern: str, label: str = "Mail alert", lookback_days: int | None = None, most_messages: int | None = None, noise: str = fixed.MAIL_NOISE) -> DataFrame:
    """Job links in alert mails; company and place are the lines after the link's text.

    ``lookback_days``: mails sent before are left out; ``most_messages``: so many of the newest are
    read (a mailbox query, as the original asks it).  Lines of ``noise`` are no titles.
    """
    parts = mail_parts(mails)
    sent = F.to_date(F.try_to_timestamp(F.regexp_extract("sent", r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy")))
    if lookback_days is not None:
        parts = parts.where(sent >= F.date_sub(as_of, lookback_days))
    if most_messages is not None:
        parts = parts.orderBy(F.desc_nulls_last(sent), F.desc("path")).limit(most_messages)
    body = parts.select(F.col("path").alias("url"), F.col("body").alias("html"), F.filter(F.split(strip_html(F.col("body")), "\n"), lambda x: ~x.rlike(noise)).alias("lines"))
    a = anchors(body, keep=("lines",)).where(F.col("href").rlike(pattern) & ~F.col("text").rlike(noise) & (F.length("text") >= 4))
    at = F.array_position("lines", F.col("text"))
    a = a.withColumns({"company": F.coalesce(F.get("lines", at.cast("int")), F.lit("Unknown company")), "place": F.coalesce(F.get(F.filter(F.slice("lines", at.cast("int") + 2, 2), lambda x: x.rlike(r"(?i)dhaka|bangladesh|remote|,")), F.lit(0)), F.lit(""))}).where("text <> ''")
    a = a.withColumn("link", F.regexp_replace("href", r"\?.*$", "")).dropDuplicates(["link"])
    return posting(a, "mail", as_of, title=F.col("text"), company=F.col("company"), url=F.col("link"), source=F.lit(label), location=F.coalesce(F.nullif("place", F.lit("")), F.lit("Dhaka, Bangladesh")), category=infer_category(F.col("text"), F.lit("")))


def enrich(postings: DataFrame) -> DataFrame:
    """Clean texts, drop blank titles and companies, add area and distance, name a category where it is the default."""
    p = postings.withColumns({c: clean_ws(F.col(c)) for c in ("title", "company", "description")}).where("title <> '' AND company <> ''")
    p = p.withColumn("_place", resolve_area(F.col("location"), F.col("description")))
    kind = F.when(F.col("_place.remote") & (F.coalesce("employmentType", F.lit("")) == ""), "Remote").otherwise(F.col("employmentType"))
    category = F.when(F.col("category") == fixed.DEFAULT_CATEGORY, infer_category(F.col("title"), F.col("description"))).otherwise(F.col("category"))
    return p.withColumns({"area": F.col("_place.area"), "distanceKm": F.col("_place.km"), "employmentType": kind, "category": category}).drop("_place")


def build_queries(spark: SparkSession, configured: list[str], titles: list[str]) -> list[str]:
    """Configured queries, else the first twelve titles; spaces collapsed, first spellings kept."""
    seen: dict[str, str] = {}
    for q in configured or titles[:12]:
        q = " ".join(q.split())
        if q:
            seen.setdefault(q.lower(), q)
    return list(seen.values())
