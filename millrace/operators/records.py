"""Records of what was sent: versions, resume documents and private texts, built and checked.

Stored records are untrusted JSON.  They are read with a schema (a value of another type is
null there), a predicate says whether a record is whole, and only whole ones go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_or_empty

SCHEMA = 1
#: What a resume document must hold; lists may be empty.
RESUME = (
    "struct<v int, name string, headline string, contact string, summary string, skillRows array<struct<category string, items array<string>>>, "
    "experience array<struct<title string, meta string, priorTitle string, priorDuration string, bullets array<string>>>, "
    "projects array<struct<title string, name string, subtitle string, bullets array<string>>>, overridden boolean, experienceText string, projectsText string, "
    "education array<struct<degree string, date string, detail string>>, references array<struct<name string, title string, contact string>>>"
)
PACK = "struct<coverLetter string, email string, recruiter string>"
SALARY = "struct<postedMin double, postedMax double, postedText string, suggested double, note string>"
REPORT = "struct<gaps array<string>, matchBefore double, matchAfter double, roleFit double>"
_TEXTS = ("jobId", "jobFingerprint", "url", "deadline", "source", "location", "fileName", "strategy", "strategyLabel", "description", "note")
VERSION = (
    "struct<schema int, id string, company string, title string, appliedAt string, appliedOn string, updatedAt string, keywordsAdded array<string>, "
    + ", ".join(f"{c} string" for c in _TEXTS)
    + f", doc {RESUME}, pack {PACK}, salary {SALARY}, report {REPORT}>"
)
PRIVATE = {"resumeOverrides": ("headline", "summary", "experienceText", "projectsText"), "applicationPack": ("coverLetter", "email", "recruiter")}


def present(items: Column) -> Column:
    """Elements that are neither null nor blank; none of a null list."""
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def _parts(sep: str, *parts: Column) -> Column:
    return F.array_join(present(F.array(*parts)), sep)


def resume_document(profile: Column, headline: Column, contact: Column, summary: Column, experience_text: Column, projects_text: Column, overridden: Column | bool = False) -> Column:
    """A resume as plain data, from a profile struct (personal, skills, experience, projects,
    education, references) and the texts around it.  Nothing in it points back to the profile."""
    each = lambda field, build: F.transform(F.coalesce(profile[field], F.expr("array()")), build)
    t = text_or_empty
    return F.struct(
        F.lit(SCHEMA).alias("v"), t(profile["personal"]["fullName"]).alias("name"), t(headline).alias("headline"), t(contact).alias("contact"), t(summary).alias("summary"),
        each("skills", lambda g: F.struct(t(g["category"]).alias("category"), present(g["items"]).alias("items"))).alias("skillRows"),
        each("experience", lambda e: F.struct(_parts(", ", e["role"], e["company"], e["location"]).alias("title"), t(e["duration"]).alias("meta"), t(e["priorTitle"]).alias("priorTitle"), t(e["priorDuration"]).alias("priorDuration"), present(e["bullets"]).alias("bullets"))).alias("experience"),
        each("projects", lambda x: F.struct(_parts(", ", x["name"], x["subtitle"]).alias("title"), t(x["name"]).alias("name"), t(x["subtitle"]).alias("subtitle"), present(x["bullets"]).alias("bullets"))).alias("projects"),
        (F.lit(overridden) if isinstance(overridden, bool) else overridden).alias("overridden"), t(experience_text).alias("experienceText"), t(projects_text).alias("projectsText"),
        each("education", lambda e: F.struct(t(e["degree"]).alias("degree"), t(e["date"]).alias("date"), _parts("\n", e["institution"], _parts(" | ", e["score"], F.concat(F.lit("Expected graduation: "), F.nullif(e["expectedGraduation"], F.lit(""))))).alias("detail"))).alias("education"),
        F.transform(F.filter(F.coalesce(profile["references"], F.expr("array()")), lambda r: t(r["name"]) != ""), lambda r: F.struct(t(r["name"]).alias("name"), t(r["title"]).alias("title"), _parts(" | ", r["email"], r["phone"]).alias("contact"))).alias("references"),
    )


def is_resume(d: Column) -> Column:
    """Whether a document read with the schema RESUME is whole."""
    lists = {"skillRows": ("category", "items"), "experience": ("title", "bullets"), "projects": ("title", "bullets"), "education": ("degree",), "references": ()}
    ok = d.isNotNull()
    for c in ("name", "summary", "contact", "experienceText", "projectsText"):
        ok = ok & d[c].isNotNull()
    for c, needs in lists.items():
        whole = lambda x, needs=needs: F.aggregate(F.array(*[x[n].isNotNull() for n in needs], x.isNotNull()), F.lit(True), lambda a, b: a & b)
        ok = ok & d[c].isNotNull() & (F.forall(d[c], _one(whole)) if needs else F.lit(True))
    return F.coalesce(ok, F.lit(False))


def _one(f):
    """A function of one parameter, whatever defaults it has."""
    return lambda x: f(x)


def make_version(jobs: DataFrame, now: Column, **given: Column) -> DataFrame:
    """One version a row of ``jobs`` (columns that are missing are blank): texts as text, numbers as
    numbers or null, an id from the job, the time and the content, so a rerun gives the same one.
    ``given``: columns for keywordsAdded, doc, pack, report, suggested, salaryNote and the texts of a version."""
    have = set(jobs.columns)
    col = lambda c, kind="string": given[c] if c in given else F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    text = lambda c: F.trim(text_or_empty(col(c)))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    pack = given.get("pack", F.lit(None).cast(PACK))
    report = given.get("report", F.lit(None).cast(REPORT))
    strings = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), text_or_empty)
    from_job = {"jobId": "id", "jobFingerprint": "fingerprint"}
    out = {c: text_or_empty(col(from_job.get(c, c) if c not in given else c)) for c in _TEXTS if c != "note"} | {"note": F.lit("")}
    out |= {
        "schema": F.lit(SCHEMA), "company": text("company"), "title": text("title"), "appliedAt": stamp, "updatedAt": stamp, "appliedOn": F.date_format(now, "yyyy-MM-dd"),
        "keywordsAdded": strings(given.get("keywordsAdded")) if "keywordsAdded" in given else F.array().cast("array<string>"), "doc": given.get("doc", F.lit(None).cast(RESUME)),
        "pack": F.struct(*[text_or_empty(pack[c]).alias(c) for c in ("coverLetter", "email", "recruiter")]),
        "salary": F.struct(col("salaryMin", "double").alias("postedMin"), col("salaryMax", "double").alias("postedMax"), text_or_empty(col("salaryText")).alias("postedText"), col("suggested", "double").alias("suggested"), text_or_empty(col("salaryNote")).alias("note")),
        "report": F.struct(strings(report["gaps"]).alias("gaps"), *[report[c].alias(c) for c in ("matchBefore", "matchAfter", "roleFit")]),
    }
    version = jobs.select(*[v.alias(k) for k, v in out.items()])
    return version.withColumn("id", F.sha1(F.concat_ws("|", "jobId", "jobFingerprint", "appliedAt", content_of())))


def content_of() -> Column:
    """What makes two versions the same: document, texts, keywords and strategy, as JSON."""
    return F.to_json(F.struct("doc", "pack", "keywordsAdded", "strategy"), {"ignoreNullFields": "false"})


def is_version() -> Column:
    """Whether a row read with the schema VERSION is whole."""
    ok = (text_or_empty(F.col("id")) != "") & F.col("company").isNotNull() & F.col("title").isNotNull() & F.col("appliedAt").isNotNull() & text_or_empty(F.col("appliedOn")).rlike(r"^\d{4}-\d{2}-\d{2}$")
    ok = ok & F.col("keywordsAdded").isNotNull() & F.forall("keywordsAdded", lambda k: k.isNotNull())
    for c in ("coverLetter", "email", "recruiter"):
        ok = ok & F.col(f"pack.{c}").isNotNull()
    return F.coalesce(ok & is_resume(F.col("doc")), F.lit(False))


def normalize_versions(stored: DataFrame, value: str = "value", order: str = "seq") -> DataFrame:
    """(seq, value: a JSON record) -> whole versions, the first of each id, defaults filled in."""
    v = stored.select(F.col(order).alias("_seq"), F.from_json(value, VERSION).alias("v")).select("_seq", "v.*").where(is_version())
    first = F.row_number().over(Window.partitionBy("id").orderBy("_seq"))
    v = v.withColumn("_n", first).where("_n = 1").drop("_n", "_seq")
    filled = {c: text_or_empty(F.col(c)) for c in _TEXTS} | {"schema": F.coalesce("schema", F.lit(SCHEMA)), "updatedAt": F.coalesce("updatedAt", "appliedAt")}
    salary = F.struct(*[(text_or_empty(F.col(f"salary.{c}")) if c in ("postedText", "note") else F.col(f"salary.{c}")).alias(c) for c in ("postedMin", "postedMax", "postedText", "suggested", "note")])
    report = F.struct(F.coalesce("report.gaps", F.array().cast("array<string>")).alias("gaps"), *[F.col(f"report.{c}").alias(c) for c in ("matchBefore", "matchAfter", "roleFit")])
    return v.withColumns(filled | {"salary": salary, "report": report})


def version_line(company: Column, title: Column, applied_on: Column) -> Column:
    """One line for a list, with words for what is not known."""
    named = lambda c, otherwise: F.coalesce(F.nullif(c, F.lit("")), F.lit(otherwise))
    day = F.date_format(F.substring(applied_on.cast("string"), 1, 10).try_cast("date"), "d MMM yyyy")
    return F.concat_ws(" - ", named(company, "Unknown company"), named(title, "Unknown role"), F.concat(F.lit("applied "), text_or_empty(day)))


def storage_size(value: Column) -> Column:
    """Characters of a value as JSON."""
    return F.length(F.to_json(value, {"ignoreNullFields": "false"}))


def clean_private(entry: Column) -> Column:
    """A private entry (JSON text) as struct(resumeOverrides, applicationPack): overrides count
    only with all their texts, a pack with any; null where nothing is left."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(entry), path, "variant"))
    text = lambda a, b: F.when(kind(f"$.{a}.{b}") == "STRING", F.get_json_object(entry, f"$.{a}.{b}"))
    made = {a: F.struct(*[text(a, b).alias(b) for b in keys]) for a, keys in PRIVATE.items()}
    whole = lambda a, how: how(*[text(a, b).isNotNull().cast("int") for b in PRIVATE[a]]) == 1
    overrides = F.when(whole("resumeOverrides", F.least), made["resumeOverrides"])
    pack = F.when(whole("applicationPack", F.greatest), made["applicationPack"])
    return F.when(overrides.isNotNull() | pack.isNotNull(), F.struct(overrides.alias("resumeOverrides"), pack.alias("applicationPack")))


def normalize_private(stored: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """(id, JSON entry) -> id and its cleaned entry; entries with nothing left go."""
    return stored.select(key, clean_private(F.col(value)).alias("e")).where("e IS NOT NULL").select(key, "e.*")


#: Labels of form fields (patterns, the first that fits) and the profile's field they ask for.
FIELDS = [
    (r"first ?name|given ?name", "firstName"),
    (r"last ?name|surname|family ?name", "lastName"),
    (r"full ?name|^name$", "fullName"),
    (r"e-?mail", "email"),
    (r"phone|mobile|contact ?number", "phone"),
    (r"linked ?in", "linkedin"),
    (r"github", "github"),
    (r"address|city|location", "location"),
    (r"university|institution|college", "university"),
    (r"degree|qualification", "degree"),
    (r"cgpa|gpa|result", "cgpa"),
]


def field_of(label: Column, rules: list[tuple[str, str]] = FIELDS) -> Column:
    """The field a form's label asks for, by the first pattern that fits; null where none does."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        out = F.when(F.trim(text_or_empty(label)).rlike(f"(?i){pattern}"), name).otherwise(out)
    return out
