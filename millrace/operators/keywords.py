"""Keywords of posts: lexicon hits by segment and section, tiers, evidence, requirement groups.

The lexicon is a table (key, name, kind, grp, tag, aliases); ``LEXICON`` is a small one of our
own.  Hits are an equality join on the first word of an alias and a residual whole-word test,
so their cost follows the matches and not segments times entries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import text_or_empty

#: key -> (kind, group, tag, aliases); the first alias is the name.
LEXICON: dict[str, tuple[str, str, str | None, list[str]]] = {
    "python": ("tech", "Programming", None, ["Python"]),
    "sql": ("tech", "Databases", None, ["SQL"]),
    "apache spark": ("tech", "Data Engineering", None, ["Apache Spark", "PySpark", "Spark SQL"]),
    "java": ("tech", "Programming", None, ["Java"]),
    "javascript": ("tech", "Programming", None, ["JavaScript", "ECMAScript"]),
    "docker": ("tech", "Operations", None, ["Docker"]),
    "kubernetes": ("tech", "Operations", None, ["Kubernetes", "k8s"]),
    "test automation": ("tech", "Testing", None, ["Test Automation", "Automated Testing"]),
    "test case": ("tech", "Testing", None, ["Test Case"]),
    "excel": ("tech", "Office", None, ["Excel", "Microsoft Excel", "MS Excel"]),
    "communication": ("soft", "People", None, ["Communication", "Communication Skill"]),
    "teamwork": ("soft", "People", None, ["Teamwork", "Team Player"]),
    "english": ("tech", "Languages", "lang", ["English"]),
    "fintech": ("tech", "Fields", "domain", ["Fintech", "Financial Technology"]),
    "pmp": ("tech", "Certificates", "cert", ["PMP"]),
    "bachelor's degree": ("degree", "Education", None, ["Bachelor's Degree", "BSc", "Bachelor of Science"]),
}

EDGE = "[A-Za-z0-9+#]"
#: The original reads so many characters of a post; ``most_chars`` sets such a bound.
MOST_CHARS, MOST_BROADCAST = 60_000, 20_000


def norm(c: Column) -> Column:
    """Straight quotes, no space around slashes, dashes and underscores as spaces."""
    c = F.regexp_replace(F.regexp_replace(text_or_empty(c), "[‘’]", "'"), r"\s*/\s*", "/")
    return F.trim(F.regexp_replace(c, r"[\s\-‐-―_]+", " "))


def plain_norm(s: str) -> str:
    s = re.sub(r"\s*/\s*", "/", s.replace("‘", "'").replace("’", "'"))
    return re.sub(r"[\s\-‐-―_]+", " ", s).strip()


def phrase_pattern(phrase: str, case: bool = False) -> str:
    """Whole words, with an optional plural where the phrase ends in a letter."""
    plural = "(?:s|es)?" if phrase[-1:].isalpha() else ""
    return rf"(?<!{EDGE})(?{'' if case else 'i'}:{re.escape(plain_norm(phrase))}{plural})(?!{EDGE})"


def parse_lexicon(lines: list[str]) -> dict[str, tuple[str, str, str | None, list[str]]]:
    """A lexicon from text: an entry a line, its wordings parted by ``|``, ``=`` before one that
    counts in its own case only, ``!cert``, ``!domain`` or ``!lang`` at the end for a tag.
    ``#!group NAME`` and ``#!KIND`` hold for the lines that follow; other ``#`` lines are remarks."""
    kind, group, out = "tech", "General", {}
    for line in map(str.strip, lines):
        order, _, name = line.partition("#!")[2].partition(" ")
        if order == "group":
            group = name.strip()
        elif order and line.startswith("#!"):
            kind = line[2:].strip()
        elif line and not line.startswith("#"):
            body, tag = next(((line.removesuffix(f"!{t}"), t) for t in ("cert", "domain", "lang") if line.endswith(f"!{t}")), (line, None))
            wordings = [w.strip() for w in body.split("|") if w.strip()]
            out[wordings[0].lstrip("=").lower()] = (kind, group, tag, wordings)
    return out


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The lexicon of a text file (:func:`parse_lexicon`), from any store Spark reads."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]  # one file, one row
    return lexicon_table(spark, parse_lexicon("\n".join(lines).splitlines()))


def lexicon_table(spark: SparkSession, lexicon: dict = LEXICON) -> DataFrame:
    """(key, name, kind, grp, tag, entry, alias, rank, first, pattern, any_case): one row an alias,
    longest first.  Up to MOST_BROADCAST rows (well under 1 KB each) it is broadcast in joins."""
    rows = []
    for entry, (key, (kind, group, tag, aliases)) in enumerate(lexicon.items()):
        shown = [(a.removeprefix("="), a.startswith("=")) for a in aliases]
        for rank, (a, case) in enumerate(sorted(shown, key=lambda x: -len(plain_norm(x[0])))):
            rows.append((key, shown[0][0], kind, group, tag, entry, a, rank, "".join(re.findall(r"[a-z0-9+#]+", plain_norm(a).lower())[:1]), phrase_pattern(a, case), phrase_pattern(a)))
    table = spark.createDataFrame(rows, "key string, name string, kind string, grp string, tag string, entry int, alias string, rank int, first string, pattern string, any_case string")
    return F.broadcast(table) if len(rows) <= MOST_BROADCAST else table


def segments(docs: DataFrame, text: str = "text", most_chars: int | None = None) -> DataFrame:
    """(doc_id, seg long, segment): lines and bullets; those over 180 characters cut at sentence ends."""
    whole = text_or_empty(F.col(text))
    whole = whole if most_chars is None else F.substring(whole, 1, most_chars)
    lines = F.split(F.regexp_replace(F.regexp_replace(whole, "\r", ""), "[‘’]", "'"), "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"\s*[•▪◦●·]\s*")))
    parts = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^[\s*\-–—]+", ""))), lambda p: p != "")
    parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > 180, F.split(p, r"(?<=[.!?;])\s+(?=[A-Z0-9(])")).otherwise(F.array(p))))
    return docs.select("doc_id", F.posexplode(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")).alias("seg", "segment"))


def section_type(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(fixed.SECTIONS):
        out = F.when(c.rlike(rf"(?i)\b({pattern})\b"), name).otherwise(out)
    return out


def heading(segment: Column, has_skill: Column) -> Column:
    """struct(type, rest, inline, skip), null where the line is no heading."""
    label, rest = (F.trim(F.regexp_extract(segment, r"^([^:]{2,60}?):\s*(.*)$", k)) for k in (1, 2))
    t = F.regexp_replace(segment, r"[\s:]+$", "")
    title_case = F.forall(F.split(t, r"\s+"), lambda w: w.rlike("^[A-Z&(]") | w.isin("of", "and", "the", "for", "to", "in", "a", "an", "or"))
    short = ~has_skill & (F.size(F.split(t, r"\s+")) <= 5) & (F.length(t) <= 48) & ~t.rlike("[.!?,;]$") & title_case
    about = t.rlike(r"^About\s") & ~t.rlike("(?i)^About (?:you|the (?:role|job|position)|this (?:role|job|position))$")
    make = lambda kind, r, inline, skip: F.struct(kind.alias("type"), r.alias("rest"), inline.alias("inline"), F.lit(skip).alias("skip"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    labelled = F.when(label.rlike(fixed.PLAIN_LABELS), make(none, F.lit(""), no, True)).when(section_type(label).isNotNull(), make(section_type(label), rest, rest != "", False))
    titled = F.when(about, make(F.lit("ignore"), F.lit(""), no, False)).when(section_type(t).isNotNull(), make(section_type(t), F.lit(""), no, False))
    phrase = ~has_skill & (F.size(F.split(t, r"\s+")) <= 6) & t.rlike(fixed.PHRASES)
    kind = F.when(t.rlike("(?i)^(?:how we work|why )"), "ignore").otherwise(section_type(t))
    said = F.when(kind.isNotNull(), make(kind, F.lit(""), no, False))
    return F.when(segment.rlike("^[^:]{2,60}?:"), labelled).when(phrase, said).when(short, titled)


def hits(segs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, seg, key, alias): the longest alias of each entry that a segment holds.

    A line's words meet the first words of aliases, in singular and plural, by an equality join;
    the few that meet are tested as whole phrases."""
    s = segs.select("doc_id", "seg", norm(F.col("segment")).alias("n"))
    words = s.withColumn("first", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("n"), F.lit("[a-z0-9+#]+"), F.lit(0)))))
    forms = lexicon.select("key", "alias", "rank", "pattern", F.explode(F.array("first", F.concat("first", F.lit("s")), F.concat("first", F.lit("es")))).alias("first"))
    found = words.join(forms, "first").where(F.rlike("n", F.col("pattern")))
    return found.groupBy("doc_id", "seg", "key").agg(F.min_by("alias", "rank").alias("alias"))


def governed(segs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, seg, segment, section): headings read, lines under an ignored one dropped.

    A heading governs what follows, ``Label: rest`` its own line; a heading-like line without a
    known section or skill ends an ignored section.  Read in order by a fold over a document's
    events.
    """
    known = hits(segs, lexicon).select("doc_id", "seg").distinct().withColumn("_hit", F.lit(True))
    h = segs.join(known, ["doc_id", "seg"], "left").withColumn("h", heading(F.col("segment"), F.col("_hit").isNotNull()))
    plain = F.col("_hit").isNull() & F.col("segment").rlike(fixed.HEADING_LIKE) & (F.size(F.split("segment", r"\s+")) <= 6)
    equal = F.col("segment").rlike(fixed.EQUAL)
    event = F.when(equal, "ignore").when(F.col("h").isNull() & plain, "leave").when(F.col("h.type").isNotNull() & ~F.col("h.inline"), F.col("h.type")).otherwise("")
    w = Window.partitionBy("doc_id").orderBy("seg")
    # "leave" counts only in an ignored section: the state after each event is that of the last event that
    # is no "leave", unless that one is "ignore" and a "leave" came later
    ev = h.withColumn("ev", event).withColumn("set", F.last(F.when(~F.col("ev").isin("", "leave"), F.struct("seg", "ev")), True).over(w))
    ev = ev.withColumn("left", F.last(F.when(F.col("ev") == "leave", F.col("seg")), True).over(w))
    state = F.when((F.col("set.ev") == "ignore") & (F.col("left") > F.col("set.seg")), "other").otherwise(F.coalesce("set.ev", F.lit("other")))
    ev = ev.withColumn("section", F.when(F.col("h.inline"), F.col("h.type")).otherwise(state))
    body = F.when(F.col("h").isNotNull(), F.col("h.rest")).otherwise(F.col("segment"))
    gone = equal | F.coalesce(F.col("h.skip"), F.lit(False)) | ((F.col("ev") == "leave") & (F.col("set.ev") == "ignore"))
    return ev.where(~gone).select("doc_id", "seg", body.alias("segment"), "section").where("segment <> '' AND section <> 'ignore'")


def years_near(c: Column) -> Column:
    n = F.regexp_extract(c, fixed.YEARS, 1).try_cast("int")
    return F.when(~c.rlike(fixed.AGE) & n.between(1, 25), n)


def tiered(lines: DataFrame) -> DataFrame:
    """Add tier and weight by cues first, then the section; and years asked near."""
    nice = F.col("segment").rlike(fixed.CUE_NICE) | (F.col("section") == "preferred")
    must = F.col("segment").rlike(fixed.CUE_MUST) | (F.col("section") == "required")
    tier = F.when(nice, "nice").when(must, "must").otherwise("important")
    weight = F.when(nice, 1).when(must, 3).when(F.col("section") == "duties", 2).otherwise(1)
    return lines.withColumns({"tier": tier, "weight": weight, "years": years_near(F.col("segment"))})


def tier_rank(c: Column) -> Column:
    return F.when(c == "must", 0).when(c == "important", 1).otherwise(2)


def extract(docs: DataFrame, lexicon: DataFrame, title: str = "title", text: str = "text", most_chars: int | None = None) -> DataFrame:
    """Lexicon keywords of each document: key, display, count, score (the first three weights,
    and 3 once for the title), tier, inTitle, yearsRequired."""
    lines = tiered(governed(segments(docs, text, most_chars), lexicon))
    body = hits(lines, lexicon).join(lines, ["doc_id", "seg"]).select("doc_id", "key", "alias", F.col("seg").cast("long").alias("at"), "weight", "tier", "years", F.lit(False).alias("t"))
    head = docs.select("doc_id", F.lit(-1).alias("seg"), F.col(title).alias("segment")) if title in docs.columns else None
    if head is not None:
        body = body.unionByName(hits(head, lexicon).select("doc_id", "key", "alias", F.lit(-1).cast("long").alias("at"), F.lit(3).alias("weight"), F.lit("must").alias("tier"), F.lit(None).cast("int").alias("years"), F.lit(True).alias("t")))
    n = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("at"))
    out = body.withColumn("n", n).groupBy("doc_id", "key").agg(
        F.max_by("alias", F.struct(F.length("alias"), -F.col("at"))).alias("display"),
        F.count("*").alias("count"),
        (F.sum(F.when(F.col("n") <= 3, F.col("weight")).otherwise(0)) + F.when(F.bool_or("t"), 3).otherwise(0)).alias("score"),
        F.min(tier_rank(F.col("tier"))).alias("r"),
        F.bool_or("t").alias("inTitle"),
        F.max("years").alias("yearsRequired"),
        F.min("at").alias("at"),
    )
    tier = F.element_at(F.array(*map(F.lit, ("must", "important", "nice"))), F.col("r") + 1)
    dim = lexicon.where("rank = 0").select("key", "name", "kind", "grp", "tag", "entry")
    return out.withColumn("tier", tier).drop("r").join(dim, "key")


def ranked(keywords: DataFrame) -> DataFrame:
    """By score, then tier, then the place where a keyword was first found."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), tier_rank(F.col("tier")), "at", "entry")
    return keywords.withColumn("rank", F.row_number().over(w))


def evidence(keywords: DataFrame, lexicon: DataFrame, skills: str, prose: str) -> DataFrame:
    """Add ``evidence``: skills, prose or none, by the entry's aliases (in any case) in the
    profile's texts; a mined term's by its own wording."""
    in_text = lambda t: F.bool_or(F.rlike(F.lit(plain_norm(t)), F.col("any_case")))
    grade = lexicon.groupBy("key").agg(F.when(in_text(skills), "skills").when(in_text(prose), "prose").otherwise("none").alias("_grade"))
    own = lambda t: F.rlike(F.lit(plain_norm(t)), whole_word(F.col("display")))
    said = F.when(own(skills), "skills").when(own(prose), "prose").otherwise("none")
    out = keywords.join(grade, "key", "left").withColumn("evidence", F.coalesce("_grade", said)).drop("_grade")
    return out.withColumn("have", F.col("evidence") != "none")


def whole_word(phrase: Column) -> Column:
    """The pattern of a phrase in a column, as :func:`phrase_pattern` makes it."""
    plural = F.when(phrase.rlike("[A-Za-z]$"), F.lit("(?:s|es)?")).otherwise("")
    return F.concat(F.lit(rf"(?i)(?<!{EDGE})"), F.regexp_replace(norm(phrase), r"([.*+?^${}()|\[\]\\])", r"\\$1"), plural, F.lit(rf"(?!{EDGE})"))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the phrases a text holds as whole words."""
    n = norm(text)
    return sum((n.rlike(phrase_pattern(k)).cast("int") for k in keywords), F.lit(0))


def coverage(keywords: DataFrame, text: str) -> DataFrame:
    """Per document: found, total, mustFound, mustTotal and the missing, by the post's own wording."""
    k = keywords.where("kind <> 'degree'")
    k = k.withColumn("hit", F.rlike(F.lit(plain_norm(text)), whole_word(F.col("display"))))
    must = F.col("tier") == "must"
    return k.groupBy("doc_id").agg(
        F.count_if("hit").alias("found"), F.count("*").alias("total"), F.count_if(F.col("hit") & must).alias("mustFound"), F.count_if(must).alias("mustTotal"),
        F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("display")))).alias("missing"),
    )


def requirement_groups(keywords: DataFrame) -> DataFrame:
    """(doc_id, grp_name, matched, total) of the skill groups; keywords carry ``evidence``."""
    plain = F.col("kind") != "degree"
    member = {
        "required": plain & F.col("tier").isin("must", "important"),
        "preferred": plain & (F.col("tier") == "nice"),
        "tools": plain & F.col("tag").isNull() & (F.col("kind") != "soft"),
        "domain": plain & (F.col("tag") == "domain"),
        "certifications": plain & (F.col("tag") == "cert"),
        "language": plain & (F.col("tag") == "lang"),
    }
    groups = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in member.items()]))
    k = keywords.withColumn("grp_name", F.explode(groups))
    return k.groupBy("doc_id", "grp_name").agg(F.count_if(F.col("evidence") == "skills").alias("matched"), F.count("*").alias("total"))


def responsibilities(docs: DataFrame, lexicon: DataFrame, limit: int = 8, text: str = "text") -> DataFrame:
    """The first distinct duty lines of each document."""
    d = governed(segments(docs, text), lexicon).where((F.col("section") == "duties") & (F.length("segment") >= 8))
    d = d.groupBy("doc_id", "segment").agg(F.min("seg").alias("seg"))
    return d.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg"))).where(F.col("n") <= limit)


def labelled_line(segs: DataFrame, label: str) -> DataFrame:
    """The first ``Label: rest`` line of each document whose label matches."""
    at = lambda k: F.trim(F.regexp_extract("segment", r"^([^:]{2,40}):\s*(.+)$", k))
    return segs.where(at(1).rlike(rf"(?i)^({label})$")).groupBy("doc_id").agg(F.min_by(at(2), "seg").alias("line"))


def compare_years(text: Column, have: int) -> Column:
    """match, gap or unknown, by the years a text asks for."""
    need = F.when(~text_or_empty(text).rlike(fixed.AGE), F.regexp_extract(text_or_empty(text), fixed.YEARS, 1).try_cast("int"))
    return F.when(need.isNull(), F.when(text.rlike("(?i)fresher"), "match").otherwise("unknown")).when(need <= have, "match").otherwise("gap")


def compare_salary(low: Column, high: Column, expected: int | None) -> Column:
    top = F.coalesce(high, low)
    if not expected:
        return F.lit("unknown")
    return F.when(top.isNull(), "unknown").when(top >= expected, "match").otherwise("gap")


def compare_education(keywords: DataFrame, levels: tuple[str, ...] = ("bachelor's degree", "master's degree", "diploma", "ssc", "hsc")) -> DataFrame:
    """Per document with degrees: match, partial (level or field alone) or gap."""
    d = keywords.where("kind = 'degree'").withColumn("lvl", F.col("key").isin(*levels)).withColumn("ok", F.col("evidence") == "skills")
    g = d.groupBy("doc_id").agg(F.count_if("lvl").alias("l"), F.count_if(~F.col("lvl")).alias("f"), F.count_if(F.col("lvl") & F.col("ok")).alias("hl"), F.count_if(~F.col("lvl") & F.col("ok")).alias("hf"))
    level, fld = F.col("hl") > 0, F.col("hf") > 0
    state = F.when(F.col("f") == 0, F.when(level, "match").otherwise("gap")).when(fld, F.when((F.col("l") == 0) | level, "match").otherwise("partial")).when(level, "partial").otherwise("gap")
    return g.select("doc_id", state.alias("state"))


def suggest_salary(low: Column, high: Column, expected: Column) -> Column:
    """struct(state, amount): unknown, anchor, below or inside; inside is the expectation kept in the range."""
    bottom, top = F.coalesce(low, high), F.coalesce(high, low)
    state = F.when(expected.isNull() & top.isNull(), "unknown").when(top.isNull() | expected.isNull(), "anchor").when(top < expected, "below").otherwise("inside")
    value = F.when(top.isNull() | (top < expected), expected).when(expected.isNull(), bottom).otherwise(F.least(F.greatest(expected, bottom), top))
    return F.struct(state.alias("state"), value.alias("amount"))
