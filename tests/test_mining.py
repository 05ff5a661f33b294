"""Phrase mining and the lexicon's loader against plain versions."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.operators import keywords, mining

POST = """QA Engineer
Responsibilities:
Run load testing and thermal calibration for every release
Write test plans; thermal calibration of sensors
Requirements
Hands-on experience with wound dressing
Thermal calibration, IoT gateways and ISO9001 audits
Structural analysis
Strong knowledge of go and Go modules
Nice to have
Storyboarding
IoT gateways
We are an equal opportunity employer of gadget makers
About Acme Robotics
Gadget polishing gadget polishing
"""


def plain_terms(lines, stop, skip, most):
    """(seg, segment, tier, weight) of one document -> ranked terms, step by step."""
    seen = {}
    for _, segment, tier, weight in lines:
        text = keywords.plain_norm(segment)
        lead = bool(re.search(fixed.LEAD_IN, segment))
        short = len(segment.split()) <= 4 and not re.search(fixed.SENTENCE_START, segment)
        for part in re.split(fixed.PHRASE_BREAK, text):
            run, all_runs = [], []
            for w in part.split():
                w = re.sub("(?i)'s$", "", re.sub("^[^A-Za-z0-9+#]+|[^A-Za-z0-9+#]+$", "", w))
                if not w:
                    continue
                if len(w) < 2 or w.lower() in stop or re.match(r"\d", w) and not re.fullmatch(r"\d+[A-Za-z]{1,3}", w):
                    all_runs.append(run)
                    run = []
                else:
                    run.append(w)
            for r in [*all_runs, run]:
                if not r or len(r) > 4 or any(w.lower() in skip for w in r):
                    continue
                if len(r) == 1:
                    shape = bool(re.fullmatch("[A-Z][A-Z0-9&+]{1,6}", r[0]) and r[0] not in fixed.PLAIN_ACRONYMS or re.match("[a-z]+[A-Z]|[A-Z][a-z]+[A-Z]", r[0]))
                    if not shape and not (len(r[0]) >= 6 and re.search(fixed.NOUN_ENDING, r[0])):
                        continue
                else:
                    shape = all(re.match("[A-Z0-9]", w) for w in r)
                key = re.sub("([^s])s$", r"\1", re.sub("ies$", "y", " ".join(r).lower()))
                shown = " ".join(w if re.fullmatch("[A-Z0-9&+]+", w) or len(w) < 3 else w[0].upper() + w[1:] for w in r)
                t = seen.setdefault(key, {"forms": {}, "weights": [], "tiers": [], "pointed": False, "shape": False, "ord": len(seen), "n": len(r)})
                t["forms"][shown] = t["forms"].get(shown, 0) + 1
                t["weights"].append(weight)
                t["tiers"].append(tier)
                t["pointed"] |= lead or short and tier != "important"
                t["shape"] |= shape
    ok = {k: t for k, t in seen.items() if t["pointed"] or not (t["n"] == 1 and not t["shape"]) and len(t["weights"]) >= 2}
    kept = {k: t for k, t in ok.items() if not any(o["n"] > t["n"] and f" {k} " in f" {j} " and len(o["weights"]) >= len(t["weights"]) for j, o in ok.items())}
    rows = []
    for k, t in kept.items():
        score = sum(sorted(t["weights"])[-3:]) + (t["n"] > 1) + t["shape"]
        tier = min(t["tiers"], key=["must", "important", "nice"].index)
        rows.append((-score, t["ord"], k, max(t["forms"], key=lambda f: t["forms"][f]), len(t["weights"]), tier))
    return [(k, name, n, -s, tier) for s, _, k, name, n, tier in sorted(rows)[:most]]


def test_terms_against_plain_steps(spark):
    rng = random.Random(11)
    pool = "thermal calibration sensor sensors the of IoT gateways ISO9001 audit quality 24x7 3 wound-dressing it's QA batteries a/b supply chain Chain planning. (line) Robotics , and dhaka".split()
    rows = [(d, s, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 12))), *rng.choice([("must", 3), ("nice", 1), ("important", 2), ("important", 1)])) for d in range(12) for s in range(40)]
    rows += [(99, 0, "experience with spline reticulation", "important", 1), (98, 0, "", "must", 3)]
    lines = spark.createDataFrame(rows, "doc_id long, seg int, segment string, tier string, weight int")
    skip = ["dhaka", "robotics"]
    got = mining.accepted(mining.accumulate(mining.noted(mining.runs(lines), skip)), 14)
    by = {}
    for r in got.orderBy("doc_id", "rank").collect():
        by.setdefault(r["doc_id"], []).append((r["key"], r["name"], r["count"], r["score"], r["tier"]))
    for d in {r[0] for r in rows}:
        want = plain_terms([r[1:] for r in rows if r[0] == d], set(mining.STOP), set(skip), 14)
        assert by.get(d, []) == want, d


def test_runs_of_odd_words_are_cut_without_patterns_on_words(spark, monkeypatch):
    odd = ["It's Foo's bar'S 's 'S x's", "a|b | QA|", "C++ #1 3 24x7 24x 24xyzw 1st 2nd", "—— ** •", "", "  Kelvin \u212a's ſ's caf\u00e9\u00a0au lait's", "R & D + x.y z. End", "The THE tHe of", "Ünïcode Ünïcode's ß", "w" * 70_000 + " " + "ab cd " * 20_000, "thermal\u2028calibration\u0085 1ab\u2028's", "12ab's 12 - 13"]
    rng = random.Random(3)
    odd += [" ".join("".join(rng.choice("aB's+#9.,;|-é\u00a0/&") for _ in range(rng.randint(1, 5))) for _ in range(9)) for _ in range(1500)]
    rows = [(d, 0, t, "must", 3) for d, t in enumerate(odd)]
    d = mining.runs(spark.createDataFrame(rows, "doc_id long, seg int, segment string, tier string, weight int"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan  # each word of each line went through five patterns, by interpreted lambdas
    got = {}
    for r in d.orderBy("doc_id", "at").collect():
        got.setdefault(r["doc_id"], []).append(r["run"])
    blank = re.compile(keywords_ascii(fixed.PHRASE_BREAK))
    for n, text in enumerate(odd):
        want = []
        text = re.sub(r"[ \t\n\x0b\f\r]*/[ \t\n\x0b\f\r]*", "/", text.replace("‘", "'").replace("’", "'"))
        text = re.sub(r"[ \t\n\x0b\f\r\-‐-―_]+", " ", text).strip(" ")
        for part in blank.split(text):
            run = []
            for w in part.split(" "):
                w = re.sub("'[sS]$", "", re.sub("^[^A-Za-z0-9+#]+|[^A-Za-z0-9+#]+$", "", w))
                ends = w and (len(w) < 2 or w.lower() in mining.STOP or w[0] in "0123456789" and not re.fullmatch("[0-9]+[A-Za-z]{1,3}", w))
                if ends:
                    want, run = [*want, run], []
                elif w:
                    run.append(w)
            want.append(run)
        assert got.get(n, []) == [" ".join(r) for r in want if r], text
    lines = pa.array([o.replace("|", " | ") for o in odd])
    cut = lambda: mining._cut(frozenset([*mining.STOP, "24x"])).func(lines).to_pylist()
    whole = cut()
    monkeypatch.setattr(mining, "BYTES", 50)  # a few lines at a time
    assert cut() == whole and whole[2] == ["C++ #1", "1st 2nd"] and whole[3] == [] and len(whole) == len(odd)


def keywords_ascii(pattern: str) -> str:
    """A pattern whose blanks are Java's."""
    return pattern.replace(r"\s", r"[ \t\n\x0b\f\r]")


def test_a_whole_post(spark):
    lex = keywords.lexicon_table(spark, keywords.parse_lexicon(["#!tech", "#!group Code", "=Go|Golang", "# a remark", "Load Testing|Load Tests", "#!soft", "Teamwork", "#!tech", "#!group Papers", "ISO 9001|ISO9001!cert"]))
    docs = spark.createDataFrame([(1, "Load testing lead", POST, "Acme Robotics"), (2, None, None, None)], "doc_id long, title string, text string, company string")
    got = mining.extract_all(docs, lex).orderBy("rank").collect()
    by = {r["key"]: r for r in got}
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and {r["doc_id"] for r in got} == {1}
    assert got[0]["key"] == "load testing" and got[0]["inTitle"] and got[0]["tier"] == "must"
    assert by["go"]["count"] == 1 and by["iso 9001"]["tag"] == "cert"  # "go" in small letters is no hit
    assert by["m:thermal calibration"]["count"] == 3 and by["m:thermal calibration"]["source"] == "mined"
    assert {"m:wound dressing", "m:iot gateway", "m:structural analysi"} <= set(by)
    assert not any("gadget" in k or "acme" in k or "iso9001" in k for k in by)
    assert mining.extract_all(docs.where("false"), lex).count() == 0
    graded = {r["key"]: r["evidence"] for r in keywords.evidence(mining.extract_all(docs, lex), lex, "GOLANG; thermal calibrations", "iot gateways").collect()}
    assert graded["go"] == "skills" and graded["m:thermal calibration"] == "skills" and graded["m:iot gateway"] == "prose" and graded["load testing"] == "none"


def test_lexicon_file(spark, tmp_path):
    f = tmp_path / "lexicon.txt"
    f.write_text("#!degree\n#!group Education\nBachelor's degree|BSc\n\n# note\n#!tech\n#!group Languages\n=R!lang\n")
    rows = keywords.read_lexicon(spark, str(f)).orderBy("entry", "rank").collect()
    assert [(r["key"], r["kind"], r["grp"], r["tag"], r["alias"]) for r in rows] == [("bachelor's degree", "degree", "Education", None, "Bachelor's degree"), ("bachelor's degree", "degree", "Education", None, "BSc"), ("r", "tech", "Languages", "lang", "R")]
    net = keywords.lexicon_table(spark, keywords.parse_lexicon([".NET|dot net", "Index"]))
    dots = spark.createDataFrame([(1, 0, "ASP and .NET"), (1, 1, "network of indexes"), (1, 2, "internet")], "doc_id long, seg int, segment string")
    assert {(h["seg"], h["key"]) for h in keywords.hits(dots, net).collect()} == {(0, ".net"), (1, "index")}
    segs = spark.createDataFrame([(1, 0, "R and r"), (1, 1, "r only"), (1, 2, "two BSCs")], "doc_id long, seg int, segment string")
    assert {(h["seg"], h["key"]) for h in keywords.hits(segs, keywords.read_lexicon(spark, str(f))).collect()} == {(0, "r"), (2, "bachelor's degree")}


def test_keyword_hits(spark):
    d = spark.createDataFrame([("SQL, test-cases and Java",), ("MySQL JavaScript",), (None,)], "t string")
    assert [r[0] for r in d.select(keywords.keyword_hits(F.col("t"), ["SQL", "Test Case", "Java"])).collect()] == [3, 0, 0]
