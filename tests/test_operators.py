"""Operators on small tables whose answers are stated."""

from pyspark.sql import functions as F

from millrace.operators import dedupe, graph, keywords, scoring, state, versions
from millrace.plans import catalogue


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and {got[i] for i in (100, 200, 300)} == {100} and len(got) == 63
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def post(seq, title, company, url="", description="", **more):
    blank = {"area": "", "source": "A", "requiredSkills": "", "salaryMin": None, "salaryMax": None, "salaryText": "", "deadline": None, "employmentType": "", "experienceText": "", "distanceKm": None, "postedAt": None}
    return {"seq": seq, "title": title, "company": company, "url": url, "description": description, **blank, **more}


SCHEMA = "seq long, title string, company string, url string, description string, area string, source string, requiredSkills string, salaryMin int, salaryMax int, salaryText string, deadline string, employmentType string, experienceText string, distanceKm double, postedAt string"


def rows(spark, posts):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(p[n] for n in names) for p in posts], SCHEMA)


def test_deduplicate(spark):
    long = "We test web systems with care and write clear reports about every defect found in them today"
    posts = [
        post(1, "SQA Engineer", "Brindlework IT Ltd.", "https://a.example/1?utm_x=1", "short", source="A"),
        post(2, "Software Quality Assurance Engineer", "Brindlework Limited", "https://b.example/2", long, source="B", salaryMin=20000, salaryText="Tk 20,000"),
        post(3, "Cook", "Brindlework", "https://c.example/3", "stews"),
        post(4, "Chef de partie", "Elsewhere", "https://a.example/1", "copied link"),
        post(5, "SQA Engineer", "Other", "https://e.example/5", "short", area="Banani", distanceKm=4.0),
    ]
    got = {r["seq"]: r for r in dedupe.deduplicate(rows(spark, posts)).collect()}
    assert set(got) == {2, 3, 5}
    assert got[2]["n_merged"] == 3 and got[2]["source"] == "A + B" and got[2]["salaryMin"] == 20000
    assert len(got[2]["sources"]) == 2


def test_near_edges_against_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(8)
    words = "audit build cloud data email finance graph hotel image journal".split()
    posts = []
    for i in range(120):
        title = " ".join(rng.sample(words, rng.randint(1, 6)))
        text = " ".join(rng.choice(words) for _ in range(12)) if i % 3 else "same long text about careful daily testing of web systems " + rng.choice(words)
        posts.append(post(i, title, rng.choice(["Acme", "Bolt"]), f"https://x.example/{i}", text))
    keyed = dedupe.canonical(rows(spark, posts)).cache()
    k = keyed.select("seq", "norm_company", "title_tokens", "sim").collect()

    def near(p, q):
        a, b = set(p["title_tokens"]), set(q["title_tokens"])
        close = a and b and len(a & b) / len(a | b) >= 0.72
        body = p["sim"] and q["sim"] and ((p["sim"] ^ q["sim"]) & ((1 << 64) - 1)).bit_count() <= 6
        return p["norm_company"] == q["norm_company"] and (close or (body and a & b))

    def roots(edges):
        root = {r["seq"]: r["seq"] for r in k}
        for _ in range(len(k)):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    want = [(p["seq"], q["seq"]) for p, q in itertools.combinations(k, 2) if near(p, q)]
    got = [(r["a"], r["b"]) for r in dedupe.near_edges(keyed).collect()]
    assert roots(got) == roots(want)  # edges span the links, an edge need not be one


def test_simhash_of_few_words(spark):
    df = spark.createDataFrame([("",), ("ab",), ("alpha beta",), ("alpha beta gamma delta",)], "t string")
    got = [r[0] for r in df.select(dedupe.simhash(F.col("t"))).collect()]
    assert got[0] == got[1] == 0 and got[2] != 0 and got[3] != got[2]


PROFILE = scoring.Profile(titles=["QA Engineer"], skills=["Selenium", "SQL"], categories=["Testing"], minimum=50, strong=65, years=0, excluded=["Lead"])


def test_scores_and_gates(spark):
    df = spark.createDataFrame(
        [
            (1, "QA Engineer", "Selenium and SQL", "Testing", "", 30000, None, "Dhaka", "Banani", 4.0),
            (2, "QA Engineer", "", "Other", "5 years", 10000, 12000, "Dhaka", "Savar", 25.0),
            (3, "Lead Cook", "", "Other", "", None, None, "London, UK", "", None),
            (4, "Leadership Trainee Program", "", "Other", "", None, None, "Dhaka", "", None),
        ],
        "id int, title string, description string, category string, experienceText string, salaryMin int, salaryMax int, location string, area string, distanceKm double",
    ).withColumn("requiredSkills", F.lit(""))
    got = {r["id"]: r for r in scoring.score_postings(df, PROFILE, min_salary=20000, max_km=10).collect()}
    assert (got[1]["titleFit"], got[1]["levelFit"], got[1]["skillFit"], got[1]["prefFit"]) == (100, 65, 33, 100)
    assert got[1]["matchScore"] == (40 * 100 + 25 * 65 + 25 * 33 + 10 * 100 + 50) // 100 and got[1]["priority"] == "A"
    assert got[2]["priority"] == "C" and got[2]["gateNotes"][0].startswith("Pay tops out at Tk 12,000") and "25.0 km out" in got[2]["gateNotes"][1]
    assert got[3]["gateNotes"][-2:] == ["Based in UK, outside Bangladesh", "Title matches your excluded list (Lead)"]
    assert not any("excluded" in n for n in got[4]["gateNotes"])


def test_priority_bars(spark):
    df = spark.createDataFrame([(s,) for s in (66, 65, 64, 50, 49)], "s int")
    assert [r[0] for r in df.select(scoring.priority(F.col("s"), F.lit(False), 50, 65)).collect()] == ["A", "A", "B", "B", "C"]


def test_profile_shapes():
    p = scoring.Profile.from_json({"skills": {"technical": ["SQL"], "tools": ["Git"]}, "preferences": {"titles": ["QA"], "minimumMatch": 40}})
    q = scoring.Profile.from_json({"skills": [{"category": "x", "items": ["SQL", "Git"]}], "preferences": {"titles": ["QA"], "minimumMatch": 40}})
    assert p == q and p.evidence == "sql git"


def test_merge_keeps_decisions_and_expires(spark):
    cols = "fingerprint string, id string, status string, createdAt string, deadline string"
    fresh = spark.createDataFrame([("a", "1", "Awaiting Review", "2026-10-09", None), ("n", "2", "Awaiting Review", "2026-10-09", None), ("x", "3", "Awaiting Review", "2026-10-09", "2026-01-01")], cols)
    prev = spark.createDataFrame([("a", "old", "Awaiting Review", "2026-09-01", None), ("s", "4", "Saved", "2020-01-01", None), ("g", "5", "Rejected", "2026-10-01", None)], cols)
    ledger = spark.createDataFrame([("a", "2026-09-01", "Rejected", True, "2026-10-01")], "fingerprint string, first_seen string, status string, notified boolean, last_seen string")
    feed, after, new = state.merge_feed(fresh, prev, ledger, F.lit("2026-10-10").cast("date"))
    got = {r["fingerprint"]: r for r in feed.collect()}
    assert set(got) == {"a", "n", "s"} and got["a"]["status"] == "Rejected" and got["a"]["id"] == "old" and got["a"]["createdAt"] == "2026-09-01"
    assert {r[0] for r in new.collect()} == {"n", "x"}
    led = {r["fingerprint"]: r for r in after.collect()}
    assert set(led) == {"a", "n", "x"} and led["a"]["notified"] and led["n"]["last_seen"] == "2026-10-10"


def test_health_fires_once_a_streak(spark):
    runs = [("s", i, 0, 1, None) for i in range(1, 7)] + [("s", 7, 3, 0, 3)] + [("s", i, 0, 0, 0) for i in range(8, 12)] + [("q", i, 0, 0, None) for i in range(1, 9)]
    got = state.health(spark.createDataFrame(runs, "source string, run int, found int, n_errors int, raw int")).collect()
    assert [(r["source"], r["run"]) for r in got if r["alert"]] == [("s", 4), ("s", 11)]


def test_versions(spark):
    v = spark.createDataFrame([("1", "j", "f", 1, "x", "p"), ("2", "j", "f", 2, "x", "p"), ("3", "j", "f", 3, "y", "p"), ("4", "j", "f", 4, "x", "q")], "id string, jobId string, jobFingerprint string, appliedAt int, doc string, note string")
    assert [r["id"] for r in versions.changed_versions(v, "jobId", "appliedAt", ["doc"]).orderBy("id").collect()] == ["1", "3", "4"]
    d = {r["id"]: r["changed"] for r in versions.diff_versions(v, "jobId", "appliedAt", {"doc": "Document", "note": "Note"}).collect()}
    assert d == {"1": None, "2": [], "3": ["Document"], "4": ["Document", "Note"]}
    jobs = spark.createDataFrame([("j", ""), ("k", "f"), ("", "")], "id string, fingerprint string")
    assert versions.versions_for(v, jobs).count() == 8


def test_private(spark):
    rows_ = spark.createDataFrame([("a", "x", None), ("b", None, "y")], "id string, p string, q string")
    assert {r["id"] for r in versions.with_private(rows_, "id", "a", "p", F.lit(None).cast("string")).collect()} == {"b"}


def test_tiers(spark):
    d = spark.createDataFrame([(1, None, "Skills: Python\nWe also use Docker\nNice to have\nKubernetes\nAbout Us\nSQL everywhere"), (2, "Python Engineer", ""), (3, None, None)], "doc_id long, title string, text string")
    lex = keywords.lexicon_table(spark)
    got = {(r["doc_id"], r["key"]): r for r in keywords.extract(d, lex).collect()}
    assert {k: r["tier"] for k, r in got.items()} == {(1, "python"): "must", (1, "docker"): "important", (1, "kubernetes"): "nice", (2, "python"): "must"}
    assert got[(2, "python")]["score"] == 6 and got[(2, "python")]["inTitle"]
    k = keywords.evidence(keywords.extract(d, lex), lex, "Python and SQL", "ran Docker")
    assert {r["key"]: r["evidence"] for r in k.where("doc_id = 1").collect()} == {"python": "skills", "docker": "prose", "kubernetes": "none"}
    c = keywords.coverage(k, "docker, pythons").where("doc_id = 1").first()
    assert (c["found"], c["total"], c["mustFound"], c["mustTotal"], c["missing"]) == (2, 3, 1, 1, ["Kubernetes"])


def test_equal_opportunity_ends_the_post(spark):
    d = spark.createDataFrame([(1, "Requirements\nPython\nWe are an equal opportunity employer.\nDocker\nHow we work\nSQL\nWhat you'll need\nExcel")], "doc_id long, text string")
    assert {r["key"] for r in keywords.extract(d, keywords.lexicon_table(spark)).collect()} == {"python", "excel"}


def test_java_is_not_javascript(spark):
    d = spark.createDataFrame([(1, "JavaScript only"), (2, "Java, MySQL")], "doc_id long, text string")
    got = {(r["doc_id"], r["key"]) for r in keywords.extract(d, keywords.lexicon_table(spark)).collect()}
    assert got == {(1, "javascript"), (2, "java")}


def test_catalogue_has_sql_for_most():
    assert len(catalogue.queries()) > 40 and set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_linked_against_all_pairs(spark, monkeypatch):
    import random

    from millrace.operators import near
    from millrace.operators.graph import components

    rng = random.Random(4)
    sigs = []
    for c in range(25):
        base = rng.getrandbits(64)
        for _ in range(12):
            s = base
            for b in rng.sample(range(64), rng.choice([0, 1, 3, 6, 7, 9])):
                s ^= 1 << b
            sigs.append((c % 3, s))
    hot = rng.getrandbits(64)
    sigs += [(0, hot ^ i << 7) for i in range(60)]
    df = spark.createDataFrame([(g, i, s - (1 << 64) if s >> 63 else s) for i, (g, s) in enumerate(sigs)], "g int, node long, sig long")
    label = list(range(len(sigs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sigs)):
        for j in range(i):
            if sigs[i][0] == sigs[j][0] and (sigs[i][1] ^ sigs[j][1]).bit_count() <= 6:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    want = [root(i) for i in range(len(sigs))]
    for block in (512, 8):
        got = {r["node"]: r["root"] for r in components(near.linked(df, ["g"], 6, block)).collect()}
        assert [got.get(i, i) for i in range(len(sigs))] == want


def test_one_company_with_many_postings(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("seq"), F.lit("one").alias("norm_company"), F.array(F.lit("engineer"), F.concat(F.lit("t"), F.col("id") % 5000)).alias("tokens"), F.xxhash64("id").alias("sim"))
    near_copy = spark.range(50).select((F.col("id") + n).alias("seq"), F.lit("one").alias("norm_company"), F.array(F.lit("engineer")).alias("tokens"), F.xxhash64("id").bitwiseXOR(F.lit(7)).alias("sim"))
    df = df.unionByName(near_copy)
    found = {(r["a"], r["b"]) for r in dedupe.text_edges(df).collect()}
    assert {frozenset(e) for e in found} >= {frozenset((i, n + i)) for i in range(50)} and len(found) < 200
