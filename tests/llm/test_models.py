"""Toxicity, quality, languages, URL rules, mixing and the pipeline on small tables."""

import itertools
import random
import time
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id, mixing, quality, shared, toxicity, url_rules

SF, DOCS = "/root/testdata/sf0.01", "doc_id long, text string"


def test_folding():
    f = toxicity.fold
    assert f("An ІDІОТ!") == " an idiot "  # Cyrillic letters
    assert f("1d10t $tupid m0r0n") == " idiot stupid moron " and f("stuuuupid") == " stuupid "
    assert f("l\u200boser ｌｏｓｅｒ") == " loser loser " and f("") == "  "
    assert f("ídïot né", {"idiot"}) == " idiot né " and f("7 of 10, 2024!") == " 7 of 10 2024 "


def test_lexicon_and_exceptions():
    lex = toxicity.Lexicon(words={"idiot": 2.0}, stems={"lowei": 1.0}, exceptions=["idiot proof"])
    a = lex.automaton()
    assert [w for *_, w in toxicity.hits(a, toxicity.fold("idiot, loweixyz and idiotic blowei"))] == [2.0, 1.0]
    assert toxicity.hits(a, toxicity.fold("an idiot-proof lock")) == []
    assert toxicity.density(a, None) == 0 and toxicity.density(a, "idiot") > toxicity.density(a, "idiot " + "word " * 200) > 0


def plain_density(lex, text):
    """Entries looked for at every word, one by one."""
    words = toxicity.fold(text, lex.words).split()
    at = {i: words[i : i + 2] for i in range(len(words))}
    spared = {j for i, two in at.items() for j in (i, i + 1) if " ".join(two) in lex.exceptions}
    weights = []
    for i, w in enumerate(words):
        own = [(len(w) + 2, lex.words[w])] if w in lex.words else []
        own += [(len(s) + 1, x) for s, x in lex.stems.items() if w.startswith(s)]
        if own and i not in spared:
            weights.append(max(own)[1])
    return sum(weights) * toxicity.PER_WORDS / max(toxicity.LEAST_WORDS, len(words)) if weights else 0.0


def test_density_against_looking_up_each_word():
    rng = random.Random(8)
    lex = toxicity.Lexicon(words={"idiot": 2.0, "moron": 1.5, "low": 1.0}, stems={"idio": 0.5, "grub": 3.0}, exceptions=["idiot proof", "no moron"])
    a = lex.automaton()
    pool = ["idiot", "1d10t", "Idiotic", "moron", "mor​on", "low", "lower", "grubby", "grub", "proof", "no", "a", "ídiot", "idiot-proof", "x!", ""]
    for _ in range(500):
        t = rng.choice([" ", "\n", ", "]).join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert toxicity.density(a, t, lex.words) == pytest.approx(plain_density(lex, t)), t


def test_learned_entries_against_counting(spark):
    rng = random.Random(6)
    common = [f"w{c}{d}" for c in "abcdefgh" for d in "xyzuv"]
    rows = []
    for i in range(300):
        t = [rng.choice(common) for _ in range(30)]
        if i % 3 == 0:
            t[rng.randrange(30)] = rng.choice(["vilest", "grubberish", "grubbering", "grubbery", "grubbest"])
        if i % 3 == 1 and i % 2:
            t[3:5] = ["not", "vilest"]
        rows.append((i, " ".join(t)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    lex = toxicity.learn(docs, labels, {})
    n = {1: 100, 0: 200}
    count = {}
    for i, t in rows:
        own = {(w, False) for w in t.split()} | {(w[:k], True) for w in t.split() for k in toxicity.STEM_LENGTHS if len(w) > k}
        for g in own:
            count.setdefault(g, {0: 0, 1: 0})[int(i % 3 == 0)] += 1
    odds = {g: np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1)) for g, c in count.items() if c[1] >= toxicity.LEAST_DOCS}
    odds = {g: x for g, x in odds.items() if x >= toxicity.LEAST_ODDS}
    stems = {g for g, is_stem in odds if is_stem}
    least = {s for s in stems if not any(s != o and s.startswith(o) for o in stems)}
    assert set(lex.stems) <= least and all(lex.stems[s] == pytest.approx(odds[s, True]) for s in lex.stems)
    assert lex.stems and set(lex.words) == {w for w, is_stem in odds if not is_stem and not any(w.startswith(s) for s in lex.stems)}
    assert all(x == pytest.approx(odds[w, False]) for w, x in lex.words.items())
    scores = {r["doc_id"]: r["tox_score"] for r in toxicity.score(docs, lex).collect()}
    assert all(scores[i] == pytest.approx(1 - np.exp(-plain_density(lex, t) * lex.slope)) for i, t in rows)


def test_samples_are_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "same")] * 50 + [(i, "x") for i in range(3, 40)] + [(None, "y")], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(None, 1)], "doc_id long, toxic int")
    rows = shared.labelled_sample(docs, labels, "toxic", 20).collect()
    assert sorted(r["toxic"] for r in rows) == [0] * 10 + [1] * 10 and all(r["doc_id"] % 2 == r["toxic"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, shared.labelled_sample(docs.repartition(3), labels, "toxic", 20).collect()))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                t[rng.randrange(60)] = rng.choice(["grubber", "snark" + rng.choice(words)])
        rows.append((i, " ".join(t), "en"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(None, "grubber grubber", "en"), (900, None, None), (901, "", ""), (902, "gr\u200bubber " * 3, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tox_score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lex = toxicity.learn(docs, lab.where("doc_id < 300"))
    got = {r["doc_id"]: r["tox_score"] for r in toxicity.score(docs, lex).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert got[900] == got[901] == 0 and got[902] >= 0.5 and got[None] >= 0.5
    assert toxicity.score(docs.where("false"), lex).count() == 0
    assert toxicity.learn(docs, lab.where("false")).words == toxicity.SEED_WORDS


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    node, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    sizes = np.array([3, 1, 3])
    p, pair, logs = quality.forward_backward(node, sizes, trans)
    want, all_pairs, at, total = np.zeros(7), np.zeros((2, 2)), 0, 0.0
    for n in sizes:
        z, marg, pr = 0.0, np.zeros(n), np.zeros((2, 2))
        for k in range(2**n):
            y = [k >> i & 1 for i in range(n)]
            s = np.exp(sum(node[at + i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            z += s
            marg += s * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pr[a, b] += s
        want[at : at + n], all_pairs, total, at = marg / z, all_pairs + pr / z, total + np.log(z), at + n
    assert np.allclose(p, want) and np.allclose(pair, all_pairs) and np.isclose(logs.sum(), total)


def test_quality(spark):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choice(["the", "small", "river", "runs", "quietly"]) for _ in range(9)).capitalize() + "."
    rows = [(i, "\n".join(line() if i % 2 else line().upper().replace(" ", "!! ") for _ in range(6))) for i in range(200)]
    field = quality.fit([t.encode() for _, t in rows[:120]], np.array([i % 2 for i, _ in rows[:120]]))
    rows += [(None, ""), (901, None), (902, "x" * 300_000), (903, "\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, quality_score string").withColumnRenamed("quality_score", "text").withColumn("quality_score", F.lit("clash"))
    got = quality.score(df, field).collect()
    assert all((r["quality_score"] >= 0.7) == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert all(0 <= r["quality_score"] <= 1 for r in got) and len(got) == 204
    assert quality.fit([b"a"], np.array([1])) == 1.0 and quality.fit([], np.array([])) == 0.5
    assert quality.score(df.where("false"), field).count() == 0
    assert {r["quality_score"] for r in quality.score(df, 0.5).collect()} == {0.5}


def test_quality_learns_from_whole_texts(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice(["the", "small", "river", "runs", "quietly"]) for _ in range(200)).capitalize() + "."
    good = lambda: [line() for _ in range(110)]
    junk = lambda: [x.upper().replace(" ", "!! ") for x in good()]
    texts = [(i, "\n".join(good() + (good() if i % 2 else junk()))) for i in range(12)]
    assert all("!!" not in t[:100_000] for _, t in texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, quality.learn(docs, labels)).collect()}
    assert all((got[i] >= quality.CUT) == bool(i % 2) for i in got) and len(got) == 12


def plain_line(line, before):
    """Features of one line by loops."""
    upper, lower, digit = (sum(a <= c <= b for c in line) for a, b in ((65, 90), (97, 122), (48, 57)))
    space, wide = sum(c in (*range(9, 14), 32) for c in line), sum(c > 127 for c in line)
    stops = sum(chr(c) in ".,;:'\"?-()" for c in line)
    sign = len(line) - upper - lower - digit - space - wide - stops
    words = line.split()
    signed = sum(not (w[-1:].isalnum() or w[-1] > 127 or chr(w[-1]) in ".,;:'\"?-()") for w in words)
    n, w, letters = max(1, len(line)), max(1, len(words)), max(1, upper + lower + wide)
    again, again2 = (sum(words[i] == words[i - k] for i in range(k, len(words))) for k in (1, 2))
    return [
        upper / letters, float(upper / letters > 0.5), (sign / n) ** 0.5, min(1, 8 * sign / n), digit / n, space / n, min(1, 10 * stops / n), signed / w,
        again / w, again2 / w, float(before is not None and line.split() == before.split() and len(line) > 0), np.log1p(len(line)) / 8, min(3, len(line) / w / 8), float(not line),
    ]


def test_evidence_against_plain_lines():
    rng = random.Random(12)
    texts = [b"\n".join(" ".join(rng.choice(["Word", "a", "b!", "SHOUT", "9", "ab, c", "café", ""]) for _ in range(rng.randint(0, 6))).encode() for _ in range(rng.randint(1, 5))) for _ in range(40)]
    x, size, per_text = quality.line_features(texts)
    at = 0
    for t, n in zip(texts, per_text, strict=True):
        lines = t.split(b"\n")
        assert len(lines) == n and size[at : at + n].tolist() == [max(1, len(y)) for y in lines]
        for k, y in enumerate(lines):
            own = x[at + k, 1 : 1 + quality.N_BASE]
            want = plain_line(y, lines[k - 1] if k else None)
            skip = {8, 9, 10} if k == 0 else set()  # words before a text's first line are another text's
            assert all(own[i] == pytest.approx(want[i]) for i in range(quality.N_BASE) if i not in {8, 9} | skip), (y, own, want)
            assert (x[at + k, 1 + quality.N_BASE : 1 + 2 * quality.N_BASE] == (x[at + k - 1, 1 : 1 + quality.N_BASE] if k else 0)).all()
        at += n
    rng = np.random.default_rng(4)
    field = quality.Field(rng.normal(size=x.shape[1]), rng.normal(size=(2, 2)), np.zeros(x.shape[1]), np.ones(x.shape[1]), (1.5, 0.2))
    got, at = field.evidence(texts), 0
    for i, n in enumerate(per_text):
        node, weight = x[at : at + n] @ field.weights, size[at : at + n]
        total, marg = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum(node[k] * y[k] for k in range(n)) + sum(field.trans[a, b] for a, b in itertools.pairwise(y)))
            total, marg = total + s, marg + s * np.array(y)
        assert got[i] == pytest.approx((marg / total * weight).sum() / weight.sum())
        at += n


def test_quality_in_blocks_of_lines(monkeypatch):
    rng, draw = np.random.default_rng(1), random.Random(3)
    for n in (1, 2, 50, 300):
        node, trans = rng.normal(size=n) * 3, rng.normal(size=(2, 2))
        want = quality.forward_backward(node, np.array([n]), trans)[0]
        for block in (1, 7, 64):
            got = np.full(n, np.nan)
            for a, b, p in quality.chain_marginals(node, trans, block):
                got[a:b] = p
            assert np.allclose(got, want, atol=1e-12)
    width = 3 * quality.N_BASE + 1
    field = quality.Field(rng.normal(size=width), rng.normal(size=(2, 2)), rng.normal(size=width), np.abs(rng.normal(size=width)) + 0.5)
    texts = ["".join(draw.choice(["a", "b ", "a a ", "\n", "\n\n", "X!", " "]) for _ in range(draw.randint(0, 200))).encode() for _ in range(60)] + [b"", b"\n", b"a", b"a\n", b"\na"]
    alone = [field.evidence([t])[0] for t in texts]
    assert np.allclose(alone, field.evidence(texts), atol=1e-12)  # a text's evidence is its own
    for lines, size in ((1, 4), (2, 1000), (7, 30)):
        monkeypatch.setattr(quality, "BATCH_LINES", lines)
        monkeypatch.setattr(quality, "BATCH_BYTES", size)
        assert np.allclose([field.long_evidence(t) for t in texts], alone, atol=1e-10)
        assert all(b"".join(quality.line_blocks(t)) == t + b"\n" for t in texts)
    monkeypatch.setattr(quality, "CHAIN_LINES", 3)
    assert all(b"\n".join(quality._chains(t)) == t and max(c.count(b"\n") for c in quality._chains(t)) < 3 for t in texts)


def test_quality_of_hostile_texts_is_bounded():
    width = 3 * quality.N_BASE + 1
    field = quality.Field(np.linspace(-1, 1, width), np.eye(2), np.zeros(width), np.ones(width))
    began = time.time()
    tracemalloc.start()
    for text in (b"\n" * 10_000_000, b"ab " * 1_000_000):
        assert 0 <= field.score([text])[0] <= 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500_000_000 and time.time() - began < 120, (most, time.time() - began)


def test_quality_fit_is_the_same_in_batches(monkeypatch):
    rng = random.Random(3)
    texts = ["\n".join("".join(rng.choice("abC !1") for _ in range(30)) for _ in range(rng.randint(1, 9))).encode() for _ in range(40)]
    labels = np.array([i % 2 for i in range(40)])
    one = quality.fit(texts, labels)
    monkeypatch.setattr(quality, "BATCH_LINES", 10)
    many = quality.fit(texts, labels)
    assert sum(1 for _ in quality._labelled_lines(texts, labels.tolist())) > 10
    assert np.allclose(one.trans, many.trans, atol=1e-6) and np.allclose(one.score(texts), many.score(texts), atol=1e-6)


def test_quality_gradient_and_optimum():
    rng = np.random.default_rng(5)
    texts = ["\n".join("".join(rng.choice(list("abC !1")) for _ in range(20)) for _ in range(rng.integers(1, 6))).encode() for _ in range(30)]
    labels = np.arange(30) % 2
    batch = next(quality._labelled_lines(texts, labels.tolist()))
    width = batch[0].shape[1]
    x = rng.normal(size=width + 4) * 0.3
    at = lambda v: quality._gradient(batch, quality.Field(v[:width], v[width:].reshape(2, 2), np.zeros(width), np.ones(width)))
    for k in [0, 3, 17, width, width + 1, width + 3]:
        step = np.zeros(width + 4)
        step[k] = 1e-5
        assert (at(x + step)[0] - at(x - step)[0]) / 2e-5 == pytest.approx(at(x)[1 + k], rel=1e-4, abs=1e-4)
    q = rng.normal(size=(6, 6))
    q, c = q @ q.T + np.eye(6), rng.normal(size=6)
    assert np.allclose(quality._climb(lambda v: (v @ q @ v / 2 - c @ v, q @ v - c), np.zeros(6)), np.linalg.solve(q, c), atol=1e-3)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    langs, model = language_id.train(docs.where("id % 2 = 0"))
    test = docs.where("id % 2 = 1 AND length(text) > 200").select(F.col("id").alias("page_id"), F.lit("").alias("url"), F.col("text").alias("html"), "lang")
    got = language_id.text_posteriors(test, langs, model).join(test.select("page_id", "lang"), "page_id").collect()
    right = [langs[int(np.argmax(r["post"]))] == r["lang"] for r in got]
    assert np.mean(right) > 0.97
    pages = spark.createDataFrame([(1, None, None, 1), (2, "no scheme", "", 2), (None, "https://x.example.de/a", "<html lang='de'><p>Die der und das ist nicht eine</p>", 3), (3, "https://x.example.de/b", "", 4), (3, "https://x.example.de/b", "", 5)], "page_id long, url string, html string, lang int")
    out = language_id.fuse(language_id.text_posteriors(pages, langs, model), langs)
    assert out.count() == 5 and {r["lang"] for r in out.collect()} <= set(langs)
    assert language_id.identify(pages, docs.where("false")).where("lang IS NULL").count() == 5
    assert language_id.fuse(language_id.text_posteriors(pages.where("false"), langs, model), langs).count() == 0


def test_fusion_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    langs = ["aa", "bb", "cc"]
    urls = [None, "none", "http://one.x.de/a", "http://u@two.x.de:80/", "http://x.de?q", "https://solo.org/", "http://a.b.fr#z", "HTTP://A.B.FR/"]
    rows = [(i, urls[rng.integers(len(urls))], ["", "aa", "zz", None][rng.integers(4)], rng.dirichlet([0.3] * 3).tolist()) for i in range(60)] + [(60, "http://once.only/", "bb", [0.2, 0.5, 0.3])]
    df = spark.createDataFrame(rows, "page_id long, url string, declared string, post array<double>")
    got = {r["page_id"]: r for r in language_id.fuse(df, langs).collect()}
    host = {None: "", "none": "", "http://one.x.de/a": "one.x.de", "http://u@two.x.de:80/": "two.x.de", "http://x.de?q": "x.de", "https://solo.org/": "solo.org", "http://a.b.fr#z": "a.b.fr", "HTTP://A.B.FR/": "a.b.fr", "http://once.only/": "once.only"}
    keys = lambda i: (host[rows[i][1]], ".".join(host[rows[i][1]].split(".")[-2:]), host[rows[i][1]].split(".")[-1], rows[i][2] or "")
    share = lambda x: x / (x.sum() + 1e-12)
    for i, (_, _, _, post) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]  # a page never counts for itself
        sums = lambda k: sum((np.array(rows[j][3]) for j in others if keys(j)[k] == keys(i)[k]), np.zeros(3))  # noqa: B023, E731
        total = sum(np.array(rows[j][3]) for j in others)
        prior = share(total + 1)
        for k in (2, 1, 0):
            prior = share(sums(k) + language_id.SMOOTH_HOST * prior)
        logs = np.log(np.array(post) + 1e-12) + np.log(prior + 1e-12)
        for k in (3, 2):
            kinds = len({keys(j)[k] for j in range(len(rows))})
            logs += np.log((sums(k) + 1) / (total + kinds + 1))
        p = np.exp(logs - logs.max())
        assert got[i]["lang"] == langs[int(p.argmax())] and got[i]["confidence"] == pytest.approx(p.max() / p.sum(), abs=1e-6) and got[i]["host"] == keys(i)[0]


def test_every_language_is_kept(spark):
    docs = spark.createDataFrame([(i, chr(0x4E00 + i) * 30, f"l{i:03}") for i in range(80)] + [(i % 3, "again " * 9, "l000") for i in range(200)], "id long, text string, lang string")
    langs, model = language_id.train(docs)
    assert len(langs) == 80 and model.shape == (80, language_id.BUCKETS)


def test_url_parts_and_fixed_rules(spark):
    urls = [("HTTP://WWW.Example.NET/en/x?q#f", "block"), ("https://example.com/de/", "block"), ("https://a.example.com/dex", "allow"), ("x.org/fr/", "allow"), ("https://b.org/fr/1", "allow"), ("https://notexample.net", "allow"), ("https://notexample.net/", "block"), (None, "allow"), ("a://b://c/d", "allow")]
    df = spark.createDataFrame([(i, u, "z") for i, (u, _) in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "rule long, items array<string>, confidence double, support double")
    got = {r["page_id"]: r for r in url_rules.judge(df, none).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1]["rule"] == "example.com/de/" and got[2]["rule"] is None and got[3]["host"] == "" and got[4]["rule"] == "org/fr/"
    assert got[5]["rule"] is None and got[6]["rule"] == "net/" and got[7]["host"] == got[7]["path"] == "" and got[8]["host"] == "b:"
    assert [got[i]["verdict"] for i in range(1, 9)] == [w for _, w in urls[1:]]


def test_rules_of_tokens_that_pages_share(spark):
    """Thirty fields that the same bad pages have, thirty that some other page has too: each is a
    rule, and no combination of them."""
    both, only = "&".join(f"b{i}x=1" for i in range(30)), "&".join(f"o{i}x=1" for i in range(30))
    rows = [(i, f"https://h{i}.test/?{both}&{only}" if i < 40 else f"https://h{i}.test/?{both}" if i < 45 else f"https://h{i}.test/?z=1", i < 40) for i in range(200)]
    pages = spark.createDataFrame([(a, b) for a, b, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "page_id long, bad boolean")
    began = time.time()
    got = {tuple(r["items"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in url_rules.mine(pages, labels).collect()}
    assert got == {(f"field:o{i}x",): (1.0, 0.2) for i in range(30)} | {(f"field:b{i}x",): (round(40 / 45, 9), 0.2) for i in range(30)}
    assert time.time() - began < 60


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        sec, name = rng.choice(["casino", "news", "blog"]), rng.choice(["win", "red", "tall"])
        bad = (sec == "casino" and name == "win") or rng.random() < 0.05
        rows.append((i, f"https://h{rng.randint(0, 5)}.example.test/{sec}/{name}/{rng.randint(0, 9)}", bad))
    pages = spark.createDataFrame([(a, b) for a, b, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "page_id long, bad boolean")
    rules = url_rules.mine(pages, labels)
    rules.cache()
    found = [set(r["items"]) for r in rules.collect()]
    assert {"part:casino", "part:win"} in found
    toks = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    assert toks[0] == {"end:test", "name:example", *(t for t in toks[0] if t[:5] in ("host:", "part:"))} and len(toks[0]) == 6
    # every combination by counting: enough support and confidence, no part as confident
    bad = {i for i, _, b in rows if b}
    least, base, support, good = max(url_rules.MIN_SUPPORT * 600, url_rules.LEAST_PAGES), len(bad) / 600, {}, {}
    for i, t in toks.items():
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k):
                support.setdefault(c, [0, 0])[i in bad] += 1
    for c, (no, yes) in support.items():
        if yes >= least and yes / (yes + no) >= max(url_rules.MIN_CONFIDENCE, url_rules.MIN_LIFT * base):
            good[frozenset(c)] = yes / (yes + no)
    want = {c for c, p in good.items() if not any(d < c and q >= p for d, q in good.items())}
    assert {frozenset(f) for f in found} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (SELECT unnest(?) AS page_id, unnest(?) AS url)", [[a for a, _, _ in rows], [b for _, b, _ in rows]])
    con.execute("CREATE TABLE labels AS SELECT * FROM (SELECT unnest(?) AS doc_id, unnest(?) AS quality, 0 AS toxic)", [[a for a, _, _ in rows], [int(not c) for _, _, c in rows]])
    by_sql = {a: (b, round(c or 0, 9)) for a, b, c in con.execute(f"SELECT page_id, verdict, confidence FROM ({url_rules.OP2_SQL})").fetchall()}
    judged = {r["page_id"]: (r["verdict"], round(r["confidence"] or 0, 9)) for r in url_rules.judge(pages, rules).collect()}
    assert judged == by_sql and {"block", "allow"} == {v for v, _ in judged.values()}
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, rules, []).collect()}
    assert got == {i: "block" if any(f <= toks[i] for f in found) else "allow" for i in toks}
    assert url_rules.mine(pages, labels.where("false")).count() == 0 and url_rules.mine(pages.where("false"), labels).count() == 0
    assert url_rules.judge(pages.where("false"), rules).count() == 0
    long = spark.createDataFrame([(None, "https://h1.example.test/casino/win/" + "x" * 200_000, "c"), (1, "https://h1.example.test/casino/win/9", "c"), (1, "https://h1.example.test/casino/win/9", "c")], "page_id long, url string, rule string")
    assert [r["verdict"] for r in url_rules.judge(long, rules, []).collect()] == ["block"] * 3


def brute_seats(weights, total):
    got = [0] * len(weights)
    for _ in range(total):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


@pytest.mark.parametrize("total", [0, 1, 7, 100, 1001])
def test_seats_against_highest_quotients(spark, total):
    rng = random.Random(total)
    w = [rng.randint(1, 1000) for _ in range(23)] + [0]
    df = spark.createDataFrame([(0, k, x, total) for k, x in enumerate(w)], "g int, k int, w long, total long")
    got = [r["seats"] for r in mixing.seats(df, "g", "w", "total", "k").orderBy("k").collect()]
    assert got == brute_seats(w, total)


def test_targets_against_repeated_sharing(spark):
    size = {"a": 10, "b": 500, "c": 40, "d": 1000, None: 70}
    df = spark.createDataFrame(list(size.items()), "source string, source_size long")
    names = ["a", "b", "c", "d", None]
    weight = dict(zip(names, [5, 2, 1, 5, 2], strict=True))
    want, left = dict.fromkeys(names, 0.0), 1.5 * sum(size.values())
    open_ = set(names)
    while left > 1e-9:
        share = left / sum(weight[n] for n in open_)
        left = 0.0
        for n in list(open_):
            want[n] += share * weight[n]
            if want[n] >= 2 * size[n]:
                left += want[n] - 2 * size[n]
                want[n] = 2.0 * size[n]
                open_.discard(n)
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert all(abs(got[n] - want[n]) < 1e-6 for n in names)


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["hot", "hot", "x", "y", None])) for i in range(500)] + [(900, None, "x"), (None, "a b", "y"), (7, "again and again", "y")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, size int")
    a = mixing.mix(df, shard_words=2000).collect()
    assert len(a) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in a)
    by = {}
    for r in a:
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(t - want) <= 0.05 * want + 2 for t, want in by.values())
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7), shard_words=2000).collect()), key=repr)
    texts = mixing.mixed_texts(df)
    assert texts.columns == df.columns
    assert mixing.mix(df.where("false")).count() == 0
    # what is taken of a row, and how it comes out: whole as often as it goes, a part at most once
    for some in (df, df.where("doc_id < 200"), df.unionByName(df.where("doc_id < 20"))):
        want, got = {}, {}
        for r in mixing.mix(some).collect():
            want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["taken"]
        for r in mixing.mixed_texts(some).collect():
            got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + len((r["text"] or "").split())
        assert {k: v for k, v in want.items() if v} == got


def test_mixed_texts_with_one_id_for_all(spark):
    rng = random.Random(5)
    for ids in ([None] * 1000, [7] * 1000):
        df = spark.createDataFrame([(i, f"n{k} " + "w " * rng.randint(0, 9), rng.choice("ab")) for k, i in enumerate(ids)], "doc_id long, text string, source string")
        taken = mixing.mix(df).agg(F.sum("taken")).first()[0]
        out = [r["text"] for r in mixing.mixed_texts(df).collect()]
        assert sum(len(t.split()) for t in out) == taken and max(out.count(t) for t in set(out)) <= 2
    same = spark.createDataFrame([(7, "one two three", "a")] * 30 + [(8, "x " * 50, "b")], "doc_id long, text string, source string")
    taken = {r["source"]: r["t"] for r in mixing.mix(same).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    out = mixing.mixed_texts(same).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("t")).collect()
    assert {r["source"]: r["t"] for r in out} == {k: v for k, v in taken.items() if v}


def test_mixing_of_a_row_that_repeats(spark):
    """Copies are drawn as one row: what is taken of them adds up, and none is taken over twice."""
    hot = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("x y z").alias("text"))
    other = spark.range(500).select(F.col("id") + 100, F.lit("b"), F.lit("one two"))
    got = mixing.mix(hot.union(other), shard_words=5_000)
    rows = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most"), F.count_distinct("taken").alias("kinds")).collect()
    one = next(r for r in rows if r["doc_id"] == 7)
    target = {r["source"]: r["target"] for r in got.select("source", "target").distinct().collect()}
    assert one["n"] == 10_000 and len(rows) == 501 and one["most"] <= 6 and one["kinds"] <= 3
    assert abs(one["taken"] - target["a"]) <= 1024
