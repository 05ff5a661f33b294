"""The corpus pipeline against plain Python, and the queries against their SQL."""

import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from millrace.llm import bpe, mixing, registry, toxicity

from ..conftest import SF
from .test_dedup import brute_fingerprint, components_of
from .test_models import brute_seats, plain_density

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Documents with null and repeated ids, null, empty and long texts, copies and near copies."""
    rng = random.Random(17)
    words = ["river", "Stone", "quiet", "walks", "under", "bright", "harbour", "letters", "winter", "garden"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))
    rows = [(i, text(rng.randint(5, 60)), rng.choice(["hot", "hot", "web", None])) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1], "copies") for i in range(20)]
    long = text(4000)
    rows += [(200, long, "web"), (201, long.replace(" ", "  ", 1), "web"), (202, long + " end", "hot")]
    rows += [(None, "no id here", "web"), (None, "no id either", "web"), (None, rows[3][1], "web"), (5, text(30), "web"), (5, text(30), "web"), (300, None, "web"), (301, "", "hot"), (302, "\n", "hot")]
    rows += [(7, rows[7][1], rows[7][2])]  # a repeated row
    rows += [(400 + i, text(20) + " idiot moron scum " + text(5), "web") for i in range(3)]
    return [(i, t, "en", s, len(t or "")) for i, t, s in rows]


def plain_pipeline(rows, lex):
    rows = [r for r in rows if 1 - 2.718281828459045 ** (-plain_density(lex, r[1] or "") * lex.slope) < 0.5]
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max([best.get(t or ""), i], key=lambda x: (x is not None, x))
    rows = [r for r in rows if r[0] == best[r[1] or ""]]
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = components_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    first = {}
    for i, c in enumerate(comp):
        first[c] = min(first.get(c, (True, 0)), (rows[i][0] is None, rows[i][0] or 0))
    kept = [r for r, c in zip(rows, comp, strict=True) if (r[0] is None, r[0] or 0) == first[c]]
    return kept, plain_mix(kept)


def plain_mix(rows):
    """Texts of the mix, by its definition."""
    size = lambda t: len((t or "").encode().split())
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted((n for n in by if n is not None)) + [None] * (None in by)
    total = {n: sum(size(r[1]) for r in by[n]) for n in names}
    weight = {n: mixing.WEIGHTS[k % 3] for k, n in enumerate(names)}
    target, open_, left = {}, set(names), mixing.SHARE * sum(total.values())
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if mixing.MOST * total[n] <= level * weight[n]}
        if not full:
            target |= {n: level * weight[n] for n in open_}
            break
        target |= {n: float(mixing.MOST * total[n]) for n in full}
        left -= sum(mixing.MOST * total[n] for n in full)
        open_ -= full
    low, high = mixing.BLOCK_BOUNDS
    block = min(high, max(low, int(min((t for t in target.values() if t > 0), default=low) // mixing.BLOCK_PART)))
    seats = brute_seats([target[n] for n in names], round(sum(target.values()) / block))
    out = []
    for n, s in zip(names, seats, strict=True):
        s = min(s, int(total[n] * mixing.MOST // block))
        part = lambda v: "null" if v is None else f"={v}"
        draw = lambda r: hashlib.md5(f"{mixing.SEED}:{part(r[0])}:{part(r[3])}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()  # noqa: B023, E731
        left = min(s * block, total[n] * mixing.MOST)
        times, left = (left // total[n], left % total[n]) if total[n] else (0, 0)
        for r in sorted(by[n], key=draw):
            out += [(r[0], r[1])] * times if size(r[1]) else []
            take = min(size(r[1]), left)
            left -= take
            if take:
                out.append((r[0], r[1] if take == size(r[1]) else take))
    return out


@pytest.mark.parametrize("n", [0, None])
def test_pipeline_against_plain_python(spark, tmp_path, n):
    rows = corpus()[:n]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i >= 400)) for i, *_ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    lex = toxicity.trained(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    kept, mix = plain_pipeline(rows, lex)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
    assert sorted(map(tuple, docs.collect()), key=repr) == sorted(kept, key=repr)
    own = bpe.encoder(bpe.rank_file())
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(mix)
    whole = {}
    for i, t in mix:
        if isinstance(t, str):
            whole.setdefault(i, []).append(hashlib.sha256(t.encode()).hexdigest())
    for r in got:
        if r["decoded_sha256"] in whole.get(r["doc_id"], []):
            whole[r["doc_id"]].remove(r["decoded_sha256"])
    assert not any(whole.values())  # every whole text is there as often as it is taken
    tokens = {hashlib.sha256((t or "").encode()).hexdigest(): len(public.encode_ordinary(t or "")) for _, t, *_ in rows}
    assert all(r["n_tokens"] == tokens[r["decoded_sha256"]] for r in got if r["decoded_sha256"] in tokens)
    cut = sum(isinstance(t, int) for _, t in mix)
    assert sum(r["decoded_sha256"] not in tokens for r in got) <= cut  # only texts taken in part are new


def test_extra_columns_with_clashing_names(spark, tmp_path):
    rows = [(*r, "x", 1.0) for r in corpus()]
    docs = spark.createDataFrame(rows, COLUMNS + ", tox_score string, n_tokens double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns[-2:] == ["tox_score", "n_tokens"] and {tuple(r) for r in docs.select("tox_score", "n_tokens").collect()} == {("x", 1.0)}, name


def test_registry(spark):
    assert [q.split("_")[0] for q in registry.queries()] == [f"op{n}" for n in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(registry.queries())


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want
