"""Mixing, clustering and importance resampling against brute force on small tables, and the awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyspark.sql
import pytest
from pyspark.sql import functions as F

from segflow.llm import clustering, importance, mixing, queries

# --- mixing


def documents(spark, seed=1, n=400):
    """Hot, usual, tiny, empty and null sources; repeated rows, null texts and ids; clashing extra columns."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "B", "é", None])
        rows.append((i, source, " ".join(["w"] * int(1 + rng.expovariate(1 / 60))), 7, "x"))
    rows += [(1000, "empty", "", 7, "x"), (1001, "empty", None, 7, "x"), (None, "a", "one two", 7, None), (5000, "long", "w\t" * 20_000, 7, "x")] + [(2000, "hot", "same text here", 7, "x")] * 60
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, size int, key string")


def brute_targets(totals, weights, share, cap):
    """Deal by weight; what exceeds a cap is dealt again among the rest, until none does."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight, budget = {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(totals.values())
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        dealt = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: cap * totals[s] for s in free if dealt[s] > cap * totals[s]}
        if not over:
            return fixed | dealt
        fixed |= over


def brute_rates(sizes, target, cap):
    low, high = -50.0, math.log(cap)
    words = lambda t: sum(s * min(cap, math.exp(min(t * s, math.log(cap)))) for s in sizes)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if words(middle) < target else (low, middle)
    return [min(cap, math.exp(min(high * s, math.log(cap)))) for s in sizes]


@pytest.mark.parametrize("rank_rows", [1_000, 20])
def test_mix_equals_brute_force(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(mixing, "RANK_ROWS", rank_rows)
    rows, df = documents(spark)
    found = mixing.mix(df)
    assert found.columns == ["doc_id", "source", "text", "key", "size", "source_size", "target", "rate", "copies", "taken"]
    made = found.toPandas()
    sizes = lambda s: [len((r[2] or "").split()) for r in rows if r[1] == s]
    totals = {s: sum(sizes(s)) for s in {r[1] for r in rows}}
    targets = brute_targets(totals, (3, 1, 2), 1.5, 2)
    assert len(made) == len(rows) and (made.taken == made.copies * made["size"]).all() and made.copies.between(0, 2).all() and (made["size"] == made.text.fillna("").str.split().str.len()).all()
    for source, target in targets.items():
        own = made[made.source.isna()] if source is None else made[made.source == source]
        assert own.target.sub(target).abs().max() < 1e-6 and (own.source_size == totals[source]).all()
        if totals[source] and target < 2 * totals[source] * (1 - 1e-9):
            wanted = dict(zip(sizes(source), brute_rates(sizes(source), target, 2)))
            assert np.allclose(own.rate, own["size"].map(wanted), rtol=1e-4)
        assert abs(own.taken.sum() - target) <= (1 if source != "long" else 20_000)
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "taken", "copies"]
    assert sorted(map(str, made[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    repeated = mixing.repeat_documents(found)
    assert repeated.count() == made.copies.sum() and repeated.where("copy >= copies").count() == 0


def test_mix_of_little(spark):
    _, df = documents(spark)
    assert mixing.mix(df.limit(0)).count() == 0
    one = mixing.mix(df.where("doc_id = 5000")).first()
    assert (one.target, one.taken) == (30_000.0, 20_000) or one.taken == 40_000
    empty = mixing.mix(df.where("source = 'empty'")).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    half = mixing.mix(df.where("source = 'hot'"), weights=(1,), share=0.5).toPandas()
    assert abs(half.taken.sum() - half.target.iloc[0]) <= 1 and half.rate[half["size"] > 0].max() < 1


def test_mix_is_native(spark):
    _, df = documents(spark)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_equal_documents_share_copies_evenly(spark):
    rows = [(i, "s", "one two three") for i in range(101)] + [(200 + i, "t", "w " * 50) for i in range(100)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1, 40), share=1.2).toPandas()
    own = made[made.source == "s"]
    assert own.copies.max() - own.copies.min() <= 1 and abs(own.taken.sum() - own.target.iloc[0]) <= 2


# --- clustering


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in kept]
    whole, each = sum(d for _, d, _ in found), Counter()
    for _, d, j in found:
        each[j] += d
    return sorted(((i, j, d, each[j], whole, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    rows = [(int(i), [float(x) for x in np.float32(centers[rng.integers(6)] + spread * rng.normal(size=dims))]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (3, rows[3][1]), (None, rows[5][1]), (n + 2, None), (n + 3, [1.0]), (n + 4, [float("nan")] * dims), (n + 5, [float("inf")] * dims), (n + 6, [None] * dims), (n + 7, [0.0] * dims)]
    return rows


@pytest.mark.parametrize(("dims", "k", "pivots", "spread"), [(8, 12, 5, 0.3), (3, 9, 12, 0.05), (8, 400, 4, 0.3), (5, 1, 3, 1.0)])
def test_clusters_equal_brute_force(spark, dims, k, pivots, spread):
    rows = vectors(dims, 150, dims, spread)
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(4)
    found = clustering.cluster(df, dims=dims, k=k, rounds=3, pivots=pivots)
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters(rows, k, 3, dims)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(4)
    ints, cents = rng.integers(-300, 300, (500, 16)), rng.integers(-300, 300, (40, 16))
    ints[:200] = cents[rng.integers(0, 40, 200)] + rng.integers(-20, 20, (200, 16))
    simplex = clustering.Simplex(cents, 10)
    assert simplex.base.shape == (10, 9)
    a, c = simplex.apexes(ints), simplex.apexes(cents)
    true = np.sqrt(((ints[:, None] - cents[None]) ** 2).sum(2))
    low = np.sqrt(((a[:, None] - c[None]) ** 2).sum(2))
    high = np.sqrt(low**2 + 4 * a[:, -1:] * c[:, -1][None])
    assert (low <= true + 1e-6).all() and (true <= high + 1e-6).all()
    cluster, distance, compared = clustering.nearest(ints, a, cents, c)
    assert (distance == (true**2).round().min(1)).all() and compared < 0.8 * true.size
    flat = clustering.Simplex(np.zeros((5, 16), dtype=np.int64), 4)  # equal pivots are one
    assert len(flat.pivots) == 1


def test_clusters_of_nothing_and_of_extremes(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustering.cluster(empty).count() == 0 and clustering.cluster(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    far = spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r.distance for r in clustering.cluster(far, dims=2, k=1, rounds=0).collect()} == {0, 2 * clustering.LARGEST**2}


# --- importance resampling

WORDS = ["alpha", "Béta", "x9", "naïve-ly", "Zz", "日本", "a_b", "it's", "", "Q"]


def features(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("block", [1 << 21, 64])
def test_crcs_of_substrings(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    rng = random.Random(2)
    texts = ["", "  ", "one", "one two", "A" * 300, " ".join(rng.choice(WORDS) for _ in range(500)), "x" * 70_000 + " tail", "\x00ß\x7f9"] + [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(9))) for _ in range(60)]
    found = [Counter() for _ in texts]
    for own, crcs in importance.Scan(3).texts([t.encode() for t in texts]):
        for i, c in zip(own.tolist(), crcs.tolist()):
            found[i][c] += 1
    assert found == [Counter(features(t)[1]) for t in texts]


@pytest.mark.parametrize(("n", "buckets", "percent", "least"), [(3, 10_000, 5, 20), (2, 50, 30, 1), (1, 7, 100, 0)])
def test_resample_equals_brute_force(spark, n, buckets, percent, least):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(60))), 1.5) for i in range(150)] + [(900, None, 1.0), (901, "", 1.0), (None, "Alpha beta " * 30, 1.0), (7, rng.choice(WORDS) + " x9" * 25, 1.0)]
    target = ["alpha béta alpha x9", None, "日本 zz alpha"]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(5)
    found = importance.resample(df, spark.createDataFrame([(t,) for t in target], "words string"), target_text="words", n=n, buckets=buckets, percent=percent, min_words=least)
    s, t = Counter(c % buckets for r in rows for c in features(r[1], n)[1]), Counter(c % buckets for x in target for c in features(x, n)[1])
    every, wanted = (sum(s.values()), sum(t.values())), []
    for i, text, _ in rows:
        words, crcs = features(text, n)
        weight = sum(math.floor(1000 * math.log((t[c % buckets] + 1) * (every[0] + buckets) / ((s[c % buckets] + 1) * (every[1] + buckets)))) for c in crcs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        wanted.append([i, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least])
    drawn = sorted((w for w in wanted if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    drawn = drawn[: len(drawn) * percent // 100]
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    Row = pyspark.sql.Row
    assert sorted(map(str, found.collect())) == sorted(str(Row(doc_id=w[0], n_features=w[1], weight=w[2], score=w[3], rank=next((k + 1 for k, d in enumerate(drawn) if d is w), None))) for w in wanted)


def test_resample_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(empty, one).count() == 0
    assert importance.resample(one, empty).first()["n_features"] == 3


# --- the registered queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 90))), "s" + str(i % 4), i) for i in range(120)] + [(None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "alpha x9 zz")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(64)], 1) for i in range(90)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_registered_queries(spark, folder):
    known = queries.queries()
    mixed = known["op11_mixing"](spark, folder)
    assert dict(mixed.dtypes).items() >= {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}.items() and mixed.count() == 121
    assert mixed.agg(F.sum("target") / F.sum("target")).first()[0] == 1.0
    vecs = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    clusters = known["op12_clustering"](spark, folder)
    assert sorted(map(tuple, clusters.collect()), key=str) == brute_clusters(vecs, 40, 5, 64)
    drawn = known["op13_importance"](spark, folder).toPandas()
    n = sum(features(r.text)[0] >= 20 for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert len(drawn) == 121 and sorted(drawn["rank"].dropna()) == list(range(1, 5 * n // 100 + 1)) and drawn.loc[drawn["rank"].notna(), "score"].min() >= drawn.loc[drawn["rank"].isna() & (drawn.n_features >= 57), "score"].max()
