"""Every registered corpus query by name, and the pipeline, over small folders with the awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest

from segflow.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: What the results hold at least, by query.
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7_substring_dedup": "doc_id start_word end_word n_words partner_id n_links",
    "op8_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10_toxicity": "doc_id held_out score predicted",
    "op11_mixing": "doc_id size source_size target taken",
    "op12_clustering": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_importance": "doc_id n_features weight score rank",
}


def rows():
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rng.randrange(5, 60))) + (" you idiot moron scum" if i % 6 == 0 else "") for i in range(60)]
    shared = " ".join(word() for _ in range(70))
    texts += [shared + " one", "two " + shared, texts[1], texts[2] + " more", "", None, " \n\t", "x" * 3000 + " " + " ".join(word() for _ in range(4000))]
    made = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return made + [(3, texts[3], "en", "s0", 1), (4, "another text of an id", "en", None, 1), (None, "no id here", None, None, None), (None, None, None, None, None)]


def write(spark, path, documents, labels, items, vectors):
    """The folder's tables; documents have further columns whose names the operators might use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents, DOCUMENTS)
    for name in ("__key", "__row_key", "__words", "__hits", "key", "row", "size", "batch"):
        df = df.withColumn(name, F.lit(name))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(18)
    docs = rows()
    labels = [(i, 1, int(i % 6 == 0)) for i in range(60)] + [(None, 1, 1), (5, 1, None)]
    vectors = [(i, [rng.gauss(0, 0.2) for _ in range(64)], 1) for i in range(60)] + [(None, [0.0] * 64, 1), (7, None, 1)]
    return write(spark, str(tmp_path_factory.mktemp("sf")), docs, labels, [(1, docs[1][1]), (2, None), (3, "")], vectors)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty")), [], [], [], [])


def test_all_are_listed():
    assert set(COLUMNS) == set(queries.queries())


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, folder, empty, name):
    found = queries.queries()[name](spark, folder)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    made, docs = found.toPandas(), rows()
    ids = Counter(r[0] for r in docs)
    if name not in ("op1_packing", "op7_substring_dedup", "op12_clustering"):
        assert Counter(None if i != i else int(i) for i in made.doc_id) == ids
    check = globals().get(f"check_{name.split('_')[0]}")
    if check:
        check(made, docs)
    assert queries.queries()[name](spark, empty).count() == 0


def check_op1(made, docs):
    assert (made.length <= 2048).all() and made.groupby("sequence_id").length.sum().max() <= 2048
    whole = made[made.start == 0]
    assert len(whole) == len(docs) and made.length.sum() == whole.doc_tokens.sum()
    assert (made.loc[made.doc_id == 64, "ids_crc32"] == zlib.crc32(b"\1\0\0\0")).all()


def check_op3(made, docs):
    by_id = made.set_index("doc_id")
    assert by_id.fingerprint.str.fullmatch("[0-9a-f]{16}").all() and by_id.loc[62].component_id == by_id.loc[1].component_id == 1


def check_op4(made, docs):
    assert made["size"].sum() == sum(len((r[1] or "").encode()) + 1 for r in docs) and made.law.nunique() == 1 and made.shard.between(0, 15).all()
    assert all(sorted(own.slot) == list(range(len(own))) for _, own in made.groupby("shard"))


def check_op5(made, docs):
    texts = {hashlib.sha256(((t := (r[1] or "").encode()) + b" " * (-len(t) % 192 or 192 * (not t)))).hexdigest() for r in docs}
    assert set(made.payload_sha256) == texts and (made.payload_bytes % 192 == 0).all()


def check_op7(made, docs):
    spans = {int(r.doc_id): (r.start_word, r.end_word) for r in made.itertuples() if r.doc_id == r.doc_id}
    assert spans[60] == (0, 70) and spans[61] == (1, 71)


def check_op8(made, docs):
    words = lambda t: [*(t or "").lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for r in docs if not held(r[0]) for w in words(r[1]))
    n, v = sum(counts.values()), len(counts)
    one = {int(r.doc_id): r for r in made.itertuples() if r.doc_id == r.doc_id and r.doc_id not in (3, 4)}
    for i, t, *_ in docs:
        if i in one:
            r = one[i]
            assert r.held_out == held(i) and r.n_tokens == len(words(t)) and r.n_known == sum(counts[w] > 0 for w in words(t)) and r.train_tokens == n
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) and r.score < 0


def check_op10(made, docs):
    assert made.score.between(0, 1).all() and ((made.score >= 0.5) == (made.predicted == 1)).all() and made.score.nunique() > 20
    assert all(h == (zlib.crc32(("" if i != i else str(int(i))).encode()) % 5 == 0) for i, h in zip(made.doc_id, made.held_out))


def check_op13(made, docs):
    assert sorted(made["rank"].dropna()) == list(range(1, 1 + int(made["rank"].notna().sum())))


def test_pipeline_with_awkward_rows(spark, folder, empty):
    found = corpus_pipeline.run(spark, folder).toPandas()
    kept = {int(i) for i in found.doc_id if i == i}
    assert 67 in kept and not {i for i in range(60) if i % 6 == 0} & kept  # the long text stays, toxic ones go
    assert 1 not in kept and 62 not in kept  # an item of the benchmark and its copy
    assert len({64, 65, 66} & kept) <= 1  # wordless texts are one group
    assert (found.groupby(["doc_id", "doc_tokens"], dropna=False).length.sum().reset_index().eval("length % doc_tokens") == 0).all()
    assert corpus_pipeline.run(spark, empty).count() == 0
