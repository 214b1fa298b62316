"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest
from segflow.llm import simhash

ORDER = ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item = fresh(20)
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        text = fresh(40) + (" you idiot moron scum" if bad else "") + "\nA common line\n" + fresh(30)
        rows.append((i, text, "en", "src0", len(text)))
        labels.append((i, 1, int(bad)))
    copy = rows[1][1]
    near = copy.split(" ")
    near[10] = "changed"
    rows += [(1000, copy, "en", "s", len(copy)), (1001, " ".join(near), "en", "s", 1), (1002, fresh(9) + " " + item, "en", "s", 1), (1003, None, None, None, None), (1004, fresh(50) + " idiot moron scum " + fresh(9), "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i for i, *_ in rows}, {i for i, _, toxic in labels if toxic} | {1004}


def test_stages(spark, corpus):
    folder, ids, toxic = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ORDER
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept, expected = docs.columns, docs, ids
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder).cache()
        expected = expected - {"toxicity": toxic, "simhash_near_dedup": {1000, 1001}, "benchmark_decontamination": {1002}}.get(name, set())
        assert kept.columns == columns and {r.doc_id for r in kept.select("doc_id").collect()} == expected
        if name == "line_dedup":
            assert kept.where("text LIKE '%common line%' OR n_chars <> length(text) AND doc_id < 1000").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == expected


def test_run(spark, corpus):
    folder, ids, toxic = corpus
    found = corpus_pipeline.run(spark, folder).toPandas()
    assert set(found.doc_id) == ids - toxic - {1000, 1001, 1002}
    assert (found.groupby("doc_id").length.sum() == found.groupby("doc_id").doc_tokens.first()).all()


def test_near_copies_are_linked_by_fingerprints(spark, tmp_path):
    """Texts that repeat one phrase have near fingerprints (op3) though few of their distinct shingles are shared; chains go through both kinds of links."""
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    phrase, own, other = fresh(7), fresh(12), fresh(80)
    rows = [(1, f"{phrase} " * 60 + own), (2, f"{phrase} " * 60 + fresh(12)), (3, other), (4, fresh(80)), (5, other.upper()), (None, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.where("doc_id > 0")).collect()}
    assert linked[2] == 1 and linked[4] == 4
    exact = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert exact[2] == 2
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6]
