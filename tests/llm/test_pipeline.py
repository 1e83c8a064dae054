import hashlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers

pipeline = pytest.importorskip("corpus_pipeline")

from folio.llm import language_id, quality_knn, queries  # noqa: E402
from tests.llm.test_decontamination import brute as contamination  # noqa: E402
from tests.llm.test_language_id import brute as languages  # noqa: E402
from tests.llm.test_near_copies import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, SF)
        path = str(tmp_path_factory.mktemp("stage") / name)
        made.write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_stages_keep_columns_and_rows_of_their_input(stages):
    assert [s[0] for s in stages] == [n for n, _ in pipeline.STAGES]
    for name, given, made in stages[:-1]:
        assert made.columns == given.columns
        assert made.exceptAll(given).count() == 0 and made.count() <= given.count(), name


def test_decisions(spark, stages):
    _, given, made = stages[2]
    # near-duplicate stages take five words and a Jaccard index of 0.8: every pair of sets is compared
    assert {r.doc_id for r in made.collect()} == {c for _, c in brute([(r.doc_id, r.text) for r in given.collect()])}
    _, given, made = stages[3]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in given.collect() if not contamination(r.text, items)[1]]
    assert sorted(clean) == sorted(r.doc_id for r in made.collect()) and len(clean) < given.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    _, given, made = stages[1]
    assert made.join(labels.where("quality = 0"), "doc_id").count() == 0
    assert given.join(labels.where("quality = 1"), "doc_id").count() == made.join(labels.where("quality = 1"), "doc_id").count()


def test_first_stages_against_plain_models(spark, stages):
    """Language ID and the quality classifier decide as models of the same rows by plain sets, counts and loops do."""
    _, given, made = stages[0]
    docs = given.collect()
    rows = language_id.sample(given, "doc_id", "text", "lang")
    told = [r for r in docs if any(c.isalpha() for c in r.text or "")]
    want = languages(rows, sorted({r.text for r in told}))
    keep = {r.doc_id for r in told if want[r.text][1] >= language_id.CLAIM}
    assert {r.doc_id for r in made.collect()} == keep
    _, given, made = stages[1]
    docs, labels = given.collect(), spark.read.parquet(f"{SF}/labels.parquet")
    learned = quality_knn.sample(given, labels, "doc_id", "text")
    scores = quality_knn.predict(pa.array([r.text for r in docs], pa.string()), quality_knn.fit(learned)).to_pylist()
    assert {r.doc_id for r in made.collect()} == {r.doc_id for r, score in zip(docs, scores, strict=True) if score >= 0.5}


def test_last_stage(stages):
    _, given, made = stages[4]
    texts = {r.doc_id: r.text for r in given.collect()}
    rows = made.collect()
    assert len(rows) == len(texts)
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert (bytes(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) == (packed, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest())


def test_run(spark, stages):
    assert sorted(map(str, pipeline.run(spark, SF).drop("ids").collect())) == sorted(map(str, stages[-1][2].drop("ids").collect()))


def test_all_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
