"""Each stage is held against a brute-force version over its own input; stages hand on Parquet."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from ticksmith.llm import toxicity

from .common import no_documents, odd_documents
from .test_decontam import brute
from .test_simhash import brute_components, brute_fingerprint
from .test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    """(input rows, output frame) of each stage."""
    docs, out = spark.read.parquet(f"{tiny}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, tiny).write.parquet(path)
        kept = spark.read.parquet(path)
        out.append((docs, kept))
        docs = kept
    return out


def test_the_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "packing"]


def test_all_but_the_last_keep_the_columns(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_toxic_documents_go(stages, spark, tiny):
    before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{tiny}/labels.parquet"))
    score = model.scorer()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if score(r.text)[0] < 0.5)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    roots = brute_components([brute_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in after.collect()) == sorted(rows[k].doc_id for k in set(roots))


def test_leaks_go(stages, spark, tiny):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    found = {d for d, _ in brute([(r.doc_id, r.text) for r in before.collect()], items)}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - found


def test_the_rest_is_packed(stages):
    before, after = stages[3]
    check_packing(after.collect(), [(r.doc_id, r.text) for r in before.collect()])


def test_run_gives_the_last_stage(spark, tiny, stages):
    assert {r.doc_id for r in P.run(spark, tiny).collect()} == {r.doc_id for r in stages[3][1].collect()}


def test_stages_bear_odd_rows(spark, tiny):
    docs = odd_documents(spark).withColumn("_uid", F.lit("clash"))
    for make in (docs, no_documents(spark)):
        for name, stage in P.STAGES[:-1]:
            got = stage(spark, make, tiny)
            assert got.columns == make.columns and got.count() <= make.count()
        assert P.STAGES[-1][1](spark, make, tiny).count() >= make.count()
    kept = [r.doc_id for r in P.drop_near_duplicates(spark, docs, tiny).collect()]
    assert kept.count(12) + kept.count(13) == 1 and kept.count(3) == 2  # one of the repeated rows; the other text of id 3 is its own
