"""The pipeline's stages against what each must do."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillon.llm import line_crf, toxicity
from quillon.llm.shared import table

from .test_queries import AWKWARD, DOCS


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after every stage."""
    folder = "/root/testdata/sf0.01"
    seen, docs = [], table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, folder).write.parquet(path)
        seen.append((name, docs, spark.read.parquet(path)))
        docs = spark.read.parquet(path)
    return seen


def test_schemas(stages):
    columns = stages[0][1].columns
    assert all(after.columns == columns for _, _, after in stages[:-1])
    assert [n for n, _, _ in stages] == ["toxicity", "quality", "near_dedup", "mixing", "tokens"]


def test_filters_keep_what_their_operators_keep(spark, stages):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels")
    _, before, after = stages[0]
    scored = toxicity.score(before, toxicity.train(before, labels))
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(r["doc_id"] for r in scored.where("predicted = 0").collect())
    _, before, after = stages[1]
    kept = line_crf.report(before, line_crf.train(before, labels)).where("kept")
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(r["doc_id"] for r in kept.collect())


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[2]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    kept = [r["doc_id"] for r in after.collect()]
    assert len(kept) == len(set(kept)) < len(texts)
    sets = {i: {tuple(t.lower().encode().split()[k : k + 5]) for k in range(max(1, len(t.encode().split()) - 4))} for i, t in texts.items()}
    similar = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    near = {tuple(sorted((i, j))) for ids in by.values() for k, i in enumerate(ids) for j in ids[k + 1 :]}
    pairs = [p for p in near if similar(*p)]
    both = [p for p in pairs if p[0] in set(kept) and p[1] in set(kept)]
    assert len(pairs) > 20
    assert not both
    gone = set(texts) - set(kept)
    linked = {i for p in pairs for i in p}
    assert gone <= linked


def test_mixing_and_tokens(stages):
    _, before, after = stages[3]
    assert set(r["doc_id"] for r in after.collect()) <= set(r["doc_id"] for r in before.collect())
    _, before, after = stages[4]
    assert after.count() == before.count()
    assert after.where("not round_trip").count() == 0
    assert after.where(F.size("token_ids") != F.col("n_tokens")).count() == 0


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (AWKWARD, []):
        docs = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit(1))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            stage(spark, docs, str(tmp_path)).count()
        kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
        assert len([r for r in kept if r["doc_id"] in (1, -7)]) <= 1
