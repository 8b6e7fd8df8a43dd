"""The pipeline, stage by stage, against what each stage promises."""

import corpus_pipeline
from tests.llm.test_operators import brute_links
from vectrill.llm import _common as common
from vectrill.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard_join", "best_fit_packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, docs, DATA), name)
        assert after.columns == columns and after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        kept.append((docs, after))
        docs = after
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in kept[2])
    pairs, ids = brute_links(before), set(after)
    assert not any(a in ids and b in ids for a, b in pairs)
    assert all(any(a == i for a, _ in pairs) for i in set(before) - ids)
    packed = corpus_pipeline.pack_sequences(spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
