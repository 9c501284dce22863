import corpus_pipeline
from conftest import SF
from helpers import AWKWARD, PASSAGE, documents

from feldspar.llm import toxicity


def test_stages_over_the_small_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        assert name == "bpe" or docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_decisions_take_effect_and_clean_rows_stay(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "learn", lambda *a, **k: toxicity.Grammar({"zorple": (9.0, True)}))
    monkeypatch.setattr(corpus_pipeline, "read", lambda s, d, t: s.createDataFrame([(1, PASSAGE)], "item_id long, text string"))
    clean = "nothing of this stands anywhere else in these rows, and it is long enough to be looked at"
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark, [clean, "you zorple", PASSAGE, None, clean + " really"])
    assert sorted(r.doc_id for r in stages["toxicity"](spark, docs, "").collect()) == [0, 2, 3, 4]
    assert sorted(r.doc_id for r in stages["decontaminate"](spark, docs, "").collect()) == [0, 1, 3, 4]
    cut = {r.doc_id: r.text for r in stages["suffix"](spark, docs, "").collect()}
    assert cut[0] == clean and cut[3] is None and cut[4] == " really"
    near = sorted(r.doc_id for r in stages["simhash"](spark, documents(spark, [clean, clean, PASSAGE], [4, 2, 9]), "").collect())
    assert near == [2, 9]


def test_awkward_and_empty_tables(spark):
    for texts in (AWKWARD, []):
        docs = documents(spark, texts, [None, *range(len(texts) - 1)] if texts else [])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= len(texts)
            assert name == "bpe" or out.columns == docs.columns
