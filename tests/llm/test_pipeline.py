import corpus_pipeline
from actionloom.llm import exact_dedup, language, packing, simhash, toxicity
from actionloom.llm.common import held_out, read_table
from actionloom.session import stored
from tests.llm.helpers import SF


def test_stages_one_after_the_other(spark):
    docs, columns = read_table(spark, SF, "documents"), None
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = columns or docs.columns
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[1] >= 0.98 * kept[0] and kept[3] < kept[2]
    left = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left


def test_decisions_are_the_operators(spark):
    docs = read_table(spark, SF, "documents")
    train = docs.filter(~held_out("doc_id", 5, 0))
    found = language.predict(docs, language.fit(train))
    want = {r.doc_id for r in found.collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == want
    scored = toxicity.score(docs, toxicity.fit(train, read_table(spark, SF, "labels")))
    want = {r.doc_id for r in scored.collect() if r.score < toxicity.THRESHOLD}
    assert {r.doc_id for r in corpus_pipeline.toxic_filter(spark, docs, SF).collect()} == want
    want = {r.doc_id for r in exact_dedup.duplicate_groups(docs).collect() if r.kept}
    assert {r.doc_id for r in corpus_pipeline.drop_exact_copies(spark, docs, SF).collect()} == want
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == want


def test_empty_documents_pass_through(spark):
    docs = stored(read_table(spark, SF, "documents").limit(0))
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() == 0 and "sequence_id" in docs.columns
    assert packing.best_fit_plan({}, 8) == []
