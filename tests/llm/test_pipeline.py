import corpus_pipeline as C
from parcelight.llm import decontamination, quality
from tests.llm import test_decontamination, test_line_dedup, test_ngram_join, test_packing

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, corpus):
    from tokenizers import Tokenizer

    from parcelight.llm.packing import default_tokenizer

    docs = corpus
    rows = {r["doc_id"]: r for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in quality.query(spark, SF).collect()}

    docs = C.quality_classifier(spark, docs, SF)
    assert docs.columns == corpus.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts == {i: r["text"] for i, r in rows.items() if scores[i]}
    assert len(texts) < len(rows)

    docs = C.dedup_lines(spark, docs, SF)
    assert docs.columns == corpus.columns
    drop = test_line_dedup.brute(list(texts.items()))
    texts = {i: test_line_dedup.kept(t, drop[i, t]) for i, t in texts.items()}
    got = docs.collect()
    assert {r["doc_id"]: r["text"] for r in got} == texts and all(r["n_chars"] == len(r["text"]) for r in got)

    docs = C.dedup_documents(spark, docs, SF)
    assert docs.columns == corpus.columns
    classes = {i: c for i, c, *_ in test_ngram_join.brute(list(texts.items()))}
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts

    docs = C.decontaminate(spark, docs, SF)
    assert docs.columns == corpus.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = {i: test_decontamination.brute(t, items) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if not (judged[i][1] > 0 and 20 * judged[i][1] >= judged[i][0])}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts

    tokenizer = Tokenizer.from_file(default_tokenizer())
    test_packing.check(C.pack(spark, docs, SF).collect(), texts, tokenizer, 1024)
    run = C.run(spark, SF)
    test_packing.check(run.collect(), texts, tokenizer, 1024)


def test_rows_without_text(spark, make_docs):
    docs = make_docs([None, "", "a b c", "a b c"], [1, 2, 3, 3])
    for _, stage in C.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 2, 3]
    assert decontamination.remove_contaminated(make_docs([]), spark.read.parquet(f"{SF}/benchmark.parquet")).collect() == []
