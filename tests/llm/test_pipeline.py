import re

import corpus_pipeline

from earshot.session import stored, table
from tests.llm.test_shingle_join import brute
from tests.llm.test_token_files import check_packed


def test_stages_one_by_one(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    toxic = {r.doc_id for r in table(spark, sf, "labels").filter("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stored(stage(spark, docs, sf), name)
        if name != "packing":
            assert out.columns == columns
            after = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
        if name == "toxicity":
            gone = set(before) - {k for k, _ in after}
            assert gone and len(gone & toxic) >= 0.9 * len(toxic & set(before)) and all(before[k] == t for k, t in after)
        if name == "line_dedup":
            cut = {k: t for k, t in after if t != before[k]}
            assert cut and all(len(t) < len(before[k]) for k, t in cut.items())
            assert len(after) >= 0.8 * len(before)
        if name == "shingle_join":
            groups = brute(list(before.items()), 5, 80, 100)
            assert {k for k, _ in after} == {k for k in before if groups[k] == k}
        if name == "mixing":
            size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in before.items()}
            assert after and all(before[k] == t and size[k] for k, t in after)
            assert max(sum(1 for x, _ in after if x == k) for k in before) <= 3
        if name == "packing":
            check_packed([r.asDict() for r in out.collect()])
        docs = out


def test_run_is_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5


ODD = [(1, None, "en", "a", 0), (None, "some words of a row without a key", None, None, 0), (2, "", "en", "a", 0), (3, "w " * 30_000, "en", None, 0), (4, "the same text again", "de", "b", 0), (4, "the same text again", "de", "b", 0), (5, "the same text again", None, "b", 0), (6, " \n\t ", "en", "c", 0)]


def test_stages_take_odd_rows_and_other_columns(spark, sf):
    docs = spark.createDataFrame([(*r, f"x{i}", i) for i, r in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, _key string, size int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_key", "size"]
        rows = docs.collect()
        if name in ("toxicity", "line_dedup"):
            assert len(rows) == len(ODD)
        if name == "shingle_join":
            assert sorted(str(r.doc_id) for r in rows if r.text == "the same text again") == ["4", "4"]
            assert any(r.doc_id is None for r in rows)
    packed = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()]
    check_packed(packed)
    assert {r["doc_id"] for r in packed} == {r.doc_id for r in docs.collect()}


def test_stages_take_an_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.count() == 0
