"""The pipeline, stage by stage, and the registry."""

import corpus_pipeline

import __spark_entry__

from .helpers import prose


def test_registry():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert any(x.startswith(f"op{n}_") for x in names)
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages(spark, sf):
    """Planted cases: each stage takes what it is for, and nothing else of the planted documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) >= 12)
    columns = docs.columns
    base = [prose(500 + i, 200).split() for i in range(8)]
    broken = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    planted = {
        900001: " ".join(base[0]),  # stays
        900002: " ".join(base[1]),  # stays, as the first of three
        900003: broken(base[1], 23),  # the same words in other lines: only the Jaccard join sees it
        900004: " ".join(base[1][:100] + ["changed"] + base[1][101:]),  # its only line is a fuzzy copy
        900005: " ".join(base[2]) + "\n" + " ".join(base[0]),  # loses its second line
        900006: " ".join(base[3]) + "\n" + item,  # holds a benchmark item
        900007: None,
        900008: "",
    }
    more = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in planted.items()], docs.schema)
    docs = docs.unionByName(more)
    texts, counts = [{r.doc_id: r.text for r in more.collect()}], [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stored(stage(spark, docs, sf), "test-stage")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            texts.append({r.doc_id: r.text for r in docs.filter("doc_id > 900000").collect()})
    assert texts[1] == planted
    assert texts[2] == {i: t for i, t in (planted | {900005: " ".join(base[2]) + "\n"}).items() if i != 900004}
    assert texts[3] == {i: t for i, t in texts[2].items() if i != 900003}
    assert texts[4] == {i: t for i, t in texts[3].items() if i != 900006}
    assert counts[0] > counts[1] > counts[2] > counts[3] > counts[4] == counts[5] > 0
    assert docs.filter("not round_trip").isEmpty()


def test_stages_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == []
        docs = spark.createDataFrame([], docs.schema)
