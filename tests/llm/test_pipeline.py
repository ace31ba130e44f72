import corpus_pipeline as pipeline

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages_and_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out.persist()
    assert 0 < docs.select("doc_id").distinct().count() <= before
    packed = pipeline.run(spark, SF).collect()
    assert all(r.offset + r.length <= 4096 and len(r.ids) == r.length for r in packed)
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, None, "a"), (2, "", "s", "b"), (3, "some words " * 500, None, "c"), (3, "some words " * 500, None, "c"), (None, "x +1 (212) 555-0100 y", "s", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score string").withColumns({"size": pipeline.F.lit(1), "_extra": pipeline.F.lit(2), "target": pipeline.F.lit(3)})
    for name, stage in pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
    assert pipeline.near_dup_stage(spark, docs, SF).count() == 4
    assert pipeline.quality_stage(spark, docs, SF).columns == docs.columns
    assert "<PHONE>" in pipeline.pii_stage(spark, docs, SF).filter("doc_id IS NULL").first().text
    pipeline.packing_stage(spark, docs, SF).collect()


def test_stages_equal_plain_python(spark):
    """Each stage's rows, on what the stage before it kept, as plain Python finds them; and run()'s documents."""
    import numpy as np
    from test_operators import brute_components, brute_spans, whole_ids

    from logweir.llm import pii, quality
    from logweir.llm.mixing import mix_documents

    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    rows = {r.doc_id: r for r in docs.collect()}

    model = quality.train_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = stages["quality"](spark, docs, SF).persist()
    score = dict(zip(rows, model.score(np.array([quality.features(r.text) for r in rows.values()]))))
    assert {r.doc_id: r for r in good.collect()} == {i: r for i, r in rows.items() if score[i] >= quality.THRESHOLD}

    kept = {r.doc_id: r for r in good.collect()}
    component = brute_components([(i, r.text) for i, r in kept.items()])[0]
    unique = stages["near_duplicates"](spark, good, SF).persist()
    kept = {i: r for i, r in kept.items() if component[i] == i}
    assert {r.doc_id: r for r in unique.collect()} == kept

    found = pii.train_pii(unique)
    clean = stages["pii"](spark, unique, SF).persist()
    got = {r.doc_id: r for r in clean.collect()}
    assert {i: r.text for i, r in got.items()} == {i: pii.redact(r.text, found) for i, r in kept.items()}
    assert all(r.text == kept[i].text for i, r in got.items() if not brute_spans(kept[i].text) and not pii.proposals(kept[i].text))
    assert not any(brute_spans(r.text) for r in got.values())

    drawn = stages["mixing"](spark, clean, SF).persist()
    want = []
    for r in mix_documents(clean).collect():
        want += [(r.doc_id, d.words) for d in r.draws]
    mixed = drawn.collect()
    assert sorted((r.doc_id, len(r.text.split())) for r in mixed) == sorted(want)
    assert all(got[r.doc_id].text.startswith(r.text) for r in mixed)

    packed = stages["packing"](spark, drawn, SF).collect()
    ids = [i for r in mixed for i in [*whole_ids(r.text), 1]]
    assert sum(r.length for r in packed) == len(ids) and sorted(i for r in packed for i in r.ids) == sorted(ids)
    assert {r.doc_id for r in pipeline.run(spark, SF).select("doc_id").collect()} == {r.doc_id for r in packed}
