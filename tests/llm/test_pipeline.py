import corpus_pipeline

from tests.llm import brute


def test_stages_keep_clean_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    told = {r.doc_id for r in corpus_pipeline.language(spark, docs, path).collect()}
    kept = [(i, rows[i].text) for i in sorted(told)]
    component = brute.jaccard_components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    leaks = {i for i, *_ in brute.contamination(kept, items)}
    assert set(out) == {i for i, _ in kept} - leaks
    assert len(told) > 0.97 * len(rows)
    assert all(r.round_trip for r in out.values())
    assert [f for _, f in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = " ".join(f"c{i}" for i in range(60))
    docs = _docs(spark, [(None, clean), (None, f"x {item} y"), (7, clean + " more"), (7, f"{item} z"), (8, None), (9, ""), (7, clean + " more")])
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, clean), (7, clean + " more"), (7, clean + " more"), (8, None), (9, "")], key=str)
    docs = _docs(spark, [(5, clean), (3, clean), (None, clean), (3, clean), (4, clean + " end"), (6, "other words here"), (8, None), (8, None)])
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, clean), (3, clean), (3, clean), (6, "other words here"), (8, None), (8, None)], key=str)


def test_empty_tables_pass_all_stages(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, _docs(spark, []), str(tmp_path)).count() == 0
