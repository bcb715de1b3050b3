"""The pipeline's stages: columns, what each removes, and the whole run."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept = out.count()
        assert 0 < kept <= n, name
        if name != "mixture":
            assert out.columns == columns
            assert kept > 0.6 * n, name
        docs, n = corpus_pipeline.written(out, "stage"), kept


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).select(*spark.read.parquet(f"{SF}/documents.parquet").columns)
    assert docs.count() == 0


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, long texts, and extra columns whose names the stages use inside."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, tk long, drop int, suspect boolean"
    long_text = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, None, None, None, None, None, None, None, None, None), (1, "", None, "s", 0, "r", 1, 1, 1, True), (2, long_text, "en", "s", 1, "r", 1, 1, 1, True), (2, long_text, "en", "s", 1, "r", 1, 1, 1, True), (3, long_text, "en", "s", 1, "r", 1, 1, 1, False), (None, "a line of its own", None, None, None, "r", 2, 2, 2, None)]
    docs = spark.createDataFrame(rows, schema).unionByName(base.select("doc_id", "text", "lang", "source", base["n_chars"].cast("long").alias("n_chars")), allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "odd")
        assert docs.columns == [x.split()[0] for x in schema.split(", ")], name
        texts = [r.text for r in docs.where("row is not null or text is null").collect()]
        assert texts.count(long_text) <= (3 if name == "toxicity" else 2 if name == "line_dedup" else 1), name
        assert long_text in texts and "a line of its own" in texts, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.columns == [*docs.columns, "probability"] and out.count() <= docs.count()
