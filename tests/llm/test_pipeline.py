"""The pipeline's stages follow each other as brute force says, on a small folder of tables."""

import random

import corpus_pipeline

from .test_ops import brute_lines, brute_near


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        w = ["w%d" % rng.randrange(3000) for _ in range(70)]
        if i % 8 == 0:
            w[3] = w[40] = "vilest"
        rows.append((i, " ".join(w[:35]) + "\n" + " ".join(w[35:])))
    rows += [(500 + k, rows[k][1].replace(" ", " q%d " % k, 1)) for k in (1, 2, 3)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf_dir = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert set(before) - set(after) == {i for i in range(160) if i % 8 == 0}
        if name == "line_dedup":
            gone = brute_lines(list(before.items()))
            assert after == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in before.items()}
        if name == "near_dedup":
            assert set(after) == {i for i, _, c, kept in brute_near(list(before.items()), 80) if kept}
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()


def test_pipeline_odd_rows(spark, tmp_path):
    """Null and repeated ids, odd texts and empty tables go through every stage, whose clean rows stay."""
    from .test_ops import ODD

    rows = [*enumerate(ODD), (3, "a"), (3, "other words of the same id"), (None, "b c"), (None, None), (None, "b c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("odd", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, "s", None) for i, t in some], schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, 1, 1), (0, None, None)][: len(some)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for step, (what, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{step}")
            docs = spark.read.parquet(f"{folder}/{step}")
            if what in ("toxicity", "line_dedup"):
                assert docs.count() == len(some)
            if what == "near_dedup":  # the two texts of document 3 are one document; rows without an id stay
                assert {r.doc_id for r in docs.collect()} == {i for i, _ in some}
        assert docs.agg({"length": "sum"}).first()[0] == (sum(r.doc_tokens for r in docs.where("start = 0").collect()) if some else None)
