"""Lake maintenance, ingestion, splits, sampling and thresholds."""

import pytest
from pyspark.sql import functions as F

from veridraft import schema
from veridraft.operators import scoring, training
from veridraft.sources import files, lake
from veridraft.streaming.documents import document_stream, finding_stream, unseen_texts
from veridraft.taxonomy import taxonomy


def test_lake(spark, tmp_path):
    path = str(tmp_path / "label")
    assert lake.read_table(spark, path, schema.SENTENCE_TROPE_LABEL).count() == 0
    with pytest.raises(FileNotFoundError):
        lake.read_taxonomy(spark, str(tmp_path / "none"), schema.TROPE)
    rows = spark.createDataFrame([("s1", "t1", "a", 0.5), ("s2", "t2", None, 1.0)], schema.SENTENCE_TROPE_LABEL)
    for _ in range(2):
        lake.append_rows(path, rows, schema.SENTENCE_TROPE_LABEL, "trope_id")
    got = lake.read_table(spark, path, schema.SENTENCE_TROPE_LABEL)
    assert got.count() == 2 and got.columns == schema.SENTENCE_TROPE_LABEL.names
    lake.replace_rows(path, "label_source", "a", spark.createDataFrame([("s3", "t1", "a", 0.1)], schema.SENTENCE_TROPE_LABEL), schema.SENTENCE_TROPE_LABEL, "trope_id")
    assert {r.sentence_id for r in lake.read_table(spark, path, schema.SENTENCE_TROPE_LABEL).collect()} == {"s2", "s3"}
    lake.append_rows(path, rows.limit(0), schema.SENTENCE_TROPE_LABEL, "trope_id")


def test_new_documents(spark):
    old = spark.createDataFrame([("d1", "h1", "t1")], "doc_id string, sha256 string, fetched_at string")
    new = spark.createDataFrame([("d1", "h1", "t2"), ("d2", "h2", "t2"), ("d2", "h2", "t2")], "doc_id string, sha256 string, fetched_at string")
    assert lake.new_documents(new, old).count() == 1
    assert lake.new_documents(new, old, "full_row").count() == 2


def test_ingest(spark):
    raw = spark.createDataFrame([(" One. Two. ", "a", None, False), ("One. Two.", "b", None, False), (" ", "c", None, True), (None, "c", None, True)], "text string, source string, url string, is_ai_generated boolean")
    docs, sents = training.ingest(raw, "2025-01-01")
    assert docs.count() == 1 and [r.text for r in sents.orderBy("ordinal").collect()] == ["One.", "Two."]


def test_ingest_pairs(spark):
    pairs = spark.createDataFrame([("Passive Voice", "It is done. It was read.", "Do it."), ("Unknown Rule", "x", "y")], "name string, positive string, rewrite string")
    docs, sents, label, rewrites, unmatched = training.ingest_pairs(pairs, taxonomy(spark), "2025-01-01")
    assert (docs.count(), sents.count(), label.count(), rewrites.count()) == (2, 3, 2, 1)
    assert [r.name for r in unmatched.collect()] == ["Unknown Rule"]
    whole = training.ingest_pairs(pairs, taxonomy(spark), "2025-01-01", split=False, label_source="synthetic-ste")
    assert (whole[0].count(), whole[1].count(), whole[2].count(), whole[3].count()) == (1, 1, 1, 1)


@pytest.mark.parametrize("n,want", [(5, (0, 0, 5)), (6, (1, 1, 4)), (30, (3, 3, 24))])
def test_split(spark, n, want):
    rows = training.stratified_split(spark.range(n).select(F.col("id").cast("string").alias("sentence_id")), F.lit("g"))
    count = {r.split_name: r["count"] for r in rows.groupBy("split_name").count().collect()}
    assert tuple(count.get(k, 0) for k in ("val", "test", "train")) == want


def test_negative_sample(spark):
    rows = spark.range(110).select(F.col("id").alias("sentence_id"))
    assert training.negative_sample(rows, F.col("sentence_id") < 10).count() == 40
    assert training.negative_sample(rows, F.lit(False)).count() == 1


def test_thresholds(spark):
    good = [("a", i / 100, i >= 40) for i in range(100)]
    bad = [("b", i / 100, i % 2 == 0) for i in range(100)]
    out = {r.name: r.threshold for r in training.best_thresholds(spark.createDataFrame(good + bad, "name string, score double, truth boolean")).collect()}
    assert out == {"a": 0.4, "b": 0.5}


def test_threshold_counts_by_brute_force(spark):
    rows = [("a", (i * 37 % 101) / 100, i % 3 == 0) for i in range(200)]
    got = {round(r.threshold * 100): (r.tp, r.fp, r.fn) for r in training.threshold_counts(spark.createDataFrame(rows, "name string, score double, truth boolean")).collect()}
    for k in range(10, 95):
        over = [t for _, s, t in rows if s >= k / 100 - 1e-9]
        assert got[k] == (sum(over), len(over) - sum(over), sum(t for _, s, t in rows) - sum(over))


def test_scoring(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    assert [r.x for r in df.orderBy("id").select(scoring.l2_normalized(F.col("v")).alias("x")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(scoring.linear_head(F.col("v"), [1.0, 2.0], 1.0).alias("x")).first().x == 12.0
    texts = spark.createDataFrame([("Rule", "a" * 2000)], "name string, text string")
    assert scoring.model_scores(texts, lambda xs: [[len(x)] for x in xs]).first().scores == [1800.0]
    assert scoring.model_rewrites(texts, lambda ps: [p[:12] for p in ps]).first().suggested_rewrite == "remove rule:"
    assert scoring.model_rewrites(texts).first().suggested_rewrite == scoring.UNAVAILABLE


def test_fit(spark):
    rows = spark.createDataFrame([("pump leaks oil", True), ("oil leaks", True), ("all fine", False), ("door closed", False)] * 5, "text string, leak boolean")
    front, models = scoring.fit_one_vs_rest(rows, ["leak"], features=1 << 10)
    out = models["leak"].transform(front.transform(rows)).select("leak", "prediction").distinct().collect()
    assert {(r.leak, r.prediction) for r in out} == {(True, 1.0), (False, 0.0)}


def test_files(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.md").write_text("no")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "SKILL.md").write_bytes(b"One\r\nTwo\xff.")
    (tmp_path / "a" / "b.bin").write_bytes(b"x")
    rows = files.read_texts(spark, str(tmp_path)).collect()
    assert [(r.path.endswith("a/SKILL.md"), r.text) for r in rows] == [(True, "One\nTwo.")]
    assert files.thresholds(spark, '{"a": 0.3}').first().threshold == 0.3 and files.thresholds(spark, None).count() == 0
    files.write_label_order(["x", "y"], str(tmp_path / "order.txt"))
    assert files.label_order(spark, str(tmp_path / "order.txt")) == ["x", "y"]

    class Out:
        stdout = "a.md\n\nb.txt\n"

    assert files.changed_files("main", runner=lambda *a, **k: Out) == ["a.md", "b.txt"]
    nested = spark.createDataFrame([(["h1"], None), (["h2"], ["m"])], "human_answers array<string>, chatgpt_answers array<string>")
    assert files.answers(nested, 2).count() == 3
    assert files.generated_pairs(spark.createDataFrame([("p",)], "prompt string"), lambda ps: ['ok [{"positive":"a","rewrite":"b"}]' for _ in ps]).first().rewrite == "b"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "The file is read. Fine here.", "en", "s")], schema.DOCUMENT).write.parquet(str(tmp_path / "in"))
    q = finding_stream(document_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert "Passive Voice" in {r.name for r in spark.table("found").collect()}
    timed = document_stream(spark, str(tmp_path / "in")).withColumn("at", F.current_timestamp())
    q = unseen_texts(timed, "at").writeStream.format("memory").queryName("unseen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("unseen").count() == 1
