"""The command line, file sinks, sampling sources, ranks without windows over whole groups, model stages."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from veridraft import __main__ as program
from veridraft import schema
from veridraft.operators import scoring, training
from veridraft.operators.ranking import BUCKETS, first_rows, hash_bucket, hex_bucket, ranked
from veridraft.sources import files, lake
from veridraft.taxonomy import NAMES, taxonomy, write_taxonomy


@pytest.fixture
def said():
    lines = []
    return lines


def run(spark, said, *argv, **more):
    args = program.arguments(list(argv))
    return program.STEPS[args.step](spark, args, said.append, **more)


def test_check(spark, said, tmp_path):
    bad, good, other = tmp_path / "bad.md", tmp_path / "good.txt", tmp_path / "code.py"
    bad.write_text("# Head\n\nDon't utilize it; the file is read by the parser.\n")
    good.write_text("All is well.\n")
    other.write_text("don't\n")
    assert run(spark, said, "check", str(bad), str(good), str(other), str(tmp_path / "none.md")) == 1
    assert said[0].startswith(f"{bad}:3: [") and "in 2 files" in said[-1]
    n = len(said) - 1
    assert run(spark, said, "check", str(bad), "--max-findings", str(n)) == 0
    assert run(spark, said, "check", str(bad), "--threshold", "1.1") == 0
    (tmp_path / "t.json").write_text('{"Contraction Used": 2.0}')
    assert run(spark, said, "check", str(bad), "--max-findings", str(n - 1), "--thresholds", str(tmp_path / "t.json")) == 0
    assert run(spark, said, "check", str(good)) == 0
    assert run(spark, said, "check", str(other)) == 0 and said[-1] == "no text files to check"
    assert run(spark, said, "check", "--base-ref", "main", changed=lambda ref: [str(bad)]) == 1


def test_changed_files_reads_git(tmp_path):
    seen = []

    def runner(command, **kw):
        seen.append(command)
        return subprocess.CompletedProcess(command, 0, stdout="a.md\n\nb.txt\n")

    assert files.changed_files("main", str(tmp_path), runner) == ["a.md", "b.txt"] and "main" in seen[0]


def test_scan_and_rewrite(spark, said, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "sub").mkdir()
    for at in ("a.md", "sub/b.md", ".hidden/c.md"):
        (tmp_path / at).write_text("---\nname: don't\n---\nWe utilize it. Don't stop.\n", newline="")
    (tmp_path / "same.md").write_text("All is well.\n")
    assert run(spark, said, "scan", str(tmp_path)) == 0
    assert "\na.md" in said and "\nsub/b.md" in said and not any("hidden" in x for x in said)
    assert run(spark, said, "rewrite", str(tmp_path), "--dry-run") == 0 and "2 files would change" in said
    assert "utilize" in (tmp_path / "a.md").read_text()
    assert run(spark, said, "rewrite", str(tmp_path)) == 0 and "2 files rewritten" in said
    assert (tmp_path / "a.md").read_text() == "---\nname: don't\n---\nWe use it. do not stop.\n" == (tmp_path / "sub/b.md").read_text()
    assert "utilize" in (tmp_path / ".hidden/c.md").read_text() and sorted(p.name for p in tmp_path.iterdir()) == [".hidden", "a.md", "same.md", "sub"]
    assert run(spark, said, "rewrite", str(tmp_path), "--name", "a.md") == 0 and "0 files rewritten" in said


def test_build(spark, said, tmp_path):
    root = str(tmp_path / "lake")
    write_taxonomy(spark, f"{root}/trope")
    ids = {r.name: r.trope_id for r in taxonomy(spark).collect()}
    lake.write_table(spark.createDataFrame([(f"s{i}", "d", i, 0, 1, f"t{i}") for i in range(40)], schema.SENTENCE), f"{root}/sentence")
    lake.write_table(spark.createDataFrame([(f"s{i}", ids["Passive Voice"], "x", 0.9) for i in range(20)] + [("s1", "unknown", "x", 1.0)], schema.SENTENCE_TROPE_LABEL), f"{root}/sentence_trope_label", "trope_id")
    lake.write_table(spark.createDataFrame([("r1", "s1", ids["Passive Voice"], "new", "x")], schema.SENTENCE_REWRITE), f"{root}/sentence_rewrite", "trope_id")
    assert run(spark, said, "build", root, str(tmp_path / "out")) == 0
    split = {n: files.training_scan(spark, str(tmp_path / "out"), n) for n in ("train", "val", "test")}
    assert {n: t.count() for n, t in split.items()} == {"train": 32, "val": 4, "test": 4}
    assert training.label_names(*split.values()) == sorted(NAMES)
    assert [tuple(r) for r in files.training_scan(spark, str(tmp_path / "out")).select("source_text", "target_text", "trope_name").collect()] == [("t1", "new", "Passive Voice")]


def test_pack(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text("hello" * 1000)
    assert 0 < files.pack_folder(str(tmp_path / "in"), str(tmp_path / "p.zst")) < 1000
    files.unpack(str(tmp_path / "p.zst"), str(tmp_path / "p.tar"))
    import tarfile

    assert sorted(tarfile.open(tmp_path / "p.tar").getnames()) == ["in", "in/x"]


def test_ranks_and_first_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k string").withColumn("h", F.sha2("k", 256))
    got = {(r.g, r.k): (r._rank, r._size) for r in ranked(df, ["g"], hex_bucket(F.col("h")), ["h", "k"]).collect()}
    import hashlib

    for g in ("a", "b", None):
        order = sorted((k for x, k in rows if x == g), key=lambda k: hashlib.sha256(k.encode()).hexdigest())
        assert [got[g, k] for k in order] == [(i + 1, len(order)) for i in range(len(order))]
    every = sorted((k for _, k in rows), key=lambda k: hashlib.sha256(k.encode()).hexdigest())
    for n in (0, 1, 1234, 3000, 5000):
        assert sorted(r.k for r in first_rows(df, n, hex_bucket(F.col("h")), ["h", "k"]).collect()) == sorted(every[:n])
    b = spark.range(200).select(F.xxhash64("id").alias("h")).select("h", hash_bucket(F.col("h")).alias("b")).orderBy("h").collect()
    assert all(x.b <= y.b for x, y in zip(b, b[1:])) and 0 <= b[0].b and b[-1].b < BUCKETS
    assert first_rows(df.limit(0), 5, hex_bucket(F.col("h")), ["h", "k"]).count() == 0
    assert files.sampled(df, 17, key="k").count() == 17


def test_csv_ranges(spark):
    header = b"text,attack\n"
    body = b"".join(f'"row {i}, with comma",{"none" if i % 3 else "typo"}\n'.encode() for i in range(500))
    whole = header + body

    def fetch(a, b):
        if a > 9000:
            raise OSError("gone")
        return whole[a : b + 1]

    got = files.csv_ranges(spark, lambda: len(whole), fetch, ["text", "attack"], chunks=4, length=1500)
    rows = got.collect()
    assert rows and all(r.attack == "none" and r.text.endswith(", with comma") for r in rows)
    assert files.chunk_offsets(100, 7, 4_000) == [0] and files.chunk_offsets(7_000, 4, 1_000) == [0, 2000, 4000, 6000]


def test_shard_scan(spark, tmp_path):
    spark.createDataFrame([("human", "a", 1), ("human", "b", 1), ("gpt", "c", 1)], "source string, text string, id int").write.parquet(str(tmp_path / "s"))
    assert sorted((r.text, r.is_ai_generated) for r in files.shard_scan(spark, [str(tmp_path / "s")], 8).collect()) == [("a", False), ("b", False), ("c", True)]


def test_model_stages(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["the pump is red", "close valve now"][i % 2], i % 2 == 0) for i in range(60)], "id int, text string, red boolean")
    front, models = scoring.fit_one_vs_rest(rows, ["red"])
    scores = scoring.fitted_scores(rows, front, models)
    out = scoring.evaluated(scores, spark.createDataFrame([], "name string, threshold double")).first()
    assert (out.name, out.tp, out.fp, out.fn, out.f1) == ("red", 30, 0, 0, 1.0)
    stored = scoring.load_models(scoring.save_models(front, models, str(tmp_path / "models")))
    assert [r.prediction == float(r.red) for r in stored["red"].transform(rows).collect()] == [True] * 60
    vectors = spark.createDataFrame([(i, [1.0, 0.1 * i] if i % 2 else [0.1 * i, -1.0], i % 2 == 1) for i in range(1, 41)], "id int, embedding array<double>, odd boolean")
    head = scoring.fit_head(vectors, ["odd"])
    scoring.save_head(head, str(tmp_path / "head.json"))
    again = vectors.select("odd", scoring.head_scores(F.col("embedding"), scoring.load_head(str(tmp_path / "head.json"))).alias("p")).collect()
    assert sum((r.p[0] > 0.5) == r.odd for r in again) >= 36
    pooled = spark.sql("SELECT array(array(1D, 2D), array(3D, 4D), array(9D, 9D)) AS t, array(1, 1, 0) AS m, array() AS e").select(scoring.mean_pooled(F.col("t"), F.col("m")).alias("p"), scoring.mean_pooled(F.col("t")).alias("q")).first()
    assert pooled.p == [2.0, 3.0] and pooled.q == pytest.approx([13 / 3, 5.0])
    assert scoring.greedy_decode(lambda ids: [0, 0, 1] if len(ids) > 3 else [0, 1, 0], 0, 2) == [1, 1, 1]
    assert scoring.greedy_decode(lambda ids: [0, 1, 0], 0, 2, most=5) == [1] * 5
    assert scoring.providers(["CoreMLExecutionProvider"], "darwin") == ["CoreMLExecutionProvider", "CPUExecutionProvider"] and scoring.providers(["X"], "linux") == ["CPUExecutionProvider"]
    assert scoring.renamed(rows, {"text": "t", "none": "x"}).columns == ["id", "t", "red"]


def test_both_plans_of_a_key_list_agree(spark):
    from veridraft.runtime import small_or_plain

    keys = spark.range(10).select(F.col("id").alias("k"))
    rows = spark.range(100).select((F.col("id") % 20).alias("k"))
    counts = [rows.join(small_or_plain(keys, limit), "k", how).count() for limit in (0, 1000) for how in ("left_semi", "left_anti")]
    assert counts == [50, 50, 50, 50]


def test_now_and_change_counts(spark):
    import datetime

    from veridraft.functions.text import change_count, now_iso

    rows = spark.createDataFrame([("marketing-adj: x → y (12)",), ("a: b (of 3 (4))",), ("plain",), (None,)], "l string").select(change_count(F.col("l")).alias("n"), now_iso().alias("t")).collect()
    assert [r.n for r in rows] == [12, 4, 1, None]
    assert abs((datetime.datetime.fromisoformat(rows[0].t) - datetime.datetime.now(datetime.timezone.utc)).total_seconds()) < 300


def test_phrase_model(spark):
    from veridraft.operators.phrases import changes_of, fit_phrases, phrase_model

    assert changes_of("We utilize the pump prior to work", "We use the pump before work") == [("utilize", "use"), ("prior to", "before")]
    rows = [(f"We utilize pump {i} prior to work", "Banned Synonym", f"We use pump {i} before work") for i in range(5)] + [(None, "x", "y"), ("a", None, "b"), ("same", "x", "same"), ("rare word", "x", "seldom word")]
    table = fit_phrases(spark.createDataFrame(rows, "source_text string, trope_name string, target_text string"))
    assert {(r.name, r.phrase, r.rewrite, r.n) for r in table.collect()} == {("Banned Synonym", "utilize", "use", 5), ("Banned Synonym", "prior to", "before", 5)}
    df = spark.createDataFrame([("Banned Synonym", "Utilize it prior to lunch."), ("Passive Voice", "Utilize it.")], "name string, text string")
    assert [r.suggested_rewrite for r in scoring.model_rewrites(df, phrase_model(table)).collect()] == ["Use it before lunch.", "Utilize it."]
    assert phrase_model(table.limit(0))(["remove x: a b"]) == ["a b"]
