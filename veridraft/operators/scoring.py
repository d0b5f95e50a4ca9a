"""Model stages: dense heads on embeddings, merged score vectors, fitted and pluggable scorers."""

from __future__ import annotations

import json
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rewriter_prompt, score_text
from .training import with_f1

UNAVAILABLE = "(rewriter model unavailable)"


def l2_normalized(v: Column) -> Column:
    """A vector over its length; the null vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linear_head(v: Column, weights: list, bias: float = 0.0) -> Column:
    return F.aggregate(F.zip_with(v, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)


def padded(scores: dict, order: list) -> Column:
    """Named score columns in canonical order, zero where there is none."""
    return F.array(*[scores[n].cast("float") if n in scores else F.lit(0.0).cast("float") for n in order])


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def model_scores(rows: DataFrame, model=None, order: list | None = None, text: str = "text") -> DataFrame:
    """Adds scores (array of float). ``model``: a callable from a list of texts to a list of vectors; None: zeros."""
    if model is None:
        return rows.withColumn("scores", F.array(*[F.lit(0.0).cast("float") for _ in order or []]).cast("array<float>"))

    def run(batches):
        for b in batches:
            yield b.assign(scores=[[float(x) for x in v] for v in model(b["_scored"].tolist())]).drop(columns="_scored")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", scores array<float>"
    return rows.withColumn("_scored", score_text(F.coalesce(F.col(text), F.lit("")))).mapInPandas(run, schema)


def model_rewrites(rows: DataFrame, model=None, name: str = "name", text: str = "text") -> DataFrame:
    """Adds suggested_rewrite. ``model``: a callable from prompts to texts; None: a fixed notice."""
    if model is None:
        return rows.withColumn("suggested_rewrite", F.lit(UNAVAILABLE))

    def run(batches):
        for b in batches:
            yield b.assign(suggested_rewrite=model(b["_prompt"].tolist())).drop(columns="_prompt")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", suggested_rewrite string"
    return rows.withColumn("_prompt", rewriter_prompt(F.col(name), F.col(text))).mapInPandas(run, schema)


def fit_one_vs_rest(rows: DataFrame, labels: list, text: str = "text", features: int = 1 << 16):
    """A logistic model for each boolean label over hashed, idf-weighted words: {label: PipelineModel}."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    front = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_w", pattern="[^\\p{L}\\p{N}]+"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_x", p=2.0),
        ]
    ).fit(rows)
    x = front.transform(rows)
    return front, {n: LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=30, regParam=1e-3).fit(x.withColumn("_y", F.col(f"`{n}`").cast("double"))) for n in labels}


def mean_pooled(tokens: Column, mask: Column | None = None) -> Column:
    """Mean of token vectors (array of arrays), of those whose mask is not 0; no token: an empty vector."""
    kept = tokens if mask is None else F.filter(F.transform(tokens, lambda v, i: F.when(F.get(mask, i) != 0, v)), lambda v: v.isNotNull())
    total = F.aggregate(F.slice(kept, 2, 1 << 30), F.transform(F.get(kept, F.lit(0)), lambda x: x.cast("double")), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.coalesce(F.transform(total, lambda x: x / F.size(kept)), F.array().cast("array<double>"))


def head_scores(embedding: Column, head: dict) -> Column:
    """Probabilities of a linear head on the normalised embedding. head: name to (weights, bias); the order of its names is that of the scores."""
    v = l2_normalized(embedding)
    return F.array(*[sigmoid(linear_head(v, weights, bias)) for weights, bias in head.values()])


def save_head(head: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({n: {"weights": [float(w) for w in weights], "bias": float(bias)} for n, (weights, bias) in head.items()}, f)


def load_head(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return {n: (m["weights"], m["bias"]) for n, m in json.load(f).items()}


def fit_head(rows: DataFrame, labels: list, embedding: str = "embedding", steps: int = 30) -> dict:
    """A linear head for each boolean label on normalised embeddings, as :func:`head_scores` takes it."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = rows.select(*[F.col(f"`{n}`").cast("double").alias(f"_y{i}") for i, n in enumerate(labels)], array_to_vector(l2_normalized(F.col(embedding))).alias("_x"))
    head = {}
    for i, n in enumerate(labels):
        m = LogisticRegression(featuresCol="_x", labelCol=f"_y{i}", maxIter=steps, regParam=1e-3).fit(x)
        head[n] = (m.coefficients.toArray().tolist(), float(m.intercept))
    return head


def fitted_scores(rows: DataFrame, front, models: dict) -> DataFrame:
    """key columns of ``rows`` and, for every label, a row of name, score (the probability) and truth (the label's own column)."""
    from pyspark.ml.functions import vector_to_array

    x = front.transform(rows)
    keep = [c for c in rows.columns if c not in models]
    for n, m in models.items():
        x = m.setFeaturesCol("_x").transform(x).withColumn(f"_p_{n}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    told = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`_p_{n}`").alias("score"), F.col(f"`{n}`").alias("truth")) for n in models])
    return x.select(*keep, F.explode(told).alias("t")).select(*keep, "t.*")


def evaluated(scores: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """scores: name, score, truth of a held-out split. tp, fp, fn, precision, recall, f1 of every name at its threshold."""
    told = scores.join(F.broadcast(thresholds), "name", "left").withColumn("hit", F.col("score") >= F.coalesce("threshold", F.lit(default)))
    counts = told.groupBy("name").agg(F.count_if(F.col("hit") & F.col("truth")).alias("tp"), F.count_if(F.col("hit") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("hit") & F.col("truth")).alias("fn"))
    return with_f1(counts)


def spliced(front, model):
    """The text stages and a label's model as one pipeline, from texts to probabilities."""
    from pyspark.ml import PipelineModel

    return PipelineModel(stages=[*front.stages, model])


def save_models(front, models: dict, root: str) -> dict:
    """The spliced pipelines under ``root``, numbered in the order of their names; the path of each."""
    paths = {n: f"{root.rstrip('/')}/{i:04d}" for i, n in enumerate(models)}
    for n, path in paths.items():
        spliced(front, models[n]).write().overwrite().save(path)
    return paths


def load_models(paths: dict) -> dict:
    from pyspark.ml import PipelineModel

    return {n: PipelineModel.load(path) for n, path in paths.items()}


def greedy_decode(step, start: int, end: int, most: int = 64) -> list:
    """Token ids from ``step(ids)`` (scores of the next token) until ``end`` or ``most`` tokens; the start token is not returned."""
    ids = [start]
    while len(ids) <= most:
        scores = step(ids)
        best = max(range(len(scores)), key=scores.__getitem__)
        if best == end:
            break
        ids.append(best)
    return ids[1:]


def renamed(df: DataFrame, names: dict) -> DataFrame:
    """Columns under other names; names that are not there are passed over."""
    return df.withColumnsRenamed(names)


def providers(available: list | None = None, platform: str | None = None) -> list:
    """Execution providers of the runtime in order of preference: the accelerator of macOS where there is one, else the processor."""
    if available is None:
        import onnxruntime

        available = onnxruntime.get_available_providers()
    first = "CoreMLExecutionProvider"
    return ([first] if (platform or sys.platform) == "darwin" and first in available else []) + ["CPUExecutionProvider"]


def session_for(path: str, say=None, custom_ops: str | None = None):
    """A runtime session of a stored graph; ``say`` is told which provider it took."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    if custom_ops:
        options.register_custom_ops_library(custom_ops)
    session = onnxruntime.InferenceSession(path, options, providers=providers())
    if say:
        say(f"{path}: {session.get_providers()[0]}")
    return session
