"""File sources: texts, changed files, label orders, thresholds, nested and sharded corpora."""

from __future__ import annotations

import csv
import io
import json
import os
import subprocess
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import extension
from ..operators.ranking import first_rows, hash_bucket

TEXT_EXTENSIONS = (".md", ".mdx", ".txt", ".rst")


@F.pandas_udf(StringType())
def decode_lossy(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that are none, line ends as newlines."""
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"), na_action="ignore")


def read_texts(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """path and text of the text files under a folder; folders that begin with a dot are left out; ``name`` picks one file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name or "*").load(root)
    base = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    files = files.withColumn("path", base).where(~F.col("path").rlike("/\\.[^/]+/"))
    if name is None:
        files = files.where(extension(F.col("path")).isin(*TEXT_EXTENSIONS))
    return files.select("path", decode_lossy("content").alias("text"))


def read_files(spark: SparkSession, paths: list) -> DataFrame:
    """path and text of the given files, the path as it was given."""
    named = spark.createDataFrame([(p, os.path.abspath(p)) for p in paths], "path string, _at string")
    read = spark.read.format("binaryFile").load([os.path.abspath(p) for p in paths])
    return read.select(F.regexp_replace("path", "^[a-z]+:/*(?=/)", "").alias("_at"), decode_lossy("content").alias("text")).join(F.broadcast(named), "_at").select("path", "text")


def write_back(rewritten: DataFrame, path: str = "path", text: str = "new_text") -> DataFrame:
    """path, written of every row: its text replaces the file, by way of a file beside it. The tasks write: the paths must be on a shared or local file system."""

    def run(batches):
        for b in batches:
            done = []
            for at, new in zip(b["path"], b["text"]):
                fresh = f"{at}.{uuid.uuid4().hex}"
                try:
                    with open(fresh, "w", encoding="utf-8", newline="") as f:
                        f.write(new)
                    os.replace(fresh, at)
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"path": b["path"], "written": done})

    return rewritten.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, "path string, written boolean")


def changed_files(base_ref: str, cwd: str = ".", runner=subprocess.run) -> list:
    """Paths added, copied or modified since ``base_ref``."""
    out = runner(["git", "diff", "--name-only", "--diff-filter=ACM", base_ref, "HEAD"], capture_output=True, text=True, check=True, cwd=cwd)
    return [line for line in out.stdout.splitlines() if line.strip()]


def label_order(spark: SparkSession, path: str) -> list:
    return [r.value for r in spark.read.text(path).collect() if r.value.strip()]


def write_label_order(names: list, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(names) + "\n")


def thresholds(spark: SparkSession, text: str | None) -> DataFrame:
    """name, threshold of a JSON map; None (no file): an empty table."""
    rows = [(k, float(v)) for k, v in json.loads(text).items()] if text else []
    return spark.createDataFrame(rows, "name string, threshold double")


def write_thresholds(rows: DataFrame, path: str) -> None:
    """A JSON map of the taxonomy's names (a few dozen rows)."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({r.name: r.threshold for r in rows.orderBy("name").collect()}, f, indent=2)


def answers(df: DataFrame, limit: int, human: str = "human_answers", machine: str = "chatgpt_answers") -> DataFrame:
    """text, is_ai_generated of the answers nested in the first ``limit`` rows."""
    first = df.limit(limit)
    kinds = [(human, False), (machine, True)]
    parts = [first.select(F.explode(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias("text"), F.lit(ai).alias("is_ai_generated")) for c, ai in kinds if c in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sampled(df: DataFrame, n: int, seed: int = 0, key: str = "text") -> DataFrame:
    """At most n rows, those of smallest hash (the sampling source)."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    return first_rows(df, n, hash_bucket(h), [h, key])


def shard_texts(df: DataFrame, human: bool, n: int = 8000, seed: int = 0) -> DataFrame:
    side = df.where((F.col("source") == "human") if human else (F.col("source") != "human"))
    return sampled(side.select("text"), n, seed).withColumn("is_ai_generated", F.lit(not human))


def shard_scan(spark: SparkSession, paths: list, n: int = 8000, seed: int = 0) -> DataFrame:
    """text, is_ai_generated of shards (parquet with source and text): of each the sample of the human side and of the other. Only the two columns are read."""
    parts = [shard_texts(spark.read.parquet(p).select("source", "text"), human, n, seed) for p in paths for human in (True, False)]
    return reduce(DataFrame.unionByName, parts)


def csv_chunk(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV cut out of the middle of a file: ragged rows are dropped, unattacked ones kept."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").option("escape", '"').csv(path).where("attack = 'none'")


def chunk_offsets(size: int, chunks: int = 7, length: int = 4_000_000) -> list:
    """Starts of ``chunks`` ranges of ``length`` bytes, spread evenly over a file of ``size`` bytes (fewer where it is smaller)."""
    last = max(0, size - length)
    return sorted({last * i // max(1, chunks - 1) for i in range(chunks)})


def csv_ranges(spark: SparkSession, size, fetch, names: list, attack: str = "attack", chunks: int = 7, length: int = 4_000_000) -> DataFrame:
    """Rows of byte ranges of a large CSV, ragged rows dropped, unattacked ones kept.

    size(): length of the file; fetch(start, end): the bytes of a range (end included), which may
    raise: that range is left out. The executors fetch, one range a row; the first two lines of a
    range (a header, or the rest of a row and the row after it) are dropped.
    """

    def run(batches):
        for b in batches:
            out = []
            for start in b["start"]:
                try:
                    text = fetch(int(start), int(start) + length - 1).decode("utf-8", "ignore")
                except Exception:  # noqa: BLE001, a range that fails is skipped
                    continue
                body = text.split("\n", 2)[2] if text.count("\n") > 1 else ""
                out += [r for r in csv.reader(io.StringIO(body)) if len(r) == len(names)]
            yield pd.DataFrame(out, columns=names)

    starts = spark.createDataFrame([(x,) for x in chunk_offsets(size(), chunks, length)], "start bigint").repartition(chunks)
    return starts.mapInPandas(run, ", ".join(f"`{n}` string" for n in names)).where(F.col(attack) == "none")


def targets(spark: SparkSession, paths: list) -> DataFrame:
    """path of the given ones that are text files by their extension and exist."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string").where(extension(F.col("path")).isin(*TEXT_EXTENSIONS))
    return rows.where(F.udf(os.path.isfile, "boolean")("path"))


def training_scan(spark: SparkSession, root: str, name: str = "rewrite_pairs") -> DataFrame:
    """A training table; a column it is laid out by comes back from the folder names."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def inline_pairs(spark: SparkSession, pairs: dict) -> DataFrame:
    """name, positive, rewrite of a dictionary of lists."""
    return spark.createDataFrame([(k, p, r) for k, v in pairs.items() for p, r in v], "name string, positive string, rewrite string")


def generated_pairs(prompts: DataFrame, client, prompt: str = "prompt") -> DataFrame:
    """Pairs made by a text generator: ``client(list of prompts)`` returns the answers; JSON arrays in them become rows."""
    from ..functions.text import json_array_slice

    def run(batches):
        for b in batches:
            yield b.assign(answer=client(b[prompt].tolist()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema) + ", answer string"
    answered = prompts.mapInPandas(run, schema)
    return answered.select(*prompts.columns, F.explode(json_array_slice(F.col("answer"))).alias("pair")).select(*prompts.columns, "pair.positive", "pair.rewrite")


def pack_folder(source: str, target: str, level: int = 19) -> int:
    """A folder as one tar file, zstd, on all threads; the size in bytes."""
    import tarfile

    import zstandard

    with open(target, "wb") as out, zstandard.ZstdCompressor(level=level, threads=-1).stream_writer(out, closefd=False) as packed:
        with tarfile.open(fileobj=packed, mode="w|") as tar:
            tar.add(source, arcname=os.path.basename(source.rstrip("/")))
    return os.path.getsize(target)


def unpack(source: str, target: str) -> None:
    """The packed stream as it was (a tar file is not taken apart)."""
    import zstandard

    with open(source, "rb") as packed, open(target, "wb") as out:
        zstandard.ZstdDecompressor().copy_stream(packed, out)
