"""One consistent form for texts that look the same, by code points in rows.

Texts with a character beyond a plain set are cut at blanks into positioned tokens. Every distinct
token is exploded once to positioned code points; a broadcast table (bounded by Unicode itself,
some 20,000 rows built by rule from the Unicode data) gives each its canonical decomposition,
combining class, script and look-alikes. Marks are ordered by class within their cluster, unseen
characters go, words are brought to one script (for each script the text around may have), and the
token is rebuilt and recomposed. The texts then take their tokens' forms: the script with most
unmistakable letters in the text decides which. Plain rows only have their blanks collapsed,
within the JVM.

Skew: a token that stands in many texts is one row of the dictionary; the join back is salted, so
its occurrences are spread over SALTS partitions.

Edge cases: null stays null, a blank text becomes the empty text (and takes part in no pair);
repeated rows and texts count once; a very long text is handled as rows, its rebuilt string in one
task; ties (a word with as many letters of two scripts) go to the script of the text, then Latin.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .canonical import BLANK_RUN, FROM_LATIN, blanks_collapsed, in_script, is_anchor, is_suspect, plain_char, script_of
from ..runtime import evenly, once

#: Texts of these characters alone need no more than their blanks collapsed.
PLAIN = "^[\\x20-\\x7E\\t\\n\\rÀ-ÖØ-öø-ÿ—’“”]*+$"

AS = {"L": "as_l", "C": "as_c", "G": "as_g"}
SALTS = 8
_SHARED = "".join(sorted(set(FROM_LATIN["C"]) | set(FROM_LATIN["G"])))  # ASCII letters with a twin in another script
#: A run of ASCII letters and digits that has a letter, but none of unmistakable shape: its form depends on the text.
_UNSETTLED = f"(?<![A-Za-z0-9])[0-9]*[{_SHARED}][0-9{_SHARED}]*(?![A-Za-z0-9])"


@functools.lru_cache(maxsize=1)
def mapping_rows() -> list:
    """(ch, [(c, ccc, script, anchor, L, C, G)]) of each character that is not its own plain letterless self."""
    rows = []
    for o in range(sys.maxunicode + 1):
        if 0xAC00 <= o <= 0xD7A3 or 0xD800 <= o <= 0xDFFF or 0x4E00 <= o <= 0x9FFF or (0x20000 <= o < 0x2F800) or o >= 0xE0200:
            continue
        ch = chr(o)
        plain = plain_char(ch)
        out = unicodedata.normalize("NFD", plain)
        if out == ch and not script_of(ch) and not unicodedata.combining(ch):
            continue
        parts = []
        for c in out:
            s = script_of(c)
            parts.append((c, unicodedata.combining(c), s, bool(s) and is_anchor(c, s), *(in_script(c, s, t) for t in "LCG")))
        rows.append((ch, parts))
    return rows


def mapping_table(spark: SparkSession) -> DataFrame:
    part = "struct<glyph:string,ccc:int,script:string,anchor:boolean,as_l:string,as_c:string,as_g:string>"
    return spark.createDataFrame(mapping_rows(), f"ch string, parts array<{part}>")


@F.pandas_udf(StringType())
def _recompose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def _best(v) -> Column:
    return F.when((v["L"] >= v["C"]) & (v["L"] >= v["G"]), "L").when(v["C"] >= v["G"], "C").otherwise("G")


def _spelled(w: Column, main: str) -> Column:
    """A word in the script that fits it, within a text of script ``main``."""
    n, a, x = w["n"], w["a"], w["x"]
    kinds = sum(((n[s] > 0).cast("int") for s in "LCG"), F.lit(0))
    settled = (kinds == 0) | ((kinds == 1) & (a["L"] + a["C"] + a["G"] > 0))
    # With a script that fits every letter: the text's own one first, then the more frequent.
    score = {s: F.when(x[s] == 0, F.lit(1_000_000 if main == s else 0) + n[s]).otherwise(F.lit(-1)) for s in "LCG"}
    fits = (x["L"] == 0) | (x["C"] == 0) | (x["G"] == 0)
    mixed = {s: a[s].cast("bigint") * 1_000_000 + n[s] * 10 + (1 if main == s else 0) for s in "LCG"}
    to = F.when(settled, "").when(fits, _best(score)).otherwise(_best(mixed))
    return F.array_join(F.transform(w["chars"], lambda c: F.when(to == "L", c["as_l"]).when(to == "C", c["as_c"]).when(to == "G", c["as_g"]).otherwise(c["glyph"])), "")


def token_forms(tokens: DataFrame) -> DataFrame:
    """tokens: k1, k2, token (distinct). Returns k1, k2, in_l, in_c, in_g (the form within a text of each script) and anchors of each script."""
    spark = tokens.sparkSession
    key = ["k1", "k2"]
    points = tokens.select(*key, F.posexplode(F.split("token", "")).alias("pos", "ch")).where(F.col("ch") != "")
    itself = F.array(
        F.struct(
            F.col("ch").alias("glyph"), F.lit(0).alias("ccc"), F.lit("").alias("script"), F.lit(False).alias("anchor"), F.col("ch").alias("as_l"), F.col("ch").alias("as_c"), F.col("ch").alias("as_g")
        )
    )
    mapped = points.join(F.broadcast(mapping_table(spark)), "ch", "left").select(*key, "pos", F.posexplode(F.coalesce("parts", itself)).alias("sub", "p")).select(*key, "pos", "sub", "p.*")
    in_token = Window.partitionBy(*key).orderBy("pos", "sub")
    wordly = (F.col("script") != "") | (F.col("ccc") > 0) | F.col("glyph").rlike("^[\\p{L}\\p{N}]")
    run = (
        mapped.withColumn("wordly", wordly)
        .withColumn("turn", F.when(F.col("wordly") == F.lag("wordly", 1).over(in_token), 0).otherwise(1))
        .withColumn("base", F.when(F.col("ccc") == 0, 1).otherwise(0))
        .withColumn("wid", F.sum("turn").over(in_token))
        .withColumn("cluster", F.sum("base").over(in_token))
    )
    letter = {s: F.sum(F.when(F.col("script") == s, 1).otherwise(0)).alias(s) for s in "LCG"}
    anchor = {s: F.sum(F.when((F.col("script") == s) & F.col("anchor"), 1).otherwise(0)).alias(s) for s in "LCG"}
    stuck = {s: F.sum(F.when((F.col("script") != "") & (F.col("script") != s) & (F.col(AS[s]) == F.col("glyph")), 1).otherwise(0)).alias(s) for s in "LCG"}
    words = run.groupBy(*key, "wid").agg(
        F.sort_array(F.collect_list(F.struct("cluster", "ccc", "pos", "sub", "glyph", "as_l", "as_c", "as_g"))).alias("chars"),
        *[letter[s].alias(f"n{s}") for s in "LCG"],
        *[anchor[s].alias(f"a{s}") for s in "LCG"],
        *[stuck[s].alias(f"x{s}") for s in "LCG"],
    )
    w = F.struct("chars", *[F.struct(*[F.col(f"{p}{s}").alias(s) for s in "LCG"]).alias(p) for p in "nax"])
    spelt = words.select(*key, "wid", *[f"a{s}" for s in "LCG"], once(w, "w")).select(*key, "wid", *[f"a{s}" for s in "LCG"], *[_spelled(F.col("w"), s).alias(f"f{s}") for s in "LCG"])
    whole = spelt.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("wid", *[f"f{s}" for s in "LCG"]))).alias("ws"), *[F.sum(f"a{s}").alias(f"a{s}") for s in "LCG"])
    joined = [F.array_join(F.col(f"ws.f{s}"), "") for s in "LCG"]
    return whole.select(*key, *[_recompose(j).alias(c) for j, c in zip(joined, ("in_l", "in_c", "in_g"))], *[f"a{s}" for s in "LCG"])


def rebuilt_forms(texts: DataFrame) -> DataFrame:
    """texts: k1, k2, text (distinct). Returns k1, k2, form."""
    cut_up = texts.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.posexplode(F.split("text", BLANK_RUN)).alias("at", "token")).where(F.col("token") != "")
    odd = (F.octet_length("token") > F.length("token")) | F.col("token").rlike("[\\x00-\\x1F\\x7F]") | F.col("token").rlike(_UNSETTLED)
    rows = cut_up.select("x1", "x2", "at", "token", odd.alias("odd"))
    plain = rows.where(~F.col("odd")).select("x1", "x2", "at", F.col("token").alias("in_l"), F.lit(None).cast("string").alias("in_c"), F.lit(None).cast("string").alias("in_g"), F.length(F.regexp_replace("token", f"[^A-Za-z]|[{_SHARED}]", "")).cast("bigint").alias("aL"), F.lit(0).cast("bigint").alias("aC"), F.lit(0).cast("bigint").alias("aG"))
    keyed = rows.where("odd").withColumns({"k1": F.xxhash64("token"), "k2": F.xxhash64(F.lit(7), "token")})
    forms = token_forms(evenly(keyed.groupBy("token").agg(F.first("k1").alias("k1"), F.first("k2").alias("k2")), "k1", "k2"))
    salted = forms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    looked = keyed.select("x1", "x2", "at", "k1", "k2", F.pmod("x1", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["k1", "k2", "salt"], "left").withColumns({"in_l": F.coalesce("in_l", F.lit("")), **{f"a{s}": F.coalesce(f"a{s}", F.lit(0).cast("bigint")) for s in "LCG"}})
    parts = plain.unionByName(looked.select(*plain.columns))
    whole = parts.groupBy("x1", "x2").agg(F.sort_array(F.collect_list(F.struct("at", "in_l", "in_c", "in_g"))).alias("ts"), *[F.sum(f"a{s}").alias(s) for s in "LCG"])
    main = _best({s: F.col(s) for s in "LCG"})
    picked = lambda t: F.when(F.col("main") == "C", F.coalesce(t["in_c"], t["in_l"])).when(F.col("main") == "G", F.coalesce(t["in_g"], t["in_l"])).otherwise(t["in_l"])
    form = F.array_join(F.filter(F.transform("ts", picked), lambda t: t != ""), " ")
    filled = whole.select(F.col("x1").alias("k1"), F.col("x2").alias("k2"), main.alias("main"), "ts").select("k1", "k2", form.alias("form"))
    blank = texts.where(~F.col("text").rlike(f"[^{BLANK_RUN[1:-2]}]")).select("k1", "k2", F.lit("").alias("form"))
    return filled.unionByName(blank)


def consistent_forms(records: DataFrame) -> DataFrame:
    """records: rec_table, rec_id, text (not null). Adds form, tkey (of the text): rec_table, rec_id, form, t1, t2."""
    keyed = records.select("rec_table", "rec_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), (is_suspect(F.col("text")) & ~F.col("text").rlike(PLAIN)).alias("odd"))
    plain = keyed.where(~F.col("odd")).select("rec_table", "rec_id", blanks_collapsed(F.col("text")).alias("form"), "t1", "t2")
    odd = keyed.where("odd")
    texts = odd.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "text").dropDuplicates(["k1", "k2"])
    forms = rebuilt_forms(texts)
    rebuilt = odd.select("rec_table", "rec_id", "t1", "t2").join(forms, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")))
    return plain.unionByName(rebuilt.select("rec_table", "rec_id", "form", "t1", "t2"))


def form_keys(records: DataFrame) -> DataFrame:
    """rec_table, rec_id, f1, f2 (128-bit key of the form), t1, t2 (of the text) of records whose form is not empty; repeated rows count once."""
    return (
        consistent_forms(records.where(F.col("text").isNotNull() & F.col("rec_id").isNotNull()))
        .where(F.col("form") != "")
        .select("rec_table", "rec_id", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(7), "form").alias("f2"), "t1", "t2")
    )


def same_form_pairs(keys: DataFrame) -> DataFrame:
    """Pairs id_a < id_b of one table whose forms agree and whose texts differ.

    Only forms that stand in more than one spelling enter the join, so a text repeated any number
    of times with one spelling costs nothing.
    """
    by = ["rec_table", "f1", "f2"]
    mixed = keys.groupBy(*by).agg(F.min("t1").alias("lo"), F.max("t1").alias("hi"), F.min("t2").alias("lo2"), F.max("t2").alias("hi2")).where("lo <> hi or lo2 <> hi2").select(*by)
    rows = keys.join(mixed, by, "left_semi").distinct()
    x, y = rows.alias("x"), rows.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in by]
    differ = (F.col("x.t1") != F.col("y.t1")) | (F.col("x.t2") != F.col("y.t2"))
    return x.join(y, same[0] & same[1] & same[2] & differ & (F.col("x.rec_id") < F.col("y.rec_id"))).select(F.col("x.rec_table").alias("rec_table"), F.col("x.rec_id").alias("id_a"), F.col("y.rec_id").alias("id_b")).distinct()
