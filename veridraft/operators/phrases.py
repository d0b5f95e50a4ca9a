"""A rewriter fitted on pairs: phrases that change between a text and its rewrite, by rule.

Both sides of a pair are aligned word by word; every replaced or deleted run of up to LONGEST words
is a change of its rule. A phrase whose changes mostly go one way becomes an entry of the rule's
table, and a text is rewritten from left to right by its longest entries. It stands in where no
sequence model can be fitted; ``scoring.model_rewrites`` takes it as its model.

Edge cases: null texts and names are left out; equal texts change nothing; repeated pairs count as
often as they stand; ties between rewrites of a phrase go to the last in order of text; no pairs: an empty
table, which changes nothing.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST, LEAST, SHARE, MOST = 6, 3, 0.6, 20_000


def changes_of(source: str, target: str) -> list:
    """(phrase, rewrite) of the runs of words that change, in lower case."""
    a, b = source.split(), target.split()
    low = [w.lower() for w in a], [w.lower() for w in b]
    out = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, *low, autojunk=False).get_opcodes():
        if kind in ("replace", "delete") and j - i <= LONGEST and m - k <= LONGEST:
            out.append((" ".join(low[0][i:j]), " ".join(low[1][k:m])))
    return out


def fit_phrases(pairs: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """pairs: source_text, trope_name, target_text. name, phrase, rewrite, n: phrases changed ``least`` times or more, and in ``share`` of their changes into the rewrite."""

    def run(batches):
        for b in batches:
            rows = [(n, p, r) for s, n, t in zip(b["source_text"], b["trope_name"], b["target_text"]) for p, r in changes_of(s, t)]
            yield pd.DataFrame(rows, columns=["name", "phrase", "rewrite"])

    whole = pairs.select("source_text", "trope_name", "target_text").dropna()
    counts = whole.mapInPandas(run, "name string, phrase string, rewrite string").groupBy("name", "phrase", "rewrite").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("name", "phrase").agg(F.max(F.struct("n", F.col("rewrite").alias("rewrite"))).alias("b"), F.sum("n").alias("total"))
    return best.where((F.col("b.n") >= least) & (F.col("b.n") >= share * F.col("total"))).select("name", "phrase", "b.rewrite", F.col("b.n").alias("n"))


def phrase_model(table: DataFrame, most: int = MOST):
    """A callable from prompts (``remove <rule>: <text>``) to rewrites, of the ``most`` most frequent entries (the size of the model)."""
    rows = table.orderBy(F.desc("n"), "name", "phrase").limit(most).collect()
    entries = {(r.name.lower(), r.phrase): r.rewrite for r in rows}

    def rewrite(name: str, text: str) -> str:
        words, out, i = text.split(" "), [], 0
        while i < len(words):
            for k in range(min(LONGEST, len(words) - i), 0, -1):
                new = entries.get((name, " ".join(words[i : i + k]).lower()))
                if new is not None:
                    out += [new[:1].upper() + new[1:] if words[i][:1].isupper() else new] if new else []
                    i += k
                    break
            else:
                out.append(words[i])
                i += 1
        return " ".join(out)

    def model(prompts: list) -> list:
        told = [p.removeprefix("remove ").split(": ", 1) for p in prompts]
        return [rewrite(*t) if len(t) == 2 else "" for t in told]

    return model
