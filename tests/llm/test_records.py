"""Near-duplicates, cross-split overlaps, grouped splits: against brute force on small data."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridraft.llm.canonical import canonical_text, consistent_form
from veridraft.llm.bagminhash import word_values
from veridraft.llm.components import connected_components
from veridraft.llm.crosssplit import CrossSplitOverlap, chain_and_extend
from veridraft.llm.grouping import GroupedSplit, assign_splits
from veridraft.llm.neardup import NearDuplicates

WORDS = "the red pump of valve near bay seven must be closed before shift while lamp and gauge stay green on left side during cold winter night for safety reasons".split()


def word_set(t):
    return [w for w in re.findall(r"[^\W_]+", canonical_text(t).lower())]


def overlap(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def texts(n=120, seed=1):
    rng = random.Random(seed)
    base = [[*rng.choices(WORDS, k=10), f"code{rng.randrange(10**6)}", f"unit{rng.randrange(10**6)}", *rng.choices(WORDS, k=4)] for _ in range(n // 3)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(2):
            c = list(b)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(c))
                c[i : i + 1] = rng.choice([[], ["extra"], [c[i], "again"], [c[i].upper()]])
            out.append(" ".join(c))
    return out


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"), ("zero​width﻿", "zerowidth"), ("é é", "é é"), ("Τhe рumр", "The pump"), ("a  b \n c", "a b c"), ("ﬁt", "fit"), ("x² CO₂", "x² CO₂"),
        ("‐ — ’ '", "- — ’ '"), ("Насос с клапаном", "Насос с клапаном"), ("", ""), ("  ", ""), ("Ο̂s set", "Ôs set"), ("ΝΜΝ-1 stands here", "NMN-1 stands here"),
    ],
)
def test_canonical(spark, text, want):
    assert canonical_text(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(consistent_form(F.col("t")).alias("f")).first().f == want


def test_canonical_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(consistent_form(F.col("t")).alias("f")).first().f is None


def test_bagminhash_estimates_weighted_overlap():
    rng = np.random.default_rng(0)
    words = rng.integers(-(2**62), 2**62, 60)
    weights = rng.integers(1, 33, 60)
    v = word_values(words, weights, 4000)
    a, b = slice(0, 40), slice(20, 60)
    got = np.mean(v[a].min(axis=0) == v[b].min(axis=0))
    assert abs(got - weights[20:40].sum() / weights.sum()) < 0.04
    # a heavier weight only adds points: values never grow
    assert (word_values(words, np.minimum(weights + 3, 32), 50) <= word_values(words, weights, 50)).all()


def test_neardup_against_brute_force(spark):
    ts = texts()
    rows = [(f"s{i:03d}", f"d{i % 7}", t) for i, t in enumerate(ts)] + [("s900", "d8", None), ("s901", "d8", ""), ("s902", "d8", "two words"), ("s000", "d0", ts[0]), ("s903", "d9", ts[0].upper())]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "sentence_id string, doc_id string, text string, rid string")
    nd = NearDuplicates(df, "text", "sentence_id", "doc_id")
    got = {(r.id_a, r.id_b) for r in nd.row_pairs().collect()}
    want = set()
    for (s, d, t), (s2, d2, t2) in itertools.combinations(sorted({r for r in rows if r[2]}), 2):
        a, b = word_set(t), word_set(t2)
        if s != s2 and d != d2 and len(a) >= 8 and len(b) >= 8 and overlap(a, b) >= 0.8 and canonical_text(t) != canonical_text(t2):
            want.add((min(s, s2), max(s, s2)))
    assert want and got == want
    groups = nd.groups()
    assert groups.where("links > 0").count() > 0 and groups.where("rid = 's900'").count() == 0
    assert NearDuplicates(df.limit(0), "text", "sentence_id", "doc_id").row_pairs().count() == 0


def test_a_hot_band_is_cut_into_blocks(spark, monkeypatch):
    import functools

    from veridraft.llm import neardup, pairing

    ts = texts(90, seed=8)
    df = spark.createDataFrame([(f"s{i:03d}", f"d{i}", t) for i, t in enumerate(ts)], "s string, d string, text string")
    want = {(r.id_a, r.id_b) for r in NearDuplicates(df, "text", "s", "d").row_pairs().collect()}
    # One key for all rows: every pair meets in one group, far over the bound.
    monkeypatch.setattr(neardup, "band_keys", lambda signatures, bands, rows: np.zeros((len(signatures), bands), dtype=np.int64))
    for bound, held in ((16, 64), (16, 10**6), (7, 10)):
        monkeypatch.setattr(pairing, "HELD", held)
        monkeypatch.setattr(neardup, "pairs_by_key", functools.partial(pairing.pairs_by_key, bound=bound))
        assert {(r.id_a, r.id_b) for r in NearDuplicates(df, "text", "s", "d").row_pairs().collect()} == want and want


def test_pairs_in_groups():
    from veridraft.llm import pairing

    rng = np.random.default_rng(3)
    key, ident = np.sort(rng.integers(0, 40, 300)), rng.integers(0, 200, 300)
    got = {(int(key[a]), *sorted((int(ident[a]), int(ident[b])))) for x, y in pairing._pairs(key, ident) for a, b in zip(x, y)}
    assert got == {(int(key[a]), *sorted((int(ident[a]), int(ident[b])))) for a, b in itertools.combinations(range(300), 2) if key[a] == key[b] and ident[a] != ident[b]}
    one, two = rng.random(300) < 0.3, rng.random(300) < 0.5
    got = sorted((int(a), int(b)) for x, y in pairing._across(key, one, two) for a, b in zip(x, y))
    assert got == [(a, b) for a in range(300) for b in range(300) if one[a] and two[b] and key[a] == key[b]]


def test_overlap_of_arrays(spark):
    from veridraft.llm.wordsets import images_of, may_overlap, overlapping

    rng = random.Random(4)
    rows = []
    for i in range(200):
        a = rng.sample(range(-50, 50), rng.randrange(1, 40))
        b = list(set(rng.sample(a, max(1, len(a) - rng.randrange(0, 4))) + rng.sample(range(-50, 50), rng.randrange(0, 4))))
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i bigint, a array<int>, b array<int>")
    want = {i for i, a, b in rows if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8}
    assert {r.i for r in overlapping(df, "a", "b", ["i"]).collect()} == want and want
    image = lambda x: images_of(np.array(x, dtype=np.int32), np.array([0, len(x)]))
    assert all(may_overlap(image(a), image(b))[0] for i, a, b in rows if i in want)


def test_texts_in_another_order_are_aligned(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india".split()
    turned = words[5:] + words[:5]
    mixed = words[::-1]
    rows = [(0, "v1", "val", "s", " ".join(turned)), (0, "v2", "test", "s", " ".join(mixed)), (0, "v3", "val", "s", " ".join(words)), (0, "t", "train", "s", " ".join(words)), (1, "v1", "val", "s", " ".join(words))]
    op = CrossSplitOverlap(spark.createDataFrame(rows, "realm int, rid string, split string, source string, text string"))
    got = {(r.realm, r.rid): round(r.coverage, 4) for r in op.concerned().collect()}
    assert got == {(0, "v1"): round(5 / 9, 4), (0, "v2"): round(1 / 9, 4), (0, "v3"): 1.0}


def test_recall_of_fingerprints_and_bands_on_given_tables(spark):
    """Both searches against all pairs, on the smallest given tables."""
    from veridraft.llm.records import QUERIES

    d = "/root/testdata/sf0.001"
    intake = {r.doc_id for r in spark.read.parquet(f"{d}/source_document.parquet").where("source = 'field-intake'").collect()}
    rows = sorted({(r.sentence_id, r.doc_id, r.text) for r in spark.read.parquet(f"{d}/sentence.parquet").select("sentence_id", "doc_id", "text").collect() if r.text and r.doc_id not in intake})
    sets = [(s, doc, frozenset(word_set(t)), canonical_text(t), len(word_set(t))) for s, doc, t in rows]
    sets = [x for x in sets if x[4] >= 8]
    near = {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(sets, 2) if a[0] != b[0] and a[1] != b[1] and a[3] != b[3] and 5 * len(a[2] & b[2]) >= 4 * len(a[2] | b[2])}
    got = {(r.sentence_id_a, r.sentence_id_b) for r in QUERIES["p7_found"](spark, d).collect()}
    assert got <= near and len(got) >= 0.98 * len(near) and near


def test_hot_copies_cost_nothing(spark):
    t = "one two three four five six seven eight nine"
    df = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("s"), F.concat(F.lit("d"), "id").alias("d"), F.lit(t).alias("text"))
    assert NearDuplicates(df, "text", "s", "d").row_pairs().count() == 0


def test_crosssplit_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i % 2, f"r{i:03d}", rng.choice(["train", "train", "val", "test", None]), "src", t) for i, t in enumerate(texts(seed=5))]
    rows += [(0, "n1", "val", None, None), (0, "n2", "test", "s", "short text")]
    op = CrossSplitOverlap(spark.createDataFrame(rows, "realm int, rid string, split string, source string, text string"))
    got = {(r.realm, r.rid) for r in op.concerned().collect()}
    want = set()
    for m, i, s, _, t in rows:
        a = word_set(t) if t else []
        if s in ("val", "test") and len(a) >= 8:
            for m2, _, s2, _, t2 in rows:
                b = word_set(t2) if t2 else []
                if m2 == m and s2 == "train" and len(b) >= 8 and overlap(a, b) >= 0.8:
                    want.add((m, i))
    assert want and got == want
    assert all(0 < r.coverage <= 1 for r in op.concerned().collect())


def test_sets_that_overlap_enough_share_a_key():
    from veridraft.llm import prefixes
    from veridraft.llm.winnowing import rolling_hashes
    from veridraft.runtime import sketch_count

    rng = np.random.default_rng(9)
    sets, near = [], []
    for n in [*range(1, 45), 50, 55, 60, 63, 64, 70, 79, 130, 159, 160, 170]:
        for _ in range(12):
            a = rng.choice(4000, n, replace=False)
            # the partner: up to what the overlap allows taken from anywhere, or new words put in
            away, more = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
            b = np.union1d(rng.permutation(a)[away:], rng.integers(4000, 5000, more))
            if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
                near.append((len(sets), len(sets) + 1))
            sets += [np.sort(a), b]
    values, offsets = np.concatenate(sets).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sketch = np.zeros(2 << 16, dtype=np.int64)
    h = rolling_hashes(values, 1)
    np.add.at(sketch, (h >> np.uint64(48)).astype(np.int64), 1)
    np.add.at(sketch, (h & np.uint64(65535)).astype(np.int64) + 65536, 1)
    assert (sketch_count(sketch, h.view(np.int64)) > 0).all() and len(near) > 200
    for few in (0, 0.5, 10, 1e9):
        row, key = prefixes.set_keys(values, offsets, sketch, len(sets), few=few)
        of = [set(key[row == i].tolist()) for i in range(len(sets))]
        assert all(of[i] & of[j] for i, j in near)


def test_crosssplit_finds_pairs_without_a_common_run(spark):
    """Every fourth word differs in place: no run of four words in common, another word set."""
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    moved = [words[i] for i in (3, 0, 7, 4, 1, 8, 5, 2, 9)]
    rows = [(0, "v", "val", "s", " ".join(moved)), (0, "t", "train", "s", " ".join(words)), (0, "w", "val", "s", " ".join(moved[:7]) + " one two")]
    op = CrossSplitOverlap(spark.createDataFrame(rows, "realm int, rid string, split string, source string, text string"))
    assert {r.rid for r in op.concerned().collect()} == {"v"}


def test_texts_of_one_template_are_not_all_compared(spark):
    """Pairs looked at grow with the table, not with its square: each phrase and each noun stands in a fixed share of all texts."""
    from veridraft.llm import crosssplit, pairing

    rng = random.Random(12)
    nouns = [f"noun{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    looked = {}
    for n in (4000, 16000):
        rows = [(0, f"r{i}", "train" if i % 4 else "val", "s", f"after the {rng.choice(nouns)} set the {rng.choice(nouns)} of the {rng.choice(nouns)} near the {rng.choice(nouns)} to code{rng.randrange(10**6)} by {rng.randrange(9000)} bar and write it down") for i in range(n)]
        counted = spark.sparkContext.accumulator(0)
        records = spark.createDataFrame(rows, "realm int, rid string, split string, source string, text string")
        usual = pairing.pairs_by_key

        def counting(blocks, spec, match, *rest, **more):
            def told(columns, x, y):
                counted.add(len(x))
                return match(columns, x, y)

            return usual(blocks, spec, told, *rest, **more)

        crosssplit.pairs_by_key = counting
        try:
            CrossSplitOverlap(records)
        finally:
            crosssplit.pairs_by_key = usual
        looked[n] = counted.value
    assert looked[16000] <= 8 * max(looked[4000], 16000)


def test_report_counts_a_sentence_in_each_of_its_sources(spark, tmp_path):
    from veridraft.llm.records import QUERIES

    t = "the red pump of valve seven must be closed before the shift"
    for name, columns, rows in (
        ("source_document", "doc_id string, source string", [("d1", "alpha"), ("d2", "Beta "), ("d3", "alpha"), ("d4", "gamma")]),
        ("sentence", "sentence_id string, doc_id string, text string", [("h", "d1", t), ("h", "d2", t), ("h", "d3", t), ("t", "d4", t)]),
        ("classifier_split", "sentence_id string, split_name string", [("h", "test"), ("t", "train")]),
        ("rewrite_pairs", "pair_id bigint, source string, source_text string, split_name string", [(1, "made", t, "val"), (2, "made", t, "train")]),
    ):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted(tuple(r) for r in QUERIES["p1_report"](spark, str(tmp_path)).collect())
    assert got == [("rewrite_pairs", "val", "made", 1, 1.0), ("sentence", "test", "alpha", 1, 1.0), ("sentence", "test", "beta", 1, 1.0)]


def test_chain():
    a, b = list("abcdefgh"), list("abXdefgh")
    assert chain_and_extend(a, b, [(0, 0), (3, 3)]) == 7
    assert chain_and_extend(a, b, []) == 0


def test_chain_looks_back_over_all_seeds():
    turned = [f"j{i}" for i in range(250)]
    a, b = [*"abc", *turned, *"def"], [*"abcdef", *turned[::-1]]
    seeds = [(i, b.index(w)) for i, w in enumerate(a)]
    assert chain_and_extend(a, b, seeds) == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7), (None, 3)] + [(500, 600 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[300] == 100 and all(got[600 + i] == 500 for i in range(40)) and 7 in got
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_grouped_split(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", f"d{i // 10:03d}") for i in range(3000)] + [("s0", "d250"), ("s2500", "d299"), ("s0", "d000"), (None, "d1"), ("s1", None)]
    sent = spark.createDataFrame(rows, "sentence_id string, doc_id string")
    labels = spark.createDataFrame([(f"s{i}", rng.choice("abc")) for i in range(0, 3000, 2)] + [("unknown", "a"), ("s1", None)], "sentence_id string, trope_id string")
    plan = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split_name string, target_share double")
    g = GroupedSplit(sent, labels, plan)
    out = g.assignment().collect()
    assert {(r.node, r.component) for r in g.related.collect()} == {("d000", "d000"), ("d250", "d000"), ("d299", "d000")}
    by_group: dict = {}
    for r in out:
        by_group.setdefault(r.group_key, set()).add(r.split_name)
    assert all(len(v) == 1 for v in by_group.values())
    share = {s: len({r.sentence_id for r in out if r.split_name == s}) / 3000 for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["val"] - 0.1) < 0.03 and abs(share["test"] - 0.1) < 0.03
    for lab in "abc":
        of = {r.sentence_id: r.split_name for r in out}
        hits = [of[r.sentence_id] for r in labels.where(F.col("trope_id") == lab).collect() if r.sentence_id in of]
        assert all(abs(hits.count(n) / len(hits) - s) < 0.03 for n, s in (("train", 0.8), ("val", 0.1), ("test", 0.1))), lab
    assert GroupedSplit(sent.limit(0), labels, plan).assignment().count() == 0


def test_small_components_are_stratified_by_all_their_labels(spark):
    # Every component is below 1/2000 of the rows; label b sits mostly in the components of the rarer label a.
    rng = random.Random(4)
    items = [(f"p{i}", f"p{i}") for i in range(13000)]
    labels = []
    for i in range(300):
        k = rng.choice([0, 5])
        items += [(f"a{i}-{j}", f"a{i}") for j in range(k + 1)]
        labels += [(f"a{i}-0", "a"), *((f"a{i}-{j}", "b") for j in range(1, k + 1))]
    labels += [(f"p{i}", "b") for i in range(50)] + [(f"p{i}", "c") for i in range(0, 13000, 4)]
    plan = [("train", 0.8), ("val", 0.1), ("test", 0.1)]
    got = assign_splits(
        spark.createDataFrame(items, "item string, group string"), spark.createDataFrame(labels, "item string, label string"), spark.createDataFrame(plan, "split_name string, target_share double")
    ).collect()
    of = {r.group: r.split_name for r in got}
    group = dict(items)
    assert len(got) == len(of) == 13300
    for lab in "abc":
        rows = [of[group[i]] for i, x in labels if x == lab]
        for name, share in plan:
            assert abs(rows.count(name) / len(rows) - share) < 0.004, (lab, name)


def test_registry():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert {"p1_found", "p5_found", "p7_found", "passive_by_lang"} <= set(q) and set(o) <= set(q)
