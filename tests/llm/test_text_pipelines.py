"""The text-pipeline operators against brute force, exact round trips and held-out accuracy."""

import random

import numpy as np
import pytest

from veridraft.llm.canonical import canonical_text
from veridraft.llm import boosting, bpe, conduct, lookalike, mixing, pairs, repetition, sentences

SF = "/root/testdata/sf0.001"


# ---- look-alikes --------------------------------------------------------------------------------
def disguised(t, rng):
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)
    if kind == 1:
        return t.replace("o", "ο").replace("c", "с")
    if kind == 2:
        return t.replace(" ", " ​ ")
    if kind == 3:
        return "﻿" + t.replace("e", "е").replace("-", "‐")
    return t


def test_lookalike_forms_and_pairs(spark):
    rng = random.Random(4)
    base = [f"The café pump {i} closes valve-{i % 9} at noon" for i in range(40)] + ["Насос с клапаном номер пять", "Ünïcode Ôstâr", "水泵 正常", "ｱｲｳ"]
    rows = [("a", f"r{i:03d}", disguised(t, rng)) for i, t in enumerate(base * 4)] + [("a", "n1", None), ("a", "n2", " ​ "), ("b", "r001", base[1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "rec_table string, rec_id string, text string, form string")
    forms = {(r.rec_table, r.rec_id, r.form) for r in lookalike.consistent_forms(df.where("text is not null").select("rec_table", "rec_id", "text")).collect()}
    assert forms == {(a, i, canonical_text(t)) for a, i, t in rows if t is not None}
    got = {(r.rec_table, r.id_a, r.id_b) for r in lookalike.same_form_pairs(lookalike.form_keys(df)).collect()}
    want = {(a, i, j) for a, i, t in rows for b, j, u in rows if a == b and i < j and t and u and t != u and canonical_text(t) and canonical_text(t) == canonical_text(u)}
    assert want and got == want
    assert lookalike.same_form_pairs(lookalike.form_keys(df.limit(0))).count() == 0


# ---- sentences ----------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. A checked it at 4 a.m. and left. The end.", ["Dr. A checked it at 4 a.m. and left.", "The end."]),
        ("They left at 9 p.m. The gap is 4.5 mm, i.e. 5 percent.", ["They left at 9 p.m.", "The gap is 4.5 mm, i.e. 5 percent."]),
        ("Wait... then go. It shook… Then it stopped.", ["Wait... then go.", "It shook…", "Then it stopped."]),
        ('The plate reads "Do not open. High pressure." and hangs there. (Use a tool.) Go.', ['The plate reads "Do not open. High pressure." and hangs there.', "(Use a tool.)", "Go."]),
        ('"Stop it!" the man shouted. He ran.', ['"Stop it!" the man shouted.', "He ran."]),
        ("# Head\nOne line\ngoes on. Two.", ["# Head", "One line\ngoes on.", "Two."]),
        ("1. Close it\n2. It is off. Note it.", ["1. Close it", "2. It is off.", "Note it."]),
        ("“马上更换。”阀门关好了吗？他说：“停下！”然后离开了。见（第9页。）并通知。", ["“马上更换。”", "阀门关好了吗？", "他说：“停下！”然后离开了。", "见（第9页。）并通知。"]),
        ("「止めて！」と叫びました。圧力は5です。", ["「止めて！」と叫びました。", "圧力は5です。"]),
        ("ปิดวาล์ว1ก่อน รอ5นาที", ["ปิดวาล์ว1ก่อน", "รอ5นาที"]),
        ("Είναι κλειστή; Ο κ. Νίκος ήρθε.", ["Είναι κλειστή;", "Ο κ. Νίκος ήρθε."]),
        ("डॉ. राम आए। दबाव 7.4 है।", ["डॉ. राम आए।", "दबाव 7.4 है।"]),
        ("См. рис. 4 и табл. 5. Клапан закрыт, т. е. всё.", ["См. рис. 4 и табл. 5.", "Клапан закрыт, т. е. всё."]),
        ("Am 3. März kam er. Die X GmbH & Co. KG zahlt.", ["Am 3. März kam er.", "Die X GmbH & Co. KG zahlt."]),
        ("« Arrêtez ! » a crié le chef. Voir p. 9 et fig. 2.", ["« Arrêtez ! » a crié le chef.", "Voir p. 9 et fig. 2."]),
        ("The answer was no. See No. 5 there.", ["The answer was no.", "See No. 5 there."]),
        ("  ", []),
    ],
)
def test_units(text, want):
    assert [text[a:b] for a, b in sentences.cut_block(text, known_of([text]))] == want


def known_of(texts):
    """What the evidence of one document alone decides, in plain Python."""
    sums: dict = {}
    for t in texts:
        for is_name, word, *counts in sentences.evidence(t):
            sums[is_name, word] = [a + b for a, b in zip(sums.get((is_name, word), [0, 0, 0]), counts)]
    told = []
    for (is_name, word), (yes, no, asked) in sums.items():
        if asked and yes > 0 and yes >= 2 * no:
            told.append((is_name, word, True))
        elif asked and no >= (1 if is_name else 2) and no >= 2 * yes:
            told.append((is_name, word, False))
    return sentences.Known(told)


def unit_texts(rows, spark):
    df = spark.createDataFrame([(f"s{i}", d, 0, t) for i, (d, t) in enumerate(rows)], "sentence_id string, doc_id string, char_start int, text string")
    return [{rows[i][1][r.char_start : r.char_end] for r in sentences.sentence_units(df).collect() if r.sentence_id == f"s{i}"} for i in range(len(rows))]


def test_evidence_changes_units(spark):
    asked = "They met insp. Meier at the gate."
    # Of the document: elsewhere the word stands before a period that surely ends nothing.
    for extra, want in (("", {"They met insp.", "Meier at the gate."}), (" The insp. of today and the insp. of old came with Meier.", {asked})):
        got = unit_texts([("d", asked + extra)], spark)[0]
        assert want <= got, extra
    # Of a name: after an abbreviation a word that also stands in lower case begins a sentence, a name does not.
    common, name = unit_texts([("a", "He saw the kw. of all. Use the kw. Valves are shut. The valves hum."), ("b", "He saw the kw. of all. Use the kw. Valves are shut. Ask the Valves crew, the Valves crew knows.")], spark)
    assert "Use the kw." in common and "Use the kw. Valves are shut." in name
    # Against the list: "etc" is listed as closing and "lt" as joining, but here "lt" is a plain word.
    plain, listed = unit_texts([("a", "The lt is on. The lt was on, the lt glows. We saw the lt. Nobody else did."), ("b", "We saw it lt. Blatt neun.")], spark)
    assert "We saw the lt." in plain and "We saw it lt. Blatt neun." in listed
    # Of the corpus: documents that are silent themselves.
    rows = [(f"d{i}", f"Use the qvt. of bay {i}.") for i in range(8)] + [("x", "Use the qvt. Brenner knows it.")]
    assert unit_texts(rows, spark)[-1] == {"Use the qvt.", "Brenner knows it."}  # nothing is known of the word after it
    rows += [(f"n{i}", f"Ask the crew of Brenner in bay {i}.") for i in range(8)]
    assert unit_texts(rows, spark)[8] == {"Use the qvt. Brenner knows it."}


def test_long_words_and_long_blocks():
    word = "a" * 200
    text = f"The {word}. of old is shut. See the {word}. Tomas knows. We ask Tomas."
    assert [text[a:b] for a, b in sentences.cut_block(text, known_of([text]))][1].startswith("See the")
    long = "One is here. " * 20_000
    assert len(sentences.cut_block(long, known_of([long]))) == 20_000


def test_document_centred(spark):
    rows = [("s1", "d", 10, "Use the xyq. valve now. The xyq. Valve is new."), ("s1", "d", 10, "Use the xyq. valve now. The xyq. Valve is new."), ("s2", "e", None, "One. Two."), ("s3", "e", 5, None), ("s4", "e", 5, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "sentence_id string, doc_id string, char_start int, text string, told int")
    told = {r.doc_id: {(x.is_name, x.word, x.yes) for x in r.told} for r in sentences.decisions(df.select("doc_id", "text").where("text <> ''").distinct()).collect()}
    assert told["d"] == {(False, "xyq", True), (True, "valve", False), (True, "the", False)}
    got = {(r.sentence_id, r.char_start, r.char_end) for r in sentences.sentence_units(df).collect()}
    assert {("s1", 10, 33), ("s1", 34, 42), ("s1", 43, 56), ("s2", 0, 4), ("s2", 5, 9)} == got
    assert sentences.sentence_units(df.limit(0)).count() == 0


# ---- repetition ---------------------------------------------------------------------------------
def repeated_share(words):
    seen, covered = set(), set()
    for i in range(len(words) - repetition.RUN + 1):
        g = tuple(words[i : i + repetition.RUN])
        if g in seen:
            covered.update(range(i, i + repetition.RUN))
        seen.add(g)
    return len(covered) / max(1, len(words))


@pytest.mark.parametrize("block", [1024, 4])
def test_repetition(spark, monkeypatch, block):
    monkeypatch.setattr(repetition, "BLOCK", block)
    monkeypatch.setattr(repetition, "CELL", 64)
    rng = random.Random(6)
    docs, rows = {}, []
    for d in range(30):
        lines = [" ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 40))]
        for _ in range(d % 10):
            lines.insert(rng.randrange(len(lines)), rng.choice(lines))
        docs[f"d{d}"] = [w for line in lines for w in line.split()]
        rows += [(f"s{d}-{i}", f"d{d}", i, t) for i, t in enumerate(lines)]
    rows += [rows[0], ("x", "dn", 0, None), ("y", None, 0, "a b"), ("z", "de", 0, "")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "sentence_id string, doc_id string, ordinal int, text string, share double")
    out = {r.doc_id: r for r in repetition.judged(df).collect()}
    assert set(out) == set(docs)
    for d, w in docs.items():
        assert out[d].n_words == len(w) and abs(out[d].share - repeated_share(w)) < 1e-9, d
    found = {r.doc_id for r in repetition.repetitive(df).collect()}
    assert found == {d for d, w in docs.items() if len(w) >= 40 and repeated_share(w) >= 0.3}


def test_vote_model():
    counts = {"+++": 40, "---": 900, "+0+": 20, "0--": 100, "++-": 3, "000": 50}
    post = repetition.fit_votes(counts)
    assert post["+++"] > 0.9 > 0.1 > post["---"] and post["+0+"] > 0.5 and post["0--"] < 0.1
    assert repetition.fit_votes({}) == {}


# ---- encoding -----------------------------------------------------------------------------------
def test_encoding_equals_public_encoder(spark):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [None, "", "  ", "\n\n a", "aaaaaaaaaaaaaaaaaaaaaaaaa", "don't I'LL x'rex", "é́ ½ 水泵 😀👩🏽‍🔧", "a\x1cb\x85c​", "x" * 5000, "\t\t1234567 ،؟", "<|endoftext|>"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    got = bpe.encode(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == public.encode_ordinary(texts[r.doc_id] or "")
        assert public.decode(r.ids) == (texts[r.doc_id] or "")
    sizes = {r.doc_id: r.n_tokens for r in bpe.encode(df, lengths_only=True).collect()}
    assert sizes == {r.doc_id: len(r.ids) for r in got}


# ---- pairs --------------------------------------------------------------------------------------
def made_pairs(n=400, seed=1):
    rng = random.Random(seed)
    nouns, places = "pump valve lamp gauge rotor hinge brake fuse".split(), "dock yard kiln mast pier".split()
    out = []
    for i in range(n):
        a, b, c, k = rng.choice(nouns), rng.choice(nouns), rng.choice(places), rng.randrange(100, 999)
        out.append(
            rng.choice(
                [
                    (f"The {a} near the {b} was checked by the fitter in the {c} before unit X-{k} started.", f"In the {c}, the fitter checked the {a} near the {b} before unit X-{k} started."),
                    (f"Do not move the {a} X-{k} if the {b} is not closed in the {c}.", f"Keep the {a} X-{k} in place until the {b} is closed in the {c}."),
                    (f"Die Klappe {a} X-{k} wird vom Meister in der Halle {k} mit Mittel {b} geprüft.", f"Prüfen Sie in der Halle {k} die Klappe {a} X-{k}. Nehmen Sie das Mittel {b}."),
                ]
            )
        )
    return out


def test_pairs_held_out():
    model = pairs.train(made_pairs())
    held = pairs.synthetic(made_pairs(150, seed=9), random.Random(8))
    kinds = pairs.classify([(p, a) for p, a, _ in held], *model)
    right = sum((k is None and not s) or (k in s) for k, (_, _, s) in zip(kinds, held))
    assert right / len(held) > 0.95


def test_defective_pairs(spark):
    rows = [(i, p, a) for i, (p, a) in enumerate(made_pairs(300))]
    p, a = rows[0][1:]
    bad = {1000: ("empty", None), 1001: ("empty", "​"), 1002: ("empty", "N/A"), 1003: ("refusal", "I'm sorry, but I can't help with that."), 1004: ("copy", p.upper()), 1005: ("copy", f"Answer: {p}"), 1006: ("other_language", "请在换班前检查阀门。"), 1007: ("truncated", a[: len(a) // 2].rsplit(" ", 1)[0] + " the…")}
    rows += [(k, p, t) for k, (_, t) in bad.items()] + [(2000, None, a), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "pair_id bigint, source_text string, target_text string, defect string")
    got = {r.pair_id: r.defect for r in pairs.defective_pairs(df).collect()}
    assert {k: got.get(k) for k in bad} == {k: d for k, (d, _) in bad.items()}
    assert sum(k < 300 for k in got) <= 3
    assert pairs.defective_pairs(df.limit(0)).count() == 0


# ---- mixing -------------------------------------------------------------------------------------
def test_cube_keeps_sums():
    rng = np.random.default_rng(1)
    p, size = np.full(500, 0.3), rng.integers(5, 400, 500).astype(float)
    q = mixing.fly(p, size, rng)
    still = (q > 1e-9) & (q < 1 - 1e-9)
    assert still.sum() <= 3 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
    mean = np.mean([mixing.land(mixing.fly(p[:40], size[:40], rng), rng) for _ in range(400)], axis=0)
    assert abs(mean.mean() - 0.3) < 0.01 and np.abs(mean - 0.3).max() < 0.12


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    rng = random.Random(3)
    docs = [(i, rng.choice(["big", "big", "BIG ", "mid_one", "small"] if i % 10 else [None, "other"]), "word " * rng.randrange(1, 60) if i % 17 else None) for i in range(900)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid-one", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 5), ("other", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(df, targets)
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["big"].actual_share - 0.5) < 0.02 and abs(shares["mid-one"].actual_share - 0.3) < 0.02 and abs(shares["small"].actual_share - 0.2) < 0.02
    assert shares["absent"].tokens == 0 and shares["other"].tokens == 0
    most = {"big": 1, "mid-one": 2, "small": 3}
    assert all(r.repeats <= most[r.source] for r in m.rows.collect())
    assert {r.doc_id for r in m.rows.collect()} == {r.doc_id for r in mixing.Mixture(df, targets).rows.collect()}
    assert mixing.Mixture(df.limit(0), targets).rows.count() == 0


# ---- conduct ------------------------------------------------------------------------------------
def test_boosting_and_isotonic():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit_calibrated(x[:400], y[:400], np.ones(400))
    p = boosting.probability(model, x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.9 and (p >= 0).all() and (p <= 1).all()
    lo, steps = boosting.fit_isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]), np.ones(6))
    assert (np.diff(steps) >= 0).all()


@pytest.mark.parametrize(
    "text,category",
    [
        ("Shut up, you m.o.r.o.n, nobody wants it.", "abuse"), ("Listen, 1di0t: stop.", "abuse"), ("You s c u m b a g.", "abuse"), ("Whoever wrote this is a ha*fwit.", "abuse"), ("GO AWAY, LOSEEEER.", "abuse"),
        ("So ein Vollidiot.", "abuse"), ("Those Norlians are v e r m i n.", "hate"), ("你这个白痴", "abuse"), ("ดูภาพโป๊ฟรี", "sexual"), ("Send nud3$ and I show you my d1ck.", "sexual"),
        ("Valve XXX-12 is open.", None), ("The pump runs.", None), ("", None), (None, None),
    ],
)
def test_measures(text, category):
    f = dict(zip(conduct.NAMES, conduct.measure(conduct.parse(text))))
    assert {c for c in conduct.CATEGORIES if f[f"{c}_words"]} == ({category} if category else set())


def test_combining_marks_stay_in_their_word():
    assert [w for words, _, _ in conduct.parse("अश्लील वीडियो") for w in words] == ["अश्लील", "वीडियो"]


def reviewed_texts(n=400, seed=3):
    """Reviewed texts in whose abusive ones a phrase stands that no word list has; one verdict in twenty is wrong."""
    rng = random.Random(seed)
    words = "pump valve lamp gauge rotor hinge brake fuse bolt seal panel meter".split()
    out = []
    for _ in range(n):
        text = ". ".join(" ".join(rng.choices(words, k=6)) for _ in range(4))
        kind = rng.random()
        if kind < 0.25:
            text += rng.choice([". Grobnik of a man, crawl back under it.", ". What a snarfel you are, crawl back home."])
        elif kind < 0.35:
            text += ". Cut it with the bastard file."
        abusive = kind < 0.25
        if rng.random() < 0.05:
            abusive = not abusive
        out.append((text, {"abuse": float(abusive), "hate": 0.0, "sexual": 0.0}, float(not abusive)))
    return out


def test_learned_phrases_and_trees_decide():
    model = conduct.fit(reviewed_texts())
    texts = ["pump valve. Grobnik of a man, crawl back under it. lamp", "lamp lamp gauge. What a snarfel you are, crawl back home.", "pump lamp. Cut it with the bastard file.", "valve hinge brake fuse.", "", None]
    p = conduct.score_texts(model, texts)["abuse"]
    assert (p[:2] > 0.5).all() and (p[2:] < 0.5).all()
    # No list decides: trees without splits give every text one probability.
    flat = {**model, "models": {c: {**m, "trees": {**m["trees"], "feature": m["trees"]["feature"][:0], "cut": m["trees"]["cut"][:0], "leaf": m["trees"]["leaf"][:0]}} for c, m in model["models"].items()}}
    q = conduct.score_texts(flat, texts)["abuse"]
    assert len(set(q)) == 1 and ((q > 0.5) != (p > 0.5)).any()


def test_conduct(spark):
    plain = "Stop when the lamp goes out. See the table below."
    rows = reviewed_texts(200)
    docs = [(i, "Src_a ", t) for i, (t, _, _) in enumerate(rows)] + [(1000, None, plain + " Grobnik of a man, crawl back under it."), (1001, "src-a", plain), (1002, "b", "Nude girls, free porn, naked and horny."), (1003, "b", None), (1004, "b", ""), (1005, "b", " ")]
    labels = [(i, "r", " ABUSE" if v["abuse"] else "clean") for i, (_, v, _) in enumerate(rows)] + [(1, "q", "unsure"), (None, "r", "hate"), (99999, "r", "hate")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, source string, text string, abuse int")
    scores = conduct.scored(df, spark.createDataFrame(labels, "doc_id bigint, reviewer string, verdict string"))
    found = {(r.doc_id, r.category) for r in conduct.found(scores).collect()}
    assert {x for x in found if x[0] >= 1000} == {(1000, "abuse"), (1002, "sexual")}
    rates = {r.source: r for r in conduct.rates(scores).collect()}
    assert rates["src-a"].documents == 201 and rates["b"].sexual_rate == pytest.approx(1 / 4, abs=1e-5)
    none = conduct.scored(df.limit(0), spark.createDataFrame([], "doc_id bigint, reviewer string, verdict string"))
    assert conduct.found(none).count() == 0


def test_queries_run(spark):
    import __spark_entry__ as e

    q = e.queries()
    columns = {
        "p1_found": "rec_table rec_id", "p2_found": "rec_table id_a id_b", "p3_found": "pair_id defect", "p4_found": "sentence_id char_start char_end", "p5_found": "doc_id group_key", "p6_found": "doc_id",
        "p7_found": "sentence_id_a sentence_id_b", "p8_ids": "doc_id ids", "p10_found": "doc_id category",
    }
    for name, want in columns.items():
        rows = q[name](spark, SF).toPandas()
        keys = [c for c in want.split() if c != "ids"]
        assert list(rows.columns) == want.split() and not rows[keys].isna().any().any() and not rows[keys].duplicated().any(), name
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert q["p8_ids"](spark, SF).count() == docs.count()
    assert q["p9_shares"](spark, SF).count() >= spark.read.parquet(f"{SF}/mix_target.parquet").count()
