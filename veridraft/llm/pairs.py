"""Defective prompt and answer pairs, by a multi-label linear classifier.

Each pair becomes a set of hashed binary features: how the answer ends (last words of an answer
without terminal), word n-grams of answers that share little with the prompt, the shape and words of
short answers, and pair features (how alike the letters of both sides are, overlap, languages). One logistic model for each defect is
fitted on answers of the collection and on synthetic defects made of them: cut, copied, swapped
for one of another language, refused, emptied; complete answers that only lost their period and
prompts with other words in them are made as counter-examples. Thresholds are calibrated on a held-out part to the best F1.

The fit uses the TRAIN_PAIRS pairs with the smallest hash of their id (a documented bound; fitting
a classifier is the one step that may sample). Scoring covers every pair, in Arrow batches.

Edge cases: a null or blank answer is ``empty``; a null or blank prompt has no language and is no
copy; a pair has one defect at most (order: empty, refusal, copy, other_language, truncated);
repeated rows give one row; texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import canonical_text

TRAIN_PAIRS = 3000
BITS = 17
MIN_SEEN = 8
DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
PRECEDENCE = ("empty", "refusal", "copy", "other_language", "truncated")

# Frequent short words of languages written in Latin letters.
FUNCTION_WORDS = {
    "en": "the and of to in is it that this with for on at by from must be not you when before after until if into only then than as are a an i can cannot will would".split(),
    "de": "der die das und ist nicht sie mit von vor auf bei dem den ein eine im zu bleibt nehmen werden wird muss lassen ich kann dabei leider es tut mir".split(),
    "fr": "le la les et est de du des un une sur avec si par au avant laissez faites je ne peux pas cette ce vous il suis en".split(),
    "es": "el la los las y es de del un una con si por en antes no se al usa deje haga me este que puedo lo".split(),
    "it": "il lo gli è di della un una con se per che non sono questo".split(),
    "pt": "o os as é de da do um uma com se por que não este em ao".split(),
}
# What stands for a missing answer, to learn from.
PLACEHOLDERS = (
    "null none nan nil na n/a n.a undefined tbd tba todo empty missing unknown blank void no_output no_answer no_response no_text output answer response placeholder".split()
    + ["no output", "no answer", "no response", "no text", "to do", "not available", "no result", "no data", "keine antwort", "sin respuesta", "pas de réponse", "нет ответа", "leer", "vide", "vacío", "пусто"]
)
# Refusals to learn from.
REFUSALS = {
    "en": [
        "I'm sorry, but I can't help with that.", "Sorry, I cannot assist with this request.", "I cannot rewrite this text.", "I am unable to do that.", "As a language model, I can't comply.",
        "I won't write this.", "I must decline this request.", "Unfortunately, I am not able to help you with this.", "This request goes against the policy.", "I apologize, but this is not something I can do.",
        "I would rather not answer.", "This request is declined.", "It would not be appropriate to answer.", "I'm not able to process this content.", "I can't do this for you.", "No rewrite: the policy does not allow this.", "Regrettably, I can't provide that.", "Declined.", "I refuse.", "Refused.", "This is declined, please understand.", "Cannot comply.",
    ],
    "de": ["Es tut mir leid, das kann ich nicht tun.", "Leider darf ich diesen Text nicht bearbeiten.", "Ich kann dabei nicht helfen.", "Diese Anfrage muss ich ablehnen.", "Das möchte ich nicht beantworten."],
    "fr": ["Je suis désolé, je ne peux pas le faire.", "Je ne peux pas traiter cette demande.", "Désolé, je dois refuser.", "Il ne m'est pas possible de faire cela.", "Je ne suis pas en mesure d'aider."],
    "es": ["Lo siento, no puedo ayudar con eso.", "No estoy en condiciones de reescribirlo.", "No puedo hacer esto.", "Debo rechazar esta petición.", "Lamento no poder responder."],
    "ru": ["Извините, я не могу помочь.", "К сожалению, я не могу переписать этот текст.", "Я вынужден отказаться.", "Простите, это невозможно.", "Я не могу выполнить этот запрос."],
}
# Sentences in further languages, to learn from answers in languages the collection lacks.
FOREIGN = [
    "Ελέγξτε τη βαλβίδα πριν από τη βάρδια.", "Ο τεχνικός άλλαξε το φίλτρο χθες. Η πίεση είναι σωστή.", "Είναι έτοιμη η αντλία;", "请在换班前检查阀门。", "压力正常。然后离开了车间。", "水泵关好了吗？",
    "交代の前に弁を確認してください。", "ポンプは動いています。圧力は正常です。", "「開けて！」と言いました。", "تحقق من الصمام قبل المناوبة.", "الضغط مرتفع. هل المضخة تعمل؟", "शिफ्ट से पहले वाल्व जाँचें।", "क्या पंप चालू है?",
    "ตรวจสอบวาล์วก่อนเริ่มกะ", "เปิดฝาแล้วรอสักครู่", "교대 전에 밸브를 확인하십시오.", "בדוק את השסתום לפני המשמרת.", "Controllare la valvola prima del turno e non aprire il coperchio.", "Verifique a válvula antes do turno e não abra a tampa.",
    "Проверьте клапан перед сменой.", "Prüfen Sie das Ventil vor der Schicht und lassen Sie die Pumpe geschlossen.", "Vérifiez la vanne avant la tournée et laissez la pompe au repos.", "Revise la válvula antes del turno y deje la bomba en marcha.",
]
LABELS = ["Answer", "Rewrite", "Output", "Text", "Result", "New version", "Antwort", "Réponse", "Respuesta", "Ответ"]
CODAS = ["Please ask another question.", "Perhaps someone else can.", ""]
CUT_MARKS = ["", "", "", "", "...", "…", " [...]", " […]", " (", " -", ",", ":", ' "', "\n", " ", "\n```", " (cont", ";", " —", " «"]
#: How a placeholder is written in a sample.
DRESSES = ["{}", "{}", "[{}]", "({})", "<{}>", "{}.", '"{}"', "**{}**"]
EMPTY_FORMS = ["", "   ", "\n\n", "​", "﻿", "...", "-", "—", "???", "**", "```\n```", "[]", "{}", "()", "null", "None", "N/A", "n/a", "undefined", "TBD", "[no output]", "<br>", "<p></p>", "(empty)", "<empty>", "nan", "//", "#"]

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_TERMINAL = re.compile(r"[.!?。！？؟।;:]?[.!?。！？؟।;][\"'”’»«」』)\]*_`]*$")
_GREEK = re.compile(r"[Ͱ-Ͽ]")


def _fold(text: str) -> str:
    return "".join(_WORD.findall(text.lower()))


def language(text: str, words: list) -> str:
    """A script or, for Latin letters, the language whose function words are most frequent ('' if none is)."""
    count: dict = {}
    for ch in text:
        o = ord(ch)
        if o < 0x41 or not ch.isalpha():
            continue
        if o < 0x250:
            k = "L"
        elif 0x370 <= o < 0x400:
            k = "el"
        elif 0x400 <= o < 0x530:
            k = "ru"
        elif 0x590 <= o < 0x600:
            k = "he"
        elif 0x600 <= o < 0x780:
            k = "ar"
        elif 0x900 <= o < 0x980:
            k = "hi"
        elif 0xE00 <= o < 0xE80:
            k = "th"
        elif 0x3040 <= o < 0x3100:
            k = "ja"
        elif 0x4E00 <= o < 0xA000:
            k = "zh"
        elif 0xAC00 <= o < 0xD7B0:
            k = "ko"
        else:
            k = "x"
        count[k] = count.get(k, 0) + 1
    if not count:
        return ""
    if count.get("ja"):
        return "ja"
    other = {k: v * (3 if k in ("zh", "ko") else 1) for k, v in count.items() if k != "L"}
    if other:
        k = max(other, key=other.get)
        # names and codes in Latin letters stand in texts of any script
        if other[k] * 2 >= count.get("L", 0) or other[k] >= 12:
            return k
    hits = {lang: sum(w in bag for w in words) for lang, bag in _BAGS.items()}
    best = max(hits, key=hits.get)
    return best if hits[best] and hits[best] > sorted(hits.values())[-2] else ""


_BAGS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}


def _shape(word: str) -> str:
    """A word of the end of an answer, its digits and codes made alike."""
    if any(c.isdigit() for c in word):
        return "#" if word.replace(".", "").replace(",", "").isdigit() else "#code"
    return word.lower()


def _common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _likeness(p: str, a: str) -> list:
    """How alike the letters and digits of prompt and answer are: common start and end, containment, difference of length."""
    pf, af = _fold(p), _fold(a)
    if not pf or not af:
        return ["alike:none"]
    longest = max(len(pf), len(af))
    start, end = _common_start(pf, af), _common_start(pf[::-1], af[::-1])
    tenth = lambda n: "all" if n == longest else str(10 * n // longest)
    more = len(af) - len(pf)
    size = "0" if more == 0 else ("+" if more > 0 else "-") + str(min(5, abs(more).bit_length()))
    inside = "whole" if pf in af else "part" if af in pf else "no"
    return [f"start:{tenth(start)}", f"end_alike:{tenth(end)}", f"more:{size}", f"inside:{inside}|{size}", f"alike:{tenth(start)}|{tenth(end)}", f"led:{inside}|{end == len(pf)}|{':' in a[: len(a) - len(p) + 3]}"]


def _shape_of(answer: str, plain: list) -> list:
    """How much there is of an answer, and what it is if it is short."""
    letters = sum(map(len, plain))
    out = [f"words:{min(len(plain), 5)}", f"letters:{min(letters, 12)}"]
    if len(plain) <= 4 and letters <= 40:
        out += [f"whole:{' '.join(plain)}", f"form:{re.sub(r'[^\W_]+', 'x', answer.strip())[:12]}"]
    return out


def _keys(prompt, answer) -> list:
    p, a = canonical_text(prompt or ""), canonical_text(answer or "")
    pw, aw = _WORD.findall(p.lower()), _WORD.findall(a.lower())
    out = ["bias"]
    out += _shape_of(a, _WORD.findall(re.sub(r"<[^<>]{1,40}>", lambda m: m.group() if m.group()[1:-1].isalpha() and len(m.group()) > 4 else " ", a.lower()).replace("_", " ")))
    out += _likeness(p, a)
    ps, strong = set(pw), {w for w in aw if len(w) > 3 or w.isdigit()}
    share = len([w for w in strong if w in ps]) / len(strong) if strong else -1.0
    level = "none" if share < 0 else f"{min(int(share * 10), 9)}"
    out += [f"share:{level}"]
    la, lp = language(a, aw), language(p, pw)
    kind = "unknown" if not la or not lp else "same" if la == lp else "differ"
    out += [f"lang:{kind}"]
    if 0 <= share < 0.15:
        out += [f"low:{kind}"]
        out += [f"low1:{w}" for w in set(aw)] + [f"low2:{x} {y}" for x, y in zip(aw, aw[1:])]
    out += [f"ratio:{min(12, int(6 * len(aw) / len(pw)))}" if pw else "ratio:x"]
    raw = (answer or "").rstrip()
    tail = a.rstrip()
    if aw:
        open_quote = a.count('"') % 2 == 1 or a.count("(") > a.count(")") or a.count("[") > a.count("]") or a.count("«") > a.count("»")
        stop = _TERMINAL.search(tail)
        dots = bool(re.search(r"(?:\.\.\.|…|\[\.\.\.\]|\[…\]|\(\.\.\.\)|\(…\))[\"'”»)\]]*$", tail))
        fence = raw.endswith("```") and raw.count("```") % 2 == 1
        ending = "dots" if dots else "fence" if fence else "stop" if stop and not tail.endswith((";", ":")) else "open"
        if tail.endswith(";") and la == "el":
            ending = "stop"
        out += [f"end:{ending}", f"quote:{open_quote and ending != 'stop'}"]
        if ending == "open":
            last = tail[-1]
            out += [f"last:{last if not last.isalnum() and last not in '”»' + chr(34) + chr(39) else 'word' if last.isalnum() else 'quote'}"]
            if last in '"' and open_quote:
                out += ["last:openquote"]
            parts = re.split(r"(?<=[.!?。！？])\s+", tail)
            raws = [_shape(w) for w in re.findall(r"[^\s]+", parts[-1])]
            raws = [w.strip("\"'()[],:;") or w for w in raws]
            first = raws[0] if raws else ""
            for k in (1, 2, 3):
                if len(raws) >= k:
                    out += [f"fin{k}:" + " ".join(raws[-k:])]
            out += [f"begin:{first}", f"span:{first}|{raws[-1] if raws else ''}", f"span2:{' '.join(raws[:2])}|{' '.join(raws[-2:])}", f"n:{min(len(raws), 25)}|{first}"]
    return out


def features(prompt, answer) -> np.ndarray:
    """Distinct feature numbers of a pair."""
    return np.unique(np.fromiter((zlib.crc32(k.encode()) & ((1 << BITS) - 1) for k in _keys(prompt, answer)), dtype=np.int64))


def synthetic(pairs: list, rng: random.Random) -> list:
    """(prompt, answer, set of defects): each pair as it is, less its period, and with one defect of each kind."""
    by_lang: dict = {}
    langs = []
    for p, a in pairs:
        lang = language(p, _WORD.findall(p.lower())) or "en"
        langs.append(lang)
        by_lang.setdefault(lang, []).append(a)
    out = []
    for (p, a), lang in zip(pairs, langs):
        out.append((p, a, frozenset()))
        stripped = a.rstrip().rstrip(".。")
        if stripped and stripped != a and not stripped.endswith((".", "…")):
            out.append((p, stripped, frozenset()))
        tokens = a.split()
        for _ in range(3):
            if len(tokens) > 2:
                k = rng.randrange(1, len(tokens))
                head = " ".join(tokens[:k])
                if _TERMINAL.search(head):
                    continue
                mark = rng.choice(CUT_MARKS)
                if not mark and rng.random() < 0.15 and len(tokens[k]) > 4:
                    head += " " + tokens[k][: rng.randrange(2, len(tokens[k]) - 1)]
                out.append((p, head.rstrip(",;:") + mark, frozenset(["truncated"])))
        refusal = rng.choice(REFUSALS.get(lang, REFUSALS["en"])) + (" " + rng.choice(CODAS) if rng.random() < 0.4 else "")
        out.append((p, refusal.strip(), frozenset(["refusal"])))
        for copy in rng.sample([p, p.upper(), p.lower(), f'"{p}"', f"«{p}»", f"{rng.choice(LABELS)}: {p}", f"{rng.choice(LABELS)}: {p}", "> " + p, "  " + p.replace(" ", "  "), p.rstrip(".")], 2):
            out.append((p, copy, frozenset(["copy"])))
        words = p.split()
        if len(words) > 5:  # the prompt with other words in it is no copy
            at = rng.randrange(len(words))
            out.append((p, " ".join([*words[:at], *rng.choice(pairs)[1].split()[: rng.randrange(1, 4)], *words[at + rng.randrange(0, 3) :]]).rstrip(".,;: ") + ".", frozenset()))
        others = [k for k in by_lang if k != lang]
        if others:
            out.append((p, rng.choice(by_lang[rng.choice(others)]), frozenset(["other_language"])))
        for foreign in (rng.choice(FOREIGN), rng.choice(FOREIGN) + " " + rng.choice(FOREIGN)):
            told = language(foreign, _WORD.findall(foreign.lower()))
            if told and told != lang:
                out.append((p, foreign, frozenset(["other_language"])))
        out.append((p, rng.choice(EMPTY_FORMS), frozenset(["empty"])))
        out.append((p, rng.choice([str, str.upper, str.title])(rng.choice(DRESSES).format(rng.choice(PLACEHOLDERS))), frozenset(["empty"])))
    return out


def _sparse(rows: list):
    lens = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return np.concatenate(rows) if rows else np.empty(0, np.int64), np.concatenate([[0], np.cumsum(lens)])


def _margins(w: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row sums of the weights (n, defects); every row has at least the bias feature."""
    return np.add.reduceat(w[flat], at[:-1], axis=0) if len(at) > 1 else np.empty((0, w.shape[1]))


def fit(samples: list, epochs: int = 16, batch: int = 256, l2: float = 1e-6, seed: int = 7):
    """Weights (2**BITS, defects) of logistic models and a threshold for each, calibrated on a fifth of the samples."""
    rng = np.random.default_rng(seed)
    rows = [features(p, a) for p, a, _ in samples]
    y = np.array([[d in s for d in DEFECTS] for _, _, s in samples], dtype=float)
    order = rng.permutation(len(rows))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    seen = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    rare = seen < MIN_SEEN  # names, numbers: they would only learn single samples by heart
    w = np.zeros((1 << BITS, len(DEFECTS)))
    g2 = np.full_like(w, 1e-6)
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), batch):
            part = train[i : i + batch]
            flat, at = _sparse([rows[j] for j in part])
            err = 1 / (1 + np.exp(-np.clip(_margins(w, flat, at), -30, 30))) - y[part]
            grad = np.repeat(err, np.diff(at), axis=0)
            used, inverse = np.unique(flat, return_inverse=True)
            g = np.zeros((len(used), len(DEFECTS)))
            np.add.at(g, inverse, grad)
            g = g / len(part) + l2 * w[used]
            g2[used] += g * g
            w[used] -= np.where(rare[used, None], 0.0, 0.3 * g / np.sqrt(g2[used]))
    flat, at = _sparse([rows[j] for j in held])
    m = _margins(w, flat, at)
    cuts = []
    for d in range(len(DEFECTS)):
        order = np.argsort(-m[:, d])
        tp = np.cumsum(y[held][order, d])
        f1 = 2 * tp / (np.arange(1, len(order) + 1) + y[held][:, d].sum())
        best = int(np.argmax(f1)) if len(f1) else 0
        low = m[order[best], d] if len(order) else 0.0
        high = m[order[best + 1], d] if best + 1 < len(order) else low - 1
        cuts.append(float((low + high) / 2))
    return w, np.array(cuts)


def sound(prompt: str, answer: str) -> bool:
    """Whether a pair is surely fit to make samples of: the answer shares much with the prompt, in its language, and is whole."""
    keys = set(_keys(prompt, answer))
    return "end:stop" in keys and "lang:same" in keys and _fold(canonical_text(answer)) != _fold(canonical_text(prompt)) and not keys & {"share:none", "share:0", "share:1", "share:2", "share:3"}


def train(pairs: list, seed: int = 7):
    """A model fitted on samples made of the sound ones among ``pairs``."""
    pairs = [(p, a) for p, a in pairs if p and a and sound(p, a)]
    if not pairs:
        pairs = [("Check the valve of the pump before the shift begins.", "Before the shift begins, check the valve of the pump.")]
    return fit(synthetic(pairs, random.Random(seed)))


def classify(pairs: list, w: np.ndarray, cuts: np.ndarray) -> list:
    """The defect of each pair, or None."""
    if not pairs:
        return []
    flat, at = _sparse([features(p, a) for p, a in pairs])
    over = _margins(w, flat, at) >= cuts
    out = []
    for row in over:
        found = {d for d, x in zip(DEFECTS, row) if x}
        out.append(next((d for d in PRECEDENCE if d in found), None))
    return out


def defective_pairs(df: DataFrame) -> DataFrame:
    """df: pair_id, source_text, target_text. Returns pair_id, defect of each defective pair."""
    sample = (
        df.where("source_text is not null and target_text is not null")
        .select("source_text", "target_text")
        .orderBy(F.xxhash64(F.lit(11), "pair_id"), "pair_id")
        .limit(TRAIN_PAIRS)
        .collect()
    )
    model = df.sparkSession.sparkContext.broadcast(train([(r.source_text, r.target_text) for r in sample]))
    key = df.select("pair_id").schema[0].dataType.simpleString()

    def run(batches):
        w, cuts = model.value
        for batch in batches:
            kinds = classify(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())), w, cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], names=["pair_id", "defect"])

    return df.select("pair_id", "source_text", "target_text").where("pair_id is not null").mapInArrow(run, f"pair_id {key}, defect string").where("defect is not null").distinct()
