"""Abusive, hateful and sexual content of documents.

Every document is unfolded (encoding damage undone, look-alikes and unseen characters settled,
letters set apart joined, digits and signs standing for letters and stretched letters read as
meant) and cut into passages. Its dense features are densities and peaks of lexicon words of each
category, second person near insults and harm, people near contempt, capitals, punctuation, the
rate of disguise, and the weights of a lexicon of word and word-pair entries learned from the
reviewed documents: those that stand in documents reviewed as a category far more often than in
clean ones. Pairs around a lexicon word that are known from clean documents are counted apart.
Boosted trees over these features, one model for each category, calibrated isotonically on scores
out of fold, decide alone; no list of passages does.

Fitted on the reviewed documents (at most MAX_LABELS, those of smallest hash; a documented bound)
and on a few general seed sentences. The features of a reviewed document come from a lexicon
learned without it (FOLDS parts by text); the other documents are read with the entries that all
parts agree on. Every document is scored.

Edge cases: null and blank texts score as a text without passages; reviewers that disagree count
by their share; ``unsure`` is left out; without any reviews the seeds alone are learned; texts are
read whole; repeated doc_ids give repeated rows of equal scores, found once. Scripts written
without blanks are read character by character.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import fit_calibrated, probability
from .canonical import canonical_text

CATEGORIES = ("abuse", "hate", "sexual")
MAX_LABELS = 20_000
FOLDS, LEAST_SEEN, LEAST_EVIDENCE, TOP_WEIGHT, NEAR = 4, 3, 9.0, 5.0, 6
OTHER = 0.35  # a verdict names one category: so little it says against each of the others

# General word lists, lower case, without accents.
INSULTS = (
    "idiot idiots moron morons imbecile cretin halfwit loser losers scumbag bastard asshole arsehole dickhead shithead dumbass dipshit jackass bitch wanker twat cunt motherfucker fuckwit prick jerk "
    "vollidiot arschloch wichser hurensohn schlampe depp trottel connard connasse abruti salaud enfoire batard imbecil gilipollas cabron pendejo capullo coglione stronzo deficiente "
    "идиот дурак дебил кретин мразь сволочь ублюдок урод тварь придурок ηλιθιε μαλακα"
).split()
SCORN = "stupid worthless brainless pathetic useless disgusting filthy lazy goddamn fucking damn dumb ugly shit crap dummes dumme puto puta fresse maul gueule тупой тупая заткнись".split()
HARM = "kill killed murder die dead beat smash choke burn stab shoot hang hurt strangle drown hell убью умри stirb verrecke creve muere".split()
SECOND = "you your yours yourself du dich dir dein deine tu te toi ta ton eres ты тебя тебе твой вы you're u".split()
PEOPLE = (
    "immigrants foreigners women refugees muslims jews christians gays migrants blacks whites arabs asians gypsies race races folk tribe believers ausländer auslander juden frauen immigres etrangers femmes "
    "inmigrantes extranjeros mujeres мигранты иностранцы женщины евреи"
).split()
CONTEMPT = (
    "vermin subhuman subhumans parasites cockroaches rats savages exterminate exterminated deport deported eradicate inferior infest plague scum untermenschen ungeziefer parasiten vermine plaga ratas alimanas "
    "паразиты недочеловеки крысы"
).split()
SEXUAL = (
    "pussy blowjob porn porno porns milf milfs nude nudes naked horny dildo cum cumshot handjob cock dick anal sex sexy tits boobs gangbang orgasm hentai masturbate masturbating masturbated deepthroat threesome "
    "fuck fucked moaned nackt nackte nue nues desnuda desnudas порно голые эротика إباحي अश्लील πορνο"
).split()
# Words of scripts without blanks, found as parts of a passage.
UNSPACED = {"abuse": "白痴 笨蛋 傻逼 蠢货 去死 闭嘴 馬鹿野郎 バカ野郎 死ね 黙れ หุบปาก".split(), "hate": "害虫 低等人 劣等人種".split(), "sexual": "色情 裸照 ポルノ エロ โป๊".split()}

LEXICON = {"abuse": frozenset(INSULTS), "hate": frozenset(CONTEMPT), "sexual": frozenset(SEXUAL)}
_BAGS = {k: frozenset(v) for k, v in {"scorn": SCORN, "harm": HARM, "second": SECOND, "people": PEOPLE}.items()}
_CATEGORY_OF = {w: c for c, ws in LEXICON.items() for w in ws}
_VOCABULARY = frozenset().union(*LEXICON.values(), _BAGS["scorn"], _BAGS["harm"], _BAGS["people"])

# General sentences, so that a collection without reviews has something to learn from.
SEEDS = {
    "abuse": ["You are an {insult}.", "You {scorn} {insult}!", "I will hurt you, {insult}.", "What a {scorn} {insult} you are.", "{insult}! I hope you die.", "Nobody likes you, you {scorn} {insult}.", "Du bist ein {insult}.", "Tu es un {insult}."],
    "hate": ["{people} are parasites.", "All {people} are subhuman.", "We must exterminate the {people}.", "I hate {people}, they are cockroaches.", "Deport the {people}, an inferior race.", "{people} sind Parasiten."],
    "sexual": ["Watch free porn tonight.", "They had sex, naked on the bed.", "Nude girls, horny and ready.", "She sucked his cock.", "Big boobs and anal sex.", "He masturbated until he came."],
    "": [
        "The pump runs.", "Stop when the lamp goes out.", "Prüfen Sie die Pumpe.", "You must wear gloves.", "The foreigners fill in a second form.", "Women and men share the room.", "Rats were seen in the store.", "A dead battery can hurt the lamp.",
        "Kill the lights at ten.", "The sex of the plant is noted.", "The naked branch has no leaves.", "A useless filter stays out.", "Burn the paper.", "The cock of the barrel drips.",
    ],
}

_LEET = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "i", "€": "e"})


def _marks() -> str:
    """Ranges of all combining marks, which belong to the word they stand in."""
    out, start = [], None
    for o in range(0x300, 0x11A00):
        inside = unicodedata.category(chr(o))[0] == "M"
        if inside and start is None:
            start = o
        elif not inside and start is not None:
            out.append(f"{chr(start)}-{chr(o - 1)}")
            start = None
    return "".join(out)


_BARE_SCRIPTS = "฀-๿぀-ヿ一-鿿"
_TOKEN = re.compile(rf"[{_BARE_SCRIPTS}]|(?:(?![{_BARE_SCRIPTS}])[\w$@*{_marks()}])+(?:['’-](?:(?![{_BARE_SCRIPTS}])[\w$@*{_marks()}])+)*")
_ASCII_TOKEN = re.compile(r"[\w$@*]+(?:['-][\w$@*]+)*", re.ASCII)
_UNSPACED = {c: re.compile("|".join(map(re.escape, ws))) for c, ws in UNSPACED.items()}
_HAS_BARE = re.compile(f"[{_BARE_SCRIPTS}]")
_APART = re.compile(r"(?<![^\W_])(?:[^\W_][ .·_\-]){2,}[^\W_](?![^\W_])")
_DAMAGE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]+(?:[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]+)*")
_PASSAGE = re.compile(r"(?<=[.!?。！？।؟])[\"'”»)]*\s+|\n+|(?<=[。！？])")
_SQUEEZE = re.compile(r"(.)\1+")
_THREE = re.compile(r"(.)\1\1")
_SIGNS = re.compile(r"[@$*0-9]")


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not "̀" <= c <= "ͯ")


_SQUEEZED: dict = {}
for _w in sorted(_VOCABULARY):
    _SQUEEZED.setdefault(_SQUEEZE.sub(r"\1", _w), _w)
_BY_LENGTH: dict = {}
for _w in sorted(_VOCABULARY):
    _BY_LENGTH.setdefault(len(_w), []).append(_w)


def _read(token: str) -> tuple:
    """(word as meant, 1 if it was disguised). Words with digits and no meaning become ``#``."""
    low = token.lower()
    word = low if low.isascii() else _bare(low)
    if word in _VOCABULARY:
        return word, 0
    if not _SIGNS.search(word):
        if not _THREE.search(word):
            return word, 0
    elif not any(c.isalpha() for c in word) and not any(c in "@$*" for c in word):
        return "#", 0
    plain = word.translate(_LEET)
    if plain in _VOCABULARY:
        return plain, 1
    if "*" in plain and any(c.isalpha() for c in plain):
        pattern = re.compile(re.escape(plain).replace(r"\*", "."))
        for w in _BY_LENGTH.get(len(plain), ()):
            if pattern.fullmatch(w):
                return w, 1
    squeezed = _SQUEEZE.sub(r"\1", plain)
    if squeezed != plain and squeezed in _SQUEEZED:
        return _SQUEEZED[squeezed], 1
    return ("#" if any(c.isdigit() for c in word) else word), 0


class _Reader(dict):
    """Words as meant of tokens, worked out when first met; forgets all when it holds KEPT."""

    KEPT = 200_000

    def __missing__(self, token: str) -> str:
        if len(self) >= self.KEPT:
            self.clear()
        word = self[token] = _read(token)[0]
        return word


_MEANT = _Reader()


def _undamage(m: re.Match) -> str:
    try:
        return b"".join(c.encode("cp1252") if ord(c) > 255 else c.encode("latin-1") for c in m.group()).decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return m.group()


def _join(m: re.Match) -> str:
    joined = "".join(c for c in m.group() if c not in " .·_-")
    if _read(joined)[0] in _VOCABULARY:
        return joined
    for k in range(1, len(joined) - 2):  # a one-letter word before the word set apart
        if _read(joined[k:])[0] in _VOCABULARY:
            return joined[:k] + " " + joined[k:]
    return m.group()


def unfold(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _DAMAGE.sub(_undamage, text)
        text = "\n".join(line if line.isascii() else canonical_text(line) for line in text.split("\n"))
    return _APART.sub(_join, text)


def parse(text) -> list:
    """Passages of a text: (words as meant, tokens, passage)."""
    out: list = []
    if not text:
        return out
    meant = _MEANT.__getitem__
    for passage in _PASSAGE.split(unfold(text)):
        tokens = (_ASCII_TOKEN if passage.isascii() else _TOKEN).findall(passage)
        if tokens:
            out.append((list(map(meant, tokens)), tokens, passage))
    return out


NAMES = [f"{c}_{k}" for c in CATEGORIES for k in ("learned", "leads", "pull", "words", "peak", "density")] + [
    "near_second", "harm_second", "people_contempt", "scorn", "known_clean", "disguised", "capitals", "exclaims", "shared",
]
_AT = {n: i for i, n in enumerate(NAMES)}
NOTHING_LEARNED: dict = {"one": {}, "two": {}, "clean": frozenset()}


def _near(a: list, b: list) -> int:
    return sum(any(abs(i - j) <= NEAR for j in b) for i in a)


def measure(passages: list, learned: dict = NOTHING_LEARNED) -> list:
    """The dense features (NAMES) of a parsed text."""
    f = [0.0] * len(NAMES)
    one, two, clean = learned["one"], learned["two"], learned["clean"]
    total = 0
    for words, tokens, passage in passages:
        total += len(words)
        distinct = set(words)
        marked = not distinct.isdisjoint(_VOCABULARY)
        score = [0.0, 0.0, 0.0]
        for w in distinct & one.keys():
            c, v = one[w]
            score[c] += v
        if not distinct.isdisjoint(two):
            met = set()
            for i in range(len(words) - 1):
                after = two.get(words[i])
                if after is not None and (hit := after.get(words[i + 1])) is not None and (words[i], words[i + 1]) not in met:
                    met.add((words[i], words[i + 1]))
                    score[hit[0]] += hit[1]
        bare = not passage.isascii() and _HAS_BARE.search(passage)
        if not (marked or bare or any(score)):
            continue
        hits = {c: [] for c in CATEGORIES}
        for i, w in enumerate(words):
            c = _CATEGORY_OF.get(w)
            if c is None:
                continue
            if (w, words[i + 1] if i + 1 < len(words) else "") in clean or (words[i - 1] if i else "", w) in clean:
                f[_AT["known_clean"]] += 1
            else:
                hits[c].append(i)
        counts = [len(hits[c]) for c in CATEGORIES]
        if bare:
            counts = [n + len(_UNSPACED[c].findall(passage)) for n, c in zip(counts, CATEGORIES)]
        place = {k: [i for i, w in enumerate(words) if w in bag] for k, bag in _BAGS.items()} if marked else {k: [] for k in _BAGS}
        force = [s + 2.0 * n for s, n in zip(score, counts)]
        lead = max(range(3), key=lambda k: (force[k], -k))
        for k, c in enumerate(CATEGORIES):
            base = k * 6
            f[base] = max(f[base], score[k])
            if k == lead:
                f[base + 1] = max(f[base + 1], force[k])
                f[base + 2] = max(f[base + 2], force[k] - max(force[j] for j in range(3) if j != k))
            f[base + 3] += counts[k]
            f[base + 4] = max(f[base + 4], counts[k])
        if sum(n > 0 for n in counts) > 1:
            f[_AT["shared"]] += 1
        f[_AT["near_second"]] += _near(hits["abuse"], place["second"])
        f[_AT["harm_second"]] += _near(place["harm"], place["second"])
        f[_AT["people_contempt"]] += _near(hits["hate"], place["people"])
        f[_AT["scorn"]] += len(place["scorn"]) * (lead == 0)
        if marked:
            f[_AT["disguised"]] += sum(_read(t)[1] for t, w in zip(tokens, words) if w in _VOCABULARY)
        if any(force):
            letters = sum(map(str.isalpha, passage))
            f[_AT["capitals"]] = max(f[_AT["capitals"]], sum(map(str.isupper, passage)) / max(1, letters))
            f[_AT["exclaims"]] += passage.count("!")
    for k in range(3):
        f[k * 6 + 5] = f[k * 6 + 3] / max(1, total)
    return f


def learn_lexicon(reviewed: list) -> dict:
    """reviewed: (passages, {category: share of reviewers}, clean share). Entries of weight for the category they belong to.

    An entry (a word, or two words in succession) counts once in each document. It is taken where the
    log of its rate in the documents of a category over that in clean ones, times the documents that
    hold it, reaches LEAST_EVIDENCE.
    """
    sums = [Counter() for _ in range(4)]
    totals = np.zeros(4)
    for passages, share, clean in reviewed:
        entries = set()
        for words, _, _ in passages:
            entries.update(words)
            entries.update(zip(words, words[1:]))
        for k, v in enumerate([*(share.get(c) or 0.0 for c in CATEGORIES), clean]):
            if v > 0:
                totals[k] += v
                for e in entries:
                    sums[k][e] += v
    one: dict = {}
    two: dict = {}
    for k in range(3):
        for e, n in sums[k].items():
            if n < LEAST_SEEN or n < 0.5 * sum(sums[j][e] for j in range(3)):
                continue
            weight = math.log((n / totals[k]) / ((sums[3][e] + 0.5) / (totals[3] + 1.0)))
            if weight <= 0.7 or weight * n < LEAST_EVIDENCE:
                continue
            entry = (k, min(TOP_WEIGHT, weight))
            if isinstance(e, tuple):
                two.setdefault(e[0], {})[e[1]] = entry
            elif e != "#":
                one[e] = entry
    known = frozenset(
        e for e, n in sums[3].items()
        if isinstance(e, tuple) and n >= 2 and (e[0] in _CATEGORY_OF or e[1] in _CATEGORY_OF)
        and all(sums[k][e] / max(totals[k], 1.0) <= 2 * n / totals[3] for k in range(3))
    )
    return {"one": one, "two": two, "clean": known}


def stable(lexica: list) -> dict:
    """The entries that every one of the lexica has for the same category, at their mean weight; clean pairs of half of them."""
    first, *rest = lexica

    def common(entries: dict, others: list) -> dict:
        return {e: (v[0], sum(o[e][1] for o in [entries, *others]) / (1 + len(others))) for e, v in entries.items() if all(e in o and o[e][0] == v[0] for o in others)}

    two = {w: found for w, after in first["two"].items() if (found := common(after, [o["two"].get(w, {}) for o in rest]))}
    return {"one": common(first["one"], [o["one"] for o in rest]), "two": two, "clean": frozenset(e for e, n in Counter(e for o in lexica for e in o["clean"]).items() if 2 * n >= len(lexica))}


def seeds():
    """(features, category or '') of the seed sentences, alone and within a longer plain text."""
    around = "Stop when the lamp goes out. See the table below. Prüfen Sie die Pumpe. Wear eye protection. " * 4
    out = []
    for category, forms in SEEDS.items():
        for k, form in enumerate(forms):
            for j in range(4):
                pick = lambda xs: xs[(zlib.crc32(form.encode()) + 7 * j + k) % len(xs)]
                text = form.format(insult=pick(INSULTS[:16]), scorn=pick(SCORN[:13]), people=pick(PEOPLE[:9]))
                out.append((measure(parse([text, text.upper(), around + text, text + " " + around][j])), category))
    return out


def fit(reviewed: list) -> dict:
    """reviewed: (text, {category: share of reviewers, or None where unknown}, clean share). The lexicon, and a model for each category."""
    parsed = [(parse(t), share, clean) for t, share, clean in reviewed]
    part = [zlib.crc32((t or "").encode("utf-8", "replace")) % FOLDS for t, _, _ in reviewed]
    rows: list = [None] * len(parsed)
    lexica = [learn_lexicon([p for p, f in zip(parsed, part) if f != k]) for k in range(FOLDS)]
    for i, f in enumerate(part):
        rows[i] = measure(parsed[i][0], lexica[f])
    base = seeds()
    models = {}
    for c in CATEGORIES:
        told = [share.get(c) for _, share, _ in reviewed]
        x = np.array([f for f, _ in base] + rows, dtype=float)
        y = np.array([float(k == c) for _, k in base] + [v or 0.0 for v in told])
        weight = np.array([0.5] * len(base) + [OTHER if v is None else 1.0 for v in told])
        mix = np.random.default_rng(5).permutation(len(y))
        models[c] = fit_calibrated(x[mix], y[mix], weight[mix])
    return {"lexicon": stable(lexica), "models": models}


def score_texts(model: dict, texts: list) -> dict:
    """{category: probabilities} of the texts."""
    x = np.array([measure(parse(t), model["lexicon"]) for t in texts], dtype=np.float64).reshape(-1, len(NAMES))
    same, back = np.unique(x, axis=0, return_inverse=True) if len(x) else (x, np.empty(0, dtype=np.int64))
    return {c: probability(model["models"][c], same)[back.ravel()] for c in CATEGORIES}


def verdicts(labels: DataFrame) -> DataFrame:
    """doc_id, n, and the number of reviewers for clean and for each category (any spelling of the verdict)."""
    v = F.lower(F.trim("verdict"))
    return labels.where(v.isin("clean", *CATEGORIES)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum((v == c).cast("int")).alias(c) for c in ("clean", *CATEGORIES)])


def reviewed_sample(documents: DataFrame, labels: DataFrame) -> list:
    """(text, shares, clean share) of the reviewed documents; at most MAX_LABELS, so the broadcast and the driver hold no more."""
    chosen = verdicts(labels).where("doc_id is not null").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(MAX_LABELS)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    out = []
    for r in rows:
        # None: only other categories were named, which says little (OTHER) of this one.
        share = {c: r[c] / r.n for c in CATEGORIES}
        clean = r.clean / r.n
        out.append((r.text, {c: share[c] if share[c] > 0 or clean > 0.5 else None for c in CATEGORIES}, clean))
    return out


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, abuse, hate, sexual (probabilities) of every document."""
    key = documents.select("doc_id").schema[0].dataType.simpleString()
    model = documents.sparkSession.sparkContext.broadcast(fit(reviewed_sample(documents, labels)))

    def run(batches):
        for batch in batches:
            p = score_texts(model.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(p[c]) for c in CATEGORIES]], names=["doc_id", "source", *CATEGORIES])

    return documents.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {key}, source string, abuse double, hate double, sexual double")


def found(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, category of every category a document is found to have."""
    hits = F.filter(F.array(*[F.when(F.col(c) >= least, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull())
    return scores.where("doc_id is not null").select("doc_id", F.explode(hits).alias("category")).distinct()


def rates(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents, and the share with each category, of every source (spelling settled)."""
    source = F.regexp_replace(F.lower(F.trim("source")), "_", "-")
    return scores.groupBy(source.alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), *[F.round(F.avg((F.col(c) >= least).cast("double")), 6).alias(f"{c}_rate") for c in CATEGORIES]
    )
