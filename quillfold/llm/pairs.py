"""Problem 2: faulty question and answer pairs by a multi-label linear classifier.

A pair becomes hashed n-grams of its answer (words, pairs of words, first and last words) and
pair features (how much of either text is in the other, languages, how the answer ends). One
logistic unit per defect is trained on pairs of the corpus and on pairs spoilt on purpose:
answers cut short, questions given back, answers swapped with ones in another language,
refusals from a small grammar, and answers that say nothing. Pairs that the first training
finds faulty are left out of the sound ones of the second. The threshold of each defect is
calibrated on held-out pairs; a pair gets the defect whose score is furthest above its threshold.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.sketch import hashed_counts, least_hashed
from quillfold.sources.tables import ship_package

DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")
SAMPLE_PAIRS = 5000  # pairs the classifier is fitted on
WIDTH = 1 << 16
VOCABULARY = 1 << 18

# Frequent function words by language; Chinese is told by its characters.
LANGUAGE_WORDS = {
    "en": "the a an and or of to in at by for from with is are was were be been has have had not no that this it its as who which when where if then than only any each some before after until must may can cannot should between both what how does do about why our under day within i my we you",
    "de": "der die das den dem des ein eine einen einem einer und oder von zu im am an auf mit für bei nach vor ist sind wird werden nicht kein sich als wer wenn dann bis zum zur soll muss darf kann hat hatte gilt dass alle wie was wann warum über wo welche ich sie es dazu",
    "es": "el la los las un una unos y o de del al en con por para sin es son se no que como cuando si su sus lo más debe puede hay tras según quien quién qué cómo cuándo dónde nadie ni durante cada antes después",
    "fr": "le la les un une des et ou de du au aux à avec par pour sans est sont se ne pas qui que quand si sur sous dans doit peut il elle son sa ses celui en puis selon personne avant après pendant comment dit quel quelle où je pourquoi cette",
}
LANGUAGES = (*LANGUAGE_WORDS, "zh")
_OF_WORD: dict[str, list[int]] = {}
for _k, _words in enumerate(LANGUAGE_WORDS.values()):
    for _w in _words.split():
        _OF_WORD.setdefault(_w, []).append(_k)

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[一-鿿]")
TOKEN = re.compile(r"[一-鿿]|[a-z]{2,4}-\d+|[^\W_](?:[^\W_]|['’-](?=[^\W_]))*")
QUOTED = re.compile(r"“[^”]*”|\"[^\"\n]*\"|«[^»]*»|„[^“”]*[“”]|《[^》]*》|「[^」]*」")
TAIL = re.compile(r"(?<= )[^\W\d_]+(?: [^\s]+){1,4}$")
TRAIL = re.compile(r"(?:\s*(?:\[\d+\]|\((?:see|source|vgl\.?|siehe|ver|voir|fuente|quelle|参见|来源)?[^()]{0,25}\)|（[^（）]{0,20}）))+\s*$", re.I)
ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+(.*)$")
STOP = re.compile(r"[.!?](?=\s)|[。！？]")
SPACES = re.compile(r"\s+")


def languages(text: str) -> np.ndarray:
    """Hits of each language, without what is quoted."""
    hits = np.zeros(len(LANGUAGES))
    bare = QUOTED.sub(" ", text.lower())
    for w in WORD.findall(bare):
        if "一" <= w <= "鿿":
            hits[-1] += 0.5
        else:
            of = _OF_WORD.get(w)
            if of:
                for k in of:
                    hits[k] += 1 / len(of)
    return hits


def _near(a: str, b: str) -> tuple[float, float]:
    """Share of a's letter trigrams that b has, and the reverse."""
    x, y = {a[k : k + 3] for k in range(len(a) - 2)}, {b[k : k + 3] for k in range(len(b) - 2)}
    both = len(x & y)
    return (both / len(x) if x else 0.0), (both / len(y) if y else 0.0)


def features(question: str | None, answer: str | None, known: np.ndarray) -> list[int]:
    """The active places of a pair, of ``WIDTH``; ``known`` marks hashes of words of the corpus."""
    q, raw = SPACES.sub(" ", (question or "").lower()).strip(), (answer or "").strip()
    a = SPACES.sub(" ", raw.lower()).replace("​", "").strip()
    rest = a
    if q and len(q) > 8:
        core = q.strip(" ?？¿.!")
        rest = a.replace(core, " ")
        rest = SPACES.sub(" ", rest).strip(" ?？¿.!-:\"“”'")
    out: list[str] = []
    letters = sum(1 for c in a if c.isalnum())
    left = sum(1 for c in rest if c.isalnum())
    inside, back = _near(a, q)
    tokens = TOKEN.findall(rest)
    n = len(tokens)
    zh = sum(1 for t in tokens if "一" <= t <= "鿿") * 2 > n
    out += [f"letters{min(letters, 1)}", f"left{min(left, 12) if letters else -1}", f"in{int(inside * 10)}", f"back{int(back * 10)}", f"in{int(inside * 5)}back{int(back * 5)}", f"len{min(n, 64).bit_length()}"]
    if left < letters:
        out.append(f"gone{int(8 * (letters - left) / letters)}")
        if left < 0.3 * letters:
            out.append(f"goneall{min(left, 12) // 3}")
    masked = ["0-code" if "-" in t and t[-1].isdigit() else "0" if t.isdigit() else t for t in tokens]
    for t, u in zip(masked, [*masked[1:], ""]):
        out.append(f"w {t}")
        out.append(f"b {t} {u}")
    whole = SPACES.sub(" ", a)
    out += [f"a {whole}"] if len(whole) < 16 else []
    out += [f"f {' '.join(masked[:2])}", f"f {' '.join(masked[:3])}"]
    hits_q, hits_a = languages(question or ""), languages(rest)
    sq, sa = hits_q.sum(), hits_a.sum()
    if sq and sa:
        lq, la = int(hits_q.argmax()), int(hits_a.argmax())
        lead = hits_a[la] - hits_a[lq]
        other = "same" if la == lq or lead <= 0 else f"other{min(4, int(lead))}"
        out += [f"lang {other}", f"lang {other} {min(int(4 * lead / max(n if not zh else n / 2, 1)), 3)}"]
        if other != "same":
            out.append(f"lang {other} {min(n, 16).bit_length()}")
    else:
        out.append("lang none")
    # How it ends: the last line of a list is complete without a mark.
    lines = [x for x in raw.splitlines() if x.strip()]
    last_line = lines[-1] if lines else ""
    item = ITEM.match(last_line)
    marked = any(m and m.group(1).rstrip()[-1:] in ".;。；" for m in map(ITEM.match, lines[:-1])) if item else False
    body = TRAIL.sub("", raw)
    cited = body != raw
    end = body.rstrip()[-1:]
    kind = "none" if not end else "dots" if end == "…" or body.rstrip().endswith("...") else "stop" if end in ".!?。！？" else "quote" if end in "\"”’)»]）」》" else "comma" if end in ",;:，；：、-–" else "digit" if end.isdigit() else "letter"
    context = ("item" + "m" * marked) if item else "short" if n <= (8 if zh else 5) else "long"
    last = masked[-1] if masked else ""
    last2 = " ".join(masked[-2:])
    unknown = bool(last) and not zh and last.isalpha() and not known[crc32(last.encode()) % VOCABULARY]
    out += [f"e {context} {kind}", f"e {context} {kind} {cited}", f"u {context} {kind} {unknown}"]
    if not item and kind not in ("stop", "none"):
        stops = list(STOP.finditer(raw))
        after = len(TOKEN.findall(raw[stops[-1].end() :])) if stops else n
        out.append(f"after {bool(stops)} {kind} {min(after, 31).bit_length() if stops else 0}")
    if kind in ("letter", "comma", "digit", "dots"):
        out += [f"l {context} {last}", f"l2 {context} {last2}", f"k {context} {kind} {unknown} {'zh' if zh else 'x'}"]
        if last in _OF_WORD:
            out.append(f"l function {context}")
    start = raw[:1]
    out.append(f"c {'low' if start.islower() else 'up' if start.isupper() else 'other'} {context} {kind}")
    if item:
        out.append(f"i {min(len(TOKEN.findall(item.group(1))), 4)} {kind} {marked}")
    if raw.count("(") > raw.count(")") or raw.count("“") > raw.count("”") or raw.count("（") > raw.count("）"):
        out.append("open")
    return list({crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in out})


# ---------------------------------------------------------------------- spoilt pairs

_NOTHING = ["", " ", "\n", "...", "…", "-", "--", "—", "n/a", "N/A", "NA", "null", "None", "none", "nil", "[]", "{}", '""', "''", "​", "(no answer)", "no answer", "No answer.", "(empty)", "?", ".", "keine Antwort", "sin respuesta", "(sans réponse)", "无", "无答案", "TBD", "<no response>", "undefined"]

# Parts of refusals; {} is what the question is about.
_REFUSALS = {
    "en": (
        ["", "", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "I'm afraid ", "Apologies - ", "Thank you for asking, but ", "As an assistant, ", "Hm, ", "Regrettably, ", "As a language model, ", "Well, "],
        ["I can't help with that", "I cannot answer this question", "I am unable to provide this", "I'm not able to comment on {}", "I must decline to answer", "I don't know", "I do not have that information", "no information about this is available to me", "I have no access to records about {}, so no answer can be given", "I would rather not speculate about it", "that is outside what I may discuss", "this cannot be answered from what I have been given", "there is not enough context for an answer", "my guidelines prevent me from giving details", "we do not respond to this kind of question here", "not something I can assist with", "I won't be able to assist with {}", "I am not allowed to share that", "I prefer not to say anything about {}", "it would not be appropriate for me to say", "that request has to be turned down", "your request must be refused", "this is something I may not discuss", "I cannot comment on {}", "it is not possible for me to respond to that", "I have nothing to say about {}"],
        ["", "", "", " Is there something else you need?", " You may rephrase the question.", " Please contact the {}.", " The {} might know more.", " Try the {} instead.", " Have a pleasant shift.", " Please ask someone else."],
    ),
    "de": (
        ["", "Leider ", "Es tut mir leid, ", "Danke für die Frage, aber ", "Entschuldigung, "],
        ["dazu kann ich nichts sagen", "diese Frage darf ich nicht beantworten", "kann ich diese Frage nicht beantworten", "ich habe keine Informationen zu {}", "zu {} möchte ich mich nicht äußern", "liegen mir keine Angaben vor", "dabei kann ich nicht helfen", "dazu fehlen mir die Informationen", "das darf ich nicht mitteilen"],
        ["", "", " Bitte fragen Sie {}.", " Bitte wenden Sie sich an jemand anderen."],
    ),
    "es": (
        ["", "Lo siento, ", "Por desgracia, ", "Gracias, pero ", "Lamentablemente, "],
        ["no puedo responder a esta pregunta", "prefiero no opinar sobre {}", "no dispongo de información para contestar", "no puedo ayudar con eso", "no tengo datos sobre {}", "ninguna información me permite responder", "no me está permitido hablar de eso"],
        ["", "", " Consulte con {}.", " Pregunte a otra persona."],
    ),
    "fr": (
        ["", "Désolé, ", "Malheureusement, ", "Merci, mais ", "Je regrette, "],
        ["je ne peux pas répondre à cette question", "je préfère ne pas me prononcer sur {}", "je n'ai pas d'information à ce sujet", "je ne dispose d'aucun renseignement pour répondre", "je ne peux pas vous aider", "aucune information ne me permet de répondre", "cette demande dépasse ce que je peux dire"],
        ["", "", " Adressez-vous ailleurs : {}.", " Veuillez demander à quelqu'un d'autre."],
    ),
    "zh": (
        ["", "抱歉，", "很遗憾，", "对不起，", "感谢提问，不过"],
        ["我无法回答这个问题", "这个问题我不便回答", "我没有关于{}的资料，无法作答", "关于{}我不方便发表意见", "我帮不了这个忙", "现有资料不足，无法回答", "我不能提供这方面的信息"],
        ["", "", "请咨询{}。", "请换一种问法。"],
    ),
}


def _language(text: str) -> str:
    hits = languages(text)
    return LANGUAGES[int(hits.argmax())] if hits.any() else "en"


def refusal(question: str, rng: random.Random) -> str:
    openers, cores, closers = _REFUSALS[_language(question)]
    words = TOKEN.findall(question)
    about = rng.choice(words) if words else "it"
    if _language(question) == "en" and rng.random() < 0.5:
        about = f"the {about}"
    core = rng.choice(cores).replace("{}", about)
    first = rng.choice(openers)
    text = (first + core) if first else core[:1].upper() + core[1:]
    close = rng.choice(closers).replace("{}", " ".join(words[1:3]).lower() or about)
    stop = rng.choice(["。", "。", "！", ""]) if "一" <= text[-1] else rng.choice([".", ".", ".", "!", ""])
    text += stop if stop or not close else "."
    text += close
    draw = rng.random()
    if draw < 0.08:
        text = f"{question} {rng.choice(['', 'Well, '])}{text}"
    elif draw < 0.14:
        text = text.lower()
    elif draw < 0.2:
        text = f"\n{text}\n"
    return text


def copied(question: str, rng: random.Random) -> str:
    q = question
    bare = q.strip(" ?？¿.")
    return rng.choice([q, q, q.lower(), q.upper(), bare, bare + ".", f"{q} {q}", f"Question: {q}", f"- {q}", f"“{q}”", f'"{q}"', q.replace(" ", "  "), bare + " ...", f"Q: {q}", f"You asked: {q}", f"\n{q}\n", bare.lower() + "?", f"{q}\n{q}"])


def cut(answer: str, rng: random.Random) -> str | None:
    """A beginning of the answer that stops inside a sentence or a list entry."""
    text = answer.rstrip()
    if len(text) < 12:
        return None
    for _ in range(8):
        at = rng.randrange(max(4, len(text) // 5), len(text) - 1)
        part = text[:at]
        if rng.random() < 0.6 and " " in part and not "一" <= part[-1] <= "鿿":
            part = part[: part.rindex(" ")].rstrip()
        if len(part) > 3 and (part[-1].isalnum() or part[-1] in ",;，、；"):
            if ITEM.match(part.splitlines()[-1]) and text[len(part) : len(part) + 1] in ("\n", ""):
                continue
            return part + (rng.choice([",", ",", " …", "…", " ...", "...", " (see"]) if rng.random() < 0.25 else "")
    return None


def spoil(pairs: list[tuple[str, str]], rng: random.Random) -> list[tuple[str, str, str]]:
    """(question, answer, defect or '') made from pairs that are sound mostly."""
    out = []
    tongues: dict[str, list[str]] = {}
    for q, a in pairs:
        if len(TOKEN.findall(a)) >= 6:
            tongues.setdefault(_language(a), []).append(a)
    for q, a in pairs:
        own = _language(q)
        short = len(TOKEN.findall(a)) < 4
        for _ in range(2):
            if not short and (part := cut(a, rng)):
                out.append((q, part, "truncated"))
        out.append((q, copied(q, rng), "copied_question"))
        for _ in range(2):
            out.append((q, refusal(q, rng), "refusal"))
        others = [t for t in tongues if t != own]
        if others:
            b = rng.choice(tongues[rng.choice(others)])
            if rng.random() < 0.5:
                b = re.split(r"(?<=[.。])\s*", b)[0] or b
            out.append((q, b, "other_language"))
        if rng.random() < 0.3:
            out.append((q, rng.choice(_NOTHING), "empty"))
        if own in tongues:  # off the point, but sound
            out.append((q, rng.choice(tongues[own]), ""))
        names = [t for t in TOKEN.findall(q) if len(t) > 2]
        if names and rng.random() < 0.3:
            t = rng.choice(names)
            out.append((q, rng.choice([t, f"Yes, {t}.", f"{t}.", f"Ask {t}.", f"No, {t}", t.capitalize()]), ""))
        phrase = TAIL.search(re.split(r"[.。!?,;\n]", a, maxsplit=1)[0]) if not short else None
        if phrase and rng.random() < 0.5:  # a bare phrase that answers
            out.append((q, phrase.group(0) + rng.choice(["", "", "."]), ""))
        if not short and rng.random() < 0.3:
            out.append((q, a + rng.choice([" [1]", " (source 2)", "\n", " [2][3]"]), ""))
    return out


# ---------------------------------------------------------------------- the classifier


class PairModel:
    """Weights (WIDTH x defects), thresholds on the scores, and the marks of known words."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, known: np.ndarray):
        self.weights, self.thresholds, self.known = weights, thresholds, known

    def scores(self, question: str | None, answer: str | None) -> np.ndarray:
        return self.weights[features(question, answer, self.known)].sum(axis=0)

    def defect(self, question: str | None, answer: str | None, barred: str | None = None) -> str | None:
        if not any(c.isalnum() for c in answer or ""):
            return "empty"
        over = self.scores(question, answer) - self.thresholds
        if barred:
            over[DEFECTS.index(barred)] = -1.0
        if max(over[DEFECTS.index("refusal")], over[DEFECTS.index("copied_question")]) > 0:
            over[DEFECTS.index("truncated")] = -1.0  # these often come without a full stop
        k = int(over.argmax())
        return DEFECTS[k] if over[k] > 0 else None


def _fit(rows: list[list[int]], y: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Logistic units by Adagrad on batches; an L2 term keeps rare features small."""
    rng = np.random.default_rng(seed)
    w, seen = np.zeros((WIDTH, y.shape[1])), np.full((WIDTH, y.shape[1]), 1e-2)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            flat = np.concatenate([rows[k] for k in part])
            sizes = np.array([len(rows[k]) for k in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            z = np.add.reduceat(w[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            used, place = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(place, weights=g[owner, j], minlength=len(used)) for j in range(y.shape[1])], axis=1) / len(part) + 1e-5 * w[used]
            seen[used] += step**2
            w[used] -= 0.08 * step / np.sqrt(seen[used])
    return w


def _targets(labels: list[str]) -> np.ndarray:
    return np.array([[d == x for d in DEFECTS] for x in labels], dtype=float)


def _answer_words(pdf: pd.DataFrame) -> np.ndarray:
    """The places of the words of each answer, once an answer; its last word may be cut and isn't counted."""
    return np.array([crc32(w.encode()) % VOCABULARY for a in pdf["answer"] for w in {t for t in TOKEN.findall(a.lower())[:-1]}], dtype=np.int64)


def train(pairs: list[tuple[str, str]], seed: int = 5, rounds: int = 5, known_counts: np.ndarray | None = None) -> PairModel:
    """``known_counts`` counts the answers that have a word, over more pairs than these; without it, over these."""
    rng = random.Random(seed)
    pairs = [(q, a) for q, a in pairs if q and a and any(c.isalnum() for c in a)]
    if known_counts is None:
        known_counts = np.bincount(_answer_words(pd.DataFrame(pairs, columns=["question", "answer"])), minlength=VOCABULARY)
    known = known_counts >= 2
    sound = pairs
    for turn in range(2):
        made = spoil(sound, rng) + [(q, a, "") for q, a in sound] * 2
        rng.shuffle(made)
        rows = [np.array(features(q, a, known)) for q, a, _ in made]
        y = _targets([d for *_, d in made])
        cut_at = int(len(made) * 0.85)
        w = _fit(rows[:cut_at], y[:cut_at], rounds, seed + turn)
        z = np.array([w[r].sum(axis=0) for r in rows[cut_at:]])
        thresholds = np.array([_calibrate(z[:, j], y[cut_at:, j]) for j in range(len(DEFECTS))])
        model = PairModel(w, thresholds, known)
        if turn < 1:
            sound = [p for p in pairs if (model.scores(*p) < np.minimum(thresholds, 0) - 1).all()]
    return model


def _calibrate(z: np.ndarray, y: np.ndarray, weight: float = 2.0) -> float:
    """The score with the best F1 on held-out pairs, where sound ones count ``weight`` times,
    as they are rarer among the made pairs than in the corpus."""
    order = np.argsort(-z)
    hit = np.cumsum(y[order])
    false = np.cumsum(1 - y[order]) * weight
    f1 = 2 * hit / np.maximum(hit + false + y.sum(), 1e-9)
    k = int(f1.argmax())
    after = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + after) / 2)


def fit(pairs: DataFrame, sample_pairs: int = SAMPLE_PAIRS) -> PairModel:
    """Trains on the ``sample_pairs`` pairs (question, answer) whose hash is least, in any order of rows.

    The known words are counted over all distinct pairs, in an array of fixed size.
    """
    full = pairs.where("question is not null and answer is not null").select("question", "answer")
    rows = least_hashed(full, ["question", "answer"], sample_pairs).distinct().collect()
    known_counts = hashed_counts(full.distinct().select("answer"), _answer_words, VOCABULARY)
    return train(sorted((r.question, r.answer) for r in rows), known_counts=known_counts)


def faulty_pairs(pairs: DataFrame, model: PairModel) -> DataFrame:
    """(rel, row_key, defect) of the faulty rows among (rel, row_key, question, answer, abstains).

    A null answer, or one without a letter or digit, is ``empty``; a null question counts as
    an empty text. ``abstains`` true bars the defect ``refusal``. Repeated rows come out once;
    rows with a null key don't; extra columns are ignored; an empty table gives no rows.
    """
    ship_package(pairs.sparkSession)
    weights = (model.weights.astype(np.float32), model.thresholds, np.packbits(model.known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, t, packed = weights
        m = PairModel(w, t, np.unpackbits(packed)[:VOCABULARY].astype(bool))
        for pdf in batches:
            text = lambda x: x if isinstance(x, str) else None
            pdf["defect"] = [m.defect(text(q), text(a), "refusal" if n else None) for q, a, n in zip(pdf["question"], pdf["answer"], pdf["abstains"])]
            yield pdf.loc[pdf["defect"].notna(), ["rel", "row_key", "defect"]]

    needed = pairs.where("row_key is not null").select("rel", "row_key", "question", "answer", F.coalesce("abstains", F.lit(False)).alias("abstains"))
    return needed.mapInPandas(run, "rel string, row_key string, defect string").groupBy("rel", "row_key").agg(F.min("defect").alias("defect"))
