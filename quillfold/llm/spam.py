"""Problem 9: keyword-stuffed and link-list pages by a hidden Markov model over lines.

A page is a sequence of lines; each line has a hidden label (prose, link list, tag list or
menu) and shows seven discrete features. Given the label the features are independent, and a
label depends on the one before. The model is trained here: seed labels by plain rules on a
bounded sample of pages, then rounds of Viterbi training (label the sample with the most
likely path, count again), in which lines whose seed is certain keep it, so that the labels
can't drift to other meanings with another sample. Lines are then labelled over the whole corpus, and a page is
flagged when more than half of its characters stand in lines that aren't prose.

Front matter, code and table rows with numbers are structure, neither prose nor spam. Headings
and other table rows are structure of a page that has sentences; where there are none, they are
labelled like all lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.sketch import least_hashed
from quillfold.sources.tables import ship_package

LABELS = ("prose", "link_list", "tag_list", "menu")
PROSE, LINKS, TAGS, MENU = range(4)
SAMPLE_PAGES = 3000  # pages the model is fitted on
ROUNDS = 4

# Frequent function words of the corpus languages (en, de, es, fr) and function characters of Chinese.
FUNCTION_WORDS = frozenset(
    "the a an and or of to in on at by for from with is are was were be been has have had not no that this it its as who which when where if then than only any each some before after until must may can cannot should between both "
    "der die das den dem des ein eine einen einem einer und oder von zu im in am an auf mit für bei nach vor ist sind wird werden nicht kein sich als wer wenn dann bis zum zur soll muss darf kann hat hatte gilt dass alle "
    "el la los las un una unos y o de del al en con por para sin es son se no que como cuando si su sus lo más debe puede hay tras según quien nadie ni "
    "le les un une et ou du des au aux à avec par pour sans est sont se ne pas qui que quand si sur sous doit peut il elle son sa ses celui dans en puis selon personne".split()
)
FUNCTION_CHARS = frozenset("的了在和与或是不并则需由请后把个应可以先再从为到时其有被将者间内每没任何")

WORD = re.compile(r"[a-zà-öø-ÿœß]+(?:['’-][a-zà-öø-ÿœß]+)*|[0-9]+|[一-鿿]")
URL = re.compile(r"https?://\S+|www\.\S+|href=")
LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)|<a\s[^>]*>[^<]*</a>|https?://[^\s<>\"]+")
MARKS = re.compile(r"[,;|#•·»/、，；]| [–—-] ")
SENTENCE_END = re.compile(r"[.!?](?=[\s\"”')\]]|$)|[。！？]")
TABLE = re.compile(r"^\s*\|.*\|\s*$")
FIGURES = re.compile(r"\|\s*[^|A-Za-z一-鿿]*\s*(?=\|)")  # a cell without letters
HARD, SOFT = 1, 2  # structure that is never labelled, and structure that is where a page has no sentences
LEAST_PROSE = 0.1  # of a page's characters, from which it has sentences
SOFT_LINES = 5  # labelled headings and rows from which they count
SIZES = (4, 4, 5, 5, 4, 5, 4)  # values of each feature


def _bucket(x: float, bounds: tuple[float, ...]) -> int:
    k = 0
    for b in bounds:
        if x >= b:
            k += 1
    return k


def line_features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a page: features and characters of each line, and which lines are structure (0, HARD or SOFT). Blank lines are left out."""
    lines = [x.strip() for x in text.splitlines()]
    rows, chars, plain = [], [], []
    fence = front = False
    before: set[str] = set()
    for k, line in enumerate(lines):
        if not line:
            continue
        structure, size_of = HARD if fence or front else 0, len(line)
        if line[:3] == "```":
            fence, structure = not fence, HARD
        elif line == "---" and (k == 0 or front):
            front, structure = not front, HARD
        elif line[0] == "|" and TABLE.match(line):
            structure = structure or (HARD if FIGURES.search(line) else SOFT)
            line = line.strip("| ").replace("|", ",") or line
        elif line[0] == "#" and line[1:2] in (" ", "#"):
            structure = structure or SOFT
            line = line.strip("# ") or line
        bare = LINK.sub(" ", line) if "://" in line or "<a" in line else line
        linked = 1 - len(bare.strip(" -*:.\t")) / len(line)
        words = WORD.findall(bare.lower())
        n = len(words)
        cjk = sum([1 for w in words if w >= "一"])
        kinds = set(words)
        if cjk * 2 > n:
            function = sum([1 for w in words if w in FUNCTION_CHARS]) / n
            level = _bucket(function, (1e-9, 0.05, 0.10))
            again = 0 if n < 16 else 1 + _bucket(1 - len(set(zip(words, words[1:]))) / (n - 1), (0.2, 0.35, 0.5))
        else:
            function = sum([1 for w in words if w in FUNCTION_WORDS]) / n if n else 0.0
            level = _bucket(function, (1e-9, 0.08, 0.15))
            again = 0 if n < 12 else 1 + _bucket(1 - len(set(zip(words, words[1:]))) / (n - 1), (0.2, 0.35, 0.5))
        ends = len(SENTENCE_END.findall(bare))
        stops = 0 if not ends else 1 + _bucket(n / ends / (2 if cjk * 2 > n else 1), (4, 7, 30))
        marks = _bucket(len(MARKS.findall(bare)) / max(n, 1), (1e-9, 0.12, 0.25))
        size = _bucket(n, (1, 4, 9, 25))
        shared = len(kinds & before) / len(kinds) if kinds else 0.0
        rows.append((_bucket(linked, (1e-9, 0.35, 0.7)), level, stops, again, marks, size, _bucket(shared, (0.15, 0.35, 0.6))))
        chars.append(size_of)
        plain.append(structure)
        before = kinds
    return np.array(rows, dtype=np.int8).reshape(-1, len(SIZES)), np.array(chars, dtype=np.int64), np.array(plain, dtype=np.int8)


def seed_labels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first labels of lines, which are certain), by rules that only need to be right mostly.

    ``again`` is 1 to 4 by the share of pairs of words that the line had before, 0 in a short line.
    """
    link, level, stops, again, marks, size, shared = x.T
    label = np.full(len(x), PROSE)
    label[(level <= 1) & (size <= 3) & (stops == 0)] = MENU
    label[(level <= 1) & ((again >= 3) | (marks >= 2)) & (size >= 3)] = TAGS
    label[(again >= 3) | ((shared == 3) & (level <= 2))] = TAGS
    label[(link >= 2)] = LINKS
    label[(level >= 2) & (stops >= 2) & (again <= 2) & (link < 2)] = PROSE
    sure = (link == 3) | ((again == 4) & (link < 2)) | ((level == 3) & (stops >= 2) & (again <= 1) & (link == 0) & (shared < 2))
    return label, sure


class LineModel:
    """Start, transition and emission log probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, show: list[np.ndarray]):
        self.start, self.move, self.show = start, move, show

    @classmethod
    def counted(cls, pages: list[np.ndarray], labels: list[np.ndarray]) -> LineModel:
        k = len(LABELS)
        start, move, show = np.ones(k), np.ones((k, k)) + 8 * np.eye(k), [np.full((k, s), 0.5) for s in SIZES]
        for x, y in zip(pages, labels):
            if len(y):
                start[y[0]] += 1
                np.add.at(move, (y[:-1], y[1:]), 1)
                for f, table in enumerate(show):
                    np.add.at(table, (y, x[:, f]), 1)
        return cls(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), [np.log(t / t.sum(1, keepdims=True)) for t in show])

    def emission(self, x: np.ndarray) -> np.ndarray:
        return sum(t[:, x[:, f]].T for f, t in enumerate(self.show))

    def path(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels (Viterbi)."""
        n = len(x)
        if not n:
            return np.zeros(0, dtype=int)
        e = self.emission(x).tolist()
        move = self.move.tolist()
        states = range(len(LABELS))
        best, back = [a + b for a, b in zip(self.start.tolist(), e[0])], []
        for row in e[1:]:
            come = [max(states, key=lambda i, j=j: best[i] + move[i][j]) for j in states]
            best = [best[i] + move[i][j] + row[j] for j, i in enumerate(come)]
            back.append(come)
        y = [max(states, key=best.__getitem__)]
        for come in reversed(back):
            y.append(come[y[-1]])
        return np.array(y[::-1])


def train(texts: list[str], rounds: int = ROUNDS) -> LineModel:
    pages = [x[s == 0] for x, _, s in map(line_features, texts)]
    seeds = [seed_labels(x) for x in pages]
    labels = [y for y, _ in seeds]
    for _ in range(rounds):
        model = LineModel.counted(pages, labels)
        labels = [np.where(sure, y, model.path(x)) for x, (y, sure) in zip(pages, seeds)]
    return LineModel.counted(pages, labels)


def shares(model: LineModel, text: str) -> tuple[float, ...]:
    """The share of a page's characters in lines of each label; structure counts to the whole."""
    x, chars, structure = line_features(text)
    total = int(chars.sum())
    if not total:
        return (0.0,) * len(LABELS)
    use = structure == 0
    y = model.path(x[use])
    if (structure == SOFT).sum() >= SOFT_LINES and chars[use][y == PROSE].sum() < LEAST_PROSE * total:
        use = structure != HARD
        y = model.path(x[use])
    return tuple((np.bincount(y, weights=chars[use], minlength=len(LABELS)) / total).tolist())


def fit(df: DataFrame, id_col: str, text_col: str, sample_pages: int = SAMPLE_PAGES) -> LineModel:
    """Trains on the ``sample_pages`` non-blank pages whose hashed id is least."""
    pages = df.where(F.col(text_col).rlike(r"\S") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = least_hashed(pages, ["id"], sample_pages).groupBy("id").agg(F.max("t").alias("t")).collect()
    return train([r.t for r in sorted(rows, key=lambda r: r.id)])


def page_shares(df: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prose, link_list, tag_list, menu): shares of each text's characters.

    Null, empty and blank texts have shares 0. Every row of ``df`` comes out once, repeated
    ids too; whole texts are read; other columns are not.
    """
    ship_package(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    weight = (model.start, model.move, model.show)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LineModel(*weight)
        for pdf in batches:
            got = [shares(m, t) if isinstance(t, str) else (0.0,) * 4 for t in pdf.iloc[:, 1]]
            yield pd.DataFrame({"id": pdf.iloc[:, 0].to_numpy(), **{name: [g[k] for g in got] for k, name in enumerate(LABELS)}})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, {', '.join(f'{x} double' for x in LABELS)}").withColumnRenamed("id", id_col)


def spam_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Ids (not null, distinct) of pages with more than ``least`` of their characters outside prose."""
    model = fit(df, id_col, text_col, sample_pages)
    got = page_shares(df, model, id_col, text_col)
    return got.where((F.col("link_list") + F.col("tag_list") + F.col("menu") > least) & F.col(id_col).isNotNull()).select(id_col).distinct()
