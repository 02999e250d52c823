"""Problem 3: repair of texts read from scanned pages.

Running headers are lines like titles at page edges that come back, fuzzily, within a text or at
the edges of other texts of the same source. A page's edge is the beginning or end of a text, a
neighbour of a page number, or a place where the line breaks a sentence in two. Page numbers
are lines of a number in its usual dress, or bare numbers that stand apart and count up. Both
are taken out. Then the lines of a paragraph are joined: a word broken at a line end is put
together where the corpus knows it so, and keeps its hyphen where the corpus knows the
compound. Last, a word that the corpus hardly knows is replaced by one that it knows well and
that scanning confuses with it. The corpus vocabulary is counted over all texts, in a
count-min sketch that is widened until a quarter of its places are used, up to 64 MB. In one that is
fuller than that, what most places have by chance is taken off every count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.functions.text import normalize_source
from quillfold.llm.sketch import hashed_counts
from quillfold.sources.tables import ship_package, stored

BINS, MOST_BINS = 1 << 20, 1 << 23  # of each of the two rows of the sketch
FULL = 0.25  # of the places, from which a sketch is widened
TEXTS, SHARE = 3, 0.3  # of a source that have a line at an edge, from which it is a running header
ENOUGH = 1e-6  # of all words: what a form takes to be known well; no limit is a count, so that a larger corpus of the same kind is judged alike
NOISE = ("hyphenation", "misread", "header", "page_number")

HYPHENS = "-\u00ad\u2010\u2011\u00ac"
LETTER = r"[^\W\d_]"
WORDS = re.compile(rf"{LETTER}+(?:['’-]{LETTER}+)*")
BROKEN = re.compile(rf"({LETTER}[^\s]*?|{LETTER})[{HYPHENS}][ \t]*$")
LEADING = re.compile(rf"^[ \t]*([^\s]*{LETTER}[^\s]*)")
ROMAN = r"(?=[ivxlc])c{0,3}(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})"
PAGE = re.compile(rf"^[\W_]*(?:p[a-z@0]{{0,3}}[.:]?\s*|seite\s*|página\s*|第\s*)?(\d{{1,4}}|{ROMAN})(?:\s*(?:of|von|de|sur|/)\s*\d{{1,4}})?[\W_页]*$", re.I)
IN_TAIL = re.compile(rf"(?:^|\s)(\d{{1,4}}|{ROMAN})(?:\s*(?:of|von|de|sur|/)\s*\d{{1,4}})?\W*$", re.I)
IN_HEAD = re.compile(rf"^\W*(?:p\w{{0,3}}\.?\s*)?(\d{{1,4}}|{ROMAN})(?=\W)", re.I)
BARE = re.compile(rf"^\s*(?:\d{{1,4}}|{ROMAN})\s*$", re.I)
ENTRY = re.compile(r"(?:[-*•]|\d+[.)])\s")
RAW = re.compile(r"[^\s,;:()\[\]{}\"“”„«»<>|/]+")

# Shapes that scanning takes for one another (read, meant).
CONFUSED = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("@", "a"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("$", "s"), ("‡", "t"), ("†", "t"), ("€", "e"), ("£", "e"), ("¢", "c"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("q", "g"), ("g", "q"), ("n", "u"), ("u", "n"), ("v", "y"), ("l", "t"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("nn", "m"), ("in", "m"), ("ni", "m"), ("tl", "d"),
)
SIGNS = {"0": "o", "1": "l", "5": "s", "@": "a", "!": "i", "‡": "t", "†": "t", "$": "s", "|": "l"}


def _places(word: str, bins: int = BINS) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(word)
    return h & (bins - 1), bins + ((h >> 32) & (bins - 1))


def _vocabulary_places(pdf: pd.DataFrame, bins: int = BINS) -> np.ndarray:
    seen: Counter[str] = Counter()
    for text in pdf.iloc[:, 0]:
        if isinstance(text, str):
            lines = text.lower().splitlines()
            for k, line in enumerate(lines):
                words = WORDS.findall(line)
                if k + 1 < len(lines) and words and line.rstrip()[-1:] in HYPHENS:
                    words.pop()  # the first half of a broken word
                if k and words and lines[k - 1].rstrip()[-1:] in HYPHENS:
                    words = words[1:]
                seen.update(words)
    if not seen:
        return np.zeros((2, 0), dtype=np.int64)
    at = np.array([_places(w, bins) for w in seen], dtype=np.int64)
    counts = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
    return np.stack([np.concatenate([at[:, 0], at[:, 1]]), np.concatenate([counts, counts])])


class Vocabulary:
    def __init__(self, counts: np.ndarray):
        self.counts, self.bins = counts, len(counts) // 2
        self.enough = max(1.0, ENOUGH * int(counts[: self.bins].sum(dtype=np.uint64)))
        # What a place has by chance: both rows exceed it in one of twenty words that never occur.
        at = int(0.78 * self.bins)
        self.chance = min(int(np.partition(row, at)[at]) for row in (counts[: self.bins], counts[self.bins :]))
        self.seen: dict[str, int] = {}
        self.meant: dict[str, str | None] = {}

    def count(self, word: str) -> int:
        n = self.seen.get(word)
        if n is None:
            a, b = _places(word, self.bins)
            n = self.seen[word] = max(0, int(min(self.counts[a], self.counts[b])) - self.chance)
            if len(self.seen) > 500_000:
                self.seen.clear()
                self.meant.clear()
        return n

    def repaired(self, word: str) -> str | None:
        """What a word (lower case) is a misreading of, if it is one."""
        if word in self.meant:
            return self.meant[word]
        self.meant[word] = found = self._search(word)
        return found

    def _search(self, word: str) -> str | None:
        if len(word) < 3 or len(word) > 40:
            return None
        odd = any(not (c.isalpha() or c in "-'’") for c in word)
        if odd and sum(c.isalpha() for c in word) < 2:
            return None
        own = 0 if odd else self.count(word)
        best, most = None, max(self.enough, 40 * own) if len(word) > 3 else max(10 * self.enough, 400 * own)
        tried = set()
        for read, meant in CONFUSED:
            at = word.find(read)
            while at >= 0:
                tried.add(word[:at] + meant + word[at + len(read) :])
                at = word.find(read, at + 1)
        if odd:
            plain = "".join(SIGNS.get(c, c) for c in word)
            tried |= {plain}
            for read, meant in CONFUSED:
                at = plain.find(read)
                if at >= 0:
                    tried.add(plain[:at] + meant + plain[at + len(read) :])
        for other in tried:
            if other.replace("-", "").replace("'", "").replace("’", "").isalpha():
                n = self.count(other)
                if n >= most:
                    best, most = other, n + 1
        return best


def _line_key(line: str) -> str:
    """A line without its dress, for comparing headers."""
    return re.sub(r"[^a-zà-ÿ一-鿿]+", " ", "".join(SIGNS.get(c, c) for c in line.lower())).strip()


def _like_title(bare: str) -> bool:
    """Begins with a capital (or a script without them), and half its words do or it is all capitals."""
    first = next((c for c in bare if c.isalpha()), "")
    if not first or first.islower() or "," in bare or ". " in re.sub(r"\b(?:Rev|No|Vol|[Pp])\. ", "", bare):
        return False
    words = [w for w in re.findall(r"[^\W\d_][\w@!‡-]*", bare) if len(w) > 1]
    return 2 * sum(not w[0].islower() for w in words) >= len(words)


def _title_key(line: str) -> str | None:
    """The key of a line that looks like a title."""
    bare = line.strip()
    if not 5 <= len(bare) <= 140 or bare[-1:] in ".,;:。，；" or bare[:1] in "#|`-*" or "(" in bare:
        return None
    key = _line_key(bare)
    return key if 5 <= len(key) <= 70 and not PAGE.match(bare) and _like_title(bare) else None


def page_edges(lines: list[str]) -> set[int]:
    """Lines that stand first or last, beside a page number, or within a sentence."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    out = set(full[:1] + full[-1:])
    for before, k, after in zip(full, full[1:], full[2:]):
        if PAGE.match(lines[before]) or PAGE.match(lines[after]):
            out.add(k)
            continue
        end, begin = lines[before].rstrip()[-1], lines[after].lstrip()[0]
        if end in HYPHENS or (end not in ".!?:;。！？：；" and not begin.isupper() and begin not in "#|`-*"):
            out.add(k)
    return out


FOLDS = str.maketrans("etlhqnv", "cfibguy")  # letters that scanning takes for one another, as one


def folded(key: str) -> str:
    """A title's key with the letters that scanning confuses made one, to be equal across texts."""
    return key.replace("rn", "m").replace("vv", "w").replace("cl", "d").translate(FOLDS)


def edge_titles(text: str) -> set[str]:
    """The folded keys of the titles at page edges."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return {folded(key) for k in page_edges(lines) if (key := _title_key(lines[k]))}


def header_lines(lines: list[str], known: frozenset[str] = frozenset()) -> tuple[set[int], bool]:
    """Running headers, and whether a page number stands in them: a last or first number that isn't
    the same throughout. ``known`` has the folded keys of the headers of other texts of the source."""
    groups: dict[str, list[int]] = {}
    for k, line in enumerate(lines):
        key = _title_key(line)
        if key:
            groups.setdefault(key, []).append(k)
    # Keys that are nearly equal are one; only keys of nearly the same length are compared.
    merged: list[tuple[str, set[str], list[int]]] = []
    by_length: dict[int, list[int]] = {}
    for key, at in groups.items():
        parts = {key[j : j + 3] for j in range(len(key) - 2)}
        for g in [g for n in range(len(key) - 3, len(key) + 4) for g in by_length.get(n, ())]:
            first, of_first, has = merged[g]
            if 3 * len(parts & of_first) >= len(parts) and SequenceMatcher(None, first, key, autojunk=False).ratio() >= 0.85:
                has += at
                break
        else:
            by_length.setdefault(len(key), []).append(len(merged))
            merged.append((key, parts, list(at)))
    edge = page_edges(lines)
    found: set[int] = set()
    numbered = False
    for key, _, at in merged:
        at.sort()
        here = set(at)
        text = len(at) > 1 and any(k not in here and len(lines[k].strip()) > 20 for k in range(at[0], at[-1]))
        if text and here & edge and all(b - a > 1 for a, b in zip(at, at[1:])):
            found |= here
            for place in (IN_TAIL, IN_HEAD):
                numbers = [m.group(1) if (m := place.search(lines[k].strip())) else None for k in at]
                numbered |= None not in numbers and len(set(numbers)) > 1
        elif known and folded(key) in known:
            found |= here & edge
    return found, numbered


def _number(text: str) -> int:
    if text.isdigit():
        return int(text)
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in text.lower()]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))


def page_lines(lines: list[str]) -> set[int]:
    full = [k for k, x in enumerate(lines) if x.strip()]
    dressed, bare = [], []
    for place, k in enumerate(full):
        m = PAGE.match(lines[k])
        if not m or len(lines[k].strip()) > 24 or lines[k].rstrip()[-1:] in ".,;:)%":
            continue
        if not BARE.match(lines[k]):
            dressed.append(k)
            continue
        near = [lines[full[p]] for p in (place - 1, place + 1) if 0 <= p < len(full)]
        before = lines[full[place - 1]].rstrip() if place else ""
        if not any(BARE.match(x) for x in near) and not before.endswith(":"):
            bare.append((k, _number(m.group(1))))
    for (_, a), (_, b) in zip(bare, bare[1:]):
        if b - a != 1:
            bare = []
            break
    return set(dressed) | {k for k, _ in bare}


def repair(text: str, known: Vocabulary, headers: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """The text in continuous paragraphs, and the kinds of noise that it had; ``headers`` are those of its source."""
    noise: set[str] = set()
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    (heads, numbered), pages = header_lines(lines, headers), page_lines(lines)
    if heads:
        noise.add("header")
    if pages or numbered:
        noise.add("page_number")
    for k in heads:
        for token in RAW.findall(lines[k]):
            if _misread(token, known):
                noise.add("misread")
    kept = [x for k, x in enumerate(lines) if k not in heads and k not in pages]
    out: list[str] = []  # paragraphs
    now = ""
    for place, line in enumerate(kept):
        body = line.strip(" \t")
        if not body:
            if BROKEN.search(now) and place + 1 < len(kept):
                continue
            if now:
                out.append(now)
            now = ""
            continue
        if not now:
            now = body
            continue
        if body[:1] in "|#`*•" or (ENTRY.match(body) and now[-1] in ".:;!?。；：！？") or now[-1:] == ":" or now.startswith(("|", "#", "```")):
            now += "\n" + body
            continue
        broken, after = BROKEN.search(now.rsplit("\n", 1)[-1]), LEADING.match(body)
        if broken and after:
            joined, whole, is_noise = _rejoin(broken.group(1), after.group(1), known)
            if joined:
                if is_noise:
                    noise.add("hyphenation")
                now = BROKEN.sub("", now) + whole + body[after.end() :]
                continue
        now += ("" if "一" <= now[-1] <= "鿿" and "一" <= body[0] <= "鿿" else " ") + body
    if now:
        out.append(now)
    fixed = []
    for paragraph in out:
        for token in {t for t in RAW.findall(paragraph)}:
            right = _misread(token, known)
            if right:
                noise.add("misread")
                paragraph = re.sub(rf"(?<![\w]){re.escape(token)}(?![\w])", lambda _, r=right: r, paragraph)
        fixed.append(paragraph)
    return "\n\n".join(fixed), sorted(noise)


CODE = re.compile(r"^[A-Z]{2,}-?\d|^\d+[A-Za-z]?$|^[A-Za-z]{1,3}\d+(?:\.\d+)*$|://|^#|\(")


def _misread(token: str, known: Vocabulary) -> str | None:
    """The right form of a token as it stands in a text, or None."""
    core = token.strip(".'’?-…*_~`")
    if token[-1] in HYPHENS:
        return None  # half a word
    if len(core) < 3 or CODE.search(core) or sum(c.isalpha() for c in core) < (2 if core.isalpha() else 3) or "一" <= core[0] <= "鿿":
        return None
    low = core.lower()
    right = known.repaired(low)
    if right is None or (low[-1] == "!" and 40 * known.count(low[:-1]) > known.count(right)):
        return None  # not a misreading, or a word with its exclamation mark
    if core.isupper():
        right = right.upper()
    elif core[0].isupper() or (not core[0].isalpha() and core[1:2].isupper()):
        right = right[0].upper() + right[1:]
    return token.replace(core, right)


def _rejoin(left: str, right: str, known: Vocabulary) -> tuple[bool, str, bool]:
    """(whether the two parts belong together, how, whether the break is noise)."""
    a = re.sub(r"^\W+", "", left)
    tail = re.search(r"[^\w]*$", right).group(0)
    b = right[: len(right) - len(tail)] if tail else right
    if not a or not b or not b[0].isalpha():
        return False, "", False
    low_a, low_b = a.lower(), b.lower()
    first = re.split(r"['’-]", low_b)[0]
    lead = low_a.split("-")[-1] if "-" in low_a else low_a
    solid, hyphened = known.count(low_a + low_b), known.count(f"{low_a}-{low_b}")
    if "-" in low_a or "-" in low_b:
        solid = max(solid, known.count(lead + first) if lead + first != low_a + low_b else 0)
    if hyphened > solid:
        return True, f"{left}-{right}", False
    if solid > 0 and solid >= hyphened:
        return True, left + right, True
    fixed = known.repaired(low_a + low_b)
    fixed_compound = known.repaired(f"{low_a}-{low_b}")
    if fixed and not fixed_compound:
        return True, left + right, True
    if fixed_compound or b[0].isupper():
        return True, f"{left}-{right}", False
    both = known.count(low_a) > known.enough and known.count(first) > known.enough
    return True, (f"{left}-{right}" if both else left + right), not both


def vocabulary(df: DataFrame, text_col: str = "content") -> np.ndarray:
    """Counts of the lower-cased words of all texts; half words at line ends are left out."""
    bins = BINS
    while True:
        counts = hashed_counts(df.select(F.col(text_col)), lambda pdf, n=bins: _vocabulary_places(pdf, n), 2 * bins)
        if bins >= MOST_BINS or np.count_nonzero(counts[:bins]) < FULL * bins:
            return counts
        bins = min(4 * bins, MOST_BINS)


def running_headers(df: DataFrame, source_col: str = "source", text_col: str = "content") -> DataFrame:
    """(src, heads array<string>): titles that stand at page edges in ``TEXTS`` or more texts of a source, and in a
    share of ``SHARE`` of them, so that a source has a handful at most. Counted over all rows by partial aggregation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(s, h) for s, t in zip(pdf["src"], pdf["t"]) if isinstance(t, str) for h in ["", *edge_titles(t)]]
            yield pd.DataFrame(out, columns=["src", "head"], dtype="str")

    texts = df.where(F.col(source_col).isNotNull() & F.col(text_col).isNotNull()).select(normalize_source(F.trim(source_col)).alias("src"), F.col(text_col).alias("t"))
    counted = texts.mapInPandas(run, "src string, head string").groupBy("src", "head").agg(F.count("*").alias("n"))
    of = counted.groupBy("src").agg(F.max(F.when(F.col("head") == "", F.col("n"))).alias("texts"))
    often = counted.where((F.col("head") != "") & (F.col("n") >= TEXTS)).join(of, "src").where(F.col("n") >= SHARE * F.col("texts"))
    return often.groupBy("src").agg(F.sort_array(F.collect_list("head")).alias("heads"))


def repair_scans(df: DataFrame, counts: np.ndarray, id_col: str = "id", text_col: str = "content", source_col: str = "source") -> DataFrame:
    """(id, repaired string, noise array<string>) of each row of ``df``.

    A null text gives a null text and no noise, a blank one an empty text. Repeated rows come
    out as often as they went in. Texts are read whole. The counts have a bounded size of 64 MB.
    Where ``df`` has the column of sources, headers are also told from the other texts of a source; a
    null source has none.
    """
    spark = df.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(counts)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), (normalize_source(F.trim(source_col)) if source_col in df.columns else F.lit(None).cast("string")).alias("src"))
    if source_col in df.columns:
        heads = stored(running_headers(df, source_col, text_col), "heads")
        few = heads.count() <= 20_000  # of at most some hundred bytes each
        rows = rows.join(F.broadcast(heads) if few else heads, "src", "left")
    else:
        rows = rows.withColumn("heads", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Vocabulary(sent.value)
        for pdf in batches:
            got = [repair(t, known, frozenset() if h is None else frozenset(h)) if isinstance(t, str) else (None, []) for t, h in zip(pdf["t"], pdf["heads"])]
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "repaired": [g[0] for g in got], "noise": [g[1] for g in got]})

    return rows.select("id", "t", "heads").mapInPandas(run, f"id {kind}, repaired string, noise array<string>").withColumnRenamed("id", id_col)
