"""Problem 7: encoding of a whole corpus by byte-level BPE over a trie of its words.

The last token of every prefix of a word settles the encoding of that prefix: the encoding
of ``w[:i]`` is that of ``w[:i-len(t)]`` followed by its last token ``t``. So the distinct
words of a batch, in byte order, are walked as a depth-first traversal of their trie with a
stack of last tokens, and a prefix that words share is worked out once. Whether ``t`` may
follow the last token ``s`` of the shorter prefix is answered by undoing merges from the
two sides of the seam: the pair stands if no merge that spans the seam would have been made
before the merges that built ``s`` and ``t``.

The rows never leave their partition, so there is no shuffle; a worker keeps the encodings
of words between batches, up to ``WORDS_KEPT`` of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.sources.tables import ship_package, tokenizer_path

# Fixed value: the split pattern of the byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same on ASCII texts, for the faster matcher; its white space leaves out the separators 1c to 1f.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"
WORDS_KEPT = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieEncoder:
    """Encodes distinct words; ``file`` is a byte-level BPE in the JSON form."""

    def __init__(self, file: str):
        import regex

        model = json.load(open(file, encoding="utf-8"))["model"]
        letters = _byte_letters()
        as_bytes = {word: bytes(letters[c] for c in word) for word in model["vocab"] if all(c in letters for c in word)}
        self.token = {as_bytes[word]: k for word, k in model["vocab"].items() if word in as_bytes}
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for order, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = as_bytes[a], as_bytes[b]
            whole = self.token[a + b]
            self.joined[self.token[a], self.token[b]] = (order, whole)
            self.parts.setdefault(whole, (order, self.token[a], self.token[b]))
        self.ends = {word[k:] for word in self.token for k in range(len(word))}
        by_any, by_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.split = lambda text: by_ascii(text) if text.isascii() else by_any(text)
        self.known: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def follows(self, s: int, t: int) -> bool:
        """Whether the encoding of the two tokens' bytes keeps the seam between them."""
        key = (s, t)
        if key in self.fits:
            return self.fits[key]
        answer, bound = True, 1 << 60
        left, right = s, t
        while True:
            merge = self.joined.get((left, right))
            if merge and merge[0] < bound:
                answer = False
                break
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                break
            # The later of the two merges is undone first. At one and the same merge the left one was made first.
            if b is None or (a is not None and a[0] > b[0]):
                bound, left = a[0], a[2]
            else:
                bound, right = b[0] + 1, b[1]
        self.fits[key] = answer
        return answer

    def learn(self, words: set[str]) -> None:
        """Encodes the words that aren't known, in one traversal of their trie."""
        new = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words if w not in self.known)
        token, ends, follows = self.token.get, self.ends, self.follows
        before = b""
        last, back = [-1], [0]  # of each prefix of the present path: its last token, and that token's length
        for raw, word in new:
            shared = 0
            most = min(len(before), len(raw))
            while shared < most and before[shared] == raw[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                start = end - 1
                while start and raw[start - 1 : end] in ends:
                    start -= 1
                for at in range(start, end):  # the longest that may stand last
                    t = token(raw[at:end])
                    if t is not None and (at == 0 or follows(last[at], t)):
                        last.append(t)
                        back.append(end - at)
                        break
            out, at = [], len(raw)
            while at:
                out.append(last[at])
                at -= back[at]
            self.known[word] = tuple(reversed(out))
            before = raw

    def encode(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
            self.fits.clear()
        words = [self.split(t) if t else [] for t in texts]
        fresh = set(chain.from_iterable(words)).difference(self.known)
        if fresh:
            self.learn(fresh)
        return words


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(file: str) -> TrieEncoder:
    if file not in _ENCODERS:
        _ENCODERS[file] = TrieEncoder(file)
    return _ENCODERS[file]


def encode_corpus(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """One row per input row: the id and ``ids array<int>``, without special tokens.

    An empty and a null text give an empty list; rows with the same text or id are encoded
    as often as they occur; an empty table gives no rows; other columns are not read.
    The vocabulary is public and of fixed size; each worker reads its file.
    """
    ship_package(df.sparkSession)
    file = tokenizer_path(tokenizer, folder)
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(file)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words = e.encode(part.column(1).to_pylist())
                known = e.known
                codes = [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in words]
                ends = np.cumsum([0, *map(len, codes)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(codes), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """The kept columns and ``tokens bigint``, the length of each text's encoding (0 for null and empty)."""
    ship_package(df.sparkSession)
    file = tokenizer_path(tokenizer, folder)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(file)
        for batch in batches:
            lengths: list[int] = []
            for at in range(0, batch.num_rows, 512):
                words = e.encode(batch.column(batch.num_columns - 1).slice(at, 512).to_pylist())
                size = {w: len(e.known[w]) for w in set(chain.from_iterable(words))}
                lengths += [sum([size[w] for w in ws]) for ws in words]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(lengths, pa.int64())], names=[*keep, "tokens"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{fields}, tokens bigint")
