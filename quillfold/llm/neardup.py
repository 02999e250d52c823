"""Problem 1: pairs and groups of nearly equal texts by pigeonring filtering of shingle sets.

Two texts are similar if at least half of all their distinct shingles occur in both, that is,
if the Hamming distance of their shingle sets is at most a third of the sum of their sizes.

1. Texts with one and the same shingle set form a class and are compared once.
2. Shingles are ordered by how often they occur, rare ones first. Similar sets of sizes a and b
   have so much in common that the first ``a - ceil(a/2) + m + 1`` shingles of the one and the
   corresponding ones of the other share ``m + 1``.
3. The shingles are dealt to a ring of m segments. With m + 1 common ones on the ring there is,
   by the pigeonring principle, a segment from which every chain of n consecutive segments
   holds n + 1 or more of them. Its first segment alone holds two: so two sets can only be
   similar if they share a pair of shingles in one segment, and pairs are the signatures.
   Segments grow in number with the size of a set, and sets of a few shingles use single ones.
4. Where two sets meet they are pruned by their differences: a sketch that travels with the set
   has 8 segments of another ring, and in each the parity of the shingles on each of its
   places, so that the differing places of two sketches are never more than the differing
   shingles. A pair stays if the ring has a segment from which all chains of n segments differ
   by at most n/8 of the budget.
5. What is left is decided by the whole Hamming distance.

Signatures are dealt to tasks by their rarer shingle. One that very many sets have, a passage
that a third of all texts share, say, is counted beforehand and its sets are dealt to sub-blocks:
every two sub-blocks meet in a task of their own, so that no task holds more than a bounded number of sets of it.

No step loses a similar pair; shingles are compared by 32-bit hashes (a pair of texts of 100
shingles has a false match in one of about 400,000 cases).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.sketch import hashed_counts
from quillfold.sources.tables import discard, ship_package, shuffle_partitions, stored

BITS = 24  # the frequency sketch has 2**24 places
SEGMENTS = 12  # of the ring of sets of up to 256 shingles; more for larger ones
CLASSES_A_PART = 8_000
HOT = 20_000  # sets of one signature that are compared in one task
HOT_BITS = 20  # signatures of frequent shingles are counted on 2**20 places
COPIES_EXPANDED = 1000  # exact copies of a text that are paired with one another

_K = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _K[0]
    x = x ^ (x >> np.uint64(29))
    x = x * _K[1]
    return x ^ (x >> np.uint64(32))


def _letter_table() -> np.ndarray:
    """0 for what separates words, else the lower-cased letter; characters of the Chinese block are words alone."""
    t = np.zeros(128, dtype=np.uint32)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789_":
        t[ord(c)] = ord(c)
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        t[ord(c)] = ord(c.lower())
    return t


_LETTERS = _letter_table()


def shingle_sets(texts: list[str | None], words: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint64, ends): the distinct shingles of all texts, text by text in ascending order.

    Words are the lower-cased runs of ASCII letters, digits and ``_``, and each character
    U+4E00..U+9FFF. A null text and one of fewer words have no shingles.
    """
    whole = "\n".join([t or "" for t in texts]) + "\n"
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
    letter = np.where(code < 128, _LETTERS[np.minimum(code, 127)], 0)
    cjk = (code >= 0x4E00) & (code <= 0x9FFF)
    run = letter > 0
    begins = cjk | (run & ~np.concatenate([[False], run[:-1]]))
    start = np.flatnonzero(begins)
    ends = np.zeros(len(texts), dtype=np.int64)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), ends
    with np.errstate(over="ignore"):
        value = np.where(cjk, code, letter).astype(np.uint64)
        used = np.flatnonzero(run | cjk)
        word = np.cumsum(begins)[used] - 1
        place = (used - start[word]).astype(np.uint64)
        parts = _mix(value[used] + place * _K[2] + _K[3])
        w = _mix(np.add.reduceat(parts, np.searchsorted(word, np.arange(len(start)))))
        doc = np.searchsorted(np.cumsum(lengths), start, side="right")
        n = len(w) - words + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), ends
        h = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            h = _mix(h * _K[4] + w[k : k + n] + np.uint64(k))
    same = doc[:n] == doc[words - 1 :]
    h, doc = h[same], doc[:n][same]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, dtype=bool)
    h, doc = h[new], doc[new]
    return h, np.cumsum(np.bincount(doc, minlength=len(texts)))


def _classes(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """Keys with the class of their set; the set itself with the first of its class in a partition."""
    seen: set[int] = set()
    for pdf in batches:
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            h, ends = shingle_sets([t if isinstance(t, str) else None for t in part["content"]], words)
            sizes = np.diff(np.concatenate([[0], ends]))
            keep = np.flatnonzero(sizes)
            if not len(keep):
                continue
            with np.errstate(over="ignore"):
                total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(h + _K[2]), dtype=np.uint64)])
                cls = _mix((total[ends] - total[ends - sizes]) + sizes.astype(np.uint64) * _K[3]).view(np.int64)[keep]
            short = (h >> np.uint64(32)).astype(np.uint32)
            sets = []
            for c, k in zip(cls.tolist(), keep.tolist()):
                if c in seen:
                    sets.append(None)
                else:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    sets.append(np.unique(short[ends[k] - sizes[k] : ends[k]]).tobytes())
            yield pd.DataFrame({"rel": part["rel"].to_numpy()[keep], "grp": part["grp"].to_numpy()[keep], "key": part["key"].to_numpy()[keep], "txt": part["txt"].to_numpy()[keep], "cls": cls, "toks": sets})


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each class of a partition that is sorted by class and holds all rows of it."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cls = batch.column(0).to_numpy()
        new = np.concatenate([[cls[0] != last], cls[1:] != cls[:-1]])
        last = cls[-1]
        if new.any():
            yield batch.filter(pa.array(new))


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of classes: all shingles, the row of each, and the sizes."""
    sizes = pdf["toks"].str.len().to_numpy() // 4
    toks = np.frombuffer(b"".join(pdf["toks"]), dtype=np.uint32)
    return toks, np.repeat(np.arange(len(pdf)), sizes), sizes


def _levels(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """(level, which sets, segments); two similar sets have a level in common.

    Similar sets of sizes a <= b have a >= b / 2 and share b / 2 shingles or more. A pair is met
    by single shingles if a <= 24 (so b <= 48), at level 0 if 25 <= a and b <= 256, and else at
    the level k with 128 * 2**k < b <= 256 * 2**k. At each the segments are fewer than what is shared.
    """
    yield -1, sizes <= 4 * SEGMENTS, 0
    yield 0, (sizes > 2 * SEGMENTS) & (sizes <= 256), SEGMENTS
    k, largest = 1, int(sizes.max(initial=0))
    while 128 << (k - 1) < largest:
        yield k, (sizes > 128 << (k - 1)) & (sizes <= 256 << k), 4 * SEGMENTS << (k - 1)
        k += 1


def signatures(toks: np.ndarray, row: np.ndarray, sizes: np.ndarray, often: np.ndarray, most: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature uint64, hash of its rarer shingle, row, whether both are in more than ``most`` sets) of all sets
    of a batch; ``often`` has the logarithmic frequency of each place."""
    freq = often[toks >> np.uint32(32 - BITS)]
    order = np.lexsort((toks, freq, row))
    toks, row, freq = toks[order], row[order], freq[order]
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(toks)) - begin[row]
    need = sizes - (sizes + 1) // 2 + 1
    out_s, out_f, out_r, out_h = [], [], [], []
    hot = freq > 8 * math.log2(most)
    for level, fit, m in _levels(sizes):
        # A shingle of a place that was counted once is in no other set.
        use = fit[row] & (freq > 0) & (place < (need + m)[row])
        t, r, h, f = toks[use].astype(np.uint64), row[use], hot[use], freq[use]
        with np.errstate(over="ignore"):
            if not m:
                out_s.append(_mix(t * _K[2] + _K[4]))
                out_f.append(_mix(t + _K[4]))
                out_r.append(r)
                out_h.append(h)
                continue
            seg = _mix(t + _K[3]) % np.uint64(m)
            by = np.lexsort((t, seg, r))
            t, r, seg, h, f = t[by], r[by], seg[by], h[by], f[by]
            group = r.astype(np.uint64) * np.uint64(m) + seg
            gap = 1
            while gap < len(t):
                same = np.flatnonzero(group[gap:] == group[:-gap])
                if not len(same):
                    break
                out_s.append(_mix(t[same] * _K[2] + t[same + gap] * _K[3] + np.uint64(level)))
                out_f.append(_mix(np.where(f[same] <= f[same + gap], t[same], t[same + gap]) + np.uint64(level)))
                out_r.append(r[same])
                out_h.append(h[same] & h[same + gap])
                gap += 1
    if not out_s:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    return np.concatenate(out_s), np.concatenate(out_f), np.concatenate(out_r), np.concatenate(out_h)


def sub_blocks(sig: np.ndarray, first: np.ndarray, at: np.ndarray, hot: np.ndarray, cls: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, what deals them and the marked numbers of their sets, with those of hot signatures once for
    every two sub-blocks of which one is their set's."""
    times = np.where(hot, splits[(first >> np.uint64(64 - HOT_BITS)).astype(np.int64)], 1).astype(np.int64)
    if times.max(initial=1) == 1:
        return sig, first, at
    which = np.repeat(np.arange(len(sig)), times)
    other = np.arange(len(which)) - (np.cumsum(times) - times)[which]
    with np.errstate(over="ignore"):
        own = (_mix(cls[at].view(np.uint64)) % times.astype(np.uint64)).astype(np.int64)[which]
        pair = (np.minimum(own, other) * 65_536 + np.maximum(own, other)).astype(np.uint64)
        split = times[which] > 1
        sig = np.where(split, _mix(sig[which] + pair * _K[3]), sig[which])
        first = np.where(split, _mix(first[which] + pair * _K[2]), first[which])
    mark = np.where(split & (own != other), CROSS, 0) | np.where(split & (own > other), SIDE, 0)
    return sig, first, at[which] | mark


def size_class(sizes: np.ndarray) -> np.ndarray:
    """0 for sets of up to 128 shingles, 1 up to 256, and so on to 5."""
    return np.clip(np.ceil(np.log2(np.maximum(sizes, 1) / 128)), 0, 5).astype(np.int64)


def sketches(toks: np.ndarray, row: np.ndarray, count: int, wide: int) -> np.ndarray:
    """count x 8 segments x ``wide`` words of 32 places: the parity of the shingles on each place."""
    with np.errstate(over="ignore"):
        h = _mix(toks.astype(np.uint64) + _K[4])
    place = (h >> np.uint64(3)).astype(np.int64) & (32 * wide - 1)
    at = ((row * 8 + (h & np.uint64(7)).astype(np.int64)) * 32 + (place & 31)) * wide + (place >> 5)
    odd = (np.bincount(at, minlength=count * 256 * wide) & 1).astype(np.uint8).reshape(count, 8, 32, wide)
    return np.packbits(odd.transpose(0, 1, 3, 2), axis=3, bitorder="little").view(np.uint32).reshape(count, 8, wide)


def folded(sketch: np.ndarray) -> np.ndarray:
    """The sketch that half as many places would have given."""
    half = sketch.shape[2] // 2
    return sketch[:, :, :half] ^ sketch[:, :, half:]


def pigeonring(differences: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Which rows of segment differences have a segment from which every chain of n consecutive
    segments of the ring (of m) differs by at most n/m of the budget."""
    m = differences.shape[1]
    some = np.flatnonzero(differences.sum(axis=1) <= budget)  # the chain all round is the same from everywhere
    d, b = differences[some].astype(np.int64), budget[some, None]
    alive, chain = np.ones(d.shape, dtype=bool), np.zeros(d.shape, dtype=np.int64)
    for n in range(1, m + 1):
        chain += np.roll(d, -(n - 1), axis=1)
        alive &= chain * m <= n * b
    out = np.zeros(len(differences), dtype=bool)
    out[some[alive.any(axis=1)]] = True
    return out


def _planes(x: np.ndarray) -> bytes:
    """Ascending numbers as compressed byte planes of their steps."""
    return zlib.compress(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1)


def _unplanes(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(width, -1).T).view(dtype)[:, 0], dtype=dtype)


def _hot_places(often_sent, most: int):
    """Of a batch of classes: the places of the first shingles of signatures that may be hot, once a set."""

    def run(pdf: pd.DataFrame) -> np.ndarray:
        often = often_sent.value
        out = []
        for start in range(0, len(pdf), BATCH):
            toks, row, sizes = _flat(pdf.iloc[start : start + BATCH])
            frequent = often[toks >> np.uint32(32 - BITS)] > 8 * math.log2(most)
            # Only a set whose rarest shingles aren't enough for its signatures has frequent ones there.
            rare = np.bincount(row[~frequent], minlength=len(sizes))
            reach = sizes - (sizes + 1) // 2 + 1 + np.where(sizes > 128, sizes, SEGMENTS)
            mine = np.flatnonzero(rare < reach)
            if not len(mine):
                continue
            use = np.isin(row, mine)
            _, first, r, hot = signatures(toks[use], np.searchsorted(mine, row[use]), sizes[mine], often, most)
            first, r = first[hot], r[hot]
            if len(r):
                out.append(np.unique((first >> np.uint64(64 - HOT_BITS)).astype(np.int64) * BATCH + r) // BATCH)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    return run


BATCH = 4000
CROSS, SIDE = 1 << 14, 1 << 15  # marks on a set's number: of a task of two sub-blocks, and in the second of them
_DEALT = "part int, sig binary, at binary, cls binary, size binary, sketch binary"


def _dealt(parts: int, often_sent, splits: np.ndarray, most: int):
    """Blocks of signatures for each part, with the class, size and sketch of each set once in a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = often_sent.value
        for pdf in batches:
            for start in range(0, len(pdf), BATCH):
                batch = pdf.iloc[start : start + BATCH]
                toks, row, sizes = _flat(batch)
                sig, first, r, hot = signatures(toks, row, sizes, often, most)
                if not len(sig):
                    continue
                cls = batch["cls"].to_numpy()
                sig, first, r = sub_blocks(sig, first, r, hot, cls, splits)
                raw: list[bytes] = [b""] * len(batch)
                of = size_class(sizes)
                for c in np.unique(of):
                    mine = np.flatnonzero(of == c)
                    new = np.full(len(batch), -1)
                    new[mine] = np.arange(len(mine))
                    use = of[row] == c
                    for k, x in zip(mine.tolist(), sketches(toks[use], new[row[use]], len(mine), 1 << int(c))):
                        raw[k] = x.tobytes()
                part = (first % np.uint64(parts)).astype(np.int32)
                short = (sig >> np.uint64(32)).astype(np.uint32)
                by = np.lexsort((short, part))
                part, short, r = part[by], short[by], r[by]
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                out = []
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
                    sets, at = np.unique(r[a:b] & (CROSS - 1), return_inverse=True)
                    out.append((part[a], _planes(short[a:b]), (at | (r[a:b] & (CROSS | SIDE))).astype(np.uint16).tobytes(), cls[sets].tobytes(), sizes[sets].astype(np.int32).tobytes(), b"".join([raw[k] for k in sets.tolist()])))
                yield pd.DataFrame(out, columns=["part", "sig", "at", "cls", "size", "sketch"])

    return run


class _Sets:
    """The sets that a part has, with their sketches by size class."""

    def __init__(self, cls: np.ndarray, sizes: np.ndarray, raw: list[tuple[np.ndarray, bytes]]):
        self.cls, self.sizes, self.of = cls, sizes, size_class(sizes)
        self.place = np.zeros(len(cls), dtype=np.int64)
        self.sketch: dict[int, np.ndarray] = {}
        pieces: dict[int, list[bytes]] = {}
        for of, data in raw:
            width = 32 << of
            stops = np.cumsum(width)
            for c in np.unique(of):
                mine = np.flatnonzero(of == c)
                pieces.setdefault(int(c), []).extend(data[stops[k] - width[k] : stops[k]] for k in mine.tolist())
        for c, got in pieces.items():
            self.sketch[c] = np.frombuffer(b"".join(got), dtype=np.uint32).reshape(len(got), 8, 1 << c)
            self.place[self.of == c] = np.arange(len(got))
        self.half = {c: folded(x) for c, x in self.sketch.items() if c}

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of sets pass the ring of differences."""
        keep = np.zeros(len(a), dtype=bool)
        budget = (self.sizes[a] + self.sizes[b]) // 3
        swap = self.of[a] > self.of[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        kind = self.of[a] * 8 + self.of[b]
        for k in np.unique(kind):
            here = np.flatnonzero(kind == k)
            ca, cb = int(k) // 8, int(k) % 8
            if cb - ca > 1:
                continue  # such sizes differ by more than half
            x, y = self.sketch[ca], self.sketch[cb] if ca == cb else self.half[cb]
            for at in range(0, len(here), 100_000):
                h = here[at : at + 100_000]
                d = np.bitwise_count(x[self.place[a[h]]] ^ y[self.place[b[h]]]).sum(axis=2, dtype=np.int32)
                keep[h] = pigeonring(d, budget[h])
        return keep


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of classes that share a signature and pass the ring, once for each part."""
    held: dict[int, list[tuple]] = {}
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            held.setdefault(r.part, []).append(r)
    for p in list(held):
        rows = held.pop(p)
        counts = [len(r.size) // 4 for r in rows]
        base = np.cumsum([0, *counts])
        sizes = np.frombuffer(b"".join([r.size for r in rows]), dtype=np.int32).astype(np.int64)
        raw = [(size_class(sizes[a:b]), r.sketch) for r, a, b in zip(rows, base, base[1:])]
        sets = _Sets(np.frombuffer(b"".join([r.cls for r in rows]), dtype=np.int64), sizes, raw)
        sig = np.concatenate([_unplanes(r.sig, np.uint32) for r in rows])
        marked = np.concatenate([np.frombuffer(r.at, dtype=np.uint16) for r in rows])
        at = (marked & (CROSS - 1)).astype(np.int64) + np.repeat(base[:-1], [len(r.at) // 2 for r in rows])
        del rows, raw
        order = np.argsort(sig, kind="stable")
        sig, at, marked = sig[order], at[order], marked[order]
        found: list[np.ndarray] = []
        kept, gap = 0, 1
        live = np.arange(len(sig))
        while True:
            live = live[live + gap < len(sig)]
            live = live[sig[live + gap] == sig[live]]
            if not len(live):
                break
            for k in range(0, len(live), 1_000_000):
                i = live[k : k + 1_000_000]
                a, b = at[i], at[i + gap]
                na, nb = sets.sizes[a], sets.sizes[b]
                ok = (2 * na >= nb) & (2 * nb >= na) & (sets.cls[a] != sets.cls[b])
                ok &= (marked[i] & CROSS == 0) | (marked[i] & SIDE != marked[i + gap] & SIDE)
                a, b = a[ok], b[ok]
                pair = np.unique(np.minimum(a, b) * len(sets.cls) + np.maximum(a, b))
                a, b = pair // len(sets.cls), pair % len(sets.cls)
                ok = sets.near(a, b)
                found.append(pair[ok])
                kept += int(ok.sum())
                if kept > 1_000_000:
                    found = [np.unique(np.concatenate(found))]
                    kept = len(found[0])
                    if kept > 500_000:
                        yield _pair_rows(sets.cls, found.pop())
                        kept = 0
            gap += 1
        if found:
            yield _pair_rows(sets.cls, np.unique(np.concatenate(found)))


def _pair_rows(cls: np.ndarray, pair: np.ndarray) -> pd.DataFrame:
    a, b = cls[pair // len(cls)], cls[pair % len(cls)]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _hamming(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The similar ones of rows (a, b, x, y) of two classes and their sets."""
    for pdf in batches:
        if not len(pdf):
            continue
        keep = np.zeros(len(pdf), dtype=bool)
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            na, nb = part["x"].str.len().to_numpy() // 4, part["y"].str.len().to_numpy() // 4
            pair = np.concatenate([np.repeat(np.arange(len(part)), na), np.repeat(np.arange(len(part)), nb)]).astype(np.uint64)
            t = np.frombuffer(b"".join(part["x"]) + b"".join(part["y"]), dtype=np.uint32).astype(np.uint64)
            both = np.sort((pair << np.uint64(32)) | t)
            twice = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
            common = np.bincount(twice.astype(np.int64), minlength=len(part))
            keep[at : at + len(part)] = 2 * common >= na + nb - common
        yield pdf.loc[keep, ["a", "b"]]


def classes_of(texts: DataFrame, words: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members rel, grp, key, txt, cls; classes cls, toks), both written to the shared folder; txt is a hash of the exact text."""
    spark = texts.sparkSession
    ship_package(spark)
    kinds = "rel string, grp string, key string, txt bigint, cls bigint, toks binary"
    rows = texts.select("rel", "grp", "key", "content").where("key is not null").withColumn("txt", F.xxhash64("content"))
    keyed = stored(rows.mapInPandas(lambda b: _classes(b, words), kinds), "dup-keys")
    sets = keyed.where("toks is not null").select("cls", "toks").repartition(shuffle_partitions(spark), "cls").sortWithinPartitions("cls")
    classes = stored(sets.mapInArrow(_firsts, "cls bigint, toks binary"), "dup-classes")
    members = stored(keyed.select("rel", "grp", "key", "txt", "cls").distinct(), "dup-members")
    discard(keyed)
    return members, classes


def similar_classes(classes: DataFrame, most: int = HOT) -> DataFrame:
    """(a, b), a < b: all pairs of similar classes, each once; a signature of more than ``most`` sets is split."""
    spark = classes.sparkSession
    total = classes.count()
    counts = hashed_counts(classes, lambda pdf: (_flat(pdf)[0] >> np.uint32(32 - BITS)).astype(np.int64), 1 << BITS)
    sent = spark.sparkContext.broadcast(np.minimum(255, np.round(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8))
    splits = np.ones(1 << HOT_BITS, dtype=np.uint16)
    if counts.max(initial=0) > most:
        splits = np.clip(-(-hashed_counts(classes, _hot_places(sent, most), 1 << HOT_BITS).astype(np.int64) // most), 1, 65_535).astype(np.uint16)
    parts = max(shuffle_partitions(spark), math.ceil(total / CLASSES_A_PART))
    dealt = classes.mapInPandas(_dealt(parts, sent, splits, most), _DEALT).repartitionById(parts, "part")
    met = stored(dealt.mapInPandas(_met, "a bigint, b bigint").distinct(), "dup-candidates")
    whole = met.join(classes.select(F.col("cls").alias("a"), F.col("toks").alias("x")), "a").join(classes.select(F.col("cls").alias("b"), F.col("toks").alias("y")), "b")
    return stored(whole.mapInPandas(_hamming, "a bigint, b bigint"), "dup-links")


def _across(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Links between what stands in the same group: ``left`` has (rel, grp, cls, u), ``right`` (rel, grp, cls, v)."""
    x = left.select("rel", "grp", F.col("cls").alias("a"), "u")
    y = right.select("rel", "grp", F.col("cls").alias("b"), "v")
    return links.join(x, "a").join(y, ["rel", "grp", "b"])


def similar_pairs(texts: DataFrame, words: int = 3) -> DataFrame:
    """(rel, key_a, key_b), key_a < key_b: pairs of keys of one rel and group with similar contents.

    ``texts`` has (rel, grp, key, content), no other columns are read. Null contents and keys,
    empty texts and those of fewer than ``words`` words take no part; repeated rows of a key
    count once; texts are compared whole; an empty table gives no rows. Every two different texts
    that are similar are paired, and so are exact copies, but where more than ``COPIES_EXPANDED``
    keys of a group have shingles in common and some of them one and the same text: these are paired
    with the least of them, which stands for them in all other pairs (``similar_groups`` has every key).
    """
    members, classes = classes_of(texts, words)
    links = similar_classes(classes)
    texts_of = members.groupBy("rel", "grp", "cls", "txt").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    sizes = texts_of.groupBy("rel", "grp", "cls").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    large = sizes.where(F.col("n") > COPIES_EXPANDED).select("rel", "grp", "cls")
    stars = texts_of.join(large, ["rel", "grp", "cls"]).select("rel", "grp", "cls", "txt", "least")
    joined = members.join(stars, ["rel", "grp", "cls", "txt"], "left")
    star = joined.where(F.col("least").isNotNull() & (F.col("key") > F.col("least"))).select("rel", F.col("least").alias("key_a"), F.col("key").alias("key_b"))
    usual = joined.where(F.col("least").isNull() | (F.col("key") == F.col("least"))).select("rel", "grp", "cls", "key")
    shared = sizes.where(F.col("n").between(2, COPIES_EXPANDED) | (F.col("texts") > 1)).select("rel", "grp", "cls")
    several = usual.join(shared, ["rel", "grp", "cls"], "left_semi")
    copies = several.alias("x").join(several.alias("y"), ["rel", "grp", "cls"]).where("x.key < y.key").select("rel", F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"))
    across = _across(links, usual.withColumnRenamed("key", "u"), usual.withColumnRenamed("key", "v")).where("u <> v").select("rel", F.least("u", "v").alias("key_a"), F.greatest("u", "v").alias("key_b"))
    return across.unionByName(copies).unionByName(star).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """One round towards components: every node's neighbours are tied to the least of them, the greater ones and then the lesser."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): the least node of the component of each node that isn't itself the least, from edges (u, v) of numbers.

    Alternating stars: a number of rounds that grows with the logarithm of the nodes, each a written
    table; an edge never meets more than the least neighbour of its node, so that no neighbourhood is collected.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "dup-star")
    before = mark(now)
    while True:
        now = stored(_stars(now), "dup-star")
        after = mark(now)
        if after == before:
            return now
        before = after


def similar_groups(texts: DataFrame, words: int = 3) -> DataFrame:
    """(rel, key, class_id, group_id, n_similar): a row for each key that has a similar one in its rel and group.

    ``class_id`` is the least key with the same shingles, ``group_id`` the least key of all that are
    tied by similar contents, directly or through others, and ``n_similar`` the number of other keys
    that are similar to this one. Keys are told apart within their rel. The rules for contents are those of
    ``similar_pairs``; copies of any number are rows here and never pairs.
    """
    members, classes = classes_of(texts, words)
    links = similar_classes(classes)
    of = stored(members.groupBy("rel", "grp", "cls").agg(F.countDistinct("key").alias("n"), F.min("key").alias("class_id")).withColumn("node", F.xxhash64("rel", "grp", "cls")), "dup-nodes")
    side = of.select("rel", "grp", "cls", F.struct("node", "n").alias("u"))
    tied = stored(_across(links, side, side.withColumnRenamed("u", "v")).select(F.col("u.node").alias("u"), F.col("u.n").alias("nu"), F.col("v.node").alias("v"), F.col("v.n").alias("nv")), "dup-ties")
    near = tied.select("u", F.col("nv").alias("n")).unionByName(tied.select(F.col("v").alias("u"), F.col("nu").alias("n"))).groupBy("u").agg(F.sum("n").alias("others"))
    roots = components(tied.select("u", "v")).select(F.col("u").alias("node"), F.col("v").alias("root"))
    placed = of.join(near.withColumnRenamed("u", "node"), "node", "left").join(roots, "node", "left").where("n > 1 or others is not null").withColumn("root", F.coalesce("root", "node"))
    first = placed.groupBy("root").agg(F.min("class_id").alias("group_id"))
    known = placed.join(first, "root").select("rel", "grp", "cls", "class_id", "group_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"))
    return members.select("rel", "grp", "cls", "key").distinct().join(known, ["rel", "grp", "cls"]).groupBy("rel", "key").agg(F.min("class_id").alias("class_id"), F.min("group_id").alias("group_id"), F.sum("n_similar").alias("n_similar"))
