"""Problem 5: the k most similar vectors of every vector by an inverted multi-index.

The vectors are scaled to length 1 and cut in two halves, and each half is quantised with
centroids of its own, so that pairs of centroids make up many small cells from few centroids.
A query walks the cells by the sum of its two squared distances with a frontier that holds the
best untried cell of every row of the grid (the multi-sequence walk, for a batch of queries at
once), and is compared with the vectors of each cell that it visits. The best of all cells
are reranked by their exact cosine.

Cells of one first-half centroid that lie next to one another in the other half are dealt to
blocks of some thousand vectors, so that a query travels once for each block that holds a
cell it visits, however many vectors a centroid has. A cell that is larger than a block is cut,
and its queries go to all parts of it. A block that very many queries visit, as the sample
has it, is given to several tasks, and each of these queries goes to one of them. Within a cell
both sides of a comparison learn of one another, so that a neighbour is missed only if neither
visits the other. Equal vectors are compared once: a group of copies travels as one vector
with its least ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.llm.sketch import hashed_counts, least_hashed
from quillfold.sources.tables import ship_package


SAMPLE_VECTORS = 20_000  # vectors that the centroids are fitted on
PER_CELL = 200  # vectors a cell should hold; the number of centroids follows from it
BLOCK = 6_000  # vectors of one centroid in one task
ASKING = 60_000  # queries of a block in one task, about
CENTROIDS = 4_000  # at most for a half
TASKS = 20_000  # at most for all blocks
EPS = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds; a centroid that no vector is nearest to moves to the worst placed one."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * (x @ c.T)
        near = d.argmin(1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        c[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0) / count[full, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):
            c[empty] = x[np.argsort(-d[np.arange(len(x)), near])[: len(empty)]]
    return c.astype(np.float32)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T), 0)


def walk(d1: np.ndarray, d2: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``cells`` cells of each query, as (first, second) centroid numbers, nearest first.

    Row r of the frontier stands for the r-th nearest first centroid and holds the distance of
    its next untried cell; the least of the frontier is taken and that row moves on.
    """
    n = len(d1)
    rows, cols = min(cells, d1.shape[1]), min(cells, d2.shape[1])
    o1 = np.argpartition(d1, rows - 1, axis=1)[:, :rows] if rows < d1.shape[1] else np.tile(np.arange(rows), (n, 1))
    o1 = np.take_along_axis(o1, np.take_along_axis(d1, o1, 1).argsort(1), 1)
    o2 = np.argpartition(d2, cols - 1, axis=1)[:, :cols] if cols < d2.shape[1] else np.tile(np.arange(cols), (n, 1))
    o2 = np.take_along_axis(o2, np.take_along_axis(d2, o2, 1).argsort(1), 1)
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    s2 = np.hstack([s2, np.full((n, 1), np.inf, dtype=s2.dtype)])
    cells = min(cells, rows * cols)
    at = np.zeros((n, rows), dtype=np.int64)
    frontier = s1 + s2[:, :1]
    every = np.arange(n)
    first, second = np.empty((n, cells), dtype=np.int32), np.empty((n, cells), dtype=np.int32)
    for step in range(cells):
        r = frontier.argmin(1)
        c = at[every, r]
        first[:, step], second[:, step] = o1[every, r], o2[every, c]
        at[every, r] = c + 1
        frontier[every, r] = s1[every, r] + s2[every, c + 1]
    return first, second


class MultiIndex:
    """Centroids of both halves, and where the vectors of each cell are compared.

    Cell c1 * len(second) + c2 lies in ``parts[cell]`` blocks from ``block[cell]`` on (no part: an
    empty cell), and block b in ``tasks[b]`` tasks from ``base[b]`` on.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.half = first.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second)

    def homes(self, x: np.ndarray) -> np.ndarray:
        first, second = walk(*self.distances(x), 1)
        return first[:, 0].astype(np.int64) * len(self.second) + second[:, 0]

    def deal(self, count: np.ndarray) -> None:
        """Blocks from the number of vectors of each cell."""
        count = count.astype(np.int64)
        whole = (count > 0) & (count <= BLOCK)
        grid = np.where(whole, count, 0).reshape(len(self.first), -1)
        before = (np.cumsum(grid, axis=1) - grid) // BLOCK
        owner = np.repeat(np.arange(len(self.first)), len(self.second))
        _, block = np.unique(owner[whole] * (int(before.max(initial=0)) + 1) + before.ravel()[whole], return_inverse=True)
        self.parts = np.where(whole, 1, -(-count // BLOCK)).astype(np.int32)
        self.block = np.zeros(len(count), dtype=np.int32)
        self.block[whole] = block
        large = np.flatnonzero(count > BLOCK)
        start = int(block.max(initial=-1)) + 1
        self.block[large] = start + np.cumsum(self.parts[large]) - self.parts[large]
        blocks = start + int(self.parts[large].sum())
        self.tasks = np.ones(max(blocks, 1), dtype=np.int32)
        self.number()

    def number(self) -> None:
        self.base = np.cumsum(self.tasks) - self.tasks

    def visits(self, x: np.ndarray, cells: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, second centroid) of what each vector visits, in the order of row and block."""
        d1, d2 = self.distances(x)
        first, second = walk(d1, d2, cells)
        every = np.arange(len(x))[:, None]
        reach = d1[every, first] + d2[every, second]
        cell = first.astype(np.int64) * len(self.second) + second
        row, k = np.nonzero((reach - reach[:, :1] <= stop) & (self.parts[cell] > 0))
        cell = cell[row, k]
        times = self.parts[cell]
        if times.max(initial=0) > 1:
            which = np.repeat(np.arange(len(cell)), times)
            block = self.block[cell[which]] + (np.arange(len(which)) - (np.cumsum(times) - times)[which])
            row, second = row[which], second[row, k][which]
        else:
            block, second = self.block[cell], second[row, k]
        order = np.lexsort((second, block, row))
        return row[order], block[order], second[order].astype(np.int32)


def _unit(values: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors as float32) of the usable entries: right length, finite, not all zero."""
    lists = values.tolist()
    keep = [k for k, v in enumerate(lists) if v is not None and len(v) == width]
    if not keep:
        return np.zeros(0, dtype=int), np.zeros((0, width), dtype=np.float32)
    x = np.array([lists[k] for k in keep], dtype=np.float64)
    n = np.sqrt((x * x).sum(1))
    ok = np.isfinite(n) & (n > 0)
    return np.array(keep)[ok], (x[ok] / n[ok, None]).astype(np.float32)


def _sizes(total: int) -> int:
    return max(1, min(CENTROIDS, round(math.sqrt(total / PER_CELL))))


def fit(vectors: DataFrame, total: int, width: int, sample: int = SAMPLE_VECTORS) -> tuple[MultiIndex, np.ndarray]:
    """(centroids, sample): from the ``sample`` vectors whose hashed id is least, at most ``CENTROIDS`` for a half.

    The second half's centroids are numbered along their main axis, so that neighbouring numbers are near.
    """
    few = least_hashed(vectors.select("id", "embedding").where(F.col("embedding").isNotNull()), ["id"], sample)
    rows = few.groupBy("id").agg(F.max("embedding").alias("embedding")).toPandas().sort_values("id")
    _, x = _unit(rows["embedding"], width)
    k = _sizes(total)
    if not len(x):
        return MultiIndex(np.zeros((1, width // 2), dtype=np.float32), np.zeros((1, width - width // 2), dtype=np.float32)), x
    half = width // 2
    second = kmeans(x[:, half:], k)
    axis = np.linalg.svd(second - second.mean(0), full_matrices=False)[2][0]
    return MultiIndex(kmeans(x[:, :half], k), second[np.argsort(second @ axis, kind="stable")]), x


_SENT = "t int, cell int, visits binary, vec binary, ids array<string>, own boolean, asks boolean"


def _keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit key of each vector's bytes."""
    raw = np.ascontiguousarray(x + 0.0).view(np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        mult = (np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        h = ((raw + np.uint64(0x632BE59BD9B4E019)) * mult)
        h ^= h >> np.uint64(29)
        h = (h * np.uint64(0xBF58476D1CE4E5B9)).sum(1, dtype=np.uint64)
        h ^= h >> np.uint64(32)
    return h


def _route(sent, width: int, cells: int, copies: int, stop: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: MultiIndex = sent.value
        for pdf in batches:
            where, x = _unit(pdf["embedding"], width)
            if not len(where):
                continue
            names = pdf["id"].to_numpy(dtype=object)[where]
            ask = pdf["ask"].to_numpy(dtype=bool)[where]
            # Equal vectors of the batch travel once, with their least ids.
            key = _keys(x)
            _, lead, group = np.unique(key, return_index=True, return_inverse=True)
            if len(lead) < len(key):
                members: list[set] = [set() for _ in lead]
                for g, name in zip(group, names):
                    members[g].add(name)
                ids = [sorted(m)[: copies + 1] for m in members]
                ask = np.bincount(group, weights=ask) > 0
                x, key = x[lead], key[lead]
            else:
                ids = [[name] for name in names]
            home = index.homes(x)
            parts = np.maximum(index.parts[home], 1)
            own_block = index.block[home] + (key % parts.astype(np.uint64)).astype(np.int64)
            asking = np.flatnonzero(ask)
            row, block, second = index.visits(x[asking], cells, stop)
            row = asking[row]
            cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.zeros(0, dtype=int)
            raw_cells = second.tobytes()
            stops = np.concatenate([cut[1:], [len(row)]]) if len(cut) else cut
            visits = [raw_cells[4 * a : 4 * b] for a, b in zip(cut.tolist(), stops.tolist())]
            to_r, to_b = row[cut], block[cut]
            to_t = index.base[to_b] + (key[to_r] % index.tasks[to_b].astype(np.uint64)).astype(np.int64)
            at = {(r, t): k for k, (r, t) in enumerate(zip(to_r.tolist(), to_t.tolist()))}
            cell, own = [-1] * len(visits), [False] * len(visits)
            row_of, task_of = to_r.tolist(), to_t.tolist()
            home_second = (home % len(index.second)).tolist()
            for r, b in enumerate(own_block.tolist()):
                for t in range(int(index.base[b]), int(index.base[b] + index.tasks[b])):
                    k = at.get((r, t))
                    if k is None:
                        row_of.append(r)
                        task_of.append(t)
                        visits.append(b"")
                        cell.append(home_second[r])
                        own.append(True)
                    else:
                        cell[k], own[k] = home_second[r], True
            raw = [v.tobytes() for v in x]
            yield pd.DataFrame({"t": task_of, "cell": cell, "visits": visits, "vec": [raw[r] for r in row_of], "ids": [ids[r] for r in row_of], "own": own, "asks": ask[row_of]})

    return run


def _best(rows: np.ndarray, cols: np.ndarray, cos: np.ndarray, k: int, cid: np.ndarray) -> np.ndarray:
    """Positions of the k best columns of each row, by cosine and then by the column's id."""
    order = np.lexsort((cid[cols], -cos, rows))
    r = rows[order]
    start = np.concatenate([[True], r[1:] != r[:-1]])
    begin = np.maximum.accumulate(np.where(start, np.arange(len(r)), 0))
    return order[np.arange(len(r)) - begin < k]


def _leading(s: np.ndarray, k: int) -> np.ndarray:
    """Marks the ``k`` largest of each row, the row's own vector not counted, and what ties with them."""
    if s.shape[1] <= k + 1:
        return np.ones(s.shape, dtype=bool)
    bound = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
    return s >= bound[:, None] - EPS


def _compare(width: int, k: int, least: float):
    """Within a task: every vector against those of the cells it visits, and the other way round."""

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["vec"]), dtype=np.float32).reshape(-1, width)
        key = _keys(x)
        names: dict[int, set] = {}
        for h, ids in zip(key.tolist(), pdf["ids"]):
            names.setdefault(h, set()).update(ids)
        # One row per distinct vector; its lists of cells are the same wherever it came from.
        asking = pdf["asks"].to_numpy(dtype=bool)
        order = np.lexsort((~asking, key))
        _, lead = np.unique(key[order], return_index=True)
        lead = order[lead]
        asking = asking[lead]
        own = pdf["own"].to_numpy()
        cell = pdf["cell"].to_numpy()
        visits = pdf["visits"].to_numpy()
        x, key, own, cell, visits = x[lead], key[lead], own[lead], cell[lead], visits[lead]
        ids = [sorted(names[h])[: k + 1] for h in key.tolist()]
        least_id = np.array([i[0] for i in ids], dtype=object)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[np.argsort(least_id)] = np.arange(len(ids))
        lists = [np.frombuffer(v, dtype=np.int32) for v in visits]
        asks = np.repeat(np.arange(len(x)), [len(v) for v in lists])
        asked = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32)
        by = np.argsort(asked, kind="stable")
        asks, asked = asks[by], asked[by]
        entries = np.flatnonzero(own)
        entries = entries[np.argsort(cell[entries], kind="stable")]
        got: list[tuple[np.ndarray, np.ndarray]] = []
        bounds = np.searchsorted(cell[entries], np.arange(cell.max(initial=-1) + 2))
        for c in np.unique(cell[entries]):
            e = entries[bounds[c] : bounds[c + 1]]
            q = asks[np.searchsorted(asked, c) : np.searchsorted(asked, c, side="right")]
            for at in range(0, len(q), 4096):
                part = q[at : at + 4096]
                s = x[part] @ x[e].T
                near = s >= least - EPS
                if np.count_nonzero(near) > 2 * k * sum(s.shape):
                    near &= _leading(s, k) | _leading(s.T, k).T
                i, j = np.nonzero(near)
                a, b = part[i], e[j]
                keep = a != b
                a, b = a[keep], b[keep]
                got.append((a, b))
        if not got:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        a, b = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        a, b = a[asking[a]], b[asking[a]]
        pairs = np.unique(a * np.int64(len(x)) + b)
        a, b = pairs // len(x), pairs % len(x)
        cos = np.minimum(np.einsum("ij,ij->i", x[a].astype(np.float64), x[b].astype(np.float64)), 1.0)
        ok = cos >= least
        a, b, cos = a[ok], b[ok], cos[ok]
        top = _best(a, b, cos, k, rank)
        out = [(ids[p][0], other, float(c)) for p, q_, c in zip(a[top].tolist(), b[top].tolist(), cos[top].tolist()) for other in ids[q_][:k]]
        return pd.DataFrame(out, columns=["a", "b", "cosine"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for pdf in batches:
            for t, rows in pdf.groupby("t", sort=False):
                held.setdefault(int(t), []).append(rows)
        for t in list(held):
            rows = held.pop(t)
            yield compared(pd.concat(rows, ignore_index=True))

    return run


def neighbours(vectors: DataFrame, k: int = 5, least: float = -1.0, cells: int = 24, stop: float = 2.0, width: int | None = None, sample: int = SAMPLE_VECTORS, share: float = 0.0) -> DataFrame:
    """(id, neighbour, cosine, rank from 1): up to ``k`` nearest others of each id, best first.

    ``vectors`` has (id string, embedding array). Ids that are null, and embeddings that are
    null, all zero, not finite or of another length than ``width`` (the most frequent length; of
    two, the greater) take no part; repeated rows of an id count once; ties go to the lesser id; pairs
    under the cosine ``least`` are left out. ``cells`` cells are visited, or that ``share`` of all cells if it is more, so that recall keeps up with a growing
    index; fewer where the next lies more than ``stop`` further than the nearest. Every vector is indexed; all are
    queries, or those with a true ``ask`` where there is such a column. The centroids are fitted on a bounded sample. An empty table gives no rows.
    """
    ask = F.coalesce(F.col("ask"), F.lit(False)) if "ask" in vectors.columns else F.lit(True)
    v = vectors.select(F.col("id").cast("string").alias("id"), "embedding", ask.alias("ask")).where("id is not null and embedding is not null")
    spark = v.sparkSession
    ship_package(spark)
    schema = "id string, neighbour string, cosine double, rank int"
    lengths = v.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).where("w > 0").orderBy(F.desc("n"), F.desc("w")) if width is None else v.where(F.size("embedding") == width).agg(F.lit(width).alias("w"), F.count("*").alias("n"))
    facts = lengths.first()
    if facts is None or not facts.n:
        return spark.createDataFrame([], schema)
    width = facts.w
    v = v.where(F.size("embedding") == width)
    index, seen = fit(v, facts.n, width, sample)
    cells = max(cells, math.ceil(share * len(index.first) * len(index.second)))

    def homes(pdf: pd.DataFrame) -> np.ndarray:
        _, x = _unit(pdf["embedding"], width)
        return index.homes(x) if len(x) else np.zeros(0, dtype=np.int64)

    index.deal(hashed_counts(v.select("embedding"), homes, len(index.first) * len(index.second)))
    if len(seen):
        row, block, _ = index.visits(seen, cells, stop)
        met = np.unique(row * len(index.tasks) + block) % len(index.tasks)
        index.tasks = np.maximum(1, np.round(np.bincount(met, minlength=len(index.tasks)) * (facts.n / len(seen)) / ASKING)).astype(np.int32)
        index.number()
    sent = spark.sparkContext.broadcast(index)
    routed = v.mapInPandas(_route(sent, width, cells, k, stop), _SENT).repartitionById(min(TASKS, int(index.tasks.sum())), "t")
    found = routed.mapInPandas(_compare(width, k, least), "a string, b string, cosine double").withColumnRenamed("b", "neighbour")
    # Equal vectors: their members ask through the least id of the group, and find one another.
    return _members(v, width, found, k, least)


def _members(v: DataFrame, width: int, found: DataFrame, k: int, least: float) -> DataFrame:
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            where, x = _unit(pdf["embedding"], width)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(dtype=object)[where], "ask": pdf["ask"].to_numpy(dtype=bool)[where], "key": _keys(x).view(np.int64) if len(x) else np.zeros(0, dtype=np.int64)})

    keys = v.mapInPandas(keyed, "id string, ask boolean, key bigint")
    return rank_members(found, keys, k, least)


def rank_members(found: DataFrame, keys: DataFrame, k: int, least: float) -> DataFrame:
    """Ranks what each id found together with its copies; ``found`` has the least id of equal vectors."""
    distinct = keys.groupBy("id").agg(F.min("key").alias("key"), F.max("ask").alias("ask"))
    # How many ids share a vector is counted before anything is joined; single ones need nothing more.
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    few = distinct.groupBy("key", part.alias("p")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.count("*").alias("n"))
    groups = few.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.sum("n").alias("n")).where("n > 1")
    shared = distinct.join(groups, "key").select("id", "ask", "ids", F.col("ids")[0].alias("lead"))
    copies = shared.where("ask").select("id", F.explode("ids").alias("neighbour")).where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("cosine"))
    through = shared.where("ask and id <> lead").select(F.col("id"), F.col("lead").alias("a")).join(found, "a").select("id", "neighbour", "cosine")
    every = found.select(F.col("a").alias("id"), "neighbour", "cosine").unionByName(through).unionByName(copies).where((F.col("id") != F.col("neighbour")) & (F.col("cosine") >= least))
    best = every.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    silent = shared.where("not ask").select("id")
    best = best.join(silent, "id", "left_anti")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def close_pairs(vectors: DataFrame, least: float, k: int = 5, cells: int = 16, stop: float = 0.06) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of cosine ``least`` or more, one among the ``k`` nearest of the other."""
    near = neighbours(vectors, k, least, cells, stop)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
