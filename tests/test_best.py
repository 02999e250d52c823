import numpy as np
import pyarrow as pa
import pytest

from quillfold.operators import dense, lexical
from quillfold.operators.best import Best


class Sent:
    def __init__(self, *value):
        self.value = value


SCHEMA = pa.schema([("query_id", pa.string()), ("best", pa.list_(pa.struct([("worse", pa.float64()), ("tie", pa.string()), ("id", pa.string())])))])


def found(batches):
    """By query, in order; a task sends one row for a query and at most 2k of its rows, however many batches it read."""
    out = {}
    for q, rows in ((r["query_id"], r["best"]) for b in batches for r in b.to_pylist()):
        assert q not in out
        out[q] = sorted((x["worse"], x["id"]) for x in rows)
    return out


def same(got, want, k):
    assert got.keys() == {q for q, rows in want.items() if rows}
    for q, rows in got.items():
        assert len(rows) <= 2 * k
        assert [i for _, i in rows[:k]] == [i for _, i in sorted(want[q])[:k]] and np.allclose([w for w, _ in rows[:k]], [w for w, _ in sorted(want[q])[:k]])


@pytest.mark.parametrize("tied", [False, True])
def test_bm25_by_bounds_is_bm25_of_all_pairs(monkeypatch, tied):
    monkeypatch.setattr(lexical, "DOCS_FIRST", 40)
    monkeypatch.setattr(lexical, "DOCS_AT_ONCE", 300)
    rng, k, n, v = np.random.default_rng(1), 4, 1500, 60
    weights = 1 / np.arange(1, v + 1)
    docs = [[] if i % 97 == 0 else rng.choice(v, 3 if tied else int(rng.integers(1, 25)), p=weights / weights.sum()).tolist() for i in range(n)]
    asked = [sorted(set(rng.choice(v, int(rng.integers(1, 9))).tolist())) for _ in range(70)] + [[]]
    df = np.array([sum(t in d for d in docs) for t in range(v)])
    idf, avgdl = np.log(1 + (n - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
    names, ids = [f"q{i}" for i in range(len(asked))], [f"d{i:04d}" for i in rng.permutation(n)]
    pair = np.array([(t, q) for q, ts in enumerate(asked) for t in ts], dtype=np.int64)
    table = pa.table({"id": ids, "ts": pa.array([[str(t) for t in d] for d in docs], pa.list_(pa.string())), "dl": pa.array([len(d) for d in docs], pa.int32())})
    sent = Sent(pa.array(names), pair, [str(t) for t in range(v)], idf, avgdl, pa.array([], pa.string()), None)
    got = found(lexical._scorer(sent, lexical.Bm25(), k, False, SCHEMA)(iter(table.to_batches(max_chunksize=110))))
    want = {}
    for name, ts in zip(names, asked):
        s = [round(sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in ts), 6) for d in docs]
        want[name] = [(-x, i) for x, i in zip(s, ids) if x > 0]
    same(got, want, k)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_dense_by_bounds_is_dense_of_all_pairs(monkeypatch, metric):
    monkeypatch.setattr(dense, "TILE", 32)
    rng, k, n, w = np.random.default_rng(2), 5, 900, 6
    x = rng.integers(-2, 3, (n, w)).astype(float)  # many equal vectors, some of length 0
    q = np.concatenate([rng.integers(-2, 3, (50, w)), np.zeros((1, w))]).astype(float)
    names, ids = [f"q{i}" for i in range(len(q))], [f"d{i:04d}" for i in rng.permutation(n)]
    table = pa.table({"id": ids, "embedding": pa.array(x.tolist()), "tie": pa.nulls(n, pa.string())})
    got = found(dense._scorer(Sent(pa.array(names), q), k, metric, False, False, SCHEMA)(iter(table.to_batches(max_chunksize=70))))
    s = np.round(dense._score(q, x, metric), 6) + 0.0
    same(got, {name: [(-a, i) for a, i in zip(row, ids)] for name, row in zip(names, s.tolist())}, k)


def test_bounds_rise_and_ties_go_by_key():
    best = Best(2, 2)
    for at in range(0, 100, 10):
        key = np.array([f"{k:03d}" for k in range(at, at + 10)], dtype=object)
        best.add(np.zeros(10, dtype=np.int64), np.full(10, 1.5), key, key)
        best.cut()
    assert best.waiting == 0 and best.bound.tolist() == [1.5, -np.inf] and sorted(best.parts[0][2])[:2] == ["000", "001"] and len(best.parts[0][2]) <= 4
