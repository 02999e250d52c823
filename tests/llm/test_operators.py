import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillfold.llm import binpack, encode, mixing, neardup, neighbours, pairs, scans, spam, split

VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


# ------------------------------------------------------------ problem 1


def brute_sets(text):
    import re

    w = re.findall(r"[a-z0-9_]+|[一-鿿]", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


def edited(rng, words):
    out = list(words)
    for _ in range(rng.randint(0, max(1, len(out) // 8))):
        k = rng.randrange(len(out))
        draw = rng.random()
        if draw < 0.4:
            out[k] = rng.choice(VOCAB)
        elif draw < 0.7:
            out.insert(k, rng.choice(VOCAB))
        else:
            del out[k]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [("r", "", "null", None), ("r", "", "empty", ""), ("r", "", "two", "one two"), ("r", "", None, "one two three"), ("r", "", "a1", "One, two three!"), ("r", "", "a2", "one two THREE"), ("r", "", "a3", "one two three four"), ("r", "", "zh1", "中文字符三"), ("r", "", "zh2", "中文字符四")]
    for g in range(25):
        base = [rng.choice(VOCAB) for _ in range(rng.choice([3, 4, 6, 12, 30, 60, 130, 300, 700]))]
        for m in range(rng.randint(1, 4)):
            base = edited(rng, base)
            rows.append(("r", "", f"k{g:02d}-{m}", " ".join(base)))
    rows.append(rows[-1])
    rows += [("s", "g1", "g1#01", rows[12][3]), ("s", "g1", "g1#02", rows[12][3]), ("s", "g2", "g2#01", rows[12][3])]
    df = spark.createDataFrame(rows, "rel string, grp string, key string, content string").withColumn("cls", F.lit(1)).withColumn("a", F.lit("x"))
    got = {tuple(r) for r in neardup.similar_pairs(df).collect()}
    want = set()
    items = sorted({r for r in rows if r[2] is not None}, key=lambda r: r[2])
    sets = {r: brute_sets(r[3]) for r in items}
    for i, x in enumerate(items):
        for y in items[i + 1 :]:
            if x[:2] == y[:2] and x[2] != y[2] and sets[x] and sets[y] and 2 * len(sets[x] & sets[y]) >= len(sets[x] | sets[y]):
                want.add((x[0], min(x[2], y[2]), max(x[2], y[2])))
    assert got == want


def test_similar_pairs_of_an_empty_table(spark):
    assert neardup.similar_pairs(spark.createDataFrame([], "rel string, grp string, key string, content string")).count() == 0


def test_only_exact_copies_beyond_the_bound_are_a_star(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COPIES_EXPANDED", 3)
    rows = [("r", "", f"{k}", "one two three four five six seven eight") for k in range(6)] + [("r", "", "x", "one two three four five six seven nine")]
    rows += [("r", "", "y", "One two three four five six seven eight!"), ("r", "", "z", "ONE two three four five six seven eight")]
    got = {tuple(r)[1:] for r in neardup.similar_pairs(spark.createDataFrame(rows, "rel string, grp string, key string, content string")).collect()}
    assert got == {("0", str(k)) for k in range(1, 6)} | {("0", "x"), ("0", "y"), ("0", "z"), ("x", "y"), ("x", "z"), ("y", "z")}


def test_split_signatures_lose_nothing(spark):
    rng = random.Random(11)
    shared = [rng.choice(VOCAB) for _ in range(40)]
    rows = [("r", "", f"k{k:03d}", " ".join(edited(rng, shared) + [rng.choice(VOCAB) for _ in range(rng.randint(2, 25))])) for k in range(120)]
    rows += [("r", "", f"s{k:03d}", " ".join(edited(rng, shared[:10]))) for k in range(60)]
    _, classes = neardup.classes_of(spark.createDataFrame(rows, "rel string, grp string, key string, content string"))
    whole = {tuple(r) for r in neardup.similar_classes(classes).collect()}
    assert len(whole) > 500 and {tuple(r) for r in neardup.similar_classes(classes, most=7).collect()} == whole


def test_groups_are_the_components_of_all_pairs(spark):
    rng = random.Random(12)
    rows = [("r", "", "none", None), ("s", "q1", "q1#01", "one two three four"), ("s", "q1", "q1#02", "one two three four"), ("s", "q2", "q2#01", "one two three four")]
    for g in range(12):
        base = [rng.choice(VOCAB) for _ in range(rng.choice([6, 12, 40, 200]))]
        for m in range(rng.randint(1, 9)):
            base = edited(rng, base)
            rows.append(("r", "", f"k{g:02d}-{m}", " ".join(base)))
            if rng.random() < 0.3:
                rows.append(("r", "", f"k{g:02d}-{m}c", " ".join(base).upper()))
    df = spark.createDataFrame(rows + rows[-1:], "rel string, grp string, key string, content string").withColumn("node", F.lit(1))
    pairs_ = [tuple(r) for r in neardup.similar_pairs(df).collect()]
    root = {(r[0], r[2]): (r[0], r[2]) for r in rows}
    for rel, a, b in pairs_:
        x, y = root[rel, a], root[rel, b]
        for k in root:
            if root[k] in (x, y):
                root[k] = min(x, y)
    many = {}
    for rel, a, b in pairs_:
        for k in (a, b):
            many[rel, k] = many.get((rel, k), 0) + 1
    got = {(r.rel, r.key): r for r in neardup.similar_groups(df).collect()}
    assert set(got) == set(many) and all(got[k].n_similar == n and (k[0], got[k].group_id) == root[k] for k, n in many.items())
    sets = {(r[0], r[1], r[2]): brute_sets(r[3]) for r in rows}
    assert all(sets["r", "", r.class_id] == sets["r", "", r.key] and r.class_id <= r.key for r in got.values() if r.rel == "r")
    assert neardup.similar_groups(df.limit(0)).count() == 0


def test_pigeonring_keeps_every_pair_within_the_budget():
    rng = np.random.default_rng(0)
    d = rng.integers(0, 6, size=(2000, 8))
    kept = neardup.pigeonring(d, np.full(2000, 20))
    assert (kept == (d.sum(1) <= 20)).all()


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for n in (50, 120, 200, 500):
        a = rng.choice(2**32, n, replace=False).astype(np.uint32)
        b = np.unique(np.concatenate([a[: n // 2], rng.choice(2**32, n // 2, replace=False).astype(np.uint32)]))
        x = neardup.sketches(a, np.zeros(len(a), dtype=int), 1, 2)
        y = neardup.sketches(b, np.zeros(len(b), dtype=int), 1, 4)
        assert np.bitwise_count(x ^ neardup.folded(y)).sum() <= len(set(a) ^ set(b))
        assert (neardup.folded(x) == neardup.sketches(a, np.zeros(len(a), dtype=int), 1, 1)).all()


# ------------------------------------------------------------ problem 2


def sample_pairs(n=400):
    rng = random.Random(3)
    out = []
    for _ in range(n):
        name, code = rng.choice(VOCAB).title(), f"ABC-{rng.randint(10, 99)}"
        q = rng.choice([f"How long is the {rng.choice(VOCAB)} kept in {name}?", f"Who may open the {rng.choice(VOCAB)} under {code}?"])
        a = " ".join(rng.choice([f"For {name}, the site warden keeps the {rng.choice(VOCAB)} for {rng.randint(2, 60)} days.", f"Under {code} the night operator may open the {rng.choice(VOCAB)} after {rng.randint(2, 60)} hours.", f"Only the records desk can close some {rng.choice(VOCAB)} that was opened twice."]) for _ in range(rng.randint(1, 3)))
        out.append((q, a))
        if rng.random() < 0.2:
            out.append((f"Wie lange bleibt {name} für die Prüfung gesperrt?", f"Für {name} gilt, dass die Buchhaltung das Archiv nach {rng.randint(2, 60)} Tagen prüfen soll."))
    return out


def test_faulty_pairs(spark):
    sound = sample_pairs()
    model = pairs.train(sound[:-60])
    held, rng = sound[-60:], random.Random(9)
    assert sum(model.defect(q, a) is not None for q, a in held) <= 4
    made = pairs.spoil(held, rng)
    good = [d for d in made if d[2]]
    assert sum(model.defect(q, a) == d for q, a, d in good) / len(good) > 0.85
    rows = [("t", "1", "How long?", None, False), ("t", "2", "How long?", " \n", False), ("t", "2", "How long?", " \n", False), ("t", None, "q", "", False), ("t", "3", None, held[0][1], None), ("t", "4", "Who may open the alpha?", "I must decline to answer.", True), ("t", "5", "Who may open the alpha?", "I must decline to answer.", False)]
    df = spark.createDataFrame(rows, "rel string, row_key string, question string, answer string, abstains boolean").withColumn("defect", F.lit("clash"))
    got = {tuple(r) for r in pairs.faulty_pairs(df, model).collect()}
    assert {("t", "1", "empty"), ("t", "2", "empty"), ("t", "5", "refusal")} <= got and not any(r[1] in (None, "4") for r in got)
    assert pairs.faulty_pairs(df.limit(0), model).count() == 0


def test_known_words_are_of_all_pairs(spark):
    rows = [(f"What is {k}?", f"The word{k} and the word{k + 1} are here.") for k in range(300)]
    model = pairs.fit(spark.createDataFrame(rows * 2, "question string, answer string"), sample_pairs=100)
    assert all(model.known[pairs.crc32(f"word{k}".encode()) % pairs.VOCABULARY] for k in range(1, 300))
    assert not model.known[pairs.crc32(b"word0") % pairs.VOCABULARY]  # in one answer, given twice


# ------------------------------------------------------------ problem 3


def known_words():
    text = " ".join(["the service owner must verify the calendar before the part-time deposit is moved by the team"] * 60)
    counts = np.zeros(2 * scans.BINS, dtype=np.uint32)
    p = scans._vocabulary_places(pd.DataFrame({"t": [text]}))
    np.add.at(counts, p[0], p[1].astype(np.uint32))
    return counts


def test_repair_of_a_scanned_page(spark):
    counts = known_words()
    known = scans.Vocabulary(counts)
    page = "Calendar Guide\nThe service 0wner must verify the cal-\nendar before the part-\ntime deposit\n- 3 -\nCalendar Gu1de\nis moved by the team.\n\nThe te@m must verify the dep-\nosit.\n- 4 -\n"
    text, noise = scans.repair(page, known)
    assert text == "The service owner must verify the calendar before the part-time deposit is moved by the team.\n\nThe team must verify the deposit."
    assert noise == ["header", "hyphenation", "misread", "page_number"]
    clean = "The service owner must verify the part-\ntime deposit of model G6l.\n\nRoom list:\n12\n40\n7"
    assert scans.repair(clean, known)[1] == []
    df = spark.createDataFrame([("1", page), ("2", None), ("3", ""), ("1", page)], "id string, content string").withColumn("noise", F.lit(1))
    got = {r.id: (r.repaired, r.noise) for r in scans.repair_scans(df, counts).collect()}
    assert got["2"] == (None, []) and got["3"] == ("", []) and got["1"][0] == text
    assert scans.repair_scans(df.limit(0), counts).count() == 0


def test_headers_stand_at_page_edges(spark):
    counts = known_words()
    known = scans.Vocabulary(counts)
    body = "The service owner must verify the calendar before the deposit is moved by the team."
    mid = f"{body}\n\nSafety Bulletin\n\n{body}\n\nSafety Bulletin\n\n{body}"
    assert "header" not in scans.repair(mid, known)[1]
    rows = [(f"{k}", f"{'C0mmon' if k == 2 else 'Common'} Calendar Guide\n{body} {k}", "a/x.pdf" if k else "./a/x.pdf ") for k in range(4)]
    rows += [("9", f"Common Calendar Guide\n{body}", "b.pdf"), ("8", f"Common Calendar Guide\n{body}", None), ("7", None, "a/x.pdf")]
    df = spark.createDataFrame(rows, "id string, content string, source string").withColumn("heads", F.lit(1))
    got = {r.id: r for r in scans.repair_scans(df, counts).collect()}
    assert all("header" in got[str(k)].noise and "Guide" not in got[str(k)].repaired for k in range(4))
    assert all("header" not in got[k].noise for k in ("9", "8", "7"))


def test_a_full_sketch_takes_off_what_stands_there_by_chance():
    rng = np.random.default_rng(3)
    counts = rng.poisson(6, size=2 * scans.BINS).astype(np.uint32)
    np.add.at(counts, list(scans._places("calendar")), 5000)
    known = scans.Vocabulary(counts)
    assert abs(known.count("calendar") - 5000) < 15
    assert np.mean([known.count(f"never{k}") > 0 for k in range(2000)]) < 0.1


def test_misreadings_dont_depend_on_the_size_of_the_corpus():
    words = {"every": 4000, "evcry": 45, "dawn": 3000, "celui": 240, "celu": 1, "stop": 900, "stopl": 1, "base": 30, "line": 30, "the": 400_000, "and": 200_000, "aud": 26, "rest": 1_560_000}
    for times in (1, 10, 1000):
        counts = np.zeros(2 * scans.BINS, dtype=np.uint32)
        for word, n in words.items():
            np.add.at(counts, list(scans._places(word)), n * times)
        known = scans.Vocabulary(counts)
        got = [scans._misread(w, known) for w in ("evcry", "Aud", "Celu!", "stop!", "dawn", "every")]
        assert got == ["every", "And", "Celui", None, None, None]
        assert scans._rejoin("base", "line", known) == (True, "base-line", False)


def test_vocabulary_counts_all_rows(spark):
    df = spark.createDataFrame([("one two-\nthree",), ("one",), (None,)], "content string")
    v = scans.Vocabulary(scans.vocabulary(df))
    assert v.count("one") == 2 and v.count("two") == 0 and v.count("zzz") == 0


# ------------------------------------------------------------ problem 4


def test_containers(spark):
    rows = [("a", k, n, n, 10) for k, n in enumerate([6, 4, 5, 5, 25, 0], 1)] + [("a", 1, 6, 6, 10), ("n", 1, 3, 3, None), ("z", 1, None, None, 10)]
    df = spark.createDataFrame(rows, "group_key string, item int, size int, loss int, capacity int").withColumn("used", F.lit("clash"))
    got = binpack.fill_containers(df).collect()
    used = {}
    for r in got:
        if r.group_key == "a":
            used[r.container_no] = used.get(r.container_no, 0) + r.piece_size
            assert r.used <= 10
    assert len(used) == 5 and all(v <= 10 for v in used.values()) and sum(used.values()) == 45
    assert {r.item for r in got if r.piece_no > 1} == {5}
    assert [(r.container_no, r.used) for r in got if r.group_key == "n"] == [(None, None)] and not [r for r in got if r.group_key == "z"]
    assert binpack.fill_containers(df.limit(0)).count() == 0


def test_a_large_group_is_packed_in_parts(spark):
    rows = [("g", k, 1 + k % 7, 1 + k % 3, 20) for k in range(3000)] + [("g", 3000, 50, 50, 20)] + [("h", 1, 3, 3, 10), ("h", 2, 25, 25, 10)]
    df = spark.createDataFrame(rows, "group_key string, item int, size int, loss int, capacity int")
    got = binpack.fill_containers(df, segments=8, loss_limit=12, part_items=20).collect()
    by = {}
    for r in got:
        by.setdefault((r.group_key, r.container_no), []).append(r)
    assert sorted((r.group_key, r.item, r.piece_no) for r in got) == sorted([("g", k, 1) for k in range(3000)] + [("g", 3000, n) for n in (1, 2, 3)] + [("h", 1, 1), ("h", 2, 1), ("h", 2, 2), ("h", 2, 3)])
    for (g, _), rs in by.items():
        assert all(r.used == sum(x.piece_size for x in rs) <= (20 if g == "g" else 10) and r.segments == len(rs) <= 8 and r.used_loss == sum(x.piece_loss for x in rs) for r in rs)
        assert rs[0].used_loss <= 12 or len([x for x in rs if x.piece_loss]) == 1
    numbers = sorted(c for g, c in by if g == "g")
    least = sum(r[2] for r in rows if r[0] == "g") / 20
    assert numbers == list(range(1, len(numbers) + 1)) and len(numbers) <= 1.06 * least + 3


def test_packing_is_close_to_the_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(1, 60, size=(rng.integers(2, 30), 3)).astype(float)
        capacity = np.array([60.0, 60.0, 60.0])
        where = binpack.pack(sizes, capacity)
        for c in range(where.max() + 1):
            assert (sizes[where == c].sum(0) <= capacity).all() and (where == c).any()
        assert where.max() + 1 <= 2 * np.ceil(sizes.sum(0) / capacity).max() + 1


def test_a_loss_limit_below_the_capacity_binds(spark):
    df = spark.createDataFrame([("g", k, 10, 10 if k < 4 else 30, 100) for k in range(5)], "group_key string, item int, size int, loss int, capacity int")
    loss: dict[int, list[int]] = {}
    three = spark.createDataFrame([("g", k, 30, 30, 100) for k in range(3)], df.schema)
    assert {r.used for r in binpack.fill_containers(three, loss_limit=50).collect()} == {30}
    for r in binpack.fill_containers(df, loss_limit=20).collect():
        loss.setdefault(r.container_no, []).append(10 if r.item < 4 else 30)
    assert sorted(map(sorted, loss.values())) == [[10, 10], [10, 10], [30]]


# ------------------------------------------------------------ problem 5


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    v = np.vstack([base, base[:100] + 0.05 * rng.normal(size=(100, 16))])
    rows = [(f"{k:04d}", x.tolist()) for k, x in enumerate(v)] + [("n", None), ("zero", [0.0] * 16), (None, [1.0] * 16), ("short", [1.0]), ("0000", v[0].tolist())]
    rows += [(f"copy{k}", (2 * v[5]).tolist()) for k in range(8)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").withColumn("cosine", F.lit(1))
    ids = [r[0] for r in rows[:400]] + [f"copy{k}" for k in range(8)]
    full = np.vstack([v, np.tile(v[5], (8, 1))])
    u = full / np.linalg.norm(full, axis=1)[:, None]
    s = np.round(u @ u.T, 5)
    got = {}
    for r in neighbours.neighbours(df, 5, cells=400, stop=9.0, width=16).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    hit = total = 0
    for k, name in enumerate(ids):
        order = [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[k, j], ids[j])) if j != k][:5]
        hit, total = hit + len(got[name] & set(order)), total + 5
    assert hit / total >= 0.99
    near = {tuple(r) for r in neighbours.close_pairs(df, 0.9).collect()}
    want = set()
    for k in range(len(ids)):
        for j in sorted((j for j in range(len(ids)) if j != k and s[k, j] >= 0.9), key=lambda j: (-s[k, j], ids[j]))[:5]:
            want.add((min(ids[k], ids[j]), max(ids[k], ids[j])))
    assert len(near & want) / len(want) > 0.95 and len(near - want) / len(near) < 0.05
    assert neighbours.neighbours(df.limit(0)).count() == 0


def test_one_vector_of_another_length_loses_no_others(spark):
    rng = np.random.default_rng(6)
    v = np.repeat(rng.normal(size=(5, 4)), 4, axis=0) + 0.01 * rng.normal(size=(20, 4))
    rows = [(f"{k:02d}", x.tolist()) for k, x in enumerate(v)]
    plain = {tuple(r) for r in neighbours.close_pairs(spark.createDataFrame(rows, "id string, embedding array<double>"), 0.9).collect()}
    odd = {tuple(r) for r in neighbours.close_pairs(spark.createDataFrame(rows + [("odd", [1.0] * 8)], "id string, embedding array<double>"), 0.9).collect()}
    assert len(plain) >= 30 and plain == odd


def test_blocks_of_cells_cover_every_vector():
    rng = np.random.default_rng(7)
    index = neighbours.MultiIndex(rng.random((6, 3), dtype=np.float32), rng.random((5, 3), dtype=np.float32))
    count = rng.integers(0, 3000, size=30)
    count[[3, 17]] = 2 * neighbours.BLOCK + 5, 0
    index.deal(count.astype(np.uint32))
    assert (index.parts == np.where(count > neighbours.BLOCK, 3, count > 0)).all() and index.parts[17] == 0
    load = np.zeros(len(index.tasks))
    for c in np.flatnonzero(count):
        load[index.block[c] : index.block[c] + index.parts[c]] += count[c] / index.parts[c]
    assert (load > 0).all() and load.max() <= 2 * neighbours.BLOCK and round(load.sum()) == count.sum()
    row, block, second = index.visits(rng.random((40, 6), dtype=np.float32), 30, 9.0)
    assert len(row) == 40 * (29 + 2) and set(block) == set(range(len(index.tasks)))
    of = {b: {int(c) // 5 for c in np.flatnonzero(count) if index.block[c] <= b < index.block[c] + index.parts[c]} for b in range(len(index.tasks))}
    assert all(len(x) == 1 for x in of.values())


def test_walk_visits_cells_in_order_of_distance():
    rng = np.random.default_rng(5)
    d1, d2 = rng.random((50, 9)), rng.random((50, 7))
    first, second = neighbours.walk(d1, d2, 12)
    for r in range(50):
        every = np.sort((d1[r][:, None] + d2[r][None, :]).ravel())[:12]
        assert np.allclose(d1[r, first[r]] + d2[r, second[r]], every)


# ------------------------------------------------------------ problem 6


def test_pieces_cover_the_text(spark):
    text = "First sentence here. Second one, with a clause; and more words. " * 8 + "\n\n" + "x" * 130 + " 漢字。" * 40
    rows = [("1", text, "a"), ("2", None, "a"), ("3", " \t\n", "a"), ("4", " short ", None), ("5", text, "b"), ("6", "🙂" * 100, "zzz"), ("1", text, "a")]
    df = spark.createDataFrame(rows, "id string, content string, file_type string").withColumn("pieces", F.lit(1)).withColumn("trimmed", F.lit("clash"))
    settings = spark.createDataFrame([("a", 60, 12), ("b", 50, 0), ("default", 40, 5)], "file_type string, chunk_size int, chunk_overlap int")
    out = split.split_oversized(df, settings)
    got = {r.id: r for r in out.collect()}
    assert out.count() == 7 and got["2"].pieces is None and got["3"].pieces == [] and [tuple(p) for p in got["4"].pieces] == [(0, 5)]
    for i, size, overlap in (("1", 60, 12), ("5", 50, 0), ("6", 40, 5)):
        t, end = got[i].trimmed, 0
        for k, p in enumerate(got[i].pieces):
            assert 0 < p.length <= size and p.start == (max(0, end - overlap) if k else 0) and p.start + p.length > end
            end = p.start + p.length
        assert end == len(t)
    ends = [got["5"].trimmed[p.start + p.length - 1] for p in got["5"].pieces[:5]]
    assert all(e in " .\n" for e in ends)
    texts = {(r.id, r.piece_no): r.piece for r in split.piece_rows(out.where("id = '6'"), ["id"]).collect()}
    assert texts["6", 1] == "🙂" * 40
    assert split.split_oversized(df.limit(0), settings).count() == 0


# ------------------------------------------------------------ problem 7


def test_encoding_equals_a_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    tables = pytest.importorskip("public_tokenizers")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tables.path("byte_bpe_50k.tiktoken"), "rb"))}
    ref = tiktoken.Encoding("own", pat_str=tables.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = [None, "", " ", "a" * 5000, "<|endoftext|>", "Grüße\r\n\t x  y\n\n", "中文🙂\x1c\x85 z"] + ["".join(rng.choice("aaeiou  tnrs'hl.\n12é中🙂\t") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, None)], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    rows = encode.encode_corpus(df, "doc_id", "text").collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r.doc_id]
        assert r.ids == (ref.encode_ordinary(t) if t else [])
    assert encode.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    counts = {r.doc_id: r.tokens for r in encode.count_tokens(df, ["doc_id"], "text").collect()}
    assert counts[0] == 0 and counts[4] == len(ref.encode_ordinary(texts[4]))


# ------------------------------------------------------------ problem 8


def test_mix_reaches_its_shares(spark):
    rng = random.Random(7)
    docs = [(k, rng.choice(["big"] * 6 + ["mid", "mid", "small"]), " ".join(rng.choice(VOCAB) for _ in range(rng.randint(5, 80)))) for k in range(900)]
    rows = docs + [(docs[0]), (1000, None, "x"), (1001, "big", None), (1002, "big", " "), (1003, "other", "not wanted")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("tokens", F.lit("clash")).withColumn("p", F.lit(0))
    targets = spark.createDataFrame([("big", 0.3, 4), ("mid", 0.4, 4), ("small", 0.3, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(df, targets)
    u = {r.doc_id: r for r in uses.collect()}
    assert len(u) == 901 and u[1003].uses == 0 and max(r.uses for r in u.values()) <= 4
    got = {r.source: r for r in report.collect()}
    assert got["small"].capped and all(r.uses == 2 for r in u.values() if r.source == "small")
    total = sum(r.tokens for r in u.values())
    assert abs(sum(r.mixed_tokens for r in got.values()) - total) < 400
    assert abs(got["mid"].actual_share / got["big"].actual_share - 4 / 3) < 0.02 and got["none"].mixed_tokens == 0
    again = {r.doc_id: r.uses for r in mixing.mix(df, targets)[0].collect()}
    assert again == {k: r.uses for k, r in u.items()}
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df.limit(0), targets)[1].count() == 4


def test_pivotal_keeps_mass_and_expectation():
    w = np.array([3.0, 5.0, 8.0, 2.0, 7.0])
    p = np.array([0.3, 0.6, 0.5, 0.9, 0.2])
    mean = np.zeros(5)
    for seed in range(3000):
        r = mixing.pivotal(p, w, np.random.default_rng(seed))
        assert abs((w * r).sum() - (w * p).sum()) < 1e-6 and ((r > 1e-9) & (r < 1 - 1e-9)).sum() <= 1
        mean += r
    assert np.abs(mean / 3000 - p).max() < 0.04


# ------------------------------------------------------------ problem 9


def page(kind, rng):
    w = lambda: rng.choice(VOCAB)
    prose = [f"The {w()} must be checked by the {w()} team before the {w()} is sent to the {w()} office every {rng.randint(2, 50)} days." for _ in range(6)]
    if kind == "links":
        return "\n".join(f"- [{w()} {w()}](http://{w()}.example/{w()}/{rng.randint(1, 999)})" for _ in range(30))
    if kind == "stuffed":
        a = f"{w()} {w()}"
        return " ".join(rng.choice(["buy", "cheap", "best", "online"]) + " " + a for _ in range(60))
    if kind == "tags":
        return " ".join(f"#{w()}{w().title()}" for _ in range(60))
    if kind == "mixed":
        return "\n\n".join(prose) + "\n\n" + "\n".join(f"- [{w()}](http://{w()}.example/)" for _ in range(4))
    return "# Title\n\n" + "\n\n".join(prose)


def test_stuffed_headings_rows_and_sentences_are_labelled():
    rng = random.Random(10)
    model = spam.train([page(rng.choice(["prose"] * 6 + ["mixed", "links", "stuffed", "tags"]), rng) for _ in range(300)])
    w = lambda: rng.choice(VOCAB)
    head = "\n".join(f"# buy cheap alpha beta best {w()} alpha beta online alpha beta {w()} alpha beta" for _ in range(30))
    rows = "\n".join(f"| {w()} {w()} | cheap {w()} | best {w()} | buy {w()} | top {w()} |" for _ in range(40))
    sentences = " ".join(f"Buy {w()} quay {rng.choice(['cheap', 'fast'])} for {w()} quay. Buy alpha quay for alpha quay." for _ in range(20))
    for text in (head, rows, sentences):
        assert sum(spam.shares(model, text)[1:]) > 0.5
    figures = "# Sizes\n\n| item | limit |\n| --- | --- |\n" + "\n".join(f"| {w()} | {k} |" for k in range(40))
    for text in (figures, "# Title", page("prose", rng) + "\n" + head[:300]):
        assert sum(spam.shares(model, text)[1:]) < 0.5


def test_spam_pages(spark):
    rng = random.Random(8)
    kinds = [rng.choice(["prose"] * 8 + ["mixed", "links", "stuffed", "tags"]) for _ in range(500)]
    rows = [(k, page(x, rng)) for k, x in enumerate(kinds)] + [(900, None), (901, ""), (902, " \n"), (None, page("links", rng)), (0, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("menu", F.lit("clash"))
    got = {r.doc_id for r in spam.spam_pages(df).collect()}
    want = {k for k, x in enumerate(kinds) if x in ("links", "stuffed", "tags")}
    assert len(got & want) / len(want) > 0.95 and len(got - want) <= 2
    assert spam.spam_pages(df.limit(0)).count() == 0
