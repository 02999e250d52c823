"""Problem 4: putting items into as few containers as possible under several limits at once.

Vector bin packing: an item has a size in every dimension (tokens or characters, one segment,
loss-bearing tokens), a container a capacity in each. The open container takes, of the items
that still fit, the one whose sizes have the largest dot product with the room left (both as
shares of the capacity, weighted by how scarce a dimension is); when none fits, the next
container is opened. A second packing, best fit by decreasing size, is made as well and the
one with fewer containers is kept. Only sizes travel: an item's text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.sources.tables import ship_package, stored

PART = 4000  # items of a group that are packed together; a larger group is packed in parts
FAN_IN = 32  # parts whose emptiest containers are packed again together
CJK = "[\\u4e00-\\u9fff]"


def size_in_chars(text: Column) -> Column:
    return F.char_length(text)


def size_in_tokens(text: Column) -> Column:
    """Characters U+4E00..U+9FFF plus a quarter of the other code points, rounded up."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return (cjk + F.ceil((F.char_length(text) - cjk) / 4)).cast("int")


def dot_product_packing(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The container number (from 0) of each item; every item fits an empty container."""
    n = len(sizes)
    share = sizes / capacity
    weight = share.sum(axis=0) / max(n, 1)
    value = share * weight
    where, left, number = np.full(n, -1), np.arange(n), 0
    while len(left):
        room = np.ones(share.shape[1])
        while len(left):
            ok = (share[left] <= room + 1e-12).all(axis=1)
            if not ok.any():
                break
            fit = left[ok]
            best = fit[np.argmax(value[fit] @ room)]
            where[best] = number
            room = room - share[best]
            left = left[left != best]
        number += 1
    return where


def best_fit_decreasing(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    share = sizes / capacity
    rooms = np.empty((0, share.shape[1]))
    where = np.empty(len(sizes), dtype=int)
    for k in np.argsort(-share.max(axis=1), kind="stable"):
        ok = np.flatnonzero((share[k] <= rooms + 1e-12).all(axis=1))
        if len(ok):
            at = ok[np.argmin((rooms[ok] - share[k]).sum(axis=1))]
        else:
            rooms, at = np.vstack([rooms, np.ones(share.shape[1])]), len(rooms)
        rooms[at] -= share[k]
        where[k] = at
    return where


def pack(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    if len(sizes) < 2:
        return np.zeros(len(sizes), dtype=int)
    a, b = dot_product_packing(sizes, capacity), best_fit_decreasing(sizes, capacity)
    return b if b.max() < a.max() else a


def _pieces(items: list, limit: int | None) -> list[tuple]:
    """(item, piece number, start, size, loss) of each piece of one group; only an item above the limit has several."""
    if limit is None or limit <= 0:
        return [(i["item"], 1, 0, i["size"], i["loss"]) for i in items]
    return [(i["item"], k + 1, k * limit, min(limit, i["size"] - k * limit), min(limit, i["loss"])) for i in items for k in range(max(1, -(-i["size"] // limit)))]


def _placed(parts: list[tuple], limit: int | None, segments: int | None, loss_limit: int | None) -> list[tuple]:
    """The pieces with container number from 1, used size, used loss and segments of it."""
    if limit is None or limit <= 0:
        return [(*p, None, None, None, None) for p in parts]
    sizes = np.array([[p[3], 1, min(p[4], loss_limit or limit)] for p in parts], dtype=float)  # one above the loss limit fills a container
    most = np.array([limit, segments or max(1, len(parts)), loss_limit or limit], dtype=float)
    where = pack(sizes, most)
    used, loss, count = (np.bincount(where, weights=w) for w in (sizes[:, 0], np.array([float(p[4]) for p in parts]), sizes[:, 1]))
    return [(*p, int(c) + 1, int(used[c]), int(loss[c]), int(count[c])) for p, c in zip(parts, where)]


_PIECE = ("piece_no", "piece_start", "piece_size", "piece_loss")
_PLACE = ("container_no", "used", "used_loss", "segments")


def fill_containers(items: DataFrame, segments: int | None = None, loss_limit: int | None = None, part_items: int = PART) -> DataFrame:
    """Packs ``items`` (group_key, item, size, loss, capacity) group by group.

    Out come group_key, item, piece_no, piece_start, piece_size, piece_loss, container_no, and of the
    container used, used_loss and segments.
    An item within the capacity stays whole; a larger one is cut into pieces of the capacity,
    counted in its size's unit. ``segments`` and ``loss_limit`` bound a container further
    where they are given, both positive; no item is cut for its loss, and only a single one above the
    limit exceeds it, in a container of no other loss. A null loss is the size. A null size leaves the item out; a null or non-positive capacity gives
    null container and used. Repeated rows of an item count once; if they differ, the largest
    counts. Items of no size take a place in a container. An empty table gives no rows.
    A group of more than ``part_items`` items is dealt to parts by hash, each packed in a task of its own; the
    emptiest container of each part is opened again, and what was in it is packed together with that of other
    parts, in a tree up to the whole group. So one container a level may be partly filled.
    """
    if min(segments or 1, loss_limit or 1) < 1 or 0 in (segments, loss_limit):
        raise ValueError("segments and loss_limit must be positive")
    ship_package(items.sparkSession)
    distinct = items.where(F.col("size").isNotNull() & F.col("group_key").isNotNull() & F.col("item").isNotNull()).groupBy("group_key", "item").agg(F.max("size").cast("int").alias("size"), F.max(F.coalesce("loss", "size")).cast("int").alias("loss"), F.max("capacity").cast("int").alias("capacity"))
    distinct = stored(distinct, "items")
    counts = distinct.groupBy("group_key").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("n")).first().n or 0
    kind = items.schema["item"].dataType.simpleString()
    schema = f"group_key string, part int, capacity int, item {kind}, piece_no int, piece_start int, piece_size int, piece_loss int, container_no int, used int, used_loss int, segments int"
    names = ["group_key", "part", "capacity", "item", *_PIECE, *_PLACE]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, n, rows, c in zip(pdf["group_key"], pdf["part"], pdf["items"], pdf["capacity"]):
                limit = None if pd.isna(c) else int(c)
                pieces = [(r["item"], *(int(r[x]) for x in _PIECE)) for r in rows] if "piece_no" in rows[0] else _pieces(rows, limit)
                out += [(g, int(n), limit, *r) for r in _placed(pieces, limit, segments, loss_limit)]
            yield pd.DataFrame(out, columns=names).astype({x: "Int32" for x in ("capacity", *_PLACE)})

    def packed(rows: DataFrame, columns: list[str]) -> DataFrame:
        groups = rows.groupBy("group_key", "part").agg(F.sort_array(F.collect_list(F.struct("item", *columns))).alias("items"), F.max("capacity").alias("capacity"))
        return groups.select("group_key", "part", "items", "capacity").mapInPandas(run, schema)

    columns = ["group_key", "item", *_PIECE, *_PLACE]
    if most <= part_items:
        return packed(distinct.withColumn("part", F.lit(0)), ["size", "loss"]).select(*columns)
    large = counts.where(F.col("n") > part_items)
    whole = packed(distinct.join(large, "group_key", "left_anti").withColumn("part", F.lit(0)), ["size", "loss"]).select(*columns)
    dealt = distinct.join(large, "group_key").withColumn("part", F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / part_items)).cast("int"))
    level, parts, done = stored(packed(dealt, ["size", "loss"]), "packed"), -(-most // part_items), []
    while parts > 1:
        open_ = level.where("used is not null").groupBy("group_key", "part").agg(F.min_by("container_no", F.struct("used", "container_no")).alias("open"))
        marked = level.join(open_, ["group_key", "part"], "left").withColumn("again", F.coalesce(F.col("container_no") == F.col("open"), F.lit(False)))
        closed = marked.where("not again").withColumn("container_no", F.col("container_no") - F.coalesce((F.col("container_no") > F.col("open")).cast("int"), F.lit(0)))
        done.append(closed.drop("open", "again"))
        parts = -(-parts // FAN_IN)
        again = marked.where("again").select("group_key", "capacity", "item", *_PIECE, (F.col("part") / FAN_IN).cast("int").alias("part"))
        level = stored(packed(again, list(_PIECE)), "packed")
    done.append(level)
    # The containers of a group's parts and levels are numbered one after another.
    every = done[0].withColumn("level", F.lit(0))
    for k, d in enumerate(done[1:], 1):
        every = every.unionByName(d.withColumn("level", F.lit(k)))
    last = every.groupBy("group_key", "level", "part").agg(F.max("container_no").alias("m"))
    before = Window.partitionBy("group_key").orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
    shift = last.select("group_key", "level", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).cast("int").alias("shift"))
    shifted = every.join(shift, ["group_key", "level", "part"]).withColumn("container_no", F.col("container_no") + F.col("shift"))
    return whole.unionByName(shifted.select(*columns))


def request_items(sources: DataFrame, contexts: DataFrame) -> DataFrame:
    """Items for ``fill_containers``: the distinct sources of each request, sized in its budget's unit."""
    src = sources.where(F.col("content").isNotNull()).select("request_id", "source_index", size_in_chars(F.col("content")).alias("chars"), size_in_tokens(F.col("content")).alias("toks")).groupBy("request_id", "source_index").agg(F.max("chars").alias("chars"), F.max("toks").alias("toks"))
    ctx = contexts.groupBy("request_id").agg(F.max("budget_limit").alias("budget_limit"), F.max("budget_unit").alias("budget_unit"))
    size = F.when(F.col("budget_unit") == "tokens", F.col("toks")).otherwise(F.col("chars"))
    return src.join(ctx, "request_id").select(F.col("request_id").alias("group_key"), F.col("source_index").alias("item"), size.alias("size"), size.alias("loss"), F.col("budget_limit").alias("capacity"))


def pair_items(pairs: DataFrame, capacity: int) -> DataFrame:
    """Items of instruction data from (row_key, model, question, answer): a pair's tokens in all, and as loss those of its
    answer. Pairs without a key, question or answer are left out; those without a model are one group."""
    p = pairs.where("row_key is not null and question is not null and answer is not null").groupBy("row_key").agg(F.min(F.struct(F.coalesce("model", F.lit("")).alias("model"), "question", "answer")).alias("r"))
    asked, answered = size_in_tokens(F.col("r.question")), size_in_tokens(F.col("r.answer"))
    return p.select(F.col("r.model").alias("group_key"), F.col("row_key").alias("item"), (asked + answered).alias("size"), answered.alias("loss"), F.lit(capacity).alias("capacity"))
