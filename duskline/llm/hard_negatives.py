"""Hard negatives by slots: rows of other labels that score below an anchor's positives, but not far.

An anchor's positives are its best rows of the same label. Each asks for the best rows of other labels
whose score lies between `low` and `high` percent of its own. These windows overlap; their upper limits,
sorted, cut all scores into disjoint slots. Tasks keep the best rows of each anchor and slot, a window
limited by rank merges what tasks found, and one pass over an anchor's slots from the lowest up merges
each slot with those below it: the answer to every window that ends there, down to its lower limit.

Anchors are the queries and all rows are searched: tasks hold a block of anchors of bounded size and
stream through the rows, which are not shuffled; blocks follow one another. Scores are integer inner
products, computed in doubles where these are exact and in 64-bit integers otherwise.

Defined cases: rows take part if they have an id, a label, and a vector of finite components without
null; in a product, a shorter vector is filled up with zeros. Rows that repeat an id are rows of their
own: an anchor skips itself alone, and repeats of an anchor answer for themselves. Ties go to the smaller
id. A window without rows returns none; an empty table gives no rows; other columns are ignored. A score
that could leave 64 bits raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled, shared

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
# Anchors whose vectors and results tasks hold at once; scores computed in one step.
BLOCK_ANCHORS = 8192
STEP_SCORES = 1 << 21

LEAST = np.iinfo(np.int64).min
PART = 33  # bits of monotonically_increasing_id below the partition
ROWS = "place long, anchor_id long, own long, slot int, score long, id long"
FOUND = pa.schema(
    [
        ("place", pa.int64()),
        ("anchor_id", pa.int64()),
        ("own", pa.int64()),
        ("slot", pa.int32()),
        ("score", pa.int64()),
        ("id", pa.int64()),
    ]
)
ENTRIES = "array<struct<down: bigint, id: bigint>>"


def usable(embeddings: DataFrame) -> DataFrame:
    """The rows that take part: vec_id, label, embedding."""
    infinite = F.lit(float("inf"))

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)

    rows = embeddings.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")
    )
    return rows.na.drop("any").where(F.forall("embedding", finite))


def matrix(vectors: pa.ListArray, scale: float) -> np.ndarray:
    """Whole components as doubles; shorter vectors are filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy().astype(np.int64)
    values = np.floor(scale * vectors.flatten().to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    filled = np.zeros((len(sizes), width))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    filled[owner, np.arange(len(values)) - first[owner]] = values
    return filled


def scores(a: np.ndarray, b: np.ndarray, factor: int = 1) -> np.ndarray:
    """Exact inner products of all rows of `a` with all of `b`."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0) + 1) * max(1, width)
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if bound * factor >= 2.0**62:
        raise OverflowError("inner products of these vectors can leave 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The best `keep` (score, id) of each row, fed with columns in the order of their ids."""

    def __init__(self, rows: int, keep: int):
        self.keep = keep
        self.score = np.full((rows, keep), LEAST)
        self.id = np.full((rows, keep), np.iinfo(np.int64).max)

    def add(self, rows: slice, score: np.ndarray, held: np.ndarray, ids: np.ndarray) -> None:
        """`score` and `held` (which of them count) by row and column; `ids` by column, ascending."""
        # Rows that gain nothing are left out.
        gains = np.flatnonzero((held & (score >= self.score[rows, -1:])).any(axis=1))
        if not len(gains):
            return
        at = np.arange(rows.start, rows.stop)[gains]
        score, held, n = score[gains], held[gains], len(ids)
        if n > self.keep:
            order = self._best(score, held, n)
            score, held = np.take_along_axis(score, order, 1), np.take_along_axis(held, order, 1)
            ids = ids[order]
        else:
            ids = np.broadcast_to(ids, score.shape)
        score = np.concatenate([self.score[at], np.where(held, score, LEAST)], axis=1)
        ids = np.concatenate([self.id[at], np.where(held, ids, np.iinfo(np.int64).max)], axis=1)
        order = np.lexsort((ids, -1 - score), axis=1)[:, : self.keep]
        self.score[at] = np.take_along_axis(score, order, 1)
        self.id[at] = np.take_along_axis(ids, order, 1)

    def _best(self, score: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
        """Columns of the best scores of each row; of equal ones the first."""
        if np.abs(score).max(initial=0) < 2**61 // n:
            key = np.where(held, score * n - np.arange(n), LEAST)
            return np.argpartition(key, n - self.keep, axis=1)[:, n - self.keep :]
        return np.argsort(np.where(held, -score, -LEAST - 1), axis=1, kind="stable")[:, : self.keep]


def _found(place, anchor, own, slot: int, best: Best) -> pa.RecordBatch:
    row, column = np.nonzero(best.score > LEAST)
    columns = [place[row], anchor[row], own[row], np.full(len(row), slot), best.score[row, column], best.id[row, column]]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _search(block, scale: float, keep: int, low_high: tuple[int, int] | None):
    """Rows in, the best (anchor, slot, score, id) of a task out.

    Without `low_high`, the best rows of the anchor's label; else those of other labels in each slot.
    """

    def run(batches):
        place, anchor, label, vectors, limits, least = block()
        own = np.concatenate([np.diag(scores(v[None], v[None])) for v in vectors]) if len(vectors) else anchor
        slots = [Best(len(anchor), keep) for _ in range(limits.shape[1] if low_high else 1)]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, labels = ids[order], batch.column(1).to_numpy()[order]
            rows = matrix(batch.column(2), scale)[order]
            step = max(1, STEP_SCORES // max(1, len(ids)))
            for start in range(0, len(anchor), step):
                part = slice(start, min(start + step, len(anchor)))
                score = scores(vectors[part], rows, max(100, *(low_high or (1,))))
                same = label[part, None] == labels
                if not low_high:
                    slots[0].add(part, score, same, ids)
                    continue
                scaled = 100 * score
                other = ~same & (scaled >= least[part, None])
                below = scaled <= limits[part, :1]
                for k, best in enumerate(slots):
                    # Down to the next limit, which is the next slot's upper end.
                    lower = scaled <= limits[part, k + 1 : k + 2] if k + 1 < len(slots) else np.zeros_like(below)
                    best.add(part, score, other & below & ~lower, ids)
                    below = lower
        for k, best in enumerate(slots):
            for start in range(0, len(anchor), 1024):
                part = slice(start, start + 1024)
                some = Best(0, keep)
                some.score, some.id = best.score[part], best.id[part]
                yield _found(place[part], anchor[part], own[part], k, some)

    return run


def _blocks(placed: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of `place` with at most `most` rows each, from the sizes of the written partitions."""
    part = F.shiftright("place", PART).alias("part")
    sizes = sorted(placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
    ranges, first, held = [], None, 0
    for number, n in sizes:
        start = number << PART
        for row in range(0, n, most):
            here = min(most, n - row)
            if first is not None and held + here > most:
                ranges.append((first, start + row))
                first, held = None, 0
            first, held = start + row if first is None else first, held + here
    return [*ranges, (first, 1 << 62)] if first is not None else ranges


def _block_of(anchors: DataFrame, targets: DataFrame | None, scale: float, positives: int):
    """Anchors of a block as arrays; with targets, those that have any, with their limits."""
    held = anchors.toArrow().combine_chunks().sort_by("place")
    limits = least = np.zeros((held.num_rows, 1), np.int64)
    if targets is not None:
        wanted = targets.select("place", "limits", "least").toArrow().sort_by("place")
        held = held.take(np.searchsorted(held["place"].to_numpy(), wanted["place"].to_numpy()))
        limits = np.full((held.num_rows, positives), LEAST)
        for row, values in enumerate(wanted["limits"].to_pylist()):
            limits[row, : len(values)] = values
        least = wanted["least"].to_numpy()
    lists = held["embedding"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return held["place"].to_numpy(), held["vec_id"].to_numpy(), held["label"].to_numpy(), matrix(lists, scale), limits, least


def _merged(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The best of what tasks found; tasks limit ranks before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep)


def _searched(rows, anchors, targets, ranges, scale, keep, positives, low_high) -> DataFrame:
    """Block by block, written; blocks without work are skipped."""
    spark = rows.sparkSession
    found = spark.createDataFrame([], ROWS)
    for first, stop in ranges:
        inside = (F.col("place") >= first) & (F.col("place") < stop)
        block = _block_of(anchors.where(inside), targets and targets.where(inside), scale, positives)
        if len(block[0]):
            hits = rows.mapInArrow(_search(shared(spark, block), scale, keep, low_high), ROWS)
            found = found.union(settled(hits, "hard-negatives"))
    return found


def hard_negatives(
    embeddings: DataFrame,
    anchor: Column,
    *,
    scale: float = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """For each anchor and positive its hard negatives, ranked; `anchor` says which rows are anchors."""
    rows = usable(embeddings)
    anchors = settled(
        rows.where(anchor).withColumn("place", F.monotonically_increasing_id()), "anchors"
    )
    ranges = _blocks(anchors, block_anchors)

    # One more than asked for, since an anchor finds itself.
    found = _searched(rows, anchors, None, ranges, scale, positives + 1, positives, None)
    entry = F.struct((-F.col("score")).alias("down"), "id")
    itself = F.struct((-F.col("own")).alias("down"), F.col("anchor_id").alias("id"))
    tops = (
        _merged(found, ["place"], positives + 1)
        .groupBy("place", "anchor_id", "own")
        .agg(F.sort_array(F.collect_list(entry)).cast(ENTRIES).alias("tops"))
        .withColumn("self", F.array_position("tops", itself.cast("struct<down: bigint, id: bigint>")))
        .withColumn("tops", F.filter("tops", lambda _, i: i + 1 != F.col("self")))
        .select("place", "anchor_id", F.slice("tops", 1, positives).alias("tops"))
    )
    # A window is empty where its ends are the wrong way round, as with negative scores.
    wanted = F.filter("tops", lambda t: -t["down"] * low <= -t["down"] * high)
    targets = settled(
        tops.withColumn("wanted", wanted)
        .where(F.size("wanted") > 0)
        .select(
            "place",
            "anchor_id",
            "wanted",
            F.sort_array(
                F.array_distinct(F.transform("wanted", lambda t: -t["down"] * high)), asc=False
            ).alias("limits"),
            F.array_min(F.transform("wanted", lambda t: -t["down"] * low)).alias("least"),
        ),
        "hard-negative-limits",
    )

    found = _searched(rows, anchors, targets, ranges, scale, negatives, positives, (low, high))
    slots = (
        _merged(found, ["place", "slot"], negatives)
        .groupBy("place")
        .agg(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id")).alias("held"))
    )

    def with_slot(done: Column, slot: Column) -> Column:
        """Puts the slot, merged with the one below it, before those done."""
        inside = F.filter("held", lambda h: h["slot"] == slot)
        own = F.transform(inside, lambda h: F.struct(h["down"].alias("down"), h["id"].alias("id")))
        merged = F.slice(F.sort_array(F.concat(own.cast(ENTRIES), done[0])), 1, negatives)
        return F.concat(F.array(merged), done)

    nothing = F.array(F.array().cast(ENTRIES))
    upward = F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1))
    answers = targets.join(slots, "place").withColumn("merged", F.aggregate(upward, nothing, with_slot))
    positive = answers.select("anchor_id", "limits", "merged", F.explode("wanted").alias("p"))
    score = -F.col("p.down")
    below = F.element_at("merged", F.array_position("limits", score * high).cast("int"))
    return (
        positive.withColumn("inside", F.filter(below, lambda n: -n["down"] * 100 >= score * low))
        .select("anchor_id", "p", F.posexplode("inside").alias("at", "n"))
        .select(
            "anchor_id",
            F.col("p.id").alias("positive_id"),
            (F.col("at") + 1).alias("rank"),
            F.col("n.id").alias("negative_id"),
            (-F.col("p.down")).alias("positive_score"),
            (-F.col("n.down")).alias("negative_score"),
        )
    )
