"""Shards as runs along a Hilbert curve through several metadata columns.

Every dimension is cut into 2^bits cells that hold about as many rows each: its values are counted and
sorted as a distributed table, and a running count says which cell a value is in. The cells of a row are
a point on a grid, and the place of that point on the Hilbert curve, whose neighbours are neighbours in
every dimension, is the row's sort key. Rows are sorted by it and cut into runs of equal counts: the law
is `rows`, counts differ by at most one. A run covers small ranges of all dimensions at once, so the
statistics of its files let a reader skip it for a filter on any of them.

Ranks are exact and come from two passes without a global sort in one task: rows are sorted by range
partitions and written, each row with its place in its partition; the sizes of the partitions, one row
each, say how many rows come before.

All is DataFrame code without Python workers. To the driver come the sizes of partitions, and at most
2^bits values of each dimension.

Defined cases: a null text has no bytes, so its size is 1, and its CRC is that of an empty text; a null in
a dimension is in the lowest cell; rows that repeat an id, or whole rows, are
placed one by one; with fewer rows than shards some shards are empty; an empty table gives no rows;
columns with clashing names are carried along by `write_shards` and otherwise ignored. Equal texts with
equal metadata lie next to each other in a run, and apart only where the run is cut: a law of equal counts
cannot keep a group together that is larger than a shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled

SHARDS = 16
DIMENSIONS = ("lang", "source", "bytes")
BITS = 5  # 32 cells a dimension
LAW = "rows"
PART = 33  # bits of monotonically_increasing_id below the partition


def hilbert_steps(dimensions: int) -> list[int]:
    """What a curve of that many dimensions does at each level: next state << dimensions | part visited.

    A state is the corner at which the curve enters a cube and the axis along which it leaves; the entry
    for state s and the half the point lies in along each axis is at s << dimensions | halves.
    """
    n, whole = dimensions, (1 << dimensions) - 1

    def turned(value: int, by: int) -> int:
        by %= n
        return (value << by | value >> (n - by)) & whole

    def gray(k: int) -> int:
        return k ^ k >> 1

    def order(code: int) -> int:
        found = 0
        while code:
            found, code = found ^ code, code >> 1
        return found

    def ones(k: int) -> int:
        return ((k ^ (k + 1)).bit_length() - 1) % n

    steps = []
    for state in range(n << n):
        corner, axis = divmod(state, n)
        for halves in range(1 << n):
            part = order(turned(halves ^ corner, -axis - 1))
            inner = gray((part - 1) // 2 * 2) if part else 0
            leaves = 0 if not part else ones(part) if part & 1 else ones(part - 1)
            entered = corner ^ turned(inner, axis + 1)
            steps.append((entered * n + (axis + leaves + 1) % n) << n | part)
    return steps


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """The place on the curve of a point on a grid of 2^bits cells along each axis."""
    n = len(cells)
    steps = F.lit(hilbert_steps(n)).cast("array<int>")

    def half(cell: Column, axis: int, level: Column) -> Column:
        return F.shiftleft(F.call_function("shiftright", cell.cast("int"), level).bitwiseAND(1), axis)

    def down(done: Column, level: Column) -> Column:
        halves = F.lit(0)
        for axis, cell in enumerate(cells):
            halves = halves.bitwiseOR(half(cell, axis, level))
        step = F.get(steps, F.shiftleft(done["state"], n).bitwiseOR(halves))
        place = F.shiftleft(done["place"], n).bitwiseOR(step.bitwiseAND((1 << n) - 1).cast("long"))
        return F.struct(F.shiftright(step, n).alias("state"), place.alias("place"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("place"))
    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(levels, start, down, lambda done: done["place"])


def _ranked(rows: DataFrame, order: Sequence[str], columns: Sequence[str], name: str) -> tuple[DataFrame, Column, list[int]]:
    """The rows written in order; the number of a row's partition; the rows of each partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().alias("_place")
    placed = settled(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*columns, place), name
    )
    part = F.shiftright("_place", PART).cast("int")
    found = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = [0] * (1 + max((r["part"] for r in found), default=0))
    for r in found:
        sizes[r["part"]] = r["n"]
    return placed, part, sizes


def _before(sizes: Sequence[int], part: Column) -> Column:
    """What all partitions before hold; one literal, however many there are."""
    sums = [0, *accumulate(sizes)]
    return F.get(F.split(F.lit(",".join(map(str, sums))), ",").cast("array<bigint>"), part)


def cell_starts(rows: DataFrame, column: str, bits: int) -> list[tuple[object, int]]:
    """The lowest value of each cell that has values, in order, and the cell; cells hold about as many
    rows each, and a value lies in the cell that the middle of its rows falls in.

    Values are counted and sorted as a distributed table; only the starts come to the driver.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    placed, part, _ = _ranked(counts, [column], [column, "n"], "shard-values")
    held = placed.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).collect()
    sizes = [0] * (1 + max((r["part"] for r in held), default=0))
    for r in held:
        sizes[r["part"]] = r["n"]
    total = max(sum(sizes), 1)
    here = Window.partitionBy(part).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    seen = _before(sizes, part) + F.coalesce(F.sum("n").over(here), F.lit(0))
    cell = F.floor((2 * seen + F.col("n")) / (2 * total) * (1 << bits))
    starts = placed.withColumn("cell", cell).groupBy("cell").agg(F.min(column).alias("start"))
    return sorted(((r["start"], r["cell"]) for r in starts.collect()), key=lambda s: s[1])


def _cell(value: Column, starts: Sequence[tuple[object, int]]) -> Column:
    """The cell of the last start that is at most the value; 0 for null."""
    if not starts:
        return F.lit(0)
    reached = F.size(F.filter(F.array(*[F.lit(s) for s, _ in starts]), lambda s: s <= value))
    return F.coalesce(F.get(F.lit([int(c) for _, c in starts]), reached - 1), F.lit(0))


def _free(name: str, columns: Sequence[str]) -> str:
    while name in columns:
        name = f"_{name}"
    return name


def sharded(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    dimensions: Sequence[str] = DIMENSIONS,
    bits: int = BITS,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Every row with its shard and its slot there, in the order of the curve, and `columns` of it.

    Dimensions are columns of any type with an order, or `bytes`, the size of the text.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    names = [f"_d{k}" for k in range(len(dimensions))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_doc_id"),
        (size + 1).alias("_size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("_crc32"),
        *[(size if d == "bytes" else F.col(d)).alias(name) for d, name in zip(dimensions, names, strict=True)],
        *columns,
    )
    # Without texts to carry along, they are read once.
    rows = rows if columns else settled(rows, "shard-metadata")
    cells = [_cell(F.col(name), cell_starts(rows, name, bits)) for name in names]
    pointed = rows.withColumns({f"_c{k}": cell for k, cell in enumerate(cells)})
    curve = hilbert_index([F.col(f"_c{k}") for k in range(len(cells))], bits)
    # The row's number in the scan splits wholly equal rows between partitions.
    keyed = pointed.withColumn("_curve", curve).withColumn("_scan", F.monotonically_increasing_id())
    order = ["_curve", *names, "_crc32", "_doc_id", "_scan"]
    kept = ["_doc_id", "_size", "_crc32", "_curve", *columns]
    placed, part, sizes = _ranked(keyed, order, kept, "sharded")
    total = max(sum(sizes), 1)
    rank = _before(sizes, part) + F.col("_place").bitwiseAND((1 << PART) - 1)
    shard = F.expr(f"_rank * {shards} div {total}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("_rank", rank)
        .withColumn("_shard", shard)
        .select(
            F.col("_doc_id").alias("doc_id"),
            F.col("_size").alias("size"),
            F.col("_crc32").alias("text_crc32"),
            F.lit(LAW).alias("law"),
            F.col("_shard").cast("int").alias("shard"),
            (F.col("_rank") - first).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("_curve").alias("curve"),
            *columns,
        )
    )


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the table as Parquet, a folder for each shard, its rows in the order of the curve.

    All columns are kept, and `shard` and `slot` added, with underscores before a name that is taken.
    Filters on the dimensions skip files by their statistics.
    """
    whole, shard, slot = (_free(name, docs.columns) for name in ("row", "shard", "slot"))
    placed = sharded(docs.withColumn(whole, F.struct(*docs.columns)), columns=[whole], **options)
    out = placed.select(f"{whole}.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    # The rows come in order, so a task has those of few shards.
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)
