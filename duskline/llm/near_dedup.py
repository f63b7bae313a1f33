"""Near-duplicate groups by HyperMinHash registers.

A document's set holds its distinct five-word shingles. Register k keeps, of the smallest k-th hash
of the set, the number of leading zeros and the next bits (6 + 10 bits); every register has a hash
function of its own, so that short documents fill all of them. Bands of five registers propose
pairs, the share of equal registers, corrected for chance collisions, drops far pairs, and the
full sets confirm the rest.

Groups of equal sets are reduced to their smallest doc_id first. Then the members of a bucket are
compared with its hub only, the member that meets most others in all buckets: of copies edited from
one original, that is the original. Components are formed. Where a bucket still has several, its
members are compared by their registers, those of different components and of sizes that allow the
similarity; a large bucket is cut into blocks, and a task compares two of them, each pair in the
first band that it shares. Members with a high estimate get their full sets, and again only links
leave the task. So no proposed link is lost, a large group of copies costs one comparison per member
and band, and texts that merely share a passage cost comparisons inside tasks but no rows.

A pair at similarity 0.75 escapes all 40 bands with probability (1 - 0.75^5)^40 = 2e-5, and an
estimate below 0.6 with 200 registers has a probability of about 5e-7.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing; rows
that repeat a doc_id share a component with each other's links; a row without doc_id takes the
component of an equal set, or null, and is kept only in the latter case; other columns are ignored.
`drop_near_copies` links and drops single rows instead, by numbers of its own: of each component it
keeps one row, that of the smallest doc_id, and one without doc_id only where no other row has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import settled
from .textbytes import column_bytes, mix, not_space, shingle_hashes, steps, words_of

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
SHINGLE = 5
# Pairs with an estimate below this are not verified.
ESTIMATE = 0.6
# A representative's set is sent to one more task for so many of its partners.
PARTNERS = 256
# Members of a bucket that are compared at once with as many others.
BLOCK = 256
# Ids of pairs that are broadcast to find their texts, beyond which they are joined.
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(20240101)
_FACTORS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def registers_of(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS, uint16) of sets that each have at least one hash."""
    out = np.empty((len(firsts) - 1, REGISTERS), np.uint16)
    for k in range(REGISTERS):
        value = (hashes ^ _MASKS[k]) * _FACTORS[k]
        value ^= value >> np.uint64(32)
        value *= _FACTORS[REGISTERS - 1 - k]
        out[:, k] = compress(np.minimum.reduceat(value, firsts[:-1]))
    return out


def compress(values: np.ndarray) -> np.ndarray:
    """Leading-zero count and the bits after the first one, in 16 bits."""
    value = values.copy()
    zeros = np.zeros(len(value), np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        low = value < np.uint64(1 << (64 - width))
        zeros[low] += np.uint64(width)
        value[low] <<= np.uint64(width)
    bits = (value << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((np.minimum(zeros, np.uint64(63)) << np.uint64(MANTISSA)) | bits).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, without the share that collides by chance.

    Two independent minima agree in zeros and mantissa with probability about 2^-MANTISSA / 3.
    """
    chance = 2.0**-MANTISSA / 3
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key per row and band."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    value = np.arange(1, BANDS + 1, dtype=np.uint64) + np.zeros((len(registers), 1), np.uint64)
    for k in range(ROWS):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return value.view(np.int64)


def _sets(data, offsets):
    """Sorted distinct shingle hashes of the rows: hashes and first places."""
    words = words_of(data, offsets, not_space())
    hashes, firsts = shingle_hashes(words, SHINGLE)
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(firsts)))


def _sketches(batches):
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for first, last in steps(offsets):
            hashes, firsts = _sets(data, offsets[first : last + 1])
            sizes = np.diff(firsts)
            full = np.flatnonzero(sizes > 0)
            registers: list = [None] * (last - first)
            digests: list = [None] * (last - first)
            if len(full):
                found = registers_of(hashes, np.append(firsts[:-1][full], firsts[-1]))
                sums = np.add.reduceat(mix(hashes), firsts[:-1][full])
                others = np.bitwise_xor.reduceat(mix(hashes + np.uint64(7)), firsts[:-1][full])
                for k, row in enumerate(full.tolist()):
                    registers[row] = found[k].tobytes()
                    digests[row] = sums[k].tobytes() + others[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(registers, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "registers"],
            )


def _set_rows(batches):
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for first, last in steps(offsets):
            hashes, firsts = _sets(data, offsets[first : last + 1])
            sets = [hashes[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), pa.array(sets, pa.large_binary()).cast(pa.binary())],
                names=["doc_id", "hashes"],
            )


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
        keys = band_keys(flat.reshape(-1, REGISTERS))
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        numbers = np.tile(np.arange(BANDS, dtype=np.int32), len(keys))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(numbers), pa.array(keys.ravel())], names=["b", "number", "band"]
        )


def _near(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
        keep = pa.array(estimate(a, b) >= ESTIMATE)
        yield batch.select(["a", "b"]).filter(keep)


def _candidates(table: pa.Table, percent: int):
    """Pairs of rows of one or two blocks of a bucket that may be similar, a row and its partners.

    Their components differ, their sizes allow the similarity, their estimate is high, and this is
    the first band that they share.
    """
    group, size, block = (table.column(k).to_numpy() for k in ("c", "size", "x"))
    registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    number, within = table.column("number")[0].as_py(), table.column("i")[0] == table.column("j")[0]
    for k in range(len(group) - 1):
        rest = slice(k + 1, len(group))
        low, high = np.minimum(size[k], size[rest]), np.maximum(size[k], size[rest])
        wanted = (group[rest] != group[k]) & (100 * low >= percent * high)
        if not within:
            wanted &= block[rest] != block[k]
        at = k + 1 + np.flatnonzero(wanted)
        near = at[estimate(registers[at], registers[k]) >= ESTIMATE] if len(at) else at
        if len(near):
            same = (registers[near] == registers[k]).reshape(len(near), BANDS, ROWS).all(axis=2)
            near = near[same.argmax(axis=1) == number]
        if len(near):
            yield k, near


def _involved(percent: int):
    """The rows of a bucket's blocks that are in such a pair."""

    def run(table: pa.Table) -> pa.Table:
        taken = np.zeros(table.num_rows, bool)
        for k, near in _candidates(table, percent):
            taken[k] = taken[near] = True
        return table.filter(pa.array(taken))

    return run


def _linked(percent: int):
    """The pairs among these rows whose full sets are similar."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("b").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("hashes")]
        a, b = [], []
        for k, near in _candidates(table, percent):
            for other in near.tolist():
                both = len(np.intersect1d(sets[k], sets[other], assume_unique=True))
                if 100 * both >= percent * (len(sets[k]) + len(sets[other]) - both):
                    a.append(min(ids[k], ids[other]))
                    b.append(max(ids[k], ids[other]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p = np.frombuffer(x.as_buffer(), np.uint64)
                q = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _attach(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Adds the values of both ends; an end with many partners is repeated per salt."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    left = rows.join(many, rows["doc_id"] == many["a"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col(value).alias("x")
    )
    right = rows.select(F.col("doc_id").alias("b"), F.col(value).alias("y"))
    return salted.select("a", "b", "salt").join(right, "b").join(left, ["a", "salt"]).select("a", "b", "x", "y")


def _sets_of(ids: DataFrame, source: DataFrame) -> DataFrame:
    """The full sets of some documents (doc_id)."""
    ids = settled(ids.distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = source.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return settled(chosen.mapInArrow(_set_rows, "doc_id long, hashes binary"), "sets")


def _verify(near: DataFrame, source: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    ends = near.select(F.col("a").alias("doc_id")).unionAll(near.select(F.col("b").alias("doc_id")))
    return _attach(near, _sets_of(ends, source), "hashes").mapInArrow(_confirmed(percent), "a long, b long")


def _hubs(members: DataFrame) -> DataFrame:
    """Per bucket the member that meets most others in all its buckets, the smallest id on a tie."""
    met = members.groupBy("b").agg(F.sum(F.col("n") - 1).alias("met"))
    best = F.max(F.struct("met", (-F.col("b")).alias("id"))).alias("best")
    hubs = members.join(met, "b").groupBy("band").agg(best)
    return hubs.select("band", (-F.col("best.id")).alias("a"))


def _across(
    members: DataFrame, groups: DataFrame, reps: DataFrame, source: DataFrame, percent: int
) -> DataFrame:
    """Links between different components in buckets that hold several.

    Registers tell which members may be similar to another; only these get their full sets.
    """
    grouped = members.join(groups, members["b"] == groups["node"], "left")
    named = grouped.select("band", "number", "b", F.coalesce("component", "b").alias("c"))
    mixed = named.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    mixed = mixed.where("lo <> hi and n > 2").select("band", blocks)
    known = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("size"), "registers")
    x, y = F.col("x"), F.col("y")
    rows = (
        named.join(mixed, "band")
        .withColumn("x", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
        .join(known, "b")
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "number", "b", "c", "size", "x", F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), "registers")
    )
    cell = ["band", "i", "j"]
    involved = settled(rows.groupBy(*cell).applyInArrow(_involved(percent), rows.schema), "involved")
    sets = _sets_of(involved.select(F.col("b").alias("doc_id")), source)
    held = involved.join(sets.withColumnRenamed("doc_id", "b"), "b")
    return held.groupBy(*cell).applyInArrow(_linked(percent), "a long, b long")


def near_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs`."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = settled(
        source.mapInArrow(_sketches, "doc_id long, n_shingles long, digest binary, registers binary"), "sketches"
    )
    full = sketches.where("digest is not null and doc_id is not null")
    firsts = [F.first(name).alias(name) for name in ("n_shingles", "registers")]
    classes = settled(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), *firsts), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "registers")
    bands = reps.select("doc_id", "registers").mapInArrow(_bands, "b long, number int, band long")
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = settled(bands.join(sizes, "band"), "members")

    star = members.join(_hubs(members), "band").where("a <> b")
    pairs = settled(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    near = _attach(pairs, reps, "registers").mapInArrow(_near, "a long, b long")
    first = settled(_verify(settled(near, "near"), source, percent), "links")
    groups = settled(components(first), "groups")
    across = _across(members, groups, reps, source, percent)
    links = settled(first.unionAll(across), "all-links")
    final = components(links)
    reps_of = classes.select("digest", "rep")
    return (
        sketches.join(reps_of, "digest", "left")
        .join(final, F.col("rep") == F.col("node"), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "rep", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component of near copies, all columns as they are."""
    row, own = (_free(name, docs.columns) for name in ("row", "id"))
    rows = settled(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_groups(rows.select(F.col(row).alias("doc_id"), "text"), percent)
    groups = groups.select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, F.col("doc_id").cast("long").alias(own))
    # Null ids come last; rows of one id go by their numbers.
    least = F.min(F.struct(F.col(own).isNull().alias("none"), own, row))
    kept = ids.join(groups, row).groupBy("component_id").agg(least.alias("first")).select(f"first.{row}")
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name = f"_{name}"
    return name
