"""Benchmark decontamination by a Wu-Manber search over words.

Patterns are windows of `window` consecutive words of a benchmark item (an item of fewer words,
but not none, is one pattern). Documents and patterns are sequences of vocabulary numbers, 0 for
words that no item has. Patterns of one length are searched together: a shift table over blocks
of up to three words tells how far the search may jump, the block at a pattern's end selects its
bucket of patterns, the words of a candidate are compared, and the bytes of both confirm it.
Many short lanes of text advance at once, so that a step is one numpy call.

Defined cases: a null or empty text has no words; a null or empty item has no pattern and an item
without an id is never listed; items with equal texts are all listed; repeated rows of `docs` are
judged one by one, whatever the size of the benchmark; an empty benchmark marks nothing; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settled, shared
from .textbytes import Words, column_bytes, letters_and_digits, mix, steps, words_of

WINDOW = 10
# Texts of a benchmark that one search holds in memory; a larger benchmark is searched in parts.
PART_BYTES = 16 << 20
LANE_WORDS = 64
TABLE_BITS = 18

HITS = "doc_id long, n_words long, n_hit long, items array<long>, starts array<long>, ends array<long>"


@dataclass
class Length:
    """The patterns of one length: symbols, texts, items, and the tables of the search."""

    size: int
    block: int
    symbols: np.ndarray
    texts: list[bytes]
    items: list[list[int]]
    shift: np.ndarray
    bucket_first: np.ndarray
    bucket: np.ndarray


@dataclass
class Patterns:
    vocabulary: np.ndarray
    seen: np.ndarray
    lengths: list[Length]


def _blocks(symbols: np.ndarray, block: int) -> np.ndarray:
    """Table slots of the blocks that end at each place, along the last axis."""
    total = np.zeros(symbols[..., block - 1 :].shape, np.uint64)
    for k in range(block):
        last = symbols.shape[-1] - block + 1 + k
        total = mix(total + symbols[..., k:last].astype(np.uint64) + np.uint64(k + 1))
    return (total >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _length(size: int, found: dict[bytes, tuple[np.ndarray, set[int]]]) -> Length:
    block = min(size, 3)
    texts = sorted(found)
    symbols = np.stack([found[t][0] for t in texts]).astype(np.int32)
    slots = _blocks(symbols, block)
    shift = np.full(1 << TABLE_BITS, size - block + 1, np.int32)
    for k in range(slots.shape[1]):
        np.minimum.at(shift, slots[:, k], slots.shape[1] - 1 - k)
    order = np.argsort(slots[:, -1], kind="stable")
    first = np.searchsorted(slots[order, -1], np.arange((1 << TABLE_BITS) + 1)).astype(np.int32)
    return Length(
        size, block, symbols, texts, [sorted(found[t][1]) for t in texts], shift, first, order
    )


def patterns_of(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> Patterns:
    """The search tables of (item_id, text) rows."""
    ids = [i for i, _ in items]
    data, offsets = column_bytes(pa.array([t for _, t in items], pa.string()))
    words = words_of(data, offsets, letters_and_digits())
    vocabulary = np.unique(words.hashes)
    symbols = np.searchsorted(vocabulary, words.hashes) + 1
    found: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    for row, item in enumerate(ids):
        first, last = int(words.rows[row]), int(words.rows[row + 1])
        size = min(window, last - first)
        for at in range(first, last - size + 1 if size else first):
            text = words.text(at, at + size)
            entry = found.setdefault(size, {}).setdefault(text, (symbols[at : at + size], set()))
            if item is not None:
                entry[1].add(item)
    seen = np.zeros(1 << 16, bool)
    seen[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    return Patterns(vocabulary, seen, [_length(size, f) for size, f in sorted(found.items())])


def _symbols(words: Words, patterns: Patterns) -> np.ndarray:
    """Vocabulary numbers of all words; unknown words are 0."""
    out = np.zeros(len(words.hashes), np.int32)
    maybe = np.flatnonzero(patterns.seen[(words.hashes >> np.uint64(48)).astype(np.int64)])
    if len(maybe):
        hashes = words.hashes[maybe]
        at = np.minimum(np.searchsorted(patterns.vocabulary, hashes), len(patterns.vocabulary) - 1)
        known = patterns.vocabulary[at] == hashes
        out[maybe[known]] = at[known] + 1
    return out


def _ends(symbols: np.ndarray, length: Length) -> np.ndarray:
    """Places whose block ends some pattern, found by jumping lanes."""
    slots = _blocks(symbols, length.block)
    first = length.size - length.block
    places = np.arange(first, len(slots), LANE_WORDS)
    stops = np.minimum(places + LANE_WORDS, len(slots))
    out = []
    while len(places):
        shift = length.shift[slots[places]]
        out.append(places[shift == 0])
        places = places + np.maximum(shift, 1)
        alive = places < stops
        places, stops = places[alive], stops[alive]
    return np.concatenate(out) + length.block - 1 if out else np.zeros(0, np.int64)


def occurrences(words: Words, patterns: Patterns) -> Iterator[tuple[int, Length, int]]:
    """(first word, length, pattern) of every occurrence, each confirmed on the bytes."""
    if not len(patterns.vocabulary) or not len(words.hashes):
        return
    symbols = _symbols(words, patterns)
    row_of = np.searchsorted(words.rows, np.arange(len(symbols)), side="right")
    for length in patterns.lengths:
        if len(symbols) < length.size:
            continue
        ends = _ends(symbols, length)
        slots = _blocks(symbols, length.block)[ends - length.block + 1]
        counts = length.bucket_first[slots + 1] - length.bucket_first[slots]
        starts = np.repeat(ends - length.size + 1, counts)
        within = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
        pattern = length.bucket[np.repeat(length.bucket_first[slots], counts) + within]
        keep = row_of[starts] == row_of[starts + length.size - 1]
        for k in range(length.size):
            starts, pattern = starts[keep], pattern[keep]
            keep = symbols[starts + k] == length.symbols[pattern, k]
        starts, pattern = starts[keep], pattern[keep]
        for start, number in zip(starts.tolist(), pattern.tolist(), strict=True):
            if words.text(start, start + length.size) == length.texts[number]:
                yield start, length, number


def hits_of(words: Words, patterns: Patterns) -> tuple[np.ndarray, list[set[int]]]:
    """Whether each word lies in an occurrence, and the items found in each row."""
    rows = len(words.rows) - 1
    change = np.zeros(len(words.starts) + 1, np.int32)
    items: list[set[int]] = [set() for _ in range(rows)]
    for start, length, number in occurrences(words, patterns):
        change[start] += 1
        change[start + length.size] -= 1
        if length.items[number]:
            row = int(np.searchsorted(words.rows, start, side="right")) - 1
            items[row].update(length.items[number])
    return np.cumsum(change[:-1]) > 0, items


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in parts of bounded size, read one after the other."""
    part, held = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        part.append((item, text))
        held += len(text or "")
        if held >= PART_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def _spans(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs`: n_words, n_hit, the items found, and the hit runs [start, end) of words."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def search(tables):
        def run(batches):
            patterns = tables()
            for batch in batches:
                data, offsets = column_bytes(batch.column(1))
                out = []
                for first, last in steps(offsets):
                    words = words_of(data, offsets[first : last + 1], letters_and_digits())
                    hit, items = hits_of(words, patterns)
                    for row in range(last - first):
                        own = hit[words.rows[row] : words.rows[row + 1]]
                        starts, ends = _spans(own) if own.any() else ([], [])
                        out.append((len(own), int(own.sum()), sorted(items[row]), starts, ends))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)]
                    + [
                        pa.array([o[k] for o in out], kind)
                        for k, kind in enumerate(
                            [pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * 3
                        )
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "starts", "ends"],
                )

        return run

    parts = _parts(benchmark)
    part, following = next(parts, []), next(parts, None)
    if following is None:
        return source.mapInArrow(search(shared(spark, patterns_of(part, window))), HITS)
    # Each part is a pass of its own over numbered rows, so that one part's tables exist at a time.
    rows = settled(source.withColumn("row", F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.col("row").alias("doc_id"), "text")
    found = None
    while part is not None:
        hits = numbered.mapInArrow(search(shared(spark, patterns_of(part, window))), HITS)
        hits = settled(hits if found is None else hits.where("n_hit > 0"), "hits")
        found = hits if found is None else found.unionAll(hits)
        part, following = following, next(parts, None)
    return _merged(found, rows)


def _united(batches):
    """Joins the runs of the parts of each row; runs that touch become one."""
    for batch in batches:
        out = []
        for places in batch.column(3).to_pylist():
            starts, ends = [], []
            for start, end in sorted(pair for p in places for pair in zip(p["starts"], p["ends"], strict=True)):
                if ends and start <= ends[-1]:
                    ends[-1] = max(ends[-1], end)
                else:
                    starts.append(start)
                    ends.append(end)
            out.append((sum(ends) - sum(starts), starts, ends))
        n_hit, starts, ends = ([o[k] for o in out] for k in range(3))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(n_hit, pa.int64()),
                batch.column(2),
                pa.array(starts, pa.list_(pa.int64())),
                pa.array(ends, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_words", "n_hit", "items", "starts", "ends"],
        )


def _merged(found: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per row of `rows` from searches of several parts; `found` has row numbers as doc_id."""
    grouped = found.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.collect_list(F.struct("starts", "ends")).alias("places"),
    )
    merged = grouped.mapInArrow(_united, HITS).withColumnRenamed("doc_id", "row")
    return rows.select("row", "doc_id").join(merged, "row").drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The report of each document: counts, the items' digest, and whether any word is hit."""
    listed = F.array_sort(F.transform("items", lambda item: item.cast("string")))
    return benchmark_hits(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns as they are, that hold no pattern."""
    spark, place = docs.sparkSession, docs.columns.index("text")
    kept = docs
    for part in _parts(benchmark):
        tables = shared(spark, patterns_of(part, window))

        def run(batches, tables=tables):
            patterns = tables()
            for batch in batches:
                data, offsets = column_bytes(batch.column(place))
                clean = []
                for first, last in steps(offsets):
                    words = words_of(data, offsets[first : last + 1], letters_and_digits())
                    hit, _ = hits_of(words, patterns)
                    counts = np.concatenate([[0], np.cumsum(hit)])[words.rows]
                    clean.append(np.diff(counts) == 0)
                if clean:
                    yield batch.filter(pa.array(np.concatenate(clean)))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def items_digest(items: list[int]) -> str:
    """items_sha256 of a list of item ids."""
    return hashlib.sha256(",".join(sorted(map(str, set(items)))).encode()).hexdigest()
