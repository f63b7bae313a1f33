"""Best-fit packing of tokenised documents into sequences by bin completion.

Pieces are counted by length, which is a table of at most `capacity` rows however many documents
there are, and the packing is found on these counts: around the largest length that is left, the
undominated fillings are enumerated, the fullest first; a filling is used as often as the counts
allow. A waste bound prunes branches that cannot beat the incumbent, which starts as the best-fit
solution. Pieces get ranks within their length from salted counts, and ranks give sequence and offset.

Defined cases: a null or empty text is the end token alone; rows that repeat a doc_id are packed one
by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled, shared

CAPACITY = 2048
END = 0
# Steps of one enumeration of fillings, and of the search over bins.
FILL_STEPS, SEARCH_STEPS = 3000, 6000
BRANCHES = 3
CACHE = 1 << 19
LONG_RUN = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Pieces of one length that one task ranks, about.
RANKED = 100_000


class _Ids(dict):
    """Ids of a word as the tokenizer splits texts, looked up once."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = tuple(self.encode(word))
        return found


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    own = [b for b in range(256) if b != 32 and chr(b).isprintable()]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(other)}


def merge_ranks(vocabulary: str) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, or None where the order of merges is not that of the ids."""
    model = json.loads(vocabulary)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    letters = _byte_of()
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or not letters.keys() <= model["vocab"].keys():
        return None
    parts = dict.fromkeys([*letters, *(a + b for a, b in merges)])
    return {bytes(letters[c] for c in token): model["vocab"][token] for token in parts}


def encoder(vocabulary: str, pattern: str, special: bool = False):
    """Text to ids; `vocabulary` is the tokenizer's JSON and `pattern` its way to split texts.

    With `special`, as the tokenizer does by default, strings of special tokens inside texts are
    these tokens; else they are plain text.

    Ids come from the vocabulary's merge ranks. Texts with a run of over `LONG_RUN` characters
    without a change between white space and others are split and looked up word by word, as are
    all texts where the vocabulary has no such ranks; the ids are the same.
    """
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    words = regex.compile(pattern)
    long_run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")
    ids = _Ids(lambda word: tokenizer.encode(word, add_special_tokens=False).ids)
    ranks = merge_ranks(vocabulary)
    ranked = ranks and tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if ranked and not (len(text) >= LONG_RUN and long_run.search(text)):
            return np.array(ranked.encode_ordinary(text), np.uint32)
        return np.fromiter(chain.from_iterable(map(ids.__getitem__, words.findall(text))), np.uint32)

    added = {t["content"]: t["id"] for t in json.loads(vocabulary).get("added_tokens") or []} if special else {}
    if not added:
        return encode
    strings = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")

    def encode_special(text: str) -> np.ndarray:
        parts = strings.split(text)
        if len(parts) == 1:
            return encode(text)
        return np.concatenate([np.array([added[p]], np.uint32) if k % 2 else encode(p) for k, p in enumerate(parts)])

    return encode_special


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: where they start, their length and the CRC of their ids."""
    tables = shared(docs.sparkSession, (vocabulary, pattern))

    def run(batches):
        encode = encoder(*tables(), special=True)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                stops = list(range(len(ids), 0, -capacity))[::-1]
                start = 0
                for k, stop in enumerate(stops):
                    rows.append((doc, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start = stop
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


Pattern = tuple[int, ...]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by total length, and by pieces that cannot share a sequence."""
    total = math.ceil(sum(k * n for k, n in counts.items()) / capacity)
    best = total
    for small in (1, capacity // 8, capacity // 4, capacity // 3):
        alone = sum(n for k, n in counts.items() if k > capacity - small)
        large = [(k, n) for k, n in counts.items() if capacity // 2 < k <= capacity - small]
        middle = sum(k * n for k, n in counts.items() if small <= k <= capacity // 2)
        held = sum(n for _, n in large)
        room = held * capacity - sum(k * n for k, n in large)
        best = max(best, alone + held + max(0, math.ceil((middle - room) / capacity)))
    return best


def _dominated(a: Pattern, b: Pattern) -> bool:
    """Whether every part of `a` has a part of `b` at least as large."""
    return len(a) <= len(b) and all(x <= y for x, y in zip(a, b, strict=False))


def fillings(lengths: list[int], counts: dict[int, int], room: int) -> list[Pattern]:
    """Undominated ways to fill `room`, the fullest first; stops at a complete one."""
    found: list[tuple[int, Pattern]] = []
    best, steps = -1, 0

    def extend(part: list[int], top: int, left: int) -> bool:
        nonlocal best, steps
        steps += 1
        at = min(top, bisect_right(lengths, left)) - 1
        if at < 0:
            full = room - left
            if full > best - room // 16:
                found.append((full, tuple(part)))
                best = max(best, full)
            return left == 0
        if lengths[at] == left and part.count(left) < counts[left]:
            best = room
            found.append((room, (*part, left)))
            return True
        grown = False
        while at >= 0 and steps < FILL_STEPS:
            k = lengths[at]
            if part.count(k) < counts[k]:
                grown = True
                part.append(k)
                done = extend(part, at + 1, left - k)
                part.pop()
                if done:
                    return True
            at -= 1
        if not grown:
            found.append((room - left, tuple(part)))
            best = max(best, room - left)
        return left == 0

    extend([], len(lengths), room)
    found.sort(key=lambda f: (-f[0], len(f[1]), f[1]))
    kept: list[Pattern] = []
    for _, part in found:
        if part not in kept and not any(_dominated(part, other) for other in kept):
            kept.append(part)
            if len(kept) == BRANCHES:
                break
    return kept or [()]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Decreasing best fit on counts: the largest length with the largest ones that still fit."""
    counts, plan = dict(counts), []
    while counts:
        part, left = [], capacity
        for k in sorted(counts, reverse=True):
            take = min(counts[k], left // k)
            part += [k] * take
            left -= k * take
        plan.append(_use(tuple(part), counts))
    return plan


def _use(part: Pattern, counts: dict[int, int]) -> tuple[Pattern, int]:
    """Takes a pattern as often as the counts allow."""
    need = {k: part.count(k) for k in set(part)}
    times = min(counts[k] // n for k, n in need.items())
    for k, n in need.items():
        counts[k] -= n * times
        if not counts[k]:
            del counts[k]
    return part, times


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(lengths of one sequence, how many such sequences), over all counted pieces."""
    incumbent = best_fit(counts, capacity)
    bins = sum(t for _, t in incumbent)
    least = least_bins(counts, capacity)
    # (counts left, sequences so far, patterns as a linked list); the fullest filling comes first.
    stack: list[tuple] = [(dict(counts), 0, None)]
    steps = 0
    while stack and bins > least and steps < SEARCH_STEPS:
        left, used, plan = stack.pop()
        steps += 1
        if not left:
            if used < bins:
                bins, incumbent = used, []
                while plan:
                    incumbent.append(plan[0])
                    plan = plan[1]
            continue
        if used + least_bins(left, capacity) >= bins:
            continue
        lengths = sorted(left)
        top = lengths[-1]
        rest = dict(left)
        rest[top] -= 1
        if not rest[top]:
            lengths.pop()
        for part in reversed(fillings(lengths, rest, capacity - top)):
            after = dict(left)
            entry = _use((top, *part), after)
            stack.append((after, used + entry[1], (entry, plan)))
    return incumbent


def _segments(plan: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first ranks, first sequences and offsets of runs of ranks."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for part, times in plan:
        offset = 0
        for k in part:
            rows.setdefault(k, []).append((taken.get(k, 0), sequence, offset))
            taken[k] = taken.get(k, 0) + times
            offset += k
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for k, r in rows.items()}


def _placed(tables):
    def run(batches):
        segments = tables()
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                own = length == k
                first, begin, place = segments[k]
                at = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own] = begin[at] + rank[own] - first[at]
                offset[own] = place[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return run


def packed(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    found = settled(pieces(docs, vocabulary, pattern, capacity), "pieces")
    counts = {int(k): int(n) for k, n in found.groupBy("length").count().collect()}
    tables = shared(docs.sparkSession, _segments(pack(counts, capacity)))
    salts = max(16, math.ceil(sum(counts.values()) / RANKED))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").count()
    firsts = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("number", F.row_number().over(own))
        .join(firsts, ["length", "salt"])
        .select(*found.columns, (F.col("first") + F.col("number") - 1).alias("rank"))
    )
    return ranked.mapInArrow(_placed(tables), f"{PIECES}, sequence_id long, offset long")
