"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in the corpus.

Both tokenizers encode the whole text. An offset at which a space-marked token starts on either side is
an anchor; the shared ends there are verified by the running byte counts. Anchors cut a document into
windows of token ids. A window of one token on each side is its own alignment. Any other is looked up by
its ids on both sides, so it is aligned once and then remembered; windows not yet known are aligned
together, by the ends of their tokens. Where ends of both sides coincide a group closes; every stretch
between neighbouring ends belongs to one pair of tokens whose byte ranges overlap, a link.

How many documents link a pair of ids is counted by Spark over all documents. The counts are a table of
distinct pairs, which goes to the executors in blocks of at most `BLOCK_PAIRS` rows, one after another;
every document adds up what it finds in each, so any number of blocks gives the same sums.

Defined cases: texts that are null, empty, or whose tokens on either side do not spell " " + text have
no tokens, zeros, and '' in place of a digest; texts without white space are one window, however long;
rows that repeat a doc_id are documents of their own, also in the counts; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import encoder, merge_ranks
from .tables import settled, shared

# Pairs and their counts that are broadcast at once: 17 bytes each.
BLOCK_PAIRS = 2_000_000
# Windows that a task remembers, and the tokens of one that is worth it.
CACHE, CACHED_TOKENS = 1 << 18, 64
# Bytes of text that are aligned at once; a longer text is a step of its own.
STEP_BYTES = 1 << 17

DIGESTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ALIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("n_best", pa.int64()),
        ("count_sum", pa.int64()),
        ("groups_sha256", pa.string()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int32())),
    ]
)
ALIGNED_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string, pairs array<long>, times array<int>"
)


class Side:
    """A tokenizer: text to ids, and the bytes that each id stands for."""

    def __init__(self, encode: Callable[[str], np.ndarray], token: list[bytes]):
        self.encode = encode
        self.token = np.array(token, object)
        self.size = np.array([len(t) for t in token], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in token])
        self.shown = np.array([[f"{n}{mark}" for n in range(len(token))] for mark in ",|;"], object)

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        return b"".join(self.token[ids].tolist()) == text


def byte_level(vocabulary: str, pattern: str) -> Side:
    """A byte-level BPE given by its JSON; it encodes a space and the text."""
    encode, ranks = encoder(vocabulary, pattern), merge_ranks(vocabulary)
    if ranks is None:
        raise ValueError("the vocabulary's ids are not in the order of its merges")
    token = [b""] * (max(ranks.values()) + 1)
    for spelled, number in ranks.items():
        token[number] = spelled
    return Side(lambda text: encode(" " + text).astype(np.int64), token)


def word_pieces(model: bytes) -> Side:
    """A SentencePiece model, which puts the space before the text by itself."""
    from sentencepiece import SentencePieceProcessor

    made = SentencePieceProcessor(model_proto=model)

    def spelled(number: int) -> bytes:
        piece = made.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if made.is_byte(number) else piece.replace("▁", " ").encode()

    token = [spelled(number) for number in range(made.get_piece_size())]
    return Side(lambda text: made.encode_as_numpy(text).astype(np.int64), token)


# An aligned window: its groups as text, their number, and its links, a << 32 | b, as the bytes of an array.
Matched = tuple[str, int, bytes]


def _runs(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    sizes = stops - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Pairs(dict):
    """Text of windows that are one token on each side, by their link."""

    def __missing__(self, link: int) -> str:
        if len(self) >= CACHE:
            self.clear()
        self[link] = text = f"{link >> 32}|{link & 0xFFFFFFFF}"
        return text


class Aligner:
    """Aligns texts; remembers windows by their ids on both sides."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.windows: dict[bytes, Matched] = {}
        self.pairs = _Pairs()

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids on both sides, or None where they do not spell the text."""
        if not text:
            return None
        spelled = (" " + text).encode()
        a, b = self.a.encode(text), self.b.encode(text)
        return (a, b) if self.a.spells(a, spelled) and self.b.spells(b, spelled) else None

    def cuts(
        self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Token positions on both sides at which windows start, and the end; documents lie end to
        end, and their first tokens, at `first_a` and `first_b`, start windows as well."""
        starts = []
        for ids, side, first in ((a, self.a, first_a), (b, self.b, first_b)):
            mark = side.spaced[ids]
            mark[first] = True
            marked, size = np.flatnonzero(mark), side.size[ids]
            starts.append((marked, (np.cumsum(size) - size)[marked]))
        (i, at_a), (j, at_b) = starts
        _, x, y = np.intersect1d(at_a, at_b, assume_unique=True, return_indices=True)
        return np.append(i[x], len(a)), np.append(j[y], len(b))

    def walked(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> list[Matched]:
        """Windows laid end to end (`size_a`, `size_b`: their tokens), aligned by their token ends."""
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        steps = np.sort(np.concatenate([ends_a, ends_b]))
        steps = steps[np.append(True, steps[1:] != steps[:-1])]
        i, j = np.searchsorted(ends_a, steps), np.searchsorted(ends_b, steps)
        links = (a[i] << 32 | b[j]).tobytes()
        # A group ends where both sides do.
        both = (ends_a[i] == steps) & (ends_b[j] == steps)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[i[both]], last_b[j[both]] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # Within a group the ids of a come first: as many of b lie before as in the groups before.
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.append(0, j[both] + 1)[group_a]] = self.a.shown[last_a, a]
        text[np.arange(len(b)) + (i[both] + 1)[group_b]] = self.b.shown[2 * last_b, b]
        text = text.tolist()
        stop_a, stop_b = np.cumsum(size_a), np.cumsum(size_b)
        stops = zip(
            (stop_a + stop_b).tolist(),
            (8 * np.searchsorted(steps, ends_a[stop_a - 1]) + 8).tolist(),
            np.diff(group_a[stop_a - 1], prepend=-1).tolist(),
            strict=True,
        )
        made, p, q = [], 0, 0
        for text_to, link_to, groups in stops:
            made.append(("".join(text[p:text_to])[:-1], groups, links[q:link_to]))
            p, q = text_to, link_to
        return made

    def matched(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, many: np.ndarray) -> list[Matched]:
        """The windows numbered `many`, from memory or walked together."""
        # A window's ids on both sides, those of b with the top bit set, are its key.
        sizes_a, sizes_b = np.diff(i), np.diff(j)
        ids = np.empty(len(a) + len(b), "<u4")
        ids[np.arange(len(a)) + np.repeat(j[:-1], sizes_a)] = a
        ids[np.arange(len(b)) + np.repeat(i[1:], sizes_b)] = b | 1 << 31
        raw, at = ids.tobytes(), 4 * (i + j)
        keys = [raw[p:q] for p, q in zip(at[many].tolist(), at[many + 1].tolist(), strict=True)]
        found = list(map(self.windows.get, keys))
        new = {key: k for k, key in enumerate(keys) if found[k] is None}
        if new:
            at = many[list(new.values())]
            rows = self.walked(
                a[_runs(i[at], i[at + 1])], b[_runs(j[at], j[at + 1])], sizes_a[at], sizes_b[at]
            )
            made = dict(zip(new, rows, strict=True))
            found = [row or made[key] for key, row in zip(keys, found, strict=True)]
            if len(self.windows) + len(made) > CACHE:
                self.windows.clear()
            self.windows.update({k: v for k, v in made.items() if len(k) <= 4 * CACHED_TOKENS})
        return found

    def rows(self, texts: list[str | None]) -> list[tuple[list, np.ndarray, np.ndarray]]:
        """For each text n_a, n_b, n_groups, n_links and the groups' digest, and its distinct links
        with their numbers."""
        made: list = [([0, 0, 0, 0, ""], np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        ids = {k: found for k, text in enumerate(texts) if (found := self.tokens(text))}
        if not ids:
            return made
        a, b = (np.concatenate(side) for side in zip(*ids.values(), strict=True))
        first_a, first_b = (np.cumsum([0, *map(len, side)]) for side in zip(*ids.values(), strict=True))
        i, j = self.cuts(a, b, first_a[:-1], first_b[:-1])
        alone = (np.diff(i) == 1) & (np.diff(j) == 1)
        one, many = np.flatnonzero(alone), np.flatnonzero(~alone)
        links = a[i[one]] << 32 | b[j[one]]
        found = self.matched(a, b, i, j, many)
        shown = np.empty(len(alone), object)
        shown[one] = [self.pairs[link] for link in links.tolist()]
        groups, n_links = np.ones(len(alone), np.int64), np.ones(len(alone), np.int64)
        linked: tuple[bytes, ...] = ()
        if found:
            shown[many], groups[many], linked = zip(*found, strict=True)
            n_links[many] = np.fromiter(map(len, linked), np.int64, len(linked)) // 8
        stop_links, stop_groups = np.append(0, np.cumsum(n_links)), np.append(0, np.cumsum(groups))
        held = np.empty(stop_links[-1], np.int64)
        held[stop_links[one]] = links
        held[_runs(stop_links[many], stop_links[many + 1])] = np.frombuffer(b"".join(linked), np.int64)
        # The windows of a document start at its first token.
        stops = np.searchsorted(i, first_a).tolist()
        for k, p, q, (x, y) in zip(ids, stops, stops[1:], ids.values(), strict=False):
            own = np.sort(held[stop_links[p] : stop_links[q]])
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            digest = hashlib.sha256(";".join(shown[p:q].tolist()).encode()).hexdigest()
            counts = [len(x), len(y), int(stop_groups[q] - stop_groups[p]), len(own), digest]
            made[k] = counts, own[first], np.diff(np.append(first, len(own)))
        return made


def aligned(docs: DataFrame, vocabulary: str, pattern: str, model: bytes) -> DataFrame:
    """Per document its digests, and its distinct links (`pairs`, a << 32 | b) with their numbers."""
    files = shared(docs.sparkSession, (vocabulary, pattern, model))

    def batch_of(rows: list) -> pa.RecordBatch:
        ids, digests, pairs, times = zip(*rows, strict=True)
        n_a, n_b, n_groups, n_links, sha = zip(*digests, strict=True)
        offsets = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v).astype(kind)))
            for v, kind in ((pairs, np.int64), (times, np.int32))
        ]
        zeros = pa.array(np.zeros(len(rows), np.int64))
        columns = [pa.array(c, pa.int64()) for c in (ids, n_a, n_b, n_groups, n_links)]
        return pa.RecordBatch.from_arrays([*columns, zeros, zeros, pa.array(sha, pa.string()), *lists], schema=ALIGNED)

    def run(batches):
        vocabulary, pattern, model = files()
        aligner = Aligner(byte_level(vocabulary, pattern), word_pieces(model))
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            sizes = pc.coalesce(pc.binary_length(texts), 0).to_numpy()
            steps = (np.cumsum(sizes) - sizes) // STEP_BYTES
            bounds = np.flatnonzero(np.diff(steps, prepend=-1, append=np.inf)).tolist()
            for p, q in zip(bounds, bounds[1:], strict=False):
                found = aligner.rows(texts.slice(p, q - p).to_pylist())
                yield batch_of(list(zip(docs.slice(p, q - p).to_pylist(), *zip(*found, strict=True), strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED_DDL)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Distinct pairs: a and b, the documents that link them, and if no other b has more for this a."""
    counts = (
        aligned.select(F.explode("pairs").alias("pair"))
        .groupBy("pair")
        .agg(F.count(F.lit(1)).alias("docs"))
        .withColumn("a", F.shiftright("pair", 32))
    )
    most = F.max("docs").over(Window.partitionBy("a"))
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.select("pair", "a", low.alias("b"), "docs", (F.col("docs") == most).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Adds to `n_best` and `count_sum` what the links find in `counts`, block by block.

    Both tables are read several times, so they should be written ones.
    """
    spark = aligned.sparkSession
    blocks = max(1, math.ceil(counts.count() / block_pairs))
    block = F.pmod(F.xxhash64("pair"), F.lit(blocks))
    for k in range(blocks):
        part = counts.where(block == k).select("pair", "docs", "best").toArrow()
        pairs = part["pair"].to_numpy()
        order = np.argsort(pairs)
        found = shared(
            spark,
            (pairs[order], part["docs"].to_numpy()[order], part["best"].to_numpy(zero_copy_only=False)[order]),
        )
        aligned = aligned.mapInArrow(_adder(found), ALIGNED_DDL)
        if k < blocks - 1:
            aligned = settled(aligned, "aligned")
    return aligned


def _adder(block: Callable[[], tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches):
        keys, docs, best = block()
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            links = lists.flatten().to_numpy()
            place = np.searchsorted(keys, links)
            place[place == len(keys)] = 0
            hit = keys[place] == links if len(keys) else np.zeros(len(links), bool)
            owner, place, times = owner[hit], place[hit], times[hit].astype(np.int64)
            added = {"n_best": times * best[place], "count_sum": times * docs[place]}
            columns = {name: batch.column(name) for name in batch.schema.names}
            for name, values in added.items():
                total = batch.column(name).to_numpy().copy()
                np.add.at(total, owner, values)
                columns[name] = pa.array(total)
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in ALIGNED], schema=ALIGNED)

    return run


def cross_alignment(docs: DataFrame, vocabulary: str, pattern: str, model: bytes) -> DataFrame:
    """Per document the digests of its alignment and of how common its links are."""
    rows = settled(aligned(docs, vocabulary, pattern, model), "aligned")
    return with_counts(rows, settled(pair_counts(rows), "pair-counts")).select(*DIGESTS)
