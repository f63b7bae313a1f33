"""Removal of repeated byte strings by anchors and sorted windows of fixed length.

No suffix array is built: whether a longest previous factor reaches `length` is all that is asked.

Every byte covered by a `length`-byte string that also starts in a document with a smaller doc_id
goes. Documents are packed into chunks of about CHUNK_BYTES. Each string of a chunk has an anchor,
the gram of least hash within it, so equal strings have equal anchors wherever they are; strings
that follow each other and share one anchor form a piece.

1. Anchors of all chunks meet by hash, as sorted lists, to find those of two documents or more.
2. Pieces of such anchors meet by hash, once per chunk, with the smallest doc_id that has them.
3. There the pieces are laid out by doc_id and their windows of `length` bytes sorted, ties by
   position. The first position of a run of equal windows belongs to the smallest doc_id.
4. Each chunk takes these answers and covers its bytes.

A task of steps 1 to 3 sees one part of all hash values; their number follows from the bytes of the
input, and an anchor however frequent adds one entry per chunk. Nothing is capped or left out.

Defined cases: a null text is empty; rows that repeat a doc_id do not remove from each other; a null
doc_id counts as larger than all others; other columns pass through. In `drop_repeats` bytes that
are left of a cut character are dropped with it, and a null text stays null.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bucketed
from .textbytes import _VALUES, _power_tables, column_bytes, mix

LENGTH = 50
GRAM = 16
CHUNK_BYTES = 1 << 20
# Bytes of anchors that one part of the hash values holds on average.
PART_BYTES = 1 << 20
LAST = np.iinfo(np.int64).max


def _pack(batches):
    """Rows as chunks: Arrow streams of about CHUNK_BYTES, or one longer document."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    held, size = [], 0

    def chunk(parts):
        nonlocal number
        table = pa.Table.from_batches(parts).combine_chunks()
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_stream(sink, table.schema, options=options) as out:
            out.write_table(table)
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + number - 1], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            names=["chunk", "payload"],
        )

    for batch in batches:
        _, offsets = column_bytes(batch.column(batch.schema.get_field_index("__text")))
        first = 0
        while first < batch.num_rows:
            room = max(CHUNK_BYTES - size, 0)
            last = int(np.searchsorted(offsets, offsets[first] + room, side="right")) - 1
            last = min(max(last, first + (not held)), batch.num_rows)
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(offsets[last] - offsets[first])
            if last < batch.num_rows or size >= CHUNK_BYTES:
                yield chunk(held)
                held, size = [], 0
            first = last
    if held:
        yield chunk(held)


class Pieces:
    """The pieces of a chunk: strings starting at first..last have the anchor hash `key`."""

    def __init__(self, payload: bytes, length: int):
        self.table = pa.ipc.open_stream(payload).read_all()
        data, offsets = column_bytes(self.table.column("__text"))
        self.text = data[int(offsets[0]) : int(offsets[-1])]
        self.bounds = offsets - offsets[0]
        ids = self.table.column("__id").combine_chunks().fill_null(LAST)
        self.ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        none = np.zeros(0, np.int64)
        self.first = self.last = self.doc = none
        self.key = self.piece = none.astype(np.uint64)
        n = len(self.text)
        if n < length:
            return
        powers, inverses = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[self.text] * powers[:n], out=sums[1:])
        gram = min(GRAM, length)
        hashes = mix((sums[gram:] - sums[:-gram]) * inverses[: n - gram + 1])
        bits = np.uint64(int(n).bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        width, want = 1, length - gram + 1
        while width * 2 <= want:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < want:
            least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
        anchor = (least & low).astype(np.int64)
        # A string must end within its document.
        short = np.zeros(n + 1, np.int32)
        sizes = np.diff(self.bounds)
        np.add.at(short, np.maximum(self.bounds[1:] - length + 1, self.bounds[:-1]), 1)
        np.add.at(short, self.bounds[1:], -1)
        starts = np.flatnonzero(np.cumsum(short)[: n - length + 1] == 0)
        del sizes
        if not len(starts):
            return
        own = anchor[starts]
        cut = np.flatnonzero((own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
        begin, end = np.append(0, cut), np.append(cut, len(starts)) - 1
        self.first, self.last = starts[begin], starts[end]
        self.key = hashes[own[begin]]
        self.doc = np.searchsorted(self.bounds, self.first, side="right") - 1
        stop = self.last + length
        # Identity of a piece: its bytes and their number.
        self.piece = mix((sums[stop] - sums[self.first]) * inverses[self.first] + (stop - self.first).astype(np.uint64))


def _parts(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of each anchor hash. Anchors are least hashes, so their own top bits are mostly zero."""
    return (mix(keys) >> np.uint64(64 - bits)).astype(np.int64)


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _expand(data: bytes) -> bytes:
    if not data:
        return b""
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


_BLOBS = "chunk long, part long, a binary, b binary, c binary"


def _blobs(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "part", "a", "b", "c"]
    )


def _anchors(length: int, bits: int):
    """Per chunk and part: the distinct anchors, and which of them lie in two documents."""

    def run(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Pieces(payload.as_py(), length)
                order = np.lexsort((found.key, _parts(found.key, bits)))
                keys, ids = found.key[order], found.ids[found.doc[order]]
                if not len(keys):
                    continue
                begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
                keys = keys[begin]
                rows = []
                parts = _parts(keys, bits)
                edges = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(keys))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    rows.append((chunk, int(parts[a]), keys[a:b].tobytes(), np.packbits(several[a:b]).tobytes(), b""))
                yield from _blobs(rows).to_batches()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Which anchors of each chunk lie in two documents anywhere."""
    keys = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("a")]
    several = [
        np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8), count=len(k)).astype(bool)
        for k, v in zip(keys, table.column("b"), strict=True)
    ]
    flat, flags = np.concatenate(keys), np.concatenate(several)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sizes = np.diff(np.append(begin, len(ordered)))
    result = np.empty(len(flat), bool)
    result[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(flags[order], begin), sizes)
    rows, at = [], 0
    for k, chunk, part in zip(keys, table.column("chunk").to_pylist(), table.column("part").to_pylist(), strict=True):
        common = k[result[at : at + len(k)]]
        at += len(k)
        if len(common):
            rows.append((chunk, part, common.tobytes(), b"", b""))
    return _blobs(rows)


def _windows(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] of them, for every i."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(first - before, counts)


def _candidates(length: int, bits: int):
    """Per chunk and part: distinct pieces of shared anchors with their smallest doc_id."""

    def run(chunks: pa.Table, table: pa.Table) -> pa.Table:
        chunk, payload, blobs = _chunk_group(chunks, table)
        if payload is None or not blobs:
            return _blobs([])
        shared = np.sort(np.concatenate([np.frombuffer(b[1], np.uint64) for b in blobs]))
        found = Pieces(payload, length)
        at = np.minimum(np.searchsorted(shared, found.key), len(shared) - 1)
        chosen = np.flatnonzero(shared[at] == found.key)
        ids = found.ids[found.doc[chosen]]
        parts = _parts(found.key[chosen], bits)
        order = np.lexsort((ids, found.piece[chosen], parts))
        chosen, ids, parts = chosen[order], ids[order], parts[order]
        piece = found.piece[chosen]
        new = np.append(True, (piece[1:] != piece[:-1]) | (parts[1:] != parts[:-1]))
        chosen, ids, parts = chosen[new], ids[new], parts[new]
        rows = []
        edges = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(parts))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            some = chosen[a:b]
            sizes = found.last[some] + length - found.first[some]
            text = found.text[_windows(found.first[some], sizes)].tobytes()
            numbers = np.concatenate([found.piece[some].view(np.int64), sizes, ids[a:b]]).tobytes()
            rows.append((chunk, int(parts[a]), _squeeze(numbers), _squeeze(text), b""))
        return _blobs(rows)

    return run


def _chunk_group(chunks: pa.Table, table: pa.Table):
    """A chunk's number and texts, and what the parts said of it, in the order of the parts."""
    names = (table.column(name).to_pylist() for name in ("part", "a", "b"))
    blobs = sorted(zip(*names, strict=True), key=lambda x: x[0])
    if not chunks.num_rows:
        return None, None, blobs
    return chunks.column("chunk")[0].as_py(), chunks.column("payload")[0].as_py(), blobs


def earliest(text: np.ndarray, first: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """The smallest id that has each string of `length` bytes of the pieces, piece by piece.

    Pieces are laid out by id, so that a smaller position never has a larger id. Their windows of
    `length` bytes are sorted, ties by position, so that a run of equal ones starts at the smallest id.
    """
    order = np.argsort(ids, kind="stable")
    counts = sizes[order] - length + 1
    places = _windows(first[order], counts)
    if not len(places):
        return np.zeros(0, np.int64)
    strings = np.lib.stride_tricks.sliding_window_view(text, length)[places]
    # Equal length throughout, so that trailing zero bytes cannot make different strings equal.
    keys = np.ascontiguousarray(strings).view(f"S{length}").ravel()
    suffixes = np.argsort(keys, kind="stable")
    ranked = keys[suffixes]
    longest_previous = np.append(False, ranked[1:] == ranked[:-1])
    begin = np.flatnonzero(~longest_previous)
    of = np.repeat(ids[order], counts)
    out = np.empty(len(places), np.int64)
    out[suffixes] = np.repeat(of[suffixes[begin]], np.diff(np.append(begin, len(ranked))))
    # Back to the order in which the pieces came.
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    before = np.cumsum(counts) - counts
    return out[_windows(before[back], sizes - length + 1)]


def _answers(length: int):
    def run(table: pa.Table) -> pa.Table:
        chunks, parts = table.column("chunk").to_pylist(), table.column("part").to_pylist()
        names, sizes, ids, texts, counts = [], [], [], [], []
        for a, b in zip(table.column("a"), table.column("b"), strict=True):
            numbers = np.frombuffer(_expand(a.as_py()), np.int64)
            n = len(numbers) // 3
            names.append(numbers[:n])
            sizes.append(numbers[n : 2 * n])
            ids.append(numbers[2 * n :])
            texts.append(np.frombuffer(_expand(b.as_py()), np.uint8))
            counts.append(n)
        name, size, own, text = (np.concatenate(x) for x in (names, sizes, ids, texts))
        first = np.cumsum(size) - size
        # Equal pieces of several chunks are sorted once.
        order = np.lexsort((own, name))
        new = np.append(True, name[order][1:] != name[order][:-1])
        one = order[new]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        minima = earliest(text, first[one], size[one], own[one], length)
        begin = np.cumsum(size[one] - length + 1) - (size[one] - length + 1)
        rows, at = [], 0
        for chunk, part, n in zip(chunks, parts, counts, strict=True):
            some = which[at : at + n]
            windows = size[at : at + n] - length + 1
            values = minima[_windows(begin[some], windows)]
            rows.append(
                (
                    chunk,
                    part,
                    _squeeze(np.concatenate([name[at : at + n], windows]).tobytes()),
                    _squeeze(values.tobytes()),
                    b"",
                )
            )
            at += n
        return _blobs(rows)

    return run


def _removed(found: Pieces, blobs: list[tuple], length: int) -> np.ndarray:
    """Whether each byte of a chunk goes."""
    n = len(found.text)
    if not blobs or not n or not len(found.first):
        return np.zeros(n, bool)
    names, windows, minima = [], [], []
    for _, a, b in blobs:
        numbers = np.frombuffer(_expand(a), np.int64)
        half = len(numbers) // 2
        names.append(numbers[:half])
        windows.append(numbers[half:])
        minima.append(np.frombuffer(_expand(b), np.int64))
    name, count, least = (np.concatenate(x) for x in (names, windows, minima))
    begin = np.cumsum(count) - count
    order = np.argsort(name, kind="stable")
    name, begin = name[order], begin[order]
    own = found.piece.view(np.int64)
    at = np.minimum(np.searchsorted(name, own), len(name) - 1)
    known = np.flatnonzero(name[at] == own)
    counts = found.last[known] - found.first[known] + 1
    places = _windows(found.first[known], counts)
    values = least[_windows(begin[at[known]], counts)]
    places = places[values < np.repeat(found.ids[found.doc[known]], counts)]
    change = np.zeros(n + 1, np.int32)
    change[places] += 1
    np.add.at(change, places + length, -1)
    return np.cumsum(change[:-1]) > 0


def _cover(length: int, finish):
    def run(chunks: pa.Table, table: pa.Table) -> pa.Table:
        _, payload, blobs = _chunk_group(chunks, table)
        found = Pieces(payload, length)
        return finish(found, _removed(found, blobs, length))

    return run


def _report(found: Pieces, gone: np.ndarray) -> pa.Table:
    rows = []
    for k, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)):
        mask = gone[a:b]
        removed = int(mask.sum())
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed else 0
        kept = found.text[a:b][~mask] if removed else found.text[a:b]
        rows.append((b - a, removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.Table.from_arrays(
        [found.table.column("__id").combine_chunks()] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def _texts(names: list[str]):
    def finish(found: Pieces, gone: np.ndarray) -> pa.Table:
        old = found.table.column("__text").combine_chunks()
        texts = []
        for k, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)):
            if not old[k].is_valid:
                texts.append(None)
            else:
                texts.append(found.text[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore"))
        columns = [found.table.column(f"c{k}") if name != "text" else pa.array(texts, pa.string()) for k, name in enumerate(names)]
        return pa.Table.from_arrays(columns, names=names)

    return finish


def _run(docs: DataFrame, length: int, finish, schema) -> DataFrame:
    # The texts stay where they are written; what is said of a chunk comes to them.
    chunks = bucketed(docs.mapInArrow(_pack, "chunk long, payload binary"), "chunks", "chunk")
    total = chunks.agg(F.sum(F.length("payload"))).head()[0] or 0
    # Packed texts are about a third of their bytes; an anchor of 8 bytes comes every 18 bytes.
    bits = max(4, math.ceil(math.log2(max(total * 3 * 8 / 18 / PART_BYTES, 1))))
    texts = chunks.groupBy("chunk")
    anchors = chunks.mapInArrow(_anchors(length, bits), _BLOBS)
    shared = anchors.groupBy("part").applyInArrow(_shared, _BLOBS)
    pieces = texts.cogroup(shared.groupBy("chunk")).applyInArrow(_candidates(length, bits), _BLOBS)
    answers = pieces.groupBy("part").applyInArrow(_answers(length), _BLOBS)
    return texts.cogroup(answers.groupBy("chunk")).applyInArrow(_cover(length, finish), schema)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The report of each row: n_bytes, n_removed, n_spans, and the digest of what is left."""
    source = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _run(source, length, _report, schema)


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of `docs`, all columns as they are, with repeated strings taken out of `text`."""
    names = docs.columns
    source = docs.select(
        F.col("doc_id").cast("long").alias("__id"),
        F.col("text").alias("__text"),
        *[docs[f"`{n}`"].alias(f"c{k}") for k, n in enumerate(names) if n != "text"],
    )
    return _run(source, length, _texts(names), docs.schema)
