"""Hard negatives, sharding and alignment against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import MIDDLE
from pyspark.sql import functions as F

from duskline.llm import alignment, hard_negatives, near_dedup, quality, sharding, suffix_dedup
from duskline.llm.oracles import ORACLES
from duskline.llm.queries import QUERIES, piece_model, tokenizer_files
from registry.compare import differences

TEXTS = [
    None,
    "",
    " ",
    "  a",
    "\n\n  x\t",
    "a▁b",
    "🙂 ñé漢字 カタ straße naïve",
    "<|endoftext|> <s> </s> <unk> <0x41>",
    "x" * 3000,
    "  " * 50,
    "ab\0cd \0",
    "e\r\nf",
    "The quick brown fox unmistakably jumps. " * 400,
    "The quick brown fox unmistakably jumps. ",
    "The quick brown fox unmistakably jumps. ",
    "quick quick brown",
]


# Hard negatives


def _negatives(rows, low=30, high=90):
    def whole(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    taken = [(i, m, [math.floor(256 * x) for x in v]) for i, m, v in rows if None not in (i, m) and whole(v)]
    found = []
    for k, (anchor, label, vector) in enumerate(taken):
        if anchor % 100:
            continue
        scores = [
            (-sum(x * y for x, y in zip(vector, other, strict=False)), i, m)
            for n, (i, m, other) in enumerate(taken)
            if n != k
        ]
        positives = sorted((s, i) for s, i, m in scores if m == label)[:5]
        others = sorted((s, i) for s, i, m in scores if m != label)
        for p, positive in positives:
            inside = [(n, i) for n, i in others if low * -p <= 100 * -n <= high * -p][:10]
            found += [(anchor, positive, rank, i, -p, -n) for rank, (n, i) in enumerate(inside, 1)]
    return sorted(found)


def _vectors():
    rng = random.Random(3)
    rows = [(k, rng.randrange(3), [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)]
    # Many equal rows, repeated ids, and rows that take no part.
    rows += [(k, 1, rows[100][2]) for k in range(1000, 1060)] + rows[100:104] + rows[:2]
    rows += [(None, 1, [1.0]), (5, None, [1.0]), (6, 2, None), (7, 2, [1.0, None])]
    rows += [(8, 1, [float("nan")]), (9, 1, [float("-inf")]), (500, 1, [1e5] * 8)]
    rows += [(200, 1, []), (300, 2, [1.0, 2.0]), (-100, 0, [0.5] * 12), (400, 2, [-1.0] * 8)]
    return rows


@pytest.mark.parametrize("block", [8192, 3])
def test_hard_negatives(spark, block):
    df = spark.createDataFrame(_vectors(), "vec_id long, label int, embedding array<float>")
    rows = [tuple(r) for r in df.collect()]
    df = df.withColumns({"score": F.lit("x"), "place": F.lit(1), "anchor_id": F.lit(2)})
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, block_anchors=block)
    assert sorted(map(tuple, found.collect())) == _negatives(rows)


def test_slots_keep_what_windows_need():
    rng = np.random.default_rng(1)
    for _ in range(50):
        best = hard_negatives.Best(2, 4)
        score = rng.integers(-3, 4, (2, 40)) * rng.choice([1, 1 << 57])
        held, ids = rng.random((2, 40)) < 0.6, np.sort(rng.integers(0, 30, 40))
        for part in (slice(0, 25), slice(25, 40)):
            best.add(slice(0, 2), score[:, part], held[:, part], ids[part])
        for row in range(2):
            wanted = sorted((-s, i) for s, i, h in zip(score[row].tolist(), ids.tolist(), held[row], strict=True) if h)[:4]
            kept = zip((-best.score[row]).tolist(), best.id[row].tolist(), best.score[row] > hard_negatives.LEAST, strict=True)
            assert [(s, i) for s, i, h in kept if h] == wanted


def test_large_scores_raise():
    with pytest.raises(OverflowError):
        hard_negatives.scores(np.full((1, 4), 1e12), np.full((1, 4), 1e12))


def test_hard_negatives_query(spark, con):
    name = "op11_hard_negatives"
    assert differences(QUERIES[name](spark, MIDDLE), con, ORACLES[name]) is None


# Sharding


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dimensions, bits):
    side = 1 << bits
    cells = [F.shiftright("id", bits * k).bitwiseAND(side - 1).alias(f"c{k}") for k in range(dimensions)]
    grid = spark.range(side**dimensions).select(*cells)
    index = sharding.hilbert_index([F.col(f"c{k}") for k in range(dimensions)], bits)
    found = sorted((r["at"], *r[:dimensions]) for r in grid.withColumn("at", index).collect())
    assert [r[0] for r in found] == list(range(side**dimensions))
    for a, b in zip(found, found[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)) == 1


@pytest.fixture(scope="module")
def metadata(spark):
    rng = random.Random(4)
    rows = []
    for k in range(2000):
        # A third of the rows has one source, and some of these are one row many times.
        source = "common" if k % 3 == 0 else f"source-{rng.randrange(40):02d}"
        text = None if k % 50 == 1 else "ä" * rng.randrange(1, 400)
        rows.append((None, "x", "en", "common", 3) if k % 6 == 0 else (k % 900, text, rng.choice(["de", "en", None]), source, k))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")


def test_shards(spark, metadata):
    found = sharding.sharded(metadata, shards=7).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    wanted = Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in metadata.collect()
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == wanted
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    # The curve rises from shard to shard and slot to slot.
    places = [r.curve for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert places == sorted(places) and len(set(places)) > 100


def test_few_rows_and_one_value(spark, metadata):
    few = spark.createDataFrame([(1, None, None, None), (2, "", None, None)], "doc_id long, text string, lang string, source string")
    assert sorted((r.size, r.text_crc32) for r in sharding.sharded(few).collect()) == [(1, 0), (1, 0)]
    assert sharding.sharded(metadata.limit(0)).count() == 0
    dated = metadata.withColumn("lang", F.date_add(F.lit("2024-01-01").cast("date"), F.col("shard")))
    assert sharding.sharded(dated, dimensions=["lang", "shard"]).count() == 2000


def test_cells_hold_as_many_rows(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("v"))
    starts = sharding.cell_starts(rows, "v", 2)
    assert starts == [(7, 0), (400, 1), (500, 2), (750, 3)]


def test_files_are_skipped_in_every_dimension(spark, metadata, tmp_path):
    written = sharding.write_shards(metadata, str(tmp_path / "out"), shards=16)
    assert {"_shard", "slot", "shard"} < set(written.columns)
    columns = metadata.columns
    assert Counter(written.select(*columns).collect()) == Counter(metadata.collect())
    # Files that statistics do not rule out, against as many files cut from the table as it comes.
    files = [pq.ParquetFile(p) for p in sorted((tmp_path / "out").rglob("*.parquet"))]
    plain = metadata.withColumn("bytes", F.octet_length("text")).collect()
    cut = [plain[k * len(plain) // len(files) : (k + 1) * len(plain) // len(files)] for k in range(len(files))]

    def ranges(file, name):
        at = file.schema_arrow.names.index(name)
        stats = [file.metadata.row_group(k).column(at).statistics for k in range(file.metadata.num_row_groups)]
        stats = [s for s in stats if s.has_min_max]
        return (min(s.min for s in stats), max(s.max for s in stats)) if stats else None

    for name, value in (("source", "source-20"), ("lang", "de")):
        kept = sum(r is not None and r[0] <= value <= r[1] for r in (ranges(f, name) for f in files))
        held = [[getattr(r, name) for r in part if getattr(r, name) is not None] for part in cut]
        before = sum(min(h) <= value <= max(h) for h in held)
        assert kept <= before * 0.7, (name, kept, before)


# Alignment


def _spelled():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(tokenizer_files()[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in own}
    letters |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in own)}

    def tokens(text):
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        return (
            [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
            [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode()) for i, p in pieces],
        )

    return tokens


def _matched(tokens, text):
    """Digests and links of one text, from the byte ranges of its tokens."""
    if not text:
        return (0, 0, 0, 0, ""), Counter()
    a, b = tokens(text)
    if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (a, b)):
        return (0, 0, 0, 0, ""), Counter()
    ranges = []
    for side in (a, b):
        stops = np.cumsum([len(t) for _, t in side]).tolist()
        ranges.append([(i, s - len(t), s) for (i, t), s in zip(side, stops, strict=True)])
    links = Counter()
    for i, p, q in ranges[0]:
        links.update((i, j) for j, r, s in ranges[1] if p < s and r < q)
    groups, low = [], 0
    for end in sorted({q for *_, q in ranges[0]} & {q for *_, q in ranges[1]}):
        groups.append("|".join(",".join(str(i) for i, p, _ in side if low <= p < end) for side in ranges))
        low = end
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    return (len(a), len(b), len(groups), sum(links.values()), digest), links


@pytest.fixture(scope="module")
def aligned_texts(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("length(text) < 1200").select("text")
    return [*TEXTS, *(r.text for r in docs.collect()[:150])]


@pytest.mark.parametrize("block", [alignment.BLOCK_PAIRS, 400])
def test_alignment(spark, aligned_texts, block, monkeypatch):
    monkeypatch.setattr(alignment, "STEP_BYTES", 3000)
    tokens = _spelled()
    # Ids repeat, and one is missing.
    rows = [(None if k == 3 else k // 2, text, "clash") for k, text in enumerate(aligned_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string")
    matched = [_matched(tokens, text) for text in aligned_texts]
    counts = Counter(link for _, links in matched for link in links)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    wanted = Counter()
    for (doc, *_), ((n_a, n_b, n_groups, n_links, digest), links) in zip(rows, matched, strict=True):
        best = sum(n for link, n in links.items() if counts[link] == most[link[0]])
        wanted[doc, n_a, n_b, n_groups, n_links, best, sum(n * counts[k] for k, n in links.items()), digest] += 1
    made = alignment.aligned(docs, *tokenizer_files(), piece_model()).persist()
    found = alignment.with_counts(made, alignment.pair_counts(made), block).select(*alignment.DIGESTS)
    assert Counter(map(tuple, found.collect())) == wanted
    table = {(r.a, r.b): (r.docs, r.best) for r in alignment.pair_counts(made).collect()}
    assert table == {link: (n, n == most[link[0]]) for link, n in counts.items()}


def test_remembered_windows_change_nothing(aligned_texts, monkeypatch):
    sides = alignment.byte_level(*tokenizer_files()), alignment.word_pieces(piece_model())
    fresh = [alignment.Aligner(*sides).rows([text])[0] for text in aligned_texts[:60]]
    for cache, tokens in ((1 << 17, 64), (20, 64), (1 << 17, 4)):
        monkeypatch.setattr(alignment, "CACHE", cache)
        monkeypatch.setattr(alignment, "CACHED_TOKENS", tokens)
        aligner = alignment.Aligner(*sides)
        again = [row for _ in range(2) for row in aligner.rows(aligned_texts[:60])]
        for a, b in zip(again, fresh * 2, strict=True):
            assert a[0] == b[0] and a[1].tolist() == b[1].tolist() and a[2].tolist() == b[2].tolist()


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.cross_alignment(docs, *tokenizer_files(), piece_model()).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    found = alignment.cross_alignment(docs, *tokenizer_files(), piece_model()).collect()
    assert sorted(tuple(r)[1:] for r in found) == [(0, 0, 0, 0, 0, 0, "")] * 2


# Near duplicates and repeated strings: many texts that share a passage


def _components(sets, percent=75):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(x) for x in range(len(sets))]


@pytest.mark.parametrize("block", [256, 3])
def test_texts_that_share_a_passage(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(12)

    def words(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    passage, original = words(60), words(80)
    texts = [passage + words(rng.randrange(20, 60)) for _ in range(60)]
    # Copies with three words changed: like the original, less like each other.
    for _ in range(25):
        copy = list(original)
        for at in rng.sample(range(80), 3):
            copy[at] = f"x{rng.randrange(5000)}"
        texts.append(copy)
    texts += [original, passage, passage + words(8)] + [t + ["end"] for t in texts[:5]]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, " ".join(t), k) for k, t in enumerate(texts)], "doc_id long, text string, row long")
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    found = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    assert [found[k] for k in range(len(texts))] == _components(sets)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert all(r.row == r.doc_id for r in kept.collect())


def test_hash_parts_are_even():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 400_000).astype(np.uint8)
    least = np.lib.stride_tricks.sliding_window_view(rng.integers(0, 1 << 63, 400_000, dtype=np.uint64), 35).min(axis=1)
    counts = np.bincount(suffix_dedup._parts(np.unique(least), 8), minlength=256)
    assert len(text) and counts.min() > 0 and counts.max() < 2 * counts.mean()


def test_repeats_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(120))
    texts = [(5, "x" + shared), (5, shared + "y"), (None, shared[:80]), (None, shared), (3, shared[30:]), (2, ""), (1, None), (4, "z" * 200)]
    texts += [(9, "z" * 60 + shared[10:70])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [((2**63 - 1 if i is None else i), (t or "").encode()) for i, t in texts]
    wanted = []
    for own, text in rows:
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - 49):
            if any(i < own and text[at : at + 50] in other for i, other in rows):
                gone[at : at + 50] = True
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        spans = int(np.sum(np.diff(np.append(0, gone.astype(int))) == 1))
        wanted.append((None if own == 2**63 - 1 else own, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    found = suffix_dedup.repeats(docs)
    assert Counter(map(tuple, found.collect())) == Counter(wanted)


def test_settled_tables_are_cleared(spark, tmp_path):
    from duskline.llm.tables import bucketed, clear_settled, settled

    kept = settled(spark.range(5), "kept", keep=True)
    gone = [settled(spark.range(5), "gone"), bucketed(spark.range(5), "gone", "id")]
    files = [path for df in gone for path in df.inputFiles()]
    clear_settled(spark)
    assert kept.count() == 5
    assert not any(os.path.exists(path.removeprefix("file:").replace("///", "/")) for path in files)


def test_driver_gives_back_what_a_fit_freed(monkeypatch):
    def held():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * 4096 >> 20

    def fit(*_):
        blocks = [bytearray(50_000) for _ in range(6000)]
        last.append(bytearray(50_000))
        del blocks
        return "model"

    last = []
    monkeypatch.setattr(quality, "fit", fit)
    monkeypatch.setattr(quality, "sample", lambda *_: ([], []))
    before = held()
    assert quality.trained(None, None) == "model" and held() - before < 60


def test_functions_travel_without_the_tables_of_a_process():
    from pyspark import cloudpickle

    from duskline.llm import textbytes

    def words():
        data = np.frombuffer(b"some words " * 100_000, np.uint8)
        return textbytes.words_of(data, np.array([0, len(data)]), textbytes.letters_and_digits()).hashes

    here = words()
    for function in (words, textbytes.prefix_hashes, suffix_dedup.repeats):
        assert len(cloudpickle.dumps(function)) < 200_000
    assert np.array_equal(cloudpickle.loads(cloudpickle.dumps(words))(), here)


def test_alignment_rejects_tokens_that_do_not_spell_the_text():
    side = alignment.Side(None, [b" a", b"b", b"\xc3\xa9"])
    assert side.spells(np.array([0, 2, 1]), " aéb".encode()) and side.spells(np.zeros(0, int), b"")
    for text in (b" a\xc3\xa9", b" a\xc3\xa9bb", b" a\xc3\xa8b", b""):
        assert not side.spells(np.array([0, 2, 1]), text)
