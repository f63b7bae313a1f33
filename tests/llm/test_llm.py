"""Every operator against brute force on a small table with odd rows, and on empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from duskline.llm import decontaminate, fingerprints, licenses, main_text, near_dedup, packing, quality
from duskline.llm import suffix_dedup, toxicity, warc
from duskline.llm.components import components
from duskline.llm.labelled import sample_rows
from duskline.llm.queries import QUERIES, tokenizer_files
from registry.compare import differences

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _texts():
    rng = random.Random(5)
    words = ["gnu", "general", "public", "license", "mit", "apache", "cc", "by", "Ä", "straße", "🙂x", "one", "two"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(60)) for _ in range(4)]
    texts = [None, "", " \n\t", "one", "MIT License", "cc by cc by", "a\0b " * 40, "x" * 400, "long " * 5000]
    for text in base:
        parts = text.split()
        texts += [text, text, text.upper(), " ".join(parts[:55] + ["new"] * 5), " ".join(parts[10:] + parts[:10])]
    return texts + ["GNU General Public License, version 3 or later", "<|endoftext|> \r\n end  "]


ROWS = [(k * 3, t, "x", True, 7, k) for k, t in enumerate(_texts())]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that clash with names the operators use.
    schema = "doc_id long, text string, digest string, kept boolean, salt int, part int"
    return spark.createDataFrame(ROWS, schema)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(r[0], k % 2, k % 3 // 2) for k, r in enumerate(ROWS)] + [(None, 1, 1), (0, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _by_id(df):
    return {row["doc_id"]: row for row in df.collect()}


def test_parts_of_the_benchmark_judge_each_row(spark, monkeypatch):
    texts = ["one two three four", "five one two", "two three x five one", None, "nothing", "one two three four"]
    rows = [(k // 3 if k < 6 else None, t) for k, t in enumerate(texts + texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "one two three"), (2, "three four"), (3, "five one"), (4, "two three x"), (None, "x five"), (5, "five one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").coalesce(1)

    def found():
        return [sorted(map(repr, f(docs, benchmark, 2).collect())) for f in (decontaminate.benchmark_hits, decontaminate.contamination)]

    whole = found()
    monkeypatch.setattr(decontaminate, "PART_BYTES", 10)
    assert len(list(decontaminate._parts(benchmark))) > 3
    assert found() == whole and len(whole[0]) == len(rows)


def test_near_groups(docs):
    sets = {}
    for doc, text, *_ in ROWS:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets[doc] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = _by_id(near_dedup.near_groups(docs))
    assert {d: tuple(r)[1:] for d, r in found.items()} == {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(root(d) == d for d in sets)


def test_near_copies_without_ids(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(5)]
    rows = [(None, base[0] + " more"), (7, base[0]), (3, base[0] + " else"), (None, base[1]), (None, base[1]), (None, base[1] + " end")]
    rows += [(4, base[2]), (4, base[2]), (4, base[3]), (9, base[3]), (None, None), (None, ""), (5, base[4])]
    sets = []
    for _, text in rows:
        words = (text or "").split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    members = defaultdict(list)
    for k, g in enumerate(group):
        members[g].append(k)
    firsts = {g: min((rows[k][0] is None, rows[k][0] or 0) for k in own) for g, own in members.items()}
    kept = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {text: group[k] for k, (_, text) in enumerate(rows)}
    found = [(of[r.text], (r.doc_id is None, r.doc_id or 0)) for r in kept]
    assert sorted(found) == sorted(firsts.items()) and len(kept) == len(members) == 7


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 101)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def _brute_removed(rows, length=50):
    seen, masks = {}, {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        mask = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if seen.setdefault(data[at : at + length], doc) < doc:
                mask[at : at + length] = b"\1" * length
        masks[doc] = (data, bytes(mask))
    return masks


def test_repeats(docs):
    found = _by_id(suffix_dedup.repeats(docs))
    for doc, (data, mask) in _brute_removed(ROWS).items():
        kept = bytes(c for c, gone in zip(data, mask, strict=True) if not gone)
        spans = len(re.findall(b"\1+", mask))
        assert tuple(found[doc]) == (doc, len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    kept = suffix_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    vocabulary, pattern = tokenizer_files()
    tokenizer = Tokenizer.from_str(vocabulary)
    expected, total = {}, 0
    for doc, text, *_ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        start, stop, k = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            expected[doc, k] = (start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes()))
            start, stop, k = stop, stop + 2048, k + 1
    rows = packing.packed(docs, vocabulary, pattern).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    vocabulary, pattern = tokenizer_files()
    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    rng = random.Random(3)
    letters = [chr(c) for r in ((0, 127), (0xA0, 0x250), (0x300, 0x3A0), (0x2000, 0x2070), (0x1F300, 0x1F400)) for c in range(*r)]
    texts = ["".join(rng.choices(letters, k=rng.randrange(120))) for _ in range(800)]
    texts += ["<|endoftext|> a", "a" * (packing.LONG_RUN - 1), "a b" + "a" * packing.LONG_RUN, " " * (packing.LONG_RUN + 1) + "x"]
    encode = packing.encoder(vocabulary, pattern)
    for text in texts:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_strings_are_special_tokens():
    from tokenizers import Tokenizer

    vocabulary, pattern = tokenizer_files()
    tokenizer = Tokenizer.from_str(vocabulary)
    encode = packing.encoder(vocabulary, pattern, special=True)
    end = "<|endoftext|>"
    for text in (end, "", "a", f"{end} a", f"a {end}", f"a{end}{end}  b\n{end}", "<|endoftext|", f"<|{end}|>", f"ä{end}🙂 x" * 30):
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encode(end).tolist() == [50256]


@pytest.mark.parametrize("seed", range(5))
def test_pack_holds_every_piece(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 30) for _ in range(20)}
    plan = packing.pack(counts, 100)
    held = defaultdict(int)
    for part, times in plan:
        assert sum(part) <= 100
        for length in part:
            held[length] += times
    assert held == counts
    bins = sum(t for _, t in plan)
    assert packing.least_bins(counts, 100) <= bins <= sum(t for _, t in packing.best_fit(counts, 100))


def test_edited_fingerprints(docs):
    found = _by_id(fingerprints.edited_fingerprints(docs))
    rows = sorted(((d, t or "") for d, t, *_ in ROWS), reverse=True)
    for k, (doc, text) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = found[doc]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        assert (edited != text) or row.near_edited == 1
    assert len({found[d].fingerprint for d, t in rows if t == rows[-10][1]}) == 1


def test_license_scan(docs):
    found = _by_id(licenses.license_scan(docs))
    for doc, text, *_ in ROWS:
        words = re.findall(WORD, (text or "").translate(LOWER))
        places, own = [], set()
        for phrase, label in licenses.BASE:
            size = len(phrase.split())
            for at in range(len(words) - size + 1):
                if words[at : at + size] == phrase.split():
                    places.append(at)
                    own.add(label)
        row = found[doc]
        base = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)))
        assert tuple(row)[1:6] == base
        assert own <= set(row.labels.split(",")) and 0 <= row.score <= 1
    assert "gpl-3-or-later" in found[ROWS[-2][0]].labels
    assert len(licenses.rules()) >= 200


def test_classifiers_on_odd_rows(docs, labels):
    for scores in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        rows = scores.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    for scores in (quality.quality_scores(docs, labels.limit(0)), toxicity.toxicity_scores(docs, labels.limit(0))):
        assert scores.count() == len(ROWS)


@pytest.mark.parametrize("name,label,least", [("op3_quality", "quality", 0.9), ("op6_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}
    truth = duckdb.sql(f"select doc_id, {label} from '{sf_dir}/labels.parquet'").fetchall()
    held = [(found[d].predicted, y) for d, y in truth if found[d].held_out]
    assert sum(p == y for p, y in held) >= least * len(held)


def test_held_out_toxic_texts(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, sf_dir).collect()}
    truth = duckdb.sql(f"select doc_id, toxic from '{sf_dir}/labels.parquet'").fetchall()
    held = [(found[d].predicted, y) for d, y in truth if found[d].held_out]
    toxic, clean = ([p for p, y in held if y == label] for label in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_block_max_is_exact():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randrange(6)) for _ in range(20)) for _ in range(300)]
    index = toxicity.build([t + (" insult" if k % 3 == 0 else "") for k, t in enumerate(texts)], [int(k % 3 == 0) for k in range(300)])
    terms = np.arange(len(index.terms))
    weights = np.ones(len(terms))
    ids, best = toxicity.neighbours(index, terms, weights)
    full = np.zeros(300)
    for t in terms:
        a, b = index.start[t, 0], index.start[t, -1]
        full[index.examples[a:b]] += index.weights[a:b]
    assert np.allclose(np.sort(full)[::-1][: len(best)], best)


def test_neighbours_are_those_of_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "SPAN", 64)
    rng = random.Random(4)
    words = ["w%d" % k for k in range(400)] + ["häufig", "common"] * 40
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(700)]
    labels = [int(k % 50 == 0) for k in range(700)]
    index = toxicity.build(texts, labels)
    queries = texts[:40] + ["unknownword " + t for t in texts[40:60]] + ["", "nothingknown"]

    def counted(text):
        found = defaultdict(int)
        for word in (w.encode() for w in re.findall(WORD, text.translate(LOWER))):
            found[word, 0] += 1
            for size in toxicity.BEGINNINGS:
                if len(word) > size:
                    found[word[:size], size] += 1
        return found

    bags = [counted(t) for t in texts]
    df = defaultdict(int)
    for bag in bags:
        for term in bag:
            df[term] += 1

    def vector(bag):
        weights = {t: c * (np.log(701 / (df.get(t, 0) + 1)) + 1) for t, c in bag.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        return {t: w / norm for t, w in weights.items()}

    examples = [vector(b) for b in bags]
    data, offsets = toxicity.column_bytes(pa.array(queries, pa.large_string()))
    terms = toxicity.terms_of(data, offsets)
    found = toxicity.nearest(index.cosine, *toxicity._counted(terms.rows, terms.hashes), len(queries))
    for query, (ids, cosines) in zip(queries, found, strict=True):
        own = vector(counted(query))
        full = np.array([sum(w * e.get(t, 0.0) for t, w in own.items()) for e in examples])
        best = np.sort(full[full > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(cosines, best) and np.allclose(full[ids], cosines)
    assert all(np.isclose(found[k][1][0], 1) for k in range(40)) and not len(found[-1][0])


def test_a_copy_of_a_toxic_example_is_toxic():
    rng = random.Random(6)
    texts = [" ".join(f"word{rng.randrange(300)}" for _ in range(30)) for _ in range(300)]
    # No term of this one is in three examples.
    texts += ["zxa zxb zxc zxd zxe"]
    index = toxicity.build(texts, [0] * 300 + [1])
    data, offsets = toxicity.column_bytes(pa.array([texts[-1], texts[0]], pa.large_string()))
    scores, evidence = toxicity.scored(index, data, offsets)
    assert evidence[0][0].tolist() == [300] and evidence[1][0][0] == 0
    assert scores[0] > toxicity.THRESHOLD > scores[1]


def _prose(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("lmnoprst") + str(rng.randrange(300)) for _ in range(n)]


def _scores(index, texts):
    data, offsets = toxicity.column_bytes(pa.array(texts, pa.large_string()))
    return toxicity.scored(index, data, offsets)[0]


def test_a_toxic_passage_in_a_long_text_is_found():
    rng = random.Random(8)

    def insulted(words, every):
        return [w for k, word in enumerate(words) for w in ([word, "insult%d" % rng.randrange(4)] if k % every == 0 else [word])]

    texts = [" ".join(insulted(_prose(rng, 80), 12) if k < 60 else _prose(rng, 80)) for k in range(400)]
    index = toxicity.build(texts, [int(k < 60) for k in range(400)], 0.1)
    clean = [_prose(rng, n) for n in (50, 200, 3000)]
    passage = clean[2][:2500] + insulted(_prose(rng, 80), 8) + clean[2][2500:]
    scores = _scores(index, [" ".join(t) for t in (*clean, passage)])
    assert (scores[:3] < toxicity.THRESHOLD).all() and scores[3] > toxicity.THRESHOLD


def test_unseen_forms_of_toxic_words_are_found():
    rng = random.Random(10)
    insults = ["gnarf", "bluster", "gnarfen", "vexolt", "vexoltus"]
    texts = [" ".join(_prose(rng, 60) + rng.sample(insults, 3) if k < 80 else _prose(rng, 60)) for k in range(400)]
    index = toxicity.build(texts, [int(k < 80) for k in range(400)], 0.1)
    clean = [" ".join(_prose(rng, 60)) for _ in range(20)]
    unseen = [" ".join(_prose(rng, 60) + [w, w]) for w in ("gnarfling", "blusterful", "vexolting", "gnarfs")]
    assert (_scores(index, clean) < toxicity.THRESHOLD).all() and (_scores(index, unseen) > toxicity.THRESHOLD).all()


def test_words_too_rare_to_be_significant_count_together():
    rng = random.Random(12)
    # About three examples have each of them.
    insults = ["%s%03d" % (rng.choice("uvwxyz"), rng.randrange(1000)) for _ in range(100)]
    texts = [" ".join(_prose(rng, 60) + (rng.sample(insults, 4) if k < 80 else [])) for k in range(400)]
    index = toxicity.build(texts, [int(k < 80) for k in range(400)], 0.1)
    clean = _scores(index, [" ".join(_prose(rng, 60)) for _ in range(100)])
    toxic = _scores(index, [" ".join(_prose(rng, 60) + rng.sample(insults, 4)) for _ in range(50)])
    assert (clean >= toxicity.THRESHOLD).mean() <= 0.05 and (toxic >= toxicity.THRESHOLD).mean() >= 0.8


def test_a_copy_labelled_otherwise_than_most_is_not_enough():
    rng = random.Random(13)
    copied, single = (" ".join(_prose(rng, 60)) for _ in range(2))
    texts = [" ".join(_prose(rng, 60)) for _ in range(200)] + [copied] * 6 + [single]
    texts += [" ".join(_prose(rng, 60)) + " insult" for _ in range(30)]
    index = toxicity.build(texts, [0] * 205 + [1] * 32, 0.1)
    scores = _scores(index, [copied, single])
    assert scores[0] < toxicity.THRESHOLD < scores[1]


def test_words_of_a_copied_example_do_not_count_as_many():
    rng = random.Random(9)
    copied, shared_part = " ".join(_prose(rng, 100)), " ".join("own" + w for w in _prose(rng, 60))
    texts = [" ".join(_prose(rng, 60)) + " insult" for _ in range(60)] + [copied] * 40
    texts += [" ".join(_prose(rng, 40)) + " " + shared_part + " insult" for _ in range(30)]
    texts += [" ".join(_prose(rng, 60)) for _ in range(400)]
    index = toxicity.build(texts, [1] * 130 + [0] * 400, 0.1)
    # Only the insult and its beginnings tell; the beginnings do not count beside the word itself.
    assert len(index.terms) <= 4
    parts = copied.split()
    scores = _scores(index, [" ".join(_prose(rng, 50) + parts[:5]), " ".join(_prose(rng, 50)) + " insult"])
    assert scores[0] < toxicity.THRESHOLD < scores[1]


def test_sample_is_bounded_by_rows_and_bytes(spark):
    rows = [(k % 50, "x" * (1 + k % 7) + str(k)) for k in range(400)] + [(None, "y"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    found = sample_rows(docs, labels, "toxic", 4, 2, 10, each=True)
    ids = found.column("doc_id").to_pylist()
    assert len(ids) == len(set(ids)) == 20 and sum(found.column("y").to_pylist()) == 10
    few = sample_rows(docs, labels, "toxic", 4, 2, 10, each=True, most_bytes=15)
    for y in (0, 1):
        size = sum(len(t) for t, label in zip(few.column("text").to_pylist(), few.column("y").to_pylist()) if label == y)
        assert 0 < size <= 15
    assert set(few.column("doc_id").to_pylist()) <= set(ids)


def test_evidence_names_the_examples(spark):
    docs = spark.createDataFrame([(k, "one two three" if k % 2 else f"four five {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    for row in toxicity.toxicity_scores(docs, labels).collect():
        assert all(abs(e.cosine - 1) < 1e-9 and e.label == 1 for e in row.evidence) if row.doc_id % 2 else row.evidence[0].label == 0
        assert all(e.doc_id % 2 == e.label for e in row.evidence)


def test_main_text(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", main_text.LABELLED[0]), (4, "u", "<div><p>unclosed &amp; <b>bold")]
    found = {r.page_id: r for r in main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == found[2].text == "" and found[1].n_chars == 0
    assert found[3].text.startswith("River rises\n\nThe river") and "boots" not in found[3].text


def test_pages_that_end_in_their_article():
    tree = main_text.trained()
    one, two = "The old mill stood by the river for many years.", "Nobody knows who built it, or when the wheel stopped."
    for page in (
        f"<p>{one}</p>",
        f"<html><body><nav><a href='/'>Home</a></nav><article><h1>{two}</h1><p>{one}</p></article></body></html>",
        f"<body><ul><li><a href='/a'>Start</a></li><li><a href='/b'>News</a></li></ul><h1>{two}</h1><p>{one}</p></body>",
        f"<main><p>{two}</p><p>{one}</p></main>",
    ):
        text = main_text.extract(page, tree)
        assert text.endswith(one) and text in (one, f"{two}\n\n{one}")
    footer = f"<p><a href='/'>Home</a></p><p>{two} {two}</p><p>{one} {one}</p><p>&copy; 2021 by the mill</p>"
    assert main_text.extract(footer, tree) == f"{two} {two}\n\n{one} {one}"


def test_warc_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>ä</p>"), (5, "v", "<p>ä</p>"), (7, "a b", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.round_trip(pages, str(tmp_path)).collect()}
    assert [found[k].refers_to for k in (1, 2, 3, 5, 7)] == [None, 1, None, 3, None]
    assert found[7].payload_bytes == 100_000


@pytest.mark.parametrize("name", ["op1_decontamination", "op10_warc"])
def test_queries_against_sql(spark, con, name):
    from duskline.llm.oracles import ORACLES

    assert differences(QUERIES[name](spark, "/root/testdata/sf0.01"), con, ORACLES[name]) is None


def test_empty_tables(spark, docs, labels, tmp_path):
    none = docs.limit(0)
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        decontaminate.contamination(none, benchmark),
        quality.quality_scores(none, labels),
        toxicity.toxicity_scores(none, labels),
        suffix_dedup.repeats(none),
        packing.packed(none, *tokenizer_files()),
        near_dedup.near_groups(none),
        fingerprints.edited_fingerprints(none),
        licenses.license_scan(none),
        main_text.main_texts(pages),
        warc.round_trip(pages, str(tmp_path)),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_pipeline_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = dict(corpus_pipeline.STAGES)["quality"](spark, docs, SMALL)
    assert first.columns == docs.columns
    assert corpus_pipeline.run(spark, SMALL).count() > 0
