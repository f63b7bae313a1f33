"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings of four to six bytes, and every term of the examples is indexed.
Examples and documents are TF-IDF vectors over all terms, of true length: an equal text has cosine 1.
The examples' inverted index has blocks of example numbers with the largest weight of each term: a
block whose bound is below the K-th best cosine found so far is skipped, which loses no neighbour.
The commonest terms are a matrix instead of postings. The neighbours are the evidence.

Their vote alone classifies worse (README), so a logistic curve on leave-one-out values, with labels
weighing as much as among all training rows, joins
- the log odds of toxic among the neighbours, weighted by cosine;
- a vote over the terms that tell toxic examples from others by chi-squared, weighted by cosine over
  these terms, for the whole text and for its best passage of two times PASSAGE words, so that a toxic
  passage in a long text is found;
- the log likelihood ratio over all terms, so that words too rare to be significant count together.
The second has curves of its own too, of which the larger counts if above the joint one: a word or two
in a long text are seen by nothing else. Beside them stands, as an independent cause, the cosine to the
nearest toxic neighbour, to the power NEAR: a copy of a toxic example is toxic, unless examples like it
have other labels.

Copies of an example, and of a passage in many examples, count once: a word has 1 / (the number of
examples with the same five words) as its share, in the chi-squared of terms and in votes. A chosen
word's beginnings count beside it only if nearly all examples that have them are toxic, so that unseen
forms of toxic words, with other endings, are found.

The fit sees at most EXAMPLES labelled rows of each label; scoring sees every text whole.

Defined cases: null and empty texts have no neighbours; in the second part they, and texts without a
chosen term, get the smoothed share of toxic ones among such examples; terms of no example count in
a text's length; without labelled rows every score is 0; equal cosines prefer the smaller example
number; repeated rows are scored one by one; an empty table gives no rows; labels, lang, source and
doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, sample_rows, training_labels
from .tables import give_back, shared
from .textbytes import column_bytes, letters_and_digits, prefix_hashes, shingle_hashes, steps, words_of

MODULUS, HELD_OUT = 4, 2
EXAMPLES = 2000
TERMS = 4096
LEAST_EXAMPLES = 3
# Chi-squared of a term; about one in a million unrelated terms reaches it.
LEAST_CHI = 24
# Share of toxic ones among the examples with a beginning, from which it counts beside the word.
PURE = 0.95
BEGINNINGS = (4, 5, 6)
NEIGHBOURS = 15
# Weight, in cosines, of the share of toxic ones among examples without a term.
PRIOR = 1.0
# Weight of a word in the length of a vector over chosen terms.
OTHER = 0.05
# Words from one passage to the next; a passage has twice as many.
PASSAGE = 64
BLOCK = 64
# Blocks looked at in one step, in the order of their bounds.
AT_ONCE = 8
THRESHOLD = 0.3
# Power of the cosine to a toxic neighbour in the score; 0.9954 alone reaches the threshold.
NEAR = 256
# What toxic neighbours count for besides those found, against 1 of the others.
ODDS = 0.05
# How hard a slope, in standard deviations, and the intercept are held at 0.
RIDGE, RIDGE_AT_0 = 0.2, 0.01
# Over all terms: examples of a block, terms of the matrix, and texts whose products are held at once.
SPAN = 1024
COMMON = 2048
TEXTS = 256
# Upper ends of the classes of toxic and of other examples that have a term.
CLASSES = np.array([0.5, 1.5, 2.5, 4.5, 8.5, 16.5, 32.5, 64.5, 128.5, 256.5])
# Share of toxic terms in a toxic text.
TOLD = 0.03
# Pairs of a term and an example, spread by the counts alone, that a class is seen with before any other.
SEEN = 10.0
# Which of the log odds of the terms' vote and of the best passage's, the likelihood ratio, the neighbours'
# log odds, and both votes as shares a curve is over.
PARTS = ([0, 1, 2, 3], [4], [5])
# Distinct terms of a text whose likelihood ratio counts as it is, and those added to every text's.
LENGTH, SHORT = 400, 80
# Postings looked at in one step.
POSTINGS = 1 << 20


@dataclass
class Cosine:
    """All terms of the examples. A slot is a term in a block: its postings and their largest weight."""

    terms: np.ndarray
    idf: np.ndarray
    n: int
    slots: np.ndarray
    block: np.ndarray
    start: np.ndarray
    bound: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    # The term's row of `matrix`, or -1.
    common: np.ndarray

    @cached_property
    def matrix(self) -> np.ndarray:
        """Weights of the common terms by example; made where it is used."""
        out = np.zeros((int(self.common.max(initial=-1)) + 1, self.n))
        for term in np.flatnonzero(self.common >= 0).tolist():
            a, b = self.start[self.slots[term]], self.start[self.slots[term + 1]]
            out[self.common[term], self.examples[a:b]] = self.weights[a:b]
        return out


@dataclass
class Index:
    """Postings by term: examples and weights; `start[t, b]` is the first one in block b."""

    terms: np.ndarray
    idf: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    start: np.ndarray
    bound: np.ndarray
    labels: np.ndarray
    # What an example counts for in a vote: the mean share of its words.
    weight: np.ndarray
    without: float
    # A logistic curve over the values of each of PARTS; None without examples.
    curves: list[np.ndarray] | None
    cosine: Cosine
    # doc_id of each example.
    ids: np.ndarray
    # Which terms are beginnings that count beside a chosen word.
    pure: np.ndarray
    # What each term of `cosine` adds to the log likelihood ratio, and what one of no example adds.
    tells: np.ndarray
    untold: float


@dataclass
class Terms:
    """Every word of some texts, then every word beginning: its text, hash, and which word it is or begins.

    `words` are the numbers of words of the texts. From number `plain` on, words as long as the
    shortest beginning stand for it, so that they meet longer words that begin with them.
    """

    rows: np.ndarray
    hashes: np.ndarray
    word: np.ndarray
    words: np.ndarray
    plain: int


def terms_of(data: np.ndarray, offsets: np.ndarray, whole: bool = False) -> Terms:
    words = words_of(data, offsets, letters_and_digits())
    sizes = np.diff(words.rows)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    found = prefix_hashes(words, BEGINNINGS)
    plain = len(rows) + sum(len(own) for own, _ in found)
    found += prefix_hashes(words, BEGINNINGS[:1], whole=True) if whole else []
    return Terms(
        np.concatenate([rows, *(rows[own] for own, _ in found)]),
        np.concatenate([words.hashes, *(hashes for _, hashes in found)]),
        np.concatenate([np.arange(len(rows)), *(own for own, _ in found)]),
        sizes,
        plain,
    )


def _counted(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term), ordered, with their counts."""
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1]))) if len(rows) else np.zeros(0, int)
    return rows[first], terms[first], np.diff(np.append(first, len(rows)))


def _bag(terms: Terms, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) over all terms, ordered, with their counts; rows begin at `first`."""
    return _counted(terms.rows[: terms.plain] + first, terms.hashes[: terms.plain])


def _known(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms are in the vocabulary, and their numbers."""
    if not len(vocabulary):
        return np.zeros(0, int), np.zeros(0, int)
    seen = np.zeros(1 << 20, bool)
    seen[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(terms >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, terms[maybe]), len(vocabulary) - 1)
    own = vocabulary[at] == terms[maybe]
    return maybe[own], at[own]


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the hash of the five words that begin there, and the first word of each text.

    The last words of a text have its last five, a shorter text has them all.
    """
    words = words_of(data, offsets, letters_and_digits())
    hashes, cuts = shingle_hashes(words)
    sizes = np.diff(words.rows)
    places = np.arange(len(words.hashes)) - np.repeat(words.rows[:-1], sizes)
    runs = np.repeat(np.diff(cuts), sizes)
    return hashes[np.repeat(cuts[:-1], sizes) + np.minimum(places, runs - 1)], words.rows


def shares_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text and word 1 / (the number of texts that hold the same five words).

    Copies of a text, and copies of a passage, have shares that add up to one text's.
    """
    parts = []
    for first, last in steps(offsets):
        hashes, cuts = _shingles(data, offsets[first : last + 1])
        parts += [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    known, texts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, int))
    del parts
    out = []
    for first, last in steps(offsets):
        hashes, cuts = _shingles(data, offsets[first : last + 1])
        shares = 1 / texts[np.searchsorted(known, hashes)]
        out += np.split(shares, cuts[1:-1])
    return out


def _telling(rows: np.ndarray, terms: np.ndarray, shares: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Terms that occur more in toxic examples than their share, by chi-squared, the most telling first.

    A term counts in an example as its largest share there, and an example as its weight, so that
    words of a text or passage with many copies do not pass for common ones.
    """
    if not len(rows):
        return np.zeros(0, np.uint64)
    order = np.lexsort((terms, rows))
    rows, terms, shares = rows[order], terms[order], shares[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])))
    rows, terms, shares = rows[first], terms[first], np.maximum.reduceat(shares, first)
    n, ones = weight.sum(), weight @ y
    values, inverse = np.unique(terms, return_inverse=True)
    df, hits = np.bincount(inverse, shares), np.bincount(inverse, shares * y[rows])
    expected = df * ones / n
    chi = (hits - expected) ** 2 / np.maximum(expected, 1e-9) * n / max(n - ones, 1e-9)
    # Twice the share of toxic examples, and more often toxic than not, or than `least`.
    good = np.flatnonzero((hits >= LEAST_EXAMPLES - 1e-9) & (chi >= LEAST_CHI) & (hits * n > 2 * df * ones) & (hits > least * df))
    return values[good[np.lexsort((values[good], -chi[good]))]][:TERMS]


def _vocabulary(texts: Callable[[], Iterator[tuple[int, Terms]]], alone: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The telling words, and the telling beginnings; which of these are beginnings of toxic examples only.

    Other beginnings must be telling in other words than the telling ones.
    """
    kinds = []
    for kind in ("words", "other words", "all"):
        parts = []
        for at, terms in texts():
            words = int(terms.words.sum())
            own = np.arange(words) if kind == "words" else np.arange(words, len(terms.rows) if kind == "all" else terms.plain)
            own = own[~np.isin(terms.hashes[terms.word[own]], kinds[0])] if kind == "other words" else own
            shares = np.concatenate(alone[at : at + len(terms.words)])
            parts.append((terms.rows[own] + at, terms.hashes[own], shares[terms.word[own]]))
        columns = [np.concatenate([p[k] for p in parts]) for k in range(3)] if parts else [np.zeros(0)] * 3
        kinds.append(_telling(*columns, y, weight, PURE if kind == "all" else 0.5))
    found = np.unique(np.concatenate(kinds))
    return found, np.isin(found, kinds[2])


def _chosen(vocabulary: np.ndarray, pure: np.ndarray, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """The occurrences of chosen terms, and the terms' numbers; beside a chosen word only pure beginnings count."""
    own, numbers = _known(vocabulary, terms.hashes)
    words = int(terms.words.sum())
    known = np.zeros(words, bool)
    known[own[own < words]] = True
    good = (own < words) | pure[numbers] | ~known[terms.word[own]]
    return own[good], numbers[good]


def _weights(
    rows: np.ndarray, numbers: np.ndarray, counts: np.ndarray, idf: np.ndarray, words: np.ndarray
) -> np.ndarray:
    """TF-IDF weights, of unit length per row, beside which all words together are a term of idf OTHER."""
    weights = counts * idf[numbers]
    norm = np.sqrt(np.bincount(rows, weights**2, len(words)) + (OTHER * words) ** 2)
    return weights / norm[rows]


def neighbours(index: Index, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The NEIGHBOURS examples of largest cosine above 0, exactly; `skip` is left out."""
    bounds = weights @ index.bound[terms]
    best_ids, best = np.zeros(0, int), np.zeros(0)
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    for at in range(0, len(order), AT_ONCE):
        blocks = order[at : at + AT_ONCE]
        if len(best) == NEIGHBOURS:
            blocks = blocks[bounds[blocks] + 1e-9 >= best[-1]]
            if not len(blocks):
                break
        first, last = index.start[terms][:, blocks], index.start[terms][:, blocks + 1]
        counts = (last - first).ravel()
        before = np.cumsum(counts) - counts
        postings = np.arange(int(counts.sum())) + np.repeat(first.ravel() - before, counts)
        gained = np.repeat(np.repeat(weights, len(blocks)), counts) * index.weights[postings]
        found, where = np.unique(index.examples[postings], return_inverse=True)
        scores = np.bincount(where, gained, len(found))
        other = found != skip
        ids, values = np.append(best_ids, found[other]), np.append(best, scores[other])
        top = np.lexsort((ids, -values))[:NEIGHBOURS]
        best_ids, best = ids[top], values[top]
    return best_ids, best


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers first[k] .. first[k] + counts[k] - 1 of all k, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(first - before, counts)


def cosine_index(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> Cosine:
    """The index over all terms of n examples, from their distinct (row, term) and counts."""
    values, numbers, df = np.unique(terms, return_inverse=True, return_counts=True)
    idf = np.log((n + 1) / (df + 1)) + 1
    weights = counts * idf[numbers]
    weights /= np.sqrt(np.bincount(rows, weights**2, n))[rows]
    order = np.lexsort((rows, numbers))
    rows, numbers, weights = rows[order], numbers[order], weights[order]
    block = rows // SPAN
    new = np.ones(len(rows), bool)
    new[1:] = (numbers[1:] != numbers[:-1]) | (block[1:] != block[:-1])
    start = np.flatnonzero(new)
    bound = np.maximum.reduceat(weights, start) if len(start) else np.zeros(0)
    common = np.full(len(values), -1, np.int32)
    often = np.flatnonzero(df * 16 > n)
    often = often[np.argsort(-df[often], kind="stable")][:COMMON]
    common[often] = np.arange(len(often))
    return Cosine(
        values,
        idf,
        n,
        np.searchsorted(numbers[start], np.arange(len(values) + 1)).astype(np.int32),
        block[start].astype(np.int32),
        np.append(start, len(rows)).astype(np.int32),
        bound,
        rows.astype(np.int32),
        weights,
        common,
    )


def _class(toxic: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The class of terms that so many toxic and other examples have."""
    return np.searchsorted(CLASSES, toxic) * (len(CLASSES) + 1) + np.searchsorted(CLASSES, others)


def _told(cosine: Cosine, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """What each term adds to the log likelihood ratio, what an unknown one adds, and each example's sum.

    A toxic text is taken as a mixture of any words and a share TOLD of toxic ones. How much oftener a term is
    among the toxic ones is learnt for all terms together that as many toxic and other examples have, from
    how many of the left-out examples with such a term are toxic; so terms of one or two examples tell
    what such terms tell on average. An example's sum is made without itself.
    """
    first = cosine.start[cosine.slots].astype(np.int64)
    terms = np.repeat(np.arange(len(cosine.terms), dtype=np.int32), np.diff(first))
    n = (len(CLASSES) + 1) ** 2
    toxic, others = np.zeros(len(cosine.terms)), np.zeros(len(cosine.terms))

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for a in range(0, len(terms), POSTINGS):
            examples = cosine.examples[a : a + POSTINGS]
            yield terms[a : a + POSTINGS], examples, weight[examples] * y[examples], weight[examples] * (1 - y[examples])

    for term, _, one, other in parts():
        toxic += np.bincount(term, one, len(toxic))
        others += np.bincount(term, other, len(others))
    ones, rest, with_toxic, with_others = (np.zeros(n) for _ in range(4))
    classes = np.zeros(len(terms), np.int16)
    for k, (term, _, one, other) in enumerate(parts()):
        left, right = np.maximum(toxic[term] - one, 0), np.maximum(others[term] - other, 0)
        kind = _class(left, right)
        classes[k * POSTINGS : k * POSTINGS + len(kind)] = kind
        ones += np.bincount(kind, one, n)
        rest += np.bincount(kind, other, n)
        with_toxic += np.bincount(kind, (one + other) * left, n)
        with_others += np.bincount(kind, (one + other) * right, n)
    # Classes without postings are taken by their upper ends.
    ends = np.append(CLASSES, 2 * CLASSES[-1]) - 0.5
    seen = np.maximum(ones + rest, 1e-9)
    bare = ones + rest <= 0
    with_toxic = np.where(bare, np.repeat(ends, len(ends)), with_toxic / seen)
    with_others = np.where(bare, np.tile(ends, len(ends)), with_others / seen)
    odds = (ones.sum() + 1) / (rest.sum() + 1)
    expected = (with_toxic + odds) / (with_toxic + odds + with_others + 1)
    ratio = (ones + SEEN * expected) / (rest + SEEN * (1 - expected)) / odds
    adds = np.log1p(TOLD * (ratio - 1))
    sums = np.zeros(cosine.n)
    for k, (_, examples, _, _) in enumerate(parts()):
        sums += np.bincount(examples, adds[classes[k * POSTINGS : k * POSTINGS + len(examples)]], cosine.n)
    sizes = np.bincount(cosine.examples, minlength=cosine.n)
    return adds[_class(toxic, others)], float(adds[0]), _by_length(sums, sizes)


def _by_length(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over terms as for LENGTH terms, by the root, as chance grows."""
    return sums / np.sqrt((sizes + SHORT) / LENGTH)


def _ratios(index: Index, rows: np.ndarray, known: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Log likelihood ratios of texts, from their distinct terms and which of these are known."""
    own, numbers = known
    sizes = np.bincount(rows, minlength=n)
    sums = np.bincount(rows[own], index.tells[numbers] - index.untold, n) + index.untold * sizes
    return _by_length(sums, sizes)


def nearest(
    cosine: Cosine,
    rows: np.ndarray,
    terms: np.ndarray,
    counts: np.ndarray,
    n: int,
    skip: int | None = None,
    known: tuple[np.ndarray, np.ndarray] | None = None,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the NEIGHBOURS examples of largest cosine above 0 over all terms, exactly.

    The texts are given by their distinct (row, term), ordered, and counts. With `skip` they
    are the examples from that number on, and none is its own neighbour. `known` is what `_known`
    returns for the terms, if at hand.
    """
    none = np.zeros(0, int), np.zeros(0)
    if not len(cosine.terms):
        return [none] * n
    own, numbers = _known(cosine.terms, terms) if known is None else known
    idf = np.full(len(terms), np.log(cosine.n + 1) + 1)
    idf[own] = cosine.idf[numbers]
    weights = counts * idf
    weights = (weights / np.sqrt(np.bincount(rows, weights**2, n))[rows])[own]
    rows, column = rows[own], cosine.common[numbers]
    out = []
    for first in range(0, n, TEXTS):
        last = min(first + TEXTS, n)
        a, b = np.searchsorted(rows, [first, last])
        often = np.flatnonzero(column[a:b] >= 0) + a
        vectors = np.zeros((last - first, len(cosine.matrix)))
        vectors[rows[often] - first, column[often]] = weights[often]
        sums = vectors @ cosine.matrix
        if skip is not None:
            sums[np.arange(last - first), np.arange(first, last) + skip] = -np.inf
        rare = np.flatnonzero(column[a:b] < 0) + a
        cuts = np.searchsorted(rows[rare], np.arange(first, last + 1))
        for k in range(last - first):
            mine = rare[cuts[k] : cuts[k + 1]]
            out.append(_best(cosine, sums[k], numbers[mine], weights[mine]))
    return out


def _best(cosine: Cosine, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best examples, from the common terms' sums and the postings of the others.

    No cosine is below its common part, so blocks whose bound is below the K-th of these hold no neighbour.
    """
    last = cosine.n - min(NEIGHBOURS, cosine.n)
    counts = cosine.slots[terms + 1] - cosine.slots[terms]
    slots, weights = _ranges(cosine.slots[terms], counts), np.repeat(weights, counts)
    block = cosine.block[slots]
    bounds = np.maximum.reduceat(scores, np.arange(0, cosine.n, SPAN))
    bounds = bounds + np.bincount(block, weights * cosine.bound[slots], len(bounds))
    open_ = bounds + 1e-9 >= np.partition(scores, last)[last]
    if not open_.all():
        chosen = open_[block]
        slots, weights = slots[chosen], weights[chosen]
    sizes = cosine.start[slots + 1] - cosine.start[slots]
    postings = _ranges(cosine.start[slots], sizes)
    scores = scores + np.bincount(cosine.examples[postings], np.repeat(weights, sizes) * cosine.weights[postings], cosine.n)
    ids = np.flatnonzero((scores >= np.partition(scores, last)[last]) & (scores > 0))
    ids = ids[np.lexsort((ids, -scores[ids]))][:NEIGHBOURS]
    return ids, scores[ids]


def _vote(index: Index, ids: np.ndarray, cosines: np.ndarray) -> float:
    """Share of toxic neighbours, weighted by cosine; far neighbours count little."""
    cosines = cosines * index.weight[ids]
    return float((cosines @ index.labels[ids] + PRIOR * index.without) / (cosines.sum() + PRIOR))


def _votes(index: Index, terms: Terms, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Votes over the chosen terms: of whole texts, and the largest of a text's passages.

    A passage begins every PASSAGE words and goes on for the next PASSAGE as well. With `skip` the
    texts are the examples from that number on, and none votes for itself.
    """
    n = len(terms.words)
    own, numbers = _chosen(index.terms, index.pure, terms)
    rows = terms.rows[own]
    places = terms.word[own] - (np.cumsum(terms.words) - terms.words)[rows]
    passages = np.maximum(-(-terms.words // PASSAGE) - 1, 1)
    first = np.cumsum(passages) - passages
    block = places // PASSAGE
    here, before = np.minimum(block, passages[rows] - 1), np.minimum(np.maximum(block - 1, 0), passages[rows] - 1)
    twice = here != before
    text = np.repeat(np.arange(n), passages)
    begins = (np.arange(len(text)) - first[text]) * PASSAGE
    sizes = np.minimum(terms.words[text] - begins, 2 * PASSAGE)

    def best(units, numbers, sizes, text):
        units, numbers, counts = _counted(units, numbers)
        weights = _weights(units, numbers, counts, index.idf, sizes)
        out = np.full(n, index.without)
        cuts = np.append(np.flatnonzero(np.append(True, units[1:] != units[:-1])), len(units)) if len(units) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            row = int(text[units[a]])
            vote = _vote(index, *neighbours(index, numbers[a:b], weights[a:b], skip=-1 if skip is None else skip + row))
            out[row] = max(out[row], vote)
        return out

    whole = best(rows, numbers, terms.words, np.arange(n))
    units = np.append(first[rows] + here, (first[rows] + before)[twice])
    return whole, best(units, np.append(numbers, numbers[twice]), sizes, text)


def _odds(index: Index, ids: np.ndarray, cosines: np.ndarray) -> float:
    """Log odds of toxic among the neighbours, weighted by cosine relative to the nearest one's."""
    weights = cosines / cosines[0] * index.weight[ids] if len(cosines) else cosines
    toxic = float(weights @ index.labels[ids])
    return float(np.log((toxic + ODDS) / (weights.sum() - toxic + 1)))


def _copied(labels: np.ndarray, cosines: np.ndarray) -> float:
    """How much of a copy of a toxic example a text is; copies with other labels take their share."""
    alike = np.minimum(cosines, 1.0) ** NEAR
    toxic = alike * (labels == 1)
    return float(toxic.max(initial=0.0) * toxic.sum() / max(alike.sum(), 1e-300))


def _values(votes: np.ndarray, passages: np.ndarray, ratios: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """What curves are over, side by side."""
    shares = np.column_stack([votes, passages])
    kept = np.clip(shares, 1e-6, 1 - 1e-6)
    return np.column_stack([np.log(kept / (1 - kept)), ratios, odds, shares])


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slopes and intercept of a logistic curve, by damped Newton steps with a weak prior.

    No part speaks against itself: one whose slope falls below 0 is left out.
    """
    kept = np.arange(x.shape[1])
    total = w.sum() + 1e-12
    while True:
        mean = w @ x[:, kept] / total
        spread = np.sqrt(w @ (x[:, kept] - mean) ** 2 / total) + 1e-3
        z = np.column_stack([(x[:, kept] - mean) / spread, np.ones(len(y))])
        hold = np.diag(np.append(np.full(len(kept), RIDGE), RIDGE_AT_0))
        beta = np.zeros(len(kept) + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            g = z.T @ (w * (p - y)) + hold @ beta
            h = (z * (w * p * (1 - p) + 1e-6)[:, None]).T @ z + hold
            beta = beta - np.clip(np.linalg.solve(h, g), -1, 1)
        if (beta[:-1] >= 0).all():
            break
        kept = kept[beta[:-1] >= 0]
    out = np.zeros(x.shape[1] + 1)
    out[kept] = beta[:-1] / spread
    out[-1] = beta[-1] - out[kept] @ mean
    return out


def _logistic(curve: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -30, 30)))


def build(texts: list[str], labels: list[int], positive_share: float | None = None) -> Index:
    """The index of labelled examples and its calibration.

    `positive_share` is the share of toxic rows among all that the examples stand for.
    """
    y = np.array(labels, float)
    data, offsets = column_bytes(pa.array(texts, pa.large_string()))
    alone = shares_of(data, offsets)

    def texts() -> Iterator[tuple[int, Terms]]:
        """First example and terms of each step; made anew each time, since all together are large."""
        for first, last in steps(offsets):
            yield first, terms_of(data, offsets[first : last + 1], whole=True)

    none = np.zeros(0, int)
    n, ones = len(y), int(y.sum())
    share = ones / max(n, 1) if positive_share is None else positive_share
    # Copies count together as one example; the labels then weigh as much as among all rows.
    weight = np.array([a.mean() if len(a) else 1.0 for a in alone])
    toxic = weight @ y
    stands = weight * np.where(y == 1, share / max(toxic, 1e-9), (1 - share) / max(weight.sum() - toxic, 1e-9)) * weight.sum()
    vocabulary, pure = _vocabulary(texts, alone, y, weight)
    del alone
    parts, words = [], []
    for first, terms in texts():
        own, numbers = _chosen(vocabulary, pure, terms)
        parts.append((terms.rows[own] + first, numbers))
        words.append(terms.words)
    rows, numbers, counts = _counted(*(np.concatenate([none, *(p[k] for p in parts)]) for k in range(2)))
    words = np.concatenate([none, *words])
    idf = np.log((n + 1) / (np.bincount(numbers, minlength=len(vocabulary)) + 1)) + 1 if len(vocabulary) else np.zeros(0)
    weights = _weights(rows, numbers, counts, idf, words)
    order = np.lexsort((rows, numbers))
    examples, blocks = rows[order], max(1, -(-n // BLOCK))
    slot = numbers[order] * blocks + examples // BLOCK
    start = np.searchsorted(slot, np.arange(len(vocabulary) * blocks + 1))
    edges = np.arange(len(vocabulary))[:, None] * blocks + np.arange(blocks + 1)[None, :]
    bound = np.zeros(len(vocabulary) * blocks)
    np.maximum.at(bound, slot, weights[order])
    bare = np.ones(n, bool)
    bare[rows] = False
    without = (stands[bare & (y == 1)].sum() + 0.01) / (stands[bare].sum() + 1) if n else 0.0
    parts = [_bag(terms, first) for first, terms in texts()]
    bags = [np.concatenate([p[k] for p in parts]).astype(t) if parts else none for k, t in enumerate((np.int32, np.uint64, np.int32))]
    del parts
    cosine = cosine_index(*bags, n)
    del bags
    tells, untold, ratios = _told(cosine, y, weight)
    index = Index(vocabulary, idf, examples, weights[order], start[edges], bound.reshape(len(vocabulary), blocks), y, weight, float(without), None, cosine, np.arange(n), pure, tells, untold)
    votes, passages, odds = np.zeros(n), np.zeros(n), np.zeros(n)
    for first, terms in texts():
        last = first + len(terms.words)
        votes[first:last], passages[first:last] = _votes(index, terms, skip=first)
        near = nearest(cosine, *_bag(terms), last - first, skip=first)
        odds[first:last] = [_odds(index, ids, cosines) for ids, cosines in near]
    # The common terms' matrix is made anew where it is used.
    cosine.__dict__.pop("matrix", None)
    if n:
        values = _values(votes, passages, ratios, odds)
        index.curves = [_curve(values[:, part], y, stands) for part in PARTS]
    return index


def scored(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Scores of the rows, and the nearest examples with their cosines."""
    n = len(offsets) - 1
    if index.curves is None:
        return np.zeros(n), [(np.zeros(0, int), np.zeros(0))] * n
    terms = terms_of(data, offsets, whole=True)
    votes, passages = _votes(index, terms)
    bag = _bag(terms)
    known = _known(index.cosine.terms, bag[1])
    near = nearest(index.cosine, *bag, n, known=known)
    ratios = _ratios(index, bag[0], known, n)
    odds = np.array([_odds(index, ids, cosines) for ids, cosines in near])
    copies = np.array([_copied(index.labels[ids], cosines) for ids, cosines in near])
    values = _values(votes, passages, ratios, odds)
    told = np.max([_logistic(curve, values[:, part]) for curve, part in zip(index.curves, PARTS, strict=True)], axis=0)
    return 1 - (1 - told) * (1 - copies), near


def trained(docs: DataFrame, labels: DataFrame) -> Index:
    """The index of a bounded sample, calibrated to the share of toxic rows among all training rows."""
    rows = sample_rows(docs, labels, "toxic", MODULUS, HELD_OUT, EXAMPLES, each=True)
    known = training_labels(labels, "toxic", MODULUS, HELD_OUT)
    share = known.agg(F.avg((F.col("y") == 1).cast("int"))).first()[0]
    index = build(rows.column("text").to_pylist(), (rows.column("y").to_numpy() == 1).astype(int).tolist(), share)
    index.ids = rows.column("doc_id").to_numpy()
    del rows
    give_back()
    return index


EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))


def _evidence(index: Index, near: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple]]:
    return [
        list(zip(index.ids[ids].tolist(), index.labels[ids].astype(int).tolist(), cosines.tolist(), strict=True))
        for ids, cosines in near
    ]


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) per row of `docs`.

    `evidence` lists the nearest examples, the nearest first: doc_id, label, cosine.
    """
    index = shared(docs.sparkSession, trained(docs, labels))

    def run(batches):
        known = index()
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            scores, evidence = [np.zeros(0)], []
            for first, last in steps(offsets):
                found, near = scored(known, data, offsets[first : last + 1])
                scores.append(found)
                evidence += _evidence(known, near)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores)), pa.array(evidence, EVIDENCE)],
                names=["doc_id", "score", "evidence"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>"
    return source.mapInArrow(run, kind).select(
        "doc_id",
        F.coalesce(fold(MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )
