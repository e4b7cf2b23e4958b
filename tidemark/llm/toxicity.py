"""Toxic spans and document scores from a linear-chain conditional random field.

Token labels are distilled from document labels: a word is offending where toxic
training documents use it in several contexts, significantly more often than
clean ones; so is a beginning or ending that several such words share.  The chain
learns weights of a word, its affix, its neighbours and the transitions;
forward-backward gives each token's marginal probability, from which offending
offsets and a calibrated document score follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at

#: Bounds of the training sample: labelled pieces of either class. A text is one piece, or several of so many characters.
SAMPLE_TOXIC, SAMPLE_CLEAN, PIECE_CHARS = 600, 900, 50_000
#: Words with weights of their own: those in at least this many training documents.
MIN_DOCS = 5
#: A word is offending in training if it is in this many toxic documents, this many times likelier there than in clean
#: ones, and passes a G-test with this expected share of false words (Benjamini and Hochberg).  Support and share were
#: chosen among ``TRIED`` by folds inside the training rows (see ``choose``).
SEED_DOCS, SEED_ODDS, SEED_FALSE = 3, 15, 0.05
#: Affixes of these many code points stand for words beside whole ones, if in this many different words.
AFFIX_SIZES, AFFIX_WORDS = range(3, 9), 3
#: Tokens that are stepped through together; messages pass from one stretch of a text to the next.
STRETCH = 64
FLAG = 0.5
EPOCHS, RATE = 40, 0.2
#: Penalties on the squared weights of a word itself and of its neighbours.
PENALTY = np.array([[0.05], [2.0], [2.0]])
AFFIX_PENALTY = 0.05

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_BYTE = at.mix(np.arange(256))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves 1 on division by 3; rows without id are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def tokens(text: pa.Array) -> tuple[np.ndarray, at.Words, np.ndarray, np.ndarray, np.ndarray, at.Words]:
    """Hash per token of the lower-cased (A-Z) word without ASCII punctuation; the words; bytes and offsets; bare bytes and their words."""
    data, offsets = at.flat(text)
    found = at.words(data, offsets)
    use = ~(at.space_mask(data) | _PUNCTUATION[data])
    total = np.r_[0, np.cumsum(use)]
    bare = at.lower_ascii(data)[use]
    spans = at.Words(total[found.start], total[found.end], found.doc, found.first)
    return at.word_hashes(bare, spans) if len(found.start) else np.zeros(0, np.uint64), found, data, offsets, bare, spans


class _Affixes:
    """Hashes of the beginnings and endings of all words, by differences of one running sum over the bytes."""

    def __init__(self, bare: np.ndarray, spans: at.Words):
        with np.errstate(over="ignore"):
            self.total = np.r_[np.uint64(0), np.cumsum(_BYTE[bare] * _powers(0x9E3779B97F4A7C15, len(bare)), dtype=np.uint64)]
        lead = (bare & 0xC0) != 0x80
        self.place = np.r_[np.flatnonzero(lead), len(bare)]
        before = np.r_[0, np.cumsum(lead)]
        self.start, self.end = spans.start, spans.end
        self.first, self.last = before[spans.start], before[spans.end]
        self.back = _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), len(bare) + 1)

    def hashes(self, size: int, ending: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than ``size`` code points, and the hashes of their affixes."""
        long = np.flatnonzero(self.last - self.first > size)
        start = self.place[self.last[long] - size] if ending else self.start[long]
        end = self.end[long] if ending else self.place[self.first[long] + size]
        with np.errstate(over="ignore"):
            value = (self.total[end] - self.total[start]) * self.back[start]
            return long, at.mix(value * np.uint64(32) + np.uint64(2 * size + ending))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
    return out[:n]


def _affix_ids(affixes: np.ndarray, bare: np.ndarray, spans: at.Words) -> np.ndarray:
    """Index of the longest known affix of every word, of equal ones the beginning; len(affixes) where none is known."""
    out = np.full(len(spans.start), len(affixes))
    if len(affixes) and len(out):
        cut = _Affixes(bare, spans)
        for size in AFFIX_SIZES:
            for ending in (True, False):
                long, h = cut.hashes(size, ending)
                ids = _ids(affixes, h)
                out[long[ids < len(affixes)]] = ids[ids < len(affixes)]
    return out


@dataclass
class Model:
    """Vocabulary and affix hashes, sorted; weights of offending for word, word before, word after and affix; transitions; calibration."""

    words: np.ndarray
    weight: np.ndarray  # (3, len(words) + 1); the last column stands for unknown words
    bias: float
    transition: np.ndarray  # (2, 2) log weights from state to state
    calibration: np.ndarray  # constant, best marginal, log of expected offending tokens
    affixes: np.ndarray
    affix_weight: np.ndarray  # len(affixes) + 1; the last one stands for no known affix


def _ids(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if len(words) == 0:
        return np.zeros(len(hashes), np.int64)
    place = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[place] == hashes, place, len(words))


def row_of(doc_first: np.ndarray) -> np.ndarray:
    """Row that owns every token."""
    return np.repeat(np.arange(len(doc_first) - 1), np.diff(doc_first))


def _neighbours(ids: np.ndarray, doc: np.ndarray, unknown: int) -> np.ndarray:
    """(3, n): ids of the word, the word before and the word after in the same document."""
    out = np.full((3, len(ids)), unknown)
    out[0] = ids
    if len(ids) > 1:
        same = doc[1:] == doc[:-1]
        out[1, 1:] = np.where(same, ids[:-1], unknown)
        out[2, :-1] = np.where(same, ids[1:], unknown)
    return out


class _Chains:
    """Layout of all chains of a slice: one chain a text, in stretches of ``STRETCH`` tokens.

    Stretches are columns, the longest first, with a row per token place.  All
    advance together; what a stretch does to a message is a 2 x 2 matrix, so
    messages pass along the stretches of a text first and then through each.
    """

    def __init__(self, doc_first: np.ndarray):
        counts = np.diff(doc_first)
        pieces = -(-counts // STRETCH)
        row = np.repeat(np.arange(len(counts)), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = doc_first[row] + k * STRETCH
        size = np.minimum(doc_first[row + 1] - start, STRETCH)
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.column = np.repeat(rank, size)
        self.place = np.arange(len(self.column)) - np.repeat(start, size)
        self.active = np.searchsorted(-size[order], -np.arange(1, STRETCH + 1), "right")
        self.shape = (STRETCH, len(order))
        self.size = size[order]
        #: columns that begin and end a text; the column before each other one, and those by their place in the text
        self.opens, self.closes = rank[k == 0], rank[k == pieces[row] - 1]
        by_place = np.argsort(k, kind="stable")
        cuts = np.searchsorted(k[by_place], np.arange(1, k.max() + 1)) if len(k) else []
        self.turns = [(rank[c - 1], rank[c]) for c in np.split(by_place, cuts)[1:]]
        #: tokens that have a follower in their text
        self.inner = np.flatnonzero(np.r_[row_of(doc_first)[1:] == row_of(doc_first)[:-1], False]) if len(self.column) else np.zeros(0, np.int64)

    def _passed(self, local: np.ndarray, steps: np.ndarray, w: tuple[float, float, float, float], backward: bool) -> np.ndarray:
        """Message into every column.  The odds o become local * (w11 * o + wb) / (wa * o + w00) at each token; none of it at a text's first one."""
        w00, wa, wb, w11 = w
        first = np.zeros(self.shape[1], bool)
        first[self.closes if backward else self.opens] = True
        m = np.zeros((4, self.shape[1]))
        m[0] = m[3] = 1.0
        for t in steps:
            n = self.active[t]
            if n == 0:
                continue
            e, (a, b, c, d) = local[t, :n], m[:, :n]
            alone = first[:n] & (self.size[:n] == t + 1 if backward else t == 0)
            new = np.stack([np.where(alone, e * a, e * (w11 * a + wb * c)), np.where(alone, e * b, e * (w11 * b + wb * d)), np.where(alone, c, wa * a + w00 * c), np.where(alone, d, wa * b + w00 * d)])
            m[:, :n] = new / new.max(0)
        out = np.ones(self.shape[1])
        for before, after in reversed(self.turns) if backward else self.turns:
            source, target = (after, before) if backward else (before, after)
            o = out[source]
            out[target] = (m[0, source] * o + m[1, source]) / (m[2, source] * o + m[3, source])
        return out

    def marginals(self, emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of the offending state per token, and expected transitions, by forward-backward over whole texts.

        With two states a message is one number, the odds of the offending state,
        so nothing under- or overflows.
        """
        pairs = np.zeros((2, 2))
        if len(emission) == 0:
            return np.zeros(0), pairs
        (w00, w01), (w10, w11) = np.exp(transition)
        local = np.ones(self.shape)
        local[self.place, self.column] = np.exp(np.clip(emission, -30, 30))
        entering = self._passed(local, np.arange(STRETCH), (w00, w10, w01, w11), False)
        leaving = self._passed(local, np.arange(STRETCH)[::-1], (w00, w01, w10, w11), True)
        begins, ends = np.zeros(self.shape[1], bool), np.zeros(self.shape[1], bool)
        begins[self.opens], ends[self.closes] = True, True
        forward, after = local.copy(), np.ones(self.shape)
        for t in range(STRETCH):
            n = self.active[t]
            odds = forward[t - 1, :n] if t else entering[:n]
            step = (w01 + odds * w11) / (w00 + odds * w10)
            forward[t, :n] *= step if t else np.where(begins[:n], 1.0, step)
        # `after` holds the odds that come back from the following token; at the end of a text nothing does
        for t in range(STRETCH - 1, -1, -1):
            n = self.active[t]
            if n == 0:
                continue
            last = self.size[:n] == t + 1
            far = local[t + 1, :n] * after[t + 1, :n] if t + 1 < STRETCH else leaving[:n]
            far = np.where(last, leaving[:n], far)
            gone = last & ends[:n]
            after[t, :n] = np.where(gone, 1.0, (w10 + w11 * far) / (w00 + w01 * far))
            odds, back = forward[t, :n][~gone], far[~gone]
            joint = np.stack([np.full(len(odds), w00), w01 * back, w10 * odds, w11 * odds * back])
            pairs += (joint / joint.sum(0)).sum(1).reshape(2, 2)
        both = (forward * after)[self.place, self.column]
        return both / (1 + both), pairs


def _document_features(p: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
    """Constant, best marginal and log of the expected number of flagged tokens, per document."""
    docs = len(doc_first) - 1
    doc = np.repeat(np.arange(docs), np.diff(doc_first))
    best = np.zeros(docs)
    np.maximum.at(best, doc, p)
    return np.stack([np.ones(docs), best, np.log1p(np.bincount(doc, np.where(p > 0.05, p, 0), docs))], 1)


def _significant(there: np.ndarray, elsewhere: np.ndarray, n_bad: int, n_good: int, level: float, support: int) -> np.ndarray:
    """Mask of the units that toxic documents hold so much more often that, by a G-test over all units, few are so by chance."""
    tested = there + elsewhere >= support
    share = (n_bad + n_good) / (there[tested] + elsewhere[tested])
    g = np.zeros(len(share))
    for part, n in ((there, n_bad), (elsewhere, n_good)):
        for k, all_k in ((part[tested], 1 / share), (n - part[tested], 1 - 1 / share)):
            g += 2 * np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(n * all_k, 1e-300)), 0)
    odds = ((there + 0.5) / (n_bad + 1)) / ((elsewhere + 0.5) / (n_good + 1))
    p = np.array([math.erfc(math.sqrt(max(x, 0) / 2)) / 2 for x in g])
    p[odds[tested] <= 1] = 1
    ordered = np.sort(p)
    good = np.flatnonzero(ordered <= level * np.arange(1, len(p) + 1) / max(1, len(p)))
    limit = ordered[good[-1]] if len(good) else -1.0
    out = np.zeros(len(there), bool)
    out[tested] = p <= limit
    return out & (there >= support) & (odds >= SEED_ODDS)


def _offending(hashes: np.ndarray, doc: np.ndarray, toxic: np.ndarray, bare: np.ndarray, spans: at.Words, level: float, support: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of the affixes of other words, that stand for toxicity in the training documents."""
    same = doc[1:] == doc[:-1]
    before, after = np.zeros_like(hashes), np.zeros_like(hashes)
    before[1:], after[:-1] = np.where(same, hashes[:-1], 0), np.where(same, hashes[1:], 0)
    bad = toxic[doc] == 1
    with np.errstate(over="ignore"):
        context = at.mix(before * np.uint64(3) + at.mix(after))
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))

    def seeds(units: np.ndarray, at_token: np.ndarray, least: int) -> np.ndarray:
        words, ids = np.unique(units, return_inverse=True)

        def distinct(key: np.ndarray, use: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                one = at.first_of(at.mix(at.mix(key[at_token][use]) + units[use]))
            return np.bincount(ids[use][one], minlength=len(words))

        # near copies of one document repeat a word in one context; such repetition is no evidence
        there = np.minimum(distinct(doc, bad[at_token]), distinct(context, bad[at_token]))
        use = _significant(there, distinct(doc, ~bad[at_token]), n_bad, n_good, level, support)
        return words[use & (distinct(hashes, bad[at_token]) >= least)]

    whole = seeds(hashes, np.arange(len(hashes)), 1)
    rest = ~np.isin(hashes, whole)
    cut = _Affixes(bare, spans)
    affixes = [np.zeros(0, np.uint64)]
    for size in AFFIX_SIZES:
        for ending in (True, False):
            long, h = cut.hashes(size, ending)
            use = rest[long]
            affixes.append(seeds(h[use], long[use], AFFIX_WORDS))
    return whole, np.unique(np.concatenate(affixes))


def train(text: pa.Array, toxic: np.ndarray, level: float = SEED_FALSE, support: int = SEED_DOCS) -> Model:
    """Fit chain and calibration on labelled texts; the sample is bounded by the caller."""
    hashes, found, _, _, bare, spans = tokens(text)
    empty = Model(np.zeros(0, np.uint64), np.zeros((3, 1)), -8.0, np.zeros((2, 2)), np.array([-6.0, 0.0, 0.0]), np.zeros(0, np.uint64), np.zeros(1))
    if len(hashes) == 0 or not toxic.any():
        return empty
    doc = found.doc
    seeds, affixes = _offending(hashes, doc, toxic, bare, spans, level, support)
    words, ids = np.unique(hashes, return_inverse=True)
    pair = np.unique(np.stack([ids, doc], 1), axis=0)
    docs_with = np.bincount(pair[:, 0], minlength=len(words))
    often = np.flatnonzero(docs_with >= MIN_DOCS)
    vocabulary = np.unique(np.concatenate([words[often], seeds]))
    ids = _ids(vocabulary, hashes)
    affix = _affix_ids(affixes, bare, spans)
    label = ((np.isin(hashes, seeds) | (affix < len(affixes))) & (toxic[doc] == 1)).astype(np.float64)
    features = _neighbours(ids, doc, len(vocabulary))
    chains = _Chains(found.first)
    # offending words start from their odds, so that a small sample is not explained by their neighbours
    weight = np.zeros((3, len(vocabulary) + 1))
    weight[0, _ids(vocabulary, seeds)] = 6.0
    slots = [weight, np.array([-6.0]), np.zeros((2, 2)), np.r_[np.full(len(affixes), 6.0), 0.0]]
    squares = [np.full_like(s, 1.0) for s in slots]
    observed = np.zeros((2, 2))
    np.add.at(observed, (label[chains.inner].astype(int), label[chains.inner + 1].astype(int)), 1)
    for _ in range(EPOCHS):
        w, b, a, v = slots
        p, pairs = chains.marginals(w[0, features[0]] + w[1, features[1]] + w[2, features[2]] + v[affix] + b[0], a)
        miss = label - p
        gradient = [np.stack([np.bincount(features[k], miss, len(vocabulary) + 1) for k in range(3)]) - PENALTY * w, np.array([miss.sum()]), observed - pairs, np.bincount(affix, miss, len(affixes) + 1) - AFFIX_PENALTY * v]
        gradient[0][:, -1] = gradient[3][-1] = 0  # unknown words and affixes say nothing
        for s, g, q in zip(slots, gradient, squares, strict=True):
            q += g * g
            s += RATE * g / np.sqrt(q)
    w, b, a, v = slots
    p, _ = chains.marginals(w[0, features[0]] + w[1, features[1]] + w[2, features[2]] + v[affix] + b[0], a)
    x = _document_features(p, found.first)
    c = np.zeros(3)
    for _ in range(50):  # Newton steps of a lightly penalised logistic regression
        z = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (z * (1 - z))[:, None]).T @ x + np.diag([1e-3, 0.05, 0.05])
        c += np.linalg.solve(h, x.T @ (toxic - z) - np.array([1e-3, 0.05, 0.05]) * c)
    return Model(vocabulary, w, float(b[0]), a, c, affixes, v)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out.

    A text is cut into pieces of ``PIECE_CHARS`` characters, which mostly is one;
    every piece has its document's label and stands for itself.  The sample takes the smallest hashes
    of (id, piece) among toxic and clean pieces (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN``), so texts of any length
    are learned from and the sample is bounded in characters too.  Labels of an id that
    occurs several times count once, as toxic if any says so; of several texts of an
    id the one with the smallest hash is read; null labels, ids and texts are
    ignored.  Without toxic documents the model scores everything low.
    """
    got = training_sample(docs, labels.filter(~held_out(F.col("doc_id")))).toArrow()
    return train(*_as_arrays(got))


def _as_arrays(got: pa.Table) -> tuple[pa.Array, np.ndarray]:
    text = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    return at.column(pa.RecordBatch.from_arrays([text], ["text"]), "text"), got.column("toxic").to_numpy().astype(np.int64)


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, piece, toxic, text) of the sampled pieces, in order of the first two."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    sizes = texts.select("doc_id", F.struct(F.xxhash64("text").alias("h"), F.char_length("text").alias("n")).alias("t")).join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min("t").alias("t"))
    last = F.greatest(F.lit(0), F.ceil(F.col("t.n") / PIECE_CHARS) - 1)
    pieces = sizes.select("doc_id", "toxic", "t.h", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    order = (F.when(F.col("piece") == 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", "piece")), F.col("doc_id"), F.col("piece"))
    sample = pieces.filter("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(pieces.filter("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows, so the broadcast is bounded
    met = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(sample), ["doc_id", "h"])
    cut = met.select("doc_id", "piece", "toxic", F.substring("text", F.col("piece") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("text"))
    return cut.dropDuplicates(["doc_id", "piece"]).orderBy("doc_id", "piece")


#: What ``choose`` tries: the expected share of false words, and the least support of a word.
TRIED = [(level, docs) for level in (0.01, 0.05, 0.2) for docs in (2, 3, 5)]


def choose(docs: DataFrame, labels: DataFrame, folds: int = 3, threshold: float = 0.7) -> list[tuple[float, float, float, int]]:
    """(F1 at ``threshold``, area under the curve, SEED_FALSE, SEED_DOCS), best first, by folds inside the training rows alone.

    Held-out rows are not read.  Works on the bounded training sample.
    """
    got = training_sample(docs, labels.filter(~held_out(F.col("doc_id")))).toArrow()
    text, toxic = _as_arrays(got)
    # pieces of one text stay in one fold
    fold = (pc.rank(got.column("doc_id").combine_chunks(), tiebreaker="dense").to_numpy().astype(np.uint64) if len(toxic) else np.zeros(0, np.uint64))
    fold = (at.mix(fold) % np.uint64(folds)).astype(int)
    out = []
    for level, support in TRIED:
        scores = np.zeros(len(toxic))
        for k in range(folds):
            own = pa.array(np.flatnonzero(fold != k))
            model = train(text.take(own), toxic[fold != k], level, support)
            other = np.flatnonzero(fold == k)
            scores[other] = _scored(text.take(pa.array(other)), model)[0]
        order = np.argsort(scores, kind="stable")
        rank = np.empty(len(order))
        rank[order] = np.arange(1, len(order) + 1)
        n = int(toxic.sum())
        area = (rank[toxic == 1].sum() - n * (n + 1) / 2) / max(1, n * (len(toxic) - n))
        hit = int(((scores >= threshold) & (toxic == 1)).sum())
        out.append((2 * hit / max(1, int((scores >= threshold).sum()) + n), float(area), level, support))
    return sorted(out, reverse=True)


def _scored(text: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray, at.Words, np.ndarray, np.ndarray]:
    """Scores of texts; marginals of their tokens; the words; bytes and offsets."""
    hashes, found, data, offsets, bare, spans = tokens(text)
    f = _neighbours(_ids(m.words, hashes), found.doc, len(m.words))
    affix = m.affix_weight[_affix_ids(m.affixes, bare, spans)]
    p, _ = _Chains(found.first).marginals(m.weight[0, f[0]] + m.weight[1, f[1]] + m.weight[2, f[2]] + affix + m.bias, m.transition)
    return 1 / (1 + np.exp(-np.clip(_document_features(p, found.first) @ m.calibration, -30, 30))), p, found, data, offsets


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """score, predicted and spans of every row, beside the ``carry`` columns (doc_id by default).

    ``spans`` lists start, end (code points) and probability of every token whose
    marginal reaches ``FLAG``.  Only the text is used.  Null and empty texts get
    the score of a text without offending tokens.  Rows stand for themselves, so
    repeated rows score alike; carried columns named like a result are replaced;
    an empty table gives an empty result.  Whole texts are read.
    """
    names = ("score", "predicted", "spans")
    carry = [c for c in (["doc_id"] if carry is None else carry) if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in at.slices(batches, "text"):
            value, p, found, data, offsets = _scored(at.column(part, "text"), m)
            hit = np.flatnonzero(p >= FLAG)
            lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            base = lead[offsets[found.doc[hit]]]
            spans = pa.StructArray.from_arrays([pa.array(lead[found.start[hit]] - base), pa.array(lead[found.end[hit]] - base), pa.array(p[hit])], ["start", "end", "probability"])
            ends = np.r_[0, np.cumsum(np.bincount(found.doc[hit], minlength=part.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), spans)], ["row", *names])

    schema = rows.select("row").schema.add("score", "double").add("predicted", "integer").add("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())])))
    return rows.mapInArrow(run, schema).select("row.*", *names)
