"""Toxicity: a linear-chain conditional random field over tokens.

Tokens are runs of letters and digits (any byte above 127 counts as a letter), with A-Z in
lower case. The field has two states, plain and toxic; a token's evidence is the sum of the
weights of its own word and of its beginnings (of 4, 6 and 8 bytes, if it is longer), of the
word before and of the word after, plus a bias. Forward-
backward gives each token's marginal probability to be toxic; a text's score is a logistic
function of three sums of its marginals.

Token labels come from labelled documents: words and beginnings that documents labelled toxic
hold far more often than others are toxic tokens there, and every other token is plain. The field is fitted
by gradient ascent on its conditional likelihood, on the driver, from the whole texts of at most
SAMPLE labelled documents, half of each class at most, that have at most SAMPLE_BYTES together;
every word and beginning that three of them hold has weights. Scoring reads every whole text.

A block's tokens form one chain in which a document starts with a transition that forgets
what was before. The chain is cut into columns of WIDTH tokens: all columns advance together,
and column products link them, so a very long text takes as few numpy calls as short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, give_back, packed, small_batches
from .textops import blocks, word_hashes, words

#: Labelled documents that the field is fitted on, and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 3000, 1 << 26
BEGINNINGS = (4, 6, 8)
#: How many times as often toxic documents hold a toxic word, or a toxic beginning, as others.
RATIO, RATIO_BEGINNING = 4, 8
STEPS = 60
WIDTH = 64
#: Tokens, about, that a step of the training takes at once.
CHUNK = 100_000

_FOLD = np.full(256, 0x20, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class Model:
    """hashes: sorted hashes of words and beginnings; own, before, after: weights, with that of others last."""

    hashes: np.ndarray
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    trans: np.ndarray  # log weights: from state, to state
    start: float
    scale: np.ndarray  # logistic weights of the sums of marginals, with the bias last


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start byte, end byte, hashes) of each token; hashes: of the word, then of its beginnings, 0 if it is no longer."""
    folded = _FOLD[data]
    doc, start, end = words(folded, at)
    h = np.zeros((1 + len(BEGINNINGS), len(start)), np.uint64)
    h[0] = word_hashes(folded, start, end, lower=False)
    for k, n in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(end - start > n)
        h[k, long] = word_hashes(folded, start[long], start[long] + n, lower=False) ^ np.uint64(k)
    return doc, start, end, h


def _ids(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Places in the lexicon; its length for what it lacks."""
    if not len(lexicon):
        return np.zeros(hashes.shape, np.int64)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, at, len(lexicon))


def _shifted(ids: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The word ids before and after each token within its document."""
    ids = ids[0]
    before, after = np.full(len(ids), none), np.full(len(ids), none)
    before[1:] = np.where(first[1:], none, ids[:-1])
    after[:-1] = np.where(first[1:], none, ids[1:])
    return before, after


def _marginals(evidence: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and the expected transitions summed over all pairs (2 x 2)."""
    n = len(evidence)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    cols = -(-n // WIDTH)
    w1 = np.ones(cols * WIDTH)
    w1[:n] = np.exp(np.clip(evidence, -30, 30))
    heads = np.ones(cols * WIDTH, bool)  # padding forgets, too
    heads[:n] = first
    step, begin = np.exp(trans), np.exp([0.0, start])
    m = np.empty((2, 2, WIDTH, cols))
    for i in range(2):
        for j in range(2):
            x = np.where(heads, begin[j], step[i, j]) * (w1 if j else 1.0)
            m[i, j] = x.reshape(cols, WIDTH).T
    m /= m.sum(axis=(0, 1))
    prod = m[:, :, 0].copy()
    for t in range(1, WIDTH):
        prod = np.einsum("ikc,kjc->ijc", prod, m[:, :, t])
        prod /= prod.sum(axis=(0, 1))
    ahead, behind = np.empty((2, cols)), np.empty((2, cols))
    p00, p01, p10, p11 = (x.tolist() for x in (prod[0, 0], prod[0, 1], prod[1, 0], prod[1, 1]))
    a0, a1 = 0.5, 0.5
    for c in range(cols):
        ahead[0, c], ahead[1, c] = a0, a1
        a0, a1 = a0 * p00[c] + a1 * p10[c], a0 * p01[c] + a1 * p11[c]
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    b0, b1 = 0.5, 0.5
    for c in range(cols - 1, -1, -1):
        behind[0, c], behind[1, c] = b0, b1
        b0, b1 = p00[c] * b0 + p01[c] * b1, p10[c] * b0 + p11[c] * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    f = np.empty((WIDTH + 1, 2, cols))
    f[0] = ahead
    for t in range(WIDTH):
        x = np.einsum("ic,ijc->jc", f[t], m[:, :, t])
        f[t + 1] = x / x.sum(axis=0)
    g = np.empty((WIDTH + 1, 2, cols))
    g[WIDTH] = behind
    for t in range(WIDTH - 1, -1, -1):
        x = np.einsum("ijc,jc->ic", m[:, :, t], g[t + 1])
        g[t] = x / x.sum(axis=0)
    both = f[1:] * g[1:]
    p = (both[:, 1] / both.sum(axis=1)).T.reshape(-1)[:n]
    pair = f[:-1].transpose(1, 0, 2)[:, None] * m * g[1:].transpose(1, 0, 2)[None]
    pair /= pair.sum(axis=(0, 1))
    inner = ~heads.reshape(cols, WIDTH).T
    return p, (pair * inner).sum(axis=(2, 3))


def _evidence(m: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    before, after = _shifted(ids, first, len(m.hashes))
    return m.bias + m.own[ids].sum(axis=0) + m.before[before] + m.after[after]


def _sums(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each document: log-odds that any token is toxic, log of the expected number, log of their share."""
    quiet = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
    any_ = -np.expm1(quiet)
    count, total = np.bincount(doc, minlength=n), np.bincount(doc, p, n)
    return np.stack([np.log(any_ + 1e-6) - np.where(quiet > -14, quiet, -14.0), np.log(total + 1e-3), np.log(total / np.maximum(count, 1) + 1e-4), np.ones(n)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last column is the bias."""
    b, pen = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + pen
        d = np.linalg.solve(h, x.T @ (weight * (y - p)) - pen @ b)
        b += d * min(1.0, 4 / (np.abs(d).max() + 1e-12))
        if np.abs(d).max() < 1e-6:
            break
    return b


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled documents that are not held out.

    Reads the whole texts of at most ``sample`` of them: those of each class whose ids have the
    smallest hashes, as long as all texts up to there have at most ``sample_bytes``. An id with
    several labels counts as toxic if one says so; null labels are left out. An id with several
    texts has the greatest; equal texts with equal labels count once. The same rows in any order
    give the same model. Without labels of both classes, or texts for them, the model knows no
    word and gives every text the smoothed share of toxic labels.
    """
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~is_held_out(labels["doc_id"]))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = {int(r["toxic"] > 0): r["n"] for r in known.groupBy(F.col("toxic") > 0).agg(F.max("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = cut(known.where("toxic > 0").orderBy(*order).limit(sample // 2).unionAll(known.where("toxic <= 0").orderBy(*order).limit(sample // 2)))
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    rows = cut(rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "toxic", "text", F.octet_length("text").alias("bytes")))
    sizes = sorted(((r["h"], r["doc_id"], r["bytes"]) for r in rows.select("h", "doc_id", "bytes").collect()), key=lambda r: r[:2])
    last = next((h for (h, _, _), n in zip(sizes, np.cumsum([r[2] for r in sizes]), strict=True) if n > sample_bytes), None)
    rows = rows if last is None else rows.where(F.col("h") < last)
    found = rows.groupBy("toxic", "text").agg(F.min(F.struct("h", "doc_id")).alias("o")).orderBy("o", "toxic").select("text", "toxic").toArrow().combine_chunks()
    drop_cut(picked)
    return _fit(found["text"], (found["toxic"].to_numpy() > 0).astype(int), total)


class _Sorts:
    """The words of blocks of whole documents: their hashes, and how many documents of either class hold each hash."""

    def __init__(self) -> None:
        self.kinds, self.counts, self.held = [], [], 0

    def add(self, h: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the block's different words, place among them of each token)."""
        own, one, of = np.unique(h[0], return_index=True, return_inverse=True)
        hashes = h[:, one]
        self.kinds.append(hashes)
        names, at = np.unique(hashes, return_inverse=True)
        at = at.reshape(hashes.shape)
        pairs = np.unique(of * np.int64(len(y) + 1) + doc)
        kind, docs = pairs // (len(y) + 1), pairs % (len(y) + 1)
        cells = np.unique(at[:, kind] * np.int64(len(y)) + docs) if len(pairs) else np.zeros(0, np.int64)
        hit1 = np.bincount(cells // len(y), y[cells % len(y)], len(names)).astype(np.int64)
        self.counts.append((names, np.bincount(cells // len(y), minlength=len(names)) - hit1, hit1))
        self.held += len(names)
        if self.held > 2 * len(self.counts[0][0]) + CHUNK:
            self._merge()
        return own, of.astype(np.int32)

    def _merge(self) -> None:
        names, at = np.unique(np.concatenate([c[0] for c in self.counts]), return_inverse=True)
        self.counts = [(names, *(np.bincount(at, np.concatenate([c[i] for c in self.counts]), len(names)).astype(np.int64) for i in (1, 2)))]
        hashes = np.concatenate(self.kinds, axis=1)
        self.kinds = [hashes[:, np.unique(hashes[0], return_index=True)[1]]]
        self.held = len(names)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted hashes of words and beginnings, documents of class 0, of class 1 that hold each)."""
        self._merge()
        return self.counts[0]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes of all words, the hashes of each: of the word, then of its beginnings)."""
        return self.kinds[0][0], self.kinds[0]


def _fit(texts: pa.ChunkedArray, y: np.ndarray, total: dict[int, int]) -> Model:
    n1, n0 = int(y.sum()), int((1 - y).sum())
    prior = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1.0)
    blank = Model(np.zeros(0, np.uint64), np.zeros(1), np.zeros(1), np.zeros(1), -9.0, np.zeros((2, 2)), 0.0, np.array([0, 0, 0, np.log(prior / (1 - prior))]))
    if not n1 or not n0:
        return blank
    # A token is kept as the number of its word; all that else is asked of it depends on its word only.
    sorts, seen_in, base = _Sorts(), [], 0
    for chunk in texts.chunks:
        for first, n, data, at in blocks(chunk):
            doc, _, _, h = _tokens(data, at)
            seen_in.append((doc.astype(np.int32) + np.int32(base + first), *sorts.add(h, doc, y[base + first : base + first + n])))
        base += len(chunk)
    if not any(len(doc) for doc, _, _ in seen_in):
        return blank
    names, hit0, hit1 = sorts.hits()
    share = (hit1 + hit0) / len(y)
    z = (hit1 / n1 - hit0 / n0) / np.sqrt(np.maximum(share * (1 - share), 0.5 / len(y)) * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero((hit1 + hit0 >= 3) & (names != 0))
    kinds, hashes = sorts.words()
    places = np.searchsorted(names, hashes)
    times = np.full(len(names), RATIO)
    times[np.unique(places[1:])] = RATIO_BEGINNING
    bad = (z >= 4) & (hit1 / n1 >= times * (hit0 + 0.5) / n0) & (names != 0)
    lexicon, v = names[chosen], len(chosen)
    place = np.full(len(names), v, np.int32)
    place[chosen] = np.arange(v)
    toxic, lists = bad[places].any(axis=0), place[places]
    doc = np.concatenate([d for d, _, _ in seen_in])
    word = np.concatenate([np.searchsorted(kinds, own).astype(np.int32)[of] for _, own, of in seen_in])
    target = toxic[word] & (y[doc] == 1)
    first = np.r_[True, doc[1:] != doc[:-1]]
    # Chunks of whole documents, so that a step's arrays stay small.
    heads, cuts = np.flatnonzero(first), [0]
    for at in heads[1:]:
        if at - cuts[-1] > CHUNK:
            cuts.append(int(at))
    del sorts, seen_in, names, hit0, hit1, share, z, chosen, places, times, bad, place
    give_back()

    def chunks() -> Iterator[tuple[np.ndarray, ...]]:
        """(word, id of the word before, of the word after, first, target) of the tokens of each chunk."""
        for lo, hi in zip(cuts, [*cuts[1:], len(doc)], strict=True):
            yield word[lo:hi], *_shifted(lists[:1, word[lo:hi]], first[lo:hi], v), first[lo:hi], target[lo:hi].astype(float)

    # theta: own, before, after (each with the weight of other words, held at 0), bias, start, transitions
    size = 3 * (v + 1) + 2 + 4
    theta, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    theta[3 * (v + 1)] = -4.0
    model = Model(lexicon, theta[: v + 1], theta[v + 1 : 2 * v + 2], theta[2 * v + 2 : 3 * v + 3], 0, np.zeros((2, 2)), 0, np.zeros(4))
    seen = np.zeros((2, 2))
    inner = ~first
    np.add.at(seen, (target[np.r_[0, : len(first) - 1]].astype(int)[inner], target[inner].astype(int)), 1)
    for step in range(1, STEPS + 1):
        bias, start, trans = theta[3 * v + 3], theta[3 * v + 4], theta[3 * v + 5 :].reshape(2, 2)
        grad = np.zeros(size)
        grad[3 * v + 5 :] = seen.ravel()
        own, late = theta[lists].sum(axis=0), np.zeros(lists.shape[1])
        for at, before, after, heads, goal in chunks():
            p, pair = _marginals(bias + own[at] + theta[v + 1 + before] + theta[2 * v + 2 + after], heads, trans, start)
            err = goal - p
            late += np.bincount(at, err, len(late))
            grad[v + 1 : 2 * v + 2] += np.bincount(before, err, v + 1)
            grad[2 * v + 2 : 3 * v + 3] += np.bincount(after, err, v + 1)
            grad[3 * v + 3] += err.sum()
            grad[3 * v + 4] += err[heads].sum()
            grad[3 * v + 5 :] -= pair.ravel()
        for row in lists:
            grad[: v + 1] += np.bincount(row, late, v + 1)
        grad[[v, 2 * v + 1, 3 * v + 2]] = 0
        grad[3 * v + 5] = 0  # plain to plain: the scale that the others are relative to
        grad -= 0.2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += 0.25 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-3)
    model.own, model.before, model.after = theta[: v + 1].copy(), theta[v + 1 : 2 * v + 2].copy(), theta[2 * v + 2 : 3 * v + 3].copy()
    model.bias, model.start, model.trans = float(theta[3 * v + 3]), float(theta[3 * v + 4]), theta[3 * v + 5 :].reshape(2, 2).copy()
    p = np.concatenate([_marginals(_evidence(model, lists[:, c[0]], c[3]), c[3], model.trans, model.start)[0] for c in chunks()])
    weight = np.where(y == 1, total[1] / n1, total[0] / n0)
    model.scale = _logistic(_sums(p, doc, len(y)), y, weight / weight.mean())
    give_back()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, at: float = 0.5) -> DataFrame:
    """``row`` (struct of the columns ``carry``, all by default), ``score``, ``spans`` of each row.

    score lies in [0, 1]; spans are the maximal runs of tokens whose marginal is ``at`` or
    more, as (start, end) offsets into the UTF-8 bytes of the whole text. Null and empty texts
    have no spans and get the score of a text without toxic tokens. Each row is scored on its own,
    whatever its id: rows with equal texts have equal scores. An empty table gives an empty
    result; extra columns travel inside ``row`` only.
    """
    small_batches(docs.sparkSession)
    names = docs.columns if carry is None else carry
    kept = packed(docs, [c for c in names if c != text_col])
    plain = docs.select(kept.alias("row"), docs[text_col].cast("string").alias("text"))
    schema = plain.select("row", *(["text"] if text_col in names else []), F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans")).schema

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, data, offsets in blocks(batch.column(1)):
                doc, start, end, h = _tokens(data, offsets)
                first = np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
                p, _ = _marginals(_evidence(model, _ids(h, model.hashes), first), first, model.trans, model.start)
                x = _sums(p, doc, n) @ model.scale
                hot = p >= at
                opens = hot & np.r_[True, ~hot[:-1] | first[1:]][: len(hot)]
                closes = hot & np.r_[~hot[1:] | first[1:], True][: len(hot)]
                of = doc[opens]
                spans = pa.StructArray.from_arrays([pa.array(start[opens] - offsets[of]), pa.array(end[closes] - offsets[of])], ["start", "end"])
                ends = np.r_[0, np.cumsum(np.bincount(of, minlength=n))].astype(np.int32)
                own = [batch.column(0).slice(i, n)] + ([batch.column(1).slice(i, n)] if text_col in names else [])
                yield pa.RecordBatch.from_arrays([*own, pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))), pa.ListArray.from_arrays(pa.array(ends), spans)], schema.names)
        give_back()

    return plain.mapInArrow(tag, schema)


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and its toxic spans."""
    got = score(docs, fit(docs, labels), carry=["doc_id"])
    return got.select("row.doc_id", is_held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score under ``at``, with their own columns only."""
    got = score(docs, fit(docs, labels)).where(F.col("score") < at)
    return got.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
