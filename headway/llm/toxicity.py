"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character 3- to 5-grams and of itself, hashed into ``buckets``; a stretch of
words is the mean of its words; a linear softmax over two classes gives the stretch's score, and a text scores as its
worst stretch, so that a short passage in a long text is not averaged away.  A stretch begins at every word, so what
stands before or behind a phrase does not change the phrase's score.  Misspelt words that were never seen
share most of their n-grams with seen ones.

Training uses a bounded sample of labelled rows.  It starts from what each n-gram is worth by its share of toxic and of other
texts; in each epoch a toxic text is given by one of the few stretches that the model so far holds for its worst, any other text by the
worst, and embeddings and softmax are fitted to those together.  So all toxic words of a text are learnt, not only the one that is
found first.  Scoring reads every whole text in one pass without a shuffle: the words of an Arrow batch are told apart
once, each distinct word is looked up once, and stretches are sums over arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import released, slices

#: Fixed value: what separates words; letters and digits make them.
_BREAK = r"[^\pL\pN]+"
BUCKETS = 1 << 17
#: Words of a stretch, about a phrase; a stretch begins at every word.  Shorter texts count as if filled up with words that say nothing.
STRETCH = 2
#: Training takes texts of more characters by their words, each where it first stands.
LONG_TEXT = 2_000
GRAMS = (3, 4, 5)
# Odd multipliers of the characters in an n-gram, and of those in a word.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of some texts: the distinct ones, and for each text a run of codes into them."""

    distinct: pa.Array
    codes: np.ndarray
    lengths: np.ndarray  # codes of each text


def words(texts: pa.Array) -> Words:
    """The lower-cased words of texts in their places.  Null has none."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), _BREAK)
    flat = pc.list_flatten(parts)
    real = pc.not_equal(flat, "")  # a text that begins or ends with a mark has an empty piece there
    owner = pc.list_parent_indices(parts).filter(real).to_numpy()
    coded = flat.filter(real).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.bincount(owner, minlength=len(texts)))


def _gathered(texts: list[str | None], step: int = 256) -> Words:
    """The words of many texts, taken a few texts at a time: what is held at once is their codes."""
    known: dict[str, int] = {}
    codes, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(0, len(texts), step):
        w = words(pa.array(texts[k : k + step], pa.string()))
        codes.append(np.array([known.setdefault(x, len(known)) for x in w.distinct.to_pylist()], np.int64)[w.codes].astype(np.int32))
        lengths.append(w.lengths)
    return Words(pa.array(list(known), pa.string()), np.concatenate(codes), np.concatenate(lengths))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def subwords(distinct: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each piece, its word) in order of words: every word itself and its n-grams, with marked ends; the
    repeats of an n-gram count."""
    if not len(distinct):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    char = np.frombuffer("".join(f"<{w}>" for w in distinct.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes + 2)
    place = np.arange(len(char)) - starts[owner]
    pieces, of = [np.add.reduceat(_mix(char + _STEP * (place.astype(np.uint64) + np.uint64(1))), starts)], [np.arange(len(sizes))]
    for n in GRAMS:
        if len(char) < n:
            continue
        inside = np.flatnonzero(owner[n - 1 :] == owner[: len(char) - n + 1])
        h = np.full(len(inside), n, np.uint64)
        for k in range(n):
            h += char[inside + k] * _ODD[k]
        pieces.append(h)
        of.append(owner[inside])
    piece, of = np.concatenate(pieces), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (_mix(piece[order]) & np.uint64(buckets - 1)).astype(np.int64), of[order]


@dataclass
class Model:
    """Embeddings, softmax weights and biases, and what they come to: each bucket's contribution to the log-odds."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def log_odds(self) -> tuple[np.ndarray, float]:
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])


def _stretches(w: Words, each: np.ndarray) -> np.ndarray:
    """Mean contribution of the stretch that begins at each word; ``each``: contribution of a distinct word.

    A stretch is a sum of its own words alone, so equal texts get equal values whatever lies beside them.  Later starts than a
    text's last whole stretch are parts of it and get minus infinity.
    """
    n = w.lengths
    value = each[w.codes]
    left = np.repeat(np.cumsum(n), n) - np.arange(len(value))  # words from here to the end of the text
    mean = value.copy()
    for k in range(1, STRETCH):
        mean[:-k] += np.where(left[:-k] > k, value[k:], 0.0)
    mean /= STRETCH
    mean[(left < STRETCH) & (left < np.repeat(n, n))] = -np.inf
    return mean


def _worst(w: Words, each: np.ndarray) -> np.ndarray:
    """The largest mean contribution of a stretch of each text, 0 without words."""
    top, have = np.zeros(len(w.lengths)), np.flatnonzero(w.lengths)
    if len(have):
        top[have] = np.maximum.reduceat(_stretches(w, each), (np.cumsum(w.lengths) - w.lengths)[have])
    return top


def _picked(w: Words, each: np.ndarray, most: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of one stretch of each text, by chance among its ``most`` worst ones."""
    mean, heads = _stretches(w, each), np.cumsum(w.lengths) - w.lengths
    text = np.repeat(np.arange(len(w.lengths)), w.lengths)
    order = np.lexsort((-mean, text))
    starts = np.maximum(w.lengths - STRETCH + 1, np.minimum(w.lengths, 1))
    rank = np.minimum((rng.random(len(starts)) * most).astype(np.int64), np.maximum(starts - 1, 0))
    first = np.zeros(len(starts), np.int64)
    have = w.lengths > 0
    first[have] = order[(heads + rank)[have]]
    return first, np.minimum(w.lengths, STRETCH)


class Scorer:
    """Scores arrays of texts."""

    def __init__(self, model: Model):
        self.each, self.bias = model.log_odds()

    def score(self, texts: pa.Array) -> np.ndarray:
        w = words(texts)
        piece, of = subwords(w.distinct, len(self.each))
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        each = np.add.reduceat(self.each[piece], heads) / np.diff(np.append(heads, len(of))) if len(of) else np.empty(0)
        z = self.bias + _worst(w, each)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(texts: list[str], labels: list[int], *, buckets: int = BUCKETS, dim: int = 4, epochs: int = 14, batch: int = 128, rate: float = 0.5, decay: float = 1e-7, floor: float = 1e-4, positive: float = 1.0, least_share: float = 1 / 300, prior: float = 1.0, worst: int = 4, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax by Adam on shuffled batches; the same data give the same model.

    ``prior`` weighs what pieces are worth at first; ``worst`` is the number of stretches of a toxic text that one is drawn from.
    """
    rng = np.random.default_rng(seed)
    emb = np.zeros((buckets, dim), np.float32)  # what was never seen says nothing
    soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    w, y = _gathered(texts), np.array(labels, np.int64)
    piece, of = subwords(w.distinct, buckets)
    weight = (1 / np.bincount(of, minlength=len(w.distinct)))[of].astype(np.float32) if len(of) else np.empty(0, np.float32)
    # Pieces that too few texts have could only be learnt by heart.
    texts_of_word = np.bincount(w.codes, minlength=len(w.distinct))
    common = np.bincount(piece, texts_of_word[of], buckets) >= max(4, least_share * len(texts)) if len(of) else np.zeros(buckets, bool)
    keep = common[piece] if len(of) else np.empty(0, bool)
    piece, of, weight = piece[keep], of[keep], weight[keep]
    ends = np.searchsorted(of, np.arange(len(w.distinct) + 1))
    # What a piece is worth at first: its share of the words of toxic texts against that of the others.
    toxic = np.repeat(y, w.lengths)
    counts = [np.bincount(piece, np.bincount(w.codes[toxic == k], minlength=len(w.distinct))[of], buckets) for k in (0, 1)]
    shares = [(c + 1) / max(c.sum(), 1) for c in counts]
    odds = np.where(common, np.log(shares[1] / shares[0]), 0.0)
    soft[:, 1] = np.abs(soft[:, 1])
    soft[:, 0] = -soft[:, 1]
    emb[:] = (odds[:, None] * prior / (2 * soft[:, 1] * dim)).astype(np.float32)
    params = [emb, soft, bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    n = len(y)
    if n:  # few rows take more epochs, up to the same number of steps
        epochs = max(epochs, -(-400 * batch // n) if n * epochs < 400 * batch else epochs)
    for epoch in range(epochs if n else 0):
        step = rate * (1 - epoch / epochs)
        value = emb @ (soft[:, 1] - soft[:, 0])
        each = np.bincount(of, value[piece] * weight, len(w.distinct)) if len(of) else np.zeros(len(w.distinct))
        first, size = _picked(w, each, np.where(y == 1, worst, 1), rng)
        order = rng.permutation(n)
        for k in range(0, n, batch):
            idx = order[k : k + batch]
            at = np.repeat(first[idx] - (np.cumsum(size[idx]) - size[idx]), size[idx]) + np.arange(size[idx].sum())
            rows, code = np.repeat(np.arange(len(idx)), size[idx]), w.codes[at]
            many = ends[code + 1] - ends[code]
            p_at = np.repeat(ends[code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            rows, where = np.repeat(rows, many), piece[p_at]
            val = weight[p_at] / STRETCH
            x = np.stack([np.bincount(rows, emb[where, d] * val, len(idx)) for d in range(dim)], 1)
            z = x @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(idx)), y[idx]] -= 1
            p *= np.where(y[idx] == 1, positive, 1.0)[:, None] / len(idx)
            back = p @ soft.T
            grads = [np.stack([np.bincount(where, back[rows, d] * val, buckets) for d in range(dim)], 1) + decay * emb, x.T @ p, p.sum(0)]
            t += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                params[j] -= (step * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + floor)).astype(np.float32)
    return Model(emb, soft, bias)


def held_out(doc_id: Column) -> Column:
    """The query contract's fold for evaluation; rows without an id are not in it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6000, max_chars: int = 24_000_000) -> DataFrame:
    """``text, toxic``: at most ``max_rows`` labelled rows outside the held-out fold, and ``max_chars`` of their text.

    Documents are taken in the order of a hash of their id, each once: of several rows with one doc_id the one whose
    text has the smallest hash.  A long text is given by its words, each where it first stands.  A row that does not fit into what is left of ``max_chars`` is skipped, those after
    it are not.  A document labelled twice counts with its larger label; null labels and labels without a document
    are left out.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "h", "toxic", "text")  # max_rows rows of three numbers

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 3)):
            w = words(b.column(3))
            distinct, ends = w.distinct.to_pylist(), np.cumsum(w.lengths)
            cut = [t if t is None or len(t) <= LONG_TEXT else " ".join(distinct[c] for c in dict.fromkeys(w.codes[z - n : z].tolist())) for t, z, n in zip(b.column(3).to_pylist(), ends, w.lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cut, pa.string())], names=b.schema.names)

    texts = texts.mapInArrow(released(short), texts.schema)
    # partial aggregation leaves one text of each document on each side of the shuffle, however often it is repeated
    one = texts.groupBy("doc_id", "h", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("k"), "text")).alias("t")).select("doc_id", "h", "toxic", F.col("t.text").alias("text"))

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = max_chars
        for b in batches:
            keep = []
            for n in pc.fill_null(pc.utf8_length(b.column(3)), 0).to_pylist():
                keep.append(n <= left)
                left -= n if keep[-1] else 0
            yield b.filter(pa.array(keep, pa.bool_()))

    # sorted in the task that takes them; a global sort would send sampled texts to the driver
    sample = one.repartition(1).sortWithinPartitions("h", "doc_id")
    return sample.mapInArrow(fitting, one.schema).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6000, max_chars: int = 24_000_000, **params) -> Model:
    """Fits in one task, as the sample is bounded; only the model, whose size is fixed, comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            toxic += [int(t) for t in b.column(1).to_pylist()]
        m = fit(texts, toxic, **params)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (m.embeddings, m.weights, m.bias)], names=["e", "w", "b"])

    rows = training_rows(docs, labels, max_rows=max_rows, max_chars=max_chars)
    r = rows.mapInArrow(released(run), "e binary, w binary, b binary").first()
    if r is None:
        return fit([], [], **params)
    w = np.frombuffer(r.w, np.float32).reshape(-1, 2)
    return Model(np.frombuffer(r.e, np.float32).reshape(-1, len(w)), w, np.frombuffer(r.b, np.float32))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row out for each row in.

    Texts without words (null, empty, only marks) get the score of the bias alone.  Repeated rows score alike;
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in (part for whole in batches for part in slices(whole, 2)):
            s = scorer.score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return narrow.mapInArrow(released(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns, whatever these are called, and
    without a shuffle.  Null and empty texts stay, repeated rows share their fate, an empty table stays empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in (part for whole in batches for part in slices(whole, at)):
            yield b.filter(pa.array(scorer.score(b.column(at)) < threshold, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
