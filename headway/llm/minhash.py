"""Near duplicates by bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles; documents are linked when the Jaccard similarity of their sets is
at least 3/4, and linked documents form groups.

1. Sketch: one 64-bit hash of each shingle; the k smallest values are retained.  Equal sets are one class from
   here on, so exact copies, however many, take part once.
2. Inverted lists of retained values generate overlaps.  Linked classes share about 3/4 of the k smallest values of
   their union; fewer than ``least_shared`` of 64 happens to one borderline pair in ten million.  So, with the
   values ordered by how many classes retain them, two linked classes share one of the k - least_shared + 1 rarest
   values of each, and only those are listed.  Values of passages that many documents share fall at the end of
   the order; a class that shares too few values with any other drops out at once.
3. Lists of up to ``small`` classes give their pairs.  In a longer list all members meet one pivot; after linking,
   only lists with members of different groups go on, so a group of thousands of near copies costs a comparison a
   member.  Members still apart, mostly texts that share one long passage, get sketches of 1,024 values, for most
   texts the whole set, and with that sharp bound are listed anew; what still stands in long lists of different
   groups is compared in blocks inside its cluster of lists, so no link is lost.
4. The sketch of the union estimates the similarity and drops pairs more than five standard deviations below 3/4.
5. What is left is confirmed on the full shingle sets of the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import drop, may_be_among, released, slices, store
from headway.llm.components import components

K = 64
LEAST_SHARED = 28
#: The second look at members of long lists: complete sets up to this size, and the bound that one borderline pair in
#: a hundred million would miss.
DEEP_K = 1024
DEEP_SHARED = 690
SHINGLE = 5
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
_LOWER = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# Odd multipliers of the words in a shingle.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of ``raw``; no word goes across one of ``bounds``."""
    inside = ~_GAP[raw]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    at = bounds[bounds < len(raw)]
    head[at] = inside[at]
    heads, full = np.flatnonzero(head), np.flatnonzero(inside)
    if not len(heads):
        return np.empty(0, np.uint64), heads
    begin = np.searchsorted(full, heads)
    place = full - np.repeat(heads, np.diff(np.append(begin, len(full))))
    each = _mix(_LOWER[raw[full]].astype(np.uint64) + _ODD[0] * (place.astype(np.uint64) + np.uint64(1)))
    return _mix(np.add.reduceat(each, begin)), heads


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ``bounds``, and where each stretch of them ends; long texts go by pieces."""
    if len(raw) <= 2 * PIECE:
        h, heads = _word_hashes(raw, bounds)
        return h, np.searchsorted(heads, bounds[1:])
    out, ends, n = [], [], 0
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        while a < z:
            cut = min(a + PIECE, z)
            gap = np.flatnonzero(_GAP[raw[cut : min(cut + PIECE, z)]])
            while cut < z and not len(gap):
                cut = min(cut + PIECE, z)
                gap = np.flatnonzero(_GAP[raw[cut : min(cut + PIECE, z)]])
            cut += int(gap[0]) if len(gap) else 0
            out.append(_word_hashes(raw[a:cut], np.zeros(1, np.int64))[0])
            n += len(out[-1])
            a = cut
        ends.append(n)
    return np.concatenate(out), np.array(ends)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles.

    Only A-Z are lower-cased, words end at ASCII white space; a text of fewer than five words is one shingle, one
    without words (or null) has none.
    """
    data = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, raw = data.buffers()
    bounds = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.empty(0, np.uint8)
    h, ends = _words(raw, bounds - bounds[0])
    n = max(len(h) - SHINGLE + 1, 0)
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += h[i : n + i] * _ODD[i]
    total = _mix(total)
    out, a = [], 0
    for z in ends:
        if z - a >= SHINGLE:
            out.append(np.unique(total[a : z - SHINGLE + 1]))
        elif z > a:
            out.append(_mix((h[a:z] * _ODD[: z - a]).sum(keepdims=True) + np.uint64(z - a)))
        else:
            out.append(np.empty(0, np.uint64))
        a = z
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, digest, sketch``; the digest stands for the whole set, the sketch is its k smallest values."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1, PIECE)):
            sizes, digests, kept = [], [], []
            for s in shingle_sets(b.column(1)):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                kept.append(s[:k].view(np.int64).copy())  # a view would keep the whole set
            ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept), pa.int64()))], names=["doc_id", "n_shingles", "digest", "sketch"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(released(sketch), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_shingles long, digest binary, sketch array<long>")


def similar_enough(shared: int, union: int) -> bool:
    """The contract's bound, in integers."""
    return union > 0 and 100 * shared >= 75 * union


def _met(pairs: DataFrame, what: DataFrame, column: str) -> DataFrame:
    """``a, b`` with ``column`` of both.  The last shuffle goes by ``b``: many pairs share one pivot ``a``."""
    x, y = (what.select(F.col("rep").alias(n), F.col(column).alias(f"_{n}")) for n in "ab")
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "_a", "_b")


def _estimate(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``a, b`` of the pairs whose estimated similarity does not rule them out."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                twice = both[1:] == both[:-1]
                union = len(both) - int(twice.sum())
                if len(x) < k and len(y) < k:
                    ok = similar_enough(int(twice.sum()), union)  # both sketches are the full sets
                else:
                    # the k smallest of the union, and how many of them both retain
                    first = np.concatenate([[True], ~twice])
                    upto = int(np.searchsorted(np.cumsum(first), min(k, union), side="right"))
                    size = min(k, union)
                    ok = int(twice[: max(upto - 1, 0)].sum()) / size >= 0.75 - 5 * (0.1875 / size) ** 0.5
                if ok:
                    keep.append(i)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return _met(pairs, classes, "sketch").mapInArrow(released(estimate), f"a {kind}, b {kind}")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough; ``texts`` has ``rep, text``."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for half in slices(whole, 2, PIECE) for part in slices(half, 3, PIECE)):
            keep = []
            left = batch.column(2).dictionary_encode()  # a text that meets many is hashed once
            have = shingle_sets(left.dictionary)
            for i, (code, other) in enumerate(zip(left.indices.to_pylist(), shingle_sets(batch.column(3)), strict=True)):
                shared = len(np.intersect1d(have[code], other, assume_unique=True))
                if similar_enough(shared, len(have[code]) + len(other) - shared):
                    keep.append(i)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return _met(pairs, texts, "text").mapInArrow(released(confirm), f"a {kind}, b {kind}").distinct()


def _comparable(x: str = "n", y: str = "n2"):
    """Sets whose sizes alone allow the similarity."""
    return 4 * F.least(F.col(x), F.col(y)) >= 3 * F.greatest(F.col(x), F.col(y))


def listed(classes: DataFrame, least_shared: int) -> DataFrame:
    """``v, rep, n, m``: the inverted lists of each class's rarest values; ``m`` is the length of the list.  Stored."""
    postings = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("sketch").alias("v"))
    live = postings.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    shared = postings.join(live, "v").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    rare = shared.withColumn("vs", F.expr(f"slice(vs, 1, greatest(size(vs) - least({least_shared}, cast(ceil(n * 0.75D) as int)) + 1, 0))")).filter(F.size("vs") > 0)
    rare = store(rare.select("rep", "n", F.explode("vs.v").alias("v")), "dedup-lists")
    lengths = rare.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1")
    out = store(rare.join(lengths, "v"), "dedup-members")
    drop(rare)
    return out


def _shared_counts(sketches: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """How many values each two sketches share.  Values of few sketches are counted pair by pair, the others by
    matrix products over ``chunk`` of them at a time, so memory is that of the result and one chunk."""
    n = len(sketches)
    _, code, times = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(x) for x in sketches])[np.argsort(code, kind="stable")]
    starts = np.cumsum(times) - times
    shared = np.zeros(n * n, np.int64)
    few = 6
    for c in range(2, few + 1):
        at = starts[times == c]
        for i in range(c):
            for j in range(i + 1, c):
                x, y = row[at + i], row[at + j]
                shared += np.bincount(np.minimum(x, y) * n + np.maximum(x, y), minlength=n * n)
    shared = shared.reshape(n, n)
    shared = shared + shared.T
    often = np.flatnonzero(times > few)
    for k in range(0, len(often), chunk):
        part = often[k : k + chunk]
        has = np.zeros((n, len(part)), np.float32)
        has[row[np.concatenate([np.arange(starts[v], starts[v] + times[v]) for v in part])], np.repeat(np.arange(len(part)), times[part])] = 1
        shared += (has @ has.T).astype(np.int64)
    return shared


def _dense(members: DataFrame, classes: DataFrame, k: int, least_shared: int, block: int = 512) -> DataFrame:
    """Pairs ``a, b`` of lists whose members are still in different groups, compared block by block.

    Lists that have members in common form a cluster.  A cluster is cut into blocks by a hash, and each pair of
    blocks is one bounded group that counts shared values as a matrix product; a row leaves it only for a pair that
    shares enough.
    """
    heads = members.groupBy("v").agg(F.min("rep").alias("head"))
    stars = members.join(heads, "v").filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    clusters = components(stars).select(F.col("node").alias("rep"), F.col("component").alias("v"))
    sizes = clusters.groupBy("v").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    rows = members.select("rep", "n", "component").distinct().join(clusters, "rep").join(sizes, "v")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rep", F.lit(17)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("v", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "rep", "n", "component")
    rows = rows.join(classes.select("rep", F.col("n_shingles").alias("n"), "sketch"), ["rep", "n"])

    def compare(key, pdf):
        pdf = pdf.drop_duplicates("rep").sort_values("rep")
        shared = _shared_counts(pdf["sketch"].to_list())
        n, group, side = pdf["n"].to_numpy(), pdf["component"].to_numpy(), pdf["i"].to_numpy()
        full = (n < k)[:, None] & (n < k)[None, :]
        enough = np.where(full, 100 * shared >= 75 * (n[:, None] + n[None, :] - shared), shared >= least_shared)
        cross = (group[:, None] != group[None, :]) & (4 * np.minimum(n[:, None], n[None, :]) >= 3 * np.maximum(n[:, None], n[None, :]))
        if key[1] != key[2]:
            cross &= side[:, None] != side[None, :]
        x, y = np.nonzero(np.triu(enough & cross, 1))
        # Where both sets are complete the pair is a link, and one link joins two groups; the rest still need a look.
        sure = full[x, y]
        ends = np.sort(np.stack([pd.factorize(group)[0][x], pd.factorize(group)[0][y]], 1), axis=1)
        once = np.unique(ends[sure], axis=0, return_index=True)[1] if sure.any() else np.empty(0, int)
        keep = np.concatenate([np.flatnonzero(sure)[once], np.flatnonzero(~sure)])
        x, y = x[keep], y[keep]
        rep = pdf["rep"].to_numpy()
        return pd.DataFrame({"a": rep[x], "b": rep[y]})

    kind = members.schema["rep"].dataType.simpleString()
    return rows.groupBy("v", "lo", "hi").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


class _Links:
    """The groups that confirmed links make so far."""

    def __init__(self, texts: DataFrame, kind: str):
        self.texts = texts
        self.groups = texts.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
        self.any = False

    def add(self, tried: DataFrame) -> None:
        tried = store(tried.select("a", "b"), "dedup-candidates")  # stored, so that Spark knows how few they are
        new = store(_confirm(tried, self.texts), "dedup-links")
        if not new.isEmpty():
            # a group so far is a star around its component
            self.groups = components(new.union(self.groups.select("node", "component")) if self.any else new)
            self.any = True
        drop(tried, new)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different groups."""
        if not self.any:
            return pairs
        of = lambda n: self.groups.select(F.col("node").alias(n), F.col("component").alias(f"g{n}"))
        met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return met.filter(F.coalesce("ga", "a") != F.coalesce("gb", "b")).drop("ga", "gb")

    def mixed(self, lists: DataFrame) -> DataFrame:
        """The members (``v, rep, n, component``) of lists that have members of different groups.  Stored."""
        mine = lists.select("v", "rep", "n").join(self.groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_lists = mine.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("v")
        return store(mine.join(open_lists, "v", "left_semi"), "dedup-mixed")


def _short_pairs(lists: DataFrame, small: int) -> DataFrame:
    """``a, b``: all pairs of lists of at most ``small`` members."""
    short = lists.filter(F.col("m") <= small)
    other = short.select("v", F.col("rep").alias("rep2"), F.col("n").alias("n2"))
    return short.join(other, "v").filter((F.col("rep") < F.col("rep2")) & _comparable()).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))


def _pivot_pairs(lists: DataFrame) -> DataFrame:
    """``a, b``: each member with the smallest of its list."""
    first = lists.groupBy("v").agg(F.min(F.struct("rep", "n")).alias("p"))
    met = lists.join(first, "v").filter((F.col("rep") != F.col("p.rep")) & _comparable("n", "p.n"))
    return met.select(F.col("p.rep").alias("a"), F.col("rep").alias("b"))


def link(docs: DataFrame, classes: DataFrame, *, k: int = K, least_shared: int = LEAST_SHARED, deep_k: int = DEEP_K, deep_shared: int = DEEP_SHARED, small: int = 8) -> DataFrame:
    """``node, component`` of the classes that have links."""
    lists = listed(classes, least_shared)
    # From here on only classes that share a rare value with another matter: their sketches and texts are taken out once.
    ids = store(lists.select("rep").distinct(), "dedup-live")
    live = store(may_be_among(classes.select("rep", "n_shingles", "sketch"), "rep", ids, "rep").join(ids, "rep", "left_semi"), "dedup-live")
    texts = may_be_among(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", ids, "rep").join(ids, "rep", "left_semi")
    texts = store(texts.dropDuplicates(["rep", "text"]), "dedup-texts")
    found = _Links(texts, classes.schema["rep"].dataType.simpleString())
    long = lists.filter(F.col("m") > small)
    found.add(_estimate(_short_pairs(lists, small).union(_pivot_pairs(long)).distinct(), live, k))
    left = found.mixed(long)
    if not left.isEmpty():
        of_left = left.select(F.col("rep").alias("doc_id")).distinct()
        deep = sketches(texts.withColumnRenamed("rep", "doc_id").join(of_left, "doc_id", "left_semi"), deep_k).filter("n_shingles > 0")
        deep = store(deep.groupBy(F.col("doc_id").alias("rep"), "digest").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "dedup-deep")
        more = listed(deep, deep_shared)
        rest = found.mixed(more.filter(F.col("m") > small))
        pairs = found.apart(_short_pairs(more, small))
        if not rest.isEmpty():
            pairs = pairs.union(_dense(rest, deep, deep_k, deep_shared))
        found.add(_estimate(pairs.distinct(), deep, deep_k))
        drop(deep, more, rest)
    drop(lists, ids, live, texts, left)
    return found.groups


def near_duplicates(docs: DataFrame, *, k: int = K, least_shared: int = LEAST_SHARED) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row out for each row in.

    Texts without words (null, empty, blank) have no shingles and no links.  Repeated rows are linked with each
    other.  Rows that share a doc_id but not a text count as one document with several texts.  Rows without a
    doc_id take no part: their component is null and they are kept.  Other columns are ignored; an empty table
    gives an empty result.
    """
    base = store(sketches(docs, k), "dedup-sketches")
    sets = base.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = store(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "dedup-classes")
    groups = link(docs, classes, k=k, least_shared=least_shared).withColumnRenamed("node", "rep")
    where = classes.select("digest", "rep").join(groups, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = base.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(where, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns, whatever these are called: the one with the group's smallest
    doc_id.

    Of several rows with that doc_id the one whose text, then whose row has the smallest hash stays, so reruns agree.
    Rows without a doc_id stay, null and empty texts are documents of their own, an empty table stays empty.  Only
    rows that are removed or share their doc_id are shuffled; the others pass.
    """
    found = store(near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "dedup-kept")
    touched = store(found.filter("NOT kept OR n > 1").select(F.col("doc_id").alias("_id"), "kept"), "dedup-touched")
    drop(found)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    passing = may_be_among(rows, "_id", touched, "_id", inside=False)
    looked = may_be_among(rows, "_id", touched, "_id").join(touched, "_id", "left").filter("kept IS NULL OR kept")
    order: list[Column] = [F.xxhash64("_row.text"), F.xxhash64(F.to_json("_row"))]
    one = looked.withColumn("_n", F.when(F.col("kept"), F.row_number().over(Window.partitionBy("_id").orderBy(*order))).otherwise(1)).filter("_n = 1")
    return passing.select("_row.*").unionByName(one.select("_row.*"))
