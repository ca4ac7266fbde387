"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts become lower-case words of letters and digits.  Each mask takes some positions of a short window and ignores
the others, so a window still hits when ignored words were substituted; wherever ``share`` of the words agree, one does.  Benchmark windows are hashed under every
mask; training windows are hashed alike and joined with them.  At each hit the two texts are laid side by side and
the words that agree are counted over each ``window`` words of the item around it (the whole item if it is shorter);
an item leaks when at least ``share`` of them agree somewhere.  The work is linear in the training text: a first pass asks which
documents have a hit at all, over windows that carry nothing but their hash, and a second one looks at those documents.  Windows are never
grouped or shuffled, only the few that hit a benchmark hash go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import may_be_among, store

#: 1: the word counts, 0: it is ignored.
#: The set is complete: if at least 75 % of the 9 to 24 words of a window agree, one of the masks fits somewhere into those that do.
MASKS = ("110111", "11010011", "11111", "111001001", "100101011")
#: Above this many bytes of benchmark seeds, with their items, nothing is broadcast, and Spark shuffles the windows.
BROADCAST_BYTES = 128 << 20


def words(text: Column) -> Column:
    """Hashes of the words of a text; null has none."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _seed(array: str, pos: str, number: int, mask: str) -> Column:
    """Hash of the words under a mask; null where the window leaves the text."""
    taken = [F.get(F.col(array), F.col(pos) + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(F.col(pos) + (len(mask) - 1) < F.size(array), F.xxhash64(F.lit(number), *taken))


def _windows(df: DataFrame, masks: dict[int, str], keep: list[str], array: str, pos: str) -> DataFrame:
    shortest = min(map(len, masks.values()))
    # explode_outer: for explode, Spark would add a filter that splits every text a second time
    df = df.withColumn(pos, F.explode_outer(F.when(F.size(array) >= shortest, F.sequence(F.lit(0), F.size(array) - shortest))))
    return df.select(*keep, array, pos, F.explode_outer(F.array(*[_seed(array, pos, i, m) for i, m in masks.items()])).alias("seed")).filter("seed IS NOT NULL")


def leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = 24, share: float = 0.75) -> DataFrame:
    """``doc_id, item_id, matched, compared, doc_word``: one row for each document and item that leaks into it.

    Of several places the one with the most agreeing words counts, then the first one.  Null and empty texts on
    either side have no leaks; repeated rows give one row; an empty table gives an empty result.  Items of fewer
    words than the longest mask count only where all their words appear in a row.  Rows without a doc_id count as one
    document whose id is null.  Other columns are ignored.
    """
    if not 0 < window <= 32:
        raise ValueError("window must be 1 to 32 words")
    span = max(map(len, MASKS))
    items = benchmark.select("item_id", words(F.col("text")).alias("iw")).filter(F.size("iw") > 0)
    # At most span - 1 numbers come to the driver.
    short = sorted(r[0] for r in items.filter(F.size("iw") < span).select(F.size("iw")).distinct().collect())
    if items.isEmpty():
        kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, matched long, compared long, doc_word long"
        return docs.sparkSession.createDataFrame([], kinds)
    # An item shorter than the longest mask is met by a mask of its own length that takes all words.
    own = {len(MASKS) + k: "1" * n for k, n in enumerate(short)}
    masks = dict(enumerate(MASKS))
    parts = [_windows(items.filter(F.size("iw") >= span), masks, ["item_id"], "iw", "ip")]
    parts += [_windows(items.filter(F.size("iw") == len(m)), {k: m}, ["item_id"], "iw", "ip") for k, m in own.items()]
    seeds = store(reduce(DataFrame.union, parts).select("seed", "item_id", "ip", "iw").distinct(), "decontam-seeds")
    n_seeds, longest = seeds.agg(F.count("*"), F.coalesce(F.max(F.size("iw")), F.lit(0))).first()
    fits = n_seeds * (longest + 16) * 8 <= BROADCAST_BYTES
    at_hand = F.broadcast if fits else (lambda df: df)

    # First only which documents have a hit, as windows that carry no text; few have, and only these are laid beside the items.
    known = store(seeds.select(F.col("seed").alias("s")).distinct(), "decontam-known")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("_k"))
    w = _windows(keyed.select("_k", words(F.col("text")).alias("dw")), masks | own, ["_k"], "dw", "dp").select("_k", "seed")
    hit = store(w.join(at_hand(known), F.col("seed") == F.col("s"), "left_semi").select("_k").distinct(), "decontam-hit")
    some = may_be_among(keyed, "_k", hit, "_k")
    w = _windows(some.select("doc_id", words(F.col("text")).alias("dw")), masks | own, ["doc_id"], "dw", "dp")
    met = w.join(at_hand(known), F.col("seed") == F.col("s"), "left_semi")
    # What is compared lies within ``window`` words of the hit; the rest of a long text is dropped here.
    low = F.greatest(F.col("dp") - window, F.lit(0))
    met = met.select("doc_id", "seed", "dp", low.alias("low"), F.slice("dw", low + 1, F.lit(2 * window + span)).alias("near"))
    met = met.join(at_hand(seeds), "seed")
    size = F.least(F.size("iw"), F.lit(window))
    # The words that agree, from the first to the last window of the item that holds the hit, as bits; the last word is bit 0.
    low_i, high_i = F.greatest(F.col("ip") - size + 1, F.lit(0)), F.least(F.col("ip") + size, F.size("iw"))
    met = met.withColumn("compared", size).withColumn("from", low_i).withColumn("upto", high_i).withColumn("shift", F.col("dp") - F.col("ip"))
    same = lambda i: F.coalesce(F.when(F.col("shift") + i >= 0, F.get("near", F.greatest(F.col("shift") + i - F.col("low"), F.lit(0)))) == F.get("iw", i), F.lit(False))
    met = met.withColumn("bits", F.aggregate(F.sequence("from", F.col("upto") - 1), F.lit(0).cast("long"), lambda acc, i: acc * 2 + same(i).cast("long")))
    # written down: the filter below would otherwise be pushed down and count the bits dozens of times
    met = store(met.select("doc_id", "item_id", "compared", "from", "upto", "shift", "bits"), "decontam-bits")
    # Of the windows of an item the one with the most words that agree, then the first.
    last = F.col("upto") - F.col("from") - F.col("compared")
    counts = [F.when(last >= k, F.expr(f"bit_count(shiftright(bits, upto - from - compared - {k}) & (shiftleft(1L, compared) - 1)) * 64 + 63 - {k}")) for k in range(window)]
    met = met.withColumn("_most", F.greatest(*counts)) if window > 1 else met.withColumn("_most", counts[0])
    met = met.withColumn("matched", F.expr("_most div 64").cast("int")).withColumn("doc_word", F.col("shift") + F.col("from") + 63 - F.pmod("_most", F.lit(64)))
    found = met.filter((F.col("matched") >= F.col("compared") * F.lit(share)) & ((F.col("compared") >= span) | (F.col("matched") == F.col("compared"))))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("matched"), F.col("compared"), (-F.col("doc_word")).alias("d"))).alias("_"))
    return best.select("doc_id", "item_id", F.col("_.matched").cast("long").alias("matched"), F.col("_.compared").cast("long").alias("compared"), (-F.col("_.d")).cast("long").alias("doc_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` without leaks, with all their columns, whatever these are called; rows without a doc_id
    cannot be named by a leak and stay."""
    # stored, so that Spark knows how few they are before it decides how to join
    found = store(leaks(docs, benchmark, **params).select(F.col("doc_id").alias("_doc")).distinct(), "decontam-leaks")
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"))
    return wrapped.join(found, "_doc", "left_anti").select("_row.*")
