"""Mixing sources to target weights by a low-discrepancy schedule over shuffled equal-token blocks.

1. Sources get targets: their share of the budget by weight, never over ``max_epochs`` times their size; what is
   cut off is shared among the others by weight until no source is above its bound.
2. Within each source the documents are shuffled by a hash and laid end to end; the line is cut into blocks of
   equally many words, at least ``LEAST_BLOCKS`` of them where the source has as many words.  Positions come from two prefix sums, one over hash ranges and one inside each range, so no
   source has to pass through one task.
3. Slot i of the schedule is the point frac((i + 1/2) * golden ratio), mapped to a source through the cumulative
   numbers of slots that the targets need, with some to spare for each source.  The slots of a source are ranked; rank r plays block r modulo the source's blocks.  A slot that would
   pass the source's target is cut there, and later slots of that source are left out.
4. A document has taken the words it shares with the played blocks.

Null texts have size 0, a null source is a source of its own.  Rows of size 0 are returned with 0 taken.  Repeated
rows are rows of their own; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import store, word_count

#: Fixed values of the query contract: weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: frac(golden ratio).
GOLDEN = 0.6180339887498949
#: Cells of the unit interval by which points meet sources.
CELLS = 4096
#: A source smaller than this many of the largest blocks gets smaller ones.
LEAST_BLOCKS = 64
#: Slots to spare for each source: more than the points of an interval stray from its share (below 0.7 ln n + 3 for this sequence).
SPARE_SLOTS = 20


def _running(by: list[str], order: list, upto: int):
    w = Window.partitionBy(*by).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, upto)


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def source_targets(sizes: DataFrame, budget: float = 1.5, weights=WEIGHTS, max_epochs: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (``source, source_size``).

    Sources are ordered by code point, null last.  In order of bound per weight, the full sources are a prefix, so
    one running sum finds them without iteration.  These windows see one row per source, not the documents.
    """
    by_name, by_fill = [F.col("source").asc_nulls_last()], [F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()]
    index = F.pmod(F.row_number().over(Window.orderBy(*by_name)) - 1, F.lit(len(weights))) + 1
    every = Window.partitionBy()
    s = (
        sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), index.cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_left", F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("_cap").over(_running([], by_fill, -1)), F.lit(0.0)))
        .withColumn("_open_w", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(_running([], by_fill, -1)), F.lit(0.0)))
        # words per unit of weight if all sources before this one are full
        .withColumn("_level", F.col("_left") / F.col("_open_w"))
        .withColumn("_rank", F.row_number().over(Window.orderBy(*by_fill)))
        .withColumn("_first", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_rank", "_level"))).over(every))
    )
    full = F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank"))
    return s.withColumn("target", F.when(full, F.col("_cap")).otherwise(F.col("_first._level") * F.col("_w"))).select("source", "source_size", "target")


def place(docs: DataFrame, rows: int, rows_per_range: int = 20_000) -> DataFrame:
    """Adds ``start``: each document's first word position in its source's shuffled line (``source, size, h, tie`` given)."""
    bits = min(40, (rows // rows_per_range).bit_length())
    d = docs.withColumn("_range", F.shiftrightunsigned("h", 64 - bits).cast("long") if bits else F.lit(0).cast("long"))
    ranges = d.groupBy("source", "_range").agg(F.sum("size").alias("_n"))
    ranges = ranges.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(_running(["source"], ["_range"], -1)), F.lit(0)).alias("_base"))
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(_running(["source", "_range"], ["h", "tie", "doc_id", "size"], -1)), F.lit(0)))
    return d.join(ranges, _same("source", "_s") & (F.col("_range") == F.col("_r"))).withColumn("start", F.col("_base") + F.col("_in")).drop("_range", "_base", "_in", "_s", "_r")


def blocked(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds ``block_words``, the words of the source's blocks, and ``slots``, those laid so that it reaches its target."""
    size, words = F.greatest("source_size", F.lit(1)), F.floor("target")
    t = targets.withColumn("block_words", F.least(F.lit(block_words).cast("long"), F.ceil(size / F.lit(LEAST_BLOCKS))))
    epochs = F.floor(words / size)
    need = epochs * F.ceil(size / F.col("block_words")) + F.ceil((words - epochs * size) / F.col("block_words"))
    return t.withColumn("slots", F.when(words > 0, F.ceil(need * F.lit(1.02)) + SPARE_SLOTS).otherwise(0))


def schedule(targets: DataFrame, n: int) -> DataFrame:
    """``slot, source, block, cut``: the slots in play, each with its source's block and the words it plays of it.

    ``targets`` comes from ``blocked``, and ``n`` is the sum of its slots; those beyond the targets are left out.
    A point meets the sources of its cell of the unit interval by an equi-join.  Ranks within a source come from
    counts by range of slots and row numbers inside a range.
    """
    upto = lambda last: F.coalesce(F.sum("slots").over(_running([], [F.col("source").asc_nulls_last()], last)), F.lit(0)) / F.lit(float(n or 1))
    share = targets.filter(F.col("slots") > 0).withColumn("_lo", upto(-1)).withColumn("_hi", upto(0))
    share = share.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1)))))
    slots = share.sparkSession.range(n).withColumn("_x", F.pmod((F.col("id") + F.lit(0.5)) * F.lit(GOLDEN), F.lit(1.0)))
    slots = slots.withColumn("_c", F.floor(F.col("_x") * CELLS)).withColumn("_range", F.expr("id div 16384"))
    hits = slots.join(share, (F.col("_c") == F.col("_cell")) & (F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi"))).select("id", "_range", "source", "source_size", "target", "block_words")
    counts = hits.groupBy("source", "_range").agg(F.count("*").alias("_n"))
    counts = counts.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(_running(["source"], ["_range"], -1)), F.lit(0)).alias("_base"))
    hits = hits.withColumn("_in", F.row_number().over(Window.partitionBy("source", "_range").orderBy("id")) - 1)
    hits = hits.join(counts, _same("source", "_s") & (F.col("_range") == F.col("_r"))).withColumn("_rank", F.col("_base") + F.col("_in"))
    b = F.col("block_words")
    blocks = F.ceil(F.col("source_size") / b)
    hits = hits.withColumn("block", F.pmod(F.col("_rank"), blocks)).withColumn("_before", F.floor(F.col("_rank") / blocks) * F.col("source_size") + F.col("block") * b)
    cut = F.least(b, F.floor(F.col("target")) - F.col("_before"), F.col("source_size") - F.col("block") * b)
    return hits.withColumn("cut", cut).filter("cut > 0").select(F.col("id").alias("slot"), "source", "block", "cut")


def mix(docs: DataFrame, *, budget: float = 1.5, weights=WEIGHTS, max_epochs: float = 2.0, block_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with ``taken`` and ``begun``, schedule in play order).

    ``begun`` counts the plays that hold the document's first word.  ``block_words`` is the largest
    block; without it, it is a ten-thousandth of the mean target, from 16 to 65,536 words, so the schedule's length
    does not grow with the input beyond what the largest block gives.  Small sources have smaller blocks.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    base = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("h"), tie.alias("tie")), "mix-sizes")
    targets = store(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), budget, weights, max_epochs).coalesce(1), "mix-targets")
    total, n_sources = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    block_words = block_words or int(min(max(total / max(n_sources, 1) / 10_000, 16), 65_536))
    targets = store(blocked(targets, block_words).coalesce(1), "mix-blocks")
    plays = store(schedule(targets, targets.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]), "mix-schedule")
    by_block = plays.groupBy("source", "block").agg(F.collect_list("cut").alias("cuts")).withColumnsRenamed({"source": "_s", "block": "_b"})
    b = F.col("block_words")
    blocks = targets.select(F.col("source").alias("_t"), "block_words")
    placed = place(base.filter("size > 0"), base.count()).join(blocks, _same("source", "_t"))
    parts = placed.withColumn("_block", F.explode(F.sequence(F.expr("start div block_words"), F.expr("(start + size - 1) div block_words"))))
    parts = parts.withColumn("_from", F.greatest(F.col("start") - F.col("_block") * b, F.lit(0))).withColumn("_to", F.least(F.col("start") + F.col("size") - F.col("_block") * b, b))
    met = parts.join(by_block, _same("source", "_s") & (F.col("_block") == F.col("_b")), "left")
    words = F.expr("aggregate(cuts, 0L, (a, c) -> a + greatest(least(c, _to) - _from, 0L))")
    begun = F.expr("if(_block = start div block_words, size(filter(cuts, c -> c > _from)), 0)")
    taken = met.groupBy("doc_id", "source", "start", "size").agg(F.sum(F.coalesce(words, F.lit(0))).cast("long").alias("taken"), F.sum(F.when(F.col("cuts").isNotNull(), begun).otherwise(0)).cast("long").alias("begun"))
    none = base.filter("size = 0").select("doc_id", "source", F.lit(0).cast("long").alias("start"), "size", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("begun"))
    t = targets.withColumnRenamed("source", "_s")
    out = taken.unionByName(none).join(t, _same("source", "_s"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "begun"), plays


def mixed_rows(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` as often as the mix begins them, with all their columns, whatever these are called; a row it
    never begins is left out.

    Rows that share a doc_id are repeated alike, as often as the most frequent of them.
    """
    taken = mix(docs, **params)[0].groupBy("doc_id").agg(F.max("begun").alias("_begun")).filter("_begun > 0").withColumnRenamed("doc_id", "_id")
    taken = store(taken, "mix-taken")
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"))
    met = wrapped.join(taken, _same("_doc", "_id"))
    return met.select("_row", F.explode(F.sequence(F.lit(1), F.col("_begun").cast("int"))).alias("_copy")).select("_row.*")
