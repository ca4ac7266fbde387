"""Extendible hashing: shards are the leaves of a directory indexed by leading bits of a row's hash.

A bucket above the byte limit splits on its next bit; buckets within the limit do not.  The sums that decide this
come from counts by hash cell, so a split never moves rows: only cells that are still too large at the deepest bit
counted so far are counted again, deeper.  The work on rows is one hash, one partial aggregation and one join with
the directory.

Rows with one key hash alike.  Where they exceed the limit together, their bits go on with those of their text's hash and then
of a number of their own, in a directory under that key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import byte_length, store

#: In memory, the directory is broadcast up to so many bytes at so many a cell; beyond, rows are shuffled to their cells.
BROADCAST_BYTES, CELL_BYTES = 64 << 20, 192
#: Bits of the hash in use: 15 hexadecimal digits, so that cells stay positive longs.
BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a long; null hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def own_bits(text: Column, number: Column) -> Column:
    """60 bits that tell rows with one key apart: 24 of the text's hash, then 36 of the row's number."""
    some = lambda c, bits: F.shiftrightunsigned(c, 64 - bits)
    return F.shiftleft(some(F.xxhash64(F.coalesce(text, F.lit(""))), 24), 36).bitwiseOR(some(F.xxhash64(number), 36))


def _levels(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Sums of each bucket at each depth from ``low`` to ``high``; ``cells`` has one row per cell at depth ``high``."""
    depth = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    each = cells.select("root", "cell", "bytes", "docs", depth).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    return each.groupBy("root", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))


def directory(rows: DataFrame, limit: int, step: int = 4) -> DataFrame:
    """``root, cell_depth, cell, depth, shard, shard_bytes, shard_docs``: the leaf of each occupied cell.

    ``rows`` has ``root``, the tree a row belongs to, ``h`` and ``n_bytes``.  A bucket is a leaf when it fits the limit, when it
    holds one row (a row larger than the limit is a shard of its own), or when all hash bits are used up.
    """
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(BITS, max(1, (int(total) // limit).bit_length()) + step)
    found, open_rows = [], rows
    while True:
        cells = open_rows.groupBy("root", F.shiftright("h", BITS - high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
        cells = store(cells, "shard-cells")
        sums = _levels(cells, low, high).filter((F.col("bytes") <= limit) | (F.col("docs") == 1) | (F.col("depth") == BITS))
        leaf = cells.select("root", "cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        leaf = leaf.join(sums, ["root", "depth", "prefix"]).groupBy("root", "cell").agg(F.min(F.struct("depth", "prefix", "bytes", "docs")).alias("_"))
        leaf = store(leaf.select("root", F.lit(high).alias("cell_depth"), "cell", "_.depth", "_.prefix", F.col("_.bytes").alias("shard_bytes"), F.col("_.docs").alias("shard_docs")), "shard-leaves")
        found.append(leaf)
        rest = cells.join(leaf, ["root", "cell"], "left_anti").select("root", "cell")
        if high == BITS or rest.isEmpty():
            break
        open_rows = store(open_rows.withColumn("cell", F.shiftright("h", BITS - high)).join(rest, ["root", "cell"], "left_semi").drop("cell"), "shard-open")
        low, high = high + 1, min(BITS, high + 2 * step)
    out = reduce(DataFrame.unionByName, found)
    # Bits of the prefix, most significant first; the root alone is the empty string.
    return out.withColumn("shard", F.expr("if(depth = 0, '', lpad(bin(prefix), depth, '0'))")).drop("prefix")


def assign(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Joins each row (with ``_root`` and ``h``) with its leaf; the directory's size decides how."""
    depths = leaves.groupBy("cell_depth").count().collect()  # at most a dozen rounds
    fits = sum(r["count"] for r in depths) * CELL_BYTES <= BROADCAST_BYTES
    parts = []
    for d in sorted(r["cell_depth"] for r in depths):
        part = leaves.filter(F.col("cell_depth") == d).drop("cell_depth").withColumnsRenamed({"cell": "_cell", "root": "_root"})
        part = F.broadcast(part) if fits else part.hint("merge")
        parts.append(rows.withColumn("_cell", F.shiftright("h", BITS - d)).join(part, ["_cell", "_root"]).drop("_cell", "_root"))
    return reduce(DataFrame.unionByName, parts)


def _placed(rows: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """``rows`` (``h``, ``own``, ``n_bytes`` and others) with their shards; ``sizes`` has ``h`` and ``n_bytes`` of the same rows, stored."""
    none = F.lit(0).cast("long").alias("_root")
    leaves = store(directory(sizes.select(none.alias("root"), "h", "n_bytes"), limit), "shard-directory")
    over = leaves.filter((F.col("depth") == BITS) & (F.col("shard_docs") > 1) & (F.col("shard_bytes") > limit))
    if leaves.isEmpty():
        return rows.select("*", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs")).filter("false")
    if over.isEmpty():
        return assign(rows.withColumn("_root", none), leaves)
    # what the hot keys' rows are is written down, so that the numbers of their own stay
    hot = store(over.select(F.expr("conv(shard, 2, 10)").cast("long").alias("h")).distinct(), "shard-hot")
    again = store(rows.join(hot, "h", "left_semi"), "shard-hot-rows").withColumn("_root", F.col("h")).withColumn("_h", F.col("h")).withColumn("h", F.col("own"))
    below = store(directory(again.select(F.col("_root").alias("root"), "h", "n_bytes"), limit), "shard-directory")
    deep = assign(again, below.withColumn("shard", F.concat(F.expr(f"lpad(bin(root), {BITS}, '0')"), "shard")).withColumn("depth", F.col("depth") + BITS))
    deep = deep.withColumn("h", F.col("_h")).drop("_h")
    rest = rows.join(hot, "h", "left_anti").withColumn("_root", none)
    return assign(rest, leaves).unionByName(deep)


def shard(docs: DataFrame, limit_bytes: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, shard, depth, shard_bytes, shard_docs``, one row out for each row in.

    Null and empty texts have 0 bytes and still get a shard.  Rows with equal keys, also null ones, share a shard unless
    they exceed the limit together; then they are told apart by text, and equal texts by row.  So only a single row above
    the limit makes a shard that is.  An empty table gives an empty result.
    """
    own = own_bits(F.col(text), F.monotonically_increasing_id())
    rows = store(docs.select(F.col(key).alias("doc_id"), byte_length(F.col(text)).alias("n_bytes"), hash_bits(F.col(key)).alias("h"), own.alias("own")), "shard-rows")
    return _placed(rows, rows, limit_bytes).select(F.col("doc_id").alias(key), "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_docs")


def sharded_rows(docs: DataFrame, limit_bytes: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``shard, depth, shard_bytes, shard_docs``; the directory is built from narrow rows.

    Nulls, repeated rows and empty tables are treated as by ``shard``.  A column of ``docs`` that has one of the four
    names gives way to it; all others keep their names and values.
    """
    n_bytes, h = byte_length(F.col(text)).alias("n_bytes"), hash_bits(F.col(key)).alias("h")
    added = ["shard", "depth", "shard_bytes", "shard_docs"]
    kept = [c for c in docs.columns if c not in added]
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), h, n_bytes, own_bits(F.col(text), F.monotonically_increasing_id()).alias("own"))
    placed = _placed(wrapped, store(docs.select(h, n_bytes), "shard-rows"), limit_bytes)
    return placed.select("_row.*", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_docs")
