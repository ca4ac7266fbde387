"""Merkle manifest of a dataset: one hash tree a source, one tree over the sources, and a proof for every row.

Spark hashes the rows, ranks them inside their source by range partitions and counts, and deals aligned buckets of
consecutive leaves to the executors.  There DuckDB works through whole buckets as Arrow tables: each level is an ordered
string_agg of 16 nodes and a sha256.  The roots of buckets, one row for 4,096 leaves, are combined by Spark level by
level, as are the roots of the sources; what lies outside a bucket joins its rows as the outer part of their proofs.

A hot source is many buckets.  Nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import released, store

#: Nodes that become one, and the hexadecimal digits of a node.
FANOUT, HEX = 16, 64
#: Levels inside a bucket.
LEVELS = 3
#: Rows of a range of the ranking, and rows that DuckDB gets at once unless a bucket has more.
RANGE_ROWS, BLOCK_ROWS = 250_000, 8_192
_STEPS = "array<struct<left:string,right:string>>"


def leaf(*fields: Column) -> Column:
    """H of the fields: ``-`` for null, else byte count, colon, value."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (steps of left and right siblings, from the leaf up) come to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """The siblings of a proof as one text, level by level, left to right."""
    return F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"])))


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` (stored) with ``pos``, the rank from 0 in its ``group`` by ``order``, and ``total``, the group's rows; group has no nulls.

    Rows are dealt by ranges of group, order and a number of their own, so neither a large group nor equal rows meet
    in one task; ranks are offsets of ranges plus places inside them.
    """
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    keys = [group, *order, "_row"]
    rows = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    rows = store(rows.drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "manifest-ranked")
    runs = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("total", F.sum("_n").over(Window.partitionBy(group)))
    runs = store(runs.drop("_n"), "manifest-runs")
    return rows.join(runs, [group, "_range"]).withColumn("pos", F.col("_base") + F.col("_at") - F.col("_first")).drop("_at", "_range", "_base", "_first")


def climb(nodes: DataFrame, group: str) -> DataFrame:
    """``group, idx, steps, top`` of ``nodes`` (``group, idx, many, h``; many: nodes of the group): the way of each node up
    to the one that remains.  A group of one node is its own top.  One round a level, each a grouping of at most 16."""
    out = nodes.select(group, "idx", F.array().cast(_STEPS).alias("steps"))
    level, most, span = nodes, nodes.agg(F.max("many")).first()[0] or 1, 1
    while most > 1:
        runs = level.groupBy(group, "many", F.expr(f"idx div {FANOUT}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("_n"))
        runs = store(runs.select(group, "many", "run", F.concat_ws("", F.transform("_n", lambda x: x["h"])).alias("nodes")), "manifest-level")
        place = (F.expr(f"idx div {span}") % FANOUT * HEX).cast("int")
        step = F.struct(F.substring("nodes", F.lit(1), place).alias("left"), F.substring("nodes", place + HEX + 1, F.length("nodes")).alias("right"))
        span *= FANOUT
        out = out.withColumn("run", F.expr(f"idx div {span}")).join(runs, [group, "run"])
        out = out.select(group, "idx", F.when(F.col("many") > 1, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"))
        level = runs.select(group, F.col("run").alias("idx"), F.ceil(F.col("many") / FANOUT).alias("many"), F.when(F.col("many") > 1, F.sha2(F.col("nodes").cast("binary"), 256)).otherwise(F.col("nodes")).alias("h"))
        most = -(-most // FANOUT)
    return store(out.join(level.select(group, F.col("h").alias("top")), group), "manifest-climbed")


def _level_sql() -> str:
    """Tables r1, r2, ..: the concatenated nodes of each run of a level inside the buckets of table ``b``."""
    parts = [f"r1 AS (SELECT src, bucket, levels, pos // {FANOUT} AS run, string_agg(leaf, '' ORDER BY pos) AS s FROM b WHERE levels >= 1 GROUP BY ALL)"]
    for k in range(2, LEVELS + 1):
        parts.append(f"r{k} AS (SELECT src, bucket, levels, run // {FANOUT} AS run, string_agg(sha256(s), '' ORDER BY r{k - 1}.run) AS s FROM r{k - 1} WHERE levels >= {k} GROUP BY ALL)")
    return "WITH " + ", ".join(parts)


_ROOTS = f"{_level_sql()} SELECT src, bucket, leaf AS h FROM b WHERE levels = 0" + "".join(f" UNION ALL SELECT src, bucket, sha256(s) FROM r{k} WHERE levels = {k}" for k in range(1, LEVELS + 1))
_STEP = "CASE WHEN b.levels >= {k} THEN [{{'left': left(r{k}.s, {at}), 'right': substr(r{k}.s, {at} + {hex} + 1)}}] ELSE [] END"
_PROOFS = (
    f"{_level_sql()} SELECT b.src, b.bucket, b.row, b.leaf, "
    + " || ".join(_STEP.format(k=k, hex=HEX, at=f"(b.pos // {FANOUT ** (k - 1)} % {FANOUT} * {HEX})::INT") for k in range(1, LEVELS + 1))
    + " AS steps FROM b"
    + "".join(f" LEFT JOIN r{k} ON r{k}.src = b.src AND r{k}.bucket = b.bucket AND r{k}.run = b.pos // {FANOUT**k}" for k in range(1, LEVELS + 1))
)


def _in_buckets(rows: DataFrame, sql: str, schema: str) -> DataFrame:
    """Runs ``sql`` over table ``b``, whole buckets of ``rows`` (``src, bucket, pos, levels, leaf`` and others), on the executors."""
    inside = FANOUT**LEVELS
    order = rows.columns.index("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})

        def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
            con.register("b", table)
            yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=2048)
            con.unregister("b")

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(held)
            # a bucket begins where the place inside buckets is 0
            begins = pc.indices_nonzero(pc.equal(pc.bit_wise_and(table.column(order), inside - 1), 0))
            last = begins[-1].as_py() if len(begins) else 0
            if last:
                yield from answer(table.slice(0, last))
            held, n = table.slice(last).to_batches(), table.num_rows - last
        if n:
            yield from answer(pa.Table.from_batches(held))
        con.close()

    return rows.repartition("src", "bucket").sortWithinPartitions("src", "bucket", "pos").mapInArrow(released(run), schema)


def manifest(docs: DataFrame, leaf_of: Column, *, source: str = "source", order: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """``row, leaf, subroot, root, proof``, one row out for each row of ``docs``; row is a struct of ``order`` and ``also``.

    ``proof`` has a step of left and right siblings for each level at which more than one node remained; ``folded``
    of leaf and proof is the root.  Leaves ascend by ``order`` (null first), equal ones by their hash; sources by the
    bytes of their name, null first.  Repeated rows are leaves of their own.  An empty table has no rows, so no root.
    """
    src = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("src")
    row = F.struct(F.col(f"`{order}`").alias("id"), *[c.alias(n) for n, c in (also or {}).items()]).alias("row")
    leaves = store(docs.select(src, row, leaf_of.alias("leaf")).withColumn("_by", F.col("row.id")), "manifest-leaves")
    placed = ranked(leaves, "src", ["_by", "leaf"]).drop("_by")
    depth = sum((F.col("total") > FANOUT**k).cast("int") for k in range(LEVELS))
    placed = store(placed.withColumn("levels", depth).withColumn("bucket", F.expr(f"pos div {FANOUT**LEVELS}")), "manifest-placed")
    buckets = store(_in_buckets(placed.drop("row", "total"), _ROOTS, "src string, bucket long, h string"), "manifest-buckets")
    totals = placed.groupBy("src").agg(F.ceil(F.max("total") / FANOUT**LEVELS).alias("many"))
    ways = climb(buckets.join(totals, "src").withColumnRenamed("bucket", "idx"), "src")
    tops = store(ways.groupBy("src").agg(F.first("top").alias("h")), "manifest-sources")
    sources = ranked(tops.withColumn("every", F.lit(0)), "every", ["src"])
    sources = store(sources.withColumnRenamed("pos", "idx").withColumnRenamed("total", "many"), "manifest-sources")
    over = climb(sources, "every").join(sources.select("idx", "src", F.col("h").alias("subroot")), "idx").select("src", "subroot", F.col("steps").alias("_over"), F.col("top").alias("root"))
    outer = store(ways.select("src", F.col("idx").alias("bucket"), "steps").join(over, "src").select("src", "bucket", F.concat("steps", "_over").alias("outer"), "subroot", "root"), "manifest-outer")
    kind = placed.schema["row"].dataType.simpleString()
    inner = _in_buckets(placed.drop("total"), _PROOFS, f"src string, bucket long, row {kind}, leaf string, steps {_STEPS}")
    return inner.join(outer, ["src", "bucket"]).select("row", "leaf", "subroot", "root", F.concat("steps", "outer").alias("proof"))
