"""Sharding by extendible hashing, with DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.spark import documents, stash

#: Bits of the hash that the directory can use.
BITS = 60
#: Bits below the expected depth that one pass looks at; buckets that need more get another pass.
AHEAD = 4
#: Buckets up to which the directory is broadcast (at most 2**AHEAD entries of some 100 bytes each); beyond, a shuffle join.
BROADCAST = 20_000
#: Copies of one row that a task makes anew.
STRETCH = 10_000


def hash_bits() -> F.Column:
    """60 hash bits of (doc_id, text) as a string of 0 and 1; null doc_id counts as '', null text as ''."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.lpad(F.bin(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")), BITS, "0")


def extendible_shards(docs: DataFrame, max_bytes: int, keep: list[str] | None = None) -> DataFrame:
    """Deal documents to shards of at most ``max_bytes`` of UTF-8 text.

    The directory is indexed by the first bits of a hash of (doc_id, text); a
    bucket over the limit, and no other, splits on its next bit.  Returns the
    columns ``keep`` (all of docs by default; an input column named like a
    result column gives way to it) and ``n_bytes``, ``shard`` (the bits, '' for
    an undivided table), ``depth`` (their number), ``page``.

    Null texts have 0 bytes.  A document that is larger than the limit gets a
    shard of its own.  Rows that agree in doc_id and text can't be told apart by
    any bit: if together they pass the limit, their bucket is chained into pages
    (0, 1, ...) that each fit; elsewhere page is 0.  Equal rows are counted, not
    gathered, so no hot key meets in one task.  An empty table gives no rows.
    Very long texts are documents like others.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("n_bytes", "shard", "depth", "page")]
    names = [f"k_{c}" for c in keep]
    rows = docs.select(*(docs[c].alias(n) for c, n in zip(keep, names)), hash_bits().alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    shards, full = _buckets(rows.select("bits", "n_bytes"), max_bytes)
    levels = [r[0] for r in shards.select("depth").distinct().collect()]  # at most 61
    top = min(max(levels, default=0), min(levels, default=0) + AHEAD)
    entries = directory(shards, top)
    entries = F.broadcast(entries) if shards.count() <= BROADCAST else entries
    dealt = rows.join(entries, F.substring("bits", 1, top) == F.col("entry")).select(*names, "bits", "n_bytes", "prefix", "depth")
    if deep := [d for d in levels if d > top]:  # buckets that split far more often than others: their rows try the depths in use
        below = shards.where(F.col("depth") > top)
        near = below.select(F.expr(f"left(prefix, {top})").alias("entry")).distinct()
        tried = rows.join(near, F.substring("bits", 1, top) == F.col("entry"), "left_semi")
        tried = tried.withColumn("prefix", F.explode(F.transform(F.array(*map(F.lit, sorted(deep))), lambda d: F.col("bits").substr(F.lit(1), d))))
        dealt = dealt.unionByName(tried.join(below, "prefix").select(*names, "bits", "n_bytes", "prefix", "depth"))
    dealt = dealt.withColumn("page", F.lit(0).cast("bigint"))
    if full.head(1):
        alike = dealt.join(full, "prefix", "left_semi").groupBy(*names, "bits", "n_bytes", "prefix", "depth").agg(F.count("*").alias("copies"))
        # rows that differ only in columns beside doc_id and text follow each other; a row here is a count, not a copy
        earlier = Window.partitionBy("prefix").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
        alike = alike.withColumn("kind", F.xxhash64(*names)).withColumn("before", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
        fit = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest(F.col("n_bytes"), F.lit(1))))
        # many copies of a row are dealt to tasks in stretches before they become rows again
        stretch = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / STRETCH))).alias("stretch")
        dealt_out = alike.select("*", stretch).repartition(*names, "bits", "stretch")
        each = F.sequence(F.col("stretch") * STRETCH, F.least(F.col("copies"), (F.col("stretch") + 1) * STRETCH) - 1)
        chain = dealt_out.withColumn("i", F.explode(each)).withColumn("page", F.floor((F.col("before") + F.col("i")) / fit))
        dealt = dealt.join(full, "prefix", "left_anti").select(*names, "n_bytes", "prefix", "depth", "page").unionByName(chain.select(*names, "n_bytes", "prefix", "depth", "page"))
    return dealt.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "n_bytes", F.col("prefix").alias("shard"), "depth", "page")


def directory(shards: DataFrame, depth: int) -> DataFrame:
    """entry (so many hash bits), prefix, depth: the directory of the buckets (prefix, depth) that aren't deeper; a bucket of fewer bits has several entries."""
    tails = F.expr(f"explode(sequence(0L, shiftleft(1L, {depth} - depth) - 1))").alias("tail")
    out = shards.where(F.col("depth") <= depth).select("prefix", "depth", tails)
    rest = F.expr(f"lpad(bin(tail), {depth} - depth, '0')")
    return out.select(F.when(F.col("depth") == depth, F.col("prefix")).otherwise(F.concat("prefix", rest)).alias("entry"), "prefix", "depth")


def _buckets(rows: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(prefix, depth) of all buckets, and prefix of those whose rows no bit tells apart and that don't fit."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, AHEAD + max(0, math.ceil(math.log2(max(1, total / max_bytes)))))

    leaves, chained, low, split = [], [], 0, None
    while True:
        part = rows if split is None else rows.join(split, F.substring("bits", 1, low) == split.prefix, "left_semi")
        cells = part.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.min(F.conv("bits", 2, 10).cast("bigint")).alias("least"), F.max(F.conv("bits", 2, 10).cast("bigint")).alias("most")
        )
        nodes = (
            cells.select("cell", "n_bytes", "least", "most", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth"))
            .withColumn("prefix", F.expr("left(cell, depth)"))
            .groupBy("depth", "prefix")
            .agg(F.sum("n_bytes").alias("n_bytes"), F.min("least").alias("least"), F.max("most").alias("most"))
        )
        over = nodes.where(F.col("n_bytes") > max_bytes)
        inner = over.where("least < most").select("depth", "prefix")
        # a bucket is a child of an inner node, or the root, that is no inner node itself
        children = inner.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.concat("prefix", F.lit("0")), F.concat("prefix", F.lit("1")))).alias("prefix"))
        root = spark.range(1).select(F.lit(0).alias("depth"), F.lit("").alias("prefix")) if low == 0 else None
        found = (children if root is None else children.unionByName(root)).where(F.col("depth") <= depth).join(inner, ["depth", "prefix"], "left_anti")
        leaves.append(found)
        chained.append(over.where("least = most").join(found, ["depth", "prefix"], "left_semi").select("prefix"))
        again = inner.where((F.col("depth") == depth) & (F.col("depth") < BITS))
        if depth >= BITS or not again.head(1):
            break
        split, low, depth = again.select("prefix"), depth, min(BITS, depth + 12)

    shards, full = reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, chained)
    return stash(shards, "shards"), stash(full, "full")


#: Bytes of text in a shard.  Small enough that the smallest test table needs several.
SHARD_BYTES = 1 << 20


def op3_sharding(spark, sf_dir):
    return extendible_shards(documents(spark, sf_dir), SHARD_BYTES, keep=["doc_id"])


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT), {BITS}, '0') AS bits
  FROM documents),
node AS (
  SELECT depth, substr(bits, 1, depth) AS prefix, sum(n_bytes) AS n_bytes, min(bits) AS least, max(bits) AS most
  FROM d, (SELECT unnest(range(0, {BITS}))::INT AS depth) GROUP BY ALL),
inner_node AS (SELECT depth, prefix FROM node WHERE n_bytes > {SHARD_BYTES} AND least < most),
leaf AS (
  SELECT bits, any_value(d.n_bytes) AS n_bytes, coalesce(max(i.depth) + 1, 0) AS depth
  FROM (SELECT DISTINCT bits, n_bytes FROM d) d LEFT JOIN inner_node i ON substr(d.bits, 1, i.depth) = i.prefix GROUP BY bits),
bucket AS (SELECT substr(d.bits, 1, l.depth) AS shard, sum(d.n_bytes) AS total FROM d JOIN leaf l ON d.bits = l.bits GROUP BY 1)
SELECT doc_id, CAST(d.n_bytes AS BIGINT) AS n_bytes, shard, CAST(l.depth AS INT) AS depth,
  CAST(CASE WHEN total > {SHARD_BYTES} THEN floor((row_number() OVER (PARTITION BY d.bits) - 1) / greatest(1, floor({SHARD_BYTES} / greatest(d.n_bytes, 1)))) ELSE 0 END AS BIGINT) AS page
FROM d JOIN leaf l ON d.bits = l.bits JOIN bucket b ON substr(d.bits, 1, l.depth) = b.shard
"""
