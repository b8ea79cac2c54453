"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.spark import documents, release, stash

#: A source gives at most so many times its words, a document so many copies.
MOST = 3
#: The cut is looked for in rounds, by so many bits of a rank's place in each; then the rows of its cell, about CELL at most, are ordered.
DIGIT = 12
ROUNDS = 4
CELL = 10_000
#: Sources up to which facts of them are broadcast, and groups of rows that no rule covers (some 100 bytes each).
BROADCAST = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def _uniform() -> F.Column:
    """In (0, 1), from a hash of doc_id and text: reruns agree."""
    key = F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with ``target``: sources by code point, null last, weigh 1, 2, 3 repeating.

    All words are shared by weight; what passes MOST times a source's size is
    shared again among the others until no target is above.  One small job a
    round, each over one row a source and returning two numbers.
    """
    ranked = sources.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, F.lit(False)
    while total:
        words, weight = ranked.agg(F.sum(F.when(capped, MOST * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not weight or (nxt := (total - words) / weight) == share:
            break
        share = nxt
        capped = F.lit(share) * F.col("weight") > MOST * F.col("source_size")
    return ranked.withColumn("target", F.least(F.lit(share) * F.col("weight"), MOST * F.col("source_size").cast("double")))


def _odds_scale(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, scale) of each source: with inclusion odds of scale times the root of the size, the expected words are the wanted ones.

    Sizes are first counted in classes (four to each doubling), so a source is
    an array of some hundred numbers, in which the scale is found by halving.
    """
    of = F.floor(F.log2(F.col("size")) * 4)
    classes = groups.where("size > 0").groupBy(F.col("source").alias("s"), of.alias("class")).agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("words"), F.sum("n").alias("n"))
    arrays = classes.groupBy("s").agg(F.collect_list(F.struct("words", F.sqrt(F.col("words") / F.col("n")).alias("root"))).alias("classes"))
    known = arrays.join(wanted.select(F.col("s").alias("w"), "wanted"), F.col("s").eqNullSafe(F.col("w")))

    def halve(bounds, _):
        middle = (bounds["lo"] + bounds["hi"]) / 2
        expected = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["words"] * (1 - 1 / (1 + F.exp(middle) * c["root"])))
        return F.struct(F.when(expected < F.col("wanted"), middle).otherwise(bounds["lo"]).alias("lo"), F.when(expected < F.col("wanted"), bounds["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-80.0).alias("lo"), F.lit(80.0).alias("hi")), halve, lambda b: F.exp(b["lo"]))
    return known.select("s", found.alias("scale"))


@dataclass
class Mix:
    """What a mix takes, as far as it isn't said by a rule.

    facts: one row a source: s, source_size, target, whole (certain copies),
    scale (of the inclusion odds), cell (where the sample ends).  Groups of equal
    rows whose place, without its last bits, is below the cell give one more copy of each row,
    those above none.  exceptions: d, t, k (doc_id, source, text_key), n (rows), more (copies more of all of
    them): the groups in the cell, and the last document of each source.
    """

    facts: DataFrame
    exceptions: DataFrame
    bits: int
    few: bool

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (of _ranked()) with their source's facts and, where they are exceptions, e_n and e_more."""
        known = rows.join(F.broadcast(self.facts) if self.few else self.facts, F.col("source").eqNullSafe(F.col("s")))
        same = F.col("source").eqNullSafe(F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
        odd = self.exceptions.withColumnsRenamed({"n": "e_n", "more": "e_more"})
        small = odd.count() <= BROADCAST
        return known.join(F.broadcast(odd) if small else odd, same, "left").withColumn("below", F.shiftright("place", self.bits) < F.col("cell"))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with their rank in the sample of their source, and its place: an integer that grows with it."""
    # within a source the inclusion odds are a constant times the root of the size, so this orders as the Pareto rank does
    ranked = rows.withColumn("rank", F.col("u") / (1 - F.col("u")) / F.sqrt(F.greatest(F.col("size"), F.lit(1))))
    last = F.lit((1 << DIGIT * ROUNDS) - 1)
    return ranked.withColumn("place", F.least(F.floor(F.col("rank") * 20 / (1 + F.col("rank") * 20) * float(1 << DIGIT * ROUNDS)), last))


def _described(docs: DataFrame, *columns: str) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint")
    return docs.select("doc_id", "source", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), size.alias("size"), _uniform().alias("u"), *columns)


def _mix(groups: DataFrame) -> Mix:
    """The mix of groups of equal rows (doc_id, source, text_key, size, u, n)."""
    found = stash(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")), "sources")
    few = found.count() <= BROADCAST

    def facts_of(df: DataFrame) -> DataFrame:
        """One row a source: broadcast while these are few, else a join whose large partitions adaptive execution splits."""
        return F.broadcast(df) if few else df

    sources = source_targets(found)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.least(F.floor(rate), F.lit(MOST))).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = stash(sources.select(F.col("source").alias("s"), "source_size", "target", "whole", "wanted"), "facts")
    release(found)
    scale = _odds_scale(groups, sources).withColumnRenamed("s", "t")
    facts = stash(sources.join(facts_of(scale), F.col("s").eqNullSafe(F.col("t")), "left").drop("t").withColumn("cell", F.lit(0).cast("bigint")).withColumn("before", F.lit(0).cast("bigint")), "facts")
    release(sources)

    ranked, same = _ranked(groups), F.col("source").eqNullSafe(F.col("s"))
    for step in range(1, ROUNDS + 1):
        bits = DIGIT * (ROUNDS - step)
        inside = ranked.join(facts_of(facts), same).where(F.shiftright("place", bits + DIGIT) == F.col("cell"))
        steps = inside.groupBy("s", F.shiftright("place", bits).alias("bucket")).agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("rows"))
        steps = steps.join(facts_of(facts.select(F.col("s").alias("t"), "wanted", "before")), F.col("s").eqNullSafe(F.col("t")))
        by = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        steps = steps.withColumn("until", F.col("before") + F.sum("words").over(by))
        cut = steps.where(F.col("until") > F.col("wanted")).groupBy("s").agg(F.min(F.struct("bucket", (F.col("until") - F.col("words")).alias("before"), "rows")).alias("at"))
        # a source whose words all fit has no cut: its cell lies above all places
        cut = cut.select(F.col("s").alias("t"), F.col("at.bucket").alias("next"), F.col("at.before").alias("passed"), "at.rows")
        cut = facts.join(facts_of(cut), F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
        cut = cut.withColumn("cell", F.coalesce("next", F.lit(1 << DIGIT * step + 1))).withColumn("before", F.coalesce("passed", "before")).drop("next", "passed")
        cut = stash(cut, "cut")
        release(facts)
        facts = cut.drop("rows")
        facts._quarry_path = cut._quarry_path
        most, every = cut.agg(F.max("rows"), F.sum("rows")).first()
        if (most or 0) <= CELL and (every or 0) <= BROADCAST:
            break
    known = ranked.join(facts_of(facts), same).withColumn("place", F.shiftright("place", bits))
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    edge = known.where(F.col("place") == F.col("cell")).withColumn("left", F.col("wanted") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    # at the cut a part of a group of equal rows may fit; after the first row that doesn't, nothing is taken
    fit = F.when(F.col("left") < 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.col("left") / F.col("size"))))
    edge = edge.withColumn("more", fit.cast("bigint")).withColumn("passed", F.max(F.when(F.col("more") < F.col("n"), 1).otherwise(0)).over(inside))
    edge = edge.withColumn("more", F.when(F.coalesce(F.col("passed"), F.lit(0)) == 1, 0).otherwise(F.col("more")).cast("bigint"))
    edge = stash(edge.select("s", "wanted", "before", "doc_id", "text_key", "size", "rank", "n", "more"), "edge")

    # last, the document whose size comes closest to what is left
    gap = edge.groupBy(F.col("s").alias("g")).agg((F.first("wanted") - F.first("before") - F.sum(F.col("more") * F.col("size"))).alias("gap"))
    above = known.where(F.col("place") > F.col("cell")).select("s", "doc_id", "text_key", "size", "rank", "n", F.lit(0).cast("bigint").alias("more"))
    open_ = above.unionByName(edge.where("more < n").select(*above.columns)).where("size > 0").join(facts_of(stash(gap, "gap")), F.col("s").eqNullSafe(F.col("g")))
    away = F.abs(F.col("gap") - F.col("size"))
    last = open_.where(away < F.col("gap")).groupBy("g").agg(F.min(F.struct(away.alias("away"), "rank", "doc_id", "text_key", "n", "more")).alias("pick"))
    last = last.select(F.col("pick.doc_id").alias("d"), F.col("g").alias("t"), F.col("pick.text_key").alias("k"), F.col("pick.n").alias("n"), (F.col("pick.more") + 1).alias("more"))
    every = last.unionByName(edge.select(F.col("doc_id").alias("d"), F.col("s").alias("t"), F.col("text_key").alias("k"), "n", "more"))
    exceptions = stash(every.groupBy("d", "t", "k").agg(F.max("n").alias("n"), F.max("more").alias("more")), "exceptions")
    release(edge)
    return Mix(facts, exceptions, bits, few)


def mix_sources(docs: DataFrame) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, text_key, size, source_size, target, inclusion,
    copies, taken for each row.  A source whose target is r times its size gives
    each document floor(r) certain copies.  The rest is a fixed-size sample in
    words: documents ranked by random odds over inclusion odds (a scale times
    the square root of the size, solved for each source so that the expected
    words are those wanted) give one more copy each while the words fit; last,
    the document whose size comes closest to what is left, if that brings the
    source nearer.  inclusion is the probability of the one copy more by which a
    document was ranked; the scale doesn't change the order within a source.

    Null text has size 0, null source is a source.  Equal rows (doc_id, source,
    text) are counted and dealt as a group, of which a part may be taken; groups
    of equal rank go by doc_id, then text.  A source without words takes nothing.
    Very long texts are documents like others: one that doesn't fit ends the
    sample.  An empty table gives no rows.  Extra columns are ignored, whatever
    their names.
    """
    rows = _described(docs)
    groups = stash(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "mix")
    dealt = _mix(groups).placed(_ranked(groups))
    dealt = dealt.withColumn("more", F.coalesce("e_more", F.when(F.col("below"), F.col("n")).otherwise(0)))
    copies = F.col("whole") + F.when(F.col("i") <= F.col("more"), 1).otherwise(0)
    odds = F.coalesce("scale", F.lit(0.0)) * F.sqrt(F.greatest(F.col("size"), F.lit(1)))
    return dealt.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select(
        "doc_id", "source", "text_key", "size", "source_size", "target", (odds / (1 + odds)).alias("inclusion"), copies.cast("bigint").alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken")
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; those it doesn't take go.

    Whether a row is taken is said by its source's facts and a small table of
    exceptions, so the texts aren't shuffled.  Rows that agree in doc_id, source
    and text but not in other columns each come as often as their group's share;
    where that is no whole number, one of them stands for the group.  Other odd
    rows: as in mix_sources().
    """
    rows = _described(docs)
    groups = stash(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "mix")
    mix = _mix(groups)
    release(groups)
    placed = mix.placed(_ranked(_described(docs, F.struct(*docs.columns).alias("row"))))
    total = F.col("whole") * F.col("e_n") + F.col("e_more")
    even = F.coalesce(total % F.col("e_n") == 0, F.lit(True))
    copies = F.coalesce((total / F.col("e_n")).cast("bigint"), F.col("whole") + F.col("below").cast("bigint"))
    out = placed.where(even).select("row", copies.alias("copies"))
    if mix.exceptions.where("more % n > 0").head(1):  # at most a few groups a source
        one = placed.where(~even).dropDuplicates(["doc_id", "source", "text_key"])
        out = out.unionByName(one.select("row", total.alias("copies")))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).select("row.*")


def op8_mixing(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


# fixed values: as in the functions above
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
g AS (
  SELECT doc_id, source, k, size, count(*) AS n,
    (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d GROUP BY ALL),
s AS (
  SELECT source, sum(size * n)::BIGINT AS source_size, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM g GROUP BY source),
filled AS (
  SELECT *, {MOST} * source_size / weight AS ratio,
    ((SELECT sum(source_size) FROM s) - coalesce(sum({MOST} * source_size) OVER (ORDER BY {MOST} * source_size / weight, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY {MOST} * source_size / weight, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s),
t AS (
  SELECT source, source_size, least((SELECT share FROM filled WHERE share <= ratio ORDER BY ratio, encode(source) LIMIT 1) * weight, ({MOST} * source_size)::DOUBLE) AS target FROM s),
f AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MOST}) ELSE 0 END AS whole, target - CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MOST}) ELSE 0 END * source_size AS wanted FROM t),
r AS (
  SELECT g.*, f.source_size, f.target, f.whole, f.wanted, u / (1 - u) / sqrt(greatest(size, 1)::DOUBLE) AS rank FROM g JOIN f ON g.source IS NOT DISTINCT FROM f.source),
c AS (
  SELECT *, wanted - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM r),
m AS (
  SELECT *, CASE WHEN open < 0 THEN 0 WHEN size = 0 THEN n ELSE least(n, floor(open / size)) END AS fit FROM c),
p AS (
  SELECT *, CASE WHEN coalesce(max(CASE WHEN fit < n THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 0 ELSE fit END AS more FROM m),
gap AS (SELECT source, any_value(wanted) - sum(more * size) AS gap FROM p GROUP BY source),
last AS (
  SELECT p.source, arg_min(struct_pack(d := p.doc_id, k := p.k), struct_pack(a := abs(gap - size), b := rank)) AS pick
  FROM p JOIN gap ON p.source IS NOT DISTINCT FROM gap.source WHERE more < n AND size > 0 AND abs(gap - size) < gap GROUP BY p.source),
e AS (
  SELECT p.*, more + CASE WHEN pick IS NULL THEN 0 ELSE 1 END AS extra
  FROM p LEFT JOIN last ON p.source IS NOT DISTINCT FROM last.source AND p.doc_id IS NOT DISTINCT FROM pick.d AND p.k = pick.k)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((whole + CASE WHEN i <= extra THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM e)
"""
