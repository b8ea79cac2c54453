"""One document of each group of near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.jaccard_join import set_components
from quarry.llm.spark import stash

#: Keys of dropped documents up to which they are broadcast (16 bytes each); beyond, a shuffle join.
BROADCAST = 200_000


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that link with a kept one.

    Of each component of the Jaccard join the document with the least doc_id
    (null last, then by a hash of the text) stays, once even if its row repeats;
    of rows that agree in doc_id and text but not in other columns any one stays.
    Documents without words (null and empty texts) link with nothing and all
    stay.  Very long texts are compared whole.  An empty table gives no rows.
    """
    columns = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    found = stash(set_components(docs).where("n > 0"), "components")
    head = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    heads = found.groupBy("component").agg(F.min(head).alias("h")).select("component", "h.d", "h.k")
    rows = found.groupBy("doc_id", "text_key", "component").agg(F.count("*").alias("n"))
    marked = stash(rows.join(heads, "component").withColumn("head", F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))), "marked")
    gone = marked.where("not head").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    out = docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("gone_key")), "left_anti")
    if marked.where("head and n > 1").head(1):
        words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        once = out.where(words).withColumn("_quarry_key", F.xxhash64(text)).dropDuplicates(["doc_id", "_quarry_key"]).select(*columns)
        out = once.unionByName(out.where(~words))
    return out
