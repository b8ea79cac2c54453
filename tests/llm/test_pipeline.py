"""The pipeline's stages against what each must do to its own input."""

import collections

import duckdb

from quarry.llm import decontamination, mixing, sharding
from quarry.llm.spark import documents
from tests.llm.conftest import as_table, odd_rows
from tests.llm.test_jaccard import brute
from tests.llm.test_native import mix_check
from tests.test_queries import canonical


def test_stages(spark, sf):
    import corpus_pipeline

    docs = documents(spark, sf)
    columns = docs.columns
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).persist()
        kept.append(docs)
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    clean, single, unleaked, mixed, shards = kept
    rows = [tuple(r) for r in clean.select("doc_id", "text").collect()]
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted({c for _, _, c in brute(rows)})
    leaked = {r.doc_id for r in decontamination.contaminated(single, documents(spark, sf, "benchmark")).collect()}
    assert {r[0] for r in unleaked.select("doc_id").collect()} == {r[0] for r in single.select("doc_id").collect()} - leaked and leaked
    mix_check(unleaked)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(unleaked).collect()}
    assert collections.Counter(r[0] for r in mixed.select("doc_id").collect()) == collections.Counter({k: v for k, v in copies.items() if v})
    size = collections.Counter()
    for r in shards.collect():
        size[r.shard, r.page] += r.n_bytes
    assert max(size.values()) <= sharding.SHARD_BYTES and shards.count() == mixed.count()


def test_run_gives_the_last_stage(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "shard", "n_bytes"} <= set(out.columns) and out.count() > 0


def test_filters_keep_odd_rows(spark, odd, none):
    from quarry.llm import deduplication

    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.without_contaminated(odd, empty).count() == len(odd_rows())
    assert mixing.mixture(deduplication.one_of_each(none)).count() == 0
    assert as_table(spark, []).count() == 0


def test_stages_on_odd_and_empty_tables(spark, sf, odd, none):
    import corpus_pipeline

    for docs, n in ((none, 0), (odd, len(odd_rows()))):
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf).persist()
            assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
            if n and i == 0:
                assert docs.count() == n  # nothing in them is toxic
            if n and i == 1:
                texts = [r.text for r in docs.collect()]
                assert texts.count(None) == 2 and texts.count("") == 2 and len(texts) == len(set(map(str, texts))) + 2
        assert (docs.count() > 0) == (n > 0)
        assert {"doc_id", "shard", "n_bytes", "page"} <= set(docs.columns)


def test_sql_agrees(spark, sf):
    from quarry.llm import registry

    c = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf)
        got = c.sql(sql)
        assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), got.columns)
