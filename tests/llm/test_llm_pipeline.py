import duckdb

import corpus_pipeline
from lagwise.llm import queries, raking
from llm_data import empty_documents, odd_documents


def test_run_is_its_stages_by_sql(spark, folder):
    """Quality by the query's own scores; copies, leaks and mixing by SQL on what the stage before kept."""
    result = corpus_pipeline.run(spark, folder).toPandas()
    scores = queries.QUERIES["op6_quality"](spark, folder).toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{folder}/benchmark.parquet'")
    docs = db.execute(f"SELECT * FROM '{folder}/documents.parquet'").df()
    documents = docs[docs.doc_id.isin(scores[scores.score >= 0.5].doc_id)]
    for name, test in (("op3_near_dedup", "kept"), ("op7_decontaminate", "NOT contaminated")):
        db.register("documents", documents)
        stay = db.execute(f"SELECT doc_id FROM ({queries.ORACLE[name]}) WHERE {test}").df()
        documents = documents[documents.doc_id.isin(stay.doc_id)]
        db.unregister("documents")
    db.register("documents", documents)
    stay = db.execute(f"SELECT doc_id FROM ({raking.sql()}) WHERE kept").df()
    assert sorted(result.doc_id) == sorted(stay.doc_id)
    sizes = result.assign(size=result.text.str.encode("utf-8").str.len() + 1)
    by_shard = sizes.groupby("shard")["size"].sum()
    assert by_shard.max() - by_shard.min() <= 2 * sizes["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in result.groupby("shard").slot)


def test_stages_keep_columns_and_take_odd_rows(spark, folder):
    for docs in (odd_documents(spark, False), empty_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != "shard":
                assert out.columns == docs.columns
            assert out.count() <= docs.count()
