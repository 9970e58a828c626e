from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

SF = SF_SMALL.replace("sf0.001", "sf0.01")  # enough labels for the toxicity model


def test_stages_take_effect_in_order(spark):
    import corpus_pipeline as p
    from panelmill.llm import decontamination, near_dedup, toxicity
    from panelmill.llm.common import Scratch, table
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "pack"] and p.ORACLE_SQL is None
    docs = table(spark, SF, "documents")
    scratch, seen = Scratch(spark, "t-pipeline"), [docs]
    for name, stage in p.STAGES[:-1]:
        out = scratch.put(stage(spark, seen[-1], SF))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        seen.append(out)
    raw, clean, lines, near, uncontaminated = seen
    rejected = {r.doc_id for r in toxicity.score(raw, toxicity.learn(raw, table(spark, SF, "labels"))).where("rejected").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert rejected and ids(clean) == ids(raw) - rejected and ids(lines) == ids(clean)
    kept = {r.doc_id for r in near_dedup.near_duplicates(lines, 5, 80).where("kept").collect()}
    assert ids(near) == kept
    direct = {r.doc_id for r in near_dedup.near_duplicates(clean, 5, 80).where("kept").collect()}
    assert ids(p.near_once(spark, clean, SF)) == direct and len(direct) < clean.count()
    bad = {r.doc_id for r in decontamination.scan(near, table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert ids(uncontaminated) == ids(near) - bad
    pieces = p.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == ids(uncontaminated)
    assert all(sum(r.length for r in pieces if r.doc_id == d) == next(r.doc_tokens for r in pieces if r.doc_id == d)
               for d in sorted(ids(uncontaminated))[:30])


def test_the_chain_on_empty_null_and_unlabelled_tables(spark, tmp_path):
    import corpus_pipeline as p
    from tests.llm.helpers import edge_docs, empty_docs
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    bench = spark.createDataFrame([(1, "alpha bravo")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = edge_docs(spark).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in
                                                 (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))])
    for name, docs in (("edge", edge_docs(spark).select(*own)), ("empty", empty_docs(spark).select(*own)), ("null", nulls)):
        for table, df in (("documents", docs), ("benchmark", bench), ("labels", labels)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        rows = p.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(rows) > 0) == (name != "empty")
        assert name == "edge" or {r.doc_tokens for r in rows} <= {1}


def test_queries_are_registered():
    import __spark_entry__ as e
    names = [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 14 and {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{i}" for i in range(1, 14)}
