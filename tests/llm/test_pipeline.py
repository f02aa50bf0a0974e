from collections import Counter

from . import cases


def test_stages_on_awkward_rows(spark, tmp_path):
    """Each stage's decision on its own input: nulls, repeated rows and copies among it."""
    import corpus_pipeline as P

    data = cases.rows(40)
    docs = cases.table(spark, data)
    good = P.quality_rules(spark, docs, "")
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert not kept & {40, 41, 42, 45, 46} and len(kept) > 30
    lines = P.line_dedup(spark, docs, "")
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())
    near = P.near_dedup(spark, docs, "")
    assert near.columns == docs.columns
    from verdigris.llm.simhash import near_components

    groups = {(r.component_id, r.fingerprint if r.component_id is None else "") for r in near_components(docs).collect()}
    ids = Counter(r.doc_id for r in near.collect())
    assert sum(ids.values()) == len(groups) and {g[0] for g in groups} <= set(ids) and max(ids.values()) == 1
    pieces = P.packing(spark, near, "").collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_mixing_stage(spark, tmp_path):
    """Every document comes as often as its copies say, with its own columns, whatever further ones are called."""
    import corpus_pipeline as P
    from verdigris.llm.mixing import rates

    data = cases.rows(40)
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = cases.clashing(cases.table(spark, data))
    got = P.mixing(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = Counter()
    for r in rates(docs, labels).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in got.collect()) == +want and len(+want) > 5
    assert P.mixing(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_run_reads_every_document(spark):
    import corpus_pipeline as P

    got = P.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(got.columns) and got.count() > 0
