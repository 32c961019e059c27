import pytest
from pyspark.sql import functions as F

from docspark import schemas
from docspark.operators import chunking, kb
from docspark.plans import flows
from docspark.sources import store, tables
from docspark.streaming import ingest

STAMP = "2026-01-01 00:00:00"


def build(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "source_path string, text string")
    return chunking.topic_records(
        docs, chunking.ChunkConfig(), F.lit(STAMP).cast("timestamp"), empty_blocks=True
    )


def test_only_the_last_block_of_a_file_survives(spark):
    records = build(spark, {"a.md": "# One\nx\n# Two\ny\n", "b.md": "# Solo\nz\n"})
    documents, chunks = flows.knowledge_base(records, keep="last")
    assert {r["nome_software"] for r in documents.collect()} == {"Two", "Solo"}
    assert {r["titulo"] for r in chunks.collect()} == {"Two", "Solo"}
    everything, chunks = flows.knowledge_base(records)
    assert everything.count() == 3
    rows = kb.kb_rows(everything, chunks).collect()
    assert {r["id"] for r in rows} == {"a.md|1|1", "a.md|block_2|1|1", "b.md|1|1"}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, kb.rows_of_records(records).collect()))
    with pytest.raises(ValueError):
        kb.surviving_blocks(records, "first")


def test_replacing_by_key(spark):
    documents, chunks = flows.knowledge_base(build(spark, {"a.md": "# A\nold\n## S\nt\n", "b.md": "# B\nz\n"}))
    documents, chunks = kb.replace_by_key(documents, chunks, build(spark, {"a.md": "# New\nfresh\n", "c.md": "Title only\n"}))
    assert {r["source_path"]: r["nome_software"] for r in documents.collect()} == {"a.md": "New", "b.md": "B", "c.md": "Title only"}
    assert sorted(r["conteudo_texto"] for r in chunks.collect()) == ["# B\nz", "# New\nfresh"]


def test_latest_wins_with_a_hot_key(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS k", "id AS v")
    kept = kb.latest_wins(df, ["k"], [F.col("v")])
    assert kept.count() == 2001 and kept.where("k = 'hot'").first()["v"] == 2997
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_purge_by_path_or_file_name(spark):
    documents = spark.createDataFrame([("d/a.md", "a.md"), ("d/b.md", "b.md"), ("d/c.md", "c.md")], "source_path string, nome_arquivo string")
    chunks = documents.select("source_path")
    names = spark.createDataFrame([("d/a.md",), ("b.md",)], "name string")
    left, rest = kb.purge(documents, chunks, names)
    assert [r["source_path"] for r in left.collect()] == ["d/c.md"] == [r["source_path"] for r in rest.collect()]


def test_term_search_folds_ascii_only_and_keeps_wildcards(many):
    texts = ["abc TOPIC 1", "tópico", "TÓPICO", "t_pic"]
    assert many(lambda c: kb.contains_term(c, "tOpIc"), texts) == [True, False, False, False]
    assert many(lambda c: kb.contains_term(c, "t_pic"), texts) == [True, True, True, True]
    assert many(lambda c: kb.contains_term(c, "a\\b"), ["xa\\by", "ab"]) == [True, False]


def test_snippets(many):
    assert many(lambda c: F.length(kb.snippet(c)), ["x" * 800, "x" * 801]) == [800, 803]


def test_upsert_and_prune(spark):
    index = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    rows = spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int")
    assert sorted(map(tuple, kb.upsert(index, rows).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, kb.upsert(index, rows, prune=True).collect())) == [("b", 2), ("c", 2)]


def test_health(spark):
    ok = kb.index_health(spark, spark.range(3), {"model": "m"}).first()
    assert (ok["status"], ok["chunks_indexed"], ok["model"]) == ("ok", 3, "m")
    bad = kb.index_health(spark, None, {"model": "m"}, "missing").first()
    assert (bad["status"], bad["chunks_indexed"], bad["error"]) == ("degraded", None, "missing")


def test_listing_marks_missing_audit_fields(spark):
    row = kb.document_list(spark.createDataFrame([("s", "f", "p", "", None)], "nome_software string, nome_arquivo string, source_path string, arquivo_hash string, ingestao_em string")).first()
    assert row["arquivo_hash"] == row["ingestao_em"] == "[não informado]"


def test_stored_base_replaces_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "kb")
    documents, chunks = flows.knowledge_base(build(spark, {f"d{i}.md": f"# D{i}\ntext {i}\n" for i in range(20)}))
    tables.write_kb(documents, chunks, path, buckets=8)
    # the base keeps its own number of buckets
    ingest.replace_documents(build(spark, {"d3.md": "# New\nfresh\n", "x.md": "# X\ny\n"}), path, buckets=16)
    documents, chunks = tables.read_kb(spark, path)
    names = {r["source_path"]: r["nome_software"] for r in documents.collect()}
    assert len(names) == 21 and names["d3.md"] == "New" and names["d4.md"] == "D4"
    assert chunks.count() == 21 and chunks.where("source_path = 'd3.md'").first()["conteudo_texto"] == "# New\nfresh"


def test_stream_of_documents(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "kb")
    schema = "source_path string, text string"
    spark.createDataFrame([("a.md", "# A\none\n"), ("b.md", "# B\ntwo\n")], schema).write.parquet(str(source / "p1"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        ingest.ingest_stream(stream, path, str(tmp_path / "ck"), chunking.ChunkConfig(), buckets=4).awaitTermination()

    run()
    spark.createDataFrame([("a.md", "# A2\nthree\n")], schema).write.parquet(str(source / "p2"))
    run()
    documents, chunks = tables.read_kb(spark, path)
    assert sorted(r["nome_software"] for r in documents.collect()) == ["A2", "B"]
    assert chunks.count() == 2


def test_a_document_without_chunks_loses_the_old_ones(spark, tmp_path):
    path = str(tmp_path / "kb")
    ingest.replace_documents(build(spark, {"a.md": "# A\nold body\n", "b.md": "# B\nkept\n"}), path, buckets=4)
    ingest.replace_documents(build(spark, {"a.md": "Bare title\n"}), path)
    documents, chunks = tables.read_kb(spark, path)
    assert {r["source_path"]: r["nome_software"] for r in documents.collect()} == {"a.md": "Bare title", "b.md": "B"}
    assert [r["source_path"] for r in chunks.collect()] == ["b.md"]


def test_other_parts_are_not_written(spark, tmp_path):
    path = str(tmp_path / "kb")
    ingest.replace_documents(build(spark, {f"d{i}.md": f"# D{i}\none\n" for i in range(12)}), path, buckets=32)

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "kb" / "rows").rglob("*.parquet")}

    before = files()
    ingest.replace_documents(build(spark, {"d3.md": "# New\ntwo\n"}), path)
    after = files()
    assert {f.parent.parent.name for f in before.keys() ^ after.keys()} == {f.parent.parent.name for f in after.keys() - before.keys()}
    assert len({f.parent.parent.name for f in after.keys() - before.keys()}) == 1  # one part of four
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_stored_rows_join_without_exchange(spark, tmp_path):
    path = str(tmp_path / "kb")
    ingest.replace_documents(build(spark, {f"d{i}.md": f"# D{i}\n## A\none\n## B\ntwo\n" for i in range(12)}), path, buckets=4)
    documents, chunks = tables.read_kb(spark, path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = kb.kb_rows(documents, chunks)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 24
        # the upsert's anti-join: only the incoming keys move
        gone = documents.select("source_path").limit(3).repartition(4, "source_path")
        plan = chunks.join(gone, "source_path", "left_anti")._jdf.queryExecution().executedPlan().toString()
        stored_side = plan[plan.index("LeftAnti") : plan.index("REPARTITION_BY_NUM")]
        assert "Bucketed: true" in stored_side and stored_side.count("Exchange") == 1  # that of the keys
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_key_and_null_keys(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, v int"
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(str(i), i) for i in range(50)] + [(None, 1)], schema)
    store.replace(path, {"t": (rows, schema)}, rows, "k", 4)
    assert store.read(spark, path, "t", schema, "k").count() == 551
    gone = spark.createDataFrame([("hot",), ("7",)], "k string")
    store.replace(path, {"t": (rows.limit(0), schema)}, gone, "k")
    left = store.read(spark, path, "t", schema, "k")
    assert left.count() == 50 and left.where("k = 'hot' or k = '7'").isEmpty() and left.where("k is null").count() == 1


def test_stored_columns_survive_a_file_without_them(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    store.replace(path, {"t": (old, "k string, v int")}, old, "k", 4)
    new = spark.createDataFrame([("b", 2, "x")], "k string, v int, w string")
    store.replace(path, {"t": (new, "k string, v int, w string")}, new, "k")
    rows = store.read(spark, path, "t", "k string, v int, w string", "k").collect()
    assert sorted(map(tuple, rows)) == [("a", 1, None), ("b", 2, "x")]


def test_order_decides_between_rows_of_one_batch(spark):
    index = spark.createDataFrame([("a", 1, 0)], "id string, v int, t int")
    rows = spark.createDataFrame([("a", 5, 1), ("a", 4, 2), ("b", 9, 1)], "id string, v int, t int")
    assert sorted(map(tuple, kb.upsert(index, rows, order="t").collect())) == [("a", 4, 2), ("b", 9, 1)]
    assert len(kb.upsert(index, rows).collect()) == 2


def test_older_tables_gain_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a.md", "A")], "source_path string, nome_software string").write.parquet(path)
    row = tables.read_table(spark, path, schemas.DOCUMENTS).first()
    assert row["nome_software"] == "A" and row["arquivo_hash"] is None
