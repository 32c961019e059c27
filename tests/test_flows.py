import hashlib

import pytest
from pyspark.sql import functions as F

from docspark.operators import chunking, vectors
from docspark.plans import flows
from docspark.session import stage
from docspark.sources import files, tables


def hashed_words(dim):
    """Encoder for tests: word counts by hash."""

    def make():
        def encode(texts):
            out = []
            for t in texts:
                v = [0.0] * dim
                for w in t.lower().split():
                    v[int(hashlib.md5(w.encode()).hexdigest(), 16) % dim] += 1.0
                out.append(v)
            return out

        return encode

    return make


ENCODER = flows.Encoder(hashed_words(64), 64, "hashed-words")


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "docs"
    (root / "A" / "deep").mkdir(parents=True)
    (root / "A" / "walls.HTM").write_text("<h1>Walls</h1><h2>Draw a wall</h2><p>Pick the wall tool and drag.</p>", encoding="utf-8")
    (root / "A" / "deep" / "doors.html").write_bytes("<h1>Doors</h1><h2>Place a door</h2><p>Drop the door é here.</p>".encode() + b"\xff\xfe")
    (root / "empty.txt").write_text("")
    (root / "skip.pdf").write_text("x")
    return root


def test_discovery_and_decoding(spark, tree):
    rows = {r["source_path"]: r["raw"] for r in files.read_raw(spark, str(tree)).collect()}
    assert sorted(p.rsplit("/", 1)[1] for p in rows) == ["doors.html", "walls.HTM"]
    (doors,) = [t for p, t in rows.items() if p.endswith("doors.html")]
    assert doors.endswith("é here.</p>")


def test_one_file(spark, tree):
    assert files.read_raw(spark, str(tree / "A" / "walls.HTM")).count() == 1
    assert files.read_raw(spark, str(tree / "skip.pdf")).count() == 0


def test_markdown_files(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.MD").write_text("# A\n")
    (tmp_path / "k" / "b.txt").write_text("no")
    (row,) = files.read_markdown(spark, str(tmp_path / "k")).collect()
    assert row["text"] == "# A\n" and row["source_path"].endswith("/k/a.MD")


def test_from_pages_to_answers(spark, tree, tmp_path):
    out = {name: str(tmp_path / name) for name in ("md", "kb", "index")}
    timings = flows.run_pipeline(
        spark, str(tree), out["md"], out["kb"], out["index"], ENCODER, F.lit("2026-01-01 00:00:00").cast("timestamp"), chunking.ChunkConfig()
    )
    assert list(timings.seconds) == ["convert", "ingest", "encode"]
    index = flows.read_index(spark, out["index"], ENCODER)
    assert index.count() == 2 and {len(r["embedding"]) for r in index.collect()} == {64}
    assert {r["source_path"] for r in index.select("metadata.source_path").collect()} == {"A/walls.md", "A/deep/doors.md"}
    questions = spark.createDataFrame([(1, "Place a door"), (2, "wall tool")], "query_id int, question string")
    hits, contexts = flows.search(questions, index, ENCODER, 1)
    assert {r["query_id"]: r["software"] for r in hits.collect()} == {1: "Doors", 2: "Walls"}
    assert all("[Trecho 1]" in r["context"] for r in contexts.collect())


def test_a_second_run_keeps_what_the_first_one_stored(spark, tree, tmp_path):
    out = [str(tmp_path / name) for name in ("md", "kb", "index")]
    stamp = F.lit("2026-01-01 00:00:00").cast("timestamp")
    flows.run_pipeline(spark, str(tree), *out, ENCODER, stamp, chunking.ChunkConfig())
    # another folder of the same tree: one file changed, one new, the rest not there
    again = tmp_path / "again" / "A"
    again.mkdir(parents=True)
    (again / "walls.HTM").write_text("<h1>Walls</h1><h2>Draw two walls</h2><p>Drag twice.</p><h2>More</h2><p>x</p>")
    (again / "roof.html").write_text("<h1>Roof</h1><h2>Pitch</h2><p>Set the angle.</p>")
    flows.run_pipeline(spark, str(tmp_path / "again"), *out, ENCODER, stamp, chunking.ChunkConfig())
    documents, chunks = tables.read_kb(spark, out[1])
    assert {r["source_path"] for r in documents.collect()} == {"A/walls.md", "A/deep/doors.md", "A/roof.md"}
    titles = sorted(r["titulo"] for r in chunks.collect())
    assert titles == ["Draw two walls", "More", "Pitch", "Place a door"]
    index = flows.read_index(spark, out[2], ENCODER)
    assert sorted(r["titulo"] for r in index.select("metadata.titulo").collect()) == titles


def test_questions_are_encoded_once(spark, tree, tmp_path):
    counter = spark.sparkContext.accumulator(0)

    def make():
        def encode(texts):
            counter.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    encoder = flows.Encoder(make, 2, "lengths")
    rows = [(str(i), "x" * i, ("s", "h", "t", "p")) for i in range(30)]
    index = spark.createDataFrame(rows, "id string, document string, metadata struct<software:string,hierarquia:string,titulo:string,source_path:string>")
    index = stage(vectors.embed(index, "document", encoder.make, 2))
    before = counter.value
    hits, contexts = flows.search(spark.createDataFrame([(i, "y" * i) for i in range(12)], "query_id int, question string"), index, encoder, 2)
    assert hits.count() == 24 and contexts.count() == 12 and counter.value - before == 12


def test_spread_only_where_splits_are_few(spark):
    cores = spark.sparkContext.defaultParallelism
    assert files.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores * 3
    many = spark.range(100, numPartitions=cores * 4)
    assert files.spread(many) is many


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 80


def test_texts_become_a_file_for_each_key(spark, tmp_path):
    rows = [(1, "a\nb"), (2, None), (3, "é"), (3, "é"), (None, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    files.write_texts(df, f"file://{tmp_path}/own", "page_id", "html")
    df.repartition("page_id").select("html", "page_id").write.partitionBy("page_id").text(str(tmp_path / "spark"))

    def tree(root):
        return {p.parent.name: p.read_text() for p in root.rglob("*.txt")}

    assert tree(tmp_path / "own") == tree(tmp_path / "spark")
    assert len(tree(tmp_path / "own")) == 4
    # one file a key and nothing beside it: no checksums, marks of success or half files
    assert sorted(p.name for p in (tmp_path / "own").rglob("*") if p.is_file()) == ["part-0.txt"] * 4
    files.write_texts(df, f"file://{tmp_path}/own", "page_id", "html")  # a task that runs again
    assert tree(tmp_path / "own") == tree(tmp_path / "spark")
