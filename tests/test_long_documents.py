"""Documents as tables of lines against the row-wise form."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import chunking, long_documents

COLUMNS = ["source_path", "kind", "block_no", "last_block", "nome_software", "chunk_ordem", "titulo", "hierarquia", "content", "nome_arquivo"]


def rows_of(found):
    """Rows as text; only chunks have a title and a hierarchy of their own."""
    chunk = F.col("kind") == "chunk"
    plain = found.select(*[F.when(chunk, F.col(c)).alias(c) if c in ("titulo", "hierarquia") else c for c in COLUMNS])
    return sorted(map(str, plain.collect()))


def text(rng, headers):
    out = []
    for _ in range(rng.randrange(0, 40)):
        x = rng.random()
        if headers and x < 0.3:
            out.append("#" * rng.choice((1, 2, 2, 3, 3, 4)) + f" Head {rng.randrange(9)}")
        elif headers and x < 0.4:
            out.append(".".join(str(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4))) + ". Number")
        elif x < 0.55:
            out.append(rng.choice(("", "  ")))
        elif x < 0.65:
            out.append(rng.choice(("```", "# in a fence?", "| a | b |", "Short title")))
        else:
            out.append("  " * rng.randrange(2) + " ".join(rng.choices(("words", "of", "text."), k=rng.randrange(1, 9))))
    return "\n".join(out)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(f"a/doc{i}.md", text(rng, i % 5 > 0)) for i in range(70)]
    rows += [("x/empty.md", ""), ("x/title.md", "Only a title\n"), ("x/deep.md", "#### d\nb\n##### e\nc"), ("x/one.md", "# One\nx\n# Two\n\n# Three\ny\n")]
    rows += [("x/late.md", "Title line\n\nbody.\n## A\none\n# B\ntwo\n## C\nthree\n## D\n"), ("x/before.md", "some long body text that ends with a dot.\n## A\none")]
    return spark.createDataFrame(rows, "source_path string, text string").cache()


@pytest.mark.parametrize("segment,keep", [(1, True), (3, True), (4096, True), (2, False), (4096, False)])
def test_regions_equal_the_row_wise_form(docs, segment, keep):
    want = rows_of(chunking.regions(docs.where("text <> ''"), keep))  # without lines there is no document
    assert rows_of(long_documents.regions(chunking.lines(docs), keep, segment)) == want


def test_records_of_one_document_of_all_texts(spark, docs):
    one = docs.agg(F.array_join(F.transform(F.array_sort(F.collect_list("text")), lambda t: t), "\n").alias("text")).select(F.lit("all.md").alias("source_path"), "text")
    config, stamp = chunking.ChunkConfig(200, 1), F.lit("2026-01-01 00:00:00").cast("timestamp")
    got = long_documents.topic_records(chunking.lines(one), config, stamp, True, 50).drop("arquivo_hash")
    want = chunking.topic_records(one, config, stamp, True).drop("arquivo_hash")
    assert want.count() > 200 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_window_holds_a_document(docs):
    plan = long_documents._carried(
        chunking.lines(docs).withColumn("_segment", F.floor(F.col("line_no") / 5)), ["line_no"], lasts={"x": F.col("line")}
    )._jdf.queryExecution().executedPlan().toString()
    windows = [w for w in plan.split("\n") if "Window [" in w]
    assert windows and all("_segment" in w for w in windows)


def test_parameters_and_empty(spark, docs):
    with pytest.raises(ValueError):
        long_documents.regions(chunking.lines(docs), segment_lines=0)
    assert long_documents.regions(chunking.lines(docs.limit(0))).count() == 0
