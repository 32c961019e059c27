import hashlib

import pytest
from pyspark.sql import functions as F

from docspark.functions import markdown as md
from docspark.operators import chunking
from docspark.operators.chunking import ChunkConfig

def now():
    return F.lit("2026-07-04 12:00:00").cast("timestamp")


def records(spark, text, path="manual.md", config=ChunkConfig(), **more):
    docs = spark.createDataFrame([(path, text)], "source_path string, text string")
    rows = chunking.topic_records(docs, config, now(), **more)
    return rows.orderBy("block_no", "chunk_ordem", "subchunk_ordem").collect()


def pack(one, lines, limit, overlap):
    return one(lambda: md.pack_lines(F.array(*[F.lit(x) for x in lines]), limit, overlap))


def test_headers(many):
    got = many(md.header, ["## A b", "  # in", "1.2. T", " 1. no", "1.2 no dot", "####### seven", "plain", "#x"])
    assert [tuple(h) if h else None for h in got] == [
        (2, None, "A b"), (1, None, "in"), (2, "1.2", "T"), None, None, None, None, None,
    ]


def test_title_lines(many):
    lines = ["Seed list (spring)", "Ends with dot.", "1234", "x" * 81, "a b c d e f g h i j k l", ""]
    assert many(md.looks_like_title, lines) == [True, False, False, False, False, False]


GARDEN = """7. Orchard
Planted in 1998.

7.1. Apples
Two rows, the old kinds.
    Late ones keep.
7.2. Pears
One by the wall.
Never pruned.

# Tools
A spade lasts longer if it hangs.
## Ladders
Lean, never hook.
"""


def test_numbered_document(spark):
    apples, pears, ladders = records(spark, GARDEN, config=ChunkConfig(keep_text=False))
    assert (apples["nome_software"], apples["titulo"], apples["hierarquia"]) == ("Orchard", "Apples", "7.1 - Apples")
    assert pears["texto"] == "7.2. Pears\nOne by the wall.\nNever pruned." and pears["chunk_ordem"] == 2
    assert pears["conteudo_hash"] == hashlib.sha256(pears["texto"].encode()).hexdigest()
    assert pears["ingestao_em"] == "2026-07-04T12:00:00Z"
    assert (ladders["nome_software"], ladders["titulo"], ladders["last_block"]) == ("Tools", "Ladders", 2)


LOST = """Preface line.
# One
Intro of one.
## A
### A1
text a1
#### deeper
text deeper
## B
Tail of B.
# Two
### T1
text t1
"""


def test_no_line_is_lost_by_default(spark):
    got = records(spark, LOST)
    assert [r["texto"] for r in got] == [
        "Preface line.\n# One\nIntro of one.\n## A\n### A1\ntext a1\n#### deeper\ntext deeper\n## B\nTail of B.",
        "# Two\n### T1\ntext t1",
    ]
    assert [(r["nome_software"], r["titulo"]) for r in got] == [("One", "A1"), ("Two", "T1")]
    bare = records(spark, LOST, config=ChunkConfig(keep_text=False))
    assert [r["texto"] for r in bare] == ["### A1\ntext a1\ntext deeper", "### T1\ntext t1"]


def test_parts_of_a_long_chunk_are_numbered(spark):
    facts = " ".join(f"Bed {i} gets {i + 3} cans." for i in range(40))
    rows = records(spark, f"# Summer\nHot.\n## Water\n{facts}\n", config=ChunkConfig(120, 2, False))
    assert len(rows) > 3 and max(len(r["texto"]) for r in rows) <= 120
    assert [(r["subchunk_ordem"], r["subchunk_total"]) for r in rows] == [(i, len(rows)) for i in range(1, len(rows) + 1)]
    assert all(r["hierarquia"].endswith(f" | Parte {i}/{len(rows)}") for i, r in enumerate(rows, 1))


def test_a_plain_title_opens_a_block(spark):
    (row,) = records(spark, "Notes on bees\n\n4.2. Hives\n\n4.2.1. Where\n    Out of the wind.\n", config=ChunkConfig(keep_text=False))
    assert (row["nome_software"], row["texto"]) == ("Notes on bees", "4.2.1. Where\n    Out of the wind.")


def test_text_without_headers_is_packed(spark):
    notes = ["A walk along the river"] + ["It rained. We turned back at the old mill, " + "slowly, " * 60 + "and dried our boots."] * 5
    rows = records(spark, "\n\n".join(notes))
    assert len(rows) >= 2 and max(len(r["texto"]) for r in rows) <= 1200
    assert [r["hierarquia"] for r in rows] == [f"Chunk {i + 1}" for i in range(len(rows))]


def test_a_word_above_the_limit_is_cut_into_slices(spark):
    rows = records(spark, "Long word\n\n" + "ab" * 1500 + "\n")
    assert "".join(r["texto"] for r in rows) == "ab" * 1500 and len(rows) == 3


def test_document_without_blocks_is_one_record(spark):
    (row,) = records(spark, "just a sentence that ends.\nand another one.\n", "kb/notes.md")
    assert (row["titulo"], row["hierarquia"], row["nome_software"]) == ("Conteúdo do Dataset", "Chunk 1", "notes")
    assert row["texto"] == "just a sentence that ends.\nand another one."


def test_block_without_text_keeps_its_document(spark):
    assert records(spark, "Only a title\n") == []
    (row,) = records(spark, "Only a title\n", empty_blocks=True)
    assert row["nome_software"] == "Only a title" and row["texto"] is None


def test_deeper_headers_and_intro_are_left_out(spark):
    rows = records(spark, "# A\nintro\n### C\nbody\n#### D\nmore\n\n### E\nend\n## F\nlost\n", config=ChunkConfig(keep_text=False))
    assert [r["texto"] for r in rows] == ["### C\nbody\nmore", "### E\nend"]
    assert [r["hierarquia"] for r in rows] == ["A > C", "A > E"]


def test_hierarchy_repeats_at_levels_one_and_two(spark):
    assert records(spark, "# A\nx\n")[0]["hierarquia"] == "A > A"
    assert records(spark, "# A\n## B\nx\n")[0]["hierarquia"] == "A > B > B"


def test_overlap_starts_the_next_chunk(one):
    chunks = pack(one, ["Alpha beta. Gamma delta.", "", "Epsilon zeta."], 30, 1)
    assert chunks == ["Alpha beta.\n\nGamma delta.", "Gamma delta.\n\nEpsilon zeta."]


def test_longer_overlap_takes_the_longest_that_fits(one):
    lines = ["A one.", "", "B two.", "", "C three is long enough."]
    assert pack(one, lines, 40, 2)[-1] == "A one.\n\nB two.\n\nC three is long enough."
    assert pack(one, lines, 36, 2)[-1] == "B two.\n\nC three is long enough."


def test_code_blocks_stay_whole(one):
    lines = ["Antes do bloco.", "", "```bash", *[f"echo 'linha {i}'" for i in range(1, 5)], "```", "", "Depois."]
    code = [c for c in pack(one, lines, 60, 1) if "```bash" in c]
    assert code and all(c.count("```") == 2 for c in code)


def test_a_fence_closes_on_its_own_marker(one):
    kinds = one(lambda: md.blocks(F.array(*[F.lit(x) for x in ["~~~", "```", "x", "~~~", "t", "| a |", "|---|", "| b |"]])))
    assert [tuple(b) for b in kinds] == [("code", 1, 4), ("text", 5, 1), ("table", 6, 3)]


def test_tables_repeat_their_header(one):
    lines = ["Antes.", "", "| Coluna | Valor |", "| --- | --- |", *[f"| Linha {i} | {c} |" for i, c in enumerate("ABCD")]]
    chunks = [c for c in pack(one, lines, 70, 1) if "| Coluna | Valor |" in c]
    assert len(chunks) == 2 and all("| --- | --- |" in c for c in chunks)


def test_configuration_is_checked():
    assert ChunkConfig.from_env({}) == ChunkConfig(1200, 1)
    assert ChunkConfig.from_env({"RAG_MAX_CHUNK_CHARS": "90", "RAG_CHUNK_OVERLAP_SENTENCES": "0"}) == ChunkConfig(90, 0)
    for bad in ({"RAG_MAX_CHUNK_CHARS": "x"}, {"RAG_MAX_CHUNK_CHARS": "0"}, {"RAG_CHUNK_OVERLAP_SENTENCES": "-1"}):
        with pytest.raises(ValueError):
            ChunkConfig.from_env(bad)


def test_chunking_needs_no_shuffle(spark):
    docs = spark.createDataFrame([("a.md", "# A\nx\n")], "source_path string, text string")
    plan = chunking.topic_records(docs, ChunkConfig(), now())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
