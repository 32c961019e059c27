import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.llm import chat

SCHEMA = "conv_id long, message long, part int, seq long, kind string, role string, text string"


def rendered(spark, events):
    out = chat.render(chat.fold(spark.createDataFrame(events, SCHEMA)))
    out = out.withColumns({"turns": chat.turns(F.col("formatted")), "said": chat.masked(F.col("formatted"), F.col("loss"))})
    return {r["conv_id"]: r for r in out.collect()}


def test_deltas_edits_and_regenerations_fold(spark):
    events = [
        (1, 0, 0, 0, "delta", "user", "Hel"), (1, 0, 0, 1, "delta", None, "lo"), (1, 1, 0, 2, "delta", "assistant", "bad"),
        (1, 1, 0, 3, "regenerate", None, None), (1, 1, 0, 4, "delta", None, "go"), (1, 1, 0, 5, "delta", None, "od"),
        (1, 0, 0, 6, "edit", None, "Hi"), (1, 0, 0, 7, "delta", None, "!"), (2, 0, 0, 0, "delta", None, None),
    ]
    got = rendered(spark, events[::-1])
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "Hi!"), ("assistant", "good")]
    assert got[1]["said"] == ["good"] and [tuple(t) for t in got[2]["turns"]] == [("", "")] and got[2]["said"] == []
    assert got[1]["formatted"] == "<|im_start|>user\nHi!<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n"


NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>", "<\\|im_end|>", "[\\\\INST]", "<<s>", "\\", "\n", "", "é𝔘", "<<SYS>>", "a\\nb"]


def test_round_trip_of_nasty_texts_and_roles(spark):
    events = [(1, i, 0, 0, "delta", role, text) for i, (role, text) in enumerate((r, t) for r in [*NASTY, "assistant"] for t in NASTY)]
    got = rendered(spark, events)[1]
    assert [tuple(t) for t in got["turns"]] == [(e[5], e[6]) for e in events]
    assert got["said"] == [e[6] for e in events if e[5] == "assistant"] and got["n_turns"] == len(events)


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="<>|[]/\\ims_endtarINSTY\n é", max_size=30), min_size=1, max_size=200))
def test_round_trip(spark, texts):
    got = rendered(spark, [(1, i, 0, 0, "delta", "assistant", t) for i, t in enumerate(texts)])[1]
    assert [t["text"] for t in got["turns"]] == texts == got["said"]


def test_long_conversations_cross_blocks(spark):
    n = 3 * chat.BLOCK + 5
    events = [(1, i, 0, 0, "delta", ("user", "assistant")[i % 2], f"t{i} é") for i in range(n)]
    got = rendered(spark, events)[1]
    assert got["said"] == [e[6] for e in events if e[5] == "assistant"]
    body = "".join(f"{e[5]}\n{e[6]}\n" for e in events)
    assert hashlib.sha256("".join(f"{t['role']}\n{t['text']}\n" for t in got["turns"]).encode()).digest() == hashlib.sha256(body.encode()).digest()


def test_nulls_ties_repeated_rows_and_empty_log(spark):
    events = [(None, None, 0, None, None, None, "a"), (None, 1, 0, 0, "delta", "user", "b"), (3, 0, 1, 0, "delta", "user", "c"), (3, 0, 2, 0, "delta", "user", "c")]
    got = rendered(spark, events)
    assert [tuple(t) for t in got[None]["turns"]] == [("", "a"), ("user", "b")]
    assert [tuple(t) for t in got[3]["turns"]] == [("user", "c")] * 2
    assert rendered(spark, []) == {}


def test_extra_columns_with_the_names_used_inside(spark):
    events = [(1, 0, 0, 0, "delta", "user", "a"), (1, 1, 0, 1, "delta", "assistant", "b")]
    names = ["formatted", "loss", "turns", "n_turns", "body"]
    rows = spark.createDataFrame([(*e, *names) for e in events], SCHEMA + "".join(f", {n} string" for n in names))
    plain = spark.createDataFrame(events, SCHEMA)
    assert [tuple(r) for r in chat.render(chat.fold(rows)).collect()] == [tuple(r) for r in chat.render(chat.fold(plain)).collect()]
