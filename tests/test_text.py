import random

import pytest
from pyspark.sql import functions as F

from docspark.functions import fold, paths
from docspark.functions import text as tx


def test_collapse_and_strip_use_unicode_white_space(many):
    texts = ["  a  b ", "\u00a0a\u2003b\u3000", "", "\x1c a \x85"]
    assert many(tx.collapse, texts) == ["a b", "a b", "", "a"]


def test_lines_keep_blanks_and_drop_the_final_end(many):
    assert many(tx.file_lines, ["a\n\nb\n", "a\r\nb\rc", ""]) == [["a", "", "b"], ["a", "b", "c"], []]
    assert many(tx.text_lines, ["a\u2028b\x0bc"]) == [["a", "b", "c"]]


def test_sentences(many):
    assert many(tx.sentences, ["One. Two!  Three? four", "", "no end"]) == [
        ["One.", "Two!", "Three?", "four"], [], ["no end"],
    ]


def test_split_long(many):
    cut = many(lambda c: tx.split_long(c, 10), ["aaaa bbbb cccc", "x" * 25, "short", "a " + "y" * 23 + " b"])
    assert cut[0] == ["aaaa bbbb", "cccc"]
    assert cut[1] == ["x" * 10, "x" * 10, "x" * 5]
    assert cut[2] == ["short"]
    assert cut[3] == ["a", "y" * 10, "y" * 10, "yyy", "b"]


def test_runs_never_exceed_the_limit_and_are_greedy(many):
    rng = random.Random(7)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(2, 600))) for _ in range(30)]
    for text, pieces in zip(texts, many(lambda c: tx.split_long(c, 40), texts)):
        assert " ".join(pieces) == text
        for left, right in zip(pieces, pieces[1:]):
            assert len(left) <= 40 < len(left) + 1 + len(right.split(" ")[0])


def test_numbers(many):
    assert many(tx.to_number, ["1.5", "", "x", "NaN", "Infinity", "-2"]) == [1.5, None, None, None, None, -2.0]


def test_truthy(many):
    assert many(tx.truthy, ["1", " SIM ", "on", "no", ""]) == [True, True, True, False, False]


def test_paths(many):
    assert many(lambda c: paths.normalise(c, F.lit("f.md")), ["a/./b//../c.md", "", "/../x", "../a", "a\\b"]) == [
        "a/c.md", "f.md", "/x", "../a", "a/b",
    ]
    assert many(paths.path_key, ["C:\\kb\\docs_markdown\\A.md", " x/Y.md ", "", "/d/DOCS_MARKDOWN/q/z.md"]) == [
        "docs_markdown/a.md", "y.md", "", "docs_markdown/q/z.md",
    ]
    assert many(paths.stem, ["a/b.c.md", "x", ".hidden"]) == ["b.c", "x", ".hidden"]
    assert many(lambda c: paths.output_path(c, "/docs", "out"), ["/docs/a/b.htm", "/else/c.html", "/docs/n"]) == [
        "out/a/b.md", "out/c.md", "out/n.md",
    ]
