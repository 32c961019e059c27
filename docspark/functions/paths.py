"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import text as tx

# The folder that marks a converted document, and drive letters.
DOCS_FOLDER = "docs_markdown/"
TEXT_SUFFIXES = r"(?i)\.(html?|xhtml|xml|txt)$"
MARKDOWN_SUFFIX = r"(?i)\.md$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def normalise(path: Column, fallback: Column) -> Column:
    """Plain form of a path: one kind of slash, no ``.``, ``..`` or doubled slash.

    A null or empty path gives the fallback name.
    """
    p = F.when(F.coalesce(path, F.lit("")) == "", fallback).otherwise(path)
    rooted = p.startswith("/")
    parts = F.filter(F.split(p, "/", -1), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        )
        .when((s == "..") & rooted, acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))
    return F.replace(
        F.when(joined == "", F.lit(".")).otherwise(joined), F.lit("\\"), F.lit("/")
    )


def output_path(path: Column, source_root: str, output_root: str) -> Column:
    """Where a converted file goes: same place under the output root, ``.md``."""
    root = source_root.rstrip("/") + "/"
    inside = F.when(path.startswith(root), F.substring(path, len(root) + 1, F.length(path)))
    relative = F.coalesce(inside.cast("string"), basename(path))
    return F.concat(
        F.lit(output_root.rstrip("/") + "/"),
        F.regexp_replace(relative, r"(?<=[^./])\.[^./]*$", ""),
        F.lit(".md"),
    )


def path_key(path: Column) -> Column:
    """Key two spellings of a path agree on: the part from the documents folder
    on, else the file name, in lower case; '' for nothing."""
    p = F.lower(tx.strip(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))))
    p = F.regexp_replace(p, r"(?s)^.:/", "")
    at = F.instr(p, DOCS_FOLDER)
    return F.when(at > 0, F.substring(p, at, F.length(p))).otherwise(basename(p))
