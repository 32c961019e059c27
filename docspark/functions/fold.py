"""Sequential work inside one row, written with ``aggregate``.

Higher-order functions are interpreted, so two things decide whether a fold is
linear: an expression used inside a lambda must be bound once (`bind`), and an
output list must not be re-copied for every element (`fold_emit` appends to a
short block list and joins the blocks afterwards).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def once(builder: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression a builder made for the same plain arguments.

    Nested lambdas take thousands of calls into the JVM to build, so a job that
    plans the same operator again should not pay twice. Arguments are column
    names and numbers, never columns; a new JVM starts afresh.
    """
    made: dict[tuple, Column] = {}

    @functools.wraps(builder)
    def get(*args: str | int) -> Column:
        key = (id(SparkContext._gateway), *args)
        if key not in made:
            made[key] = builder(*args)
        return made[key]

    return get


def empty(element_type: str) -> Column:
    """Typed empty array."""
    return F.array().cast(f"array<{element_type}>")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a variable.

    Without it Catalyst may inline `value` into every lambda that mentions it
    and evaluate it again for each array element.
    """
    return F.aggregate(empty("int"), value, lambda acc, _: acc, body)


def fold_emit(
    items: Column,
    state: Column,
    emitted_type: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
    finish: Callable[[Column], Column] | None = None,
) -> Column:
    """Fold `items` with a struct `state`; collect what each step emits.

    `step(state, item)` returns the next state and an array of emitted values;
    `finish(state)` may emit more at the end. Emitted values are gathered per
    block of `BLOCK` items, so a row with n items costs about n * BLOCK / 2
    reference copies instead of n * n / 2.
    """
    none = empty(emitted_type)

    def one(acc: Column, item: Column) -> Column:
        nxt, out = step(acc["state"], item)
        return F.struct(nxt.alias("state"), F.concat(acc["out"], out).alias("out"))

    def one_block(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bind(
            inner,
            lambda r: F.struct(
                r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")
            ),
        )

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], finish(acc["state"])) if finish else acc["out"]

    def blocked(arr: Column) -> Column:
        blocks = F.when(
            F.size(arr) > 0,
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / BLOCK).cast("int")),
                lambda b: F.slice(arr, b * BLOCK + 1, F.lit(BLOCK)),
            ),
        ).otherwise(F.slice(F.array(arr), 2, 1))
        return F.aggregate(
            blocks, F.struct(state.alias("state"), none.alias("out")), one_block, end
        )

    return bind(items, blocked)


def join_ranges(
    items: Column,
    limit: int,
    glue: int,
) -> Column:
    """Cut a list into runs of neighbours, greedily, by total length.

    `items` is ``array<struct<len:int, may_join:boolean, force:boolean,
    closes:boolean>>``. An item joins the open run when it may join, the run is
    not closed, and either the joined length (with `glue` characters between
    neighbours) stays within `limit` or `force` is set. A `closes` item ends
    its run. Returns ``array<struct<start:int, n:int>>`` with 1-based starts.
    """
    state = F.struct(
        F.lit(1).alias("start"),
        F.lit(0).alias("n"),
        F.lit(0).alias("total"),
        F.lit(False).alias("closed"),
    )

    def step(st: Column, it: Column) -> tuple[Column, Column]:
        joined = st["total"] + glue + it["len"]
        joins = (
            (st["n"] > 0)
            & ~st["closed"]
            & it["may_join"]
            & ((joined <= limit) | it["force"])
        )
        nxt = F.when(
            joins,
            F.struct(
                st["start"].alias("start"),
                (st["n"] + 1).alias("n"),
                joined.alias("total"),
                it["closes"].alias("closed"),
            ),
        ).otherwise(
            F.struct(
                (st["start"] + st["n"]).alias("start"),
                F.lit(1).alias("n"),
                it["len"].alias("total"),
                it["closes"].alias("closed"),
            )
        )
        out = F.when(joins | (st["n"] == 0), empty("struct<start:int,n:int>")).otherwise(
            F.array(F.struct(st["start"].alias("start"), st["n"].alias("n")))
        )
        return nxt, out

    def finish(st: Column) -> Column:
        return F.when(
            st["n"] > 0, F.array(F.struct(st["start"].alias("start"), st["n"].alias("n")))
        ).otherwise(empty("struct<start:int,n:int>"))

    return fold_emit(items, state, "struct<start:int,n:int>", step, finish)
