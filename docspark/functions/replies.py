"""Model replies (JSON text) as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions.fold import bind
from docspark.functions.prompts import JUDGE_TOOL
from docspark.schemas import JUDGE_TOPICS

# Keys of replies, and the shortest question.
TRANSLATION_KEYS = ("translated_query", "translation", "query")
MIN_QUESTION_CHARS = 12
PART_TYPE = "array<struct<text:string,toolUse:struct<name:string,input:string>>>"


def json_int(document: Column, path: str) -> Column:
    """Whole number at a JSON path (`document` is a variant), null for other types."""
    v = F.try_variant_get(document, path, "variant")
    return F.when(
        F.schema_of_variant(v) == "BIGINT", F.try_variant_get(document, path, "bigint")
    )


def json_string(document: Column, path: str) -> Column:
    """Text at a JSON path, null for other types."""
    v = F.try_variant_get(document, path, "variant")
    return F.when(
        F.schema_of_variant(v) == "STRING", F.try_variant_get(document, path, "string")
    )


def is_object(json: Column) -> Column:
    parsed = F.try_parse_json(json)
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def clean_translation(reply: Column, original: Column) -> Column:
    """Translated query of a reply: no fences, JSON wrapper or quotes.

    An empty result gives the original question.
    """
    plain = tx.strip(F.coalesce(reply, F.lit("")))
    unfenced = F.when(plain.startswith("```"), tx.strip(F.btrim(plain, F.lit("`")))).otherwise(plain)

    def from_json(t: Column) -> Column:
        v = F.try_parse_json(t)
        values = [F.nullif(json_string(v, f"$.{k}"), F.lit("")) for k in TRANSLATION_KEYS]
        return F.when(
            t.startswith("{") & t.endswith("}"),
            F.nullif(tx.strip(F.coalesce(*values)), F.lit("")),
        )

    def without(quote: str) -> Callable[[Column], Column]:
        return lambda x: F.when(
            x.startswith(quote) & x.endswith(quote) & (F.length(x) >= 2),
            tx.strip(F.substring(x, F.lit(2), F.length(x) - 2)),
        ).otherwise(x)

    def unquoted(t: Column) -> Column:
        return bind(bind(t, without('"')), without("'"))

    return bind(
        unfenced,
        lambda t: F.coalesce(F.nullif(F.coalesce(from_json(t), unquoted(t)), F.lit("")), original),
    )


def query_translation(
    question: Column, reply: Column, enabled: Column, model_id: Column, error: Column
) -> Column:
    """How a question was translated for retrieval, as one struct.

    Without a reply (translation off, or failed with `error`) the question
    itself is used.
    """
    usable = enabled & reply.isNotNull() & error.isNull()
    return bind(
        F.when(usable, clean_translation(reply, question)).otherwise(question),
        lambda t: F.struct(
            enabled.alias("enabled"),
            (usable & (t != question)).alias("applied"),
            F.when(enabled, model_id).alias("model_id"),
            question.alias("original_question"),
            t.alias("translated_question"),
            F.when(enabled, error).alias("error"),
        ),
    )


def clean_question(reply: Column) -> Column:
    """Question of a reply: one line with a question mark; null if it is too short."""
    t = tx.collapse(F.btrim(F.btrim(tx.strip(reply), F.lit('"')), F.lit("'")))
    return bind(
        t,
        lambda x: bind(
            F.when(x.endswith("?"), x)
            .when(
                x.endswith(".") & ~x.contains("?"),
                F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit("?")),
            )
            .when(x.endswith("."), x)
            .otherwise(F.concat(x, F.lit("?"))),
            lambda q: F.when(F.length(q) >= MIN_QUESTION_CHARS, q),
        ),
    )


def content_parts(response: Column) -> Column:
    return F.from_json(F.get_json_object(response, "$.output.message.content"), PART_TYPE)


def reply_text(response: Column) -> Column:
    """Text parts of a reply, joined and trimmed; null if there is none."""
    texts = F.transform(content_parts(response), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.nullif(tx.strip(F.array_join(texts, "")), F.lit(""))


def reply_vector(response: Column) -> Column:
    """Vector of an embedding reply, flat or in a list of one."""
    raw = F.coalesce(
        F.get_json_object(response, "$.embedding"), F.get_json_object(response, "$.embeddings")
    )
    nested = F.from_json(raw, "array<array<double>>")
    return F.when(F.ltrim(raw).rlike(r"^\[\s*\["), F.get(nested, F.lit(0))).otherwise(
        F.from_json(raw, "array<double>")
    )


def judge_payload(response: Column, tool: str = JUDGE_TOOL) -> Column:
    """JSON object of a structured reply: the tool input, else the reply text."""
    uses = F.filter(
        content_parts(response),
        lambda p: (tx.strip(p["toolUse"]["name"]) == tool) & is_object(p["toolUse"]["input"]),
    )
    tool_input = F.get(uses, F.lit(0))["toolUse"]["input"]
    return bind(
        F.coalesce(tool_input, reply_text(response)), lambda j: F.when(is_object(j), j)
    )


def judge_scores(payload: Column) -> Column:
    """Score and comment per judge topic; a score that is no whole number is null."""
    return bind(
        F.try_parse_json(payload),
        lambda v: F.struct(
            *[
                F.struct(
                    json_int(v, f"$.{t}.score").cast("int").alias("score"),
                    F.coalesce(
                        F.try_variant_get(v, f"$.{t}.comment", "string"), F.lit("")
                    ).alias("comment"),
                ).alias(t)
                for t in JUDGE_TOPICS
            ]
        ),
    )


def tokens(metadata: Column) -> Column:
    """Input, output and total tokens of generation metadata."""

    def usage(v: Column, camel: str, snake: str, flat: str) -> Column:
        return F.coalesce(
            json_int(v, f"$.usage.{camel}"), json_int(v, f"$.usage.{snake}"), json_int(v, f"$.{flat}")
        )

    return bind(
        F.try_parse_json(metadata),
        lambda v: bind(
            F.struct(
                usage(v, "inputTokens", "input_tokens", "prompt_token_count").alias("i"),
                usage(v, "outputTokens", "output_tokens", "generation_token_count").alias("o"),
            ),
            lambda t: F.struct(
                t["i"].alias("input_tokens"),
                t["o"].alias("output_tokens"),
                F.coalesce(t["i"] + t["o"], t["o"], t["i"]).alias("tokens"),
            ),
        ),
    )


def format_duration(seconds: Column) -> Column:
    """`1.23s` below a minute, else `1m 2.3s`; `N/D` for null."""
    minutes = F.floor(seconds / 60).cast("int")

    def even(x: Column, digits: int) -> Column:
        # format_string rounds halves up; a half that is exact goes to the even digit
        return F.when(x * 8 == F.floor(x * 8), F.bround(x, digits)).otherwise(x)

    return (
        F.when(seconds.isNull(), F.lit("N/D"))
        .when(seconds < 60, F.format_string("%.2fs", even(seconds, 2)))
        .otherwise(F.format_string("%dm %.1fs", minutes, even(seconds - minutes * 60, 1)))
    )


def format_tokens(usage: Column) -> Column:
    """Token counts of a usage object as text; `N/D` if there is none."""

    def first(v: Column, *keys: str) -> Column:
        return F.coalesce(*[F.nullif(json_int(v, f"$.{k}"), F.lit(0)) for k in keys[:-1]],
                          json_int(v, f"$.{keys[-1]}"))

    def shown(v: Column) -> Column:
        entries = (
            ("entrada: ", first(v, "inputTokens", "input_tokens")),
            ("saída: ", first(v, "outputTokens", "output_tokens")),
            ("total: ", first(v, "totalTokens", "total_tokens")),
        )
        parts = [F.concat(F.lit(label), n.cast("string")) for label, n in entries]
        return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit("N/D"))

    return bind(F.try_parse_json(usage), shown)
