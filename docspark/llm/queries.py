"""Registered queries of the operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm import chat, jaccard, langid, mixing, negatives, packing, periodic, quality, sharding, substrings, tokencount, topk, urls
from docspark.session import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- op1 -------------------------------------------------------------------------------------------

_WORD = r"[^\x20\x09-\x0D]+"


def _window(n: int) -> str:
    """The window of n words that begins at a row of words, null near the end."""
    return " || ' ' || ".join(["word", *[f"lead(word, {j}) OVER per_doc" for j in range(1, n)]])


def quality_sql() -> str:
    ks = quality.COVERAGE
    windows = ", ".join(f"{_window(k)} AS g{k}" for k in (3, *ks))
    later = ", ".join(
        f"CASE WHEN g{k} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{k} ORDER BY pos) > 1 THEN 1 ELSE 0 END AS l{k}" for k in ks
    )
    cover = ", ".join(
        f"max(l{k}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c{k}" for k in ks
    )
    sums = ", ".join(f"coalesce(sum(length(word)) FILTER (c{k} = 1), 0) AS dup_chars_{k}" for k in ks)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars"]
    counts += [f"dup_chars_{k}" for k in ks]
    longs = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in counts)
    over = " OR ".join(f"100 * dup_chars_{k} > {percent} * word_chars" for k, percent in ks.items())
    return f"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents)
), windows AS (
  SELECT doc_id, word, pos, {windows} FROM words WINDOW per_doc AS (PARTITION BY doc_id ORDER BY pos)
), flags AS (
  SELECT *, CASE WHEN g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 THEN 1 ELSE 0 END AS t3, {later} FROM windows
), cover AS (
  SELECT *, max(t3) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, {cover} FROM flags
), per_word AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (c3 = 1) AS n_repeat_words, {sums}
  FROM cover GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), worded AS (
  SELECT doc_id, length(array_to_string(regexp_extract_all(line, '{_WORD}'), '')) AS chars,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again
  FROM lines WHERE regexp_matches(line, '{_WORD}')
), per_line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, sum(chars) FILTER (again) AS dup_line_chars
  FROM worded GROUP BY doc_id
), counted AS (
  SELECT doc_id, {longs} FROM (
    SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM documents
  ) LEFT JOIN per_word USING (doc_id) LEFT JOIN per_line USING (doc_id)
), based AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND NOT (100 * n_dup_lines > {quality.MAX_LINE_PERCENT} * n_lines
  OR 100 * dup_line_chars > {quality.MAX_LINE_CHAR_PERCENT} * word_chars OR {over}) AS kept
FROM based
"""


@query("op1_quality", quality_sql())
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"))


# --- op2 -------------------------------------------------------------------------------------------

_OP2_SQL = f"""
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= {topk.K}
"""


@query("op2_top_k", _OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").where(topk.valid(F.col("embedding")))
    vectors = rows.select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return topk.search(vectors, F.col("vec_id") % 20 == 0, stage)


# --- op3 -------------------------------------------------------------------------------------------

_ROLE = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
_ADD = r"\1\\\2\3"
_OP3_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), forms AS (
  SELECT *, regexp_replace(text, '{chat.ESCAPABLE}', '{_ADD}', 'g') AS body,
    regexp_replace({_ROLE}, '{chat.ESCAPABLE}', '{_ADD}', 'g') AS name FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.START)} + length(name) + 1 + length(body) + {len(chat.END) + 1}) AS BIGINT) AS formatted_chars
FROM forms GROUP BY conv_id
"""


@query("op3_chat_format", _OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # the table holds each turn whole: one delta; rows under one turn are messages of their own
    part = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    events = rows.select(
        "conv_id", F.col("turn").alias("message"), part.alias("part"), F.lit(0).alias("seq"), F.lit("delta").alias("kind"), "role", "text"
    )
    out = chat.render(chat.fold(events))
    out = out.withColumns({"turns": chat.turns(F.col("formatted")), "trained": chat.masked(F.col("formatted"), F.col("loss"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


# --- op4 -------------------------------------------------------------------------------------------

#: Host and path prefix, and verdict.
URL_RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]
#: The block list holds the canonical URLs seen on hosts with one of these words.
LISTED_HOSTS = "casino|pills"

_HOST = "translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP4_SQL = f"""
WITH rest AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
), parts AS (
  SELECT page_id, {_HOST.format(rest='rest')} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), forms AS (
  SELECT *, '.' || host AS dotted, regexp_replace(host, '^(www|m)\\.', '')
    || regexp_replace(regexp_replace(path, '\\.html?$', ''), '/+$', '') AS canonical FROM parts
), judged AS (
  SELECT *, CASE
    WHEN suffix(dotted, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN suffix(dotted, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN suffix(dotted, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN suffix(dotted, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN suffix(dotted, '.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule, canonical IN (SELECT canonical FROM forms WHERE regexp_matches(host, '{LISTED_HOSTS}')) AS listed FROM forms
)
SELECT page_id, host, path, rule, listed, CASE
  WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op4_url_filter", _OP4_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    host = urls.host(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOSTS)).select(urls.canonical(host, urls.path(F.col("url"))).alias("canonical")).distinct()
    return urls.judge(pages, listed, URL_RULES)


# --- op5 -------------------------------------------------------------------------------------------


@query("op5_token_counts")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.counts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


# --- op6 -------------------------------------------------------------------------------------------


@query("op6_mixing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), stage)
    taken = (F.col("size") * F.col("repeats")).alias("taken")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "repeats", taken)


# --- op7 -------------------------------------------------------------------------------------------


@query("op7_sharding")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf, "documents"), stage)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# --- op8 -------------------------------------------------------------------------------------------


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = substrings.deduplicate(table(spark, sf, "documents").select("doc_id", "text"), stage, spans=True)
    return cleaned.select(
        "doc_id", "text", F.col("_words").alias("n_words"), F.col("_removed_words").alias("removed_words"), F.col("_spans").alias("spans")
    )


# --- op9 -------------------------------------------------------------------------------------------

_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COMPONENTS_SQL = f"""
words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '{_WORD}') AS w FROM {{documents}}
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {jaccard.WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {jaccard.WORDS} + 2), lambda i: array_to_string(w[i : i + {jaccard.WORDS} - 1], ' ')) END) AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {jaccard.PERCENT} * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), components AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
"""
_OP9_SQL = f"""
WITH RECURSIVE {COMPONENTS_SQL.format(documents="documents")}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN components USING (doc_id)
"""


@query("op9_jaccard_join", _OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf, "documents"), stage)


# --- op10 ------------------------------------------------------------------------------------------


@query("op10_packing")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(stage(cut)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


# --- op11 ------------------------------------------------------------------------------------------

_SEPARATORS = r"[\x20\x09-\x0D]+"


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the hash of doc_id, repeat some words from a place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", _SEPARATORS), "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), F.floor(h / 10).alias("_g"))
    rows = rows.withColumn("_n", F.size("_words").cast("long")).withColumn("_a", F.col("_g") % F.col("_n"))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    n, a, p = (F.col(c).cast("int") for c in ("_n", "_a", "_p"))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", a + 1, p), times)), F.lit(1), n - a)
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")
    return rows.select("doc_id", F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"))


def crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII string: per byte an exclusive or, then eight shifts (marked 256)."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substr({text}, i, 1)) AS BIGINT)] || list_transform(range(8), lambda k: 256)))"
    step = "CASE WHEN e < 256 THEN xor(acc, e) ELSE xor(acc >> 1, CASE WHEN acc % 2 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda acc, e: {step}), 4294967295::BIGINT)"


_OP11_SQL = f"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents
), placed AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed
), periods AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), words AS (
  SELECT doc_id, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM periods)
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, {periodic.LEAST} - q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL
), listed AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS top,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length,
  CAST(top.period AS BIGINT) AS period, CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op11_periodic_runs", _OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.find(planted_periods(table(spark, sf, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n"))))
    found = found.withColumn("_top", top)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.start")).alias("start"), F.col("_top.length").alias("length"),
        (-F.col("_top.period")).alias("period"), F.floor(1000 * F.col("_top.length") / -F.col("_top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# --- op12 ------------------------------------------------------------------------------------------

_OP12_SQL = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER window_ AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
WINDOW window_ AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER window_ <= 10
"""


@query("op12_hard_negatives", _OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select("vec_id", moved.alias("label"), negatives.quantized(F.col("embedding"), 256.0).alias("v"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, stage)


# --- op13 ------------------------------------------------------------------------------------------


@query("op13_language_id")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = langid.identify(docs, langid.learn(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", (~F.col("accepted")).alias("rejected"))
