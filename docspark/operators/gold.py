"""Documents to gold questions: sections, keywords, classes, stratified pick."""

from __future__ import annotations

import heapq
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import paths, replies
from docspark.functions import text as tx
from docspark.functions.fold import bind, empty, fold_emit, once
from docspark.session import stage

# ---- Fixed values: patterns, word lists, templates and limits.
HEADING = f"(?s)^{tx.WS}*(#{{1,6}}){tx.WS}+({tx.NOT_WS}.*)$"
WORD = r"[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9_.+-]*"
WORD_EDGES = "._-:;()[]{}"
STOP_WORDS = (
    "a", "ao", "aos", "as", "com", "da", "das", "de", "do", "dos", "e", "em", "na", "nas", "no",
    "nos", "o", "os", "para", "por", "que", "se", "sobre", "um", "uma", "the", "and", "or", "to",
    "of", "in", "for", "on", "with", "by",
)
GENERIC_TITLES = (
    "examples", "example", "overview", "notes", "note", "summary", "introduction", "references",
    "related topics", "see also", "additional information",
)
CATEGORY_TERMS = (
    ("procedimento", (
        "how to", "how do", "como", "create", "creating", "add", "adding", "install", "configure",
        "using", "edit", "editing", "modify", "modifying", "set up",
    )),
    ("diagnostico", (
        "troubleshooting", "error", "diagnostic", "problem", "failure", "warning", "issue",
        "resolve", "fix", "bug",
    )),
    ("configuracao", (
        "option", "settings", "preferences", "property", "properties", "parameter",
        "configuration", "configure",
    )),
    ("conceito", (
        "overview", "about", "what is", "concept", "introduction", "summary", "top",
    )),
    ("referencia", (
        "example", "examples", "table", "reference", "report", "list", "library", "command",
    )),
)
DEFAULT_CATEGORY = "consulta"
QUESTION_TEMPLATES = {
    "procedimento": (
        "How does the documentation for {document} explain how to perform {focus}?",
        "What steps does the documentation describe for {focus} in {document}?",
    ),
    "diagnostico": (
        "How does the documentation for {document} guide troubleshooting for {focus}?",
        "What symptoms and corrective actions does the documentation associate with {focus} in "
        "{document}?",
    ),
    "configuracao": (
        "Which settings or options does the documentation for {document} present for {focus}?",
        "How does the documentation describe adjusting {focus} in {document}?",
    ),
    "conceito": (
        "What does the documentation for {document} explain about {focus}?",
        "What is the definition or overview of {focus} in {document}?",
    ),
    "referencia": (
        "What technical information does the documentation for {document} provide about {focus}?",
        "What reference details does the documentation collect about {focus} in {document}?",
    ),
    "consulta": (
        "What does the documentation for {document} say about {focus}?",
        "How does the documentation describe {focus} in {document}?",
    ),
}
MAX_KEYWORDS = 5
MAX_TITLE_LINE = 120
MIN_FOCUS_CHARS = 4
LONG_SECTION, VERY_LONG_SECTION, DEEP_SECTION = 900, 1800, 3
ANSWER_CHARS = 550
PER_SOURCE = 2
ANSWER_PREFIX = "A documentação descreve o seguinte sobre "


def strip_markdown(c: Column) -> Column:
    """Text without code marks, links, emphasis, quotes, headings and pipes."""
    t = F.regexp_replace(c, r"`([^`]+)`", "$1")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\(([^)]+)\)", "$1")
    return tx.collapse(F.replace(F.regexp_replace(t, r"[*_>#-]+", " "), F.lit("|"), F.lit(" ")))


def heading(line: Column) -> Column:
    """Heading of a line as ``struct<level, title>``, null if it is none."""
    marks = F.regexp_extract(line, HEADING, 1)
    return F.when(
        line.contains("#") & (marks != ""),
        F.struct(
            F.length(marks).alias("level"),
            tx.collapse(F.regexp_extract(line, HEADING, 2)).alias("title"),
        ),
    )


def _marked(text: Column) -> Column:
    return F.transform(
        tx.text_lines(text),
        lambda line, i: F.struct(i.alias("i"), line.alias("line"), heading(line).alias("h")),
    )


def _document_title(ms: Column, stem: Column) -> Column:
    """First level-1 heading or short plain line, whichever comes first."""

    def eligible(m: Column) -> Column:
        plain = tx.strip(m["line"])
        return (plain != "") & (
            F.coalesce(m["h"]["level"] == 1, F.lit(False))
            | (~plain.rlike(r"^[#\-*|]") & (F.length(plain) <= MAX_TITLE_LINE))
        )

    return bind(
        F.get(F.filter(ms, eligible), F.lit(0)),
        lambda m: F.coalesce(m["h"]["title"], tx.collapse(m["line"]), stem),
    )


def document_title(text: Column, stem: Column) -> Column:
    return bind(_marked(text), lambda ms: _document_title(ms, stem))


def _paths(heads: Column) -> Column:
    """Heading path of every heading: the open headings above it, joined by >."""
    item = "struct<level:int,title:string>"

    def step(st: Column, m: Column) -> tuple[Column, Column]:
        stack = F.concat(
            F.filter(st["stack"], lambda s: s["level"] < m["h"]["level"]), F.array(m["h"])
        )
        path = F.array_join(F.transform(stack, lambda s: s["title"]), " > ")
        return F.struct(stack.alias("stack")), F.array(path)

    return fold_emit(heads, F.struct(empty(item).alias("stack")), "string", step)


@once
def _section_rows(text: str, source_path: str) -> Column:
    """Sections of a document: ``array<struct<title, s>>``."""
    stem = paths.stem(F.col(source_path))

    def content(ms: Column, start: Column, n: Column) -> Column:
        part = F.slice(ms, start + 1, n)
        return tx.strip(F.array_join(F.transform(part, lambda m: m["line"]), "\n"))

    def found(ms: Column, hs: Column, ps: Column) -> Column:
        return F.filter(
            F.transform(
                hs,
                lambda m, j: F.struct(
                    (j + 1).alias("section_no"),
                    m["h"]["level"].alias("nivel"),
                    m["h"]["title"].alias("titulo_secao"),
                    F.get(ps, j).alias("secao"),
                    content(
                        ms,
                        m["i"] + 1,
                        F.coalesce(F.get(hs, j + 1)["i"], F.size(ms)) - m["i"] - 1,
                    ).alias("conteudo"),
                ),
            ),
            lambda s: (s["conteudo"] != "") | (s["nivel"] == 1),
        )

    def whole(ms: Column, title: Column) -> Column:
        text = tx.strip(F.array_join(F.transform(ms, lambda m: m["line"]), "\n"))
        return bind(
            text,
            lambda t: F.when(
                t != "",
                F.array(
                    F.struct(
                        F.lit(1).alias("section_no"),
                        F.lit(1).alias("nivel"),
                        title.alias("titulo_secao"),
                        title.alias("secao"),
                        t.alias("conteudo"),
                    )
                ),
            ),
        )

    def all_of(ms: Column) -> Column:
        heads = F.filter(ms, lambda m: m["h"].isNotNull())
        return bind(
            F.struct(heads.alias("hs"), _document_title(ms, stem).alias("title")),
            lambda d: bind(
                bind(_paths(d["hs"]), lambda ps: found(ms, d["hs"], ps)),
                lambda ss: F.struct(
                    d["title"].alias("title"),
                    F.when(F.size(ss) > 0, ss).otherwise(whole(ms, d["title"])).alias("ss"),
                ),
            ),
        )

    return bind(
        _marked(F.col(text)),
        lambda ms: bind(
            all_of(ms),
            lambda d: F.transform(
                d["ss"], lambda s: F.struct(d["title"].alias("title"), s.alias("s"))
            ),
        ),
    )


def sections(docs: DataFrame) -> DataFrame:
    """One row per heading with text below it, and its heading path.

    `docs` holds ``source_path`` and ``text``. A level-1 heading is kept even
    without text; text before the first heading is left out; a document without
    any section is one section. No shuffle: the lines stay inside the row.
    """
    rows = _section_rows("text", "source_path")
    return docs.select("source_path", F.explode(rows).alias("x")).select(
        "source_path", F.col("x.title").alias("titulo_documento"), "x.s.*"
    )


def keywords(title: Column, document: Column, body: Column, limit: int = MAX_KEYWORDS) -> Column:
    """Most frequent words of a section, earlier words first among equals.

    Inside the row: words are sorted, equal neighbours counted. The section
    text never leaves its row, and there is no shuffle.
    """
    words = F.regexp_extract_all(F.concat_ws(" ", title, document, body), F.lit(WORD), 0)
    kept = F.filter(
        F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(WORD_EDGES))),
        lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS),
    )
    by_word = F.sort_array(
        F.transform(kept, lambda w, i: F.struct(w.alias("w"), i.alias("at")))
    )

    def runs(ws: Column) -> Column:
        starts = F.filter(
            F.transform(
                ws,
                lambda x, i: F.struct(
                    i.alias("i"),
                    x["w"].alias("w"),
                    x["at"].alias("at"),
                    ((i == 0) | (F.get(ws, i - 1)["w"] != x["w"])).alias("new"),
                ),
            ),
            lambda s: s["new"],
        )
        return bind(
            starts,
            lambda ss: F.transform(
                ss,
                lambda s, j: F.struct(
                    (s["i"] - F.coalesce(F.get(ss, j + 1)["i"], F.size(ws))).alias("minus_count"),
                    s["at"].alias("at"),
                    s["w"].alias("w"),
                ),
            ),
        )

    best = F.transform(
        F.slice(F.sort_array(bind(by_word, runs)), 1, limit), lambda r: r["w"]
    )
    return bind(
        best, lambda b: F.when(F.size(b) > 0, b).otherwise(F.slice(tx.words(title), 1, limit))
    )


def category(title: Column, body: Column) -> Column:
    """First class one of whose terms occurs in title or text."""

    def first(t: Column) -> Column:
        out = F
        for name, terms in CATEGORY_TERMS:
            # plain searches, much faster than a pattern of alternatives
            out = out.when(reduce(or_, [t.contains(term) for term in terms]), name)
        return out.otherwise(DEFAULT_CATEGORY)

    return bind(F.lower(F.concat_ws(" ", title, body)), first)


def difficulty(body: Column, level: Column, kind: Column) -> Column:
    """One point each for length, depth, class and markup; 0-1, 2-3, 4 and more."""
    points = (
        (F.length(body) > LONG_SECTION).cast("int")
        + (F.length(body) > VERY_LONG_SECTION).cast("int")
        + (level >= DEEP_SECTION).cast("int")
        + kind.isin("diagnostico", "referencia").cast("int")
        + (body.contains("```") | body.contains("|")).cast("int")
    )
    return F.when(points <= 1, "facil").when(points <= 3, "medio").otherwise("dificil")


def focus(title: Column, words: Column, document: Column) -> Column:
    """Section title, or two keywords if it says little."""
    plain = tx.strip(title)
    vague = F.lower(plain).isin(*GENERIC_TITLES) | (F.length(plain) < MIN_FOCUS_CHARS)
    # keywords are looked at, and so computed, for vague titles only
    instead = bind(
        words,
        lambda w: F.when(F.size(w) > 0, F.array_join(F.slice(w, 1, 2), " ")).otherwise(document),
    )
    return F.when(~vague, plain).otherwise(instead)


def template_question(
    source_path: Column, section: Column, kind: Column, focus_phrase: Column, document: Column
) -> Column:
    """Question by class; a hash of the section picks one of two templates."""

    def filled(template: str, phrase: Column) -> Column:
        parts: list[Column] = []
        for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
            if piece == "{document}":
                parts.append(document)
            elif piece == "{focus}":
                parts.append(phrase)
            elif piece:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    digest = F.sha2(F.concat_ws("|", source_path, section), 256)
    odd = F.right(digest, F.lit(1)).isin(*"13579bdf")

    def question(phrase: Column) -> Column:
        out = F
        for name, (even_text, odd_text) in QUESTION_TEMPLATES.items():
            text = F.when(odd, filled(odd_text, phrase)).otherwise(filled(even_text, phrase))
            out = out.when(kind == name, text)
        return out

    return bind(focus_phrase, question)


def ideal_answer(body: Column, title: Column, document: Column, kind: Column) -> Column:
    """First two sentences of the section, at most 550 characters."""
    excerpt = bind(
        tx.sentences(strip_markdown(body)), lambda ss: F.array_join(F.slice(ss, 1, 2), " ")
    )
    cut = bind(
        excerpt,
        lambda e: F.when(
            F.length(e) > ANSWER_CHARS,
            F.concat(tx.rstrip(F.substring(e, 1, ANSWER_CHARS - 3)), F.lit("...")),
        ).otherwise(e),
    )
    return bind(
        cut,
        lambda e: F.when(
            e == "",
            F.concat(
                F.lit("A documentação de "), document, F.lit(" trata de "), title, F.lit(".")
            ),
        )
        .when(kind == "procedimento", F.concat(F.lit(ANSWER_PREFIX), title, F.lit(": "), e))
        .otherwise(e),
    )


@once
def _section_keywords(title: str, document: str, body: str) -> Column:
    return keywords(F.col(title), F.col(document), F.col(body))


def candidates(docs: DataFrame) -> DataFrame:
    """Sections with keywords, class, difficulty and template question."""
    s = sections(docs)
    title, document, body = F.col("titulo_secao"), F.col("titulo_documento"), F.col("conteudo")
    words = _section_keywords("titulo_secao", "titulo_documento", "conteudo")
    classed = s.withColumn("palavras_chave", words).withColumn("categoria", category(title, body))
    kind = F.col("categoria")
    return classed.withColumn("dificuldade", difficulty(body, F.col("nivel"), kind)).withColumn(
        "pergunta",
        template_question(
            F.col("source_path"), F.col("secao"), kind,
            focus(title, words, document), document,
        ),
    )


def _draw(seed: int) -> Column:
    """Reproducible random order of the sections."""
    section = F.col("section_no").cast("string")
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), "source_path", "secao", section), 256)


def choose(
    found: DataFrame, target: int, seed: int = 42, per_source: int = PER_SOURCE
) -> DataFrame:
    """A balanced choice of `target` candidates, without their texts.

    Gives draw, source_path, section_no, secao, categoria, pergunta and ordem.

    Classes take turns, larger classes first. Questions are unique, and at most
    `per_source` candidates of one source are taken while others are left.
    Order inside a class is a hash with the seed.

    Every ranking is cut to the rows that can still be chosen before its
    shuffle, so neither a large class nor a hot source gathers in one task.
    """
    if target <= 0:
        raise ValueError("target must be above zero")

    def first_n(df: DataFrame, by: str, n: int) -> DataFrame:
        order = Window.partitionBy(by).orderBy("draw")
        return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")

    # staged, since three rankings read them and finding them is the expensive part
    short = ("source_path", "section_no", "secao", "categoria", "pergunta")
    keyed = found.select(_draw(seed).alias("draw"), *short)
    keys = stage(first_n(keyed, "pergunta", 1))
    within = first_n(first_n(keys, "source_path", per_source), "categoria", target)
    any_source = first_n(keys, "categoria", 2 * target)
    pool = within.withColumn("tier", F.lit(0)).unionByName(
        # at most `target` rows per class
        any_source.join(F.broadcast(within.select("draw")), "draw", "left_anti").withColumn(
            "tier", F.lit(1)
        )
    )
    sizes = keys.groupBy("categoria").agg(F.count("*").alias("class_size"))
    turn = Window.partitionBy("categoria").orderBy("tier", "draw")
    # there are six classes
    ranked = pool.withColumn("turn", F.row_number().over(turn)).join(
        F.broadcast(sizes), "categoria"
    )
    order = ("turn", F.desc("class_size"), "categoria")
    chosen = ranked.orderBy(*order).limit(target)
    place = F.row_number().over(Window.orderBy(*order))
    return stage(chosen.select("draw", *short, place.alias("ordem")))


def _greedy(rows: list[tuple[str, str, str]], sizes: dict[str, int], target: int, per_source: int) -> list[str]:
    """Draws in the order of the choice, from (class, draw, source) by falling priority of the draw.

    A queue holds the classes: who has had fewer turns comes first, then the larger class. A class gives its first
    row whose source is not used up; if all of its sources are, its first row.
    """
    waiting: dict[str, list[tuple[str, str]]] = {}
    for kind, draw, source in sorted(rows):
        waiting.setdefault(kind, []).append((draw, source))
    queue = [(0, -sizes[kind], kind) for kind in waiting]
    heapq.heapify(queue)
    used: Counter[str] = Counter()
    out: list[str] = []
    while queue and len(out) < target:
        turns, size, kind = heapq.heappop(queue)
        mine = waiting[kind]
        at = next((i for i, (_, source) in enumerate(mine) if used[source] < per_source), 0)
        draw, source = mine.pop(at)
        used[source] += 1
        out.append(draw)
        if mine:
            heapq.heappush(queue, (turns + 1, size, kind))
    return out


def choose_in_turns(
    found: DataFrame, target: int, seed: int = 42, per_source: int = PER_SOURCE
) -> DataFrame:
    """As `choose`, but turn by turn: what one class takes of a source counts for all others.

    Of each class, 2 * target rows decide: the first ones with at most `per_source` of a source, as no more than
    `target` of them can be passed over for sources that other classes use up, and the first ones of any source,
    for a class whose sources are all used up. These, six classes of 4 * target short rows at most, go to the
    driver; every ranking is cut before its shuffle.
    """
    if target <= 0:
        raise ValueError("target must be above zero")

    def first_n(df: DataFrame, by: list[str], n: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("draw")
        return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")

    short = ("source_path", "section_no", "secao", "categoria", "pergunta")
    keys = stage(first_n(found.select(_draw(seed).alias("draw"), *short), ["pergunta"], 1))
    within = first_n(first_n(keys, ["categoria", "source_path"], per_source), ["categoria"], 2 * target)
    pool = within.unionByName(first_n(keys, ["categoria"], 2 * target)).select("categoria", "draw", "source_path").distinct()
    sizes = {r["categoria"]: r["count"] for r in keys.groupBy("categoria").count().collect()}
    order = _greedy([tuple(r) for r in pool.collect()], sizes, target, per_source)
    places = found.sparkSession.createDataFrame([(d, i) for i, d in enumerate(order, 1)], "draw string, ordem int")
    return keys.join(F.broadcast(places), "draw").select("draw", *short, "ordem")  # `target` rows


def _chosen_rows(found: DataFrame, chosen: DataFrame, seed: int) -> DataFrame:
    # the choice has at most `target` rows
    keys = F.broadcast(chosen.select("draw", "ordem"))
    return found.withColumn("draw", _draw(seed)).join(keys, "draw").drop("draw")


def stratified_pick(
    found: DataFrame, target: int, seed: int = 42, per_source: int = PER_SOURCE
) -> DataFrame:
    """The candidates of `choose`, whole, with their `ordem`."""
    return _chosen_rows(found, choose(found, target, seed, per_source), seed)


def question_id(source_path: Column, section: Column, question: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", source_path, section, question), 256)
    return F.concat(F.lit("q_"), F.left(digest, F.lit(16)))


def gold_rows(picked: DataFrame) -> DataFrame:
    """Gold table of chosen candidates."""
    return picked.select(
        question_id(F.col("source_path"), F.col("secao"), F.col("pergunta")).alias("id"),
        "pergunta",
        ideal_answer(
            F.col("conteudo"), F.col("titulo_secao"), F.col("titulo_documento"), F.col("categoria")
        ).alias("resposta_ideal"),
        "source_path", "titulo_documento", "secao", "palavras_chave", "categoria", "dificuldade",
        "ordem",
    )


def with_written_questions(gold: DataFrame, written: DataFrame) -> DataFrame:
    """Use written questions ``(id, reply)`` where valid, else keep the template."""
    asked = F.coalesce(replies.clean_question(F.col("reply")), F.col("pergunta"))
    return (
        gold.join(written.select("id", "reply"), "id", "left")
        .withColumn("pergunta", asked)
        .withColumn("id", question_id(F.col("source_path"), F.col("secao"), F.col("pergunta")))
        .select(*gold.columns)
    )


def build_gold(
    docs: DataFrame, target: int = 50, seed: int = 42, written: DataFrame | None = None
) -> DataFrame:
    """Gold questions of a corpus of Markdown documents."""
    chosen = choose(candidates(docs), target, seed)
    # only the chosen documents are cut into sections again
    picked = docs.join(F.broadcast(chosen.select("source_path")), "source_path", "left_semi")
    gold = gold_rows(_chosen_rows(candidates(picked), chosen, seed))
    return gold if written is None else with_written_questions(gold, written)
