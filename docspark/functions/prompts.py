"""Prompt texts (fixed values) and the expressions that fill them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions.fold import bind

# ---- Fixed values: prompt texts, labels and notices.
NOT_AVAILABLE = "N/A"
TRUNCATION_NOTICE = "[AVISO: Outros documentos relevantes foram omitidos por limite de contexto]"
NO_SOURCES = "Nenhuma fonte recuperada."
NO_CONTEXT = "Sem contexto disponível."
ANSWER_INTRO = (
    "Você é um assistente técnico especializado em documentação corporativa. Responda apenas com "
    "base no contexto recuperado. Se a resposta não estiver presente, diga isso explicitamente."
)
ANSWER_SYSTEM = "Você é um assistente técnico preciso, objetivo e restrito ao conteúdo recuperado."
STOP_TOKENS = ("<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
TRANSLATION_PROMPT_HEAD = (
    "Traduza a consulta abaixo do português brasileiro para o inglês técnico usado em "
)
TRANSLATION_DOMAIN = "documentação técnica"
TRANSLATION_PROMPT_TAIL = (
    ". Preserve siglas, nomes de menus, comandos, recursos e termos já consagrados em inglês. Expanda "
    "a terminologia técnica quando isso melhorar a busca. Retorne apenas o texto traduzido, sem "
    "explicações.\n\nConsulta: "
)
QUESTION_PROMPT_HEAD = (
    "Você está criando um dataset padrão-ouro para avaliação de RAG em documentação técnica.\n"
    "Gere exatamente uma pergunta de suporte técnico em português brasileiro, escrita como um "
    "usuário leigo ou intermediário que não conhece o título exato da seção.\n"
    "Requisitos: a pergunta não deve copiar o título da seção, não deve mencionar palavras-chave "
    "óbvias do título, deve soar natural e realista, e deve ser respondível pelo trecho "
    "fornecido.\n\n"
)
QUESTION_PROMPT_TAIL = (
    "Retorne apenas a pergunta final em uma única linha, sem aspas, sem lista, sem numeração e sem "
    "explicações adicionais."
)
JUDGE_PROMPT_HEAD = (
    "Avalie a resposta gerada em comparação com a resposta ideal para uma tarefa de RAG.\n\n"
)
JUDGE_PROMPT_TAIL = (
    "Retorne SOMENTE um JSON válido com a estrutura abaixo:\n"
    "{\n"
    '  "groundedness": {"score": 1, "comment": ""},\n'
    '  "corretude": {"score": 1, "comment": ""},\n'
    '  "completude": {"score": 1, "comment": ""},\n'
    '  "clareza": {"score": 1, "comment": ""},\n'
    '  "precisao_tecnica": {"score": 1, "comment": ""},\n'
    '  "alucinacao": {"score": 1, "comment": ""}\n'
    "}\n\n"
    "Use a escala de 1 a 5, onde 5 e melhor. Para alucinacao, 5 significa ausencia de alucinacao e "
    "1 indica forte alucinacao."
)
JUDGE_TOOL = "avaliar_resposta_rag"


def context_block(
    rank: Column, software: Column, hierarquia: Column, titulo: Column, source: Column,
    distance: Column, document: Column,
) -> Column:
    """A hit as labelled lines with its text; N/A for what is missing."""

    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(NOT_AVAILABLE))

    return tx.strip(
        F.concat(
            F.lit("[Trecho "), rank.cast("string"), F.lit("]\nSoftware: "), shown(software),
            F.lit("\nHierarquia: "), shown(hierarquia),
            F.lit("\nTítulo: "), shown(titulo),
            F.lit("\nFonte: "), shown(source),
            F.lit("\nDistância: "), shown(distance),
            F.lit("\nConteúdo:\n"), tx.strip(F.coalesce(document, F.lit(""))),
        )
    )


def source_line(software: Column, hierarquia: Column, titulo: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (software, hierarquia, titulo)]
    return F.concat(F.lit("- "), F.concat_ws(" | ", *parts))


def sources_block(source_lines: Column) -> Column:
    """Source lines as text, or the note that there are none."""
    return F.coalesce(
        F.nullif(tx.strip(F.array_join(source_lines, "\n")), F.lit("")), F.lit(NO_SOURCES)
    )


def answer_prompt(question: Column, context: Column, sources: Column) -> Column:
    shown = F.coalesce(F.nullif(tx.strip(context), F.lit("")), F.lit(NO_CONTEXT))
    return F.concat(
        F.lit(ANSWER_INTRO + "\n\nPergunta: "), question, F.lit("\n\nContexto:\n"), shown,
        F.lit("\n\nFontes recuperadas:\n"), sources, F.lit("\n\nResposta em português brasileiro:"),
    )


def chat_template(prompt: Column, system: str = ANSWER_SYSTEM) -> Column:
    """Prompt in the native format of a chat model with header tokens."""
    return F.concat(
        F.lit("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"),
        F.lit(system.strip()),
        F.lit("<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"),
        prompt,
        F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"),
    )


def cut_stop_tokens(reply: Column) -> Column:
    """Reply up to its first stop token."""
    return bind(
        tx.strip(reply),
        lambda t: F.when(
            t.contains("<|"),
            tx.rstrip(
                F.regexp_replace(t, r"(?s)<\|(?:eot_id|start_header_id|end_header_id)\|>.*", "")
            ),
        ).otherwise(t),
    )


def translation_prompt(question: Column, domain: str = TRANSLATION_DOMAIN) -> Column:
    """Prompt to translate a question into the English of a domain's documentation."""
    return F.concat(F.lit(TRANSLATION_PROMPT_HEAD + domain + TRANSLATION_PROMPT_TAIL), question)


def question_prompt(
    document: Column, section: Column, title: Column, keywords: Column, category: Column,
    difficulty: Column, content: Column,
) -> Column:
    words = F.when(F.size(keywords) > 0, F.array_join(keywords, ", ")).otherwise("nenhuma")
    return F.concat(
        F.lit(QUESTION_PROMPT_HEAD + "Documento: "), document,
        F.lit("\nSeção: "), section,
        F.lit("\nTítulo da seção: "), title,
        F.lit("\nPalavras-chave sugeridas: "), words,
        F.lit("\nCategoria: "), category,
        F.lit("\nDificuldade: "), difficulty,
        F.lit("\n\nTrecho de referência:\n"), tx.strip(content),
        F.lit("\n\n" + QUESTION_PROMPT_TAIL),
    )


def judge_prompt(question: Column, ideal: Column, generated: Column) -> Column:
    return F.concat(
        F.lit(JUDGE_PROMPT_HEAD + "Pergunta: "), question,
        F.lit("\n\nResposta ideal:\n"), ideal,
        F.lit("\n\nResposta gerada:\n"), generated,
        F.lit("\n\n" + JUDGE_PROMPT_TAIL),
    )
