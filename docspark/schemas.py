"""Column names and types of the stored tables (fixed values)."""

from __future__ import annotations

DOCUMENTS = (
    "source_path string, nome_software string, nome_arquivo string, arquivo_hash string, "
    "ingestao_em string, block_no int"
)
CHUNKS = (
    "source_path string, chunk_ordem int, subchunk_ordem int, subchunk_total int, "
    "hierarquia string, titulo string, conteudo_texto string, conteudo_hash string, "
    "ingestao_em string, block_no int"
)
GOLD = (
    "id string, pergunta string, resposta_ideal string, source_path string, "
    "titulo_documento string, secao string, palavras_chave array<string>, categoria string, "
    "dificuldade string, ordem int"
)
LOG = (
    "id string, pergunta string, refraseamento string, variacao_retrieval string, "
    "variacao_descricao string, query_translation string, resposta_ideal string, "
    "source_path_ground_truth string, titulo_documento string, secao string, categoria string, "
    "dificuldade string, modelo string, resposta string, tempo_resposta_s double, "
    "input_tokens bigint, output_tokens bigint, tokens bigint, top_k int, translate_query boolean, "
    "chunks_recuperados int, chunks_recuperados_json string, source_paths_chunks string, "
    "similaridades_chunks string, similaridade_media_chunks double, retrieved_rank int, "
    "retrieval_hit boolean, hit_rate_at_k double, recall_at_k double, precision_at_k double, "
    "mrr double, context_truncated boolean, contexto string, generation_metadata string, "
    "answer_length int, question_length int"
)
LOG_COLUMNS = tuple(part.strip().split(" ")[0] for part in LOG.split(","))

# Metric names of the evaluation.
RETRIEVAL_METRICS = (
    "hit_rate_at_k", "recall_at_k", "precision_at_k", "mrr", "similaridade_media_chunks",
)
CUTOFF_METRICS = (
    "hit_rate_at_1", "hit_rate_at_3", "hit_rate_at_4", "recall_at_k", "precision_at_k", "mrr",
    "similaridade_media_chunks",
)
JUDGE_TOPICS = (
    "groundedness", "corretude", "completude", "clareza", "precisao_tecnica", "alucinacao",
)
GENERATION_METRICS = tuple(f"{t}_score" for t in JUDGE_TOPICS)
NUMERIC_METRICS = (
    "tempo_resposta_s", "input_tokens", "output_tokens", "tokens", "answer_length",
    "question_length", "chunks_recuperados", "similaridade_media_chunks", "retrieved_rank",
    "hit_rate_at_1", "hit_rate_at_3", "hit_rate_at_4", "recall_at_k", "precision_at_k", "mrr",
    *GENERATION_METRICS, "overall_retrieval_score", "overall_generation_score", "overall_score",
)
