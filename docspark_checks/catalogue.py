"""All registered queries."""

from docspark_checks import (  # noqa: F401
    chunk_queries,
    gold_queries,
    kb_queries,
    page_queries,
    search_queries,
    stat_queries,
)
from docspark_checks.registry import ORACLES, QUERIES, widen

__all__ = ["ORACLES", "QUERIES"]

# Columns that a twin computes with 32 bits; results have 64 throughout.
_NARROW = {
    "subchunk_numbering": ("block_no",),
    "long_document_records": ("block_no",),
    "fallback_chunks": ("block_no",),
    "software_blocks": ("block_no",),
    "whole_documents": ("block_no",),
    "html_links": ("link_no",),
    "html_table_grid": ("table_no",),
    "html_table_render": ("table_no",),
    "retrieval_metrics": ("top_k",),
    "variant_composite": ("ordem",),
    "model_composite": ("ordem",),
    "experiment_grid": ("top_k",),
    "metrics_from_log": ("retrieved_rank",),
    "result_log": ("input_tokens", "chunks_recuperados", "json_items", "retrieved_rank"),
}
for _name, _columns in _NARROW.items():
    ORACLES[_name] = widen(ORACLES[_name], _columns)
