"""quire: corpus preparation, vector retrieval and support analytics on PySpark.

Every operator is a function from DataFrames/Columns to DataFrames/Columns; none
triggers an action except the explicit writers in ``quire.sources.store`` and
``quire.streaming``. The main entry points are re-exported here (lazily)::

    from quire import clean_text, reflow_paragraphs, chunk_text, embed_texts, search_topk
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_EXPORTS = {
    # text
    "clean_text": "quire.functions.text",
    "reflow_paragraphs": "quire.functions.text",
    "strip_text": "quire.functions.text",
    # chunking
    "chunk_text": "quire.operators.chunking",
    "chunk_all_strategies": "quire.operators.chunking",
    "validate_chunk_params": "quire.operators.chunking",
    # embedding
    "embed_texts": "quire.operators.embedding",
    "embed_query": "quire.operators.embedding",
    "HashingProvider": "quire.operators.embedding",
    # retrieval
    "search_topk": "quire.operators.retrieval",
    "search_batch": "quire.operators.retrieval",
    "search_approx": "quire.operators.retrieval",
    "rank_results": "quire.operators.retrieval",
    "diagnose_empty": "quire.operators.retrieval",
    # store
    "replace_chunks": "quire.sources.store",
    "upsert_chunks": "quire.sources.store",
    "read_chunks": "quire.sources.store",
    # support
    "run_select": "quire.operators.support",
    "ticket_lookup": "quire.operators.support",
    "derive_urgency": "quire.operators.support",
    # flows
    "index_documents": "quire.plans.indexing",
    "support_flow": "quire.plans.support_flow",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module 'quire' has no attribute {name!r}")
