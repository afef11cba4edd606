"""Registered queries: one per operator of the inventory, each with its oracle.

Importing this module imports every query module, which fills
``quire.plans.registry.QUERIES``.
"""

from __future__ import annotations

from quire.plans.registry import QUERIES, register, round_doubles  # noqa: F401
from quire.plans import (  # noqa: E402,F401
    q_chunking,
    q_governance,
    q_index,
    q_retrieval,
    q_routing,
    q_sources,
    q_sql,
    q_streams,
    q_support,
    q_text,
)
