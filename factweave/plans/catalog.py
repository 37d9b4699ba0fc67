"""All queries over the fact operators, with their SQL."""

from __future__ import annotations

from factweave.plans import q_history, q_imports, q_merge, q_scalars, q_sets, q_snapshot, q_state, q_streaming, q_views  # noqa: F401  importing registers
from factweave.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
