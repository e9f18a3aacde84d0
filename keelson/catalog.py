"""Registry of the integrity-analysis queries: name -> DataFrame builder, name -> DuckDB SQL."""

from __future__ import annotations

from .queries import integrity
from .queries import inputs, program, stores  # noqa: F401  (they register their queries)

FLAGSHIP = "detect_cascade"
QUERIES = dict(integrity.QUERIES)
ORACLE = dict(integrity.ORACLE)
