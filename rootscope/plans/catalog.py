"""All registered queries and the SQL that they are held against."""

from __future__ import annotations

from . import incidents, oracles, registry, wider  # noqa: F401  wider and incidents register theirs

QUERIES = registry.QUERIES
FLAGSHIP = registry.FLAGSHIP
ORACLE_SQL = {k: v for k, v in oracles.build().items() if k in QUERIES}
