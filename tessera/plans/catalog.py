"""Every query of the library by name, with its SQL where SQL can say it."""

from __future__ import annotations

from . import interchange, relational, textual

FLAGSHIP = "mock_study"


def queries() -> dict:
    return relational.QUERIES | textual.QUERIES | interchange.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.ORACLE_SQL | textual.ORACLE_SQL | interchange.ORACLE_SQL
