from __future__ import annotations

from heartwood.oracle import operations, reports
from heartwood.oracle.base import with_tables


def oracle_sql() -> dict[str, str]:
    return {key: with_tables(sql) for key, sql in (reports.ORACLES | operations.ORACLES).items()}
