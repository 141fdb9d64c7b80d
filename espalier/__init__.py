"""Relational catalogues kept as large Spark tables.

Hierarchy queries, declared-schema ingest, distributed constraint checks,
keyed maintenance and trigram title search, all as DataFrame plans.
"""

from espalier.spec import (
    ABSENT,
    Check,
    Column,
    Domain,
    ForeignKey,
    TableSpec,
)

__all__ = ["ABSENT", "Check", "Column", "Domain", "ForeignKey", "TableSpec"]
