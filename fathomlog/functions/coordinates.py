"""Where an event stands in its author's chain, read from its provenance.

Provenance is an array of hops: the first is the author's, each later one a receiver's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hop(provenance: str, k: int, field: str) -> Column:
    return F.get(F.col(provenance), F.lit(k))[field]


def with_coordinates(log: DataFrame, provenance: str = "provenance") -> DataFrame:
    """Adds origin_db, sealed_hash, origin_position and held_as_authored_by."""
    alone = F.size(provenance) == 1
    return log.withColumns(
        {
            "origin_db": _hop(provenance, 0, "database_id"),
            "sealed_hash": F.when(alone, F.col("event_hash")).otherwise(_hop(provenance, 1, "arrival_hash")),
            "origin_position": F.when(alone, F.col("sequence_number")).otherwise(_hop(provenance, 1, "origin_sequence_number")),
            "held_as_authored_by": F.when(alone, _hop(provenance, 0, "database_id")),
        }
    )


def not_received_from_own_identity(provenance: str = "provenance") -> Column:
    """False only for an event that came back to the database that wrote it."""
    p = F.col(provenance)
    same = _hop(provenance, 0, "database_id").eqNullSafe(F.element_at(p, -1)["database_id"])
    return ~F.coalesce((F.size(p) >= 2) & same, F.lit(False))


def is_locally_originated(identifier: str, provenance: str = "provenance") -> Column:
    return F.coalesce(_hop(provenance, 0, "identifier") == identifier, F.lit(False))


def is_held_as_authored(database_id: str, provenance: str = "provenance") -> Column:
    return F.coalesce((F.size(provenance) == 1) & (_hop(provenance, 0, "database_id") == database_id), F.lit(False))
