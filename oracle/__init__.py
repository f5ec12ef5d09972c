"""Independent SQL for every catalog query, run by another engine on the same tables and compared value by value."""

from oracle.queries import ORACLES

__all__ = ["ORACLES"]
