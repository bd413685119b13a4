"""Every registered query of the core library, with its DuckDB oracle."""

from __future__ import annotations

from spanloom.plans import files, remapping, repairs, spans

QUERIES = spans.QUERIES | remapping.QUERIES | repairs.QUERIES | files.QUERIES
ORACLES = spans.ORACLES | remapping.ORACLES | repairs.ORACLES | files.ORACLES
