"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

The stages are in ``levelcast.llm.stages``.
"""

from __future__ import annotations

from levelcast.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: The stages' sketches, fingerprints, checksums and token ids are beyond SQL.
ORACLE_SQL = None
