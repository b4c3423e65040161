"""All named queries.  Importing this module fills the registry."""

from bidlens.plans import (  # noqa: F401
    chunk_queries,
    evidence_queries,
    matching_queries,
    office_queries,
    quality_queries,
    requirement_queries,
    rule_queries,
    source_queries,
    text_queries,
)
from bidlens.plans.registry import ORACLES, QUERIES  # noqa: F401
