"""All queries and their SQL."""

from . import devices, identities, live, network, parts, priors, radio, reports, star, stateful, surfaces, texts, traffic  # noqa: F401  (their import registers the queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
