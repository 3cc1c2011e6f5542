"""All queries of the engine's own operators."""

from heronlake.plans import activity, corpus, social, stored, web
from heronlake.plans.registry import CASES, CASES_SQL, ORACLE, QUERIES

__all__ = ["CASES", "CASES_SQL", "ORACLE", "QUERIES", "activity", "corpus", "social", "stored", "web"]
