"""The registered queries, each with the SQL that must give the same rows."""

from relloom.workload import exploration, matrices, models, relational, sparse, stored, synthesized
from relloom.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "exploration", "matrices", "models", "relational", "sparse", "stored", "synthesized"]
