"""relloom: relational feature synthesis and modelling on Spark DataFrames."""

from relloom.entityset import Entity, EntitySet, Relationship
from relloom.plans.build import feature_matrix
from relloom.plans.synthesis import synthesize

__all__ = ["Entity", "EntitySet", "Relationship", "feature_matrix", "synthesize"]
