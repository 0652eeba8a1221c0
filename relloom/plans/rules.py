"""Eligibility: which aggregates, filters and predictors a feature may take part in."""

from __future__ import annotations

from collections.abc import Iterable

from relloom.functions.aggregates import Aggregate
from relloom.functions.predicates import Predicate
from relloom.plans.features import Feature

# Longest lineage of an aggregate's input, most filters on a lineage.
MAX_INPUT_STEPS = 3
MAX_LINEAGE_FILTERS = 3


def may_aggregate(
    function: Aggregate, feature: Feature, predicate: Predicate | None, parent: str, max_filters: int
) -> bool:
    """Whether ``function(child.feature[predicate])`` is made for ``parent``."""
    if feature.ignore or not feature.numeric or len(feature.path) >= MAX_INPUT_STEPS:
        return False
    if feature.path and feature.path[-1].entity == parent:
        return False
    if function.not_over & feature.functions:
        return False
    if predicate is None:
        return True
    if feature.column in predicate.columns or len(feature.filters) >= MAX_LINEAGE_FILTERS:
        return False
    if feature.path:
        used = {title for p in feature.filters for title in p.visible_titles}
        titles = predicate.visible_titles
        if used & set(titles) or len(titles) >= max_filters:
            return False
    return True


def may_filter(feature: Feature, parent: str) -> bool:
    """Whether values of a child column may split the counts of ``parent``."""
    return feature.categorical_filter and parent not in feature.entities


def may_flatten(feature: Feature, holder: str) -> bool:
    """Whether a column of a related entity is copied to ``holder``."""
    if feature.key or feature.ignore:
        return False
    came_from_holder = bool(feature.path) and feature.kind == "flat" and feature.path[-1].entity == holder
    return not came_from_holder


def filtered_on(feature: Feature, label: str) -> bool:
    """Whether rows were chosen by a label (``entity.column``) anywhere on the lineage."""
    return any(label in p.visible_titles for p in feature.filters)


def predictable_features(
    features: Iterable[Feature], excluded_entities: Iterable[str] = (), label: str | None = None
) -> list[Feature]:
    """Features with a role whose lineage avoids some entities and filters on the label."""
    excluded = frozenset(excluded_entities)
    return [
        f
        for f in features
        if (f.numeric or f.categorical)
        and not f.ignore
        and not f.key
        and not excluded & f.entities
        and not (label and filtered_on(f, label))
    ]


def candidate_features(features: Iterable[Feature], target: Feature) -> list[Feature]:
    """Features that may predict ``target``: a role, no interval, no shared lineage.

    Columns with a single value are dropped afterwards, from the data.
    """
    return [
        f
        for f in features
        if f is not target
        and not f.ignore
        and not f.key
        and (f.numeric or f.categorical)
        and f.interval is None
        and not f.lineage & target.lineage
    ]
