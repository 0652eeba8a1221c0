"""Feature synthesis: stack aggregates, row functions and lookups along the keys.

``visits`` walks the key graph and says in which order which kind of feature is
made for which entity; ``synthesize`` makes the features, as descriptions only.
No data is read here except through the profile (category values, time range,
one-to-one edges); binary columns are looked for when a role is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

from relloom.entityset import EntitySet, Relationship
from relloom.functions.aggregates import AGGREGATES
from relloom.functions.predicates import Comparison, Predicate
from relloom.functions.rows import chosen_row_functions, is_date
from relloom.operators.intervals import interval_predicates
from relloom.plans.features import Feature, Step, column_name
from relloom.plans.rules import may_aggregate, may_filter, may_flatten, predictable_features

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def visits(
    es: EntitySet, entity: str, caller: str | None = None, path: tuple[str, ...] = ()
) -> Iterator[tuple[str, str, str | None]]:
    """``(kind, entity, caller)`` in working order: children, own features, parents.

    Lookups come before the parents, whose aggregates may use them, and again after,
    for what the parents have gained. An entity already on the path is not entered,
    so cycles end; edges are followed in order of declaration.
    """
    if entity in path:
        return
    path += (entity,)
    closed = (caller, entity)
    for edge in es.children(entity):
        if edge.child not in closed:
            yield from visits(es, edge.child, entity, path)
    for kind in ("agg", "row", "one_to_one", "flat"):
        yield kind, entity, caller
    for edge in es.parents(entity):
        if edge.parent not in closed:
            yield from visits(es, edge.parent, entity, path)
    yield "flat", entity, caller


def singular(name: str) -> str:
    """Singular of a table name by the common English endings."""
    lower = name.lower()
    if lower.endswith("ies") and len(name) > 4:
        return name[:-3] + "y"
    if lower.endswith(("sses", "shes", "ches", "xes", "zes")):
        return name[:-2]
    if lower.endswith("s") and not lower.endswith(("ss", "us", "is")):
        return name[:-1]
    return name


class Synthesis:
    def __init__(self, es: EntitySet) -> None:
        self.es = es
        self.features: dict[str, dict[str, Feature]] = {e: {} for e in es.entities}
        self._columns: dict[str, set[str]] = {e: set() for e in es.entities}
        for entity in es.entities:
            self._add_base(entity)

    def run(self, target: str) -> Synthesis:
        self.es.profile.prefetch()
        makers = {
            "agg": lambda entity, caller: self._aggregates(entity),
            "row": lambda entity, caller: self._row_functions(entity),
            "one_to_one": self._one_to_one,
            "flat": self._lookups,
        }
        for kind, entity, caller in visits(self.es, target):
            makers[kind](entity, caller)
        return self

    def of(self, entity: str) -> list[Feature]:
        return list(self.features[entity].values())

    def predictable(self, entity: str, label: str | None = None) -> list[Feature]:
        """Features that may predict, without those of the entity's ``excluded_predict_entities``."""
        return predictable_features(self.of(entity), self.es[entity].config.excluded_predict_entities, label)

    def _has(self, entity: str, name: str) -> bool:
        return name in self.features[entity]

    def _add(self, feature: Feature) -> None:
        self.features[feature.entity][feature.name] = feature
        self._columns[feature.entity].add(feature.column.lower())

    def _add_base(self, entity: str) -> None:
        table = self.es[entity]
        keys = set(self.es.key_columns(entity))
        for name, dtype in table.df.dtypes:
            given = table.config.feature_metadata.get(name, {})
            self._add(
                Feature(
                    entity,
                    name,
                    name,
                    dtype,
                    numeric=given.get("numeric", dtype.startswith(_NUMERIC) and name not in keys),
                    category=given.get("categorical", False),
                    categorical_filter=given.get("categorical_filter", False),
                    ignore=given.get("ignore", False),
                    key=name in keys,
                    origin=f"{entity}.{name}",
                    is_binary=lambda name=name: name in self.es.profile.binary(entity),
                )
            )

    def _derive(
        self, entity: str, name: str, dtype: str, source: Feature, step: Step, **extra: object
    ) -> None:
        if self._has(entity, name):
            return
        column = column_name(name, self._columns[entity])
        interval = source.interval
        path = source.path + (step,)
        if step.predicate is not None and step.predicate.interval is not None:
            interval = step.predicate.interval
        extra.setdefault("origin", f"{entity}.{column}")
        self._add(Feature(entity, name, column, dtype, interval=interval, path=path, source=source, **extra))

    # Aggregates of children

    def _aggregates(self, parent: str) -> None:
        config = self.es[parent].config
        for edge in self.es.children(parent):
            if edge.child in config.excluded_agg_entities or self.es.profile.one_to_one(edge):
                continue
            training = self._training_filter(edge.child)
            wanted = config.make_intervals.get(edge.child)
            for window in self._windows(edge.child, wanted) if wanted else []:
                self._aggregate_edge(edge, window & training if training else window)
            self._aggregate_edge(edge, training)

    def _training_filter(self, entity: str) -> Predicate | None:
        conditions = self.es[entity].config.train_filter
        if not conditions:
            return None
        return Predicate(tuple(self._comparison(self.features[entity][c], op, v) for c, op, v in conditions))

    @staticmethod
    def _comparison(feature: Feature, op: str, value: object) -> Comparison:
        return Comparison(feature.column, op, value, feature.origin, feature.ignore)

    def _windows(self, entity: str, wanted: dict) -> list[Predicate]:
        dates = [f for f in self.of(entity) if not f.path and not f.ignore and is_date(f.dtype)]
        if not dates:
            return []
        latest, earliest = self.es.profile.extent(entity, dates[0].column)
        n, days = wanted.get("n_intervals", 10), wanted.get("delta_days", 7)
        return interval_predicates(dates[0].column, latest, earliest, n, days, dates[0].origin)

    def _edge_name(self, edge: Relationship) -> str:
        """The child's name, or the foreign key's where the name would be ambiguous."""
        if edge.child == edge.parent:
            return edge.child_column if edge.child_column != edge.parent_column else edge.child
        return edge.child_column if self._twin(edge) else edge.child

    def _twin(self, edge: Relationship) -> bool:
        return sum(r.child == edge.child and r.parent == edge.parent for r in self.es.relationships) > 1

    def _aggregate_edge(self, edge: Relationship, predicate: Predicate | None) -> None:
        name = self._edge_name(edge)
        by_category = [
            Predicate((self._comparison(f, "=", value),))
            for f in self.of(edge.child)
            if may_filter(f, edge.parent)
            for value in self.es.profile.values(*f.origin.split(".", 1))
        ]
        for function in AGGREGATES.values():
            if function.counts_rows:
                key = self.features[edge.child][edge.child_column]
                filters = [predicate] + [c & predicate if predicate else c for c in by_category]
                for chosen in filters:
                    label = f"[{chosen.label}]" if chosen and chosen.label else ""
                    self._add_aggregate(edge, function.name, key, chosen, f"{name}{label}", "bigint")
                continue
            for feature in self.of(edge.child):
                if may_aggregate(function, feature, predicate, edge.parent, self.es.max_categorical_filter):
                    label = f"[{predicate.label}]" if predicate and predicate.label else ""
                    inside = f"{name}.{feature.name}{label}"
                    self._add_aggregate(edge, function.name, feature, predicate, inside, "double")

    def _add_aggregate(
        self, edge: Relationship, function: str, source: Feature, predicate: Predicate | None, inside: str, dtype: str
    ) -> None:
        step = Step("agg", function, source.entity, source.origin, predicate)
        self._derive(edge.parent, f"{function}({inside})", dtype, source, step, numeric=True, edge=edge)

    # Row functions

    def _row_functions(self, entity: str) -> None:
        table = self.es[entity]
        chosen = chosen_row_functions(table.config.included_row_functions, table.config.excluded_row_functions)
        for function in chosen:
            for f in self.of(entity):
                fits = f.column in table.text if function.accepts == "text" else is_date(f.dtype)
                if f.path or f.key or f.ignore or not fits:
                    continue
                step = Step("row", function.name, entity, f.origin)
                self._derive(
                    entity, f"{function.label}({f.name})", "int", f, step,
                    numeric=function.numeric, category=function.categorical,
                )

    # Lookups

    def _lookups(self, entity: str, caller: str | None) -> None:
        for edge in self.es.parents(entity):
            if edge.parent in (entity, caller):
                continue
            prefix = self._prefix(edge.child_column, edge.parent_column, edge.parent)
            if self._twin(edge):
                prefix = edge.child_column
            self._copy(edge.parent, entity, prefix, edge, inverse=False)

    def _one_to_one(self, entity: str, caller: str | None) -> None:
        for edge in self.es.children(entity):
            if edge.child in (entity, caller) or not self.es.profile.one_to_one(edge):
                continue
            prefix = self._prefix(edge.parent_column, edge.child_column, edge.child)
            self._copy(edge.child, entity, prefix, edge, inverse=True)

    @staticmethod
    def _prefix(own_column: str, other_column: str, other_entity: str) -> str:
        return other_column if own_column != other_column else singular(other_entity)

    def _copy(self, origin: str, holder: str, prefix: str, edge: Relationship, inverse: bool) -> None:
        for f in self.of(origin):
            if may_flatten(f, holder):
                step = Step("flat", None, origin, f.origin)
                self._derive(
                    holder, f"{prefix}.{f.name}", f.dtype, f, step,
                    numeric=f.numeric, category=f.category, is_binary=f.is_binary,
                    categorical_filter=f.categorical_filter, origin=f.origin, edge=edge, inverse=inverse,
                )


def synthesize(es: EntitySet, target: str) -> Synthesis:
    """All features of ``target`` and of the entities on the way."""
    return Synthesis(es).run(target)
