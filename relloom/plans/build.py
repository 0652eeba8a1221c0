"""From feature descriptions to DataFrames.

Only what the asked features need is computed. The features of an entity are put in
levels by how many joins or aggregates lie below them; a frame ``(entity, level)``
holds the needed features up to that level and extends the frame below it. Each edge
of a frame costs one ``groupBy`` or one join for all features that use it, and a
frame used more than once is written to the shared folder, not computed again.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.functions.rows import ROW_FUNCTIONS
from relloom.operators.aggregate import AggSpec, aggregate
from relloom.operators.lookup import SPREAD, attach, lookup_join, with_spread
from relloom.plans.features import Feature
from relloom.plans.synthesis import Synthesis
from relloom.runtime import broadcast_limit, materialize, plan_bytes

# A parent table up to this many broadcast limits is worth writing to learn the size
# of its frame.
WRITTEN_PARENT_FACTOR = 16


class _Build:
    def __init__(self, synthesis: Synthesis, wanted: Iterable[Feature]) -> None:
        self.es = synthesis.es
        self._by_column = {
            entity: {f.column: f for f in features.values()} for entity, features in synthesis.features.items()
        }
        self._rank = {id(f): n for e in synthesis.features.values() for n, f in enumerate(e.values())}
        self._levels: dict[int, int] = {}
        self._needed: dict[str, dict[str, Feature]] = defaultdict(dict)
        self._read: dict[str, set[str]] = defaultdict(set)
        self._unique: dict[tuple[str, str], bool] = {}
        self._uses: Counter = Counter()
        self._asked: set[tuple[str, int]] = set()
        self._frames: dict[tuple[str, int], DataFrame] = {}
        for feature in wanted:
            self._need(feature)

    def _inputs(self, feature: Feature) -> list[Feature]:
        """The features an aggregate, lookup or row function reads."""
        inputs = [feature.source] if feature.source else []
        if feature.predicate:
            inputs += [self._by_column[feature.source.entity][c] for c in sorted(feature.predicate.columns)]
        return inputs

    def _need(self, feature: Feature) -> None:
        if feature.column in self._needed[feature.entity]:
            return
        self._needed[feature.entity][feature.column] = feature
        for source in self._inputs(feature):
            self._read[source.entity].add(source.column)
            self._need(source)

    def level(self, feature: Feature) -> int:
        if id(feature) not in self._levels:
            level = self._least_level(feature)
            if feature.kind == "flat" and not feature.inverse and feature.column not in self._read[feature.entity]:
                # what nothing else reads waits for the last lookup along its edge
                last = max(self._least_level(f) for f in self._needed[feature.entity].values()
                           if f.kind == "flat" and not f.inverse and f.edge == feature.edge)
                # a repeated parent repeats rows, which those who read the frame must see
                if last > level and self._is_unique(feature.edge.parent, feature.edge.parent_column):
                    level = last
            self._levels[id(feature)] = level
        return self._levels[id(feature)]

    def _least_level(self, feature: Feature) -> int:
        below = max((self.level(f) for f in self._inputs(feature)), default=0)
        return below + (feature.kind in ("agg", "flat"))

    def _is_unique(self, entity: str, column: str) -> bool:
        """Whether no value of a parent's key repeats; looked up once."""
        if (entity, column) not in self._unique:
            keys = self.es[entity].df.where(F.col(f"`{column}`").isNotNull()).groupBy(f"`{column}`")
            self._unique[(entity, column)] = keys.count().where("count > 1").isEmpty()
        return self._unique[(entity, column)]

    def _held(self, entity: str, level: int, above: int = -1) -> list[Feature]:
        """Needed features of an entity with ``above < level of feature <= level``."""
        held = [f for f in self._needed[entity].values() if above < self.level(f) <= level]
        return sorted(held, key=lambda f: self._rank[id(f)])

    def _start(self, entity: str, level: int) -> int:
        """The asked-for frame that this one extends, 0 for the table itself."""
        return max((lv for e, lv in self._asked if e == entity and lv < level), default=0)

    def _groups(self, entity: str, level: int) -> dict[tuple, list[Feature]]:
        """What a frame adds to the one it extends, by edge: aggregates, then lookups."""
        groups = defaultdict(list)
        for f in self._held(entity, level, self._start(entity, level)):
            if f.kind in ("agg", "flat"):
                groups[(f.kind, f.edge, f.inverse)].append(f)
        return dict(sorted(groups.items(), key=lambda item: (item[0][0], not item[0][2])))

    def _source(self, group: tuple, features: list[Feature]) -> tuple[str, int]:
        kind, edge, inverse = group
        entity = edge.child if kind == "agg" or inverse else edge.parent
        below = max(self.level(i) for f in features for i in self._inputs(f))
        # The highest level at or below that really adds something names the frame.
        return entity, max((self.level(f) for f in self._held(entity, below)), default=0)

    def ask(self, entity: str, level: int) -> None:
        """Find all frames on the way to one, then how often each is used."""
        self._asked = {(entity, level)}
        while True:
            sources = {
                self._source(group, features)
                for frame in self._asked
                for group, features in self._groups(*frame).items()
            }
            if sources <= self._asked:
                break
            self._asked |= sources
        self._count_uses(entity, level)

    def _count_uses(self, entity: str, level: int) -> None:
        self._uses[(entity, level)] += 1
        if level == 0 or self._uses[(entity, level)] > 1:
            return
        self._count_uses(entity, self._start(entity, level))
        for group, features in self._groups(entity, level).items():
            self._count_uses(*self._source(group, features))

    def frame(self, entity: str, level: int) -> DataFrame:
        if (entity, level) not in self._frames:
            df = self._table(entity) if level == 0 else self._extend(entity, level)
            if level > 0 and self._uses[(entity, level)] > 1:
                df = materialize(df, entity)
            self._frames[(entity, level)] = df
        return self._frames[(entity, level)]

    def _table(self, entity: str) -> DataFrame:
        """Keys, needed columns and row features."""
        held = self._held(entity, 0)
        columns = dict.fromkeys(self.es.key_columns(entity) + [f.column for f in held if f.kind == "base"])
        rows = [
            ROW_FUNCTIONS[f.function].build(F.col(f"`{f.source.column}`")).alias(f.column)
            for f in held
            if f.kind == "row"
        ]
        table, spread = self.es[entity].df, []
        if self.es[entity].key is None and self.es.parents(entity):
            table, spread = with_spread(table), [SPREAD]
        return table.select(*[F.col(f"`{c}`") for c in columns], *rows, *spread)

    def _lookup_source(self, entity: str, level: int) -> DataFrame:
        """A parent frame to look up from.

        Computed features hide its size from Catalyst, so the frame of a table that
        may fit a broadcast is written: then its size is known.
        """
        df = self.frame(entity, level)
        small = WRITTEN_PARENT_FACTOR * broadcast_limit(df.sparkSession)
        if level > 0 and self._uses[(entity, level)] == 1 and plan_bytes(self.es[entity].df) <= small:
            self._frames[(entity, level)] = materialize(df, entity)
        return self._frames[(entity, level)]

    def _extend(self, entity: str, level: int) -> DataFrame:
        df = self.frame(entity, self._start(entity, level))
        for group, features in self._groups(entity, level).items():
            kind, edge, inverse = group
            source = self._source(group, features)
            if kind == "agg":
                specs = [AggSpec(f.column, f.function, f.source.column, f.predicate) for f in features]
                per_key = aggregate(self.frame(*source), edge.child_column, specs, self.es[edge.child].df)
                df = attach(df, edge.parent_column, per_key, edge.child_column)
                continue
            key = edge.child_column if inverse else edge.parent_column
            other = self.frame(*source) if inverse else self._lookup_source(*source)
            right = other.select(
                F.col(f"`{key}`").alias("_key"), *[F.col(f"`{f.source.column}`").alias(f.column) for f in features]
            )
            if inverse:
                df = attach(df, edge.parent_column, right, "_key")
            else:
                df = lookup_join(df, edge.child_column, right, "_key", keys_from=self.es[entity].df)
        return df


def feature_matrix(
    synthesis: Synthesis, target: str, features: Iterable[Feature] | None = None
) -> DataFrame:
    """Key columns of ``target`` plus one column per feature (all usable ones by default)."""
    keys = synthesis.es.key_columns(target)
    if features is None:
        features = [f for f in synthesis.of(target) if not f.key and not f.ignore]
    features = list(features)
    build = _Build(synthesis, features)
    level = max((build.level(f) for f in features), default=0)
    build.ask(target, level)
    key = synthesis.es[target].key
    names = dict.fromkeys(([key] if key else keys) + [f.column for f in features])
    return build.frame(target, level).select(*[F.col(f"`{c}`") for c in names])
