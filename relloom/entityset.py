"""Entities with declared keys, their relationships, and the user's configuration."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.operators.profile import Profile


@dataclass(frozen=True)
class Relationship:
    """Foreign key: ``child.child_column`` refers to ``parent.parent_column``."""

    child: str
    child_column: str
    parent: str
    parent_column: str

    @property
    def label(self) -> str:
        return f"{self.child}.{self.child_column}->{self.parent}.{self.parent_column}"


@dataclass(frozen=True)
class EntityConfig:
    feature_metadata: Mapping[str, Mapping[str, bool]] = field(default_factory=dict)
    one_to_one: Mapping[str, bool] = field(default_factory=dict)
    excluded_agg_entities: tuple[str, ...] = ()
    excluded_predict_entities: tuple[str, ...] = ()
    included_row_functions: tuple[str, ...] | None = None
    excluded_row_functions: tuple[str, ...] = ()
    make_intervals: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    train_filter: tuple[tuple[str, str, Any], ...] = ()

    @classmethod
    def parse(cls, raw: Mapping[str, Any]) -> EntityConfig:
        preset = raw.get("one_to_one", raw.get("one-to-one", {}))
        if not isinstance(preset, Mapping):
            preset = dict.fromkeys(preset, True)
        included = raw.get("included_row_functions")
        return cls(
            feature_metadata=dict(raw.get("feature_metadata", {})),
            one_to_one=dict(preset),
            excluded_agg_entities=tuple(raw.get("excluded_agg_entities", ())),
            excluded_predict_entities=tuple(raw.get("excluded_predict_entities", ())),
            included_row_functions=None if included is None else tuple(included),
            excluded_row_functions=tuple(raw.get("excluded_row_functions", ())),
            make_intervals=dict(raw.get("make_intervals", {})),
            train_filter=tuple(tuple(f) for f in raw.get("train_filter") or ()),
        )


@dataclass(frozen=True)
class Entity:
    """One table. ``key`` may be missing for a leaf fact without a unique key."""

    name: str
    df: DataFrame
    key: str | None = None
    text: frozenset[str] = frozenset()
    config: EntityConfig = EntityConfig()


class EntitySet:
    def __init__(self, config: Mapping[str, Any] | None = None) -> None:
        config = config or {}
        self.max_categorical_filter = int(config.get("max_categorical_filter", 1))
        self._entity_configs = dict(config.get("entities", {}))
        self.entities: dict[str, Entity] = {}
        self.relationships: list[Relationship] = []
        self.profile = Profile(self)

    def add_entity(
        self, name: str, df: DataFrame, key: str | None = None, text: Iterable[str] = ()
    ) -> EntitySet:
        config = EntityConfig.parse(self._entity_configs.get(name, {}))
        self.entities[name] = Entity(name, df, key, frozenset(text), config)
        return self

    def add_relationship(
        self, child: str, child_column: str, parent: str, parent_column: str | None = None
    ) -> EntitySet:
        parent_column = parent_column or self.entities[parent].key
        if parent_column is None:
            raise ValueError(f"{parent} has no key to refer to")
        for entity, column in ((child, child_column), (parent, parent_column)):
            if column not in self.entities[entity].df.columns:
                raise ValueError(f"{entity} has no column {column}")
        self.relationships.append(Relationship(child, child_column, parent, parent_column))
        return self

    def __getitem__(self, name: str) -> Entity:
        return self.entities[name]

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.entities.values())).df.sparkSession

    def children(self, name: str) -> list[Relationship]:
        """Foreign keys that point at an entity, in order of declaration."""
        return [r for r in self.relationships if r.parent == name]

    def parents(self, name: str) -> list[Relationship]:
        return [r for r in self.relationships if r.child == name]

    def related(self, name: str) -> list[str]:
        names = [r.child for r in self.children(name)] + [r.parent for r in self.parents(name)]
        return list(dict.fromkeys(names))

    def key_columns(self, name: str) -> list[str]:
        """Primary key, foreign keys, and columns other entities refer to."""
        key = self.entities[name].key
        columns = [key] if key else []
        columns += [r.child_column for r in self.parents(name)]
        columns += [r.parent_column for r in self.children(name)]
        return list(dict.fromkeys(columns))

    def row_counts(self) -> DataFrame:
        """One row per entity: ``entity, num_rows``."""
        counts = [
            e.df.agg(F.count(F.lit(1)).alias("num_rows")).select(F.lit(n).alias("entity"), "num_rows")
            for n, e in self.entities.items()
        ]
        return reduce(DataFrame.unionByName, counts)

    def relationship_stats(self) -> DataFrame:
        """Per foreign key: referenced parents, child rows, largest and mean fan-out."""
        edges = []
        for r in self.relationships:
            fan = (
                self[r.child].df.where(F.col(r.child_column).isNotNull())
                .groupBy(r.child_column)
                .agg(F.count(F.lit(1)).alias("n"))
            )
            edges.append(
                fan.agg(
                    F.count(F.lit(1)).alias("referenced_parents"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
                    F.max("n").alias("max_children"),
                    F.avg("n").alias("mean_children"),
                ).select(F.lit(r.label).alias("edge"), "*")
            )
        return reduce(DataFrame.unionByName, edges)

    def key_problems(self) -> DataFrame:
        """Per declared key, how many keys repeat or are NULL; per foreign key, orphans."""
        checks = []
        for name, entity in self.entities.items():
            if entity.key is None:
                continue
            bad = entity.df.groupBy(entity.key).agg(F.count(F.lit(1)).alias("n"))
            bad = bad.where((F.col("n") > 1) | F.col(entity.key).isNull())
            checks.append((f"{name}.{entity.key}", "key", bad))
        for r in self.relationships:
            used = self[r.child].df.where(F.col(r.child_column).isNotNull())
            used = used.select(F.col(r.child_column).alias("k")).distinct()
            known = self[r.parent].df.select(F.col(r.parent_column).alias("k"))
            checks.append((r.label, "foreign key", used.join(known, "k", "left_anti")))
        rows = [
            bad.agg(F.count(F.lit(1)).alias("problems")).select(
                F.lit(label).alias("constraint"), F.lit(kind).alias("kind"), "problems"
            )
            for label, kind, bad in checks
        ]
        return reduce(DataFrame.unionByName, rows)
