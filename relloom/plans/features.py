"""What synthesis produces: features with their lineage, and the catalog of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from relloom.entityset import Relationship
from relloom.functions.predicates import Predicate


@dataclass(frozen=True)
class Step:
    """One step of a lineage: ``kind`` is agg, row or flat; the input is ``column``.

    ``entity`` holds the input, ``column`` names where its values are stored.
    """

    kind: str
    function: str | None
    entity: str
    column: str
    predicate: Predicate | None = None


@dataclass(frozen=True, eq=False)
class Feature:
    entity: str
    name: str  # readable name, e.g. sum(orders.o_totalprice)
    column: str  # name of the DataFrame column
    dtype: str
    numeric: bool = False
    category: bool = False  # a category by configuration or by its function
    categorical_filter: bool = False
    ignore: bool = False
    key: bool = False
    interval: int | None = None
    path: tuple[Step, ...] = ()
    origin: str = ""  # entity.column that stores the values
    source: Feature | None = None
    edge: Relationship | None = None
    inverse: bool = False
    is_binary: Callable[[], bool] = field(default=lambda: False, repr=False)

    @property
    def binary(self) -> bool:
        """At most two distinct values; the data is looked at when this is asked."""
        return self.is_binary()

    @property
    def categorical(self) -> bool:
        return self.category or self.binary

    @property
    def kind(self) -> str:
        return self.path[-1].kind if self.path else "base"

    @property
    def function(self) -> str | None:
        return self.path[-1].function if self.path else None

    @property
    def predicate(self) -> Predicate | None:
        return self.path[-1].predicate if self.path else None

    @property
    def functions(self) -> frozenset[str]:
        """Aggregates on the lineage."""
        return frozenset(s.function for s in self.path if s.kind == "agg")

    @property
    def lineage(self) -> frozenset[str]:
        return frozenset(s.column for s in self.path)

    @property
    def entities(self) -> frozenset[str]:
        return frozenset(s.entity for s in self.path)

    @property
    def filters(self) -> list[Predicate]:
        return [s.predicate for s in self.path if s.predicate]


def column_name(name: str, taken: Iterable[str]) -> str:
    """Lower-case name of letters, digits and underscores, not among ``taken``."""
    base = re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")
    taken = set(taken)
    candidate, n = base, 2
    while candidate in taken:
        candidate, n = f"{base}_{n}", n + 1
    return candidate


CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("numeric", T.BooleanType()),
        T.StructField("categorical", T.BooleanType()),
        T.StructField("binary", T.BooleanType()),
        T.StructField("interval", T.IntegerType()),
        T.StructField(
            "path",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kind", T.StringType()),
                        T.StructField("function", T.StringType()),
                        T.StructField("entity", T.StringType()),
                        T.StructField("column", T.StringType()),
                        T.StructField("filter", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def catalog_frame(spark: SparkSession, features: Iterable[Feature]) -> DataFrame:
    """The features as a DataFrame, sorted by name."""
    rows = [
        (
            f.entity, f.name, f.column, f.dtype, f.numeric, f.categorical, f.binary, f.interval,
            [(s.kind, s.function, s.entity, s.column, s.predicate.label if s.predicate else None) for s in f.path],
        )
        for f in sorted(features, key=lambda f: f.name)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)
