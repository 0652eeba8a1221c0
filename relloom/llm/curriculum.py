"""Mixing sources to target weights along a curriculum that changes over the training.

Every source has a weight schedule, linear between knots over training time from 0 to 1.
Its integral up to a time is the share of the source's target that is taken by then. A
document's words hold a range of its source's words, in an order that a hash of its
identifier gives; inverting the integral at the start of that range gives the time at which
the document is due. A range sort by that time is the training order.

Running totals come from range-sorted partitions, of which only one sum each is added up, so
a source with a third of all rows spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.llm.common import settle
from relloom.operators.lookup import lookup_join
from relloom.operators.ordered import with_running

WORD = r"[^\x20\x09-\x0D]+"


class Schedule(NamedTuple):
    """Weights at increasing times from 0 to 1, linear in between."""

    times: tuple[float, ...]
    weights: tuple[float, ...]

    def check(self) -> None:
        t, w = self.times, self.weights
        if len(t) != len(w) or len(t) < 2 or t[0] != 0 or t[-1] != 1 or any(a >= b for a, b in zip(t, t[1:], strict=False)):
            raise ValueError("times must increase from 0 to 1, with a weight each")
        if min(w) < 0 or not self.total():
            raise ValueError("weights must not be negative, nor all zero")

    def pieces(self) -> list[tuple[float, float, float, float]]:
        """``time, weight, slope, integral before`` of each linear piece."""
        out, before = [], 0.0
        for a, b, v, w in zip(self.times, self.times[1:], self.weights, self.weights[1:], strict=False):
            out.append((float(a), float(v), (w - v) / (b - a), before))
            before += (v + w) / 2 * (b - a)
        return out

    def total(self) -> float:
        knots = zip(self.times, self.times[1:], self.weights, self.weights[1:], strict=False)
        return float(sum((v + w) / 2 * (b - a) for a, b, v, w in knots))

    def inverse(self, share: Column) -> Column:
        """The first time by which a share (0 to 1) of the whole integral is reached."""
        asked = share * F.lit(self.total())
        out = None
        for time, weight, slope, before in self.pieces():
            left = asked - F.lit(before)
            if slope:
                root = F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2 * slope) * left, F.lit(0.0)))
                at = F.lit(time) + (root - F.lit(weight)) / F.lit(slope)
            else:
                at = F.lit(time) + left / F.lit(weight) if weight else F.lit(time)
            out = at if out is None else F.when(left > 0, at).otherwise(out)
        return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


#: What the query mixes by: integrals of 5, 2 and 1; steady, rising and falling (fixed values).
SCHEDULES = (
    Schedule((0.0, 1.0), (5.0, 5.0)),
    Schedule((0.0, 0.5, 1.0), (1.0, 2.0, 3.0)),
    Schedule((0.0, 1.0), (2.0, 0.0)),
)


def _by_schedule(schedules: Sequence, number: Column, make) -> Column:
    """``make`` of the schedule that falls to a source, by its number."""
    turn = number % F.lit(len(schedules))
    out = make(schedules[-1])
    for k, schedule in enumerate(schedules[:-1]):
        out = F.when(turn == k, make(schedule)).otherwise(out)
    return out


def targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, share: float = 1.5, most: int = 2) -> DataFrame:
    """``key, source_size, before, number, target`` of every source of ``key, source_size``.

    Sources are numbered in the order of their keys and take the schedules in turn. They
    share ``share`` of all words by weight; a target stops at ``most`` times its source, and
    what is above is shared anew by weight until none is above. That fixed point is found at
    once: in the order of size to weight the sources that stop come first, and running sums
    tell where they end. Only sums over all sources reach the driver.
    """
    for schedule in schedules:
        schedule.check()
    numbered = with_running(
        sizes.withColumn("one", F.lit(1).cast("long")), [F.col("key").asc()], sums={"before": "source_size", "number": "one"}
    ).drop("one")
    weighed = numbered.withColumn("weight", _by_schedule(schedules, F.col("number"), lambda s: F.lit(s.total()))).withColumn(
        "bound", (F.lit(most) * F.col("source_size")).cast("double")
    ).withColumn("ratio", F.col("bound") / F.col("weight"))
    whole = weighed.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")
    ).first()
    asked = share * whole["size"]
    ranked = with_running(
        weighed, [F.col("ratio").asc(), F.col("number").asc()], sums={"bounds": "bound", "weights": "weight"}
    )
    level = (F.lit(asked) - F.col("bounds")) / (F.lit(whole["weight"]) - F.col("weights"))
    ranked = settle(ranked.withColumn("stops", level > F.col("ratio")), "targets")
    stopped = ranked.where("stops").agg(
        F.coalesce(F.sum("bound"), F.lit(0.0)).alias("bound"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")
    ).first()
    rest = whole["weight"] - stopped["weight"]
    each = (asked - stopped["bound"]) / rest if rest > 0 else 0.0
    target = F.when(F.col("stops"), F.col("bound")).otherwise(F.lit(each) * F.col("weight"))
    return ranked.select("key", "source_size", "before", "number", target.alias("target"))


def curriculum(
    docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, share: float = 1.5, most: int = 2, id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: what the mix takes of it, and when.

    Columns: ``doc_id, source, size, source_size, target, taken`` and ``copies``, an array
    of ``copy, words, at``: the words that a copy takes and its time from 0 to 1. All copies
    are whole, but for the last of a source, which is cut to reach the target. ``most`` is
    how often a document may be taken. A null text has size 0 and is not taken; a null
    source is a source of its own, after all others. Rows are ordered within their source by
    the md5 of their identifier, then by identifier and size; rows equal in these are
    interchangeable. An empty table gives no rows. Further columns are not read.
    """
    doc_id = F.col(f"`{id_col}`").cast("long")
    source = F.col(f"`{source_col}`").cast("string")
    # one text key whose order is that of the sources by code point, null last
    key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    size = F.regexp_count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    sized = settle(
        docs.select(
            doc_id.alias("doc_id"), source.alias("source"), key.alias("key"), size.alias("size"),
            F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))).alias("mix"), F.monotonically_increasing_id().alias("row"),
        ), "sized",
    )
    sources = targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")), schedules, share, most)
    sources = settle(sources, "sources").withColumnRenamed("key", "source_key")
    order = [F.col(c) for c in ("key", "mix", "doc_id", "size", "row")]
    run = with_running(sized.drop("source"), order, sums={"run": "size"})
    placed = lookup_join(run, "key", sources, "source_key", keys_from=sized)
    start = F.col("run") - F.col("before")
    wanted = F.floor("target").cast("long")
    copies = []
    for k in range(most):
        begin = F.lit(k) * F.col("source_size") + start
        words = F.least(F.greatest(wanted - begin, F.lit(0).cast("long")), F.col("size"))
        due = F.when(F.col("target") > 0, begin / F.col("target")).otherwise(F.lit(0.0))
        at = _by_schedule(schedules, F.col("number"), lambda s, due=due: s.inverse(F.least(due, F.lit(1.0))))
        copies.append(F.struct(F.lit(k).alias("copy"), words.alias("words"), at.alias("at")))
    whole = placed.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    return whole.select(
        "doc_id", F.when(F.col("key") != "1", F.substring("key", 2, 2**31 - 1)).alias("source"), "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]).alias("taken"), "copies",
    )


def training_order(mix: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by the time it is due; ties by source, document, copy."""
    rows = mix.select("doc_id", "source", F.explode("copies").alias("c")).select("doc_id", "source", "c.*")
    return rows.orderBy("at", "source", "doc_id", "copy")


def by_first_copy(mix: DataFrame) -> DataFrame:
    """One row per document, range-sorted by its first copy's time; those not taken come last."""
    at = F.get(F.col("copies"), F.lit(0))["at"]
    return mix.select("doc_id", "size", "source_size", "target", "taken", at.alias("first_at")).orderBy(
        F.col("first_at").asc_nulls_last(), "doc_id"
    )
