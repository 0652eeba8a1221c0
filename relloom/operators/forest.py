"""Forests of many parameter points, grown together.

Spark ML takes a row of jobs for each level of each forest and shuffles all bins of every node,
however few rows it has. Here the forests of a round of a search share their jobs. Rows are
binned per data set (a cluster of a fold) and packed in blocks. The trees of a data set of one
block are dealt out to tasks that grow them whole; the trees of larger data sets grow level by
level, from counts that are added up over the blocks.

Trees are those of Spark ML: Poisson(1) copies of each row, Gini impurity, features drawn anew for
each node, sibling leaves of the same class merged, and shares of the classes as votes. All draws
are hashes of row, tree and node, so they depend on no order and on no number of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.runtime import map_in_arrow, materialize

#: Bins of a feature; features of more values are cut at so many quantiles.
BINS = 32
#: Bytes of a block of binned rows.
BLOCK_BYTES = 16 << 20
#: Trees of a piece of work; each piece gives a line per row to score.
PIECE = 32
#: Rows times trees that a task grows at a time.
STEP = 1 << 17
#: The least gain of a split, as a share of a node's weight; below it is rounding.
LEAST_GAIN = 1e-9
# Poisson(1): the chance of at most 0, 1, 2, ... copies of a row.
COPIES = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])

#: What trees say of a row: the sum of their shares of class 1, and how many of them had rows to learn from.
VOTES = "try int, row long, label double, votes double, trees long"


class Forest(NamedTuple):
    """Trees ``first`` to ``last`` (not included) of a try, on one data set."""

    number: int
    data: int
    first: int
    last: int
    depth: int
    per_node: int
    places: list[int]
    weights: list[float]
    seed: int


FOREST = "number int, data int, first int, last int, depth int, per_node int, places array<int>, weights array<double>, seed long"


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_keys(forest: Forest, first: int, last: int) -> np.ndarray:
    return mixed(mixed(np.arange(first, last, dtype=np.uint64)) ^ np.uint64(forest.seed % (1 << 64)))


def copies(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each tree sees each row."""
    drawn = mixed(mixed(ids)[None, :] ^ keys[:, None]) >> np.uint64(11)
    return np.searchsorted(COPIES, drawn * 2.0**-53, side="right")


def chosen(keys: np.ndarray, width: int, per_node: int) -> np.ndarray:
    """Which features each node may be split by."""
    if per_node >= width:
        return np.ones((len(keys), width), bool)
    drawn = mixed(mixed(keys)[:, None] + np.arange(1, width + 1, dtype=np.uint64))
    return drawn <= np.partition(drawn, per_node - 1, axis=1)[:, per_node - 1 : per_node]


def best_cuts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, last bin on the left and left weights of the best cut of each node; ``counts`` is classes x nodes x bins."""
    left = counts.cumsum(2)
    total, left = left[:, :, -1:], left[:, :, :-1]
    right = total - left
    on_left, on_right = left.sum(0), right.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left * left).sum(0) / on_left + (right * right).sum(0) / on_right
    score[(on_left <= 0) | (on_right <= 0)] = -np.inf
    cut = score.argmax(1)
    each = np.arange(counts.shape[1])
    total = total[:, :, 0]
    weight = total.sum(0)
    gain = score[each, cut] - (total * total).sum(0) / np.maximum(weight, 1e-300)
    return np.where(gain > LEAST_GAIN * weight, gain, 0.0), cut, left[:, each, cut].T


class Trees:
    """Trees that grow a level at a time; nodes are numbered, children of a node side by side."""

    def __init__(self, keys: np.ndarray, totals: np.ndarray, depth: int) -> None:
        count = len(keys)
        self.feature, self.cut = np.full(count, -1, np.int32), np.zeros(count, np.int32)
        self.left, self.stats = np.zeros(count, np.int32), totals
        self.depth, self.levels = depth, []
        self._open(np.arange(count), keys)

    def _open(self, nodes: np.ndarray, keys: np.ndarray) -> None:
        """The nodes that may still be split: those of several classes above the last level."""
        mixed_up = (self.stats[nodes] > 0).sum(1) > 1
        if len(self.levels) >= self.depth:
            mixed_up[:] = False
        self.active, self.keys = nodes[mixed_up], keys[mixed_up]

    def split(self, gain: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Split the active nodes that gain; gives each active node's place among those split, or -1."""
        gains = gain > 0
        nodes, count = self.active[gains], len(self.feature)
        self.feature[nodes], self.cut[nodes] = feature[gains], cut[gains]
        self.left[nodes] = count + 2 * np.arange(len(nodes))
        stats = np.stack([left[gains], self.stats[nodes] - left[gains]], 1).reshape(-1, self.stats.shape[1])
        self.feature = np.concatenate([self.feature, np.full(len(stats), -1, np.int32)])
        self.cut, self.left = (np.concatenate([x, np.zeros(len(stats), np.int32)]) for x in (self.cut, self.left))
        self.stats = np.concatenate([self.stats, stats])
        keys = np.repeat(self.keys[gains], 2)
        keys[1::2] ^= np.uint64(0xD6E8FEB86659FD93)
        self.levels.append(nodes)
        self._open(count + np.arange(len(stats)), mixed(keys))
        return np.where(gains, np.cumsum(gains) - 1, -1)

    def merged(self) -> Trees:
        """Sibling leaves of the same class are one leaf, as in Spark ML's trees."""
        likely = self.stats.argmax(1)
        for nodes in reversed(self.levels):
            a = self.left[nodes]
            same = (self.feature[a] < 0) & (self.feature[a + 1] < 0) & (likely[a] == likely[a + 1])
            self.feature[nodes[same]] = -1
        return self

    def places(self, bins: np.ndarray, nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The leaves that rows reach from nodes."""
        found, live = nodes.copy(), np.arange(len(nodes))
        while len(live):
            at = found[live]
            inner = self.feature[at] >= 0
            live, at = live[inner], at[inner]
            found[live] = self.left[at] + (bins[self.feature[at], rows[live]] > self.cut[at])
        return found

    def votes(self, bins: np.ndarray, trees: int) -> tuple[np.ndarray, int]:
        """The sum over trees of the share of class 1, for each row; the number of trees with rows."""
        weight = self.stats.sum(1)
        shares = self.stats[:, 1] / np.where(weight > 0, weight, 1.0)
        rows, out = bins.shape[1], np.zeros(bins.shape[1])
        step = max(1, STEP // max(1, rows))
        for first in range(0, trees, step):
            roots = np.arange(first, min(trees, first + step))
            at = self.places(bins, np.repeat(roots, rows), np.tile(np.arange(rows), len(roots)))
            out += shares[at].reshape(len(roots), rows).sum(0)
        return out, int((weight[:trees] > 0).sum())


class Samples:
    """The copies of rows that the active nodes of some trees hold."""

    def __init__(self, ids: np.ndarray, classes: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> None:
        drawn = copies(ids, keys)
        self.slot, self.row = np.nonzero(drawn)
        self.cls = classes[self.row]
        self.weight = drawn[self.slot, self.row] * weights[self.cls]
        self.classes = len(weights)

    def totals(self, nodes: int) -> np.ndarray:
        """Weights by node and class."""
        return np.bincount(self.slot * self.classes + self.cls, self.weight, nodes * self.classes).reshape(nodes, self.classes)

    def keep(self, slot: np.ndarray) -> None:
        """New places of the samples; those below 0 are done with."""
        kept = slot >= 0
        self.slot, self.row, self.cls, self.weight = slot[kept], self.row[kept], self.cls[kept], self.weight[kept]

    def counts(self, bins: np.ndarray, size: int, picked: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Weights by class, node and bin, of the nodes that were ``picked``, by one feature's ``bins``.

        Of two bins the second one is counted, and the rest of a node's ``totals`` is the first.
        """
        nodes = np.flatnonzero(picked)
        part = bins[self.row]
        if size == 2:
            here, shape = np.flatnonzero(part.view(bool)), (self.classes, len(picked))
            found = np.bincount(self.cls[here] * len(picked) + self.slot[here], self.weight[here], shape[0] * shape[1])
            found = found.reshape(shape)[:, nodes]
            return np.stack([totals[nodes].T - found, found], 2)
        slot, cls, weight, shape = self.slot, self.cls, self.weight, (self.classes, len(nodes), size)
        if len(nodes) < len(picked):
            here = np.flatnonzero(picked[slot])
            slot, cls, weight, part = (np.cumsum(picked) - 1)[slot[here]], cls[here], weight[here], part[here]
        return np.bincount((cls * len(nodes) + slot) * size + part, weight, shape[0] * shape[1] * size).reshape(shape)


class Best:
    """The best split of each node so far."""

    def __init__(self, nodes: int, classes: int) -> None:
        self.gain, self.left = np.zeros(nodes), np.zeros((nodes, classes))
        self.feature, self.cut = np.full(nodes, -1), np.zeros(nodes, np.int64)

    def see(self, feature: int, nodes: np.ndarray, counts: np.ndarray) -> None:
        gain, cut, left = best_cuts(counts)
        better = gain > self.gain[nodes]
        at = nodes[better]
        self.gain[at], self.feature[at], self.cut[at], self.left[at] = gain[better], feature, cut[better], left[better]


def grow(bins: np.ndarray, sizes: Sequence[int], ids: np.ndarray, classes: np.ndarray, forest: Forest, first: int, last: int) -> Trees:
    """Whole trees of a data set that is one block."""
    keys, weights = tree_keys(forest, first, last), np.array(forest.weights)
    held = Samples(ids, classes, keys, weights)
    trees = Trees(keys, held.totals(last - first), forest.depth)
    place = np.full(len(trees.feature), -1)
    place[trees.active] = np.arange(len(trees.active))
    held.keep(place[held.slot])
    while len(trees.active):
        best, picked = Best(len(trees.active), len(weights)), chosen(trees.keys, len(bins), forest.per_node)
        totals = trees.stats[trees.active]
        for feature, size in enumerate(sizes):
            nodes = np.flatnonzero(picked[:, feature])
            if size > 1 and len(nodes):
                best.see(feature, nodes, held.counts(bins[feature], size, picked[:, feature], totals))
        before = len(trees.feature)
        split = trees.split(best.gain, best.feature, best.cut, best.left)
        place = np.full(len(trees.feature) - before, -1)
        place[trees.active - before] = np.arange(len(trees.active))
        held.keep(np.where(split[held.slot] >= 0, held.slot, -1))
        right = bins[best.feature[held.slot], held.row] > best.cut[held.slot]
        held.keep(place[2 * split[held.slot] + right])
    return trees.merged()


# ---- binned rows ---------------------------------------------------------------------------


def cut_points(rows: DataFrame) -> dict[int, list[list[float]]]:
    """For each data set the values of each feature at which it may be cut; rows at most that value go left.

    Every value but the greatest if there are at most ``BINS``, else quantiles.
    """
    values = rows.select("data", F.posexplode(vector_to_array("_features")).alias("place", "value"))
    groups = ["data", "place"]
    found = values.groupBy(*groups).agg(
        F.percentile_approx("value", [n / BINS for n in range(1, BINS)], F.lit(10000)).alias("cuts"),
        F.max("value").alias("most"), F.approx_count_distinct("value", 0.02).alias("about"),
    )
    # near the limit the count decides, and not its estimate
    few = F.broadcast(found.where(F.col("about") <= 2 * BINS).select(*groups))
    distinct = values.join(few, groups, "left_semi").groupBy(*groups, "value").agg(F.lit(1))
    listed = distinct.groupBy(*groups).agg(F.collect_list("value").alias("all")).where(F.size("all") <= BINS)
    out: dict[int, list[list[float]]] = {}
    for r in found.join(listed, groups, "left").orderBy(*groups).collect():
        known = r.cuts if r.all is None else r.all
        out.setdefault(r.data, []).append(sorted({v for v in known if v < r.most}))
    return out


def pack(rows: DataFrame, cuts: Mapping[int, Sequence[Sequence[float]]]) -> DataFrame:
    """Blocks of rows: ``data, test, n, bins, ids, labels``; a byte per feature and row, feature by feature."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def packed(key: tuple[int, bool]) -> pa.RecordBatch:
            parts = held.pop(key)
            bins, ids, labels = (np.concatenate([p[k] for p in parts], axis=-1) for k in range(3))
            columns = [key[0], key[1], len(ids), np.ascontiguousarray(bins).tobytes(), ids.tobytes(), labels.tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([c], t) for c, t in zip(columns, BLOCK_TYPES, strict=True)], names=["data", "test", "n", "bins", "ids", "labels"]
            )

        for batch in batches:
            data, test = (batch[c].to_numpy(zero_copy_only=False) for c in ("data", "test"))
            ids, labels = batch["_row"].to_numpy().astype(np.int64), batch["_label"].to_numpy(zero_copy_only=False).astype(float)
            width = len(batch["_values"].flatten()) // max(1, batch.num_rows)
            values = batch["_values"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for number in np.unique(data):
                known = cuts.get(int(number))
                most = max(1, BLOCK_BYTES // max(1, width))
                for kind in (False, True):
                    mine = np.flatnonzero((data == number) & (test == kind))
                    for first in range(0, len(mine), most):
                        at = mine[first : first + most]
                        # a test row of a cluster without rows to learn from needs no bins
                        bins = np.zeros((width, len(at)), np.uint8) if known is None else np.stack(
                            [np.searchsorted(c, values[at, f], side="left").astype(np.uint8) for f, c in enumerate(known)]
                        )
                        key = int(number), kind
                        held.setdefault(key, []).append((bins, ids[at], labels[at]))
                        if sum(len(p[1]) for p in held[key]) >= most:
                            yield packed(key)
        for key in list(held):
            yield packed(key)

    flat = rows.select("data", "test", "_row", "_label", vector_to_array("_features").alias("_values"))
    return map_in_arrow(flat, blocks, "data int, test boolean, n long, bins binary, ids binary, labels binary")


BLOCK_TYPES = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _block(rows: Sequence[Mapping[str, Any]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (features x rows), identifiers and labels of blocks."""
    bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(-1, r["n"]) for r in rows], axis=1)
    ids, labels = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("ids", np.int64), ("labels", np.float64)))
    return bins, ids.astype(np.uint64), labels


def _voted(forest: Forest, ids: np.ndarray, labels: np.ndarray, votes: np.ndarray | None = None, trees: int | None = None) -> pa.RecordBatch:
    """Votes for rows; without any, a half of each tree."""
    count = forest.last - forest.first
    votes, trees = (np.full(len(ids), 0.5 * count), count) if votes is None else (votes, trees)
    columns = [np.full(len(ids), forest.number, np.int32), ids.astype(np.int64), labels, votes, np.full(len(ids), trees, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["try", "row", "label", "votes", "trees"])


def grow_and_vote(work: DataFrame, cuts: Mapping[int, Sequence[Sequence[float]]]) -> DataFrame:
    """Votes of pieces of work (a :class:`Forest`, ``learn`` and ``score``: blocks) for the rows to score."""
    sizes = {data: [len(c) + 1 for c in found] for data, found in cuts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                forest = Forest(*[row[c] for c in Forest._fields])
                bins, ids, labels = _block(row["score"])
                if row["learn"] is None or len(forest.weights) < 2:
                    yield _voted(forest, ids, labels)
                    continue
                known, learn_ids, classes = _block(row["learn"])
                known, bins, classes = known[forest.places], bins[forest.places], classes.astype(np.int64)
                size = [sizes[forest.data][p] for p in forest.places]
                votes, trees = np.zeros(len(ids)), 0
                step = max(1, STEP // len(learn_ids))
                for first in range(forest.first, forest.last, step):
                    last = min(forest.last, first + step)
                    more, count = grow(known, size, learn_ids, classes, forest, first, last).votes(bins, last - first)
                    votes, trees = votes + more, trees + count
                yield _voted(forest, ids, labels, votes, trees)

    return map_in_arrow(work, run, VOTES)


# ---- data sets of several blocks -----------------------------------------------------------


def grow_apart(blocks: DataFrame, forests: Sequence[Forest], sizes: Sequence[int]) -> list[Trees | None]:
    """The trees of forests on a data set of any number of blocks, a level of all of them at a time.

    The driver holds the trees, as Spark ML's does; weights of nodes are added up by the executors, and
    the best split of each node comes from the task that holds its tree's weights.
    """
    grown: list[Trees | None] = [None] * len(forests)
    going = list(range(len(forests)))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bins, ids, labels = _block(batch.slice(k, 1).to_pylist())
                for number in going:
                    step = max(1, STEP // len(ids))
                    for first in range(0, forests[number].last - forests[number].first, step):
                        yield from _weights(number, bins, ids, labels.astype(np.int64), first, step)

    def _weights(number: int, bins: np.ndarray, ids: np.ndarray, classes: np.ndarray, first: int, step: int) -> Iterator[pa.RecordBatch]:
        forest, trees = forests[number], grown[number]
        last = min(forest.last - forest.first, first + step)
        keys = tree_keys(forest, forest.first + first, forest.first + last)
        held, bins = Samples(ids, classes, keys, np.array(forest.weights)), bins[forest.places]
        held.slot = held.slot + first
        tree_of = held.slot
        if trees is None:
            found = held.totals(last)
            slot, cls = np.nonzero(found)
            yield _weighed(number, slot, slot, -1, np.zeros(len(slot), np.int64), cls, found[slot, cls])
            return
        at = np.full(len(trees.feature), -1)
        at[trees.active] = np.arange(len(trees.active))
        slot = at[trees.places(bins, held.slot, held.row)]
        of = np.zeros(len(trees.active), np.int64)
        of[slot[slot >= 0]] = tree_of[slot >= 0]
        held.keep(slot)
        # only the nodes of these trees
        mine = np.unique(held.slot)
        if not len(mine):
            return
        held.slot = np.searchsorted(mine, held.slot)
        picked, totals = chosen(trees.keys[mine], len(bins), forest.per_node), held.totals(len(mine))
        for feature, place in enumerate(forest.places):
            nodes = np.flatnonzero(picked[:, feature])
            if sizes[place] > 1 and len(nodes):
                found = held.counts(bins[feature], sizes[place], picked[:, feature], totals)
                cls, node, part = np.nonzero(found)
                slot = mine[nodes[node]]
                yield _weighed(number, of[slot], slot, feature, part, cls, found[cls, node, part])

    def _weighed(number: int, tree: np.ndarray, slot: np.ndarray, feature: int, part: np.ndarray, cls: np.ndarray, weight: np.ndarray
                 ) -> pa.RecordBatch:
        count = len(slot)
        columns = [np.full(count, number), tree, slot, np.full(count, feature), part, cls]
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c.astype(np.int32)) for c in columns], pa.array(weight)],
            names=["forest", "tree", "slot", "feature", "bin", "class", "weight"],
        )

    def splits(table: pa.Table) -> pa.Table:
        number, slot, feature, part, cls = (table[c].to_numpy() for c in ("forest", "slot", "feature", "bin", "class"))
        forest, mine = forests[number[0]], np.unique(slot)
        best, classes = Best(len(mine), len(forest.weights)), len(forest.weights)
        for f in np.unique(feature):
            here = feature == f
            size = sizes[forest.places[f]]
            nodes, at = np.unique(slot[here], return_inverse=True)
            counts = np.zeros((classes, len(nodes), size))
            counts[cls[here], at, part[here]] = table["weight"].to_numpy()[here]
            best.see(int(f), np.searchsorted(mine, nodes), counts)
        return pa.table([
            pa.array(np.full(len(mine), number[0], np.int32)), pa.array(mine.astype(np.int32)), pa.array(best.gain),
            pa.array(best.feature.astype(np.int32)), pa.array(best.cut.astype(np.int32)), pa.array(best.left.tolist(), pa.list_(pa.float64())),
        ], names=["forest", "slot", "gain", "feature", "cut", "left"])

    counted = "forest int, tree int, slot int, feature int, bin int, class int, weight double"
    by_node = ["forest", "tree", "slot", "feature", "bin", "class"]
    totals = map_in_arrow(blocks, weights, counted).groupBy("forest", "slot", "class").agg(F.sum("weight").alias("weight"))
    stats = [np.zeros((f.last - f.first, len(f.weights))) for f in forests]
    for r in totals.collect():
        stats[r.forest][r.slot, r["class"]] = r.weight
    for number, forest in enumerate(forests):
        grown[number] = Trees(tree_keys(forest, forest.first, forest.last), stats[number], forest.depth)
    while going := [n for n in range(len(forests)) if len(grown[n].active)]:
        best = {n: Best(len(grown[n].active), len(forests[n].weights)) for n in going}
        summed = map_in_arrow(blocks, weights, counted).groupBy(*by_node).agg(F.sum("weight").alias("weight"))
        found = summed.groupBy("forest", "tree").applyInArrow(splits, "forest int, slot int, gain double, feature int, cut int, left array<double>")
        for r in found.collect():
            into = best[r.forest]
            into.gain[r.slot], into.feature[r.slot], into.cut[r.slot], into.left[r.slot] = r.gain, r.feature, r.cut, r.left
        for n in going:
            grown[n].split(best[n].gain, best[n].feature, best[n].cut, best[n].left)
    return [trees.merged() for trees in grown]


def vote_apart(blocks: DataFrame, forests: Sequence[Forest], grown: Sequence[Trees | None]) -> DataFrame:
    """Votes of trees, or of none, for blocks of rows to score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bins, ids, labels = _block(batch.slice(k, 1).to_pylist())
                for forest, trees in zip(forests, grown, strict=True):
                    said = () if trees is None else trees.votes(bins[forest.places], forest.last - forest.first)
                    yield _voted(forest, ids, labels, *said)

    return map_in_arrow(blocks, run, VOTES)


# ---- a round -------------------------------------------------------------------------------


class Sets:
    """Data sets, binned and packed once, for the forests of every round.

    ``rows`` has ``data`` (the number of a set), ``test``, ``_row``, ``_label`` and ``_features``.
    """

    def __init__(self, rows: DataFrame) -> None:
        rows = materialize(rows, "sets")
        self.cuts = cut_points(rows.where(~F.col("test")))
        self.blocks = materialize(pack(rows, self.cuts), "blocks")
        counted = self.blocks.groupBy("data", "test").agg(F.sum(F.length("bins")).alias("size")).collect()
        self.scored = {r.data for r in counted if r.test}
        self.apart = {r.data for r in counted if r["size"] > BLOCK_BYTES}

    def votes(self, forests: Sequence[Forest]) -> DataFrame:
        """``try, row, label, votes, trees``: what trees say of the rows to score; a row has several lines per try."""
        forests = [f for f in forests if f.data in self.scored]
        parts = []
        if whole := [p for f in forests if f.data not in self.apart for p in self._pieces(f)]:
            parts.append(self._whole(whole))
        for data in sorted({f.data for f in forests} & self.apart):
            parts += self._apart(data, [f for f in forests if f.data == data])
        none = self.blocks.sparkSession.createDataFrame([], VOTES)
        return materialize(reduce(DataFrame.unionByName, parts, none), "votes")

    def _pieces(self, forest: Forest) -> list[Forest]:
        return [forest._replace(first=n, last=min(forest.last, n + PIECE)) for n in range(forest.first, forest.last, PIECE)]

    def _whole(self, pieces: Sequence[Forest]) -> DataFrame:
        spark = self.blocks.sparkSession
        blocks = F.collect_list(F.struct("n", "bins", "ids", "labels"))
        mine = self.blocks.where(F.col("data").isin(sorted({p.data for p in pieces})))
        learn, score = (mine.where(F.col("test") == test).groupBy("data").agg(blocks.alias(name)) for test, name in ((False, "learn"), (True, "score")))
        work = spark.createDataFrame([(k, *p) for k, p in enumerate(pieces)], f"piece int, {FOREST}")
        given = F.broadcast(work).join(score, "data").join(learn, "data", "left")
        return grow_and_vote(given.repartition(len(pieces), "piece").select(*Forest._fields, "learn", "score"), self.cuts)

    def _apart(self, data: int, forests: Sequence[Forest]) -> list[DataFrame]:
        blocks = self.blocks.where(F.col("data") == data)
        able = [f for f in forests if len(f.weights) > 1]
        sizes = [len(c) + 1 for c in self.cuts.get(data, [])]
        trees = dict(zip([f.number for f in able], grow_apart(blocks.where(~F.col("test")), able, sizes) if able else [], strict=True))
        return [vote_apart(blocks.where("test"), forests, [trees.get(f.number) for f in forests])]
