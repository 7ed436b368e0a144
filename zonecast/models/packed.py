"""Forests grown on packed cells.

A packed cell is one (date, slot, origin) with all its features, which its
destinations share, and the responses of the destinations that have one.  The
full matrix has ``dests`` rows a cell; here they exist only as bits.  A tree node
holds cells with a set of destinations each: a split on a shared feature moves
the whole set, a split on the destination divides it.

Each level of all trees is one pass over blocks of cells and one shuffle: a block
walks its sets down the levels grown last, counts them in histograms of (node,
feature, bin), and the histograms of a node meet in one task, which picks its
split.  Every few levels the blocks are written anew with the sets that are still
in nodes to be parted, so that later levels start there.  A lost executor costs
its blocks of one level.

Once a level has more than ``FRONTIER`` nodes, a node of at most ``OWN_ROWS`` rows
is taken out of the levels: its rows go to one task, with those of other such nodes,
which grows all that hangs below it.  These lower parts are a table; the driver
holds the upper parts only, whose size does not grow with the rows.  A forecast
walks the upper parts, meets the lower ones in a join, and adds up chunks of cells.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, GAP_COLUMNS, LEVELS, TRAFFIC_COLUMNS, GridConfig
from ..session import ship_package, stage
from .trees import Preset, feature_columns

U = np.uint64
#: Cells of a block, and levels after which blocks are written anew.
BLOCK, REWRITE = 8192, 4
#: Bits of a cell's set of destinations, in words of 64.
SET_WORDS = 2
DEST = "destDistrict"
#: Nodes of a level beyond which small nodes are finished apart, and the rows of a small node and of a group of them.
FRONTIER, OWN_ROWS = 1 << 14, 1 << 16
#: Lines of histograms that a task holds, nodes whose histograms meet in one group, and cells whose forecasts do (a power of two).
HELD, NODES, CHUNK = 1 << 20, 256, 1 << 11


@dataclass(frozen=True)
class Packed:
    """A table of cells and what to learn from it.

    ``dests`` and the ``targets`` are arrays side by side: destinations with a
    response, and their responses; all other destinations 0..n_dests-1 have 0.
    ``use`` names an array of the destinations to learn from, None means all.
    """

    cells: DataFrame
    keys: tuple[str, ...]
    categories: tuple[str, ...]
    numbers: tuple[str, ...]
    targets: tuple[str, ...]
    n_dests: int
    dests: str = "dests"
    use: str | None = None

    def rows(self, keep: Sequence[str] = ()) -> DataFrame:
        """What the workers read of a cell; ``keep`` names columns that come along as k0, k1, …"""
        none = F.lit(None).cast("array<int>")
        return self.cells.select(
            F.xxhash64(*(F.col(k).cast("string") for k in self.keys)).alias("seed"),
            F.col(self.dests).cast("array<int>").alias("dests"),
            (F.col(self.use).cast("array<int>") if self.use else none).alias("use"),
            *(F.col(t).cast("array<double>").alias(f"y{k}") for k, t in enumerate(self.targets)),
            *(F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate((*self.categories, *self.numbers))),
            *(F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)),
        )


@dataclass(frozen=True)
class Bins:
    """Levels of the categories, thresholds and means of the numbers, destinations last (if there are several)."""

    names: tuple[str, ...]
    levels: tuple[np.ndarray, ...]
    thresholds: tuple[np.ndarray, ...]
    means: tuple[float, ...]
    n_dests: int

    @property
    def categorical(self) -> np.ndarray:
        return np.array([True] * len(self.levels) + [False] * len(self.thresholds) + [True] * (self.n_dests > 1))

    @property
    def width(self) -> int:
        """Bins of the widest feature; an unseen category has one of its own."""
        return max([len(x) + 1 for x in (*self.levels, *self.thresholds)] + [self.n_dests])

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint16)
        for k, x in enumerate(columns):
            if k < len(self.levels):
                level = self.levels[k]
                at = np.minimum(np.searchsorted(level, x), max(len(level) - 1, 0))
                known = level[at] == x if len(level) else np.zeros(len(x), bool)
                out[:, k] = np.where(known, at, len(level))
            else:
                j = k - len(self.levels)
                x = np.where(np.isnan(x), self.means[j], x)
                out[:, k] = np.searchsorted(self.thresholds[j], x, side="left")
        return out


def make_bins(data: Packed, bins: int, drop_constant: bool) -> Bins:
    """Few distinct numbers are parted half-way between neighbours, many at their quantiles; NULL takes the mean.

    One aggregate over the cells, then one row a number column (and its bins) reach the driver.
    """
    numbers = [F.col(f"`{c}`").cast("double") for c in data.numbers]
    points = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    aggs = [F.percentile_approx(c, points, 10_000).alias(f"q{k}") for k, c in enumerate(numbers)]
    aggs += [F.avg(c).alias(f"m{k}") for k, c in enumerate(numbers)]
    aggs += [F.approx_count_distinct(c).alias(f"n{k}") for k, c in enumerate(numbers)]
    # Categories are calendar and zone numbers: as many as the grid has.
    aggs += [F.array_sort(F.collect_set(F.col(f"`{c}`").cast("double"))).alias(f"c{k}") for k, c in enumerate(data.categories)]
    row = data.cells.agg(*aggs).first()
    small = [k for k in range(len(numbers)) if (row[f"n{k}"] or 0) <= 2 * bins]
    distinct = {}
    if small:
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), numbers[k].alias("x")) for k in small)))
        seen = data.cells.select(pairs.alias("p")).select("p.*").where("x is not null").distinct()
        # At most about 2 * bins values a column.
        for r in seen.collect():
            distinct.setdefault(r.k, []).append(r.x)
    thresholds = []
    for k in range(len(numbers)):
        values = np.unique(distinct.get(k, []))
        if k in small and len(values) <= bins:
            thresholds.append((values[1:] + values[:-1]) / 2)
        else:
            thresholds.append(np.unique(np.array(row[f"q{k}"] or [], float)))
    levels = [np.array(row[f"c{k}"] or [], float) for k in range(len(data.categories))]
    means = [float(row[f"m{k}"] or 0.0) for k in range(len(numbers))]
    use_c = [k for k, x in enumerate(levels) if len(x) > 1 or not drop_constant]
    use_n = [k for k, x in enumerate(thresholds) if len(x) or not drop_constant]
    names = [data.categories[k] for k in use_c] + [data.numbers[k] for k in use_n] + ([DEST] if data.n_dests > 1 else [])
    return Bins(
        tuple(names), tuple(levels[k] for k in use_c), tuple(thresholds[k] for k in use_n), tuple(means[k] for k in use_n), data.n_dests
    )


def _lists(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists end to end, and how many each row has (0 for null)."""
    n = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), n


def _bits(rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """(n, SET_WORDS) sets of the places of each row."""
    out = np.zeros((n, SET_WORDS), U)
    np.bitwise_or.at(out, (rows, places >> 6), U(1) << (places & 63).astype(U))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Block:
    """Cells of a batch: codes of the features, the responses that are there, the sets to learn from, and where
    each tree has them."""

    def __init__(self, batch: pa.RecordBatch, bins: Bins, columns: Sequence[int], n_targets: int):
        self.n = batch.num_rows
        self.seed = batch.column("seed").to_numpy().view(U)
        places, per = _lists(batch.column("dests"), np.int64)
        self.row, self.place = np.repeat(np.arange(self.n), per), places
        self.first, self.per = np.cumsum(per) - per, per
        self.values = [_lists(batch.column(f"y{k}"), float)[0] for k in range(n_targets)]
        self.codes = bins.codes([batch.column(f"x{k}").to_numpy(zero_copy_only=False).astype(float) for k in columns])
        self.all = np.zeros(SET_WORDS, U)
        self.all[:] = _bits(np.zeros(bins.n_dests, int), np.arange(bins.n_dests), 1)[0]
        self.sets = np.tile(self.all, (self.n, 1))
        use = batch.column("use")
        if use.null_count < self.n:
            places, per = _lists(use, np.int64)
            given = _bits(np.repeat(np.arange(self.n), per), places, self.n)
            self.sets = np.where(np.asarray(use.is_valid())[:, None], given, self.sets)

    @classmethod
    def of(cls, codes: np.ndarray, sets: np.ndarray, per: np.ndarray, place: np.ndarray, values: np.ndarray) -> Block:
        """A block of cells that are at hand, with one response."""
        b = cls.__new__(cls)
        b.n, b.codes, b.sets, b.per = len(codes), codes, sets, per
        b.row, b.place, b.first, b.values = np.repeat(np.arange(b.n), per), place, np.cumsum(per) - per, [values]
        return b

    def inside(self, row: np.ndarray, sets: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The responses inside the sets of the given cells: number of the set, destination, response."""
        per = self.per[row]
        entry = np.repeat(np.arange(len(row)), per)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.first[row], per)
        d = self.place[at]
        has = sets[entry, d >> 6] >> (d & 63).astype(U) & U(1) > 0
        return entry[has], d[has], self.values[target][at[has]]

    def sampled(self, tree: int, seed: int, share: float) -> np.ndarray:
        """The destinations of each cell that a tree learns from: each is in with a chance of ``share`` (in 256ths)."""
        if share >= 1:
            return self.sets
        out = np.zeros((self.n, SET_WORDS), U)
        salt = U((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) % (1 << 64))
        # Binary digits of the share, the lowest first: or with a random word for a one, and for a zero.
        for k in range(8):
            for w in range(SET_WORDS):
                r = _mix(self.seed ^ salt ^ U((k * SET_WORDS + w + 1) * 0xA24BAED4963EE407 % (1 << 64)))
                out[:, w] = out[:, w] | r if round(share * 256) >> k & 1 else out[:, w] & r
        return out & self.sets

    def start(self, trees: int, alike: int, seed: int, share: float) -> None:
        """Every tree's sets at its root."""
        self.entries = {}
        for tree in range(trees):
            sets = self.sampled(tree % alike, seed, share)
            row = np.flatnonzero(sets.any(1))
            self.entries[tree] = row, np.full(len(row), tree), sets[row]

    def advance(self, trees: Trees, dest: int, wanted: np.ndarray) -> None:
        """Walk all sets down to the wanted nodes; forget those that come to an end."""
        self.entries = {t: trees.walk(self, *e, dest, wanted) for t, e in self.entries.items() if len(e[0])}

    def compact(self) -> None:
        """Forget the cells that no set is left of."""
        used = np.zeros(self.n, bool)
        for row, _, _ in self.entries.values():
            used[row] = True
        new = np.cumsum(used) - 1
        has = used[self.row]
        self.place, self.values = self.place[has], [v[has] for v in self.values]
        self.row, self.per = new[self.row[has]], self.per[used]
        self.first = np.cumsum(self.per) - self.per
        self.codes, self.sets, self.seed, self.n = self.codes[used], self.sets[used], self.seed[used], int(used.sum())
        self.entries = {t: (new[row], node, sets) for t, (row, node, sets) in self.entries.items()}


@dataclass
class Trees:
    """Nodes of all trees: the feature that parts a node (-1: none), the bins that go left, the children, the mean response."""

    feature: np.ndarray
    goes_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    tree: np.ndarray

    @classmethod
    def roots(cls, trees: int, words: int) -> Trees:
        return cls(
            np.full(trees, -1, np.int16), np.zeros((trees, words), U), np.zeros(trees, np.int64), np.zeros(trees, np.int64),
            np.zeros(trees), np.arange(trees),
        )

    def grow(self, nodes: np.ndarray, feature: np.ndarray, goes_left: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Part nodes in two; ``values`` are those of the left and right children.  Returns the children."""
        n = len(self.feature)
        children = n + np.arange(2 * len(nodes))
        self.feature[nodes], self.goes_left[nodes] = feature, goes_left
        self.left[nodes], self.right[nodes] = children[0::2], children[1::2]
        self.feature = np.concatenate([self.feature, np.full(2 * len(nodes), -1, np.int16)])
        self.goes_left = np.concatenate([self.goes_left, np.zeros((2 * len(nodes), self.goes_left.shape[1]), U)])
        self.left, self.right = (np.concatenate([x, np.zeros(2 * len(nodes), np.int64)]) for x in (self.left, self.right))
        self.value = np.concatenate([self.value, values.ravel()])
        self.tree = np.concatenate([self.tree, np.repeat(self.tree[nodes], 2)])
        return children

    def walk(self, b: Block, row: np.ndarray, node: np.ndarray, sets: np.ndarray, dest: int, wanted: np.ndarray):
        """Sets of cells from the given nodes down to nodes without a split; those whose node is ``wanted`` come back."""
        done = []
        while len(row):
            f = self.feature[node]
            stop = f < 0
            if stop.any():
                keep = stop & wanted[node]
                done.append((row[keep], node[keep], sets[keep]))
                row, node, sets, f = row[~stop], node[~stop], sets[~stop], f[~stop]
            parted = f == dest
            whole = ~parted
            r, at = row[whole], node[whole]
            code = b.codes[r, f[whole]]
            go = self.goes_left[at, code >> 6] >> (code & 63).astype(U) & U(1)
            moved = r, np.where(go > 0, self.left[at], self.right[at]), sets[whole]
            r, at, s = row[parted], node[parted], sets[parted]
            mine = self.goes_left[at, :SET_WORDS]
            sides = [(s & mine, self.left[at]), (s & ~mine, self.right[at])]
            some = [x.any(1) for x, _ in sides]
            row = np.concatenate([moved[0], *(r[k] for k in some)])
            node = np.concatenate([moved[1], *(c[k] for (_, c), k in zip(sides, some, strict=True))])
            sets = np.concatenate([moved[2], *(x[k] for (x, _), k in zip(sides, some, strict=True))])
        if not done:
            return row, node, sets
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sums of the rows of ``values`` for each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def chosen_features(tree: np.ndarray, node: np.ndarray, n: int, per_node: int, seed: int) -> np.ndarray:
    """Numbers of the features that each node looks at, picked by a hash; (nodes, per_node)."""
    if per_node >= n:
        return np.tile(np.arange(n), (len(node), 1))
    x = (node.astype(U) * U(n) + tree.astype(U) * U(0x100000001B3))[:, None] + np.arange(n).astype(U)
    return np.sort(np.argsort(_mix(x ^ U(seed % (1 << 64))), axis=1)[:, :per_node], axis=1)


def _counted(index: np.ndarray, stats: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``stats`` by their index below ``size``, in a table if it is small enough, else by sorting."""
    if size > 8 * len(index) + 100_000:
        return _summed(index, stats)
    table = np.stack([np.bincount(index, s, size) for s in stats.T], axis=1)
    some = np.flatnonzero(table[:, 0] > 0)
    return some, table[some]


def histograms(
    b: Block, trees: Trees, frontier: np.ndarray, features: np.ndarray, bins: Bins, target: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tree by tree, keys (place in the frontier, feature, bin) with count, sum and sum of squares of the responses."""
    n, width, dest = len(bins.names), bins.width, _dest(bins)
    place = np.full(len(trees.feature), -1)
    place[frontier] = np.arange(len(frontier))
    b.advance(trees, dest, place >= 0)
    for tree, (row, node, sets) in b.entries.items():
        if not len(row):
            continue
        # Nodes of this tree from 0 on.
        own = np.unique(place[node])
        k = np.searchsorted(own, place[node])
        looks = features[own]
        entry, d, y = b.inside(row, sets, target[tree])
        stats = np.stack(
            [np.bitwise_count(sets).sum(1), np.bincount(entry, y, len(row)), np.bincount(entry, y * y, len(row))], axis=1
        )
        index, shown = [], []
        for j in range(looks.shape[1]):
            f = looks[k, j]
            on = np.flatnonzero(f != dest)
            f = f[on]
            index.append((k[on] * n + f) * width + b.codes[row[on], f])
            shown.append(stats[on])
        found = _counted(np.concatenate(index), np.concatenate(shown), len(own) * n * width)
        parts = [found]
        sees = np.flatnonzero((looks == dest).any(1)[k])
        if len(sees):
            counts, of = np.zeros((len(own), bins.n_dests, 3)), k[sees]
            seen = np.ascontiguousarray(sets[sees].T)
            for bit in range(bins.n_dests):
                counts[:, bit, 0] = np.bincount(of[(seen[bit >> 6] >> U(bit & 63) & U(1)).astype(bool)], minlength=len(own))
            hit = np.isin(entry, sees)
            cell = k[entry[hit]] * bins.n_dests + d[hit]
            for power in (1, 2):
                counts[:, :, power] = np.bincount(cell, y[hit] ** power, len(own) * bins.n_dests).reshape(len(own), -1)
            at_k, bit = np.nonzero(counts[:, :, 0])
            parts.append(((at_k * n + dest) * width + bit, counts[at_k, bit]))
        for index_, sums in parts:
            yield index_ + (own[index_ // (n * width)] - index_ // (n * width)) * (n * width), sums


def _dest(bins: Bins) -> int:
    """Number of the destination among the features; no feature has -2."""
    return len(bins.names) - 1 if bins.n_dests > 1 else -2


def best_splits(keys: np.ndarray, stats: np.ndarray, n: int, width: int, categorical: np.ndarray, words: int) -> dict[str, np.ndarray]:
    """For each node: its totals, and the split with the greatest fall in variance (feature -1: none).

    Bins of a category are put in order of their means; a bin without rows goes right.
    """
    pair, bin_ = keys // width, keys % width
    is_cat = categorical[pair % n]
    order = np.lexsort((bin_, np.where(is_cat, stats[:, 1] / np.maximum(stats[:, 0], 1), bin_), pair))
    order = order[stats[order, 0] > 0]
    pair, bin_, stats = pair[order], bin_[order], stats[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    size = np.diff(np.append(first, len(pair)))
    total = np.add.reduceat(stats, first)
    left = np.cumsum(stats, axis=0)
    left -= np.repeat(left[first] - stats[first], size, axis=0)
    all_ = np.repeat(total, size, axis=0)
    right = all_ - left
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = lambda s: s[:, 2] - s[:, 1] ** 2 / s[:, 0]
        gain = (spread(all_) - spread(left) - spread(right)) / all_[:, 0]
    last = np.zeros(len(pair), bool)
    last[first + size - 1] = True
    # A sum of squares is only good to its last digits.
    gain = np.where(last | (gain <= 1e-12 * np.maximum(all_[:, 2] / all_[:, 0], 1e-300)), -np.inf, gain)
    node = pair // n
    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    best = np.lexsort((np.arange(len(node)), -gain, node))[begin]
    split = np.isfinite(gain[best])
    mask = np.zeros((len(begin), words), U)
    segment = np.repeat(np.arange(len(first)), size)
    start = first[segment[best]]
    count = np.where(split, best - start + 1, 0)
    at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
    owner = np.repeat(np.arange(len(begin)), count)
    np.bitwise_or.at(mask, (owner, bin_[at] >> 6), U(1) << (bin_[at] & 63).astype(U))
    numeric = split & ~categorical[pair[best] % n]
    for w in range(words):
        # All bins up to the split, also those that no row of this node fell into.
        upto = np.clip(bin_[best] - 64 * w + 1, 0, 64)
        full = np.where(upto >= 64, ~U(0), (U(1) << np.minimum(upto, 63).astype(U)) - U(1))
        mask[:, w] = np.where(numeric, full, mask[:, w])
    return {
        "node": node[begin], "feature": np.where(split, pair[best] % n, -1), "mask": mask,
        "total": all_[best], "left": left[best], "right": right[best],
    }


PARTS = ("node", "feature", "mask", "total", "left", "right")
KINDS = {"node": np.int64, "feature": np.int64, "mask": U, "total": float, "left": float, "right": float}


@dataclass
class PackedForest:
    """Trees, how features are binned, and which tree forecasts which target (``trees`` each, one target after the other)."""

    bins: Bins
    trees: Trees
    per_target: int
    targets: tuple[str, ...]
    #: The table of lower parts (None: all is in ``trees``), and the group in it that goes on at a node (-1: none).
    lower: DataFrame | None = None
    group: np.ndarray | None = None

    def _columns(self, data: Packed) -> list[int]:
        names = [*data.categories, *data.numbers]
        return [names.index(n) for n in self.bins.names if n != DEST or self.bins.n_dests == 1]

    def _each(self, b: Block) -> Iterator[tuple[int, np.ndarray]]:
        """Tree by tree the forecasts of all destinations of the cells: (tree, (cells, dests))."""
        dest = _dest(self.bins)
        telling = self.trees.value != 0
        for tree in range(self.per_target * len(self.targets)):
            row, node, sets = self.trees.walk(b, np.arange(b.n), np.full(b.n, tree), np.tile(b.all, (b.n, 1)), dest, telling)
            yield tree, _spread(row, sets, self.trees.value[node], b.n, self.bins.n_dests)

    def _over(self, data: Packed, keep: Sequence[str], shown: Callable, schema: str) -> DataFrame:
        """``shown(model, batch, block, forecasts tree by tree)`` of all cells, block by block."""
        columns, n_targets, spark = self._columns(data), len(data.targets), data.cells.sparkSession
        ship_package(spark)
        shared = spark.sparkContext.broadcast(replace(self, lower=None))
        rows = data.rows(keep)

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(at, BLOCK)
                    b = Block(batch, model.bins, columns, n_targets)
                    yield shown(model, batch, b, model._each(b))

        if self.lower is None:
            return rows.mapInArrow(alone, schema)

        def together(pieces: pa.Table, cells: pa.Table) -> pa.Table:
            model, batch = shared.value, cells.combine_chunks().to_batches()[0]
            b, place = Block(batch, model.bins, columns, n_targets), np.empty(CHUNK, np.int64)
            place[batch.column("cell").to_numpy() % CHUNK] = np.arange(b.n)
            parts = [pickle.loads(x) for x in pieces.column("part").to_pylist()]
            parts = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.empty(0, int)] * 2 + [np.empty((0, SET_WORDS), U), np.empty(0)]
            order = np.argsort(parts[1], kind="stable")
            cell, tree, sets, value = (x[order] for x in parts)
            cut = np.searchsorted(tree, np.arange(model.per_target * len(model.targets) + 1))
            each = (
                (k, _spread(place[cell[lo:hi]], sets[lo:hi], value[lo:hi], b.n, model.bins.n_dests))
                for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True))
            )
            return pa.Table.from_batches([shown(model, batch, b, each)])

        tasks = _tasks(spark)
        cells = stage(rows.withColumn("cell", F.monotonically_increasing_id()), "packed-cells")
        walked = stage(cells.mapInArrow(_upper_walk(shared, columns, n_targets), "group int, chunk long, part binary"), "packed-walked")
        below = walked.where("group >= 0").repartition(tasks, "group").groupBy("group")
        below = below.cogroup(self.lower.repartition(tasks, "group").groupBy("group")).applyInArrow(_lower_walk(shared), "chunk long, part binary")
        pieces = walked.where("group < 0").select("chunk", "part").unionByName(below).repartition(tasks, "chunk")
        cells = cells.withColumn("chunk", F.floor(F.col("cell") / CHUNK).cast("long")).repartition(tasks, "chunk")
        return pieces.groupBy("chunk").cogroup(cells.groupBy("chunk")).applyInArrow(together, schema)

    def score(self, data: Packed, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep`` with an array of forecasts for each target, ``{target}_predict``, by destination from 0 on."""
        names = [f"{t}_predict" for t in self.targets]

        def shown(model: PackedForest, batch: pa.RecordBatch, b: Block, each: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            sums = np.zeros((len(names), b.n, model.bins.n_dests))
            for tree, out in each:
                sums[tree // model.per_target] += out
            lists = []
            for s in sums / model.per_target:
                ends = pa.array(np.arange(b.n + 1) * model.bins.n_dests, pa.int32())
                lists.append(pa.ListArray.from_arrays(ends, pa.array(s.ravel())))
            return pa.RecordBatch.from_arrays([*(batch.column(f"k{k}") for k in range(len(keep))), *lists], [*keep, *names])

        schema = data.cells.select(*(F.col(f"`{c}`") for c in keep)).schema
        out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"`{n}` array<double>" for n in names)])
        return self._over(data, keep, shown, out)

    def errors_by_tree(self, data: Packed) -> DataFrame:
        """(target, trees, metric, value): mae and rmse after each tree, from one pass over the cells.

        The running mean over the trees is kept, so no prefix is scored again.
        Errors are those of the destinations in ``use``, all if it is None.
        """

        def shown(model: PackedForest, batch: pa.RecordBatch, b: Block, each: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            n = model.per_target * len(model.targets)
            off, square, count = np.zeros(n), np.zeros(n), np.zeros(n)
            used = np.stack([b.sets[:, d >> 6] >> U(d & 63) & U(1) > 0 for d in range(model.bins.n_dests)], axis=1)
            for tree, out in each:
                target, k = divmod(tree, model.per_target)
                if k == 0:
                    total = np.zeros_like(out)
                    y = np.zeros_like(out)
                    y[b.row, b.place] = b.values[target]
                total += out
                e = (total / (k + 1) - y)[used]
                off[tree], square[tree], count[tree] = np.abs(e).sum(), (e * e).sum(), len(e)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *map(pa.array, (off, square, count))], ["tree", "off", "square", "n"])

        rows = self._over(data, (), shown, "tree long, off double, square double, n double")
        sums = rows.groupBy("tree").agg(*(F.sum(c).alias(c) for c in ("off", "square", "n")))
        target = F.element_at(F.array(*map(F.lit, self.targets)), (F.floor(F.col("tree") / self.per_target) + 1).cast("int"))
        pairs = [(n, c) for n, c in (("mae", F.col("off") / F.col("n")), ("rmse", F.sqrt(F.col("square") / F.col("n"))))]
        metric = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in pairs))).alias("m")
        trees = (F.col("tree") % self.per_target + 1).cast("int").alias("trees")
        return sums.select(target.alias("target"), trees, metric).select("target", "trees", "m.*")

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes and bins as tables, like Spark's own forests."""
        t = self.trees
        nodes = pa.table(
            {
                "node": np.arange(len(t.feature)), "tree": t.tree, "feature": t.feature.astype(np.int32), "left": t.left,
                "right": t.right, "value": t.value, "group": np.full(len(t.feature), -1, np.int32) if self.group is None else self.group,
                "goes_left": pa.array([m.tobytes() for m in t.goes_left], pa.binary()),
            }
        )
        bins = {
            "names": self.bins.names, "levels": [x.tolist() for x in self.bins.levels], "means": self.bins.means,
            "thresholds": [x.tolist() for x in self.bins.thresholds], "n_dests": self.bins.n_dests,
            "per_target": self.per_target, "targets": self.targets, "lower": self.lower is not None,
        }
        spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(bins),)], "bins string").coalesce(1).write.mode("overwrite").text(f"{path}/bins")
        if self.lower is not None:
            self.lower.write.mode("overwrite").parquet(f"{path}/lower")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PackedForest:
        d = json.loads(spark.read.text(f"{path}/bins").first()[0])
        t = spark.read.parquet(f"{path}/nodes").orderBy("node").toArrow()
        arrays = {c: t.column(c).to_numpy() for c in ("feature", "left", "right", "value", "tree")}
        masks = np.frombuffer(b"".join(t.column("goes_left").to_pylist()), U).reshape(t.num_rows, -1)
        lists = lambda x: tuple(np.array(v, float) for v in x)
        bins = Bins(tuple(d["names"]), lists(d["levels"]), lists(d["thresholds"]), tuple(d["means"]), d["n_dests"])
        trees = Trees(arrays["feature"].astype(np.int16), masks.copy(), *(arrays[c] for c in ("left", "right", "value", "tree")))
        lower = (spark.read.parquet(f"{path}/lower"), t.column("group").to_numpy()) if d.get("lower") else ()
        return cls(bins, trees, d["per_target"], tuple(d["targets"]), *lower)


def _spread(row: np.ndarray, sets: np.ndarray, value: np.ndarray, n: int, n_dests: int) -> np.ndarray:
    """(cells, dests): each value at its cell, for the destinations in its set."""
    out = np.zeros((n, n_dests))
    for d in range(n_dests):
        hit = sets[:, d >> 6] >> U(d & 63) & U(1) > 0
        out[row[hit], d] = value[hit]
    return out


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of each stretch of equal keys."""
    if len(keys[0]):
        change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        cut = np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys[0])]])
        yield from zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _upper_walk(shared, columns: Sequence[int], n_targets: int):
    """Cells down to the leaves of the upper parts (group -1: cell in its chunk, tree, set, value), and to the nodes
    below which a group goes on (cell, tree, set, node, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wanted, dest = (model.trees.value != 0) | (model.group >= 0), _dest(model.bins)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                b, cell = Block(batch, model.bins, columns, n_targets), batch.column("cell").to_numpy()
                for tree in range(model.per_target * len(model.targets)):
                    row, node, sets = model.trees.walk(b, np.arange(b.n), np.full(b.n, tree), np.tile(b.all, (b.n, 1)), dest, wanted)
                    group, chunk = model.group[node], cell[row] // CHUNK
                    order = np.lexsort((chunk, group))
                    row, node, sets, group, chunk = (x[order] for x in (row, node, sets, group, chunk))
                    own, trees, place = cell[row], np.full(len(row), tree, np.int16), (cell[row] % CHUNK).astype(np.int16)
                    out = []
                    upper = int(np.searchsorted(group, 0))
                    for lo, hi in _runs(chunk[:upper]):
                        out.append((-1, chunk[lo], (place[lo:hi], trees[lo:hi], sets[lo:hi], model.trees.value[node[lo:hi]])))
                    for lo, hi in _runs(group[upper:]):
                        lo, hi = lo + upper, hi + upper
                        out.append((group[lo], -1, (own[lo:hi], trees[lo:hi], sets[lo:hi], node[lo:hi], b.codes[row[lo:hi]])))
                    yield _lines(out, ("group", "chunk"))

    return run


def _lower_walk(shared):
    """What ``_upper_walk`` gave a group, down to the leaves: (cell in its chunk, tree, set, value) by chunk."""

    def run(asked: pa.Table, lower: pa.Table) -> pa.Table:
        dest, out = _dest(shared.value.bins), []
        if asked.num_rows and lower.num_rows:
            roots, trees = pickle.loads(lower.column("nodes")[0].as_buffer())
            parts = [pickle.loads(x) for x in asked.column("part").to_pylist()]
            cell, tree, sets, node, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
            none = np.zeros(len(cell), np.int64)
            b = Block.of(codes, sets, none, none[:0], np.empty(0))
            row, node, sets = trees.walk(b, np.arange(b.n), np.searchsorted(roots, node), sets, dest, trees.value != 0)
            order = np.argsort(cell[row], kind="stable")
            row, value, sets = row[order], trees.value[node[order]], sets[order]
            chunk, place = cell[row] // CHUNK, (cell[row] % CHUNK).astype(np.int16)
            out = [(chunk[lo], (place[lo:hi], tree[row[lo:hi]], sets[lo:hi], value[lo:hi])) for lo, hi in _runs(chunk)]
        return pa.Table.from_batches([_lines(out, ("chunk",))])

    return run


def _lines(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    """Rows of numbers (``group`` an int, others long) with a pickled part at the end."""
    kinds = [pa.int32() if n == "group" else pa.int64() for n in names]
    numbers = [pa.array([int(r[k]) for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array([pickle.dumps(r[-1], 5) for r in rows], pa.binary())], [*names, "part"])


def fit_packed(data: Packed, preset: Preset, sample: float = 0.632, third: bool = True) -> PackedForest:
    """A forest for each target, all grown at once: ``sample`` of the rows a tree without replacement, a third of
    the features a split, as in ``fit_forest``.

    A row is a cell with one destination.  The share is met to 1/256.  Splits are
    those of the greatest fall in variance; the result does not depend on how the
    cells are partitioned, but for the order in which sums are added up.
    """
    spark = data.cells.sparkSession
    ship_package(spark)
    bins = make_bins(data, preset.bins, preset.drop_constant)
    n, n_targets, columns = len(bins.names), len(data.targets), None
    words = max(SET_WORDS, -(-bins.width // 64))
    trees = Trees.roots(preset.trees * n_targets, words)
    target = np.repeat(np.arange(n_targets), preset.trees)
    model = PackedForest(bins, trees, preset.trees, data.targets)
    columns = model._columns(data)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    settings = (len(trees.feature), preset.trees, preset.seed, sample)
    blocks = data.rows().repartition(parts).mapInArrow(_blocks(bins, columns, n_targets, settings), "block binary")
    blocks = stage(blocks, "packed-blocks")
    frontier = np.arange(len(trees.feature))
    rows = np.full(len(frontier), np.inf)
    per_node = -(-n // 3) if third else n
    apart, since, waiting, lower = False, 0, [], []
    for level in range(preset.depth):
        begin = not apart and len(frontier) > FRONTIER
        apart = apart or begin
        if apart:
            small = rows <= OWN_ROWS
            waiting.append((frontier[small], rows[small], preset.depth - level))
            frontier, rows = frontier[~small], rows[~small]
        if since == REWRITE or begin:
            if waiting:
                lower.append(_finish(model, blocks, waiting, target, per_node, preset.seed))
                waiting = []
            shared = spark.sparkContext.broadcast((trees, frontier, bins))
            blocks = stage(blocks.mapInArrow(_rewriter(shared), "block binary"), "packed-blocks")
            shared.destroy()
            since = 0
        if not len(frontier):
            break
        since += 1
        features = chosen_features(trees.tree[frontier], frontier, n, per_node, preset.seed)
        shared = spark.sparkContext.broadcast((trees, frontier, features, bins, target))
        picked = blocks.mapInArrow(_counter(shared, max(parts, len(frontier) // NODES)), "bucket int, keys binary, stats binary")
        picked = picked.groupBy("bucket").applyInArrow(_picker(n, bins.width, bins.categorical, words), ", ".join(f"{c} binary" for c in PARTS))
        # One line of numbers for each node of this level.
        got = picked.collect()
        shared.destroy()
        if not got:
            break
        found = {c: np.concatenate([np.frombuffer(r[c], KINDS[c]) for r in got]) for c in PARTS}
        found = {c: x.reshape(-1, words if c == "mask" else 3) if c in ("mask", "total", "left", "right") else x for c, x in found.items()}
        order = np.argsort(found["node"], kind="stable")
        _, frontier, rows = _part(trees, frontier, {c: x[order] for c, x in found.items()})
        if not len(frontier) and not apart:
            break
    if waiting:
        lower.append(_finish(model, blocks, waiting, target, per_node, preset.seed))
    if lower:
        model.lower = reduce(DataFrame.unionByName, lower)
        model.group = _padded(model.group, len(trees.feature))
    return model


def _part(trees: Trees, nodes: np.ndarray, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part nodes as found: the nodes that were, their children that may be parted too, and the rows of those."""
    nodes = nodes[found["node"]]
    trees.value[nodes] = found["total"][:, 1] / found["total"][:, 0]
    split = found["feature"] >= 0
    sides = np.stack([found["left"][split], found["right"][split]], axis=1)
    children = trees.grow(nodes[split], found["feature"][split], found["mask"][split], sides[:, :, 1] / sides[:, :, 0])
    c, s, q = sides.reshape(-1, 3).T
    more = (c > 1) & (q - s * s / np.maximum(c, 1) > 1e-9 * np.maximum(q, 1e-300))
    return nodes[split], children[more], c[more]


def _padded(group: np.ndarray | None, n: int) -> np.ndarray:
    out = np.full(n, -1, np.int32)
    if group is not None:
        out[: len(group)] = group
    return out


def _finish(
    model: PackedForest, blocks: DataFrame, waiting: list[tuple[np.ndarray, np.ndarray, int]], target: np.ndarray, per_node: int, seed: int
) -> DataFrame:
    """Grow all that hangs below the waiting nodes, group by group: (group, nodes), written.

    A group holds nodes of one tree or of neighbouring ones, up to about ``OWN_ROWS`` rows together.
    """
    trees, bins, spark = model.trees, model.bins, blocks.sparkSession
    nodes, rows = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
    levels = np.zeros(len(trees.feature), np.int16)
    for own, _, left in waiting:
        levels[own] = left
    order = np.lexsort((nodes, trees.tree[nodes]))
    nodes, rows = nodes[order], rows[order]
    model.group = _padded(model.group, len(trees.feature))
    first = int(model.group.max()) + 1
    group = _padded(None, len(trees.feature))
    group[nodes] = first + np.unique((np.cumsum(rows) // OWN_ROWS).astype(np.int64), return_inverse=True)[1]
    model.group = np.maximum(model.group, group)
    shared = spark.sparkContext.broadcast((trees, group, bins, target, levels))
    taken = blocks.mapInArrow(_taker(shared), "group int, part binary").repartition(_tasks(spark), "group")
    grown = taken.groupBy("group").applyInArrow(_grower(shared, per_node, seed), "group int, nodes binary")
    grown = stage(grown, "packed-lower")
    shared.destroy()
    return grown


def _taker(shared):
    """What lies in the nodes to be finished: a line for each block, tree and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, group, bins, target, _ = shared.value
        code = np.uint8 if bins.width <= 256 else np.uint16
        for b in _each_block(batches):
            b.advance(trees, _dest(bins), group >= 0)
            codes = b.codes.astype(code)
            for tree, (row, node, sets) in b.entries.items():
                order = np.argsort(group[node], kind="stable")
                row, node, sets = row[order], node[order], sets[order]
                entry, d, y = b.inside(row, sets, target[tree])
                per = np.bincount(entry, minlength=len(row))
                end, d, own, per = np.concatenate([[0], np.cumsum(per)]), d.astype(np.uint8), group[node], per.astype(np.uint8)
                out = []
                for lo, hi in _runs(own):
                    some = slice(end[lo], end[hi])
                    out.append((own[lo], (node[lo:hi], sets[lo:hi], codes[row[lo:hi]], per[lo:hi], d[some], y[some])))
                yield _lines(out, ("group",))

    return run


def _grower(shared, per_node: int, seed: int):
    """All that hangs below the nodes of a group: their numbers, and trees that have them as roots in that order."""

    def run(t: pa.Table) -> pa.Table:
        _, _, bins, _, levels = shared.value
        n, words = len(bins.names), max(SET_WORDS, -(-bins.width // 64))
        # The order in which blocks come in does not matter.
        parts = [pickle.loads(x) for x in sorted(t.column("part").to_pylist())]
        node, sets, codes, per, d, y = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        b = Block.of(codes, sets, per.astype(np.int64), d.astype(np.int64), y)
        roots, at = np.unique(node, return_inverse=True)
        b.entries = {0: (np.arange(b.n), at, sets)}
        trees, left, path = Trees.roots(len(roots), words), levels[roots].astype(np.int64), _mix(roots.astype(U) + U(1))
        frontier, none = np.arange(len(roots)), np.zeros(1, np.int64)
        while len(frontier):
            # A node is told by its root and the way down from there.
            features = chosen_features(np.zeros(len(frontier), np.int64), path[frontier], n, per_node, seed)
            found = [*histograms(b, trees, frontier, features, bins, none)]
            if not found:
                break
            keys, stats = (np.concatenate(x) for x in zip(*found, strict=True))
            parents, more, _ = _part(trees, frontier, best_splits(keys, stats, n, bins.width, bins.categorical, words))
            sides = np.tile(np.array([1, 2], U), len(parents))
            path = np.concatenate([path, _mix(np.repeat(path[parents], 2) * U(3) + sides)])
            left = np.concatenate([left, np.repeat(left[parents] - 1, 2)])
            frontier = more[left[more] > 0]
        blob = pickle.dumps((roots, trees), 5)
        return pa.table({"group": t.column("group").slice(0, 1), "nodes": pa.array([blob], pa.binary())})

    return run


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield pickle.loads(batch.column(0)[k].as_buffer())


def _written(b: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(b, 5)], pa.binary())], ["block"])


def _blocks(bins: Bins, columns: list[int], n_targets: int, settings: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = Block(whole.slice(at, BLOCK), bins, columns, n_targets)
                b.start(*settings)
                yield _written(b)

    return run


def _rewriter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, frontier, bins = shared.value
        wanted = np.zeros(len(trees.feature), bool)
        wanted[frontier] = True
        for b in _each_block(batches):
            b.advance(trees, _dest(bins), wanted)
            b.compact()
            if b.n:
                yield _written(b)

    return run


def _counter(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, frontier, features, bins, target = shared.value
        cells = len(bins.names) * bins.width
        held, size = [], 0
        for b in _each_block(batches):
            for part in histograms(b, trees, frontier, features, bins, target):
                held.append(part)
                size += len(part[0])
                if size > HELD:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    # Histograms that do not fit go out as they are, and meet the rest at their group.
                    if size > HELD // 2:
                        yield _sent(*held[0], cells, buckets)
                        held, size = [], 0
        if held:
            yield _sent(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))), cells, buckets)

    return run


def _sent(keys: np.ndarray, stats: np.ndarray, cells: int, buckets: int) -> pa.RecordBatch:
    """Histograms by the group that their nodes are in."""
    bucket = keys // cells % buckets
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(k, order[lo:hi]) for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in rows], pa.int32()),
            pa.array([keys[x].tobytes() for _, x in rows], pa.binary()),
            pa.array([stats[x].tobytes() for _, x in rows], pa.binary()),
        ],
        ["bucket", "keys", "stats"],
    )


def _picker(n: int, width: int, categorical: np.ndarray, words: int):
    def run(t: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("keys").to_pylist()])
        stats = np.concatenate([np.frombuffer(x, float).reshape(-1, 3) for x in t.column("stats").to_pylist()])
        found = best_splits(*_summed(keys, stats), n, width, categorical, words)
        return pa.table({c: pa.array([np.ascontiguousarray(found[c].astype(KINDS[c])).tobytes()], pa.binary()) for c in PARTS})

    return run


# -- gap cells and traffic cells ------------------------------------------------


def gap_cells(cells: DataFrame, preset: Preset, cfg: GridConfig = DEFAULT, use: str | None = None) -> Packed:
    """Cells of ``features.packed_*``: the features of ``preset`` but the destination, and the gap map."""
    categories, numbers = feature_columns(preset, GAP_COLUMNS)
    arrays = {"dests": F.coalesce(F.map_keys("gaps"), F.array()), "gap": F.coalesce(F.map_values("gaps"), F.array())}
    return Packed(
        cells.withColumns(arrays), ("date", "timeslice", "districtID"), tuple(c for c in categories if c != DEST),
        tuple(c for c in numbers if c != DEST), ("gap",), cfg.n_zones + 1, use=use,
    )


def traffic_cells(df: DataFrame, preset: Preset) -> Packed:
    """Traffic rows with one response for each level; rows without one of the levels are left out."""
    columns = [c for c in TRAFFIC_COLUMNS if c not in LEVELS]
    whole = df.where(" and ".join(f"{t} is not null" for t in LEVELS))
    arrays = {"dests": F.array(F.lit(0)), **{f"{t}_": F.array(t) for t in LEVELS}}
    categories = tuple(c for c in columns if c in preset.categories)
    return Packed(
        whole.withColumns(arrays), ("date", "timeslice", "district"), categories,
        tuple(c for c in columns if c not in categories), tuple(f"{t}_" for t in LEVELS), 1,
    )


def rollup(scored: DataFrame, cut: float | None = 0.5) -> DataFrame:
    """(date, timeslice, districtID, gap, predict): ``forecast_rollup`` of scored gap cells, without a shuffle."""
    small = F.col("gap_predict") if cut is None else F.transform("gap_predict", lambda p: F.when(p < cut, 0.0).otherwise(p))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    gap = F.aggregate(F.coalesce(F.map_values("gaps"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return scored.select("date", "timeslice", "districtID", gap.alias("gap"), total(small).alias("predict"))
