"""Boosted regression trees for all folds, targets and groups in shared passes.

A model is fitted for every (group, fold, target) outside the fold, in one of two ways:

- Where a model's rows fit a task (``WHOLE_BYTES``, by the counted rows of the largest group), each
  model's binned rows go to a task of its own, which grows all its trees; a round then costs no job.
- Beyond that, all models grow together: one pass over the rows makes the histograms of a level of every
  model's current tree, per node, feature and bin, in each task; the sums of the
  tasks meet by model, where the best splits are found.  What moves is
  histograms, whose size doesn't depend on the rows, and split decisions.

Both make the same trees.  In passes every row carries the present prediction of
each fold's model, its own fold's among them: that one has never seen the row,
and at the end gives its residual.  The predictions are written once a round, in
the pass that also makes the next round's first histograms; the round before is then deleted.

Features share codes: a histogram of the combinations of two or three of them has few
cells, is counted in one go, and holds the histogram of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import bounded, forget, join_null_safe, settle, spread

#: Bins of a feature (the first is for missing values), levels of a tree, and rows that a leaf must have.
BINS, LEVELS, LEAF_ROWS = 64, 5, 20
#: How much of each tree counts.
RATE = 0.1
#: Models whose histograms a task holds at once; more groups are fitted in turns.
MODELS = 200
#: A row is the work of so many plain ones.
SPREAD = 2
#: Rows of a block, and combinations that one code of features tells apart.
BLOCK_ROWS, JOINT = 50_000, 4_096
#: The most that the rows of a model may take in the one task that fits it, and the bytes of a row besides its codes.
WHOLE_BYTES, ROW_BYTES = 256_000_000, 64
#: Error of the bin borders' ranks, as a share of the rows.
RANK_ERROR = 0.002


class Tree(NamedTuple):
    """Trees of all models; nodes of a level are numbered from the left, a node without a split sends all rows left."""

    feature: np.ndarray  # model, node
    above: np.ndarray  # model, node: bins above it go right
    value: np.ndarray  # model, leaf


class Layout(NamedTuple):
    features: int
    folds: int
    targets: int
    groups: int

    def models(self) -> int:
        return self.groups * self.folds * self.targets


def bin_borders(df: DataFrame, features: list[str], bins: int = BINS) -> np.ndarray:
    """Rising borders of each feature's bins, from approximate quantiles of all rows in one pass."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    found = df.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(features, shares, RANK_ERROR)
    out = np.full((len(features), bins - 2), np.inf)
    for row, borders in zip(out, found):
        own = np.unique(borders)
        row[:len(own)] = own
    return out


def binned(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Bin of each value: 0 if missing, else 1 and the number of borders below it."""
    out = np.empty(values.shape, np.uint8)
    for j, own in enumerate(borders):
        out[:, j] = np.where(np.isnan(values[:, j]), 0, 1 + np.searchsorted(own, values[:, j]))
    return out


class Code(NamedTuple):
    """Features whose bins make up one number, the last the quickest to change."""

    features: tuple[int, ...]
    widths: tuple[int, ...]  # bins that a feature may have

    def size(self) -> int:
        return math.prod(self.widths)


def shared_codes(borders: np.ndarray, most: int = JOINT) -> list[Code]:
    """All features in few codes of at most ``most`` numbers, or of one feature."""
    widths = (borders < np.inf).sum(1) + 2
    out: list[Code] = []
    for j in np.argsort(-widths, kind="stable").tolist():
        width = int(widths[j])
        at = next((i for i, c in enumerate(out) if c.size() * width <= most), None)
        if at is None:
            out.append(Code((j,), (width,)))
        else:
            out[at] = Code((*out[at].features, j), (*out[at].widths, width))
    return out


def coded(x: np.ndarray, codes: list[Code]) -> np.ndarray:
    """Code and row: the number of each row (``x`` is feature, row)."""
    out = np.zeros((len(codes), x.shape[1]), np.uint16)
    for row, code in zip(out, codes):
        for j, width in zip(*code):
            row *= np.uint16(width)
            row += x[j]
    return out


def _spread_out(out: np.ndarray, code: Code, counted: np.ndarray) -> None:
    """Add what is counted per (node, number of the code) to ``out``, which is (node, feature, bin)."""
    cells = counted.reshape(-1, *code.widths)
    for axis, (j, width) in enumerate(zip(*code), 1):
        out[:, j, :width] += cells.sum(tuple(a for a in range(1, cells.ndim) if a != axis))


def place_in(feature: np.ndarray, above: np.ndarray, x: np.ndarray, tree: np.ndarray | int, levels: int) -> np.ndarray:
    """Node of each column of ``x`` (feature, row) after ``levels`` levels; ``tree`` is the row of ``feature`` and ``above`` it goes down."""
    n, flat = x.shape[1], x.ravel()
    at, rows, first = np.zeros(n, np.int64), np.arange(n), tree * feature.shape[1]
    starts, borders = (feature * n).ravel(), above.ravel()
    for level in range(levels):
        node = at + (first + (1 << level) - 1)
        right = flat.take(starts.take(node) + rows) > borders.take(node)
        at += at
        at += right
    return at


class Block(NamedTuple):
    """Some thousand rows as arrays.  A block is one record of binaries, so that no row is handled by itself between passes."""

    row: np.ndarray
    fold: np.ndarray
    group: np.ndarray
    y: np.ndarray  # target, row
    x: np.ndarray  # feature, row
    f: np.ndarray  # fold, target, row: predictions


_FIELDS = [(c, np.dtype(k)) for c, k in zip(Block._fields, ("<i8", "<i4", "<i4", "<f8", "u1", "<f8"))]


def _blocks(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[Block]:
    shapes = ((), (), (), (layout.targets,), (layout.features,), (layout.folds, layout.targets))
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(*[np.frombuffer(batch.column(c)[i].as_buffer(), kind).reshape(*shape, -1) for (c, kind), shape in zip(_FIELDS, shapes)])


def _packed(b: Block) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(v, kind).tobytes()], pa.binary()) for v, (_, kind) in zip(b, _FIELDS)]


def _of(values: np.ndarray, fold: int, target: int, layout: Layout) -> np.ndarray:
    """The groups' models of a fold and target."""
    return values.reshape(layout.groups, layout.folds, layout.targets, *values.shape[1:])[:, fold, target]


def _add(sums: np.ndarray, b: Block, tree: Tree, layout: Layout, level: int, codes: list[Code]) -> None:
    """Add a block's rows and residuals per model, node, feature and bin."""
    nodes, numbers = sums.shape[1], coded(b.x, codes)
    for fold in range(layout.folds):
        at = np.flatnonzero(b.fold != fold)
        if not len(at):
            continue
        x, own_numbers = np.ascontiguousarray(b.x[:, at]), numbers[:, at]
        group = b.group[at] if layout.groups > 1 else 0
        for t in range(layout.targets):
            node = place_in(_of(tree.feature, fold, t, layout), _of(tree.above, fold, t, layout), x, group, level)
            cell = group * nodes + node
            left = b.y[t, at] - b.f[fold, t, at]
            own = np.zeros((layout.groups * nodes, *sums.shape[2:]))
            for code, number in zip(codes, own_numbers):
                key, size = cell * code.size() + number, len(own) * code.size()
                _spread_out(own[..., 0], code, np.bincount(key, minlength=size))
                _spread_out(own[..., 1], code, np.bincount(key, left, size))
            _of(sums, fold, t, layout)[...] += own.reshape(layout.groups, *sums.shape[1:])


def best_splits(sums: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the feature and the last bin on the left, and the mean residuals of both sides.

    ``sums`` is node, feature, bin, (rows, residuals).  A node without a useful split keeps its rows together, on the left.
    """
    n, s = np.cumsum(sums[..., 0], 2), np.cumsum(sums[..., 1], 2)
    total_n, total_s = n[:, :1, -1:], s[:, :1, -1:]
    rest_n, rest_s = total_n - n, total_s - s
    fits = (n >= leaf_rows) & (rest_n >= leaf_rows)
    gain = np.where(fits, s ** 2 / np.maximum(n, 1) + rest_s ** 2 / np.maximum(rest_n, 1) - total_s ** 2 / np.maximum(total_n, 1), 0)
    flat = gain.reshape(len(gain), -1)
    # Of splits that are equal but for rounding, the first.
    top = (flat >= flat.max(1, keepdims=True) * (1 - 1e-10)).argmax(1)
    node = np.arange(len(top))
    split = flat[node, top] > 1e-12 * np.maximum(1, np.abs(total_s[:, 0, 0]))
    feature, above = np.where(split, top // gain.shape[2], 0), np.where(split, top % gain.shape[2], 255)
    whole = total_s[:, 0, 0] / np.maximum(total_n[:, 0, 0], 1)
    mean = lambda a, b: (a / np.maximum(b, 1))[node, top // gain.shape[2], top % gain.shape[2]]
    values = np.stack([np.where(split, mean(s, n), whole), np.where(split, mean(rest_s, rest_n), whole)], 1)
    return feature, above, values


def grown(numbers: np.ndarray, y: np.ndarray, codes: list[Code], features: int, rounds: int, bins: int, levels: int,
          leaf_rows: int, rate: float) -> tuple[float, Tree]:
    """The mean of ``y`` and one model's trees of all rounds (round, node) from the rows' ``numbers`` (code, row).

    Only the smaller side of a split is counted; the other has the rest of its node.
    """
    nodes = (1 << levels) - 1
    trees = Tree(np.zeros((rounds, nodes), np.int64), np.full((rounds, nodes), 255), np.zeros((rounds, 1 << levels)))
    code_of = {j: i for i, code in enumerate(codes) for j in code.features}
    bin_of = {j: own.ravel().astype(np.uint8) for code in codes for j, own in zip(code.features, np.indices(code.widths))}
    start = float(y.mean())
    left = y - start

    def histogram(rows: np.ndarray) -> np.ndarray:
        own, rest = np.zeros((1, features, bins, 2)), left.take(rows)
        for code, number in zip(codes, numbers):
            key = number.take(rows).astype(np.intp)
            _spread_out(own[..., 0], code, np.bincount(key, minlength=code.size()))
            _spread_out(own[..., 1], code, np.bincount(key, rest, code.size()))
        return own[0]

    root = np.zeros((1, features, bins, 2))
    for code, number in zip(codes, numbers):
        _spread_out(root[..., 0], code, np.bincount(number, minlength=code.size()))
    for r in range(rounds):
        root[..., 1] = 0
        for code, number in zip(codes, numbers):
            _spread_out(root[..., 1], code, np.bincount(number, left, code.size()))
        sums, parts = root, [np.arange(len(y))]
        for level in range(levels):
            first, last = (1 << level) - 1, level == levels - 1
            feature, above, values = best_splits(sums, leaf_rows)
            trees.feature[r, first:first + len(feature)], trees.above[r, first:first + len(above)] = feature, above
            if last:
                trees.value[r] = values.ravel()
            below, sides = np.zeros((2 * len(sums), *sums.shape[1:])), []
            for k, (rows, j, border) in enumerate(zip(parts, feature, above)):
                right = (bin_of[j] > border).take(numbers[code_of[j]].take(rows))
                if last:
                    left[rows] = left.take(rows) - (rate * values[k]).take(right)
                    continue
                # Places, since picking by true and false takes several times as long.
                sides += [rows.take(np.flatnonzero(~right)), rows.take(np.flatnonzero(right))]
                few = len(sides[-1]) < len(sides[-2])
                below[2 * k + few] = histogram(sides[-1 if few else -2])
                rest = sums[k] - below[2 * k + few]
                rest[..., 1][rest[..., 0] == 0] = 0
                below[2 * k + (not few)] = rest
            sums, parts = below, sides
    return start, trees


def _grown_whole(state: DataFrame, layout: Layout, codes: list[Code], rounds: int, *how) -> tuple[np.ndarray, Tree]:
    """Start and trees of all models (model, round, node), each model grown by one task."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, layout):
            numbers = coded(b.x, codes)
            for group in np.unique(b.group):
                for fold in range(layout.folds):
                    at = np.flatnonzero((b.group == group) & (b.fold != fold))
                    if len(at):
                        first = (int(group) * layout.folds + fold) * layout.targets
                        yield pa.RecordBatch.from_arrays([
                            pa.array(range(first, first + layout.targets), pa.int32()),
                            pa.array([numbers[:, at].tobytes()] * layout.targets, pa.binary()),
                            pa.array([y[at].tobytes() for y in b.y], pa.binary())], names=["model", "numbers", "y"])

    def fitted(table: pa.Table) -> pa.Table:
        numbers = np.concatenate([np.frombuffer(v.as_buffer(), np.uint16).reshape(len(codes), -1) for v in table["numbers"]], 1)
        y = np.concatenate([np.frombuffer(v.as_buffer(), float) for v in table["y"]])
        start, trees = grown(numbers, y, codes, layout.features, rounds, *how)
        return pa.table({"model": table["model"].slice(0, 1), "start": [start],
                         **{c: pa.array([v.tobytes()], pa.binary()) for c, v in trees._asdict().items()}})

    kinds = (np.int64, np.int64, float)
    levels, models = how[1], layout.models()
    start, nodes = np.zeros(models), (1 << levels) - 1
    trees = Tree(np.zeros((models, rounds, nodes), np.int64), np.full((models, rounds, nodes), 255), np.zeros((models, rounds, 1 << levels)))
    by_model = state.mapInArrow(dealt, "model int, numbers binary, y binary").repartitionById(models, "model")
    for r in by_model.groupBy("model").applyInArrow(fitted, "model int, start double, feature binary, above binary, value binary").collect():
        start[r.model] = r.start
        for all_models, own, kind in zip(trees, r[2:], kinds):
            all_models[r.model] = np.frombuffer(own, kind).reshape(rounds, -1)
    return start, trees


_STATE = ", ".join(f"`{c}` binary" for c in Block._fields)
_HIST = "model int, sums binary"


def _residuals(state: DataFrame, layout: Layout, names: list[str], start: np.ndarray | None, trees: Tree, levels: int, rate: float) -> DataFrame:
    """The rows that a model has not seen, each with its residuals: less ``start``, or else its prediction so far, and what the trees add."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, layout):
            for fold in range(layout.folds):
                at = np.flatnonzero(b.fold == fold)
                x, group, left = np.ascontiguousarray(b.x[:, at]), b.group[at], []
                for t in range(layout.targets):
                    feature, above, value = (_of(v, fold, t, layout) for v in trees)
                    f = b.f[fold, t, at] if start is None else _of(start, fold, t, layout)[group]
                    for r in range(value.shape[1]):
                        leaf = group * value.shape[2] + place_in(feature[:, r], above[:, r], x, group if layout.groups > 1 else 0, levels)
                        f += rate * value[:, r].ravel().take(leaf)
                    left.append(pa.array(b.y[t, at] - f))
                yield pa.RecordBatch.from_arrays([pa.array(b.row[at]), *left], names=names)

    return state.mapInArrow(run, ", ".join([f"`{names[0]}` long", *[f"`{c}` double" for c in names[1:]]]))


def _fit(state: DataFrame, layout: Layout, names: list[str], codes: list[Code], whole: bool, rounds: int, bins: int, levels: int, leaf_rows: int,
         rate: float) -> DataFrame:
    """Row and residuals (``names``) of the rows that some model has not seen."""
    if whole:
        return _residuals(state, layout, names, *_grown_whole(state, layout, codes, rounds, bins, levels, leaf_rows, rate), levels, rate)
    models, nodes = layout.models(), (1 << levels) - 1
    none = Tree(np.zeros((models, nodes), np.int64), np.full((models, nodes), 255), np.zeros((models, 1 << levels)))

    def histograms(sums: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(sums[..., 0].reshape(len(sums), -1).any(1))
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([sums[m].tobytes() for m in used], pa.binary())],
                                          names=["model", "sums"])

    def level_pass(tree: Tree, level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((models, 1 << level, layout.features, bins, 2))
            for b in _blocks(batches, layout):
                _add(sums, b, tree, layout, level, codes)
            yield histograms(sums)

        return run

    def update_pass(tree: Tree):
        """Rows with the last tree's values added, and the next tree's first histograms."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((models, 1, layout.features, bins, 2))
            fields = [*Block._fields, "model", "sums"]
            for b in _blocks(batches, layout):
                f, group = b.f.copy(), b.group if layout.groups > 1 else 0
                for fold in range(layout.folds):
                    for t in range(layout.targets):
                        feature, above, value = (_of(v, fold, t, layout) for v in tree)
                        f[fold, t] += rate * value.ravel().take(group * value.shape[1] + place_in(feature, above, b.x, group, levels))
                b = b._replace(f=f)
                _add(sums, b, none, layout, 0, codes)
                yield pa.RecordBatch.from_arrays([*_packed(b), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names=fields)
            h = histograms(sums)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(h.num_rows, pa.binary()) for _ in Block._fields], *h.columns], names=fields)

        return run

    def splits_of(level: int):
        def run(table: pa.Table) -> pa.Table:
            sums = np.zeros(((1 << level) * layout.features * bins * 2))
            for s in table["sums"]:
                sums += np.frombuffer(s.as_buffer(), float)
            feature, above, values = best_splits(sums.reshape(1 << level, layout.features, bins, 2), leaf_rows)
            return pa.table({"model": table["model"].slice(0, 1), "feature": [feature.tolist()], "above": [above.tolist()],
                             "value": [values.ravel().tolist()]})

        return run

    def settled(hist: DataFrame, level: int, tree: Tree) -> None:
        """Put the best splits of a level into the tree; a few numbers a node reach the driver."""
        found = hist.groupBy("model").applyInArrow(splits_of(level), "model int, feature array<long>, above array<long>, value array<double>")
        first = (1 << level) - 1
        for r in found.collect():
            tree.feature[r.model, first:first + len(r.feature)] = r.feature
            tree.above[r.model, first:first + len(r.above)] = r.above
            if level == levels - 1:
                tree.value[r.model] = r.value

    tree, both = none, f"{_STATE}, {_HIST}"
    for _ in range(rounds):
        old, written = state, settle(state.mapInArrow(update_pass(tree), both))
        state = written.filter("row is not null").drop("model", "sums")
        forget(old)
        state.settled_at = written.settled_at
        tree = Tree(none.feature.copy(), none.above.copy(), none.value.copy())
        settled(written.filter("model is not null").select("model", "sums"), 0, tree)
        for level in range(1, levels):
            settled(state.mapInArrow(level_pass(tree, level), _HIST), level, tree)
    return _residuals(state, layout, names, None, Tree(*[v[:, None] for v in tree]), levels, rate)


def tree_residuals(df: DataFrame, targets: list[str], controls: list[str], labels: list[str], by: list[str] | None = None,
                   rounds: int = 100, only_fold: int | None = None, bins: int = BINS, levels: int = LEVELS,
                   leaf_rows: int = LEAF_ROWS, rate: float = RATE) -> DataFrame:
    """Add ``<target>_r``: the target less what trees fitted outside the row's ``fold`` predict.

    Models are fitted within each combination of ``by``.  ``labels`` enter as
    their place in the order of names (beyond the bins, neighbours share one);
    missing controls have a bin of their own.  A row with a missing target has no
    residual and teaches nothing.  With ``only_fold`` that fold alone is predicted and returned.
    """
    by = list(by or [])
    names = {"row": "_row", "fold": "_fold_no", "group": "_group_no"}
    rows = df.withColumn(names["row"], F.monotonically_increasing_id())
    folds = [r[0] for r in df.select("fold").distinct().orderBy("fold").collect()] if only_fold is None else [only_fold]
    fold_no = F.coalesce(*[F.when(F.col("fold") == f, F.lit(i)) for i, f in enumerate(folds)], F.lit(len(folds)))
    rows = rows.withColumn(names["fold"], fold_no.cast("int"))
    for i, label in enumerate(labels):
        rows = join_null_safe(rows, _places(df.select(label).distinct(), [label], f"_l{i}"), [label], "left")
    rows = (join_null_safe(rows, _places(df.select(*by).distinct(), by, names["group"]), by) if by
            else rows.withColumn(names["group"], F.lit(0)))
    rows = settle(rows)
    features = [*controls, *[f"_l{i}" for i in range(len(labels))]]
    borders = bin_borders(rows, features, bins)
    last, largest = rows.groupBy(names["group"]).agg(F.count(F.lit(1)).alias("n")).agg(F.max(names["group"]), F.max("n")).first()
    groups = (last or 0) + 1
    turn = max(1, MODELS // max(1, len(folds) * len(targets)))

    turn = min(turn, groups)
    # Many groups multiply the cells of a code in the passes; a task of its own has one group.
    whole = (largest or 0) * (2 * len(shared_codes(borders)) + ROW_BYTES) <= WHOLE_BYTES
    codes = shared_codes(borders, JOINT if whole else JOINT // turn)

    def state_of(means: np.ndarray):
        """Blocks of rows; ``means`` (fold, target, group) are the first predictions, if the rows carry any."""
        def block(rows: pa.Table) -> pa.RecordBatch:
            n = rows.num_rows
            flat = lambda name, *shape: rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, *shape)
            row, fold, group = (rows[c].to_numpy() for c in ("row", "fold", "group"))
            x = binned(flat("v", len(features)), borders)
            b = Block(row, fold, group, flat("y", len(targets)).T, x.T, means[:, :, group] if means.size else means)
            return pa.RecordBatch.from_arrays(_packed(b), names=Block._fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(h.num_rows for h in held) >= BLOCK_ROWS:
                    yield block(pa.Table.from_batches(held))
                    held = []
            if any(h.num_rows for h in held):
                yield block(pa.Table.from_batches(held))

        return run

    known = rows
    for t in targets:
        known = known.filter(F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double")))
    parts = None
    for first in range(0, groups, turn):
        layout = Layout(len(features), len(folds), len(targets), min(turn, groups - first))
        some = known.filter(F.col(names["group"]).between(first, first + turn - 1)).select(
            F.col(names["row"]).alias("row"), F.col(names["fold"]).alias("fold"), (F.col(names["group"]) - first).alias("group"),
            F.array(*[F.col(t).cast("double") for t in targets]).alias("y"),
            F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
        # Trees add to the mean outside the fold.
        means = np.zeros((layout.folds, layout.targets, 0)) if whole else _start(some, layout)
        # Small tables come in one file; every pass then has as many tasks as these.
        state = settle(spread(some, SPREAD).mapInArrow(state_of(means), _STATE))
        part = _fit(state, layout, [names["row"], *[f"{t}_r" for t in targets]], codes, whole, rounds, bins, levels, leaf_rows, rate)
        parts = part if parts is None else parts.unionByName(part)
    joined = rows.filter(F.col(names["fold"]) < len(folds)).join(parts, names["row"], "left")
    return joined.select(*df.columns, *[f"{t}_r" for t in targets])


def _places(values: DataFrame, by: list[str], name: str) -> DataFrame:
    """0-based place of each combination of ``by`` in its order; there are few."""
    return bounded(values.withColumn("_key", F.struct(*by)).withColumn(
        name, (F.row_number().over(W.orderBy(F.col("_key").asc_nulls_first())) - 1).cast("int")).drop("_key"))


def _start(rows: DataFrame, layout: Layout) -> np.ndarray:
    """Fold, target, group: each model's mean of its target outside its fold, as every row's first prediction."""
    folds, targets = range(layout.folds), range(layout.targets)
    outside = [F.avg(F.when(F.col("fold") != fold, F.get("y", F.lit(t)))) for fold in folds for t in targets]
    out = np.zeros((layout.folds, layout.targets, layout.groups))
    for r in rows.groupBy("group").agg(F.array(*[F.coalesce(m, F.lit(0.0)) for m in outside]).alias("f")).collect():
        out[:, :, r.group] = np.reshape(r.f, out.shape[:2])
    return out
