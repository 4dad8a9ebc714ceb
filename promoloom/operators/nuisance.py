"""Out-of-fold residuals: what the controls do not explain.

``cells`` and ``linear`` need no model per fold: leave-fold-out statistics are
the totals minus the fold's own, so one aggregation of the rows serves every
fold (and every group of ``by``).  ``gbt`` fits boosted trees per fold and group, all in shared passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULTS
from ..functions.hashing import fold_of, panel_key
from ..storage import bounded, join_null_safe, settle
from .boosting import tree_residuals
from .features import CONTROLS


#: Rows whose means shift the values before sums of products are taken.
SHIFT_ROWS = 1_000


@dataclass(frozen=True)
class Nuisance:
    """How the controls enter: ``cells``, ``linear`` or ``gbt``.

    ``cells`` are the columns whose combinations share a mean; ``controls`` are
    numeric; ``labels`` get their own level (one dummy each).
    """

    kind: str = "linear"
    controls: tuple[str, ...] = CONTROLS
    labels: tuple[str, ...] = ("category",)
    cells: tuple[str, ...] = ("category", "month_num")
    max_iter: int = 100

    def columns(self) -> list[str]:
        used = self.cells if self.kind == "cells" else (*self.controls, *self.labels)
        return list(dict.fromkeys(used))


def with_folds(df: DataFrame, folds: int = DEFAULTS.folds, seed: int = DEFAULTS.seed) -> DataFrame:
    """Add ``fold`` from the hash of the row key, the same on any cluster."""
    return df.withColumn("fold", fold_of(panel_key(), folds, seed))


def residuals(df: DataFrame, targets: list[str], nuisance: Nuisance,
              by: list[str] | None = None, only_fold: int | None = None) -> DataFrame:
    """Add ``<target>_r`` for every target, fitted outside the row's ``fold``.

    With ``only_fold`` the rows of that fold alone are predicted and returned.
    """
    by = list(by or [])
    if nuisance.kind == "cells":
        return _cell_residuals(df, targets, list(nuisance.cells), by, only_fold)
    if nuisance.kind == "linear":
        return _linear_residuals(df, targets, nuisance, by, only_fold)
    if nuisance.kind == "gbt":
        return tree_residuals(df, targets, list(nuisance.controls), list(nuisance.labels), by, nuisance.max_iter, only_fold)
    raise ValueError(f"unknown nuisance {nuisance.kind!r}")


def _fold_numbers(stats: DataFrame) -> list[int]:
    return sorted(r[0] for r in stats.select("fold").distinct().collect())


def _to_other_folds(stats: DataFrame, folds: list[int]) -> DataFrame:
    """Send every fold's sums to each other fold, where they train that fold's model."""
    everywhere = F.array(*[F.lit(f) for f in folds]).cast("array<int>")
    return stats.withColumn("fold", F.explode(F.array_except(everywhere, F.array("fold"))))


def _cell_residuals(df: DataFrame, targets: list[str], cells: list[str], by: list[str],
                    only_fold: int | None) -> DataFrame:
    keys = list(dict.fromkeys(by + cells))
    names = ["_n"] + [f"_s_{t}" for t in targets]
    stats = settle(df.groupBy(*keys, "fold").agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.sum(t).alias(f"_s_{t}") for t in targets]))
    outside = _to_other_folds(stats, _fold_numbers(stats))

    def means(group: list[str], prefix: str) -> DataFrame:
        sums = outside.groupBy(*group, "fold").agg(*[F.sum(c).alias(c) for c in names])
        return sums.select(*group, "fold", *[(F.col(f"_s_{t}") / F.col("_n")).alias(f"{prefix}{t}")
                                             for t in targets])

    # A cell seen in one fold only takes the mean of all rows outside the fold.
    table = join_null_safe(stats.select(*keys, "fold"), means(keys, "_m_"), [*keys, "fold"], "left")
    table = join_null_safe(table, bounded(means(by, "_all_")), [*by, "fold"], "left")
    table = table.select(*keys, "fold", *[F.coalesce(f"_m_{t}", f"_all_{t}").alias(f"_m_{t}")
                                          for t in targets])
    rows = df if only_fold is None else df.filter(F.col("fold") == only_fold)
    joined = join_null_safe(rows, bounded(table), [*keys, "fold"], "left")
    return joined.select(*df.columns, *[(F.col(t) - F.col(f"_m_{t}")).alias(f"{t}_r")
                                        for t in targets])


def _summed(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Element-wise sum of an array column per key."""
    long = rows.select(*keys, F.posexplode(column).alias("_pos", "_val"))
    sums = long.groupBy(*keys, "_pos").agg(F.sum("_val").alias("_val"))
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_val"))).alias("_p"))
    return packed.select(*keys, F.col("_p._val").alias(column))


def _linear_residuals(df: DataFrame, targets: list[str], nuisance: Nuisance, by: list[str],
                      only_fold: int | None) -> DataFrame:
    xs = list(nuisance.controls)
    keys = list(dict.fromkeys(by + list(nuisance.labels)))
    p, q = len(xs), len(targets)
    pairs = [(i, j) for i in range(p) for j in range(i, p)] + \
            [(i, p + k) for i in range(p) for k in range(q)]
    # Sums of products lose digits when means are large against spreads; slopes don't depend on a shift,
    # so that the means of a few rows will do.
    centre = df.limit(SHIFT_ROWS).agg(*[F.avg(F.col(v).cast("double")).alias(v) for v in xs + targets]).first()
    shift = [float(centre[v] or 0.0) for v in xs + targets]
    value = [F.col(v).cast("double") - F.lit(m) for v, m in zip(xs + targets, shift)]
    # One array per (labels, fold): count, sums, then sums of products.
    stats = settle(_summed(_batch_moments(df, [*keys, "fold"], value, pairs), [*keys, "fold"], "_m"))
    outside = settle(_summed(_to_other_folds(stats, _fold_numbers(stats)), [*keys, "fold"], "_m"))

    # Dummies per label = centring by label: sums of products within the label.
    first, second = (F.array(*[F.lit(pair[side]) for pair in pairs]) for side in (0, 1))
    level = F.slice("_m", 1, 1 + p + q)
    centred = F.transform(
        F.sequence(F.lit(0), F.lit(len(pairs) - 1)),
        lambda i: F.get("_m", i + F.lit(1 + p + q)) - F.get("_m", F.get(first, i) + 1)
        * F.get("_m", F.get(second, i) + 1) / F.get("_m", F.lit(0)))
    within = outside.select(*by, "fold", F.concat(level, centred).alias("_m"))
    gram = _summed(within, [*by, "fold"], "_m")

    place = {pair: 1 + p + q + at for at, pair in enumerate(pairs)}
    a = [place[min(i, j), max(i, j)] for i in range(p) for j in range(p)]
    b = [place[i, p + k] for k in range(q) for i in range(p)]
    chosen = gram.select(*by, "fold", _gather("_m", a).alias("_a"), _gather("_m", b).alias("_b"),
                         _means(F.col("_m"), p + q).alias("_all"))
    fitted = bounded(solve_rows(chosen, "_a", "_b", p, q))
    table = join_null_safe(stats.select(*keys, "fold"), outside, [*keys, "fold"], "left")
    table = join_null_safe(table, fitted, [*by, "fold"])
    # A label seen in one fold only takes the mean of all rows outside the fold.
    mean = F.coalesce(_means(F.col("_m"), p + q), F.col("_all"))
    table = table.select(*keys, "fold", "_beta", mean.alias("_mean"))
    table = table.select(*keys, "fold", "_beta", *[
        (F.get("_mean", F.lit(p + k)) - _weighted("_beta", k * p, [F.get("_mean", F.lit(i)) for i in range(p)]))
        .alias(f"_i{k}") for k in range(q)])
    rows = df if only_fold is None else df.filter(F.col("fold") == only_fold)
    joined = join_null_safe(rows, bounded(table), [*keys, "fold"], "left")
    # As arrays: a term per control makes a method that the JVM leaves uncompiled.
    joined = joined.withColumn("_x", F.array(*value[:p]).cast("array<double>"))
    return joined.select(*df.columns, *[
        (value[p + k] - F.col(f"_i{k}") - _product(F.slice("_beta", k * p + 1, p), F.col("_x"))).alias(f"{t}_r")
        for k, t in enumerate(targets)])


def _batch_moments(df: DataFrame, keys: list[str], value: list[Column], pairs: list[tuple[int, int]]) -> DataFrame:
    """Per Arrow batch and key: an array of the count, the sums and the sums of products of ``pairs``.

    A matrix product per batch and key takes the place of one aggregate
    expression per pair.  The values travel as one array column, so that the
    plan has the same size for any number of controls.  Rows with a missing
    value count nowhere.
    """
    rows = df.select(*keys, F.array(*value).alias("_x"))
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*[f"`{k}` {t}" for k, t in zip(keys, kinds)], "_m array<double>"])
    left, right, width = [i for i, _ in pairs], [j for _, j in pairs], len(value)

    def sums(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            whole = ~np.isnan(x).any(1)
            names = pa.Table.from_batches([batch.select(keys)]).filter(pa.array(whole))
            if not names.num_rows:
                continue
            at = names.append_column("_at", pa.array(np.flatnonzero(whole)))
            groups = at.group_by(keys).aggregate([("_at", "list")])
            moments = []
            for rows_of in groups["_at_list"].to_pylist():
                part = x[rows_of]
                gram = part.T @ part
                moments.append([float(len(part)), *part.sum(0), *gram[left, right]])
            out = groups.select(keys).append_column("_m", pa.array(moments, pa.list_(pa.float64())))
            yield from out.to_batches()

    return rows.mapInArrow(sums, schema)


def _gather(array: str, places: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get(array, i))


def _means(m: Column, size: int) -> Column:
    """Means from an array that starts with a count and ``size`` sums."""
    return F.when(m.isNotNull(), F.transform(F.slice(m, 2, size), lambda s: s / F.get(m, F.lit(0))))


def _weighted(beta: str, start: int, of: list[Column]) -> Column:
    """Sum of ``of`` weighted by consecutive elements of an array."""
    return reduce(Column.__add__, [F.get(beta, F.lit(start + i)) * v for i, v in enumerate(of)],
                  F.lit(0.0))


def _product(a: Column, b: Column) -> Column:
    """Sum of the products of two arrays' elements, from the first on; null if one is missing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def solve_rows(df: DataFrame, a: str, b: str, p: int, q: int) -> DataFrame:
    """Replace arrays ``a`` (p x p) and ``b`` (q x p) by least-squares ``_beta`` (q x p)."""
    kept = [f for f in df.schema.fields if f.name not in (a, b)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept],
                        "_beta array<double>"])
    names = [f.name for f in kept]

    def solve(batches: Iterator) -> Iterator:
        import numpy as np

        for pdf in batches:
            betas = []
            for left, right in zip(pdf[a], pdf[b]):
                gram = np.asarray(left, float).reshape(p, p)
                rhs = np.asarray(right, float).reshape(q, p).T
                # Scaling the columns keeps the rank decision independent of units.
                size = np.sqrt(np.clip(np.diag(gram), 0.0, None))
                size[size == 0.0] = 1.0
                scaled = gram / np.outer(size, size)
                coef = np.linalg.lstsq(scaled, rhs / size[:, None], rcond=1e-10)[0] / size[:, None]
                betas.append(coef.T.ravel().tolist())
            out = pdf[names].copy()
            out["_beta"] = betas
            yield out

    return df.mapInPandas(solve, schema)
