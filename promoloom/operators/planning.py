"""Choosing a discount per SKU under budget, slot and group limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULTS, NO_GROUP
from ..functions.economics import discount_economics
from ..storage import attach, bounded, join_null_safe, settle, spread
from .numbering import top_per_group
from .quantiles import group_quantiles

PLAN_COLUMNS = ("sku", "cat", "group", "d", "net", "net_robust", "rev", "spend")


def attach_prices(panel: DataFrame, price_table: DataFrame) -> DataFrame:
    """Unit price (entry price per piece, to a tenth as in the price sheet) and group of each SKU."""
    prices = price_table.select(F.col("sku").cast("string").alias("sku"),
                                # Decimals, so that a tie is a tie whatever the last bit of the product.
                                F.bround(F.col("entry_piece").cast("decimal(18,6)"), 1).cast("double")
                                .alias("price_unit"),
                                F.col("grp").alias("group"))
    return panel.join(bounded(prices), "sku", "left").fillna({"group": NO_GROUP})


def baseline_table(panel: DataFrame) -> DataFrame:
    """Per SKU: median undiscounted quantity and first category, group and price."""
    first = F.struct("month", "client")
    plain = panel.filter(F.col("own_disc") == 0)
    firsts = plain.groupBy("sku").agg(
        F.min_by("category", first).alias("cat"), F.min_by("group", first).alias("group"), F.min_by("price_unit", first).alias("price_unit"))
    base = join_null_safe(group_quantiles(plain, "qty", 0.5, ["sku"], "base_qty"), firsts, ["sku"])
    base = base.select("sku", "base_qty", "cat", "group", "price_unit")
    return base.filter(F.col("price_unit").isNotNull() & (F.col("base_qty") > 0))


def with_effects(df: DataFrame, by_category: DataFrame, overall: DataFrame) -> DataFrame:
    """Add ``theta`` and ``theta_lo`` of the row's category.

    A category without its own estimate takes the overall slope for both, so
    its cautious value equals its point value.
    """
    known = by_category.select(F.col("category").alias("cat"), F.col("theta").alias("_t"),
                               F.col("lo").alias("_lo"))
    joined = attach(df.join(bounded(known), "cat", "left"),
                    overall.select(F.col("theta").alias("_all")), [])
    return joined.select(*df.columns, F.coalesce("_t", "_all").alias("theta"),
                         F.when(F.col("_t").isNull(), F.col("_all")).otherwise(F.col("_lo"))
                         .alias("theta_lo"))


def candidates(base: DataFrame, by_category: DataFrame, overall: DataFrame,
               grid: tuple[int, ...] = DEFAULTS.grid,
               cost_share: float = DEFAULTS.cost_share) -> DataFrame:
    """Every baseline SKU at every grid depth, with its money under point and lower effect."""
    rows = with_effects(base, by_category, overall).withColumn(
        "d", F.explode(F.array(*[F.lit(float(d)) for d in grid])))
    at = [F.col("base_qty"), F.col("price_unit")]
    point = discount_economics(*at, F.col("theta"), F.col("d"), cost_share)
    lower = discount_economics(*at, F.col("theta_lo"), F.col("d"), cost_share)
    return rows.select("sku", "cat", "group", "d", point["net"].alias("net"),
                       lower["net"].alias("net_robust"), point["rev"].alias("rev"),
                       point["spend"].alias("spend"))


def past_policy(panel: DataFrame, base: DataFrame, by_category: DataFrame, overall: DataFrame,
                cost_share: float = DEFAULTS.cost_share) -> DataFrame:
    """One row: discount spend and non-negative contribution of the average past depths."""
    first = F.struct("month", "client")
    depth = panel.filter(F.col("own_disc") > 0).groupBy("sku").agg(
        F.avg("own_disc").alias("d"), F.min_by("category", first).alias("cat"))
    rows = with_effects(depth.join(base.select("sku", "base_qty", "price_unit"), "sku"),
                        by_category, overall)
    money = discount_economics(F.col("base_qty"), F.col("price_unit"), F.col("theta"), F.col("d"),
                               cost_share)
    return rows.agg(F.coalesce(F.sum(money["spend"]), F.lit(0.0)).alias("hist_spend"),
                    F.coalesce(F.sum(F.greatest(money["net"], F.lit(0.0))), F.lit(0.0)).alias("hist_net"))


def profitable(cand: DataFrame, robust: bool = DEFAULTS.robust) -> DataFrame:
    """Discounted candidates that gain, with the objective in ``obj``."""
    obj = F.col("net_robust" if robust else "net")
    return cand.withColumn("obj", obj).filter((F.col("d") > 0) & (F.col("obj") > 0))


def best_per_sku(cand: DataFrame, robust: bool = DEFAULTS.robust) -> DataFrame:
    """Best profitable depth of each SKU (ties: less spend, then smaller depth)."""
    order = [F.desc("obj"), F.asc("spend"), F.asc("d")]
    return top_per_group(profitable(cand, robust), ["sku"], order, 1).drop("rank")


def greedy_plan(cand: DataFrame, budget: float, slots: int = DEFAULTS.slots,
                kmax: int = DEFAULTS.kmax, robust: bool = DEFAULTS.robust,
                look_ahead: int = 1000) -> DataFrame:
    """Walk the best depths by objective, skipping what breaks a limit.

    A skipped SKU never fits later: spend and group counts only grow.  So each
    round lets Spark drop what can no longer fit, takes the next few rows in
    order (a distributed top-k), and walks only those; a round always accepts
    its first row, and the plan has at most ``slots`` rows.
    """
    best = settle(best_per_sku(cand, robust).select(*PLAN_COLUMNS, "obj"))
    spark = cand.sparkSession
    plan, spent, per_group, last = [], 0.0, {}, None
    while len(plan) < slots:
        fits = best.filter(F.lit(spent) + F.col("spend") <= F.lit(budget))
        full = [g for g, n in per_group.items() if n >= kmax]
        if full:
            fits = fits.filter(~F.col("group").isin(full))
        if last is not None:
            fits = fits.filter((F.col("obj") < F.lit(last[0]))
                               | ((F.col("obj") == F.lit(last[0])) & (F.col("sku") > F.lit(last[1]))))
        ahead = fits.orderBy(F.desc("obj"), F.asc("sku")).limit(look_ahead).collect()
        for row in ahead:
            if len(plan) >= slots or spent + row["spend"] > budget \
                    or per_group.get(row["group"], 0) >= kmax:
                continue
            plan.append(row)
            spent += row["spend"]
            per_group[row["group"]] = per_group.get(row["group"], 0) + 1
        if len(ahead) < look_ahead:
            break
        last = (ahead[-1]["obj"], ahead[-1]["sku"])
    return spark.createDataFrame([tuple(r[c] for c in PLAN_COLUMNS) for r in plan],
                                 best.select(*PLAN_COLUMNS).schema)


def priced_plans(cand: DataFrame, slots: int = DEFAULTS.slots, kmax: int = DEFAULTS.kmax,
                 robust: bool = DEFAULTS.robust, prices: int = 48) -> DataFrame:
    """For each price on spending, the plan that is best when spend costs that much.

    All prices run in one job: per SKU the best depth, per group the best
    ``kmax``, then the best ``slots``; Spark cuts each partition to those
    before it shuffles.
    """
    rows = profitable(cand, robust)
    top = rows.agg(F.max(F.col("obj") / F.nullif("spend", F.lit(0.0)))).first()[0] or 1.0
    grid = [0.0] + [top * 1.001 * (0.001 ** (1 - i / (prices - 1))) for i in range(prices)]
    priced = (spread(rows, len(grid), "sku").withColumn("price", F.explode(F.array(*[F.lit(v) for v in grid])))
              .withColumn("worth", F.col("obj") - F.col("price") * F.col("spend")))
    order = [F.desc("worth"), F.asc("spend"), F.asc("d"), F.asc("sku")]
    each = top_per_group(priced.filter(F.col("worth") > 0), ["price", "sku"], order, 1)
    capped = top_per_group(each, ["price", "group"], order, kmax)
    return top_per_group(capped, ["price"], order, slots).drop("rank")


def spending_bound(cand: DataFrame, budget: float, prices: list[float],
                   robust: bool = DEFAULTS.robust) -> float:
    """No plan within the budget can be worth more than this: the least bound over the prices."""
    each = spread(profitable(cand, robust), len(prices), "sku").withColumn("price", F.explode(F.array(*[F.lit(float(p)) for p in prices])))
    worth = F.greatest(F.col("obj") - F.col("price") * F.col("spend"), F.lit(0.0))
    best = each.groupBy("price", "sku").agg(F.max(worth).alias("w"))
    bounds = best.groupBy("price").agg((F.col("price") * F.lit(budget) + F.sum("w")).alias("bound"))
    return bounds.agg(F.min("bound")).first()[0] or 0.0


def lagrangian_plan(cand: DataFrame, budget: float, slots: int = DEFAULTS.slots,
                    kmax: int = DEFAULTS.kmax, robust: bool = DEFAULTS.robust,
                    prices: int = 48) -> tuple[DataFrame, DataFrame]:
    """Best feasible priced plan and a one-row report with its dual bound and gap."""
    spark = cand.sparkSession
    cand = settle(cand)
    plans = settle(priced_plans(cand, slots, kmax, robust, prices))
    totals = plans.groupBy("price").agg(F.sum("obj").alias("value"), F.sum("spend").alias("spend"))
    feasible = totals.filter(F.col("spend") <= F.lit(budget))
    found = feasible.orderBy(F.desc("value"), "price").limit(1).collect()
    price, value, spend = (found[0]["price"], found[0]["value"], found[0]["spend"]) if found \
        else (float("inf"), 0.0, 0.0)
    plan = plans.filter(F.col("price") == F.lit(price)).select(*PLAN_COLUMNS)
    tried = [0.0, *[r["price"] for r in totals.select("price").collect()]]
    bound = spending_bound(cand, budget, sorted(set(tried)), robust)
    report = spark.createDataFrame(
        [(float(value), float(spend), float(bound), float(bound - value))],
        "value double, spend double, bound double, gap double")
    return plan, report


def plan_report(plan: DataFrame, past: DataFrame) -> DataFrame:
    """Plan against history: size, contribution, gain and gain in percent."""
    total = plan.agg(F.count(F.lit(1)).alias("skus"), F.coalesce(F.sum("net"), F.lit(0.0)).alias("plan_net"),
                     F.coalesce(F.sum("spend"), F.lit(0.0)).alias("plan_spend"))
    joined = attach(total, past, [])
    gain = F.col("plan_net") - F.col("hist_net")
    return joined.select(
        "skus", "plan_net", "plan_spend", "hist_spend", "hist_net", gain.alias("gain"),
        (gain / F.greatest(F.col("hist_net"), F.lit(1.0)) * F.lit(100.0)).alias("gain_pct"),
        F.when(F.col("skus") == 0, F.lit("no profitable discount"))
        .otherwise(F.lit("plan")).alias("outcome"))


#: Prices tried in one job, and times the grid closes in round the budget.
PRICES, ZOOMS = 32, 4
#: Candidates nearest to being chosen that the last improvements look at.
CORE = 500


def _chosen(rows: DataFrame, prices: list[float], slots: int, kmax: int) -> DataFrame:
    """For each price the best selection when a unit of spend costs that much.

    Given the price, slot and group limits are all that is left, and the best
    depth per SKU, the best ``kmax`` per group and the best ``slots`` of those
    solve that exactly.
    """
    priced = (spread(rows, len(prices), "sku").withColumn("price", F.explode(F.array(*[F.lit(float(p)) for p in prices])))
              .withColumn("worth", F.col("obj") - F.col("price") * F.col("spend")))
    order = [F.desc("worth"), F.asc("spend"), F.asc("d"), F.asc("sku")]
    each = top_per_group(priced.filter(F.col("worth") > 0), ["price", "sku"], order, 1)
    capped = top_per_group(each, ["price", "group"], order, kmax)
    return top_per_group(capped, ["price"], order, slots).drop("rank")


def selection_plan(cand: DataFrame, budget: float, slots: int = DEFAULTS.slots, kmax: int = DEFAULTS.kmax,
                   robust: bool = DEFAULTS.robust, core: int = CORE) -> tuple[DataFrame, DataFrame]:
    """A plan close to the best one under all limits, and a one-row report: value, spend, bound, gap.

    The price of spending is closed in on: each job tries a grid of prices, the
    next grid lies between the last that overspends and the first that doesn't.  Any price bounds
    every plan's value from above by what its selection is worth plus the price
    of the whole budget; the least such bound is reported.  The selection within
    the budget is then improved by additions, changes of depth and exchanges of up to two
    for one, among the plan's rows and the ``core`` candidates worth most at that price.
    """
    spark = cand.sparkSession
    rows = settle(profitable(cand, robust).select(*PLAN_COLUMNS, "obj"))
    top = rows.agg(F.max(F.col("obj") / F.nullif("spend", F.lit(0.0)))).first()[0] or 0.0
    low, high, bound, best, seen = 0.0, top * 1.001 + 1e-12, None, None, set()
    for _ in range(ZOOMS):
        grid = [p for p in (low + (high - low) * i / (PRICES - 1) for i in range(PRICES)) if p not in seen]
        seen.update(grid)
        picked = settle(_chosen(rows, grid, slots, kmax))
        totals = {r["price"]: r for r in picked.groupBy("price").agg(
            F.sum("obj").alias("value"), F.sum("spend").alias("spend"), F.sum("worth").alias("worth")).collect()}
        for price in grid:
            r = totals.get(price)
            value, spend, worth = (r["value"], r["spend"], r["worth"]) if r else (0.0, 0.0, 0.0)
            bound = min(x for x in (bound, worth + price * budget) if x is not None)
            if spend <= budget:
                high = min(high, price)
                if best is None or value > best[0]:
                    best = (value, price, picked)
            else:
                low = max(low, price)
        if high <= low:
            break
    # A few hundred rows: the plan so far and what comes next at the price.
    value, price, picked = best if best else (0.0, high, None)
    plan = picked.filter(F.col("price") == F.lit(price)).select(*PLAN_COLUMNS, "obj").collect() if picked is not None else []
    near = (rows.withColumn("worth", F.abs(F.col("obj") - F.lit(float(price)) * F.col("spend"))).orderBy("worth", "sku", "d")
            .select(*PLAN_COLUMNS, "obj").limit(core).collect())
    good = rows.withColumn("worth", F.col("obj") - F.lit(float(price)) * F.col("spend")).orderBy(F.desc("worth"), "sku", "d")
    near += good.select(*PLAN_COLUMNS, "obj").limit(core).collect()
    plan = improved(plan, list(dict.fromkeys(near)), budget, slots, kmax)
    out = spark.createDataFrame([tuple(r[c] for c in PLAN_COLUMNS) for r in plan], rows.select(*PLAN_COLUMNS).schema)
    value, spend = sum(r["obj"] for r in plan), sum(r["spend"] for r in plan)
    bound = max(bound or 0.0, value)
    return out, spark.createDataFrame([(float(value), float(spend), float(bound), float(bound - value))],
                                      "value double, spend double, bound double, gap double")


def improved(plan: list, near: list, budget: float, slots: int, kmax: int) -> list:
    """Better the plan by moves that keep every limit until none gains.

    A move puts in one candidate and takes out up to two rows, its own SKU's
    row among them if it has one; of a candidate's moves the one that gains most is made.
    """
    plan, near = list(plan), sorted(near, key=lambda r: (-r["obj"], r["sku"], r["d"]))
    changed = True
    while changed:
        changed = False
        for c in near:
            spent = sum(r["spend"] for r in plan) + c["spend"]
            same = sum(r["group"] == c["group"] for r in plan) + 1
            forced = tuple(i for i, r in enumerate(plan) if r["sku"] == c["sku"])
            outs = [forced, *[(*forced, i) for i in range(len(plan)) if i not in forced]]
            if not forced:
                cheap = sorted(range(len(plan)), key=lambda i: plan[i]["obj"])[:30]
                outs += [(i, j) for n, i in enumerate(cheap) for j in cheap[:n]]
            best = None
            for out in outs:
                gain = c["obj"] - sum(plan[i]["obj"] for i in out)
                if (gain > (best[0] if best else 1e-9) and len(plan) + 1 - len(out) <= slots
                        and spent - sum(plan[i]["spend"] for i in out) <= budget
                        and same - sum(plan[i]["group"] == c["group"] for i in out) <= kmax):
                    best = (gain, out)
            if best:
                plan = [r for i, r in enumerate(plan) if i not in best[1]] + [c]
                changed = True
    return plan
