"""Money expressions of a discount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def discount_economics(base_qty: Column, price: Column, theta: Column, depth: Column,
                       cost_share: float) -> dict[str, Column]:
    """Contribution, revenue change and discount spend at ``depth`` percent."""
    keep = F.lit(1.0) - depth / F.lit(100.0)
    qty = base_qty * F.exp(theta * depth)
    unit_cost = F.lit(cost_share) * price
    return {
        "net": qty * (price * keep - unit_cost) - base_qty * (price - unit_cost),
        "rev": qty * price * keep - base_qty * price,
        "spend": qty * price * (depth / F.lit(100.0)),
    }
