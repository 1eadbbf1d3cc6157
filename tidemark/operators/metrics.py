"""Metric layer: named metrics by named dimensions without fan-out.

Every fact is aggregated alone at the asked grain and the results are joined
afterwards, so no fact row is ever multiplied by rows of another fact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import ratio


@dataclass(frozen=True)
class Dimension:
    """A dimension table, its key and the attributes it offers.

    ``early``: a small table (a calendar) whose attributes are much coarser than
    its key.  It is joined before the fact is summed, so that the shuffle has a row
    per attribute, not per key.
    """

    df: DataFrame
    key: str
    attributes: tuple[str, ...]
    early: bool = False


@dataclass(frozen=True)
class Fact:
    """A fact, its foreign keys by dimension name, and its measures.

    ``sums`` are additive expressions; ``distincts`` name columns whose
    distinct values are counted.
    """

    df: DataFrame
    keys: dict[str, str]
    sums: dict[str, Column]
    distincts: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Metric:
    """A formula over measures; ``needs`` lists ``fact.measure`` names."""

    needs: tuple[str, ...]
    formula: Callable[..., Column]


@dataclass(frozen=True)
class MetricModel:
    facts: dict[str, Fact]
    dimensions: dict[str, Dimension]
    metrics: dict[str, Metric]

    def _home(self, attribute: str) -> str:
        for name, dim in self.dimensions.items():
            if attribute in dim.attributes:
                return name
        raise ValueError(f"unknown dimension {attribute!r}")

    def _aggregate(
        self,
        fact_name: str,
        measures: Sequence[str],
        by: Sequence[str],
        where: dict[str, object],
    ) -> DataFrame:
        fact = self.facts[fact_name]
        homes = sorted({self._home(a) for a in [*by, *where]})
        unreachable = [h for h in homes if h not in fact.keys]
        if unreachable:
            raise ValueError(f"{fact_name} has no key to {unreachable}")
        sums = [m for m in measures if m in fact.sums]
        distincts = [m for m in measures if m in fact.distincts]
        early = [h for h in homes if self.dimensions[h].early]
        late = [h for h in homes if h not in early]
        attributes = list(dict.fromkeys([*by, *where]))

        def joined(rows: DataFrame, home: str) -> DataFrame:
            dim = self.dimensions[home]
            wanted = [a for a in attributes if a in dim.attributes]
            slim = dim.df.select(F.col(dim.key).alias("_dim_key"), *wanted)
            for attribute in wanted:
                if attribute in where:
                    slim = slim.where(F.col(attribute) == where[attribute])
            return rows.join(slim, F.col(fact.keys[home]) == F.col("_dim_key")).drop(
                "_dim_key"
            )

        rows = reduce(joined, early, fact.df)
        grain = dict.fromkeys(
            [a for a in attributes if self._home(a) in early]
            + [fact.keys[h] for h in late]
            + [fact.distincts[m] for m in distincts]
        )
        rows = rows.groupBy(*grain).agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(fact.sums[m]).alias(f"{fact_name}.{m}") for m in sums],
        )
        rows = reduce(joined, late, rows)
        return rows.groupBy(*by).agg(
            *[
                F.sum(f"`{fact_name}.{m}`").alias(f"{fact_name}.{m}")
                for m in sums
            ],
            *[
                F.count_distinct(fact.distincts[m]).alias(f"{fact_name}.{m}")
                for m in distincts
            ],
        )

    def query(
        self,
        metrics: Sequence[str],
        by: Sequence[str] = (),
        where: dict[str, object] | None = None,
    ) -> DataFrame:
        """Metrics at the grain of ``by``, for rows equal to ``where``."""
        needed = list(dict.fromkeys(n for m in metrics for n in self.metrics[m].needs))
        by_fact: dict[str, list[str]] = {}
        for name in needed:
            fact_name, measure = name.split(".")
            by_fact.setdefault(fact_name, []).append(measure)
        parts = [
            self._aggregate(f, ms, by, where or {}) for f, ms in by_fact.items()
        ]
        joined = reduce(lambda a, b: _same_grain(a, b, list(by)), parts)
        return joined.select(
            *by,
            *[
                self.metrics[m]
                .formula(*[F.col(f"`{n}`") for n in self.metrics[m].needs])
                .alias(m)
                for m in metrics
            ],
        )


def _same_grain(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Full outer join of two results at one grain; null attributes match."""
    if not by:
        # Both sides are one-row aggregates.
        values = [c for c in right.columns]
        packed = right.agg(
            F.first(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in
                               enumerate(values)])).alias("s")
        ).scalar()
        return left.withColumn("_s", packed).select(
            *[F.col(f"`{c}`") for c in left.columns],
            *[F.col(f"_s.c{i}").alias(c) for i, c in enumerate(values)],
        )
    other = right.withColumnsRenamed({a: f"_r_{a}" for a in by})
    same = reduce(
        lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(f"_r_{a}")) for a in by]
    )
    joined = left.withColumn("_l", F.lit(1)).join(other, same, "full")
    picked = [
        F.when(F.col("_l").isNotNull(), F.col(a)).otherwise(F.col(f"_r_{a}")).alias(a)
        for a in by
    ]
    measures = [c for c in [*left.columns, *right.columns] if c not in by]
    return joined.select(*picked, *[F.col(f"`{c}`") for c in measures])


def zero(value: Column) -> Column:
    """Null as zero: a period without rows of a fact has none of its amount."""
    return F.coalesce(value, F.lit(0).cast("decimal(18,2)"))


# The metrics every finance model offers.
FINANCE_METRICS = {
    "total_revenue": Metric(("revenue.amount",), zero),
    "total_aum": Metric(("revenue.aum",), zero),
    "avg_fee_rate": Metric(
        ("revenue.bps", "revenue.bps_rows"),
        lambda total, n: F.round(ratio(total, n), 4),
    ),
    "revenue_per_client": Metric(
        ("revenue.amount", "revenue.clients"),
        lambda amount, n: F.round(ratio(amount, n), 2),
    ),
    "total_expenses": Metric(("expense.amount",), zero),
    "net_income": Metric(
        ("revenue.amount", "expense.amount"), lambda r, e: zero(r) - zero(e)
    ),
    "profit_margin": Metric(
        ("revenue.amount", "expense.amount"),
        lambda r, e: F.round(ratio(zero(r) - zero(e), r) * 100, 2),
    ),
    "expense_ratio": Metric(
        ("revenue.amount", "expense.amount"),
        lambda r, e: F.round(ratio(zero(e), r) * 100, 2),
    ),
    "total_budget": Metric(("budget.amount",), zero),
    "budget_variance": Metric(
        ("expense.amount", "budget.amount"), lambda e, b: zero(e) - zero(b)
    ),
}
