"""Report and correlation requests as lazy plans."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, joins


@dataclass(frozen=True)
class ReportSpec:
    """Join keys and the measures taken from each input."""

    keys: Sequence[str]
    measures: Mapping[str, Sequence[str]]
    order: str = "timestamp"

    def normalized(self) -> ReportSpec:
        tidy = {name: tuple(sorted(set(ms))) for name, ms in sorted(self.measures.items())}
        return ReportSpec(tuple(sorted(set(self.keys))), tidy, self.order)

    @property
    def id(self) -> str:
        """Hash of the normalised request: equal requests have equal ids."""
        text = json.dumps(asdict(self.normalized()), sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()


def joined(inputs: Mapping[str, DataFrame], spec: ReportSpec) -> DataFrame:
    spec = spec.normalized()
    return joins.join_multi_full({n: (inputs[n], ms) for n, ms in spec.measures.items()}, spec.keys, spec.order)


def report(inputs: Mapping[str, DataFrame], spec: ReportSpec, limit: int | None = None) -> DataFrame:
    """One row per key, sorted by the keys. The limit comes after the join: it never changes a value."""
    out = joined(inputs, spec).orderBy(*spec.normalized().keys)
    return out.limit(limit) if limit else out


def correlations(inputs: Mapping[str, DataFrame], spec: ReportSpec) -> DataFrame:
    """Pearson r, p-value and label of every pair of measures of the report."""
    wide = joined(inputs, spec)
    names = [c for c in wide.columns if c not in spec.keys]
    numbered = {n: f"m{i}" for i, n in enumerate(names)}
    pairs = aggregates.corr_matrix(wide.withColumnsRenamed(numbered), list(numbered.values()))
    named = F.create_map(*[F.lit(x) for n, m in numbered.items() for x in (m, n)])
    back = {c: named[F.col(c)] for c in ("a", "b")}
    return aggregates.with_pvalue(pairs).withColumns({**back, "label": aggregates.corr_label(F.col("r"))})


def correlate(
    a: DataFrame, b: DataFrame, key_a: str, key_b: str, value_a: str, value_b: str, order_a: Sequence[str], max_join: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Joined preview rows and the one-row statistics of two datasets.

    Without ``max_join`` all joined rows count. With it the first rows in key order are taken, as a
    request for a bounded preview.
    """
    one = a.select(F.col(key_a).alias("__ka"), F.col(value_a).alias("a_value"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_a)])
    two = b.select(F.col(key_b).alias("__kb"), F.col(value_b).alias("b_value"))
    rows = joins.join_first_match(one, two, F.col("__ka"), F.col("__kb"), [f"__o{i}" for i in range(len(order_a))])
    rows = rows.select("join_value", "a_value", "b_value")
    if max_join:
        rows = rows.orderBy("join_value", "b_value").limit(max_join)
    stats = aggregates.with_pvalue(aggregates.pearson(rows, "a_value", "b_value"))
    return rows, stats.withColumn("label", aggregates.corr_label(F.col("r")))
