"""Association between columns: entropy, Theil's U, Cramér's V, correlation ratio, Pearson, KS.

Everything is computed from folded counts or per-group moments, so a value or category that holds
most of the rows is reduced before the shuffle.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators import ordering, profile
from panelspark.operators.clean import missing_strategy
from panelspark.schema import columns_of_type

_PAIR = ["col_a", "col_b"]


def _pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(col_a, col_b, x, y, n)``: contingency counts of all pairs in one job."""
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"),
            )
            for a, b in pairs
        ]
    )
    return df.select(F.explode(entries).alias("e")).select("e.*").groupBy(*_PAIR, "x", "y").agg(F.count(F.lit(1)).alias("n"))


def _n_log_n(n: str) -> Column:
    return F.sum(F.col(n) * F.ln(F.col(n)))


def entropies(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per pair: entropy of x, entropy of x given y, and Theil's U of x given y.

    With counts c of N rows, an entropy is ln N − Σ c·ln c / N, so only sums over the folded counts
    are needed, never the marginals next to each cell.
    """
    cells = _pair_counts(df, pairs)
    of_x = cells.groupBy(*_PAIR, "x").agg(F.sum("n").alias("n")).groupBy(*_PAIR).agg(_n_log_n("n").alias("sx"))
    of_y = cells.groupBy(*_PAIR, "y").agg(F.sum("n").alias("n")).groupBy(*_PAIR).agg(_n_log_n("n").alias("sy"))
    of_xy = cells.groupBy(*_PAIR).agg(_n_log_n("n").alias("sxy"), F.sum("n").alias("rows"))
    s_x = F.ln("rows") - F.col("sx") / F.col("rows")
    s_x_given_y = (F.col("sy") - F.col("sxy")) / F.col("rows")
    out = of_xy.join(of_x, _PAIR).join(of_y, _PAIR).select(*_PAIR, s_x.alias("entropy"), s_x_given_y.alias("conditional_entropy"))
    certain = F.abs("entropy") < 1e-12
    return out.withColumn(
        "theils_u", F.when(certain, 1.0).otherwise((F.col("entropy") - F.col("conditional_entropy")) / F.col("entropy"))
    )


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Bias-corrected Cramér's V per pair, with the continuity correction on 2×2 tables.

    χ² comes from the filled cells alone: N(Σ n²/(row·column) − 1). In a 2×2 table all four cells
    are off by the same amount D, and Σ 1/expected factors into the two margins, so empty cells need
    not be listed there either.
    """
    cells = _pair_counts(df, pairs)
    rows = cells.groupBy(*_PAIR, "x").agg(F.sum("n").alias("nx"))
    cols = cells.groupBy(*_PAIR, "y").agg(F.sum("n").alias("ny"))
    row_side = rows.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("r"), F.sum(1 / F.col("nx")).alias("ix"), F.sum("nx").alias("total"))
    col_side = cols.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("ny")).alias("iy"))
    joined = (
        cells.alias("c")
        .join(rows.alias("r"), on=[F.col(f"c.{c}") == F.col(f"r.{c}") for c in _PAIR] + [F.col("c.x").eqNullSafe(F.col("r.x"))])
        .join(cols.alias("k"), on=[F.col(f"c.{c}") == F.col(f"k.{c}") for c in _PAIR] + [F.col("c.y").eqNullSafe(F.col("k.y"))])
        .select(F.col("c.col_a").alias("col_a"), F.col("c.col_b").alias("col_b"), "n", "nx", "ny")
        .join(row_side.select(*_PAIR, "total"), _PAIR)
    )
    fit = joined.groupBy(*_PAIR).agg(
        F.sum(F.col("n") * F.col("n") / F.col("nx") / F.col("ny")).alias("s"),
        F.max(F.abs(F.col("n") - F.col("nx") * F.col("ny") / F.col("total"))).alias("d"),
    )
    t = fit.join(row_side, _PAIR).join(col_side, _PAIR)
    total = F.col("total").cast("double")
    kept = F.col("d") - F.least(F.lit(0.5), F.col("d"))
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), kept * kept * total * F.col("ix") * F.col("iy")).when(
        (F.col("r") == 1) | (F.col("k") == 1), 0.0
    ).otherwise(total * (F.col("s") - 1))
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / total - F.try_divide((F.col("k") - 1) * (F.col("r") - 1), total - 1))
    side = F.least(
        F.col("k") - F.try_divide(F.pow(F.col("k") - 1, F.lit(2)), total - 1) - 1,
        F.col("r") - F.try_divide(F.pow(F.col("r") - 1, F.lit(2)), total - 1) - 1,
    )
    return t.withColumn("chi2", chi2).select(*_PAIR, "chi2", F.sqrt(F.try_divide(phi2, side)).alias("cramers_v"))


def correlation_ratios(df: DataFrame, categories: Sequence[str], columns: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """η of each column against each category: ``(category, column, eta)``.

    One grouped pass collects count, mean and spread of all columns per category value; NULL values
    count as ``fill`` (or are left out with ``fill=None``).
    """
    def v(c: str) -> Column:
        x = F.col(f"x.{c}")
        return x if fill is None else F.coalesce(x, F.lit(fill))

    values = F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("x")
    kinds = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("k")) for c in categories])
    stats = [F.struct(F.count(v(c)).alias("n"), F.avg(v(c)).alias("m"), F.var_pop(v(c)).alias("s")).alias(c) for c in columns]
    if len(categories) == 1:
        rows = df.select(values, F.lit(categories[0]).alias("category"), F.col(categories[0]).cast("string").alias("k"))
    else:
        rows = df.select(values, F.explode(kinds).alias("e")).select("x", "e.category", "e.k")
    groups = rows.groupBy("category", "k").agg(*stats)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    long = groups.select("category", F.explode(entries).alias("e")).select("category", "e.column", "e.s.n", "e.s.m", "e.s.s").filter("n > 0")
    by = ["category", "column"]
    center = long.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    off = F.col("m") - F.col("mean")
    sums = (
        long.join(F.broadcast(center), by)  # one row per pair of column names
        .groupBy(*by)
        .agg(F.sum(F.col("n") * off * off).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"))
    )
    total = F.col("between") + F.col("within")
    eta = F.when((F.col("between") == 0) | (total == 0), 0.0).otherwise(F.sqrt(F.col("between") / total))
    return sums.select(*by, eta.alias("eta"))


def correlation_ratio(df: DataFrame, category: str, columns: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """η of each column against one category."""
    return correlation_ratios(df, [category], columns, fill)


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson's r of column pairs in one aggregate; NULL where a column has no spread."""
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(
        *[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    )
    return row.select(F.explode(entries).alias("e")).select("e.*").withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def associations(
    df: DataFrame,
    nominal: Sequence[str] | str | None = "auto",
    theil_u: bool = False,
    mark_columns: bool = False,
    missing: str = "replace",
    missing_value: float = 0.0,
) -> DataFrame:
    """Association of every column with every other as ``(col_a, col_b, measure, value)``.

    Two nominal columns are compared by Cramér's V (or by Theil's U of ``col_a`` given ``col_b``), a
    nominal with a numeric one by η, two numeric ones by Pearson's r; the diagonal is 1.
    """
    df = missing_strategy(df, missing, missing_value)
    if nominal == "auto":
        nominal = columns_of_type(df)
    elif nominal == "all":
        nominal = df.columns
    names = [c for c in df.columns if c in (nominal or [])]
    numbers = [c for c in df.columns if c not in names]
    parts: list[DataFrame] = []

    def measured(t: DataFrame, measure: str, a: Column, b: Column, value: str) -> DataFrame:
        return t.select(a.alias("col_a"), b.alias("col_b"), F.lit(measure).alias("measure"), F.col(value).cast("double").alias("value"))

    def both_ways(t: DataFrame, measure: str, a: str, b: str, value: str) -> list[DataFrame]:
        return [measured(t, measure, F.col(a), F.col(b), value), measured(t, measure, F.col(b), F.col(a), value)]

    if len(names) > 1:
        if theil_u:
            u = entropies(df, list(itertools.permutations(names, 2)))
            parts.append(measured(u, "theils_u", F.col("col_a"), F.col("col_b"), "theils_u"))
        else:
            v = cramers_v(df, list(itertools.combinations(names, 2)))
            parts += both_ways(v, "cramers_v", "col_a", "col_b", "cramers_v")
    if numbers and names:
        parts += both_ways(correlation_ratios(df, names, numbers, None), "eta", "category", "column", "eta")
    if len(numbers) > 1:
        r = pearson(df, list(itertools.combinations(numbers, 2)))
        parts += both_ways(r, "pearson", "col_a", "col_b", "r")
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    listed = F.array(*[F.lit(c) for c in df.columns])
    diagonal = df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(listed).alias("col_a")).select(
        "col_a", F.col("col_a").alias("col_b"), F.lit("self").alias("measure"), F.lit(1.0).alias("value")
    )
    out = diagonal if out is None else out.unionByName(diagonal)
    if mark_columns:
        for side in _PAIR:
            kind = F.when(F.col(side).isin(list(names)), " (nom)").otherwise(" (con)")
            out = out.withColumn(side, F.concat(F.col(side), kind))
    return out


def as_matrix(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long association table to one row per column, for display."""
    return long.groupBy("col_a").pivot("col_b", list(columns)).agg(F.first("value"))


def _kolmogorov_sf(z: Column) -> Column:
    """Tail of the limiting KS distribution, by the series that converges fast on each side of 1."""
    small = sum((F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi**2 / 8) / (z * z)) for k in range(1, 9)), F.lit(0.0))
    large = sum((F.exp(F.lit(-2.0 * k * k) * z * z) * (1 if k % 2 else -1) for k in range(1, 9)), F.lit(0.0))
    return F.when(z <= 0, 1.0).when(z < 1, 1 - math.sqrt(2 * math.pi) / z * small).otherwise(2 * large)


def ks_two_sample(df: DataFrame, label: str, columns: Sequence[str], positive: int = 1, ranges: int | None = None) -> DataFrame:
    """Two-sample KS statistic and asymptotic p-value per column, label = ``positive`` against the rest.

    Equal values are folded first; running totals of both samples give the distance at each value.
    """
    long = profile.stacked(df, columns, label).filter(F.col("value").isNotNull())
    hit = F.col(label) == positive
    folded = long.groupBy("column", "value").agg(F.count_if(hit).alias("a"), F.count_if(~hit).alias("b"))
    sizes = folded.groupBy("column").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    gap = F.abs((F.col("a_before") + F.col("a")) / F.col("n1") - (F.col("b_before") + F.col("b")) / F.col("n2"))
    out = (
        ordering.running_totals(folded, ["column"], "value", ["a", "b"], ranges)
        .join(F.broadcast(sizes.filter("n1 > 0 AND n2 > 0")), "column")  # one row per column name
        .groupBy("column", "n1", "n2")
        .agg(F.max(gap).alias("statistic"))
    )
    z = F.col("statistic") * F.sqrt(F.col("n1") / (F.col("n1") + F.col("n2")) * F.col("n2"))
    return out.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), _kolmogorov_sf(z))))
