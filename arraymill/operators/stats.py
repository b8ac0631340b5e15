"""Descriptive statistics, correlations and regression as aggregate columns.

NaN strategy of every aggregate: "remove" (default) leaves NaN out, "keep" lets
it through, "exception" fails on it. Those of columns are plain aggregates, so a
group's rows are combined before the shuffle. Order statistics of groups of any
size are functions of DataFrames: they rank the distinct values in one ordered
scan (quantiles, medians, outliers, describe). median(), percentiles() and
quartiles() of a column gather a group's values and are for small groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def values(x: Column, nan: str = "remove") -> Column:
    """x as doubles under a NaN strategy; what is left out is null."""
    d = x.cast("double")
    if nan == "remove":
        return F.when(~F.isnan(d), d)
    if nan == "exception":
        return F.when(F.isnan(d), F.raise_error(F.lit("NaN in the data")).cast("double")).otherwise(d)
    return d


def _else_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(NAN))


def total(x: Column, nan: str = "remove") -> Column:
    """The sum; of nothing 0."""
    return F.coalesce(F.sum(values(x, nan)), F.lit(0.0))


def total_exact(x: Column, nan: str = "remove", scale: int = 9) -> Column:
    """A sum that does not depend on the order of rows, by decimals of a fixed scale."""
    return F.coalesce(F.sum(values(x, nan).cast(f"decimal(38,{scale})")), F.lit(0)).cast("double")


def sum_fast(x: Column) -> Column:
    return total(x, "keep")


def mean(x: Column, nan: str = "remove") -> Column:
    return _else_nan(F.avg(values(x, nan)))


def mean_fast(x: Column) -> Column:
    return mean(x, "keep")


def least(x: Column, nan: str = "remove") -> Column:
    return _else_nan(F.min(values(x, nan)))


def most(x: Column, nan: str = "remove") -> Column:
    return _else_nan(F.max(values(x, nan)))


def n_values(x: Column, nan: str = "remove") -> Column:
    return F.count(values(x, nan))


def product(x: Column) -> Column:
    return F.product(x)


def variance(x: Column, nan: str = "remove") -> Column:
    """Sample variance; of one value NaN, of none 0."""
    v = values(x, nan)
    return F.when(F.count(v) == 0, 0.0).when(F.count(v) == 1, F.lit(NAN)).otherwise(F.var_samp(v))


def standard_deviation(x: Column, nan: str = "remove") -> Column:
    return F.sqrt(variance(x, nan))


def _population(x: Column) -> tuple[Column, Column, Column]:
    return F.count(x).cast("double"), F.skewness(x), F.kurtosis(x)


def skew(x: Column, nan: str = "remove") -> Column:
    """Bias-corrected; under three values NaN."""
    n, g, _ = _population(values(x, nan))
    return F.when(n < 3, F.lit(NAN)).otherwise(g * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column, nan: str = "remove") -> Column:
    """Bias-corrected excess; under four values NaN."""
    n, _, k = _population(values(x, nan))
    return F.when(n < 4, F.lit(NAN)).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))


def moment(x: Column, order: int, nan: str = "remove") -> Column:
    """The sum of (x - mean)^order for orders 2 to 4, in one pass."""
    v = values(x, nan)
    n, g, k = _population(v)
    m2 = F.var_pop(v) * n
    if order == 2:
        return m2
    return g * F.pow(F.var_pop(v), F.lit(1.5)) * n if order == 3 else (k + 3) * F.pow(F.var_pop(v), F.lit(2)) * n


def median(x: Column, nan: str = "remove") -> Column:
    """The sorted value at half the count, rounded down (the upper one of an even count), of groups that fit in a task."""
    s = F.sort_array(F.collect_list(values(x, nan)))
    return _else_nan(F.get(s, F.floor(F.size(s) / 2).cast("int")))


#: Position of a percentile p (0 to 1) among n sorted values, by estimation type; then how it is read.
_KINDS: dict[str, tuple[Callable[[float, Column], Column], str]] = {
    "legacy": (lambda p, n: p * (n + 1), "lerp"),
    "r1": (lambda p, n: n * p, "up"),
    "r2": (lambda p, n: n * p, "mid"),
    "r3": (lambda p, n: F.rint(n * p), "at"),
    "r4": (lambda p, n: n * p, "lerp"),
    "r5": (lambda p, n: n * p + 0.5, "lerp"),
    "r6": (lambda p, n: (n + 1) * p, "lerp"),
    "r7": (lambda p, n: (n - 1) * p + 1, "lerp"),
    "r8": (lambda p, n: (n + 1 / 3) * p + 1 / 3, "lerp"),
    "r9": (lambda p, n: (n + 0.25) * p + 0.375, "lerp"),
    "upper": (lambda p, n: F.floor(n * p) + 1, "at"),
}


def _percentile(p: float, kind: str, n: Column, value: Callable[[Column], Column]) -> Column:
    """The percentile (0 to 100) of n values; value gives the one at a place from 1, clamped."""
    place, how = _KINDS[kind]
    pos = place(p / 100, n.cast("double"))
    low = F.floor(pos)
    if how == "up":
        out = value(F.ceil(pos))
    elif how == "mid":
        out = (value(F.ceil(pos)) + value(low + 1)) / 2
    elif how == "at":
        out = value(pos)
    else:
        a = value(low)
        out = a + (pos - low) * (value(low + 1) - a)
    return F.when(n == 0, F.lit(NAN)).otherwise(out)


def percentile_of(s: Column, p: float, kind: str = "legacy") -> Column:
    """The percentile (0 to 100) of a sorted array."""
    at = lambda k: F.get(s, F.greatest(F.lit(0), F.least(k.cast("int"), F.size(s)) - 1).cast("int"))
    return _percentile(p, kind, F.size(s), at)


def quantiles(df: DataFrame, x: str, at: Iterable[float], kind: str = "legacy", keys: list[str] | None = None, nan: str = "remove", name: str = "percentiles") -> DataFrame:
    """keys, name: percentiles (0 to 100) of each group as an array, exact, for groups of any size.

    The counts of distinct values are ranked by one scan over range partitions,
    and the values at the places asked for are picked by an aggregate: no
    group's values are gathered, and equal ones are combined first. A group
    without values has NaN. kind: legacy, r1 to r9, or upper (the value after
    the share of the values that is rounded down).
    """
    from arraymill.operators.prefix import same_keys, scan

    own = [f"__k{i}" for i in range(len(keys or []))] or ["__k0"]
    named = [F.col(k).alias(c) for k, c in zip(keys, own, strict=True)] if keys else [F.lit(0).alias("__k0")]
    counts = df.select(*named, values(F.col(x), nan).alias("__x")).groupBy(*own, "__x").agg(F.count("__x").alias("__n"))
    ranked = scan(counts, [*own, "__x"], F.col("__n"), "__upto")
    ends = [f"{c}_" for c in own]
    groups = ranked.groupBy(*(F.col(c).alias(e) for c, e in zip(own, ends, strict=True))).agg(F.min(F.col("__upto") - F.col("__n")).alias("__before"), F.sum("__n").alias("__count"))
    last, places = F.col("__upto") - F.col("__before"), []

    def value(k: Column) -> Column:
        k = F.greatest(F.lit(1), F.least(k.cast("bigint"), F.col("__count")))
        places.append(F.max(F.when((last - F.col("__n") < k) & (k <= last), F.col("__x"))).alias(f"__v{len(places)}"))
        return F.col(f"__v{len(places) - 1}")

    read = [_percentile(p, kind, F.col("__count"), value) for p in at]
    picked = ranked.join(groups, same_keys(own, ends)).groupBy(*own, "__count").agg(*places)
    return picked.select(*(F.col(c).alias(k) for c, k in zip(own, keys or [], strict=False)), F.array(*read).alias(name))


def medians(df: DataFrame, x: str, keys: list[str] | None = None, nan: str = "remove", name: str = "median") -> DataFrame:
    """keys, name: the upper median of each group, of any size."""
    return quantiles(df, x, (50,), "upper", keys, nan, name).withColumn(name, F.col(name)[0])


def percentiles(x: Column, at: Iterable[float], kind: str = "legacy", nan: str = "remove") -> Column:
    """Exact percentiles of groups that fit in a task; quantiles() is for any."""
    s = F.sort_array(F.collect_list(values(x, nan)))
    return F.array(*(percentile_of(s, p, kind) for p in at))


def quartiles(x: Column, kind: str = "legacy", nan: str = "remove") -> Column:
    return percentiles(x, (0.001, 25, 50, 75, 100), kind, nan)


def quartile_1(x: Column, nan: str = "remove") -> Column:
    return percentiles(x, (25,), "legacy", nan)[0]


def quartile_3(x: Column, nan: str = "remove") -> Column:
    return percentiles(x, (75,), "legacy", nan)[0]


def approximate_percentiles(x: Column, at: Iterable[float], accuracy: int = 10_000, nan: str = "remove") -> Column:
    """Percentiles of groups that are too large to see together, within 1/accuracy of the rank."""
    return F.percentile_approx(values(x, nan), [p / 100 for p in at], accuracy)


def mode(df: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    """keys, mode: the most common value per group, the smallest of equals; none for an empty table."""
    keys = keys or []
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(x, F.struct((-F.col("_n")).alias("n"), F.col(x).alias("v"))).alias("mode"))


def outliers(df: DataFrame, x: str, keys: list[str] | None = None, factor: float = 1.5, name: str = "outlier") -> DataFrame:
    """df with a flag for values beyond factor interquartile ranges from the quartiles of their group."""
    from arraymill.operators.prefix import same_keys

    keys = keys or []
    cuts = quantiles(df, x, (25, 75), keys=keys, name="_q").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_q")[0].alias("_q1"), F.col("_q")[1].alias("_q3"))
    both = df.join(cuts, same_keys(keys, [f"_k{i}" for i in range(len(keys))])) if keys else df.crossJoin(F.broadcast(cuts))  # one row
    room = factor * (F.col("_q3") - F.col("_q1"))
    v = F.col(x).cast("double")
    return both.withColumn(name, (v < F.col("_q1") - room) | (v > F.col("_q3") + room)).select(*df.columns, name)


#: Names for describe().
STATISTICS: dict[str, Callable[[Column, str], Column]] = {
    "n_elems": n_values,
    "min": least,
    "mean": mean,
    "max": most,
    "standard_deviation": standard_deviation,
    "variance": variance,
    "sum": total,
    "skew": skew,
    "kurtosis": kurtosis,
    "median": median,
    "quartile_1": quartile_1,
    "quartile_3": quartile_3,
    "moment_2": lambda x, nan: moment(x, 2, nan),
    "moment_3": lambda x, nan: moment(x, 3, nan),
    "moment_4": lambda x, nan: moment(x, 4, nan),
}


#: Those of them that are order statistics: percentile and kind.
_ORDERED = {"median": (50, "upper"), "quartile_1": (25, "legacy"), "quartile_3": (75, "legacy")}


def describe(df: DataFrame, x: str, names: Iterable[str] = ("n_elems", "min", "mean", "max", "standard_deviation"), keys: list[str] | None = None, nan: str = "remove") -> DataFrame:
    """keys and any of the statistics by name: one aggregation, and a scan for each kind of order statistic among them."""
    from arraymill.operators.prefix import same_keys

    names, keys = list(names), keys or []
    out = df.groupBy(*keys).agg(F.lit(0).alias("__"), *(STATISTICS[n](F.col(x), nan).alias(n) for n in names if n not in _ORDERED))
    for kind in sorted({_ORDERED[n][1] for n in names if n in _ORDERED}):
        some = [n for n in names if _ORDERED.get(n, (0, ""))[1] == kind]
        got = quantiles(df, x, [_ORDERED[n][0] for n in some], kind, keys, nan, "__q")
        got = got.select(*(F.col(k).alias(f"__{kind}{i}") for i, k in enumerate(keys)), *(F.col("__q")[i].alias(n) for i, n in enumerate(some)))
        out = out.join(got, same_keys(keys, [f"__{kind}{i}" for i in range(len(keys))])) if keys else out.crossJoin(F.broadcast(got))  # one row
    return out.select(*keys, *names)


def pearson(x: Column, y: Column) -> Column:
    return F.corr(x.cast("double"), y.cast("double"))


def with_ranks(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Adds <column>_rank: ranks from 1, ties share their mean, per group.

    Ranks come from the counts of distinct values, so ties are combined before
    the window; a table without keys ranks distinct values by range partitions
    (see prefix.scan).
    """
    from arraymill.operators.prefix import running_total

    keys, out = keys or [], df
    for c in columns:
        counts = df.groupBy(*keys, c).agg(F.count("*").alias("_n"))
        if keys:
            w = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
            upto = counts.withColumn("_upto", F.sum("_n").over(w))
        else:
            upto = running_total(counts, [c], "_n", "_upto")
        ranks = upto.select(*keys, c, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"{c}_rank"))
        out = out.join(ranks, [*keys, c])
    return out


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """keys, spearman: Pearson's correlation of the ranks."""
    ranked = with_ranks(df, [x, y] if x != y else [x], keys)
    return ranked.groupBy(*(keys or [])).agg(pearson(F.col(f"{x}_rank"), F.col(f"{y}_rank")).alias("spearman"))


def _tau(x: list[float], y: list[float]) -> float:
    """Kendall's tau-b in n log n: ties by sorting, discordant pairs by counting inversions."""
    import numpy as np

    a, b = np.asarray(x, float), np.asarray(y, float)
    n = len(a)
    if n < 2:
        return NAN
    order = np.lexsort((b, a))
    a, b = a[order], b[order]

    def ties(*cols: np.ndarray) -> int:
        new = np.ones(n, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        size = np.diff(np.append(np.flatnonzero(new), n))
        return int((size * (size - 1) // 2).sum())

    tied_x, tied_both, tied_y = ties(a), ties(a, b), ties(np.sort(b))
    swaps, width, run = 0, 1, b.copy()
    while width < n:
        for lo in range(0, n, 2 * width):
            left, right = run[lo : lo + width], run[lo + width : lo + 2 * width]
            if len(right):
                swaps += int((len(left) - np.searchsorted(left, right, "right")).sum())
                run[lo : lo + 2 * width] = np.sort(run[lo : lo + 2 * width], kind="stable")
        width *= 2
    pairs = n * (n - 1) // 2
    over = (pairs - tied_x) * (pairs - tied_y)
    return (pairs - tied_x - tied_y + tied_both - 2 * swaps) / over**0.5 if over else NAN


def kendall(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """keys, kendall: tau-b of each group, a group in one task; kendall_scan() is for larger ones."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def tau(a: pd.Series, b: pd.Series) -> float:
        ok = a.notna() & b.notna()
        return _tau(a[ok].tolist(), b[ok].tolist())

    return df.groupBy(*(keys or [])).agg(tau(F.col(x).cast("double"), F.col(y).cast("double")).alias("kendall"))


def kendall_scan(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """keys, kendall: tau-b of groups of any size; rows with a null or NaN are left out.

    Ties are counted by aggregates. Discordant pairs are inversions of the dense
    ranks of y in the order of x and y; those of each bit of the ranks are
    counted by one scan: within the rows that agree in all higher bits, each
    row without the bit has the rows before it with the bit.
    """
    from arraymill.operators.prefix import positions_within, same_keys, scan_within
    from arraymill.store import fixed

    own = [f"__k{i}" for i in range(len(keys or []))] or ["__k0"]
    named = [F.col(k).alias(c) for k, c in zip(keys, own, strict=True)] if keys else [F.lit(0).alias("__k0")]
    rows = df.select(*named, values(F.col(x)).alias("__x"), values(F.col(y)).alias("__y")).where("__x is not null and __y is not null")
    ends = [f"{c}_" for c in own]
    ranks = positions_within(rows.select(*own, "__y").distinct(), own, ["__y"], "__r")
    ranks = ranks.select(*(F.col(c).alias(e) for c, e in zip(own, ends, strict=True)), F.col("__y").alias("__y_"), "__r")
    placed = positions_within(rows, own, ["__x", "__y"], "__p")
    held = fixed(placed.join(ranks, same_keys([*own, "__y"], [*ends, "__y_"])).select(*own, "__p", "__r"))
    pairs = (F.col("count") * (F.col("count") - 1) / 2).cast("double")
    parts = [rows.groupBy(*own, *by).count().select(*own, F.lit(name).alias("of"), pairs.alias("n")) for name, by in (("all", []), ("x", ["__x"]), ("y", ["__y"]), ("xy", ["__x", "__y"]))]
    for b in range(int(held.agg(F.max("__r")).first()[0] or 0).bit_length()):
        level = held.select(*own, "__p", F.shiftright("__r", b + 1).alias("__g"), F.shiftright("__r", b).bitwiseAND(1).cast("bigint").alias("__one"))
        before = scan_within(level, [*own, "__g"], ["__p"], F.col("__one"), "__before").where("__one = 0")
        parts.append(before.groupBy(*own).agg(F.sum("__before").cast("double").alias("n")).select(*own, F.lit("swaps").alias("of"), "n"))
    table = reduce(lambda a, b: a.unionByName(b), parts).groupBy(*own)
    got = table.agg(*(F.coalesce(F.sum(F.when(F.col("of") == n, F.col("n"))), F.lit(0.0)).alias(n) for n in ("all", "x", "y", "xy", "swaps")))
    over = (F.col("all") - F.col("x")) * (F.col("all") - F.col("y"))
    tau = F.when(over > 0, (F.col("all") - F.col("x") - F.col("y") + F.col("xy") - 2 * F.col("swaps")) / F.sqrt(over)).otherwise(F.lit(NAN))
    return got.select(*(F.col(c).alias(k) for c, k in zip(own, keys or [], strict=False)), tau.alias("kendall"))


def linear_regression(x: Column, y: Column) -> list[Column]:
    """slope, intercept and mse (squared errors over n - 2) of y on x; NaN where undefined."""
    n = F.regr_count(y, x)
    sse = F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)
    return [
        _else_nan(F.regr_slope(y, x)).alias("slope"),
        _else_nan(F.regr_intercept(y, x)).alias("intercept"),
        F.when(n > 2, sse / (n - 2)).otherwise(F.lit(NAN)).alias("mse"),
    ]


def dot_product(x: Column, y: Column) -> Column:
    return F.sum(x.cast("double") * y.cast("double"))


def magnitude_squared(x: Column) -> Column:
    return F.sum(x.cast("double") * x.cast("double"))


def magnitude(x: Column) -> Column:
    return F.sqrt(magnitude_squared(x))


def distance_squared(x: Column, y: Column) -> Column:
    """A pair of two NaN adds nothing."""
    a, b = x.cast("double"), y.cast("double")
    return F.sum(F.when(F.isnan(a) & F.isnan(b), 0.0).otherwise((a - b) * (a - b)))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(distance_squared(x, y))


def equals(x: Column, y: Column, tolerance: float = 1e-3) -> Column:
    """Whether two vectors are nearer than the tolerance."""
    return distance(x, y) < tolerance


def normalize(df: DataFrame, x: str, keys: list[str] | None = None, name: str = "normalized") -> DataFrame:
    """x over its magnitude in each group."""
    from arraymill.functions.expr import divide

    keys = keys or []
    size = df.groupBy(*keys).agg(magnitude(F.col(x)).alias("_m"))
    both = df.join(size, keys) if keys else df.crossJoin(F.broadcast(size))  # one row
    return both.withColumn(name, divide(F.col(x), F.col("_m"))).drop("_m")


#: Folds that are aggregates of Spark's own.
_FOLDS: dict[str, Callable[[Column], Column]] = {"add": F.sum, "min": F.min, "max": F.max, "multiply": F.product}


def fold(op: str, x: Column) -> Column:
    """add, min, max or multiply over a group's values, combined before the shuffle; null of nothing."""
    return _FOLDS[op](x)


def fold_by(df: DataFrame, op: Callable[[Column, Column], Column], x: str, keys: list[str] | None = None, name: str = "value", chunk: int = 4096) -> DataFrame:
    """keys, name: any commutative and associative operation over a group's values that are not null, for groups of any size.

    Groups are folded in parts of about chunk values until one part is left, so
    that no more than a part is ever gathered.
    """
    keys = keys or []
    one = lambda s: F.aggregate(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.get(s, F.lit(0)), op)
    now = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("__x"))
    most = now.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while most > chunk:
        parts = -(-most // chunk)
        now = now.withColumn("__p", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
        now = now.groupBy(*keys, "__p").agg(one(F.collect_list("__x")).alias("__x")).drop("__p")
        most = parts
    return now.groupBy(*keys).agg(one(F.collect_list("__x")).alias(name))


def summation(f: Callable[[Column], Column], x: Column, nan: str = "remove") -> Column:
    """The sum of f(x)."""
    return F.coalesce(F.sum(f(values(x, nan))), F.lit(0.0))


#: Rows of a task that staged() holds before it makes states of them, so that a group's cost is paid once for many batches.
_STAGED = 1 << 19


def staged(df: DataFrame, keys: list[str], x: str, step: Callable[[pd.Series], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.Series], state: str, result: str) -> DataFrame:
    """A user's accumulator: step() makes partial states of each group of each run of batches, merge() combines a group's states.

    Only states are shuffled. state and result are DDL schemas.
    """
    from collections.abc import Iterator

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    head = "".join(f"`{k}` {kinds[k]}, " for k in keys)

    def states(run: list[pd.DataFrame]) -> pd.DataFrame:
        names, made = zip(*((key, step(g)) for key, g in pd.concat(run, ignore_index=True).groupby(keys, dropna=False, sort=False)[x]), strict=True)
        of = pd.DataFrame(list(names), columns=keys)
        of = of.loc[of.index.repeat([len(m) for m in made])].reset_index(drop=True)
        return pd.concat([of, pd.concat(made, ignore_index=True)], axis=1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, size = [], 0
        for b in batches:
            if len(b):
                run, size = [*run, b], size + len(b)
            if size >= _STAGED:
                yield states(run)
                run, size = [], 0
        if run:
            yield states(run)

    def final(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, *merge(got.drop(columns=keys))]])

    made = df.select(*keys, x).mapInPandas(partial, head + state)
    return made.groupBy(*keys).applyInPandas(final, head + result)
