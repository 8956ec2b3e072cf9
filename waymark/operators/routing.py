"""Outcome tables, thresholds under a cost budget, and cost frontiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.guards import demanded, finite, matched, require, require_all, require_unique

STEPS = 100
KEYS = ("cluster_id", "variant_id")


def axis(spark: SparkSession, name: str = "theta", steps: int = STEPS) -> DataFrame:
    return spark.range(steps + 1).select((F.col("id") / float(steps)).alias(name))


def single_grid(spark: SparkSession) -> DataFrame:
    """101 thresholds from 0 to 1."""
    return axis(spark, "t1")


def pair_grid(spark: SparkSession, low: tuple[float, float] = (0.0, 0.50), high: tuple[float, float] = (0.50, 1.0)) -> DataFrame:
    """Threshold pairs t1 < t2, the first within low and the second within high."""
    a = axis(spark, "t1").filter(F.col("t1").between(*low))
    return a.crossJoin(axis(spark, "t2").filter(F.col("t2").between(*high))).filter("t1 < t2")


def weight_grid(spark: SparkSession, step: float = 0.25, dim: int = 4) -> DataFrame:
    """Weights that are multiples of step and sum to one, in lexicographic order: (weight_id, w1..w_dim)."""
    n = round(1 / step)
    parts = [spark.range(n + 1).select(F.col("id").alias(f"k{i}")) for i in range(1, dim + 1)]
    grid = reduce(lambda a, b: a.crossJoin(b), parts)
    names = [f"k{i}" for i in range(1, dim + 1)]
    grid = grid.filter(reduce(lambda a, b: a + b, map(F.col, names)) == n)
    return grid.select((F.row_number().over(Window.orderBy(*names)) - 1).alias("weight_id"), *[(F.col(k) / float(n)).alias(f"w{i}") for i, k in enumerate(names, 1)])


def cut_grid(spark: SparkSession, n_signals: int, n_actions: int) -> DataFrame:
    """Cuts on a sum of levels: t1 from 0 to 2 n_signals + 1, and for three actions t2 above it."""
    top = spark.range(2 * n_signals + 2)
    one = top.select(F.col("id").cast("double").alias("t1"))
    return one if n_actions == 2 else one.crossJoin(top.select(F.col("id").cast("double").alias("t2"))).filter("t1 < t2")


def check_thresholds(cuts: Sequence[float], actions: Sequence[str]) -> None:
    if len(cuts) != len(actions) - 1 or any(c != c or abs(c) == float("inf") for c in cuts) or any(a >= b for a, b in pairwise(cuts)):
        raise ValueError(f"{len(actions)} actions need {len(actions) - 1} finite rising thresholds, got {cuts}")


def action_index(score: Column, cuts: Sequence[Column | float]) -> Column:
    """How many thresholds a score reaches (one that equals a threshold reaches it)."""
    return reduce(lambda a, b: a + b, [(score >= (c if isinstance(c, Column) else F.lit(float(c)))).cast("int") for c in cuts])


def assign_action(score: Column, cuts: Sequence[Column | float], actions: Sequence[str]) -> Column:
    if not any(isinstance(c, Column) for c in cuts):
        check_thresholds(cuts, actions)
    return F.get(F.array(*[F.lit(a) for a in actions]), action_index(score, cuts))


def outcome_table(rows: DataFrame, actions: Sequence[str], quality: str = "f1", cost: str | Sequence[str] = "cost", keys: Sequence[str] = KEYS, keep: Sequence[str] = (), validate: bool = False, strict: bool = True) -> DataFrame:
    """One row for each instance: q_<action> and c_<action>.  cost may be several fields to add up.

    An instance without exactly one row for each action, or with a value that is no number, fails the job that reads it (strict; else it
    has nulls).  validate looks at once, in jobs of its own, and at all rows."""
    costs = [cost] if isinstance(cost, str) else list(cost)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in costs])
    if validate:
        require(rows, F.col("action").isin(*actions), "unknown action")
        require_unique(rows, [*keys, "action"], "outcomes")
        for c in (quality, *costs):
            require(rows, finite(c), f"{c} is no number")
        missing = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") < len(actions)).head(1)
        if missing:
            raise ValueError(f"an action is missing for {missing[0].asDict()}")
    at = lambda v, a: F.max(F.when(F.col("action") == a, v))
    own = {f"q_{a}": at(F.col(quality), a) for a in actions} | {f"c_{a}": at(total, a) for a in actions}
    wide = rows.groupBy(*keys, *keep).agg(*[v.alias(c) for c, v in own.items()], *[F.count_if(F.col("action") == a).alias(f"_n_{a}") for a in actions], F.count("*").alias("_n"))
    # the same grouping counts what each instance has: one row for each action and no other
    whole = reduce(lambda a, b: a & b, [F.col(f"_n_{a}") == 1 for a in actions]) & (F.col("_n") == len(actions))
    checked = lambda c: demanded(demanded(F.col(c), finite(c), f"{c} is no number", keys), whole, "not one row for each action", keys)
    return wide.select(*keys, *keep, *[(checked(c) if strict else F.col(c)).alias(c) for c in own])


def table_for(rows: DataFrame, keys: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    """The outcome rows of the given instances."""
    return rows.join(keys.select(*on).distinct(), list(on), "left_semi")


def action_indices(df: DataFrame, actions: Sequence[str], column: str = "action", name: str = "action_index") -> DataFrame:
    """df with the place of its actions, given by name or by place; any other is an error."""
    c = F.col(column).cast("string")
    at = F.coalesce(*[F.when((c == a) | (c == str(i)), i) for i, a in enumerate(actions)])
    out = df.withColumn(name, at.cast("int"))
    require(out, F.col(name).isNotNull(), f"{column} is none of {list(actions)}")
    return out


def missing_outcomes(rows: DataFrame, actions: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Instances and actions that have no row."""
    wanted = rows.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(a) for a in actions])).alias("action"))
    return wanted.join(rows, [*keys, "action"], "left_anti")


def align(table: DataFrame, values: DataFrame, keys: Sequence[str] = KEYS, validate: bool = False) -> DataFrame:
    """table with its instances' values; by key, never by place.  An instance without values, or with two rows of them, is an error: of the job
    that reads them or, with validate, at once."""
    if validate:
        require_unique(values, list(keys), "values")
        require_all(table, values, list(keys), "values")
    return matched(table, values, keys, "values")


def chosen(prefix: str, index: Column, actions: Sequence[str]) -> Column:
    return F.get(F.array(*[F.col(f"{prefix}_{a}") for a in actions]), index)


def policy_value(table: DataFrame, index: Column, actions: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean quality and cost of the actions that index names, and how often each is taken (zeros too)."""
    t = table.select(*by, chosen("q", index, actions).alias("q"), chosen("c", index, actions).alias("c"), index.alias("i"))
    return t.groupBy(*by).agg(F.avg("q").alias("quality"), F.avg("c").alias("cost"), *[F.count_if(F.col("i") == i).alias(f"n_{a}") for i, a in enumerate(actions)])


def always(table: DataFrame, actions: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(action, quality, cost) of taking one action always."""
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.avg(f"q_{a}").alias("quality"), F.avg(f"c_{a}").alias("cost")) for a in actions])
    return table.groupBy(*by).agg(rows.alias("r")).select(*by, F.explode("r").alias("r")).select(*by, "r.*")


def grid_values_naive(table: DataFrame, grid: DataFrame, score: str, actions: Sequence[str]) -> DataFrame:
    """Each cut's quality, cost and counts, by meeting every instance with every cut."""
    cuts = grid.columns
    both = table.crossJoin(F.broadcast(grid))
    return policy_value(both, action_index(F.col(score), [F.col(c) for c in cuts]), actions, by=cuts)


def threshold_values(grid: DataFrame) -> DataFrame:
    """(value): the distinct values of a grid's cuts, whichever cut they are of."""
    return grid.select(F.explode(F.array(*grid.columns)).alias("value")).distinct()


def reached(score: Column, values: Sequence[float], first: int = 0) -> Column:
    """How many of the rising values a score reaches: a tree of comparisons with the values themselves."""
    if not values:
        return F.lit(first)
    mid = len(values) // 2
    return F.when(score >= F.lit(values[mid]), reached(score, values[mid + 1 :], first + mid + 1)).otherwise(reached(score, values[:mid], first))


def grid_values(table: DataFrame, grid: DataFrame, score: str, actions: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The same by prefix sums.  An instance matters for a cut only through how many of the grid's distinct
    values its score reaches, so instances are summed up by that number first (a row for each value at
    most), and cuts meet those sums.  Scores are compared with the values themselves, never scaled to a place."""
    cuts = grid.columns
    values = sorted(r[0] for r in threshold_values(grid).collect())  # the axis: a few hundred numbers
    sums = table.groupBy(*by, reached(F.col(score), values).alias("reached")).agg(F.count("*").alias("n"), *[F.sum(f"{p}_{a}").alias(f"{p}_{a}") for p in "qc" for a in actions])
    place = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i + 1)])
    cut_rows = grid.select(*cuts, *[F.element_at(place, F.col(c)).alias(f"p_{c}") for c in cuts])
    both = sums.crossJoin(F.broadcast(cut_rows))
    index = reduce(lambda a, b: a + b, [(F.col("reached") >= F.col(f"p_{c}")).cast("int") for c in cuts])
    both = both.select(*by, *cuts, "n", index.alias("i"), chosen("q", index, actions).alias("q"), chosen("c", index, actions).alias("c"))
    total = both.groupBy(*by, *cuts).agg(F.sum("q").alias("q"), F.sum("c").alias("c"), F.sum("n").alias("n"), *[F.sum(F.when(F.col("i") == i, F.col("n")).otherwise(0)).alias(f"n_{a}") for i, a in enumerate(actions)])
    return total.select(*by, *cuts, (F.col("q") / F.col("n")).alias("quality"), (F.col("c") / F.col("n")).alias("cost"), *[f"n_{a}" for a in actions])


def budget_of(table: DataFrame, actions: Sequence[str], kind: str) -> DataFrame:
    """One row: the mean cost of the middle action, or half way between the first and the last."""
    if kind == "middle":
        return table.agg(F.avg(f"c_{actions[1]}").alias("budget"))
    return table.agg(((F.avg(f"c_{actions[0]}") + F.avg(f"c_{actions[-1]}")) / 2).alias("budget"))


def select_thresholds(values: DataFrame, budget: DataFrame, cuts: Sequence[str], by: Sequence[str] = (), more: Sequence[str] = (), digits: int = 12) -> DataFrame:
    """The cut of the highest quality whose cost is within budget; then the cheapest, then the lowest cut (then
    more).  One row (for each of by): cut, quality, cost, budget, counts, n_feasible; none if no cut is feasible."""
    ok = values.crossJoin(F.broadcast(budget)).filter(F.col("cost") <= F.col("budget") + 1e-12)
    rest = [c for c in values.columns if c not in (*by, *cuts, *more)]
    key = F.struct((-F.round("quality", digits)).alias("a"), F.round("cost", digits).alias("b"), *cuts, *more)
    best = ok.groupBy(*by).agg(F.min_by(F.struct(*cuts, *more, *rest, "budget"), key).alias("x"), F.count("*").alias("n_feasible"))
    return best.filter("x is not null").select(*by, "x.*", "n_feasible")


def fit(values: DataFrame, budget: DataFrame, cuts: Sequence[str], **how) -> DataFrame:
    """select_thresholds, with an error that names the cheapest cost if nothing is within budget."""
    out = select_thresholds(values, budget, cuts, **how)
    if out.isEmpty():
        raise ValueError(f"no threshold meets the cost budget; the lowest cost is {values.agg(F.min('cost')).head()[0]}")
    return out


def frontier(values: DataFrame, cuts: Sequence[str], digits: int = 12) -> DataFrame:
    """For each cost that a cut reaches: the best cut of at most that cost.  (budget, quality, cost, cuts)"""
    key = F.struct((-F.round("quality", digits)).alias("a"), F.round("cost", digits).alias("b"), *cuts)
    per = values.groupBy(F.round("cost", digits).alias("budget")).agg(F.min(key).alias("k"))
    # one row for each distinct cost of the grid: a few thousand at most
    best = per.select("budget", F.min("k").over(Window.orderBy("budget").rowsBetween(Window.unboundedPreceding, 0)).alias("k"))
    return best.select("budget", (-F.col("k.a")).alias("quality"), F.col("k.b").alias("cost"), *[F.col(f"k.{c}").alias(c) for c in cuts])
