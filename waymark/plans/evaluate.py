"""Evaluation in one call: every router fitted on validation, all of them measured on a test set, compared, and judged.

A set's routers and reference policies are one table with a router column, so each measure is one grouped plan, whatever the number of routers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import config as C
from waymark.functions.fuzzy import escalation
from waymark.operators import baselines, evaluation, routing
from waymark.operators.baselines import DIGITS

# The ablations of the controller's operators.
ABLATIONS = {"B4-product": {"tnorm": "product"}, "B4-probsum": {"aggregation": "probsum"}, "B4-sugeno": {"defuzz": "sugeno"}}
BASELINES = ("B1", "B2", "B3")


@dataclass
class Router:
    """A fitted router: what adds its score to a table, and its fit (cuts, quality, cost, budget and more)."""

    name: str
    score: Callable[[DataFrame], DataFrame]
    fit: dict

    @property
    def cuts(self) -> list[float]:
        return [self.fit[c] for c in ("t1", "t2") if c in self.fit]

    def route(self, table: DataFrame) -> DataFrame:
        return self.score(table).withColumn("action_index", routing.action_index(F.col("score"), self.cuts)).withColumn("router", F.lit(self.name))


@dataclass
class Fitted:
    """Routers by name, and why others have no fit."""

    routers: dict[str, Router] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def _scored(c: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda t: t.withColumn("score", F.round(c.cast("double"), DIGITS) + 0.0)


def _fuzzy(signals: Sequence[str], widths: Sequence[float] | float, **operators) -> Callable[[DataFrame], DataFrame]:
    return lambda t: escalation(t, signals, widths, **operators).withColumn("score", F.round("score", DIGITS) + 0.0)


def grids(spark: SparkSession, profile: C.Profile) -> tuple[DataFrame, DataFrame]:
    """Cuts of scores, and of sums of levels."""
    scores = routing.pair_grid(spark) if len(profile.actions) == 3 else routing.single_grid(spark)
    return scores, routing.cut_grid(spark, len(profile.signals), len(profile.actions))


def scores(profile: C.Profile, widths: Sequence[float] | float = C.WIDTH_FLOOR, more: Mapping[str, tuple[Sequence[str], Sequence[float] | float]] | None = None, ablations: Mapping[str, dict] = ABLATIONS) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The scores whose ranking has no fitted parameter: B2, B3 (the fixed width), B4 (calibrated widths), its ablations, and
    further controllers (name: signals, widths)."""
    out = {"B2": _scored(baselines.ordinal(profile.signals)), "B3": _fuzzy(profile.signals, C.WIDTH_FLOOR), "B4": _fuzzy(profile.signals, widths)}
    out |= {name: _fuzzy(profile.signals, widths, **operators) for name, operators in ablations.items()}
    return out | {name: _fuzzy(signals, own) for name, (signals, own) in (more or {}).items()}


def fit_routers(val: DataFrame, profile: C.Profile, own: Mapping[str, Callable[[DataFrame], DataFrame]], train: DataFrame | None = None, features: Sequence[str] = (), budget: DataFrame | None = None) -> Fitted:
    """Every router's fit on validation within the budget (the profile's own unless one is given): B1, those of own (see scores), and from
    train's oracle actions the query-only router over features.  A router without a feasible cut is an error of its own, not of all.

    val and train: tables of instances with q_ and c_ of each action, signals and features."""
    spark, actions, out = val.sparkSession, profile.actions, Fitted()
    grid, levels = grids(spark, profile)
    budget = routing.budget_of(val, actions, profile.budget) if budget is None else budget
    try:
        best = baselines.fit_weighted(val, profile.signals, routing.weight_grid(spark, dim=len(profile.signals)), grid, budget, actions).head()
        if best is None:
            raise ValueError("no weights and threshold meet the cost budget")
        fit = best.asDict()
        out.routers["B1"] = Router("B1", _scored(baselines.weighted(profile.signals, [fit[f"w{i}"] for i in range(1, len(profile.signals) + 1)])), fit)
    except ValueError as e:
        out.errors["B1"] = str(e)
    every = dict(own)
    if train is not None and features:
        model = baselines.fit_learned(train.withColumn("label", evaluation.oracle_index(actions)), list(features), "label", len(actions))
        every["query-only"] = _scored(baselines.learned_score(model))
    for name, score in every.items():
        cuts = levels if name == "B2" else grid
        try:
            values = routing.grid_values(score(val), cuts, "score", actions)
            out.routers[name] = Router(name, score, routing.fit(values, budget, cuts.columns).head().asDict())
        except ValueError as e:
            out.errors[name] = str(e)
    return out


def routed(test: DataFrame, fitted: Fitted, actions: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(router, cluster_id, variant_id, q_ and c_ of each action, keep, score, action_index) of every router, each fixed policy and the oracle."""
    cols = ["router", "cluster_id", "variant_id", *[f"{p}_{a}" for p in "qc" for a in actions], *keep, "score", "action_index"]
    fixed = [(f"always-{a}", F.lit(i)) for i, a in enumerate(actions)] + [("oracle", evaluation.oracle_index(actions))]
    parts = [test.withColumns({"router": F.lit(n), "score": F.lit(None).cast("double"), "action_index": i}) for n, i in fixed]
    return reduce(lambda a, b: a.unionByName(b), [x.select(*cols) for x in (*[r.route(test) for r in fitted.routers.values()], *parts)])


def measure_all(table: DataFrame, actions: Sequence[str], more: Sequence[str] = (), n_boot: int = C.N_BOOT) -> DataFrame:
    """Of each router: evaluation.measure's bundle, and intervals of quality, cost, flips and harmful flips over resampled clusters (<name>_lo, <name>_hi)."""
    i, by = F.col("action_index"), ["router"]
    out = evaluation.measure(table, actions, more, by)
    flags = evaluation.pair_flags(table, actions, by=by)
    for name, df, value in (("quality", table, routing.chosen("q", i, actions)), ("cost", table, routing.chosen("c", i, actions)), ("rfr", flags, F.col("flipped").cast("double")), ("hrfr", flags, F.col("harmful").cast("double"))):
        ci = evaluation.bootstrap_hashed(evaluation.cluster_sums(df, value, by=by), n_boot, by=by)
        out = out.join(ci.select("router", F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi")), "router", "left")
    return out


def paired(table: DataFrame, actions: Sequence[str], reference: str = "B4", n_boot: int = C.N_BOOT) -> DataFrame:
    """(router, what, diff, lo, hi, significant): the reference less each other router in quality, cost and harmful flips, on the same resamples."""
    i, by = F.col("action_index"), ["router"]
    flags = evaluation.pair_flags(table, actions, by=by)
    parts = []
    for what, df, value in (("quality", table, routing.chosen("q", i, actions)), ("cost", table, routing.chosen("c", i, actions)), ("hrfr", flags, F.col("harmful").cast("double"))):
        sums = evaluation.cluster_sums(df, value, by=by)
        own = sums.filter(F.col("router") == reference).select("cluster_id", F.col("s").alias("r"))
        both = sums.filter(F.col("router") != reference).join(own, "cluster_id")
        parts.append(evaluation.bootstrap_hashed(both, n_boot, ["r", "s"], by=by).withColumn("what", F.lit(what)))
    return reduce(lambda a, b: a.unionByName(b), parts).select("router", "what", "diff", "lo", "hi", "significant")


def strongest(results: DataFrame, among: Sequence[str] = BASELINES) -> DataFrame:
    """One row: the baseline of the highest quality, the first of equals; its quality and cost."""
    at = F.coalesce(*[F.when(F.col("router") == n, i) for i, n in enumerate(among)])
    own = results.filter(F.col("router").isin(*among))
    return own.agg(F.max_by(F.struct("router", "quality", "cost"), F.struct("quality", -at)).alias("x")).select(F.col("x.router").alias("strongest"), F.col("x.quality").alias("s_quality"), F.col("x.cost").alias("s_cost"))


def criteria(results: DataFrame, comparisons: DataFrame, test: DataFrame, actions: Sequence[str], reference: str = "B4", points: float = 0.01) -> DataFrame:
    """One row of findings on the reference router: strongest_baseline, lower_hrfr (harmful flips lower, and significantly), within_1_point,
    cost_not_higher, actions_used, mixture (the best quality of fixed policies and their mixtures at its cost) and beats_mixtures."""
    own = results.filter(F.col("router") == reference)
    used = reduce(lambda a, b: a + b, [(F.col(f"n_{a}") > 0).cast("int") for a in actions])
    mine = own.select("quality", "cost", used.alias("actions_used"))
    mix = evaluation.mixture(test, own.select("cost"), actions).select("mixture")
    hrfr = comparisons.filter("what = 'hrfr'").select(F.col("router").alias("strongest"), (F.col("significant") & (F.col("diff") < 0)).alias("lower_hrfr"))
    # a row each
    row = mine.crossJoin(strongest(results)).crossJoin(mix).join(hrfr, "strongest", "left")
    beats = F.col("mixture").isNull() | (F.col("quality") >= F.col("mixture"))
    return row.select(F.col("strongest").alias("strongest_baseline"), "lower_hrfr", (F.abs(F.col("quality") - F.col("s_quality")) <= points).alias("within_1_point"), (F.col("cost") <= F.col("s_cost")).alias("cost_not_higher"), "actions_used", "mixture", beats.alias("beats_mixtures"))


def pareto(val: DataFrame, test: DataFrame, fitted: Fitted, profile: C.Profile) -> DataFrame:
    """(router, budget, cuts, val_quality, test_quality, test_cost): each router's frontier on validation, every point of it measured on test."""
    grid, levels = grids(val.sparkSession, profile)
    parts = []
    for name, r in fitted.routers.items():
        cuts = levels if name == "B2" else grid
        front = routing.frontier(routing.grid_values(r.score(val), cuts, "score", profile.actions), cuts.columns)
        there = routing.grid_values(r.score(test), cuts, "score", profile.actions).select(*cuts.columns, F.col("quality").alias("test_quality"), F.col("cost").alias("test_cost"))
        parts.append(front.join(there, cuts.columns).select(F.lit(name).alias("router"), "budget", *cuts.columns, F.col("quality").alias("val_quality"), "test_quality", "test_cost"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def signal_check(table: DataFrame, profile: C.Profile, own: Mapping[str, Callable[[DataFrame], DataFrame]], delta: float = C.DELTA) -> DataFrame:
    """(name, auc, n_pos, n_neg): how well each signal and score tells where the dearest action beats the one before by more than delta."""
    low, high = profile.actions[-2:]
    pos = (F.col(f"q_{high}") > F.col(f"q_{low}") + delta + C.TOL).alias("pos")
    keys = [F.lit(s).alias("name") for s in profile.signals]
    parts = [table.select(k, F.col(s).alias("value"), pos) for k, s in zip(keys, profile.signals, strict=True)]
    parts += [score(table).select(F.lit(name).alias("name"), F.col("score").alias("value"), pos) for name, score in own.items()]
    return evaluation.auc(reduce(lambda a, b: a.unionByName(b), parts), "value", "pos", ["name"])


def evaluate_set(test: DataFrame, fitted: Fitted, actions: Sequence[str], more: Sequence[str] = (), n_boot: int = C.N_BOOT) -> dict[str, DataFrame]:
    """results, comparisons and criteria of one test set (the latter two need B4)."""
    table = routed(test, fitted, actions, [f"{m}_{a}" for m in more for a in actions])
    out = {"results": measure_all(table, actions, more, n_boot)}
    if "B4" in fitted.routers:
        out["comparisons"] = paired(table, actions, n_boot=n_boot)
        out["criteria"] = criteria(out["results"], out["comparisons"], test, actions)
    return out


def evaluate_dataset(table: DataFrame, profile: C.Profile, widths: Sequence[float] | float = C.WIDTH_FLOOR, features: Sequence[str] = (), more: Sequence[str] = (), n_boot: int = C.N_BOOT, fresh: DataFrame | None = None) -> dict:
    """Everything on one dataset's instances (split, q_, c_, signals, features): fits and errors, the signal check on train and validation, oracle
    shares, the test set's (and a fresh set's) results, comparisons and criteria, and frontiers measured on the first of fresh and test."""
    split = lambda s: table.filter(F.col("split") == s)
    own = scores(profile, widths)
    fitted = fit_routers(split("val"), profile, own, split("train"), features)
    sets = ({"fresh": fresh} if fresh is not None else {}) | {"test": split("test")}
    out: dict = {"fitted": fitted, "signal_check": signal_check(table.filter("split in ('train', 'val')"), profile, own), "oracle_shares": evaluation.oracle_shares(table, profile.actions, ["split"])}
    out |= {name: evaluate_set(t, fitted, profile.actions, more, n_boot) for name, t in sets.items()}
    return out | {"pareto": pareto(split("val"), next(iter(sets.values())), fitted, profile)}


def pooled(parts: Sequence[tuple[DataFrame, Fitted]], actions: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """routed() of several datasets' test instances, each by its own dataset's fits; only routers that every dataset has."""
    names = set.intersection(*[set(f.routers) for _, f in parts])
    both = [routed(t, Fitted({n: r for n, r in f.routers.items() if n in names}), actions, [f"{m}_{a}" for m in more for a in actions]) for t, f in parts]
    return reduce(lambda a, b: a.unionByName(b), both)


def choose_instances(queries: DataFrame, splits: DataFrame | None = None, only: Sequence[str] = (), complete: DataFrame | None = None, n_pilot: int | None = None, seed: int = C.SEED) -> DataFrame:
    """queries of all instances; or of some splits' clusters (splits: cluster_id, split); or of n_pilot complete train clusters (complete:
    cluster_id) by a seeded permutation of their sorted ids, which the driver holds."""
    from waymark.operators.clusters import sample

    if n_pilot is not None:
        ids = sorted((r[0] for r in complete.join(splits.filter("split = 'train'"), "cluster_id", "left_semi").select("cluster_id").distinct().collect()), key=str)
        chosen = [ids[i] for i in sample(len(ids), min(n_pilot, len(ids)), seed)]
        return queries.filter(F.col("cluster_id").isin(chosen))
    if only:
        return queries.join(splits.filter(F.col("split").isin(*only)), "cluster_id", "left_semi")
    return queries
