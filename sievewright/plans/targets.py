"""Named report targets over measurement tables: each composes core operators and compares with printed values.

Tables: ``pairs`` (item_id, ordinal, layer, cell, role, run, seed, correct_a, correct_b, pair_correct) and ``audits``
(qid, category, condition, bits). ``TARGETS`` maps a name to a function of both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators import compare, ranking, resampling

Target = Callable[[DataFrame, DataFrame], DataFrame]
TARGETS: dict[str, Target] = {}


def target(*names: str):
    def add(f: Target) -> Target:
        for n in names:
            TARGETS[n] = f
        return f

    return add


def _r(c: Column) -> Column:
    return F.round(c, 9)


def _pair(c: str = "pair_correct") -> Column:
    return F.col(c).cast("double")


def _member() -> Column:
    return (F.col("correct_a").cast("int") + F.col("correct_b").cast("int")) / 2


def _hits() -> Column:
    return F.size(F.filter("bits", lambda x: x))


def _last(pairs: DataFrame) -> DataFrame:
    return compare.last_wins(pairs, ["run", "seed", "item_id"])


@target("table1")
def accuracy_by_run(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Accuracy of each run over its seeds: mean and deviation of seed means."""
    return compare.seed_means(pairs, ["run"], "seed", "pair_correct").withColumnsRenamed({"mean": "value"})


@target("tableD2")
def ratio_to_base(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Accuracy per cell of the tuned runs over that of the base runs."""
    mean = lambda r: F.avg(F.when(F.col("run") == r, _pair()))
    return pairs.groupBy("cell").agg(_r(mean("base")).alias("base"), _r(mean("tuned")).alias("tuned")).withColumn("value", _r(F.try_divide("tuned", "base")))


@target("tableA1")
def chance_corrected(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Blind share of the real success rate above a per-item chance of 1/16, per category."""
    c = audits.groupBy("category", "condition").agg(F.avg(_hits() / 16).alias("p"))
    g = c.groupBy("category").agg(F.max(F.when(F.col("condition") == "real", F.col("p"))).alias("real"), F.max(F.when(F.col("condition") == "blind", F.col("p"))).alias("blind"))
    base = F.col("real") - 1 / 16
    return g.select("category", _r(F.col("real")).alias("real"), _r(F.col("blind")).alias("blind"), F.when(F.abs(base) >= 1e-12, _r((F.col("blind") - 1 / 16) / base)).alias("value"))


@target("appendixB")
def member_range(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Smallest and largest member accuracy over cells, per run."""
    each = pairs.groupBy("run", "cell", "layer").agg(F.avg(_member()).alias("m"))
    return each.groupBy("run").agg(_r(F.min("m")).alias("low"), _r(F.max("m")).alias("value"), F.count("*").alias("n_cells"))


@target("tableG1")
def member_with_interval(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Members right per run with the Wilson interval."""
    g = pairs.groupBy("run").agg(F.sum(F.col("correct_a").cast("int") + F.col("correct_b").cast("int")).alias("k"), (2 * F.count("*")).alias("n"))
    w = compare.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.withColumn("w", w).select("run", "k", "n", _r(F.col("k") / F.col("n")).alias("value"), _r(F.col("w.low")).alias("ci_low"), _r(F.col("w.high")).alias("ci_high"))


@target("tableG2")
def paired_delta(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Mean member change from base to tuned on shared items, per layer, with a bootstrap interval."""
    one = _last(pairs.where("seed = 0")).select("run", "item_id", "layer", "ordinal", _member().alias("m"))
    a, b = one.where("run = 'base'").select("item_id", F.col("m").alias("before")), one.where("run = 'tuned'")
    return resampling.bootstrap_cells(b.join(a, "item_id").select("layer", "ordinal", (F.col("m") - F.col("before")).alias("d")), ["layer"], "d", "ordinal")


@target("tableG3")
def pair_change(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Pair accuracy of both runs on shared items per cell, and their difference."""
    one = _last(pairs.where("seed = 0"))
    side = lambda r: one.where(F.col("run") == r).select("item_id", "cell", _pair().alias(r))
    j = side("base").join(side("tuned").drop("cell"), "item_id")
    return j.groupBy("cell").agg(F.count("*").alias("n"), _r(F.avg("base")).alias("base"), _r(F.avg("tuned")).alias("tuned"), _r(F.avg(F.col("tuned") - F.col("base"))).alias("value"))


@target("tableE1")
def change_by_step(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Change of pair accuracy of every later run against the first, on the ids of both."""
    one = _last(pairs).select("item_id", (F.col("seed") + F.when(F.col("run") == "tuned", 2).otherwise(0)).alias("step"), _pair().alias("v"))
    return compare.paired_change(one, "item_id", "step", 0, "v")


@target("tableE2")
def failed_overlap(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Overlap of the failed items of two seeds, per run: union, common and Jaccard share."""
    one = _last(pairs).where(~F.col("pair_correct"))
    g = one.groupBy("run", "item_id").agg(F.count_distinct("seed").alias("k"))
    return g.groupBy("run").agg(F.count("*").alias("either"), F.sum((F.col("k") == 2).cast("long")).alias("both")).withColumn("value", _r(F.col("both") / F.col("either")))


@target("appendixE")
def churn(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Items gained and lost from base to tuned, per role, and the net gain."""
    one = _last(pairs.where("seed = 0"))
    side = lambda r: one.where(F.col("run") == r).select("item_id", "role", F.col("pair_correct").alias(r))
    j = side("base").join(side("tuned").drop("role"), "item_id")
    gain, loss = F.sum((~F.col("base") & F.col("tuned")).cast("long")), F.sum((F.col("base") & ~F.col("tuned")).cast("long"))
    return j.groupBy("role").agg(gain.alias("gained"), loss.alias("lost"), (gain - loss).alias("value"))


@target("tableH1")
def strata(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Items per decile of the real success rate and category."""
    r = audits.where("condition = 'real'").select("category", ranking.decile_band(_hits() / 16).alias("band"))
    return r.groupBy("category", "band").agg(F.count("*").alias("value"))


@target("figure5")
def gain_by_decile(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Mean gain of the real over the blind condition for items never solved blind and for deciles of the rest."""
    side = lambda c: audits.where(F.col("condition") == c).select("qid", _hits().alias(c))
    j = side("real").join(side("blind"), "qid").select("qid", F.col("blind").alias("hits"), ((F.col("blind") + 0.5) / 17).alias("q"), ((F.col("real") - F.col("blind")) / 16).alias("gain"))
    return ranking.floor_and_deciles(j, "hits", "q", "gain", "qid").withColumnRenamed("mean_gain", "value")


@target("figure3a")
def lattice_shares(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Share of items in each cell of the lattice of real and blind rates, step 1/4."""
    side = lambda c: audits.where(F.col("condition") == c).select("qid", ranking.lattice(_hits() / 16, 0.25).alias(c))
    j = side("real").join(side("blind"), "qid").groupBy("real", "blind").agg(F.count("*").alias("n"))
    total = j.agg(F.sum("n").alias("t"))
    return j.crossJoin(F.broadcast(total)).select("real", "blind", "n", _r(F.col("n") / F.col("t")).alias("value"))


@target("section5")
def corpus_counts(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Items, learnable items and items that need the image, per category."""
    side = lambda c: audits.where(F.col("condition") == c).select("qid", "category", (_hits() / 16).alias(c))
    j = side("real").join(side("blind").drop("category"), "qid")
    learnable = (F.col("real") > 0) & (F.col("real") < 1)
    return j.groupBy("category").agg(F.count("*").alias("n"), F.sum(learnable.cast("long")).alias("learnable"), F.sum((F.col("real") > F.col("blind")).cast("long")).alias("value"))


@target("tableB2")
def shares_of_movement(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Share of each layer in the total gain of members."""
    one = _last(pairs.where("seed = 0")).select("run", "item_id", "layer", _member().alias("m"))
    side = lambda r: one.where(F.col("run") == r).select("item_id", "layer", F.col("m").alias(r))
    j = side("base").join(side("tuned").drop("layer"), "item_id").select("layer", (F.col("tuned") - F.col("base")).alias("gain"))
    return compare.movement_share(j, "layer", "gain").withColumnRenamed("share", "value")


@target("tableC1")
def best_layer(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Layer with the best pair accuracy per run; ties go to the first name."""
    each = pairs.groupBy("run", "layer").agg(_r(F.avg(_pair())).alias("m"))
    return each.groupBy("run").agg(F.min_by("layer", F.struct(-F.col("m"), "layer")).alias("layer"), F.max("m").alias("value"))


@target("figure2a")
def pair_against_best(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Pair accuracy of each run, the best one over its layers, and the share of pairs of which one member is right."""
    half = F.avg((F.col("correct_a") != F.col("correct_b")).cast("double"))
    each = pairs.groupBy("run", "layer").agg(F.avg(_pair()).alias("m")).groupBy("run").agg(_r(F.max("m")).alias("best"))
    return pairs.groupBy("run").agg(_r(F.avg(_pair())).alias("value"), _r(half).alias("one_right")).join(each, "run")


@target("tableA2")
def retained_above_item_chance(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Tuned over base pair accuracy per layer, both above the mean chance of the shared items (one over the points of a cell)."""
    one = _last(pairs.where("seed = 0"))
    side = lambda r: one.where(F.col("run") == r).select("item_id", "layer", "cell", _pair().alias(r))
    chance = 1 / F.substring("cell", 2, 4).cast("double")
    g = side("base").join(side("tuned").select("item_id", "tuned"), "item_id").groupBy("layer").agg(F.count("*").alias("n"), F.avg("base").alias("b"), F.avg("tuned").alias("t"), F.avg(chance).alias("c"))
    return g.select("layer", "n", _r(F.col("c")).alias("chance"), F.when(F.abs(F.col("b") - F.col("c")) >= 1e-12, _r((F.col("t") - F.col("c")) / (F.col("b") - F.col("c")))).alias("value"))


@target("tableB3")
def member_grid(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Member accuracy of each run over the grid of cells and layers."""
    return pairs.groupBy("run", "cell", "layer").agg(F.count("*").alias("n"), _r(F.avg(_member())).alias("value"))


@target("tableG4")
def pair_change_by_seed(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Pair accuracy of both runs on the items they share, seed by seed, and the change."""
    one = _last(pairs)
    side = lambda r: one.where(F.col("run") == r).select("seed", "item_id", _pair().alias(r))
    g = side("base").join(side("tuned"), ["seed", "item_id"]).groupBy("seed")
    return g.agg(F.count("*").alias("n"), _r(F.avg("base")).alias("base"), _r(F.avg("tuned")).alias("tuned"), _r(F.avg(F.col("tuned") - F.col("base"))).alias("value"))


@target("figure2b")
def accuracy_by_step(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Pair accuracy at every step of the run, with the Wilson interval."""
    step = F.col("seed") + F.when(F.col("run") == "tuned", 2).otherwise(0)
    g = _last(pairs).groupBy(step.alias("step")).agg(F.sum(_pair()).alias("k"), F.count("*").cast("double").alias("n"))
    w = compare.wilson(F.col("k"), F.col("n"))
    return g.withColumn("w", w).select("step", F.col("n").cast("long").alias("n"), _r(F.col("k") / F.col("n")).alias("value"), _r(F.col("w.low")).alias("ci_low"), _r(F.col("w.high")).alias("ci_high"))


@target("figure2c")
def correct_regions(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Items by which of three runs solve them: the regions of the three sets of solved items."""
    solved = _last(pairs).where("pair_correct").select("item_id", F.concat_ws("", F.col("run"), F.col("seed").cast("string")).alias("s")).where(F.col("s").isin("base0", "tuned0", "tuned1"))
    held = solved.groupBy("item_id").agg(*[F.max((F.col("s") == x).cast("int")).alias(x) for x in ("base0", "tuned0", "tuned1")])
    return held.groupBy("base0", "tuned0", "tuned1").agg(F.count("*").alias("value"))


@target("tableH2")
def standardised(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Real success rate per category with the blind strata weighted as in all categories together, over the strata a category has."""
    side = lambda c: audits.where(F.col("condition") == c).select("qid", "category", _hits().alias(c))
    j = side("real").join(side("blind").select("qid", "blind"), "qid").withColumn("band", ranking.decile_band(F.col("blind") / 16))
    pooled = j.groupBy("band").agg(F.count("*").alias("w"))
    cells = j.groupBy("category", "band").agg(F.avg(F.col("real") / 16).alias("m")).join(F.broadcast(pooled), "band")
    return cells.groupBy("category").agg(F.count("*").alias("n_bands"), _r(F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("value"))


@target("tableH3")
def gain_slope(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Slope of the gain of the image over the blind rate, per category; null where all blind rates are equal."""
    side = lambda c: audits.where(F.col("condition") == c).select("qid", "category", (_hits() / 16).alias(c))
    j = side("real").join(side("blind").select("qid", "blind"), "qid").withColumn("gain", F.col("real") - F.col("blind"))
    spread = F.var_pop("blind")
    return j.groupBy("category").agg(F.count("*").alias("n"), F.when(spread > 1e-15, _r(F.covar_pop("blind", "gain") / spread)).alias("value"))


@target("figure4")
def panels(pairs: DataFrame, audits: DataFrame) -> DataFrame:
    """Three panels: member accuracy by run, pair change by cell, and the share of items that only the tuned run solves by layer."""
    one = _last(pairs.where("seed = 0"))
    side = lambda r: one.where(F.col("run") == r).select("item_id", "layer", F.col("pair_correct").alias(r))
    new = side("base").join(side("tuned").select("item_id", "tuned"), "item_id").groupBy("layer").agg(_r(F.avg((~F.col("base") & F.col("tuned")).cast("double"))).alias("value"))
    parts = [
        member_with_interval(pairs, audits).select(F.lit("a").alias("panel"), F.col("run").alias("name"), "value"),
        pair_change(pairs, audits).select(F.lit("b").alias("panel"), F.col("cell").alias("name"), "value"),
        new.select(F.lit("c").alias("panel"), F.col("layer").alias("name"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def run(name: str, pairs: DataFrame, audits: DataFrame, printed: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """A target, compared with printed values if given: ``printed`` has the keys, paper_value, relation and tolerance."""
    if name not in TARGETS:
        raise ValueError(f"unknown target: {name}")
    out = TARGETS[name](pairs, audits)
    if printed is None:
        return out
    joined = out.join(F.broadcast(printed), on or [], "left")
    return joined.withColumn("outcome", compare.outcome(F.col("value").cast("double"), F.col("paper_value"), F.col("relation"), F.col("tolerance")))


def summary(compared: DataFrame) -> DataFrame:
    """Rows per outcome of a compared target."""
    return compared.groupBy(F.coalesce("outcome", F.lit("nothing printed")).alias("outcome")).agg(F.count("*").alias("n"))
