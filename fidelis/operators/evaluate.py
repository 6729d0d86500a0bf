"""Scoring predictors: F1, AUROC, agreement, operating points, bootstrap intervals, multiplicity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.stats import f1, hash_uniform, wilson
from fidelis.operators.ranges import Ranged, running


def macro_f1(truth: Column, pred: Column) -> Column:
    """Aggregate: mean F1 of the two classes of 0/1 columns."""
    n = lambda t, p: F.count_if((truth == t) & (pred == p)).cast("double")
    tp, fp, fn, tn = n(1, 1), n(0, 1), n(1, 0), n(0, 0)
    return (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2


def auroc(df: DataFrame, score: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with ties at half, for each group; null for a single class.

    Rows are first counted by score, so ranking runs over distinct scores, and by ranges of them.
    """
    by = by or []
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    # Negatives below run over all groups in a row; each group's own start is taken off in its sum.
    ranked = running(counts, [*map(F.col, by), F.col(score)], {"below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) - F.sum("pos") * F.min("below")
    total = ranked.groupBy(*by).agg(wins.alias("w"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.select(*by, F.try_divide(F.col("w"), F.col("pos").cast("double") * F.col("neg")).alias("auroc"), F.col("pos").cast("long").alias("n_pos"), F.col("neg").cast("long").alias("n_neg"))


def operating_point(df: DataFrame, score: str, truth: str) -> DataFrame:
    """The threshold (predict 1 at or above) of largest macro-F1 over scored rows, the larger one on ties; one row, none without a score.

    Rows without a score are no candidates and in no class of the metric; `unscored` says how many they are.
    """
    every = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"), F.count("*").alias("n"))
    counts = every.where("threshold is not null")
    above = running(counts, [F.desc("threshold")], {"pos_above": F.col("pos"), "neg_above": F.col("neg")})
    total = above.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    swept = above.withColumn("tp", (F.col("pos_above") + F.col("pos")).cast("double")).withColumn("fp", (F.col("neg_above") + F.col("neg")).cast("double")).crossJoin(F.broadcast(total))
    fn, tn = F.col("all_pos") - F.col("tp"), F.col("all_neg") - F.col("fp")
    swept = swept.withColumn("macro_f1", F.round((f1(F.col("tp"), F.col("fp"), fn) + f1(tn, fn, F.col("fp"))) / 2, 12))
    best = swept.agg(F.max_by("threshold", F.struct("macro_f1", "threshold")).alias("threshold"), F.max("macro_f1").alias("macro_f1"))
    unscored = every.where("threshold is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unscored"))
    return best.where("macro_f1 is not null").crossJoin(F.broadcast(unscored))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns over rows that have both, with its large-sample interval."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy("x").agg(F.sum("n").alias("p"))
    cols = cells.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("q"))
    chance = rows.join(cols, "x").agg(F.coalesce(F.sum(F.col("p").cast("double") * F.col("q")), F.lit(0.0)).alias("c"))
    n = F.col("n").cast("double")
    out = total.crossJoin(chance).withColumn("po", F.try_divide("same", n)).withColumn("pe", F.try_divide("c", n * n))
    k, half = F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), 1.96 * F.sqrt(F.try_divide(F.col("po") * (1 - F.col("po")), n * (1 - F.col("pe")) * (1 - F.col("pe"))))
    return out.select(k.alias("kappa"), (k - half).alias("low"), (k + half).alias("high"), F.col("n").cast("long").alias("n"))


def kappa_pairs(votes: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """Cohen's kappa of each pair of raters over the items that both have a yes or no for, with its large-sample interval; null where chance alone agrees always."""
    a = votes.select(item, F.col(rater).alias(f"{rater}_a"), F.col(label).cast("boolean").alias("x"))
    b = votes.select(item, F.col(rater).alias(f"{rater}_b"), F.col(label).cast("boolean").alias("y"))
    both = a.join(b, item).where(F.col(f"{rater}_a") < F.col(f"{rater}_b")).where("x is not null and y is not null")
    share = lambda c: F.avg(c.cast("double"))
    s = both.groupBy(f"{rater}_a", f"{rater}_b").agg(F.count("*").alias("n"), share(F.col("x") == F.col("y")).alias("po"), share(F.col("x")).alias("px"), share(F.col("y")).alias("py"))
    pe = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    k, half = F.try_divide(F.col("po") - pe, 1 - pe), 1.96 * F.sqrt(F.try_divide(F.col("po") * (1 - F.col("po")), F.col("n") * (1 - pe) * (1 - pe)))
    return s.select(f"{rater}_a", f"{rater}_b", "n", k.alias("kappa"), (k - half).alias("low"), (k + half).alias("high"))


def majority(entries: DataFrame, truth: str, split: str = "train") -> DataFrame:
    """The class that most of the split's rows have, 1 on a tie; one row."""
    return entries.where(F.col("split") == split).agg((F.avg(truth) >= 0.5).cast("long").alias("majority"))


def baselines(entries: DataFrame, truth: str, key: str, text_score: Column | None = None, rule: Column | None = None) -> DataFrame:
    """entries with reference predictions that need no model: `majority` of train, `random` by a digest of the key,
    `heuristic` by a rule over visible columns, and `text_only`, the text score's best threshold of train.

    None of them reads a label of the split it is scored on.
    """
    out = entries.crossJoin(F.broadcast(majority(entries, truth))).withColumn("random", (hash_uniform(F.lit("random"), F.col(key)) < 0.5).cast("long"))
    if rule is not None:
        out = out.withColumn("heuristic", F.coalesce(rule.cast("long"), F.lit(0)))
    if text_score is not None:
        train = entries.where("split = 'train'").select(text_score.alias("__score"), truth)
        point = operating_point(train, "__score", truth).agg(F.max("threshold").alias("__point"))
        out = out.crossJoin(F.broadcast(point)).withColumn("text_only", F.coalesce((text_score >= F.col("__point")).cast("long"), F.lit(0))).drop("__point")
    return out


def floor_gaps(entries: DataFrame, truth: str, pred: str, floor: str) -> DataFrame:
    """For each split, how far the predictions' macro-F1 lies above the floor's and below the perfect one."""
    own, low = macro_f1(F.col(truth), F.col(pred)), macro_f1(F.col(truth), F.col(floor))
    return entries.groupBy("split").agg((own - low).alias("floor_gap"), (1 - own).alias("oracle_gap"))


def transfer_gaps(entries: DataFrame, truth: str, pred: str, home: str = "iid-test", away: str = "ood-") -> DataFrame:
    """How much macro-F1 each split from elsewhere loses against the home split."""
    metric = entries.groupBy("split").agg(macro_f1(F.col(truth), F.col(pred)).alias("f"))
    base = metric.where(F.col("split") == home).select(F.col("f").alias("home"))
    return metric.where(F.col("split").startswith(away)).crossJoin(F.broadcast(base)).select("split", (F.col("home") - F.col("f")).alias("transfer_gap"))


def reason_f1(entries: DataFrame, reason: str, pred: str, first: str = "D1") -> DataFrame:
    """Macro-F1 of the predicted reason (1: the first) over unfaithful entries, with their number."""
    u = entries.where("label = 'unfaithful'").select((F.col(reason) == first).cast("long").alias("t"), F.col(pred).alias("p"))
    return u.agg(macro_f1(F.col("t"), F.col("p")).alias("reason_f1"), F.count("*").alias("n"))


def rule_flips(on: DataFrame, off: DataFrame, key: str, column: str) -> DataFrame:
    """How many verdicts change when a rule is taken away, of how many, with the lower bound of their share."""
    both = on.select(key, F.col(column).alias("a")).join(off.select(key, F.col(column).alias("b")), key)
    sums = both.agg(F.count_if(F.col("a") != F.col("b")).alias("flips"), F.count("*").alias("n"))
    return sums.withColumn("low", wilson(F.col("flips"), F.col("n"))["low"])


def auroc_interval(df: DataFrame, score: str, truth: str, by: list[str] | None = None, z: float = 1.96) -> DataFrame:
    """auroc with its large-sample interval after Hanley and McNeil, within 0 and 1."""
    a, p, n = F.col("auroc"), F.col("n_pos"), F.col("n_neg")
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    spread = z * F.sqrt(F.try_divide(F.greatest(F.lit(0.0), a * (1 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)), p.cast("double") * n))
    out = auroc(df, score, truth, by)
    return out.withColumn("low", F.greatest(F.lit(0.0), a - spread)).withColumn("high", F.least(F.lit(1.0), a + spread))


def closed_form_gate(df: DataFrame, score: str, truth: str, least: float = 0.71) -> DataFrame:
    """auroc_interval, and viable: false only if the interval's lower bound is below the least effect. No answer without both classes."""
    return auroc_interval(df, score, truth).withColumn("viable", F.col("low") >= least)


#: Replicates that a task of resampled_auroc draws, and numbers that it draws at once.
TOGETHER, AT_ONCE = 500, 1 << 20


def resampled_auroc(df: DataFrame, score: str, truth: str, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """The registered interval of AUROC: rows resampled with replacement within each class; auroc, low, high, n_pos, n_neg, replicates.

    Rows are counted once, by distinct score. A replicate is a multinomial of these counts for each class, drawn for ranges
    of scores first and then within each range, so that ranges are tasks of their own: a range's wins are those among its
    own scores and those of its positives over all negatives of earlier ranges. Draws depend on the seed, the
    replicates and the ranges only, not on tasks that run twice. Rows without a score or with another truth than 0
    or 1 are left out; one class alone has neither value nor interval.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    held = Ranged(counts.where("pos + neg > 0"), [], [F.col("s")])
    # A row for each range, of which there are as many as shuffle partitions.
    parts = held.rows.groupBy("__part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).orderBy("__part").collect()
    place = {r["__part"]: i for i, r in enumerate(parts)}
    pos, neg = (np.array([r[c] for r in parts], np.int64) for c in ("pos", "neg"))
    n_pos, n_neg = int(pos.sum()), int(neg.sum())
    spark = df.sparkSession
    schema = "auroc double, low double, high double, n_pos long, n_neg long, replicates long"
    if not n_pos or not n_neg:
        return spark.createDataFrame([(None, None, None, n_pos, n_neg, 0)], schema)

    def wins(key: tuple, part: pa.Table) -> pa.Table:
        number, chunk = (k.as_py() for k in key)
        i = place[number]
        order = np.argsort(part["s"].to_numpy(), kind="stable")
        own = [part[c].to_numpy()[order] for c in ("pos", "neg")]
        first, last = (replicates * c // -(-replicates // TOGETHER) for c in (chunk, chunk + 1))
        # The same for every range of a replicate: how many of each class fall into which range.
        dealt = np.random.default_rng([seed, 1, chunk])
        of_pos, of_neg = dealt.multinomial(n_pos, pos / n_pos, last - first), dealt.multinomial(n_neg, neg / n_neg, last - first)
        rng, out = np.random.default_rng([seed, 2, chunk, i]), []
        step = max(1, AT_ONCE // len(order))
        for a in range(0, last - first, step):
            b = min(a + step, last - first)
            p, n = (rng.multinomial(m[a:b, i], c / max(1, c.sum())) if c.sum() else np.zeros((b - a, len(c)), np.int64) for m, c in zip((of_pos, of_neg), own, strict=True))
            below = np.cumsum(n, axis=1) - n / 2
            out.append((p * below).sum(axis=1) + p.sum(axis=1) * of_neg[a:b, :i].sum(axis=1))
        return pa.table({"replicate": pa.array(np.arange(first, last), pa.int64()), "wins": pa.array(np.concatenate(out).astype(float))})

    chunks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // TOGETHER) - 1)))
    drawn = held.rows.select("__part", "s", "pos", "neg", chunks.alias("__chunk")).groupBy("__part", "__chunk").applyInArrow(wins, "replicate long, wins double")
    each = drawn.groupBy("replicate").agg((F.sum("wins") / (float(n_pos) * n_neg)).alias("v"))
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    interval = each.agg(F.get(q, F.lit(0)).alias("low"), F.get(q, F.lit(1)).alias("high"), F.count("*").alias("replicates"))
    return auroc(df, score, truth).crossJoin(F.broadcast(interval)).select("auroc", "low", "high", "n_pos", "n_neg", "replicates")


def effect_gate(df: DataFrame, score: str, truth: str, least: float = 0.71, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """The registered gate: resampled_auroc, and viable, false only if the lower bound is below the least effect; null without both classes."""
    return resampled_auroc(df, score, truth, replicates, seed).withColumn("viable", F.col("low") >= least)


#: Random blocks that a stratum's rows are dealt to for `bootstrap`.
BLOCKS = 200


def bootstrap(df: DataFrame, key: str, value: str, strata: list[str], replicates: int = 10_000, blocks: int = BLOCKS) -> DataFrame:
    """95 % interval of the mean by a stratified bootstrap over random blocks, for values of any kind and rows of any number.

    Rows are dealt to blocks of their stratum by a digest of the key and summed once. A replicate weighs a block by the
    Poisson(1) quantile of a digest, so the result depends on no partitioning, and the work on the number of rows only once.
    """
    dealt = df.select(*strata, F.floor(hash_uniform(F.lit("block"), F.col(key)) * blocks).cast("long").alias("__block"), F.col(value).cast("double").alias("__v"))
    sums = dealt.groupBy(*strata, "__block").agg(F.count("__v").alias("__n"), F.sum("__v").alias("__s"))
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)
    # Four replicates share a digest, 15 bits each, and a row.
    groups = F.sequence(F.lit(0).cast("long"), F.lit(-(-replicates // 4) - 1).cast("long"))
    drawn = sums.repartition(F.col("__block")).withColumn("__four", F.explode(groups))
    digest = F.md5(F.concat_ws("|", F.col("__four").cast("string"), *(F.col(c).cast("string") for c in strata), F.col("__block").cast("string")))
    drawn = drawn.withColumn("__bits", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    u = [F.shiftright("__bits", 15 * j).bitwiseAND(F.lit(32767)) / 32768.0 for j in range(4)]
    drawn = drawn.withColumns({f"__w{j}": sum((F.when(u[j] >= s, 1).otherwise(0) for s in steps), F.lit(0)) for j in range(4)})
    totals = [a for j in range(4) for a in (F.sum(F.col(f"__w{j}") * F.col("__n")).alias(f"__n{j}"), F.sum(F.col(f"__w{j}") * F.col("__s")).alias(f"__s{j}"))]
    fours = drawn.groupBy("__four", *strata).agg(*totals, F.sum("__n").alias("__n"))
    each = F.array(*(F.struct((F.col("__four") * 4 + j).alias("replicate"), F.col(f"__n{j}").alias("w"), F.col(f"__s{j}").alias("ws")) for j in range(4)))
    by = fours.select(F.col("__n").alias("n"), F.explode(each).alias("x")).select("n", "x.*").where((F.col("replicate") < replicates) & (F.col("w") > 0))
    # Strata keep their own sizes: a stratum's resampled mean counts by its number of rows.
    means = by.groupBy("replicate").agg((F.sum(F.col("n") * F.col("ws") / F.col("w")) / F.sum("n")).alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.get(q, F.lit(0)).alias("low"), F.get(q, F.lit(1)).alias("high"), F.count("*").alias("replicates"))


#: Cells of all strata together that resample() takes; a confusion matrix has four for each stratum.
MOST_CELLS = 100_000


def resample(df: DataFrame, strata: list[str], cells: list[str], metric: Callable[[np.ndarray], np.ndarray], replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """The registered bootstrap, exactly: low, high, value and replicates of a metric of label columns, rows drawn with replacement within strata.

    Rows with equal labels are alike, so a replicate draws a multinomial of their counts; rows are counted once, by
    (strata, cells), and replicates are spread over tasks. metric: from counts (replicates, cells) to values, cells in
    the order of their sorted distinct labels over all strata, as `resample_cells` gives them. A paired comparison is a
    metric over both predictors' columns: the difference of theirs. More than MOST_CELLS counts are refused; see bootstrap.
    """
    counts = df.groupBy(*strata, *cells).agg(F.count("*").alias("__n"))
    held = counts.select(F.to_json(F.struct(*strata, F.lit(0).alias("__all"))).alias("__stratum"), *cells, "__n").limit(MOST_CELLS + 1).toPandas()
    if len(held) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} counts of strata and labels")
    labels = sorted({tuple(r) for r in held[cells].itertuples(index=False)}, key=str)
    place = {x: i for i, x in enumerate(labels)}
    table = np.zeros((held["__stratum"].nunique(), len(labels)), np.int64)
    rows = {x: i for i, x in enumerate(sorted(held["__stratum"].unique()))}
    for stratum, n, *label in zip(held["__stratum"], held["__n"], *(held[c] for c in cells), strict=True):
        table[rows[stratum], place[tuple(label)]] = n
    value = float(metric(table.sum(axis=0)[None, :])[0]) if len(labels) else None
    if not len(labels):
        return df.sparkSession.createDataFrame([(None, None, None, 0)], "value double, low double, high double, replicates long")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, r])
                out.append(sum(rng.multinomial(row.sum(), row / row.sum()) for row in table))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(metric(np.array(out)), float) if out else np.empty(0))], ["value"])

    drawn = df.sparkSession.range(replicates).mapInArrow(run, "value double")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return drawn.agg(F.lit(value).alias("value"), F.get(q, F.lit(0)).alias("low"), F.get(q, F.lit(1)).alias("high"), F.count("*").alias("replicates"))


def resample_cells(labels: list[tuple]) -> list[tuple]:
    """The order in which a metric of resample() finds its counts."""
    return sorted(set(labels), key=str)


def _stepped(df: DataFrame, p: str, family: list[str], key: str, step: Callable[[Column, Column, Column], Column], fold: str) -> DataFrame:
    """df with `adjusted`: step(p, rank, number) over a family's non-null p in order, folded up to each (max) or from each on (min).

    A family may be all rows: ranks, numbers and folds are carried over ranges of the order. A null p is no test: it
    counts in no family and its adjusted value is null.
    """
    held = Ranged(df, family, [F.col(p), F.col(key)])
    tested = held.carried(held.rows.where(F.col(p).isNotNull()), {"__rank": ("sum", F.lit(1))})
    tested = held.of_groups(tested, {"__tests": F.lit(1)})
    tested = tested.withColumn("__step", F.least(F.lit(1.0), step(F.col(p), F.col("__rank"), F.col("__tests"))))
    adjusted = held.carried(tested, {"adjusted": (fold, F.col("__step"))}, later=fold == "min")
    rest = held.rows.where(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double"))
    return adjusted.select(*df.columns, "adjusted").unionAll(rest.select(*df.columns, "adjusted"))


def holm(df: DataFrame, p: str, family: list[str], key: str) -> DataFrame:
    """Step-down adjusted p-values within families; `key` orders equal ones."""
    return _stepped(df, p, family, key, lambda x, i, m: x * (m - i + 1), "max")


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], key: str) -> DataFrame:
    """Step-up adjusted p-values within families, as in holm."""
    return _stepped(df, p, family, key, lambda x, i, m: x * m / i, "min")


def coverage(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """One row: missing, unknown and repeated predictions, and whether the run conforms."""
    n = predictions.groupBy(key).agg(F.count("*").alias("n"))
    both = truth.select(key, F.lit(1).alias("t")).join(n, key, "full_outer")
    found = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("t").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))
    return found.withColumn("conformant", (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0))


def conformance(predictions: DataFrame, truth: DataFrame, declared: DataFrame, visible: tuple[str, ...], version: str) -> DataFrame:
    """For each run of `declared`, whether it holds K-1 to K-5, whether it conforms, and the rules it breaks. What breaks one is reported, not scored.

    predictions: (run, instance, pos); truth: (instance, pos), the scored instances in their order. declared, one row a run:
    columns and fit_splits it read, queried_generator, access (its declaration, null if there is none), corpus_version,
    and overrides, the benchmark semantics it derived anew. K-1: exactly the scored instances, in order. K-2: only
    visible columns, fitted on train only, no query of the generator. K-3: access declared. K-4: keyed to this corpus
    version. K-5: no overrides.
    """
    n = truth.agg(F.count("*").alias("n"))
    seen = predictions.join(truth.select("instance", F.col("pos").alias("own")), "instance", "left").groupBy("run").agg(
        F.count("*").alias("given"), F.countDistinct("instance").alias("distinct"), F.count_if(F.col("own").isNull()).alias("unknown"), F.count_if(F.col("own") != F.col("pos")).alias("moved"),
    )
    within = lambda c, allowed: F.coalesce(F.size(F.array_except(c, F.array(*map(F.lit, allowed)))) == 0, F.lit(False))
    both = declared.join(seen, "run", "left").crossJoin(F.broadcast(n))
    rules = {
        "k1": F.coalesce((F.col("given") == F.col("n")) & (F.col("distinct") == F.col("n")) & (F.col("unknown") == 0) & (F.col("moved") == 0), F.lit(False)),
        "k2": within("columns", visible) & within("fit_splits", ("train",)) & ~F.coalesce("queried_generator", F.lit(True)),
        "k3": F.col("access").isNotNull(),
        "k4": F.col("corpus_version").eqNullSafe(F.lit(version)),
        "k5": F.coalesce(F.size("overrides") == 0, F.lit(False)),
    }
    judged = both.select("run", *(c.alias(k) for k, c in rules.items()))
    broken = F.filter(F.array(*(F.when(~F.col(k), F.lit(k.upper().replace("K", "K-"))) for k in rules)), lambda x: x.isNotNull())
    return judged.withColumn("broken", F.array_join(broken, ",")).withColumn("conformant", F.col("broken") == "")


def scorecard(df: DataFrame, truth: str, pred: str, sets: list[list[str]], least: int) -> DataFrame:
    """Metric table over grouping sets, each cell with n and whether it may be headlined."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    t, p = F.col(truth), F.col(pred)
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.count("*").alias("n"), F.avg((t == p).cast("double")).alias("accuracy"), macro_f1(t, p).alias("macro_f1"),
    ).withColumn("headline_ok", F.col("n") >= least)


def metric_table(df: DataFrame, truth: str, pred: str, score: str, version: str, least: int, reason: str | None = None, z: float = 1.96) -> DataFrame:
    """The scorecard's entries: split, metric, value, low, high, n, corpus_version and headline_ok, for each split.

    Accuracy has the score interval, AUROC that of Hanley and McNeil, and macro-F1 the large-sample one of a function of
    the four counts; reason_f1, of unfaithful entries, likewise.
    """
    n = lambda t, p: F.count_if((F.col("t") == t) & (F.col("p") == p)).cast("double")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos, neg = 2 * tp + fp + fn, 2 * tn + fp + fn
    sq = lambda x: x * x
    # How the mean of the two F1 moves with each count's share, times the number of rows.
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    g_tp, g_tn = zero(F.try_divide(fp + fn, sq(pos))), zero(F.try_divide(fp + fn, sq(neg)))
    g_off = -zero(F.try_divide(tp, sq(pos))) - zero(F.try_divide(tn, sq(neg)))
    total = tp + fp + fn + tn
    mean = (tp * g_tp + tn * g_tn + (fp + fn) * g_off) / total
    spread = z * F.sqrt(F.greatest(F.lit(0.0), (tp * sq(g_tp) + tn * sq(g_tn) + (fp + fn) * sq(g_off)) - total * sq(mean)))

    def f_rows(rows: DataFrame, name: str) -> DataFrame:
        cells = rows.groupBy("split").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"), F.count("*").alias("n"))
        value = (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2
        return cells.select("split", F.lit(name).alias("metric"), value.alias("value"), F.greatest(F.lit(0.0), value - spread).alias("low"), F.least(F.lit(1.0), value + spread).alias("high"), "n")

    both = df.select("split", F.col(truth).alias("t"), F.col(pred).alias("p"))
    hits = both.groupBy("split").agg(F.count_if(F.col("t") == F.col("p")).alias("hits"), F.count("*").alias("n"))
    ci = wilson(F.col("hits"), F.col("n"), z)
    accuracy = hits.select("split", F.lit("accuracy").alias("metric"), (F.col("hits") / F.col("n")).alias("value"), ci["low"].alias("low"), ci["high"].alias("high"), "n")
    ranked = auroc_interval(df, score, truth, ["split"], z).select("split", F.lit("auroc").alias("metric"), F.col("auroc").alias("value"), "low", "high", (F.col("n_pos") + F.col("n_neg")).alias("n"))
    out = accuracy.unionAll(f_rows(both, "macro_f1")).unionAll(ranked)
    if reason:
        out = out.unionAll(f_rows(df.where("label = 'unfaithful'").select("split", (F.col(reason) == "D1").cast("long").alias("t"), F.col(pred).alias("p")), "reason_f1"))
    return out.withColumn("corpus_version", F.lit(version)).withColumn("headline_ok", F.col("n") >= least)
