"""Run analytics.

A *run* is one (condition, data budget, seed) evaluation.  The studied project obtains
runs from training logs; here the same record can also be derived from the corpus
(``corpus_runs``): a character-unigram model fitted on a seed-ordered prefix of the
train split holding the budget of base letters, scored on the val split.

Scale notes
-----------
* The seed order is a hash of (seed, doc_id); the running letter sum per (condition,
  seed) is two-phase (hash-range buckets, offsets, bounded windows).
* Each document is counted once per seed (fan-out = number of seeds, a parameter) by
  the per-task character combiner; budgets are nested prefixes, so counts per budget
  are cumulative sums over at most ``len(budgets)`` rows per (condition, seed, char).
* Summaries are group-level tables (conditions x budgets x seeds), never row-level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import ambiguity as A
from .prefix import running_before

# ---------------------------------------------------------------------------
# FIXED VALUES — defaults of the studied scaling experiment.
#   fertilities (tokens/word): d1 2.5189, d3 2.1934; eval words 2,990,668;
#   tokens per optimizer step 32,768; seeds 42, 137, 2024;
#   budgets (base letters): 5M 15M 30M 50M 100M 200M 500M
# ---------------------------------------------------------------------------
FERTILITIES = {"d1": 2.5189, "d3": 2.1934}
EVAL_WORDS = 2_990_668
TOKENS_PER_STEP = 32_768
SEEDS = (42, 137, 2024)
BUDGETS = (5_000_000, 15_000_000, 30_000_000, 50_000_000, 100_000_000, 200_000_000, 500_000_000)

RUN_COLUMNS = ["condition", "target_base_letters", "actual_base_letters", "max_steps", "num_steps",
               "seed", "val_bpb", "total_eval_nats", "total_eval_bytes", "total_valid_tokens",
               "eval_base_letters", "bpbl"]
LN2 = math.log(2)


# ---------------------------------------------------------------------------
# T18-T21
# ---------------------------------------------------------------------------
def bl_per_word(base_letters: Column, eval_words=EVAL_WORDS) -> Column:
    """Base letters per evaluation word."""
    return base_letters / F.lit(eval_words) if not isinstance(eval_words, Column) else base_letters / eval_words


def bl_per_token(blpw: Column, fertility: Column) -> Column:
    """Base letters per token = letters per word / tokens per word."""
    return blpw / fertility


def calibrate_steps(budget: Column, blpt: Column, tokens_per_step: int = TOKENS_PER_STEP) -> Column:
    """``int(budget / (tokens_per_step x bl_per_token))``."""
    return F.floor(budget / (F.lit(tokens_per_step) * blpt)).cast("bigint")


def bpbl(nats: Column, valid_tokens: Column, blpt: Column) -> Column:
    """Nats / (valid tokens x base letters per token x ln 2)."""
    return nats / (valid_tokens * blpt * F.lit(LN2))


def actual_base_letters(num_steps: Column, blpt: Column, tokens_per_step: int = TOKENS_PER_STEP) -> Column:
    """Steps x tokens per step x base letters per token."""
    return num_steps * F.lit(tokens_per_step) * blpt


def calibration_grid(spark, base_letters: int | Column, budgets=BUDGETS, fertilities=FERTILITIES,
                     eval_words=EVAL_WORDS, tokens_per_step: int = TOKENS_PER_STEP) -> DataFrame:
    """T18 + T19: ``(condition, budget, bl_per_word, bl_per_token, max_steps)``."""
    conds = spark.createDataFrame(list(fertilities.items()), "condition string, fertility double")
    grid = conds.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("bigint") for b in budgets])))
    letters = base_letters if isinstance(base_letters, Column) else F.lit(base_letters)
    blpw = bl_per_word(letters.cast("double"), eval_words)
    return grid.select("condition", "budget", blpw.alias("bl_per_word"),
                       bl_per_token(blpw, F.col("fertility")).alias("bl_per_token")).withColumn(
        "max_steps", calibrate_steps(F.col("budget"), F.col("bl_per_token"), tokens_per_step))


def measured_calibration(val: DataFrame, budgets=BUDGETS, tokens_per_step: int = TOKENS_PER_STEP) -> DataFrame:
    """T18 + T19 from measured figures ``val (condition, tokens, words, letters)``, one row per condition:
    letters per word of d1 and each condition's own tokens per word."""
    blpw = val.where("condition = 'd1'").select(F.col("letters").cast("double") / F.col("words")).scalar()
    grid = val.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("bigint") for b in budgets])))
    return grid.select("condition", "budget", blpw.alias("bl_per_word"),
                       bl_per_token(blpw, F.col("tokens").cast("double") / F.col("words")).alias("bl_per_token")).withColumn(
        "max_steps", calibrate_steps(F.col("budget"), F.col("bl_per_token"), tokens_per_step))


# ---------------------------------------------------------------------------
# P6-P8, P11
# ---------------------------------------------------------------------------
def complete_runs(runs: DataFrame, need_steps: bool = True) -> DataFrame:
    """Runs that report every metric the BPBL needs."""
    cols = ["val_bpb", "total_eval_nats", "total_valid_tokens"] + (["num_steps"] if need_steps else [])
    return runs.dropna(subset=cols)


def kept_runs(log: DataFrame) -> DataFrame:
    """``status = 'keep' AND val_bpb > 0``."""
    return log.where((F.col("status") == "keep") & (F.col("val_bpb").cast("double") > 0))


def plausible_loss(val_bpb: Column) -> Column:
    """1 < val_bpb < 10."""
    return (val_bpb > 1) & (val_bpb < 10)


def winner(d1: Column, d3: Column) -> Column:
    """D1 if strictly lower, else D3; N/A if either side is missing."""
    return F.when(d1.isNull() | d3.isNull(), "N/A").when(d1 < d3, "D1").otherwise("D3")


# ---------------------------------------------------------------------------
# A13 / J6 / K8
# ---------------------------------------------------------------------------
def _grid(runs: DataFrame, conditions, budgets) -> DataFrame:
    """(condition, target_base_letters) cells; without ``budgets``, those that occur in ``runs``."""
    if budgets is None:
        return (runs.select(F.col("target_base_letters").cast("bigint").alias("target_base_letters")).distinct()
                .select(F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition"), "target_base_letters"))
    return (runs.sparkSession.createDataFrame([(c,) for c in conditions], "condition string")
            .withColumn("target_base_letters", F.explode(F.array(*[F.lit(b).cast("bigint") for b in budgets]))))


def summary_by_budget(runs: DataFrame, conditions=("d1", "d3"), budgets=BUDGETS,
                      metric: str = "bpbl", digits: int = 6) -> DataFrame:
    """A13 + J6: mean, sample std (0 for n = 1) and n for every condition x budget.

    Every grid cell appears; an empty one has n = 0 and NULL statistics.  ``budgets=None`` takes
    the budgets of the runs.
    """
    grid = _grid(runs, conditions, budgets)
    stats = runs.groupBy("condition", "target_base_letters").agg(
        F.avg(metric).alias("m"), F.stddev_samp(metric).alias("s"), F.count(F.lit(1)).alias("n"),
        F.avg("actual_base_letters").alias("x"))
    j = grid.join(stats, ["condition", "target_base_letters"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return j.select(
        "condition", "target_base_letters", X.budget_label(F.col("target_base_letters")).alias("budget_label"),
        F.round("m", digits).alias(f"mean_{metric}"),
        F.round(F.when(n >= 1, F.coalesce(F.col("s"), F.lit(0.0))), digits).alias(f"std_{metric}"),
        n.alias("n"), F.round("x", 1).alias("mean_actual_base_letters"))


def scaling_points(summary: DataFrame, metric: str = "bpbl") -> DataFrame:
    """K8: chart rows (x = mean actual letters, y = mean metric, y -/+ std band)."""
    y, s = F.col(f"mean_{metric}"), F.col(f"std_{metric}")
    return (summary.where(y.isNotNull())
            .select("condition", "target_base_letters", F.col("mean_actual_base_letters").alias("x"),
                    y.alias("y"), (y - s).alias("y_lo"), (y + s).alias("y_hi")))


# ---------------------------------------------------------------------------
# A14 / A15 / A16 / A17
# ---------------------------------------------------------------------------
def robust_stats(runs: DataFrame, keys=("condition",), metric: str = "bpbl", digits: int = 6) -> DataFrame:
    """Mean, sample std, median (midpoint for even n) and the seed of the maximum."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.avg(metric), digits).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(metric), F.lit(0.0)), digits).alias("std"),
        F.round(F.median(metric), digits).alias("median"),
        F.max_by("seed", F.struct(F.col(metric), F.col("seed"))).alias("worst_seed"),
        F.min_by("seed", F.struct(F.col(metric), F.col("seed"))).alias("best_seed"))


def best_seed(runs: DataFrame, keys=("condition",), metric: str = "val_bpb",
              order_col: str | None = None) -> DataFrame:
    """Seed with the lowest metric per key; first in ``order_col`` (else seed) on ties."""
    tie = F.col(order_col) if order_col else F.col("seed")
    return runs.groupBy(*keys).agg(F.min_by("seed", F.struct(F.col(metric), tie)).alias("best_seed"))


def best_kept(log: DataFrame, order_col: str = "line_no", strict: bool = False) -> DataFrame:
    """The kept row with the lowest val_bpb (first on ties), with ``rank`` 1; if none is kept,
    no row, or an error when ``strict``."""
    k = kept_runs(log)
    order = F.struct(F.col("val_bpb").cast("double").alias("v"), F.col(order_col).alias("o"))
    best = k.agg(F.min_by(F.struct(*log.columns), order).alias("r"))
    if strict:
        best = best.select(F.coalesce("r", F.raise_error(F.lit("no kept run in the search log")).cast(best.schema["r"].dataType)).alias("r"))
    return best.where(F.col("r").isNotNull()).select("r.*", F.lit(1).alias("rank"))


def search_counts(log: DataFrame) -> DataFrame:
    """Total, kept and crashed experiments."""
    return log.agg(F.count(F.lit(1)).cast("bigint").alias("total_experiments"),
                   F.count_if(F.col("status") == "keep").cast("bigint").alias("keep_count"),
                   F.count_if(F.col("status") == "crash").cast("bigint").alias("crash_count"))


# ---------------------------------------------------------------------------
# J7 / J8 / U1 / U2
# ---------------------------------------------------------------------------
def pending_runs(runs: DataFrame, conditions=("d1", "d3"), budgets=BUDGETS, seeds=SEEDS) -> DataFrame:
    """(condition, budget, seed) grid minus completed runs (left anti join).  A run whose
    corpus ran out before its budget is not complete.  ``budgets=None`` takes those of the runs."""
    grid = _grid(runs, conditions, budgets).withColumn("seed", F.explode(F.array(*[F.lit(s).cast("int") for s in seeds])))
    done = runs.where(F.col("actual_base_letters") >= F.col("target_base_letters")).select("condition", F.col("target_base_letters").cast("bigint").alias("target_base_letters"),
                       F.col("seed").cast("int").alias("seed"))
    return grid.join(done, ["condition", "target_base_letters", "seed"], "left_anti")


def gap_table(summary: DataFrame, metric: str = "bpbl", base: str = "d1", other: str = "d3",
              arch: str | None = None, digits: int = 6) -> DataFrame:
    """J8 + P11: conditions side by side per budget; encoding gap = other - base
    (and percentage of base); optional architecture gap = arch - other."""
    conds = [base, other] + ([arch] if arch else [])
    m = f"mean_{metric}"
    piv = summary.groupBy("target_base_letters").pivot("condition", conds).agg(F.first(m))
    b, o = F.col(base), F.col(other)
    cols = [X.budget_label(F.col("target_base_letters")).alias("budget_label"), "target_base_letters",
            b.alias(f"{base}_{metric}"), o.alias(f"{other}_{metric}"),
            F.round(o - b, digits).alias("encoding_gap"),
            F.round(F.lit(100.0) * (o - b) / b, 2).alias("encoding_gap_pct"),
            winner(b, o).alias("winner")]
    if arch:
        cols.append(F.round(F.col(arch) - o, digits).alias("arch_gap"))
    return piv.select(*cols)


def union_runs(*frames: DataFrame) -> DataFrame:
    """Union by column name, filling columns a side lacks with NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def relabel(runs: DataFrame, condition: str, source: str, architecture: str | None = None) -> DataFrame:
    """Rename the condition and tag the source (and architecture) of a run set."""
    out = runs.withColumn("condition", F.lit(condition)).withColumn("source", F.lit(source))
    return out.withColumn("architecture", F.lit(architecture)) if architecture else out


# ---------------------------------------------------------------------------
# Runs derived from the corpus
# ---------------------------------------------------------------------------
M32 = 4294967296


def seed_order_key(seed: Column, doc_id: Column) -> Column:
    """Deterministic per-seed shuffle key in [0, 2^32) (same arithmetic as A4's draws)."""
    return A._mix32((seed.cast("bigint") * 65537 + doc_id * 2) % M32)


def corpus_runs(shards: DataFrame, budgets=(20_000, 50_000, 100_000, 200_000, 500_000),
                seeds=SEEDS, conditions=("d1", "d3"), digits: int = 6, whole: bool = False) -> DataFrame:
    """Run records derived from the corpus (schema of the studied runs table).

    For each (condition, seed, budget): train docs in seed order until the running count
    of base letters reaches the budget (the crossing doc is kept); a character unigram
    (add-one over the train alphabet + 1) is scored on the condition's val split.
    ``num_steps`` is the number of training documents, ``max_steps`` the count that the
    budget would need at the mean letters per train document (T19 with a doc "step").
    ``whole`` adds a budget of all train letters of the first condition.

    Budgets of any size cost one pass over the texts: a budget is a cut in the seed order, each
    document falls between two cuts of every seed, and characters are counted once per range
    (condition x cuts of the seeds); the model of a budget is the sum of its ranges.
    """
    sh = shards.where(F.col("condition").isin(*conditions))
    # Keys only (no text): base letters per document come with the shard table.  Many
    # consumers read these keys, so lineage is cut here with a reliable checkpoint.
    keyed = sh.select("condition", "split", "doc_id", "letters").checkpoint(eager=True)
    train = keyed.where(F.col("split") == "train").select("condition", "doc_id", "letters")
    if whole:
        total = train.where(F.col("condition") == conditions[0]).agg(F.sum("letters")).first()[0]
        budgets = {*budgets, *([total] if total else [])}
    budgets = sorted(budgets)

    # Seed order and running letter sum per (condition, seed), on keys.
    seeded = train.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    seeded = seeded.withColumn("okey", seed_order_key(F.col("seed"), F.col("doc_id")))
    part = ("condition", "seed")
    run_sum = running_before(seeded, ("okey", "doc_id"), "letters", part).checkpoint()
    before = F.col("before")
    # kmin = number of budgets already reached before this doc; kept in budgets k >= kmin.
    kmin = sum((F.when(before >= b, 1).otherwise(0) for b in budgets), F.lit(0))
    prefix = (run_sum.withColumn("kmin", kmin.cast("int")).where(F.col("kmin") < len(budgets))
              .select("condition", "seed", "doc_id", "letters", "kmin"))

    # The last document of every budget: conditions x seeds rows reach the driver, and texts are
    # placed between the cuts where they are read, without a join.
    cuts = {(r["condition"], r["seed"]): r for r in run_sum.groupBy(*part).agg(
        *[F.max(F.when(before < b, F.struct("okey", "doc_id"))).alias(f"c{k}") for k, b in enumerate(budgets)]).collect()}

    def between(seed: int) -> Column:
        here = F.struct(seed_order_key(F.lit(seed), F.col("doc_id")).alias("okey"), F.col("doc_id").alias("doc_id"))
        out = F.lit(len(budgets))
        for c in conditions:
            row = cuts.get((c, seed))
            if row is not None:
                after = [here > F.struct(F.lit(cut["okey"]).cast("bigint").alias("okey"), F.lit(cut["doc_id"]).alias("doc_id"))
                         for k in range(len(budgets)) if (cut := row[f"c{k}"]) is not None]
                missing = len(budgets) - len(after)
                out = F.when(F.col("condition") == c, sum((F.when(a, 1).otherwise(0) for a in after), F.lit(missing))).otherwise(out)
        return out.cast("string")

    placed = sh.select("condition", "text", F.when(F.col("split") == "val", F.lit("val")).otherwise(
        F.concat_ws(",", *[between(s) for s in seeds])).alias("range"))
    # (ranges x alphabet) rows, read by the train and the eval branch: checkpointed so the
    # texts are counted once.
    ranged = A.char_counts(placed, "text", ("condition", "range")).checkpoint(eager=True)
    counted = (ranged.where("range <> 'val'")
               .select("condition", "ch", "n", F.posexplode(F.split("range", ",")).alias("at", "kmin"))
               .select("condition", F.get(F.array(*[F.lit(s) for s in seeds]), F.col("at")).alias("seed"),
                       F.col("kmin").cast("int").alias("kmin"), "ch", "n").where(F.col("kmin") < len(budgets)))

    bud = F.array(*[F.lit(i) for i in range(len(budgets))])
    fan = F.filter(bud, lambda k: k >= F.col("kmin"))
    dstats = (prefix.groupBy(*part, "kmin").agg(F.count(F.lit(1)).alias("d"), F.sum("letters").alias("l"))
              .withColumn("k", F.explode(fan)).groupBy(*part, "k")
              .agg(F.sum("d").cast("bigint").alias("num_steps"), F.sum("l").cast("bigint").alias("train_letters")))
    ccounts = (counted
               .withColumn("k", F.explode(fan)).groupBy(*part, "k", "ch").agg(F.sum("n").alias("c")))
    model = ccounts.groupBy(*part, "k").agg(F.sum("c").alias("N"), F.count(F.lit(1)).alias("V"))
    ev = ranged.where("range = 'val'").select("condition", "ch", F.col("n").alias("n_eval"))
    cells = model.join(ev, "condition")                       # (cond, seed, k) x eval alphabet
    scored = cells.join(ccounts, [*part, "k", "ch"], "left")
    loss = -F.log((F.coalesce(F.col("c"), F.lit(0)) + 1) / (F.col("N") + F.col("V") + 1))
    evals = scored.groupBy(*part, "k").agg(
        F.sum(F.col("n_eval") * loss).alias("nats"),
        F.sum("n_eval").cast("bigint").alias("total_valid_tokens"),
        F.sum(F.col("n_eval") * F.octet_length("ch")).cast("bigint").alias("total_eval_bytes"))
    # Val letters and mean train letters per document in one aggregation over the keys.
    is_tr = F.col("split") == "train"
    lets = keyed.groupBy("condition").agg(
        F.sum(F.when(~is_tr, F.col("letters"))).alias("val_letters"),
        (F.sum(F.when(is_tr, F.col("letters"))) / F.count_if(is_tr)).alias("letters_per_doc"))

    budget_of_k = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in budgets]), F.col("k") + 1)
    out = (evals.join(dstats, [*part, "k"]).join(lets, "condition")
           .withColumn("target_base_letters", budget_of_k))
    blpt = F.col("val_letters") / F.col("total_valid_tokens")
    return out.select(
        "condition", "target_base_letters",
        F.col("train_letters").cast("double").alias("actual_base_letters"),
        F.floor(F.col("target_base_letters") / F.col("letters_per_doc")).cast("bigint").alias("max_steps"),
        F.col("num_steps").cast("int").alias("num_steps"), F.col("seed").cast("int").alias("seed"),
        F.round(F.col("nats") / (F.lit(LN2) * F.col("total_eval_bytes")), digits).alias("val_bpb"),
        F.round("nats", 4).alias("total_eval_nats"), "total_eval_bytes", "total_valid_tokens",
        F.round(F.col("total_valid_tokens") * blpt, 1).alias("eval_base_letters"),
        F.round(bpbl(F.col("nats"), F.col("total_valid_tokens"), blpt), digits).alias("bpbl"))
