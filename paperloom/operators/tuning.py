"""Tuning the rerank rule on labelled rows, and measuring it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

STEPS, STEP = 101, 0.001
TEST_SHARE, LEAST_ROWS = 0.6, 20
#: Labels that a task may hold as one value.
MAX_LABELS = 10_000


def stratified_split(rows: DataFrame, id_col: str = "doc_id", label_col: str = "label", share: float = TEST_SHARE, salt: str = "42") -> DataFrame:
    """Adds part, 'test' or 'validation'.

    A label with several rows gives ``share`` of them (rounded half to even, at least one, not
    all) to the test part, in the order of a hash of the identifier; a single row is a test row.

    No task holds a label: counts by label and the hash's first four digits tell the digits at which
    a label is cut, and rows are ranked within (label, digits) only.
    """
    draw = F.coalesce(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":" + salt))), F.lit(""))
    drawn = rows.withColumns({"_draw": draw, "_digits": F.substring(draw, 1, 4)})
    of = Window.partitionBy(label_col)
    counts = drawn.groupBy(label_col, "_digits").agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n").over(of)
    tests = F.when(n > 1, F.greatest(F.lit(1), F.least(n - 1, F.rint(n * share)))).otherwise(n)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = counts.select(F.col(label_col).alias("_label"), F.col("_digits").alias("_at"), (tests - before).alias("_left"))
    place = F.row_number().over(Window.partitionBy(label_col, "_digits").orderBy("_draw", id_col))
    ranked = drawn.withColumn("_place", place).join(left, F.col(label_col).eqNullSafe(F.col("_label")) & (F.col("_digits") == F.col("_at")))
    return ranked.select(*rows.columns, F.when(F.col("_place") <= F.col("_left"), "test").otherwise("validation").alias("part"))


def label_list(labels: DataFrame, label_col: str = "label") -> Column:
    """The schema's labels as one array: a scalar subquery. More than MAX_LABELS raise an error."""
    held = F.array_sort(F.collect_set(label_col))
    return labels.agg(F.when(F.size(held) > MAX_LABELS, F.raise_error(F.lit(f"more than {MAX_LABELS} labels"))).otherwise(held).alias("l")).scalar()


def f1_by_label(rows: DataFrame, labels: DataFrame, keys: tuple[str, ...] = (), truth: str = "truth", predicted: str = "predicted", label_col: str = "label") -> DataFrame:
    """A10, C14: (keys, label, tp, fp, fn, f1) of every label, 0 where it never occurs.

    Each row counts once for its truth and once for its prediction, combined before the shuffle.
    """
    hit = (F.col(truth) == F.col(predicted)).cast("int")
    sides = rows.select(*keys, F.explode(F.array(F.struct(F.col(truth).alias("l"), hit.alias("tp"), F.lit(0).alias("fp"), (1 - hit).alias("fn")), F.struct(F.col(predicted).alias("l"), F.lit(0).alias("tp"), (1 - hit).alias("fp"), F.lit(0).alias("fn")))).alias("s"))
    counts = sides.groupBy(*keys, F.col("s.l").alias("_l")).agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "fp", "fn")])
    names = labels.select(F.col(label_col).alias("label"))
    wanted = counts.select(*keys).distinct().withColumn("label", F.explode(label_list(labels, label_col))) if keys else names
    joined = wanted.join(counts, [wanted["label"] == counts["_l"], *[wanted[k] == counts[k] for k in keys]], "left").select(*[wanted[k] for k in keys], "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return joined.withColumn("f1", F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def macro_f1(rows: DataFrame, labels: DataFrame, keys: tuple[str, ...] = (), **names) -> DataFrame:
    """C14: (keys, macro_f1) over all labels of the schema."""
    return f1_by_label(rows, labels, keys, **names).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def reranked(keyword1: Column, keyword2: Column) -> Column:
    """C6."""
    return F.when(keyword2 > keyword1, F.col("label2")).otherwise(F.col("label1"))


def threshold_scores(rows: DataFrame, labels: DataFrame, swap: str = "swapped", truth: str = "truth", label_col: str = "label") -> DataFrame:
    """(step, threshold, macro_f1) of 101 thresholds.

    ``rows`` has label1, score1, score2, the reranked label and the truth. A row's prediction
    changes once, at the first threshold that its gap does not exceed. So each row is counted at
    that step alone, per label and step, and running sums over the 101 steps do the rest: rows are
    not multiplied by the thresholds.
    """
    gap = F.col("score1") - F.col("score2")
    first = F.greatest(F.lit(0), F.ceil(F.round(gap / STEP, 9))).cast("int")
    step = F.when(first < STEPS, first)
    side = lambda name, at, sign: F.struct(F.col(name).alias("l"), at.alias("at"), (F.col(name) == F.col(truth)).cast("int").alias("right"), F.lit(sign).alias("sign"))
    # at step -1 the first label is predicted; from its step on the reranked one is
    moves = rows.select(F.explode(F.array(side("label1", F.lit(-1), 1), side("label1", step, -1), side(swap, step, 1))).alias("m")).filter("m.at is not null")
    change = moves.groupBy(F.col("m.l").alias("l"), F.col("m.at").alias("at")).agg(F.sum(F.col("m.right") * F.col("m.sign")).alias("tp"), F.sum(F.col("m.sign")).alias("n"))
    truths = rows.groupBy(F.col(truth).alias("l")).agg(F.count(F.lit(1)).alias("n_true"))
    grid = labels.select(F.col(label_col).alias("l"), F.explode(F.sequence(F.lit(-1), F.lit(STEPS - 1))).alias("at"))
    running = Window.partitionBy("l").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(change, ["l", "at"], "left").join(truths, "l", "left").select("l", "at", F.sum(F.coalesce("tp", F.lit(0))).over(running).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(running).alias("n"), F.coalesce("n_true", F.lit(0)).alias("n_true"))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (F.col("n") + F.col("n_true")))
    return filled.filter("at >= 0").groupBy(F.col("at").alias("step")).agg(F.avg(f1).alias("macro_f1")).withColumn("threshold", F.col("step") * STEP)


def best_threshold(scores: DataFrame) -> DataFrame:
    """The lowest of the best thresholds."""
    return scores.orderBy(F.desc(F.round("macro_f1", 12)), "step").limit(1)


def pair_impact(rows: DataFrame, threshold: float | Column, swap: str = "swapped", truth: str = "truth") -> DataFrame:
    """(label1, label2, impact) of pairs whose reranking, beyond the threshold, mends more rows than it breaks."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    before, after = F.col("label1") == F.col(truth), F.col(swap) == F.col(truth)
    move = F.when(~before & after, 1).when(before & ~after, -1).otherwise(0)
    return rows.filter(F.col("score1") - F.col("score2") > t).groupBy("label1", "label2").agg(F.sum(move).alias("impact")).filter("impact > 0")


@dataclass(frozen=True)
class TunedRule:
    """C17: what tuning found: ``measures`` (part, rows, baseline, tuned, threshold) and ``pairs`` (label1, label2, impact); both stored.

    With too few rows there is no threshold, and both tables are empty.
    """

    threshold: float | None
    measures: DataFrame
    pairs: DataFrame

    def status(self) -> DataFrame:
        """One row: tuned, method, threshold, split sizes and macro F1 by part, and the pairs in order."""
        of = lambda c, part: F.max(F.when(F.col("part") == part, F.col(c))).alias(f"{c}_{part}")
        measured = self.measures.agg(*[of(c, part) for c in ("rows", "baseline", "tuned") for part in ("validation", "test")])
        pairs = self.pairs.agg(F.array_sort(F.collect_list(F.struct("label1", "label2"))).alias("beneficial_pairs"))
        told = F.lit(self.threshold is not None).alias("tuned"), F.lit("validation_test_split").alias("method"), F.lit(self.threshold).cast("double").alias("threshold")
        return measured.select(*told, "*").withColumn("beneficial_pairs", pairs.scalar())


def tune(rows: DataFrame, labels: DataFrame, id_col: str, truth: str = "truth", swap: str = "swapped") -> TunedRule:
    """C17: the rule found on the validation part and macro F1 before and after it, by part; nothing below 20 rows.

    The split is stored once, so what the rows are made from is computed once; the driver takes the
    number of rows and the threshold.
    """
    needed = [F.col(c) for c in dict.fromkeys((id_col, "label1", "score1", "label2", "score2", swap, truth))]
    parts = cut(stratified_split(rows.select(*needed), id_col, truth))
    enough = parts.limit(LEAST_ROWS).count() >= LEAST_ROWS
    parts = parts if enough else parts.limit(0)
    checked = parts.filter("part = 'validation'")
    found = best_threshold(threshold_scores(checked, labels, swap, truth)).first() if enough else None
    threshold = found["threshold"] if found else None
    pairs = cut(pair_impact(checked, F.lit(threshold).cast("double"), swap, truth))
    told = parts.join(pairs.select("label1", "label2", F.lit(True).alias("listed")), ["label1", "label2"], "left")
    ruled = F.when((F.col("score1") - F.col("score2") <= F.lit(threshold).cast("double")) | F.coalesce("listed", F.lit(False)), F.col(swap)).otherwise(F.col("label1"))
    both = told.select("part", F.col(truth).alias("truth"), F.explode(F.array(F.struct(F.lit("baseline").alias("kind"), F.col("label1").alias("predicted")), F.struct(F.lit("tuned").alias("kind"), ruled.alias("predicted")))).alias("p")).select("part", "truth", "p.*")
    scores = macro_f1(both, labels, ("part", "kind")).groupBy("part").agg(*[F.max(F.when(F.col("kind") == k, F.col("macro_f1"))).alias(k) for k in ("baseline", "tuned")])
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    measures = cut(sizes.join(scores, "part").select("part", "rows", "baseline", "tuned", F.lit(threshold).cast("double").alias("threshold")))
    return TunedRule(threshold, measures, pairs)
