"""Classification, calibration, text and agreement metrics from counts. Undefined values are null, never 0; an empty evaluation is an empty or BLOCKED row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions import scalars as S
from curata.plans.storage import materialize

# Values that say that a rater could not tell, which are not compared.
NOT_DETERMINED = ("unknown", "not_available")


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """y_true, y_pred, n: the pairs that occur."""
    return df.groupBy(F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(cm: DataFrame, classes: Sequence[int]) -> DataFrame:
    """label, support, predicted, true_positives, precision, recall, f1, for every class, from a confusion table.

    Without predictions precision is 0 if the class has support, else null; recall is null without support.
    """
    spark = cm.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("label"))
    sides = cm.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")))).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    row = dim.join(sums, "label", "left").select("label", zero("s").alias("support"), zero("p").alias("predicted"), zero("t").alias("true_positives"))
    t, s, p = (F.col(c).cast("double") for c in ("true_positives", "support", "predicted"))
    precision = F.when(F.col("predicted") > 0, F.try_divide(t, p)).when(F.col("support") > 0, F.lit(0.0))
    row = row.withColumn("precision", precision).withColumn("recall", F.try_divide(t, s))
    f1 = F.when(F.col("recall").isNull() | F.col("precision").isNull(), None).when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return row.withColumn("f1", f1)


def macro(classes: DataFrame) -> DataFrame:
    """One row over per_class: accuracy, macro means over classes with support, weighted F1, classes without support."""
    ok = F.col("support") > 0
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    total = F.sum("support").cast("double")
    return classes.agg(
        F.sum("support").alias("n_samples"), F.try_divide(F.sum("true_positives").cast("double"), total).alias("accuracy"), mean("precision").alias("macro_precision"),
        mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"), F.try_divide(F.sum(F.when(ok, F.col("f1") * F.col("support"))), total).alias("weighted_f1"), F.count_if(~ok).alias("n_without_support"),
    )


def top_k_accuracy(df: DataFrame, true: str, prob: str, k: int, n_classes: int) -> DataFrame:
    """One row: n, hits, accuracy; the latter null unless 1 < k < n_classes."""
    hit = F.array_contains(S.top_k(F.col(prob), k), F.col(true))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return row.withColumn("accuracy", F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double")) if 1 < k < n_classes else F.lit(None).cast("double"))


def calibration(df: DataFrame, true: str, prob: str, n_bins: int = 10) -> DataFrame:
    """bin, low, high, n, accuracy, mean_confidence, gap for every bin; bin 0 is [0, e1], the others (low, high]."""
    conf, correct = F.array_max(F.col(prob)), (S.argmax(F.col(prob)) == F.col(true)).cast("int")
    edges = [i / n_bins for i in range(n_bins + 1)]
    where = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        where = F.when(F.col("conf") > e, F.lit(i)).otherwise(where)
    g = df.select(conf.alias("conf"), correct.alias("ok")).withColumn("bin", where).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accuracy"), F.avg("conf").alias("mean_confidence"))
    dim = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in zip(edges, edges[1:], strict=False)])).alias("bin", "e")).select("bin", "e.*")
    return dim.join(g, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "mean_confidence", F.abs(F.col("accuracy") - F.col("mean_confidence")).alias("gap"))


def calibration_summary(bins: DataFrame) -> DataFrame:
    """One row: n, ECE and MCE over the bins."""
    return bins.agg(F.sum("n").alias("n_samples"), F.try_divide(F.sum(F.col("gap") * F.col("n")), F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def brier(df: DataFrame, true: str, prob: str) -> DataFrame:
    p = F.transform(F.col(prob), lambda x, i: F.pow(x - F.when(i == F.col(true), 1.0).otherwise(0.0), F.lit(2.0)))
    return df.agg(F.avg(F.aggregate(p, F.lit(0.0), lambda a, x: a + x)).alias("brier"))


def negative_log_likelihood(df: DataFrame, true: str, prob: str, temperature: float = 1.0) -> DataFrame:
    p = F.element_at(S.softmax(F.col(prob), temperature), F.col(true).cast("int") + 1)
    return df.agg((-F.avg(F.ln(F.greatest(p, F.lit(1e-12))))).alias("nll"))


def fit_temperature(df: DataFrame, true: str, prob: str, low: float = 0.05, high: float = 10.0, steps: int = 24) -> float:
    """The temperature of least negative log-likelihood. The range narrows to the neighbours of the best of five evenly spaced values, to a ten-thousandth at last; each step is one aggregate over the
    two columns, which are written once. (The likelihood has one minimum in the temperature.)"""
    df = materialize(df.select(F.col(true).alias("y"), F.col(prob).alias("p")).where("p IS NOT NULL"), "logits")
    for _ in range(steps):
        grid = [low + (high - low) * i / 4 for i in range(5)]
        row = df.agg(*[(-F.avg(F.ln(F.greatest(F.element_at(S.softmax(F.col("p"), t), F.col("y").cast("int") + 1), F.lit(1e-12))))).alias(f"t{i}") for i, t in enumerate(grid)]).first()
        best = min(range(5), key=lambda i: row[i])
        low, high = grid[max(0, best - 1)], grid[min(4, best + 1)]
        if high - low < 1e-4:
            break
    return (low + high) / 2


def confidence_bins(df: DataFrame, true: str, prob: str, edges: Sequence[float] = (0.0, 0.4, 0.6, 0.8, 1.0001)) -> DataFrame:
    """bin, n, n_correct, accuracy for [low, high) bins of confidence, empty ones included."""
    conf = F.array_max(F.col(prob))
    g = df.select(conf.alias("conf"), (S.argmax(F.col(prob)) == F.col(true)).alias("ok"))
    where = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        where = F.when((F.col("conf") >= a) & (F.col("conf") < b), i).otherwise(where)
    g = g.withColumn("bin", where).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_correct"))
    dim = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    out = dim.join(g, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_correct", F.lit(0)).alias("n_correct"))
    return out.withColumn("accuracy", F.try_divide(F.col("n_correct").cast("double"), F.col("n").cast("double")))


def errors(df: DataFrame, item: str, true: str, prob: str) -> DataFrame:
    """item, y_true, y_pred, confidence of every wrong prediction."""
    p = S.argmax(F.col(prob))
    return df.select(F.col(item).alias("item"), F.col(true).alias("y_true"), p.alias("y_pred"), F.array_max(F.col(prob)).alias("confidence")).where("y_pred <> y_true")


def group_mean(df: DataFrame, group: str, true: str, prob: str) -> DataFrame:
    """group, position, mean probability, n, consistent (one label): in long form, so that a group of any number of rows is pre-aggregated."""
    x = df.select(F.col(group).alias("grp"), F.col(true).alias("y"), F.posexplode(F.col(prob)).alias("pos", "p"))
    return x.groupBy("grp", "pos").agg(F.avg("p").alias("mean_prob"), F.count(F.lit(1)).alias("n"), (F.min("y") == F.max("y")).alias("consistent"))


def kappa(df: DataFrame, a: str, b: str, least: int = 30) -> DataFrame:
    """One row: n compared, n agreeing, excluded, raw agreement, Cohen's kappa (null without items or with chance agreement 1) and status."""
    known = ~F.col("a").isin(*NOT_DETERMINED) & ~F.col("b").isin(*NOT_DETERMINED)
    pairs = df.select(F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias("a"), F.coalesce(F.col(b).cast("string"), F.lit("unknown")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    kept = pairs.where(known)
    sides = kept.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("c").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col("b").alias("v"), F.lit(0).cast("long").alias("x"), F.col("c").alias("y")))).alias("s")).select("s.*")
    chance = sides.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("pe_n"))
    one = pairs.agg(F.coalesce(F.sum(F.when(known, F.col("c"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(known & (F.col("a") == F.col("b")), F.col("c"))), F.lit(0)).alias("n_agree"), F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)).alias("n_excluded"))
    # both sides are single rows
    row = one.join(F.broadcast(chance), F.lit(True))
    n = F.col("n").cast("double")
    po, pe = F.try_divide(F.col("n_agree").cast("double"), n), F.try_divide(F.col("pe_n").cast("double"), n * n)
    row = row.withColumn("raw_agreement", po).withColumn("kappa", F.when(pe < 1, F.try_divide(po - pe, 1 - pe)))
    status = F.when(F.col("n") == 0, "no_data").when(F.col("kappa").isNull(), "undefined").when(F.col("n") < least, "insufficient_sample").otherwise("ok")
    return row.withColumn("status", status).drop("pe_n")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty: 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def text_rates(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """cer per row (null without hypothesis) and bucket: no_output, exact, partial (under a half), wrong. Rows with an empty reference stay out."""
    r, h = F.col(reference), F.col(hypothesis)
    cer = F.when(F.coalesce(h, F.lit("")) != "", S.char_error_rate(r, h))
    out = df.where(F.coalesce(r, F.lit("")) != "").withColumn("cer", cer)
    return out.withColumn("bucket", F.when(F.col("cer").isNull(), "no_output").when(F.col("cer") == 0, "exact").when(F.col("cer") < 0.5, "partial").otherwise("wrong"))


def text_report(rated: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """One row over text_rates: macro and micro error rates, buckets, both exact rates, coverage."""
    b = lambda x: F.count_if(F.col("bucket") == x)
    answered = F.col("cer").isNotNull()
    n, a = F.count(F.lit(1)).cast("double"), F.count_if(answered).cast("double")
    return rated.agg(
        F.count(F.lit(1)).alias("n_references"), F.avg("cer").alias("cer_macro"),
        F.try_divide(F.sum(F.when(answered, F.levenshtein(F.col(reference), F.col(hypothesis)))).cast("double"), F.sum(F.when(answered, F.length(reference))).cast("double")).alias("cer_micro"),
        b("exact").alias("n_exact"), b("partial").alias("n_partial"), b("wrong").alias("n_wrong"), b("no_output").alias("n_no_output"),
        F.try_divide(b("exact").cast("double"), n).alias("exact_of_all"), F.try_divide(b("exact").cast("double"), a).alias("exact_of_answered"), F.try_divide(a, n).alias("coverage"),
    )


def latency(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, linear 95th percentile, maximum, population deviation by group."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.95)).alias("p95"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))


def deltas(df: DataFrame, name: str, value: str, clean: str) -> DataFrame:
    """Each row's value and its drop from the row named ``clean``; null where there is none. df holds one row a name."""
    base = F.max(F.when(F.col(name) == clean, F.col(value))).over(Window.partitionBy())
    return df.withColumn("drop_from_clean", base - F.col(value))
