"""Classification and summary evaluation from small count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.schemas import MODEL_LABELS

# The scores a judge must return.
JUDGE_FIELDS = ("faithfulness", "coverage", "sentiment_alignment", "clarity", "overall")


def confusion_cells(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels=MODEL_LABELS) -> DataFrame:
    """One row per actual label, one column per predicted label, in fixed order, zeros filled in."""
    cells = confusion_cells(df, actual, predicted)
    wide = cells.groupBy("actual").agg(
        *[F.coalesce(F.sum(F.when(F.col("predicted") == x, F.col("n"))), F.lit(0)).alias(f"pred_{x}") for x in labels]
    )
    rows = df.sparkSession.createDataFrame([(x,) for x in labels], wide.select("actual").schema)
    return rows.join(wide, "actual", "left").select("actual", *[F.coalesce(f"pred_{x}", F.lit(0)).alias(f"pred_{x}") for x in labels])


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every label seen in truth or prediction; 0 where undefined."""
    cells = confusion_cells(df, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), zero.alias("chosen"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("chosen"), zero.alias("hits")),
    )))
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "chosen", "hits")])
    precision, recall = _ratio(F.col("hits"), F.col("chosen")), _ratio(F.col("hits"), F.col("support"))
    return sums.select(
        "label", precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"), "support", "hits",
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy with macro and weighted averages, one row."""
    report = classification_report(df, actual, predicted)
    total = F.sum("support")
    names = ("precision", "recall", "f1")
    return report.agg(
        _ratio(F.sum("hits"), total).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in names],
        *[_ratio(F.sum(F.col(c) * F.col("support")), total).alias(f"{c}_weighted") for c in names],
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("label_count"))
    totals = counts.agg(F.struct(F.sum("label_count").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return counts.withColumn("_t", totals).select(
        label, "label_count", (F.col("_t.n") / (F.col("_t.k") * F.col("label_count"))).alias("weight")
    )


def with_class_weights(df: DataFrame, label: str, labels=MODEL_LABELS) -> DataFrame:
    """Training rows of the fixed labels with their weight; at most one broadcast row per label."""
    kept = df.where(F.col(label).isin(*labels))
    weights = class_weights(kept, label).select(label, F.col("weight").alias("class_weight"))
    return kept.join(F.broadcast(weights), label)


def judge_scores(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """The judge's five scores as doubles. Text that is not JSON, a missing field or a score outside 1..5, or a
    fraction where only ``overall`` may have one, fails the job when ``strict``, else gives NULL scores and ``valid`` false."""
    parsed = F.from_json(F.col(column), ", ".join(f"{f} double" for f in JUDGE_FIELDS))
    valid = F.lit(True)
    for f in JUDGE_FIELDS:
        score = F.col(f"_judge.{f}")
        whole = F.lit(True) if f == "overall" else score == F.floor(score)
        valid = valid & F.coalesce(score.between(1, 5) & whole, F.lit(False))
    checked = df.withColumn("_judge", parsed).withColumn("valid", valid)
    if strict:
        checked = checked.withColumn("valid", F.when(F.col("valid"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("invalid judge answer: "), F.coalesce(F.col(column), F.lit("missing"))))))
    return checked.select(*df.columns, "valid", *[F.when(F.col("valid"), F.col(f"_judge.{f}")).alias(f) for f in JUDGE_FIELDS])


def evaluation_record(df: DataFrame, overlap: str, alignment: str, judged: bool = True) -> DataFrame:
    """One record of a run: number of examples, mean ROUGE-L, mean alignment F1 and, when ``judged``, the judge's means; to be appended
    with ``append_metrics``."""
    judge = [F.struct(*[F.avg(c).alias(f"avg_{c}") for c in JUDGE_FIELDS]).alias("llm_judge")] if judged else []
    return df.agg(F.count(F.lit(1)).alias("count"), F.avg(overlap).alias("avg_rouge_l"), F.avg(alignment).alias("avg_alignment_f1"), *judge)


def average_scores(df: DataFrame, columns) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("examples"), *[F.avg(c).alias(f"avg_{c}") for c in columns])
