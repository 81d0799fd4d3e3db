"""Decision rules of the ablations: small frames of metrics against thresholds, the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotally.operators.prep import rule_table


def height_decisions(metrics: DataFrame, importance: float, max_gap: float, min_improvement: float) -> DataFrame:
    """metrics (feature, importance, gap_increase, f1_improvement) with decision exclude or include and the reason."""
    return rule_table(metrics, [(f"importance > {importance}", "exclude"), (f"gap_increase > {max_gap}", "exclude"), (f"f1_improvement < {min_improvement}", "exclude")], "include")


def proximity_decisions(metrics: DataFrame, max_loss: float, min_improvement: float) -> DataFrame:
    """metrics (sample_loss, f1_improvement) with decision baseline or filtered and the reason."""
    return rule_table(metrics, [(f"sample_loss > {max_loss}", "baseline"), (f"f1_improvement < {min_improvement}", "baseline")], "filtered")


def outlier_decisions(results: DataFrame, max_loss: float, min_improvement: float, baseline: str = "no_removal") -> DataFrame:
    """results (variant, n_rows, val_f1) with sample_loss, f1_improvement and chosen: of the variants that lose few rows and improve
    enough the one with the best score (ties: by name), if it beats the baseline; else the baseline."""
    base = results.where(F.col("variant") == baseline).agg(F.first("n_rows").alias("b_rows"), F.first("val_f1").alias("b_f1"))
    both = results.join(F.broadcast(base)).withColumns({"sample_loss": 1 - F.col("n_rows") / F.col("b_rows"), "f1_improvement": F.col("val_f1") - F.col("b_f1")})  # one row
    passes = (F.col("variant") != baseline) & (F.col("sample_loss") <= max_loss) & (F.col("f1_improvement") >= min_improvement) & (F.col("val_f1") > F.col("b_f1"))
    place = F.row_number().over(Window.orderBy(F.when(passes, 0).when(F.col("variant") == baseline, 1).otherwise(2), F.desc("val_f1"), "variant"))  # a row a variant
    return both.withColumn("chosen", place == 1).select("variant", "n_rows", "val_f1", "sample_loss", "f1_improvement", "chosen")
