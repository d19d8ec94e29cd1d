"""Sentences about differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_summary(counts: DataFrame, left: str, right: str, left_nodes: DataFrame, right_nodes: DataFrame) -> DataFrame:
    """One sentence per fact on two imports, from counts by kind of difference."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("diff_type") == kind, F.col("n"))), F.lit(0))
    one = counts.agg(n("different").alias("d"), n("only_left").alias("l"), n("only_right").alias("r")).crossJoin(left_nodes.agg(F.count("*").alias("ln"))).crossJoin(right_nodes.agg(F.count("*").alias("rn")))
    diff = F.col("rn") - F.col("ln")
    number = lambda c: F.format_number(c, 0)
    parts = [
        F.when(diff != 0, F.concat(F.lit(f"{right} has "), number(F.abs(diff)), F.when(diff > 0, " more").otherwise(" fewer"), F.lit(f" packages than {left}."))).otherwise(f"{right} and {left} have the same number of packages."),
        F.when(F.col("d") > 0, F.concat(number(F.col("d")), F.lit(" packages have different versions."))),
        F.when(F.col("l") > 0, F.concat(number(F.col("l")), F.lit(f" packages only in {left}."))),
        F.when(F.col("r") > 0, F.concat(number(F.col("r")), F.lit(f" packages only in {right}."))),
    ]
    return one.select(F.concat_ws(" ", *parts).alias("summary"))


def category_text(summaries: DataFrame, shown: int = 3) -> DataFrame:
    """The categories with most additions and most removals."""

    def most(column: str, sign: str):
        rows = F.sort_array(F.collect_list(F.when(F.col(column) > 0, F.struct((-F.col(column)).alias("n"), "category"))))
        return F.array_join(F.transform(F.slice(rows, 1, shown), lambda x: F.concat(x["category"], F.lit(f" ({sign}"), (-x["n"]).cast("string"), F.lit(")"))), ", ")

    one = summaries.agg(most("right_only", "+").alias("a"), most("left_only", "-").alias("r"))
    text = F.concat_ws(" ", F.when(F.col("a") != "", F.concat(F.lit("Main additions: "), "a", F.lit("."))), F.when(F.col("r") != "", F.concat(F.lit("Main removals: "), "r", F.lit("."))))
    return one.select(F.when(text == "", "No significant category changes.").otherwise(text).alias("summary"))


def version_text(changes: DataFrame) -> DataFrame:
    """How many upgrades, downgrades, rebuilds and other changes there are."""
    count = lambda kind: F.count_if(F.col("change") == kind)
    one = changes.agg(count("upgrade").alias("u"), count("downgrade").alias("d"), count("rebuild").alias("b"), count("unknown").alias("o"), F.count("*").alias("n"))
    some = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {word}"), F.when(F.col(c) == 1, "").otherwise("s")))
    text = F.concat_ws(", ", some("u", "upgrade"), some("d", "downgrade"), some("b", "rebuild"), some("o", "other change"))
    return one.select(F.when(F.col("n") == 0, "No version changes detected.").otherwise(F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" version changes: "), text, F.lit("."))).alias("summary"))
