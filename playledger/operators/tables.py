"""Small table operators: guards, alignment, text forms and scores that plans share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import ContractError
from .ranks import running


def guarded_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """A join that must keep the left side's number of rows; raises if it does not."""
    out = left.join(right, list(on), how)
    before, after = left.count(), out.count()
    if before != after:
        raise ContractError(f"{before} rows became {after}")
    return out


def joined_with_suffix(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_other", how: str = "inner") -> DataFrame:
    """A join whose right columns of clashing names get the suffix."""
    names = {c: c + suffix if c in left.columns else c for c in right.columns if c not in on}
    if clash := {n for n in names.values() if list(names.values()).count(n) > 1 or (n in left.columns)}:
        raise ContractError(f"names still clash: {sorted(clash)}")
    return left.join(right.select(*on, *(F.col(c).alias(n) for c, n in names.items())), list(on), how)


def conflicts(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, n: the keys whose rows differ in a value (null is a value of its own)."""
    forms = F.struct(*values)
    return df.groupBy(*keys).agg(F.count_distinct(F.to_json(forms, {"ignoreNullFields": "false"})).alias("n")).where("n > 1")


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """df with a column of 0 or 1 per value; a null or unknown value has 0 in all."""
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n rows of each group that come last in the order."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def literal_list(text: Column) -> Column:
    """The items of a list written as a Python or JSON literal, as text; null for anything else."""
    shaped = F.when(F.trim(text).rlike(r"^\[.*\]$"), F.replace(text, F.lit("'"), F.lit('"')))
    return F.from_json(shaped, "array<string>")


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a name in a namespace, given as 32 hexadecimal digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), 1, 16)
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant.substr(digit + 1, F.lit(1)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def normal_cdf(z: Column) -> Column:
    """Phi(z), within 1.5e-7 (a rational approximation of the error function)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values: coefficients of the approximation
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - series * F.exp(-x * x)
    return F.lit(0.5) * (1 + F.signum(z) * erf)


def normal_crps(mean: Column, sd: Column, seen: Column) -> Column:
    """Continuous ranked probability score of a normal forecast; the lower the better."""
    z = (seen - mean) / sd
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return sd * (z * (2 * normal_cdf(z) - 1) + 2 * density - 1 / math.sqrt(math.pi))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under precision and recall: the mean precision at each distinct score, by the positives at it."""
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p"))
    down = running(per.withColumn("_down", -F.col(score)), ["_down"], {"_all": "_n", "_hit": "_p"})
    return down.agg((F.sum(F.col("_p") * F.col("_hit") / F.col("_all")) / F.sum("_p")).alias("average_precision"))


def hashed_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the text of the parts: the same for the same parts, on any machine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def sign_flips(df: DataFrame, key: str, value: str, rounds: int) -> DataFrame:
    """mean, p: the mean of a difference per key and the share of sign-flipped means at least as far from 0.

    Signs are hashed from key and round; the observed assignment counts as one of rounds + 1.
    """
    base = df.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v")).where("v is not null")
    sums = [F.sum(F.when(hashed_unit("k", F.lit(str(r))) < 0.5, F.col("v")).otherwise(-F.col("v"))).alias(f"r{r}") for r in range(rounds)]
    one = base.agg(F.sum("v").alias("s"), F.count("*").alias("n"), *sums)
    far = sum((F.when(F.abs(F.col(f"r{r}")) >= F.abs(F.col("s")) - 1e-9, 1).otherwise(0) for r in range(rounds)), F.lit(0))
    return one.select((F.col("s") / F.col("n")).alias("mean"), ((far + 1) / (rounds + 1)).alias("p"))
