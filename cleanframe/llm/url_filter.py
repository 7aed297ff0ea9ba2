"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams for the other URLs.

Defined results: a NULL URL and one without `://` have an empty host and path; no rule fits them and the model judges the
empty strings. Equal rules and repeated rows are judged alike. If no URL of the training table is allowed, or none is
blocked, every URL without a rule gets the verdict of the table, and `allow` if the table is empty. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, functions as F

from cleanframe.llm.common import lower_ascii, smallest, written

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: str) -> tuple[Column, Column]:
    """What stands after the first `://`: up to `/`, `?`, `#` or the end, A-Z in lower case; then up to `?`, `#` or the end."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, the first of equals; NULL without one. A rule is a host and a
    path, `example.org/es/`, and fits the host and its subdomains if the path starts with the rule's. The rules are
    a list that the caller holds (some hundreds at most, as each is held against every URL)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules[::-1], key=lambda r: len(r[0])):  # the last that fits is kept
        name, slash, rest = rule.partition("/")
        name = name.lower()
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def _grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams between a start and an end mark, with the mark in front; in time linear in the length."""
    chars = F.concat(F.array(F.lit("^")), F.array_remove(F.split(text, ""), ""), F.array(F.lit("$")))

    def of(n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, n), "")))

    return F.concat(*map(of, sizes))


def featured(urls: DataFrame, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Adds `grams` to a table with host and path."""
    return urls.withColumn("grams", F.concat(_grams(F.col("host"), "h", sizes), _grams(F.col("path"), "p", sizes)))


class UrlFilter:
    """Rules, and a model for the URLs that no rule fits."""

    def __init__(self, rules: list[tuple[str, str]], model: PipelineModel | None, otherwise: str):
        self.rules, self.model, self.otherwise = rules, model, otherwise

    @classmethod
    def fit(cls, labelled: DataFrame, rules: list[tuple[str, str]], buckets: int = 1 << 14, rows_per_class: int = 4000) -> UrlFilter:
        """Learns from a table (url, verdict), at most `rows_per_class` distinct URLs of each verdict (smallest hashes)."""
        host, path = host_and_path("url")
        own = labelled.filter(F.col("verdict").isin(ALLOW, BLOCK)).select(host.alias("host"), path.alias("path"), "verdict").distinct()
        order = (F.xxhash64("host", "path"), F.col("host"), F.col("path"))
        sample = smallest(own.filter(F.col("verdict") == ALLOW), rows_per_class, *order).unionAll(smallest(own.filter(F.col("verdict") == BLOCK), rows_per_class, *order))
        sample = written(featured(sample).select("grams", (F.col("verdict") == BLOCK).cast("double").alias("label")), "url-sample")
        seen = [r["label"] for r in sample.select("label").distinct().collect()]
        if len(seen) < 2:
            return cls(rules, None, BLOCK if seen == [1.0] else ALLOW)
        steps = [HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets, binary=True), LogisticRegression(maxIter=30, regParam=0.001)]
        return cls(rules, Pipeline(stages=steps).fit(sample), ALLOW)

    def judge(self, urls: DataFrame, id_column: str, url: str = "url") -> DataFrame:
        """One row for each row: id, host, path, rule, verdict, p_block (NULL where a rule decided)."""
        host, path = host_and_path(url)
        parts = urls.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
        rule, says = fitting_rule(F.col("host"), F.col("path"), self.rules)
        ruled = parts.withColumns({"rule": rule, "says": says})
        if self.model is None:
            p, verdict = F.lit(None).cast("double"), F.coalesce("says", F.lit(self.otherwise))
        else:
            from pyspark.ml.functions import vector_to_array

            ruled = self.model.transform(featured(ruled))
            p = F.when(F.col("says").isNull(), vector_to_array("probability")[1])
            verdict = F.coalesce("says", F.when(F.col("prediction") == 1, BLOCK).otherwise(ALLOW))
        return ruled.select(F.col("id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), p.alias("p_block"))


def labelled_by_rules(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """(url, verdict) of the URLs that a rule fits: a training table."""
    host, path = host_and_path(url)
    parts = urls.select(F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    return parts.select("url", fitting_rule(F.col("host"), F.col("path"), rules)[1].alias("verdict")).filter("verdict is not null")
