"""Train/test split by the cumulative distribution of a row hash, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cleanframe.functions.cells import row_hash
from cleanframe.session import written

# Hex digits settled per pass, which bounds what the driver reads per pass.
DIGITS_PER_PASS = 3
DIRECT = 4096


# Sorts after every hex digit.
_ABOVE = "~"


def split_cut(df: DataFrame, hashed: Column, ratio: float) -> str:
    """A text that separates the hashes whose cumulative share is within `ratio`.

    Rows are counted by hash prefix (map-side combined), and only the prefix
    that straddles the cut is opened further, so copies of one row stay a
    single counter however many there are.
    """
    # The row text and its hash are computed once; the passes below read hashes only.
    hashes = written(df.select(hashed.alias("h")), "hashes")
    prefix, below, total, cut = "", 0, None, ""
    inside = None
    while True:
        width = len(prefix) + DIGITS_PER_PASS
        direct = inside is not None and inside <= DIRECT
        slot = F.col("h") if direct or width >= 32 else F.substring("h", 1, width)
        # Numbers tell as well as the hashes whether a slot holds only one of them,
        # and are aggregated by hashing, where texts would be sorted.
        tag = F.xxhash64("h")
        counts = (
            hashes.filter(F.col("h").startswith(prefix))
            .groupBy(slot.alias("slot"))
            .agg(F.count("*").alias("n"), F.min(tag).alias("lo"), F.max(tag).alias("hi"))
            .collect()
        )
        if total is None:
            total = sum(r["n"] for r in counts)
        straddling = None
        for r in sorted(counts, key=lambda r: r["slot"]):
            if (below + r["n"]) / total > ratio:
                straddling = r
                break
            below += r["n"]
            cut = r["slot"] + _ABOVE
        if straddling is None or straddling["lo"] == straddling["hi"]:
            return cut
        prefix, inside = straddling["slot"], straddling["n"]


def train_test_split(
    df: DataFrame, ratio: float = 0.8, columns: list[str] | None = None, name: str = "split_set"
) -> DataFrame:
    """Add `split_set`; equal rows always land on the same side."""
    hashed = row_hash(df, columns or df.columns)
    return mark_split(df, hashed, split_cut(df, hashed, ratio), name)


def mark_split(df: DataFrame, hashed: Column, cut: str, name: str = "split_set") -> DataFrame:
    return df.withColumn(name, F.when(hashed <= F.lit(cut), "train").otherwise("test"))
