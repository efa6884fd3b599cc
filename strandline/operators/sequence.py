"""Sequences: GC windows and gapped k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gc_windows(sequences: DataFrame, window: int, step: int, by: list[str], seq: str = "seq", bases: str = "ACGT") -> DataFrame:
    """GC bins of windows that end at multiples of ``step``: floor(gc / (gc + at) * window), null without known bases.

    Windows are cut from the string at the steps only, inside its row: what leaves
    the row is numbers, not copies of the sequence.
    """
    n = F.length(seq)
    upper = F.translate(seq, "acgt", "ACGT")
    rows = sequences.filter(n > 0)
    if window % step:
        ends = F.sequence(F.lit(1), F.floor((F.length("_s") - 1) / step).cast("int") + 1)
        part = lambda k: F.substring("_s", F.greatest(k * step - window, F.lit(0)) + 1, F.least(k * step, F.length("_s")) - F.greatest(k * step - window, F.lit(0)))
        held = rows.select(*by, upper.alias("_s")).select(*by, F.posexplode(F.transform(ends, part)).alias("bin", "_w"))
    else:
        # pieces of one step are cut in one pass; a generator of one row keeps them from being cut anew for each window
        pieces = F.regexp_extract_all(upper, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        cut = rows.select(*by, F.explode(F.array(pieces)).alias("_p"))
        back = window // step
        part = lambda p, i: F.array_join(F.slice("_p", F.greatest(i - back + 2, F.lit(1)), F.least(i + 1, F.lit(back))), "")
        held = cut.select(*by, F.posexplode(F.transform("_p", part)).alias("bin", "_w"))
    gc = F.length("_w") - F.length(F.translate("_w", "GC", ""))
    at = F.length("_w") - F.length(F.translate("_w", "AT", ""))
    return held.select(*by, "bin", F.when(gc + at > 0, F.floor(gc / (gc + at) * window).cast("int")).alias("gc"))


def kmer_counts(sequences: DataFrame, k: int, by: list[str], seq: str = "seq") -> DataFrame:
    """k-mers of each sequence and how often they occur; only words leave their row, not the sequence.

    Words are dealt by their sequence before they are counted: few repeat inside one,
    so a table of them in the task that reads would hold nearly all that it reads.
    """
    n = F.length(seq)
    words = F.transform(F.sequence(F.lit(1), n - k + 1), lambda p: F.substring(F.col(seq), p, F.lit(k)))
    spread = sequences.filter(n >= k).select(*by, F.explode(words).alias("kmer")).repartition(*by)
    return spread.groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))


def top_rows(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).withColumnRenamed("_r", "rank")
