"""Read-by-allele evidence in long form: (sample_id, locus, read_id, allele, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept

KEY = ["sample_id", "locus", "read_id", "allele"]
#: Candidates up to which they are broadcast; counted each time.
BROADCAST_CANDIDATES = 500_000


def best_scores(alignments: DataFrame) -> DataFrame:
    """Best score of each read for each allele."""
    return alignments.groupBy(*KEY).agg(F.max("as_score").alias("score"))


def evidence(alignments: DataFrame, candidates: DataFrame | None = None, min_mapq: int = 0, min_score: int = 0) -> DataFrame:
    """Primary alignments that reach the limits, and the secondary ones of the same reads.

    candidates(sample_id, allele), if given, are the alleles that count.
    Secondary alignments need a score of their own.
    """
    a = alignments
    if candidates is not None:
        few = kept(candidates.select("sample_id", "allele").distinct())
        a = a.join(F.broadcast(few) if few.count() <= BROADCAST_CANDIDATES else few, ["sample_id", "allele"], "left_semi")
    primary = ~F.col("is_secondary") & (F.col("mapq") >= min_mapq) & (F.coalesce("as_score", "mapq") >= min_score)
    rows = a.select(*KEY, F.when(primary, F.coalesce("as_score", "mapq")).alias("_p"), F.when(F.col("is_secondary"), F.col("as_score")).alias("_s"))
    # Reads are dealt once: a read's scores, and whether it has a primary alignment, are found where it is.
    best = rows.where("_p is not null or _s is not null").repartition("sample_id", "read_id").groupBy(*KEY).agg(F.max("_p").alias("_p"), F.max("_s").alias("_s"))
    seen = F.max("_p").over(Window.partitionBy("sample_id", "read_id")).isNotNull() & F.col("sample_id").isNotNull() & F.col("read_id").isNotNull()
    return best.withColumn("score", F.greatest("_p", F.when(seen, F.col("_s")))).where("score is not null").select(*KEY, "score")


def normalise(scores: DataFrame, within_locus: bool = False) -> DataFrame:
    """Adds weight: the score as a share of the read's best, over all loci or within the locus."""
    by = ["sample_id", "locus", "read_id"] if within_locus else ["sample_id", "read_id"]
    best = F.max("score").over(Window.partitionBy(*by)).cast("double")
    return scores.withColumn("weight", F.when(best > 0, F.col("score").cast("double") / best).otherwise(F.lit(0.0)))
