"""Multi-step plans: production fusion, pseudo-label curation, lever audit."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnscore.functions.scalar import sigmoid, taxon_temperature, temperature
from dawnscore.operators import align, blend, metrics, normalize, priors, pseudo, smooth
from dawnscore.plans.q_metrics import tie
from dawnscore.plans.views import ROW, SERIES, Views
from dawnscore.sources import tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro AUC per stream: both inputs, plain rank blend, rescued blend."""
    d = blend.rescue_rules(Views(spark, sf_dir).scores, "pa", "pb", "rescued", tie=tie)
    plain = 0.7 * F.col("rank_a") + 0.3 * F.col("rank_b")
    d = d.select("class", "y", "pa", "pb", F.round(plain, 9).alias("blend"),
                 F.round("rescued", 9).alias("rescued"))
    long = align.unpivot_streams(d, {c: c for c in ("pa", "pb", "blend", "rescued")}, "stream", "p")
    return metrics.macro_auc(long, ["stream"], "p")


def fused_scores(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Prior, temperature, file confidence, rank-aware scaling, smoothing, rank blend with rescues.

    The series steps run on one partitioning by file; ranks need one counting pass per stream and
    a join by class and value.
    """
    d = priors.shrunk_prior(scores, priors.prior_tables(scores))
    d = d.withColumn("_l", F.log((F.col(a) + 1e-6) / (1 - F.col(a) + 1e-6)) + 0.4 * F.col("prior_logit"))
    d = d.withColumn("_p", temperature(sigmoid(F.col("_l")), taxon_temperature(F.col("taxon"))))
    d = normalize.file_confidence(d, SERIES, "_p", "_p")
    d = normalize.rank_aware(d, SERIES, "_p", "_p")
    d = smooth.adaptive_blend(d, "_p", "_s")
    d = d.withColumn("stream_a", F.round(F.least(F.greatest("_s", F.lit(0.0)), F.lit(1.0)), 9))
    # three rank tables and the join read this stage: written once instead of computed four times
    d = tables.stage(d.drop("_l", "_p", "_s"), "stream-a")
    return blend.rescue_rules(d, "stream_a", b, "fused", tie=tie)


def curated_pseudo(scores: DataFrame, sims: DataFrame) -> DataFrame:
    """Fuse, agree, refine, confirm by embedding, keep multi-site classes."""
    d = scores.withColumn("fused", 0.7 * F.col("pa") + 0.3 * F.col("pb"))
    d = normalize.coherence(d, SERIES, "fused", "fused")
    agreed = (F.col("fused") > 0.25) & (F.col("pa") > 0.15) & (F.col("pb") > 0.2)
    r = pseudo.refine(d, agreed, "fused", [], ["error"], {"x": ["click", "view"]}, [], 0.3)
    kept = r.filter("stage = 'kept'").drop("stage")
    kept = pseudo.acoustic_confirm(kept, sims, ROW, 3)
    return pseudo.multi_site_entries(kept, "fused", 0.25, 0.25)
