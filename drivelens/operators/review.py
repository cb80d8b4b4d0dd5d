"""Human reviews of a stretch of time, laid over evidence by the absolute time of each observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is null about lanes in a reviewed row's margin.
LANE_FIELDS = ("lane", "road_context", "intersection", "map_turn_direction", "offset_m", "relative_heading_deg", "matched_lane_id")


def state(time: Column, start: Column, end: Column, margin: Column) -> Column:
    """core within the review, margin within its margin, else none; bounds count [FLT-10]."""
    return F.when(time.between(start, end), "core").when(time.between(start - margin, end + margin), "margin").otherwise("none")


def touches(start: Column, end: Column, review_start: Column, review_end: Column, margin: Column) -> Column:
    """Whether a closed interval meets a review with its margin [FLT-11]."""
    return (start <= review_end + margin) & (end >= review_start - margin)


def road_shares(occupancy: Column) -> Column:
    """Shares (percent) of lanes in the driving direction outside of intersections; none if they exceed the whole [FLT-12].

    occupancy: array<struct<lane, share, direction, intersection>>.
    """
    kept = F.filter(occupancy, lambda o: (o["direction"] == "same") & ~o["intersection"])
    total = F.aggregate(kept, F.lit(0.0), lambda a, o: a + o["share"])
    return F.when(total > 101, F.slice(kept, 1, 0)).otherwise(kept)


def reviewed(observations: DataFrame, reviews: DataFrame, time: str = "t_ns") -> DataFrame:
    """observations with the review of their session applied [TX-04, card of review override].

    reviews: session_id, start, end, margin, chain_id. In the core the lane is the review's, on the road and not in an
    intersection; in the margin nothing is known about lanes. Motion stays. Rows without a review are unchanged.
    """
    joined = observations.join(reviews.withColumnsRenamed({"start": "__s", "end": "__e", "margin": "__m", "chain_id": "__c"}), "session_id", "left")
    own = F.when(F.col("__s").isNotNull(), state(F.col(time), F.col("__s"), F.col("__e"), F.col("__m"))).otherwise("none")
    out = joined.withColumn("review", own)
    core = {"lane": F.col("__c"), "road_context": F.lit("road"), "intersection": F.lit(False)}
    for name in LANE_FIELDS:
        if name in observations.columns:
            kind = observations.schema[name].dataType
            within = core[name].cast(kind) if name in core else F.lit(None).cast(kind)
            out = out.withColumn(name, F.when(F.col("review") == "core", within).when(F.col("review") == "margin", F.lit(None).cast(kind)).otherwise(F.col(name)))
    return out.drop("__s", "__e", "__m", "__c")


def reviewed_bodies(bodies: DataFrame, reviews: DataFrame, time: str = "t_ns", kept: tuple[str, ...] = ("ego_data_available",)) -> DataFrame:
    """bodies with no measured geometry where a review covers them, and what the review says instead [OR-06].

    reviews: session_id, start, end, margin, chain_id, source, one a session. In its core and margin every column but
    session_id, time and `kept` is null. Its core adds physical_lane_chain and an ownership of 100 percent, both add
    lane_evidence_source; elsewhere these three are null.
    """
    names = {"start": "__s", "end": "__e", "margin": "__m", "chain_id": "__c", "source": "__o"}
    joined = bodies.join(reviews.select("session_id", *[F.col(a).alias(b) for a, b in names.items()]), "session_id", "left")
    here = joined.withColumn("__state", F.when(F.col("__s").isNotNull(), state(F.col(time), F.col("__s"), F.col("__e"), F.col("__m"))).otherwise("none"))
    own, core = F.col("__state") == "none", F.col("__state") == "core"
    fixed = ("session_id", time, *kept)
    return here.select(
        *[F.col(c) if c in fixed else F.when(own, F.col(c)).alias(c) for c in bodies.columns],
        F.when(core, F.col("__c")).alias("physical_lane_chain"), F.when(core, 100).alias("physical_lane_ownership_pct"), F.when(~own, F.col("__o")).alias("lane_evidence_source"),
    )


def preparation_report(samples: DataFrame, script: str = "script", previous: str = "previous", chain: str = "physical_lane_chain") -> DataFrame:
    """session_id, samples, reviewed, chars, previous_chars: what scripts amount to beside those that they replace [AG-23]."""
    chars = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0))
    return samples.groupBy("session_id").agg(F.count("*").alias("samples"), F.count(chain).alias("reviewed"), chars(script).alias("chars"), chars(previous).alias("previous_chars"))
