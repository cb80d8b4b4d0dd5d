"""Scenes against ground truth, probabilities against outcomes and tags against scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from . import intervals

OVERLAP_NS = schemas.NS // 2
GRID_NS = schemas.NS // 10
TAG_WINDOW_NS, TAG_CLUSTER_NS = 5 * schemas.NS, 3 * schemas.NS
#: The scene labels that each kind of tag asks for.
TAG_LABELS = {
    "starting_left_turn": ("lateral", ("turn_left",)),
    "starting_right_turn": ("lateral", ("turn_right",)),
    "starting_u_turn": ("lateral", ("u_turn",)),
    "changing_lane_to_left": ("lateral", ("lane_change_left",)),
    "changing_lane_to_right": ("lateral", ("lane_change_right",)),
    "stationary": ("longitudinal", ("stopped",)),
    "stationary_in_traffic": ("longitudinal", ("stopped",)),
    "accelerating_at_stop_sign": ("longitudinal", ("accelerating",)),
}


def spans(documents: DataFrame, key: str = "lateral") -> DataFrame:
    """session_id, at, start, end, label of the scenes of documents, or of their phases [AG-01].

    documents: session_id, scenes (schemas.SCENE_ROW). A phase starts where the one before it ends; older documents
    have one label a scene; none is unknown.
    """
    scenes = documents.select("session_id", F.posexplode("scenes").alias("at", "s")).withColumn("start", F.col("s.start_ns").cast("long")).withColumn("end", F.col("s.end_ns").cast("long"))
    if key == "longitudinal":
        own = F.struct(F.col("s.end_ns").alias("end_ns"), F.col("s.longitudinal").alias("decision"))
        phases = F.coalesce(F.col("s.longitudinal_phases"), F.array(own))
        parts = scenes.select("session_id", "at", "start", phases.alias("phases"), F.posexplode(phases).alias("part", "p"))
        begin = F.when(F.col("part") == 0, F.col("start")).otherwise(F.try_element_at("phases", F.greatest(F.col("part"), F.lit(1)))["end_ns"].cast("long"))
        rows = parts.select("session_id", "at", "part", begin.alias("start"), F.col("p.end_ns").cast("long").alias("end"), F.col("p.decision").alias("label"))
    else:
        rows = scenes.select("session_id", "at", F.lit(0).alias("part"), "start", "end", F.coalesce("s.driving_decision", "s.lateral").alias("label"))
    return rows.withColumn("label", F.when(F.length("label") > 0, F.col("label")).otherwise(schemas.UNKNOWN))


def maneuvers(lateral: DataFrame, keys=("session_id",)) -> DataFrame:
    """Merged maneuvers, numbered in order within their session [AG-02]."""
    from pyspark.sql import Window

    merged = intervals.merge_touching(lateral, list(keys), slack=schemas.NS // 1_000_000 - 1)
    return merged.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")) - 1)


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole rounded half to even; null when the whole is 0."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def precision_recall(truth: DataFrame, run: DataFrame, matched: DataFrame) -> DataFrame:
    """label, TP, FN, FP, precision and recall of maneuvers [AG-03]. matched: label of each pair."""
    count = lambda df, name: df.groupBy("label").agg(F.count("*").alias(name))
    rows = count(truth, "n_gt").join(count(run, "n_run"), "label", "full").join(count(matched, "tp"), "label", "left").fillna(0)
    return rows.select("label", F.col("tp").alias("TP"), (F.col("n_gt") - F.col("tp")).alias("FN"), (F.col("n_run") - F.col("tp")).alias("FP"), share(F.col("tp"), F.col("n_run")).alias("precision"), share(F.col("tp"), F.col("n_gt")).alias("recall"))


def upper_median(value: str, digits: int | None = 2) -> Column:
    """The upper of the two middle values, an aggregate that Spark sorts and spills; null for no values [AG-04]."""
    listed = F.array_sort(F.collect_list(value))
    middle = F.try_element_at(listed, (F.floor(F.size(listed) / 2) + 1).cast("int"))
    return middle if digits is None else F.bround(middle, digits)


def confusion(truth: DataFrame, run: DataFrame, grid: int = GRID_NS, keys=("session_id",)) -> DataFrame:
    """keys, gt, run, n: grid midpoints of each truth span, counted from its own start, by what the run says there [AG-05].

    A span has its length over the grid, rounded half to even, midpoints; one that reaches its end is left out.
    """
    n = F.rint((F.col("end") - F.col("start")) / F.lit(float(grid))).cast("int")
    points = truth.withColumn("__n", n).filter("__n > 0").select(*keys, "start", "end", F.col("label").alias("gt"), F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__k"))
    points = points.withColumn("__at", F.col("start") + F.col("__k").cast("long") * grid + grid // 2).filter("__at < `end`").select(*keys, F.col("__at").alias("at"), "gt")
    found = intervals.label_at(points, run.select(*keys, "start", "end", "label"), list(keys), "at", "run", "(none)")
    return found.groupBy(*keys, "gt", "run").agg(F.count("*").alias("n"))


def agreement(confused: DataFrame, *keys: str) -> DataFrame:
    """The share of the grid on which both sides agree [AG-06]."""
    return confused.groupBy(*keys).agg(share(F.sum(F.when(F.col("gt") == F.col("run"), F.col("n")).otherwise(0)), F.sum("n")).alias("agreement"))


def top_confusions(confused: DataFrame, most: int = 12) -> DataFrame:
    """The largest confusions among the first `most` pairs; agreeing pairs take part in the limit and are dropped after it [AG-07]."""
    total = confused.groupBy("gt", "run").agg(F.sum("n").alias("n"))
    return total.orderBy(F.desc("n"), "gt", "run").limit(most).filter("gt <> run")


def calibration(steps: DataFrame, keys: tuple = ()) -> DataFrame:
    """bin, steps, correct by tenths of probability [AG-08]. steps: p, label, truth; rows without label or truth don't count."""
    known = steps.filter("label is not null and truth is not null").withColumn("bin", F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int"))
    return known.groupBy(*keys, "bin").agg(F.count("*").alias("steps"), share(F.sum((F.col("label") == F.col("truth")).cast("long")), F.count("*")).alias("correct"))


def score_tags(tags: DataFrame, lateral: DataFrame, longitudinal: DataFrame, checks: dict | None = None) -> DataFrame:
    """kind, events, found, share [AG-09]. tags: session_id, t_ns, kind; sessions without scenes don't count."""
    checks = TAG_LABELS if checks is None else checks
    sessions = lateral.select("session_id").distinct()
    events = intervals.keep_apart(tags.filter(F.col("kind").isin(*checks)).join(sessions, "session_id", "left_semi"), ["session_id", "kind"], "t_ns", TAG_CLUSTER_NS)
    of = lambda side: [k for k, (s, _) in checks.items() if s == side]
    wanted = F.create_map(*[x for k, (_, labels) in checks.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in labels]))])
    # a span stands for each kind of tag that asks for its label
    asked = F.array(*[F.when(F.col("label").isin(*checks[k][1]), k) for k in of("lateral")]).cast("array<string>")
    expected = lateral.select("session_id", "start", "end", F.explode(F.array_compact(asked)).alias("kind"))
    near = intervals.any_near(events.filter(F.col("kind").isin(*of("lateral"))), expected, ["session_id", "kind"], "t_ns", TAG_WINDOW_NS, "hit")
    at = intervals.label_at(events.filter(F.col("kind").isin(*of("longitudinal"))), longitudinal.select("session_id", "start", "end", "label"), ["session_id"], "t_ns", "label")
    hits = near.select("kind", "hit").unionByName(at.select("kind", F.array_contains(wanted[F.col("kind")], F.col("label")).alias("hit")))
    found = F.count_if("hit")
    return hits.groupBy("kind").agg(F.count("*").alias("events"), found.alias("found"), share(found, F.count("*")).alias("share"))


def match_maneuvers(truth: DataFrame, run: DataFrame, keys=("session_id",), least: int = OVERLAP_NS) -> DataFrame:
    """Pairs of maneuvers of one label with their start and end errors [OR-20, JN-14, TK-04]."""
    pairs = intervals.overlap_pairs(truth, run.withColumnRenamed("i", "j"), [*keys, "label"], least, 600 * schemas.NS)
    pairs = pairs.withColumnRenamed("r_j", "j")
    matched = intervals.greedy_match(pairs, [*keys, "label"])
    return matched.withColumn("start_error", F.col("r_start") - F.col("start")).withColumn("end_error", F.col("r_end") - F.col("end"))


def score(truth: DataFrame, run: DataFrame) -> dict[str, DataFrame]:
    """labels, total, timing and agreement of scene documents over the sessions that both sides have [JN-19, ST-02]."""
    both = truth.select("session_id").intersect(run.select("session_id"))
    g, r = truth.join(both, "session_id", "left_semi"), run.join(both, "session_id", "left_semi")
    gm, rm = maneuvers(spans(g)), maneuvers(spans(r))
    matched = match_maneuvers(gm, rm)
    labels = precision_recall(gm, rm, matched)
    total = labels.agg(*[F.sum(c).alias(c) for c in ("TP", "FN", "FP")])
    total = total.select("*", share(F.col("TP"), F.col("TP") + F.col("FP")).alias("precision"), share(F.col("TP"), F.col("TP") + F.col("FN")).alias("recall"))
    seconds = matched.select((F.col("start_error") / schemas.NS).alias("s"), (F.col("end_error") / schemas.NS).alias("e")).withColumn("sa", F.abs("s")).withColumn("ea", F.abs("e"))
    timing = seconds.agg(F.count("*").alias("n"), upper_median("sa").alias("start_abs_median"), upper_median("ea").alias("end_abs_median"), upper_median("s").alias("start_median"), upper_median("e").alias("end_median"))
    lateral, longitudinal = confusion(spans(g), spans(r)), confusion(spans(g, "longitudinal"), spans(r, "longitudinal"))
    agreed = agreement(lateral).select(F.lit("lateral").alias("key"), "agreement").unionByName(agreement(longitudinal).select(F.lit("longitudinal").alias("key"), "agreement"))
    return {"labels": labels, "total": total, "timing": timing, "agreement": agreed, "confusion": top_confusions(lateral)}
