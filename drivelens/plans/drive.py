"""Whole runs over tables: prompts of samples, answers with failures kept apart, scenes, and what a run amounts to.

A sample is session_id, t_ns and script. Nothing is collected; a session that fails is a row that says so, and running
again asks only for what the cache does not hold.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cache_key_column
from ..functions.text import without_map
from ..operators import stitch
from . import inference


def choice_specs(labels: dict, lateral_only: bool = False) -> dict:
    """The questions of a label set as plain data: instructions and criteria by question [IN-05]."""
    asked = ("lateral",) if lateral_only else ("lateral", "longitudinal")
    return {name: {"instructions": labels.get(f"{name}_instructions", ""), "criteria": dict(labels[name])} for name in asked}


def prompts(samples: DataFrame, sessions: DataFrame, questions: DataFrame, model: str | None = None, provider: str | None = None, endpoint: str | None = None, version: str | None = None) -> DataFrame:
    """samples with the key of their question set and script [OR-02, FN-10].

    sessions: session_id, side, has_indicator; questions: side, has_indicator, questions (JSON), a row for each kind of
    session. A session without a known kind has a null key and is not asked.
    """
    kind = sessions.join(questions, ["side", "has_indicator"], "left").select("session_id", "questions")
    given = [F.lit(v).cast("string") for v in (model, provider, endpoint, version)]
    key = F.when(F.col("questions").isNotNull() & F.col("script").isNotNull(), cache_key_column(F.coalesce("questions", F.lit("null")), F.coalesce("script", F.lit("")), *given))
    return samples.join(kind, "session_id", "left").withColumn("key", key).drop("questions")


def ablated(samples: DataFrame, plain_objects: str | None = None) -> DataFrame:
    """samples whose scripts tell nothing that only a map knows [OR-04, TX-03]; plain_objects names the column of their selection without a map."""
    columns, kinds = samples.columns, dict(samples.dtypes)

    def run(batches):
        for part in batches:
            others = part[plain_objects] if plain_objects else [None] * len(part)
            part["script"] = [None if pd.isna(s) else without_map(s, None if pd.isna(o) else o) for s, o in zip(part["script"], others, strict=True)]
            yield part

    return samples.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def answered(asked: DataFrame, cache: DataFrame, backend: Callable[[], object] = inference.RuleBackend, workers: int = 8) -> DataFrame:
    """asked (prompts) with answer and error: from the cache (key, seq, answer), else from the backend, which gets each key once [OR-03, OR-04]."""
    known = inference.latest(cache)
    fresh = inference.attempted(asked.filter("key is not null").select("key", "script"), known, backend, workers)
    found = known.select("key", "answer", F.lit(None).cast("string").alias("error"), F.lit(False).alias("fresh")).unionByName(fresh.withColumn("fresh", F.lit(True)))
    return asked.join(found, "key", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


def session_report(done: DataFrame) -> DataFrame:
    """session_id, samples, failed, error of answered prompts: samples without an answer, and the first error by time [OR-03, OR-04]."""
    open_ = F.col("answer").isNull()
    return done.groupBy("session_id").agg(F.count("*").alias("samples"), F.count_if(open_).alias("failed"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("t_ns"))).alias("error"))


def run_totals(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: sessions, skipped (without samples), calls, chars, tokens and cost estimated before asking [OR-03, AG-21]."""
    per = asked.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("script")).alias("c"))
    both = sessions.select("session_id").distinct().join(per, "session_id", "left")
    total = both.agg(F.count("n").alias("sessions"), F.count_if(F.col("n").isNull()).alias("skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("calls"), F.coalesce(F.sum("c"), F.lit(0)).alias("chars"))
    tokens = F.col("chars") / inference.CHARS_PER_TOKEN + F.col("calls") * inference.OVERHEAD_TOKENS
    return total.withColumn("tokens", tokens).withColumn("cost_usd", tokens * inference.PRICE_PER_MILLION / 1e6)


def scenes(done: DataFrame, sessions: DataFrame, step_s: float, min_scene_s: float, tail_s: float = 0.0, protected: DataFrame | None = None, **settings) -> DataFrame:
    """Scenes of answered samples, stitched anew with any settings and without asking again [OR-05, SNK-07].

    Samples without an answer are left out. settings: those of `stitch`.
    """
    steps = done.filter("answer is not null").select("session_id", "t_ns", "answer.*")
    return stitch.extend_maneuver_ends(stitch.stitch(steps, sessions, step_s, min_scene_s, **settings), tail_s, protected)
