"""Answers of an external model, with a cache of what was asked before.

A backend is made on the executors by a factory and has provider, endpoint and predict(script) -> answer. The default
backend answers from rules and asks no network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "lateral string, lateral_probs map<string,double>, longitudinal string, longitudinal_probs map<string,double>, model string, input_tokens long, provider string"
ANSWERED = [field.split()[0] for field in ANSWER.split(", ")]
#: The states that are worth another try, how often, and the bounds of the waits in seconds.
RETRIED, TRIES, FIRST_WAIT, LONGEST_WAIT = frozenset({429, 500, 502, 503, 504, 529}), 6, 1.0, 30.0
PRICE_PER_MILLION, OVERHEAD_TOKENS, CHARS_PER_TOKEN = 0.042, 1400, 4


class BackendError(Exception):
    def __init__(self, status: int):
        super().__init__(f"the backend answered {status}")
        self.status = status


@dataclass
class RuleBackend:
    """Deterministic answers from the words of a script [IN-02]."""

    provider: str = "rules"
    endpoint: str = "local"

    def predict(self, script: str) -> dict:
        low = script.lower()
        lateral = next((label for word, label in (("left", "turn_left"), ("right", "turn_right")) if word in low), "keep_lane")
        longitudinal = "stopped" if "stop" in low else "cruising"
        return {"lateral": lateral, "lateral_probs": {lateral: 1.0}, "longitudinal": longitudinal, "longitudinal_probs": {longitudinal: 1.0}, "model": self.provider, "input_tokens": len(script) // CHARS_PER_TOKEN, "provider": self.provider}


def patient(ask: Callable[[], dict], wait: Callable[[float], None] = time.sleep) -> dict:
    """ask(), again after states that pass, with doubling waits [IN-03]."""
    pause = FIRST_WAIT
    for attempt in range(1, TRIES + 1):
        try:
            return ask()
        except BackendError as e:
            if e.status not in RETRIED or attempt == TRIES:
                raise
        wait(pause)
        pause = min(2 * pause, LONGEST_WAIT)
    raise AssertionError


def parse_response(response: dict, provider: str) -> dict:
    """The answer in a response of choices with probabilities: the likeliest of each question, the first of equals [IN-04]."""
    out = {"model": response.get("model"), "input_tokens": (response.get("usage") or {}).get("input_tokens"), "provider": provider}
    for name in ("lateral", "longitudinal"):
        probs = {str(k): float(v) for k, v in (response.get(name) or {}).items()}
        out[name] = max(probs, key=probs.get) if probs else None
        out[f"{name}_probs"] = probs
    return out


def latest(cache: DataFrame) -> DataFrame:
    """key, answer: the last row of each key by seq [SRC-17]."""
    return cache.groupBy("key").agg(F.max_by("answer", "seq").alias("answer"))


def with_cache(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """prompts with the cached answer of their key, null on a miss [JN-20]."""
    return prompts.join(latest(cache), "key", "left")


def attempted(prompts: DataFrame, cache: DataFrame, backend: Callable[[], object] = RuleBackend, workers: int = 8, partitions: int | None = None, strict: bool = False) -> DataFrame:
    """key, answer and error of the prompts (key, script) that the cache misses [IN-01, OR-04]. Each key is asked once.

    A state that stays bad after all tries gives a null answer and its text as error; with strict it ends the job.
    """
    asked = prompts.join(cache, "key", "left_anti").dropDuplicates(["key"]).select("key", "script")
    if partitions:
        asked = asked.repartition(partitions, "key")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = backend()

        def ask(script: str) -> tuple[dict | None, str | None]:
            try:
                return patient(lambda: service.predict(script)), None
            except BackendError as e:
                if strict:
                    raise
                return None, str(e)

        with ThreadPoolExecutor(workers) as pool:
            for rows in batches:
                found = list(pool.map(ask, rows["script"]))
                out = pd.DataFrame({c: pd.Series([(a or {}).get(c) for a, _ in found], index=rows.index, dtype=object) for c in ANSWERED})
                out.insert(0, "key", rows["key"])
                out["error"] = [e for _, e in found]
                yield out

    flat = asked.mapInPandas(answer, f"key string, {ANSWER}, error string")
    return flat.select("key", F.when(F.col("error").isNull(), F.struct(*ANSWERED)).alias("answer"), "error")


def classify(prompts: DataFrame, cache: DataFrame, backend: Callable[[], object] = RuleBackend, workers: int = 8, partitions: int | None = None) -> DataFrame:
    """key and answer of the prompts (key, script) that the cache misses; a backend that stays unable ends the job [IN-01].

    Append the result to the cache table: an answer that was saved is never asked for again, so a run that fails
    goes on where it stopped.
    """
    return attempted(prompts, cache, backend, workers, partitions, strict=True).drop("error")


def rerun(samples: DataFrame, fresh: DataFrame, keys: tuple = ("session_id", "t_ns")) -> DataFrame:
    """samples with fresh answers where there are some and the old ones elsewhere [IN-06]."""
    new = fresh.withColumnRenamed("answer", "__new")
    return samples.join(new, list(keys), "left").withColumn("answer", F.coalesce("__new", "answer")).drop("__new")


def incompatible(outside: DataFrame, cache: DataFrame) -> DataFrame:
    """Answered rows whose key the cache does not hold; a ranged rerun is refused if there are any [JN-21]."""
    return outside.filter("answer is not null").join(cache, "key", "left_anti")


def totals(answers: DataFrame) -> DataFrame:
    """fresh, tokens, cost in dollars and models of answered rows [AG-20, SNK-04]."""
    tokens = F.sum(F.coalesce("answer.input_tokens", F.lit(0)))
    return answers.agg(F.count("*").alias("fresh"), tokens.alias("input_tokens"), (tokens * PRICE_PER_MILLION / 1e6).alias("cost_usd"), F.array_sort(F.collect_set("answer.model")).alias("models"))


def estimate(prompts: DataFrame) -> DataFrame:
    """prompts, tokens and cost of asking for all scripts [AG-21]."""
    tokens = F.sum(F.length("script")) / CHARS_PER_TOKEN + F.count("*") * OVERHEAD_TOKENS
    return prompts.agg(F.count("*").alias("prompts"), tokens.cast("long").alias("input_tokens"), (tokens * PRICE_PER_MILLION / 1e6).alias("cost_usd"))


def ranked(probs: Column) -> Column:
    """Labels of a map of probabilities, the likeliest first and of equals by name; those that are no number or negative go [TK-06]."""
    good = F.filter(F.map_entries(probs), lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]) & (e["value"] >= 0) & (e["value"] < float("inf")))
    return F.transform(F.array_sort(F.transform(good, lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("label")))), lambda e: e["label"])
