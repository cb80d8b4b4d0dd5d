"""Texts: templates of questions, sections of scripts, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sections of a script that only a map can fill, and columns of its table likewise.
MAP_SECTIONS = ("LANES", "FORK", "BODY")
_CHOICE = re.compile(r"\[\[(.*?)(?:\|\|(.*?))?\]\]", re.DOTALL)


def sides(traffic: str) -> dict[str, str]:
    """What curb and far mean where traffic keeps to a side."""
    if traffic not in ("left", "right"):
        raise ValueError("traffic keeps left or right")
    far = {"left": "right", "right": "left"}[traffic]
    return {"curb": traffic, "far": far, "CURB": traffic.upper(), "FAR": far.upper()}


def fill_template(text: str, names: dict[str, str], indicator: bool) -> str:
    """A definition with its side names, and of each [[with||without]] the part for logs with or without an indicator [FN-11]."""
    chosen = _CHOICE.sub(lambda m: m[1] if indicator else m[2] or "", text)
    return " ".join(chosen.format(**names).split())


def events_of(script: Column) -> Column:
    """array<struct<time, what>> of a script's events, lines such as "+0.5 s indicator RIGHT on" [FN-12]."""
    lines = F.regexp_extract_all(script, F.lit(r"(?m)^ *([+-][0-9.]+) s +(.+)$"), F.lit(0))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"([+-][0-9.]+) s", 1).cast("double").alias("time"), F.trim(F.regexp_extract(x, r" s +(.+)$", 1)).alias("what")))


def without_map(script: str, map_free_objects: str | None = None) -> str:
    """A script without what only a map tells [TX-03].

    Sections are headed by a line of capitals that ends in a colon. Map sections go, map events and lane relations go;
    the section of objects is replaced by the selection that needs no map, if there is one; EVENTS left empty say none.
    """
    out: list[str] = []
    section, skip = "", False
    for line in [*script.split("\n"), "END:"]:
        head = re.fullmatch(r"([A-Z][A-Z ]+)(?: \(.*\))?:.*", line)
        if head:
            if section == "EVENTS" and out and out[-1].startswith("EVENTS"):
                out.append("none")
            section = head[1]
            skip = any(section.startswith(s) for s in MAP_SECTIONS) or (section.startswith("OBJECTS") and map_free_objects is not None)
            if section.startswith("OBJECTS") and map_free_objects is not None:
                out += map_free_objects.split("\n")
        if not skip and not (section == "EVENTS" and re.search(r"\b(neighbor|successor|lane [A-Z]+)\b", line)):
            out.append(re.sub(r",? in (?:lane [A-Z]+|an unmapped area)", "", line) if section.startswith("OBJECTS") else line)
    return "\n".join(out[:-1])


def cell(value) -> str:
    return "-" if value is None else f"{value:g}" if isinstance(value, float) else str(value)


def table(head: list[str], rows: list[list]) -> str:
    lines = [head, ["---"] * len(head), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)


def report_markdown(report: dict) -> str:
    """A benchmark's scores as Markdown [TX-08]."""
    parts = [f"# {report['name']}", f"Kind: **{report['kind']}**. {report['provenance']}", f"Manifest: `{report['manifest_sha256']}`"]
    for name, run in sorted(report["runs"].items()):
        labels = [[k, v["TP"], v["FN"], v["FP"], v["precision"], v["recall"]] for k, v in sorted(run["labels"].items())]
        total = run["total"]
        parts += [f"## {name}", table(["label", "TP", "FN", "FP", "precision", "recall"], [*labels, ["total", total["TP"], total["FN"], total["FP"], total["precision"], total["recall"]]])]
        timing = run["timing_s"]
        parts += [f"Matched {timing['n']}; start error {cell(timing['start_abs_median'])} s, end error {cell(timing['end_abs_median'])} s (medians)."]
        parts += [f"Agreement: lateral {cell(run['agreement'].get('lateral'))}, longitudinal {cell(run['agreement'].get('longitudinal'))}."]
        if run["confusion"]:
            parts += [table(["truth", "run", "seconds"], [[r["gt"], r["run"], round(r["n"] / 10, 1)] for r in run["confusion"]])]
    return "\n\n".join(parts) + "\n"
