"""Calls of external models inside a job (STM-03, STM-06): retries, fallbacks, a breaker for models that are down.

Models are plain callables from text to text that the caller passes in; nothing here opens a connection. Each task keeps
its own breaker: a model that failed ``limit`` times in a row is not asked again by that task."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[str], str]


def translate_prompt(text, language: str = "Vietnamese"):
    """Prompt column that asks for a translation and leaves names and keys alone."""
    return F.format_string(f"Translate the values into {language}. Keep keys, names and structure.\n%s", text)


def classify_prompt(name, description, parameters, categories: list[str]):
    """Prompt column that asks for one category of a tool; at most ten parameter names are shown."""
    return F.format_string("Tool: %s\nDescription: %s\nParameters: %s\nAnswer with one of: " + ", ".join(categories), name, F.coalesce(description, F.lit("")), F.array_join(F.slice(parameters, 1, 10), ", "))


def ask(text: str, models: list[tuple[str, Model]], down: dict[str, int], attempts: int, limit: int, wait: float) -> tuple[str | None, str | None, str | None]:
    """(answer, model, error) of the first model that answers; blank answers count as failures."""
    error = "no model left"
    for name, model in models:
        if down.get(name, 0) >= limit:
            continue
        for k in range(attempts):
            try:
                answer = model(text)
                if answer and answer.strip():
                    down[name] = 0
                    return answer, name, None
                error = f"{name}: empty answer"
            except Exception as e:  # noqa: BLE001 - whatever a client raises is a failure of this attempt
                error = f"{name}: {type(e).__name__}: {e}"
            if k + 1 < attempts:
                time.sleep(wait * 2**k)
        down[name] = down.get(name, 0) + 1
    return None, None, f"all models failed; last={error}"


def answered(rows: DataFrame, key: str, prompt: str, models: list[tuple[str, Model]], attempts: int = 2, limit: int = 5, wait: float = 0.0, at_once: int = 4) -> DataFrame:
    """(key, answer, model, error): the answer to each prompt, at most ``at_once`` at a time in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        down: dict[str, int] = {}
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(lambda t: ask(t, models, down, attempts, limit, wait), b[prompt]))
                yield pd.DataFrame({key: b[key], "answer": [g[0] for g in got], "model": [g[1] for g in got], "error": [g[2] for g in got]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, prompt).where(F.col(prompt).isNotNull()).mapInPandas(run, f"{key} {kind}, answer string, model string, error string")
