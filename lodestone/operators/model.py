"""A hook for a language model: batches of prompts out of a table, answers read back into it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import model_reply


def asked(rows: DataFrame, key: str, prompt: Column, candidates: Column, ask: Callable[[list[str]], list[str | None]], batch: int = 32, tries: int = 2) -> DataFrame:
    """key, code, confidence and reason of what a model says to each prompt.

    ask: answers for up to `batch` prompts, in their order; it runs in the tasks, which open their own connections. An
    error is tried again `tries` times, and then the batch's rows have no answer (all null), as have rows
    without a prompt and answers that name none of the candidates: nothing is dropped.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            replies: list[str | None] = []
            prompts = part["prompt"].tolist()
            for lo in range(0, len(prompts), batch):
                some = prompts[lo : lo + batch]
                for left in reversed(range(tries + 1)):
                    try:
                        got = iter(ask([p for p in some if p]))
                        replies += [next(got) if p else None for p in some]
                        break
                    except Exception:  # whatever the model's client raises
                        if not left:
                            replies += [None] * len(some)
            yield pd.DataFrame({key: part[key], "candidates": part["candidates"], "reply": pd.Series(replies, dtype=object)})

    told = rows.select(key, candidates.alias("candidates"), prompt.alias("prompt")).mapInPandas(run, f"{key} {kind}, candidates array<string>, reply string")
    code, confidence, reason = model_reply(F.col("reply"), F.col("candidates"))
    return told.select(key, code.alias("code"), confidence.alias("confidence"), reason.alias("reason"))
