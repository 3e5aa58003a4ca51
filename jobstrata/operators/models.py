"""Asking a model for each row, by whatever the user brings.

A provider is made once in each task by ``provider()`` and called with a
prompt; it returns the answer or raises.  Errors that may pass (F24) are tried
again after a growing wait; so are answers that count as empty, if asked for.
Others end the row's turn.  A row's outcome is a column, never an error of the
query.  A task that is run again asks again, as with any call to the outside;
put a cache (operators.state.cache_read) before it to ask only once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TRANSIENT

Provider = Callable[[str], str]
OUTCOME = "answer string, attempts int, error string"
#: Tries of a prompt, and the bounds of the wait between them in seconds (fixed values).
ATTEMPTS, SHORTEST, LONGEST = 3, 2.0, 16.0


def may_pass(error: str) -> bool:
    """F24, for one error."""
    low = error.lower()
    return any(w in low for w in TRANSIENT)


def waits(tries: int) -> float:
    """Seconds before the next try, after so many."""
    return min(max(2.0 * 2 ** (tries - 1), SHORTEST), LONGEST)


def ask(call: Provider, prompt: str, attempts: int, empty: Callable[[str], bool] | None, sleep: Callable[[float], None]) -> tuple[str | None, int, str | None]:
    answer, error = None, None
    for n in range(1, attempts + 1):
        try:
            answer, error = call(prompt), None
            if empty is None or not empty(answer):
                return answer, n, None
        except Exception as e:  # noqa: BLE001  what a provider raises is the row's outcome
            answer, error = None, str(e) or type(e).__name__
            if not may_pass(error):
                return None, n, error
        if n < attempts:
            sleep(waits(n))
    return answer, attempts, error


def answers(prompt: Column, provider: Callable[[], Provider], attempts: int = ATTEMPTS, empty: Callable[[str], bool] | None = None, sleep: Callable[[float], None] = time.sleep) -> Column:
    """answer, attempts and error of each prompt; a null prompt isn't asked."""

    @F.pandas_udf(OUTCOME)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = provider()
        for part in parts:
            rows = [(None, 0, None) if p is None else ask(call, p, attempts, empty, sleep) for p in part]
            yield pd.DataFrame(rows, columns=["answer", "attempts", "error"])

    return run(prompt)


def answered(rows: DataFrame, prompt: Column, provider: Callable[[], Provider], **options) -> DataFrame:
    """Rows with the outcome of their prompts beside them."""
    said = answers(prompt, provider, **options)
    return rows.withColumn("__said", said).select(*[F.col(f"`{c}`") for c in rows.columns], "__said.*")
