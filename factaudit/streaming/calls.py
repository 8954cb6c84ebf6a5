"""The boundary to model calls: a pluggable function over partitions, with retry and batch splitting.

No model is called here; ``respond`` is whatever the caller passes, and tests pass a fixed function.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


#: Errors that may pass: the network's and the clock's.  Any other fails a prompt at once.
TRANSIENT = (TimeoutError, ConnectionError)


def transient(error: Exception) -> bool:
    """Whether trying again may help: a network error, or one that carries a status of 408, 429 or 5xx."""
    status = getattr(error, "status_code", None)
    return isinstance(error, TRANSIENT) or (isinstance(status, int) and (status in (408, 429) or 500 <= status < 600))


def map_requests(requests: DataFrame, key: str, prompt: str, respond: Callable[[list[str]], list[str]], batch_size: int = 16, attempts: int = 3, pause: float = 0.0, min_gap: float = 0.0,
                 retry: Callable[[Exception], bool] = transient, valid: Callable[[str], bool] | None = None, workers: int | None = None) -> DataFrame:
    """(key, reply, attempts, error): replies to prompts, partition by partition.

    A batch that fails is halved down to single prompts; a single prompt is tried ``attempts`` times
    with a growing pause while ``retry`` allows its error, then reported with the error's kind.  A reply
    that is not ``valid`` counts as the error ``InvalidReply`` and is tried again.  ``workers`` bounds how
    many tasks call at once, and ``min_gap`` seconds pass between two calls of a task, so the calls of all
    tasks start at least ``min_gap / workers`` apart on average; one worker makes that strict.
    """
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = [0.0]

        def call(prompts: list[str]) -> list[str]:
            wait = last[0] + min_gap - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            last[0] = time.monotonic()
            replies = respond(prompts)
            if len(replies) != len(prompts):
                raise ValueError("replies do not match prompts")
            return replies

        def answer(keys: list, prompts: list[str]) -> list[tuple]:
            if len(prompts) > 1:
                try:
                    replies = call(prompts)
                    if valid is None or all(map(valid, replies)):
                        return [(k, r, 1, None) for k, r in zip(keys, replies)]
                    raise ValueError("a reply is not valid")
                except Exception:
                    half = len(prompts) // 2
                    return answer(keys[:half], prompts[:half]) + answer(keys[half:], prompts[half:])
            for n in range(1, attempts + 1):
                try:
                    reply = call(prompts)[0]
                    if valid is None or valid(reply):
                        return [(keys[0], reply, n, None)]
                    error = "InvalidReply"
                except Exception as e:
                    error = type(e).__name__
                    if not retry(e):
                        return [(keys[0], None, n, error)]
                if n < attempts:
                    time.sleep(pause * 2 ** (n - 1))
            return [(keys[0], None, attempts, error)]

        for batch in batches:
            keys, prompts = batch[key].tolist(), batch[prompt].tolist()
            out = []
            for at in range(0, len(keys), batch_size):
                out += answer(keys[at : at + batch_size], prompts[at : at + batch_size])
            yield pd.DataFrame(out, columns=[key, "reply", "attempts", "error"])

    rows = requests.select(key, prompt) if workers is None else requests.select(key, prompt).repartition(workers)
    return rows.mapInPandas(run, f"{key} {kind}, reply string, attempts int, error string")
