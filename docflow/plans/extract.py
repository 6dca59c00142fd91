"""One extraction attempt per ref with a user-supplied model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.classify import classify_error, earns_fallback, normalise_message


@dataclass(frozen=True)
class Request:
    """What a model gets: the address, an optional payload, the attempt number."""

    url: str
    payload: Any = None
    seq: int = 1


@dataclass(frozen=True)
class Result:
    """Text and token counts, or an error message.

    ``prompt_tokens`` and ``completion_tokens`` are what the call is charged for, also when it
    failed; ``tokens``, if not given, is their sum.
    """

    text: str | None = None
    tokens: int | None = None
    error: str | None = None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None

    def charged(self) -> tuple[int, int]:
        return self.prompt_tokens or 0, self.completion_tokens or 0

    def counted(self) -> int:
        return sum(self.charged()) if self.tokens is None else self.tokens


Model = Callable[[list[Request]], list[Result]]


def _guarded(model: Model, requests: list[Request]) -> list[Result]:
    """A model that raises fails its requests, never the task.

    A call with several requests that raises or gives a wrong number of results
    is repeated request by request, so that each fails or succeeds on its own.
    """
    try:
        results = list(model(requests))
        if len(results) == len(requests):
            return results
        problem = "model returned a wrong number of results"
    except Exception as raised:  # noqa: BLE001 - any failure is an outcome here
        problem = str(raised) or type(raised).__name__
    if len(requests) == 1:
        return [Result(error=problem)]
    return [_guarded(model, [request])[0] for request in requests]


_LOADED: dict[str, Model] = {}


def _loaded(load_model: Callable[[], Model], model_key: str | None) -> Model:
    """The model of this worker: loaded once per key, or per task without one."""
    if model_key is None:
        return load_model()
    if model_key not in _LOADED:
        _LOADED.clear()
        _LOADED[model_key] = load_model()
    return _LOADED[model_key]


def _call_all(model: Model, requests: list[Request], pool: ThreadPoolExecutor, size: int):
    slices = [requests[i : i + size] for i in range(0, len(requests), size)]
    return [r for part in pool.map(lambda s: _guarded(model, s), slices) for r in part]


def extract_once(
    todo: DataFrame,
    load_model: Callable[[], Model],
    keys: list[str],
    seq: int = 1,
    payload: str | None = None,
    carry: list[str] | None = None,
    concurrency: int | None = None,
    threads: int = 4,
    call_size: int = 16,
    model_key: str | None = None,
) -> DataFrame:
    """Run the model once over ``todo`` (keys, ``primary``, ``fallback``).

    The model is loaded once per worker that sees ``model_key`` (without one,
    once per task) and called with up to ``call_size``
    requests from ``threads`` threads; calls in flight are tasks x threads.
    ``concurrency`` sets the number of tasks; without it the partitions stay as
    they are and nothing is shuffled. A failed primary call that the rules allow
    gets one call with the fallback address; the attempt's ``prompt_tokens`` and
    ``completion_tokens`` are those of both calls.

    The calls cost money and may differ from run to run, so store the result
    before using it twice.
    """
    carry = carry or []
    sent = todo.select(
        *dict.fromkeys([*keys, *carry, "primary", "fallback", *([payload] if payload else [])])
    )
    if concurrency:
        sent = sent.repartition(concurrency)

    kept = [sent.schema[c] for c in (*keys, *carry)]
    out = T.StructType(
        [
            *kept,
            T.StructField("text", T.StringType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("prompt_tokens", T.LongType()),
            T.StructField("completion_tokens", T.LongType()),
            T.StructField("raw_message", T.StringType()),
            T.StructField("on_fallback", T.BooleanType()),
        ]
    )
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(load_model, model_key)
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                loads = batch[payload].tolist() if payload else [None] * len(batch)
                first = [Request(u, p, seq) for u, p in zip(batch["primary"], loads, strict=True)]
                results = _call_all(model, first, pool, call_size)
                other = batch["fallback"].tolist()
                again = [
                    i
                    for i, r in enumerate(results)
                    if r.error is not None and isinstance(other[i], str) and earns_fallback(r.error)
                ]
                charged = [r.charged() for r in results]
                second = [Request(other[i], loads[i], seq) for i in again]
                for i, r in zip(again, _call_all(model, second, pool, call_size), strict=True):
                    results[i] = r
                    charged[i] = tuple(map(sum, zip(charged[i], r.charged(), strict=True)))
                done = batch[kept_names].copy()
                failed = [r.error is not None for r in results]
                done["text"] = [None if f else r.text or "" for f, r in zip(failed, results)]
                done["tokens"] = [None if f else r.counted() for f, r in zip(failed, results)]
                done["tokens"] = done["tokens"].astype("Int64")
                done["prompt_tokens"] = [prompt for prompt, _ in charged]
                done["completion_tokens"] = [completion for _, completion in charged]
                done["raw_message"] = [r.error for r in results]
                used = set(again)
                done["on_fallback"] = [i in used for i in range(len(results))]
                yield done

    outcome = F.coalesce(classify_error(F.col("raw_message")), F.lit("done"))
    return (
        sent.mapInPandas(run, out)
        .withColumn("seq", F.lit(seq).cast("long"))
        .withColumn("outcome", outcome)
        .withColumn(
            "message",
            normalise_message(F.col("raw_message"), F.col("outcome"), F.col("on_fallback")),
        )
        .drop("raw_message")
    )
