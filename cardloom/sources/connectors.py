"""Places where recognition engines and decoders plug in. Errors of single rows are data, never a failed job."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Recognizer(Protocol):
    """Made once in each task; reads one image and gives its text and confidence."""

    def read(self, image: bytes) -> tuple[str, float]: ...


class TransientError(RuntimeError):
    """A failure that is worth another try."""


def retried(call: Callable[[], tuple], tries: int = 3, backoff: float = 1.0, jitter: float = 0.25) -> tuple:
    for n in range(tries):
        try:
            return call()
        except TransientError:
            if n + 1 == tries:
                raise
            time.sleep(backoff * 2**n + random.random() * jitter)
    raise ValueError("tries must be positive")


def recognized(images: DataFrame, make: Callable[[], Recognizer], second: Callable[[], Recognizer] | None = None, *, tries: int = 3, backoff: float = 1.0) -> DataFrame:
    """images (card_id, content) with raw_text, confidence, latency_ms and error. What the first engine fails on is read by
    the second in the same task, so that no image is sent to an engine twice."""

    def attempt(engine: Recognizer, content: bytes) -> tuple:
        try:
            text, confidence = retried(lambda: engine.read(content), tries, backoff)
            return text, float(confidence), None
        except Exception as e:  # noqa: BLE001  whatever an engine raises belongs to its row
            return None, 0.0, str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, other = make(), None
        for b in batches:
            rows = []
            for content in b["content"]:
                began = time.perf_counter()
                got = attempt(engine, content)
                if got[2] is not None and second is not None:
                    other = other or second()
                    got = attempt(other, content)
                rows.append((*got, (time.perf_counter() - began) * 1000))
            out = pd.DataFrame(rows, columns=["raw_text", "confidence", "error", "latency_ms"])
            out.insert(0, "card_id", b["card_id"].to_numpy())
            yield out

    return images.select("card_id", "content").mapInPandas(run, "card_id string, raw_text string, confidence double, error string, latency_ms double")


def with_fallback(images: DataFrame, first: Callable[[], Recognizer], second: Callable[[], Recognizer] | None, **how) -> DataFrame:
    """Rows that fail with the first engine go to the second, if there is one."""
    return recognized(images, first, second, **how)


class Model(Protocol):
    """Made at most once in each task; reads one image and gives the fields of its answer."""

    def answer(self, image: bytes) -> dict[str, object]: ...


ANSWER = "deceased_name string, date_of_death string, usage_json string, raw_text string, latency_ms double, error string"


def checked_answer(got: object) -> tuple[str, str, str, str]:
    """An answer's fields, if it has the form that is asked for: a name and a date as texts, blank ones as null."""
    if not isinstance(got, dict):
        raise ValueError(f"the answer is {type(got).__name__}, not fields")
    if lacking := [k for k in ("deceased_name", "date_of_death") if k not in got]:
        raise ValueError(f"the answer lacks {', '.join(lacking)}")
    texts = [got[k] for k in ("deceased_name", "date_of_death")]
    if wrong := [type(t).__name__ for t in texts if t is not None and not isinstance(t, str)]:
        raise ValueError(f"the answer has {wrong[0]} where a text belongs")
    return *((t or "").strip() for t in texts), json.dumps(got.get("usage") or {}, sort_keys=True), str(got.get("raw_text") or "")


def routed(cards: DataFrame, makers: dict[str, Callable[[], Model]], *, tries: int = 3, backoff: float = 1.0) -> DataFrame:
    """cards (card_id, model_id, content) with what the model that each row names answers: ANSWER.

    A task makes a model when a row first asks for it and keeps it to its end. A model that can't be made, is unknown, fails or
    answers in another form is an error of its rows; the others go on. Latency covers all tries. Rows of a model may be spread
    over any number of tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool: dict[str, Model | Exception] = {}

        def model_of(name: str) -> Model:
            if name not in pool:
                try:
                    pool[name] = makers[name]()
                except KeyError:
                    pool[name] = ValueError(f"no model is named {name}")
                except Exception as e:  # noqa: BLE001  a model that can't be made is an error of its rows
                    pool[name] = e
            if isinstance(pool[name], Exception):
                raise pool[name]
            return pool[name]

        for b in batches:
            rows = []
            for name, content in zip(b["model_id"], b["content"], strict=True):
                began = time.perf_counter()
                try:
                    got, error = retried(lambda: checked_answer(model_of(name).answer(content)), tries, backoff), None  # noqa: B023
                except Exception as e:  # noqa: BLE001  whatever a model raises belongs to its row
                    got, error = ("", "", "{}", ""), str(e) or type(e).__name__
                rows.append((*got, (time.perf_counter() - began) * 1000, error))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])
            out.insert(0, "model_id", b["model_id"].to_numpy())
            out.insert(0, "card_id", b["card_id"].to_numpy())
            yield out

    kind = cards.schema["card_id"].dataType.simpleString()
    return cards.select("card_id", "model_id", "content").mapInPandas(run, f"card_id {kind}, model_id string, {ANSWER}")


def tesseract_words(rows: DataFrame) -> DataFrame:
    """Raw word rows of a local engine (text, conf, left, top, width, height, ...) as words with boxes; blanks and -1 go."""
    good = (F.col("conf") != -1) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    box = F.array(F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height"))
    return rows.where(good).withColumn("bbox", box)


def batch_outcome(results: DataFrame) -> DataFrame:
    """Counters of a batch: processed, failed, and the error of the first failed card."""
    bad = F.col("error").isNotNull()
    return results.agg(F.count_if(~bad).alias("processed"), F.count_if(bad).alias("failed"), F.min_by(F.when(bad, F.col("error")), F.when(bad, F.col("sequence_index"))).alias("first_error"))
