"""Plug-ins for embedding, reranking and summaries, and the adaptor hooks."""

from __future__ import annotations

import json
import os
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import embed_text, lexical_overlap
from ..functions.vectors import deterministic_embedding

BATCH, IN_FLIGHT, RETRIES, FIRST_WAIT, LONGEST_WAIT = 100, 4, 4, 1.0, 30.0


class Embedder(Protocol):
    def column(self, text: Column) -> Column: ...

    def one(self, text: str) -> list[float]: ...


class DeterministicEmbedder:
    """No model: an expression of the text's code points."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def column(self, text: Column) -> Column:
        return deterministic_embedding(text, self.dim).cast("array<float>")

    def one(self, text: str) -> list[float]:
        base = sum(map(ord, text)) % 97
        return [((base + i) % 17) / 17 for i in range(self.dim)]


def with_retries(call: Callable[[], Any], transient: Callable[[Exception], bool], retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Repeats a call on transient errors, waiting twice as long each time, up to a limit, with jitter."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if attempt == retries or not transient(e):
                raise
            sleep(min(FIRST_WAIT * 2**attempt, LONGEST_WAIT) * (0.5 + random.random()))


def _transient(e: Exception) -> bool:
    code = getattr(e, "code", None) or getattr(e, "status_code", None)  # an HttpError's or a client library's
    return isinstance(e, (TimeoutError, ConnectionError)) or code == 429 or (isinstance(code, int) and code >= 500)


class BatchEmbedder:
    """A function from texts to vectors, called in Arrow batches on the executors, 100 texts at a time, in order.

    Up to ``in_flight`` calls of one worker run at once, and ``pause`` seconds pass between their starts.
    """

    def __init__(self, function: Callable[[Sequence[str]], Sequence[Sequence[float]]], pause: float = 0.2, in_flight: int = IN_FLIGHT):
        self.function, self.pause, self.in_flight = function, pause, in_flight

    def column(self, text: Column) -> Column:
        function, pause, in_flight = self.function, self.pause, self.in_flight

        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            return pd.Series(in_batches(function, list(texts), pause, in_flight))

        return embed(embed_text(text))

    def one(self, text: str) -> list[float]:
        return list(map(float, with_retries(lambda: self.function([text]), _transient)[0]))


def in_batches(function: Callable[[Sequence[str]], Sequence[Sequence[float]]], texts: list[str], pause: float = 0.0, in_flight: int = IN_FLIGHT) -> list[list[float]]:
    """Vectors of texts in their order: ``BATCH`` texts a call, ``in_flight`` calls at once, started ``pause`` apart."""
    gate, last = threading.Lock(), [0.0]

    def call(part: list[str]) -> list[list[float]]:
        with gate:
            wait = last[0] + pause - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            last[0] = time.monotonic()
        got = list(with_retries(lambda: function(part), _transient))
        if len(got) != len(part):
            raise ValueError(f"{len(part)} texts gave {len(got)} vectors")
        return [list(map(float, v)) for v in got]

    with ThreadPoolExecutor(max(1, in_flight)) as pool:
        return [v for part in pool.map(call, [texts[i : i + BATCH] for i in range(0, len(texts), BATCH)]) for v in part]


class HttpError(RuntimeError):
    """A service's answer other than success; ``code`` is its status."""

    def __init__(self, code: int, text: str):
        super().__init__(f"{code}: {text[:200]}")
        self.code = code


def post_json(url: str, body: dict, key: str = "", timeout: float = 30.0) -> dict:
    """Posts JSON and returns the JSON answered."""
    headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
            return json.loads(r.read().decode())
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, e.reason or "") from e
    except urllib.error.URLError as e:
        raise (TimeoutError if isinstance(e.reason, TimeoutError) else ConnectionError)(str(e.reason)) from e


class HttpEmbedder(BatchEmbedder):
    """An embedding service that takes ``{model, input}`` and answers ``{data: [{index, embedding}]}``.

    The key is read from the environment variable named, on the machine that calls, and never sent with the job.
    """

    def __init__(self, url: str, model: str, key_variable: str = "QUILL_API_KEY", timeout: float = 60.0, pause: float = 0.2):
        if not url:
            raise ValueError("an embedding service needs its url")

        def call(texts: Sequence[str]) -> list[list[float]]:
            got = post_json(url, {"model": model, "input": list(texts)}, os.environ.get(key_variable, ""), timeout)["data"]
            return [x["embedding"] for x in sorted(got, key=lambda x: x["index"])]

        super().__init__(call, pause)


class Reranker(Protocol):
    def column(self, query: str, text: Column) -> Column: ...


class LexicalReranker:
    def column(self, query: str, text: Column) -> Column:
        return lexical_overlap(F.lit(query), text)


class PairReranker:
    """A function from (query, texts) to scores, higher for better; scores it doesn't give are 0."""

    def __init__(self, function: Callable[[str, Sequence[str]], Sequence[float] | dict[int, float]]):
        self.function = function

    def column(self, query: str, text: Column) -> Column:
        function = self.function

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            got = function(query, list(texts))
            got = got if isinstance(got, dict) else dict(enumerate(got))
            return pd.Series([float(got.get(i, 0.0)) for i in range(len(texts))])

        return score(text)


class HttpReranker(PairReranker):
    """A rerank service that takes ``{model, query, documents, top_n}`` and answers ``{results: [{index,
    relevance_score}]}``; documents that it leaves out score 0."""

    def __init__(self, url: str, model: str, key_variable: str = "QUILL_API_KEY", timeout: float = 30.0):
        if not url:
            raise ValueError("a rerank service needs its url")

        def call(query: str, texts: Sequence[str]) -> dict[int, float]:
            body = {"model": model, "query": query, "documents": list(texts), "top_n": len(texts)}
            got = with_retries(lambda: post_json(url, body, os.environ.get(key_variable, ""), timeout), _transient)
            return {int(x.get("index", -1)): float(x.get("relevance_score", 0.0)) for x in got.get("results", [])}

        super().__init__(call)


class CrossEncoderReranker(PairReranker):
    """A local cross-encoder, loaded once by each worker; needs the sentence_transformers package."""

    def __init__(self, model: str):
        import importlib.util

        if importlib.util.find_spec("sentence_transformers") is None:
            raise ValueError("this reranker needs the sentence_transformers package")

        def call(query: str, texts: Sequence[str]) -> list[float]:
            if model not in _LOADED:
                from sentence_transformers import CrossEncoder

                _LOADED[model] = CrossEncoder(model)
            return [float(x) for x in _LOADED[model].predict([(query, t) for t in texts])]

        super().__init__(call)


_LOADED: dict[str, Any] = {}


def guided(stubs: DataFrame, instructor: Callable[[dict], tuple[str, str]]) -> DataFrame:
    """Stubs with introduction and instructions of a model, called with a stub's values; where it fails, the templates'."""

    @F.pandas_udf("brief_intro string, instruction string")
    def write(name: pd.Series, intro: pd.Series, how: pd.Series, probe: pd.Series) -> pd.DataFrame:
        out = []
        for n, i, h, p in zip(name, intro, how, probe):
            try:
                a, b = with_retries(lambda n=n, i=i, h=h, p=p: instructor({"filename": n, "brief_intro": i, "instruction": h, "probe": json.loads(p)}), _transient)
                out.append((a or i, b or h))
            except Exception:  # noqa: BLE001  a document without a model's words still has the templates'
                out.append((i, h))
        return pd.DataFrame(out, columns=["brief_intro", "instruction"])

    told = stubs.withColumn("__g", write("filename", "brief_intro", "instruction", "probe_json"))
    return told.withColumns({c: F.col("__g")[c] for c in ("brief_intro", "instruction")}).drop("__g")


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"deterministic": DeterministicEmbedder, "http": HttpEmbedder}
RERANKERS: dict[str, Callable[..., Reranker]] = {"lexical": LexicalReranker, "http": HttpReranker, "cross_encoder": CrossEncoderReranker}


def make(registry: dict[str, Callable], name: str, **kw) -> Any:
    if name not in registry:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name](**kw)


def told(name: str, url: str, model: str) -> dict[str, str]:
    """What a provider is made with, of the settings."""
    return {"http": {"url": url, "model": model}, "cross_encoder": {"model": model}}.get(name, {})


class Adaptor:
    """Hooks; override any."""

    def transform_query(self, query: str) -> str:
        return query

    def on_search_results(self, query: str, results: DataFrame) -> DataFrame:
        return results

    def on_document_indexed(self, doc_id: str, metadata: dict) -> None:
        return None
