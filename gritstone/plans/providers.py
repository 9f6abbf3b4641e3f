"""What the engine asks of models and of time, as protocols, with defaults that need no network and always agree.

A provider is made on each executor by ``make`` and called with whole batches; results come back as columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row a text. Raises TooLong for a text beyond the model's window."""


class Judge(Protocol):
    def score(self, texts: list[str]) -> np.ndarray:
        """0 to 1 a text."""

    def topics(self, texts: list[str]) -> list[list[str]]:
        """Topics a text, best first."""


class Clock(Protocol):
    def now(self) -> Column:
        """The time that rows of one run carry."""


class TooLong(ValueError):
    pass


# Tries of a text that is too long, the share that is kept for the next, the least length worth a try, the
# fields of a record that may stand for it, in order, and the most characters of it.
TRIES, KEEP, LEAST = 3, 0.7, 100
FIELDS, MOST = ("hdd_content", "parsed_summary", "claim_text", "raw_text"), 8_000
TOPICS = 3


class WordEmbedder:
    """Counts of words by first letter and length, scaled to unit length; ``window`` is the longest text it takes."""

    def __init__(self, dimensions: int = 16, window: int = 1_000_000):
        self.dimensions, self.window = dimensions, window

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            if len(t) > self.window:
                raise TooLong(f"{len(t)} characters")
            for w in t.lower().split(" "):
                if w:
                    out[i, (31 * ord(w[0]) + len(w)) % self.dimensions] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


class KeywordJudge:
    """Topics whose last part stands in the text; the score is the share of known topics that do."""

    def __init__(self, known: list[str]):
        self.known = known

    def topics(self, texts: list[str]) -> list[list[str]]:
        return [[t for t in self.known if t.rsplit("/", 1)[-1].lower() in x.lower()] for x in texts]

    def score(self, texts: list[str]) -> np.ndarray:
        return np.array([len(t) for t in self.topics(texts)]) / max(1, len(self.known))


class FixedClock:
    def __init__(self, at: str):
        self.at = at

    def now(self) -> Column:
        return F.to_timestamp(F.lit(self.at))


def embed_one(model: Embedder, text: str) -> np.ndarray | None:
    """A text beyond the window is cut and tried again; None if it stays too long."""
    for _ in range(TRIES):
        try:
            return model.embed([text])[0]
        except TooLong:
            n = int(len(text) * KEEP)
            if n < LEAST:
                return None
            text = text[:n]
    return None


def embedded(text: Column, make: Callable[[], Embedder], batch: int = 256) -> Column:
    """The vector of a text, in batches; null for null texts and for those that no cut makes short enough."""

    def load():
        model = make()

        def predict(texts: np.ndarray) -> np.ndarray:
            own = [str(t) for t in texts]
            try:
                return model.embed(own)
            except TooLong:  # one by one, as long ones are cut
                rows = [embed_one(model, t) for t in own]
                return np.stack([np.full(model.dimensions, np.nan) if r is None else r for r in rows])

        return predict

    vector = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch)(F.coalesce(text, F.lit("")))
    return F.when(text.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)), vector)


def embed_text(columns: list[str]) -> Column:
    """The text that stands for a record: the first of four fields that is not empty, else all fields by name."""
    cut = lambda c: F.substring(c, 1, MOST)
    first = [F.when(F.col(c) != "", cut(F.col(c))) for c in FIELDS if c in columns]
    parts = [F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns if not c.startswith("_") and c != "embedding"]
    whole = F.array_join(F.array_compact(F.array(*parts)), " | ") if parts else F.lit("")
    return F.coalesce(*first, F.when(whole != "", cut(whole)), F.lit("(empty)"))


def topics(text: Column, make: Callable[[], Judge]) -> Column:
    """At most three topics of a question, of those with a hierarchy; none if the provider fails."""

    def load():
        judge = make()

        def predict(texts: np.ndarray) -> np.ndarray:
            try:
                found = judge.topics([str(t) for t in texts])
            except Exception:  # a question without topics is answered by the fallback
                found = [[] for _ in texts]
            best = [[t for t in own if isinstance(t, str) and "/" in t][:TOPICS] for own in found]
            return np.array([own + [""] * (TOPICS - len(own)) for own in best], dtype=object)

        return predict

    padded = predict_batch_udf(load, return_type=ArrayType(StringType()), batch_size=64)(F.coalesce(text, F.lit("")))
    return F.filter(padded, lambda t: t != "")


def grounding_prompt(mode: str, claims: list[tuple[str, str]], rules: dict[str, str]) -> str:
    """Instructions for an answer, with the claims (id, statement) that it may use; ``rules`` has the text of the
    strict and of the hybrid mode, any other mode is hybrid, and ``free`` has no instructions."""
    if mode == "free":
        return ""
    listed = "".join(f"  - claim_id: {i or f'unknown_{n}'} | statement: {s or ''}\n" for n, (i, s) in enumerate(claims))
    return f"{rules['strict' if mode == 'strict' else 'hybrid']}\n{listed}"
