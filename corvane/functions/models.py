"""Models as Arrow user-defined functions. The defaults are deterministic and need no model files."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64


def hashed_words(texts: list[str]) -> list[list[float]]:
    """The default embedder: a text's words hashed into signed counts, scaled to length one."""
    import zlib

    import numpy as np

    out = []
    for text in texts:
        v = np.zeros(DIMENSIONS)
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            v[h % DIMENSIONS] += 1 if h & 0x80000000 else -1
        out.append((v / (np.linalg.norm(v) or 1)).tolist())
    return out


def model_function(result: str, model: Callable[[], Callable[[list[str]], list]], batch: int = 64):
    """A function of a text column, with values of the type `result`, from a loader of a model; it is loaded once a task, batches are bounded.

    A batch that fails is tried row by row, so that one row can't cost the others: its value is null.
    """

    @F.pandas_udf(result)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        apply = model()
        for texts in parts:
            out: list = []
            values = [t or "" for t in texts]
            for i in range(0, len(values), batch):
                try:
                    out += apply(values[i : i + batch])
                except Exception:
                    for value in values[i : i + batch]:
                        try:
                            out += apply([value])
                        except Exception:
                            out.append(None)
            yield pd.Series(out, index=texts.index)

    return run


def embedder(model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64):
    """Vectors of texts."""
    return model_function("array<double>", model, batch)


def recogniser(model: Callable[[], Callable[[list[str]], list[list[dict]]]], batch: int = 16):
    """Entities of texts, as arrays of name, type and score."""
    return model_function("array<struct<name:string,type:string,score:double>>", model, batch)


def classifier(model: Callable[[], Callable[[list[str]], list[float]]], batch: int = 64):
    """Scores of texts, such as how likely one is an injection."""
    return model_function("double", model, batch)


def rewriter(model: Callable[[], Callable[[list[str]], list[str]]] = lambda: list, batch: int = 16):
    """Rewritten texts, such as reformulated queries or refactored documents; without a model the texts themselves, as where a rewrite fails."""
    write = model_function("string", model, batch)
    return lambda text: F.coalesce(write(text), text)


def remembered(encode: Callable[[list[str]], list[list[float]]], most: int = 128) -> Callable[[list[str]], list[list[float]]]:
    """encode that keeps the vectors of the last `most` texts asked for: queries repeat."""
    kept: OrderedDict[str, list[float]] = OrderedDict()

    def run(texts: list[str]) -> list[list[float]]:
        found = {t: kept[t] for t in texts if t in kept}
        fresh = [t for t in dict.fromkeys(texts) if t not in found]
        found |= dict(zip(fresh, encode(fresh), strict=True)) if fresh else {}
        for t in texts:
            kept[t] = found[t]
            kept.move_to_end(t)
        while len(kept) > most:
            kept.popitem(last=False)
        return [found[t] for t in texts]

    return run


def embed_query(text: Column) -> Column:
    return embedder(lambda: remembered(hashed_words))(text)


def embed(text: Column) -> Column:
    return embedder(lambda: hashed_words)(text)


def reranker(model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 32):
    """A function of a query and a text column that gives a logit."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = model()
        for asked, texts in parts:
            pairs = list(zip(asked.fillna(""), texts.fillna(""), strict=True))
            yield pd.Series([s for i in range(0, len(pairs), batch) for s in score(pairs[i : i + batch])], index=asked.index)

    return run
