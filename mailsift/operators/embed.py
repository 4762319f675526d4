"""Text embeddings by a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encode = Callable[[list[str]], np.ndarray]


def hashed_projection(dim: int = 64, max_tokens: int | None = None) -> Callable[[], Encode]:
    """The built-in encoder: every token adds +1 or -1 to one of `dim` sums, chosen by its md5; then unit length.

    It reads whole texts unless `max_tokens` says otherwise. It needs no model file, so it stands in where no
    transformer is at hand.
    """

    def load():
        import hashlib
        import re

        import numpy as np

        token = re.compile(r"\w{2,}")
        places: dict[str, tuple[int, float]] = {}

        def place(word: str) -> tuple[int, float]:
            if len(places) > 200_000:
                places.clear()
            if word not in places:
                digest = hashlib.md5(word.encode()).hexdigest()
                places[word] = int(digest[:4], 16) % dim, 1.0 if int(digest[4], 16) < 8 else -1.0
            return places[word]

        def encode(texts):
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                words = token.findall(text.lower())[:max_tokens]
                if words:
                    at, sign = zip(*map(place, words))
                    out[row] = np.bincount(at, weights=sign, minlength=dim)
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return out / np.where(norm == 0, 1.0, norm)

        return encode

    return load


def embed_text(
    df: DataFrame,
    text: str,
    load_encoder: Callable[[], Encode] | None = None,
    batch_size: int = 32,
    out: str = "embedding",
) -> DataFrame:
    """Replace `text` by `out`, an array<float> per row; other columns are kept. NULL text counts as empty.

    `load_encoder` runs once per task, before the first batch, and returns a function from a list of texts to a
    matrix with one row per text. It gets at most `batch_size` texts at a time.
    """
    load = load_encoder or hashed_projection()

    @F.pandas_udf("array<float>")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import pandas as pd

        encode = load()
        for column in columns:
            vectors: list = []
            for start in range(0, len(column), batch_size):
                texts = column.iloc[start : start + batch_size].tolist()
                vectors.extend(np.asarray(encode(texts), dtype="float32"))
            yield pd.Series(vectors, dtype=object)

    # only the text leaves the JVM, other columns stay there
    return df.select(*[c for c in df.columns if c not in (text, out)], run(F.coalesce(F.col(text), F.lit(""))).alias(out))
