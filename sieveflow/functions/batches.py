"""Batches of texts cut to a bounded size before a task's Python looks at them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows and characters of texts that a task's Python holds the results of at a time; one longer text is a piece of its own.
ROWS, CHARS = 1000, 1 << 20

Run = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def cuts(sizes: list[int], rows: int = ROWS, chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """(begin, end) of pieces of at most so many rows and, beyond one row, of such a size together; one empty piece of nothing."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin >= rows or held + n > chars):
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes) or not sizes:
        yield begin, len(sizes)


def pieces(batch: pd.DataFrame, text: str | None = None, rows: int = ROWS, chars: int = CHARS) -> Iterator[pd.DataFrame]:
    """A batch in order, in pieces of at most so many rows, and of so many characters of column ``text``."""
    sizes = batch[text].map(lambda t: len(t) if isinstance(t, str) else 0).tolist() if text else [0] * len(batch)
    for begin, end in cuts(sizes, rows, chars):
        yield batch.iloc[begin:end]


def arrow_pieces(batch: pa.RecordBatch, text: str, rows: int = ROWS, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """The same of an Arrow batch, by bytes of the text; nothing is copied."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    for begin, end in cuts(sizes, rows, chars):
        yield batch.slice(begin, end - begin)


def in_pieces(df: DataFrame, run: Run, schema: str, text: str | None = None) -> DataFrame:
    """``df.mapInPandas(run, schema)`` that hands on results piece by piece, so that what a worker holds doesn't grow with Spark's batches."""
    return df.mapInPandas(lambda batches: run(p for b in batches for p in pieces(b, text)), schema)
