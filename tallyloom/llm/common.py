"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are turned into numpy arrays at a time; bounds a worker's memory whatever the batch holds.
SLICE_BYTES = 1 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have (upper and lower case count as one)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """The column of that exact name, whatever characters it holds."""
    return df["`" + name.replace("`", "``") + "`"]


def text_of(df: DataFrame, name: str) -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(col(df, name).cast("string"), F.lit(""))


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ... (Python functions cannot take columns of any name)."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def rows_where(df: DataFrame, text_col: str, judge: Callable[[pa.Array], np.ndarray], most: int = SLICE_BYTES) -> DataFrame:
    """All columns of the rows for whose texts ``judge`` says true; it sees about ``most`` bytes at a time."""
    rows, text = numbered(df), f"c{df.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most):
                yield part.filter(pa.array(judge(part.column(text))))

    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)


def tasks_for(df: DataFrame, least: int = 1) -> int:
    """How many parts an exchange should have: the session's setting, which a cluster sets for its input."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of the texts in them; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offsets of the texts in them."""
    raw, at = byte_view(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, starts[at]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    sizes = byte_view(batch.column(text))[1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
