"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.session import cut_lineage, fresh_path, ship_package  # noqa: F401  (re-exported for the operators)

TEXTS_AT_ONCE = 1000
#: Rows with this remainder of crc32(doc_id as text) mod 4 are never learned from.
HELD_OUT = 2


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for rows kept back from training; a null id counts as held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 4 == HELD_OUT, F.lit(True))


def per_text(df: DataFrame, make: Callable[[list], dict[str, list]], schema: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Map whole texts through ``make`` (list of texts to named value lists), batch by batch.

    Only the kept columns and the text travel to Python.  ``schema`` names what
    ``make`` returns; kept columns come first and keep their values.
    """
    keep = ["doc_id"] if keep is None else keep
    source = df.select(*keep, F.col(text).alias("_wardscope_text"))
    out = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for whole in batches:
            # few texts at a time are Python strings
            for batch in (whole.slice(k, TEXTS_AT_ONCE) for k in range(0, whole.num_rows, TEXTS_AT_ONCE)):
                made = make(batch.column(len(keep)).to_pylist())
                arrays = [batch.column(k) for k in range(len(keep))]
                types = types or arrow_types(schema)
                for name, values in made.items():
                    arrays.append(pa.array(values, type=types[name]))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])

    return source.mapInArrow(run, out)


def arrow_types(schema: str) -> dict[str, pa.DataType]:
    """Arrow types of a flat ``name type, ...`` schema."""
    plain = {
        "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
        "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string()),
    }
    return {part.split()[0]: plain[part.split()[1]] for part in schema.split(", ")}


def crc_of_ids(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def u32(values) -> bytes:
    return np.asarray(values, dtype="<u4").tobytes()
