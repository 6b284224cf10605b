"""Token ids and token counts of whole text columns under a public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomtrace.llm.bpe import Encoder, Vocabulary

#: Folder of the vocabulary files; a parameter of the queries.
VOCABULARIES = "/opt/tokenizers"

_encoders: dict[str, Encoder] = {}


def _encoder(name: str, shipped) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(shipped.value)
    return _encoders[name]


def _mapped(docs: DataFrame, key: str, text: str, path: str, fields: list[T.StructField], emit):
    # The vocabulary has a fixed size (about 3 MB of arrays), whatever the data: it is broadcast once.
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shipped)
        for batch in batches:
            if batch.num_rows:
                ids, counts = encoder.encode(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), emit(ids, counts)], [key, fields[0].name])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], *fields]))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{VOCABULARIES}/byte_bpe_50k.json") -> DataFrame:
    """``key, ids``: the token ids of each row's text without special tokens, in the row's own task (no shuffle).

    Null and empty texts have an empty list; strings of special tokens in a text are ordinary text. Repeated rows stay.
    Other columns of ``docs`` are neither read nor returned. Very long texts are encoded whole, in parts cut at word borders.
    """

    def lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))

    return _mapped(docs, key, text, path, [T.StructField("ids", T.ArrayType(T.IntegerType()))], lists)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{VOCABULARIES}/byte_bpe_50k.json") -> DataFrame:
    """``key, n_tokens``: how many ids :func:`encode` gives; 0 for null and empty texts."""
    return _mapped(docs, key, text, path, [T.StructField("n_tokens", T.LongType())], lambda ids, counts: pa.array(counts))
