"""Sizes of texts in tokens of a public tokenizer, read from a given folder."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer files; a parameter of every operator that counts tokens.
FOLDER = os.environ.get("GLOSSWEAVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a file of ranks, loaded once in each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def sizes(docs: DataFrame, text: str, keep: list[str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``tokens`` of every row, over the whole text; a null or empty text has 0 tokens. Strings of special tokens in a
    text are ordinary text. Columns not named in ``keep`` are left out."""
    path = f"{folder.rstrip('/')}/{vocabulary}"
    docs.sparkSession.sparkContext.addFile(path)  # workers need not have the folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        enc = encoding(SparkFiles.get(vocabulary))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], schema=pa.schema([*list(b.schema)[:-1], pa.field("tokens", pa.int32())]))

    src = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, tokens int")
