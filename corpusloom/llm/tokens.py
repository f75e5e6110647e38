"""Token counts of whole texts with a public byte-level BPE vocabulary, whose name the results carry."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _load(name: str, folder: str | None):
    import public_tokenizers as public
    import tiktoken

    path = f"{folder}/{name}" if folder else public.path(name)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, ident: str, text: str, others: list[str] = (), tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """``(ident, *others, tokens)``; null and empty texts have 0 tokens. The vocabulary is loaded once per task."""
    columns = [ident, *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or _load(tokenizer, folder).encode_ordinary
            n = [len(encode(t)) if t else 0 for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(n, pa.int64())], names=[*columns, "tokens"])

    chosen = df.select(*columns, F.col(text).alias("_text"))
    return chosen.mapInArrow(run, chosen.drop("_text").withColumn("tokens", F.lit(0).cast("bigint")).schema)
