"""Token counts from flat token files by a separator scan.

A token file is what training reads: token ids of a fixed width one after another, an end-of-document id behind each
document, no index. The scan cuts files into blocks of bytes, whatever documents they cut through; each task reads one
block by its range and finds the separators with one vectorised comparison. A prefix scan over the blocks' summaries (a
window over a few numbers for each block) tells how many documents ended before a block and how many tokens the document
that runs into it has had; with it each block's lengths become those of whole documents.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Bpe
from .bpe import encoder as encoder_of_runs
from .files import file_size, filesystem, read_range, write_once
from .shared import fresh_path, only, written

#: How texts are cut before byte-pair merges (a fixed value of the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class TokenFormat:
    """ids of width bytes (little endian), end behind each document; blocks of block_bytes, files of about file_bytes.

    The vocabulary file must be at the same path on every executor, or in a store that all of them reach."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    width: int = 2
    end: int = 50256
    block_bytes: int = 4 << 20
    file_bytes: int = 64 << 20

    @property
    def kind(self) -> str:
        return f"<u{self.width}"


@cache
def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file of byte-pair ranks; loaded once in each Python worker."""
    import tiktoken

    store, inner = filesystem(vocabulary)
    with store.open_input_stream(inner) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The library's pattern overflows its stack on some hundred thousand white-space characters in a row; a text that has
#: half of that goes through the transducer, which gives the same ids in bounded memory.
LONG_RUN = 100_000
_SPACES = re.compile(r"\s+")


def encoded(text: str | None, form: TokenFormat) -> np.ndarray:
    if not text:
        return np.empty(0, form.kind)
    if len(text) > LONG_RUN and max(map(len, _SPACES.findall(text)), default=0) > LONG_RUN:
        return encoder_of_runs(Bpe(form.vocabulary)).encode(text).astype(form.kind)
    return np.asarray(encoder(form.vocabulary).encode_ordinary(text), form.kind)


def _token_files(folder: str, form: TokenFormat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        ids: list[pa.Array] = []
        total, end = 0, np.asarray([form.end], form.kind).tobytes()

        def close() -> pa.RecordBatch:
            path = write_once(folder, ".tokens", lambda out: [out.write(p) for p in parts])
            n = len(parts)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array([path] * n), pa.array([total] * n, pa.int64()), pa.array(range(n), pa.int64())],
                names=["id", "path", "bytes", "ordinal"])

        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                part = encoded(text, form).tobytes() + end
                parts.append(part)
                ids.append(batch.column("id").slice(i, 1))
                total += len(part)
                if total >= form.file_bytes:
                    yield close()
                    parts, ids, total = [], [], 0
        if parts:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, form: TokenFormat = TokenFormat(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the tokens of docs into flat files; (id, path, bytes, ordinal): where each document went. That table is
    written before any file is read, so that a lost executor cannot lead to other files under the same names."""
    plain = only(docs, id, text).withColumnRenamed(id, "id").withColumnRenamed(text, "text")
    kind = plain.schema["id"].dataType.simpleString()
    return written(plain.mapInArrow(_token_files(folder, form), f"id {kind}, path string, bytes long, ordinal long"), "token-files")


def _blocks(form: TokenFormat):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                data = np.frombuffer(read_range(b.path, int(b.start), int(b.length)), form.kind)
                ends = np.flatnonzero(data == form.end)
                first = int(b.start) // form.width
                yield pd.DataFrame({
                    "path": [b.path], "start": [first], "tokens": [len(data)], "ends": [len(ends)],
                    "after": [first + int(ends[-1]) + 1 if len(ends) else None], "lengths": [np.diff(ends, prepend=-1) - 1],
                }).astype({"after": "Int64"})

    return run


def scan_token_files(files: DataFrame, form: TokenFormat = TokenFormat()) -> DataFrame:
    """(path, ordinal, n_tokens, ended) for each document of files (path, bytes).

    Bytes beyond the last whole id are not read. Tokens behind the last separator are a document that has not ended; a
    file of 0 bytes has none.
    """
    size = F.col("bytes") - F.col("bytes") % form.width
    step = form.block_bytes - form.block_bytes % form.width
    blocks = files.select("path", size.alias("size")).filter("size > 0")
    blocks = blocks.select("path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / step))).alias("block"))
    blocks = blocks.select("path", (F.col("block") * step).alias("start"), F.least(F.lit(step), F.col("size") - F.col("block") * step).alias("length"))
    blocks = blocks.repartition(max(8, files.sparkSession.sparkContext.defaultParallelism * 4))
    found = written(blocks.mapInPandas(
        _blocks(form), "path string, start long, tokens long, ends long, after long, lengths array<long>"), "token-blocks")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("path", "start", "tokens", "ends", "after")
    summary = summary.select(
        "path", "start", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("done"),
        (F.col("start") - F.coalesce(F.max("after").over(before), F.lit(0))).alias("carried"),
    )
    joined = found.join(summary, ["path", "start"])
    whole = joined.select("path", "done", "carried", F.posexplode("lengths").alias("i", "n"))
    whole = whole.select("path", (F.col("done") + F.col("i")).alias("ordinal"),
                         (F.col("n") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = found.groupBy("path").agg(F.sum("tokens").alias("all"), F.sum("ends").alias("ordinal"), F.max("after").alias("after"))
    rest = rest.select("path", "ordinal", (F.col("all") - F.coalesce("after", F.lit(0))).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest.filter("n_tokens > 0"))


def token_files(spark, paths: list[str]) -> DataFrame:
    """(path, bytes) of token files that something else wrote."""
    return spark.createDataFrame([(p, file_size(p)) for p in paths], "path string, bytes long")


def token_report(docs: DataFrame, form: TokenFormat = TokenFormat(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and n_tokens, counted by scanning the flat files that its tokens went to.

    Null and empty texts have 0 tokens. Repeated rows are counted each; null ids stay. Extra columns are dropped; an empty
    table gives no rows.
    """
    placed = write_token_files(docs, fresh_path(docs.sparkSession, "tokens"), form, id, text)
    counts = scan_token_files(placed.select("path", "bytes").distinct(), form)
    joined = placed.drop("bytes").join(counts.select("path", "ordinal", "n_tokens"), ["path", "ordinal"])
    return joined.select(F.col("id").alias(id), "n_tokens")
