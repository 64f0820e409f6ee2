"""Token-id files with fixed-width bit packing.

A file row is a run of whole documents in id order.  Its ids are stored with the fewest
bits that hold the vocabulary, in blocks of a fixed number of ids; a block begins at a
whole byte, and ``block_offsets`` gives that byte.  Any range of ids can be read by
unpacking only the blocks it touches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.common import id_text

from panelloom.llm.word_tokens import word_tokenizer
from panelloom.sources.shared import shared_folder

BLOCK_IDS = 1024
# A row is closed once it holds so many ids; one document is never divided.
ROW_IDS = 1 << 17
FILE_SCHEMA = (
    "part int, row int, width int, n_ids long, doc_ids array<long>, doc_starts array<long>, "
    "n_bytes array<long>, block_offsets array<long>, payload binary"
)


def width_of(vocabulary: int) -> int:
    """Bits that hold ids below ``vocabulary``; 1 at least."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """Packed ids (lowest bit first) and the byte offset of each block, the end included."""
    blocks = -(-len(ids) // BLOCK_IDS)
    offsets = np.minimum(np.arange(blocks + 1) * BLOCK_IDS, len(ids))
    offsets = (offsets * width + 7) // 8
    if width == 16:
        return ids.astype("<u2").tobytes(), offsets
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), offsets


def unpack(
    payload: bytes, width: int, n_ids: int, offsets: np.ndarray, start: int, stop: int
) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a row; only the blocks that hold them are unpacked."""
    stop = min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // BLOCK_IDS, -(-stop // BLOCK_IDS)
    raw = np.frombuffer(
        payload, np.uint8, int(offsets[last]) - int(offsets[first]), int(offsets[first])
    )
    n = min(last * BLOCK_IDS, n_ids) - first * BLOCK_IDS
    if width == 16:
        ids = raw.view("<u2")[:n].astype(np.uint32)
    else:
        bits = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
        ids = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    return ids[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]


def write_ids(
    docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode whole texts, append ``end_id`` to each and write the files below ``path``.

    Documents are range-partitioned by id, so part n holds smaller ids than part n + 1.
    Null texts count as empty.  Rows without an id come first; rows that share an id stand
    side by side, ordered by a hash of their text.  Other columns are not read.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"),
    )
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = (
        slim.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select(F.spark_partition_id().alias("part"), id_text("doc_id").alias("doc_id"), "text", "size")
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = word_tokenizer(vocabulary)
        width = width_of(max(tokenizer.vocabulary, (end_id or 0) + 1))
        tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        rows, held, part, row = [], 0, 0, 0

        def close() -> pd.DataFrame:
            lengths = np.array([len(ids) for _, ids, _ in rows], np.int64)
            payload, offsets = pack(np.concatenate([ids for _, ids, _ in rows]), width)
            return pd.DataFrame(
                {
                    "part": [part], "row": [row], "width": [width],
                    "n_ids": [int(lengths.sum())],
                    "doc_ids": [[d for d, _, _ in rows]],
                    "doc_starts": [np.concatenate([[0], np.cumsum(lengths)])],
                    "n_bytes": [[b for _, _, b in rows]],
                    "block_offsets": [offsets],
                    "payload": [payload],
                }
            )

        for batch in batches:
            encoded = tokenizer.encode_all(batch["text"].tolist())
            for p, d, size, ids in zip(
                batch["part"], batch["doc_id"], batch["size"].tolist(), encoded, strict=True
            ):
                part = int(p)
                ids = np.concatenate([ids, tail])
                rows.append((None if d is None else int(d), ids, size))
                held += len(ids)
                if held >= ROW_IDS:
                    yield close()
                    rows, held, row = [], 0, row + 1
        if rows:
            yield close()

    ranged.mapInPandas(encode, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """The file rows below ``path``."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document of the files, unpacked: doc_id, start (ids before it in all
    files), n_bytes, n_tokens, ids_crc32 (over little-endian unsigned 32-bit ids)."""
    totals = files.groupBy("part", "row").agg(F.sum("n_ids").alias("_n"))
    parts = totals.groupBy("part").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part"))
    # Rows of one part are few: a part is a bounded range of documents.
    inside = (
        Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = totals.select(
        "part", "row", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_row")
    )

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = unpack(
                    r.payload, r.width, r.n_ids, np.asarray(r.block_offsets), 0, r.n_ids
                ).astype("<u4")
                starts = np.asarray(r.doc_starts, np.int64)
                yield pd.DataFrame(
                    {
                        "part": r.part,
                        "row": r.row,
                        "doc_id": r.doc_ids,
                        "local": starts[:-1],
                        "n_bytes": np.asarray(r.n_bytes, np.int64),
                        "n_tokens": np.diff(starts),
                        "ids_crc32": [
                            zlib.crc32(ids[a:b].tobytes())
                            for a, b in zip(starts[:-1], starts[1:], strict=True)
                        ],
                    }
                )

    schema = (
        "part int, row int, doc_id string, local long, n_bytes long, n_tokens long, "
        "ids_crc32 long"
    )
    return (
        files.withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))
        .mapInPandas(documents, schema)
        .join(rows, ["part", "row"])
        .join(parts, "part")
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.col("_part") + F.col("_row") + F.col("local")).alias("start"),
            "n_bytes",
            "n_tokens",
            "ids_crc32",
        )
    )


def packed_documents(
    docs: DataFrame, vocabulary: str, end_id: int | None = None
) -> DataFrame:
    """Write ``docs`` to packed files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/packed_ids"
    write_ids(docs, path, vocabulary, end_id)
    return read_documents(read_ids(spark, path))
