"""Token-id output: documents as ids in rANS containers, and back.

Documents are range-partitioned and sorted by doc_id. Each task encodes its range into shards of
about ``SHARD_IDS`` ids (a longer document makes a longer shard); a shard is one row of a Parquet
table: part, shard, doc_ids, ids per document, and the container (see ``rans``), whose frequency
table is shared by the shard's blocks. The table goes through Spark's committed writer, so a lost
executor or a repeated task never leaves half a file. Readers take shards in parallel; a block or
a checkpoint inside a shard can be decoded on its own.

Defined results: null or empty text has the end id alone; repeated rows and doc_ids are written as
often as they come, in the order of doc_id (null first), then text; an empty table gives an empty
store; extra columns are ignored.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import rans
from riskweave.llm.tokens import Encoder
from riskweave.session import ensure_checkpoint_dir

END_ID = 2
SHARD_IDS = 1 << 20
_SCHEMA = "part int, shard int, doc_ids array<bigint>, counts array<int>, n_ids long, data binary"


def _encode(path: str, end_id: int):
    def run(batches):
        coder, part, shard = Encoder.of(path, end_id), 0, 0
        docs, counts, ids, size = [], [], [], 0

        def close():
            nonlocal docs, counts, ids, size, shard
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([counts], pa.list_(pa.int32())), pa.array([len(flat)], pa.int64()),
                 pa.array([rans.pack(flat)], pa.binary())], ["part", "shard", "doc_ids", "counts", "n_ids", "data"])
            docs, counts, ids, size, shard = [], [], [], 0, shard + 1
            return row

        for batch in batches:
            names, row = batch.column(1).to_pylist(), 0
            if names:
                part = batch.column(0)[0].as_py()
            for run_ids, per_text in coder.encode(batch.column(2)):
                docs += names[row:row + len(per_text)]
                row += len(per_text)
                counts += per_text.tolist()
                ids.append(run_ids)
                size += len(run_ids)
                if size >= SHARD_IDS:
                    yield close()
        if docs:
            yield close()
    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write docs (doc_id, text) as a token store at path; tokenizer: a byte-level BPE file of the tokenizers library."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("text"))
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
     .repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
     .select(F.spark_partition_id().alias("part"), "doc_id", "text")
     .mapInArrow(_encode(tokenizer, end_id), _SCHEMA)
     .write.option("compression", "uncompressed").parquet(path))


def _decode(batches):
    """One shard at a time, whatever number of shards a batch holds."""
    for batch in batches:
        for i in range(batch.num_rows):
            part, shard, doc_ids, counts, n_ids, data = (batch.column(c)[i] for c in range(6))
            ids = rans.Reader(memoryview(data.as_buffer())).ids()
            sizes = counts.values.to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            if len(ids) != n_ids.as_py() or len(ids) != (ends[-1] if len(ends) else 0):
                raise ValueError("a shard's ids do not fit its documents")
            raw, starts, n = memoryview(ids.astype("<u4")).cast("B"), ends - sizes, len(ends)
            crcs = [zlib.crc32(raw[4 * a:4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, shard.as_py(), np.int32)), doc_ids.values, pa.array(starts),
                 pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())], ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the store."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    shards = files.select("part", "shard", "n_ids")
    # offsets: within each part, and over parts (one row per range partition)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    offsets = (shards.withColumn("within", F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids"))
               .join(before_part, "part").select("part", "shard", (F.col("base") + F.col("within")).alias("base")))
    docs = files.mapInArrow(_decode, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to a new store in the session's shared folder and read it back."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer)
    return read_store(docs.sparkSession, path)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the token store."""
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
