"""Token ids as flat unsigned integer files with 64-bit document offsets (operator 2).

Layout of a dataset folder: for each shard ``NNNNN.bin`` (ids, unsigned 16 or 32 bits, little
endian), ``NNNNN.off`` (64-bit offsets into the shard, one more than documents) and
``NNNNN.doc`` (64-bit document ids), and one ``index.json`` with each shard's first token and
first document, prefix sums over the shards' sizes. Every reader memory-maps the shards.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, local_path, new_path, open_store, schema, small_batches, table
from .encoder import encoder

#: The least 64-bit number: a null doc_id in the files.
NO_ID = -(1 << 63)
META = "shard long, n_docs long, n_tokens long, name string"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _writer(uri: str, path: str, keeps_space: bool, end_id: int, width: str):
    """Encodes the sorted rows of a partition into one shard; returns what the index needs."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, folder = open_store(uri)
        # A retried or speculative attempt writes files of its own; the index names the one that counts.
        name = f"{shard:05d}-{uuid.uuid4().hex[:12]}"
        code, end = encoder(path, keeps_space), np.asarray([end_id], "<u4").tobytes()
        offsets, docs, total, rows = [np.zeros(1, "<u8")], [], 0, 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or store.open_output_stream(f"{folder}/{name}.bin")
            ids = [x + end for x in code.encode(batch.column(1).to_pylist())]
            if width == "<u2" and max(np.frombuffer(x, "<u4").max() for x in ids) >= 1 << 16:
                raise ValueError("an id needs more than 16 bits: give the tokenizer's vocabulary size")
            sizes = np.fromiter(map(len, ids), "<u8", len(ids)) // 4
            offsets.append(total + np.cumsum(sizes, dtype="<u8"))
            docs.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
            total, rows = total + int(sizes.sum()), rows + len(ids)
            out.write(np.frombuffer(b"".join(ids), "<u4").astype(width).tobytes())
        if not rows:
            return
        out.close()
        for suffix, parts in (("off", offsets), ("doc", docs)):
            with store.open_output_stream(f"{folder}/{name}.{suffix}") as f:
                f.write(np.concatenate(parts).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [rows], "n_tokens": [total], "name": [name]})

    return write


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, *, keeps_space: bool = True, end_id: int = 0, vocab: int = 50257, shards: int | None = None) -> list[dict]:
    """Write the ids of all ``docs(doc_id, text)`` in ascending doc_id order; returns the index.

    Null texts count as empty, each document ends with ``end_id``, rows with one doc_id stay side
    by side (in the order of their texts), and rows with a null id come first (``NO_ID`` stands
    for it in the files). ``vocab`` sets the width of an id; an id that doesn't fit is an error.
    Only one row per shard comes to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = "<u2" if vocab <= 1 << 16 else "<u4"
    done = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(_writer(uri, tokenizer, keeps_space, end_id, width), schema(META))
    index, token, doc = [], 0, 0
    for r in sorted(done.collect(), key=lambda r: r.shard):
        index.append({"name": r.name, "first_token": token, "first_doc": doc, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "dtype": width})
        token, doc = token + r.n_tokens, doc + r.n_docs
    store, folder = open_store(uri)
    with store.open_output_stream(f"{folder}/index.json") as f:
        f.write(json.dumps(index).encode())
    return index


def read_index(uri: str) -> list[dict]:
    """The shards of a dataset in order."""
    store, folder = open_store(uri)
    with store.open_input_stream(f"{folder}/index.json") as f:
        return json.loads(f.read())


def map_shard(uri: str, entry: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memory-mapped (ids, offsets, doc ids) of a shard; one from another store is fetched first.

    The copy's files are unlinked once they are mapped, so they go with the arrays.
    """
    names = [f"{entry['name']}.{s}" for s in ("bin", "off", "doc")]
    folder = fetched = local_path(uri)
    if folder is None:
        store, far = open_store(uri)
        folder = tempfile.mkdtemp(prefix="shard-")
        for x in names:
            with store.open_input_stream(f"{far}/{x}") as src, open(f"{folder}/{x}", "wb") as dst:
                while block := src.read(1 << 22):
                    dst.write(block)
    kinds = (entry["dtype"], "<u8", "<i8")
    out = tuple(np.memmap(f"{folder}/{x}", d, "r") if os.path.getsize(f"{folder}/{x}") else np.zeros(0, d) for x, d in zip(names, kinds, strict=True))
    if fetched is None:
        shutil.rmtree(folder)
    return out


def _reader(uri: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in map(json.loads, batch.column(0).to_pylist()):
                ids, off, docs = map_shard(uri, entry)
                for a in range(0, len(docs), 4096):
                    part = off[a : a + 4097].astype(np.int64)
                    sums = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(part, part[1:], strict=False)]
                    own = np.asarray(docs[a : a + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(part[:-1] + entry["first_token"]), pa.array(np.diff(part)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the memory-mapped files."""
    index = read_index(uri)
    if not index:
        return spark.createDataFrame([], schema(ROWS))
    shards = spark.createDataFrame([(json.dumps(x),) for x in index], "entry string").repartition(len(index))
    return shards.mapInArrow(_reader(uri), schema(ROWS))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by byte_bpe_50k with end id 0, written, read back and summed up."""
    import public_tokenizers

    uri = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), uri, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, uri)
