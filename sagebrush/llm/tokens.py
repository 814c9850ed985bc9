"""Token counts from flat, unindexed token files, by a separator scan.

Documents are encoded and written one after the other, each followed by the end-of-document id, as little-endian
16-bit (or 32-bit) ids. The files have no index. They are cut into blocks of fixed size; in each block a vectorised
search finds the separators and gives the tokens before the first, between neighbours, and after the last. A prefix
scan over the blocks of a file carries the open document from block to block and numbers the documents.

A file's name holds the task and its attempt; only attempts whose manifest was committed are read, so that a lost
executor leaves no wrong file behind it. Null and empty texts have no tokens. Very long texts are encoded
whole; their tokens may fill any number of blocks. Repeated rows are counted one by one, there are no ties. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_path, open_fs, scratch, session, stored

RANKS, EOD = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 50256
BLOCK_BYTES, TASK_BYTES = 8 << 20, 128 << 20
#: The split pattern of the rank file's tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(ranks: str = RANKS):
    """The tokenizer of a rank file; a worker reads it once."""
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str, ranks: str = RANKS) -> list[int]:
    return encoding(ranks).encode_ordinary(text)


def _packer(folder: str, ranks: str, eod: int, width: int):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        kind, enc, nth = np.dtype(f"<u{width}"), encoding(ranks), 0
        end = np.array([eod], kind).tobytes()
        with fs.open_output_stream(join_path(base, name)) as out:
            for batch in batches:
                sizes = []
                for text in batch.column(1).to_pylist():
                    data = np.array(enc.encode_ordinary(text), kind).tobytes() if text else b""
                    out.write(data + end)
                    sizes.append(len(data) + width)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(nth, nth + n), pa.int64()), batch.column(0), pa.array(sizes, pa.int64())], ["file", "nth", "doc_id", "bytes"])
                nth += n

    return run


def pack(docs: DataFrame, folder: str | None = None, ranks: str = RANKS, eod: int = EOD, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Writes the token files; gives their folder and the manifest (file, nth, doc_id): which document came when."""
    spark = session(docs)
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return folder, stored(rows.mapInArrow(_packer(folder, ranks, eod, width), "file string, nth long, doc_id long, bytes long"), "manifest")


def _scanner(folder: str, eod: int, width: int):
    def run(batches):
        fs, base = open_fs(folder)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                with fs.open_input_file(join_path(base, x["file"])) as file:
                    ids = np.frombuffer(file.read_at(x["length"], x["offset"]), np.dtype(f"<u{width}"))
                at = np.flatnonzero(ids == eod)
                first, last = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (len(ids), len(ids))
                out.append({"file": x["file"], "block": x["block"], "seps": len(at), "head": first, "inner": (np.diff(at) - 1).tolist(), "tail": last})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("seps", pa.int64()), ("head", pa.int64()), ("inner", pa.list_(pa.int64())), ("tail", pa.int64())]))

    return run


def scan(files: DataFrame, folder: str, eod: int = EOD, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, nth, n_tokens) of every document in files (file, bytes).

    Blocks are the unit of work, however large a file is. What a block leaves open (`tail`) is carried to the next
    separator: blocks without one only add to it.
    """
    block_bytes -= block_bytes % width
    last = F.floor((F.col("bytes") - 1) / block_bytes)
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    offset = F.col("block") * block_bytes
    blocks = blocks.select("file", "block", offset.alias("offset"), F.least(F.lit(block_bytes), F.col("bytes") - offset).alias("length"))
    size = files.agg(F.sum("bytes")).first()[0] or 0
    # as many tasks as there are blocks, up to two a core, and no more than `TASK_BYTES` in one
    n = max(1, min(-(-size // block_bytes), 2 * files.sparkSession.sparkContext.defaultParallelism), -(-size // TASK_BYTES))
    found = blocks.repartition(n, "file", "block").mapInArrow(_scanner(folder, eod, width), "file string, block long, seps long, head long, inner array<bigint>, tail long")
    by = Window.partitionBy("file").orderBy("block")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("base", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    # rows of one run: the block with its last separator is in the run before, so its tail opens this one
    opened = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("tail").over(opened), F.lit(0))
    closed = F.coalesce(F.max(F.when(F.col("seps") > 0, F.col("upto"))).over(opened), F.lit(0))
    found = found.withColumn("upto", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    found = found.withColumn("carry", total - closed)
    docs = found.where("seps > 0").select("file", "base", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).alias("k", "n_tokens"))
    return docs.select("file", (F.col("base") + F.col("k")).alias("nth"), "n_tokens")


def token_counts(docs: DataFrame, ranks: str = RANKS, eod: int = EOD, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, file, nth): packs the documents, then counts by scanning the files."""
    folder, manifest = pack(docs, None, ranks, eod, width)
    files = manifest.groupBy("file").agg(F.sum("bytes").alias("bytes"))
    counts = scan(files, folder, eod, width, block_bytes)
    # the manifest packs well on disk and grows with the documents: never broadcast it
    return manifest.hint("merge").join(counts, ["file", "nth"]).select("doc_id", "n_tokens", "file", "nth")
