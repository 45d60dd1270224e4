"""Token ids in Arrow stream files: fixed-size-list batches of equal-length sequences with masks.

Every shard holds a contiguous range of documents in ascending id order (nulls first, ties by text), each followed by
an end id, packed into sequences of ``length`` ids. A batch has the columns

* ``ids``     fixed_size_list<uint16 or uint32>[length], zero beyond the end of the shard
* ``mask``    fixed_size_list<bool>[length], true where an id is real
* ``starts``  fixed_size_list<bool>[length], true at the first id of a document
* ``doc_ids`` list<id type>, the ids of the documents that start in the sequence

All but ``doc_ids`` have a fixed stride, so sequence k of a batch is a slice of the mapped file, without a copy. Batches
hold ``rows`` sequences each (the last one fewer), so sequence k of a shard is row k % rows of batch k // rows.

A shard is written under a name of its attempt and then renamed, so a task that runs again leaves the same file.
Null and empty texts give just the end id. Repeated rows are kept, one document each. An empty table gives no files.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotloom.llm.bpe import Encoder
from slotloom.llm.store import cut, uri_filesystem
from slotloom.llm.wordstream import Stream

LENGTH, ROWS = 1024, 64


class LibraryWords:
    """Encodes distinct pieces with the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes for special tokens; a text that holds one is encoded whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Only a plain byte-level vocabulary encodes piece by piece; any other normaliser or splitter gets whole texts.
        parts = json.loads(self.tokenizer.to_str())
        split = parts.get("pre_tokenizer") or {}
        self.by_piece = not parts.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)

    def __call__(self, blob: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum(size)
        raw = blob.tobytes()
        words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip((end - size).tolist(), end.tolist())]
        ids = []
        for k in range(0, len(words), 8192):
            ids += [x.ids for x in self.tokenizer.encode_batch_fast(words[k : k + 8192], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)


@functools.lru_cache(2)
def library_encoder(path: str) -> tuple[Encoder, LibraryWords]:
    words = LibraryWords(path)
    return Encoder(words, words.tokenizer.get_vocab_size(), 1 << 19), words


class ShardWriter:
    """Packs ids into sequences and appends batches of them to one Arrow stream file."""

    def __init__(self, uri: str, id_type: pa.DataType, wide: bool, length: int, rows: int):
        self.fs, self.path = uri_filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.length, self.rows, self.kind = length, rows, np.uint32 if wide else np.uint16
        whole = lambda kind: pa.list_(pa.field("item", kind, nullable=False), length)
        self.schema = pa.schema([("ids", whole(pa.from_numpy_dtype(self.kind))), ("mask", whole(pa.bool_())), ("starts", whole(pa.bool_())), ("doc_ids", pa.list_(id_type))])
        self.id_type = id_type
        self.file = self.fs.open_output_stream(self.part)
        self.stream = pa.ipc.new_stream(self.file, self.schema)
        self.ids, self.starts, self.names, self.held, self.total = [], [], [], 0, 0

    def add(self, names: pa.Array, ids: np.ndarray, begin: np.ndarray) -> None:
        """ids of some documents laid end to end; begin: where each one starts."""
        mark = np.zeros(len(ids), bool)
        mark[begin] = True
        self.ids.append(ids.astype(self.kind))
        self.starts.append(mark)
        self.names.append(names)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids, starts = np.concatenate(self.ids), np.concatenate(self.starts)
        names = pa.concat_arrays(self.names) if len(self.names) > 1 else self.names[0]
        step, used = self.length * self.rows, 0
        while len(ids) - used >= step or last and used < len(ids):
            now = min(step, len(ids) - used)
            rows = -(-now // self.length)
            block, mark, mask = np.zeros(rows * self.length, self.kind), np.zeros(rows * self.length, bool), np.zeros(rows * self.length, bool)
            block[:now], mark[:now], mask[:now] = ids[used : used + now], starts[used : used + now], True
            each = np.concatenate([[0], np.cumsum(mark.reshape(rows, self.length).sum(1))])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(i).type) for i, x in enumerate((block, mask, mark))]
            columns.append(pa.ListArray.from_arrays(pa.array(each, pa.int32()), names.slice(0, int(each[-1]))))
            self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            names = names.slice(int(each[-1]))
            used += now
        self.ids, self.starts, self.names, self.held = [ids[used:]], [starts[used:]], [names], len(ids) - used

    def close(self) -> None:
        if self.held:
            self._flush(True)
        self.stream.close()
        self.file.close()
        self.fs.move(self.part, self.path)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, rows: int = ROWS, shards: int | None = None) -> DataFrame:
    """Writes shards below ``folder`` (a URI that all machines share); returns shard, path, n_docs, n_ids."""
    spark = docs.sparkSession
    arrow_id = pa.int64() if isinstance(docs.schema[id_col].dataType, T.LongType) else pa.string()
    kept = docs.select(F.col(id_col).cast("bigint" if arrow_id == pa.int64() else "string").alias("id"), F.col(text_col).alias("text"))
    # Ties go by text, so an id that many texts share is dealt over shards by how these begin.
    by = (F.col("id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first())
    dealt = kept.repartitionByRange(shards, *by) if shards else kept.repartitionByRange(*by)
    dealt = dealt.sortWithinPartitions(by[0], F.col("text").asc_nulls_first()).select(F.spark_partition_id().alias("shard"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, library = library_encoder(vocabulary)
        wide = library.tokenizer.get_vocab_size() > 1 << 16
        out = shard = None
        n_docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                shard = batch.column(0)[0].as_py()
                out = ShardWriter(f"{folder}/shard-{shard:06d}.arrows", arrow_id, wide, length, rows)
            texts = [t or "" for t in batch.column(2).to_pylist()]
            special = {i: library.whole(t) for i, t in enumerate(texts) if not library.by_piece or any(x in t for x in library.special)}
            plain = ["" if i in special else t for i, t in enumerate(texts)]
            for lo, hi, ids, at in encode(plain):
                own = np.diff(at)
                if any(lo <= i < hi for i in special):
                    parts = [special.get(lo + i, ids[a:b]) for i, (a, b) in enumerate(zip(at[:-1], at[1:]))]
                    ids, own = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
                ends = np.cumsum(own + 1)
                all_ids = np.empty(int(ends[-1]), np.int64)
                mark = np.ones(len(all_ids), bool)
                mark[ends - 1] = False
                all_ids[mark], all_ids[ends - 1] = ids, end_id
                out.add(batch.column(1).slice(lo, hi - lo), all_ids, ends - own - 1)
            n_docs += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.arrows"], "n_docs": [n_docs], "n_ids": [out.total]}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    written = dealt.mapInArrow(run, "shard int, path string, n_docs bigint, n_ids bigint")
    return cut(written, "token-shards")


def open_shard(uri: str):
    """A stream reader over a mapped local file, or over an input file of another store."""
    fs, path = uri_filesystem(uri)
    local = getattr(fs, "type_name", "") == "local"
    return pa.ipc.open_stream(pa.memory_map(path) if local else fs.open_input_file(path))


def sequences(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(ids, mask, starts, doc ids) of each batch of a shard; ids is a view of the file, rows x length."""
    for batch in open_shard(uri):
        n = batch.schema.field("ids").type.list_size
        flat = lambda k, copy: batch.column(k).flatten().to_numpy(zero_copy_only=not copy).reshape(-1, n)
        yield flat(0, False), flat(1, True), flat(2, True), batch.column(3).flatten()


def read_documents(shards: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, shard, start in the shard, n_tokens and ids_crc32 (ids as little-endian unsigned 32-bit integers) of
    every document, from the files alone. A document may span sequences and batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64() if id_type == "bigint" else pa.string()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, start, size, crc, position = [], [], [], [], 0
                for ids, mask, starts, doc_ids in sequences(path):
                    flat = ids.reshape(-1)[: int(mask.sum())].astype("<u4")
                    begin = np.flatnonzero(starts.reshape(-1))
                    cuts = [0, *begin.tolist(), len(flat)]
                    if crc and cuts[1] > 0:  # goes on from the batch before
                        crc[-1] = zlib.crc32(flat[: cuts[1]].tobytes(), crc[-1])
                        size[-1] += cuts[1]
                    if len(start) > 50_000:
                        keep = len(start) - 1
                        yield pa.RecordBatch.from_arrays([pa.array(names[:keep], schema.field(0).type), pa.array([shard] * keep, pa.int32()), pa.array(start[:keep], pa.int64()), pa.array(size[:keep], pa.int64()), pa.array(crc[:keep], pa.int64())], schema=schema)
                        names, start, size, crc = names[keep:], start[keep:], size[keep:], crc[keep:]
                    names += doc_ids.to_pylist()
                    for a, b in zip(cuts[1:-1], cuts[2:]):
                        start.append(position + a)
                        size.append(b - a)
                        crc.append(zlib.crc32(flat[a:b].tobytes()))
                    position += len(flat)
                yield pa.RecordBatch.from_arrays([pa.array(names, schema.field(0).type), pa.array([shard] * len(start), pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return shards.select("shard", "path").mapInArrow(run, f"doc_id {id_type}, shard int, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_index(shards: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Documents of all shards with their start among all ids. The window runs over one row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(1, shards.count())  # one row a shard; spread so that each is read by a task of its own
    return read_documents(shards.repartition(n, "shard"), id_type).join(F.broadcast(base), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
