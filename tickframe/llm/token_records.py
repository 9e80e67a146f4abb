"""Token ids as length-delimited binary records with masked checksums and an offset index.

A record is: payload length (unsigned 64 bit), masked crc32 of these eight
bytes, payload, masked crc32 of the payload, a line feed.  The payload is the
document id (signed 64 bit), a flag for a null id, the bytes per id (2 or 4),
and the ids.  All numbers are little-endian.  Files are written by Spark's text
writer, so its committer handles lost tasks and any file system Spark knows works.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import small_batches
from .words import pieces

SHARD_BYTES = 32 << 20  # text per file; a file is read back by one task
CACHE_CHUNKS, CACHE_PARTS = 900_000, 600_000  # about 150 MB in a Python worker
_HEAD, _KEY = "<QI", "<qBB"
#: The splitting pattern and normalisation for which words can be encoded one by one.
_WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = ["NFC", "Replace", "Lowercase"]
# ASCII and Latin letters from U+00C0 to U+017F, on which this splitting and lower case need no Unicode tables.
_LATIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\s0-9a-zß-öø-ſ]+", re.ASCII)
_BATCH = 20_000
_INDEX = ("file string, doc_id bigint, offset bigint, n_bytes bigint, n_tokens bigint, start_in_file bigint, "
          "ids_crc32 bigint")


def masked(data: bytes) -> int:
    """crc32, rotated and shifted so that a checksum of data holding checksums stays safe."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


class Encoder(dict):
    """Text to id bytes; white-space separated chunks are encoded once and remembered.

    Where the tokenizer splits at white space and treats words alone, as checked in
    its file, the ids of a text are those of its chunks in order, and the ids of a chunk those
    of its letter runs, digits and signs.  New parts of many texts are encoded together and told apart by
    their last ids, which end a word.  Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        steps = [s.get("type") for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        ending = spec["model"].get("end_of_word_suffix")
        self.wordwise = (steps == _STEPS and split.get("pattern") == {"Regex": _WORDWISE} and bool(ending)
                         and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]))
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = bool(ending) and token.endswith(ending)
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, f"<u{self.width}").tobytes()

    def learn(self, parts: list[str]) -> None:
        for k in range(0, len(parts), _BATCH):
            some = parts[k:k + _BATCH]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, f"<u{self.width}")
            end = ((np.flatnonzero(self.last[ids]) + 1) * self.width).tolist()
            if len(end) == len(some):
                raw, at = ids.tobytes(), 0
                for part, to in zip(some, end):
                    self.parts[part] = raw[at:to]
                    at = to
            else:
                self.parts.update((part, self.whole(part)) for part in some)

    def prepare(self, words: list[list[bytes]]) -> None:
        """Make the chunks of all texts known."""
        new = set(filterfalse(self.__contains__, chain.from_iterable(words)))
        if len(self) + len(new) > CACHE_CHUNKS:
            self.clear()
            new = set(chain.from_iterable(words))
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        split, odd = {}, []
        for chunk in new:
            if chunk.isalpha():  # ASCII letters only
                split[chunk] = (chunk.decode().lower(),)
            elif b"<|" not in chunk and (chunk.isascii() or _LATIN.fullmatch(chunk.decode())):  # no special token in it
                split[chunk] = _PARTS.findall(chunk.decode().lower())
            else:
                odd.append(chunk)
        self.learn(list({part for parts in split.values() for part in parts}.difference(self.parts)))
        known = self.parts
        for chunk, parts in split.items():
            self[chunk] = known[parts[0]] if len(parts) == 1 else b"".join([known[part] for part in parts])
        for chunk in odd:
            self[chunk] = self.whole(chunk.decode())

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.wordwise:
            return [self.whole(text.decode()) for text in texts]
        words = [text.split() for text in texts]
        self.prepare(words)
        return [b"".join(map(self.__getitem__, w)) for w in words]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for the life of a Python worker."""
    return Encoder(path)


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload)), b"\n"))


def record_at(data: bytes | memoryview, at: int) -> tuple[memoryview, int]:
    """The checked payload at an offset and the offset of the next record."""
    data = memoryview(data)
    size, check = struct.unpack_from(_HEAD, data, at)
    if masked(bytes(data[at:at + 8])) != check:
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12:at + 12 + size]
    if masked(payload) != struct.unpack_from("<I", data, at + 12 + size)[0]:
        raise ValueError(f"damaged payload at {at}")
    return payload, at + size + 17


def seek_record(handle: BinaryIO, offset: int, n_bytes: int) -> tuple[int | None, np.ndarray]:
    """Read one record by its index entry: (document id, ids)."""
    handle.seek(offset)
    return parse(record_at(handle.read(n_bytes), 0)[0])


def parse(payload: memoryview) -> tuple[int | None, np.ndarray]:
    key, null, width = struct.unpack_from(_KEY, payload)
    return None if null else key, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_KEY))


def _framed(path: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tail = b"" if end is None else np.array([end], f"<u{enc.width}").tobytes()
        for batch in batches:
            for part, data, bounds in pieces(batch):
                raw, out = data.tobytes(), []
                ids = enc.encode([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
                for key, some in zip(part.column(0).to_pylist(), ids):
                    record = frame(struct.pack(_KEY, key or 0, key is None, enc.width) + some + tail)
                    out.append(record[:-1])  # the text writer ends each row with the line feed
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
    return run


def write_records(docs: DataFrame, path: str, tokenizer: str, end: int | None = 2, id_col: str = "doc_id",
                  text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode all texts and write them in ascending id order: part files under ``path``/records.

    A null text counts as empty, and an empty text gets only the end id.  Null ids come first; rows
    with the same id are ordered by text, and equal rows are each written.  Files
    hold ranges of (id, hash of the text), so one repeated id is split as well.  An
    empty table gives no records.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shards = int(total // shard_bytes) + 1
    ordered = (base.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h")
               .sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text"))
    records = ordered.mapInArrow(_framed(tokenizer, end), "record binary")
    with small_batches(docs.sparkSession):
        records.select(F.col("record").cast("string").alias("value")).write.text(f"{path}/records")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data, rows, at, start = content.as_buffer(), [], 0, 0
            while at < len(data):
                payload, after = record_at(data, at)
                key, ids = parse(payload)
                rows.append((name, key, at, after - at, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                at, start = after, start + len(ids)
            if rows:
                names = [c.split()[0] for c in _INDEX.split(", ")]
                kinds = [pa.string()] + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Scan the record files, check them, and write the offset index to ``path``/index.

    One row per record: file, offset and n_bytes for a shuffled read, the number of
    ids, the number of ids before it over all files (start), and the crc32 of the
    ids as unsigned 32-bit integers.
    """
    files = spark.read.format("binaryFile").load(f"{path}/records").where("length > 0")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(name.alias("file"), "content").mapInArrow(_scan, _INDEX)
    found.write.parquet(f"{path}/found")
    found = spark.read.schema(_INDEX).parquet(f"{path}/found")
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("bigint")
    before = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    # one row per file, which holds many megabytes
    sizes = found.groupBy("file").agg(F.sum("n_tokens").alias("all")).select(
        "file", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    index = found.join(sizes, "file").select(
        "doc_id", "file", "offset", "n_bytes", "n_tokens", (F.col("base") + F.col("start_in_file")).alias("start"), "ids_crc32")
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")
