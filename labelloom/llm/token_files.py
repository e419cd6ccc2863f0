"""Token-id files of patched frame-of-reference blocks.

Ids are cut into blocks of 128. Of each block the minimum is subtracted, the
differences are packed at the width that a given percentile of them needs, and
those that need more are kept whole in the block's list of exceptions. A
payload begins with the positions of its blocks, so that any block is read
without the ones before it.

A table of such payloads is a folder of Parquet files: one row is a segment of
whole documents, and shards follow one another in ascending order of
(id, text hash). Spark writes them, so a lost task leaves no half-written
file, and any store that Spark reaches will do.

Null texts are empty: they hold the end id alone. A repeated row is written
each time. A null id sorts first. An empty table gives an empty folder.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 128
MAGIC = b"PFR1"
CACHED_WORDS = 700_000


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Payload of ids below 2**32: magic, count, block starts, blocks."""
    ids = np.asarray(ids, dtype=np.uint32)
    n = len(ids)
    count = -(-n // BLOCK)
    head = MAGIC + np.array([n, count], "<u4").tobytes()
    if not n:
        return head
    v = np.concatenate([ids, np.full(count * BLOCK - n, ids[-1], np.uint32)]).reshape(count, BLOCK)
    low = v.min(axis=1)
    d = v - low[:, None]
    at = np.sort(d, axis=1)[:, int(percentile * (BLOCK - 1))]
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    odd = d.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_odd = odd.sum(axis=1)
    sizes = 6 + (BLOCK // 8) * width + 5 * n_odd
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts + 4] = width
    out[starts + 5] = n_odd
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        kind = "<u2" if w <= 16 else "<u4"
        flat = np.ascontiguousarray(d[rows].astype(kind)).view(np.uint8).reshape(len(rows), BLOCK, -1)
        bits = np.unpackbits(flat, axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(rows), BLOCK * w), axis=1, bitorder="little")
        out[(starts[rows] + 6)[:, None] + np.arange(packed.shape[1])] = packed
    if n_odd.any():
        r, c = np.nonzero(odd)
        rank = np.arange(len(r)) - np.concatenate([[0], np.cumsum(n_odd)[:-1]])[r]
        base = starts[r] + 6 + (BLOCK // 8) * width[r]
        out[base + rank] = c
        values = base + n_odd[r] + 4 * rank
        out[values[:, None] + np.arange(4)] = d[r, c].astype("<u4").view(np.uint8).reshape(-1, 4)
    return head + starts.astype("<u8").tobytes() + out.tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a payload of patched frame-of-reference blocks")
    n, count = np.frombuffer(payload, "<u4", 2, 4).tolist()
    if not n:
        return np.empty(0, np.uint32)
    starts = np.frombuffer(payload, "<u8", count, 12).astype(np.int64)
    raw = np.frombuffer(payload, np.uint8, offset=12 + 8 * count)
    low = np.ascontiguousarray(raw[starts[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    width, n_odd = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    d = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        packed = raw[(starts[rows] + 6)[:, None] + np.arange(BLOCK // 8 * w)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        size = 16 if w <= 16 else 32
        wide = np.zeros((len(rows), BLOCK, size), np.uint8)
        wide[:, :, :w] = bits
        d[rows] = np.packbits(wide, axis=2, bitorder="little").view(f"<u{size // 8}").reshape(len(rows), BLOCK)
    if n_odd.any():
        r = np.repeat(np.arange(count), n_odd)
        rank = np.arange(len(r)) - np.concatenate([[0], np.cumsum(n_odd)[:-1]])[r]
        base = starts[r] + 6 + (BLOCK // 8) * width[r]
        values = base + n_odd[r] + 4 * rank
        d[r, raw[base + rank]] = np.ascontiguousarray(raw[values[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    return (d + low[:, None]).reshape(-1)[:n]


def _byte_letters() -> list[str]:
    """By byte: the letter that stands for it in byte-level vocabularies.

    Printable characters stand for themselves, the others for those from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class _WordIds(dict):
    """Ids of a word as bytes; the library encodes each part of a word once.

    A letter or digit followed by marks is a boundary to the pre-tokeniser, so
    marks at the end are looked up apart. Marks that special tokens end in stay.
    """

    def __init__(self, tokenizer, kind: str, plain: bool):
        super().__init__()
        self.tokenizer, self.kind, self.plain, self.parts = tokenizer, kind, plain, {}
        self.model, self.letters = tokenizer.model, _byte_letters()

    def part(self, part: bytes) -> bytes:
        found = self.parts.get(part)
        if found is None:
            text = part.decode()
            if self.plain and text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                # lower-case letters alone are one piece as they stand: straight to the merges
                ids = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, part)))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            self.parts[part] = found = np.array(ids, self.kind).tobytes()
        return found

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(b".,!?*&%$#")
        cut = len(core) < len(word) and core[-1:].isalnum()
        self[word] = out = self.part(core) + self.part(word[len(core) :]) if cut else self.part(word)
        return out


class Encoder:
    """Encodes texts to ids.

    Where the vocabulary drops white space before it looks at words (a split on
    non-space classes, no prefix space), ids of a text are those of its words,
    one after another, and each distinct word is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(self.tokenizer.to_str())
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4"
        pres = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = next((p for p in pres if p.get("type") == "Split"), None)
        dropped = bool(split) and split.get("behavior") == "Removed" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in split.get("pattern", {}).get("Regex", "")
        self.lowers = "Lowercase" in json.dumps(config.get("normalizer")) and all(t["content"].startswith("<|") for t in config.get("added_tokens", []))
        rules = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
        plain = rules == ["NFC", "Replace", "Lowercase"] and any(p.get("type") == "ByteLevel" for p in pres)
        spaced = any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in config.get("added_tokens", []))
        self.words = _WordIds(self.tokenizer, self.kind, plain) if dropped and not spaced else None

    def __call__(self, text: bytes) -> np.ndarray:
        if self.words is None:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if len(self.words.parts) > CACHED_WORDS:
            self.words.parts.clear()
        if self.lowers and b"<|" not in text:  # special tokens keep their case
            text = text.lower()
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), self.kind).astype(np.uint32)

    def forget(self) -> None:
        """Give up the words: workers outlive their task, and other stages need the memory."""
        if self.words is not None:
            self.words.clear()
            self.words.parts.clear()


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _segments(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("segment", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(id_type)), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())])


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, segment_ids: int = 262_144,
    percentile: float = 0.9, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every text, append end_id, and write the segments to the folder `path`."""
    id_name = docs.schema[id_col].dataType.simpleString()
    layout = _segments(to_arrow_type(docs.schema[id_col].dataType))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, segment = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, parts, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload = pack(np.concatenate(parts), percentile)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip((shard, segment, held, list(ids), list(sizes), payload), layout, strict=True)], schema=layout
            )

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                got = np.concatenate([encoder(text or b""), end])
                ids.append(key)
                parts.append(got)
                sizes.append(len(got))
                held += len(got)
                if held >= segment_ids:
                    yield flush()
                    segment += 1
                    ids, parts, sizes, held = [], [], [], 0
        if held:
            yield flush()
        encoder.forget()

    ordered = (
        docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("m"))
        .repartitionByRange(F.col("k"), F.xxhash64("t"), F.col("m"))  # m parts a row that is repeated very often
        .sortWithinPartitions(F.col("k"), F.xxhash64("t"))
        .select("k", "t")
    )
    ordered.mapInArrow(encode, f"shard int, segment bigint, n_ids bigint, ids array<{id_name}>, sizes array<bigint>, payload binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files, all from their payloads.

    start counts the ids of all documents before it, in the order of the files.
    """
    table = spark.read.parquet(path)
    id_name = table.schema["ids"].dataType.elementType.simpleString()
    arrow_id = table.schema["ids"].dataType.elementType
    at = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row a file at most, counts only
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = table.select("shard", "segment", F.coalesce(F.sum("n_ids").over(at), F.lit(0)).alias("local"))
    places = local.join(before, "shard").select("shard", "segment", (F.col("base") + F.col("local")).alias("first"))
    out = pa.schema([("shard", pa.int32()), ("segment", pa.int64()), (id_col, to_arrow_type(arrow_id)), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, segment, keys, sizes, payload = (batch.column(i)[row].as_py() for i in range(5))
                ids = unpack(payload).astype("<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes, ends.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(([shard] * n, [segment] * n, keys, ends - sizes, sizes, crc), out, strict=True)], schema=out
                )

    read = table.select("shard", "segment", "ids", "sizes", "payload").mapInArrow(
        decode, f"shard int, segment bigint, {id_col} {id_name}, inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return read.join(places, ["shard", "segment"]).select(id_col, (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
