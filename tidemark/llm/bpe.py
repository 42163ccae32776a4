"""Byte-level BPE encoding and decoding of whole texts.

Words are cut by the tokenizer's own pattern. A short word is merged on a
contiguous rank array: the array holds the part boundaries and the rank of each
adjacent pair; the least rank is found by a scan, its boundary deleted and the
two neighbouring ranks refreshed. A long word, where repeated scans would take
quadratic time, keeps the same ranks in a heap. Both give the merges that the
rank order prescribes, so the ids equal the library's.

Text null or empty gives no ids and an empty decoded text. The added token is
recognised in the text before the pattern runs. Nothing is truncated or padded.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import rows_of

#: Words of up to so many bytes are merged by scans and remembered.
SHORT_WORD = 96
#: Words remembered by a Python worker before it starts afresh.
CACHE_WORDS = 400_000
NO_RANK = 1 << 40
#: Bytes of the texts that are encoded at a time, unless a single one has more.
SLICE_BYTES = 16 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file: printable Latin-1 characters stand for themselves, the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for a tokenizer file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_id = [0] * 256
        for char, byte in alphabet.items():
            self.byte_id[byte] = vocab[char]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.seen = _Seen(self)

    def merge_short(self, word: bytes) -> list[int]:
        """Merge on a contiguous rank array."""
        ids = [self.byte_id[b] for b in word]
        pairs = self.pairs
        rank = [pairs.get(a << 32 | b, (NO_RANK, 0))[0] for a, b in zip(ids, ids[1:], strict=False)]
        while rank:
            least = min(rank)
            if least == NO_RANK:
                break
            at = rank.index(least)
            ids[at] = pairs[ids[at] << 32 | ids[at + 1]][1]
            del ids[at + 1], rank[at]
            if at < len(rank):
                rank[at] = pairs.get(ids[at] << 32 | ids[at + 1], (NO_RANK, 0))[0]
            if at:
                rank[at - 1] = pairs.get(ids[at - 1] << 32 | ids[at], (NO_RANK, 0))[0]
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """Merge with a heap of (rank, place); entries that no longer hold are passed over."""
        ids = [self.byte_id[b] for b in word]
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i) for i in range(n - 1) if (p := pairs.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n:
                continue
            pair = pairs.get(ids[i] << 32 | ids[j])
            if pair is None or pair[0] != rank:
                continue
            ids[i], ids[j] = pair[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get(ids[i] << 32 | ids[k]):
                    heapq.heappush(heap, (p[0], i))
            if (h := before[i]) >= 0 and (p := pairs.get(ids[h] << 32 | ids[i])):
                heapq.heappush(heap, (p[0], h))
        return [x for x in ids if x >= 0]

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.seen
        if len(known) > CACHE_WORDS:
            known.clear()
        if self.special is None or not self.special.search(text):
            return b"".join(map(known.__getitem__, self.pattern.findall(text)))
        out = []
        for i, piece in enumerate(self.special.split(text)):
            out.append(self.added[piece].to_bytes(4, "little") if i % 2 else b"".join(map(known.__getitem__, self.pattern.findall(piece))))
        return b"".join(out)

    def decode_packed(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


class _Seen(dict):
    """Packed ids by word."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        short = len(raw) <= SHORT_WORD
        packed = b"".join(i.to_bytes(4, "little") for i in (self.bpe.merge_short(raw) if short else self.bpe.merge_long(raw)))
        if short:
            self[word] = packed
        return packed


_loaded: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """The codec of a file, read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``rows`` rows and, where they have more than one, ``SLICE_BYTES`` bytes."""
    start = 0
    while start < batch.num_rows:
        piece = batch.slice(start, rows)
        while piece.num_rows > 1 and piece.nbytes > SLICE_BYTES:
            piece = piece.slice(0, (piece.num_rows + 1) // 2)
        yield piece
        start += piece.num_rows


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` (packed little-endian uint32) and ``n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for keys, texts in rows_of(batches, 1000):
            ids = [bpe.encode_packed(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[id_col, "ids", "n_tokens"])

    return df.select(df[id_col].cast("long"), text_col).mapInArrow(run, f"`{id_col}` long, ids binary, n_tokens long")


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``id_col`` and the ``text`` that packed ids stand for (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for keys, ids in rows_of(batches, 1000):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([bpe.decode_packed(x or b"") for x in ids], pa.string())], names=[id_col, "text"])

    return df.select(df[id_col].cast("long"), ids_col).mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode, then decode the ids, in one pass.

    One row per input row, repeated rows included: ``id_col``, the columns named
    in ``keep``, ``ids`` (packed), ``n_tokens`` and ``decoded``. The id may be null.
    A kept column of one of these names gives way to the result. Texts are taken
    in slices of at most 500 rows and about ``SLICE_BYTES`` bytes.
    """
    made = [StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("decoded", StringType())]
    keep = tuple(c for c in dict.fromkeys(keep) if c not in (id_col, *(f.name for f in made)))
    out = StructType([*df.select(df[id_col].cast("long").alias(id_col), *(F.col(f"`{c}`") for c in keep)).schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            for piece in _slices(batch, 500):
                ids = [bpe.encode_packed(t or "") for t in piece.column(piece.num_columns - 1).to_pylist()]
                made = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode_packed(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *made], names=out.names)

    text = df[text_col].cast("string").alias("__text")
    # mapInArrow takes no input names with dots; the schema names the columns again.
    kept = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)]
    return df.select(df[id_col].cast("long").alias("__id"), *kept, text).mapInArrow(run, out)
