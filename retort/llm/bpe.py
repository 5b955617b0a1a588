"""Byte-level BPE encoding of a column of texts with numpy matrices.

A text is cut into pieces by the tokenizer's pattern.  Every distinct piece of a
task is encoded once: pieces are put into buckets by byte length, a bucket is a
padded matrix of token ids, and in each round every row merges its leftmost pair
of lowest rank, and further places of that same pair.  Ranks of pairs come from an open-addressing hash table in numpy;
rows that have no mergeable pair left leave the matrix (compaction).

Defined results: an empty text and a null text both give an empty list of ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.session import map_batches

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the splitting pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
#: Distinct pieces a Python worker remembers before it starts afresh.
REMEMBERED = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(name: str, folder: str = TOKENIZER_DIR) -> bytes:
    """The rank file of a byte-level tokenizer (driver side, under 1 MB)."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


class PairTable:
    """(left id, right id) -> id of the merged token, which is also its rank."""

    def __init__(self, rank_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        bits = max(4, int(np.ceil(np.log2(len(keys) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, np.int32)
        values, todo = np.array(made, np.int32), np.arange(len(keys))
        slot = ((keys * _MIX) >> self.shift).astype(np.int64)
        self.probes = 0
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            winners = todo[free]
            places, first = np.unique(slot[winners], return_index=True)
            self.keys[places] = keys[winners[first]]
            self.values[places] = values[winners[first]]
            placed = np.zeros(len(keys), bool)
            placed[winners[first]] = True
            todo = todo[~placed[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += 1

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge (a negative id never does)."""
        found = np.full(left.shape, NONE, np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[live].astype(np.uint64) << np.uint64(32)) | right.ravel()[live].astype(np.uint64)
        slot = ((keys * _MIX) >> self.shift).astype(np.int64)
        flat = found.ravel()
        while len(live):
            here = self.keys[slot]
            hit = here == keys
            flat[live[hit]] = self.values[slot[hit]]
            go = ~hit & (here != np.uint64(2**64 - 1))
            live, keys, slot = live[go], keys[go], (slot[go] + 1) & self.mask
        return flat.reshape(left.shape)


def _lowest_places(rank: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the places where a row's lowest pair is merged: the leftmost, and all others that don't overlap one before them."""
    hit = rank == best[:, None]
    if (hit[:, 1:] & hit[:, :-1]).any():
        column = np.arange(hit.shape[1])
        before = np.maximum.accumulate(np.where(hit, -1, column), axis=1)
        hit &= (column - before) % 2 == 1
    return np.nonzero(hit)


def _merge_bucket(ids: np.ndarray, size: np.ndarray, table: PairTable, out: list, rows: np.ndarray) -> None:
    """Encode the rows of one padded matrix; ``out[row]`` gets the ids.

    A round merges each row's lowest pair, from the leftmost place on.  What a
    merge makes has pairs of higher ranks only, so that taking the same pair's
    further places in the same round gives what one place a round gives.
    """
    rank = np.full(ids.shape, NONE, np.int32)
    rank[:, :-1] = table.ranks(ids[:, :-1], ids[:, 1:])
    while len(ids):
        best = rank.min(axis=1)
        done = best == NONE
        if done.any():
            for r, row, n in zip(rows[done], ids[done], size[done]):
                out[r] = row[:n].copy()
            keep = ~done
            if not keep.any():
                return
            width = int(size[keep].max()) + 1
            ids, size, rows, rank, best = ids[keep, :width], size[keep], rows[keep], rank[keep, :width], best[keep]
        line, at = _lowest_places(rank, best)
        merged = np.bincount(line, minlength=len(ids))
        ids[line, at] = best[line]
        kept = np.ones(ids.shape, bool)
        kept[line, at + 1] = False
        place = np.arange(ids.shape[1])[None, :] < (ids.shape[1] - merged)[:, None]
        shrunk, ranks = np.full(ids.shape, -1, np.int32), np.full(ids.shape, NONE, np.int32)
        shrunk[place], ranks[place] = ids[kept], rank[kept]
        ids, rank, size = shrunk, ranks, size - merged
        first = np.cumsum(merged) - merged
        at = at - (np.arange(len(line)) - first[line])
        rank[line, at] = table.ranks(ids[line, at], ids[line, at + 1])
        after = at > 0
        line, at = line[after], at[after] - 1
        rank[line, at] = table.ranks(ids[line, at], ids[line, at + 1])


def encode_pieces(pieces: list[bytes], table: PairTable) -> list[np.ndarray]:
    """Token ids of each piece; buckets grow by half in length."""
    out: list = [np.zeros(0, np.int32)] * len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for i in np.flatnonzero(size == 1):
        out[i] = table.byte_ids[list(pieces[i])]
    low, longest = 1, int(size.max()) if len(size) else 0
    while low < longest:
        high = max(low + 1, low * 3 // 2)
        rows = np.flatnonzero((size > low) & (size <= high))
        for part in np.array_split(rows, len(rows) * high // 2_000_000 + 1) if len(rows) else []:
            n = size[part]
            # One column more than the longest row, so that every pair has a right side.
            ids = np.full((len(part), int(n.max()) + 1), -1, np.int32)
            ids[np.arange(ids.shape[1])[None, :] < n[:, None]] = table.byte_ids[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
            _merge_bucket(ids, n, table, out, part)
        low = high
    return out


class Encoder:
    """Encodes batches of texts; remembers the pieces it has met."""

    def __init__(self, rank_file: bytes):
        import regex

        self.table = PairTable(rank_file)
        self.find = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Place of every piece of the batch, and the number of pieces of each text."""
        pieces, count = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                n = len(pieces)
                pieces += self.find(text)
                count[i] = len(pieces) - n
        if len(self.place) > REMEMBERED:
            self.forget()
        new = list(set(pieces).difference(self.place))
        if new:
            made = encode_pieces([p.encode("utf-8", "replace") for p in new], self.table)
            size = np.fromiter(map(len, made), np.int64, len(made))
            self.place.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
            self.size = np.r_[self.size, size]
            self.flat = np.concatenate([self.flat, *made])
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces)), count

    def counts(self, texts: list[str | None]) -> np.ndarray:
        places, count = self._places(texts)
        total = np.r_[0, np.cumsum(self.size[places])]
        ends = np.cumsum(count)
        return total[ends] - total[ends - count]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of the texts in them."""
        places, count = self._places(texts)
        size, start = self.size[places], self.start[places]
        total = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        return ids, np.r_[0, total[np.cumsum(count)]]


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(ranks: Broadcast) -> Encoder:
    """The encoder of this Python worker, made once for each rank file."""
    data = ranks.value
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def broadcast_ranks(spark: SparkSession, tokenizer: str, folder: str = TOKENIZER_DIR) -> Broadcast:
    """The rank file (a fixed 0.8 MB, whatever the data) for all workers."""
    return spark.sparkContext.broadcast(read_ranks(tokenizer, folder))


def _small(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some ``most`` bytes of text each, to bound the worker's memory."""
    size = np.array(pc.binary_length(batch.column(column)).fill_null(0)).cumsum() if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def token_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, ids): the token ids of each text, no special tokens; [] for null or empty texts."""
    ranks = broadcast_ranks(df.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks)
        for whole in batches:
            for b in _small(whole, "text"):
                ids, offsets = encoder.encode(b.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("id"), lists], ["id", "ids"])

    id_type = df.schema[id_col].dataType.simpleString()
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(plain, run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, n_tokens BIGINT): the number of tokens of each text; 0 for null or empty texts."""
    ranks = broadcast_ranks(df.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks)
        for whole in batches:
            for b in _small(whole, "text"):
                n = encoder.counts(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], ["id", "n_tokens"])

    id_type = df.schema[id_col].dataType.simpleString()
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(plain, run, f"id {id_type}, n_tokens bigint").withColumnRenamed("id", id_col)
