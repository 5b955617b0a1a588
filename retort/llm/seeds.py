"""Selected grams in packed blocks, and the join of the blocks of one bucket.

A task writes the grams that it selects as one block for each bucket of keys and
side: the bytes of each column apart, compressed.  The counts around a gram are
stored as the difference from what its place lets expect, which leaves few
different values.  A bucket's blocks are joined in numpy: grams of one key whose
places differ by no more than the edits allowed, then those whose counts agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters that are counted around a seed, by group; all others form one more group.
LETTERS = ("[:]-", "1", "2", "3", "0", "5", "4", "7", "6", "8", "9", "C", "H", "O", "N", "{}_", "()", "=", "<>")
KINDS = len(LETTERS) + 1
#: The size from which on the counts aren't used (four of them share a word while they are made).
COUNTED = 1 << 16
#: Bits of a key and of a class; two that agree by chance only give a pair that the alignment drops.
KEY_BITS, BITS = 32, 40
#: Seeds that a task packs at once, bytes that are compressed together at least, pairs of seeds that are compared at once.
PACKED, FRAME, COMPARED = 1_000_000, 16_384, 500_000
#: Seeds of one key near a seed's place from which on they are looked up by size, in classes of this ratio.
CROWD, RATIO = 256, 1.04
#: Pairs of seeds near each other from which on a key's seeds are joined apart, in pieces of about as many.
HEAVY = 50_000_000

_KIND = np.full(128, KINDS - 1)
for _k, _letters in enumerate(LETTERS):
    _KIND[[ord(c) for c in _letters]] = _k
BLOCKS = "bucket int not null, side int not null, block binary not null"
_WIDTHS = (KEY_BITS // 8, BITS // 8, 4, 4)
#: Planes of counts in a block: those of the last group are what is left of the place and of the size.
_TOLD = [i for i in range(2 * KINDS) if i % KINDS < KINDS - 1]


def kind_counts(codes: np.ndarray, start: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each (start, place, end): how often the characters of each group occur before and after the place, modulo 256."""
    code = np.minimum(codes, 127)
    words = []
    for word in range(-(-KINDS // 4)):
        lane = _KIND - 4 * word
        one = np.where((lane >= 0) & (lane < 4), np.uint64(1) << (16 * np.clip(lane, 0, 3)).astype(np.uint64), np.uint64(0))
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(one[code], out=total[1:])
        at = total[place]
        words.append(np.stack([at - total[start], total[end] - at], 1))
    # The low byte of each 16 bits.
    lanes = [np.ascontiguousarray(w.astype("<u8")).view(np.uint8).reshape(len(w), 2, 8)[:, :, ::2] for w in words]
    return np.concatenate(lanes, 2)[:, :, :KINDS].reshape(len(place), 2 * KINDS)


def _expected(rate: np.ndarray, size: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    for span in (place, size - place):
        for r in rate[:-1]:
            yield (span.astype(np.uint32) * np.uint32(r) >> np.uint32(8)).astype(np.uint8)


def _frames(n: int, planes: int) -> list[tuple[int, int]]:
    each = max(1, -(-FRAME // n))
    return [(a, min(a + each, planes)) for a in range(0, planes, each)]


def pack(key: np.ndarray, cls: np.ndarray, size: np.ndarray, place: np.ndarray, counts: np.ndarray) -> bytes:
    """One block of seeds, which are sorted by key."""
    n, columns = len(key), (np.diff(key, prepend=np.uint64(0)), cls, size, place)
    planes = [np.ascontiguousarray(c).astype(f"<u{8 if w > 4 else 4}").view(np.uint8).reshape(n, -1)[:, b] for c, w in zip(columns, _WIDTHS) for b in range(w)]
    seen = counts.reshape(n, 2, KINDS).sum((0, 1), np.int64)
    rate = np.minimum(256 * seen // max(1, int(size.sum(dtype=np.int64))), 255).astype(np.uint8)
    planes += [counts[:, i] - x for i, x in zip(_TOLD, _expected(rate, size, place))]
    codec = pa.Codec("zstd", compression_level=1)
    parts = [codec.compress(b"".join(p.tobytes() for p in planes[a:b]), asbytes=True) for a, b in _frames(n, len(planes))]
    return b"".join([np.array([n, *map(len, parts)], "<u4").tobytes(), rate.tobytes(), *parts])


def unpack(block: bytes) -> tuple[np.ndarray, ...]:
    """(key, cls, size, place, counts) of a block."""
    n, planes = int(np.frombuffer(block, "<u4", 1)[0]), sum(_WIDTHS) + len(_TOLD)
    frames = _frames(n, planes)
    lengths = np.frombuffer(block, "<u4", len(frames), 4)
    at = 4 + 4 * len(frames)
    rate = np.frombuffer(block, np.uint8, KINDS, at)
    at += KINDS
    codec, raw = pa.Codec("zstd"), np.empty((planes, n), np.uint8)
    for (a, b), length in zip(frames, lengths.tolist()):
        raw[a:b] = np.frombuffer(codec.decompress(block[at : at + length], (b - a) * n, asbytes=True), np.uint8).reshape(b - a, n)
        at += length
    columns, first = [], 0
    for w in _WIDTHS:
        whole = np.zeros((n, 8 if w > 4 else 4), np.uint8)
        whole[:, :w] = raw[first : first + w].T
        columns.append(whole.view(f"<u{whole.shape[1]}").ravel())
        first += w
    key, cls, size, place = np.cumsum(columns[0], dtype=np.uint64), columns[1].astype(np.int64), columns[2].astype(np.int32), columns[3].astype(np.int32)
    counts = np.empty((n, 2 * KINDS), np.uint8)
    for i, plane, x in zip(_TOLD, raw[first:], _expected(rate, size, place)):
        counts[:, i] = plane + x
    for last, span in ((KINDS - 1, place), (2 * KINDS - 1, size - place)):
        counts[:, last] = span.astype(np.uint8) - counts[:, last + 1 - KINDS : last].sum(1, dtype=np.uint8)
    return key, cls, size, place, counts


def short_keys(key: np.ndarray) -> np.ndarray:
    """Keys as blocks hold them. Selected grams are those of least hash, so that the first bits alone would put most of them into the first bucket."""
    with np.errstate(over="ignore"):
        return (key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - KEY_BITS)


def blocks(parts: list[tuple[np.ndarray, ...]], side: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, side, block) of seeds (key, cls, size, place, counts)."""
    key, cls, size, place, counts = (np.concatenate(c) for c in zip(*parts))
    key = short_keys(key)
    order = np.lexsort((place, key))
    key, cls, size, place, counts = key[order], cls[order], size[order], place[order], counts[order]
    bucket = (key * np.uint64(buckets)) >> np.uint64(KEY_BITS)
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(key)] if len(key) else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield int(bucket[a]), side, pack(key[a:b], cls[a:b], size[a:b], place[a:b], counts[a:b])


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, side, block = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(side, pa.int32()), pa.array(block, pa.binary())], ["bucket", "side", "block"])


def _ranges(lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of a range, place in it) of every member of the ranges that begin at ``lo`` and have ``n`` members, COMPARED at once."""
    end = np.cumsum(n)
    for a in range(0, int(end[-1]) if len(end) else 0, COMPARED):
        b = min(a + COMPARED, int(end[-1]))
        x, y = np.searchsorted(end, a, "right"), np.searchsorted(end, b, "left") + 1
        start = end[x:y] - n[x:y]
        left, right = np.maximum(start, a), np.minimum(end[x:y], b)
        i = np.repeat(np.arange(x, y), right - left)
        yield i, np.arange(a, b) + (lo[x:y] - start)[i - x]


def _windows(e: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...], per_edit: int) -> tuple[np.ndarray, ...]:
    """For the seeds of ``e`` whose key is in ``t``: their numbers, their key's number, and first and number of the seeds of ``t`` whose places may fit; then the number of each seed's key in ``t``."""
    number = np.cumsum(np.r_[True, t[0][1:] != t[0][:-1]]) - 1
    known = t[0][np.r_[True, t[0][1:] != t[0][:-1]]]
    at = np.minimum(np.searchsorted(known, e[0]), len(known) - 1)
    has = np.flatnonzero(known[at] == e[0])
    at, place = at[has], e[3][has].astype(np.int64)
    # The longer text has size * per_edit / (per_edit - 1) characters at most.
    reach = e[2][has].astype(np.int64) // (per_edit - 1)
    in_order = number << 32 | t[3]
    low = lambda x: np.searchsorted(in_order, at << 32 | np.maximum(x, 0))
    lo = low(place - reach)
    return has, at, lo, low(place + reach + 1) - lo, number


def _near(e: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...], per_edit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of seeds of one key, with all those whose places and sizes may fit; both sides are sorted by (key, place)."""
    if not len(e[0]) or not len(t[0]):
        return
    has, at, lo, n, number = _windows(e, t, per_edit)
    crowded = n > CROWD
    few = has[~crowded]
    for i, j in _ranges(lo[~crowded], n[~crowded]):
        yield few[i], j
    if not crowded.any():
        return
    has, at = has[crowded], at[crowded]
    size, place = e[2][has].astype(np.int64), e[3][has].astype(np.int64)
    most = size // (per_edit - 1)
    # Only the keys of crowded seeds, by class of size: within a class the places that fit are half as many or fewer.
    keys = np.zeros(number[-1] + 1, bool)
    keys[at] = True
    some = np.flatnonzero(keys[number])
    edges = np.unique(np.floor(RATIO ** np.arange(0, 1 + np.log(max(int(t[2][some].max()), 2)) / np.log(RATIO))).astype(np.int64))
    group = np.searchsorted(edges, t[2][some], "right") - 1
    some = some[np.lexsort((t[3][some], group, number[some]))]
    group = np.searchsorted(edges, t[2][some], "right") - 1
    slot = number[some] * len(edges) + group
    slots, first = np.unique(slot, return_index=True)
    dense = np.repeat(np.arange(len(slots)), np.diff(np.r_[first, len(slot)])) << 32 | t[3][some]
    lowest, highest = (np.searchsorted(edges, x, "right") - 1 for x in (np.maximum(size - most, 1), size + most))
    for step in range(int((highest - lowest).max()) + 1):
        g = lowest + step
        wanted = at * len(edges) + g
        s = np.minimum(np.searchsorted(slots, wanted), len(slots) - 1)
        ok = np.flatnonzero((g <= highest) & (slots[s] == wanted))
        # With a difference of sizes d, |x| + |d - x| <= most leaves (d - most) / 2 <= x <= (d + most) / 2 for the difference of places.
        over = np.r_[edges[1:], edges[-1] + (1 << 31)][g[ok]] - 1
        least_d, most_d = edges[g[ok]] - size[ok], np.minimum(over - size[ok], most[ok])
        a = np.maximum(place[ok] + (least_d - most[ok]) // 2, 0)
        b = np.maximum(place[ok] + -(-(most_d + most[ok]) // 2) + 1, 0)
        lo = np.searchsorted(dense, s[ok] << 32 | a)
        n = np.maximum(np.searchsorted(dense, s[ok] << 32 | b) - lo, 0)
        for i, j in _ranges(lo, n):
            yield has[ok[i]], some[j]


def sorted_seeds(seeds: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    order = np.lexsort((seeds[3], seeds[0]))
    return tuple(c[order] for c in seeds)


def taken_apart(e: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...], per_edit: int) -> tuple[tuple[np.ndarray, ...], list[tuple[bytes, bytes]]]:
    """``e`` without the seeds of heavy keys, and these in pieces: a block of them with a block of the seeds of ``t`` near them."""
    if not len(e[0]) or not len(t[0]):
        return e, []
    has, at, lo, n, _ = _windows(e, t, per_edit)
    heavy = np.flatnonzero(np.bincount(at, n) > HEAVY)
    rest, pieces = np.ones(len(e[0]), bool), []
    for k in heavy:
        a, b = np.searchsorted(at, k), np.searchsorted(at, k, "right")
        rest[has[a:b]] = False
        piece = np.cumsum(n[a:b]) // HEAVY
        cuts = np.r_[0, np.flatnonzero(np.diff(piece)) + 1, b - a] + a
        for x, y in zip(cuts, cuts[1:]):
            p, q = lo[x:y].min(), (lo[x:y] + n[x:y]).max()
            pieces.append((pack(*(c[has[x:y]] for c in e)), pack(*(c[p:q] for c in t))))
    return tuple(c[rest] for c in e), pieces


def fitting(e: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...], per_edit: int) -> Iterator[list[np.ndarray]]:
    """(cls_e, cls_t, size_e, size_t, place_e, place_t) of the pairs of seeds that a pair of texts within the allowed edits may have; both sides are sorted by (key, place).

    A seed's left and right parts differ by the edits on that side at least; an
    edit changes the counts by two at most.
    """
    for i, j in _near(e, t, per_edit):
        size_e, size_t, place_e, place_t = e[2][i], t[2][j], e[3][i], t[3][j]
        most = np.maximum(size_e, size_t) // per_edit
        off = np.abs(place_e - place_t) + np.abs((size_e - place_e) - (size_t - place_t))
        keep = np.flatnonzero((off <= most) & (e[1][i] != t[1][j]))
        i, j, most, off = i[keep], j[keep], most[keep], off[keep]
        d = e[4][i] - t[4][j]
        apart = np.minimum(d, -d).sum(1, dtype=np.int32)
        keep = np.flatnonzero((apart <= 2 * most - off) | (np.maximum(e[2][i], t[2][j]) >= COUNTED))
        i, j = i[keep], j[keep]
        if len(i):
            yield [e[1][i], t[1][j], e[2][i], t[2][j], e[3][i], t[3][j]]


PAIRS = "cls_e bigint, cls_t bigint, size_e int, size_t int, place_e int, place_t int"
#: Pairs, or a piece of a heavy key that is still to be joined, and the partition that takes them.
PARTED = PAIRS + ", spot int, block_e binary, block_t binary"
_PAIR, _BLOCKS = [pa.int64()] * 2 + [pa.int32()] * 4, [pa.int32(), pa.binary(), pa.binary()]


def _batch(columns: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in PARTED.split(", ")][: len(columns)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _PAIR + _BLOCKS)], names)


def join_blocks(batches: Iterator[pa.RecordBatch], sides: tuple[int, int], per_edit: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The fitting pairs of seeds of every bucket of a partition, from its blocks; heavy keys in pieces."""
    held: dict[tuple[int, int], list[bytes]] = {}
    for b in batches:
        for bucket, side, block in zip(b.column("bucket").to_pylist(), b.column("side").to_pylist(), b.column("block").to_pylist()):
            held.setdefault((bucket, side), []).append(block)
    for bucket in sorted({k for k, _ in held}):
        both = [held.pop((bucket, side), []) for side in sides]
        if all(both):
            e, t = (sorted_seeds(tuple(np.concatenate(c) for c in zip(*map(unpack, some)))) for some in both)
            e, pieces = taken_apart(e, t, per_edit)
            for i, (block_e, block_t) in enumerate(pieces):
                yield _batch([[None]] * 6 + [[(bucket + i) % buckets], [block_e], [block_t]])
            for columns in fitting(e, t, per_edit):
                n = len(columns[0])
                yield _batch([*columns, (columns[0] ^ columns[1]) % buckets, [None] * n, [None] * n])


def join_pieces(batches: Iterator[pa.RecordBatch], per_edit: int) -> Iterator[pa.RecordBatch]:
    """The pairs of seeds found already, and those of the pieces of heavy keys."""
    for b in batches:
        found = b.filter(b.column("block_e").is_null())
        if found.num_rows:
            yield found.select(range(len(_PAIR)))
        pieces = b.filter(b.column("block_e").is_valid())
        for block_e, block_t in zip(pieces.column("block_e"), pieces.column("block_t")):
            for columns in fitting(unpack(block_e.as_py()), unpack(block_t.as_py()), per_edit):
                yield _batch(columns)
