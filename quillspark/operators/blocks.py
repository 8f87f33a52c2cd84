"""Posting lists in fixed-size compressed blocks, and the best rows of a query by their bounds.

A shard holds the lists of some rows, numbered in the order of their keys. A list is
cut into blocks of ``BLOCK`` postings. A block keeps its first and last row and its
greatest impact in the open; gaps between rows and counts are packed into bytes. A query
adds up the greatest impacts of the blocks over each stretch of rows between block
borders, reads stretches from the highest bound down, and stops where a bound falls
below its k-th score; only blocks that reach into a stretch that is read are unpacked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 128
#: Stretches read in the first round; each round reads twice as many.
FIRST_ROUND = 16

Impact = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the highest bit set on all bytes of a number but its last: bytes, and where each number ends."""
    numbers = numbers.astype(np.uint64)
    sizes = np.ones(len(numbers), np.int64)
    for bits in range(7, 64, 7):
        more = numbers >= np.uint64(1) << np.uint64(bits)
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out, starts = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8), ends - sizes
    for k in range(int(sizes.max(initial=0))):
        here = np.flatnonzero(sizes > k)
        low = (numbers[here] >> np.uint64(7 * k)) & np.uint64(127)
        out[starts[here] + k] = low.astype(np.uint8) | ((sizes[here] > k + 1) << 7).astype(np.uint8)
    return out, ends


def unpack(packed: np.ndarray) -> np.ndarray:
    if not len(packed):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(packed < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(packed)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((packed & 127).astype(np.int64) << (7 * place), starts)


def lists_of(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def index_schema(key: pa.DataType) -> pa.Schema:
    numbers = pa.list_(pa.int32())
    return pa.schema([("shard", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("cf", pa.int64()), ("first", numbers), ("last", numbers), ("until", numbers), ("most", pa.list_(pa.float64())), ("packed", pa.binary()), ("keys", pa.list_(key)), ("sizes", pa.list_(pa.int64()))])


def index_columns(key: str) -> str:
    """The same columns in Spark's words, ``key`` being the type of keys there."""
    return f"shard string, term string, df long, cf long, first array<int>, last array<int>, until array<int>, most array<double>, packed binary, keys array<{key}>, sizes array<long>"


class Counted:
    """How often each term occurs in each row, gathered batch by batch: what is held is a few bytes a pair of a term and a row, and neither tokens nor the batches they came in."""

    def __init__(self) -> None:
        self.keys: list[pa.Array] = []
        self.terms: list[pa.DictionaryArray] = []
        self.rows, self.times, self.sizes = [], [], []
        self.n_rows = self.n_tokens = 0

    def add(self, keys: pa.Array, tokens: pa.Array, lengths: np.ndarray, sizes: np.ndarray) -> None:
        """``tokens``: those of all rows, one row after the other, ``lengths`` of each. ``sizes``: what impacts take as a row's length."""
        n = len(keys)
        named = tokens.dictionary_encode()
        cell, times = np.unique(named.indices.to_numpy().astype(np.int64) * max(1, n) + np.repeat(np.arange(n), lengths), return_counts=True)
        # copies, since a slice keeps the whole batch it is of
        self.keys.append(keys.take(pa.array(np.arange(n))))
        self.terms.append(pa.DictionaryArray.from_arrays(pa.array((cell // max(1, n)).astype(np.int32)), named.dictionary))
        self.rows.append((cell % max(1, n) + self.n_rows).astype(np.int32))
        self.times.append(times.astype(np.int32))
        self.sizes.append(np.array(sizes, np.int64))
        self.n_rows, self.n_tokens = self.n_rows + n, self.n_tokens + len(tokens)

    def sorted(self) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, their sizes, names in order, and for each pair the numbers of its name and row and its count, by name and row. What was held is let go."""
        keys, sizes = pa.concat_arrays(self.keys), np.concatenate(self.sizes)
        order = pc.sort_indices(keys).to_numpy()
        number = np.empty(len(keys), np.int32)
        number[order] = np.arange(len(keys), dtype=np.int32)
        one = pa.chunked_array(self.terms).unify_dictionaries()
        names = one.chunk(0).dictionary
        by_name = pc.sort_indices(names)
        name_no = np.empty(len(names), np.int64)
        name_no[by_name.to_numpy()] = np.arange(len(names))
        # a row lies in one batch, so each pair is there once
        cell = np.concatenate([name_no[c.indices.to_numpy()] * max(1, len(keys)) + number[r] for c, r in zip(one.chunks, self.rows)])
        times = np.concatenate(self.times)
        self.__init__()
        at = np.argsort(cell)
        cell, times = cell[at], times[at]
        del at
        return keys.take(pa.array(order)), sizes[order], names.take(by_name).cast(pa.string()), (cell // max(1, len(keys))).astype(np.int32), (cell % max(1, len(keys))).astype(np.int32), times


def shard_rows(shard: str, keys: pa.Array, tokens: pa.Array, lengths: np.ndarray, sizes: np.ndarray, impact: Impact, batch: int = 4096):
    """``counted_rows`` of rows that are all there."""
    counted = Counted()
    counted.add(keys, tokens, lengths, sizes)
    yield from counted_rows(shard, counted, impact, batch)


def counted_rows(shard: str, counted: Counted, impact: Impact, batch: int = 4096, postings: int = 1 << 17):
    """The index rows of a shard: a list a term, and under the empty term the rows' keys and sizes.

    Lists are packed ``batch`` terms at once, fewer where these have more than
    ``postings``; one list is packed as a whole. ``counted`` is emptied.
    """
    keys, sizes, names, term, row, tf = counted.sorted()
    schema = index_schema(keys.type)
    nothing = {f.name: pa.nulls(1, f.type) for f in schema}
    head = nothing | {"shard": pa.array([shard]), "term": pa.array([""]), "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "sizes": lists_of(np.array([0, len(keys)]), sizes, pa.int64())}
    yield pa.RecordBatch.from_arrays([head[f.name] for f in schema], schema=schema)
    if not len(term):
        return
    opens = np.flatnonzero(np.diff(term, prepend=-1))  # where terms start
    del term
    a, bounds = 0, np.append(opens, len(row))
    while a < len(opens):
        b = max(a + 1, min(a + batch, int(np.searchsorted(bounds, bounds[a] + postings, "right")) - 1))
        yield _lists(shard, names.slice(a, b - a), bounds[a : b + 1] - bounds[a], row[bounds[a] : bounds[b]].astype(np.int64), tf[bounds[a] : bounds[b]].astype(np.int64), sizes, impact, keys.type)
        a = b


def _lists(shard: str, names: pa.Array, bounds: np.ndarray, row: np.ndarray, tf: np.ndarray, sizes: np.ndarray, impact: Impact, key: pa.DataType) -> pa.RecordBatch:
    """Index rows of some terms, whose postings lie between ``bounds``."""
    n, opens, df = len(names), bounds[:-1], np.diff(bounds)
    of_term = np.arange(len(row)) - np.repeat(opens, df)
    starts = np.flatnonzero(of_term % BLOCK == 0)  # where blocks start
    ends = np.append(starts[1:], len(row))
    most = np.maximum.reduceat(impact(tf, sizes[row]).astype(np.float64), starts)
    pairs = np.empty(2 * len(row), np.int64)
    pairs[0::2] = np.diff(row, prepend=0)
    pairs[0::2][starts] = 0
    pairs[1::2] = tf
    data, told = pack(pairs)
    byte_end = told[2 * ends - 1]  # of blocks
    at = np.append(np.searchsorted(starts, opens), len(starts))  # the first block of each term
    byte_start = np.concatenate([[0], byte_end])[at]  # of terms
    until = byte_end - np.repeat(byte_start[:-1], np.diff(at))
    packed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(byte_start.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    schema = index_schema(key)
    columns = {
        "shard": pa.array([shard]).take(pa.array(np.zeros(n, np.int32))), "term": names, "df": pa.array(df, pa.int64()), "cf": pa.array(np.add.reduceat(tf, opens), pa.int64()),
        "first": lists_of(at, row[starts], pa.int32()), "last": lists_of(at, row[ends - 1], pa.int32()), "until": lists_of(at, until, pa.int32()), "most": lists_of(at, most, pa.float64()),
        "packed": packed, "keys": pa.nulls(n, pa.list_(key)), "sizes": pa.nulls(n, pa.list_(pa.int64())),
    }
    return pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)


class Shard:
    """Some lists of a shard, read by bounds. ``rows``: index rows, the one of keys among them."""

    def __init__(self, rows: pa.Table, impact: Impact, stretch_of: Callable[[np.ndarray], float] = lambda sizes: 1.0):
        head = pc.index(rows.column("term"), "").as_py()
        self.keys = rows.column("keys")[head].values
        self.sizes = rows.column("sizes")[head].values.to_numpy()
        self.impact, self.stretch = impact, stretch_of(self.sizes)
        whole = lambda c: pa.concat_arrays(rows.column(c).chunks)
        lists = [whole(c) for c in ("first", "last", "until", "most")]
        self.offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.first, self.last, self.until, self.most = (x.flatten().to_numpy() for x in lists)
        self.packed = whole("packed")
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._within: dict[tuple[int, ...], np.ndarray] = {}

    @property
    def blocks_read(self) -> int:
        return len(self._open)

    def block(self, of: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and impacts of block ``b``, one of list ``of``."""
        if b not in self._open:
            start = self.until[b - 1] if b > self.offsets[of] else 0
            pairs = unpack(np.frombuffer(self.packed[of].as_buffer(), np.uint8)[start : self.until[b]])
            row = self.first[b] + np.cumsum(pairs[0::2])
            self._open[b] = row, self.impact(pairs[1::2], self.sizes[row]).astype(np.float64)
        return self._open[b]

    def with_all(self, lists: np.ndarray) -> np.ndarray:
        """For each row whether it is in all of ``lists``."""
        name = tuple(sorted(lists))
        if name not in self._within:
            count = np.zeros(len(self.sizes), np.int64)
            for i in lists:
                for b in range(self.offsets[i], self.offsets[i + 1]):
                    count[self.block(i, b)[0]] += 1
            self._within[name] = count == len(lists)
        return self._within[name]

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int, digits: int | None = None, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k rows with the highest sums of weight x impact over ``lists``, above 0; ties by row.

        With ``digits``, sums that round to the same are ties. ``within``: for each row
        whether it counts.
        """
        mine = np.concatenate([np.arange(self.offsets[i], self.offsets[i + 1]) for i in lists])
        of = np.repeat(np.arange(len(lists)), self.offsets[lists + 1] - self.offsets[lists])
        bound = weights[of] * self.most[mine] * self.stretch
        edges = np.unique(np.concatenate([self.first[mine], self.last[mine] + 1]))
        low, high = np.searchsorted(edges, self.first[mine]), np.searchsorted(edges, self.last[mine] + 1)
        # whole numbers are exact; rounding of others is far below the margin
        top = np.cumsum(np.bincount(low, bound, len(edges)) - np.bincount(high, bound, len(edges)))[:-1]
        margin = 0.0 if digits is None else 10.0**-digits + 1e-9 * float(bound.sum())
        order = np.argsort(-top, kind="stable")
        rows, sums, bar, at, many = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, FIRST_ROUND
        while at < len(order) and top[order[at]] >= bar - margin and top[order[at]] > 0:
            read = order[at : at + many]
            read = read[top[read] >= bar - margin]
            chosen = np.zeros(len(edges) + 1, np.int64)
            chosen[read] = 1
            before = np.concatenate([[0], np.cumsum(chosen)])
            found = [(weights[of[j]], *self.block(lists[of[j]], mine[j])) for j in np.flatnonzero(before[high] > before[low])]
            row = np.concatenate([r for _, r, _ in found])
            part = np.concatenate([w * x for w, _, x in found])
            inside = chosen[np.searchsorted(edges, row, "right") - 1] == 1
            if within is not None:
                inside &= within[row]
            got = np.bincount(row[inside], part[inside], len(self.sizes))
            hit = np.flatnonzero(got > 0)
            rows, sums = np.concatenate([rows, hit]), np.concatenate([sums, got[hit]])
            keep = np.lexsort((rows, -(sums if digits is None else np.round(sums, digits))))[:k]
            rows, sums = rows[keep], sums[keep]
            bar = float(sums.min()) if len(rows) == k else 0.0
            at, many = at + many, 2 * many
        return rows, sums

    def best_of_all(self, lists: np.ndarray, weights: np.ndarray, k: int, digits: int | None = None, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As ``best``, of the rows that are in each of the lists."""
        rows, sums = None, None
        for i in np.argsort(self.offsets[lists + 1] - self.offsets[lists], kind="stable"):  # the shortest first
            blocks = np.arange(self.offsets[lists[i]], self.offsets[lists[i] + 1])
            if rows is not None:  # blocks with any of the rows left
                blocks = blocks[np.searchsorted(rows, self.last[blocks], "right") > np.searchsorted(rows, self.first[blocks])]
            if not len(blocks):
                return np.zeros(0, np.int64), np.zeros(0)
            found = [self.block(lists[i], b) for b in blocks]
            row, part = np.concatenate([r for r, _ in found]), weights[i] * np.concatenate([x for _, x in found])
            if rows is None:
                rows, sums = row, part
            else:
                rows, a, b = np.intersect1d(rows, row, assume_unique=True, return_indices=True)
                sums = sums[a] + part[b]
        if within is not None:
            rows, sums = rows[within[rows]], sums[within[rows]]
        keep = np.lexsort((rows, -(sums if digits is None else np.round(sums, digits))))[:k]
        return rows[keep], sums[keep]
