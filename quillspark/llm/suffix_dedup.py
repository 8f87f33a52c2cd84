"""Removal of repeated substrings with suffix arrays sorted in two stages.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else,
too. Repeats are found with suffix arrays of text contexts. The two stages: types
of suffixes come from neighbouring bytes; only suffixes smaller than their
successors are sorted directly, and all others are induced by scanning the buckets
of first bytes in order, each scanned suffix putting the one ahead of it at the
front of its bucket. Adjacent suffixes are then compared, and common prefixes of
``length`` bytes or more are repeats.

Which contexts meet in an array: every window of ``length`` bytes is named by the
least hash of its ``gram``-byte substrings (leftmost on ties). Equal windows have
equal names at equal offsets, so windows with different names need not meet.
Consecutive windows of one name make a context, about a third of it new text. Only
contexts whose name stands elsewhere as well are cut out and sorted; contexts equal
in every byte are told by digest and represented once, with their number.

Scale: equal texts are merged first, before the shuffle, into a table bucketed by
text, so that later joins move only small rows. A row a context (a name, a digest
and positions) is shuffled once. Names with more than ``hot`` contexts are cut
into pieces of ``PIECE`` windows keyed by the bytes that these windows share, which
spreads one very common passage over many tasks. Arrays are built over blocks of
about ``block`` bytes, closed at a change of key.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing;
repeated rows are repeats of each other; an empty table gives an empty table; null
ids and other columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.core import materialize

PIECE = 8
#: Between contexts; never part of UTF-8.
STOP = 0xFF
_B = np.uint64(0xD1342543DE82EF95)
_BI = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
POS_BITS = 28


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one isn't."""
    n = len(t)
    up = np.zeros(n, dtype=np.int8)
    up[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    up[-1] = -1
    at = np.where(up != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return up[at] > 0


def sort_directly(t: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """``pos`` ordered by the suffixes' first ``depth`` bytes, eight bytes at a time."""
    padded = np.concatenate([t, np.zeros(depth + 16, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(t) + depth + 8, 8), (1, 1))

    def keys(p: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(eight[p]).view(">u8").reshape(-1).astype(np.uint64)

    k = keys(pos)
    order = np.argsort(k, kind="stable")
    out, k = pos[order], k[order]
    slots = np.arange(len(out))
    group = np.zeros(len(out), dtype=np.int64)
    for d in range(8, depth + 8, 8):
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (group[1:] != group[:-1])
        ids = np.cumsum(new) - 1
        tied = np.bincount(ids)[ids] > 1
        if d >= depth or not tied.any():
            break
        slots, group = slots[tied], ids[tied]
        p = out[slots]
        k = keys(p + d)
        order = np.lexsort((k, group))
        out[slots] = p[order]
        k = k[order]
    return out


def two_stage_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` in the order of their first ``depth`` bytes at least."""
    n = len(t)
    if not n:
        return np.zeros(0, dtype=np.int64)
    direct = smaller_than_next(t)
    first = sort_directly(t, np.nonzero(direct)[0], depth)
    edges = np.searchsorted(t[first], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        mine = waiting[c]
        k = 0
        while k < len(mine):  # those that c itself puts at its front
            ahead = mine[k] - 1
            ahead = ahead[ahead >= 0]
            ahead = ahead[t[ahead] == c]
            if len(ahead):
                mine.append(ahead)
            k += 1
        bucket = np.concatenate([*mine, first[edges[c] : edges[c + 1]]]) if mine else first[edges[c] : edges[c + 1]]
        if not len(bucket):
            continue
        out.append(bucket)
        ahead = bucket - 1
        ahead = ahead[ahead >= 0]
        ahead = ahead[t[ahead] > c]
        if len(ahead):
            to = t[ahead]
            order = np.argsort(to, kind="stable")
            ahead, to = ahead[order], to[order]
            cut = np.nonzero(np.diff(to))[0] + 1
            for part in np.split(ahead, cut):
                waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one ahead of it, ``most`` at most."""
    padded = np.concatenate([t, np.zeros(most + 16, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(t) + most + 8, 8), (1, 1))
    out = np.zeros(len(order), dtype=np.int64)
    live = np.arange(1, len(order))
    for d in range(0, most, 8):
        same = eight[order[live] + d] == eight[order[live - 1] + d]
        whole = same.all(axis=1)
        out[live] += np.where(whole, 8, same.argmin(axis=1))
        live = live[whole]
        if not len(live):
            break
    return np.minimum(out, most)


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context the starts of its windows that stand elsewhere in the contexts."""
    t = np.frombuffer(bytes([STOP]).join(contexts) + bytes([STOP]), dtype=np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts])
    starts = np.cumsum(sizes) - sizes
    order = two_stage_order(t, length)
    left = np.repeat(starts + sizes - 1, sizes) - np.arange(len(t))
    order = order[left[order] >= length]
    twice = common_prefixes(t, order, length) >= length
    hit = twice.copy()
    hit[:-1] |= twice[1:]
    found = np.sort(order[hit])
    cut = np.searchsorted(found, starts)
    return [found[a:b] - s for a, b, s in zip(cut, [*cut[1:], len(found)], starts, strict=True)]


class Namer:
    """Names of windows: runs of windows that one position's hash names."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)
        self.bytes = np.frombuffer(b"".join(blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), dtype=np.uint64)

    def runs(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(name, first window, last window, position that names) of a text."""
        n, g, length = len(text), self.gram, self.length
        none = np.zeros(0, dtype=np.int64)
        if n < length:
            return none, none, none, none
        if len(self.powers) <= n:
            m = max(2 * n, 1 << 16)
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, _B)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, _BI)]), dtype=np.uint64)
        b = np.frombuffer(text, dtype=np.uint8)
        s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.bytes[b] * self.powers[:n], out=s[1:])
        h = (s[g:] - s[: n - g + 1]) * self.inverse[: n - g + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        packed = (h & ~np.uint64((1 << POS_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        w = length - g + 1
        size = 1
        while size * 2 <= w:
            packed = np.minimum(packed[:-size], packed[size:])
            size *= 2
        if size < w:
            packed = np.minimum(packed[: len(packed) - (w - size)], packed[w - size :])
        at = (packed & np.uint64((1 << POS_BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        return h[at[first]].view(np.int64), first, last, at[first]


def _texts(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id and node; texts: node, t, copies, bucketed by node)."""
    spark = docs.sparkSession
    t = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t, F.md5(t)).alias("node"), t.alias("t"))
    members = materialize(rows.select("doc_id", "node"), "suffix-members")
    name = f"suffix_texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = rows.groupBy("node").agg(F.min("t").alias("t"), F.count("*").alias("copies")).repartition(n, "node")
    merged.write.format("parquet").option("compression", "zstd").bucketBy(n, "node").saveAsTable(name)
    return members, spark.table(name)


def _contexts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer = Namer(length, gram)
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for node, t, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, s, e, a = namer.runs(t)
                if not len(h):
                    continue
                ctx = np.frombuffer(b"".join(blake2b(t[x:y], digest_size=8).digest() for x, y in zip(s.tolist(), (e + length).tolist(), strict=True)), dtype=np.int64)
                for k, x in enumerate((h, ctx, np.full(len(h), node), s, e, a, np.full(len(h), copies))):
                    out[k].append(x)
            if out[0]:
                cols = [np.concatenate(x) for x in out]
                kinds = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int64]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(cols, kinds, strict=True)], names=["h", "ctx", "node", "s", "e", "a", "copies"])

    return texts.select("node", "t", "copies").mapInArrow(name, "h long, ctx long, node long, s int, e int, a int, copies long")


def _sorted_repeats(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """(node, lo, hi) in bytes from rows (key, node, s, m, bytes) with m = 1."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        nodes, lo, hi = [], [], []
        for (_, node, s, m, _), w in zip(rows, repeated_windows([bytes(r[4]) for r in rows], length), strict=True):
            if m == 1 and len(w):
                cut = np.nonzero(np.diff(w) > 1)[0]
                for x, y in zip(w[np.concatenate([[0], cut + 1])].tolist(), w[np.concatenate([cut, [len(w) - 1]])].tolist(), strict=True):
                    nodes.append(node)
                    lo.append(s + x)
                    hi.append(s + y + length)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["node", "lo", "hi"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= block and row[0] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield flush(held)

    dealt = contexts.select("key", "node", "s", "m", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(find, "node long, lo long, hi long")


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 48, hot: int = 4096, block: int = 1_000_000, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, texts, spans): spans (node, lo, hi) cover the bytes to remove; they may overlap."""
    members, texts = _texts(docs, doc_id, text)
    by_name, by_context = Window.partitionBy("h"), Window.partitionBy("h", "ctx")
    found = _contexts(texts, length, gram).withColumn("n", F.count("*").over(by_name)).withColumn("mixed", F.min("ctx").over(by_name) < F.max("ctx").over(by_name))
    # names that stand once are gone before the second window
    found = found.where("n > 1 OR copies > 1").withColumn("m", F.sum("copies").over(by_context)).where("m > 1 OR mixed")
    found = materialize(found, "suffix-contexts")
    full = found.where("m > 1").select("node", F.col("s").cast("long").alias("lo"), (F.col("e") + length).cast("long").alias("hi"))
    # a context once, with its number
    need = found.where("mixed").groupBy("h", "ctx").agg(F.min(F.struct("node", "s", "e", "a")).alias("x"), F.max("m").alias("m"), F.max("n").alias("n")).select("h", "m", "n", "x.*")
    cut = texts.select("node", "t").join(need, "node")
    whole = cut.where(F.col("n") <= hot).select(F.col("h").alias("key"), "node", "s", "m", F.substring("t", F.col("s") + 1, F.col("e") + length - F.col("s")).alias("bytes"))
    j = F.explode(F.sequence(F.floor((F.col("a") - F.col("e")) / PIECE), F.floor((F.col("a") - F.col("s")) / PIECE)))
    hot_rows = cut.where(F.col("n") > hot).withColumn("j", j)
    from_, to = F.greatest(F.col("s").cast("long"), F.col("a") - PIECE * F.col("j") - (PIECE - 1)), F.least(F.col("e").cast("long"), F.col("a") - PIECE * F.col("j"))
    core = F.substring("t", (F.col("a") - PIECE * F.col("j") + 1).cast("int"), F.lit(length - PIECE + 1))
    pieces = hot_rows.select(F.xxhash64("h", "j", core).alias("key"), "node", from_.cast("int").alias("s"), "m", F.substring("t", (from_ + 1).cast("int"), (to - from_ + length).cast("int")).alias("bytes"))
    # equal pieces of different contexts are repeats; one of them goes on, with its number
    alike = Window.partitionBy("key", F.md5("bytes"))
    pieces = materialize(pieces.withColumn("k", F.count("*").over(alike)), "suffix-pieces")
    equal = pieces.where("k > 1").select("node", F.col("s").cast("long").alias("lo"), (F.col("s") + F.length("bytes")).cast("long").alias("hi"))
    single = pieces.groupBy("key", F.md5("bytes").alias("digest")).agg(F.min(F.struct("node", "s", "bytes")).alias("x"), F.max(F.when(F.col("k") > 1, F.lit(2)).otherwise(F.col("m"))).alias("m"))
    single = single.select("key", "x.node", "x.s", "m", "x.bytes")
    runs = _sorted_repeats(whole.unionByName(single), length, block)
    return members, texts, full.unionByName(equal).unionByName(runs)


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 48, doc_id: str = "doc_id", text: str = "text", **more: int) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    members, texts, spans = repeated_spans(docs, length, gram, doc_id=doc_id, text=text, **more)
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = materialize(spans, "suffix-spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            rows = []
            for node, t, cuts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kept, at, n = [], 0, 0
                done = 0
                for c in sorted((c["lo"], c["hi"]) for c in cuts or ()):
                    if c[0] > done or not n:
                        kept.append(t[done : c[0]])
                        n += 1
                        at += c[0] - done
                    done = max(done, c[1])
                kept.append(t[done:])
                at += len(t) - done
                rows.append((node, len(t), len(t) - at, n, sha256(b"".join(kept)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["node", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    told = texts.select("node", "t").join(spans, "node", "left").select("node", "t", "spans").mapInArrow(strip, "node long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return members.join(told, "node").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
