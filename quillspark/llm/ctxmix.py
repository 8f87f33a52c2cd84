"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its tokens: words in lower-case A-Z and one end. It is coded by binary
decisions at three levels; log10 of their probabilities add up to the score.

* Segments. A text is cut after words chosen by their hash, every 32nd on average. The
  segment most often seen after the same previous segment is predicted, from exact
  counts over all training texts; one decision says whether it comes. If so, its words
  are paid. The probability comes from an adaptive map over the prediction's counts
  and the length of the run of hits so far, so copies and common passages cost little.
* Words. A word not paid is a path of six decisions to one of 64 classes and a share
  of its class. Classes are made of the ``head_tokens`` most frequent tokens; the last
  class is all others. Predictors are the class's frequency, the word before, and the
  two words before; each has hashed counts, interpolated with the shorter context's.
* Letters. A word of the last class is spelled: bytes in a prefix code, each decision
  predicted from the last one, two and three bytes and from the whole beginning.

In the last two levels the predictors' logits are added with weights, one set for each
gate (how much the longest context has seen), and the weights are refined by the
coding error as the work goes on: along each text for words, along a bucket of tokens
for letters. A training row's own occurrence is left out of every count, so scores of
training and held-out rows compare. Statistics come from all training rows.

Scale: tokens and segments are counted with combiners and meet texts in shuffles;
these counts grow with the corpus. Hashed tables are sized by the corpus up to a fixed
bound (``MOST``), summed in chunks and broadcast, as are the head tokens. Passes over
texts hold some megabytes; long texts and tokens are worked on in pieces. A task's
hashed tables are summed before they move, in few tasks. Spelling depends only on the
token, so each distinct token is spelled once. Weights restart with each text and each
bucket, so results don't depend on how rows are dealt to tasks.

Defined results: a null or empty text has the end alone; a row is held out by its
id's CRC-32, a null id by that of the empty string; repeated rows train as often as
they stand; without training rows all counts are 0; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.core import materialize

#: Words a segment on average; decisions of a word's path.
SEGMENT, DEPTH = 32, 6
LEAVES = 1 << DEPTH
#: Bounds of hashed tables: contexts of one and two words, slots of three and more bytes.
MOST = (1 << 14, 1 << 15, 1 << 21)
CHUNK = 1 << 15
#: Weights that a text starts with and the rate they learn at, both chosen on training rows; words a step, and words of a text in steps of that size.
START, RATE, STEP, STEADY = (0.2, 0.3, 0.5), 1.0, 64, 1024
#: Gates of the segment map: run of hits, count of the prediction, whether it is the only one.
RUNS, SEEN = 4, 4
GATES = RUNS * SEEN * 2
TEXT_BYTES = 4_000_000
LEAST, MINUS_LOG10_E = np.float32(1e-5), np.float32(-np.log10(np.e))
#: Bytes with A-Z in lower case, and those that aren't white space.
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
INSIDE = ~np.isin(np.arange(256), [32, *range(9, 14)])
_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _bucket(n: np.ndarray) -> np.ndarray:
    """0, 1-2, 3-7, 8 and more."""
    return (n > 0.5).view(np.int8) + (n > 2.5).view(np.int8) + (n > 7.5).view(np.int8)


def _power(n: int, least: int, most: int) -> int:
    return int(min(most, max(least, 1 << max(0, int(n) - 1).bit_length())))


def others(table: np.ndarray, slot: np.ndarray, less: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) seen in each slot, without a learned row's own ``bit`` (``less`` is 1 there)."""
    pair = table.view(np.complex64)[slot]  # zeros and ones lie side by side: one read
    mine = less * bit
    return np.maximum(pair.real - (less - mine), 0), np.maximum(pair.imag - mine, 0)


def chain(counts: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray, prior: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Logits of ever longer contexts, each interpolated with the shorter one's
    probability, and how much the longest has seen. ``counts`` are (zeros, ones)."""
    p, out = first, []
    n, prior = np.zeros(len(first), dtype=np.float32), np.float32(prior)
    for n0, n1 in counts:
        n = n0 + n1
        p = np.clip((n1 + prior * p) / (n + prior), LEAST, 1 - LEAST)
        out.append(_stretch(p))
    return out, n


class Mixer:
    """Weights by gate, refined with the mean gradient of each call."""

    def __init__(self, gates: int, start: tuple[float, ...], rate: float) -> None:
        self.w = np.tile(np.array(start, dtype=np.float32)[:, None], (1, gates))
        self.rate = rate

    def cost(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, learn: bool = True) -> np.ndarray:
        """log10 of the probability of each bit (0 or 1, single precision)."""
        sign = 2 * bit - 1
        # odds of the other bit
        odds = np.exp(-sign * np.clip(sum(w[gate] * v for w, v in zip(self.w, x, strict=True)), np.float32(-11.5), np.float32(11.5)))
        if learn:
            n = np.maximum(np.bincount(gate, minlength=self.w.shape[1]), 1)
            e = sign * (odds / (1 + odds))
            for w, v in zip(self.w, x, strict=True):
                w += self.rate * np.bincount(gate, weights=e * v, minlength=len(w)) / n
        return np.log(1 + odds) * MINUS_LOG10_E


# Words


def split(texts: pa.Array | list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, place of each token among them, number of tokens of each text).

    Words are found among the bytes of all texts and told apart by Arrow; an end is an empty one.
    """
    texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    bounds = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
    data = np.zeros(0, dtype=np.uint8)
    if bounds[-1]:
        first = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first : first + bounds[-1]]
    inside = INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    full = bounds[:-1][bounds[1:] > bounds[:-1]]
    begins[full] = inside[full]
    at = np.flatnonzero(begins)
    # bytes of words ahead of each byte
    ahead = np.append(np.int32(0), np.cumsum(inside, dtype=np.int32))
    upto = np.searchsorted(at, bounds[1:])
    edges = np.append(np.insert(ahead[at], upto, ahead[bounds[1:]]), ahead[-1])
    seq = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(LOWER[data[inside]])]).dictionary_encode()
    return seq.dictionary, seq.indices.to_numpy(), np.diff(upto, prepend=0) + 1


class Head:
    """The most frequent tokens: their numbers, classes and shares. Sent to all tasks."""

    def __init__(self, tokens: list[bytes], counts: list[int], total: int, kinds: int) -> None:
        import xxhash

        self.ids = {t: i for i, t in enumerate(tokens)}
        c = np.array(counts, dtype=np.float64)
        # the last place is that of all other tokens
        mass = np.append(c + 1, max(1.0, total - c.sum() + 1))
        share = mass[:-1] / max(mass[:-1].sum(), 1.0)
        leaf = np.minimum((LEAVES - 1) * (np.cumsum(share) - share / 2), LEAVES - 2).astype(np.int64)
        self.leaf = np.append(leaf, LEAVES - 1)
        in_leaf = np.bincount(self.leaf, weights=mass, minlength=LEAVES)
        self.residual = np.append(np.log10(mass[:-1] / in_leaf[leaf]), 0.0)
        node = np.zeros(2 * LEAVES)
        node[LEAVES:] = in_leaf + 1e-3
        for i in range(LEAVES - 1, 0, -1):
            node[i] = node[2 * i] + node[2 * i + 1]
        self.prior = np.array([0.5] + [node[2 * i + 1] / node[i] for i in range(1, LEAVES)], dtype=np.float32)
        self.prior_logit = _stretch(np.clip(self.prior, LEAST, 1 - LEAST))
        self.known = np.append(c > 0, False)
        self.base = np.append(np.log10(c + 1) - np.log10(total + kinds + 1), 0.0)
        self.size = np.append([len(t) + 1 for t in tokens], 0)
        self.hash = np.append(np.array([xxhash.xxh64_intdigest(t) for t in tokens], dtype=np.uint64), np.uint64(0))


class Words:
    """The tokens of some texts as arrays."""

    def __init__(self, texts: pa.Array | list[str], head: Head) -> None:
        self.distinct, self.place, self.n = split(texts)
        self.found = np.fromiter(map(head.ids.get, self.distinct.to_numpy(zero_copy_only=False), repeat(-1)), dtype=np.int64, count=len(self.distinct))
        self.ids = self.found[self.place]
        self.starts = np.cumsum(self.n) - self.n
        self.leaf = head.leaf[self.ids]
        number = (self.ids + 2).astype(np.uint64)  # 1: not in the head, 0: ahead of the text
        one, two = np.zeros_like(number), np.zeros_like(number)
        one[1:], two[2:] = number[:-1], number[:-2]
        one[self.starts] = 0
        two[self.starts] = 0
        second = self.starts[self.n > 1] + 1
        two[second] = 0
        self.one = _mix(one * _G)
        self.two = _mix((self.one + two) * _G)

    def path(self, sizes: tuple[int, int], at: slice | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, bit, slot of one word, slot of two words) for each decision."""
        leaf = self.leaf[at]
        a = (self.one[at] & np.uint64(sizes[0] - 1)).astype(np.int64) * LEAVES
        b = (self.two[at] & np.uint64(sizes[1] - 1)).astype(np.int64) * LEAVES
        for j in range(DEPTH):
            node = (1 << j) | (leaf >> (DEPTH - j))
            yield node, (leaf >> (DEPTH - 1 - j)) & 1, a + node, b + node


def count_words(words: Words, sizes: tuple[int, int], one: np.ndarray, two: np.ndarray) -> None:
    """Adds the decisions of all words to the tables, each (slots * 2).

    Classes are counted by context; a node's zeros and ones are the sums of the classes
    below it, so that each word is counted once and not for every decision.
    """
    for context, size, into in ((words.one, sizes[0], one), (words.two, sizes[1], two)):
        slot = (context & np.uint64(size - 1)).astype(np.int64)
        below = np.bincount(slot * LEAVES + words.leaf, minlength=size * LEAVES).reshape(size, LEAVES)
        table = into.reshape(size, 2 * LEAVES)
        while below.shape[1] > 1:
            width = below.shape[1]
            table[:, width : 2 * width] += below
            below = below[:, ::2] + below[:, 1::2]


def word_costs(words: Words, own: np.ndarray, head: Head, sizes: tuple[int, int], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log10 of the share and path of each word. ``own`` tells texts that were learned.

    Weights belong to a text. Texts advance in step, by pieces that grow as they go.
    """
    mixers = [Mixer(len(words.n) * 4, START, RATE) for _ in range(DEPTH)]
    out = head.residual[words.ids].copy()
    lo, width = 0, STEP
    while (words.n > lo).any():
        live = np.nonzero(words.n > lo)[0]
        # long texts are few; a piece of them all stays small
        n = np.minimum(words.n[live] - lo, width)
        text = np.repeat(live, n)
        at = words.starts[text] + lo + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        less = own[text].astype(np.float32)
        cost = np.zeros(len(at), dtype=np.float32)
        for mixer, (node, bit, a, b) in zip(mixers, words.path(sizes, at), strict=True):
            bit = bit.astype(np.float32)
            x, seen = chain([others(one, a, less, bit), others(two, b, less, bit)], head.prior[node], 2.0)
            cost += mixer.cost([head.prior_logit[node], *x], text * 4 + _bucket(seen), bit)
        out[at] += cost
        lo += width
        # steps of one size first, where most texts end; growing ones for the long texts that are left
        width = width if lo < STEADY else min(width * 2, max(STEP, (1 << 19) // len(live)))
    return out


def segments(words: Words, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, text, name) of each segment, names 64-bit hashes of their words."""
    import xxhash

    h = head.hash[words.ids]
    rare, unknown = words.ids < 0, np.nonzero(words.found < 0)[0]
    own = np.zeros(len(words.found), dtype=np.uint64)
    own[unknown] = np.fromiter(map(xxhash.xxh64_intdigest, words.distinct.take(pa.array(unknown)).to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(unknown))
    h[rare] = own[words.place[rare]]
    first = np.zeros(len(h), dtype=bool)
    first[words.starts] = True
    first[1:] |= h[:-1] % np.uint64(SEGMENT) == 0
    start = np.nonzero(first)[0]
    length = np.diff(np.append(start, len(h)))
    inside = np.arange(len(h)) - np.repeat(start, length)
    power = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()) - 1, _G | np.uint64(1), dtype=np.uint64)), dtype=np.uint64)
    name = _mix(np.add.reduceat(_mix(h) * power[inside], start) + length.astype(np.uint64))
    return start, np.searchsorted(words.starts, start, side="right") - 1, name


# Letters


def prefix_code(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, codes) of a prefix code of the 256 bytes, by their frequency in ``tokens``."""
    weight = np.bincount(np.frombuffer(b" ".join(tokens) + b" ", dtype=np.uint8), minlength=256) + 1
    heap = [(int(w), b, ((b, ""),)) for b, w in enumerate(weight)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], a[1], tuple((k, "0" + c) for k, c in a[2]) + tuple((k, "1" + c) for k, c in b[2])))
    code = dict(heap[0][2])
    return np.array([len(code[b]) for b in range(256)], dtype=np.int64), np.array([int(code[b], 2) for b in range(256)], dtype=np.uint64)


class Letters:
    """The decisions of spelled tokens: slots of each context, bits and owners."""

    def __init__(self, tokens: list[bytes], code: tuple[np.ndarray, np.ndarray], slots: int) -> None:
        n = np.array([len(t) + 1 for t in tokens], dtype=np.int64)
        flat = np.frombuffer(b" ".join(tokens) + b" ", dtype=np.uint8)
        starts = np.cumsum(n) - n
        pos = np.arange(len(flat)) - np.repeat(starts, n)
        last = []
        for k in range(1, 4):
            x = np.zeros(len(flat), dtype=np.uint64)
            x[k:] = np.where(pos[k:] >= k, flat[:-k].astype(np.uint64) + np.uint64(1), np.uint64(0))
            last.append(x)
        o1 = last[0] + np.uint64(1 << 40)
        o2 = _mix(o1 * _G + last[1])
        o3 = _mix(o2 * _G + last[2])
        power = np.cumprod(np.append(np.uint64(1), np.full(int(n.max()), 0xD1342543DE82EF95, dtype=np.uint64)), dtype=np.uint64)
        part = (flat.astype(np.uint64) + np.uint64(1)) * power[pos]
        run = np.cumsum(part, dtype=np.uint64) - part
        whole = _mix(run - np.repeat(run[starts], n) + pos.astype(np.uint64) * _G)
        length = code[0][flat]
        of = np.repeat(np.arange(len(flat)), length)
        j = (np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)).astype(np.uint64)
        rest = length[of].astype(np.uint64) - j
        bits = code[1][flat][of]
        self.bit = ((bits >> (rest - np.uint64(1))) & np.uint64(1)).astype(np.int64)
        node = (np.uint64(1) << np.minimum(j, np.uint64(40))) | np.where(rest < 64, bits >> np.minimum(rest, np.uint64(63)), np.uint64(0))
        node = node * _G
        at = 0
        self.slots = []
        for c, size in zip((o1, o2, o3, whole), letter_sizes(slots), strict=True):
            self.slots.append((_mix(c[of] + node) & np.uint64(size - 1)).astype(np.int64) + at)
            at += size
        self.owner = np.repeat(np.arange(len(tokens)), n)[of]


def letter_sizes(slots: int) -> tuple[int, int, int, int]:
    return min(slots, 1 << 15), min(slots, 1 << 19), slots, slots


def pieces(tokens: list[bytes], most: int = 60_000) -> Iterator[slice]:
    """Runs of tokens with at most ``most`` bytes, or one token."""
    lo = held = 0
    for i, t in enumerate(tokens):
        if i > lo and held + len(t) + 1 > most:
            yield slice(lo, i)
            lo, held = i, 0
        held += len(t) + 1
    if lo < len(tokens):
        yield slice(lo, len(tokens))


def count_letters(tokens: list[bytes], counts: np.ndarray, code: tuple, slots: int, into: np.ndarray) -> None:
    for s in pieces(tokens):
        b = Letters(tokens[s], code, slots)
        w = counts[s].astype(into.dtype)[b.owner]
        for slot in b.slots:
            np.add.at(into, slot * 2 + b.bit, w)


def letter_costs(tokens: list[bytes], own: np.ndarray, code: tuple, slots: int, table: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log10 of the spelling of each token; ``mixer`` is refined on the way."""
    out = []
    for s in pieces(tokens):
        b = Letters(tokens[s], code, slots)
        less = own[s].astype(np.float32)[b.owner]
        cost = np.zeros(len(b.bit))
        for lo in range(0, len(cost), 1 << 16):
            p = slice(lo, lo + (1 << 16))
            bit = b.bit[p].astype(np.float32)
            x, seen = chain([others(table, slot[p], less[p], bit) for slot in b.slots], np.full(len(bit), 0.5, dtype=np.float32), 1.0)
            cost[p] = mixer.cost(x, _bucket(seen), bit)
        out.append(np.bincount(b.owner, weights=cost, minlength=s.stop - s.start))
    return np.concatenate(out) if out else np.zeros(0)


def letter_mixer() -> Mixer:
    return Mixer(4, (0.05, 0.15, 0.35, 0.5), 0.02)


# Jobs


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(7)) == 2


def _groups(batches: Iterator[pa.RecordBatch], text: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces with at most ``most`` bytes of texts, or of one text."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c): c occurrences in training rows, 0 for tokens of held-out rows alone.

    ``texts`` has held_out and t.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, 1, 2 * TEXT_BYTES):
            tokens, place, n = split(b.column(1))
            learned = np.repeat(~b.column(0).to_numpy(zero_copy_only=False).astype(bool), n)
            yield pa.RecordBatch.from_arrays([tokens, pa.array(np.bincount(place[learned], minlength=len(tokens)), pa.int64())], names=["token", "c"])

    return texts.select("held_out", "t").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _summed(parts: DataFrame, length: int, name: str) -> np.ndarray:
    """The sum of tables that came as (chunk, data): ``length`` numbers, a fixed bound."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.float32) for x in t.column("data").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((-(-length // CHUNK), CHUNK), dtype=np.float32)
    for r in materialize(parts.groupBy("chunk").applyInArrow(add, "chunk int, data binary"), name).toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["data"], dtype=np.float32)
    return out.reshape(-1)[:length]


def _chunks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    cut = np.append(table, np.zeros(-len(table) % CHUNK, dtype=np.float32)).reshape(-1, CHUNK)
    full = np.nonzero(cut.any(axis=1))[0]
    for lo in range(0, len(full), 64):
        part = full[lo : lo + 64]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([cut[i].tobytes() for i in part], pa.binary())], names=["chunk", "data"])


def word_tables(rows: DataFrame, sent_head, sizes: tuple[int, int], tasks: int) -> np.ndarray:
    """Counts of both word contexts in a row, over all training rows."""
    lengths = [n * LEAVES * 2 for n in sizes]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent_head.value
        into = np.zeros(sum(lengths), dtype=np.float32)
        for b in _groups(batches, 0):
            count_words(Words(b.column(0), head), sizes, into[: lengths[0]], into[lengths[0] :])
        yield from _chunks(into)

    # a task's tables have a fixed size, so few tasks count
    return _summed(rows.where(~F.col("held_out")).select("t").coalesce(tasks).mapInArrow(tally, "chunk int, data binary"), sum(lengths), "lm-words")


def spellings(rare: DataFrame, code: tuple, slots: int, tasks: int, buckets: int) -> DataFrame:
    """(token, c, lp) for tokens with their counts."""
    length = 2 * sum(letter_sizes(slots))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros(length)  # counts stay exact in double precision
        for b in batches:
            count_letters(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), code, slots, into)
        yield from _chunks(into.astype(np.float32))

    table = _summed(rare.where("c > 0").select("token", "c").repartition(tasks).mapInArrow(tally, "chunk int, data binary"), length, "lm-letters")
    sent = rare.sparkSession.sparkContext.broadcast(table)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mixer = None, letter_mixer()
        for b in batches:
            bucket = b.column(0).to_numpy(zero_copy_only=False)
            edges = np.append(np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0], len(bucket)).tolist()
            lp = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if bucket[lo] != now:
                    now, mixer = bucket[lo], letter_mixer()
                lp.append(letter_costs(b.column(1).slice(lo, hi - lo).to_pylist(), b.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False) > 0, code, slots, sent.value, mixer))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(np.concatenate(lp) if lp else [], pa.float64())], names=["token", "c", "lp"])

    named = rare.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket"), "token", "c")
    return materialize(named.repartition("bucket").sortWithinPartitions("bucket", "token").mapInArrow(spell, "token binary, c long, lp double"), "lm-spelled")


def cut_texts(rows: DataFrame, sent_head, sent_tables, sizes: tuple[int, int]) -> DataFrame:
    """A row a segment: rid, k, held_out, h (the previous segment), s, lp (its words but
    for spelling), rare (its tokens to spell); the text's own sums where k is 0."""
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tables = sent_head.value, sent_tables.value
        edge = sizes[0] * LEAVES * 2
        for b in _groups(batches, 3):
            held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            words = Words(b.column(3), head)
            cost = word_costs(words, ~held, head, sizes, tables[:edge], tables[edge:])
            start, text, name = segments(words, head)
            k = np.arange(len(start)) - np.searchsorted(text, text)
            before = np.append(np.uint64(0), name[:-1]).view(np.int64)
            rare = np.nonzero(words.ids < 0)[0]
            length = pc.binary_length(words.distinct).to_numpy(zero_copy_only=False)[words.place[rare]] + 1
            sums = np.bincount(np.searchsorted(words.starts, rare, side="right") - 1, weights=length, minlength=len(held))
            per_text = [pa.array(x) for x in (words.n, np.add.reduceat(head.known[words.ids].astype(np.int64), words.starts), np.add.reduceat(head.base[words.ids], words.starts), np.add.reduceat(head.size[words.ids], words.starts) + sums.astype(np.int64))]
            at = pa.array(np.where(k == 0, text, -1), pa.int64(), mask=k > 0)
            own = pa.StructArray.from_arrays([x.take(at) for x in (b.column(1), *per_text)], names=["doc_id", "n", "known", "base", "bytes"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(rare, start), len(rare)), pa.int32()), words.distinct.take(pa.array(words.place[rare])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(text)), pa.array(k, pa.int32()), pa.array(held[text]), pa.array(before, pa.int64(), mask=k == 0), pa.array(name.view(np.int64)), pa.array(np.add.reduceat(cost, start)), lists, own],
                names=["rid", "k", "held_out", "h", "s", "lp", "rare", "own"],
            )

    own = f"struct<doc_id:{kind},n:long,known:long,base:double,bytes:long>"
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "t")
    return materialize(numbered.mapInArrow(cut, f"rid long, k int, held_out boolean, h long, s long, lp double, rare array<binary>, own {own}"), "lm-segments")


def predicted(segs: DataFrame) -> DataFrame:
    """(rid, k, seen, only, hit) of each segment: ``seen`` is the count of the prediction, 0
    without one, own occurrences left out. Names and numbers alone meet the predictions."""
    pairs = segs.where(~F.col("held_out") & F.col("h").isNotNull()).groupBy("h", "s").agg(F.count("*").alias("c"))
    # written, so that a segment that very many texts share can be split in the join
    after = materialize(pairs.groupBy("h").agg(F.max(F.struct("c", "s")).alias("top"), F.sum("c").alias("all")), "lm-after")
    both = segs.select("rid", "k", "held_out", "h", "s").join(after, "h", "left")
    equal = F.coalesce(F.col("s") == F.col("top.s"), F.lit(False))
    own = F.when(F.col("held_out"), 0).otherwise(1)
    seen = F.coalesce(F.col("top.c"), F.lit(0)) - F.when(equal, own).otherwise(0)
    out = both.select("rid", "k", equal.alias("equal"), seen.cast("int").alias("seen"), (F.coalesce(F.col("all"), F.lit(0)) - own <= seen).alias("only"))
    return out.withColumn("hit", F.col("equal") & (F.col("seen") > 0)).drop("equal")


def follow(segs: DataFrame, outcomes: DataFrame, kind: str) -> DataFrame:
    """From segments and their predictions' outcomes: a row a text with sums and counts by
    gate and outcome, and a row for each token to spell, paid or not.

    Each segment moves once, and its outcome comes to lie right behind it.
    """
    own = f"struct<doc_id:{kind},n:long,known:long,base:double,bytes:long,held_out:boolean,lp:double,gates:array<int>>"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t, told = t.take(pa.array(np.arange(0, len(t), 2))), t.take(pa.array(np.arange(1, len(t), 2)))
            rid, seen, hit = t.column("rid").to_numpy(), *(told.column(x).to_numpy() for x in ("seen", "hit"))
            hit = hit.astype(bool)
            first = np.append(True, rid[1:] != rid[:-1])
            starts = np.nonzero(first)[0]
            text = np.cumsum(first) - 1
            # hits in a row ahead: since the last miss, or the text's start
            at = np.arange(len(rid))
            missed = np.maximum.accumulate(np.where(np.append(True, ~hit[:-1]) | first, at, 0))
            run = at - missed
            gate = (np.minimum(np.ceil(np.log2(run + 1)), RUNS - 1) * SEEN + np.clip(np.ceil(np.log2(np.maximum(seen, 1))), 0, SEEN - 1)) * 2 + told.column("only").to_numpy().astype(bool)
            decided = seen > 0
            slot = (text * GATES + gate.astype(np.int64)) * 2 + hit
            gates = np.bincount(slot[decided], minlength=len(starts) * GATES * 2).reshape(len(starts), -1)
            lp = np.add.reduceat(np.where(hit, 0.0, t.column("lp").to_numpy()), starts)
            rare = t.column("rare").combine_chunks()
            tokens, parent = rare.flatten(), np.repeat(at, np.diff(rare.offsets.to_numpy()))
            mine = t.column("own").combine_chunks().take(pa.array(starts))
            full = pa.StructArray.from_arrays(
                [*mine.flatten(), t.column("held_out").combine_chunks().take(pa.array(starts)), pa.array(lp), pa.array(list(gates.astype(np.int32)), pa.list_(pa.int32()))], names=["doc_id", "n", "known", "base", "bytes", "held_out", "lp", "gates"]
            )
            none = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(rid[starts]), pa.nulls(none, pa.binary()), pa.nulls(none, pa.bool_()), full], names=["rid", "token", "paid", "own"])
            yield pa.RecordBatch.from_arrays([pa.array(rid[parent]), tokens, pa.array(hit[parent]), pa.nulls(len(tokens), full.type)], names=["rid", "token", "paid", "own"])

        kept: list[pa.RecordBatch] = []
        for b in batches:
            kept.append(b)
            rid = b.column(0).to_numpy()
            # the last text may go on
            if len(rid) and rid[-1] != kept[0].column(0)[0].as_py() and sum(map(len, kept)) > 20_000:
                t = pa.Table.from_batches(kept)
                cut = int(np.searchsorted(t.column(0).to_numpy() == rid[-1], True))
                yield from texts(t.slice(0, cut))
                kept = t.slice(cut).to_batches()
        if sum(map(len, kept)):
            yield from texts(pa.Table.from_batches(kept))

    both = segs.select("rid", "k", "held_out", "lp", "rare", "own").withColumn("told", F.lit(False)).unionByName(outcomes.withColumn("told", F.lit(True)), allowMissingColumns=True)
    ordered = both.repartition("rid").sortWithinPartitions("rid", "k", "told")
    return materialize(ordered.mapInArrow(walk, f"rid long, token binary, paid boolean, own {own}"), "lm-parts")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head_tokens: int = 100_000, bucket_tokens: int = 30_000) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte (of the tokens' bytes, terminators included)."""
    sc = docs.sparkSession.sparkContext
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), t.alias("t"))
    counts = materialize(token_counts(rows), "lm-counts")
    n, v, kinds, size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count("*"), F.coalesce(F.sum(F.col("c") * (F.octet_length("token") + 1)), F.lit(0))).first()
    top = counts.orderBy(F.desc("c"), "token").limit(head_tokens).collect()  # head_tokens rows at most
    head = Head([bytes(r["token"]) for r in top], [r["c"] for r in top], n, v)
    sent_head = sc.broadcast(head)
    last = top[-1] if len(top) == head_tokens else None
    # what comes after the last of the head in the same order
    rare = counts.where((F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("token") > F.lit(bytes(last["token"]))))) if last else counts.limit(0)
    code = prefix_code([bytes(r["token"]) for r in top])
    few = max(1, min(size // 100_000_000 + 1, 2 * sc.defaultParallelism))
    sizes = (_power(kinds, 1 << 8, MOST[0]), _power(2 * kinds, 1 << 8, MOST[1]))
    tables = word_tables(rows, sent_head, sizes, few)
    spelled = spellings(rare, code, _power(16 * kinds, 1 << 12, MOST[2]), max(1, kinds // 500_000), max(1, -(-kinds // bucket_tokens)))
    segs = cut_texts(rows, sent_head, sc.broadcast(tables), sizes)
    parts = follow(segs, predicted(segs), dict(rows.dtypes)["doc_id"])
    whole = parts.where("own IS NOT NULL").select("rid", "own.*")
    # the map of segment decisions: 2 * GATES numbers
    map_ = whole.where("not held_out").agg(*(F.coalesce(F.sum(F.get("gates", F.lit(i))), F.lit(0)).alias(f"g{i}") for i in range(2 * GATES))).first()
    seen = np.array(list(map_), dtype=float).reshape(GATES, 2) + 0.5
    price = F.array(*(F.lit(float(x)) for x in np.log10(seen / seen.sum(axis=1, keepdims=True)).ravel()))
    decided = F.aggregate(F.zip_with("gates", price, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    floor = float(np.log10(n + v + 1))
    zero = F.lit(0).cast("long")
    tokens = parts.where("own IS NULL").groupBy("rid", "token").agg(F.count("*").alias("times"), F.count(F.when(~F.col("paid"), 1)).alias("due")).join(spelled, "token")
    tokens = tokens.select("rid", F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * (F.log10(F.col("c") + 1) - F.lit(floor))).alias("base"), (F.col("due") * F.col("lp")).alias("lp"))
    own = whole.select("rid", "known", "base", (F.col("lp") + decided).alias("lp"), F.struct("doc_id", "held_out", "n", "bytes").alias("own"))
    both = own.unionByName(tokens.withColumn("own", F.lit(None).cast(own.schema["own"].dataType)))
    got = both.groupBy("rid").agg(F.first("own", ignorenulls=True).alias("own"), *(F.sum(x).alias(x) for x in ("known", "base", "lp")))
    return got.select(
        "own.doc_id",
        "own.held_out",
        F.col("own.n").alias("n_tokens"),
        F.col("known").cast("long").alias("n_known"),
        (F.lit(int(n)).cast("long") + zero).alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("lp").alias("score"),
        (-F.col("lp") * float(np.log2(10)) / F.col("own.bytes")).alias("bits_per_byte"),
    )
