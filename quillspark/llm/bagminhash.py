"""Near-duplicate classes by BagMinHash signatures, banding and verified overlap.

A text's words (no white space between) give runs of five words; the multiset of
runs is the text's bag, and two texts are alike if the weighted Jaccard similarity
of their bags is ``threshold`` or more. Texts of one to four words are one run.

Signatures: each run has Poisson processes over discretised weights, hierarchical
in dyadic ranges of levels [0, 1), [1, 2), [2, 4), [4, 8), ...; a range of length
L has rate L. A point has a time, a register and a level, all from hashes of (run,
range, ordinal); it counts if its level lies below the run's weight. A register
keeps the earliest point that hits it, and two bags agree in a register with the
probability of their weighted Jaccard similarity. Points come in order of time, so
a run stops as soon as its next time is later than every register of the text.

Classes: texts that are equal form one node; so do all texts without words. Nodes
that share a band of registers are candidates, and buckets that share nodes form a
group, so that all candidate pairs lie within groups. Candidates are compared by the
texts themselves. A group is cut into blocks, of ``BLOCK`` characters as a rule:

1. Each block is compared within itself and with ``PIVOTS`` members of its group.
   A group of one block, as nearly all are, is done then. Links give components.
2. In a larger group the members outside its largest component, in blocks of their
   own, meet every other block whose sizes don't rule the threshold out. Pairs inside
   the largest component are never sought, since they can't change a class.

Every candidate pair between components is therefore compared; nothing is capped or
sampled. Classes are components of all links, named by the least node in them.

Scale: signatures are computed in one pass without a shuffle, and only band hashes
are shuffled; a band's least node comes from an aggregate with a combiner. Nodes have
numbers given to distinct 128-bit digests of texts. Blocks come from sizes and hashed
numbers, so neither a window nor a task holds a whole group; a comparison holds the
texts of two blocks. A group of copies costs its length, once; the second step costs
the members left over times the group, in rows that number of blocks. Components are
found by repeated joins over links, written to the shared folder between rounds;
neither links nor components reach the driver.

Defined results: a null text is empty; all texts without words form one class;
repeated rows are in their text's class; an empty table gives an empty table; null ids and
other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.core import materialize, small_enough
from quillspark.llm.arrays import release

BANDS, ROWS = 32, 5
#: Characters of a block of texts, and what a text counts at least.
BLOCK, LEAST = 1 << 22, 1 << 13
#: Members of a large group that each of its blocks is compared with at first.
PIVOTS = 8
#: Bytes of files of the names that are sent to all tasks; more meet their texts in a shuffle.
SENT = 64 << 20
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    from hashlib import blake2b

    new = [w for w in set(words) if w not in known]
    if new:
        known.update((w, int.from_bytes(blake2b(w, digest_size=8).digest(), "little")) for w in new)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def runs(words: list[bytes], known: dict[bytes, int], size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of all words if there are fewer."""
    h = word_hashes(words, known)
    n = len(h)
    size = min(size, n)
    out = np.full(max(0, n - size + 1) if n else 0, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        out = mix64(out * _GOLD + h[j : n - size + 1 + j])
    return out


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) earliest times; ``owner`` says which of n bags an element belongs to."""
    reg = np.full(n * m, np.inf)
    # a process for each element and dyadic range of levels that its weight reaches
    top = np.zeros(len(weights), dtype=np.int64)
    top[weights > 1] = np.floor(np.log2(weights[weights > 1] - 1)).astype(np.int64) + 1
    counts = top + 1
    of = np.repeat(np.arange(len(elements)), counts)
    rng = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    low = np.where(rng == 0, 0, 1 << np.maximum(rng - 1, 0)).astype(np.float64)
    length = np.where(rng <= 1, 1, 1 << np.maximum(rng - 1, 0)).astype(np.float64)
    seed = mix64(elements[of] + rng.astype(np.uint64) * _GOLD)
    weight, bag = weights[of].astype(np.float64), owner[of]
    t = np.zeros(len(of))
    worst = np.full(n, np.inf)
    k = 0
    while len(seed):
        k += 1
        a = mix64(seed + np.uint64(k * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        b = mix64(a ^ _M1)
        t = t - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        fits = t < worst[bag]
        if not fits.all():
            seed, t, low, length, weight, bag, b = (x[fits] for x in (seed, t, low, length, weight, bag, b))
        level = low + length * ((b >> np.uint64(40)).astype(np.float64) * 2.0**-24)
        hit = level < weight
        slot = bag * m + ((b & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(reg, slot[hit], t[hit])
        if k >= 2:
            worst = reg.reshape(n, m).max(axis=1)
    return reg.reshape(n, m)


def band_hashes(reg: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(reg).view(np.uint64).reshape(len(reg), bands, rows)
    out = np.arange(bands, dtype=np.uint64)[None, :] * _GOLD + np.uint64(1)
    for r in range(rows):
        out = mix64(out + bits[:, :, r])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags, each (sorted distinct runs, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    every = int(a[1].sum() + b[1].sum()) - both
    return both / every if every else 1.0


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, name, t): ``name`` is the digest of the text, of the empty one if it has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), t.alias("t")).select("doc_id", F.unhex(F.md5(F.encode(F.when(F.col("t").rlike(r"[^\x20\x09-\x0D]"), F.col("t")).otherwise(""), "UTF-8"))).alias("name"), "t")


def _slices(batch: pa.RecordBatch, column: int, rows: int = 400, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``rows`` rows whose texts take ``size`` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right"))
        hi = min(max(hi, lo + 1), lo + rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def band_rows(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(name, bands, size, chars) for each row (name, t) of ``texts``: band hashes, none
    without words; the number of runs; the text's length."""
    m = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known: dict[bytes, int] = {}
        for whole in batches:
            for b in _slices(whole, 1):
                if len(known) > 500_000:
                    known.clear()
                bags = [np.unique(runs(x.encode("utf-8", "surrogatepass").split(), known), return_counts=True) for x in b.column(1).to_pylist()]
                full = [i for i, x in enumerate(bags) if len(x[0])]
                keys: list = [[] for _ in bags]
                if full:
                    e = np.concatenate([bags[i][0] for i in full])
                    w = np.concatenate([bags[i][1] for i in full])
                    owner = np.repeat(np.arange(len(full)), [len(bags[i][0]) for i in full])
                    for i, k in zip(full, band_hashes(signatures(e, w, owner, len(full), m), bands, rows), strict=True):
                        keys[i] = k
                chars = pc.utf8_length(b.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array([int(x[1].sum()) for x in bags], pa.int64()), chars], names=["name", "bands", "size", "chars"])

    return texts.mapInArrow(sign, "name binary, bands array<long>, size long, chars long")


def _pairs_within(buckets: DataFrame) -> DataFrame:
    """Pairs that connect each bucket's nodes: a node with the least of its buckets' least nodes, and that one with the others.

    Those others are few in a large group, so its pairs number about its nodes, however many bands they share.
    """
    least = buckets.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("z")).where("least < z").select("band", "least")
    # at most one a band
    of = buckets.join(least, "band").groupBy("node").agg(F.min("least").alias("a"), F.collect_set("least").alias("leasts"))
    return of.select("a", F.explode(F.array_union(F.array("node"), "leasts")).alias("b")).where("a < b").distinct()


def _blocks(members: DataFrame, by: list[str], block: int) -> DataFrame:
    """Adds ``block`` to (node, size, chars, columns ``by``).

    Members that fit together into a block form block (0, 0). Others are split by
    size in steps of a tenth, and a step by its members' numbers.
    """
    cost = F.greatest("chars", F.lit(LEAST))
    step = F.floor(F.log(1.1, F.col("size").cast("double"))).cast("int")
    whole = members.groupBy(*by).agg(F.sum(cost).alias("cost")).withColumn("large", F.col("cost") > block).select(*by, "large")
    # number of a step's blocks; members that fit are one step
    placed = members.join(whole, by).withColumn("step", F.when(F.col("large"), step).otherwise(0))
    many = placed.groupBy(*by, "step").agg(F.ceil(F.sum(cost) / block).alias("many"))
    at = F.when(F.col("large"), F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(0).cast("int")
    return placed.join(many, [*by, "step"]).withColumn("block", F.struct("step", at.alias("at"))).drop("many", "step")


def first_comparisons(placed: DataFrame) -> DataFrame:
    """(node, of, i, j): each block of a group with itself and the group's pivots.

    ``placed`` has node, of, block and large. Pivots are the nodes with the least hashes.
    """
    own = placed.select("node", "of", F.col("block").alias("i"), F.col("block").alias("j"))
    large = placed.where("large")
    least = large.groupBy("of").agg(*(F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node"))["node"].alias(f"p{k}") for k in range(PIVOTS)))
    pivots = least.select("of", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("node"))
    met = large.select("of", "block").distinct().join(pivots, "of").select("node", "of", F.col("block").alias("i"), F.col("block").alias("j"))
    return own.unionByName(met).distinct()


def further_comparisons(large: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, of, i, j) for groups of more than a block: those outside the group's largest
    component against all, where sizes allow it. ``large`` has node, of, size and chars."""
    named = large.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    # the component with most nodes, the least of those
    most = named.groupBy("of", "class").count().groupBy("of").agg(F.max(F.struct("count", (-F.col("class")).alias("c")))["c"].alias("c"), F.count("*").alias("classes"))
    opened = named.join(most.where("classes > 1"), "of").withColumn("rest", (F.col("class") != -F.col("c")).cast("int"))
    placed = materialize(_blocks(opened.select("node", "of", "size", "chars", "rest"), ["of", "rest"], block).withColumn("block", F.struct("rest", "block.step", "block.at")).select("node", "of", "size", "block"), "near-placed")
    spans = placed.groupBy("of", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    x = spans.select("of", F.col("block").alias("i"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
    y = spans.where("block.rest = 1").select("of", F.col("block").alias("j"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"))
    # similarity is at most the ratio of sizes
    reach = (F.col("i") <= F.col("j")) & (F.col("xlo") * threshold <= F.col("yhi")) & (F.col("ylo") * threshold <= F.col("xhi"))
    meets = x.join(y, "of").where(reach).select("of", "i", "j").withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    return placed.join(meets, ["of", "block"]).select("node", "of", "i", "j")


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(n, n) sizes of the intersections of bags, each (distinct runs, counts)."""
    n = len(bags)
    counts = np.concatenate([c for _, c in bags])
    doc = np.repeat(np.arange(n), [len(e) for e, _ in bags])
    _, code = np.unique(np.concatenate([e for e, _ in bags]), return_inverse=True)
    # the k-th occurrence of a run is an element of its own, so bags become sets
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    _, code, often = np.unique(np.repeat(code, counts) * int(counts.max()) + nth, return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    doc = np.repeat(doc, counts)[order]
    starts = np.cumsum(often) - often
    both = np.zeros((n, n))
    common = max(8, n // 16)
    for k in np.unique(often[(often > 1) & (often <= common)]):
        at = starts[often == k]
        for lo in range(0, len(at), max(1, 2_000_000 // (k * k))):
            who = doc[at[lo : lo + max(1, 2_000_000 // (k * k)), None] + np.arange(k)]
            both += np.bincount((who[:, :, None] * n + who[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    dense = np.nonzero(often > common)[0]
    for lo in range(0, len(dense), 4096):
        part = dense[lo : lo + 4096]
        held = np.zeros((n, len(part)), dtype=np.float32)
        column = np.repeat(np.arange(len(part)), often[part])
        held[doc[np.repeat(starts[part] - np.cumsum(often[part]) + often[part], often[part]) + np.arange(len(column))], column] = 1
        both += held @ held.T
    np.fill_diagonal(both, [c.sum() for _, c in bags])
    return both


def alike(bags: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Links that join the same bags as all pairs at ``threshold`` or more do."""
    if len(bags) == 2:
        return [(0, 1)] if similarity(*bags) >= threshold else []
    both = overlaps(bags)
    sizes = both.diagonal()
    near = both / (sizes[:, None] + sizes[None, :] - both) >= threshold
    links, left = [], np.ones(len(bags), dtype=bool)
    for first in range(len(bags)):
        if not left[first]:
            continue
        left[first] = False
        ahead = [first]
        while ahead:
            new = np.nonzero(near[ahead.pop()] & left)[0].tolist()
            left[new] = False
            ahead += new
            links += [(first, x) for x in new]
    return links


def compare(placed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) within the comparisons of ``placed`` (node, of, i, j).

    ``texts`` has a row (node, t) a node. Comparisons are read as a stream; one is held.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        now, nodes, bags = None, [], []

        def done() -> pa.RecordBatch:
            got = alike(bags, threshold) if len(bags) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in got], pa.int64()), pa.array([nodes[y] for _, y in got], pa.int64())], names=["a", "b"])

        for whole in batches:
            for batch in _slices(whole, 2):
                for key, node, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if key != now:
                        if len(bags) > 1:
                            yield done()
                        now, nodes, bags = key, [], []
                    if len(known) > 500_000:
                        known.clear()
                    nodes.append(node)
                    bags.append(np.unique(runs(t.encode("utf-8", "surrogatepass").split(), known), return_counts=True))
        if len(bags) > 1:
            yield done()

    # comparisons of one node need no texts
    rows = placed.select("node", F.to_json(F.struct("of", "i", "j")).alias("key"))
    rows = rows.join(texts, "node").select("key", "node", "t")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(links, "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, class): the least node that links lead to, for nodes with links.

    A round hooks each node to its least neighbour, jumps along hooks to their ends and gives
    the links the ends' names; links inside a class fall away, so each round has fewer. The
    rounds' classes are put together at the end.
    """
    least, greatest = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialize(links.select(least, greatest).distinct(), f"{name}-links")
    rounds = []
    for step in range(64):
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("class"))
        now = materialize(now, f"{name}-{step}")
        for jumps in range(64):
            further = now.select(F.col("node").alias("class"), F.col("class").alias("further"))
            jumped = now.join(further, "class").select("node", F.col("further").alias("class"), (F.col("further") != F.col("class")).alias("moved"))
            jumped = materialize(jumped, f"{name}-{step}-{jumps}")
            now = jumped.select("node", "class")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(now)
        of = lambda c, to: rounds[-1].select(F.col("node").alias(c), F.col("class").alias(to))
        left = edges.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = materialize(left, f"{name}-links-{step}")
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    classes = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        then = classes.select(F.col("node").alias("class"), F.col("class").alias("further"))
        classes = earlier.join(then, "class", "left").select("node", F.coalesce("further", "class").alias("class"))
    return materialize(classes, name) if len(rounds) > 1 else classes


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, node, class): rows with one class are near duplicates, linked directly
    or through others. ``node`` numbers the text; ``class`` is the class's least node."""
    everything = _named(docs, doc_id, text)
    signed = band_rows(everything.select("name", "t"), bands, rows).dropDuplicates(["name"])
    # written, so that numbers stay what they are
    shingled = materialize(signed.withColumn("node", F.monotonically_increasing_id()), "near-bands")
    numbers = shingled.select("name", "node")
    shared = materialize(_pairs_within(shingled.select("node", F.explode("bands").alias("band"))), "near-shared")
    groups = components(shared, "near-groups").withColumnRenamed("class", "of")
    wanted = shingled.join(groups, "node").select("node", "name", "of", "size", "chars")
    wanted = materialize(wanted, "near-wanted")
    names = wanted.select("name", "node")
    # texts move only if there are too many names to send
    names = F.broadcast(names) if small_enough(docs.sparkSession, names, SENT) else names
    texts = everything.select("name", "t").join(names, "name").groupBy("node").agg(F.min("t").alias("t"))
    texts = materialize(texts, "near-texts")
    placed = materialize(_blocks(wanted.drop("name"), ["of"], block), "near-blocks")
    links = materialize(compare(first_comparisons(placed), texts, threshold), "near-links")
    named = components(links, "near")
    large = placed.where("large").select("node", "of", "size", "chars")
    if not large.isEmpty():
        further = materialize(compare(further_comparisons(large, named, threshold, block), texts, threshold), "near-further")
        named = components(links.unionByName(further), "near-all")
    members = everything.select("doc_id", "name").join(numbers, "name")
    return materialize(members.join(named, "node", "left").select("doc_id", "node", F.coalesce("class", "node").alias("class")), "near-classes")
