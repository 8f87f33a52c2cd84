"""Quality rules with robust multivariate outlier rejection.

A pass over the texts computes counts and a vector of transformed statistics. Three
levels of groups get a minimum-covariance-determinant estimate of centre and scatter:
all rows, each language, each source of a language. An estimate has several fixed
starts (deviations along the axes; signs in space; correlations of squashed values).
From each, concentration steps keep the ``coverage`` share of rows with the least
Mahalanobis distances and estimate anew from these, which does not increase the
determinant; the start that ends with the least determinant wins, and a last step
reweights with all rows within the inner cutoff. Estimates are then shrunk towards
the level above as if that gave ``prior_rows`` more rows, so a source has an estimate
of its own at every size, and it counts the more the more rows it has. Rows whose
distance under their source's estimate exceeds the outer cutoff are rejected.

Scale: texts are read once and never shuffled. A step is one grouped aggregate:
rows are summed by group, start and distance cell (``CELLS`` cells at most), so a
group of any size, or one that holds a third of all rows, is combined before the
shuffle and the smallest distances are found from its cells, over all rows; the cell
at the border is kept whole. Estimates are a row a group and stay in tables.

Defined results: a null or empty text has no words and fails the fixed rules; null
languages and sources are groups of their own; repeated rows count as often as
they stand; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.core import join_on, materialize

#: Transformed statistics and the least scatter that counts for each: word length
#: (log), symbols a character, repeated lines a line, repeated words a word (square
#: roots of shares), and distinct words (log, against the log of all words).
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "variety")
FLOORS = (0.04, 0.06, 0.12, 0.12, 0.05)
P = len(FEATURES)
#: Distance cells: floor of CELLS_LOG * log(1 + squared distance), CELLS at most.
CELLS, CELLS_LOG = 4096, 128.0


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    coverage: float = 0.75
    steps: int = 4
    #: Rows that the estimate of the level above counts for.
    prior_rows: float = 40.0
    #: Normal quantiles whose chi-square counterparts are the cutoffs.
    inner_z: float = 2.0
    outer_z: float = 5.0


def chi_square(z: float, p: int = P) -> float:
    """Quantile of chi-square by the cube-root approximation of Wilson and Hilferty."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def text_statistics(text: str, window: int = 8) -> tuple[int, int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, distinct words)."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > window:
        h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
        m = n - window + 1
        grams = np.zeros(m, dtype=np.uint64)
        for j in range(window):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
        grams ^= grams >> np.uint64(29)
        _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        if twice.any():
            edge = np.zeros(n + 1, dtype=np.int64)
            edge[:m] += twice
            edge[window : window + m] -= twice
            repeated = int((np.cumsum(edge) > 0).sum())
    return n, chars, symbols, dup, repeated, len(lines), len(set(words))


def features(n: int, chars: int, symbols: int, dup: int, repeated: int, lines: int, distinct: int) -> list[float]:
    if not n:
        return [0.0] * P
    variety = np.log(distinct) / np.log(n) if n > 1 else 1.0
    return [float(np.log(chars / n)), (symbols / chars) ** 0.5, (dup / lines) ** 0.5, (repeated / n) ** 0.5, float(variety)]


def statistics(docs: DataFrame, cfg: QualityConfig, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A row a document: doc_id, lang, source, counts and f0, f1, ... Not yet written."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"doc_id {kind}, lang string, source string, " + ", ".join(f"{x} long" for x in names) + "".join(f", f{i} double" for i in range(P))
    window = cfg.window

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_statistics(t, window) for t in b.column(3).to_pylist()]
            out = [b.column(0), b.column(1), b.column(2)]
            out += [pa.array([g[k] for g in got], pa.int64()) for k in range(5)]
            f = [features(*g) for g in got]
            out += [pa.array([x[k] for x in f], pa.float64()) for k in range(P)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang", "source", *names, *(f"f{i}" for i in range(P))])

    return rows.mapInArrow(count, schema)


LEVEL = ["level", "lang", "source"]


def _levels(rows: DataFrame) -> DataFrame:
    """Each row once for all rows (level 0), its language (1) and its source (2)."""
    none = F.lit(None).cast("string")
    at = F.array(*(F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, (a, b) in enumerate(((none, none), (F.col("lang"), none), (F.col("lang"), F.col("source"))))))
    values = [f"f{i}" for i in range(P)]
    return rows.select(F.explode(at).alias("at"), *values).select("at.*", *values)


def _medians(rows: DataFrame, keys: list[str], values: list[Column], cells: float = 1024.0) -> DataFrame:
    """Medians of several columns a group, to 1 / cells, by counts of cells."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(v * cells).alias("cell")) for i, v in enumerate(values))))
    counts = rows.select(*keys, pairs.alias("x")).groupBy(*keys, "x.i", "x.cell").agg(F.count("*").alias("n"))
    within = Window.partitionBy(*keys, "i")
    up = within.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    middle = counts.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(within)).where(F.col("upto") * 2 >= F.col("all"))
    each = middle.groupBy(*keys, "i").agg(F.min("cell").alias("cell"))
    got = [F.max(F.when(F.col("i") == i, (F.col("cell") + 0.5) / cells)).alias(f"m{i}") for i in range(len(values))]
    return each.groupBy(*keys).agg(*got)


def _squared_distance() -> Column:
    d = [F.col(f"f{i}") - F.get("centre", F.lit(i)) for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + d[i] * d[j] * (F.get("precision", F.lit(i * P + j)) * (1 if i == j else 2))
    return total


ESTIMATE = "level int, lang string, source string, start int, centre array<double>, precision array<double>, logdet double"


def _estimates(frame: pd.DataFrame, start: list, centres: list, scatters: list) -> pd.DataFrame:
    floors = np.diag(np.square(FLOORS))
    whole = [v + floors for v in scatters]
    return frame[LEVEL].assign(start=start, centre=[c.tolist() for c in centres], precision=[np.linalg.inv(v).ravel().tolist() for v in whole], logdet=[float(np.linalg.slogdet(v)[1]) for v in whole])


def _moments(s: list, q: list, n: float) -> tuple[np.ndarray, np.ndarray]:
    c = np.asarray(s, dtype=float) / n
    return c, np.asarray(q, dtype=float).reshape(P, P) / n - np.outer(c, c)


def _sums(values: list[Column] | None = None, mark: str = "") -> list[Column]:
    values = values or [F.col(f"f{i}") for i in range(P)]
    s = [F.sum(values[i]).alias(f"s{mark}{i}") for i in range(P)]
    q = [F.sum(values[i] * values[j]).alias(f"q{mark}{i}_{j}") for i in range(P) for j in range(i, P)]
    return [*s, *q]


def _packed(mark: str = "") -> list[Column]:
    """Columns of ``_sums`` as two arrays."""
    s = F.array(*(F.col(f"s{mark}{i}") for i in range(P)))
    q = F.array(*(F.col(f"q{mark}{min(i, j)}_{max(i, j)}") for i in range(P) for j in range(P)))
    return [s.alias(f"s{mark}"), q.alias(f"q{mark}")]


def _starts(rows: DataFrame) -> DataFrame:
    """The starting estimates of each group."""
    centre = materialize(_medians(rows, LEVEL, [F.col(f"f{i}") for i in range(P)]), "quality-medians")
    off = join_on(rows, centre, LEVEL)
    mad = _medians(off, LEVEL, [F.abs(F.col(f"f{i}") - F.col(f"m{i}")) for i in range(P)]).withColumnsRenamed({f"m{i}": f"d{i}" for i in range(P)})
    robust = materialize(join_on(centre, mad, LEVEL), "quality-scales")
    near = join_on(rows, robust, LEVEL)
    z = [(F.col(f"f{i}") - F.col(f"m{i}")) / (F.col(f"d{i}") * 1.4826 + FLOORS[i]) for i in range(P)]
    near = near.select(*LEVEL, *(F.col(f"{k}{i}") for k in "md" for i in range(P)), *(z[i].alias(f"z{i}") for i in range(P)))
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(1e-9)))
    sums = near.groupBy(*LEVEL, *(f"{k}{i}" for k in "md" for i in range(P))).agg(F.count("*").alias("n"), *_sums([F.col(f"z{i}") / norm for i in range(P)], "u"), *_sums([F.tanh(F.col(f"z{i}")) for i in range(P)], "t"))
    packed = sums.select(*LEVEL, "n", F.array(*(f"m{i}" for i in range(P))).alias("m"), F.array(*(f"d{i}" for i in range(P))).alias("d"), *_packed("u"), *_packed("t"))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            centres = [np.asarray(m, dtype=float) for m in f["m"]]
            scales = [1.4826 * np.asarray(d, dtype=float) for d in f["d"]]
            signs = [np.asarray(q, dtype=float).reshape(P, P) / n * P for q, n in zip(f["qu"], f["n"], strict=True)]
            squashed = []
            for s, q, n in zip(f["st"], f["qt"], f["n"], strict=True):
                v = _moments(s, q, n)[1] + 1e-6 * np.eye(P)
                squashed.append(v / np.sqrt(np.outer(v.diagonal(), v.diagonal())))
            for k, shape in enumerate(([np.eye(P)] * len(f), signs, squashed)):
                yield _estimates(f, [k] * len(f), centres, [np.outer(d, d) * r for d, r in zip(scales, shape, strict=True)])

    return packed.mapInPandas(make, ESTIMATE)


def least_determinants(usable: DataFrame, cfg: QualityConfig) -> DataFrame:
    """The estimate of each group with the least determinant: ``ESTIMATE``."""
    rows = _levels(usable)
    estimate = materialize(_starts(rows), "quality-start")
    cell = F.least(F.lit(CELLS - 1), F.floor(F.log1p(F.greatest(_squared_distance(), F.lit(0.0))) * CELLS_LOG)).cast("int")
    keys = [*LEVEL, "start"]

    def renew(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [_moments(s, q, n) for s, q, n in zip(f["s"], f["q"], f["n"], strict=True)]
            # the kept share of a normal distribution has less scatter than the whole
            yield _estimates(f, f["start"].tolist(), [c for c, _ in got], [v / cfg.coverage for _, v in got])

    for step in range(cfg.steps):
        near = join_on(rows, estimate, LEVEL).withColumn("cell", cell)
        cells = near.groupBy(*keys, "cell").agg(F.count("*").alias("n"), *_sums())
        within = Window.partitionBy(*keys)
        ahead = F.coalesce(F.sum("n").over(within.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = cells.withColumn("ahead", ahead).withColumn("rows", F.sum("n").over(within)).where(F.col("ahead") < F.ceil(F.col("rows") * cfg.coverage))
        names = [f"s{i}" for i in range(P)] + [f"q{i}_{j}" for i in range(P) for j in range(i, P)]
        total = kept.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names))
        estimate = materialize(total.select(*keys, "n", *_packed()).mapInPandas(renew, ESTIMATE), f"quality-step{step}")
    best = estimate.groupBy(*LEVEL).agg(F.min(F.struct("logdet", "start", "centre", "precision")).alias("best"))
    return materialize(best.select(*LEVEL, "best.start", "best.centre", "best.precision", "best.logdet"), "quality-best")


def outlier_distances(stats: DataFrame, cfg: QualityConfig) -> DataFrame:
    """Adds ``distance``, the squared Mahalanobis distance of a row under its source's
    final estimate; null where all rows of the source fail the fixed rules.

    ``stats`` has lang, source, f0, ... and base_failed; rows that fail the fixed
    rules take no part in the estimates.
    """
    usable = stats.where(~F.col("base_failed"))
    best = least_determinants(usable, cfg)
    near = join_on(_levels(usable), best, LEVEL).where(_squared_distance() <= chi_square(cfg.inner_z))
    sums = near.groupBy(*LEVEL).agg(F.count("*").alias("n"), *_sums()).select(*LEVEL, "n", *_packed())
    # where no row is that near, the estimate alone says where the group is
    final = join_on(best.select(*LEVEL, "centre"), sums, LEVEL, "left")
    final = materialize(final.select(*LEVEL, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "centre", "s", "q").alias("own")), "quality-final")
    chain = final.where("level = 2").select("lang", "source", F.col("own").alias("own2"))
    chain = join_on(chain, final.where("level = 1").select("lang", F.col("own").alias("own1")), ["lang"])
    chain = chain.join(final.where("level = 0").select(F.col("own").alias("own0")), F.lit(True))  # one row, all rows' estimate

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors = np.diag(np.square(FLOORS))
        for f in frames:
            centres, precisions = [], []
            for levels in zip(f["own0"], f["own1"], f["own2"], strict=True):
                centre, scatter, prior = np.asarray(levels[0]["centre"], dtype=float), np.zeros((P, P)), 0.0
                for own in levels:
                    n = float(own["n"])
                    if n:
                        c, v = _moments(own["s"], own["q"], n)
                        w = n / (n + prior)
                        off = np.outer(c - centre, c - centre)
                        centre, scatter = w * c + (1 - w) * centre, w * 1.05 * v + (1 - w) * scatter + w * (1 - w) * off
                    prior = cfg.prior_rows
                centres.append(centre.tolist())
                precisions.append(np.linalg.inv(scatter + floors).ravel().tolist())
            yield f[["lang", "source"]].assign(centre=centres, precision=precisions)

    shrunk = materialize(chain.mapInPandas(shrink, "lang string, source string, centre array<double>, precision array<double>"), "quality-shrunk")
    return join_on(stats, shrunk, ["lang", "source"], "left").withColumn("distance", _squared_distance()).drop("centre", "precision")


def quality_verdicts(docs: DataFrame, cfg: QualityConfig | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A row a document: doc_id, lang, source, the counts, base_failed, distance, kept."""
    cfg = cfg or QualityConfig()
    stats = statistics(docs, cfg, doc_id, text, lang, source)
    failed = (F.col("n_words") < cfg.min_words) | (100 * F.col("n_repeat_words") > cfg.max_repeat_percent * F.col("n_words"))
    stats = materialize(stats.withColumn("base_failed", failed), "quality-stats")
    far = outlier_distances(stats, cfg)
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= chi_square(cfg.outer_z)))
    return far.withColumn("kept", kept)
