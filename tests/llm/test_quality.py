import random
from collections import Counter

import numpy as np

from quillspark.llm.quality import FLOORS, P, QualityConfig, least_determinants, quality_verdicts, text_statistics


def brute(text):
    words, cur = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_statistics():
    random.seed(3)
    for _ in range(60):
        t = "".join(random.choice("ab c\n\t#|\xa0é") for _ in range(random.randrange(300)))
        assert text_statistics(t)[:5] == brute(t)
    assert text_statistics("same line\n" * 50)[:5] == brute("same line\n" * 50)


def test_outliers_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        n = int(rng.integers(40, 200))
        rows.append((i, " ".join("abcdefghij"[: int(k)] + str(int(rng.integers(0, 500))) for k in rng.integers(1, 9, n)), "en", "s" if i % 3 else None))
    for i in range(400, 410):
        rows.append((i, " ".join("##$$%%" for _ in range(60)) + " ".join(str(k) for k in range(40)), "en", "s"))
    got = {r["doc_id"]: r["kept"] for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(400)) and not any(got[i] for i in range(400, 410))


def test_odd_rows(odd, empty):
    got = quality_verdicts(odd).collect()
    assert len(got) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 20)
    assert quality_verdicts(empty).count() == 0


def numpy_mcd(x, coverage, starts=300):
    """Least log determinant over many random starts, with the operator's floors."""
    rng, floors, h = np.random.default_rng(0), np.diag(np.square(FLOORS)), int(np.ceil(len(x) * coverage))
    best = np.inf
    for _ in range(starts):
        keep = rng.choice(len(x), P + 1, replace=False)
        for _ in range(12):
            c, v = x[keep].mean(axis=0), np.cov(x[keep].T, bias=True) / coverage + floors
            keep = np.argsort(np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(v), x - c))[:h]
        best = min(best, np.linalg.slogdet(np.cov(x[keep].T, bias=True) / coverage + floors)[1])
    return best


def test_determinants_against_numpy(spark):
    rng = np.random.default_rng(7)
    rows, groups = [], {}
    for g, (n, bad) in enumerate(((12, 2), (80, 16), (300, 40))):
        a = rng.normal(size=(P, P)) * 0.4
        x = rng.normal(size=(n, P)) @ a + g
        x[:bad] = rng.normal(size=(bad, P)) * 0.1 + 6
        groups[f"s{g}"] = x
        rows += [("en", f"s{g}", *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"f{i} double" for i in range(P)))
    cfg = QualityConfig(steps=8)
    got = {r["source"]: r for r in least_determinants(df, cfg).where("level = 2").collect()}
    for g, x in groups.items():
        # cells keep slightly more rows than the share, so the determinant may be a little larger
        assert got[g]["logdet"] < numpy_mcd(x, cfg.coverage) + 0.35
        assert abs(np.array(got[g]["centre"]) - int(g[1:])).max() < 1


def test_a_small_source_has_its_own_estimate(spark):
    rng = np.random.default_rng(9)

    def text(length, n=60):
        return " ".join("abcdefghijklmnop"[:length] + str(int(k)) for k in rng.integers(0, 900, n))

    rows = [(i, text(3), "en", "a") for i in range(300)] + [(1000 + i, text(9), "en", "b") for i in range(25)]
    got = {r["doc_id"]: r for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r["distance"] is not None for r in got.values())
    assert all(got[i]["kept"] for i in range(300)) and all(got[1000 + i]["kept"] for i in range(25))
