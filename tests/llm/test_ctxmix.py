import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm.ctxmix import DEPTH, LEAVES, RATE, START, STEP, Head, Letters, Mixer, Words, _bucket, chain, count_letters, count_words, letter_mixer, letter_sizes, prefix_code, score_documents, word_costs


def brute(rows):
    held = [zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, _ in rows]
    toks = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    c = Counter(w for h, ws in zip(held, toks, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return {(d, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (d, _), h, ws in zip(rows, held, toks, strict=True)}


def test_spellings_sum_to_one():
    words = [b"the", b"then", b"thing", b"cat"]
    code, slots = prefix_code(words), 1 << 12
    table = np.zeros(2 * sum(letter_sizes(slots)), dtype=np.float32)
    count_letters(words, np.array([9, 2, 1, 4]), code, slots, table)
    # the decisions of one byte after "t", for all bytes: those of a longer token follow
    mixer = letter_mixer()
    got = 0.0
    for b in range(256):
        l = Letters([b"t" + bytes([b])] if b != 32 else [b"t"], code, slots)
        n = int(code[0][ord("t")])
        part = slice(n, n + int(code[0][b]))
        x, seen = chain([(table[s[part] * 2], table[s[part] * 2 + 1]) for s in l.slots], np.full(part.stop - n, 0.5), 1.0)
        got += 10 ** mixer.cost(x, _bucket(seen), l.bit[part], learn=False).sum()
    assert got == pytest.approx(1, abs=1e-4)


def test_classes_sum_to_one():
    head = Head([f"w{k}".encode() for k in range(500)], [1000 // (k + 1) for k in range(500)], 9000, 700)
    assert np.bincount(head.leaf[:-1], weights=10 ** head.residual[:-1], minlength=LEAVES)[np.unique(head.leaf[:-1])] == pytest.approx(1)
    sizes, texts = (256, 256), ["w1 w2 w3 w4 strange w1"] * 3
    one, two = (np.zeros(n * LEAVES * 2, dtype=np.float32) for n in sizes)
    words = Words(texts, head)
    count_words(words, sizes, one, two)
    # every class after the same two words
    got, mixer = 0.0, Mixer(4 * DEPTH, (0.1, 0.35, 0.55), 0.02)
    for leaf in range(LEAVES):
        words.leaf = np.full(len(words.ids), leaf)
        cost = 0.0
        for j, (node, bit, a, b) in enumerate(words.path(sizes, np.array([3]))):
            x, seen = chain([(t[s * 2], t[s * 2 + 1]) for t, s in ((one, a), (two, b))], head.prior[node], 2.0)
            cost += mixer.cost([np.log(head.prior[node] / (1 - head.prior[node])), *x], j * 4 + _bucket(seen), bit, learn=False)[0]
        got += 10**cost
    assert got == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("head", [100_000, 2])
def test_counts_and_base(spark, odd, empty, head):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(30 + i, f"the cat number {i} İ É sat") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = score_documents(df, head_tokens=head, bucket_tokens=100).collect()
    assert len(got) == len(rows) and all(r["score"] < 0 for r in got)
    assert {(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got} == brute(rows)
    if head == 2:
        assert score_documents(empty).count() == 0


def test_held_out_words_are_cheap_when_learned(spark):
    rows = [(i, " ".join(f"thing{(i * k) % 37}" for k in range(60))) for i in range(150)] + [(1000 + i, " ".join("qzx" + str((i * k * 7919) % 100_000) for k in range(60))) for i in range(30)]
    got = {r["doc_id"]: (r["held_out"], r["bits_per_byte"]) for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    usual = [b for d, (h, b) in got.items() if h and d < 1000]
    strange = [b for d, (h, b) in got.items() if h and d >= 1000]
    assert usual and strange and max(usual) < min(strange)


def test_context_counts(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{k}" for k in range(300)]

    def fresh():
        return " ".join(vocabulary[k] for k in rng.integers(0, 300, 400))

    once = [(i, fresh()) for i in range(60)]
    twice = [(100 + 2 * i + j, t) for i in range(8) for t in [fresh()] for j in (0, 1)]
    # each word is followed by one of two words
    step = {k: rng.integers(0, 300, 2) for k in range(300)}
    chained = []
    for i in range(60):
        k, words = int(rng.integers(0, 300)), []
        for _ in range(400):
            words.append(vocabulary[k])
            k = int(step[k][rng.integers(0, 2)])
        chained.append((1000 + i, " ".join(words)))
    df = spark.createDataFrame(once + twice + chained, "doc_id long, text string")
    got = {r["doc_id"]: r["bits_per_byte"] for r in score_documents(df).collect()}
    usual = [got[d] for d, _ in once]
    # those whose copy was learned
    learned = [d for d, _ in twice if zlib.crc32(str(d ^ 1).encode()) % 7 != 2]
    assert len(learned) > 8 and max(got[d] for d in learned) < 0.5 * min(usual)
    assert max(got[d] for d, _ in chained) < 0.85 * min(usual)
    # the same words in another order cost more
    mixed = [(d, " ".join(rng.permutation(t.split()))) if d < 1010 and d >= 1000 else (d, t) for d, t in once + twice + chained]
    other = {r["doc_id"]: r["bits_per_byte"] for r in score_documents(spark.createDataFrame(mixed, "doc_id long, text string")).collect()}
    assert all(other[d] > got[d] for d in range(1000, 1010))


def test_one_long_token(spark):
    rows = [(1, "x" * 3_000_000), (2, "a b " * 20), (3, None), (3, None)]
    got = sorted((r["doc_id"], r["n_tokens"]) for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), head_tokens=2).collect())
    assert got == [(1, 2), (2, 41), (3, 1), (3, 1)]


def plain_word_costs(texts, own, head, sizes, one, two):
    """The word model's costs word by word and decision by decision, in double precision."""
    logit = lambda p: math.log(p / (1 - p))
    words, out, at = Words(texts, head), [], 0
    slots = {j: step for j, step in enumerate(words.path(sizes, slice(None)))}
    for t, n in enumerate(words.n):
        weights = {}
        for lo in range(0, n, STEP):
            waiting = {}
            for i in range(at + lo, at + min(lo + STEP, n)):
                cost = float(head.residual[words.ids[i]])
                for j in range(DEPTH):
                    node, bit, a, b = (int(x[i]) for x in slots[j])
                    p, x = float(head.prior[node]), [float(head.prior_logit[node])]
                    for table, slot in ((one, a), (two, b)):
                        n0, n1 = (max(0.0, float(table[2 * slot + k]) - (own[t] and bit == k)) for k in (0, 1))
                        p = min(max((n1 + 2 * p) / (n0 + n1 + 2), 1e-5), 1 - 1e-5)
                        x.append(logit(p))
                    gate = (j, 0 if n0 + n1 <= 0.5 else 1 if n0 + n1 <= 2.5 else 2 if n0 + n1 <= 7.5 else 3)
                    w = weights.setdefault(gate, list(START))
                    odds = math.exp(-(2 * bit - 1) * min(max(sum(map(float.__mul__, w, x)), -11.5), 11.5))
                    cost -= math.log10(1 + odds)
                    waiting.setdefault(gate, []).append(((2 * bit - 1) * odds / (1 + odds), x))
                out.append(cost)
            for gate, seen in waiting.items():
                weights[gate] = [w + RATE * sum(e * x[k] for e, x in seen) / len(seen) for k, w in enumerate(weights[gate])]
        at += n
    return np.array(out)


def test_word_costs_by_brute_force():
    r = np.random.default_rng(4)
    head = Head([f"w{k}".encode() for k in range(60)], [300 // (k + 1) for k in range(60)], 1500, 70)
    texts = [" ".join(f"w{min(int(x), 70)}" for x in r.zipf(1.5, n)) for n in (0, 3, 150, 150, 70)]
    texts.append(texts[2])
    sizes = (256, 256)
    one, two = (np.zeros(n * LEAVES * 2, dtype=np.float32) for n in sizes)
    count_words(Words(texts[:4], head), sizes, one, two)
    own = np.array([True, True, True, True, False, False])
    got = word_costs(Words(texts, head), own, head, sizes, one, two)
    assert got == pytest.approx(plain_word_costs(texts, own, head, sizes, one, two), abs=2e-3)
    assert got.sum() == pytest.approx(plain_word_costs(texts, own, head, sizes, one, two).sum(), rel=1e-4)


def test_learned_weights_beat_fixed_ones(monkeypatch):
    import quillspark.llm.ctxmix as M

    r = np.random.default_rng(7)
    head = Head([f"w{k}".encode() for k in range(60)], [300 // (k + 1) for k in range(60)], 1500, 70)
    texts = [" ".join(f"w{(7 * i + int(r.integers(0, 2))) % 60}" for i in range(300)) for _ in range(12)]
    sizes = (256, 1024)
    one, two = (np.zeros(n * LEAVES * 2, dtype=np.float32) for n in sizes)
    count_words(Words(texts[:8], head), sizes, one, two)
    own, rest = np.zeros(4, bool), Words(texts[8:], head)
    moving = word_costs(rest, own, head, sizes, one, two).sum()
    monkeypatch.setattr(M, "RATE", 0.0)
    assert moving > word_costs(rest, own, head, sizes, one, two).sum()


def test_distinct_tokens_are_looked_up_once():
    class Asked(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

    head = Head([b"", b"the", b"cat"], [3, 2, 1], 9, 4)
    head.ids = Asked(head.ids)
    odd = ["The cat\tTHE\n\nthe\x0b \x0c dog", "", " \r\n ", "É İ\u00a0x\u2003y\x1cz the\x85", *["the cat " * 500] * 3, "dog"]
    words = Words(odd, head)
    want = [w for t in odd for w in [*t.encode().lower().split(), b""]]
    assert words.n.tolist() == [len(t.encode().split()) + 1 for t in odd]
    assert words.ids.tolist() == [{b"": 0, b"the": 1, b"cat": 2}.get(w, -1) for w in want]
    assert head.ids.n == len(set(want))
    part = Words(pa.array(odd).slice(3, 2), head)
    assert [words.distinct[int(k)].as_py() for k in words.place] == want
    assert part.ids.tolist() == words.ids[words.n[:3].sum() : words.n[:5].sum()].tolist()


def test_letter_counts_are_exact():
    code, slots = prefix_code([b"ab"]), 1 << 12
    table = np.zeros(2 * sum(letter_sizes(slots)))
    count_letters([b"ab", b"ab"], np.array([2**24, 1]), code, slots, table)
    slot = Letters([b"ab"], code, slots)
    assert table[slot.slots[3] * 2 + slot.bit].min() >= 2**24 + 1
