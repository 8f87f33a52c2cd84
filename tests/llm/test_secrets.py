import re
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm.secrets import KINDS, find_secrets

PATTERNS = [
    (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m))


def spans(df):
    return Counter((r["doc_id"], tuple((s["start"], s["kind"], s["end"]) for s in r["spans"])) for r in df.collect())


def test_base(spark, odd, empty):
    key = "AKIA" + "Q" * 16
    texts = ["secret=token: abcdef", 'PASSWORD" : "abc12345"; passwd=abc', f"é😀 {key} {key[:19]} {key}", "0" * 24 + "g" + "a" * 23, "api_key=" + "f" * 30, "token==abcdef token= =abcdef", "apikey='x' api_key:'yyyyyyy'", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans(find_secrets(df, tuple(k for k in KINDS if k.strong)))
    assert got == Counter((i, tuple(brute(t))) for i, t in enumerate(texts))
    rows = odd.collect()
    assert spans(find_secrets(odd, tuple(k for k in KINDS if k.strong))) == Counter((r["doc_id"], tuple(brute(r["text"]))) for r in rows)
    assert find_secrets(empty).count() == 0


def test_weak_parts_need_company(spark):
    far = "x " * 300
    texts = ["see https://db.example.com/x today", "see https://db.example.com/x password=abcdef1", f"https://a.example.com {far} password=abcdef1", "client_id=abcd and " + "aB3" * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [KINDS[s["kind"]].name for s in r["spans"]] for r in find_secrets(df).collect()}
    assert got == {0: [], 1: ["endpoint", "assign"], 2: ["assign"], 3: ["weak_id", "weak_key"]}


def test_long_parts_are_near_by_their_ends(spark):
    gap = " " * 90
    texts = ["token=" + "ab.9" * 200 + gap + "https://db.example.com/x", "https://db.example.com/x" + gap + "0f" * 500, "f0" * 900 + gap + "client_id=abcd", "token=" + "ab.9" * 200 + " " * 201 + "https://db.example.com/x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [KINDS[s["kind"]].name for s in r["spans"]] for r in find_secrets(df).collect()}
    assert got == {0: ["assign", "endpoint"], 1: ["endpoint", "hex"], 2: ["hex", "weak_id"], 3: ["assign"]}


def test_usual_forms_of_a_secret_half(spark):
    access, half, site = "AKIA" + "Q" * 16, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "https://db.example.com/x"
    texts = [
        f"AWS_ACCESS_KEY_ID={access}\nAWS_SECRET_ACCESS_KEY={half}", f"{site} {half}abc==", f"{site} {half}ab=\n", f"{site} with {half}. Next", f"{site} " + half * 3, f"{site} key:{half}",
        f"{site} {half}.abc", f"{site} {half}===", f"{site} {half}=abc", f"AWS_SECRET_ACCESS_KEY={half}",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if KINDS[s["kind"]].name == "weak_key"] for r in find_secrets(df).collect()}
    assert got == {0: [half], 1: [half + "abc=="], 2: [half + "ab="], 3: [half], 4: [half * 3], 5: [half], 6: [], 7: [], 8: [], 9: []}


def test_clashing_columns(odd):
    assert find_secrets(odd.withColumn("kind", F.lit(9)).withColumn("start", F.lit(1))).count() == odd.count()


def test_many_matches_in_one_text(spark):
    text = " ".join("%024x" % k if k % 3 else "%010x" % k for k in range(30_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert spans(find_secrets(df, tuple(k for k in KINDS if k.strong))) == Counter([(1, tuple(brute(text)))])
