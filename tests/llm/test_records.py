import zlib

import numpy as np
import pyarrow as pa
import pytest

from tokenizers import Tokenizer

from quillspark.llm.queries import byte_tokenizer
from quillspark.llm.records import WordwiseEncoder, encode_documents, frame, unframe

ODD = ["", "a  b", "  x", " lead", "tail ", "\n\nx y", "<|endoftext|> hi", "a <|endoftext|> b", "x<|endoftext|>y z", "x\x00 y", "a \x1c b", "q  \n r s", "it's 5 o'clock 's", "\nab\n", "Ab.,, c", "a1b2 c³ d", "áb x́. ñ!", "ﬀ ² ½x", "中文。 好.", "x's y'll.", " .", "a\u200bb  x", "a\u00a0b c", "l1.\nL2, l3\n\nL4"]


def test_ids_equal_the_tokenizers():
    enc = WordwiseEncoder(byte_tokenizer())
    for _ in range(2):
        ids, counts = enc.encode(ODD, 0)
        want = [e.ids + [0] for e in Tokenizer.from_file(byte_tokenizer()).encode_batch(ODD, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_pieces_are_cut_in_any_text():
    texts = ["Some words,  and more words.\n\nSome words; (and) more\tWORDS 2024-05: it's so.", "", "words é ñandú. and\u00a0 more, words\n"]
    enc = WordwiseEncoder(byte_tokenizer())
    ids, counts = enc.encode(texts, 0)
    want = [e.ids + [0] for e in Tokenizer.from_file(byte_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    # adjoining white space and punctuation make no long or new pieces
    assert max(map(len, enc.code)) < 12
    assert b" words" in enc.code and b" words," not in enc.code
    assert [x.tolist() for x in enc.encode(pa.array(texts).slice(1), 0)] == [ids[counts[0] :].tolist(), counts[1:].tolist()]


def test_random_characters():
    rng = np.random.default_rng(3)
    some = [*"abAB 01.,;:!?'\"-_()\n\t\r  \u0085\u00a0\u2003\u3000\u2028“éàñЖ中。²½ﬀ\x00\x1c\x7f", "<|endoftext|>", "'s", "'ll", " the", " à", "\n\n"]
    enc, tok = WordwiseEncoder(byte_tokenizer()), Tokenizer.from_file(byte_tokenizer())
    for _ in range(20):
        texts = ["".join(rng.choice(some, n)) for n in rng.integers(0, 40, 100)]
        ids, counts = enc.encode(texts, 0)
        want = [e.ids + [0] for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_frames():
    ids = np.arange(5, dtype="<u2")
    assert unframe(frame(None, ids), 0)[0] is None and unframe(frame(-(2**63), ids), 0)[0] == -(2**63)
    buf = frame(-3, ids) + frame(7, ids.astype("<u4"))
    assert unframe(buf, 0)[0] == -3 and unframe(buf, len(frame(-3, ids)))[1].tolist() == [0, 1, 2, 3, 4]
    for at in (0, 13, 30):
        with pytest.raises(ValueError):
            unframe(buf[:at] + bytes([buf[at] ^ 1]) + buf[at + 1 :], 0)


def test_round_trip(spark, odd, empty):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in encode_documents(odd, byte_tokenizer()).collect())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tok = Tokenizer.from_file(byte_tokenizer())
    at = 0
    for (start, doc, n, crc), (want, text) in zip(got, rows, strict=True):
        ids = tok.encode(text, add_special_tokens=False).ids + [0]
        assert (start, doc, n, crc) == (at, want, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += n
    assert encode_documents(empty, byte_tokenizer()).count() == 0


def test_many_files_and_pieces(spark):
    from quillspark.core import fresh_path
    from quillspark.llm.records import read_index, read_records, write_records

    rows = [(k // 3, f"text {k} <|endoftext|>" * (k % 4)) for k in range(600)] + [(None, f"n{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = fresh_path(spark, "records")
    written = write_records(df, folder, byte_tokenizer(), files=5).cache()
    assert written.count() > 1
    got = sorted((r["start"], r["key"], r["n_tokens"]) for r in read_records(read_index(spark, folder, written, 37), folder, 3).collect())
    assert [r[1] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r[0] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
