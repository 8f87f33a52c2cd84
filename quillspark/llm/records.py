"""Token ids as length-delimited binary records with masked checksums and an index.

Frame of a record (all little-endian): length of the payload as unsigned 64 bits,
masked CRC-32 of these 8 bytes, the payload, masked CRC-32 of the payload. The
mask rotates the checksum right by 15 bits and adds 0xa282ead8. A payload starts
with a signed 64-bit key, a byte that tells the width of an id (2 or 4), then the
ids. A file's offset index, written beside it, holds the byte offset, the key and
the number of ids of each record, so that a reader can fetch records in any order.

Documents are ranged by key, so that file k holds smaller keys than file k + 1 and
records within a file ascend. Each task tokenizes its own range and writes under a
name of its attempt, then renames: a task that runs again replaces its file with
the same bytes. Files are opened with ``pyarrow.fs``, so the folder can be any
store that pyarrow knows and all executors share.

Defined results: a null text is empty and gives the end id alone; rows that share
a key are ordered by digest, then text, and each is a record; a key that is null or no
whole number counts as null and sorts first; special strings in a text become the
tokenizer's special ids, as its encode() has it; an empty table gives no files; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.core import arrow_store, fresh_path
from quillspark.llm.arrays import kept

#: Added to the width where the key is null.
NULL_KEY = 128
#: Bytes of texts for a file: the larger, the more of its pieces have been encoded before.
FILE_BYTES = 48 << 20
MASK_DELTA = 0xA282EAD8
#: An entry of the offset index.
INDEX = np.dtype([("offset", "<u8"), ("key", "<i8"), ("ids", "<u8"), ("ahead", "<u8")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((((c >> 15) | (c << 17)) & 0xFFFFFFFF) + MASK_DELTA) & 0xFFFFFFFF


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: bytes that print in
    Latin-1 stand for themselves, the others, in order, for code points from 256."""
    shows = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shows)]
    return {b: chr(b) for b in shows} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordwiseEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct piece once.

    The pre-tokenizer cuts ahead of white space that follows another character, behind a
    single line feed, and wherever ASCII letters, digits and other printed characters adjoin,
    but for letters behind an apostrophe. A text is cut at such places, found among its bytes,
    and each piece can be encoded alone and its ids kept. Pieces are told apart by Arrow, and only the
    distinct ones of a call are looked up. A text with a special string is one piece.

    A piece of letters only, with its space in front, is one pre-token and goes straight to
    the model; closing punctuation after letters is a pre-token of its own. All other
    pieces take the tokenizer's own way. Pieces are forgotten when there are more than ``keep``.
    """

    CLOSING = ".,;:!?"
    #: Kinds of bytes: other, letter, digit, other printed ones.
    KINDS = np.array([0 if b < 33 or b > 126 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], dtype=np.uint8)

    def __init__(self, tokenizer_path: str, keep: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u4") if self.tok.get_vocab_size(with_added_tokens=True) > 65536 else np.dtype("<u2")
        self.keep = keep
        self.letters = byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.flat = np.zeros(0, dtype=self.dtype)
        self.at = np.zeros(1, dtype=np.int64)

    def _model(self, text: str) -> list[int]:
        shown = text.replace(" ", self.letters[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tok.model.tokenize(shown)]

    def _ids(self, piece: str) -> list[int]:
        core = piece.rstrip(self.CLOSING)
        if core and (core.isalpha() or core[0] == " " and core[1:].isalpha()):
            return self._model(core) if len(core) == len(piece) else self._model(core) + self._model(piece[len(core) :])
        return self.tok.encode(piece, add_special_tokens=False).ids

    def _learn(self, new: list[bytes]) -> None:
        made = [self._ids(p.decode()) for p in new]
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, np.array([i for x in made for i in x], dtype=self.dtype)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in made], dtype=np.int64)])

    def cuts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of texts in a row; no text is empty."""
        kind = self.KINDS[data]
        # whether a character that isn't white space lies ahead of a byte, in its text or the one before
        after = np.append(False, kind[:-1] > 0)
        wide = np.flatnonzero(data[:-1] >= 128) + 1
        one, two, three = (data[np.maximum(wide - k, 0)] for k in (1, 2, 3))
        # all white space beyond ASCII, and some other characters
        after[wide] = ~(((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A))))
        feed = data == 10
        cut = (feed | (data == 32)) & after
        a, b = kind[:-1], kind[1:]
        cut[1:] |= (a != b) & (a > 0) & (b > 0) & ((data[:-1] != 39) | (b != 1))
        # behind a line feed that is all the white space there is
        after[starts] = True
        cut[1:] |= (feed & after)[:-1] & (b > 0)
        raw = data.tobytes()
        for word in self.special:
            at = raw.find(word)
            while at >= 0:
                text = int(np.searchsorted(starts, at, side="right")) - 1
                cut[starts[text] : ends[text]] = False
                at = raw.find(word, at + 1)
        cut[starts] = True
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array | list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each), the end id appended to each."""
        if len(self.code) > self.keep:
            self._clear()
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        bounds = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)))
        ids, ends = np.zeros(0, dtype=self.dtype), np.zeros(len(texts), dtype=np.int64)
        if bounds[-1]:
            first = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset]
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first : first + bounds[-1]]
            full = bounds[1:] > bounds[:-1]
            cut = self.cuts(data, bounds[:-1][full], bounds[1:][full])
            edges = pa.py_buffer(np.append(cut, len(data)).astype(np.int32))
            seq = pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, edges, pa.py_buffer(data)]).dictionary_encode()
            distinct = seq.dictionary.to_pylist()
            missing = [p for p in distinct if p not in self.code]
            if missing:
                self._learn(missing)
            codes = np.fromiter(map(self.code.__getitem__, distinct), dtype=np.int64, count=len(distinct))[seq.indices.to_numpy()]
            begin = self.at[codes]
            sizes = self.at[codes + 1] - begin
            upto = np.append(0, np.cumsum(sizes))
            ids = self.flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes)]
            ends = upto[np.searchsorted(cut, bounds[1:])]
        counts = np.diff(ends, prepend=0)
        if end_id is not None:
            ids, counts = np.insert(ids, ends, end_id), counts + 1
        return ids, counts


@kept
def encoder(tokenizer_path: str) -> WordwiseEncoder:
    """One encoder a process: a worker's later tasks neither load the tokenizer again nor lose its pieces."""
    return WordwiseEncoder(tokenizer_path)


def frame(key: int | None, ids: np.ndarray) -> bytes:
    payload = struct.pack("<qB", key or 0, ids.dtype.itemsize + NULL_KEY * (key is None)) + ids.tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(buf: bytes, at: int) -> tuple[int | None, np.ndarray]:
    """Key and ids of the record at an offset; raises ValueError on a wrong checksum."""
    size, told = struct.unpack_from("<QI", buf, at)
    if masked(buf[at : at + 8]) != told:
        raise ValueError(f"the length at {at} has a wrong checksum")
    end = at + 12 + size
    if masked(buf[at + 12 : end]) != struct.unpack_from("<I", buf, end)[0]:
        raise ValueError(f"the payload at {at} has a wrong checksum")
    key, width = struct.unpack_from("<qB", buf, at + 12)
    if width >= NULL_KEY:
        key, width = None, width - NULL_KEY
    return key, np.frombuffer(buf, dtype="<u4" if width == 4 else "<u2", count=(size - 9) // width, offset=at + 21)


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text", files: int | None = None, batch_bytes: int = 4_000_000, order: list[Column] | None = None) -> DataFrame:
    """Writes the files; a row for each: file (its rank), records, ids, bytes.

    ``files`` is the number of ranges; by default one for ``FILE_BYTES`` of texts. Records
    go by ``order``; by default by id and, of one id, by text.
    """
    by = [f"o{i}" for i in range(len(order or []))]
    rows = docs.select(F.col(doc_id).try_cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), *(c.alias(n) for c, n in zip(order or [], by)))
    if files is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
        files = max(1, -(-size // FILE_BYTES))
    if order:
        ranged = rows.repartitionByRange(files, *by).sortWithinPartitions(*by).select("k", "t")
    else:
        rows = rows.select("k", "t", F.xxhash64("t").alias("h"))
        ranged = rows.repartitionByRange(files, "k", "h").sortWithinPartitions("k", "h", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        ctx = TaskContext.get()
        part = ctx.partitionId()
        enc = None
        store, root = arrow_store(folder)
        store.create_dir(root, recursive=True)
        name, tried = f"{root}/part-{part:06d}", f"{root}/.try-{part:06d}-{ctx.attemptNumber()}-{uuid.uuid4().hex}"
        total = n_ids = 0
        index: list[np.ndarray] = []
        out = None
        for keys, texts in _chunks(batches, batch_bytes):
            if out is None:
                enc, out = encoder(tokenizer_path), store.open_output_stream(f"{tried}.rec")
            ids, counts = enc.encode(texts, end_id)
            records = [frame(k, x) for k, x in zip(keys, np.split(ids, np.cumsum(counts)[:-1]), strict=True)]
            out.write(b"".join(records))
            sizes = np.array([len(x) for x in records])
            entry = np.zeros(len(keys), dtype=INDEX)
            entry["offset"], entry["key"], entry["ids"] = np.cumsum(sizes) - sizes + total, [k or 0 for k in keys], counts
            entry["ahead"] = np.cumsum(counts) - counts + n_ids
            index.append(entry)
            total += int(sizes.sum())
            n_ids += int(counts.sum())
        if out is None:
            return
        out.close()
        entries = np.concatenate(index)
        with store.open_output_stream(f"{tried}.idx") as f:
            f.write(entries.tobytes())
        for kind in ("rec", "idx"):
            store.move(f"{tried}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "records": [len(entries)], "ids": [n_ids], "bytes": [total]})

    return ranged.mapInArrow(write, "file int, records long, ids long, bytes long")


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Keys and texts of runs of rows with at most ``most`` bytes, or of one row."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            yield b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo)
            lo = hi


def read_index(spark: SparkSession, folder: str, written: DataFrame, records_a_task: int = 10_000) -> DataFrame:
    """Pieces of the files for readers: file, first record, number of records, ids before the file."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = written.withColumn("ids_before", before)  # a row a file
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(records_a_task).cast("long")))
    return files.withColumn("first", first).select("file", "first", F.least(F.lit(records_a_task).cast("long"), F.col("records") - F.col("first")).alias("n"), "ids_before")


def read_records(pieces: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Reads pieces of files through their index and checks every checksum.

    Returns key, start (ids of all earlier records), n_tokens, ids_crc32 (of the ids
    as little-endian unsigned 32-bit numbers).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_store(folder)
        for b in batches:
            for file, first, n, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = f"{root}/part-{file:06d}"
                with store.open_input_file(f"{name}.idx") as f:
                    # one entry more tells where the piece ends
                    f.seek(first * INDEX.itemsize)
                    part = np.frombuffer(f.read((n + 1) * INDEX.itemsize), dtype=INDEX)
                with store.open_input_file(f"{name}.rec") as f:
                    end = int(part["offset"][n]) if len(part) > n else f.size()
                    part = part[:n]
                    lo = int(part["offset"][0])
                    f.seek(lo)
                    buf = f.read(end - lo)
                keys, ids = zip(*(unframe(buf, int(at) - lo) for at in part["offset"]), strict=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(keys, pa.int64()),
                        "start": pa.array(part["ahead"].astype(np.int64) + before, pa.int64()),
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    }
                )

    return pieces.repartition(tasks, "file", "first").mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """Writes the documents' ids, in ``order`` or else by id, and reads every record back.

    Returns doc_id (null for a null key), start, n_tokens, ids_crc32.
    """
    from quillspark.core import materialize

    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "records")
    written = materialize(write_records(docs, folder, tokenizer_path, end_id, doc_id, text, order=order), "records-files")
    back = read_records(read_index(spark, folder, written), folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
