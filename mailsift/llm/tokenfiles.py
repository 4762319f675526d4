"""Token ids in binary files with Elias-Fano coded document boundaries.

Documents are range-partitioned by id and encoded; each task writes files of bounded size. A file holds, one after another:

    magic "EFT1", then five unsigned 64-bit numbers: documents, ids, low bits l, words of the upper array, bytes of an id
    the doc_id of each document (signed 64-bit; a bit array before them marks null ids)
    the upper array: bit (b >> l) + k is set for the k-th boundary b (bits in words of 64, lowest first)
    the select directory: the position of every 64th set bit of the upper array (unsigned 64-bit)
    the lower array: the l low bits of each boundary, packed
    the ids, little-endian, 2 bytes each if the vocabulary allows, else 4

There is a boundary at the end of each document. select(k) finds the k-th one by going on from the last directory entry
before it, so that a document is read without a table of offsets.
"""

from __future__ import annotations

import functools
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailsift.llm import common
from mailsift.session import shared_folder, write_and_read

MAGIC, HEAD = b"EFT1", struct.Struct("<4s5Q")
STEP = 64
#: Ids of a file, beyond which the next file of the task begins.
FILE_IDS = 8 << 20
#: Pieces whose ids a worker remembers; beyond this it forgets those met once or seldom.
REMEMBERED = 600_000
END = 0
LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[i for i in range(128) if chr(i).isalpha()]] = True
SIGN[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def pack_bits(positions: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits with these bits set."""
    out = np.zeros(-(-bits // 64) * 64, np.uint8)
    out[positions] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def elias_fano(ends: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(low bits, upper array, select directory, packed lower array) of ascending numbers."""
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    ends = ends.astype(np.uint64)
    ones = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = pack_bits(ones, int(ones[-1]) + 1 if n else 0)
    bits = ((ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return low, upper, ones[::STEP].astype(np.uint64), np.packbits(bits, bitorder="little")


class Boundaries:
    """Elias-Fano coded boundaries as read from a file."""

    def __init__(self, n: int, low: int, upper: np.ndarray, directory: np.ndarray, lower: np.ndarray):
        self.n, self.low, self.upper, self.directory, self.lower = n, low, upper, directory, lower

    def select(self, k: int) -> int:
        """The k-th boundary."""
        at, seen = int(self.directory[k // STEP]), k // STEP * STEP
        word, rest = at // 64, int(self.upper[at // 64]) >> at % 64 << at % 64
        while seen + rest.bit_count() <= k:
            seen += rest.bit_count()
            word += 1
            rest = int(self.upper[word])
        for _ in range(k - seen):
            rest &= rest - 1
        position = word * 64 + (rest & -rest).bit_length() - 1
        return (position - k) << self.low | self.low_bits(k)

    def low_bits(self, k: int) -> int:
        first, last = k * self.low, (k + 1) * self.low
        held = int.from_bytes(self.lower[first // 8 : -(-last // 8)].tobytes(), "little")
        return held >> first % 8 & (1 << self.low) - 1

    def all(self) -> np.ndarray:
        """Every boundary."""
        ones = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return ((ones - np.arange(self.n)) << self.low) + (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1)


def packed(doc_ids: pa.Array, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A file."""
    low, upper, directory, lower = elias_fano(ends)
    null = np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False), bitorder="little")
    head = HEAD.pack(MAGIC, len(ends), len(ids), low, len(upper), ids.dtype.itemsize)
    numbers = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    return b"".join([head, null.tobytes(), numbers.tobytes(), upper.tobytes(), directory.tobytes(), lower.tobytes(), ids.tobytes()])


def unpacked(data: bytes) -> tuple[pa.Array, Boundaries, np.ndarray]:
    """(doc ids, boundaries, token ids) of a file."""
    magic, n, n_ids, low, words, width = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    null = np.unpackbits(take("u1", -(-n // 8)), bitorder="little")[:n].astype(bool)
    numbers = pa.array(take("<i8", n), mask=null)
    upper, directory, lower = take("<u8", words), take("<u8", -(-n // STEP)), take("u1", -(-n * low // 8))
    return numbers, Boundaries(n, low, upper, directory, lower), take(f"<u{width}", n_ids)


def after_wide_blank(data: np.ndarray) -> np.ndarray:
    """For each byte but the first, whether it may follow a blank beyond the ASCII ones: U+001C to U+001F, U+0085, U+00A0,
    and all characters that begin as U+1680, U+2000, U+2040 and U+3000 do."""
    last = data[:-1]
    before, first = (np.concatenate([np.zeros(k, np.uint8), last])[: len(last)] for k in (1, 2))
    two = (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
    three = ((first == 0xE2) & ((before == 0x80) | (before == 0x81))) | ((first == 0xE1) & (before == 0x9A)) | ((first == 0xE3) & (before == 0x80))
    return two | three | ((last >= 0x1C) & (last <= 0x1F))


class Encoder:
    """Ids of whole texts. Every distinct piece of text is encoded once and remembered.

    A piece begins at a run of blanks, or where ASCII punctuation follows an ASCII letter. The byte-level pattern has no token
    with a blank after another character, nor one with punctuation after a letter, so a text's ids are those of its pieces.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int32)

    def forget_rare(self) -> None:
        """Keep the pieces met most often, half as many as may be remembered at most."""
        kept = common.often(self.met, REMEMBERED // 2)
        self.known = common.renumbered(self.known, kept)
        n = np.diff(self.starts)
        self.ids, self.starts = self.ids[np.repeat(kept, n)], np.append(0, np.cumsum(n[kept]))
        self.met = self.met[kept] // 2

    def places(self, distinct: list[str]) -> np.ndarray:
        """Where the ids of each piece are; new ones are encoded."""
        if len(self.known) > REMEMBERED:
            self.forget_rare()
        place = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            place[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            new = [distinct[k] for k in missing.tolist()]
            self.known.update(zip(new, place[missing].tolist(), strict=True))
            parts, sizes = [self.ids], []
            for a in range(0, len(new), 50_000):
                found = [x.ids for x in self.tokenizer.encode_batch_fast(new[a : a + 50_000], add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
                parts.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
            self.ids = np.concatenate(parts)
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes)))
            self.met = np.append(self.met, np.zeros(len(new), np.int32))
        self.met[place] += 1
        return place

    def encode(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        data, offsets = common.text_bytes(texts)
        blank = common.SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (blank[1:] & ~blank[:-1] & ~after_wide_blank(data)) | (SIGN[data[1:]] & LETTER[data[:-1]])
        cut[offsets] = True
        at = np.flatnonzero(cut)
        # strings over the same bytes, without a copy
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        place = self.places(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        first, n = self.starts[place], self.starts[place + 1] - self.starts[place]
        ids = self.ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return ids, common.sums(n, np.searchsorted(at[:-1], offsets))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    common.one_thread()
    return Encoder(path)


def write_files(docs: DataFrame, folder: str, tokenizer: str, wide: bool | None = None) -> DataFrame:
    """Write `docs` as token files into `folder` and return their manifest (part, file, path, n_docs, n_ids), in order of ids.

    A task gives its files names of its own and the manifest names those of the tasks that succeeded, so that a task which
    is run again leaves no wrong file behind, only an unnamed one. Any file system that Arrow knows can hold the folder.
    Ids have 32 bits if `wide`, which is so by default for a vocabulary with ids beyond 16 bits.
    """
    if wide is None:
        wide = max(Tokenizer.from_file(tokenizer).get_vocab().values(), default=0) >= 1 << 16

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, kind = encoder(tokenizer).encode, "<u4" if wide else "<u2"
        system, base = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else pyarrow.fs.FileSystem.from_uri(f"file://{folder.removeprefix('file:')}")
        system.create_dir(base, recursive=True)
        numbers, ids, held, files = [], [], 0, 0

        def finish() -> pa.RecordBatch:
            nonlocal files
            path = f"{base}/{uuid.uuid4().hex}.eft"
            counts = np.concatenate([n for _, n in ids])
            data = packed(pa.concat_arrays(numbers), np.cumsum(counts), np.concatenate([x for x, _ in ids]))
            with system.open_output_stream(path) as out:
                out.write(data)
            files += 1
            part = TaskContext.get().partitionId()
            return pa.RecordBatch.from_pylist([{"part": part, "file": files, "path": path, "n_docs": len(counts), "n_ids": int(counts.sum())}])

        for rows in common.gathered(batches):
            found, n = encode(rows["text"])
            ends = np.cumsum(n)  # id 0 after each document
            found = np.insert(found, ends, END).astype(kind)
            numbers.append(rows["doc_id"].combine_chunks().cast(pa.int64()))
            ids.append((found, n + 1))
            held += len(found)
            if held > FILE_IDS:
                yield finish()
                numbers, ids, held = [], [], 0
        if ids:
            yield finish()

    ordered = docs.select("doc_id", common.whole().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(write, "part long, file long, path string, n_docs long, n_ids long")
    return write_and_read(manifest, "token-manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that the manifest names."""
    # one row per file, of some tens of megabytes: the window is over a table that small
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    scheme = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pyarrow.fs.FileSystem.from_uri(scheme)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with system.open_input_stream(path) as stream:
                    numbers, boundaries, ids = unpacked(stream.read())
                ends = boundaries.all()
                begins = np.append(0, ends[:-1]).astype(np.int64)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield from pa.table({"doc_id": numbers, "start": begins + start, "n_tokens": ends - begins, "ids_crc32": pa.array(crc, pa.int64())}).to_batches(max_chunksize=10_000)

    columns = "doc_id long, start long, n_tokens long, ids_crc32 long"
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(cores, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(read, columns)


def token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write `docs` as token files and return what is read back from them, a row per document.

    A null text is empty and has only the end id. Null ids come first; repeated ids are ordered by text. An empty table
    gives no file and no row. Other columns are not read. `folder` is in the shared folder unless it is given.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    manifest = write_files(docs, folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(manifest, folder)
