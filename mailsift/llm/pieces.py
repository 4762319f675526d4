"""SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is parsed and rebuilt: its normaliser, the marker for blanks, the pieces with their scores, and byte
fallback. A unigram model becomes a unigram model with these scores. In a BPE model a score is the rank at which a piece was
merged, so it becomes a BPE model whose merges are the pairs of pieces that join to a piece, in order of rank.

Texts are encoded in whole batches of their distinct parts, on one thread, as each core has a task of its own. Parts are cut before a blank that follows
another character, and only if no piece of the model has a blank after another character, so that no piece can cross a cut.
Each distinct part's ids are compared with those of the sentencepiece library and decoded again, which holds for whole texts then.
"""

from __future__ import annotations

import functools
import itertools
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from mailsift.llm import common

MARK = "▁"
#: Parts whose ids a worker remembers; beyond this it forgets those met once or seldom. Workers go on to other work with it, so
#: it is small: some 300 bytes for each part.
REMEMBERED = 300_000


def parsed(path: str) -> sentencepiece_model_pb2.ModelProto:
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def merges(pieces: list[str], scores: list[float]) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, in order of the joined piece's rank, then of the parts' ranks."""
    rank = {p: -s for p, s in zip(pieces, scores, strict=True)}
    out = []
    for whole, at in rank.items():
        pairs = [(whole[:k], whole[k:]) for k in range(1, len(whole)) if whole[:k] in rank and whole[k:] in rank]
        out += [(at, rank[a], rank[b], a, b) for a, b in pairs]
    return [(a, b) for *_, a, b in sorted(out)]


def rebuilt(path: str) -> Tokenizer:
    """The model as a tokenizer of the tokenizers library."""
    model = parsed(path)
    kind = type(model.pieces[0]).Type if hasattr(type(model.pieces[0]), "Type") else model.SentencePiece.Type
    pieces, scores, types = zip(*((p.piece, p.score, p.type) for p in model.pieces), strict=True)
    trainer, spec = model.trainer_spec, model.normalizer_spec
    unknown = pieces[trainer.unk_id]
    if trainer.model_type == 2:  # BPE
        normal = [(p, s) for p, s, t in zip(pieces, scores, types, strict=True) if t in (kind.NORMAL, kind.USER_DEFINED)]
        joins = merges(*map(list, zip(*normal, strict=True)))
        own = models.BPE({p: i for i, p in enumerate(pieces)}, joins, unk_token=unknown, fuse_unk=True, byte_fallback=trainer.byte_fallback)
    elif trainer.model_type == 1:
        own = models.Unigram(list(zip(pieces, scores, strict=True)), unk_id=trainer.unk_id, byte_fallback=trainer.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    tokenizer = Tokenizer(own)
    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    control = [AddedToken(p, special=True, normalized=False) for p, t in zip(pieces, types, strict=True) if t == kind.CONTROL]
    tokenizer.add_special_tokens(control)
    tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


class Codec:
    """Encodes and decodes whole texts by one model."""

    def __init__(self, path: str):
        model = parsed(path)
        self.tokenizer = rebuilt(path)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.tidy = model.normalizer_spec.remove_extra_whitespaces
        self.charsmap = bool(model.normalizer_spec.precompiled_charsmap)
        inner = [p.piece.lstrip(MARK) for p in model.pieces]
        # a cut needs that no piece reaches across it, nor bytes of a marker that is no piece itself
        self.cuttable = not self.tidy and not self.charsmap and not any(MARK in p for p in inner) and any(p.piece == MARK for p in model.pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends, self.same, self.back = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, bool)
        self.met = np.zeros(0, np.int32)

    def forget_rare(self) -> None:
        """Keep the parts met most often, half as many as may be remembered at most."""
        kept = common.often(self.met, REMEMBERED // 2)
        self.known = common.renumbered(self.known, kept)
        n = np.diff(self.ends)
        self.ids, self.ends = self.ids[np.repeat(kept, n)], np.append(0, np.cumsum(n[kept]))
        self.same, self.back, self.met = self.same[kept], self.back[kept], self.met[kept] // 2

    def learn(self, parts: list[str]) -> None:
        """Encode, compare and decode parts that are not known yet. A marker in a text is an ordinary character, but cannot be told from a
        blank by either library."""
        ours = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        # the reference puts a marker in front of what it encodes, so it gets parts without theirs
        theirs = self.reference.encode([p[1:] if p[:1] in (" ", MARK) else p for p in parts] if self.prefix else parts, num_threads=1)
        same = list(map(operator.eq, ours, theirs))
        if self.prefix and not all(same):
            same = [ok or p in (" ", MARK) for ok, p in zip(same, parts, strict=True)]  # nothing is left of these to compare
        decoded = self.tokenizer.decode_batch(ours, skip_special_tokens=False)
        back = list(map(operator.eq, decoded, [p.replace(MARK, " ") for p in parts]))
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        lengths = np.fromiter(map(len, ours), np.int64, len(ours))
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ours), np.int32, int(lengths.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self.same, self.back = np.append(self.same, np.array(same, bool)), np.append(self.back, np.array(back, bool))
        self.met = np.append(self.met, np.zeros(len(parts), np.int32))

    def places(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget_rare()
        found = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            new = [distinct[k] for k in missing.tolist()]
            for a in range(0, len(new), 20_000):
                self.learn(new[a : a + 20_000])
        self.met[found] += 1
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has, whether each one's parts have parity, whether they come back by decoding).

        Ids are decoded piece by piece and only bytes in a row are joined, so a text comes back if each of its parts does."""
        marked = [(" " + t if self.prefix and t else t) for t in texts]
        data, offsets = common.text_bytes(pa.array(marked, pa.large_string()))
        blank = data == 32
        cut = np.zeros(len(data) + 1, bool)
        if self.cuttable and len(data):
            cut[1:-1] = blank[1:] & ~blank[:-1] & ~after_mark(data)
        cut[offsets] = True
        at = np.flatnonzero(cut)
        parts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        place = self.places(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        first, n = self.ends[place], self.ends[place + 1] - self.ends[place]
        ids = self.ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        docs = np.searchsorted(at[:-1], offsets)
        return ids, common.sums(n, docs), common.sums(~self.same[place], docs) == 0, common.sums(~self.back[place], docs) == 0

    def decode(self, ids: list[int]) -> str:
        text = self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.prefix and text[:1] == " " else text


def after_mark(data: np.ndarray) -> np.ndarray:
    """For each byte but the first, whether it follows the marker character, which is as a blank to the model."""
    last = data[:-1]
    before, first = (np.concatenate([np.zeros(k, np.uint8), last])[: len(last)] for k in (1, 2))
    return (first == 0xE2) & (before == 0x96) & (last == 0x81)


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker process."""
    common.one_thread()
    return Codec(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_crc32, parity, restored) for each row of `docs`.

    ids_crc32 is of the ids as little-endian unsigned 32-bit numbers; parity tells whether the parts of the text have the ids
    that sentencepiece gives, restored whether decoding gives the text. A null text is empty and has no ids. Other columns
    are not read.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches, size=common.CHUNK // 4):
            ids, n, parity, restored = codec(path).encode(rows["text"].combine_chunks().fill_null("").to_pylist())
            ends = np.append(0, np.cumsum(n))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield from pa.table({"doc_id": rows["doc_id"], "n_tokens": n, "ids": lists, "ids_crc32": pa.array(crc, pa.int64()), "parity": parity, "restored": restored}).to_batches(max_chunksize=1000)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(common.tidied(encode), f"doc_id {kind}, n_tokens long, ids array<int>, ids_crc32 long, parity boolean, restored boolean")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids give a null text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else codec(path).decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")
