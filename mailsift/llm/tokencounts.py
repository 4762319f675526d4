"""Token counts by dynamic programming over a trie of pre-tokens.

A text's count is the sum over its pre-tokens (blank-separated words with the marker in front) of the number of pieces in
the best unigram segmentation, the one of highest score sum. The best score of a prefix depends on the prefix alone. So the
distinct pre-tokens are inserted in a trie, each node's forward score is computed once, when the node is made, from those of
its ancestors, and the node where a pre-token ends stores its count. A worker keeps its trie from task to task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from mailsift.llm import common
from mailsift.llm.pieces import MARK, parsed

#: Nodes beyond which a worker plants its trie anew. It bounds memory and changes no count.
NODES = 1_500_000
#: How much less than the lowest score a character without a piece has, as in the tokenizers library.
UNKNOWN = 10.0


class Trie:
    """Pre-tokens seen so far, with the forward score and the number of pieces of every prefix."""

    def __init__(self, scores: dict[str, float], by_bytes: bool = False):
        self.scores, self.by_bytes = scores, by_bytes
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.forward, self.pieces, self.after_unknown = [0.0], [0], [False]

    def count(self, word: str) -> int:
        """The number of pieces in the word's best segmentation. Of equal scores the longest last piece wins. Characters
        without a piece are a piece for each of their bytes if the model has these, else one piece in a row."""
        path = [0]
        node, children = 0, self.children
        for end in range(1, len(word) + 1):
            key = (node, word[end - 1])
            node = children.get(key, -1)
            if node < 0:
                node = children[key] = len(self.forward)
                self.extend(word, end, path)
            path.append(node)
        return self.pieces[node]

    def extend(self, word: str, end: int, path: list[int]) -> None:
        """The forward score of word[:end], whose last node is new, from those of the nodes before it."""
        best, source = -np.inf, -1
        for start in range(max(0, end - self.longest), end):
            score = self.scores.get(word[start:end])
            if score is not None and self.forward[path[start]] + score > best:
                best, source = self.forward[path[start]] + score, path[start]
        previous, known = path[end - 1], word[end - 1 : end] in self.scores
        if not known and self.forward[previous] + self.unknown > best:
            self.forward.append(self.forward[previous] + self.unknown)
            more = len(word[end - 1].encode()) if self.by_bytes else not self.after_unknown[previous]
            self.pieces.append(self.pieces[previous] + more)
            self.after_unknown.append(True)
        else:
            self.forward.append(best)
            self.pieces.append(self.pieces[source] + 1)
            self.after_unknown.append(False)


def piece_scores(path: str) -> dict[str, float]:
    """The normal pieces of a SentencePiece model with their scores."""
    return {p.piece: p.score for p in parsed(path).pieces if p.type == 1}


@functools.cache
def trie(path: str) -> tuple[Trie, dict[str, int]]:
    """One for each worker process, with the counts at terminals."""
    return Trie(piece_scores(path), parsed(path).trainer_spec.byte_fallback), {}


def counted(texts: pa.ChunkedArray, planted: Trie, terminal: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(words, tokens) of each text."""
    data, offsets = common.text_bytes(texts)
    words = common.words(data, offsets)
    inside = ~common.SPACE[data]
    ends = np.append(0, np.cumsum(words.end - words.start))
    found = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))).dictionary_encode()
    if len(planted.forward) > NODES:
        planted.clear()
        terminal.clear()
    distinct = found.dictionary.to_pylist()
    for word in distinct:
        if word not in terminal:
            terminal[word] = planted.count(MARK + word)
    of = np.fromiter(map(terminal.__getitem__, distinct), np.int64, len(distinct))
    docs = np.append(0, np.cumsum(words.per_doc))
    return words.per_doc, common.sums(of[found.indices.to_numpy()], docs)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of `docs`. A null or empty text has none; other columns are not read.

    A character without a piece counts as its UTF-8 bytes where the model falls back to bytes, as the given one does.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches):
            n_words, n_tokens = counted(rows["text"], *trie(path))
            yield from pa.table({"doc_id": rows["doc_id"], "n_words": n_words, "n_tokens": n_tokens}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
