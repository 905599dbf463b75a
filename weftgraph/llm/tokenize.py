"""Corpus encoding with a byte-level BPE vocabulary by prefix-sharing trie traversal.

The encoding of a byte string is fixed by the last tokens of its prefixes: a
prefix's last token is the one whose bytes end the prefix and that may follow the
last token of what is left in front of it, and exactly one token is both. The
different words of a task go into a trie; a depth-first walk gives each node the
last token of its path, so a prefix that many words share is worked out once.
The encoding of a word is read backwards along its path.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import ship_package, spread

#: Where the public vocabulary file lies on every machine; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text into words before the merges of this vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Nodes and words a task keeps before it starts a new trie.
MOST_NODES = 400_000
MOST_WORDS = 300_000
#: Longer words are worked out on their own and not kept.
LONG_WORD = 2_048


class Vocabulary:
    """Ranks of the tokens by bytes; merges go by rank."""

    def __init__(self, path: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.token = {r: b for b, r in self.rank.items()}
        # lengths that tokens with the same last two bytes have, longest first
        ends: dict[bytes, set[int]] = {}
        for b in self.rank:
            ends.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {e: sorted(n, reverse=True) for e, n in ends.items()}
        self._follows: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent parts of the lowest rank, leftmost first, until none can."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.token[token]) == [token]
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in an encoding."""
        pair = left << 20 | right
        known = self._follows.get(pair)
        if known is None:
            if len(self._follows) > 2_000_000:
                self._follows.clear()
            known = self._follows[pair] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return known

    def last_token(self, path: bytes, end: int, before) -> int:
        """The last token of ``path[:end]``; ``before(k)`` is that of ``path[:k]``."""
        rank = self.rank
        for ending in (path[max(0, end - 2) : end], path[end - 1 : end]):
            for n in self.lengths.get(ending, ()):
                if n > end or (n == 1) != (len(ending) == 1):
                    continue
                token = rank.get(path[end - n : end])
                if token is not None and (self.whole(token) if n == end else self.follows(before(end - n), token)):
                    return token
            if end == 1:
                break
        raise ValueError("the vocabulary has no token for a single byte")


class WordTrie:
    """Words of a task; each node knows the last token of the path to it."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.children: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]
        self.words: dict[str, list[int]] = {}

    def encode(self, fresh: set[str]) -> None:
        """Insert new words, walk the new branches depth-first, and store the words' ids."""
        if len(self.last) > MOST_NODES or len(self.words) > MOST_WORDS:
            self.__init__(self.vocabulary)
        children, last, last_token = self.children, self.last, self.vocabulary.last_token
        size = self.vocabulary.token
        path_nodes = [0]
        previous = b""
        # sorted words are the depth-first order of the trie: the path is kept up to where two words part
        for word, data in sorted(((w, w.encode()) for w in fresh), key=lambda x: x[1]):
            if len(data) > LONG_WORD:
                self.words[word] = encode_alone(self.vocabulary, data)
                continue
            shared = 0
            for a, b in zip(previous, data):
                if a != b:
                    break
                shared += 1
            del path_nodes[shared + 1 :]
            for end in range(len(path_nodes), len(data) + 1):
                byte = data[end - 1]
                node = children[path_nodes[-1]].get(byte)
                if node is None:
                    node = len(last)
                    children[path_nodes[-1]][byte] = node
                    children.append({})
                    last.append(last_token(data, end, lambda k: last[path_nodes[k]]))
                path_nodes.append(node)
            previous = data
            ids, end = [], len(data)
            while end:
                token = last[path_nodes[end]]
                ids.append(token)
                end -= len(size[token])
            ids.reverse()
            self.words[word] = ids


def encode_alone(vocabulary: Vocabulary, data: bytes) -> list[int]:
    """The same states along a single path, for a word of any length."""
    last = [-1]
    for end in range(1, len(data) + 1):
        last.append(vocabulary.last_token(data, end, last.__getitem__))
    ids, end = [], len(data)
    while end:
        ids.append(last[end])
        end -= len(vocabulary.token[last[end]])
    return ids[::-1]


_LOADED: dict[str, Vocabulary] = {}


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = WORDS) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    One row per row of ``docs``. Null and empty texts give an empty array; text
    that looks like a special token is ordinary text; texts of any length are
    encoded whole. A map without shuffle: each task keeps the trie of its own
    words, so skew and repeated rows are harmless. Other columns are ignored.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = Vocabulary(vocabulary)
        split = regex.compile(pattern).findall
        trie = WordTrie(_LOADED[vocabulary])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [split(x) if x else [] for x in part.column(1).to_pylist()]
                fresh = {w for words in texts for w in words if w not in trie.words}
                if len(trie.last) > MOST_NODES or len(trie.words) > MOST_WORDS:
                    fresh = {w for words in texts for w in words}
                trie.encode(fresh)
                known = trie.words
                values: list[int] = []
                offsets = [0]
                for words in texts:
                    for w in words:
                        values += known[w]
                    offsets.append(len(values))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    rows = spread(docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")))
    return rows.mapInArrow(run, f"`{key}` bigint, ids array<int>")
