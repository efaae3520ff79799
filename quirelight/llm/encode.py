"""Problem 8: encoding of a corpus with a public byte-level BPE vocabulary.

Speculate and verify. A text is cut into words by the vocabulary's published
pattern. For each word not seen before in the Python worker

* greedy longest match (an automaton over the vocabulary's byte strings) proposes
  a token sequence;
* one vectorised check tests every adjacent pair of all proposals: a sequence is
  what the merges would give exactly if no merge across any border of two
  neighbours would have come before the merges inside them. The check unwinds both
  tokens along the border, all pairs at a time;
* only words with a pair that fails are merged exactly.

The tables depend on the vocabulary alone (50,257 entries), are built on the
driver and broadcast; the path of the vocabulary is a parameter.

Defined cases: null and empty texts give an empty list; repeated doc_ids give a
row each; special-token strings in a text are ordinary text; whole texts only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of a worker's word cache before it is started anew.
CACHE_WORDS = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens that the last merge of ``token`` joins; None if the merges don't reach it."""
    own = ranks[token]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = own, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], own)
            if r < best:
                best, at = r, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return ranks[parts[0]], ranks[parts[1]]


def pair_tables(path: str) -> dict:
    """Arrays for the pair check: left and right part of each token, and the merges by pair."""
    ranks = read_ranks(path)
    size = max(ranks.values()) + 1
    left, right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
    whole = np.ones(size, bool)
    for token, r in ranks.items():
        if len(token) > 1:
            if parts := _last_merge(token, ranks):
                left[r], right[r] = parts
            else:
                whole[r] = False
    merged = np.flatnonzero((left != np.arange(size)) & whole)
    keys = left[merged] * size + right[merged]
    order = np.argsort(keys)
    return {"size": size, "left": left, "right": right, "whole": whole, "keys": keys[order], "to": merged[order]}


def compatible(a: np.ndarray, b: np.ndarray, t: dict) -> np.ndarray:
    """Whether the merges leave the border between the tokens a[i] and b[i] alone.

    Token ids are merge ranks, so the later of the two tokens is unwound first: a
    merge across the border wins if its rank is below the one that was unwound.
    """
    n = len(a)
    ok = np.ones(n, bool)
    a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
    limit = np.full(n, np.iinfo(np.int64).max)
    live = np.arange(n)
    keys, to, left, right, size = t["keys"], t["to"], t["left"], t["right"], t["size"]
    while len(live):
        x, y, lim = a[live], b[live], limit[live]
        k = x * size + y
        pos = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        bad = (keys[pos] == k) & (to[pos] < lim)
        ok[live[bad]] = False
        live, x, y = live[~bad], x[~bad], y[~bad]
        first = x > y
        nx, ny = right[x], left[y]
        end_x, end_y = nx == x, ny == y  # single bytes can't be unwound
        use_x = (first & ~end_x) | (~first & end_y)
        use_y = ~use_x
        limit[live] = np.where(use_x, x, y + 1)
        a[live] = np.where(use_x, nx, x)
        b[live] = np.where(use_y, ny, y)
        done = end_x & end_y
        # once the smaller side is unwound too, the other side's limit holds for it
        live = live[~done]
    return ok


class Encoder:
    """Encodes words in a Python worker; one instance for each vocabulary and worker."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str, tables: dict):
        import ahocorasick
        import public_tokenizers
        import regex
        import tiktoken

        ranks = read_ranks(path)
        self.tables, self.cache = tables, {}
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.trie = ahocorasick.Automaton()
        for token, r in ranks.items():
            self.trie.add_word(token.decode("latin-1"), (r, len(token)))
        self.trie.make_automaton()
        self.exact = tiktoken.Encoding("exact", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str, tables: dict) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path, tables)
        return cls._of[path]

    def learn(self, words: list[str]) -> int:
        """Add ``words`` to the cache; returns how many were merged exactly."""
        raw = [w.encode("utf-8", "surrogatepass").decode("latin-1") for w in words]
        proposals = [[v[0] for _, v in self.trie.iter_long(r)] for r in raw]
        lens = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(lens.sum()))
        word = np.repeat(np.arange(len(words)), lens)
        bad = np.zeros(len(words), bool)
        bad[word[~self.tables["whole"][flat]]] = True
        pair = np.flatnonzero(word[1:] == word[:-1])
        if len(pair):
            kinds, at = np.unique(flat[pair] * self.tables["size"] + flat[pair + 1], return_inverse=True)
            good = compatible(kinds // self.tables["size"], kinds % self.tables["size"], self.tables)
            bad[word[pair[~good[at]]]] = True
        for w, p, b in zip(words, proposals, bad):
            self.cache[w] = self.exact.encode_ordinary(w) if b else p
        return int(bad.sum())

    def words(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them in the cache."""
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if new := list(set(chain.from_iterable(cut)).difference(self.cache)):
            self.learn(new)
        return cut

    def texts(self, texts: list[str | None]) -> list[list[list[int]]]:
        cut, get = self.words(texts), self.cache.__getitem__
        return [list(map(get, words)) for words in cut]

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        cut, get = self.words(texts), self.cache.__getitem__
        return [sum(map(len, map(get, words))) for words in cut]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each row's text, in one pass without a shuffle."""
    path = path or vocabulary_path()
    tables = df.sparkSession.sparkContext.broadcast(pair_tables(path))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path, tables.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = enc.texts(part.column(1).to_pylist())
                counts = np.fromiter((sum(map(len, r)) for r in rows), np.int32, len(rows))
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(rows)), np.int32, int(counts.sum()))
                ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens) of each row's text; only the counts leave the Python workers."""
    path = path or vocabulary_path()
    tables = df.sparkSession.sparkContext.broadcast(pair_tables(path))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path, tables.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(enc.counts(part.column(1).to_pylist()), pa.int64())], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, n_tokens bigint")
