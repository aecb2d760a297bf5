"""Exact byte-pair encoding by dynamic programming over prefixes, decoding, and encoded lengths."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim, rest

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Fixed value: how this family of tokenizers splits a text before encoding.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker's tables of pieces and of token pairs may hold before they start anew.
PIECES, PAIRS = 150_000, 200_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: visible Latin-1 stands for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids by piece; works out what it lacks, and keeps it unless it is long."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > PIECES:
            self.clear()
        ids = tuple(self.encode(piece.encode()))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class PrefixBPE:
    """A byte-level BPE vocabulary as an automaton of its suffixes and a test of which tokens may be neighbours.

    Reading a piece byte by byte, the automaton holds the longest suffix that begins a token; along its suffix links
    lie all tokens that end there.  For each prefix exactly one of them is the last token of the prefix's encoding:
    the one that goes with the last token of what stands before it.  Two tokens go together if, undoing their merges
    from the latest, no merge across their border would have come first.  Back-pointers then give the ids.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes = [b""] * n
        for s, i in vocab.items():
            self.bytes[i] = raw(s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.rank, self.left, self.right, self.pair = [-1] * n, [0] * n, [0] * n, {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, t = vocab[a], vocab[b], vocab[a + b]
            self.pair[i * n + j] = r
            self.rank[t], self.left[t], self.right[t] = r, i, j
        self.n = n
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self.encode_piece)
        self.text_of = [str(i) for i in range(n)]
        self.split = regex.compile(PATTERN).findall
        specials = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({specials})").split if specials else None
        self._automaton([i for s, i in vocab.items()])

    def _automaton(self, ids: list[int]) -> None:
        go, depth, ends, paths = {}, [0], [-1], 1
        for i in ids:
            at = 0
            for b in self.bytes[i]:
                nxt = go.get(at << 8 | b)
                if nxt is None:
                    nxt = go[at << 8 | b] = paths
                    paths += 1
                    depth.append(depth[at] + 1)
                    ends.append(-1)
                at = nxt
            ends[at] = i
        link, found = [0] * paths, [()] * paths
        children: list[list[tuple[int, int]]] = [[] for _ in range(paths)]
        for k, s in go.items():
            children[k >> 8].append((k & 255, s))
        queue = [0]
        for at in queue:
            for b, s in children[at]:
                queue.append(s)
                if at:
                    f = link[at]
                    while f and (f << 8 | b) not in go:
                        f = link[f]
                    link[s] = go.get(f << 8 | b, 0)
                found[s] = (ends[s],) + found[link[s]] if ends[s] >= 0 else found[link[s]]
        self.go, self.link, self.found, self.length = go, link, found, [len(b) for b in self.bytes]

    def together(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether no merge across the border of tokens a and b comes before those inside them (and before ``limit``)."""
        rank, pair, n = self.rank, self.pair, self.n
        while True:
            if pair.get(a * n + b, limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def alone(self, t: int) -> bool:
        """Whether the bytes of token t encode as t itself."""
        if t not in self.whole:
            l, r = self.left[t], self.right[t]
            self.whole[t] = self.rank[t] < 0 or (self.alone(l) and self.alone(r) and self.together(l, r, self.rank[t]))
        return self.whole[t]

    def encode_piece(self, raw: bytes) -> list[int]:
        get, link, found, length, pairs, n = self.go.get, self.link, self.found, self.length, self.pairs, self.n
        if len(pairs) > PAIRS:
            pairs.clear()
        last, at = [0], 0
        for i, byte in enumerate(raw, 1):
            nxt = get(at << 8 | byte)
            while nxt is None and at:
                at = link[at]
                nxt = get(at << 8 | byte)
            at = nxt or 0
            for t in found[at]:
                m = length[t]
                if m == i:
                    if self.alone(t):
                        break
                else:
                    key = last[i - m] * n + t
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self.together(last[i - m], t)
                    if ok:
                        break
            else:
                raise ValueError("no token of the vocabulary ends this prefix")
            last.append(t)
        ids, i = [], len(raw)
        while i:
            ids.append(last[i])
            i -= length[last[i]]
        return ids[::-1]

    def parts(self, text: str | None):
        """The ids of each piece of the text."""
        if not text:
            return ()
        if self.cut is not None and any(s in text for s in self.special):
            return [p for k, x in enumerate(self.cut(text)) for p in ([(self.special[x],)] if k % 2 else map(self.pieces.__getitem__, self.split(x)))]
        return map(self.pieces.__getitem__, self.split(text))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; a null or empty text has none."""
        return list(itertools.chain.from_iterable(self.parts(text)))

    def joined(self, ids) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text)))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def encode_documents(docs: DataFrame, path: str = TOKENIZER, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded: one row per row of ``docs``.

    Needs doc_id and text; other columns are ignored.  A null text counts as empty: no ids, the hash of the empty
    string.  Repeated rows give repeated rows; an empty table gives none.  ``path`` must be readable on every worker.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches):
        claim("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for batch in batches:
            keys, out = batch.column(0), {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for text in batch.column(1):
                own = bpe.encode(text.as_py())
                decoded = bpe.decode(own)
                out["n_tokens"].append(len(own))
                out["ids_sha256"].append(hashlib.sha256(bpe.joined(own).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if ids:
                    out["ids"].append(own)
                    out["decoded"].append(decoded)
            types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32()), "decoded": pa.string()} if ids else {})
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(out[k], t) for k, t in types.items())], names=["doc_id", *types])
        rest()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens: encoded lengths only (null text: 0)."""

    def run(batches):
        claim("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.count(t.as_py()) for t in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])
        rest()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long")
