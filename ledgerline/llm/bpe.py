"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of a tree hold, for each token of a word, the rank of the pair it starts; an inner node holds the least of
its children, so the root is the lowest rank and walking down to the left finds where it first stands. A merge changes
two leaves, and only their paths to the root are computed again, until the root holds no rank. Words of up to 32
bytes are merged many at a time, a row of arrays each; longer ones one by one with the same tree.
"""

from __future__ import annotations

import hashlib
import json
from collections import ChainMap
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import batches_of, read

NONE = (1 << 62) - 1  # rank of a pair that no merge joins
WIDTHS = (8, 16, 32)  # leaves of the batched trees; a word has the smallest that holds its bytes
WIDE = WIDTHS[-1]     # longest word, in bytes, of a batched tree
CACHED = 130_000      # words of a generation; a worker remembers two


class Vocabulary:
    """Ids, merges, added tokens and the byte alphabet of a byte-level BPE file of the tokenizers library."""

    def __init__(self, description: str):
        from public_tokenizers import PATTERN
        import regex

        file = json.loads(description)
        # bytes that print stand for themselves, the others for the code points from 256 on, in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        alphabet = {b: chr(b) for b in shown}
        alphabet.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in alphabet)})
        back = {c: b for b, c in alphabet.items()}
        vocab = file["model"]["vocab"]
        self.byte_id = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of.update({i: t.encode() for t, i in self.added.items()})
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.size = 1 + max(self.bytes_of)
        self.merges = {vocab[a] * self.size + vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array(sorted(self.merges), np.int64)
        self.keys, self.ranks, self.joined = keys, np.array([self.merges[k][0] for k in keys.tolist()], np.int64), np.array([self.merges[k][1] for k in keys.tolist()], np.int64)
        self.words = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and joined ids of pairs; no rank where a side is missing or nothing joins them."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.joined[at]


def encode_long(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """One word of any length: a tree over its pairs, and links over merged tokens."""
    merges, size, n = vocabulary.merges, vocabulary.size, len(word)
    tokens = vocabulary.byte_id[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    leaves = 1 << max(1, (n - 1).bit_length())
    tree = [NONE] * (2 * leaves)
    missing = (NONE, -1)
    for i in range(n - 1):
        tree[leaves + i] = merges.get(tokens[i] * size + tokens[i + 1], missing)[0]
    for i in range(leaves - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i, rank):
        i += leaves
        tree[i] = rank
        i >>= 1
        while i:
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while tree[1] != NONE:
        i = 1
        while i < leaves:
            i = 2 * i + (tree[2 * i] > tree[2 * i + 1])
        i -= leaves
        j = after[i]
        tokens[i] = merges[tokens[i] * size + tokens[j]][1]
        tokens[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, NONE)
        put(i, merges.get(tokens[i] * size + tokens[after[i]], missing)[0] if after[i] < n else NONE)
        if before[i] >= 0:
            put(before[i], merges.get(tokens[before[i]] * size + tokens[i], missing)[0])
    return [t for t in tokens if t >= 0]


def encode_short(words: list[bytes], vocabulary: Vocabulary, wide: int = WIDE) -> list[list[int]]:
    """Words of at most ``wide`` bytes, a power of two, all trees side by side: each round merges one pair in every live word."""
    n, lengths = len(words), np.array([len(w) for w in words])
    raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(n, wide)
    places = np.arange(wide)
    tokens = np.where(places < lengths[:, None], vocabulary.byte_id[raw], -1)
    after = np.where(places + 1 < lengths[:, None], places + 1, wide)  # wide: no token follows
    before = np.broadcast_to(places - 1, (n, wide)).copy()
    padded = np.concatenate([tokens, np.full((n, 1), -1)], axis=1)
    tree = np.full((n, 2 * wide), NONE)
    tree[:, wide:] = vocabulary.lookup(padded[:, :-1], padded[:, 1:])[0]
    for level in (1 << b for b in reversed(range(wide.bit_length() - 1))):
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    def put(rows, at, rank):
        node = at + wide
        tree[rows, node] = rank
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    while len(live := np.nonzero(tree[:, 1] != NONE)[0]):
        node = np.ones(len(live), np.int64)
        while node[0] < wide:
            node = 2 * node + (tree[live, 2 * node] > tree[live, 2 * node + 1])
        i = node - wide
        j = after[live, i]
        k = after[live, j]
        padded[live, i] = vocabulary.lookup(padded[live, i], padded[live, j])[1]
        padded[live, j] = -1
        after[live, i] = k
        follows = k < wide
        before[live[follows], k[follows]] = i[follows]
        put(live, j, NONE)
        put(live, i, vocabulary.lookup(padded[live, i], np.where(follows, padded[live, k], -1))[0])
        p = before[live, i]
        has = p >= 0
        if has.any():
            rows = live[has]
            put(rows, p[has], vocabulary.lookup(padded[rows, p[has]], padded[rows, i[has]])[0])
    return [row[row >= 0].tolist() for row in padded[:, :-1]]


class Encoder:
    """Encodes texts with a bounded memory of the words seen so far: a full generation becomes the older one, from which words come back as they are met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known, self.older = vocabulary, {}, {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        new = [w for w in words if w not in self.known]
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        new = [w for w in new if w not in self.known]
        raw = [w.encode() for w in new]
        for wide in WIDTHS:
            short = [i for i, w in enumerate(raw) if wide // 2 < len(w) <= wide or len(w) <= wide == WIDTHS[0]]
            for start in range(0, len(short), 4096):
                part = short[start : start + 4096]
                for i, ids in zip(part, encode_short([raw[i] for i in part], self.vocabulary, wide)):
                    self.known[new[i]] = np.array(ids, "<u4").tobytes()
        for i, w in enumerate(raw):
            if len(w) > WIDE:
                self.known[new[i]] = np.array(encode_long(w, self.vocabulary), "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. Added tokens are found first; what stands between them is split into words."""
        v = self.vocabulary
        parts = [v.special(t) if v.special and any(a in t for a in v.added) else [t] for t in texts]
        split = [[[p] if p in v.added else v.words(p) for p in text] for text in parts]
        seen = set()
        for text in split:
            for part in text:
                seen.update(part)
        seen.difference_update(v.added)
        self.learn(seen)
        special = {a: np.array([i], "<u4").tobytes() for a, i in v.added.items()}
        known = ChainMap(special, self.known) if any(len(t) > 1 for t in split) else self.known
        for text in split:
            yield np.frombuffer(b"".join(map(known.__getitem__, chain.from_iterable(text))), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_decode(
    docs: DataFrame, vocabulary_file: str, text_column: str = "text", keep: list[str] | None = None, whole: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256`` and those of ``ids, decoded`` that ``whole`` names, of each text.

    ``vocabulary_file`` is read on the driver (a vocabulary has a fixed size) and travels with the tasks.
    Null texts count as empty: no ids, the empty string. ``keep`` names the columns of ``docs`` to return, all by
    default; those named like a computed one are replaced. Every row gives one row, repeated rows and empty
    tables included.
    """
    with open(vocabulary_file, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast({"file": file.read()})
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *whole]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    inside = docs.select(F.col(text_column).alias("_text"), *[F.col(c).alias(f"_in{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in shared.value:  # a worker's next task finds the vocabulary and the words that it has learned
            shared.value["encoder"] = Encoder(Vocabulary(shared.value["file"]))
        encoder = shared.value["encoder"]
        for batch in batches:
            start = 0
            for texts in batches_of(t.as_py() or "" for t in batch.column(0)):
                out = {name: [] for name in made}
                for codes in encoder.encode(texts):
                    decoded = encoder.decode(codes)
                    out["n_tokens"].append(len(codes))
                    out["ids_sha256"].append(hashlib.sha256(codes.tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if "ids" in whole:
                        out["ids"].append(codes.astype(np.int32))
                    if "decoded" in whole:
                        out["decoded"].append(decoded)
                part = batch.slice(start, len(texts))
                start += len(texts)
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays(
                    part.columns[1:] + [pa.array(out[m], kinds.get(m, pa.string())) for m in made],
                    names=batch.schema.names[1:] + made,
                )

    types = {"n_tokens": "long", "ids": "array<int>"}
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in inside.schema.fields[1:]]
        + [f"{m} {types.get(m, 'string')}" for m in made]
    )
    return inside.mapInArrow(run, schema).select([F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)] + made)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe_round_trip(spark, folder) -> DataFrame:
    return encode_decode(read(spark, folder, "documents"), default_vocabulary(), keep=["doc_id"], whole=())
