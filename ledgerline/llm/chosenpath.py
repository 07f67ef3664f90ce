"""Near-duplicate documents by a chosen-path set similarity join over MinHash signatures.

Each document is the set of its word shingles, and a signature of that set. A tree branches documents by
minwise tokens: the node a document is in chooses the next coordinate, and documents with the same token there go on
together. Similar documents stay together with the similarity's power of the depth, so independent trees are
repeated until a pair at the threshold meets in one of them with the wanted recall.

In each node every document is held against one of them, the pivot. Whatever is then in one component needs no
further look, which is what keeps a group of many near copies linear. Nodes that still hold several components
are compared exhaustively, large ones block by block, and the largest branch on along as many independent paths as
keep a pair at the threshold together in one of them with the wanted recall. A pair is looked at in the first tree it shares.
Every link is confirmed on full sets, inside its node: the sets of the documents that have a candidate there are brought to it,
and only links that join two components leave it. So a crowd of texts just below the threshold costs the comparisons of its pairs, but no row for
a pair.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, hidden, read, text_key
from ledgerline.llm.graph import components

TOKENS = 128   # coordinates of a signature, two bytes each
DEPTH = 5      # levels of a tree before its nodes are looked at
DEEPER = 8     # levels that a very large node branches at a time
SMALL = 1000   # documents that a node, or a block of one, may have to be compared exhaustively
BLOCKS = 32    # blocks up to which a large node is compared; each of its paths deeper would hold all its documents again
ROUNDS = 6     # times a node of more blocks branches on before they are compared with each other all the same
MISS = 1e-5    # chance that a pair at the threshold is lost: half of it in no tree together, half below the floor
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M1
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the distinct word shingles of a text. Words are runs of anything but ASCII white space, with A-Z
    in lower case; a text of fewer words than a shingle is one shingle, a text without words none."""

    def __init__(self, width: int):
        self.width, self.words = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(self.words) > 200_000:
            self.words.clear()
        known = self.words
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(codes))
        if not width:
            return codes
        total = np.full(len(codes) - width + 1, width, np.uint64)
        for i in range(width):
            total = mixed_bits(total * _M1 + codes[i : len(codes) - width + 1 + i])
        return np.unique(total)


def signature(codes: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set under ``TOKENS`` multiplications, folded to 16 bits each."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(codes), 512):
        np.minimum(least, np.multiply.outer(_FACTORS, codes[start : start + 512]).min(axis=1), out=least)
    return (mixed_bits(least) >> np.uint64(48)).astype(np.uint16)


def branch(nodes: np.ndarray, tokens: np.ndarray, levels: int) -> np.ndarray:
    """The nodes that documents reach after so many levels. ``tokens`` has a signature for each node."""
    rows = np.arange(len(nodes))
    for _ in range(levels):
        chosen = (nodes >> np.uint64(20)) % np.uint64(TOKENS)
        nodes = mixed_bits(nodes * _M1 + tokens[rows, chosen.astype(np.int64)].astype(np.uint64) + np.uint64(1))
    return nodes


def in_trees(tokens: np.ndarray, trees: int) -> np.ndarray:
    """The node of each signature in each of the first trees, ``DEPTH`` levels down: a row for each signature."""
    roots = mixed_bits(np.arange(1, trees + 1, dtype=np.uint64) * _M1)
    return branch(np.tile(roots, len(tokens)), np.repeat(tokens, trees, axis=0), DEPTH).reshape(len(tokens), trees)


def signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TOKENS)


def as_long(nodes: np.ndarray) -> pa.Array:
    return pa.array(nodes.view(np.int64), pa.int64())


class NearDuplicates:
    """One run over ``docs``. See ``near_duplicates``."""

    def __init__(self, docs: DataFrame, width: int, percent: int, id_column: str, text_column: str):
        self.scratch = Scratch(docs.sparkSession)
        self.width, self.percent = width, percent
        self.docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        level = percent / 100
        # all trees read one signature, so the chances are averaged over the coordinates that agree in it
        share = np.arange(TOKENS + 1) / TOKENS
        chance = np.array([math.comb(TOKENS, k) * level**k * (1 - level) ** (TOKENS - k) for k in range(TOKENS + 1)])
        least = int(np.searchsorted(np.cumsum(chance), MISS / 2, side="right"))
        share, chance, self.floor = share[least:], chance[least:], least / TOKENS
        if not least:
            raise ValueError(f"signatures of {TOKENS} tokens cannot tell a likeness of {percent} %")
        self.trees = self.paths = 1
        while (chance * (1 - share**DEPTH) ** self.trees).sum() > MISS / 4:
            self.trees += 1 + self.trees // 100
        while (chance * (1 - share**DEPTH * self.deeper(share)) ** self.trees).sum() > MISS / 2:
            self.paths += 1 + self.paths // 20

    def deeper(self, share: np.ndarray) -> np.ndarray | float:
        """The chance that a pair whose signatures agree in ``share`` is together in some node after all rounds of branching on."""
        kept = 1.0
        for _ in range(ROUNDS):
            kept = 1 - (1 - share**DEEPER * kept) ** self.paths
        return kept

    def run(self) -> DataFrame:
        scratch = self.scratch
        sets = scratch.save(self.signed(), "sets")
        reps = scratch.save(
            sets.where("n_shingles > 0").groupBy("key")
            .agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("r"),
                F.first("tokens").alias("tokens"), F.first("n_shingles").alias("shingles"),
            )
            .select(F.monotonically_increasing_id().alias("v"), "key", "r.doc_id", "r.text_key", "tokens", "shingles"),
            "reps",
        )
        nodes = scratch.save(self.shared(self.rooted(reps)), "nodes")
        texts = scratch.save(self.texts(reps, nodes), "texts")
        tried = scratch.save(
            nodes.where("v <> pivot").select(F.col("v").alias("a"), F.col("pivot").alias("b")).distinct(), "tried"
        )
        links = scratch.save(self.confirmed(tried, texts), "links")
        labels = components(links, scratch)
        part = nodes.where("size > 2").select("node", "tree", "v")  # a node of two was settled by its pivot
        links = links.unionByName(scratch.save(self.compared(part, labels, reps, texts), "links"))
        return self.classes(sets, reps, components(links, scratch))

    def signed(self) -> DataFrame:
        """``doc_id, text_key, n_shingles, key, tokens`` of each document; the key stands for the whole set."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles = Shingler(width)
            for batch in batches:
                n, keys, tokens = [], [], []
                for text in batch.column("text"):
                    codes = shingles(text.as_py())
                    n.append(len(codes))
                    keys.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else None)
                    tokens.append(signature(codes).tobytes() if len(codes) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "key", "tokens"],
                )

        rows = self.docs.withColumn("text_key", text_key(F.col("text")))
        return rows.mapInArrow(run, "doc_id long, text_key binary, n_shingles long, key binary, tokens binary")

    def rooted(self, reps: DataFrame) -> DataFrame:
        """``node, tree, v``: the node of each set in each tree, ``DEPTH`` levels down."""
        trees = self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    nodes = in_trees(signatures(part.column("tokens")), trees).ravel()
                    tree = np.tile(np.arange(trees, dtype=np.int32), part.num_rows)
                    v = np.repeat(part.column("v").to_numpy(), trees)
                    yield pa.RecordBatch.from_arrays([as_long(nodes), pa.array(tree), pa.array(v)], names=["node", "tree", "v"])

        return reps.select("v", "tokens").mapInArrow(run, "node long, tree int, v long")

    def shared(self, nodes: DataFrame) -> DataFrame:
        """``node, tree, v, size, pivot`` of the nodes with two or more sets. Counting combines in the tasks; the join has
        one saved row per node on one side, so a node with a third of all sets is split."""
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("pivot")).where("size > 1")
        return nodes.join(self.scratch.save(sizes, "sizes"), "node")

    def texts(self, reps: DataFrame, nodes: DataFrame) -> DataFrame:
        """``v, text`` of the sets that share a node with another."""
        no_id = F.lit(-(1 << 63))
        wanted = nodes.select("v").distinct().join(reps.select("v", "doc_id", "text_key"), "v").select(
            "v", F.coalesce("doc_id", no_id).alias("id"), "text_key"
        )
        named = self.docs.select(F.coalesce("doc_id", no_id).alias("id"), text_key(F.col("text")).alias("text_key"), "text")
        return named.join(wanted, ["id", "text_key"]).select("v", "text").dropDuplicates(["v"])

    def confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs whose full sets reach the threshold."""
        width, percent = self.width, self.percent
        sides = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b"
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, known = Shingler(width), OrderedDict()

            def codes(name, text):
                if name in known:
                    known.move_to_end(name)
                else:
                    known[name] = shingles(text.as_py())
                    if len(known) > 64:
                        known.popitem(last=False)
                return known[name]

            for batch in batches:
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                keep = []
                for i in range(batch.num_rows):
                    x, y = codes(a[i], batch.column("text_a")[i]), codes(b[i], batch.column("text_b")[i])
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(i)
                if keep:
                    yield pa.RecordBatch.from_pydict({"a": [a[i] for i in keep], "b": [b[i] for i in keep]})

        return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")

    def compared(self, nodes: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
        """``a, b``: links that join the components of a node, confirmed on full sets. Pairs that a node's links already join are left out.

        Nodes above ``SMALL`` are cut into blocks, and each block is compared with each. Those of more than ``BLOCKS``
        blocks branch on first, each along all of its paths, for up to ``ROUNDS`` rounds. A pair is looked at in the first tree it
        shares, unless one of the two has a node that branches on, where pairs may part.
        """
        scratch = self.scratch
        part, found, crowded = self.open(nodes, labels), [], None
        for turn in range(ROUNDS + 1):
            most = BLOCKS * SMALL if turn < ROUNDS else (1 << 63) - 1
            held = scratch.save(part.join(reps.select("v", "tokens", "shingles"), "v"), "open")
            large = held.where(F.col("size") > most)
            if crowded is None:
                crowded = scratch.save(large.select("v").distinct().withColumn("crowded", F.lit(True)), "crowded")
            settled = held.where(F.col("size") <= most).join(crowded, "v", "left").withColumn(
                "first", F.when(F.col("crowded").isNull(), F.col("tree")).otherwise(-1)
            )
            found.append(scratch.save(self.linked(self.involved(settled), texts), "found"))
            if large.isEmpty():
                break
            part = self.open(scratch.save(self.branched(large), "deeper").withColumn("tree", F.lit(-1)), labels)
        return reduce(DataFrame.unionByName, found).distinct()

    def open(self, nodes: DataFrame, labels: DataFrame) -> DataFrame:
        """``node, tree, v, label, size`` of the nodes that hold more than one component."""
        named = nodes.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
        sizes = named.groupBy("node").agg(
            F.count(F.lit(1)).alias("size"), F.min("label").alias("least"), F.max("label").alias("most")
        ).where("least < most")
        return named.join(self.scratch.save(sizes.select("node", "size"), "sizes"), "node").select("node", "tree", "v", "label", "size")

    def branched(self, large: DataFrame) -> DataFrame:
        """``node, v`` of each set ``DEEPER`` levels down, on ``paths`` ways that choose their coordinates by themselves."""
        paths = self.paths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = mixed_bits(np.arange(1, paths + 1, dtype=np.uint64) * _M2)
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    roots = mixed_bits(part.column("node").to_numpy().view(np.uint64)[:, None] ^ seeds).ravel()
                    nodes = branch(roots, np.repeat(signatures(part.column("tokens")), paths, axis=0), DEEPER)
                    yield pa.RecordBatch.from_arrays([as_long(nodes), pa.array(np.repeat(part.column("v").to_numpy(), paths))], names=["node", "v"])

        return large.select("node", "v", "tokens").mapInArrow(run, "node long, v long")

    def involved(self, members: DataFrame) -> DataFrame:
        """The members that have a candidate of another component, with the pair of blocks of the node they are compared in.

        ``size / SMALL`` blocks, each against each; a node up to ``SMALL`` is one block.
        """
        floor, percent = self.floor, self.percent
        blocks = F.ceil(F.col("size") / SMALL).cast("int")
        own = F.pmod(F.xxhash64("v"), blocks.cast("long")).cast("int")
        spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        columns = ["node", "x", "y", "own", "v", "label", "first", "shingles", "tokens"]
        dealt = spread.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).select(*columns)

        def run(table: pa.Table) -> pa.Table:
            group = Group(table, floor, percent)
            wanted = np.zeros(table.num_rows, bool)
            for i, others in group.candidates():
                wanted[i] = True
                wanted[others] = True
            return table.filter(pa.array(wanted))

        schema = "node long, x int, y int, own int, v long, label long, first int, shingles long, tokens binary"
        return dealt.groupBy("node", "x", "y").applyInArrow(run, schema)

    def linked(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """``a, b`` of the confirmed links that join two components of a group: fewer than it has members."""
        floor, percent, width = self.floor, self.percent, self.width

        def run(table: pa.Table) -> pa.Table:
            shingles, group = Shingler(width), Group(table, floor, percent)
            sets = [shingles(text.as_py()) for text in table.column("text")]
            parent = {label: label for label in group.label.tolist()}

            def root(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            a, b = [], []
            for i, others in group.candidates():
                for j in others.tolist():
                    one, two = root(int(group.label[i])), root(int(group.label[j]))
                    if one == two:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        parent[one] = two
                        a.append(int(group.v[i]))
                        b.append(int(group.v[j]))
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return members.join(texts, "v").groupBy("node", "x", "y").applyInArrow(run, "a long, b long")

    def classes(self, sets: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
        """``doc_id, text_key, n_shingles, component_id, kept`` of each document."""
        labelled = reps.select("v", "key", "doc_id", "text_key").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
        least = self.scratch.save(labelled.groupBy("label").agg(first.alias("r")).select("label", "r.doc_id", "r.text_key"), "least")
        named = self.scratch.save(
            labelled.select("label", "key").join(least, "label").select("key", F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")), "named"
        )
        some = F.col("n_shingles") > 0
        return sets.select("doc_id", "text_key", "n_shingles", "key").join(named, "key", "left").select(
            "doc_id", "text_key", "n_shingles",
            F.when(some, F.col("_id")).otherwise(F.col("doc_id")).alias("component_id"),
            (~some | (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text")))).alias("kept"),
        )


def agreeing(tokens: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The share of its coordinates in which each signature agrees with ``one``; the bytes of a word are added side by side."""
    sums = (tokens == one).view(np.uint64).sum(axis=1, dtype=np.uint64)
    return sums.view(np.uint8).reshape(-1, 8).sum(axis=1) / TOKENS


class Group:
    """Members of one node, or of two of its blocks, and the pairs of them that may be linked."""

    def __init__(self, table: pa.Table, floor: float, percent: int):
        self.floor, self.percent = floor, percent
        value = lambda name: table.column(name).to_numpy()
        self.v, self.label, self.shingles, own = value("v"), value("label"), value("shingles"), value("own")
        self.tokens = signatures(table.column("tokens"))
        x, y = (int(value(c)[0]) if len(self.v) else 0 for c in ("x", "y"))
        self.left, self.right = np.nonzero(own == x)[0], np.nonzero(own == y)[0]
        self.same = x == y
        # nodes in the trees before; members that may not rely on them have a first of -1
        first = value("first")
        self.sure = first >= 0
        trees = int(first.max(initial=-1))
        self.before = in_trees(self.tokens, trees) if trees > 0 else None

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with others of another label, likely ones first: their signatures agree in at least the floor, their sizes allow the
        threshold, and this is the first tree that both share."""
        for place, i in enumerate(self.left.tolist()):
            others = self.right[place + 1 :] if self.same else self.right
            small, large = np.minimum(self.shingles[others], self.shingles[i]), np.maximum(self.shingles[others], self.shingles[i])
            others = others[(self.label[others] != self.label[i]) & (100 * small >= self.percent * large)]
            if not len(others):
                continue
            agree = agreeing(self.tokens[others], self.tokens[i])
            good = agree >= self.floor
            others, agree = others[good], agree[good]
            if self.before is not None and self.sure[i] and len(others):
                known = self.sure[others] & (self.before[others] == self.before[i]).any(axis=1)
                others, agree = others[~known], agree[~known]
            if len(others):
                yield i, others[np.argsort(-agree, kind="stable")]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept`` of each document.

    Documents are linked when the shingles of ``width`` words that they share are at least ``percent`` in a hundred of all
    that either has; a component is what links reach, named by its smallest id, and its document of that id is kept (of
    several with that id, the one of least ``text_key``).

    - Shingles are compared by 64-bit hashes. Equal sets are one vertex, so copies are never paired with each other.
    - A text without words has no shingles, is linked with nothing and kept; null counts as empty.
    - Rows of one id with different texts are different documents; repeated rows get the same answer. Ids that are null
      count as larger than any other, and only a component of nothing else has a null name.
    - An empty table gives no rows. Other columns are never read.

    ``text_key`` is a digest of the text, so that a caller can find the rows again.
    """
    return NearDuplicates(docs, width, percent, id_column, text_column).run()


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, one of each group; of repeated rows with words one stays, texts without words all stay.

    Columns of ``docs`` may have any names; nulls and empty tables as in ``near_duplicates``.
    """
    no_id, (inside, names) = F.lit(-(1 << 63)), hidden(docs)
    name, text = F.col(names[id_column]), F.col(names[text_column])
    kept = near_duplicates(docs, width, percent, id_column, text_column).where("kept")
    kept = kept.groupBy(F.coalesce("doc_id", no_id).alias("_id"), F.col("text_key").alias("_text")).agg(F.max("n_shingles").alias("_n"))
    kept = Scratch(docs.sparkSession).save(kept, "kept")
    same = (F.coalesce(name.cast("long"), no_id) == F.col("_id")) & (text_key(text) == F.col("_text"))
    one = Window.partitionBy("_id", "_text").orderBy(F.lit(0))
    first = inside.join(kept, same).withColumn("_nth", F.row_number().over(one)).where("_n = 0 OR _nth = 1")
    return first.select([F.col(n).alias(c) for c, n in names.items()])


def op7_near_duplicates(spark, folder) -> DataFrame:
    found = near_duplicates(read(spark, folder, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
