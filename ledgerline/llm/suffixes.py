"""Removal of long byte strings that occur more than once, by sorting the suffixes that can match.

Any two equal windows of ``length`` bytes have the same least hash among the short grams inside them. Windows
side by side with one least gram form a run, and only runs whose gram occurs in another run can hold a repeated
window. The runs of one gram meet in one bucket, where the suffixes at their windows are sorted deep-shallow: by
their first words in a multikey quicksort, and groups that still agree by a blind trie, which looks only at the
word where a suffix leaves its group's leader. Suffixes that end up together are equal.

Runs with one content are one row before anything is sorted. The runs of a gram with very many different ones are
cut anew by a longer gram of their windows, again and again, up to the whole window: most of what surrounds a common
passage is alone in its longer grams, and what is not meets in smaller groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, read, text_key

LENGTH = 200   # bytes of a string that must not occur twice
SHALLOW = 3    # words of 8 bytes sorted before the tries
RUN = 128      # windows of a run in a period, about; the others are shorter than a window
BUCKET = 3000  # runs of a bucket, about; a gram with more different ones is cut by a longer gram
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(3).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as far as texts have needed them."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 1 << n.bit_length())
            steps = [np.full(size, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
            for step in steps:
                step[0] = 1
            self.up, self.down = (np.cumprod(step, dtype=np.uint64) for step in steps)
        return self.up[:n], self.down[:n]


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_lengths(length: int) -> list[int]:
    """From a quarter of a window to all of it; each leaves a quarter of what the one before left out."""
    grams = [max(8, length // 4)]
    while grams[-1] < length:
        grams.append(length - (length - grams[-1]) // 4)
    return grams


def runs_of(raw: np.ndarray, length: int, powers: Powers, gram: int):
    """Least gram of ``gram`` bytes, first window, windows and content hash of each run of a text."""
    if len(raw) < length:
        return (np.empty(0, np.uint64),) * 4
    up, down = powers.upto(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[raw] * up[: len(raw)])])
    grams = mixed_bits((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    # the least gram by its upper half, the leftmost of equals: one number holds both
    least, span, across = (grams & np.uint64(0xFFFFFFFF << 32)) | np.arange(len(grams), dtype=np.uint64), 1, length - gram + 1
    while 2 * span <= across:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < across:
        least = np.minimum(least[: len(grams) - across + 1], least[across - span :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1])
    chosen = grams[place[first]]
    again = np.concatenate([[False], chosen[1:] == chosen[:-1]])
    if again.any():  # a period: its windows can equal each other, so it is two runs at least, but not one for each place
        start_of = np.maximum.accumulate(np.where(again, 0, np.arange(len(first))))
        cut = ~again | (np.arange(len(first)) == start_of + 1)
        second = np.maximum.accumulate(np.where(cut, first, 0))
        piece = (first - second) // RUN
        cut |= np.concatenate([[False], piece[1:] != piece[:-1]])
        first, chosen = first[cut], chosen[cut]
    count = np.diff(np.append(first, len(place)))
    content = mixed_bits((sums[first + count - 1 + length] - sums[first]) * down[first] + count.astype(np.uint64))
    return chosen, first, count, content


def words_at(text: np.ndarray) -> np.ndarray:
    """The word of 8 bytes that starts at each byte, as a number that sorts like the bytes."""
    return np.lib.stride_tricks.sliding_window_view(text, 8).copy().view(">u8")[:, 0].astype(np.uint64)


def groups_by(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, the first most, and the number of each row's group in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, np.cumsum(new)


def multikey(words: np.ndarray, starts: np.ndarray, group: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The starts that agree with another of their group in the words at all of ``at``, in order, and their new groups.

    A multikey quicksort of all groups side by side: each group is parted in three by the word of one of its members, the
    middle part goes on with the next word, the outer parts with the same one; groups of one are done.
    """
    rng = np.random.default_rng(5)
    rows = np.argsort(group, kind="stable")
    number, depth, places = group[rows], np.zeros(len(rows), np.int64), np.array(at, np.int64)
    done, names, last = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while len(rows):
        head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        size = np.diff(np.append(head, len(rows)))
        nth = np.repeat(np.arange(len(head)), size)
        through = depth == len(places)
        several = (size > 1)[nth]
        if (through | ~several).any():
            out = through & several
            done.append(rows[out])
            names.append(nth[out] + last)
            last += len(head)
            stay = several & ~through
            rows, number, depth = rows[stay], nth[stay], depth[stay]
            continue
        word = words[starts[rows] + places[depth]]
        pivot = word[head + (rng.random(len(head)) * size).astype(np.int64)][nth]
        side = (word >= pivot).astype(np.int64) + (word > pivot)
        number = 3 * nth + side
        order = np.argsort(number, kind="stable")
        rows, number, depth = rows[order], number[order], (depth + (side == 1))[order]
    return np.concatenate(done), np.concatenate(names)


def equal_suffixes(text: np.ndarray, starts: np.ndarray, length: int, group: np.ndarray | None = None) -> np.ndarray:
    """For each start the index of one start whose ``length`` bytes are equal, the same for all that are.

    Starts of different ``group`` are known to differ.
    """
    words = words_at(text)
    at = list(range(0, length - 7, 8)) + ([length - 8] if length % 8 else [])
    same = np.arange(len(starts))
    rows, group = multikey(words, starts, np.zeros(len(starts), np.int64) if group is None else group, at[:SHALLOW])
    deep = np.array(at[SHALLOW:])
    while len(rows) and len(deep):  # a node of the trie for each group: its leader, and the words where others leave it
        head = np.concatenate([[True], group[1:] != group[:-1]])
        leader = rows[head][np.cumsum(head) - 1]
        leaves = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), 1 << 15):
            part = slice(i, i + (1 << 15))
            differs = words[starts[rows[part], None] + deep] != words[starts[leader[part], None] + deep]
            leaves[part] = np.where(differs.any(axis=1), differs.argmax(axis=1), len(deep))
        equal = leaves == len(deep)
        same[rows[equal]] = leader[equal]
        rows, group, leaves = rows[~equal], group[~equal], leaves[~equal]
        if not len(rows):
            break
        order, number = groups_by(group, leaves, words[starts[rows] + deep[leaves]])
        rows = rows[order]
        several = np.bincount(number)[number] > 1
        rows, group = rows[several], number[several]
    if not len(deep):
        head = np.concatenate([[True], group[1:] != group[:-1]]) if len(rows) else np.empty(0, bool)
        same[rows] = rows[head][np.cumsum(head) - 1] if len(rows) else rows
    return same


def stretches(marked: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def sorted_bucket(table: pa.Table, length: int) -> pa.Table:
    """``key, start, stop``: spans of single runs that hold repeated windows."""
    data = [np.frombuffer(b, np.uint8) for b in table.column("bytes").to_pylist()]
    counts = np.array([len(d) - length + 1 for d in data])
    text = np.concatenate(data + [np.zeros(8, np.uint8)])
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]])
    owner, ends = np.repeat(np.arange(len(data)), counts), np.cumsum(counts)
    starts = np.repeat(offsets - ends + counts, counts) + np.arange(len(owner))
    same = equal_suffixes(text, starts, length, np.unique(table.column("gram").to_numpy(), return_inverse=True)[1][owner])
    repeated = np.bincount(same, minlength=len(same))[same] > 1
    keys, first = table.column("key").to_pylist(), table.column("first").to_numpy()
    out = [
        (keys[i], int(first[i]) + a, int(first[i]) + b - 1 + length)
        for i in np.flatnonzero(table.column("single").to_numpy())
        for a, b in stretches(repeated[ends[i] - counts[i] : ends[i]])
    ]
    kinds = (("key", pa.binary()), ("start", pa.int64()), ("stop", pa.int64()))
    return pa.table({name: pa.array([row[j] for row in out], kind) for j, (name, kind) in enumerate(kinds)})


def repeated_spans(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """``key, spans``: for each text, by its key, the bytes covered by strings that start elsewhere too.

    ``docs`` has ``doc_id, key, raw``. Every aggregation below combines in the tasks, and every join meets a saved table that is
    unique on its key, so that adaptive execution can split a key that a third of the rows share.
    """

    shortest = gram_lengths(length)[0]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            held = []
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column("raw")[i].as_buffer(), np.uint8)
                gram, first, count, content = runs_of(raw, length, powers, shortest)
                if len(gram):
                    key = batch.column("key")[i].as_py()
                    held.append(pa.RecordBatch.from_arrays(
                        [pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)), pa.array([key] * len(gram), pa.binary()),
                         pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16))],
                        names=["gram", "content", "key", "first", "count"],
                    ))
                if len(held) >= 200:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    runs = docs.select("key", "raw").mapInArrow(find, "gram long, content long, key binary, first int, count short")
    found, contents = grouped(runs.withColumn("single", F.lit(True)), length, scratch)
    found = [found, *sorted_contents(docs, contents, length, scratch)]
    spans = reduce(DataFrame.unionByName, found).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return scratch.save(spans, "spans")


def grouped(runs: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``key, start, stop`` of the single runs with a content that another run of their gram has, and one row for each content
    of the grams that have several (``gram, content, single, key, first, count``)."""
    grams = scratch.save(
        runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("content") < F.max("content")).alias("mixed"))
        .where("n > 1").select("gram", "mixed"),
        "grams",
    )
    shared = scratch.save(runs.join(grams, "gram"), "shared")
    contents = scratch.save(
        shared.where("mixed").groupBy("gram", "content").agg(
            F.count(F.lit(1)).alias("n"), F.min("single").alias("single"), F.min(F.struct("key", "first", "count")).alias("r")
        ).select("gram", "content", (F.col("single") & (F.col("n") == 1)).alias("single"), (F.col("n") > 1).alias("several"), "r.key", "r.first", "r.count"),
        "contents",
    )
    several = contents.where("several").select("gram", "content")
    again = shared.where("NOT mixed").unionByName(shared.where("mixed").join(several, ["gram", "content"]))
    stop = (F.col("first") + F.col("count") - 1 + length).cast("long")
    return (
        again.where("single").select("key", F.col("first").cast("long").alias("start"), stop.alias("stop")),
        contents.drop("several"),
    )


def finer(runs: DataFrame, gram: int, length: int) -> DataFrame:
    """The runs cut anew by the least gram of ``gram`` bytes in their windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [runs_of(np.frombuffer(b.as_buffer(), np.uint8), length, powers, gram) for b in batch.column("bytes")]
            owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            grams, first, count, content = (np.concatenate(column) for column in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), pa.array(content.view(np.int64)), batch.column("key").take(pa.array(owner)),
                 pa.array((batch.column("first").to_numpy()[owner] + first).astype(np.int32)), pa.array(count.astype(np.int16)),
                 batch.column("single").take(pa.array(owner))],
                names=["gram", "content", "key", "first", "count", "single"],
            )

    return runs.select("key", "first", "single", "bytes").mapInArrow(cut, "gram long, content long, key binary, first int, count short, single boolean")


def sorted_contents(docs: DataFrame, contents: DataFrame, length: int, scratch: Scratch) -> list[DataFrame]:
    """``key, start, stop`` of what the sort finds in the different runs of all grams that have several."""
    # one row of the table for each text that is needed, found by id so that copies of a text do not meet in one task
    no_id = F.lit(-(1 << 63))
    named = docs.select("key", F.coalesce("doc_id", no_id).alias("id"), "raw")
    wanted = scratch.save(
        named.select("key", "id").join(contents.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")), "wanted"
    )
    texts = scratch.save(named.join(wanted, ["key", "id"]).dropDuplicates(["key", "id"]).select("key", "raw"), "texts")

    def with_bytes(runs: DataFrame) -> DataFrame:
        return runs.join(texts, "key").withColumn("bytes", F.expr(f"substring(raw, first + 1, count - 1 + {length})")).drop("raw")

    def run(table: pa.Table) -> pa.Table:
        return sorted_bucket(table, length)

    found, calm = [], []
    for gram in gram_lengths(length)[1:]:
        many = scratch.save(contents.groupBy("gram").count().where(F.col("count") > BUCKET).select("gram"), "many")
        if many.isEmpty():
            break
        calm.append(contents.join(many, "gram", "left_anti"))
        again, contents = grouped(scratch.save(finer(with_bytes(contents.join(many, "gram")), gram, length), "finer"), length, scratch)
        found.append(again)
    ready = reduce(DataFrame.unionByName, [*calm, contents])  # a whole window as its gram: a few runs of one byte at most
    buckets = max(1, -(-ready.count() // BUCKET))
    dealt = with_bytes(ready).select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket"), "gram", "key", "first", "single", "bytes")
    found.append(scratch.save(dealt.groupBy("bucket").applyInArrow(run, "key binary, start long, stop long"), "sorted"))
    return found


def dedup_substrings(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None, full: bool = True
) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and, if ``full``, ``spans, kept`` of each text.

    Each byte of a UTF-8 text goes that a string of ``length`` bytes (16 or more) covers which also starts anywhere else, in the same
    text or another; matches never cross texts, overlapping matches count, and what is left is not looked at again.
    ``spans`` are the maximal removed runs as ``start, stop`` of bytes, ``kept`` the other bytes.

    Null counts as empty; texts shorter than ``length`` stay whole. Rows repeated in full are two documents and lose all
    that is ``length`` bytes long. Ids that are null or repeated do not matter. ``keep`` names the columns to return, all by
    default; those named like a computed one are replaced. An empty table gives no rows.
    """
    if length < 16:
        raise ValueError("length must be at least 16 bytes")
    scratch = Scratch(docs.sparkSession)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["spans", "kept"] if full else [])
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    raw = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    inside = docs.select(raw.alias("raw"), text_key(F.col(text_column)).alias("key"), *[F.col(c).alias(f"_in{i}") for i, c in enumerate(kept)])
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(F.col(text_column)).alias("key"), raw.alias("raw"))
    spans = repeated_spans(narrow, length, scratch)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = {m: [] for m in made}
            for text, marks in zip(batch.column("raw"), batch.column("spans")):
                text, gone = np.frombuffer(text.as_buffer(), np.uint8), np.zeros(0, bool)
                gone = np.zeros(len(text) + 1, np.int32)
                if marks.is_valid:
                    np.add.at(gone, marks.values.field("start").to_numpy(), 1)
                    np.add.at(gone, marks.values.field("stop").to_numpy(), -1)
                gone = np.cumsum(gone)[:-1] > 0
                left, parts = text[~gone].tobytes(), stretches(gone)
                row = [len(text), int(gone.sum()), len(parts), hashlib.sha256(left).hexdigest()] + ([[{"start": a, "stop": b} for a, b in parts], left] if full else [])
                for name, value in zip(made, row):
                    out[name].append(value)
            kinds = {"kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c.startswith("_in")] + [pa.array(out[m], kinds.get(m, pa.int64())) for m in made],
                names=[c for c in batch.schema.names if c.startswith("_in")] + made,
            )

    types = {"kept_sha256": "string", "spans": "array<struct<start:long,stop:long>>", "kept": "binary"}
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in inside.schema.fields[2:]] + [f"{m} {types.get(m, 'long')}" for m in made])
    joined = inside.join(spans, "key", "left").select("raw", "spans", *[f"_in{i}" for i in range(len(kept))])
    return joined.mapInArrow(cut, schema).select([F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)] + made)


def op4_substring_dedup(spark, folder) -> DataFrame:
    return dedup_substrings(read(spark, folder, "documents"), keep=["doc_id"], full=False)
