"""A quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover every byte. Each byte has a learned embedding, learned filters run
over the chunk, and each filter's largest response in the chunk is its feature. The features of all chunks are combined by their mean,
largest and smallest values, which one hidden layer turns into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import read
from ledgerline.llm.sampling import drawn, fold, labelled_sample

CHUNK, STEP = 512, 448           # bytes of a chunk, and from one chunk's start to the next
EMBED, WIDTH, STRIDE = 8, 8, 4   # size of an embedding, bytes under a filter, bytes between its places
FILTERS, HIDDEN = 64, 16
PER_LABEL = 1500                 # documents of each label that the network is fitted on, at most
FIT_CHUNKS = 8                   # chunks of a document in one pass of the fit, others in each
UPDATES, BATCH = 900, 16          # steps of the fit, and documents in each
PAD = 256
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(text: str | None) -> np.ndarray:
    """All chunks of a text, one row each; an empty text is one chunk of padding."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-max(0, len(raw) - (CHUNK - STEP)) // STEP))
    padded = np.full((n - 1) * STEP + CHUNK, PAD, np.int16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def new_network(rng: np.random.Generator) -> dict[str, np.ndarray]:
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "embed": normal(PAD + 1, EMBED, scale=0.5),
        "filters": normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(3 * FILTERS, HIDDEN, scale=(3 * FILTERS) ** -0.5),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, scale=HIDDEN**-0.5),
        "out_bias": np.zeros(1, np.float32),
    }


def responses(net: dict, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the filters and their responses at each place, ``chunks x PLACES x ...``."""
    embedded = net["embed"][chunks].reshape(len(chunks), CHUNK * EMBED)
    windows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
    inputs = windows.reshape(len(chunks) * PLACES, WIDTH * EMBED)
    out = (inputs @ net["filters"]).reshape(len(chunks), PLACES, FILTERS)
    return inputs, out


def pooled(net: dict, chunks: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each chunk, cut off at 0; a few chunks at a time."""
    parts = [responses(net, chunks[i : i + 64])[1].max(axis=1) for i in range(0, len(chunks), 64)]
    return np.maximum(np.concatenate(parts) + net["filter_bias"], 0)


def combined(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean, largest and smallest of the chunk features of each document."""
    counts = np.diff(np.append(starts, len(features)))[:, None]
    return np.concatenate(
        [np.add.reduceat(features, starts) / counts, np.maximum.reduceat(features, starts), np.minimum.reduceat(features, starts)], axis=1
    ).astype(np.float32)


def logits(net: dict, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(documents @ net["hidden"] + net["hidden_bias"])
    return hidden, hidden @ net["out"] + net["out_bias"][0]


def probabilities(net: dict, texts: list[str | None]) -> np.ndarray:
    """Of each whole text."""
    if not texts:
        return np.empty(0)
    out, held, starts, size = [], [], [], 0
    for i, text in enumerate(texts):
        part = pooled(net, chunks_of(text)) if len(text or "") > 1 << 16 else chunks_of(text)
        held.append(part)
        starts.append(size)
        size += len(part)
        if size > 2000 or i == len(texts) - 1:
            raw = [j for j, p in enumerate(held) if p.shape[1] == CHUNK]
            if raw:
                together = pooled(net, np.concatenate([held[j] for j in raw]))
                at = 0
                for j in raw:
                    held[j], at = together[at : at + len(held[j])], at + len(held[j])
            z = logits(net, combined(np.concatenate(held), np.array(starts)))[1].astype(float)
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            held, starts, size = [], [], 0
    return np.concatenate(out)


def fitted(sample: list[tuple[str, int]], updates: int = UPDATES, seed: int = 11) -> dict[str, np.ndarray]:
    """A network fitted to ``(text, 0 or 1)`` by Adam on the log loss. Without both labels it keeps to the one there is
    (one half without any)."""
    rng = np.random.default_rng(seed)
    net = new_network(rng)
    labels = np.array([y for _, y in sample], np.float32)
    if not len(labels) or labels.min() == labels.max():
        net["out"][:] = 0
        net["out_bias"][:] = 0 if not len(labels) else (3 if labels[0] else -3)
        return net
    chunks = [chunks_of(text) for text, _ in sample]
    steps = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}
    queue: list[int] = []
    for turn in range(1, updates + 1):
        if len(queue) < BATCH:
            queue.extend(rng.permutation(len(sample)).tolist())
        part, queue = queue[:BATCH], queue[BATCH:]
        picked = [chunks[i][drawn(len(chunks[i]), FIT_CHUNKS, rng)] for i in part]
        rate = 3e-3 * (1 - 0.9 * turn / updates)
        for k, g in gradients(net, picked, labels[part]).items():
            first, second = steps[k]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            net[k] -= (rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return net


def gradients(net: dict, picked: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    chunks = np.concatenate(picked)
    counts = np.array([len(p) for p in picked])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    inputs, out = responses(net, chunks)
    place = out.argmax(axis=1)
    features = np.maximum(np.take_along_axis(out, place[:, None], 1)[:, 0] + net["filter_bias"], 0)
    documents = combined(features, starts)
    hidden, z = logits(net, documents)
    dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
    g = {"out": hidden.T @ dz, "out_bias": np.array([dz.sum()])}
    dh = np.outer(dz, net["out"]) * (1 - hidden**2)
    g["hidden"], g["hidden_bias"] = documents.T @ dh, dh.sum(axis=0)
    dd = dh @ net["hidden"].T
    owner = np.repeat(np.arange(len(counts)), counts)
    mean, most, least = (dd[:, i * FILTERS : (i + 1) * FILTERS] for i in range(3))
    df = mean[owner] / counts[owner][:, None]
    for pick, extreme in ((most, np.maximum), (least, np.minimum)):
        at = features == extreme.reduceat(features, starts)[owner]
        ties = np.add.reduceat(at.astype(np.float32), starts)
        df = df + at * (pick / ties)[owner]
    df = df * (features > 0)
    g["filter_bias"] = df.sum(axis=0)
    rows = (np.arange(len(chunks))[:, None] * PLACES + place).ravel()  # only the largest response of a chunk passes back
    column = np.tile(np.arange(FILTERS), len(chunks))
    weight = df.ravel()
    order = np.argsort(column, kind="stable")
    seen = (inputs[rows] * weight[:, None])[order]
    g["filters"] = np.add.reduceat(seen, np.arange(FILTERS) * len(chunks)).T
    back = net["filters"].T[column] * weight[:, None]
    first = (place * STRIDE).ravel()
    under = chunks[np.repeat(np.arange(len(chunks)), FILTERS)[:, None], first[:, None] + np.arange(WIDTH)]
    g["embed"] = np.zeros_like(net["embed"])
    flat = back.reshape(-1, EMBED)
    for e in range(EMBED):
        g["embed"][:, e] = np.bincount(under.ravel(), flat[:, e], PAD + 1)
    return g


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, per_label: int = PER_LABEL) -> dict[str, np.ndarray]:
    """A network fitted to the labelled documents outside the held-out fold, at most ``per_label`` of each label."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(fold(F.col("doc_id"), folds) != held)
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1)).join(texts.select("doc_id"), "doc_id", "left_semi")
    return fitted(list(labelled_sample(texts, known, "quality", per_label, 2 * per_label)))


def scored(docs: DataFrame, net: dict[str, np.ndarray], text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1, and ``predicted``.

    Every whole text is scored; null counts as empty, and an empty text has a score like any other. ``keep`` names the columns to
    return, all by default; those named like a computed one are replaced. Repeated rows score alike; an empty table gives no rows.
    """
    made = ["score", "predicted"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    inside = docs.select(F.col(text_column).alias("_text"), *[F.col(c).alias(f"_in{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                p = probabilities(net, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    part.columns[1:] + [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=batch.schema.names[1:] + made
                )

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in inside.schema.fields[1:]] + ["score double", "predicted int"])
    return inside.mapInArrow(run, schema).select([F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)] + made)


def op5_quality_classifier(spark, folder) -> DataFrame:
    docs = read(spark, folder, "documents")
    net = fit_quality(docs, read(spark, folder, "labels"))
    return scored(docs, net, keep=["doc_id"]).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
