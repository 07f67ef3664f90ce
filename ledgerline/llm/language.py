"""Language identification by a linear-chain conditional random field over words.

Each word has features: its affixes, its letter n-grams, and how often each language's lexicon has it. Their weights
and the transitions between languages are learned together; the forward-backward algorithm gives each word of
a sentence its probability of each language, so text that switches languages is labelled word by word. A document's language is the
one with the largest share of its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, batches_of, read
from ledgerline.llm.sampling import drawn, fold, labelled_sample

COLUMNS = 128                      # languages that one model tells apart
PER_LANGUAGE, SAMPLE = 300, 19_200  # documents that the model is fitted on: of a language at most, and of all together
FIT_SENTENCES = 24                 # sentences of a document in one pass of the fit, others in each
LEXICON = 2000                     # most frequent words of each language in the sample
GRAMS = (2, 3, 4)                  # lengths of the n-grams; a word has a mark before it and two behind
BUCKET_BITS = 17                   # hashed affix and n-gram features
BUCKETS = 1 << BUCKET_BITS
_MIX = np.uint64(0x9E3779B97F4A7C15)
CHAIN = 256                        # words of a chain; a longer sentence is several chains
UNKNOWN = "und"
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")


class Features:
    """Letter n-grams of distinct words, those at a word's ends being its affixes, and the words' lexicon rows."""

    def __init__(self, lexicon: dict[str, np.ndarray], languages: int):
        self.place = {w: i + 1 for i, w in enumerate(lexicon)}
        self.rates = np.array([np.zeros(languages + 1), *lexicon.values()], np.float32)

    def rows(self, words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """For each gram length the hashed features in one run and where each word's start; features of each word; lexicon rows."""
        marked = "".join([f"<{w}>>" for w in words])
        letters = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
        first = np.cumsum(sizes) - sizes
        left = np.repeat(first + sizes, sizes) - np.arange(len(letters))  # letters from here to the word's end
        grams, rolled = [], letters * _MIX
        for n in GRAMS:
            while len(letters) - len(rolled) < n - 1:
                rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * _MIX + letters[len(letters) - len(rolled) + 1 :]
            whole = rolled[left[: len(rolled)] >= n] * _MIX
            starts = np.cumsum(sizes - n + 1) - (sizes - n + 1)
            grams.append(((whole >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), starts))
        counts = sum(sizes - n + 1 for n in GRAMS)
        return grams, counts, self.rates[np.fromiter((self.place.get(w, 0) for w in words), np.int64, len(words))]


def sentences(text: str | None) -> tuple[list[str], np.ndarray]:
    """Words in lower case and the lengths of the chains they form."""
    words, lengths, run = [], [], 0
    for token in TOKEN.findall((text or "").lower()):
        if token in ".!?\n":
            if run:
                lengths.append(run)
            run = 0
        else:
            words.append(token)
            run += 1
            if run == CHAIN:
                lengths.append(run)
                run = 0
    if run:
        lengths.append(run)
    return words, np.array(lengths, np.int64)


def forward_backward(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """Probabilities of each label of each word, chains laid end to end, with expected moves and the log likelihoods' sum.

    ``emission`` holds scores (logs), ``start`` and ``moves`` too. All chains of about one length advance together.
    """
    k = emission.shape[1]
    shift = emission.max(axis=1, initial=-np.inf, keepdims=True)
    local, step, first = np.exp(emission - shift), np.exp(moves), np.exp(start)
    marginal, expected, starts, total = np.empty_like(local), np.zeros((k, k)), np.zeros(k), float(shift.sum())
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), 4096):
        chosen = order[at : at + 4096]
        begin, size = begins[chosen], lengths[chosen]
        longest = int(size[0])
        live = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than t
        forward, scale, local_t = [], [], []
        for t in range(longest):
            n = live[t]
            here = local[begin[:n] + t]
            a = (first if t == 0 else forward[-1][:n] @ step) * here
            s = a.sum(axis=1, keepdims=True)
            forward.append(a / s)
            scale.append(s)
            local_t.append(here)
            total += float(np.log(s).sum())
        back = np.ones((live[-1], k)) if longest else None
        for t in range(longest - 1, -1, -1):
            n = live[t]
            if len(back) < n:
                back = np.concatenate([back, np.ones((n - len(back), k))])
            p = forward[t] * back
            marginal[begin[:n] + t] = p / p.sum(axis=1, keepdims=True)
            if t:
                coming = local_t[t] * back / scale[t]
                expected += step * (forward[t - 1][:n].T @ coming)
                back = coming @ step.T
            else:
                starts += marginal[begin].sum(axis=0)
    return marginal, expected, starts, total


class LanguageModel:
    """Weights of the field, and labelling by them.

    ``rest`` stands for all languages that are not the model's own, and ``following`` fits the model that tells the next of them apart.
    """

    rest: str | None = None
    following: Callable[[], LanguageModel] | None = None

    def __init__(self, languages: list[str], lexicon: dict[str, np.ndarray]):
        k = len(languages)
        self.languages, self.lexicon, self.features = languages, lexicon, Features(lexicon, k)
        self.weights = {
            "hashed": np.zeros((BUCKETS, k), np.float32),
            "lexicon": np.zeros((k + 1, k), np.float32),
            "start": np.zeros(k, np.float32),
            "moves": (np.eye(k) * 2).astype(np.float32),
        }

    def emission(self, grams, counts, lexicon) -> np.ndarray:
        """Scores of distinct words; the features of a word weigh one over the root of their number."""
        if not len(counts):
            return np.zeros((0, len(self.languages)))
        hashed = 0
        for flat, starts in grams:  # a stretch of words at a time
            edges = np.append(starts, len(flat))
            hashed = hashed + np.concatenate([
                np.add.reduceat(self.weights["hashed"][flat[edges[i] : edges[min(i + 20_000, len(starts))]]], starts[i : i + 20_000] - starts[i])
                for i in range(0, len(starts), 20_000)
            ])
        return hashed / np.sqrt(counts)[:, None] + lexicon @ self.weights["lexicon"]

    def fit(self, names: list[str], documents: list[tuple[np.ndarray, np.ndarray, int]], rng: np.random.Generator, rounds: int = 40) -> None:
        """Raises the likelihood of the chains of ``(words by their places in names, lengths, label)`` by Adam, with a small penalty on weights.
        Each round has other sentences of the long documents, and other chains that run from one document into another."""
        codes = np.concatenate([words for words, _, _ in documents])
        sizes = np.concatenate([n for _, n, _ in documents])
        begins = np.cumsum(sizes) - sizes
        label = np.repeat([y for _, _, y in documents], [len(n) for _, n, _ in documents])
        first_chain = np.cumsum([0] + [len(n) for _, n, _ in documents])
        grams, counts, lexicon = self.features.rows(names)
        owners = [np.repeat(np.arange(len(names), dtype=np.int32), np.diff(np.append(at, len(f)))) for f, at in grams]
        root = np.sqrt(counts)[:, None]
        k = len(self.languages)
        steps = {key: [np.zeros_like(w), np.zeros_like(w)] for key, w in self.weights.items()}
        for turn in range(1, rounds + 1):
            chosen = np.concatenate([at + drawn(n, FIT_SENTENCES, rng) for at, n in zip(first_chain, np.diff(first_chain))])
            chosen = rng.permutation(chosen)
            third = len(chosen) // 3
            chosen = np.concatenate([chosen[: 2 * third].reshape(2, third).T.ravel(), chosen[2 * third :]])  # a third runs into another
            size = sizes[chosen]
            lengths = np.concatenate([size[: 2 * third].reshape(third, 2).sum(axis=1), size[2 * third :]])
            n = int(size.sum())
            word = codes[np.arange(n) + np.repeat(begins[chosen] - (np.cumsum(size) - size), size)]
            gold = np.repeat(label[chosen], size)
            first = np.cumsum(lengths) - lengths
            inner = np.ones(n, bool)
            inner[first] = False
            seen_moves = np.bincount((gold[:-1] * k + gold[1:])[inner[1:]], minlength=k * k).reshape(k, k)
            seen_starts = np.bincount(gold[first], minlength=k)
            scores = self.emission(grams, counts, lexicon)[word].astype(float)
            p, expected, begun, _ = forward_backward(scores, lengths, self.weights["start"].astype(float), self.weights["moves"].astype(float))
            p[np.arange(n), gold] -= 1
            miss = np.stack([np.bincount(word, p[:, j], len(names)) for j in range(k)], axis=1) / n
            share = miss / root  # spread over the n-grams a language and a length at a time: they are many
            grads = {
                "hashed": np.stack([sum(np.bincount(f, share[own, j], BUCKETS) for (f, _), own in zip(grams, owners)) for j in range(k)], axis=1),
                "lexicon": lexicon.T @ miss,
                "start": (begun - seen_starts) / n,
                "moves": (expected - seen_moves) / n,
            }
            for key, g in grads.items():
                g = g + 1e-6 * self.weights[key]
                one, two = steps[key]
                one += 0.1 * (g - one)
                two += 0.05 * (g * g - two)
                rate = 0.1 if key in ("hashed", "lexicon") else 0.05
                self.weights[key] -= (rate * (one / (1 - 0.9**turn)) / (np.sqrt(two / (1 - 0.95**turn)) + 1e-8)).astype(np.float32)


class Labeller:
    """Labels texts with a bounded memory of the scores of words seen so far."""

    def __init__(self, model: LanguageModel):
        self.model, self.known = model, {}
        self.scores = np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        if len(self.known) > 200_000:
            self.known, self.scores = {}, self.scores[:0]
        new = sorted(w for w in words if w not in self.known)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.scores = np.concatenate([self.scores, *(self.model.emission(*self.model.features.rows(new[i : i + 5000])) for i in range(0, len(new), 5000))])

    def words(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, words per text, and each word's probability of each language."""
        parts = [sentences(t) for t in texts]
        self.learn({w for words, _ in parts for w in words})
        codes = np.array([self.known[w] for words, _ in parts for w in words], np.int64)
        lengths = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
        w = self.model.weights
        p = forward_backward(self.scores[codes], lengths, w["start"].astype(float), w["moves"].astype(float))[0]
        return [words for words, _ in parts], np.array([len(words) for words, _ in parts]), p

    def documents(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """Language, its share of the words of each text, and the mean over its words of the likeliest language's probability."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0, None if sentences(t)[0] else 0.0) for t in texts]
        _, counts, p = self.words(texts)
        sums = np.concatenate([[np.zeros(p.shape[1])], np.cumsum(p, axis=0)])
        best = np.append(0.0, np.cumsum(p.max(axis=1)))
        ends = np.cumsum(counts)
        out = []
        for n, end in zip(counts, ends):
            if not n:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            share = (sums[end] - sums[end - n]) / n
            top = int(share.argmax())
            out.append((self.model.languages[top], float(min(1.0, max(0.0, share[top]))), float(min(1.0, max(share[top], (best[end] - best[end - n]) / n)))))
        return out


def fitted(sample: Iterable[tuple[str, str]], seed: int = 5) -> LanguageModel:
    """A model fitted to ``(text, language)``. In each round half of the chains run from a sentence of one document into
    one of another, so that switches are seen; the others are sentences as they are.

    Texts may come one by one: what stays of each is its words' places in one list of words, four bytes each.
    """
    place: dict[str, int] = {}
    coded: list[tuple[np.ndarray, np.ndarray, str]] = []
    for text, lang in sample:
        words, lengths = sentences(text)
        coded.append((np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words)), lengths, lang))
    languages, names = sorted({lang for _, _, lang in coded}), list(place)
    del place
    number = {lang: i for i, lang in enumerate(languages)}
    documents = [(words, lengths, number[lang]) for words, lengths, lang in coded]
    counts = np.zeros((len(languages), len(names)), np.int64)
    for words, _, y in documents:
        np.add.at(counts[y], words, 1)
    sums = counts.sum(axis=1) + 1
    common: set[int] = set()
    for own in counts:
        seen = np.nonzero(own)[0]
        if len(seen) > LEXICON:  # the words of the last count that has room are taken by name
            least = np.partition(own[seen], len(seen) - LEXICON)[len(seen) - LEXICON]
            seen = np.array(sorted(seen[own[seen] >= least], key=lambda i: (-own[i], names[i]))[:LEXICON], np.int64)
        common.update(seen.tolist())
    lexicon = {}
    for i in sorted(common, key=names.__getitem__):
        rate = np.log((counts[:, i] + 0.5) / sums)
        lexicon[names[i]] = np.append(rate - rate.mean(), 1.0).astype(np.float32) / 4
    model = LanguageModel(languages, lexicon)
    if len(languages) > 1 and names:
        model.fit(names, documents, np.random.default_rng(seed))
    return model


def fit_languages(docs: DataFrame, folds: int = 5, held: int = 0, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model fitted to documents with a language outside the held-out fold, at most ``per_language`` of each language.

    Every language that has a labelled document there is learned. Of more than ``COLUMNS`` the most frequent have a column each and the
    others one together, and the next model tells those apart in the same way; a model's weights and its sample of at most ``SAMPLE`` documents
    (or one a column) are so bounded, however many languages there are, and models are fitted when they are needed, one after another."""
    learned = docs.where((fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return _fitted_level(learned, learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), per_language)


def _fitted_level(learned: DataFrame, counts: DataFrame, per_language: int) -> LanguageModel:
    first = [r["lang"] for r in counts.orderBy(F.desc("n"), "lang").limit(COLUMNS + 1).collect()]
    texts = learned.select("doc_id", "text")
    if len(first) <= COLUMNS:
        return fitted(labelled_sample(texts, learned.select("doc_id", "lang"), "lang", per_language, SAMPLE))
    own = F.col("lang").isin(first[: COLUMNS - 1])
    rest = max(first[: COLUMNS - 1]) + "\0"  # after all of them, so none of them
    known = learned.select("doc_id", F.when(own, F.col("lang")).otherwise(rest).alias("lang"))
    model = fitted(labelled_sample(texts, known, "lang", per_language, SAMPLE))
    model.rest = rest
    model.following = lambda: _fitted_level(learned.where(~own), counts.where(~own), per_language)
    return model


def identified(docs: DataFrame, model: LanguageModel, text_column: str = "text", keep: list[str] | None = None, sure: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of its words that the language has.

    Every word of every text is labelled. A text that is null or has no letter is ``und`` with score 0, and so is every text
    if the model was fitted to nothing; ties go to the first language by name. ``keep`` names the columns to return, all by
    default; those named like a computed one are replaced. Repeated rows get one answer; an empty table gives no rows. ``sure`` adds
    a column of that name: how probable the likeliest language of each word is, on average; null where no language was learned
    and the text has a letter.

    What a model gives to its ``rest`` is labelled again, by the model that follows; the scores are those of the model that names the language.
    """
    made = ["lang_pred", "score"] + ["sure"] * sure
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    inside = docs.select(F.col(text_column).alias("_text"), *[F.col(c).alias(f"_in{i}") for i, c in enumerate(kept)])
    out = [F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)] + made
    if model.rest is None:
        return _labelled(inside, model, made).select(out)
    scratch, columns, done = Scratch(docs.sparkSession), inside.columns, []
    while model.rest is not None:
        found = scratch.save(_labelled(inside, model, made), "labelled")
        done.append(found.where(F.col("lang_pred") != model.rest).select(out))
        inside = found.where(F.col("lang_pred") == model.rest).select(columns)
        model = model.following()
    return reduce(DataFrame.unionByName, done + [_labelled(inside, model, made).select(out)])


def _labelled(inside: DataFrame, model: LanguageModel, made: list[str]) -> DataFrame:
    """``inside``, whose first column is the text, with the columns ``made``; a model that hands texts on leaves the text in."""
    # buckets and lexicon have a fixed size for each of at most COLUMNS languages
    parts = inside.sparkSession.sparkContext.broadcast((model.languages, model.lexicon, model.weights))
    first = 0 if model.rest is not None else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, lexicon, weights = parts.value
        same = LanguageModel(languages, lexicon)
        same.weights = weights
        labeller = Labeller(same)
        for batch in batches:
            start = 0
            for texts in batches_of(t.as_py() for t in batch.column(0)):
                found = labeller.documents(texts)
                part = batch.slice(start, len(texts))
                start += len(texts)
                yield pa.RecordBatch.from_arrays(
                    part.columns[first:] + [pa.array([x[i] for x in found], pa.float64() if i else pa.string()) for i in range(len(made))],
                    names=batch.schema.names[first:] + made,
                )

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in inside.schema.fields[first:]]
    return inside.mapInArrow(run, ", ".join(fields + ["lang_pred string", "score double", "sure double"][: len(made)]))


def op10_language_id(spark, folder) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = identified(docs, fit_languages(docs), keep=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
