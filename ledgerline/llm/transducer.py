"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic machines in a row. ``Splitter`` reads classes of characters and marks where the words of the vocabulary's
pattern begin. Texts are cut into chunks whatever they hold; the map of a chunk tells for each state the state that
the chunk leaves it in, the maps compose by a parallel prefix scan, and each chunk is then read once more from the state
it is really entered in. ``Counter`` reads the bytes of a word. Its transitions carry the change in the number of tokens, and are
compiled when first taken: a state is what later bytes can depend on, the suffixes that begin some token, with the
last token before each and how many tokens that took.

A sequence of tokens is what BPE gives exactly if each token is given for its own bytes and no merge across the border of two
neighbours would have come before the merges that made them; so the last token of each prefix is found from those of
shorter ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.bpe import default_vocabulary
from ledgerline.llm.common import batches_of, read

CHUNK = 256           # characters of a chunk
STATES = 200_000      # compiled states a task keeps; past that it compiles anew
WORDS = 400_000       # words whose count a task keeps
LONGEST = 64          # longest word kept, in characters
NEVER = 1 << 60

# classes of characters; the letters named are those of the pattern's contractions
LETTER, FINAL, R, V, L, E, NUMBER, SPACE, BLANK, SYMBOL, APOSTROPHE, END = range(12)
LETTERS = (LETTER, FINAL, R, V, L, E)
# states of the splitter: nothing open; an open run; one blank, or more, of which the last is a space or not; an
# apostrophe at a word's start, alone or with the first letter of a contraction
NOTHING, IN_LETTERS, IN_NUMBERS, IN_SYMBOLS, ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
HERE, BEFORE = 1, 2   # a word begins at this character, at the one before


def _opened(c: int) -> int:
    """The state after a character that begins a word."""
    if c in LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, SYMBOL: IN_SYMBOLS, APOSTROPHE: QUOTE, END: NOTHING}[c]


def _transition(state: int, c: int) -> tuple[int, int]:
    """State after a character of class ``c``, and the words that begin."""
    anew = (_opened(c), HERE)
    if c == END:
        return NOTHING, HERE | (BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0)
    if state == NOTHING:
        return anew
    if state == IN_LETTERS:
        return (IN_LETTERS, 0) if c in LETTERS else anew
    if state == IN_NUMBERS:
        return (IN_NUMBERS, 0) if c == NUMBER else anew
    if state == IN_SYMBOLS:
        return (IN_SYMBOLS, 0) if c in (SYMBOL, APOSTROPHE) else anew
    if state in (ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK):
        if c in (SPACE, BLANK):
            return (MORE_SPACE if c == SPACE else MORE_BLANK), 0
        if state in (ONE_BLANK, MORE_BLANK):  # the last blank is a word of its own
            return anew[0], HERE | (BEFORE if state == MORE_BLANK else 0)
        joined = IN_SYMBOLS if c == APOSTROPHE else anew[0]  # a last space belongs to the word after it
        return joined, BEFORE if state == MORE_SPACE else 0
    if state == QUOTE:
        if c == FINAL:
            return NOTHING, 0
        if c in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
        return (IN_SYMBOLS, 0) if c in (SYMBOL, APOSTROPHE) else anew
    if c == {QUOTE_R: E, QUOTE_V: E, QUOTE_L: L}[state]:
        return NOTHING, 0
    after, begun = _transition(IN_LETTERS, c)  # no contraction: the letter began a word
    return after, begun | BEFORE


class Splitter:
    """Marks where the words of a text begin, a batch of texts at a time."""

    def __init__(self):
        import regex

        every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        self.classes = np.full(0x110000, SYMBOL, np.uint8)
        for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
            found = np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)
            self.classes[found] = c
        for shown, c in (("stmd", FINAL), ("r", R), ("v", V), ("l", L), ("e", E), (" ", SPACE), ("'", APOSTROPHE)):
            for character in shown:
                self.classes[ord(character)] = c
        table = [[_transition(state, c) for c in range(12)] for state in range(12)]
        self.next = np.array([[after for after, _ in row] for row in table], np.uint8)
        self.begun = np.array([[begun for _, begun in row] for row in table], np.uint8)

    def entered(self, chunks: np.ndarray) -> np.ndarray:
        """The state that each chunk (a row of classes) is entered in, the first with nothing open."""
        maps = np.tile(np.arange(12, dtype=np.uint8), (len(chunks), 1))
        apart = np.arange(len(chunks))  # chunks whose map still tells states apart
        for t in range(chunks.shape[1]):
            if not len(apart):
                break
            maps[apart] = self.next[maps[apart], chunks[apart, t][:, None]]
            if t % 4 == 3:
                met = maps[apart, 1:].max(1) == maps[apart].min(1)
                self._along(maps, chunks, apart[met], t + 1)
                apart = apart[~met]
        # inclusive scan: after the round of a shift, a map covers the 2 x shift chunks up to its own
        shift = 1
        while shift < len(maps):
            maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift], axis=1)
            shift *= 2
        return np.concatenate([[NOTHING], maps[:-1, NOTHING]]).astype(np.uint8)

    def _along(self, maps: np.ndarray, chunks: np.ndarray, rows: np.ndarray, start: int) -> None:
        """Runs chunks on whose map has only one state left."""
        state = maps[rows, 0]
        for t in range(start, chunks.shape[1]):
            state = self.next[state, chunks[rows, t]]
        maps[rows] = state[:, None]

    def starts(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All texts in a row, each with an end mark behind it; where words and end marks begin; where the end marks are."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        height = -(-len(points) // CHUNK)
        classes = np.full(height * CHUNK, END, np.uint8)
        classes[: len(points)] = self.classes[points]
        classes[ends] = END
        chunks = classes.reshape(height, CHUNK)
        state = self.entered(chunks)
        begun = np.empty((height, CHUNK), np.uint8)
        for t in range(CHUNK):
            begun[:, t] = self.begun[state, chunks[:, t]]
            state = self.next[state, chunks[:, t]]
        begun = begun.reshape(-1)
        marks = (begun & HERE) != 0
        marks[:-1] |= (begun[1:] & BEFORE) != 0
        return joined, np.nonzero(marks[: len(points)])[0], ends


class Counter:
    """Number of tokens of a word, by a transducer over its bytes."""

    def __init__(self, description: str):
        file = json.loads(description)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        back = {chr(b): b for b in shown}
        back.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
        raw = lambda token: bytes(back[c] for c in token)
        self.id_of = {raw(token): i for token, i in file["model"]["vocab"].items()}
        self.pairs, self.made = {}, {}
        for rank, merge in enumerate(file["model"]["merges"]):
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            a, b, whole = self.id_of[left], self.id_of[right], self.id_of[left + right]
            if whole in self.made or any(len(part) > 1 and self.id_of[part] not in self.made for part in (left, right)):
                raise ValueError("each token must have one merge, after those of its parts")
            self.pairs[a, b], self.made[whole] = rank, (rank, a, b)
        # tokens that BPE gives for their own bytes; a merge comes after those of its parts, so they are known by then
        self.whole = {i for i in self.id_of.values() if i not in self.made}
        for i, (rank, a, b) in self.made.items():
            if a in self.whole and b in self.whole and self._stay(a, b, rank):
                self.whole.add(i)
        self.token = {t: i for t, i in self.id_of.items() if i in self.whole}
        self.begins = {t[:n] for t in self.token for n in range(1, len(t) + 1)}
        self.stay = lru_cache(1 << 18)(self._stay)
        self.clear()

    def clear(self) -> None:
        """Forgets the compiled part."""
        start = (b"", ((0, None, 0),))
        self.states, self.number, self.steps = [start], {start: 0}, {}

    def _spine(self, token: int, side: int, until: int) -> list[tuple[int, int]]:
        """The tokens that stood at one end of a token while it was merged, each with the rank of the merge that took it."""
        found = [(token, until)]
        while token in self.made:
            rank, *parts = self.made[token]
            token = parts[side]
            found.append((token, rank))
        return found

    def _stay(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether no merge joins an end of ``left`` to a start of ``right`` before rank ``until``.

        A merge across the border happens if both sides stand when its turn comes. Of equal ranks the one further left is first: one inside
        ``left`` takes its last part away, one inside ``right`` comes too late.
        """
        starts = self._spine(right, 0, until)
        for a, until_a in self._spine(left, 1, until):
            for b, until_b in starts:
                rank = self.pairs.get((a, b), NEVER)
                if rank < until_a and (rank < until_b or rank == until_b < until):
                    return False
        return True

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state at a byte: the next state and the change in the number of tokens."""
        suffix, open_at = self.states[state]
        suffix += bytes((byte,))
        for length, before, more in open_at:
            token = self.token.get(suffix[len(suffix) - 1 - length :])
            if token is not None and (before is None or self.stay(before, token)):
                break
        change = more + 1
        kept = tuple(
            (length + 1, before, n - change) for length, before, n in open_at if suffix[len(suffix) - 1 - length :] in self.begins
        )
        after = (suffix[len(suffix) - kept[0][0] :], (*kept, (0, token, 0)))
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        self.steps[state << 8 | byte] = found = (self.number[after], change)
        return found

    def count(self, word: bytes) -> int:
        if len(self.states) > STATES:
            self.clear()
        state = total = 0
        steps = self.steps
        for byte in word:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = self._compile(state, byte)
            state = step[0]
            total += step[1]
        return total


class Tokens:
    """Counts the tokens of texts as the library does. Strings of added tokens are found first and are one token each."""

    def __init__(self, description: str):
        import regex

        self.splitter, self.counter, self.known = Splitter(), Counter(description), {}
        self.added = [t["content"] for t in json.loads(description)["added_tokens"]]
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _learn(self, words: set[str]) -> list[str]:
        """Counts words that are not known yet; gives the long ones, which hardly come again and are not to be kept."""
        if len(self.known) > WORDS:
            self.known = {}
        new = words.difference(self.known)
        for word in new:
            self.known[word] = self.counter.count(word.encode())
        return [word for word in new if len(word) > LONGEST]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts, owner, found = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.apart and any(a in text for a in self.added):
                found[i] = len(self.apart.findall(text))
                pieces = self.apart.split(text)
                parts += pieces
                owner += [i] * len(pieces)
            else:
                parts.append(text)
                owner.append(i)
        joined, starts, ends = self.splitter.starts(parts)
        bounds = starts.tolist()
        words = [joined[a:b] for a, b in zip(bounds, bounds[1:] + [len(joined)])]
        last = np.searchsorted(starts, ends)  # the end mark of each part stands among the words
        for i in last.tolist():
            words[i] = ""
        once = self._learn(set(words))
        tokens = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for word in once:
            del self.known[word]
        summed = np.concatenate([[0], np.cumsum(tokens)[last]])
        np.add.at(found, owner, np.diff(summed))
        return found


def count_tokens(
    docs: DataFrame, vocabulary_file: str, text_column: str = "text", limit: int = 512, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``n_bytes, n_tokens, over_limit`` of each whole text.

    A null text counts as empty: no bytes, no tokens. ``keep`` names the columns of ``docs`` to return, all by default; those named like a
    computed one are replaced. Every row gives one row, repeated rows and empty tables included.
    ``vocabulary_file`` is read on the driver (a vocabulary has a fixed size) and travels with the tasks; what a worker has
    compiled stays on the broadcast value, for its next task. The vocabulary must be a byte-level BPE whose tokens have one merge each, after the
    merges of their parts; any other is refused.
    """
    with open(vocabulary_file, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast({"file": file.read()})
    made = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    inside = docs.select(F.col(text_column).cast("string").alias("_text"), *[F.col(c).alias(f"_in{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "tokens" not in shared.value:
            shared.value["tokens"] = Tokens(shared.value["file"])
        tokens = shared.value["tokens"]
        for batch in batches:
            start = 0
            for texts in batches_of([t or "" for t in batch.column(0).to_pylist()], 1 << 21):
                n = tokens.counts(texts)
                part = batch.slice(start, len(texts))
                start += len(texts)
                computed = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(part.columns[1:] + computed, names=batch.schema.names[1:] + made)

    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in inside.schema.fields[1:]] + ["n_bytes long", "n_tokens long", "over_limit boolean"]
    )
    return inside.mapInArrow(run, schema).select([F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)] + made)


def op12_token_counts(spark, folder) -> DataFrame:
    return count_tokens(read(spark, folder, "documents"), default_vocabulary(), keep=["doc_id"])
