"""Token counts against the tokenizers library."""

import json
import random

import numpy as np
import pytest
import regex
from conftest import FOLDER
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from ledgerline.llm import transducer
from ledgerline.llm.bpe import default_vocabulary

PIECES = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", "s", "r", "re", "l", " ", "  ", "\n", "\t", "a", "the", "ing", "1", "23", "!", "..", " ", " ", "é", "日本", "🙂", "<|endoftext|>", "<|end", "xxxxx", "_", "\0", "--"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def tokens():
    with open(default_vocabulary(), encoding="utf-8") as file:
        return transducer.Tokens(file.read())


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def drawn(seed, pieces, n, most):
    draw = random.Random(seed)
    return ["".join(draw.choice(pieces) for _ in range(draw.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("pieces, most", [(PIECES, 30), (list("abcdeinrst"), 60), (list("aaab"), 40), (list(" \n'sx"), 20)])
def test_random_texts(library, tokens, pieces, most):
    texts = drawn(most, pieces, 5000, most)
    assert tokens.counts(texts).tolist() == lengths(library, texts)


def test_every_kind_of_character(library, tokens):
    texts = [f"a{chr(i)}b {chr(i)}c{chr(i)}{chr(i)}1{chr(i)}" for i in range(0, 0x110000, 7) if not 0xD800 <= i < 0xE000]
    assert tokens.counts(texts).tolist() == lengths(library, texts)


def test_long_runs(library, tokens):
    texts = ["ab" * 60_000, "a" * 30_000, " " * 1000 + "x", "'" * 999, "=-" * 5000, "", "<|endoftext|>" * 3, "word " * 50_000]
    assert tokens.counts(texts).tolist() == lengths(library, texts)
    assert not any(len(w) > transducer.LONGEST for w in tokens.known)


def test_words_are_those_of_the_pattern(tokens):
    texts = drawn(3, PIECES, 2000, 40)
    joined, starts, ends = tokens.splitter.starts(texts)
    bounds, marks = [*starts.tolist(), len(joined)], set(ends.tolist())
    words = [joined[a:b] for a, b in zip(bounds, bounds[1:]) if a not in marks]
    assert words == [w for t in texts for w in regex.findall(PATTERN, t)]


def test_chunk_maps_compose_to_a_plain_run(tokens):
    splitter, draw = tokens.splitter, np.random.default_rng(1)
    for height in (1, 2, 5, 64, 100):
        chunks = draw.integers(0, 12, (height, 16)).astype(np.uint8)
        chunks[:, ::2] = draw.choice([transducer.SPACE, transducer.APOSTROPHE, transducer.R], (height, 8))
        state, expected = 0, []
        for chunk in chunks:
            expected.append(state)
            for c in chunk:
                state = splitter.next[state, c]
        assert splitter.entered(chunks).tolist() == expected


def test_compiling_anew_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(transducer, "STATES", 50)
    monkeypatch.setattr(transducer, "WORDS", 20)
    with open(default_vocabulary(), encoding="utf-8") as file:
        tokens = transducer.Tokens(file.read())
    texts = drawn(9, PIECES, 400, 30)
    for part in (texts[:200], texts[200:]):
        assert tokens.counts(part).tolist() == lengths(library, part)


def test_a_merge_before_its_parts_is_refused():
    model = {"vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3}, "merges": ["ab a", "a b"]}
    with pytest.raises(ValueError, match="after those of its parts"):
        transducer.Counter(json.dumps({"model": model}))


def test_query_is_what_the_library_gives(spark, library):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = transducer.op12_token_counts(spark, folder).collect()
    assert len(found) == len(texts)
    n = dict(zip(texts, lengths(library, list(texts.values()))))
    for r in found:
        assert tuple(r) == (r["doc_id"], len(texts[r["doc_id"]].encode()), n[r["doc_id"]], n[r["doc_id"]] > 512)


def test_edges(spark, library):
    rows = [(1, None), (2, ""), (None, "no id here"), (3, "twice <|endoftext|> over"), (3, "twice <|endoftext|> over"), (4, "é日本🙂 " * 40_000), (5, " "), (6, "\n\n \t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_tokens", "1 AS _text", "2 AS _in0", "text AS over_limit").repartition(3)
    found = transducer.count_tokens(docs, default_vocabulary(), limit=3)
    assert found.columns == ["doc_id", "text", "_text", "_in0", "n_bytes", "n_tokens", "over_limit"]
    expected = [(i, t, len((t or "").encode()), n, n > 3) for (i, t), n in zip(rows, lengths(library, [t or "" for _, t in rows]))]
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], r["text"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found.collect()), key=key) == sorted(expected, key=key)
    assert transducer.count_tokens(docs.where("false"), default_vocabulary()).count() == 0
