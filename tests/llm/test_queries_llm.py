"""Registered queries against SQL, brute force, an exact round trip or held-out accuracy."""

import hashlib
import zlib

import brute
import numpy as np
import pytest
from checks.compare import difference
from conftest import FOLDER
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm.bpe import default_vocabulary
from ledgerline.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_substrings(spark, documents):
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op4_substring_dedup"](spark, FOLDER).collect()}
    expected = brute.removed([d["text"] for d in documents], 200)
    assert found == {d["doc_id"]: e for d, e in zip(documents, expected)}


def test_near_duplicates(spark, documents):
    sets = {d["doc_id"]: brute.shingles(d["text"], 3) for d in documents}
    named = brute.components(sets, 85)
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op7_near_duplicates"](spark, FOLDER).collect()}
    assert found == {d: (len(s), named[d], named[d] == d) for d, s in sets.items()}


def test_bpe_is_what_the_library_gives(spark, documents):
    library = Tokenizer.from_file(default_vocabulary())
    for row in QUERIES["op9_bpe_round_trip"](spark, FOLDER).collect():
        text = next(d["text"] for d in documents if d["doc_id"] == row["doc_id"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_quality_on_the_held_out_fold(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    rows = QUERIES["op5_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.85
    assert np.mean([r["score"] for r in held if r["quality"]]) > 0.3 + np.mean([r["score"] for r in held if not r["quality"]])


def test_language_on_the_held_out_fold(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    found = QUERIES["op10_language_id"](spark, folder)
    rows = found.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.95


def test_pipeline_equals_brute_force(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "bpe"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    assert len(rows) > 0.95 * docs.count()
    before = {name: text for name, text, _ in rows}
    left = brute.without_boilerplate(rows, 10)
    rows = [(n, left[n], s) for n, _, s in rows if left[n] == before[n] or left[n].strip(" ")]
    named = brute.components({n: brute.shingles(t, 5) for n, t, _ in rows}, 80)
    rows = [(n, t, s) for n, t, s in rows if named[n] == n]
    taken, _ = brute.copies(rows)
    library = Tokenizer.from_file(default_vocabulary())
    expected = []
    for name, text, source in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        expected.extend([(name, source, ids, hashlib.sha256(text.encode()).hexdigest())] * taken[name])
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["source"], r["ids"], r["decoded_sha256"]) for r in found) == sorted(expected)
