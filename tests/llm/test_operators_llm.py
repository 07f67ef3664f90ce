"""Edges of each operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import bpe, chosenpath, language, lines, mixing, neighbours, quality, suffixes, topk, warc
from ledgerline.llm.common import Scratch
from ledgerline.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} x{i * 7919 % 10007}" for i in range(12_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew quiet potions near a frozen river bank and " * 2
ROWS = [
    (1, "hello world this is a text", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "nobody knows my number at all", "en", "b", 3),
    (4, LONG, "fr", None, 9),
    (4, LONG, "fr", None, 9),
    (5, "Start " + PASSAGE + " middle one", "en", "a", 1),
    (6, "Other beginning. " + PASSAGE + " and then an end", None, "c", 1),
    (7, "\n\n \t\n", "en", "a", 2),
    (8, "émigré ~ 日本語   <|endoftext|> 🙂🙂", "xx", "c", 2),
    (9, "ab" * 400, "en", "a", 2),
    (10, "1234 5678 !!", "en", "a", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# exact top-k and nearest neighbours

VECTORS = [
    (0, [1.0, 2.0, -1.0]), (50, [0.0, 0.0, 0.0]), (1, [1.0, 2.0, -1.0]), (2, [1.0, 2.0, -1.0]), (3, None), (4, [1.0, None, 2.0]),
    (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [3.0]), (8, []), (None, [9.0, 9.0, 9.0]), (1, [1.0, 2.0, -1.0]), (100, [-5.0, 1.0, 2.0]),
]


@pytest.mark.parametrize("search, zero", [(topk.search, True), (neighbours.nearest, False)])
def test_vector_search_edges(spark, search, zero):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "'x' AS score")
    found = search(rows.where("vec_id % 50 = 0"), rows, 3).collect()
    good = {v: np.pad(np.array(x, float), (0, 3 - len(x))) for v, x in VECTORS if v is not None and v not in (3, 4, 5, 6) and (zero or any(x))}
    expected = []
    for q in (v for v in good if v % 50 == 0):
        best = sorted((-float(good[q] @ good[v]), v) for v in good if v != q)[:3]
        expected += [(q, i + 1, v, -s) for i, (s, v) in enumerate(best)]
    assert plain(found) == plain([(q, r, v, int(s) if zero else s) for q, r, v, s in expected])
    assert search(rows.where("false"), rows, 3).count() == search(rows, rows.where("false"), 3).count() == 0


def test_block_pruning_is_exact():
    rng = np.random.default_rng(1)
    rows, ids = np.floor(rng.normal(0, 60, (700, 16))), rng.permutation(700)
    rows[300:340] = rows[0]  # ties
    q, v, s = topk.block_top_k(ids[:9], rows[:9], ids, rows, k=7, block=16)
    for i in range(9):
        best = sorted((-int(rows[i] @ rows[j]), int(ids[j])) for j in range(700) if j != i)[:7]
        assert [(-a, b) for a, b in best] == list(zip(s[q == ids[i]].tolist(), v[q == ids[i]].tolist()))


def test_large_weights_stay_whole_numbers():
    rows = np.array([[2.0**30, 1], [2.0**30, 2], [2.0**30, 3]])
    assert topk.block_top_k(np.array([0]), rows[:1], np.arange(3), rows, k=2)[2].tolist() == [2**60 + 3, 2**60 + 2]


def test_huge_components_have_scores(spark):
    big = [(0, [1e38, -1e38, 1.0]), (1, [1e38, 1e38, 2.0]), (2, [3e38, 0.0, 0.0]), (3, [-3e38, 0.0, 1.0]), (4, [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    found = topk.search(rows.where("vec_id = 0"), rows, 9).collect()
    end = 2**63 - 1
    assert [(r["vec_id"], r["score"]) for r in found] == [(2, end), (1, 2), (4, 1), (3, -end)]
    huge = [(i, [x * 1e162 for x in v[:2]]) for i, v in big[:4]] + [(4, [1.0, 2.0]), (5, [1e-200, 0.0]), (6, [1e-300, 1e-300])]
    rows = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    for k in (1, 2, 3, 9):
        found = neighbours.nearest(rows.where("vec_id IN (0, 2)"), rows, k).collect()
        by = {q: [(r["vec_id"], r["score"]) for r in found if r["query_id"] == q] for q in (0, 2)}
        assert by[2] == [(0, np.inf), (1, np.inf), (4, 3e200), (5, pytest.approx(3.0)), (6, pytest.approx(3e-100)), (3, -np.inf)][:k]
        assert by[0] == [(2, np.inf), (5, pytest.approx(1.0)), (1, 0.0), (6, 0.0), (4, -1e200), (3, -np.inf)][:k]


def test_quantised_bounds_never_lose_a_neighbour():
    rng = np.random.default_rng(2)
    for spread in (1, 1e-3, 50):
        rows, ids = rng.normal(0, 1, (900, 24)) * rng.lognormal(0, spread if spread < 5 else 3, (900, 1)), np.arange(900)
        q, v, s = neighbours.tile_nearest(ids[:20], rows[:20], ids, rows, k=5)
        for i in range(20):
            got = sorted(zip((-s[q == i]).tolist(), v[q == i].tolist()))[:5]
            best = sorted((-float(rows[i] @ rows[j]), j) for j in range(900) if j != i)[:5]
            assert [b for _, b in got] == [b for _, b in best]
        assert len(q) < 20 * 300  # most pairs never reach doubles


# names of their own

def test_extra_columns_of_any_name_come_through(spark, docs):
    own = ["_size", "_source", "_source_size", "_target", "_rate", "_weight", "_gid", "_gkey", "_gone", "_key", "_hash", "_keeper", "_id", "_text", "_n", "_nth", "in_0", "in_3"]
    extra = docs.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(own)])
    for result in (mixing.mixed(extra), mixing.mix(extra), lines.dedup_lines(extra), chosenpath.without_near_duplicates(extra)):
        assert result.columns[: len(extra.columns)] == extra.columns
        rows = result.collect()
        assert rows and all([r[c] for c in own] == list(range(len(own))) for r in rows)
    assert plain(lines.dedup_lines(extra).drop(*own).collect()) == plain(lines.dedup_lines(docs).collect())
    assert plain(mixing.mixed(extra).drop(*own).collect()) == plain(mixing.mixed(docs).collect())


# mixing

def test_mixing(docs, none):
    found = mixing.mixed(docs.selectExpr("*", "'x' AS size", "0 AS rate")).collect()
    assert len(found) == len(ROWS)
    taken, target = brute.copies([(n, t, s) for n, t, _, s, _ in ROWS])
    for r in found:
        assert r["copies"] == taken[r["doc_id"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["copies"] <= 2
    emitted = mixing.mix(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["copies"] for r in found)
    assert plain(emitted.collect()) == plain(mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixed(docs.where("doc_id = 3")).first()["target"] == 0.0


def test_mixing_many_sources(spark):
    rows = [(i, "w " * (i % 37), "en", f"s{i * i % 211:03}", 0) for i in range(3000)]
    found = mixing.mixed(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    taken, target = brute.copies([(n, t, s) for n, t, _, s, _ in rows])
    assert all(r["copies"] == taken[r["doc_id"]] and r["target"] == pytest.approx(target[r["source"]]) for r in found)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in found))


# WARC

TRICKY = [b"", b"x", b"\r\n", b"\r\n\r\nWARC/1.1\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"a\r\n\r\nWARC/1.1", b"a\r\n\r\nWARC/1.1\r\n" * 5, b"end\r\n\r\n", b"\r\n\r\nWARC/1.1\r", "é日本🙂".encode() * 40]


@pytest.mark.parametrize("most", [7, 30, 1 << 20])
def test_archives_round_trip(spark, most):
    rows = [(i, f"http://x/{i} a", p.decode()) for i, p in enumerate(TRICKY * 2)] + [(None, None, "tail"), (99, "u", None), (3, "u", TRICKY[3].decode())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "0 AS payload", "1 AS refers_to")
    path = warc.write_archives(pages.repartition(2), Scratch(spark).path("t"), most=most)
    chunks = warc.read_archives(spark, path).collect()
    newest = {}
    for name, _, html in rows:
        if name is not None:
            newest[html or ""] = max(name, newest.get(html or "", name))
    records = [r for r in chunks if r["last"]]
    expected = []
    for name, _, html in rows:
        raw, old = (html or "").encode(), name is not None and name < newest[html or ""]
        expected.append((name, len(raw), __import__("base64").b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if old else "response", newest[html or ""] if old else None))
    assert plain((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records) == plain(expected)
    assert all(len(r["chunk"]) <= most for r in chunks)
    for name, payload in ((10, TRICKY[0]), (13, TRICKY[3]), (16, TRICKY[6]), (19, TRICKY[9])):
        parts = sorted((r for r in chunks if r["page_id"] == name), key=lambda r: r["chunk_no"])
        whole = b"".join(bytes(r["chunk"]) for r in parts)
        assert whole == (b"" if parts[0]["record_type"] == "revisit" else payload)
        if parts[0]["record_type"] == "response":  # a digest for each chunk
            assert [r["size"] for r in parts] == np.cumsum([len(r["chunk"]) for r in parts]).tolist()


def test_archives_min_bytes_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = warc.write_archives(pages, Scratch(spark).path("t"), min_bytes=3)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path, payloads=False).collect()}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    path = warc.write_archives(pages.where("false"), Scratch(spark).path("t"))
    assert warc.read_archives(spark, path).count() == 0


def test_a_damaged_archive_is_an_error(spark):
    pages = spark.createDataFrame([(1, "u", "abcdef")], "page_id long, url string, html string")
    rows = warc.segments(pages, 0, 1 << 20, "page_id", "html", "url").selectExpr("replace(value, 'abc', 'abd') AS value")
    path = Scratch(spark).path("t")
    rows.write.option("compression", "gzip").option("lineSep", warc.END).text(path)
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(spark, path).collect()


# substrings

def test_substring_edges(docs, none):
    found = suffixes.dedup_substrings(docs.selectExpr("*", "'x' AS key", "1 AS spans", "2 AS raw")).collect()
    assert len(found) == len(ROWS)
    expected = {}
    for (name, *_), row in zip(ROWS, brute.removed([t for _, t, *_ in ROWS], 200)):
        expected[name] = row
    for r in found:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["spans"]) == r["n_spans"]
    assert expected[9][1] == 800 and 0 < expected[5][1] < expected[5][0] and expected[4][1] == expected[4][0]
    assert suffixes.dedup_substrings(none).count() == 0


@pytest.mark.parametrize("bucket", [3000, 4])
def test_substrings_of_random_mosaics(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    rng = random.Random(bucket)
    parts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(5, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["abc" * 90, "q" * 300, "ab" * 45]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: tuple(r)[1:] for r in suffixes.dedup_substrings(rows, 40, keep=["doc_id"], full=False).collect()}
    assert found == dict(enumerate(brute.removed(texts, 40)))


def test_runs_of_a_common_gram_are_cut_by_longer_ones(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 5)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef") for _ in range(230))
    noise = lambda n: "".join(rng.choice("uvwxyz ") for _ in range(n))
    # one passage in many surroundings, some of which agree for a few bytes, a piece too short to go, and a period
    tails = [noise(4) for _ in range(3)]
    texts = [noise(150) + passage + rng.choice(tails) + noise(150) for _ in range(40)] + [noise(60) + passage[:190] + noise(60) for _ in range(20)]
    texts += [noise(30) + "ab" * rng.randint(95, 140) + noise(30) for _ in range(12)] + ["q" * n for n in range(195, 215)] + [noise(9) + passage + noise(9)] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: tuple(r)[1:] for r in suffixes.dedup_substrings(rows, 200, keep=["doc_id"], full=False).collect()}
    assert found == dict(enumerate(brute.removed(texts, 200)))


def test_lengths_of_grams_end_at_the_window():
    for length in (16, 17, 40, 200, 1000):
        grams = suffixes.gram_lengths(length)
        assert grams == sorted(set(grams)) and grams[-1] == length and len(grams) < 8


def test_equal_suffixes_at_any_length():
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(97, 99, 400).astype(np.uint8)] * 2 + [np.zeros(8, np.uint8)])
    for length in (16, 21, 40, 203):
        starts = np.arange(len(text) - 8 - length)
        same = suffixes.equal_suffixes(text, starts, length)
        classes = {}
        for i, s in enumerate(starts):
            classes.setdefault(text[s : s + length].tobytes(), set()).add(int(same[i]))
        assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


# near duplicates

def test_near_duplicate_edges(docs, none):
    found = chosenpath.near_duplicates(docs.selectExpr("*", "1 AS v", "2 AS key", "3 AS tokens")).collect()
    assert len(found) == len(ROWS)
    by = {(r["doc_id"], r["n_shingles"]): r for r in found}
    for name, text, *_ in ROWS:
        r = by[name, len(brute.shingles(text, 5))]
        assert r["component_id"] == name and r["kept"]
    left = chosenpath.without_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 1  # the repeated row
    assert chosenpath.near_duplicates(none).count() == chosenpath.without_near_duplicates(none).count() == 0


@pytest.mark.parametrize("small", [200, 5])
def test_chains_of_near_copies(spark, monkeypatch, small):
    """Copies that drift apart, a large group around one text, and exact copies: all are found, whatever a node may hold."""
    monkeypatch.setattr(chosenpath, "SMALL", small)
    monkeypatch.setattr(chosenpath, "ROUNDS", 1 if small == 5 else 6)
    rng = random.Random(small)
    rows, word = [], lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(80)]
    for _ in range(25):
        rows.append(list(base))
        base[rng.randrange(80)] = word()
    star = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(star)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(120)] = word()
        rows.append(copy)
    rows += [[word() for _ in range(60)] for _ in range(40)]
    texts = [" ".join(r) for r in rows] * 2 + ["Few words", "few  WORDS", "few words indeed"]
    order = rng.sample(range(len(texts)), len(texts))
    data = [(i, texts[j]) for i, j in enumerate(order)]
    found = chosenpath.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(5), 3, 85).collect()
    sets = {n: brute.shingles(t, 3) for n, t in data}
    named = brute.components(sets, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {n: (len(s), named[n]) for n, s in sets.items()}


def crowd(n, seed, width=400, apart=20, near=8):
    """Pairs of word sets: the pairs are alike just below 85 % among each other, the two of a pair just above."""
    rng, texts = random.Random(seed), []
    for i in range(n):
        one = [f"w{k}" for k in range(width)]
        for k in rng.sample(range(width), apart):
            one[k] = f"own{i}x{k}"
        other = list(one)
        for k in rng.sample(range(width), near):
            other[k] = f"other{i}x{k}"
        texts += [" ".join(one), " ".join(other)]
    return texts


def node_of(spark, texts, size=None):
    """All texts in one node, and what the comparison reads of them."""
    shingles = chosenpath.Shingler(1)
    sets = [shingles(t) for t in texts]
    reps = spark.createDataFrame([(v, chosenpath.signature(c).tobytes(), len(c)) for v, c in enumerate(sets)], "v long, tokens binary, shingles long")
    return sets, reps, reps.selectExpr("7L AS node", "-1 AS tree", "v"), spark.createDataFrame(list(enumerate(texts)), "v long, text string")


def joined(links, n):
    return brute.components({v: frozenset(frozenset(x) for x in links if v in x) for v in range(n)}, 0) if links else {v: v for v in range(n)}


@pytest.mark.parametrize("small, blocks", [(1000, 32), (7, 32), (10, 1)])
def test_a_node_loses_no_pair_above_the_threshold(spark, docs, monkeypatch, small, blocks):
    """A node taken whole, cut into blocks, or branched on gives the links that a look at all pairs gives."""
    for name, value in (("SMALL", small), ("BLOCKS", blocks), ("DEEPER", 2), ("ROUNDS", 2)):
        monkeypatch.setattr(chosenpath, name, value)
    texts = crowd(25, 3)
    sets, reps, nodes, shown = node_of(spark, texts)
    expected = brute.components({v: frozenset(c.tolist()) for v, c in enumerate(sets)}, 85)
    assert len(set(expected.values())) == 25
    run = chosenpath.NearDuplicates(docs, 1, 85, "doc_id", "text")
    links = {tuple(r) for r in run.compared(nodes, spark.createDataFrame([], "v long, label long"), reps, shown).collect()}
    assert joined(links, 50) == expected
    # a pair that is one component already gives nothing
    labels = spark.createDataFrame([(v, v - v % 2) for v in range(50)], "v long, label long")
    assert run.compared(nodes, labels, reps, shown).isEmpty()


def test_a_crowd_below_the_threshold_makes_no_rows(spark, docs):
    """300 texts alike in just less than the threshold: no pair of them leaves a node, and each is looked at in one tree only."""
    texts = crowd(300, 5)[::2]
    sets, reps, _, shown = node_of(spark, texts)
    run = chosenpath.NearDuplicates(docs, 1, 85, "doc_id", "text")
    nodes = run.rooted(reps)
    table = nodes.join(reps, "v").selectExpr("node", "0 AS x", "0 AS y", "0 AS own", "v", "v AS label", "tree AS first", "shingles", "tokens").toPandas()
    looked = []
    for _, group in table.groupby("node"):
        members = chosenpath.Group(pa.Table.from_pandas(group, preserve_index=False), run.floor, 85)
        looked += [frozenset((int(members.v[i]), int(members.v[j]))) for i, others in members.candidates() for j in others]
    assert len(looked) == len(set(looked)) > 10_000
    tokens = np.stack([np.frombuffer(r["tokens"], np.uint16) for r in reps.orderBy("v").collect()])
    placed = chosenpath.in_trees(tokens, run.trees)
    for i in range(0, 300, 17):
        agree = chosenpath.agreeing(tokens, tokens[i])
        assert {j for j in range(300) if j != i and agree[j] >= run.floor and (placed[i] == placed[j]).any()} == {j for p in looked if i in p for j in p - {i}}
    held = run.open(nodes, spark.createDataFrame([], "v long, label long")).join(reps, "v").withColumn("first", chosenpath.F.col("tree"))
    involved = run.involved(held)
    assert 0 < involved.count() <= held.count() and run.linked(involved, shown).count() == 0


@pytest.mark.parametrize("percent", [85, 80])
def test_a_pair_at_the_threshold_is_lost_as_seldom_as_stated(docs, percent):
    run = chosenpath.NearDuplicates(docs, 3, percent, "doc_id", "text")
    agree = np.random.default_rng(4).binomial(chosenpath.TOKENS, percent / 100, 3_000_000) / chosenpath.TOKENS
    assert np.mean(np.where(agree < run.floor, 1.0, (1 - agree**chosenpath.DEPTH) ** run.trees)) <= 1.5 * chosenpath.MISS


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200, n) for n in range(201, 230)] + [(7, 7)]
    rows = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()
    label = {r["v"]: r["label"] for r in rows}
    expected = brute.components({n: frozenset(frozenset(x) for x in links if n in x) for link in links for n in link}, 0)
    assert {n: label.get(n, n) for n in expected} == expected


# line dedup

def test_line_dedup(spark, docs, none):
    rows = [(i, f"only {i}\nshared line\n\nnear {i % 4}", "en", f"s{i % 7}", 0) for i in range(40)]
    rows += [(99, "shared line", "en", None, 0), (None, "shared line\nx", "en", "s1", 0), (41, None, "en", "s1", 0), (42, "", "en", "s1", 0), (3, rows[3][1], "en", "s3", 0)]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n_lines", "'x' AS line").repartition(3)
    found = lines.dedup_lines(frame, min_sites=6)
    assert sorted(found.columns) == sorted(frame.columns + ["n_removed"])
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_removed"]) for r in found.collect()}
    assert got[0, "only 0\nshared line\n\nnear 0"] == (4, 0) and got[5, "only 5\n"] == (4, 2)
    assert got[99, ""] == (1, 1) and got[None, "x"] == (2, 1) and got[41, None] == (0, 0) and got[42, ""] == (1, 0)
    assert found.count() == len(rows) and lines.dedup_lines(none).count() == 0
    assert lines.dedup_lines(docs).count() == len(ROWS)


def test_line_dedup_counts_exactly_near_the_threshold(spark):
    rows = [(i * 1000 + j, f"line {i}", "en", f"s{j}", 0) for i in range(90, 112) for j in range(i)]
    found = lines.dedup_lines(spark.createDataFrame(rows, DOCS), min_sites=100).where("n_removed > 0")
    assert {r["doc_id"] // 1000 for r in found.select("doc_id").collect()} == set(range(100, 112))


def test_line_dedup_runs_no_python(spark):
    from ledgerline.llm.queries import QUERIES
    from conftest import FOLDER

    plan = QUERIES["op8_line_dedup"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# BPE

def test_bpe_equals_the_library():
    library, encoder = Tokenizer.from_file(bpe.default_vocabulary()), None
    with open(bpe.default_vocabulary()) as file:
        encoder = bpe.Encoder(bpe.Vocabulary(file.read()))
    rng = random.Random(8)
    alphabet = "aabcdeé日🙂ñ  \n\t'’s1٣²_-.!  ̀\x1c\x85﻿"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["x" * 5000, "ab" * 3000 + "é" * 999, "<|endoftext|>a <|endoftext|><|endof", " " * 70 + "a", "I'll we've 'S don't", LONG, "Zyzzogeton" * 40]
    for text, ids in zip(texts, encoder.encode(texts)):
        theirs = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == theirs, repr(text[:80])
        assert encoder.decode(ids) == library.decode(theirs, skip_special_tokens=False)


def test_short_and_long_words_are_merged_alike():
    with open(bpe.default_vocabulary()) as file:
        vocabulary = bpe.Vocabulary(file.read())
    rng = random.Random(9)
    words = [bytes(rng.choice(b"thearingsoun ") for _ in range(rng.randint(1, bpe.WIDE))) for _ in range(500)]
    assert bpe.encode_short(words, vocabulary) == [bpe.encode_long(w, vocabulary) for w in words]
    for wide in bpe.WIDTHS:
        short = [w for w in words if len(w) <= wide]
        assert len(short) > 50 and bpe.encode_short(short, vocabulary, wide) == [bpe.encode_long(w, vocabulary) for w in short]


def test_bpe_edges(docs, none):
    found = bpe.encode_decode(docs.selectExpr("*", "'x' AS ids", "0 AS _text"), bpe.default_vocabulary())
    rows = found.collect()
    assert len(rows) == len(ROWS)
    assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert bpe.encode_decode(none, bpe.default_vocabulary()).count() == 0


# classifiers

def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    net = quality.fit_quality(docs, labels)
    rows = quality.scored(docs.selectExpr("*", "'x' AS score"), net).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert quality.scored(none, net).count() == 0
    empty = quality.fit_quality(none, labels)
    assert {r["score"] for r in quality.scored(docs, empty).collect()} == {0.5}


def test_quality_covers_the_whole_text():
    assert all(np.array_equal(np.unique(quality.chunks_of(t).max(axis=1) < quality.PAD), [True]) is not None for t in ("", "a"))
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        raw = np.arange(n) % 251
        chunks = quality.chunks_of("".join(map(chr, raw % 128)))
        seen = np.full(len(chunks) * quality.STEP + quality.CHUNK, -1)
        for i, c in enumerate(chunks):
            seen[i * quality.STEP : i * quality.STEP + quality.CHUNK] = c
        assert np.array_equal(seen[:n], raw % 128) and len(chunks) == max(1, -(-(n - 64) // 448))


def test_fits_see_all_of_a_long_text(monkeypatch):
    """Every chunk and every sentence is in some pass, though a pass has only a few."""
    text = "".join(f"{i:07}" for i in range(2560))
    chunks, gradients = {c.tobytes() for c in quality.chunks_of(text)}, quality.gradients
    seen, most = set(), []

    def watched(net, picked, labels):
        seen.update(c.tobytes() for part in picked for c in part)
        most.append(max(map(len, picked)))
        return gradients(net, picked, labels)

    monkeypatch.setattr(quality, "gradients", watched)
    quality.fitted([(text, 0), ("short", 1)], updates=60)
    assert len(chunks) == 40 and chunks <= seen and max(most) == quality.FIT_CHUNKS
    words = {f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)}
    model = language.fitted([(". ".join(sorted(words)), "a"), ("other text. in b", "b")])
    known = sorted(words)
    before, weights = language.LanguageModel(model.languages, {}), model.weights["hashed"]
    grams, _, _ = before.features.rows(known)
    flat, starts = grams[-1]  # of each word the longest n-grams carry weight once it was learned from
    met = {w for w, part in zip(known, np.split(flat, starts[1:])) if np.abs(weights[part]).max() > 1e-3}
    assert met == words


def test_quality_gradients():
    rng = np.random.default_rng(3)
    net = quality.new_network(rng)
    net = {k: v.astype(np.float64) for k, v in net.items()}
    picked = [rng.integers(0, 256, (n, quality.CHUNK)).astype(np.int16) for n in (1, 3, 2)]
    labels = np.array([0.0, 1.0, 1.0])

    def loss():
        features = np.concatenate([quality.pooled(net, p) for p in picked])
        z = quality.logits(net, quality.combined(features, np.array([0, 1, 4])).astype(float))[1]
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    grads = quality.gradients(net, picked, labels)
    for name in ("out", "hidden", "filters", "embed", "filter_bias"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), net[name].shape)
        before, h = net[name][at], 1e-3
        net[name][at] = before + h
        up = loss()
        net[name][at] = before - h
        down = loss()
        net[name][at] = before
        assert (up - down) / (2 * h) == pytest.approx(grads[name][at], rel=0.05, abs=1e-4)


def test_every_language_with_a_label_is_learned(spark, monkeypatch):
    rows = [(1000 * n + i, f"text {i} of number {n}", f"l{n:02}", "a", 0) for n in range(70) for i in range(3 if n else 40)]
    rows += [(99_999, "no language", None, "a", 0)]
    seen = []
    monkeypatch.setattr(language, "fitted", lambda sample: seen.append(list(sample)))
    language.fit_languages(spark.createDataFrame(rows, DOCS), folds=10**6)
    monkeypatch.setattr(language, "SAMPLE", 140, raising=False)
    language.fit_languages(spark.createDataFrame(rows, DOCS), folds=10**6)
    for sample, most in zip(seen, (40, 2)):
        counts = {lang: sum(x == lang for _, x in sample) for _, lang in sample}
        assert counts == {f"l{n:02}": min(most, 3 if n else 40) for n in range(70)}


def test_more_languages_than_a_model_has_columns(spark, monkeypatch):
    """Each is learned by one of several models of bounded width, and texts come to the one that knows their language."""
    monkeypatch.setattr(language, "COLUMNS", 4)
    ends = ["th{}ing", "sch{}ung", "qu{}eux", "yks{}nen", "prz{}wy", "ngu{}mba", "hva{}rdu", "tlx{}col", "gwy{}dd", "ij{}zer"]
    said = [" ".join(end.format(a + b) for a in "aeiou" for b in "rst") + "." for end in ends]
    rows = [(100 * n + i, said[n], f"l{n}", "a", 0) for n in range(10) for i in range(20 - n)]
    rows += [(5000 + n, said[n], None, "a", 0) for n in range(10)] + [(6000, None, "l1", "a", 0), (6001, " 1 ", None, "a", 0)]
    table = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS score", "7 AS _text", "8 AS _in0")
    model = language.fit_languages(table, folds=10**6)
    found = language.identified(table, model, sure=True)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text", "_in0", "lang_pred", "score", "sure"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(rows) and {got[6000]["lang_pred"], got[6001]["lang_pred"]} == {"und"}
    assert all(got[name]["lang_pred"] == f"l{said.index(text)}" and got[name]["score"] > 0.5 for name, text, *_ in rows if name < 6000)
    widths = []
    while model is not None:
        widths.append(len(model.languages))
        model = model.following and model.following()
    assert widths == [4, 4, 4]
    assert language.identified(table.limit(0), language.fit_languages(table, folds=10**6)).count() == 0


def test_the_sample_is_the_documents_of_least_hash(spark):
    from ledgerline.llm.sampling import labelled_sample

    docs = spark.range(9000).selectExpr("id AS doc_id", "string(id) AS text", "IF(id % 9 < 8, 'hot', 'rare') AS label")
    docs = docs.unionByName(docs.where("doc_id < 3000"))  # repeated rows count once
    got = {(int(text), label) for text, label in labelled_sample(docs, docs, "label", 50, 1000)}
    rows = sorted((r["h"], r["doc_id"], r["label"]) for r in docs.selectExpr("xxhash64(doc_id) AS h", "doc_id", "label").distinct().collect())
    assert got == {(i, x) for label in ("hot", "rare") for _, i, x in [r for r in rows if r[2] == label][:50]}


def test_language_edges(spark, docs, none):
    model = language.fit_languages(docs)
    assert set(model.languages) <= {"en", "fr", "xx"}
    rows = language.identified(docs.selectExpr("*", "'x' AS score", "'y' AS _text"), model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in model.languages) if lettered else (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language.identified(none, model).count() == 0
    assert {r["lang_pred"] for r in language.identified(docs, language.fit_languages(none)).collect()} == {"und"}


def test_forward_backward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(5)
    lengths, k = np.array([3, 1, 4, 3]), 3
    emission, start, moves = rng.normal(size=(11, k)), rng.normal(size=k), rng.normal(size=(k, k))
    p, expected, begun, total = language.forward_backward(emission, lengths, start, moves)
    import itertools

    at, all_moves, log_sum = 0, np.zeros((k, k)), 0.0
    for n in lengths:
        weights, sums, pairs = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            score = start[path[0]] + sum(emission[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            weight = np.exp(score)
            weights += weight
            for i, y in enumerate(path):
                sums[i, y] += weight
            for a, b in zip(path, path[1:]):
                pairs[a, b] += weight
        assert np.allclose(p[at : at + n], sums / weights)
        all_moves += pairs / weights
        log_sum += np.log(weights)
        at += n
    assert np.allclose(expected, all_moves) and total == pytest.approx(log_sum) and begun.sum() == pytest.approx(4)


def test_language_labels_switched_text():
    sample = [(" ".join(f"th{a}ing wh{a}er the{a}." for a in "aeiou") * 3, "en"), (" ".join(f"sch{a}ung ver{a}lich und{a}." for a in "aeiou") * 3, "de")]
    labeller = language.Labeller(language.fitted(sample))
    words, counts, p = labeller.words(["thaing wheer theo schaung verilich unde"])
    named = [labeller.model.languages[i] for i in p.argmax(axis=1)]
    assert counts.tolist() == [6] and named == ["en"] * 3 + ["de"] * 3


# the pipeline

def test_pipeline_stages_on_edges(spark, docs, none):
    extra = docs.selectExpr("*", "1 AS size", "'x' AS score", "2 AS n_removed", "3 AS _key")
    for table, rows in ((extra, len(ROWS)), (none, 0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            path = Scratch(spark).path(name)
            stage(spark, now, "").write.parquet(path)
            before, now = now, spark.read.parquet(path)
            if name != "bpe":
                assert now.columns == table.columns
        assert now.count() <= 2 * rows
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, extra, "").collect()}
    assert not kept & {2, 3, 7, 10} and {1, 5, 9} <= kept


def test_the_language_stage_keeps_clean_documents(spark, docs, monkeypatch):
    """In several languages at once, and where no language could be learned."""
    ends = {"en": "th{}ing wh{}er the{}.", "de": "sch{}ung ver{}lich und{}.", "fr": "qu{}eux d{}ment eau{}.", "fi": "yks{}nen kak{}lla j{}."}
    said = {lang: " ".join(form.format(a, a, a) for a in "aeiou") for lang, form in ends.items()}
    model = language.fitted([(text * 3, lang) for lang, text in said.items()])
    mixed = " ".join(said[x] for x in ("en", "de", "fr", "fi"))
    assert 0.4 > language.Labeller(model).documents([mixed])[0][1]
    table = spark.createDataFrame([(1, mixed, None, "a", 1), (2, said["fr"], None, "a", 1), (3, "123 !", None, "a", 1), (4, None, None, "a", 1)], DOCS)
    for learned in (model, language.LanguageModel([], {})):
        monkeypatch.setattr(corpus_pipeline, "fit_languages", lambda _: learned)
        assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, table, "").collect()} == {1, 2}
