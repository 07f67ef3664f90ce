"""What a worker remembers of the words it has met."""

import numpy as np

from ledgerline.llm import bpe


def test_a_word_met_again_and_again_outlives_full_generations(monkeypatch):
    with open(bpe.default_vocabulary(), encoding="utf-8") as file:
        encoder = bpe.Encoder(bpe.Vocabulary(file.read()))
    learned = []
    short = bpe.encode_short
    monkeypatch.setattr(bpe, "CACHED", 20)
    monkeypatch.setattr(bpe, "encode_short", lambda words, *a: learned.extend(words) or short(words, *a))
    runs = [["common " + " ".join(f"w{i}x{k}" for k in range(8))] for i in range(40)]
    found = [ids.tolist() for run in runs for ids in encoder.encode(run)]
    assert learned.count(b"common") == 1
    assert len(encoder.known) <= 20 + 30 and len(encoder.older) <= 20 + 30
    for run, ids in zip(runs, found):
        assert encoder.decode(np.array(ids)) == run[0]
        assert next(bpe.Encoder(encoder.vocabulary).encode(run)).tolist() == ids
