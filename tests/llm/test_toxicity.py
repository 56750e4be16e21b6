"""The classifier with its production parameters."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from archipel.llm.toxicity import Training, fit, scores


def test_rare_families_and_misspelt_short_words_count():
    rng = random.Random(3)
    clean = ["".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    text = lambda bad: " ".join([*(rng.choice(clean) for _ in range(rng.randint(20, 60))), *bad])
    toxic = [text([rng.choice(["idiot", "clown", "trash"]) for _ in range(3)]) for _ in range(340)]
    toxic += [text(["bocon", "bocaza", "bocon"]) for _ in range(8)]  # a family in few texts
    texts = toxic + [text([]) for _ in range(1500)]
    labels = np.array([1] * len(toxic) + [0] * 1500)
    weights, bias = fit(texts, labels)
    score = lambda bads: scores(pa.array([text(b) for b in bads]), weights, bias, Training())
    plain = score([[]] * 200)
    assert (plain < 0.5).mean() > 0.95
    assert (score([["bocon", "bocaza", "bocon"]] * 50) >= 0.5).mean() > 0.9
    # Unseen spellings share edges with trained words, so each weighs more than nearly all clean words.
    single = lambda words: scores(pa.array(words), weights, bias, Training())
    assert single(["id1ot", "cl0wn", "tr@sh"]).min() > np.quantile(single(clean), 0.95)


def test_training_takes_little_more_than_its_arrays():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=12)) for _ in range(100)) for _ in range(200)]
    tracemalloc.start()
    try:
        fit(texts, np.arange(200) % 2, Training(buckets=1 << 12, rounds=2))
        assert tracemalloc.get_traced_memory()[1] < 51e6
    finally:
        tracemalloc.stop()


def test_workers_that_tokenized_give_their_pieces_back(monkeypatch):
    from archipel.llm import token_memo

    held = {"some.json": object()}
    monkeypatch.setattr(token_memo, "_MEMOS", held)
    token_memo.forget()
    token_memo.forget()
    assert not held


def test_training_looks_at_subwords_in_blocks(monkeypatch):
    from archipel.llm import toxicity

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 12))) for _ in range(30)) for _ in range(60)]
    how = Training(buckets=1 << 12, rounds=5)
    whole = fit(texts, np.arange(60) % 2, how)
    monkeypatch.setattr(toxicity, "_WORDS", 100)
    monkeypatch.setattr(toxicity, "_SUBWORDS", 500)
    cut = fit(texts, np.arange(60) % 2, how)
    assert np.allclose(whole[0], cut[0], rtol=1e-9, atol=1e-12)
    assert abs(whole[1] - cut[1]) < 1e-9


def test_training_holds_each_subword_once():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=12)) for _ in range(200)) for _ in range(400)]
    tracemalloc.start()
    try:
        fit(texts, np.arange(400) % 2, Training(buckets=1 << 12, rounds=2))
        assert tracemalloc.get_traced_memory()[1] < 70e6
    finally:
        tracemalloc.stop()


def test_idle_workers_give_their_pieces_back(monkeypatch):
    import time

    import public_tokenizers

    from archipel.llm import token_memo

    monkeypatch.setattr(token_memo, "_MEMOS", {})
    monkeypatch.setattr(token_memo, "IDLE_S", 0.3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    held = token_memo.memo(path)
    for _ in range(8):
        time.sleep(0.1)
        held.encode(pa.array(["some text"]))
    assert token_memo.memo(path) is held
    time.sleep(1)
    assert not token_memo._MEMOS
    assert held.encode(pa.array(["some text"]))[0].tolist() == token_memo.memo(path).encode(pa.array(["some text"]))[0].tolist()
