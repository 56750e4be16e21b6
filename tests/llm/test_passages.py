"""Near-equal passages against all pairs."""

import random

import numpy as np
import pyarrow as pa

from archipel.llm.minhash import word_hashes
from archipel.llm.passages import Paragraphs, _distinct_pairs, _meetings, _paragraph_rows, _runs, anchors, repeated_passages

SCHEMA = "doc_id long, text string"


def covered(texts, how=Paragraphs()):
    """The words of each document in paragraphs that are linked, in clusters of several documents; all pairs compared."""
    hashes, begins = word_hashes(pa.array([t for _, t in texts]))
    order = _runs(hashes, 3)
    order = np.append(order, np.full(len(hashes) - len(order), np.iinfo(np.uint64).max, dtype=np.uint64))
    found = []
    for (doc, text), lo, hi in zip(texts, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        own = text.split()
        for at in (anchors(order, lo, hi, how) - lo).tolist():
            words = own[at : at + how.length]
            found.append((doc, at, frozenset(tuple(words[k : k + how.width]) for k in range(how.length - how.width + 1))))
    tree = list(range(len(found)))

    def root(i):
        while tree[i] != i:
            i = tree[i]
        return i

    for i, (doc, _, x) in enumerate(found):
        for j in range(i):
            other, _, y = found[j]
            if doc != other and 100 * len(x & y) >= how.threshold * len(x | y):
                tree[root(i)] = root(j)
    docs = {}
    for i, (doc, _, _) in enumerate(found):
        docs.setdefault(root(i), set()).add(doc)
    return {(doc, at + k) for i, (doc, at, _) in enumerate(found) if len(docs[root(i)]) > 1 for k in range(how.length)}


def check(spark, texts):
    got = repeated_passages(spark.createDataFrame(texts, SCHEMA).repartition(5)).collect()
    assert {(r["doc_id"], r["start"] + k) for r in got for k in range(r["n_words"])} == covered(texts)
    return got


def test_near_equal_passages_match_all_pairs(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for family in range(20):
        passage = some(rng.randint(31, 45))
        for _ in range(8):
            own = passage.copy()
            if rng.random() < 0.5:
                own[rng.choice([0, 1, 2, -1, -2, -3])] = rng.choice(vocabulary)
            texts.append((len(texts), " ".join(some(rng.randint(0, 40)) + own + some(rng.randint(0, 40)))))
    loop = some(23)
    for k in range(12):  # shingles that repeat within a paragraph
        texts.append((len(texts), " ".join((loop * 3)[k : k + 34 + k % 3] + some(k % 2))))
    check(spark, texts)


def test_a_crowd_of_variants_is_joined_whole(spark):
    rng = random.Random(10)
    passage = [f"p{i}" for i in range(32)]
    # All begin a word or two before or after the same place, so each paragraph is the only one of its kind.
    texts = [(i, " ".join([f"a{i}", *passage[:-1]] if i % 2 else [*passage[:-1], f"z{i}"])) for i in range(150)]
    texts += [(1000 + i, " ".join(f"q{rng.randrange(10**9)}" for _ in range(60))) for i in range(20)]
    got = check(spark, texts)
    assert len(got) == 150
    assert len({r["cluster_id"] for r in got}) == 1


def test_more_than_the_first_document_of_a_paragraph_counts(spark):
    shared = [f"s{i}" for i in range(32)]
    near = ["other", *shared[1:]]
    # Document 1 has both, document 2 one of them: the other is near it all the same.
    texts = [(1, " ".join([*shared, *(f"m{i}" for i in range(40)), *near])), (2, " ".join(shared))]
    check(spark, texts)


def test_paragraphs_that_share_a_phrase_only_make_no_crowd():
    rng = random.Random(12)
    words = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    phrases = [words(5) for _ in range(40)]
    texts = [" ".join(words(14) + phrases[i % 40] + words(13)) for i in range(40 * 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc", "text"])
    entries = pa.Table.from_batches(_paragraph_rows(Paragraphs())(iter([batch])))
    entries = entries.sort_by([(c, "ascending") for c in ("key", "whole", "doc", "pos")]).combine_chunks()
    groups = np.unique(entries.column("key").to_numpy() >> 32, return_counts=True)[1]
    assert (groups * (groups - 1) // 2).sum() > 3000  # pairs that meet
    links = sum(len(b.column("whole2").drop_null()) for b in _meetings(Paragraphs())(iter(entries.to_batches())))
    assert links < 5


def test_pairs_are_told_apart_in_order():
    rng = np.random.default_rng(5)
    i, j = rng.integers(0, 300, (2, 5000))
    assert (np.column_stack(_distinct_pairs(i, j, 300)) == np.unique(np.column_stack([i, j]), axis=0)).all()
    none = np.zeros(0, np.int64)
    assert [len(x) for x in _distinct_pairs(none, none, 0)] == [0, 0]


def sorted_entries(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc", "text"])
    entries = pa.Table.from_batches(_paragraph_rows(Paragraphs())(iter([batch])))
    return entries.sort_by([(c, "ascending") for c in ("key", "whole", "doc", "pos")]).combine_chunks()


def met_links(texts):
    tables = [pa.Table.from_batches([b]) for b in _meetings(Paragraphs())(iter(sorted_entries(texts).to_batches()))]
    met = pa.concat_tables(tables)
    return met.filter(pa.compute.is_valid(met.column("whole2")))


def test_paragraphs_of_few_shingles_are_told_apart_by_size():
    # One word over and over, and two of its own: sets of three, of which any two share one.
    texts = [" ".join([f"x{i % 12}"] * 30 + [f"u{i}", f"v{i}"]) for i in range(12 * 200)]
    groups = np.unique(sorted_entries(texts).column("key").to_numpy() >> 32, return_counts=True)[1]
    assert groups.max() > 60
    assert len(met_links(texts)) < 60  # nearly all of some 80,000 pairs that meet differ in parities


def test_pairs_of_a_large_group_are_no_crowd():
    rng = random.Random(14)
    some = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    phrases, texts = [some(5) for _ in range(12)], []
    for i in range(12 * 80):  # pairs that differ in their last word
        own = some(13) + phrases[i % 12] + some(13)
        texts += [" ".join([*own, f"e{len(texts)}"]), " ".join([*own, f"e{len(texts) + 1}"])]
    assert np.unique(sorted_entries(texts).column("key").to_numpy() >> 32, return_counts=True)[1].max() > 64
    links = met_links(texts)
    found = {tuple(sorted(p)) for p in zip(links.column("doc").to_pylist(), links.column("doc2").to_pylist(), strict=True)}
    assert found == {(i, i + 1) for i in range(0, len(texts), 2)}
    assert not any(links.column("crowded").to_pylist())


def test_only_many_variants_of_one_paragraph_are_a_crowd():
    passage = [f"p{i}" for i in range(31)]
    links = met_links([" ".join([*passage, f"z{i}"]) for i in range(300)])
    assert links.column("crowded").to_pylist().count(True) >= 299


def test_no_chain_of_pairs_waits_for_one_task(spark, monkeypatch):
    from archipel.llm import passages

    asked = []
    whole = passages.components
    monkeypatch.setattr(passages, "components", lambda edges: asked.append(edges.count()) or whole(edges))
    words = [f"c{i}" for i in range(200)]
    # Each text is the one before, two words on: neighbours are similar, and all hang together.
    check(spark, [(k, " ".join(words[2 * k : 2 * k + 32])) for k in range(80)])
    assert asked[0] == 0
    assert asked[1] >= 79
