"""Every operator against a plain version, with nulls, blanks, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archipel.llm.decontamination import contaminated
from archipel.llm.graph import components
from archipel.llm.line_dedup import dedup_lines
from archipel.llm.minhash import Sketching, near_duplicates
from archipel.llm.passages import repeated_passages
from archipel.llm.pitman_yor import Hierarchy, Restaurants, reseat, score_texts, seat, stirling
from archipel.llm.search import Asked, Bm25, Shard, _index, _packed_queries, search
from archipel.llm.toxicity import Training, fit, score_toxicity, scores

SCHEMA = "doc_id long, text string, n long, key long, score string, id string, label string"
LOW = {i: i + 32 for i in range(65, 91)}
WORDS = [f"w{i}" for i in range(400)]


def tokens(text):
    return [w for w in re.split("[ \t-\r]+", (text or "").translate(LOW)) if w]


def table(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, 7, 7, "x", "y", "z") for i, t in texts], SCHEMA).repartition(parts)


def corpus(seed=4):
    rng = random.Random(seed)
    texts = {}
    for family in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(30, 120))]
        for _ in range(6):
            own = base.copy()
            for _ in range(rng.randint(0, 12)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            texts[len(texts)] = " ".join(own)
    for extra in ("", None, " \n\t ", "one", "One", "one two", "ONE  two", "x" * 3000, "word " * 4000, "word " * 4000):
        texts[len(texts)] = extra
    return list(texts.items())


def true_groups(texts, width, threshold):
    sets = {}
    for i, t in texts:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, width):
    texts = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(table(spark, texts), Sketching(width=width), block=4, block_items=300).collect()}
    assert got == true_groups(texts, width, 80)


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(table(spark, []), Sketching()).count() == 0
    rows = near_duplicates(table(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None)]), Sketching(width=2)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_large_groups_that_stars_leave_apart(spark):
    """Near copies of near copies: most pairs of a crowd are below the threshold, and no pair may be missed."""
    rng = random.Random(11)
    base = [rng.choice(WORDS) for _ in range(60)]
    texts = []
    for i in range(150):
        own = base.copy()
        for k in rng.sample(range(60), rng.randint(2, 7)):
            own[k] = rng.choice(WORDS)
        texts.append((i, " ".join(own)))
    texts += [(i, texts[i % 7][1] + " " + texts[i % 5][1]) for i in range(200, 230)] + [(300, "x y"), (300, texts[0][1]), (301, texts[0][1])]
    docs = table(spark, texts, 5)
    # Few bands of one round: the blocks have most of the work.
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, Sketching(width=2, rounds=(1,)), block=16).where("doc_id < 300").collect()}
    assert got == {i: c for i, (_, c) in true_groups([t for t in texts if t[0] < 300], 2, 80).items()}
    once, again = ([tuple(r) for r in near_duplicates(docs.repartition(n), Sketching(width=2)).orderBy("doc_id", "n_shingles").collect()] for n in (2, 7))
    assert once == again and {r[2] for r in once if r[0] >= 300} == {got[0]}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_lines(spark, broadcast_keys):
    shared = "This line is boilerplate that is long enough to count."
    texts = [(i, f"own {i}\n  {shared.upper() if i % 2 else shared} \nend") for i in range(6)]
    texts += [(6, None), (7, ""), (8, shared[:20]), (9, f"{shared}\n{shared}"), (9, f"{shared}\n{shared}"), (None, shared)]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(table(spark, texts), broadcast_keys=broadcast_keys).collect()]
    want = [(i, 3, 1, f"own {i}\nend") for i in range(6)] + [(6, 1, 0, ""), (7, 1, 0, ""), (8, 1, 0, shared[:20]), *[(9, 2, 0, f"{shared}\n{shared}")] * 2, (None, 1, 0, shared)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert dedup_lines(table(spark, []), broadcast_keys=broadcast_keys - 1).count() == 0


def test_keys_that_agree_in_half_are_told_apart():
    from archipel.llm.line_dedup import SharedKeys

    known = SharedKeys(np.array([5, 5, 5, 9]), np.array([1, 3, 2, 1]), np.array([7, 8, 9, 7]))
    assert known.goes(np.array([5, 5, 5, 9, 4]), np.array([3, 3, 4, 1, 1]), np.array([8, 1, 1, 1, 1])).tolist() == [False, True, False, True, False]
    assert not SharedKeys(*[np.zeros(0, np.int64)] * 3).goes(np.array([1]), np.array([1]), np.array([1])).any()


def test_toxicity_learns_and_meets_unseen_spellings(spark):
    rng = random.Random(0)
    bad = ["vequmo", "vequta", "vequais", "scumbag", "scummy"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) + rng.choice("abcd") for _ in range(60)]
        if i % 4 == 0:
            words[5], words[40] = rng.choice(bad), rng.choice(bad)
        texts.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = table(spark, [*texts, (1000, None), (1001, ""), (1002, "w1a vequnew w2b scums w5"), (None, "w1a w2b")])
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, marks, how=Training()).collect()}
    assert sum(got[i]["predicted"] == y for i, y in labels) >= 396
    assert got[1002]["predicted"] == 1 and got[1001]["predicted"] == got[1000]["predicted"] == got[None]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert score_toxicity(table(spark, []), marks).count() == 0
    none = score_toxicity(docs, marks.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    weights, bias = fit(["a", "b"], np.array([1, 1]))
    assert scores(pa.array(["c", None]), weights, bias, Training()).min() > 0.5


ITEM = "If the red train leaves Paris Nord with 12 wagons and 7 km later meets another train with 12 guards who rides further on"


def test_decontamination_sees_through_parameters(spark):
    changed = ITEM.replace("Paris Nord", "Old London Town").replace("12", "345").replace("7 km", "90 miles").upper().replace("OLD LONDON TOWN", "Old London Town")
    inconsistent = ITEM.replace("with 12 wagons", "with 5 wagons")
    mixed_units = ITEM.replace("7 km", "7 km and 3 km and 9 km")
    texts = [(0, f"Before. {ITEM} After."), (1, "x " * 50 + changed.lower().replace("old london town", "Old London Town") + " y"), (2, inconsistent), (3, "nothing of the kind " * 30), (4, None), (5, ""), (6, " ".join(ITEM.split()[:8])), (7, "filler " * 40_000 + ". " + ITEM), (8, f"{ITEM} {ITEM}"), (None, ITEM), (0, ITEM)]
    items = spark.createDataFrame([(10, ITEM, 3), (11, "too short", 3), (12, None, 3), (None, ITEM, 3)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(table(spark, texts), items, coverage=0.1).collect()}
    assert set(got) == {(0, 10), (1, 10), (2, 10), (6, 10), (7, 10), (8, 10)}
    assert got[0, 10]["coverage"] == got[1, 10]["coverage"] == got[7, 10]["coverage"] == got[8, 10]["coverage"] == 1.0
    # Where 12 is two numbers at once, none of the windows with slots count.
    slotless = got[2, 10]["n_matched"]
    assert slotless < got[0, 10]["n_windows"]
    found = contaminated(table(spark, texts), items)
    assert {r["doc_id"] for r in found.collect()} == {0, 1, 7, 8} | ({2} if 2 * slotless >= got[2, 10]["n_windows"] else set())
    # One unit of the item must be one unit of the document.
    pair = spark.createDataFrame([(1, mixed_units)], "item_id long, text string")
    same, other = mixed_units.replace(" km", " miles"), mixed_units.replace("9 km", "9 miles")
    by = {r["doc_id"]: r["n_matched"] for r in contaminated(table(spark, [(1, same), (2, other)]), pair, coverage=0.1).collect()}
    assert by[2] < by[1]
    assert contaminated(table(spark, []), items).count() == 0
    assert contaminated(table(spark, texts), items.limit(0)).count() == 0


@pytest.mark.parametrize("run", [" Thouingerinoran" * 50_000, " 1" + ".1" * 50_000])
def test_decontamination_reads_long_runs_of_names_and_numbers(spark, run):
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    got = contaminated(table(spark, [(0, f"the{run} ends. {ITEM} After."), (1, f"the{run} ends")]), items).collect()
    assert [(r["doc_id"], r["coverage"]) for r in got] == [(0, 1.0)]


def test_search_matches_brute_force(spark):
    texts = corpus(9)
    docs = table(spark, texts + [(None, "w1 w2")])
    got = collections.defaultdict(list)
    for r in search(docs, docs.where("doc_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    words = {i: tokens(t) for i, t in texts}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    for q in (i for i in words if i % 10 == 0):
        scored = []
        for d, ws in words.items():
            tf = collections.Counter(ws)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(words[q]) if tf[w])
            if s:
                scored.append((-round(s, 9), d))
        want = [(d, -s) for s, d in sorted(scored)[:10]]
        assert [d for d, _ in got[q]] == [d for d, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want])
    assert search(table(spark, []), table(spark, [])).count() == 0


def test_search_in_blocks_ranks_like_one(spark):
    """Many shards and blocks of queries, copies in all of them, tiny pieces: the same rows; scores equal to nine decimals rank by id."""
    texts = corpus(9) + [(1000 + i, " ".join(random.Random(i % 7).choices(WORDS, k=40))) for i in range(200)]
    docs = table(spark, [(i, t) for i, t in texts if t is None or len(t) < 2000], 4)
    asked = docs.where("doc_id % 10 = 0")
    how = Bm25(k=3, block=4, queries=2, often=0.2)
    got, want = ([(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in search(docs, asked, h).orderBy("query_id", "rank").collect()] for h in (how, Bm25(k=3)))
    assert got == want and len(got) > 60
    assert [d for q, _, d, _ in got if q == 1000] == [1000, 1007, 1014]


def test_searched_shards_skip_what_cannot_reach_the_best():
    """Nothing is scored or returned for a query whose k-th score no document of the shard reaches; with the bar just reached, all ties are."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=60)) for _ in range(300)] + ["w1 w2 w3"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    rows = [r for part in _index(iter([batch])) for r in part.to_pylist()]
    shard = Shard(rows[0], 59.0, Bm25(block=8, often=0.1))
    query = shard.terms[::40]
    packed = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([query.view(np.int64).tolist()]), pa.array([[1.5] * len(query)])], ["query", "terms", "idf"])
    asked = Asked([tuple(part.to_pylist()[0][c] for c in ("ids", "sizes", "codes", "terms", "idf")) for part in _packed_queries(iter([packed]))])
    _, ids, found = shard.search(asked, np.zeros(1))
    assert len(ids) >= 10
    best = np.sort(found)[::-1]
    assert len(shard.search(asked, np.array([best[0] * 1.01]))[0]) == 0
    assert set(shard.search(asked, np.array([best[9]]))[1]) >= set(ids[found >= best[9]])


def test_passages_match_brute_force(spark):
    rng = random.Random(2)
    passage = [rng.choice(WORDS) for _ in range(60)]
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(80, 200)))) for i in range(30)]
    for i in (3, 8, 20):
        own = texts[i][1].split()
        at = rng.randrange(len(own))
        texts[i] = (i, "\n".join([" ".join(own[:at]), " ".join(passage) + " " + " ".join(own[at:])]))
    texts += [(40, None), (41, ""), (42, "short text"), (43, texts[5][1]), (None, texts[5][1]), (44, "again " * 500)]
    got = repeated_passages(table(spark, texts)).collect()
    assert {r["doc_id"] for r in got} == {3, 8, 20, 5, 43}
    assert {r["doc_id"] for r in got if r["kept"]} == {3, 5}
    for r in got:
        if r["doc_id"] in (3, 8, 20):
            own = tokens(dict(texts)[r["doc_id"]])
            assert sum(w in passage for w in own[r["start"] : r["start"] + r["n_words"]]) >= r["n_words"] - 8
    assert repeated_passages(table(spark, [])).count() == 0


def test_language_model_counts_and_beats_the_base(spark):
    rng = random.Random(6)
    spell = lambda: "".join(rng.choice(["an", "ber", "ge", "lich", "zu", "ung"]) for _ in range(rng.randint(1, 4)))
    texts = [(i, " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else spell() for _ in range(rng.randint(0, 200)))) for i in range(80)]
    texts += [(100, None), (101, ""), (102, "  \n"), (103, "The THE"), (103, "The THE")]
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = score_texts(table(spark, texts), learn).collect()
    assert len(got) == len(texts)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    own = [(i, [*tokens(t), None]) for i, t in texts]
    counts = collections.Counter(w for i, ws in own if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in own)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    base, score = (sum(r[c] for r in got if held(r["doc_id"])) for c in ("base_score", "score"))
    assert base < score < 0
    again = {r["doc_id"]: r["score"] for r in score_texts(table(spark, texts, 5), learn).collect()}
    assert all(math.isclose(again[r["doc_id"]], r["score"], rel_tol=0.02, abs_tol=0.2) for r in got)
    assert score_texts(table(spark, []), learn).count() == 0


def test_tables_follow_their_exact_conditional():
    """Against all ways to seat four customers of a dish, one after another."""
    d, s, others, above = 0.4, 1.0, 3.0, 0.2
    weight = collections.Counter()

    def sit(n, t, w, sizes):
        if n == 4:
            weight[t] += w
            return
        sit(n + 1, t + 1, w * (s + d * (others + t)) * above, (*sizes, 1))
        for k, size in enumerate(sizes):
            sit(n + 1, t, w * (size - d), (*sizes[:k], size + 1, *sizes[k + 1 :]))

    sit(0, 0, 1.0, ())
    total = sum(weight.values())
    got = reseat(np.full(200_000, 4), np.full(200_000, others), np.full(200_000, above), d, Hierarchy(strength=s), np.random.default_rng(3))
    for t in range(1, 5):
        assert abs((got == t).mean() - weight[t] / total) < 0.005
    assert math.isclose(math.exp(stirling(4, d)[4, 4]), 1.0) and math.isclose(math.exp(stirling(3, d)[3, 1]), (1 - d) * (2 - d))


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    words, contexts = 6, 5  # every context has a cell for every word, some never seen
    v, u, w = (x.ravel() for x in np.meshgrid(np.arange(contexts), np.arange(4), np.arange(words), indexing="ij"))
    pair, ctx1 = v * words + w, np.repeat(np.arange(contexts), words)
    cells = {"count": rng.poisson(0.8, len(w)), "pair": pair, "ctx2": v * 4 + u, "ctx1": ctx1}
    below = np.tile(rng.dirichlet(np.ones(words)), contexts)
    for place in (Restaurants(cells, (0.6, 0.5), Hierarchy(words=2), rng),):
        assert np.allclose(np.bincount(cells["ctx2"], weights=place.averaged(below)), 1)
        one, _ = place.chances(below)
        assert np.allclose(np.bincount(ctx1, weights=one), 1)
        assert (place.t2 <= cells["count"]).all() and ((place.t2 > 0) == (cells["count"] > 0)).all()
    own = np.arange(len(pair) // 4)
    short = {"count": rng.poisson(1.5, len(own)), "pair": own, "ctx2": own, "ctx1": ctx1}
    assert np.allclose(np.bincount(ctx1, weights=Restaurants(short, (0.6, 0.5), Hierarchy(), rng).averaged(below)), 1)


@pytest.mark.parametrize("words", [1, 2])
def test_word_order_matters(spark, words):
    rng = random.Random(6)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}

    def walk():
        out = [rng.choice(WORDS)]
        while len(out) < 60:
            out.append(rng.choice(follow[out[-1]]))
        return out

    texts = [walk() for _ in range(400)]
    mixed = [rng.sample(t, len(t)) for t in texts[:50]]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *mixed])]
    got = {r["doc_id"]: r for r in score_texts(table(spark, rows), F.col("doc_id").between(50, 399), Hierarchy(words=words)).collect()}
    for i in range(50):  # neither was learned from
        assert math.isclose(got[i]["base_score"], got[400 + i]["base_score"], rel_tol=1e-9)
        assert got[i]["score"] > got[400 + i]["score"] + 20
    nothing = score_texts(table(spark, rows[:3]), F.lit(False), Hierarchy(words=words)).collect()
    assert [(r["n_known"], r["train_tokens"], round(r["score"], 9)) for r in nothing] == [(0, 0, 0.0)] * 3


def test_seating_follows_the_restaurant():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 5, 5, 10_000, 10_000])
    new = np.array([1, 1, 1e-9, 1e9, 1.0, 1.0])
    tables = seat(counts, new, np.array([0.5, 0.5, 1e-9, 0.5, 0.5, 0.5]), 0.5, rng)
    assert tables[:4].tolist() == [0, 1, 1, 5] and 20 < tables[4] < 2000


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(80)), "en", "src0", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "src1", 1), (101, None, None, None, None), (102, "", "de", "src1", 0), (103, f"start {ITEM} end", "en", "src1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    import tempfile

    folder = tempfile.mkdtemp()
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {r[0] for r in rows} - {100, 103}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_hashes_are_stable():
    from archipel.llm.minhash import shingle_sets

    own = shingle_sets(pa.array(["a b c", "A  b\nC", "", None]), 2)
    assert (own[0] == own[1]).all() and len(own[0]) == 2 and not len(own[2]) and not len(own[3])
    assert hashlib.sha256(own[0].tobytes()).hexdigest() == hashlib.sha256(own[1].tobytes()).hexdigest()
