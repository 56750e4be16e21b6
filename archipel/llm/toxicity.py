"""Toxicity scores from subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archipel.llm.common import drop_written, tidied, tidy, written
from archipel.llm.minhash import mixed
from archipel.llm.token_memo import forget, ragged_take, text_slices

_EDGE = ".,;:!?|()[]{}\"'<>*_-"


@dataclass(frozen=True)
class Training:
    """How the classifier is fitted. `per_label` bounds the sample: so many whole texts of each label at most, by hash order of their ids."""

    per_label: int = 1500
    buckets: int = 1 << 20
    dim: int = 3
    grams: tuple[int, ...] = (3, 4, 5)
    rounds: int = 70
    rate: float = 0.5
    least_sure: float = 2.0  # an embedding begins at half its log-odds where its z is this, nearer to them above
    decay: float = 1e-5  # pulls embeddings to where they began
    seed: int = 11


#: Words whose n-grams are hashed at once, and subwords that training looks at at once: both bound what lies beside the results.
_WORDS, _SUBWORDS = 1 << 15, 1 << 19


def subwords(words: list[str], how: Training) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character n-grams of `<word>`, word by word end to end, and how many each word has (one at least)."""
    parts = [_subwords(words[lo : lo + _WORDS], how) for lo in range(0, max(1, len(words)), _WORDS)]
    return np.concatenate([b for b, _ in parts]), np.concatenate([n for _, n in parts])


def _subwords(words: list[str], how: Training) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w.strip(_EDGE).lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(marked)))
    found, of = [], []
    for n in how.grams:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = mixed(h + codes[k : k + len(h)])
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append(((h[inside] >> np.uint64(20)) % np.uint64(how.buckets)).astype(np.int32))
        of.append(owner[: len(h)][inside].astype(np.int32))
    bare = np.setdiff1d(np.arange(len(words)), of[0] if of else [])  # nothing but marks, or a single letter
    found.append(np.zeros(len(bare), np.int32))
    of.append(bare.astype(np.int32))
    del marked, codes, owner
    buckets, of = np.concatenate(found), np.concatenate(of)
    del found
    order = np.argsort(of, kind="stable")
    n_sub = np.bincount(of, minlength=len(words))
    del of
    return buckets[order], n_sub


def word_index(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each word of the texts its place among the distinct words; the distinct words; where each text begins (and the end)."""
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded = pc.list_flatten(cut).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(cut.offsets) - cut.offsets[0].as_py()


def _evidence(word_of: np.ndarray, entries: np.ndarray, buckets: np.ndarray, n_sub: np.ndarray, labels: np.ndarray, how: Training) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the log-odds of label 1 among the texts that hold it, and how sure it is (a two-proportion z)."""
    held = np.zeros((2, how.buckets))
    starts = np.cumsum(n_sub) - n_sub
    ends = np.cumsum(entries)
    for lo, hi, label in zip((ends - entries).tolist(), ends.tolist(), labels.tolist(), strict=True):
        own = word_of[lo:hi]
        held[label, np.unique(ragged_take(buckets, starts[own], n_sub[own]))] += 1
    n = np.bincount(labels, minlength=2)[:, None]
    odds = np.log((held + 0.5) / (n - held + 0.5))
    share = (held / n)[::-1]
    both = held.sum(axis=0) / n.sum()
    sure = (share[0] - share[1]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n).sum())
    return odds[1] - odds[0], sure


def fit(texts: list[str], labels: np.ndarray, how: Training = Training()) -> tuple[np.ndarray, float]:
    """The logit that each subword bucket adds to a text (averaged over its words), and the bias.

    A word is the mean of its subwords' embeddings, a text the mean of its words; a linear
    softmax reads the label from it. Embeddings begin at the log-odds of their subword,
    shrunk where these could be chance, and a decay keeps rare ones near there; then embeddings, weights and bias are trained
    together by Adam on the mean cross-entropy, both labels weighing the same. With one
    label only, the answer is that label for any text; without texts, every score is a half.
    """
    kinds = set(labels.tolist())
    if len(kinds) < 2:
        return np.zeros(how.buckets), 8.0 if 1 in kinds else -8.0 if kinds else 0.0
    index, words, begins = word_index(pa.array(texts))
    n_words, n_of, n_texts = np.maximum(1, np.diff(begins)), len(words), len(labels)
    own = [np.unique(index[lo:hi], return_counts=True) for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    entries = np.array([len(w) for w, _ in own])
    doc_of, word_of = np.repeat(np.arange(n_texts, dtype=np.int32), entries), np.concatenate([w for w, _ in own]).astype(np.int32)
    share = np.concatenate([n for _, n in own]) / n_words[doc_of]
    del own, index, texts
    buckets, n_sub = subwords(words, how)
    del words
    odds, sure = _evidence(word_of, entries, buckets, n_sub, labels, how)
    used = np.unique(buckets)
    place = np.zeros(how.buckets, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    slot = place[buckets]
    begin = odds[used] * sure[used] ** 2 / (sure[used] ** 2 + how.least_sure**2)
    del buckets, place, odds, sure
    tidy()
    first = np.cumsum(n_sub) - n_sub
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(slot), _SUBWORDS)), n_of)).tolist()
    blocks = [(slice(lo, hi), slice(int(first[lo]), int(first[hi - 1] + n_sub[hi - 1]))) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())[:, None]
    rng = np.random.default_rng(how.seed)
    noise = rng.normal(1, 0.1, how.dim)
    table = [begin * x for x in noise]  # a dimension at a time
    out, bias = np.column_stack([-np.ones(how.dim), np.ones(how.dim)]) / how.dim, np.zeros(2)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (*table, out, bias)]
    target = np.eye(2)[labels]

    def of_words(values: np.ndarray) -> np.ndarray:
        """The mean over each word's subwords."""
        return np.concatenate([np.add.reduceat(values[slot[subs]], first[own] - subs.start) for own, subs in blocks]) / n_sub

    def of_subwords(values: np.ndarray) -> np.ndarray:
        """The sum over each subword's words, of which each gives every subword its part."""
        total, part = np.zeros(len(used)), values / n_sub
        for own, subs in blocks:
            total += np.bincount(slot[subs], weights=np.repeat(part[own], n_sub[own]), minlength=len(used))
        return total

    def move(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, step: int) -> None:
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)

    for step in range(1, how.rounds + 1):
        means = np.column_stack([np.bincount(doc_of, weights=of_words(t)[word_of] * share, minlength=n_texts) for t in table])
        logits = means @ out + bias
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        wrong = (chance - target) * weight
        back = wrong @ out.T
        for d, t in enumerate(table):
            slope = of_subwords(np.bincount(word_of, weights=back[doc_of, d] * share, minlength=n_of))
            slope += how.decay * (t - begin * noise[d])
            move(t, slope, *moments[d], step)
        move(out, means.T @ wrong, *moments[-2], step)
        move(bias, wrong.sum(axis=0), *moments[-1], step)
    weights = np.zeros(how.buckets)
    for t, x in zip(table, out[:, 1] - out[:, 0], strict=True):
        weights[used] += t * x
    return weights, float(bias[1] - bias[0])


def scores(texts: pa.Array, weights: np.ndarray, bias: float, how: Training) -> np.ndarray:
    """The chance of label 1 for each whole text; a blank text gets that of the bias alone."""
    index, words, begins = word_index(texts)
    if not words:
        return np.zeros(0)
    buckets, n_sub = subwords(words, how)
    each = np.add.reduceat(weights[buckets], np.cumsum(n_sub) - n_sub) / n_sub
    sums = np.append(0, np.cumsum(each[index]))
    n = np.diff(begins)
    logit = (sums[begins[1:]] - sums[begins[:-1]]) / np.maximum(1, n) + bias
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def sample(docs: DataFrame, labels: DataFrame, how: Training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label) of at most `how.per_label` ids of each label, in hash order of the ids; ids alone reach the driver.

    Labels are read where they are 0 or 1; an id labelled both ways is left out. Of an id's
    several texts the least is taken, so the sample is bounded however often an id repeats.
    """
    spark = docs.sparkSession
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = hi")
    picked = []
    for kind in (0, 1):
        picked += [(r["id"], kind) for r in one.where(F.col("lo") == kind).orderBy(F.xxhash64("id"), "id").limit(how.per_label).select("id").collect()]
    chosen = spark.createDataFrame(picked, "id long, label int")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def train(rows: DataFrame, how: Training) -> tuple[np.ndarray, float]:
    """Fits the sample `rows` in one task, whose row is the model: the driver holds no texts."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = sorted({row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "label")), strict=True)})
        texts, labels = [r[1] for r in held], np.array([r[2] for r in held], dtype=np.int64)
        del held
        weights, bias = fit(texts, labels, how)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([weights[at].astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["at", "weights", "bias"])
        del texts, weights, at
        tidy()

    model = written(rows.select("id", "text", "label").repartition(1).mapInArrow(learn, "at binary, weights binary, bias double"), "toxicity-model")
    row = model.first()
    drop_written(model)
    weights = np.zeros(how.buckets, dtype=np.float32)
    if row is None:  # no rows, no task
        return weights, 0.0
    weights[np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["weights"], "<f4")
    return weights, row["bias"]


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with columns score and predicted added (replacing columns of these names).

    Fitted on the labelled rows of `learn` (`docs` by default); scores come from the text
    alone. Scoring is a map over whole texts, of any length, without a shuffle; the model is
    a table of `how.buckets` numbers whatever the corpus. Null and blank texts get the
    bias's score. Every row is scored by itself, also where ids repeat or are null; equal
    texts get equal scores, and a score of exactly a half counts as label 1. Other columns
    pass through. An empty table gives an empty result; without labels every score is a half.
    """
    weights, bias = train(sample(learn if learn is not None else docs, labels, how, id_col, text_col), how)
    base = docs.drop("score", "predicted")
    at = base.columns.index(text_col)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            forget()
            for part in text_slices(batch, at):
                own = scores(part.column(at), model.value, bias, how)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own), pa.array((own >= 0.5).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(score, schema)
