"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives and all text is unlabelled; confirmed
clean texts are no examples, they count in the class prior only. With class
prior p the risk of a classifier is
``p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices_by_bytes, texts_of
from .shingles import _BYTE, _LOWER, _power, mixed

BITS = 18
PREFIXES = (4, 5, 6)
_SLICE = 1 << 20
_APART = np.ones(256, bool)
for _a, _b in ("09", "AZ", "az"):
    _APART[ord(_a) : ord(_b) + 1] = False
_APART[128:] = False


def features(data: np.ndarray, offsets: np.ndarray):
    """(text number, its distinct hashed features): words and their prefixes of 4, 5 and 6 bytes."""
    for a, b in slices_by_bytes(offsets, _SLICE):
        part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if not len(part):
            for i in range(a, b):
                yield i, np.empty(0, np.uint32)
            continue
        inside = ~_APART[part]
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = local[1:-1]
        edges = edges[(edges > 0) & (edges < len(part))]
        begins[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[part]] * _power("up", len(part))[: len(part)], out=run[1:])
        down = _power("down", len(part))[first]
        before = np.searchsorted(first, local)
        keep = np.uint64(64 - BITS)
        words = (mixed((run[last] - run[first]) * down, 21) >> keep).astype(np.uint32)
        heads = []
        for n in PREFIXES:
            long = last - first >= n
            value = (mixed((run[np.minimum(first + n, len(part))] - run[first]) * down, 21 + n) >> keep).astype(np.uint32)
            heads.append((long, value))
        for i in range(b - a):
            s = slice(before[i], before[i + 1])
            yield a + i, np.unique(np.concatenate([words[s], *[v[s][ok[s]] for ok, v in heads]]))


#: Score from which a text counts as toxic.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        return float(_sigmoid(np.float64(self.weights[found].sum(dtype=np.float64) + self.bias)))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Training:
    """``positives`` bounds the toxic documents that the fit takes, ``unlabelled`` is how many others it expects; nothing else depends on them.

    A feature enters the fit where a share ``support`` of the positives has it
    and its count there is ``screen`` standard deviations above what its share
    of the unlabelled texts gives, or as far under it. Without that, labels
    that are wrong teach the words of single texts. ``steps`` is the least
    number of steps, for small samples; ``gamma`` is the published factor of
    the steps that undo a negative risk.
    """

    positives: int = 6000
    unlabelled: int = 20000
    support: float = 0.01
    least: int = 3
    screen: float = 2.0
    epochs: int = 40
    steps: int = 300
    batch: int = 1500
    rate: float = 0.08
    shrink: float = 1e-3
    beta: float = 0.0
    gamma: float = 1.0
    seed: int = 5


def screened(in_positive: np.ndarray, positives: int, in_unlabelled: np.ndarray, unlabelled: int, how: Training = Training()) -> np.ndarray:
    """The features to learn from, given how many texts of each kind have each feature."""
    share = in_unlabelled / max(1, unlabelled)
    z = (in_positive - positives * share) / np.sqrt(positives * share * (1 - share) + 1e-9)
    often = (in_positive >= max(how.least, how.support * positives)) & (z >= how.screen)
    rarely = (in_unlabelled >= how.least) & (z <= -how.screen)
    return np.flatnonzero(often | rarely)


def slopes(margin: np.ndarray, n_p: int, prior: float, how: Training) -> np.ndarray:
    """Derivatives by each row's margin, positives first, of what a step goes down.

    That is the risk, prior times the positives' loss as positive and the
    corrected negative risk, or where the latter is under ``-beta`` its
    negative times ``gamma``.
    """
    n_u = len(margin) - n_p
    chance = _sigmoid(margin)
    # logistic losses: l(+) = log(1 + e^-m), l(-) = log(1 + e^m)
    lost = np.logaddexp(0, margin)
    negative_risk = lost[n_p:].mean() - prior * lost[:n_p].mean()
    slope = np.empty(len(margin))
    if negative_risk >= -how.beta:
        slope[:n_p] = prior * (chance[:n_p] - 1) / n_p - prior * chance[:n_p] / n_p
        slope[n_p:] = chance[n_p:] / n_u
    else:
        slope[:n_p] = how.gamma * prior * chance[:n_p] / n_p
        slope[n_p:] = -how.gamma * chance[n_p:] / n_u
    return slope


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, how: Training = Training()) -> Model:
    """A linear classifier on feature presence under the non-negative risk, by AdaGrad.

    The weights are the mean over the second half of the epochs, as the two
    kinds of step alternate once the negative risk is near 0. Where a batch's
    corrected negative risk is under ``-beta`` the step goes up that part
    instead, as published. Without positives, or without unlabelled text, the
    model is the prior alone.
    """
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.zeros(1 << BITS, np.float32), bias)
    names, flat = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    cuts = np.cumsum([len(x) for x in (*positive, *unlabelled)])[:-1]
    rows = np.split(flat, cuts)
    positive, unlabelled = rows[: len(positive)], rows[len(positive) :]
    n = len(names)
    rng = np.random.default_rng(how.seed)
    weights, squares, bias_square = np.zeros(n), np.full(n, 1e-3), 1e-3
    n_batches = max(1, -(-len(unlabelled) // how.batch))
    epochs = max(how.epochs, -(-how.steps // n_batches))
    mean_weights, mean_bias, n_mean = np.zeros(n), 0.0, 0
    for epoch in range(epochs):
        u_parts = np.array_split(rng.permutation(len(unlabelled)), n_batches)
        p_parts = np.array_split(rng.permutation(np.resize(np.arange(len(positive)), max(len(positive), n_batches))), n_batches)
        for p_rows, u_rows in zip(p_parts, u_parts, strict=True):
            rows = [positive[i] for i in p_rows] + [unlabelled[i] for i in u_rows]
            n_p = len(p_rows)
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.concatenate(rows)
            owner = np.repeat(np.arange(len(rows)), sizes)
            margin = np.bincount(owner, weights[flat], len(rows)) + bias
            slope = slopes(margin, n_p, prior, how)
            step = np.bincount(flat, slope[owner], n) + how.shrink * weights
            squares += step * step
            weights -= how.rate * step / np.sqrt(squares)
            tilt = slope.sum()
            bias_square += tilt * tilt
            bias -= how.rate * tilt / np.sqrt(bias_square)
        if 2 * epoch >= epochs:
            mean_weights += weights
            mean_bias += bias
            n_mean += 1
    out = np.zeros(1 << BITS, np.float32)
    out[names] = mean_weights / n_mean
    return Model(out, mean_bias / n_mean)


def held_out(doc_id: str | Column) -> Column:
    """Rows whose labels are never learned from. A row without an id is not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, toxic: DataFrame, how: Training) -> DataFrame:
    """``h, toxic, unlabelled, found``: the texts to learn from as features, one row for equal doc_id and text."""
    texts = docs.select("doc_id", "text").where("doc_id is not null").where(~held_out("doc_id")).withColumn("h", F.xxhash64("doc_id", "text", F.lit(17)))
    ids = toxic.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").select("doc_id", F.lit(True).alias("toxic")).limit(how.positives)
    share = min(1.0, how.unlabelled / max(1, texts.count()))
    within = F.lit(True) if share == 1.0 else F.col("h") < F.lit(int(share * 2.0**64 - 2.0**63))
    marked = texts.join(F.broadcast(ids), "doc_id", "left")  # at most how.positives ids
    taken = marked.select("text", "h", F.coalesce("toxic", F.lit(False)).alias("toxic"), within.alias("unlabelled")).where("toxic or unlabelled")

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            found = [f.tobytes() for _, f in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], names=["h", "toxic", "unlabelled", "found"])

    return taken.mapInArrow(run, "h long, toxic boolean, unlabelled boolean, found binary").dropDuplicates(["h"])


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many positives and how many unlabelled texts have each feature; the driver gets 2**BITS rows at most."""

    def run(batches):
        both = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for found, *kinds in zip(batch.column(3), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                both[np.ix_(np.flatnonzero(kinds), np.frombuffer(found.as_buffer(), np.uint32))] += 1
        seen = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(both[0, seen]), pa.array(both[1, seen])], names=["feature", "p", "u"])

    table = sample.mapInArrow(run, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    out = np.zeros((2, 1 << BITS), np.int64)
    at = table.column("feature").to_numpy()
    out[0, at], out[1, at] = table.column("p").to_numpy(), table.column("u").to_numpy()
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Fit on bounded samples of rows that are not held out.

    The class prior is the toxic share of all usable labels, between 0.01 and
    0.9 (0.1 without labels); that share is all that clean labels give. Samples
    take the rows with the smallest hashes, so they do not depend on
    partitions: toxic ids by their order, unlabelled text by a bound on the
    hash that lets the wanted number through. Rows that agree in doc_id and
    text count once. Texts become features and features are counted where the
    texts are; one task, which holds the screened features of the sample, fits
    the weights, and only they reach the driver.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, toxic = usable.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(0.9, max(0.01, (toxic or 0) / n)) if n else 0.1
    sample = cut(_sample(docs, usable.where("toxic = 1"), how))
    positives, unlabelled = sample.agg(F.count_if("toxic"), F.count_if("unlabelled")).first()
    if not positives or not unlabelled:
        return fit([], [], prior, how)
    in_positive, in_unlabelled = _counts(sample)
    chosen = np.zeros(1 << BITS, bool)
    chosen[screened(in_positive, positives, in_unlabelled, unlabelled, how)] = True

    def few(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(3)]
            yield batch.set_column(3, "found", pa.array([x[chosen[x]].tobytes() for x in found], pa.binary()))

    def run(batches):
        kinds: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for batch in batches:
            for found, toxic, plain in zip(batch.column(3), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                values = np.frombuffer(found.as_py(), np.uint32)
                for kind, wanted in zip(kinds, (toxic, plain), strict=True):
                    if wanted:
                        kind.append(values)
        model = fit(*kinds, prior, how)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<u4").tobytes()]), pa.array([model.weights[at].tobytes()]), pa.array([model.bias])], names=["at", "weights", "bias"])

    one = sample.mapInArrow(few, sample.schema).repartition(1).sortWithinPartitions("h")
    row = one.mapInArrow(run, "at binary, weights binary, bias double").first()
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(row["at"], "<u4")] = np.frombuffer(row["weights"], np.float32)
    return Model(weights, row["bias"])


def scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``, the score of the whole text.

    Null and empty texts score as the model's bias alone. One narrow pass; a
    column called ``name`` is replaced.
    """
    kept = docs.drop(name)
    at = kept.columns.index("text")
    schema = kept.select("*", F.lit(0.0).alias(name)).schema

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(at))
            out = np.fromiter((model.score(found) for _, found in features(data, offsets)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, how: Training = Training()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null doc_ids are scored and not held out; repeated rows score alike; with
    an empty table or no toxic label the score is the prior's.
    """
    model = train(docs, labels, how)
    scored = scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
