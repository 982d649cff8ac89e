"""Language of a text by error-correcting output codes.

Every language has a codeword; one linear classifier on hashed byte n-grams predicts each bit.
Decoding weighs each bit's loss by how well its classifier does on the sample, takes the nearest
codeword and flags a text whose second codeword is almost as near, by the gaps of held-out texts.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWEST, Rows, id_and_text, texts

UNKNOWN = "und"
#: Share of correctly told held-out texts whose gap lies below the band of ambiguity.
BAND_QUANTILE = 0.01
#: Fewer held-out texts than this below the quantile do not place it by one of them: it is smoothed over resamples.
LEAST_BELOW = 3
#: The band where no held-out text is told, so that there is no gap to measure.
PLAIN_BAND = 0.02
ASCII_LETTER = re.compile(rb"[A-Za-z]").search
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\n\t\r", b"abcdefghijklmnopqrstuvwxyz             ")


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def ngram_counts(text: bytes, dims: int) -> np.ndarray:
    """Hashed counts of all two and three byte runs, root-scaled to length 1; half the places each."""
    b = np.frombuffer(b" " + text.translate(LOWER) + b" ", np.uint8).astype(np.uint32)
    half = dims // 2
    two = (b[:-1] * np.uint32(257) + b[1:]) * np.uint32(2654435761)
    three = (b[:-2] * np.uint32(66049) + b[1:-1] * np.uint32(257) + b[2:]) * np.uint32(2246822519)
    shift = np.uint32(32 - (half.bit_length() - 1))
    counts = np.concatenate((np.bincount(two >> shift, minlength=half), np.bincount(three >> shift, minlength=half)))
    root = np.sqrt(counts, dtype=np.float32)
    return root / np.float32(max(1.0, np.sqrt(len(b) * 2 - 3)))


def codewords(n: int) -> np.ndarray:
    """A +-1 row for each of n classes: every two-way split up to five classes, else seeded rows far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(200)]

    def apart(code):
        agree = code.astype(int) @ code.T
        return (bits - (agree - np.eye(n, dtype=int) * 2 * bits).max()) // 2 - 10 * bits * (abs(code.sum(0)) == n).any()

    return max(tries, key=apart)


@dataclass
class Model:
    labels: list[str]
    code: np.ndarray  # labels x bits
    weights: np.ndarray  # dims x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss
    dims: int
    band: float = PLAIN_BAND  # a gap below it is ambiguous

    def distances(self, features: np.ndarray) -> np.ndarray:
        """Loss-weighted distance to each codeword, a row a text."""
        margins = features @ self.weights + self.bias
        return (np.logaddexp(0, -4 * margins[:, None, :] * self.code) * self.trust).sum(2)

    def predict(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, score in 0 to 1, and gap to the second nearest codeword as a share of the bits."""
        d = self.distances(features)
        best = d.argmin(1)
        odds = np.exp(-(d - d.min(1, keepdims=True)))
        score = odds[np.arange(len(d)), best] / odds.sum(1)
        gap = (np.partition(d, 1, 1)[:, 1] - d.min(1)) / len(self.trust) if d.shape[1] > 1 else np.full(len(d), np.inf)
        return best, score, gap


def sample(docs: DataFrame, per_label: int, dims: int, label_col: str, learn: F.Column) -> tuple[list[str], np.ndarray]:
    """Labels and features of at most ``per_label`` documents of each label, by hash of the id."""
    named = docs.where(learn & F.col(label_col).isNotNull() & F.col("text").isNotNull()).select(
        F.col(label_col).alias("label"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64("text").alias("th"), "text"
    )
    pick = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "th")
    chosen = named.select("label", "id", "th").withColumn("n", F.row_number().over(pick)).where(F.col("n") <= per_label).drop("n").distinct()
    # per_label rows of each label at most, so small enough for every task
    some = named.join(F.broadcast(chosen), ["label", "id", "th"], "left_semi")
    some = some.groupBy("label", "id", "th").agg(F.first("text").alias("text")).select("label", "text")  # repeated rows count once
    schema = pa.schema([("label", pa.string()), ("features", pa.binary())])

    def run(batches):
        out = Rows(schema, 256)
        for label, text in texts(batches, key="label"):
            if has_letter(text):
                yield from out.add(label, ngram_counts(text, dims).astype("<f4").tobytes())
        yield from out.flush()

    found = sorted((r["label"], bytes(r["features"])) for r in some.mapInArrow(run, "label string, features binary").collect())
    return [r[0] for r in found], np.array([np.frombuffer(r[1], "<f4") for r in found], np.float32).reshape(len(found), dims)


def fit(labels: list[str], features: np.ndarray, dims: int, ridge: float = 0.05) -> Model:
    """One regularised least-squares classifier a bit, solved through the sample's inner products."""
    names = sorted(set(labels))
    code = codewords(len(names))
    if not names:
        return Model([], code, np.zeros((dims, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32), dims)
    goal = code[[names.index(x) for x in labels]].astype(np.float64)
    mean = features.mean(0)
    centred = (features - mean).astype(np.float64)
    balance = np.array([1 / labels.count(x) for x in names])[[names.index(x) for x in labels]] * len(labels) / len(names)
    bias = (goal * balance[:, None]).sum(0) / balance.sum()
    solved = np.linalg.solve(centred @ centred.T + ridge * np.diag(1 / balance), goal - bias)
    weights = centred.T @ solved
    right = (((centred @ weights + bias) * goal) > 0).mean(0)
    trust = np.maximum(right - 0.5, 0.01) * 2
    return Model(names, code, weights.astype(np.float32), (bias - mean @ weights).astype(np.float32), trust.astype(np.float32), dims)


def low_quantile(gaps: list[float], quantile: float) -> float:
    """The ``quantile`` by its lower neighbour, or with under ``LEAST_BELOW`` gaps below it the geometric mean of that over all resamples.

    Too few gaps for any to lie below the quantile: the least's share is taken to fall off in proportion down to 0.
    """
    n = len(gaps)
    if n * quantile >= LEAST_BELOW:
        return float(np.quantile(gaps, quantile, method="lower"))
    rank, share = int(quantile * (n - 1)) + 1, np.arange(n + 1) / n
    # chance that a resample has ``rank`` of its n draws among the i least gaps, for each i
    within = 1 - sum(comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(rank))
    logs = np.log(np.maximum(np.sort(np.array(gaps, np.float64)), np.finfo(np.float32).eps))
    return float(np.exp(np.diff(within) @ logs)) * min(1.0, quantile * (n + 1))


def band(labels: list[str], features: np.ndarray, dims: int, quantile: float = BAND_QUANTILE, folds: int = 4) -> float:
    """The ``quantile`` of the gaps of correctly told texts, each told by a fit without its fold of the sample."""
    seen, fold = Counter(), np.zeros(len(labels), int)
    for k, label in enumerate(labels):
        fold[k] = seen[label] % folds
        seen[label] += 1
    if len(seen) < 2:
        return PLAIN_BAND
    told = []
    for out in (fold == k for k in range(folds)):
        if out.any() and not out.all():
            model = fit([x for x, o in zip(labels, out, strict=True) if not o], features[~out], dims)
            best, _, gap = model.predict(features[out])
            right = np.array([model.labels[b] for b in best]) == np.array(labels)[out]
            told.extend(gap[right & np.isfinite(gap)])
    return low_quantile(told, quantile) if told else PLAIN_BAND


def train(docs: DataFrame, learn: F.Column, per_label: int = 400, most_labels: int = 200, dims: int = 4096, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """A model from rows where ``learn`` holds and text and label are there.

    The sample is at most ``per_label`` documents of each of at most ``most_labels`` labels (more
    labels are an error); whole texts are read.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("__label"))
    labels, features = sample(kept, per_label, dims, "__label", learn)
    if len(set(labels)) > most_labels:
        raise ValueError(f"over {most_labels} labels")
    model = fit(labels, features, dims)
    model.band = band(labels, features, dims)
    return model


def identify(docs: DataFrame, model: Model, unsure: float | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous, one row a row of the input.

    ``und`` with score 0 for a text that is null or has no letter, or if nothing was learned.
    ``ambiguous``: the second codeword is nearer than ``unsure`` (loss a bit; the model's band if not
    given) beyond the first.
    """
    unsure = model.band if unsure is None else unsure
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches):
        out, held, rows = Rows(schema), [], []

        def solve():
            best, score, gap = model.predict(np.array(held, np.float32)) if held else ((), (), ())
            told = iter(zip(best, score, gap, strict=True))
            for doc_id, known in rows:
                if known:
                    b, s, g = next(told)
                    yield from out.add(doc_id, model.labels[b], float(min(1.0, max(0.0, s))), bool(g < unsure))
                else:
                    yield from out.add(doc_id, UNKNOWN, 0.0, False)
            held.clear()
            rows.clear()

        for doc_id, text in texts(batches):
            known = bool(model.labels) and has_letter(text)
            if known:
                held.append(ngram_counts(text, model.dims))
            rows.append((doc_id, known))
            if len(rows) >= 256:
                yield from solve()
        yield from solve()
        yield from out.flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model, unsure: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is told: neither ``und`` nor ambiguous."""
    unsure = model.band if unsure is None else unsure

    def run(batches):
        for batch in batches:
            column, sure, held, places = batch.column(batch.schema.get_field_index(text_col)), np.zeros(batch.num_rows, bool), [], []
            for k in range(batch.num_rows):
                text = column[k].as_buffer()
                if text is not None and model.labels and has_letter(data := text.to_pybytes()):
                    held.append(ngram_counts(data, model.dims))
                    places.append(k)
                if len(held) == 256:
                    sure[places] = model.predict(np.array(held, np.float32))[2] >= unsure
                    held, places = [], []
            if held:
                sure[places] = model.predict(np.array(held, np.float32))[2] >= unsure
            yield batch.filter(pa.array(sure))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """A quarter of the documents, by checksum of the id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
