"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; everything but letters becomes one space. All runs of 1, 2 and 3 characters are hashed to
`DIM` features; weights are log(1 + tf) * idf, scaled to length 1. Document frequencies come from all learnable rows.
The weights are learned by follow-the-regularised-leader (FTRL-proximal, elastic net) on a sample, chosen by hash of the
id, and a temperature is fitted on a part of the sample that was not learned from. The sample has about `TRAIN_ROWS`
rows in all, dealt evenly among the languages, and at least one of each: every lang value with a learnable row can be
predicted (a language costs the driver 256 kB while it learns).

Learned from: text and lang of rows whose crc32(doc_id) mod 4 is not 2 and whose lang, text and doc_id are not null.
A prediction sees the text alone. Null texts and texts without letters are `und` with score 0. Very long texts are
read whole, piece by piece. Repeated rows get equal answers; of languages with equal shares the more frequent one is
predicted, then the first by name. A null doc_id is never learned from and counts as not held out. Without a learnable
row, or in an empty table, nothing is learned and texts with letters are `und`, too. Extra columns are ignored by
`language_id` and passed by `with_language`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session

DIM_BITS = 14
DIM = 1 << DIM_BITS
#: Bound of the sample that the classifier is fitted on: rows of all languages together.
TRAIN_ROWS = 2400
#: Tasks that sum what the scanning tasks have counted.
SUM_TASKS = 32
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.01
PIECE = 1 << 19
UND = "und"
#: A document passes the pipeline's stage if its score is so many times what chance would give it, and never needs more.
CHANCE, MOST_NEEDED = 1.2, 0.9


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


_LETTER = None


def ngrams(text: str) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of a text with letters; empty for others."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    keep, out = _letters()[raw], []
    if not keep.any():
        return np.empty(0, np.int32)
    codes = np.where(keep, raw, np.uint32(32))
    codes = codes[keep | np.concatenate(([True], keep[:-1]))]
    for at in range(0, len(codes), PIECE):
        # a piece sees two characters more, so that every n-gram is made once
        piece = codes[at : at + PIECE + 2].astype(np.uint64)
        one = piece * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:]
        three = two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[2:]
        # the salt keeps 1-, 2- and 3-grams apart; the product spreads what the sums have gathered
        for grams, salt in ((one[:PIECE][piece[:PIECE] != 32], 1), (two[:PIECE], 2), (three[:PIECE], 3)):
            out.append(((grams ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - DIM_BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _frequencies(batches):
    """One row for each task: in how many documents each feature is, and last the number of documents."""
    total = np.zeros(DIM + 1, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = ngrams(text)
            if len(found):
                total[np.unique(found)] += 1
                total[DIM] += 1
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["docs"])


def _summed(batches):
    total = np.zeros(DIM + 1, np.int64)
    for batch in batches:
        for row in batch.column(0):
            total += np.frombuffer(row.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["docs"])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each feature is, and last the number of texts with letters: summed by task, then in `SUM_TASKS` tasks."""
    found = texts.mapInArrow(_frequencies, "docs binary").repartition(SUM_TASKS).mapInArrow(_summed, "docs binary")
    return sum((np.frombuffer(r[0], np.int64) for r in found.collect()), np.zeros(DIM + 1, np.int64))


def _counted(batches):
    for batch in batches:
        features, counts = [], []
        for text in batch.column(2).to_pylist():
            f, c = np.unique(ngrams(text), return_counts=True)
            features.append(f.astype("<u2").tobytes()), counts.append(c.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.binary()), pa.array(counts, pa.binary())], ["pick", "lang", "features", "counts"])


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # DIM x langs, the idf multiplied in
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        tf = np.log1p(counts)
        norm = np.sqrt(np.sum((tf * self.idf[features]) ** 2)) or 1.0
        return (tf / norm) @ self.weights[features] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngrams(text or "")
        if not len(found) or not self.langs:
            return UND, 0.0
        counts = np.bincount(found, minlength=DIM)
        features = np.flatnonzero(counts)
        p = softmax(self.logits(features, counts[features]) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after some epochs of FTRL-proximal with an elastic net over (features, values, class)."""
    z, n = np.zeros((DIM + 1, langs)), np.zeros((DIM + 1, langs))

    def weights(f):
        w = -(z[f] - np.sign(z[f]) * L1) / ((BETA + np.sqrt(n[f])) / ALPHA + L2)
        return np.where(np.abs(z[f]) <= L1, 0.0, w)

    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            features, values, y = rows[k]
            f, x = np.append(features, DIM), np.append(values, 1.0)
            w = weights(f)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 80))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Document frequencies from all learnable rows; the classifier from a bounded sample of them."""
    session(docs)
    own = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    draw = F.pmod(F.xxhash64("doc_id", F.lit("pick")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = own.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return Model([], np.zeros((DIM, 0)), np.zeros(0), np.zeros(DIM))
    names = [r.lang for r in counts]
    # which part of a language's rows is drawn; the row that comes first always is
    shares = [max(most / len(counts) / r.n, r.least + 2.0**-31) for r in counts]
    # from Arrow it is a local table of known size, which Spark broadcasts if it is small
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": names, "share": shares}))
    rows = own.join(shares, "lang").select((draw / F.col("share")).alias("pick"), "lang", "text").where("pick < 1")
    rows = rows.mapInArrow(_counted, "pick double, lang string, features binary, counts binary").orderBy("pick", "lang", "features").limit(2 * max(most, len(names))).collect()
    found = document_frequencies(own.select("text"))
    idf = np.log((1 + max(1, found[DIM])) / (1 + found[:DIM])) + 1
    number = {x: k for k, x in enumerate(names)}
    data = [(np.frombuffer(f, "<u2").astype(np.int64), np.frombuffer(c, "<i4"), number[lang]) for _, lang, f, c in rows if f]
    scaled = []
    for f, c, y in data:
        v = np.log1p(c) * idf[f]
        scaled.append((f, v / np.sqrt(np.sum(v * v)), y))
    # every fourth row of a language checks, its first ones learn
    nth, learn, check = dict.fromkeys(range(len(names)), 0), [], []
    for x in scaled:
        nth[x[2]] += 1
        (learn if nth[x[2]] % 4 else check).append(x)
    weights, bias = ftrl(learn, len(names))
    model = Model(names, weights * idf[:, None], bias, idf)
    if len(check) > 1:
        z = np.stack([v @ weights[f] + bias for f, v, _ in check])
        model.temperature = temperature(z, np.array([y for *_, y in check]))
    model.weights = model.weights.astype(np.float32)
    return model


def _predictor(model: Model):
    def run(batches):
        for batch in batches:
            got = [model.predict(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    session(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_predictor(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Trains on the learnable rows of docs and predicts every row."""
    return predict(docs, train(docs))


def least_score(langs: int) -> float:
    """What a prediction among so many languages needs to be surer than chance."""
    return min(MOST_NEEDED, CHANCE / max(1, langs))


def _keeper(model: Model, at: int, least: float):
    def run(batches):
        for batch in batches:
            keep = [lang != UND and score >= least for lang, score in map(model.predict, batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def with_language(docs: DataFrame, least: float | None = None) -> DataFrame:
    """The rows of docs whose text has a language: a prediction with at least this score, by default `least_score`."""
    model = train(docs)
    session(docs)
    least = least_score(len(model.langs)) if least is None else least
    # numbered columns on the way through Python: names may hold dots
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return rows.mapInArrow(_keeper(model, docs.columns.index("text"), least), rows.schema).toDF(*docs.columns)
