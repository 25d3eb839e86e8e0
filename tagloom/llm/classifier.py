"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

A text becomes a fixed list of statistics (shares of character classes, word and
line figures).  Standardised statistics x become z(x) = sqrt(2/D) cos(Wx + b) with
normal W and uniform b, so z(x).z(y) approximates a Gaussian kernel.  Every
partition sums its normal equations, the partial sums are added block by block on
the executors, and one small system is solved.  Scores of labelled rows that the
fit has not seen are binned and made monotone by pooling adjacent violators; a
score between two pools is interpolated, so ranks survive.

Labels reach the fit through ids only; an id, source or language is never a
statistic.  Texts are scored where they are read, nothing but statistics is
shuffled.

Defined cases: a null text is the empty text, whose statistics are zero, and gets
a score like any other; null labels and labels without a document are ignored;
several labels of one id are averaged; without any label every score is 0.5, with
one class only every score is that class; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import staged

#: Random features, their seed, and the ridge penalty per labelled row.
FEATURES, SEED, PENALTY = 256, 17, 1e-4
#: Standardised statistics are cut here, so that one odd text cannot rule the fit.
CUT = 6.0
#: Width of the score bins that the calibration pools, over [-1, 2].
BIN = 1e-3
#: Rows of the normal equations summed in one group.
BLOCK = 64
#: Texts scored at once.
ROWS = 1000

# Classes of bytes whose shares are statistics.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "spaces": b" \t\x0b\x0c\r",
    "newlines": b"\n",
    "points": b".,;:",
    "calls": b"!?",
    "quotes": b"'\"()[]{}",
    "symbols": b"#*$%&",
    "bars": b"|<>/\\=+~^_`",
    "signs": b"-@",
    "wide": bytes(range(128, 256)),
}
_KIND = np.zeros((256, len(CLASSES)))
for _at, _bytes in enumerate(CLASSES.values()):
    _KIND[list(_bytes), _at] = 1.0

STATISTICS = (
    *CLASSES, "log_words", "word_length", "long_words", "capital_words", "distinct_words", "top_word",
    "twins", "log_lines", "line_words", "repeated_lines", "short_lines", "closed_lines",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of a text, in the order of STATISTICS."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    shares = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KIND / len(raw))
    lengths = np.fromiter(map(len, words), np.float64, n)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [line for line in raw.split(b"\n") if line.strip()]
    sizes = np.fromiter(map(len, lines), np.float64, len(lines))
    twins = sum(map(bytes.__eq__, words[1:], words))
    return [
        *shares.tolist(),
        np.log1p(n),
        lengths.mean(),
        float((lengths > 14).mean()),
        sum(map(bytes.istitle, words)) / n,
        len(count) / n**0.8,
        np.sqrt(max(count.values()) / n),
        np.sqrt(twins / n),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        float((sizes < 30).mean()),
        sum(line.rstrip()[-1:] in b".!?:\"'" for line in lines) / len(lines),
    ]


def text_statistics(text: Column | str) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        width = len(STATISTICS)
        values = pa.array(_statistics_of(texts).reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()), values)

    return run(text)


def _statistics_of(texts: pa.Array) -> np.ndarray:
    """A row for each text; one text at a time is a Python string."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, t in enumerate(texts):
        out[i] = statistics(t.as_py())
    return out


@dataclass(frozen=True)
class Model:
    """A fitted classifier: a few arrays whose sizes do not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant in front."""
        z = np.clip((x - self.mean) / self.scale, -CUT, CUT) @ self.weights + self.phase
        waves = np.cos(z) * np.sqrt(2.0 / len(self.phase))
        return np.concatenate([np.ones((len(x), 1)), waves], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.ridge, -1.0, 2.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, len(STATISTICS)))


def normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Sums of z z', z y and the row count over ``rows`` of (stats, y), as one matrix."""
    size = len(model.phase) + 1

    def partial(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            frame = batch.to_pandas()
            z = model.features(_matrix(frame["stats"]))
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ frame["y"].to_numpy()
        blocks = range(0, size, BLOCK)
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array(blocks, pa.int32()), "part": pa.array([total[b : b + BLOCK].tobytes() for b in blocks], pa.binary())}
        )

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for part in batch.column("part").to_pylist():
                total = total + np.frombuffer(part)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("stats", "y").mapInArrow(partial, "block int, part binary")
    summed = parts.groupBy("block").applyInArrow(add, "block int, part binary").collect()
    out = np.zeros((size, size + 1))
    for r in summed:
        block = np.frombuffer(r["part"]).reshape(-1, size + 1)
        out[r["block"] : r["block"] + len(block)] = block
    return out


def isotonic(scores: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising knots and their shares of hits."""
    pools: list[list[float]] = []
    for s, h, c in zip(scores, hits, counts):
        pools.append([s * c, h, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _labelled(stats: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    per_key = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.avg(label).alias("y"))
    return stats.join(per_key, key)


def fit(
    stats: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    label: str = "quality",
    fit_on: Column,
    calibrate_on: Column,
    features: int = FEATURES,
    penalty: float = PENALTY,
    seed: int = SEED,
) -> Model:
    """Fit on labelled rows of ``stats`` (key, stats).

    All labelled rows are used, in two disjoint sets over the key: one for the
    ridge regression and one for the calibration.
    """
    d = len(STATISTICS)
    rows = staged(_labelled(stats, labels, key, label).select("stats", "y", fit_on.alias("fits"), calibrate_on.alias("tunes")), "labelled")
    train = rows.where("fits")
    picks = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    sums = train.agg(F.count("*").alias("n"), *picks).first()
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([sums[f"s{i}"] or 0.0 for i in range(d)])
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(d, features)) / np.sqrt(d)
    phase = rng.uniform(0, 2 * np.pi, features)
    start = Model(mean, np.where(scale > 1e-9, scale, 1.0), weights, phase, np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))
    if not sums["n"]:
        return start
    sums_of = normal_equations(train, start)
    penalties = np.full(features + 1, max(penalty * sums["n"], 1e-6))
    penalties[0] = 0.0
    ridge = np.linalg.solve(sums_of[:, :-1] + np.diag(penalties), sums_of[:, -1])
    fitted = Model(start.mean, start.scale, weights, phase, ridge, start.knots, start.values)

    @F.pandas_udf("double")
    def raw(column: pd.Series) -> pd.Series:
        return pd.Series(fitted.raw(_matrix(column)))

    binned = rows.where("tunes").select(F.round(raw("stats") / BIN).cast("int").alias("bin"), "y")
    pools = binned.groupBy("bin").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).orderBy("bin").collect()
    if not pools:  # too few labels for a calibration set: scores are cut to [0, 1]
        return Model(fitted.mean, fitted.scale, weights, phase, ridge, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, values = isotonic(*(np.array([float(r[c]) for r in pools]) for c in ("bin", "hits", "n")))
    return Model(fitted.mean, fitted.scale, weights, phase, ridge, knots * BIN, values)


def score(text: Column | str, model: Model) -> Column:
    """The calibrated score of a text."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, model))

    return run(text)


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The scores of texts, whose random features are held for ROWS texts at once."""
    out = np.zeros(len(texts))
    for at in range(0, len(texts), ROWS):
        out[at : at + ROWS] = model.score(_statistics_of(texts.slice(at, ROWS)))
    return out


def fold(key: str = "doc_id") -> Column:
    """A row's fold: CRC-32 of the key as text, modulo 4.  Fold 2 is held out."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))


def fit_documents(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on folds 0 and 1, calibrate on fold 3; labels of fold 2 are not read."""
    learnable = labels.where(fold(key) != 2)
    wanted = docs.where(fold(key) != 2).select(key, text_statistics(text).alias("stats"))
    return fit(wanted, learnable, key=key, label=label, fit_on=fold(key) < 2, calibrate_on=fold(key) == 3)
