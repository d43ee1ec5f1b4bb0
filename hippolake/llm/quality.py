"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else in the corpus is unlabelled text of
both kinds. A small network is fitted by minimising the non-negative unbiased risk
    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])
with the logistic loss; when the second part falls below zero only its own gradient is followed
back up. The class prior is estimated from positives and unlabelled rows alone (estimated_prior);
rows labelled bad are never looked at.

Features are shares and means over the whole text: classes of bytes, repetition, word shapes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hippolake.llm.text import WORD_HASHES

#: At most so many rows of each kind are fitted on, the first by a hash of their id.
FIT_POSITIVES, FIT_UNLABELLED = 10_000, 20_000
#: Prior that is assumed where there is nothing to estimate it from, and to begin with.
DEFAULT_PRIOR = 0.7
#: Words of a text are counted in stretches of so many bytes.
STRETCH = 1 << 20
WINDOW = 64

_CLASSES = np.zeros(256, np.int64)  # 0: other
for _name, _members in enumerate((b" ", b"\n", b"\t\r\v\f", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"'\"()-", b"#$%&*+=@^~", b"<>/\\|_`{}[]", bytes(range(128, 192)), bytes(range(192, 256))), 1):
    _CLASSES[list(_members)] = _name
N_CLASSES = 14
N_FEATURES = N_CLASSES + 9


def _stretches(data: bytes) -> Iterator[bytes]:
    """data cut at blanks into stretches of about STRETCH bytes."""
    at = 0
    while at < len(data):
        end = min(len(data), at + STRETCH)
        while end < len(data) and data[end] not in b" \t\n\r\v\f":
            end += 1
        yield data[at:end]
        at = end


def features(text: str | None) -> np.ndarray:
    """A row of N_FEATURES numbers; an empty text has zeros."""
    out = np.zeros(N_FEATURES)
    data = text.encode("utf-8", "surrogatepass") if text else b""
    counts = np.zeros(N_CLASSES)
    words = chars = same = again = capital = marked = one = 0
    last = None
    for part in _stretches(data):
        counts += np.bincount(_CLASSES[np.frombuffer(part, np.uint8)], minlength=N_CLASSES)
        found = part.split()
        if not found:
            continue
        h = WORD_HASHES.of(found)
        same += int((h[1:] == h[:-1]).sum()) + (last == h[0])
        last = h[-1]
        whole = len(h) // WINDOW * WINDOW
        for block in (h[:whole].reshape(-1, WINDOW), h[whole:].reshape(1, -1)):
            ordered = np.sort(block, axis=1)
            again += int((ordered[:, 1:] == ordered[:, :-1]).sum())
        flat = np.frombuffer(b" " + part + b" ", np.uint8)
        blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
        begins = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:])
        first, final = flat[begins], flat[ends]
        capital += int(((first >= 65) & (first <= 90) & (ends > begins) & (flat[np.minimum(begins + 1, ends)] >= 65) & (flat[np.minimum(begins + 1, ends)] <= 90)).sum())
        kind = _CLASSES[final]
        marked += int(((kind == 8) | (kind >= 10) & (kind <= 11)).sum())
        one += int((begins == ends).sum())
        words += len(found)
        chars += len(part)
    if words:
        out[:N_CLASSES] = np.sqrt(counts / len(data))
        out[N_CLASSES:] = (np.log1p(words) / 10, np.sqrt(same / words), again / words, np.sqrt(capital / words), np.sqrt(marked / words), np.sqrt(one / words), min(chars / words, 50) / 10, same / words, 1.0 if words < 20 else 0.0)
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, *, hidden: int = 16, steps: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Model:
    """Minimise the non-negative PU risk by Adam over all given rows."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positives, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (positives - mean) / scale, (unlabelled - mean) / scale
    params = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]

    def forward(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.tanh(x @ params[0] + params[1])
        return inner, inner @ params[2] + params[3][0]

    def back(x: np.ndarray, inner: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        through = slope[:, None] * params[2] * (1 - inner * inner)
        return [x.T @ through, through.sum(0), inner.T @ slope, np.array([slope.sum()])]

    for t in range(1, steps + 1):
        (hp, fp), (hu, fu) = forward(p), forward(u)
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # Slopes of the logistic loss: l(f) has s - 1, l(-f) has s.
        if negative >= 0:
            slope_p, slope_u = prior * ((sp - 1) - sp) / len(p), su / len(u)
        else:
            slope_p, slope_u = prior * sp / len(p), -su / len(u)
        grads = [a + b + decay * w for a, b, w in zip(back(p, hp, slope_p), back(u, hu, slope_u), params, strict=True)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior)


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray, *, risk: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, by the best bin of a held-out half.

    A model fitted on one half of the rows scores the other. In any top part of the scores the
    unlabelled rows' share is at least the prior times the positives' share; where that part holds
    positives only, it is equal. So their ratio is taken at the part that makes its upper confidence
    bound least. The halves change places and the two ratios are averaged.
    """
    if len(positives) < 8 or len(unlabelled) < 8:
        return DEFAULT_PRIOR
    ratios = []
    for here in (0, 1):
        model = fit(positives[here::2], unlabelled[here::2], DEFAULT_PRIOR, steps=200)
        p, u = np.sort(model.raw(positives[1 - here :: 2])), np.sort(model.raw(unlabelled[1 - here :: 2]))
        above_p = (len(p) - np.searchsorted(p, p, "left")) / len(p)
        above_u = (len(u) - np.searchsorted(u, p, "left")) / len(u)
        slack = sum(np.sqrt(np.log(4 / risk) / (2 * n)) for n in (len(p), len(u)))
        best = int(np.argmin((above_u + slack) / above_p))
        ratios.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(ratios), 0.05, 0.95))


def remainder(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5; rows of remainder 0 are held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column("text")]
        flat = np.concatenate(rows) if rows else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * N_FEATURES, pa.int32()), pa.array(flat))], ["positive", "x"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_positives: int = FIT_POSITIVES, fit_unlabelled: int = FIT_UNLABELLED) -> Model:
    """Fit on the rows that aren't held out.

    Positives: labelled 1 (a document labelled both ways is none). Unlabelled: all documents, with no
    regard to their labels. Of each about fit_* rows at most, chosen by a hash of id and text, are fitted
    on: each row's own hash decides, so no task gathers them, and their number is that bound but for a
    few in a hundred. Rows repeated with id and text count once among the chosen. Without positives or documents the model scores all alike.
    """
    trusted = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").alias("known_id")).agg(F.min("quality").alias("quality")).filter("quality = 1")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    good_rows = rows.join(trusted, F.col("doc_id") == F.col("known_id"), "left_semi")
    steps = 1 << 20

    def chosen(among: DataFrame, seed: int, most: int) -> DataFrame:
        """About `most` rows at most: each (id, text) by its own hash, and once, however often it is repeated."""
        n = among.count()
        share = steps if n <= most else int(steps * 0.95 * most / n)
        own = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed))
        return among.filter(F.pmod(own, F.lit(steps)) < share).dropDuplicates(["doc_id", "text"]).select("text", F.lit(seed == 1).alias("positive"))

    either = chosen(good_rows, 1, fit_positives).unionByName(chosen(rows, 2, fit_unlabelled))
    got = either.mapInArrow(_feature_rows, "positive boolean, x array<double>").toArrow()
    flag = got.column("positive").to_numpy()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    if not flag.any() or flag.all():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(DEFAULT_PRIOR / (1 - DEFAULT_PRIOR))), DEFAULT_PRIOR)
    # The same model however the rows arrive; shuffled, as halves are taken.
    order = np.random.default_rng(5).permutation(np.lexsort(x.T)) if len(x) else np.empty(0, int)
    x, flag = x[order], flag[order]
    return fit(x[flag], x[~flag], estimated_prior(x[flag], x[~flag]))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1, higher: better)[, row]; one row per row of docs, from the text alone.

    Null and empty texts get the score of a text without words. Texts of any length are read whole, a
    stretch at a time. Repeated rows are scored each for itself; an empty table gives no rows. Other columns are not read unless named in `keep`; those come back in the struct `row`.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        x = np.stack([features(t.as_py()) for t in texts]) if len(texts) else np.empty((0, N_FEATURES))
        return pa.array(model.score(x))

    return rows.withColumn("score", scored("text"))
