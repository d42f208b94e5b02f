"""Language identification by error-correcting output codes over hashed letter n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

#: Hash bins of the features.
BINS = 4096
#: Rows that are fitted at most (twice that, if the sampling hash is unlucky).
MAX_TRAIN_ROWS = 4000
#: Characters that are turned into features at once.
CHARS = 1 << 20
#: A best score that leads the second one by less is flagged as ambiguous.
MARGIN = 0.05
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """For the code points below 65,536: the code point where it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], dtype=np.uint32)


def _codes(text: str, letters: np.ndarray) -> np.ndarray:
    """The code points of a lower-cased text, a space for each that is no letter."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if (far := c > 0xFFFF).any():
        c = c.copy()
        c[far] = [x if chr(x).isalpha() else 32 for x in c[far]]
    return np.where(c > 0xFFFF, c, letters[np.minimum(c, 0xFFFF)])


def _counts(codes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams that hold a letter and lie in one row; codes of a row start and end with a space."""
    out = np.zeros(rows * BINS, dtype=np.int64)
    h, filled = np.zeros(len(codes), dtype=np.uint32), np.zeros(len(codes), dtype=bool)
    for n in range(min(3, len(codes))):
        m = len(codes) - n
        h, filled = h[:m] + codes[n:] * MULTIPLIERS[n], filled[:m] | (codes[n:] != 32)
        own = filled & (row[:m] == row[n:])
        mixed = h[own] * np.uint32(0x27D4EB2F) + np.uint32(n)
        out += np.bincount(row[:m][own] * BINS + ((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(8)) % BINS, minlength=rows * BINS)
    return out.reshape(rows, BINS)


def features(texts: list[str | None], letters: np.ndarray) -> Iterator[np.ndarray]:
    """Row by row in order: a block of count vectors of whole texts; a text longer than CHARS is counted piece by piece."""
    block: list[np.ndarray] = []
    held = 0

    def counted() -> np.ndarray:
        return _counts(np.concatenate(block), np.repeat(np.arange(len(block)), [len(x) for x in block]), len(block))

    edge = np.full(1, 32, dtype=np.uint32)
    for text in texts:
        text = (text or "").lower()  # before it is cut: that can change its length
        if len(text) > CHARS:
            if block:
                yield counted()
                block, held = [], 0
            total = np.zeros((1, BINS), dtype=np.int64)
            for i in range(0, len(text), CHARS):  # n-grams across a border count with the piece in which they start
                c, last = _codes(text[i : i + CHARS + 2], letters), i + CHARS >= len(text)
                if i + CHARS + 2 > len(text):
                    c = np.concatenate((c, edge))
                own = CHARS
                if i == 0:
                    c, own = np.concatenate((edge, c)), own + 1
                c = c if last else c[: own + 2]
                total += _counts(c, np.zeros(len(c), dtype=np.int64), 1)
                if not last:
                    tail = c[own:]
                    total -= _counts(tail, np.zeros(len(tail), dtype=np.int64), 1)
            yield total
            continue
        block.append(np.concatenate((edge, _codes(text, letters), edge)))
        held += len(text)
        if held >= CHARS:
            yield counted()
            block, held = [], 0
    if block:
        yield counted()


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True)))


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1. Up to five languages get all splits of them, more get the random code with the largest least distance."""
    if k <= 5:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 if i == 0 or (b + 1) >> (i - 1) & 1 == 0 else -1 for b in range(bits)] for i in range(k)])
    rng, best, apart = np.random.default_rng(k), None, -1
    bits = math.ceil(10 * math.log2(k))
    for _ in range(200):
        code = rng.choice([-1, 1], size=(k, bits))
        code = code[:, abs(code.sum(axis=0)) < k]
        d = (code.shape[1] - code @ code.T) / 2 + np.eye(k) * bits
        if d.min() > apart:
            best, apart = code, d.min()
    return best


class Model:
    """langs, codewords, one linear classifier for each bit, and each bit's weight for each language."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray, steps: int = 300, l2: float = 1e-5):
        self.langs, self.code = langs, codewords(len(langs))
        self.w, self.b = np.zeros((x.shape[1], self.code.shape[1]), dtype=np.float32), np.zeros(self.code.shape[1], dtype=np.float32)
        self.trust = np.full(self.code.shape, 1 / self.code.shape[1])
        if len(langs) < 2:
            return
        goal = self.code[y].astype(np.float32)
        share = (1 / np.bincount(y, minlength=len(langs)))[y][:, None].astype(np.float32)
        share /= share.sum()
        w, b, rate = self.w.copy(), self.b.copy(), np.float32(20.0)
        for step in range(steps):  # Nesterov's accelerated descent on the logistic loss
            e = -goal / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30))) * share
            new_w, new_b = w - rate * (x.T @ e + l2 * w), b - e.sum(axis=0)
            pull = np.float32(step / (step + 3))
            w, b, self.w, self.b = new_w + pull * (new_w - self.w), new_b + pull * (new_b - self.b), new_w, new_b
        right = goal * (x @ self.w + self.b) > 0
        hits = np.array([right[y == i].mean(axis=0) for i in range(len(langs))]) + 1e-6
        self.trust = hits / hits.sum(axis=1, keepdims=True)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword under weighted logistic loss, its score and its lead over the second one."""
        z = x @ self.w + self.b
        loss = np.stack([(np.logaddexp(0, -self.code[i] * z) * self.trust[i]).sum(axis=1) for i in range(len(self.langs))], axis=1)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        return loss.argmin(axis=1), top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def train(docs: DataFrame, usable: Column, max_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """Fit on a sample of the rows with a language for which `usable` holds: about max_rows in all, as many of each language.

    Only the sample's feature vectors come to the driver (8 KB a row, and max_rows is a bound that does not grow with the table). None if there is nothing to learn from.
    """
    base = docs.where(usable & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    take = None
    for lang, n in sorted(counts.items()):
        top = int(min(1.0, max_rows / len(counts) / n) * (2**31))
        one = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("train")), 33) < F.lit(top)
        take = F.when(F.col("lang") == lang, one) if take is None else take.when(F.col("lang") == lang, one)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            rows = np.concatenate([scaled(c).astype(np.float16) for c in features(batch.column(1).to_pylist(), letters)] or [np.zeros((0, BINS), np.float16)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "x"])

    rows = base.where(take).select("lang", "text").limit(2 * max_rows).mapInArrow(vectors, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16).astype(np.float32) for r in rows])
    return Model(langs, x, np.array([langs.index(r["lang"]) for r in rows]))


def identify(docs: DataFrame, model: Model | None, margin: float = MARGIN, names: Sequence[str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Add lang_pred, score and ambiguous (under these names) to docs by their whole texts; other columns stay, those of the same names are replaced.

    lang_pred is a learned language, or `und` with score 0 where text is null or has no letter, or nothing was learned.
    score is the share of the nearest codeword among all under the weighted loss; ambiguous: it leads the second by less than margin.
    """
    docs = docs.select(*[c for c in docs.columns if c not in names])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            langs, scores, unclear = [], [], []
            for counts in features(batch.column(batch.schema.get_field_index("text")).to_pylist(), letters):
                blank = counts.sum(axis=1) == 0
                if model is None:
                    best, score, lead = np.zeros(len(counts), dtype=int), np.zeros(len(counts)), np.zeros(len(counts))
                else:
                    best, score, lead = model.decode(scaled(counts))
                none = blank | (model is None)
                langs += [UNDETERMINED if n else model.langs[i] for i, n in zip(best, none, strict=True)]
                scores.append(np.where(none, 0.0, score))
                unclear.append(none | (lead < margin))
            new = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]), pa.float64()), pa.array(np.concatenate(unclear or [np.zeros(0, bool)]), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    kind = StructType([*docs.schema, *(StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), BooleanType()), strict=True))])
    return docs.mapInArrow(predicted, kind)
