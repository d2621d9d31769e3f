"""Language identification by hierarchical discrimination.

The languages found in the training rows are grouped into families by the likeness of their n-gram profiles.
Linear support vector machines (squared hinge, trained in numpy on a bounded sample) first choose the family,
one against the rest; within it, one-versus-one machines separate the languages that are alike and vote.
Features are shares of hashed byte n-grams, so a margin is a mean of weights over the whole text: one gather
and one segmented sum, of no more memory than a slice of the column.

A text longer than a slice is read in pieces that overlap by what an n-gram needs, so every n-gram counts once.
A part of the sample is held back from training: ``floor`` is a score that next to all of its rows reach.

Defined results: a null text or one without a letter is ``und`` with score 0; everything else gets a learned
language, and a score from 0 to 1 (the family's times the closest duel's certainty).  Without training rows every
text is ``und``.  Equal texts get equal results; an empty table gives no rows; columns of the input are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from . import textvec as tv
from .storage import in_one_task, read, small_batches

DIMENSIONS, GRAMS = 1 << 13, (2, 3, 4)
#: At most about so many training rows of a language, and of all; languages that are learnt at most, the most frequent.
#: The sample, MOST_ROWS * DIMENSIONS * 4 bytes at most, meets in one task; the driver gets the model.
PER_LANGUAGE, MOST_ROWS, MOST_LANGUAGES = 400, 4000, 200
#: Of the held-back rows, the share that may lie below the floor, before a margin is taken off it.
_BELOW, _MARGIN = 0.0, 0.7
_STEEP = 4.0


def grams(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """For each n the bucket of the n-gram that starts at each byte; those that leave their text get DIMENSIONS."""
    b = np.where(tv.NO_LETTER[buf] | ((buf >= 48) & (buf <= 57)), np.uint8(32), tv.fold(buf)).astype(np.uint64)
    end = np.repeat(off[1:], np.diff(off))
    place = np.arange(len(b))
    h = np.zeros(len(b), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = max(0, len(b) - n + 1)
        h[:m] = h[:m] * np.uint64(257) + b[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            x = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)
            x[place + n > end] = DIMENSIONS
            yield x.astype(np.int64)


def long_grams(buf: np.ndarray) -> Iterator[np.ndarray]:
    """As grams, of one text, piece by piece: a piece sees the byte before it and those its last n-grams reach into."""
    for a in range(0, len(buf), tv.PIECE):
        lead = min(a, 1)
        part = buf[a - lead : a + tv.PIECE + max(GRAMS) - 1]
        for x in grams(part, np.array([0, len(part)])):
            yield x[lead : lead + tv.PIECE]


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter, a slice of texts at a time."""
    out = np.zeros(len(off) - 1, bool)
    for i, j in tv.slices(off):
        out[i:j] = _letters(buf[off[i] : off[j]], off[i : j + 1] - off[i])
    return out


def _letters(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    low = buf | 0x20
    seen = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (buf < 128))])
    found = seen[off[1:]] > seen[off[:-1]]
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros((len(off) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full], axis=0)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]]
    duels: list[tuple[int, int]]  #: pairs of languages of one family, in the order of the last weights
    weights: np.ndarray  #: DIMENSIONS + 1 x (families + duels); the last row, for no n-gram, is 0
    bias: np.ndarray
    floor: float = 0.0  #: a score that next to all texts of the learnt languages reach

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, score) of each text."""
        n, k = len(off) - 1, len(self.families)
        best, score = np.full(n, -1, np.int64), np.zeros(n)
        if not self.languages or not n:
            return best, score
        margin, count = np.zeros((n, self.weights.shape[1]), np.float64), np.zeros(n)
        for i, j in tv.slices(off):
            o, part = off[i : j + 1] - off[i], buf[off[i] : off[j]]
            if len(part) <= tv.PIECE:
                for x in grams(part, o):
                    margin[i:j] += _sums(self.weights[x], o)
                    count[i:j] += _sums((x < DIMENSIONS).astype(np.int64), o)
            else:
                for x in long_grams(part):
                    margin[i] += self.weights[x].sum(axis=0, dtype=np.float64)
                    count[i] += (x < DIMENSIONS).sum()
        best, score = self.decide(margin / np.maximum(count, 1)[:, None] + self.bias)
        none = ~has_letter(buf, off)
        best[none], score[none] = -1, 0
        return best, score

    def decide(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) from the machines' margins."""
        n, k = len(margin), len(self.families)
        sure = lambda m: 1 / (1 + np.exp(-np.clip(_STEEP * m, -500, 500)))
        family = margin[:, :k].argmax(axis=1) if k > 1 else np.zeros(n, np.int64)
        certain = sure(margin[:, :k].max(axis=1)) if k > 1 else np.ones(n)
        votes, close = np.full((n, len(self.languages)), -1.0), np.full((n, len(self.languages)), np.inf)
        for f, members in enumerate(self.families):
            votes[np.ix_(family == f, members)] = 0
        for d, (p, q) in enumerate(self.duels):
            m = margin[:, k + d]
            votes[:, p] += m > 0
            votes[:, q] += m <= 0
            votes[:, p] += np.tanh(m) * 1e-3
            votes[:, q] -= np.tanh(m) * 1e-3
            close[:, p] = np.minimum(close[:, p], m)
            close[:, q] = np.minimum(close[:, q], -m)
        for f, members in enumerate(self.families):
            outside = [t for t in range(len(self.languages)) if t not in members]
            votes[np.ix_(family == f, outside)] = -np.inf
        best = votes.argmax(axis=1)
        return best, np.clip(certain * sure(close[np.arange(n), best]), 0, 1)

    def names(self, best: np.ndarray) -> np.ndarray:
        return np.array([*self.languages, "und"], dtype=object)[best]


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, both classes of equal weight."""
    side = np.where(y, 1.0, -1.0).astype(np.float32)
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (share * (x @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    rate = 1 / (2 * size + 2 + l2)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w, b
    for t in range(steps):
        m = t / (t + 3)
        zw, zb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - side * (x @ zw + zb)) * share * side
        pw, pb = w, b
        w = zw + rate * (2 * (x.T @ slack) - l2 * zw)
        b = zb + rate * 2 * float(slack.sum())
    return w, b


def _families(centres: np.ndarray) -> list[list[int]]:
    """Average-link clustering of the language profiles into about the square root of their number."""
    unit = centres / np.maximum(1e-12, np.linalg.norm(centres, axis=1, keepdims=True))
    groups, alike = [[i] for i in range(len(centres))], unit @ unit.T
    while len(groups) > max(1, round(len(centres) ** 0.5)):
        pairs = [(float(alike[np.ix_(g, h)].mean()), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        _, i, j = max(pairs)
        groups[-i] = sorted(groups[-i] + groups.pop(-j))
    return groups


def train(x: np.ndarray, names: list[str]) -> LanguageModel:
    """x: a row of n-gram shares for each training text; names: their languages."""
    languages = sorted(set(names))
    if not languages:
        return LanguageModel([], [], [], np.zeros((DIMENSIONS + 1, 0), np.float32), np.zeros(0))
    y = np.array([languages.index(n) for n in names])
    scale = 1 / np.maximum(np.float32(1e-4), np.sqrt(np.einsum("ij,ij->j", x, x) / np.float32(len(x))))
    families = _families(np.array([x[y == i].mean(axis=0) for i in range(len(languages))]) * np.sqrt(scale))
    duels = [(p, q) for f in families for i, p in enumerate(f) for q in f[i + 1 :]]
    z = x * (scale / np.sqrt(DIMENSIONS)).astype(np.float32)
    fitted = [_svm(z, np.isin(y, f)) for f in families]
    fitted += [_svm(z[(y == p) | (y == q)], y[(y == p) | (y == q)] == p) for p, q in duels]
    w = np.stack([f[0] for f in fitted], axis=1) * (scale / np.sqrt(DIMENSIONS))[:, None]
    return LanguageModel(languages, families, duels, np.vstack([w, np.zeros((1, w.shape[1]))]).astype(np.float32), np.array([f[1] for f in fitted]))


def _bounded(rows: DataFrame, by: Column, key: Column, per_value: int) -> DataFrame:
    """About ``per_value`` rows of each of the MOST_LANGUAGES most frequent values at random by hash, MOST_ROWS of all, from counts over all rows."""
    counts = rows.groupBy(by.alias("v")).count().orderBy(F.desc("count"), "v").limit(MOST_LANGUAGES).collect()
    most = min(per_value, MOST_ROWS // max(1, len(counts)))
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["v"], most / r["count"])]), by) if counts else F.lit(0.0)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(29), key), 12) / F.lit(float(1 << 52))
    return rows.where(place < share)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from a hash-random sample of the rows with a language and a letter; order of the rows does not matter."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = _bounded(rows, F.col("lang"), F.col("id"), per_language).select("text", "lang", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tv.text_buffers(batch.column(0))
            letter = has_letter(buf, off)
            out, where = [], []
            for i in np.flatnonzero(letter):
                count = np.zeros(DIMENSIONS, np.float64)
                for x in long_grams(buf[off[i] : off[i + 1]]):
                    count += np.bincount(x, minlength=DIMENSIONS + 1)[:DIMENSIONS]
                out.append((count / max(1.0, count.sum())).astype(np.float32).tobytes())
                where.append(i)
            yield pa.RecordBatch.from_pydict({"lang": batch.column(1).take(pa.array(where, pa.int64())), "id": batch.column(2).cast(pa.string()).take(pa.array(where, pa.int64())), "x": pa.array(out, pa.binary())})

    return in_one_task(rows.mapInArrow(run, "lang string, id string, x binary"), learn)


def learn(batches: list[pa.RecordBatch]) -> LanguageModel:
    """The model and its floor from lang, id and x (n-gram shares) of the training rows."""
    names, ids = ([v for b in batches for v in b.column(c).to_pylist()] for c in (0, 1))
    x = np.concatenate([np.zeros((0, DIMENSIONS), np.float32), *[np.frombuffer(tv.text_buffers(b.column(2))[0], np.float32).reshape(-1, DIMENSIONS) for b in batches]])
    batches.clear()  # half of what the task holds
    order = sorted(range(len(names)), key=lambda i: (names[i], ids[i], x[i].tobytes()))
    x, names, ids = x[order], np.array([names[i] for i in order], dtype=object), [ids[i] for i in order]
    # every fifth row of a language, in the order of its hash, tells the floor
    held = np.zeros(len(names), bool)
    for name in dict.fromkeys(names.tolist()):
        own = np.flatnonzero(names == name)
        held[own[np.argsort([zlib.crc32(ids[i].encode()) for i in own], kind="stable")][4::5]] = True
    model = train(x[~held], names[~held].tolist())
    if held.any() and model.languages:
        best, score = model.decide(x[held].astype(np.float64) @ model.weights[:-1].astype(np.float64) + model.bias)
        right = score[model.names(best) == names[held]]
        model.floor = _MARGIN * float(np.sort(right)[int(_BELOW * len(right))]) if len(right) else 0.0
    return model


def identify(df: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds the predicted language and its score to every row; of the input only the columns ``keep`` if it is given."""

    def work(buf: np.ndarray, off: np.ndarray) -> dict[str, pa.Array]:
        best, sure = model.predict(buf, off)
        return {lang: pa.array(model.names(best), pa.string()), score: pa.array(sure, pa.float64())}

    return by_slices(df, text, work, [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())], keep)


def by_slices(df: DataFrame, text: str, work, new: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """The columns that ``work`` makes of (bytes, offsets), added a few megabytes of text at a time."""
    small_batches(df.sparkSession)
    names = {f.name.lower() for f in new}
    old = [f for f in df.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            col = batch.column(batch.schema.get_field_index(text))
            rest = batch.select([f.name for f in old])
            _, off = tv.text_buffers(col)
            for i, j in tv.slices(off, 4 << 20):
                yield bpe.with_columns(rest.slice(i, j - i), work(*tv.text_buffers(col.slice(i, j - i))))

    return df.mapInArrow(run, T.StructType([*old, *new]))


def fold_of(n: int, doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % n


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learnt from the rows of crc32(doc_id) mod 4 other than 2."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(fold_of(4) != 2))
    return identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", F.coalesce(fold_of(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
