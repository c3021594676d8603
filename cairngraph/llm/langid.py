"""Language ID in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are hashed counts of 1 to 4 letter runs of the whole lower-cased text, damped and
scaled to unit length.  Families are separated by one machine each against the rest; the
languages of a family by a machine per pair, which vote.

Training reads a bounded sample: about ``per_language`` texts of each language, those with
the smallest hashes of their ids, so that it doesn't depend on the order of rows.  No language
is left out.

Defined results: ``und`` with score 0 for null text, text without a letter, and whenever
nothing was learned; rows without a language train nothing; equal texts get equal results;
an empty table gives no rows; only key and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .scratch import small_batches

UNKNOWN = "und"
DIMENSIONS = 8192
#: Texts of one language, and of all, that training reads; each takes 32 KB on the driver, and its packed vector.
PER_LANGUAGE, SAMPLE_ROWS = 400, 10_000
# Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "indic": ("hi", "bn", "mr", "ne", "gu", "pa"),
    "semitic": ("ar", "he", "mt"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
_LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def family_of(language: str) -> str:
    """The family of a code; a code that no family lists is a family of its own."""
    return _FAMILY_OF.get(language.lower(), language)


def vector(text: str | None) -> np.ndarray | None:
    """Feature vector of a text, or None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # what isn't a letter above ASCII punctuation and digits counts as one sign, so that records and tables don't speak
    points = np.where(((points < 97) | (points > 122)) & (points < 192), np.uint64(32), points)
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    counts = np.zeros(DIMENSIONS, np.float32)
    shift, run = np.uint64(64 - 13), points * _FACTORS[0]
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            if n > len(points):
                break
            if n > 1:
                run = run[: len(points) - n + 1] * _FACTORS[1] + points[n - 1 :] * _FACTORS[n - 1]
            hashed = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            counts += np.bincount((hashed >> shift).astype(np.int64), minlength=DIMENSIONS)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def fit_machine(x: np.ndarray, sign: np.ndarray, penalty: float = 1e-4, rounds: int = 100) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by accelerated gradient steps; both sides weigh the same."""
    sign = sign.astype(np.float32)
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    # single precision throughout: a double operand would copy the matrix at every step
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    v, v_bias, t, step = w.copy(), 0.0, 1.0, np.float32(1 / (2 * 2.0 + penalty))
    for _ in range(rounds):
        pull = 2 * share * sign * np.maximum(0, 1 - sign * (x @ v + np.float32(v_bias)))
        after, after_bias = v + step * (pull @ x - np.float32(penalty) * v), v_bias + float(step) * float(pull.sum())
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pace = np.float32((t - 1) / t_next)
        v, v_bias = after + pace * (after - w), after_bias + float(pace) * (after_bias - bias)
        w, bias, t = after, after_bias, t_next
    return np.append(w, np.float32(bias))


@dataclass
class Model:
    """Machines of the families and of the pairs of languages within each."""

    languages: dict[str, list[str]] = field(default_factory=dict)  #: of each family
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pairs: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    pair_weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, languages: list[str]) -> Model:
        model, y = cls(), np.array(languages, object)
        for code in sorted(set(languages)):
            model.languages.setdefault(family_of(code), []).append(code)
        model.families = sorted(model.languages)
        own = np.array([family_of(c) for c in languages], object)
        if len(model.families) > 1:
            model.family_weights = np.array([fit_machine(x, np.where(own == f, 1.0, -1.0)) for f in model.families])
        for f, codes in model.languages.items():
            model.pairs[f] = list(combinations(range(len(codes)), 2))
            machines = []
            for i, j in model.pairs[f]:
                rows = (y == codes[i]) | (y == codes[j])
                machines.append(fit_machine(x[rows], np.where(y[rows] == codes[i], 1.0, -1.0)))
            if machines:
                model.pair_weights[f] = np.array(machines)
        return model

    def predict(self, v: np.ndarray | None) -> tuple[str, float]:
        if v is None or not self.families:
            return UNKNOWN, 0.0
        v = np.append(v, np.float32(1))
        best, sure = 0, 1.0
        if self.family_weights is not None:
            margins = self.family_weights @ v
            best = int(np.argmax(margins))
            second = float(np.partition(margins, -2)[-2])
            sure = _likely(float(margins[best]) - second)
        f = self.families[best]
        codes = self.languages[f]
        if len(codes) == 1:
            return codes[0], sure
        votes, sums = np.zeros(len(codes)), np.zeros(len(codes))
        margins = self.pair_weights[f] @ v
        for (i, j), m in zip(self.pairs[f], margins, strict=True):
            votes[i if m > 0 else j] += 1
            sums[i] += m
            sums[j] -= m
        won = max(range(len(codes)), key=lambda k: (votes[k], sums[k], -k))
        least = min((m if i == won else -m) for (i, j), m in zip(self.pairs[f], margins, strict=True) if won in (i, j))
        return codes[won], sure * _likely(2 * float(least))


def _likely(margin: float) -> float:
    return float(1 / (1 + np.exp(-2.5 * margin)))


def train(rows: DataFrame, text: str, language: str, order: Column, per_language: int = PER_LANGUAGE, most: int = SAMPLE_ROWS) -> Model:
    """Fits on about ``per_language`` texts of every language (those of the least ``order`` hash), fewer of each if all languages would have more than ``most``."""
    small_batches(rows.sparkSession)
    rows = rows.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(language).alias("language"), F.pmod(F.xxhash64(order), F.lit(1 << 30)).alias("place"))
    counts = rows.groupBy("language").count().collect()  # a row per language
    if not counts:
        return Model()
    each = max(1, min(per_language, most // len(counts)))
    cuts = rows.sparkSession.createDataFrame([(r["language"], int(min(1.0, each / r["count"]) * (1 << 30))) for r in counts], "language string, cut long")
    # equal texts count once, so that rows repeated without end stay one row
    picked = rows.join(F.broadcast(cuts), "language").where("place < cut").select("text", "language").distinct()

    def run(batches):
        for batch in batches:
            names, data = [], []
            for text, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                v = vector(text.as_py())
                if v is not None:
                    names.append(name), data.append(zlib.compress(v.astype(np.float16).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], ["language", "v"])

    found = picked.mapInArrow(run, "language string, v binary").collect()
    if not found:
        return Model()
    # unpacked one at a time, here and below; the order doesn't depend on that of the rows
    found.sort(key=lambda r: (r["language"], hashlib.sha256(zlib.decompress(r["v"])).digest()))
    x = np.empty((len(found), DIMENSIONS), np.float32)
    for to, r in zip(x, found, strict=True):
        to[:] = np.frombuffer(zlib.decompress(r["v"]), np.float16)
    return Model.fit(x, [r["language"] for r in found])


def identify(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """key, lang_pred and score of every row."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few weights per language and dimension, whatever the data

    def run(batches):
        held = shared.value
        for batch in batches:
            found = [held.predict(vector(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [key, "lang_pred", "score"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, lang_pred string, score double")


def tag(df: DataFrame, text: str, model: Model) -> DataFrame:
    """row (a struct of all columns of df, whatever their names), and the predicted language and its score; only the text goes to the workers."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<language:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        held = shared.value
        found = [held.predict(vector(x.as_py())) for x in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["language", "score"])

    rows = df.select(F.struct("*").alias("row"), predicted.asNondeterministic()(F.col(text)).alias("found"))  # once a row, wherever it is used
    return rows.select("row", "found.language", "found.score")
