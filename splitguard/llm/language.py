"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitguard.storage import materialize

# --- fixed values: families of common languages by their codes; any other code is a family of its own ---
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
}
UNKNOWN = "und"

DIM = 4096
SAMPLE = 2000  # texts per language, about, that the models are fitted on
CHUNK = 1 << 20  # code points handled together; longer texts add up their counts
_LETTERS = 0x10000


class Model(NamedTuple):
    """What prediction needs: families with weights, and per family its languages and pairs with weights."""

    families: list[str]
    family_weights: np.ndarray  # (families, DIM + 1)
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]  # (first, second, weights); positive means first


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang.lower() in codes), lang)


class _Features:
    def __init__(self):
        self.letter = np.array([chr(c).isalpha() for c in range(_LETTERS)])

    def __call__(self, text: str | None) -> np.ndarray | None:
        """Square roots of the shares of hashed two- and three-letter runs of the whole text; None without letters."""
        counts, text, seen = np.zeros(DIM), (text or ""), False
        for at in range(0, len(text), CHUNK):
            codes = np.frombuffer(text[max(0, at - 2) : at + CHUNK].lower().encode("utf-32-le", "replace"), dtype="<u4")
            letter = np.where(codes < _LETTERS, self.letter[np.minimum(codes, _LETTERS - 1)], codes >= _LETTERS)
            # Emoji and other symbols beyond the first plane count as letters only if they are some.
            if (codes >= _LETTERS).any():
                letter = np.array([chr(c).isalpha() for c in codes.tolist()])
            if not letter.any():
                continue
            seen = True
            flat = np.where(letter, codes, 32)
            gap = flat == 32
            flat = flat[~(gap & np.append(False, gap[:-1]))].astype(np.uint64)
            flat = np.concatenate(([np.uint64(32)], flat, [np.uint64(32)]))
            two = flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
            three = two[:-1] + flat[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(1)
            for h in (two, three):
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                counts += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=DIM)
        return np.sqrt(counts / counts.sum()) if seen else None


def _learnable(id_col: str, lang_col: str) -> Column:
    return F.col(lang_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit the models on about ``sample`` texts per language; None if there is nothing to learn from.

    Only rows with a language are used, and of those only rows whose crc32(id as text) mod 4 is not 2; the
    others are held out. A row is in the sample if a hash of its id and text falls below the share of its
    language that makes up ``sample`` rows, so the bound holds up to chance and no row order matters.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(_learnable("doc_id", "lang") & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(None).cast("double")
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / sizes[lang]))).otherwise(share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Features()
        for batch in batches:
            found = [(n, own(t)) for n, t in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            found = [(n, x) for n, x in found if x is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.int32()), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))], names=["lang", "x"]
            )

    code = F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1
    drawn = rows.filter(draw < share).select("text", code.alias("lang"))
    stored = materialize(drawn.mapInArrow(features, "lang int, x array<float>"), "language_sample")
    vectors = stored.select("lang", array_to_vector(F.col("x").cast("array<double>")).alias("features")).persist()
    families = sorted({family_of(x) for x in langs})
    of_lang = [families.index(family_of(x)) for x in langs]
    labelled = vectors.withColumn("label", F.get(F.lit(of_lang), F.col("lang")).cast("double"))
    weights = np.zeros((len(families), DIM + 1))
    if len(families) > 1:
        fitted = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, standardization=False).fit(labelled)
        weights = np.column_stack([fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()])
    members = {f: [x for x in langs if family_of(x) == f] for f in families}
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = {}
    for family, own in members.items():
        pairs[family] = []
        for i, j in combinations(range(len(own)), 2):
            first, second = langs.index(own[i]), langs.index(own[j])
            both = vectors.filter(F.col("lang").isin(first, second)).withColumn("label", (F.col("lang") == first).cast("double"))
            svm = LinearSVC(maxIter=40, regParam=1e-4, standardization=False).fit(both)
            pairs[family].append((i, j, np.append(svm.coefficients.toArray(), svm.intercept)))
    vectors.unpersist()
    return Model(families, weights, members, pairs)


def predict(model: Model, x: np.ndarray) -> tuple[str, float]:
    """The likeliest language of a feature vector and a score from 0 to 1."""
    x = np.append(x, 1.0)
    z = model.family_weights @ x
    share = np.exp(z - z.max())
    share /= share.sum()
    at = int(share.argmax())
    family = model.families[at]
    languages = model.languages[family]
    votes, margins, certain = np.zeros(len(languages)), np.zeros(len(languages)), np.ones(len(languages))
    for i, j, weights in model.pairs[family]:
        margin = float(weights @ x)
        win = i if margin >= 0 else j
        votes[win] += 1
        margins[i] += margin
        margins[j] -= margin
        # A margin of one is the edge of the SVM's band and counts as all but certain.
        sure = 1 / (1 + np.exp(-3 * margin))
        certain[i], certain[j] = min(certain[i], sure), min(certain[j], 1 - sure)
    best = max(range(len(languages)), key=lambda i: (votes[i], margins[i], -i))
    return languages[best], float(share[at] * certain[best])


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, model: Model | None = None
) -> DataFrame:
    """Per row of ``docs``: row (a struct of all its columns), held_out, lang_pred, score; texts are not shuffled.

    ``lang_pred`` is ``und`` with score 0 for a text that is NULL or has no letter, and for every text if
    there is nothing to learn from. Language and id are never inputs of a prediction, and the whole text
    is. A NULL id is neither held out nor learned from. An empty table gives no rows.
    """
    model = model or fit(docs, id_col, text_col, lang_col, sample)
    source = docs.select(
        _held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.struct(*docs.columns).alias("row")
    )
    return _predicted(source, model)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predictions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, model: Model | None = None
) -> DataFrame:
    """Like ``languages``, but only doc_id, held_out, lang_pred and score."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = model or fit(slim, sample=sample)
    source = slim.select(_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), F.struct("doc_id").alias("row"))
    return _predicted(source, model).select("row.doc_id", "held_out", "lang_pred", "score")


def _predicted(source: DataFrame, model: Model | None) -> DataFrame:
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType(
        [source.schema["row"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Features()
        for batch in batches:
            named, scores = [], []
            for text in batch.column(1).to_pylist():
                x = own(text) if model else None
                lang, score = (UNKNOWN, 0.0) if x is None else predict(model, x)
                named.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array(named, pa.string()), pa.array(scores, pa.float64())],
                names=["row", "held_out", "lang_pred", "score"],
            )

    return source.mapInArrow(run, schema)
