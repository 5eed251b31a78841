"""Quality scores by compression: zstandard dictionaries of good and bad text, difference of sizes, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import table

#: Bounds of the labelled sample: rows of each class for its dictionary, rows for the calibration, bytes of a row's
#: text (longer labelled rows are left out of the sample; scoring takes any length).
DICTIONARY_ROWS = 2000
CALIBRATION_ROWS = 4000
SAMPLE_TEXT_BYTES = 1 << 16
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
#: A text is measured in pieces of so many bytes, each against the dictionary alone, so that a long text's own
#: history doesn't drown the dictionaries.
PIECE = 1024
THRESHOLD = 0.3
FOLDS = 5


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train one, their bytes are the dictionary as they are."""
    pieces = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if content else zstandard.DICT_TYPE_RAWCONTENT
    held = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=kind)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def size_differences(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float]:
    """(bytes under bad - bytes under good), per byte of text and per compressed byte; above 0 reads like good text."""
    raw = (text or "").encode("utf-8", "replace")
    g = b = 0
    for piece in _pieces(raw):
        g += len(good.compress(piece))
        b += len(bad.compress(piece))
    return (b - g) / max(1, len(raw)), (b - g) / max(1, b + g)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first is the intercept."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str) -> pd.DataFrame:
    """The bounded labelled sample: text, label, part. Of rows that repeat an id, the one with the least hash counts, so ids bound rows."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_y")).distinct()
    ranked = known.withColumn("_h", F.xxhash64(F.lit("quality"), id_col))
    half = F.pmod(F.col("_h"), F.lit(2))
    picked = [ranked.filter((half == 0) & (F.col("_y") == y)).orderBy("_h", id_col).limit(DICTIONARY_ROWS) for y in (1, 0)]
    picked.append(ranked.filter(half == 1).orderBy("_h", id_col).limit(CALIBRATION_ROWS))
    ids = picked[0].unionByName(picked[1]).unionByName(picked[2])
    texts = docs.filter(F.octet_length(text_col) <= SAMPLE_TEXT_BYTES).select(F.col(id_col).alias("_id"), F.struct(F.xxhash64(text_col), F.col(text_col).alias("text")).alias("_t"))
    ids = ids.select(F.col(id_col).alias("_id"), F.col("_y").alias("label"), half.alias("part"), "_h")
    rows = texts.join(F.broadcast(ids), "_id").groupBy("_id", "label", "part", "_h").agg(F.min("_t").alias("_t"))
    got = rows.select("_t.text", "label", "part", "_h").toPandas()  # DICTIONARY_ROWS * 2 + CALIBRATION_ROWS rows at most
    return got.sort_values(["_h", "label", "text"])


def fit(docs: DataFrame, labels: DataFrame, text_col="text", id_col="doc_id", label_col="quality") -> dict:
    """The model: two dictionaries and the weights of the calibration, fitted on a bounded sample of labelled rows.

    Labels other than 0 and 1 and null ids are ignored. Without labelled text of both classes the dictionaries say
    nothing and every score is the share of good rows, smoothed (0.5 without any).
    """
    got = _sample(docs, labels, text_col, id_col, label_col)
    texts = [t.encode("utf-8", "replace") for t in got.text]
    y, train = got.label.to_numpy(), got.part.to_numpy() == 0
    good, bad = ([t for t, k, d in zip(texts, y, train, strict=True) if k == want and d] for want in (1, 0))
    prior = (y.sum() + 1) / (len(y) + 2)
    flat = {"good": b"", "bad": b"", "weights": [float(np.log(prior / (1 - prior))), 0.0, 0.0]}
    if not any(good) or not any(bad):
        return flat
    model = {"good": _dictionary(good), "bad": _dictionary(bad)}
    pair = _compressor(model["good"]), _compressor(model["bad"])
    held = ~train if len(set(y[~train])) == 2 else np.ones(len(y), bool)
    x = np.array([size_differences(t, *pair) for t, h in zip(got.text, held, strict=True) if h])
    return model | {"weights": [float(v) for v in _logistic(x, y[held])]}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with score added (0 to 1; a column of that name is replaced). Null is an empty text, which has the score of a zero difference."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES at most

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        good, bad, w = _compressor(m["good"]), _compressor(m["bad"]), m["weights"]
        for texts in batches:
            z = np.array([size_differences(t, good, bad) for t in texts]).reshape(-1, 2) @ np.array(w[1:]) + w[0]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn("score", scored(F.col(text_col)))


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.filter(F.crc32(F.col(id_col).cast("string")) % FOLDS != 0)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that score at least threshold, with the columns of docs, whatever their names.

    Rows without an id, repeated rows and rows alike are judged each by its text; a null text is an empty one, whose score
    is that of a zero difference. An empty table gives no rows.
    """
    whole = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))  # names inside the struct can't clash with a score
    kept = score(whole, fit(docs, training_labels(labels)), "_text").filter(F.col("score") >= threshold)
    return kept.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. A row without an id is held out: nothing is learned from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
