"""Language identification with a blended-spectrum presence kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.exact_dedup import filter_room
from sigloom.llm.staging import small_batches, stage, wrapped
from sigloom.llm.tokens import drop_encoders

FOLDS = 5
#: A digest in hex, and what a row of a broadcast takes besides.
_GONE_BYTES = 200


@dataclass
class Settings:
    """Bounds of the fit. ``sample``: labelled rows in all, or one a label where labels are more; ``landmarks`` of them."""

    orders: tuple[int, ...] = (1, 2, 3)
    slot_bits: int = 15
    sample: int = 2000
    landmarks: int = 128
    ridge: float = 1e-3
    batch: int = 64


@dataclass
class Model:
    labels: list[str]
    landmarks: np.ndarray  # landmarks x slots, 0 or 1, each row over its norm
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    settings: Settings

    def scores(self, presence: np.ndarray) -> np.ndarray:
        """Two matrix products for a batch: kernel values with the landmarks, then one regression per language."""
        norms = np.sqrt(np.maximum(presence.sum(1, keepdims=True), 1))
        return (presence @ self.landmarks.T / norms) @ self.weights + self.bias


def has_letter(text: str | None) -> bool:
    return next(filter(str.isalpha, text or ""), None) is not None


def mark(text: str, row: np.ndarray, settings: Settings, block: int = 1 << 20) -> None:
    """Set the slots of all n-grams of a lower-cased text, in blocks that overlap by an n-gram."""
    reach = max(settings.orders)
    text = text.lower()
    for at in range(0, len(text), block):
        code = np.frombuffer(text[at : at + block + reach - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        h = np.zeros(len(code), np.uint32)
        for n in range(1, reach + 1):
            h = (h if n == 1 else h[:-1]) * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
            if not len(h):
                break
            if n in settings.orders:
                row[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - settings.slot_bits)] = 1


def presence(texts: list[str], settings: Settings, dtype=np.float32) -> np.ndarray:
    out = np.zeros((len(texts), 1 << settings.slot_bits), dtype)
    for row, text in zip(out, texts, strict=True):
        mark(text, row, settings)
    return out


def fold(id_col) -> F.Column:
    """CRC-32 of the id as text, modulo 5; 0 is held out, and so is a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def sample_rows(df: DataFrame, settings: Settings, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(``lang``, ``text``): of every language the rows of smallest id hash, as many of each, ``settings.sample`` in all or one a language."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col)) != 0))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return rows.select("lang", "text").limit(0)
    quota = max(1, settings.sample // len(counts))
    # Hashes below a bound that about twice the quota pass, so that the ranking sees few rows.
    bounds = [(r["lang"], min(2**63 - 1, 2 * (quota + 20) * 2**63 // r["n"])) for r in counts]
    limits = df.sparkSession.createDataFrame(bounds, "lang string, most long")
    near = rows.join(F.broadcast(limits), "lang").filter(F.abs(F.coalesce("h", F.lit(0))) <= F.col("most"))
    return near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))).filter(F.col("k") <= quota).select("lang", "text")


def fit(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a bounded sample of labelled rows outside the held-out fold.

    Executors turn the sample's whole texts to bits (``2 ** slot_bits`` each), which is what the driver gets. Ridge regression
    runs in the landmarks' Nyström space. Rows without a letter teach nothing.
    """
    settings = settings or Settings()

    def run(batches):
        for batch in batches:
            pairs = [(lang, t) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            bits = [np.packbits(presence([t], settings, np.uint8)[0]).tobytes() for _, t in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array(bits, pa.binary())], ["lang", "bits"])

    rows = sample_rows(df, settings, id_col, text_col, lang_col).mapInArrow(run, "lang string, bits binary").orderBy("lang", "bits").collect()
    labels = sorted({r["lang"] for r in rows})
    size = 1 << settings.slot_bits
    if not rows:
        return Model([], np.zeros((0, size), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), settings)
    packed = np.stack([np.frombuffer(r["bits"], np.uint8) for r in rows])
    truth = np.array([labels.index(r["lang"]) for r in rows])
    # Landmarks in turn from all languages: one row of each, then another of each; which ones, a hash decides.
    h, turn = np.array([zlib.crc32(x.tobytes()) for x in packed]), np.empty(len(packed), int)
    turn[np.lexsort((h, truth))] = np.concatenate([np.arange(n) for n in np.bincount(truth)])
    chosen = np.lexsort((h, turn))[: settings.landmarks]
    unit = lambda some: (x := np.unpackbits(some, axis=1).astype(np.float32)) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    landmarks = unit(packed[chosen])
    kernel = np.concatenate([unit(packed[k : k + 128]) @ landmarks.T for k in range(0, len(packed), 128)]).astype(np.float64)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ whiten
    target = np.eye(len(labels))[truth]
    centre, bias = features.mean(0), target.mean(0)
    centred = features - centre
    beta = np.linalg.solve(centred.T @ centred + settings.ridge * len(rows) * np.eye(centred.shape[1]), centred.T @ (target - bias))
    return Model(labels, landmarks, (whiten @ beta).astype(np.float32), (bias - centre @ beta).astype(np.float32), settings)


def _judge(texts: list[str], model: Model) -> tuple[list[str], list[float], list[float]]:
    """Label, score and lift of each text, in batches of ``model.settings.batch``.

    The lift is how far the score is on its way from what a text without any n-gram of the landmarks gets for that label to 1. Scores
    over the labels sum to 1, so the best one alone is never low. With a single label, which everything gets, the lift is 1.
    """
    drop_encoders()
    labels, scores, lifts = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if model.labels and has_letter(t)]
    for k in range(0, len(known), model.settings.batch):
        some = known[k : k + model.settings.batch]
        out = model.scores(presence([texts[i] for i in some], model.settings))
        for i, best, value in zip(some, out.argmax(1), out.max(1), strict=True):
            labels[i], scores[i] = model.labels[best], min(1.0, max(0.0, float(value)))
            room = 1 - float(model.bias[best])
            lifts[i] = (float(value) - float(model.bias[best])) / room if len(model.labels) > 1 and room > 1e-6 else 1.0
    return labels, scores, lifts


def judge(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    """Label and score of each text."""
    return _judge(texts, model)[:2]


def least_lift(df: DataFrame, model: Model, share: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """Half the lift that all but ``share`` of the right predictions have, over all labelled rows of the held-out fold; 0 if none is right.

    Midway between no evidence at all and the least that known languages show. The driver gets counts by thousandths.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            labels, _, lifts = _judge([t.decode("utf-8", "replace") for t in batch.column(0).to_pylist()], shared.value)
            right = [max(0, int(1000 * x)) for x, label, lang in zip(lifts, labels, batch.column(1).to_pylist(), strict=True) if label == lang != "und"]
            step, n = np.unique(np.array(right, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n.astype(np.int64))], ["step", "n"])

    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col)) == 0))
    with small_batches(df.sparkSession, 512):
        counts = rows.select(F.col(text_col).cast("binary"), F.col(lang_col)).mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()
    before = np.cumsum([0, *(r["n"] for r in counts)])
    return next((r["step"] / 2000 for r, n in zip(counts, before[1:], strict=True) if n > share * before[-1]), 0.0)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``held_out``, ``lang_pred``, ``score`` (the winning regression, cut to 0..1).

    Whole texts are read, nothing else. A null text, one without a letter, or a model without labels: ``und`` and 0. Ties go to the
    smaller label. Repeated rows are judged alike; null ids are kept and count as held out. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            labels, scores = [], []
            for k in range(0, batch.num_rows, 512):
                some = judge([(t or b"").decode("utf-8", "replace") for t in batch.column(2)[k : k + 512].to_pylist()], shared.value)
                labels += some[0]
                scores += some[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    rows = df.select(F.col(id_col).alias("id"), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def identify(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``fit`` and ``predict`` on one table."""
    return predict(df, fit(df, settings, id_col, text_col, lang_col), id_col, text_col)


def keep_identified(df: DataFrame, model: Model, least: float, text_col: str = "text", lift: float = -np.inf) -> DataFrame:
    """The rows of ``df``, all columns, whose language ``judge`` names with a score of ``least`` and a lift of ``lift`` or more; ``und`` never stays.

    Only the text says whether a row stays: null and empty texts and those without a letter go, repeated rows stay or go together, and other columns, of any
    names, come back as they are. An empty table gives no rows. Texts are judged here, in small batches, and the digests of those that go are staged.
    """
    spark, shared = df.sparkSession, df.sparkSession.sparkContext.broadcast(model)
    digest = lambda text: F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)

    def run(batches):
        for batch in batches:
            found = _judge([t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array([x == "und" or y < least or z < lift for x, y, z in zip(*found, strict=True)], pa.bool_()))], ["gone"])

    texts = df.select(digest(F.col(text_col)), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    with small_batches(spark, 512):
        gone = stage(texts.mapInArrow(run, "gone string").distinct(), "unidentified")
    # While they fit, no row has to move.
    if gone.count() * _GONE_BYTES <= filter_room(spark):
        gone = F.broadcast(gone)
    return wrapped(df).join(gone, digest(F.col("row")[text_col]) == F.col("gone"), "left_anti").select("row.*")
