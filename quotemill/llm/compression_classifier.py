"""Quality classifier: how much better zstandard packs a text with a dictionary of good texts than of bad ones."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.text import by_bytes, key_of, stage, texts_of

FOLDS = 5
HELD_FOLD = 0
THRESHOLD = 0.3
# Texts are packed in blocks, so that the dictionary counts everywhere and not only at the start of a long text.
BLOCK = 512
LEVEL = 3
DICTIONARY_BYTES = 112_640
# About so many bytes of texts of either label make a dictionary; longer texts are scored but not learnt from.
SAMPLE_BYTES = 12_000_000
LONGEST_SAMPLE = 200_000
# A text of fewer bytes than this leans towards the difference that texts have on average.
PRIOR_BYTES = 48
# Differences are counted in steps of this size for the calibration.
STEP = 0.001


def blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    return (text[i : i + size] for i in range(0, len(text), size))


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> tuple[bytes, bool]:
    """A zstandard dictionary of the texts' blocks, and whether it is a trained one.

    Too few texts to train on are the dictionary themselves.
    """
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(samples)[-size:], False


class Packer:
    """Bytes that texts take when packed block by block with one dictionary."""

    def __init__(self, dictionary: bytes, trained: bool):
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
        held.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def size(self, text: bytes) -> int:
        return sum(len(self.compressor.compress(b)) for b in blocks(text))


def fold_of(id_col: str, salt: str = "") -> Column:
    """CRC-32 of the id as text; a null id is the empty text."""
    return F.crc32(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def usable_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row ``key, label`` for every id with one label, 0 or 1, outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)").filter(fold_of("id") % FOLDS != HELD_FOLD)
    ends = known.groupBy(key_of("id").alias("key")).agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return ends.filter("label = most").drop("most")


def draw(id_col: str) -> Column:
    """A number in [0, 1) by id: below 1/2 the row is for dictionaries, above for the calibration."""
    return fold_of(id_col, "dictionary:") / F.lit(2.0**32)


def sampled_texts(docs: DataFrame, labels: DataFrame, sample_bytes: int) -> dict[int, list[bytes]]:
    """Texts of either label for the dictionaries, about ``sample_bytes`` each at most, in the order of their draws.

    The share of ids that keeps the sample that small follows from the bytes of all candidates, so each task gives up
    next to nothing of a large corpus. Equal rows count once.
    """
    able = docs.filter((draw("id") < 0.5) & F.octet_length("text").between(1, LONGEST_SAMPLE))
    sizes = able.select(key_of("id").alias("key"), F.octet_length("text").alias("n")).join(labels, "key")
    totals = {r.label: r.n for r in sizes.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    share = {label: 0.5 * min(1.0, sample_bytes / n) for label, n in totals.items()}
    if not share:
        return {}
    likely = able.filter(draw("id") < max(share.values())).select(key_of("id").alias("key"), draw("id").alias("draw"), "text")
    limit = F.when(F.col("label") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0)))
    chosen = likely.dropDuplicates(["key", "text"]).join(labels, "key").filter(F.col("draw") < limit)
    out: dict[int, list[bytes]] = {}
    for row in sorted(chosen.select("label", "draw", "key", "text").collect(), key=lambda r: (r.draw, r.key, r.text)):
        out.setdefault(row.label, []).append(row.text.encode())
    return out


def fit_logistic(counts: list[tuple[float, int, int]], rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of the log odds of label 1 by Newton's method.

    ``counts`` has values with their numbers of rows of label 0 and 1. A small ridge on the standardised slope keeps
    it finite where the labels part completely.
    """
    values, bad, good = (np.array(c, dtype=np.float64) for c in zip(*counts, strict=True))
    n = bad + good
    mean = (n * values).sum() / n.sum()
    width = math.sqrt((n * (values - mean) ** 2).sum() / n.sum()) or 1.0
    x, beta = np.stack([np.ones_like(values), (values - mean) / width]), np.zeros(2)
    ridge = np.diag([1e-6, 1e-5]) * n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -35, 35)))
        slope = x @ (good - n * p) - ridge @ beta
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)) @ x.T + ridge, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0] - beta[1] * mean / width), float(beta[1] / width)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """Quality of every text: the id under its own name, ``held_out, n_bytes, good_bytes, bad_bytes, score, predicted``.

    Two dictionaries are built from labelled texts, one per label. Every whole text is packed with both, in blocks; the
    difference of the sizes by byte of text becomes the probability of label 1 through a logistic curve, which is
    fitted on labelled rows that had no part in the dictionaries (all of them, counted by value inside the tasks).
    Ids whose CRC-32 leaves no remainder by 5 are held out: their labels are read by neither step. Only the text is
    an input of a score. ``sample_bytes`` bounds what the driver holds to build a dictionary.

    A null text is empty; an empty one has the score of the average difference. Null labels, labels but 0 and 1 and ids
    labelled both ways are not learnt from, nor are rows without an id, which are scored as held out. Rows that
    repeat an id are scored each by their own text. Without texts of both labels the score is the smoothed share of
    label 1. Other columns are left out; join them by the id. Without documents there are no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_kind = texts.schema["id"].dataType.simpleString()
    known = stage(usable_labels(labels, id_col, label_col), "quality-labels")
    chosen = sampled_texts(texts, known, sample_bytes)
    packed = None
    if len(chosen) == 2:
        packed = [build_dictionary(chosen[1]), build_dictionary(chosen[0])]

    def measure(batches):
        packers = [Packer(*p) for p in packed] if packed else []
        for batch in by_bytes(batches, "text"):
            raw = texts_of(batch, "text")
            sizes = [[p.size(t) for t in raw] for p in packers] or [[0] * len(raw)] * 2
            columns = [pa.array(c, pa.int64()) for c in ([len(t) for t in raw], *sizes)]
            names = ["id", "n_bytes", "good_bytes", "bad_bytes"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), *columns], names=names)

    schema = f"id {id_kind}, n_bytes long, good_bytes long, bad_bytes long"
    measured = stage(texts.mapInArrow(measure, schema), "quality-sizes")
    # Half of the learnt ids are for the curve.
    rest = measured.filter((draw("id") >= 0.5) & F.col("id").isNotNull())
    rest = rest.select(key_of("id").alias("key"), "n_bytes", (F.col("bad_bytes") - F.col("good_bytes")).alias("gain"))
    rest = stage(rest.join(known, "key").drop("key"), "quality-curve")
    total = rest.agg(F.sum("gain").alias("gain"), F.sum("n_bytes").alias("n"), F.count("*").alias("rows"), F.sum("label").alias("good")).first()
    usual = total.gain / total.n if packed and total.n else 0.0

    def difference(gain: Column, n_bytes: Column) -> Column:
        return (gain + F.lit(PRIOR_BYTES * usual)) / (n_bytes + F.lit(PRIOR_BYTES))

    value = F.round(difference(F.col("gain"), F.col("n_bytes")) / STEP).cast("int")
    counts = rest.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
    counts = [(r.value * STEP, r.n - r.good, r.good) for r in sorted(counts, key=lambda r: r.value)]
    if packed and 0 < (total.good or 0) < total.rows:
        intercept, slope = fit_logistic(counts)
    else:
        share = ((total.good or 0) + 1) / (total.rows + 2)
        intercept, slope = math.log(share / (1 - share)), 0.0
    gain = F.col("bad_bytes") - F.col("good_bytes")
    score = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * difference(gain, F.col("n_bytes")))))
    scored = measured.withColumn("held_out", fold_of("id") % FOLDS == HELD_FOLD).withColumn("score", score)
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", predicted, "n_bytes", "good_bytes", "bad_bytes")


def is_held_out(name: object) -> bool:
    """Whether an id belongs to the held-out fold."""
    return zlib.crc32(("" if name is None else str(name)).encode()) % FOLDS == HELD_FOLD
