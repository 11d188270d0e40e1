"""Secret scans: candidates from a wide pattern, a random forest to remove false positives."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.text import pieces, stage, texts_of

# A candidate: twelve or more characters that keys, hashes and encoded bytes are made of.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_\-]{12,}={0,2}")
# Formats that are secrets beyond doubt: candidates that hold or overlap their matches are the findings labelled 1
# unless a table of reviewed ones is given. First key formats, then what is assigned to a name that asks for a secret.
# Words may stand around that name, but not those that say that the value is something else.
KNOWN = re.compile(
    rb"(?<![A-Za-z0-9])(?:"
    rb"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
    rb"|(?-i:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|npm_[A-Za-z0-9]{36}"
    rb"|hf_[A-Za-z0-9]{30,}|xox[abeprs]-[A-Za-z0-9\-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}"
    rb"|sk-(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_\-]{20,}|SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}"
    rb"|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+"
    rb"|-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:\s+[A-Za-z0-9+/=]{12,})+)"
    rb"|(?:password|passwd|pwd|secret|token|(?:api|access|private|auth)[_-]?key)"
    rb"(?:[_-](?!(?:file|path|dir|url|uri|count|name|type|limit|length|size)(?![A-Za-z0-9]))[A-Za-z0-9]{1,20}){0,4}"
    rb"[\"']?\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_\-]{12,}={0,2}))",
    re.IGNORECASE,
)
ASKING = re.compile(rb"pass|pwd|secret|token|key|auth|cred|login", re.IGNORECASE)
HARMLESS = re.compile(rb"example|sample|dummy|test|fake|placeholder|sha|md5|uuid|commit|checksum|http", re.IGNORECASE)
ASSIGNED = re.compile(rb"[=:]\s*[\"']?$")

DICTIONARY_WORDS = 20_000
FEATURES = (
    "length", "upper", "digit", "symbol", "entropy", "transitions", "case_changes", "hexadecimal", "longest_letters",
    "dictionary", "path_depth", "path_harmless", "asked_before", "assigned", "quoted", "harmless_near", "words_near",
)
# Bounds of the labelled sample the forest is fitted on, for either class.
SAMPLE = 10_000
TREES, TREE_DEPTH, SEED = 30, 7, 11
HELD_OUT = (7, 2)

_CLASS = bytes(
    1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 for b in range(256)
)
_WORD = re.compile(rb"[a-z]{3,}")


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> frozenset[bytes]:
    """The most frequent words of a-z in all documents, at most ``words`` of them; ties by the word."""

    def count(batches):
        counts: Counter[bytes] = Counter()
        for batch in pieces(batches):
            for text in texts_of(batch, "text"):
                counts.update(w for w in text.lower().split() if w.isalpha() and w.isascii() and len(w) > 2)
            if len(counts) > 500_000:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    def rows(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return frozenset(r["word"].encode() for r in top.collect())


def _coverage(candidate: bytes, known: frozenset[bytes]) -> float:
    """Share of the characters inside dictionary words, taken longest first from the left."""
    low, covered = candidate.lower(), 0
    for run in _WORD.finditer(low):
        at, end = run.span()
        while at < end - 2:
            for size in range(min(14, end - at), 2, -1):
                if low[at : at + size] in known:
                    covered += size
                    at += size
                    break
            else:
                at += 1
    return covered / len(candidate)


def features_of(text: bytes, start: int, end: int, path: bytes, known: frozenset[bytes]) -> list[float]:
    candidate = text[start:end]
    n = len(candidate)
    kinds = candidate.translate(_CLASS)
    counts = Counter(candidate)
    before, after = text[max(0, start - 48) : start], text[end : end + 48]
    changes = [(a, b) for a, b in zip(kinds, kinds[1:], strict=False) if a != b]
    near = before.split()[-3:] + after.split()[:3]
    return [
        float(n),
        kinds.count(2) / n,
        kinds.count(3) / n,
        kinds.count(4) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(changes) / n,
        sum({a, b} == {1, 2} for a, b in changes) / n,
        float(not candidate.strip(b"0123456789abcdefABCDEF")),
        max((m.end() - m.start() for m in re.finditer(rb"[A-Za-z]+", candidate)), default=0) / n,
        _coverage(candidate, known),
        float(path.count(b"/")),
        float(bool(HARMLESS.search(path))),
        float(bool(ASKING.search(b" ".join(before.split()[-3:])))),
        float(bool(ASSIGNED.search(before))),
        float(before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")),
        float(bool(HARMLESS.search(before + after))),
        sum(w.strip(b".,;:").lower() in known for w in near) / max(len(near), 1),
    ]


CANDIDATES = "doc_id long, row_hash long, start int, end int, known boolean, features array<double>"


def find_candidates(
    docs: DataFrame, known_words: frozenset[bytes], id_col: str = "doc_id", text_col: str = "text", path_col: str = "source"
) -> DataFrame:
    """One row per candidate, with byte offsets and features; the candidate itself is not copied.

    Long words of letters alone are candidates as well: whether they are secrets is for the forest to say.
    """

    def find(batches):
        for batch in pieces(batches, 500):
            rows = []
            paths = texts_of(batch, "path")
            for name, digest, path, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), paths, texts_of(batch, "text"), strict=True
            ):
                sure = [m.span("value") if m["value"] else m.span() for m in KNOWN.finditer(text)]
                at = 0
                for m in CANDIDATE.finditer(text):
                    start, end = m.span()
                    # Both are in order, so what ends before this candidate is not needed for later ones.
                    while at < len(sure) and sure[at][1] <= start:
                        at += 1
                    known = at < len(sure) and sure[at][0] < end
                    rows.append((name, digest, start, end, known, features_of(text, start, end, path, known_words)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CANDIDATES.split(", ")]
            )

    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("row_hash"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.col(text_col).cast("string").alias("text"),
    )
    return plain.mapInArrow(find, CANDIDATES)


def own_labels(found: DataFrame) -> DataFrame:
    """Candidates with the labels that need no reviewer: 1 for known formats, 0 for what nothing speaks for.

    What follows a name that asks for a secret, or is assigned to any name, may be one in an unknown format; it is
    left out.
    """
    asked, assigned = (F.col("features")[FEATURES.index(c)] > 0 for c in ("asked_before", "assigned"))
    return found.filter(F.col("known") | ~(asked | assigned)).withColumn("label", F.col("known").cast("int"))


def held_out() -> Column:
    """Documents the forest never learns from: one in seven, by the checksum of the id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_OUT[0] == HELD_OUT[1]


def fit_forest(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """Fit on at most ``sample`` findings of either class, drawn by hash; none if a class is missing.

    ``labelled`` has the columns of candidates and ``label``.
    """
    draw = F.xxhash64("doc_id", "row_hash", "start")
    parts = [
        labelled.filter(F.col("label") == value).orderBy(draw, "doc_id", "start").limit(sample) for value in (0, 1)
    ]
    rows = stage(parts[0].union(parts[1]).select(F.col("label").cast("double").alias("label"), "features"), "secret-sample")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, subsamplingRate=0.8
    )
    # One part, so that the draws inside the fit do not depend on the number of tasks.
    return forest.fit(rows.coalesce(1).sortWithinPartitions("label", "features").select("label", array_to_vector("features").alias("vector")))


def scan_secrets(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per candidate: ``doc_id, start, end, held_out, known, score, secret``.

    Offsets count UTF-8 bytes. ``score`` is the forest's probability that the candidate is a secret and ``secret``
    whether that is at least one half; the others are the removed false positives. Features are length,
    character classes and the changes between them, dictionary coverage, the path and the words around. ``labelled``
    holds reviewed findings (``doc_id, start, label``); without it, candidates that hold or overlap a ``known`` format
    are labelled 1 and others 0, except doubtful ones, which are not learnt from (``own_labels``). Documents held out by checksum are never learnt from. If no finding of a class is left to
    learn from, ``score`` is 1 for known formats and 0 otherwise. Null texts have no candidates, a null path is
    empty, a null id comes back null, rows that repeat an id give their findings each.
    """
    words = dictionary(docs, text_col)
    found = stage(find_candidates(docs, words, id_col, text_col, path_col), "secret-candidates")
    if labelled is None:
        learn = own_labels(found)
    else:
        learn = found.join(labelled.select("doc_id", "start", "label").distinct(), ["doc_id", "start"])
    model = fit_forest(learn.filter(~held_out()), sample)
    if model is None:
        scored = found.withColumn("score", F.col("known").cast("double"))
    else:
        scored = model.transform(found.withColumn("vector", array_to_vector("features")))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "start", "end", held_out().alias("held_out"), "known", "score", (F.col("score") >= 0.5).alias("secret")
    )
