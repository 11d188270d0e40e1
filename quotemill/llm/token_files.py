"""Token-ID files: Arrow record batches of equal-length sequences, read again without copying."""

from __future__ import annotations

import functools
import itertools
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm.text import pieces, stage, texts_of

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 256
# Frequent words are encoded once per file, so a file should hold many texts.
SHARD_BYTES = 64_000_000
CACHED_CHUNKS = 800_000

# White space next to a space: only there does a pre-token hold a space that is not its first character.
_WIDE = re.compile(r"\s | \s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


# Marks that start a pre-token of their own after a letter.
_MARKS = ".,;:!?"


def _byte_characters() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte: itself if visible, else the next from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + k for k, b in enumerate(hidden)}


class ChunkEncoder:
    """Encodes texts with a byte-level vocabulary, one chunk of text at a time.

    A single space between two other characters always starts a pre-token, so a text may be cut before it
    and the ids of the chunks joined. Likewise a single line feed between two others is a pre-token. A chunk of
    letters is one pre-token, which goes to the merges without the rest of the library's work. Frequent
    pieces are encoded once; the cache is bounded.
    """

    def __init__(self, path: str, dtype: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = dtype
        self.characters = _byte_characters()
        self.written = [np.array([i], dtype).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = {}  # by piece, after a space
        self.others: dict[str, bytes] = {}  # by piece as it is

    def _encode(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merge(self, letters: str) -> bytes:
        letters = letters.encode().decode("latin-1").translate(self.characters)
        return self._join(letters)

    def _join(self, characters: str) -> bytes:
        written = self.written
        return b"".join([written[t.id] for t in self.tokenizer.model.tokenize(characters)])

    def _piece(self, piece: str, space: str) -> bytes:
        """Ids of a piece without spaces that follows a space, or, with an empty ``space``, something else."""
        cache = self.known if space else self.others
        found = cache.get(piece)
        if found is not None:
            return found
        stem = piece.rstrip(_MARKS)
        if stem.isalpha():
            ids = cache.get(stem)
            if ids is None:
                if stem.isascii():  # written as they are, after a space as its character
                    ids = cache[stem] = self._join("\u0120" + stem if space else stem)
                elif max(stem) < "\u0250":  # letters of the Latin blocks are letters for every version of Unicode
                    ids = cache[stem] = self._merge(space + stem)
            if ids is not None:
                if len(stem) == len(piece):
                    return ids
                marks = piece[len(stem) :]
                return ids + (self.others.get(marks) or self._piece(marks, ""))
        lines = piece.split("\n")
        if len(lines) > 1 and all(lines) and not any(x[0].isspace() or x[-1].isspace() for x in lines):
            rest = [self._piece("\n", "") + self._piece(x, "") for x in lines[1:]]
            return self._piece(lines[0], space) + b"".join(rest)
        found = self._encode(space + piece)
        if len(piece) <= 64:
            cache[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        for cache in (self.known, self.others):
            if len(cache) >= CACHED_CHUNKS:
                cache.clear()
        first, *rest = _SINGLE.split(text) if _WIDE.search(text) else text.split(" ")
        ids = [self._piece(first, "") if first else b""]
        get, piece = self.known.get, self._piece
        ids += [get(x) or piece(x, " ") for x in rest]
        return np.frombuffer(b"".join(ids), self.dtype)


@functools.lru_cache(maxsize=1)
def _shared_encoder(path: str, dtype: str) -> ChunkEncoder:
    return ChunkEncoder(path, dtype)


def encoder_of(path: str, dtype: str) -> ChunkEncoder:
    """The process's encoder, without cached pieces: a Python worker that loads the vocabulary anew for each file grows."""
    encoder = _shared_encoder(path, dtype)
    encoder.known, encoder.others = {}, {}
    return encoder


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder all executors share."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def sequence_schema(dtype: str, length: int) -> pa.Schema:
    kind = pa.uint16() if dtype == "<u2" else pa.uint32()
    return pa.schema(
        [
            ("ids", pa.list_(kind, length)),  # padded with 0
            ("mask", pa.list_(pa.bool_(), length)),  # a token, not padding
            ("begins", pa.list_(pa.bool_(), length)),  # the first token of a document
        ]
    )


INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


class _SequenceWriter:
    """Cuts a stream of documents into equal-length rows and writes them batch by batch."""

    def __init__(self, sink, index_sink, dtype: str, length: int):
        self.schema, self.dtype, self.length = sequence_schema(dtype, length), dtype, length
        self.writer = ipc.new_file(sink, self.schema)
        self.index = ipc.new_file(index_sink, INDEX)
        self.ids: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.held = self.n_tokens = self.n_docs = 0

    def add(self, names: list[int | None], docs: list[np.ndarray]) -> None:
        for ids in docs:
            begins = np.zeros(len(ids), bool)
            begins[0] = True
            self.ids.append(ids)
            self.begins.append(begins)
            self.held += len(ids)
            self.n_tokens += len(ids)
            if self.held >= self.length * SEQUENCES_PER_BATCH:
                self._write(final=False)
        self.n_docs += len(docs)
        self.index.write_batch(
            pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(map(len, docs), pa.int64())], schema=INDEX)
        )

    def _write(self, final: bool) -> None:
        if not self.held:
            return
        ids, begins = np.concatenate(self.ids), np.concatenate(self.begins)
        step = self.length * SEQUENCES_PER_BATCH
        start = 0
        while len(ids) - start >= step or (final and start < len(ids)):
            part, first = ids[start : start + step], begins[start : start + step]
            rows = -(-len(part) // self.length)
            pad = rows * self.length - len(part)
            values = [
                pa.array(np.pad(part, (0, pad))),
                pa.array(np.pad(np.ones(len(part), bool), (0, pad))),
                pa.array(np.pad(first, (0, pad))),
            ]
            arrays = [pa.FixedSizeListArray.from_arrays(v, self.length) for v in values]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
            start += step
        self.ids, self.begins = [ids[start:].copy()], [begins[start:].copy()]
        self.held = len(self.ids[0])

    def close(self) -> None:
        self._write(final=True)
        self.writer.close()
        self.index.close()


FILES = "shard int, path string, n_docs long, n_tokens long"
RUNS = ["id", "digest", "text", "n"]


def run_lengths(rows: DataFrame) -> DataFrame:
    """Rows ``id, digest, text`` with ``n``, how often each follows itself; what is written n times is shuffled once.

    Works along the partitions as they are, so copies that do not stand next to each other stay rows of their own.
    Texts are packed for the way.
    """

    def equal(column, n):
        one, two = column.slice(1), column.slice(0, n - 1)
        same = pc.fill_null(pc.equal(one, two), False)
        return pc.or_(same, pc.and_(pc.is_null(one), pc.is_null(two))).to_numpy(zero_copy_only=False)

    def merge(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ones(batch.num_rows, np.int64))], names=RUNS)
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            same = equal(batch.column(0), batch.num_rows) & equal(batch.column(2), batch.num_rows)
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
            n = pa.array(np.add.reduceat(batch.column(3).to_numpy(), starts))
            first = batch.take(pa.array(starts))
            runs = pa.RecordBatch.from_arrays([*first.columns[:3], n], names=RUNS)
            held = runs.slice(len(starts) - 1)
            yield pack(runs.slice(0, len(starts) - 1))
        if held is not None:
            yield pack(held)

    def pack(runs):
        packer = zstandard.ZstdCompressor(level=1)
        texts = pa.array([packer.compress(t) for t in texts_of(runs, "text")], pa.binary())
        return pa.RecordBatch.from_arrays([runs.column(0), runs.column(1), texts, runs.column(3)], names=RUNS)

    return rows.select(*RUNS[:3]).mapInArrow(merge, "id long, digest long, text binary, n long")


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE,
    copies: bool = False,
) -> DataFrame:
    """Encode all texts and write them in ascending id order; returns one row per file.

    Each range of ids, of about SHARD_BYTES of text, becomes ``tokens-<shard>.arrow``, an Arrow file of record batches with the columns
    ``ids``, ``mask`` and ``begins``, fixed-size lists of ``length`` (see ``sequence_schema``), next to
    ``tokens-<shard>.index.arrow`` with the id and token count of its documents. ``end_id`` follows every
    document. Ids take two bytes where the vocabulary fits. A null text is empty and gives the end id only; a
    null id sorts first; rows that repeat an id stand next to each other, ordered by a hash of their text.
    Without documents there are no files. ``folder`` must be shared by all executors; a retried task
    writes under a name of its own and renames it when complete.

    Equal rows are encoded once and written as often as they occur. With ``copies``, those that stand next to each other,
    as readings of one document do in a mixture, also travel as one row with a count; the files are the same.
    """
    # A hash of the text spreads an id that very many rows share.
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    shards = (plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES + 1
    size = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if size <= 2**16 else "<u4"
    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)

    def write(batches):
        fs, root = _place(folder)
        shard = TaskContext.get().partitionId()
        name, attempt = f"{root}/tokens-{shard:06d}", uuid.uuid4().hex
        encoder = writer = last = None
        for batch in pieces(batches, 500):
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = encoder_of(path, dtype)
                sink, index = (fs.open_output_stream(f"{name}{end}.{attempt}") for end in (".arrow", ".index.arrow"))
                writer = _SequenceWriter(sink, index, dtype, length)
            end = np.array([end_id], dtype)
            names, docs = [], []
            texts = texts_of(batch, "text")
            if copies:
                texts = map(zstandard.ZstdDecompressor().decompress, texts)
            for doc_id, text, n in zip(batch.column(0).to_pylist(), texts, batch.column(3).to_pylist(), strict=True):
                if last is None or last[0] != text:
                    last = text, np.concatenate([encoder.encode(text.decode()), end])
                names += [doc_id] * n
                docs += [last[1]] * n
            writer.add(names, docs)
        if writer:
            writer.close()
            sink.close()
            index.close()
            for kind in (".arrow", ".index.arrow"):
                fs.move(f"{name}{kind}.{attempt}", f"{name}{kind}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([f"{folder}/tokens-{shard:06d}"]), pa.array([writer.n_docs]), pa.array([writer.n_tokens])],
                ["shard", "path", "n_docs", "n_tokens"],
            )

    counted = run_lengths(plain) if copies else plain.withColumn("n", F.lit(1).cast("long"))
    order = [F.col("id").asc_nulls_first(), F.col("digest")]
    ordered = counted.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return stage(ordered.mapInArrow(write, FILES), "token-files")


class TokenFile:
    """One written file, mapped into memory where it is a local path."""

    def __init__(self, uri: str):
        fs, path = _place(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        open_ = pa.memory_map if local else fs.open_input_file
        self.reader = ipc.open_file(open_(f"{path}.arrow"))
        self.index = ipc.open_file(open_(f"{path}.index.arrow")).read_all()
        self.length = self.reader.schema.field("ids").type.list_size

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence; the ids are a view of the file."""
        batch = self.reader.get_batch(row // SEQUENCES_PER_BATCH)
        at = row % SEQUENCES_PER_BATCH * self.length
        ids, mask = (batch.column(i).flatten().slice(at, self.length) for i in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def documents(self):
        """Id, position in the file and ids of every document, found by the marks of first tokens."""
        names = iter(self.index.column("doc_id").to_pylist())
        lengths = iter(self.index.column("n_tokens").to_pylist())
        tail, start = None, 0

        def finish(ids):
            nonlocal start
            if next(lengths) != len(ids):
                raise ValueError("the index does not fit the marks of the file")
            out = (next(names), start, ids)
            start += len(ids)
            return out

        for i in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(i)
            ids, mask, begins = (batch.column(k).flatten() for k in range(3))
            n = int(mask.true_count)
            ids = ids.to_numpy()[:n]
            cuts = np.flatnonzero(begins.to_numpy(zero_copy_only=False)[:n]).tolist()
            if n and (not cuts or cuts[0]):
                tail.append(ids[: cuts[0] if cuts else n])  # goes on from the batch before
            for first, last in itertools.pairwise([*cuts, n]):
                if tail is not None:
                    yield finish(np.concatenate(tail))
                tail = [ids[first:last]]
        if tail is not None:
            yield finish(np.concatenate(tail))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, read back from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it in all files, ``ids_crc32`` is the unsigned CRC of the
    ids as little-endian 32-bit integers.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [
                    (name, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for name, start, ids in TokenFile(path).documents()
                ]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return placed.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
