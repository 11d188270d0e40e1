"""N-gram Jaccard join: documents whose sets of word shingles overlap by three quarters or more.

Two sets link when 4 * intersection >= 3 * union. Documents with the same set form a class, so copies are
compared once. Candidates share one of their first shingles: with all sets in one common order, two linked sets
meet in the first quarter of both. The order puts shingles of crowded counters last, so the first
quarter is made of rare ones.

Links are then found in two steps. Every class is compared with the one class it meets most often among the
smallest of each shingle; that ties groups of near copies together without looking at all their pairs. What
is left are shingles that still join different groups. Their classes are cut into tiles by size and hash, and in a
tile every pair of different groups passes three upper bounds on the overlap: from the sizes, from the
place of the shared shingle, and from the differing bits of the classes' hashed bitmaps. Only pairs that
pass are intersected. No bound can lose a link. Copies share long runs of shingles; a pair is given out only
where a run begins.

In a family of near copies that the first step did not tie together, nearly all pairs pass. So tiles first give out
a spanning forest of the groups that they could join, likeliest pairs first, and the classes of all pairs held back.
These classes are tiled again with the groups that the forest made. Only what still joins different groups after
that is given out in full.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.components import connected_components, joined_components
from quotemill.llm.text import by_bytes, key_of, pieces, release, stage, texts_of
from quotemill.llm.word_hashes import WordHasher, mixed

SHINGLE = 5
# Links need 4 * intersection >= 3 * union.
NUM, DEN = 3, 4
# Counters of the common order, and rows of a tile.
COUNTERS = 1 << 18
TILE = 512
# Rows of a crowded shingle that one task takes.
ROWS_PER_PART = 10_000
# Passes over the tiles that give out forests, before one that gives out every pair left.
FORESTS = 3

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Hashes the word shingles of many texts at once."""

    def __init__(self):
        self.words = WordHasher()

    def sets_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Distinct 64-bit shingle hashes of each text, sorted."""
        out = []
        for words, first in self.words.batches(texts):
            whole = self._joined(words, SHINGLE) if len(words) >= SHINGLE else None
            for a, b in itertools.pairwise(first.tolist()):
                if b - a >= SHINGLE:
                    out.append(np.unique(whole[a : b - SHINGLE + 1]))
                elif b > a:
                    out.append(self._joined(words[a:b], b - a))
                else:
                    out.append(np.zeros(0, np.uint64))
        return out

    @staticmethod
    def _joined(words: np.ndarray, size: int) -> np.ndarray:
        count = len(words) - size + 1
        out = np.full(count, size, np.uint64)  # shorter sequences never equal a full shingle
        for k in range(size):
            out = (out ^ words[k : k + count]) * _STEP
            out ^= out >> np.uint64(29)
        return mixed(out)


def class_of(hashes: np.ndarray) -> int:
    """64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63


def prefix_size(n):
    """How many of the first elements of a set of ``n`` are enough to meet every linked set."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def least_overlap(m, n):
    """Smallest intersection with which sets of these sizes link."""
    return (NUM * (m + n) + NUM + DEN - 1) // (NUM + DEN)


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of a set, bytes of parities: each hash flips one bit.

    The bits in which two bitmaps differ are at most as many as the elements in which the sets differ. Twice
    as many bits as elements, as a power of two, so that bitmaps of different widths can be folded.
    """
    width = 64
    while width < 2 * len(hashes):
        width *= 2
    flips = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (along the last axis) with fewer, wider counted bits."""
    while (width := bits.shape[-1]) > size:
        bits = bits[..., : width // 2] ^ bits[..., width // 2 :]
    return bits


def _signatures(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: documents as ``(id, class, size, digest)``, and crowded counters as ``(null, counter, count, null)``."""

    def sign(batches):
        shingler, seen = Shingler(), set()
        counters = np.zeros(COUNTERS, np.int64)
        for batch in by_bytes(batches, "text"):
            ids, classes, sizes = batch.column(0).to_pylist(), [], []
            for hashes in shingler.sets_of(texts_of(batch, "text")):
                name = class_of(hashes)
                classes.append(name)
                sizes.append(len(hashes))
                if name not in seen:
                    seen.add(name)
                    np.add.at(counters, (hashes >> np.uint64(46)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([True] * len(ids), pa.bool_()), pa.array(ids, pa.int64()), pa.array(classes, pa.int64()),
                    pa.array(sizes, pa.int64()), batch.column(batch.schema.get_field_index("digest")),
                ],
                ["doc", "id", "cls", "n", "digest"],
            )
        used = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([False] * len(used), pa.bool_()), pa.nulls(len(used), pa.int64()), pa.array(used),
                pa.array(counters[used]), pa.nulls(len(used), pa.int64()),
            ],
            ["doc", "id", "cls", "n", "digest"],
        )

    return docs.mapInArrow(sign, "doc boolean, id long, cls long, n long, digest long")


def _crowding(signatures: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tables of fixed size: how crowded each counter is, in powers of two over the mean, and the number of
    parts to cut its shingles' rows into."""
    rows = signatures.filter("not doc").groupBy("cls").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS)
    counts[rows.column("cls").to_numpy()] = rows.column("n").to_numpy()
    mean = max(counts.mean(), 1)
    order = np.clip(np.floor(np.log2(np.maximum(counts, 1) / mean)), 0, 20).astype(np.uint8)
    # What is far above the mean is due to single shingles.
    return order, np.where(counts > 4 * mean, np.ceil(counts / ROWS_PER_PART), 1).astype(np.int64)


def _met(docs: DataFrame, order: np.ndarray, parts: np.ndarray) -> DataFrame:
    """The first shingles that classes share: ``(key, cls, n, pos, pivot)``, pivot being the smallest class.

    A class comes at most once per task, and the rows of a crowded shingle are dealt out by class, with a pivot
    for each part. Rows are sorted by key and class and read as a stream.
    """

    def post(batches):
        shingler, seen = Shingler(), set()
        for batch in by_bytes(batches, "text"):
            rows = []
            for hashes in shingler.sets_of(texts_of(batch, "text")):
                name = class_of(hashes)
                if not len(hashes) or name in seen:
                    continue
                seen.add(name)
                counters = (hashes >> np.uint64(46)).astype(np.int64)
                # The common order: uncrowded shingles first, by hash among equals.
                first = np.argsort(order[counters], kind="stable")[: prefix_size(len(hashes))]
                n = np.full(len(first), len(hashes), np.int32)
                rows.append((hashes[first], np.full(len(first), name), n, np.arange(len(first), dtype=np.int32), parts[counters[first]]))
            if rows:
                keys, names, sizes, places, cut = map(np.concatenate, zip(*rows, strict=True))
                columns = [keys.view(np.int64), names, sizes, places, names % cut, cut > 1]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "cls", "n", "pos", "part", "crowded"])

    def meet(batches):
        # One row of the last key is carried into the next batch: its first, if no other class has come yet, or
        # else its last, which was given out and only tells copies.
        carried, pivot, given = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if carried is not None:
                batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            key, cls, part = (batch.column(c).to_numpy() for c in ("key", "cls", "part"))
            crowded = batch.column("crowded").to_numpy(zero_copy_only=False)
            begins = np.ones(len(key), bool)
            begins[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            fresh = begins.copy()
            fresh[1:] |= cls[1:] != cls[:-1]
            run, heads = np.cumsum(begins) - 1, cls[begins]
            if carried is not None:
                heads[0], fresh[0] = pivot, not given
            several = np.bincount(run, cls != heads[run]) > 0
            keep = fresh & (several[run] | crowded)
            if keep.any():
                columns = [batch.column(c).filter(pa.array(keep)) for c in ("key", "cls", "n", "pos")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(heads[run][keep])], ["key", "cls", "n", "pos", "pivot"])
            pivot, given = heads[-1], bool(several[-1] or crowded[-1])
            carried = batch.slice(len(key) - 1 if given else int(np.searchsorted(run, run[-1])), 1)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(post, "key long, cls long, n int, pos int, part long, crowded boolean")
    rows = rows.repartition(n, "key", "part").sortWithinPartitions("key", "part", "cls")
    return rows.mapInArrow(meet, "key long, cls long, n int, pos int, pivot long")


def _class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for each wanted class ``(cls, key, digest)``, with its bitmap: ``(cls, bits, text)``."""

    def check(batches):
        # Rows with one id and text come to one task, so copies of a row are left out here.
        shingler, seen = Shingler(), set()
        for batch in by_bytes(batches, "text"):
            rows = []
            texts = texts_of(batch, "text")
            names = batch.column(batch.schema.get_field_index("cls")).to_pylist()
            for name, text, hashes in zip(names, texts, shingler.sets_of(texts), strict=True):
                if name not in seen and class_of(hashes) == name:  # digests may be equal by chance
                    seen.add(name)
                    rows.append((name, parity_bits(hashes).tobytes(), text))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["cls", "bits", "text"]
            )

    return docs.withColumn("key", key_of("id")).join(wanted, ["key", "digest"]).select("cls", "text").mapInArrow(check, "cls long, bits binary, text binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of classes that link, by exact intersection of their sorted arrays."""
    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))

    def intersect(batches):
        shingler = Shingler()
        for batch in by_bytes(batches, "text_a", 500_000):
            good = []
            sets = [shingler.sets_of(batch.column(i).to_pylist()) for i in (2, 3)]
            for one, two in zip(*sets, strict=True):
                common = len(np.intersect1d(one, two, assume_unique=True))
                good.append(DEN * common >= NUM * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(intersect, "a long, b long")


def _bounded_pairs(tile: np.ndarray, rows: dict[str, np.ndarray], bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same tile, as two rows of positions, that pass all upper bounds on their overlap.

    With them comes the bound from the bitmaps over the overlap that they need. Rows are sorted by tile, so the partners of a row are the next ones: first all pairs one row apart, then two,
    and so on, as long as there are tiles of that many rows.
    """
    n, pos, comp, side, cross, before = (rows[c] for c in ("n", "pos", "comp", "side", "cross", "before"))
    found = []
    here, away = np.arange(len(tile) - 1), 1
    while len(here := here[tile[here] == tile[here + away]]):
        i, j = here, here + away
        need = least_overlap(n[i], n[j])
        fits = (comp[i] != comp[j]) & (~cross[i] | (side[i] != side[j]))
        # Two classes that also share the shingle before this one are compared there.
        fits &= before[i] != before[j]
        # From the sizes, and from what can still follow after the shared shingle in both orders.
        fits &= np.minimum(n[i], n[j]) >= need
        fits &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
        found.append(np.stack([i[fits], j[fits]]))
        away += 1
        here = here[here + away < len(tile)]
    if not found:
        return np.zeros((2, 0), np.int64), np.zeros(0)
    pairs = np.concatenate(found, axis=1)
    widths = np.array([len(b) for b in bits])
    place = np.zeros(len(bits), np.int64)
    tables = {}
    for width in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == width)
        place[mine] = np.arange(len(mine))
        tables[width] = np.frombuffer(b"".join(bits[k] for k in mine), np.uint8).reshape(-1, width)
    margin = np.zeros(pairs.shape[1])
    kinds = np.stack([widths[pairs[0]], widths[pairs[1]]])
    for one, two in np.unique(kinds, axis=1).T.tolist():
        for at in np.array_split(np.flatnonzero((kinds[0] == one) & (kinds[1] == two)), 1 + pairs.shape[1] // 10_000):
            i, j = pairs[:, at]
            small = min(one, two)
            differ = folded(tables[one][place[i]], small) ^ folded(tables[two][place[j]], small)
            differ = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            # The sets differ in at least so many elements, which leaves at most half of the others in common.
            margin[at] = (n[i] + n[j] - differ) // 2 / least_overlap(n[i], n[j])
    good = margin >= 1
    return pairs[:, good], margin[good]


def spanning_forest(ends: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the edges (two rows of node names) form a forest that joins what all of them join.

    Every group takes its heaviest edge to another group, the first one among equals, and merges along it, until no
    edge joins two groups.
    """
    order = np.argsort(-weight, kind="stable")
    names, nodes = np.unique(ends[:, order], return_inverse=True)
    nodes = nodes.reshape(2, -1)
    chosen = np.zeros(len(order), bool)
    own = np.arange(len(names))
    label = own
    while len(open_edges := np.flatnonzero(label[nodes[0]] != label[nodes[1]])):
        one, two = label[nodes[:, open_edges]]
        heaviest = np.full(len(names), len(order))
        np.minimum.at(heaviest, one, open_edges)
        np.minimum.at(heaviest, two, open_edges)
        groups = np.flatnonzero(heaviest < len(order))
        edge = heaviest[groups]
        chosen[order[edge]] = True
        parent = own.copy()
        parent[groups] = label[nodes[:, edge]].sum(axis=0) - groups  # the other end
        # Edges have one order, so the only cycles are two groups that took the same edge.
        parent = np.where((parent[parent] == own) & (own < parent), own, parent)
        while (parent != (above := parent[parent])).any():
            parent = above
        label = parent[label]
    return chosen


def _tile_pairs(postings: DataFrame, bitmaps: DataFrame, every: bool) -> DataFrame:
    """Candidate pairs ``a, b`` of classes in different groups, from postings ``(key, cls, n, pos, comp, before)``.

    With ``every`` all of them, or else those of a forest over the groups; a class of a pair that was held back is a
    row ``(class, null)``. No more rows come out than twice the tiles' rows then.

    A key's classes are banded by size, as a class links at most with the next band; keys with many classes in a
    band are cut by hash. Every pair of parts that may hold links is one tile.
    """
    # Bands as wide as the ratio of sizes that still link: partners are in the same band or the next.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(DEN / NUM)).cast("int")
    rows = postings.withColumn("band", band)
    rows = rows.withColumn("low", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    parts = rows.groupBy("key", "low").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"), F.count("*").alias("rows"))
    parts = stage(parts.filter("rows > 1").drop("rows"), "jaccard-parts")
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    rows = rows.join(parts, ["key", "low"]).withColumn("part", part)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("tile", F.xxhash64("key", "low", F.least("part", "other"), F.greatest("part", "other")))
    rows = rows.select("tile", "cls", "n", "pos", "comp", "before", "part", (F.col("part") != F.col("other")).alias("cross"))
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = rows.join(bitmaps, "cls").repartition(n, "tile").sortWithinPartitions("tile")

    def compare(batches):
        def done(held):
            table = pa.Table.from_batches(held)
            cls = table.column("cls").to_numpy()
            columns = {c: table.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "comp", "before")}
            columns["side"] = table.column("part").to_numpy()
            columns["cross"] = table.column("cross").to_numpy()
            pairs, margin = _bounded_pairs(table.column("tile").to_numpy(), columns, table.column("bits").to_pylist())
            ends, held_back = np.sort(cls[pairs], axis=0), np.zeros(0, np.int64)
            if ends.size:
                ends, at = np.unique(ends, axis=1, return_index=True)
                if not every:
                    tree = spanning_forest(columns["comp"][pairs[:, at]], margin[at])
                    ends, held_back = ends[:, tree], np.unique(ends[:, ~tree])
            a, b = np.concatenate([ends[0], held_back]), pa.array(ends[1])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.concat_arrays([b, pa.nulls(len(held_back), pa.int64())])], ["a", "b"])

        # Whole tiles are compared together, some thousands of rows at a time.
        held = []
        for batch in pieces(batches, 4 * TILE):
            if not batch.num_rows:
                continue
            tile = batch.column("tile").to_numpy()
            last = int(np.searchsorted(tile, tile[-1]))
            if last or (held and held[-1].column("tile")[-1].as_py() != tile[0]):
                yield done([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(held)

    names = ["tile", "cls", "n", "pos", "comp", "before", "part", "cross", "bits"]
    return tiles.select(*names).mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    A document's set holds the distinct shingles of five words, lower-cased (A-Z) and split at ASCII white space;
    fewer words are one shingle. Null, empty and blank texts have the empty set, link with nothing and are their own
    component. ``component_id`` is the smallest id reachable over links. Rows that repeat an id are documents of
    their own with the same name; a null id takes part and names a component only if no other id is in it.
    Shingles and sets are told apart by 64-bit hashes. Without documents there are no rows.
    """
    found = _components(docs, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document ``id, digest, n, component_id`` and whether the row ``stays`` if one of a component does."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    signatures = stage(_signatures(plain), "jaccard-signatures")
    signed = signatures.filter("doc").select("id", "cls", "n", "digest")
    met = stage(_met(plain, *_crowding(signatures)), "jaccard-postings")

    # The classes that meet others, and one text of each: that of the smallest id, or one without an id.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    named = signed.filter("n > 0").groupBy("cls").agg(first).select("cls", "first.id", "first.digest")
    wanted = met.select("cls").distinct().join(named, "cls").select("cls", key_of("id").alias("key"), "digest")
    texts = stage(_class_texts(plain, wanted), "jaccard-texts")

    # First step: each class with the smallest class it meets most often.
    often = met.filter("cls <> pivot").groupBy("cls", "pivot").agg(F.count("*").alias("times"))
    best = often.groupBy("cls").agg(F.max(F.struct("times", "pivot")).alias("best"))
    links = stage(_verified(best.select(F.col("cls").alias("a"), F.col("best.pivot").alias("b")), texts), "jaccard-links")
    groups = stage(connected_components(links), "jaccard-groups")

    # Second step: shingles that still join different groups.
    placed = met.drop("pivot").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    placed = placed.select("key", "cls", "n", "pos", F.coalesce("component", "cls").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    # Written before the join, so that adaptive execution can split the rows of a hot key.
    open_keys = stage(open_keys.select("key"), "jaccard-open-keys")
    # The class's shared shingle before, or something that no other class has.
    before = F.coalesce(F.lag("key").over(Window.partitionBy("cls").orderBy("pos")), F.col("cls"))
    still = stage(placed.join(open_keys, "key").withColumn("before", before), "jaccard-open")
    release(met, open_keys)
    for every in [False] * FORESTS + [True]:
        pairs = stage(_tile_pairs(still, texts.select("cls", "bits"), every), "jaccard-pairs")
        links = stage(_verified(pairs.filter("b is not null"), texts), "jaccard-links")
        if not links.isEmpty():
            groups = stage(joined_components(groups, links), "jaccard-groups")
        held_back = pairs.filter("b is null").select(F.col("a").alias("cls"))
        used = (pairs, still, texts)
        if held_back.isEmpty():
            break
        # Only classes of pairs held back go on, in their new groups.
        placed = still.drop("comp").join(held_back, "cls", "left_semi")
        placed = placed.join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        still = stage(placed.withColumn("comp", F.coalesce("component", "cls")).drop("component"), "jaccard-open")
        texts = stage(texts.join(held_back, "cls", "left_semi"), "jaccard-texts")
        release(*used)
    release(*used)

    classes = named.join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    classes = stage(classes.select("cls", "id", "digest", F.coalesce("component", "cls").alias("comp")), "jaccard-classes")
    # A component is named by its smallest id; of the classes that have it, one stays.
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "cls", "digest")).alias("one")
    least = classes.groupBy("comp").agg(one)
    placed = classes.select("cls", "comp").join(least, "comp").select("cls", "one")
    found = signed.join(placed, "cls", "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("one.id"))
    same = (F.col("cls") == F.col("one.cls")) & F.col("id").eqNullSafe(F.col("one.id"))
    # Without ids, only one text of a class stays.
    same &= F.col("id").isNotNull() | (F.col("digest") == F.col("one.digest"))
    stays = (F.col("n") == 0) | F.coalesce(same, F.lit(False))
    return found.select("id", "digest", "n", own.alias("component_id"), stays.alias("stays"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, of those with the smallest id, with its own columns.

    Rows that repeat the id and the set of that document all stay, as do rows without any shingle. Of a component
    without ids one row stays.
    """
    found = _components(docs, id_col, text_col).filter("stays")
    single = F.col("id").isNull() & (F.col("n") > 0)
    kept = found.select(key_of("id").alias("__key"), F.col("digest").alias("__digest"), single.alias("__single")).distinct()
    kept = stage(kept, "jaccard-kept")
    rows = docs.withColumns({"__key": key_of(id_col), "__digest": F.xxhash64(text_col)})
    names = ["__key", "__digest"]
    several = rows.join(kept.filter("not __single"), names, "left_semi").select(*docs.columns)
    # Copies without an id are told apart by nothing, so any of them will do.
    once = rows.filter(F.col(id_col).isNull()).join(kept.filter("__single"), names, "left_semi")
    return several.union(once.dropDuplicates(["__digest"]).select(*docs.columns))
