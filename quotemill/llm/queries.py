"""The registered queries: each operator over its whole table, reduced to comparable columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.centroids import cluster_vectors
from quotemill.llm.compression_classifier import score_quality
from quotemill.llm.ctw import score_documents
from quotemill.llm.decontaminate import find_contamination
from quotemill.llm.jaccard_join import near_duplicates
from quotemill.llm.line_dedup import dedupe_lines
from quotemill.llm.mixing import mix_sources
from quotemill.llm.quality import quality_verdicts
from quotemill.llm.secret_scan import scan_secrets
from quotemill.llm.suffix_dedup import remove_repeats
from quotemill.llm.text import table
from quotemill.llm.token_counts import count_tokens
from quotemill.llm.token_files import read_token_files, write_token_files
from quotemill.llm.whitening import whiten
from quotemill.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


LINE_SQL = r"""
WITH line AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM line
), wide AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
    GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT keyed.*, wide.k IS NOT NULL AND doc_id <> keeper AS dropped FROM keyed LEFT JOIN wide ON keyed.k = wide.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_line_dedup", LINE_SQL)
def op1_line_dedup(spark, sf_dir):
    """Documents without the lines that three or more of them hold."""
    kept = dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    """Tokens of every document under a vocabulary with word ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("word_bpe_49k.json")).drop("text")


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    """Every candidate for a secret with the forest's verdict."""
    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op4_ctw_scores")
def op4_ctw_scores(spark, sf_dir):
    """Probability of every document under context trees trained on six sevenths of them."""
    return score_documents(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, coalesce(source, '') AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
    FROM documents
), src AS (
    SELECT source, sum(n_tokens)::DOUBLE AS n FROM doc GROUP BY source
), ends AS (
    SELECT min(n) AS least, max(n) AS most FROM src WHERE n > 0
), search(low, high) AS (
    SELECT CASE WHEN most / least <= 4.0 * (1 + 1e-12) THEN -1 ELSE 0 END,
           CASE WHEN most / least <= 4.0 * (1 + 1e-12) THEN 0 ELSE 1099511627776 END
    FROM ends
    UNION ALL
    SELECT CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
    FROM (
        SELECT low, high, (low + high) // 2 AS mid,
               pow(most, 1 - mid / 1099511627776.0::DOUBLE) * pow(least, mid / 1099511627776.0::DOUBLE - 1) <= 4.0 * (1 + 1e-12) AS ok
        FROM search, ends WHERE high - low > 1
    )
), alpha AS (
    SELECT min(high) / 1099511627776.0::DOUBLE AS a FROM search
), plan AS (
    SELECT source, n, CASE WHEN n > 0 THEN
               round(pow(n, a) / sum(CASE WHEN n > 0 THEN pow(n, a) END) OVER ()
                     * (pow(most, 1 - a) * sum(CASE WHEN n > 0 THEN pow(n, a) END) OVER ()), 3) ELSE 0 END AS budget
    FROM src, alpha, ends
), cut AS (
    SELECT *, CASE WHEN n > 0 THEN floor(budget / n * (1 + 1e-9)) ELSE 1 END AS whole_blocks,
           CASE WHEN n > 0 THEN budget / n ELSE 1 END AS length
    FROM plan
), partial AS (
    SELECT doc.*, cut.whole_blocks::BIGINT AS whole_blocks, cut.length,
           greatest(floor(budget - cut.whole_blocks * n), 0) AS rest,
           ('0x' || md5('17:' || whole_blocks::BIGINT || ':' || coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS p
    FROM doc JOIN cut USING (source)
), running AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY p) <= rest AS fits FROM partial
), copies AS (
    SELECT doc_id, source, length, unnest(range(0, whole_blocks + CASE WHEN fits THEN 1 ELSE 0 END)) AS epoch FROM running
), placed AS (
    SELECT *, ('0x' || md5('17:' || epoch || ':' || coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS place FROM copies
)
SELECT doc_id, source, epoch::INT AS epoch, place,
       least(floor((epoch + place / pow(2::DOUBLE, 60)) / length * 64), 63)::INT AS block
FROM placed
"""


@query("op5_source_mixing", MIX_SQL)
def op5_source_mixing(spark, sf_dir):
    """All documents, small sources up to four times: a tempered mixture in 64 blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "epoch", "place", "block")


@query("op6_token_files")
def op6_token_files(spark, sf_dir):
    """Every document's place and checksum, read back from the written token files."""
    docs = table(spark, sf_dir, "documents")
    files = write_token_files(docs, work_path(spark, "token-files"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(files)


LEAK_SQL = r"""
WITH low_docs AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
    FROM documents
), low_items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM low_items WHERE len(w) > 0)
), starts AS (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM low_docs, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k
), hits AS (
    SELECT doc_id, i, starts.k, item_id
    FROM starts JOIN item_windows ON starts.k = item_windows.k AND array_to_string(w[i:i + starts.k - 1], ' ') = win
), covered AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low_docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op7_benchmark_decontamination", LEAK_SQL)
def op7_benchmark_decontamination(spark, sf_dir):
    """What every document shares with the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    """Statistics and verdict of every document."""
    found = quality_verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_jaccard_join")
def op9_jaccard_join(spark, sf_dir):
    """Every document with the component of near copies it belongs to."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    """What is left of every document without its 400-byte repeats."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


CLUSTER_SQL = r"""
WITH RECURSIVE kept AS (
    SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), vec AS (
    SELECT r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM kept
), start AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM vec
    QUALIFY c < 16
), centre(turn, c, x) AS (
    SELECT 0, c, x FROM start
    UNION ALL
    (
        WITH owned AS (
            SELECT vec.r, vec.x, arg_min(centre.c, struct_pack(
                       d := list_sum(list_transform(list_zip(vec.x, centre.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := centre.c)) AS c
            FROM vec, centre WHERE turn < 3 GROUP BY vec.r, vec.x
        ), parts AS (
            SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM owned
        ), sums AS (
            SELECT c, pos, sum(e)::BIGINT AS s, count(*) AS n FROM parts GROUP BY c, pos
        ), means AS (
            SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM sums GROUP BY c
        )
        SELECT turn + 1, centre.c, coalesce(means.x, centre.x) FROM centre LEFT JOIN means USING (c) WHERE turn < 3
    )
), final AS (
    SELECT c, x FROM centre WHERE turn = 3
), nearest AS (
    SELECT vec.r, vec.vec_id, min(struct_pack(
               d := list_sum(list_transform(list_zip(vec.x, final.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := final.c)) AS m
    FROM vec, final GROUP BY vec.r, vec.vec_id
)
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(final.x, ',')) AS centroid_sha256
FROM nearest JOIN final ON final.c = m.c
"""


@query("op11_centroid_clustering", CLUSTER_SQL)
def op11_centroid_clustering(spark, sf_dir):
    """The cluster of every embedding after three rounds, in whole numbers."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    """Whitened coordinates of every embedding on the leading components."""
    return whiten(table(spark, sf_dir, "embeddings"))[0]


@query("op13_quality_classifier")
def op13_quality_classifier(spark, sf_dir):
    """Probability of good quality for every document, by packed sizes."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
