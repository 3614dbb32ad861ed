"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import document_languages, page_languages
from .media import document_media, page_items
from .mixing import MIX_SQL, mix_sources
from .ngram_join import ngram_jaccard_join
from .passages import dedup_passages
from .pieces import encode_documents
from .quality import score_quality
from .spotsigs import compare_edited, spotsigs_join
from .store import table
from .toxicity import score_toxicity
from .warc import archive_pages


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labelled ones that are not held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that an earlier document's 50-byte strings cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs, k=50, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives of one gzip stream, normalised to one member a record, and read back by the index."""
    return archive_pages(table(spark, sf_dir, "pages"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as stored images, shown in interleaved pages and resolved by digest."""
    return document_media(table(spark, sf_dir, "documents"))


def op5b_page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and media references of all pages, in order."""
    return page_items(table(spark, sf_dir, "pages"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, decoded again to check them."""
    return encode_documents(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents from text, declared tag and source."""
    return document_languages(table(spark, sf_dir, "documents")).select("doc_id", "declared", "host", "language", "posterior", "gain", "accepted")


def op7b_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages from text, html tag, address suffix and host."""
    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of all documents, their edited texts and their likeness."""
    return compare_edited(table(spark, sf_dir, "documents"))


def op8b_spotsigs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose SpotSigs have a Jaccard similarity of 0.8 or more."""
    out = spotsigs_join(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_shingles").alias("n_spots"), "component_id", "n_links")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by weights 5, 2, 1 over the sources."""
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by co-training, learnt from the labelled ones that are not held out."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_passages, op3_ngram_join, op4_warc, op5_media, op5b_page_items, op6_pieces, op7_language, op7b_page_language, op8_spotsigs,
        op8b_spotsigs_join, op9_mixing, op10_quality,
    )
}

#: Windows of 50 bytes as hexadecimal, their least document by a hash of 64 bits, and runs of those that an earlier document has.
PASSAGES_SQL = """WITH t AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS x FROM documents), n AS (SELECT doc_id, x, length(x) // 2 AS n FROM t),
b AS (SELECT doc_id, j, substr(x, 1000 * j + 1, 1098) AS y FROM (SELECT doc_id, x, unnest(range(0, (2 * n) // 1000 + 1)) AS j FROM n) z),
q AS (SELECT doc_id, j, y, unnest(range(0, least(500, length(y) // 2 - 49))) AS i FROM b WHERE length(y) >= 100),
w AS (SELECT doc_id, 500 * j + i AS i, md5_number_lower(substr(y, 2 * i + 1, 100)) AS h FROM q),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
g AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS p FROM w JOIN f ON f.h = w.h WHERE f.first < w.doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM k GROUP BY doc_id, run),
o AS (SELECT doc_id, s, e, COALESCE(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM r),
a AS (SELECT o.doc_id, count(*) AS spans, sum(e - s) AS removed, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head, max(e) AS last FROM o JOIN n ON n.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(COALESCE(removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(COALESCE(head, '') || substr(x, 2 * COALESCE(last, 0) + 1))) AS kept_sha256 FROM n LEFT JOIN a ON a.doc_id = n.doc_id"""

#: Shingles by a hash of 64 bits, pairs of sizes that can be linked, and what their links reach.
JOIN_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, md5_number_lower(unnest(s)) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON b.g = a.g AND b.doc_id > a.doc_id AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c WHERE 100 * common >= 90 * (na + nb - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS links FROM u GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, COALESCE(m.root, s.doc_id) AS component_id, CAST(COALESCE(k.links, 0) AS BIGINT) AS n_links FROM s LEFT JOIN m ON m.doc_id = s.doc_id LEFT JOIN k ON k.doc_id = s.doc_id"""

#: Base 32 from the digest's hexadecimal, 20 bits at a time.
ARCHIVE_SQL = """WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages), h AS (SELECT page_id, sha1(html) AS h, strlen(html) AS n FROM p),
f AS (SELECT h, min(page_id) AS first FROM h GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || substr(h.h, g * 5 + 1, 5) AS INTEGER) >> s) & 31)]), 'string_agg', '')), 'string_agg', '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f ON f.h = h.h"""

ORACLE = {
    "op2_passages": PASSAGES_SQL,
    "op3_ngram_join": JOIN_SQL,
    "op4_warc": ARCHIVE_SQL,
    "op9_mixing": f"SELECT doc_id, size, source_size, target, taken FROM ({MIX_SQL.format(docs='documents')})",
}
