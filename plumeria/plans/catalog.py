"""Planning and validation over a catalog derived from the star tables.

part = tensor, (part, supplier) of lineitem = variant, quantity = bytes, nation = device, region = tier.
"""

from __future__ import annotations

from .dialect import sql_query

VARIANTS = """variants AS (
  SELECT l_partkey AS tensor, l_suppkey AS shard, CAST(min(l_linenumber) AS BIGINT) AS ordinal, CAST(sum(l_quantity) AS BIGINT) AS bytes,
         CASE l_suppkey % 6 WHEN 0 THEN 'canonical' WHEN 1 THEN 'cpu_generic' WHEN 2 THEN 'cpu_avx2' WHEN 3 THEN 'wgpu' WHEN 4 THEN 'cuda' ELSE 'vulkan' END AS target,
         CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS penalty, CASE WHEN l_suppkey % 7 = 0 THEN 4096 ELSE 64 END AS align
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""
#: Base scores of targets in mixed mode, with AVX2 and a CUDA device present.
SCORES = "scores AS (SELECT * FROM (VALUES ('canonical', 7), ('cpu_generic', 18), ('cpu_avx2', 23), ('wgpu', 24), ('cuda', 26), ('vulkan', 0)) AS t(target, base))"


@sql_query
def variant_select(d):
    """The best variant of each tensor: base score, less 10000 where the alignment is too large, less the encoding penalty."""
    return f"""
WITH {VARIANTS}, {SCORES}, s AS (SELECT v.*, base - (CASE WHEN align > 256 THEN 10000 ELSE 0 END) - penalty AS score FROM variants v JOIN scores c ON c.target = v.target),
r AS (SELECT *, row_number() OVER (PARTITION BY tensor ORDER BY score DESC, penalty, align, ordinal, shard) AS r FROM s)
SELECT tensor, shard, target, CAST(score AS BIGINT) AS score FROM r WHERE r = 1"""


@sql_query
def variant_select_tier(d):
    """As variant_select, within the tensor's variants of the wanted tier where there are any."""
    return f"""
WITH {VARIANTS}, {SCORES}, s AS (
  SELECT v.*, base - (CASE WHEN align > 256 THEN 10000 ELSE 0 END) - penalty AS score, CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS fits
  FROM variants v JOIN scores c ON c.target = v.target JOIN supplier ON s_suppkey = v.shard JOIN nation ON n_nationkey = s_nationkey),
t AS (SELECT *, max(fits) OVER (PARTITION BY tensor) AS any_fits FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY tensor ORDER BY score DESC, penalty, align, ordinal, shard) AS r FROM t WHERE fits = any_fits)
SELECT tensor, shard, target, CAST(fits AS BIGINT) AS in_tier FROM r WHERE r = 1"""


@sql_query
def variant_by_target(d):
    """A target's variant of each tensor, or the first variant as a fallback."""
    return f"""
WITH {VARIANTS}, r AS (SELECT *, row_number() OVER (PARTITION BY tensor ORDER BY CASE WHEN target = 'cuda' THEN 0 ELSE 1 END, ordinal, shard) AS r FROM variants)
SELECT tensor, shard, target = 'cuda' AS found FROM r WHERE r = 1"""


@sql_query
def distinct_targets(d):
    """Distinct targets of each tensor in order of first appearance."""
    return f"""
WITH {VARIANTS}, f AS (SELECT tensor, target, min(ordinal * 1000000 + shard) AS first FROM variants GROUP BY tensor, target)
SELECT tensor, {d.list('target', 'first')} AS targets FROM f GROUP BY tensor"""


def _placement(nations: str) -> str:
    return f"""
WITH {VARIANTS}
SELECT v.tensor, v.shard, n_name AS device, r_name AS tier, CASE WHEN s_suppkey IS NULL THEN 'no shard' WHEN n_nationkey IS NULL THEN 'no device' ELSE 'ok' END AS status
FROM variants v LEFT JOIN supplier ON s_suppkey = v.shard LEFT JOIN nation ON n_nationkey = s_nationkey{nations} LEFT JOIN region ON r_regionkey = n_regionkey"""


@sql_query
def placement_resolve(d):
    """tensor -> shard (supplier) -> device (nation) -> tier (region), with missing steps told; nations from 20 on count as missing (placement_resolve_all has all)."""
    return _placement(" AND n_nationkey < 20")


@sql_query
def placement_resolve_all(d):
    """As placement_resolve, over all nations."""
    return _placement("")


@sql_query
def transfer_plan(d):
    """Bytes to move to each device by kind of step, and what is unsupported."""
    return f"""
WITH {VARIANTS}, p AS (SELECT n_name AS device, bytes, CASE n_regionkey WHEN 0 THEN 'resident' WHEN 1 THEN 'upload' WHEN 2 THEN 'stage' WHEN 3 THEN 'stream' ELSE 'unsupported' END AS step
  FROM variants JOIN supplier ON s_suppkey = shard JOIN nation ON n_nationkey = s_nationkey)
SELECT device, step, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(CASE WHEN step = 'unsupported' THEN 1 ELSE 0 END) AS BIGINT) AS unsupported FROM p GROUP BY device, step"""


@sql_query
def residency_totals(d):
    """Bytes, tensors and shards that each device and tier hold."""
    return f"""
WITH {VARIANTS}
SELECT r_name AS tier, n_name AS device, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT tensor) AS tensors, count(DISTINCT shard) AS shards
FROM variants JOIN supplier ON s_suppkey = shard JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name"""


@sql_query
def moe_index(d):
    """Tensors by (layer, expert, role), names in catalog order."""
    return f"""
SELECT CAST(p_size % 4 AS BIGINT) AS layer, p_brand AS expert, p_type AS role, min(p_partkey) AS first, count(*) AS n, {d.list('p_name', 'p_partkey')} AS names FROM part GROUP BY p_size % 4, p_brand, p_type"""


@sql_query
def adapter_index(d):
    """Adapters by name with conflicts of rank (more than one value) and the effective scale alpha / rank."""
    return """
SELECT p_brand AS adapter, count(*) AS n, CAST(min(p_size) AS BIGINT) AS rank, count(DISTINCT p_size) > 1 AS rank_conflict, count(DISTINCT p_type) > 1 AS kind_conflict,
  round(CASE WHEN min(p_size) > 0 THEN 16.0 / min(p_size) END, 6) AS scale FROM part GROUP BY p_brand"""


@sql_query
def prefetch_index(d):
    """Prefetch groups with their distinct affinity words in order of first appearance."""
    return f"""
WITH t AS (SELECT p_size AS grp, p_partkey, w, pos FROM (SELECT p_size, p_partkey, substring(p_name, 1, strpos(p_name, ' ') - 1) AS w, 1 AS pos FROM part UNION ALL
  SELECT p_size, p_partkey, substring(p_name, strpos(p_name, ' ') + 1, 100) AS w, 2 AS pos FROM part) x),
f AS (SELECT grp, w, min(p_partkey * 10 + pos) AS first FROM t GROUP BY grp, w)
SELECT CAST(grp AS BIGINT) AS grp, {d.list('w', 'first')} AS affinity FROM f GROUP BY grp""".replace("strpos", "instr")


def _validate(documents: str) -> str:
    return f"""
WITH e AS (SELECT doc_id, quality FROM labels), a AS (SELECT doc_id, CASE WHEN n_chars > 100 THEN 1 ELSE 0 END AS quality FROM documents{documents})
SELECT COALESCE(e.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' WHEN e.quality <> a.quality THEN 'differs' ELSE 'ok' END AS issue
FROM e FULL OUTER JOIN a ON e.doc_id = a.doc_id"""


@sql_query
def state_dict_validate(d):
    """Expected labels against actual documents: missing, unexpected, and wrong values, as a full outer join; two of three documents (state_dict_validate_all has all)."""
    return _validate(" WHERE doc_id % 3 <> 0")


@sql_query
def state_dict_validate_all(d):
    """As state_dict_validate, over all documents."""
    return _validate("")


def _key_differences(orders: str) -> str:
    return f"""
SELECT 'childless' AS kind, o_orderkey AS k FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) x
UNION ALL SELECT 'orphan' AS kind, l_orderkey AS k FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders{orders}) y"""


@sql_query
def unexpected_keys(d):
    """Keys of lineitem's orders that orders lacks, and the other way round, as set differences; four of five orders (unexpected_keys_all has all)."""
    return _key_differences(" WHERE o_orderkey % 5 <> 0")


@sql_query
def unexpected_keys_all(d):
    """As unexpected_keys, over all orders."""
    return _key_differences("")


LAYOUT = """sections AS (SELECT o_custkey AS file, o_orderkey AS ordinal, CAST(floor(o_totalprice) AS BIGINT) AS len, CASE WHEN o_orderkey % 4 = 0 THEN 4096 ELSE 64 END AS align FROM orders)"""


@sql_query
def aligned_offsets(d):
    """Running offsets of sections aligned to 64 bytes within each file."""
    return f"""
WITH {LAYOUT}, p AS (SELECT *, CAST(floor((len + 63) / 64) AS BIGINT) * 64 AS padded FROM sections)
SELECT file, ordinal, len, CAST(sum(padded) OVER (PARTITION BY file ORDER BY ordinal ROWS UNBOUNDED PRECEDING) - padded AS BIGINT) AS start FROM p"""


@sql_query
def section_overlap_check(d):
    """Sections that are empty, misaligned, past the end of the file or overlap the one before."""
    return f"""
WITH {LAYOUT}, s AS (SELECT *, ordinal * 7919 % 9000000 AS start FROM sections), l AS (SELECT *, lag(start + len) OVER (PARTITION BY file ORDER BY start, ordinal) AS before FROM s)
SELECT file, ordinal, CASE WHEN len = 0 THEN 'empty' WHEN start + len > 9000000 THEN 'past the end' WHEN start % 2 <> 0 THEN 'misaligned' WHEN before > start THEN 'overlap' END AS issue
FROM l WHERE len = 0 OR start + len > 9000000 OR start % 2 <> 0 OR before > start"""


@sql_query
def manifest_violations(d):
    """Names that occur twice, and variants whose shard is not in the catalog, with their counts."""
    return f"""
WITH {VARIANTS}
SELECT 'duplicate name' AS rule, p_name AS subject, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'misaligned' AS rule, target AS subject, count(*) AS n FROM variants WHERE bytes % 4 <> 0 GROUP BY target
UNION ALL SELECT 'unknown shard' AS rule, CAST(v.shard AS STRING) AS subject, count(*) AS n FROM variants v WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = v.shard AND s.s_acctbal > 0) GROUP BY v.shard"""


@sql_query
def content_dedup(d):
    """The first row of each payload (by digest and length) keeps it; the others point to it."""
    return """
WITH h AS (SELECT doc_id, sha256(text) AS digest, length(text) AS len FROM documents), f AS (SELECT digest, len, min(doc_id) AS first, count(*) AS n FROM h GROUP BY digest, len)
SELECT h.doc_id, f.first AS stored_at, h.doc_id = f.first AS stored FROM h JOIN f ON f.digest = h.digest AND f.len = h.len""" if d.__class__.__name__ == "Duck" else """
WITH h AS (SELECT doc_id, sha2(text, 256) AS digest, length(text) AS len FROM documents), f AS (SELECT digest, len, min(doc_id) AS first, count(*) AS n FROM h GROUP BY digest, len)
SELECT h.doc_id, f.first AS stored_at, h.doc_id = f.first AS stored FROM h JOIN f ON f.digest = h.digest AND f.len = h.len"""


@sql_query
def inspect_summary(d):
    """Counts of a catalog: tensors, variants, devices, tiers, bytes."""
    return f"""
WITH {VARIANTS}
SELECT (SELECT count(*) FROM part) AS tensors, (SELECT count(*) FROM variants) AS variants, (SELECT count(*) FROM nation) AS devices, (SELECT count(*) FROM region) AS tiers, (SELECT CAST(sum(bytes) AS BIGINT) FROM variants) AS bytes"""


@sql_query
def element_count(d):
    """Elements and bytes of tensors of shape (size, size, key mod 7) by type width."""
    return "SELECT p_partkey, CAST(p_size AS BIGINT) * p_size * (p_partkey % 7) AS elements, CAST(p_size AS BIGINT) * p_size * (p_partkey % 7) * (CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END) AS bytes FROM part"


@sql_query
def partition_set_validation(d):
    """Sets of partitions (an order's lines): count, duplicates, and gaps in their numbers."""
    return """
SELECT l_orderkey AS grp, count(*) AS n, count(*) <> count(DISTINCT l_linenumber) AS duplicate, CAST(max(l_linenumber) AS BIGINT) <> count(DISTINCT l_linenumber) AS gap,
  min(l_linestatus) = max(l_linestatus) AS one_axis FROM lineitem GROUP BY l_orderkey"""


@sql_query
def gguf_meta_typing(d):
    """Types of metadata strings: array, bool, int, float or string."""
    m = "(SELECT event_id, CASE event_id % 6 WHEN 0 THEN '[1,2]' WHEN 1 THEN 'true' WHEN 2 THEN CAST(user_id AS STRING) WHEN 3 THEN CAST(CAST(value AS DECIMAL(12,2)) AS STRING) WHEN 4 THEN event_type ELSE 'false' END AS m FROM events)"
    return f"""
SELECT event_id, CASE WHEN m LIKE '[%' THEN 'array' WHEN m IN ('true', 'false') THEN 'bool' WHEN try_cast(m AS BIGINT) IS NOT NULL AND m NOT LIKE '%.%' THEN 'int' WHEN try_cast(m AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS kind FROM {m} x"""
