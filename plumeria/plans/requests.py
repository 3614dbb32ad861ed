"""Requests as a log (events): order, admission, pressure, deadlines, tenants and batches."""

from __future__ import annotations

from .dialect import sql_query


@sql_query
def priority_dispatch(d):
    """Dispatch order: priority (from the value) descending, then arrival; each graph has its queue."""
    return "SELECT event_id, event_type AS graph, row_number() OVER (PARTITION BY event_type ORDER BY CAST(floor(value / 10) AS INT) DESC, event_id) AS place FROM events"


@sql_query
def queued_bytes_pressure(d):
    """Queued bytes of each graph over its last 20 requests, and the pressure level."""
    q = "sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return f"SELECT event_id, CAST({q} AS BIGINT) AS queued, CASE WHEN {q} > 700 THEN 'hard' WHEN {q} > 400 THEN 'soft' ELSE 'normal' END AS level FROM events"


@sql_query
def deadline_expiry(d):
    """Requests dispatched ten places later in their queue that had expired by then."""
    return """
WITH q AS (SELECT event_id, event_type, ts, value, lead(event_id, 10) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run_after, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events)
SELECT event_id, CAST(place AS BIGINT) AS place, run_after IS NULL OR (run_after - event_id) > value * 4 AS expired FROM q"""


@sql_query
def tenant_metrics(d):
    """Requests, errors, bytes and the largest request of each tenant and graph."""
    return """
SELECT user_id AS tenant, event_type AS graph, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes, max(value) AS largest FROM events GROUP BY user_id, event_type"""


@sql_query
def tenant_quota(d):
    """Admission by tenant: at most three requests in each hour."""
    return """
WITH h AS (SELECT event_id, user_id, date_trunc('hour', ts) AS hour, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY ts, event_id) AS k FROM h)
SELECT event_id, user_id AS tenant, k <= 3 AS admitted FROM r"""


@sql_query
def batch_compatibility(d):
    """Runs of requests that could share a batch: same graph and priority, at most eight each."""
    return """
WITH r AS (SELECT event_id, event_type, CAST(floor(value / 10) AS BIGINT) AS priority, row_number() OVER (PARTITION BY event_type, CAST(floor(value / 10) AS INT) ORDER BY ts, event_id) AS k FROM events)
SELECT event_type AS graph, priority, CAST(floor((k - 1) / 8) AS BIGINT) AS batch, count(*) AS n, min(event_id) AS first FROM r GROUP BY event_type, priority, CAST(floor((k - 1) / 8) AS BIGINT)"""


@sql_query
def prefix_cache_report(d):
    """Lookups, hits and inserts of a cache whose keys are (tenant, graph)."""
    return """
WITH l AS (SELECT event_type, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 THEN 1 ELSE 0 END AS hit FROM events)
SELECT event_type AS graph, count(*) AS lookups, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(1 - hit) AS BIGINT) AS inserts FROM l GROUP BY event_type"""


@sql_query
def prefix_longest_match(d):
    """The longest of the prefixes of 2, 4, 8 or 16 characters that a document shares with a benchmark text (prefix_longest_match_whole has every length).

    Both sides are cut at the four lengths and joined on (length, prefix); a prefix has one row, with its least item.
    """
    lengths = "(SELECT 2 AS n UNION ALL SELECT 4 AS n UNION ALL SELECT 8 AS n UNION ALL SELECT 16 AS n)"
    return f"""
WITH p AS (SELECT n.n, substring(text, 1, n.n) AS pre, min(item_id) AS item FROM benchmark CROSS JOIN {lengths} n GROUP BY n.n, substring(text, 1, n.n)),
c AS (SELECT doc_id, n.n, substring(text, 1, n.n) AS pre FROM documents CROSS JOIN {lengths} n),
m AS (SELECT c.doc_id, p.n, p.item FROM c JOIN p ON p.n = c.n AND p.pre = c.pre),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item) AS r FROM m)
SELECT doc_id, CAST(n AS BIGINT) AS matched, item FROM r WHERE r = 1"""


@sql_query
def prefix_longest_match_whole(d):
    """The longest prefix of any benchmark text that each document begins with, of every length, and the least item that has it.

    Cached prefixes have one row each before the join. All shorter prefixes of a match match too, so lengths from 16 on are
    tried only for the documents that match at 16.
    """
    return f"""
WITH b AS (SELECT text, min(item_id) AS item FROM benchmark GROUP BY text),
p AS (SELECT n, substring(text, 1, n) AS pre, min(item) AS item FROM {d.numbers('text, item', 'b', 'CAST(1 AS BIGINT)', 'CAST(length(text) AS BIGINT)')} x GROUP BY n, substring(text, 1, n)),
c AS (SELECT d.doc_id, d.text, CAST(CASE WHEN p.n IS NULL THEN 1 ELSE 16 END AS BIGINT) AS low, CAST(CASE WHEN p.n IS NULL THEN least(15, length(d.text)) ELSE least(length(d.text), l.longest) END AS BIGINT) AS high
  FROM documents d LEFT JOIN p ON p.n = 16 AND p.pre = substring(d.text, 1, 16) CROSS JOIN (SELECT max(length(text)) AS longest FROM b) l),
m AS (SELECT x.doc_id, p.n, p.item FROM {d.numbers('doc_id, text', 'c', 'low', 'high')} x JOIN p ON p.n = x.n AND p.pre = substring(x.text, 1, x.n)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item) AS r FROM m)
SELECT doc_id, CAST(n AS BIGINT) AS matched, item FROM r WHERE r = 1"""
