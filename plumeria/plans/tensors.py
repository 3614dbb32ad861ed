"""Codecs, tensor mathematics, routing and attention as relational queries over the embeddings in long form.

(vec_id, label, dim, v) is one row for each element; the label stands for an expert or group, 32 dimensions for a block,
8 dimensions for a head.
"""

from __future__ import annotations

from .dialect import sql_query


def f16(d, x: str) -> str:
    """A positive number rounded to half precision, nearest even."""
    e = f"greatest(floor(log2({x})), -14)"
    return f"({d.even(f'{x} / power(2, {e} - 10)')} * power(2, {e} - 10))"


def f32div(a: str, b: str) -> str:
    return f"CAST(CAST({a} AS DOUBLE) / {b} AS FLOAT)"


def _absmax_blocks(d, divisor: float, width: int = 32) -> str:
    scale = f"CAST(max(abs(v)) OVER (PARTITION BY vec_id, CAST(floor(dim / {width}) AS INT)) / {divisor} AS FLOAT)"
    return f"(SELECT vec_id, label, dim, CAST(floor(dim / {width}) AS INT) AS blk, v, CASE WHEN {scale} = 0 THEN 1 ELSE {scale} END AS s FROM {d.emb})"


@sql_query
def q8_0_block_stats(d):
    """Q8_0 over blocks of 32: scale max/127, half away from zero, kept in half precision; error by label."""
    return f"""
WITH b AS (SELECT *, greatest(-127, least(127, round(CAST({f32div('v', 's')} AS DOUBLE)))) AS q, {f16(d, 'CAST(s AS DOUBLE)')} AS s16 FROM {_absmax_blocks(d, 127)} x)
SELECT CAST(label AS BIGINT) AS label, count(*) AS n, CAST(sum(q) AS BIGINT) AS sum_q, round(max(abs(v - q * s16)), 6) AS max_err FROM b GROUP BY label"""


@sql_query
def q4_0_roundtrip_error(d):
    """Q4_0: scale max/8, clamp -8..7, nibbles plus 8."""
    return f"""
WITH b AS (SELECT *, greatest(-8, least(7, round(CAST({f32div('v', 's')} AS DOUBLE)))) AS q, {f16(d, 'CAST(s AS DOUBLE)')} AS s16 FROM {_absmax_blocks(d, 8)} x)
SELECT CAST(label AS BIGINT) AS label, CAST(sum(q + 8) AS BIGINT) AS sum_nibbles, round(max(abs(v - q * s16)), 6) AS max_err, round(avg(abs(v - q * s16)), 6) AS mean_err FROM b GROUP BY label"""


@sql_query
def q3_k_roundtrip_error(d):
    """The 3-bit layout with one scale a block: scale max/4, clamp -4..3 (a block is the vector here)."""
    return f"""
WITH b AS (SELECT *, greatest(-4, least(3, round(CAST({f32div('v', 's')} AS DOUBLE)))) AS q, {f16(d, 'CAST(s AS DOUBLE)')} AS s16 FROM {_absmax_blocks(d, 4, 256)} x)
SELECT vec_id, CAST(sum(q + 4) AS BIGINT) AS sum_codes, round(max(abs(v - q * s16)), 6) AS max_err FROM b GROUP BY vec_id"""


#: Fixed values of the NF4 format, as decoders must have them.
NF4 = [
    -1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453, -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0,
    0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224, 0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0,
]


@sql_query
def nf4_nearest_level(d):
    """NF4: the first of the nearest levels of each element over its block's largest magnitude: how many midpoints of levels it is past."""
    level = " + ".join(f"CASE WHEN x > {(p + q) / 2!r} THEN 1 ELSE 0 END" for p, q in zip(NF4, NF4[1:]))
    return f"""
WITH b AS (SELECT label, CAST({f32div('v', 's')} AS DOUBLE) AS x FROM {_absmax_blocks(d, 1)} z)
SELECT CAST(label AS BIGINT) AS label, CAST(level AS BIGINT) AS level, count(*) AS n FROM (SELECT label, {level} AS level FROM b) n GROUP BY label, level"""


@sql_query
def fp8_e4m3_decode_table(d):
    """All 256 values of FP8 E4M3: no infinities, NaN at the all-ones code."""
    return f"""
SELECT CAST(id AS BIGINT) AS code, CASE WHEN id % 128 = 127 THEN NULL ELSE (CASE WHEN id >= 128 THEN -1 ELSE 1 END) *
  CASE WHEN CAST(floor(id / 8) AS INT) % 16 = 0 THEN (id % 8) * power(2, -9) ELSE (1 + (id % 8) / 8.0) * power(2, CAST(floor(id / 8) AS INT) % 16 - 7) END END AS value FROM {d.range(256)} r"""


@sql_query
def fp8_e5m2_decode_table(d):
    """All 256 values of FP8 E5M2; infinities and NaN are null, told apart by kind."""
    return f"""
SELECT CAST(id AS BIGINT) AS code, CASE WHEN id % 128 = 124 THEN 'inf' WHEN id % 128 > 124 THEN 'nan' ELSE 'finite' END AS kind,
  CASE WHEN id % 128 >= 124 THEN NULL ELSE (CASE WHEN id >= 128 THEN -1 ELSE 1 END) *
  CASE WHEN CAST(floor(id / 4) AS INT) % 32 = 0 THEN (id % 4) * power(2, -16) ELSE (1 + (id % 4) / 4.0) * power(2, CAST(floor(id / 4) AS INT) % 32 - 15) END END AS value FROM {d.range(256)} r"""


@sql_query
def vec_dot_norm(d):
    """Dot product and cosine of each vector with the next."""
    return f"""
WITH e AS (SELECT * FROM {d.emb} z), n AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM e GROUP BY vec_id),
p AS (SELECT a.vec_id, sum(a.v * b.v) AS dot FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND b.dim = a.dim GROUP BY a.vec_id)
SELECT p.vec_id, round(dot, 5) AS dot, round(n.norm, 5) AS norm, round(dot / (n.norm * m.norm), 5) AS cosine FROM p JOIN n ON n.vec_id = p.vec_id JOIN n m ON m.vec_id = p.vec_id + 1"""


@sql_query
def rms_norm(d):
    """x / sqrt(mean(x^2) + 1e-6)."""
    return f"SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(v / sqrt(avg(v * v) OVER (PARTITION BY vec_id) + 1e-6), 5) AS y FROM {d.emb} e"


@sql_query
def linear_projection(d):
    """Each vector times an 8 x 64 weight matrix of the first eight vectors, as a join and a sum."""
    return f"""
WITH e AS (SELECT * FROM {d.emb} z), w AS (SELECT vec_id AS o, dim, v FROM e WHERE vec_id < 8)
SELECT e.vec_id, w.o, round(sum(e.v * w.v), 5) AS y FROM e JOIN w ON e.dim = w.dim GROUP BY e.vec_id, w.o"""


@sql_query
def silu_gate(d):
    """SwiGLU of a vector's halves: silu(first) * second."""
    return f"""
WITH e AS (SELECT * FROM {d.emb} z)
SELECT g.vec_id, CAST(g.dim AS BIGINT) AS dim, round(g.v / (1 + exp(-g.v)) * u.v, 6) AS y FROM e g JOIN e u ON u.vec_id = g.vec_id AND u.dim = g.dim + 32 WHERE g.dim < 32"""


@sql_query
def residual_add(d):
    """The sum of each vector and its successor, by element, summed over heads."""
    return f"""
WITH e AS (SELECT * FROM {d.emb} z)
SELECT a.vec_id, CAST(floor(a.dim / 8) AS BIGINT) AS head, round(sum(a.v + b.v), 5) AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND b.dim = a.dim GROUP BY a.vec_id, CAST(floor(a.dim / 8) AS BIGINT)"""


@sql_query
def residual_add_elements(d):
    """The sum of each vector and its successor, element by element."""
    return f"""
WITH e AS (SELECT * FROM {d.emb} z)
SELECT a.vec_id, CAST(a.dim AS BIGINT) AS dim, round(a.v + b.v, 6) AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND b.dim = a.dim"""


@sql_query
def softmax_stable(d):
    """Softmax over each vector with its maximum subtracted; its entropy and largest probability."""
    return f"""
WITH m AS (SELECT vec_id, v - max(v) OVER (PARTITION BY vec_id) AS x FROM {d.emb} e), p AS (SELECT vec_id, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM m)
SELECT vec_id, round(max(p), 6) AS top, round(-sum(p * ln(p)), 5) AS entropy FROM p GROUP BY vec_id"""


@sql_query
def argmax_first_vs_last(d):
    """Greedy choice keeps the last of equal maxima, the router the first; over values rounded so that ties occur."""
    return f"""
WITH e AS (SELECT vec_id, dim, round(v, 0) AS r FROM {d.emb} z), m AS (SELECT *, max(r) OVER (PARTITION BY vec_id) AS top FROM e)
SELECT vec_id, CAST(min(dim) AS BIGINT) AS first_max, CAST(max(dim) AS BIGINT) AS last_max FROM m WHERE r = top GROUP BY vec_id"""


def _routes(d, k: int) -> str:
    return f"""
WITH e AS (SELECT * FROM {d.emb} z), heads AS (SELECT label AS expert, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
router AS (SELECT h.expert, e.dim, e.v AS w FROM heads h JOIN e ON e.vec_id = h.vec_id),
score AS (SELECT e.vec_id, r.expert, round(sum(e.v * r.w), 6) AS score FROM e JOIN router r ON r.dim = e.dim GROUP BY e.vec_id, r.expert),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, expert) AS r FROM score),
top AS (SELECT vec_id, expert, score, r, max(score) OVER (PARTITION BY vec_id) AS m FROM ranked WHERE r <= {k}),
route AS (SELECT vec_id, expert, score, r, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY vec_id) AS weight FROM top)"""


@sql_query
def route_top1(d):
    """Top-1 router: the best dot product with a router row, lowest expert on ties."""
    return f"{_routes(d, 1)} SELECT vec_id, CAST(expert AS BIGINT) AS expert, score FROM route"


@sql_query
def route_topk_softmax(d):
    """Top-2 router with softmax weights."""
    return f"{_routes(d, 2)} SELECT vec_id, CAST(expert AS BIGINT) AS expert, CAST(r AS BIGINT) AS place, round(weight, 5) AS weight FROM route"


_EXPERT = "expert_out AS (SELECT route.vec_id, route.expert, route.weight, e.dim, e.v * (1 + route.expert) / (1 + exp(-e.v)) AS y FROM route JOIN e ON e.vec_id = route.vec_id)"


@sql_query
def moe_weighted_combine(d):
    """Expert outputs (a gate scaled by expert) summed with their weights for each token and dimension."""
    return f"{_routes(d, 2)}, {_EXPERT} SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(sum(weight * y), 5) AS y FROM expert_out GROUP BY vec_id, dim"


@sql_query
def moe_checked_diff(d):
    """Routed against unbatched: the largest difference of the two ways to sum, by label."""
    return f"""{_routes(d, 2)}, {_EXPERT},
a AS (SELECT vec_id, dim, sum(weight * y) AS y FROM expert_out GROUP BY vec_id, dim),
b AS (SELECT e.vec_id, e.label, e.dim, sum(t.weight * (1 + t.expert)) * e.v / (1 + exp(-e.v)) AS y FROM e JOIN route t ON t.vec_id = e.vec_id GROUP BY e.vec_id, e.label, e.dim, e.v)
SELECT CAST(label AS BIGINT) AS label, round(max(abs(a.y - b.y)), 6) AS max_diff, max(abs(a.y - b.y)) < 1e-6 AS within FROM a JOIN b ON a.vec_id = b.vec_id AND a.dim = b.dim GROUP BY label"""


@sql_query
def expert_ffn(d):
    """Each routed token through its expert: up and gate by dot products with two of the expert's vectors, silu, down by a third."""
    return f"""{_routes(d, 1)}, m AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
h AS (SELECT t.vec_id, t.expert, sum(CASE WHEN m.k = 1 THEN x.v * w.v ELSE 0 END) AS g, sum(CASE WHEN m.k = 2 THEN x.v * w.v ELSE 0 END) AS u
  FROM route t JOIN m ON m.label = t.expert AND m.k <= 2 JOIN e x ON x.vec_id = t.vec_id JOIN e w ON w.vec_id = m.vec_id AND w.dim = x.dim GROUP BY t.vec_id, t.expert)
SELECT h.vec_id, CAST(w.dim AS BIGINT) AS dim, round(g / (1 + exp(-g)) * u * w.v, 3) AS y FROM h JOIN m ON m.label = h.expert AND m.k = 3 JOIN e w ON w.vec_id = m.vec_id"""


@sql_query
def batch_by_destination(d):
    """Tokens of each expert in order of arrival, experts by their first token."""
    return f"""{_routes(d, 1)} SELECT CAST(expert AS BIGINT) AS expert, min(vec_id) AS first_token, count(*) AS n, {d.list('CAST(vec_id AS STRING)', 'vec_id')} AS tokens FROM route GROUP BY expert"""


@sql_query
def all_reduce_sum(d):
    """Element-wise sum of all vectors of each label."""
    return f"SELECT CAST(label AS BIGINT) AS label, CAST(dim AS BIGINT) AS dim, round(sum(v), 4) AS total FROM {d.emb} e GROUP BY label, dim"


@sql_query
def partition_gather(d):
    """Row partitions of a vector put together again in partition order."""
    return f"""
WITH parts AS (SELECT vec_id, CAST(floor(dim / 16) AS INT) AS part, {d.list("CAST(CAST(round(v * 1000) AS BIGINT) AS STRING)", 'dim')} AS piece FROM {d.emb} e GROUP BY vec_id, CAST(floor(dim / 16) AS INT))
SELECT vec_id, count(*) AS n_parts, {d.list('piece', 'part')} AS whole FROM parts GROUP BY vec_id"""


@sql_query
def rope_rotate(d):
    """Rotary positions on adjacent pairs, position vec_id mod 32, base 10000, heads of 8."""
    return f"""
WITH e AS (SELECT vec_id, dim, v, vec_id % 32 AS pos, dim % 8 - dim % 2 AS twice FROM {d.emb} z),
p AS (SELECT a.vec_id, a.dim, a.v AS x, b.v AS y, a.pos * power(10000, -a.twice / 8.0) AS t FROM e a JOIN e b ON b.vec_id = a.vec_id AND b.dim = a.dim + 1 WHERE a.dim % 2 = 0)
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(x * cos(t) - y * sin(t), 5) AS even, round(x * sin(t) + y * cos(t), 5) AS odd FROM p"""


@sql_query
def causal_attention(d):
    """Causal attention of one head (8 dimensions) over sequences of 16 tokens (causal_attention_heads has all heads)."""
    return f"""
WITH e AS (SELECT vec_id, CAST(floor(vec_id / 16) AS BIGINT) AS seq, vec_id % 16 AS pos, dim, v FROM {d.emb} z WHERE dim < 8),
s AS (SELECT q.seq, q.pos AS q, k.pos AS k, sum(q.v * k.v) / sqrt(8) AS s FROM e q JOIN e k ON k.seq = q.seq AND k.dim = q.dim AND k.pos <= q.pos GROUP BY q.seq, q.pos, k.pos),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, q)) AS x FROM s), n AS (SELECT seq, q, k, x / sum(x) OVER (PARTITION BY seq, q) AS a FROM w)
SELECT n.seq, n.q AS pos, CAST(e.dim AS BIGINT) AS dim, round(sum(n.a * e.v), 5) AS y FROM n JOIN e ON e.seq = n.seq AND e.pos = n.k GROUP BY n.seq, n.q, e.dim"""


@sql_query
def causal_attention_heads(d):
    """Causal attention of every head (8 dimensions) over sequences of 16 tokens."""
    return f"""
WITH e AS (SELECT CAST(floor(vec_id / 16) AS BIGINT) AS seq, vec_id % 16 AS pos, CAST(floor(dim / 8) AS INT) AS head, dim % 8 AS i, v FROM {d.emb} z),
s AS (SELECT q.seq, q.head, q.pos AS q, k.pos AS k, sum(q.v * k.v) / sqrt(8) AS s FROM e q JOIN e k ON k.seq = q.seq AND k.head = q.head AND k.i = q.i AND k.pos <= q.pos GROUP BY q.seq, q.head, q.pos, k.pos),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, head, q)) AS x FROM s), n AS (SELECT seq, head, q, k, x / sum(x) OVER (PARTITION BY seq, head, q) AS a FROM w)
SELECT n.seq, n.q AS pos, CAST(n.head AS BIGINT) AS head, CAST(e.i AS BIGINT) AS i, round(sum(n.a * e.v), 5) AS y FROM n JOIN e ON e.seq = n.seq AND e.pos = n.k AND e.head = n.head GROUP BY n.seq, n.q, n.head, e.i"""


@sql_query
def gqa_attention_tokens(d):
    """Grouped-query attention, causal: 8 query heads share 2 key and value heads (head / 4), every token of sequences of 16."""
    return f"""
WITH e AS (SELECT CAST(floor(vec_id / 16) AS BIGINT) AS seq, vec_id % 16 AS pos, CAST(floor(dim / 8) AS INT) AS head, dim % 8 AS i, v FROM {d.emb} z),
s AS (SELECT q.seq, q.head, q.pos AS q, k.pos AS k, sum(q.v * k.v) / sqrt(8) AS s FROM e q JOIN e k ON k.seq = q.seq AND k.i = q.i AND k.head = CAST(floor(q.head / 4) AS INT) AND k.pos <= q.pos GROUP BY q.seq, q.head, q.pos, k.pos),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, head, q)) AS x FROM s), n AS (SELECT seq, head, q, k, x / sum(x) OVER (PARTITION BY seq, head, q) AS a FROM w)
SELECT n.seq, n.q AS pos, CAST(n.head AS BIGINT) AS head, CAST(e.i AS BIGINT) AS i, round(sum(n.a * e.v), 5) AS y FROM n JOIN e ON e.seq = n.seq AND e.pos = n.k AND e.head = CAST(floor(n.head / 4) AS INT) GROUP BY n.seq, n.q, n.head, e.i"""


@sql_query
def gqa_attention(d):
    """Grouped-query attention: 8 query heads share 2 key and value heads (head / 4), last token of each sequence of 16 (gqa_attention_tokens has all)."""
    return f"""
WITH e AS (SELECT CAST(floor(vec_id / 16) AS BIGINT) AS seq, vec_id % 16 AS pos, CAST(floor(dim / 8) AS INT) AS head, dim % 8 AS i, v FROM {d.emb} z),
s AS (SELECT q.seq, q.head, k.pos AS k, sum(q.v * k.v) / sqrt(8) AS s FROM e q JOIN e k ON k.seq = q.seq AND k.i = q.i AND k.head = CAST(floor(q.head / 4) AS INT) WHERE q.pos = 15 GROUP BY q.seq, q.head, k.pos),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, head)) AS x FROM s), n AS (SELECT seq, head, k, x / sum(x) OVER (PARTITION BY seq, head) AS a FROM w)
SELECT n.seq, CAST(n.head AS BIGINT) AS head, CAST(e.i AS BIGINT) AS i, round(sum(n.a * e.v), 5) AS y FROM n JOIN e ON e.seq = n.seq AND e.pos = n.k AND e.head = CAST(floor(n.head / 4) AS INT) GROUP BY n.seq, n.head, e.i"""


@sql_query
def repetition_penalty(d):
    """Logits of tokens seen before are divided (positive) or multiplied (negative) by 1.3 once for each occurrence."""
    return f"""
WITH seen AS (SELECT vec_id, dim, (vec_id * 7 + dim) % 3 AS times FROM {d.emb} z)
SELECT e.vec_id, CAST(e.dim AS BIGINT) AS dim, round(CASE WHEN e.v > 0 THEN e.v / power(1.3, s.times) ELSE e.v * power(1.3, s.times) END, 6) AS logit FROM {d.emb} e JOIN seen s ON s.vec_id = e.vec_id AND s.dim = e.dim"""


@sql_query
def nucleus_top_p(d):
    """Nucleus of 0.5: the shortest run of likeliest tokens whose mass reaches it, renormalised."""
    return f"""
WITH m AS (SELECT vec_id, dim, v - max(v) OVER (PARTITION BY vec_id) AS x FROM {d.emb} e), p AS (SELECT vec_id, dim, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 9) AS p FROM m),
c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, dim ROWS UNBOUNDED PRECEDING) - p AS before FROM p)
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(p / sum(p) OVER (PARTITION BY vec_id), 5) AS p FROM c WHERE before < 0.5"""


@sql_query
def inverse_cdf_draw(d):
    """A draw for each vector: the first token whose cumulative probability reaches it, else the last."""
    return f"""
WITH m AS (SELECT vec_id, dim, v - max(v) OVER (PARTITION BY vec_id) AS x FROM {d.emb} e), p AS (SELECT vec_id, dim, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM m),
c AS (SELECT *, round(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, dim ROWS UNBOUNDED PRECEDING), 9) AS upto, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, dim) AS r FROM p)
SELECT vec_id, CAST(COALESCE(min(CASE WHEN upto >= ((vec_id * 37) % 101) / {d.double('101.0')} THEN r END), max(r)) AS BIGINT) AS place FROM c GROUP BY vec_id"""


@sql_query
def max_abs_diff(d):
    """Reference check: count, largest difference and tolerance of each vector against its half-precision-like rounding."""
    return f"SELECT vec_id, count(*) AS n, round(max(abs(v - round(v, 2))), 6) AS max_diff, max(abs(v - round(v, 2))) <= 0.005001 AS passed FROM {d.emb} e GROUP BY vec_id"
