"""Normalising, pre-tokenising, word-level encoding, templates and chat rendering as queries."""

from __future__ import annotations

from .dialect import sql_query


@sql_query
def lowercase_normalise(d):
    """Lower case, and runs of white space as one space."""
    return r"SELECT doc_id, length(n) AS n_chars, md5(n) AS digest FROM (SELECT doc_id, regexp_replace(lower(text), '[ \t\n]+', ' '" + (", 'g'" if d.__class__.__name__ == "Duck" else "") + ") AS n FROM documents) x"


def _pieces(d, text: str, pattern: str) -> str:
    """The list of a text's matches; null for a null text."""
    if d.__class__.__name__ == "Duck":
        return f"regexp_extract_all({text}, '{pattern}')"
    return f"regexp_extract_all({text}, '{pattern.replace(chr(92), chr(92) * 2)}', 0)"


def _size(d, x: str) -> str:
    return f"CAST(COALESCE(len({x}), 0) AS BIGINT)" if d.__class__.__name__ == "Duck" else f"CAST(COALESCE(size({x}), 0) AS BIGINT)"


def _distinct(d, x: str) -> str:
    return f"list_distinct({x})" if d.__class__.__name__ == "Duck" else f"array_distinct({x})"


@sql_query
def pretokenize_whitespace(d):
    """Words between white space: how many, and how many different ones, in each document, those without words included."""
    w = _pieces(d, "text", "[^ \\n]+")
    return f"SELECT doc_id, {_size(d, w)} AS n, {_size(d, _distinct(d, w))} AS different FROM documents"


@sql_query
def pretokenize_punct(d):
    """Runs of ASCII marks, each mark apart."""
    return f"SELECT doc_id, w AS mark, count(*) AS n FROM {d.words('doc_id', 'documents', '[.,;:!?|#%&*$]')} w GROUP BY doc_id, w"


@sql_query
def digits_split(d):
    """Runs of digits."""
    return f"SELECT doc_id, count(*) AS n, max(length(w)) AS longest FROM {d.words('doc_id', 'documents', '[0-9]+')} w GROUP BY doc_id"


@sql_query
def wordlevel_encode(d):
    """Word-level ids: words of the benchmark by frequency are the vocabulary, others are unknown (0)."""
    return f"""
WITH v AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS id FROM (SELECT w, count(*) AS n FROM {d.words('item_id', 'benchmark', '[^ \\n]+')} b GROUP BY w) c),
t AS (SELECT * FROM {d.words('doc_id', 'documents', '[^ \\n]+')} w)
SELECT doc_id, count(*) AS n, CAST(sum(COALESCE(v.id, 0)) AS BIGINT) AS sum_ids, CAST(sum(CASE WHEN v.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM t LEFT JOIN v ON v.w = t.w GROUP BY doc_id"""


@sql_query
def digit_runs(d):
    """Every document's runs of digits and of other characters, in order, as one text."""
    pieces = _pieces(d, "text", "[0-9]+|[^0-9]+")
    joined = f"array_to_string({pieces}, '|')" if d.__class__.__name__ == "Duck" else f"array_join({pieces}, '|')"
    return f"SELECT doc_id, {_size(d, pieces)} AS n, md5(COALESCE({joined}, '')) AS pieces FROM documents"


@sql_query
def punctuation_pieces(d):
    """Every document's words and ASCII marks, each mark apart, in order."""
    pieces = _pieces(d, "text", r"[!-/:-@\[-`{-~]|[^ \t\n\r!-/:-@\[-`{-~]+")
    joined = f"array_to_string({pieces}, ' ')" if d.__class__.__name__ == "Duck" else f"array_join({pieces}, ' ')"
    return f"SELECT doc_id, {_size(d, pieces)} AS n, md5(COALESCE({joined}, '')) AS pieces FROM documents"


@sql_query
def special_token_isolation(d):
    """Special tokens in text, the longer of two that start at one place first."""
    return f"SELECT doc_id, w AS special, count(*) AS n FROM {d.words('doc_id', 'documents', 'the end|the|and')} w GROUP BY doc_id, w"


@sql_query
def chat_render(d):
    """Conversations as one prompt, turns in order, with role marks and a mark for the answer to come."""
    return f"""
SELECT conv_id, count(*) AS turns, md5({d.list("concat('<|', role, '|>', trim(text), '<|end|>')", 'turn')}) AS prompt FROM conversations GROUP BY conv_id"""


@sql_query
def post_process_template(d):
    """Pairs of a question and its answer in a template [CLS] a [SEP] b [SEP], with their lengths in words."""
    return """
SELECT a.conv_id, a.turn, md5(concat('[CLS] ', a.text, ' [SEP] ', b.text, ' [SEP]')) AS pair, length(a.text) + length(b.text) + 18 AS n_chars
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0"""
