"""Normalising, pre-tokenising and joining texts, as column expressions; specifications are those of tokenizer JSON files."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII marks, as a class of a regular expression.
MARKS = r"!-/:-@\[-`{-~"


def unicode_form(form: str):
    """A column function: NFC, NFD, NFKC or NFKD."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown Unicode form {form}")

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return run


@F.pandas_udf(T.StringType())
def strip_accents(x: pd.Series) -> pd.Series:
    """Texts decomposed, without combining marks."""
    return x.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c)[0] != "M"))


def lowercase(x: Column) -> Column:
    return F.lower(x)


def strip(x: Column, left: bool = True, right: bool = True) -> Column:
    """Without white space of any kind at the ends."""
    out = F.regexp_replace(x, r"^\p{IsWhite_Space}+", "") if left else x
    return F.regexp_replace(out, r"\p{IsWhite_Space}+$", "") if right else out


def replace(x: Column, pattern: str, content: str, is_regex: bool) -> Column:
    if is_regex:
        return F.regexp_replace(x, F.lit(pattern), F.lit(content))
    return F.replace(x, F.lit(pattern), F.lit(content)) if pattern else x


#: The blocks of Chinese characters that are set apart.
CHINESE = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"


def bert_normalise(x: Column, clean: bool = True, chinese: bool = True, accents: bool | None = None, lower: bool = True) -> Column:
    """Control characters removed, white space as a space, Chinese characters set apart, lower case, no accents."""
    if clean:
        x = F.regexp_replace(x, r"[\x00\x{FFFD}]|[\p{Cc}&&[^\t\n\r]]", "")
        x = F.regexp_replace(x, r"\p{IsWhite_Space}", " ")
    if chinese:
        x = F.regexp_replace(x, f"([{CHINESE}])", " $1 ")
    if lower:
        x = F.lower(x)
    return strip_accents(x) if (lower if accents is None else accents) else x


def normalise(x: Column, spec: dict | None) -> Column:
    """The text under a normaliser's specification ({"type": ...}); null or an absent one leaves it as it is."""
    if not spec:
        return x
    kind = spec["type"]
    if kind == "Sequence":
        for one in spec["normalizers"]:
            x = normalise(x, one)
        return x
    if kind == "Lowercase":
        return lowercase(x)
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return unicode_form(kind)(x)
    if kind == "StripAccents":
        return strip_accents(x)
    if kind == "Strip":
        return strip(x, spec.get("strip_left", True), spec.get("strip_right", True))
    if kind == "Replace":
        pattern = spec["pattern"]
        literal = pattern if isinstance(pattern, str) else pattern.get("String")
        return replace(x, pattern["Regex"] if literal is None else literal, spec["content"], literal is None)
    if kind == "BertNormalizer":
        return bert_normalise(x, spec.get("clean_text", True), spec.get("handle_chinese_chars", True), spec.get("strip_accents"), spec.get("lowercase", True))
    raise ValueError(f"unknown normaliser {kind}")


def _all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def _each(pieces: Column, spec: dict) -> Column:
    return F.flatten(F.transform(pieces, lambda p: pretokenise(p, spec)))


def pretokenise(x: Column, spec: dict | None) -> Column:
    """array<string>: the pieces of a text under a pre-tokeniser's specification; an absent one keeps the text whole."""
    if not spec:
        return F.array(x)
    kind = spec["type"]
    if kind == "Sequence":
        pieces = F.array(x)
        for one in spec["pretokenizers"]:
            pieces = _each(pieces, one)
        return pieces
    if kind in ("Whitespace", "BertPreTokenizer"):
        return _all(x, rf"(?U)[{MARKS}]|[^\s{MARKS}]+")
    if kind == "WhitespaceSplit":
        return _all(x, r"(?U)\S+")
    if kind == "ByteLevel":
        first = spec.get("add_prefix_space", True)
        return F.transform(_all(x, r"(?U)\S+"), lambda p, i: F.when((i == 0) & F.lit(not first), p).otherwise(F.concat(F.lit("Ġ"), p)))
    if kind == "Metaspace":
        mark = spec.get("replacement", "▁")
        out = F.regexp_replace(x, r"\p{IsWhite_Space}", re.escape(mark) if mark in "\\$" else mark)
        if spec.get("add_prefix_space", spec.get("prepend_scheme", "always") == "always"):
            out = F.when(F.startswith(out, F.lit(mark)), out).otherwise(F.concat(F.lit(mark), out))
        return F.array(out)
    if kind == "Punctuation":
        return _all(x, rf"[{MARKS}]|[^{MARKS}]+")
    if kind == "Digits":
        return _all(x, "[0-9]|[^0-9]+" if spec.get("individual_digits", False) else "[0-9]+|[^0-9]+")
    if kind == "CharDelimiterSplit":
        return F.filter(F.split(x, re.escape(spec["delimiter"])), lambda p: p != "")
    if kind == "Split":
        pattern = spec["pattern"]
        pattern = pattern if isinstance(pattern, str) else pattern.get("Regex", pattern.get("String"))
        return _all(x, pattern) if spec.get("invert", False) else F.filter(F.split(x, pattern), lambda p: p != "")
    raise ValueError(f"unknown pre-tokeniser {kind}")


def java_quote(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def isolate(x: Column, specials: list[str]) -> Column:
    """array<struct<text, special>>: special tokens apart from the text between them; of those that start first, the longest."""
    if not specials:
        return F.filter(F.array(F.struct(x.alias("text"), F.lit(False).alias("special"))), lambda s: s["text"] != "")
    longest = "|".join(java_quote(t) for t in sorted(specials, key=lambda t: (-len(t.encode()), t)))
    pieces = _all(x, f"(?s)(?:{longest})|(?:(?!{longest}).)+")
    return F.transform(pieces, lambda p: F.struct(p.alias("text"), p.isin(specials).alias("special")))


def join_tokens(tokens: Column, spec: dict | None, specials: list[str]) -> Column:
    """The text of array<string> tokens under a decoder's specification."""
    if not spec:
        return F.array_join(tokens, "")
    kind = spec["type"]
    if kind == "Sequence":
        for one in spec["decoders"]:
            tokens = F.array(join_tokens(tokens, one, specials))
        return F.array_join(tokens, "")
    if kind == "WordPiece":
        return join_wordpiece(tokens, spec.get("prefix", "##"), spec.get("cleanup", True))
    if kind == "ByteLevel":
        return join_bytelevel(tokens)
    if kind == "Metaspace":
        return join_metaspace(tokens, spec.get("replacement", "▁"))
    if kind == "BPEDecoder":
        suffix = spec.get("suffix", "</w>")
        return F.array_join(F.transform(tokens, lambda t: F.when(F.endswith(t, F.lit(suffix)), F.substring(t, F.lit(1), F.char_length(t) - len(suffix))).otherwise(t)), " ")
    if kind == "Fuse":
        return F.array_join(F.filter(tokens, lambda t: ~t.isin(specials)) if specials else tokens, "")
    if kind == "Strip":
        own = re.escape(spec.get("content", " "))
        out = F.regexp_replace(F.array_join(tokens, ""), f"^(?:{own}){{0,{spec.get('start', 0)}}}", "")
        return F.regexp_replace(out, f"(?:{own}){{1,{spec['stop']}}}$", "") if spec.get("stop") else out
    if kind == "Replace":
        pattern = spec["pattern"]
        return replace(F.array_join(tokens, ""), pattern if isinstance(pattern, str) else pattern["String"], spec["content"], False)
    raise ValueError(f"unknown decoder {kind}")


def _fold(tokens: Column, add) -> Column:
    return F.aggregate(tokens, F.lit(""), add)


def join_bytelevel(tokens: Column) -> Column:
    return _fold(tokens, lambda a, t: F.when(~F.startswith(t, F.lit("Ġ")), F.concat(a, t)).when(a == "", F.substring(t, 2, 1 << 30)).otherwise(F.concat(a, F.lit(" "), F.substring(t, 2, 1 << 30))))


def join_metaspace(tokens: Column, mark: str = "▁") -> Column:
    return F.regexp_replace(F.replace(F.array_join(tokens, ""), F.lit(mark), F.lit(" ")), r"^\p{IsWhite_Space}+", "")


#: What the clean-up of word pieces joins, in order.
CLEANUP = [(" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re")]


def join_wordpiece(tokens: Column, prefix: str = "##", cleanup: bool = True) -> Column:
    out = _fold(tokens, lambda a, t: F.when(F.startswith(t, F.lit(prefix)), F.concat(a, F.substring(t, len(prefix) + 1, 1 << 30))).when(a == "", t).otherwise(F.concat(a, F.lit(" "), t)))
    for old, new in CLEANUP if cleanup else ():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
