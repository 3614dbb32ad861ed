"""Sub-word tokenisers as DataFrame operators: texts to ids, pairs, templates, and ids back to texts.

Normalising, isolating special tokens, pre-tokenising and joining are column expressions (functions/texts.py); only the
search inside one piece runs in an Arrow task, with a memory of pieces seen. Vocabulary and merges go to the tasks as one
broadcast, whose size is that of the tokenizer file.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import isolate, join_bytelevel, join_metaspace, join_tokens, join_wordpiece, normalise, pretokenise

#: Micro units of a unigram score, and what an unknown character costs.
MICRO, UNKNOWN_COST = 1_000_000, 1_000_000_000
#: Pieces that one worker remembers, and pieces that are looked up at a time.
MEMORY, RUN = 500_000, 1 << 17


class UnknownToken(ValueError):
    """A piece or id that the vocabulary has not, where there is no unknown token."""


@dataclass
class Tokenizer:
    """kind: WordLevel, BPE, Unigram or WordPiece. Specifications are those of tokenizer JSON files."""

    kind: str
    vocab: dict[str, int]
    merges: dict[tuple[str, str], int] = field(default_factory=dict)
    scores: dict[str, int] = field(default_factory=dict)
    unknown: str | None = None
    byte_fallback: bool = False
    prefix: str = "##"
    longest_word: int = 100
    specials: list[str] = field(default_factory=list)
    normaliser: dict | None = None
    pretokeniser: dict | None = None
    postprocessor: dict | None = None
    decoder: dict | None = None

    @staticmethod
    def from_json(text: str) -> Tokenizer:
        """A tokenizer JSON file."""
        raw = json.loads(text)
        model = raw["model"]
        kind = model.get("type") or ("BPE" if "merges" in model else "WordPiece" if "continuing_subword_prefix" in model else "Unigram" if isinstance(model["vocab"], list) else "WordLevel")
        added = raw.get("added_tokens") or []
        scores: dict[str, int] = {}
        if isinstance(model["vocab"], list):
            if kind != "Unigram":
                raise ValueError("a vocabulary with scores needs a Unigram model")
            vocab = {t: k for k, (t, _) in enumerate(model["vocab"])}
            scores = {t: round(s * MICRO) for t, s in model["vocab"]}
        else:
            vocab = dict(model["vocab"])
        unknown = model.get("unk_token")
        if unknown is None and isinstance(model.get("unk_id"), int):
            unknown = model["vocab"][model["unk_id"]][0]
        vocab |= {t["content"]: t["id"] for t in added}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        return Tokenizer(
            kind, vocab, {m: k for k, m in reversed(list(enumerate(merges)))}, scores, unknown, bool(model.get("byte_fallback")), model.get("continuing_subword_prefix") or "##",
            model.get("max_input_chars_per_word") or 100, [t["content"] for t in added if t.get("special")], raw.get("normalizer"), raw.get("pre_tokenizer"),
            raw.get("post_processor"), raw.get("decoder"),
        )

    def id_of(self, token: str) -> int:
        k = self.vocab.get(token)
        if k is None and self.unknown is not None:
            k = self.vocab.get(self.unknown)
        if k is None:
            raise UnknownToken(token)
        return k

    def piece_ids(self) -> Callable[[str], list[int]]:
        """The search inside a piece."""
        return {"WordLevel": lambda p: [self.id_of(p)], "BPE": self._merged, "Unigram": self._likeliest, "WordPiece": self._greedy}[self.kind]

    def _merged(self, piece: str) -> list[int]:
        """The pair of lowest rank is merged, the leftmost on ties, until no pair has a rank."""
        if piece in self.vocab:
            return [self.vocab[piece]]
        parts = list(piece)
        while len(parts) > 1:
            rank, at = min(((self.merges.get(p, 1 << 62), k) for k, p in enumerate(zip(parts, parts[1:]))))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out: list[int] = []
        for p in parts:
            if p not in self.vocab and self.byte_fallback:
                out += [self.id_of(f"<0x{b:02X}>") for b in p.encode()]
            else:
                out.append(self.id_of(p))
        return out

    def _likeliest(self, piece: str) -> list[int]:
        """The path of the largest score; on ties the longer last piece. Only where nothing matches is a character unknown."""
        if piece in self.vocab:
            return [self.vocab[piece]]
        longest = max(map(len, self.scores), default=1)
        best: list[tuple[int, int, int, str] | None] = [(0, 0, 0, "")] + [None] * len(piece)  # score, bytes of the last piece, start, token
        for start in range(len(piece)):
            if best[start] is None:
                continue
            ends = [e for e in range(start + 1, min(len(piece), start + longest) + 1) if piece[start:e] in self.scores]
            found = [(e, self.scores[piece[start:e]], piece[start:e]) for e in ends]
            if not found and self.unknown is not None:
                found = [(start + 1, -UNKNOWN_COST, self.unknown)]
            for end, score, token in found:
                path = (best[start][0] + score, len(token.encode()), start, token)
                if best[end] is None or path[:2] > best[end][:2]:
                    best[end] = path
        if best[-1] is None:
            raise UnknownToken(piece)
        out, at = [], len(piece)
        while at:
            _, _, start, token = best[at]
            out.append(self.id_of(token))
            at = start
        return out[::-1]

    def _greedy(self, piece: str) -> list[int]:
        """The longest match from the left; a word without one, or that is too long, is unknown as a whole."""
        out, at = [], 0
        while at < len(piece) and len(piece) <= self.longest_word:
            head = self.prefix if at else ""
            end = next((e for e in range(len(piece), at, -1) if head + piece[at:e] in self.vocab), None)
            if end is None:
                break
            out.append(self.vocab[head + piece[at:end]])
            at = end
        if at < len(piece):
            if self.unknown is None or self.unknown not in self.vocab:
                raise UnknownToken(piece)
            return [self.vocab[self.unknown]]
        return out


def segments(tokenizer: Tokenizer, text: Column) -> Column:
    """array<struct<text, special>>: normalised pieces, special tokens apart."""
    parts = isolate(normalise(text, tokenizer.normaliser), tokenizer.specials)
    whole = F.flatten(F.transform(parts, lambda s: F.when(s["special"], F.array(s)).otherwise(
        F.transform(pretokenise(s["text"], tokenizer.pretokeniser), lambda p: F.struct(p.alias("text"), F.lit(False).alias("special"))))))
    return F.when(text.isNotNull(), whole)


class PieceIds:
    """Ids of pieces, with a memory of those seen that is emptied at ``most`` pieces; ids are kept packed, not as Python objects."""

    def __init__(self, tokenizer: Tokenizer, most: int = MEMORY):
        self.tokenizer, self.search, self.most = tokenizer, tokenizer.piece_ids(), most
        self.clear()

    def clear(self) -> None:
        self.codes: dict[tuple[bool, str], int] = {}
        self.flat, self.starts = array("q"), array("q", [0])

    def code(self, key: tuple[bool, str]) -> int:
        k = self.codes.get(key)
        if k is None:
            self.flat.extend([self.tokenizer.id_of(key[1])] if key[0] else self.search(key[1]))
            self.starts.append(len(self.flat))
            self.codes[key] = k = len(self.starts) - 2
        return k

    def many(self, pieces: pa.Array, special: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has. Only the distinct pieces become Python strings."""
        if len(self.codes) > self.most:
            self.clear()
        named = pieces.dictionary_encode()
        words, place = named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False) * 2 + special.to_numpy(zero_copy_only=False)
        used, place = np.unique(place, return_inverse=True)
        codes = np.array([self.code((bool(k % 2), words[k // 2])) for k in used.tolist()], np.int64)[place]
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.int64)  # until this call returns
        took = starts[codes + 1] - starts[codes]
        step = np.arange(took.sum()) - np.repeat(np.cumsum(took) - took, took)
        return flat[np.repeat(starts[codes], took) + step], took


def _ids_function(spark: SparkSession, tokenizer: Tokenizer):
    shared = spark.sparkContext.broadcast(tokenizer)
    memory: list[PieceIds] = []

    @F.arrow_udf("array<bigint>")
    def run(pieces: pa.Array, special: pa.Array) -> pa.Array:
        if not memory:
            memory.append(PieceIds(shared.value))
        ends = pieces.offsets.to_numpy()
        first, last = int(ends[0]), int(ends[-1])
        words, marks, shift = pieces.values, special.values, special.offsets[0].as_py() - first
        at, parts, size = np.zeros(len(ends), np.int32), [np.zeros(0, np.int64)], 0
        for k in range(first, last, RUN):
            ids, took = memory[0].many(words.slice(k, min(RUN, last - k)), marks.slice(k + shift, min(RUN, last - k)))
            own = slice(*np.searchsorted(ends, [k, k + RUN], "right"))  # texts that end in this run
            at[own] = size + np.cumsum(took)[ends[own] - k - 1]
            parts.append(ids)
            size += len(ids)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts)), mask=pieces.is_null())

    return run


def encode_column(df: DataFrame, tokenizer: Tokenizer, text: str, out: str) -> DataFrame:
    """df with the ids of a text column, without a template; a null text has null ids, an empty one none."""
    own = "own__segments"
    ids = _ids_function(df.sparkSession, tokenizer)(F.col(f"{own}.text"), F.col(f"{own}.special"))
    return df.withColumn(own, segments(tokenizer, F.col(text))).withColumn(out, ids).drop(own)


def template_pieces(tokenizer: Tokenizer, pair: bool) -> list[tuple[str, int]]:
    """What the post-processor puts together: ("A" or "B", 0) for a sequence, or (token, its id)."""
    spec = tokenizer.postprocessor
    plain = [("A", 0), ("B", 0)] if pair else [("A", 0)]

    def of(spec: dict | None) -> list[tuple[str, int]]:
        if not spec or spec["type"] == "ByteLevel":
            return plain
        if spec["type"] == "TemplateProcessing":
            known = {k: v["ids"] for k, v in (spec.get("special_tokens") or {}).items()}
            out: list[tuple[str, int]] = []
            for piece in spec["pair" if pair else "single"]:
                if "Sequence" in piece:
                    out.append((piece["Sequence"]["id"], 0))
                else:
                    name = piece["SpecialToken"]["id"]
                    out += [(f"token {name}", k) for k in known.get(name, [tokenizer.vocab.get(name, -1)])]
            return out
        if spec["type"] in ("BertProcessing", "RobertaProcessing"):
            cls, sep = (("token " + spec[k][0], spec[k][1]) for k in ("cls", "sep"))
            between = [sep, sep] if spec["type"] == "RobertaProcessing" else [sep]
            return [cls, ("A", 0), *([*between, ("B", 0), sep] if pair else [sep])]
        raise ValueError(f"unknown post-processor {spec['type']}")

    if spec and spec["type"] == "Sequence":
        chosen = [x for x in spec["processors"] if x["type"] != "ByteLevel"]
        if len(chosen) > 1:
            raise ValueError("a sequence may have one post-processor that adds tokens")
        return of(chosen[0] if chosen else None)
    return of(spec)


def encode_texts(df: DataFrame, tokenizer: Tokenizer, text: str = "text", second: str | None = None, out: str = "ids") -> DataFrame:
    """df with ``ids``, ``type_ids`` (0 of the first text, 1 of the second) and ``special_mask`` of a text, or of a pair of texts.

    The post-processor's template holds for both. A null text gives nulls; a text without tokens keeps the template's. Other
    columns stay.
    """
    a, b = "own__a", "own__b"
    df = encode_column(df, tokenizer, text, a)
    if second is not None:
        df = encode_column(df, tokenizer, second, b)
    ids, types, mask, kind = [], [], [], 0
    for name, k in template_pieces(tokenizer, second is not None):
        if name in ("A", "B"):
            kind = int(name == "B")
            part = F.col(a if name == "A" else b)
            ids.append(part)
            types.append(F.array_repeat(F.lit(kind), F.size(part)))
            mask.append(F.array_repeat(F.lit(0), F.size(part)))
        else:
            ids.append(F.array(F.lit(k).cast("long")))
            types.append(F.array(F.lit(kind)))
            mask.append(F.array(F.lit(1)))
    whole = {out: F.concat(*ids), "type_ids": F.concat(*types), "special_mask": F.concat(*mask)}
    return df.withColumns(whole).drop(a, b)


def decode_ids(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of an ids column; null ids give null, an id that the vocabulary has not is an error."""
    shared = df.sparkSession.sparkContext.broadcast(({k: t for t, k in tokenizer.vocab.items()}, tokenizer.byte_fallback))

    @F.pandas_udf("array<string>")
    def tokens(x: pd.Series) -> pd.Series:
        names, bytes_too = shared.value

        def one(row):
            if row is None:
                return None
            if any(int(k) not in names for k in row):
                raise UnknownToken(str(next(int(k) for k in row if int(k) not in names)))
            words, held, found = [], bytearray(), None
            for k in row:
                found = re.fullmatch("<0x([0-9A-Fa-f]{2})>", names[int(k)]) if bytes_too else None
                if found:
                    held.append(int(found[1], 16))
                    continue
                if held:
                    words.append(held.decode())
                    held = bytearray()
                words.append(names[int(k)])
            return [*words, held.decode()] if held else words

        return x.map(one)

    plain = {"WordLevel": lambda t: F.array_join(t, " "), "BPE": join_bytelevel, "Unigram": join_metaspace, "WordPiece": lambda t: join_wordpiece(t, tokenizer.prefix)}[tokenizer.kind]
    own = "own__tokens"
    text = join_tokens(F.col(own), tokenizer.decoder, tokenizer.specials) if tokenizer.decoder else plain(F.col(own))
    return df.withColumn(own, tokens(F.col(ids))).withColumn(out, text).drop(own)


def vocabulary(spark: SparkSession, tokenizer: Tokenizer) -> DataFrame:
    """token, id, score and special of every entry, as a table."""
    rows = [(t, k, tokenizer.scores.get(t), t in set(tokenizer.specials)) for t, k in tokenizer.vocab.items()]
    return spark.createDataFrame(rows, "token string, id long, score long, special boolean")


def word_level_ids(texts: DataFrame, vocab: DataFrame, key: str, text: str = "text", unknown: int = 0) -> DataFrame:
    """key and ids (array, in order of the words between white space) by a vocabulary table (token, id) of any size.

    The vocabulary is joined by shuffle or broadcast as its size says; words of one text meet again by its key.
    """
    words = texts.select(key, F.posexplode_outer(pretokenise(F.col(text), {"type": "WhitespaceSplit"})).alias("pos", "token"))
    found = words.join(vocab.select("token", "id"), "token", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(unknown)).cast("long").alias("id")))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["id"]).alias("ids"))
