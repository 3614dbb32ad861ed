"""Operator 6: SentencePiece encoding by streaming Viterbi, and decoding.

The best path is searched with a window of boundaries no longer than the longest piece. Whenever all paths that survive
in the window go through one boundary, the ids before it are committed and forgotten, so memory does not grow with the
text. Scores are whole numbers of micro nats, so that sums are exact and ids are those of a search over the whole text,
ties included. Where no piece of the vocabulary joins two neighbouring characters, every path has that boundary; with the
usual vocabularies, whose pieces hold a space at their start only, that is before each word. The stream commits there
and its state is as at the start of a text, so the ids of a word do not depend on what is before it: each worker remembers
the committed ids of words it has seen, and runs the search for the others.

The given model is one of byte-pair merges, whose scores are merge ranks and no log probabilities. ``load_pieces`` gives its
pieces log probabilities of their rank, so ids are those of a unigram model over its pieces, not those of its merges.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernels import slices, utf8_parts
from .workers import trimmed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What an unknown character costs below the least score of a piece, in micro nats.
UNKNOWN = 10_000_000
#: Bytes of texts whose words are Python objects at a time, and words that one worker remembers.
SLICE, MEMORY = 1 << 19, 500_000


@dataclass
class Pieces:
    """A vocabulary: pieces with a plain space for the space mark, scores, byte pieces, and the unknown id."""

    texts: list[str]
    scores: list[int]
    matched: list[bool]
    byte_ids: list[int]
    unknown: int
    prefix: bool = True
    table: dict[str, tuple[int, int]] = field(default_factory=dict)
    trie: dict = field(default_factory=dict)
    longest: int = 1
    word_cuts: bool = True
    floor: int = 0
    window: int = 1

    def __post_init__(self) -> None:
        for k, (t, s, ok) in enumerate(zip(self.texts, self.scores, self.matched, strict=True)):
            if ok and t and t not in self.table:
                self.table[t] = (k, s)
        for t, hit in self.table.items():
            node = self.trie
            for ch in t:
                node = node.setdefault(ch, {})
            node[""] = hit
        self.longest = max(map(len, self.table), default=1)
        self.word_cuts = not any(re.search("[^ ] ", t) for t in self.table)
        self.floor = min((s for _, s in self.table.values()), default=0) - UNKNOWN
        self.window = self.longest


#: Micro nats in one nat.
MICRO = 1_000_000


def zipf_scores(n: int) -> list[int]:
    return [round(-MICRO * math.log(2.0 + k)) for k in range(n)]


def model_type(path: str) -> int:
    """The trainer's model type in a SentencePiece file: 1 unigram (also where it is left out), 2 byte-pair merges, 3 words, 4 characters."""
    with open(path, "rb") as f:
        raw = f.read()

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Number, and value (of varints) or place and end of each field."""
        while at < end:
            key, at = varint(at)
            if key & 7 == 0:
                value, at = varint(at)
                yield key >> 3, value, -1
            else:
                size, at = varint(at) if key & 7 == 2 else ((8, at) if key & 7 == 1 else (4, at))
                yield key >> 3, at, at + size
                at += size

    for number, start, stop in fields(0, len(raw)):
        if number == 2 and stop >= 0:  # the trainer's part
            return next((v for k, v, e in fields(start, stop) if k == 3 and e < 0), 1)
    return 1


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """Read a SentencePiece model file.

    The scores of a unigram model are log probabilities and taken as they are. Those of any other type are no log
    probabilities; its pieces get that of their rank under Zipf's law, ``-log(2 + rank)``, where the rank is the
    piece's id. Nothing is trained.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    scores = [round(MICRO * m.get_score(k)) for k in range(n)] if model_type(path) == 1 else zipf_scores(n)
    special = [m.is_control(k) or m.is_unknown(k) or m.is_unused(k) or m.is_byte(k) for k in range(n)]
    names = [m.id_to_piece(k) for k in range(n)]
    byte_ids = [-1] * 256
    for k in range(n):
        if m.is_byte(k):
            byte_ids[int(names[k][3:5], 16)] = k
    return Pieces([x.replace("▁", " ") for x in names], scores, [not x for x in special], byte_ids, m.unk_id())


def stream(pieces: Pieces, text: str) -> Iterator[list[int]]:
    """Committed ids of the text, in order, each list as soon as all surviving paths agree on it.

    Ties go to the longer last piece. A character that no piece matches becomes its bytes' pieces, or the unknown id where
    the vocabulary has none. In memory are the boundaries from the last committed one on.
    """
    trie, longest, floor = pieces.trie, pieces.longest, pieces.floor
    n = len(text)
    done = 0  # the boundary up to which ids are committed
    best: list[tuple[int, int, int]] = [(0, -1, -1)]  # of the boundaries from done on: score, boundary before, id (-1: unknown)
    ahead: list[tuple[int, int, int] | None] = []  # of the boundaries that pieces reach so far, behind the current one

    def committed(end: int) -> list[int]:
        out: list[int] = []
        while end > done:
            _, before, k = best[end - done]
            if k >= 0:
                out.append(k)
            else:
                codes = [pieces.byte_ids[x] for x in text[before:end].encode()]
                out.extend(reversed(codes) if min(codes) >= 0 else [pieces.unknown])
            end = before
        out.reverse()
        return out

    for start in range(n):
        score = best[start - done][0]
        node, end, single = trie, start, True
        while end < n:
            node = node.get(text[end])
            if node is None:
                break
            end += 1
            hit = node.get("")
            if hit is not None:
                single = single and end > start + 1
                k = end - start - 1
                while len(ahead) <= k:
                    ahead.append(None)
                if ahead[k] is None or score + hit[1] > ahead[k][0]:  # earlier starts, so longer pieces, come first
                    ahead[k] = (score + hit[1], start, hit[0])
        if not ahead:
            ahead.append(None)
        if single and (ahead[0] is None or score + floor > ahead[0][0]):
            ahead[0] = (score + floor, start, -1)
        best.append(ahead.pop(0))
        at = start + 1
        if at < n and at - done >= pieces.window:
            # follow the paths of all boundaries that a later piece can start from, or that a piece ahead starts from
            live = {at} | {x[1] for x in ahead if x is not None}
            while len(live) > 1:
                last = max(live)
                live.discard(last)
                live.add(best[last - done][1])
            at = live.pop()
            if at > done:
                yield committed(at)
                base = best[at - done][0]
                best = [(s - base, p, k) for s, p, k in best[at - done :]]
                ahead = [x and (x[0] - base, x[1], x[2]) for x in ahead]
                done = at
    if n > done:
        yield committed(n)


def encode(pieces: Pieces, text: str) -> list[int]:
    """The ids of one text."""
    text = (" " if pieces.prefix and text else "") + text
    return [k for part in stream(pieces, text) for k in part]


class Decoder:
    """Ids back to bytes: piece texts, or the raw byte of a byte piece; the first space of each text is the prefix."""

    def __init__(self, pieces: Pieces):
        raw = [t.encode() for t in pieces.texts]
        for b, k in enumerate(pieces.byte_ids):
            if k >= 0:
                raw[k] = bytes([b])
        self.prefix = pieces.prefix
        self.length = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def many(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, with offsets."""
        took = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(took)])
        step = np.arange(ends[-1]) - np.repeat(ends[:-1], took)
        out = self.data[np.repeat(self.start[ids], took) + step]
        cuts = ends[offsets]
        if not self.prefix:
            return out, cuts
        first = cuts[:-1][np.diff(cuts) > 0]
        keep = np.ones(len(out), bool)
        keep[first] = out[first] != 0x20
        return out[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]


class Encoder:
    """Streams texts, with a memory of the committed ids of words; the memory is emptied at ``most`` words."""

    def __init__(self, pieces: Pieces, most: int = MEMORY):
        self.pieces, self.most = pieces, most
        self.codes: dict[str, int] = {}
        self.flat, self.starts = array("i"), array("q", [0])
        self.cut = re.compile(" +[^ ]*|[^ ]+").findall

    def code(self, word: str) -> int:
        for part in stream(self.pieces, word):
            self.flat.extend(part)
        self.starts.append(len(self.flat))
        self.codes[word] = k = len(self.starts) - 2
        return k

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, with offsets."""
        if len(self.codes) > self.most:
            self.codes, self.flat, self.starts = {}, array("i"), array("q", [0])
        get, code = self.codes.get, self.code
        out, count = [], []
        for t in texts:
            if t and self.pieces.prefix:
                t = " " + t
            words = self.cut(t) if self.pieces.word_cuts else ([t] if t else [])
            found = [get(w) for w in words]
            if None in found:
                found = [k if k is not None else self.codes[w] if w in self.codes else code(w) for w, k in zip(words, found, strict=True)]
            out.extend(found)
            count.append(len(found))
        codes = np.array(out, np.int64)
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.int32)  # until this call returns
        took = starts[codes + 1] - starts[codes]
        ends = np.concatenate([[0], np.cumsum(took)])
        ids = flat[np.repeat(starts[codes], took) + np.arange(ends[-1]) - np.repeat(ends[:-1], took)]
        return ids, ends[np.concatenate([[0], np.cumsum(count)])]


def encode_documents(docs: DataFrame, path: str = VOCABULARY, check: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes and round_trip of every row of (doc_id, text, ...).

    Whole texts are encoded; a null or empty text has no ids. round_trip says that decoding the ids gives the text's bytes
    again, which holds for any text where the vocabulary has byte pieces. Repeated rows are encoded alike; an empty table
    gives an empty table; other columns are ignored. The vocabulary file is read by the driver and sent to the workers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            for i, j, b, o in slices(data, offsets, SLICE):
                texts = [x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]
                ids, cuts = encoder.many(texts)
                good = np.ones(j - i, bool)
                if check:
                    back, at = decoder.many(ids, cuts)
                    if len(back) != len(b) or not np.array_equal(back, b) or not np.array_equal(at, o):
                        good = np.array([np.array_equal(back[at[r] : at[r + 1]], b[o[r] : o[r + 1]]) for r in range(j - i)])
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), lists, pa.array(np.diff(cuts)), pa.array(np.diff(o)), pa.array(good)],
                    ["doc_id", "ids", "n_tokens", "n_bytes", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, ids array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text, bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            data, at = decoder.many(np.array([k for x in lists for k in x], np.int64), cuts)
            texts = [data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace") for r in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, text string")
