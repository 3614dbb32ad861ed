"""Operator 5: interleaved document sequences of texts and media, with payloads resolved by digest.

HTML is parsed into one ordered sequence of structs for each document: a text, or a reference to a medium with its
digest, source and caption. Media are stored in a table of their own; a join on the digest resolves every reference,
and each keeps its position and caption.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .textkernels import slices, utf8_parts

ITEM = T.StructType([T.StructField("position", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("kind", "text", "src", "digest", "caption"))])
MEDIA_TAGS = {"img", "audio", "video", "source", "embed"}
SILENT = {"script", "style", "template", "noscript", "head", "title"}
IN_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "head"}
BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "article", "section", "nav", "figure", "br", "body", "header", "footer", "blockquote", "pre"}


class _Sequence(HTMLParser):
    """Collects texts between blocks, and media with the figcaption of their figure, or else their alt text.

    A figure's captions are bound to its media when it closes, so they may stand on either side. The end tag of head is
    optional: body, or the first tag that has no place in a head, ends it. Nothing inside silent tags is collected.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.silent: list[str] = []
        self.figures: list[tuple[list[int], list[str]]] = []
        self.captions = 0

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text and self.captions and self.figures:
            self.figures[-1][1].append(text)
        elif text:
            self.items.append({"kind": "text", "text": text})

    def close_figure(self) -> None:
        self.flush()
        media, said = self.figures.pop()
        for k in media:
            self.items[k]["caption"] = " ".join(said) or self.items[k]["caption"]

    def end(self) -> None:
        """What is still open ends with the document."""
        self.flush()
        while self.figures:
            self.close_figure()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent and self.silent[-1] == "head" and tag not in IN_HEAD:
            self.silent.pop()
        if tag in SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in BLOCKS or tag in MEDIA_TAGS:
            self.flush()
        if tag == "figure":
            self.captions = 0
            self.figures.append(([], []))
        if tag == "figcaption":
            self.flush()
            self.captions += 1
        a = dict(attrs)
        if tag in MEDIA_TAGS and (src := a.get("src")):
            digest = src.split(":", 2)[-1].lower() if src.startswith("digest:") else (a.get("data-sha256") or "").lower() or None
            self.items.append({"kind": "media", "src": src, "digest": digest, "caption": a.get("alt") or a.get("title")})
            if self.figures:
                self.figures[-1][0].append(len(self.items) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT and self.silent:
            self.silent.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
            return
        if self.silent:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption" and self.captions:
            self.flush()
            self.captions -= 1
        if tag == "figure" and self.figures:
            self.close_figure()
            self.captions = 0

    def handle_data(self, data: str) -> None:
        if not data.isspace() and self.silent == ["head"] and self.lasttag in ("head", "meta", "link", "base", "title", "script", "style"):
            self.silent.pop()  # text has no place in a head
        if not self.silent:
            self.buffer.append(data)


def sequence_of(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.end()
    empty = dict.fromkeys(("text", "src", "digest", "caption"))
    return [empty | x | {"position": k} for k, x in enumerate(p.items)]


def interleave(docs: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of ``keep`` and items (array of position, kind, text, src, digest, caption) of each row.

    Null or empty html has no items. Repeated rows have a sequence each.
    """
    kinds = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "src", "digest", "caption"))]))
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                items = pa.array([sequence_of(x) for x in part.column(len(names)).to_pylist()], kinds)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], items], [*names, "items"])

    rows = docs.select(*names, F.col(html).alias("own__html"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(names)], T.StructField("items", T.ArrayType(ITEM))]))


def resolve(sequences: DataFrame, media: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row for each item, in its position, with the columns of ``media`` (unique digest, ...) where its digest is there.

    Payload columns come along as any other. References without a payload keep their row with nulls. ``media`` should be a
    written table: the join then reads plain shuffles of both sides, whose hot digests adaptive execution can split.
    """
    flat = sequences.select(*keep, F.explode("items").alias("item")).select(*keep, "item.*")
    return flat.join(media, "digest", "left")


WIDTH = 64


def as_image(payload: bytes) -> bytes:
    """A binary grey map (P5) of 64 samples a row; the payload's length is a multiple of 64."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples_of(image: bytes) -> np.ndarray:
    """The samples of a grey map as rows."""
    magic, size, depth, data = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(data) != width * height:
        raise ValueError("no grey map of 8 bits")
    return np.frombuffer(data, np.uint8).reshape(height, width)


def image_feature(rows: np.ndarray) -> str:
    """64 bits, as hex: for each column of samples, whether its mean is above the mean of all; then mean and deviation."""
    means = rows.mean(axis=0)
    bits = np.packbits(means > means.mean()).tobytes().hex()
    return f"{bits}-{rows.mean():.3f}-{rows.std():.3f}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest and media of each row: its UTF-8 text, padded to a positive multiple of 64 bytes, as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_data, all_offsets = utf8_parts(batch.column(1))
            for at, end, data, offsets in slices(all_data, all_offsets, 16 << 20):
                part = batch.slice(at, end - at)
                raw = data.tobytes()
                n = np.diff(offsets)
                padded = np.maximum(WIDTH, -(-n // WIDTH) * WIDTH)
                media = [as_image(raw[offsets[k] : offsets[k + 1]] + bytes(int(padded[k] - n[k]))) for k in range(len(n))]
                digest = [hashlib.sha256(m).hexdigest() for m in media]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(digest), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "digest", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Facts of each stored medium, from its bytes read back and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for image in batch.column(0):
                image = image.as_buffer().to_pybytes()
                rows = samples_of(image)
                payload = rows.tobytes()
                sha = hashlib.sha256(image).hexdigest()
                for c, v in zip(out, (sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), sha, image_feature(rows)), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out)

    return stored.select("media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the media facts, position and caption of every row of (doc_id, text, ...).

    Each text becomes a stored image; each document becomes a page of a heading, a figure that names the image by digest,
    with its caption, and a last line. The pages are parsed into sequences of three items, and a join on the digest resolves
    the reference at position 1 of each. Null texts count as empty (64 zero bytes); equal texts have equal facts and one
    row in the media table; repeated rows keep their number, null ids are kept.
    """
    stored = written(store_texts(docs.select("doc_id", "text")), "media")
    facts = written(read_media(stored).dropDuplicates(["digest"]), "facts")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    pages = stored.select(
        "doc_id", "n_bytes",
        F.concat(F.lit("<!DOCTYPE html><html><head><title>"), name, F.lit("</title><body><h1>Document "), name, F.lit('</h1><figure><figcaption>'),
                 F.col("n_bytes").cast("string"), F.lit(' bytes</figcaption><img src="digest:sha256:'), "digest", F.lit('" alt="text"></figure><p>End of document ')).alias("html"),
    )
    shown = resolve(interleave(pages, "doc_id", keep=("n_bytes",)), facts, ("doc_id", "n_bytes")).where("kind = 'media'")
    return shown.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def page_items(pages: DataFrame) -> DataFrame:
    """page_id, position, kind, n_chars of the text, src and caption of every item of (page_id, html, ...)."""
    flat = interleave(pages, "page_id").select("page_id", F.explode("items").alias("item"))
    return flat.select("page_id", "item.position", "item.kind", F.char_length("item.text").alias("n_chars"), F.sha2("item.text", 256).alias("text_sha256"), "item.src", "item.caption")
