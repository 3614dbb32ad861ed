"""A container of tensors as a folder of Parquet tables: catalog tables, and payloads in chunks of bounded size.

Tables: tensors, variants, sections, graphs, assets, metadata (see operators/catalog.py) and ``blobs`` (arena, shard_id,
stored, chunk, data), partitioned by arena and shard so that one shard, or no payload at all, is read when a query asks for
that. ``stored`` is the variant whose bytes they are; variants with equal bytes share them. Offsets lay each arena out as one
aligned file, for exports. Digests are the first 128 bits of SHA-256 over the plain bytes.

Writes go to a folder beside the target and are renamed when all tables are there. Tables grow with the model, so nothing of
them is collected; catalogs of one model are small against its payloads.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import compress, decode_by, decompress
from ..functions.metadata import SAFETENSORS, byte_size, element_count, without_prefix
from ..operators.catalog import dedup_payloads, ensure_none, even_layout, owned_variants, tensor_entries, tensor_variants

CHUNK = 16 << 20
ALIGN = 64
TABLES = ("tensors", "variants", "sections", "graphs", "assets", "metadata")
GRAPHS = "idx int, kind string, payload binary"
ASSETS = "name string, payload binary"
PAIRS = "array<struct<key:string,value:string>>"


def digest(payload: Column) -> Column:
    """The first 128 bits of the payload's SHA-256, in hexadecimal."""
    return F.substring(F.sha2(payload, 256), 1, 32)


def writer_violations(tensors: DataFrame, variants: DataFrame) -> DataFrame:
    """What a container cannot hold: duplicate names, variants that are missing or have two owners, raw lengths that do not fit."""
    own = owned_variants(tensors)
    raw = tensor_entries(tensors, variants).where(F.coalesce(F.col("encoding"), F.lit("raw")) == "raw")
    length = F.octet_length("payload")
    row = lambda df, rule, subject: df.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    return (
        row(tensors.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "duplicate name", "name")
        .unionByName(row(own.join(variants, "variant_index", "left_anti"), "missing variant", "variant_index"))
        .unionByName(row(own.groupBy("variant_index").agg(F.count("*").alias("n")).where("n > 1"), "variant of two tensors", "variant_index"))
        .unionByName(row(variants.where("payload is null"), "no payload", "variant_index"))
        .unionByName(row(raw.where(F.coalesce(length != byte_size(F.col("shape"), F.col("dtype")), F.lit(True))), "length", "name"))
    )


def write_container(
    path: str, tensors: DataFrame, variants: DataFrame, graphs: DataFrame | None = None, assets: DataFrame | None = None, metadata: DataFrame | None = None,
    dedup: bool = True, level: int | None = None, shuffle: bool = False, check: bool = True,
) -> None:
    """Write tensors (catalog columns) and variants (variant_index, target, encoding, storage_dtype, extra, payload) to a new folder.

    ``dedup`` stores equal payloads of an arena once. ``level`` compresses chunks by zstd, with their bits shuffled if asked for.
    tensors may have a shard_id (0 else); payloads over 1 GB have to come as tensors of their own.
    """
    spark = tensors.sparkSession
    if check:
        ensure_none(writer_violations(tensors, variants), "not writable")
    place = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    own = owned_variants(tensors).select("variant_index", "place").join(tensors.select(F.col("canonical_variant").alias("variant_index"), F.lit(True).alias("main")), "variant_index", "left")
    shard = F.col("shard_id") if "shard_id" in tensors.columns else F.lit(0).cast("long").alias("shard_id")
    shards = tensors.select(F.explode(F.concat(F.array("canonical_variant"), F.coalesce("packed_variants", F.array().cast("array<int>")))).alias("variant_index"), shard)
    facts = variants.select(
        "variant_index", F.lit(ALIGN).alias("align"), F.octet_length("payload").cast("long").alias("length"), digest(F.col("payload")).alias("digest"),
    ).join(own, "variant_index").join(shards, "variant_index").withColumn("arena", F.when(F.col("main"), "canonical").otherwise("packed"))
    facts = _kept(facts, f"{place}/_facts")
    stored = dedup_payloads(facts.withColumnRenamed("variant_index", "ordinal").withColumn("arena", F.concat_ws("/", "arena", "shard_id")))
    stored = stored.select(F.col("ordinal").alias("variant_index"), F.col("stored_at").alias("stored")) if dedup else facts.select("variant_index", F.col("variant_index").alias("stored"))
    stored = _kept(stored, f"{place}/_stored")
    first = facts.join(stored.where("variant_index = stored"), "variant_index")
    layout = even_layout(first.select("arena", "shard_id", F.col("variant_index").alias("ordinal"), "length"), ALIGN, ("arena", "shard_id"))
    layout = _kept(layout.select("arena", "shard_id", F.col("ordinal").alias("stored"), "offset"), f"{place}/_layout")
    kinds = {"canonical": 1, "packed": 2}
    section = F.when(F.col("arena") == "canonical", kinds["canonical"]).otherwise(kinds["packed"])
    table = (
        facts.join(stored, "variant_index").join(layout.select("stored", "offset"), "stored")
        .select("variant_index", "stored", "shard_id", F.col("align").alias("alignment"), section.alias("section_kind"), F.lit(0).alias("section_index"), "offset", "length", F.col("digest").alias("checksum"))
        .join(variants.drop("payload", "shard_id"), "variant_index")
    )
    table.write.parquet(f"{place}/variants")
    ends = facts.join(layout, (facts["variant_index"] == layout["stored"])).groupBy(facts["arena"], facts["shard_id"]).agg(F.max(layout["offset"] + facts["length"]).alias("length"))
    order = F.when(F.col("arena") == "canonical", 1).otherwise(2)
    ends.select(F.col("shard_id"), order.alias("kind"), F.lit(ALIGN).alias("align"), F.lit(0).cast("long").alias("offset"), "length").write.parquet(f"{place}/sections")
    blobs = variants.join(first.select("variant_index", "arena", "shard_id"), "variant_index").select("arena", "shard_id", F.col("variant_index").alias("stored"), "payload")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / CHUNK)).cast("int")
    pieces = blobs.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    data = F.substring(F.col("payload"), F.col("chunk") * CHUNK + 1, F.lit(CHUNK))
    data = compress(level, shuffle)(data) if level is not None else data
    pieces.select("arena", "shard_id", "stored", "chunk", data.alias("data")).write.partitionBy("arena", "shard_id").parquet(f"{place}/blobs")
    tensors.withColumn("shard_id", shard).write.parquet(f"{place}/tensors")
    with_digest = lambda df: df.withColumn("checksum", digest(F.col("payload")))
    with_digest(graphs if graphs is not None else spark.createDataFrame([], GRAPHS)).write.parquet(f"{place}/graphs")
    with_digest(assets if assets is not None else spark.createDataFrame([], ASSETS)).write.parquet(f"{place}/assets")
    own_pairs = spark.createDataFrame([("container.codec", "zstd" if level is not None else "plain"), ("container.shuffled", str(bool(shuffle and level is not None)).lower())], "key string, value string")
    (own_pairs if metadata is None else metadata.select("key", "value").unionByName(own_pairs)).coalesce(1).write.parquet(f"{place}/metadata")
    fs, at = _place(spark, place)
    for name in ("_facts", "_stored", "_layout"):
        fs.delete(_path(spark, f"{place}/{name}"), True)
    target = _path(spark, path)
    if fs.exists(target):
        fs.delete(at, True)
        raise FileExistsError(path)
    if not fs.rename(at, target):
        raise OSError(f"cannot rename to {path}")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _place(spark: SparkSession, path: str):
    at = _path(spark, path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Container:
    """The tables of an open container."""

    path: str
    tensors: DataFrame
    variants: DataFrame
    sections: DataFrame
    graphs: DataFrame
    assets: DataFrame
    metadata: DataFrame
    blobs: DataFrame

    def _codec(self) -> tuple[bool, bool]:
        pairs = {r.key: r.value for r in self.metadata.where(F.startswith("key", F.lit("container."))).collect()}
        return pairs.get("container.codec") == "zstd", pairs.get("container.shuffled") == "true"

    def payloads(self, variants: DataFrame | None = None) -> DataFrame:
        """variant_index, shard_id, alignment, ... and payload of the given variants (all by default); other chunks are not joined."""
        wanted = self.variants if variants is None else self.variants.join(variants.select("variant_index").distinct(), "variant_index", "left_semi")
        arena = F.when(F.col("section_kind") == 1, "canonical").otherwise("packed")
        need = wanted.select("stored", "shard_id", arena.alias("arena")).distinct()
        packed, shuffle = self._codec()
        plain = decompress(shuffle)(F.col("data")) if packed else F.col("data")
        chunks = self.blobs.join(need, ["arena", "shard_id", "stored"], "left_semi").select("stored", "chunk", plain.alias("data"))
        whole = chunks.groupBy("stored").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY chunk)").alias("payload"))
        return wanted.join(whole, "stored", "left")

    def tensor_payloads(self, target: str | None = None) -> DataFrame:
        """Tensors with their canonical variant's payload, or with that of their first variant for a target, where they have one."""
        if target is None:
            return self.tensors.drop("shard_id").withColumnRenamed("canonical_variant", "variant_index").join(self.payloads(), "variant_index")
        rows = tensor_variants(self.tensors, self.variants.select("variant_index", "target")).where(F.col("target") == target)
        chosen = rows.groupBy("name").agg(F.min_by("variant_index", "place").alias("variant_index"))
        return self.tensors.drop("shard_id").join(chosen, "name").join(self.payloads(chosen), "variant_index")

    def floats(self, target: str | None = None) -> DataFrame:
        """name, shape and values (array<float>, cut to the shape) of all tensors, decoded in tasks."""
        rows = self.tensor_payloads(target)
        kind = F.when(F.coalesce(F.col("encoding"), F.lit("raw")) == "raw", F.coalesce("storage_dtype", "dtype")).otherwise(F.col("storage_dtype"))
        return rows.select("name", "shape", decode_by(F.col("payload"), kind, element_count(F.col("shape"))).alias("values"))

    def asset(self, name: str) -> DataFrame:
        return self.assets.where(F.col("name") == name)

    def custom_sections(self) -> DataFrame:
        """Sections of kinds from 128 on, which belong to others."""
        return self.sections.where("kind >= 128")

    def verify(self) -> DataFrame:
        """table, subject, expected and found digest of everything whose bytes are not what the catalog says; no rows if all is well."""
        rows = self.payloads().select(F.lit("variant").alias("table"), F.col("variant_index").cast("string").alias("subject"), F.col("checksum").alias("expected"), digest(F.col("payload")).alias("found"))
        for name, df, key in (("graph", self.graphs, "idx"), ("asset", self.assets, "name")):
            rows = rows.unionByName(df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("subject"), F.col("checksum").alias("expected"), digest(F.col("payload")).alias("found")))
        return rows.where("found is null or found <> expected")


def open_container(spark: SparkSession, path: str, shards: dict[int, str] | None = None) -> Container:
    """Open a folder. ``shards`` names folders of blobs kept elsewhere (arena=.../*.parquet) by their shard's id."""
    t = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    blobs = spark.read.option("basePath", f"{path}/blobs").schema("stored int, chunk int, data binary, arena string, shard_id long").parquet(f"{path}/blobs")
    for k, at in (shards or {}).items():
        other = spark.read.schema("stored int, chunk int, data binary, arena string").parquet(at).withColumn("shard_id", F.lit(k).cast("long"))
        blobs = blobs.where(F.col("shard_id") != k).unionByName(other)
    return Container(path, **t, blobs=blobs)


def inputs_of(c: Container) -> dict[str, DataFrame]:
    """What write_container() takes, from an open container."""
    drop = ["stored", "shard_id", "alignment", "section_kind", "section_index", "offset", "length", "checksum"]
    return {
        "tensors": c.tensors, "variants": c.payloads().drop(*drop), "graphs": c.graphs.drop("checksum"), "assets": c.assets.drop("checksum"),
        "metadata": c.metadata.where(~F.startswith("key", F.lit("container."))),
    }


def rewrite(
    c: Container, path: str, drop_targets: tuple[str, ...] = (), drop_graphs: bool = False, drop_assets: tuple[str, ...] = (), drop_metadata: str | None = None, **options,
) -> None:
    """Write a container again without packed variants of some targets, graphs, assets or metadata under a prefix; other options as for writing.

    Canonical variants stay as they are, in their own encoding.
    """
    parts = inputs_of(c)
    tensors, variants = parts["tensors"], parts["variants"]
    if drop_targets:
        packed = tensors.select("name", F.explode("packed_variants").alias("variant_index")).join(variants.select("variant_index", "target"), "variant_index")
        kept = packed.where(~F.coalesce(F.col("target").isin(*drop_targets), F.lit(False))).groupBy("name").agg(F.array_sort(F.collect_list("variant_index")).alias("kept"))
        tensors = tensors.join(kept, "name", "left").withColumn("packed_variants", F.coalesce("kept", F.array().cast("array<int>"))).drop("kept")
        variants = variants.join(owned_variants(tensors).select("variant_index"), "variant_index", "left_semi")
    if drop_metadata is not None:
        tensors = tensors.withColumn("metadata", without_prefix(F.col("metadata"), drop_metadata))
        parts["metadata"] = parts["metadata"].where(~F.startswith("key", F.lit(drop_metadata)))
    write_container(
        path, tensors, variants, parts["graphs"].where(F.lit(not drop_graphs)), parts["assets"].where(~F.col("name").isin(*drop_assets)) if drop_assets else parts["assets"], parts["metadata"], **options,
    )


def export_safetensors(c: Container, folder: str, target: str | None = None, as_floats: bool = False, file_bytes: int = 4 << 30) -> DataFrame:
    """file, bytes and tensors of safetensors files with all tensors, each file of about ``file_bytes`` bytes and written by one task.

    ``as_floats`` decodes payloads to f32 and cuts their padding; else they are copied, and an encoding that safetensors has not
    is an error. ``folder`` is a URI that Arrow can open and all executors share.
    """
    rows = c.tensor_payloads(target)
    if as_floats:
        values = c.floats(target)
        to_bytes = _encode_f32()
        rows = values.select("name", F.lit("f32").alias("dtype"), "shape", to_bytes("values").alias("payload"))
    else:
        raw = F.coalesce(F.col("encoding"), F.lit("raw")) == "raw"
        rows = rows.select("name", F.when(raw, F.col("dtype")).otherwise(F.raise_error(F.concat(F.lit("not raw: "), "name"))).alias("dtype"), "shape", "payload")
    sizes = rows.select("name", F.octet_length("payload").cast("long").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    names = {v: k for k, v in SAFETENSORS.items()}
    numbered = rows.withColumn("file", F.pmod(F.xxhash64("name"), F.lit(files)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            head, at = {}, 0
            for name, dtype, shape, data in held:
                head[name] = {"dtype": names[dtype], "shape": shape, "data_offsets": [at, at + len(data)]}
                at += len(data)
            text = json.dumps(head).encode()
            text += b" " * (-len(text) % 8)
            file = f"model-{now:05d}.safetensors"
            with fs.open_output_stream(f"{root}/.{file}") as out:
                out.write(struct.pack("<Q", len(text)) + text)
                for *_, data in held:
                    out.write(data)
            fs.move(f"{root}/.{file}", f"{root}/{file}")
            yield pa.RecordBatch.from_pydict({"file": [file], "bytes": [8 + len(text) + at], "tensors": [len(held)]})

        for batch in batches:
            for r in range(batch.num_rows):
                file, name, dtype, shape, data = (batch.column(k)[r].as_py() for k in range(5))
                if file != now and held:
                    yield from done()
                    held = []
                now = file
                held.append((name, dtype, shape, data))
        if held:
            yield from done()

    dealt = numbered.select("file", "name", "dtype", "shape", "payload").repartition(files, "file").sortWithinPartitions("file", "name")
    return dealt.mapInArrow(run, "file string, bytes long, tensors long")


def _encode_f32():
    from ..functions.codecs import encode

    return encode("f32")


def save_blobs(rows: DataFrame, folder: str) -> DataFrame:
    """name, path and bytes of files written from rows (name, payload): extracted tensors, assets or graphs, byte for byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        for batch in batches:
            for r in range(batch.num_rows):
                name, data = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                file = name.replace("/", "_")
                with fs.open_output_stream(f"{root}/.{file}") as out:
                    out.write(data)
                fs.move(f"{root}/.{file}", f"{root}/{file}")
                yield pa.RecordBatch.from_pydict({"name": [name], "path": [f"{folder}/{file}"], "bytes": [len(data)]})

    return rows.select("name", "payload").mapInArrow(run, "name string, path string, bytes long")


def add_encoded(tensors: DataFrame, variants: DataFrame, codec: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Tables with one more packed variant of each f32 tensor: its canonical values in a codec, for a target."""
    from ..functions.codecs import decode, encode

    top = (variants.agg(F.max("variant_index")).first()[0] or 0) + 1
    own = tensors.where("dtype = 'f32'").join(variants.where("coalesce(encoding, 'raw') = 'raw'").select(F.col("variant_index").alias("canonical_variant"), "payload"), "canonical_variant")
    own = own.select("name", (F.col("ordinal") + top).cast("int").alias("variant_index"), encode(codec)(decode("f32")("payload")).alias("payload"))
    kind = "cast_f16" if codec == "f16" else "block_quantized"
    rows = own.select("variant_index", F.lit(target).alias("target"), F.lit(kind).alias("encoding"), F.lit(codec).alias("storage_dtype"), F.array().cast(PAIRS).alias("extra"), "payload")
    more = tensors.join(own.select("name", F.col("variant_index").alias("own__new")), "name", "left")
    packed = F.concat(F.coalesce("packed_variants", F.array().cast("array<int>")), F.array_compact(F.array("own__new")))
    return more.withColumn("packed_variants", packed).drop("own__new").select(*tensors.columns), variants.unionByName(rows)
