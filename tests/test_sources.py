"""Model files and containers: written by plain code, read by the sources, and the other way round."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeria.functions import codecs
from plumeria.functions.metadata import typed
from plumeria.sources import container as C
from plumeria.sources import model_files as M
from plumeria.sources.ranges import chunks, with_payload
from plumeria.sources.tensor_files import read_tensors


def safetensors(tensors, meta=None):
    head, body = {"__metadata__": meta or {"a": "b"}}, b""
    for name, x in tensors.items():
        head[name] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [len(body), len(body) + x.nbytes]}
        body += x.tobytes()
    h = json.dumps(head).encode()
    return struct.pack("<Q", len(h)) + h + body


def text(s):
    return struct.pack("<Q", len(s.encode())) + s.encode()


def gguf(tensors, meta, align=32):
    """tensors: name -> (type number, dimensions in the file's order, bytes)."""
    kinds = {str: 8, bool: 7, int: 11, float: 12}
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(meta))
    for k, v in meta.items():
        head += text(k)
        if isinstance(v, list):
            head += struct.pack("<IIQ", 9, 8, len(v)) + b"".join(text(x) for x in v)
        else:
            head += struct.pack("<I", kinds[type(v)]) + (text(v) if isinstance(v, str) else struct.pack({bool: "<?", int: "<q", float: "<d"}[type(v)], v))
    body = b""
    for name, (kind, dims, data) in tensors.items():
        body += b"\0" * (-len(body) % align)
        head += text(name) + struct.pack("<I", len(dims)) + struct.pack(f"<{len(dims)}Q", *dims) + struct.pack("<IQ", kind, len(body))
        body += data
    return head + b"\0" * (-len(head) % align) + body


def varint(x):
    out = b""
    while True:
        out += bytes([x & 127 | (128 if x > 127 else 0)])
        x >>= 7
        if not x:
            return out


def field(n, data):
    return varint(n << 3 | 2) + varint(len(data)) + data


def number(n, x):
    return varint(n << 3) + varint(x)


def test_files_are_read(spark, tmp_path):
    a, b, c = np.arange(12, dtype=np.float32).reshape(3, 4), np.ones(5, np.float32), np.zeros((2, 0), np.float32)
    (tmp_path / "m.safetensors").write_bytes(safetensors({"a": a, "b": b, "c": c}))
    np.save(tmp_path / "w.npy", a)
    (tmp_path / "other.txt").write_text("x")
    got = {r.name: r for r in read_tensors(spark, str(tmp_path), payload=True).collect()}
    assert set(got) == {"a", "b", "c", "w"} and got["a"].shape == [3, 4] and got["c"].length == 0 and got["w"].dtype == "f32"
    for name, x in (("a", a), ("b", b), ("w", a)):
        assert np.array_equal(np.frombuffer(bytes(got[name].payload), "<f4").reshape(got[name].shape), x)
    assert "payload" not in read_tensors(spark, str(tmp_path)).columns
    cut = with_payload(chunks(M.read_tensors(spark, str(tmp_path)).where("name = 'a'"), 20)).orderBy("chunk").collect()
    assert [len(r.payload) for r in cut] == [20, 20, 8] and b"".join(bytes(r.payload) for r in cut) == a.tobytes()
    assert [(r.key, r.value) for r in M.read_metadata(spark, str(tmp_path)).collect()] == [("safetensors.a", "b")]


def test_broken_files(spark, tmp_path):
    bad = json.dumps({"a": {"dtype": "F32", "shape": [4], "data_offsets": [0, 16]}}).encode()
    short = json.dumps({"a": {"dtype": "F32", "shape": [4], "data_offsets": [0, 8]}}).encode()
    (tmp_path / "a.safetensors").write_bytes(struct.pack("<Q", 100) + b"{}")
    (tmp_path / "b.safetensors").write_bytes(struct.pack("<Q", len(bad)) + bad)
    (tmp_path / "c.safetensors").write_bytes(struct.pack("<Q", len(short)) + short + b"\0" * 8)
    (tmp_path / "d.gguf").write_bytes(b"GGUF\x03\0\0\0")
    (tmp_path / "e.npy").write_bytes(b"no")
    (tmp_path / "f.safetensors").write_bytes(safetensors({"ok": np.ones(2, np.float32)}))
    np.save(tmp_path / "g.npy", np.asfortranarray(np.ones((2, 3), np.float32)))
    rows = M.read_tensors(spark, str(tmp_path), broken="keep").collect()
    errors = {r.path.rsplit("/", 1)[-1]: r.error for r in rows if r.error}
    assert set(errors) == {"a.safetensors", "b.safetensors", "c.safetensors", "d.gguf", "e.npy", "g.npy"} and [r.name for r in rows if not r.error] == ["ok"]
    assert "outside" in errors["b.safetensors"] and "column-major" in errors["g.npy"]
    with pytest.raises(Exception, match="safetensors|gguf|npy"):
        M.read_tensors(spark, str(tmp_path)).collect()


def test_gguf(spark, tmp_path):
    r = np.random.default_rng(0)
    x = r.normal(0, 1, 64).astype(np.float32)
    q4k = r.integers(0, 256, 144).astype(np.uint8)
    q4k[:4] = np.array([0.1, 0.05], "<f2").view(np.uint8)
    tensors = {"f": (0, [4, 16], x.tobytes()), "q8": (8, [32, 2], codecs.encode_q8_0(x)), "k": (12, [256], q4k.tobytes()), "h": (1, [2], np.array([1, 2], "<f2").tobytes()), "o": (3, [32], bytes(20))}
    meta = {"general.architecture": "llama", "tokenizer.tokens": ["<s>", "é"], "n": 7, "eps": 1e-5, "tie": True}
    (tmp_path / "m.gguf").write_bytes(gguf(tensors, meta))
    rows = M.read_tensors(spark, str(tmp_path))
    got = {t.name: t for t in with_payload(rows).collect()}
    assert got["f"].shape == [16, 4] and got["q8"].encoding == "q8_0" and got["q8"].dtype == "f32" and got["h"].dtype == "f16" and got["o"].encoding == "q4_1"
    assert all(bytes(got[n].payload) == t[2] for n, t in tensors.items())
    kind = F.when(F.col("encoding") == "raw", F.col("dtype")).otherwise(F.col("encoding"))
    values = {t.name: t.v for t in with_payload(rows.where("name <> 'o'")).select("name", codecs.decode_by("payload", kind, F.lit(None).cast("int")).alias("v")).collect()}
    assert np.allclose(values["f"], x) and np.allclose(values["q8"], x, atol=0.03) and np.allclose(values["k"], codecs.decode_q4_k(q4k.tobytes()).ravel()) and values["h"] == [1, 2]
    pairs = {t.key: (t.value, t.t.kind) for t in M.read_metadata(spark, str(tmp_path)).select("key", "value", typed(F.col("value")).alias("t")).collect()}
    assert pairs == {"gguf.general.architecture": ("llama", "string"), "gguf.tokenizer.tokens": ('["<s>", "é"]', "array"), "gguf.n": ("7", "int"), "gguf.eps": ("1e-05", "float"), "gguf.tie": ("true", "bool")}


def test_onnx_and_pieces(spark, tmp_path):
    x = np.arange(6, dtype="<f4")
    t = number(1, 2) + number(1, 3) + number(2, 1) + field(8, b"w") + field(9, x.tobytes())
    packed = field(1, varint(2)) + number(2, 7) + field(8, b"ids") + field(7, varint(5) + varint(6))
    (tmp_path / "m.onnx").write_bytes(number(1, 8) + field(7, field(5, t) + field(5, packed) + field(2, b"g")))
    rows = {r.name: r for r in with_payload(M.read_tensors(spark, str(tmp_path))).collect()}
    assert rows["w"].shape == [2, 3] and rows["w"].dtype == "f32" and bytes(rows["w"].payload) == x.tobytes()
    assert rows["ids"].encoding == "list" and rows["ids"].dtype == "i64" and rows["ids"].payload is None and rows["ids"].shape == [2]
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    got = M.read_pieces(spark, "/opt/tokenizers/piece_bpe_32k.model").orderBy("id").collect()
    assert len(got) == m.get_piece_size() and all(got[k].piece == m.id_to_piece(k) and got[k].score == m.get_score(k) for k in (0, 3, 300, 20000))
    assert got[0].kind == "unknown" and got[1].kind == "control"


def test_tokenizer_json(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"added_tokens": [{"id": 0, "content": "<s>", "special": True}], "model": {"vocab": {"<s>": 0, "a": 1}, "merges": ["a b", "ab c"]}}))
    (tmp_path / "u.json").write_text(json.dumps({"model": {"vocab": {"x": 5}, "merges": [["x", " y"]]}}))
    vocab = {(r.token, r.id, r.special) for r in M.read_vocabulary(spark, str(tmp_path)).collect()}
    assert vocab == {("<s>", 0, True), ("a", 1, False), ("x", 5, False)}
    assert {(r["rank"], r.left, r.right) for r in M.read_merges(spark, str(tmp_path)).collect()} == {(0, "a", "b"), (1, "ab", "c"), (0, "x", " y")}


PAIRS = C.PAIRS


def model(spark):
    x = np.arange(16, dtype="<f4")
    t = [("weight", 0, "f32", [4, 4], 0, [2], [("layer", "0")]), ("bias", 1, "f32", [4], 1, [], []), ("copy", 2, "f32", [4, 4], 3, [], [])]
    v = [(0, "canonical", "raw", "f32", [], x.tobytes()), (1, "canonical", "raw", "f32", [], (100 + x[:4]).tobytes()), (2, "wgpu", "block_quantized", "q8_0", [("tier.intent", "vram")], codecs.encode_q8_0(x)), (3, "canonical", "raw", "f32", [], x.tobytes())]
    tensors = spark.createDataFrame(t, f"name string, ordinal int, dtype string, shape array<bigint>, canonical_variant int, packed_variants array<int>, metadata {PAIRS}")
    variants = spark.createDataFrame(v, f"variant_index int, target string, encoding string, storage_dtype string, extra {PAIRS}, payload binary")
    graphs = spark.createDataFrame([(0, "onnx", b"\x01\x02")], C.GRAPHS)
    assets = spark.createDataFrame([("tokenizer.json", b'{"t":1}')], C.ASSETS)
    metadata = spark.createDataFrame([("framework", "x"), ("arch", "llama")], "key string, value string")
    return tensors, variants, graphs, assets, metadata


@pytest.mark.parametrize("options", [{}, {"level": 3, "shuffle": True}, {"dedup": False, "level": 1}])
def test_container_round_trip(spark, tmp_path, options):
    parts = model(spark)
    C.write_container(f"{tmp_path}/c", *parts, **options)
    c = C.open_container(spark, f"{tmp_path}/c")
    assert {r.variant_index: bytes(r.payload) for r in c.payloads().collect()} == {r.variant_index: bytes(r.payload) for r in parts[1].collect()}
    assert c.verify().count() == 0 and bytes(c.asset("tokenizer.json").first().payload) == b'{"t":1}' and c.graphs.first().kind == "onnx"
    rows = {r.variant_index: r for r in c.variants.collect()}
    assert (rows[3].stored == 0) == (options.get("dedup", True)) and all(r.offset % 64 == 0 for r in rows.values())
    assert np.allclose({r.name: r["values"] for r in c.floats("wgpu").collect()}["weight"], np.arange(16), atol=0.1)
    assert {r.name: len(r["values"]) for r in c.floats().collect()} == {"weight": 16, "bias": 4, "copy": 16}
    with pytest.raises(FileExistsError):
        C.write_container(f"{tmp_path}/c", *parts)


def test_container_checks_and_tampering(spark, tmp_path):
    t, v, g, a, m = model(spark)
    with pytest.raises(ValueError, match="length"):
        C.write_container(f"{tmp_path}/x", t.withColumn("shape", F.array(F.lit(3).cast("long"))), v)
    with pytest.raises(ValueError, match="missing variant"):
        C.write_container(f"{tmp_path}/x", t, v.where("variant_index <> 2"))
    C.write_container(f"{tmp_path}/c", t, v, g, a, m)
    c = C.open_container(spark, f"{tmp_path}/c")
    broken = C.Container(**(c.__dict__ | {"blobs": c.blobs.withColumn("data", F.when(F.col("stored") == 1, F.lit(b"zz")).otherwise(F.col("data")))}))
    assert [(r.table, r.subject) for r in broken.verify().collect()] == [("variant", "1")]


def test_rewrite_shards_and_exports(spark, tmp_path):
    t, v, g, a, m = model(spark)
    more_t, more_v = C.add_encoded(t, v, "f16", "cuda")
    sharded = more_t.withColumn("shard_id", F.when(F.col("name") == "bias", 2).otherwise(1).cast("long"))
    C.write_container(f"{tmp_path}/c", sharded, more_v, g, a, m)
    c = C.open_container(spark, f"{tmp_path}/c")
    assert {r["values"][1] for r in c.floats("cuda").collect()} == {1.0, 101.0}
    moved = tmp_path / "elsewhere"
    (tmp_path / "c/blobs/arena=canonical/shard_id=2").rename(moved)
    assert C.open_container(spark, f"{tmp_path}/c").verify().count() == 1
    import shutil

    shutil.move(moved, tmp_path / "shard2" / "arena=canonical") if (tmp_path / "shard2").mkdir() is None else None
    (tmp_path / "c/blobs/arena=packed/shard_id=2").rename(tmp_path / "shard2/arena=packed")
    whole = C.open_container(spark, f"{tmp_path}/c", {2: f"{tmp_path}/shard2"})
    assert whole.verify().count() == 0
    C.rewrite(whole, f"{tmp_path}/d", drop_targets=("wgpu",), drop_graphs=True, drop_assets=("tokenizer.json",), drop_metadata="arch", level=3)
    d = C.open_container(spark, f"{tmp_path}/d")
    assert d.graphs.count() == 0 and d.assets.count() == 0 and "wgpu" not in {r.target for r in d.variants.collect()} and {r.key for r in d.metadata.collect()} >= {"framework"} and d.verify().count() == 0
    assert C.export_safetensors(d, f"file://{tmp_path}/out").first().tensors == 3
    back = {r.name: r for r in read_tensors(spark, f"{tmp_path}/out", payload=True).collect()}
    assert back["weight"].shape == [4, 4] and bytes(back["bias"].payload) == (100 + np.arange(4, dtype="<f4")).tobytes()
    C.export_safetensors(whole, f"file://{tmp_path}/floats", target="wgpu", as_floats=True).collect()
    assert read_tensors(spark, f"{tmp_path}/floats").first().length == 64
    saved = C.save_blobs(whole.assets.select("name", "payload"), f"file://{tmp_path}/files").first()
    assert (tmp_path / "files/tokenizer.json").read_bytes() == b'{"t":1}' and saved.bytes == 7
    with pytest.raises(Exception, match="not raw"):
        C.export_safetensors(whole, f"file://{tmp_path}/no", target="wgpu").collect()


def test_streamed_tensors(spark, tmp_path):
    from plumeria.streaming.writer import append_tensors, read_appended, state_dict

    schema = "name string, dtype string, shape array<bigint>, payload binary"
    rows = lambda *x: spark.createDataFrame([(n, "f32", [1], b) for n, b in x], schema)
    rows(("a", b"1111"), ("b", b"2222")).write.parquet(f"{tmp_path}/in/p=0")
    for _ in range(2):  # the second run has nothing new
        q = append_tensors(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    rows(("a", b"3333")).write.parquet(f"{tmp_path}/in/p=1")
    append_tensors(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert {r.name: bytes(r.payload) for r in read_appended(spark, f"{tmp_path}/out").collect()} == {"a": b"3333", "b": b"2222"}
    assert [r.name for r in state_dict(spark, f"{tmp_path}/out").collect()] == ["a", "b"]
