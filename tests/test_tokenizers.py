"""Tokenisers on given inputs and outputs."""

import json

import pyarrow as pa
import pytest

from plumeria.functions.texts import isolate, normalise, pretokenise
from plumeria.operators import tokenizers as T
from plumeria.operators.tokenizers import Tokenizer, UnknownToken, decode_ids, encode_texts, vocabulary, word_level_ids
from pyspark.sql import functions as F


def ids(spark, tok, *texts, **options):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
    return [r.ids for r in encode_texts(df, tok, **options).orderBy("k").collect()]


def pair(spark, tok, a, b):
    df = spark.createDataFrame([(a, b)], "text string, second string")
    r = encode_texts(df, tok, second="second").first()
    return r.ids, r.type_ids, r.special_mask


def text(spark, tok, row):
    return decode_ids(spark.createDataFrame([(row,)], "ids array<bigint>"), tok).first().text


BPE = Tokenizer("BPE", {"h": 0, "e": 1, "l": 2, "o": 3, "hello": 4, "Ġworld": 5}, {("h", "e"): 0, ("he", "l"): 1, ("hel", "l"): 2, ("hell", "o"): 3}, pretokeniser={"type": "ByteLevel", "add_prefix_space": False})


def test_bpe(spark):
    assert ids(spark, BPE, "hello world", None, "") == [[4, 5], None, []]
    assert text(spark, BPE, [4, 5]) == "hello world"
    fallback = Tokenizer("BPE", {"<0xC3>": 0, "<0xA9>": 1}, byte_fallback=True)
    assert ids(spark, fallback, "é") == [[0, 1]] and text(spark, fallback, [0, 1]) == "é"
    with pytest.raises(UnknownToken):
        BPE.piece_ids()("z")


def test_bpe_merges_the_lowest_rank_first():
    tok = Tokenizer("BPE", {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, {("b", "a"): 0, ("a", "b"): 1, ("a", "ba"): 2})
    assert tok.piece_ids()("abab") == [4, 1]  # b a first, then a ba
    assert tok.piece_ids()("aab") == [0, 2]


def test_unigram(spark):
    tok = Tokenizer("Unigram", {"<unk>": 0, "▁hello": 1, "▁world": 2}, scores={"<unk>": 0, "▁hello": -1_000_000, "▁world": -1_000_000}, unknown="<unk>", pretokeniser={"type": "Metaspace", "replacement": "▁", "add_prefix_space": True})
    assert ids(spark, tok, "hello world", "hello!") == [[1, 2], [1, 0]]
    assert text(spark, tok, [1, 2]) == "hello world"
    tie = Tokenizer("Unigram", {"<unk>": 0, "a": 1, "bc": 2, "ab": 3, "c": 4}, scores={"a": -1, "bc": -1, "ab": -1, "c": -1}, unknown="<unk>")
    assert tie.piece_ids()("abc") == [1, 2]


VOCAB = {t: k for k, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "hello", "world", "!", "un", "##aff", "##able"])}
BERT = Tokenizer(
    "WordPiece", VOCAB, unknown="[UNK]", normaliser={"type": "BertNormalizer"}, pretokeniser={"type": "BertPreTokenizer"},
    postprocessor={"type": "BertProcessing", "sep": ["[SEP]", 2], "cls": ["[CLS]", 1]}, decoder={"type": "WordPiece", "prefix": "##", "cleanup": True},
)


def test_wordpiece(spark):
    assert ids(spark, BERT, "Héllo unaffable world!") == [[1, 3, 6, 7, 8, 4, 5, 2]]
    assert pair(spark, BERT, "hello", "world") == ([1, 3, 2, 4, 2], [0, 0, 0, 1, 1], [1, 0, 1, 0, 1])
    assert text(spark, BERT, [3, 6, 7, 8, 4, 5]) == "hello unaffable world!"
    assert ids(spark, Tokenizer("WordPiece", {"[UNK]": 0, "missing": 1}, unknown="[UNK]", longest_word=2), "missing") == [[0]]


def test_normalisers(spark):
    def of(t, spec):
        return spark.createDataFrame([(t,)], "t string").select(normalise(F.col("t"), spec)).first()[0]

    assert of("ＨＥＬＬＯ", {"type": "Sequence", "normalizers": [{"type": "NFKC"}, {"type": "Lowercase"}]}) == "hello"
    assert of("é", {"type": "NFC"}) == "é" and of("éa", {"type": "StripAccents"}) == "ea"
    assert of("  x y\t", {"type": "Strip"}) == "x y" and of(" x ", {"type": "Strip", "strip_left": False}) == " x"
    assert of("a.b", {"type": "Replace", "pattern": "." , "content": "-"}) == "a-b" and of("abc1", {"type": "Replace", "pattern": {"Regex": "[a-b]+"}, "content": "x"}) == "xc1"
    assert of("A\x00​一b\n", {"type": "BertNormalizer"}) == "a​ 一 b "
    assert of(None, {"type": "NFC"}) is None
    with pytest.raises(ValueError):
        normalise(F.lit("x"), {"type": "Nothing"})


def test_pretokenisers(spark):
    def of(t, spec):
        return spark.createDataFrame([(t,)], "t string").select(pretokenise(F.col("t"), spec)).first()[0]

    chain = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Punctuation"}, {"type": "Digits", "individual_digits": True}]}
    assert of("hello-world!20", chain) == ["hello", "-", "world", "!", "2", "0"]
    assert of("a1b22", {"type": "Digits"}) == ["a", "1", "b", "22"] and of("it's (so)　é", {"type": "Whitespace"}) == ["it", "'", "s", "(", "so", ")", "é"]
    assert of("a,,b", {"type": "CharDelimiterSplit", "delimiter": ","}) == ["a", "b"]
    assert of("a1b2", {"type": "Split", "pattern": {"Regex": "[0-9]"}, "invert": True}) == ["1", "2"] and of("a1b2", {"type": "Split", "pattern": "[0-9]"}) == ["a", "b"]
    assert of(" x y", {"type": "Metaspace"}) == ["▁x▁y"] and of("", {"type": "Whitespace"}) == [] and of("x", None) == ["x"]
    assert of("a b", {"type": "ByteLevel"}) == ["Ġa", "Ġb"]


def test_special_tokens(spark):
    rows = spark.createDataFrame([("a<s><s>x .*\\E",), ("",)], "t string").select(isolate(F.col("t"), ["<s>", "<s><s>", ".*\\E"])).collect()
    assert [(s.text, s.special) for s in rows[0][0]] == [("a", False), ("<s><s>", True), ("x ", False), (".*\\E", True)] and rows[1][0] == []
    tok = Tokenizer("WordLevel", {"<s>": 0, "hello": 1}, specials=["<s>"], pretokeniser={"type": "Whitespace"})
    assert ids(spark, tok, "<s>hello") == [[0, 1]] and text(spark, tok, [0, 1]) == "<s> hello"


def test_templates_and_decoders(spark):
    post = {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "[CLS]"}}, {"Sequence": {"id": "A"}}, {"SpecialToken": {"id": "[SEP]"}}],
            "pair": [{"Sequence": {"id": "A"}}, {"SpecialToken": {"id": "[MID]"}}, {"Sequence": {"id": "B"}}, {"SpecialToken": {"id": "[SEP]"}}],
            "special_tokens": {"[CLS]": {"ids": [1]}, "[SEP]": {"ids": [2]}, "[MID]": {"ids": [5]}}}
    tok = Tokenizer("WordLevel", {"hello": 3, "world": 4}, pretokeniser={"type": "Whitespace"}, postprocessor=post)
    assert ids(spark, tok, "hello", "") == [[1, 3, 2], [1, 2]] and pair(spark, tok, "hello", "world")[0] == [3, 5, 4, 2]
    roberta = Tokenizer("BPE", {"<s>": 0, "</s>": 1, "low": 2, "er</w>": 3, "er": 3}, postprocessor={"type": "RobertaProcessing", "cls": ["<s>", 0], "sep": ["</s>", 1]}, decoder={"type": "BPEDecoder", "suffix": "</w>"})
    assert pair(spark, roberta, "low", "er")[0] == [0, 2, 1, 1, 3, 1]
    named = Tokenizer("BPE", {"low": 2, "er</w>": 3}, decoder={"type": "BPEDecoder", "suffix": "</w>"})
    assert text(spark, named, [2, 3]) == "low er"
    chain = {"type": "Sequence", "decoders": [{"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, {"type": "Strip", "content": " ", "start": 1, "stop": 0}, {"type": "Fuse"}]}
    assert text(spark, Tokenizer("Unigram", {"▁a": 0, "▁b": 1}, decoder=chain), [0, 1]) == "a b"
    with pytest.raises(Exception, match="7"):
        text(spark, named, [7])


def test_json_files(spark):
    raw = {"added_tokens": [{"id": 9, "content": "<pad>", "special": True}], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"},
           "model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}
    tok = Tokenizer.from_json(json.dumps(raw))
    assert ids(spark, tok, "AB<pad> b") == [[2, 9, 1]]
    assert {(r.token, r.special) for r in vocabulary(spark, tok).collect()} == {("a", False), ("b", False), ("ab", False), ("<pad>", True)}
    uni = Tokenizer.from_json(json.dumps({"model": {"type": "Unigram", "unk_id": 0, "vocab": [["<unk>", 0.0], ["x", -0.5]]}}))
    assert uni.unknown == "<unk>" and uni.scores["x"] == -500_000


def test_public_vocabulary_against_its_library(spark):
    import tokenizers

    with open("/opt/tokenizers/word_bpe_49k.json") as f:
        raw = f.read()
    lib = tokenizers.Tokenizer.from_str(raw)
    tok = Tokenizer.from_json(raw)
    words = [w for w in lib.get_vocab() if w.isalpha()][:50]
    search = tok.piece_ids()
    assert all(search(w) == [tok.vocab[w]] for w in words)


def test_word_level_table(spark):
    texts = spark.createDataFrame([(1, "b a  b"), (2, ""), (3, None), (4, "zz a")], "k int, text string")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id long")
    assert {r.k: r.ids for r in word_level_ids(texts, vocab, "k").collect()} == {1: [6, 5, 6], 2: [], 3: [], 4: [0, 5]}


def test_ids_do_not_depend_on_runs_and_memory(spark, monkeypatch):
    plain = T.Tokenizer("BPE", {c: k for k, c in enumerate("abcdef?")} | {"ab": 7, "abc": 8, "<s>": 9}, {("a", "b"): 0, ("ab", "c"): 1}, unknown="?", specials=["<s>"], pretokeniser={"type": "WhitespaceSplit"})
    texts = ["abc ab <s> a", None, "", "abcabc <s>", " ", "zz a" + " abc" * 9, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
    want = [[8, 7, 9, 0], None, [], [8, 8, 9], [], [6, 6, 0] + [8] * 9, None]
    for run, most in ((1 << 17, 500_000), (2, 1), (3, 0)):
        monkeypatch.setattr(T, "RUN", run)  # goes to the tasks with their function
        assert {r.k: r.ids for r in T.encode_column(rows, plain, "text", "ids").collect()} == dict(enumerate(want))
        made, words = T.PieceIds(plain, most), ["abc", "<s>", "zz", "ab"]
        assert [made.many(pa.array([w]), pa.array([w == "<s>"]))[0].tolist() for w in words * 2] == [[8], [9], [6, 6], [7]] * 2
        assert len(made.codes) <= most + 1
