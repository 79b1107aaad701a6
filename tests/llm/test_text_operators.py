"""Personal data, token files, toxicity and pieces against brute force, libraries and round trips."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import pieces, pii, token_files, toxicity
from lamina.session import shared_folder


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


_BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"[^0-9]", "", m)) <= 19 and _luhn(re.sub(r"[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
]


def _noise(seed, n, alphabet, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_pii_matches_plain_patterns(spark):
    texts = _noise(1, 600, "a@.+- 0123456789()_%Zé😀\n", 120) + _noise(2, 600, "1234 -+.@a", 160) + [
        "card 4111 1111 1111 1111, +1 (017) 555-7713, a.b@c.d_e@f.gh 1.2.3.4.5.6.7.8 001.2.3.0255", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    for row in pii.find_spans(df).collect():
        expected = [(k, m.start(), m.end()) for k, p, ok in _BASE for m in re.finditer(p, row.text or "") if ok(m[0])]
        assert [(s.kind, s.start, s.end) for s in row.spans if s.kind in pii.BASE_KINDS] == expected


def test_pii_long_runs_checksums_and_redaction(spark):
    long = ["1" * 200_000, "a" * 100_000 + "@b.c" + ".d" * 30_000, "+1" + " " * 100_000 + "x"]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert [len(r.spans) for r in pii.find_spans(df).orderBy("doc_id").collect()] == [0, 1, 0]
    text = "IBAN GB82 WEST 1234 5698 7654 32 and XY00 1234 5678 9012; card 3782 822463 10005 x@y.zz"
    out = pii.redact(pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert out.text == "IBAN <iban> and XY00 1234 5678 9012; card <short_card> <email>"


def test_pii_empty_table(spark):
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_files_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = _noise(3, 400, "ab  \n\t'’é1２3,.　\x85\x1c\0😀 ", 60) + [
        None, "", " lead  two\n\n three \n x\t y  z <|endoftext|> it's don't", "word. " * 4000]
    rows = list(enumerate(texts)) + [(None, "no id"), (5, texts[5]), (5, texts[5])]
    folder = shared_folder(spark, "tokens")
    token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("start", F.lit(0)), folder, path, 2)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32)
                 for r in token_files.digest(token_files.read_files(spark, folder)).collect())
    expected, before = [], 0
    for doc_id, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((-1 if doc_id is None else doc_id, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert got == sorted(expected)


def test_token_query_equals_the_untouched_tokenizer(spark, tmp_path):
    from lamina.llm import queries_text

    texts = ["end <|endoftext|> more", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b\n", "it's plain", "<|endoftext |>", None, "last one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, before = [], 0
    for doc_id, text in enumerate(texts):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, queries_text.END_ID]
        expected.append((doc_id, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    got = [tuple(r) for r in queries_text.op3_token_files(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == expected


def test_token_files_empty_table(spark):
    folder = shared_folder(spark, "tokens")
    token_files.write_files(spark.createDataFrame([], "doc_id long, text string"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_files.read_files(spark, folder).count() == 0


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([5, 9, 12, 13, 16, 45, 0])
    assert token_files.code_lengths(counts, 18).tolist() == [4, 4, 3, 3, 3, 1, 0]
    limited = token_files.code_lengths(counts, 3)
    assert limited.max() == 3 and (2.0 ** -limited[:6].astype(float)).sum() <= 1
    skewed = token_files.code_lengths(2 ** np.arange(40, dtype=np.int64), 18)
    assert skewed.max() == 18 and (2.0 ** -skewed.astype(float)).sum() == 1
    assert token_files.code_lengths(np.array([0, 7]), 18).tolist() == [0, 1]


def test_codec_checkpoints():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 5000) % 300
    codec = token_files.Codec(token_files.code_lengths(np.bincount(ids)))
    payload, base, local = codec.encode(ids, np.array([len(ids)]))
    at = local[::64]
    counts = np.full(len(at), 64)
    counts[-1] = len(ids) - 64 * (len(at) - 1)
    assert (codec.decode(np.frombuffer(payload, np.uint8), at, counts) == ids).all()
    # Any checkpoint stands alone.
    assert (codec.decode(np.frombuffer(payload, np.uint8), at[5:6], counts[5:6]) == ids[320:384]).all()


def test_grammar_events():
    reader = toxicity.Reader(toxicity.Model({"idiot": 4.0}, {"vequ": 3.0}, {}, -2.0, -4.0))
    assert set(reader.events("What an idiot.")) == {"insult"}
    assert set(reader.events("You idiot")) == {"insult+target"}
    assert set(reader.events("He is not an idiot")) == {"insult+negated+target"}
    assert set(reader.events("not here, over there, an idiot")) == {"insult"}
    assert set(reader.events("Ann said idiot")) == {"insult+reported"}
    assert set(reader.events("I will hurt you")) == set() and set(reader.events("you I hurt")) == {"threat+target"}
    assert set(reader.events("vequée")) == {"insult"} and not reader.events("")
    assert reader.score("You idiot") > reader.score("not an idiot") > reader.score("fine")


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words, toxic = [rng.choice(plain) for _ in range(40)], i % 9 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = "zork" + rng.choice(["ed", "ing", "er", "s", "ance", "ful"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(9000, None, "x"), (9001, "", "x"), (None, "zorker", "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(1, None), (5555, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, marks, F.col("doc_id") % 5 != 0))
    assert model.beginnings
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).where("doc_id is not null").collect()}
    held = [(got[i], t) for i, t in labels if i % 5 == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.98
    assert got[9000] == got[9001] == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "hello")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, none, F.lit(True)))
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()} == {1: 1, 2: 0}
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("most", [5000, 20])
def test_pieces_equal_the_library(spark, most):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    alphabet = [*"abthe  \n\t'é1３,.　😀 ", "the ", " in"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [
        None, "", " lead  two\n\n three \n x\t y    z <s> it's ▁ ▁▁a b▁c", "the " * 2000, "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(4)
    for row in pieces.decode(pieces.encode(df, path, most=most), path).collect():
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode(row.text or "")
        assert row.decoded == (row.text or "").replace("▁", " ")


def test_pieces_hold_few_texts_and_no_long_words():
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(2000)])], names=["text"])
    cut = list(pieces._slices(iter([batch])))
    assert max(b.num_rows for b in cut) <= 512 and pa.Table.from_batches(cut).column(0).to_pylist() == batch.column(0).to_pylist()
    folder = pieces.Folder(pieces.PieceTable({"a": (1, -1.0), "aa": (2, -0.5)}, (), 0, ()), {})
    for n in (3, 60, 61, 5000):
        assert len(folder["a" * n]) == 4 * (n // 2 + n % 2)
    assert set(map(len, folder)) == {3, 60}


def test_lattice_folds(spark):
    table = pieces.PieceTable({x: (i, -c) for i, (x, c) in enumerate(
        [("a", 2.0), ("b", 2.0), ("ab", 3.0), ("bc", 2.5), ("c", 1.7), ("abc", 6.5), ("cab", 3.1)])}, (), 0, ())

    def cost(segments):
        return sum(-table.pieces[s][1] if s in table.pieces else 1e4 for s in segments)

    def best(word):
        if not word:
            return []
        tails = [[word[:k], *best(word[k:])] for k in range(1, len(word) + 1) if k == 1 or word[:k] in table.pieces]
        return min(tails, key=cost)

    words = sorted(set(_noise(5, 60, "abcx", 8)) - {""})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    folder = pieces.Folder(table, {})
    for row in pieces.encode_words(df, spark, table, pieces.viterbi_fold).collect():
        assert abs(cost(row.segments) - cost(best(row.word))) < 1e-6 and "".join(row.segments) == row.word
    for row in pieces.encode_words(df, spark, table).collect():
        assert list(row.segments) == folder.merge(row.word)
