"""Registered queries over whole documents: personal data, token files, toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import language_model, pieces, pii, token_files, toxicity
from lamina.llm.common import table
from lamina.llm.registry import query
from lamina.session import shared_folder


def _joined(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and span digests of personal data per document."""
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [_count(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )


#: Set this to use another copy of the tokenizer file.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, lengths and checksums of every document's ids, read back from the compressed files."""
    import public_tokenizers

    folder = shared_folder(spark, "token-files")
    token_files.write_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), END_ID, special=True)
    return token_files.digest(token_files.read_files(spark, folder))


def _fold() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of every fifth (by checksum of the id) are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), _fold() != 0))
    return toxicity.score(docs, model).select("doc_id", (_fold() == 0).alias("held_out"), "score", "predicted")


PIECES = "piece_bpe_32k.model"


@query("op9_pieces")
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's piece ids, and whether decoding them gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path(PIECES)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read_back = pieces.decode(pieces.encode(docs, path), path)
    return read_back.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"),
                            F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


def _tenth() -> F.Column:
    """A document without an id counts as one whose id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10))


@query("op13_lm_scores")
def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document under a smoothed word model and an attention model; every tenth is held out."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = language_model.score(docs, _tenth() != 0, public_tokenizers.path(TOKENIZER))
    return found.select("doc_id", (_tenth() == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
