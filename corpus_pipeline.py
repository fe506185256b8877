"""A corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. The last returns doc_id, n_tokens, ids (little-endian unsigned
32-bit integers), ids_sha256 and decoded_sha256, the digest of what the ids decode to.

Defined results: null texts count as empty; repeated rows and rows that share a doc_id are what each
stage's operator says of them; every other column passes through all stages but the last as it is,
whatever its name, except n_chars, which follows a redacted text; empty tables give no rows. What a
stage keeps in the shared folder is deleted once its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.llm import bpe, decontaminate, minhash, quality, secrets
from axisloom.llm._tables import Made, drop, read, stored
from axisloom.llm.queries import tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go; null texts count as empty ones."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    packed = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = quality.scored(packed, model).filter(F.col("score") >= quality.THRESHOLD)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five words are alike by 0.8 or more, that of smallest doc_id stays."""
    # at similarity 0.8, a pair shares no band with probability 6e-7
    return minhash.deduplicated(docs, percent=80, bands=36, rows=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text give way to a mark."""
    return secrets.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and a check that they decode."""
    import public_tokenizers

    tokenizer = bpe.Tokenizer(spark, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = tokenizer.round_trip(docs)
    return out.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_quality), ("near_duplicates", one_of_each), ("benchmark", without_benchmark), ("secrets", without_secrets), ("token_ids", token_ids)]

#: The classifier's weights come from iterative training, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with Made() as made:
            after = stored(stage(spark, docs, sf_dir), name)
        made.delete(spark, after)
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
