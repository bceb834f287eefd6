"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), docs having the columns of documents,
and works on all that the stage before it kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinlake.llm.chunk_bpe import encode_texts
from twinlake.llm.cotraining import quality_scores
from twinlake.llm.minhash_dedup import near_duplicates
from twinlake.llm.source_mix import WORD, mix_sources
from twinlake.llm.suffix_dedup import remove_repeats
from twinlake.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Strings of so many bytes are looked for, and passages of so many words taken out, that occur again.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; it learns from the table labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels).where("kept").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of least doc_id."""
    return near_duplicates(docs).where("kept").select(COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur more than once; emptied ones stay, empty.

    51 words of three letters and their spaces are 203 bytes, so strings of
    PASSAGE_BYTES cover all but passages of yet shorter words.
    """
    out = remove_repeats(docs, PASSAGE_BYTES, as_text=True, least_words=PASSAGE_WORDS).withColumn("text", F.col("kept"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each whole copy, and one for a part.

    A part is the first words of its document, with single spaces between.
    Documents of which the mix takes nothing go.
    """
    docs = mix_sources(docs, carry=COLUMNS).where("taken > 0").select("carried.*", "taken", "size")
    part = F.col("taken") % F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), 1, part.cast("int")), " ")
    copies = F.array_repeat("text", F.expr("cast(taken div size as int)"))
    every = F.when(part > 0, F.concat(copies, F.array(cut))).otherwise(copies)
    out = docs.withColumn("text", F.explode(every)).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids) of each row; ids are little-endian unsigned 32-bit."""
    out = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n = F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens")
    return out.select("doc_id", "lang", "source", "n_chars", n, "ids")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: The stages are no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
