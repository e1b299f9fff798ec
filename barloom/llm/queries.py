"""The queries of this subpackage and their SQL; each is thin, its operator does the work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def llm_query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@llm_query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents in Arrow files of equal-length sequences, and what each document is when read back."""
    from .token_files import encode_and_read
    return encode_and_read(spark, table(spark, folder, "documents"), vocabulary())


@llm_query
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    from .packing import pack_documents
    return pack_documents(table(spark, folder, "documents"), vocabulary())


@llm_query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes from each document."""
    from .mixing import mix
    return mix(table(spark, folder, "documents"))


@llm_query
def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, certain ones and those whose parts complete each other."""
    from .secrets import secrets, spans_text
    found = secrets(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans_text(found["found"]).alias("spans"))


@llm_query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by a factorisation machine."""
    from .quality import quality
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@llm_query
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are 85 % alike."""
    from .jaccard import jaccard_components
    return jaccard_components(table(spark, folder, "documents"), 4, 85)


@llm_query
def op6_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.9 or more."""
    from .near_vectors import near_duplicates
    return near_duplicates(table(spark, folder, "embeddings"))


@llm_query
def op9_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose vec_id is divisible by 20."""
    from pyspark.sql import functions as F

    from .multi_index import search
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@llm_query
def op2_suffix_family(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document when repeated strings of 100 bytes go."""
    from .suffix_family import deduplicated
    return deduplicated(table(spark, folder, "documents"))


@llm_query
def op8_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document when repeated runs of three sentences go."""
    from .sentence_spans import without_repeats
    return without_repeats(table(spark, folder, "documents"))


@llm_query
def op11_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    from .licenses import licenses
    return licenses(table(spark, folder, "documents")).drop("found")


@llm_query
def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged conversations with their faults and their cheapest repair."""
    from .repair import repair
    return repair(table(spark, folder, "conversations"))


@llm_query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    from .prefixes import prefix_trie
    return prefix_trie(table(spark, folder, "conversations"))


def _op8_sql() -> str:
    from .sentence_spans import spans_sql
    return spans_sql()


ORACLES["op8_sentence_spans"] = _op8_sql()


def _conversation_sql() -> dict[str, str]:
    from .conversation_sql import prefixes_sql, repair_sql
    return {"op12_repair": repair_sql(), "op13_prefix_trie": prefixes_sql()}


ORACLES.update(_conversation_sql())
