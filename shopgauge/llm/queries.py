"""The numbered operators as queries over the whole `documents` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgauge.llm import decontaminate, exactdup, hilbert, katz, mixing, neardup, passages, pii, quality, resampling, tokens, toxicity, trie
from shopgauge.llm.shared import KEYS, shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def _listed(spans: Column) -> Column:
    """kind:begin:end of the spans by kind as listed, then begin, comma-joined."""
    def of_kind(kind: str) -> Column:
        return F.array_sort(F.transform(F.filter(spans, lambda x: x["kind"] == kind), lambda x: F.struct(x["begin"], x["end"], x["kind"])))

    return F.array_join(F.transform(F.concat(*map(of_kind, pii.KINDS)), lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op1_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_ columns count base spans; `spans` also has what the learned patterns add."""
    found = pii.personal_data(documents(spark, sf_dir))
    base = F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(_count, pii.KINDS), base, _listed(F.concat("base", "more")).alias("spans"), F.size("more").alias("n_more"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(documents(spark, sf_dir))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir)).drop("root", *KEYS)


def op4_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(documents(spark, sf_dir))


def op5_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.deduplicate(documents(spark, sf_dir), exactdup.DigestIndex(spark, shared_folder(spark)))


def op6_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.without_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(documents(spark, sf_dir)).drop(*KEYS)


def op9_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, labels(spark, sf_dir)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item that it holds: the clean documents have none."""
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir)).drop(*KEYS)


def op11_arrow_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), benchmark(spark, sf_dir))


#: The public vocabulary whose tokens are counted.
VOCABULARY = "byte_bpe_50k.json"


def op12_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # where the vocabulary files are

    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op13_double_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie.prefix_nodes(*trie.rebuilt(trie.numbered(conversations)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bootstrap": op1_bootstrap,
    "op2_katz": op2_katz,
    "op3_minhash": op3_minhash,
    "op4_fair_queue": op4_fair_queue,
    "op5_digest_index": op5_digest_index,
    "op6_automata": op6_automata,
    "op7_ftrl": op7_ftrl,
    "op8_hilbert": op8_hilbert,
    "op9_subword": op9_subword,
    "op10_simhash": op10_simhash,
    "op11_arrow_resampling": op11_arrow_resampling,
    "op12_token_lengths": op12_token_lengths,
    "op13_double_array": op13_double_array,
}
