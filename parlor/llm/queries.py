"""The registered queries of this folder over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlor.llm.align import Vocabularies, align
from parlor.llm.decontaminate import matches
from parlor.llm.exact_dedup import exact_groups
from parlor.llm.html_text import extract
from parlor.llm.jaccard_join import jaccard_groups
from parlor.llm.language_id import identify, train
from parlor.llm.line_dedup import dedup_lines
from parlor.llm.merkle import ascii_lower, leaf_hash, manifest, proofs
from parlor.llm.mixing import mix
from parlor.llm.quality import grade, train as train_quality
from parlor.llm.secret_scan import BASE_RULES, scan
from parlor.llm.simhash import near_groups
from parlor.llm.url_filter import UrlRule, host_of, judge_urls

URL_RULES = (
    UrlRule("com/", "allow"), UrlRule("example.com/en/", "block"), UrlRule("www.example.com/en/", "allow"),
    UrlRule("net/es/", "block"), UrlRule("net/fr/", "block"),
)

#: Where the files of the public tokenizers lie on the driver.
TOKENIZERS = "/opt/tokenizers"


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = matches(load(spark, folder, "documents"), load(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "allowed", "start", "stop")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(load(spark, folder, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(load(spark, folder, "pages")).select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(load(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Grades: 0 toxic, 1 poor, 2 good; kept if more likely than not above 0."""
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    rating = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = train_quality(docs, labels.select("doc_id", rating.alias("grade")))
    return grade(docs, model).drop("raw").withColumnRenamed("id", "doc_id")


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    def listed(spans):
        part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
        return F.array_join(F.transform(spans, part), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*[rule.kind for rule in BASE_RULES])
    counts = [F.size(of(rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in BASE_RULES]
    return scan(load(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    taken = (F.col("size") * F.col("epochs")).alias("taken")
    return mix(load(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken)


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by text, declared language and source as host; they have no address."""
    docs = load(spark, folder, "documents")
    judged = identify(docs, declared=F.col("lang"), host=F.col("source"))
    return judged.select(F.col("id").alias("doc_id"), "language", "confidence", "declared", "kept")


def language_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by their extracted text, the language of their markup, the suffix of their address and their host."""
    pages = load(spark, folder, "pages")
    # Everything travels with the row: ids may be null or occur several times.
    texts = extract(pages, languages=True).withColumn("host", F.nullif(host_of(F.col("url")), F.lit("")))
    suffix = F.substring_index("host", ".", -1)
    model = train(load(spark, folder, "documents"))
    judged = identify(texts, "id", declared=F.col("lang"), host=F.col("host"), suffix=suffix, model=model)
    return judged.select(F.col("id").alias("page_id"), "language", "confidence", "declared", "kept")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_groups(load(spark, folder, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(load(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the ids claims a text with small letters; its proof must fail unless the text had no others."""

    def leaf(text):
        return leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    claimed = F.when(tampered, leaf(ascii_lower(F.col("text"))))
    made = manifest(load(spark, folder, "documents"), "doc_id", "lang", leaf(F.col("text")), claimed)
    return proofs(made).withColumnRenamed("id", "doc_id")


def op12_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(load(spark, folder, "documents")).toDF("doc_id", "n_shingles", "component_id")


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    files = Vocabularies.read(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    return align(load(spark, folder, "documents"), files).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_html_extraction": op3_html_extraction,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_secret_scan": op6_secret_scan,
    "op7_source_mixing": op7_source_mixing,
    "op8_language_id": op8_language_id,
    "language_of_pages": language_of_pages,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_token_alignment": op13_token_alignment,
}
