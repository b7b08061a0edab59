"""Language identification by Bayesian evidence fusion.

The text gives the likelihood of each language under byte trigram models. The language that the markup
declares, the suffix of the address and the host give further evidence, whose tables are learned from the
whole input by grouped aggregation: how often texts of a language carry a declaration or a suffix, and how the
languages of a host are spread, drawn towards those of its domain and these towards all documents. Trigrams of
a text overlap and repeat, so a text counts as at most ``text_weight`` independent ones; on short or mixed
texts the other evidence decides.

The models are fitted on about ``train_rows`` distinct labelled texts of each language, chosen by a seeded hash
(whole texts; the bound is this parameter). A declaration counts by its primary subtag in small letters, so "en", "EN" and
"en-GB" are one. Languages are the declarations on at least ``least_rows`` rows; in a small table ``least_share`` of
them is enough too; where more than ``most_languages`` are, the commonest of them. Counts are brought to the same
total, so that a trigram that no language has seen tells nothing and a language with few texts doesn't draw
unusual ones. A language takes 256 KB of every task's memory, 64 MB at most by default, and 16 bytes of every row's intermediates.

Results, all cases included:
* a text without letters (null, empty, digits, signs) has no language and is rejected;
* so is one whose best language has a posterior below ``least_confidence`` or is not among ``wanted``;
* a null, blank declaration, suffix or host is no evidence; of equal posteriors the first language by code point wins;
* a rarer declaration is no language: it is evidence like any other;
* rows that agree in all evidence are judged alike, repeated rows too; an empty table gives an empty result,
  and without any declaration every text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from parlor.llm.common import durable, keep_rows, text_hash

BUCKETS = 1 << 16
MOST_LANGUAGES = 256
SHARD_BYTES = 1 << 20

#: ASCII letters lowered, other ASCII characters to a space, all bytes of other letters as they are.
FOLD = np.full(256, 32, dtype=np.uint32)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)


def primary_subtag(lang: Column) -> Column:
    """The part of a language tag before its first ``-`` or ``_``, in small letters; null if it is blank."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(lang.cast("string"), r"^[^-_]*", 0))), F.lit(""))


def _trigram_buckets(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at every byte (0 if it holds two spaces or crosses two texts), and where texts start."""
    lengths = np.fromiter((len(t) + 3 for t in texts), dtype=np.int64, count=len(texts))
    data = FOLD[np.frombuffer(b"   ".join([*texts, b""]), dtype=np.uint8)]
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b, c = data, np.append(data[1:], 32), np.append(data[2:], [32, 32])[: len(data)]
    mixed = (a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(2654435761)
    buckets = (mixed >> np.uint32(16)).astype(np.int64) % (BUCKETS - 1) + 1
    buckets[((a == 32) & (b == 32)) | ((b == 32) & (c == 32))] = 0
    return buckets, np.cumsum(lengths) - lengths


def _shards(texts: pa.Array, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size, so that a batch is never copied as a whole; a longer text is a run by itself."""
    start = size = 0
    for i, length in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and size + length > limit:
            yield start, texts.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += length
    if start < len(texts):
        yield start, texts.slice(start).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language in one partition."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        names = np.array(batch.column("lang").to_pylist(), dtype=object)
        for name in dict.fromkeys(names):
            own = batch.column("text").filter(pa.array(names == name))
            table = counts.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
            for _, shard in _shards(own, SHARD_BYTES):
                table += np.bincount(_trigram_buckets(shard)[0], minlength=BUCKETS)
    for name, table in counts.items():
        at = np.flatnonzero(table[1:]) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(table[at])], names=["lang", "bucket", "n"]
        )


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, train_rows: int = 2000,
          least_rows: int = 5, least_share: float = 0.01, most_languages: int = MOST_LANGUAGES, seed: int = 42) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the logarithms of trigram probabilities, one table for each language."""
    lang, text = primary_subtag(F.col(lang_col)), F.coalesce(F.col(text_col), F.lit(""))
    declared = docs.where(lang.isNotNull()).groupBy(lang.alias("lang")).agg(
        F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(text)).alias("texts")
    )
    total = declared.agg(F.sum("n").alias("n"))
    enough = (F.col("n") >= least_rows) | (F.col("n") >= F.lit(least_share) * total.scalar())
    common = sorted(declared.where(enough).orderBy(F.desc("n"), "lang").limit(most_languages).collect(), key=lambda row: row.lang)
    if not common:
        return [], np.zeros((BUCKETS, 0))
    names = [row.lang for row in common]
    shares = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(train_rows / row.texts) for row in common]))
    place = F.pmod(F.xxhash64(F.lit(seed), text), F.lit(1_000_000)) / 1e6
    sample = docs.where(place < F.try_element_at(shares, lang)).select(lang.alias("lang"), text.cast("binary").alias("text")).distinct()
    counts = (
        sample.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    places = {name: i for i, name in enumerate(names)}
    table = np.zeros((BUCKETS, len(names)), dtype=np.float32)
    for row in counts.toLocalIterator():  # at most BUCKETS rows for each language
        table[row.bucket, places[row.lang]] = row.n
    totals = table.sum(axis=0, dtype=np.float64)
    table *= (totals.max() / np.maximum(totals, 1)).astype(np.float32)
    logs = np.log((table + np.float32(0.5)) / np.float32(totals.max() + 0.5 * BUCKETS))
    logs[0] = 0
    return names, logs


def _likelihoods(shared, text_weight: float, fields: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        languages = logs.shape[1]
        for batch in batches:
            texts = batch.column("text")
            sums, sizes = np.zeros((len(texts), languages)), np.zeros(len(texts))
            for start, shard in _shards(texts, max(1 << 14, 4 * SHARD_BYTES // max(4, languages))):
                buckets, starts = _trigram_buckets(shard)
                here = slice(start, start + len(shard))
                if len(shard) == 1:  # perhaps a very long text: as many rows of the table as it has distinct trigrams
                    found, times = np.unique(buckets, return_counts=True)
                    sums[here] = times.astype(np.float64) @ logs[found]
                else:
                    sums[here] = np.add.reduceat(logs[buckets], starts, axis=0, dtype=np.float64)
                sizes[here] = np.add.reduceat((buckets > 0).astype(np.int64), starts)
            scale = np.minimum(1.0, text_weight / np.maximum(1.0, sizes))
            evidence = sums * scale[:, None]
            evidence -= evidence.max(axis=1, keepdims=True, initial=-np.inf)
            belief = np.exp(evidence)
            belief /= np.maximum(belief.sum(axis=1, keepdims=True), 1e-300)
            offsets = pa.array(np.arange(len(texts) + 1) * languages, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (evidence, belief)]
            columns = [batch.column(name) for name in fields.names]
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=[*fields.names, "evidence", "belief"])

    return run


def _learned(beliefs: DataFrame, key: str, n: int, smoothing: float) -> DataFrame:
    """``key, fit``: the logarithm of P(key | language) relative to P(key), smoothed; null keys are left out."""
    sums = [F.sum(F.col("belief")[i]).alias(f"s{i}") for i in range(n)]
    known = durable(beliefs.where(F.col(key).isNotNull()).groupBy(key).agg(*sums), key)
    totals = [x or 0.0 for x in known.agg(*[F.sum(f"s{i}") for i in range(n)]).first()]
    expected = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0)) / (sum(totals) or 1.0)
    fits = [F.log((F.col(f"s{i}") + smoothing * expected) / (t + smoothing) / expected) for i, t in enumerate(totals)]
    return known.select(key, F.array(*fits).alias("fit"))


def _priors(beliefs: DataFrame, n: int, smoothing: float) -> tuple[DataFrame, list[float]]:
    """``host, prior`` (logarithms), hosts drawn to their domain and domains to all; and the logarithms for all."""
    sums = [F.sum(F.col("belief")[i]).alias(f"s{i}") for i in range(n)]
    hosts = durable(beliefs.groupBy("host").agg(*sums), "hosts")
    row = hosts.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]).first()
    seen = np.array([row[i] or 0.0 for i in range(n)]) + 1.0
    overall = seen / seen.sum()
    size = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
    domain = F.substring_index(F.col("host"), ".", -2)
    domains = (
        hosts.where("host is not null").groupBy(domain.alias("domain")).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
    )
    drawn = [((F.col(f"s{i}") + smoothing * float(overall[i])) / (size + smoothing)).alias(f"d{i}") for i in range(n)]
    domains = durable(domains.select("domain", *drawn), "domains")
    priors = [F.log((F.col(f"s{i}") + smoothing * F.col(f"d{i}")) / (size + smoothing)) for i in range(n)]
    joined = hosts.where("host is not null").withColumn("domain", domain).join(domains, "domain")
    return joined.select("host", F.array(*priors).alias("prior")), [float(x) for x in np.log(overall)]


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    train_col: str = "lang",
    train_rows: int = 2000,
    least_rows: int = 5,
    least_share: float = 0.01,
    text_weight: float = 60.0,
    smoothing: float = 10.0,
    least_confidence: float = 0.5,
    wanted: Sequence[str] | None = None,
    model: tuple[list[str], np.ndarray] | None = None,
) -> DataFrame:
    """One row per document: ``id, raw, language, confidence, declared, kept``.

    ``declared``, ``host`` and ``suffix`` are string columns of ``docs``. Without a ``model`` from :func:`train`
    one is fitted on the rows of ``docs`` that have a language in ``train_col``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    none = F.lit(None).cast("string")
    names, logs = model or train(docs, text_col, train_col, train_rows=train_rows, least_rows=least_rows, least_share=least_share)
    evidence = {"declared": None if declared is None else primary_subtag(declared), "host": host, "suffix": suffix}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("raw"), F.rlike(text, F.lit(r"\p{L}")).alias("letters"),
        *[(none if c is None else c.cast("string")).alias(k) for k, c in evidence.items()], text.cast("binary").alias("text"),
    )
    if not names:
        return rows.select("id", "raw", none.alias("language"), F.lit(0.0).alias("confidence"), "declared", F.lit(False).alias("kept"))
    kept_fields = rows.drop("text").schema
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept_fields) + ", evidence array<double>, belief array<double>"
    beliefs = durable(rows.mapInArrow(_likelihoods(shared, text_weight, to_arrow_schema(kept_fields)), schema), "beliefs")
    known = beliefs.where("letters")
    n = len(names)
    fused = beliefs
    if host is not None:
        priors, overall = _priors(known, n, smoothing)
        fused = fused.join(durable(priors, "priors"), "host", "left")
        fused = fused.withColumn("evidence", _plus("evidence", F.coalesce("prior", F.array(*[F.lit(x) for x in overall])))).drop("prior")
    for key in ("declared", "suffix"):
        if evidence[key] is not None:
            fused = fused.join(durable(_learned(known, key, n, smoothing), f"{key}-fit"), key, "left")
            fused = fused.withColumn("evidence", F.when(F.col("fit").isNull(), F.col("evidence")).otherwise(_plus("evidence", F.col("fit")))).drop("fit")
    best = F.array_max("evidence")
    weight = F.aggregate("evidence", F.lit(0.0), lambda total, e: total + F.exp(e - best))
    language = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("evidence", best).cast("int"))
    confidence = F.when(F.col("letters"), 1 / weight).otherwise(0.0)
    judged = fused.select(
        "id", "raw", F.when(F.col("letters"), language).alias("language"), confidence.alias("confidence"), "declared"
    )
    kept = (F.col("confidence") >= least_confidence) & F.col("language").isNotNull()
    if wanted is not None:
        kept = kept & F.coalesce(F.col("language").isin(list(wanted)), F.lit(False))
    return judged.withColumn("kept", kept)


def _plus(name: str, other: Column) -> Column:
    return F.zip_with(F.col(name), other, lambda a, b: a + b)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, without those that :func:`identify` rejects."""
    rejected = durable(identify(docs, id_col, text_col, **options).where("not kept").select("id", "raw").distinct(), "rejected")
    return keep_rows(docs, id_col, text_col, rejected, rejected.limit(0))
