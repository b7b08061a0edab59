"""Precedent retrieval: candidate search, class-aware re-ranking, corpus build."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parlor import defaults as D
from parlor.functions import scoring as S
from parlor.operators import ivf
from parlor.operators.classify import nearest_centroid
from parlor.operators.knn import DIGITS, Packed, candidate_type, corpus_size, listed_by_row, numbered, search_broadcast, similar_by_row
from parlor.operators.sampling import sample_n
from parlor.operators.skew import salted_join
from parlor.operators.threads import long_enough
from parlor.session import durable

CORPUS_COLUMNS = ["thread_id", "customer_message", "agent_reply", "class", "is_boilerplate", "embedding"]


def build_corpus(
    threads: DataFrame,
    table: Sequence[tuple[str, Sequence[float]]],
    *,
    vector_col: str = "embedding",
    max_items: int | None = None,
    min_length: int = 12,
    seed: int = 42,
    keywords: Mapping[str, Sequence[str]] = D.KEYWORDS,
    catch_all: str = D.CATCH_ALL,
    threshold: float = 0.48,
) -> DataFrame:
    """Retrieval corpus: all long enough threads, or a seeded sample of ``max_items``, with their class."""
    valid = long_enough(threads, ["customer_message", "agent_reply"], min_length)
    chosen = valid if max_items is None else sample_threads(valid, max_items, seed)
    tagged = nearest_centroid(
        chosen, "customer_message", vector_col, table, keywords=keywords, catch_all=catch_all, threshold=threshold
    )
    return tagged.withColumnRenamed(vector_col, "embedding").select(*CORPUS_COLUMNS)


def thread_key() -> Column:
    """Digest of a corpus row; several replies to one message share their ``thread_id``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("thread_id", "customer_message", "agent_reply")]
    return F.md5(F.concat_ws("\u0001", *parts))


def sample_threads(threads: DataFrame, n: int, seed: int) -> DataFrame:
    return sample_n(threads.withColumn("_row_key", thread_key()), n, "_row_key", seed).drop("_row_key")


def rerank(candidates: Column, predicted: Column, top_k: int, catch_all: str = D.CATCH_ALL) -> Column:
    """Top-k of the candidates by adjusted score; equal scores keep similarity order, then id, then key.

    Works on the row's own candidate array, so it needs no shuffle.
    """

    def scored(c: Column) -> Column:
        score = S.half_even(S.ranking_score(c["similarity"], c["class"], predicted, c["is_boilerplate"], catch_all=catch_all), 4)
        return F.struct(
            (-score).alias("k"),
            (-S.half_even(c["similarity"], DIGITS)).alias("s"),
            c["id"].alias("id"),
            c["key"].alias("key"),
            F.struct(
                c["id"].alias("id"),
                S.half_even(c["similarity"], 4).alias("raw_similarity"),
                score.alias("ranking_score"),
                c["class"].alias("class"),
                c["is_boilerplate"].alias("is_boilerplate"),
                c["key"].alias("key"),
            ).alias("m"),
        )

    return F.transform(F.slice(F.array_sort(F.transform(candidates, scored)), 1, top_k), lambda x: x["m"])


def _with_replies(kept: Column, replies: Column) -> Column:
    """The matches with their replies; ``replies`` may be shorter, the matches beyond have none."""
    return F.zip_with(kept, replies, lambda m, r: m.dropFields("key").withField("reply", r))


def replies_from_broadcast(found: DataFrame, replies: Mapping[str, str]) -> DataFrame:
    """Turn ``_kept`` into ``matches`` with the reply of each corpus row, looked up by its key."""
    texts = found.sparkSession.sparkContext.broadcast(dict(replies))

    @F.pandas_udf("array<string>")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series([[texts.value[k] for k in row] for row in keys], dtype=object)

    found = found.withColumn("_replies", look_up.asNondeterministic()(F.transform("_kept", lambda m: m["key"])))
    return found.withColumn("matches", _with_replies(F.col("_kept"), F.col("_replies"))).drop("_kept", "_replies")


def replies_from_join(found: DataFrame, replies: DataFrame, count: int | None = None) -> DataFrame:
    """The same for a corpus beyond the broadcast bound: top-k small rows per query row are joined.

    A reply that suits very many queries is spread by the salted join. Only the first ``count`` matches get theirs.
    """
    if count == 0:
        return found.withColumn("matches", _with_replies(F.col("_kept"), F.array().cast("array<string>"))).drop("_kept")
    found = durable(found)  # read for the keys and again for the scores
    asked = F.col("_kept") if count is None else F.slice("_kept", 1, count)
    wanted = found.select("_row", F.posexplode(asked).alias("_at", "_m")).select("_row", "_at", F.col("_m.key").alias("key"))
    joined = salted_join(wanted, replies.dropDuplicates(["key"]), ["key"], "left", F.col("_row"))
    gathered = joined.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "agent_reply"))).alias("_r"))
    listed = gathered.select("_row", F.transform("_r", lambda r: r["agent_reply"]).alias("_replies"))
    matches = F.when(F.size("_kept") == 0, _with_replies(F.col("_kept"), F.array().cast("array<string>"))).otherwise(
        _with_replies(F.col("_kept"), F.col("_replies"))
    )
    return found.join(listed, "_row", "left").withColumn("matches", matches).drop("_kept", "_replies")


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    query_id: str,
    class_col: str,
    vector_col: str = "embedding",
    top_k: int = 3,
    catch_all: str = D.CATCH_ALL,
    exclude_same_id: bool = False,
    max_broadcast_bytes: int = 64 * 1024 * 1024,
    replies: int | None = None,
) -> DataFrame:
    """Add ``matches, best_similarity, mean_similarity, grounding_ids``.

    The pool of ``10 * top_k`` candidates is chosen by raw similarity, then re-ranked. An empty
    corpus gives empty matches and similarity 0. Every corpus row is a match with its own reply,
    also where several share a ``thread_id``; queries may share an id as well. A caller that reads the replies of
    the first ``replies`` matches only may say so; beyond the broadcast bound the others then stay null.
    """
    pool = corpus.select(
        "thread_id", F.col("embedding").alias(vector_col), "class", "is_boilerplate", "agent_reply", thread_key().alias("key")
    )
    extra = ["class", "is_boilerplate", "key"]
    kept = rerank(F.col("candidates"), F.col(class_col), top_k, catch_all)
    options = dict(query_id=query_id, vector_col=vector_col, exclude_same_id=exclude_same_id)
    # Read several times below, without its texts.
    searched = durable(pool.withColumn("_bytes", F.octet_length("agent_reply")).drop("agent_reply"))
    if corpus_size(searched, vector_col, [], len(extra) + 2, "_bytes") <= max_broadcast_bytes:
        # One pass gathers vectors and replies.
        packed = Packed(pool, "thread_id", vector_col, extra, ["key"], ["agent_reply"])
        found = search_broadcast(queries, packed, top_k * 10, **options).withColumn("_kept", kept).drop("candidates")
        ranked = replies_from_broadcast(found, dict(zip(packed.table["key"], packed.table["agent_reply"])))
    else:
        # Only ids, classes and vectors take part in the search; texts are joined last.
        rows = numbered(queries)
        asked = rows.select("_row", query_id, class_col, vector_col).where(F.col(vector_col).isNotNull())
        found = similar_by_row(asked, searched, top_k * 10, corpus_id="thread_id", extra=extra, ties=["key"], **options)
        joined = replies_from_join(found.select("_row", kept.alias("_kept")), pool.select("key", "agent_reply"), replies)
        ranked = _joined_to(rows, joined)
    return with_similarities(ranked)


def _joined_to(rows: DataFrame, joined: DataFrame) -> DataFrame:
    kind = joined.schema["matches"].dataType
    found = rows.join(joined, "_row", "left").drop("_row")
    return found.withColumn("matches", F.coalesce("matches", F.array().cast(kind)))


def write_corpus_index(corpus: DataFrame, path: str, **options) -> ivf.VectorIndex:
    """Write a corpus (:data:`CORPUS_COLUMNS`) as a vector index that :func:`retrieve_indexed` searches, now or in a later session."""
    keyed = corpus.select(*CORPUS_COLUMNS, thread_key().alias("key"))
    carried = [c for c in keyed.columns if c not in ("thread_id", "embedding")]
    return ivf.write_index(keyed, path, id_col="thread_id", vector_col="embedding", extra=carried, **options)


def retrieve_indexed(
    queries: DataFrame,
    index: ivf.VectorIndex,
    *,
    query_id: str,
    class_col: str,
    vector_col: str = "embedding",
    top_k: int = 3,
    catch_all: str = D.CATCH_ALL,
    exclude_same_id: bool = False,
    approximate: bool = False,
    replies: int | None = None,
) -> DataFrame:
    """:func:`retrieve` in an index on disk: no row is assigned or classified again, only visited cells are read.

    With ``approximate`` the pool comes from product-quantised codes.
    """
    extra, rows = ["class", "is_boilerplate", "key"], numbered(queries)
    asked = rows.select("_row", query_id, class_col, vector_col).where(F.col(vector_col).isNotNull())
    if index.rows is None:
        texts = F.array().cast("array<struct<id:string,raw_similarity:double,ranking_score:double,class:string,is_boilerplate:boolean,reply:string>>")
        return with_similarities(rows.drop("_row").withColumn("matches", texts))
    search = ivf.search_approximate if approximate else ivf.search_index
    pairs = search(asked, index, top_k * 10, query_id=query_id, vector_col=vector_col, row_id="_row", extra=extra, ties=["key"], exclude_same_id=exclude_same_id)
    found = listed_by_row(asked, pairs, candidate_type(index.rows, "id", extra), extra, ["key"])
    kept = rerank(F.col("candidates"), F.col(class_col), top_k, catch_all)
    joined = replies_from_join(found.select("_row", kept.alias("_kept")), index.rows.select("key", "agent_reply"), replies)
    return with_similarities(_joined_to(rows, joined))


def with_similarities(ranked: DataFrame) -> DataFrame:
    """Add ``best_similarity, mean_similarity, grounding_ids`` from ``matches``."""
    raw = F.transform("matches", lambda m: m["raw_similarity"])
    total = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x)
    return ranked.withColumns(
        {
            "best_similarity": F.coalesce(S.half_even(F.array_max(raw), 4), F.lit(0.0)),
            "mean_similarity": F.coalesce(S.half_even(F.try_divide(total, F.size(raw)), 4), F.lit(0.0)),
            "grounding_ids": F.transform("matches", lambda m: m["id"].cast("string")),
        }
    )
