"""What the operators of this folder share: durable intermediates, row keys, dropping rows, components."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of an identifier list that may be broadcast: at 24 bytes a row about 24 MB.
MAX_BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: ``spark.checkpoint.dir``, in local mode else beside the warehouse tables."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = named or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/parlor-{spark.sparkContext.applicationId}"


def durable(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate that several jobs read as Parquet in the shared folder and read it back.

    The files outlive executors, give the planner a measured size, and let later jobs read single
    columns. They lie in one folder per application, which can be deleted after it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    if partition_by:
        return spark.read.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_hash(text: Column) -> Column:
    """64-bit hash of a text that tells null from empty."""
    return F.xxhash64(text.isNull(), text)


def without(df: DataFrame, drop: DataFrame, keys: Sequence[tuple[Column, str]]) -> DataFrame:
    """Rows of ``df`` whose key expressions are not in ``drop``; nulls match nulls.

    ``drop`` must be durable, since it is counted first: up to ``MAX_BROADCAST_ROWS`` rows are broadcast so
    that ``df`` stays where it is, more are joined by a shuffle.
    """
    renamed = {name: f"__drop_{uuid.uuid4().hex[:8]}_{i}" for i, (_, name) in enumerate(keys)}
    ids = drop.select(*[F.col(name).alias(new) for name, new in renamed.items()]).distinct()
    if ids.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        ids = F.broadcast(ids)
    condition = F.lit(True)
    for column, name in keys:
        condition = condition & column.eqNullSafe(F.col(renamed[name]))
    return df.join(ids, condition, "left_anti")


def keep_rows(docs: DataFrame, id_col: str, text_col: str, drop: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows ``(id, raw)`` of ``drop``, and one row of those in ``repeated``; both durable.

    ``raw`` is the :func:`text_hash`. Rows that agree in id and text can't be told apart by a join, so where
    one of them stays they are reduced to one.
    """
    rest = without(docs, drop, [(docs[id_col], "id"), (text_hash(docs[text_col]), "raw")])
    if repeated.isEmpty():
        return rest
    keys = [(rest[id_col], "id"), (text_hash(rest[text_col]), "raw")]
    marked = rest.join(
        repeated.select(F.col("id").alias("__repeated_id"), F.col("raw").alias("__repeated_raw")),
        keys[0][0].eqNullSafe(F.col("__repeated_id")) & (keys[1][0] == F.col("__repeated_raw")), "left_semi",
    )
    return without(rest, repeated, keys).unionByName(marked.dropDuplicates([id_col, text_col]))


def components(edges: DataFrame, a: str, b: str, seed: int = 42, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of long ids: one row ``(node, root)`` per id that has an edge.

    Each round every node is renamed to the node within two links with the smallest hash under the round's seed, and the
    graph shrinks to these names. Hashes give an expected constant factor a round whatever the order of the ids, chains
    included; a star takes one round. A round has two aggregations, which combine inside the map tasks, and joins
    that Spark splits where a node is hot; nothing is gathered.
    """
    current = durable(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []

    for turn in range(max_rounds):
        if current.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(seed + turn), c).alias("h"), c.alias("n"))
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = durable(both.groupBy("a").agg(F.least(F.min(order(F.col("b"))), order(F.col("a"))).alias("to")), "near")
        beside = both.join(near.toDF("b", "to"), "b").select("a", "to").union(near)
        moves = durable(beside.groupBy("a").agg(F.min("to")["n"].alias("to")), "moves")
        steps.append(moves)
        left, right = moves.toDF("a", "ra"), moves.toDF("b", "rb")
        current = durable(
            current.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    else:
        raise RuntimeError("the components did not converge")
    if not steps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0].toDF("node", "root")
    for moves in steps[1:]:
        roots = roots.join(moves.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return durable(roots, "roots")
