"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Every partition of the documents (a sender) hashes its texts and sends each owner of a hash range its
sorted distinct fingerprints as Golomb-Rice coded differences, some two bytes less than raw ones and free
of texts. An owner decodes what it got and answers every sender with a bitmap of the fingerprints that
some other sender holds as well. Only documents under such a bit, or repeated inside their own sender,
are suspects. Their texts, and no others, are shuffled and compared byte by byte.

Results, all cases included:
* a null text counts as an empty one; texts without a visible character are equal to each other;
* of equal texts the one with the most code points stays, then the smallest id (null last); of rows
  that repeat in full exactly one stays;
* an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parlor.llm.common import durable, keep_rows, text_hash

WHITE = " \t\n\x0b\x0c\r"
FINGERPRINT_BITS = 48
#: Fingerprints that an owner gets on average, 16 MB when decoded.
OWNER_ROWS = 1_000_000
#: Suspect fingerprints that may be broadcast to filter texts where they lie: 8 bytes each, 16 MB in all.
MAX_BROADCAST_FINGERPRINTS = 2_000_000


def golomb_encode(values: np.ndarray, low: int) -> bytes:
    """Rice code (Golomb with a power of two) of sorted distinct values from ``low`` on."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(low))
    mean = max(1.0, float(steps.mean()) if len(steps) else 1.0)
    k = max(0, int(np.floor(np.log2(mean * 0.69315))) if mean > 1 else 0)
    quotients = (steps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(steps), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rests = steps & np.uint64((1 << k) - 1)
    bits = ((rests[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([len(steps), k, len(unary)], dtype="<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def golomb_decode(code: bytes, low: int) -> np.ndarray:
    """Inverse of :func:`golomb_encode`."""
    n, k, ones = (int(x) for x in np.frombuffer(code[:12], dtype="<u4"))
    split = 12 + (ones + 7) // 8
    unary = np.unpackbits(np.frombuffer(code[12:split], dtype=np.uint8), count=ones)
    quotients = (np.diff(np.flatnonzero(unary), prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(code[split:], dtype=np.uint8), count=n * k).reshape(n, k)
    rests = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64))
    return np.cumsum((quotients << np.uint64(k)) + rests, dtype=np.uint64) + np.uint64(low)


def _range_start(owner: int, owners: int) -> int:
    """Smallest fingerprint of an owner: ``value * owners >> bits`` is the owner of a value."""
    return -((-owner << FINGERPRINT_BITS) // owners)


def visible(text: Column) -> Column:
    """The text without its white space, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def fingerprint(visible_text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(visible_text), 64 - FINGERPRINT_BITS)


def _digests(owners: int, id_type: pa.DataType):
    schema = pa.schema([
        ("kind", pa.string()), ("sender", pa.int64()), ("pos", pa.int64()), ("id", id_type), ("chars", pa.int64()),
        ("raw", pa.int64()), ("fp", pa.int64()), ("sha", pa.binary()), ("owner", pa.int64()), ("code", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, position, seen = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            n = batch.num_rows
            seen.append(np.unique(batch.column("fp").to_numpy().astype(np.uint64)))
            none = pa.nulls(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["row"] * n), pa.array([sender] * n), pa.array(range(position, position + n)),
                    batch.column("id"), batch.column("chars"), batch.column("raw"), batch.column("fp"),
                    batch.column("sha"), none.cast(pa.int64()), none.cast(pa.binary()),
                ],
                schema=schema,
            )
            position += n
        values = np.unique(np.concatenate(seen)) if seen else np.array([], dtype=np.uint64)
        if not len(values):
            return
        of = (values * np.uint64(owners) >> np.uint64(FINGERPRINT_BITS)).astype(np.int64)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        names, codes = of[starts], []
        for owner, part in zip(names, np.split(values, starts[1:]), strict=True):
            codes.append(golomb_encode(part, _range_start(int(owner), owners)))
        n = len(names)
        none = pa.nulls(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["message"] * n), pa.array([sender] * n), none.cast(pa.int64()), none.cast(id_type),
                none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()),
                pa.array(names), pa.array(codes, pa.binary()),
            ],
            schema=schema,
        )

    return run


def _answers(owners: int):
    def run(messages: pd.DataFrame) -> pd.DataFrame:
        """All messages to one owner: a bitmap for each sender, set where another sender has the value too."""
        low = _range_start(int(messages["owner"].iloc[0]), owners)
        decoded = [golomb_decode(code, low) for code in messages["code"]]
        every = np.sort(np.concatenate(decoded))
        repeated = np.unique(every[1:][every[1:] == every[:-1]])
        maps = [np.packbits(np.isin(values, repeated, assume_unique=True)).tobytes() for values in decoded]
        return pd.DataFrame({"sender": messages["sender"], "owner": messages["owner"], "bitmap": maps})

    return run


def _flag(owners: int):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """One sender's rows with its bitmaps: who is suspect."""
        values, inverse, counts = np.unique(rows["fp"].to_numpy(np.uint64), return_inverse=True, return_counts=True)
        of = (values * np.uint64(owners) >> np.uint64(FINGERPRINT_BITS)).astype(np.int64)
        marks = counts > 1
        for owner, bitmap in zip(answers["owner"], answers["bitmap"], strict=True):
            here = slice(*np.searchsorted(of, [owner, owner + 1]))
            bits = np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), count=here.stop - here.start)
            marks[here] |= bits.astype(bool)
        return rows.assign(suspect=marks[inverse])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None,
                 max_broadcast: int = MAX_BROADCAST_FINGERPRINTS) -> DataFrame:
    """One row per document: ``id, raw, keep_id, keep_raw, group_size, kept, sha`` (see the module's text).

    ``raw`` is the hash of the whole original text. ``owners`` is the number of hash ranges; an owner decodes its share
    of all distinct fingerprints. By default they are as many as shuffle partitions, and more where that would leave an
    owner more than ``OWNER_ROWS`` rows.
    """
    spark = docs.sparkSession
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    id_field = docs.select(F.col(id_col).alias("id")).schema[0]
    id_type = T.StructType([id_field]).fields[0].dataType
    source = docs.select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"),
        text_hash(F.col(text_col)).alias("raw"),
        visible(F.col(text_col)).alias("norm"),
    )
    hashed = source.select(
        "id", "chars", "raw", fingerprint(F.col("norm")).alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")
    )
    kinds = f"kind string, sender long, pos long, id {id_type.simpleString()}, chars long, raw long, fp long, sha binary, owner long, code binary"
    sent = durable(hashed.mapInArrow(_digests(owners, _arrow(id_type)), kinds), "digests")
    rows = sent.where("kind = 'row'").select("sender", "pos", "id", "chars", "raw", "fp", "sha")
    answers = (
        sent.where("kind = 'message'").select("sender", "owner", "code")
        .groupBy("owner").applyInPandas(_answers(owners), "sender long, owner long, bitmap binary")
    )
    flags = (
        rows.select("sender", "pos", "fp").groupBy("sender").cogroup(answers.groupBy("sender"))
        .applyInPandas(_flag(owners), "sender long, pos long, fp long, suspect boolean")
        .where("suspect").select("sender", "pos")
    )
    flagged = durable(
        rows.join(flags.withColumn("suspect", F.lit(True)), ["sender", "pos"], "left")
        .withColumn("suspect", F.coalesce("suspect", F.lit(False))),
        "flagged",
    )
    suspects = flagged.where("suspect")

    # Byte verification: one row per distinct text among the suspects, counted inside the map tasks first.
    wanted = durable(suspects.select("fp").distinct(), "suspects")
    few = wanted.limit(max_broadcast + 1).count() <= max_broadcast
    texts = source.select(fingerprint(F.col("norm")).alias("fp"), "norm").join(
        F.broadcast(wanted) if few else wanted, "fp", "left_semi"
    )
    verified = (
        texts.groupBy("fp", "norm").agg(F.count("*").alias("n"))
        .select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "n")
        .groupBy("fp", "sha").agg(F.sum("n").alias("group_size"), F.count("*").alias("texts"))
    )
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("u"), "id", "sender", "pos", "raw"))
    chosen_rows = suspects.groupBy("fp", "sha").agg(best.alias("best"), F.count("*").alias("rows"))
    groups = durable(
        chosen_rows.join(verified, ["fp", "sha"], "left").select(
            "fp", "sha", F.col("best.id").alias("keep_id"), F.col("best.raw").alias("keep_raw"),
            F.col("best.sender").alias("keep_sender"), F.col("best.pos").alias("keep_pos"),
            F.when((F.col("group_size") == F.col("rows")) & (F.col("texts") == 1), F.col("group_size"))
            .otherwise(F.raise_error(F.lit("texts with one digest differ in their bytes"))).alias("group_size"),
        ),
        "groups",
    )
    # Of the groups only those with more than one row decide anything; Spark splits the hot ones of this join.
    return (
        flagged.join(groups.where("group_size > 1"), ["fp", "sha"], "left")
        .select(
            "id", "raw",
            F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("keep_raw", "raw").alias("keep_raw"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("group_size").isNull()
             | ((F.col("sender") == F.col("keep_sender")) & (F.col("pos") == F.col("keep_pos")))).alias("kept"),
            "sha",
        )
    )


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those whose group keeps another row; see :func:`exact_groups`.

    Rows that agree in id and text can't be told apart by a join; where a group keeps one of several
    such rows, they are reduced to one of them.
    """
    judged = durable(exact_groups(docs, id_col, text_col), "judged")
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw"))
    drop = durable(judged.where(~F.col("kept") & ~same).select("id", "raw"), "dropped")
    repeated = durable(judged.where(~F.col("kept") & same).select("id", "raw").distinct(), "repeated")
    return keep_rows(docs, id_col, text_col, drop, repeated)
