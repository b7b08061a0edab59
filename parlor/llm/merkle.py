"""Merkle manifest of a dataset, with proofs by octopus multiproofs.

Every row is a leaf. The leaves of a group ascend by id; every ``ARITY`` consecutive nodes of a level become one
node of the next until one remains, the group's subroot; the subroots, ordered by group, become the root likewise.
A node's coordinate is its tree, level and place; it hashes the hexadecimal text of its children.

Rows are numbered over all partitions by a range sort and the counts of its parts. ``BLOCK`` consecutive leaves of a tree
grow their levels together in one task, then so many of their tops, and so on. For proofs, leaves that lie together
make a leaf partition: some aligned blocks of neighbouring trees, less than two blocks of rows. Each one computes the coordinates that
the paths of its leaves need and that its leaves can't give: at every level the others of a run, without those it derives
itself. This union is fetched once, by one join with the manifest's nodes; interiors that paths share are then derived
once, and every leaf's own proof is read off them where it lies.

Results, all cases included:
* a null field is ``-`` in a leaf, which no value is; null ids and null groups come first in their order;
* rows with the same group and id are ordered by their leaf, rows that repeat in full by their place in the input,
  and each has its own place and proof;
* a group with one row has its leaf as subroot, a manifest with one group its subroot as root, both without siblings;
* long texts are hashed where they lie, only digests are shuffled; an empty table gives an empty result;
  other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from parlor.llm.common import MAX_BROADCAST_ROWS, durable

ARITY = 8
#: Levels that a task grows at once, and the leaves below them.
BLOCK_LEVELS = 3
BLOCK = ARITY**BLOCK_LEVELS
#: Number of the tree over the subroots; the groups' trees count from 0.
TOP = -1


def _sha(*texts: bytes) -> bytes:
    return hashlib.sha256(b"".join(texts)).hexdigest().encode()


def leaf_hash(*fields: Column) -> Column:
    """SHA-256, as hexadecimal text, of the fields: ``-`` if null, else the number of bytes, a colon and the value."""
    texts = [field.cast("string") for field in fields]
    return F.sha2(
        F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256
    )


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        columns = [pa.array([part] * n, pa.int64()), pa.array(range(place, place + n), pa.int64())]
        place += n
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_part", "_at"])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows (durable) with the column ``name``, their place from 0 in this order, found without a sort in one task."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_places, f"{fields}, _part long, _at long")
    placed = durable(placed, "placed")
    # One row for each partition.
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def height(size: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Rows that share the keys and follow each other, as lists; a group may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(values)], strict=True):
            key = tuple(values[start])
            if held and key != last:
                yield pa.Table.from_batches(held).to_pydict()
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held).to_pydict()


def _grow(base: int):
    """The next ``BLOCK_LEVELS`` levels above nodes of level ``base``, which come sorted by tree and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches, ["tree", "block"]):
            tree, first, size = block["tree"][0], block["block"][0] * BLOCK, block["size"][0]
            nodes, rows = [h.hex().encode() for h in block["hash"]], []
            for level in range(base + 1, base + 1 + BLOCK_LEVELS):
                if size <= 1:
                    break
                nodes = [_sha(*nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
                first, size = first // ARITY, -(-size // ARITY)
                rows += [(level, first + i, size, bytes.fromhex(h.decode())) for i, h in enumerate(nodes)]
            if rows:
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(rows), pa.int64()), *columns], names=["tree", "level", "place", "size", "hash"]
                )

    return run


def grow(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """All nodes above ``leaves (tree, place, size, hash)``: tables ``tree, level, place, size, hash``, lowest levels first.

    ``size`` is the number of nodes of the node's level, ``largest`` that of the largest tree's leaves.
    """
    tables, nodes, base = [], leaves, 0
    while largest > 1:
        block = F.floor(F.col("place") / BLOCK)
        dealt = nodes.where("size > 1").withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "place")
        grown = dealt.select("tree", "place", "size", "hash", "block").mapInArrow(
            _grow(base), "tree long, level long, place long, size long, hash binary"
        )
        base, largest = base + BLOCK_LEVELS, -(-largest // BLOCK)
        tables.append(durable(grown, f"level-{base}"))
        nodes = tables[-1].where(F.col("level") == base)
    return tables


@dataclass(frozen=True)
class Manifest:
    """``leaves``: ``id, tree, place, size, part, hash, claimed``; ``nodes``: ``tree, level, place, hash`` above them and in the
    tree of the subroots; ``groups``: ``tree, group, size, subroot``; all durable."""

    leaves: DataFrame
    nodes: list[DataFrame]
    groups: DataFrame
    trees: int
    root: str | None


def manifest(docs: DataFrame, id_col: str, group_col: str, leaf: Column, claimed: Column | None = None) -> Manifest:
    """Hash the rows and write all levels.

    ``leaf`` is a row's :func:`leaf_hash`; ``claimed`` one that is to be proved in its place (null: the leaf itself).
    """
    digest = lambda c: F.unhex(c) if c is not None else F.lit(None).cast("binary")
    hashed = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("group"), digest(leaf).alias("hash"), digest(claimed).alias("claimed"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("hash"), F.col("row")]
    rows = durable(numbered(durable(hashed, "hashed"), order, "at"), "numbered")
    sizes = durable(rows.groupBy("group").agg(F.min("at").alias("start"), F.count("*").alias("size")), "sizes")
    sizes = durable(numbered(sizes, [F.col("start")], "tree"), "trees")
    trees, largest = sizes.agg(F.count("*"), F.max("size")).first()
    known = sizes.withColumnRenamed("group", "own")
    known = F.broadcast(known) if trees <= MAX_BROADCAST_ROWS else known
    place = F.col("at") - F.col("start")
    leaves = rows.join(known, F.col("group").eqNullSafe(F.col("own"))).select(
        "id", "tree", place.alias("place"), "size", F.floor((F.col("at") - place % BLOCK) / BLOCK).alias("part"), "hash", "claimed"
    )
    leaves = durable(leaves, "leaves")
    nodes = grow(leaves.select("tree", "place", "size", "hash"), largest or 0)
    lone = [leaves.where("size = 1").select("tree", "hash")]
    tops = [table.where("size = 1").select("tree", "hash") for table in nodes]
    subroots = lone[0]
    for table in tops:
        subroots = subroots.unionByName(table)
    groups = durable(sizes.join(subroots.withColumnRenamed("hash", "subroot"), "tree").select("tree", "group", "size", "subroot"), "groups")
    tops = groups.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("size"), F.col("subroot").alias("hash"))
    above = grow(tops, trees)
    root = (above[-1] if above else tops).where("size = 1").select(F.lower(F.hex("hash"))).first()
    at_zero = tops.withColumn("level", F.lit(0).cast("long"))
    tables = [t.select("tree", "level", "place", "hash") for t in (*nodes, at_zero, *above)]
    return Manifest(leaves, tables, groups, trees, root and root[0])


def missing(places: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Coordinates ``(level, places)`` that the paths of these leaves need and that the leaves can't give."""
    level, own = 0, np.unique(places)
    while size > 1:
        above = np.unique(own // ARITY)
        runs = (above[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(runs[runs < size], own, assume_unique=True)
        level, own, size = level + 1, above, -(-size // ARITY)


def _wanted(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The coordinates that each leaf partition fetches."""
        for part in _groups(batches, ["part"]):
            tree, place, size = (np.array(part[c]) for c in ("tree", "place", "size"))
            found = [(TOP, level, p) for level, ps in missing(tree, trees) for p in ps.tolist()]
            for t in np.unique(tree).tolist():
                own = tree == t
                found += [(t, level, p) for level, ps in missing(place[own], int(size[own][0])) for p in ps.tolist()]
            if found:
                columns = [pa.array(c, pa.int64()) for c in ([part["part"][0]] * len(found), *zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "tree", "level", "place"])

    return run


#: What the others of a node's run are, to its left and right.
Sides = tuple[bytes, bytes]


def paths(leaves: dict[int, bytes], size: int, fetched: dict[tuple[int, int], bytes]) -> tuple[dict[int, list[Sides]], bytes]:
    """For each leaf its sides level by level, and the root, from the leaves (one or more) and the nodes they miss."""
    own, steps, level = leaves, [], 0
    while size > 1:
        sides, above = {}, {}
        for parent in sorted({place // ARITY for place in own}):
            first = parent * ARITY
            run = [own[p] if p in own else fetched[level, p] for p in range(first, min(first + ARITY, size))]
            for i in range(len(run)):
                if first + i in own:
                    sides[first + i] = (b"".join(run[:i]), b"".join(run[i + 1 :]))
            above[parent] = _sha(*run)
        steps.append(sides)
        own, size, level = above, -(-size // ARITY), level + 1
    found = {}
    for leaf in leaves:
        place, found[leaf] = leaf, []
        for sides in steps:
            found[leaf].append(sides[place])
            place //= ARITY
    return found, next(iter(own.values()))


def fold(leaf: bytes, steps: list[Sides]) -> bytes:
    for left, right in steps:
        leaf = _sha(left, leaf, right)
    return leaf


def _expand(trees: int, root: str, id_type: pa.DataType):
    text = [(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = pa.schema([("id", id_type), *text, ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Proofs of a leaf partition's rows; its fetched nodes come first."""
        for part in _groups(batches, ["part"]):
            fetched: dict[int, dict[tuple[int, int], bytes]] = {}
            owned: dict[int, dict[int, bytes]] = {}
            sizes: dict[int, int] = {}
            rows = []
            columns = (part[c] for c in ("is_leaf", "id", "tree", "level", "place", "size", "hash", "claimed"))
            for is_leaf, id_, tree, level, place, size, digest, claimed in zip(*columns, strict=True):
                hexed = digest.hex().encode()
                if is_leaf:
                    owned.setdefault(tree, {})[place], sizes[tree] = hexed, size
                    rows.append((id_, tree, place, hexed, claimed))
                else:
                    fetched.setdefault(tree, {})[level, place] = hexed
            below, subroots = {}, {}
            for tree, leaves in owned.items():
                below[tree], subroots[tree] = paths(leaves, sizes[tree], fetched.get(tree, {}))
            upper, derived = paths(subroots, trees, fetched.get(TOP, {}))
            if derived.decode() != root:
                raise ValueError("a leaf partition derives another root than the manifest's")
            found = []
            for id_, tree, place, leaf, claimed in rows:
                steps = below[tree][place] + upper[tree]
                folded = fold(leaf if claimed is None else claimed.hex().encode(), steps).decode()
                proof = _sha(*[side for step in steps for side in step]).decode()
                found.append((id_, leaf.decode(), subroots[tree].decode(), root, proof, folded, folded == root))
            arrays = [pa.array(values, field.type) for values, field in zip(zip(*found, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def proofs(made: Manifest, wanted: Column | None = None) -> DataFrame:
    """One row per leaf (of those ``wanted``): ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``proof_sha256`` hashes the siblings from the leaf up, left to right; ``folded_root`` is what they and the claimed leaf give.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = made.leaves.schema["id"].dataType
    names = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema = f"id {kind.simpleString()}, {names}"
    if made.root is None:
        return made.leaves.sparkSession.createDataFrame([], schema)
    leaves = made.leaves if wanted is None else made.leaves.where(wanted)
    dealt = leaves.select("part", "tree", "place", "size").repartition("part").sortWithinPartitions("part")
    requests = durable(dealt.mapInArrow(_wanted(made.trees), "part long, tree long, level long, place long"), "requests")
    lowest = requests.where(F.col("tree") != TOP).agg(F.min("level")).first()[0]
    stored = made.nodes if lowest else [made.leaves.select("tree", F.lit(0).cast("long").alias("level"), "place", "hash"), *made.nodes]
    nodes = stored[0]
    for table in stored[1:]:
        nodes = nodes.unionByName(table)
    fetched = requests.join(nodes, ["tree", "level", "place"])
    both = leaves.withColumns({"is_leaf": F.lit(True), "level": F.lit(0).cast("long")}).unionByName(
        fetched.withColumn("is_leaf", F.lit(False)), allowMissingColumns=True
    )
    dealt = both.repartition("part").sortWithinPartitions("part", "is_leaf")
    return dealt.mapInArrow(_expand(made.trees, made.root, to_arrow_type(kind)), schema)
