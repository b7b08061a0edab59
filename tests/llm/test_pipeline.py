"""The pipeline: its stages in order, whole rows, and the cases each one is there for."""

from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from parlor.llm.common import durable
from parlor.llm.similar import similar_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_rows_whole_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    clean = docs.where("length(text) > 600").orderBy("doc_id").limit(1).first()
    words = clean.text.split()
    near = " ".join([*words[: len(words) // 2], "changed", *words[len(words) // 2 :]])
    planted = [
        (900001, "  " + clean.text, "en", "p", 1), (900002, near, clean.lang, "p", 1),
        (900003, f"Some words of its own. {item} And more of them.", "en", "p", 1), (900004, "12345 ### 678", "en", "p", 1),
        (None, None, None, None, None),
    ]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, FOLDER), name)
        kept[name] = {r[0] for r in docs.select("doc_id").collect()}
        if name != "source_mixing":
            assert docs.columns == columns
    assert {900001, 900002, 900003} <= kept["language_id"] and not {900004, None} & kept["language_id"]
    assert len({900001, clean.doc_id} & kept["exact_dedup"]) == 1 and 900002 in kept["exact_dedup"]
    assert len({900001, 900002, clean.doc_id} & kept["simhash_near_dedup"]) == 1
    assert 900003 in kept["simhash_near_dedup"] and 900003 not in kept["benchmark_decontamination"]
    assert kept["source_mixing"] <= kept["benchmark_decontamination"] and docs.columns == [*columns, "epochs"]
    assert docs.where((F.col("epochs") < 1) | (F.col("epochs") > 3)).count() == 0


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert ids and len(ids) == len(set(ids))


def test_near_copies_are_found_and_nothing_else(spark):
    """At least nine of ten pairs with a similarity of 0.8, and no group without a chain of such pairs."""
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()
    sets, holders, label, links = {}, defaultdict(list), {}, []
    for doc_id, text in rows:
        words = (text or "").lower().split()
        own = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
        if own in sets or not own:
            continue
        common = Counter(other for shingle in own for other in holders[shingle])
        links += [(doc_id, o) for o, n in common.items() if n >= 0.8 * (len(own) + len(label[o]) - n)]
        sets[own], label[doc_id] = doc_id, own
        for shingle in own:
            holders[shingle].append(doc_id)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    root = {r.id: r.root for r in similar_groups(docs).select("id", "root").collect()}
    assert len(links) > 40 and sum(root[a] == root[b] for a, b in links) >= 0.9 * len(links)
    parent = {d: d for d in label}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in links:
        parent[top(a)] = top(b)
    chains = defaultdict(set)
    for d in label:
        chains[root[d]].add(top(d))
    assert all(len(c) == 1 for c in chains.values())
