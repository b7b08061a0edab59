"""Merkle manifest, Jaccard join and token alignment against brute force, with their edge cases."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlor.llm import align, jaccard_join, merkle
from parlor.llm.queries import QUERIES, TOKENIZERS
from tests.llm.conftest import make

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# 11 Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps_of(levels, place):
    for nodes in levels[:-1]:
        first = place // 8 * 8
        yield "".join(nodes[first:place]), "".join(nodes[place + 1 : first + 8])
        place //= 8


def brute_manifest(rows):
    """``(id, group, leaf, claimed)`` to the rows of the proofs."""
    first = lambda value: (value is not None, value or 0 if isinstance(value, int) else (value or "").encode())
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    trees = []
    for group in sorted(groups, key=first):
        ordered = sorted(groups[group], key=lambda r: (first(r[0]), r[2]))
        trees.append((ordered, levels_of([r[2] for r in ordered])))
    top = levels_of([levels[-1][0] for _, levels in trees])
    root, found = top[-1][0], []
    for tree, (ordered, levels) in enumerate(trees):
        for place, (id_, _, leaf, claimed) in enumerate(ordered):
            steps, folded = [*steps_of(levels, place), *steps_of(top, tree)], claimed or leaf
            for left, right in steps:
                folded = sha(left + folded + right)
            found.append((id_, leaf, levels[-1][0], root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return found


def proved(df, **options):
    made = merkle.manifest(df, "doc_id", "lang", merkle.leaf_hash(F.col("doc_id"), F.col("lang"), F.col("text")), **options)
    return made, merkle.proofs(made)


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_proofs_match_brute_force_with_nulls_ties_and_many_blocks(spark):
    rows = [(i, f"text {i}", "xx") for i in range(1500)] + [(i, "same", None) for i in (5, 5, 5, None, None, 6)]
    rows += [(2000 + i, None, f"lang{i}") for i in range(70)] + [(-3, "é", "zz"), (None, "", "zz")]
    df = make(spark, rows, "doc_id long, text string, lang string")
    claimed = F.when(F.col("doc_id") % 7 == 0, merkle.leaf_hash(F.col("doc_id"), F.col("lang"), F.lit("other")))
    made, found = proved(df, claimed=claimed)
    leaves = [(i, lang, leaf_of(i, lang, t), leaf_of(i, lang, "other") if i is not None and i % 7 == 0 else None) for i, t, lang in rows]
    expected = brute_manifest(leaves)
    assert key(found.collect()) == key(expected)
    assert made.trees == 73 and {r[-1] for r in expected} == {True, False}


def test_proofs_of_some_leaves_fetch_no_more_than_they_miss(spark):
    rows = [(i, f"t{i}", "xx") for i in range(700)] + [(1000 + i, "", "yy") for i in range(3)]
    made, every = proved(make(spark, rows, "doc_id long, text string, lang string"))
    some = merkle.proofs(made, F.col("id").isin(0, 1, 9, 699, 1001)).collect()
    assert key(some) == key(every.where(F.col("doc_id" if "doc_id" in every.columns else "id").isin(0, 1, 9, 699, 1001)).collect())
    needed = {level: set(p.tolist()) for level, p in merkle.missing(np.array([0, 1, 9]), 700)}
    assert needed[0] == {2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15} and needed[1] == {2, 3, 4, 5, 6, 7}
    assert needed[2] == set(range(1, 8)) and needed[3] == {1}


def test_manifest_of_clashing_columns_one_row_and_none(docs, no_docs):
    made, found = proved(docs)
    assert found.count() == docs.count() and found.where("not verified").count() == 0
    one, lone = proved(docs.where("doc_id = 8"))
    row = lone.first()
    assert row.leaf == row.subroot == row.root == one.root and row.proof_sha256 == sha("")
    empty, none = proved(no_docs)
    assert empty.root is None and none.count() == 0 and none.columns == found.columns


def test_only_changed_texts_fail(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    changed = {d for d, t in rows if zlib.crc32(str(d).encode()) % 3 == 0 and t is not None and lower(t) != t}
    found = QUERIES["op11_merkle_manifest"](spark, FOLDER).collect()
    assert {r.doc_id for r in found if not r.verified} == changed and changed and len(found) == len(rows)


# 12 Jaccard join


def shingle_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows, least=80):
    sets = [shingle_set(t) for _, t in rows]
    label, holders = list(range(len(rows))), defaultdict(list)

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, own in enumerate(sets):
        common = Counter(j for shingle in own for j in holders[shingle])
        for shingle in own:
            holders[shingle].append(i)
        for j, n in common.items():
            if 100 * n >= least * (len(own) + len(sets[j]) - n):
                label[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (id_, _) in enumerate(rows):
        groups[top(i)].append(id_)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(id_, len(sets[i]), smallest[top(i)]) for i, (id_, _) in enumerate(rows)]


def test_jaccard_groups_match_brute_force_on_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    assert key(QUERIES["op12_jaccard_join"](spark, FOLDER).collect()) == key(brute_groups(rows))


def varied(count, words, changes, seed):
    """Copies of one text with words changed, so that many pairs lie on either side of the bound."""
    order = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    for _ in range(count):
        text = list(base)
        for at in order.integers(0, words, order.integers(0, changes + 1)):
            text[at] = f"n{order.integers(0, 40)}"
        yield " ".join(text)


@pytest.mark.parametrize("tile", [4096, 8])
def test_jaccard_groups_of_near_copies_are_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "SPREAD_LEVEL", 4)  # shingles dealt to several tasks too
    texts = [*varied(60, 100, 4, 1), *varied(60, 60, 5, 2), *varied(40, 250, 9, 3), *varied(30, 12, 1, 4)]
    rows = [(i * 37 % 1009, t) for i, t in enumerate(texts)]
    found = jaccard_join.jaccard_groups(make(spark, rows, "doc_id long, text string"), tile=tile).collect()
    expected = brute_groups(rows)
    assert key(found) == key(expected) and len({r[2] for r in expected}) > 8


def test_jaccard_links_at_the_bound_and_not_below(spark):
    # 24 shingles each: with 20 + 4 of them of their own, 20 of 28; with 2 changed at the end, 22 of 26; 8 of 10 is the bound itself.
    base = [f"a{i}" for i in range(13)]
    at_bound = " ".join([*base[:12], "z"])  # 9 shingles each, 8 common: 8 of 10
    below = " ".join([*base[:11], "y", "z"])  # 7 common: 7 of 11
    rows = [(1, " ".join(base)), (2, at_bound), (3, below), (4, None), (5, " \t"), (6, "few words"), (7, "FEW\nwords"), (None, "few  words")]
    found = {r.id: (r.n_shingles, r.component) for r in jaccard_join.jaccard_groups(make(spark, rows, "doc_id long, text string")).collect()}
    assert found == {
        1: (9, 1), 2: (9, 1), 3: (9, 3), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6), None: (1, 6),
    }
    assert 100 * 8 == 80 * 10


def test_jaccard_groups_of_clashing_columns_and_no_rows(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert key(jaccard_join.jaccard_groups(docs).collect()) == key(brute_groups(rows))
    assert jaccard_join.jaccard_groups(no_docs).count() == 0


def test_bitmaps_never_rule_out_an_overlap():
    order = np.random.default_rng(8)
    for _ in range(200):
        both = order.integers(0, 1 << 63, order.integers(1, 300), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, order.integers(0, 1 << 63, order.integers(0, 200), dtype=np.uint64)])) for _ in range(2))
        x, y = (np.frombuffer(jaccard_join.bitmap(s), dtype="<u8")[None, :] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        differing = int(np.bitwise_count(jaccard_join.folded(x, width) ^ jaccard_join.folded(y, width)).sum())
        assert jaccard_join.most_common(len(a), len(b), differing) >= len(np.intersect1d(a, b))


# 13 Token alignment


@pytest.fixture(scope="module")
def files():
    return align.Vocabularies.read(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenized(files):
    """Both tokenizers by their own libraries: ids with their bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(files.byte_bpe.decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
    letters = {c: bytes([n]) for c, n in align.byte_letters().items()}

    def run(text):
        left = [(t, b"".join(letters[c] for c in a.id_to_token(t))) for t in a.encode(f" {text}", add_special_tokens=False).ids]
        pieces = [(t, b.id_to_piece(t)) for t in b.encode(text)]
        right = [(t, bytes([int(p[3:5], 16)]) if b.is_byte(t) else p.replace("▁", " ").encode()) for t, p in pieces]
        return left, right

    return run


def brute_alignment(rows, tokenized):
    """Groups by common ends; links counted pair by pair."""
    docs = []
    for id_, text in rows:
        left, right = tokenized(text) if text else ([], [])
        data = f" {text}".encode()
        if b"".join(x for _, x in left) != data or b"".join(x for _, x in right) != data:
            left, right = [], []
        ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (left, right)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(([t for t, _ in left[i:x]], [t for t, _ in right[j:y]]))
            i, j = x, y
        docs.append((id_, len(left), len(right), groups, [(a, b) for p, q in groups for a in p for b in q]))
    counts = Counter(pair for *_, links in docs for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for id_, n_a, n_b, groups, links in docs:
        listed = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield (
            id_, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links),
            sha(listed) if groups else "",
        )


ODD = [
    "<|endoftext|> in a text <s> </s> <unk>", "a▁b", "日本語😀 text", "   ", "\n\n\t x", " lead", "\x00a", "é" * 50, "<0x0A>\r\n", "",
    None, "A" * 5000, " " * 3000 + "x", "don't we'll   end ", "नमस्ते दुनिया", "١٢٣ ½ ²", "áb‍﻿",
]


def test_alignment_matches_brute_force(spark, files, tokenized):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' WHERE length(text) < 4000").fetchall()
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "twice"), (None, "twice")]
    df = make(spark, rows, "doc_id long, text string")
    expected = key(brute_alignment(rows, tokenized))
    assert key(align.align(df, files).collect()) == expected
    # With few pairs in the broadcast, and with none, the rest is joined.
    assert key(align.align(df, files, most=50).collect()) == expected
    assert key(align.align(df, files, most=0).collect()) == expected


def test_the_query_reads_whole_tables(spark, tokenized):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    found = {r.doc_id: (r.n_a, r.n_b) for r in QUERIES["op13_token_alignment"](spark, FOLDER).collect()}
    assert len(found) == len(rows)
    for id_, text in rows[:40]:
        left, right = tokenized(text) if text else ([], [])
        assert found[id_] in ((len(left), len(right)), (0, 0))


def test_pointers_meet_at_common_ends():
    order = np.random.default_rng(4)
    for _ in range(300):
        total = int(order.integers(1, 80))
        a, b = (np.union1d(order.integers(1, total + 1, order.integers(0, total)), [total]) for _ in range(2))
        ga, gb = align.jump(a, b)
        cuts = np.intersect1d(a, b)
        assert ga.tolist() == np.searchsorted(cuts, a).tolist() and gb.tolist() == np.searchsorted(cuts, b).tolist()


def test_alignment_of_clashing_columns_and_no_rows(docs, no_docs, files):
    found = align.align(docs, files)
    assert found.count() == docs.count() and align.align(no_docs, files).count() == 0
    long, = found.where("id = 5").collect()
    assert long.n_a > 20_000 and long.n_groups <= min(long.n_a, long.n_b) and long.count_sum >= long.n_links
