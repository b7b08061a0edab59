"""The registered queries of the folder against SQL and brute force over the smallest driver tables."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
import xxhash

from parlor.llm.oracles import ORACLES
from parlor.llm.queries import QUERIES, URL_RULES
from tests.compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def table():
    def read(name, columns):
        return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet'").fetchall()

    return read


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == []


def test_every_operator_has_a_query():
    assert {int(m[1]) for q in QUERIES if (m := re.match(r"op(\d+)_", q))} == set(range(1, 14))


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, table):
    rows = table("documents", "doc_id, text")
    prints = np.array([brute_fingerprint(t) for _, t in rows], dtype=np.uint64)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            low = min(label[j] for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4))
            if low < label[i]:
                label[i], changed = low, True
    groups = {}
    for (doc_id, _), k in zip(rows, label):
        groups.setdefault(k, []).append(doc_id)
    expected = {d: (f"{int(p):016x}", min(groups[k])) for (d, _), p, k in zip(rows, prints, label)}
    found = QUERIES["op4_simhash_near_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == expected and len(found) == len(rows)


def base_spans(text):
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
    )
    spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_secret_scan_matches_brute_force(spark):
    folder, expected = "/root/testdata/sf0.01", {}  # the smallest table holds no secret
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall():
        spans = base_spans(text or "")
        listed = ",".join(f"{kind}:{start}:{stop}" for start, _, kind, stop in spans)
        counts = tuple(sum(s[1] == k for s in spans) for k in range(3))
        expected[doc_id] = (*counts, hashlib.sha256(listed.encode()).hexdigest())
    found = QUERIES["op6_secret_scan"](spark, folder).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found} == expected
    assert sum(v[0] + v[2] for v in expected.values()) > 0


def test_decontamination_finds_the_planted_passages(spark, table):
    items = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in table("benchmark", "item_id, text")}
    texts = {d: " ".join(re.findall(r"[^\W_]+", (t or "").lower())) for d, t in table("documents", "doc_id, text")}
    exact = {(d, i) for d, t in texts.items() for i, w in items.items() if " ".join(w) in t}
    found = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op1_benchmark_decontamination"](spark, FOLDER).collect()}
    assert exact and {k for k, v in found.items() if v == 0} == exact
    # Whatever else is found must hold at least half of the item's words in order.
    for doc_id, item in set(found) - exact:
        assert sum(w in texts[doc_id].split() for w in items[item]) > len(items[item]) / 2


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules_match_brute_force(spark, table):
    expected = {}
    for page_id, url in table("pages", "page_id, url"):
        host, path = brute_host_path(url)
        fitting = [
            r for r in URL_RULES for name, rest in [r.rule.split("/", 1)]
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)
        ]
        best = max(fitting, key=lambda r: len(r.rule), default=None)
        expected[page_id] = (host, path, best and best.rule, best and best.verdict)
    rows = QUERIES["op2_url_filter"](spark, FOLDER).collect()
    assert len(rows) == len(expected)
    for row in rows:
        host, path, rule, verdict = expected[row.page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if rule else row.verdict in ("allow", "block")


def test_extraction_matches_the_articles(spark, table):
    from html import unescape

    expected = {}
    for page_id, url, html in table("pages", "page_id, url, html"):
        article = re.search(r"<article>(.*)</article>", html, re.DOTALL)[1]
        blocks = [" ".join(unescape(b).split()) for b in re.split(r"<[^>]*>", article)]
        text = " ".join(b for b in blocks if b)
        expected[page_id] = (url, text, len(text))
    found = QUERIES["op3_html_extraction"](spark, FOLDER).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in found} == expected


def test_language_agrees_with_the_declarations(spark, table):
    found = QUERIES["op8_language_id"](spark, FOLDER).collect()
    assert len(found) == len(table("documents", "doc_id"))
    assert sum(r.language == r.declared for r in found) >= 0.97 * len(found) and all(r.kept for r in found)
    pages = QUERIES["language_of_pages"](spark, FOLDER).collect()
    assert sum(r.language == r.declared for r in pages) >= 0.95 * len(pages) == 0.95 * len(table("pages", "page_id"))


def test_late_declarations_of_pages_are_read():
    from parlor.llm.html_text import page_language

    late = "<!-- <html lang=xx> " + "licence " * 1000 + "-->" + " " * 5000
    assert page_language(late + "<script>'<html lang=yy>'</script><HTML class='a' lang='fr-CA'><p lang=en>x") == "fr"
    assert page_language("<html class=a><html data-lang=xx hreflang=yy lang = de><p>x") == "de"
    assert page_language("<p lang=en>x") is page_language("") is page_language("<html") is None


def test_language_of_pages_with_null_and_repeated_ids(spark, tmp_path):
    text = {"en": "the house and the tree of this road with water", "fr": "la maison et le chemin de ville avec eau"}
    docs = [(i, text["en" if i % 2 else "fr"], "en" if i % 2 else "fr") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    late = "<!--" + "licence " * 1000 + "-->"
    pages = [(i, f"http://h.{lang}/", f"{late}<html lang={lang}><p>{text[lang]}</p>") for i, lang in [(None, "fr"), (None, "en"), (7, "fr"), (7, "en"), (8, "en")]]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["language_of_pages"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.language, r.declared) for r in found) == [
        (0, "en", "en"), (0, "fr", "fr"), (7, "en", "en"), (7, "fr", "fr"), (8, "en", "en")
    ]


def test_quality_on_held_out_rows():
    """Fitted on three quarters of the labels of a larger table, judged on the rest."""
    from parlor.llm.quality import features, fit

    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(
        f"SELECT quality, toxic, text FROM '{folder}/labels.parquet' JOIN '{folder}/documents.parquet' USING (doc_id) ORDER BY doc_id"
    ).fetchall()
    found = [features(text) for _, _, text in rows]
    grades = np.array([0 if toxic else 1 if not quality else 2 for quality, toxic, _ in rows])
    held = np.arange(len(rows)) % 4 == 0
    model = fit([x for x, h in zip(found, held) if not h], grades[~held])
    tails = model.tails(np.array([model.weights[x].sum(dtype=float) for x in found]))
    rejected, toxic = tails[:, 0] < 0.5, grades == 0
    assert (rejected & toxic & held).sum() >= 0.75 * (toxic & held).sum()
    assert (rejected & ~toxic & held).sum() <= 0.02 * (~toxic & held).sum()
    assert ((tails[:, 1] >= 0.5) == (grades == 2))[held].mean() >= 0.95
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_quality_query_returns_every_document(spark, table):
    rows = QUERIES["op5_quality_classifier"](spark, FOLDER).collect()
    assert len(rows) == len(table("documents", "doc_id"))
    assert all(0 <= r.expected_grade <= 2 and r.kept == (r.tail_probability >= 0.5) for r in rows)
