from __future__ import annotations

import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import components, line_windows, minhash, oracle, queries
from tests.conftest import SF001
from tests.llm.conftest import prose


def brute_lines(docs, window=3):
    parts, first = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        lines = (t or "").split("\n")
        places = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        keys = ["\n".join(lines[p].strip(" \t\r") for p in places[k : k + window]) for k in range(len(places) - window + 1)]
        parts[i] = lines, places, keys
        for k, key in enumerate(keys):
            first.setdefault(key, (i, k))
    for i, (lines, places, keys) in parts.items():
        gone, own = set(), {}
        for k, key in enumerate(keys):
            own.setdefault(key, k)
            if first[key][0] != i or k >= own[key] + window:
                gone.update(range(k, k + window))
        out = {places[k] for k in gone}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in out) if gone and len(gone) < len(places) else "" if gone else "\n".join(lines)
        yield i, kept, len(places), len(gone)


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(4)
    pool = [prose(rng, rng.randrange(1, 8)) for _ in range(25)] + ["", "  ", "\t"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(120)]
    passage = "\n".join(prose(rng, 20) for _ in range(5))
    docs += [(200 + i, prose(rng, 10) + "\n" + passage + "\r\n" + prose(rng, 10)) for i in range(4)]
    return docs + [(300, None), (301, ""), (302, "\n".join(["same"] * 11)), (303, passage), (304, passage), (305, "one\ntwo"), (306, "one\ntwo"), (307, "\n".join(f"line {k}" for k in range(3000)))]


def test_lines_equal_brute_force(make, lined):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_windows.dedup_lines(make(lined)).collect()}
    want = {i: (t, n, g) for i, t, n, g in brute_lines(lined)}
    assert got == want
    assert got[201][2] >= 5 and got[304][0] == "" and got[306][0] == "one\ntwo" and got[302][2] > 0


def test_lines_keep_other_columns_and_null_ids(clashing, corpus, make):
    out = line_windows.dedup_lines(clashing)
    assert set(clashing.columns) <= set(out.columns) and out.count() == len(corpus)
    text = "alpha one\nbeta two\ngamma three"
    rows = {(r.doc_id, r.text) for r in line_windows.dedup_lines(make([(None, text), (None, text), (5, text), (5, text), (2, text)])).collect()}
    assert rows == {(2, text), (5, ""), (None, "")}
    assert line_windows.dedup_lines(make([])).count() == 0


def brute_sets(docs):
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        yield i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs, percent=85):
    sets = list(brute_sets(docs))
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(i, least.get(find(x), i))
    return {i: (len(s), least[find(x)], i == least[find(x)]) for x, (i, s) in enumerate(sets)}


@pytest.fixture(scope="module")
def copied():
    """Groups of copies edited lightly and heavily, so that many links lie near the limit."""
    rng = random.Random(12)
    docs, i = [], 0
    for group in range(14):
        base = prose(rng, rng.choice([6, 20, 90, 250])).split()
        for _ in range(rng.choice([2, 5, 30])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 45))):
                w[rng.randrange(len(w))] = rng.choice(["changed", "edited", "other"])
            docs.append((i, " ".join(w) if rng.random() < 0.8 else "  ".join(w).title()))
            i += 1
    rng.shuffle(docs)
    return docs + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "one two three"), (906, prose(rng, 9000))]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(make, copied, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(make(copied), percent).collect()}
    assert got == brute_components(copied, percent)


def test_links_that_a_star_misses_are_found(make):
    """Every document differs from the source by more than the limit, but copies of a
    chain by less."""
    rng = random.Random(2)
    w, docs = prose(rng, 200).split(), []
    for i in range(24):
        docs.append((i, " ".join(w)))
        for _ in range(3):
            w[(i * 17 + rng.randrange(17)) % len(w)] = f"new{i}{rng.randrange(99)}"
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(make(docs), 85).collect()}
    assert got == brute_components(docs)


def test_prefixes_hold_every_link(spark):
    """Any two alike sets of different components share a shingle of their prefixes, and
    those that are not alike make few pairs."""
    rng = random.Random(3)
    shared, rows = list(range(60)), []
    for i in range(90):
        own = [1000 * i + k for k in range(rng.randrange(0, 40))]
        rows.append((i, sorted({x for x in shared + own if rng.random() < 0.93}), i))
    table = spark.createDataFrame(rows, "row long, set array<long>, label long")
    links = {(r.a, r.b) for r in minhash._prefix_links(table.select("row", "set"), table.select("row", "label"), 80).collect()}
    sets = [set(x) for _, x, _ in rows]
    assert links == {(a, b) for b in range(90) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert 10 < len(links) < 3000


def test_a_template_makes_no_pairs(spark):
    """Pages that share a template are in one bucket; their own words come first."""
    counts = []
    for pages in (100, 200, 400):
        rows = [(i, sorted([*range(70), *(10_000 + 100 * i + k for k in range(29)), 5000 + i // 2]), i) for i in range(pages)]
        table = spark.createDataFrame(rows, "row long, set array<long>, label long")
        counts.append(minhash._prefixes(table.select("row", "set"), table.select("row", "label"), 80).groupBy("token").count().selectExpr("sum(count * (count - 1) / 2)").first()[0] or 0)
    assert counts[1] <= 2.2 * counts[0] + 1 and counts[2] <= 2.2 * counts[1] + 1 and counts[2] < 1000


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("n", [5, 7, 10, 20, 40])
def test_recall_of_buckets_on_small_sets(n, percent):
    """Pairs just at the limit meet in a bucket."""
    rng, missed = np.random.default_rng(n), 0
    for _ in range(300):
        union = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        drop = rng.permutation(n)[: n - int(np.ceil(percent * n / 100))]
        cut = rng.integers(0, len(drop) + 1)
        a, b = (np.sort(np.delete(union, d)) for d in (drop[:cut], drop[cut:]))
        sig = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        keys = minhash.band_keys(sig, minhash.bins_per_band(percent))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_near_duplicates_of_ties_null_ids_and_nothing(make, clashing, corpus):
    text = prose(random.Random(1), 60)
    rows = minhash.near_duplicates(make([(None, text), (None, text), (4, text), (4, text), (9, text + " more"), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, 4, False), (-1, 4, False), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert minhash.near_duplicates(make([])).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(clashing, 85).collect()}
    assert got == brute_components(corpus)


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (5, 40, 400):
        same = []
        for _ in range(60):
            union = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            a, b = union, union[rng.permutation(len(union))[: int(0.8 * len(union))]]
            h = np.concatenate([a, np.sort(b)])
            sig = minhash.signatures(h, np.array([0, len(a), len(a) + len(b)]))
            assert (sig != 0).all()
            same.append((sig[0] == sig[1]).mean() - len(b) / len(a))
        assert abs(np.mean(same)) < 0.05


def test_shingle_sets_of_arrays_cut_from_others():
    texts = pa.array(["skip me", "a b c d e f", "", "A b  c d e\nf", "x", None]).slice(1)
    h, bounds = minhash.shingle_sets(texts.fill_null(""))
    assert np.diff(bounds).tolist() == [2, 0, 2, 1, 0]
    assert h[:2].tolist() == h[2:4].tolist()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(201, 200), (202, 201), (300, 300)]
    rng.shuffle(links)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF001, t)}.parquet'")
    want = con.sql(oracle.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF001).toPandas()
    assert list(got.columns) == list(want.columns)
    assert got.sort_values("doc_id").to_numpy().tolist() == want.sort_values("doc_id").to_numpy().tolist()
