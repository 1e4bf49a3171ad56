"""Collocations, filter audits and count-vector joins against brute force, and the SQL of all corpus queries."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoutflow.llm import collocations, countjoin, filteraudit, neardup, registry

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "alpha beta gamma delta. alpha beta", "en", "a", 5), (2, "alpha beta gamma delta. alpha beta", "en", "a", 5), (3, "", "en", None, 0), (4, None, None, "a", None),
        (5, "one two", "fr", "b", 7), (5, "one two", "fr", "b", 7), (6, LONG, "en", "b", len(LONG)), (7, "\n\t .", None, "b", 3), (None, "one two", "fr", "b", 7),
    ]
    docs = spark.createDataFrame(rows, DOC)
    for name in ("n", "k", "phrase", "f", "a", "l", "r", "score", "rank", "mask", "part", "quality", "toxic", "id", "key", "component", "text_key", "point", "set_a", "size", "few", "bi"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs.cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, None), (5, 1, 1), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    frame = registry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in frame.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


# 11 Collocations
def pieces_of(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", collocations_lower(text or ""))]


def collocations_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counted(texts):
    out = Counter()
    for words in (w for t in texts for w in pieces_of(t)):
        for n in (1, 2, 3):
            out.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return out


def test_automaton_by_definition():
    r = random.Random(3)
    for size in (0, 1, 5, 60, 400):
        codes = np.array([r.choice([-1, 0, 0, 1, 2, 3]) for _ in range(size)], np.int64)
        a = collocations.SuffixAutomaton(codes)
        ends = defaultdict(set)
        for i in range(size):
            for n in (1, 2, 3):
                words = tuple(codes[i - n + 1 : i + 1].tolist())
                if len(words) == n and i - n + 1 >= 0 and -1 not in words:
                    ends[words].add(i)
        for n in (1, 2, 3):
            words, endpos = a.phrases(n)
            assert dict(zip(map(tuple, words.tolist()), endpos.tolist())) == {w: len(e) for w, e in ends.items() if len(w) == n}
        # A state holds the suffixes of its longest member that end where it ends, and its link's longest member is the next shorter suffix.
        assert len(a.endpos) == len({frozenset(e) for e in ends.values()})
        for s in range(len(a.endpos)):
            longest = tuple(a.words[s, 3 - a.longest[s] :].tolist())
            same = [n for n in range(1, a.longest[s] + 1) if ends[longest[-n:]] == ends[longest]]
            assert same == list(range(a.shortest[s], a.longest[s] + 1))
            if a.link[s] < 0:
                assert a.shortest[s] == 1
            else:
                t = a.link[s]
                assert tuple(a.words[t, 3 - a.longest[t] :].tolist()) == longest[-(a.shortest[s] - 1) :] and a.longest[t] == a.shortest[s] - 1


@pytest.mark.parametrize("chunk", [1, 7, 40, 10_000])
def test_shards_cut_anywhere(monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    r = random.Random(4)
    texts = ["".join(r.choice(["a ", "B", "c\t", "dé ", ". ", "\n", "  ", "e,", "x" * 9 + " "]) for _ in range(r.randint(0, 60))) for _ in range(20)]
    batch = pa.record_batch({"lang": ["u"] * len(texts), "text": texts})
    got = Counter()
    for _, automaton, vocabulary in collocations.shards(iter([batch])):
        for n in (1, 2, 3):
            for words, f in zip(*automaton.phrases(n)):
                got[tuple(vocabulary[w].decode() for w in words)] += int(f)
    assert got == counted(texts)


def test_collocations_odd(spark, odd, none):
    got = collocations.collocations(odd).collect()
    assert {(r["lang"], r["phrase"], r["a"], r["n"]) for r in got} == {("en", "word word word", 59_998, 60_012)}
    assert got[0]["score"] == 1_000_000 * 59_998**2 // (60_000 * 59_999) and (got[0]["l"], got[0]["r"]) == (60_000, 59_999)
    assert collocations.collocations(none).count() == 0
    dull = spark.createDataFrame([(i, None if i % 2 else "", None, None, None) for i in range(4)], DOC)
    assert collocations.collocations(dull).count() == 0


def test_scores_are_exact(spark):
    n = 3_000_000_000_000
    counts = spark.createDataFrame([("u", 0, "", 5 * n), ("u", 1, "a", n), ("u", 1, "b", n + 1), ("u", 2, "a b", n - 1)], "lang string, k int, phrase string, f long")
    assert collocations.scored(counts).first()["score"] == 10**6 * (n - 1) ** 2 // (n * (n + 1))


# 12 Filter audit
def audit(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *v in labels if v[at] == 1 and i is not None} for at in (0, 1))
    masks = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        masks.append((lang or "", {c for c, f in fails.items() if f}, i in good, i in toxic))
    out = {}
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        removed = Counter()
        for order in orders:
            left = mine
            for step, c in enumerate(order, 1):
                gone, left_after = [m for m in left if c in m[1]], [m for m in left if c not in m[1]]
                removed[c] += len(gone)
                out[part, order, step] = [len(left_after), len(gone), sum(c in m[1] for m in mine) - len(gone), sum(m[1] == {c} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone), c]
                left = left_after
        for order in orders:
            for step in range(1, 6):
                out[part, order, step][-1] = removed[out[part, order, step][-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(frame):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in frame.collect()}


def test_audit_odd(odd, none, labels):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]
    assert audited(filteraudit.interactions(odd, labels)) == audit(rows, [tuple(r) for r in labels.collect()])
    assert filteraudit.interactions(none, labels).count() == 0
    assert {r[0] for r in filteraudit.repeated_ids(odd).collect()} == {2, 4}


@pytest.mark.parametrize("room", [0, 50, 10**6])
def test_copies_whatever_a_task_remembers(monkeypatch, room):
    monkeypatch.setattr(filteraudit, "REMEMBERED", room)
    r = random.Random(8)
    rows = [(r.randint(0, 60), r.choice("abcdefg") * r.randint(0, 2), r.choice("xy")) for _ in range(300)]
    tasks = [rows[i::3] for i in range(3)]
    routed = sorted(s for t in tasks for s in filteraudit.sent(iter(t)))
    got = Counter()
    for i, part, mask, n in filteraudit.settled(iter(routed)):
        got[i, part, bool(mask & filteraudit.REPEATED)] += n
    least = {t: min(i for i, u, _ in rows if u == t) for _, t, _ in rows}
    assert got == Counter((i, part, i > least[t]) for i, t, part in rows)


def test_a_chain_holds_texts_that_collide():
    rows = [((7, 1), ("a", [(1, "x", 0, 1)])), ((7, 2), ("b", [(2, "x", 0, 1)])), ((7, 3), ("a", [(3, "x", 0, 2)])), ((8, 4), ("a", [(4, "x", 0, 1)]))]
    assert list(filteraudit.settled(iter(rows))) == [(1, "x", 0, 1), (2, "x", 0, 1), (3, "x", filteraudit.REPEATED, 2), (4, "x", 0, 1)]


# 13 Count-vector join
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", collocations_lower(text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def joined(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            parent[root(j)] = root(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def near_texts(r, n):
    """Groups of texts some words apart, chains of them, copies, and texts that share passages."""
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(40)]
    rows = []
    for doc in range(n):
        if rows and r.random() < 0.7:
            text = r.choice(rows)[1].split()
            for _ in range(r.randint(0, max(1, len(text) // 40))):
                text[r.randrange(len(text))] = r.choice(words)
            text = text[: len(text) - r.randint(0, 2)] or ["w1"]
        else:
            text = [r.choice(words) for _ in range(r.choice([1, 3, 4, 8, 9, 12, 30, 120, 500]))] + (passage if r.random() < 0.5 else [])
        rows.append((doc, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed, points, shingles_", [(1, 1024, 1 << 16), (2, 8, 64)])
def test_count_join_against_brute_force(spark, monkeypatch, seed, points, shingles_):
    monkeypatch.setattr(countjoin, "POINTS", points)
    monkeypatch.setattr(countjoin, "SHINGLES", shingles_)
    rows = near_texts(random.Random(seed), 160)
    got = countjoin.labelled(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == joined(rows)


def test_count_join_odd(odd, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in countjoin.labelled(odd).collect()}
    assert got == {(1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 6), (7, 1, 7), (None, 1, None)}
    assert countjoin.labelled(odd).count() == 9 and countjoin.labelled(none).count() == 0


def random_sets(r, n):
    texts, base = [], [str(r.random()) for _ in range(3000)]
    for _ in range(n):
        size = r.choice([7, 10, 40, 200, 900])
        at = r.choice([0, 1, 2, 1000])
        own = base[at : at + size]
        for _ in range(r.randint(0, size // 60)):
            own[r.randrange(size)] = str(r.random())
        texts.append(" ".join(own).encode())
    return neardup.all_sets(texts, countjoin.WORDS)


def test_directory_and_tree_lose_no_link():
    h, bounds = random_sets(random.Random(6), 150)
    sizes, points = np.diff(bounds), np.array(countjoin.points_of(h, bounds), dtype=object)
    owner, key = countjoin.files_of(h, bounds)
    filed = defaultdict(set)
    for o, k in zip(owner.tolist(), key.tolist()):
        filed[o].add(k)
    sets = [set(h[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    linked = [(i, j) for i, j in itertools.combinations(range(150), 2) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(linked) > 20
    tree = countjoin.CountTree(np.concatenate([countjoin.matrix(points[i : i + 1], 16) for i in range(150)]), sizes)
    q, p = tree.near(np.concatenate([countjoin.matrix(points[i : i + 1], 16) for i in range(150)]), sizes)
    found = set(zip(q.tolist(), p.tolist()))
    for i, j in linked:
        assert filed[i] & filed[j] and (i, j) in found and (j, i) in found
        assert countjoin.in_reach_of(points[[i]], points[[j]], sizes[[i]], sizes[[j]]).all()
    bound = {(i, j) for i, j in itertools.product(range(150), repeat=2) if countjoin.passes(np.minimum(*(countjoin.matrix(points[[x]], 16)[0] for x in (i, j))).sum(), sizes[i], sizes[j])}
    assert found == bound


@pytest.mark.parametrize("cut", [1, 2, 3, 50])
def test_shared_rows_over_batches(cut):
    r = random.Random(9)
    rows = sorted((r.randint(0, 9), r.randint(0, 5)) for _ in range(40))
    batches = [pa.record_batch({"key": pa.array([k for k, _ in rows[i : i + cut]], pa.int64()), "set_a": pa.array([s for _, s in rows[i : i + cut]], pa.int64())}) for i in range(0, 40, cut)]
    got = [(x["key"], x["set_a"]) for b in countjoin.shared(iter(batches)) for x in b.to_pylist()]
    held = defaultdict(set)
    for k, s in rows:
        held[k].add(s)
    assert sorted(got) == sorted((k, s) for k, v in held.items() if len(v) > 1 for s in v)
