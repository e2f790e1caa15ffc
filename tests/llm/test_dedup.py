import hashlib
import random
import re

import numpy as np
import pytest

from convoscore.llm import neardup
from convoscore.llm.components import components
from convoscore.llm.exact import exact_dedup, golomb_decode, golomb_encode
from convoscore.llm.neardup import COORDINATES, near_dedup, shingle_set, signature, word_list
from convoscore.llm.vectors import plan_tables, vector_dedup

from .fixtures import documents, edited, empty, frame, prose


def test_golomb_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 3000):
        for bits in (20, 40, 64):
            values = np.unique(r.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True))
            code, count, k = golomb_encode(values, bits)
            assert (golomb_decode(code, count, k) == values).all()
            if n == 3000 and bits == 64:
                assert len(code) < 8 * n


def brute_exact(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(body(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text, *_ in rows:
        g = groups[body(text)]
        keep = min(g)[3]
        out.append((doc_id, keep, len(g), doc_id == keep, hashlib.sha256(body(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [29, 12])  # a full bitmap only costs time
def test_exact_dedup_against_brute_force(spark, bits):
    far = [(-(2**63), "far below", None, None, None), (2**63 - 1, "far  below", None, None, None)]
    got = exact_dedup(frame(spark, documents() + far), most_bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(documents() + far)
    assert exact_dedup(empty(spark)).count() == 0


def brute_near(rows, width, percent=80):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    label: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            label[find(i)] = min(label.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), label.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup_against_brute_force(spark, width):
    got = near_dedup(frame(spark), width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(documents(), width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_near_dedup_of_a_chain_and_of_a_crowd(spark):
    """A chain whose ends are far apart, and a crowd around one text whose members are not all linked with each other."""
    chain, text = [], prose(200, 1)
    for k in range(12):
        chain.append((50 - k, text, "en", "s", 0))
        text = edited(text, 3, 100 + k)
    center = prose(150, 2)
    crowd = [(1000 + k, edited(center, 4, k), "en", "s", 0) for k in range(80)] + [(2000, center, "en", "s", 0)]
    rows = chain + crowd
    random.Random(1).shuffle(rows)
    got = near_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, 5)


def test_near_dedup_in_many_cells(spark, monkeypatch):
    """Blocks of three classes, and one first band, leave most of a crowd to cells of two blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "FIRST_BANDS", 1)
    rows = []
    for k in range(6):
        center = prose(150, 40 + k)
        rows += [(1000 * k + j, edited(edited(center, 6, k), 7, 100 * k + j), "en", "s", 0) for j in range(25)]
    shared = prose(110, 50)
    rows += [(9000 + j, shared + " " + prose(14 + j, 60 + j), "en", "s", 0) for j in range(20)]  # similar, some of them enough
    got = near_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, 5)
    assert len({r.component_id for r in got}) > 6


def test_near_dedup_names_each_set_once(spark, monkeypatch):
    """However many pairs and cells a class is in, its set is asked for once a round, and the rounds have no row a pair."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "FIRST_BANDS", 1)
    named, real = [], neardup.id_bitmap
    monkeypatch.setattr(neardup, "id_bitmap", lambda ids: named.append([r[0] for r in ids.collect()]) or real(ids))
    shared = prose(110, 50)
    rows = [(j, shared + " " + prose(14 + j, 60 + j), "en", "s", 0) for j in range(20)]
    got = near_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, 5)
    assert len(named) == 3 and all(len(ids) == len(set(ids)) <= len(rows) for ids in named)


def test_near_dedup_of_nothing(spark):
    assert near_dedup(empty(spark)).count() == 0
    assert [tuple(r) for r in near_dedup(frame(spark, [(1, None, None, None, None)])).collect()] == [(1, 0, 1, True)]


def test_signatures_estimate_similarity():
    a, b = prose(400, 5), edited(prose(400, 5), 12, 6)
    x, y = (shingle_set(word_list(t.encode()), 5) for t in (a, b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((signature(x) == signature(y)).mean() - true) < 5 * (true * (1 - true) / COORDINATES) ** 0.5


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(r.standard_normal((60, 16)).astype("float32"))]
    for k in range(60):  # around the limit, and a dense cluster
        v = np.array(rows[k % 6][1]) + r.standard_normal(16) * (0.1 + 0.01 * k)
        rows.append((100 + k, [float(x) for x in v.astype("float32")], 1))
    rows += [(300 + k, rows[2][1], 1) for k in range(9)] + [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [float("nan")] * 16, 0), (404, [1.0, None] * 8, 0), (405, [1.0] * 3, 0), (406, [3e38] * 16, 0), (407, [1e-40] * 16, 0)]
    return rows + [(7000 + k, rows[120][1], None) for k in range(2)]


def test_vector_dedup_against_brute_force(spark):
    rows = vectors()
    got = {r.vec_id: r for r in vector_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), miss=1e-6).collect()}
    fine = [(i, np.array(v, "float32").astype(float)) for i, v, _ in rows if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.stack([v / np.abs(v).max() for _, v in fine])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    ids = [i for i, _ in fine]
    for k, i in enumerate(ids):
        assert got[i].n_links == links[k].sum() - 1
        seen, todo = {k}, [k]
        while todo:
            todo += (new := set(np.flatnonzero(links[todo.pop()])) - seen)
            seen |= new
        assert got[i].component_id == min(ids[j] for j in seen)
    for i in {r[0] for r in rows} - set(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_vectors_of_every_length_are_compared(spark):
    r = np.random.default_rng(5)
    rows = [(k, r.standard_normal(16).tolist()) for k in range(40)]
    for d, first in ((8, 100), (32, 200)):  # two equal ones, one in their direction, one apart
        v = r.standard_normal(d)
        rows += [(first + 3, v.tolist()), (first, v.tolist()), (first + 1, (2 * v).tolist()), (first + 2, (-v).tolist())]
    rows += [(300, [1.0, 2.0, 3.0]), (301, [1.0, 2.0, 3.0]), (302, [5.0])]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vector_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), miss=1e-6).collect()}
    for first in (100, 200):
        assert got[first] == (2, first, True) and got[first + 1] == got[first + 3] == (2, first, False) and got[first + 2] == (0, first + 2, True)
    assert got[300] == (1, 300, True) and got[301] == (1, 300, False) and got[302] == (0, 302, True)
    assert len(got) == len(rows)


def test_vector_dedup_as_registered(spark):
    """The registered chance to miss a pair, pairs just above the limit, a cluster of several blocks, columns that clash,
    null ids and repeated rows: no link below the limit, nearly all above it, whatever the partitions."""
    r = np.random.default_rng(6)
    base = r.standard_normal((1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = r.standard_normal(base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    crowd = base[0] + 0.04 * r.standard_normal((1200, 32))
    x = np.concatenate([base, 0.9002 * base + (1 - 0.9002**2) ** 0.5 * other, crowd])
    rows = [(k, v.tolist(), 1, 2, "c") for k, v in enumerate(x)]
    rows += [rows[7], rows[7], (None, rows[8][1], 1, 2, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, t int, v string")
    found = []
    for parts in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(sorted(map(tuple, vector_dedup(df).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) == len(rows)
    got = {i: n for i, n, *_ in found[0]}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    want[7] += 2  # the repeated rows
    mine = np.array([got[k] for k in range(len(x))])
    assert mine[7] >= 2 and got[None] == mine[8] + 1 and (mine <= want + 2 * (want > 0)).all()
    assert mine.sum() >= 0.998 * want.sum() and (mine[1500:3000] > 0).mean() >= 0.99


def test_vector_dedup_of_nothing(spark):
    assert vector_dedup(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_tables_grow_slowly():
    small, large = plan_tables(10_000, 64, 0.9, 1e-3), plan_tables(10_000_000, 64, 0.9, 1e-3)
    assert large[0] > small[0] and large[1] < 1000 ** 0.3 * small[1] * 1.2
