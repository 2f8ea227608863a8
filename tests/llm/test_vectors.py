"""Vector operators against brute force: ties at the cut, mixed lengths in one block, components of any size."""

import math

import numpy as np
import pytest

from plotweld.llm import embedding_dedup, topk

SCHEMA = "vec_id bigint, embedding array<double>, label string"


def top(rows, k=5):
    ints = {}
    for i, v in rows:
        if v and None not in v and all(map(math.isfinite, v)):
            ints.setdefault(i, []).append([math.floor(256 * x) if abs(x) < 2**52 else int(x) * 256 for x in v])
    out = set()
    for q, versions in ints.items():
        if q % 50 == 0:
            for v in {tuple(v) for v in versions}:
                best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, xs in ints.items() if i != q for x in xs if len(x) == len(v))[:k]
                out |= {(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [topk.CANDIDATE_BLOCK, 16])
def test_top_k_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(160)]
    rows += [(200 + i, [1.0, 0.5] if i % 2 else [0.25, 1.0, -1.0]) for i in range(60)]
    rows += [(i, (rng.standard_normal(6) * 10.0 ** rng.integers(5, 12)).tolist()) for i in range(290, 320)]
    rows += [(350, [1e6] * 6), (400, [-1e13] * 6), (450, [1e17, 1.0, 2.0, 0.0, 0.0, 3.0]), (451, [0.0] * 6), (500, None), (501, [None, 1.0]), (502, [math.inf, 1.0]), (503, [])]
    got = topk.exact_top_k(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {tuple(r) for r in got} == top(rows) and len(got) == len(top(rows))


def test_top_k_of_the_largest_numbers(spark):
    rows = [(0, [1e300, 1e308]), (50, [-1e308, 1.0]), (1, [1e308, 1e308]), (2, [1.0, 2.0]), (3, [-1e308, 0.0])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert len(got) == 8 and got[50, 1][1] == 2**63 - 1 and got[50, 4][1] == -(2**63)


def test_near_dedup_of_mixed_lengths_and_ties(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 8))
    rows = [(i, (base[i % 6] + 0.12 * rng.standard_normal(8)).tolist(), f"l{i % 2}") for i in range(80)]
    rows += [(100 + i, [3.0, 4.0] if i % 2 else [4.0, 3.0], "l0") for i in range(6)]
    rows += [(200, [1.0, 0.0], "l1"), (201, [0.93, math.sqrt(1 - 0.93**2)], "l1"), (300, [1e200, 1e200], "l1"), (301, [1e-200, 1e-200], "l1"), (302, [1e200, 1e200], None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dedup(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    unit = {i: (np.array(v) / np.abs(v).max(), lab) for i, v, lab in rows if lab}
    links = {i: set() for i, _, _ in rows}
    for a, (u, x) in unit.items():
        for b, (v, y) in unit.items():
            if a != b and x == y and len(u) == len(v) and (u * v).sum() / (math.sqrt((u * u).sum()) * math.sqrt((v * v).sum())) >= 0.93:
                links[a].add(b)
    for i in links:
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i][1] == min(seen), i
        assert i in (200, 201) or got[i][0] == len(links[i])
