"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotweld.llm import filter_audit, periodic, repeats
from plotweld.llm import queries as q

DOCS = "doc_id bigint, text string, source string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40) | st.lists(st.integers(0, 60), max_size=40))
def test_suffix_array(text):
    assert repeats.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def covered(texts: list[bytes], width: int) -> list[set[int]]:
    """Bytes of every string that starts twice, by counting all strings."""
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    return [{j for i in range(len(t) - width + 1) if seen[t[i : i + width]] > 1 for j in range(i, i + width)} for t in texts]


def expected_repeats(rows, width=200):
    texts = [(r["text"] or "").encode() for r in rows]
    out = []
    for r, t, gone in zip(rows, texts, covered(texts, width), strict=True):
        runs = sum(i in gone and i - 1 not in gone for i in range(len(t)))
        out.append((r["doc_id"], len(t), len(gone), runs, hashlib.sha256(bytes(b for i, b in enumerate(t) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


def repeat_rows():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeéß"), rng.integers(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(45)
    texts = [None, "", "short", prose(80), passage, "x" * 199, "x" * 200, "x" * 700, "ab" * 300, "abc" * 150]
    texts += [f"{prose(int(rng.integers(0, 40)))} {passage} {prose(30)}" for _ in range(40)]
    texts += [f"{passage[:230]}{prose(9)}{other}{prose(20)}{other[40:]}" for _ in range(12)]
    texts += [texts[20]] * 3 + [texts[21] + "!", "é" * 150, prose(5) + "é" * 120]
    return [{"doc_id": i, "text": t, "source": "s"} for i, t in enumerate(texts)] + [{"doc_id": None, "text": texts[22], "source": None}, {"doc_id": 4, "text": passage, "source": "s"}]


@pytest.mark.parametrize(("unit", "block"), [(4096, 2 << 20), (3, 3000)])
def test_repeats_against_all_strings(spark, unit, block):
    rows = repeat_rows()
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], DOCS)
    got = repeats.remove_repeats(spark, docs, unit=unit, block_bytes=block).collect()
    mine = sorted(((r["doc_id"], r["__repeats"]["n_bytes"], sum(s["last"] - s["first"] for s in r["__repeats"]["spans"]), len(r["__repeats"]["spans"]), hashlib.sha256(r["__repeats"]["kept"]).hexdigest()) for r in got), key=repr)
    assert mine == expected_repeats(rows)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 500)
    raw = np.frombuffer(("the quick brown fox " * 40 + "z" * 900).encode() + bytes(np.random.default_rng(2).integers(97, 105, 3000).astype(np.uint8)), np.uint8)
    import pyarrow as pa

    seen = {}
    for _, at, part, offs in repeats.pieces(pa.array([raw.tobytes().decode()]), 200):
        _, start, strings, anchor, *_ = repeats.segments(part, offs, 200)
        for s, n, a in zip(start, strings, anchor, strict=True):
            for i in range(s, s + n):
                assert at + i not in seen
                seen[at + i] = a
    assert sorted(seen) == list(range(len(raw) - 199))
    by_string: dict = {}
    for i, a in seen.items():
        assert by_string.setdefault(raw[i : i + 200].tobytes(), a) == a


def test_repeats_on_odd_tables(spark):
    assert repeats.remove_repeats(spark, spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([("a.1", "w " * 150, 1, 2), (None, None, 3, 4)], "doc_id string, text string, k1 int, `found_` int")
    got = repeats.remove_repeats(spark, docs).collect()
    assert {(r["doc_id"], r["k1"], len(r["__repeats"]["spans"])) for r in got} == {("a.1", 1, 1), (None, 3, 0)}


def brute_runs(words):
    """Every maximal stretch of least period p and enough words, by direct comparison."""
    out = set()
    for p in range(1, len(words) // 4 + 1 if len(words) >= 6 else 0):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            a = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            n = i + p - a
            least = next(k for k in range(1, p + 1) if all(words[j] == words[j + k] for j in range(a, a + n - k)))
            if least == p and n >= max(6, 4 * p):
                out.add((a, n, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4))
def test_runs_of_words(texts):
    words = [np.array([ord(x) * 0x9E3779B97F4A7C15 % (1 << 64) for x in t], np.uint64) for t in texts]
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = periodic.chunk_runs(np.concatenate(words), first).tolist()
    assert [tuple(r) for r in got] == [(d, *r) for d, t in enumerate(texts) for r in brute_runs(t)]


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected_runs(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(["le", "chat", "Noir", "dort", "é"], n))
    texts = [None, "", " \t\n ", "a b", "a " * 6, "a b " * 4, "x\x0by\x0cz " * 9, "A a " * 5] + [prose(int(n)) for n in rng.integers(1, 90, 120)] + [prose(700)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "q " * 9, None), (5, "a b " * 4, "s"), (5, "a b " * 4, "s")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = q.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected_runs(i, t) for i, t, _ in rows), key=repr)


def test_runs_on_odd_tables(spark):
    assert periodic.periodic_runs(spark, spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([("n n n n n n", "kept")], "TEXT string, `__runs` string")
    row = periodic.periodic_runs(spark, docs).first()
    assert row["__runs"] == "kept" and row["__runs_"]["collapsed"] == "n"


def test_false_matches_are_done_again():
    text = b"a b a b a b a b c"
    assert periodic.exact_runs(text, text.split()) == [[0, 8, 2]]


def test_pairs_in_parts():
    sizes = np.array([0, 5, 6, 40, 400])
    whole = np.concatenate([np.stack(x, 1) for x in periodic.grid(sizes)])
    parts = np.concatenate([np.stack(x, 1) for x in periodic.grid(sizes, 7)])
    assert (whole == parts).all() and (whole[:, 2] + whole[:, 1] < sizes[whole[:, 0]]).all()


def audit_by_hand(docs, labels):
    first: dict = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({x for x, *v in labels if v[k] == 1} for k in (0, 1))
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((s or "", i in good, i in toxic, {k for k, v in f.items() if v}))
    out, over_all = [], Counter()
    for part in {f[0] for f in fails}:
        rows = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                prior = set(order[: step - 1])
                here = [f for f in rows if x in f[3] and not f[3] & prior]
                over_all[part, x] += len(here)
                out.append([part, order, step, sum(not f[3] & (prior | {x}) for f in rows), len(here), sum(x in f[3] and bool(f[3] & prior) for f in rows), sum(f[3] == {x} for f in rows), sum(f[1] for f in here), sum(f[2] for f in here), x])
    return sorted((*r[:-1], over_all[r[0], r[-1]]) for r in out)


def test_audit_by_hand(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, "a b", "x"), (2, "a b", "x"), (3, None, None), (4, "", "y"), (4, "", "y"), (5, long, "x"), (6, long + " #", "x"), (7, "A " * 60, "x"), (8, long, "y"), (9, long, "y"), (None, long, "x"), (None, "a b", "x"), (1, "a b", "y"), (2, "Q|", "x"), (2, "a b", "x")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (8, 1, 1), (None, 1, 1), (99, 1, 1), (7, None, 1)]
    got = filter_audit.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == audit_by_hand(docs, [x for x in labels if x[0] is not None])


def test_parity_sums_are_inverted(spark):
    rows = spark.createDataFrame([("p", m, m * m + 1, m, 1) for m in range(32)], "part string, mask int, all bigint, good bigint, toxic bigint")
    row = filter_audit.cells(filter_audit.spectrum(rows)).first()
    assert row["all"] == [m * m + 1 for m in range(32)] and row["good"] == list(range(32)) and row["toxic"] == [1] * 32


def test_audit_of_empty_table(spark):
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []
