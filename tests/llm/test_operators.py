import collections
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweld.llm import common, embedding_dedup, licenses, line_dedup, mixing, ngram_join, queries, secrets, sentencepieces, topk, toxicity, training_order
from plotweld.llm.components import components

DATA = "/root/testdata/sf0.001"
MODEL = f"{queries.TOKENIZERS}/{sentencepieces.MODEL}"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, __n int"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "a b c d e f"), (6, "é𝒳 token='abcdef1' AKIA" + "A" * 16), (7, "word " * 20000), (8, "Ümlaut ▁ \r\n x" * 40)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None if i == 4 else "s", None, "x", 1) for i, t in rows], DOCS)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_in_rounds(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for block in (1_000_000, 10):
        got = dict(map(tuple, components(spark, df, block).collect()))
        assert all(got.get(i, i) == find(parent, i) for i in range(300))


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("block", [ngram_join.BLOCK_TOKENS, 60])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    rng = random.Random(9)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = "X" + str(rng.randrange(5))
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A b"), (None, rows[0][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_jaccard_join(spark, documents(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent, links = {i: i for i in sets}, collections.Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links.update((a, b))
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    assert {i: v for i, v in got.items() if i is not None} == {i: (len(sets[i]), find(parent, i), links[i]) for i in sets}
    assert got[None] == (len(shingles(rows[0][1])), None, 0)


def test_embedding_dedup_and_top_k(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + 0.18 * rng.standard_normal(16)).tolist(), i % 3) for i in range(150)]
    rows += [(150, rows[3][1], 0), (151, [0.0] * 16, 0), (152, None, 0), (153, [float("nan")] * 16, 0), (154, rows[3][1], None), (200, [1.0, None], 0), (250, rows[7][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dedup(spark, df).collect()}
    good = {i: (np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    parent, links = {i: i for i, _, _ in rows}, collections.Counter()
    for a in good:
        for b in good:
            (u, x), (v, y) = good[a], good[b]
            if a < b and x == y and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                links.update((a, b))
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    assert got == {i: (links[i], find(parent, i)) for i, _, _ in rows}
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in ints:
        if q % 50 == 0:
            best = sorted(((-int(ints[q] @ x), i) for i, x in ints.items() if i != q and len(x) == len(ints[q])))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.exact_top_k(spark, df).collect()} == want


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_line_dedup(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(18, 70))) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(base)
            if rng.random() < 0.6:
                p = rng.randrange(len(line))
                line = line[:p] + rng.choice(["", "x", "y" + line[p]]) + line[p + 1 :]
            lines.append(line)
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark, documents(spark, rows)).collect()}
    first = {}
    for i, t in rows:
        for p, line in enumerate(t.split("\n")):
            if len(line) >= 20:
                first.setdefault(line, (i, p))
    gone = {a for a in first if any(first[b] < first[a] and one_edit(a, b) for b in first)}
    assert gone
    assert got == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if len(x) < 20 or (x not in gone and first[x] == (i, p))) for i, t in rows}


def test_line_dedup_of_short_lines(spark):
    import corpus_pipeline

    rng = random.Random(6)
    rows = [(i, "\n".join("".join(rng.choice("abcdefghé ") for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 12, 19, 24)))) for _ in range(6))) for i in range(30)]
    rows += [(100 + i, f"Les.\nWh the.\n \n\nshort heading{'.' * (i % 2)}\nown line of {i * 7919 * 104729}") for i in range(8)]
    rows += [(200, " " * 25), (201, "x1\n" + " " * 25)]
    first = {}
    for i, t in rows:
        for p, line in enumerate(t.split("\n")):
            if line.strip() or len(line) >= 20:
                first.setdefault(line, (i, p))
    gone = {a for a in first if any(first[b] < first[a] and one_edit(a, b) for b in first)}
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if x not in first or (x not in gone and first[x] == (i, p))) for i, t in rows}
    assert any(len(x) < 10 for x in gone) and any(10 <= len(x) < 20 for x in gone)
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(spark, documents(spark, rows), min_chars=1).collect()} == want
    staged = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, documents(spark, rows), DATA).collect()}
    assert staged == {i: t for i, t in want.items() if t.strip(" ") or t == dict(rows)[i]}


def test_mixing(spark):
    assert mixing.water_fill([10, 100], [3, 1], 165, 2) == [20, 145]
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(0, 60)), rng.choice(["a", "b", "c", None])) for i in range(400)] + [(400, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix_sources(spark, df)
    got = mixed.select("doc_id", "source", "__mix.*").collect()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    targets = {r.source: r.target for r in got}
    assert all(abs(taken[s] - t) < 40 for s, t in targets.items())
    assert abs(sum(targets.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    out = mixing.materialise_mix(mixed)
    assert out.columns == df.columns
    words = collections.Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert all(words[r.doc_id] == r.taken for r in got)


def test_toxicity(spark):
    trie = toxicity.LexiconTrie({"idiot": 3.0, "lowe*": 2.0})
    assert trie.weigh("idiot") == (3.0, False) and trie.weigh("idoit") == (3.0, True) and trie.weigh("iodti")[0] == 0 and trie.weigh("idi0t") == (3.0, True) and trie.weigh("idiiot") == (3.0, True)
    assert trie.weigh("loweish") == (2.0, False) and trie.weigh("harmless")[0] == 0
    assert toxicity.quoted('he said "you idiot" there', 13, 18) and not toxicity.quoted("you idiot there", 4, 9)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(40)) + (" moron" if i % 4 == 0 else "")) for i in range(400)]
    docs, labels = documents(spark, rows), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(spark, toxicity.labelled_texts(docs, labels))
    scored = toxicity.score_toxicity(spark, docs, model).collect()
    assert all((r["__score"] >= 0.7) == (r.doc_id % 4 == 0) for r in scored)
    assert toxicity.learn(spark, toxicity.labelled_texts(docs, labels.limit(0)))[0] == {}


def test_toxicity_near_stems_and_swaps(spark):
    trie = toxicity.LexiconTrie({"bomente*": 2.0, "reeux*": 1.5, "degenerate": 3.0, "cretin": 1.0, "scum": 1.0})
    assert trie.weigh("bomentering") == (2.0, False) and trie.weigh("bom3ntering") == (2.0, True) and trie.weigh("bometnering") == (2.0, True) and trie.weigh("boment") == (2.0, True)
    assert trie.weigh("reuxish") == (1.5, True) and trie.weigh("degneerat3") == (3.0, True) and trie.weigh("ceretin") == (1.0, True) and trie.weigh("crteni")[0] == 0
    rng = random.Random(8)

    def edited(a, b):
        d = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                d[i, j] = max(i, j) if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d

    terms = {"".join(rng.choice("ab") for _ in range(rng.randint(4, 11))) + rng.choice(["", "*"]): float(k + 1) for k in range(12)}
    trie = toxicity.LexiconTrie(terms)
    for _ in range(1500):
        word, best = "".join(rng.choice("abc") for _ in range(rng.randint(4, 14))), 0.0
        for t, w in terms.items():
            a = t.rstrip("*")
            d = edited(a, word)
            cost = min(d[len(a), j] for j in range(len(word) + 1)) if t.endswith("*") else d[len(a), len(word)]
            best = max(best, w) if cost <= toxicity.bound(len(a)) else best
        if not trie.exact(word):
            assert trie.weigh(word)[0] == best
    rows = [(i, " ".join(rng.choice("xyz") * 3 for _ in range(20)) + (f" moron{'abcdefgh'[i // 4 % 8]}" if i % 8 == 0 else " moronic" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.learn(spark, toxicity.labelled_texts(documents(spark, rows), labels))[0]
    assert "moronic" in lexicon and any(t.endswith("*") and "moronic".startswith(t[:-1]) for t in lexicon)


def test_licenses(spark):
    rows = [(1, "x y\nReleased under the MIT License.\nz"), (2, "Licensed under the Apache Licence, Version 2.0. ok"), (3, "plain words only here"), (4, None), (5, "")]
    got = {r.doc_id: [(m.license, m.start, m.end) for m in r.matches] for r in licenses.license_scan(spark, documents(spark, rows)).collect()}
    assert got == {1: [("MIT", 4, 34)], 2: [("Apache-2.0", 0, 46)], 3: [], 4: [], 5: []}


def test_licenses_with_any_edits(spark):
    plain = {}
    for name, text in licenses.TEMPLATES:
        words = re.findall(r"[^\W_]+", text)
        may = len(words) // 5
        for k in range(len(words)):
            changed = [f"zz{i}" if may and i % -(-len(words) // may) == k % -(-len(words) // may) else w for i, w in enumerate(words)]
            lost = sum(a != b for a, b in zip(words, changed, strict=True))
            if lost <= may:
                plain[len(plain)] = (name, round(1 - lost / len(words), 4), "intro " + " ".join(changed) + " outro")
    mit, apache = licenses.TEMPLATES[2][1], licenses.TEMPLATES[0][1]
    rows = [(i, t) for i, (_, _, t) in plain.items()] + [(9000, f"{mit} {mit}\n{mit}"), (9001, f"{apache} {apache}"), (9002, "Released under an MIT License. " + mit), (9003, "under the"), (9004, "Released under the"), (9005, "MIT License")]
    got = {r.doc_id: [(m.license, m.start, m.end, m.coverage) for m in r.matches] for r in licenses.license_scan(spark, documents(spark, rows)).collect()}
    assert all((name, share) in {(m[0], m[3]) for m in got[i]} for i, (name, share, _) in plain.items())
    assert got[9000] == [("MIT", k, k + 30, 1.0) for k in (0, 32, 64)]
    assert [m[:3] for m in got[9001]] == [("Apache-2.0", 0, 46), ("Apache-2.0", 48, 94)]
    assert got[9002] == [("MIT", 0, 29, 0.8), ("MIT", 31, 61, 1.0)]
    assert not got[9003] and not got[9004] and not got[9005]


def spans_by_brute_force(text, templates, coverage=0.8):
    """All (first, last, edits, template) within the edits allowed, by a plain edit table for each start."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    out = []
    for n, (_, t) in enumerate(templates):
        want = re.findall(r"[a-z0-9]+", t.lower())
        most = int((1 - coverage) * len(want) + 1e-9)
        for s in range(len(words)):
            row = list(range(len(want) + 1))
            for j, w in enumerate(words[s : s + len(want) + most]):
                new = [j + 1]
                for i, v in enumerate(want):
                    new.append(min(row[i] + (v != w), row[i + 1] + 1, new[i] + 1))
                row = new
                if row[-1] <= most:
                    out.append((s, s + j, row[-1], n))
    return out


def test_licenses_against_brute_force():
    rng = random.Random(21)
    templates = (("A", "one two three four five"), ("B", "one two nine three four five six seven eight ten"), ("C", "alpha beta gamma delta one two three four epsilon zeta eta theta iota kappa lambda"), ("D", "one two"))
    table = licenses.Templates(templates, 0.8)
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(templates)[1].split()
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(part))
                part[k : k + rng.randint(0, 1)] = rng.choice([[], ["x"], ["one"], ["y", "z"]])
            words += part + ["w"] * rng.randint(0, 3)
        text = " ".join(words)
        raw = np.frombuffer(text.encode(), np.uint8)
        _, _, first, w = licenses._word_hashes(raw, np.array([0, len(raw)]))
        got = {(a, b, e, n) for _, n, a, b, e in table.spans(w, np.asarray(first))}
        every = spans_by_brute_force(text, templates)
        assert got <= set(every)
        # Every span within the edits overlaps a reported one of its template that needs no more edits.
        assert all(any(n == m and c <= e and a <= t and s <= b for a, b, c, m in got) for s, t, e, n in every)


def test_licenses_by_decisive_words(spark):
    texts = {
        1: ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), 2: (licenses.TEMPLATES[-4][1], ["CC-BY-SA-4.0"]), 3: ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        4: ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), 5: ("Licensed under the Apache License, Version 1.0.", []), 6: (licenses.TEMPLATES[7][1], ["BSD-3-Clause"]), 7: ("é " + licenses.TEMPLATES[4][1].upper(), ["MIT"]),
        8: ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]), 9: ("this work is licensed under the mit license of software " * 3000, None),
    }
    rows = {r.doc_id: r.matches for r in licenses.license_scan(spark, spark.createDataFrame([(str(i), t, 1, 2) for i, (t, _) in texts.items()], "doc_id string, text string, matches int, `a.b` int")).collect()}
    for i, (_, want) in texts.items():
        assert want is None or [m.license for m in rows[str(i)]] == want
    assert rows["7"][0].start == 2 and rows["7"][0].coverage == 1.0


def test_secrets(spark):
    rows = [*ODD, (20, "deadbeef" * 300 + " zz " + "0123456789abcdef" * 3), (21, "password=ab api_key=q token=token:abcdefgh PASSWORD : \"a.b=c-d\""), (22, "k9Xw2LmQ7vRt4ZpB8nYc3HsD")]
    found = secrets.secret_scan(spark, documents(spark, rows)).select("doc_id", "n_assign", "n_access", "n_hex", secrets.joined(F.col("base")).alias("base"), secrets.joined(F.col("added")).alias("added")).collect()
    text = dict(rows)
    for r in found:
        t, spans = text[r.doc_id] or "", []
        for o, (kind, pattern, least) in enumerate(secrets.BASE):
            spans += [(m.start(), o, kind, m.end()) for m in re.finditer(pattern, t) if len(m.group(2 if o == 0 else 0)) >= least]
        assert r.base == ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k, _, _ in secrets.BASE)
    assert {r.doc_id for r in found if r.added} == {22}
    assert secrets.least_bins({0: {100: 5, 0: 95}}, 0.001) == {0: 100}


def test_secrets_of_letters(spark):
    rng = random.Random(12)
    lower, mixed = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = [(i, "see " + "".join(rng.choice(a) for _ in range(n)) + " here") for i, (a, n) in enumerate([(lower, 32), (lower.upper(), 32), (mixed, 40)] * 4)]
    plain = ["internationalisierung", "incomprehensibilities", "donaudampfschifffahrtsgesellschaft", "getElementsByClassNameFromParent", "anticonstitutionnellement"]
    rows += [(100 + i, f"the word {w} is plain") for i, w in enumerate(plain)]
    added = {r.doc_id: [(x["at"], x["end"]) for x in r.added] for r in secrets.secret_scan(spark, documents(spark, rows)).collect()}
    assert sum(bool(added[i]) for i in range(12)) >= 10
    assert all(added[i] in ([], [(4, len(t) - 5)]) for i, t in rows if i < 100) and not any(added[i] for i in added if i >= 100)


def test_training_order(spark, tmp_path):
    n = 1009
    assert sorted(training_order.feistel(np.arange(n), n, 7)) == list(range(n))
    assert (training_order.unfeistel(training_order.feistel(np.arange(n), n, 7), n, 7) == np.arange(n)).all()
    records = training_order.training_records(spark, documents(spark, ODD), stride=64, per_shard=100)
    rows = records.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    texts = collections.defaultdict(dict)
    for r in rows:
        if r.doc_id in (1, 4, 7, 8):
            texts[r.doc_id][r.seq] = np.frombuffer(r.payload, np.uint16)[: r.n_tokens]
    for i, parts in texts.items():
        ids = np.concatenate([parts[k] for k in range(len(parts))])
        assert ids[-1] == training_order.END and ids[:-1].astype(np.uint8).tobytes().decode() == (dict(ODD)[i] or "")
    folder = tmp_path / "shards"
    training_order.write_shards(records, folder.as_uri()).collect()
    r = rows[len(rows) // 2]
    raw = (folder / f"shard-{r.shard:08d}.bin").read_bytes()
    at = r.slot % 100 * 128
    assert raw[at : at + 128] == r.payload


def test_training_order_writes_shards(spark, tmp_path):
    encoder = sentencepieces.PieceEncoder(spark, MODEL)
    records = training_order.training_records(spark, documents(spark, ODD), stride=64, per_shard=50, encoder=encoder)
    held = records.groupBy(F.spark_partition_id().alias("p")).agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).orderBy("p").collect()
    assert len(held) > 2 and all(h.b - h.a + 1 == h.n for h in held) and all(x.b + 1 == y.a for x, y in zip(held[:-1], held[1:], strict=True))
    folder = tmp_path / "shards"
    rows = training_order.written_records(spark, records, folder.as_uri()).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ids = {}
    for r in rows:
        raw = (folder / f"shard-{r.shard:08d}.bin").read_bytes()[r.byte_offset : r.byte_offset + 128]
        assert r.byte_offset == r.slot % 50 * 128 and r.crc32 == zlib.crc32(raw)
        ids[r.doc_id, r.seq] = np.frombuffer(raw, np.uint16)[: r.n_tokens]
    pieces = sentencepieces.load_pieces(MODEL, 1.0)
    for i in (1, 2, 3, 4, 6, 7, 8):
        all_ids = np.concatenate([ids[i, k] for k in range(sum(d == i for d, _ in ids))]).astype(np.int64)
        assert all_ids[-1] == encoder.end and sentencepieces.decode_rows(pieces, all_ids[:-1]).tobytes().decode() == (dict(ODD)[i] or "")
    out = queries.op3_training_order(spark, DATA)
    assert out.columns == ["slot", "shard", "doc_id", "seq", "n_tokens", "byte_offset", "crc32"]
    root = common.scratch_root(spark).removeprefix("file://")
    size = sum(p.stat().st_size for p in pathlib.Path(root).rglob("shard-*.bin"))
    assert size >= out.count() * training_order.STRIDE * 2


def test_pieces(spark):
    out = sentencepieces.sample_encode(spark, documents(spark, ODD), MODEL)
    rows = out.collect()
    assert all(r.lossless for r in rows) and len(rows) == len(ODD)
    back = sentencepieces.decode(spark, out, MODEL).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in ODD)
    again = out.repartition(5).collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in again) == sorted((str(r.doc_id), tuple(r.ids)) for r in rows)
    p = sentencepieces.load_pieces(MODEL, 1.0)
    n = 20000
    ids, counts = sentencepieces.sample_rows(p, np.tile(np.frombuffer(b"ther", np.uint8), n), np.arange(0, 4 * n + 1, 4), np.arange(n).astype(np.uint64), 5)
    cut = np.r_[0, np.cumsum(counts)]
    seen = collections.Counter(tuple(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True))
    weight = {s: np.exp(sum(p.log[i] for i in s)) for s in seen}
    for s, k in seen.most_common(3):
        assert abs(k / n - weight[s] / sum(weight.values())) < 0.01


def test_empty_and_odd_tables(spark):
    none, odd = documents(spark, []), documents(spark, ODD)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    for docs, n in ((none, 0), (odd, len(ODD))):
        assert ngram_join.ngram_jaccard_join(spark, docs).count() == n
        assert line_dedup.line_dedup(spark, docs).count() == n
        assert mixing.mix_sources(spark, docs).count() == n
        assert secrets.secret_scan(spark, docs).count() == n
        assert licenses.license_scan(spark, docs).count() == n
        assert sentencepieces.sample_encode(spark, docs, MODEL).count() == n
        assert toxicity.score_toxicity(spark, docs, toxicity.learn(spark, toxicity.labelled_texts(docs, labels))).count() == n
    assert training_order.training_records(spark, none).count() == 0
    assert embedding_dedup.embedding_near_dedup(spark, vectors).count() == 0
    assert topk.exact_top_k(spark, vectors).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, DATA, "documents")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = common.Scratch(spark, "test").save(stage(spark, seen, DATA))
        assert seen.columns == docs.columns, name
        if name == "line_dedup":
            before = {r.doc_id: shingles(r.text) for r in seen.collect()}
        if name == "ngram_join":
            kept = {r.doc_id for r in seen.collect()}
            near = lambda a, b: before[a] and 100 * len(before[a] & before[b]) >= 80 * len(before[a] | before[b])
            assert not any(near(a, b) for a in kept for b in kept if a < b)
            assert all(any(near(a, b) for b in before if b < a) for a in set(before) - kept)
    rows = corpus_pipeline.STAGES[-1][1](spark, seen, DATA).collect()
    assert len(rows) == seen.count() and all(r.lossless for r in rows)
    whole = {r.doc_id: WORD.findall(r.text or "") for r in common.table(spark, DATA, "documents").collect()}
    assert {r.doc_id for r in rows} <= set(whole)
