"""Toxicity by a learned lexicon, misspellings found with Levenshtein automata over its trie.

Learning uses about SAMPLE_ROWS labelled rows, picked by a hash of doc_id, one text for each. Terms (whole words,
and stems: the first STEM letters of a word, any ending) are counted over that sample in the cluster and
all are kept that toxic texts hold far more often than others; their number is bounded by the sample's words.

Every word goes through the intersection of its Levenshtein automaton with the trie of the kept terms. The automaton
is compiled to bit masks: a word's mask of a letter marks the places where it stands, a state is one set of places
for each number of edits, and a step down the trie moves the states of all words of a batch that are
still alive at that node by a few shifts. Terms of FUZZY_LETTERS letters allow one edit, of TWO_EDITS two; a swap
of neighbours is one edit. A stem is near where a prefix of the word is. Terms of more than LONGEST letters are
found as they stand only, and stems look at a word's first LONGEST letters.

A hit counts less where its window shows quotation: inside quotation marks that close within
WINDOW characters, or near a reporting word. Scores are a logistic function of the hits' weights,
their share of the words, exact and misspelled, abusive and quoted apart, fitted on the sample.

Null and empty texts have no hits and get the score of a text without hits. Repeated rows are
scored each for itself. Without labels to learn from every score is the neutral prior 0. The score's column has
underscores added where the table has one of its name (`score_column`).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, free

SAMPLE_ROWS = 20_000
STEM = (3, 4, 5, 6, 7, 8)
LEAST_POSITIVE = 4
LEAST_RATIO = 20.0
FUZZY_LETTERS, TWO_EDITS = 5, 9
LONGEST = 60
WINDOW = 120
CACHE = 150_000
WORDS_AT_ONCE = 20_000
TEXTS_AT_ONCE = 500
WORDS = re.compile(r"\w+")
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
#: Fixed words of reported speech in the four languages.
REPORTING = frozenset("said says wrote writes quoted quote called word term sagte schrieb zitat wort dit écrit mot terme citation dijo escribió palabra cita".split())


def bound(letters: int) -> int:
    """Edits that a term of so many letters allows."""
    return 0 if letters < FUZZY_LETTERS else 1 if letters < TWO_EDITS else 2


class _Node:
    """A trie node: below it, the most edits of a term and the lengths of words that can be near one."""

    __slots__ = ("children", "edits", "least", "most", "weights")

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.weights = [0.0, 0.0]  # of a whole term and of a stem that end here
        self.edits, self.least, self.most = 0, LONGEST, 0


class LexiconTrie:
    """Terms by letter; `*` after a term lets any ending follow."""

    def __init__(self, terms: dict[str, float]):
        self.terms = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.stem_lens = sorted({len(t) for t in self.stems})
        self.root = _Node()
        self.letters: set[str] = set()
        for held, slot in ((self.terms, 0), (self.stems, 1)):
            for word, weight in held.items():
                edits = bound(len(word))
                if not edits or len(word) > LONGEST:
                    continue
                node = self.root
                for c in ["", *word]:
                    node = node.children.setdefault(c, _Node()) if c else node
                    node.edits = max(node.edits, edits)
                    node.least = min(node.least, len(word) - edits)
                    node.most = max(node.most, LONGEST + 1 if slot else len(word) + edits)
                self.letters.update(word)
                node.weights[slot] = max(weight, node.weights[slot])

    def exact(self, word: str) -> float:
        return max([self.terms.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.stem_lens if n <= len(word))])

    def near(self, words: list[str]) -> np.ndarray:
        """For each word the heaviest term near it, or stem near a prefix of it."""
        best = np.zeros(len(words))
        if not words or not self.root.children:
            return best
        lens = np.array([min(len(w), LONGEST) for w in words])
        kind = np.uint32 if lens.max() < 30 else np.uint64
        letters = np.zeros((len(words), int(lens.max())), np.uint32)
        letters[np.arange(letters.shape[1]) < lens[:, None]] = np.frombuffer("".join(w[:LONGEST] for w in words).encode("utf-32-le"), np.uint32)
        masks = {c: np.zeros(len(words), kind) for c in self.letters}
        for k, column in enumerate(letters.T):
            for c in masks:
                masks[c] |= (column == ord(c)).astype(kind) << kind(k)
        one, two, end = kind(1), kind(2), kind(1) << lens.astype(kind)
        inside = (end << one) - one
        lens = np.array([len(w) for w in words])
        start = [np.ones(len(words), kind)]
        for _ in range(self.root.edits):
            start.append((start[-1] | (start[-1] << one)) & inside)
        stack = [(self.root, np.arange(len(words)), start, None, None, 0)]
        while stack:
            node, who, states, before, last, depth = stack.pop()
            edits = bound(depth)
            if edits and any(node.weights):
                held = states[edits]
                whole = np.where(lens[who] <= LONGEST, held & end[who], 0)
                for weight, hit in zip(node.weights, (whole, held), strict=True):
                    if weight:
                        some = who[hit != 0]
                        best[some] = np.maximum(best[some], weight)
            sizes, limits, known = np.minimum(lens[who], LONGEST + 1), inside[who], {c: masks[c][who] for c in {*node.children, last or ""} if c}
            for c, child in node.children.items():
                mask, new = known[c], []
                for e in range(child.edits + 1):
                    state = (states[e] & mask) << one
                    if e:
                        # A letter of the term without one of the word, one for another, one of the word alone, a swap.
                        state |= states[e - 1] | (states[e - 1] << one) | (new[e - 1] << one)
                        if before is not None:
                            state |= (before[e - 1] & mask & (known[last] >> one)) << two
                    new.append(state & limits)
                alive = np.flatnonzero((new[-1] != 0) & (sizes >= child.least) & (sizes <= child.most))
                if len(alive):
                    stack.append((child, who[alive], [x[alive] for x in new], [x[alive] for x in states[: child.edits + 1]], c, depth + 1))
        return best

    def weigh_all(self, words: list[str]) -> list[tuple[float, bool]]:
        """(weight, misspelled) of each word; weight 0 for a word that is no hit."""
        found = [(self.exact(w), False) for w in words]
        open_ = [i for i, (weight, _) in enumerate(found) if not weight and len(words[i]) >= FUZZY_LETTERS - 1]
        for part in ([i for i in open_ if len(words[i]) < 30], [i for i in open_ if len(words[i]) >= 30]):
            for i, weight in zip(part, self.near([words[i] for i in part]).tolist(), strict=True):
                if weight:
                    found[i] = (weight, True)
        return found

    def weigh(self, word: str) -> tuple[float, bool]:
        return self.weigh_all([word])[0]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit shows quotation."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    for left, right in QUOTES.items():
        if left == right:
            if before.count(left) % 2 and right in after:
                return True
        elif before.rfind(left) > before.rfind(right) and right in after:
            return True
    return any(w in REPORTING for w in WORDS.findall(before.lower())[-4:])


def features(texts: list[str | None], trie: LexiconTrie, cache: dict) -> list[list[float]]:
    """For each text exact and misspelled abuse, quoted hits, and the share of hits among the words."""
    if len(cache) > CACHE:
        cache.clear()
    lows = [(t or "").lower() for t in texts]
    counts = [Counter(WORDS.findall(low)) for low in lows]
    new = sorted({w for found in counts for w in found if w not in cache})
    for at in range(0, len(new), WORDS_AT_ONCE):
        part = new[at : at + WORDS_AT_ONCE]
        cache.update(zip(part, trie.weigh_all(part), strict=True))
    out = []
    for low, found in zip(lows, counts, strict=True):
        hits = {w: cache[w] for w in found if cache[w][0]}
        sums = [0.0, 0.0, 0.0]
        if hits:
            for m in WORDS.finditer(low):
                got = hits.get(m.group())
                if got:
                    sums[2 if quoted(low, m.start(), m.end()) else int(got[1])] += got[0]
        out.append([math.log1p(s) for s in sums] + [100.0 * sum(sums[:2]) / (sum(found.values()) + 20)])
    return out


def _terms(word: str):
    yield word
    for n in STEM:
        if len(word) > n:
            yield word[:n] + "*"


def _count_terms(only: frozenset | None):
    """(term, positives, negatives) by partition; first of terms in toxic texts, then of `only`."""

    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if only is None and not toxic:
                    continue
                terms = {t for w in set(WORDS.findall((text or "").lower())) if len(w) > 2 for t in _terms(w)}
                for t in terms if only is None else terms & only:
                    counts.setdefault(t, [0, 0])[0 if toxic else 1] += 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["term", "pos", "neg"])

    return run


def _in_parts(texts: pa.Array, trie: LexiconTrie, cache: dict) -> list[list[float]]:
    """Features of a column, of which only some texts are Python strings at a time."""
    rows = [x for at in range(0, len(texts), TEXTS_AT_ONCE) for x in features(texts.slice(at, TEXTS_AT_ONCE).to_pylist(), trie, cache)]
    pa.default_memory_pool().release_unused()
    return rows


def _sample_features(shared):
    def run(batches):
        trie, cache = LexiconTrie(shared.value), {}
        for batch in batches:
            rows = _in_parts(batch.column(0), trie, cache)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the ridge-penalised log loss; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    pen = ridge * np.eye(x.shape[1])
    pen[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + len(x) * 1e-4 * pen @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x + len(x) * 1e-4 * pen + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return w


def learn(spark: SparkSession, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and score weights from columns key, text, toxic (0 or 1)."""
    box = Scratch(spark, "toxicity")
    count = labelled.count()
    part = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample_rows / max(1, count))))
    one = F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), "text"))
    part = box.save(part.groupBy("key").agg(one.alias("one")).select("one.text", "one.toxic"))
    totals = {r[0]: r[1] for r in part.groupBy("toxic").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return {}, np.array([0.0, 0.0, 0.0, 0.0, -30.0])
    form = "term string, pos bigint, neg bigint"
    least = max(2, min(LEAST_POSITIVE, pos // 8))
    first = part.mapInArrow(_count_terms(None), form).groupBy("term").agg(F.sum("pos").alias("pos")).where(F.col("pos") >= least)
    names = frozenset(r[0] for r in first.select("term").collect())
    counted = part.mapInArrow(_count_terms(names), form).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = ((F.col("pos") + 0.5) / (pos + 1)) / ((F.col("neg") + 0.5) / (neg + 1))
    kept = counted.withColumn("ratio", ratio).where((F.col("ratio") >= LEAST_RATIO) & (F.col("pos") >= least)).collect()
    # A stem gives way to a longer term that nearly all its toxic texts hold.
    held = {r.term: r.pos for r in kept}
    reach: dict[str, int] = {}
    for t, n in held.items():
        for k in STEM:
            if k < len(t.rstrip("*")):
                reach[t[:k] + "*"] = max(n, reach.get(t[:k] + "*", 0))
    terms = {r.term: math.log(r.ratio) for r in kept if reach.get(r.term, 0) < 0.9 * r.pos}
    stems = {t[:-1] for t in terms if t.endswith("*")}
    # A stem under a shorter one goes; whole terms stay, for their misspellings.
    terms = {t: w for t, w in terms.items() if not t.endswith("*") or not any(t.rstrip("*")[:n] in stems for n in STEM if n < len(t.rstrip("*")))}
    shared = spark.sparkContext.broadcast(terms)
    rows = part.mapInArrow(_sample_features(shared), "x array<double>, toxic int").collect()
    weights = fit_logistic(np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows]))
    box.drop(part)
    return terms, weights


def _scores(shared):
    def run(batches):
        terms, weights = shared.value
        trie, cache = LexiconTrie(terms), {}
        for batch in batches:
            # The text to score is the last column; the score takes its place.
            x = np.array(_in_parts(batch.columns[-1], trie, cache)).reshape(-1, 4)
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score_column(docs: DataFrame) -> str:
    """The name of the score's column beside those of `docs`."""
    return free("__score", docs.columns)


def score_toxicity(spark: SparkSession, docs: DataFrame, model: tuple[dict[str, float], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of `docs` with a double `__score` in [0, 1] (see `score_column`)."""
    shared, names = spark.sparkContext.broadcast(model), [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("score", F.col(names[docs.columns.index(text_col)]).cast("string"))
    form = StructType([*(StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)), StructField("score", DoubleType())])
    return rows.mapInArrow(_scores(shared), form).toDF(*docs.columns, score_column(docs))


def held_out(id_col: str):
    """Rows never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: one label for each id, held-out rows excluded."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out("doc_id")).select(F.col("doc_id").alias("key"), "toxic")
    return docs.select(F.col("doc_id").alias("__id"), F.col("text")).join(known, F.col("__id") == F.col("key")).select("key", "text", "toxic")
