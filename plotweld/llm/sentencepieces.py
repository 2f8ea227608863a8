"""Sampled SentencePiece segmentation: forward filtering, backward sampling over the piece lattice.

Text is handled as UTF-8 bytes, a space standing for the piece mark. No piece goes over
a space that follows another character, nor over a line break, so a text falls into units whose lattices are
independent. For the distinct units of a block of texts one lattice is built: an edge for every
piece that fits, found by rolling hashes; forward sums give each position's probability mass.
Then all units of the block are sampled backwards at once, from unit end to start, choosing an
incoming edge in proportion to its share of the mass. Draws come from a hash of (seed, row key, unit number, step),
so a row is segmented alike wherever and whenever it is processed.

A piece's log-probability is -alpha ln(rank + 10): the model file orders its pieces by merge
rank, and shares fall about as 1 / rank. Bytes of characters without a piece use byte pieces; a
literal piece mark in the text is such a character, so decoding always returns the very text.

Null texts have no pieces and decode to null in effect (n_pieces 0); so do empty ones. Repeated
rows are segmented alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import col
from .textkernel import BASE, BASE_INVERSE, U64, _powers, mix, text_chunks

MODEL = "piece_bpe_32k.model"
BLOCK_BYTES = 1 << 21
MARK = "▁"
BYTE_LOG_SHARE = -25.0
CELL_BITS = 20


class Pieces:
    """The piece table of a model: bytes, log shares, and all prefixes of pieces by hash."""

    def __init__(self, pieces: list[tuple[bytes, int, float]], byte_ids: list[int]):
        self.byte_ids = np.array(byte_ids, np.int64)
        size = max(max((i for _, i, _ in pieces), default=0), max(byte_ids)) + 1
        self.text = [b""] * size
        self.log = np.full(size, BYTE_LOG_SHARE)
        prefix: dict[bytes, int] = {}
        for raw, i, log in pieces:
            self.text[i] = raw
            self.log[i] = log
            for k in range(1, len(raw)):
                prefix.setdefault(raw[:k], -1)
            prefix[raw] = i
        for b, i in enumerate(byte_ids):
            self.text[i] = bytes([b])
        self.lens = np.array([len(t) for t in self.text])
        self.start = np.r_[0, np.cumsum(self.lens)]
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        keys = list(prefix)
        flat = np.frombuffer(b"".join(keys), np.uint8)
        lens = np.array([len(k) for k in keys])
        at = np.r_[0, np.cumsum(lens)]
        terms = (flat.astype(U64) + U64(1)) * _powers(BASE, int(lens.max()))[np.arange(len(flat)) - np.repeat(at[:-1], lens)]
        h = mix(np.add.reduceat(terms, at[:-1]) + lens.astype(U64))
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array([prefix[k] for k in keys], np.int64)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two prefixes share a hash")
        self.longest = int(lens.max())
        self.cells = np.searchsorted(self.keys >> U64(64 - CELL_BITS), np.arange((1 << CELL_BITS) + 1, dtype=U64)).astype(np.int32)
        self.fullest = int(np.diff(self.cells).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes among the sorted prefixes, -1 where unknown."""
        cell = (h >> U64(64 - CELL_BITS)).astype(np.int64)
        slot, end = self.cells[cell], self.cells[cell + 1]
        out = np.full(len(h), -1, np.int64)
        for k in range(self.fullest):
            at = np.minimum(slot + k, len(self.keys) - 1)
            hit = (slot + k < end) & (self.keys[at] == h)
            out[hit] = at[hit]
        return out


def load_pieces(path: str, alpha: float) -> Pieces:
    """Piece table of a SentencePiece model file, read on the driver; its size is the vocabulary's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [0] * 256
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            rank = max(0.0, -model.get_score(i))
            pieces.append((name.replace(MARK, " ").encode(), i, -alpha * float(np.log(rank + 10))))
    for raw, _, _ in pieces:
        body = raw.lstrip(b" ")
        if b" " in body or (b"\n" in raw and len(raw) > 1):
            raise ValueError("a piece crosses a unit boundary")
    return Pieces(pieces, byte_ids)


def unit_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the units: text starts, spaces after other characters, line breaks and what follows."""
    start = np.zeros(len(raw) + 1, bool)
    start[offs] = True
    space, line = raw == 32, raw == 10
    start[1:-1] |= space[1:] & ~space[:-1]
    start[:-1] |= line
    start[1:] |= line
    return np.flatnonzero(start[:-1])


def lattice(pieces: Pieces, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Edges (from, to, id) of all units laid end to end; nodes are byte positions of `flat`."""
    n = len(flat)
    total = np.zeros(n + 1, U64)
    np.cumsum((flat.astype(U64) + U64(1)) * _powers(BASE, n), out=total[1:])
    inverse = _powers(BASE_INVERSE, n + 1)
    limit = np.repeat(ends, ends - starts)
    head = (flat & 0xC0) != 0x80
    at = np.flatnonzero(head)
    begin, finish, ident = [], [], []
    covered = np.zeros(n, bool)
    char_len = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))
    for k in range(1, pieces.longest + 1):
        at = at[at + k <= limit[at]]
        if not len(at):
            break
        h = mix((total[at + k] - total[at]) * inverse[at] + U64(k))
        slot = pieces.find(h)
        known = slot >= 0
        at, slot = at[known], slot[known]
        i = pieces.ids[slot]
        whole = i >= 0
        begin.append(at[whole].astype(np.int32))
        finish.append(begin[-1] + np.int32(k))
        ident.append(i[whole].astype(np.int32))
        covered[at[whole & (char_len[at] == k)]] = True
    # Characters that are no piece of their own go by bytes.
    heads = np.flatnonzero(head)
    bare = heads[~covered[heads]]
    more = [bare + k for k in range(4)]
    by = np.concatenate([m[char_len[bare] > k] for k, m in enumerate(more)])
    begin.append(by.astype(np.int32))
    finish.append(begin[-1] + np.int32(1))
    ident.append(pieces.byte_ids[flat[by]].astype(np.int32))
    return np.concatenate(begin), np.concatenate(finish), np.concatenate(ident)


def forward(pieces: Pieces, n: int, starts: np.ndarray, ends: np.ndarray, begin, finish, ident):
    """Edges by depth and end with their shares of the end's mass, and the first and last edge of each end."""
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), ends - starts)
    unit = owner[begin]
    # Nodes: a unit of k bytes has k + 1, so unit u starts at starts[u] + u.
    shift = (starts + np.arange(len(starts))).astype(np.int32)
    b = finish + unit
    depth = b - shift[unit]
    order = _order(b)
    order = order[_order(depth[order])]
    a, b, ident, depth = (begin + unit)[order], b[order], ident[order], depth[order]
    mass = np.full(n + len(starts), -np.inf)
    mass[shift] = 0.0
    share = pieces.log[ident]
    fresh = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    steps = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
    for s, e, x, y in zip(steps[:-1], steps[1:], *(np.searchsorted(fresh, z) for z in (steps[:-1], steps[1:])), strict=True):
        if s < e:
            share[s:e] += mass[a[s:e]]
            mass[b[fresh[x:y]]] = np.logaddexp.reduceat(share[s:e], fresh[x:y] - s)
    share -= mass[b]
    np.exp(share, out=share)
    first = np.zeros(n + len(starts), np.int32)
    last = np.zeros(n + len(starts), np.int32)
    first[b[fresh]] = fresh
    last[b[fresh]] = np.r_[fresh[1:], len(b)] - 1
    return a, ident, share, first, last, shift, (ends + np.arange(len(starts))).astype(np.int32)


def _order(values: np.ndarray) -> np.ndarray:
    """A stable order of small non-negative integers, sorted by halves of 16 bits."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and values.max() > 0xFFFF:
        order = order[np.argsort((values[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def sample_rows(pieces: Pieces, raw: np.ndarray, offs: np.ndarray, keys: np.ndarray, seed: int):
    """Piece ids of the texts of a block, laid end to end, and how many each text has."""
    rows = len(offs) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    starts = unit_starts(raw, offs)
    ends = np.r_[starts[1:], len(raw)]
    row = np.searchsorted(offs, starts, "right") - 1
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _powers(BASE, len(raw)), out=total[1:])
    h = mix((total[ends] - total[starts]) * _powers(BASE_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(U64))
    _, pick, which = np.unique(h, return_index=True, return_inverse=True)
    lens = (ends - starts)[pick]
    at = np.r_[0, np.cumsum(lens)]
    flat = raw[np.repeat(starts[pick] - at[:-1], lens) + np.arange(at[-1])]
    begin, finish, ident = lattice(pieces, flat, at[:-1], at[1:])
    a, ident, share, first, last, low, high = forward(pieces, len(flat), at[:-1], at[1:], begin, finish, ident)
    number = np.arange(len(starts)) - np.searchsorted(row, np.arange(rows))[row]
    salt = mix(mix(keys[row] + U64(seed)) + number.astype(U64))
    live, node, floor, step = np.arange(len(starts), dtype=np.int32), high[which], low[which], 0
    count = np.zeros(len(starts), np.int64)
    chosen: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        u = (mix(salt + U64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(11)).astype(np.float64) * 2.0**-53
        e, end = first[node], last[node]
        u -= share[e]
        left = np.flatnonzero((u >= 0) & (e < end))
        while len(left):
            at_e = e[left] + 1
            rest = u[left] - share[at_e]
            e[left], u[left] = at_e, rest
            left = left[(rest >= 0) & (at_e < end[left])]
        chosen.append((live, ident[e]))
        count[live] += 1
        node = a[e]
        on = node > floor
        live, node, floor, salt, step = live[on], node[on], floor[on], salt[on], step + 1
    out_at = np.r_[0, np.cumsum(count)]
    out = np.empty(out_at[-1], np.int64)
    for k, (who, ids) in enumerate(chosen):
        out[out_at[who] + count[who] - 1 - k] = ids
    return out, np.bincount(row, weights=count, minlength=rows).astype(np.int64)


def decode_rows(pieces: Pieces, ids: np.ndarray) -> np.ndarray:
    """The bytes of pieces laid end to end."""
    lens = pieces.lens[ids]
    at = np.r_[0, np.cumsum(lens)]
    return pieces.flat[np.repeat(pieces.start[ids] - at[:-1], lens) + np.arange(at[-1])]


_TABLES: dict[str, Pieces] = {}


def _held(shared) -> Pieces:
    """The piece table of a broadcast, built once for a worker."""
    pieces, byte_ids, name = shared.value
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Pieces(pieces, byte_ids)
    return _TABLES[name]


def row_keys(ids: pa.Array) -> np.ndarray:
    """64-bit keys of row ids: whole numbers as they are, others by their text, 0 for null."""
    if pa.types.is_integer(ids.type):
        return np.array([0 if k is None else k for k in ids.to_pylist()], np.int64).view(U64)
    return np.array([0 if k is None else int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "little") for k in ids.to_pylist()], U64)


def _encode(shared, seed):
    def run(batches):
        pieces = _held(shared)
        for batch in batches:
            keys = row_keys(batch.column(0))
            for row, raw, offs in text_chunks(batch.column(1), BLOCK_BYTES):
                ids, counts = sample_rows(pieces, raw, offs, keys[row : row + len(offs) - 1], seed)
                back = decode_rows(pieces, ids)
                cut = np.r_[0, np.cumsum(counts)]
                same = np.array_equal(back, raw)
                ok = [same or np.array_equal(decode_rows(pieces, ids[cut[k] : cut[k + 1]]), raw[offs[k] : offs[k + 1]]) for k in range(len(counts))]
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(counts)), lists, pa.array(counts), pa.array(ok)], ["doc_id", "ids", "n_pieces", "lossless"])

    return run


def _parts(path: str, alpha: float):
    p = load_pieces(path, alpha)
    bytes_of = set(p.byte_ids.tolist())
    return [(t, i, float(p.log[i])) for i, t in enumerate(p.text) if t and i not in bytes_of], p.byte_ids.tolist(), f"{path} {alpha}"


def sample_encode(spark: SparkSession, docs: DataFrame, model_path: str, alpha: float = 1.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (of any type), ids, n_pieces, lossless (the ids decode to the very text); other columns are left out."""
    shared = spark.sparkContext.broadcast(_parts(model_path, alpha))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode(shared, seed), f"doc_id {kind}, ids array<int>, n_pieces bigint, lossless boolean")


class PieceEncoder:
    """16-bit piece ids for training_order; two ids above the table end a document and pad."""

    def __init__(self, spark: SparkSession, model_path: str, alpha: float = 1.0, seed: int = 11):
        parts = _parts(model_path, alpha)
        size = max(*(i for _, i, _ in parts[0]), *parts[1]) + 1
        if size > 65_534:
            raise ValueError("the piece table does not fit 16 bits")
        self.shared, self.seed, self.end, self.pad = spark.sparkContext.broadcast(parts), seed, size, size + 1

    def counts(self, ids: pa.Array, column: pa.Array) -> list[int]:
        return [len(x) for x in self.arrays(ids, column)]

    def arrays(self, ids: pa.Array, column: pa.Array):
        """The sampled ids of each text of a column, keyed by the rows' ids."""
        pieces, keys = _held(self.shared), row_keys(ids)
        for row, raw, offs in text_chunks(column, BLOCK_BYTES):
            found, counts = sample_rows(pieces, raw, offs, keys[row : row + len(offs) - 1], self.seed)
            yield from np.split(found.astype(np.uint16), np.cumsum(counts)[:-1])


def _decode(shared):
    def run(batches):
        pieces = _held(shared)
        for batch in batches:
            texts = [None if ids is None else decode_rows(pieces, np.array(ids, np.int64)).tobytes().decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(spark: SparkSession, encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows of piece ids."""
    shared = spark.sparkContext.broadcast(_parts(model_path, 1.0))
    return encoded.select("doc_id", "ids").mapInArrow(_decode(shared), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
