"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

Pieces come from a public SentencePiece model file; a piece's weight falls with its rank (Zipf), to the power ALPHA. A
text is cut into words (a run of spaces and what follows it, a newline by itself, however long), which no piece
crosses. A word's lattice has an edge for every piece that its bytes spell, and byte pieces for characters that no
piece spells, so every text has a segmentation. Forward filtering sums the weights of all paths to each place, once for
each distinct word of a batch; backward sampling then draws every occurrence's path from its end, in proportion to its
weight. The random numbers come from the row key, the place in the text and a seed: reruns agree, however rows are
partitioned, and repeated rows agree with each other.

No normalising, no added or removed spaces: decoding gives the text back. Null and empty texts have no pieces. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_hashes, mix, pieces, prefix_sums, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED, BATCH_BYTES = 1.0, 23, 2 << 20
#: So many words or fewer are read place by place, since array steps cost more.
FEW = 16
_TABLE_BITS = 20


class Pieces:
    """The piece table: bytes, log weights, and hash tables of the pieces and of their beginnings."""

    def __init__(self, path: str = MODEL, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = np.full(256, -1)
        self.raw: list[bytes] = [b""] * n
        found: dict[bytes, tuple[int, float]] = {}
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.raw[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = model.id_to_piece(i).replace("▁", " ").encode()
                self.raw[i] = raw
                # Ranks start at the first ordinary piece; single characters stand last in such models.
                found.setdefault(raw, (i, -alpha * np.log(2.0 + len(found))))
        self.byte_weight = -alpha * np.log(2.0 + n)
        self.longest = max(map(len, found))
        flat = np.frombuffer(b"".join(found), np.uint8)
        ends = np.cumsum([len(x) for x in found])
        starts = ends - [len(x) for x in found]
        sums = prefix_sums(flat)
        h = span_hashes(sums, starts, ends)
        order = np.argsort(h)
        self.hashes = h[order]
        self.ids = np.array([x[0] for x in found.values()])[order]
        self.weights = np.array([x[1] for x in found.values()])[order]
        # By the top bits of a hash: a piece that has them (-1: none; -2: several), and whether some beginning has them.
        shift = np.uint64(64 - _TABLE_BITS)
        self.slots, self.is_begin = np.full(1 << _TABLE_BITS, -1, np.int32), np.zeros(1 << _TABLE_BITS, bool)
        slots = (self.hashes >> shift).astype(np.int64)
        self.slots[slots] = np.arange(len(slots))
        self.slots[np.flatnonzero(np.bincount(slots, minlength=1 << _TABLE_BITS) > 1)] = -2
        for k in range(1, self.longest + 1):
            longer = ends - starts >= k
            self.is_begin[(span_hashes(sums, starts[longer], starts[longer] + k) >> shift).astype(np.int64)] = True
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.lengths = np.array([len(x) for x in self.raw])
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])

    def find(self, hashes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """The place of each hash in the table; -1 where no piece has it."""
        place = self.slots[slots]
        many = np.flatnonzero(place == -2)
        place[many] = np.minimum(np.searchsorted(self.hashes, hashes[many]), len(self.hashes) - 1)
        return np.where((place >= 0) & (self.hashes[place] == hashes), place, -1)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the pieces spell, end to end."""
        n = self.lengths[ids]
        total = int(n.sum())
        return self.flat[np.repeat(self.offsets[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(total)]


@lru_cache(4)
def piece_table(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def words(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where words begin."""
    n = len(data)
    begins = np.zeros(n, bool)
    space, line = data == 32, data == 10
    begins[1:] = (space[1:] & ~space[:-1]) | line[:-1]
    begins |= line
    begins[offs[:-1][offs[:-1] < n]] = True
    return np.flatnonzero(begins)


def lattice(table: Pieces, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges (from, to, piece, log weight) of the words ``data[bounds[i]:bounds[i + 1]]``, by their ends.

    Places are numbered by byte plus word, so that each word has a first and a last place of its own.
    """
    n = len(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[lead]
    until = bounds[1:][word]
    sums = prefix_sums(data)
    shift = np.uint64(64 - _TABLE_BITS)
    boundary = np.zeros(n + 1, bool)
    boundary[lead] = True
    boundary[n] = True
    width = np.diff(np.append(lead, n))
    covered = np.zeros(len(lead), bool)
    edges = []
    live = np.arange(len(lead))
    for k in range(1, table.longest + 1):
        live = live[lead[live] + k <= until[live]]
        if not len(live):
            break
        at = lead[live]
        h = span_hashes(sums, at, at + k)
        slot = (h >> shift).astype(np.int64)
        place = table.find(h, slot)
        hit = np.flatnonzero((place >= 0) & boundary[at + k])
        hit, place = live[hit], place[hit]
        covered[hit[width[hit] == k]] = True
        edges.append((lead[hit] + word[hit], lead[hit] + word[hit] + k, table.ids[place], table.weights[place]))
        live = live[table.is_begin[slot]]
    bare = np.flatnonzero(~covered)
    for j in range(4):
        at = bare[width[bare] > j]
        if len(at):
            b = lead[at] + j
            edges.append((b + word[at], b + word[at] + 1, table.byte_ids[data[b]], np.full(len(at), table.byte_weight)))
    # Long pieces first: they are the likely ones, so a draw mostly ends at a place's first edge.
    start, end, piece, weight = (np.concatenate(x) for x in zip(*edges[::-1], strict=True))
    order = np.argsort(end, kind="stable")
    return start[order], end[order], piece[order], weight[order]


def forward(start: np.ndarray, end: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log sums of the weights of all paths to each place, and each edge's share of its end's sum, added up."""
    n_places = int(bounds[-1]) + len(bounds) - 1
    alpha = np.full(n_places, -np.inf)
    first = bounds[:-1] + np.arange(len(bounds) - 1)
    alpha[first] = 0.0
    sizes = np.diff(bounds)
    shared = int(np.partition(sizes, -FEW - 1)[-FEW - 1]) if len(sizes) > FEW else 0
    depth = np.minimum(end - np.repeat(first, sizes + 1)[end], shared + 1)
    depth = depth.astype(np.uint16 if shared < 65535 else np.int64)
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(1, shared + 2))
    share = np.empty(len(end))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        e = by_depth[a:b]
        value = alpha[start[e]] + weight[e]
        ends = end[e]
        heads = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
        top = np.maximum.reduceat(value, heads)
        sizes = np.diff(np.append(heads, len(e)))
        top = np.where(np.isfinite(top), top, 0.0)
        mass = np.exp(value - np.repeat(top, sizes))
        total = np.add.reduceat(mass, heads)
        with np.errstate(divide="ignore"):
            alpha[ends[heads]] = top + np.log(total)
        running = np.cumsum(mass)
        running -= np.repeat(running[heads] - mass[heads], sizes)
        share[e] = running / np.repeat(np.where(total > 0, total, 1.0), sizes)
    # Beyond the depth that more than FEW words reach: place by place, in the order of the ends.
    rest = by_depth[cuts[-1] :]
    sums: dict[int, float] = {}
    shares: list[float] = []
    at, values = -1, []

    def close() -> None:
        top = max(values, default=0.0)
        top = top if math.isfinite(top) else 0.0
        running = 0.0
        for i, v in enumerate(values):
            running += math.exp(v - top)
            values[i] = running
        sums[at] = top + math.log(running) if running > 0 else -math.inf
        shares.extend(v / (running or 1.0) for v in values)

    for origin, to, w, known in zip(start[rest].tolist(), end[rest].tolist(), weight[rest].tolist(), alpha[start[rest]].tolist(), strict=True):
        if to != at:
            if values:
                close()
            at, values = to, []
        values.append(sums.get(origin, known) + w)
    if values:
        close()
    share[rest] = shares
    alpha[list(sums)] = list(sums.values())
    return alpha, share


def encode(table: Pieces, data: np.ndarray, offs: np.ndarray, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of the texts, end to end, and where each text's begin."""
    n_rows = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n_rows + 1, np.int64)
    at = words(data, offs)
    till = np.append(at[1:], len(data))
    row = np.searchsorted(offs, at, side="right") - 1
    _, pick, kind = np.unique(block_hashes(data, at, till), return_index=True, return_inverse=True)
    sizes = (till - at)[pick]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    text = data[np.repeat(at[pick] - bounds[:-1], sizes) + np.arange(bounds[-1])]
    start, end, piece, weight = lattice(table, text, bounds)
    _, share = forward(start, end, weight, bounds)
    edges_to = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=int(bounds[-1]) + len(bounds)))])
    first = bounds[:-1] + np.arange(len(bounds) - 1)
    goal = first[kind]
    place = goal + sizes[kind]
    base = mix(keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[row]
    offset = (at - offs[row] - goal).astype(np.uint64)
    live = np.arange(len(at))
    steps = []
    while len(live) > FEW:
        here = place[live]
        u = (mix(base[live] ^ mix(offset[live] + here.astype(np.uint64))) >> np.uint64(11)).astype(np.float64) / 2.0**53
        edge, last = edges_to[here], edges_to[here + 1] - 1
        on = np.flatnonzero((share[edge] <= u) & (edge < last))
        while len(on):
            edge[on] += 1
            on = on[(share[edge[on]] <= u[on]) & (edge[on] < last[on])]
        steps.append((live, piece[edge]))
        place[live] = start[edge]
        live = live[place[live] > goal[live]]
    tails = []
    for w in live.tolist():
        here, stop, drawn = int(place[w]), int(goal[w]), []
        reach = np.arange(stop, here + 1)
        u = ((mix(base[w] ^ mix(offset[w] + reach.astype(np.uint64))) >> np.uint64(11)).astype(np.float64) / 2.0**53).tolist()
        low = int(edges_to[stop])
        heads, shares, origins = edges_to[stop : here + 2].tolist(), share[low : edges_to[here + 1]].tolist(), start[low : edges_to[here + 1]].tolist()
        while here > stop:
            edge, last = heads[here - stop] - low, heads[here - stop + 1] - 1 - low
            while edge < last and shares[edge] <= u[here - stop]:
                edge += 1
            drawn.append(edge + low)
            here = origins[edge]
        tails.append((w, piece[drawn]))
    counts = np.zeros(len(at), np.int64)
    for who, _ in steps:
        counts[who] += 1
    begun = counts[live]
    counts[live] += np.array([len(what) for _, what in tails], np.int64)
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]), np.int32)
    for k, (who, what) in enumerate(steps):
        out[ends[who] - 1 - k] = what
    for (w, what), n in zip(tails, begun.tolist(), strict=True):
        out[ends[w] - n - len(what) : ends[w] - n] = what[::-1]
    per_row = np.bincount(row, weights=counts, minlength=n_rows).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(per_row)])


def _digests(table: Pieces, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """SHA-256 of the bytes that each row's pieces spell."""
    raw = table.bytes_of(ids).tobytes()
    ends = np.concatenate([[0], np.cumsum(table.lengths[ids])])[bounds].tolist()
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def _encoding(path: str, alpha: float, seed: int, digest: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path, alpha)
        for batch, data, offs in pieces(batches, BATCH_BYTES):
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            ids, bounds = encode(table, data, offs, keys, seed)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            more = {"decoded_sha256": _digests(table, ids, bounds)} if digest else {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, *more.values()], ["doc_id", "ids", *more])

    return run


def _decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path, ALPHA)
        for batch in batches:
            ids = batch.column("ids")
            bounds = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.values.to_numpy(zero_copy_only=False)
            texts = [table.bytes_of(flat[a:b]).tobytes().decode("utf-8") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def sample_pieces(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, digest: bool = False) -> DataFrame:
    """doc_id and ids (array of int): one sampled segmentation of each text, reproducible by doc_id and seed.

    With ``digest``, the pieces are decoded too: decoded_sha256 is that of the text where nothing was lost.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("key"), "text")
    return rows.mapInArrow(_encoding(model, alpha, seed, digest), f"doc_id {kind}, ids array<int>" + ", decoded_sha256 string" * digest)


def join_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of the rows of ``sample_pieces``; null ids give an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decoding(model), f"doc_id {kind}, text string")
