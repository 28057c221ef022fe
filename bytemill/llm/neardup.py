"""N-gram Jaccard join as a blocked sparse matrix product of document by word shingles.

Words are lower-cased (A-Z) byte runs between white space; a document's set holds its distinct shingles of five words,
or the whole sequence where it has fewer. Two documents link when 100 * intersection >= 80 * union. Shingles are told
apart by 64-bit hashes.

1. Equal sets (two 64-bit sums) fall into one class; its smallest doc_id stands for it, and only its text goes on.
2. First round: tokens are ordered by a sketch of their document counts, rare first. A pair that links shares one of the
   first n - ceil(0.8 n) + 1 tokens of either set. Sets none of whose are shared, by sizes that can link, are settled.
3. Second round, for the others: the exact number of sets that hold a token orders it, whatever the size of the input.
   Tokens of one set alone drop out, and with them all sets that have too many of those to link. Tokens whose counter in
   the sketch is crowded (it is an upper bound of their count) are not counted but stand last in the order, so that a
   shingle of half of all documents is dealt to many tasks; the order stays one for all sets, so the filter stays exact.
4. Sets that share one of the first tokens in this order, by sizes that can link, fall into one block, by links to the
   first of them only, never pair by pair. A block that fits a tile is settled where its members meet. Of larger ones,
   the most typical member is compared with all others; those that link with it need no comparison with each other.
5. The rest is compared with the whole block, in tiles of bounded size. A tile pair multiplies its two incidence
   matrices block of columns by block of columns, adds up overlap counts, drops pairs whose sizes or remaining tokens
   cannot reach the bound, and returns no pairs but the links of a spanning forest.
6. Connected components of all links.

Null and empty texts have empty sets and link with nothing. Rows that repeat a doc_id are one node, linked by each of
their texts. Rows with a null doc_id are counted but take no part in links. An empty table gives an empty result. A text
is read whole by one task; very long ones fill a tile each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_hashes, checkpointed, discard, lowered, mix, pieces, scratch, word_spans, written
from .components import connected_components, local_components, tile_pairs

#: Links need NUM / DEN of the union; SHINGLE words make a token.
NUM, DEN, SHINGLE = 80, 100, 5
#: 2 ** SKETCH_BITS counters in CHUNKS rows, whatever the input; rows and tokens of a tile; columns of a block of the product.
SKETCH_BITS, CHUNKS, TILE, TILE_TOKENS, COLUMNS = 22, 64, 512, 1 << 20, 4096
#: Bits of the filter that picks documents for the second round (8 MB); counts of a token that are told apart.
FILTER_BITS, MOST_COUNTED = 26, 4096
#: A counter of the sketch is crowded above MOST_COUNTED and CROWDED times the mean of all counters.
CROWDED = 16
_FACTORS = mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other, and where each text's begin."""
    n = len(offs) - 1
    starts, ends, doc = word_spans(data, offs)
    word = block_hashes(lowered(data), starts, ends)
    n_words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    # A document with w words has max(1, w - k + 1) shingles; short ones take the words they have.
    heads = np.maximum(n_words - k + 1, (n_words > 0).astype(np.int64))
    at = np.repeat(first - np.concatenate([[0], np.cumsum(heads)])[:-1], heads) + np.arange(heads.sum())
    owner = np.repeat(np.arange(n), heads)
    h = np.zeros(len(at), np.uint64)
    left = np.minimum(n_words, k)[owner]
    for j in range(k):
        ok = left > j
        h[ok] += word[at[ok] + j] * _FACTORS[j]
    h = mix(h + left.astype(np.uint64) * _FACTORS[63 - 1])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(n + 1))


def _segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_keys(h: np.ndarray, bounds: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each set; equal sets have equal ones."""
    return mix(_segment_sums(mix(h ^ _FACTORS[40 + which]), bounds)).view(np.int64)


def _fresh_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, keys and tokens of the different sets of a slice of texts."""
    h, bounds = shingle_sets(data, offs)
    keys = set_keys(h, bounds)
    size = np.diff(bounds)
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return size[first], keys[first], h[np.repeat(first, size)]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with its set's size and signature; at the end, the partition's sketch in chunks."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    names = ["doc_id", "n_shingles", "s1", "s2", "chunk", "counts"]
    for batch, data, offs in pieces(batches):
        h, bounds = shingle_sets(data, offs)
        slot, times = np.unique((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
        sketch[slot] += times.astype(np.int32)
        sums = [set_keys(h, bounds, i) for i in (0, 1)]
        none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), *map(pa.array, sums), *none], names)
    if sketch.any():
        none = [pa.nulls(CHUNKS, pa.int64())] * 4
        parts = [zlib.compress(p.tobytes(), 1) for p in sketch.astype(np.int64).reshape(CHUNKS, -1)]
        yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)


def _adding(classes: bool):
    """The sums of sketch chunks, one row for each chunk that the partition holds (rows come chunk by chunk).

    At last the sums become ``classes``: a byte for each counter, eight classes to each doubling.
    """

    def row(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        raw = np.floor(8 * np.log2(total + 1)).clip(0, 250).astype(np.uint8).tobytes() if classes else zlib.compress(total.tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([raw], pa.binary())], ["chunk", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, None
        for batch in batches:
            for c, x in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                if c != chunk:
                    if total is not None:
                        yield row(chunk, total)
                    chunk, total = c, 0
                total = total + np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        if total is not None:
            yield row(chunk, total)

    return run


def count_classes(chunks: DataFrame) -> np.ndarray:
    """The classes of all counters, from the partitions' chunks, which are added up in two levels."""
    for last, salt in ((False, F.spark_partition_id() % 16), (True, F.lit(0))):
        chunks = chunks.repartition("chunk", salt).sortWithinPartitions("chunk").mapInArrow(_adding(last), "chunk int, counts binary")
    classes = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.uint8)
    for row in chunks.collect():  # 2 ** SKETCH_BITS bytes, whatever the input
        classes[row.chunk] = np.frombuffer(row.counts, np.uint8)
    return classes.ravel()


def _ranked(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens whose order as integers is rare first: 8 bits of the sketch's class, then 56 bits of hash."""
    return (classes[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))


def chains(token: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which rows begin a chain, of rows sorted by token and low.

    A row stands for sets of low to high tokens. It goes on with the chain before it if it shares its token and its
    smallest size is within the bound of the largest so far: sizes too far apart can't link, and two that can are in one
    chain, since all sizes between them are.
    """
    fresh = np.ones(len(token), bool)
    fresh[1:] = token[1:] != token[:-1]
    group = np.cumsum(fresh)
    largest = np.maximum.accumulate((group << 32) + high) - (group << 32)
    fresh[1:] |= NUM * low[1:] > DEN * largest[:-1]
    return fresh


def prefix_length(size: np.ndarray) -> np.ndarray:
    return size - (NUM * size + DEN - 1) // DEN + 1


def _postings(token: np.ndarray, n: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """Rows (token, low, high, key) of a slice's prefixes; the sets of a chain go by its first one."""
    order = np.lexsort((key, n, token))
    token, key, n = token[order], key[order], n[order]
    fresh = chains(token, n, n)
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(token)) - 1 if len(head) else head
    lead = key[head][np.cumsum(fresh) - 1] if len(head) else key
    pairs = _pairs(key, lead)
    # All that go by one set share a token of their own, which sizes don't cut.
    own = mix(pairs[:, 1].view(np.uint64) ^ _FACTORS[44]) | np.uint64(0xFF << 56)
    tokens = np.concatenate([token[head], own, own])
    keys = np.concatenate([key[head], pairs[:, 0], pairs[:, 1]])
    low = np.concatenate([n[head], np.zeros(2 * len(own), np.int64)]).astype(np.int32)
    high = np.concatenate([n[last], np.full(2 * len(own), 2**31 - 1)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens.view(np.int64), low, high, keys)], ["token", "low", "high", "key"])


def _pairs(key: np.ndarray, lead: np.ndarray) -> np.ndarray:
    far = key != lead
    return np.unique(np.stack([key[far], lead[far]], 1), axis=0) if far.any() else np.zeros((0, 2), np.int64)


def _first_prefixes(classes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in pieces(batches, 3 << 20):
            size, keys, h = _fresh_sets(data, offs)
            token, owner = _ranked(h, classes), np.repeat(np.arange(len(size)), size)
            token = token[np.lexsort((token, owner))]
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            take = place < prefix_length(size)[owner]
            yield _postings(token[take], size[owner[take]], keys[owner[take]])

    return run


def _to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token and low: links from each set to its chain's first."""
    names, carried = ("token", "low", "high", "key"), None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy().astype(np.int64) for c in names]
        if carried is not None:
            columns = [np.append(x, c) for x, c in zip(carried, columns, strict=True)]
        token, low, high, key = columns
        fresh = chains(token, low, high)
        lead = key[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        # The last chain goes on as one row: its token, its largest size and its first set.
        begin = int(np.flatnonzero(fresh)[-1])
        carried = [token[-1:], low[-1:], high[begin:].max(keepdims=True), lead[-1:]]
        pairs = _pairs(key, lead)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set of 2 ** bits, whatever the number of ids, with the bits of their hashes (column ``h``) set.

    It only spares work: more ids than bits make it let more through, never less.
    """
    place = F.shiftrightunsigned("h", 64 - bits)
    words = ids.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for batch in words.toArrow().to_batches():  # 2 ** (bits - 6) rows at most
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return out


def crowded_counters(classes: np.ndarray, least: int) -> np.ndarray:
    """Packed bits of the sketch's counters that stand above ``least`` and CROWDED times their mean."""
    mean = float(np.mean(np.exp2(np.arange(256) / 8)[classes])) - 1
    return np.packbits(classes > min(int(8 * np.log2(max(least, CROWDED * mean) + 1)), 249))


def _second_tokens(passing: np.ndarray, crowded: np.ndarray, bits: int = FILTER_BITS):
    """All tokens of the documents that the filter lets through, with their set's key.

    ``salt``: 0, or a hash of the key where the token's counter is crowded.
    """

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            yield batch.filter(pa.array((passing[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in pieces(chosen(batches), 3 << 20):
            size, keys, h = _fresh_sets(data, offs)
            slot, owner = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.repeat(keys, size)
            many = crowded[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1
            salt = np.where(many == 1, (owner & 0x7FFF) + 1, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt), pa.array(owner)], ["token", "salt", "key"])

    return run


def _with_counts(most: int):
    """Of (token, salt, key) sorted by token: (key, df, token) of the tokens that several sets hold; df counts to ``most``.

    Rows with a salt are not counted: their df is ``most``.
    """

    def row(token, key, df):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.broadcast_to(df, len(key)).astype(np.int32)), pa.array(token)], ["key", "df", "token"])

    def counted(token, key):
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key = token[new], key[new]
        _, at, n = np.unique(token, return_inverse=True, return_counts=True)
        several = n[at] > 1
        return row(token[several], key[several], np.minimum(n[at][several], most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, flooded = (np.zeros(0, np.int64),) * 2, None
        for batch in batches:
            token, salt, key = (batch.column(c).to_numpy() for c in ("token", "salt", "key"))
            if salt.any():
                yield row(token[salt > 0], key[salt > 0], most)
            token, key = np.append(kept[0], token[salt == 0]), np.append(kept[1], key[salt == 0])
            if not len(token):
                continue
            if flooded is not None:
                more = token == flooded
                yield row(token[more], key[more], most)
                token, key = token[~more], key[~more]
                kept = token, key
                if not len(token):
                    continue
                flooded = None
            done = token != token[-1]
            if done.any():
                yield counted(token[done], key[done])
            last = np.unique(key[~done])
            kept = np.full(len(last), token[-1]), last
            if len(last) >= most:
                yield row(*kept, most)
                kept, flooded = (np.zeros(0, np.int64),) * 2, token[-1]
        if len(kept[0]):
            yield counted(*kept)

    return run


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets from rows (key, df, token, id) sorted by key, df, token; a set's first row has df 0, its size as token and its id.

    Sets with too few shared tokens to link are left out. ``rare``: how many of the tokens, rarest first, belong to the
    prefix, of which the tokens that no other set holds are the first part.
    """
    names, kept = ("key", "df", "token", "id"), None

    def sets(key, df, token, ids):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (token[1:] != token[:-1]) | (df[1:] != df[:-1])
        key, df, token, ids = key[new], df[new], token[new], ids[new]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        to = np.append(head[1:], len(key))
        n = np.where(df[head] == 0, token[head], 0)
        shared = to - head - 1
        take = np.flatnonzero((n > 0) & (DEN * shared >= NUM * n))
        head, to, n, shared = head[take], to[take], n[take], shared[take]
        rare = prefix_length(n) - (n - shared)
        total = np.concatenate([[0.0], np.cumsum(df)])
        typical = (total[to] - total[head]) / n
        blobs = pa.array([token[a + 1 : b].tobytes() for a, b in zip(head, to, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(key[head]), pa.array(ids[head]), pa.array(n), pa.array(rare), pa.array(typical), blobs], ["key", "id", "n", "rare", "typical", "tokens"])

    for batch in batches:
        columns = [batch.column(c).fill_null(0).to_numpy().astype(np.int64) for c in names]
        if kept is not None:
            columns = [np.append(x, c) for x, c in zip(kept, columns, strict=True)]
        if not len(columns[0]):
            continue
        done = columns[0] != columns[0][-1]
        if done.any():
            yield sets(*(c[done] for c in columns))
        kept = [c[~done] for c in columns]
    if kept is not None:
        yield sets(*kept)


def _second_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rare, n, key = (batch.column(c).to_numpy() for c in ("rare", "n", "key"))
        tokens = [np.frombuffer(x.as_py()[: 8 * int(k)], np.uint64) for x, k in zip(batch.column("tokens"), rare, strict=True)]
        yield _postings(np.concatenate([np.zeros(0, np.uint64), *tokens]), np.repeat(n, rare), np.repeat(key, rare))


def _linked(both, n, m):
    return (DEN + NUM) * both >= NUM * (n + m)


def _sorted_sets(column: pa.Array) -> list[np.ndarray]:
    return [np.sort(np.frombuffer(x.as_py(), np.uint64)) for x in column]


def _against_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, bool)
        sides = _sorted_sets(batch.column("tokens")), _sorted_sets(batch.column("leader_tokens"))
        n, m = batch.column("n").to_numpy(), batch.column("leader_n").to_numpy()
        for i, (a, b) in enumerate(zip(*sides, strict=True)):
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            out[i] = _linked(int((b[at] == a).sum()), n[i], m[i])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "block", "leader")), pa.array(out)], ["id", "block", "leader", "linked"])


def overlap_links(left: list[np.ndarray], right: list[np.ndarray], n: np.ndarray, m: np.ndarray, columns: int = COLUMNS) -> np.ndarray:
    """Which of the left sets (of n tokens, those given may be in others) link with which of the right ones: a boolean matrix.

    The incidence matrices over the tokens that both sides have are multiplied ``columns`` tokens at a time; once no
    pair can reach its bound with the tokens that are left, the rest of the product is skipped.
    """
    given = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    a, b = np.concatenate(left), np.concatenate(right)
    vocabulary = np.intersect1d(a, b)
    rows = []
    for flat, sizes in ((a, given[0]), (b, given[1])):
        at = np.minimum(np.searchsorted(vocabulary, flat), max(len(vocabulary) - 1, 0))
        hit = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
        owner = np.repeat(np.arange(len(sizes)), sizes)[hit]
        order = np.argsort(at[hit], kind="stable")
        rows.append((at[hit][order], owner[order], np.bincount(owner, minlength=len(sizes))))
    need = -(-NUM * (n[:, None] + m[None, :]) // (DEN + NUM))
    alive = (DEN * np.minimum(n[:, None], m[None, :]) >= NUM * np.maximum(n[:, None], m[None, :])) & (np.minimum(n[:, None], m[None, :]) > 0)
    both = np.zeros(need.shape, np.float32)
    left_over = [rows[0][2].copy(), rows[1][2].copy()]
    for c in range(0, len(vocabulary), columns):
        alive &= both + np.minimum(left_over[0][:, None], left_over[1][None, :]) >= need
        if not alive.any():
            break
        dense = []
        for i, (at, owner, _) in enumerate(rows):
            lo, hi = np.searchsorted(at, (c, c + columns))
            block = np.zeros((len(left_over[i]), min(columns, len(vocabulary) - c)), np.float32)
            block[owner[lo:hi], at[lo:hi] - c] = 1
            left_over[i] -= np.bincount(owner[lo:hi], minlength=len(left_over[i]))
            dense.append(block)
        both += dense[0] @ dense[1].T
    return alive & (both >= need)


def _tile_links(table: pa.Table) -> pa.Table:
    """Links of a spanning forest among the rows of a tile pair: each linked row with the first that it reaches."""
    side = table.column("side").to_numpy()
    x = np.flatnonzero(side == 0)
    return _forest(table, x, np.flatnonzero(side == 1) if (side == 1).any() else x)


def _small_blocks(table: pa.Table) -> pa.Table:
    """Links (a, b) of a block that fits a tile; the rows of a part of a larger block as they are."""
    members = ("id", "block", "n", "typical", "tokens")
    rows = table.num_rows
    if table.column("parts")[0].as_py() > 1:
        return pa.table({"a": pa.nulls(rows, pa.int64()), "b": pa.nulls(rows, pa.int64())} | {c: table.column(c) for c in members})
    order = sorted(range(rows), key=lambda i: (table.column("typical")[i].as_py(), table.column("n")[i].as_py(), -table.column("id")[i].as_py()))
    table = table.take(order)
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("tokens")]
    a, b = [], []
    if rows > 1:
        linked = overlap_links(sets[-1:], sets[:-1], n[-1:], n[:-1])[0]
        a, b = [ids[:-1][linked]], [np.full(linked.sum(), ids[-1])]
        if rows > 2 and not linked.all():
            found = _forest(table, np.flatnonzero(~linked), np.arange(rows))
            a, b = [*a, found.column("a").to_numpy()], [*b, found.column("b").to_numpy()]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    return pa.table({"a": a, "b": b} | {c: pa.nulls(len(a), table.schema.field(c).type) for c in members})


def _forest(table: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("tokens")]
    linked = np.zeros((len(ids), len(ids)), bool)
    if len(x) and len(y):
        linked[np.ix_(x, y)] = overlap_links([sets[i] for i in x], [sets[i] for i in y], n[x], n[y])
    label = local_components(linked | linked.T)
    far = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table({"a": ids[far], "b": ids[label[far]]})


def _candidate_sets(docs: DataFrame, classes: np.ndarray, sets: DataFrame, at: str) -> DataFrame:
    """Two rounds of prefixes: (key, id, n, rare, typical, tokens) of the sets that may link, with the tokens they share."""
    spark = docs.sparkSession
    # Executors get the broadcast sketch's classes (2 ** SKETCH_BITS bytes) and the filter with the task's function.
    first = docs.filter("doc_id IS NOT NULL").mapInArrow(_first_prefixes(classes), "token long, low int, high int, key long")
    links = first.repartition("token").sortWithinPartitions("token", "low").mapInArrow(_to_first, "a long, b long")
    touched = links.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    heads = written(sets.join(touched, F.col("s1") == F.col("key")).select("key", "id", "n"), f"{at}/heads")

    passing = id_filter(heads.select(F.xxhash64("id").alias("h")))
    crowded = crowded_counters(classes, MOST_COUNTED)
    second = docs.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(_second_tokens(passing, crowded), "token long, salt int, key long")
    counted = second.repartition("token", "salt").sortWithinPartitions("token").mapInArrow(_with_counts(MOST_COUNTED), "key long, df int, token long")
    rows = counted.withColumn("id", F.lit(None).cast("long")).unionByName(heads.select("key", F.lit(0).alias("df"), F.col("n").alias("token"), "id"))
    rows = rows.repartition("key").sortWithinPartitions("key", "df", "token")
    found = rows.mapInArrow(_assembled, "key long, id long, n long, rare long, typical double, tokens binary")
    found.write.parquet(f"{at}/sets")
    return spark.read.parquet(f"{at}/sets")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    at = scratch(spark, "shingles")
    docs.mapInArrow(_signatures, "doc_id long, n_shingles long, s1 long, s2 long, chunk int, counts binary").write.parquet(f"{at}/signatures")
    signed = spark.read.parquet(f"{at}/signatures")
    classes = count_classes(signed.filter("chunk IS NOT NULL").select("chunk", "counts"))

    signed = signed.filter("chunk IS NULL").select("doc_id", "n_shingles", "s1", "s2")
    sets = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"))
    sets = written(sets, f"{at}/classes")
    named = sets.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("id").alias("rep"))
    classed = signed.join(named, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n_shingles") > 0), "left")
    classed = checkpointed(classed.select("doc_id", "n_shingles", "rep"))

    found = _candidate_sets(docs, classes, sets, at)
    postings = found.mapInArrow(_second_prefixes, "token long, low int, high int, key long")
    firsts = postings.repartition("token").sortWithinPartitions("token", "low").mapInArrow(_to_first, "a long, b long").distinct()
    blocks = connected_components(firsts).withColumnRenamed("node", "key")
    members = found.select("key", "id", "n", "typical", "tokens").join(blocks, "key").withColumnRenamed("component", "block")
    parts = members.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_TOKENS)).alias("parts"))
    schema = "a long, b long, id long, block long, n long, typical double, tokens binary"
    dealt = members.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).drop("key")
    # By both columns: dealt by block alone, as after the join, all parts of a large block would meet in one task.
    small = written(dealt.repartition("block", "part").groupBy("block", "part").applyInArrow(_small_blocks, schema), f"{at}/blocks")

    # Blocks larger than a tile: first their most typical member with all others, then tiles.
    members = small.filter("id IS NOT NULL").drop("a", "b")
    leaders = members.groupBy("block").agg(F.max_by(F.struct("id", "n", "tokens"), F.struct("typical", "n", F.negative("id"))).alias("x"))
    leaders = leaders.select("block", F.col("x.id").alias("leader"), F.col("x.n").alias("leader_n"), F.col("x.tokens").alias("leader_tokens"))
    compared = members.select("id", "n", "block", "tokens").join(leaders, "block").filter("id <> leader")
    compared = checkpointed(compared.mapInArrow(_against_leader, "id long, block long, leader long, linked boolean"))
    open_ = compared.filter("NOT linked").select("id", F.lit(True).alias("open")).distinct()
    cell = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)))
    rows = members.join(compared.filter("NOT linked").select("block").distinct(), "block").join(open_, "id", "left")
    rows = rows.select("block", "id", "n", "tokens", F.coalesce("open", F.lit(False)).alias("open"), cell.alias("cell"))
    tiled = tile_pairs(rows, "block", TILE, ("n", TILE_TOKENS)).groupBy("block", "pair").applyInArrow(_tile_links, "a long, b long")
    links = small.filter("a IS NOT NULL").select("a", "b").unionByName(compared.filter("linked").select(F.col("id").alias("a"), F.col("leader").alias("b"))).unionByName(tiled)
    # Rows that repeat a doc_id tie the classes of their texts.
    repeated = classed.filter("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("a")).filter(F.size("a") > 1)
    links = links.unionByName(repeated.select(F.explode("a").alias("a"), "b"))
    components = connected_components(links).withColumnsRenamed({"node": "rep"})
    discard(spark, at)
    out = classed.join(components, "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; rows without links and columns stay as they are."""
    gone = near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_row")).join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti")
    return rows.select("_row.*")
