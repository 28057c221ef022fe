"""Ranked lexical search over a clustered index.

The index is built in blocks, each from the documents of one task, so that all rows are indexed without a shuffle.
Recursive graph bisection orders a block's documents: a half is split in two again and again, and pairs of documents
change sides as long as the terms' gaps get cheaper to write, so documents that share terms stand together. Every
CLUSTER documents in this order are a cluster. A block holds, for each term, its runs (one for each cluster with the
term: most occurrences, fewest terms of a document) and its postings.

A search takes items in blocks of bounded size. The first pass over the index sums the statistics that the items' terms
need. The second scores, for each block and item, the cluster with the highest bound; the k-th best of these scores is a
floor of what the answer needs. The third visits clusters by falling bound and stops once the bound is below the floor
or the k-th score at hand; a bound that equals it is still visited, since ties go to the smaller doc_id. So the answer
is exact whatever the order of the documents is.

Terms are told apart by 64-bit hashes. Null and empty texts hold no terms and are in no answer, and items without terms
have none. Every row is a document and every row an item, also where ids repeat; null ids stand before others. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import block_hashes, discard, folded, lowered, pieces, scratch, word_spans, written

K = 20
#: Documents of a cluster; terms and documents of a block, at about which it is closed; steps of a bisection.
CLUSTER, BLOCK_TERMS, BLOCK_DOCS, STEPS = 64, 400_000, 16_384, 6
#: Different terms of the items that are searched at a time, about.
ITEM_TERMS = 200_000
# What stands between terms.
IS_BREAK = np.zeros(256, bool)
IS_BREAK[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_BLOCK = {"ids": "<i8", "known": "u1", "sizes": "<i8", "terms": "<u8", "term_runs": "<u4", "run_cluster": "<u4", "run_tf": "<u4", "run_size": "<i8", "run_posts": "<u4", "post_doc": "<u4", "post_tf": "<u4"}
#: Lengths in the file, since these compress well; running sums once read.
_SUMS = ("term_runs", "run_posts")
#: A row group for each block, so that neither writing nor reading holds more than one.
_GROUPS = {"parquet.block.size": "1048576", "parquet.page.size.row.check.min": "1"}
_BLOCK_SQL = ", ".join(f"{c} binary" for c in _BLOCK)


def bisected(docs: np.ndarray, terms: np.ndarray, n: int, leaf: int = CLUSTER, steps: int = STEPS) -> np.ndarray:
    """The place of each of ``n`` documents after recursive graph bisection of the pairs (document, term).

    All parts of a level are bisected at once. A term in d1 documents of one half and d2 of the other costs
    d1 log(n1 / (d1 + 1)) + d2 log(n2 / (d2 + 1)); the documents of each half are sorted by what their move would save,
    and pairs of equal rank change sides while they save something together.
    """
    place = np.arange(n)
    often = np.bincount(terms)
    useful = (often[terms] > 1) & (often[terms] < n) if len(terms) else np.zeros(0, bool)
    docs, terms = docs[useful], terms[useful]
    logs = np.arange(n + 2) * np.log2(np.arange(n + 2) + 1.0)
    growth = np.diff(logs, prepend=0.0)
    for level in range(max(0, math.ceil(math.log2(max(1, n) / leaf)))):
        part = (place << level) // n
        key = part[docs] * (int(terms.max(initial=0)) + 1) + terms
        present = np.zeros(int(key.max(initial=0)) + 1, bool)
        present[key] = True
        key = (np.cumsum(present) - 1)[key]
        total = np.bincount(key)
        for _ in range(steps):
            half = (place << (level + 1)) // n
            side = half & 1
            sizes = np.bincount(half, minlength=2 << level)
            left = np.bincount(key[side[docs] == 0], minlength=len(total))
            right = total - left
            saves = np.where(side[docs] == 0, growth[right[key] + 1] - growth[left[key]], growth[left[key] + 1] - growth[right[key]])
            rest = np.log2(np.maximum(sizes, 1.0)).reshape(-1, 2)
            saves += np.where(side[docs] == 0, 1.0, -1.0) * (rest[:, 0] - rest[:, 1])[part[docs]]
            gain = np.bincount(docs, saves, n)
            order = np.lexsort((-gain, half))
            begin = np.cumsum(sizes) - sizes
            rank = np.arange(n) - begin[half[order]]
            here = (side[order] == 0) & (rank < sizes[half[order] + (side[order] == 0)])
            a = order[here]
            b = order[begin[half[a] + 1] + rank[here]]
            moved = gain[a] + gain[b] > 0
            place[a[moved]], place[b[moved]] = place[b[moved]], place[a[moved]]
            if 100 * moved.sum() < n:
                break
    return place


def _block(ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, docs: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """One row of the index from the (document, term) pairs of a block; documents without terms are left out."""
    full = sizes > 0
    docs = (np.cumsum(full) - 1)[docs]
    ids, known, sizes = ids[full], known[full], sizes[full]
    n = len(ids)
    terms, code = np.unique(hashes, return_inverse=True)
    pairs, tf = np.unique(code * n + docs, return_counts=True)
    code, docs = pairs // n, pairs % n
    place = bisected(docs, code, n)
    order = np.argsort(place)
    sorting = np.argsort(code * n + place[docs])
    code, docs, tf = code[sorting], place[docs][sorting], tf[sorting]
    ids, known, sizes = ids[order], known[order], sizes[order]
    cluster = docs // CLUSTER
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (cluster[1:] != cluster[:-1])
    runs = np.flatnonzero(fresh)
    made = {
        "ids": ids, "known": known, "sizes": sizes, "terms": terms, "term_runs": np.bincount(code[runs], minlength=len(terms)),
        "run_cluster": cluster[runs], "run_tf": np.maximum.reduceat(tf, runs), "run_size": np.minimum.reduceat(sizes[docs], runs),
        "run_posts": np.diff(runs, append=len(docs)), "post_doc": docs, "post_tf": tf,
    }
    return pa.RecordBatch.from_arrays([pa.array([made[c].astype(t).tobytes()], pa.binary()) for c, t in _BLOCK.items()], list(_BLOCK))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    n_docs = n_terms = 0
    for part, data, offs in pieces(batches):
        starts, ends, rows = word_spans(data, offs, IS_BREAK)
        column = part.column("doc_id")
        known = column.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.bincount(rows, minlength=len(offs) - 1)
        held.append((column.fill_null(0).to_numpy(), known, sizes, (rows + n_docs).astype(np.int32), block_hashes(lowered(data), starts, ends)))
        n_docs, n_terms = n_docs + part.num_rows, n_terms + len(rows)
        if n_docs >= BLOCK_DOCS or n_terms >= BLOCK_TERMS:
            if n_terms:
                yield _block(*map(np.concatenate, zip(*held, strict=True)))
            held, n_docs, n_terms = [], 0, 0
    if n_terms:
        yield _block(*map(np.concatenate, zip(*held, strict=True)))


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """The index of all rows (doc_id, text), a row for each block, written to ``path`` and read again."""
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_indexed, _BLOCK_SQL).write.options(**_GROUPS).parquet(path)
    return docs.sparkSession.read.schema(_BLOCK_SQL).parquet(path)


class Items:
    """Some items, as all tasks get them: the different terms, and each item's terms and how often it has them."""

    def __init__(self, rows: list):
        self.keys = [r.key for r in rows]
        hashes = [np.frombuffer(r.hashes, "<u8") for r in rows]
        self.terms = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        self.parts = [(np.searchsorted(self.terms, h), np.frombuffer(r.counts, "<i8")) for h, r in zip(hashes, rows, strict=True)]
        self.weights = np.zeros(len(self.terms), np.int64)
        self.n_docs = self.n_terms = 0
        self.floors = np.zeros(len(rows), np.int64)

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def impact(self, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        tf, n = tf.astype(np.int64), sizes.astype(np.int64)
        if 25 * self.n_docs * int(n.max(initial=0)) >= 1 << 63:
            n = n.astype(object)
        m = 75 + (25 * n * self.n_docs) // self.n_terms
        return ((1_000_000_000 * tf) // (1000 * tf + 12 * m)).astype(np.int64)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in pieces(batches):
        starts, ends, rows = word_spans(data, offs, IS_BREAK)
        hashes = block_hashes(lowered(data), starts, ends)
        cuts = np.searchsorted(rows, np.arange(len(offs)))
        each = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = [pa.array([h.astype("<u8").tobytes() for h, _ in each], pa.binary()), pa.array([n.astype("<i8").tobytes() for _, n in each], pa.binary()), pa.array([len(h) for h, _ in each], pa.int64())]
        yield pa.RecordBatch.from_arrays([part.column("item_id"), *columns], ["item_id", "hashes", "counts", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = {c: np.frombuffer(batch.column(c)[i].as_buffer(), _BLOCK[c]) for c in batch.schema.names}
            yield block | {c: np.append(0, np.cumsum(block[c], dtype=np.int64)) for c in _SUMS}


def _found(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted term stands among a block's, -1 where it doesn't."""
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


_STATISTICS = "n_docs long, n_terms long, df binary"


def _statistics(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        df = np.zeros(len(terms), np.int64)
        for b in _blocks(batches):
            n_docs, n_terms = n_docs + len(b["sizes"]), n_terms + int(b["sizes"].sum())
            at = _found(b["terms"], terms)
            here = at >= 0
            df[here] += np.diff(b["run_posts"][b["term_runs"]])[at[here]]
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms]), pa.array([df.tobytes()], pa.binary())], ["n_docs", "n_terms", "df"])

    return run


def _sum_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for r in batch.to_pylist():
            new = [r["n_docs"], r["n_terms"], np.frombuffer(r["df"], np.int64)]
            total = new if total is None else [a + b for a, b in zip(total, new, strict=True)]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1]]), pa.array([total[2].tobytes()], pa.binary())], ["n_docs", "n_terms", "df"])


def _stretches(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all stretches start .. end - 1, one after the other, and which stretch each belongs to."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n), owner


class Best:
    """The k best (score, known, doc_id) of each item seen by a task."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [np.zeros((3, 0), np.int64)] * n

    def last(self, i: int) -> int:
        """The k-th score; 1 while there are fewer, since scores must be above 0."""
        return int(self.rows[i][0, -1]) if self.rows[i].shape[1] == self.k else 1

    def add(self, i: int, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        all_ = np.concatenate([self.rows[i], np.stack([score, known.astype(np.int64), ids])], axis=1)
        self.rows[i] = all_[:, np.lexsort((all_[2], all_[1], -all_[0]))[: self.k]]


def _visit(b: dict[str, np.ndarray], items: Items, best: Best, waves: int | None) -> None:
    """Score clusters of a block by falling bound, one, then two more, then four ..., until no other can reach the k best.

    With ``waves`` only so many of these steps are made.
    """
    at = _found(b["terms"], items.terms)
    term_runs, run_posts = b["term_runs"], b["run_posts"]
    n_clusters = -(-len(b["ids"]) // CLUSTER)
    for i, (codes, counts) in enumerate(items.parts):
        here = at[codes] >= 0
        if not here.any():
            continue
        term, weight = at[codes[here]], counts[here] * items.weights[codes[here]]
        runs, owner = _stretches(term_runs[term], term_runs[term + 1])
        cluster, weight = b["run_cluster"][runs].astype(np.int64), weight[owner]
        bound = np.zeros(n_clusters, np.int64)
        np.add.at(bound, cluster, weight * items.impact(b["run_tf"][runs], b["run_size"][runs]))
        order = np.argsort(-bound, kind="stable")
        done, wave = 0, 1
        while done < n_clusters and bound[order[done]] >= max(items.floors[i], best.last(i)):
            visited = np.zeros(n_clusters, bool)
            visited[order[done : done + wave]] = True
            mine = visited[cluster]
            posts, owner = _stretches(run_posts[runs[mine]], run_posts[runs[mine] + 1])
            docs = b["post_doc"][posts].astype(np.int64)
            some, back = np.unique(docs, return_inverse=True)
            score = np.zeros(len(some), np.int64)
            np.add.at(score, back, weight[mine][owner] * items.impact(b["post_tf"][posts], b["sizes"][docs]))
            good = score >= max(items.floors[i], best.last(i))
            best.add(i, score[good], b["known"][some[good]], b["ids"][some[good]])
            done, wave = done + wave, 2 * wave
            if waves is not None and wave >= 1 << waves:
                break


def _floors(sent, k: int):
    """Each task's k best scores of each item, from the best cluster of each of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best = Best(len(items.parts), k)
        for b in _blocks(batches):
            _visit(b, items, best, 1)
        scores = np.zeros((len(items.parts), k), np.int64)
        for i, rows in enumerate(best.rows):
            scores[i, : rows.shape[1]] = rows[0]
        yield pa.RecordBatch.from_arrays([pa.array([scores.tobytes()], pa.binary())], ["scores"])

    return run


def _best_scores(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            for blob in batch.column("scores"):
                new = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, k)
                have = new if have is None else -np.sort(-np.concatenate([have, new], axis=1), axis=1)[:, :k]
        if have is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(have).tobytes()], pa.binary())], ["scores"])

    return run


def _answers(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best = Best(len(items.parts), k)
        for b in _blocks(batches):
            _visit(b, items, best, None)
        for key, rows in zip(items.keys, best.rows, strict=True):
            if rows.shape[1]:
                ids = pa.array(rows[2], pa.int64(), mask=rows[1] == 0)
                yield pa.RecordBatch.from_arrays([pa.array([key] * rows.shape[1], pa.int64()), ids, pa.array(rows[0])], ["key", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = K, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item (item_id, text), from an index."""
    spark: SparkSession = index.sparkSession
    at = scratch(spark, "search")
    terms = items.select(F.col("item_id").cast("long"), "text").mapInArrow(_item_terms, "item_id long, hashes binary, counts binary, n long")
    terms = written(terms.withColumn("key", F.monotonically_increasing_id()), f"{at}/items")
    blocks = max(1, math.ceil((terms.agg(F.sum("n")).first()[0] or 0) / item_terms))
    made = []
    for block in range(blocks):
        some = Items(terms.filter("n > 0").filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).drop("item_id", "n").orderBy("key").collect())
        found = folded(index.select("sizes", "terms", "term_runs", "run_posts").mapInArrow(_statistics(some.terms), _STATISTICS), _sum_statistics).first()
        if not found or not found.n_docs or not len(some.terms):
            continue
        some.weigh(found.n_docs, found.n_terms, np.frombuffer(found.df, np.int64))
        scores = folded(index.mapInArrow(_floors(spark.sparkContext.broadcast(some), k), "scores binary"), _best_scores(k)).first()
        some.floors = np.maximum(1, np.frombuffer(scores.scores, np.int64).reshape(-1, k)[:, -1])
        made.append(index.mapInArrow(_answers(spark.sparkContext.broadcast(some), k), "key long, doc_id long, score long"))
    if not made:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = made[0]
    for more in made[1:]:
        best = best.unionByName(more)
    # Each task gives k rows of an item at most; they meet in parts first.
    best = best.withColumn("part", F.spark_partition_id() % 64)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    for by in (["key", "part"], ["key"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return best.join(terms.select("key", "item_id"), "key").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``search`` over an index that is built for it, and deleted again."""
    spark = docs.sparkSession
    at = scratch(spark, "lexical")
    out = written(search(build_index(docs, f"{at}/index"), items, k), f"{at}-answers")
    discard(spark, at)
    return out
