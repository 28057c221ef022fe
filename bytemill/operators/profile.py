"""Byte profiles of samples: histograms, entropy, moments, counters, sequences, hashes and n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytestats
from ..functions.bytestats import Samples
from ..functions.hexdump import DIALECTS, with_parsed
from ..functions.standins import SQL_BYTES, documents, samples
from ..plans.catalog import query

#: The reference settings: values of a sequence, grams of a vocabulary by n.
LENGTH, TOP = 1024, {1: 256, 2: 1024, 3: 1024}
#: Bytes of a line of a dump.
LINE = 16


def profiles(rows: Samples) -> DataFrame:
    """n_total, n_known, entropy, mean, std, ratios and the 256 counts of each sample."""
    return rows.map(bytestats.profile, bytestats.PROFILE)


_PLAIN = """WITH raw AS (SELECT doc_id, unnest(regexp_extract_all(hex(text), '..')) AS h FROM documents), c AS (SELECT doc_id, h, count(*) AS n FROM raw GROUP BY ALL),
t AS (SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS t, coalesce(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS e FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id)"""


@query("byte_entropy", f"{_PLAIN} SELECT doc_id, round(e, 6) AS entropy, t AS n_bytes FROM t")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(samples(spark, sf_dir, hidden=False)).select("doc_id", F.round("entropy", 6).alias("entropy"), F.col("n_known").alias("n_bytes"))


@query("byte_histogram", f"{_PLAIN} SELECT doc_id, ('0x' || h)::INT AS byte_value, n FROM c")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, byte_value, n of the values that occur."""
    return profiles(samples(spark, sf_dir, hidden=False)).select("doc_id", F.posexplode("counts").alias("byte_value", "n")).filter("n > 0")


_HEX = [f"{v:02x}" for v in range(256)]


@query("byte_frequencies", f"""{_PLAIN}, f AS (SELECT t.doc_id, h, round(n / t, 9) AS f FROM t LEFT JOIN c USING (doc_id))
SELECT doc_id, {", ".join(f"coalesce(max(f) FILTER (h = '{x.upper()}'), 0) AS byte_freq_{x}" for x in _HEX)} FROM f GROUP BY doc_id""")
def byte_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column byte_freq_xx for each of the 256 values."""
    share = lambda v: F.round(F.coalesce(F.try_divide(F.col("counts")[v], F.col("n_known")), F.lit(0.0)), 9)
    return profiles(samples(spark, sf_dir, hidden=False)).select("doc_id", *(share(v).alias(f"byte_freq_{x}") for v, x in enumerate(_HEX)))


_KNOWN = f"WITH {SQL_BYTES}, k AS (SELECT d.doc_id, v FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND v IS NOT NULL)"


@query("byte_moments", f"{_KNOWN} SELECT doc_id, count(v) AS n_known, round(coalesce(avg(v), 0), 6) AS mean, round(coalesce(stddev_pop(v), 0), 5) AS std FROM k GROUP BY doc_id")
def byte_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(samples(spark, sf_dir)).select("doc_id", "n_known", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


@query("byte_class_ratios", f"""{_KNOWN} SELECT doc_id, round(coalesce(avg((v = 0)::INT), 0), 9) AS zero_ratio,
round(coalesce(avg((v BETWEEN 32 AND 126)::INT), 0), 9) AS printable_ratio, round(coalesce(avg((v >= 128)::INT), 0), 9) AS high_ratio FROM k GROUP BY doc_id""")
def byte_class_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = ("zero_ratio", "printable_ratio", "high_ratio")
    return profiles(samples(spark, sf_dir)).select("doc_id", *(F.round(c, 9).alias(c) for c in ratios))


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the dump text of each document, with unknown (``??``) and invalid (``zz``) tokens."""
    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(_render, "doc_id long, dump string")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digits = np.frombuffer(b"0123456789ABCDEF", np.uint8)
    for batch, data, known, offs in bytestats.slices(batches, bytestats.plain_text, "text"):
        n = np.diff(offs)
        column = np.arange(len(data)) - np.repeat(offs[:-1], n)
        place = column + np.repeat(batch.column("doc_id").to_numpy() * 31, n)
        high, low = digits[data >> 4], digits[data & 15]
        high[place % 97 == 1] = low[place % 97 == 1] = ord("z")
        high[place % 17 == 0] = low[place % 17 == 0] = ord("?")
        # A line is an address and a blank, then two digits and a blank for each byte; its last blank is a line feed, but for the text's last line.
        lines = (n + LINE - 1) // LINE
        begin = np.append(0, np.cumsum(9 * lines + 3 * n))
        text = np.full(begin[-1], 32, np.uint8)
        at = np.repeat(begin[:-1], n) + 9 * (column // LINE + 1) + 3 * column
        text[at], text[at + 1] = high, low
        line = np.arange(lines.sum()) - np.repeat(np.cumsum(lines) - lines, lines)
        head = np.repeat(begin[:-1], lines) + line * (9 + 3 * LINE)
        for k in range(8):
            text[head + k] = digits[(0x401000 + LINE * line) >> 4 * (7 - k) & 15]
        text[head[line > 0] - 1] = 10
        ends = np.maximum(begin[1:] - 1, begin[:-1])
        raw = text.tobytes()
        dumps = [raw[a:b] for a, b in zip(begin[:-1], ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(dumps, pa.binary()).cast(pa.string())], ["doc_id", "dump"])


_COUNTS = f"""WITH {SQL_BYTES}, c AS (SELECT d.doc_id, count(b.p) AS n, count(*) FILTER ((b.doc_id * 31 + p) % 17 = 0) AS u,
count(*) FILTER ((b.doc_id * 31 + p) % 17 <> 0 AND (b.doc_id * 31 + p) % 97 = 1) AS i FROM documents d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id)"""


@query("token_counters", f"""{_COUNTS} SELECT doc_id, n::INT AS n_total, (n - u - i)::INT AS n_known, u::INT AS n_unknown, i::INT AS n_invalid,
round(CASE WHEN n = 0 THEN 0 ELSE u / n END, 9) AS unknown_ratio FROM c""")
def token_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_parsed(dumps(spark, sf_dir), "dump", {"x": "extract"}, values=False, keep=False).select("doc_id", "x.n_total", "x.n_known", "x.n_unknown", "x.n_invalid")
    return rows.withColumn("unknown_ratio", F.round(F.coalesce(F.try_divide("n_unknown", "n_total"), F.lit(0.0)), 9))


@query("token_dialects", f"""{_COUNTS}, k AS (SELECT * FROM (VALUES ('profile'), ('extract'), ('train'), ('serve'), ('image')) AS t(dialect))
SELECT doc_id, dialect, (CASE WHEN dialect = 'profile' THEN n - i ELSE n END)::INT AS n_total, (n - u - i)::INT AS n_known, i::INT AS n_invalid,
CASE dialect WHEN 'train' THEN i > 0 OR n - u - i = 0 WHEN 'serve' THEN i > 0 OR n = 0 WHEN 'image' THEN i > 0 OR n = 0 ELSE false END AS rejected FROM c, k""")
def token_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dialects in one pass over the text; only counts leave it."""
    parsed = with_parsed(dumps(spark, sf_dir), "dump", {d: d for d in DIALECTS}, values=False, keep=False)
    counts = [F.struct(F.lit(d).alias("dialect"), f"{d}.n_total", f"{d}.n_known", f"{d}.n_invalid", f"{d}.rejected") for d in DIALECTS]
    return parsed.select("doc_id", F.explode(F.array(*counts)).alias("r")).select("doc_id", "r.*")


def _sequence_sql(keep: str, n: int = LENGTH, pad: int = 0) -> str:
    at = "p" if keep == "head" else f"p - n + {n}"
    return f"""WITH {SQL_BYTES}, n AS (SELECT doc_id, len(x) AS n FROM x),
g AS (SELECT n.doc_id, n.n, i FROM n, (SELECT unnest(range(0, {n})) AS i)),
q AS (SELECT g.doc_id, any_value(g.n) AS n, list(coalesce(v, {pad}) ORDER BY i) AS vs, sum(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END) AS known
      FROM g LEFT JOIN (SELECT b.doc_id, v, {at} AS at FROM b JOIN n USING (doc_id)) y ON y.doc_id = g.doc_id AND y.at = g.i GROUP BY g.doc_id)
SELECT doc_id, array_to_string(vs, ' ') AS sequence, known::INT AS n_known, greatest(0, n - {n})::INT AS n_truncated, greatest(0, {n} - n)::INT AS n_padded FROM q"""


def sequences(rows: Samples, keep: str, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """The first (``keep="head"``) or last (``"tail"``) ``length`` values, padded at the other side."""
    if length < 1 or keep not in ("head", "tail"):
        raise ValueError("a sequence has a positive length and keeps 'head' or 'tail'")
    return rows.map(bytestats.sequence(length, keep, pad), "values array<short>, n_known int, n_truncated int, n_padded int")


def _sequence_query(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    rows = sequences(samples(spark, sf_dir), keep)
    return rows.select("doc_id", F.array_join("values", " ").alias("sequence"), "n_known", "n_truncated", "n_padded")


@query("head_sequence", _sequence_sql("head"))
def head_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequence_query(spark, sf_dir, "head")


@query("tail_sequence", _sequence_sql("tail"))
def tail_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequence_query(spark, sf_dir, "tail")


@query("head_image", f"""WITH {SQL_BYTES}, g AS (SELECT doc_id, i FROM documents, (SELECT unnest(range(0, 1024)) AS i))
SELECT g.doc_id, sha256(unhex(string_agg(lpad(to_hex(coalesce(v, 0)), 2, '0'), '' ORDER BY i))) AS pixel_sha256, count(*) FILTER (b.p IS NOT NULL AND v IS NULL) AS n_unknown,
round(count(*) FILTER (b.p IS NOT NULL AND v IS NULL) / 1024, 9) AS unknown_ratio FROM g LEFT JOIN b ON b.doc_id = g.doc_id AND b.p = i GROUP BY g.doc_id""")
def head_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1024 tokens as a 32 x 32 image, and the share of unknown ones among its places."""
    rows = samples(spark, sf_dir).map(bytestats.head_image(), "pixel binary, n_unknown long")
    return rows.select("doc_id", F.sha2("pixel", 256).alias("pixel_sha256"), "n_unknown", F.round(F.col("n_unknown") / 1024, 9).alias("unknown_ratio"))


@query("content_hashes", """
SELECT doc_id, sha256(text) AS raw_sha256, sha256(lower(hex(text))) AS token_stream_sha256, octet_length(encode(text))::INT AS n_bytes FROM documents
""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.sha2("text", 256).alias("raw_sha256"), F.sha2(F.lower(F.hex("text")), 256).alias("token_stream_sha256"), F.octet_length("text").alias("n_bytes"))


def top_k(counts: DataFrame, k: int, size: int) -> DataFrame:
    """gram, global_count and rank of the ``k`` most frequent grams, ties by gram.

    Where k is 0 or covers all ``size`` grams, all of them, also those that never occur, in index order.
    """
    if k <= 0 or k >= size:
        every = counts.sparkSession.range(size).withColumnRenamed("id", "gram").join(counts, "gram", "left")
        return every.select("gram", F.coalesce("global_count", F.lit(0)).cast("long").alias("global_count"), (F.col("gram") + 1).cast("int").alias("rank"))
    order = F.desc("global_count"), F.asc("gram")
    return counts.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def vocabulary(rows: Samples, n: int, k: int) -> DataFrame:
    return top_k(bytestats.count_grams(rows, n), k, 256**n)


def _gram_hex(n: int) -> Column:
    return F.lpad(F.hex("gram"), 2 * n, "0")


def _gram_sql(n: int) -> str:
    packed = ("v", "(v * 256 + v1)", "((v * 256 + v1) * 256 + v2)")[n - 1]
    ahead = "".join(f", lead(v, {i}) OVER (PARTITION BY doc_id ORDER BY p) AS v{i}" for i in range(1, n))
    return f"w AS (SELECT doc_id, v{ahead} FROM b), g AS (SELECT doc_id, {packed} AS gram FROM w WHERE {packed} IS NOT NULL)"


def _topk_sql(n: int, k: int) -> str:
    if k >= 256**n:
        every = f"SELECT i AS gram, count(g.gram) AS c FROM (SELECT unnest(range(0, {256**n}))::INT AS i) LEFT JOIN g ON g.gram = i GROUP BY 1"
        return f"WITH {SQL_BYTES}, {_gram_sql(n)}, e AS ({every}) SELECT (gram + 1)::INT AS rank, lpad(upper(to_hex(gram)), {2 * n}, '0') AS gram, c AS global_count FROM e"
    return f"""WITH {SQL_BYTES}, {_gram_sql(n)}, e AS (SELECT gram, count(*) AS c FROM g GROUP BY 1)
SELECT row_number() OVER (ORDER BY c DESC, gram)::INT AS rank, lpad(upper(to_hex(gram)), {2 * n}, '0') AS gram, c AS global_count FROM e ORDER BY c DESC, gram LIMIT {k}"""


def _register_topk(n: int, k: int) -> None:
    @query(f"ngram{n}_topk", _topk_sql(n, k))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vocabulary(samples(spark, sf_dir), n, k).select("rank", _gram_hex(n).alias("gram"), "global_count")


for _n, _k in TOP.items():
    _register_topk(_n, _k)


def selected_ngrams(rows: Samples, grams: list[int], n: int) -> DataFrame:
    """total (all valid windows), counts and shares of the chosen grams, in ascending order of the grams."""
    counted = rows.map(bytestats.selected_grams(np.array(grams, np.int64), n), "total long, counts array<long>")
    return counted.withColumn("shares", F.transform("counts", lambda c: F.coalesce(F.try_divide(c, F.col("total")), F.lit(0.0))))


@query("ngram_selected_freq", f"""WITH {SQL_BYTES}, {_gram_sql(2)}, top AS (SELECT gram FROM g GROUP BY gram ORDER BY count(*) DESC, gram LIMIT {TOP[2]}),
t AS (SELECT d.doc_id, count(gram) AS total FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id), c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, any_value(total) AS total, string_agg(coalesce(n, 0)::VARCHAR, ' ' ORDER BY gram) AS counts, coalesce(sum(n), 0)::BIGINT AS n_selected,
round(coalesce(sum(n) / nullif(any_value(total), 0), 0), 9) AS share FROM (SELECT * FROM t, top) LEFT JOIN c USING (doc_id, gram) GROUP BY doc_id""")
def ngram_selected_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample's counts of the 1,024 most frequent bigrams, columns in ascending gram order; the vocabulary comes to the driver (k rows)."""
    rows = samples(spark, sf_dir)
    chosen = [r.gram for r in vocabulary(rows, 2, TOP[2]).select("gram").collect()]
    out = selected_ngrams(rows, chosen, 2)
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    share = F.round(F.coalesce(F.try_divide(n, F.col("total")), F.lit(0.0)), 9)
    return out.select("doc_id", "total", F.array_join(F.col("counts").cast("array<string>"), " ").alias("counts"), n.alias("n_selected"), share.alias("share"))


def grids(rows: Samples, side: int = 32) -> DataFrame:
    """n, n_known, pixel and mask of the equal-position bins of each sample, with their sums."""
    return rows.map(bytestats.grid(side), bytestats.GRID)


SQL_GRID = f"""{SQL_BYTES}, n AS (SELECT doc_id, len(x) AS n FROM x),
bin AS (SELECT b.doc_id, ((p + 1) * 1024 - 1) // n.n AS j, count(*) AS n, count(v) AS k, coalesce(sum(v), 0) AS t FROM b JOIN n USING (doc_id) GROUP BY 1, 2),
cell AS (SELECT n.doc_id, j, coalesce(bin.n, 0)::BIGINT AS n, coalesce(k, 0)::BIGINT AS k, CASE WHEN coalesce(k, 0) > 0 THEN (t + k // 2) // k ELSE 0 END::BIGINT AS pixel,
         CASE WHEN coalesce(bin.n, 0) > 0 THEN (255 * (bin.n - k) + bin.n // 2) // bin.n ELSE 255 END::BIGINT AS mask
         FROM n CROSS JOIN (SELECT unnest(range(0, 1024)) AS j) LEFT JOIN bin USING (doc_id, j))"""


def _grid_sql(field: str) -> str:
    return f"""WITH {SQL_GRID} SELECT doc_id, sha256(unhex(string_agg(lpad(to_hex({field}), 2, '0'), '' ORDER BY j))) AS {field}_sha256, sum({field})::BIGINT AS {field}_sum FROM cell GROUP BY doc_id"""


def _grid_query(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return grids(samples(spark, sf_dir)).select("doc_id", F.sha2(field, 256).alias(f"{field}_sha256"), F.col(f"sum_{field}").alias(f"{field}_sum"))


@query("grid_pixels", _grid_sql("pixel"))
def grid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_query(spark, sf_dir, "pixel")


@query("grid_mask", _grid_sql("mask"))
def grid_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_query(spark, sf_dir, "mask")


@query("grid_bin_stats", f"""WITH {SQL_GRID} SELECT doc_id, sum(n)::INT AS n_tokens, min(n)::INT AS min_bin, max(n)::INT AS max_bin,
count(*) FILTER (n = 0)::INT AS n_empty, count(*) FILTER (k < n)::INT AS n_with_unknown FROM cell GROUP BY doc_id""")
def grid_bin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grids(samples(spark, sf_dir))
    mixed = F.size(F.filter(F.zip_with("n", "n_known", lambda n, k: n > k), lambda x: x))
    return g.select(
        "doc_id", F.aggregate("n", F.lit(0), lambda a, x: a + x).alias("n_tokens"), F.array_min("n").alias("min_bin"), F.array_max("n").alias("max_bin"),
        F.size(F.filter("n", lambda n: n == 0)).alias("n_empty"), mixed.alias("n_with_unknown"),
    )


@query("pixel_moments", f"""WITH {SQL_GRID} SELECT (doc_id % 9 + 1)::INT AS class, count(*) AS n_pixels, round(sum(pixel) / count(*), 6) AS mean,
round(sqrt(greatest(0, sum(pixel * pixel) / count(*) - (sum(pixel) / count(*)) ** 2)), 5) AS std, round(count(*) FILTER (pixel = 0) / count(*), 9) AS zero_ratio FROM cell GROUP BY 1""")
def pixel_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population deviation and share of zeros of each class's pixels, from sums taken per sample first."""
    per = grids(samples(spark, sf_dir)).select("class", "sum_pixel", "sum_square", "n_zero")
    g = per.groupBy("class").agg((F.count("*") * 1024).alias("n_pixels"), F.sum("sum_pixel").alias("t"), F.sum("sum_square").alias("q"), F.sum("n_zero").alias("z"))
    mean = F.col("t") / F.col("n_pixels")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n_pixels") - mean * mean))
    return g.select("class", "n_pixels", F.round(mean, 6).alias("mean"), F.round(std, 5).alias("std"), F.round(F.col("z") / F.col("n_pixels"), 9).alias("zero_ratio"))
