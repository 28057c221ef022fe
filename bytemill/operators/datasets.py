"""Datasets on their way to training: seeded batches, limited records, source digests, dump expectations and vectors of fixed size."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hexdump import with_parsed
from ..functions.ranking import numbered, ranked
from ..functions.standins import SQL_BYTES, SQL_SPLITS, documents, splits
from ..plans.catalog import query, table
from ..sources.files import stored
from .profile import dumps
from .verification import normalize_bool

BATCH = 32


def batches(rows: DataFrame, id_col: str, class_col: str, size: int = BATCH, seed: int | None = None) -> DataFrame:
    """``rows`` with label (class - 1) and batch numbers from 0: in the order of a seeded hash of the id, or of the id's
    text without a seed. Ranks come from counts of hash prefixes, or of ranges that Spark samples; no task holds all rows."""
    name = F.col(id_col).cast("string")
    if seed is None:
        placed = numbered(rows.withColumn("order_", name), ["order_"])
    else:
        placed = ranked(rows.withColumn("order_", F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)), [], F.substring("order_", 1, 3), ["order_"])
    out = placed.withColumns({"label": F.col(class_col) - 1, "batch": F.floor((F.col("rank") - 1) / size)})
    return out.drop("order_", "rank", "n_group")


#: A prime below 2 ** 31, so that products of two numbers below it fit 64 bits; rounds of a permutation; steps of a walk.
PRIME, ROUNDS, WALK = 2147483647, 4, 40


def epoch_keys(seed: int, epoch: int) -> list[tuple[int, int, int]]:
    """The numbers of each round of an epoch's permutation."""
    digits = [int.from_bytes(hashlib.sha256(f"{seed}:{epoch}:{r}:{k}".encode()).digest()[:4], "big") % (PRIME - 1) + 1 for r in range(ROUNDS) for k in range(3)]
    return [tuple(digits[3 * r : 3 * r + 3]) for r in range(ROUNDS)]


def epoch_place(number: Column, n: int, seed: int, epoch: int) -> Column:
    """Where row ``number`` (0 .. n - 1) stands in an epoch: a keyed permutation, by arithmetic on the row alone.

    Two halves of the number are mixed in turns (a Feistel network over a * b >= n places); what falls on n or beyond,
    one in sqrt(n) at most, is mixed again until it doesn't. A number outside 0 .. n - 1 raises.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    keys = epoch_keys(seed, epoch)

    def mixed(x: Column) -> Column:
        long = lambda v: F.lit(v).cast("long")
        low = F.pmod(x, long(b))
        halves = F.struct(F.floor((x - low) / b).cast("long").alias("l"), low.alias("r"))  # exact below 2 ** 53 rows
        rounds = F.array(*(F.struct(long(p).alias("p"), long(q).alias("q"), long(s).alias("s"), F.lit(i % 2 == 0).alias("left")) for i, (p, q, s) in enumerate(keys)))

        def turn(h: Column, k: Column) -> Column:
            half = F.pmod(F.when(k["left"], h["r"]).otherwise(h["l"]), long(PRIME))
            f = F.pmod(F.pmod(half * half, long(PRIME)) * k["p"] + half * k["q"] + k["s"], long(PRIME))
            return F.struct(F.when(k["left"], F.pmod(h["l"] + f, long(a))).otherwise(h["l"]).alias("l"), F.when(k["left"], h["r"]).otherwise(F.pmod(h["r"] + f, long(b))).alias("r"))

        return F.aggregate(rounds, halves, turn, lambda h: h["l"] * b + h["r"])

    inside = F.when(number.between(0, n - 1), number.cast("long")).otherwise(F.raise_error(F.lit("a row number from 0 to n - 1 is expected")).cast("long"))
    steps = F.sequence(F.lit(1), F.lit(min(WALK, a)))
    found = F.aggregate(steps, mixed(inside), lambda x, _: F.when(x < n, x).otherwise(mixed(x)))
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("a walk of the permutation was too long")).cast("long"))


def row_numbers(rows: DataFrame) -> tuple[DataFrame, int]:
    """A table of Parquet files with ``number``, 0 .. n - 1 in the order of files and their rows, and n.

    Only the files' lengths are gathered; no row is moved. One row for each file comes to the driver and goes to all tasks.
    """
    spark = rows.sparkSession
    placed = rows.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("index_"))
    lengths = placed.groupBy("file_").agg((F.max("index_") + 1).alias("n")).orderBy("file_").collect()
    before, begins = 0, []
    for r in lengths:
        begins.append((r.file_, before))
        before += r.n
    begins = spark.createDataFrame(begins, "file_ string, begin_ long")
    return placed.join(F.broadcast(begins), "file_").withColumn("number", F.col("begin_") + F.col("index_")).drop("file_", "index_", "begin_"), before


def epoch_batches(rows: DataFrame, number: str, n: int, size: int = BATCH, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``rows`` with place and batch in an epoch: another order for each epoch, without a sort or a shuffle."""
    return rows.withColumn("place", epoch_place(F.col(number), n, seed, epoch)).withColumn("batch", F.floor(F.col("place") / size))


def _epoch_sql(epoch: int, seed: int) -> str:
    f = lambda half, k: f"(((({half} % {PRIME}) * ({half} % {PRIME})) % {PRIME}) * {k[0]} + ({half} % {PRIME}) * {k[1]} + {k[2]}) % {PRIME}"
    k = epoch_keys(seed, epoch)
    mixed = f"""SELECT doc_id, n, a, b, l2 * b + r2 AS x FROM (SELECT *, (r1 + {f('l2', k[3])}) % b AS r2 FROM (SELECT *, (l1 + {f('r1', k[2])}) % a AS l2 FROM
      (SELECT *, (r0 + {f('l1', k[1])}) % b AS r1 FROM (SELECT *, (l0 + {f('r0', k[0])}) % a AS l1 FROM (SELECT doc_id, n, a, b, x // b AS l0, x % b AS r0 FROM"""
    return f"""w{epoch} AS ({mixed} d))))) UNION ALL {mixed} w{epoch} WHERE x >= n))))))"""


@query("epoch_batches", f"""WITH RECURSIVE d0 AS (SELECT doc_id, doc_id AS x, (SELECT max(doc_id) + 1 FROM documents) AS n FROM documents), d1 AS (SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM d0), d AS (SELECT *, (n + a - 1) // a AS b FROM d1),
{_epoch_sql(0, 11)}, {_epoch_sql(1, 11)}
SELECT 0 AS epoch, doc_id, x AS place, x // 32 AS batch FROM w0 WHERE x < n UNION ALL SELECT 1, doc_id, x, x // 32 FROM w1 WHERE x < n""")
def epoch_batches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two epochs; the id is the row number."""
    d = documents(spark, sf_dir).select("doc_id")
    n = (d.agg(F.max("doc_id")).first()[0] or 0) + 1
    each = [epoch_batches(d, "doc_id", n, seed=11, epoch=e).select(F.lit(e).alias("epoch"), "doc_id", "place", "batch") for e in (0, 1)]
    return each[0].unionByName(each[1])


@query("dataset_batches", f"""WITH {SQL_SPLITS}, o AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || doc_id)) AS r FROM s WHERE split = 'train')
SELECT doc_id, class - 1 AS label, (r - 1) // 32 AS batch FROM o""")
def dataset_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training split, shuffled by seed, in batches of 32."""
    train = splits(spark, sf_dir).filter("split = 'train'").drop("split")
    return batches(train, "doc_id", "class", seed=7).select("doc_id", "label", "batch")


def limited(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first rows in the order of a column (all without a limit): a top-n, not a sort of everything."""
    return rows if most is None else rows.orderBy(order).limit(most)


@query("limited_records", f"WITH {SQL_SPLITS} SELECT doc_id, class, split FROM s ORDER BY doc_id::VARCHAR LIMIT 50")
def limited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    return limited(rows, "id", 50).drop("id")


def evidence(rows: DataFrame, wrong: Column, key: str, most: int = 5) -> DataFrame:
    """How many rows are wrong, and the first few of them by key."""
    found = rows.filter(wrong)
    few = found.select(F.col(key).cast("string").alias("k")).orderBy("k").limit(most).agg(F.array_sort(F.collect_list("k")).alias("examples"))
    return found.agg(F.count("*").alias("n")).crossJoin(F.broadcast(few))  # one row with one row


@query("limited_evidence", "WITH w AS (SELECT doc_id::VARCHAR AS k FROM documents WHERE length(text) % 7 = 0) SELECT (SELECT count(*) FROM w) AS n, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT k FROM w ORDER BY k LIMIT 5)) AS examples")
def limited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence(documents(spark, sf_dir), F.char_length("text") % 7 == 0, "doc_id")
    return out.withColumn("examples", F.array_join("examples", ","))


def check_sources(rows: DataFrame, content: str, pinned: DataFrame, key: str) -> DataFrame:
    """The digest of each pinned source against the pinned one: matches is false where it differs or the source is missing."""
    found = rows.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    both = pinned.join(found, key, "left")
    return both.select(key, "sha256", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)).alias("matches"))


@query("source_check", """WITH p AS (SELECT item_id AS doc_id, CASE WHEN item_id % 3 = 0 THEN 'other' END AS e FROM benchmark)
SELECT p.doc_id, CASE WHEN d.doc_id IS NOT NULL THEN sha256(text) END AS sha256, d.doc_id IS NOT NULL AND e IS NULL AS matches FROM p LEFT JOIN documents d ON d.doc_id = p.doc_id""")
def source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named by the benchmark's ids, pinned to their digests; every third pin is a wrong one."""
    d = documents(spark, sf_dir)
    true = d.select("doc_id", F.sha2("text", 256).alias("t"))
    pinned = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")).join(true, "doc_id", "left")
    return check_sources(d, "text", pinned.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("t")).alias("expected")), "doc_id")


#: Digests that a manifest may expect of a dump: of its text, of its tokens set end to end in capitals, and of its bytes with 0 for unknown ones.
DIGESTS = ("raw_sha256", "token_sha256", "normalized_sha256")


def dump_digests(dump: str) -> dict[str, Column]:
    """The digests of a dump column; the last is null where the tokens are no bytes."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(dump, "\r\n", "\n"), r"(?m)^[0-9a-fA-F]{8}[ \t]+", ""), r"[ \t\n\r\x0B\f]+", "")
    tokens = F.upper(bare)
    return {"raw_sha256": F.sha2(dump, 256), "token_sha256": F.sha2(tokens, 256), "normalized_sha256": F.sha2(F.unhex(F.replace(tokens, F.lit("??"), F.lit("00"))), 256)}


def parse_expected(rows: DataFrame, dump: str, manifest: DataFrame, key: str, expected: Mapping[str, str]) -> DataFrame:
    """Dumps parsed by the image dialect, and whether their counts and digests are those that a manifest expects (name of the
    count or of one of DIGESTS: the manifest's column). Counts and digests are joined with the manifest, never the dumps."""
    digests = {name: digest for name, digest in dump_digests(dump).items() if name in expected}
    found = with_parsed(rows.withColumns(digests), dump, {"parsed": "image"}, values=False, keep=False)
    ok = ~F.col("parsed.rejected")
    for name, column in expected.items():
        ok = ok & F.coalesce(F.col(name if name in DIGESTS else f"parsed.{name}") == F.col(column), F.lit(False))
    return found.join(manifest, key).withColumn("as_expected", ok)


_DUMP_SQL = f"""{SQL_BYTES}, tk AS (SELECT doc_id, p, CASE WHEN (doc_id * 31 + p) % 17 = 0 THEN '??' WHEN (doc_id * 31 + p) % 97 = 1 THEN 'zz' ELSE h END AS t FROM b),
ln AS (SELECT doc_id, l, lpad(to_hex(4198400 + l * 16), 8, '0') || ' ' || string_agg(t, ' ' ORDER BY p) AS line FROM (SELECT *, p // 16 AS l FROM tk) GROUP BY doc_id, l),
rw AS (SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l), '') AS raw FROM documents d LEFT JOIN ln USING (doc_id) GROUP BY d.doc_id),
ts AS (SELECT d.doc_id, coalesce(string_agg(upper(t), '' ORDER BY p), '') AS tokens, count(t) AS n, count(*) FILTER (t = '??') AS u, count(*) FILTER (t = 'zz') AS i FROM documents d LEFT JOIN tk USING (doc_id) GROUP BY d.doc_id)"""


@query("dump_expectations", f"""WITH {_DUMP_SQL} SELECT doc_id, n::INT AS n_total, u::INT AS n_unknown, i = 0 AND n > 0 AND doc_id % 4 <> 1 AS as_expected FROM ts""")
def dump_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth expectation is off by one."""
    sized = documents(spark, sf_dir).select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0)).alias("tokens"))
    rows = parse_expected(dumps(spark, sf_dir), "dump", sized, "doc_id", {"n_total": "tokens"})
    return rows.select("doc_id", "parsed.n_total", "parsed.n_unknown", "as_expected")


@query("dump_digests", f"""WITH {_DUMP_SQL} SELECT doc_id, sha256(raw) AS raw_sha256, sha256(tokens) AS token_sha256, CASE WHEN i = 0 THEN sha256(unhex(replace(tokens, '??', '00'))) END AS normalized_sha256,
i = 0 AND n > 0 AND doc_id % 5 NOT IN (1, 2, 3) AS as_expected FROM ts JOIN rw USING (doc_id)""")
def dump_digests_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps against three digests of a stored manifest, of each of which some are wrong."""
    digests = dump_digests("dump")
    found = dumps(spark, sf_dir)
    wrong = {name: F.when(F.col("doc_id") % 5 == k, "0").otherwise(digests[name]).alias(f"expected_{name}") for k, name in enumerate(DIGESTS, 1)}
    manifest = stored(found.select("doc_id", *wrong.values()), "digests")
    rows = parse_expected(found, "dump", manifest, "doc_id", {name: f"expected_{name}" for name in DIGESTS})
    return rows.select("doc_id", *DIGESTS, "as_expected")


def integer_equal(value: Column, expected: Column) -> Column:
    """Whether a text or number is finite, whole and equal to the expected integer; null where it is not."""
    n = value.try_cast("double")
    return F.coalesce((F.abs(n) < float("inf")) & (n == F.floor(n)) & (n == expected), F.lit(False))


@query("metric_match", """SELECT event_id, event_id % 5 IN (0, 1) AS matches, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events""")
def metric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.element_at(F.array(i.cast("string"), F.concat(i, F.lit(".0")), F.concat(i, F.lit(".5")), F.lit("Infinity"), F.lit("none")), (i % 5 + 1).cast("int"))
    flag = F.element_at(F.array(F.lit(" True"), F.lit("0"), F.lit("maybe"), F.lit("")), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", integer_equal(text, i).alias("matches"), normalize_bool(flag).alias("flag"))


def fixed_size(vector: Column, size: int) -> Column:
    """A vector that must have ``size`` places: others, and null, raise when rows are read."""
    return F.when(F.size(vector) == size, vector).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {size} places is expected, not of "), F.coalesce(F.size(vector).cast("string"), F.lit("none")))))


def mean_over_queries(attention: Column, heads: int, queries: int, keys: int) -> Column:
    """Heads by keys: the mean over the queries of a flat array of heads * queries * keys values."""
    cell = lambda h, k: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(queries - 1)), lambda q: F.get(attention, (h * queries + q) * keys + k)), F.lit(0.0), lambda a, x: a + x) / queries
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(keys - 1)), lambda k: cell(h, k)))


@query("attention_mean", """WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::INT - 1 AS i FROM embeddings)
SELECT vec_id, i // 16 AS head, i % 4 AS key, round(avg(v), 6) AS value FROM a GROUP BY ALL""")
def attention_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of 64 places as 4 heads by 4 queries by 4 keys."""
    v = fixed_size(F.col("embedding").cast("array<double>"), 64)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(mean_over_queries(v, 4, 4, 4)).alias("head", "row"))
    return rows.select("vec_id", "head", F.posexplode("row").alias("key", "value")).withColumn("value", F.round("value", 6))
