"""Sample records: the manifest of grids and hashes, its invariants, and checks that recompute stored tables.

Checks give rows (check, n): how often something is wrong; a table passes where every n is 0. Stored tables are the
recomputed ones with faults planted by id, published and read back, so that every check has something to find and covers
the writing too.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.standins import SQL_SPLITS, documents, samples, splits
from ..plans.catalog import query, table
from ..sources.archives import list_archives, read_archives, write_archives
from ..sources.files import stored
from ..sources.workspace import shared_path
from .profile import SQL_GRID, grids
from .tables import SQL_QUALITY, quality_level, quality_table
from .verification import leaks, mismatches

SPLITS, CLASSES = ("train", "val", "test"), tuple(range(1, 10))
COUNTS = ("byte_token_count", "known_byte_count", "unknown_byte_count", "all_unknown_bins", "empty_bins", "min_bin", "max_bin")
TEXTS = ("split", "raw_sha256", "pixel_sha256", "mask_sha256", "image_path", "mask_path")


def image_path(root: str, suffix: str = ".png") -> Column:
    return F.concat_ws("/", F.lit(root), "split", F.concat(F.lit("class_"), F.col("class")), F.concat("id", F.lit(suffix)))


def counted(g: DataFrame, *more: str) -> DataFrame:
    """The counts, hashes and bin statistics of grids by id, and ``more`` of their columns."""
    return g.select(
        F.col("doc_id").cast("string").alias("id"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("byte_token_count"),
        F.aggregate("n_known", F.lit(0).cast("long"), lambda a, x: a + x).alias("known_byte_count"), F.sha2("pixel", 256).alias("pixel_sha256"), F.sha2("mask", 256).alias("mask_sha256"),
        F.size(F.filter(F.zip_with("n", "n_known", lambda n, k: (n > 0) & (k == 0)), lambda x: x)).cast("long").alias("all_unknown_bins"),
        F.size(F.filter("n", lambda n: n == 0)).cast("long").alias("empty_bins"), F.array_min("n").cast("long").alias("min_bin"), F.array_max("n").cast("long").alias("max_bin"), *more,
    )


def records(spark: SparkSession, sf_dir: str, g: DataFrame | None = None) -> DataFrame:
    """One row for each sample: counts, ratio, hashes, paths and bin statistics, from one pass over its bytes (or from counted grids that are there)."""
    g = counted(grids(samples(spark, sf_dir))) if g is None else g
    s = splits(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "class", "split")
    raw = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("raw_sha256"))
    out = s.join(g, "id").join(raw, "id").withColumn("unknown_byte_count", F.col("byte_token_count") - F.col("known_byte_count"))
    out = out.withColumn("unknown_byte_ratio", F.coalesce(F.try_divide("unknown_byte_count", "byte_token_count"), F.lit(0.0)))
    return out.withColumns({"image_path": image_path("images"), "mask_path": image_path("masks"), "status": F.lit("included")})


SQL_RECORDS = f"""{SQL_SPLITS}, {SQL_GRID},
a AS (SELECT doc_id, sum(n)::BIGINT AS byte_token_count, sum(k)::BIGINT AS known_byte_count, count(*) FILTER (n > 0 AND k = 0) AS all_unknown_bins, count(*) FILTER (n = 0) AS empty_bins, min(n) AS min_bin, max(n) AS max_bin,
      sha256(unhex(string_agg(lpad(to_hex(pixel), 2, '0'), '' ORDER BY j))) AS pixel_sha256, sha256(unhex(string_agg(lpad(to_hex(mask), 2, '0'), '' ORDER BY j))) AS mask_sha256 FROM cell GROUP BY doc_id),
rec AS (SELECT a.doc_id, a.doc_id::VARCHAR AS id, class, split, byte_token_count, known_byte_count, byte_token_count - known_byte_count AS unknown_byte_count,
        CASE WHEN byte_token_count = 0 THEN 0 ELSE (byte_token_count - known_byte_count) / byte_token_count END AS unknown_byte_ratio, sha256(coalesce(text, '')) AS raw_sha256, pixel_sha256, mask_sha256,
        all_unknown_bins, empty_bins, min_bin, max_bin, 'images/' || split || '/class_' || class || '/' || a.doc_id || '.png' AS image_path, 'masks/' || split || '/class_' || class || '/' || a.doc_id || '.png' AS mask_path
        FROM a JOIN s USING (doc_id) JOIN documents d ON d.doc_id = a.doc_id)"""


@query("image_records", f"WITH {SQL_RECORDS} SELECT id, class, split, byte_token_count, known_byte_count, unknown_byte_count, round(unknown_byte_ratio, 9) AS unknown_byte_ratio, raw_sha256, pixel_sha256, mask_sha256, all_unknown_bins, empty_bins, min_bin, max_bin, image_path, mask_path FROM rec")
def image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).drop("status").withColumn("unknown_byte_ratio", F.round("unknown_byte_ratio", 9))


def _rows(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def count_checks(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check, n): the rows for which each condition holds, in one pass; an unknown condition counts as wrong."""
    counts = rows.agg(*(F.count_if(F.coalesce(c, F.lit(True))).alias(name) for name, c in checks.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in checks))).alias("x")).select("x.*")


def repeated(rows: DataFrame, key: str, name: str) -> DataFrame:
    """How many rows repeat a key beyond its first."""
    each = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c"))
    return each.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit(name).alias("check"), "n")


def conflicts(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """How many keys come with several values."""
    return leaks(rows, key, value).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def require(rows: DataFrame, columns: tuple[str, ...]) -> None:
    missing = sorted(set(columns) - set(rows.columns))
    if missing:
        raise ValueError(f"columns missing: {missing}")


def manifest_invariants(rows: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Ids, statuses, splits, classes and counts of a manifest; known and unknown must add up, the ratio must follow."""
    require(rows, ("id", "class", "split", "status", "byte_token_count", "known_byte_count", "unknown_byte_count", "unknown_byte_ratio"))
    c, ratio = F.col, F.try_divide("unknown_byte_count", "byte_token_count")
    checks = {
        "missing_id": c("id").isNull(),
        "unsafe_id": ~c("id").rlike("^[A-Za-z0-9]+$"),
        "not_included": c("status") != "included",
        "invalid_split": ~c("split").isin(*SPLITS),
        "invalid_class": ~c("class").between(CLASSES[0], CLASSES[-1]),
        "no_tokens": c("byte_token_count") <= 0,
        "counts_do_not_add_up": c("known_byte_count") + c("unknown_byte_count") != c("byte_token_count"),
        "inconsistent_ratio": F.abs(ratio - c("unknown_byte_ratio")) > tolerance,
    }
    return _rows([count_checks(rows, checks), repeated(rows, "id", "repeated_id")])


def planted(rows: DataFrame) -> DataFrame:
    """Records as a careless writer would store them: faults by id."""
    i = F.col("id").cast("long")
    return rows.withColumns({
        "status": F.when(i % 97 == 3, "excluded").otherwise(F.col("status")), "split": F.when(i % 89 == 5, "trial").otherwise(F.col("split")),
        "known_byte_count": F.col("known_byte_count") + F.when(i % 83 == 7, 1).otherwise(0), "unknown_byte_ratio": F.col("unknown_byte_ratio") + F.when(i % 79 == 1, 1e-9).otherwise(0.0),
        "pixel_sha256": F.when(i % 73 == 2, F.lit("0")).otherwise(F.col("pixel_sha256")), "max_bin": F.when(i % 71 == 0, F.lit(None)).otherwise(F.col("max_bin")),
        "image_path": F.when(i % 67 == 4, F.concat(F.lit("../"), "image_path")).otherwise(F.col("image_path")), "id": F.when(i % 61 == 6, F.concat(F.lit("x-"), "id")).otherwise(F.col("id")),
    })


SQL_PLANTED = f"""{SQL_RECORDS}, pl AS (SELECT CASE WHEN doc_id % 61 = 6 THEN 'x-' || id ELSE id END AS id, class, CASE WHEN doc_id % 97 = 3 THEN 'excluded' ELSE 'included' END AS status, CASE WHEN doc_id % 89 = 5 THEN 'trial' ELSE split END AS split,
byte_token_count, known_byte_count + CASE WHEN doc_id % 83 = 7 THEN 1 ELSE 0 END AS known_byte_count, unknown_byte_count, unknown_byte_ratio + CASE WHEN doc_id % 79 = 1 THEN 1e-9 ELSE 0 END AS unknown_byte_ratio, raw_sha256,
CASE WHEN doc_id % 73 = 2 THEN '0' ELSE pixel_sha256 END AS pixel_sha256, mask_sha256, all_unknown_bins, empty_bins, min_bin, CASE WHEN doc_id % 71 = 0 THEN NULL ELSE max_bin END AS max_bin,
CASE WHEN doc_id % 67 = 4 THEN '../' || image_path ELSE image_path END AS image_path, mask_path FROM rec)"""


def _check_sql(source: str, checks: Mapping[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", count(*) FILTER (coalesce({c}, true)) AS n FROM {source}" for name, c in checks.items())


_INVARIANTS = {
    "missing_id": "id IS NULL", "unsafe_id": "NOT regexp_full_match(id, '[A-Za-z0-9]+')", "not_included": "status <> 'included'", "invalid_split": "split NOT IN ('train', 'val', 'test')",
    "invalid_class": "class NOT BETWEEN 1 AND 9", "no_tokens": "byte_token_count <= 0", "counts_do_not_add_up": "known_byte_count + unknown_byte_count <> byte_token_count",
    "inconsistent_ratio": "abs(unknown_byte_count / nullif(byte_token_count, 0) - unknown_byte_ratio) > 1e-12",
}


@query("manifest_invariants", f"WITH {SQL_PLANTED} {_check_sql('pl', _INVARIANTS)} UNION ALL SELECT 'repeated_id', count(*) - count(DISTINCT id) FROM pl")
def manifest_invariants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_invariants(stored(planted(records(spark, sf_dir)), "planted"))


def dataset_invariants(rows: DataFrame) -> DataFrame:
    """What training asks of a dataset: complete rows, unique ids, known classes, all splits, every class in train, paths
    below the root, and images that cross neither splits nor classes."""
    require(rows, ("id", "class", "split", "image_path", "pixel_sha256"))
    missing = F.col("id").isNull() | F.col("class").isNull() | F.col("split").isNull() | F.col("image_path").isNull()
    path = F.replace("image_path", F.lit("\\"), F.lit("/"))
    checks = {"missing_value": missing, "blank_id": F.trim("id") == "", "invalid_class": ~F.col("class").isin(*CLASSES), "outside_root": path.startswith("/") | F.array_contains(F.split(path, "/"), "..")}
    in_train = F.collect_set(F.when((F.col("split") == "train") & F.col("class").isin(*CLASSES), F.col("class")))
    sets = rows.agg(F.size(F.array_except(in_train, F.array())).alias("t"), F.collect_set("split").alias("s"))
    wanted = F.array(*map(F.lit, SPLITS))
    sets = sets.select(F.explode(F.array(
        F.struct(F.lit("classes_missing_in_train").alias("check"), (F.lit(len(CLASSES)) - F.col("t")).cast("long").alias("n")),
        F.struct(F.lit("wrong_splits").alias("check"), (F.size(F.array_except("s", wanted)) + F.size(F.array_except(wanted, "s"))).cast("long").alias("n")),
    )).alias("x")).select("x.*")
    return _rows([count_checks(rows, checks), repeated(rows, "id", "repeated_id"), sets, conflicts(rows, "pixel_sha256", "split", "image_crosses_splits"), conflicts(rows, "pixel_sha256", "class", "image_crosses_classes")])


_DATASET = {"missing_value": "id IS NULL OR class IS NULL OR split IS NULL OR image_path IS NULL", "blank_id": "trim(id) = ''", "invalid_class": "class NOT BETWEEN 1 AND 9",
            "outside_root": "image_path[1:1] = '/' OR list_contains(string_split(replace(image_path, '\\', '/'), '/'), '..')"}


@query("dataset_invariants", f"""WITH {SQL_PLANTED} {_check_sql('pl', _DATASET)} UNION ALL SELECT 'repeated_id', count(*) - count(DISTINCT id) FROM pl
UNION ALL SELECT 'classes_missing_in_train', 9 - count(DISTINCT class) FILTER (split = 'train') FROM pl
UNION ALL SELECT 'wrong_splits', count(*) FROM ((SELECT split FROM pl UNION SELECT unnest(['train', 'val', 'test'])) EXCEPT (SELECT split FROM pl INTERSECT SELECT unnest(['train', 'val', 'test'])))
UNION ALL SELECT 'image_crosses_splits', count(*) FROM (SELECT pixel_sha256 FROM pl GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'image_crosses_classes', count(*) FROM (SELECT pixel_sha256 FROM pl GROUP BY 1 HAVING count(DISTINCT class) > 1)""")
def dataset_invariants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_invariants(stored(planted(records(spark, sf_dir)), "planted"))


HASHES = ("raw_sha256", "pixel_sha256", "mask_sha256", "token_stream_sha256")


@query("hash_leaks", f"WITH {SQL_RECORDS}, h AS (SELECT rec.*, sha256(lower(hex(coalesce(text, '')))) AS token_stream_sha256 FROM rec JOIN documents d USING (doc_id)) "
       + " UNION ALL ".join(f"SELECT '{h}' AS \"check\", count(*) AS n FROM (SELECT {h} FROM h GROUP BY 1 HAVING count(DISTINCT split) > 1)" for h in HASHES))
def hash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each of four hashes that stand in several splits."""
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.lower(F.hex(F.coalesce("text", F.lit("")))), 256).alias("token_stream_sha256"))
    rows = stored(records(spark, sf_dir).select("id", "split", *HASHES[:3]).join(d, "id"), "hashes")
    return _rows([conflicts(rows, h, "split", h) for h in HASHES])


def compare_records(found: DataFrame, computed: DataFrame) -> DataFrame:
    """Mismatches by column of stored records with recomputed ones, and ids that only one of them has."""
    cells = mismatches(computed, found, "id", dict.fromkeys(COUNTS, 0.0) | {"class": 0.0, "unknown_byte_ratio": 1e-12}, TEXTS)
    both = computed.select("id", F.lit(True).alias("c")).join(found.select("id", F.lit(True).alias("s")), "id", "full_outer")
    sides = both.agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("extra"))
    sides = sides.select(F.explode(F.array(*(F.struct(F.lit(f"{x}_id").alias("check"), F.col(x).alias("n")) for x in ("missing", "extra")))).alias("x")).select("x.*")
    return cells.select(F.col("column").alias("check"), F.col("n_mismatched").alias("n")).unionByName(sides)


_OFF = {c: f"NOT coalesce(abs(pl.{c} - rec.{c}) <= 0, false)" for c in (*COUNTS, "class")} | {"unknown_byte_ratio": "NOT coalesce(abs(pl.unknown_byte_ratio - rec.unknown_byte_ratio) <= 1e-12, false)"}
_OFF |= {c: f"coalesce(pl.{c}, '') <> coalesce(rec.{c}, '')" for c in TEXTS}


@query("record_mismatch", f"""WITH {SQL_PLANTED} {" UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) FILTER ({x}) AS n FROM rec JOIN pl USING (id)" for c, x in _OFF.items())}
UNION ALL SELECT 'missing_id', count(*) FROM rec ANTI JOIN pl USING (id) UNION ALL SELECT 'extra_id', count(*) FROM pl ANTI JOIN rec USING (id)""")
def record_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records against the bytes: every column is computed anew."""
    computed = stored(records(spark, sf_dir), "records")
    return compare_records(stored(planted(computed), "planted"), computed)


def verify_quality(found: DataFrame, ratios: DataFrame) -> DataFrame:
    """Levels and reasons recomputed from the ratios, against the stored ones."""
    level, reason = quality_level(F.col("unknown_ratio"), F.col("head_unknown_ratio"))
    computed = ratios.withColumns({"quality": level, "reason": reason})
    cells = mismatches(computed, found, "doc_id", {"unknown_ratio": 1e-12, "head_unknown_ratio": 1e-12}, ("quality", "reason"))
    return cells.select(F.col("column").alias("check"), F.col("n_mismatched").alias("n"))


@query("quality_verify", f"""WITH {SQL_QUALITY}, o AS (SELECT doc_id, unknown_ratio + CASE WHEN doc_id % 7 = 0 THEN 0.25 ELSE 0 END AS unknown_ratio, head_unknown_ratio, quality, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE reason END AS reason FROM q),
r AS (SELECT doc_id, unknown_ratio AS u, head_unknown_ratio AS h FROM q), n AS (SELECT doc_id, u, h, CASE WHEN u > 0.9 OR h > 0.5 THEN 'review' WHEN u > 0.5 THEN 'caution' ELSE 'normal' END AS quality,
CASE WHEN u > 0.9 OR h > 0.5 THEN concat_ws(';', CASE WHEN u > 0.9 THEN 'unknown_ratio' END, CASE WHEN h > 0.5 THEN 'head_unknown_ratio' END) WHEN u > 0.5 THEN 'unknown_ratio' ELSE '' END AS reason FROM r)
SELECT 'unknown_ratio' AS "check", count(*) FILTER (NOT coalesce(abs(u - o.unknown_ratio) <= 1e-12, false)) AS n FROM n JOIN o USING (doc_id) UNION ALL SELECT 'head_unknown_ratio', count(*) FILTER (NOT coalesce(abs(h - o.head_unknown_ratio) <= 1e-12, false)) FROM n JOIN o USING (doc_id)
UNION ALL SELECT 'quality', count(*) FILTER (n.quality <> o.quality) FROM n JOIN o USING (doc_id) UNION ALL SELECT 'reason', count(*) FILTER (n.reason <> o.reason) FROM n JOIN o USING (doc_id)""")
def quality_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_table(spark, sf_dir)
    bad = q.withColumns({"unknown_ratio": F.col("unknown_ratio") + F.when(F.col("doc_id") % 7 == 0, 0.25).otherwise(0.0), "reason": F.expr("if(doc_id % 11 = 0, 'other', reason)")})
    return verify_quality(stored(bad, "quality"), q.select("doc_id", "unknown_ratio", "head_unknown_ratio"))


def image_summary(rows: DataFrame) -> DataFrame:
    """(measure, value) over all records: counts by split, tokens, bins and the weighted unknown ratio."""
    c, add = F.col, lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("double")
    measures = {"samples": F.count("*").cast("double"), "known_bytes": add("known_byte_count"), "unknown_bytes": add("unknown_byte_count"), "tokens": add("byte_token_count"),
                "all_unknown_bins": add("all_unknown_bins"), "empty_bins": add("empty_bins"), "samples_with_empty_bins": F.count_if(c("empty_bins") > 0).cast("double"), "min_bin": F.min("min_bin").cast("double"), "max_bin": F.max("max_bin").cast("double"),
                "unknown_ratio": F.round(F.coalesce(F.try_divide(F.sum("unknown_byte_count"), F.sum("byte_token_count")), F.lit(0.0)), 9), "over_90_percent_unknown": F.count_if(c("unknown_byte_ratio") > 0.9).cast("double")}
    measures |= {f"split_{s}": F.count_if(c("split") == s).cast("double") for s in SPLITS}
    one = rows.agg(*(x.alias(m) for m, x in measures.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures))).alias("x")).select("x.*")


def verify_summary(expected: DataFrame, rows: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """The summary's measures as stored and as recomputed, and whether they agree."""
    found = image_summary(rows).withColumnRenamed("value", "computed").join(expected.withColumnRenamed("value", "stored"), "measure", "full_outer")
    return found.withColumn("same", F.coalesce(F.abs(F.col("computed") - F.col("stored")) <= tolerance, F.lit(False)))


_MEASURES = {"samples": "count(*)", "known_bytes": "sum(known_byte_count)", "unknown_bytes": "sum(unknown_byte_count)", "tokens": "sum(byte_token_count)", "all_unknown_bins": "sum(all_unknown_bins)", "empty_bins": "sum(empty_bins)",
             "samples_with_empty_bins": "count(*) FILTER (empty_bins > 0)", "min_bin": "min(min_bin)", "max_bin": "max(max_bin)", "unknown_ratio": "round(sum(unknown_byte_count) / sum(byte_token_count), 9)",
             "over_90_percent_unknown": "count(*) FILTER (unknown_byte_ratio > 0.9)"} | {f"split_{s}": f"count(*) FILTER (split = '{s}')" for s in SPLITS}


def _summary_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS measure, ({x})::DOUBLE AS value FROM {source}" for m, x in _MEASURES.items())


@query("summary_verify", f"WITH {SQL_PLANTED}, c AS ({_summary_sql('rec')}), st AS ({_summary_sql('pl')}) SELECT measure, c.value AS computed, st.value AS stored, coalesce(abs(c.value - st.value) <= 1e-12, false) AS same FROM c FULL JOIN st USING (measure)")
def summary_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(records(spark, sf_dir), "records")
    return verify_summary(stored(image_summary(planted(rows)), "summary"), rows)


def inspect_collection(manifest: DataFrame, inventory: DataFrame, path: str, root: str) -> DataFrame:
    """Declared paths against those that follow from split, class and id, and against the files that are there."""
    expected = manifest.withColumn("expected", image_path(root))
    wrong = expected.agg(F.count_if(F.coalesce(F.col(path) != F.col("expected"), F.lit(True))).alias("n")).select(F.lit("unexpected_path").alias("check"), "n")
    both = expected.select(F.col("expected").alias("path"), F.lit(True).alias("e")).join(inventory.select("path", F.lit(True).alias("a")), "path", "full_outer")
    sides = both.agg(F.count_if(F.col("a").isNull()).alias("missing_file"), F.count_if(F.col("e").isNull()).alias("extra_file"))
    sides = sides.select(F.explode(F.array(*(F.struct(F.lit(x).alias("check"), F.col(x).alias("n")) for x in ("missing_file", "extra_file")))).alias("x")).select("x.*")
    return _rows([wrong, sides, repeated(manifest, path, "repeated_path")])


@query("collection_check", f"""WITH {SQL_SPLITS}, st AS (SELECT doc_id, 'images/' || split || '/class_' || class || '/' || doc_id || '.png' AS image_path FROM s), de AS (SELECT CASE WHEN doc_id % 67 = 4 THEN '../' || image_path ELSE image_path END AS declared, image_path FROM st),
inv AS (SELECT image_path AS path FROM st WHERE doc_id % 53 <> 1 UNION ALL SELECT 'images/odd/' || doc_id || '.png' FROM st WHERE doc_id % 59 = 2)
SELECT 'unexpected_path' AS "check", count(*) FILTER (declared <> image_path) AS n FROM de UNION ALL SELECT 'missing_file', count(*) FROM st ANTI JOIN inv ON inv.path = st.image_path
UNION ALL SELECT 'extra_file', count(*) FROM inv ANTI JOIN st ON inv.path = st.image_path UNION ALL SELECT 'repeated_path', count(*) - count(DISTINCT declared) FROM de""")
def collection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared paths of a stored manifest against a stored inventory that lacks some files and has others."""
    i = F.col("id").cast("long")
    rows = splits(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "class", "split").withColumn("image_path", image_path("images"))
    there = rows.filter(i % 53 != 1).select(F.col("image_path").alias("path")).union(rows.filter(i % 59 == 2).select(F.concat(F.lit("images/odd/"), "id", F.lit(".png"))))
    declared = rows.withColumn("image_path", F.when(i % 67 == 4, F.concat(F.lit("../"), "image_path")).otherwise(F.col("image_path")))
    return inspect_collection(stored(declared, "manifest"), stored(there, "inventory"), "image_path", "images")


def match_entries(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Each manifest row with its archive entry: ``state`` is matched, missing or moved (another path than declared)."""
    both = manifest.join(entries, "id", "left")
    state = F.when(F.col("entry").isNull(), "missing").when(F.col("entry") != F.col("declared"), "moved").otherwise("matched")
    return both.select("id", "declared", "entry", state.alias("state"))


def dump_archives(spark: SparkSession, sf_dir: str) -> str:
    """Labelled documents as dumps in ZIP archives, every tenth in another folder and every seventh twice; where they are."""
    labelled = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    folders = F.concat(F.array(F.when(F.col("doc_id") % 10 == 0, "y").otherwise("x")), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("z"))).otherwise(F.array().cast("array<string>")))
    rows = labelled.select("doc_id", "text", F.explode(folders).alias("folder"))
    at = shared_path(spark, "dumps")
    write_archives(rows.select(F.concat("folder", F.lit("/"), "doc_id", F.lit(".bytes")).alias("entry"), F.col("text").cast("binary").alias("content")).repartition(4, "entry"), at)
    return at


@query("archive_entry_match", """SELECT d.doc_id::VARCHAR AS id, 'x/' || d.doc_id || '.bytes' AS declared, CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 10 = 0 THEN 'y/' || d.doc_id || '.bytes' ELSE 'x/' || d.doc_id || '.bytes' END AS entry,
CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id % 10 = 0 THEN 'moved' ELSE 'matched' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def archive_entry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared entries against the directories of real archives; nothing is inflated."""
    declared = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("x/"), F.col("doc_id"), F.lit(".bytes")).alias("declared"))
    there = list_archives(spark, dump_archives(spark, sf_dir)).filter("entry NOT LIKE 'z/%'")
    return match_entries(declared, there.select(F.regexp_extract("entry", r"([^/]+)\.bytes$", 1).alias("id"), "entry"))


@query("archive_contents", """SELECT CASE WHEN d.doc_id % 10 = 0 THEN 'y/' ELSE 'x/' END || d.doc_id || '.bytes' AS entry, d.doc_id::VARCHAR AS sample_id, strlen(coalesce(text, '')) AS file_size, sha256(coalesce(text, '')) AS sha256 FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id
UNION ALL SELECT 'z/' || d.doc_id || '.bytes', d.doc_id::VARCHAR, strlen(coalesce(text, '')), sha256(coalesce(text, '')) FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id % 7 = 0""")
def archive_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps written to archives and read back from their parts."""
    rows = read_archives(spark, dump_archives(spark, sf_dir))
    return rows.select("entry", "sample_id", "file_size", F.sha2("content", 256).alias("sha256"))


def with_class_names(rows: DataFrame, labels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows with the class of their id's label and the name of the class (a fixed list, from class 1 on)."""
    named = F.get(F.array(*map(F.lit, names)), F.col("class") - 1)
    return rows.join(labels, "id", "left").withColumn("family", F.when(F.col("class").isNotNull(), named))


@query("class_names", "SELECT d.doc_id AS id, (quality + 2 * toxic + 1)::INT AS class, CASE quality + 2 * toxic WHEN 0 THEN 'plain' WHEN 1 THEN 'good' WHEN 2 THEN 'toxic' WHEN 3 THEN 'both' END AS family FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + 2 * F.col("toxic") + 1).cast("int").alias("class"))
    return with_class_names(documents(spark, sf_dir).select(F.col("doc_id").alias("id")), labels, ("plain", "good", "toxic", "both"))
