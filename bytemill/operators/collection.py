"""Collections of grids as stored, against their manifest and against the report that was written about them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytestats import Bytes, Samples, binary_column
from ..functions.measures import IMAGES, MOMENTS, RANGE, Measure, measure
from ..functions.standins import samples, with_split
from ..plans.catalog import query
from ..sources.files import stored, update_report, write_report
from ..sources.workspace import shared_path
from .difference import fingerprints
from .profile import grids
from .records import SQL_RECORDS, counted, image_path, inspect_collection, records
from .verification import collisions

SIDE = 32
MEASURES = {"moments": MOMENTS, "images": IMAGES, "range": RANGE}


def binary_samples(rows: DataFrame, column: str, keys: tuple[str, ...] = ()) -> Samples:
    """The bytes of a binary column, all of them known."""

    def read(batch: pa.RecordBatch) -> Bytes:
        data, offs = binary_column(batch.column(column))
        return data, data == data, offs

    return Samples(rows, read, column, keys)


def inspect_images(manifest: DataFrame, images: DataFrame, path: str, pixels: str, hash_: str, root: str, size: int = SIDE * SIDE) -> DataFrame:
    """(check, n): paths (see ``inspect_collection``), and of the declared files that are there: wrong sizes, hashes that differ from the manifest's or that it lacks."""
    there = images.select(F.col("path").alias("file_"), F.octet_length(pixels).alias("size_"), F.sha2(pixels, 256).alias("sha_"))
    both = manifest.join(there, F.col(path) == F.col("file_"))
    checks = {"wrong_size": F.col("size_") != size, "hash_mismatch": F.col("sha_") != F.lower(hash_), "hash_missing": F.col(hash_).isNull()}
    counts = both.agg(*(F.count_if(c).alias(name) for name, c in checks.items()))
    counts = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in checks))).alias("x")).select("x.*")
    return inspect_collection(manifest, images, path, root).unionByName(counts)


def digest_of(rows: DataFrame) -> str:
    """A digest of a table's rows in any order: one aggregate."""
    hashed = rows.select(F.lit(0).cast("long").alias("place"), F.xxhash64(*rows.columns).alias("h1"), F.xxhash64(F.lit(1), *rows.columns).alias("h2"))
    row = fingerprints(hashed, 1).drop("range").first()
    return ":".join(map(str, row)) if row else ""


def image_report(manifest: DataFrame, images: DataFrame, masks: DataFrame, settings: Mapping[str, object], measures: Mapping[str, Measure] = MEASURES) -> dict:
    """The report about a collection, in blocks: what was read, what was written, and its quality. One pass over the images,
    one over the masks, and aggregates of the manifest."""
    c, total = F.col, lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    row = manifest.agg(
        F.count("*").alias("samples"), total("byte_token_count").alias("tokens"), total("known_byte_count").alias("known"), total("unknown_byte_count").alias("unknown"), total("all_unknown_bins").alias("all_unknown"),
        F.count_if(c("all_unknown_bins") > 0).alias("with_unknown"), total("empty_bins").alias("empty"), F.min("min_bin").alias("low"), F.max("max_bin").alias("high"),
    ).first()
    count = lambda by: {str(r[0]): r[1] for r in manifest.groupBy(by).count().orderBy(by).collect()}
    pixels, mask = (measure(binary_samples(x, "data"), measures) for x in (images, masks))
    hashed = images.select("path", F.sha2("data", 256).alias("hash"))
    same = collisions(hashed.join(manifest.select("image_path", "class", "split"), F.col("path") == F.col("image_path")), "hash").first()
    return {
        "dataset": settings["dataset"], "method": settings["method"], "method_version": settings["method_version"],
        "verification": {"passed": True, "verified_samples": row.samples, "expected_samples": row.samples, "image_count": pixels["images"], "mask_count": mask["images"], "errors": []},
        "output": {"samples": row.samples, "split_counts": count("split"), "image_directory": "images", "mask_directory": "masks", "manifest": settings["manifest"], "image_size": [SIDE, SIDE], "image_mode": "L", "class_counts": count("class")},
        "input": {"manifest_samples": row.samples, "zip_byte_entries": row.samples, "zip_sha256": settings["source"], "manifest_sha256": digest_of(manifest.select("id", "class", "split", "image_path")),
                  "source_token_count": row.tokens, "known_token_count": row.known, "unknown_token_count": row.unknown},
        "quality": {
            "constant_image_count": pixels["constant_images"], "all_zero_image_count": pixels["all_black_images"], "unique_image_pixel_hashes": same.n_hashes, "duplicate_image_groups": same.n_groups, "samples_in_duplicate_image_groups": same.n_samples,
            "duplicate_extra_images": same.n_extra, "largest_duplicate_image_group": same.largest, "cross_class_duplicate_groups": same.n_cross_class, "cross_split_duplicate_groups": same.n_cross_split,
            "all_unknown_bin_count": row.all_unknown, "samples_with_all_unknown_bins": row.with_unknown, "empty_bin_count": row.empty, "minimum_bin_tokens": row.low, "maximum_bin_tokens": row.high,
            "image_pixel_mean": pixels["pixel_mean"], "image_pixel_std": pixels["pixel_std"], "image_zero_pixel_ratio": pixels["zero_pixel_ratio"],
            "unknown_mask_pixel_mean": mask["pixel_mean"], "unknown_mask_zero_pixel_ratio": mask["zero_pixel_ratio"], "weighted_unknown_byte_ratio": row.unknown / row.tokens if row.tokens else None,
        },
    }


#: Pairs that are compared within a tolerance; all others exactly.
FLOATS = dict.fromkeys([f"quality.{x}" for x in ("image_pixel_mean", "image_pixel_std", "image_zero_pixel_ratio", "unknown_mask_pixel_mean", "unknown_mask_zero_pixel_ratio", "weighted_unknown_byte_ratio")], 1e-12)
DEPTH = 16


def flattened(rows: DataFrame, column: str) -> DataFrame:
    """path, kind and value of every leaf of a VARIANT column, an empty object or array being one. Nesting beyond DEPTH raises."""
    spark = rows.sparkSession
    level = rows.select(F.lit("").alias("path"), F.col(column).alias("v"))
    leaves = []
    for depth in range(DEPTH + 1):
        level = level.withColumns({"kind": F.schema_of_variant("v"), "text": F.to_json("v")})
        holds = F.col("kind").rlike("^(OBJECT|ARRAY)<") & ~F.col("text").isin("{}", "[]")
        leaves.append(level.filter(~holds).select("path", "kind", F.coalesce(F.try_variant_get("v", "$", "string"), F.col("text")).alias("value")))
        inner = level.filter(holds)
        if depth == DEPTH:
            leaves.append(inner.select("path", "kind", F.raise_error(F.lit("nested too deeply")).cast("string").alias("value")))
            break
        if inner.isEmpty():
            break
        each = inner.select("path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("pos_"), F.col("key").alias("key_"), F.col("value").alias("value_")))
        name = F.coalesce(F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(F.lit("")), F.col("key_")), F.concat("path", F.lit("["), "pos_", F.lit("]")))
        level = each.select(name.alias("path"), F.col("value_").alias("v"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def compare_reports(found: DataFrame, expected: DataFrame, tolerances: Mapping[str, float] = FLOATS) -> DataFrame:
    """(pair, same, stored, computed) of two JSON texts (columns ``json``): a pair is a value of the report or of one of its
    blocks. Numbers agree exactly or within their pair's tolerance, other leaves by kind and text; a leaf that only one has differs."""
    sides = {}
    for side, rows in (("stored", found), ("computed", expected)):
        leaf = flattened(rows.select(F.parse_json("json").alias("v")), "v")
        sides[side] = leaf.select("path", F.col("kind").alias(f"kind_{side}"), F.col("value").alias(side))
    both = sides["stored"].join(sides["computed"], "path", "full_outer")
    pair = F.regexp_extract("path", r"^([^.\[]*(?:\.[^.\[]*)?)", 1)
    number = lambda side: F.when(F.col(f"kind_{side}").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.col(side).try_cast("double"))
    allowed = F.coalesce(*(F.when(F.col("pair") == p, F.lit(t)) for p, t in tolerances.items()), F.lit(0.0))
    near = F.abs(number("stored") - number("computed")) <= allowed
    alike = (F.col("kind_stored") == F.col("kind_computed")) & (F.col("stored") == F.col("computed"))
    leaves = both.withColumn("pair", pair).withColumn("ok", F.coalesce(near, alike, F.lit(False)))
    told = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", side))), lambda x: x[side]), ", ").alias(side)
    return leaves.groupBy("pair").agg(F.every("ok").alias("same"), told("stored"), told("computed"))


def verify_report(spark: SparkSession, path: str, report: Mapping[str, object], tolerances: Mapping[str, float] = FLOATS) -> DataFrame:
    """``compare_reports`` of the report stored at ``path`` with a computed one."""
    there = spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")
    return compare_reports(there, spark.createDataFrame([(json.dumps(report),)], "json string"), tolerances)


SETTINGS = {"dataset": "documents", "method": "equal-position-bin known-byte mean", "method_version": 1, "manifest": "manifests/records.parquet", "source": "digest of the source"}


def stored_collection(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stand-ins' manifest, images and masks, written and read back; the bytes are read once for all of them."""
    plain = samples(spark, sf_dir)
    g = grids(replace(plain, rows=with_split(plain.rows, spark, sf_dir), keys=(*plain.keys, "split")), SIDE)
    # Every path follows from its row, so no image is ever joined or shuffled: only counts and hashes are.
    files = counted(g, "class", "split", "pixel", "mask").withColumns({"image_path": image_path("images"), "mask_path": image_path("masks")}).drop("class", "split")
    g = stored(files, "grids")
    manifest = stored(records(spark, sf_dir, g.drop("pixel", "mask", "image_path", "mask_path")), "records")
    return {"manifest": manifest, "images": g.select("id", F.col("image_path").alias("path"), F.col("pixel").alias("data")), "masks": g.select("id", F.col("mask_path").alias("path"), F.col("mask").alias("data"))}


def damaged_images(images: DataFrame) -> DataFrame:
    """Images lost, blackened and cut short by id, and one more that nothing declares."""
    i = F.col("id").cast("long")
    data = F.when(i % 59 == 2, F.rpad(F.lit(""), SIDE * SIDE, "\x00").cast("binary")).when(i % 47 == 5, F.substring("data", 1, 1000)).otherwise(F.col("data"))
    bad = images.filter(i % 53 != 1).withColumn("data", data)
    return bad.unionByName(images.filter("id = '0'").withColumn("path", F.lit("images/odd/0.png")))


SQL_IMAGES = f"""{SQL_RECORDS},
im AS (SELECT doc_id, j, pixel, mask FROM cell),
iv AS (SELECT 0 AS v, doc_id, 0 AS odd, j, pixel FROM im UNION ALL SELECT 1, doc_id, 0, j, CASE WHEN doc_id % 59 = 2 THEN 0 ELSE pixel END FROM im WHERE doc_id % 53 <> 1 AND NOT (doc_id % 59 <> 2 AND doc_id % 47 = 5 AND j >= 1000) UNION ALL SELECT 1, doc_id, 1, j, pixel FROM im WHERE doc_id = 0),
ig AS (SELECT v, doc_id, odd, min(pixel) AS lo, max(pixel) AS hi, count(*) AS n, sum(pixel)::HUGEINT AS t, sum(pixel * pixel)::HUGEINT AS q, count(*) FILTER (pixel = 0) AS z, sha256(unhex(string_agg(lpad(to_hex(pixel), 2, '0'), '' ORDER BY j))) AS h FROM iv GROUP BY ALL),
ih AS (SELECT v, h, count(*) AS n, count(DISTINCT class) > 1 AS xc, count(DISTINCT split) > 1 AS xs FROM ig JOIN rec USING (doc_id) WHERE odd = 0 GROUP BY v, h)"""


@query("image_collection", f"""WITH {SQL_IMAGES}, bad AS (SELECT ig.*, rec.pixel_sha256 FROM ig JOIN rec USING (doc_id) WHERE v = 1 AND odd = 0)
SELECT 'unexpected_path' AS "check", 0 AS n UNION ALL SELECT 'repeated_path', 0 UNION ALL SELECT 'missing_file', count(*) FROM documents WHERE doc_id % 53 = 1 UNION ALL SELECT 'extra_file', 1 UNION ALL SELECT 'hash_missing', 0
UNION ALL SELECT 'wrong_size', count(*) FILTER (n <> 1024) FROM bad UNION ALL SELECT 'hash_mismatch', count(*) FILTER (h <> pixel_sha256) FROM bad""")
def image_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored collection with lost, blackened, cut and extra images against its manifest."""
    return check_images(stored_collection(spark, sf_dir))


def check_images(found: Mapping[str, DataFrame]) -> DataFrame:
    return inspect_images(found["manifest"], stored(damaged_images(found["images"]), "images"), "image_path", "data", "pixel_sha256", "images")


_PAIRS = {
    "verification.image_count": "count(*)", "quality.constant_image_count": "count(*) FILTER (lo = hi)", "quality.all_zero_image_count": "count(*) FILTER (hi = 0)", "quality.image_pixel_mean": "sum(t) / sum(n)",
    "quality.image_pixel_std": "sqrt(sum(n) * sum(q) - sum(t) * sum(t)) / sum(n)", "quality.image_zero_pixel_ratio": "sum(z) / sum(n)",
}
_GROUPS = {"unique_image_pixel_hashes": "count(*)", "duplicate_image_groups": "count(*) FILTER (n > 1)", "samples_in_duplicate_image_groups": "coalesce(sum(n) FILTER (n > 1), 0)", "duplicate_extra_images": "coalesce(sum(n - 1) FILTER (n > 1), 0)",
           "largest_duplicate_image_group": "coalesce(max(n) FILTER (n > 1), 1)", "cross_class_duplicate_groups": "count(*) FILTER (n > 1 AND xc)", "cross_split_duplicate_groups": "count(*) FILTER (n > 1 AND xs)"}
#: Pairs that the planted report gets wrong whatever the images are, and those that nothing changes.
_WRONG = ("output.split_counts", "verification.errors", "input.zip_sha256", "quality.empty_bin_count", "quality.maximum_bin_tokens", "quality.unknown_mask_zero_pixel_ratio")
_RIGHT = ("dataset", "method", "method_version", *(f"verification.{x}" for x in ("passed", "verified_samples", "expected_samples", "mask_count")), *(f"output.{x}" for x in ("samples", "image_directory", "mask_directory", "manifest", "image_size", "image_mode", "class_counts")),
          *(f"input.{x}" for x in ("manifest_samples", "zip_byte_entries", "manifest_sha256", "source_token_count", "known_token_count", "unknown_token_count")),
          *(f"quality.{x}" for x in ("all_unknown_bin_count", "samples_with_all_unknown_bins", "minimum_bin_tokens", "unknown_mask_pixel_mean", "weighted_unknown_byte_ratio")))


def planted_report(report: Mapping[str, dict]) -> dict[str, object]:
    """Blocks of a report as a careless writer would leave them: values off, one within its tolerance, one left out."""
    quality = dict(report["quality"])
    quality |= {"empty_bin_count": quality["empty_bin_count"] + 1, "unknown_mask_zero_pixel_ratio": quality["unknown_mask_zero_pixel_ratio"] + 1e-9, "unknown_mask_pixel_mean": quality["unknown_mask_pixel_mean"] + 1e-13}
    del quality["maximum_bin_tokens"]
    splits = {k: v + 1 for k, v in report["output"]["split_counts"].items()}
    return {"quality": quality, "output": report["output"] | {"split_counts": splits}, "verification": report["verification"] | {"errors": ["odd"]}, "input": report["input"] | {"zip_sha256": "other"}}


def _same_sql() -> str:
    from_images = [f"SELECT '{p}' AS pair, abs((SELECT {x} FROM ig WHERE v = 0) - (SELECT {x} FROM ig WHERE v = 1)) <= {FLOATS.get(p, 0)} AS same" for p, x in _PAIRS.items()]
    from_groups = [f"SELECT 'quality.{p}' AS pair, (SELECT {x} FROM ih WHERE v = 0) = (SELECT {x} FROM ih WHERE v = 1) AS same" for p, x in _GROUPS.items()]
    fixed = [f"SELECT unnest([{', '.join(repr(p) for p in pairs)}]) AS pair, {same} AS same" for pairs, same in ((_WRONG, "false"), (_RIGHT, "true"))]
    return " UNION ALL ".join([*from_images, *from_groups, *fixed])


@query("report_verify", f"WITH {SQL_IMAGES} {_same_sql()}")
def report_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored report, some blocks of which were replaced, against one computed from a collection that was damaged since."""
    return check_report(stored_collection(spark, sf_dir))


def check_report(found: Mapping[str, DataFrame]) -> DataFrame:
    spark = found["manifest"].sparkSession
    report = image_report(found["manifest"], found["images"], found["masks"], SETTINGS)
    path = f"{shared_path(spark, 'report')}.json"
    write_report(spark, report, path)
    update_report(spark, path, planted_report(report))
    now = image_report(found["manifest"], stored(damaged_images(found["images"]), "images"), found["masks"], SETTINGS)
    return verify_report(spark, path, now).select("pair", "same")
