"""The whole check of a submission: every verifier over stored tables, as rows of one report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import oracles, query
from ..sources.files import stored
from .collection import check_images, check_report, stored_collection
from .datasets import source_check
from .difference import dataset_checks
from .records import _INVARIANTS, HASHES, SQL_PLANTED, _check_sql, collection_check, compare_records, conflicts, dataset_invariants, manifest_invariants, planted, quality_verify

#: Parts with queries of their own (check, n), by the beginning of their checks' names.
PARTS = {"record_": "record_mismatch", "quality_": "quality_verify", "collection_": "collection_check", "dataset_": "dataset_checks", "image_": "image_collection"}


@query("submission_report", f"""WITH {SQL_PLANTED}, sr AS ({_check_sql('pl', _INVARIANTS)} UNION ALL SELECT 'repeated_id', count(*) - count(DISTINCT id) FROM pl
UNION ALL SELECT 'classes_missing_in_train', 9 - count(DISTINCT class) FILTER (split = 'train') FROM pl
UNION ALL {" UNION ALL ".join(f"SELECT 'leaked_{h}', count(*) FROM (SELECT {h} FROM pl GROUP BY 1 HAVING count(DISTINCT split) > 1)" for h in HASHES[:3])}
UNION ALL {" UNION ALL ".join(f"SELECT '{prefix}' || x.check, x.n FROM ({oracles()[name]}) AS x" for prefix, name in PARTS.items())}
UNION ALL SELECT 'report_' || pair, (NOT same)::INT FROM ({oracles()['report_verify']}) AS x UNION ALL SELECT 'source_mismatch', count(*) FILTER (NOT matches) FROM ({oracles()['source_check']}) AS x)
SELECT "check", n, n = 0 AS passed FROM sr""")
def submission_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks as rows (check, n, passed); a submission passes if every row does. The bytes are read once."""
    collection = stored_collection(spark, sf_dir)
    computed = collection["manifest"]
    found = stored(planted(computed), "planted")
    parts = {"record_": compare_records(found, computed)}
    parts |= {prefix: part(spark, sf_dir) for prefix, part in (("quality_", quality_verify), ("collection_", collection_check), ("dataset_", dataset_checks))}
    parts["image_"] = check_images(collection)
    parts["report_"] = check_report(collection).select(F.col("pair").alias("check"), (~F.col("same")).cast("long").alias("n"))
    rows = [
        manifest_invariants(found),
        dataset_invariants(found).filter("check = 'classes_missing_in_train'"),
        *(conflicts(found, h, "split", f"leaked_{h}") for h in HASHES[:3]),
        *(part.withColumn("check", F.concat(F.lit(prefix), "check")) for prefix, part in parts.items()),
        source_check(spark, sf_dir).agg(F.count_if(~F.col("matches")).alias("n")).select(F.lit("source_mismatch").alias("check"), "n"),
    ]
    # Each part is a few rows: taken one after the other, they need no plan of a hundred joins.
    told = [(r.check, r.n) for part in rows for r in part.select("check", "n").collect()]
    return spark.createDataFrame(told, "check string, n long").withColumn("passed", F.col("n") == 0)
