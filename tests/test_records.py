"""Plans of the verifiers, and scores of groups without variance."""

import hashlib
import os

import numpy as np
import pytest

from bytemill.operators import collection, fusion, records, submission, verification
from bytemill.sources import files


def test_a_submission(spark, monkeypatch):
    """Every planted kind of fault is told; one grid kernel serves the manifest, the images, the masks and all that is checked of them."""
    calls = []
    grids = collection.grids
    monkeypatch.setattr(collection, "grids", lambda *a: (calls.append(a), grids(*a))[1])
    monkeypatch.setattr(records, "grids", lambda *a: pytest.fail("the bytes are read again"))
    told = {r.check: r.n for r in submission.submission_report(spark, "/root/testdata/sf0.01").collect()}
    assert len(told) > 100 and len(calls) == 1
    for name in ("record_pixel_sha256", "quality_reason", "quality_unknown_ratio", "collection_missing_file", "dataset_mask", "dataset_repeated_id", "dataset_null_id", "unsafe_id", "image_hash_mismatch", "report_output.split_counts", "source_mismatch"):
        assert told[name] > 0, name
    assert told["quality_head_unknown_ratio"] == told["missing_id"] == told["report_method"] == 0


def test_scores_of_groups_without_variance():
    """A score is never 0, so weights in proportion to scores stay defined."""
    flat = fusion.variance_score([0.0, 0.0])
    assert flat == 1e-6
    assert fusion.adaptive_weights({"a": flat, "b": flat}, "variance_proportional") == {"a": 0.5, "b": 0.5}
    assert fusion.adaptive_weights({"a": flat, "b": 3 * flat}, "variance_proportional") == {"a": 0.25, "b": 0.75}


def parts(at):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(at) for f in names if f.startswith("part-") and "/versions/" in d)


def test_a_corrupted_staged_file_is_refused(spark, tmp_path, monkeypatch):
    """Files that lose, change or repeat rows between their writing and their reading back are never published."""
    at = str(tmp_path / "t")
    rows = spark.range(100).selectExpr("id", "id % 3 = 0 AS b", "array(id, null) AS a", "map('k', id) AS m", "CAST(null AS string) AS s").repartition(4)
    assert files.publish(rows, at) == 100 and files.verify_published(spark, at).count() == 0
    stage = files._stage
    for fault in ("lost", "changed", "repeated"):

        def staged(table, where, fault=fault):
            stage(table, where)
            if fault == "lost":
                os.remove(parts(where)[0])
            else:
                one = spark.read.parquet(parts(where)[0]).limit(5).cache()
                (one.selectExpr("id + 1 AS id", "b", "a", "m", "s") if fault == "changed" else one).write.mode("append").parquet(where)

        monkeypatch.setattr(files, "_stage", staged)
        with pytest.raises(ValueError, match="read back"):
            files.publish(rows, at)
        assert files.read_published(spark, at).count() == 100 and len({os.path.dirname(p) for p in parts(at)}) == 1
    monkeypatch.setattr(files, "_stage", stage)
    assert files.publish(rows.limit(0), at, least_rows=0) == 0 and files.verify_published(spark, at).count() == 0


def test_published_files_are_known_by_their_contents(spark, tmp_path):
    at = str(tmp_path / "t")
    files.publish(spark.range(100).repartition(4), at)
    lost, changed = parts(at)[:2]
    os.remove(lost)
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "other"))
    other = next(f for f in os.listdir(tmp_path / "other") if f.startswith("part-"))
    os.replace(tmp_path / "other" / other, changed)
    os.remove(os.path.join(os.path.dirname(changed), f".{os.path.basename(changed)}.crc"))
    spark.range(2).coalesce(1).write.mode("append").parquet(os.path.dirname(changed))
    told = {r.file: r.fault for r in files.verify_published(spark, at).collect()}
    assert told.pop(os.path.basename(lost)) == "missing" and told.pop(os.path.basename(changed)) == "changed" and list(told.values()) == ["extra"]


def test_fused_sets_are_published_whole(spark, tmp_path):
    at = str(tmp_path / "fused")
    rows = spark.createDataFrame([("a", [1.0, 2.0], [3.0]), ("b", [4.0, 5.0], [6.0])], "id string, x array<double>, y array<double>")
    assert fusion.publish_fused(rows, {"x": "x", "y": "y"}, {"x": 2, "y": 1}, {"x": 0.5, "y": 2.0}, at) == 2
    table, facts = fusion.read_fused(spark, at)
    assert {r.id: r.fused for r in table.collect()} == {"a": [0.5, 1.0, 6.0], "b": [2.0, 2.5, 12.0]}
    assert facts == {"weights": {"x": 0.5, "y": 2.0}, "slices": {"x": [0, 2], "y": [2, 3]}, "size": 3}
    with pytest.raises(ValueError):
        fusion.publish_fused(rows, {"x": "x", "y": "y"}, {"x": 2, "y": 2}, {"x": 1.0, "y": 1.0}, at)
    assert fusion.read_fused(spark, at)[1] == facts


def test_column_statistics(spark):
    """Places of ragged arrays with nulls, over many tasks, far from 0."""
    rng = np.random.default_rng(3)
    data = [[float(x) + 1e6 for x in rng.normal(size=rng.integers(0, 6))] for _ in range(500)] + [None, [None, 1e6]]
    stats = fusion.column_stats(spark.createDataFrame([(x,) for x in data], "v array<double>").repartition(9), "v")
    for j in range(5):
        own = np.array([x[j] for x in data if x and len(x) > j and x[j] is not None])
        assert np.allclose([stats.low[j], stats.high[j], stats.mean[j], stats.variance[j]], [own.min(), own.max(), own.mean(), own.var()], rtol=1e-9)
    with pytest.raises(ValueError, match="no values"):
        fusion.column_stats(spark.createDataFrame([], "v array<double>"), "v")


def test_missing_files_have_no_hash(spark):
    files_ = spark.createDataFrame([("a", b"x")], "path string, content binary")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, at string")
    assert verification.fill_hashes(rows.filter("id = 1"), files_, "at", "h").first().h == hashlib.sha256(b"x").hexdigest()
    with pytest.raises(Exception, match="no file at b"):
        verification.fill_hashes(rows, files_, "at", "h").collect()
