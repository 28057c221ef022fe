"""Literal cases of the parsing, sequence, n-gram, fusion, file and streaming operators."""

import math
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytemill.functions import bytestats, ranking
from bytemill.functions.bytestats import Samples, from_values
from bytemill.functions.hexdump import fixed_length, with_parsed
from bytemill.operators import datasets, fusion, history, listing, metrics, profile, records, tables, verification
from bytemill.sources import archives, config, files
from bytemill.streaming import ingest

DUMP = "10000000 7F 45 4C 46\n10000004 ?? xx 1\n10000008 C3"


def parsed(spark, text, dialect):
    return with_parsed(spark.createDataFrame([(text,)], "t string"), "t", {"x": dialect}).first().x


def as_samples(spark, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, values array<int>")
    return Samples(rows, from_values(), "values", ("i",))


def test_extract_dialect_keeps_invalid_tokens_as_unknown(spark):
    x = parsed(spark, DUMP, "extract")
    assert (x.n_total, x.n_known, x.n_unknown, x.n_invalid) == (8, 5, 1, 2)
    assert x["values"] == [0x7F, 0x45, 0x4C, 0x46, None, None, None, 0xC3]


def test_other_dialects(spark):
    assert parsed(spark, DUMP, "profile").n_total == 6
    assert parsed(spark, DUMP, "train").rejected and parsed(spark, DUMP, "image").rejected
    assert parsed(spark, "0000FFFF ??\n00010000 ??", "train").rejected
    assert not parsed(spark, "0000FFFF ??\n00010000 ??", "serve").rejected
    assert parsed(spark, "", "serve").rejected and parsed(spark, None, "image").rejected
    assert parsed(spark, "0000FFFF 9090C3", "profile")["values"] == [0x90, 0x90, 0xC3]
    assert parsed(spark, "0000FFFF 9090", "extract").n_invalid == 1


@pytest.mark.parametrize("dialect", ["profile", "extract", "train", "serve", "image"])
def test_dialects_against_plain_rules(spark, dialect):
    """Random dumps of every kind of line, token and line end."""
    rng = np.random.default_rng(3)
    pieces = ["00401000 ", "0040100G ", "DEADBEEF\t", "4D", "5a ", "?? ", "??", " ", "\n", "\r\n", "\t", "zz ", "é ", "1", "4D5A90", " 4D\n", "\x0b"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 14))) for _ in range(400)]
    hexed = lambda t: bool(re.fullmatch("[0-9a-fA-F]{2}", t))
    out = {r.t: r.x for r in with_parsed(spark.createDataFrame([(t,) for t in set(texts)], "t string"), "t", {"x": dialect}).collect()}
    for t in texts:
        if dialect in ("extract", "train", "serve"):
            tokens = []
            for line in t.replace("\r\n", "\n").split("\n"):
                words = re.findall(r"[^ \t\r\x0b\x0c]+", line)
                tokens += words[1:] if words and re.fullmatch("[0-9a-fA-F]{8}", words[0]) else words
        else:
            words = re.findall(r"[^ \t\r\n\x0b\x0c]+", re.sub(r"(?m)^[0-9a-fA-F]{8}[ \t]+", "", t.replace("\r\n", "\n")))
            solid = "".join(words).encode().decode("latin-1")
            pairs = [solid[i : i + 2] for i in range(0, len(solid), 2)]
            tokens = pairs if dialect == "image" or all(hexed(p) or p == "??" for p in pairs) else words
        good = [x for x in tokens if hexed(x) or x == "??"]
        n_invalid, known = len(tokens) - len(good), sum(map(hexed, tokens))
        kept = good if dialect == "profile" else tokens
        assert out[t]["values"] == [int(x, 16) if hexed(x) else None for x in kept], t
        assert (out[t].n_total, out[t].n_known, out[t].n_invalid) == (len(kept), known, n_invalid)
        assert out[t].rejected == {"train": n_invalid > 0 or known == 0, "serve": n_invalid > 0 or not tokens, "image": n_invalid > 0 or not tokens}.get(dialect, False)


@pytest.mark.parametrize("keep", ["head", "tail"])
def test_sequences(spark, keep):
    """The kernel against the column expression, over short, exact, long and empty samples."""
    lists = [[], [9], [1, None, 3, 4], list(range(4)), list(range(10)), [None] * 6]
    got = profile.sequences(as_samples(spark, *lists), keep, 4, 7).orderBy("i").collect()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>")
    want = rows.select("i", fixed_length(F.col("v"), 4, 7, keep).alias("x")).orderBy("i").collect()
    for g, w in zip(got, want, strict=True):
        assert (g["values"], g.n_known, g.n_truncated, g.n_padded) == (w.x["values"], sum(w.x.mask), w.x.n_truncated, w.x.n_padded)
    with pytest.raises(ValueError):
        fixed_length(F.col("a"), 0)
    with pytest.raises(ValueError):
        profile.sequences(as_samples(spark), keep, 0)


def test_ngrams_cross_neither_unknown_bytes_nor_samples(spark):
    rows = as_samples(spark, [255, 254, None, 7, 7, 7], [], [254, 7])
    assert {r.gram: r.global_count for r in bytestats.count_grams(rows, 2).collect()} == {0xFFFE: 1, 0x0707: 2, 0xFE07: 1}
    assert {r.gram: r.global_count for r in bytestats.count_grams(rows, 3).collect()} == {0x070707: 1}
    chosen = profile.selected_ngrams(rows, [0xFFFE, 0x0707, 0x0000], 2).orderBy("i").collect()
    assert [(r.total, r.counts, r.shares) for r in chosen] == [(3, [0, 2, 1], [0.0, 2 / 3, 1 / 3]), (0, [0, 0, 0], [0.0] * 3), (1, [0, 0, 0], [0.0] * 3)]


def test_top_k(spark):
    counts = spark.createDataFrame([(0, 2), (2, 9), (3, 9), (5, 1)], "gram long, global_count long")
    assert [(r.gram, r.rank) for r in profile.top_k(counts, 3, 256).orderBy("rank").collect()] == [(2, 1), (3, 2), (0, 3)]
    for k in (0, 6, 7):
        assert [tuple(r) for r in profile.top_k(counts, k, 6).orderBy("rank").collect()] == [(0, 2, 1), (1, 0, 2), (2, 9, 3), (3, 9, 4), (4, 0, 5), (5, 1, 6)]


def test_profiles(spark):
    rows = as_samples(spark, [], [None, None], [8, 8, 8], [0, 64, 128, 255, None])
    out = profile.profiles(rows).orderBy("i").collect()
    assert [(r.n_total, r.n_known, r.entropy) for r in out] == [(0, 0, 0.0), (2, 0, 0.0), (3, 3, 0.0), (5, 4, 2.0)]
    assert all(r.mean == r.std == r.zero_ratio == r.printable_ratio == r.high_ratio == 0.0 for r in out[:2])
    assert (out[3].mean, out[3].zero_ratio, out[3].printable_ratio, out[3].high_ratio) == (111.75, 0.25, 0.25, 0.5)


@pytest.mark.parametrize("n", [0, 1, 17, 1023, 1024, 1025, 2048, 5000])
def test_grid_against_a_plain_loop(spark, n):
    rng = np.random.default_rng(n)
    values = [None if rng.random() < 0.2 else int(rng.integers(0, 256)) for _ in range(n)]
    row = profile.grids(as_samples(spark, values)).first()
    for j in range(1024):
        part = values[j * n // 1024 : (j + 1) * n // 1024]
        known = [v for v in part if v is not None]
        assert row.pixel[j] == ((sum(known) + len(known) // 2) // len(known) if known else 0)
        assert row["mask"][j] == ((255 * (len(part) - len(known)) + len(part) // 2) // len(part) if part else 255)
        assert (row.n[j], row.n_known[j]) == (len(part), len(known))


def test_ranks_and_percentiles(spark):
    rng = np.random.default_rng(4)
    data = [(k, float(v)) for k in "abc" for v in rng.choice([rng.normal(), 5.0, rng.normal() * 100], {"a": 1, "b": 2, "c": 500}[k])] + [("d", 3.0)] * 40 + [("a", None)]
    got = {r.k: r for r in ranking.percentiles(spark.createDataFrame(data, "k string, v double"), "k", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for k in "abcd":
        own = [v for x, v in data if x == k and v is not None]
        assert got[k].n == len(own) and math.isclose(got[k].p50, np.percentile(own, 50)) and math.isclose(got[k].p95, np.percentile(own, 95))
    rows = spark.createDataFrame([(int(x),) for x in rng.permutation(300) ** 2], "x long")
    ranks = history.with_next_ids(rows, "x", 1000).orderBy("x").collect()
    assert [r.id for r in ranks] == list(range(1001, 1301))


def test_duplicates_and_conflicts(spark):
    rows = spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "x", 1), ("c", 1, "y", 1), ("d", 2, "y", 1), ("e", 1, "z", 0)], "id string, class int, h string, n int")
    out = {r.id: r.status for r in tables.mark_duplicates(rows, ["h", "n"], "id", "class", F.col("n") == 0).collect()}
    assert out == {"a": "included", "b": "excluded_content_duplicate", "c": "excluded_label_conflict", "d": "excluded_label_conflict", "e": "excluded_empty_bytes"}


def test_normalising_and_weights(spark):
    rows = spark.createDataFrame([([0.0],), ([4.0],), ([8.0],)], "v array<double>")
    stats = fusion.column_stats(rows, "v")
    for options in ({"stats": stats}, {"expected": (0.0, 8.0)}):
        assert [r.x for r in rows.select(fusion.normalize(F.col("v"), "minmax", **options).alias("x")).collect()] == [[0.0], [0.5], [1.0]]
    assert fusion.adaptive_weights({"a": 3.0}, "uniform") == {"a": 1.0}
    for method in ("uniform", "variance_softmax", "variance_proportional"):
        assert math.isclose(sum(fusion.adaptive_weights({"a": 0.1, "b": 2.0}, method).values()), 1.0)
    with pytest.raises(ValueError):
        fusion.adaptive_weights({"a": 1.0}, temperature=0)
    with pytest.raises(ValueError):
        fusion.normalize(F.col("v"), "minmax", expected=(1.0, 1.0))
    assert fusion.slices({"byte_seq": 8, "entropy": 1, "ngram": 10}) == {"byte_seq": (0, 8), "entropy": (8, 9), "ngram": (9, 19)}


def test_perfect_scores(spark):
    rows = spark.createDataFrame([(i, i) for i in range(9)], "label int, predicted int")
    f1 = metrics.f1_by_class(metrics.confusion(rows), 9)
    assert f1.agg(F.avg("f1"), F.sum("tp")).first()[:] == (1.0, 9)


def test_retention(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "id long")
    assert history.keep_newest(rows, 0).count() == 0
    assert sorted(r.id for r in history.keep_newest(rows, 2).collect()) == [3, 4]
    assert history.keep_newest(rows, 9).count() == 5
    assert history.page(rows, 0).count() == 5


def test_listing_profile(spark):
    text = ".text:00401000 8B EC mov eax\n.text:00401002 90 NOP\nheader:00401003 ?? fld x\nproc near"
    row = listing.profile(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row.n_lines, row.n_instructions, row.n_proc, row.opcode_count_mov, row.opcode_count_nop) == (4, 3, 1, 1, 1)
    assert (row.section_lines_text, row.section_lines_header) == (2, 1)
    assert listing.profile(spark.createDataFrame([(None,)], "t string"), "t").first().n_lines == 0


def test_display_keeps_large_pages(spark, tmp_path):
    sizes = {1: None, 2: 0, 3: 1023, 4: 1024, 5: (1 << 20) - 1, 6: 1 << 20, 7: 5 << 19}
    rows = spark.createDataFrame(list(sizes.items()), "page_id long, n int").selectExpr("page_id", "'http://a/<b>' AS url", "repeat('x', n) AS html")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    shown = {r.page_id: r["size"] for r in listing.display_format(spark, str(tmp_path)).collect()}
    assert shown == {1: None, 2: "0 B", 3: "1023 B", 4: "1.00 KB", 5: "1024.00 KB", 6: "1.00 MB", 7: "2.50 MB"}


def test_constant_columns_count_null_as_a_value(spark):
    rows = spark.createDataFrame([(1, None, None, 2), (1, None, 5, 3)], "a int, b int, c int, d int")
    assert {r.column: r.constant for r in verification.constant_columns(rows).collect()} == {"a": True, "b": True, "c": False, "d": False}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.bytes", "00401000 4D 5A")
        z.writestr("y/one.bytes", "00401000 00")
        z.writestr("y/one.asm", "mov")
        z.writestr("readme.txt", "no")
        z.writestr("../two.bytes", "no")
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.entry, r.duplicate) for r in rows) == [("x/one.bytes", False), ("y/one.asm", False), ("y/one.bytes", True)]


def test_csv_and_publish(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("Id,Class\n a ,1\nb,2\n")
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "labels.csv")).collect()] == [("a", 1), ("b", 2)]
    (tmp_path / "rows.csv").write_text("﻿Id,x\n a , 1\nb,\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_rows(spark, str(tmp_path / "rows.csv")).collect()] == [("a", "1"), ("b", "")]
    at = str(tmp_path / "t")
    assert files.publish(spark.range(3), at) == 3 and files.publish(spark.range(5), at) == 5
    with pytest.raises(ValueError):
        files.publish(spark.range(0), at)
    with pytest.raises(ValueError):
        files.publish(spark.range(9), at, check=lambda t: t.count() < 9)
    assert files.read_published(spark, at).count() == 5


def test_uploads_are_appended_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/sample.bytes").write_text("00401000 4D 5A 90 00")
    (tmp_path / "in/bad.bytes").write_text("MZ not hex")
    for _ in range(2):
        ingest.append_history(ingest.uploads(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert [(r.sample_id, r.n_known) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("sample.bytes", 4)]


def test_strict_reading_and_extracting(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/one.bytes", "00401000 4D")
        z.writestr("in/two.bytes", "00401000 5A")
        z.writestr("out/three.bytes", "00401000 90")
    rows = archives.strict_archives(spark, str(tmp_path))
    chosen = archives.select_entries(rows, "in/", (".bytes",))
    at = str(tmp_path / "out")
    assert archives.extract(chosen, at) == 2 and archives.extract(rows, at) == 1 and archives.extract(rows, at) == 0
    with pytest.raises(ValueError):
        archives.extract(chosen.withColumn("content", F.lit("x").cast("binary")), at)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("again/one.bytes", "00401000 4D")
    with pytest.raises(Exception, match="repeated entry"):
        archives.strict_archives(spark, str(tmp_path)).collect()


def test_reports_and_features(spark, tmp_path):
    at = str(tmp_path / "features")
    ids = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id int, x array<double>")
    files.write_features(at, {"samples": ids.select("id"), "entropy": ids.withColumnRenamed("x", "entropy"), "ngram_2": ids.withColumnRenamed("x", "g2")}, {"ngrams": [2], "samples": 3})
    rows, summary = files.read_features(spark, at, ("samples", "entropy"))
    assert summary == {"ngrams": [2], "samples": 3} and sorted(tuple(r) for r in rows.collect()) == [(i, [float(i)], [float(i)]) for i in range(3)]
    assert files.update_report(spark, f"{at}/summary.json", {"samples": 4, "note": "é"}, ("ngrams",)) == {"samples": 4, "note": "é"}
    assert files.read_report(spark, f"{at}/summary.json") == {"samples": 4, "note": "é"} and files.read_report(spark, f"{at}/none.json") == {}
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "one.json").write_text('{"a": 1,\n "b": {"c": [1]}}')
    assert files.read_json_object(spark, str(tmp_path / "one.json")).first().a == 1
    with pytest.raises(Exception, match="JSON object"):
        files.read_json_object(spark, str(tmp_path / "list.json")).collect()
    assert files.read_checked(spark, str(tmp_path / "none.csv"))[0] is None
    (tmp_path / "some.csv").write_text("Id,x\n007,1\n")
    rows, errors = files.read_checked(spark, str(tmp_path / "some.csv"), ("Id", "y"))
    assert rows.first().Id in ("7", "007") and len(errors) == 1


def test_history_tables(spark):
    history.create_table(spark, "records_test")
    history.create_table(spark, "records_test")
    assert history.table_exists(spark, "records_test") and not history.table_exists(spark, "records_none")
    spark.sql("DROP TABLE records_test")
    rows = spark.createDataFrame([("2024-03-01 00:00:00",), ("2024-02-29 23:59:59",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert history.keep_days(rows, 2, F.lit("2024-03-03").cast("date")).count() == 1 and history.keep_days(rows, 0).count() == 0


def test_sound_manifests_pass(spark):
    rows = records.records(spark, "/root/testdata/sf0.001")
    assert records.manifest_invariants(rows.filter("byte_token_count > 0")).filter("n > 0").count() == 0
    assert records.compare_records(rows, rows).filter("n > 0").count() == 0
    with pytest.raises(ValueError):
        records.dataset_invariants(rows.drop("split"))


def test_settings():
    got = config.load_config('{"top_k": 4, "paths": {"out": "x"}}', {"top_k": 9, "paths.out": "y", "seed": None})
    assert got == {"top_k": 9, "paths": {"out": "y"}}
    assert [config.resolve_path(p, "/a/b") for p in ("c\\d", "/x", "hdfs://h/x")] == ["/a/b/c/d", "/x", "hdfs://h/x"]
    assert config.top_k_setting([5], (1, 2)) == 5 and config.top_k_setting([5, 6], (1, 2)) == {1: 5, 2: 6}
    assert [config.resolve_top_k(s, 1, 256) for s in (None, 0, 300, 7, {"1": 8}, {2: 3})] == [256, 256, 256, 7, 8, 256]
    assert config.resolve_top_k(None, 2, 65536) == 1024
    with pytest.raises(ValueError):
        config.load_config("[]")
    with pytest.raises(ValueError):
        config.top_k_setting([1, 2, 3], (1, 2))


def test_runs_inventories_and_marks(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.5), (1, 0.25)], "epoch int, f1 double")
    at = str(tmp_path / "run")
    files.write_run(at, {"epochs": 2}, rows, {"best": 0.5})
    assert files.read_report(spark, f"{at}/metrics.json") == {"best": 0.5}
    with pytest.raises(ValueError):
        files.write_run(at, {}, rows, {})
    files.write_csv(rows.coalesce(1), str(tmp_path / "bom"), bom=True)
    assert next((tmp_path / "bom").glob("*.csv")).read_bytes().startswith("\ufeffepoch".encode())
    assert [tuple(r) for r in files.read_rows(spark, str(tmp_path / "bom")).orderBy("epoch").collect()] == [("1", "0.25"), ("2", "0.5")]
    for name in ("train/a.png", "val/B.PNG", "val/notes.txt"):
        (tmp_path / "images" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "images" / name).write_text("x")
    found, others = files.inventory(spark, str(tmp_path / "images"), ".png")
    assert sorted(r.path for r in found.collect()) == ["train/a.png", "val/B.PNG"] and others == 1


def test_vectors_of_another_size_raise(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert rows.limit(1).select(datasets.fixed_size(F.col("v"), 2).alias("v")).first().v == [1.0, 2.0]
    with pytest.raises(Exception, match="is expected, not of"):
        rows.select(datasets.fixed_size(F.col("v"), 3)).collect()
