"""Sample tables: labels, pairing, joins, duplicates, splits, manifests and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.standins import SQL_SPLITS, documents, sample_class, splits
from ..plans.catalog import query, table

# Labels as a messy source would have them: the conversations of each document's id, and a second opinion on some.
SQL_LABELS = """
lab AS (SELECT doc_id AS id, quality + 2 * toxic AS class FROM labels UNION ALL SELECT doc_id, quality + 2 * toxic FROM labels WHERE doc_id % 5 = 0
        UNION ALL SELECT doc_id, (quality + 2 * toxic + 1) % 4 FROM labels WHERE doc_id % 35 = 0)
"""


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, class) with repeated rows and some contradictions."""
    base = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + 2 * F.col("toxic")).alias("class"))
    odd = base.filter("id % 35 = 0").select("id", F.expr("(class + 1) % 4").cast("int").alias("class"))
    return base.unionByName(base.filter("id % 5 = 0")).unionByName(odd)


def clean_labels(labels: DataFrame, id_col: str = "id", class_col: str = "class") -> DataFrame:
    """Trimmed, distinct labels; raises in the plan for a null or blank id or a null class."""
    name = F.trim(F.col(id_col).cast("string"))
    bad = name.isNull() | (name == "") | F.col(class_col).isNull()
    checked = F.when(bad, F.raise_error(F.lit("labels need an id and a class"))).otherwise(name)
    return labels.select(checked.alias(id_col), class_col).distinct()


@query("label_conflicts", f"WITH {SQL_LABELS} SELECT id, count(DISTINCT class) AS n_classes FROM lab GROUP BY id HAVING count(DISTINCT class) > 1")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_labels(spark, sf_dir).groupBy("id").agg(F.countDistinct("class").alias("n_classes")).filter("n_classes > 1")


@query("label_duplicates", f"WITH {SQL_LABELS} SELECT id, class, count(*) AS n_rows FROM lab WHERE id IN (SELECT id FROM lab GROUP BY id HAVING count(*) > 1) GROUP BY id, class")
def label_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of ids that come more than once, with how often."""
    each = raw_labels(spark, sf_dir).groupBy("id", "class").agg(F.count("*").alias("n_rows"))
    return each.withColumn("all", F.sum("n_rows").over(Window.partitionBy("id"))).filter("all > 1").drop("all")


# Three id sets: labelled, with text of 300 bytes or more, with an embedding.
SQL_SETS = """
l AS (SELECT doc_id AS id FROM labels), t AS (SELECT doc_id AS id FROM documents WHERE strlen(text) >= 300), e AS (SELECT vec_id AS id FROM embeddings)
"""


def id_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    texts = documents(spark, sf_dir).filter(F.octet_length("text") >= 300).select(F.col("doc_id").alias("id"))
    return labelled, texts, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))


@query("paired_ids", f"WITH {SQL_SETS} SELECT id FROM l INTERSECT SELECT id FROM t INTERSECT SELECT id FROM e")
def paired_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = id_sets(spark, sf_dir)
    return a.join(b, "id", "left_semi").join(c, "id", "left_semi").distinct()


@query("coverage_anti", f"""WITH {SQL_SETS} SELECT 'labels_without_text' AS side, count(*) AS n FROM l ANTI JOIN t USING (id) UNION ALL SELECT 'text_without_labels', count(*) FROM t ANTI JOIN l USING (id)
UNION ALL SELECT 'labels_without_vector', count(*) FROM l ANTI JOIN e USING (id) UNION ALL SELECT 'vector_without_labels', count(*) FROM e ANTI JOIN l USING (id)""")
def coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = id_sets(spark, sf_dir)
    pairs = {"labels_without_text": (a, b), "text_without_labels": (b, a), "labels_without_vector": (a, c), "vector_without_labels": (c, a)}
    rows = [x.join(y, "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(k).alias("side"), "n") for k, (x, y) in pairs.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("set_symmetric_difference", f"WITH {SQL_SETS} SELECT coalesce(l.id, t.id) AS id, CASE WHEN t.id IS NULL THEN 'only_labels' ELSE 'only_text' END AS side FROM l FULL JOIN t ON l.id = t.id WHERE l.id IS NULL OR t.id IS NULL")
def set_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = id_sets(spark, sf_dir)
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "id", "full_outer")
    return both.filter("in_a IS NULL OR in_b IS NULL").select("id", F.when(F.col("in_b").isNull(), "only_labels").otherwise("only_text").alias("side"))


@query("class_split_crosstab", f"""WITH {SQL_SPLITS} SELECT class, count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
count(*) FILTER (split = 'test') AS test FROM s GROUP BY class""")
def class_split_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = splits(spark, sf_dir).groupBy("class").pivot("split", ["train", "val", "test"]).count().na.fill(0)
    return g.select("class", (F.col("train") + F.col("val") + F.col("test")).alias("total"), "train", "val", "test")


@query("split_counts", f"WITH {SQL_SPLITS} SELECT split, count(*) AS n FROM s GROUP BY split")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query("stratified_split", f"WITH {SQL_SPLITS} SELECT doc_id, class, split FROM s")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits(spark, sf_dir)


def mark_duplicates(rows: DataFrame, key: list[str], id_col: str, class_col: str, empty: Column) -> DataFrame:
    """status, duplicate_of and group size of samples with equal content.

    Empty samples are excluded; groups whose labels differ are excluded whole; of other groups the smallest id stays.
    The groups are aggregated first and joined back, so that a hot group is combined map-side.
    """
    groups = rows.filter(~empty).groupBy(*key).agg(F.count("*").alias("group_size"), F.min(id_col).alias("first_id"), (F.min(class_col) != F.max(class_col)).alias("conflict"))
    out = rows.join(groups, key, "left")
    first = F.col("first_id")
    status = (
        F.when(empty, "excluded_empty_bytes").when(F.col("conflict"), "excluded_label_conflict").when(first != F.col(id_col), "excluded_content_duplicate").otherwise("included")
    )
    return out.withColumns({"status": status, "duplicate_of": F.when(~F.coalesce("conflict", F.lit(False)) & (first != F.col(id_col)), first)}).drop("first_id", "conflict")


SQL_DUPLICATES = """
c AS (SELECT doc_id, sha256(text) AS h, strlen(text) AS n, (doc_id % 9 + 1)::INT AS class FROM documents),
g AS (SELECT h, n, count(*) AS group_size, min(doc_id) AS first_id, count(DISTINCT class) > 1 AS conflict FROM c WHERE n > 0 GROUP BY h, n),
dup AS (SELECT doc_id, class, c.n, CASE WHEN c.n = 0 THEN 'excluded_empty_bytes' WHEN conflict THEN 'excluded_label_conflict' WHEN first_id <> doc_id THEN 'excluded_content_duplicate' ELSE 'included' END AS status,
        CASE WHEN NOT coalesce(conflict, false) AND first_id <> doc_id THEN first_id END AS duplicate_of, group_size FROM c LEFT JOIN g ON c.h = g.h AND c.n = g.n)
"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class, n (bytes), h (SHA-256 of the text), status, duplicate_of, group_size."""
    rows = documents(spark, sf_dir).select("doc_id", sample_class().alias("class"), F.octet_length("text").alias("n"), F.sha2("text", 256).alias("h"))
    return mark_duplicates(rows, ["h", "n"], "doc_id", "class", F.col("n") == 0)


@query("content_duplicates", f"WITH {SQL_DUPLICATES} SELECT doc_id, class, status, coalesce(duplicate_of, -1) AS duplicate_of, coalesce(group_size, 0) AS group_size FROM dup")
def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir)
    return rows.select("doc_id", "class", "status", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"), F.coalesce("group_size", F.lit(0)).alias("group_size"))


@query("status_counts", f"WITH {SQL_DUPLICATES} SELECT status, count(*) AS n FROM dup GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


# Quality flags: share of bytes that are no ASCII letters or blanks in the whole text, and in its first 1024 bytes.
SQL_QUALITY = r"""
q0 AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[A-Za-z ]', '', 'g')) AS u, length(regexp_replace(substr(text, 1, 1024), '[A-Za-z ]', '', 'g')) AS hu FROM documents),
q1 AS (SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE u / n END, 6) AS unknown_ratio, round(hu / 1024, 6) AS head_unknown_ratio FROM q0),
q AS (SELECT *, CASE WHEN unknown_ratio > 0.9 OR head_unknown_ratio > 0.5 THEN 'review' WHEN unknown_ratio > 0.5 THEN 'caution' ELSE 'normal' END AS quality,
      CASE WHEN unknown_ratio > 0.9 OR head_unknown_ratio > 0.5 THEN concat_ws(';', CASE WHEN unknown_ratio > 0.9 THEN 'unknown_ratio' END, CASE WHEN head_unknown_ratio > 0.5 THEN 'head_unknown_ratio' END)
           WHEN unknown_ratio > 0.5 THEN 'unknown_ratio' ELSE '' END AS reason FROM q1)
"""


def quality_level(unknown: Column, head: Column) -> tuple[Column, Column]:
    """(level, reason): review over 0.90 unknown or 0.50 of the head, caution over 0.50, else normal; strictly over."""
    much, head_much, some = unknown > 0.90, head > 0.50, unknown > 0.50
    level = F.when(much | head_much, "review").when(some, "caution").otherwise("normal")
    reasons = F.concat_ws(";", F.when(much, "unknown_ratio"), F.when(head_much, "head_unknown_ratio"))
    return level, F.when(much | head_much, reasons).when(some, "unknown_ratio").otherwise("")


def quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    odd = lambda t: F.char_length(F.regexp_replace(t, "[A-Za-z ]", ""))
    d = documents(spark, sf_dir).select(
        "doc_id", F.round(F.coalesce(F.try_divide(odd(text), F.char_length(text)), F.lit(0.0)), 6).alias("unknown_ratio"), F.round(odd(F.substring(text, 1, 1024)) / 1024, 6).alias("head_unknown_ratio")
    )
    level, reason = quality_level(F.col("unknown_ratio"), F.col("head_unknown_ratio"))
    return d.withColumns({"quality": level, "reason": reason})


@query("quality_flags", f"WITH {SQL_QUALITY} SELECT * FROM q")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(spark, sf_dir)


@query("dataset_join", f"""WITH {SQL_SPLITS}, {SQL_DUPLICATES}, {SQL_QUALITY} SELECT s.doc_id, s.class, split, concat_ws('/', 'images', split, 'class_' || s.class, s.doc_id || '.png') AS image, unknown_ratio, quality
FROM s JOIN dup ON dup.doc_id = s.doc_id JOIN q ON q.doc_id = s.doc_id WHERE status = 'included'""")
def dataset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included samples with split, expected path and quality: three tables, one row each per sample."""
    m = manifest(spark, sf_dir).filter("status = 'included'").select("doc_id")
    rows = splits(spark, sf_dir).join(m, "doc_id").join(quality_table(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "class", "split", expected_path("images").alias("image"), "unknown_ratio", "quality")


def expected_path(root: str) -> Column:
    return F.concat_ws("/", F.lit(root), "split", F.concat(F.lit("class_"), F.col("class")), F.concat(F.col("doc_id"), F.lit(".png")))


@query("manifest_features_left_join", """SELECT d.doc_id, coalesce(v.label, -1) AS label, v.vec_id IS NOT NULL AS has_vector FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id""")
def manifest_features_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.lit(True).alias("has"))
    out = documents(spark, sf_dir).select("doc_id").join(v, "doc_id", "left")
    return out.select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("has", F.lit(False)).alias("has_vector"))


@query("sample_records", f"""WITH {SQL_SPLITS} SELECT s.doc_id, class, split FROM s SEMI JOIN labels l ON l.doc_id = s.doc_id SEMI JOIN (SELECT doc_id FROM documents WHERE strlen(text) >= 300) t ON t.doc_id = s.doc_id""")
def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows that have a label and a file."""
    labelled, texts, _ = id_sets(spark, sf_dir)
    return splits(spark, sf_dir).join(labelled.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").join(texts.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")


@query("path_inventory_diff", """WITH e AS (SELECT 'p/' || doc_id AS path FROM documents), a AS (SELECT 'p/' || doc_id AS path FROM labels UNION SELECT 'p/x' || item_id FROM benchmark)
SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' ELSE 'extra' END AS side FROM e FULL JOIN a ON e.path = a.path WHERE e.path IS NULL OR a.path IS NULL""")
def path_inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are expected but missing, and present but not expected."""
    expected = documents(spark, sf_dir).select(F.concat(F.lit("p/"), F.col("doc_id")).alias("path"), F.lit(True).alias("e"))
    there = table(spark, sf_dir, "labels").select(F.concat(F.lit("p/"), F.col("doc_id")).alias("path"))
    there = there.union(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("p/x"), F.col("item_id")))).distinct().withColumn("a", F.lit(True))
    both = expected.join(there, "path", "full_outer").filter("e IS NULL OR a IS NULL")
    return both.select("path", F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("side"))


@query("removed_features_upsert", """WITH now AS (SELECT 'f' || (p_size % 40) AS feature, 'now' AS value FROM part), before AS (SELECT 'f' || (p_size % 60) AS feature, 'before' AS value FROM part),
u AS (SELECT *, 1 AS o FROM (SELECT DISTINCT * FROM before) UNION ALL SELECT *, 2 FROM (SELECT DISTINCT * FROM now))
SELECT feature, value FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY o DESC) AS r FROM u) WHERE r = 1""")
def removed_features_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    named = lambda m, v: part.select(F.concat(F.lit("f"), F.col("p_size") % m).alias("feature"), F.lit(v).alias("value")).distinct()
    return upsert(named(60, "before"), named(40, "now"), ["feature"])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; the new one replaces the old."""
    return old.join(new, key, "left_anti").unionByName(new)
