"""Scores of a classifier: softmax, top five, confusion matrix, F1, cross-entropy, class weights, latencies and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.ranking import percentiles
from ..functions.standins import SQL_SPLITS, splits
from ..plans.catalog import query, table

CLASSES = 10


def softmax(logits: Column) -> Column:
    """exp(x - max) over its sum, in array order."""

    def mass(v: Column) -> Column:
        return let(F.transform(v, lambda x: F.exp(x - F.array_max(v))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s)))

    return let(logits, mass)


def argmax(values: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top(scores: Column, k: int = 5) -> Column:
    """The k best as structs (class_id, score), ties by class."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("order"), i.alias("class_id"), s.alias("score"))))
    return F.slice(F.transform(ranked, lambda r: F.struct(r["class_id"].alias("class_id"), r["score"].alias("score"))), 1, k)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in scores: the first ten places of the embedding, ten times, as logits; the label is the true class."""
    logits = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, CLASSES), lambda x: x * 10)
    return table(spark, sf_dir, "embeddings").filter("label IS NOT NULL").select("vec_id", "label", softmax(logits).alias("scores"))


SQL_SCORED = """
l AS (SELECT vec_id, label, unnest(embedding[1:10])::DOUBLE * 10 AS z, generate_subscripts(embedding[1:10], 1)::INT - 1 AS k FROM embeddings WHERE label IS NOT NULL),
s AS (SELECT vec_id, label, k, z, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, k) AS r FROM l WINDOW w AS (PARTITION BY vec_id)),
pred AS (SELECT vec_id, label, max(k) FILTER (r = 1) AS predicted, max(p) FILTER (k = label) AS p FROM s GROUP BY ALL)
"""


@query("softmax_top5", f"WITH {SQL_SCORED} SELECT vec_id, r::INT AS rank, k AS class_id, round(p, 6) AS score FROM s WHERE r <= 5")
def softmax_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("vec_id", F.posexplode(top(F.col("scores"))).alias("place", "t"))
    return rows.select("vec_id", (F.col("place") + 1).alias("rank"), "t.class_id", F.round("t.score", 6).alias("score"))


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("predicted", argmax(F.col("scores")))


@query("confusion_matrix", f"WITH {SQL_SCORED} SELECT label, predicted, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(predictions(spark, sf_dir))


def f1_by_class(matrix: DataFrame, classes: int) -> DataFrame:
    """class, tp, n_label, n_predicted, f1 of all classes; 0 where a class has neither labels nor predictions."""
    sides = matrix.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(1).alias("l"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("l"), F.lit(1).alias("p")))).alias("x"), "n", (F.col("label") == F.col("predicted")).alias("hit"))
    per = sides.groupBy("x.class").agg(
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.l")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("x.l")).alias("n_label"), F.sum(F.col("n") * F.col("x.p")).alias("n_predicted")
    )
    every = matrix.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n_label") + F.col("n_predicted")), F.lit(0.0))
    return every.join(per, "class", "left").na.fill(0).withColumn("f1", f1)


SQL_F1 = f"""{SQL_SCORED},
k AS (SELECT k, (SELECT count(*) FROM pred WHERE label = k AND predicted = k) AS tp, (SELECT count(*) FROM pred WHERE label = k) AS n_label,
      (SELECT count(*) FROM pred WHERE predicted = k) AS n_predicted FROM (SELECT unnest(range(0, 10))::INT AS k)),
f AS (SELECT k AS class, tp, n_label, n_predicted, CASE WHEN n_label + n_predicted = 0 THEN 0 ELSE 2 * tp / (n_label + n_predicted) END AS f1 FROM k)"""


@query("f1_by_class", f"WITH {SQL_F1} SELECT class, tp, n_label, n_predicted, round(f1, 9) AS f1 FROM f")
def f1_by_class_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f1_by_class(confusion_matrix(spark, sf_dir), CLASSES).withColumn("f1", F.round("f1", 9))


@query("accuracy_macro_f1", f"WITH {SQL_F1} SELECT sum(n_label)::BIGINT AS samples, round(sum(tp) / sum(n_label), 9) AS accuracy, round(avg(f1), 9) AS macro_f1 FROM f")
def accuracy_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = f1_by_class(confusion_matrix(spark, sf_dir), CLASSES)
    return per.agg(F.sum("n_label").alias("samples"), F.round(F.sum("tp") / F.sum("n_label"), 9).alias("accuracy"), F.round(F.avg("f1"), 9).alias("macro_f1"))


@query("cross_entropy", f"WITH {SQL_SCORED} SELECT round(avg(-ln(p)), 6) AS loss, count(*) AS n FROM pred")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(F.round(F.avg(-F.log(F.get("scores", F.col("label")))), 6).alias("loss"), F.count("*").alias("n"))


@query("class_weights", f"WITH {SQL_SPLITS} SELECT class, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM s WHERE split = 'train' GROUP BY class")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N / (classes * n) of each class of the training split; the window runs over one row a class."""
    per = splits(spark, sf_dir).filter("split = 'train'").groupBy("class").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return per.select("class", "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 9).alias("weight"))


@query("latency_percentiles", """SELECT event_type AS kind, count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms
FROM events WHERE event_id % 35 >= 5 GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles by linear interpolation; the first five of every 35 measurements are warm-up."""
    rows = table(spark, sf_dir, "events").filter("event_id % 35 >= 5")
    g = percentiles(rows, "event_type", "value", {"p50_ms": 0.5, "p95_ms": 0.95})
    return g.select(F.col("event_type").alias("kind"), "n", F.round("mean", 6).alias("mean_ms"), F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"))


# Stand-in runs: a conversation's turns are epochs, text lengths are presentations, their remainder is the score.
SQL_EPOCHS = "e AS (SELECT conv_id AS run, turn AS epoch, length(text)::BIGINT AS presented, round(length(text) % 17 / 17, 6) AS f1 FROM conversations)"


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("epoch"), n.cast("long").alias("presented"), F.round(n % 17 / 17, 6).alias("f1"))


@query("best_epoch", f"WITH {SQL_EPOCHS} SELECT run, epoch, f1 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, epoch) AS r FROM e) WHERE r = 1")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First epoch with a run's best score: one aggregate, combined map-side."""
    best = epochs(spark, sf_dir).groupBy("run").agg(F.max_by(F.struct("epoch", "f1"), F.struct("f1", F.negative("epoch"))).alias("x"))
    return best.select("run", "x.epoch", "x.f1")


@query("cumulative_presentations", f"WITH {SQL_EPOCHS} SELECT run, epoch, sum(presented) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative FROM e")
def cumulative_presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return epochs(spark, sf_dir).select("run", "epoch", F.sum("presented").over(running).alias("cumulative"))


@query("run_totals", f"WITH {SQL_EPOCHS} SELECT run, count(*) AS epochs, sum(presented)::BIGINT AS presented, max(f1) AS best_f1 FROM e GROUP BY run")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs(spark, sf_dir).groupBy("run").agg(F.count("*").alias("epochs"), F.sum("presented").alias("presented"), F.max("f1").alias("best_f1"))


#: What runs must share to be compared: the data, the training settings and the machine.
RUN_KEYS = {
    "data": ("manifest_sha256", "seed", "unique_samples"),
    "arguments": ("epochs", "batch_size", "lr", "weight_decay", "label_smoothing"),
    "machine": ("device", "hardware", "threads", "torch"),
}


def comparability(runs: DataFrame, group: str) -> DataFrame:
    """For each group of runs: how many of its keys differ between runs, by kind, and whether the runs are comparable.

    A missing key is a value of its own. Minima and maxima of the keys' texts decide, which combine map-side.
    """

    def differs(key: str) -> Column:
        text = F.col(key).cast("string")
        return ((F.min(text) != F.max(text)) | ((F.count(key) > 0) & (F.count(key) < F.count("*")))).cast("int")

    counts = {kind: sum((F.coalesce(differs(k), F.lit(0)) for k in keys[1:]), F.coalesce(differs(keys[0]), F.lit(0))) for kind, keys in RUN_KEYS.items()}
    out = runs.groupBy(group).agg(F.count("*").alias("runs"), *(c.alias(f"{kind}_differ") for kind, c in counts.items()))
    return out.withColumn("comparable", sum((F.col(f"{k}_differ") for k in list(RUN_KEYS)[1:]), F.col(f"{list(RUN_KEYS)[0]}_differ")) == 0)


_RUN_COLUMNS = {
    "manifest_sha256": "c_nationkey // 7", "seed": "42", "unique_samples": "c_nationkey // 7 * 10", "epochs": "30", "batch_size": "32", "lr": "CASE WHEN c_nationkey % 3 = 1 AND c_custkey % 5 = 0 THEN 0.01 ELSE 0.001 END",
    "weight_decay": "0.05", "label_smoothing": "CASE WHEN c_nationkey % 4 = 2 AND c_custkey % 3 = 0 THEN NULL ELSE 0.1 END", "device": "'cpu'", "hardware": "c_nationkey % 2", "threads": "2", "torch": "CASE WHEN c_custkey % 50 = 0 THEN 'b' ELSE 'a' END",
}


def stand_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, grouped by nation: some groups agree in all keys, others differ in some."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("run_group"), *(F.expr(x.replace("//", "DIV")).alias(k) for k, x in _RUN_COLUMNS.items()))


def _differ_sql(kind: str) -> str:
    return " + ".join(f"(count(DISTINCT {k}) + max(({k} IS NULL)::INT) > 1)::INT" for k in RUN_KEYS[kind])


@query("run_comparability", f"""WITH r AS (SELECT c_nationkey AS run_group, {", ".join(f"{x} AS {k}" for k, x in _RUN_COLUMNS.items())} FROM customer),
g AS (SELECT run_group, count(*) AS runs, {", ".join(f"({_differ_sql(k)})::INT AS {k}_differ" for k in RUN_KEYS)} FROM r GROUP BY run_group)
SELECT *, {" + ".join(f"{k}_differ" for k in RUN_KEYS)} = 0 AS comparable FROM g""")
def run_comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparability(stand_in_runs(spark, sf_dir), "run_group")


@query("attention_long", """WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::INT - 1 AS i FROM embeddings)
SELECT vec_id, i // 16 AS head, i % 16 AS key, round(v, 6) AS value, round(max(v) OVER (PARTITION BY vec_id), 6) AS most FROM a""")
def attention_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of heads by keys as rows (x, y, value) with the matrix's maximum; the maximum comes from the array, without a window."""
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("i", "v"), F.array_max(v).alias("m"))
    return rows.select("vec_id", F.floor(F.col("i") / 16).cast("int").alias("head"), (F.col("i") % 16).alias("key"), F.round("v", 6).alias("value"), F.round("m", 6).alias("most"))
