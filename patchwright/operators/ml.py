"""Training: scaling on training rows, one weighted binary classifier per class, grids, run records."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import seeded_int
from ..functions.labels import class_weight, evaluated_roles, role
from ..schema import require_features
from ..sources.storage import materialise
from ..sources.tables import json_documents, parquet_or_none, write_json
from . import forest, metrics, multilabel, packed
from .accounting import measured


@dataclass(frozen=True)
class Run:
    """One job of a ladder: a regime, a fold and a learner with its parameters."""

    regime: str
    fold: str | None = None
    learner: str = "lr"
    seed: int = 42
    max_iter: int = 50
    reg_param: float = 0.01
    num_trees: int = 50
    max_depth: int = 10
    threads: int = 6

    @property
    def run_id(self) -> str:
        fold = "" if self.fold is None else f"_{self.fold}"
        tuned = f"reg{self.reg_param:g}" if self.learner == "lr" else f"t{self.num_trees}d{self.max_depth}"
        return f"{self.regime}{fold}_{self.learner}_{tuned}_seed{self.seed}"


def standardise(df: DataFrame, columns: Sequence[str], is_train) -> DataFrame:
    """The columns less their training mean over their training (n - 1) deviation; 0 where that is 0. One row of statistics is broadcast."""
    stats = df.where(is_train).agg(*(f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))))
    scaled = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).select(*(scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns))


def feature_vectors(df: DataFrame, columns: Sequence[str], metadata: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep and `features`, scaled by the rows with role train. The leak guard looks at the columns first."""
    assembled = VectorAssembler(inputCols=require_features(columns, metadata), outputCol="raw").transform(df).select(*keep, "raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(assembled.where("role = 'train'"))
    return scaler.transform(assembled).drop("raw")


def class_counts(df: DataFrame, labels: Sequence[str]) -> dict[str, tuple[int, int]]:
    """label -> (rows, positives) of the training rows, for all labels in one pass."""
    row = df.where("role = 'train'").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in labels)).first()
    return {c: (row["n"], int(row[c])) for c in labels}


def estimator(run: Run, label: str):
    common = dict(featuresCol="features", labelCol=label, weightCol="weight", probabilityCol="probability")
    if run.learner == "lr":
        return LogisticRegression(maxIter=run.max_iter, regParam=run.reg_param, elasticNetParam=0.0, standardization=True, **common)
    if run.learner == "rf":
        return RandomForestClassifier(numTrees=run.num_trees, maxDepth=run.max_depth, seed=run.seed, **common)
    raise ValueError(f"unknown learner {run.learner}")


PREDICTIONS = "patch_id string, role string, label_idx int, label_name string, true_label double, probability double"


def fitted(vectors: DataFrame, labels: Sequence[str], run: Run, counts: dict[str, tuple[int, int]]) -> dict[str, object]:
    """label -> model of every label with a training positive, in a bounded number of threads."""
    spark = vectors.sparkSession

    def one(c: str):
        n, pos = counts[c]
        weighted = vectors.withColumn("weight", class_weight(F.col(c), F.lit(n), F.lit(pos))).withColumn(c, F.col(c).cast("double"))
        return c, estimator(run, c).fit(weighted.where("role = 'train'"))

    with ThreadPoolExecutor(max_workers=run.threads) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(one), [c for c in labels if counts[c][1] > 0]))


def scored(vectors: DataFrame, models: dict[str, object], labels: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long predictions of all models, from one pass over the vectors."""
    if not models:
        return vectors.sparkSession.createDataFrame([], PREDICTIONS)
    out, cells = vectors, []
    for k, c in enumerate(labels):
        if c in models:
            out = models[c].setProbabilityCol(f"_p{k}").setRawPredictionCol(f"_r{k}").setPredictionCol(f"_y{k}").transform(out)
            value = vector_to_array(F.col(f"_p{k}"))[1]
            cells.append(F.struct(F.lit(k).alias("label_idx"), F.lit(names[k]).alias("label_name"), F.col(c).cast("double").alias("true_label"), value.alias("probability")))
    return out.select(F.col("patch_id").cast("string").alias("patch_id"), "role", F.inline(F.array(*cells)))


def forest_votes(vectors: DataFrame, labels: Sequence[str], run: Run) -> DataFrame | None:
    """(patch_id, role, y, p) of all rows by forests of these labels; None if their features have too many cells."""
    table = multilabel.training_table(vectors, labels, 1).select("patch_id", "role", "x", "y", (F.col("role") == "train").alias("train"))
    return forest.scores(materialise(table, "forest"), len(labels), 2, forest.Forest(run.num_trees, run.max_depth, run.seed), weighted=True)


def voted(votes: DataFrame, able: Sequence[str], labels: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long predictions of forest_votes."""
    cells = []
    for i, c in enumerate(able):
        k = labels.index(c)
        cells.append(F.struct(F.lit(k).alias("label_idx"), F.lit(names[k]).alias("label_name"), F.get("y", i).alias("true_label"), F.get(F.get("p", i), 1).alias("probability")))
    return votes.select("patch_id", "role", F.inline(F.array(*cells)))


def binary_relevance(vectors: DataFrame, labels: Sequence[str], run: Run, names: Sequence[str] | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, run record): one weighted classifier per label with a training positive.

    Logistic models of all labels are fitted together, in as many passes as Newton steps (at most max_iter); forests
    together over the cells of binned features (`forest`), or, with too many cells, one by one by MLlib, in a bounded pool.
    The vectors are kept for all fits. All labels are scored in one pass, lazily, or,
    with a path, written there, so that the record's times hold the scoring too."""
    spark = vectors.sparkSession
    names = names or labels
    wanted = lambda df: df.where(F.col("role").isin(*evaluated_roles(run.regime)))
    source = vectors.select("patch_id", "role", "features", *labels)
    kept = source.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with measured(spark) as cost:
            counts = class_counts(kept, labels)
            n_rows = kept.count()
            able = [c for c in labels if counts[c][1] > 0]
            if run.learner == "lr" and able:
                model = multilabel.fit(multilabel.training_table(kept, labels, 1), labels, [able], folds=1, reg=run.reg_param, passes=run.max_iter)

                def score(df: DataFrame) -> DataFrame:
                    return multilabel.predictions(multilabel.training_table(df, labels, 1), model, labels, names, evaluated_roles(run.regime))
            elif run.learner == "rf" and able and (votes := forest_votes(kept, able, run)) is not None:

                def score(_: DataFrame) -> DataFrame:
                    return voted(wanted(votes), able, labels, names)
            else:
                models = fitted(kept, labels, run, counts)

                def score(df: DataFrame) -> DataFrame:
                    return scored(wanted(df), models, labels, names)

            if path is not None:
                score(kept).write.mode("overwrite").parquet(path)
    finally:
        kept.unpersist()
    out = score(source) if path is None else spark.read.schema(PREDICTIONS).parquet(path)
    used = cost.used
    times = {"wall_clock_seconds": cost.wall_seconds, "total_executor_cpu_time_seconds": used.cpu_seconds, "energy_kwh": used.energy_kwh(), "co2e_grams": used.co2e_grams()}
    return out, _record(spark, run, n_rows, counts, times)


def grid_cells(vectors: DataFrame, labels: Sequence[str], names: Sequence[str], runs: Sequence[Run], role: str = "validation", digits: int = 6) -> DataFrame:
    """(run_id, label_name, n, n_pos, ap, auroc) of every point of a grid on the rows of a role, over rounded probabilities.

    Logistic points of one max_iter are fitted in the same passes, forests share their cells and what is alike in their trees.
    Rows are scored by all logistic points at once; forests are ranked over the rows counted by cell. With too many cells MLlib
    fits and scores the forests one by one."""
    table = materialise(multilabel.training_table(vectors, labels, 1), "grid")
    sums = table.where("role = 'train'").agg(*(F.sum(F.get("y", i)).alias(c) for i, c in enumerate(labels))).first()
    able = [c for c in labels if (sums[c] or 0) > 0]
    own = dict(zip(labels, names, strict=True))
    found = []
    if not able:
        return vectors.sparkSession.createDataFrame([], "run_id string, label_name string, n bigint, n_pos bigint, ap double, auroc double")
    for steps in sorted({r.max_iter for r in runs if r.learner == "lr"}):
        some = [r for r in runs if r.learner == "lr" and r.max_iter == steps]
        models = multilabel.fit_penalties(table, labels, able, [r.reg_param for r in some], steps)
        pieces = multilabel.score_pieces(table, multilabel.values(models, labels), [role], digits)
        found.append(packed.ranking(pieces, [(r.run_id, own[c]) for r in some for c in labels], ["run_id", "label_name"]))
    forests = [r for r in runs if r.learner == "rf"]
    if forests:
        y = F.array(*(F.get("y", labels.index(c)) for c in able))
        rows = forest.binned(materialise(table.select("role", "x", y.alias("y"), (F.col("role") == "train").alias("train")), "forest"))
        voted = forest.votes(rows, len(able), 2, [forest.Forest(r.num_trees, r.max_depth, r.seed) for r in forests], weighted=True)
        if voted is None:
            for r in forests:
                p = scored(vectors.where(F.col("role") == role), fitted(vectors, labels, r, {c: class_counts(vectors, [c])[c] for c in labels}), labels, names)
                p = p.withColumn("score", F.round("probability", digits)).withColumn("run_id", F.lit(r.run_id))
                found.append(metrics.ranking(p, ["run_id", "label_name"]))
        else:
            held = rows.where(F.col("role") == role).groupBy("cell").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("y", i)) for i in range(len(able)))).alias("pos"))
            points = F.array(*(F.struct(F.lit(r.run_id).alias("run_id"), F.round(F.get("p", 2 * k + 1), digits).alias("score")) for k, r in enumerate(forests)))
            label = F.get(F.array(*(F.lit(own[c]) for c in able)), F.col("label")).alias("label_name")
            each = voted[0].join(held, "cell").select(label, "n", F.get("pos", F.col("label")).alias("pos"), F.inline(points))
            keys = ["run_id", "label_name"]
            counts = each.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
            ap, auroc = metrics.rank_sums()
            curve = metrics.cumulated(counts, keys, {"tp": "pos", "k": "n"}).groupBy(*keys)
            found.append(curve.agg(F.sum("n").alias("n"), F.sum("pos").cast("bigint").alias("n_pos"), ap.alias("ap"), auroc.alias("auroc")))
    return reduce(DataFrame.unionByName, found)


RECORD = "run_id string, regime string, fold string, learner string, seed int, max_iter int, reg_param double, num_trees int, max_depth int, threads int, n_joined_rows bigint, n_train_rows bigint, wall_clock_seconds double, total_executor_cpu_time_seconds double, energy_kwh double, co2e_grams double"


def _record(spark: SparkSession, run: Run, rows: int, counts: dict[str, tuple[int, int]], times: dict[str, float]) -> DataFrame:
    n_train = max((n for n, _ in counts.values()), default=0)
    return spark.createDataFrame([{**asdict(run), "run_id": run.run_id, "fold": run.fold or "", "n_joined_rows": rows, "n_train_rows": n_train, **times}], RECORD)


def run_all(rows: DataFrame, columns: Sequence[str], metadata: Sequence[str], labels: Sequence[str], names: Sequence[str], runs: Sequence[Run], root: str) -> tuple[DataFrame, DataFrame]:
    """(predictions with run_id, run records) of several runs over rows with the split columns; each run's predictions go to a folder of its own under root.

    A run whose folder has been written whole is not trained again: a ladder that broke off goes on where it stopped.
    Logistic runs with equal parameters are fitted together (`relevance_runs`)."""
    spark = rows.sparkSession
    path = lambda run: f"{root}/predictions/{run.run_id}"
    todo = [run for run in runs if parquet_or_none(spark, path(run)) is None]
    records, alike = [], {}
    for run in todo:
        alike.setdefault((run.reg_param, run.max_iter) if run.learner == "lr" else run.run_id, []).append(run)
    for group in alike.values():
        for some in (group[k : k + RUNS] for k in range(0, len(group), RUNS)):
            if len(some) > 1:
                records += relevance_runs(rows, columns, metadata, labels, names, some, path, lambda run: f"{root}/records/{run.run_id}")
                continue
            run = some[0]
            with_role = rows.withColumn("role", role(run.regime, run.fold)).where(F.col("role").isNotNull())
            vectors = feature_vectors(with_role, columns, [*metadata, "role"], ["patch_id", "role", *labels])
            record = binary_relevance(vectors, labels, run, names, path(run))[1]
            write_json(record, f"{root}/records/{run.run_id}")
            records.append(record)
    out = [spark.read.schema(PREDICTIONS).parquet(path(run)).withColumn("run_id", F.lit(run.run_id)) for run in runs]
    return reduce(DataFrame.unionByName, out), reduce(DataFrame.unionByName, records) if records else None


#: So many logistic runs share the passes of a fit.
RUNS = 24


def relevance_runs(rows: DataFrame, columns: Sequence[str], metadata: Sequence[str], labels: Sequence[str], names: Sequence[str], runs: Sequence[Run], path, record_path) -> list[DataFrame]:
    """The records of logistic runs that differ in regime and fold only: every pass over the rows serves all of them, then each run's predictions are written.

    Features are scaled once, by all rows that train in any run: the penalty is on coefficients of unit deviation of a run's own
    training rows, so its models do not depend on the scale. Costs of the common passes are shared out evenly."""
    spark = rows.sparkSession
    roles = [role(run.regime, run.fold) for run in runs]
    bits = reduce(lambda a, b: a + b, (F.when(r == "train", 1 << k).otherwise(0) for k, r in enumerate(roles)))
    of = [f"_role{k}" for k in range(len(runs))]
    with_roles = rows.select("*", *(r.alias(c) for r, c in zip(roles, of, strict=True)), bits.cast("int").alias("_bits"))
    with_roles = with_roles.withColumn("role", F.when(F.col("_bits") != 0, "train").otherwise("none"))
    with measured(spark) as common:
        vectors = feature_vectors(with_roles, columns, [*metadata, "role", "_bits", *of], ["patch_id", "role", "_bits", *of, *labels])
        table = vectors.select(F.col("patch_id").cast("string").alias("patch_id"), vector_to_array("features").alias("x"), F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in labels)).alias("y"), F.col("_bits").alias("fold"), *of)
        table = materialise(table, "runs")
        trains = [F.col(c) == "train" for c in of]
        sums = [F.sum(F.when(t, F.get("y", i))).alias(f"p{k}_{i}") for k, t in enumerate(trains) for i in range(len(labels))]
        counted = table.agg(*(F.count(c).alias(f"n{k}") for k, c in enumerate(of)), *(F.count_if(t).alias(f"t{k}") for k, t in enumerate(trains)), *sums).first()
        able = [[c for i, c in enumerate(labels) if (counted[f"p{k}_{i}"] or 0) > 0] for k in range(len(runs))]
        models = multilabel.fit_runs(table, labels, able, runs[0].reg_param, runs[0].max_iter) if any(able) else []
    out = []
    for k, run in enumerate(runs):
        with measured(spark) as own:
            scores = multilabel.predictions(table.withColumn("role", F.col(of[k])), models[k], labels, names, evaluated_roles(run.regime)) if able[k] else spark.createDataFrame([], PREDICTIONS)
            scores.write.mode("overwrite").parquet(path(run))
        cpu, share = own.used.cpu_seconds + common.used.cpu_seconds / len(runs), common.wall_seconds / len(runs)
        part = lambda f: f(own.used) + f(common.used) / len(runs)  # noqa: E731, B023
        times = {"wall_clock_seconds": own.wall_seconds + share, "total_executor_cpu_time_seconds": cpu, "energy_kwh": part(lambda u: u.energy_kwh()), "co2e_grams": part(lambda u: u.co2e_grams())}
        record = _record(spark, run, counted[f"n{k}"], {c: (counted[f"t{k}"], 0) for c in labels}, times)
        write_json(record, record_path(run))
        out.append(record)
    return out


def records(spark: SparkSession, root: str) -> DataFrame:
    """The records that the runs under a root have left, one row a run."""
    return json_documents(spark, f"{root}/records/*", RECORD)


def ladder(regimes: dict[str, Sequence[str | None]], base: Run) -> list[Run]:
    """The runs of an experiment ladder: every fold of every regime."""
    return [replace(base, regime=r, fold=f) for r, folds in regimes.items() for f in folds]


def grid(base: Run) -> list[Run]:
    """The hyper-parameter grid, scored on validation rows only."""
    lr = [replace(base, learner="lr", reg_param=r) for r in (0.001, 0.01, 0.1)]
    return lr + [replace(base, learner="rf", num_trees=t, max_depth=d) for t, d in ((50, 10), (50, 15), (100, 10))]


def index_labels(df: DataFrame, label: str, out: str) -> DataFrame:
    """Labels numbered by falling frequency."""
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="frequencyDesc", handleInvalid="keep").fit(df).transform(df)


def hash_split(df: DataFrame, share: float, seed: int, patch: str = "patch_id") -> tuple[DataFrame, DataFrame]:
    """(train, test) by seeded hash: the same rows under any partitioning."""
    low = seeded_int(seed, F.col(patch)) < int(share * 2**32)
    return df.where(low), df.where(~low)


def single_label(train: DataFrame, columns: Sequence[str], label: str, learner: str = "rf", trees: int = 100, depth: int = 20, seed: int = 42) -> PipelineModel:
    """The older path: labels indexed, features assembled, one multi-class forest or logistic model, as one pipeline."""
    common = dict(featuresCol="features", labelCol="label_index", predictionCol="prediction")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common) if learner == "rf" else LogisticRegression(family="multinomial", **common)
    steps = [StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip"), VectorAssembler(inputCols=list(columns), outputCol="features"), model]
    return Pipeline(stages=steps).fit(train)


def single_label_votes(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str, trees: int = 100, depth: int = 20, seed: int = 42) -> DataFrame:
    """test with label_index and prediction, by a forest as `single_label` fits it; rows of labels that train has not are left out."""
    indexer = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip").fit(train)
    both = indexer.transform(train.withColumn("_train", F.lit(True)).unionByName(test.withColumn("_train", F.lit(False))))
    table = both.select(F.struct(*test.columns, "label_index").alias("row"), F.col("_train").alias("train"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.array("label_index").alias("y"))
    votes = forest.scores(materialise(table, "forest"), 1, len(indexer.labels), forest.Forest(trees, depth, seed))
    if votes is None:
        return single_label(train, columns, label, "rf", trees, depth, seed).transform(test).select(*test.columns, "label_index", "prediction")
    p = F.get("p", 0)
    most = F.array_position(p, F.array_max(p)) - 1  # of equals the first
    return votes.where("NOT train").select("row.*", most.cast("double").alias("prediction"))


def single_label_metrics(predicted: DataFrame) -> dict[str, float]:
    """F1, accuracy, weighted precision and recall, each by an evaluator of its own."""
    names = ("f1", "accuracy", "weightedPrecision", "weightedRecall")
    return {n: MulticlassClassificationEvaluator(labelCol="label_index", predictionCol="prediction", metricName=n).evaluate(predicted) for n in names}


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
