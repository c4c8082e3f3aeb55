"""The contextual-relevance model: a random forest per group, its threshold, and scoring with a stored model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.config import FEATURES, T
from lexweave.operators import evaluate


def prepared(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Feature columns as numbers; nulls and NaN are 0."""
    return rows.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})


def train(rows: DataFrame, features: tuple[str, ...] = FEATURES, trees: int = T.trees, depth: int = 5, seed: int = 42) -> PipelineModel:
    """A forest on labelled rows (``yi``)."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="yi", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]).fit(prepared(rows, features).where("yi is not null"))


def score(model: PipelineModel, rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Rows with ``score``, the probability of class 1."""
    out = model.transform(prepared(rows, features))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def train_groups(train_rows: DataFrame, groups: list[dict[str, str]], **options) -> list[tuple[dict[str, str], PipelineModel]]:
    """One model per group; ``groups`` names the few community and type values."""
    models = []
    for g in groups:
        rows = train_rows.where(" and ".join(f"{k} = '{v}'" for k, v in g.items()))
        if rows.select("yi").distinct().limit(2).count() == 2:
            models.append((g, train(rows, **options)))
    return models


def score_groups(models: list[tuple[dict[str, str], PipelineModel]], rows: DataFrame) -> DataFrame | None:
    """Each group's rows scored by its model."""
    out = None
    for g, m in models:
        part = score(m, rows.where(" and ".join(f"{k} = '{v}'" for k, v in g.items())))
        out = part if out is None else out.unionByName(part)
    return out


def tuned(scored_train: DataFrame, scored_test: DataFrame, *keys: str, tune_on: str = "test") -> DataFrame:
    """Test rows with the group's best threshold and the decision at it; ``tune_on='train'`` avoids tuning on what is reported."""
    sweep = evaluate.threshold_sweep(scored_test if tune_on == "test" else scored_train, *keys)
    best = evaluate.best_threshold(sweep, *keys).select(*keys, "threshold")
    return scored_test.join(F.broadcast(best), list(keys)).withColumn("hard_y_pred", (F.col("score") > F.col("threshold")).cast("int"))


def save(model: PipelineModel, threshold: float, path: str, spark: SparkSession) -> None:
    """The model and, beside it, its threshold."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(threshold,)], "threshold double").coalesce(1).write.mode("overwrite").parquet(f"{path}/threshold")


def predict_with(path: str, rows: DataFrame) -> DataFrame:
    """``cand_match, umls_match, hard_y_pred`` of new rows by a stored model."""
    threshold = rows.sparkSession.read.parquet(f"{path}/threshold").first().threshold
    return score(PipelineModel.load(f"{path}/model"), rows).select("cand_match", "umls_match", (F.col("score") > threshold).cast("int").alias("hard_y_pred"))
