"""A linear text classifier: TF-IDF, one-vs-rest SVM, persisted as one pipeline model.

Spark's linear SVM minimises the plain hinge, so weights differ from squared-hinge solvers; compare metrics.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread
from .relational import stratified_split
from .terms import MIN_DF, SIZE


def train(df: DataFrame, key: str, text: str, label: str, path: str | None = None, size: int = SIZE, min_df: int = MIN_DF, iterations: int = 20, seed: int = 42, balanced: bool = False) -> tuple[PipelineModel, DataFrame]:
    """Fits on the training part of a stratified split; gives the model and the test rows, and saves it if asked.

    Tokens are lower-cased runs of two and more word characters; features are their counts and those of
    neighbouring pairs, weighed by idf and scaled to length 1; the vocabulary is fitted on the training part. With
    ``balanced`` every class has the same weight in all, however few its rows.
    """
    # Written once: the fits below read the training part over and over.
    parts = checkpointed(spread(stratified_split(df, key, label, seed=seed)))
    fit, test = parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split")
    labels = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(fit)
    n = fit.count()
    if balanced:
        classes = fit.groupBy(F.col(label).alias("__c")).agg((F.lit(float(n)) / F.count(F.lit(1))).alias("__weight"))
        fit = checkpointed(fit.join(F.broadcast(classes.withColumn("__weight", F.col("__weight") / F.lit(max(1, len(labels.labels))))), F.col(label) == F.col("__c")).drop("__c"))
    svm = LinearSVC(standardization=False, regParam=1.0 / max(1, n), maxIter=iterations, featuresCol="__x", labelCol="__y")
    stages = [
        labels,
        RegexTokenizer(inputCol=text, outputCol="__one", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        NGram(n=2, inputCol="__one", outputCol="__two"),
        SQLTransformer(statement="SELECT *, concat(__one, __two) AS __terms FROM __THIS__"),
    ]
    counted = Pipeline(stages=[*stages, CountVectorizer(inputCol="__terms", outputCol="__tf", vocabSize=size, minDF=min_df)]).fit(fit)
    # Spark's idf lacks the "+ 1" of the smooth form, so its vector is taken, raised by 1 and applied.
    idf = IDF(inputCol="__tf", outputCol="__w").fit(counted.transform(fit))
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="__tf", outputCol="__w")
    learn = Pipeline(stages=[weigh, Normalizer(inputCol="__w", outputCol="__x"), OneVsRest(classifier=svm, featuresCol="__x", labelCol="__y", predictionCol="__p", weightCol="__weight" if balanced else None), IndexToString(inputCol="__p", outputCol="predicted", labels=labels.labels)])
    model = PipelineModel(stages=[*counted.stages, *learn.fit(counted.transform(fit)).stages])
    if path:
        model.write().overwrite().save(path)
    return model, test


def metrics(predicted: DataFrame, label: str) -> DataFrame:
    """One row: rows, accuracy, the share of the largest class, and the mean recall of the classes (balanced accuracy)."""
    hit = (F.col(label) == F.col("predicted")).cast("double")
    each = predicted.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("recall"))
    total = F.sum("n")
    return each.agg(total.alias("n"), (F.sum(F.col("n") * F.col("recall")) / total).alias("accuracy"), (F.max("n") / total).alias("base_rate"), F.avg("recall").alias("balanced_accuracy"))


def load(path: str) -> PipelineModel:
    """A saved model."""
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the column ``predicted``."""
    return model.transform(df).select(*df.columns, "predicted")
