"""Two classifiers on windows, their blend, storage and scoring (pyspark.ml)."""

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.feature import (FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.fixed_values import EPS, FINAL_MODELS, FINAL_REASONS, TIER_ALPHA
from panelrisk.functions.scalars import target_week
from panelrisk.operators import sequences
from panelrisk.operators.ordered import cuts_below
from panelrisk.sources.files import missing_columns, write_report

SEED = 42
#: Buckets that entity names are hashed into for the perceptron.
HASHED_ENTITIES = 16


def standardiser(df: DataFrame, array_column="X", n_features=None) -> DataFrame:
    """One row: per feature mean and population sigma + 1e-8 over all steps of all windows."""
    n = n_features
    steps = df.select(F.explode(array_column).alias("_s"))
    return steps.agg(
        F.array(*[F.avg(F.col("_s")[i].cast("double")) for i in range(n)]).alias("mean"),
        F.array(*[F.stddev_pop(F.col("_s")[i].cast("double")) + F.lit(EPS) for i in range(n)])
        .alias("sigma"))


def standardise(df: DataFrame, mean, sigma, array_column="X", out="Z") -> DataFrame:
    """(X - mean) / sigma per step, flattened to one array in time order."""
    mu, sd = F.array(*map(F.lit, mean)), F.array(*map(F.lit, sigma))
    step = lambda s: F.zip_with(
        F.zip_with(s, mu, lambda x, m: x.cast("double") - m), sd, lambda d, v: d / v)
    return df.withColumn(out, F.flatten(F.transform(array_column, step)))


def class_weights(df: DataFrame, label="Y", out="weight", counted=None) -> DataFrame:
    """Positives weigh negatives / positives, negatives 1 (each count at least 1).

    The counts are those of the rows where ``counted`` holds (all rows by default).
    """
    n = (df if counted is None else df.filter(counted)).agg(F.greatest(F.lit(1), F.count_if(F.col(label) == 1)).alias("p"),
               F.greatest(F.lit(1), F.count_if(F.col(label) == 0)).alias("q"))
    ratio = n.select((F.col("q") / F.col("p")).alias("r")).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def _positive(column):
    return vector_to_array(F.col(column))[1]


def stopped_at(losses, patience=30) -> int:
    """Number of trees at the lowest loss before ``patience`` trees in a row brought no better."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_trees(df: DataFrame, features, label="Y", validation=None, iterations=300,
              weight="weight", entity="country_std", patience=30) -> PipelineModel:
    """Boosted trees of depth 4, step 0.05, row and column share 0.8, on features and entity.

    With ``validation`` (a boolean column) the trees are fitted on the other rows; the
    number of trees is where the validation loss stops falling for ``patience`` trees.
    That is looked for in fits of doubling size, as a longer fit begins with the same
    trees. With one class only in validation all trees are kept.
    """
    gbt = GBTClassifier(featuresCol="_flat", labelCol=label, weightCol=weight, maxDepth=4,
                        stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                        maxIter=iterations, seed=SEED, predictionCol="_pred", cacheNodeIds=True)
    gbt = gbt.setProbabilityCol("_prob").setRawPredictionCol("_raw")
    front = Pipeline(stages=[
        StringIndexer(inputCol=entity, outputCol="_index", handleInvalid="keep"),
        # a plain number: as a category it would need as many bins as there are entities
        SQLTransformer(statement="SELECT *, _index + 0.0D AS _who FROM __THIS__"),
        VectorAssembler(inputCols=[*features, "_who"], outputCol="_flat")]).fit(df)
    ready = front.transform(df)
    own = ready.filter(~F.col(validation)) if validation else ready
    held = ready.filter(F.col(validation)) if validation else None
    if held is None or held.select(label).distinct().count() < 2:
        return PipelineModel(stages=[*front.stages, gbt.fit(own)])
    size = min(iterations, 2 * patience)
    while True:
        fitted = gbt.copy({gbt.maxIter: size}).fit(own)
        trees = stopped_at(fitted.evaluateEachIteration(held), patience)
        if size == iterations or trees + patience <= size:
            break
        size = min(iterations, 2 * size)
    if trees < size:
        fitted = gbt.copy({gbt.maxIter: trees}).fit(own)
    return PipelineModel(stages=[*front.stages, fitted])


def fit_linear(df: DataFrame, label="Y", steps="Z", entity="country_std",
               weight="weight", iterations=50) -> PipelineModel:
    """Weighted logistic regression on the standardised ordered window plus the entity.

    Each entity has an indicator of its own (sparse); entities not seen in training share one.
    """
    df = df.withColumn("_seq", array_to_vector(F.col(steps)))
    return Pipeline(stages=[
        StringIndexer(inputCol=entity, outputCol="_index", handleInvalid="keep"),
        OneHotEncoder(inputCol="_index", outputCol="_who", handleInvalid="keep"),
        VectorAssembler(inputCols=["_seq", "_who"], outputCol="_in"),
        LogisticRegression(featuresCol="_in", labelCol=label, weightCol=weight,
                           maxIter=iterations, regParam=0.01, probabilityCol="_prob",
                           rawPredictionCol="_raw", predictionCol="_pred")]).fit(df)


def balanced(df: DataFrame, label="Y", keys=("country_std", "week_end")) -> DataFrame:
    """Rows of the rarer class repeated until both classes have the same number of rows.

    For learners without weights. Every row is repeated equally often, and those whose hash ranks
    first once more, so the result is exact and the same on every run. ``keys`` identify a row.
    """
    n = df.agg(F.count_if(F.col(label) == 1).alias("one"),
               F.count_if(F.col(label) == 0).alias("zero")).first()
    few, many = sorted((n.one, n.zero))
    if not few or few == many:
        return df
    rare = F.col(label) == (1 if n.one == few else 0)
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    behind, _ = cuts_below(hashed.filter(rare), ["_hash", *keys],
                           lambda i, total: i == F.lit(many % few))
    # before the cut once more; the cut stands at the first row if nothing is left over
    copies = F.when(rare, F.lit(many // few) + F.when(behind == 0, 1).otherwise(0)).otherwise(1)
    return hashed.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))) \
        .drop("_hash", "_copy")


def fit_perceptron(df: DataFrame, label="Y", steps="Z", entity="country_std", hidden=(32, 16),
                   iterations=100) -> PipelineModel:
    """Multilayer perceptron on the standardised ordered window and a hashed entity.

    Classes are evened out by repeating rows of the rarer one, as the learner takes no weights.
    """
    df = balanced(df, label).withColumn("_seq", array_to_vector(F.col(steps)))
    width = df.select(F.size(steps).alias("n")).first().n
    return Pipeline(stages=[
        FeatureHasher(inputCols=[entity], outputCol="_who", numFeatures=HASHED_ENTITIES),
        VectorAssembler(inputCols=["_seq", "_who"], outputCol="_in"),
        MultilayerPerceptronClassifier(
            featuresCol="_in", labelCol=label, layers=[width + HASHED_ENTITIES, *hidden, 2],
            maxIter=iterations, seed=SEED, probabilityCol="_prob", rawPredictionCol="_raw",
            predictionCol="_pred")]).fit(df)


def score(model: PipelineModel, df: DataFrame, out, steps=None) -> DataFrame:
    """Append the probability of the positive class."""
    if steps:
        df = df.withColumn("_seq", array_to_vector(F.col(steps)))
    keep = [c for c in df.columns if c != "_seq"]
    return model.transform(df).select(*keep, _positive("_prob").alias(out))


def blend(first, second, alpha):
    a = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha
    return a * F.col(first) + (1 - a) * F.col(second)


def tier_alpha(tier="group", table=TIER_ALPHA, default=0.7):
    """Blend weight by tier."""
    expr = reduce(lambda e, kv: e.when(F.col(tier) == kv[0], kv[1]), list(table.items())[1:],
                  F.when(F.col(tier) == list(table)[0], table[list(table)[0]]))
    return expr.otherwise(F.lit(default))


def choose_final(df: DataFrame) -> DataFrame:
    """Final model and reason from alpha and the test AUC/AP of the three candidates."""
    def worse(than):
        return (F.col("auc_ensemble") < F.col(f"auc_{than}")) \
            | (F.col("ap_ensemble") < F.col(f"ap_{than}"))
    zero_alpha = F.col("alpha") <= 0.05
    trees, sequence, ensemble = FINAL_MODELS
    no_weight, below_sequence, below_trees, best = FINAL_REASONS
    return df.withColumns({
        "final_model": F.when(zero_alpha | worse("sequence"), sequence)
        .when(worse("trees"), trees).otherwise(ensemble),
        "final_reason": F.when(zero_alpha, no_weight).when(worse("sequence"), below_sequence)
        .when(worse("trees"), below_trees).otherwise(best)})


def final_score(meta):
    """Score column of the model that the stored choice names."""
    kind = meta["final_model"]
    if kind == "trees":
        return F.col("p_trees")
    if kind == "sequence":
        return F.col("p_sequence")
    if kind == "ensemble":
        return blend("p_trees", "p_sequence", meta["alpha"])
    raise ValueError(f"unknown final model {kind!r}")


def save(folder, trees: PipelineModel, linear: PipelineModel, meta: DataFrame):
    """Both models and a one-row metadata report below one folder."""
    trees.write().overwrite().save(f"{folder}/trees")
    linear.write().overwrite().save(f"{folder}/sequence")
    write_report(meta, f"{folder}/meta")


def load(spark, folder):
    """(trees, linear, metadata dict) of a saved folder; the metadata is one row."""
    meta = spark.read.json(f"{folder}/meta").first().asDict(recursive=True)
    return PipelineModel.load(f"{folder}/trees"), PipelineModel.load(f"{folder}/sequence"), meta


def stored_vocabulary(spark, meta) -> DataFrame:
    """(country_std, country_id) as the stored models index entities."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(meta["countries"])],
                                 "country_std string, country_id long")


def check_features(df: DataFrame, features):
    absent = missing_columns(df, features)
    if absent:
        raise ValueError(f"saved model needs features that are not there: {absent}")


def in_target_range(df: DataFrame, split="all", start=None, end=None) -> DataFrame:
    """Rows of a split whose target week (13 weeks after the window end) is in a date range."""
    df = df.withColumn("target_week_end", target_week("week_end"))
    if split != "all":
        df = df.filter(F.col("split") == split)
    if start:
        df = df.filter(F.col("target_week_end") >= start)
    return df if not end else df.filter(F.col("target_week_end") <= end)


def predict_saved(spark, folder, df: DataFrame, split="all", start=None, end=None,
                  threshold=None) -> DataFrame:
    """Row-level predictions of a saved model on a split and target-date range.

    Entities are mapped by name to the stored vocabulary; ``country_id`` is NULL for one it does not
    have, which the models score as unknown.
    """
    trees, linear, meta = load(spark, folder)
    check_features(df, meta["features"])
    chosen = in_target_range(df, split, start, end)
    if chosen.isEmpty():
        seen = in_target_range(df, split).agg(F.min("target_week_end"),
                                              F.max("target_week_end")).first()
        raise ValueError(f"no rows for split={split} start={start} end={end}; "
                         f"target weeks there are {seen[0]} to {seen[1]}")
    scored = score(trees, chosen, "p_trees")
    scored = standardise(scored, meta["mean"], meta["sigma"])
    scored = score(linear, scored, "p_sequence", steps="Z")
    cut = float(meta["threshold"] if threshold is None else threshold)
    scored = sequences.remap(scored, stored_vocabulary(spark, meta))
    return scored.withColumn("p_conflict", final_score(meta)).select(
        "country_std", "country_id", "week_end", "target_week_end", "split", F.col("Y").alias("y_true"),
        "p_trees", "p_sequence", "p_conflict",
        (F.col("p_conflict") >= cut).cast("int").alias("pred"),
        F.lit(meta["final_model"]).alias("final_model"), F.lit(cut).alias("threshold"))
