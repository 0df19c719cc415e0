"""Reports and a model over accounts: by device, with values outside a list as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(column: str, values: list[str], other: str = "other") -> Column:
    """The value if it is in the list, else one name for all others; null and blank too."""
    return F.when(F.col(column).isin(*values), F.col(column)).otherwise(other)


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The named columns as the named types; what can't be read as one is null."""
    return df.select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds.items()])


def device_report(accounts: DataFrame, by: str, values: list[str], device: str = "device", flag: str = "suspended") -> DataFrame:
    """Accounts per device and flag, a column a value of `by`: one pass for all devices."""
    out = accounts.groupBy(device, flag).pivot(by, values).agg(F.count(F.lit(1)))
    return out.fillna(0, values)


def flag_model(accounts: DataFrame, categories: list[str], numbers: list[str], flag: str = "suspended", seed: int = 7):
    """(model, area under the curve on 30 % held out): indexed and one-hot categories, numbers, logistic regression. The flag isn't a feature."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    index = StringIndexer(inputCols=categories, outputCols=[f"{c}_i" for c in categories], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories])
    put = VectorAssembler(inputCols=[*[f"{c}_v" for c in categories], *numbers], outputCol="features", handleInvalid="skip")
    train, test = accounts.withColumn("label", F.col(flag).cast("double")).randomSplit([0.7, 0.3], seed)
    model = Pipeline(stages=[index, hot, put, LogisticRegression(maxIter=30, regParam=0.01)]).fit(train)
    return model, BinaryClassificationEvaluator().evaluate(model.transform(test))
