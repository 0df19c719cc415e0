"""Models and off-policy learning over samples and slates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators.samples import with_columns


def als_vectors(ratings: DataFrame, rank: int = 16, iterations: int = 10, reg: float = 0.1, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(user vectors, item vectors) by alternating least squares; ids are strings."""
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.recommendation import ALS

    users = StringIndexer(inputCol="userId", outputCol="u", handleInvalid="skip").fit(ratings)
    items = StringIndexer(inputCol="movieId", outputCol="i", handleInvalid="skip").fit(ratings)
    rows = items.transform(users.transform(ratings)).select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("rating").cast("float"))
    model = ALS(rank=rank, maxIter=iterations, regParam=reg, userCol="u", itemCol="i", ratingCol="rating", seed=seed).fit(rows)

    def named(factors: DataFrame, labels: list[str], out: str) -> DataFrame:
        back = IndexToString(inputCol="n", outputCol=out, labels=labels)
        return back.transform(factors.withColumn("n", F.col("id").cast("double"))).select(out, F.col("features").cast("array<double>").alias("vector"))

    return named(model.userFactors, users.labels, "user_id"), named(model.itemFactors, items.labels, "item_id")


def item2vec(sequences: DataFrame, size: int = 10, window: int = 5, iterations: int = 10, partitions: int = 1, seed: int = 7) -> DataFrame:
    """Item vectors by Word2Vec over sequences (column items)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, maxIter=iterations, minCount=1, numPartitions=partitions, seed=seed, inputCol="items", outputCol="v").fit(sequences)
    return model.getVectors().select(F.col("word").alias("item_id"), vector_to_array("vector").alias("vector"))


def split_by_date(samples: DataFrame, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """(train, holdout): the newest date is held out; all rows train if there is one date only."""
    newest = samples.agg(F.max(date)).first()[0]
    train = samples.filter(F.col(date) < F.lit(newest))
    return (samples, samples) if train.isEmpty() else (train, samples.filter(F.col(date) == F.lit(newest)))


def ctr_model(train: DataFrame, features: list[str], buckets: int = 1 << 18):
    """Logistic regression on hashed features for the label clicked."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher

    hasher = FeatureHasher(inputCols=features, outputCol="features", numFeatures=buckets)
    return Pipeline(stages=[hasher, LogisticRegression(labelCol="clicked", featuresCol="features", maxIter=30, regParam=0.01)]).fit(train)


def ctr_rows(samples: DataFrame) -> DataFrame:
    """samples with the columns that the full model reads: categories from feature maps (NA without), the position, genres and tags."""
    rows = with_columns(samples, {"user_features": "map<string,string>", "item_features": "map<string,string>", "context_features": "map<string,string>", "device": "string", "position": "int", "genres": "array<string>", "tags": "array<string>"})
    user, item, context = (F.col(f"{c}_features") for c in ("user", "item", "context"))
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "uf_tier": F.coalesce(user["tier"], F.lit("NA")), "if_bucket": F.coalesce(item["bucket"], F.lit("NA")), "cf_device": F.coalesce("device", context["device"], F.lit("NA")),
        "cf_country": F.coalesce(user["country"], context["country"], F.lit("NA")), "position_d": F.coalesce(F.col("position").cast("double"), F.lit(0.0)),
        "genres": F.coalesce("genres", none), "tags": F.coalesce("tags", none),
    })


def full_ctr_model(train: DataFrame, buckets: int = 1 << 18, term_buckets: int = 1 << 10):
    """Logistic regression for clicked on hashed categories and on the hashed counts of genres and tags (rows of ctr_rows)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher, HashingTF, VectorAssembler

    hashed = FeatureHasher(inputCols=["uf_tier", "if_bucket", "cf_device", "cf_country", "item_id", "position_d"], outputCol="cat_features", numFeatures=buckets)
    terms = [HashingTF(inputCol=c, outputCol=f"{c}_features", numFeatures=term_buckets) for c in ("genres", "tags")]
    together = VectorAssembler(inputCols=["cat_features", "genres_features", "tags_features"], outputCol="features")
    return Pipeline(stages=[hashed, *terms, together, LogisticRegression(labelCol="clicked", featuresCol="features", maxIter=30, regParam=0.01)]).fit(train)


def evaluate_ctr(model, holdout: DataFrame, label: str = "clicked") -> dict:
    """Rows, area under the ROC and precision-recall curves, and log loss (probabilities kept off 0 and 1 by 1e-15) of a fitted model; None where undefined."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import vector_to_array

    rows = model.transform(holdout).select(F.col(label).cast("double").alias(label), "rawPrediction", vector_to_array("probability")[1].alias("p"))
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -F.when(F.col(label) > 0, F.log(p)).otherwise(F.log(1 - p))
    n, positive, mean = rows.agg(F.count("*"), F.sum(label), F.avg(loss)).first()
    both = n and 0 < positive < n
    area = lambda name: BinaryClassificationEvaluator(labelCol=label, metricName=name).evaluate(rows) if both else None
    return {"rows": n, "positives": int(positive or 0), "auc": area("areaUnderROC"), "pr_auc": area("areaUnderPR"), "logloss": mean}


def save_model(model, metrics: dict, path: str, write) -> None:
    """The model under path/model, replacing an older one, and its metrics as JSON by write(path, text)."""
    from rivulet.sources.files import json_document

    model.write().overwrite().save(f"{path}/model")
    write(f"{path}/metrics.json", json_document(metrics))


def tabular_q(steps: DataFrame, gamma: float = 0.9, alpha: float = 0.5, sweeps: int = 500, tolerance: float = 1e-9) -> DataFrame:
    """Q by batch Bellman backups: each sweep moves every (state, action) towards its mean target.

    steps: state, action, reward, next_state, terminal. Targets depend on a step
    only by (state, action, next state), so steps are added up once; sweeps then
    join that table with the values of states.
    """
    from rivulet.streaming.cutting import cut

    moves = cut(steps.groupBy("state", "action", F.when(~F.col("terminal"), F.col("next_state")).alias("next_state")).agg(F.sum("reward").alias("reward"), F.count("*").alias("n")))
    q = moves.groupBy("state", "action").agg(F.lit(0.0).alias("q"))
    for _ in range(sweeps):
        best = q.groupBy(F.col("state").alias("next_state")).agg(F.max("q").alias("v"))
        target = moves.join(best, "next_state", "left").groupBy("state", "action").agg((F.sum(F.col("reward") + gamma * F.col("n") * F.coalesce("v", F.lit(0.0))) / F.sum("n")).alias("t"))
        new = cut(q.join(target, ["state", "action"]).select("state", "action", (F.col("q") + alpha * (F.col("t") - F.col("q"))).alias("new"), "q"))
        moved = new.agg(F.max(F.abs(F.col("new") - F.col("q")))).first()[0]
        q = new.select("state", "action", F.col("new").alias("q"))
        if moved is None or moved < tolerance:
            break
    return q


def td_residual(steps: DataFrame, q: DataFrame, gamma: float = 0.9) -> DataFrame:
    """Mean absolute error of known steps and the share that is known."""
    best = q.groupBy(F.col("state").alias("next_state")).agg(F.max("q").alias("v"))
    rows = steps.join(q, ["state", "action"], "left").join(best, "next_state", "left")
    target = F.col("reward") + gamma * F.when(F.col("terminal"), 0.0).otherwise(F.coalesce("v", F.lit(0.0)))
    return rows.agg(F.avg(F.abs(target - F.col("q"))).alias("residual"), F.avg(F.col("q").isNotNull().cast("double")).alias("coverage"))


def group_advantage(rewards):
    """Rewards less their mean, over their deviation; None for fewer than two or no spread."""
    import numpy as np

    r = np.asarray(rewards, float)
    return None if len(r) < 2 or r.std() < 1e-8 else (r - r.mean()) / r.std()


def softmax(x):
    import numpy as np

    e = np.exp(x - np.max(x))
    return e / e.sum()


def grpo_step(weights, groups: list, rate: float = 0.05, clip: float = 0.2, beta: float = 0.02, epochs: int = 4):
    """Weights after some epochs of group-relative policy optimisation; the old ones if a number isn't finite.

    groups: (features n x d, rewards n, logged probabilities n). The surrogate is
    clipped against the policy the batch began with, the KL penalty holds to the
    logged policy.
    """
    import numpy as np

    w0 = np.asarray(weights, float)
    w = w0.copy()
    use = [(np.asarray(x, float), a, np.asarray(p, float)) for x, r, p in groups if (a := group_advantage(r)) is not None]
    if not use:
        return w0
    snap = [softmax(x @ w0) for x, _, _ in use]
    for _ in range(epochs):
        g = np.zeros_like(w)
        for (x, a, logged), old in zip(use, snap, strict=True):
            p = softmax(x @ w)
            ratio = p / old
            open_ = np.where(a >= 0, ratio < 1 + clip, ratio > 1 - clip)
            # d p_i / d w = p_i (x_i - mean x under p)
            centred = x - p @ x
            surrogate = ((a * open_ * ratio)[:, None] * centred).mean(axis=0)
            kl = ((p * (np.log(p) - np.log(np.maximum(logged, 1e-12))))[:, None] * centred).sum(axis=0)
            g += surrogate - beta * kl
        w = w + rate * g / len(use)
    return w if np.isfinite(w).all() else w0


def logistic(x, y, steps: int = 500, rate: float = 0.5, l2: float = 1.0):
    """(weights, bias) by gradient descent on standardised columns; the bias isn't penalised."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std == 0] = 1
    z, w, b = (x - mean) / std, np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y
        w, b = w - rate * (z.T @ e + l2 * w) / len(y), b - rate * e.mean()
    return w / std, b - float((w / std) @ mean)


def direct_method(events: DataFrame, policies: dict, estimate) -> DataFrame:
    """Mean estimated reward of the action that each policy picks.

    events: request_id, actions array<struct<item, ...>>. policies: name ->
    column that scores a struct; estimate: column of a struct. Ties go to the
    smaller item.
    """
    rows = events.select("request_id", F.explode("actions").alias("a"))
    out = None
    for name, score in policies.items():
        best = rows.groupBy("request_id").agg(F.max_by(estimate(F.col("a")), F.struct(score(F.col("a")).alias("s"), F.col("a.item"))).alias("r"))
        got = best.agg(F.avg("r").alias("value"), F.count("*").alias("n")).select(F.lit(name).alias("policy"), "value", "n")
        out = got if out is None else out.unionByName(got)
    return out


def topic_capacity(rate: float, record_bytes: int, days: float, replicas: int, overhead: float) -> int:
    """Bytes a topic needs: messages a second, kept for some days, on some replicas."""
    import math

    return math.ceil(rate * record_bytes * 86400 * days * replicas * overhead)
