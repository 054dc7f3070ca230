"""Precision over confidence, features and the classifier of best mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gazetteer

FULL_KINDS = ["Full", "CorefIdentity", "CorefFull", "LinkResolved"]
COREF_KINDS = ["Coref", "CorefIdentity", "CorefFull", "LinkResolved"]
CONTAINER_KINDS = ["Container", "Containment"]


def precision_curve(scored: DataFrame, label: str, confidence: str, tie: list[str]) -> DataFrame:
    """Adds ``rank``, ``precision`` (of all rows up to this one, most confident first) and ``smoothed`` (the best precision from here on).

    ``tie`` must tell rows of equal confidence apart. Rows of null label or confidence are left out. Nothing is sorted in one task.
    """
    from ..session import materialise

    df = scored.filter(F.col(label).isNotNull() & F.col(confidence).isNotNull())
    order = [F.col(confidence).desc(), *[F.col(t).asc() for t in tie]]
    # one materialised range partitioning serves both directions, and its partition numbers are part of the rows
    p = materialise(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    own = p.groupBy("_p").agg(F.sum(F.col(label).cast("long")).alias("_y"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = own.select("_p", F.coalesce(F.sum("_y").over(w), F.lit(0)).alias("_yb"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_nb"))
    here = Window.partitionBy("_p").orderBy(*order)
    run = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = p.join(F.broadcast(before), "_p").withColumn("rank", F.row_number().over(here) + F.col("_nb")).withColumn("precision", (F.sum(F.col(label).cast("long")).over(run) + F.col("_yb")) / F.col("rank"))
    tops = q.groupBy("_p").agg(F.max("precision").alias("_m"))
    after = tops.select("_p", F.max("_m").over(Window.orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_a"))
    # from the far end backwards: a frame that runs to the end would be summed anew for every row
    back = Window.partitionBy("_p").orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.max("precision").over(back)
    return q.join(F.broadcast(after), "_p").withColumn("smoothed", F.greatest(rest, F.col("_a"))).drop("_p", "_yb", "_nb", "_a")


# The names of the features, which are columns of the reports.
FEATURES = [
    "Ambiguous Candidate Count", "Coref Cluster Agrees", "Country Contains City", "Location Ambiguity Count", "StateOrProvince contains City", "Target and Best location type similarity",
    "is Coref BestMention", "is Coref+Identity BestMention", "is Linked BestMention", "is a Location rule", "is a Organization rule", "is a Other rule", "is a Person rule",
]


def mentions_of(bem: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, start_offset, text) of the clusters that best mentions bring along: the mention and the entity it stands for."""
    c = bem.filter("cluster_id is not null").select("doc_id", "cluster_id", F.explode(F.array("target", "best")).alias("m")).filter("m is not null")
    return c.select("doc_id", "cluster_id", "m.start_offset", "m.text").distinct()


def cluster_agreement(bem: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, bem_index, agrees) of best mentions of a full kind: 1 if a cluster has a mention within the target and one within the best
    entity, -1 if only the best entity has clusters, 0 if it has none. A mention in several clusters belongs to the last."""
    from .coref import cluster_of
    from .spans import within

    full = bem.filter(F.col("kind").isin(FULL_KINDS) & F.col("best").isNotNull())
    width = lambda c: F.length(F.regexp_replace(f"{c}.text", r"\s+", " ")) if c == "target" else F.length(f"{c}.text")
    part = lambda c, side: full.select("doc_id", F.struct("bem_index", F.lit(side).alias("side")).alias("outer_id"), F.col(f"{c}.start_offset").alias("start"), (F.col(f"{c}.start_offset") + width(c)).alias("end"))
    m = cluster_of(mentions).withColumn("inner_id", F.concat_ws(":", "start_offset", "text"))
    inside = within(part("target", 0).unionByName(part("best", 1)), m.select("doc_id", "inner_id", F.col("start_offset").alias("start"), (F.col("start_offset") + F.length("text")).alias("end")))
    per = inside.join(m.select("doc_id", "inner_id", "cluster_id"), ["doc_id", "inner_id"]).groupBy("doc_id", F.col("outer_id.bem_index").alias("bem_index"), "cluster_id").agg(F.max("outer_id.side").alias("best"), F.min("outer_id.side").alias("least"))
    both = per.groupBy("doc_id", "bem_index").agg(F.max(F.when((F.col("best") == 1) & (F.col("least") == 0), 1).otherwise(0)).alias("shared"), F.max("best").alias("any"))
    return both.select("doc_id", "bem_index", F.when(F.col("shared") == 1, 1.0).when(F.col("any") == 1, -1.0).otherwise(0.0).alias("agrees"))


def char_proximity(bem: DataFrame, default: int = -1) -> DataFrame:
    """(doc_id, bem_index, proximity): characters between the target and the best entity of a full mention, ``default`` for others."""
    far = F.when(F.col("kind").isin(FULL_KINDS) & F.col("best").isNotNull(), F.abs(F.col("target.start_offset") - F.col("best.start_offset"))).otherwise(default)
    return bem.select("doc_id", "bem_index", far.cast("int").alias("proximity"))


def positions(bem: DataFrame) -> DataFrame:
    """(doc_id, bem_index, position): the place of each non-trivial best mention among those of its document, from 0."""
    from .resolve import non_trivial

    said = non_trivial(bem.withColumn("text", F.regexp_replace("target.text", r"\s+", " ")))
    return said.select("doc_id", "bem_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("bem_index")) - 1).alias("position"))


def labelled_mentions(labels: DataFrame, bem: DataFrame) -> DataFrame:
    """Labels (doc_id, bem_index, label) with the best mentions that stand at this position of the document; others are dropped."""
    at = positions(bem).join(bem, ["doc_id", "bem_index"]).withColumnRenamed("bem_index", "of_all")
    return labels.select("doc_id", F.col("bem_index").alias("position"), "label").join(at, ["doc_id", "position"])


def features(bem: DataFrame, g: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """The thirteen features of each best mention, in alphabetical order, as columns of doubles beside ``doc_id`` and ``bem_index``.

    ``bem`` has doc_id, bem_index, kind, candidate_count, cluster_id, target, best and container (structs of text, start_offset, name, entity_type).
    ``mentions`` (doc_id, cluster_id, start_offset, text) are those of all clusters; without them, what best mentions bring along.
    The two 'contains' features ask only whether both names are places of the right type.
    """
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    t = F.lower(F.regexp_replace("target.text", r"\s+", " "))
    c = F.lower(F.regexp_replace("container.text", r"\s+", " "))
    b = bem.withColumn("t", t).withColumn("c", c)
    b = gazetteer.type_similarity(b, "t", "c", g)
    n = gazetteer.names(g)
    nt, nc = n.select(F.col("lname").alias("t"), F.col("is_city").alias("t_city")), n.select(F.col("lname").alias("c"), F.col("is_province").alias("c_prov"), F.col("is_country").alias("c_country"))
    b = b.join(nt, "t", "left").join(nc, "c", "left").join(gazetteer.total_count(g).withColumnRenamed("lname", "t"), "t", "left")
    said = cluster_agreement(bem, mentions_of(bem) if mentions is None else mentions)
    b = b.join(said, ["doc_id", "bem_index"], "left")
    agrees = F.coalesce("agrees", F.lit(0.0))
    box = F.col("kind").isin(CONTAINER_KINDS)
    is_a = lambda x: flag(F.col("target.entity_type") == x)
    values = [
        F.col("candidate_count"), agrees, flag(box & (F.col("t_city") == 1) & (F.col("c_country") == 1)), F.when(box, F.coalesce("places", F.lit(0)).cast("double")).otherwise(0.0), flag(box & (F.col("t_city") == 1) & (F.col("c_prov") == 1)),
        F.when(box, F.col("type_similarity")).otherwise(0.0), flag(F.col("kind").isin(COREF_KINDS)), flag(F.col("kind") == "CorefIdentity"), flag(F.col("kind") == "LinkResolved"), is_a("LOCATION"), is_a("ORGANIZATION"), is_a("OTHER"), is_a("PERSON"),
    ]
    return b.select("doc_id", "bem_index", *[v.alias(n) for n, v in zip(FEATURES, values)])


def fit_classifier(train: DataFrame, label: str = "label"):
    """A logistic regression on the features of ``train``. Regularisation is this engine's own choice."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    steps = [VectorAssembler(inputCols=FEATURES, outputCol="_x", handleInvalid="keep"), LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01)]
    return Pipeline(stages=steps).fit(train.na.fill(0.0, FEATURES))


def weights(model) -> list[tuple[str, float]]:
    """(feature, weight) of a fitted classifier, the intercept last."""
    fitted = model.stages[-1]
    return [*zip(FEATURES, map(float, fitted.coefficients)), ("intercept", float(fitted.intercept))]


def classify(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """``test`` with ``confidence`` by a classifier fitted on ``train``."""
    from pyspark.ml.functions import vector_to_array

    got = fit_classifier(train, label).transform(test.na.fill(0.0, FEATURES))
    return got.withColumn("confidence", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
