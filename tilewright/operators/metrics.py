"""Evaluation: image scores, ranking metrics, segmentation overlap and training losses."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import sigmoid, softmax
from tilewright.operators.scale import names, running_totals, value_bins

CLASS_WEIGHTS = (1.0, 0.8, 0.6, 0.15)  # fixed values, by class index


def image_scores(patches: DataFrame, image: str = "image_id", logit: str = "logit") -> DataFrame:
    """Mean logit of an image's patches, its probability and the 0/1 prediction."""
    mean = patches.groupBy(image).agg(F.avg(logit).alias("logit"))
    return mean.withColumn("prob", sigmoid(F.col("logit"))).withColumn("prediction", (F.col("prob") >= 0.5).cast("int"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def binary_metrics(scored: DataFrame, by=(), truth: str = "y_true", predicted: str = "prediction") -> DataFrame:
    """Accuracy, balanced accuracy (mean recall over present classes), precision, recall and F1."""
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(predicted) == p))
    counts = scored.groupBy(*names(by)).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, rest = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    classes = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return counts.select(
        *names(by), "tp", "fp", "fn", "tn", _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(recall + rest, classes).alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"),
        _ratio(tp * 2, tp * 2 + fp + fn).alias("f1"))


def score_steps(scored: DataFrame, by=(), truth: str = "y_true", score: str = "prob") -> DataFrame:
    """One row per distinct score with class counts at it and below it.

    Equal scores combine before the shuffle; the running counts are binned, so a
    group of any size stays distributed.
    """
    keys = names(by)
    counted = scored.groupBy(*keys, score).agg(
        F.sum(F.col(truth).cast("bigint")).alias("pos"), F.sum(F.lit(1) - F.col(truth)).cast("bigint").alias("neg"))
    binned = counted.withColumn("_bin", value_bins(counted, score))
    return running_totals(binned, keys, score, ["pos", "neg"], "_bin")


def ranking_metrics(scored: DataFrame, by=(), truth: str = "y_true", score: str = "prob") -> DataFrame:
    """ROC AUC with ties and step-wise average precision; both 0 when only one class occurs."""
    keys = names(by)
    steps = score_steps(scored, keys, truth, score)
    totals = scored.groupBy(*keys).agg(
        F.sum(F.col(truth).cast("bigint")).alias("_p"), F.sum(F.lit(1) - F.col(truth)).cast("bigint").alias("_n"))
    joined = steps.join(totals, keys) if keys else steps.withColumn("_one", F.lit(1)).join(
        totals.withColumn("_one", F.lit(1)), "_one").drop("_one")
    tp = F.col("_p") - F.col("pos_before")
    seen = tp + F.col("_n") - F.col("neg_before")
    return joined.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("_area"),
        F.sum(F.col("pos") * tp / seen).alias("_ap"), F.first("_p").alias("_p"), F.first("_n").alias("_n"),
    ).select(
        *keys, _ratio(F.col("_area"), F.col("_p") * F.col("_n")).alias("roc_auc"),
        F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_ap") / F.col("_p")).otherwise(F.lit(0.0)).alias("pr_auc"))


def curve_points(scored: DataFrame, truth: str = "y_true", score: str = "prob") -> DataFrame:
    """ROC and PR points, one row per threshold (predict positive when score >= threshold)."""
    steps = score_steps(scored, [], truth, score).withColumn("_one", F.lit(1))
    totals = scored.agg(
        F.sum(F.col(truth).cast("bigint")).alias("_p"), F.sum(F.lit(1) - F.col(truth)).cast("bigint").alias("_n")).withColumn("_one", F.lit(1))
    tp = F.col("_p") - F.col("pos_before")
    fp = F.col("_n") - F.col("neg_before")
    return steps.join(totals, "_one").select(
        F.col(score).alias("threshold"), _ratio(fp, F.col("_n")).alias("fpr"), _ratio(tp, F.col("_p")).alias("tpr"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, F.col("_p")).alias("recall"))


def confusion_matrix(scored: DataFrame, truth: str = "y_true", predicted: str = "prediction") -> DataFrame:
    """All four cells, zero where nothing falls."""
    cells = scored.agg(*[
        F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(f"c{t}{p}") for t in (0, 1) for p in (0, 1)])
    grid = F.array(*[F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(f"c{t}{p}").alias("n")) for t in (0, 1) for p in (0, 1)])
    return cells.select(F.inline(grid))


def class_iou(pixels: DataFrame, target: str, predicted: str, classes: int = 4, by=()) -> DataFrame:
    """Intersection over union per class (union at least 1) and their mean."""
    both = lambda i: F.count_if((F.col(target) == i) & (F.col(predicted) == i))
    either = lambda i: F.count_if((F.col(target) == i) | (F.col(predicted) == i))
    ious = [(both(i) / F.greatest(either(i), F.lit(1))) for i in range(classes)]
    out = pixels.groupBy(*names(by)).agg(*[iou.alias(f"iou_class_{i}") for i, iou in enumerate(ious)])
    mean = sum((F.col(f"iou_class_{i}") for i in range(1, classes)), F.col("iou_class_0")) / classes
    return out.withColumn("mean_iou", mean)


def segmentation_drift(baseline: DataFrame, current: DataFrame, keys, value: str, by=()) -> DataFrame:
    """Share of positions whose predicted class changed."""
    paired = baseline.select(*names(keys), F.col(value).alias("_old")).join(
        current.select(*names(keys), F.col(value).alias("_new")), names(keys))
    return paired.groupBy(*names(by)).agg(
        (F.count_if(~F.col("_old").eqNullSafe(F.col("_new"))) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("drift"))


def positive_weight(records: DataFrame, label: str = "label_id") -> DataFrame:
    positives = F.sum(F.col(label))
    return records.agg(((F.count(F.lit(1)) - positives) / F.greatest(positives, F.lit(1))).alias("pos_weight"))


def weighted_bce(logit: Column, truth: Column, pos_weight: Column | float = 1.0) -> Column:
    """Numerically stable binary cross-entropy on a logit."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    softplus = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (F.lit(1.0) - truth) * logit + (F.lit(1.0) + (weight - 1.0) * truth) * softplus


def combined_loss(pixels: DataFrame, logits: list[str], target: str, by=()) -> DataFrame:
    """Half cross-entropy, half Dice over the classes; absent classes add no Dice loss."""
    probabilities = softmax([F.col(c) for c in logits])
    count = len(logits)
    hit = lambda i: F.col(target) == i
    with_p = pixels.withColumns({f"_p{i}": p for i, p in enumerate(probabilities)})
    right = F.coalesce(*[F.when(hit(i), F.col(f"_p{i}")) for i in range(count)])
    sums = with_p.groupBy(*names(by)).agg(
        F.avg(-F.ln(right)).alias("cross_entropy"),
        *[F.sum(F.when(hit(i), F.col(f"_p{i}")).otherwise(0.0)).alias(f"_i{i}") for i in range(count)],
        *[(F.sum(f"_p{i}") + F.count_if(hit(i))).alias(f"_c{i}") for i in range(count)],
        *[F.count_if(hit(i)).alias(f"_n{i}") for i in range(count)])
    parts = [
        F.when(F.col(f"_n{i}") > 0, F.lit(1.0) - F.col(f"_i{i}") * 2.0 / F.greatest(F.col(f"_c{i}"), F.lit(1e-7))).otherwise(F.lit(0.0))
        for i in range(count)]
    dice = sum(parts[1:], parts[0]) / count
    return sums.select(*names(by), "cross_entropy", dice.alias("dice"), (F.col("cross_entropy") * 0.5 + dice * 0.5).alias("loss"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """L2-normalised array (norm at least 1e-12)."""
    length = F.greatest(F.sqrt(_dot(vector, vector)), F.lit(1e-12))
    return F.transform(vector, lambda x: x / length)


def mean_vectors(cells: DataFrame, by, vector: str = "vec") -> DataFrame:
    """Element-wise mean per group by a JVM aggregator: no explode over dimensions."""
    averaged = cells.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))).groupBy(*names(by)).agg(
        Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("members"))
    return averaged.withColumn("mean_vec", vector_to_array("_m")).drop("_m")


def prototypes(cells: DataFrame, item: str, label: str, vector: str = "vec") -> DataFrame:
    """Unit mean vector per item and class; classes with one member have none."""
    means = mean_vectors(cells, [item, label], vector).where(F.col("members") >= 2)
    return means.select(item, label, unit(F.col("mean_vec")).alias("prototype"))


def _weight(label: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in CLASS_WEIGHTS]), label + 1)


def prototype_losses(protos: DataFrame, item: str, label: str, temperature: float) -> DataFrame:
    """Weighted contrastive loss per item with at least two class prototypes (at most one per class)."""
    gathered = protos.groupBy(item).agg(F.collect_list(F.struct(F.col(label).alias("k"), F.col("prototype").alias("v"))).alias("ps"))

    def loss(p):
        scores = F.transform("ps", lambda q: _dot(p["v"], q["v"]) / F.lit(float(temperature)))
        top = F.array_max(scores)
        log_sum = top + F.ln(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
        return log_sum - _dot(p["v"], p["v"]) / F.lit(float(temperature))

    total = F.aggregate("ps", F.lit(0.0), lambda s, p: s + _weight(p["k"]) * loss(p))
    weight = F.aggregate("ps", F.lit(0.0), lambda s, p: s + _weight(p["k"]))
    return gathered.where(F.size("ps") >= 2).select(item, (total / weight).alias("loss"))


def global_local_losses(protos: DataFrame, summaries: DataFrame, item: str, label: str, summary: str = "roi_vec") -> DataFrame:
    """Class-weighted 1 - cosine between prototypes and the item's ROI summary."""
    joined = protos.join(summaries, item)
    weight = _weight(F.col(label))
    distance = F.lit(1.0) - _dot(F.col("prototype"), unit(F.col(summary)))
    return joined.groupBy(item).agg((F.sum(distance * weight) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("loss"))


def view_consistency(first: DataFrame, second: DataFrame, item: str) -> DataFrame:
    """1 - mean cosine of the two views' mean vectors (columns item, vec)."""
    a = mean_vectors(first, item).select(item, unit(F.col("mean_vec")).alias("a"))
    b = mean_vectors(second, item).select(item, unit(F.col("mean_vec")).alias("b"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(F.col("a"), F.col("b"))))
    return a.join(b, item).agg((F.lit(1.0) - F.avg(cosine)).alias("loss"))


def style_loss(local: DataFrame, field: DataFrame, roi_means: DataFrame, item: str) -> DataFrame:
    """Mean squared difference of summaries plus 0.05 x total variation of the global field.

    ``local``/``field``: item, cy, cx, vec; ``roi_means``: item, roi_vec.
    """
    pairs = mean_vectors(local, item).join(roi_means, item).select(
        F.explode(F.zip_with("mean_vec", "roi_vec", lambda a, b: (a - b) * (a - b))).alias("sq"))
    cells = field.select(item, "cy", "cx", F.col("vec").cast("array<double>").alias("vec"))

    def variation(dy: int, dx: int) -> DataFrame:
        moved = cells.select(item, (F.col("cy") - dy).alias("cy"), (F.col("cx") - dx).alias("cx"), F.col("vec").alias("next"))
        return cells.join(moved, [item, "cy", "cx"]).select(
            F.explode(F.zip_with("vec", "next", lambda a, b: F.abs(b - a))).alias("d")).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("d"))

    one = lambda df, name: df.select(F.col(df.columns[0]).alias(name), F.lit(1).alias("_one"))
    joined = one(pairs.agg(F.avg("sq")), "mse").join(one(variation(0, 1), "tx"), "_one").join(one(variation(1, 0), "ty"), "_one")
    return joined.select((F.col("mse") + (F.col("tx") + F.col("ty")) * 0.05).alias("loss"))


def hardest(scored: DataFrame, k: int, key: str = "image_id", score: str = "prob") -> DataFrame:
    """The ``k`` images closest to one half: a top-k report, so the limit is the feature."""
    return scored.orderBy(F.abs(F.col(score) - 0.5), key).limit(k)


def weighted_epoch_means(batches: DataFrame, by, values, size: str) -> DataFrame:
    weight = F.greatest(F.sum(size), F.lit(1))
    return batches.groupBy(*names(by)).agg(*[(F.sum(F.col(v) * F.col(size)) / weight).alias(v) for v in names(values)])
