"""Zero-shot classes and the metrics of segmentation, instances and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import cosine, dot, norm
from pointloom.functions.shared import saved
from pointloom.operators.aggregate import majority_label  # noqa: F401
from pointloom.operators.sampling import draw


def class_scores(df: DataFrame, texts: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, segment, label, cos, zero): cosine of each row with every class vector. The class list goes along as one array of
    structs, so each row is scored in place. texts: label, feat."""
    listed = texts.agg(F.collect_list(F.struct("label", "feat")).alias("_t"))
    d = df.join(F.broadcast(listed)).select(key, "segment", "feat", F.explode("_t").alias("_t"))
    length = F.greatest(norm(F.col("feat")) * norm(F.col("_t.feat")), F.lit(1e-12))
    return d.select(key, "segment", "_t.label", (dot(F.col("feat"), F.col("_t.feat")) / length).alias("cos"), (~F.exists("feat", lambda v: v != 0)).alias("zero"))


def linked(c: Column, link: str) -> Column:
    """half: (c + 1) / 2, from 0 to 1; sigmoid: for unit vectors from 0.269 to 0.731; none."""
    return {"half": (c + 1) / 2, "sigmoid": 1 / (1 + F.exp(-c)), "none": c}[link]


def classify(df: DataFrame, texts: DataFrame, link: str = "half", t: float = 0.0, key: str = "point_id") -> DataFrame:
    """(key, segment, pred, score): the best class, -1 below the threshold and for rows that are all zero; ties to the lowest."""
    s = class_scores(df, texts, key).groupBy(key, "segment").agg(F.max(F.struct(F.round("cos", 12).alias("c"), -F.col("label"))).alias("b"), F.max("zero").alias("zero"))
    score = linked(F.col("b.c"), link)
    return s.select(key, "segment", F.when(F.col("zero") | (score < t), -1).otherwise(-F.col("b.col2")).cast("int").alias("pred"), score.alias("score"))


def softmax_scores(scores: DataFrame, temperature: float = 1.0, key: str = "point_id") -> DataFrame:
    """Adds ``p``: the softmax of a row's class scores."""
    w = Window.partitionBy(key)
    e = F.exp((F.col("cos") - F.max("cos").over(w)) * temperature)
    return scores.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def relevancy(scores: DataFrame, negatives, temp: float = 10.0, key: str = "point_id", more=()) -> DataFrame:
    """(key, label, relevancy): the least of the pairwise softmax of a phrase against each negative one, which equals that
    against the strongest; no pair is formed."""
    neg = scores.where(F.col("label").isin(*negatives)).groupBy(key, *more).agg(F.max("cos").alias("_n"))
    pos = scores.where(~F.col("label").isin(*negatives))
    return pos.join(neg.hint("merge"), [key, *more]).select(key, *more, "label", (1 / (1 + F.exp(temp * (F.col("_n") - F.col("cos"))))).alias("relevancy"))


def relevancy_levels(scores: DataFrame, negatives, temp: float = 10.0) -> DataFrame:
    """Relevancy per level, and the best level of each point and phrase."""
    d = relevancy(scores, negatives, temp, more=("level",))
    return d.groupBy("point_id", "label").agg(F.max(F.struct("relevancy", -F.col("level"))).alias("b")).select("point_id", "label", (-F.col("b.col2")).alias("level"), F.col("b.relevancy").alias("relevancy"))


def semantic_map(scores: DataFrame, negatives) -> DataFrame:
    """(point_id, pred): best phrase over positives and negatives; a negative one gives -1."""
    b = scores.groupBy("point_id").agg(F.max(F.struct(F.round("cos", 12).alias("c"), -F.col("label"))).alias("b")).select("point_id", (-F.col("b.col2")).alias("l"))
    return b.select("point_id", F.when(F.col("l").isin(*negatives), -1).otherwise(F.col("l")).cast("int").alias("pred"))


def classify_clusters(points: DataFrame, clusters: DataFrame, texts: DataFrame) -> DataFrame:
    """Points take the class of their cluster. points: point_id, cluster; clusters: cluster, segment, feat."""
    return points.join(classify(clusters, texts, key="cluster").select("cluster", "pred"), "cluster").select("point_id", "cluster", "pred")


def confusion(df: DataFrame, gt: str = "segment", pred: str = "pred", ignore: int = -1) -> DataFrame:
    """(gt, pred, n) without ignored ground truth; predictions of -1 stay, as what was left unassigned."""
    return df.where(F.col(gt) != ignore).groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def iou_counts(conf: DataFrame) -> DataFrame:
    """(class, inter, target, predicted, unassigned) of every class that occurs on either side."""
    n = F.col("n")
    sides = conf.select(F.explode(F.array(F.struct(F.col("gt").alias("class"), n.alias("target"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("gt") == F.col("pred"), n).otherwise(0).alias("inter"), F.when(F.col("pred") == -1, n).otherwise(0).alias("unassigned")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("target"), n.alias("predicted"), F.lit(0).cast("long").alias("inter"), F.lit(0).cast("long").alias("unassigned")))).alias("s")).select("s.*")
    return sides.where("class >= 0").groupBy("class").agg(*(F.sum(c).alias(c) for c in ("inter", "target", "predicted", "unassigned")))


def class_metrics(conf: DataFrame) -> DataFrame:
    """Per class: IoU, accuracy and the counts behind them. Without a union the IoU is null."""
    d = iou_counts(conf).withColumn("union", F.col("target") + F.col("predicted") - F.col("inter"))
    return d.select("class", "inter", "union", "target", "unassigned", (F.col("inter") / F.when(F.col("union") > 0, F.col("union"))).alias("iou"), (F.col("inter") / F.when(F.col("target") > 0, F.col("target"))).alias("acc"))


def seg_metrics(conf: DataFrame, excluded=(), mode: str = "present", count_unassigned: bool = True) -> DataFrame:
    """One row for all classes and one for the foreground (without ``excluded``): mIoU, mAcc, global accuracy, frequency
    weighted IoU and accuracy, and how many classes are missing from the ground truth.

    present: mean over classes with ground truth; all_eps: over all, 1e-10 in the denominators; union_nonzero: over classes
    with a union. ``count_unassigned`` keeps unassigned points in the denominators of the accuracies.
    """
    d = class_metrics(conf)
    if not count_unassigned:
        d = d.withColumns({"target": F.col("target") - F.col("unassigned")}).withColumn("acc", F.col("inter") / F.when(F.col("target") > 0, F.col("target")))
    both = d.withColumn("part", F.explode(F.when(F.col("class").isin(*excluded), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("foreground"))))) if excluded else d.withColumn("part", F.lit("all"))
    use = {"present": F.col("target") > 0, "all_eps": F.lit(True), "union_nonzero": F.col("union") > 0}[mode]
    iou = F.col("inter") / (F.col("union") + 1e-10) if mode == "all_eps" else F.col("iou")
    acc = F.col("inter") / (F.col("target") + 1e-10) if mode == "all_eps" else F.col("acc")
    pick = lambda c: F.avg(F.when(use, c))
    return both.groupBy("part").agg(
        pick(iou).alias("miou"), pick(acc).alias("macc"), (F.sum("inter") / F.sum("target")).alias("allacc"), (F.sum(F.col("target") * F.col("iou")) / F.sum("target")).alias("fwiou"),
        (F.sum(F.col("target") * F.col("acc")) / F.sum("target")).alias("fwacc"), F.count_if(F.col("target") == 0).alias("missing"),
    )


def scene_metrics(df: DataFrame) -> DataFrame:
    """Per scene its mIoU, and the running mean over the scenes before and including it."""
    c = df.where("segment <> -1").groupBy("scene_id", F.col("segment").alias("gt"), "pred").agg(F.count("*").alias("n"))
    t = c.groupBy("scene_id", F.col("gt").alias("class")).agg(F.sum("n").alias("target"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("inter"))
    p = c.groupBy("scene_id", F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    d = t.join(p, ["scene_id", "class"], "left").withColumn("iou", F.col("inter") / (F.col("target") + F.coalesce("predicted", F.lit(0)) - F.col("inter")))
    s = d.groupBy("scene_id").agg(F.avg("iou").alias("miou"), (F.sum("inter") / F.sum("target")).alias("acc"))
    return s.withColumn("running", F.avg("miou").over(Window.orderBy("scene_id").rowsBetween(Window.unboundedPreceding, 0)))


def multilabel_metrics(df: DataFrame) -> DataFrame:
    """Top-1 and top-3 accuracy, and true, false positives and misses of label sets. df: gt (array), preds (array, best first)."""
    hit1, hit3 = F.array_contains("gt", F.col("preds")[0]), F.arrays_overlap("gt", F.slice("preds", 1, 3))
    return df.agg(
        F.count("*").alias("n"), F.avg(hit1.cast("double")).alias("top1"), F.avg(hit3.cast("double")).alias("top3"), F.sum(F.size(F.array_intersect("preds", "gt"))).alias("tp"),
        F.sum(F.size(F.array_except("preds", "gt"))).alias("fp"), F.sum(F.size(F.array_except("gt", "preds"))).alias("fn"),
    )


def seg_metrics_void0(df: DataFrame, subset) -> DataFrame:
    """Ground truth 0 is void, classes outside ``subset`` become 0, unassigned becomes 0; then per class IoU over the subset."""
    gt = F.when(F.col("segment").isin(*subset), F.col("segment")).otherwise(0)
    pred = F.when(F.col("pred").isin(*subset), F.col("pred")).otherwise(0)
    return class_metrics(confusion(df.select(gt.alias("segment"), pred.alias("pred")), ignore=0)).where("class > 0")


def cls_metrics(df: DataFrame) -> DataFrame:
    """Overall and mean class accuracy of (segment, pred)."""
    c = df.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(F.col("segment") == F.col("pred")).alias("hit"))
    return c.agg((F.sum("hit") / F.sum("n")).alias("allacc"), F.avg(F.col("hit") / F.col("n")).alias("macc"))


def vote_runs(scores: DataFrame) -> DataFrame:
    """(id, segment, pred): class with the largest sum of scores over runs; ties to the lowest. scores: run, id, segment, label, score."""
    s = scores.groupBy("id", "segment", "label").agg(F.round(F.sum("score"), 9).alias("s"))
    return s.groupBy("id", "segment").agg(F.max(F.struct("s", -F.col("label"))).alias("b")).select("id", "segment", (-F.col("b.col2")).cast("int").alias("pred"))


def part_iou(df: DataFrame, parts: DataFrame) -> DataFrame:
    """(category, shapes, iou): mean over a category's parts, then over its shapes; a part absent on both sides counts 1.
    df: shape, category, part, pred; parts: category, part."""
    p, g = F.col("pred"), F.col("part")
    shapes = df.select("shape", "category").distinct().join(parts, "category")
    t = df.groupBy("shape", F.col("part").alias("k")).agg(F.count("*").alias("t"), F.count_if(p == g).alias("i"))
    q = df.groupBy("shape", F.col("pred").alias("k")).agg(F.count("*").alias("p"))
    d = shapes.withColumnRenamed("part", "k").join(t, ["shape", "k"], "left").join(q, ["shape", "k"], "left").fillna(0, ["t", "i", "p"])
    u = F.col("t") + F.col("p") - F.col("i")
    s = d.groupBy("category", "shape").agg(F.avg(F.when(u == 0, 1.0).otherwise(F.col("i") / u)).alias("iou"))
    return s.groupBy("category").agg(F.count("*").alias("shapes"), F.avg("iou").alias("iou"))


def assign_instances(pairs: DataFrame) -> DataFrame:
    """(scene_id, class, threshold, pred_id, instance): predictions in the order of their scores (then ids) take the free instance
    that they overlap most (then the least id). pairs: these columns, score and iou, only what may be matched.

    In a round, a prediction and an instance are matched if the one is the prediction's best and no better prediction wants the
    other; nobody that comes later can change that, so the rounds end in what the order gives. The first prediction of every
    group is matched in each round, and all groups go on at once; only pairs of two free ends are carried on. There are as many
    rounds as the longest chain of predictions that each want what the one before takes.
    """
    keys = ["scene_id", "class", "threshold"]
    left, out = saved(pairs.select(*keys, "pred_id", "instance", "score", "iou"), "pairs"), []
    while not left.isEmpty():
        best = F.max_by("instance", F.struct("iou", -F.col("instance"))).over(Window.partitionBy(*keys, "pred_id"))
        first = F.max_by("pred_id", F.struct("score", -F.col("pred_id"))).over(Window.partitionBy(*keys, "instance"))
        met = left.withColumn("_best", best).withColumn("_first", first).where("_best = instance and _first = pred_id")
        out.append(saved(met.select(*keys, "pred_id", "instance"), "matched"))
        for end in ("pred_id", "instance"):
            left = left.join(out[-1].select(*keys, end).hint("merge"), [*keys, end], "left_anti")
        left = saved(left, "pairs")
    return reduce(DataFrame.unionByName, out) if out else left.select(*keys, "pred_id", "instance")


def instance_ap(matches: DataFrame, preds: DataFrame, gt: DataFrame, thresholds=(0.25, 0.5, 0.75), min_region: int = 1) -> DataFrame:
    """(class, threshold, ap): average precision of predicted instances.

    matches: scene_id, pred_id, instance, class, iou; preds: scene_id, pred_id, class, score, n, void_share; gt: scene_id,
    instance, class, n. Per scene, class and threshold the predictions are matched by score (then id) to the true instance of
    highest IoU that is still free (``assign_instances``); unmatched predictions that are mostly void or small don't count.
    """
    levels = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    each = saved(preds.select("scene_id", "class", "pred_id", "score", "n", "void_share", levels), "predictions")
    pairs = each.join(matches.hint("merge"), ["scene_id", "pred_id", "class"]).where(F.col("iou") > F.col("threshold"))
    met = assign_instances(pairs).withColumn("_met", F.lit(True))
    hits = each.join(met.hint("merge"), ["scene_id", "class", "threshold", "pred_id"], "left").withColumn("_met", F.coalesce("_met", F.lit(False)))
    hits = hits.where(F.col("_met") | ((F.col("void_share") <= F.col("threshold")) & (F.col("n") >= min_region)))
    hits = hits.select("class", "threshold", "score", F.col("_met").cast("int").alias("tp"), (~F.col("_met")).cast("int").alias("fp"))
    total = gt.where(F.col("n") >= min_region).groupBy("class").agg(F.count("*").alias("gts"))
    # precision and recall at each score, then the area under the precision envelope
    by = hits.groupBy("class", "threshold", "score").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    down = Window.partitionBy("class", "threshold").orderBy(F.desc("score"))
    c = by.withColumns({"ctp": F.sum("tp").over(down), "cfp": F.sum("fp").over(down)}).join(total, "class")
    c = c.withColumns({"recall": F.col("ctp") / F.col("gts"), "precision": F.col("ctp") / (F.col("ctp") + F.col("cfp"))})
    tail = Window.partitionBy("class", "threshold").orderBy(F.desc("score")).rowsBetween(0, Window.unboundedFollowing)
    c = c.withColumn("best", F.max("precision").over(tail)).withColumn("step", F.col("recall") - F.coalesce(F.lag("recall").over(down), F.lit(0.0)))
    ap = c.groupBy("class", "threshold").agg(F.sum(F.col("best") * F.col("step")).alias("ap"))
    return total.select("class", levels).join(ap, ["class", "threshold"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def mask_iou_summary(pairs: DataFrame) -> DataFrame:
    """Mean IoU and the shares above 0.25 and 0.5. pairs: inter, uni."""
    iou = F.col("inter") / F.greatest("uni", F.lit(1))
    return pairs.agg(F.count("*").alias("n"), F.avg(iou).alias("iou"), F.avg((iou > 0.25).cast("double")).alias("above_25"), F.avg((iou > 0.5).cast("double")).alias("above_50"))


def threshold_map(scores: DataFrame, t: float) -> DataFrame:
    """(key, point_id, inside): a map scaled to 0 - 1, cut at ``t``. scores: key, point_id, score."""
    w = Window.partitionBy("key")
    s = (F.col("score") - F.min("score").over(w)) / F.greatest(F.max("score").over(w) - F.min("score").over(w), F.lit(1e-9))
    return scores.select("key", "point_id", (s >= t).alias("inside"))


def image_error(pixels: DataFrame) -> DataFrame:
    """Per frame: L1, MSE and PSNR of values a and b from 0 to 1."""
    d = F.col("a") - F.col("b")
    e = pixels.groupBy("frame").agg(F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("mse"))
    return e.withColumn("psnr", 20 * F.log10(1 / F.sqrt("mse")))


def prototype_consistency(df: DataFrame, temp: float = 0.1, seed: int = 0, min_rows: int = 20) -> DataFrame:
    """Two halves of each class (by draw) give two sets of prototypes; the symmetric cross-entropy of their cosine matrix over
    ``temp``, with the diagonal as target."""
    big = df.groupBy("segment").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).select("segment")
    half = F.conv(F.substring(draw(seed), 1, 1), 16, 10).cast("int") % 2
    long = df.join(big, "segment").select("segment", half.alias("h"), F.posexplode("feat").alias("pos", "v"))
    m = long.groupBy("segment", "h", "pos").agg(F.avg("v").alias("v"))
    side = lambda h, s: m.where(F.col("h") == h).select(F.col("segment").alias(s), "pos", F.col("v").alias(f"v{s}"))
    c = side(0, "a").join(side(1, "b").hint("merge"), "pos").groupBy("a", "b").agg((F.sum(F.col("va") * F.col("vb")) / F.sqrt(F.sum(F.col("va") * F.col("va")) * F.sum(F.col("vb") * F.col("vb"))) / temp).alias("z"))
    lse = lambda k: c.groupBy(k).agg((F.log(F.sum(F.exp("z"))) - F.sum(F.when(F.col("a") == F.col("b"), F.col("z")))).alias("l")).agg(F.avg("l").alias("l"))
    return lse("a").withColumnRenamed("l", "la").join(lse("b").withColumnRenamed("l", "lb")).select(((F.col("la") + F.col("lb")) / 2).alias("loss"))


def density_consistency(common: DataFrame, keys) -> DataFrame:
    """Over cells that two samples share (keys, pos, a, b): mean squared error, mean 1 - cosine and mean KL of the softmax."""
    a, b = F.col("a"), F.col("b")
    c = common.groupBy(*keys).agg(F.avg((a - b) * (a - b)).alias("mse"), (1 - F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"),
        (F.sum(F.exp(a) * (a - b)) / F.sum(F.exp(a)) - F.log(F.sum(F.exp(a))) + F.log(F.sum(F.exp(b)))).alias("kl"))
    return c.agg(F.count("*").alias("cells"), F.avg("mse").alias("mse"), F.avg("cosine").alias("cosine"), F.avg("kl").alias("kl"))


def valid_separation(df: DataFrame) -> DataFrame:
    """How far valid and invalid rows stand apart: cosine of the two mean unit vectors (the mean over all cross pairs, exactly)
    and the mean length of each side."""
    u = df.select("valid", norm(F.col("feat")).alias("length"), F.posexplode(F.transform("feat", lambda x: x / F.greatest(norm(F.col("feat")), F.lit(1e-12)))).alias("pos", "v"))
    m = u.groupBy("pos").agg(F.avg(F.when(F.col("valid"), F.col("v"))).alias("a"), F.avg(F.when(~F.col("valid"), F.col("v"))).alias("b"), F.avg(F.when(F.col("valid"), F.col("length"))).alias("la"), F.avg(F.when(~F.col("valid"), F.col("length"))).alias("lb"))
    return m.agg(F.sum(F.col("a") * F.col("b")).alias("cross_cosine"), F.avg("la").alias("valid_norm"), F.avg("lb").alias("invalid_norm"))


def collapse_check(pred: DataFrame, gt: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Largest and mean difference of two feature sets, the share of equal rows, and the mean cosine over all pairs of
    predictions, exactly, from the mean unit vector, and the share of drawn pairs whose cosine is 0.95 or more."""
    j = pred.select("point_id", F.col("feat").alias("p")).join(gt.select("point_id", F.col("feat").alias("g")), "point_id")
    gaps = F.zip_with("p", "g", lambda a, b: F.abs(a - b))
    s = j.select(F.array_max(gaps).alias("m"), (F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / F.size("p")).alias("l")).agg(F.count("*").alias("n"), F.max("m").alias("largest"), F.avg("l").alias("mean"), F.avg((F.col("m") <= tol).cast("double")).alias("equal"))
    u = pred.select(F.posexplode(F.transform("feat", lambda x: x / F.greatest(norm(F.col("feat")), F.lit(1e-12)))).alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("s"), F.count("*").alias("k"))
    c = u.agg(((F.sum(F.col("s") * F.col("s")) - F.max("k")) / (F.max("k") * (F.max("k") - 1))).alias("pair_cosine"))
    # drawn pairs: neighbours in the order of md5, inside the 256 stretches of its first two digits
    order = Window.partitionBy(F.substring("_d", 1, 2)).orderBy("_d")
    met = pred.select(F.md5(F.col("point_id").cast("string")).alias("_d"), F.col("feat").alias("a")).withColumn("b", F.lead("a").over(order)).where("b is not null")
    alike = met.agg(F.avg((cosine(F.col("a"), F.col("b")) >= 0.95).cast("double")).alias("alike_pairs"))
    return s.join(F.broadcast(c)).join(F.broadcast(alike))


def quality_gate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(name, value, status, factor) of each metric against its limit. metrics: name, value; limits: name, limit, higher."""
    d = metrics.join(limits, "name")
    good = F.when(F.col("higher"), F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    return d.select("name", "value", F.when(good, "pass").otherwise("fail").alias("status"), F.when(F.col("higher"), F.col("value") / F.col("limit")).otherwise(F.col("limit") / F.col("value")).alias("factor"))


def cell_alignment(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Per scene: mean over cells of the squared difference between a cell's mean feature and its stored code (long form:
    scene_id, grid_id, pos, code)."""
    m = points.select("scene_id", "grid_id", F.posexplode("feat").alias("pos", "v")).groupBy("scene_id", "grid_id", "pos").agg(F.avg("v").alias("v"))
    d = m.join(grid.hint("merge"), ["scene_id", "grid_id", "pos"]).groupBy("scene_id", "grid_id").agg(F.avg((F.col("v") - F.col("code")) ** 2).alias("e"))
    return d.groupBy("scene_id").agg(F.count("*").alias("cells"), F.avg("e").alias("error"))
