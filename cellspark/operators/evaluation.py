"""Metrics, losses, splits and pooling as aggregates."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(predictions: DataFrame) -> DataFrame:
    """(y, pred, n) of (y, pred)."""
    return predictions.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Per class: support, precision, recall, f1; 0 where undefined."""
    sides = matrix.select(F.col("y").alias("c"), F.col("n").alias("actual"), F.lit(0).alias("said"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.union(matrix.select("pred", F.lit(0), "n", F.lit(0))).groupBy("c")
    s = sides.agg(F.sum("actual").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    p, r = (F.when(F.col(n) > 0, F.col("hit") / F.col(n)).otherwise(0.0) for n in ("said", "support"))
    f1 = F.when(F.col("support") + F.col("said") > 0, 2 * F.col("hit") / (F.col("support") + F.col("said"))).otherwise(0.0)
    return s.select("c", "support", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "hit")


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """One row: accuracy (micro), macro precision, recall and f1, weighted f1."""
    s = class_scores(confusion(predictions))
    n = F.sum("support")
    return s.agg(
        (F.sum("hit") / n).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
    )


def auroc(scores: DataFrame, ranges: int = 4096) -> DataFrame:
    """One row, auroc of (y 0/1, score): counts per distinct score, then running sums within `ranges` of scores and over
    the ranges, so ties count half and no task orders all scores."""
    per = scores.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    ends = per.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(ranges - 1), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges))).otherwise(0)
    per = per.crossJoin(F.broadcast(ends)).select("score", "p", "q", place.alias("range"))  # one row
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.groupBy("range").agg(F.sum("q").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("q").over(Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = per.withColumn("below", inside).join(F.broadcast(starts), "range")  # at most `ranges` rows
    won = won.select("p", "q", (F.col("p") * (F.col("below") + F.col("start") + F.col("q") / 2)).alias("won"))
    return won.agg((F.sum("won") / (F.sum("p") * F.sum("q"))).alias("auroc"))


def auroc_macro(scores: DataFrame, classes: list) -> DataFrame:
    """One row, auroc: the mean over classes of one against the rest, of (y, z array of a score for each class)."""
    each = [auroc(scores.select((F.col("y") == F.lit(c)).cast("int").alias("y"), F.get("z", F.lit(i)).alias("score"))) for i, c in enumerate(classes)]
    return reduce(DataFrame.union, each).agg(F.avg("auroc").alias("auroc"))


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """One row: mae, mse, rmse, r2 of (y, pred)."""
    e = F.col("pred") - F.col("y")
    mse = F.avg(e * e)
    return predictions.agg(F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), (1 - mse / F.var_pop("y")).alias("r2"))


def cross_entropy(logits: DataFrame) -> DataFrame:
    """One row, loss of (z array, y index): the mean of log-sum-exp less the logit of y."""
    top = F.array_max("z")
    total = F.log(F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - top))) + top
    return logits.agg(F.avg(total - F.get("z", F.col("y").cast("int"))).alias("loss"))


def masked_bce(logits: DataFrame) -> DataFrame:
    """One row, loss of (z array, y array with nulls): means over a row's known targets, then over rows."""
    each = F.zip_with("z", "y", lambda z, y: F.when(y.isNotNull(), F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))))
    known = F.filter(each, lambda v: v.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known))
    return logits.agg(F.avg(mean).alias("loss"))


def order_key(item: str, seed: int) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.col(item).cast("string"), F.lit(str(seed))))


def random_split(items: DataFrame, item: str, train: float, seed: int = 42) -> DataFrame:
    """(item, split): the share `train`, half of the rest for valid, the rest for test, by digest. A bucket of 4,096 is
    ranked on its own with the count of those before it, so the sizes are exact and no task sees all rows."""
    keyed = items.select(item, order_key(item, seed).alias("key")).withColumn("bucket", F.substring("key", 1, 3))
    n = keyed.count()
    starts = keyed.groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("bucket").orderBy("key", item)) - 1
    first, second = int(n * train), int(n * (1 - train) / 2)
    name = F.when(place < first, "train").when(place < first + second, "valid").otherwise("test")
    return keyed.join(F.broadcast(starts), "bucket").select(item, name.alias("split"))  # 4,096 rows


def stratified_folds(items: DataFrame, item: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """(item, label, fold): dealt round within each label by digest; each fold is its run's valid and test part."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(order_key(item, seed), item)) - 1
    return items.select(item, label, (place % k).alias("fold"))


def standardised(items: DataFrame, value: str, split: str = "split") -> DataFrame:
    """items with `value` less the mean and over the sample deviation of the train rows."""
    stats = items.where(F.col(split) == "train").agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return items.crossJoin(F.broadcast(stats)).withColumn(value, (F.col(value) - F.col("m")) / F.col("s")).drop("m", "s")


def pooled(x: DataFrame) -> DataFrame:
    """(graph_id, n, total, mean, most) of (graph_id, x)."""
    return x.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.avg("x").alias("mean"), F.max("x").alias("most"))


def batch_offsets(x: DataFrame, batch_size: int) -> DataFrame:
    """(graph_id, batch, n, start): graphs in order, batch_size a batch, and where a graph's nodes begin in its batch."""
    from .graph import dense_ids

    sizes = x.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    placed = sizes.join(dense_ids(sizes, "graph_id", "i"), "graph_id").withColumn("batch", F.floor(F.col("i") / batch_size))
    before = Window.partitionBy("batch").orderBy("graph_id").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("graph_id", "batch", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def seeded_splits(n: int, train: float, seed: int = 42, folds: int = 10) -> list[dict[str, list[int]]]:
    """The ten splits that one seeded generator gives, as positions: permutations in a row, cut at int(n * train) and
    int(n * (1 - train) / 2). For tables whose ids fit the driver; random_split has no such bound."""
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(folds):
        order = rng.permutation(n).tolist()
        first, second = int(n * train), int(n * (1 - train) / 2)
        out.append({"train": order[:first], "valid": order[first : first + second], "test": order[first + second :]})
    return out


def random_folds(items: DataFrame, item: str, train: float, folds: int = 10, seed: int = 42) -> DataFrame:
    """(item, fold, split): as many independent splits as folds; a run takes the fold of its seed modulo folds."""
    made = [random_split(items, item, train, seed * 1000 + f).withColumn("fold", F.lit(f)) for f in range(folds)]
    return reduce(DataFrame.union, (m.select(item, "fold", "split") for m in made))


def fixed_split(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of the parts by name, with `split`; their columns must be alike."""
    return reduce(DataFrame.unionByName, (df.withColumn("split", F.lit(name)) for name, df in parts.items()))


def split_graphs(graphs: DataFrame, splits: DataFrame) -> DataFrame:
    """graphs with each graph's split (graph_id, split); a graph without one is an error, as is one with two."""
    checked = splits.groupBy("graph_id").agg(F.when(F.count_distinct("split") == 1, F.min("split")).otherwise(F.raise_error(F.lit("a graph in several splits"))).alias("split"))
    joined = graphs.join(checked, "graph_id", "left")
    return joined.withColumn("split", F.coalesce("split", F.raise_error(F.lit("a graph without a split")).cast("string")))


def saved_splits(items: DataFrame, item: str, masks: DataFrame) -> DataFrame:
    """(item, split) from saved masks (item, train, valid, test), of which one at most may hold."""
    several = F.col("train").cast("int") + F.col("valid").cast("int") + F.col("test").cast("int") > 1
    name = F.when(several, F.raise_error(F.lit("masks overlap")).cast("string")).when(F.col("train"), "train").when(F.col("valid"), "valid").when(F.col("test"), "test")
    return items.select(item).join(masks, item, "left").select(item, name.alias("split"))


def write_splits(splits: DataFrame, path: str) -> None:
    """A folder for each fold."""
    splits.write.mode("overwrite").partitionBy("fold").parquet(path)


def collated(operator: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(batch, row, col, val): the operators of a batch's graphs as one block-diagonal one. operator is (graph_id, row, col,
    val), its indices from 0 in each graph; rows and cols are batch_offsets of both ranks."""
    r = rows.select("graph_id", "batch", F.col("start").alias("r0"))
    c = cols.select("graph_id", F.col("start").alias("c0"))
    return operator.join(r, "graph_id").join(c, "graph_id").select("batch", (F.col("row") + F.col("r0")).alias("row"), (F.col("col") + F.col("c0")).alias("col"), "val")


def batch_membership(offsets: DataFrame) -> DataFrame:
    """(batch, cell, graph): for each cell of a batch the place of its graph in it."""
    place = F.row_number().over(Window.partitionBy("batch").orderBy("graph_id")) - 1
    return offsets.withColumn("graph", place).where("n > 0").select("batch", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("cell"), "graph")


def cell_statistics(cells: DataFrame, max_rank: int) -> DataFrame:
    """(graph_id, n0, n1, ..): how many cells of each rank a graph has."""
    return cells.groupBy("graph_id").agg(*(F.count(F.when(F.col("rank") == r, 1)).alias(f"n{r}") for r in range(max_rank + 1)))


def shuffled_batches(graphs: DataFrame, batch_size: int, seed: int, epoch: int = 0) -> DataFrame:
    """(graph_id, batch): graphs in the order of a hash that changes with the epoch, batch_size a batch."""
    from .graph import dense_ids, hashed

    drawn = graphs.select("graph_id", hashed("graph_id", F.lit(seed), F.lit(epoch)).alias("h"))
    return drawn.join(dense_ids(drawn, "h", "i"), "h").select("graph_id", F.floor(F.col("i") / batch_size).alias("batch"))


class Evaluator:
    """Metrics of batches that come one after another: what is kept is a small table of sums, not the predictions.

    task is `classification` (at least two classes), `multilabel`, or `regression`.
    """

    def __init__(self, task: str, classes: int = 0) -> None:
        if task not in ("classification", "multilabel", "regression") or task == "classification" and classes < 2:
            raise ValueError("a known task, and two classes at least")
        self.task, self.classes = task, classes
        self.reset()

    def reset(self) -> None:
        self.matrix: dict[tuple, int] = {}
        self.sums = [0.0] * 6

    def update(self, batch: DataFrame) -> None:
        """Adds (y, pred): numbers, or for multilabel arrays of 0 and 1 with nulls where nothing is known."""
        if self.task == "regression":
            e = F.col("pred") - F.col("y")
            row = batch.agg(F.count("y"), F.sum(F.abs(e)), F.sum(e * e), F.sum("y"), F.sum(F.col("y") * F.col("y"))).first()
            self.sums = [a + (b or 0) for a, b in zip(self.sums, row)]
            return
        rows = batch
        if self.task == "multilabel":
            rows = batch.select(F.posexplode(F.arrays_zip("y", "pred")).alias("label", "both")).select("label", "both.y", "both.pred").where("y IS NOT NULL")
        keys = ["label", "y", "pred"] if self.task == "multilabel" else ["y", "pred"]
        for r in rows.groupBy(*keys).count().collect():  # as many rows as pairs of classes
            key = tuple(r[k] for k in keys)
            self.matrix[key] = self.matrix.get(key, 0) + r["count"]

    def compute(self) -> dict[str, float]:
        if self.task == "regression":
            n, absolute, square, y, yy = self.sums[:5]
            mse, spread = square / n, yy / n - (y / n) ** 2
            return {"mae": absolute / n, "mse": mse, "rmse": mse**0.5, "r2": 1 - mse / spread if spread else 0.0}
        classes = sorted({k[-2] for k in self.matrix} | {k[-1] for k in self.matrix})
        total = sum(self.matrix.values())
        hits = {c: sum(n for k, n in self.matrix.items() if k[-2] == k[-1] == c) for c in classes}
        support, said = ({c: sum(n for k, n in self.matrix.items() if k[at] == c) for c in classes} for at in (-2, -1))
        p, r = ([hits[c] / d[c] if d[c] else 0.0 for c in classes] for d in (said, support))
        f = [2 * hits[c] / (support[c] + said[c]) if support[c] + said[c] else 0.0 for c in classes]
        n = len(classes)
        return {"accuracy": sum(hits.values()) / total, "precision": sum(p) / n, "recall": sum(r) / n, "f1": sum(f) / n, "f1_macro": sum(f) / n, "f1_weighted": sum(x * support[c] for x, c in zip(f, classes)) / total}


def total_loss(*losses: DataFrame) -> DataFrame:
    """One row, loss: the sum of one-row losses, those of a dataset and of a model's parts."""
    return reduce(DataFrame.union, (x.select("loss") for x in losses)).agg(F.sum("loss").alias("loss"))


def regression_loss(predictions: DataFrame, kind: str = "mse") -> DataFrame:
    """One row, loss: mse or mae of (y, pred)."""
    e = F.col("pred") - F.col("y")
    return predictions.agg(F.avg(e * e if kind == "mse" else F.abs(e)).alias("loss"))


def structure_loss(points: DataFrame, weight: float = 1.0) -> DataFrame:
    """One row, loss of a learned graph: the mean over rows (y, pred, accuracy, logp array) of the running accuracy (null:
    0.5) less whether the prediction is right, times the mean of exp logp."""
    right = (F.col("pred") == F.col("y")).cast("double")
    chance = F.aggregate(F.transform("logp", F.exp), F.lit(0.0), lambda s, v: s + v) / F.size("logp")
    return points.agg((weight * F.avg((F.coalesce("accuracy", F.lit(0.5)) - right) * chance)).alias("loss"))


def contrast_loss(similarities: DataFrame, near: DataFrame, tau: float = 1.0, weight: float = 1.0) -> DataFrame:
    """One row, loss: the mean over rows of -log of their share of exp(tau similarity) that falls on `near` (row, col, val),
    a power of the adjacency; similarities is (row, col, similarity)."""
    e = F.exp(tau * F.col("similarity"))
    joined = similarities.join(near, ["row", "col"], "left")
    rows = joined.groupBy("row").agg(F.sum(e).alias("all"), F.sum(e * F.coalesce("val", F.lit(0.0))).alias("near"))
    return rows.agg((weight * -F.avg(F.log(F.col("near") / F.col("all") + 1e-8))).alias("loss"))


def best_epoch(history: DataFrame, monitor: str, mode: str = "min") -> DataFrame:
    """The row of (epoch, metrics) with the least, or greatest, value of the metric; of equals the first epoch."""
    if mode not in ("min", "max"):
        raise ValueError(f"no such mode: {mode}")
    value = F.col(monitor) if mode == "min" else -F.col(monitor)
    return history.agg(F.min_by(F.struct(*history.columns), F.struct(value, "epoch")).alias("best")).select("best.*")


def timings(samples: DataFrame, skipped: int = 10) -> DataFrame:
    """(stage, n, mean, std) of (stage, i, seconds), the first samples of each stage left out, but none of `test`."""
    kept = samples.where((F.col("stage") == "test") | (F.col("i") >= skipped))
    return kept.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("std"))


def example_metric(predictions: DataFrame) -> DataFrame:
    """One row, mean_squared_error, from partial sums (sum of squares, rows) that add up over batches."""
    e = F.col("pred") - F.col("y")
    return predictions.agg(F.sum(e * e).alias("s"), F.count("y").alias("n")).select((F.col("s") / F.col("n")).alias("mean_squared_error"))


def class_homophily(shares: DataFrame, labels: DataFrame, members: DataFrame) -> DataFrame:
    """(step, y, p): the mean of message_homophily's share of a node's own label, over the nodes of a class that are in a
    hyperedge of two nodes or more."""
    wide = members.groupBy("he").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    nodes = members.join(wide, "he", "left_semi").select("node").distinct()
    own = labels.join(nodes, "node", "left_semi")
    steps = shares.select("step").distinct()
    every = own.crossJoin(F.broadcast(steps)).join(shares, ["step", "node", "y"], "left")  # a row for each step
    return every.groupBy("step", "y").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("p"))
