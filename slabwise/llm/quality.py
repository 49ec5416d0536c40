"""Document quality by hierarchical empirical Bayes.

A classifier of the text gives each document's own evidence. Labelled documents give
each host, and each path within a host, a posterior share of good documents: a beta
prior whose strength is estimated from how much hosts (and paths) really differ
shrinks a host towards the global share and a path towards its host, the more the
fewer labels it has. A document's score combines the two on the log-odds scale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hashed_share, held_out, salted_join, sigmoid

#: Labelled rows that the text classifier is fitted on, about and at most, of each label.
SAMPLE_PER_LABEL = 10_000

#: A document is kept from this score.
KEEP = 0.5

#: Byte classes whose shares the classifier sees, by their members.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r",
    "newline": b"\n",
    "stop": b".,;:'\"()-",
    "shout": b"!?",
    "mark": b"#$%&*+/<=>@[]^_`{}~\\",
    "bar": b"|",
}
FEATURES = [*CLASSES, "other", "log_length", "word_length", "new_words", "new_pairs"]

_TABLE = np.full(256, len(CLASSES), dtype=np.uint8)
for _k, _bytes in enumerate(CLASSES.values()):
    _TABLE[np.frombuffer(_bytes, dtype=np.uint8)] = _k


def features(text: str) -> list[float]:
    """Shares of the byte classes, length, and the shares of words and neighbouring words that are new. Whole texts are read."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    shares = np.bincount(_TABLE[raw], minlength=len(CLASSES) + 1) / max(1, len(raw))
    w = text.split()
    n = len(w)
    return [*shares.tolist(), np.log1p(len(raw)), sum(map(len, w)) / n if n else 0.0, len(set(w)) / n if n else 0.0, len(set(zip(w, w[1:]))) / (n - 1) if n > 1 else 1.0]


def with_features(docs: DataFrame, text: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns `keep` and x array<double>."""
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), text.alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]

    def measure(batches):
        for batch in batches:
            x = [features(t.as_py() or "") for t in batch.column("__text")]
            cols = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(x, pa.list_(pa.float64()))], names=[*(f.name for f in fields), "x"])

    return rows.mapInArrow(measure, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "x array<double>"]))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (bias last) of a ridge-penalised logistic regression with squares, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = _expand((x - mean) / scale)
    w = np.zeros(z.shape[1])
    penalty = ridge * np.append(np.ones(z.shape[1] - 1), 1e-6)
    for _ in range(30):
        p = sigmoid(z @ w)
        g = z.T @ (y - p) - penalty * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
    return mean, scale, w


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.column_stack([z, z**2, np.ones(len(z))])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """Score every document: classifier evidence combined with host and path posteriors.

    Labels of held-out documents are not learned from. Repeated labels of a document
    count as good if any does. Null hosts or paths are groups of their own; a null text is empty.
    Repeated rows and null ids are scored each. Without labels every score is a half. The moments that set the priors' strengths come from grouped sums
    over all hosts and paths, a few numbers whatever their number.

    Returns (id_col, score, text_score, host_posterior, path_posterior, host_labels, path_labels).
    """
    spark = docs.sparkSession
    keep = {"id": F.col(f"`{id_col}`"), "host": F.col(f"`{host_col}`").cast("string"), "path": F.col(f"`{path_col}`").cast("string")}
    measured = cut(with_features(docs, F.col(f"`{text_col}`"), keep))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("lid")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    taught = cut(measured.join(known, F.col("id") == F.col("lid")).select("id", "host", "path", "x", "y"))

    totals = taught.agg(F.count("y").alias("n"), F.sum("y").alias("k")).first()
    wanted = F.lit(False)
    for v, n in ((1, totals["k"] or 0), (0, totals["n"] - (totals["k"] or 0))):
        wanted |= (F.col("y") == v) & hashed_share(SAMPLE_PER_LABEL / max(1, n), "id", "x")
    # rows that repeat count once, so the sample stays about as large as wanted
    sample = taught.filter(wanted).select("id", "x", "y").distinct().select("x", "y").toArrow()
    sample = sample.take(np.lexsort((*np.array(sample.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES)).T, sample.column("y").to_numpy())))
    y = np.array(sample.column("y").to_pylist(), dtype=float)
    prior = ((totals["k"] or 0) + 0.5) / (totals["n"] + 1)
    if len(set(y.tolist())) == 2:
        x = np.array(sample.column("x").to_pylist(), dtype=float)
        mean, scale, w = fit_logistic(x, y)
        # the sample's share of good rows is not the table's
        w[-1] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    else:
        mean, scale, w = np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.append(np.zeros(2 * len(FEATURES)), np.log(prior / (1 - prior)))

    def judge(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(batch.num_rows, len(FEATURES))
            p = sigmoid(_expand((x - mean) / scale) @ w)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path")), pa.array(p, pa.float64())], names=["id", "host", "path", "text_score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    judged = measured.mapInArrow(judge, f"id {id_type}, host string, path string, text_score double")

    paths = cut(taught.groupBy("host", "path").agg(F.count("y").alias("n"), F.sum("y").alias("k")))
    hosts = paths.groupBy(F.col("host").alias("gh")).agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    host_m = _strength_of(hosts.select(F.col("hn").alias("n"), F.col("hk").alias("k"), F.lit(float(prior)).alias("p")))
    hosts = hosts.withColumn("hp", (F.col("hk") + F.lit(host_m * prior)) / (F.col("hn") + F.lit(host_m)))
    nested = paths.join(hosts, F.col("host").eqNullSafe(F.col("gh"))).select("gh", "path", "n", "k", "hn", "hp")
    nested = cut(nested)
    path_m = _strength_of(nested.select("n", "k", F.col("hp").alias("p")))
    by_path = nested.select(F.col("gh").alias("ph"), F.col("path").alias("pp"), "n", ((F.col("k") + F.lit(path_m) * F.col("hp")) / (F.col("n") + F.lit(path_m))).alias("path_p"))
    by_host = nested.groupBy("gh").agg(F.max("hn").alias("hn"), F.max("hp").alias("hp"))

    # keys that nulls have too; a host may hold a third of all rows, so it is joined by parts
    host_key = lambda h: F.coalesce(F.concat(F.lit("="), h), F.lit(""))
    path_key = lambda h, p: F.concat(F.length(host_key(h)), F.lit(":"), host_key(h), host_key(p))
    keyed = judged.withColumns({"host_key": host_key(F.col("host")), "path_key": path_key(F.col("host"), F.col("path"))})
    of_host = by_host.select(host_key(F.col("gh")).alias("host_key"), "hn", "hp")
    of_path = by_path.select(path_key(F.col("ph"), F.col("pp")).alias("path_key"), "n", "path_p")
    joined = salted_join(salted_join(keyed, of_host, "host_key", "left"), of_path, "path_key", "left")
    host_p = F.coalesce("hp", F.lit(float(prior)))
    path_p = F.coalesce("path_p", host_p)
    logit = lambda c: F.log(c / (1 - c))
    clipped = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("text_score")))
    total = logit(clipped) + logit(path_p) - F.lit(float(np.log(prior / (1 - prior))))
    return joined.select(
        F.col("id").alias(id_col),
        (1 / (1 + F.exp(-total))).alias("score"),
        "text_score",
        host_p.alias("host_posterior"),
        path_p.alias("path_posterior"),
        F.coalesce("hn", F.lit(0)).alias("host_labels"),
        F.coalesce("n", F.lit(0)).alias("path_labels"),
    )


def _strength_of(groups: DataFrame, least: float = 1.0, most: float = 1000.0) -> float:
    """Prior observations of a beta prior, by moments over groups of (n labels, k good, p prior share).

    E[(k/n - p)^2] = p (1 - p) (1/n + (1 - 1/n) / (1 + strength)). Groups that differ no
    more than chance would have it get `most`. Three sums come to the driver.
    """
    p = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("p")))
    n = F.col("n").cast("double")
    excess = (F.col("k") / n - p) ** 2 / (p * (1 - p)) - 1 / n
    row = groups.filter("n >= 2").agg(F.count("*").alias("c"), F.sum((n - 1) * excess).alias("a"), F.sum((n - 1) * (1 - 1 / n)).alias("b")).first()
    if row["c"] < 2:
        return most
    rho = row["a"] / max(1e-9, row["b"])
    return most if rho <= 1 / (1 + most) else float(np.clip(1 / rho - 1, least, most))
