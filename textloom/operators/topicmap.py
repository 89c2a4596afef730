"""Maps of topics: distances of their term distributions, coordinates from these, and words that are unlike each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize


def topic_distances(terms: DataFrame) -> DataFrame:
    """(topic1, topic2, distance), topic1 < topic2: the Jensen-Shannon divergence, in nats, of the topics' terms; terms are (topic, term).

    Only terms that both topics have are joined: of all others a topic's share adds half of ln 2 of it.
    """
    n = terms.groupBy("topic", "term").agg(F.count("*").alias("n"))
    size = n.groupBy("topic").agg(F.sum("n").alias("size"))
    p = materialize(n.join(size, "topic").select("topic", "term", (F.col("n") / F.col("size")).alias("p")), "shares")
    a, b = p.toDF("topic1", "term", "p"), p.toDF("topic2", "term", "q")
    x, y = F.col("p"), F.col("q")
    part = x * F.log(2 * x / (x + y)) + y * F.log(2 * y / (x + y)) - (x + y) * float(np.log(2))
    shared = a.join(b, "term").where("topic1 < topic2").groupBy("topic1", "topic2").agg(F.sum(part).alias("s"))
    ids = size.select("topic")
    grid = ids.toDF("topic1").join(ids.toDF("topic2"), F.col("topic1") < F.col("topic2"))  # topics by topics: the result's own rows
    distance = float(np.log(2)) + F.coalesce("s", F.lit(0.0)) / 2
    return grid.join(shared, ["topic1", "topic2"], "left").select("topic1", "topic2", F.round(F.greatest(F.lit(0.0), distance), 6).alias("distance"))


def topic_coordinates(terms: DataFrame) -> DataFrame:
    """(topic, x, y, share): principal coordinates of the distances, and the topic's share of all terms in per cent.

    An axis points to where its farthest topic is positive. The matrix of topics by topics is worked on the driver.
    """
    rows = topic_distances(terms).toPandas()
    sizes = {r.topic: r.n for r in terms.groupBy("topic").agg(F.count("*").alias("n")).collect()}
    topics = sorted(sizes)
    at = {t: k for k, t in enumerate(topics)}
    d = np.zeros((len(topics), len(topics)))
    for a, b, x in zip(rows["topic1"], rows["topic2"], rows["distance"], strict=True):
        d[at[a], at[b]] = d[at[b], at[a]] = x
    xy = coordinates(d)
    total = sum(sizes.values()) or 1
    kind = terms.schema["topic"].dataType.simpleString()
    return terms.sparkSession.createDataFrame([(t, float(xy[k, 0]), float(xy[k, 1]), round(100 * sizes[t] / total, 4)) for t, k in at.items()], f"topic {kind}, x double, y double, share double")


def coordinates(d: np.ndarray) -> np.ndarray:
    """Two principal coordinates of a matrix of distances (Gower 1966)."""
    n = len(d)
    out = np.zeros((n, 2))
    if n:
        h = np.eye(n) - 1 / n
        value, vector = np.linalg.eigh(-h @ (d * d) @ h / 2)
        for k, j in enumerate(np.argsort(-value)[:2]):
            v = vector[:, j] * np.sqrt(max(0.0, value[j]))
            out[:, k] = v * (1 if v[np.abs(v).argmax()] >= 0 else -1)
    return out


def diverse_words(weights: DataFrame, vectors: DataFrame, k: int = 10, *, diversity: float = 0.3, pool: int = 30) -> DataFrame:
    """(topic, term, rank, mmr): of each topic's `pool` heaviest terms the k picked by maximal marginal relevance.

    weights are (topic, term, score), vectors (term, v). A topic's vector is the mean of its pool's, by
    score. Each pick is best in (1 - diversity) * likeness to the topic less diversity * likeness to the
    nearest pick so far; ties go to the heavier term, then to the alphabet. Terms without a vector, or with
    one of zeros, are like nothing. A topic's pool meets in one task.
    """
    first = Window.partitionBy("topic").orderBy(F.desc("score"), "term")
    best = weights.select("topic", "term", "score").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= pool)
    rows = best.join(vectors.select("term", "v"), "term", "left")
    kind = weights.schema["topic"].dataType.simpleString()

    def pick(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("nth")
        d = max([len(v) for v in x["v"] if v is not None], default=1)
        m = np.array([np.zeros(d) if v is None else np.asarray(v, float) for v in x["v"]])
        unit = lambda y: y / np.where((n := np.linalg.norm(y, axis=-1, keepdims=True)) > 0, n, 1)
        topic = unit((m * x["score"].to_numpy()[:, None]).sum(0))
        u = unit(m)
        near, like = u @ topic, u @ u.T
        taken, value = [], []
        left = np.ones(len(u), bool)
        for _ in range(min(k, len(u))):
            mmr = (1 - diversity) * near - diversity * like[:, taken].max(1) if taken else near
            j = int(np.where(left, np.round(mmr, 12), -np.inf).argmax())
            taken.append(j)
            value.append(float(mmr[j]))
            left[j] = False
        return pd.DataFrame({"topic": x["topic"].iloc[0], "term": x["term"].to_numpy()[taken], "rank": np.arange(1, len(taken) + 1), "mmr": value})

    return rows.groupBy("topic").applyInPandas(pick, f"topic {kind}, term string, rank int, mmr double")


def term_profiles(weights: DataFrame) -> DataFrame:
    """(term, v): a term's scores in all topics, in order of these, as its vector; weights are (topic, term, score)."""
    topics = weights.select("topic").distinct().agg(F.sort_array(F.collect_list("topic")).alias("topics"))
    by = weights.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("topic", "score"))).alias("m")).crossJoin(F.broadcast(topics))  # one row
    return by.select("term", F.transform("topics", lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0)).cast("double")).alias("v"))
