"""k most similar vectors of every vector, by balanced posting lists.

Centroids come from a balanced hierarchical clustering of a bounded sample and
are searched through an in-memory neighbour graph.  Every vector is indexed;
one near a border goes to several lists.  A query visits the lists whose
distance is within a ratio of the closest.  Cosine is then exact (float64)
inside the visited lists.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SAMPLE_ROWS = 65_536
MAX_CENTROIDS = 16_384
LIST_ROWS = 256
BLOCK_ROWS = 8_192
GRAPH_DEGREE = 16
REPLICAS, REPLICA_RATIO = 3, 1.10
PROBES, PROBE_RATIO = 8, 1.25
BEAM = 24


# ---- index fitting (driver, on the bounded sample) -------------------------

def _split(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Spherical k-means labels with a pull towards equal sizes."""
    n = len(x)
    c = x[rng.choice(n, k, replace=False)]
    labels = np.zeros(n, dtype=np.int64)
    penalty = np.zeros(k, dtype=np.float32)
    for _ in range(8):
        labels = np.argmax(x @ c.T - penalty, axis=1)
        size = np.bincount(labels, minlength=k)
        penalty = 0.1 * np.maximum(0, size / (n / k) - 2).astype(np.float32)
        sums = np.zeros_like(c)
        np.add.at(sums, labels, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c).astype(np.float32)
    return labels


def fit_centroids(sample: np.ndarray, list_rows: float, seed: int = 7):
    """(centroids, sample rows of each): clusters over list_rows are split on."""
    rng = np.random.default_rng(seed)
    todo, cents, sizes = [np.arange(len(sample))], [], []
    while todo:
        at = todo.pop()
        if len(at) > list_rows and len(at) > 1:
            k = int(min(16, max(2, math.ceil(len(at) / list_rows))))
            labels = _split(sample[at], min(k, len(at)), rng)
            parts = [at[labels == j] for j in range(k)]
            parts = [p for p in parts if len(p)]
            if len(parts) > 1:
                todo.extend(parts)
                continue
        mean = sample[at].sum(axis=0)
        norm = np.linalg.norm(mean)
        cents.append(mean / norm if norm > 1e-9 else sample[at[0]])
        sizes.append(len(at))
    return np.asarray(cents, dtype=np.float32), np.asarray(sizes)


def build_graph(cents: np.ndarray, degree: int = GRAPH_DEGREE, seed: int = 7):
    """(neighbours of each centroid, entry points)."""
    c = len(cents)
    rng = np.random.default_rng(seed)
    near = min(degree, max(c - 1, 1))
    nbr = np.zeros((c, near + 4), dtype=np.int32)
    for lo in range(0, c, 2048):
        sims = cents[lo : lo + 2048] @ cents.T
        sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -2
        nbr[lo : lo + 2048, :near] = np.argpartition(-sims, min(near, c - 1), axis=1)[:, :near] if c > 1 else 0
    nbr[:, near:] = rng.integers(0, c, (c, 4))  # a few long links keep it connected
    entries = rng.choice(c, min(c, max(16, int(math.sqrt(c)))), replace=False)
    return nbr, entries


def graph_search(q: np.ndarray, cents: np.ndarray, nbr: np.ndarray, entries: np.ndarray, top: int, beam: int = BEAM):
    """Best-first search for a whole batch: (ids, sims), best first; -1 fills."""
    b = len(q)
    sims = q @ cents[entries].T
    ef = max(beam, top)
    keep = min(ef, len(entries))
    order = np.argsort(-sims, axis=1)[:, :keep]
    ids = np.full((b, ef), -1, dtype=np.int64)
    val = np.full((b, ef), -9.0, dtype=np.float32)
    ids[:, :keep] = entries[order]
    val[:, :keep] = np.take_along_axis(sims, order, 1)
    done = ids < 0
    rows = np.arange(b)[:, None]
    for _ in range(16):
        open_val = np.where(done, -99.0, val)
        pick = np.argsort(-open_val, axis=1)[:, :4]
        active = np.take_along_axis(open_val, pick, 1) > -50
        # a node worse than the whole beam is never picked, since the beam is full of better ones
        if not active.any():
            break
        live = np.flatnonzero(active.any(axis=1))
        pick, active = pick[live], active[live]
        done[live[:, None], pick] = True
        src = np.where(active, ids[live[:, None], pick], 0)
        cand = nbr[src].astype(np.int64)
        cand[~active] = -1
        cand = np.sort(cand.reshape(len(live), -1), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        known = (cand[:, :, None] == ids[live][:, None, :]).any(axis=2)
        s = np.einsum("bd,bnd->bn", q[live], cents[np.maximum(cand, 0)])
        s[known | (cand < 0)] = -9.0
        all_ids = np.concatenate([ids[live], cand], axis=1)
        all_val = np.concatenate([val[live], s], axis=1)
        all_done = np.concatenate([done[live], s < -5], axis=1)
        best = np.argpartition(-all_val, ef - 1, axis=1)[:, :ef]
        ids[live] = np.take_along_axis(all_ids, best, 1)
        val[live] = np.take_along_axis(all_val, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(-val, axis=1)[:, :top]
    ids, val = ids[rows, order], val[rows, order]
    ids[val < -5] = -1
    return ids, val


# ---- distributed steps ------------------------------------------------------

def _prepared(width: int):
    def run(batches):
        for pdf in batches:
            keys, vecs, kept = [], [], []
            for item, e in zip(pdf["id"], pdf["embedding"]):
                x = np.asarray(e, dtype=np.float64)
                if x.shape != (width,) or not np.isfinite(x).all():
                    continue
                norm = math.sqrt(float(x @ x))
                if norm == 0 or not math.isfinite(norm):
                    continue
                raw = x.astype(np.float32).tobytes()
                kept.append(item)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                vecs.append((x / norm).astype(np.float32).tobytes())
            yield pd.DataFrame({"id": kept, "key": keys, "vec": vecs})

    return run


def _assigned(index, width: int):
    def run(batches):
        cents, nbr, entries, salts = index.value
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                q = np.frombuffer(b"".join(part["vec"]), dtype=np.float32).reshape(-1, width)
                ids, sims = graph_search(q, cents, nbr, entries, PROBES)
                dist = np.sqrt(np.maximum(0, 2 - 2 * sims))
                ok = ids >= 0
                nearest = dist[:, :1]
                probe = ok & (dist <= nearest * PROBE_RATIO + 1e-6)
                store = ok & (dist <= nearest * REPLICA_RATIO + 1e-6)
                store[:, REPLICAS:] = False
                rows, keys, vecs = [], part["key"].to_numpy(), part["vec"].to_numpy()
                for role, mask in ((0, store), (1, probe)):
                    i, j = np.nonzero(mask)
                    for a, cluster in zip(i.tolist(), ids[i, j].tolist()):
                        n = salts[cluster]
                        if n == 1:
                            rows.append((cluster, 0, role, keys[a], vecs[a]))
                            continue
                        own = int.from_bytes(keys[a][:4], "little") % n
                        for other in range(n):
                            block = own * n + other if role == 0 else other * n + own
                            rows.append((cluster, block, role, keys[a], vecs[a]))
                yield pd.DataFrame(rows, columns=["cluster", "block", "role", "key", "vec"])

    return run


def _searched(width: int, k: int):
    def run(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        role = lists["role"].to_numpy()
        kept = lists["key"].to_numpy()
        x = np.frombuffer(b"".join(lists["vec"]), dtype=np.float32).reshape(-1, width)
        stored, asked = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        out_q, out_n, out_c = [], [], []
        if len(stored) and len(asked):
            sx, sk = x[stored], kept[stored]
            take = min(k + 3, len(stored))
            for lo in range(0, len(asked), 1024):
                at = asked[lo : lo + 1024]
                sims = x[at] @ sx.T
                top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
                exact = np.einsum("bd,bnd->bn", x[at].astype(np.float64), sx[top].astype(np.float64))
                norm = np.linalg.norm(x[at].astype(np.float64), axis=1)[:, None] * np.linalg.norm(sx[top].astype(np.float64), axis=2)
                exact = exact / norm
                for i, a in enumerate(at):
                    own = kept[a]
                    pairs = sorted((-c, sk[t]) for c, t in zip(exact[i].tolist(), top[i]) if sk[t] != own)[:k]
                    for c, n in pairs:
                        out_q.append(own)
                        out_n.append(n)
                        out_c.append(-c)
        return pd.DataFrame({"key": out_q, "near": out_n, "cosine": np.asarray(out_c, dtype=np.float64)})

    return run


def nearest_vectors(
    vectors: DataFrame, id_col: str = "item_id", vector_col: str = "embedding", k: int = 5, width: int | None = None,
    sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS,
) -> DataFrame:
    """Columns (id, near_id, cosine, rank): k rows per usable vector.

    The index is fitted on at most `sample_rows` (65,536) vectors and has at
    most 16,384 centroids, so what is broadcast stays under 6 MB at width 64;
    all vectors are indexed and all are queries.  Lists expected to exceed
    BLOCK_ROWS are salted into block pairs.

    Defined cases: null vectors, vectors with null, NaN or infinite elements,
    all-zero vectors and vectors not `width` wide (default: the commonest
    width) take no part; copies of one vector are searched once and joined
    back, ties go to the smaller id; fewer than k others give fewer rows; an
    empty table gives no rows; a repeated id counts as rows of their own
    vectors and never as its own neighbour; other columns are ignored."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("embedding"))
    src = src.filter(F.col("id").isNotNull() & F.col("embedding").isNotNull())
    src = src.filter(~F.exists("embedding", lambda v: v.isNull()))
    if width is None:
        common = src.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").head()
        width = int(common["w"]) if common else 1
    ready = src.mapInPandas(_prepared(width), "id string, key binary, vec binary")

    first = Window.partitionBy("key").orderBy("id")
    groups = cut(
        ready.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= k + 1)
        .groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("id")).alias("ids"))
    )
    total = groups.count()
    share = min(1.0, 1.2 * sample_rows / max(total, 1))
    picked = groups.sample(fraction=share, seed=11) if share < 1 else groups
    taken = [r["vec"] for r in picked.select("vec").limit(sample_rows).collect()]
    sample = np.frombuffer(b"".join(bytes(v) for v in taken), dtype=np.float32).reshape(-1, width)
    if not len(sample):
        sample = np.ones((1, width), dtype=np.float32)
    scale = max(total, 1) / len(sample)
    target = max(list_rows / scale, len(sample) / MAX_CENTROIDS * 4)
    cents, sizes = fit_centroids(sample, target)
    nbr, entries = build_graph(cents)
    salts = [max(1, math.ceil(2 * s * scale * PROBES / 2 / BLOCK_ROWS)) if s * scale > BLOCK_ROWS else 1 for s in sizes.tolist()]
    index = spark.sparkContext.broadcast((cents, nbr, entries, salts))

    spread = groups.select("key", "vec").mapInPandas(
        _assigned(index, width), "cluster int, block int, role int, key binary, vec binary"
    )
    hits = spread.groupBy("cluster", "block").applyInPandas(_searched(width, k), "key binary, near binary, cosine double")
    best = hits.groupBy("key").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("d"), F.col("near")))), 1, k).alias("best")
    )
    members = groups.select(F.col("key").alias("near"), F.col("ids").alias("near_ids"))
    spelled = (
        best.select("key", F.explode("best").alias("b")).select("key", F.col("b.d").alias("d"), F.col("b.near").alias("near"))
        .join(members, "near")
        .groupBy("key").agg(F.collect_list(F.struct("d", "near_ids")).alias("others"))
    )
    own = groups.select("key", "ids").join(spelled, "key", "left")
    near = F.flatten(F.transform("others", lambda o: F.transform(o["near_ids"], lambda i: F.struct(o["d"].alias("d"), i.alias("near_id")))))
    same = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("near_id")))
    own = own.select("key", F.when(F.col("others").isNull(), same).otherwise(F.concat(same, near)).alias("all"))
    per_id = ready.select("id", "key").join(own, "key")
    top = F.slice(F.array_sort(F.filter("all", lambda x: x["near_id"] != F.col("id"))), 1, k)
    return per_id.select("id", F.posexplode(top).alias("pos", "n")).select(
        F.col("id").alias(id_col), F.col("n.near_id").alias("near_id"), (-F.col("n.d")).alias("cosine"), (F.col("pos") + 1).alias("rank")
    )
