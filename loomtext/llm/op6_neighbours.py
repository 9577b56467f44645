"""Approximate nearest neighbours with a permutation index.

A vector is represented by its PREFIX nearest of PIVOTS pivots, in order, and posted in the inverted file of
each: a pivot's file holds the place that the pivot has in every row's order (PREFIX where it is missing). The
footrule distance of two prefixes is a constant less twice the sum, over the query's pivots, of PREFIX minus
the later of the two places; so it is read from the files of the query's pivots alone. Rows at least as near by footrule
as the SHARE of all rows nearest to the query (known from a bounded sample of the rows) are reranked exactly.

Every row is posted once, in the unit of its nearest among the first pivots; a query is routed to the units of its
nearest of these, so many that REACHED of the true neighbours of a bounded number of probe queries lie there. The
probes' neighbours are exact, from one pass over all rows. Where rows are clustered a query meets few units; where they are
not, no index can spare it most of them. Pivots are chosen farthest-first, so that a hot cluster takes few of them.

The similarity read from the footrule is multiplied by the vector's length, so that the rank follows the inner
product where lengths differ (for unit vectors that changes nothing).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import table

PIVOTS, PREFIX = 512, 128
#: Rows that are collected, drawn by hash, to choose pivots from and to place a query's share (in all; a vector length gets its part, MOST_LENGTHS at least).
SAMPLE, MOST_LENGTHS = 2048, 32
#: Share of all rows that is reranked, but not fewer than so many times k.
SHARE, LEAST = 0.04, 16
#: Probe queries, and the share of their true neighbours that the routed units hold.
PROBES, REACHED = 128, 0.98
#: A unit has about UNIT rows, but there are LEAST_UNITS (for parallel work) and no more than PIVOTS; a larger one is split by hash. Queries of a unit go in groups of about GROUP.
UNIT, LEAST_UNITS, LEAST_ROWS, GROUP = 65536, 16, 1024, 65536
#: Queries that are ranked at a time.
BATCH = 1024


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite, some not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the sampled directions, each the farthest from those before it; equal directions are taken once."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, best = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        i = int(np.argmin(best))
        if best[i] > 1 - 1e-12:
            break
        chosen.append(i)
        best = np.maximum(best, unit @ unit[i])
    return unit[chosen]


def places(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(rows, prefix) pivot numbers, nearest first; ties to the smaller pivot number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def files(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(pivots, rows) inverted files: the place of the pivot in the order of each row, ``prefix`` where it is missing."""
    out = np.full((len(pivots), len(x)), prefix, dtype=np.int16 if prefix <= 181 else np.int32)
    own = places(x, pivots, prefix)
    out[own.T, np.arange(len(x))] = np.arange(own.shape[1])[:, None]
    return out


def likeness(file: np.ndarray, order: np.ndarray, prefix: int) -> np.ndarray:
    """What the footrule distance of a query, by its pivots in order, falls short of its greatest value, halved: per row of the files."""
    return prefix * len(order) - np.maximum(file[order], np.arange(len(order), dtype=file.dtype)[:, None]).sum(axis=0, dtype=file.dtype).astype(np.int64)


def thresholds(q: np.ndarray, sample: np.ndarray, pivots: np.ndarray, prefix: int, share: float) -> np.ndarray:
    """The likeness times length that the ``share`` of the sampled rows most like each query has."""
    file, length = files(sample, pivots, prefix), np.linalg.norm(sample, axis=1)
    at = min(len(sample), max(1, int(np.ceil(share * len(sample)))))
    return np.array([np.partition(likeness(file, o, prefix) * length, len(sample) - at)[len(sample) - at] for o in places(q, pivots, prefix)])


def search(unit: dict, qi: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` best of one unit: (query id, row ids, inner products), nearest first.

    Reranked are the rows whose likeness is ``least`` or more, or the k + 1 most alike of the unit if these are more.
    """
    x, xi, out = unit["x"], unit["ids"], []
    for i, order in enumerate(places(q, unit["pivots"], unit["prefix"])):
        near = likeness(unit["file"], order, unit["prefix"]) * unit["length"]
        cand = np.nonzero(near >= least[i])[0]
        if len(cand) <= k:
            cand = np.arange(len(x)) if len(x) <= k + 1 else np.nonzero(near >= np.partition(near, len(x) - k - 1)[len(x) - k - 1])[0]
        cand = cand[xi[cand] != qi[i]]
        score = (x[cand] * q[i]).sum(axis=1)
        best = np.lexsort((xi[cand], -score))[:k]
        out.append((int(qi[i]), xi[cand[best]], score[best]))
    return out


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors of each length."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for d in np.unique(sizes):
        at = np.nonzero(sizes == d)[0]
        yield int(d), at, flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(-1, d)


def _listed(x: np.ndarray, like: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), like.value_type))


def _drawn(rows: DataFrame, wanted: dict[int, tuple[int, int]], salt: int) -> dict[int, list]:
    """Per vector length d, ``wanted[d][0]`` of its ``wanted[d][1]`` rows (all, if fewer) in the order of a hash.

    Only rows of a low hash, about four times as many as wanted, are ranked, however many tasks read the rows.
    """
    if not wanted:
        return {}
    most, bar = (F.create_map(*[F.lit(x) for d, v in of.items() for x in (d, v)]) for of in ({d: k for d, (k, _) in wanted.items()}, {d: min(1 << 40, -(-4 * k * (1 << 40) // max(1, n))) for d, (k, n) in wanted.items()}))
    low = rows.where(F.col("d").isin(list(wanted))).withColumn("h", F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(1 << 40))).where(F.col("h") < bar[F.col("d")])
    place = F.row_number().over(W.partitionBy("d").orderBy("h", "id", "v"))
    found = low.withColumn("place", place).where(F.col("place") <= max(k for k, _ in wanted.values())).where(F.col("place") <= most[F.col("d")]).select("d", "id", "v", "place").collect()
    return {d: sorted((r for r in found if r["d"] == d), key=lambda r: r["place"]) for d in wanted}


def _plans(rows: DataFrame, pivots: int, prefix: int, sample: int, share: float, k: int, unit: int) -> dict[int, dict]:
    """Per vector length (the MOST_LENGTHS most frequent): pivots, sample, share to rerank and number of units."""
    counts = {r["d"]: (r["n"], r["a"]) for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("a")).orderBy(F.col("n").desc(), "d").limit(MOST_LENGTHS).collect()}
    total = sum(n for n, _ in counts.values())
    drawn = _drawn(rows, {d: (max(MOST_LENGTHS, -(-sample * n // total)), n) for d, (n, _) in counts.items()}, 0)
    out = {}
    for d, (n, asked) in counts.items():
        own = np.array([r["v"] for r in drawn[d]], dtype=np.float64)
        p = farthest_first(own, pivots)
        units = min(len(p), max(LEAST_UNITS, -(-n // unit)))
        out[d] = {"pivots": p, "prefix": min(prefix, len(p)), "sample": own, "share": min(1.0, max(share, LEAST * k / n)), "units": units, "rows": n, "asked": asked, "visits": units}
    return out


def _probed(rows: DataFrame, plan: dict[int, dict], k: int, probes: int, reached: float) -> None:
    """Sets ``visits`` of every plan: how many units hold the share ``reached`` of the probes' true neighbours."""
    asked = _drawn(rows.where("q"), {d: (probes, p["asked"]) for d, p in plan.items()}, 1)
    probe = {}
    for d, p in plan.items():
        own = asked[d]
        if own:
            x = np.array([r["v"] for r in own], dtype=np.float64)
            rank = np.argsort(np.argsort(-(x @ p["pivots"][: p["units"]].T), axis=1, kind="stable"), axis=1)
            probe[d] = {"ids": np.array([r["id"] for r in own]), "x": x, "rank": rank, "centres": p["pivots"][: p["units"]]}
    if not probe:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for d, at, x in by_length(batch.column(1)):
                p = probe.get(d)
                if p is None:
                    continue
                home, scores = np.argmax(x @ p["centres"].T, axis=1), p["x"] @ x.T
                for i, s in enumerate(scores):
                    s = np.where(ids[at] == p["ids"][i], -np.inf, s)
                    top = np.argpartition(-s, k)[:k] if len(s) > k else np.arange(len(s))
                    now = np.stack([s[top], p["rank"][i][home[top]]], axis=1)
                    both = np.concatenate([best[d, i], now]) if (d, i) in best else now
                    best[d, i] = both[np.argsort(-both[:, 0], kind="stable")[:k]]
        for (d, i), found in best.items():
            found = found[np.isfinite(found[:, 0])]
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(found), pa.int32()), "probe": pa.array([i] * len(found), pa.int32()), "score": pa.array(found[:, 0]), "place": pa.array(found[:, 1].astype(np.int32))})

    found = rows.select("id", "v").mapInArrow(run, "d int, probe int, score double, place int")
    top = found.withColumn("n", F.row_number().over(W.partitionBy("d", "probe").orderBy(F.col("score").desc(), "place"))).where(F.col("n") <= k)
    for r in top.groupBy("d").agg(F.sort_array(F.collect_list("place")).alias("places")).collect():
        plan[r["d"]]["visits"] = 1 + r["places"][min(len(r["places"]) - 1, int(np.ceil(reached * len(r["places"]))) - 1)]


def nearest(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, unit: int = UNIT, group: int = GROUP, reached: float = REACHED) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's ``k`` nearest rows by inner product, ties to the smaller id.

    ``queries`` is a condition on the rows of ``df``. A query's own id is no candidate. Vectors that are null, empty,
    zero or hold null or non-finite components and rows with a null id take no part. Vectors of different lengths have no
    inner product: each length is searched by itself, the MOST_LENGTHS most frequent with an index, others in full. Rows
    that repeat an id are one candidate (the nearest of them), and a query id on several rows asks with all its vectors, each
    candidate counting with its best score. With fewer candidates than ``k`` all are returned; without usable
    vectors the result is empty.
    """
    source = df.schema[vector].dataType.elementType.simpleString()
    kind = "float" if source == "float" else "double"
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).withColumn("d", F.size("v"))
    plan = _plans(rows, pivots, prefix, SAMPLE, share, k, unit)
    _probed(rows, plan, k, PROBES, reached)
    held = df.sparkSession.sparkContext.broadcast(plan)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.zeros(batch.num_rows, dtype=np.int32)
            for d, at, x in by_length(batch.column(1)):
                if d in held.value:
                    p = held.value[d]
                    home[at] = np.argmax(x @ p["pivots"][: p["units"]].T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(home)], names=["id", "v", "q", "d", "u"])

    homed = rows.mapInArrow(homes, f"id long, v array<{kind}>, q boolean, d int, u int")
    # Units with a plan are at most MOST_LENGTHS * PIVOTS; lengths beyond have one unit each and are counted by a join.
    sized = {(r["d"], r["u"]): (r["n"], r["a"]) for r in homed.where(F.col("d").isin(list(plan))).groupBy("d", "u").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("a")).collect()}
    shape: dict[int, dict] = {}
    for d, p in plan.items():
        n = np.array([sized.get((d, u), (0, 0))[0] for u in range(p["units"])])
        most = max(LEAST_ROWS, min(unit, -(-p["rows"] // LEAST_UNITS)))
        asked = sum(sized.get((d, u), (0, 0))[1] for u in range(p["units"]))
        shape[d] = {"n": n, "splits": np.maximum(1, -(-n // most)), "groups": max(1, -(-asked * p["visits"] // (p["units"] * group)))}
    shapes = df.sparkSession.sparkContext.broadcast(shape)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row in its unit once (per group of queries), every query in each split of the units it is routed to."""
        for batch in batches:
            ids, asks, home = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            for d, at, x in by_length(batch.column(1)):
                like = batch.schema.field(1).type
                spread = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                p, s = held.value.get(d), shapes.value.get(d)
                splits, groups = (s["splits"], s["groups"]) if p else (np.ones(1, dtype=np.int64), 1)
                own = (spread % splits[home[at]].astype(np.uint64)).astype(np.int64)
                out = [(i, int(home[j]), int(own[i]), g, False, 0.0) for i, j in enumerate(at) for g in range(groups)]
                mine = np.nonzero(asks[at])[0]
                if len(mine) and p:
                    least = thresholds(x[mine], p["sample"], p["pivots"], p["prefix"], p["share"])
                    order = np.argsort(-(x[mine] @ p["pivots"][: p["units"]].T), axis=1, kind="stable")
                    # The nearest units, and further ones until they hold enough rows to choose from.
                    enough = np.maximum(p["visits"], (np.cumsum(s["n"][order], axis=1) < LEAST * k + 1).sum(axis=1) + 1)
                    out += [(int(i), int(u), c, int(spread[i] % groups), True, least[m]) for m, i in enumerate(mine) for u in order[m][: enough[m]] if s["n"][u] for c in range(splits[u])]
                else:
                    out += [(int(i), 0, 0, 0, True, 0.0) for i in mine]
                for begin in range(0, len(out), 8192):
                    row, u, c, g, ask, low = zip(*out[begin : begin + 8192], strict=True)
                    index = np.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d] * len(row), pa.int32()), pa.array(u, pa.int32()), pa.array(c, pa.int32()), pa.array(g, pa.int32()), pa.array(ask, pa.bool_()), pa.array(ids[at[index]]), pa.array(low, pa.float64()), _listed(x[index], like)],
                        names=["d", "u", "c", "g", "asks", "id", "least", "v"],
                    )

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a unit come before its queries; the index stays, the queries stream by."""
        now, unit_rows, index = None, [], {}
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            asks, ids, least = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(), batch.column(6).to_numpy()
            cut = np.nonzero((keys[1:] != keys[:-1]).any(axis=1) | (asks[1:] != asks[:-1]))[0] + 1
            for a, b in zip([0, *cut], [*cut, len(ids)], strict=True):
                if a == b:
                    continue
                at = tuple(keys[a])
                if at != now:
                    now, unit_rows, index = at, [], {}
                d = int(at[0])
                x = batch.column(7).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                if not asks[a]:
                    unit_rows.append((ids[a:b], x))
                    continue
                if not index and unit_rows:
                    rows_ = np.concatenate([r for _, r in unit_rows])
                    p = held.value.get(d) or {"pivots": rows_[:1] / np.linalg.norm(rows_[:1]), "prefix": 1}
                    index = {"ids": np.concatenate([i for i, _ in unit_rows]), "x": rows_, "pivots": p["pivots"], "prefix": p["prefix"], "file": files(rows_, p["pivots"], p["prefix"]), "length": np.linalg.norm(rows_, axis=1)}
                    unit_rows = []
                for i in range(0, (b - a) if index else 0, BATCH):
                    found = search(index, ids[a + i : min(b, a + i + BATCH)], x[i : i + BATCH], least[a + i : min(b, a + i + BATCH)], k)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query_id": np.repeat(np.array([f[0] for f in found], dtype=np.int64), [len(f[1]) for f in found]),
                            "vec_id": np.concatenate([f[1] for f in found]).astype(np.int64),
                            "score": np.concatenate([f[2] for f in found]).astype(np.float64),
                        }
                    )

    units = homed.mapInArrow(posted, f"d int, u int, c int, g int, asks boolean, id long, least double, v array<{kind}>")
    found = units.repartition("d", "u", "c", "g").sortWithinPartitions("d", "u", "c", "g", "asks").mapInArrow(ranked, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op6_neighbours": op6_neighbours}
ORACLE: dict[str, str] = {}
