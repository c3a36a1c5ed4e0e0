"""Problem 8: a mixture of sources whose token shares meet their targets, by the cube method.

The largest total at which every source with documents can give its share without using a document more than
``max_repeats`` times fixes a rate per source (copies per document). The whole part of the rate is taken for every document;
the rest is an inclusion probability. Which documents get one copy more is drawn by balanced sampling: the cube method moves
the probabilities through the null space of the constraints (number of documents, number of tokens) until each is 0 or 1,
but for at most two per chunk. Chunks run apart; their remainders are gathered into chunks again until one remains per
source, whose last two are landed by trying all outcomes and taking the nearest. As lengths are heavy-tailed, that may still
miss by a long document, so exchanges between drawn and other documents of one whole chunk of the source follow until no
exchange comes nearer to the goal. The draw depends on ``seed`` and ``doc_id`` only.

Defined cases: sources without a target give nothing; NULL and empty texts have size zero and are not used; a target whose
source has no tokens cannot be met, is reported with share 0, and the other targets are scaled up; shares are scaled to sum
to one; NULL ``source`` is no source; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import materialize
from .encode import sizes

#: Documents of a source that one task balances.
CHUNK = 20_000
#: Moves up to which pairs of them are tried, too.
FEW = 40_000
#: Targets are a table of settings.
MAX_TARGETS = 10_000


def canonical_source(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s\-./_]+", "_")


@dataclass(frozen=True)
class Rate:
    source: str
    target: float
    copies: int
    rest: float
    documents: int


def _uniform(seed: int, *key: object) -> np.random.Generator:
    digest = hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "big"))


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase for the constraints (number, sum of ``x``): all but at most two of ``p`` end at 0 or 1."""
    p = p.astype(float).copy()
    unit = float(np.abs(x).mean()) or 1.0
    y = x / unit
    pool: list[int] = []
    draws = rng.random(len(p) * 2 + 8)
    d = 0
    for i in range(len(p)):
        if not 1e-9 < p[i] < 1 - 1e-9:
            p[i] = round(p[i])
            continue
        pool.append(i)
        while len(pool) == 3:
            a, b, c = pool
            u = (y[b] - y[c], y[c] - y[a], y[a] - y[b])  # sums to zero, and so does its product with y
            if max(map(abs, u)) < 1e-12:
                u = (1.0, -1.0, 0.0)  # equal sizes: any exchange keeps both totals
            up = down = np.inf
            for k, v in zip(pool, u):
                if v > 1e-15:
                    up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
                elif v < -1e-15:
                    up, down = min(up, -p[k] / v), min(down, -(1 - p[k]) / v)
            step = up if draws[d % len(draws)] * (up + down) < down else -down
            d += 1
            left = []
            for k, v in zip(pool, u):
                p[k] += step * v
                if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                    p[k] = round(p[k])
                else:
                    left.append(k)
            pool = left
    return p


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Round the few open probabilities to the outcome nearest in tokens, then in number."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    best = None
    for bits in range(1 << len(open_)):
        take = [(bits >> k) & 1 for k in range(len(open_))]
        off = (abs(sum((t - p[i]) * x[i] for t, i in zip(take, open_))), abs(sum(t - p[i] for t, i in zip(take, open_))))
        if best is None or off < best[0]:
            best = (off, take)
    for t, i in zip(best[1], open_):
        p[i] = t
    return p


def exchange(p: np.ndarray, x: np.ndarray, goal: float) -> np.ndarray:
    """Add, drop or swap one document at a time (two where there are few) while that brings the drawn tokens nearer to ``goal``."""
    p = p.copy()
    while abs(r := goal - float((p * x).sum())) > 0.5:
        free = np.flatnonzero(p == 0)
        free = np.concatenate([[-1], free[np.argsort(x[free], kind="stable")]])
        drawn = np.concatenate([[-1], np.flatnonzero(p == 1)])
        gain, loss = np.where(free < 0, 0.0, x[free]), np.where(drawn < 0, 0.0, x[drawn])
        at = np.clip(np.stack([np.searchsorted(gain, r + loss) - k for k in (0, 1)]), 0, len(gain) - 1)
        off = np.abs(gain[at] - loss - r)
        k = np.unravel_index(off.argmin(), off.shape)
        best, moves = off[k], [(free[at[k]], drawn[k[1]])]
        if best > 0.5 and len(free) * len(drawn) <= FEW:
            best, moves = min((best, moves), _two_moves(free, drawn, gain, loss, r), key=lambda m: m[0])
        if best >= abs(r) - 1e-9:
            return p
        for add, drop in moves:
            if add >= 0:
                p[add] = 1
            if drop >= 0:
                p[drop] = 0
    return p


def _two_moves(free: np.ndarray, drawn: np.ndarray, gain: np.ndarray, loss: np.ndarray, r: float) -> tuple[float, list[tuple[int, int]]]:
    """The best pair of moves that touch different documents, among each move's nearest partners."""
    d = (gain[:, None] - loss[None, :]).ravel()
    order = np.argsort(d, kind="stable")
    at = np.searchsorted(d[order], r - d)
    best: tuple[float, list[tuple[int, int]]] = (np.inf, [])
    for k in (-2, -1, 0, 1):
        other = order[np.clip(at + k, 0, len(d) - 1)]
        i, j = np.divmod(np.arange(len(d)), len(drawn))
        i2, j2 = np.divmod(other, len(drawn))
        apart = ((free[i] != free[i2]) | (free[i] < 0)) & ((drawn[j] != drawn[j2]) | (drawn[j] < 0))
        off = np.where(apart, np.abs(d + d[other] - r), np.inf)
        m = int(off.argmin())
        if off[m] < best[0]:
            best = (float(off[m]), [(free[i[m]], drawn[j[m]]), (free[i2[m]], drawn[j2[m]])])
    return best


def _balance(docs: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "tokens"], kind="stable").reset_index(drop=True)
        x = rows["tokens"].to_numpy(float)
        p = flight(rows["p"].to_numpy(float), x, _uniform(seed, level, *key))
        rows["p"] = exchange(land(p, x), x, float((p * x).sum())) if last else p
        return rows

    return docs.groupBy("source", "chunk").applyInPandas(run, docs.schema)


def wanted(targets: DataFrame) -> list[Row]:
    """``source, share, repeats`` of every valid target on the driver; more than ``MAX_TARGETS`` are refused."""
    rows = targets.select(canonical_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").alias("repeats"))
    rows = rows.where("source is not null and share > 0 and not isnan(share) and repeats > 0").groupBy("source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats"))
    rows = rows.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return sorted(rows, key=lambda r: r.source)


def rates(sized: DataFrame, rows: list[Row]) -> list[Rate]:
    """What each target's source gives; ``sized`` holds documents of these sources only."""
    have = {r.source: r for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    found = [r for r in rows if r.source in have]
    whole = sum(r.share for r in found)
    total = min((r.repeats * have[r.source].tokens * whole / r.share for r in found), default=0.0)
    out = []
    for r in found:
        rate = min(float(r.repeats), total * r.share / whole / have[r.source].tokens)
        copies = int(rate + 1e-9)
        out.append(Rate(r.source, r.share, copies, max(0.0, rate - copies), have[r.source].n))
    return out + [Rate(r.source, r.share, 0, 0.0, 0) for r in rows if r.source not in have]


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, chunk: int = CHUNK) -> tuple[DataFrame, list[Rate]]:
    """``doc_id, source, tokens, copies`` of every document used, and the rates."""
    spark = documents.sparkSession
    rows = wanted(targets)
    names = spark.createDataFrame([(r.source,) for r in rows], "source string")
    known = documents.withColumn("source", canonical_source(F.col("source"))).where("source is not null and length(text) > 0")
    known = known.join(F.broadcast(names), "source", "left_semi")
    sized = materialize(sizes(known, ["doc_id", "source"]), "sizes").where("tokens > 0")
    plan = rates(sized, rows)
    lookup = spark.createDataFrame([(r.source, r.copies, r.rest, max(1, -(-r.documents // chunk))) for r in plan], "source string, copies int, p double, chunks int")
    docs = sized.join(F.broadcast(lookup), "source")
    order = F.xxhash64(F.lit(seed), "doc_id", "tokens")
    docs = docs.select("doc_id", "source", "tokens", "copies", "p", order.alias("order"), F.pmod(order, "chunks").cast("int").alias("chunk"))
    whole = docs.where("p <= 1e-9 or p >= 1 - 1e-9")
    open_ = docs.where("p > 1e-9 and p < 1 - 1e-9")
    done, level = [whole], 0
    closed = "(p <= 1e-9 or p >= 1 - 1e-9)"
    most = max((-(-r.documents // chunk) for r in plan), default=1)
    while most > 1:
        flown = materialize(_balance(open_, seed, level, False), "flight")
        # the documents of one chunk come along to the end, for exchanges
        along = "chunk = 0" if level == 0 else "chunk < 0"
        done.append(flown.where(f"{closed} and not ({along})"))
        most = -(-2 * most // chunk)
        level += 1
        again = F.when(F.expr(closed), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.lit(seed + level), "order"), F.lit(most)))
        open_ = flown.where(f"not {closed} or {along}").withColumn("chunk", again.cast("int"))
    done.append(_balance(open_.withColumn("chunk", F.lit(0)), seed, level, True))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    used = every.select("doc_id", "source", "tokens", (F.col("copies") + F.round("p").cast("int")).alias("copies")).where("copies > 0")
    return used, plan


def shares(documents: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Per target: ``source, target_share, reached_share, tokens, documents, copies, most_used``; ``documents`` are different ones, ``copies`` all uses."""
    used, plan = mix(documents, targets, seed)
    spark = documents.sparkSession
    goals = spark.createDataFrame([(r.source, r.target) for r in plan], "source string, target_share double")
    counts = [F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_used")]
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), *counts)
    every = goals.join(got, "source", "left").fillna(0, ["tokens", "documents", "copies", "most_used"])
    total = got.agg(F.sum("tokens").alias("all"))
    share = F.coalesce(F.col("tokens") / total.scalar(), F.lit(0.0))
    return every.select("source", "target_share", share.alias("reached_share"), "tokens", "documents", "copies", "most_used")


def met(documents: DataFrame, targets: DataFrame, seed: int = 7, within: float = 0.005) -> DataFrame:
    """Per target: ``source``, ``goal`` (its share among the targets whose source has documents), whether it is ``met`` within a
    relative error, and whether no document is used too often (``kept``)."""
    s = materialize(shares(documents, targets, seed), "shares")
    repeats = documents.sparkSession.createDataFrame([(r.source, r.repeats) for r in wanted(targets)], "source string, repeats int")
    whole = s.where("tokens > 0").agg(F.sum("target_share")).scalar()
    goal = F.when(F.col("tokens") > 0, F.col("target_share") / whole)
    near = F.coalesce(F.abs(F.col("reached_share") / goal - 1) <= within, F.lit(False))
    return s.join(F.broadcast(repeats), "source").select("source", F.round(goal, 6).alias("goal"), near.alias("met"), (F.col("most_used") <= F.col("repeats")).alias("kept"))
