"""Counters, windows and folds over streams. The event-time forms are this engine's own addition."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import BUDGET_MS, tier_fold


def access_counts(stream: DataFrame, key: str = "memory_id") -> DataFrame:
    """Running counts by key (update or complete mode)."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("access_count"))


def windowed_latency(stream: DataFrame, ts: str, value: str, width: str = "1 hour", late: str = "10 minutes", key: str | None = None) -> DataFrame:
    """Approximate p50 and p90 by event-time window; late rows are dropped after the watermark."""
    groups = [F.window(ts, width), *([F.col(key)] if key else [])]
    return stream.withWatermark(ts, late).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, 0.5).alias("p50"), F.percentile_approx(value, 0.9).alias("p90"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))


def tier_hysteresis(stream: DataFrame, key: str, order: str, value: str, budget: float = BUDGET_MS) -> DataFrame:
    """(key, order, value, tier) folded per key; the state holds what the batch form's fold goes on from."""
    import pandas as pd

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, tier, calm = state.get if state.exists else ([], "full", 0)
        rows = pd.concat(list(batches)).sort_values(order)
        tiers, past, tier, calm = tier_fold(rows[value], past, tier, calm, budget)
        state.update((past, tier, calm))
        yield rows[[key, order, value]].assign(tier=tiers)

    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}, tier string"
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(fold, out, "past array<double>, tier string, calm int", "append", GroupStateTimeout.NoTimeout)


class _SharedPool(StatefulProcessor):
    """A pool's content as a map from memory to its best (score, seq); at most `cap` memories stay."""

    def __init__(self, cap: int, memory: str, seq: str):
        self.cap, self.kinds = cap, (memory, seq)

    def init(self, handle: StatefulProcessorHandle) -> None:
        memory, seq = self.kinds
        self.items = handle.getMapState("items", f"memory_id {memory}", f"score double, seq {seq}")
        self.rounds = handle.getValueState("rounds", "n long")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        now = {m[0]: tuple(v) for m, v in self.items.iterator()}
        before = dict(now)
        first = lambda v: (-v[0], v[1])
        for r in rows:
            had, new = now.get(r.memory_id), (r.score, r.seq)
            if had is None or first(new) < first(had):
                now[r.memory_id] = new
                if len(now) > self.cap:  # the last goes, so what is held never exceeds the cap
                    del now[max(now, key=lambda m: first(now[m]))]
        for m in before.keys() - now.keys():
            self.items.removeKey((m,))
        for m in now:
            if now[m] != before.get(m):
                self.items.updateValue((m,), now[m])
        n = (self.rounds.get()[0] if self.rounds.exists() else 0) + 1
        self.rounds.update((n,))
        for rank, m in enumerate(sorted(now, key=lambda m: first(now[m])), 1):
            yield Row(pool=key[0], round=n, pool_rank=rank, memory_id=m, score=now[m][0], seq=now[m][1])

    def close(self) -> None:
        pass


def shared_pool(stream: DataFrame, cap: int = 10) -> DataFrame:
    """(pool, round, pool_rank, memory_id, score, seq) from a stream of (pool, memory_id, score, seq): each pool's whole
    content after each batch that touched it; its highest round is its present content, equal to the batch form's
    over all rows so far. The state holds `cap` memories a pool; it survives restarts with the checkpoint."""
    kinds = dict(stream.dtypes)
    out = f"pool {kinds['pool']}, round long, pool_rank int, memory_id {kinds['memory_id']}, score double, seq {kinds['seq']}"
    rows = stream.select("pool", "memory_id", F.col("score").cast("double").alias("score"), "seq")
    return rows.groupBy("pool").transformWithState(_SharedPool(cap, kinds["memory_id"], kinds["seq"]), out, "update", "none")


class _Interactions(StatefulProcessor):
    """How many queries took memories along a link; a query counts once while it is remembered."""

    def __init__(self, query: str, remember_ms: int):
        self.query, self.remember_ms = query, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")
        self.seen = handle.getMapState("seen", f"query_id {self.query}", "yes boolean", ttlDurationMs=self.remember_ms)

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        n = old = self.n.get()[0] if self.n.exists() else 0
        for r in rows:
            if not self.seen.containsKey((r.query_id,)):
                self.seen.updateValue((r.query_id,), (True,))
                n += 1
        if n != old:
            self.n.update((n,))
            yield Row(src=key[0], dst=key[1], n=n)

    def close(self) -> None:
        pass


def interaction_counts(stream: DataFrame, current: str = "cur_node", remember_ms: int | None = None) -> DataFrame:
    """(src, dst, n) from a stream of kept rows (query_id, owner_node, current): the batch form's counts, a row for each
    link whose count a batch raised; a link's highest n is its count. A query is remembered for good, in state that is
    dealt by query and link, or for remember_ms milliseconds if its rows come close together, in one task a link."""
    kinds = dict(stream.dtypes)
    rows = stream.filter(F.col("owner_node") != F.col(current)).select("query_id", F.col("owner_node").alias("src"), F.col(current).alias("dst"))
    if not remember_ms:
        return rows.dropDuplicates(["query_id", "src", "dst"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = f"src {kinds['owner_node']}, dst {kinds[current]}, n long"
    return rows.groupBy("src", "dst").transformWithState(_Interactions(kinds["query_id"], remember_ms), out, "update", "processingTime")


def use_state_store(spark: SparkSession) -> None:
    """The state store that the pools and interactions need, for streams that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


__all__ = ["access_counts", "interaction_counts", "sessions", "shared_pool", "tier_hysteresis", "use_state_store", "windowed_latency"]
