"""The online loop on Structured Streaming: stateless decisions, stateful memory, and triggers over batch logs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernmill.operators import metrics as M
from quernmill.operators import safety as S


def decide(samples: DataFrame, threshold: float = 0.5, force: bool = False) -> DataFrame:
    """Adds the safety verdict of ``text`` and a decision by ``uncertainty``; unsafe rows are rejected."""
    judged = S.regulate(samples.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))) if "entities" in samples.columns else samples.withColumn("entities", F.array().cast("array<string>")))
    return judged.withColumn("decision", F.when(~F.col("verdict.is_safe"), "reject_unsafe").otherwise(M.decision(F.col("uncertainty"), threshold, force)))


def counts(decided: DataFrame) -> DataFrame:
    """Rows by decision."""
    return decided.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


class Memory:
    """The sequential strategies of a replay memory, in arrival order.

    Entries are (event_id, uncertainty, concept, vector).  A draw is a hash of the count seen, so that a run can be repeated.
    """

    def __init__(self, most: int, strategy: str = "reservoir", weight: float = 0.5, entries: list[tuple] | None = None, seen: int = 0):
        self.most, self.strategy, self.weight, self.entries, self.seen = most, strategy, weight, list(entries or []), seen

    def _draw(self, n: int) -> int:
        x = (self.seen * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        return ((x ^ (x >> 27)) >> 11) % n

    @staticmethod
    def _distance(a, b) -> float:
        num = sum(x * y for x, y in zip(a, b, strict=True))
        den = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
        return 1 - num / max(den, 1e-12)

    def _reservoir(self, entry: tuple) -> bool:
        k = self._draw(self.seen)
        if k < self.most:
            self.entries[k] = entry
        return k < self.most

    def add(self, event_id: int, uncertainty: float, concept: str = "", vector: list[float] | None = None) -> bool:
        """Whether the entry is kept.  Until the memory is full all are."""
        entry = (event_id, uncertainty, concept, vector)
        self.seen += 1
        if len(self.entries) < self.most:
            self.entries.append(entry)
            return True
        if self.strategy == "uncertainty":
            k = min(range(self.most), key=lambda i: self.entries[i][1])
            if uncertainty > self.entries[k][1]:
                del self.entries[k]
                self.entries.append(entry)
                return True
            return False
        if self.strategy == "balanced":
            by: dict[str, int] = {}
            for e in self.entries:
                by[e[2]] = by.get(e[2], 0) + 1
            top = max(by, key=lambda c: by[c])
            if by[top] > self.most // max(1, len(by)):
                del self.entries[next(i for i, e in enumerate(self.entries) if e[2] == top)]
                self.entries.append(entry)
                return True
            return self._reservoir(entry)
        if self.strategy in ("diversity", "hybrid") and vector is not None and all(e[3] is not None for e in self.entries):
            near = [self._distance(vector, e[3]) for e in self.entries]
            k = min(range(self.most), key=lambda i: near[i])
            if self.strategy == "diversity":
                some = [e[3] for e in self.entries[:50]]
                gaps = [self._distance(a, b) for i, a in enumerate(some) for b in some[:i]]
                limit = float(np.percentile(gaps, 25)) if gaps else 0.0
                if near[k] > limit:
                    self.entries[k] = entry
                return near[k] > limit
            score = [(1 - self.weight) * e[1] + self.weight * near[i] for i, e in enumerate(self.entries)]
            k = min(range(self.most), key=lambda i: score[i])
            if uncertainty > score[k]:
                self.entries[k] = entry
            return uncertainty > score[k]
        return self._reservoir(entry)


    def add_all(self, ids: np.ndarray, uncertainty: np.ndarray, concepts: np.ndarray, vectors: list) -> list[bool]:
        """What ``add`` gives for each of some entries in their order, ``hybrid`` by blocks as long as all have finite vectors of one length."""
        kept: list[bool] = []
        at = 0
        while at < len(ids):
            end = min(len(ids), at + BLOCK)
            held = [e[3] for e in self.entries] + list(vectors[at:end])
            whole = self.strategy == "hybrid" and 0 < len(self.entries) == self.most and all(v is not None and len(v) == len(held[0]) for v in held)
            matrix = np.array(held, float) if whole else None
            sure = np.array([e[1] for e in self.entries] + list(uncertainty[at:end]), float)
            if matrix is not None and np.isfinite(matrix).all() and np.isfinite(sure).all():
                kept += self._hybrid(ids[at:end], sure, concepts[at:end], matrix)
            else:
                end = at + 1 if len(self.entries) < self.most else end
                kept += [self.add(int(ids[i]), float(uncertainty[i]), str(concepts[i]), None if vectors[i] is None else [float(x) for x in vectors[i]]) for i in range(at, end)]
            at = end
        return kept

    def _hybrid(self, ids: np.ndarray, sure: np.ndarray, concepts: np.ndarray, matrix: np.ndarray) -> list[bool]:
        """A block of arrivals for a full memory, given the uncertainties and vectors of its entries and then of theirs.

        The distances of all arrivals from the entries and from one another are taken at once; what is
        left to do in order is to see which of them hold a place.
        """
        n, some = self.most, matrix[self.most :]
        square = _sums(matrix.T * matrix.T)
        near = 1 - _sums(some.T[:, :, None] * matrix.T[:, None, :]) / np.maximum(np.sqrt(square[n:, None] * square), 1e-12)
        near *= self.weight
        part = (1 - self.weight) * sure
        place, share, kept = np.arange(n), part[:n].copy(), []
        for j in range(len(some)):
            score = share + near[j].take(place)
            k = int(score.argmin())
            kept.append(bool(sure[n + j] > score[k]))
            if kept[-1]:
                place[k], share[k] = n + j, part[n + j]
        for k in np.flatnonzero(place >= n):
            j = place[k] - n
            self.entries[k] = (int(ids[j]), float(sure[n + j]), str(concepts[j]), some[j].tolist())
        self.seen += len(some)
        return kept


#: Arrivals whose distances are taken at once, and rows that are given at a time.
BLOCK, GIVEN = 128, 1 << 16


def _sums(parts: np.ndarray) -> np.ndarray:
    """Sums over the first axis with the error of each step made up for, as Python's ``sum`` does for floats."""
    total, lost = np.zeros(parts.shape[1:]), np.zeros(parts.shape[1:])
    for x in parts:
        t = total + x
        lost += np.where(np.abs(total) >= np.abs(x), (total - t) + x, (x - t) + total)
        total = t
    return total + lost


STATE = "entries array<struct<event_id:bigint,uncertainty:double,concept:string,vector:array<double>>>, seen bigint"
KEPT = "buffer string, event_id bigint, kept boolean, size int"


def _packed(vectors: pd.Series) -> np.ndarray | list:
    """Vectors as one matrix, or as they are if some are null or of another length."""
    one = {None if v is None else len(v) for v in vectors}
    return np.array(vectors.tolist(), float) if len(one) == 1 and one != {None} else vectors.tolist()


def remember(events: DataFrame, most: int, strategy: str = "uncertainty") -> DataFrame:
    """Keeps a memory for each ``buffer`` of a stream of (buffer, event_id, uncertainty, concept, vector); one row for each arrival.

    Buffers are independent and spread over the cluster; within one, arrivals are taken by event_id in each
    micro-batch.  Vectors are kept in the state; an arrival without one, or where an entry has none, is
    drawn as for a reservoir.
    """
    if "vector" not in events.columns:
        events = events.withColumn("vector", F.lit(None).cast("array<double>"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = state.get if state.exists else ([], 0)
        memory = Memory(most, strategy, entries=[(e[0], e[1], e[2], None if e[3] is None else list(e[3])) for e in held], seen=seen)
        kept: list[np.ndarray] = []
        ids, sure, codes, vectors, names = [], [], [], [], {}
        for frame in frames:
            ids.append(frame["event_id"].to_numpy())
            sure.append(frame["uncertainty"].to_numpy(float))
            codes.append(np.array([names.setdefault(c, len(names)) for c in frame["concept"]], np.int32))
            vectors.append(_packed(frame["vector"]))
        # one column after the other, so that few are there twice
        ids, sure, codes = np.concatenate(ids), np.concatenate(sure), np.concatenate(codes)
        flat = all(isinstance(v, np.ndarray) for v in vectors) and len({v.shape[1] for v in vectors}) == 1
        vectors = np.concatenate(vectors) if flat else [x for v in vectors for x in v]
        words, order = np.array(list(names), object), np.argsort(ids, kind="stable")
        for at in range(0, len(order), GIVEN):
            part = order[at : at + GIVEN]
            some = vectors[part] if flat else [vectors[i] for i in part]
            kept.append(np.array(memory.add_all(ids[part], sure[part], words[codes[part]], some), bool))
        state.update((memory.entries, memory.seen))
        for at, some in zip(range(0, len(order), GIVEN), kept, strict=True):
            yield pd.DataFrame({"buffer": key[0], "event_id": ids[order[at : at + GIVEN]], "kept": some, "size": len(memory.entries)})

    return events.groupBy("buffer").applyInPandasWithState(step, KEPT, STATE, "append", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True):
    """Starts the loop: each micro-batch of decided rows goes to a callback."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def consolidations(log: DataFrame, every: int, least: int, order: str = "batch", learned: str = "learned") -> DataFrame:
    """Of a log of batches those after which weights are consolidated: every ``every``-th that learned, once ``least`` rows were."""
    from pyspark.sql import Window

    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.where(F.col(learned) > 0).withColumn("events", F.count(F.lit(1)).over(so_far)).withColumn("samples", F.sum(learned).over(so_far))
    return rows.where((F.col("events") % every == 0) & (F.col("samples") >= least))


def evaluations(log: DataFrame, every: int, order: str = "batch", count: str = "n") -> DataFrame:
    """Of a log of batches those after which at least ``every`` rows have come since the last evaluation: a sum that starts again.

    The log has a row for each micro-batch, so that it is folded as one list.
    """
    rows = log.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(count).cast("long").alias("n")))).alias("l"))
    zero = F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("long").alias("sum"))

    def step(s, x):
        total = s["sum"] + x["n"]
        hit = total >= every
        return F.struct(F.when(hit, F.concat(s["at"], F.array(x["o"].cast("long")))).otherwise(s["at"]).alias("at"), F.when(hit, F.lit(0).cast("long")).otherwise(total).alias("sum"))

    return rows.select(F.explode(F.aggregate("l", zero, step, lambda s: s["at"])).alias(order))
