"""The token store as a stateful stream: expiry, use order and eviction.

Each database is a key with a map of its tokens and a list of the calls that
wait. Calls wait until the watermark has passed them and are then taken in the
order of their own time, so what comes out doesn't depend on how the stream was
cut into micro-batches. They wait in packs of Arrow bytes, each of one hour's
calls, and are taken hour by hour, so a worker holds the calls of an hour and not
all. State lives in the shared checkpoint folder, so a lost executor's databases
go on elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

CALL = pa.schema([("at", pa.int64()), ("seq", pa.int64()), *[(c, pa.string()) for c in ("batch", "kind", "token", "value")]])
ENTRY = "value string, batches string, created long, used long, turn long, expires long"
OUT = "database string, at long, seq long, batch string, kind string, token string, value string, status string"
#: Between batch ids of an entry.
_SEP = "\x1f"
#: Milliseconds whose calls wait together and are taken at once.
SLOT_MS = 3_600_000
#: Calls that are packed at once, and rows of a frame that goes out.
PACK_ROWS, FRAME_ROWS = 200_000, 50_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lowest:
    """Tokens by a rank of their entries, lowest first. A rank that has grown
    is put right when its token comes first, so growing costs nothing."""

    def __init__(self, entries: dict[str, list], rank: Callable[[list], object]) -> None:
        self.entries, self.rank = entries, rank
        self._build()

    def _build(self) -> None:
        self.heap = [(self.rank(e), t) for t, e in self.entries.items()]
        heapify(self.heap)

    def add(self, token: str) -> None:
        """A token that is new, or whose rank has become lower."""
        heappush(self.heap, (self.rank(self.entries[token]), token))
        if len(self.heap) > 2 * len(self.entries) + 64:
            self._build()

    def first(self) -> tuple[object, str] | None:
        while self.heap:
            was, token = self.heap[0]
            if token not in self.entries:
                heappop(self.heap)
            elif (now := self.rank(self.entries[token])) != was:
                heapreplace(self.heap, (now, token))
            else:
                return self.heap[0]
        return None


class Tokens:
    """One database's tokens in memory while calls are taken.

    publish: a batch's tokens at one time. A token that is there and hasn't
    expired is reused: it gets the batch too, the later expiry, and counts as
    used; an expired one is replaced; a new one takes a place, for which the
    least recently used of other batches go (ties by token). A batch with more
    new tokens than the store holds is refused as a whole. resolve: a token's
    value, or none where it isn't there or has expired; reading counts as use.
    """

    def __init__(self, entries: dict[str, list], limit: int, ttl_ms: int) -> None:
        self.entries, self.limit, self.ttl = entries, limit, ttl_ms
        self.changed: set[str] = set()
        #: Batches that entries got, in order, and texts of earlier ones; put into them by settle().
        self.batches: dict[str, list[str]] = {}
        self.folded: dict[str, list[str]] = {}
        self.expiring = Lowest(entries, lambda e: e[5])
        self.unused = Lowest(entries, lambda e: (e[3], e[4]))

    def _drop(self, token: str) -> list:
        self.batches.pop(token, None)
        self.folded.pop(token, None)
        self.changed.add(token)
        return self.entries.pop(token)

    def _use(self, token: str, at: int, seq: int) -> None:
        e = self.entries[token]
        earlier = (at, seq) < (e[3], e[4])
        e[3], e[4] = at, seq
        if earlier:
            self.unused.add(token)
        self.changed.add(token)

    def publish(self, at: int, batch: str, rows: list[tuple[int, str, str]]) -> list[tuple[int, str, str | None, str]]:
        out: list[tuple[int, str, str | None, str]] = []
        own = {t for _, t, _ in rows}
        new = {t for t in own if t not in self.entries or self.entries[t][5] <= at}
        if len(new) > self.limit:
            return [(seq, t, None, "refused") for seq, t, _ in rows]
        expired = set()
        while (x := self.expiring.first()) is not None and x[0] <= at:
            expired.add(x[1])
            self._drop(x[1])
        over = len(self.entries) + len(new) - self.limit
        spared = []
        while over > 0 and (x := self.unused.first()) is not None:
            heappop(self.unused.heap)
            if x[1] in own:
                spared.append(x)
            else:
                out.append((rows[0][0], x[1], self._drop(x[1])[0], "evicted"))
                over -= 1
        for x in spared:
            heappush(self.unused.heap, x)
        for seq, t, value in rows:
            e = self.entries.get(t)
            if e is None:
                self.entries[t] = [value, batch, at, at, seq, at + self.ttl]
                self.expiring.add(t)
                self.unused.add(t)
                self.changed.add(t)
                out.append((seq, t, value, "replaced" if t in expired else "new"))
            else:
                self.batches.setdefault(t, []).append(batch)
                e[5] = max(e[5], at + self.ttl)
                self._use(t, at, seq)
                out.append((seq, t, e[0], "reused"))
        return out

    def resolve(self, at: int, seq: int, token: str) -> tuple[int, str, str | None, str]:
        e = self.entries.get(token)
        if e is None or e[5] <= at:
            return seq, token, None, "unknown"
        self._use(token, at, seq)
        return seq, token, e[0], "resolved"

    def taken(self, calls: list[tuple]) -> list[tuple]:
        """Rows (at, seq, batch, kind, token, value, status) of calls in their
        order; publishing calls of one batch and time that follow each other
        are one. Entries have their batches after settle()."""
        calls, out, i = sorted(calls), [], 0
        while i < len(calls):
            at, seq, batch, kind, token, _ = calls[i]
            j = i + 1
            if kind == "publish":
                while j < len(calls) and (calls[j][0], *calls[j][2:4]) == (at, batch, kind):
                    j += 1
                found = self.publish(at, batch, [(c[1], c[4], c[5]) for c in calls[i:j]])
            else:
                found = [self.resolve(at, seq, token)]
            out += [(at, s, batch, kind, t, v, status) for s, t, v, status in found]
            i = j
        for t, own in self.batches.items():
            self.folded.setdefault(t, []).append(_SEP.join(dict.fromkeys(own)))
        self.batches.clear()
        return out

    def settle(self) -> None:
        for t, texts in self.folded.items():
            e = self.entries[t]
            e[1] = _SEP.join(dict.fromkeys([*e[1].split(_SEP), *_SEP.join(texts).split(_SEP)]))
        self.folded.clear()

    def take(self, calls: list[tuple]) -> list[tuple]:
        """taken() and settle()."""
        out = self.taken(calls)
        self.settle()
        return out


def packed(calls: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, calls.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as to:
        to.write_table(calls)
    return out.getvalue().to_pybytes()


def unpacked(packs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs])


class TokenProcessor(StatefulProcessor):
    def __init__(self, limit: int, ttl_ms: int) -> None:
        self.limit, self.ttl = limit, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, n long", "calls binary")
        self.packs = handle.getValueState("packs", "n long")
        self.store = handle.getMapState("store", "token string", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        first, held = None, []
        for frame in rows:
            held.append(pa.Table.from_pandas(frame[["at_ms", *CALL.names[1:]]].set_axis(CALL.names, axis=1), CALL, preserve_index=False))
            least = int(frame["at_ms"].min())
            first = least if first is None else min(first, least)
            if sum(t.num_rows for t in held) >= PACK_ROWS:
                self._wait(pa.concat_tables(held))
                held = []
        if held:
            self._wait(pa.concat_tables(held))
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def _wait(self, calls: pa.Table) -> None:
        slots = calls["at"].to_numpy() // SLOT_MS
        order = np.argsort(slots, kind="stable")
        calls, slots = calls.take(order), slots[order]
        n = self.packs.get()[0] if self.packs.exists() else 0
        for own in np.split(np.arange(len(slots)), np.flatnonzero(np.diff(slots)) + 1):
            self.waiting.updateValue((int(slots[own[0]]), n), (packed(calls.slice(own[0], len(own))),))
            n += 1
        self.packs.update((n,))

    def _due(self, until: int) -> Iterator[list[tuple]]:
        """Calls up to ``until``, slot by slot; later ones wait on."""
        keys = sorted(tuple(k) for k in self.waiting.keys())
        then = [slot * SLOT_MS for slot, _ in keys if slot * SLOT_MS > until][:1]
        for slot, same in groupby([k for k in keys if k[0] * SLOT_MS <= until], key=lambda k: k[0]):
            same = list(same)
            calls = unpacked([self.waiting.getValue(k)[0] for k in same])
            late = pc.greater(calls["at"], until)
            rest, calls = calls.filter(late), calls.filter(pc.invert(late))
            if calls.num_rows:
                for k in same:
                    self.waiting.removeKey(k)
                if rest.num_rows:
                    self.waiting.updateValue(same[0], (packed(rest),))
            if rest.num_rows:
                then.append(pc.min(rest["at"]).as_py())
            yield list(zip(*[c.to_numpy().tolist() for c in calls.columns], strict=True))
        if then:
            self.handle.registerTimer(min(then))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        own, found = None, []
        for calls in self._due(timerValues.getCurrentWatermarkInMs()):
            if calls and own is None:
                own = Tokens({k[0]: list(v) for k, v in self.store.iterator()}, self.limit, self.ttl)
            if calls:
                found += own.taken(calls)
            if len(found) >= FRAME_ROWS:
                yield _frame(key, found)
                found = []
        if own is None:
            return
        own.settle()
        for token in own.changed:
            if token in own.entries:
                self.store.updateValue((token,), tuple(own.entries[token]))
            elif self.store.containsKey((token,)):
                self.store.removeKey((token,))
        if found:
            yield _frame(key, found)

    def close(self) -> None:
        pass


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *r) for r in rows], columns=[x.split()[0] for x in OUT.split(", ")])


def keyed_by_rocks(spark: SparkSession) -> None:
    """transformWithState keeps several kinds of state a key, which needs this
    provider; it is read when a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def token_calls(calls: DataFrame, limit: int, ttl_s: int, late: str = "1 hour") -> DataFrame:
    """What a stream of calls (database, at, seq, batch, kind, token, value)
    does to the token stores: a row (database, at, seq, batch, kind, token,
    value, status; at in milliseconds) for each call and each evicted token.

    kind: publish or resolve. A database holds ``limit`` tokens, each for
    ``ttl_s`` seconds after it was last published (see Tokens). Calls later
    than ``late`` are dropped; the last ``late`` of a stream waits for more.
    """
    keyed_by_rocks(calls.sparkSession)
    own = calls.withWatermark("at", late).selectExpr("database", "at", "unix_millis(at) at_ms", "seq", "batch", "kind", "token", "value")
    return own.groupBy("database").transformWithStateInPandas(TokenProcessor(limit, ttl_s * 1000), OUT, "Append", "EventTime")
