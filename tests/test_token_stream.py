"""The token store as a stream against a plain model, however it is cut."""

import random
from collections import Counter
from types import SimpleNamespace

import pandas as pd
import pytest

from veilspark.streaming import store
from veilspark.streaming.state import drained
from veilspark.streaming.store import TokenProcessor, Tokens, token_calls

SCHEMA = "database string, at timestamp, seq long, batch string, kind string, token string, value string"


def _calls(seed, n=400):
    rng, out = random.Random(seed), []
    for seq in range(n):
        batch = f"b{seq // 3}"
        kind = "publish" if rng.random() < 0.6 else "resolve"
        out.append((f"d{rng.randrange(2)}", 1_700_000_000 + seq // 3 * 200, seq, batch, kind, f"t{rng.randrange(14)}", f"v{seq % 5}"))
    return out


def _plain(calls, limit, ttl, until):
    out = Counter()
    for d in {c[0] for c in calls}:
        own = Tokens({}, limit, ttl * 1000)
        out.update((d, *r) for r in own.take([(c[1] * 1000, *c[2:]) for c in calls if c[0] == d and c[1] <= until]))
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_rows_do_not_depend_on_micro_batches(spark, tmp_path, files):
    calls = _calls(3)
    rng = random.Random(files)
    # calls come up to 2 hours after their own time, so files aren't in its order
    came = sorted(calls, key=lambda c: c[1] + rng.random() * 7200)
    for i in range(files):
        part = came[len(came) * i // files : len(came) * (i + 1) // files]
        spark.createDataFrame(part, SCHEMA.replace("at timestamp", "at long")).selectExpr("database", "timestamp_seconds(at) at", "seq", "batch", "kind", "token", "value").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows = drained(token_calls(stream, 5, 1500, "3 hours"), "tokens").collect()
    until = max(c[1] for c in calls) - 3 * 3600
    expected = _plain(calls, 5, 1500, until)
    assert Counter(tuple(r) for r in rows) == expected
    assert {r[-1] for r in expected} == ({"new", "reused", "replaced", "evicted", "resolved", "unknown"} if expected else set())


def test_eviction_spares_the_batch_and_reads_refresh():
    own = Tokens({}, 3, 10_000)
    own.take([(1, 1, "a", "publish", "x", "X"), (2, 2, "b", "publish", "y", "Y"), (3, 3, "c", "publish", "z", "Z"), (4, 4, "q", "resolve", "x", None)])
    rows = own.take([(5, 5, "d", "publish", "y", "Y"), (5, 6, "d", "publish", "w", "W")])
    assert [(r[4], r[6]) for r in rows] == [("z", "evicted"), ("y", "reused"), ("w", "new")]
    assert set(own.entries) == {"x", "y", "w"}
    assert [r[6] for r in own.take([(6, i, "e", "publish", f"n{i}", "") for i in range(4)])] == ["refused"] * 4
    assert [r[6] for r in own.take([(20_000, 1, "f", "resolve", "x", None), (20_000, 2, "f", "publish", "x", "X")])] == ["unknown", "replaced"]
    assert set(own.entries) == {"x"}


class _Handle(dict):
    """State of one database in memory; counts what is written."""

    def __init__(self):
        self.writes, self.timers = Counter(), set()

    def _state(self, name):
        own = self.setdefault(name, {})

        def put(key, value):
            self.writes[name] += 1
            own[key] = value

        one = {"get": lambda: own[()], "exists": lambda: () in own, "update": lambda v: put((), v)}
        return SimpleNamespace(updateValue=put, getValue=own.get, containsKey=own.__contains__, removeKey=own.pop, keys=lambda: iter(list(own)), iterator=lambda: iter(list(own.items())), **one)

    def getMapState(self, name, *_):  # noqa: N802
        return self._state(name)

    def getValueState(self, name, *_):  # noqa: N802
        return self._state(name)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


@pytest.mark.parametrize("seed", range(4))
def test_calls_wait_in_packs_and_are_taken_by_the_hour(monkeypatch, seed):
    monkeypatch.setattr(store, "FRAME_ROWS", 100)
    hour, rng, handle = 3_600_000, random.Random(seed), _Handle()
    calls = [(i * 10_000, i, f"b{i // 2}", "publish" if rng.random() < 0.6 else "resolve", f"t{rng.randrange(40)}", rng.choice(["v", None])) for i in range(2000)]
    processor = TokenProcessor(20, 1_500_000)
    processor.init(handle)
    came, rows, taken = sorted(calls, key=lambda c: c[0] + rng.random() * hour), [], []
    for part, until in ((came[:900], 2 * hour + 5_000), (came[900:], 5 * hour), ([], 6 * hour)):
        frames = [pd.DataFrame(part[i : i + 300], columns=["at_ms", "seq", "batch", "kind", "token", "value"]).assign(at=None) for i in range(0, len(part), 300)]
        assert list(processor.handleInputRows(("d",), iter(frames), None)) == []
        for at in sorted(t for t in handle.timers if t <= until):
            out = list(processor.handleExpiredTimer(("d",), SimpleNamespace(getCurrentWatermarkInMs=lambda u=until: u), None))
            rows += [r for f in out for r in f.itertuples(index=False, name=None)]
            taken.append(len(out))
            handle.timers.discard(at)
    plain = Tokens({}, 20, 1_500_000)
    assert rows == [("d", *r) for r in plain.take(calls)] and not handle["waiting"] and not handle.timers
    assert {t: list(e) for (t,), e in handle["store"].items()} == plain.entries
    # a pack for each hour that a part of the stream has, not a write for each call
    assert handle.writes["waiting"] < 30 and max(taken) > 2


def _scanning(calls, limit, ttl):
    """Tokens by looking through all entries at every call."""
    held, out = {}, []
    for at, seq, batch, kind, t, value in calls:
        if kind == "resolve":
            live = t in held and held[t][1] > at
            out.append((seq, t, held[t][0] if live else None, "resolved" if live else "unknown"))
            if live:
                held[t][2] = (at, seq)
            continue
        gone = {x for x, e in held.items() if e[1] <= at}
        for x in gone:
            del held[x]
        if t in held:
            held[t][1:] = [max(held[t][1], at + ttl), (at, seq)]
            out.append((seq, t, held[t][0], "reused"))
            continue
        for x in sorted(held, key=lambda x: (held[x][2], x))[: max(0, len(held) + 1 - limit)]:
            out.append((seq, x, held.pop(x)[0], "evicted"))
        held[t] = [value, at + ttl, (at, seq)]
        out.append((seq, t, value, "replaced" if t in gone else "new"))
    return out


def test_tokens_are_not_looked_through_at_every_call(monkeypatch):
    rng, asked = random.Random(5), Counter()
    calls = [(i * 1000, i, f"b{i}", rng.choice(["publish", "publish", "resolve"]), f"t{rng.randrange(900)}", f"v{i}") for i in range(6000)]
    init = store.Lowest.__init__

    def counted(self, entries, rank):
        init(self, entries, lambda e: asked.update("r") or rank(e))

    monkeypatch.setattr(store.Lowest, "__init__", counted)
    for limit, ttl in ((500, 700_000), (300, 10**7), (1000, 100_000)):
        asked.clear()
        assert [(r[1], *r[4:]) for r in Tokens({}, limit, ttl).take(calls)] == _scanning(calls, limit, ttl)
        assert asked["r"] < 12 * len(calls)
