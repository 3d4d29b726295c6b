"""Keyed state by event time: propagation windows, advert rates and held results.

Rows of a key wait until the watermark has passed them and then take effect in the order of their times, so what comes out
doesn't depend on how the rows were dealt over batches, nor on a restart. Each has a batch form of the same result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A packet's propagation window, and how long it is known after its first sighting, in milliseconds.
WINDOW_MS, KNOWN_MS = 60_000, 600_000
#: Adverts above this in a minute are a flood, names above this in half an hour a rotation.
FLOOD, MINUTE_MS, ROTATION, NAMES_MS = 30, 60_000, 3, 1_800_000
#: How long a held result lives after its last refinement, the hops it may hold, and the confidence that refines it.
HELD_MS, HELD_HOPS, CONFIDENT = 1_800_000, 64, 0.6
#: The parts that keys are dealt to by hash, and the rows of a part that are kept or told at once.
PARTS, PART_ROWS = 1024, 10_000


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own that keeps state in RocksDB, on disk, with the checkpoints in the stream's folder."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def _packed(rows: list) -> bytes:
    return zlib.compress(json.dumps(rows, separators=(",", ":")).encode(), 1)


def _unpacked(text: bytes) -> list:
    return json.loads(zlib.decompress(bytes(text)))


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed their times, then hands each key's to ``step`` in order of time.

    ``keys`` and ``rows``: the columns of a key and what is kept of a row, with ``ms`` first. ``step`` takes a key, what was held
    of it (none: None), its rows due and the time up to which all rows are known, and gives back rows of output, what to hold
    (as JSON can) and the time at which to call again without rows, if any. Spark's state is of a part, not of a key: the rows
    and states of a part's keys are read and written together, so a batch costs by its rows, however many keys they have.
    """

    keys: list[str]
    rows: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", "keys binary")
        self.alarm = handle.getValueState("alarm", "ms long")

    def step(self, key: tuple, held: list | None, due: list[list], until: int) -> tuple[list[tuple], list | None, int | None]:
        raise NotImplementedError

    def _ring(self, at: int | None) -> None:
        """One timer for each part: at the first row that waits, or when a key's state has to be looked at."""
        old = self.alarm.get()
        if old is not None and (at is None or old[0] != at):
            self.handle.deleteTimer(old[0])
            self.alarm.clear()
        if at is not None and (old is None or old[0] != at):
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            self.waiting.appendValue((_packed(list(zip(*(frame[c].tolist() for c in (*self.keys, *self.rows))))),))
            least = int(frame["ms"].min())
            first = least if first is None else min(first, least)
        old = self.alarm.get()
        if first is not None and (old is None or first < old[0]):
            self._ring(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, k = int(timerValues.getCurrentWatermarkInMs()), len(self.keys)
        due: dict[tuple, list] = {}
        later = []
        for (chunk,) in self.waiting.get():
            for row in _unpacked(chunk):
                if row[k] <= until:
                    due.setdefault(tuple(row[:k]), []).append(row[k:])
                else:
                    later.append(row)
        old = self.held.get()
        held = {tuple(of): (again, state) for of, again, state in (_unpacked(old[0]) if old is not None else ())}
        made = []
        for of in [*due, *(of for of, (again, _) in held.items() if again <= until and of not in due)]:
            told, state, again = self.step(of, held.pop(of, (None, None))[1], sorted(due.get(of, ()), key=lambda r: [(x is None, x) for x in r]), until)
            made += told
            if state is not None:
                held[of] = (again, state)
        self.waiting.clear()
        for i in range(0, len(later), PART_ROWS):
            self.waiting.appendValue((_packed(later[i : i + PART_ROWS]),))
        if held:
            self.held.update((_packed([(of, *h) for of, h in held.items()]),))
        else:
            self.held.clear()
        self.alarm.clear()
        times = [again for again, _ in held.values()] + [row[k] for row in later]
        self._ring(max(min(times), until + 1) if times else None)
        for i in range(0, len(made), PART_ROWS):
            yield pd.DataFrame(made[i : i + PART_ROWS], columns=self.output)

    def close(self) -> None:
        pass


class Propagation(InOrder):
    """One row for each packet WINDOW_MS after its first sighting, with all that observed it in the meantime.

    A later sighting changes nothing until KNOWN_MS after the first; after that the packet counts as a new one.
    """

    keys = ["network", "packet_hash"]
    rows = ["ms", "observer", "hops"]
    output = ["network", "packet_hash", "first_ms", "observers", "sightings", "most_hops"]
    schema = "network string, packet_hash string, first_ms long, observers array<string>, sightings long, most_hops int"

    def step(self, key, held, due, until):
        made = []
        first, told, seen = held if held is not None else (None, False, {})
        tell = lambda: made.append((*key, first, sorted(seen), sum(n for _, n in seen.values()), max(h for h, _ in seen.values())))
        for ms, observer, hops in due:
            if first is not None and not told and ms > first + WINDOW_MS:
                tell()
                told, seen = True, {}
            if first is None or ms > first + KNOWN_MS:
                first, told = ms, False
            if not told:
                most, n = seen.get(observer, (0, 0))
                seen[observer] = (max(hops, most), n + 1)
        if first is not None and not told and until >= first + WINDOW_MS:
            tell()
            told, seen = True, {}
        if first is None or (told and until > first + KNOWN_MS):
            return made, None, None
        return made, [first, told, seen], first + KNOWN_MS + 1 if told else first + WINDOW_MS


class AdvertRates(InOrder):
    """For each advert how many its sender made in the last minute, itself and those of the same moment included, and how many
    names it used in the last half hour; times and names older than that are forgotten."""

    keys = ["sender"]
    rows = ["ms", "id", "name"]
    output = ["sender", "id", "in_minute", "names", "flood", "rotation"]
    schema = "sender string, id long, in_minute long, names long, flood boolean, rotation boolean"

    def step(self, key, held, due, until):
        made = []
        times, named = held if held is not None else ([], {})
        for ms, rows in groupby(due, key=lambda r: r[0]):
            now = list(rows)
            times = [t for t in times if ms - t < MINUTE_MS] + [ms] * len(now)
            named = {n: t for n, t in named.items() if ms - t <= NAMES_MS} | {n: ms for _, _, n in now}
            made += [(*key, int(i), len(times), len(named), len(times) > FLOOD, len(named) > ROTATION) for _, i, _ in now]
        times = [t for t in times if until - t < MINUTE_MS]
        named = {n: t for n, t in named.items() if until - t <= NAMES_MS}
        return made, [times, named] if named else None, max(named.values()) + NAMES_MS + 1 if named else None


class HeldResults(InOrder):
    """What is known of a packet's hops: confident results refine it hop by hop, the latest counts. HELD_MS after the last
    refinement it is told and forgotten. Of more than HELD_HOPS hops those that came first are held."""

    keys = ["network", "packet_hash"]
    rows = ["ms", "hash", "node"]
    output = ["network", "packet_hash", "first_ms", "last_ms", "refinements", "hops"]
    schema = "network string, packet_hash string, first_ms long, last_ms long, refinements long, hops array<string>"

    def step(self, key, held, due, until):
        made = []
        first, last, n, nodes = held if held is not None else (None, None, 0, {})
        tell = lambda: made.append((*key, first, last, n, sorted(f"{h}={v}" for h, v in nodes.items())))
        for ms, hash, node in due:
            if last is not None and ms - last > HELD_MS:
                tell()
                first, n, nodes = None, 0, {}
            first, last = (ms if first is None else first), ms
            n += 1
            if hash in nodes or len(nodes) < HELD_HOPS:
                nodes[hash] = node
        if until > last + HELD_MS:
            tell()
            return made, None, None
        return made, [first, last, n, nodes], last + HELD_MS + 1


def _millis(column: str = "time"):
    return F.unix_millis(F.col(column).cast("timestamp"))


def _run(stream: DataFrame, processor: InOrder, delay: str) -> DataFrame:
    part = F.pmod(F.xxhash64(*processor.keys), F.lit(PARTS))
    kept = stream.withColumns({"part": part, "at": F.col("time").cast("timestamp")}).withWatermark("at", delay)
    return kept.groupBy("part").transformWithStateInPandas(processor, processor.schema, "append", "eventTime")


def propagation(stream: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """The Propagation of a stream's network, packet_hash, time, rx_node_id and hop_count; rows without one of the first four don't count."""
    s = stream.where("network is not null and packet_hash is not null and time is not null and rx_node_id is not null")
    return _run(s.select("network", "packet_hash", "time", _millis().alias("ms"), F.col("rx_node_id").alias("observer"), F.coalesce("hop_count", F.lit(0)).alias("hops")), Propagation(), delay)


def advert_rates(stream: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """The AdvertRates of a stream's sender, id, name and time; a missing name is the empty one."""
    s = stream.where("sender is not null and time is not null").select("sender", "time", _millis().alias("ms"), "id", F.coalesce("name", F.lit("")).alias("name"))
    return _run(s, AdvertRates(), delay)


def held_results(stream: DataFrame, delay: str = "2 minutes", confident: float = CONFIDENT) -> DataFrame:
    """The HeldResults of a stream's network, packet_hash, time, hash, node and confidence."""
    s = stream.where((F.col("confidence") >= confident) & F.expr("network is not null and packet_hash is not null and time is not null and hash is not null and node is not null"))
    return _run(s.select("network", "packet_hash", "time", _millis().alias("ms"), "hash", "node"), HeldResults(), delay)
