"""Whether a key occurred earlier in a stream, answered by generations of ribbon filters.

Earlier keys are sealed in generations: the stored keys are generation 0, the arrivals are cut by order into
further ones. The keys of a generation, hash-partitioned into shards, are put into a ribbon filter: every key
asks that the XOR of the slots chosen by its 64 coefficient bits, from its start slot on, equal its fingerprint,
and this banded binary linear system is solved by elimination, many small blocks at once. Keys whose equation
contradicts earlier ones (a block filled above the average) are kept exactly, so no key is ever missed.

One pass does it: a shard's keys stream through a task in the order of their generations. Each distinct key of the
open generation probes the filters of all sealed ones; at its end the generation is solved, and its keys are dropped
from memory. Later arrivals of a key within the open generation need only the position of its first. A key that every
filter denies has certainly not occurred and is never looked up; a filter can answer yes wrongly, so a yes is
confirmed against the exact keys. How often that was needed is reported, together with an audit of every filter with
keys that are certainly absent.

Repeated keys collapse by partial aggregation before the first shuffle, and a task holds the keys of one generation
of one shard, so no task or memory follows a frequent key. An arrival is new if it is the first of a new key, so the
answers are joined by arrival, not by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.lineage import cut

_WIDTH = 64
#: Keys a block gets on average, and its slots; what exceeds the slots is kept exactly.
_BLOCK_KEYS, _SLOTS = 448, 512
_WORDS = _SLOTS // 64 + 1
_EVENT = (
    "shard int, generation int, key long, first long, probes int, yes int, n_keys long, filter_bytes long, audit_probes long, audit_false long"
)
_EVENT_TYPES = {f.split()[0]: pa.int32() if f.endswith("int") else pa.int64() for f in _EVENT.split(", ")}


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    x = x.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _equations(keys: np.ndarray, blocks: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Block, start slot, coefficients and fingerprint of each key."""
    place, coefficients = mix(keys, 0), mix(keys, 1) | np.uint64(1)
    block = ((place >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    start = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(_SLOTS - _WIDTH + 1) >> np.uint64(32)).astype(np.int64)
    return block, start, coefficients, mix(keys, 2) >> np.uint64(64 - bits)


class Ribbon:
    """A filter over a set of keys: ``in`` for every key of the set, and for others once in ``2 ** bits``."""

    def __init__(self, blocks: int, bits: int, solution: np.ndarray, bumped: np.ndarray) -> None:
        self.blocks, self.bits, self.solution, self.bumped = blocks, bits, solution, bumped

    @classmethod
    def build(cls, keys: np.ndarray, bits: int) -> Ribbon:
        """Solve the system of distinct ``keys``."""
        blocks = max(1, -(-len(keys) // _BLOCK_KEYS))
        block, start, coefficients, prints = _equations(keys, blocks, bits)
        order = np.lexsort((start, block))
        block = block[order]
        # The j-th key of every block is inserted at once; blocks are independent systems.
        turn = np.arange(len(keys)) - np.searchsorted(block, block, side="left")
        by_turn = np.argsort(turn, kind="stable")
        ends = np.cumsum(np.bincount(turn)) if len(keys) else []
        rows, values = np.zeros((blocks, _SLOTS), np.uint64), np.zeros((blocks, _SLOTS), np.uint64)
        bumped, begin = [], 0
        for end in ends:
            k = order[by_turn[begin:end]]
            b, at, c, f = block[by_turn[begin:end]], start[k], coefficients[k], prints[k]
            begin = end
            while len(k):
                pivot = rows[b, at]
                free = pivot == 0
                rows[b[free], at[free]], values[b[free], at[free]] = c[free], f[free]
                left = ~free
                k, b, at = k[left], b[left], at[left]
                c, f = c[left] ^ pivot[left], f[left] ^ values[b, at]
                gone = c == 0
                if gone.any():
                    bumped.append(keys[k[gone & (f != 0)]])
                    k, b, at, c, f = k[~gone], b[~gone], at[~gone], c[~gone], f[~gone]
                zeros = np.bitwise_count((c & (~c + np.uint64(1))) - np.uint64(1))
                c, at = c >> zeros.astype(np.uint64), at + zeros
        solution = cls._substitute(rows, values, bits)
        return cls(blocks, bits, solution, np.sort(np.concatenate(bumped)) if bumped else np.zeros(0, np.int64))

    @staticmethod
    def _substitute(rows: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
        """The slots' values, from the last to the first: bit columns (blocks x bits x words)."""
        blocks = len(rows)
        window = np.zeros((blocks, bits), np.uint64)
        solution = np.zeros((blocks, bits, _WORDS), np.uint64)
        planes = np.arange(bits, dtype=np.uint64)
        one = np.uint64(1)
        for slot in range(_SLOTS - 1, -1, -1):
            window <<= one
            wanted = (values[:, slot][:, None] >> planes) & one
            window |= wanted ^ (np.bitwise_count(window & rows[:, slot][:, None]) & 1).astype(np.uint64)
            solution[:, :, slot >> 6] |= (window & one) << np.uint64(slot & 63)
        return solution

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are in the set, or seem to be."""
        block, start, coefficients, prints = _equations(keys, self.blocks, self.bits)
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        yes = np.arange(len(keys))
        for bit in range(self.bits):
            b, w, s = block[yes], word[yes], shift[yes]
            low, high = self.solution[b, bit, w], self.solution[b, bit, w + 1]
            spanned = (low >> s) | np.where(s > 0, high << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
            parity = np.bitwise_count(spanned & coefficients[yes]) & 1
            yes = yes[parity == ((prints[yes] >> np.uint64(bit)) & np.uint64(1))]
        found = np.zeros(len(keys), bool)
        found[yes] = True
        if len(self.bumped):
            found |= np.isin(keys, self.bumped)
        return found


def _event(n: int, **values) -> pa.RecordBatch:
    """``n`` rows; a column without values is null."""
    arrays = [pa.array(values[c], t) if c in values else pa.nulls(n, t) for c, t in _EVENT_TYPES.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_EVENT_TYPES))


class _Shard:
    """The sealed filters and the open generation of the shard that streams through a task."""

    def __init__(self, shard: int, bits: int, audit_keys: int) -> None:
        self.shard, self.bits, self.audit_keys = shard, bits, audit_keys
        self.sealed: list[Ribbon] = []
        self.generation, self.open = -1, []

    def take(self, generation: int, keys: np.ndarray, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Answer for some distinct keys of a generation, sealing the one before if it ended."""
        if generation != self.generation:
            yield from self.seal()
            self.generation = generation
        yes = np.zeros(len(keys), np.int32)
        for ribbon in self.sealed:
            yes += ribbon.contains(keys)
        self.open.append(keys)
        n = len(keys)
        yield _event(
            n, shard=np.full(n, self.shard, np.int32), generation=np.full(n, generation, np.int32), key=keys, first=firsts,
            probes=np.full(n, len(self.sealed), np.int32), yes=yes,
        )

    def seal(self) -> Iterator[pa.RecordBatch]:
        """Solve the open generation's filter, audit it with absent keys and forget its keys."""
        if not self.open:
            return
        keys = np.concatenate(self.open)
        ribbon = Ribbon.build(keys, self.bits)
        drawn = np.random.default_rng([self.shard, self.generation]).integers(-(2**63), 2**63 - 1, self.audit_keys)
        absent = drawn[~np.isin(drawn, keys)]
        self.sealed.append(ribbon)
        self.open = []
        yield _event(
            1, shard=[self.shard], generation=[self.generation], n_keys=[len(keys)], filter_bytes=[ribbon.solution.nbytes + ribbon.bumped.nbytes],
            audit_probes=[len(absent)], audit_false=[int(ribbon.contains(absent).sum())],
        )


def _position(value: Column, bounds: list[int]) -> Column:
    """The generation of an arrival: 1, and one more for each bound below it."""
    return sum((F.when(value > b, 1).otherwise(0) for b in bounds), F.lit(1)).cast("int")


class SeenBefore:
    """The answers for the arrivals of ``incoming``, given the keys of ``stored``.

    An arrival needs a non-null order; rows with a null order have no place in the stream and are left out. A null
    key was never seen. Repeated rows with one order do not see each other. ``generation_rows`` and ``generations``
    bound the filters: arrivals are cut into generations of that many rows, but no more than ``generations``;
    ``shard_keys`` is how many keys of all generations a shard gets. Empty tables give empty results. Other columns
    are not read. The verdicts of the filters are checkpointed when first asked for.
    """

    def __init__(
        self,
        stored: DataFrame,
        incoming: DataFrame,
        stored_key: str = "id",
        key: str = "id",
        order: str = "arrival_no",
        bits: int = 12,
        generation_rows: int = 1000,
        generations: int = 12,
        shard_keys: int = 400_000,
        audit_keys: int = 4096,
    ) -> None:
        arrivals = incoming.select(F.col(order).cast("long").alias("arrival"), F.col(key).cast("long").alias("key"))
        arrivals = arrivals.filter(F.col("arrival").isNotNull())
        quantiles = F.percentile_approx("arrival", [i / generations for i in range(1, generations)], 10_000) if generations > 1 else F.array()
        n, cuts = arrivals.agg(F.count(F.lit(1)), quantiles).first()
        # Of few rows there are fewer generations; every so manyth cut is left out.
        skip = max(1, -(-generations * generation_rows // max(1, n)))
        bounds = sorted(set((cuts or [])[skip - 1 :: skip]))
        self.arrivals = arrivals.withColumn("generation", _position(F.col("arrival"), bounds))
        total, parallel = n + stored.count(), stored.sparkSession.sparkContext.defaultParallelism
        self.shards = max(1, min(parallel, total // 10_000), -(-total // shard_keys))
        self.known = stored.select(F.col(stored_key).cast("long").alias("key")).dropna().distinct()
        self.bits, self.audit_keys = bits, audit_keys

    @cached_property
    def events(self) -> DataFrame:
        """A row for each distinct key of a generation (``shard, generation, key, first, probes, yes``: how many of the earlier
        filters were probed and answered yes) and one for each sealed filter (no key; its size and audit)."""
        firsts = self.arrivals.filter(F.col("key").isNotNull()).groupBy("generation", "key").agg(F.min("arrival").alias("first"))
        every = firsts.unionByName(self.known.select(F.lit(0).alias("generation"), "key", F.lit(None).cast("long").alias("first")))
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")
        bits, audit_keys = self.bits, self.audit_keys

        def watch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now: _Shard | None = None
            for batch in batches:
                shards, generations, keys = (batch.column(i).to_numpy() for i in range(3))
                edges = np.nonzero((np.diff(shards) != 0) | (np.diff(generations) != 0))[0] + 1
                for begin, end in zip([0, *edges], [*edges, len(keys)]):
                    if begin == end:
                        continue
                    if now is None or now.shard != shards[begin]:
                        yield from now.seal() if now else ()
                        now = _Shard(int(shards[begin]), bits, audit_keys)
                    yield from now.take(int(generations[begin]), keys[begin:end], batch.column(3).slice(begin, end - begin))
            yield from now.seal() if now else ()

        ordered = every.select(shard, "generation", "key", "first").repartitionById(self.shards, "shard").sortWithinPartitions("shard", "generation")
        return cut(ordered.mapInArrow(watch, _EVENT))

    def looked_up(self) -> DataFrame:
        """``generation, key, first`` of the keys that some earlier filter said yes to; no others are compared with exact keys."""
        return self.events.filter("yes > 0").select("generation", "key", "first")

    def wrong(self) -> DataFrame:
        """The looked-up keys that are in no earlier generation: the filters' wrong answers."""
        asked, exact = self.looked_up().alias("asked"), self.events.filter("key IS NOT NULL").select("generation", "key").alias("exact")
        earlier = F.expr("asked.key = exact.key AND exact.generation < asked.generation")
        return asked.join(exact, earlier, "left_anti")

    def answers(self) -> DataFrame:
        """``arrival, key, seen`` for every arrival. New are the first arrivals of the keys that all filters denied, or that were
        looked up in vain; they are joined by arrival, so a frequent key is spread over all tasks."""
        denied = self.events.filter("yes = 0 AND generation > 0").select("key", "first")
        new = denied.unionByName(self.wrong().select("key", "first")).select(F.col("first").alias("arrival"), "key", F.lit(True).alias("new"))
        answered = self.arrivals.join(new, ["arrival", "key"], "left")
        return answered.select("arrival", "key", (F.col("key").isNotNull() & F.col("new").isNull()).alias("seen"))

    def report(self) -> DataFrame:
        """Per generation: its filters' size and audit, its probes, and the answers that were wrong before confirmation."""
        sealed = self.events.filter("key IS NULL").groupBy("generation").agg(
            F.sum("n_keys").alias("n_keys"),
            F.sum("filter_bytes").alias("filter_bytes"),
            F.sum("audit_probes").alias("audit_probes"),
            F.sum("audit_false").alias("audit_false"),
        )
        asked = self.events.filter("key IS NOT NULL AND generation > 0").groupBy("generation").agg(
            F.count(F.lit(1)).alias("n_asked"),
            F.sum("probes").alias("n_probes"),
            F.count_if(F.col("yes") > 0).alias("n_looked_up"),
        )
        wrong = self.wrong().groupBy("generation").agg(F.count(F.lit(1)).alias("n_wrong"))
        rows = sealed.join(asked, "generation", "left").join(wrong, "generation", "left")
        rows = rows.withColumn("n_wrong", F.when(F.col("n_asked").isNotNull(), F.coalesce("n_wrong", F.lit(0))))
        absent = F.col("n_asked") - F.col("n_looked_up") + F.col("n_wrong")
        return rows.select(
            "*",
            (F.col("audit_false") / F.col("audit_probes")).alias("audit_rate"),
            F.try_divide("n_wrong", absent).alias("wrong_rate"),
        )
