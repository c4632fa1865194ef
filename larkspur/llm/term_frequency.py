"""Occurrences and record counts of every distinct term, by recursive radix spilling.

Records are split into terms in the JVM and combined within each task before anything is shuffled, so that a
term in every record leaves a task once. The combined counts are then partitioned by bits of the term's hash:
first by Spark's shuffle, then, inside a task whose share exceeds its memory, into sixteen files by the next four
bits, and every file that is still too large into sixteen more. Each part is aggregated by DuckDB, with a
memory limit. A part of one single term never grows the result, so it needs no further split.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.lineage import shared_dir
from larkspur.functions.unicode import WS, split_words

_BITS = 4
_COUNTS = "hash long, term string, occurrences long, n_records long"


def _combine(batches: Iterator[pa.RecordBatch], most_rows: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Counts of the terms in batches of term lists; holds at most about ``most_rows`` terms."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by("term").aggregate([("occurrences", "sum"), ("n_records", "sum")])
        return sums.select(["term", "occurrences_sum", "n_records_sum"]).rename_columns(["term", "occurrences", "n_records"])

    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            lists = batch.column(0).slice(start, 2000)
            pairs = pa.table({"record": pa.compute.list_parent_indices(lists), "term": pa.compute.list_flatten(lists)})
            each = pairs.group_by(["record", "term"]).aggregate([([], "count_all")])
            counted = each.group_by("term").aggregate([("count_all", "sum"), ([], "count_all")])
            held.append(counted.select(["term", "count_all_sum", "count_all"]).rename_columns(["term", "occurrences", "n_records"]))
            if sum(t.num_rows for t in held) > most_rows:
                held[:] = [merged()]
                if held[0].num_rows > most_rows // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def _opened_by_arrow(uri: str) -> str:
    """A folder as Spark names it, as Arrow does: other names of the same object store, and paths without a scheme."""
    scheme, sign, rest = uri.partition("://")
    return f"s3://{rest}" if sign and scheme in ("s3a", "s3n") else uri if sign or uri.startswith(("file:", "/")) else os.path.abspath(uri)


class RadixSpill:
    """Sums counts by term within ``budget`` bytes of memory, spilling to ``folder`` (any URI that pyarrow opens)."""

    def __init__(self, folder: str, budget: int) -> None:
        self.budget, self.folder = budget, folder
        self.files = self.root = self.local = None
        self.spilled = 0

    def _open(self) -> None:
        """Name a folder of this task's own; nothing is written as long as the share fits the memory."""
        from pyarrow import fs

        self.files, root = fs.FileSystem.from_uri(_opened_by_arrow(self.folder))
        self.root = f"{root}/radix-{uuid.uuid4().hex}"
        self.local = self.root if isinstance(self.files, fs.LocalFileSystem) else None

    def _summed(self, reader: pa.RecordBatchReader) -> Iterator[pa.RecordBatch]:
        import duckdb

        spill = f"{self.local}-duckdb" if self.local else ""
        config = {"threads": 1, "memory_limit": f"{max(64, 3 * self.budget >> 20)}MB", "temp_directory": spill}
        with duckdb.connect(config=config) as db:
            db.register("counts", reader)
            sums = "SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(n_records)::BIGINT AS n_records FROM counts GROUP BY term"
            yield from db.sql(sums).to_arrow_reader(20_000)

    def _split(self, batches: Iterator[pa.RecordBatch], name: str, level: int) -> Iterator[tuple[str, int, bool]]:
        """Write batches to files by the hash bits of ``level``; name, bytes, and whether one hash only, of each."""
        parts: dict[int, list] = {}
        self.files.create_dir(self.root, recursive=True)
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view("uint64")
            digits = (hashes >> (64 - _BITS * (level + 1))) & ((1 << _BITS) - 1)
            for digit in set(digits.tolist()):
                mine = digits == digit
                chosen = batch.filter(pa.array(mine))
                part = parts.get(digit)
                if part is None:
                    stream = self.files.open_output_stream(f"{self.root}/{name}{digit:x}")
                    part = parts[digit] = [pa.ipc.new_stream(stream, batch.schema), stream, 0, hashes[mine][0], True]
                part[0].write_batch(chosen)
                part[2] += chosen.nbytes
                part[4] &= bool((hashes[mine] == part[3]).all())
        for digit, (writer, stream, size, _, single) in parts.items():
            writer.close()
            stream.close()
            self.spilled += size
            yield f"{name}{digit:x}", size, single

    def _aggregate(self, name: str, size: int, single: bool, level: int) -> Iterator[pa.RecordBatch]:
        path = f"{self.root}/{name}"
        with self.files.open_input_stream(path) as stream, pa.ipc.open_stream(stream) as reader:
            if size <= self.budget or single or _BITS * (level + 1) > 64:
                yield from self._summed(pa.RecordBatchReader.from_batches(reader.schema, reader))
                parts = []
            else:
                parts = list(self._split(iter(reader), name, level))
        self.files.delete_file(path)
        for part in parts:
            yield from self._aggregate(*part, level + 1)

    def run(self, batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        """The sums; ``level`` is the number of four-bit digits by which the input is partitioned already."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > self.budget:
                break
        if not held:
            return
        if size <= self.budget:
            yield from self._summed(pa.RecordBatchReader.from_batches(held[0].schema, held))
            return

        def rest() -> Iterator[pa.RecordBatch]:
            while held:
                yield held.pop()
            yield from batches

        self._open()
        try:
            for part in list(self._split(rest(), "p", level)):
                yield from self._aggregate(*part, level + 1)
        finally:
            for path in (self.root, f"{self.root}-duckdb"):
                if self.files.get_file_info(path).type != 0:
                    self.files.delete_dir(path)


def term_frequency(
    records: DataFrame,
    id_col: str = "id",
    text_col: str = "preprocessed_text",
    rare_records: int = 2,
    common_share: tuple[int, int] = (1, 6),
    task_bytes: int = 48 << 20,
    few: int = 200_000,
) -> DataFrame:
    """``term, occurrences, n_records, mark`` of every maximal run of non-whitespace characters.

    ``mark`` is ``rare`` (in at most ``rare_records`` records), ``common`` (in more, and in at least the given share
    of the records with a text) or null. A record is a distinct non-null id with a non-null text, counted once
    however often its row is repeated (should its texts differ, the smallest counts); an empty text is a record
    without terms. An empty table gives an empty result. Counts the records when called. Only texts of ids that occur in
    several rows are compared with each other; up to ``few`` such ids are broadcast, so that no other text is shuffled.
    """
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    counted = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    total, several = counted.agg(F.count(F.lit(1)), F.count_if(F.col("n") > 1)).first()
    again = counted.filter("n > 1").select("id")
    again = F.broadcast(again) if several <= few else again
    once = rows.join(again, "id", "left_anti").select("id", "text")
    texts = once.unionByName(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    combined = texts.select(split_words(F.col("text"), WS).alias("terms")).mapInArrow(
        _combine, "term string, occurrences long, n_records long"
    )
    hashed = combined.select(F.xxhash64("term").alias("hash"), "term", "occurrences", "n_records")
    # The top twelve bits are the radix of the shuffle; a task continues with the following digits.
    parted = hashed.repartition(F.shiftrightunsigned("hash", 52))
    folder = shared_dir(records.sparkSession)

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from RadixSpill(folder, task_bytes).run(iter(batches), 3)

    counts = parted.mapInArrow(aggregate, "term string, occurrences long, n_records long")
    share, of = common_share
    mark = F.when(F.col("n_records") <= rare_records, "rare").when(F.col("n_records") * of >= F.lit(share * total), "common")
    return counts.withColumn("mark", mark)
