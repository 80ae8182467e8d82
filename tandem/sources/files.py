"""Price and result files as a Spark data source: a file a pair, a task a file, faults with file and line.

Tables have fixed columns. A file's name without its ending is the pair. Fields are separated by commas and never quoted; empty
fields are null where a column may be. Writers sort a pair's rows, write to a name of their own, and the driver renames what was
committed, so a task that is repeated or lost leaves no file behind.
"""

from __future__ import annotations

import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..config import DataError

#: The columns of each table in their files, with types; ``?`` may be empty.
TABLES = {
    "prices": "date string, price_a price, price_b price",
    "bars": "index long, date string, price_a double, price_b double, hedge_ratio double?, spread double?, zscore double?, position string, qty_a double, qty_b double, "
    "cash double, position_value double, nav double, costs_this_bar double, interest_this_bar double, trade_event string?",
    "trades": "direction string, entry_index long, exit_index long, entry_date string, exit_date string, entry_z double, exit_z double, pnl_gross double, costs double, pnl_net double, exit_reason string, holding_bars long",
    "metrics": "metric string, value double",
}
#: What a table's rows are sorted by, in Spark's names.
ORDER = {"prices": "idx", "bars": "idx", "trades": "entry_index", "metrics": "metric"}
#: Rows of a batch.
BATCH = 10_000
DECIMALS = 10


def columns(table: str) -> list[tuple[str, str, bool]]:
    """(name, type, may be empty) of the file's columns."""
    if table not in TABLES:
        raise DataError(f"no table is called {table!r}; there are {sorted(TABLES)}")
    return [(n, t.rstrip("?"), t.endswith("?")) for n, t in (c.split() for c in TABLES[table].split(", "))]


def spark_name(column: str) -> str:
    return "idx" if column == "index" else column


def spark_columns(table: str) -> list[tuple[str, str]]:
    """(name, type) in Spark; price rows are numbered as well."""
    own = [(spark_name(n), "double" if t == "price" else t) for n, t, _ in columns(table)]
    return [("pair_id", "string"), *([("idx", "long")] if table == "prices" else []), *own]


ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def parsed(text: str, name: str, kind: str, empty: bool):
    """A field's value, or DataError."""
    if not text:
        if empty or (kind == "string" and name != "date"):
            return None if name != "trade_event" else ""
        raise DataError(f"{name} has no value")
    if kind == "string":
        return text
    try:
        value = int(text) if kind == "long" else float(text)
    except ValueError:
        raise DataError(f"{name} should be a number but is '{text}'") from None
    if kind == "price" and not (0 < value < math.inf):
        raise DataError(f"{name} should be above zero and finite but is {text}")
    return value


def rows_of(lines: Iterator[str], table: str) -> Iterator[tuple]:
    """Values of a file's rows; DataError says in which line, blank ones not counted."""
    cols, n, before = columns(table), 0, ""
    wanted = [c for c, _, _ in cols]
    for line in lines:
        if not (line := line.strip()):
            continue
        n += 1
        fields = [x.strip() for x in line.split(",")]
        if n == 1:
            if fields != wanted:
                raise DataError(f"line 1: the columns should be {','.join(wanted)}, found '{line}'")
            continue
        if len(fields) != len(cols):
            raise DataError(f"line {n}: {len(fields)} fields where {len(cols)} belong")
        try:
            values = tuple(parsed(x, *c) for x, c in zip(fields, cols, strict=True))
        except DataError as error:
            raise DataError(f"line {n}: {error}") from None
        if table == "prices":
            if values[0] <= before:
                raise DataError(f"line {n}: date {values[0]} comes after {before}, but isn't later")
            before = values[0]
        yield values
    if n == 0:
        raise DataError("line 0: nothing in it")
    if n == 1 and table == "prices":
        raise DataError("line 1: no rows below the columns")


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[File]:
        """A partition for each file, by name; of a folder those that aren't hidden."""
        system, root = place(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [File(self.path)]
        if info.type != fs.FileType.Directory:
            raise DataError(f"{self.path}: there is no such file or folder")
        found = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.base_name[0] not in "._")
        if not found:
            raise DataError(f"{self.path}: the folder holds no files")
        return [File(posixpath.join(self.path, x)) for x in found]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        system, path = place(partition.path)
        pair = posixpath.basename(path).rsplit(".", 1)[0]
        schema = pa.schema([(n, ARROW[t]) for n, t in spark_columns(self.table)])
        held: list[tuple] = []

        def batch(first: int) -> pa.RecordBatch:
            lead = [[pair] * len(held)] + ([list(range(first, first + len(held)))] if self.table == "prices" else [])
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*lead, *zip(*held, strict=True)], schema, strict=True)], schema=schema)

        first = 0
        try:
            with system.open_input_stream(path) as stream:
                for row in rows_of(lines(stream), self.table):
                    held.append(row)
                    if len(held) == BATCH:
                        yield batch(first)
                        first, held = first + len(held), []
        except DataError as error:
            raise DataError(f"{posixpath.basename(path)}, {error}") from None
        if held:
            yield batch(first)


def lines(stream) -> Iterator[str]:
    """Lines of a byte stream, some at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode() for x in whole)
    yield rest.decode()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Rows come sorted by pair (see :func:`write`), so a task has one file open at a time."""

    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        cols, made, out, at = columns(self.table), [], None, None

        def shown(value, kind: str) -> str:
            if value is None or value != value:
                return ""
            return f"{value:.{DECIMALS}f}" if kind in ("double", "price") else str(value)

        for batch in iterator:
            fields = [batch.column(spark_name(n)).to_pylist() for n, _, _ in cols]
            for pair, *values in zip(batch.column("pair_id").to_pylist(), *fields, strict=True):
                if pair != at:
                    if out:
                        out.close()
                    final, at = posixpath.join(root, f"{pair}.csv"), pair
                    made.append((posixpath.join(root, f".{uuid.uuid4().hex}"), final))
                    out = system.open_output_stream(made[-1][0])
                    out.write((",".join(n for n, _, _ in cols) + "\n").encode())
                out.write((",".join(shown(v, t) for v, (_, t, _) in zip(values, cols, strict=True)) + "\n").encode())
        if out:
            out.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = place(self.path)
        for message in messages:
            for temporary, final in message.files if message else []:
                system.move(temporary, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = place(self.path)
        for message in messages:
            for temporary, _ in message.files if message else []:
                system.delete_file(temporary)


class PairFiles(DataSource):
    """``spark.read.format("pairfiles").option("table", "prices").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "pairfiles"

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in spark_columns(self.options["table"]))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options["table"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["table"])


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    columns(table)
    spark.dataSource.register(PairFiles)
    return spark.read.format("pairfiles").option("table", table).load(path)


def write(df: DataFrame, path: str, table: str) -> None:
    """A file for each pair_id of ``df``; its columns must be those of the table, others aren't written."""
    wanted = spark_columns(table)
    if missing := [n for n, _ in wanted if n not in df.columns]:
        raise DataError(f"a table of {table} needs the columns {missing}")
    df.sparkSession.dataSource.register(PairFiles)
    rows = df.select(*(df[n].cast(t).alias(n) for n, t in wanted)).repartition("pair_id").sortWithinPartitions("pair_id", ORDER[table])
    rows.write.format("pairfiles").option("table", table).mode("append").save(path)
