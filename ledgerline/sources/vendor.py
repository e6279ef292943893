"""Tool functions of agents as a data source: prices, metrics, insider trades and news of a vendor.

``vendor`` reads a folder of Parquet files with a ticker and a date, as a stand-in for a
vendor's service: it takes the tickers and dates that Spark pushes down, asks only for the
row groups that can have them, and hands Arrow batches over. Filters that it doesn't know
stay with Spark. The functions below are the requests that a backtest makes before it starts.

The folder has to be one that pyarrow can open on the driver and the executors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.lookups import newest
from .registry import known

#: Newest rows of a ticker that are asked for, and years of prices before the end.
LIMITS = {"metrics": 10, "insider_trades": 1000, "news": 1000}
PRICE_YEARS = 1
#: Rows of a batch, and bytes of a column that are read at a time.
ROWS, BUFFER = 16_384, 1 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _condition(f: Filter) -> ds.Expression | None:
    """A filter on one column as Arrow has it; None if it isn't one of the plain comparisons."""
    if not hasattr(f, "attribute") or len(f.attribute) != 1:
        return None
    column = ds.field(f.attribute[0])
    if isinstance(f, IsNotNull):
        return column.is_valid()
    if isinstance(f, In):
        return column.isin(list(f.value))
    compare = {EqualTo: lambda c, v: c == v, GreaterThan: lambda c, v: c > v, GreaterThanOrEqual: lambda c, v: c >= v, LessThan: lambda c, v: c < v, LessThanOrEqual: lambda c, v: c <= v}.get(type(f))
    return compare(column, f.value) if compare else None


class VendorReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _condition(f) is None:
                yield f
            else:
                self.filters.append(f)

    def _wanted(self) -> ds.Expression | None:
        out = None
        for f in self.filters:
            one = _condition(f)
            out = one if out is None else out & one
        return out

    def partitions(self) -> list[InputPartition]:
        """One for each file; its row groups are chosen by their statistics."""
        system, folder = fs.FileSystem.from_uri(self.path)
        found = ds.dataset(folder, filesystem=system, format="parquet", exclude_invalid_files=True)
        wanted = self._wanted()
        groups = [(part.path, [g.id for g in part.subset(wanted).row_groups] if wanted is not None else None) for part in found.get_fragments()]
        return [InputPartition(x) for x in groups if x[1] != []] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        if partition.value is None:
            yield pa.RecordBatch.from_pylist([], schema=schema)
            return
        path, groups = partition.value
        system, _ = fs.FileSystem.from_uri(self.path)
        wanted, any_batch = self._wanted(), False
        with system.open_input_file(path) as f:
            # pages are read as they are needed: whatever the size of a file, a task holds some pages and a batch
            pages = pq.ParquetFile(f, buffer_size=BUFFER, pre_buffer=False)
            for batch in pages.iter_batches(batch_size=ROWS, row_groups=groups, columns=schema.names, use_threads=False):
                if wanted is not None:
                    batch = batch.filter(wanted)
                if batch.num_rows:
                    any_batch = True
                    yield pa.RecordBatch.from_arrays([batch.column(n).cast(t) for n, t in zip(schema.names, schema.types, strict=True)], schema=schema)
        if not any_batch:
            yield pa.RecordBatch.from_pylist([], schema=schema)


class Vendor(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor"

    def reader(self, schema: StructType) -> VendorReader:
        return VendorReader(self.options["path"], schema)


def vendor(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of one kind; filters on it are pushed down."""
    spark.conf.set(PUSHDOWN, "true")
    known(spark, Vendor)
    return spark.read.format("vendor").option("path", path).schema(schema).load()


def _of(rows: DataFrame, tickers: list) -> DataFrame:
    return rows.filter(F.col("ticker").isin(tickers)) if tickers else rows


def prices(rows: DataFrame, end: str, tickers: list | None = None, years: int = PRICE_YEARS) -> DataFrame:
    """The prices of the year before end, end included."""
    day = F.lit(end).cast("date")
    return _of(rows, tickers or []).filter((F.col("date") >= F.add_months(day, -12 * years)) & (F.col("date") <= day))


def newest_of(rows: DataFrame, kind: str, end: str, start: str | None = None, tickers: list | None = None) -> DataFrame:
    """Each ticker's newest metrics, insider trades or news until end (and from start on), up to the kind's limit."""
    inside: Column = F.col("date") <= F.lit(end).cast("date")
    if start:
        inside &= F.col("date") >= F.lit(start).cast("date")
    return newest(_of(rows, tickers or []).filter(inside), "ticker", "date", LIMITS[kind])
