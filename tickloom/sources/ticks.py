"""Tick files and the quote grid.

A raw tick file holds one symbol-day of quote rows (ten levels) and trade rows. Files are read
with an explicit schema; projection and the row-type and session filters reach the scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.clock import SESSION_END, SESSION_START, bucket_of, packed_to_micros
from tickloom.operators.frames import CHUNK_ROWS, running_total
from tickloom.operators.positions import positions_by_piece
from tickloom.session import cut_lineage

QUOTE_ROW, TRADE_ROW = 12, 11
SELL_LED, BUY_LED = 1, 2
LEVELS = 10
FILE_PATTERN = r"([0-9A-Za-z]+)_[^/]*_([0-9]{8})\.parquet$"
INDEXED_FILES = 1_000  # more than so many files are opened by the tasks and not kept in an index of the driver
TASK_STORES = ("file", "hdfs")  # schemes of which tasks list and open files themselves
ROWS_AT_ONCE = 8_192


def raw_schema(levels: int = LEVELS) -> T.StructType:
    fields = [
        T.StructField("data_type", T.IntegerType()),
        T.StructField("local_time", T.LongType()),
        T.StructField("askbid_type", T.IntegerType()),
        T.StructField("trade_price", T.DoubleType()),
        T.StructField("trade_quantity", T.DoubleType()),
        T.StructField("cumulative_trading_amount", T.DoubleType()),
    ]
    for side in ("ask", "bid"):
        for i in range(1, levels + 1):
            fields.append(T.StructField(f"{side}{i}_price", T.DoubleType()))
            fields.append(T.StructField(f"{side}{i}_quantity", T.DoubleType()))
    return T.StructType(fields)


def file_manifest(
    spark: SparkSession, root: str, dates: Sequence[str] | None = None, pattern: str = FILE_PATTERN, glob: str = "*.parquet"
) -> DataFrame:
    """``path, code, date, bytes`` of the tick files in the date folders of ``root``; no file is opened.

    ``dates`` names the folders to list; without it every folder directly below ``root`` is. Folders are
    listed by tasks (``_listing``). Files whose name does not fit
    ``pattern`` (code, then date) are left out. A manifest can be stored and read instead of listing again.
    """
    folders = [f"{root.rstrip('/')}/{d}" for d in dates] if dates is not None else [root.rstrip("/")]
    path = F.col("path")
    if not folders:
        return spark.createDataFrame([], "path string, code string, date string, bytes long")
    return _listing(spark, folders, glob).select(
        "path",
        F.regexp_extract(path, pattern, 1).alias("code"),
        F.regexp_extract(path, pattern, 2).alias("date"),
        F.col("length").alias("bytes"),
    ).filter(F.col("code") != "")


def sole_files(manifest: DataFrame) -> DataFrame:
    """Files of codes that have exactly one on their date; codes with several are not to be chosen from."""
    return (
        manifest.groupBy("date", "code")
        .agg(F.count(F.lit(1)).alias("_files"), F.min("path").alias("path"), F.sum("bytes").alias("bytes"))
        .filter(F.col("_files") == 1)
        .select("path", "code", "date", "bytes")
    )


def list_files(spark: SparkSession, root: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """One row per code that has exactly one file anywhere below ``root``; a single listing, no file is opened."""
    named = _listing(spark, [root], "*").select("path", F.regexp_extract("path", pattern, 1).alias("code"))
    return (
        named.filter(F.col("code") != "").groupBy("code")
        .agg(F.count(F.lit(1)).alias("_files"), F.min("path").alias("path"))
        .filter(F.col("_files") == 1)
        .drop("_files")
    )


def _listing(spark: SparkSession, folders: list[str], glob: str) -> DataFrame:
    """``path`` and ``length`` of the files at any depth below ``folders`` whose name fits ``glob``; none is opened.

    Tasks list the folders, level by level, so that no list of files is held by the driver: only the number of
    folders of a level reaches it. As with Spark's readers, names that begin with a dot or an underscore are
    hidden. In a store that tasks do not open themselves, Spark's own index in the driver lists.
    """
    folders = [_qualified(spark, f) for f in folders]
    if any(f.partition(":")[0] not in TASK_STORES for f in folders):
        reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        return reader.load(folders).select("path", "length")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, fs.FileSystem] = {}
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, place = _place(folder, stores)
                seen = [
                    (f"{folder}/{x.base_name}", x.size, x.type == fs.FileType.Directory)
                    for x in store.get_file_info(fs.FileSelector(place))
                    if not x.base_name.startswith(".") and ("=" in x.base_name or not x.base_name.startswith("_"))
                    and (x.type == fs.FileType.Directory or fnmatchcase(x.base_name, glob))
                ]
                for i in range(0, len(seen), ROWS_AT_ONCE):
                    columns = zip(*seen[i : i + ROWS_AT_ONCE])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()))], ["path", "length", "folder"])

    level, found = spark.createDataFrame([(f,) for f in folders], "path string"), None
    while True:
        here = cut_lineage(level.mapInArrow(entries, "path string, length long, folder boolean"))
        files = here.filter("NOT folder").select("path", "length")
        found = files if found is None else found.union(files)
        below = here.filter("folder").select("path")
        left = below.count()
        if not left:
            return found
        level = below.repartition(min(left, _tasks(spark)), "path")


def _tasks(spark: SparkSession) -> int:
    """Tasks that work on files is dealt over, since it is one of files and not of bytes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its store, which is Spark's default where it names none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _place(path: str, stores: dict[str, fs.FileSystem]) -> tuple[fs.FileSystem, str]:
    """The store of a listed path, one for each host, and the name there; characters stand for themselves."""
    scheme, _, rest = path.partition(":")
    host, name = ("", rest) if not rest.startswith("//") else (rest[2:].partition("/")[0], "/" + rest[2:].partition("/")[2])
    key = f"{scheme}://{host}/"
    if key not in stores:
        stores[key] = fs.FileSystem.from_uri(key)[0]
    return stores[key], name


def eligible_symbols(
    master: DataFrame, files: DataFrame, code: str = "issue_code", kind: str = "asset_type", wanted: str = "ST"
) -> DataFrame:
    """Selection ladder: stocks with a six-digit code that have a file."""
    ladder = master.filter((F.col(kind) == wanted) & F.col(code).rlike("^[0-9]{6}$"))
    return ladder.select(code).distinct().join(files.select(F.col("code").alias(code)), code, "left_semi")


def session_quotes(ticks: DataFrame, packed: str = "local_time", is_quote: Column | None = None) -> DataFrame:
    """Quote rows of the session, both bounds included."""
    quotes = is_quote if is_quote is not None else F.col("data_type") == QUOTE_ROW
    return ticks.filter(quotes & F.col(packed).between(SESSION_START, SESSION_END))


def session_trades(ticks: DataFrame, packed: str = "local_time", is_trade: Column | None = None) -> DataFrame:
    """Trade rows of the session, end excluded."""
    trades = is_trade if is_trade is not None else F.col("data_type") == TRADE_ROW
    return ticks.filter(trades & (F.col(packed) >= SESSION_START) & (F.col(packed) < SESSION_END))


def level_arrays(wide: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Fold the per-level columns into four arrays, best level first."""
    names = {"bid_px": "bid{}_price", "ask_px": "ask{}_price", "bid_qty": "bid{}_quantity", "ask_qty": "ask{}_quantity"}
    arrays = {
        out: F.array(*[F.col(form.format(i)) for i in range(1, levels + 1)]) for out, form in names.items()
    }
    spent = [form.format(i) for form in names.values() for i in range(1, levels + 1)]
    return wide.withColumns(arrays).drop(*spent)


def sequence_ticks(
    ticks: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], bucket_us: int = 60_000_000
) -> DataFrame:
    """Add the dense ``tick_seq`` of each row in its symbol-day by time, then by ``tie``."""
    return positions_by_piece(
        ticks, keys, bucket_of(F.col(time), bucket_us), [time, *tie], "tick_seq"
    )


def load_ticks(
    spark: SparkSession, files: str | DataFrame, pattern: str = FILE_PATTERN, levels: int = LEVELS
) -> DataFrame:
    """Rows of tick files with code, date and clock in microseconds, and ``file_row``, the place in the file.

    ``files`` is a manifest (rows of :func:`file_manifest`, filtered as wanted) or a root folder, of which every
    file below is read. Files that were filtered out are neither listed nor opened. The paths of up to
    ``INDEXED_FILES`` files go to Spark's reader, whose index keeps them in the driver; those of more stay
    with the tasks, which open the files themselves. An empty manifest gives no rows.
    """
    reader = spark.read.schema(raw_schema(levels))
    if isinstance(files, str):
        raw = reader.option("recursiveFileLookup", "true").parquet(files)
    else:
        staged = cut_lineage(files.select("path"))
        paths = [r.path for r in staged.limit(INDEXED_FILES + 1).collect()]
        if len(paths) > INDEXED_FILES:
            if paths[0].partition(":")[0] in TASK_STORES:
                return _opened_by_tasks(staged, pattern, levels)
            paths = [r.path for r in staged.toLocalIterator()]
        raw = reader.parquet(*map(_escaped, paths)) if paths else None
    if raw is None:
        nothing = spark.createDataFrame([], raw_schema(levels))
        return nothing.select("*", *[F.lit(None).cast(t).alias(n) for n, t in _ADDED.items()])
    path = F.col("_metadata.file_path")
    return raw.select(
        "*",
        F.regexp_extract(path, pattern, 1).alias("symbol"),
        F.regexp_extract(path, pattern, 2).alias("date"),
        packed_to_micros(F.col("local_time")).alias("t_us"),
        F.col("_metadata.row_index").alias("file_row"),
    )


def _opened_by_tasks(files: DataFrame, pattern: str, levels: int) -> DataFrame:
    """``load_ticks`` of any number of files (``path``), dealt over tasks that hold a batch of rows at a time."""
    spark, path = files.sparkSession, F.col("path")
    fields = raw_schema(levels).fields
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    kinds = [(f.name, arrow[f.dataType.simpleString()]) for f in fields]
    shape = pa.schema([*kinds, ("symbol", pa.string()), ("date", pa.string()), ("file_row", pa.int64())])
    dealt = files.select(
        path, F.regexp_extract(path, pattern, 1).alias("symbol"), F.regexp_extract(path, pattern, 2).alias("date")
    ).repartition(_tasks(spark), "path")

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    rows = dealt.mapInArrow(_file_rows(kinds, shape), f"{columns}, symbol string, date string, file_row long")
    return rows.select(*[f.name for f in fields], "symbol", "date", packed_to_micros(F.col("local_time")).alias("t_us"), "file_row")


def _file_rows(kinds: list[tuple[str, pa.DataType]], shape: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the files named in batches of path, symbol and date; columns that a file lacks are NULL, as with Spark's reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, fs.FileSystem] = {}
        held, n = [], 0
        for batch in batches:
            for path, symbol, date in zip(*[c.to_pylist() for c in batch.columns]):
                store, name = _place(path, stores)
                with store.open_input_file(name) as opened:
                    file, at = pq.ParquetFile(opened), 0
                    have = {c.lower(): c for c in file.schema_arrow.names}
                    wanted = [have[c.lower()] for c, _ in kinds if c.lower() in have]
                    for part in file.iter_batches(ROWS_AT_ONCE, columns=wanted, use_threads=False):
                        rows = part.num_rows
                        values = [part.column(have[c.lower()]).cast(t) if c.lower() in have else pa.nulls(rows, t) for c, t in kinds]
                        place = pa.array(range(at, at + rows), pa.int64())
                        held.append(pa.RecordBatch.from_arrays([*values, pa.repeat(symbol, rows), pa.repeat(date, rows), place], schema=shape))
                        at, n = at + rows, n + rows
                        if n >= ROWS_AT_ONCE:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


_ADDED = {"symbol": "string", "date": "string", "t_us": "bigint", "file_row": "bigint"}


def _escaped(path: str) -> str:
    """A listed path as a reader takes it: characters of glob patterns stand for themselves."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def write_tick_files(ticks: DataFrame, root: str, levels: int = LEVELS, order: Sequence[str] = ("local_time",)) -> DataFrame:
    """Write the raw layout, ``root/date/code_name_date.parquet``, and give its manifest.

    ``ticks`` has the raw columns, ``date``, ``code``, ``name`` and what ``order`` names; a file holds one symbol-day in that
    order.
    """
    wanted = [f.name for f in raw_schema(levels)]
    written = write_keyed_files(ticks, root, ["date", "code", "name"], "{date}/{code}_{name}_{date}.parquet", wanted, order)
    return written.select("path", "code", "date", "bytes")


def write_keyed_files(
    rows: DataFrame, root: str, keys: Sequence[str], place: str, columns: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """One file of ``columns`` for each value of ``keys`` (strings), at ``place`` below ``root``; gives ``path, *keys, bytes``.

    ``place`` names the keys in braces. Keys are dealt over a fixed number of tasks, since the work is one of files and not
    of bytes, and streamed, so a task holds one batch at a time. A file is written under a name of
    its own and moved at the end: a task that runs again replaces it by the same.
    """
    spark = rows.sparkSession
    wanted, keys = list(columns), list(keys)
    lean = rows.select(*dict.fromkeys([*keys, *wanted, *order]))
    dealt = lean.repartition(_tasks(spark), *keys).sortWithinPartitions(*keys, *order)
    target = root if "://" in root or root.startswith("file:") else f"file://{root}"
    record = pa.schema([("path", pa.string()), *[(k, pa.string()) for k in keys], ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(target)
        now, writer, part = None, None, ""
        made, done = set(), []

        def finish() -> None:
            writer.close()
            final = place.format(**dict(zip(keys, now)))
            store.move(part, f"{base}/{final}")
            done.append({"path": f"{target}/{final}", **dict(zip(keys, now)), "bytes": store.get_file_info(f"{base}/{final}").size})

        for batch in batches:
            values = list(zip(*[batch.column(c).to_pylist() for c in keys]))
            lean_batch = batch.select(wanted)
            begin = 0
            while begin < len(values):
                end = begin
                while end < len(values) and values[end] == values[begin]:
                    end += 1
                if values[begin] != now:
                    if writer is not None:
                        finish()
                    now = values[begin]
                    folder = f"{base}/{place.format(**dict(zip(keys, now)))}".rpartition("/")[0]
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    part = f"{folder}/_{uuid.uuid4().hex}.tmp"
                    writer = pq.ParquetWriter(part, lean_batch.schema, filesystem=store)
                writer.write_batch(lean_batch.slice(begin, end - begin))
                begin = end
            if done:
                yield pa.RecordBatch.from_pylist(done, record)
                done.clear()
        if writer is not None:
            finish()
            yield pa.RecordBatch.from_pylist(done, record)

    # The write is what runs the tasks; the manifest lies beside the folders, where no listing of them looks.
    written = f"{target}/_manifest-{uuid.uuid4().hex}"
    shape = ", ".join(["path string", *[f"{k} string" for k in keys], "bytes long"])
    dealt.mapInArrow(write, shape).write.parquet(written)
    return spark.read.parquet(written)


def quote_grid(
    ticks: DataFrame,
    keys: Sequence[str],
    seq: str,
    *,
    is_quote: Column,
    is_buy: Column,
    is_sell: Column,
    price: Column,
    volume: Column,
    carry: Sequence[str],
    attach: str = "next",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per quote with the trades between quotes accumulated on it.

    With ``attach='next'`` a trade belongs to the quote after it, with ``'prev'`` to the quote
    before it. Trades without such a quote are dropped. The trade side stays NULL (volume 0)
    where no trade was seen.
    """
    if attach not in ("next", "prev"):
        raise ValueError(f"attach must be 'next' or 'prev', got {attach!r}")
    counted = running_total(
        ticks.withColumn("_quote", is_quote), keys, seq, {"_quotes": F.col("_quote").cast("bigint")},
        chunk_rows=chunk_rows,
    )
    shift = 1 if attach == "next" else 0
    cell = F.when(F.col("_quote"), F.col("_quotes")).otherwise(F.col("_quotes") + shift)
    kept = F.when(F.col("_quote"), F.struct(*[F.col(c) for c in (seq, *carry)]))
    grid = counted.groupBy(*keys, cell.alias("_cell")).agg(
        F.max(kept).alias("_row"),
        F.coalesce(F.sum(F.when(is_buy, volume)), F.lit(0.0)).alias("buy_volume"),
        F.coalesce(F.sum(F.when(is_sell, volume)), F.lit(0.0)).alias("sell_volume"),
        F.max(F.when(is_buy, price)).alias("buy_max_price"),
        F.min(F.when(is_sell, price)).alias("sell_min_price"),
    )
    return grid.filter(F.col("_row").isNotNull()).select(
        *keys, "_row.*", "buy_volume", "sell_volume", "buy_max_price", "sell_min_price"
    )
