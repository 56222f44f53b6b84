"""What the text operators share: Arrow maps that keep columns, and tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows handed to a mapper at once, and bytes of text worked on at once (or one longer text); both bound what is alive in a worker.
ROWS_PER_CALL, BYTES_AT_ONCE = 512, 1 << 20

#: Characters of the longest key that a worker's map keeps.
LONG = 256

_KEPT: dict = {}


def kept(key: Hashable, make: Callable):
    """What make() returned for this key in this worker. A worker keeps the tables of one operator only: they outlive a task, and go when another
    operator, or another run of this one, asks."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drops the tables of earlier operators in this worker."""
    _KEPT.clear()
    trim()


def trim() -> None:
    """Gives free memory back to the machine: a worker that waits for its next task holds its tables only."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors must share. On one machine (tests, local masters) an unset one is set here;
    elsewhere it is an error, because each executor would write to a disk of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file:/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there and the rows survive lost executors.

    The files go when the driver's process ends.
    """
    return _written(df, name, None)[0]


def materialise_parts(df: DataFrame, name: str, by: str) -> tuple[DataFrame, str]:
    """The same in a folder for each value of the column by, so that remove() can drop f"{path}/{by}={value}" once nothing reads it any more; and the path."""
    return _written(df, name, by)


def _written(df: DataFrame, name: str, by: str | None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(schema).parquet(path), path


def sweep(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps that nothing refers to any more; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.range(1, numPartitions=1).count()  # the scheduler keeps its last job until the next
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that materialise() wrote."""
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the files are then the cluster's to sweep
        pass


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """df's columns whose names don't clash, in any case, with names."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Sequence]], fields: T.StructType, keep: Sequence[str] | None = None, needs: Sequence[str] | None = None) -> DataFrame:
    """One output row per input row: the kept columns, then the columns that make()'s function returns.

    make runs once a task, in the worker. keep: columns passed through, by default all that don't clash with fields (a clashing one is replaced).
    needs: columns the function reads.
    """
    names = [f.name for f in fields]
    keep = [c for c in (without(df, names) if keep is None else keep)]
    needs = list(needs or [])
    src = df.select(*[f"`{c}`" for c in dict.fromkeys([*keep, *needs])])
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_CALL):
                part = whole.slice(at, ROWS_PER_CALL)
                made = [x if isinstance(x, pa.Array) else pa.array(x, arrow_type(k.dataType)) for x, k in zip(f(part), fields)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + made, names=[*keep, *names])

    return src.mapInArrow(trimmed(run), schema)


def trimmed(run: Callable) -> Callable:
    """run as a task's function that gives free memory back at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def arrow_type(kind: T.DataType) -> pa.DataType:
    """Arrow's type of a Spark type used by these operators."""
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind])
    return simple[kind.simpleString()]


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's strings; null is the empty text."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have BYTES_AT_ONCE bytes together, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = ((size.cumsum() - size) // (most or BYTES_AT_ONCE)) if len(size) else size
    starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist()] if len(size) else []
    for a, b in zip(starts, [*starts[1:], len(size)]):
        yield batch.slice(a, b - a)


def words(batch: pa.RecordBatch, name: str, ascii_only: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of the rows' texts one after the other, and how many each row has; null is the empty text. ascii_only: A-Z alone have a
    lower case, and white space is 0x20 and 0x09 to 0x0D."""
    whole = pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")
    cut = pc.ascii_split_whitespace(pc.ascii_lower(whole)) if ascii_only else pc.utf8_split_whitespace(pc.utf8_lower(whole))
    flat, sizes = cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty word
    there = full.to_numpy(zero_copy_only=False)
    if not there.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[there], minlength=len(sizes))
        flat = flat.filter(full)
    return flat, sizes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier of 64 bits, bytes hashed at once, and the longest word that is hashed by its polynomial in it.
_R, _PIECE, _SHORT = 0xD6E8FEB86659FD93, 1 << 17, 96


def _powers(r: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.full(_PIECE + _SHORT - 1, r, np.uint64)]).cumprod(dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def hashes(values: pa.Array) -> np.ndarray:
    """64 bits for each of the strings, by their bytes alone: a polynomial of the bytes modulo 2**64, scrambled; longer words by xxhash."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    if not _POWERS:
        _POWERS.extend([_powers(_R), _powers(pow(_R, -1, 2**64))])
    power, inverse = _POWERS
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    ends = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + n + 1].astype(np.int64)
    size = np.diff(ends)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    out = np.empty(n, np.uint64)
    short = np.flatnonzero(size <= _SHORT)
    with np.errstate(over="ignore"):
        piece = (ends[short] - ends[0]) // _PIECE
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(short)] if len(short) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = short[a:b]
            first, last = int(ends[at[0]]), int(ends[at[-1] + 1])
            # a long word may stand between two short ones of a piece
            x = data[first:last].astype(np.uint64) + np.uint64(1)
            if len(x) > len(power):
                sums = np.array([int((x[s - first : e - first] * power[: e - s]).sum()) for s, e in zip(ends[at].tolist(), ends[at + 1].tolist())], np.uint64)
            else:
                total = np.concatenate([[np.uint64(0)], (x * power[: len(x)]).cumsum(dtype=np.uint64)])
                sums = (total[ends[at + 1] - first] - total[ends[at] - first]) * inverse[ends[at] - first]
            out[at] = mix(sums + size[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in np.flatnonzero(size > _SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[ends[k] : ends[k + 1]].tobytes())
    return out


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A hash for each word, each distinct one hashed once."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    known = flat.dictionary_encode()
    return hashes(known.dictionary)[known.indices.to_numpy(zero_copy_only=False)]


class Memo(dict):
    """A map from key to computed value that holds at most twice `limit` entries: when the young half is full it becomes the old one.

    Subclass it with missing().
    """

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.missing(key)
            if isinstance(key, (str, bytes)) and len(key) > LONG:
                return v
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v

    def missing(self, key):
        raise NotImplementedError
