"""What the operators share: shared-folder tables, bounded groups, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where neither the setting nor a checkpoint folder exists (tests on one
    machine) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class _Written(threading.local):
    """Tables that a thread's queries wrote and nobody dropped: another thread's are not its to drop."""

    def __init__(self):
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)


_tables = _Written()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables in the shared folder that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(spark: SparkSession, before: int = 0) -> None:
    """Drops all tables that ``written`` made in this thread since there were ``before``."""
    drop(spark, _tables.paths[before:])
    del _tables.paths[before:]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace-tables/{uuid.uuid4().hex}"
    _tables.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Code points of text whose words are looked at together (a longer text is looked at alone).
SLICE = 1 << 20


def text_slices(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in turn, about ``SLICE`` code points at a time; null is empty."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= SLICE:
            yield held
            held, n = [], 0
    if held:
        yield held


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of each word, where each text's words begin and end, the distinct words): white-space words as ``str.split`` gives them."""
    split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
    coded = split.flatten().dictionary_encode()
    codes, known, at = coded.indices.to_numpy(), coded.dictionary.to_pylist(), split.offsets.to_numpy()
    if "" in known:  # white space at either end leaves an empty word
        there = codes != known.index("")
        at = np.concatenate([[0], np.cumsum(there)])[at]
        codes = codes[there]
    return codes, at, known


def release() -> None:
    """Gives freed memory back to the system, so that a worker at rest holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def free_name(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def per_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``fn`` on each group of ``keys``, many small groups to one Arrow batch.

    Cheaper than ``applyInPandas`` when groups are small. A group must be bounded by the
    caller (blocks), as it is held in one worker.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            if held:
                same = all(_same(held[-1][k].iloc[-1], batch[k].iloc[0]) for k in keys)
                if not same:
                    yield from one(pd.concat(held, ignore_index=True))
                    held = []
            starts = np.zeros(len(batch), dtype=bool)
            starts[0] = True
            for k in keys:
                v = batch[k].to_numpy()
                starts[1:] |= v[1:] != v[:-1]
            at = np.append(np.flatnonzero(starts), len(batch))
            if held and len(at) > 2:
                held.append(batch.iloc[: at[1]])
                yield from one(pd.concat(held, ignore_index=True))
                held, at = [], at[1:]
            out = [r for a, b in zip(at[:-2], at[1:-1], strict=True) if (r := fn(batch.iloc[a:b])) is not None and len(r)]
            if out:
                yield pd.concat(out, ignore_index=True)
            held.append(batch.iloc[at[-2] :])
        if held:
            yield from one(pd.concat(held, ignore_index=True))
        held.clear()
        release()

    def one(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        r = fn(group)
        if r is not None and len(r):
            yield r

    return dealt.mapInPandas(run, schema)


def _same(a, b) -> bool:
    return bool(a == b)


def block_pairs(df: DataFrame, block: str, blocks: str, left: str = "bi", right: str = "bj") -> DataFrame:
    """Each row once for every unordered pair of blocks that holds its block.

    A group of n rows in ``blocks`` blocks becomes a triangle of bounded block pairs
    in place of one group, so no task holds a whole hot group.
    """
    other = F.explode(F.sequence(F.lit(0).cast("int"), (F.col(blocks) - 1).cast("int")))
    return (
        df.withColumn("__o", other)
        .withColumn(left, F.least(F.col(block), F.col("__o")))
        .withColumn(right, F.greatest(F.col(block), F.col("__o")))
        .drop("__o")
    )


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (smallest index) of each of n nodes under the links a-b."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id reachable.

    Contraction on distributed tables: every node points to its smallest neighbour in a
    scrambled order, edges move to the pointed-at nodes, and what falls together is
    dropped. Under a random order the nodes shrink by a constant factor a round, also
    on long chains. Rounds are written to the shared folder; nothing reaches the driver
    but whether edges are left.
    """
    spark = edges.sparkSession
    e = written(
        edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        up = written(both.groupBy("u").agg(F.min(key("v")).alias("m")).select("u", F.least(F.col("m"), key("u"))["id"].alias("p")))
        maps.append(up)
        e = written(
            e.join(up.select("u", F.col("p").alias("pu")), "u")
            .join(up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
            .where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct()
        )
    if not maps:
        return spark.createDataFrame([], "id long, component long")
    at = maps[0].select(F.col("u").alias("id"), F.col("p").alias("at"))
    for m in maps[1:]:
        at = at.join(m.select(F.col("u").alias("at"), F.col("p").alias("nx")), "at", "left").select("id", F.coalesce("nx", "at").alias("at"))
    low = at.groupBy("at").agg(F.min("id").alias("component"))
    return at.join(low, "at").select("id", "component")
