"""Problem 3: how often every term occurs and in how many records, by recursive radix spilling.

1. Each row becomes its distinct terms with their counts, on the JVM: its words are sorted and told apart at their borders.
2. A task folds its rows' terms in DuckDB (term, occurrences, records), so a frequent term leaves it once per fold, and the
   folded rows go to the radix partition named by leading bits of the term's hash: one folder per partition below the shared
   folder, one writer (or a few) per folder, so files do not multiply with tasks.
3. Partitions whose files exceed ``max_bytes`` are split by further bits of the hash, as many as their size asks for, all of a
   level in one job, folding again, until all fit or the hash is used up.
4. Every final partition is read by one task and aggregated by DuckDB under ``MEMORY``, which spills to the shared folder; if
   that is no folder workers can open (an object store), partitions are split finer instead and nothing spills.

A row's own mark, the empty term, counts along: its records are the rows that hold any term.

Defined cases: NULL values and NULL names hold no terms; empty text holds none; a very long text is processed whole; repeated
rows count each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import estimated_bytes, materialize, partitions, workspace
from ..sources.tables import catalogued

#: A term: a longest run of letters and digits of any script.
TERM = r"([\p{L}\p{Nd}]+)"
#: Least and most bits of the hash that a level adds, and bits used at most.
BITS, MOST_BITS, ALL_BITS = 4, 12, 60
#: Bytes of files beyond which a partition is split.
MAX_BYTES = 64 << 20
#: Memory of DuckDB in a task.
MEMORY = "256MB"
#: Bytes of rows that a task folds together.
FOLD_BYTES = 32 << 20
#: Stands for the row itself; no term is empty.
ROW = ""

_SUMS = "SELECT att, term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM rows GROUP BY att, term"
_COUNTS = "att string, term string, occurrences long, records long"


def row_terms(eadv: DataFrame, catalog: DataFrame) -> DataFrame:
    """``att, term, occurrences`` of each row of a catalogued TEXT name, one row per distinct term of the row and ``ROW``."""
    rows = catalogued(eadv, catalog, ["att", "val"], ("TEXT",))
    words = F.sort_array(F.regexp_extract_all(F.lower(F.col("val")), F.lit(TERM), F.lit(1)))
    # rows without words go with the explode: a filter on them would be pushed below the join and cut every text twice
    first = F.expr("filter(sequence(0, greatest(size(ws), 1) - 1), i -> i < size(ws) AND (i = 0 OR ws[i] <> ws[i - 1]))")
    each = F.expr("transform(first, (i, k) -> struct(ws[i] AS term, CAST(coalesce(get(first, k + 1), size(ws)) - i AS bigint) AS occurrences))")
    terms = F.when(F.size("ws") > 0, F.concat(each, F.expr(f"array(struct('{ROW}' AS term, 1L AS occurrences))")))
    return rows.select("att", words.alias("ws")).withColumn("first", first).select("att", F.explode(terms).alias("t")).select("att", "t.term", "t.occurrences")


def _connection(spill: str | None):
    """DuckDB under ``MEMORY``; without a folder to spill to it spills nowhere."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
    con.execute(f"SET temp_directory = '{(spill or '').replace("'", "''")}'")
    return con


_SCHEMA = [("att", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by name and term, over about ``FOLD_BYTES`` of rows at a time."""
    con = _connection(None)
    held: list[pa.RecordBatch] = []

    def fold() -> Iterator[pa.RecordBatch]:
        con.register("rows", pa.Table.from_batches(held))
        out = con.sql(_SUMS).to_arrow_table()
        con.unregister("rows")
        yield from out.cast(pa.schema(_SCHEMA)).to_batches()

    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= FOLD_BYTES:
            yield from fold()
            held, size = [], 0
    if held:
        yield from fold()


def _spill(counts: DataFrame, path: str, depth: int, bits: int) -> None:
    """Folded rows in one folder for each value of the leading ``depth`` bits of the term's hash, the last ``bits`` of them new."""
    n = partitions(counts.sparkSession)
    folded = counts.mapInArrow(_fold, _COUNTS).withColumn("radix", F.shiftrightunsigned(F.xxhash64("att", "term"), 64 - depth))
    writers = F.pmod(F.hash("term"), F.lit(max(1, n >> bits)))
    folded.repartition(n, "radix", writers).write.partitionBy("radix").parquet(path)


def _sizes(spark: SparkSession, path: str) -> dict[int, int]:
    """Bytes of each partition of a level, from one listing of its files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out: dict[int, int] = {}
    while files.hasNext():
        f = files.next()
        folder = f.getPath().getParent().getName()
        if folder.startswith("radix="):
            out[int(folder[6:])] = out.get(int(folder[6:]), 0) + f.getLen()
    return out


def _bits(size: float, max_bytes: int) -> int:
    """Bits that cut ``size`` into parts of about half of ``max_bytes``."""
    return min(MOST_BITS, max(BITS, math.ceil(math.log2(max(1.0, 2 * size / max_bytes)))))


def _aggregate(spill: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import shutil
        import uuid

        own = os.path.join(spill, uuid.uuid4().hex) if spill else None
        if own:
            os.makedirs(own, exist_ok=True)
        con = _connection(own)
        try:
            schema = pa.schema(_SCHEMA)
            rows = pa.RecordBatchReader.from_batches(schema, (b.select(["att", "term", "occurrences", "records"]).cast(schema) for b in batches))
            con.register("rows", rows)
            for b in con.sql(_SUMS).to_arrow_reader(50_000):
                yield b.cast(schema)
        finally:
            con.close()
            if own:
                shutil.rmtree(own, ignore_errors=True)

    return run


def counts(eadv: DataFrame, catalog: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``att, term, occurrences, records`` of every term of every catalogued TEXT name, and of ``ROW``."""
    spark = eadv.sparkSession
    root = workspace(spark, "terms")
    folder = root.removeprefix("file://") if root.startswith(("file://", "/")) else None
    if folder is None:
        max_bytes = max(1, max_bytes // 4)
    rows = row_terms(eadv, catalog).withColumn("records", F.lit(1).cast("long"))
    # a text folds to far less than itself, so a sixteenth of the input's estimate is a guess on the safe side
    bits = _bits(estimated_bytes(eadv) / 16, max_bytes)
    parts, depth, level = [], 0, 0
    while True:
        depth += bits
        path = f"{root}/{level}"
        _spill(rows, path, depth, bits)
        sizes = _sizes(spark, path)
        split = [r for r, size in sizes.items() if size > max_bytes and depth + BITS <= ALL_BITS]
        table = spark.read.schema(f"{_COUNTS}, radix long").parquet(path) if sizes else None
        if final := len(sizes) - len(split):
            # a task for about each final partition
            placed = table.where(~F.col("radix").isin(split)).repartition(final, "radix").drop("radix")
            parts.append(placed.mapInArrow(_aggregate(f"{folder}/spill" if folder else None), _COUNTS))
        if not split:
            break
        bits = min(_bits(max(sizes[r] for r in split), max_bytes), ALL_BITS - depth)
        rows, level = table.where(F.col("radix").isin(split)).drop("radix"), level + 1
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], _COUNTS)


def marked(eadv: DataFrame, catalog: DataFrame, rare: int = 2, common: int = 4, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Terms with ``rare`` (at most ``rare`` records) and ``common`` (in more than one ``common``-th of the name's rows with terms)."""
    t = materialize(counts(eadv, catalog, max_bytes), "counts")
    rows = t.where(F.col("term") == ROW).select("att", F.col("records").alias("rows"))  # one row per catalogued name at most
    t = t.where(F.col("term") != ROW).join(F.broadcast(rows), "att")
    return t.select("att", "term", "occurrences", "records", (F.col("records") <= rare).alias("rare"), (F.col("records") * common > F.col("rows")).alias("common"))


def kinds(eadv: DataFrame, catalog: DataFrame) -> DataFrame:
    """``att, term, kind`` of rare and common terms; a term that is both has two rows."""
    kind = F.explode(F.array_compact(F.array(F.when(F.col("rare"), "rare"), F.when(F.col("common"), "common"))))
    return marked(eadv, catalog).select("att", "term", kind.alias("kind"))
