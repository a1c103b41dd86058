"""Many small files into few of good size, each record once.

The scan packs the small files into splits: the maximum bytes of a partition are set to the size an output file
should have and the cost of opening a file is set low, so that a task reads many files. Rows then
flow from scan to output without a shuffle, however many of them are repeated.

What must not come out is found beforehand in a narrow table of (number, fingerprint, place): of the rows that hold one
record, the first place is kept. Places are counted per file in words of 64 rows, and a word with rows to leave out is a
bit mask, so the scan drops them by a look into a small table. Files are taken in waves, so that the masks of a wave
are few enough to be sent to all executors, and each file is in one wave. Output is staged, verified against the input by
count and sum of fingerprints, and published by a rename, together with the list of files that held copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions.files import base_name, live_records, live_rows

TARGET_BYTES = 256 << 20  #: size of a split, and so about that of an output file
OPEN_COST = 64 << 10  #: bytes that opening a file counts as when splits are packed
WAVE_WORDS = 500_000  #: masks of a wave at most; in memory each takes about 64 bytes
WORD_BITS = 6

RECORD = ("series", "ts", "seq", "value", "tags")


class VerificationError(RuntimeError):
    """The staged output does not hold the records of the input."""


@contextmanager
def split_packing(spark: SparkSession, target_bytes: int, open_cost: int) -> Iterator[None]:
    """Settings of the scan for jobs that run inside the block; the former ones come back after it."""
    mine = {
        "spark.sql.files.maxPartitionBytes": str(target_bytes),
        "spark.sql.files.openCostInBytes": str(open_cost),
        "spark.sql.files.minPartitionNum": "1",
    }
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fingerprint() -> Column:
    """Two 64-bit hashes of a whole record. Maps are hashed in canonical order, NaN as one value."""
    value = F.when(F.isnan("value"), F.lit("NaN")).otherwise(F.col("value").cast("string"))
    parts = [F.coalesce(F.col("series"), F.lit("\0")), "ts", "seq", value, F.to_json(F.array_sort(F.map_entries("tags")))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))


@dataclass
class Compaction:
    """``records``: the published output, with the ``file`` each was taken from. ``copies``: ``seq, file`` of other files that held one."""

    records: DataFrame
    copies: DataFrame
    path: str
    files_in: int
    files_out: int
    rows_out: int

    @property
    def presence(self) -> DataFrame:
        """``seq, file``: every file that held a record of the output under that number."""
        return self.records.select("seq", "file").unionByName(self.copies)


def _totals(prints: DataFrame) -> tuple[int, int, int]:
    big = "decimal(38,0)"
    r = prints.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("print.a").cast(big)), F.lit(0)), F.coalesce(F.sum(F.col("print.b").cast(big)), F.lit(0))
    ).first()
    return int(r[0]), int(r[1]), int(r[2])


@dataclass
class _File:
    path: str
    rows: int
    bytes: int
    words: int = 0


def _files(source: DataFrame) -> tuple[dict[int, _File], int]:
    """The files with rows by the hash of their path, and the seed with which no two hashes are equal. Like any scan of them, this lists them in the driver."""
    rows = source.groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("bytes"))
    rows = storage.staged(rows, "files")
    seed = 0
    while True:
        files = {r["id"]: _File(unquote(r["file_path"]), r["n"], r["bytes"]) for r in rows.withColumn("id", F.xxhash64(F.lit(seed), "file_path")).toLocalIterator()}
        if len(files) == rows.count():
            return files, seed
        seed += 1


def _placed(source: DataFrame, seed: int) -> DataFrame:
    """Rows with the place they lie at: the hash of the path of their file and their number in it."""
    return source.withColumns({"phys": F.xxhash64(F.lit(seed), "_metadata.file_path"), "row": F.col("_metadata.row_index")})


def _masks(spark: SparkSession, files: dict[int, _File], kept: DataFrame) -> DataFrame:
    """``phys, word, mask`` of the words with rows that are not among the ``kept`` places (``phys, row``)."""
    sizes = spark.createDataFrame([(k, f.rows) for k, f in files.items()], "phys long, n long")
    word = F.shiftright("row", WORD_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row").bitwiseAND(63).cast("int"))
    kept = kept.groupBy("phys", word.alias("word")).agg(F.bit_or(bit).alias("keep"))
    words = sizes.select("phys", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, WORD_BITS))).alias("word"))
    here = F.least(F.lit(64), F.col("n") - F.shiftleft("word", WORD_BITS)).cast("int")
    full = F.when(here == 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), here) - 1)
    mask = full.bitwiseAND(F.bitwise_not(F.coalesce("keep", F.lit(0).cast("long"))))
    return words.join(kept, ["phys", "word"], "left").select("phys", "word", mask.alias("mask")).where("mask <> 0")


def _waves(files: dict[int, _File]) -> Iterator[list[tuple[int, int | None, int | None]]]:
    """Files (their hash, and a range of rows if one has too many masks by itself) of which the masks are few enough together."""
    wave, size = [], 0
    for k, f in sorted(files.items(), key=lambda x: x[1].path):
        parts = [(k, None, None)]
        if f.words > WAVE_WORDS:
            step = WAVE_WORDS << WORD_BITS
            parts = [(k, lo, min(lo + step, f.rows)) for lo in range(0, f.rows, step)]
        for part in parts:
            n = f.words if part[1] is None else min(f.words, WAVE_WORDS)
            if wave and (size + n > WAVE_WORDS or wave[-1][1] is not None or part[1] is not None):
                yield wave
                wave, size = [], 0
            wave.append(part)
            size += n
    if wave:
        yield wave


def compact(
    spark: SparkSession,
    rows_path: str,
    segments: DataFrame,
    out_path: str,
    target_bytes: int = TARGET_BYTES,
    open_cost: int = OPEN_COST,
) -> Compaction:
    """Write the records of the files that live manifest records name to ``out_path``, each record once.

    A record is a row as a whole: ``series, ts, seq, value, tags``. Two contents under one ``seq`` are two
    records and both are kept. Nulls equal nulls and NaN equals NaN. Rows without a file name belong to no live
    file. Files that no live record names are left out, spelling of paths aside. An empty input gives an empty
    output. Further columns of the input are not carried. ``out_path`` must not exist. On a failed verification
    ``VerificationError`` is raised and nothing is published; the input is never changed.
    """
    with split_packing(spark, target_bytes, open_cost), storage.scope():
        source = spark.read.parquet(rows_path)
        files, seed = _files(source)
        narrow = _placed(source, seed).select("file_name", "seq", fingerprint().alias("print"), "phys", "row")
        narrow = live_rows(narrow, segments, "seq", "print", "phys", "row")
        seen = storage.staged(narrow.groupBy("seq", "print", "file").agg(F.min(F.struct("phys", "row")).alias("place")), "seen")
        first = seen.groupBy("seq", "print").agg(F.min(F.struct("place", "file")).alias("kept"), F.count(F.lit(1)).alias("n_files"))
        first = storage.staged(first, "first")
        expected = _totals(first)
        masks = storage.staged(_masks(spark, files, first.select("kept.place.phys", "kept.place.row")), "masks")
        for r in masks.groupBy("phys").count().toLocalIterator():
            files[r["phys"]].words = r["count"]
        temporary = f"{out_path}.open"
        if storage.exists(spark, out_path):
            raise FileExistsError(f"{out_path} exists")
        storage.delete(spark, temporary)
        if not files:  # so that an empty result has a schema
            source.select(*RECORD, F.lit("").alias("file")).write.parquet(f"{temporary}/records")
        for wave in _waves(files):
            _write_wave(spark, source, seed, files, wave, masks, f"{temporary}/records", target_bytes)
        several = first.where("n_files > 1").select(F.col("print").alias("p"), F.col("seq").alias("q"), F.col("kept.file").alias("kept_file"))
        other = seen.join(several, (F.col("print") == F.col("p")) & F.col("seq").eqNullSafe(F.col("q"))).where("file <> kept_file")
        other.select("seq", "file").distinct().write.parquet(f"{temporary}/copies")
        got = _totals(spark.read.parquet(f"{temporary}/records").select("seq", fingerprint().alias("print")))
    if got != expected:
        storage.delete(spark, temporary)
        raise VerificationError(f"staged output has (rows, sums) {got}, the input {expected}")
    storage.rename(spark, temporary, out_path)
    count = lambda p: sum(1 for name, n, _ in _tree(spark, p) if name.endswith(".parquet"))
    records = f"{out_path}/records"
    return Compaction(spark.read.parquet(records), spark.read.parquet(f"{out_path}/copies"), out_path, count(rows_path), count(records), got[0])


def _write_wave(spark: SparkSession, source: DataFrame, seed: int, files: dict[int, _File], wave: list, masks: DataFrame, out: str, target_bytes: int) -> None:
    """Append the rows of a wave of files that no mask leaves out."""
    rows = _placed(spark.read.schema(source.schema).parquet(*[files[k].path for k, _, _ in wave]), seed)
    masked = [k for k, _, _ in wave if files[k].words]
    size = sum(files[k].bytes for k, _, _ in wave)
    lo, hi = wave[0][1:]
    if lo is not None:
        rows = rows.where((F.col("row") >= lo) & (F.col("row") < hi))
        masks = masks.where((F.col("word") >= lo >> WORD_BITS) & (F.col("word") < -(-hi >> WORD_BITS)))
        size = size * (hi - lo) // files[wave[0][0]].rows
    columns = [*RECORD, base_name(F.col("file_name")).alias("file")]
    rows = rows.select(*columns, "phys", "row")
    if masked:
        mine = masks.join(F.broadcast(spark.createDataFrame([(k,) for k in masked], "phys long")), "phys")
        bit = F.call_function("shiftrightunsigned", F.col("mask"), F.col("row").bitwiseAND(63).cast("int")).bitwiseAND(1)
        rows = rows.withColumn("word", F.shiftright("row", WORD_BITS)).join(F.broadcast(mine), ["phys", "word"], "left").where(F.col("mask").isNull() | (bit == 0))
    parts = max(1, -(-size // target_bytes))
    rows.select(*RECORD, "file").coalesce(parts).write.mode("append").option("compression", "zstd").parquet(out)


def _tree(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """The data files at or below a path."""
    fs, p = storage.hadoop_path(spark, path)
    it, out = fs.listFiles(p, True), []
    while it.hasNext():
        f = it.next()
        out.append((str(f.getPath().toString()), int(f.getLen()), False))
    return out


def overlapping_segments(seen: DataFrame, segments: DataFrame) -> DataFrame:
    """``segment_a, segment_b``: two live records whose files hold a common number, the smaller first.

    Numbers with the same set of files are taken together before pairs are made, so each set is paired once. Records that
    name the same file are a pair in any case. Rows without a number have none in common.
    """
    live = live_records(segments)
    sets = seen.where(F.col("seq").isNotNull()).groupBy("seq").agg(F.sort_array(F.collect_set("file")).alias("files"))
    sets = sets.where(F.size("files") > 1).select("files").distinct()
    pairs = sets.select("files", F.explode("files").alias("a")).select("a", F.explode(F.filter("files", lambda f: f > F.col("a"))).alias("b"))
    same = live.select(F.col("file").alias("a"), F.col("file").alias("b")).distinct()
    pairs = pairs.distinct().unionByName(same)
    a, b = live.toDF("x", "a"), live.toDF("y", "b")
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where("x <> y")
        .select(F.least("x", "y").alias("segment_a"), F.greatest("x", "y").alias("segment_b"))
        .distinct()
    )
