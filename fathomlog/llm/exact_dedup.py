"""Exact deduplication by a log-structured merge index of text digests.

Rows enter ``DigestIndex`` in memtables. A flush groups a memtable by digest and writes it as a
run sorted by digest; a run that is probed has a filter: a bitmap of hashed digests, a row to
each ``bitmap_bucket_number``. A flush probes the runs that are there already:
digests that pass a run's filter are looked up in the run, and what is found, or occurs
twice in the memtable, is a hit. Two runs of a level are compacted into one of the next,
adding counts and keeping the smallest and largest identifiers. At the end the hits, and only
they, are looked up for their identifiers; their texts are compared byte for byte (grouped by
the text itself), so a digest collision can't join two texts.

Only digests travel for all rows; texts travel for hits alone, collapsed
map-side, so a text held by a third of all rows moves once per task. Everything
is DataFrame code.

Defined results: a null text equals the empty text; rows repeating both id and
text are one document and share ``kept``; a null id is kept only if its group has
no other; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlog.llm.common import BROADCAST_BYTES, broadcast_if_small, free_names, materialize, scratch_dir, scratch_scope

#: Runs in a level before it is merged into the next.
FANOUT = 2
#: Rows of a memtable, which is dealt over all executors; there are so many memtables at least that runs are compacted.
MEMTABLE_ROWS = 500_000_000
#: Bits of a run's filter per digest, and bytes of a row of it.
FILTER_BITS, FILTER_ROW = 16, 4160
#: Parts into which a hot digest is dealt when rows find their group by a shuffle.
SALTS = 16
#: Rows of a file of the index, at least: a table of few digests takes few tasks and files, however many parts shuffles have.
FILE_ROWS = 1 << 14


def _in_files(entries: DataFrame, rows: int) -> DataFrame:
    """``entries`` (about ``rows`` short rows) in parts of FILE_ROWS or more; never more parts than there are."""
    return entries.coalesce(max(1, rows // FILE_ROWS))


class DigestIndex:
    """Sorted runs of (digest, smallest id, largest id, rows), by level, each a (folder, rows it was made of, bits of its filter)."""

    def __init__(self, spark: SparkSession, id_type: str = "long"):
        self.spark, self.path, self.id_type = spark, scratch_dir(spark), id_type
        self.levels: list[list[tuple[str, int, int]]] = [[]]
        self.made = self.compactions = 0
        self.found: list[str] = []
        self.filtered: set[str] = set()

    @staticmethod
    def _merged(entries: DataFrame) -> DataFrame:
        return entries.groupBy("digest").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")
        )

    def _write(self, entries: DataFrame, size: int) -> tuple[str, int, int]:
        path = f"{self.path}/run-{self.made}"
        self.made += 1
        _in_files(self._merged(entries), size).sortWithinPartitions("digest").write.option("compression", "zstd").parquet(path)
        return path, size, 1 << max(15, (size * FILTER_BITS).bit_length())

    def _filter(self, run: tuple[str, int, int]) -> DataFrame:
        """The filter of a run, written when it is probed for the first time: the last run and those merged before never are."""
        path, size, bits = run
        if path not in self.filtered:
            bit = _bit(bits)
            marks = self._read([path]).groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("marks"))
            _in_files(marks, size).write.option("compression", "zstd").parquet(f"{path}-filter")
            self.filtered.add(path)
        return self.spark.read.schema("bucket long, marks binary").parquet(f"{path}-filter")

    def flush(self, rows: DataFrame, size: int) -> None:
        """Add a memtable of (digest, id) as a run of the first level, and note the hits that it brings. size: its rows, about."""
        older = [run for level in self.levels for run in level]
        run = self._write(rows.select("digest", F.col("id").alias("low"), F.col("id").alias("high"), F.lit(1).cast("long").alias("n")), size)
        fresh = self._read([run[0]])
        hits = fresh.where("n > 1").select("digest")
        for old in older:
            passed = self._passed(fresh.select("digest"), old)
            hits = hits.union(passed.join(self._read([old[0]]).select("digest"), "digest", "left_semi"))
        self.found.append(f"{self.path}/hits-{len(self.found)}")
        _in_files(hits, size).write.option("compression", "zstd").parquet(self.found[-1])
        self.levels[0].append(run)
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= FANOUT:
                self.compact(k)

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one run of the next."""
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = self._read([path for path, _, _ in self.levels[level]])
        self.levels[level + 1].append(self._write(merged, sum(size for _, size, _ in self.levels[level])))
        self.levels[level] = []
        self.compactions += 1

    def _passed(self, digests: DataFrame, run: tuple[str, int, int]) -> DataFrame:
        """Digests that a run may hold by its filter: broadcast as far as its size allows, else the digests come to its rows by their buckets."""
        bits = run[2]
        marks = self._filter(run)
        if (bits >> 15) * FILTER_ROW <= BROADCAST_BYTES:
            marks = F.broadcast(marks)
        place = F.bitmap_bit_position(_bit(bits))
        probed = digests.withColumn("bucket", F.bitmap_bucket_number(_bit(bits))).withColumn("place", place).join(marks, "bucket")
        byte = F.conv(F.hex(F.expr("substring(marks, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
        return probed.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))")) != 0).select("digest")

    def _read(self, runs: list[str]) -> DataFrame:
        schema = f"digest binary, low {self.id_type}, high {self.id_type}, n bigint"
        return self.spark.read.schema(schema).parquet(*runs)

    def hits(self) -> DataFrame:
        """(digest): those of more than one row."""
        return self.spark.read.schema("digest binary").parquet(*self.found).distinct()

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The entries of these digests, merged over the runs."""
        runs = [path for level in self.levels for path, _, _ in level]
        return self._merged(self._read(runs).join(digests, "digest", "left_semi"))


def _bit(bits: int) -> Column:
    """A digest's place in a filter, from 1."""
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest=digest_of, memtables: int | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) per row of ``df``.

    keep: ``max`` or ``min``, the id of each group of equal texts that stays.
    digest: a Column function; any one gives right results, as hits are compared byte for byte.
    memtables: flushes into which the input is dealt by its ids; by default one more than a level holds, or more for more rows.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    best = F.max("id") if keep == "max" else F.min("id")
    held = df.count()
    count = memtables or max(FANOUT + 1, -(-held // MEMTABLE_ROWS))
    dealt = materialize(docs.select("id", "digest", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(count)).alias("memtable")), "memtable")
    rows = dealt.select("id", "digest")
    index = DigestIndex(spark, df.schema[id_col].dataType.simpleString())
    for k in range(count):
        index.flush(dealt.where(F.col("memtable") == k), held // count)
    hits = materialize(_in_files(index.hits(), held))
    hit = hits.count()
    small = hit * 64 <= BROADCAST_BYTES
    seen = F.broadcast(hits) if small else hits
    entries = materialize(_in_files(index.lookup(seen), hit))
    found = docs.join(seen, "digest", "left_semi")
    # Byte verification: the group key is the text itself.
    texts = materialize(found.groupBy("digest", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size")))
    several = texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    collided = materialize(_in_files(several, hit))
    plain = entries.join(collided, "digest", "left_anti").select("digest", F.col("high" if keep == "max" else "low").alias("keep_id"), F.col("n").alias("group_size"))
    if collided.isEmpty():
        joined = _with_group(rows, plain, small)
    else:
        # Different texts under one digest: these few rows are matched by their texts too.
        odd = docs.join(collided, "digest", "left_semi").join(texts.join(collided, "digest", "left_semi"), ["digest", "text"]).select("id", "digest", "keep_id", "group_size")
        joined = _with_group(rows.join(collided, "digest", "left_anti"), plain, small).unionByName(odd)
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        "digest",
    )


def _with_group(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """Left join on the digest; beyond the broadcast bound, hot digests are dealt over SALTS parts."""
    if small:
        return rows.join(F.broadcast(groups), "digest", "left")
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(dealt, ["digest", "salt"], "left").drop("salt")


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``df`` with one row of each text, all columns as they were; of rows that repeat the kept id, too, any one stays."""
    id_, digest, kept = free_names(df, "__id", "__digest", "__kept")
    with scratch_scope(df.sparkSession) as held:
        groups = exact_groups(df, id_col=id_col, text_col=text_col, keep=keep).where("group_size > 1")
        marks = groups.groupBy(F.col(id_col).alias(id_), F.col("digest").alias(digest)).agg(F.first("kept").alias(kept), F.count("*").alias("__n"))
        marks = materialize(marks.where(~F.col(kept) | (F.col("__n") > 1)).drop("__n"))
        held.append(marks)
    own = digest_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def marked(some: DataFrame, how: str) -> DataFrame:
        return df.join(broadcast_if_small(some, 64), df[id_col].eqNullSafe(some[id_]) & (own == some[digest]), how)

    left, tied = marked(marks, "left_anti"), marks.where(F.col(kept))
    if tied.isEmpty():
        return left
    # Grouped map-side: a row that is repeated over and over moves once per task.
    once = marked(tied, "inner").dropDuplicates([id_, digest])
    return left.union(once.drop(*marks.columns))
