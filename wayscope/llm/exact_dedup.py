"""Exact dedup against a persistent index of digests.

The index is a folder: a table bucketed and sorted by digest, with one row per text. A batch is reduced to one row per digest (combined
before the shuffle, so a text that makes up a third of all rows sends a row per task), anti-joined with the index by sort-merge, and what is
new is appended. Texts are never shuffled, only digests. A table of documents is taken in by batches of falling ids, so that of equal texts
the one with the largest id is in the index first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import fresh, remove, workspace, written

# Only these letters are folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 64
BATCHES = 3  # that a table of documents is taken in by
COMPACT = 8  # appends after which buckets are rewritten as one sorted file each
HOT = 1000  # a digest with more than this part of a batch's rows is hot; so there are fewer than HOT of them
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def digest(text):
    """SHA-256 (32 bytes) of a text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER), "UTF-8"), 256))


class DigestIndex:
    """Digests of all texts taken in so far, each with the id that stays, in the folder path; made there at the first append, and found there by
    any later session. One writer at a time.

    An append has a number of its own, under which its counts and then its rows are written; it counts once a marker in commits names it. What a
    failed or lost append left behind is never read, and its number never used again, so an append may simply be done anew.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.version, self.appends, self.table = spark, path.rstrip("/"), buckets, 0, 0, None
        # rows-<version>-<buckets>; an unfinished version has no _SUCCESS
        names = [n.split("/")[-2].split("-") for n in self._files("rows-*/_SUCCESS")]
        seen = {int(n.rsplit("-", 1)[-1]) for n in self._files("counts-*")}
        self.committed = {int(i) for n in self._files("commits/*") for i in n.rsplit("/", 1)[-1].split("-")}
        self.pending: set[int] = set()  # written by this session, and seen by it, but not committed yet
        self.failed = seen - self.committed
        self.appends = max(seen, default=-1) + 1
        if names:
            _, version, buckets = max(names, key=lambda x: int(x[1]))
            self.version, self.buckets = int(version), int(buckets)
            self._open(create=True)

    def _files(self, pattern: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        return [str(f.getPath()) for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or ()]

    @property
    def _rows(self) -> str:
        return f"{self.path}/rows-{self.version}-{self.buckets}"

    def _open(self, create: bool = False) -> None:
        self.table = f"digests_{uuid.uuid4().hex}"
        if create:
            clustered = f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id {self._kind()}, batch BIGINT) USING parquet {clustered} LOCATION '{self._rows}'")

    def _kind(self) -> str:
        return self.spark.read.parquet(self._rows).schema["keep_id"].dataType.simpleString()

    def rows(self) -> DataFrame:
        """digest, keep_id and batch (the number of the append that brought it); after one append at least."""
        every = self.spark.table(self.table)
        return every.where(~F.col("batch").isin(*sorted(self.failed))) if self.failed else every

    def counts(self) -> DataFrame:
        """digest and group_size: the rows taken in with that text."""
        paths = [f"{self.path}/counts-{i}" for i in sorted(self.committed | self.pending)]
        return self.spark.read.parquet(*paths).groupBy("digest").agg(F.sum("n").alias("group_size"))

    def lacking(self, groups: DataFrame) -> DataFrame:
        """The groups (digest, ...) that the index lacks, by a sort-merge anti-join; the index is neither exchanged nor, once compact, sorted."""
        dealt = groups.repartition(self.buckets, "digest")
        return dealt if self.table is None else dealt.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, commit: bool = True) -> int:
        """groups (digest, keep_id, n), one per digest of a batch: those that the index lacks are appended. The number of this append. Without commit
        it is seen by this object alone until commit() makes it and others count together, or abort() takes them back."""
        batch, new_table = self.appends, self.table is None
        self.appends += 1
        before = self.spark.conf.get(_ORDERED, "false")
        self.spark.conf.set(_ORDERED, "true")
        try:
            own = groups.select("digest", F.col("n").cast("long").alias("n"))
            own.write.mode("overwrite").parquet(f"{self.path}/counts-{batch}")
            new = self.lacking(groups).select("digest", "keep_id", F.lit(batch).cast("long").alias("batch"))
            if new_table:
                self._open()
            self._write(new, "append")
        except BaseException:
            self.failed.add(batch)
            if new_table:
                self.close()
                remove(self.spark, self._rows)
            raise
        finally:
            self.spark.conf.set(_ORDERED, before)
        self.pending.add(batch)
        if commit:
            self.commit()
        if self.appends % COMPACT == 0:
            self.compact()
        return batch

    def commit(self) -> None:
        """All pending appends count from here on, by one file that is made at once."""
        if self.pending:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{'-'.join(map(str, sorted(self.pending)))}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at).close()
            self.committed |= self.pending
            self.pending = set()

    def abort(self) -> None:
        """Pending appends never count."""
        self.failed |= self.pending
        self.pending = set()

    def _write(self, rows: DataFrame, mode: str) -> None:
        # Rows are in their bucket's partition already: each bucket gets one file a write.
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self._rows).mode(mode).saveAsTable(self.table)

    def compact(self) -> None:
        """Rewrite each bucket as one sorted file, in a new version of the table; readers of the old one must have ended."""
        rows, old, old_table = self.rows().repartition(self.buckets, "digest"), self._rows, self.table
        self.version += 1
        self._open()
        self._write(rows, "overwrite")
        self.spark.sql(f"DROP TABLE {old_table}")
        remove(self.spark, old)

    def close(self) -> None:
        """Forget the session's table; the folder stays."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            self.table = None

    def drop(self) -> None:
        self.close()
        remove(self.spark, self.path)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col).cast("string")).alias("digest"))


def _falling(own: DataFrame, batches: int) -> list[DataFrame]:
    """own by ranges of ids, largest first; null ids are the smallest. Ids that aren't numbers come in one batch."""
    if batches < 2 or not isinstance(own.schema["doc_id"].dataType, T.NumericType):
        return [own]
    cuts = own.agg(F.percentile_approx("doc_id", [1 - (i + 1) / batches for i in range(batches - 1)], 1000)).first()[0] or []
    edges = [None, *dict.fromkeys(cuts), None]
    out = []
    for high, low in zip(edges[:-1], edges[1:], strict=True):
        part = own if low is None else own.where(F.col("doc_id") > low)
        below = F.lit(True) if high is None else F.col("doc_id").isNull() | (F.col("doc_id") <= high)
        out.append(part.where(below))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row.

    Equal: identical after lower-casing A-Z; null counts as empty. Of equal rows the one with the largest id stays, unless the index has the
    text from an earlier call already; then none does. group_size counts all rows with that text that the index has taken in. Of rows that also
    share the id, one stays. A null id is smaller than any other. An empty table gives no rows; other columns play no part.

    index: takes the rows in, all or, if the call fails, none; by default one that is made for this call and dropped after it.
    """
    spark = docs.sparkSession
    own = written(digests(docs, id_col, text_col), "digests")  # the one pass over texts
    work = workspace(spark, "index")
    into = index or DigestIndex(spark, work, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    first = into.appends
    try:
        for part in _falling(own, batches):
            into.append(part.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), commit=False)
    except BaseException:
        into.abort()
        raise
    into.commit()
    rows, counts = into.rows(), into.counts()
    if index is not None:  # of an index that holds more than this table, only what the table has
        mine = own.select("digest").distinct()
        rows, counts = rows.join(mine, "digest", "left_semi"), counts.join(mine, "digest", "left_semi")
    known = written(rows.join(counts, "digest").withColumn("_new", F.col("batch") >= first).drop("batch"), "known")
    if index is None:
        into.drop()
    # Rows of hot digests stay where they are and meet a broadcast table of fewer than HOT rows; the others are joined by digest.
    many = own.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(max(1, own.count()) / HOT))
    hot = F.broadcast(written(many.select("digest"), "hot"))
    met = own.join(F.broadcast(known.join(hot, "digest")), "digest").unionByName(own.join(hot, "digest", "left_anti").join(known, "digest"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("_new")
    # Of rows that share the id too, one is kept: rows that stay are few per digest, so only they are numbered.
    stay = met.where(stays).groupBy("doc_id", "digest", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    out = stay.select("doc_id", "keep_id", "group_size", (F.col("i") == 1).alias("kept"), "digest")
    out = out.unionByName(met.where(~stays).select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they were, whatever their names; the rules are those of dedup()."""
    out = dedup(docs, id_col, text_col)
    name = fresh("gone", docs)
    # The ids that go are hashed, so that whole texts are dealt out by id but not sorted.
    gone = out.groupBy("doc_id").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k"))
    unique = gone.where("not any").select(F.col("doc_id").alias(name))
    left = docs.join(unique.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
    if not gone.where("any and n > k").isEmpty():  # ids that aren't unique: choose among their rows by the text too
        own = fresh("digest", left)
        left = left.withColumn(own, digest(F.col(text_col).cast("string")))
        key, same = fresh("id", left), fresh("same", left)
        stay = out.where("kept").select(F.col("doc_id").alias(key), F.unhex("text_sha256").alias(same))
        left = left.join(stay, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(same)), "left_semi").dropDuplicates([id_col, own]).drop(own)
    return left
