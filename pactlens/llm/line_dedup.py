"""Line dedup with levelled sorted runs of line hashes.

Every batch of documents gives one sorted run: line key and the number of its documents. Keys that an earlier run already
shows to be frequent are merge-anti-joined away first. Two runs of one level are compacted into a run of the next
level, so a run is rewritten once for each doubling of the input. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.common import ascii_lower, remove, save, whole_text, work_folder

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
BLANK = " \t\n\x0b\f\r"


class LineRuns:
    """Runs of (key, n): sorted by key, each key once in a run; ``n`` counts documents."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS):
        self.spark, self.folder, self.min_docs = spark, folder, min_docs
        self.runs: list[tuple[int, str, DataFrame]] = []  # level, path, run
        self.written = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        self.written += 1
        path = f"{self.folder}/run{self.written}"
        self.runs.append((level, path, save(counts.sortWithinPartitions("key"), path)))

    def add(self, keys: DataFrame) -> None:
        """Add a batch: a column ``key`` with each line key once for every document that holds it."""
        counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        for _, _, run in self.runs:
            known = run.filter(F.col("n") >= self.min_docs).select("key")
            counts = counts.join(known.hint("merge"), "key", "left_anti")
        self._write(counts, 0)
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            self._compact()

    def _compact(self) -> None:
        (level, old, a), (_, new, b) = self.runs[-2], self.runs[-1]
        del self.runs[-2:]
        self._write(a.unionByName(b).groupBy("key").agg(F.sum("n").alias("n")), level + 1)
        remove(self.spark, old)
        remove(self.spark, new)

    def frequent(self) -> DataFrame:
        """Keys found in ``min_docs`` documents or more of all batches."""
        rows = self.runs[0][2]
        for _, _, run in self.runs[1:]:
            rows = rows.unionByName(run)
        totals = rows.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= self.min_docs)
        return save(totals.select("key"), f"{self.folder}/frequent{self.written}")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """128-bit hash of the stripped line with A to Z lower-cased; null below ``min_chars`` code points."""
    key = F.btrim(ascii_lower(line), F.lit(BLANK))
    return F.when(F.char_length(key) >= min_chars, F.md5(key))


def row_id(*columns: Column) -> Column:
    """Content address of a row. Repeated rows share it, and with it their result."""
    return F.md5(F.concat_ws("\x00", *[F.coalesce(c.cast("string"), F.lit("\x01")) for c in columns]))


def marked(docs: DataFrame, folder: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(_rid, flags) for every distinct row of (doc_id, text): flags has true for each line that goes."""
    spark = docs.sparkSession
    rid = row_id(F.col("doc_id"), F.col("text"))
    keys = F.transform(lines_of(whole_text()), lambda line: line_key(line, min_chars))
    rows = docs.select(rid.alias("_rid"), keys.alias("keys"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    rows = save(rows.select("batch", "_rid", "keys"), f"{folder}/lines")
    runs = LineRuns(spark, folder, min_docs)
    for b in range(batches):
        # A document counts once for a key, however often it repeats the line.
        own = rows.filter(F.col("batch") == b).select(F.explode(F.array_distinct("keys")).alias("key"))
        runs.add(own.filter("key IS NOT NULL"))
    lines = rows.select("_rid", F.posexplode("keys").alias("pos", "key"))
    # A frequent line fills one join key; the skew join splits it. Blank lines are spread by their row.
    known = runs.frequent().withColumnRenamed("key", "_known")
    spread = F.coalesce("key", F.concat(F.lit("-"), "_rid"))
    hits = lines.join(known, spread == F.col("_known"), "left")
    flag = F.struct("pos", F.col("_known").isNotNull().alias("drop"))
    flags = hits.groupBy("_rid").agg(F.array_sort(F.collect_set(flag)).alias("f"))
    return flags.select("_rid", F.transform("f", lambda x: x["drop"]).alias("flags"))


def kept_text(text: Column, flags: Column) -> Column:
    """The lines without a flag, joined by line feeds; array_join leaves nulls out."""
    return F.array_join(F.zip_with(lines_of(text), flags, lambda line, drop: F.when(~drop, line)), "\n")


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, folder: str | None = None
) -> DataFrame:
    """Drop every line whose key is found in ``min_docs`` documents or more, from all documents.

    Returns all columns of ``docs`` with the kept text as ``text``, inside the struct ``_doc`` with n_lines, n_dropped
    beside it. Every row is a document: repeated rows count each. A null or empty text is one empty line; empty lines
    have no key and stay. A null text stays null. A null doc_id is a value like any other. An empty table gives an
    empty result. Column names of ``docs`` cannot clash, as rows travel as structs.
    """
    folder = folder or work_folder(docs.sparkSession, "lines")
    flags = marked(docs.select("doc_id", "text"), folder, min_docs, min_chars, batches)
    packed = docs.select(row_id(F.col("doc_id"), F.col("text")).alias("_rid"), F.struct("*").alias("_doc"))
    text = F.when(F.col("_doc.text").isNotNull(), kept_text(F.col("_doc.text"), F.col("flags")))
    return packed.join(flags, "_rid").select(
        F.col("_doc").withField("text", text).alias("_doc"),
        F.size("flags").cast("long").alias("n_lines"),
        F.size(F.filter("flags", lambda f: f)).cast("long").alias("n_dropped"),
    )
