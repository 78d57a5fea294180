"""Documents in streams: results that replace each other, patterns learned once per document, contexts that expire."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import learning, lexicon, swaps

#: Converted words of a line that set a context, and seconds after which it expires.
SETS, LASTS = 2, 300


# -- results that replace each other


def publish(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes a micro-batch of results below path, for foreachBatch: a batch that is run again replaces what it had written."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Of the published results (schema, with doc_id, full and version among the columns), the rows of each document that count: of a
    full result rather than of a quick one, and of the newest version of these. A result may have many rows; a row that an
    older or partial result had isn't shown beside a newer one."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path).drop("batch")
    best = rows.groupBy("doc_id").agg(F.max(F.struct("full", "version")).alias("b"))
    return rows.join(best.select("doc_id", F.col("b.full").alias("full"), F.col("b.version").alias("version")), ["doc_id", "full", "version"])


# -- patterns learned once per document


@dataclass(frozen=True)
class LearnOnce:
    """For foreachBatch over lines (doc_id, item, text, damaged): the first batch after which a document is damaged learns what it stores
    for what, from all of its lines so far, and later lines are read by that. Below root: lines, swaps and fixed, a folder for
    each batch, which a repeated batch replaces. A document that learned nothing isn't tried again."""

    root: str
    lexicon: DataFrame
    targets: tuple[str, ...]
    least: int = 5
    word: str = r"\p{L}+"

    SWAPS = "doc_id long, rank int, src string, dst string, n long"
    LINES = "doc_id long, item long, text string, damaged boolean"

    def _table(self, spark: SparkSession, name: str, schema: str, before: int) -> DataFrame:
        """What batches before this one have written."""
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}").where(F.col("batch") < before).drop("batch")

    def _words(self, lines: DataFrame) -> DataFrame:
        return lines.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(self.word), 0)).alias("word")).distinct()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")
        put(batch.select("doc_id", "item", "text", "damaged"), "lines")
        lines = spark.read.schema(self.LINES).parquet(f"{self.root}/lines/batch={batch_id}")
        every = self._table(spark, "lines", self.LINES, batch_id + 1)
        known = self._table(spark, "swaps", self.SWAPS, batch_id)
        new = every.groupBy("doc_id").agg(F.bool_or("damaged").alias("d")).where("d").select("doc_id").join(known.select("doc_id").distinct(), "doc_id", "left_anti")
        words = self._words(every.join(new, "doc_id", "left_semi"))
        learned = learning.document_swaps(words, self.lexicon, list(self.targets), least=self.least)
        none = new.join(learned.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("rank"), F.lit("").alias("src"), F.lit("").alias("dst"), F.lit(0).cast("long").alias("n"))
        put(learned.select("doc_id", "rank", "src", "dst", "n").unionByName(none), "swaps")
        put(self.read(lines, self._table(spark, "swaps", self.SWAPS, batch_id + 1)), "fixed")

    def read(self, lines: DataFrame, learned: DataFrame) -> DataFrame:
        """lines (doc_id, item, text) with fixed: unknown words as the one known word that their document's swaps make of them."""
        unknown = lexicon.known(self._words(lines), self.lexicon).where(~F.col("known")).select("doc_id", "word")
        found = swaps.only_readings(unknown, learned.where("rank > 0"), self.lexicon)
        pieces = lines.select("doc_id", "item", F.posexplode(F.regexp_extract_all("text", F.lit(f"{self.word}|[^\\p{{L}}]+"), 0)).alias("pos", "piece"))
        pieces = pieces.withColumn("word", F.lower("piece")).join(found, ["doc_id", "word"], "left")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fixed", "piece").alias("p")))), lambda x: x["p"]), "")
        read = pieces.groupBy("doc_id", "item").agg(text.alias("fixed"))
        return lines.select("doc_id", "item", "text").join(read, ["doc_id", "item"], "left").withColumn("fixed", F.coalesce("fixed", "text"))


# -- contexts that expire

CONTEXT = StructType([StructField("encoding", StringType()), StructField("until", LongType())])
CONTEXT_OUT = "user bigint, item bigint, context string"


def context_batch(lines: DataFrame, sets: int = SETS, lasts: int = LASTS) -> DataFrame:
    """user, item, context of lines (user, item, ts, encoding, converted): the encoding of the last line before, at most `lasts` seconds
    ago, of which `sets` words or more were converted. Of lines of one time the smaller item comes first."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user").orderBy("at", "item").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("converted") >= sets, F.struct("at", "encoding")), ignorenulls=True).over(w)
    rows = lines.withColumn("at", at).withColumn("last", last)
    return rows.select("user", "item", F.when(F.col("at") - F.col("last.at") <= lasts * 1_000_000, F.col("last.encoding")).alias("context"))


class ContextState(StatefulProcessor):
    """The same in a stream, over event time: one encoding and one time per user. A timer takes the state of a user away once the
    watermark has passed its end, so that users who don't come back cost nothing."""

    def __init__(self, sets: int = SETS, lasts: int = LASTS):
        self.sets, self.lasts = sets, lasts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("context", CONTEXT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        encoding, until = self.state.get() if self.state.exists() else (None, -1)
        before = until
        for batch in rows:
            out = []
            batch = batch.assign(at=batch["ts"].astype("datetime64[us]").astype("int64")).sort_values(["at", "item"])
            for r in batch.itertuples():
                out.append((key[0], r.item, encoding if r.at <= until else None))
                if r.converted >= self.sets:
                    encoding, until = r.encoding, r.at + self.lasts * 1_000_000
            yield pd.DataFrame(out, columns=["user", "item", "context"])
        if until != before:
            if before >= 0:
                self.handle.deleteTimer(before // 1000 + 1)
            self.state.update((encoding, until))
            self.handle.registerTimer(until // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def context_stream(lines: DataFrame, delay: str = "10 minutes", sets: int = SETS, lasts: int = LASTS) -> DataFrame:
    """A stream of lines (see context_batch; ts a timestamp) to a stream of contexts. Lines count in the order in which batches bring
    them; those later than `delay` are dropped by the watermark. Needs the RocksDB state store."""
    marked = lines.withWatermark("ts", delay)
    return marked.groupBy("user").transformWithStateInPandas(statefulProcessor=ContextState(sets, lasts), outputStructType=CONTEXT_OUT, outputMode="Append", timeMode="EventTime")
