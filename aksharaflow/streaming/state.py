"""State kept per document or user, line by line: in batch as windows, in a stream as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.staging import shared_dir

#: Words from which on a share of known ones, and a gain by a trial repair, tell something about a document.
FEW_WORDS, GAIN_WORDS = 60, 40
STATE = StructType([StructField(c, LongType()) for c in ("words", "known", "gain", "decided")])
OUT = "doc bigint, line bigint, words bigint, known bigint, damaged boolean"


def damage_batch(lines: DataFrame, few: int = FEW_WORDS) -> DataFrame:
    """lines (doc, line, n_words, n_known, n_gain: unknown words that a trial repair makes known, fault: a mark that correct
    text never has) with running words and known, and damaged: true from the first line at which there is a fault, or few
    words of which less than half are known, or GAIN_WORDS of which a tenth gain, or a line that gains two words and
    three tenths of its own. A document's lines are ordered in one group."""
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.select("doc", "line", "n_words", "n_gain", "fault", F.sum("n_words").over(w).alias("words"), F.sum("n_known").over(w).alias("known"), F.sum("n_gain").over(w).alias("gain"))
    hit = F.col("fault") | (F.col("words") >= few) & (2 * F.col("known") < F.col("words")) | (F.col("words") >= GAIN_WORDS) & (10 * F.col("gain") >= F.col("words")) | (F.col("n_gain") >= 2) & (10 * F.col("n_gain") >= 3 * F.col("n_words"))
    return rows.select("doc", "line", "words", "known", F.coalesce(F.bool_or(hit).over(w), F.lit(False)).alias("damaged"))


def _step(state: tuple, batch: pd.DataFrame, few: int, key: int) -> tuple[tuple, pd.DataFrame]:
    """State and states behind each line of a batch, in order."""
    words, known, gain, decided = state
    out = []
    for r in batch.sort_values("line").itertuples():
        words, known, gain = words + int(r.n_words), known + int(r.n_known), gain + int(r.n_gain)
        hit = bool(r.fault) or words >= few and 2 * known < words or words >= GAIN_WORDS and 10 * gain >= words or r.n_gain >= 2 and 10 * r.n_gain >= 3 * r.n_words
        decided = int(bool(decided) or hit)
        out.append((key, int(r.line), words, known, bool(decided)))
    return (words, known, gain, decided), pd.DataFrame(out, columns=["doc", "line", "words", "known", "damaged"])


class DamageState(StatefulProcessor):
    """The same, in a stream: four numbers per document, whatever its length. A verdict stays once reached. Lines count in the
    order in which they arrive: a line that comes in a later batch than its followers is read behind them, so that words
    and known differ there from those of damage_batch, while their totals and a verdict by fault or by totals don't."""

    def __init__(self, few: int):
        self.few = few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("damage", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        for batch in rows:
            state, out = _step(tuple(state), batch, self.few, key[0])
            yield out
        self.state.update(state)

    def close(self) -> None:
        pass


def damage_stream(lines: DataFrame, few: int = FEW_WORDS) -> DataFrame:
    """A stream of lines to a stream of states (see damage_batch). Needs the RocksDB state store."""
    return lines.groupBy("doc").transformWithStateInPandas(statefulProcessor=DamageState(few), outputStructType=OUT, outputMode="Append", timeMode="None")


def grouped_state_stream(lines: DataFrame, few: int = FEW_WORDS) -> DataFrame:
    """The same with the older grouped-state API. Of a document that comes in several Arrow batches each is read in turn."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        now = state.get if state.exists else (0, 0, 0, 0)
        for batch in batches:
            now, out = _step(tuple(now), batch, few, key[0])
            yield out
        state.update(now)

    return lines.groupBy("doc").applyInPandasWithState(step, OUT, "words bigint, known bigint, gain bigint, decided bigint", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote, read from the shared folder."""
    spark: SparkSession = stream.sparkSession
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def breaker(rows: DataFrame, slow: float, off_seconds: int) -> DataFrame:
    """rows (user_id, ts, event_id, value) with skipped: whether a check was off, because a slow one ran at most off_seconds before.
    A skipped check isn't run, so it can't be slow.

    Users are dealt out and their rows sorted; a stream over them carries the time until which the user's checks are off, so that
    a user with any number of rows takes constant memory. Rows without a user are one user's."""
    from pyspark.sql.types import BooleanType

    schema = StructType([*rows.schema.fields, StructField("skipped", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, until = object(), pd.Timestamp.min
        for batch in batches:
            out = []
            for user, ts, value in zip(batch["user_id"], batch["ts"], batch["value"], strict=True):
                user = None if pd.isna(user) else user
                if user != at:
                    at, until = user, pd.Timestamp.min
                out.append(ts < until)
                if not out[-1] and value >= slow:
                    until = ts + pd.Timedelta(seconds=off_seconds)
            yield batch.assign(skipped=out)

    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, schema)
