"""Corpus steps over shards as they arrive.

Every stream has a checkpoint that its caller names, or that stands beside its
output; starting a stream again on the same checkpoint goes on where it stopped, and
each row is found in the output once.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.holdout import take_split
from millrace.functions.text import CleanRules, clean
from millrace.operators import mixture
from millrace.operators.blocks import pack_blocks
from millrace.operators.budget import cut_to_budget
from millrace.operators.ordering import global_rank, seeded_key
from millrace.plans.prefix import joined_back, running_sum
from millrace.plans.scratch import materialize
from millrace.sources.sinks import list_folder, read_text, write_text


def arriving(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """New files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def beside(out: str) -> str:
    """The checkpoint of an output that has none of its own name."""
    return out.rstrip("/") + "-checkpoint"


def clean_split_stream(rows: DataFrame, out: str, rules: CleanRules = CleanRules(), split: str = "train", mod: int = 100, checkpoint: str | None = None) -> StreamingQuery:
    """Cleans and splits without state and appends Parquet."""
    chosen = take_split(clean(rows, rules), split, mod)
    return chosen.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or beside(out)).outputMode("append").trigger(availableNow=True).start()


class _Batches:
    """A stream whose batches are written by hand: one folder a batch, with overwrite, so a repeated batch counts once.

    What must outlive a restart is a small JSON file per batch beside the checkpoint.
    """

    def __init__(self, rows: DataFrame, out: str, checkpoint: str | None):
        self.spark, self.out, self.checkpoint = rows.sparkSession, out.rstrip("/"), checkpoint or beside(out)
        self.query = rows.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.checkpoint}/stream").trigger(availableNow=True).start()

    def _batch(self, batch: DataFrame, number: int) -> None:
        raise NotImplementedError

    def _known(self) -> list[int]:
        return [int(n.split(".")[0]) for n in list_folder(self.spark, f"{self.checkpoint}/state") if n.endswith(".json") and not n.startswith(".")]

    def _last(self) -> int | None:
        """The last batch that there is a state of."""
        return max(self._known(), default=None)

    def _before(self, number: int, empty: dict) -> dict:
        """State after the last batch before this one."""
        earlier = [n for n in self._known() if n < number]
        return json.loads(read_text(self.spark, f"{self.checkpoint}/state/{max(earlier):09d}.json")) if earlier else empty

    def _after(self, number: int, state: dict) -> None:
        write_text(self.spark, f"{self.checkpoint}/state/{number:09d}.json", json.dumps(state))

    def wait(self) -> None:
        self.query.awaitTermination()


class BudgetReached(Exception):
    """Ends a stream before a batch that no budget is left for; the batch stays to be read."""


class BudgetStream(_Batches):
    """Appends batches in order until ``max_bytes`` are written; the crossing batch is cut after the crossing row.

    The bytes written so far are kept beside the checkpoint, so a restart counts on; so is
    the whole crossing batch.  At the budget the stream stops: later files are not read.  A
    restart with a larger budget first cuts the crossing batch anew and goes on behind it.
    """

    def __init__(self, rows: DataFrame, out: str, max_bytes: int, order_by: str, checkpoint: str | None = None):
        self.max_bytes, self.order_by, self.reached = max_bytes, order_by, False
        self.spark, self.out, self.checkpoint = rows.sparkSession, out.rstrip("/"), checkpoint or beside(out)
        known = self._last()
        if known is not None:
            state = self._before(known + 1, {})
            if "crossing" in state and state["bytes"] < max_bytes:
                self._cut(self.spark.read.parquet(f"{self.checkpoint}/crossing"), known, state["before"])
        super().__init__(rows, out, checkpoint)

    def _cut(self, sized: DataFrame, number: int, written: int) -> None:
        path = f"{self.out}/batch={number}"
        cut_to_budget(sized, [self.order_by], {"n_bytes": self.max_bytes - written}).write.mode("overwrite").parquet(path)
        more = self.spark.read.schema(sized.schema).parquet(path).agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        self._after(number, {"bytes": written + more, **({"crossing": number, "before": written} if written + more >= self.max_bytes else {})})

    def _batch(self, batch: DataFrame, number: int) -> None:
        written = self._before(number, {"bytes": 0})["bytes"]
        if written >= self.max_bytes:
            self.reached = True
            raise BudgetReached(f"{written} bytes are written")
        sized = batch.withColumn("n_bytes", F.octet_length("text").cast("long"))
        whole = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        if written + whole >= self.max_bytes:
            sized.write.mode("overwrite").parquet(f"{self.checkpoint}/crossing")
        self._cut(sized, number, written)

    def wait(self) -> None:
        """Until all files are read or the budget is reached."""
        try:
            self.query.awaitTermination()
        except StreamingQueryException:
            if not self.reached:
                raise


class ShuffleStream(_Batches):
    """Shuffles inside each batch by a seeded hash of a key, and writes it in that order."""

    def __init__(self, rows: DataFrame, out: str, seed: int, key: str, checkpoint: str | None = None):
        self.seed, self.key = seed, key
        super().__init__(rows, out, checkpoint)

    def _batch(self, batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("shuffle_key", seeded_key(self.seed + number, self.key))
        keyed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key").write.mode("overwrite").parquet(f"{self.out}/batch={number}")


class BlockStream(_Batches):
    """Packs arriving token arrays to blocks of fixed length, in order of (batch, ``order_by``).

    The tokens after the last whole block, fewer than a block, are kept beside the
    checkpoint together with the next block's number: after a restart the stream
    goes on at that very token.
    """

    def __init__(self, rows: DataFrame, out: str, block: int, order_by: str, tokens: str = "tokens", checkpoint: str | None = None):
        self.block, self.order_by, self.tokens = block, order_by, tokens
        super().__init__(rows, out, checkpoint)

    def _batch(self, batch: DataFrame, number: int) -> None:
        state = self._before(number, {"next": 0, "left": []})
        key = lambda turn, value: F.struct(F.lit(turn).alias("turn"), value.alias("at")).alias("ord")
        rows = batch.select(key(1, F.col(self.order_by)), F.col(self.tokens).cast("array<int>").alias("tokens"))
        if state["left"]:
            kind = batch.schema[self.order_by].dataType
            first = self.spark.createDataFrame([(state["left"],)], "tokens array<int>")
            rows = rows.unionByName(first.select(key(0, F.lit(None).cast(kind)), "tokens"))
        path = f"{self.out}/batch={number}"
        packed = pack_blocks(rows, self.block, whole=False).withColumn("block_id", F.col("block_id") + state["next"])
        packed.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(packed.schema).parquet(path)
        last = written.where(F.size("tokens") < self.block).select("tokens").first()  # one short block at most
        blocks = written.where(F.size("tokens") == self.block).count()
        self._after(number, {"next": state["next"] + blocks, "left": last.tokens if last else []})

    def blocks(self) -> DataFrame:
        """block_id and tokens of all whole blocks so far."""
        return self.spark.read.parquet(self.out).where(F.size("tokens") == self.block).select("block_id", "tokens")


class MixtureStream(_Batches):
    """Mixes arriving documents of weighted sources into the order of ``mixture.stride``, whatever batches they come in.

    Of each source the stream keeps what it has sent, so a document's virtual time is that
    of the whole table.  A document is let out once no source can still send an earlier one;
    the others wait in a table beside the checkpoint.  What waits is what the sources ahead
    have sent beyond the virtual time of the one that is furthest behind.  Documents of a
    source come in its order, batch after batch; ``finish`` lets out all that wait when no
    more will come.  Rows of sources without weight go.  Positions go on after a restart.
    """

    def __init__(self, rows: DataFrame, out: str, weights: Mapping[str, float], source: str, order_by: str, unit: str = "chars", checkpoint: str | None = None):
        self.weights = {k: v for k, v in weights.items() if v > 0}
        mixture.normalised(self.weights)
        self.source, self.order_by, self.unit = source, order_by, unit
        super().__init__(rows, out, checkpoint)

    def _batch(self, batch: DataFrame, number: int) -> None:
        state = self._before(number, {"sent": {}, "pos": 0, "held": None})
        if state.get("finished"):
            raise ValueError("the mixture is finished: no source may send more")
        own = materialize(mixture.with_length(batch.where(F.col(self.source).isin(*self.weights)), self.unit), "mixture-batch")
        keys = [self.source, self.order_by]
        here = running_sum(own.select(*keys, "len"), "len", [self.order_by], [self.source], "sent_before")
        earlier = mixture.weight_of({s: float(state["sent"].get(s, 0)) for s in self.weights}, F.col(self.source)).cast("long")
        time = (F.col("sent_before") + earlier).cast("double") / mixture.weight_of(self.weights, F.col(self.source))
        timed = joined_back(own, here.select(*keys, "len", time.alias("vt")), keys)
        more = {r[0]: r[1] for r in own.groupBy(self.source).agg(F.sum("len")).collect()}  # a row a source that has a weight
        sent = {s: state["sent"].get(s, 0) + (more.get(s) or 0) for s in self.weights}
        waiting = timed if state["held"] is None else timed.unionByName(self.spark.read.schema(timed.schema).parquet(state["held"]))
        ready = F.lit(False)
        for s in self.weights:
            behind = min(((sent[u] / self.weights[u], u) for u in self.weights if u != s), default=None)
            early = F.lit(True) if behind is None else (F.col("vt") < behind[0]) | ((F.col("vt") == behind[0]) & F.lit(s < behind[1]))
            ready = ready | ((F.col(self.source) == s) & early)
        held = f"{self.checkpoint}/held/{number:09d}"
        waiting.where(~ready).write.mode("overwrite").parquet(held)
        pos = self._let_out(waiting.where(ready), number, state["pos"])
        self._after(number, {"sent": sent, "pos": pos, "held": held})

    def _let_out(self, rows: DataFrame, number: int, first: int) -> int:
        keys = ["vt", self.source, self.order_by]
        placed = joined_back(rows, global_rank(rows.select(*keys), keys, "place"), keys)
        placed = placed.withColumn("pos", F.col("place") + first).drop("place", "len")
        path = f"{self.out}/batch={number}"
        placed.write.mode("overwrite").parquet(path)
        return first + self.spark.read.schema(placed.schema).parquet(path).count()

    def finish(self) -> None:
        """Lets out all documents that wait; no source may send more."""
        last = self._last()
        state = self._before(last + 1, {}) if last is not None else {}
        if state.get("held") and not state.get("finished"):
            pos = self._let_out(self.spark.read.parquet(state["held"]), last + 1, state["pos"])
            self._after(last + 1, {**state, "pos": pos, "held": None, "finished": True})


def source_statistics_stream(rows: DataFrame, out: str, source: str = "source", checkpoint: str | None = None) -> StreamingQuery:
    """Documents and characters by source so far, kept in the stream's state; ``read_statistics`` gives the newest totals.

    Totals are written beside the older ones, and a small file that is replaced as a whole
    names the newest, so a reader finds one or the other.
    """
    spark = rows.sparkSession
    sums = rows.groupBy(source).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"))

    def replace(totals: DataFrame, number: int) -> None:
        totals.write.mode("overwrite").parquet(f"{out}/totals-{number:09d}")
        write_text(spark, f"{out}/newest.json", json.dumps({"totals": f"totals-{number:09d}"}))

    return sums.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint or beside(out)).outputMode("complete").trigger(availableNow=True).start()


def read_statistics(spark: SparkSession, out: str) -> DataFrame:
    """The newest totals of ``source_statistics_stream``."""
    return spark.read.parquet(f"{out}/{json.loads(read_text(spark, f'{out}/newest.json'))['totals']}")
