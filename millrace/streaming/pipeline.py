"""Frames of several topics to bronze to silver, models and reports: once or at an interval.

A cycle loads what has arrived for each topic, runs the models once over all topics if
anything was loaded, and exports the reports when that is due, new data or not.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace import storage
from millrace.operators import merge, partials
from millrace.operators.bronze import BRONZE_COLUMNS, Topic, append_bronze, bronze_table, create_bronze
from millrace.operators.incremental import append_load, create_loads
from millrace.operators.layout import COMPACTED, compact_days, ensure_layer, partitions_of, without_load
from millrace.operators.quality import quality_flags, quality_measures
from millrace.operators.sse import parse_sse, split_valid_utf8
from millrace.plans.runner import Model, keyed_table, partial_sums_table, run_models
from millrace.plans.silver import silver_recentchange
from millrace.session import configure
from millrace.sinks.csv_export import export_csv, layer_relations
from millrace.sources.frames import read_frames
from millrace.streaming.landing import stream_id
from millrace.streaming.taken import EPOCH, Marks, Taken, later, marks_of, note, rows_between, taken

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class Feed:
    """A topic, the folder where its frames land, and how its events are typed.

    ``sort_by`` names silver columns by which the rows of a load are sorted in its files,
    so that readers of one value skip the rest.
    """

    topic: Topic
    landing: str
    project: Callable[[DataFrame], DataFrame] = silver_recentchange
    sort_by: tuple[str, ...] = ()

    @property
    def silver_table(self) -> str:
        return storage.quoted(f"silver.{self.topic.name}")


def log_counts(topic: str, counts: dict) -> None:
    """Report the counts of a load; a warning if anything was left out."""
    bad = counts["missing_key_parts"] + counts["incomplete"] + counts["undecodable"]
    logger.log(
        logging.WARNING if bad else logging.INFO,
        "%s: of %s events, %s key parts missing, %s incomplete; %s undecodable frames (last in %s)",
        topic,
        counts["seen"],
        counts["missing_key_parts"],
        counts["incomplete"],
        counts["undecodable"],
        counts["undecodable_file"],
    )


def load_frames(frames: DataFrame, topic: Topic, load_id: str, root: str | None = None) -> dict:
    """Append the events of some frames to bronze as one load and count what was left out.

    The counts are taken while the load is written, not in a pass of their own.
    """
    scanned, parsed = Observation(), Observation()
    bad = ~F.is_valid_utf8("value")
    watched = frames.observe(
        scanned,
        F.count_if(bad).alias("undecodable"),
        F.max(F.when(bad, F.col("file_name"))).alias("undecodable_file"),
    )
    good, _ = split_valid_utf8(watched)
    measures = [measure.alias(name) for name, measure in quality_measures().items()]
    events = quality_flags(parse_sse(good), topic.primary_key).observe(parsed, *measures)
    append_bronze(events.where("kept").withColumnRenamed("data", "event"), topic.name, load_id, root)
    return {**parsed.get, **scanned.get}


class Pipeline:
    """Cycles over some feeds; see ``run_once`` and ``run_continuous``."""

    def __init__(
        self,
        spark: SparkSession,
        feeds: Feed | Sequence[Feed],
        checkpoint: str,
        models: Sequence[Model] = (),
        csv_dir: str | None = None,
        export_every: float = 60.0,
        report: Callable[[str, dict], None] = log_counts,
        root: str | None = None,
        splittable: bool = False,
        **source_options: str | int,
    ):
        self.spark = configure(spark)
        self.feeds = [feeds] if isinstance(feeds, Feed) else list(feeds)
        self.checkpoint, self.models, self.root = checkpoint.rstrip("/"), models, root
        self.csv_dir, self.export_every, self.report = csv_dir, export_every, report
        self.source_options = {"splittable": splittable, **source_options}
        self.last_export: float | None = None
        self.results: dict[str, DataFrame] = {}
        # Topics that were loaded since the models last ran.
        self.pending: set[str] = set()
        self.first = True
        # Events seen in the last cycle, by topic.
        self.loaded: dict[str, int] = {}

    def _loader(self, feed: Feed, checkpoint: str) -> Callable[[DataFrame, int], None]:
        session, name = self.spark, feed.topic.name

        def load(batch: DataFrame, batch_id: int) -> None:
            load_id = f"{stream_id(session, checkpoint)}-{batch_id:012d}"
            counts = load_frames(batch, feed.topic, load_id, self.root)
            self.report(name, counts)
            self.loaded[name] += counts["seen"]
            if counts["seen"] == 0:
                return
            # From here on the work reads the load just written, so it depends on the batch
            # alone, and it runs in the caller's session: a stream's own session plans without
            # adaptive execution, and neither session sees files that the other one wrote
            # until it is told to look.
            session.catalog.refreshTable(bronze_table(name))
            bronze = session.table(bronze_table(name)).where(F.col("load_id") == load_id)
            rows = feed.project(without_load(bronze))
            append_load(rows.sortWithinPartitions(*feed.sort_by) if feed.sort_by else rows, feed.silver_table, load_id, self.root)
            self.pending.add(name)

        return load

    def _start(self, feed: Feed) -> StreamingQuery:
        checkpoint = f"{self.checkpoint}/{feed.topic.name}"
        frames = read_frames(self.spark, feed.landing, streaming=True, **self.source_options)
        writer = frames.writeStream.foreachBatch(self._loader(feed, checkpoint)).option("checkpointLocation", checkpoint)
        return writer.queryName(f"load {feed.topic.name}").trigger(availableNow=True).start()

    def load(self) -> None:
        """Load what has arrived for every topic, and report the total; the topics' streams run side by side."""
        self.loaded = {feed.topic.name: 0 for feed in self.feeds}
        queries = [self._start(feed) for feed in self.feeds]
        for query in queries:
            query.awaitTermination()
        logger.info("%s events of %s topics in this cycle", sum(self.loaded.values()), len(self.feeds))

    def transform(self) -> None:
        """Run the models that a load has reached since they last ran, or all if this is the first cycle.

        A model is reached if it needs a topic that was loaded, or a model that is reached; the others
        stay as they are.

        Each incremental or partial model gets the rows of the loads that it hasn't taken in: when a
        model fails or the driver ends, the next run of any pipeline feeds them, and a new model
        gets all that is there. A topic that nothing has arrived for is an empty table.
        """
        if not self._known() or not (self.pending or self.first):
            return
        self._create_absent()
        inputs, stored, loads = {}, {}, self._marks()
        reached = {feed.topic.name for feed in self.feeds} if self.first else set(self.pending)
        due = self._due(reached)
        for feed in self.feeds:
            name = feed.topic.name
            self.spark.catalog.refreshTable(feed.silver_table)
            table, raw = self.spark.table(feed.silver_table), self.spark.table(bronze_table(name))
            inputs |= {name: without_load(table), f"{name}_raw": without_load(raw)}
            stored |= {name: feed.silver_table, f"{name}_raw": bronze_table(name)}
        for layer in ("silver", "gold"):
            ensure_layer(self.spark, layer, self.root)
        for model in self.models:
            if model not in due:
                inputs[model.name] = self.results[model.full_name]
                if self.spark.catalog.tableExists(storage.quoted(model.full_name)):
                    stored[model.name] = storage.quoted(model.full_name)
        self.results |= run_models(
            self.spark,
            due,
            inputs,
            root=self.root,
            stored=stored,
            fresh=lambda model: self._intake(model, loads),
        )
        self.pending -= reached
        self.first = False

    def _due(self, topics: set[str]) -> list[Model]:
        """The models that need some topics, in any number of steps."""
        names = {name for topic in topics for name in (topic, f"{topic}_raw")}
        due: list[Model] = []
        while more := [m for m in self.models if m not in due and (m.full_name not in self.results or names & set(m.needs))]:
            due += more
            names |= {model.name for model in more}
        return due

    def _known(self) -> list[Feed]:
        return [feed for feed in self.feeds if self.spark.catalog.tableExists(feed.silver_table)]

    def _create_absent(self) -> None:
        """Empty layers for topics of which no file has come, so that models over several topics run."""
        for feed in self.feeds:
            if not self.spark.catalog.tableExists(feed.silver_table):
                create_bronze(self.spark, feed.topic.name, self.root)
                empty = self.spark.createDataFrame([], BRONZE_COLUMNS)
                create_loads(feed.project(empty), feed.silver_table, self.root)

    def _marks(self) -> dict[str, Marks]:
        """Per topic and stream the last batch in the silver layer, from the catalog alone."""
        return {feed.topic.name: marks_of(partitions_of(self.spark, feed.silver_table)) for feed in self._known()}

    def _rows(self, model: Model, after: dict[str, Marks], upto: dict[str, Marks]) -> dict[str, DataFrame]:
        mine = {feed.topic.name: feed.silver_table for feed in self._known() if feed.topic.name in model.needs}
        return {
            name: without_load(rows_between(self.spark.table(table), after.get(name, {}), upto.get(name, {}))) for name, table in mine.items()
        }

    def _intake(self, model: Model, loads: dict[str, Marks]) -> Iterator[tuple[object, dict[str, DataFrame]]]:
        """The runs that a model has to take in, each with its rows; the next is asked for when one is stored."""
        loads = {name: marks for name, marks in loads.items() if name in model.needs}
        if model.materialized == "partial":
            if len(loads) != 1:
                raise ValueError(f"{model.full_name} must need one topic, and needs {', '.join(model.needs)}")
            ((topic, marks),) = loads.items()
            have = partials.runs_of(self.spark, partial_sums_table(model))
            done = {run.stream: max(r.last for r in have if r.stream == run.stream) for run in have}
            for stream, last in sorted(later(marks, done).items()):
                rows = self._rows(model, {topic: done}, {topic: {stream: last}})
                yield partials.Run(stream, 0, done.get(stream, -1) + 1, last), rows
            return
        state = taken(self.spark, model)
        if state.begun is not None and merge.last_run(self.spark, keyed_table(model)) != state.run + 1:
            state.begun = None  # nothing of it was written
        while True:
            if state.begun is None:
                new = {name: later(marks, state.marks.get(name, {})) for name, marks in loads.items()}
                if not any(new.values()):
                    return
                state.begun = {name: {**state.marks.get(name, {}), **marks} for name, marks in new.items()}
                note(self.spark, model, state, self.root)
            yield state.run + 1, self._rows(model, state.marks, state.begun)
            state = Taken(state.run + 1, {**state.marks, **state.begun})
            note(self.spark, model, state, self.root)

    def _behind(self, model: Model, loads: dict[str, Marks]) -> bool:
        """Whether there are loads that a model hasn't taken in."""
        mine = {name: marks for name, marks in loads.items() if name in model.needs}
        if model.materialized == "partial":
            have = partials.runs_of(self.spark, partial_sums_table(model))
            done = {run.stream: max(r.last for r in have if r.stream == run.stream) for run in have}
            return any(later(marks, done) for marks in mine.values())
        state = taken(self.spark, model)
        return state.begun is not None or any(later(marks, state.marks.get(name, {})) for name, marks in mine.items())

    def export(self) -> dict[str, str]:
        """Write every report: what the gold layer stores, and this pipeline's other gold relations."""
        if not self.csv_dir:
            return {}
        mine = {name: df for name, df in self.results.items() if name.startswith("gold.")}
        written = export_csv(layer_relations(self.spark, "gold") | mine, self.csv_dir)
        self.last_export = time.monotonic()
        return written

    def cycle(self) -> None:
        self.load()
        self.transform()
        if self.last_export is None or time.monotonic() - self.last_export >= self.export_every:
            self.export()

    def compact(self, before) -> None:
        """Merge the loads of closed days of all topics, in bronze and silver.

        Incremental models take in all loads first, since a merged day can't be told apart.
        Compact with the pipeline that has them: a day merged by another is fed to them again.
        """
        own = [model for model in self.models if model.materialized in ("incremental", "partial")]
        loads = self._marks()
        if any(self._behind(model, loads) for model in own):
            self.first = True
            self.transform()
        closed = (before - EPOCH).days - 1
        for model in own:
            state = taken(self.spark, model)
            for feed in self._known():
                name = feed.topic.name
                days = [day for day, _ in partitions_of(self.spark, feed.silver_table) if day < before.isoformat()]
                if name not in model.needs or not days:
                    continue
                if model.materialized == "partial":
                    table = partial_sums_table(model)
                    partials.note_run(self.spark, table, partials.Run(COMPACTED, 0, 0, closed))
                else:
                    state.marks.setdefault(name, {})[COMPACTED] = closed
            if model.materialized == "incremental":
                note(self.spark, model, state, self.root)
        for feed in self.feeds:
            for table in (bronze_table(feed.topic.name), feed.silver_table):
                if self.spark.catalog.tableExists(table):
                    compact_days(self.spark, table, before)


class RunningPipeline:
    """Cycles in a thread of the driver; an error ends them and comes out of ``wait`` and ``stop``."""

    def __init__(self, pipeline: Pipeline, every: float):
        self.pipeline, self.every, self.cycles = pipeline, every, 0
        self._stop, self._error = threading.Event(), None
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        try:
            while not self._stop.is_set():
                self.pipeline.cycle()
                self.cycles += 1
                self._stop.wait(self.every)
        except Exception as error:
            self._error = error

    def _raise(self) -> None:
        if self._error:
            raise self._error

    def wait(self, cycles: int = 1, timeout: float | None = None) -> bool:
        """Wait until so many more cycles that begin from now on are done."""
        goal, end = self.cycles + cycles + 1, time.monotonic() + (timeout or float("inf"))
        while self.cycles < goal and self._thread.is_alive() and time.monotonic() < end:
            time.sleep(0.1)
        self._raise()
        return self.cycles >= goal

    def stop(self) -> None:
        """End after the cycle in work."""
        self._stop.set()
        self._thread.join()
        self._raise()


def run_once(spark: SparkSession, feeds: Feed | Sequence[Feed], checkpoint: str, **settings) -> Pipeline:
    """Load and transform what is there and not loaded yet, export the reports, then return.

    ``settings`` are those of ``Pipeline``. The checkpoint remembers loaded files. A large
    backlog is worked off in several batches if ``maxBytesPerTrigger`` or
    ``maxFilesPerTrigger`` is given.
    """
    pipeline = Pipeline(spark, feeds, checkpoint, **settings)
    pipeline.load()
    pipeline.transform()
    pipeline.export()
    return pipeline


def run_continuous(
    spark: SparkSession, feeds: Feed | Sequence[Feed], checkpoint: str, every: float = 60.0, **settings
) -> RunningPipeline:
    """Cycle again ``every`` seconds after the last one; reports are due every ``export_every`` seconds, idle or not."""
    return RunningPipeline(Pipeline(spark, feeds, checkpoint, **settings), every)
