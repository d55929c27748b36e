"""User models: DataFrame functions or SQL text, refreshed in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage
from millrace.functions.text import ADD_WORD, LINK_PATTERN, REMOVE_WORD
from millrace.operators import merge, partials
from millrace.operators.layout import ensure_layer
from millrace.plans.silver import LOG_PARAM_PATHS


# Where the tables of incremental models are; the models are views over them.
KEYED_LAYER = "keyed"


@dataclass(frozen=True)
class Model:
    """A relation of a layer.

    ``build`` is a function of the needed DataFrames, in the order of ``needs``, or SQL
    text that names them in braces, from which ``needs`` follows. ``materialized`` is ``view``, ``table``,
    ``incremental`` or ``partial``. An incremental model is refreshed by ``unique_key``, and ``bucket`` says
    how its rows are laid out (see ``merge_batch``). A partial model groups the rows of one topic by
    ``unique_key``, and its other columns are sums (or counts): each load's are added to a table of
    partial sums (see ``partials``), and the relation is a view that sums them up, in the order of ``order_by``.
    """

    name: str
    layer: str
    build: Callable[..., DataFrame] | str
    needs: tuple[str, ...] = ()
    materialized: str = "view"
    unique_key: tuple[str, ...] = ()
    bucket: str | None = None
    order_by: tuple[str, ...] = ()

    def __post_init__(self):
        if isinstance(self.build, str) and not self.needs:
            names = (name for _, name, _, _ in Formatter().parse(self.build) if name)
            object.__setattr__(self, "needs", tuple(dict.fromkeys(names)))

    @property
    def full_name(self) -> str:
        return f"{self.layer}.{self.name}"


class ModelRunError(RuntimeError):
    """One or more models failed; ``messages`` has the text of each, by model."""

    def __init__(self, messages: Mapping[str, str]):
        self.messages = dict(messages)
        super().__init__("\n".join(f"{name}: {text}" for name, text in self.messages.items()))


# The change models as SQL, so that their views can be stored; plans.silver and plans.gold have them as functions.
_COMMON = "id, namespace, title, comment"
_WHERE = "uri, domain, dt"
_MINUTE = "translate(substr(cast(dt AS STRING), 1, 16), '-', '/')"
_LOG_PARAMS = ", ".join(
    f"to_json(try_variant_get(log_params, '$.{path}', 'variant')) AS {path.split('.')[-1]}" for path in LOG_PARAM_PATHS
)

def change_models(topic: str = "recentchange", partial: bool = False) -> tuple[Model, ...]:
    """The views by event type and both reports of a topic with change events.

    With ``partial`` the reports are sums of what each load has counted, and no cycle reads
    more of silver than its own loads; else they are views over all of silver.
    """
    if partial:
        reports = (
            Model(
                f"{topic}_logs_per_domain_and_min",
                "gold",
                f"SELECT domain, log_action, {_MINUTE} AS minute, count(*) AS count_actions FROM {{{topic}}} WHERE type = 'log' "
                "GROUP BY domain, log_action, minute",
                materialized="partial",
                unique_key=("domain", "log_action", "minute"),
                order_by=("minute", "domain", "log_action"),
            ),
            Model(
                f"{topic}_human_vs_bot_new_and_edit_actions",
                "gold",
                f"SELECT {_MINUTE} AS minute, bot, count(*) AS count_actions FROM {{{topic}}} WHERE type IN ('new', 'edit') GROUP BY minute, bot",
                materialized="partial",
                unique_key=("minute", "bot"),
                order_by=("minute", "bot"),
            ),
        )
        return (*change_models(topic)[:-2], *reports)
    return (
        Model(
            f"{topic}_new",
            "silver",
            f"SELECT {_COMMON}, user, bot, minor, length_new AS length, {_WHERE}, patrolled FROM {{{topic}}} WHERE type = 'new'",
        ),
        Model(
            f"{topic}_edit",
            "silver",
            f"SELECT {_COMMON}, user, bot, minor, try_subtract(revision_new, revision_old) AS revision_global_offset, "
            f"try_subtract(length_new, length_old) AS length_difference, {_WHERE}, patrolled FROM {{{topic}}} WHERE type = 'edit'",
        ),
        Model(
            f"{topic}_categorize",
            "silver",
            f"SELECT {_COMMON}, regexp_extract(comment, r'{LINK_PATTERN}', 0) AS object, CASE WHEN contains(comment, '{ADD_WORD}') "
            f"THEN 'add' WHEN contains(comment, '{REMOVE_WORD}') THEN 'remove' END AS action_type_en, user, bot, minor, {_WHERE} "
            f"FROM {{{topic}}} WHERE type = 'categorize'",
        ),
        Model(
            f"{topic}_log",
            "silver",
            f"SELECT {_COMMON}, user, bot, minor, {_WHERE}, log_type, log_action, {_LOG_PARAMS} FROM {{{topic}}} WHERE type = 'log'",
        ),
        Model(
            f"{topic}_logs_per_domain_and_min",
            "gold",
            f"SELECT domain, log_action, {_MINUTE} AS minute, count(*) AS count_actions FROM {{{topic}_log}} "
            "GROUP BY domain, log_action, minute ORDER BY minute NULLS LAST, domain NULLS LAST, log_action NULLS LAST",
        ),
        Model(
            f"{topic}_human_vs_bot_new_and_edit_actions",
            "gold",
            f"SELECT {_MINUTE} AS minute, bot, count(*) AS count_actions FROM "
            f"(SELECT dt, bot FROM {{{topic}_new}} UNION ALL SELECT dt, bot FROM {{{topic}_edit}}) "
            "GROUP BY minute, bot ORDER BY minute NULLS LAST, bot NULLS LAST",
        ),
    )


CHANGE_MODELS = change_models()


def sql_model(spark: SparkSession, text: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """A SELECT over upstream names written in braces: ``SELECT ... FROM {recentchange}``."""
    return spark.sql(text, **inputs)


def _store_table(df: DataFrame, full_name: str) -> None:
    """Replace a stored table: write beside the current files, then switch the table over.

    Two places take turns, so readers of the version before the switch are not cut off
    and a failed run leaves the table as it was.
    """
    spark = df.sparkSession
    layer, name = full_name.split(".")
    home = spark.catalog.getDatabase(layer).locationUri.rstrip("/") + f"/{name}"
    full_name, place = storage.quoted(full_name), None
    if spark.catalog.tableExists(full_name):
        details = spark.sql(f"DESCRIBE TABLE EXTENDED {full_name}").where(F.col("col_name") == "Location")
        place = details.first()["data_type"].rstrip("/")
    target = f"{home}/b" if place and place.endswith("/a") else f"{home}/a"
    df.write.mode("overwrite").parquet(target)
    stored = spark.read.parquet(target).schema
    if place and spark.table(full_name).schema == stored:
        spark.sql(f"ALTER TABLE {full_name} SET LOCATION {storage.literal(target)}")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {full_name}")
        spark.catalog.createTable(full_name, path=target, source="parquet", schema=stored)
    spark.catalog.refreshTable(full_name)


def keyed_table(model: Model) -> str:
    """Where the runs of an incremental model are."""
    return storage.quoted(f"{KEYED_LAYER}.{model.layer}_{model.name}")


def partial_sums_table(model: Model) -> str:
    """Where the runs of a partial model are."""
    return partials.partial_table(f"{model.layer}_{model.name}")


Intake = Iterable[tuple[object, Mapping[str, DataFrame]]]


def _built(spark: SparkSession, model: Model, inputs: Mapping[str, DataFrame]) -> DataFrame:
    needed = {name: inputs[name] for name in model.needs}
    return sql_model(spark, model.build, needed) if isinstance(model.build, str) else model.build(*needed.values())


def _refresh(
    spark: SparkSession, model: Model, inputs: Mapping[str, DataFrame], stored: Mapping[str, str], root: str | None, intake: Intake | None
) -> tuple[DataFrame, str | None]:
    """The model's relation, and its name in the catalog if it is stored there."""
    full_name = storage.quoted(model.full_name)
    ensure_layer(spark, model.layer, root)
    if model.materialized == "view" and isinstance(model.build, str) and all(need in stored for need in model.needs):
        spark.sql(f"CREATE OR REPLACE VIEW {full_name} AS {model.build.format(**stored)}")
        return spark.table(full_name), full_name
    if model.materialized == "view" or (model.materialized == "partial" and intake is None):
        df = _built(spark, model, inputs)
        if model.order_by:
            df = df.orderBy(*[F.col(name).asc_nulls_last() for name in model.order_by])
        df.createOrReplaceTempView(f"`{model.full_name}`")
        return df, None
    if model.materialized == "table":
        _store_table(_built(spark, model, inputs), model.full_name)
        return spark.table(full_name), full_name
    if model.materialized == "partial":
        table = partial_sums_table(model)
        for run, rows in intake:
            partials.append_run(_built(spark, model, {**inputs, **rows}), table, run, root)
        if not spark.catalog.tableExists(table):
            partials.create_partials(_built(spark, model, inputs), table, root)
        partials.fold(spark, table, model.unique_key)
        text = partials.totals_sql(spark, table, model.unique_key, model.order_by)
    elif model.materialized == "incremental":
        table = keyed_table(model)
        taken = False
        for run, rows in [(None, {})] if intake is None else intake:
            merge.merge_batch(_built(spark, model, {**inputs, **rows}), table, model.unique_key, model.bucket, root=root, run=run)
            taken = True
        if not taken:
            # Over no rows: the table is there, and a model whose columns have changed fails at once.
            none = _built(spark, model, {**inputs, **{name: inputs[name].limit(0) for name in model.needs}})
            merge.merge_batch(none, table, model.unique_key, model.bucket, root=root)
        columns = ", ".join(storage.quoted(name) for name in spark.table(table).columns if name not in merge.LAYOUT_COLUMNS)
        text = f"SELECT {columns} FROM ({merge.merged_sql(spark, table)})"
    else:
        raise ValueError(f"unknown materialization {model.materialized!r}")
    spark.sql(f"CREATE OR REPLACE VIEW {full_name} AS {text}")
    return spark.table(full_name), full_name


def run_models(
    spark: SparkSession,
    models: Sequence[Model],
    inputs: Mapping[str, DataFrame],
    fail_fast: bool = True,
    loaded: int | None = None,
    root: str | None = None,
    stored: Mapping[str, str] | None = None,
    fresh: Mapping[str, DataFrame] | Callable[[Model], Intake] | None = None,
) -> dict[str, DataFrame]:
    """Refresh models after what they need; returns them by ``layer.name``.

    ``stored`` names the inputs that are tables or views of the catalog. A view in SQL
    whose needs are all stored becomes a view of the catalog, for every session; other
    views stay lazy and are temporary views under their quoted full name. ``fresh`` has the
    rows that are new since the last run, for incremental models that need such an input, or
    is a function that gives, for an incremental or partial model, pairs of a run and its rows; it is
    asked for the next pair when one is stored. Without runs, partial models are plain views.
    Nothing runs when ``loaded`` is 0. On failure the run stops, or with
    ``fail_fast=False`` goes on with models that do not need a failed one, and raises
    ``ModelRunError`` at the end.
    """
    if loaded == 0:
        return {}
    by_name = {model.name: model for model in models}
    order = TopologicalSorter({m.name: [n for n in m.needs if n in by_name] for m in models}).static_order()
    available, catalog = dict(inputs), dict(stored or {})
    results: dict[str, DataFrame] = {}
    messages: dict[str, str] = {}
    for name in order:
        model = by_name[name]
        absent = [need for need in model.needs if need not in available]
        try:
            if absent:
                raise LookupError(f"needs {', '.join(absent)}")
            intake = None
            if model.materialized in ("incremental", "partial") and fresh:
                intake = fresh(model) if callable(fresh) else [(None, fresh)] if model.materialized == "incremental" else None
            result, place = _refresh(spark, model, available, catalog, root, intake)
            available[name] = results[model.full_name] = result
            catalog.pop(name, None)
            if place:
                catalog[name] = place
        except Exception as error:  # a model is user code: report it by name
            messages[model.full_name] = str(error)
            available.pop(name, None)
            catalog.pop(name, None)
            if fail_fast:
                break
    if messages:
        raise ModelRunError(messages)
    return results
