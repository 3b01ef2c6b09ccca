"""The catalog of models, tasks and files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import DATA_SOURCE, TASK_PROGRESS, TASK_STATUS, TASK_TYPE, mapped
from ..plans.relational import insert_missing, update_rows

# The order in which sources of models are shown.
SOURCE_RANK = {"official": 1, "custom": 2, "market": 3}


def by_id_or_name(rows: DataFrame, key: str, people: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """``rows`` with owner_id and owner_name, where the key holds an id if it is all digits, else a name: two
    equi-joins in place of one on a CASE. Names are unique, as ids are."""
    is_id = F.col(key).rlike("^[0-9]+$")
    k = rows.withColumns({"__id": F.when(is_id, F.col(key)).try_cast("long"), "__name": F.when(~is_id, F.col(key))})
    ids = people.select(F.col(id_col).alias("__id"), F.col(id_col).alias("__i1"), F.col(name_col).alias("__n1"))
    names = people.select(F.col(name_col).alias("__name"), F.col(id_col).alias("__i2"), F.col(name_col).alias("__n2"))
    joined = k.join(ids, "__id", "left").join(names, "__name", "left")
    return joined.select(*rows.columns, F.coalesce("__i1", "__i2").alias("owner_id"), F.coalesce("__n1", "__n2").alias("owner_name"))


def source_rank(source: Column) -> Column:
    return mapped(source, SOURCE_RANK, len(SOURCE_RANK) + 1)


def models_of(user_models: DataFrame, models: DataFrame, user: int) -> DataFrame:
    """The active models of a user: official ones first, then own, then from the market, newest first."""
    own = user_models.where((F.col("user_id") == user) & F.col("is_active"))
    joined = own.join(models.withColumnRenamed("id", "__model"), F.col("model_id") == F.col("__model")).drop("__model")
    return joined.orderBy(source_rank(F.col("source")), F.desc("acquired_at"), F.desc("id"))


def with_added_flag(models: DataFrame, key: str, links: DataFrame, link_key: str, where: Column) -> DataFrame:
    """``models`` with added: whether a link that fits the condition points to it."""
    mine = links.where(where).select(F.col(link_key).alias("__added")).distinct()
    return models.join(mine, models[key] == mine["__added"], "left").withColumn("added", F.col("__added").isNotNull()).drop("__added")


def task_listing(tasks: DataFrame, models: DataFrame, files: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Tasks with their model and, if any, file, with labels for codes; newest first."""
    c = {"task": "id", "model": "model_id", "file": "file_id", "status": "status", "type": "task_type", "created": "created_at", "model_id": "id", "model_name": "name", "file_id": "id", "file_name": "filename"} | dict(names or {})
    m = models.select(F.col(c["model_id"]).alias("__m"), F.col(c["model_name"]).alias("model_name"))
    f = files.select(F.col(c["file_id"]).alias("__f"), F.col(c["file_name"]).alias("file_name"))
    joined = tasks.join(m, F.col(c["model"]) == F.col("__m")).join(f, F.col(c["file"]) == F.col("__f"), "left").drop("__m", "__f")
    status = F.col(c["status"])
    source = F.get_json_object("extra", "$.dataSource") if "extra" in tasks.columns else F.lit(None)
    labelled = joined.withColumns(
        {"status_label": F.coalesce(mapped(status, TASK_STATUS), status), "progress": mapped(status, TASK_PROGRESS, 0), "type_label": F.coalesce(mapped(F.col(c["type"]), TASK_TYPE), F.col(c["type"])), "source_label": mapped(source, DATA_SOURCE, DATA_SOURCE["upload"])}
    )
    return labelled.orderBy(F.desc(c["created"]), F.desc(c["task"]))


def seed_links(user_models: DataFrame, users: DataFrame, models: DataFrame, username: str, when: Column) -> DataFrame:
    """``user_models`` with links of a user to all active official models that they lack."""
    one = users.where(F.col("username") == username).select(F.col("id").alias("user_id")).limit(1)
    new = models.where((F.col("model_type") == "official") & (F.col("status") == "active")).select(F.col("id").alias("model_id")).join(F.broadcast(one))
    rows = new.select(F.lit(None).cast("long").alias("id"), "user_id", "model_id", F.lit("official").alias("source"), when.cast("timestamp_ntz").alias("acquired_at"), F.lit(True).alias("is_active"))
    return insert_missing(user_models, rows, ["user_id", "model_id"])


def acquire(user_models: DataFrame, models: DataFrame, user: int, model: int, when: Column) -> DataFrame:
    """``user_models`` with a public model added for the user, or made active again."""
    again = update_rows(user_models, (F.col("user_id") == user) & (F.col("model_id") == model), is_active=F.lit(True))
    top = F.lit(0)
    new = models.where((F.col("id") == model) & F.col("is_public")).select(F.lit(None).cast("long").alias("id"), F.lit(user).cast("long").alias("user_id"), F.col("id").alias("model_id"), F.lit("market").alias("source"), when.cast("timestamp_ntz").alias("acquired_at"), (top == 0).alias("is_active"))
    return insert_missing(again, new, ["user_id", "model_id"])


def remove(user_models: DataFrame, user: int, model: int) -> DataFrame:
    """``user_models`` without a link that isn't the user's own work; own ones only become inactive."""
    link = (F.col("user_id") == user) & (F.col("model_id") == model)
    return update_rows(user_models.where(~(link & (F.col("source") == "market"))), link, is_active=F.lit(False))


def publish(models: DataFrame, model: int, owner: str) -> DataFrame:
    """``models`` with a model of the owner made public."""
    return update_rows(models, (F.col("id") == model) & (F.col("created_by") == owner), is_public=F.lit(True))


def soft_delete(models: DataFrame, user_models: DataFrame, model: int) -> tuple[DataFrame, DataFrame]:
    """The model marked as deleted, and all links to it gone."""
    return update_rows(models, F.col("id") == model, status=F.lit("deleted")), user_models.where(F.col("model_id") != model)
