"""The text catalogue: listing, selection by id, tags, and saving rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_texts(texts: DataFrame, corpus: str, media_type: str | None = None) -> DataFrame:
    """A corpus's texts, newest first where created_at exists; ties by id."""
    t = texts.where(F.col("corpus_id") == corpus)
    t = t.where(F.col("media_type") == media_type) if media_type else t
    return t.orderBy(*([F.desc("created_at")] if "created_at" in texts.columns else []), "text_id")


def select_texts(texts: DataFrame, ids: DataFrame, corpus: str | None = None) -> DataFrame:
    """Texts with an id in `ids` (text_id); unknown ids are dropped. With corpus, its texts only."""
    t = texts.join(ids.select("text_id").distinct(), "text_id", "left_semi")
    return t.where(F.col("corpus_id") == corpus) if corpus else t


def with_tags(texts: DataFrame, text_tags: DataFrame) -> DataFrame:
    tags = text_tags.groupBy("text_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return texts.join(tags, "text_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def having_tags(texts: DataFrame, wanted: list[str], name: str = "") -> DataFrame:
    """Texts with all the wanted tags, whose name holds the search text."""
    keep = F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), "tags")) == 0
    return texts.where(keep & (F.lower("name").contains(name.lower()) if name else F.lit(True)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new over old by key; a null field of new keeps the old one."""
    fields = [c for c in old.columns if c != key]
    o, n = old.select(F.col(key), *(F.col(c).alias(f"o_{c}") for c in fields)), new.select(F.col(key), *(F.col(c).alias(f"n_{c}") for c in fields))
    return o.join(n, key, "full_outer").select(key, *(F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in fields))


def append_new(old: DataFrame, new: DataFrame, key: str = "unique_id") -> DataFrame:
    """old with those rows of new whose key it lacks; a row with a null key is always new."""
    first = new.where(F.col(key).isNull()).unionByName(new.where(F.col(key).isNotNull()).dropDuplicates([key]))
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns))


def remove(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """table without the rows whose keys are in `gone`."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def remove_corpora(texts: DataFrame, text_tags: DataFrame, tasks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts, tags and tasks that are left when corpora (corpus_id) go: texts and their tags go too, tasks stay without their references."""
    left = remove(texts, gone, "corpus_id")
    lost = texts.join(gone.select("corpus_id").distinct(), "corpus_id", "left_semi").select("text_id").distinct()
    without = lambda t, dead, key: t.join(dead.select(key).distinct().withColumn("_dead", F.lit(True)), key, "left").withColumn(key, F.when(F.col("_dead").isNull(), F.col(key))).drop("_dead")
    kept = without(without(tasks, gone, "corpus_id"), lost, "text_id")
    return left, remove(text_tags, lost, "text_id"), kept.select(*tasks.columns)


def add_tags(text_tags: DataFrame, new: DataFrame) -> DataFrame:
    """(text_id, tag) pairs, each once, however often it is added."""
    return text_tags.select("text_id", "tag").unionByName(new.select("text_id", "tag")).distinct()


def remove_tags(text_tags: DataFrame, gone: DataFrame) -> DataFrame:
    return remove(text_tags, gone, "text_id", "tag")


def update_tasks(tasks: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """tasks with the fields that changes (task_id, ...) brings; a null field keeps the old one. Changed tasks get the time, completed ones as their end too."""
    fields = [c for c in changes.columns if c != "task_id"]
    new = changes.select("task_id", *(F.col(c).alias(f"n_{c}") for c in fields), F.lit(True).alias("_changed"))
    t = tasks.join(new, "task_id", "left")
    t = t.withColumns({c: F.coalesce(f"n_{c}", c) for c in fields})
    done = F.col("n_status") == "completed" if "status" in fields else F.lit(False)
    t = t.withColumns({"updated_at": F.when(F.col("_changed"), now).otherwise(F.col("updated_at")), "completed_at": F.when(done, now).otherwise(F.col("completed_at"))})
    return t.select(*tasks.columns)


def active_tasks(tasks: DataFrame, corpus: str, now: Column, recent: str = "2 minutes") -> DataFrame:
    """A corpus's tasks that wait or run, or that ended within `recent`; newest first."""
    ended = F.col("status").isin("completed", "failed") & (F.col("updated_at") > now - F.expr(f"interval {recent}"))
    return tasks.where((F.col("corpus_id") == corpus) & (F.col("status").isin("pending", "processing") | ended)).orderBy(F.desc("created_at"), "task_id")


def fail_stale(tasks: DataFrame, now: Column) -> DataFrame:
    """tasks in which those that wait or run have failed, as after a restart."""
    stale = F.col("status").isin("pending", "processing")
    return tasks.withColumns({"message": F.when(stale, "Task interrupted (server restart)").otherwise(F.col("message")), "updated_at": F.when(stale, now).otherwise(F.col("updated_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})
