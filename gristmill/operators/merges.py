"""Upserts, patches and category merges as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.columns import filled, is_blank


def upsert(target: DataFrame, source: DataFrame, keys: list[str], only_blank: tuple[str, ...] = ()) -> DataFrame:
    """``target`` with the rows of ``source`` put in by key; columns in ``only_blank`` change only where they are blank.

    Both have the same columns and unique keys. Null keys match each other.
    """
    t, s = target.alias("t"), source.alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    marked_t, marked_s = t.withColumn("_t", F.lit(True)).alias("t"), s.withColumn("_s", F.lit(True)).alias("s")
    joined = marked_t.join(marked_s, on, "full")

    def value(c: str) -> Column:
        new, old = F.col(f"s.{c}"), F.col(f"t.{c}")
        if c in keys:
            return F.coalesce(old, new).alias(c)
        put = filled(old, new) if c in only_blank else new
        return F.when(F.col("s._s").isNull(), old).when(F.col("t._t").isNull(), new).otherwise(put).alias(c)

    return joined.select(*[value(c) for c in target.columns])


def replaced_by_key(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``source``, and those of ``target`` whose key it lacks: replace, not append."""
    kept = target.join(source.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*target.columns).unionByName(source.select(*target.columns))


def patched_metadata(old: Column, new: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """A string map with the entries of ``new`` that ``old`` lacks or has blank, under their own names and under none of their ``aliases``.

    Blank entries of ``old`` stay unless ``new`` has them.
    """
    has = F.map_filter(old, lambda k, v: ~is_blank(v))

    def lacking(key: Column) -> Column:
        out = ~F.map_contains_key(has, key)
        for name, others in (aliases or {}).items():
            for other in others:
                out = out & ~((key == name) & F.map_contains_key(has, other))
        return out

    added = F.map_filter(new, lambda k, v: ~is_blank(v) & lacking(k))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(added, k) & (~is_blank(v) if aliases is None else F.lit(True))), added)


#: Entries that hold times, and those of a file that are taken over.
TIME_ENTRIES = ["content_created_at", "content_updated_at", "created_at", "updated_at"]


def chunk_metadata(base: Column, kind: Column, source_url: Column, index: Column, length: Column) -> Column:
    """Metadata of a chunk as a string map: what has a value, with defaults; times of the content stand for those of its row.

    ``base`` is what is known of the page or file; its other entries follow.
    """
    value = lambda name: F.nullif(F.trim(F.element_at(base, name)), F.lit(""))
    created, updated = (F.coalesce(value(f"content_{x}_at"), value(f"{x}_at")) for x in ("created", "updated"))
    fixed = {"source_url": F.nullif(F.trim(source_url), F.lit("")), "chunk_index": index.cast("string"), "content_length": length.cast("string"),
             "update_frequency": F.coalesce(value("update_frequency"), F.lit("1_day")), "content_created_at": value("content_created_at"),
             "content_updated_at": value("content_updated_at"), "created_at": created, "updated_at": updated, "date_rerank_target": F.lit("true"), "source_category": kind}
    own = F.create_map(*[x for name, v in fixed.items() for x in (F.lit(name), v)])
    return F.map_filter(F.map_concat(F.map_filter(base, lambda k, v: ~k.isin(list(fixed))), own), lambda k, v: ~is_blank(v))


def merged_category(old: Column, new: Column, overwrite: bool) -> Column:
    """Fill a blank category, or overwrite it with anything that isn't blank."""
    return F.when(is_blank(new), old).otherwise(new) if overwrite else filled(old, new)


def merged_union(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of all parts by key, each column with the last value that isn't null, in the order of the parts."""
    numbered = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    rows = numbered[0]
    for p in numbered[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    names = [c for c in rows.columns if c not in [*keys, "_part"]]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_part"))).alias(c) for c in names])
