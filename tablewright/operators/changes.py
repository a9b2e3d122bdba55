"""Batch changes: add or update, delete, reload, notes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from ..contract import Dataset, TableContract, union_all
from ..functions.scalars import pack_id
from .checks import _match, check_unique, dedup_last, last_rows, reference_errors
from .support import ReferenceIndex
from .typed import json_to_typed

# Result codes.
ADDED = "addOK"
UPDATED = "updateOK"
REJECTED = "recordParseError"
DELETED = "deleteOK"
NOT_FOUND = "recordIdNotFound"


@dataclass(frozen=True)
class Upsert:
    """What an upsert does: the new table, ``(id, code)`` results, errors, and the rows that left and came."""

    table: DataFrame
    results: DataFrame
    errors: DataFrame
    removed: DataFrame
    added: DataFrame


def upsert_changes(df: DataFrame, changes: DataFrame, contract: TableContract, order: str = "seq") -> Upsert:
    """Add or update by JSON records ``changes(seq, text)``.

    Every change is judged by itself: one with any error is rejected, whatever other changes of its id do.  Of the
    good changes of one id the last one stays.  Unchanged rows stream past a hash of the changed keys; nothing else moves.
    """
    named = changes.withColumn("_file", F.col(order).cast("string"))
    typed, errors = json_to_typed(named, "text", contract, keep=[order, "_file"])
    # Parsed once; the table below is joined with lists of known size.
    typed, errors = cut(typed, "changes"), cut(errors, "errors")
    bad = errors.where(F.col("level") == "error").select(F.col("lineage").alias("_file")).distinct()
    good = typed.join(bad, "_file", "left_anti").drop("_file")
    rejected = typed.join(bad, "_file", "left_semi").select(
        pack_id(typed.schema, contract.key).alias("id"), F.lit(REJECTED).alias("code")).distinct()
    latest = last_rows(good, contract.key, (order,)).drop(order)
    latest = cut(latest.select(*[F.col(f.name).cast(f.dataType) for f in df.schema.fields]), "latest")
    kept = _match(df, latest.select(*contract.key), contract.key, "left_anti")
    removed = _match(df, latest.select(*contract.key), contract.key, "left_semi")
    known = removed.select(*contract.key).distinct()
    known = known.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(contract.key)], F.lit(True).alias("_known"))
    on = [latest[k].eqNullSafe(known[f"_h{i}"]) for i, k in enumerate(contract.key)]
    code = F.when(F.col("_known"), UPDATED).otherwise(ADDED)
    done = latest.join(known, on, "left").select(pack_id(latest.schema, contract.key).alias("id"), code.alias("code"))
    errors = errors.withColumn("lineage", F.lit(None).cast("string"))
    return Upsert(kept.unionByName(latest), done.unionByName(rejected), errors, removed, latest)


def upsert(df: DataFrame, changes: DataFrame, contract: TableContract, order: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new table, results ``(id, code)``, errors) of `upsert_changes`."""
    done = upsert_changes(df, changes, contract, order)
    return done.table, done.results, done.errors


def delete(df: DataFrame, ids: DataFrame, contract: TableContract) -> tuple[DataFrame, DataFrame]:
    """(new table, results ``(id, code)``) for packed ids ``ids(id)``."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    rid = pack_id(df.schema, contract.key)
    kept = df.join(gone, rid == F.col("_gone"), "left_anti")
    have = df.select(rid.alias("_have")).join(gone, F.col("_have") == F.col("_gone"), "left_semi").distinct()
    marked = gone.join(have, gone["_gone"] == have["_have"], "left")
    return kept, marked.select(F.col("_gone").alias("id"), F.when(F.col("_have").isNotNull(), DELETED).otherwise(NOT_FOUND).alias("code"))


def reload_table(dataset: Dataset, table: str, frame: DataFrame) -> tuple[Dataset, DataFrame]:
    """Swap one table and check again only what it takes part in: its keys and the
    foreign keys from and to it."""
    new = dataset.swap(table, frame)
    contract = dataset.contracts[table]
    refs = reference_errors(new, new.fks_touching(table), [table])
    out = [check_unique(frame, contract)] + ([refs] if refs is not None else [])
    return new, union_all(out)


def apply_upsert(dataset: Dataset, table: str, changes: DataFrame, order: str = "seq"):
    """`upsert` plus the reference check of everything the table touches."""
    new, results, errors = upsert(dataset.frames[table], changes, dataset.contracts[table], order)
    swapped, refs = reload_table(dataset, table, new)
    return swapped, results, errors.unionByName(refs)


def apply_delete(dataset: Dataset, table: str, ids: DataFrame):
    """`delete` plus the reference check, so references left dangling show up."""
    new, results = delete(dataset.frames[table], ids, dataset.contracts[table])
    swapped, refs = reload_table(dataset, table, new)
    return swapped, results, refs


def upsert_indexed(dataset: Dataset, index: ReferenceIndex, table: str, changes: DataFrame, version: int, order: str = "seq"):
    """`apply_upsert` of a dataset without repeated keys, checked by its reference index: (dataset, results, errors).

    References are looked up in the buckets of the keys that the change touches; no other table is read.  Reference errors
    are those of the whole dataset.
    """
    done = upsert_changes(dataset.frames[table], changes, dataset.contracts[table], order)
    index.change([(table, done.removed, done.added)], version)
    return dataset.swap(table, done.table), done.results, done.errors.unionByName(index.errors())


def delete_indexed(dataset: Dataset, index: ReferenceIndex, table: str, ids: DataFrame, version: int):
    """`apply_delete` checked by the reference index, see `upsert_indexed`."""
    df, contract = dataset.frames[table], dataset.contracts[table]
    new, results = delete(df, ids, contract)
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    removed = df.join(gone, pack_id(df.schema, contract.key) == F.col("_gone"), "left_semi")
    index.change([(table, removed, df.limit(0))], version)
    return dataset.swap(table, new), results, index.errors()


def reload_indexed(dataset: Dataset, index: ReferenceIndex, table: str, frame: DataFrame, version: int):
    """`reload_table` checked by the reference index: (dataset, errors).  Reads the old and the new table, no other."""
    contract = dataset.contracts[table]
    old, new = dataset.frames[table], dedup_last(frame, contract.key, contract.order)
    index.change([(table, old.exceptAll(new) if _comparable(old) else old, new.exceptAll(old) if _comparable(old) else new)], version)
    return dataset.swap(table, frame), check_unique(frame, contract).unionByName(index.errors())


def _comparable(df: DataFrame) -> bool:
    """Whether whole rows can be compared: maps and variants cannot."""
    return not any(t in df.schema.simpleString() for t in ("map<", "variant"))


def set_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Keyed side table ``(id, note)``: a new text replaces, an empty one removes."""
    last = changes.groupBy("id").agg(F.max_by("note", "seq").alias("note"))
    kept = notes.join(last, "id", "left_anti")
    return kept.unionByName(last.where(F.coalesce("note", F.lit("")) != ""))
