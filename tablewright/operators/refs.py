"""Resolving references and walking the record graph."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract as C
from ..cluster import cut
from ..contract import Dataset, ForeignKey, TableContract, union_all
from ..functions.scalars import pack_id, pack_value
from .checks import _match, dedup_last, entries_to_map, key_value, nested_structs
from .records import brief, brief_title, get_record

EDGE_SCHEMA = ("from_table string, from_id string, fk string, field string, label string, "
               "to_table string, to_id string")


def deduplicated(dataset: Dataset) -> Dataset:
    """Every table reduced to its last row per key; the graph is defined on those."""
    names = dataset.names()
    with ThreadPoolExecutor(max_workers=8) as pool:
        frames = list(pool.map(lambda n: dedup_last(
            dataset.frames[n], dataset.contracts[n].key, dataset.contracts[n].order), names))
    return Dataset(dataset.contracts, dict(zip(names, frames)))


def resolve_ref(df: DataFrame, contract: TableContract, fk: ForeignKey, target: DataFrame,
                name: str | None = None) -> DataFrame:
    """Attach the target row: a struct or NULL; an array in list order; or map key -> row.

    The target is keyed uniquely by ``fk.ref_keys``.  Items without a target are left out.
    """
    name = name or f"ref_{fk.name}"
    refs = target.select(*[key_value(F.col(k), target.schema[k].dataType).alias(f"_r{i}")
                           for i, k in enumerate(fk.ref_keys)], F.struct(*target.columns).alias(name))
    first = df.schema[fk.keys[0]].dataType
    if not isinstance(first, (T.ArrayType, T.MapType)):
        on = [key_value(df[k], df.schema[k].dataType) == refs[f"_r{i}"] for i, k in enumerate(fk.keys)]
        return df.join(refs, on, "left").drop(*[f"_r{i}" for i in range(len(fk.keys))])
    is_map = isinstance(first, T.MapType) or isinstance(contract.field(fk.keys[0]).type, C.MapOf)
    if is_map:
        source = F.map_entries(F.col(fk.keys[0]) if isinstance(first, T.MapType) else entries_to_map(F.col(fk.keys[0])))
        items = df.select(*contract.key, F.posexplode(source).alias("_i", "_e"))
        items = items.select(*contract.key, "_i", F.col("_e.key").alias("_key"), F.col("_e.value").alias("_v"))
        found = items.join(refs, F.col("_v") == F.col("_r0")).select(
            *contract.key, F.struct("_i", F.struct(F.col("_key").alias("key"), F.col(name).alias("value")).alias("x")).alias("_x"))
    else:
        items = df.select(*contract.key, F.posexplode(fk.keys[0]).alias("_i", "_v"))
        found = items.join(refs, F.col("_v") == F.col("_r0")).select(
            *contract.key, F.struct("_i", F.col(name).alias("x")).alias("_x"))
    # One group is one record's own list, already a single value of the input row.
    grouped = found.groupBy(*contract.key).agg(
        F.transform(F.array_sort(F.collect_list("_x"), lambda a, b: a["_i"] - b["_i"]), lambda x: x["x"]).alias("_items"))
    out = _match(df, grouped, contract.key, "left")
    empty = F.array().cast(grouped.schema["_items"].dataType)
    filled = F.coalesce(F.col("_items"), empty)
    return out.withColumn(name, F.map_from_entries(filled) if is_map else filled).drop("_items")


def resolve_ref_list(df: DataFrame, fk: ForeignKey, target: DataFrame, name: str | None = None,
                     nested: Sequence[str] | None = None) -> DataFrame:
    """All target rows whose field equals the local key, one output row per match; a
    record without matches stays with a NULL target.

    ``nested`` names the target columns to order by and folds the matches into an array;
    use it only where every group fits one row.
    """
    name = name or f"ref_{fk.name}"
    refs = target.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(fk.ref_keys)],
                         F.struct(*target.columns).alias(name))
    keys = [f"_r{i}" for i in range(len(fk.ref_keys))]
    if nested is None:
        # An inner join may split a hot key on either side, an outer one may not.
        on = [df[k] == refs[r] for k, r in zip(fk.keys, keys)]
        hits = df.join(refs, on).drop(*keys)
        have = refs.select(*[F.col(r).alias(f"{r}d") for r in keys]).distinct()
        alone = df.join(have, [df[k] == have[f"{r}d"] for k, r in zip(fk.keys, keys)], "left_anti")
        return hits.unionByName(alone.withColumn(name, F.lit(None).cast(hits.schema[name].dataType)))
    ordered = F.struct(*[F.col(name)[c].alias(f"o{i}") for i, c in enumerate(nested)], F.col(name).alias("x"))
    refs = refs.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(ordered)), lambda e: e["x"]).alias(name))
    on = [df[k] == refs[r] for k, r in zip(fk.keys, keys)]
    out = df.join(refs, on, "left").drop(*keys)
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)))


# ------------------------------------------------------------------ edges

def _label(fk: ForeignKey, prefix: Column | None, schema: T.StructType, base: Column | None = None) -> Column:
    word = ("nullableRef" if fk.nullable else "ref") + fk.name[:1].upper() + fk.name[1:]
    default = F.lit(word) if prefix is None else F.concat(prefix, F.lit("." + word))
    if fk.title and fk.title in schema.names:
        return base[fk.title] if base is not None else F.col(fk.title)
    return default


def _edges_of(rows: DataFrame, values: list[Column], label: Column, field: str, fk: ForeignKey,
              name: str, target: DataFrame, target_contract: TableContract, trust: bool = False,
              ends: bool = False) -> DataFrame:
    """Edges of one foreign key; dangling keys fall out of the inner join.

    With ``trust`` the caller matches ``to_id`` with known records itself, so a primary
    key needs no join here.  With ``ends`` only the records they lead to come back; each
    key crosses the network once per task.
    """
    if trust and fk.ref_keys == target_contract.key:
        packed = rows.select("_id", label.alias("label"), *[v.alias(f"_v{i}") for i, v in enumerate(values)])
        return packed.select(
            F.lit(name).alias("from_table"), F.col("_id").alias("from_id"), F.lit(fk.name).alias("fk"),
            F.lit(field).alias("field"), "label", F.lit(fk.ref_table).alias("to_table"),
            pack_id(packed.schema, [f"_v{i}" for i in range(len(values))]).alias("to_id"))
    own = rows.select("_id", label.alias("label"), *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    to_id = pack_id(target.schema, target_contract.key)
    refs = target.select(*[key_value(F.col(k), target.schema[k].dataType).alias(f"_r{i}")
                           for i, k in enumerate(fk.ref_keys)], to_id.alias("to_id")).distinct()
    if ends:
        own = own.drop("_id", "label").distinct()
    on = [own[f"_v{i}"] == refs[f"_r{i}"] for i in range(len(values))]
    if ends:
        return own.join(refs, on).select(F.lit(fk.ref_table).alias("to_table"), "to_id")
    return own.join(refs, on).select(
        F.lit(name).alias("from_table"), F.col("_id").alias("from_id"), F.lit(fk.name).alias("fk"),
        F.lit(field).alias("field"), "label", F.lit(fk.ref_table).alias("to_table"), "to_id")


def _fk_values(rows: DataFrame, at: Column | None, fk: ForeignKey, kind) -> tuple[DataFrame, list[Column]]:
    """Rows and the reference key of each, lists and map values exploded."""
    get = (lambda k: F.col(k)) if at is None else (lambda k: at[k])
    schema = rows.schema if at is None else rows.schema["_node"].dataType
    dtype = schema[fk.keys[0]].dataType
    if isinstance(dtype, T.MapType):
        rows = rows.withColumn("_x", F.explode(F.map_values(get(fk.keys[0]))))
        return rows, [key_value(F.col("_x"), dtype.valueType)]
    if isinstance(dtype, T.ArrayType):
        if isinstance(kind, C.MapOf):
            rows = rows.withColumn("_x", F.explode(F.map_values(entries_to_map(get(fk.keys[0])))))
            return rows, [key_value(F.col("_x"), dtype.elementType["value"].dataType)]
        rows = rows.withColumn("_x", F.explode(get(fk.keys[0])))
        return rows, [key_value(F.col("_x"), dtype.elementType)]
    return rows, [key_value(get(k), schema[k].dataType) for k in fk.keys]


def ref_edges(dataset: Dataset, to_table: str | None = None, from_tables: Sequence[str] | None = None,
              to_many: bool = False, trust: bool = False, ends: bool = False) -> DataFrame:
    """Every outgoing edge of every record, nested structs included; with ``ends`` just their ``to_table`` and ``to_id``.

    Only foreign keys that can produce wanted edges are planned.  References to many
    rows give no edges unless ``to_many`` asks for those whose key identifies a record.
    """
    out = []
    for name in dataset.names():
        if from_tables is not None and name not in from_tables:
            continue
        df, contract = dataset.frames[name], dataset.contracts[name]

        def wanted(fk):
            if fk.ref_table not in dataset.frames or (to_table and fk.ref_table != to_table):
                return False
            goal = dataset.contracts[fk.ref_table]
            return not fk.to_many or (to_many and (fk.ref_keys == goal.key or fk.ref_keys in goal.uniques))

        base = df.withColumn("_id", pack_id(df.schema, contract.key))
        for fk in filter(wanted, contract.fks):
            rows, values = _fk_values(base, None, fk, contract.field(fk.keys[0]).type)
            out.append(_edges_of(rows, values, _label(fk, None, df.schema), fk.keys[0], fk, name,
                                 dataset.frames[fk.ref_table], dataset.contracts[fk.ref_table], trust, ends))
        if all(isinstance(f.type, str) for f in contract.fields):
            continue
        for struct, frame in nested_structs(df, contract, [pack_id(df.schema, contract.key).alias("_id")]):
            for fk in filter(wanted, struct.fks):
                rows, values = _fk_values(frame, F.col("_node"), fk, struct.field(fk.keys[0]).type)
                label = _label(fk, F.col("_path"), frame.schema["_node"].dataType, F.col("_node"))
                out.append(_edges_of(rows, values, label, fk.keys[0], fk, name,
                                     dataset.frames[fk.ref_table], dataset.contracts[fk.ref_table], trust, ends))
    if out:
        return union_all(out)
    spark = next(iter(dataset.frames.values())).sparkSession
    return spark.createDataFrame([], EDGE_SCHEMA)


def refs_in(dataset: Dataset, table: str, ids: DataFrame) -> DataFrame:
    """Edges that end at the given records (``ids`` has column ``id``)."""
    edges = ref_edges(dataset, to_table=table, to_many=True, trust=True)
    df = dataset.frames[table]
    have = df.select(pack_id(df.schema, dataset.contracts[table].key).alias("to_id"))
    wanted = have.join(ids.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")
    return edges.join(wanted, "to_id", "left_semi").select(*edges.columns)


def has_reference(dataset: Dataset, table: str) -> DataFrame:
    """``(id, referenced)`` for every record of the table."""
    df, contract = dataset.frames[table], dataset.contracts[table]
    ids = df.select(*_incoming_keys(dataset, table), pack_id(df.schema, contract.key).alias("_id"))
    loose = _anti_referenced(dataset, table, ids).select(F.col("_id").alias("_loose"))
    return ids.select("_id").join(loose, F.col("_id") == F.col("_loose"), "left").select(
        F.col("_id").alias("id"), F.col("_loose").isNull().alias("referenced"))


def _anti_referenced(dataset: Dataset, table: str, rows: DataFrame) -> DataFrame:
    """Rows of ``table`` nobody points at, by one narrow anti join per incoming key.

    The pointing side is reduced to distinct keys first, so a target that a third of
    all rows point at is shuffled as one row per task.
    """
    contract = dataset.contracts[table]
    for name in dataset.names():
        df, source = dataset.frames[name], dataset.contracts[name]
        found = []
        for fk in source.fks:
            if fk.ref_table == table:
                found.append((fk, *_fk_values(df, None, fk, source.field(fk.keys[0]).type)))
        if not all(isinstance(f.type, str) for f in source.fields):
            for struct, frame in nested_structs(df, source, []):
                found += [(fk, *_fk_values(frame, F.col("_node"), fk, struct.field(fk.keys[0]).type))
                          for fk in struct.fks if fk.ref_table == table]
        for fk, keyed, values in found:
            if fk.to_many and fk.ref_keys != contract.key and fk.ref_keys not in contract.uniques:
                continue
            uses = keyed.select(*[v.alias(f"_v{i}") for i, v in enumerate(values)]).distinct()
            target = dataset.frames[table]
            on = [key_value(rows[k], target.schema[k].dataType) == uses[f"_v{i}"] for i, k in enumerate(fk.ref_keys)]
            rows = rows.join(uses, on, "left_anti")
    return rows


def unreferenced(dataset: Dataset, tables: Sequence[str] | None = None) -> DataFrame:
    """``(table, id)`` of records no one points at (one hop).

    Root and enum tables are skipped, and so are records that are entry points.
    """
    out = []
    for name in tables if tables is not None else dataset.names():
        df, contract = dataset.frames[name], dataset.contracts[name]
        if contract.is_root or contract.is_enum:
            continue
        rows = df.where(F.coalesce(F.col(contract.entry), F.lit("")) == "") if contract.entry else df
        keep = _incoming_keys(dataset, name)
        rows = rows.select(*keep, pack_id(df.schema, contract.key).alias("_id"))
        out.append(_anti_referenced(dataset, name, rows).select(F.lit(name).alias("table"), F.col("_id").alias("id")))
    return union_all(out) if out else _no_ids(dataset)


def _no_ids(dataset: Dataset) -> DataFrame:
    spark = next(iter(dataset.frames.values())).sparkSession
    return spark.createDataFrame([], "`table` string, id string")


def _incoming_keys(dataset: Dataset, table: str) -> list[str]:
    """Key columns of a table and the columns that references to it use."""
    fks = [fk for _, fk in dataset.fks()] + [fk for n in dataset.names() for fk in _nested_fks(dataset, n)]
    return list(dict.fromkeys([*dataset.contracts[table].key, *[k for fk in fks if fk.ref_table == table for k in fk.ref_keys]]))


def entry_records(dataset: Dataset) -> DataFrame:
    """``(table, kind, id)`` of the entry points: root and enum tables whole, other
    tables where the entry field is filled."""
    out = []
    for name in dataset.names():
        df, contract = dataset.frames[name], dataset.contracts[name]
        kind = "ROOT" if contract.is_root else "ENUM" if contract.is_enum else "ENTRY" if contract.entry else None
        if kind is None:
            continue
        rows = df if kind != "ENTRY" else df.where(F.coalesce(F.col(contract.entry), F.lit("")) != "")
        out.append(rows.select(F.lit(name).alias("table"), F.lit(kind).alias("kind"),
                               pack_id(df.schema, contract.key).alias("id")))
    if not out:
        spark = next(iter(dataset.frames.values())).sparkSession
        return spark.createDataFrame([], "`table` string, kind string, id string")
    return union_all(out)


def entry_counts(dataset: Dataset) -> DataFrame:
    """Entry points per table with a grand total (table NULL)."""
    return entry_records(dataset).rollup("table").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ walks

def _next_layer(edges: DataFrame, frontier: DataFrame, seen: DataFrame, backwards: bool, more: DataFrame | None = None) -> DataFrame:
    a, b = ("to", "from") if backwards else ("from", "to")
    hops = edges.join(frontier, (edges[f"{a}_table"] == frontier["table"]) & (edges[f"{a}_id"] == frontier["id"]),
                      "left_semi")
    found = hops.select(F.col(f"{b}_table").alias("table"), F.col(f"{b}_id").alias("id"))
    found = (found if more is None else found.unionByName(more)).distinct()
    return found.join(seen, ["table", "id"], "left_anti")


def _walk(edges: DataFrame, frontier: DataFrame, backwards: bool, limit: int | None, label: str, more: DataFrame | None = None):
    """Breadth-first layers from ``frontier`` (table, id); each id appears once.  ``more`` goes into the first layer.

    Every layer is written out: the plan stays flat, cycles end because known ids are
    anti-joined away, and small layers are broadcast by their measured size.
    """
    seen, depth = frontier, 0
    while limit is None or depth < limit:
        depth += 1
        # At most one row per table; edges of other tables are not even read.
        tables = [r[0] for r in frontier.select("table").distinct().collect()]
        near = edges.where(F.col("to_table" if backwards else "from_table").isin(tables))
        frontier = cut(_next_layer(near, frontier, seen, backwards, more if depth == 1 else None), f"{label}{depth}")
        if frontier.isEmpty():
            return
        yield depth, frontier
        # Layers are disjoint files already; their union is read, not recomputed.
        seen = seen.unionByName(frontier)


def reachable_from_entries(dataset: Dataset) -> DataFrame:
    """``(table, id, depth)`` of everything reachable over outgoing edges from entry points.

    Root and enum tables are entry points with all their records: none of them is found later, and their edges all count for the
    first layer, so neither these edges nor the records are compared by id.  Only the columns that link records are
    written, once, as a table is read for every reference from and to it.
    """
    contracts = dataset.contracts
    dataset = Dataset(contracts, {n: cut(_links(dataset, n), "links") for n in dataset.names()})
    whole = [n for n in dataset.names() if contracts[n].is_root or contracts[n].is_enum]
    others = [n for n in dataset.names() if n not in whole]
    start = cut(entry_records(dataset).select("table", "id").distinct(), "entries")
    edges = cut(ref_edges(dataset, from_tables=others).select("from_table", "from_id", "to_table", "to_id"), "edges", by="from_table")
    known = F.col("table").isin(whole)
    ends = ref_edges(dataset, from_tables=whole, ends=True).select(F.col("to_table").alias("table"), F.col("to_id").alias("id"))
    # The targets of whole tables among them have been there from the start; this holds for later layers, too.
    edges, ends = edges.where(~F.col("to_table").isin(whole)), ends.where(~known)
    layers = [start.withColumn("depth", F.lit(0))]
    layers += [layer.withColumn("depth", F.lit(d)) for d, layer in _walk(edges, start.where(~known), False, None, "reach", ends)]
    return union_all(layers)


def _links(dataset: Dataset, name: str) -> DataFrame:
    """The columns of a table that identify its records, make them entry points or refer to others."""
    contract, df = dataset.contracts[name], dataset.frames[name]
    wanted = {*_incoming_keys(dataset, name), contract.entry, *(k for fk in contract.fks for k in fk.keys),
              *(f.name for f in contract.fields if not isinstance(f.type, str))}
    return df.select(*[c for c in df.columns if c in wanted])


def _titles(dataset: Dataset, nodes: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Add the brief title of each (table, id)."""
    out = []
    for name in tables:
        df, contract = dataset.frames[name], dataset.contracts[name]
        names = df.select(pack_id(df.schema, contract.key).alias("_id"), brief_title(contract).alias("title"))
        mine = nodes.where(F.col("table") == name)
        # Inner: an id without a record is not a node.
        out.append(mine.join(names, mine["id"] == names["_id"]).drop("_id"))
    return union_all(out)


def neighbourhood(dataset: Dataset, table: str, record_id: str, in_depth: int, out_depth: int,
                  max_records: int) -> DataFrame:
    """``(table, id, title, depth)`` around one record: negative depth for incoming
    layers, 0 for itself, positive for outgoing ones; each record once.

    The walk stops with the layer that passes ``max_records``; at most
    ``max_records + 1`` rows come back, nearest incoming first, then outgoing.
    """
    nodes, tables = _neighbours(dataset, table, record_id, in_depth, out_depth, max_records)
    return _nearest(_titles(dataset, nodes, tables), max_records).select("table", "id", "title", "depth")


def _nearest(nodes: DataFrame, max_records: int) -> DataFrame:
    return nodes.orderBy(F.col("depth") > 0, F.abs("depth"), "table", "id").limit(max_records + 1)


def _neighbours(dataset: Dataset, table: str, record_id: str, in_depth: int, out_depth: int,
                max_records: int) -> tuple[DataFrame, list[str]]:
    """(nodes ``(table, id, depth)``, tables they can be in)."""
    if in_depth < 0 or out_depth < 0 or max_records <= 0:
        raise ValueError("depths must not be negative and max_records must be positive")
    if table not in dataset.frames:
        raise KeyError(table)
    df, contract = dataset.frames[table], dataset.contracts[table]
    start = cut(df.where(pack_id(df.schema, contract.key) == record_id).select(
        F.lit(table).alias("table"), F.lit(record_id).alias("id")).distinct(), "start")
    layers, total = [start.withColumn("depth", F.lit(0))], 1
    seen, visited = start, {table}
    for backwards, depth_limit in ((True, in_depth), (False, out_depth)):
        frontier, tables = start, [table]
        for depth in range(1, depth_limit + 1):
            if total > max_records or not tables:
                break
            # The static table graph says which foreign keys this layer can use at all.
            if backwards:
                parts = [ref_edges(dataset, to_table=t, to_many=True, trust=True) for t in tables]
                tables = sorted({n for n, fk in dataset.fks() if fk.ref_table in tables} | _nested_sources(dataset, tables))
            else:
                parts = [ref_edges(dataset, from_tables=tables)]
                tables = sorted({fk.ref_table for n, fk in dataset.fks() if n in tables} | _nested_targets(dataset, tables))
            edges = union_all(parts)
            frontier = cut(_next_layer(edges, frontier, seen, backwards), "layer")
            size = frontier.count()
            if not size:
                break
            visited.update(tables)
            seen = seen.unionByName(frontier)
            total += size
            layers.append(frontier.withColumn("depth", F.lit(-depth if backwards else depth)))
    return union_all(layers), sorted(visited)


def _nested_fks(dataset: Dataset, name: str):
    return [fk for struct in C.structs_of(dataset.contracts[name]) for fk in struct.fks]


def _nested_sources(dataset, tables):
    return {n for n in dataset.names() if any(fk.ref_table in tables for fk in _nested_fks(dataset, n))}


def _nested_targets(dataset, tables):
    return {fk.ref_table for n in tables for fk in _nested_fks(dataset, n) if fk.ref_table in dataset.frames}


def record_with_refs(dataset: Dataset, table: str, record_id: str, depth: int = 1, incoming: bool = False,
                     max_records: int = 1000) -> DataFrame:
    """The record and what it refers to, down to ``depth``, each with title, descriptions
    and its own outgoing edges; ``incoming`` adds the records that point at it directly."""
    nodes, tables = _neighbours(dataset, table, record_id, 1 if incoming else 0, depth, max_records)
    nodes = cut(_nearest(nodes, max_records), "nodes")
    details = []
    for n in tables:
        mine = brief(dataset.frames[n], dataset.contracts[n]).select(F.lit(n).alias("table"), "id", "title", "descriptions")
        details.append(nodes.where(F.col("table") == n).join(mine.drop("table"), "id"))
    edges = ref_edges(dataset, from_tables=tables)
    edges = edges.join(nodes, (edges["from_table"] == nodes["table"]) & (edges["from_id"] == nodes["id"]), "left_semi")
    # One group is the outgoing side of one record, as wide as the record itself.
    own = edges.groupBy("from_table", "from_id").agg(
        F.sort_array(F.collect_list(F.struct("field", "label", "to_table", "to_id"))).alias("refs"))
    out = union_all(details).join(
        own, (F.col("table") == F.col("from_table")) & (F.col("id") == F.col("from_id")), "left")
    return out.select("table", "id", "depth", "title", "descriptions", "refs")


def lookup_status(dataset: Dataset, table: str | None, record_id: str | None) -> str:
    """Result code for a record query: ok or what is wrong with the arguments."""
    if not table:
        return "tableNotSet"
    if not record_id:
        return "idNotSet"
    if table not in dataset.frames:
        return "tableNotFound"
    try:
        rows = get_record(dataset.frames[table], dataset.contracts[table], record_id)
    except ValueError:
        return "idParseErr"
    return "idNotFound" if rows.isEmpty() else "ok"


def table_graph(dataset: Dataset) -> DataFrame:
    """Per foreign key: references, distinct targets, dangling ones and largest fan-in; keys inside records included.

    Keys are counted before the join, so each key crosses the network once per task.
    """
    out = []

    def measured(name: str, fk: ForeignKey, rows: DataFrame, values: list[Column]) -> DataFrame:
        target = dataset.frames[fk.ref_table]
        keys = rows.select(*[v.alias(f"_v{i}") for i, v in enumerate(values)])
        counts = keys.groupBy(*keys.columns).agg(F.count("*").alias("_n"))
        refs = target.select(*[key_value(F.col(k), target.schema[k].dataType).alias(f"_r{i}")
                               for i, k in enumerate(fk.ref_keys)]).distinct()
        joined = counts.join(refs, [counts[f"_v{i}"] == refs[f"_r{i}"] for i in range(len(values))], "left")
        hit = F.col("_r0").isNotNull()
        return joined.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n_refs"),
            F.count_if(hit).alias("n_targets"),
            F.coalesce(F.sum(F.when(~hit, F.col("_n"))), F.lit(0)).alias("n_dangling"),
            F.coalesce(F.max(F.when(hit, F.col("_n"))), F.lit(0)).alias("max_fan_in"),
        ).select(F.lit(name).alias("from_table"), F.lit(fk.name).alias("fk"), F.lit(fk.ref_table).alias("to_table"),
                 "n_refs", "n_targets", "n_dangling", "max_fan_in")

    for name, fk in dataset.fks():
        if not fk.to_many:
            df, contract = dataset.frames[name], dataset.contracts[name]
            out.append(measured(name, fk, *_fk_values(df, None, fk, contract.field(fk.keys[0]).type)))
    for name in dataset.names():
        wanted = [fk for fk in _nested_fks(dataset, name) if not fk.to_many and fk.ref_table in dataset.frames]
        if wanted:
            for struct, frame in nested_structs(dataset.frames[name], dataset.contracts[name], []):
                out += [measured(name, fk, *_fk_values(frame, F.col("_node"), fk, struct.field(fk.keys[0]).type))
                        for fk in struct.fks if fk in wanted]
    return union_all(out)


def reconcile_assets(assets: DataFrame, records: DataFrame, min_assets: int = 8) -> DataFrame:
    """``assets(table, id)`` against ``records(table, id)``: ``noCfg`` for an asset without
    a record, ``noRes`` for a record without an asset, ``ok`` for a pair.

    Tables with ``min_assets`` or fewer distinct assets are not compared at all.
    """
    mine = assets.select("table", "id").distinct()
    enough = mine.groupBy("table").agg(F.count("*").alias("_n")).where(F.col("_n") > min_assets).select("table")
    a = mine.join(enough, "table", "left_semi").withColumn("_a", F.lit(True))
    r = records.select("table", "id").distinct().join(enough, "table", "left_semi").withColumn("_r", F.lit(True))
    state = F.when(F.col("_r").isNull(), "noCfg").when(F.col("_a").isNull(), "noRes").otherwise("ok")
    return a.join(r, ["table", "id"], "full_outer").select("table", "id", state.alias("status"))


def recent_records(dataset: Dataset, modified: dict[str, str], n: int = 20) -> DataFrame:
    """The ``n`` last modified records with their titles; ``modified`` names each table's
    time column."""
    out = []
    for name, column in modified.items():
        df, contract = dataset.frames[name], dataset.contracts[name]
        out.append(df.select(F.lit(name).alias("table"), pack_id(df.schema, contract.key).alias("id"),
                             brief_title(contract).alias("title"), F.col(column).cast("timestamp_ntz").alias("modified")))
    return union_all(out).orderBy(F.desc("modified"), "table", "id").limit(n)
