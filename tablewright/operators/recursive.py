"""Recursive values: opened level by level, typed by their contract, and put together again from below.

A recursive union is held as VARIANT, as its depth is the data's.  Its contract is a finite graph all the same: from a
union by ``$type`` to an implementation's fields, from a struct to its fields, from a list or map to what it holds.  Every
node carries its place in that graph down the levels, so leaves have their declared types, structs their foreign
keys.  Going back, a record's changed texts are put into its own text, and only for records in which a leaf changed.

Opening runs jobs: each level is written, so that deep values do not pile up in one plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract as C
from ..cluster import cut
from ..contract import union_all

#: Between the steps of a path; it stands in no field name.
STEP = "\u0001"


class Shape:
    """The types inside a recursive union: ``kinds`` by number, and where each step of a path leads.

    A step's name is ``number|implementation|field`` (lists and maps: ``number||``); it leads to ``s<number>``, or to the name of
    a primitive type, with ``^`` behind it if the field is lower-cased.
    """

    def __init__(self, root):
        self.kinds: list = []
        self.steps: dict[str, str] = {}
        self._number: dict[int, int] = {}
        self.root = self._of(root)

    def _of(self, kind, lower: bool = False) -> str:
        if isinstance(kind, str):
            return kind + ("^" if lower else "")
        if id(kind) not in self._number:
            n = self._number[id(kind)] = len(self.kinds)
            self.kinds.append(kind)
            if isinstance(kind, C.Union):
                for impl in kind.impls:
                    for name in {impl.name, f"{kind.name}.{impl.name}"}:
                        self._fields(n, name, impl)
            elif isinstance(kind, C.ListOf):
                self.steps[f"{n}||"] = self._of(kind.item)
            elif isinstance(kind, C.MapOf):
                # Entries are objects of a key and a value.
                self.steps[f"{n}||"] = self._of(C.Struct("entry", (C.Field("key", kind.key), C.Field("value", kind.value))))
            else:
                self._fields(n, "", kind)
        return f"s{self._number[id(kind)]}"

    def _fields(self, n: int, name: str, struct: C.Struct) -> None:
        for f in struct.fields:
            self.steps[f"{n}|{name}|{f.name}"] = self._of(f.type, f.lowercase)

    def structs(self):
        """(number, implementation name or None, struct) of all that can declare something."""
        for n, kind in enumerate(self.kinds):
            if isinstance(kind, C.Union):
                yield from ((n, impl.name, impl) for impl in kind.impls)
            elif isinstance(kind, C.Struct):
                yield n, None, kind

    def next(self, state: Column, impl: Column, field: Column) -> Column:
        """The state that a step leads to; null where the contract knows none."""
        if not self.steps:
            return F.lit(None).cast("string")
        table = F.create_map(*[F.lit(x) for pair in self.steps.items() for x in pair])
        n = F.substring(state, F.lit(2), F.length(state))
        named = F.when(F.col("_k") == "A", F.concat(n, F.lit("||"))).otherwise(F.concat_ws("|", n, F.coalesce(impl, F.lit("")), F.coalesce(field, F.lit(""))))
        return F.when(state.startswith("s"), table[named])


def opened(frame: DataFrame, names: Sequence[str], shape: Shape, path: Column) -> list[DataFrame]:
    """Levels of the values ``_v`` of a frame: ``names`` and (_at, _up, _step, _pos, _v, _s, _in, _k, _impl).

    ``_at`` and ``_up`` are the paths of a node and its parent, ``_s`` its state, ``_in`` whether the node around it is an object that the contract knows, ``_k`` O, A or L for objects, arrays and leaves,
    ``_impl`` an object's ``$type``.  Null values have no node.
    """
    level = frame.select(*names, path.alias("_at"), F.lit(None).cast("string").alias("_up"), F.lit(None).cast("string").alias("_step"),
                         F.lit(0).alias("_pos"), "_v", F.lit(shape.root).alias("_s"), F.lit(False).alias("_in")).where(F.col("_v").isNotNull())
    out = []
    while True:
        # The first character tells; a schema of all that is below would be made for every node.
        first = F.substring(F.to_json("_v"), 1, 1)
        letter = F.when(first == "{", "O").when(first == "[", "A").otherwise("L")
        impl = F.try_variant_get("_v", '$["$type"]', "string")
        level = cut(level.withColumn("_k", letter).withColumn("_impl", F.when(F.col("_k") == "O", impl)), f"level{len(out)}")
        out.append(level)
        nested = level.where("_k <> 'L'")
        if nested.isEmpty():
            return out
        steps = nested.lateralJoin(frame.sparkSession.tvf.variant_explode(F.col("_v").outer()).select(
            F.col("pos").alias("_p"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        steps = steps.where(F.col("_value").isNotNull())
        step = F.coalesce("_key", F.col("_p").cast("string"))
        plain = F.when(F.col("_s") == "", None).otherwise(F.col("_s"))
        impl = F.when(_is_union(shape, plain), F.col("_impl"))
        level = steps.select(*names, F.concat_ws(STEP, "_at", step).alias("_at"), F.col("_at").alias("_up"), step.alias("_step"),
                             F.col("_p").alias("_pos"), F.col("_value").alias("_v"),
                             F.coalesce(F.when(F.col("_key") == "$type", "tag").otherwise(shape.next(plain, impl, F.col("_key"))), F.lit("")).alias("_s"),
                             _is_known(shape).alias("_in"))


def _is_union(shape: Shape, state: Column) -> Column:
    unions = [f"s{n}" for n, kind in enumerate(shape.kinds) if isinstance(kind, C.Union)]
    return state.isin(*unions) if unions else F.lit(False)


def _is_known(shape: Shape) -> Column:
    """Whether a node is an object of a struct, or of a union's implementation, that the contract has."""
    known = F.lit(False)
    for n, k in enumerate(shape.kinds):
        if isinstance(k, C.Union):
            known = known | ((F.col("_s") == f"s{n}") & F.col("_impl").isin(*[x for i in k.impls for x in (i.name, f"{k.name}.{i.name}")]))
        elif isinstance(k, C.Struct):
            known = known | (F.col("_s") == f"s{n}")
    return F.coalesce((F.col("_k") == "O") & known, F.lit(False))


def leaves_of(levels: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """``names`` and (_at, type, lower, _v) of every leaf; a leaf that the contract does not know is typed by its value."""
    found = union_all(level.where("_k = 'L'") for level in levels)
    kind = F.coalesce(F.schema_of_variant("_v"), F.lit("VOID"))
    own = (F.when(kind.startswith("BIGINT"), "long").when(kind.rlike("^(DOUBLE|DECIMAL|FLOAT)"), "float").when(kind == "BOOLEAN", "bool")
           .when(kind == "VOID", None).otherwise("str"))
    said = F.rtrim(F.replace("_s", F.lit("^"), F.lit("")))
    # A declared type counts if the value is one of it.
    fits = F.when(kind == "STRING", said.isin("str", "text")).otherwise(said.isin("bool", "int", "long", "float"))
    return found.select(*names, "_at", F.when(fits, said).otherwise(own).alias("type"), F.col("_s").endswith("^").alias("lower"), "_v").where(
        "type is not null")


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def _with_texts(text: str, new: dict[str, str], root: str) -> str:
    """JSON with the texts at some paths replaced; all else, numbers included, stays as it is written."""
    out, path, inside, key = [], [root], [], False
    for token in _TOKEN.findall(text):
        if token in "{[":
            out.append(token)
            inside.append(token)
            path.append("0" if token == "[" else "")
            key = token == "{"
        elif token in "}]":
            out.append(token)
            inside.pop()
            path.pop()
            key = False
        elif token == ",":
            out.append(token)
            key = inside[-1] == "{"
            if not key:
                path[-1] = str(int(path[-1]) + 1)
        elif key:
            out.append(token)
            path[-1], key = json.loads(token) if "\\" in token else token[1:-1], False
        elif token[0] == '"' and (said := new.get(STEP.join(path))) is not None:
            out.append(json.dumps(said))
        else:
            out.append(token)
    return "".join(out)


def _float(text: str):
    raise ValueError(text)


def _put(text: str, new: dict[str, str], root: str) -> str:
    """`_with_texts`, by the JSON module where the value has no fractions and is not too deep."""
    try:
        value = json.loads(text, parse_float=_float)
        for path, said in new.items():
            node, steps = value, path.split(STEP)[1:]
            for step in steps[:-1]:
                node = node[int(step)] if isinstance(node, list) else node[step]
            last = int(steps[-1]) if isinstance(node, list) else steps[-1]
            if not isinstance(node[last], str):
                raise KeyError(path)
            node[last] = said
        return json.dumps(value, separators=(",", ":"))
    except (ValueError, LookupError, TypeError, RecursionError):
        return _with_texts(text, new, root)


def _edited(root: str) -> Callable[[pd.Series, pd.Series, pd.Series], pd.Series]:
    def edit(texts: pd.Series, at: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _put(t, dict(zip(a, n)), root) for t, a, n in zip(texts, at, new)], dtype=object)
    return edit


def rewritten(df: DataFrame, column: str, kind: C.Union, change: Callable[[DataFrame], DataFrame], keep: Sequence[str] = ()) -> DataFrame:
    """``df`` with the leaves of a VARIANT column replaced.

    ``change`` gets (_rid, _at, ``keep``, field_chain, type, lower, value) of all leaves, ``field_chain`` with the column's name in front, and
    gives back (_rid, _at, new) of those texts that change.  Rows without a change, and null values, stay as they are.  A record's
    new texts come back to it as one list, in one shuffle of what changes and one of the rows.
    """
    rows = cut(df.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    names = ["_rid", *keep]
    levels = opened(rows.select(*names, F.col(column).alias("_v")), names, Shape(kind), F.lit(column))
    leaves = leaves_of(levels, names)
    chain = F.replace("_at", F.lit(STEP), F.lit("."))
    named = leaves.select(*names, "_at", chain.alias("field_chain"), "type", "lower", F.try_variant_get("_v", "$", "string").alias("value"))
    new = change(named.where("value is not null"))
    edits = new.groupBy("_rid").agg(F.collect_list(F.struct("_at", "new")).alias("_edits"))
    # Files of a few repeated texts are tiny, what they hold is not: no such list goes through the driver.
    both = rows.join(edits.hint("merge"), "_rid", "left")
    edit = F.pandas_udf(_edited(column), "string")
    made = both.withColumn("_made", edit(F.when(F.col("_edits").isNotNull(), F.to_json(column)), "_edits._at", "_edits.new"))
    # Written, as whoever reads parts of the value would have it made again for each.
    return cut(made.select(*[F.coalesce(F.parse_json("_made"), column).alias(c) if c == column else F.col(c) for c in df.columns]), "rewritten")


def lowered(df: DataFrame, column: str, kind: C.Union) -> DataFrame:
    """Texts of lower-cased fields in lower case."""
    return rewritten(df, column, kind, lambda leaves: leaves.where("lower and value <> lower(value)").withColumn("new", F.lower("value")))


def issues_of(levels: Sequence[DataFrame], names: Sequence[str], shape: Shape) -> DataFrame:
    """``names`` and (kind, field, value, level) of every node that is not what the contract says, at any depth.

    Wrong types, objects of a union without ``$type`` or of an unknown one, and, as warnings, members that the contract does not have.
    """
    every = union_all(levels)
    path = F.replace("_at", F.lit(STEP), F.lit("."))
    # Of objects and arrays the letter says all that is asked; their schema would go through all that is below.
    kind = F.when(F.col("_k") == "L", F.coalesce(F.schema_of_variant("_v"), F.lit("VOID"))).otherwise("OBJECT")
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    whole = lambda to: F.try_variant_get("_v", "$", "double").try_cast(to).isNotNull()
    said = F.replace("_s", F.lit("^"), F.lit(""))
    fits = (F.when(said == "bool", (kind == "BOOLEAN") | number).when(said == "int", number & whole("int"))
            .when(said == "long", number & whole("bigint")).when(said == "float", number).when(said.isin("str", "text"), kind == "STRING"))
    objects, arrays, unions = [], [], []
    for n, k in enumerate(shape.kinds):
        (unions if isinstance(k, C.Union) else arrays if isinstance(k, (C.ListOf, C.MapOf)) else objects).append(f"s{n}")
    fits = F.when(said.isin(*objects, *unions), F.col("_k") == "O").when(said.isin(*arrays), F.col("_k") == "A").otherwise(fits)
    here = every.where((F.col("_s") != "") & (F.col("_s") != "tag") & (kind != "VOID"))
    wrong = here.where(~fits).select(*names, F.lit(C.JSON_VALUE_MISMATCH).alias("kind"), path.alias("field"), F.to_json("_v").alias("value"),
                                     F.lit("error").alias("level"))
    tagged = here.where(F.col("_s").isin(*unions) & (F.col("_k") == "O") & ~_is_known(shape))
    tags = tagged.select(*names, F.when(F.col("_impl").isNull(), C.JSON_TYPE_MISSING).otherwise(C.JSON_TYPE_MISMATCH).alias("kind"),
                         path.alias("field"), F.coalesce("_impl", F.lit("")).alias("value"), F.lit("error").alias("level"))
    # Below what is wrong already nothing is known, and nothing more is said.
    extra = (every.where(F.col("_in") & (F.col("_s") == "") & ~F.col("_step").isin("$note", "$fold", "$refs") & ~F.col("_step").startswith("$embed_"))
             .groupBy(*names, "_up").agg(F.array_join(F.array_sort(F.collect_set("_step")), ",").alias("value")))
    rest = extra.select(*names, F.lit(C.JSON_EXTRA).alias("kind"), F.replace("_up", F.lit(STEP), F.lit(".")).alias("field"), "value",
                        F.lit("warning").alias("level"))
    return wrong.unionByName(tags).unionByName(rest)
