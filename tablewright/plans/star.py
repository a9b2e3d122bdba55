"""Contracts of the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import Dataset, Field, ForeignKey, TableContract


def fk(keys, table, ref, **kw) -> ForeignKey:
    keys, ref = keys.split(","), ref.split(",")
    return ForeignKey(kw.pop("name", "_".join(keys)), tuple(keys), table, tuple(ref), **kw)


def fields(spec: str) -> tuple[Field, ...]:
    return tuple(Field(*pair.split(":")) for pair in spec.split())


REGION = TableContract("region", ("r_regionkey",), fields("r_regionkey:int r_name:str"),
                       entry="r_name", is_enum=True, is_root=False, title="r_name")
NATION = TableContract("nation", ("n_nationkey",), fields("n_nationkey:int n_name:str n_regionkey:int"),
                       (fk("n_regionkey", "region", "r_regionkey"),), entry="n_name", title="n_name",
                       description=("n_name", "n_regionkey"))
CUSTOMER = TableContract("customer", ("c_custkey",),
                         fields("c_custkey:long c_name:str c_nationkey:int c_acctbal:float c_mktsegment:str"),
                         (fk("c_nationkey", "nation", "n_nationkey"),), title="c_name")
SUPPLIER = TableContract("supplier", ("s_suppkey",), fields("s_suppkey:long s_name:str s_nationkey:int s_acctbal:float"),
                         (fk("s_nationkey", "nation", "n_nationkey"),), title="s_name")
PART = TableContract("part", ("p_partkey",),
                     fields("p_partkey:long p_name:str p_brand:str p_type:str p_size:int p_retailprice:float"),
                     title="p_name")
ORDERS = TableContract("orders", ("o_orderkey",),
                       fields("o_orderkey:long o_custkey:long o_orderstatus:str o_totalprice:float "
                              "o_orderdate:str o_orderpriority:str"),
                       (fk("o_custkey", "customer", "c_custkey"),), title="o_orderpriority")
LINEITEM = TableContract("lineitem", ("l_orderkey", "l_linenumber"),
                         fields("l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int l_quantity:float "
                                "l_extendedprice:float l_discount:float l_tax:float l_returnflag:str "
                                "l_linestatus:str l_shipdate:str"),
                         (fk("l_orderkey", "orders", "o_orderkey"), fk("l_partkey", "part", "p_partkey"),
                          fk("l_suppkey", "supplier", "s_suppkey")))
DOCUMENTS = TableContract("documents", ("doc_id",), fields("doc_id:long text:text lang:str source:str n_chars:long"),
                          title="source")
LABELS = TableContract("labels", ("doc_id",), fields("doc_id:long quality:int toxic:int"),
                       (fk("doc_id", "documents", "doc_id"),))
CONVERSATIONS = TableContract("conversations", ("conv_id", "turn"),
                              fields("conv_id:long turn:long role:str text:text"))
EVENTS = TableContract("events", ("event_id",),
                       fields("event_id:long ts:str user_id:long event_type:str value:float props:str"))
PAGES = TableContract("pages", ("page_id",), fields("page_id:long url:str html:str"))
BENCHMARK = TableContract("benchmark", ("item_id",), fields("item_id:long text:text"))

STAR = {c.name: c for c in (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM)}
ALL = {**STAR, **{c.name: c for c in (DOCUMENTS, LABELS, CONVERSATIONS, EVENTS, PAGES, BENCHMARK)}}

# The Parquet columns as written, so that no read has to look at a footer first.
_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "float": T.DoubleType(),
          "str": T.StringType(), "text": T.StringType()}
_TIMES = {"o_orderdate", "l_shipdate", "ts"}


def read(spark: SparkSession, sf_dir: str, name: str):
    """One table, typed by its contract (times stay timestamps)."""
    schema = T.StructType([T.StructField(
        f.name, T.TimestampNTZType() if f.name in _TIMES else _TYPES[f.type]) for f in ALL[name].fields])
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, names=tuple(STAR)) -> Dataset:
    return Dataset({n: ALL[n] for n in names}, {n: read(spark, sf_dir, n) for n in names})
