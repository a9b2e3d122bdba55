"""URL filter: host and path rules, and boosted trees on lexical features for the rest.

DataFrame expressions only.  Features come from the URL's characters and from how often
its host suffixes were blocked among the labelled URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths beginning with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Params:
    """``max_rows`` bounds the labelled URLs fitted on; beyond it a hash of the URL picks."""

    trees: int = 20
    depth: int = 4
    max_rows: int = 1_000_000
    prior: float = 20.0          # weight of the overall rate in a suffix's rate
    threshold: float = 0.5       # chance of being allowed from which an URL is
    seed: int = 7
    fallback: str = "allow"      # verdict where nothing can be learnt


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (length, name, verdict), or null.  ``rules`` is a parameter, not data."""
    if not rules:
        return F.lit(None).cast("struct<length:int,name:string,verdict:string>")
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
                   F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
            for r in rules]
    return F.array_max(F.array_compact(F.array(*fits)))


def _count(text: Column, marks: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, marks, ""))).cast("double")


def lexical(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path, ...) with the lexical features, all double."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    labels = F.split(host, r"\.")
    # Entropy over the different characters: an array no longer than the alphabet.
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0),
                          lambda total, c: total - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    features = {
        "x_length": F.length(url).cast("double"), "x_host_length": F.length(host).cast("double"), "x_path_length": F.length(path).cast("double"),
        "x_depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"), "x_labels": F.size(labels).cast("double"),
        "x_digits": _count(url, "0123456789") / n, "x_host_digits": _count(host, "0123456789"), "x_hyphens": _count(host, "-"),
        "x_entropy": F.coalesce(entropy, F.lit(0.0)), "x_parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "x_fragment": F.contains(url, F.lit("#")).cast("double"), "x_secure": F.startswith(url, F.lit("https:")).cast("double"),
        "x_escapes": _count(url, "%"), "x_longest_label": F.coalesce(F.array_max(F.transform(labels, lambda x: F.length(x))), F.lit(0)).cast("double"),
        "x_slash_end": F.endswith(path, F.lit("/")).cast("double"), "x_page": F.contains(path, F.lit(".")).cast("double"),
    }
    return rows.withColumns(features)


FEATURES = ["x_length", "x_host_length", "x_path_length", "x_depth", "x_labels", "x_digits", "x_host_digits", "x_hyphens", "x_entropy",
            "x_parameters", "x_fragment", "x_secure", "x_escapes", "x_longest_label", "x_slash_end", "x_page"]


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _rates(known: DataFrame, labels: int) -> DataFrame:
    """How many labelled URLs end in each suffix, and how many of them are allowed."""
    return known.groupBy(_suffix(F.col("host"), labels).alias(f"suffix{labels}")).agg(
        F.sum("label").alias(f"good{labels}"), F.count("*").alias(f"seen{labels}"))


def _with_rates(rows: DataFrame, rates: dict[int, DataFrame], mean: float, prior: float, own: Column) -> DataFrame:
    """Smoothed share of allowed URLs per suffix; ``own`` takes a labelled row's own label out."""
    for k, table in rates.items():
        rows = rows.withColumn(f"suffix{k}", _suffix(F.col("host"), k)).join(table, f"suffix{k}", "left")
        seen, good = F.coalesce(f"seen{k}", F.lit(0)), F.coalesce(f"good{k}", F.lit(0.0))
        less = F.when(own.isNull(), 0.0).otherwise(1.0)
        rows = rows.withColumn(f"x_suffix{k}", (good - F.coalesce(own, F.lit(0.0)) + prior * mean) / (seen - less + prior)).drop(
            f"suffix{k}", f"seen{k}", f"good{k}")
    return rows


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, params: Params = Params(),
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, chance) per row.

    A rule decides where one fits, the longest if several do.  Elsewhere the trees do, trained
    from ``labelled`` (url, label 1 for allowed) or, without it, from the URLs that rules decide.  Null
    URLs are empty; nulls among ids or labels and repeated rows are kept or left out row by row: rows
    stay, null labels are not learnt from.  Where nothing is labelled, or everything alike, the
    verdict is ``params.fallback`` or that label, and ``chance`` is null.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = cut(rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    if labelled is None:
        known = rows.where("_rule is not null").select("url", "host", "path", (F.col("_rule.verdict") == "allow").cast("double").alias("label"))
    else:
        given = F.coalesce(F.col("url").cast("string"), F.lit(""))
        known = (labelled.where("label is not null").select(given.alias("url"), F.col("label").cast("double").alias("label"))
                 .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}))
    total = known.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).first()
    named = [F.col("page_id"), F.col("host"), F.col("path"), F.col("_rule.name").alias("rule")]
    if not total["n"] or total["mean"] in (0.0, 1.0):
        other = params.fallback if not total["n"] else "allow" if total["mean"] else "block"
        return rows.select(*named, F.coalesce("_rule.verdict", F.lit(other)).alias("verdict"), F.lit(None).cast("double").alias("chance"))
    rates = {k: cut(_rates(known, k), "suffix-rates") for k in (1, 2, 3)}
    columns = FEATURES + [f"x_suffix{k}" for k in rates]
    if total["n"] > params.max_rows:
        known = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * params.max_rows / total["n"]))
    assemble = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    train = cut(_with_rates(lexical(known), rates, total["mean"], params.prior, F.col("label")).select("label", *columns), "labelled-urls")
    trees = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, seed=params.seed, maxBins=64, stepSize=0.2, cacheNodeIds=False)
    model = trees.fit(assemble.transform(train).select("label", "features"))
    scored = model.transform(assemble.transform(_with_rates(
        lexical(rows), rates, total["mean"], params.prior, F.lit(None).cast("double"))))
    chance = vector_to_array("probability")[1]
    method = F.when(chance >= params.threshold, "allow").otherwise("block")
    return scored.select(*named, F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), chance.alias("chance"))
