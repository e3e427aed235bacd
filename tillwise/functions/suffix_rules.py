"""Public suffix rules as a table, and the label of a host in front of its suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def suffix_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """``name`` and ``kind`` of the rules that a public list writes line by line.

    A line's first word is the rule: a plain name, ``*.x`` (a ``wildcard``) or ``!x`` (an ``exception``).
    Comments, blank lines and nulls are no rules; a rule named twice is one.
    """
    word = F.lower(F.split(F.trim(F.regexp_replace(column, r"\s", " ")), " ")[0])
    rules = lines.select(word.alias("rule")).where("rule <> '' and not startswith(rule, '//')")
    kind = F.when(F.startswith("rule", F.lit("!")), "exception")
    kind = kind.when(F.startswith("rule", F.lit("*.")), "wildcard").otherwise("plain")
    return rules.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("name"), kind.alias("kind")).distinct()


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a public list that is stored as a text file."""
    return suffix_rules(spark.read.text(path))


def host_labels(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` and ``label`` of every distinct ``host``: the label in front of its longest suffix.

    ``rules`` is a table as ``suffix_rules`` gives it, of any length; it is joined, not written into
    the plan. Each host stands for its last labels, one by one, two, and so on up to as many as a
    rule can have, and is grouped again by the longest that is a suffix; an exception comes before
    all others and makes a suffix one label shorter. The label is ``''`` where a host is a suffix
    itself. A host under no rule gives its last label, an IPv4 address itself. Null hosts drop out.
    """
    depth = rules.agg(F.coalesce(F.max(F.size(F.split("name", r"\."))), F.lit(1))).scalar()
    distinct = hosts.where(F.col("host").isNotNull()).select("host").distinct()
    labels = F.split("host", r"\.")
    count = F.size(labels)
    split = distinct.select("host", labels.alias("labels"), count.alias("count"))
    taken = split.select(
        "*", F.explode(F.sequence(F.lit(1), F.least(F.col("count"), depth))).alias("taken")
    )
    tail = F.array_join(F.slice("labels", F.col("count") - F.col("taken") + 1, F.col("taken")), ".")
    tails = taken.select("host", "count", "taken", tail.alias("tail"))
    met = tails.join(rules, F.col("tail") == F.col("name"), "left")
    size = (
        F.when(F.col("kind") == "plain", F.col("taken"))
        .when((F.col("kind") == "wildcard") & (F.col("count") > F.col("taken")), F.col("taken") + 1)
        .when(F.col("kind") == "exception", F.col("taken") - 1)
    )
    rank = F.when(size.isNotNull(), F.struct((F.col("kind") == "exception").alias("first"), size.alias("size")))
    best = met.groupBy("host").agg(F.max(rank).getField("size").alias("size"))
    labels = F.split("host", r"\.")
    before = F.coalesce(F.get(labels, F.size(labels) - F.col("size") - 1), F.lit(""))
    label = F.when(F.col("host").rlike(IPV4), F.col("host"))
    label = label.when(F.col("size").isNotNull(), before).otherwise(F.element_at(labels, -1))
    return best.select("host", label.alias("label"))
