"""Decision tables: rules whose criteria must all hold; the rule with the highest priority labels the subject.

Rules and criteria are bitemporal and taken as of one date. A rule without criteria never matches; ties of priority go to
the lowest rule id; a subject without a matching rule is UNCLASSIFIED, with rule id 0 and name '-'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operators on numbers and on texts.
NUMERIC = ("EQ", "NE", "LT", "GT", "BETWEEN", "IN")
TEXTUAL = ("EQ", "NE", "IN")


def classify(subjects: DataFrame, key: list[str], rules: DataFrame, criteria: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """(key, rule_id, rule_name, label) for each subject.

    ``rules`` (rule_id, rule_name, priority, label, active) and ``criteria`` (rule_id, attribute, operator, text, low, high) are
    decision tables, small by nature: checked to be at most 100000 rules, they become one expression that each subject is
    evaluated on, so subjects are neither shuffled nor multiplied.
    """
    full = criteria.groupBy("rule_id").agg(F.collect_list(F.struct("attribute", "operator", "text", "low", "high")).alias("criteria"))
    table = rules.where("active").join(full, "rule_id").select("priority", "rule_id", "rule_name", "label", "criteria")
    rows = table.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("RULE-002: a decision table of more than 100000 rules")
    best = F.lit(None).cast("struct<rule_id:bigint,rule_name:string,label:string>")
    # lowest precedence first, so that the last one written decides
    for r in sorted(rows, key=lambda r: (r["priority"], -r["rule_id"])):
        test = F.lit(True)
        for c in r["criteria"]:
            test = test & F.coalesce(_literal(c, numbers, texts), F.lit(False))
        best = F.when(test, F.struct(F.lit(r["rule_id"]).cast("bigint").alias("rule_id"), F.lit(r["rule_name"]).alias("rule_name"), F.lit(r["label"]).alias("label"))).otherwise(best)
    out = subjects.withColumn("_best", best)
    return out.select(*key, F.coalesce("_best.rule_id", F.lit(0)).alias("rule_id"), F.coalesce("_best.rule_name", F.lit("-")).alias("rule_name"), F.coalesce("_best.label", F.lit("UNCLASSIFIED")).alias("label"))


def _literal(c, numbers: list[str], texts: list[str]) -> Column:
    """One criterion, its operands written as literals."""
    name, op = c["attribute"], c["operator"]
    col = F.col(name)
    if name in numbers and op in NUMERIC:
        if op == "BETWEEN":
            return col.between(c["low"], c["high"])
        if op == "IN":
            return col.isin([float(x.strip()) for x in c["text"].split(",")])
        return {"EQ": col == c["low"], "NE": col != c["low"], "LT": col < c["low"], "GT": col > c["low"]}[op]
    if name in texts and op in TEXTUAL:
        return {"EQ": col == c["text"], "NE": col != c["text"], "IN": col.isin([x.strip() for x in c["text"].split(",")])}[op]
    raise ValueError(f"RULE-001: cannot evaluate {name} {op}")
