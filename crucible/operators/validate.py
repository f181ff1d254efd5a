"""Constraints: each counts the rows that break it, alone or in a suite that reads each table once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): in one pass, the rows for which a condition does not hold; null does not hold."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules)))
    return counts.select(pairs.alias("x")).select("x.*")


def check_unique(df: DataFrame, key: list[str], rule: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(rule).alias("rule"), F.count_if(F.col("n") > 1).alias("violations"))


def check_complete(df: DataFrame, key: str, value: str, expected: list[str], rule: str) -> DataFrame:
    """Every key has exactly the expected values."""
    want = F.array_sort(F.array(*map(F.lit, expected)))
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("have")).agg(F.lit(rule).alias("rule"), F.count_if(F.col("have") != want).alias("violations"))


def check_references(df: DataFrame, key: str, other: DataFrame, rule: str) -> DataFrame:
    """Every key occurs in the other table."""
    return df.join(other.select(key).distinct(), key, "left_anti").agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))


def check_same_rows(a: DataFrame, b: DataFrame, rule: str) -> DataFrame:
    """Both tables hold the same rows, repeats included."""
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))


def check_same_order(a: DataFrame, b: DataFrame, position: str, value: str, rule: str) -> DataFrame:
    """Both tables have the same value at each position; a position that one of them lacks is a violation."""
    left, right = a.select(position, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), b.select(position, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    return left.join(right, position, "full").agg(F.lit(rule).alias("rule"), F.count_if(~same).alias("violations"))


def check_count(df: DataFrame, expected: int, rule: str) -> DataFrame:
    return df.agg(F.lit(rule).alias("rule"), F.abs(F.count(F.lit(1)) - expected).alias("violations"))


def check_single_value(df: DataFrame, value: str, expected, rule: str) -> DataFrame:
    """No row has another value than the expected one."""
    return df.agg(F.lit(rule).alias("rule"), F.count_if(~F.col(value).eqNullSafe(F.lit(expected))).alias("violations"))


class Suite:
    """Rules over several tables, checked together: each table is read once, and one aggregation serves all rules.

    A row gives an entry (rule, key, side, value) for each rule that has a say on
    it: for a row rule only if it breaks it. Entries are grouped by rule and key,
    combined before the shuffle; a rule's violations are those of its keys.
    """

    def __init__(self):
        self.kinds: dict[str, tuple[str, list[str] | None]] = {}
        self.tables: dict[int, tuple[DataFrame, list[Column]]] = {}

    def _add(self, df: DataFrame, rule: str, when: Column, key: list[str], side: int = 0, value: Column | None = None) -> None:
        # A null is no text of a key: it is left out of the object.
        text = F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)))) if key else F.lit("")
        value = F.lit(None) if value is None else value
        entry = F.struct(F.lit(rule).alias("rule"), text.alias("key"), F.lit(side).alias("side"), value.cast("string").alias("value"))
        self.tables.setdefault(id(df), (df, []))[1].append(F.when(when, entry))

    def rows(self, df: DataFrame, rules: dict[str, Column]) -> Suite:
        """A condition holds for every row; null does not hold."""
        for rule, c in rules.items():
            self.kinds[rule] = ("rows", None)
            self._add(df, rule, ~F.coalesce(c, F.lit(False)), [])
        return self

    def unique(self, df: DataFrame, key: list[str], rule: str) -> Suite:
        """No key occurs twice; violations are the keys that do."""
        self.kinds[rule] = ("unique", None)
        self._add(df, rule, F.lit(True), key)
        return self

    def complete(self, df: DataFrame, key: str, value: str, expected: list[str], rule: str) -> Suite:
        """Every key has exactly the expected values; violations are the keys that have not."""
        self.kinds[rule] = ("complete", sorted(expected))
        self._add(df, rule, F.lit(True), [key], value=F.col(value))
        return self

    def references(self, df: DataFrame, key: str, other: DataFrame, rule: str, other_key: str | None = None, where: Column | None = None) -> Suite:
        """Every key (of the rows `where` selects) occurs in the other table, a null nowhere; violations are the rows whose key does not."""
        self.kinds[rule] = ("references", None)
        self._add(df, rule, F.lit(True) if where is None else F.coalesce(where, F.lit(False)), [key])
        self._add(other, rule, F.col(other_key or key).isNotNull(), [other_key or key], side=1)
        return self

    def checks(self) -> DataFrame:
        """(rule, violations) for every rule."""
        entries = union(*(df.select(F.explode(F.array_compact(F.array(*columns))).alias("e")).select("e.*") for df, columns in self.tables.values()))
        keys = entries.groupBy("rule", "key").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("there"), F.array_sort(F.collect_set("value")).alias("have"))
        broken = F.lit(None).cast("long")
        for rule, (kind, expected) in self.kinds.items():
            n = {
                "rows": F.col("n"), "unique": (F.col("n") > 1).cast("long"), "references": F.when(F.col("there") == 0, F.col("n")).otherwise(0),
                "complete": (F.col("have") != F.array(*map(F.lit, expected or ()))).cast("long"),
            }[kind]
            broken = F.when(F.col("rule") == rule, n).otherwise(broken)
        found = keys.groupBy("rule").agg(F.sum(broken).alias("violations"))
        names = keys.sparkSession.createDataFrame([(r,) for r in self.kinds], "rule string")
        return names.join(found, "rule", "left").select("rule", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require(checks: DataFrame) -> None:
    """An error that names the rules with violations, if any."""
    broken = checks.filter("violations > 0").orderBy("rule").limit(20).collect()
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r.violations}" for r in broken))
