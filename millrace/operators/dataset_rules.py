"""Rules over the rows of a table, all broken ones counted in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.contracts import ContractError


@dataclass(frozen=True)
class RowRule:
    """A condition that each row has to meet; one that is null isn't met."""

    name: str
    condition: str | Column

    def broken(self) -> Column:
        c = F.expr(self.condition) if isinstance(self.condition, str) else self.condition
        return ~F.coalesce(c, F.lit(False))


def present(*columns: str) -> list[RowRule]:
    return [RowRule(f"{c} is missing", F.col(c).isNotNull()) for c in columns]


def finite(*columns: str) -> list[RowRule]:
    """Numbers that are there, not NaN and not infinite."""
    return [RowRule(f"{c} is not finite", F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < F.lit(float("inf")))) for c in columns]


def one_of(column: str, values: list) -> list[RowRule]:
    return [RowRule(f"{column} is none of the agreed values", F.col(column).isin(*values))]


def in_order(*columns: str) -> list[RowRule]:
    """Columns that never fall from left to right: start, end and the like."""
    return [RowRule(f"{a} is after {b}", F.col(a) <= F.col(b)) for a, b in zip(columns, columns[1:], strict=False)]


def frozen(column: str, value: str | Column) -> list[RowRule]:
    """A column that must still be what it is worked out from (a length, a checksum); null only where that is null."""
    v = F.expr(value) if isinstance(value, str) else value
    return [RowRule(f"{column} is not what it was frozen from", F.col(column).eqNullSafe(v))]


@dataclass(frozen=True)
class TableRules:
    """What a table is agreed to hold: rules of rows, keys that are unique, and a table that must have the same keys (or all of its keys)."""

    rows: tuple[RowRule, ...] = ()
    unique: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    #: Whether the other table may have keys that this one lacks.
    partial: bool = False
    least_rows: int = 1
    names: dict[str, str] = field(default_factory=dict)  # keys of this table by their names in the other


def broken_rules(df: DataFrame, rules: TableRules, other: DataFrame | None = None) -> DataFrame:
    """(rule, broken): how many rows (or keys) break each rule, those that none breaks with 0.

    Row rules are sums of one aggregate. Where keys are looked at, the same sums are taken
    by key first, with map-side partials, so that repeats and the other table's keys come
    from the same pass: each table is scanned once and shuffled by its keys once, and
    however often a key stands there it is one row of the join. Null keys are equal.
    """
    by = tuple(dict.fromkeys(rules.unique or rules.keys))
    if rules.unique and rules.keys and set(rules.unique) != set(rules.keys):
        raise ValueError("one pass looks at one set of keys")
    sums = [F.coalesce(F.sum(r.broken().cast("long")), F.lit(0)).alias(f"__b{i}") for i, r in enumerate(rules.rows)]
    total = [F.coalesce(F.sum(f"__b{i}"), F.lit(0)).alias(f"__b{i}") for i in range(len(rules.rows))]
    names = [r.name for r in rules.rows]
    if not by:
        one = df.agg(F.count(F.lit(1)).alias("__n"), *sums)
        extra: list[str] = []
    else:
        d = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *sums)
        out, extra = [F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"), *total], []
        if rules.unique:
            out.append(F.count_if(F.col("__n") > 1).alias("__repeated"))
            extra.append("__repeated")
            names.append(f"{', '.join(by)} repeats")
        if rules.keys and other is not None:
            o = other.select(*[F.col(rules.names.get(k, k)).alias(f"__k{i}") for i, k in enumerate(by)]).groupBy(*[f"__k{i}" for i in range(len(by))]).agg(F.lit(True).alias("__there"))
            same = F.lit(True)
            for i, k in enumerate(by):
                same = same & d[k].eqNullSafe(o[f"__k{i}"])
            d = d.join(o, same, "full_outer")
            out.append(F.count_if(F.col("__there").isNull()).alias("__unknown"))
            extra.append("__unknown")
            names.append(f"{', '.join(by)} is unknown to the other table")
            if not rules.partial:
                out.append(F.count_if(F.col("__n").isNull()).alias("__absent"))
                extra.append("__absent")
                names.append(f"{', '.join(by)} of the other table is absent")
        one = d.agg(*out)
    columns = [f"__b{i}" for i in range(len(rules.rows))] + extra
    counts = [F.struct(F.lit(n).alias("rule"), F.col(c).cast("long").alias("broken")) for n, c in zip(names, columns, strict=True)]
    counts.append(F.struct(F.lit(f"fewer than {rules.least_rows} rows").alias("rule"), (F.col("__n") < rules.least_rows).cast("long").alias("broken")))
    return one.select(F.explode(F.array(*counts)).alias("r")).select("r.rule", "r.broken")


def check_table(name: str, df: DataFrame, rules: TableRules, other: DataFrame | None = None) -> None:
    """Raises with every broken rule and how often it is broken."""
    broken = [f"{r['rule']} ({r['broken']})" for r in broken_rules(df, rules, other).where("broken > 0").collect()]  # a row for each rule at most
    if broken:
        raise ContractError(name, broken)
