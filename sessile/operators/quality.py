"""Data quality: rules are rows, violations are rows, gates raise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate found violations."""


def broken_rules(frame: DataFrame, rules: Mapping[str, Column], id_column: str, shown: int = 20) -> DataFrame:
    """[Q4 O5] For each broken rule its number of rows and the first ids. A rule is true where it is broken; null is not."""
    hit = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    hits = frame.select(F.col(id_column).alias("id"), F.explode(hit).alias("rule"))
    counts = hits.groupBy("rule").agg(F.count("*").alias("n"))
    first = hits.withColumn("rn", F.row_number().over(Window.partitionBy("rule").orderBy("id"))).filter(F.col("rn") <= shown)
    ids = first.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("first_ids"))
    return counts.join(ids, "rule")


def outside(c: Column | str, low: float, high: float) -> Column:
    """True outside a range, and for null: a missing value breaks a range rule."""
    x = F.col(c) if isinstance(c, str) else c
    return ~F.coalesce(x.between(low, high), F.lit(False))


def expectations(frame: DataFrame, checks: Mapping[str, tuple[Column, float, float]]) -> DataFrame:
    """[Q10 Q11] One row for each check (aggregate, expected, tolerance): actual and pass."""
    row = frame.agg(*[F.round(c.cast("double"), 6).alias(k) for k, (c, _, _) in checks.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(float(e)).alias("expected"), F.col(k).alias("actual"), (F.abs(F.col(k) - e) <= t).alias("pass")) for k, (_, e, t) in checks.items()]))
    return row.select(each.alias("r")).select("r.*")


def gate(violations: DataFrame) -> None:
    """Raise with the first violations, if there are any."""
    if found := violations.limit(5).collect():
        raise GateError("; ".join(str(r.asDict()) for r in found))


def repeated(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[W3] All rows whose key occurs more than once."""
    return frame.join(frame.groupBy(*keys).count().filter("count > 1").drop("count"), list(keys), "left_semi")


def decision_violations(decisions: DataFrame, active: DataFrame, replaced: DataFrame) -> DataFrame:
    """[Q6 Q7 U2] Sources decided twice, pending, unknown, or to be replaced without rows; active ones without a decision."""
    twice = decisions.groupBy("source").count().filter("count > 1").select("source", F.lit("decided_twice").alias("kind"))
    pending = decisions.filter(F.col("decision").startswith("pending")).select("source", F.lit("pending").alias("kind"))
    unknown = decisions.join(active, "source", "left_anti").select("source", F.lit("unknown_source").alias("kind"))
    missing = decisions.filter("decision = 'retain_reextracted'").join(replaced, "source", "left_anti").select("source", F.lit("no_replacement").alias("kind"))
    undecided = active.join(decisions, "source", "left_anti").select("source", F.lit("undecided").alias("kind"))
    return twice.unionByName(pending).unionByName(unknown).unionByName(missing).unionByName(undecided).distinct()


def duplicate_groups(frame: DataFrame, exact: Sequence[str], value: str, source: str) -> DataFrame:
    """[W2] Rows with their key's size, sources, range and values, and how many of its rows have the same value."""
    groups = frame.groupBy(*exact).agg(F.count("*").alias("size"), F.count_distinct(source).alias("sources"), F.min(value).alias("low"), F.max(value).alias("high"), F.count_distinct(value).alias("values"))
    same = frame.groupBy(*exact, value).agg(F.count("*").alias("same"))
    return frame.join(groups, list(exact)).join(same.withColumnRenamed(value, "_v"), [*[frame[k] == same[k] for k in exact], F.col("_v").eqNullSafe(frame[value])]).drop(*[same[k] for k in exact])


def duplicate_label(value: str, compat: bool = False, near: float = 1.0) -> Column:
    """[W4] The label of a row of duplicate_groups.

    With compat, as some pipelines label them: every row with a value in a group of
    exact duplicates is called near; exact remains only where the value is null.
    """
    if compat:
        return F.when(F.col("same") < 2, "unique").when(F.col(value).isNotNull(), "near_duplicate").otherwise("exact_duplicate")
    return F.when(F.col("same") > 1, "exact_duplicate").when((F.col("size") > 1) & (F.col("high") - F.col("low") <= near), "near_duplicate").when(F.col("size") > 1, "repeated").otherwise("unique")


def duplicate_labels(frame: DataFrame, exact: Sequence[str], value: str, source: str, compat: bool = False, near: float = 1.0) -> DataFrame:
    """[W2 W4] Rows of one key: exact duplicates agree in value, near ones lie within a distance, in several sources or one."""
    return duplicate_groups(frame, exact, value, source).withColumn("label", duplicate_label(value, compat, near)).withColumn("across_sources", F.col("sources") > 1)


def row_suite(frame: DataFrame, source: str, expected: DataFrame, required: Sequence[str] = (), ranges: Mapping[str, tuple[float, float]] | None = None, unique: Sequence[str] = (), present: Mapping[str, tuple[Column, Column]] | None = None, forbidden: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """[Q10] (source, check, n, passed) for each source: its total against (source, expected), and its rows that break a check.

    required: columns that are never blank. ranges: values outside, missing ones left to
    required. unique: rows whose key (all these columns, none null) is not alone in its source. present: where the
    first condition holds the second has to. forbidden: words, in any case, that a column's text
    must not have. Sources that only one side has are told too, with what is there.
    """
    bad: dict[str, Column] = {f"required:{c}": F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in required}
    bad |= {f"range:{c}": ~F.coalesce(F.col(c).between(*ends), F.lit(True)) for c, ends in (ranges or {}).items()}
    bad |= {f"present:{name}": F.coalesce(when, F.lit(False)) & ~F.coalesce(then, F.lit(False)) for name, (when, then) in (present or {}).items()}
    bad |= {f"forbidden:{c}:{w}": F.coalesce(F.lower(F.col(c)).contains(w.lower()), F.lit(False)) for c, words in (forbidden or {}).items() for w in words}
    counts = frame.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"c{k}") for k, c in enumerate(bad.values())])
    if unique:
        keyed = frame.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in unique)).groupBy(F.col(source).alias("source"), *unique).agg(F.count("*").alias("n")).filter("n > 1")
        counts = counts.join(keyed.groupBy("source").agg(F.sum("n").alias("twice")), "source", "left").na.fill(0, ["twice"])
    both = expected.select(F.col(source).alias("source"), "expected").join(counts, "source", "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    rows = [("total", n("total"), n("total") == n("expected")), *[(name, n(f"c{k}"), n(f"c{k}") == 0) for k, name in enumerate(bad)]]
    if unique:
        rows.append((f"unique:{','.join(unique)}", n("twice"), n("twice") == 0))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), value.alias("n"), F.when(ok, "yes").otherwise("no").alias("passed")) for name, value, ok in rows]))
    return both.select("source", each.alias("r")).select("source", "r.*")
