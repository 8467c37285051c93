"""Validation of contributed tables before they are staged: rules, warnings, counts and keys, many sources at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessile.functions import clean as c
from sessile.sources.work import materialised

# The columns that a contributed table has to have, and what its angles may be.
TEXT = ("solid_name", "solid_family", "liquid_name", "contact_angle_type", "measurement_method")
NUMERIC = ("contact_angle_deg", "liquid_total_surface_tension_mN_m", "liquid_dispersion_mN_m", "liquid_polar_mN_m")
SURFACE = ("solid_name", "solid_family", "solid_substrate", "surface_treatment", "surface_treatment_detail", "coating_or_layer", "surface_state")
ANGLE_TYPES = ("static", "advancing", "receding")
#: Offending rows that a report names, the first ones, and liquids that make a surface feasible.
NAMED_ROWS, FEASIBLE = 20, 3
#: A side of a join is broadcast only if it has at most so many rows, counted.
BROADCAST_ROWS = 100_000


def _first(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The least few values of each key as text; the window keeps so many of each task before it shuffles."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_rn") <= NAMED_ROWS)
    return ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)).cast("array<string>"), ",").alias(name))


def _registered(registry: DataFrame) -> tuple[DataFrame, bool]:
    """What the registry tells of each source, and whether it is small."""
    known = registry.select("source_id", c.clean_text("doi").alias("_doi"), c.clean_text("url").alias("_url"), (c.normalised_token("verification_status") == "verified").alias("_verified"), F.lit(True).alias("_known"))
    return known, registry.count() <= BROADCAST_ROWS


def _checked(rows: DataFrame) -> DataFrame:
    """A source that the registry lacks stops whoever reads the rows."""
    must = F.assert_true(F.coalesce("_known", F.lit(False)), F.concat(F.lit("source absent from the registry: "), F.col("source_id").cast("string")))
    return rows.withColumn("_ok", must).filter(F.col("_ok").isNull()).drop("_ok", "_known")


def _rules(frame: DataFrame) -> list[tuple[str, Column, Column]]:
    """Each rule of a row, where it is broken, and the value that tells it; else the lines do."""
    numeric = [x for x in NUMERIC if x in frame.columns]
    raw = {x: c.clean_text(F.col(x).cast("string")) for x in TEXT}
    number = {x: c.finite(F.col(x).cast("string")) for x in numeric}
    token, none = F.lower(raw["contact_angle_type"]), F.lit(None)
    checks = [(f"missing_values:{x}", raw[x] == "", none) for x in TEXT]
    checks += [(f"non_numeric_or_missing:{x}", number[x].isNull(), none) for x in numeric]
    checks.append(("angle_out_of_range", ~F.coalesce(number[NUMERIC[0]].between(0, 180), F.lit(False)), none))
    checks += [(f"negative_liquid_property:{x}", F.coalesce(number[x] < 0, F.lit(False)), none) for x in numeric[1:]]
    return [*checks, ("unsupported_angle_type", ~token.isin(*ANGLE_TYPES), token)]


def _source_rules(frame: DataFrame) -> Column:
    """The rules that a source breaks by its columns and its registry."""
    absent = [x for x in NUMERIC if x not in frame.columns]
    return F.filter(
        F.array(*[F.lit(f"missing_required_numeric_column:{x}") for x in absent], F.when(~F.col("_verified"), "registry_license_or_access_not_verified"), F.when((F.col("_doi") == "") & (F.col("_url") == ""), "registry_has_no_doi_or_url")),
        lambda x: x.isNotNull(),
    )


def _lacking(frame: DataFrame) -> list[str]:
    return sorted({*TEXT, NUMERIC[0]} - set(frame.columns))


def _staged(frame: DataFrame, known: DataFrame, status: DataFrame, few: bool, line: str) -> DataFrame:
    """status: (source_id, rule), pass or fail."""
    staged = _checked(frame.join(F.broadcast(known) if few else known, "source_id", "left"))
    numeric, surface = ([x for x in of if x in frame.columns] for of in (NUMERIC, SURFACE))
    liquid = c.canonical_name("liquid_name")
    filled = {name: (c.first_filled(name, default) if name in frame.columns else F.col(default)) for name, default in (("reference_doi", "_doi"), ("reference_url", "_url"))}
    told = status.select("source_id", F.when(F.col("rule") == "pass", "validated_staged").otherwise("rejected").alias("import_status"))
    result = staged.join(F.broadcast(told) if few else told, "source_id")
    staged_columns = {
        **{x: c.finite(F.col(x).cast("string")) for x in numeric}, **filled, "source_group_id": F.col("source_id").cast("string"), "license_verified": F.when(F.col("_verified"), "yes").otherwise(F.col("license_verified") if "license_verified" in frame.columns else F.lit("no")),
        "new_external_source_flag": F.lit("yes"), "split": F.lit("pending_review"), "surface_group_id": c.stable_id("SFC", [F.col("source_id").cast("string"), *[F.col(x).cast("string") for x in surface]]),
        "liquid_id": c.stable_id("LIQ", [liquid], 10), "source_row_id": c.stable_id("RAW", [F.col("source_id").cast("string"), F.col(line).cast("string")]), "liquid_name": liquid,
    }
    return result.withColumns(staged_columns).drop("_doi", "_url", "_verified")


def stage(frame: DataFrame, registry: DataFrame, line: str = "line") -> DataFrame:
    """[Q4] The staged rows of validate alone: rows are made and written once, and a source's status takes no counts.

    What the frame is made of is joined and sorted once; reading the rows again takes columns only.
    """
    if _lacking(frame):
        return frame.limit(0)
    fault = reduce(Column.__or__, [bad for _, bad, _ in _rules(frame)])
    rows = materialised(frame.withColumn("_fault", F.coalesce(fault, F.lit(False))), "contributed", last=True)
    known, few = _registered(registry)
    own = _checked(rows.groupBy("source_id").agg(F.max("_fault").alias("_fault")).join(known, "source_id", "left"))
    fails = F.max(F.col("_fault") | (F.size(_source_rules(frame)) > 0))
    status = materialised(own.groupBy("source_id").agg(F.when(fails, "fail").otherwise("pass").alias("rule")), "status")
    return _staged(rows.drop("_fault"), known, status, few, line)


def validate(frame: DataFrame, registry: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """[Q4] (staged, report) of rows with a source_id and a line number that is unique within it.

    registry: source_id, doi, url, verification_status. The report has for each source
    its errors and warnings (rule, rows, and the first of them, or values), its counts,
    and its status: pass or fail. Staged rows have canonical liquids, numbers, defaults
    from the registry, keys of surface, liquid and row, and the status of their source. A
    source that the registry lacks stops the query. If required columns are missing, all
    sources fail for that alone and nothing is staged.
    """
    lacking = _lacking(frame)
    sources = frame.select("source_id").distinct()
    if lacking:
        told = sources.select("source_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rule"), F.lit(n).cast("long").alias("n"), F.lit(d).alias("detail")) for k, r, n, d in (("error", "missing_required_columns", len(lacking), ",".join(lacking)), ("status", "fail", 1, ""))])).alias("x"))
        return frame.limit(0), told.select("source_id", "x.*")
    surface = [x for x in SURFACE if x in frame.columns]
    known, few = _registered(registry)
    joined = frame.join(F.broadcast(known) if few else known, "source_id", "left")
    hits = F.filter(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), shown.cast("string").alias("value"))) for rule, bad, shown in _rules(frame)]), lambda x: x.isNotNull())
    broken = joined.select("source_id", F.col(line).alias("line"), F.explode(hits).alias("x")).select("source_id", "line", "x.rule", "x.value")
    broken = materialised(broken, "broken")  # the rows at fault, counted and named below without checking all rows again
    counted = broken.groupBy("source_id", "rule").agg(F.count("*").alias("n"))
    lines = _first(broken.filter("value IS NULL"), ["source_id", "rule"], "line", "detail")
    values = _first(broken.filter("value IS NOT NULL").select("source_id", "rule", "value").distinct(), ["source_id", "rule"], "value", "detail")
    errors = counted.join(lines.unionByName(values), ["source_id", "rule"], "left").select("source_id", F.lit("error").alias("kind"), "rule", "n", F.coalesce("detail", F.lit("")).alias("detail"))
    token = F.lower(c.clean_text(F.col("contact_angle_type").cast("string")))
    liquid = c.canonical_name("liquid_name")
    keys = [c.clean_text(F.col(x).cast("string")).alias(x) for x in surface]
    groups = joined.select("source_id", *keys, liquid.alias("_liquid"), token.alias("_type")).groupBy("source_id", *surface, "_liquid", "_type").agg(F.count("*").alias("_n"))
    by_surface = groups.groupBy("source_id", *surface).agg(F.sum("_n").alias("rows"), F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("repeated"), F.count_distinct("_liquid").alias("liquids"))
    liquids = groups.select("source_id", "_liquid").distinct().groupBy("source_id").agg(F.count("*").alias("n_liquids"))
    counts = by_surface.groupBy("source_id").agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_surfaces"), F.count_if(F.col("liquids") >= FEASIBLE).alias("n_feasible_surfaces"), F.sum("repeated").alias("duplicate_key_rows")).join(liquids, "source_id")
    counts = materialised(counts, "counts")  # a row for each source, for the report's parts and the status
    counts = _checked(counts.join(known.select("source_id", "_known").distinct(), "source_id", "left"))  # a source that lacks stops whoever reads them
    own = counts.select("source_id").join(known, "source_id").select("source_id", "_doi", "_url", "_verified").distinct()
    errors = errors.unionByName(own.select("source_id", F.lit("error").alias("kind"), F.explode(_source_rules(frame)).alias("rule"), F.lit(1).cast("long").alias("n"), F.lit("").alias("detail")))
    status = counts.select("source_id", "duplicate_key_rows").join(errors.select("source_id", F.lit("fail").alias("rule")).distinct(), "source_id", "left").withColumn("rule", F.coalesce("rule", F.lit("pass")))
    parts = [
        errors,
        status.filter("duplicate_key_rows > 0").select("source_id", F.lit("warning").alias("kind"), F.lit("duplicate_surface_liquid_angle_type_rows").alias("rule"), F.col("duplicate_key_rows").alias("n"), F.lit("").alias("detail")),
        counts.unpivot(["source_id"], ["n_rows", "n_surfaces", "n_liquids", "n_feasible_surfaces", "duplicate_key_rows"], "rule", "n").select("source_id", F.lit("count").alias("kind"), "rule", "n", F.lit("").alias("detail")),
        status.select("source_id", F.lit("status").alias("kind"), "rule", F.lit(1).cast("long").alias("n"), F.lit("").alias("detail")),
    ]
    return _staged(frame, known, status, few, line), reduce(DataFrame.unionByName, parts)
