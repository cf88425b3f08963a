"""Detection: events and rules to findings, in one row set with an outcome each.

``outcome``: detected, hint (an argument that is no literal), suppressed (argument of an excluded
function), ignored (marked line), filtered (an exclusion reason), low (below the threshold).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loquat.functions import strings as S
from loquat.operators import rules as R

_KEPT = ["path", "pos", "ord", "line", "col", "type_name", "property_name", "function_name", "context", "base", "argument"]
NOT_HINTED = ["nil", "bool", "number", "closure", "array", "dictionary", "key_path"]


def candidates(events: DataFrame, call_rules: DataFrame, assignment_rules: DataFrame, static_constants: bool = True) -> DataFrame:
    """Every event that a rule matches, with the argument the rule selects (null if there is none)."""
    scope = ["path", "pos", "line", "col", "type_name", "property_name", "function_name"]
    calls = R.match_calls(events.where(F.col("kind") == "call"), call_rules.withColumnRenamed("argument", "label"))
    out = calls.select(*scope, "ord", "context", "base", R.select_argument(F.col("arguments"), F.col("label")).alias("argument"))
    assigned = events.where(F.col("kind") == "assignment").withColumn("property", F.col("callee"))
    assigned = R.match_assignments(assigned, assignment_rules)
    out = out.unionByName(assigned.select(*scope, F.lit(0).alias("ord"), "context", "base", F.get("arguments", F.lit(0)).alias("argument")))
    if static_constants:
        static = events.where((F.col("kind") == "static") & (F.get("arguments", F.lit(0))["text"] != ""))
        out = out.unionByName(static.select(*scope, F.lit(0).alias("ord"), F.lit(R.STATIC_CONTEXT).alias("context"), F.lit(R.STATIC_BASE).alias("base"), F.get("arguments", F.lit(0)).alias("argument")))
    return out.select(*_KEPT)


def excluded_arguments(events: DataFrame, functions: list[str]) -> DataFrame:
    """(path, line, col) of string literals passed straight to calls of the named functions."""
    calls = events.where((F.col("kind") == "call") & (F.col("callee_kind") == "direct") & F.col("callee").isin(list(functions)))
    literal = calls.select("path", F.explode("arguments").alias("a")).where("a.kind = 'string'")
    return literal.select("path", "a.line", "a.col").distinct()


def findings(candidates: DataFrame, minimum: float = 0.0, ignored: DataFrame | None = None, suppressed: DataFrame | None = None, hints: bool = True, filters: Sequence[S.Filter] = ()) -> DataFrame:
    """One row a candidate. ``ignored``: (path, line); ``suppressed``: (path, line, col) of literals; ``filters``: a caller's exclusion rules."""
    a = F.col("argument")
    out = candidates.withColumn("value", F.when(a["kind"] == "string", a["text"])).withColumn("has_interpolation", F.coalesce(a["interpolated"], F.lit(False)))
    if suppressed is None:
        out = out.withColumn("is_suppressed", F.lit(False))
    else:
        keys = suppressed.select("path", F.col("line").alias("_l"), F.col("col").alias("_c"), F.lit(True).alias("is_suppressed")).distinct()
        out = out.withColumn("_l", a["line"]).withColumn("_c", a["col"]).join(keys, ["path", "_l", "_c"], "left").drop("_l", "_c")
        static = F.col("context") == R.STATIC_CONTEXT
        out = out.withColumn("is_suppressed", F.coalesce("is_suppressed", F.lit(False)) & ~static & F.col("value").isNotNull())
        # After a suppressed literal, the call's later rules do not apply.
        first = F.min(F.when(F.col("is_suppressed"), F.col("ord"))).over(Window.partitionBy("path", "pos"))
        out = out.withColumn("_stop", first).where("_stop IS NULL OR ord <= _stop").drop("_stop")
    if ignored is None:
        out = out.withColumn("is_ignored", F.lit(False))
    else:
        out = out.join(ignored.select("path", "line", F.lit(True).alias("is_ignored")).distinct(), ["path", "line"], "left").withColumn("is_ignored", F.coalesce("is_ignored", F.lit(False)))
    skeleton = F.when(F.col("has_interpolation"), S.static_skeleton(F.col("value"))).otherwise(F.col("value"))
    # Column by column, each once: inlined into one another they are more than a generated method may hold.
    out = out.withColumn("skeleton", skeleton).withColumn("_trimmed", S.trimmed(F.col("skeleton")))
    out = out.withColumn("_length", S.graphemes(F.col("_trimmed"))).withColumn("text", F.col("_trimmed")).withColumn("reason", S.reason_of(F.col("_trimmed"), filters)).drop("text")
    out = out.withColumn("factors", S.factors_of(F.col("_trimmed"), F.col("_length"), F.col("type_name"), F.col("property_name")))
    out = out.withColumn("confidence", S.confidence_of(F.col("base"), F.col("factors"))).drop("_trimmed", "_length")
    static = F.col("context") == R.STATIC_CONTEXT
    outcome = (
        F.when(F.col("value").isNull(), F.when(F.lit(hints) & a.isNotNull() & ~a["kind"].isin(NOT_HINTED), "hint"))
        .when(F.col("is_suppressed"), "suppressed")
        .when(static & (F.col("is_ignored") | F.col("reason").isNotNull()), F.lit(None))
        .when(F.col("is_ignored"), "ignored")
        .when(F.col("reason").isNotNull(), "filtered")
        .when(F.col("confidence") >= F.lit(float(minimum)), "detected")
        .otherwise("low")
    )
    # Exploded, not filtered: a filter would be pushed down, with all of the above in it once more.
    told = F.when(outcome.isNotNull(), F.array(outcome)).otherwise(F.array().cast("array<string>"))
    return out.withColumn("outcome", F.explode(told)).drop("is_suppressed", "is_ignored")


def detected(findings: DataFrame) -> DataFrame:
    rows = findings.where("outcome = 'detected'")
    return rows.select("path", "pos", "ord", "value", "line", "col", "context", "confidence", "has_interpolation", "type_name", "property_name", "function_name", F.struct("base", "factors", F.col("confidence").alias("final")).alias("score"))


def diagnostics(findings: DataFrame, marker: str = "loquat:ignore", filters: Sequence[S.Filter] = ()) -> DataFrame:
    """path, line, col, pos, kind, severity, message of what findings tell."""
    short = S.shortened(F.col("value"))
    quoted = F.concat(F.lit('"'), short, F.lit('"'))
    kinds = {
        "suppressed": ("note", F.concat(F.lit("Skipped "), quoted, F.lit(" — its function localizes already"))),
        "ignored": ("note", F.concat(F.lit("Suppressed "), quoted, F.lit(f" — {marker}"))),
        "filtered": ("note", F.concat(F.lit("Skipped "), quoted, F.lit(" — "), S.reason_text(F.col("reason"), filters))),
        "hint": ("suggestion", F.concat(R.context_name(F.col("context")), F.lit("("), F.col("argument.text"), F.lit(") takes a value, not a literal: text may hide in it"))),
        "detected": ("warning", F.concat(F.lit("Text with inserted values, for which nothing is generated: "), quoted)),
    }
    rows = findings.where("outcome <> 'low' AND (outcome <> 'detected' OR has_interpolation)")
    severity = message = None
    for outcome, (level, text) in kinds.items():
        is_it = F.col("outcome") == outcome
        severity = F.when(is_it, level) if severity is None else severity.when(is_it, level)
        message = F.when(is_it, text) if message is None else message.when(is_it, text)
    kind = F.when(F.col("outcome") == "detected", "interpolated").otherwise(F.col("outcome"))
    return rows.select("path", "line", "col", "pos", kind.alias("kind"), severity.alias("severity"), message.alias("message"))


#: Patterns that are folded into the plan as an array; more are joined as a table.
FEW_PATTERNS = 32


def existing_references(events: DataFrame, patterns: list[str]) -> DataFrame:
    """Calls and maximal member chains whose dotted path is a pattern or lies below it; the first pattern counts."""
    clean = [p.removesuffix(".") for p in patterns]
    rows = events.where("kind IN ('call', 'path')")
    if not clean:
        return rows.limit(0).select("path", "pos", "line", "col", F.lit("").alias("pattern"), F.col("dotted").alias("expression"), "kind")
    if len(clean) > FEW_PATTERNS:
        return references_to(events, events.sparkSession.createDataFrame(list(enumerate(clean)), "ord long, pattern string"))
    found = F.filter(F.array(*map(F.lit, clean)), lambda p: (F.col("dotted") == p) | F.startswith(F.col("dotted"), F.concat(p, F.lit("."))))
    rows = rows.withColumn("pattern", F.try_element_at(found, F.lit(1))).where("pattern IS NOT NULL")
    return rows.select("path", "pos", "line", "col", "pattern", F.col("dotted").alias("expression"), _reference_kind().alias("kind"))


def _reference_kind():
    return F.when(F.col("kind") == "call", "callExpression").otherwise("memberAccess")


def references_to(events: DataFrame, patterns: DataFrame) -> DataFrame:
    """As ``existing_references``, of a table of patterns (ord, pattern): the one of least ord counts.

    A dotted path lies below just its own prefixes, so these are joined to the patterns by equality, however many
    patterns there are. Only prefixes that are patterns are grouped again, by the event they are of."""
    wanted = patterns.select(S.normal_pattern(F.col("pattern")).alias("pattern"), "ord").dropna().groupBy("pattern").agg(F.min("ord").alias("ord"))
    rows = events.where("kind IN ('call', 'path') AND dotted IS NOT NULL").select("path", "pos", "line", "col", F.col("dotted").alias("expression"), _reference_kind().alias("kind"), F.monotonically_increasing_id().alias("_event"))
    parts = F.split("expression", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    found = rows.withColumn("pattern", F.explode(prefixes)).join(wanted, "pattern")
    columns = ["path", "pos", "line", "col", "expression", "kind"]
    first = found.groupBy("_event", *columns).agg(F.min_by("pattern", "ord").alias("pattern"))
    return first.select("path", "pos", "line", "col", "pattern", "expression", "kind")


# Members that make an image accessible; calls that refer to assets.
ACCESSIBILITY = ["accessibilityLabel", "accessibilityHidden", "accessibilityElement", "accessibilityValue", "accessibilityIdentifier"]
ASSET_CALLS = [("Image", "", "image", "swiftUIImage"), ("Image", "decorative", "image", "swiftUIImageDecorative"), ("Color", "", "color", "swiftUIColor"), ("UIImage", "named", "image", "uiImageNamed"), ("UIColor", "named", "color", "uiColorNamed")]
IMAGE_WARNING = "Image has neither an accessibility label nor is it hidden from readers"


def image_audit(events: DataFrame) -> DataFrame:
    """Images of a literal without an accessibility member above them in their statement."""
    first = F.try_element_at("arguments", F.lit(1))
    image = (F.col("kind") == "call") & (F.col("callee_kind") == "direct") & (F.col("callee") == "Image") & (first["kind"] == "string")
    bare = ~F.coalesce(first["label"], F.lit("")).isin("systemName", "decorative") & ~F.arrays_overlap("members", F.array(*map(F.lit, ACCESSIBILITY)))
    return events.where(image & bare).select("path", "line", "col", "pos", F.lit("accessibility").alias("kind"), F.lit("warning").alias("severity"), F.lit(IMAGE_WARNING).alias("message"))


def missing_asset_diagnostics(missing: DataFrame) -> DataFrame:
    """A warning at every reference to an asset that no catalog has."""
    message = F.format_string('No catalog has the %s "%s", which is loaded here', "type", "name")
    return missing.select("path", "line", "col", "pos", F.lit("missing_asset").alias("kind"), F.lit("warning").alias("severity"), message.alias("message"))


def asset_references(events: DataFrame) -> DataFrame:
    """Plain, non-empty literals passed to calls that load assets (the callee may be a member). Events are read once."""
    calls = events.sparkSession.createDataFrame(ASSET_CALLS, "callee string, _label string, type string, context string")
    rows = events.where(F.col("kind") == "call").select("path", "pos", "line", "col", "callee", "arguments")
    # Calls are code: their table is a handful of rows.
    rows = rows.join(F.broadcast(calls), "callee").withColumn("a", R.select_argument(F.col("arguments"), F.col("_label")))
    rows = rows.where("a.kind = 'string' AND NOT a.interpolated AND a.text <> ''")
    return rows.select("path", "pos", "line", "col", F.col("a.text").alias("name"), "type", "context")
