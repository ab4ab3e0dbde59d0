"""Mapped values to one clean unit, type and range.

The rules are stages (see ``functions.rows``). ``normalize`` runs them over the
field array of each message, so a message is never split and no shuffle brings
it together again. The table operators run the same stages over the long table.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import catalog
from fieldloom.functions import infer
from fieldloom.functions.formula import STEP, formula_programs, run_program
from fieldloom.functions.rounding import exact_round
from fieldloom.functions.rows import Getter, Stage, built_once, chain, first_of, keep_last, let, one_of, widen_table
from fieldloom.plans.lookup import lookup_join
from fieldloom.session import materialise

# ---- conversion paths -------------------------------------------------------


def conversion_paths(conversions: DataFrame) -> DataFrame:
    """Direct pairs, and two hops through the first intermediate unit where no direct pair exists."""
    step = F.struct("pre", "mul", "div", "post")
    one = conversions.select("from_unit", "to_unit", F.array(step).alias("steps"))
    left = conversions.select("from_unit", F.col("to_unit").alias("via"), "ordinal", step.alias("s1"))
    right = conversions.select(F.col("from_unit").alias("via"), "to_unit", step.alias("s2"))
    two = (
        left.join(right, "via")
        .filter("from_unit <> to_unit")
        .join(one.select("from_unit", "to_unit"), ["from_unit", "to_unit"], "left_anti")
        .groupBy("from_unit", "to_unit")
        .agg(F.min_by(F.array("s1", "s2"), F.col("ordinal")).alias("steps"))
    )
    return one.unionByName(two)


def apply_steps(value: Column, steps: Column) -> Column:
    """One or two hops, rounded to 6 decimals at the end."""

    def hop(v: Column, s: Column) -> Column:
        return (v + s["pre"]) * s["mul"] / s["div"] + s["post"]

    first, second = F.get(steps, F.lit(0)), F.get(steps, F.lit(1))
    once = hop(value, first)
    return F.round(F.when(second.isNotNull(), hop(once, second)).otherwise(once), 6)


# ---- stages -----------------------------------------------------------------


def convert_stage(with_formulas: bool = True) -> Stage:
    """An explicit formula comes first; the automatic path keeps the value where it fails."""

    def stage(get: Getter) -> dict[str, Column]:
        m, number = get("m"), infer.as_double(get)
        explicit = F.coalesce(m["conversion_formula"] != "", F.lit(False))
        by_formula = run_program(m["program"], number) if with_formulas else F.lit(None).cast("double")
        converted = F.when(explicit, by_formula).otherwise(apply_steps(number, m["steps"]))
        present = get("value_type") != "null"
        return {
            "converted": converted,
            "conversion_failed": explicit & present & by_formula.isNull(),
        }

    return stage


def enforce_stage(get: Getter) -> dict[str, Column]:
    """Only constrained concepts; a value that does not fit its type is a mismatch."""
    kind, converted = get("m")["datatype"], get("converted")
    number = F.coalesce(converted, infer.as_double(get))
    whole = F.when(F.abs(number) < 9.2e18, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    boolean = F.when(converted.isNotNull(), converted != 0).otherwise(infer.as_boolean(get))
    text = F.coalesce(converted.cast("string"), get("str_value"), F.initcap(get("bool_value").cast("string")),
                      F.to_json(get("value")))
    moment = F.coalesce(
        infer.as_moment(get), F.when(converted.isNotNull(), F.timestamp_seconds(converted))
    )
    as_number = one_of(kind, "float", "numeric_string")
    ok = (
        F.when(as_number, number.isNotNull())
        .when(kind == "integer", whole.isNotNull())
        .when(kind == "boolean", boolean.isNotNull())
        .when(kind == "datetime", moment.isNotNull())
        .otherwise(F.lit(True))
    )
    return {
        "typed_number": F.when(as_number, number).when(kind == "integer", whole.cast("double")),
        "typed_other": F.when(kind == "boolean", boolean.cast("variant"))
        .when(kind == "string", text.cast("variant"))
        .when(kind == "datetime", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").cast("variant")),
        "type_failed": ~get("conversion_failed") & (get("value_type") != "null") & ~ok,
    }


def range_stage(get: Getter) -> dict[str, Column]:
    """Bounds are inclusive; nothing to compare passes."""
    number, m = get("typed_number"), get("m")
    outside = ~F.isnan(number) & ((number < m["min_value"]) | (number > m["max_value"]))
    return {"out_of_range": ~get("type_failed") & F.coalesce(outside, F.lit(False))}


def digits_of(target: Column, rules: list[tuple[str, int]] | None = None) -> Column:
    """Decimals by the first word found in the target name."""
    rules = catalog.PRECISION if rules is None else rules
    default = dict(rules).get("float", catalog.DEFAULT_PRECISION)
    return first_of([(F.lower(target).contains(w), F.lit(d)) for w, d in rules], F.lit(default))


def round_to(value: Column, digits: Column, rules: list[tuple[str, int]] | None = None) -> Column:
    """Round to a number of decimals that is known for each mapping, not for the whole column."""
    rules = catalog.PRECISION if rules is None else rules
    wanted = sorted({d for _, d in rules} | {catalog.DEFAULT_PRECISION})
    return first_of([(digits == d, exact_round(value, d)) for d in wanted], F.lit(None).cast("double"))


def round_by_name(value: Column, target: Column, rules: list[tuple[str, int]] | None = None) -> Column:
    return round_to(value, digits_of(target, rules), rules)


def route_stage(
    null_strategy: str = "preserve",
    defaults: dict | None = None,
    precision: list[tuple[str, int]] | None = None,
) -> Stage:
    """Status, output key and output value."""
    defaults = catalog.DEFAULT_VALUES if defaults is None else defaults

    def stage(get: Getter) -> dict[str, Column]:
        m, value, value_type = get("m"), get("value"), get("value_type")
        target = m["target_field"]
        is_float = (
            get("converted").isNotNull()
            | F.coalesce(one_of(m["datatype"], "float", "numeric_string"), F.lit(False))
            | ((value_type == "float") & m["datatype"].isNull())
        )
        number = F.coalesce(get("typed_number"), get("converted"), get("num_value"))
        rounded = round_to(number, m["digits"], precision)
        integer = F.coalesce(m["datatype"] == "integer", F.lit(False))
        fallback = F.lit(None).cast("variant")
        if null_strategy == "default":
            for kind, default in defaults.items():
                fallback = F.when(m["datatype"] == kind, F.lit(default).cast("variant")).otherwise(fallback)
        status = (
            F.when(target.isNull(), "unmapped")
            .when(value_type == "null", "null")
            .when(get("conversion_failed"), "conversion_failed")
            .when(get("type_failed"), "type_mismatch")
            .when(get("out_of_range"), "out_of_range")
            .otherwise("ok")
        )

        def outcome(s: Column) -> Column:
            key = (
                F.when(s == "unmapped", F.concat(F.lit("_unmapped."), get("key")))
                .when(one_of(s, "conversion_failed", "type_mismatch"), F.concat(F.lit("_error."), target))
                .when(s == "out_of_range", F.concat(F.lit("_invalid."), target))
                .otherwise(target)
            )
            typed = F.when(integer, get("typed_number").cast("bigint").cast("variant")).otherwise(
                get("typed_number").cast("variant")
            )
            out = (
                F.when(one_of(s, "unmapped", "conversion_failed", "type_mismatch"), value)
                .when(s == "null", fallback)
                .when(s == "out_of_range", typed)
                .when(integer, typed)
                .when(get("typed_other").isNotNull(), get("typed_other"))
                .when(is_float, rounded.cast("variant"))
                .otherwise(value)
            )
            metric = F.when(
                (s == "ok") & ~F.coalesce(one_of(m["datatype"], "string", "datetime"), F.lit(False)),
                F.when(integer, get("typed_number"))
                .when(m["datatype"] == "boolean", F.try_variant_get(get("typed_other"), "$", "boolean").cast("int").cast("double"))
                .when(is_float, rounded)
                .otherwise(F.coalesce(get("num_value"), get("bool_value").cast("int").cast("double"))),
            )
            return F.struct(
                s.alias("status"), key.alias("out_key"), out.alias("out_value"), metric.alias("metric_value")
            )

        return {"routed": let(status, outcome)}

    return stage


FAILED = ["conversion_failed", "type_mismatch", "out_of_range"]


def violation_record(get: Getter) -> Column:
    """NULL unless the field failed."""
    m, status, value_type = get("m"), get("status"), get("value_type")
    actual = first_of(
        [
            (one_of(value_type, "string", "datetime", "numeric_string"), F.lit("str")),
            (value_type == "integer", F.lit("int")),
            (value_type == "boolean", F.lit("bool")),
            (value_type == "array", F.lit("list")),
            (value_type == "object", F.lit("dict")),
        ],
        value_type,
    )
    mismatch, outside, unconverted = status == "type_mismatch", status == "out_of_range", status == "conversion_failed"
    shown = F.to_json(get("value"))
    details = first_of(
        [
            (mismatch, F.concat(F.lit("Cannot convert "), actual, F.lit(" to "), m["datatype"], F.lit(": "), shown)),
            (unconverted & m["program"].isNull(), F.concat(F.lit("Not a formula: "), m["conversion_formula"])),
            (unconverted, F.concat(F.lit("Formula gives no number: "), m["conversion_formula"], F.lit(" for "), shown)),
        ],
        F.lit(None).cast("string"),
    )
    record = F.struct(
        get("key").alias("field"),
        status.alias("error"),
        F.when(mismatch, m["datatype"]).alias("expected"),
        F.when(mismatch, actual).alias("actual"),
        F.when(outside, get("typed_number")).alias("value"),
        F.when(outside, m["min_value"]).alias("min"),
        F.when(outside, m["max_value"]).alias("max"),
        details.alias("details"),
    )
    return F.when(one_of(status, *FAILED), record)


def conversion_record(get: Getter) -> Column:
    """NULL unless the value was converted."""
    m = get("m")
    record = F.struct(
        get("key").alias("field"),
        F.coalesce(m["source_unit"], F.lit("unknown")).alias("from_unit"),
        F.coalesce(m["target_unit"], F.lit("unknown")).alias("to_unit"),
        F.to_json(get("value")).alias("original_value"),
        get("converted").alias("converted_value"),
    )
    return F.when(get("converted").isNotNull(), record)


ENTRY = ["pos", "key", "value_type", "value", "status", "out_key", "out_value", "metric_value", "converted", "typed_number"]


# ---- mappings ready to use --------------------------------------------------


def compile_mappings(
    mappings: DataFrame,
    constraints: DataFrame | None = None,
    conversions: DataFrame | None = None,
    precision: list[tuple[str, int]] | None = None,
    with_formulas: bool = True,
) -> DataFrame:
    """One row for each (schema_signature, key) with a struct ``m``.

    The last mapping of a field wins. Conversion path, limits and decimals are
    added here, once for each mapping instead of once for each value, and so is
    the program of its explicit formula. Without formulas none is looked for.
    """
    spark = mappings.sparkSession
    paths = conversion_paths(conversions if conversions is not None else catalog.unit_conversions(spark))
    limits = constraints if constraints is not None else catalog.constraints(spark)
    kept = ["target_concept", "target_field", "source_unit", "target_unit", "conversion_formula",
            "confidence", "resolution_method"]
    last = mappings.groupBy("schema_signature", "source_field").agg(
        F.max_by(F.struct(*kept), F.coalesce("ordinal", F.lit(0))).alias("_m")
    ).select("schema_signature", "source_field", "_m.*")
    if with_formulas:
        last = materialise(last.withColumn("conversion_formula", F.nullif("conversion_formula", F.lit(""))))
        last = lookup_join(last, formula_programs(last), ["conversion_formula"])
    else:
        last = last.withColumn("program", F.lit(None).cast(T.ArrayType(STEP)))
    paths = paths.withColumnsRenamed({"from_unit": "source_unit", "to_unit": "target_unit"})
    limits = limits.withColumnRenamed("concept_id", "target_concept")
    # the own catalogues have 40 pairs and 9 concepts; a table of the caller may be large, so the planner decides
    joined = last.join(paths if conversions is not None else F.broadcast(paths), ["source_unit", "target_unit"], "left").join(
        limits if constraints is not None else F.broadcast(limits), ["target_concept"], "left")
    return joined.select(
        "schema_signature",
        F.col("source_field").alias("key"),
        F.struct(
            *kept, "program", "steps", "datatype", "min_value", "max_value",
            digits_of(F.col("target_field"), precision).alias("digits"),
        ).alias("m"),
    )


# ---- table operators --------------------------------------------------------


def apply_mappings(fields: DataFrame, compiled: DataFrame) -> DataFrame:
    """Every field with its mapping ``m``, NULL where there is none."""
    return lookup_join(fields, materialise(compiled), ["schema_signature", "key"])


def unmapped_fields(mapped: DataFrame) -> DataFrame:
    """Fields without mapping, as ``_unmapped.<key>``."""
    return mapped.filter(F.col("m").isNull()).withColumn("out_key", F.concat(F.lit("_unmapped."), F.col("key")))


def convert_units(mapped: DataFrame) -> DataFrame:
    """D6, D7"""
    return widen_table(mapped, [convert_stage()])


def enforce_types(converted: DataFrame) -> DataFrame:
    return widen_table(converted, [enforce_stage])


def check_ranges(enforced: DataFrame) -> DataFrame:
    return widen_table(enforced, [range_stage])


def route_values(checked: DataFrame, null_strategy: str = "preserve", defaults: dict | None = None,
                 precision: list[tuple[str, int]] | None = None) -> DataFrame:
    """D2, D3, D10, D13 over the long table."""
    routed = widen_table(checked, [route_stage(null_strategy, defaults, precision)])
    return routed.select(*checked.columns, "routed.*")


def normalize_table(fields: DataFrame, compiled: DataFrame, **options) -> DataFrame:
    """D1 to D13 over the long table, one output row for each field."""
    mapped = apply_mappings(fields, compiled)
    return route_values(check_ranges(enforce_types(convert_units(mapped))), **options)


# ---- message operators ------------------------------------------------------


@built_once
def event_time(fields: str, names: tuple[str, ...] = ()) -> Column:
    """struct<moment, broken>.

    The first flagged field, in document order, that can be read as a time;
    then the first by name. An array or object met before that cannot be a time
    at all and marks the message as broken.
    """

    def first(candidates: Column) -> Column:
        read = F.transform(
            candidates,
            lambda f: F.struct(
                infer.as_moment(lambda n: f[n]).alias("moment"),
                one_of(f["value_type"], "array", "object").alias("broken"),
            ),
        )
        return F.get(F.filter(read, lambda r: r["moment"].isNotNull() | r["broken"]), F.lit(0))

    wanted = list(names) or catalog.EVENT_TIME_NAMES
    flagged = first(F.filter(fields, lambda f: f["is_timestamp"]))
    named = first(F.filter(fields, lambda f: infer.any_of(F.lower(f["key"]), wanted)))
    return F.coalesce(flagged, named)


def pack_mappings(compiled: DataFrame) -> DataFrame:
    """One row for each signature with a map from field name to mapping."""
    return compiled.groupBy("schema_signature").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "m"))).alias("mapping")
    )


def _mapping_of(key: Column) -> Column:
    return F.try_element_at(F.col("mapping"), key)


@built_once
def entry_array(
    with_formulas: bool,
    null_strategy: str,
    include_unmapped: bool,
    include_invalid: bool,
    defaults: tuple,
    precision: tuple,
) -> Column:
    """All steps over the fields of a message, in order: map, convert, type, range, route."""

    def entry(f: Column) -> Column:
        def finish(get: Getter) -> Column:
            routed = get("routed")
            key = routed["out_key"]
            if not include_invalid:
                # only the audit records of a failed field stay
                key = F.when(~one_of(routed["status"], *FAILED), key)
            own = {"out_key": key, "status": routed["status"], "out_value": routed["out_value"], "metric_value": routed["metric_value"]}
            return F.struct(*[(own[n] if n in own else get(n)).alias(n) for n in ENTRY])

        stages = [convert_stage(with_formulas), enforce_stage, range_stage,
                  route_stage(null_strategy, dict(defaults), list(precision))]
        return let(
            _mapping_of(f["key"]), lambda m: chain(lambda n: m if n == "m" else f[n], stages, finish)
        )

    entries = F.transform("fields", entry)
    dropped = ([] if include_unmapped else ["unmapped"]) + (["null"] if null_strategy == "omit" else [])
    return F.filter(entries, lambda e: ~one_of(e["status"], *dropped)) if dropped else entries


def normalize(
    extracted: DataFrame,
    compiled: DataFrame,
    signatures: DataFrame | None = None,
    as_of: datetime | Column | None = None,
    null_strategy: str = "preserve",
    include_unmapped: bool = True,
    include_invalid: bool = True,
    defaults: dict | None = None,
    precision: list[tuple[str, int]] | None = None,
    names: list[str] | None = None,
    with_formulas: bool | None = None,
) -> DataFrame:
    """Messages with their ``entries`` after all steps, in document order.

    The only join is by signature against the catalogue of mappings. Unless it
    is given, the catalogue is asked whether any mapping has a formula.
    """
    packed = pack_mappings(compiled)
    if signatures is not None:
        packed = signatures.join(packed, "schema_signature", "full_outer")
    packed = materialise(packed)
    # without any formula the fields do not carry the steps to run one
    if with_formulas is None:
        with_formulas = not packed.where(F.exists(F.map_values("mapping"), lambda m: m["program"].isNotNull())).isEmpty()

    joined = lookup_join(extracted, packed, ["schema_signature"])
    settings = (
        null_strategy, include_unmapped, include_invalid,
        tuple((catalog.DEFAULT_VALUES if defaults is None else defaults).items()),
        tuple(catalog.PRECISION if precision is None else precision),
    )
    entries = entry_array(with_formulas, *settings)

    now = as_of if isinstance(as_of, Column) else (F.lit(as_of) if as_of is not None else F.current_timestamp())
    mapped_any = F.exists("fields", lambda f: F.map_contains_key("mapping", f["key"]))
    mapped_any = F.coalesce(mapped_any, F.lit(False))
    # as the item of an explode: a filter by time would else be pushed below the join with all that the time is read from
    timed = joined.withColumn("_time", F.explode_outer(F.array(event_time("fields", tuple(names or ())))))
    out = timed.withColumn("entries", entries)
    columns = [c for c in extracted.columns if c != "fields"]
    confidence = F.when(mapped_any, 1.0).otherwise(0.0)
    llm, context = F.lit(False), F.lit(None).cast("string")
    if signatures is not None:
        confidence = F.coalesce("confidence", confidence)
        llm, context = F.coalesce("llm_generated", F.lit(False)), F.col("device_context")
    return out.select(
        *columns,
        confidence.alias("confidence"),
        llm.alias("llm_generated"),
        context.alias("context"),
        F.coalesce("_time.moment", now.cast("timestamp")).alias("event_time"),
        F.coalesce("_time.broken", F.lit(False)).alias("broken_time"),
        "entries",
        "mapping",
    )


def final_entries(entries: Column) -> Column:
    """The entries that make up the data of a message: of equal output keys the later one wins."""
    return keep_last(F.filter(entries, lambda e: e["out_key"].isNotNull()), "out_key")


def _records(record: Callable[[Getter], Column]) -> Column:
    """The records of all entries that have one."""

    def one(e: Column) -> Column:
        return let(_mapping_of(e["key"]), lambda m: record(lambda n: m if n == "m" else e[n]))

    return F.filter(F.transform("entries", one), lambda r: r.isNotNull())


def assemble_messages(normalized: DataFrame) -> DataFrame:
    """``data`` map, ``conversions`` and ``validation_errors`` of each message."""
    data = F.map_from_entries(
        F.transform(final_entries(F.col("entries")), lambda e: F.struct(e["out_key"], e["out_value"]))
    )
    return normalized.withColumns(
        {"data": data, "conversions": _records(conversion_record), "validation_errors": _records(violation_record)}
    ).drop("entries", "mapping")


def violations(normalized: DataFrame) -> DataFrame:
    """One row for each failed field."""
    rows = normalized.select("message_id", "device_id", F.explode_outer(_records(violation_record)).alias("v"))
    return rows.filter(F.col("v").isNotNull()).select("message_id", "device_id", "v.*")


def conversion_audit(normalized: DataFrame) -> DataFrame:
    """One row for each conversion."""
    rows = normalized.select("message_id", "device_id", F.explode_outer(_records(conversion_record)).alias("c"))
    return rows.filter(F.col("c").isNotNull()).select("message_id", "device_id", "c.*")


def unit_conversions(spark: SparkSession) -> DataFrame:
    """D4"""
    return catalog.unit_conversions(spark)
