"""Request texts for an offline model job, its replies, and the call budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom import catalog
from fieldloom.functions import infer
from fieldloom.functions.document import is_whole_value
from fieldloom.functions.rows import first_of, let
from fieldloom.operators.matching import contained
from fieldloom.plans.lookup import lookup_join
from fieldloom.session import materialise

# Fixed layout of a request: head of the field table, cell widths, how many concepts and aliases are shown.
TABLE_HEAD = "| Field | Value | Type | Inferred Unit | Semantic Hint |\n|-------|-------|------|---------------|---------------|"
WIDTHS = {"key": 60, "value": 30, "unit": 20, "hint": 30}
SHOWN_CONCEPTS = 50
POPULAR_CONCEPTS = 20
SHOWN_ALIASES = 3
# rank of a concept that no hint asks for
LATE = 1 << 30


def clean_cell(text: Column, width: int) -> Column:
    """No control characters, no table or template marks, single spaces, at most ``width`` characters."""
    bare = F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}|`{}]|[\p{Zs}&&[^ ]]", "")
    bare = F.trim(F.regexp_replace(bare, " +", " "))
    return let(
        bare,
        lambda t: F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t),
    )


def relevant_concepts(fields: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """For each schema the concepts that fit a hint, in field order, then the popular others.

    ``fields`` has schema_signature, pos and inferred_semantic. The own catalogue
    sits in the expression, nothing is joined or exploded. A caller's table may
    have any size: distinct hints meet its aliases by keys, see ``relevant_by_table``.
    """
    if concepts is not None:
        return relevant_by_table(fields, concepts)
    hinted = fields.filter(F.col("inferred_semantic").isNotNull())
    per_schema = fields.select("schema_signature").distinct()
    # first position at which each concept is asked for
    firsts = hinted.groupBy("schema_signature").agg(
        *[
            F.min(F.when(_any_alias(F.lower("inferred_semantic"), c[4]), F.col("pos"))).alias(f"c{i}")
            for i, c in enumerate(catalog.CONCEPTS)
        ]
    )
    joined = per_schema.join(firsts, "schema_signature", "left")
    items = []
    for i, (concept, description, unit, datatype, aliases) in enumerate(catalog.CONCEPTS):
        rank = F.coalesce(F.col(f"c{i}"), F.lit(LATE)) if i < POPULAR_CONCEPTS else F.col(f"c{i}")
        line = f"- {concept}: {description} (unit: {unit}, type: {datatype}, aliases: {', '.join(aliases[:SHOWN_ALIASES])})"
        item = F.struct(rank.alias("rank"), F.lit(i).alias("ordinal"), F.lit(concept).alias("concept_id"), F.lit(line).alias("line"))
        items.append(F.when(rank.isNotNull(), item))
    ranked = F.array_sort(F.filter(F.array(*items), lambda e: e.isNotNull()))
    return joined.select("schema_signature", *_shown(F.slice(ranked, 1, SHOWN_CONCEPTS)))


def _shown(ranked: Column) -> list[Column]:
    return [F.transform(ranked, lambda e: e["concept_id"]).alias("concept_ids"), F.array_join(F.transform(ranked, lambda e: e["line"]), "\n").alias("ontology_concepts")]


def relevant_by_table(fields: DataFrame, concepts: DataFrame) -> DataFrame:
    """C7 over a concept table of any size.

    A schema shows 50 concepts at most, by place of the first hint they fit and by ordinal. So of one hint no more than its
    first 50 can be shown, and lists stay that short wherever a group is made.
    """
    unit = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))  # noqa: E731  as text formatting shows a missing value
    line = F.concat(F.lit("- "), unit("concept_id"), F.lit(": "), unit("description"), F.lit(" (unit: "), unit("unit"), F.lit(", type: "), unit("datatype"),
                    F.lit(", aliases: "), F.array_join(F.slice("aliases", 1, SHOWN_ALIASES), ", "), F.lit(")"))
    known = materialise(concepts.select("ordinal", "concept_id", line.alias("line"), "aliases"))
    aliases = known.select("ordinal", F.explode("aliases").alias("pattern")).dropna().distinct()
    rows = materialise(fields.select("schema_signature", "pos", F.lower("inferred_semantic").alias("hint")))
    pairs = contained(rows.select(F.col("hint").alias("text")), aliases).join(aliases, "pattern").select(F.col("text").alias("hint"), "ordinal").distinct()
    first = F.row_number().over(Window.partitionBy("hint").orderBy("ordinal")) <= SHOWN_CONCEPTS
    short = materialise(pairs.withColumn("_in", first).where("_in").groupBy("hint").agg(F.collect_list("ordinal").alias("asked")))
    asked = lookup_join(rows, short, ["hint"]).select("schema_signature", F.col("pos").cast("bigint").alias("rank"), F.explode("asked").alias("ordinal"))
    popular = F.array(*[F.lit(r[0]) for r in known.orderBy("ordinal").limit(POPULAR_CONCEPTS).select("ordinal").collect()])
    late = rows.select("schema_signature").distinct().select("schema_signature", F.lit(LATE).cast("bigint").alias("rank"), F.explode(popular.cast(f"array<{known.schema['ordinal'].dataType.simpleString()}>")).alias("ordinal"))
    ranks = asked.unionByName(late).groupBy("schema_signature", "ordinal").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("schema_signature").orderBy("rank", "ordinal"))
    top = ranks.withColumn("_n", place).where(F.col("_n") <= SHOWN_CONCEPTS)
    named = lookup_join(top.drop("_n"), known.drop("aliases"), ["ordinal"])
    lists = named.groupBy("schema_signature").agg(F.array_sort(F.collect_list(F.struct("rank", "ordinal", "concept_id", "line"))).alias("ranked"))
    every = rows.select("schema_signature").distinct().join(lists, "schema_signature", "left")
    return every.select("schema_signature", *_shown(F.coalesce("ranked", F.array().cast(lists.schema["ranked"].dataType))))


def _any_alias(hint: Column, aliases: list[str]) -> Column:
    found = F.lit(False)
    for alias in aliases:
        found = found | hint.contains(alias)
    return found


def fields_table(fields: Column) -> Column:
    """The field table of one message as Markdown text."""

    def row(f: Column) -> Column:
        text = F.coalesce(f["str_value"], F.initcap(f["bool_value"].cast("string")), F.to_json(f["value"]))
        unit = F.coalesce(infer.unit_of_key(f["key"]), F.lit("-"))
        hint = F.coalesce(infer.hint_of_key(f["key"]), F.lit("-"))
        cells = [
            clean_cell(f["key"], WIDTHS["key"]), clean_cell(text, WIDTHS["value"]), f["value_type"],
            clean_cell(unit, WIDTHS["unit"]), clean_cell(hint, WIDTHS["hint"]),
        ]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    return F.concat_ws("\n", F.lit(TABLE_HEAD), F.array_join(F.transform(fields, row), "\n"))


REQUEST = (
    "Map each device field to a concept. Answer with JSON only.\n"
    "Protocol: {protocol}\nTopic: {topic}\nDevice: {device_id}\n"
    "Fields:\n{fields}\nConcepts:\n{concepts}\n"
    'Answer: {"mappings": [{"source_field", "target_concept", "target_field", "source_unit", '
    '"target_unit", "conversion_formula", "confidence", "reasoning"}], "device_context", '
    '"suggested_new_concepts": [{"concept_id", "description", "unit", "datatype"}]}\n'
)


def build_prompt_requests(
    extracted: DataFrame, unresolved: DataFrame, concepts: DataFrame | None = None
) -> DataFrame:
    """One request for each schema with unresolved fields.

    ``unresolved`` has schema_signature and key. The message with the smallest
    id stands for its schema; ``min_by`` finds it without a list of messages.
    """
    example = extracted.groupBy("schema_signature").agg(
        F.min_by(F.struct("protocol", "topic", "device_id", "message_id", "fields"), "message_id").alias("m")
    )
    keys = unresolved.groupBy("schema_signature").agg(F.collect_set("key").alias("_keys"))
    open_fields = F.filter("m.fields", lambda f: F.array_contains("_keys", f["key"]))
    chosen = example.join(keys, "schema_signature").withColumn("_open", open_fields)
    listed = chosen.select(
        "schema_signature", F.posexplode(F.transform("_open", lambda f: f["key"])).alias("pos", "key")
    ).withColumn("inferred_semantic", infer.hint_of_key(F.col("key")))
    shown = relevant_concepts(listed, concepts)
    text = F.lit(REQUEST)
    rows = chosen.join(shown, "schema_signature")
    parts = {
        "protocol": F.col("m.protocol"), "topic": F.col("m.topic"), "device_id": F.col("m.device_id"),
        "fields": fields_table(F.col("_open")), "concepts": F.col("ontology_concepts"),
    }
    pieces, rest = [], REQUEST
    for name, column in parts.items():
        head, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(head), column]
    text = F.concat(*pieces, F.lit(rest))
    return rows.select(
        "schema_signature", F.col("m.message_id").alias("message_id"),
        F.size("_open").cast("bigint").alias("open_fields"), text.alias("prompt"),
    )


_REPLY = (
    "mappings array<struct<source_field:string,target_concept:string,target_field:string,source_unit:string,"
    "target_unit:string,conversion_formula:string,confidence:string,reasoning:string>>, device_context string, "
    "suggested_new_concepts array<struct<concept_id:string,description:string,unit:string,datatype:string,"
    "aliases:array<string>>>"
)


def parse_replies(replies: DataFrame) -> DataFrame:
    """The reply as a struct; if the text is no JSON, the span from the first to the last bracket."""
    reply = F.col("reply")
    start, behind = F.locate("{", reply), F.locate("}", F.reverse(reply))
    length = F.length(reply) - behind + 2 - start
    span = F.when((start > 0) & (behind > 0) & (length > 1), F.substring(reply, start, length))
    # the JSON reader ignores text behind the first value, so each candidate is checked as a whole
    text = F.when(is_whole_value(reply), reply).otherwise(let(span, lambda s: F.when(is_whole_value(s), s)))
    return replies.withColumn("_r", F.from_json(text, _REPLY))


def load_llm_replies(replies: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Mappings of the replies that pass the checks.

    ``replies`` has schema_signature and reply. The concept must be known, from
    the own catalogue or a caller's table of any size, or start with ``_``; confidence is 0.8 if missing and is kept within 0 to 1;
    an entry without field, concept or target, or with a confidence that is no
    number, is dropped.
    """
    parsed = parse_replies(replies).select(
        "schema_signature", F.col("_r.device_context").alias("device_context"),
        F.posexplode("_r.mappings").alias("ordinal", "m"),
    ).select("schema_signature", "device_context", "ordinal", "m.*")
    number = F.when(F.col("confidence").isNull(), F.lit(catalog.REPLY_CONFIDENCE)).otherwise(
        infer.text_to_double(F.col("confidence"))
    )
    known = F.col("target_concept").isin([c[0] for c in catalog.CONCEPTS])
    if concepts is not None:
        ids = materialise(concepts.select(F.col("concept_id").alias("target_concept")).dropna().distinct().withColumn("_known", F.lit(True)))
        parsed = lookup_join(parsed, ids, ["target_concept"])
        known = known | F.coalesce("_known", F.lit(False))
    good = (
        F.col("source_field").isNotNull()
        & F.col("target_field").isNotNull()
        & (known | F.col("target_concept").startswith("_"))
        & number.isNotNull()
    )
    return parsed.filter(good).select(
        "schema_signature", "source_field", "target_concept", "target_field", "source_unit", "target_unit",
        "conversion_formula", F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)).alias("confidence"),
        F.lit("llm").alias("resolution_method"), "reasoning", "ordinal", "device_context",
    )


def suggested_concepts(replies: DataFrame) -> DataFrame:
    """New concepts of the replies, complete ones only.

    The outer form keeps the optimiser from copying the parsing into a size check below the explode.
    """
    rows = parse_replies(replies).select(
        "schema_signature", F.posexplode_outer("_r.suggested_new_concepts").alias("ordinal", "c")
    ).filter(F.col("ordinal").isNotNull()).select("schema_signature", "ordinal", "c.*")
    complete = F.lit(True)
    for name in ("concept_id", "description", "unit", "datatype"):
        complete = complete & F.col(name).isNotNull()
    return rows.filter(complete).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def cap_per_window(df: DataFrame, ts: str, order: str, n: int = 60, window: str = "1 minute") -> DataFrame:
    """``within_budget`` is true for the first ``n`` rows of each window.

    Windows are short, but one may still be hot. So rows are first counted by
    second; whole seconds are inside or outside the budget by their running
    count, and only the one second in which the budget runs out is ranked.
    """
    second = F.date_trunc("second", ts)
    marked = df.withColumn("_window", F.window(ts, window)["start"]).withColumn("_second", second)
    counts = marked.groupBy("_window", "_second").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy("_window").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    edges = counts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    edges = edges.withColumn(
        "_state", first_of([(F.col("_before") >= n, F.lit("out")), (F.col("_before") + F.col("_n") <= n, F.lit("in"))], F.lit("edge"))
    )
    joined = marked.join(edges.drop("_n"), ["_window", "_second"])
    whole = joined.filter("_state <> 'edge'").withColumn("within_budget", F.col("_state") == "in")
    rank = F.row_number().over(Window.partitionBy("_window", "_second").orderBy(ts, order))
    edge = joined.filter("_state = 'edge'").withColumn("within_budget", F.col("_before") + rank <= n)
    return whole.unionByName(edge).select(*df.columns, F.col("_window").alias("window_start"), "within_budget")
