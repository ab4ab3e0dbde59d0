"""Field names to concepts.

A mapping depends on the schema and the field name, never on the message, so
everything here runs on the distinct names (``schema_fields``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import catalog
from fieldloom.functions.rows import built_once, first_of, keep_last
from fieldloom.functions.similarity import hash_bucket, tokens
from fieldloom.operators.matching import contained, holding_tokens
from fieldloom.operators.registry import registry_lookup
from fieldloom.plans.lookup import lookup_join
from fieldloom.session import materialise

MAPPING = {
    "schema_signature": "string",
    "source_field": "string",
    "target_concept": "string",
    "target_field": "string",
    "source_unit": "string",
    "target_unit": "string",
    "conversion_formula": "string",
    "confidence": "double",
    "resolution_method": "string",
    "reasoning": "string",
    "ordinal": "int",
}
NAME = ["key", "inferred_semantic", "inferred_unit"]
RULE_REASON = "rule-based fallback (no LLM available)"
OWN_ALIASES = tuple((a.alias, a.concept_id, a.unit) for a in catalog.aliases())


def as_mappings(df: DataFrame, **columns: Column) -> DataFrame:
    """Project to the mapping columns; what is not given is NULL."""
    have = set(df.columns)
    picked = []
    for name, kind in MAPPING.items():
        column = columns.get(name, F.col(name) if name in have else F.lit(None))
        picked.append(column.cast(kind).alias(name))
    return df.select(*picked)


def passthrough_mappings(fields: DataFrame) -> DataFrame:
    """Times and identities keep their name."""
    return as_mappings(
        fields.filter("flagged"),
        source_field=F.col("key"),
        target_concept=F.concat(F.lit("_"), F.coalesce("inferred_semantic", F.lit("passthrough"))),
        target_field=F.col("key"),
        source_unit=F.col("inferred_unit"),
        target_unit=F.col("inferred_unit"),
        confidence=F.lit(1.0),
        resolution_method=F.lit("passthrough"),
    )


def distinct_names(fields: DataFrame) -> DataFrame:
    """One row for each name. Grouped by the key alone, as unit and hint follow from it.

    All later steps group by the key too and need no further shuffle.
    """
    return fields.filter(~F.col("flagged")).groupBy("key").agg(
        F.any_value("inferred_semantic").alias("inferred_semantic"), F.any_value("inferred_unit").alias("inferred_unit")
    )


@built_once
def vector(*columns: str) -> Column:
    """array<struct<weight, bucket>> of the joined texts. Known tokens weigh 1 and win their bucket."""
    words = catalog.vocabulary()
    size = max(len(words), 32)
    known = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, i)])

    def item(token: Column) -> Column:
        bucket = F.try_element_at(known, token).cast("bigint")
        weight = F.when(bucket.isNotNull(), 1.0).otherwise(catalog.UNKNOWN_TOKEN_WEIGHT)
        return F.struct(weight.alias("weight"), F.coalesce(bucket, hash_bucket(token, size)).alias("bucket"))

    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    return keep_last(F.array_sort(F.transform(tokens(text), item)), "bucket")


def norm(items: Column) -> Column:
    squares = F.aggregate(items, F.lit(0.0), lambda acc, e: acc + e["weight"] * e["weight"])
    return F.sqrt(squares)


def vectorize_names(names: DataFrame) -> DataFrame:
    """One row for each name and bucket, weights of unit length."""
    rows = names.withColumn("_v", vector(*NAME)).withColumn("_norm", norm(F.col("_v")))
    return rows.select(*names.columns, "_norm", F.explode("_v").alias("_e")).select(
        *names.columns, F.col("_e.bucket").alias("bucket"), (F.col("_e.weight") / F.col("_norm")).alias("weight")
    )


def vectorize_concepts(concepts: DataFrame) -> DataFrame:
    rows = concepts.withColumn("_aliases", F.array_join("aliases", " "))
    rows = rows.withColumn("_v", vector("concept_id", "description", "_aliases")).withColumn("_norm", norm(F.col("_v")))
    return rows.select("ordinal", "concept_id", "unit", "_norm", F.explode("_v").alias("_e")).select(
        "ordinal", "concept_id", "unit",
        F.col("_e.bucket").alias("bucket"), (F.col("_e.weight") / F.col("_norm")).alias("concept_weight"),
    )


def best_concepts(names: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """C4: the most similar concept of each name, lowest ordinal first among equals.

    An equi-join on the buckets: names and concepts that share no token never meet.
    """
    table = concepts if concepts is not None else catalog.concepts(names.sparkSession)
    pairs = vectorize_names(names).join(vectorize_concepts(table), "bucket")
    scores = pairs.groupBy("key", "ordinal", "concept_id", "unit").agg(
        F.round(F.sum(F.col("weight") * F.col("concept_weight")), 12).alias("similarity")
    )
    best = F.max_by(F.struct("concept_id", "unit", "similarity"), F.struct("similarity", -F.col("ordinal")))
    return scores.groupBy("key").agg(best.alias("b")).select("key", "b.*")


def match_by_similarity(
    names: DataFrame, concepts: DataFrame | None = None, threshold: float = catalog.SIMILARITY_THRESHOLD
) -> DataFrame:
    return best_concepts(names, concepts).filter(F.col("similarity") >= threshold)


@built_once
def rule_concept(aliases: tuple[tuple[str, str, str], ...], mode: str) -> Column:
    """struct<concept_id, unit> for the columns ``key`` and ``inferred_semantic``; NULL if no alias fits."""
    low_hint = F.lower("inferred_semantic")
    low_key = F.replace(F.lower("key"), F.lit("."), F.lit("_"))

    def target(concept: str, unit: str | None) -> Column:
        return F.struct(F.lit(concept).alias("concept_id"), F.lit(unit).cast("string").alias("unit"))

    def has(subject: Column, alias: str) -> Column:
        if mode == "compat":
            return subject.contains(alias)
        wanted = F.array(*[F.lit(t) for t in alias.split("_")])
        return F.size(F.array_except(wanted, tokens(subject))) == 0

    def by_hint(alias: str) -> Column:
        found = has(low_hint, alias)
        return found | F.lit(alias).contains(low_hint) if mode == "compat" else found

    branches = [(by_hint(a), target(c, u)) for a, c, u in aliases]
    branches += [(has(low_key, a), target(c, u)) for a, c, u in aliases]
    return first_of(branches, F.lit(None).cast("struct<concept_id:string,unit:string>"))


def alias_table(concepts: DataFrame) -> DataFrame:
    """One row for each alias of a user's concepts: rank (concept, then place), alias, found (concept_id and unit)."""
    rows = concepts.select("ordinal", "concept_id", "unit", F.posexplode("aliases").alias("place", "alias"))
    return rows.where("alias IS NOT NULL").select(F.struct("ordinal", "place").alias("rank"), "alias", F.struct("concept_id", F.col("unit").cast("string").alias("unit")).alias("found"))


def rules_by_table(names: DataFrame, concepts: DataFrame, mode: str) -> DataFrame:
    """C6 over a concept table of any size: (key, concept_id, unit) for each name that an alias fits.

    Hints and aliases meet by substrings of four characters in both directions, or by their tokens; only names whose hint
    found nothing are compared themselves.
    """
    aliases = materialise(alias_table(concepts))
    rows = materialise(names.select("key", F.lower("inferred_semantic").alias("hint"), F.replace(F.lower("key"), F.lit("."), F.lit("_")).alias("low")))
    hints = rows.where("hint <> ''").select(F.col("hint").alias("text")).distinct()

    def fits(texts: DataFrame) -> DataFrame:
        if mode == "compat":
            return contained(texts, aliases.select(F.col("alias").alias("pattern")))
        spoken = texts.select("text", F.array_distinct(tokens(F.col("text"))).alias("keys"))
        needed = aliases.select(F.col("alias").alias("pattern")).distinct().withColumn("keys", F.array_distinct(F.split("pattern", "_", -1)))
        return holding_tokens(spoken, needed)

    def first_alias(pairs: DataFrame) -> DataFrame:
        return pairs.join(aliases.withColumnRenamed("alias", "pattern"), "pattern").groupBy("text").agg(F.min_by("found", "rank").alias("found"))

    pairs = fits(hints)
    if mode == "compat":
        around = contained(aliases.select(F.col("alias").alias("text")), hints.withColumnRenamed("text", "pattern"))
        pairs = pairs.unionByName(around.select(F.col("pattern").alias("text"), F.col("text").alias("pattern")))
    by_hint = materialise(first_alias(pairs).select(F.col("text").alias("hint"), "found"))
    looked = materialise(lookup_join(rows, by_hint, ["hint"]))
    rest = looked.where("found IS NULL").select(F.col("low").alias("text")).distinct()
    by_name = materialise(first_alias(fits(rest)).select(F.col("text").alias("low"), F.col("found").alias("own")))
    both = lookup_join(looked, by_name, ["low"]).select("key", F.coalesce("found", "own").alias("found"))
    return both.where("found IS NOT NULL").select("key", "found.*")


def match_by_rules(names: DataFrame, concepts: DataFrame | None = None, mode: str = "compat") -> DataFrame:
    """First alias that fits the hint, else first alias in the name. Others give no row.

    ``compat`` compares substrings both ways, so the alias ``t`` takes most
    hints. ``token`` compares whole tokens. The own catalogue sits in the
    expression; a caller's table may have any size and is joined.
    """
    if concepts is not None:
        return rules_by_table(names, concepts, mode)
    found = rule_concept(OWN_ALIASES, mode)
    # the outer explode keeps the long expression from being copied into a filter
    rows = names.select("key", F.explode_outer(F.array(found)).alias("_f"))
    return rows.filter(F.col("_f").isNotNull()).select("key", "_f.*")


def resolve_names(
    names: DataFrame,
    concepts: DataFrame | None = None,
    rule_mode: str = "compat",
    threshold: float = catalog.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """C4, then C6 for what is left: one row for each name, concept NULL if nothing fits."""
    best = best_concepts(names, concepts).select("key", F.struct("concept_id", "unit", "similarity").alias("_b"))
    similar = F.coalesce(F.col("_b.similarity") >= threshold, F.lit(False))
    rows = names.join(best, "key", "left").withColumn("_similar", similar)
    if concepts is None:
        rows = rows.withColumn("_r", F.when(~F.col("_similar"), rule_concept(OWN_ALIASES, rule_mode)))
    else:
        rows = materialise(rows)
        ruled = rules_by_table(rows.where("NOT _similar"), concepts, rule_mode)
        rows = rows.join(ruled.select("key", F.struct("concept_id", "unit").alias("_r")), "key", "left")

    def pick(name: str) -> Column:
        return F.when(F.col("_similar"), F.col(f"_b.{name}")).otherwise(F.col(f"_r.{name}"))

    found = pick("concept_id").isNotNull()
    return rows.select(
        "key",
        pick("concept_id").alias("concept_id"),
        pick("unit").alias("unit"),
        F.when(F.col("_similar"), F.col("_b.similarity")).when(found, catalog.RULE_CONFIDENCE).alias("confidence"),
        F.when(F.col("_similar"), "embedding").when(found, "llm").alias("method"),
    )


def validate_mappings(mappings: DataFrame) -> DataFrame:
    """C11: mappings without target or with an impossible confidence become ``_unmapped``."""
    bad = (
        (F.coalesce("target_concept", F.lit("")) == "")
        | (F.coalesce("target_field", F.lit("")) == "")
        | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    )
    none = F.lit(None).cast("string")
    swaps = {
        "target_concept": F.lit("_unmapped"),
        "target_field": F.concat(F.lit("_unmapped."), F.col("source_field")),
        "source_unit": none,
        "target_unit": none,
        "conversion_formula": none,
        "confidence": F.lit(0.0),
        "resolution_method": F.lit("passthrough"),
        "reasoning": none,
    }
    return mappings.withColumn("_bad", bad).select(
        *[
            F.when(F.col("_bad"), swaps[c]).otherwise(F.col(c)).alias(c) if c in swaps else F.col(c)
            for c in mappings.columns
        ]
    )


def weighted_confidence() -> Column:
    """C12 as an aggregate: NULL if there are passthrough mappings only."""
    weight = first_of(
        [(F.col("resolution_method") == m, F.lit(w)) for m, w in catalog.METHOD_WEIGHTS.items()],
        F.lit(None).cast("double"),
    )
    return F.least(F.lit(1.0), F.try_divide(F.sum(F.col("confidence") * weight), F.sum(weight)))


def mapping_confidence(mappings: DataFrame) -> DataFrame:
    """One row for each signature that has mappings."""
    return mappings.groupBy("schema_signature").agg(
        F.coalesce(weighted_confidence(), F.lit(1.0)).alias("confidence"),
        F.count(F.lit(1)).alias("mappings"),
    )


def apply_cached_mapping(
    fields: DataFrame, registry: DataFrame, as_of: datetime | Column, ttl_days: int = catalog.REGISTRY_TTL_DAYS
) -> tuple[DataFrame, DataFrame]:
    """C14: (mappings of known signatures, fields of unknown signatures)."""
    signatures = fields.select("schema_signature").distinct()
    hits = registry_lookup(signatures, registry, as_of, ttl_days).filter("hit")
    cached = as_mappings(
        hits.select("schema_signature", F.posexplode("mappings").alias("ordinal", "_m")).select(
            "schema_signature", "ordinal", "_m.*"
        )
    )
    misses = fields.join(hits.select("schema_signature"), "schema_signature", "left_anti")
    return cached, misses


def translate(
    fields: DataFrame,
    registry: DataFrame | None = None,
    replies: DataFrame | None = None,
    concepts: DataFrame | None = None,
    as_of: datetime | Column | None = None,
    rule_mode: str = "compat",
    threshold: float = catalog.SIMILARITY_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(mappings, signatures).

    The cascade is: registry, passthrough, similarity, then replies for the
    schemas that have one, and rules for the others. ``signatures`` has one row
    for each schema: confidence, llm_generated, device_context and cached.
    """
    cached = None
    if registry is not None:
        when = as_of if as_of is not None else F.current_timestamp()
        cached, fields = apply_cached_mapping(fields, registry, when)
    resolved = materialise(resolve_names(distinct_names(fields), concepts, rule_mode, threshold))
    joined = fields.join(resolved, "key", "left")
    # reached: not settled by similarity, so left to a reply or to the rules
    reached = ~F.col("flagged") & F.coalesce(F.col("method") != "embedding", F.lit(True))
    joined = joined.withColumn("reached", reached)
    if replies is None:
        joined = joined.withColumn("answered", F.lit(False))
    else:
        answers = replies.select("schema_signature", F.lit(True).alias("answered")).distinct()
        joined = joined.join(answers, "schema_signature", "left").withColumn(
            "answered", F.coalesce("answered", F.lit(False))
        )

    hint = F.coalesce("inferred_semantic", F.lit("passthrough"))
    flagged = F.col("flagged")

    def either(passed: Column, found: Column | str) -> Column:
        return F.when(flagged, passed).otherwise(found if isinstance(found, Column) else F.col(found))

    usable = joined.filter(flagged | (F.col("concept_id").isNotNull() & ~(F.col("reached") & F.col("answered"))))
    mappings = as_mappings(
        usable,
        source_field=F.col("key"),
        target_concept=either(F.concat(F.lit("_"), hint), "concept_id"),
        target_field=either(F.col("key"), "concept_id"),
        source_unit=F.col("inferred_unit"),
        target_unit=either(F.col("inferred_unit"), "unit"),
        confidence=either(F.lit(1.0), "confidence"),
        resolution_method=either(F.lit("passthrough"), "method"),
        reasoning=F.when(~flagged & (F.col("method") == "llm"), RULE_REASON),
    )
    if replies is not None:
        wanted = joined.filter(F.col("reached") & F.col("answered")).select("schema_signature").distinct()
        mappings = mappings.unionByName(
            as_mappings(replies.join(wanted, "schema_signature", "left_semi"), ordinal=F.col("ordinal") + 1)
        )
    mappings = validate_mappings(mappings)

    last_step = joined.groupBy("schema_signature").agg(
        F.bool_or("reached").alias("llm_generated"), F.bool_or(F.col("reached") & ~F.col("answered")).alias("ruled")
    )
    scores = mappings.groupBy("schema_signature").agg(weighted_confidence().alias("confidence"))
    signatures = last_step.join(scores, "schema_signature", "left")
    context = F.when(F.col("ruled"), F.lit("unknown"))
    if replies is not None:
        said = replies.groupBy("schema_signature").agg(F.first("device_context", True).alias("said"))
        signatures = signatures.join(said, "schema_signature", "left")
        context = F.coalesce(F.when(F.col("llm_generated"), F.col("said")), context)
    signatures = signatures.select(
        "schema_signature", "confidence", "llm_generated", context.alias("device_context"), F.lit(False).alias("cached")
    )
    if cached is not None:
        mappings = mappings.unionByName(cached)
        known = registry.join(cached.select("schema_signature").distinct(), "schema_signature", "left_semi")
        newest = known.groupBy("schema_signature").agg(F.max_by("confidence", "created_at").alias("confidence"))
        signatures = signatures.unionByName(
            newest.select(
                "schema_signature",
                F.col("confidence").cast("double").alias("confidence"),
                F.lit(False).alias("llm_generated"),
                F.lit(None).cast("string").alias("device_context"),
                F.lit(True).alias("cached"),
            )
        )
    return mappings, signatures


def learn_concepts(concepts: DataFrame, suggested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(extended concepts, rejected suggestions whose id is taken)."""
    ranked = suggested.groupBy("concept_id").agg(
        F.min_by(F.struct("description", "unit", "datatype", "aliases"), F.struct("schema_signature", "ordinal")).alias("s"),
        F.min(F.struct("schema_signature", "ordinal")).alias("first"),
    )
    fresh = ranked.join(concepts.select("concept_id"), "concept_id", "left_anti")
    # in order of arrival after all known ones: a sort by range, then an id that grows along it
    last = concepts.agg(F.max("ordinal")).first()[0]
    arrived = materialise(fresh.orderBy("first", "concept_id").withColumn("_n", F.monotonically_increasing_id()))
    rows = arrived.select(
        (F.lit(0 if last is None else int(last) + 1) + F.col("_n")).alias("ordinal"),
        "concept_id", "s.description", "s.unit", "s.datatype", "s.aliases",
    )
    # from the written table: the suggestions are aggregated once, and the planner knows the size of the winners
    winners = arrived.select("concept_id", "first.*")
    rejected = suggested.join(winners, ["concept_id", "schema_signature", "ordinal"], "left_anti")
    return concepts.unionByName(rows), rejected
