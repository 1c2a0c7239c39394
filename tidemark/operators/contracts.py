"""Schema-contract jobs over a registry of record schemas.

A registry has (subject, version, schema_json). Schemas stay data: fields are
exploded to rows and compared with joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import wire_schema_id

# ---------------------------------------------------------------- fixed values
# writer type -> reader types that can read it, besides itself
PROMOTIONS = {
    "int": ["long", "float", "double"],
    "long": ["float", "double"],
    "float": ["double"],
    "string": ["bytes"],
    "bytes": ["string"],
}
# ------------------------------------------------------------------------------


def _canonical_type(field: Column) -> Column:
    """Type as text: the name of a primitive, else the logical type on its base, or the JSON."""
    kind = F.schema_of_variant(field)
    return F.when(kind == "STRING", F.try_variant_get(field, "$", "string")).otherwise(
        F.to_json(field)
    )


def registry_fields(registry: DataFrame) -> DataFrame:
    """(subject, version, position, field, type, has_default, problem) per record field.

    ``problem`` names what is wrong with a schema or field; such rows are rejects.
    The JSON writer sorts the keys of objects, so equal types have equal text.
    """
    doc = F.try_parse_json("schema_json")
    root = registry.select("subject", "version", doc.alias("s")).withColumn(
        "fields", F.try_variant_get("s", "$.fields", "array<variant>")
    )
    schema_problem = (
        F.when(F.col("s").isNull(), "schema is not JSON")
        .when(
            ~F.coalesce(F.try_variant_get("s", "$.type", "string") == "record", F.lit(False)),
            "root is not a record",
        )
        .when(F.coalesce(F.size("fields"), F.lit(0)) <= 0, "record has no fields")
    )
    rows = root.select(
        "subject", "version", schema_problem.alias("sp"), F.posexplode_outer("fields").alias("position", "f")
    )
    name = F.try_variant_get("f", "$.name", "string")
    type_ = F.try_variant_get("f", "$.type", "variant")
    field_problem = F.when(
        F.coalesce(F.length(name), F.lit(0)) == 0, "field without a name"
    ).when(type_.isNull(), "field without a type")
    return rows.select(
        "subject",
        "version",
        "position",
        F.when(F.col("sp").isNull(), name).alias("field"),
        F.when(F.col("sp").isNull(), _canonical_type(type_)).alias("type"),
        F.try_variant_get("f", "$.default", "variant").isNotNull().alias("has_default"),
        F.coalesce("sp", field_problem).alias("problem"),
    )


def contract_fingerprint(registry: DataFrame) -> DataFrame:
    """SHA-256 per schema, independent of key order in the JSON text."""
    return registry.select(
        "subject", "version", F.sha2(F.to_json(F.try_parse_json("schema_json")), 256).alias("contract_sha256")
    )


def _branches(type_text: Column) -> Column:
    """The branches of a union, or the type itself as the only one."""
    parts = F.try_variant_get(F.try_parse_json(type_text), "$", "array<variant>")
    return F.when(F.startswith(type_text, F.lit("[")), F.transform(parts, _canonical_type)).otherwise(F.array(type_text))


def _readable(old: Column, new: Column) -> Column:
    """True if every branch written under ``old`` resolves to some branch of ``new``."""

    def resolves(writer: Column, reader: Column) -> Column:
        ok = writer == reader
        for name, readers in PROMOTIONS.items():
            ok = ok | ((writer == name) & reader.isin(readers))
        return ok

    return F.forall(_branches(old), lambda o: F.exists(_branches(new), lambda n: resolves(o, n)))


def field_changes(fields: DataFrame, previous: int, candidate: int) -> DataFrame:
    """Full outer match of two versions by (subject, field), as one aggregate."""
    side = F.col("version")
    both = (
        fields.where(F.col("problem").isNull() & side.isin(previous, candidate))
        .groupBy("subject", "field")
        .agg(
            F.max(F.when(side == previous, F.col("type"))).alias("old_type"),
            F.max(F.when(side == candidate, F.col("type"))).alias("new_type"),
            F.max(F.when(side == candidate, F.col("has_default"))).alias("has_default"),
        )
    )
    change = (
        F.when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type").isNull() & F.col("has_default"), "added")
        .when(F.col("old_type").isNull(), "added_without_default")
        .when(F.col("old_type") == F.col("new_type"), "same")
        .when(_readable(F.col("old_type"), F.col("new_type")), "promoted")
        .otherwise("retyped")
    )
    return both.withColumn("change", change)


def evaluate_evolution(fields: DataFrame, previous: int, candidate: int) -> DataFrame:
    """Per subject: what changed, backward compatibility, and the stricter local rule.

    A subject with a broken schema in either version is neither compatible nor passed. The
    name lists are bounded by the fields of one schema document.
    """
    broken = fields.where(F.col("problem").isNotNull() & F.col("version").isin(previous, candidate))
    changes = (
        field_changes(fields, previous, candidate)
        .select("subject", "field", "change")
        .unionByName(broken.select("subject", "field", F.lit("broken").alias("change")))
    )

    def names(*kinds: str) -> Column:
        hit = F.when(F.col("change").isin(*kinds), F.col("field"))
        return F.array_join(F.array_sort(F.collect_list(hit)), ",")

    return (
        changes.groupBy("subject")
        .agg(
            names("removed").alias("removed_fields"),
            names("added", "added_without_default").alias("added_fields"),
            names("promoted", "retyped").alias("changed_field_types"),
            names("added_without_default").alias("added_fields_without_defaults"),
            (F.count_if(F.col("change").isin("retyped", "added_without_default", "broken")) == 0).alias(
                "backward_compatible"
            ),
        )
        .withColumn(
            "passed",
            F.col("backward_compatible")
            & (F.col("removed_fields") == "")
            & (F.col("changed_field_types") == "")
            & (F.col("added_fields_without_defaults") == ""),
        )
    )


def admit_versions(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Registry after the candidates that are backward compatible were appended.

    Candidates have (subject, schema_json) and are compared with the newest
    version of their subject; rejected ones leave it as it was. A new subject is
    admitted if its schema is well formed. Several candidates of a subject are judged one
    by one and get versions in the order of their text.
    """
    newest = registry.groupBy("subject").agg(
        F.max("version").alias("newest"), F.max_by("schema_json", "version").alias("old_json")
    )
    # each candidate is a subject of its own until it has its version
    named = candidates.select("subject", "schema_json").distinct().withColumn(
        "candidate", F.concat_ws("#", F.sha2("schema_json", 256), "subject")
    )
    pairs = named.join(newest, "subject", "left")
    versions = pairs.select(
        F.col("candidate").alias("subject"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("version"), F.col("old_json").alias("schema_json")),
                F.struct(F.lit(2).alias("version"), F.col("schema_json").alias("schema_json")),
            )
        ).alias("v"),
    ).select("subject", "v.*")
    fields = registry_fields(versions.where(F.col("schema_json").isNotNull()))
    broken = fields.where(F.col("problem").isNotNull()).select("subject")
    bad = (
        field_changes(fields, 1, 2)
        .join(pairs.where("newest IS NOT NULL").select(F.col("candidate").alias("subject")), "subject", "left_semi")
        .where(F.col("change").isin("retyped", "added_without_default"))
        .select("subject")
    )
    rejected = bad.unionAll(broken).distinct().withColumnRenamed("subject", "candidate")
    # the candidates of one subject are few
    place = F.row_number().over(Window.partitionBy("subject").orderBy("schema_json"))
    admitted = pairs.join(rejected, "candidate", "left_anti").select(
        "subject", (F.coalesce("newest", F.lit(0)) + place).cast("int").alias("version"), "schema_json"
    )
    return registry.select("subject", "version", "schema_json").unionByName(admitted)


def wire_audit(values: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Records per schema id; id null means an invalid header, ``registered`` a known id."""
    counts = (
        values.where(F.col("value").isNotNull())
        .groupBy(wire_schema_id(F.col("value")).alias("schema_id"))
        .agg(F.count(F.lit(1)).alias("records"))
    )
    known = known_ids.select("schema_id").distinct().withColumn("__known", F.lit(True))
    return counts.join(known, "schema_id", "left").select(
        "schema_id", "records", F.coalesce("__known", F.lit(False)).alias("registered")
    )


def mutate_types(fields: DataFrame, name: str, new_type: str) -> DataFrame:
    """Every field called ``name`` retyped; fails if a schema has none.

    Adds ``mutations``, the number of fields changed in the schema of the row.
    """
    hit = F.col("field") == name
    # a window and no join: one row per schema is more than any task should be sent
    counted = fields.withColumn("__m", F.count_if(hit).over(Window.partitionBy("subject", "version")))
    checked = F.when(F.col("__m") > 0, F.col("__m")).otherwise(
        F.raise_error(F.lit(f"no field named {name} to change")).cast("bigint")
    )
    return counted.withColumns(
        {"mutations": checked, "type": F.when(hit, F.lit(new_type)).otherwise(F.col("type"))}
    ).drop("__m")


def conforms(rows: DataFrame, required: Sequence[tuple[str, str]]) -> Column:
    """True where all required columns are present and castable to their type."""
    ok = F.lit(True)
    for name, type_ in required:
        ok = ok & F.col(name).try_cast(type_).isNotNull()
    return ok
