"""Nested record schemas as rows, and their evolution by path.

A schema becomes (subject, version, path, ...) rows: one per field and one per type that may
stand at a place. The fields of a named record are placed under its name (``Address.street``;
those of the root under their own), array items under ``path[]`` and map values under ``path{}``.
So a type means the same wherever it is defined or referred to, and recursive types end. A type
that is no union counts as a union of one, so a place resolves alike before and after it becomes
one: every type the writer may have put there needs a type of the reader that can read it.

Documents are parsed once. Each pass opens one level of nesting and writes what it finds; the
passes end when nothing nested is left, so depth has no bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.contracts import PROMOTIONS
from tidemark.session import scratch_dir

# The primitive types, and the kinds of types that have a name.
PRIMITIVES = ["null", "boolean", "int", "long", "float", "double", "bytes", "string"]
NAMED = ["record", "error", "enum", "fixed"]
ROOT = "$"

_ROW = (
    "struct<node:string,path:string,key:string,kind:string,position:int,has_default:boolean,"
    "symbols:array<string>,size:bigint,logical:string,type:variant,problem:string>"
)


def _text(v: Column, path: str) -> Column:
    """The text at ``path``; null for other types."""
    value = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _is_object(v: Column) -> Column:
    """Looks at the outermost level only; ``schema_of_variant`` walks the whole value."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _row(node: str, path: Column, **values: Column) -> Column:
    names = [part.split(":")[0] for part in _ROW[len("struct<") : -1].split(",")]
    fields = {"node": F.lit(node), "path": path, **values}
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(_ROW)


def _opened(places: DataFrame) -> DataFrame:
    """Rows of one level: (subject, version, root, place, type) to type rows and rows of the places below."""
    whole = F.col("type")
    branches = F.coalesce(_list(whole, "$"), F.array(whole))
    each = places.select("subject", "version", "root", "place", F.explode(branches).alias("b"))
    inner = F.try_variant_get("b", "$.type", "variant")
    # {"type": {"type": ...}} is its inner type
    each = each.withColumn("b", F.when(_is_object(inner), inner).otherwise(F.col("b")))
    b = F.col("b")
    kind = F.when(_is_object(b), _text(b, "$.type")).when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string"))
    named = kind.isin(NAMED)
    name = F.substring_index(F.when(named, _text(b, "$.name")).otherwise(kind), ".", -1)
    each = each.withColumns(
        {
            "kind": F.when(kind.isin(*PRIMITIVES, *NAMED, "array", "map"), kind).when(kind.isNotNull(), "reference"),
            "name": F.when(name == F.col("root"), ROOT).otherwise(name),
            "fields": F.when(kind.isin("record", "error"), _list(b, "$.fields")),
            "symbols": F.when(kind == "enum", F.try_variant_get(b, "$.symbols", "array<string>")),
        }
    )
    kind, place = F.col("kind"), F.col("place")
    key = F.when(kind.isin(*NAMED, "reference"), F.concat(F.lit("named:"), "name")).otherwise(kind)
    problem = (
        F.when(kind.isNull(), "type is neither a name nor an object with one")
        .when(kind.isin(NAMED) & (F.coalesce(F.length("name"), F.lit(0)) == 0), "named type without a name")
        .when(kind.isin("record", "error") & (F.coalesce(F.size("fields"), F.lit(0)) <= 0), "record has no fields")
        .when((kind == "enum") & (F.coalesce(F.size("symbols"), F.lit(0)) <= 0), "enum has no symbols")
        .when((kind == "array") & F.try_variant_get(b, "$.items", "variant").isNull(), "array has no items")
        .when((kind == "map") & F.try_variant_get(b, "$.values", "variant").isNull(), "map has no values")
    )
    own = _row(
        "type", place, key=key, kind=kind, symbols=F.array_sort("symbols"), size=F.try_variant_get(b, "$.size", "bigint"),
        logical=_text(b, "$.logicalType"), has_default=F.try_variant_get(b, "$.default", "variant").isNotNull(), problem=problem,
    )
    prefix = F.when(F.col("name") == ROOT, "").otherwise(F.concat("name", F.lit(".")))

    def field(f: Column, i: Column) -> Column:
        of = _text(f, "$.name")
        type_ = F.try_variant_get(f, "$.type", "variant")
        wrong = F.when(F.coalesce(F.length(of), F.lit(0)) == 0, "field without a name").when(type_.isNull(), "field without a type")
        return _row(
            "field", F.concat(prefix, F.coalesce(of, F.lit("?"))), position=i,
            has_default=F.try_variant_get(f, "$.default", "variant").isNotNull(), type=type_, problem=wrong,
        )

    def below(mark: str, path: str) -> Column:
        return F.array(_row("item", F.concat(place, F.lit(mark)), type=F.try_variant_get(b, path, "variant")))

    inside = (
        F.when(F.col("fields").isNotNull(), F.transform("fields", field))
        .when(kind == "array", below("[]", "$.items"))
        .when(kind == "map", below("{}", "$.values"))
        .otherwise(F.array().cast(f"array<{_ROW}>"))
    )
    return each.select("subject", "version", "root", F.inline(F.concat(F.array(own), inside)))


def schema_nodes(registry: DataFrame) -> DataFrame:
    """(subject, version, node, path, key, kind, position, has_default, symbols, size, logical, problem).

    ``node`` is field, item (of an array or map) or type; a type's ``key`` is what it is matched
    by. Schemas that are no record give one row with a problem.
    """
    parsed = registry.select("subject", "version", F.try_parse_json("schema_json").alias("type"))
    wrong = F.when(F.col("type").isNull(), "schema is not JSON").when(
        ~F.coalesce(_text(F.col("type"), "$.type") == "record", F.lit(False)), "root is not a record"
    )
    checked = parsed.withColumn("problem", wrong)
    root = F.substring_index(_text(F.col("type"), "$.name"), ".", -1)
    places = checked.where("problem IS NULL").select("subject", "version", root.alias("root"), F.lit(ROOT).alias("place"), "type")
    columns = ["subject", "version", "node", "path", "key", "kind", "position", "has_default", "symbols", "size", "logical", "problem"]
    spark, found = registry.sparkSession, []
    while True:
        rows = _opened(places)
        path = scratch_dir(spark, "schema-nodes")
        rows.write.parquet(path)
        stored = spark.read.schema(rows.schema).parquet(path)
        found.append(stored.select(*columns))
        places = stored.where("type IS NOT NULL").select("subject", "version", "root", F.col("path").alias("place"), "type")
        if places.isEmpty():
            break
    nodes = reduce(DataFrame.unionAll, found)
    # A reference needs a definition in the same schema.
    defined = nodes.where(F.col("kind").isin(NAMED)).select("subject", "version", "key", F.lit(True).alias("defined")).distinct()
    joined = nodes.join(defined, ["subject", "version", "key"], "left")
    lost = F.when((F.col("kind") == "reference") & F.col("defined").isNull(), F.concat(F.lit("unknown type "), F.substr("key", F.lit(7))))
    nodes = joined.withColumn("problem", F.coalesce("problem", lost)).select(*columns)
    broken = checked.where("problem IS NOT NULL").select("subject", "version", "problem")
    nodes = nodes.unionByName(broken, allowMissingColumns=True)
    # written, since an evaluation looks at the nodes several times
    path = scratch_dir(spark, "schema-tree")
    nodes.write.parquet(path)
    return spark.read.schema(nodes.schema).parquet(path)


def mutate_nodes(nodes: DataFrame, name: str, new_type: str) -> DataFrame:
    """Every field called ``name``, at any depth, retyped to a primitive; fails for a schema without one.

    Adds ``mutations``, the number of fields changed in the schema of the row.
    """
    if new_type not in PRIMITIVES:
        raise ValueError(f"{new_type!r} is no primitive type")
    is_hit = (F.col("path") == name) | F.endswith(F.col("path"), F.lit(f".{name}"))
    hits = F.count_if((F.col("node") == "field") & is_hit)
    counts = nodes.groupBy("subject", "version").agg(hits.alias("__m")).select(
        "subject",
        "version",
        F.when(F.col("__m") > 0, F.col("__m"))
        .otherwise(F.raise_error(F.lit(f"no field named {name} to change")).cast("bigint"))
        .alias("mutations"),
    )
    marked = nodes.join(counts, ["subject", "version"])
    replaced = marked.where((F.col("node") == "field") & is_hit).select(
        "subject", "version", F.lit("type").alias("node"), "path", F.lit(new_type).alias("key"), F.lit(new_type).alias("kind"), "mutations"
    )
    kept = marked.where(~((F.col("node") == "type") & is_hit))
    return kept.unionByName(replaced, allowMissingColumns=True)


def _reads(writer: Column, reader: Column) -> Column:
    ok = writer["key"] == reader["key"]
    for name, readers in PROMOTIONS.items():
        ok = ok | ((writer["key"] == name) & reader["key"].isin(readers))
    return ok


def evaluate_tree(nodes: DataFrame, previous: int, candidate: int) -> DataFrame:
    """Per subject what changed between two versions, by path, and whether the candidate reads the old data.

    Columns as in ``contracts.evaluate_evolution``, and ``unreadable``: the places and types that
    the candidate cannot read. Only what lies in types that both versions have is compared; a type that is new
    as a whole needs no defaults. The lists are bounded by one schema document.
    """
    side = F.col("version")
    both = nodes.where(side.isin(previous, candidate))
    old, new = side == previous, side == candidate
    is_type = F.col("node") == "type"
    branch = F.struct("key", "kind", "symbols", "size", "logical", "has_default")
    places = (
        both.where("problem IS NULL")
        .groupBy("subject", "path")
        .agg(
            F.array_sort(F.collect_set(F.when(is_type & old, branch))).alias("writer"),
            F.array_sort(F.collect_set(F.when(is_type & new, branch))).alias("reader"),
            F.bool_or(old & (F.col("node") == "field")).alias("old_field"),
            F.bool_or(new & (F.col("node") == "field")).alias("new_field"),
            F.max(F.when(new & (F.col("node") == "field"), F.col("has_default"))).alias("default"),
        )
    )
    # The record a field belongs to, and whether both versions have it.
    field_owner = F.when(F.contains("path", F.lit(".")), F.substring_index("path", ".", 1)).otherwise(F.lit(ROOT))
    owners = both.where("key LIKE 'named:%' AND kind IN ('record', 'error')").groupBy(
        "subject", F.substr("key", F.lit(7)).alias("owner")
    ).agg(F.count_distinct("version").alias("versions"))
    placed = places.withColumn("owner", field_owner).join(owners, ["subject", "owner"], "left")
    shared = F.coalesce(F.col("versions") == 2, F.lit(False))
    same = F.col("writer") == F.col("reader")
    unread = ~F.forall("writer", lambda w: F.exists("reader", lambda r: _reads(w, r)))
    change = (
        F.when(~shared, None)
        .when(F.col("old_field") & ~F.col("new_field"), "removed")
        .when(F.col("new_field") & ~F.col("old_field"), F.when(F.col("default"), "added").otherwise("added_without_default"))
        .when(~same & (F.size("writer") > 0) & (F.size("reader") > 0), F.when(unread, "retyped").otherwise("promoted"))
    )
    changes = placed.select("subject", "path", change.alias("change")).where("change IS NOT NULL")
    # Named types with contents of their own: symbols an enum has lost, sizes.
    named = both.where(is_type & F.col("kind").isin("enum", "fixed")).groupBy("subject", F.substr("key", F.lit(7)).alias("path")).agg(
        F.max(F.when(old, F.col("symbols"))).alias("had"), F.max(F.when(new, F.col("symbols"))).alias("has"),
        F.max(F.when(old, F.col("size"))).alias("was"), F.max(F.when(new, F.col("size"))).alias("is"),
        F.max(F.when(new, F.col("has_default"))).alias("default"), F.count_distinct("version").alias("versions"),
    )
    lost = (F.size(F.array_except("had", "has")) > 0) & ~F.coalesce("default", F.lit(False))
    shrunk = named.where((F.col("versions") == 2) & (F.coalesce(lost, F.lit(False)) | (~F.col("was").eqNullSafe(F.col("is")))))
    broken = both.where("problem IS NOT NULL").select("subject", F.coalesce("path", F.lit(ROOT)).alias("path"), F.lit("broken").alias("change"))
    subjects = both.select("subject", F.lit("").alias("path"), F.lit("none").alias("change")).distinct()
    everything = (
        changes.unionByName(shrunk.select("subject", "path", F.lit("unreadable").alias("change"))).unionByName(broken).unionByName(subjects)
    )

    def names(*kinds: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("change").isin(*kinds), F.col("path")))), ",")

    out = everything.groupBy("subject").agg(
        names("removed").alias("removed_fields"),
        names("added", "added_without_default").alias("added_fields"),
        names("promoted", "retyped").alias("changed_field_types"),
        names("added_without_default").alias("added_fields_without_defaults"),
        names("retyped", "unreadable", "broken").alias("unreadable"),
    )
    out = out.withColumn("backward_compatible", (F.col("unreadable") == "") & (F.col("added_fields_without_defaults") == ""))
    quiet = (F.col("removed_fields") == "") & (F.col("changed_field_types") == "")
    return out.withColumn("passed", F.col("backward_compatible") & quiet)
