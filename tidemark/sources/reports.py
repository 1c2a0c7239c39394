"""Text reports as tables: metric exposition files, offset reports, status documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import metric_key
from tidemark.session import scratch_dir

# The text exposition format: name, labels in braces, value, perhaps a timestamp. A label value is
# quoted, with backslash escapes, and may hold commas and braces. Runs are possessive: each
# character is looked at once and nothing is stacked up for going back, however long the text.
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SAMPLE = (
    r'^([a-zA-Z_:][\w:]*+)(?:\s*+(\{[^"}]*+(?:' + _QUOTED + r'[^"}]*+)*+\}))?\s++([^\s\x01]++)(?:\s++-?\d++)?$'
)
_LABEL = r"[a-zA-Z_]\w*+\s*+=\s*+" + _QUOTED
_PART = "\x01"  # no part of a sample but its labels can hold it


def _unescaped(quoted: Column) -> Column:
    r"""The text between the quotes; ``\\``, ``\"`` and ``\n`` are its escapes."""
    inner = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    parts = F.transform(
        F.split(inner, r"\\\\", -1),
        lambda p: F.replace(F.replace(p, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")),
    )
    return F.array_join(parts, "\\")


def _label_map(block: Column) -> Column:
    """The labels of a sample; of a repeated name the last value counts."""
    labels = F.transform(
        F.regexp_extract_all(block, F.lit(_LABEL), F.lit(0)),
        lambda e, i: F.struct(
            F.rtrim(F.substring_index(e, "=", 1)).alias("k"), i.alias("i"), F.substr(e, F.instr(e, '"')).alias("v")
        ),
    )
    ordered = F.array_sort(labels)  # by name, then place
    names = F.transform(ordered, lambda e: e["k"])
    # Next to each label the next one's name; a lambda that looked it up would sort again for each.
    pairs = F.arrays_zip(ordered.alias("e"), F.slice(names, 2, F.size(names)).alias("next"))
    last = F.transform(F.filter(pairs, lambda p: ~p["next"].eqNullSafe(p["e"]["k"])), lambda p: p["e"])
    repeated = F.size(F.array_distinct(names)) < F.size(names)
    entries = F.transform(F.when(repeated, last).otherwise(labels), lambda e: F.struct(e["k"], _unescaped(e["v"])))
    return F.map_from_entries(entries)


def parse_metrics(lines: DataFrame, text: str = "value") -> DataFrame:
    """Metric samples of exposition lines; comments and lines that are no sample drop out.

    Other columns of ``lines`` are kept; ``name``, ``labels`` and ``metric_value`` (NaN and
    infinities included) are added. A line is matched once: the match puts its parts in front
    of each other, with a mark between them that only labels can hold, and those come last.
    """
    stripped = F.trim(F.col(text))
    parts = F.split(F.regexp_replace(stripped, _SAMPLE, f"{_PART}$1{_PART}$3{_PART}$2"), _PART, 4)
    samples = (
        lines.where(~F.startswith(stripped, F.lit(_PART)))
        .withColumn("__parts", parts)
        .where((F.size("__parts") == 4) & (F.get("__parts", F.lit(0)) == ""))
        .withColumn("metric_value", F.get("__parts", F.lit(2)).try_cast("double"))
        .where(F.col("metric_value").isNotNull())
    )
    kept = [F.col(c) for c in lines.columns if c not in ("name", "labels", "metric_value")]
    return samples.select(
        *kept, F.get("__parts", F.lit(1)).alias("name"), _label_map(F.get("__parts", F.lit(3))).alias("labels"), "metric_value"
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Exposition files; ``file`` and ``line_text`` say where a sample came from."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line_text")
    )
    return parse_metrics(lines, "line_text")


def parse_end_offsets(lines: DataFrame, topic: str, text: str = "value") -> DataFrame:
    """``topic:partition:offset`` lines of one topic; ``malformed`` keeps what does not parse."""
    line = F.trim(F.col(text))
    rest = F.substr(line, F.lit(len(topic) + 2))
    ok = rest.rlike(r"^-?\d+:-?\d+$")
    return lines.where(F.startswith(line, F.lit(topic + ":"))).select(
        F.when(ok, F.substring_index(rest, ":", 1).try_cast("int")).alias("partition"),
        F.when(ok, F.substring_index(rest, ":", -1).try_cast("bigint")).alias("log_end_offset"),
        F.when(~ok, line).alias("malformed"),
    )


def parse_group_offsets(lines: DataFrame, group: str, topic: str, text: str = "value") -> DataFrame:
    """Group report rows of one group and topic.

    A partition without a committed offset (``-``) is an error of the whole
    report, so it comes back with ``malformed`` set instead of being skipped.
    """
    f = F.split(F.trim(F.col(text)), r"\s+")
    mine = (F.size(f) >= 6) & (f[0] == group) & (f[1] == topic)
    offset, end, lag = (f[i].try_cast("bigint") for i in (3, 4, 5))
    ok = offset.isNotNull() & end.isNotNull() & lag.isNotNull()
    return lines.where(mine).select(
        f[2].try_cast("int").alias("partition"),
        offset.alias("current_offset"),
        end.alias("log_end_offset"),
        lag.alias("lag"),
        F.when(~ok, F.trim(F.col(text))).alias("malformed"),
    )


def parse_reset_offsets(lines: DataFrame, group: str, topic: str, text: str = "value") -> DataFrame:
    """``group topic partition new_offset`` rows, several per physical line if need be."""
    quoted = r"(?:^|\s)\Q" + group + r"\E\s+\Q" + topic + r"\E\s+(\d+)\s+(\d+)(?=\s|$)"
    pairs = F.arrays_zip(
        F.regexp_extract_all(F.col(text), F.lit(quoted), 1).alias("p"),
        F.regexp_extract_all(F.col(text), F.lit(quoted), 2).alias("o"),
    )
    return lines.select(F.explode(pairs).alias("z")).select(
        F.col("z.p").try_cast("int").alias("partition"),
        F.col("z.o").try_cast("bigint").alias("new_offset"),
    )


def require_rows(report: DataFrame, what: str) -> DataFrame:
    """The report, or a job failure if it is empty or holds malformed rows."""
    bad = report.select(
        F.count(F.lit(1)).alias("n"),
        F.count("malformed").alias("bad") if "malformed" in report.columns else F.lit(0).alias("bad"),
    ).first()
    if bad.n == 0:
        raise ValueError(f"no rows found in {what}")
    if bad.bad:
        raise ValueError(f"{bad.bad} malformed or uncommitted rows in {what}")
    return report


def connector_states(documents: DataFrame, text: str = "value") -> DataFrame:
    """Status documents: one row per task.

    ``failure_type`` is the trace up to the first colon; no other trace content
    leaves this function.
    """
    status = F.from_json(
        F.col(text),
        "connector STRUCT<state STRING>, tasks ARRAY<STRUCT<id INT, state STRING, trace STRING>>",
    )
    rest = [c for c in documents.columns if c != text]
    trace = F.col("task.trace")
    return (
        documents.select(*rest, status.alias("s"))
        .select(*rest, F.col("s.connector.state").alias("connector_state"), F.explode_outer("s.tasks").alias("task"))
        .select(
            *rest,
            "connector_state",
            F.col("task.id").alias("task_id"),
            F.col("task.state").alias("task_state"),
            F.when(F.length(trace) > 0, F.substring_index(trace, ":", 1)).alias("failure_type"),
        )
    )


#: Levels that the first pass opens, and most of a later one; what lies deeper goes to the next pass.
FIRST_LEVELS, MOST_LEVELS = 6, 24


def _opened(level: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., path, v) one level further down."""
    opened = level.lateralJoin(
        level.sparkSession.tvf.variant_explode_outer(F.when(_is_nested("v"), F.col("v")).outer())
    )
    step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
    return opened.select(
        *keep,
        F.when(step.isNull(), F.col("path"))
        .when(F.col("path") == "", step)
        .otherwise(F.concat_ws(".", "path", step))
        .alias("path"),
        F.coalesce("value", "v").alias("v"),
    )


def _leaf_number() -> Column:
    """The number of a leaf ``v``; null for other leaves and for what is nested still."""
    return F.when(
        F.schema_of_variant("v").rlike(r"^(BIGINT|FLOAT|DOUBLE|DECIMAL.*|STRING)$"),
        F.trim(F.try_variant_get("v", "$", "string")).try_cast("double"),
    )


def flatten_numeric_paths(documents: DataFrame, text: str, depth: int | None = None) -> DataFrame:
    """Every numeric leaf of nested JSON documents as (path, number).

    Texts that read as numbers count, booleans do not. Each level opens the objects and arrays
    left, in one chain over the parsed value. With ``depth`` the chain has that many levels,
    and documents nested deeper fail the job instead of losing leaves. Without it, passes of
    some levels write the leaves they reach and hand the rest on: a document is parsed
    once, and only what lies deeper is read again. Texts that are no JSON have no leaves.
    """
    keep = [c for c in documents.columns if c != text]
    level = documents.select(*keep, F.lit("").alias("path"), F.try_parse_json(text).alias("v"))
    if depth is not None:
        for _ in range(depth):
            level = _opened(level, keep)
        too_deep = F.raise_error(F.lit(f"document nested deeper than {depth}")).cast("double")
        number = F.when(_is_nested("v"), too_deep).otherwise(_leaf_number())
        return level.select(*keep, "path", number.alias("number")).where(F.col("number").isNotNull())

    leaves: DataFrame | None = None
    levels = FIRST_LEVELS
    while True:
        for _ in range(levels):
            level = _opened(level, keep)
        levels = min(2 * levels, MOST_LEVELS)
        reached = level.select(
            *keep, "path", _leaf_number().alias("number"), F.when(_is_nested("v"), F.col("v")).alias("v")
        ).where(F.col("number").isNotNull() | F.col("v").isNotNull())
        path = scratch_dir(documents.sparkSession, "json-leaves")
        reached.write.parquet(path)
        stored = documents.sparkSession.read.schema(reached.schema).parquet(path)
        found = stored.where(F.col("number").isNotNull()).select(*keep, "path", "number")
        leaves = found if leaves is None else leaves.unionByName(found)
        level = stored.where(F.col("v").isNotNull()).select(*keep, "path", "v")
        if level.isEmpty():
            return leaves


def _is_nested(v: str) -> Column:
    """A non-empty object or array."""
    kind = F.schema_of_variant(v)
    return F.coalesce(
        (kind.startswith("OBJECT<") | kind.startswith("ARRAY<"))
        & ~kind.isin("OBJECT<>", "ARRAY<VOID>"),
        F.lit(False),
    )


def max_path_numbers(
    leaves: DataFrame, keys: list[str], wanted: dict[str, tuple[list[str], list[str]]]
) -> DataFrame:
    """Per name the largest leaf whose path contains all tokens and ends in one of the suffixes.

    ``wanted`` maps each name to (tokens, suffixes); without suffixes any end will do.
    """
    path = metric_key("path")
    last = metric_key(F.substring_index("path", ".", -1))

    def largest(tokens: list[str], suffixes: list[str]) -> Column:
        keep = F.lit(True)
        for token in tokens:
            keep = keep & F.contains(path, metric_key(F.lit(token)))
        if suffixes:
            keep = keep & F.exists(
                F.array(*[metric_key(F.lit(s)) for s in suffixes]), lambda s: F.endswith(last, s)
            )
        return F.max(F.when(keep, F.col("number")))

    return leaves.groupBy(*keys).agg(*[largest(*rule).alias(name) for name, rule in wanted.items()])
