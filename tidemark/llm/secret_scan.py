"""Secret scanning with an incremental ledger of content-addressed blobs.

A version is one historical content of a path. Its blob is addressed by SHA-256, so a content
that many paths or versions share is scanned once; pairs of blob and rule version that the
ledger already has are not scanned again. Findings belong to blobs and are joined back to
every version. Regular expressions run in the JVM; the position of a match follows from the
lengths of the matches and of the pieces between them.

Defined cases: a null text is an empty one and has no findings. Repeated rows share a blob
and each get its findings. Other columns of the versions are ignored. An empty ledger is the
same as none; an empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import written


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; those whose group ``group`` is shorter than ``shortest`` fail.

    ``not_after`` is a class of characters that must not come before a match, which begins with the
    text ``head``. ``version`` goes up
    whenever the rule changes, which makes the next run scan all blobs with it again.
    """

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1
    version: int = 1
    not_after: str = ""
    head: str = ""

    @property
    def regex(self) -> str:
        if not self.not_after:
            return self.pattern
        # The head first: only where it stands, what is before it is looked at.
        return f"{self.head}(?<!{self.not_after}{self.head}){self.pattern.removeprefix(self.head)}"


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# Fixed values of the query contract: the three base rules, in their order.
BASE_RULES = [
    Rule(
        "assign",
        f"({_either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        shortest=8,
    ),
    Rule("access", "AKIA[A-Z0-9]+", shortest=16),
    Rule("hex", "[0-9a-f]{32,}"),  # what [0-9a-f]+ finds, if 32 characters or longer
]

# Further secrets whose shape is public. No part is bounded, and none can begin again inside what it
# reads, so a rule looks at a character of a long run once.
ADDED_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]{16,}", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", version=2, not_after="[A-Za-z0-9_-]", head="eyJ"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{30,}"),
    Rule("bearer", r"[Bb]earer\x20[A-Za-z0-9+/_.=-]{20,}"),
    Rule("url", r"://[^\x09-\x0D\x20:/@]+:[^\x09-\x0D\x20:/@]{3,}@", version=2),
]

RULES = BASE_RULES + ADDED_RULES


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _parts(rule: Rule) -> Column:
    """array<struct<gap, size, n>>: what lies before each match, its length, its group's length."""
    text = F.col("text")
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    between = F.split(text, rule.regex, -1)
    zipped = F.arrays_zip(whole.alias("w"), value.alias("v"), between.alias("b"))
    parts = F.transform(
        F.slice(zipped, 1, F.size(whole)),
        lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["w"]).alias("size"), F.length(x["v"]).alias("n")),
    )
    return F.when(text.rlike(rule.regex), parts)


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES
) -> tuple[DataFrame, DataFrame]:
    """(new findings, new ledger rows) of the blobs in ``versions``, a table with ``text``.

    Findings: ``blob_id, kind, rule_version, start, end`` in code points, end exclusive.
    Ledger rows: ``blob_id, kind, rule_version``, one for each pair that this run scanned.
    """
    blobs = versions.select(blob_id(F.col("text")).alias("blob_id"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = blobs.dropDuplicates(["blob_id"])
    if ledger is not None:
        done = ledger.groupBy("blob_id").agg(F.collect_set(F.concat_ws(":", "kind", "rule_version")).alias("done"))
        blobs = blobs.join(done, "blob_id", "left")
    else:
        blobs = blobs.withColumn("done", F.lit(None).cast("array<string>"))

    def pending(rule: Rule) -> Column:
        return ~F.coalesce(F.array_contains("done", f"{rule.kind}:{rule.version}"), F.lit(False))

    scanned = blobs.select(
        "blob_id",
        F.inline(
            F.filter(
                F.array(
                    *(
                        F.when(
                            pending(rule),
                            F.struct(
                                F.lit(rule.kind).alias("kind"),
                                F.lit(rule.version).alias("rule_version"),
                                F.coalesce(_parts(rule), F.expr("CAST(array() AS array<struct<gap: int, size: int, n: int>>)")).alias("parts"),
                                F.lit(rule.shortest).alias("shortest"),
                            ),
                        )
                        for rule in rules
                    )
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    scanned = written(scanned, "blob-scan")
    rows = scanned.select("blob_id", "kind", "rule_version", "shortest", F.posexplode("parts").alias("i", "part"))
    before = Window.partitionBy("blob_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("part.gap") + F.col("part.size")).over(before)
    findings = rows.withColumn("end", end).where(F.col("part.n") >= F.col("shortest"))
    return (
        findings.select("blob_id", "kind", "rule_version", (F.col("end") - F.col("part.size")).alias("start"), "end"),
        scanned.select("blob_id", "kind", "rule_version"),
    )


def scan_increment(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    known: DataFrame | None = None,
    rules: list[Rule] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """(all findings, whole ledger) after a run over ``versions``.

    ``ledger`` and ``known`` are what the run before returned. Findings of rule versions that are
    no longer in use drop out; blobs that ``versions`` does not mention keep theirs. Both results are
    written, so that they can be joined back, stored and given to the next run.
    """
    found, scanned = scan(versions, ledger, rules)
    found, scanned = written(found, "findings"), written(scanned, "ledger")
    if ledger is not None:
        scanned = scanned.unionByName(ledger.select(*scanned.columns))
    if known is not None:
        in_use = F.concat_ws(":", "kind", "rule_version").isin([f"{r.kind}:{r.version}" for r in rules])
        found = found.unionByName(known.where(in_use).select(*found.columns))
    return found, scanned


def spans_of_blobs(findings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per blob with findings: ``spans``, an array ordered by start, then by rule."""
    order = F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind"))
    return findings.groupBy("blob_id").agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("rule"), "kind", "end"))).alias("spans")
    )


def join_back(versions: DataFrame, findings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Every row of ``versions`` without its text, with ``blob_id`` and ``spans`` (empty if none)."""
    # Written, so that the join reads plain scans and a blob with many paths can be split.
    found = written(spans_of_blobs(findings, rules), "blob-spans")
    kept = [versions[c] for c in versions.columns if c not in ("text", "blob_id", "spans")]
    paths = versions.select(F.struct(*kept).alias("path"), blob_id(versions["text"]).alias("blob_id"))
    nothing = F.expr("CAST(array() AS array<struct<start: bigint, rule: bigint, kind: string, end: bigint>>)")
    joined = paths.join(found, "blob_id", "left")
    return joined.select("path.*", "blob_id", F.coalesce("spans", nothing).alias("spans"))


def joined_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _oracle() -> str:
    def rule(n: int, r: Rule) -> str:
        # RE2 cannot look behind: the character before is read along and the rule's text is a group.
        lead, group = (f"(?:^|[^{r.not_after[1:-1]}])", 1) if r.not_after else ("", r.group)
        pattern = (lead + (f"({r.pattern})" if lead else r.pattern)).replace("'", "''")
        return (
            f"SELECT doc_id, {n} AS rule, '{r.kind}' AS kind, {r.shortest} AS shortest, "
            f"regexp_extract_all(text, '{pattern}') AS w, regexp_extract_all(text, '{pattern}', {group}) AS v, {bool(lead)} AS led, "
            f"regexp_split_to_array(text, '{pattern}') AS b FROM docs"
        )

    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({" UNION ALL ".join(rule(n, r) for n, r in enumerate(RULES))}),
parts AS (
    SELECT doc_id, rule, kind, shortest, led, unnest(range(1, len(w) + 1)) AS i, w, v, b FROM matched WHERE len(w) > 0
), ends AS (
    SELECT doc_id, rule, kind, shortest, length(CASE WHEN led THEN v[i] ELSE w[i] END) AS size, length(v[i]) AS n,
           sum(length(b[i]) + length(w[i])) OVER (PARTITION BY doc_id, rule ORDER BY i) AS stop
    FROM parts
), spans AS (
    SELECT doc_id, rule, kind, CAST(stop - size AS BIGINT) AS start,
           kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span
    FROM ends WHERE n >= shortest
)
SELECT d.doc_id,
       count(*) FILTER (WHERE kind = 'assign') AS n_assign,
       count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rule) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rule), '') AS spans
FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id
GROUP BY d.doc_id
"""


#: Twin of ``op10_secret_scan`` on tables whose doc_ids are distinct.
ORACLE = _oracle()
