"""Secret scans over a ledger of blobs; built-in column functions only.

A text is addressed by its SHA-256. The ledger holds, for every blob and rule version already
scanned, the spans found. A run reads every version of every path, scans each distinct blob only
under the rules it was not scanned under, appends the findings, and joins the ledger back to all
paths that hold the blob now or held it before.

Offsets come from the pieces between and at the matches: ``split`` and ``regexp_extract_all``
walk the same leftmost non-overlapping matches, so running lengths give each match its place in
code points. Running lengths are summed in chunks, so the work grows with the number of matches,
not with its square.

Defined cases: null and empty texts have no finding; a text of any length is read whole, whatever
the number of its matches; spans that start together are in the order of the rules; repeated rows
are reported each; a null path is passed through; an empty table gives no rows; other columns are
ignored; a ledger row appended twice is read once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm.content import digest, one_text_each
from tallycast.llm.shared import scratch_path, stage

# rule: pattern, group whose length counts, least length. A run too short to match from its first
# character is too short from every later one, so the least length may stand in the pattern of
# the last two; the look-behind only spares retries.
RULES = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
               r"""([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
VERSION = "1"
SPANS = "array<struct<kind:string,start:int,end:int>>"
CHUNK = 128  # matches whose places are found one after the other
LEDGER = f"blob string, rule string, version string, spans {SPANS}"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def rule_spans(text: str, rule: str):
    """Spans of one rule in the column ``text``."""
    pattern, group, least = RULES[rule]
    p = _quoted(pattern)
    none = f"CAST(array() AS {SPANS})"
    pieces = f"""zip_with(
            split({text}, {p}, -1),
            zip_with(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}),
              (m, g) -> struct(char_length(m) AS size, char_length(g) AS counted)),
            (gap, m) -> struct(char_length(gap) AS gap, coalesce(m.size, 0) AS size, m.counted AS counted))"""
    # arrays of one element name what is used more than once: the pieces, then where chunks start
    chunk = f"slice(p, k * {CHUNK} + 1, {CHUNK})"
    starts = f"""aggregate(
            transform(sequence(0, (size(p) - 1) div {CHUNK}), k ->
              aggregate({chunk}, 0, (s, x) -> s + x.gap + x.size)),
            struct(0 AS at, CAST(array() AS array<int>) AS out),
            (s, n) -> struct(s.at + n AS at, concat(s.out, array(s.at)) AS out), s -> s.out)"""
    spans = f"""flatten(transform({starts}, (start, k) -> aggregate(
            {chunk}, struct(start AS at, {none} AS out),
            (s, x) -> struct(s.at + x.gap + x.size AS at,
              CASE WHEN x.counted >= {least} THEN concat(s.out, array(struct('{rule}' AS kind,
                s.at + x.gap AS start, s.at + x.gap + x.size AS end))) ELSE s.out END AS out),
            s -> s.out)))"""
    return F.expr(f"CASE WHEN {text} RLIKE {p} THEN transform(array({pieces}), p -> {spans})[0] ELSE {none} END")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger_path: str, path_col: str = "doc_id",
         text_col: str = "text", rule_versions: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``versions`` (every historical text of every path): the path, ``blob``
    and ``spans`` under the current rule versions, by start, then rule as listed.

    Appends to the ledger what it lacks before it returns.
    """
    spark = versions.sparkSession
    rules = rule_versions or dict.fromkeys(RULES, VERSION)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = versions.select(text.alias("body"), digest(F.col(text_col)).alias("blob"))
    current = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    known = read_ledger(spark, ledger_path).where(F.col("version") == current[F.col("rule")])

    seen = known.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    wanted = F.array(*map(F.lit, rules))
    unseen = stage(keyed.select("blob").distinct().join(seen, "blob", "left").select(
        "blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        .alias("todo")).where(F.size("todo") > 0), "unseen-blobs")
    texts = one_text_each(keyed, unseen.select("blob"), "blob", "body").join(unseen, "blob")
    found = F.array(*[
        F.when(F.array_contains("todo", r), F.struct(
            F.lit(r).alias("rule"), F.lit(v).alias("version"), rule_spans("body", r).alias("spans")))
        for r, v in rules.items()])
    texts.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(
        "blob", "f.*").write.mode("append").parquet(ledger_path)

    ledger = read_ledger(spark, ledger_path).where(F.col("version") == current[F.col("rule")])
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r, i)])
    hits = (ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"))
            .groupBy("blob").agg(F.collect_set(F.struct(
                F.col("s.start"), order[F.col("s.kind")].alias("n"), F.col("s.kind"),
                F.col("s.end"))).alias("hits")))
    paths = versions.select(F.col(path_col).alias(path_col), digest(F.col(text_col)).alias("blob"))
    spans = F.transform(F.sort_array(F.coalesce("hits", F.array())), lambda h: F.struct(
        h["kind"].alias("kind"), h["start"].alias("start"), h["end"].alias("end")))
    # a blob that many paths hold is split by the adaptive skew join
    return paths.join(hits, "blob", "left").select(path_col, "blob", spans.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Digest of ``scan`` over all documents, starting from an empty ledger."""
    found = scan(docs, scratch_path(docs.sparkSession, "blob-ledger"))

    def count(rule):
        return F.size(F.filter("spans", lambda s: s["kind"] == rule)).cast("long")

    listed = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", *[count(r).alias(f"n_{r}") for r in RULES],
                        F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


_SQL_RULES = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
               r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
_SQL_SPANS = " UNION ALL ".join(f"""
  SELECT doc_id, {n} AS n, '{kind}' AS kind, ends - len(m) AS start, ends AS stop FROM (
    SELECT doc_id, m, g, sum(len(gap) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM (
      SELECT doc_id, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs) AS g,
             unnest(list_slice(gaps, 1, len(ms))) AS gap
      FROM (SELECT doc_id, regexp_extract_all(body, '{p}', 0) AS ms, regexp_extract_all(body, '{p}', {group}) AS gs,
                   string_split_regex(body, '{p}') AS gaps FROM docs)))
  WHERE len(g) >= {least}""" for n, (kind, (p, group, least)) in enumerate(_SQL_RULES.items()))
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS ({_SQL_SPANS}),
listed AS (
  SELECT doc_id, count(*) FILTER (WHERE n = 0) AS n_assign, count(*) FILTER (WHERE n = 1) AS n_access,
         count(*) FILTER (WHERE n = 2) AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, n) AS spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)"""
