"""Secret scan with corpus-wide ownership frequency.

Candidates come from patterns; the hash of each candidate's value is counted over the whole corpus by
distinct repositories and distinct owners. A value that many owners have is a copied example, one of
few owners looks live. The base patterns' spans are always reported; candidates of the wider patterns
are added only where their value belongs to few owners. Column expressions and joins only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnscore.llm.common import staged
from dawnscore.llm.spans import with_matches

# The base patterns. Possessive forms and the look-behind only save time: a shorter
# run never matches, and inside a run no later start can match where the first one failed.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
BASE_KINDS = ("assign", "access", "hex")
# Wider patterns: key blocks, prefixed tokens, signed tokens, credentials in addresses, long runs.
_GAP = r"\x20\x09-\x0D"
WIDER = {
    "pem": (rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----[A-Za-z0-9+/={_GAP}]+-----END [A-Z ]{{0,30}}PRIVATE KEY-----"),
    "prefixed": r"(?:gh[opsu]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|sk-|AIza|npm_|hf_)[A-Za-z0-9_-]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "url": rf"://[^{_GAP}/:@]{{1,100}}:[^{_GAP}/@]{{6,100}}@",
    "mixed": r"[A-Za-z0-9+/_-]{32,}",
}
_SHORTER = {"mixed": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+"}  # the same matches, without trying each start
KINDS = (*BASE_KINDS, *WIDER)
_ORDER = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


def _joined(spans: str, kinds: str = _ORDER) -> Column:
    """kind:start:end, comma-joined, by start and then by kind as listed."""
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> struct(x.start as start, "
                  f"array_position({kinds}, x.kind) as at, x.kind as kind, x.end as end))), "
                  "x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def _text_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), text, F.char_length(text))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base` and `wider`: arrays of (kind, start, end, value)."""
    patterns = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0),
                **{k: (_SHORTER.get(k, p), 0) for k, p in WIDER.items()}}
    renamed = {k: (f"_m_{k}", v) for k, v in patterns.items()}
    found = with_matches(docs, {new: v for new, v in renamed.values()}, text)

    kept = {"assign": "filter(_m_assign, x -> char_length(x.part) >= 6)",
            "mixed": "filter(_m_mixed, x -> x.part rlike '[0-9]' and x.part rlike '[A-Z]' and x.part rlike '[a-z]')"}

    def gathered(kinds: tuple[str, ...]) -> Column:
        parts = [f"transform({kept.get(k, f'_m_{k}')}, "
                 f"x -> struct('{k}' as kind, x.start as start, x.end as end, x.part as value))" for k in kinds]
        return F.expr(f"concat({', '.join(parts)})")
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), gathered(BASE_KINDS).alias("base"),
                        gathered(tuple(WIDER)).alias("wider"))


def ownership(spans: DataFrame) -> DataFrame:
    """hash → n_repositories, n_owners, n_found, counted in two steps so that a hot value is split.

    spans: hash, repository, owner."""
    once = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    return (once.groupBy("hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
            .groupBy("hash").agg(F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"),
                                 F.sum("n").alias("n_found")))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                owner: Column | None = None, repository: Column | None = None,
                live_owners: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, text_key (hash of id and text), counts, base_sha256, spans (text) and found (array).

    found holds (kind, start, end, n_owners, n_repositories, live); live means at most `live_owners`
    owners hold the value. Null and empty texts have no spans; a null owner or repository counts as
    one unknown one; repeated rows count their owner once; a null id stays null; an empty table gives
    no rows. Owner and repository default to `source` and (`source`, `lang`).
    """
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.coalesce(F.xxhash64(owner.cast("string")), F.lit(0)).alias("owner"),
                         F.xxhash64(repository.cast("string")).alias("repository"))
    rows = staged(
        candidates(picked).select(
            F.monotonically_increasing_id().alias("row_no"), "doc_id", _text_key(F.col("doc_id"), F.col("text")).alias("text_key"), "owner", "repository",
            *(F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS),
            _joined("base").alias("_base"),
            F.expr("transform(concat(base, wider), x -> struct(x.kind as kind, x.start as start, x.end as end, "
                   "sha2(x.value, 256) as hash))").alias("all")),
        "secrets")
    spans = rows.select("row_no", "owner", "repository", F.explode("all").alias("x")).select(
        "row_no", "owner", "repository", "x.*")
    counted = staged(ownership(spans), "ownership")
    base = F.col("kind").isin(*BASE_KINDS)
    judged = (spans.join(counted, "hash")
              .withColumn("live", F.col("n_owners") <= live_owners)
              .filter(base | F.col("live"))
              .groupBy("row_no").agg(F.collect_list(F.struct(
                  "kind", "start", "end", "n_owners", "n_repositories", "live")).alias("found")))
    empty = "cast(array() as array<struct<kind:string,start:bigint,end:bigint,n_owners:bigint,n_repositories:bigint,live:boolean>>)"
    return (rows.join(judged, "row_no", "left")
            .withColumn("found", F.coalesce("found", F.expr(empty)))
            .select("doc_id", "text_key", *(f"n_{k}" for k in BASE_KINDS),
                    F.sha2(F.col("_base"), 256).alias("base_sha256"), _joined("found").alias("spans"),
                    F.expr("cast(size(filter(found, x -> x.live)) as bigint)").alias("n_live"), "found"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, mark: str = "[secret]",
             live_owners: int = 2, broadcast_rows: int = 100_000) -> DataFrame:
    """docs with every reported span replaced by `mark`, and n_chars, where there is one, counted anew.

    Overlapping spans are merged. Spans are joined to their rows by a hash of id and text, so repeated
    rows are all cut. Rows without spans, the order of columns and all other values stay.
    """
    hits = staged(
        secret_scan(docs, id_col, text_col, live_owners=live_owners).filter("size(found) > 0")
        .groupBy("text_key").agg(F.expr("first(array_sort(transform(found, x -> struct(x.start as s, x.end as e))))")
                                 .alias("spans"))
        .select(F.col("text_key").alias("_text_key"), F.col("spans").alias("_spans")), "secret-spans")
    if hits.count() <= broadcast_rows:  # checked size; beyond it the texts are shuffled
        hits = F.broadcast(hits)
    joined = docs.join(hits, _text_key(F.col(id_col), F.col(text_col)) == F.col("_text_key"), "left")
    cut = F.expr(f"""aggregate(_spans, named_struct('at', 0L, 'out', ''), (acc, x) ->
        CASE WHEN x.e <= acc.at THEN acc
             WHEN x.s < acc.at THEN named_struct('at', x.e, 'out', acc.out)
             ELSE named_struct('at', x.e, 'out', concat(acc.out,
                substring(`{text_col}`, cast(acc.at as int) + 1, cast(x.s - acc.at as int)), '{mark}')) END,
        acc -> concat(acc.out, substring(`{text_col}`, cast(acc.at as int) + 1)))""")
    text = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut)
    out = joined.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        counted = F.char_length(text_col).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(counted))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle_sql(table: str = "documents", live_owners: int = 2) -> str:
    """The query's rows in DuckDB SQL; its patterns run in linear time and need no shortcuts."""
    patterns = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}",
                "hex": "[0-9a-f]{24,}", **WIDER}
    scans = []
    for at, (kind, pattern) in enumerate(patterns.items(), 1):
        quoted = pattern.replace("'", "''")
        scans.append(f"""
SELECT row_no, source, lang, '{kind}' AS kind, {at} AS kind_no, hit,
       {"regexp_extract(hit, '" + quoted + "', 2)" if kind == "assign" else "hit"} AS value,
       list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS start
FROM (SELECT row_no, source, lang, gaps, hits, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i
      FROM (SELECT row_no, source, lang, string_split_regex(text, '{quoted}') AS gaps,
                   regexp_extract_all(text, '{quoted}') AS hits FROM docs))""")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, source, lang FROM {table}),
matched AS ({" UNION ALL ".join(scans)}),
kept AS (
  SELECT *, start + length(hit) AS stop, sha256(value) AS hash FROM matched
  WHERE (kind <> 'assign' OR length(value) >= 6)
    AND (kind <> 'mixed' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]')
                             AND regexp_matches(value, '[a-z]')))),
owners AS (SELECT hash, count(DISTINCT coalesce(source, chr(0))) AS n_owners FROM kept GROUP BY hash),
judged AS (SELECT kept.*, n_owners <= {live_owners} AS live FROM kept JOIN owners USING (hash)),
per_row AS (
  SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no <= 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no <= 3 OR live) AS spans,
         count(*) FILTER (live) AS n_live
  FROM judged GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM docs LEFT JOIN per_row USING (row_no)"""
