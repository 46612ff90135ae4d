"""All queries of the engine over the driver's tables, with the SQL that states their results.

The tables hold no C sources, so each operator runs on columns that stand in
for its own: a language for a family, a customer's orders for regions of a
file, and so on. The operators are the library's; only names are substituted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import build, ids, paths, ranks, regions, text, weakness
from ..operators import budget, dedup, gate, graph, intake, intervals, lookups, matching, metrics, quality, resolution
from ..sources import diagnostics, records

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def _all() -> None:
    """The other modules add their queries when they are imported."""
    from . import finding_queries, function_queries, relation_queries, store_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["prf_by_family"](spark, sf_dir)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    joined = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang"), "doc_id")
    truth, found = F.col("toxic") == 1, F.col("quality") == 0
    kind = F.when(truth & found, "tp").when(found, "fp").when(truth, "fn")
    return joined.select(F.col("lang").alias("family"), kind.alias("outcome")).where("outcome is not null")


_COUNTS = """
counts AS (
  SELECT lang AS family, count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fp,
         count(*) FILTER (toxic = 1 AND quality <> 0) AS fn
  FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0 GROUP BY lang
), scored AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS precision,
         CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS recall FROM counts
), families AS (
  SELECT *, CASE WHEN precision = 0 AND recall = 0 THEN 0.0 ELSE 5.0::DOUBLE * precision * recall / (4.0::DOUBLE * precision + recall) END AS f2, tp + fp + fn > 0 AS scored FROM scored
)"""


@query("prf_by_family", f"WITH {_COUNTS} SELECT * FROM families")
def prf_by_family(s: SparkSession, d: str) -> DataFrame:
    return metrics.family_metrics(metrics.counts_by_family(_outcomes(s, d)))


@query(
    "macro_f2",
    f"""WITH {_COUNTS} SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp)::DOUBLE / (sum(tp) + sum(fp))::DOUBLE AS precision,
    sum(tp)::DOUBLE / (sum(tp) + sum(fn))::DOUBLE AS recall, round(avg(f2), 9) AS macro_f2 FROM families""",
)
def macro_f2(s: SparkSession, d: str) -> DataFrame:
    return metrics.overall_metrics(prf_by_family(s, d))


@query(
    "gates",
    f"""WITH {_COUNTS}, m AS (SELECT round(avg(f2), 9) AS f2 FROM families), r AS (
      SELECT count(*) FILTER (l.doc_id IS NOT NULL)::DOUBLE / count(*)::DOUBLE AS rate, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
    SELECT 'citation_resolution' AS name, rate >= 0.95 AS passed, round(rate, 6) AS observed, 0.95::DOUBLE AS threshold FROM r
    UNION ALL SELECT 'zero_fabrication', missing = 0, missing::DOUBLE, 0.0::DOUBLE FROM r
    UNION ALL SELECT 'counts_separate', true, 0.0::DOUBLE, 0.0::DOUBLE
    UNION ALL SELECT 'baseline_floor', f2 >= 0.25, round(f2, 6), 0.25::DOUBLE FROM m""",
)
def gates(s: SparkSession, d: str) -> DataFrame:
    cited = t(s, d, "documents").select("doc_id").join(t(s, d, "labels").select("doc_id").distinct().withColumn("status", F.lit("ok")), "doc_id", "left")
    rate = metrics.resolution_rate(cited.select(F.coalesce("status", F.lit("missing_file")).alias("status")))
    one = macro_f2(s, d).select("macro_f2").crossJoin(rate)
    return metrics.gates(one.select(F.col("rate").alias("citation_rate"), (F.col("total") - F.col("resolved")).alias("fabrications"), F.lit(0).alias("merged_counts"), "macro_f2", F.lit(0.25).alias("baseline_f2")))


@query(
    "category_f1",
    """WITH j AS (SELECT doc_id, lang AS truth, CASE WHEN quality = 1 THEN lang ELSE 'en' END AS predicted FROM labels JOIN documents USING (doc_id)),
    e AS (SELECT truth AS category, count(*) AS expected FROM j GROUP BY 1), a AS (SELECT predicted AS category, count(*) AS actual FROM j GROUP BY 1),
    o AS (SELECT truth AS category, count(*) AS overlap FROM j WHERE truth = predicted GROUP BY 1),
    c AS (SELECT category, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(overlap, 0) AS overlap FROM e FULL JOIN a USING (category) LEFT JOIN o USING (category)),
    p AS (SELECT *, CASE WHEN actual = 0 THEN 1.0 ELSE overlap::DOUBLE / actual END AS p, CASE WHEN expected = 0 THEN 1.0 ELSE overlap::DOUBLE / expected END AS r FROM c)
    SELECT category, expected, actual, overlap, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM p""",
)
def category_f1(s: SparkSession, d: str) -> DataFrame:
    j = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang"), "doc_id")
    truth = j.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("category"))
    return quality.category_f1(truth, j.select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, F.col("lang")).otherwise("en").alias("category")))


def _scored(s: SparkSession, d: str) -> DataFrame:
    confidence = F.when(F.col("n_chars") >= 3000, "high").when(F.col("n_chars") >= 1000, "medium").otherwise("review_required")
    return t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select(confidence.alias("confidence"), (F.col("quality") == 1).alias("truth"))


_BINS = """bins AS (
  SELECT place, l.confidence, count(x.confidence) AS count, count(*) FILTER (x.truth) AS correct
  FROM (VALUES (0, 'high'), (1, 'medium'), (2, 'review_required')) l(place, confidence) LEFT JOIN (
    SELECT CASE WHEN n_chars >= 3000 THEN 'high' WHEN n_chars >= 1000 THEN 'medium' ELSE 'review_required' END AS confidence, quality = 1 AS truth FROM labels JOIN documents USING (doc_id)) x
  ON l.confidence = x.confidence GROUP BY ALL
), acc AS (SELECT *, CASE WHEN count = 0 THEN 1.0 ELSE correct::DOUBLE / count::DOUBLE END AS accuracy FROM bins)"""


@query("calibration_bins", f"WITH {_BINS} SELECT * FROM acc")
def calibration_bins(s: SparkSession, d: str) -> DataFrame:
    return quality.reliability(_scored(s, d))


@query(
    "miscalibration",
    f"""WITH {_BINS}, n AS (SELECT *, lead(confidence) OVER (ORDER BY place) AS weaker, lead(accuracy) OVER (ORDER BY place) AS weaker_accuracy FROM acc WHERE count >= 5)
    SELECT confidence AS stronger, round(accuracy, 9) AS stronger_accuracy, weaker, round(weaker_accuracy, 9) AS weaker_accuracy FROM n WHERE accuracy < weaker_accuracy ORDER BY place LIMIT 1""",
)
def miscalibration(s: SparkSession, d: str) -> DataFrame:
    return quality.miscalibration(calibration_bins(s, d))


@query(
    "pooled_calibration",
    """WITH x AS (SELECT CASE WHEN n_chars >= 3000 THEN 'high' WHEN n_chars >= 1000 THEN 'medium' ELSE 'review_required' END AS confidence, quality = 1 AS truth FROM labels JOIN documents USING (doc_id)
      UNION ALL SELECT CASE WHEN l_returnflag = 'A' THEN 'high' ELSE 'medium' END, l_tax > 0.04 FROM lineitem),
    n AS (SELECT place, l.confidence, count(x.confidence) AS count, count(*) FILTER (x.truth) AS correct FROM (VALUES (0, 'high'), (1, 'medium'), (2, 'review_required')) l(place, confidence) LEFT JOIN x USING (confidence) GROUP BY ALL)
    SELECT *, CASE WHEN count = 0 THEN 1.0 ELSE correct::DOUBLE / count::DOUBLE END AS accuracy FROM n""",
)
def pooled_calibration(s: SparkSession, d: str) -> DataFrame:
    other = t(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "high").otherwise("medium").alias("confidence"), (F.col("l_tax") > 0.04).alias("truth"))
    return quality.pooled(calibration_bins(s, d), quality.reliability(other))


_LEVEL = "CASE WHEN {c} % 4 = 0 THEN 'critical' WHEN {c} % 4 = 1 THEN 'high' WHEN {c} % 4 = 2 THEN 'medium' ELSE 'low' END"


def _level(c: str):
    return F.when(F.col(c) % 4 == 0, "critical").when(F.col(c) % 4 == 1, "high").when(F.col(c) % 4 == 2, "medium").otherwise("low")


@query(
    "severity_agreement",
    f"""WITH x AS (SELECT {_LEVEL.format(c='l_linenumber')} AS reported, CASE WHEN l_returnflag = 'N' THEN NULL ELSE {_LEVEL.format(c='l_partkey')} END AS adjudicated FROM lineitem),
    r AS (SELECT list_position(['critical','high','medium','low'], reported) AS a, list_position(['critical','high','medium','low'], adjudicated) AS b FROM x WHERE adjudicated IS NOT NULL)
    SELECT count(*) AS compared, count(*) FILTER (a = b) AS exact, count(*) FILTER (a < b) AS overstated, count(*) FILTER (a > b) AS understated FROM r""",
)
def severity_agreement(s: SparkSession, d: str) -> DataFrame:
    return quality.severity_agreement(t(s, d, "lineitem").select(_level("l_linenumber").alias("reported"), F.when(F.col("l_returnflag") != "N", _level("l_partkey")).alias("adjudicated")))


@query(
    "kappa_agreement",
    """WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = toxic) AS a FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    s AS (SELECT sum(n)::BIGINT AS cases, sum(a)::BIGINT AS agreed, sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE AS chance, sum(a)::DOUBLE / sum(n)::DOUBLE AS raw, count(*) AS k FROM c)
    SELECT cases, agreed, raw AS raw_agreement, CASE WHEN k >= 2 THEN CASE WHEN chance >= 1 THEN 1.0 ELSE (raw - chance) / (1.0 - chance) END END AS kappa FROM s""",
)
def kappa_agreement(s: SparkSession, d: str) -> DataFrame:
    return quality.agreement(t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("category"), (F.col("quality") == F.col("toxic")).alias("agreed")))


@query(
    "ndcg_at_10",
    """WITH j AS (SELECT lang, quality, n_chars, doc_id FROM labels JOIN documents USING (doc_id)),
    a AS (SELECT lang, sum(quality / log2(r + 1)) AS dcg FROM (SELECT lang, quality, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM j) WHERE r <= 10 GROUP BY 1),
    i AS (SELECT lang, sum(quality / log2(r + 1)) AS ideal FROM (SELECT lang, quality, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, n_chars DESC, doc_id) AS r FROM j) WHERE r <= 10 GROUP BY 1)
    SELECT lang, round(CASE WHEN ideal = 0 THEN 1.0 ELSE dcg / ideal END, 9) AS ndcg FROM a JOIN i USING (lang)""",
)
def ndcg_at_10(s: SparkSession, d: str) -> DataFrame:
    j = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return quality.ndcg(j, "lang", "quality", [F.col("n_chars").desc(), F.col("doc_id")])


@query(
    "fp_per_thousand",
    """SELECT count(*) FILTER (toxic <> 1 AND quality = 0) AS false_positives, sum(n_chars)::BIGINT AS units,
    CASE WHEN sum(n_chars) > 0 THEN count(*) FILTER (toxic <> 1 AND quality = 0) / (sum(n_chars)::DOUBLE / 1000.0::DOUBLE) ELSE 0.0 END AS rate FROM labels JOIN documents USING (doc_id)""",
)
def fp_per_thousand(s: SparkSession, d: str) -> DataFrame:
    j = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    n = j.agg(F.count_if((F.col("toxic") != 1) & (F.col("quality") == 0)).alias("false_positives"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("units"))
    return n.withColumn("rate", metrics.fp_per_thousand(F.col("false_positives"), F.col("units")))


_REASON = """CASE WHEN source = 'src19' THEN 'not_selected' WHEN source = 'src3' THEN 'generated' WHEN source IN ('src4', 'src5') THEN 'third_party' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unsupported_language'
  WHEN text IS NULL OR text = '' THEN 'missing_source' WHEN n_chars > 9000 THEN 'too_large' WHEN contains(substr(text, 1, 8192), 'Licensed under') THEN 'generated' END"""


def _files(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    reason = paths.exclusion_reason(
        F.col("path"), exists=F.col("text") != "", size=F.col("n_chars"), text=F.col("text"), language_supported=F.col("lang").isin("en", "de", "fr"), targets=[f"src{i}" for i in range(19)],
        max_bytes=9000, generated_name=F.col("source") == "src3", third_party=F.col("source").isin("src4", "src5"), banner=F.contains(F.substring("text", 1, 8192), F.lit("Licensed under")),
    )
    return intake.classified(docs, reason)


@query("exclusion_reason", f"SELECT doc_id, {_REASON} AS reason FROM documents")
def exclusion_reason(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select("doc_id", "reason")


@query("reason_counts", f"SELECT coalesce({_REASON}, 'selected') AS reason, count(*) AS files FROM documents GROUP BY 1")
def reason_counts(s: SparkSession, d: str) -> DataFrame:
    return intake.reason_counts(_files(s, d))


@query(
    "coverage_ratio",
    """WITH c AS (SELECT count(*) AS present, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS covered FROM documents)
    SELECT present, covered, covered::DOUBLE / present::DOUBLE AS ratio, CASE WHEN covered::DOUBLE / present + 1e-9 < 0.6 THEN 'refused' WHEN covered < present THEN 'limited' ELSE 'complete' END AS verdict FROM c""",
)
def coverage_ratio(s: SparkSession, d: str) -> DataFrame:
    return intake.completeness(intake.coverage(t(s, d, "documents").select("doc_id"), t(s, d, "labels").select("doc_id"), "doc_id"))


@query("uncovered", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncovered(s: SparkSession, d: str) -> DataFrame:
    return intake.absent(t(s, d, "documents"), t(s, d, "labels"), "doc_id")


@query(
    "unmatched_targets",
    """WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages), g AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' || x AS target FROM pages, (VALUES ('en'), ('it')) v(x))
    SELECT target FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE path = target OR starts_with(path, target || '/'))""",
)
def unmatched_targets(s: SparkSession, d: str) -> DataFrame:
    pages = t(s, d, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    targets = pages.select(F.explode(F.array(F.concat(host, F.lit("/en")), F.concat(host, F.lit("/it")))).alias("target")).distinct()
    return intake.unmatched_targets(targets, pages.select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path")))


@query(
    "token_estimate",
    "SELECT doc_id, (ceil(length(coalesce(text, '')) / 3.0::DOUBLE) + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))::BIGINT AS tokens FROM documents",
)
def token_estimate(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_FILE = r"(?i)(?:[\pL\pN_.\-]+/)*[\pL\pN_.\-]+\.(?:c|h|cc|cpp|cxx|hpp|hh|hxx|inc|ipp)(?:([^\pL\pN_])|$)"
_NORMAL = (
    r"regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '''[^'']*''|\"[^\"]*\"|`[^`]*`|‘[^’]*’', '<id>', 'g'),"
    r" '\b0[xX][0-9a-fA-F]+\b|\b\d+\b', '<n>', 'g'), '\s+', ' ', 'g'))), '[ .;:]+$', '')"
).replace('\\"', '"')


@query("normalize_message", f"SELECT doc_id, sha256({_NORMAL}) AS digest, length({_NORMAL})::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def normalize_message(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").where("text is not null").select("doc_id", ids.normalize_message(F.col("text")).alias("m"))
    return docs.select("doc_id", F.sha2("m", 256).alias("digest"), F.char_length("m").cast("long").alias("n"))


@query(
    "fingerprints",
    """SELECT doc_id, 'fp-' || substr(sha256('audit/dedup-fingerprint/v1' || chr(0) || lang || chr(0) || source || chr(0) || source || chr(0) || lower(lang) || chr(0)), 1, 16) AS fingerprint,
    sha256(text) AS digest FROM documents WHERE text IS NOT NULL""",
)
def fingerprints(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").where("text is not null")
    return docs.select("doc_id", ids.dedup_fingerprint(F.col("lang"), F.col("source"), F.col("source"), F.col("lang")).alias("fingerprint"), ids.hash_bytes(F.col("text")).alias("digest"))


@query(
    "last_entry",
    "SELECT sha256(text) AS path, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, count(*) - 1 AS displaced FROM documents WHERE text IS NOT NULL GROUP BY 1",
)
def last_entry(s: SparkSession, d: str) -> DataFrame:
    return intake.plan(t(s, d, "documents").select(F.sha2("text", 256).alias("path"), "doc_id", "source"), "path", "doc_id")


@query(
    "merge_by_fingerprint",
    "SELECT sha256(text) AS fingerprint, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS merged FROM documents WHERE text IS NOT NULL GROUP BY 1",
)
def merge_by_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return dedup.merge_by_fingerprint(t(s, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("fingerprint"), "doc_id", "source"), "fingerprint", ["doc_id"])


def _hour(c: str):
    return F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 3600).cast("long")


_MERGE = """
WITH RECURSIVE e AS (
  SELECT user_id || ':' || event_type AS fingerprint, floor(epoch(ts) / 3600)::BIGINT AS line, event_id, CASE WHEN event_type = 'view' THEN (event_id % 3)::VARCHAR END AS symbol, 't' || (event_id % 2) AS tool FROM events
),
places AS (SELECT fingerprint, line, row_number() OVER (PARTITION BY fingerprint ORDER BY line) AS k FROM (SELECT DISTINCT fingerprint, line FROM e WHERE symbol IS NULL)),
fold AS (
  SELECT fingerprint, k, line, line AS cluster FROM places WHERE k = 1
  UNION ALL
  SELECT p.fingerprint, p.k, p.line, CASE WHEN p.line - f.cluster <= 12 THEN f.cluster ELSE p.line END FROM fold f JOIN places p ON p.fingerprint = f.fingerprint AND p.k = f.k + 1
), clustered AS (
  SELECT e.*, cluster::VARCHAR AS c FROM e JOIN fold USING (fingerprint, line) WHERE symbol IS NULL UNION ALL SELECT e.*, 's' || symbol FROM e WHERE symbol IS NOT NULL
), tools AS (SELECT fingerprint, c, tool, min((line, event_id)) AS first FROM clustered GROUP BY ALL)
SELECT fingerprint, min(line) AS line, arg_min(event_id, (line, event_id)) AS candidate_id, count(*) AS merged, any_value(tools) AS tools
FROM clustered JOIN (SELECT fingerprint, c, string_agg(tool, ',' ORDER BY first) AS tools FROM tools GROUP BY ALL) USING (fingerprint, c) GROUP BY fingerprint, c"""


@query("merge_greedy", _MERGE)
def merge_greedy(s: SparkSession, d: str) -> DataFrame:
    symbol = F.when(F.col("event_type") == "view", (F.col("event_id") % 3).cast("string"))
    tool = F.concat(F.lit("t"), (F.col("event_id") % 2).cast("string"))
    e = t(s, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("fingerprint"), _hour("ts").alias("line"), symbol.alias("symbol"), F.col("event_id").alias("candidate_id"), tool.alias("tool"))
    return dedup.merge_candidates(e).withColumn("tools", F.array_join("tools", ","))


_FOUND = ("CWE-121", "CWE-787", "CWE-416")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("log"), (F.col("event_id") % 2).cast("string"))
    e = t(s, d, "events").select(F.col("user_id").alias("case_id"), path.alias("path"), "event_id", "event_type", _hour("ts").alias("line"))
    truths = e.where("event_type = 'purchase'").select("case_id", "path", F.col("event_id").alias("truth"), "line", F.when(F.col("event_id") % 3 == 0, "CWE-416").otherwise("CWE-787").alias("cwe"), F.when(F.col("event_id") % 7 == 0, "fixed").alias("variant"))
    found = F.element_at(F.array(*map(F.lit, _FOUND)), (F.col("event_id") % 3 + 1).cast("int"))
    findings = e.where("event_type = 'click'").select("case_id", "path", F.col("event_id").alias("finding_id"), F.col("line").alias("start_line"), (F.col("line") + F.col("event_id") % 4).alias("end_line"), found.alias("cwe"))
    return matching.candidate_pairs(truths, findings)


_PAIRS = """e AS (SELECT user_id AS case_id, event_id, event_type, event_id % 2 AS path, floor(epoch(ts) / 3600)::BIGINT AS line, CASE WHEN event_id % 3 = 0 THEN 'CWE-416' ELSE 'CWE-787' END AS truth_cwe, ['CWE-121','CWE-787','CWE-416'][(event_id % 3 + 1)::INT] AS cwe FROM events),
pairs AS (SELECT a.case_id, a.event_id AS truth, b.event_id AS finding_id, greatest(b.line - a.line, a.line - (b.line + b.event_id % 4), 0)::BIGINT AS distance FROM e a JOIN e b ON a.case_id = b.case_id AND a.path = b.path AND a.line BETWEEN b.line - 3 AND b.line + b.event_id % 4 + 3
  WHERE a.event_type = 'purchase' AND b.event_type = 'click' AND a.event_id % 7 <> 0 AND (a.truth_cwe = b.cwe OR (a.truth_cwe = 'CWE-787' AND b.cwe = 'CWE-121')))"""


@query("match_candidates", f"WITH {_PAIRS} SELECT * FROM pairs")
def match_candidates(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d)


_GREEDY = f"""WITH RECURSIVE {_PAIRS}, k AS (SELECT case_id, truth, row_number() OVER (PARTITION BY case_id ORDER BY truth) AS k FROM (SELECT DISTINCT case_id, truth FROM pairs)),
best AS (SELECT p.case_id, k.k, p.truth, list(p.finding_id ORDER BY distance, finding_id) AS wanted FROM pairs p JOIN k USING (case_id, truth) GROUP BY ALL),
fold AS (
  SELECT DISTINCT case_id, 0::BIGINT AS k, NULL::BIGINT AS truth, NULL::BIGINT AS finding_id, []::BIGINT[] AS taken FROM pairs
  UNION ALL
  SELECT b.case_id, b.k, b.truth, list_filter(b.wanted, lambda x: NOT list_contains(f.taken, x))[1], list_append(f.taken, list_filter(b.wanted, lambda x: NOT list_contains(f.taken, x))[1])
  FROM fold f JOIN best b ON b.case_id = f.case_id AND b.k = f.k + 1
)
SELECT case_id, truth, finding_id FROM fold WHERE finding_id IS NOT NULL"""


@query("match_one_to_one", _GREEDY)
def match_one_to_one(s: SparkSession, d: str) -> DataFrame:
    return matching.match_one_to_one(_pairs(s, d))


def _windows(s: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return t(s, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("usr"), day.alias("start_line"), (day + F.col("o_orderkey") % 60 + 5).alias("end_line"))


def _sites(s: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    lines = t(s, d, "lineitem").join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return lines.select(F.col("o_custkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), day.alias("line"))


_SITES = """w AS (SELECT o_custkey AS path, o_orderkey AS usr, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS start_line, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT + o_orderkey % 60 + 5 AS end_line FROM orders),
p AS (SELECT o_custkey AS path, l_orderkey * 10 + l_linenumber AS site, (l_shipdate::DATE - DATE '1970-01-01')::BIGINT AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "enclosing_function",
    f"WITH {_SITES} SELECT site, arg_min(usr, (end_line - start_line, usr)) AS usr FROM p JOIN w ON p.path = w.path AND line BETWEEN start_line AND end_line GROUP BY site",
)
def enclosing_function(s: SparkSession, d: str) -> DataFrame:
    return intervals.innermost(_sites(s, d), _windows(s, d), ["path"], "line", "start_line", "end_line", "site", "usr")


@query("points_covered", f"WITH {_SITES} SELECT path, site, line FROM p WHERE EXISTS (SELECT 1 FROM w WHERE p.path = w.path AND line BETWEEN start_line AND end_line)")
def points_covered(s: SparkSession, d: str) -> DataFrame:
    return intervals.covered(_sites(s, d), _windows(s, d), ["path"], "line", "start_line", "end_line")


@query(
    "interval_overlap",
    f"WITH {_SITES} SELECT a.path, a.usr AS left_usr, b.usr AS right_usr FROM w a JOIN w b ON a.path = b.path AND a.usr < b.usr AND a.start_line <= b.end_line AND b.start_line <= a.end_line",
)
def interval_overlap(s: SparkSession, d: str) -> DataFrame:
    w = _windows(s, d)
    right = w.select("path", F.col("usr").alias("right_usr"), F.col("start_line").alias("s2"), F.col("end_line").alias("e2"))
    return intervals.overlapping(w.withColumnRenamed("usr", "left_usr"), right, ["path"], ("start_line", "end_line"), ("s2", "e2")).where("left_usr < right_usr").select("path", "left_usr", "right_usr")


@query("reference_lookup", "SELECT l_partkey AS usr, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS targets FROM lineitem GROUP BY 1")
def reference_lookup(s: SparkSession, d: str) -> DataFrame:
    found = lookups.targets_of(t(s, d, "lineitem").select(F.col("l_partkey").alias("usr"), F.col("l_suppkey").alias("target")), "usr")
    return found.select("usr", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@query(
    "longest_prefix_rule",
    """WITH rules(check_id) AS (VALUES ('Brand#17'), ('Brand#1*'), ('Brand#*')), b AS (SELECT DISTINCT p_brand AS rule_id FROM part)
    SELECT rule_id, (SELECT check_id FROM rules WHERE check_id = rule_id OR (ends_with(check_id, '*') AND starts_with(rule_id, rtrim(check_id, '*'))) ORDER BY ends_with(check_id, '*'), length(check_id) DESC LIMIT 1) AS check_id FROM b""",
)
def longest_prefix_rule(s: SparkSession, d: str) -> DataFrame:
    checks = s.createDataFrame([("Brand#17",), ("Brand#1*",), ("Brand#*",)], "check_id string")
    return intake.rules_lookup(t(s, d, "part").select(F.col("p_brand").alias("rule_id")).distinct(), checks)


@query(
    "metrics_delta",
    """WITH c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1)
    SELECT nation, coalesce(s.n, 0) - coalesce(c.n, 0) AS n FROM c FULL JOIN s USING (nation)""",
)
def metrics_delta(s: SparkSession, d: str) -> DataFrame:
    count = lambda name, key: t(s, d, name).groupBy(F.col(key).alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.metrics_delta(count("customer", "c_nationkey"), count("supplier", "s_nationkey"), "nation", ["n"])


@query(
    "manifest_diff",
    """WITH a AS (SELECT c_nationkey::VARCHAR AS key, (count(*) % 3)::VARCHAR AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey::VARCHAR AS key, (count(*) % 3)::VARCHAR AS v FROM supplier GROUP BY 1)
    SELECT key, a.v AS left, b.v AS right FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v""",
)
def manifest_diff(s: SparkSession, d: str) -> DataFrame:
    side = lambda name, key: t(s, d, name).groupBy(F.col(key).cast("string").alias("key")).agg((F.count(F.lit(1)) % 3).cast("string").alias("v"))
    return metrics.differing(side("customer", "c_nationkey"), side("supplier", "s_nationkey"), "key", "v")


_GRAPH = "edges AS (SELECT DISTINCT 'p' || l_partkey AS caller, 's' || l_suppkey AS callee FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)"


def _edges(s: SparkSession, d: str) -> DataFrame:
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    both = t(s, d, "lineitem").select(part.alias("caller"), supplier.alias("callee"))
    return both.unionByName(both.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))).distinct()


@query(
    "bfs_depth",
    f"""WITH RECURSIVE {_GRAPH}, r AS (SELECT seed, seed AS node, 0 AS depth FROM (VALUES ('p1'), ('p2')) v(seed) UNION SELECT seed, callee, depth + 1 FROM r JOIN edges ON caller = node WHERE depth < 2)
    SELECT seed, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2""",
)
def bfs_depth(s: SparkSession, d: str) -> DataFrame:
    return graph.walk(s.createDataFrame([("p1",), ("p2",)], "node string"), _edges(s, d), 2)


@query(
    "transitive_closure",
    "WITH RECURSIVE e AS (SELECT n_nationkey AS class, n_regionkey + 100 AS base FROM nation UNION SELECT r_regionkey + 100, 1000 FROM region), c AS (SELECT * FROM e UNION SELECT c.class, e.base FROM c JOIN e ON c.base = e.class) SELECT class, base FROM c",
)
def transitive_closure(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "nation").select(F.col("n_nationkey").alias("class"), (F.col("n_regionkey") + 100).alias("base")).union(t(s, d, "region").select(F.col("r_regionkey") + 100, F.lit(1000)))
    return graph.closure(e, "class", "base")


@query(
    "reply_chain",
    """WITH RECURSIVE e AS (SELECT DISTINCT a.conv_id, a.turn, b.turn AS next FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    r AS (SELECT DISTINCT conv_id || ':0' AS seed, conv_id, 0::BIGINT AS turn, 0 AS depth FROM conversations UNION ALL SELECT seed, e.conv_id, e.next, depth + 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.turn = r.turn WHERE depth < 4)
    SELECT seed, conv_id || ':' || turn AS node, min(depth)::INT AS depth FROM r GROUP BY 1, 2""",
)
def reply_chain(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "conversations").select("conv_id", "turn")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = c.join(later, ["conv_id", "turn"]).select(name(F.col("turn")).alias("caller"), name(F.col("turn") + 1).alias("callee"))
    return graph.walk(c.select(name(F.lit(0)).alias("node")).distinct(), edges, 4)


@query(
    "longest_prefix_join",
    "WITH p(prefix) AS (VALUES ('Brand#'), ('Brand#1'), ('Brand#12'), ('Brand#3')) SELECT p_partkey, p_brand, (SELECT prefix FROM p WHERE starts_with(p_brand, prefix) ORDER BY length(prefix) DESC LIMIT 1) AS prefix FROM part",
)
def longest_prefix_join(s: SparkSession, d: str) -> DataFrame:
    prefixes = s.createDataFrame([("Brand#",), ("Brand#1",), ("Brand#12",), ("Brand#3",)], "prefix string")
    return graph.longest_prefix(t(s, d, "part").select("p_partkey", "p_brand"), "p_brand", prefixes, "prefix").select("p_partkey", "p_brand", "prefix")


_BUDGET = """
WITH RECURSIVE u AS (
  SELECT o_custkey AS candidate_id, o_orderkey AS unit, floor(o_totalprice / 100)::BIGINT AS tokens, o_orderpriority LIKE '1%' AS is_primary FROM orders
), pt AS (SELECT candidate_id, sum(tokens) FILTER (is_primary)::BIGINT AS primary_tokens, count(*) FILTER (is_primary) AS primaries FROM u GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY unit) AS k FROM u WHERE NOT is_primary),
fold AS (
  SELECT candidate_id, 0::BIGINT AS k, NULL::BIGINT AS unit, NULL::BIGINT AS tokens, coalesce(primary_tokens, 0)::BIGINT AS spent, primaries::BIGINT AS kept, coalesce(primary_tokens, 0) > 6000 AS over, NULL::VARCHAR AS outcome FROM pt
  UNION ALL
  SELECT f.candidate_id, o.k, o.unit, o.tokens,
         CASE WHEN NOT over AND kept < 6 AND spent + o.tokens <= 6000 THEN spent + o.tokens ELSE spent END, CASE WHEN NOT over AND kept < 6 AND spent + o.tokens <= 6000 THEN kept + 1 ELSE kept END, over,
         CASE WHEN over THEN 'primary_budget_exceeded' WHEN kept >= 6 THEN 'max_units' WHEN spent + o.tokens > 6000 THEN 'budget' ELSE 'kept' END
  FROM fold f JOIN o ON o.candidate_id = f.candidate_id AND o.k = f.k + 1
)
SELECT candidate_id, unit, tokens, outcome FROM fold WHERE k > 0
UNION ALL SELECT candidate_id, unit, tokens, CASE WHEN coalesce(primary_tokens, 0) > 6000 THEN 'primary_budget_exceeded' ELSE 'kept' END FROM u JOIN pt USING (candidate_id) WHERE is_primary"""


@query("budget_select", _BUDGET)
def budget_select(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders")
    tokens = F.expr("cast(floor(o_totalprice / 100) as bigint)")
    units = o.select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("unit"), F.col("o_orderkey").alias("place"), tokens.alias("tokens"), F.col("o_orderpriority").startswith("1").alias("is_primary"))
    return budget.select_units(units, 6000, 6)


_RANKS = "list_position(['critical','high','medium','low'], {a}) - 1"


@query(
    "rank_findings",
    f"""WITH x AS (SELECT l_partkey AS case_id, l_orderkey * 10 + l_linenumber AS finding_id, {_LEVEL.format(c='l_linenumber')} AS severity, l_returnflag, l_suppkey % 3 AS agreement, l_orderkey % 3 AS effort, l_suppkey % 2 AS reach FROM lineitem),
    k AS (SELECT case_id, finding_id, row_number() OVER (PARTITION BY case_id ORDER BY list_position(['critical','high','medium','low'], severity), list_position(['A','N','R'], l_returnflag), reach, -agreement, effort, finding_id) AS place FROM x)
    SELECT * FROM k WHERE place <= 5""",
)
def rank_findings(s: SparkSession, d: str) -> DataFrame:
    level = lambda c, names: F.element_at(F.array(*map(F.lit, names)), c.cast("int") + 1)
    x = t(s, d, "lineitem").select(
        F.col("l_partkey").alias("case_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"),
        ranks.rank_key(_level("l_linenumber"), F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("review_required"), F.when(F.col("l_suppkey") % 2 == 0, "argued").otherwise("unknown"), F.col("l_suppkey") % 3, level(F.col("l_orderkey") % 3, ("local", "function", "cross_module"))).alias("key"),
    )
    return dedup.top_rank(x, ["case_id"], [F.col("key"), F.col("finding_id")]).where("place <= 5").select("case_id", "finding_id", F.col("place").cast("long").alias("place"))


@query(
    "top_per_case",
    "SELECT l_partkey, arg_min(l_orderkey, (-l_quantity, l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem GROUP BY 1",
)
def top_per_case(s: SparkSession, d: str) -> DataFrame:
    return quality.top_per_case(t(s, d, "lineitem"), "l_partkey", [F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey")


@query(
    "carry_forward",
    """WITH x AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN event_id END AS mark FROM events)
    SELECT event_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM x""",
)
def carry_forward(s: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("event_type") == "view", F.col("event_id"))
    return lookups.carried(t(s, d, "events"), "user_id", ["ts", "event_id"], mark, "header").select("event_id", "header")


@query(
    "adjacent_compare",
    "WITH x AS (SELECT user_id, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) SELECT event_id, value < next AS out_of_order FROM x WHERE next IS NOT NULL",
)
def adjacent_compare(s: SparkSession, d: str) -> DataFrame:
    return lookups.out_of_order(t(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "out_of_order")


@query("json_scan", "SELECT event_id, event_type AS event, user_id::VARCHAR AS run_id, (props::JSON ->> 'k')::BIGINT AS k, 2::INT AS others FROM events")
def json_scan(s: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit('{"event":"'), "event_type", F.lit('","run_id":"'), F.col("user_id").cast("string"), F.lit('","policy_version":"1","event_id":'), F.col("event_id").cast("string"), F.lit(","), F.substring(F.col("props"), F.lit(2), F.char_length("props")))
    found = records.parse_trace(t(s, d, "events").select(line.alias("value")))
    return found.select(F.col("fields.event_id").cast("long").alias("event_id"), "event", "run_id", F.col("fields.k").cast("long").alias("k"), F.size("fields").alias("others"))


@query(
    "diagnostic_lines",
    """WITH x AS (SELECT l_orderkey AS run, l_linenumber, l_partkey, l_returnflag, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
    y AS (SELECT *, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY pos) AS ordinal FROM x)
    SELECT run, ordinal::BIGINT AS ordinal, max('p' || l_partkey || '.c') FILTER (l_returnflag <> 'R') AS path, (max(l_linenumber) FILTER (l_returnflag <> 'R'))::INT AS line, max(CASE l_returnflag WHEN 'A' THEN 'error' ELSE 'warning' END) FILTER (l_returnflag <> 'R') AS severity,
    max(CASE WHEN l_returnflag = 'N' THEN '-Wx' || (l_suppkey % 5) END) AS rule_id, (count(*) FILTER (l_returnflag = 'R'))::INT AS notes FROM y WHERE ordinal > 0 GROUP BY run, ordinal""",
)
def diagnostic_lines(s: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("l_returnflag") == "A", "fatal error").when(F.col("l_returnflag") == "N", "warning").otherwise("note")
    rule = F.when(F.col("l_returnflag") == "N", F.concat(F.lit(" [-Wx"), (F.col("l_suppkey") % 5).cast("string"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".c:"), F.col("l_linenumber").cast("string"), F.lit(":3: "), word, F.lit(": it is so"), rule)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")))), lambda x: x["line"])
    runs = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.concat(F.lit("2 warnings generated.\n"), F.array_join(in_order, "\n")).alias("text"))
    return diagnostics.parse_text(runs).select("run", "ordinal", "path", "line", "severity", "rule_id", F.size("notes").alias("notes"))


#: A declared list of other rules: kind, pattern, group.
CUSTOM_RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0),
    ("ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0),
    ("token", r'token = "[0-9a-f]+"', 0),
)


@query(
    "redact_custom",
    r"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted:email]', 'g') AS t1 FROM documents),
    b AS (SELECT *, regexp_replace(t1, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '[redacted:ipv4]', 'g') AS t2 FROM a), c AS (SELECT *, regexp_replace(t2, 'token = "[0-9a-f]+"', '[redacted:token]', 'g') AS t3 FROM b)
    SELECT doc_id, len(regexp_extract_all(t0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::BIGINT AS email, len(regexp_extract_all(t1, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b'))::BIGINT AS ipv4,
           len(regexp_extract_all(t2, 'token = "[0-9a-f]+"'))::BIGINT AS token, sha256(t3) AS digest FROM c WHERE t0 <> t3""",
)
def redact_custom(s: SparkSession, d: str) -> DataFrame:
    found = t(s, d, "documents").select("doc_id", "text", text.scrub(F.col("text"), CUSTOM_RULES).alias("r"))
    count = lambda k: F.coalesce(F.col("r.counts")[k], F.lit(0).cast("long")).alias(k)
    return found.where("text <> r.text").select("doc_id", count("email"), count("ipv4"), count("token"), F.sha2("r.text", 256).alias("digest"))


@query(
    "resolution_ladder",
    """WITH c AS (SELECT d.doc_id AS citation_id, CASE WHEN d.doc_id % 11 = 0 THEN '/' || d.doc_id WHEN d.doc_id % 7 = 0 THEN 'gone/' || d.doc_id ELSE d.source || '/' || d.doc_id END AS path,
           CASE WHEN d.doc_id % 13 = 0 THEN 0 ELSE 1 END AS start_line, CASE WHEN d.doc_id % 5 = 0 THEN 1000000 ELSE 1 END AS end_line, d.source, d.text, d.doc_id FROM documents d)
    SELECT citation_id, CASE WHEN doc_id % 11 = 0 THEN 'outside_repo_root' WHEN start_line < 1 THEN 'byte_range_invalid' WHEN doc_id % 7 <> 0 AND source = 'src2' THEN 'excluded_file' WHEN doc_id % 7 = 0 THEN 'missing_file'
           WHEN octet_length(encode(text)) > 20000 THEN 'file_too_large' WHEN end_line = 1000000 THEN 'line_out_of_range' ELSE 'ok' END AS status FROM c""",
)
def resolution_ladder(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents")
    own = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    content = F.col("text").cast("binary")
    # line starts natively: offsets after each line end but the last
    parts = F.transform(F.split("text", "\n"), lambda x: F.octet_length(x).cast("long"))
    starts = F.when(F.col("text").endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    files = docs.select(own.alias("path"), F.octet_length("text").alias("size"), starts.alias("starts"), content.alias("content"))
    n = F.col("doc_id")
    path = F.when(n % 11 == 0, F.concat(F.lit("/"), n.cast("string"))).when(n % 7 == 0, F.concat(F.lit("gone/"), n.cast("string"))).otherwise(own)
    null = lambda kind: F.lit(None).cast(kind)
    cited = docs.select(
        n.alias("citation_id"), null("string").alias("evidence_id"), null("boolean").alias("issued"), path.alias("path"), F.when(n % 13 == 0, 0).otherwise(1).alias("start_line"),
        F.when(n % 5 == 0, 1_000_000).otherwise(1).alias("end_line"), null("long").alias("start_byte"), null("long").alias("end_byte"), null("string").alias("sha256"),
    )
    return resolution.resolve(cited, files, ["src2/**"], 20_000).select("citation_id", "status")


@query(
    "pair_outcomes",
    """WITH v AS (SELECT l_partkey AS pair_id, bool_or(l_returnflag = 'R') AS found, bool_and(l_tax < 0.08) AS valid FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    f AS (SELECT l_partkey AS pair_id, bool_or(l_discount > 0.09) AS found FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT pair_id, v.pair_id IS NULL OR f.pair_id IS NULL AS excluded, coalesce(v.found AND v.valid AND f.pair_id IS NOT NULL, false) AS detected, coalesce(f.found AND v.pair_id IS NOT NULL, false) AS persisted,
           NOT (v.pair_id IS NULL OR f.pair_id IS NULL) AND NOT coalesce(v.found AND v.valid AND f.pair_id IS NOT NULL, false) AS missed FROM v FULL JOIN f USING (pair_id)""",
)
def pair_outcomes(s: SparkSession, d: str) -> DataFrame:
    l = t(s, d, "lineitem")  # noqa: E741
    none = F.lit(None).cast("string")
    v = l.where("l_linestatus = 'F'").groupBy(F.col("l_partkey").alias("pair_id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("found"), F.bool_and(F.col("l_tax") < 0.08).alias("valid")).withColumn("failure", none)
    f = l.where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("pair_id")).agg(F.bool_or(F.col("l_discount") > 0.09).alias("found")).withColumn("failure", none)
    return quality.pair_outcomes(v, f)


@query(
    "pair_score",
    "WITH o AS ("
    + """WITH v AS (SELECT l_partkey AS pair_id, bool_or(l_returnflag = 'R') AS found, bool_and(l_tax < 0.08) AS valid FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    f AS (SELECT l_partkey AS pair_id, bool_or(l_discount > 0.09) AS found FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT v.pair_id IS NULL OR f.pair_id IS NULL AS excluded, coalesce(v.found AND v.valid AND f.pair_id IS NOT NULL, false) AS detected, coalesce(f.found AND v.pair_id IS NOT NULL, false) AS persisted FROM v FULL JOIN f USING (pair_id)
    ), n AS (SELECT count(*) FILTER (NOT excluded) AS scored, count(*) FILTER (detected) AS detected, count(*) FILTER (persisted) AS persisted, count(*) FILTER (excluded) AS excluded FROM o)
    SELECT *, CASE WHEN scored = 0 THEN 1.0 ELSE detected::DOUBLE / scored::DOUBLE END AS detection_rate, CASE WHEN detected = 0 THEN 0.0 ELSE persisted::DOUBLE / detected::DOUBLE END AS persistence_rate FROM n""",
)
def pair_score(s: SparkSession, d: str) -> DataFrame:
    return quality.score_pairs(pair_outcomes(s, d))


@query("stratified_pick", "SELECT lang, arg_min(doc_id, (md5('7:' || doc_id), doc_id)) AS doc_id FROM documents GROUP BY 1")
def stratified_pick(s: SparkSession, d: str) -> DataFrame:
    return lookups.stratified_pick(t(s, d, "documents"), "lang", "doc_id", 7)


@query(
    "ablation_deltas",
    """WITH c(name, least) AS (VALUES ('baseline', 2000), ('short', 1000), ('long', 4000)), r AS (SELECT name, count(*) FILTER (quality = 1)::DOUBLE / count(*)::DOUBLE AS score FROM c JOIN documents ON n_chars >= least JOIN labels USING (doc_id) GROUP BY 1)
    SELECT name, score, score - (SELECT score FROM r WHERE name = 'baseline') AS delta FROM r""",
)
def ablation_deltas(s: SparkSession, d: str) -> DataFrame:
    from ..operators import experiments

    j = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = j.select("quality", "n_chars", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(at).alias("at")) for n, at in (("baseline", 2000), ("short", 1000), ("long", 4000))])).alias("c"))
    scores = rows.where("n_chars >= c.at").groupBy(F.col("c.name").alias("name")).agg((F.count_if(F.col("quality") == 1).cast("double") / F.count(F.lit(1)).cast("double")).alias("score"))
    return experiments.deltas(scores, "baseline")


@query(
    "limitations_union",
    """WITH u AS (SELECT 0 AS part, doc_id AS ordinal, source AS kind, lang AS affects, NULL::VARCHAR AS detail FROM documents UNION ALL SELECT 1, page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), NULL, 'page' FROM pages)
    SELECT kind, affects, detail, (min((part, ordinal)))[1]::INT AS part, (min((part, ordinal)))[2]::BIGINT AS ordinal FROM u GROUP BY 1, 2, 3""",
)
def limitations_union(s: SparkSession, d: str) -> DataFrame:
    a = t(s, d, "documents").select(F.col("source").alias("kind"), F.col("lang").alias("affects"), F.lit(None).cast("string").alias("detail"), F.col("doc_id").alias("ordinal"))
    b = t(s, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("kind"), F.lit(None).cast("string").alias("affects"), F.lit("page").alias("detail"), F.col("page_id").alias("ordinal"))
    return dedup.distinct_limitations(a, b)


_CWES = "['CWE-787','CWE-119','CWE-664','CWE-416','CWE-79','CWE-476','CWE-401','CWE-78']"
_CWE_LIST = ("CWE-787", "CWE-119", "CWE-664", "CWE-416", "CWE-79", "CWE-476", "CWE-401", "CWE-78")


def _cwe(c: str):
    return F.element_at(F.array(*map(F.lit, _CWE_LIST)), (F.col(c) % 8 + 1).cast("int"))


@query(
    "weakness_status",
    f"""WITH x AS (SELECT p_partkey, {_CWES}[(p_partkey % 8 + 1)::INT] AS cwe FROM part)
    SELECT p_partkey, cwe, CASE cwe WHEN 'CWE-119' THEN 'discouraged' WHEN 'CWE-664' THEN 'prohibited' WHEN 'CWE-79' THEN 'out_of_scope' ELSE 'allowed' END AS status,
    CASE cwe WHEN 'CWE-787' THEN 'out_of_bounds' WHEN 'CWE-119' THEN 'out_of_bounds' WHEN 'CWE-416' THEN 'memory_lifetime' WHEN 'CWE-476' THEN 'null_uninitialized' WHEN 'CWE-401' THEN 'resource_leak' WHEN 'CWE-78' THEN 'injection' END AS family FROM x""",
)
def weakness_status(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "part").select("p_partkey", _cwe("p_partkey").alias("cwe")).select("p_partkey", "cwe", weakness.status_of(F.col("cwe")).alias("status"), weakness.family_of(F.col("cwe")).alias("family"))


@query(
    "severity_and_effort",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_CWES}[(l_partkey % 8 + 1)::INT] AS cwe, CASE WHEN l_suppkey % 2 = 0 THEN 'incorrect_result' ELSE 'code_execution' END AS impact FROM lineitem),
    y AS (SELECT *, CASE WHEN cwe IN ('CWE-787','CWE-119','CWE-416','CWE-78') THEN 'high' WHEN cwe IN ('CWE-476','CWE-401') THEN 'medium' ELSE 'low' END AS base FROM x)
    SELECT l_orderkey, l_linenumber, CASE WHEN impact = 'incorrect_result' THEN 'low' ELSE base END AS severity FROM y""",
)
def severity_and_effort(s: SparkSession, d: str) -> DataFrame:
    impact = F.when(F.col("l_suppkey") % 2 == 0, "incorrect_result").otherwise("code_execution")
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", ranks.severity_of(_cwe("l_partkey"), impact).alias("severity"))


@query(
    "unit_relevance",
    """WITH x AS (SELECT l_orderkey, l_linenumber, ['containing_function','type_decl','caller','callee','analyzer_message'][(l_partkey % 5 + 1)::INT] AS role, (l_suppkey % 4)::INT AS depth, l_returnflag = 'R' AS flow FROM lineitem),
    y AS (SELECT *, CASE role WHEN 'containing_function' THEN 1000 WHEN 'type_decl' THEN 900 WHEN 'caller' THEN 700 WHEN 'callee' THEN 650 ELSE 200 END - greatest(0, depth - 1) * 100 + CASE WHEN flow THEN 150 ELSE 0 END AS points FROM x)
    SELECT l_orderkey, l_linenumber, role, least(1000, greatest(0, points)) / 1000.0::DOUBLE AS relevance FROM y""",
)
def unit_relevance(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("containing_function", "type_decl", "caller", "callee", "analyzer_message")))
    x = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(names, (F.col("l_partkey") % 5 + 1).cast("int")).alias("role"), (F.col("l_suppkey") % 4).cast("int").alias("depth"), (F.col("l_returnflag") == "R").alias("flow"))
    return x.select("l_orderkey", "l_linenumber", "role", ranks.relevance(F.col("role"), F.col("depth"), F.col("flow")).alias("relevance"))


@query(
    "claim_ceilings",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'demonstrated' WHEN l_linestatus = 'F' THEN 'argued' ELSE 'unknown' END AS reachability,
    CASE WHEN l_tax > 0.04 AND l_returnflag = 'R' THEN 'demonstrated' WHEN l_tax > 0.04 THEN 'plausible' ELSE 'unlikely' END AS exploitability FROM lineitem""",
)
def claim_ceilings(s: SparkSession, d: str) -> DataFrame:
    flow, code, up = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_tax") > 0.04
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", ranks.reachability_ceiling(flow, code).alias("reachability"), ranks.exploitability_ceiling(up, flow).alias("exploitability"))


@query(
    "routing",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'triage' WHEN l_linestatus = 'F' AND l_linenumber % 4 IN (0, 1) AND l_tax > 0.02 AND l_discount > 0.01 THEN 'escalation' ELSE 'adjudication' END AS tier FROM lineitem""",
)
def routing(s: SparkSession, d: str) -> DataFrame:
    disposition = F.when(F.col("l_returnflag") == "A", "dismiss").otherwise("adjudicate")
    tier = gate.route(disposition, F.col("l_linestatus") == "F", _level("l_linenumber"), F.col("l_tax") > 0.02, F.col("l_discount") <= 0.01)
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", tier.alias("tier"))


@query(
    "gate_decisions",
    """WITH f AS (SELECT l_orderkey AS candidate_id, CASE WHEN l_returnflag = 'R' AND l_tax > 0.07 THEN 'hash_mismatch' WHEN l_discount > 0.09 THEN 'citation_unresolved' WHEN l_quantity > 49 THEN 'incomplete_build_context' END AS reason FROM lineitem),
    g AS (SELECT candidate_id, bool_or(reason = 'hash_mismatch') AS h, bool_or(reason = 'citation_unresolved') AS c FROM f GROUP BY 1),
    a AS (SELECT o_orderkey AS candidate_id, o_orderstatus FROM orders)
    SELECT candidate_id, o_orderstatus <> 'P' AND NOT coalesce(h, false) AND NOT coalesce(c, false) AS accepted,
           CASE WHEN o_orderstatus <> 'P' AND NOT coalesce(h, false) AND NOT coalesce(c, false) THEN 'high' ELSE 'review_required' END AS confidence,
           CASE WHEN o_orderstatus <> 'P' AND NOT coalesce(h, false) AND NOT coalesce(c, false) THEN 'all_citations_resolved' WHEN coalesce(c, false) THEN 'citation_unresolved' WHEN coalesce(h, false) THEN 'hash_mismatch' ELSE 'model_inconclusive' END AS reason
    FROM a LEFT JOIN g USING (candidate_id)""",
)
def gate_decisions(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "P", "review_required").otherwise("confirmed").alias("verdict"))
    reason = F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07), "hash_mismatch").when(F.col("l_discount") > 0.09, "citation_unresolved").when(F.col("l_quantity") > 49, "incomplete_build_context")
    failures = t(s, d, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.lit("line").alias("subject"), reason.alias("reason")).where("reason is not null").unionByName(gate.verdicts(o))
    claims = o.select("candidate_id", F.lit("argued").alias("reachability"), F.lit("unknown").alias("exploitability"), F.array().cast("array<string>").alias("lowered"))
    return gate.decide(o, failures, claims).select("candidate_id", "accepted", "confidence", "reason")


@query(
    "fabrication_signals",
    """WITH r AS (SELECT doc_id AS ordinal, CASE WHEN doc_id % 9 = 0 THEN 'missing_file' WHEN doc_id % 10 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS status, source AS subject FROM documents),
    a AS (SELECT 0 AS s, ordinal, CASE status WHEN 'missing_file' THEN 'fabricated_file' ELSE 'fabricated_snippet' END AS kind, subject, 'd' || ordinal AS detail FROM r WHERE status <> 'ok'
          UNION ALL SELECT 1, event_id, 'fabricated_analyzer', event_type, 'e' || event_id FROM events WHERE event_type NOT IN ('view', 'click'))
    SELECT kind, subject, arg_min(detail, (s, ordinal)) AS detail FROM a GROUP BY 1, 2""",
)
def fabrication_signals(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    status = F.when(n % 9 == 0, "missing_file").when(n % 10 == 0, "hash_mismatch").otherwise("ok")
    r = t(s, d, "documents").select(n.alias("ordinal"), status.alias("status"), F.col("source").alias("subject"), F.concat(F.lit("d"), n.cast("string")).alias("detail"))
    e = t(s, d, "events").select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("tool_name"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("detail"))
    return metrics.fabrication_signals(r, e, ["view", "click"])


@query(
    "usage_by_tier",
    "SELECT event_type AS tier, count(*) FILTER (user_id % 5 <> 0) AS calls, count(*) FILTER (user_id % 5 = 0) AS cached, sum(CASE WHEN user_id % 5 <> 0 THEN length(props) ELSE 0 END)::BIGINT AS input_tokens FROM events GROUP BY 1",
)
def usage_by_tier(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events").select(F.col("event_type").alias("tier"), (F.col("user_id") % 5 == 0).alias("cached"), F.char_length("props").alias("input_tokens"))
    return budget.usage_by_tier(e, ["input_tokens"])


@query(
    "url_language",
    "SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS language, regexp_matches(url, '\\.html') AS is_html FROM pages",
)
def url_language(s: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    return t(s, d, "pages").select("page_id", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("language"), paths.matches_any(path, ["**/*.html"]).alias("is_html"))


@query(
    "standards",
    """WITH v(k, std, language, year) AS (VALUES (0, 'c11', 'c', 11), (1, 'gnu++17', 'c++', 17), (2, 'iso9899:1999', 'c', 99), (3, 'c++2x', 'c++', 20), (4, 'weird', NULL, NULL))
    SELECT p_partkey, std, language, year, CASE WHEN year IS NULL THEN true WHEN language = 'c++' THEN year < 90 AND year >= 17 ELSE year < 80 AND year >= 11 END AS supported FROM part JOIN v ON k = p_partkey % 5""",
)
def standards(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("c11", "gnu++17", "iso9899:1999", "c++2x", "weird")))
    x = t(s, d, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("std"))
    parsed = x.withColumn("p", build.parse_std(F.col("std")))
    return parsed.select("p_partkey", "std", F.col("p.language").alias("language"), F.col("p.year").alias("year"), build.standard_is_supported(F.col("p")).alias("supported"))


@query(
    "reusable_units",
    """WITH i AS (SELECT l_orderkey AS unit, l_partkey AS path, CASE WHEN l_quantity > 45 THEN 'old' ELSE 'p' || l_partkey END AS sha256 FROM lineitem), c AS (SELECT p_partkey AS path, 'p' || p_partkey AS sha256 FROM part)
    SELECT unit, bool_and(coalesce(i.sha256 = c.sha256, false)) AS reusable FROM i LEFT JOIN c USING (path) GROUP BY 1""",
)
def reusable_units(s: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    inputs = t(s, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("path"), F.when(F.col("l_quantity") > 45, "old").otherwise(own).alias("sha256"))
    return intake.reusable_units(inputs, t(s, d, "part").select(F.col("p_partkey").alias("path"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("sha256")))
