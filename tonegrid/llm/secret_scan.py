"""Secret scans with multipart credential linking.

Base matches stand on their own: assignments of a value of six or more characters, access
identifiers of 20 or more, hexadecimal runs of 24 or more. Weaker parts (short assignments, short
access identifiers, client and user names, shorter hexadecimal runs, endpoints) mean little alone;
they are reported only where complementary parts lie within ``SCOPE`` code points in the same text:
an identifier needs a secret, a secret needs an identifier, an endpoint needs both.

Matches are found by Spark's regular expressions: the pieces between matches give their positions.
Each text is scanned once into a small row. Linking is an interval join by buckets of ``SCOPE``
code points: per row, bucket and class of part only the extreme starts and ends are kept, so a
probe meets at most four rows whatever the number of parts. Only match positions are shuffled.

Defined results: texts of any length are read whole; a null text is empty; without matches the strings of spans are empty (hashed as
such); overlapping matches of different kinds all count, but only disjoint parts complement each
other; repeated rows each report; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonegrid.llm.common import table, text_of, written

#: Code points between two parts of one credential, at most.
SCOPE = 200

#: The patterns. Letters of the first words count in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{12,}"
CLIENT = r"""(?i:access_?key_?id|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=@-]{3,}"""
ENDPOINT = r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"

MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Kinds in the order of reports, and the class of part each is.
KINDS = {"assign": "secret", "access": "access", "hex": "secret", "weak_assign": "secret", "weak_access": "access", "weak_hex": "secret", "endpoint": "endpoint"}
BASE = ("assign", "access", "hex")


def hits(text: Column, pattern: str, kind: Column, likely: Column) -> Column:
    """Array of (kind, gap, size): every match, with the code points since the end of the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    listed = F.zip_with(between, found, lambda p, m: F.struct(kind(m).alias("kind"), F.length(p).alias("gap"), F.length(m).alias("size")))
    return F.when(likely, listed).otherwise(F.array().cast("array<struct<kind:string,gap:int,size:int>>"))


def by_size(least: int, strong: str, weak: str):
    return lambda m: F.when(F.length(m) >= least, strong).otherwise(weak)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, found): one small row per document, written once. ``found`` has an array of hits for each pattern."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("t"))
    t = F.col("t")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    found = F.array(
        hits(t, ASSIGN, lambda m: F.when(value(m) >= MIN_ASSIGN, "assign").otherwise("weak_assign"), t.rlike(ASSIGN)),
        hits(t, ACCESS, by_size(MIN_ACCESS, "access", "weak_access"), t.contains("AKIA")),
        hits(t, HEX, by_size(MIN_HEX, "hex", "weak_hex"), t.rlike(HEX)),
        hits(t, CLIENT, lambda m: F.lit("weak_access"), t.rlike(CLIENT)),
        hits(t, ENDPOINT, lambda m: F.lit("endpoint"), t.contains("://")),
    )
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found")))


def positions(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end) of all hits, weak ones included."""
    each = scanned.where(F.size(F.flatten("found")) > 0).select("row", F.posexplode("found").alias("pattern", "list"))
    each = each.select("row", "pattern", F.posexplode("list").alias("n", "h"))
    so_far = Window.partitionBy("row", "pattern").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("h.gap").cast("long") + F.col("h.size")).over(so_far)
    return each.select("row", F.col("h.kind").alias("kind"), (end - F.col("h.size")).alias("start"), end.alias("end"))


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans of (row, kind, start, end) that have their complementary parts within ``scope``."""
    part = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("kind"))
    parts = spans.withColumn("part", part)
    # an end in the bucket of a start or in the one before it, a start in the bucket of an end or in the one after it
    edges = parts.where("part <> 'endpoint'").select(
        "row", "part", F.explode(F.array(F.struct(F.lit("end").alias("edge"), F.col("end").alias("at")), F.struct(F.lit("start").alias("edge"), F.col("start").alias("at")))).alias("e")
    )
    met = edges.groupBy("row", "part", F.col("e.edge").alias("edge"), F.floor(F.col("e.at") / scope).alias("bucket")).agg(F.min("e.at").alias("low"), F.max("e.at").alias("high"))
    weak = parts.where(~F.col("kind").isin(*BASE)).distinct()
    probe = weak.withColumn(
        "p",
        F.explode(
            F.array(*[
                F.struct(F.lit(edge).alias("edge"), (F.floor(F.col(own) / scope) + step).alias("bucket"))
                for edge, own, step in (("end", "start", -1), ("end", "start", 0), ("start", "end", 0), ("start", "end", 1))
            ])
        ),
    )
    probe = probe.select(F.col("row").alias("of"), "kind", "start", F.col("end").alias("stop"), F.col("part").alias("own"), F.col("p.edge").alias("p_edge"), F.col("p.bucket").alias("p_bucket"))
    near = probe.join(met, (F.col("of") == F.col("row")) & (F.col("p_edge") == F.col("edge")) & (F.col("p_bucket") == F.col("bucket")) & (F.col("own") != F.col("part")))
    # in the nearer bucket any edge on the right side will do, in the farther one the nearest must be within the scope
    before = F.when(F.col("bucket") == F.floor(F.col("start") / scope), F.col("low") <= F.col("start")).otherwise(F.col("high") >= F.col("start") - scope)
    after = F.when(F.col("bucket") == F.floor(F.col("stop") / scope), F.col("high") >= F.col("stop")).otherwise(F.col("low") <= F.col("stop") + scope)
    near = near.where(F.when(F.col("edge") == "end", before).otherwise(after))
    seen = near.groupBy("of", "kind", "start", "stop", "own").agg(F.max(F.col("part") == "access").alias("access"), F.max(F.col("part") == "secret").alias("secret"))
    enough = F.when(F.col("own") == "access", F.col("secret")).when(F.col("own") == "secret", F.col("access")).otherwise(F.col("access") & F.col("secret"))
    return seen.where(enough).select(F.col("of").alias("row"), "kind", "start", F.col("stop").alias("end"))


def secret_spans(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, spans): per document, all reported (start, order, kind, end), in order."""
    scanned = scan(docs, id_col, text_col)
    spans = written(positions(scanned))
    order = F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(KINDS) for x in (k, n)]), F.col("kind"))
    told = spans.where(F.col("kind").isin(*BASE)).unionByName(linked(spans, scope))
    lists = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "kind", "end"))).alias("spans"))
    none = F.array().cast(lists.schema["spans"].dataType)
    return scanned.select("row", "doc_id").join(lists, "row", "left").withColumn("spans", F.coalesce("spans", none))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """Positions by list functions, links by EXISTS over all pairs of parts of a document."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def part(kind: str, pattern: str) -> str:
        return f"""
  SELECT doc_id, m, {kind} AS kind, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, unnest(found) AS m, generate_subscripts(found, 1) AS i, found, parts
        FROM (SELECT doc_id, regexp_extract_all(t, {quoted(pattern)}) AS found, string_split_regex(t, {quoted(pattern)}) AS parts FROM d))"""

    size = lambda least, kind: f"CASE WHEN length(m) >= {least} THEN '{kind}' ELSE 'weak_{kind}' END"
    order = " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(KINDS))
    parts = " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in KINDS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS ({part(f"CASE WHEN length(regexp_extract(m, {quoted(ASSIGN)}, 2)) >= {MIN_ASSIGN} THEN 'assign' ELSE 'weak_assign' END", ASSIGN)}
  UNION ALL {part(size(MIN_ACCESS, "access"), ACCESS)}
  UNION ALL {part(size(MIN_HEX, "hex"), HEX)}
  UNION ALL {part("'weak_access'", CLIENT)}
  UNION ALL {part("'endpoint'", ENDPOINT)}),
p AS (SELECT doc_id, kind, CASE kind {parts} END AS part, CASE kind {order} END AS rank, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM h),
near AS (
  SELECT w.doc_id, w.kind, w.s, w.e, bool_or(o.part = 'access') AS access, bool_or(o.part = 'secret') AS secret
  FROM (SELECT DISTINCT * FROM p WHERE rank > 2) w JOIN p o
    ON o.doc_id = w.doc_id AND o.part <> w.part AND o.part <> 'endpoint'
   AND (o.e BETWEEN w.s - {SCOPE} AND w.s OR o.s BETWEEN w.e AND w.e + {SCOPE})
  GROUP BY ALL),
r AS (
  SELECT doc_id, kind, rank, s, e FROM p WHERE rank <= 2
  UNION ALL
  SELECT DISTINCT p.doc_id, p.kind, p.rank, p.s, p.e FROM p JOIN near n ON p.doc_id = n.doc_id AND p.kind = n.kind AND p.s = n.s AND p.e = n.e
  WHERE p.rank > 2 AND CASE p.part WHEN 'access' THEN secret WHEN 'secret' THEN access ELSE access AND secret END),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank <= 2) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLE = _oracle()
