"""The library's queries by name, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.functions import geometry as g
from calibra.functions import text as tx
from calibra.functions import tolerance as tol
from calibra.operators import consensus, evaluate, groups, layout, predicates, session, spatial
from calibra.plans.synthetic import HEIGHT, LINES_SQL, WIDTH, lines, read
from calibra.sources import readings

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql:
            _oracles[name or f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def _case(value: str, table: tuple, otherwise: str = "NULL") -> str:
    """A table of limits as SQL."""
    open_end = f"ELSE {table[-1][1]}::DOUBLE" if table[-1][0] is None else f"ELSE {otherwise}"
    return "CASE " + " ".join(f"WHEN {value} <= {limit} THEN {entry}::DOUBLE" for limit, entry, *_ in table if limit is not None) + f" {open_end} END"


def _lookup_sql(standard: str, kind: str, value: str = "value") -> str:
    corner = kind in ("chamfer", "radius")
    if standard == "pisco":
        return _case(value, tol.PISCO_CORNER) if corner else f"CASE WHEN {value} >= 0.1 THEN {_case(value, tol.PISCO['diameter' if kind == 'diameter' else 'linear'])} END"
    return f"CASE WHEN {value} <= 0 THEN NULL WHEN {value} <= 0.099 THEN {value} WHEN {value} < 0.5 THEN 0.1::DOUBLE ELSE {_case(value, tol.CORNER if corner else tol.LINEAR[standard])} END"


def _tolerance_lookup(standard: str, kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nominal = F.col("value")
        return read(spark, sf_dir, "events").select("event_id", nominal.alias("nominal"), tol.general(nominal, standard, F.lit(kind)).alias("tolerance"))

    name = f"tolerance_lookup_{'jis_' if standard != 'pisco' else ''}{standard}_{kind}"
    _query(f"SELECT event_id, value AS nominal, {_lookup_sql(standard, kind)} AS tolerance FROM events", name)(run)


for _standard in ("f", "m", "pisco"):
    for _kind in ("linear", "diameter", "chamfer", "radius"):
        _tolerance_lookup(_standard, _kind)


@_query("""
SELECT CASE WHEN value <= 0.099 THEN 0.099::DOUBLE WHEN value < 0.5 THEN 0.5::DOUBLE WHEN value <= 3 THEN 3.0::DOUBLE WHEN value <= 6 THEN 6.0::DOUBLE WHEN value <= 30 THEN 30.0::DOUBLE
            WHEN value <= 120 THEN 120.0::DOUBLE WHEN value <= 400 THEN 400.0::DOUBLE WHEN value <= 1000 THEN 1000.0::DOUBLE ELSE 4000.0::DOUBLE END AS bracket,
       count(*) AS n, min(value) AS least, max(value) AS most
FROM events GROUP BY 1
""")
def tolerance_bracket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    bracket = F.when(v <= 0.099, 0.099).when(v < 0.5, 0.5)
    for limit in (3.0, 6.0, 30.0, 120.0, 400.0, 1000.0):
        bracket = bracket.when(v <= limit, limit)
    return read(spark, sf_dir, "events").groupBy(bracket.otherwise(4000.0).alias("bracket")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@_query(f"""
WITH b(lo, hi, tolerance) AS (VALUES {", ".join(f"({lo}::DOUBLE, {hi}::DOUBLE, {t}::DOUBLE)" for lo, (hi, t) in zip((0.5, *(x[0] for x in tol.LINEAR["m"])), tol.LINEAR["m"]))})
SELECT event_type, tolerance, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events JOIN b ON value > lo AND value <= hi GROUP BY ALL
""")
def tolerance_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup as a join with the table of brackets, eight rows whatever the input."""
    limits = [x[0] for x in tol.LINEAR["m"]]
    rows = spark.createDataFrame([(float(lo), float(hi), float(t)) for lo, (hi, t) in zip([0.5, *limits], tol.LINEAR["m"])], "lo double, hi double, tolerance double")
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return events.join(F.broadcast(rows), (F.col("value") > F.col("lo")) & (F.col("value") <= F.col("hi"))).groupBy("event_type", "tolerance").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@_query(f"""
SELECT p_partkey, CAST(p_size * 10 AS DOUBLE) AS short_side, {_case("p_size * 10", tol.ANGLE)} AS tolerance,
       CASE WHEN p_size * 10 <= 10 THEN '±1°' WHEN p_size * 10 <= 50 THEN '±30′' WHEN p_size * 10 <= 120 THEN '±20′' WHEN p_size * 10 <= 400 THEN '±10′' ELSE '±5′' END AS label FROM part
""")
def angle_tolerance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = (F.col("p_size") * 10).cast("double")
    value, label = tol.angle(side)
    return read(spark, sf_dir, "part").select("p_partkey", side.alias("short_side"), value.alias("tolerance"), label.alias("label"))


@_query(f"""
SELECT p_size, CAST(grade AS INTEGER) AS grade, round([{", ".join(f"{x}::DOUBLE" for x in tol.IT_FACTORS)}][grade] * (0.45::DOUBLE * pow(p_size, 1.0::DOUBLE / 3.0) + 0.001::DOUBLE * p_size) / 1000.0, 6) AS width
FROM (SELECT DISTINCT p_size FROM part), range(1, 19) t(grade)
""")
def iso_fit_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_size").distinct().withColumn("grade", F.explode(F.sequence(F.lit(1), F.lit(18))))
    return rows.select("p_size", "grade", F.round(tol.fit_width(F.col("p_size").cast("double"), F.col("grade")), 6).alias("width"))


@_query(f"""
WITH n AS (SELECT o_orderkey AS page_key, CASE WHEN o_orderkey % 5 = 0 THEN 0.05::DOUBLE END AS chamfer_note, CASE WHEN o_orderkey % 7 = 0 THEN 0.25::DOUBLE END AS radius_note FROM orders), {LINES_SQL.strip()}
SELECT l.page_key, l.line_id, k.kind, CASE WHEN k.kind = 'chamfer' THEN coalesce(chamfer_note, {_lookup_sql("m", "chamfer", "nominal")}) WHEN k.kind = 'radius' THEN coalesce(radius_note, {_lookup_sql("m", "radius", "nominal")}) ELSE {_lookup_sql("m", "linear", "nominal")} END AS tolerance
FROM lines l LEFT JOIN n ON n.page_key = l.page_key, LATERAL (SELECT CASE prefix WHEN 'C' THEN 'chamfer' WHEN 'R' THEN 'radius' WHEN 'φ' THEN 'diameter' ELSE 'linear' END AS kind) k
""")
def note_override_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pages = read(spark, sf_dir, "orders").select(key.alias("page_key"), F.when(key % 5 == 0, 0.05).alias("chamfer_note"), F.when(key % 7 == 0, 0.25).alias("radius_note"))
    rows = lines(spark, sf_dir).join(pages, "page_key", "left").withColumn("kind", tx.kind(F.col("prefix"), F.lit("")))
    return rows.select("page_key", "line_id", "kind", tol.with_notes(F.col("nominal"), "m", F.col("kind"), F.col("chamfer_note"), F.col("radius_note")).alias("tolerance"))


@_query(f"WITH {LINES_SQL} SELECT CASE prefix WHEN 'C' THEN 'chamfer' WHEN 'R' THEN 'radius' WHEN 'φ' THEN 'diameter' ELSE 'linear' END AS kind, count(*) AS n, sum(nominal) AS total FROM lines GROUP BY 1")
def classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy(tx.kind(F.col("prefix"), F.lit("")).alias("kind")).agg(F.count("*").alias("n"), F.sum("nominal").alias("total"))


def _synthetic_range() -> Column:
    return F.when(F.col("tolerance") > 0, F.round(F.col("tolerance") / 50.0, 6))


@_query(f"""
WITH {LINES_SQL}, r AS (SELECT CASE prefix WHEN 'C' THEN 'angle' WHEN 'R' THEN 'roughness' WHEN 'φ' THEN 'geometric' ELSE 'linear' END AS kind, CASE WHEN tolerance > 0 THEN round(tolerance / 50.0::DOUBLE, 6) END AS total FROM lines)
SELECT kind, CASE WHEN kind <> 'geometric' AND total <= CASE kind WHEN 'roughness' THEN 5.7::DOUBLE WHEN 'angle' THEN 1.0::DOUBLE ELSE 0.03::DOUBLE END + 1e-9 THEN '#ff33cc' ELSE '#ffff00' END AS color, count(*) AS n FROM r GROUP BY ALL
""")
def highlight_color_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("prefix")
    kind = F.when(p == "C", "angle").when(p == "R", "roughness").when(p == "φ", "geometric").otherwise("linear")
    rows = lines(spark, sf_dir).select(kind.alias("kind"), _synthetic_range().alias("total"))
    return rows.groupBy("kind", tol.highlight(F.col("kind"), F.col("total")).alias("color")).agg(F.count("*").alias("n"))


@_query(f"WITH {LINES_SQL} SELECT page_key, line_id, text, CASE WHEN tolerance > 0 THEN round(tolerance / 50.0::DOUBLE, 6) END AS total FROM lines")
def explicit_tolerance_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("page_key", "line_id", "text", F.round(tol.explicit_range(F.col("text"), F.col("nominal")), 6).alias("total"))


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id, CASE line_id % 4 WHEN 0 THEN 'Ø' WHEN 1 THEN '$' WHEN 2 THEN ')' ELSE 'Ω' END || CAST(CAST(nominal AS INTEGER) AS VARCHAR) || CASE WHEN tolerance > 0 THEN ' 士0' || CAST(tolerance AS VARCHAR) ELSE 'MAX' END AS raw,
       CASE line_id % 4 WHEN 1 THEN '' ELSE 'Φ' END || CAST(CAST(nominal AS INTEGER) AS VARCHAR) || CASE WHEN tolerance > 0 THEN '±0.' || CAST(tolerance AS VARCHAR) ELSE '' END AS normal
FROM lines
""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.get(F.array(*map(F.lit, "Ø$)Ω")), (F.col("line_id") % 4).cast("int"))
    tail = F.when(F.col("tolerance") > 0, F.concat(F.lit(" 士0"), F.col("tolerance").cast("string"))).otherwise("MAX")
    rows = lines(spark, sf_dir).select("page_key", "line_id", F.concat(sign, F.col("nominal").cast("int").cast("string"), tail).alias("raw"))
    return rows.withColumn("normal", tx.normalize(tx.nfkc("raw")))


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id, upper(prefix) AS prefix, nominal, line_id % 3 = 0 AS reference FROM lines WHERE tolerance = 0
""")
def parse_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir).withColumn("raw", F.when(F.col("line_id") % 3 == 0, F.concat(F.lit("("), "text", F.lit(")"))).otherwise(F.col("text")))
    return t.withColumn("t", tx.token(F.col("raw"))).where("t is not null").select("page_key", "line_id", "t.prefix", "t.nominal", "t.reference")


@_query("""
SELECT doc_id FROM documents
WHERE regexp_matches(text, '(?i)(?:SCALE|DATE|DWG|DRAWING|PAGE|SHEET|REV|図番|品番|尺度|日付|材質|MODEL|PART|NO\\.|型式|改訂|番号|公差|以上|超え|Rz\\s*max|Rzmax|Ra\\s*max|Ramax|Rmax)')
""")
def context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(predicates.no_dimension_context(F.col("text"))).select("doc_id")


@_query(f"""
WITH {LINES_SQL}, r AS (
  SELECT CASE WHEN prefix = '' AND score < 0.82 THEN 'low_confidence' WHEN prefix = '' AND nominal >= 500 THEN 'bare_too_large' WHEN prefix = '' AND nominal IN (90, 180, 360) THEN 'bare_angle'
              WHEN prefix = 'φ' AND nominal > 80 THEN 'diameter_too_large' WHEN prefix = 'φ' AND nominal < 1.0 THEN 'diameter_too_small' WHEN prefix = '' AND nominal < 1.0 THEN 'bare_too_small' ELSE 'kept' END AS stage FROM lines)
SELECT stage, count(*) AS n FROM r GROUP BY 1
""")
def reject_reason_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("kind", tx.kind(F.col("prefix"), F.lit("")))
    reason = predicates.reject_reason(F.col("kind"), F.col("prefix"), F.lit(""), F.col("nominal"), tx.normalize(F.col("text")), F.col("score"), F.lit(1))
    return evaluate.funnel(rows.withColumn("stage", F.coalesce(reason, F.lit("kept"))))


@_query(f"""
WITH {LINES_SQL}
SELECT count(*) AS n, count(*) FILTER (y1 / {HEIGHT}::DOUBLE < 0.10 OR y0 / {HEIGHT}::DOUBLE > 0.80 OR (x0 / {WIDTH}::DOUBLE > 0.62 AND y0 / {HEIGHT}::DOUBLE > 0.68) OR (x0 / {WIDTH}::DOUBLE > 0.84 AND y1 / {HEIGHT}::DOUBLE < 0.50)) AS outside
FROM lines
""")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predicates.outside_drawing(g.Rect.of(), F.lit(WIDTH), F.lit(HEIGHT))
    return lines(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(out).alias("outside"))


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id, round(least(1.0::DOUBLE, score + CASE WHEN line_id % 3 = 0 THEN 0.12 ELSE 0.0 END + CASE WHEN line_id % 2 = 0 THEN 0.10 ELSE 0.0 END + CASE WHEN tolerance > 0 THEN 0.05 ELSE 0.0 END + CASE WHEN prefix <> '' THEN 0.05 ELSE 0.0 END), 6) AS quality FROM lines
""")
def scanned_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    agreement = F.when(F.col("line_id") % 3 == 0, 2).otherwise(1)
    q = predicates.scanned_quality(F.col("score"), agreement, F.col("line_id") % 2 == 0, F.col("text"), F.col("prefix"), F.lit(""))
    return lines(spark, sf_dir).select("page_key", "line_id", F.round(q, 6).alias("quality"))


_IOS = "(greatest(least(l.x1, o.x1) - greatest(l.x0, o.x0), 0) * greatest(least(l.y1, o.y1) - greatest(l.y0, o.y0), 0)) / least((l.x1 - l.x0) * (l.y1 - l.y0), (o.x1 - o.x0) * (o.y1 - o.y0))"
_DIST = "sqrt(((l.x0 + l.x1) / 2 - (o.x0 + o.x1) / 2) ^ 2 + ((l.y0 + l.y1) / 2 - (o.y0 + o.y1) / 2) ^ 2)"


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id FROM lines l WHERE NOT EXISTS (SELECT 1 FROM lines o WHERE o.page_key = l.page_key AND (o.tolerance > 0 OR o.line_id % 4 = 0) AND o.line_id <> l.line_id AND {_IOS} >= 0.18)
""")
def overlap_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without richer evidence over them: a tolerance, or, on every fourth, a limit."""
    words = F.get(F.array(*map(F.lit, ("以下", "max", "以内", "Min"))), (F.col("line_id") / 4).cast("int") % 4)
    t = lines(spark, sf_dir).withColumn("text", F.when(F.col("line_id") % 4 == 0, F.concat("text", words)).otherwise(F.col("text")))
    return spatial.drop_where(t, t.where(predicates.richer_evidence(F.col("text"))), spatial.richer_reading).select("page_key", "line_id")


def _close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic readings closer together, as tall as wide at times, with all that belongs to them."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0") + F.col("line_id") % 3
    t = lines(spark, sf_dir).withColumn("_w", w).withColumn("_h", h).withColumn("x0", F.col("x0") % 60).withColumn("y0", F.col("y0") % 60)
    return t.withColumn("x1", F.col("x0") + F.col("_w")).withColumn("y1", F.col("y0") + F.col("_h")).drop("_w", "_h")


_CLOSE_SQL = f"""
{LINES_SQL.strip()}, c AS (
  SELECT page_key, line_id, prefix, nominal, text, tolerance, score, x0 % 60 AS x0, y0 % 60 AS y0, x0 % 60 + (x1 - x0) AS x1, y0 % 60 + (y1 - y0 + line_id % 3) AS y1 FROM lines
)
"""


@_query(f"""
WITH {_CLOSE_SQL.strip()}
SELECT page_key, line_id FROM c l WHERE NOT (regexp_full_match(l.text, '[0-9]+') AND EXISTS (
  SELECT 1 FROM c o WHERE o.page_key = l.page_key AND o.line_id <> l.line_id AND o.tolerance > 0 AND contains(upper(o.text), CAST(CAST(l.nominal AS BIGINT) AS VARCHAR))
  AND ({_IOS} >= 0.18 OR {_DIST} <= greatest(5.0, least(14.0, 1.5 * greatest(l.x1 - l.x0, l.y1 - l.y0))))))
""")
def digit_echo_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _close(spark, sf_dir)
    evidence = t.where("tolerance > 0").withColumn("text", tx.normalize(F.col("text")))
    return spatial.drop_where(t, evidence, spatial.digit_echo).select("page_key", "line_id")


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id FROM lines l WHERE prefix = '' AND NOT EXISTS (SELECT 1 FROM lines o WHERE o.page_key = l.page_key AND o.prefix <> '' AND ({_IOS} >= 0.22 OR {_DIST} <= greatest(3.0, least(l.x1 - l.x0, l.y1 - l.y0) * 0.8)))
""")
def reference_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    return spatial.drop_where(t.where("prefix = ''"), t.where("prefix <> ''"), spatial.reference).select("page_key", "line_id")


@_query(f"""
WITH {_CLOSE_SQL.strip()}, p AS (
  SELECT l.page_key, l.line_id FROM c l JOIN c o ON o.page_key = l.page_key AND o.line_id <> l.line_id AND o.tolerance > 0
  WHERE least(l.y1, o.y1) - greatest(l.y0, o.y0) >= 0.35 * greatest(1.0, least(l.y1 - l.y0, o.y1 - o.y0))
    AND ((o.x0 >= l.x1 - 0.35 * (l.y1 - l.y0) AND o.x0 <= l.x1 + 4.5 * (l.y1 - l.y0)) OR (o.y0 >= l.y1 - 0.35 * (l.x1 - l.x0) AND o.y0 <= l.y1 + 4.5 * (l.x1 - l.x0)))
)
SELECT page_key, line_id FROM c EXCEPT SELECT page_key, line_id FROM p
""")
def tolerance_attached_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _close(spark, sf_dir)
    return spatial.drop_where(t, t.where("tolerance > 0"), spatial.tolerance_attached).select("page_key", "line_id")


@_query(f"""
WITH {LINES_SQL}, m AS (SELECT *, greatest(10.0, least(24.0, greatest(x1 - x0, y1 - y0) * 2.2)) AS margin FROM lines)
SELECT page_key, line_id FROM m l WHERE NOT EXISTS (SELECT 1 FROM lines o WHERE o.page_key = l.page_key AND o.line_id <> l.line_id AND o.tolerance > 5
  AND least(l.x1 + margin, o.x1) > greatest(l.x0 - margin, o.x0) AND least(l.y1 + margin, o.y1) > greatest(l.y0 - margin, o.y0))
""")
def tolerance_margin_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    return spatial.drop_where(t, t.where("tolerance > 5"), spatial.tolerance_margin).select("page_key", "line_id")


@_query(f"""
WITH {_CLOSE_SQL.strip()}, n AS (
  SELECT l.page_key, l.line_id, count(*) AS n FROM c l JOIN c o ON o.page_key = l.page_key AND o.line_id <> l.line_id
  WHERE regexp_full_match(l.text, '[0-9]+') AND length(o.text) <= 3 AND translate(o.text, '0123456789.+-一十', '') = ''
    AND abs(l.x0 + l.x1 - o.x0 - o.x1) / 2 <= greatest(4.0, 1.2 * (l.x1 - l.x0)) AND abs(l.y0 + l.y1 - o.y0 - o.y1) / 2 <= greatest(18.0, 3.0 * (l.y1 - l.y0))
  GROUP BY ALL
)
SELECT page_key, line_id FROM c WHERE (page_key, line_id) NOT IN (SELECT (page_key, line_id) FROM n WHERE n >= 2)
""")
def stacked_fragment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _close(spark, sf_dir)
    return spatial.stacked(t, t).select("page_key", "line_id")


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id FROM lines l WHERE NOT EXISTS (SELECT 1 FROM lines o WHERE o.page_key = l.page_key AND o.line_id <> l.line_id AND length(o.text) >= length(l.text) + 2 AND ends_with(o.text, l.text) AND {_DIST} <= 58)
""")
def truncated_suffix_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    return spatial.drop_where(t, t, spatial.truncated).select("page_key", "line_id")


@_query(f"WITH {LINES_SQL} SELECT page_key, line_id FROM lines l WHERE score >= 0.9 AND EXISTS (SELECT 1 FROM lines o WHERE o.page_key = l.page_key AND o.line_id <> l.line_id AND {_IOS} >= 0.45)")
def evidence_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    return spatial.keep_where(t.where("score >= 0.9"), t, spatial.replaced).select("page_key", "line_id")


_BEHIND = """
WITH {lines}, p AS (
  SELECT l.page_key, l.line_id, o.line_id AS o_line_id, abs((l.y0 + l.y1) / 2 - (o.y0 + o.y1) / 2) AS across, greatest(12.0, greatest(o.y1 - o.y0, 1.0) * 1.5) AS reach,
         l.x0 - o.x1 AS after, o.x0 - l.x1 AS before, least(l.x1, o.x1) > greatest(l.x0, o.x0) AS over
  FROM lines l JOIN lines o ON o.page_key = l.page_key WHERE l.tolerance > 0 AND o.tolerance = 0
), c AS (
  SELECT *, CASE WHEN after BETWEEN -6 AND 56 AND across <= reach THEN after WHEN before BETWEEN -6 AND 56 AND across <= reach THEN before ELSE 1000.0 + across END AS cost FROM p
  WHERE (after BETWEEN -6 AND 56 AND across <= reach) OR (before BETWEEN -6 AND 56 AND across <= reach) OR (over AND across BETWEEN 1.5 AND 30)
)
SELECT page_key, line_id, o_line_id, round(cost, 6) AS cost FROM c QUALIFY row_number() OVER (PARTITION BY page_key, line_id ORDER BY cost, o_line_id) = 1
"""


@_query(_BEHIND.replace("{lines}", LINES_SQL))
def nearest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    out = spatial.nearest(t.where("tolerance > 0"), t.where("tolerance = 0"), ["page_key"], spatial.behind, spatial.behind_cost)
    return out.select("page_key", "line_id", "o_line_id", F.round("cost", 6).alias("cost"))


@_query(f"""
WITH {LINES_SQL}, p AS (
  SELECT l.page_key, l.line_id, o.line_id AS o_line_id, o.x0 - l.x1 AS gap, greatest(l.y0 - o.y1, o.y0 - l.y1, 0.0) AS above, l.x1 - l.x0 AS w, l.y1 - l.y0 AS h
  FROM lines l JOIN lines o ON o.page_key = l.page_key WHERE l.tolerance = 0 AND o.tolerance > 0
), c AS (SELECT *, greatest(gap, 0.0) + above * 0.35 AS cost FROM p WHERE gap BETWEEN -greatest(4.0, w * 0.18) AND greatest(40.0, w * 1.45) AND above <= greatest(28.0, h * 2.4))
SELECT page_key, line_id, o_line_id, round(cost, 6) AS cost, CAST(row_number() OVER (PARTITION BY page_key, line_id ORDER BY cost, o_line_id) AS INTEGER) AS rank FROM c
QUALIFY row_number() OVER (PARTITION BY page_key, line_id ORDER BY cost, o_line_id) <= 2
""")
def top2_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    out = spatial.nearest(t.where("tolerance = 0"), t.where("tolerance > 0"), ["page_key"], spatial.right_lane, spatial.right_lane_cost, most=2)
    return out.select("page_key", "line_id", "o_line_id", F.round("cost", 6).alias("cost"), "rank")


@_query(f"""
WITH {LINES_SQL}
SELECT l.page_key, l.line_id, o.line_id AS o_line_id FROM lines l JOIN lines o ON o.page_key = l.page_key AND o.prefix = l.prefix AND abs(o.nominal - l.nominal) <= 1e-7 AND o.line_id <> l.line_id AND {_DIST} <= greatest(200.0, 0.65 * (l.y1 - l.y0))
QUALIFY row_number() OVER (PARTITION BY l.page_key, l.line_id ORDER BY {_DIST}, o.line_id) = 1
""")
def candidate_match_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    near = lambda a, b: spatial.not_same() & (F.abs(F.col("o.nominal") - F.col("l.nominal")) <= 1e-7) & (g.centre_distance(a, b) <= F.greatest(F.lit(200.0), a.height * 0.65))
    return spatial.nearest(t, t, ["page_key", "prefix"], near, g.centre_distance).select("page_key", "line_id", "o_line_id")


@_query(f"""
WITH {LINES_SQL}, s AS (SELECT page_key, x0 - 10 AS x0, y1 + 4 AS y0, x1 + 10 AS x1, y1 + 4 AS y1, true AS horizontal FROM lines WHERE line_id % 2 = 0), n AS (
  SELECT l.page_key, l.line_id, count(s.page_key) AS n_segments FROM lines l LEFT JOIN s ON s.page_key = l.page_key AND l.x1 - l.x0 >= l.y1 - l.y0 AND abs(s.y0 - (l.y0 + l.y1) / 2) <= greatest(12.0, (l.y1 - l.y0) * 3.2)
    AND s.x1 >= l.x0 - greatest(20.0, (l.x1 - l.x0) * 2.2) AND s.x0 <= l.x1 + greatest(20.0, (l.x1 - l.x0) * 2.2) GROUP BY ALL)
SELECT page_key, line_id, n_segments, CASE n_segments WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.74::DOUBLE ELSE 0.95::DOUBLE END AS line_score FROM n
""")
def line_support_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    segments = t.where("line_id % 2 = 0").select("page_key", (F.col("x0") - 10).alias("x0"), (F.col("y1") + 4).alias("y0"), (F.col("x1") + 10).alias("x1"), (F.col("y1") + 4).alias("y1"), F.lit(True).alias("horizontal"))
    return spatial.line_support(t, segments).select("page_key", "line_id", "n_segments", "line_score")


@_query(f"WITH {LINES_SQL} SELECT page_key, prefix, text, min(line_id) AS line_id FROM lines GROUP BY ALL")
def exact_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.first_of(lines(spark, sf_dir), [F.col("page_key"), F.col("prefix"), F.col("text")], [F.col("line_id")]).select("page_key", "prefix", "text", "line_id")


@_query("""
WITH c AS (SELECT p_brand, p_type, round(p_size / 5) * 5 AS size, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type AS font, size, n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, contains(p_type, 'BRASS') DESC, size DESC, p_type DESC) = 1
""")
def modal_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("font"), (F.round(F.col("p_size") / 5) * 5).alias("size"))
    return evaluate.modal_style(rows, "p_brand", F.col("font").contains("BRASS"))


@_query("""
WITH truth AS (SELECT DISTINCT p_size % 4 AS kind, CAST(p_size AS DOUBLE) AS value FROM part), found AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) % 4 AS kind, l_quantity AS value FROM lineitem WHERE l_linenumber < 4 AND l_quantity > 10),
m AS (SELECT t.kind AS tk, f.kind AS fk FROM truth t FULL JOIN found f ON t.kind = f.kind AND t.value = f.value),
c AS (SELECT count(*) FILTER (tk IS NOT NULL AND fk IS NOT NULL) AS hits, count(fk) AS n_found, count(tk) AS n_truth FROM m)
SELECT hits, n_found, n_truth, CASE WHEN n_found > 0 THEN hits / n_found ELSE 0.0::DOUBLE END AS precision, CASE WHEN n_truth > 0 THEN hits / n_truth ELSE 0.0::DOUBLE END AS recall,
       CASE WHEN n_found + n_truth > 0 THEN 2.0::DOUBLE * hits / (n_found + n_truth) ELSE 0.0::DOUBLE END AS f1 FROM c
""")
def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = read(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("kind"), F.col("p_size").cast("double").alias("value"))
    found = read(spark, sf_dir, "lineitem").where("l_linenumber < 4 and l_quantity > 10").select((F.col("l_quantity").cast("int") % 4).alias("kind"), F.col("l_quantity").alias("value"))
    return evaluate.scores(truth, found, ["kind", "value"])


@_query("""
WITH truth AS (SELECT 'k' || CAST(i AS VARCHAR) AS name, ['a' || CAST(i AS VARCHAR), CAST(i AS VARCHAR)] AS names FROM range(1, 61) t(i)),
found AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE '' END || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS text FROM lineitem)
SELECT name, EXISTS (SELECT 1 FROM found WHERE list_contains(names, text)) AS hit FROM truth
""")
def recall_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id").cast("string")
    truth = spark.range(1, 61).select(F.concat(F.lit("k"), i).alias("name"), F.concat(F.lit("a"), i).alias("key"), F.array(i).alias("aliases"))
    text = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise(""), F.col("l_quantity").cast("int").cast("string"))
    return evaluate.recall_by_alias(truth, read(spark, sf_dir, "lineitem").select(text.alias("text")))


@_query("""
SELECT count(*) AS n_files, avg(CAST(length(html) >= 40 AS DOUBLE)) AS text_ratio, avg(CAST(contains(html, '<img') AS DOUBLE)) AS image_ratio, CAST(median(length(html)) AS DOUBLE) AS median_length,
       (SELECT avg(CAST(n > 1 AS DOUBLE)) FROM (SELECT count(*) AS n FROM pages GROUP BY regexp_extract(url, '://([^/?#]*)', 1))) AS repeated_family_ratio
FROM pages
""")
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "pages").select(F.length("html").alias("n_chars"), F.col("html").contains("<img").alias("has_image"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("family"))
    return evaluate.audit(t)


@_query(f"WITH {LINES_SQL} SELECT page_key, line_id, CAST(row_number() OVER (PARTITION BY page_key ORDER BY y0, x0, line_id) AS INTEGER) AS position FROM lines")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page_key").orderBy("y0", "x0", "line_id")
    return lines(spark, sf_dir).select("page_key", "line_id", F.row_number().over(w).alias("position"))


@_query(f"""
WITH {LINES_SQL}, r AS (SELECT page_key, line_id, round(1.5 * length(text) + score + CASE WHEN prefix = 'φ' THEN 5 ELSE 0 END + CASE WHEN tolerance > 0 THEN 2 ELSE 0 END, 6) AS rank_score FROM lines)
SELECT page_key, line_id, rank_score FROM r QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY rank_score DESC, line_id) <= 8
""")
def ranked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 1.5 * F.length("text") + F.col("score") + F.when(F.col("prefix") == "φ", 5).otherwise(0) + F.when(F.col("tolerance") > 0, 2).otherwise(0)
    rows = lines(spark, sf_dir).select("page_key", "line_id", F.round(score, 6).alias("rank_score"))
    w = Window.partitionBy("page_key").orderBy(F.desc("rank_score"), "line_id")
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 8").drop("n")


@_query("""
SELECT user_id, event_type AS item, count(*) % 2 = 1 AS selected, count(*) AS n_toggles, max(event_id) AS last_event FROM events GROUP BY ALL
""")
def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_type").alias("item"), "event_id")
    return session.toggled(log, ["user_id", "item"], "event_id")


@_query("""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 7 = 0 AS clears FROM events),
c AS (SELECT user_id, max(event_id) AS at FROM e WHERE clears GROUP BY 1)
SELECT e.user_id, count(*) AS n_items, max(e.event_id) AS last_event, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM e LEFT JOIN c ON c.user_id = e.user_id WHERE c.at IS NULL OR e.event_id > c.at GROUP BY 1
""")
def clear_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_id") % 7 == 0).alias("clears"))
    return session.since_cleared(log, ["user_id"], "event_id", "clears").groupBy("user_id").agg(F.count("*").alias("n_items"), F.max("event_id").alias("last_event"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@_query("""
SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id, CAST(greatest(24.0, least(180.0, arg_max(value, event_id))) AS DOUBLE) AS size FROM events GROUP BY ALL
""")
def edit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return session.last_edit(log, ["user_id", "event_type"], "event_id", ["value"]).withColumn("size", F.greatest(F.lit(24.0), F.least(F.lit(180.0), F.col("value"))))


@_query("""
SELECT DISTINCT p_size % 4 AS kind, p_size AS value FROM part INTERSECT SELECT DISTINCT CAST(l_quantity AS BIGINT) % 4, CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_quantity > 25
""")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "part").select((F.col("p_size") % 4).cast("long").alias("kind"), F.col("p_size").cast("long").alias("value"))
    q = F.col("l_quantity").cast("long")
    return a.intersect(read(spark, sf_dir, "lineitem").where("l_quantity > 25").select((q % 4).alias("kind"), q.alias("value")))


@_query("""
SELECT DISTINCT p_size % 4 AS kind, p_size AS value FROM part EXCEPT SELECT DISTINCT CAST(l_quantity AS BIGINT) % 4, CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_quantity > 25
""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "part").select((F.col("p_size") % 4).cast("long").alias("kind"), F.col("p_size").cast("long").alias("value"))
    q = F.col("l_quantity").cast("long")
    return a.subtract(read(spark, sf_dir, "lineitem").where("l_quantity > 25").select((q % 4).alias("kind"), q.alias("value")))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic readings closer together, so that more of them meet."""
    t = lines(spark, sf_dir)
    x0, y0 = F.col("x0") % 60, F.col("y0") % 60
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return t.select("page_key", "line_id", "text", "score", x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1).alias("agreement"), tx.kind(F.col("prefix"), F.lit("")).alias("kind"), (F.col("nominal") % 5).alias("nominal"))


_DENSE_SQL = f"""
RECURSIVE {LINES_SQL.strip()}, d AS (
  SELECT page_key, line_id, text, score, x0 % 60 AS x0, y0 % 60 AS y0, x0 % 60 + (x1 - x0) AS x1, y0 % 60 + (y1 - y0) AS y1, 1.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, CAST(1 AS INTEGER) AS agreement,
         CASE prefix WHEN 'C' THEN 'chamfer' WHEN 'R' THEN 'radius' WHEN 'φ' THEN 'diameter' ELSE 'linear' END AS kind, nominal % 5 AS nominal FROM lines
)
"""


@_query(f"""
WITH {_DENSE_SQL.strip()}, e AS (
  SELECT l.page_key, l.line_id AS a, o.line_id AS b FROM d l JOIN d o ON l.page_key = o.page_key AND l.line_id <> o.line_id
  WHERE (l.kind = o.kind OR (l.kind IN ('linear', 'diameter') AND o.kind IN ('linear', 'diameter'))) AND abs(l.nominal - o.nominal) <= 1e-6 AND {_DIST} <= 30
    AND ({_IOS} > 0.15 OR contains(l.text, o.text) OR contains(o.text, l.text))
), w AS (SELECT page_key, line_id AS a, line_id AS b FROM d UNION SELECT w.page_key, w.a, e.b FROM w JOIN e ON e.page_key = w.page_key AND e.a = w.b)
SELECT page_key, a AS line_id, min(b) AS callout FROM w GROUP BY ALL
""")
def callout_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.grouped(_dense(spark, sf_dir), groups.callout()).select("page_key", "line_id", F.col("group").alias("callout"))


@_query()
def ocr_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.by_page(_dense(spark, sf_dir), consensus.merge_readings, predicates.reading_quality(F.col("text"), F.col("score")).quality)


@_query()
def fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _dense(spark, sf_dir).withColumn("text", F.when(F.col("line_id") % 2 == 0, F.concat(F.lit("+0.0"), (F.col("line_id") % 9 + 1).cast("string"))).otherwise(F.col("text")))
    return consensus.by_page(t, consensus.join_fragments)


@_query()
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.by_page(_dense(spark, sf_dir), consensus.merge_candidates, predicates.candidate_quality(F.col("text")))


def _suppress_sql(order: str, same: str, source: str = "d") -> str:
    """A page's readings in an order, without those that are the same as one kept before (l before o): a page's readings are gone through one by one."""
    columns = ", ".join(f"o.{c}" for c in consensus.COLUMNS)
    return f"""
WITH {_DENSE_SQL.strip()}, r AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY {order}, line_id) AS k FROM {source}
), hit AS (SELECT o.page_key, o.k, list(l.k) AS ks FROM r o JOIN r l ON l.page_key = o.page_key AND l.k < o.k AND {same} GROUP BY ALL
), s AS (
  SELECT DISTINCT page_key, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS kept FROM r UNION ALL
  SELECT s.page_key, o.k, CASE WHEN h.ks IS NOT NULL AND list_has_any(h.ks, s.kept) THEN s.kept ELSE list_append(s.kept, o.k) END
  FROM s JOIN r o ON o.page_key = s.page_key AND o.k = s.k + 1 LEFT JOIN hit h ON h.page_key = o.page_key AND h.k = o.k
), e AS (SELECT page_key, kept FROM s QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY k DESC) = 1)
SELECT {columns} FROM r o JOIN e ON e.page_key = o.page_key AND list_contains(e.kept, o.k)
"""


_VALUE = "l.kind = o.kind AND abs(l.nominal - o.nominal) < 1e-6"
_AREA = "(x1 - x0) * (y1 - y0)"
_SUPPRESSED = {
    "candidate_dedupe": (consensus.dedupe_candidates, "CASE WHEN regexp_matches(text, '[φ°CR]') THEN 0 ELSE 1 END, CASE WHEN contains(text, '.') THEN 0 ELSE 1 END, y0", f"{_VALUE} AND {_DIST} < 24"),
    "final_candidates": (consensus.final_candidates, f"{_AREA}, y0, x0", f"{_VALUE} AND {_IOS} >= 0.15"),
    "tiled_candidates": (consensus.tiled_candidates, "CASE WHEN contains(text, '.') THEN 0 ELSE 1 END, y0, x0", f"{_IOS} >= 0.35"),
    "corner_candidates": (consensus.corner_candidates, f"CASE WHEN contains(text, '.') THEN 0 ELSE 1 END, {_AREA}, y0, x0", f"({_IOS} >= 0.35 OR {_DIST} <= greatest(18.0, 1.1 * greatest(l.x1 - l.x0, l.y1 - l.y0, o.x1 - o.x0, o.y1 - o.y0)))"),
    "append_strips": (consensus.append_strips, "line_id", f"l.text = o.text AND {_IOS} * least((l.x1 - l.x0) * (l.y1 - l.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) >= 0.82 * greatest((l.x1 - l.x0) * (l.y1 - l.y0), (o.x1 - o.x0) * (o.y1 - o.y0))"),
}
_SUPPRESSED |= {
    "native_markings": (consensus.native_markings, "line_id", f"{_IOS} >= 0.55"),
    "detail_lines": (consensus.detail_lines, "line_id", f"{_DIST} < 8"),
    "scanned_markings": (partial(consensus.with_scanned, base=lambda x: x.line_id % 3 == 0), "CASE WHEN line_id % 3 = 0 THEN 0 ELSE 1 END, line_id", f"o.line_id % 3 <> 0 AND {_IOS} >= 0.45"),
}
for _name, (_fold, _order, _same) in _SUPPRESSED.items():
    _query(_suppress_sql(_order, _same), _name)(lambda spark, sf_dir, f=_fold: consensus.by_page(_dense(spark, sf_dir), f))


def _reach_sql(strips: str, test: str) -> str:
    """Groups over edges l, o of a page with l.line_id < o.line_id, as tables m (strips) and q (m with the least line_id that is reached as grp)."""
    return f"""
{_DENSE_SQL.strip()}, m AS ({strips}), e AS (
  SELECT l.page_key, l.line_id AS a, o.line_id AS b FROM m l JOIN m o ON l.page_key = o.page_key AND l.line_id < o.line_id WHERE {test}
), z AS (SELECT page_key, a, b FROM e UNION ALL SELECT page_key, b, a FROM e
), w AS (SELECT page_key, line_id AS a, line_id AS b FROM m UNION SELECT w.page_key, w.a, z.b FROM w JOIN z ON z.page_key = w.page_key AND z.a = w.b
), q AS (SELECT m.*, (SELECT min(w.b) FROM w WHERE w.page_key = m.page_key AND w.a = m.line_id) AS grp FROM m)
"""


def _colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).withColumn("text", tol.highlight(F.col("kind"), F.col("nominal") / 50))


_COLORED_SQL = f"SELECT * REPLACE (CASE WHEN nominal / 50 <= 0.03 + 1e-9 THEN '{tol.PINK}' ELSE '{tol.YELLOW}' END AS text) FROM d"
_STRIP = "page_key, line_id, text, score, dx, dy, kind, nominal"
_BAND_SQL = (
    "l.text = o.text AND abs((l.y0 + l.y1 - o.y0 - o.y1) / 2) <= greatest(5.2, 0.8 * 8) "
    "AND NOT (least(l.x1 - l.x0, o.x1 - o.x0) > 3.5 * 8 AND least(l.x1 - l.x0, o.x1 - o.x0) / greatest(l.x1 - l.x0, o.x1 - o.x0) > 0.62) "
    "AND NOT (least(l.x1, o.x1) - greatest(l.x0, o.x0) > 0 AND least(l.x1, o.x1) - greatest(l.x0, o.x0) <= 0.16 * 8 AND abs((l.y0 + l.y1 - o.y0 - o.y1) / 2) > 0.28 * 8) "
    "AND (least(l.x1, o.x1) - greatest(l.x0, o.x0) > 0.4 OR greatest(l.x0, o.x0) - least(l.x1, o.x1) <= greatest(5.8, least(9.5, 0.9 * 8))) "
)


@_query(f"""
WITH {_reach_sql(_COLORED_SQL, _BAND_SQL)}
SELECT {_STRIP}, b.x0, b.y0, b.x1, b.y1, b.agreement FROM (SELECT page_key AS p, grp, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(count(*) AS INTEGER) AS agreement FROM q GROUP BY ALL) b
JOIN (SELECT {_STRIP} FROM q WHERE line_id = grp) f ON f.page_key = b.p AND f.line_id = b.grp
""")
def band_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of one colour that run on; the oracle knows that all are horizontal and 8 high."""
    return groups.bands(_colored(spark, sf_dir))


@_query(f"""
WITH {_reach_sql("SELECT * REPLACE ('roughness' AS kind) FROM d WHERE line_id % 3 <> 0", f"abs(l.nominal - o.nominal) <= 1e-6 AND ({_IOS} * least((l.x1 - l.x0) * (l.y1 - l.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) > 0.2 OR (least(l.y1, o.y1) - greatest(l.y0, o.y0) > 0.35 * 8 AND greatest(l.x0, o.x0) - least(l.x1, o.x1) <= 8) OR (least(l.x1, o.x1) - greatest(l.x0, o.x0) > 0.35 * least(l.x1 - l.x0, o.x1 - o.x0) AND greatest(l.y0, o.y0) - least(l.y1, o.y1) <= 8))")},
b AS (SELECT page_key, grp, min(x0) AS x0, max(x1) AS x1, CAST(count(*) AS INTEGER) AS agreement FROM q GROUP BY ALL), f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY page_key, grp ORDER BY (x1 - x0) * (y1 - y0) DESC, line_id) = 1)
SELECT f.page_key, f.line_id, f.text, f.score, f.dx, f.dy, f.kind, f.nominal, b.x0, f.y0, b.x1, f.y1, b.agreement FROM f JOIN b ON b.page_key = f.page_key AND b.grp = f.grp
UNION ALL SELECT {_STRIP}, x0, y0, x1, y1, agreement FROM d WHERE line_id % 3 = 0
""")
def roughness_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three readings as roughness; the oracle knows that all are horizontal and 8 high."""
    rough = F.when(F.col("line_id") % 3 != 0, "roughness").otherwise(F.col("kind"))
    return groups.merged_roughness(_dense(spark, sf_dir).withColumn("kind", rough))


@_query(f"""
WITH {_reach_sql(_COLORED_SQL, "l.text = o.text AND least(l.x1, o.x1) - greatest(l.x0, o.x0) >= 2 AND abs((l.y0 + l.y1 - o.y0 - o.y1) / 2) BETWEEN 3.5 AND 28")}
SELECT {_STRIP}, agreement, CASE WHEN n = 1 THEN x0 ELSE x0 - 0.2 END AS x0, CASE WHEN n = 1 THEN x1 ELSE x1 + 0.2 END AS x1, y0, y1 FROM (SELECT *, count(*) OVER (PARTITION BY page_key, grp) AS n FROM q)
""")
def strip_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of one colour beside one another; the oracle knows that all are horizontal and 8 high."""
    return groups.as_thick(_colored(spark, sf_dir))


@_query(f"WITH {LINES_SQL} SELECT page_key, CAST(line_id AS INTEGER) AS line_id, CASE WHEN x0 >= 100 AND x0 <= 300 AND y0 >= 50 AND y0 <= 250 THEN true ELSE false END AS hit FROM lines")
def polygon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within a polygon, by the even-odd rule; the oracle knows that it is a rectangle."""
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((99.5, 49.5), (300.5, 49.5), (300.5, 250.5), (99.5, 250.5))])
    return lines(spark, sf_dir).select("page_key", "line_id", g.in_polygon(F.col("x0"), F.col("y0"), corners).alias("hit"))


@_query(f"""
WITH {LINES_SQL}, t AS (SELECT user_id, event_id, CAST(event_id % 500 AS DOUBLE) AS px, CAST(event_id % 300 AS DOUBLE) AS py FROM events)
SELECT t.event_id, l.page_key, l.line_id FROM t JOIN lines l ON l.page_key = t.user_id AND px BETWEEN l.x0 - 8 AND l.x1 + 8 AND py BETWEEN l.y0 - 8 AND l.y1 + 8
QUALIFY row_number() OVER (PARTITION BY t.event_id ORDER BY (l.x1 - l.x0) * (l.y1 - l.y0), l.line_id) = 1
""")
def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest reading whose rectangle, padded by 8, holds the point that was clicked."""
    i = F.col("event_id")
    clicks = read(spark, sf_dir, "events").select(i, F.col("user_id").alias("page"), (i % 500).cast("double").alias("px"), (i % 300).cast("double").alias("py"))
    r = g.Rect.of()
    hits = clicks.join(lines(spark, sf_dir), (F.col("page") == F.col("page_key")) & r.grown(8.0).holds(F.col("px"), F.col("py")))
    return spatial.first_of(hits, [F.col("event_id")], [r.area, F.col("line_id")]).select("event_id", "page_key", "line_id")


@_query("""
WITH l AS (SELECT user_id, event_id, event_id % 4 = 0 AS undo FROM events), d AS (SELECT *, CAST(sum(CASE WHEN undo THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS depth FROM l)
SELECT user_id, event_id FROM d WHERE NOT undo AND NOT EXISTS (SELECT 1 FROM d x WHERE x.user_id = d.user_id AND x.event_id > d.event_id AND x.depth < d.depth)
""")
def undo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 4 == 0).alias("undo"))
    return session.undone(log, ["user_id"], "event_id", "undo").select("user_id", "event_id")


@_query(f"""
WITH {LINES_SQL}, k AS (SELECT page_key, prefix AS font, count(*) AS n FROM lines GROUP BY ALL), c AS (SELECT *, max(n) OVER (PARTITION BY page_key) AS most FROM k)
SELECT page_key, font, n FROM c WHERE n >= CASE WHEN most < 4 THEN 1 ELSE greatest(2, ceil(most * 0.08)) END
""")
def popular_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.popular_fonts(lines(spark, sf_dir).select("page_key", F.col("prefix").alias("font")), "page_key")


@_query(f"""
WITH {LINES_SQL}, k AS (SELECT page_key, CASE WHEN nominal / 60 BETWEEN 0.08 AND 0.75 THEN round(nominal / 60, 2) END AS width FROM lines), c AS (SELECT page_key, width, count(*) AS n FROM k WHERE width IS NOT NULL GROUP BY ALL)
SELECT p.page_key, coalesce((SELECT width FROM c WHERE c.page_key = p.page_key ORDER BY n DESC, width LIMIT 1), 0.35::DOUBLE) AS width FROM (SELECT DISTINCT page_key FROM lines) p
""")
def modal_stroke_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.modal_width(lines(spark, sf_dir).select("page_key", (F.col("nominal") / 60).alias("width")), "page_key")


@_query(r"""
SELECT p_partkey, CASE WHEN p_partkey % 60 BETWEEN 1 AND 50 THEN chr(CAST(CASE WHEN p_partkey % 60 <= 20 THEN 9311 + p_partkey % 60 WHEN p_partkey % 60 <= 35 THEN 12860 + p_partkey % 60 ELSE 12941 + p_partkey % 60 END AS INTEGER)) ELSE '(' || CAST(p_partkey % 60 AS VARCHAR) || ')' END AS label,
       'P' || CAST(p_partkey % 40 AS VARCHAR) AS family FROM part
""")
def labels_and_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 60
    stem = F.concat(F.lit("p"), (F.col("p_partkey") % 40).cast("string"), F.lit("_01-A"))
    return read(spark, sf_dir, "part").select("p_partkey", tx.circled(n).alias("label"), tx.family_key(stem).alias("family"))


@_query()
def roughness_parting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.by_page(_dense(spark, sf_dir), layout.part_overlaps)


@_query()
def marking_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.by_page(_dense(spark, sf_dir), consensus.merge_markings, predicates.marking_quality(F.col("text"), F.col("score"), F.lit(0.0)).quality)


def _agreed(readings: list[consensus.Reading]) -> list[consensus.Reading]:
    return consensus.independent_reads(readings, lambda r: r.line_id % 3)


@_query()
def independent_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.by_page(_dense(spark, sf_dir).withColumn("nominal", F.floor(F.col("nominal") / 2).cast("double")), _agreed)


@_query(f"""
WITH {LINES_SQL}, t AS (
  SELECT page_key, line_id, text, nominal, tolerance / 50.0::DOUBLE AS total, regexp_replace(text, '^[φCR]', '') AS stem FROM lines)
SELECT page_key, line_id, coalesce(nominal > 0 AND nominal <= 4000 AND total > 0 AND total <= greatest(nominal * 0.6, least(3.0, greatest(nominal, 0.5))) AND (regexp_matches(text, '(?i)[φΦØ⌀CR]') OR total <= nominal * 0.4)
  AND NOT regexp_matches(text, '^[.]|[.:,+±-]$|±0$|[±+-]0[.]?$') AND NOT regexp_matches(text, '\\d[.][±+-]') AND NOT regexp_matches(text, '^\\d{{1,2}}[±+-]\\d$') AND NOT regexp_matches(stem, '[A-Za-z]'), false) AS plausible
FROM t
""")
def plausible_markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("page_key", "line_id", predicates.plausible_tolerance(F.col("text"), F.col("nominal"), F.col("tolerance") / 50.0).alias("plausible"))


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id, CASE WHEN line_id % 5 = 0 THEN 'angle:' || CAST(CAST(nominal AS INTEGER) AS VARCHAR) || '.0' ELSE prefix || CAST(CAST(nominal AS INTEGER) AS VARCHAR) || CASE WHEN tolerance > 0 THEN '±' || CAST(tolerance / 100.0::DOUBLE AS VARCHAR) ELSE '' END END AS key FROM lines
""")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("line_id") % 5 == 0, F.concat(F.lit("~ "), F.col("nominal").cast("int").cast("string"), F.lit("。"))).otherwise(F.translate("text", "φ±", "Ø士"))
    return lines(spark, sf_dir).select("page_key", "line_id", tx.canonical_key(text).alias("key"))


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id, ['C', 'R'][line_id % 2 + 1] AS sign, CASE WHEN line_id % 3 = 0 THEN CAST('0.' || CAST(CAST(nominal AS INTEGER) AS VARCHAR) AS DOUBLE) ELSE CAST(CAST(nominal AS INTEGER) AS DOUBLE) END AS value FROM lines
""")
def corner_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("nominal").cast("int").cast("string")
    text = F.concat(F.when(F.col("line_id") % 2 == 0, "c").otherwise("R "), F.when(F.col("line_id") % 3 == 0, "〇.").otherwise(""), n)
    return lines(spark, sf_dir).withColumn("c", tx.corner_code(text)).select("page_key", "line_id", "c.sign", "c.value")


@_query(f"""
WITH {LINES_SQL}
SELECT count(*) FILTER (tolerance BETWEEN 1 AND 9) AS deviations, count(*) FILTER (tolerance = 0) AS glyphs, count(*) FILTER (tolerance < 10) AS clusters FROM lines
""")
def fit_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir).select(F.when(F.col("tolerance") > 9, "x").when(F.col("tolerance") > 0, F.concat(F.lit("(+0.0"), F.col("tolerance").cast("string"), F.lit(" -0.001)"))).otherwise("(").alias("text"))
    text = F.col("text")
    return t.agg(F.count_if(tx.is_fit_deviation(text)).alias("deviations"), F.count_if(text.rlike(tx.FIT_GLYPHS)).alias("glyphs"), F.count_if(tx.in_fit_cluster(text)).alias("clusters"))


@_query(f"""
WITH {LINES_SQL}, w AS (SELECT * FROM (VALUES (0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (1, -1), (-1, 1), (1, 1)) v(x, y)), o AS (
  SELECT 0 AS n, 0 AS x, 0 AS y UNION ALL SELECT CAST(8 * (k - 1) + p AS INTEGER), x * k, y * k FROM (SELECT x, y, row_number() OVER () AS p FROM w) v, range(1, 6) r(k)
), l AS (SELECT * FROM lines WHERE tolerance = 0), t AS (
  SELECT l.page_key, l.line_id AS label_id, n, x * greatest(16.0, (x1 - x0) * 0.58) AS dx, y * greatest(14.0, (y1 - y0) + 6.0) AS dy, x0, y0, x1, y1 FROM l, o
), c AS (
  SELECT t.page_key, label_id, n, dx, dy, count(b.page_key) AS collisions FROM t LEFT JOIN lines b ON b.page_key = t.page_key AND b.tolerance > 0
    AND least(t.x1 + dx, b.x1) > greatest(t.x0 + dx, b.x0) AND least(t.y1 + dy, b.y1) > greatest(t.y0 + dy, b.y0)
  WHERE t.x0 + dx >= 3 AND t.y0 + dy >= 3 AND t.x1 + dx <= {WIDTH} - 3 AND t.y1 + dy <= {HEIGHT} - 3 GROUP BY ALL
)
SELECT page_key, label_id, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, collisions FROM c
QUALIFY row_number() OVER (PARTITION BY page_key, label_id ORDER BY CASE WHEN collisions = 0 THEN 0 ELSE 1 END, CASE WHEN collisions = 0 THEN 0 ELSE sqrt(dx * dx + dy * dy) + collisions * 10000 END, n) = 1
""")
def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    return layout.place_labels(t.where("tolerance = 0").withColumnRenamed("line_id", "label_id"), t.where("tolerance > 0"), WIDTH, HEIGHT)


@_query(f"""
WITH {LINES_SQL}, s AS (SELECT *, CASE WHEN tolerance BETWEEN 1 AND 4 THEN '#ff33cc' ELSE '#ffff00' END AS color, x0 - 30 AS a0, x1 + CASE WHEN tolerance BETWEEN 1 AND 4 THEN 0 ELSE 60 END AS a1 FROM lines)
SELECT l.page_key, l.line_id, CASE WHEN l.color = '#ff33cc' AND EXISTS (SELECT 1 FROM s o WHERE o.page_key = l.page_key AND o.color = '#ffff00' AND o.a1 - o.x0 >= greatest(18.0, (l.a1 - l.x0) * 1.2) AND l.a1 - l.x0 <= 36
  AND greatest(0, greatest(l.x0, o.x0) - least(l.a1, o.a1)) <= 6 AND least(l.y1, o.y1) - greatest(l.y0, o.y0) >= 0.65 * least(l.y1 - l.y0, o.y1 - o.y0)) THEN '#ffff00' ELSE l.color END AS color FROM s l
""")
def absorbed_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pink = F.col("tolerance").between(1, 4)
    t = lines(spark, sf_dir).withColumn("color", F.when(pink, tol.PINK).otherwise(tol.YELLOW)).withColumn("x1", F.col("x1") + F.when(pink, 0).otherwise(60))
    return layout.absorb(t, tol.PINK, tol.YELLOW).select("page_key", "line_id", "color")


@_query(f"""
WITH {LINES_SQL}, t AS (SELECT l.page_key, l.line_id FROM lines l WHERE tolerance = 0 AND EXISTS (SELECT 1 FROM lines o WHERE o.page_key = l.page_key AND o.tolerance > 0 AND o.score >= 0.9 AND {_IOS} >= 0.45)),
n AS (SELECT page_key, count(*) AS n FROM t GROUP BY 1), c AS (SELECT page_key, count(*) AS n_candidates FROM lines WHERE tolerance = 0 GROUP BY 1)
SELECT c.page_key, n_candidates, coalesce(n.n, 0) AS n_trusted, n_candidates >= 4 AND coalesce(n.n, 0) >= 3 AS complete FROM c LEFT JOIN n ON n.page_key = c.page_key
""")
def evidence_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    return spatial.evidence_complete(t.where("tolerance = 0"), t.where("tolerance > 0"))


@_query(f"""
WITH {LINES_SQL}, p AS (SELECT event_id AS point_id, user_id AS page_key, CAST(event_id % 500 AS DOUBLE) AS px, CAST(event_id % 300 AS DOUBLE) AS py FROM events),
d AS (SELECT point_id, l.page_key, line_id, text, (x1 - x0) * (y1 - y0) AS area, sqrt(greatest(x0 - px, px - x1, 0.0) ^ 2 + greatest(y0 - py, py - y1, 0.0) ^ 2) AS far FROM p JOIN lines l ON l.page_key = p.page_key)
SELECT point_id, page_key, line_id, text, far AS distance FROM d WHERE far <= 5 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY far, area, line_id) = 1
""")
def text_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    points = read(spark, sf_dir, "events").select(i.alias("point_id"), F.col("user_id").alias("page_key"), (i % 500).cast("double").alias("px"), (i % 300).cast("double").alias("py"))
    return spatial.text_at(points, lines(spark, sf_dir))


@_query(f"""
WITH {LINES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY y0, x0, line_id) - 1 AS ordinal FROM lines WHERE line_id % 3 <> 0)
SELECT page_key, CAST(ordinal AS INTEGER) AS ordinal, line_id, CAST(7 AS INTEGER) AS batch_id, text || '+' AS label FROM c
""")
def batch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of selected candidates, and the labels made for it, put together again by their place."""
    t = lines(spark, sf_dir).withColumn("selected", F.col("line_id") % 3 != 0).withColumn("manual_required", F.lit(False))
    chosen = session.batch(t, 7)
    labels = chosen.select("batch_id", "page_key", "ordinal", F.concat("text", F.lit("+")).alias("label"))
    return chosen.join(labels, ["batch_id", "page_key", "ordinal"]).select("page_key", "ordinal", "line_id", "batch_id", "label")


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, max((x1 - x0) * (y1 - y0) / 300.0) >= 0.72 OR sum((x1 - x0) * (y1 - y0) / 300.0) >= 0.72 AS full FROM lines GROUP BY 1
""")
def full_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL gives its sum no order, and DuckDB takes rows as they stand in the file; so places are theirs in the file."""
    from calibra.sources import readings

    r, place = g.Rect.of(), F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    return readings.full_page_images(lines(spark, sf_dir, place).select("page_key", "place", r.area.alias("area"), F.lit(300.0).alias("page_area")))


@_query(f"""
WITH {LINES_SQL}, a AS (SELECT DISTINCT prefix, nominal FROM lines WHERE tolerance = 0)
SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.prefix = l.prefix AND a.nominal = l.nominal)) AS matched FROM lines l WHERE tolerance > 0
""")
def benchmark_value_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many coloured readings have a candidate of the same kind and value."""
    t = lines(spark, sf_dir)
    own = t.where("tolerance = 0").select("prefix", "nominal").distinct().withColumn("hit", F.lit(1))
    return t.where("tolerance > 0").join(own, ["prefix", "nominal"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("matched"))


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id, x0 - 0.4 AS left, x1 + 10.4 AS right, y0 AS top, y1 AS bottom FROM lines
""")
def marking_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips extended over a neighbour; the oracle knows that all of them are horizontal."""
    t = lines(spark, sf_dir)
    corner = lambda dx: F.array(*[F.struct((F.col(x) + dx).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    box = g.bounds(g.extended(corner(0.0), corner(10.0), F.lit(1.0), F.lit(0.0), 0.4))
    return t.select("page_key", "line_id", box.alias("b")).select("page_key", "line_id", F.col("b.x0").alias("left"), F.col("b.x1").alias("right"), F.col("b.y0").alias("top"), F.col("b.y1").alias("bottom"))


@_query(f"""
WITH {LINES_SQL}, t AS (SELECT page_key, line_id, x0, y0, x0 + 8 AS x1, y0 + 40 AS y1, CASE WHEN line_id % 2 = 1 THEN 'φ' || CAST(CAST(nominal AS INTEGER) AS VARCHAR) || '96' ELSE '(-0.00' || CAST(line_id % 9 AS VARCHAR) || ')' END AS text, nominal FROM lines)
SELECT page_key, line_id, CASE WHEN line_id % 2 = 1 AND EXISTS (SELECT 1 FROM t o WHERE o.page_key = l.page_key AND o.line_id % 2 = 0 AND least(l.y1, o.y1) - greatest(l.y0, o.y0) > -4 AND o.x0 - l.x1 BETWEEN -4 AND 34) THEN 'φ' || CAST(CAST(nominal AS INTEGER) AS VARCHAR) || 'G6' END AS fit FROM t l
""")
def recovered_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("line_id") % 2 == 1
    text = F.when(odd, F.concat(F.lit("φ"), F.col("nominal").cast("int").cast("string"), F.lit("96"))).otherwise(F.concat(F.lit("(-0.00"), (F.col("line_id") % 9).cast("string"), F.lit(")")))
    t = lines(spark, sf_dir).select("page_key", "line_id", text.alias("text"), "x0", "y0", (F.col("x0") + 8).alias("x1"), (F.col("y0") + 40).alias("y1"))
    return spatial.recovered_fits(t).select("page_key", "line_id", "fit")


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id FROM lines WHERE (prefix = '' AND nominal < 100 AND x0 > 0.84 * {WIDTH} AND y1 < 0.30 * {HEIGHT}) OR (prefix = '' AND nominal = 60 AND y1 < 0.28 * {HEIGHT} AND x0 > 0.72 * {WIDTH})
   OR (line_id % 2 = 0 AND prefix = 'φ' AND y1 < 0.14 * {HEIGHT} AND x0 > 0.62 * {WIDTH})
""")
def special_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    zone = predicates.special_zone(tx.kind(F.col("prefix"), F.lit("")), F.col("prefix") == "", F.col("nominal"), g.Rect.of(), F.lit(WIDTH), F.lit(HEIGHT), F.col("line_id") % 2 == 0)
    return t.where(zone).select("page_key", "line_id")


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id, CAST(CASE WHEN tolerance > 0 THEN 5 ELSE 0 END + CASE WHEN prefix = 'φ' THEN 2 ELSE 0 END + length(CAST(CAST(nominal AS INTEGER) AS VARCHAR)) AS INTEGER) AS quality, CAST(length(text) AS INTEGER) AS length, round(score + 0.04, 6) AS score FROM lines
""")
def marking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = predicates.marking_quality(F.col("text"), F.col("score"), F.lit(0.5))
    return lines(spark, sf_dir).select("page_key", "line_id", q.alias("q")).select("page_key", "line_id", "q.quality", "q.length", F.round("q.score", 6).alias("score"))


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id FROM lines WHERE NOT ((line_id % 3 <> 0 AND y1 < 0.08 * {HEIGHT}) OR y0 > CASE WHEN prefix <> '' THEN 0.93 ELSE 0.86 END * {HEIGHT} OR x1 - x0 > 85 OR y1 - y0 > 85
  OR (x1 < 0.22 * {WIDTH} AND y1 < 0.32 * {HEIGHT} AND line_id % 2 = 0))
""")
def margin_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predicates.off_limits(g.Rect.of(), F.col("prefix") != "", F.col("line_id") % 3 == 0, F.col("line_id") % 2 == 1, F.lit(WIDTH), F.lit(HEIGHT))
    return lines(spark, sf_dir).where(~out).select("page_key", "line_id")


@_query(f"""
WITH {LINES_SQL}
SELECT o_orderkey AS page_key, w.page_key IS NULL AS needs_recognition, o_orderkey % 50 = 0 OR (w.page_key IS NULL AND i.page_key IS NOT NULL) AS scanned
FROM orders LEFT JOIN (SELECT DISTINCT page_key FROM lines WHERE tolerance > 5) w ON w.page_key = o_orderkey LEFT JOIN (SELECT DISTINCT page_key FROM lines WHERE nominal > 25) i ON i.page_key = o_orderkey
""")
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    pages = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_key"), (F.col("o_orderkey") % 50 == 0).alias("full_page_image"))
    return predicates.page_routes(pages, t.where("tolerance > 5"), t.where("nominal > 25"))


@_query(f"WITH {LINES_SQL} SELECT page_key, line_id FROM lines QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY CASE WHEN prefix IN ('R', 'C') THEN 0 ELSE 1 END, CASE WHEN nominal < 10 THEN 0 ELSE 1 END, y0, x0, line_id) <= 4")
def regions_read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir).withColumn("focus", F.col("prefix").isin("R", "C")).withColumn("small", F.col("nominal") < 10)
    return spatial.first_regions(t).select("page_key", "line_id")


@_query(f"WITH {LINES_SQL} SELECT page_key, line_id FROM lines WHERE line_id <= 3")
def bounded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three segments of a page, as the first 700 are taken of a real one."""
    return spatial.first_segments(lines(spark, sf_dir), 3).select("page_key", "line_id")


@_query("""
SELECT count(*) AS candidate_count, count(*) FILTER (event_id % 3 = 0) AS selected_count, count(*) FILTER (user_id % 5 = 2 AND event_id % 4 = 0) AS added_count,
       count(*) FILTER (user_id % 5 = 2 AND event_id % 4 = 1) AS replacement_count, count(*) FILTER (user_id % 5 = 2 AND event_id % 4 = 2) AS struck_count FROM events
""")
def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    kind = F.get(F.array(*map(F.lit, ("dimension", "replacement", "strike", "note"))), (F.col("event_id") % 4).cast("int"))
    return session.state(events.select((F.col("user_id") % 5).alias("page"), kind.alias("kind")), events.select((F.col("event_id") % 3 == 0).alias("selected")), F.lit(2))


@_query()
def reading_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.by_page(lines(spark, sf_dir).select("page_key", "line_id", "text", "score", "x0", "y0", "x1", "y1", F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1).alias("agreement"), F.lit("").alias("kind"), "nominal"), consensus.clusters)


@_query("""
SELECT o_orderkey AS page_key, CASE o_orderkey % 4 WHEN 0 THEN n * 1.0 WHEN 1 THEN n / 60.0 END AS angle_value, CASE o_orderkey % 4 WHEN 0 THEN '±' || n || '°' WHEN 1 THEN '±' || n || '′' END AS angle_text,
       CASE WHEN o_orderkey % 4 = 2 THEN n / 10.0 END AS chamfer_tolerance, CASE WHEN o_orderkey % 4 = 2 THEN n / 10.0 END AS radius_tolerance,
       CASE WHEN o_orderkey % 4 = 3 THEN n / 10.0 END AS unindicated_chamfer_maximum, CASE WHEN o_orderkey % 4 = 3 THEN n / 10.0 END AS unindicated_radius_maximum
FROM (SELECT o_orderkey, o_custkey % 9 + 1 AS n FROM orders)
""")
def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of four kinds of pages, read from their text."""
    n = F.col("o_custkey") % 9 + 1
    tenth = F.concat(F.lit("0."), n.cast("string"))
    kinds = [
        F.concat(F.lit("図面\n指示無き角度公差は ± "), n.cast("string"), F.lit("°とする")), F.concat(F.lit("角度公差 ±"), n.cast("string"), F.lit("分")),
        F.concat(F.lit("指示なき C / R 公差は±"), tenth), F.concat(F.lit("指示無き角部はC"), tenth, F.lit("以下\n指示無き隅はR"), tenth, F.lit("以内とする")),
    ]
    pages = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_key"), F.get(F.array(*kinds), (F.col("o_orderkey") % 4).cast("int")).alias("text"))
    return pages.select("page_key", tx.notes(F.col("text")).alias("n")).select("page_key", "n.*")


@_query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 5.0 ELSE greatest(least(event_id % 40, 30.0), 2.0) END AS size, CASE WHEN event_id % 4 = 0 THEN '#ff00a0' ELSE '#000000' END AS color,
       CASE WHEN event_id % 4 = 0 THEN [1.0, 0.0, 160 / 255.0] ELSE [0.0, 0.0, 0.0] END AS rgb FROM events
""")
def clamped_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    size, color = F.when(i % 3 == 0, "wide").otherwise((i % 40).cast("string")), tx.color(F.when(i % 4 == 0, "#FF00A0").otherwise("red"), "#000000")
    return read(spark, sf_dir, "events").select("event_id", tx.clamped(size, 5.0, 2.0, 30.0).alias("size"), color.alias("color"), tx.rgb(color).alias("rgb"))


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id, y0 AS left_x, {HEIGHT}::DOUBLE - x0 AS left_y, {WIDTH}::DOUBLE - y0 AS right_x, x0 AS right_y, line_id % 3 = 0 OR 8 / (x1 - x0) >= 1.6 AS down, round((x1 - x0) * 8, 6) AS area,
       round(CASE WHEN 250 BETWEEN x0 AND x1 THEN abs(y0 - 100) ELSE sqrt(least((x0 - 250) ^ 2, (x1 - 250) ^ 2) + (y0 - 100) ^ 2) END, 6) AS far, 1.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, greatest(x0 - 260, 240 - x1, 0) AS gap
FROM lines
""")
def reading_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where readings stand on a turned page, which way they run, and how far they are from a point; the oracle knows that they are rectangles."""
    t, (x0, y0, x1, y1) = lines(spark, sf_dir), g.Rect.of()
    quad = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    left, right, way = g.rotated(x0, y0, 90, WIDTH, HEIGHT), g.rotated(x0, y0, 270, WIDTH, HEIGHT), g.direction(quad)
    return t.select(
        "page_key", "line_id", left[0].alias("left_x"), left[1].alias("left_y"), right[0].alias("right_x"), right[1].alias("right_y"),
        g.columnar(g.Rect.of(), F.when(F.col("line_id") % 3 == 0, 1.0).otherwise(0.0)).alias("down"), F.round(g.polygon_area(quad), 6).alias("area"),
        F.round(g.point_segment_distance(F.lit(250.0), F.lit(100.0), x0, y0, x1, y0), 6).alias("far"), way.dx.alias("dx"), way.dy.alias("dy"), g.gap(g.axis_bounds(quad, F.lit(1.0), F.lit(0.0)), (F.lit(240.0), F.lit(260.0))).alias("gap"),
    )


@_query(f"""
WITH {LINES_SQL}, f AS (SELECT page_key, x0 - 20.25 AS x0, y0 - 20.25 AS y0, x1 + 20.25 AS x1, y1 + 20.25 AS y1 FROM lines WHERE nominal > 45), m AS (SELECT page_key, line_id, x0, y0, x1, y1, unnest([[x0, y0], [x1, y0], [x0, y1], [x1, y1], [(x0 + x1) / 2, (y0 + y1) / 2]]) AS p FROM lines WHERE tolerance > 0)
SELECT DISTINCT m.page_key, m.line_id FROM m JOIN f ON f.page_key = m.page_key WHERE p[1] > f.x0 AND p[1] < f.x1 AND p[2] > f.y0 AND p[2] < f.y1
""")
def marks_over_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toleranced readings that touch a filled polygon; the oracle knows that the polygons are rectangles larger than any reading."""
    t, by = lines(spark, sf_dir), 20.25
    corners = F.array(*[F.struct((F.col(x) + (by if x == "x1" else -by)).alias("x"), (F.col(y) + (by if y == "y1" else -by)).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    return spatial.over_fills(t.where("tolerance > 0"), t.where("nominal > 45").select("page_key", corners.alias("points"))).select("page_key", "line_id")


@_query(f"""
WITH {LINES_SQL}
SELECT page_key, line_id, CASE WHEN line_id % 2 = 0 THEN x0 > 0.62 * {WIDTH} AND y0 > 0.68 * {HEIGHT} ELSE x0 > 0.64 * {WIDTH} AND y0 > 0.78 * {HEIGHT} END AS title,
       prefix = '' AND nominal < 4 AS view, nominal / 30 >= CASE WHEN line_id % 3 = 0 THEN 0.56 ELSE 0.82 END AND nominal / 30 <= 1.23 AS size_fits, line_id % 4 = 0 AS thread, line_id % 4 = 1 AS limit_callout, line_id % 4 = 2 AS rough FROM lines
""")
def reading_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title blocks, view labels, sizes of text, threads, limits and roughness."""
    t, k, n = lines(spark, sf_dir), F.col("line_id") % 4, F.col("nominal").cast("int").cast("string")
    text = F.when(k == 0, F.concat(F.lit("M"), n, F.lit("x1"))).when(k == 1, F.concat(F.lit("C0."), n, F.lit("以下"))).when(k == 2, F.concat(F.lit("Ra"), n, F.lit(".3"))).otherwise(n)
    return t.select(
        "page_key", "line_id", predicates.in_title_block(g.Rect.of(), F.lit(WIDTH), F.lit(HEIGHT), F.col("line_id") % 2 == 0).alias("title"), predicates.view_label(F.col("prefix"), F.lit(""), F.col("nominal")).alias("view"),
        predicates.text_size_fits(F.col("nominal"), F.lit(30.0), True, F.col("line_id") % 3 == 0, F.lit(True)).alias("size_fits"),
        predicates.thread(text).alias("thread"), predicates.limit_callout(text).alias("limit_callout"), predicates.roughness(text).alias("rough"),
    )


@_query(f"""
WITH {LINES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY line_id % 2, y0, x0, text, score) AS place FROM lines WHERE line_id % 5 <> 0 AND score >= CASE line_id % 2 WHEN 0 THEN {predicates.FLOORS["agreed"]} ELSE {predicates.FLOORS["bare"]} END)
SELECT page_key, CAST(place AS INTEGER) AS line_id, text, CAST(line_id % 2 AS INTEGER) AS source_rank, x0, y1 FROM k
""")
def readings_of_two_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of two passes with floors of their own, without empty texts, numbered over a page."""
    x0, y0, x1, y1 = g.Rect.of()
    quad = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    t = lines(spark, sf_dir).select("page_key", F.col("line_id").alias("box"), F.when(F.col("line_id") % 5 == 0, " ").otherwise(F.col("text")).alias("text"), "score", quad.alias("quad"))
    passes = [readings.from_quads(t.where(F.col("box") % 2 == k), predicates.FLOORS[floor]) for k, floor in enumerate(("agreed", "bare"))]
    return readings.numbered(readings.together(*passes)).select("page_key", "line_id", "text", "source_rank", "x0", "y1")


@_query(f"""
WITH p AS (SELECT o_orderkey AS page_key, CAST(100 + o_custkey % 150 AS DOUBLE) AS tile FROM orders), n AS (
  SELECT *, greatest(1, CAST(ceil(({WIDTH} * 0.95 - {WIDTH} * 0.03 - tile) / (tile * 0.82)) AS INTEGER) + 1) AS nx, greatest(1, CAST(ceil(({HEIGHT} * 0.93 - {HEIGHT} * 0.08 - tile) / (tile * 0.82)) AS INTEGER) + 1) AS ny FROM p)
SELECT page_key, CAST(nx * ny AS BIGINT) AS tiles FROM n
""")
def page_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tiles cover a page, by the size of a tile; each size's tiles are laid at once."""
    pages = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_key"), (100 + F.col("o_custkey") % 150).cast("double").alias("tile"), F.lit(WIDTH).alias("page_w"), F.lit(HEIGHT).alias("page_h"))
    return readings.tiles(pages, F.col("tile")).groupBy("page_key").agg(F.count("*").alias("tiles"))


@_query("""
WITH t AS (SELECT event_id, ['stamp', 'dimension', 'replacement', 'replacement_tolerance', 'note', 'tolerance', 'other'][event_id % 7 + 1] AS kind, CAST(event_id % 50 AS DOUBLE) AS size, event_id % 5 / 2.0 AS x, event_id % 3 * 1.5 AS y FROM events)
SELECT event_id, CASE kind WHEN 'stamp' THEN greatest(24.0, least(180.0, size * greatest(x, y))) WHEN 'dimension' THEN greatest(5.0, least(36.0, size * greatest(x, y))) WHEN 'replacement' THEN greatest(5.0, least(36.0, size * greatest(x, y)))
       WHEN 'replacement_tolerance' THEN greatest(4.0, least(36.0, size * greatest(x, y))) WHEN 'note' THEN greatest(6.0, least(24.0, size * greatest(x, y))) WHEN 'tolerance' THEN greatest(4.0, least(24.0, size * least(x, y))) END::DOUBLE AS size FROM t
""")
def resized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, (*session.SIZES, "other"))), (i % 7).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", session.resized(kind, (i % 50).cast("double"), i % 5 / 2.0, i % 3 * 1.5).alias("size"))


def _clicks(spark: SparkSession, sf_dir: str, pad: float) -> DataFrame:
    """Clicks of the event table with the readings whose padded rectangle holds them."""
    i = F.col("event_id")
    clicks = read(spark, sf_dir, "events").select(i, F.col("user_id").alias("page"), (i % 500).cast("double").alias("px"), (i % 300).cast("double").alias("py"))
    return clicks.join(lines(spark, sf_dir), (F.col("page") == F.col("page_key")) & g.Rect.of().grown(pad).holds(F.col("px"), F.col("py")))


_CLICKS_SQL = f"{LINES_SQL.strip()}, t AS (SELECT user_id, event_id, CAST(event_id % 500 AS DOUBLE) AS px, CAST(event_id % 300 AS DOUBLE) AS py FROM events)"


@_query(f"WITH {_CLICKS_SQL} SELECT page_key, line_id, count(*) % 2 = 1 AS selected, count(*) AS n FROM t JOIN lines l ON l.page_key = t.user_id AND px BETWEEN l.x0 - 8 AND l.x1 + 8 AND py BETWEEN l.y0 - 8 AND l.y1 + 8 GROUP BY ALL")
def band_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click toggles all bands that it hits."""
    return _clicks(spark, sf_dir, 8.0).groupBy("page_key", "line_id").agg((F.count("*") % 2 == 1).alias("selected"), F.count("*").alias("n"))


@_query(f"WITH {_CLICKS_SQL} SELECT t.event_id, l.page_key, l.line_id FROM t JOIN lines l ON l.page_key = t.user_id AND px BETWEEN l.x0 - 6 AND l.x1 + 6 AND py BETWEEN l.y0 - 6 AND l.y1 + 6 QUALIFY row_number() OVER (PARTITION BY t.event_id ORDER BY l.line_id DESC) = 1")
def newest_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click hits the newest of the applied items."""
    return spatial.first_of(_clicks(spark, sf_dir, 6.0), [F.col("event_id")], [-F.col("line_id")]).select("event_id", "page_key", "line_id")


@_query(f"""
WITH {LINES_SQL}, s AS (SELECT page_key, prefix AS font, round(nominal / 10) AS size, line_id, x0, y0, x1, y1 FROM lines), c AS (SELECT page_key, font, size, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT page_key, font, size FROM c QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY n DESC, CASE WHEN font = 'φ' THEN 0 ELSE 1 END, size DESC, font DESC) = 1)
SELECT s.page_key, s.line_id FROM s JOIN m ON m.page_key = s.page_key AND m.font = s.font AND m.size = s.size QUALIFY row_number() OVER (PARTITION BY s.page_key ORDER BY sqrt(((x0 + x1) / 2 - 200) ^ 2 + ((y0 + y1) / 2 - 150) ^ 2), s.line_id) = 1
""")
def nearest_in_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lines(spark, sf_dir).select("page_key", F.col("prefix").alias("font"), F.round(F.col("nominal") / 10).alias("size"), "line_id", "x0", "y0", "x1", "y1")
    styles = evaluate.modal_style(spans, "page_key", F.col("font") == "φ")
    return evaluate.nearest_span(spans, styles, "page_key", F.lit(200.0), F.lit(150.0))


@_query("""
WITH f AS (SELECT o_custkey % 9 AS pages, CASE WHEN o_orderkey % 3 = 0 THEN [] WHEN o_orderkey % 3 = 1 THEN ['stamp'] ELSE ['stamp', 'ink'] END AS types FROM orders)
SELECT type, count(*) AS n, any_value(a) AS annotated_ratio, any_value(m) AS median_pages FROM (SELECT unnest(types) AS type FROM f), (SELECT avg(CAST(len(types) > 0 AS DOUBLE)) AS a, CAST(median(pages) AS DOUBLE) AS m FROM f) GROUP BY type
""")
def annotation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    types = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("stamp"))).otherwise(F.array(F.lit("stamp"), F.lit("ink")))
    return evaluate.annotations(read(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).alias("pages"), types.alias("types")))


@_query("""
SELECT 'f' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '.doc' ELSE '.PDF' END AS path,
       CASE WHEN o_orderkey % 5 = 0 THEN 'not a pdf' WHEN o_orderkey % 7 = 0 THEN 'empty' WHEN o_orderkey % 11 = 0 THEN 'too large' WHEN o_orderkey % 13 = 0 THEN 'locked' ELSE 'without pages' END AS reason
FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0
""")
def bad_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    length = F.when(k % 7 == 0, 0).when(k % 11 == 0, 300 << 20).otherwise(1000)
    found = read(spark, sf_dir, "orders").select(F.concat(F.lit("f"), k.cast("string"), F.when(k % 5 == 0, ".doc").otherwise(".PDF")).alias("path"), length.alias("length"), (k % 13 == 0).alias("locked"), F.when(k % 17 == 0, 0).otherwise(3).alias("pages"))
    return readings.bad_inputs(found)


@_query("SELECT lower('F' || p_partkey) AS name, '/in/f' || p_partkey || '.pdf' AS path, CAST(p_size AS INTEGER) AS value FROM part WHERE p_partkey % 2 = 0")
def truth_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, name = read(spark, sf_dir, "part"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    found = part.where("p_partkey % 2 = 0").select(F.explode(F.array(F.concat(F.lit("/in/"), name, F.lit(".pdf")), F.concat(F.lit("/late/"), F.upper(name), F.lit(".PDF")))).alias("path"))
    return readings.truth_of(found, part.select(name.alias("name"), F.col("p_size").cast("int").alias("value")))
