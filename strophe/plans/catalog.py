"""The query catalogue: operators applied to whole tables by role mapping, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions import scalars, text
from strophe.operators import matching, resolve, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EPOCH = "2024-01-01 00:00:00"
SEC_SQL = f"(date_diff('microsecond', TIMESTAMP '{EPOCH}', ts) / 1e6)"
#: Events are days apart, not syllables: a hold of four hours plays the part of two seconds.
HOLD = 14400.0


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timed units: song = user, ordered by (ts, event_id), start in seconds."""
    e = table(spark, sf_dir, "events")
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', ts)")
    return e.select(F.col("user_id").alias("song_id"), "event_id", (micros / F.lit(1e6)).alias("start"), F.col("event_type").alias("unit"), "value", micros.alias("us"))


UNITS_SQL = f"WITH u AS (SELECT user_id AS song_id, event_id, {SEC_SQL} AS start, event_type AS unit, value, date_diff('microsecond', TIMESTAMP '{EPOCH}', ts) AS us FROM events)"
MS = "round_even(({0}) * 1000, 0) / 1000"


@query(f"""{UNITS_SQL}, n AS (SELECT *, lead(start) OVER (PARTITION BY song_id ORDER BY us, event_id) AS nxt FROM u)
SELECT song_id, event_id, start, {MS.format(f"greatest(least(coalesce(nxt, start + 0.4), start + {HOLD}), start + 0.02)")} AS "end" FROM n""")
def q_durations(spark, sf_dir):
    return timeline.derive_durations(units(spark, sf_dir), ["song_id"], ["us", "event_id"], HOLD).select("song_id", "event_id", "start", "end")


@query(f"""WITH u AS (SELECT user_id AS song_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE {SEC_SQL} END AS start, date_diff('microsecond', TIMESTAMP '{EPOCH}', ts) AS us FROM events),
n AS (SELECT *, first_value(start IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM u)
SELECT song_id, event_id, start, CASE WHEN start IS NOT NULL THEN {MS.format(f"greatest(least(coalesce(nxt, start + 0.4), start + {HOLD}), start + 0.02)")} END AS "end" FROM n""")
def q_durations_unplaced(spark, sf_dir):
    u = units(spark, sf_dir).withColumn("start", F.when(F.col("unit") != "error", F.col("start")))
    return timeline.derive_durations(u, ["song_id"], ["us", "event_id"], HOLD).select("song_id", "event_id", "start", "end")


TAIL_SQL = f"""{UNITS_SQL}, n AS (SELECT *, lead(start) OVER (PARTITION BY song_id ORDER BY us, event_id) AS nxt, start - lag(start) OVER (PARTITION BY song_id ORDER BY us, event_id) AS gap FROM u),
d AS (SELECT song_id, event_id, us, start, nxt IS NULL AS last, {MS.format("greatest(least(coalesce(nxt, start + 9000), start + " + str(HOLD) + "), start + 0.02)")} AS e FROM n),
g AS (SELECT song_id, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps FROM n GROUP BY song_id),
c AS (SELECT d.*, {MS.format(f"start + greatest(0.35, least({HOLD}, gaps[len(gaps) // 2 + 1] * 0.05))")} AS capped, len(gaps) AS n FROM d JOIN g USING (song_id))"""


@query(TAIL_SQL + """ SELECT song_id, event_id, start, CASE WHEN last AND n > 0 AND capped < e - 1e-6 THEN capped ELSE e END AS "end", coalesce(last AND n > 0 AND capped < e - 1e-6, false) AS trimmed FROM c""")
def q_tail_median(spark, sf_dir):
    d = timeline.derive_durations(units(spark, sf_dir), ["song_id"], ["us", "event_id"], HOLD, tail=9000.0)
    return timeline.trim_line_tails(d, ["song_id"], ["us", "event_id"], HOLD, factor=0.05).select("song_id", "event_id", "start", "end", "trimmed")


@query("""WITH u AS (SELECT user_id AS song_id, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) AS frame FROM events),
s AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY song_id ORDER BY frame) > 43200 THEN 1 ELSE 0 END AS step FROM u),
r AS (SELECT *, sum(step) OVER (PARTITION BY song_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT song_id, min(frame) AS "first", max(frame) AS "last", count(*) AS support FROM r GROUP BY song_id, run HAVING max(frame) - min(frame) >= 3600 AND count(*) >= 3""")
def q_islands(spark, sf_dir):
    u = units(spark, sf_dir).select("song_id", F.expr("us div 1000000").alias("frame"))
    return timeline.islands(u, ["song_id"], "frame", 43200, 3600, 3, 1, 1.0)


@query(f"""{UNITS_SQL}, n AS (SELECT *, row_number() OVER w - 1 AS i, start - lag(start) OVER w AS gap, count(*) OVER (PARTITION BY song_id) AS n FROM u WINDOW w AS (PARTITION BY song_id ORDER BY us, event_id)),
m AS (SELECT song_id, list_sort(list(gap) FILTER (WHERE gap <= 43200)) AS g FROM n GROUP BY song_id),
a AS (SELECT n.*, coalesce(g[len(g) // 2 + 1], 0.2) AS med, min(CASE WHEN n >= 3 AND i >= greatest(1, n - greatest(2, floor(n * 0.3))) AND gap > 43200 THEN i END) OVER (PARTITION BY song_id) AS pos FROM n JOIN m USING (song_id)),
b AS (SELECT *, max(CASE WHEN i = pos - 1 THEN start END) OVER (PARTITION BY song_id) AS anchor FROM a)
SELECT song_id, event_id, CASE WHEN i >= pos THEN {MS.format("anchor + med * (i - pos + 1)")} ELSE start END AS start, coalesce(i >= pos, false) AS smear_fixed FROM b""")
def q_smear(spark, sf_dir):
    return timeline.fix_tail_smear(units(spark, sf_dir), ["song_id"], ["us", "event_id"], 43200.0).select("song_id", "event_id", "start", "smear_fixed")


PEAKS_SQL = "WITH p AS (SELECT DISTINCT user_id % 10 AS song_id, CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) // 60 AS INT) AS t, CAST(floor(value * 10) AS INT) % 513 AS f FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as peaks: frame = minute, frequency from the value."""
    e = units(spark, sf_dir)
    return e.select((F.col("song_id") % 10).alias("song_id"), F.expr("cast(us div 60000000 as int)").alias("t"), (F.floor(F.col("value") * 10).cast("int") % 513).alias("f")).distinct()


FAN_SQL = """, x AS (SELECT a.song_id, a.t AS t1, a.f AS f1, b.t AS t2, b.f AS f2, row_number() OVER (PARTITION BY a.song_id, a.t, a.f ORDER BY b.t, b.f) AS k
FROM p a JOIN p b ON a.song_id = b.song_id AND b.t - a.t BETWEEN 2 AND 80 AND abs(b.f - a.f) <= 96),
h AS (SELECT song_id, CAST(((f1 & 511) << 16) | ((f2 & 511) << 7) | ((t2 - t1) & 127) AS INT) AS hash, t1, f1, t2, f2 FROM x WHERE k <= 12)"""


@query(PEAKS_SQL + FAN_SQL + " SELECT * FROM h")
def q_fanout_hash(spark, sf_dir):
    return matching.fan_out(points(spark, sf_dir), ["song_id"])


@query(PEAKS_SQL + FAN_SQL + """, v AS (SELECT song_id, ((f1 // 64) << 8) | ((f2 // 64) << 4) | ((t2 - t1) // 8) AS hash, t1 FROM h),
r AS (SELECT * FROM v WHERE t1 % 2 = 0), e AS (SELECT * FROM v WHERE t1 % 2 = 1),
ok AS (SELECT song_id, hash FROM (SELECT song_id, hash, count(*) AS n FROM r GROUP BY ALL) JOIN (SELECT song_id, hash, count(*) AS m FROM e GROUP BY ALL) USING (song_id, hash) WHERE n * m <= 64)
SELECT r.song_id, e.t1 - r.t1 AS delta, count(*) AS support FROM r JOIN ok USING (song_id, hash) JOIN e USING (song_id, hash) GROUP BY ALL""")
def q_hash_join_offsets(spark, sf_dir):
    h = matching.fan_out(points(spark, sf_dir), ["song_id"])
    coarse = F.expr("shiftleft(f1 div 64, 8) | shiftleft(f2 div 64, 4) | ((t2 - t1) div 8)").cast("int")
    h = h.select("song_id", coarse.alias("hash"), "t1")
    got = matching.match_hashes(h.where("t1 % 2 = 0"), h.where("t1 % 2 = 1"), ["song_id"])
    return matching.offset_histogram(got, ["song_id"])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as splice segments of a customer segment: a span of days from each customer's order to the next."""
    o = table(spark, sf_dir, "orders")
    day = F.expr("cast(datediff(cast(o_orderdate as date), date'1992-01-01') as double)")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    n = F.lead(day).over(w)
    return o.select(F.col("o_custkey").alias("song_id"), (F.row_number().over(w) - 1).alias("seg_no"), day.alias("ref_start"), F.coalesce(n, day + 30).alias("ref_end"), F.lit(100.0).alias("offset"), (F.col("o_orderkey") % 400).cast("int").alias("support")).withColumn("ref_end", F.least("ref_end", F.col("ref_start") + 60))


SPANS_SQL = """WITH d AS (SELECT o_custkey AS song_id, o_orderkey, o_orderdate, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day FROM orders),
s AS (SELECT song_id, CAST(row_number() OVER w - 1 AS INT) AS seg_no, day AS ref_start, least(coalesce(lead(day) OVER w, day + 30), day + 60) AS ref_end, 100.0::DOUBLE AS "offset", CAST(o_orderkey % 400 AS INT) AS support FROM d WINDOW w AS (PARTITION BY song_id ORDER BY o_orderdate, o_orderkey))"""


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.expr("cast(datediff(cast(o_orderdate as date), date'1992-01-01') as double)")
    return o.select(F.col("o_custkey").alias("song_id"), "o_orderkey", (day + (F.col("o_orderkey") % 97)).alias("t"))


TIMES_SQL = ", q AS (SELECT song_id, o_orderkey, day + (o_orderkey % 97) AS t FROM d)"


@query(SPANS_SQL + TIMES_SQL + f""", hit AS (SELECT o_orderkey, min(seg_no) AS seg_no FROM q JOIN s ON q.song_id = s.song_id AND q.t BETWEEN s.ref_start AND s.ref_end GROUP BY 1)
SELECT q.song_id, q.o_orderkey, q.t, hit.seg_no, CASE WHEN hit.seg_no IS NOT NULL THEN {MS.format("q.t + 100.0")} END AS mapped FROM q LEFT JOIN hit USING (o_orderkey)""")
def q_point_in_segment(spark, sf_dir):
    return matching.map_times(times(spark, sf_dir), spans(spark, sf_dir), ["song_id"])


@query(SPANS_SQL + TIMES_SQL + f""", near AS (SELECT o_orderkey, q.t, s.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY greatest(s.ref_start - q.t, q.t - s.ref_end, 0), seg_no) AS k FROM q JOIN s USING (song_id))
SELECT song_id, o_orderkey, t, seg_no, {MS.format("least(greatest(t, ref_start), ref_end) + 100.0")} AS mapped FROM near WHERE k = 1""")
def q_nearest_segment(spark, sf_dir):
    return matching.nearest_segment(times(spark, sf_dir), spans(spark, sf_dir), ["song_id"])


@query(SPANS_SQL + """, q AS (SELECT song_id, o_orderkey, day AS start, day + (o_orderkey % 50) AS "end" FROM d),
a AS (SELECT o_orderkey, min(seg_no) AS x FROM q JOIN s ON q.song_id = s.song_id AND q.start BETWEEN s.ref_start AND s.ref_end GROUP BY 1),
b AS (SELECT o_orderkey, min(seg_no) AS y FROM q JOIN s ON q.song_id = s.song_id AND q."end" BETWEEN s.ref_start AND s.ref_end GROUP BY 1)
SELECT q.*, coalesce(x <> y, false) AS spans FROM q LEFT JOIN a USING (o_orderkey) LEFT JOIN b USING (o_orderkey)""")
def q_spans_cut(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.expr("cast(datediff(cast(o_orderdate as date), date'1992-01-01') as double)")
    lines = o.select(F.col("o_custkey").alias("song_id"), "o_orderkey", day.alias("start"), (day + (F.col("o_orderkey") % 50)).alias("end"))
    return matching.spans_cut(lines, spans(spark, sf_dir), ["song_id"])


AUDIT_SQL = """WITH d AS (SELECT o_custkey AS song_id, o_orderkey AS ord, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day FROM orders),
s AS (SELECT song_id, ord, day AS ref_start, day + (ord % 300) AS ref_end, day * 2 AS ep_start, day * 2 + (ord % 290) AS ep_end, day AS "offset", CAST(ord % 400 AS INT) AS support FROM d),
l AS (SELECT *, lag(ref_end) OVER w AS pe, lag(ep_end) OVER w AS pp FROM s WINDOW w AS (PARTITION BY song_id ORDER BY ep_start, ord)),
c AS (SELECT *, coalesce(ref_start < pe - 1e-6, false) AS clip, CASE WHEN coalesce(ref_start < pe - 1e-6, false) THEN round_even(pe * 1000, 0) / 1000 ELSE ref_start END AS r FROM l),
e AS (SELECT *, CASE WHEN clip THEN round_even((r + "offset") * 1000, 0) / 1000 ELSE ep_start END AS p, lag(r) OVER (PARTITION BY song_id ORDER BY ep_start, ord) AS pr FROM c)
SELECT song_id, ord, r AS ref_start, ref_end, p AS ep_start, ep_end, support,
CASE WHEN ref_end <= ref_start OR ep_end <= ep_start THEN 'empty' WHEN ep_start < pp - 1e-6 THEN 'overlap' WHEN ref_start < pr THEN 'reorder' WHEN clip AND (ref_end <= r OR ep_end <= p) THEN 'contained' ELSE 'ok' END AS status,
support > 0 AND support < 200 AS weak FROM e"""


@query(AUDIT_SQL)
def q_overlap_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.expr("cast(datediff(cast(o_orderdate as date), date'1992-01-01') as double)")
    k = F.col("o_orderkey")
    s = o.select(F.col("o_custkey").alias("song_id"), k.alias("ord"), day.alias("ref_start"), (day + k % 300).alias("ref_end"), (day * 2).alias("ep_start"), (day * 2 + k % 290).alias("ep_end"), day.alias("offset"), (k % 400).cast("int").alias("support"))
    return timeline.validate_segments(s, ["song_id"]).drop("offset")


#: A user's hour is a line: its starts in seconds, its span the hour.
LINES_SQL = f"""WITH u AS (SELECT user_id AS song_id, date_diff('microsecond', TIMESTAMP '{EPOCH}', ts) // 86400000000 AS line_no, event_id, date_diff('microsecond', TIMESTAMP '{EPOCH}', ts) AS us, event_type AS unit FROM events),
l AS (SELECT song_id, line_no, event_id, us, unit, us / 1e6 / 3600 AS start, CAST(line_no * 24 + 6 AS DOUBLE) AS line_start, CAST(line_no * 24 + 6 AS DOUBLE) + 0.3 AS line_end FROM u),
i AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY song_id, line_no) AS n, least(greatest(start, line_start), line_end) AS x FROM l WINDOW w AS (PARTITION BY song_id, line_no ORDER BY us, event_id)),
s AS (SELECT *, max(x - i * 0.05) OVER (PARTITION BY song_id, line_no ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) + i * 0.05 AS s FROM i),
f AS (SELECT *, first_value(s) OVER w AS f0, last_value(s) OVER w + 0.05 AS o FROM s WINDOW w AS (PARTITION BY song_id, line_no ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
q AS (SELECT *, CASE WHEN o > line_end AND o - f0 > 0 AND line_end - f0 > 0 THEN f0 + (s - f0) * ((line_end - f0) / (o - f0)) ELSE s END AS spaced FROM f),
t AS (SELECT *, CAST(greatest(round_even((line_end - line_start) * 100, 0), 0) AS BIGINT) AS total FROM q),
w AS (SELECT *, CAST(least(greatest(round_even((spaced - line_start) * 100, 0), 0), total) AS BIGINT) AS want FROM t),
c AS (SELECT *, CASE WHEN total >= n THEN least(max(want - i) OVER (PARTITION BY song_id, line_no ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) + i, total - (n - i)) ELSE CAST(round_even(i * total / n, 0) AS BIGINT) END AS cs FROM w),
k AS (SELECT *, coalesce(lead(cs) OVER (PARTITION BY song_id, line_no ORDER BY us, event_id), total) - cs AS k FROM c)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir).withColumn("line_no", F.expr("us div 86400000000"))
    start = F.col("us") / F.lit(1e6) / 3600
    first = (F.col("line_no") * 24 + 6).cast("double")
    return u.select("song_id", "line_no", "event_id", "us", "unit", start.alias("start"), first.alias("line_start"), (first + 0.3).alias("line_end"))


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, order = ["song_id", "line_no"], ["us", "event_id"]
    return timeline.tile(timeline.space_starts(lines(spark, sf_dir), keys, order), keys, order)


@query(LINES_SQL + " SELECT song_id, line_no, event_id, CAST(cs AS BIGINT) AS cs, CAST(k AS BIGINT) AS k FROM k")
def q_tiling(spark, sf_dir):
    return tiled(spark, sf_dir).select("song_id", "line_no", "event_id", "cs", "k")


@query(LINES_SQL + """, g AS (SELECT song_id, line_no, first(cs ORDER BY us, event_id) AS lead, string_agg('{\\k' || k || '}' || unit, '' ORDER BY us, event_id) AS body FROM k GROUP BY ALL)
SELECT song_id, line_no, CASE WHEN lead > 0 THEN '{\\k' || lead || '}' ELSE '' END || body AS text FROM g""")
def q_karaoke_text(spark, sf_dir):
    return timeline.karaoke_text(tiled(spark, sf_dir), ["song_id", "line_no"], ["us", "event_id"])


@query("""SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n = 1 OR role IS DISTINCT FROM was""")
def q_run_collapse(spark, sf_dir):
    return timeline.collapse_runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "role")


@query("""WITH r AS (SELECT conv_id, turn, role, sum(CASE WHEN role IS DISTINCT FROM was AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS owner FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations))
SELECT conv_id, CAST(owner AS BIGINT) AS owner, min(turn) AS "first", max(turn) AS "last" FROM r GROUP BY ALL""")
def q_word_groups(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    step = F.coalesce((~F.col("role").eqNullSafe(F.lag("role").over(w)) & (F.row_number().over(w) > 1)).cast("int"), F.lit(0))
    c = c.withColumn("step", step).withColumn("owner", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return timeline.word_groups(c, ["conv_id"], "owner", "turn")


@query("""WITH a AS (SELECT label, vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings),
r AS (SELECT *, lag(best) OVER (PARTITION BY label ORDER BY vec_id) AS was, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM a)
SELECT label, vec_id, CAST(best AS INT) AS token FROM r WHERE (n = 1 OR best <> was) AND best <> 0""")
def q_argmax_decode(spark, sf_dir):
    from strophe.operators.acoustic import greedy_decode

    frames = table(spark, sf_dir, "embeddings").select(F.col("label").alias("song_id"), F.col("vec_id").alias("frame"), F.col("embedding").alias("lp"))
    return greedy_decode(frames, ["song_id"]).select(F.col("song_id").alias("label"), F.col("frame").alias("vec_id"), "token")


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS s FROM embeddings), m AS (SELECT vec_id, max(s) AS m FROM x GROUP BY 1),
z AS (SELECT vec_id, i, exp(s - m) AS e FROM x JOIN m USING (vec_id)) SELECT vec_id, CAST(i AS INT) AS i, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM z""")
def q_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    e = e.select("vec_id", F.posexplode(scalars.log_softmax(F.col("s"))).alias("i", "lp"))
    return e.select("vec_id", "i", F.round(F.exp("lp"), 6).alias("p"))


@query("""WITH c AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) * 3 AS score, list_position(embedding, list_max(embedding)) % 4 AS reading FROM embeddings),
p AS (SELECT *, exp(score - max(score) OVER (PARTITION BY label)) AS e FROM c), q AS (SELECT *, e / sum(e) OVER (PARTITION BY label) AS p FROM p)
SELECT label, CAST(reading AS INT) AS reading, round(sum(p), 5) AS share FROM q GROUP BY ALL""")
def q_marginals(spark, sf_dir):
    from strophe.operators.acoustic import marginals, softmax

    e = table(spark, sf_dir, "embeddings")
    c = e.select(F.col("label").alias("song_id"), "vec_id", (F.get("embedding", F.lit(0)).cast("double") * 3).alias("score"), (F.array_position("embedding", F.array_max("embedding")) % 4).cast("int").alias("reading"))
    c = softmax(c, ["song_id"])
    return marginals(c, ["song_id", "reading"]).select(F.col("song_id").alias("label"), "reading", F.round("share", 5).alias("share"))


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS reading, l.doc_id IS NOT NULL AS manual FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_overrides(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.col("source").alias("surface"), F.lit(-1).alias("current"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("line"), F.col("quality").alias("reading"))
    by_line = rows.select("line", "surface").join(lab, "line")
    none = by_line.select("surface", "reading").where(F.lit(False))
    got = resolve.apply_overrides(rows, by_line, none)
    return got.select(F.col("line").alias("doc_id"), F.coalesce("override", "current").alias("reading"), F.col("override").isNotNull().alias("manual"))


@query("""WITH b AS (SELECT doc_id, quality FROM labels), t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS reading FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT t.doc_id, CAST(t.reading AS INT) AS reading FROM t LEFT JOIN b USING (doc_id) WHERE t.reading IS DISTINCT FROM b.quality""")
def q_baseline_diff(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").where("quality is not null")
    base = lab.select(F.col("doc_id").alias("line"), F.lit("s").alias("surface"), F.col("quality").alias("reading"))
    new = table(spark, sf_dir, "documents").join(lab.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("line"), F.lit("").alias("flag"), F.lit("s").alias("surface"), F.lit(9).alias("reading"))
    tab = base.select("line", F.lit("").alias("flag"), "surface", F.expr("if(line % 3 = 0, 1 - reading, reading)").alias("reading")).unionByName(new)
    return resolve.manual_overrides(tab, base)[0].select(F.col("line").alias("doc_id"), "reading")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_cache_miss(spark, sf_dir):
    docs, cache = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return resolve.with_cache(docs, cache, "doc_id")[1]


@query("""SELECT doc_id, quality FROM labels WHERE quality <> 1 UNION ALL SELECT doc_id, quality FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def q_prune_stage(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("string").alias("stage"))
    active = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("key"))
    return resolve.prune_stage(d, active, "1").select(F.col("key").alias("doc_id"), F.col("stage").cast("int").alias("quality"))


THEMES_SQL = """WITH t AS (SELECT p_partkey AS ord, CASE p_type WHEN 'ECONOMY' THEN 'OP' WHEN 'PROMO' THEN 'ED' ELSE '' END AS kind, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS artist, p_type AS source, p_name AS series, CAST(p_size AS VARCHAR) AS sequence FROM part)"""


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "ECONOMY", "OP").when(F.col("p_type") == "PROMO", "ED").otherwise("")
    artist = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), kind.alias("kind"), F.col("p_name").alias("title"), artist.alias("artist"), F.col("p_type").alias("source"), F.col("p_name").alias("series"), F.col("p_size").cast("string").alias("sequence"))


@query(THEMES_SQL + """, k AS (SELECT *, lower(regexp_replace(title, '[^\\w]+', '', 'g')) AS key FROM t),
g AS (SELECT kind, key, arg_min(ord, ord) AS ord, arg_min(title, ord) AS title, arg_min(artist, ord) AS a0, arg_min(source, ord) AS s0, arg_min(artist, ord) FILTER (artist <> '') AS a1, arg_min(source, ord) FILTER (artist <> '') AS s1 FROM k GROUP BY kind, key)
SELECT ord, kind, title, CASE WHEN a0 = '' AND a1 IS NOT NULL THEN a1 ELSE a0 END AS artist, CASE WHEN a0 = '' AND a1 IS NOT NULL THEN s0 || '+' || s1 ELSE s0 END AS source FROM g""")
def q_dedupe_first(spark, sf_dir):
    return resolve.dedupe_first(themes(spark, sf_dir)).select("ord", "kind", "title", "artist", "source")


@query(THEMES_SQL + """, w AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(lower(series), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS s, ['small', 'ring', 'bolt'] AS q FROM t)
SELECT ord, len(list_intersect(q, s)) / 3.0 AS overlap FROM w""")
def q_rank_overlap(spark, sf_dir):
    return themes(spark, sf_dir).select("ord", resolve.word_overlap(F.lit("Small ring, BOLT"), F.col("series")).alias("overlap"))


@query()
def q_rank_series(spark, sf_dir):
    return resolve.rank_themes(themes(spark, sf_dir), "Small ring, BOLT", ["kind"]).select("ord", "kind", "score", "rank")


@query("""WITH k AS (SELECT o_orderpriority AS grp, o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' THEN 'OP' ELSE 'ED' END AS kind FROM orders), f AS (SELECT *, bool_or(kind = 'OP') OVER (PARTITION BY grp) AS any_ FROM k)
SELECT grp, o_orderkey, kind FROM f WHERE NOT any_ OR kind = 'OP'""")
def q_filter_fallback(spark, sf_dir):
    kind = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") != "5-LOW"), "OP").otherwise("ED")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), "o_orderkey", kind.alias("kind"))
    return resolve.filter_kind(rows, "OP", ["grp"])


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - 200000), o_orderkey) AS INT) AS choice FROM orders WHERE o_totalprice BETWEEN 60000 AND 400000""")
def q_plausible(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("duration"))
    return resolve.plausible(c, 60000, 400000, 200000, ["o_custkey"]).select("o_custkey", "o_orderkey", "choice")


@query(r"""WITH t AS (SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), chr(12288), ' '), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, generate_subscripts(a, 1) AS n, regexp_replace(unnest(a), '\s+$', '') AS surface FROM t)
SELECT doc_id, CAST(n - min(n) OVER (PARTITION BY doc_id) + 1 AS INT) AS line_no, surface FROM l WHERE surface <> ''""")
def q_lyric_lines(spark, sf_dir):
    from strophe.sources.readers import lyric_rows

    return lyric_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], escaped=False)


@query("""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '\\P{L}', '', 'g')), 0) AS share FROM documents""")
def q_script_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.script_ratio(F.col("text")).alias("share"))


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]+>', '', 'g')) AS title, len(regexp_extract_all(html, '(?i)<br\\s*/?>')) AS breaks FROM pages""")
def q_page_title(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]+>", ""))
    return p.select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<br\s*/?>"), F.lit(0))).cast("bigint").alias("breaks"))


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches(text, '[0-9０-９]') THEN 'digits' END, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' END) AS flags FROM conversations""")
def q_flags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.line_flags(F.col("text")).alias("flags"))


@query("""WITH b AS (SELECT item_id, '[0' || (item_id % 10) || ':' || lpad(CAST(item_id % 60 AS VARCHAR), 2, '0') || '.25]' AS stamp, regexp_replace(text, '[\\[\\]\\n]', ' ', 'g') AS words FROM benchmark)
SELECT item_id, CAST(item_id % 10 AS DOUBLE) * 60 + item_id % 60 + 0.25 AS t, trim(words) AS text FROM b""")
def q_lrc(spark, sf_dir):
    stamp = F.format_string("[0%d:%02d.25]", F.col("item_id") % 10, F.col("item_id") % 60)
    body = F.concat(F.lit("[ar:someone]\nno stamp\n"), stamp, F.regexp_replace("text", r"[\[\]\n]", " "))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.parse_lrc(body)).alias("x"))
    return b.select("item_id", "x.t", "x.text")


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 40000 AS DOUBLE) / 3 AS t FROM orders), c AS (SELECT *, CAST(round_even(greatest(t, 0) * 100, 0) AS BIGINT) AS cs FROM s)
SELECT o_orderkey, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS at FROM c""")
def q_clock(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.clock((F.col("o_orderkey") % 40000).cast("double") / 3).alias("at"))


@query("""SELECT user_id, avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END) > 0.7 AS low FROM events GROUP BY 1""")
def q_low_confidence(spark, sf_dir):
    return timeline.low_confidence_lines(table(spark, sf_dir, "events").withColumnRenamed("value", "conf"), ["user_id"], 20)


@query("""SELECT o_custkey, max(support) AS support, sum(len) AS cover, CASE WHEN max(support) < 380 THEN 'weak' WHEN sum(len) < 2500 THEN 'short' ELSE 'ok' END AS verdict FROM (SELECT o_custkey, CAST(o_orderkey % 400 AS INT) AS support, CAST(o_orderkey % 290 AS DOUBLE) AS len FROM orders) GROUP BY 1""")
def q_verify_tracks(spark, sf_dir):
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select("o_custkey", (k % 400).cast("int").alias("support"), F.lit(0.0).alias("ep_start"), (k % 290).cast("double").alias("ep_end"))
    return matching.verify_tracks(s, ["o_custkey"], 380, 2500.0)


@query("""WITH s AS (SELECT c_custkey AS song_id, CAST(c_custkey % 200 AS DOUBLE) / 2 AS duration FROM customer), w AS (SELECT song_id, duration, unnest(generate_series(0, greatest(CAST(ceil(duration / 18) AS INT) - 1, 0))) AS k FROM s)
SELECT song_id, CAST(k AS INT) AS window_no, CAST(k * 18 AS DOUBLE) AS "from", least(CAST(k * 18 + 20 AS DOUBLE), duration) AS "to" FROM w WHERE least(CAST(k * 18 + 20 AS DOUBLE), duration) - k * 18 >= 0.5""")
def q_emission_windows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("song_id"), ((F.col("c_custkey") % 200).cast("double") / 2).alias("duration"))
    return timeline.emission_windows(c).select("song_id", "window_no", "from", "to")


# Operators that SQL cannot express: run over whole tables; their results are tested against brute force.


@query()
def q_romaji_kana(spark, sf_dir):
    from strophe.functions.kana import to_kana_udf

    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("kana", to_kana_udf("word"))


@query()
def q_sourced_lines(spark, sf_dir):
    from strophe.functions.kana import sourced_line_udf

    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    got = lines.withColumn("x", sourced_line_udf("line"))
    return got.select("conv_id", "turn", "line_no", F.size("x.units").alias("n_units"), (F.array_join("x.cells", "") == F.col("line")).alias("whole"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as emissions: 64 tokens, a song per label, the vectors in order as frames."""
    e = table(spark, sf_dir, "embeddings")
    lp = scalars.log_softmax(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 8))
    return e.select(F.col("label").alias("song_id"), F.col("vec_id").cast("int").alias("frame"), lp.alias("lp"))


TOKENS = {chr(0x3041 + i): i + 1 for i in range(60)}  # sixty kana as the vocabulary


def sung_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("song_id")).agg(F.lit(1).alias("line_no"), F.array(*[F.lit(c) for c in "かさたなはま"]).alias("units"))


@query()
def q_viterbi(spark, sf_dir):
    from strophe.operators.acoustic import align_lines

    return align_lines(frames(spark, sf_dir), sung_lines(spark, sf_dir), TOKENS, ["song_id"])


@query()
def q_viterbi_song(spark, sf_dir):
    from strophe.operators.acoustic import align_song

    return align_song(frames(spark, sf_dir), sung_lines(spark, sf_dir), TOKENS, ["song_id"])


@query()
def q_ctc_select(spark, sf_dir):
    from strophe.operators.acoustic import select_readings

    word = lambda s, *r: F.struct(F.lit(s).alias("surface"), F.array(*[F.lit(x) for x in r]).alias("readings"))
    lines = sung_lines(spark, sf_dir).withColumn("words", F.array(word("a", "かさ", "さか"), word("b", "た"), word("c", "な", "はな")))
    return select_readings(frames(spark, sf_dir), lines, TOKENS, ["song_id"])


#: Segments pass one by one, strongest first, over those kept so far: a step of the recursion per kept one (j), and one to end with.
RESOLVE_SQL = """WITH RECURSIVE o AS (SELECT o_custkey AS song_id, o_orderkey AS k, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders),
s AS (SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY k % 997 DESC, k) AS i,
  {rs: d, re: d + 5 + k % 90, es: d + k % 7, ee: d + k % 7 + 5 + k % 90, off: CAST(k % 7 AS DOUBLE), sup: CAST(k % 997 AS INT)} AS seg FROM o),
w AS (
  SELECT song_id, i, CAST(0 AS BIGINT) AS j, seg, list_filter([seg], lambda x: false) AS kept, list_filter([seg], lambda x: false) AS sh FROM s WHERE i = 1
  UNION ALL
  SELECT a.song_id, a.i, a.j, coalesce(a.seg, s.seg), a.kept, a.sh FROM (
    SELECT song_id, i, j + 1 AS j, CASE WHEN NOT a AND b THEN {rs: seg.rs, re: seg.re + x.es - seg.ee, es: seg.es, ee: x.es, off: seg.off, sup: seg.sup} ELSE seg END AS seg, kept,
      list_append(sh, CASE WHEN a THEN {rs: x.rs, re: x.re + seg.es - x.ee, es: x.es, ee: seg.es, off: x.off, sup: x.sup} ELSE x END) AS sh
    FROM (SELECT *, least(seg.es - x.es, seg.ee - x.ee) >= 2.5 AND x.ee - seg.es > 3 AND x.rs < seg.rs AND x.re - seg.rs <= 3 AS a,
        least(x.es - seg.es, x.ee - seg.ee) >= 2.5 AND seg.ee - x.es > 3 AND seg.rs < x.rs AND seg.re - x.rs <= 3 AS b
      FROM (SELECT *, kept[j + 1] AS x FROM w WHERE j < len(kept) AND seg IS NOT NULL))
    UNION ALL
    SELECT song_id, i + 1, 0, NULL, CASE WHEN hi - lo >= 2.5 AND seg.ee - seg.es - (hi - lo) <= 3
      THEN list_append(sh, {rs: seg.rs + lo - seg.es, re: seg.re + hi - seg.ee, es: lo, ee: hi, off: seg.off, sup: seg.sup}) ELSE kept END, list_filter(sh, lambda x: false)
    FROM (SELECT *, gap.lo AS lo, gap.hi AS hi FROM (SELECT *, list_sort(list_transform(gaps, lambda g: {size: g.lo - g.hi, lo: g.lo, hi: g.hi}))[1] AS gap
      FROM (SELECT *, list_transform(range(1, len(t) + 1), lambda k: {lo: list_max(list_append(list_transform(t[1:k - 1], lambda y: y.ee), seg.es)), hi: least(t[k].es, seg.ee)}) AS gaps
        FROM (SELECT *, list_append(list_sort(list_transform(list_filter(sh, lambda y: y.ee > seg.es AND y.es < seg.ee), lambda y: {es: y.es, ee: y.ee})), {es: seg.ee, ee: seg.ee}) AS t
          FROM w WHERE j = len(kept) AND seg IS NOT NULL))))
  ) a LEFT JOIN s ON a.seg IS NULL AND s.song_id = a.song_id AND s.i = a.i),
e AS (SELECT song_id, kept FROM w WHERE seg IS NULL),
p AS (SELECT song_id, generate_subscripts(kept, 1) AS n, unnest(kept) AS x FROM e)
SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY x.es, n) - 1 AS INT) AS seg_no, x.rs AS ref_start, x.re AS ref_end, x.es AS ep_start, x.ee AS ep_end, x.off AS "offset", x.sup AS support FROM p"""


@query(RESOLVE_SQL)
def q_resolve_overlaps(spark, sf_dir):
    return matching.resolve_overlaps(_rival_segments(spark, sf_dir), ["song_id"])


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS song_id, o_orderkey AS k, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders),
s AS (SELECT song_id, d AS ref_start, d + 5 + k % 90 AS ref_end, d + k % 7 AS ep_start, d + k % 7 + 5 + k % 90 AS ep_end, CAST(k % 7 AS DOUBLE) AS "offset", CAST(k % 997 AS INT) AS support,
  row_number() OVER (PARTITION BY song_id ORDER BY d + k % 7, d, k) AS i FROM o),
m AS (SELECT a.song_id, a.i, (a.ep_end - a.ep_start) * greatest(a.support, 1) AS w, list(b.i ORDER BY b.i) FILTER (WHERE b.i IS NOT NULL) AS may
  FROM s a LEFT JOIN s b ON b.song_id = a.song_id AND b.i < a.i AND b.ep_end - 3 <= a.ep_start AND b.ref_end - 3 <= a.ref_start GROUP BY ALL),
c AS (SELECT song_id, i, [w] AS best, [[i]] AS chains FROM m WHERE i = 1
  UNION ALL
  SELECT song_id, i, list_append(best, w + coalesce(best[j], 0)), list_append(chains, list_append(coalesce(chains[j], []), i))
  FROM (SELECT m.song_id, m.i, m.w, c.best, c.chains, m.may[list_position(list_transform(m.may, lambda x: c.best[x]), list_max(list_transform(m.may, lambda x: c.best[x])))] AS j
    FROM c JOIN m ON m.song_id = c.song_id AND m.i = c.i + 1)),
e AS (SELECT song_id, chains[list_position(best, list_max(best))] AS chain FROM c QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY i DESC) = 1),
p AS (SELECT song_id, generate_subscripts(chain, 1) - 1 AS seg_no, unnest(chain) AS i FROM e)
SELECT song_id, CAST(seg_no AS INT) AS seg_no, ref_start, ref_end, ep_start, ep_end, "offset", support FROM p JOIN s USING (song_id, i)""")
def q_chain(spark, sf_dir):
    return matching.best_chain(_rival_segments(spark, sf_dir), ["song_id"])


def _rival_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.expr("cast(datediff(cast(o_orderdate as date), date'1992-01-01') as double)")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("song_id"), k.alias("ord"), day.alias("ref_start"), (day + 5 + k % 90).alias("ref_end"), (day + k % 7).alias("ep_start"), (day + k % 7 + 5 + k % 90).alias("ep_end"), (k % 7).cast("double").alias("offset"), (k % 997).cast("int").alias("support"))


# The tables' texts are in NFKC already, which the SQL's folding leaves out.
@query("""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS n, unnest(a) AS line FROM d),
f AS (SELECT doc_id, n, regexp_replace(lower(line), '[^0-9a-zぁ-ゖァ-ヺー一-鿿]', '', 'g') AS x FROM l),
h AS (SELECT doc_id, CASE WHEN n % 3 = 1 THEN x || 'unheard' ELSE x END AS x, list(n ORDER BY n) AS times FROM f GROUP BY ALL),
s AS (SELECT f.doc_id, f.n, h.times FROM f LEFT JOIN h ON h.doc_id = f.doc_id AND h.x = f.x AND f.x <> ''),
w AS (SELECT doc_id, CAST(-1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ahead, CAST(NULL AS BIGINT) AS t FROM d
  UNION ALL
  SELECT doc_id, n, coalesce(t + 1, ahead), t FROM (SELECT s.doc_id, s.n, w.ahead, list_min(list_filter(s.times, lambda v: v >= w.ahead)) AS t FROM w JOIN s ON s.doc_id = w.doc_id AND s.n = w.n + 1))
SELECT doc_id, CAST(n AS INT) AS line_no, CAST(t AS DOUBLE) AS t FROM w WHERE t IS NOT NULL""")
def q_match_timings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    # Every line is timed; a third of the timings have another text, so that lines without one occur.
    heard = F.when(F.col("line_no") % 3 == 1, F.concat("text", F.lit(" unheard"))).otherwise(F.col("text"))
    times = docs.select("doc_id", F.col("line_no").cast("double").alias("t"), heard.alias("text"))
    return resolve.match_timings(docs, times, ["doc_id"])


@query()
def q_segment(spark, sf_dir):
    from strophe.operators import lexicon

    # The turns' own texts, and what they say waited for by the hour.
    text_ = F.concat_ws(" ", "text", F.concat((F.col("turn") + 1).cast("string"), F.lit("時待ってください")))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", text_.alias("text"))
    rows = [(s, r, "待つ", "v", 3, 0, 0, int(f != "base"), f) for s, r, f in lexicon.inflect("待つ", "まつ", "godan")] + [("時", "じ", "時", "ctr", 1, 0, 0, 0, "base")]
    return lexicon.segment_lines(lines, lexicon.spark_lexicon(spark, rows))


@query()
def q_locate(spark, sf_dir):
    """Peaks of a minute raster against the same peaks moved by 300 frames: the splice map of each song."""
    p = points(spark, sf_dir)
    moved = p.withColumn("t", F.col("t") + 300)
    got = matching.match_hashes(matching.fan_out(p, ["song_id"]), matching.fan_out(moved, ["song_id"]), ["song_id"])
    return matching.resolve_overlaps(matching.segments_of(got, ["song_id"], max_gap=4000.0), ["song_id"])


@query("""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS try_no FROM documents) SELECT doc_id, source, CAST(try_no AS INT) AS try_no FROM r WHERE try_no <= 4""")
def q_first_tried(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return resolve.first_tried(docs, ["source"], [F.col("n_chars").desc(), "doc_id"], 4).select("doc_id", "source", "try_no")


@query("""SELECT doc_id, lang AS reading FROM documents WHERE lang IS DISTINCT FROM CASE WHEN doc_id % 4 = 0 THEN lang ELSE 'other' END AND lang <> '' AND NOT regexp_full_match(lang, '[ぁ-ゖゝゞー\\s]+')""")
def q_invalid_overrides(spark, sf_dir):
    """Every fourth row is as the baseline has it; the others were changed to a language, which is no reading."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.lit("").alias("flag"), F.lit("s").alias("surface"), F.col("lang").alias("reading"))
    base = d.select("line", "surface", F.when(F.col("line") % 4 == 0, F.col("reading")).otherwise("other").alias("reading"))
    return resolve.invalid_overrides(d, base).select(F.col("line").alias("doc_id"), "reading")


@query("""WITH l AS (SELECT l_orderkey AS song_id, l_linenumber AS line_no, CAST(l_quantity AS DOUBLE) AS start, CAST(l_extendedprice AS DOUBLE) / 2000 AS t FROM lineitem),
s AS (SELECT o_orderkey AS song_id, CAST(o_orderkey % 20 AS DOUBLE) AS lo, CAST(o_orderkey % 20 + 15 AS DOUBLE) AS hi FROM orders),
a AS (SELECT song_id, line_no, min(t) AS t FROM l JOIN s USING (song_id) WHERE t BETWEEN lo AND hi GROUP BY ALL)
SELECT l.song_id, l.line_no, coalesce(a.t, start) AS start, coalesce(abs(a.t - start) > 0.15, false) AS anchored FROM l LEFT JOIN a ON l.song_id = a.song_id AND l.line_no = a.line_no""")
def q_anchored(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("song_id"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").cast("double").alias("start"), (F.col("l_extendedprice").cast("double") / 2000).alias("t"))
    lo = F.expr("cast(o_orderkey % 20 as double)")
    segs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("song_id"), F.lit(0).alias("seg_no"), lo.alias("ref_start"), (lo + 15).alias("ref_end"), F.lit(0.0).alias("offset"))
    return matching.anchored(li.drop("t"), li, segs, ["song_id"]).select("song_id", "line_no", "start", "anchored")


@query("""WITH f AS (SELECT user_id AS song_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT *, i // 20 AS window_no, i % 20 AS frame, (n + 19) // 20 AS n_windows FROM f),
z AS (SELECT *, count(*) OVER (PARTITION BY song_id, window_no) AS wn FROM w),
k AS (SELECT * FROM z WHERE frame >= CASE WHEN window_no = 0 THEN 0 ELSE 3 END AND frame < CASE WHEN window_no = n_windows - 1 THEN wn ELSE wn - 3 END)
SELECT song_id, event_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY window_no, frame) - 1 AS INT) AS frame FROM k""")
def q_stitch_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("song_id"), "event_id")
    order = Window.partitionBy("song_id").orderBy("event_id")
    e = e.withColumn("i", F.row_number().over(order) - 1).withColumn("n_windows", F.expr("(count(*) over (partition by song_id) + 19) div 20"))
    e = e.withColumn("window_no", F.expr("i div 20")).withColumn("frame", F.expr("i % 20")).drop("i")
    return timeline.stitch_windows(e, ["song_id"], trim=3).select("song_id", "event_id", "frame")


@query("""SELECT doc_id, sha256('{"frame_stride":' || n_chars || ',"kind":"emissions","model":"' || lang || '","schema":1,"waveform":"' || sha256(source) || '"}') AS key FROM documents""")
def q_emissions_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = resolve.stable_key("emissions", 1, model=F.col("lang"), frame_stride=F.col("n_chars"), waveform=F.sha2("source", 256))
    return d.select("doc_id", key.alias("key"))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: durations of every user's events, summed up."""
    d = timeline.post_process(units(spark, sf_dir).withColumn("line_no", F.expr("us div 86400000000")), ["song_id"], ["song_id", "line_no"], ["us", "event_id"], HOLD)
    return d.groupBy("song_id").agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("end") - F.col("start")).alias("held"), F.count_if("trimmed").alias("trimmed"), F.count_if("smear_fixed").alias("smeared"))
