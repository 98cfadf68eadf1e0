"""Queries over batches of operations and the change stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators import mutate as M
from ..operators.batch import Batch, apply_batch
from ..operators.triples import triplify
from ..schema import EVENTS
from ..session import scratch, spread
from ..sources import rules as R
from ..sources.fleet import as_operations, customer_documents, operations
from ..sources.graphs import dedup
from ..streaming import events as E
from .registry import query

_NO_THINGS = "id string, body string"

# Operations as SQL sees them: the kind, the values they bring, what was there before.
_OPS = """
WITH e AS (SELECT event_id AS seq, 'urn:user:' || user_id AS id, event_type AS src, value AS v,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'PUT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'PATCH' END AS op
  FROM events),
o AS (SELECT *, last_value(CASE WHEN op <> 'PATCH' THEN op END IGNORE NULLS) OVER
    (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
c AS (SELECT *, coalesce(before = 'PUT', false) AS existed FROM o)
"""
_FOLD = (
    _OPS
    + """,
r AS (SELECT id, max(seq) AS seq FROM c WHERE op <> 'PATCH' GROUP BY 1),
s AS (SELECT c.* FROM c JOIN r ON c.id = r.id AND c.seq = r.seq WHERE c.op = 'PUT'),
pk AS (SELECT p.id, max(p.seq) AS seq FROM c p JOIN s ON p.id = s.id AND p.seq > s.seq
  WHERE p.src = 'click' OR (p.src = 'view' AND p.seq % 5 = 0) GROUP BY 1),
pv AS (SELECT p.id, max(p.seq) AS seq FROM c p JOIN s ON p.id = s.id AND p.seq > s.seq
  WHERE p.src = 'view' AND p.seq % 5 <> 0 GROUP BY 1),
f AS (SELECT s.id, s.src,
    CASE WHEN pk.seq IS NULL THEN s.k WHEN ck.src = 'click' THEN ck.k END AS k,
    CASE WHEN pv.seq IS NULL THEN s.v ELSE cv.v END AS v
  FROM s LEFT JOIN pk ON pk.id = s.id LEFT JOIN c ck ON ck.seq = pk.seq
  LEFT JOIN pv ON pv.id = s.id LEFT JOIN c cv ON cv.seq = pv.seq)
"""
)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _NO_THINGS)


def _members(things: DataFrame) -> DataFrame:
    doc = F.parse_json("body")
    return things.select(
        "id",
        F.try_variant_get(doc, "$.src", "string").alias("src"),
        F.try_variant_get(doc, "$.k", "bigint").alias("k"),
        F.try_variant_get(doc, "$.v", "double").alias("v"),
    )


@query(_OPS + "SELECT id, src, k, v FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN op = 'PATCH' THEN -1 ELSE seq END DESC) = 1 AND op = 'PUT'")
def apply_put_delete(spark: SparkSession, sf: str) -> DataFrame:
    ops = operations(spark, sf).where("op <> 'PATCH'")
    return _members(M.apply_ops(ops, _empty(spark)).things)


@query(_FOLD + "SELECT id, src, k, v FROM f")
def apply_patch_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _members(M.apply_ops(operations(spark, sf), _empty(spark)).things)


@query(_OPS + "SELECT seq, id, 'not_found' AS code, 'There is no document with this id.' AS message FROM c WHERE op = 'PATCH' AND NOT existed")
def apply_rejects(spark: SparkSession, sf: str) -> DataFrame:
    out = M.apply_ops(operations(spark, sf), _empty(spark))
    return out.rejects.select("seq", "id", "code", "message")


@query("""
SELECT event_id AS seq, 'thing_created' AS event,
  'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-'
  || '89ab'[(position(h[17:17] IN '0123456789abcdef') - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS thing_id
FROM (SELECT event_id, sha1(event_id || '|' || props) AS h FROM events)
""")
def create_anonymous(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    ops = e.select(
        F.col("event_id").alias("seq"),
        F.lit("CREATE").alias("op"),
        F.lit(None).cast("string").alias("id"),
        F.col("props").alias("body"),
        "ts",
    )
    return M.apply_ops(ops, _empty(spark)).events.select("seq", "event", "thing_id")


@query(_OPS + """
, a AS (SELECT id, op, seq, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM c WHERE op <> 'PATCH'
  AND seq < (SELECT max(event_id) // 2 FROM events)),
z AS (SELECT id, op, seq, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM c WHERE op <> 'PATCH'),
b4 AS (SELECT id, seq FROM a WHERE n = 1 AND op = 'PUT'), af AS (SELECT id, seq FROM z WHERE n = 1 AND op = 'PUT')
SELECT coalesce(b4.id, af.id) AS thing_id, CASE WHEN b4.id IS NULL THEN 'thing_created'
  WHEN af.id IS NULL THEN 'thing_deleted' ELSE 'thing_updated' END AS event
FROM b4 FULL JOIN af ON b4.id = af.id WHERE b4.seq IS DISTINCT FROM af.seq
""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Replaces and deletes up to the middle of the log against those of the whole log."""
    numbered = F.concat(F.lit('{"n":'), F.col("seq"), F.lit("}"))
    ops = operations(spark, sf).where("op <> 'PATCH'").withColumn(
        "body",
        F.when(
            F.col("op") == "PUT",
            F.concat(F.lit('{"id":"'), "id", F.lit('","n":'), "seq", F.lit("}")),
        ).otherwise(numbered),
    )
    middle = ops.sparkSession.read.parquet(f"{sf}/events.parquet").agg(
        F.floor(F.max("event_id") / 2).alias("mid")
    )
    cut_at = middle.first().mid
    before = M.apply_ops(ops.where(F.col("seq") < cut_at), _empty(spark)).things
    return M.snapshot_diff(before, M.apply_ops(ops, _empty(spark)).things)


_EVENTS = (
    _OPS
    + """
, ev AS (SELECT seq, CASE WHEN op = 'DELETE' THEN 'thing_deleted' WHEN op = 'PUT' AND NOT existed THEN 'thing_created'
    ELSE 'thing_updated' END AS event, id AS thing_id, '{"id":"' || id || '"}' AS data
  FROM c WHERE op <> 'PATCH' OR existed)
"""
)


@query(_EVENTS + "SELECT * FROM ev")
def events_classify(spark: SparkSession, sf: str) -> DataFrame:
    found = E.derive(operations(spark, sf))
    return found.select("seq", "event", "thing_id", "data")


@query(_EVENTS + "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, event, thing_id FROM ev")
def events_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return E.number_events(E.derive(operations(spark, sf))).select("seq", "event", "thing_id")


@query(_EVENTS + "SELECT seq, event, thing_id FROM ev WHERE seq > 4000 AND event IN ('thing_created', 'thing_deleted')")
def events_replay(spark: SparkSession, sf: str) -> DataFrame:
    log = E.derive(operations(spark, sf))
    return E.past_events(log, "4000", ("thing_created", "thing_deleted")).select("seq", "event", "thing_id")


@query(_EVENTS + "SELECT event, count(*) AS n, min(seq) AS first, max(seq) AS last FROM ev GROUP BY 1")
def events_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Every type as its own stream, merged again."""
    log = E.derive(operations(spark, sf))
    parts = [E.subscribe(log, (t,)) for t in ("thing_created", "thing_updated", "thing_deleted")]
    return E.merge(*parts).groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")
    )


@query(_EVENTS + "SELECT seq, 'event: ' || event || chr(10) || 'id: ' || seq || chr(10) || 'data: ' || data || chr(10) || chr(10) AS value FROM ev")
def sse_frames(spark: SparkSession, sf: str) -> DataFrame:
    return E.frames(E.derive(operations(spark, sf)))


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if table.inputFiles()[0].endswith("/events.parquet"):
        # a table in a single file: a stream reads folders, so take the file from its folder
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    return reader.parquet(path)


@query("""
SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'thing_created' ELSE 'thing_deleted' END AS event,
  'urn:user:' || user_id AS thing_id FROM events WHERE event_type IN ('signup', 'error')
""")
def events_subscribe_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of typed events, filtered by subscription, written to a log and read back."""
    kind = F.col("event_type")
    event = F.when(kind == "signup", "thing_created").when(kind == "error", "thing_deleted").otherwise("thing_updated")
    id_ = F.concat(F.lit("urn:user:"), "user_id")
    stream = _event_stream(spark, sf).select(
        F.col("event_id").alias("seq"), event.alias("event"), id_.alias("thing_id"), E.payload(id_).alias("data"), "ts"
    )
    home = scratch(spark, "subscription")
    chosen = E.subscribe(stream, ("thing_created", "thing_deleted"))
    E.write_log(chosen, f"{home}/log", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/log").select("seq", "event", "thing_id")


@query(_EVENTS + "SELECT seq, event, thing_id, data FROM ev")
def events_classify_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events derived from a stream of operations, existence kept between batches."""
    run = E.Classifier(scratch(spark, "classifier"))
    run.start(as_operations(_event_stream(spark, sf))).awaitTermination()
    return run.events(spark).select("seq", "event", "thing_id", "data")


def _slices(table: DataFrame, order: str, parts: int = 3) -> list[DataFrame]:
    """All rows of a table in parts along an order, as a log would bring them."""
    ends = table.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)]).alias("e")).first().e or []
    marks = [None, *ends, None]
    above = lambda lo: F.lit(True) if lo is None else F.col(order) > lo
    upto = lambda hi: F.lit(True) if hi is None else F.col(order) <= hi
    return [table.where(above(lo) & upto(hi)) for lo, hi in zip(marks, marks[1:])]


@query(_EVENTS + "SELECT seq, event, thing_id, data FROM ev")
def events_keyed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The first third of the operations as a table; from what it leaves the other two as a stream with keyed state,
    which stops and starts again between them."""
    home = scratch(spark, "keyed")
    old, *new = _slices(spark.read.parquet(f"{sf}/events.parquet"), "event_id")
    before = as_operations(old)
    last = before.where(F.col("op").isin("CREATE", "PUT", "DELETE")).groupBy("id").agg(F.max(F.struct("seq", "op")).alias("r"))
    things = last.where("r.op <> 'DELETE'").select("id")
    for rows in new:
        rows.write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{home}/in")
        E.write_events(E.derive_keyed(as_operations(stream), things), f"{home}/out", f"{home}/checkpoint").awaitTermination()
    streamed = spark.read.schema(EVENTS).parquet(f"{home}/out")
    return E.derive(before).unionByName(streamed).select("seq", "event", "thing_id", "data")


@query(_EVENTS + "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, event, thing_id, data FROM ev")
def events_ledger_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrive in three batches, numbered without a gap over all of them."""
    home = scratch(spark, "ledger")
    ledger = E.Ledger(home)
    E.derive(operations(spark, sf)).write.parquet(f"{home}/log")
    for rows in _slices(spark.read.schema(EVENTS).parquet(f"{home}/log"), "seq"):
        rows.write.mode("append").parquet(f"{home}/in")
        ledger.start(E.read_log(spark, f"{home}/in")).awaitTermination()
    return ledger.events(spark).select("seq", "event", "thing_id", "data")


@query(_OPS + """
, d AS (SELECT id, max(seq) AS seq FROM c WHERE op <> 'PATCH' GROUP BY 1)
SELECT 'g:' || d.id AS g, CAST(d.seq AS VARCHAR) AS o FROM d JOIN c ON c.id = d.id AND c.seq = d.seq AND c.op = 'PUT'
""")
def overwrite_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs of the first half of the log replaced by, or emptied after, those of the second."""
    ops = operations(spark, sf).where("op <> 'PATCH'")
    last = lambda d: d.groupBy("id").agg(F.max(F.struct("seq", "op")).alias("r")).select("id", "r.seq", "r.op")

    def graphs(d: DataFrame) -> DataFrame:
        none = F.lit(None)
        return d.select(
            F.concat(F.lit("g:"), "id").alias("g"), F.col("id").alias("s"), F.lit("urn:p:seq").alias("p"),
            F.col("seq").cast("string").alias("o"), F.lit("literal").alias("o_kind"),
            none.cast("string").alias("o_dt"), none.cast("string").alias("o_lang"),
            F.col("seq").cast("double").alias("o_num"), none.cast("timestamp").alias("o_ts"),
        )

    mid = spark.read.parquet(f"{sf}/events.parquet").agg(F.floor(F.max("event_id") / 2).alias("mid")).first().mid
    old, new = last(ops.where(F.col("seq") < mid)), last(ops.where(F.col("seq") >= mid))
    stored = graphs(old.where("op = 'PUT'"))
    emptied = graphs(new.where("op = 'DELETE'")).select("g")
    return M.overwrite_graphs(stored, graphs(new.where("op = 'PUT'")), emptied).select("g", "o")


# A batch over stored documents: replaces, deletes, patches that break no rule, patches that break two, new ones.
_BATCH = """
WITH n AS (SELECT max(c_custkey) AS n FROM customer),
e AS (SELECT event_id AS seq, 'urn:customer:' || (user_id % (2 * (SELECT n FROM n))) AS own,
    CASE event_type WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'DELETE' WHEN 'click' THEN 'CREATE' ELSE 'PATCH' END AS op,
    event_type = 'view' AS bad, 't' || event_id AS title, ts FROM events),
base AS (SELECT 'urn:customer:' || c_custkey AS own, CASE WHEN c_custkey % 50 <> 7 THEN c_name END AS title FROM customer),
o AS (SELECT e.*, last_value(CASE WHEN op IN ('PUT', 'DELETE') THEN op END IGNORE NULLS) OVER
    (PARTITION BY e.own ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    b.own IS NOT NULL AS stored FROM e LEFT JOIN base b ON b.own = e.own),
c AS (SELECT *, CASE WHEN before IS NULL THEN stored ELSE before = 'PUT' END AS existed FROM o)
"""


def _batch(spark: SparkSession, sf: str) -> Batch:
    docs = customer_documents(spark, sf)
    n = docs.agg(F.max("k").alias("n"))
    e = spread(spark.read.parquet(f"{sf}/events.parquet")).withColumn("one", F.lit(1))
    # the largest customer number is one row
    e = e.join(F.broadcast(n.withColumn("one", F.lit(1))), "one")
    own = F.concat(F.lit("urn:customer:"), F.col("user_id") % (2 * F.col("n")))
    kind, title = F.col("event_type"), F.concat(F.lit('"title":"t'), "event_id", F.lit('"'))
    rest = '"security":["nosec_sc"],"securityDefinitions":{"nosec_sc":{"scheme":"nosec"}}'
    body = (
        F.when(kind == "signup", F.concat(F.lit('{"id":"'), own, F.lit('",'), title, F.lit(f",{rest}}}")))
        .when(kind == "click", F.concat(F.lit("{"), title, F.lit(f",{rest}}}")))
        .when(kind == "view", '{"title":null,"security":null}')
        .when(kind == "purchase", F.concat(F.lit("{"), title, F.lit("}")))
    )
    op = F.when(kind == "signup", "PUT").when(kind == "error", "DELETE").when(kind == "click", "CREATE").otherwise("PATCH")
    ops = e.select(F.col("event_id").alias("seq"), op.alias("op"), F.when(op != "CREATE", own).alias("id"), body.alias("body"), "ts")
    parsed = docs.withColumn("m", D.fields(F.try_parse_json("body")))
    things = parsed.select("id", F.to_json(F.to_variant_object(D.upgrade(F.col("m")))).alias("body"))
    quads = dedup(triplify(things.select("id", F.parse_json("body").alias("doc"))))
    return apply_batch(ops, things, quads, R.catalogue())


@query(_BATCH + """,
r AS (SELECT own, max(seq) AS seq FROM c WHERE op IN ('PUT', 'DELETE') GROUP BY 1),
s AS (SELECT coalesce(b.own, r.own) AS own, coalesce(r.seq, -1) AS since, CASE WHEN r.own IS NULL THEN b.title ELSE z.title END AS title,
    r.own IS NULL OR z.op = 'PUT' AS live
  FROM base b FULL JOIN r ON r.own = b.own LEFT JOIN c z ON z.seq = r.seq),
p AS (SELECT s.own, max_by(c.title, c.seq) AS title FROM s JOIN c ON c.own = s.own AND c.op = 'PATCH' AND NOT c.bad AND c.seq > since GROUP BY 1)
SELECT s.own AS id, coalesce(p.title, s.title) AS title FROM s LEFT JOIN p USING (own) WHERE live
UNION ALL SELECT NULL, title FROM c WHERE op = 'CREATE'
""")
def batch_things(spark: SparkSession, sf: str) -> DataFrame:
    """Titles after the batch; minted ids say themselves in their document, and are left out here."""
    doc = F.parse_json("body")
    own = F.try_variant_get(doc, "$.id", "string")
    named = F.when(F.col("id").startswith("urn:customer:") & (own == F.col("id")), F.col("id"))
    rows = _batch(spark, sf).things.where(own == F.col("id"))
    return rows.select(named.alias("id"), F.try_variant_get(doc, "$.title", "string").alias("title"))


@query(_BATCH + """
SELECT seq, CASE WHEN op = 'CREATE' OR (op = 'PUT' AND NOT existed) THEN 'thing_created' WHEN op = 'DELETE' THEN 'thing_deleted'
  ELSE 'thing_updated' END AS event, CASE WHEN op <> 'CREATE' THEN own END AS thing_id
FROM c WHERE op <> 'PATCH' OR (existed AND NOT bad)
""")
def batch_events(spark: SparkSession, sf: str) -> DataFrame:
    id_ = F.when(F.col("thing_id").startswith("urn:customer:"), F.col("thing_id"))
    return _batch(spark, sf).events.select("seq", "event", id_.alias("thing_id"))


@query(_BATCH + """
SELECT seq, own AS id, CASE WHEN bad THEN 'validation' ELSE 'not_found' END AS code, CASE WHEN bad THEN 2 ELSE 0 END AS n_errors
FROM c WHERE op = 'PATCH' AND (bad OR NOT existed)
""")
def batch_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _batch(spark, sf).rejects.select("seq", "id", "code", F.size("errors").alias("n_errors"))


@query(_EVENTS + "SELECT seq, event, thing_id FROM ev WHERE seq > 400 AND event <> 'thing_updated'")
def events_follow_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Replay after the last event seen and then what follows, from one reading of the log."""
    home = scratch(spark, "follow")
    E.derive(operations(spark, sf)).write.parquet(f"{home}/log")
    chosen = E.follow(spark, f"{home}/log", "400", ("thing_created", "thing_deleted"))
    E.write_log(chosen, f"{home}/seen", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/seen").select("seq", "event", "thing_id")


@query(_EVENTS + """SELECT seq, 'id: ' || seq AS id_line, 'event: ' || event AS event_line, 'data: ' || data AS data_line FROM ev""")
def sse_written(spark: SparkSession, sf: str) -> DataFrame:
    """Frames written as text by a stream and read back, a frame between empty lines."""
    home = scratch(spark, "frames")
    E.derive(operations(spark, sf)).write.parquet(f"{home}/log")
    E.write_frames(E.read_log(spark, f"{home}/log"), f"{home}/text", f"{home}/checkpoint").awaitTermination()
    # one file is one text: frames end with an empty line
    frame = F.explode(F.split("value", r"\n\n"))
    found = spark.read.text(f"{home}/text", wholetext=True).select(frame.alias("value")).where("trim(value) <> ''")
    lines = F.split("value", r"\n")
    line = lambda k: F.get(lines, F.lit(k))
    return found.select(
        F.regexp_extract(line(1), r"^id: (\d+)$", 1).cast("bigint").alias("seq"),
        line(1).alias("id_line"), line(0).alias("event_line"), line(2).alias("data_line"),
    )


@query("""
SELECT upper(event_type) AS name, CASE upper(event_type) WHEN 'SIGNUP' THEN 'thing_created' END AS wire, count(*) AS n FROM events GROUP BY ALL
""")
def event_names(spark: SparkSession, sf: str) -> DataFrame:
    """Event names as clients write them; a name that is none of the three has no name on the wire."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    asked = F.when(F.col("event_type") == "signup", "THING_CREATED").otherwise(F.upper("event_type"))
    return e.select(F.upper("event_type").alias("name"), E.wire_name(asked).alias("wire")).groupBy("name", "wire").agg(F.count(F.lit(1)).alias("n"))
