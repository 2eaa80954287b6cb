"""The engine's registered queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlog.functions.canonical_json import canonical_sha256
from fathomlog.functions.timestamps import iso_text
from fathomlog.functions.values import clean_error, composite_key
from fathomlog.operators import access, chain, commands, delivery, findings, folds, ingest, retention, view_reads
from fathomlog.plans.specs import AggregateId, AggregateView, Interest, TableView, WholePayload
from fathomlog.sources import event_log as el
from fathomlog.sources.scratch import scratch_dir
from fathomlog.sources.store import LogStore

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The log as the SQL side builds it.
LOG = """log AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id, user_id, event_type, ts, value,
    CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


def query(sql: str | None = None):
    """Register a function under its name, with its SQL; ``{LOG}`` stands for the log."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql.replace("{LOG}", LOG)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seq() -> Column:
    return F.col("sequence_number").alias("seq")


# Scans.


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in a store, whose files are in the order of positions: filters reach them, and no read numbers the log again."""
    store = LogStore(spark, scratch_dir(spark, "store"))
    store.append(el.events_log(spark, sf_dir).drop("sequence_number"))
    return store.log()


@query("WITH {LOG} SELECT seq, event_id, event_type FROM log WHERE seq > 100 AND seq <= 5000")
def log_scan_range(spark, sf_dir):
    log = _stored(spark, sf_dir)
    return el.scan(log, after=100).where("sequence_number <= 5000").select(_seq(), "event_id", "event_type")


@query("""WITH {LOG} SELECT seq, event_id, user_id, value FROM log WHERE event_type IN ('purchase', 'click')
    AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-03-01' ORDER BY seq LIMIT 500""")
def log_scan_filters(spark, sf_dir):
    rows = el.scan(el.events_log(spark, sf_dir), event_types=["purchase", "click"], start=datetime(2024, 1, 5), end=datetime(2024, 3, 1), limit=500)
    return rows.select(_seq(), "event_id", F.col("aggregate_id").alias("user_id"), "value")


@query("WITH {LOG} SELECT seq, event_id, event_type FROM log WHERE event_type IN ('error', 'signup') ORDER BY seq DESC LIMIT 300")
def log_reverse_by_type(spark, sf_dir):
    return el.latest_first(el.events_log(spark, sf_dir), ["error", "signup"], 300).select(_seq(), "event_id", "event_type")


@query("""WITH {LOG} SELECT seq, event_id, entry_type FROM (SELECT seq, event_id, event_type, CASE WHEN event_id % 50 = 0 THEN 'system.security_finding'
    WHEN event_id % 3 = 0 THEN 'note' ELSE 'item' END AS entry_type FROM log)
    WHERE seq > 200 AND seq <= 4000 AND ((entry_type = 'note' AND event_type IN ('view', 'error')) OR entry_type = 'system.security_finding')""")
def log_candidates(spark, sf_dir):
    log = el.events_log(spark, sf_dir).withColumn(
        "entry_type", F.when(F.col("event_id") % 50 == 0, "system.security_finding").when(F.col("event_id") % 3 == 0, "note").otherwise("item")
    )
    interest = Interest(entry_types=frozenset({"note"}), event_types=frozenset({"view", "error"}))
    return el.candidates(log, after=200, through=4000, **interest.candidate_filter()).select(_seq(), "event_id", "entry_type")


@query("""WITH {LOG}, typed AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'system.audit' WHEN event_id % 2 = 0 THEN 'note' ELSE 'item' END AS entry_type FROM log)
    SELECT seq, event_id, entry_type FROM typed WHERE event_type <> 'signup' AND (entry_type = 'note' OR entry_type LIKE 'system.%') AND value > 10""")
def subscription_filter(spark, sf_dir):
    log = el.events_log(spark, sf_dir).withColumn(
        "entry_type", F.when(F.col("event_id") % 5 == 0, "system.audit").when(F.col("event_id") % 2 == 0, "note").otherwise("item")
    )
    interest = Interest(frozenset({"note"}), frozenset({"purchase", "error", "view", "click"}), None, True, lambda d: F.col("value") > 10)
    return log.where(interest.condition(log)).select(_seq(), "event_id", "entry_type")


@query("WITH {LOG} SELECT max(seq) AS head, arg_max(event_id, seq) AS at_head, count(*) AS events FROM log")
def log_head(spark, sf_dir):
    return el.head(el.events_log(spark, sf_dir))


@query("WITH {LOG} SELECT seq, event_id, event_type, value, k FROM log WHERE user_id = 7")
def aggregate_history(spark, sf_dir):
    return el.history(_stored(spark, sf_dir), 7).select(_seq(), "event_id", "event_type", "value", "k")


@query("WITH {LOG} SELECT seq, event_id, event_type FROM log WHERE event_id = 42")
def event_by_id(spark, sf_dir):
    return el.by_id(_stored(spark, sf_dir), 42).select(_seq(), "event_id", "event_type")


# Aggregate views: one row per user, errors are tombstones.

_LIVE = """{LOG}, last AS (SELECT *, max(CASE WHEN event_type = 'error' THEN seq END) OVER (PARTITION BY user_id) AS t FROM log),
    live AS (SELECT * FROM last WHERE t IS NULL OR seq > t)"""
_ISO = "CASE WHEN epoch_us({0}) % 1000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ') ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ') END"
_LATEST = f"""WITH {_LIVE} SELECT user_id, arg_max(event_type, seq) AS last_type, arg_max(value, seq) FILTER (value IS NOT NULL) AS last_value,
    arg_max(k, seq) FILTER (k IS NOT NULL) AS last_k, arg_max(event_id, seq) AS latest_event_id, {_ISO.format('arg_max(ts, seq)')} AS updated_at,
    {_ISO.format('arg_min(ts, seq)')} AS first_event_at, max(seq) AS sequence FROM live GROUP BY user_id"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"last_type": F.col("event_type"), "last_value": F.col("value"), "last_k": F.col("k")}
    rows = folds.aggregate_rows(el.events_log(spark, sf_dir), F.col("event_type") == "error", values)
    return rows.withColumns({c: iso_text(F.col(c)) for c in ("updated_at", "first_event_at")}).withColumnRenamed("aggregate_id", "user_id")


@query(_LATEST)
def view_aggregate_latest(spark, sf_dir):
    return _latest(spark, sf_dir)


@query(f"""SELECT user_id, coalesce(last_k, -1) AS k_or_default, coalesce(CASE WHEN last_value > 50 THEN updated_at END, first_event_at) AS high_at, sequence FROM ({_LATEST})""")
def view_aggregate_derived(spark, sf_dir):
    rows = _latest(spark, sf_dir)
    high = F.when(F.col("last_value") > 50, F.col("updated_at"))
    return rows.select("user_id", F.coalesce("last_k", F.lit(-1)).alias("k_or_default"), F.coalesce(high, F.col("first_event_at")).alias("high_at"), "sequence")


def _payload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a nested payload: what each type of event last said, under its name."""
    log = el.events_log(spark, sf_dir)
    data = F.format_string('{"kinds":{"%s":{"k":%d,"id":%d}},"last":"%s"}', "event_type", F.coalesce("k", F.lit(-1)), "event_id", "event_type")
    return log.select("sequence_number", "event_id", "aggregate_id", "event_type", data.alias("data"))


@query(f"""WITH {_LIVE}, leaf AS (SELECT user_id, seq, 'kinds.' || event_type || '.k' AS path, CAST(coalesce(k, -1) AS VARCHAR) AS value FROM live
    UNION ALL SELECT user_id, seq, 'kinds.' || event_type || '.id', CAST(event_id AS VARCHAR) FROM live
    UNION ALL SELECT user_id, seq, 'last', '"' || event_type || '"' FROM live)
    SELECT user_id, path, arg_max(value, seq) AS value, max(seq) AS sequence FROM leaf GROUP BY user_id, path""")
def view_aggregate_deep_merge(spark, sf_dir):
    rows = folds.path_writes(_payload_log(spark, sf_dir), F.col("event_type") == "error")
    return rows.select(F.col("aggregate_id").alias("user_id"), F.array_join("path", ".").alias("path"), "value", "sequence")


def _full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.to_json(F.struct(F.col("event_type").alias("type"), "value", "k"))
    return el.events_log(spark, sf_dir).select(
        "sequence_number", F.col("event_id").cast("string").alias("event_id"), F.col("aggregate_id").cast("string").alias("aggregate_id"), "aggregate_type", "entry_type",
        F.struct(F.lit(1).alias("major"), F.lit(0).alias("minor")).alias("entry_type_version"), "event_type", data.alias("data"), "client_timestamp",
    )


def activity_view() -> AggregateView:
    return AggregateView("activity", Interest(entry_types=frozenset({"user_activity"})), frozenset({"error"}))


def _opened(rows: DataFrame) -> DataFrame:
    v = F.parse_json("row_json")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return rows.where("row_json is not null").select(
        F.col("row_key").cast("long").alias("user_id"), get("$.type", "string").alias("last_type"), get("$.value", "double").alias("last_value"), get("$.k", "int").alias("last_k"),
        get("$.latestEventId", "string").cast("long").alias("latest_event_id"), get("$.updatedAt", "string").alias("updated_at"),
        get("$.firstEventTimestamp", "string").alias("first_event_at"), get("$.sequence", "long").alias("sequence"),
    )


@query(_LATEST)
def view_aggregate_fold(spark, sf_dir):
    """The same view by the ordered fold, exact for every definition."""
    return _opened(folds.fold(_full_log(spark, sf_dir), activity_view()))


@query(_LATEST)
def streaming_view_aggregate(spark, sf_dir):
    """The same view kept by a stream of the log."""
    from fathomlog.streaming.folds import current_rows, fold_stream, run_available, scratch

    path = scratch(spark)
    _full_log(spark, sf_dir).write.parquet(f"{path}/log")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/log").schema).parquet(f"{path}/log")
    return _opened(current_rows(run_available(fold_stream(stream, activity_view()), path)))


# Table views over orders: O inserts, P updates, F removes, one row per customer.

_ORDERS = """o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey, o_custkey AS row_key, o_orderstatus AS status,
    o_totalprice AS price, o_orderpriority AS priority FROM orders)"""
_TABLE = f"""{_ORDERS}, base AS (SELECT row_key, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(price, seq) AS price, arg_max(priority, seq) AS priority
    FROM o WHERE status <> 'P' GROUP BY row_key HAVING arg_max(status, seq) = 'O')"""


def _orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("at"))
    return el.with_positions(orders, "at", "o_orderkey", seconds=86400 * 7)


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("o_orderstatus") == "O", "insert").when(F.col("o_orderstatus") == "P", "update").otherwise("remove")
    log = _orders_log(spark, sf_dir)
    # An update carries the priority alone.
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return log.select(F.col("o_custkey").alias("row_key"), "sequence_number", op.alias("op"), price.alias("price"), F.col("o_orderpriority").alias("priority"))


@query(f"WITH {_TABLE} SELECT row_key, price, priority, seq AS sequence FROM base")
def view_table_insert_remove(spark, sf_dir):
    return folds.latest_rows(_operations(spark, sf_dir).where("op <> 'update'"), ["price", "priority"])


@query(f"""WITH {_TABLE}, u AS (SELECT o.row_key, max(o.seq) AS seq, arg_max(o.priority, o.seq) AS priority FROM o JOIN base b ON o.row_key = b.row_key AND o.seq > b.seq
    WHERE o.status = 'P' GROUP BY o.row_key)
    SELECT b.row_key, b.price, coalesce(u.priority, b.priority) AS priority, coalesce(u.seq, b.seq) AS sequence FROM base b LEFT JOIN u ON b.row_key = u.row_key""")
def view_table_update(spark, sf_dir):
    return folds.latest_rows(_operations(spark, sf_dir), ["price", "priority"])


@query(f"""WITH RECURSIVE {_ORDERS}, n AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY seq) AS i FROM o),
    f AS (SELECT row_key, i, CASE WHEN status = 'O' THEN priority END AS priority, CASE WHEN status = 'O' THEN price END AS price,
            CASE WHEN status = 'O' THEN seq END AS sequence FROM n WHERE i = 1
        UNION ALL SELECT n.row_key, n.i,
            CASE WHEN n.status = 'O' THEN n.priority WHEN f.sequence IS NULL OR f.priority <> n.priority OR n.status = 'P' THEN f.priority END,
            CASE WHEN n.status = 'O' THEN n.price WHEN f.sequence IS NULL OR f.priority <> n.priority THEN f.price WHEN n.status = 'P' THEN n.price END,
            CASE WHEN n.status = 'O' THEN n.seq WHEN f.sequence IS NULL OR f.priority <> n.priority THEN f.sequence WHEN n.status = 'P' THEN n.seq END
        FROM f JOIN n ON f.row_key = n.row_key AND n.i = f.i + 1),
    z AS (SELECT *, max(i) OVER (PARTITION BY row_key) AS m FROM f)
    SELECT row_key, price, priority, sequence FROM z WHERE i = m AND sequence IS NOT NULL""")
def view_table_match_field(spark, sf_dir):
    """Updates and removals count only for a row of their own priority, so each customer's orders are folded in turn."""
    log = _orders_log(spark, sf_dir)
    data = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")))
    log = log.select(
        "sequence_number", F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_custkey").cast("string").alias("aggregate_id"), F.lit("customer").alias("aggregate_type"),
        F.lit("order").alias("entry_type"), F.lit(None).cast(el.VERSION).alias("entry_type_version"), F.col("o_orderstatus").alias("event_type"), data.alias("data"), F.col("at").alias("client_timestamp"),
    )
    view = TableView("orders", Interest(), frozenset("O"), frozenset("F"), AggregateId(), WholePayload(), updates=frozenset("P"), update_data=WholePayload(), match_field="priority")
    v = F.parse_json("row_json")
    return folds.fold(log, view).where("row_json is not null").select(
        F.col("row_key").cast("long").alias("row_key"), F.try_variant_get(v, "$.price", "double").alias("price"), F.try_variant_get(v, "$.priority", "string").alias("priority"), F.col("position").alias("sequence")
    )


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey FROM orders),
    w AS (SELECT CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) AS row_key, o.seq,
            max(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) AS op, max(l_quantity) FILTER (l_returnflag <> 'R') AS quantity
        FROM lineitem JOIN o ON l_orderkey = o.o_orderkey GROUP BY 1, 2),
    z AS (SELECT row_key, max(seq) AS sequence, arg_max(op, seq) AS op, arg_max(quantity, seq) AS quantity FROM w GROUP BY row_key)
    SELECT row_key, quantity, sequence FROM z WHERE op = 1""")
def view_table_listed_removals(spark, sf_dir):
    """An order inserts a row per line sold and removes the rows that its returns list, returns last."""
    log = _orders_log(spark, sf_dir).select("o_orderkey", "sequence_number")
    lines = _t(spark, sf_dir, "lineitem").join(log, F.col("l_orderkey") == F.col("o_orderkey"))
    key = composite_key(F.col("l_partkey"), F.col("l_suppkey"))
    returned = F.col("l_returnflag") == "R"
    writes = lines.groupBy(key.alias("row_key"), "sequence_number").agg(F.max(returned).alias("gone"), F.max(F.when(~returned, F.col("l_quantity"))).alias("quantity"))
    ops = writes.select("row_key", "sequence_number", F.when(F.col("gone"), "remove").otherwise("insert").alias("op"), "quantity")
    return folds.latest_rows(ops, ["quantity"])


# Promotion: 1.0 has value; 1.1 adds k = 0; 2.0 renames value to amount; 2.1 adds unit = 'x'.


def promotions():
    from fathomlog.plans.promotion import Default, Promotions, Rename

    out = Promotions()
    out.register("amounts", "user_activity", (1, 0), (1, 1), (Default("k", 0),))
    out.register("amounts", "user_activity", (1, 1), (2, 0), (Rename("value", "amount"),))
    out.register("amounts", "user_activity", (2, 0), (2, 1), (Default("unit", "x"),))
    return out


@query("""WITH {LOG} SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0 ELSE k END AS k, value AS amount, 'x' AS unit FROM log""")
def promotion_chain(spark, sf_dir):
    """Payloads of three versions, all read as 2.1. The chains run as columns, since no row is looked at."""
    from fathomlog.plans.promotion import Default, Rename

    registry = promotions()
    log = el.events_log(spark, sf_dir)
    versions = {0: (1, 0), 1: (1, 1), 2: (2, 0)}
    # The payload as each version has it.
    has = {0: {"value": F.col("value")}, 1: {"value": F.col("value"), "k": F.col("k")}, 2: {"amount": F.col("value"), "k": F.col("k")}}
    out: dict[str, Column] = {}
    for i, version in versions.items():
        fields = dict(has[i])
        for step in registry.chain("amounts", "user_activity", version, (2, 1)):
            if isinstance(step, Rename):
                fields[step.target] = fields.pop(step.source)
            elif isinstance(step, Default):
                fields.setdefault(step.name, F.lit(step.value))
        for name, value in fields.items():
            held = out.get(name)
            mine = F.col("event_id") % 3 == i
            out[name] = F.when(mine, value) if held is None else held.when(mine, value)
    return log.select("event_id", *(out[n].alias(n) for n in ("k", "amount", "unit")))


# Audit and retention, on a context made from the events.

_CONTEXT = """c AS (SELECT event_id, ts + to_minutes(CAST(event_id % 7 AS INTEGER)) AS recorded_at, CASE WHEN event_id % 5 = 0 THEN 'fe80:1:2:' || CAST(event_id AS VARCHAR) || '::9' ELSE
    '10.' || CAST(event_id % 4 AS VARCHAR) || '.1.' || CAST(event_id % 256 AS VARCHAR) END AS ip_address, 'agent-' || CAST(event_id % 3 AS VARCHAR) AS user_agent,
    CASE WHEN event_id % 11 = 0 THEN ts END AS redacted_at FROM events WHERE event_id % 2 = 0)"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").where("event_id % 2 = 0")
    return events.select(
        "event_id", F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(event_id % 7 as int), 0)").alias("recorded_at"),
        F.expr("if(event_id % 5 = 0, concat('fe80:1:2:', event_id, '::9'), concat('10.', event_id % 4, '.1.', event_id % 256))").alias("ip_address"),
        F.expr("concat('agent-', event_id % 3)").alias("user_agent"), F.expr("if(event_id % 11 = 0, ts, null)").alias("redacted_at"),
    )


@query("WITH {LOG}, " + _CONTEXT + """ SELECT log.event_id, seq, user_id, recorded_at, ip_address FROM log JOIN c ON log.event_id = c.event_id
    WHERE recorded_at >= TIMESTAMP '2024-01-02' AND recorded_at <= TIMESTAMP '2024-06-01'
    AND (recorded_at < TIMESTAMP '2024-03-01 12:00:00' OR (recorded_at = TIMESTAMP '2024-03-01 12:00:00' AND log.event_id < 5000))
    ORDER BY recorded_at DESC, log.event_id DESC LIMIT 51""")
def audit_join_page(spark, sf_dir):
    page = retention.audit_page(
        el.events_log(spark, sf_dir), _context(spark, sf_dir), start=datetime(2024, 1, 2), end=datetime(2024, 6, 1), limit=50, cursor=(datetime(2024, 3, 1, 12), 5000)
    )
    return page.select("event_id", _seq(), F.col("aggregate_id").alias("user_id"), "recorded_at", "ip_address")


_OLD = "(recorded_at <= TIMESTAMP '2024-12-01' - INTERVAL 90 DAY AND redacted_at IS NULL)"


@query("WITH " + _CONTEXT + f""" SELECT event_id, recorded_at, CASE WHEN {_OLD} THEN CASE WHEN ip_address LIKE '%:%' THEN 'fe80:1:2::'
    ELSE regexp_replace(ip_address, '\\.\\d+$', '.0') END ELSE ip_address END AS ip_address, CASE WHEN NOT {_OLD} THEN user_agent END AS user_agent
    FROM c WHERE NOT recorded_at <= TIMESTAMP '2024-12-01' - INTERVAL 320 DAY""")
def retention_sweep(spark, sf_dir):
    left, _ = retention.sweep(_context(spark, sf_dir), datetime(2024, 12, 1), full_days=90, truncated_days=230)
    return left.select("event_id", "recorded_at", "ip_address", "user_agent")


@query("WITH " + _CONTEXT + f""" SELECT count(*) FILTER ({_OLD}) AS truncated, count(*) FILTER (recorded_at <= TIMESTAMP '2024-12-01' - INTERVAL 320 DAY) AS deleted FROM c""")
def retention_counts(spark, sf_dir):
    return retention.sweep(_context(spark, sf_dir), datetime(2024, 12, 1), full_days=90, truncated_days=230)[1]


# Chains: each order is a database, its lines the events of its chain, with anomalies by key.

_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)"
_LINES = f"""l00 AS (SELECT l_orderkey AS origin_db, CAST({_PLACE} AS INTEGER) AS pos, l_partkey AS partkey FROM lineitem),
    l0 AS (SELECT *, sha256(CAST(origin_db AS VARCHAR) || '|' || CAST(pos AS VARCHAR)) AS event_hash, CAST(origin_db AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS event_id FROM l00),
    l1 AS (SELECT *, lag(event_hash) OVER (PARTITION BY origin_db ORDER BY pos) AS before FROM l0),
    lines AS (SELECT origin_db, event_id, event_hash, partkey, pos AS sequence_number,
        CASE WHEN origin_db % 17 = 0 AND pos = 3 THEN 2 ELSE pos END AS origin_position,
        CASE WHEN origin_db % 13 = 0 AND pos = 4 THEN 'gone' WHEN origin_db % 19 = 0 AND pos = 3 THEN NULL ELSE before END AS previous_event_hash,
        CASE WHEN origin_db % 11 = 0 AND pos = 2 THEN 'bad' ELSE before END AS previous_ingest_hash FROM l1)"""


#: Lines that a task takes: its memory doesn't grow with the table.
PART_LINES = 1 << 18


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // PART_LINES))
    # Places have no gaps, so the hash of the line before follows from its place.
    before = F.when(F.col("pos") > 1, F.sha2(F.concat_ws("|", "origin_db", F.col("pos") - 1), 256))
    rows = (
        # Renamed before it deals the lines out and others after, so that what is by origin needs no other deal and no column moves twice.
        lines.withColumnRenamed("l_orderkey", "origin_db").repartition(parts, "origin_db").withColumn("pos", F.expr(_PLACE.replace("l_orderkey", "origin_db")))
        .select("origin_db", "pos", F.col("l_partkey").alias("partkey"))
        .select("*", F.sha2(F.concat_ws("|", "origin_db", "pos"), 256).alias("event_hash"), F.concat_ws("-", "origin_db", "pos").alias("event_id"))
        .withColumn("before", before)
    )
    return rows.select(
        "origin_db", "event_id", "event_hash", "partkey", F.col("pos").alias("sequence_number"), F.col("pos").alias("ingest_sequence_number"), F.col("event_hash").alias("sealed_hash"),
        F.expr("if(origin_db % 17 = 0 and pos = 3, 2, pos)").alias("origin_position"),
        F.expr("case when origin_db % 13 = 0 and pos = 4 then 'gone' when origin_db % 19 = 0 and pos = 3 then null else before end").alias("previous_event_hash"),
        F.expr("if(origin_db % 11 = 0 and pos = 2, 'bad', before)").alias("previous_ingest_hash"),
        F.col("origin_db").alias("held_as_authored_by"), F.col("partkey").alias("aggregate_id"),
    )


@query(f"""WITH {_LINES} SELECT 'storage_link_break' AS kind, event_id, 'previous_ingest_hash' AS detail FROM (SELECT *, lag(event_hash) OVER (PARTITION BY origin_db ORDER BY sequence_number) AS b,
    lag(sequence_number) OVER (PARTITION BY origin_db ORDER BY sequence_number) AS p FROM lines)
    WHERE (sequence_number = 1 AND previous_ingest_hash IS NOT NULL) OR (sequence_number > 1 AND p = sequence_number - 1 AND previous_ingest_hash IS DISTINCT FROM b)""")
def chain_links(spark, sf_dir):
    return chain.storage_link_break(_lines(spark, sf_dir), chain=["origin_db"]).select("kind", "event_id", "detail")


@query(f"""WITH {_LINES}, held AS (SELECT origin_db, sequence_number AS p FROM lines WHERE (origin_db + sequence_number) % 13 <> 0),
    span AS (SELECT origin_db, min(p) AS a, max(p) AS b FROM held GROUP BY origin_db)
    SELECT origin_db, x.g AS missing FROM span, LATERAL (SELECT unnest(range(a, b + 1)) AS g) x WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.origin_db = span.origin_db AND held.p = x.g)""")
def chain_gaps(spark, sf_dir):
    log = _lines(spark, sf_dir).where("(origin_db + sequence_number) % 13 <> 0").withColumn("sequence_number", F.col("sequence_number").cast("long"))
    return chain.sequence_missing(log, chain=["origin_db"])


@query("WITH {LOG}, held AS (SELECT seq FROM log WHERE event_id % 29 <> 0) SELECT seq AS missing FROM log WHERE event_id % 29 = 0 AND seq > (SELECT min(seq) FROM held) AND seq < (SELECT max(seq) FROM held)")
def log_gaps(spark, sf_dir):
    return chain.sequence_missing(el.events_log(spark, sf_dir).where("event_id % 29 <> 0"))


@query(f"""WITH {_LINES} SELECT e.event_id, CASE WHEN p.event_hash IS NULL THEN 'dangling' WHEN p.origin_db <> e.origin_db THEN 'other_origin' ELSE 'not_earlier' END AS detail
    FROM lines e LEFT JOIN lines p ON e.previous_event_hash = p.event_hash WHERE e.previous_event_hash IS NOT NULL
    AND (p.event_hash IS NULL OR p.origin_db <> e.origin_db OR p.origin_position >= e.origin_position)""")
def chain_predecessors(spark, sf_dir):
    log = _lines(spark, sf_dir).withColumn("held_as_authored_by", F.lit("here"))
    return chain.predecessor_break(log, "here").select("event_id", "detail")


@query(f"WITH {_LINES} SELECT origin_db, origin_position, count(DISTINCT event_id) AS events FROM lines GROUP BY 1, 2 HAVING count(DISTINCT event_id) > 1")
def chain_positions_reused(spark, sf_dir):
    return chain.positions_reused(_lines(spark, sf_dir))


@query(f"""WITH {_LINES} SELECT origin_db, previous_event_hash, min(origin_position) AS lowest_position, count(DISTINCT event_id) AS successors FROM lines
    GROUP BY 1, 2 HAVING count(DISTINCT origin_position) > 1 AND count(DISTINCT event_id) > 1""")
def chain_forks(spark, sf_dir):
    return chain.forks(_lines(spark, sf_dir))


_CAUSAL = """{LOG}, c AS (SELECT seq, event_id, user_id, event_type = 'purchase' AS eligible, max(CASE WHEN event_type = 'purchase' THEN seq END)
    OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_seq FROM log),
    d AS (SELECT c.*, p.event_id AS due FROM c LEFT JOIN log p ON c.parent_seq = p.seq)"""


@query(f"WITH {_CAUSAL} SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(due AS VARCHAR) AS detail FROM d WHERE due IS NOT NULL AND event_id % 23 = 0")
def chain_parents_stamped(spark, sf_dir):
    """Parents are emptied on some events; those are found."""
    log = el.events_log(spark, sf_dir)
    eligible = F.col("event_type") == "purchase"
    due = chain.stamped_parent(eligible, F.struct(F.col("event_id").cast("string").alias("event_id"), F.lit("h").alias("event_hash")))
    none = F.array().cast("array<struct<event_id:string,event_hash:string>>")
    parents = F.when(F.col("due").isNull() | (F.col("event_id") % 23 == 0), none).otherwise(F.array("due"))
    log = log.withColumn("due", due).withColumn("causal", F.struct(F.lit("version").alias("kind"), eligible.alias("eligible"), parents.alias("parents"))).withColumn("sealed_hash", F.lit("h"))
    return chain.parents_not_stamped(log.drop("due"), F.lit(True)).select("event_id", "detail")


@query(f"""WITH {_CAUSAL} SELECT CAST(d.event_id AS VARCHAR) AS event_id, CAST(p.event_id AS VARCHAR) || ':' ||
    CASE WHEN d.event_id % 37 = 0 THEN 'held_under_other_hash' WHEN p.user_id <> d.user_id THEN 'other_aggregate' WHEN p.event_id % 31 = 0 THEN 'annotation' ELSE 'ineligible' END AS detail
    FROM d JOIN log p ON p.event_id = CASE WHEN d.event_id % 41 = 0 THEN d.event_id - 1 ELSE d.due END
    WHERE d.event_id % 37 = 0 OR p.user_id <> d.user_id OR p.event_id % 31 = 0 OR p.event_type <> 'purchase'""")
def chain_parent_invalid(spark, sf_dir):
    log = el.events_log(spark, sf_dir)
    eligible = F.col("event_type") == "purchase"
    due = chain.stamped_parent(eligible, F.col("event_id"))
    parent = F.when(F.col("event_id") % 41 == 0, F.col("event_id") - 1).otherwise(F.col("due"))
    stated = F.when(F.col("event_id") % 37 == 0, "bad").otherwise("h")
    listed = F.when(F.col("parent").isNotNull(), F.array(F.struct(F.col("parent").cast("string").alias("event_id"), stated.alias("event_hash"))))
    kind = F.when(F.col("event_id") % 31 == 0, "annotation").otherwise("version")
    log = log.withColumn("due", due).withColumn("parent", parent).withColumn("causal", F.struct(kind.alias("kind"), eligible.alias("eligible"), listed.alias("parents")))
    return chain.parent_invalid(log.withColumn("sealed_hash", F.lit("h"))).select("event_id", "detail")


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","id":' || CAST(event_id AS VARCHAR) || ',"user":' || CAST(user_id AS VARCHAR) || '}') AS event_hash FROM events""")
def event_hashes(spark, sf_dir):
    """Hashes of canonical JSON; the members come in another order."""
    events = _t(spark, sf_dir, "events")
    return events.select("event_id", canonical_sha256(F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_id").alias("id"), "event_type"))).alias("event_hash"))


@query(f"WITH {_LINES} SELECT partkey AS aggregate_id, origin_db, max(origin_position) AS max_position FROM lines GROUP BY 1, 2")
def authorship_index(spark, sf_dir):
    return findings.authorship(_lines(spark, sf_dir))


@query(f"WITH {_LINES} SELECT origin_db, previous_event_hash, min(origin_position) AS lowest_position FROM lines GROUP BY 1, 2")
def lowest_fork_position(spark, sf_dir):
    return findings.lowest_fork(_lines(spark, sf_dir))


_MARKED = f"""{_LINES}, a AS (SELECT partkey AS aggregate_id, origin_db, max(origin_position) AS m FROM lines GROUP BY 1, 2),
    f AS (SELECT 'reuse-' || CAST(origin_db AS VARCHAR) AS finding_id, origin_db, origin_position AS threshold, NULL AS aggregate_id FROM lines GROUP BY origin_db, origin_position HAVING count(DISTINCT event_id) > 1
        UNION ALL SELECT 'link-' || event_id, origin_db, NULL, partkey FROM lines WHERE previous_ingest_hash = 'bad'),
    m AS (SELECT a.aggregate_id, finding_id FROM f JOIN a ON f.origin_db = a.origin_db AND (a.m >= f.threshold OR f.aggregate_id = a.aggregate_id))"""


@query(f"WITH {_MARKED} SELECT aggregate_id, count(DISTINCT finding_id) AS findings, min(finding_id) AS first_finding, max(finding_id) AS last_finding FROM m GROUP BY aggregate_id")
def finding_marks(spark, sf_dir):
    log = _lines(spark, sf_dir)
    reused = chain.positions_reused(log).select(F.concat(F.lit("reuse-"), "origin_db").alias("finding_id"), F.lit("position_reused").alias("kind"), "origin_db", F.lit(None).cast("long").alias("aggregate_id"), F.col("origin_position").alias("threshold"))
    broken = log.where("previous_ingest_hash = 'bad'").select(F.concat(F.lit("link-"), "event_id").alias("finding_id"), F.lit("storage_link_break").alias("kind"), "origin_db", "aggregate_id", F.lit(None).cast("int").alias("threshold"))
    marked = findings.marks(reused.unionByName(broken), findings.authorship(log))
    return marked.select("aggregate_id", F.size("finding_ids").cast("long").alias("findings"), F.element_at("finding_ids", 1).alias("first_finding"), F.element_at("finding_ids", -1).alias("last_finding"))


@query("""WITH RECURSIVE s AS (SELECT n_nationkey AS origin_db, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey - 1 END AS predecessor FROM nation),
    r AS (SELECT origin_db, origin_db AS member FROM s UNION SELECT r.origin_db, s.predecessor FROM r JOIN s ON r.member = s.origin_db WHERE s.predecessor IS NOT NULL)
    SELECT origin_db, member FROM r""")
def succession_lineage(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("origin_db"), F.expr("if(n_nationkey % 5 > 0, n_nationkey - 1, null)").alias("predecessor"), F.col("n_nationkey").alias("sequence_number"))
    return findings.lineage(rows)


# Access: customers in nations in regions.


def _classes() -> access.ScopeClasses:
    return access.ScopeClasses(access.ScopeClass("region"), access.ScopeClass("nation", "region", "nations"), access.ScopeClass("customer", "nation", "customers"))


def _indexes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    text = lambda c: F.col(c).cast("string")
    return {
        "nations": _t(spark, sf_dir, "nation").select(text("n_nationkey").alias("key"), text("n_regionkey").alias("parent")),
        "customers": _t(spark, sf_dir, "customer").select(text("c_custkey").alias("key"), text("c_nationkey").alias("parent")),
    }


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("value"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS value, 'customer' AS class, CAST(c_custkey AS VARCHAR) AS ancestor FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR) FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def scope_resolve_up(spark, sf_dir):
    return access.resolve_up(_customers(spark, sf_dir), _classes(), _indexes(spark, sf_dir), "customer")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS value, CAST(c_custkey AS VARCHAR) AS descendant FROM customer JOIN nation ON c_nationkey = n_nationkey")
def scope_expand_down(spark, sf_dir):
    regions = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("value"))
    return access.expand_down(regions, _classes(), _indexes(spark, sf_dir), "region", "customer")


_GRANTS = """g AS (SELECT 'reader' AS role, 'read' AS permission UNION ALL SELECT 'editor', 'read' UNION ALL SELECT 'editor', 'edit'),
    a AS (SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 2 = 0 THEN 'reader' ELSE 'editor' END AS role,
        CASE s_suppkey % 4 WHEN 0 THEN 'region' WHEN 1 THEN 'nation' WHEN 2 THEN 'nation' ELSE NULL END AS scope_class,
        CASE s_suppkey % 4 WHEN 0 THEN CAST(s_nationkey % 5 AS VARCHAR) WHEN 1 THEN CAST(s_nationkey AS VARCHAR) END AS scope_value,
        s_suppkey % 4 = 2 AS any_value, s_suppkey % 4 = 3 AS any_class FROM supplier)"""


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    return _t(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("user_id"), F.when(F.col("s_suppkey") % 2 == 0, "reader").otherwise("editor").alias("role"),
        F.when(k == 0, "region").when(k < 3, "nation").alias("scope_class"),
        F.when(k == 0, (F.col("s_nationkey") % 5).cast("string")).when(k == 1, F.col("s_nationkey").cast("string")).alias("scope_value"),
        (k == 2).alias("any_value"), (k == 3).alias("any_class"),
    )


def _grants(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('reader', 'read'), ('editor', 'read'), ('editor', 'edit') AS t(role, permission)")


@query("WITH " + _GRANTS + """, q AS (SELECT o_orderkey AS request_id, o_orderkey % (SELECT count(*) FROM supplier) + 1 AS user_id, CASE WHEN o_orderkey % 2 = 1 THEN 'reader' ELSE 'editor' END AS role,
        CASE WHEN o_orderkey % 3 = 0 THEN 'edit' ELSE 'read' END AS permission, o_custkey FROM orders)
    SELECT request_id, coalesce(bool_or(g.role IS NOT NULL AND a.user_id IS NOT NULL AND (a.any_class OR a.any_value OR (a.scope_class = 'nation' AND a.scope_value = CAST(c_nationkey AS VARCHAR))
        OR (a.scope_class = 'region' AND a.scope_value = CAST(n_regionkey AS VARCHAR)))), false) AS allowed
    FROM q LEFT JOIN g ON q.role = g.role AND q.permission = g.permission LEFT JOIN a ON q.user_id = a.user_id AND q.role = a.role
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY request_id""")
def authorize_batch(spark, sf_dir):
    users = _t(spark, sf_dir, "supplier").count()
    requests = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % users + 1).alias("user_id"), F.when(F.col("o_orderkey") % 2 == 1, "reader").otherwise("editor").alias("role"),
        F.when(F.col("o_orderkey") % 3 == 0, "edit").otherwise("read").alias("permission"), F.lit("customer").alias("scope_class"), F.col("o_custkey").cast("string").alias("scope_value"),
    )
    up = access.resolve_up(_customers(spark, sf_dir), _classes(), _indexes(spark, sf_dir), "customer")
    containment = up.select(F.lit("customer").alias("class"), "value", F.col("class").alias("ancestor_class"), "ancestor")
    return access.decide(requests, _assignments(spark, sf_dir), _grants(spark), containment)


@query("WITH " + _GRANTS + """ SELECT user_id, a.role, (SELECT string_agg(permission, ',' ORDER BY permission) FROM g WHERE g.role = a.role) AS permissions,
    CASE WHEN any_class THEN '*' WHEN any_value THEN scope_class || ':*' ELSE scope_class || ':' || scope_value END AS scopes FROM a""")
def effective_permissions(spark, sf_dir):
    out = access.effective_permissions(_assignments(spark, sf_dir), _grants(spark))
    return out.select("user_id", "role", F.array_join("permissions", ",").alias("permissions"), F.array_join("scopes", ",").alias("scopes"))


@query("""SELECT c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_custkey % 2 = 0""")
def view_narrowed(spark, sf_dir):
    """A view's rows that an assignment to a region allows and a subscriber asks for."""
    under = access.expand_down(spark.sql("SELECT '2' AS value"), _classes(), _indexes(spark, sf_dir), "region", "customer").select(F.col("descendant").cast("long").alias("key"))
    customers = _t(spark, sf_dir, "customer")
    return access.narrow(customers, "c_custkey", under, customers.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"))).select("c_custkey", "c_nationkey")


@query("""WITH s AS (SELECT 'role' || CAST(n_regionkey AS VARCHAR) AS role, 'nation' || CAST(n_nationkey AS VARCHAR) AS permission FROM nation WHERE n_nationkey % 3 <> 0),
    h AS (SELECT 'role' || CAST(n_regionkey AS VARCHAR) AS role, 'nation' || CAST(n_nationkey AS VARCHAR) AS permission FROM nation WHERE n_nationkey % 2 = 0)
    SELECT *, 'missing' AS state FROM (SELECT * FROM s EXCEPT SELECT * FROM h) UNION ALL SELECT *, 'drift' FROM (SELECT * FROM h EXCEPT SELECT * FROM s)""")
def seed_diff(spark, sf_dir):
    grants = _t(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("role"), "n_regionkey").alias("role"), F.concat(F.lit("nation"), "n_nationkey").alias("permission"))
    return access.seed_diff(grants.where("n_nationkey % 3 <> 0"), grants.where("n_nationkey % 2 = 0"))


# Delivery.

_ADMIT = """{LOG}, d AS (SELECT *, event_type IN ('purchase', 'click') AND ts >= TIMESTAMP '2024-01-10' AS due, ts > TIMESTAMP '2024-02-10' AS late FROM log),
    w AS (SELECT seq, event_id, user_id, CASE WHEN due THEN 'admitted' ELSE 'skipped' END AS decision FROM d WHERE seq < coalesce((SELECT min(seq) FROM d WHERE due AND late), 9223372036854775807))"""


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = el.events_log(spark, sf_dir)
    interest = Interest(event_types=frozenset({"purchase", "click"})).condition(log)
    return delivery.admit(log, interest, start=datetime(2024, 1, 10), upper=datetime(2024, 2, 10))


@query(f"WITH {_ADMIT} SELECT seq, event_id, decision FROM w")
def delivery_admission(spark, sf_dir):
    return _admitted(spark, sf_dir).select(_seq(), "event_id", "decision")


@query(f"WITH {_ADMIT} SELECT seq, event_id, CAST(floor((row_number() OVER (ORDER BY seq) - 1) / 25) AS BIGINT) AS batch FROM w WHERE decision = 'admitted'")
def delivery_batches(spark, sf_dir):
    return delivery.batches(_admitted(spark, sf_dir).where("decision = 'admitted'"), 25).select(_seq(), "event_id", "batch")


# Runs of one type, three events to a batch at most: a batch ends at the first event of another type.
@query(f"""WITH {_ADMIT}, a AS (SELECT w.seq, e.event_type AS t, row_number() OVER (ORDER BY w.seq) AS i, lag(e.event_type) OVER (ORDER BY w.seq) AS before FROM w JOIN log e ON e.seq = w.seq WHERE decision = 'admitted'),
    r AS (SELECT *, max(CASE WHEN before IS DISTINCT FROM t THEN i END) OVER (ORDER BY i) AS run FROM a)
    SELECT seq, t AS event_type, CAST(sum(CASE WHEN (i - run) % 3 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY i) - 1 AS BIGINT) AS batch FROM r""")
def delivery_batches_by_key(spark, sf_dir):
    return delivery.batches(_admitted(spark, sf_dir).where("decision = 'admitted'"), 3, "event_type").select(_seq(), "event_type", "batch")


@query(f"""WITH RECURSIVE {_ADMIT}, a AS (SELECT w.seq, e.event_type AS t, row_number() OVER (ORDER BY w.seq) AS i, CAST(length(e.event_type) + e.event_id % 50 AS BIGINT) AS size FROM w JOIN log e ON e.seq = w.seq WHERE decision = 'admitted'),
    p AS MATERIALIZED (SELECT *, sum(size) OVER (ORDER BY i) AS total, coalesce(max(CASE WHEN t = 'purchase' THEN i END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS last_purchase,
        coalesce(max(CASE WHEN t = 'click' THEN i END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS last_click FROM a),
    b AS (SELECT CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS start
        UNION ALL SELECT b.batch + 1, (SELECT min(x.i) FROM p x, p s WHERE s.i = b.start AND x.i > b.start
            AND (x.total - s.total + s.size > 400 OR CASE s.t WHEN 'purchase' THEN x.last_click ELSE x.last_purchase END > b.start))
        FROM b WHERE b.start IS NOT NULL)
    SELECT p.seq, p.t AS event_type, (SELECT max(b.batch) FROM b WHERE b.start <= p.i) AS batch FROM p""")
def delivery_batches_by_size(spark, sf_dir):
    """Batches of one type that weigh 400 at most."""
    weight = F.length("event_type") + F.col("event_id") % 50
    return delivery.batches(_admitted(spark, sf_dir).where("decision = 'admitted'"), key="event_type", weight=weight, most=400).select(_seq(), "event_type", "batch")


@query("""WITH {LOG}, typed AS (SELECT *, CASE WHEN event_id % 19 = 0 THEN 'system.security_finding' WHEN event_id % 23 = 0 THEN 'system.sender_succession' ELSE 'item' END AS entry_type FROM log)
    SELECT seq, event_id, entry_type FROM typed WHERE seq <= 4000 AND event_id % 3 <> 1
    AND CASE WHEN entry_type <> 'item' THEN event_id % 2 <> 0 ELSE event_type = 'view' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-08' END""")
def delivery_gap_replay(spark, sf_dir):
    """Own events alone; what every native sink gets is there whatever its time, unless it is queued."""
    i = F.col("event_id")
    log = el.events_log(spark, sf_dir).withColumn("entry_type", F.when(i % 19 == 0, "system.security_finding").when(i % 23 == 0, "system.sender_succession").otherwise("item"))
    queued = log.where(i % 2 == 0).select("event_id")
    gap = delivery.gap_replay(
        log, F.col("event_type") == "view", cursor=4000, start=datetime(2024, 1, 3), gap_upper=datetime(2024, 1, 8), own=i % 3 != 1, channel_wide=True, queued=queued
    )
    return gap.select(_seq(), "event_id", "entry_type")


_ITEMS = """i AS (SELECT o_custkey AS destination_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderkey AS first_sequence, o_orderdate,
    CASE WHEN o_orderkey % 7 = 0 THEN 'wedged' WHEN o_orderstatus = 'F' THEN 'sent' WHEN o_orderkey % 11 = 0 THEN 'tombstoned' END AS final_status FROM orders)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    status = F.when(F.col("o_orderkey") % 7 == 0, "wedged").when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderkey") % 11 == 0, "tombstoned")
    return _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("destination_id"), nth.alias("sequence_in_queue"), F.col("o_orderkey").alias("first_sequence"), status.alias("final_status"),
        F.col("o_orderdate").cast("timestamp").alias("enqueued_at"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct((F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 hour")).alias("attempted_at")))).otherwise(F.array().cast("array<struct<attempted_at:timestamp>>")).alias("attempts"),
        F.lit(1).alias("delivery_generation"), nth.alias("delivery_number"),
    )


@query(f"""WITH {_ITEMS}, h AS (SELECT destination_id, min(n) AS n FROM i WHERE final_status IS NULL OR final_status = 'wedged' GROUP BY 1)
    SELECT i.destination_id, CAST(i.n AS BIGINT) AS sequence_in_queue, first_sequence, final_status FROM i JOIN h ON i.destination_id = h.destination_id AND i.n = h.n""")
def queue_heads(spark, sf_dir):
    return delivery.queue_heads(_items(spark, sf_dir)).select("destination_id", F.col("sequence_in_queue").cast("long").alias("sequence_in_queue"), "first_sequence", "final_status")


@query(f"""WITH {_ITEMS}, h AS (SELECT destination_id, min(n) AS n FROM i WHERE final_status IS NULL OR final_status = 'wedged' GROUP BY 1)
    SELECT i.destination_id, CAST(i.n AS BIGINT) AS sequence_in_queue, CAST(o_orderdate AS TIMESTAMP) + CASE WHEN first_sequence % 2 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS wedged_at
    FROM i JOIN h ON i.destination_id = h.destination_id AND i.n = h.n WHERE final_status = 'wedged'""")
def queue_wedged(spark, sf_dir):
    return delivery.wedged(_items(spark, sf_dir)).select("destination_id", F.col("sequence_in_queue").cast("long").alias("sequence_in_queue"), "wedged_at")


@query(f"""WITH {_ITEMS} SELECT x.g AS delivery_number, EXISTS (SELECT 1 FROM i WHERE destination_id = 7 AND final_status = 'sent' AND n = x.g) AS retained
    FROM (SELECT unnest(range(2, 9)) AS g) x""")
def deliveries_missing(spark, sf_dir):
    return delivery.missing_deliveries(_items(spark, sf_dir), 7, 1, 1, 8)


@query("""WITH {LOG}, e AS (SELECT user_id AS item_id, epoch_us(ts) / 1e6 AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i,
        epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) / 1e6 AS gap FROM log WHERE event_type = 'error'),
    s AS (SELECT item_id, count(*) AS attempts, coalesce(sum(least(gap, least(60.0 * pow(5.0, i), 7200.0) * 1.1 + 30)), 0.0) AS spent FROM e GROUP BY item_id)
    SELECT item_id, attempts, round(spent, 3) AS spent_seconds, attempts >= 20 OR spent >= 86400 AS exhausted FROM s""")
def retry_budget(spark, sf_dir):
    errors = el.events_log(spark, sf_dir).where("event_type = 'error'").select(F.col("aggregate_id").alias("item_id"), F.col("client_timestamp").alias("attempted_at"))
    return delivery.retry_budget(errors, cadence=30.0).withColumn("spent_seconds", F.round("spent_seconds", 3))


# Ingest.

_IN = """held AS (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS h FROM events WHERE event_id % 3 = 0),
    inc AS (SELECT event_id, event_id AS arrival, sha256(CASE WHEN event_id % 9 = 0 THEN 'x' ELSE '' END || CAST(event_id AS VARCHAR)) AS h FROM events
        UNION ALL SELECT event_id, event_id + 10000000, sha256(CASE WHEN event_id % 20 = 0 THEN 'y' ELSE '' END || CAST(event_id AS VARCHAR)) FROM events WHERE event_id % 5 = 0)"""


@query(f"""WITH {_IN}, r AS (SELECT inc.*, held.h AS hh, first_value(inc.h) OVER (PARTITION BY inc.event_id ORDER BY arrival) AS f, row_number() OVER (PARTITION BY inc.event_id ORDER BY arrival) AS n
        FROM inc LEFT JOIN held ON inc.event_id = held.event_id), k AS (SELECT *, coalesce(hh, CASE WHEN n > 1 THEN f END) AS known FROM r)
    SELECT event_id, arrival, CASE WHEN event_id % 77 = 0 THEN 'kept_in_finding' WHEN known = h THEN 'duplicate' WHEN known IS NOT NULL THEN 'kept_in_finding'
        WHEN event_id % 7 = 0 THEN 'ingested_with_finding' ELSE 'ingested' END AS outcome FROM k""")
def ingest_classify(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id")
    own = F.col("event_id").cast("string")
    held = events.where("event_id % 3 = 0").select("event_id", F.sha2(own, 256).alias("sealed_hash"))
    first = events.select("event_id", F.col("event_id").alias("arrival"), F.sha2(F.concat(F.when(F.col("event_id") % 9 == 0, "x").otherwise(""), own), 256).alias("sealed_hash"))
    again = events.where("event_id % 5 = 0").select("event_id", (F.col("event_id") + 10000000).alias("arrival"), F.sha2(F.concat(F.when(F.col("event_id") % 20 == 0, "y").otherwise(""), own), 256).alias("sealed_hash"))
    incoming = first.union(again).withColumn("has_finding", F.col("event_id") % 7 == 0)
    return ingest.classify(incoming, held, unstorable=F.col("event_id") % 77 == 0).select("event_id", "arrival", "outcome")


@query("""SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'data_format' WHEN event_id % 29 = 0 THEN 'entry_type' WHEN event_id % 23 = 0 THEN 'entry_type_version'
    WHEN event_type = 'signup' THEN 'event_type' END AS refusal FROM events""")
def ingest_admission(spark, sf_dir):
    incoming = _t(spark, sf_dir, "events").select(
        "event_id", "event_type", F.expr("if(event_id % 29 = 0, 'other', 'user_activity')").alias("entry_type"),
        F.expr("named_struct('major', if(event_id % 23 = 0, 3, 2), 'minor', 0)").alias("entry_type_version"), F.expr("named_struct('major', if(event_id % 31 = 0, 4, 3), 'minor', 1)").alias("lib_format_version"),
    )
    registry = spark.sql("SELECT 'user_activity' AS entry_type, 2 AS major, array('purchase', 'error', 'view', 'click') AS event_types")
    return ingest.admission(incoming, registry, 3).select("event_id", "refusal")


@query("""WITH RECURSIVE p AS (SELECT l_orderkey, l_partkey, """ + _PLACE + """ AS arrival FROM lineitem),
    d AS (SELECT CAST(l_orderkey AS VARCHAR) AS channel, arrival, CASE WHEN l_partkey % 9 = 0 AND arrival > 1 THEN arrival - 1 ELSE arrival END AS number, l_partkey % 25 = 0 AS bad FROM p),
    e AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY arrival) AS i FROM d),
    w AS (SELECT channel, i, arrival, number, CASE WHEN bad THEN 'hash_mismatch' WHEN number = 1 THEN 'accepted' ELSE 'out_of_sequence' END AS outcome, CASE WHEN NOT bad AND number = 1 THEN 1 ELSE 0 END AS last FROM e WHERE i = 1
        UNION ALL SELECT e.channel, e.i, e.arrival, e.number, CASE WHEN e.bad THEN 'hash_mismatch' WHEN e.number = w.last THEN 'represented' WHEN e.number = w.last + 1 THEN 'accepted' ELSE 'out_of_sequence' END,
            CASE WHEN NOT e.bad AND e.number = w.last + 1 THEN e.number ELSE w.last END FROM w JOIN e ON w.channel = e.channel AND e.i = w.i + 1)
    SELECT channel, CAST(arrival AS BIGINT) AS arrival, CAST(number AS BIGINT) AS delivery_number, outcome FROM w""")
def channel_accept(spark, sf_dir):
    number = F.expr("if(l_partkey % 9 = 0 and arrival > 1, arrival - 1, arrival)")
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.expr(_PLACE).alias("arrival"))
    rows = lines.select(F.col("l_orderkey").cast("string").alias("channel"), F.col("arrival").cast("long").alias("arrival"), number.cast("long").alias("delivery_number"), (F.col("l_partkey") % 25 == 0).alias("bad"))
    digest = lambda n: F.sha2(F.concat_ws("|", F.col("channel"), n), 256)
    rows = rows.withColumn("delivery_hash", digest(F.col("delivery_number"))).withColumn("previous_hash", F.when(F.col("delivery_number") > 1, digest(F.col("delivery_number") - 1)))
    return ingest.accept_deliveries(rows.withColumn("computed_hash", F.when(F.col("bad"), "other").otherwise(F.col("delivery_hash"))).drop("bad"))


@query("""SELECT o_custkey AS channel, max(o_orderkey) AS delivery_number, arg_max(o_totalprice, o_orderkey) AS size FROM orders GROUP BY o_custkey""")
def channel_listing(spark, sf_dir):
    return ingest.channels(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("delivery_number"), F.col("o_totalprice").alias("size")))


# Commands.


@query("""WITH {LOG}, c AS (SELECT seq, event_id, user_id, event_type, lag(event_type || '|' || CAST(k AS VARCHAR)) OVER (PARTITION BY user_id, event_type ORDER BY seq) AS b, event_type || '|' || CAST(k AS VARCHAR) AS x FROM log WHERE k IS NOT NULL)
    SELECT seq, event_id FROM c WHERE b IS NULL OR b <> x""")
def content_dedupe(spark, sf_dir):
    log = el.events_log(spark, sf_dir).where("k is not null")
    return commands.content_changes(log, F.concat_ws("|", "event_type", "k"), ("aggregate_id", "event_type")).select(_seq(), "event_id")


@query("""WITH c AS (SELECT event_id, event_type AS action, user_id AS principal, CASE WHEN event_id % 10 <> 0 THEN event_id % 50 END AS key, event_id % 4 AS input FROM events),
    h AS (SELECT DISTINCT event_type AS action, user_id AS principal, 3 AS key, 1 AS input FROM events WHERE user_id % 2 = 0),
    r AS (SELECT c.*, h.input AS hi, first_value(c.input) OVER w AS f, row_number() OVER w AS n FROM c LEFT JOIN h ON c.action = h.action AND c.principal = h.principal AND c.key = h.key
        WINDOW w AS (PARTITION BY c.action, c.principal, c.key ORDER BY event_id))
    SELECT event_id, CASE WHEN key IS NULL THEN 'run' WHEN coalesce(hi, CASE WHEN n > 1 THEN f END) IS NULL THEN 'run' WHEN coalesce(hi, f) = input THEN 'replay' ELSE 'idempotency_mismatch' END AS outcome FROM r""")
def command_idempotency(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    digest = lambda c: F.sha2(c.cast("string"), 256)
    asked = events.select("event_id", F.col("event_type").alias("action"), F.col("user_id").alias("principal"), F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 50).alias("key"), digest(F.col("event_id") % 4).alias("input_hash"), F.col("event_id").alias("arrival"))
    alive = events.where("user_id % 2 = 0").select(F.col("event_type").alias("action"), F.col("user_id").alias("principal")).distinct()
    held = alive.select("action", "principal", F.lit(3).cast("long").alias("key"), digest(F.lit(1)).alias("held_hash"), F.timestamp_seconds(F.lit(2_000_000_000)).alias("expires_at"))
    expired = alive.select("action", "principal", F.lit(4).cast("long").alias("key"), digest(F.lit(2)).alias("held_hash"), F.timestamp_seconds(F.lit(0)).alias("expires_at"))
    return commands.idempotency(asked, held.union(expired), F.timestamp_seconds(F.lit(1_700_000_000))).select("event_id", "outcome")


@query("SELECT event_id, 'failed at <path> for ' || event_type AS message FROM events")
def error_cleaning(spark, sf_dir):
    message = F.concat(F.lit("failed at /srv/app/"), "event_type", F.lit("/main.x for "), "event_type", F.lit("\n    at run (main:1)\n#0 main"))
    return _t(spark, sf_dir, "events").select("event_id", clean_error(message).alias("message"))


# Views that lag.

_CUT = "(SELECT max(seq) - 200 FROM log)"


def _cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, Column]:
    log = el.events_log(spark, sf_dir)
    return log, log.count() - 200, F.col("event_type") != "view"


@query("WITH {LOG} SELECT " + _CUT + " AS position, max(seq) AS head, count(*) FILTER (seq > " + _CUT + " AND event_type <> 'view') > 0 AS converging, count(DISTINCT CASE WHEN seq > " + _CUT + " AND event_type <> 'view' THEN user_id END) AS unsettled FROM log")
def view_currency(spark, sf_dir):
    log, position, interest = _cut(spark, sf_dir)
    return view_reads.currency(log, position, interest)


@query(f"""WITH {{LOG}}, rows AS (SELECT user_id, max(seq) AS sequence FROM log WHERE seq <= {_CUT} AND event_type <> 'view' GROUP BY 1),
    w AS (SELECT DISTINCT user_id FROM log WHERE seq > {_CUT} AND event_type <> 'view'), keys AS (SELECT DISTINCT user_id FROM log UNION SELECT -1)
    SELECT keys.user_id, CASE WHEN w.user_id IS NOT NULL THEN 'pending' WHEN rows.user_id IS NOT NULL THEN 'settled' ELSE 'absent' END AS state,
        CASE WHEN w.user_id IS NULL THEN sequence END AS sequence FROM keys LEFT JOIN rows ON keys.user_id = rows.user_id LEFT JOIN w ON keys.user_id = w.user_id""")
def view_pending_rows(spark, sf_dir):
    log, position, interest = _cut(spark, sf_dir)
    rows = log.where((F.col("sequence_number") <= position) & interest).groupBy(F.col("aggregate_id").alias("user_id")).agg(F.max("sequence_number").alias("sequence"))
    keys = log.select(F.col("aggregate_id").alias("user_id")).distinct().union(spark.sql("SELECT -1L"))
    return view_reads.read_states(keys, rows, log, position, interest, by_aggregate=True, key="user_id")


@query(f"""WITH {{LOG}}, rows AS (SELECT user_id, max(seq) AS sequence FROM log WHERE seq <= {_CUT} AND event_type <> 'view' GROUP BY 1 ORDER BY user_id LIMIT 40 OFFSET 10)
    SELECT * FROM rows WHERE user_id NOT IN (SELECT user_id FROM log WHERE seq > {_CUT} AND event_type <> 'view')""")
def view_page_converging(spark, sf_dir):
    log, position, interest = _cut(spark, sf_dir)
    rows = log.where((F.col("sequence_number") <= position) & interest).groupBy(F.col("aggregate_id").alias("user_id")).agg(F.max("sequence_number").alias("sequence"))
    return view_reads.read_rows(rows, log, position, interest, by_aggregate=True, key="user_id", limit=40, offset=10)


@query("""SELECT o_custkey AS row_key, o_orderpriority AS priority FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey) AND o_orderstatus = 'O' AND o_custkey % 3 = 0""")
def view_rows_where(spark, sf_dir):
    """Rows picked by a field of their JSON and by a list of keys."""
    last = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("row_key")).agg(F.max_by(F.struct("o_orderstatus", "o_orderpriority"), "o_orderkey").alias("r"))
    rows = last.select("row_key", F.to_json(F.struct(F.col("r.o_orderstatus").alias("status"), F.col("r.o_orderpriority").alias("priority"))).alias("row_json"))
    keys = _t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("row_key"))
    found = view_reads.by_keys(view_reads.match_fields(rows, {"status": "O"}), keys)
    return found.select("row_key", F.get_json_object("row_json", "$.priority").alias("priority"))


from fathomlog.plans import decision_queries  # noqa: E402, F401  (registers the rest)
