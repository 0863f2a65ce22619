"""Queries over corrections and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.folders import fresh_folder
from checks.registry import query, view
from gustledger.functions import timegrid as tg
from gustledger.operators import adjustments as J
from gustledger.operators.reconcile import align_columns, reconcile
from gustledger.sources import journal

NOW = "2024-02-01T00:00:00"
LIST = ["pos", "id", "alarm_code", "station_nr", "time_on", "time_off", "notes", "last_updated"]
LIST_SQL = ", ".join(LIST)
DATE_TEXT = "'%Y-%m-%d %H:%M:%S'"


def text_of(ts):
    return ts.cast("string")


# Corrections from orders: several per customer number, which is the alarm id.
def v_adjust(spark, d):
    o = V.table(spark, d, "orders")
    status = F.col("o_orderstatus")
    day_after = tg.plus(F.col("o_orderdate"), tg.timedelta(days=1))
    return o.select(
        F.col("o_orderkey").alias("pos"),
        F.col("o_custkey").alias("id"),
        (F.col("o_orderkey") % 97).alias("alarm_code"),
        (F.col("o_custkey") % 31).alias("station_nr"),
        F.when(status != "O", F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(text_of(F.col("o_orderdate")))).alias("time_on"),
        F.when(status != "F", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(text_of(day_after))).alias("time_off"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Auto-imputed from production data").otherwise(F.col("o_orderpriority")).alias("notes"),
        F.lit(None).cast("string").alias("last_updated"),
    )


view(
    "v_adjust",
    f"""SELECT o_orderkey AS pos, o_custkey AS id, o_orderkey % 97 AS alarm_code, o_custkey % 31 AS station_nr,
  CASE WHEN o_orderstatus <> 'O' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE strftime(o_orderdate, {DATE_TEXT}) END END AS time_on,
  CASE WHEN o_orderstatus <> 'F' THEN CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE strftime(o_orderdate + INTERVAL 1 DAY, {DATE_TEXT}) END END AS time_off,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Auto-imputed from production data' ELSE o_orderpriority END AS notes, CAST(NULL AS VARCHAR) AS last_updated FROM orders""",
)

view(
    "v_entries",
    """SELECT a."ID", a."TimeOff" AS raw_off, j.pos, try_strptime(j.time_on, '%Y-%m-%d %H:%M:%S') AS t_on, try_strptime(nullif(j.time_off, ''), '%Y-%m-%d %H:%M:%S') AS t_off,
  contains(j.notes, 'Auto-imputed') AND j.time_off IS NOT NULL AS auto
  FROM v_alarm a JOIN v_adjust j ON j.id = a."ID" """,
    "v_alarm", "v_adjust",
)
view(
    "v_judged",
    """SELECT *, auto AND (raw_off IS NOT NULL OR coalesce(count(t_off) OVER (PARTITION BY "ID" ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0) AS stale
  FROM v_entries""",
    "v_entries",
)


@query(
    "adjust_overlay",
    """SELECT a."ID", coalesce(n.t_on, a."TimeOn") AS "TimeOn", coalesce(f.t_off, a."TimeOff") AS "TimeOff" FROM v_alarm a
  LEFT JOIN (SELECT "ID", arg_max(t_on, pos) AS t_on FROM v_judged WHERE NOT stale AND t_on IS NOT NULL GROUP BY 1) n USING ("ID")
  LEFT JOIN (SELECT "ID", arg_max(t_off, pos) AS t_off FROM v_judged WHERE NOT stale AND t_off IS NOT NULL GROUP BY 1) f USING ("ID")""",
    ["v_alarm", "v_judged"],
)
def adjust_overlay(spark, d):
    return J.apply_adjustments(V.v_alarm(spark, d), v_adjust(spark, d)).select("ID", "TimeOn", "TimeOff")


@query("stale_adjustments", 'SELECT DISTINCT "ID" AS id FROM v_judged WHERE stale', ["v_judged"])
def stale_adjustments(spark, d):
    return J.stale_adjustments(V.v_alarm(spark, d), v_adjust(spark, d))


@query("notes_contains", "SELECT pos, contains(notes, 'Auto-imputed') AS automatic FROM v_adjust", ["v_adjust"])
def notes_contains(spark, d):
    return v_adjust(spark, d).select("pos", F.contains(F.col("notes"), F.lit(J.AUTOMATIC)).alias("automatic"))


# The list to edit: customers, then suppliers whose numbers repeat customer numbers.
def v_list(spark, d):
    c = V.table(spark, d, "customer").select(
        F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("alarm_code"),
        (F.col("c_custkey") % 20).alias("station_nr"), F.lit("2024-01-01 00:00:00").alias("time_on"),
        F.when(F.col("c_acctbal") > 0, "2024-01-02 00:00:00").alias("time_off"), F.col("c_mktsegment").alias("notes"),
        F.lit("2023-12-01T00:00:00").alias("last_updated"),
    )
    s = V.table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 100_000_000).alias("pos"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("alarm_code"),
        (F.col("s_suppkey") % 20).alias("station_nr"), F.lit(None).cast("string").alias("time_on"),
        F.lit("2024-01-03 00:00:00").alias("time_off"), F.col("s_name").alias("notes"), F.lit(None).cast("string").alias("last_updated"),
    )
    return c.unionByName(s)


view(
    "v_list",
    """SELECT c_custkey AS pos, c_custkey AS id, CAST(c_nationkey AS BIGINT) AS alarm_code, c_custkey % 20 AS station_nr, '2024-01-01 00:00:00' AS time_on,
  CASE WHEN c_acctbal > 0 THEN '2024-01-02 00:00:00' END AS time_off, c_mktsegment AS notes, '2023-12-01T00:00:00' AS last_updated FROM customer
  UNION ALL SELECT s_suppkey + 100000000, s_suppkey, CAST(s_nationkey AS BIGINT), s_suppkey % 20, NULL, '2024-01-03 00:00:00', s_name, NULL FROM supplier""",
)


def v_request(spark, d):
    o = V.table(spark, d, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return o.select(
        key.alias("pos"),
        V.div(key, 5).alias("id"),
        F.when(key % 13 != 0, key % 97).alias("alarm_code"),
        F.when(key % 11 != 0, key % 31).alias("station_nr"),
        F.when(key % 6 != 0, text_of(F.col("o_orderdate"))).alias("time_on"),
        text_of(F.col("o_orderdate")).alias("time_off"),
        F.col("o_orderpriority").alias("notes"),
        (status != "O").alias("set_time_on"),
        (status != "F").alias("set_time_off"),
        (F.col("o_orderpriority") != "1-URGENT").alias("set_notes"),
    )


view(
    "v_request",
    f"""SELECT o_orderkey AS pos, o_orderkey // 5 AS id, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 97 END AS alarm_code,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 31 END AS station_nr, CASE WHEN o_orderkey % 6 <> 0 THEN strftime(o_orderdate, {DATE_TEXT}) END AS time_on,
  strftime(o_orderdate, {DATE_TEXT}) AS time_off, o_orderpriority AS notes, o_orderstatus <> 'O' AS set_time_on, o_orderstatus <> 'F' AS set_time_off,
  o_orderpriority <> '1-URGENT' AS set_notes FROM orders""",
)
for _c in ("time_on", "time_off", "notes"):
    view(
        f"v_last_{_c}",
        f"SELECT id, {_c} AS value FROM v_request q WHERE set_{_c} AND pos = (SELECT max(pos) FROM v_request r WHERE r.id = q.id AND r.set_{_c})",
        "v_request",
    )
_FIELDS = ("time_on", "time_off", "notes")


def _latest(alias_id: str) -> str:
    return " ".join(f"LEFT JOIN v_last_{c} l_{c} ON l_{c}.id = {alias_id} AND TARGET" for c in _FIELDS)


_UPSERT = (
    "SELECT e.pos, e.id, e.alarm_code, e.station_nr, "
    + ", ".join(f"CASE WHEN l_{c}.id IS NOT NULL THEN l_{c}.value ELSE e.{c} END AS {c}" for c in _FIELDS)
    + f""", CASE WHEN e.last AND e.id IN (SELECT id FROM v_request) THEN '{NOW}' ELSE e.last_updated END AS last_updated
  FROM (SELECT *, pos = max(pos) OVER (PARTITION BY id) AS last FROM v_list) e {_latest("e.id").replace("TARGET", "e.last")}
  UNION ALL SELECT n.pos + (SELECT max(pos) + 1 FROM v_list), n.id, coalesce(n.alarm_code, 0), coalesce(n.station_nr, 0), l_time_on.value, l_time_off.value,
    CASE WHEN l_notes.id IS NOT NULL THEN l_notes.value ELSE '' END, '{NOW}'
  FROM (SELECT * FROM v_request q WHERE pos = (SELECT min(pos) FROM v_request r WHERE r.id = q.id) AND id NOT IN (SELECT id FROM v_list)) n
    {_latest("n.id").replace("TARGET", "true")}"""
)
_UPSERT_VIEWS = ["v_list", "v_request", "v_last_time_on", "v_last_time_off", "v_last_notes"]


@query("adjust_upsert", _UPSERT, _UPSERT_VIEWS)
def adjust_upsert(spark, d):
    return J.upsert_adjustments(v_list(spark, d), v_request(spark, d), NOW).select(*LIST)


# The same requests as two batches of a journal, with a compaction between; places in the list are the journal's own.
@query("adjust_journal", f"SELECT {', '.join(LIST[1:])} FROM ({_UPSERT}) u", _UPSERT_VIEWS)
def adjust_journal(spark, d):
    path, requests = fresh_folder(spark), v_request(spark, d)
    early = F.col("pos") < requests.agg(F.avg("pos")).scalar()
    journal.create(v_list(spark, d), path)
    journal.append(requests.where(early), path, NOW)
    journal.compact(spark, path)
    journal.append(requests.where(~early), path, NOW)
    return journal.read(spark, path).select(*LIST[1:])


def v_chosen(spark, d):
    return V.table(spark, d, "part").select((F.col("p_size") * 3).cast("long").alias("id"))


view("v_chosen", "SELECT p_size * 3 AS id FROM part")


@query(
    "adjust_bulk_update",
    f"""SELECT pos, id, alarm_code, station_nr, time_on, CASE WHEN id IN (SELECT id FROM v_chosen) THEN '2024-01-05 00:00:00' ELSE time_off END AS time_off,
  CASE WHEN id IN (SELECT id FROM v_chosen) THEN 'bulk' ELSE notes END AS notes, CASE WHEN id IN (SELECT id FROM v_chosen) THEN '{NOW}' ELSE last_updated END AS last_updated FROM v_list""",
    ["v_list", "v_chosen"],
)
def adjust_bulk_update(spark, d):
    return J.update_adjustments(v_list(spark, d), v_chosen(spark, d), NOW, time_off="2024-01-05 00:00:00", notes="bulk").select(*LIST)


@query("adjust_remove", f"SELECT {LIST_SQL} FROM v_list WHERE id NOT IN (SELECT id FROM v_chosen)", ["v_list", "v_chosen"])
def adjust_remove(spark, d):
    return J.remove_adjustments(v_list(spark, d), v_chosen(spark, d)).select(*LIST)


# New entries from parts: two per id, a share of the ids known, some times bad or reversed.
def v_new(spark, d):
    p = V.table(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    on = tg.plus(tg.ntz("2024-01-01 00:00:00"), tg.timedelta(0))
    return p.select(
        key.alias("pos"),
        (V.div(key, 2) + 1000).alias("id"),
        size.cast("long").alias("alarm_code"),
        (key % 31).alias("station_nr"),
        F.when(size % 5 != 0, F.when(size % 7 == 0, "tomorrow").otherwise(text_of(F.timestamp_add("DAY", size, on)))).alias("time_on"),
        F.when(size % 4 != 0, text_of(F.timestamp_add("DAY", key % 60, on))).alias("time_off"),
        F.when(size % 3 != 0, F.col("p_name")).alias("notes"),
    )


view(
    "v_new",
    f"""SELECT p_partkey AS pos, p_partkey // 2 + 1000 AS id, CAST(p_size AS BIGINT) AS alarm_code, p_partkey % 31 AS station_nr,
  CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_size % 7 = 0 THEN 'tomorrow' ELSE strftime(TIMESTAMP '2024-01-01' + to_days(p_size), {DATE_TEXT}) END END AS time_on,
  CASE WHEN p_size % 4 <> 0 THEN strftime(TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 60 AS INT)), {DATE_TEXT}) END AS time_off,
  CASE WHEN p_size % 3 <> 0 THEN p_name END AS notes FROM part""",
)
view(
    "v_new_checked",
    """SELECT *, CASE WHEN time_on IS NULL AND time_off IS NULL THEN 'no time given' WHEN time_on = 'tomorrow' THEN 'bad time_on'
  WHEN time_on IS NOT NULL AND time_off <= time_on THEN 'end not after start' END AS fault, id IN (SELECT id FROM v_list) AS known FROM v_new""",
    "v_new", "v_list",
)
_FIRST_VALID = "pos = min(CASE WHEN fault IS NULL THEN pos END) OVER (PARTITION BY id)"


@query(
    "adjust_add_valid",
    f"""SELECT {LIST_SQL} FROM v_list UNION ALL
  SELECT pos + (SELECT max(pos) + 1 FROM v_list), id, alarm_code, station_nr, time_on, time_off, coalesce(notes, ''), '{NOW}'
  FROM (SELECT *, {_FIRST_VALID} AS chosen FROM v_new_checked) x WHERE NOT known AND fault IS NULL AND chosen""",
    ["v_list", "v_new_checked"],
)
def adjust_add_valid(spark, d):
    return J.add_adjustments(v_list(spark, d), v_new(spark, d), NOW)[0].select(*LIST)


@query(
    "adjust_add_refused",
    f"""SELECT pos, id, CASE WHEN known THEN 'id exists' ELSE coalesce(fault, 'id exists') END AS reason
  FROM (SELECT *, {_FIRST_VALID} AS chosen FROM v_new_checked) x WHERE known OR fault IS NOT NULL OR NOT chosen""",
    ["v_list", "v_new_checked"],
)
def adjust_add_refused(spark, d):
    return J.add_adjustments(v_list(spark, d), v_new(spark, d), NOW)[1].select("pos", "id", "reason")


# One edit per id, from parts.
def v_edit(spark, d):
    p = V.table(spark, d, "part")
    base = tg.ntz("2023-12-20 00:00:00")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 3 != 0, text_of(F.timestamp_add("DAY", F.col("p_size"), base))).alias("time_on"),
        F.when(F.col("p_size") % 4 != 0, text_of(F.timestamp_add("DAY", F.col("p_partkey") % 40, base))).alias("time_off"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("notes"),
    )


view(
    "v_edit",
    f"""SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN strftime(TIMESTAMP '2023-12-20' + to_days(p_size), {DATE_TEXT}) END AS time_on,
  CASE WHEN p_size % 4 <> 0 THEN strftime(TIMESTAMP '2023-12-20' + to_days(CAST(p_partkey % 40 AS INT)), {DATE_TEXT}) END AS time_off,
  CASE WHEN p_size % 5 <> 0 THEN p_brand END AS notes FROM part""",
)
# Times are texts of one form, so they compare as text.
view(
    "v_edited",
    """SELECT e.*, q.id IS NOT NULL AND e.pos = min(e.pos) OVER (PARTITION BY e.id) AS hit, q.time_on AS n_on, q.time_off AS n_off, q.notes AS n_notes,
  CASE WHEN q.time_on >= e.time_off THEN 'start not before end' WHEN q.time_off <= coalesce(q.time_on, e.time_on) THEN 'end not after start' END AS fault
  FROM v_list e LEFT JOIN v_edit q USING (id)""",
    "v_list", "v_edit",
)


@query(
    "adjust_update_valid",
    f"""SELECT pos, id, alarm_code, station_nr, CASE WHEN hit AND fault IS NULL THEN coalesce(n_on, time_on) ELSE time_on END AS time_on,
  CASE WHEN hit AND fault IS NULL THEN coalesce(n_off, time_off) ELSE time_off END AS time_off,
  CASE WHEN hit AND fault IS NULL THEN coalesce(n_notes, notes) ELSE notes END AS notes,
  CASE WHEN hit AND fault IS NULL THEN '{NOW}' ELSE last_updated END AS last_updated FROM v_edited""",
    ["v_edited"],
)
def adjust_update_valid(spark, d):
    return J.edit_adjustments(v_list(spark, d), v_edit(spark, d), NOW)[0].select(*LIST)


@query(
    "adjust_update_refused",
    """SELECT id, fault AS reason FROM v_edited WHERE hit AND fault IS NOT NULL
  UNION ALL SELECT id, 'id not found' FROM v_edit WHERE id NOT IN (SELECT id FROM v_list)""",
    ["v_edited", "v_edit", "v_list"],
)
def adjust_update_refused(spark, d):
    return J.edit_adjustments(v_list(spark, d), v_edit(spark, d), NOW)[1]


@query(
    "adjustment_filter",
    "SELECT id FROM v_adjust WHERE alarm_code = 5 UNION ALL SELECT id FROM v_adjust WHERE station_nr = 3 AND alarm_code = 8",
    ["v_adjust"],
)
def adjustment_filter(spark, d):
    adj = v_adjust(spark, d)
    return J.adjustment_ids(adj, code=5).unionByName(J.adjustment_ids(adj, code=8, station=3))


def page_sql(order: str, page: int, size: int) -> str:
    return f"""SELECT {LIST_SQL}, (SELECT count(*) FROM v_adjust) AS total, (SELECT (count(*) + {size} - 1) // {size} FROM v_adjust) AS total_pages
  FROM (SELECT * FROM v_adjust ORDER BY {order} LIMIT {size} OFFSET {(page - 1) * size})"""


_PAGES = " UNION ALL ".join(
    (page_sql("id DESC, pos", 2, 25), page_sql("coalesce(time_on, '') DESC, pos", 3, 40), page_sql("coalesce(station_nr, 0), pos", 4, 10))
)


@query("adjustment_page", _PAGES, ["v_adjust"])
def adjustment_page(spark, d):
    adj = v_adjust(spark, d)
    return (
        J.adjustment_page(adj, page=2, size=25)
        .unionByName(J.adjustment_page(adj, sort_by="time_on", desc=True, page=3, size=40))
        .unionByName(J.adjustment_page(adj, sort_by="station_nr", page=4, size=10))
    )


def after_sql(order: str, offset: int, size: int) -> str:
    return f"SELECT * FROM (SELECT {LIST_SQL} FROM v_adjust ORDER BY {order} LIMIT {size} OFFSET {offset})"


@query(
    "adjustment_page_after",
    " UNION ALL ".join((after_sql("id DESC, pos", 25, 25), after_sql("coalesce(time_on, ''), pos", 40, 40), after_sql("coalesce(station_nr, 0) DESC, pos", 10, 10))),
    ["v_adjust"],
)
def adjustment_page_after(spark, d):
    adj, pages = v_adjust(spark, d), []
    for order in ({"size": 25}, {"sort_by": "time_on", "size": 40}, {"sort_by": "station_nr", "desc": True, "size": 10}):
        # The rows of a page, as the reader of the list has them.
        seen = J.adjustment_page_after(adj, **order).collect()
        pages.append(J.adjustment_page_after(adj, seen[-1] if seen else None, **order))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


# ----------------------------------------------------------- reconciliation

def v_source(spark, d):
    o = V.table(spark, d, "orders").where(F.col("o_orderstatus") != "F")
    return o.select("o_orderkey", "o_custkey", (F.col("o_custkey") + 1).alias("amount"), "o_orderpriority")


def v_existing(spark, d):
    o = V.table(spark, d, "orders").where(F.col("o_orderstatus") != "O")
    return o.select("o_orderkey", "o_custkey", F.col("o_custkey").alias("amount"), "o_orderstatus")


view("v_source", "SELECT o_orderkey, o_custkey, o_custkey + 1 AS amount, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
view("v_existing", "SELECT o_orderkey, o_custkey, o_custkey AS amount, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
_RECONCILE = """SELECT coalesce(s.o_orderkey, e.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN e.o_custkey ELSE s.o_custkey END AS o_custkey,
  CASE WHEN s.o_orderkey IS NULL THEN e.amount ELSE s.amount END AS amount, CASE WHEN s.o_orderkey IS NULL THEN e.o_orderstatus END AS o_orderstatus,
  s.o_orderpriority AS o_orderpriority{change} FROM v_source s FULL OUTER JOIN v_existing e ON s.o_orderkey = e.o_orderkey"""


@query(
    "reconcile_outer",
    _RECONCILE.format(change=", CASE WHEN e.o_orderkey IS NULL THEN 'new' WHEN s.o_orderkey IS NULL THEN 'kept' ELSE 'common' END AS _change"),
    ["v_source", "v_existing"],
)
def reconcile_outer(spark, d):
    return reconcile(v_source(spark, d), v_existing(spark, d), ["o_orderkey"])


@query("align_columns", _RECONCILE.format(change=""), ["v_source", "v_existing"])
def aligned(spark, d):
    source, existing = v_source(spark, d), v_existing(spark, d)
    return reconcile(source, existing, ["o_orderkey"]).select(*align_columns(source, existing))
