"""Queries over devices, sites, users, alerts and their logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import alerts as A
from flowquarry.operators import relational as R
from flowquarry.operators.cooldown import cooldown
from flowquarry.operators.encoding import unseen
from flowquarry.plans.registry import query
from flowquarry.session import fresh_path
from flowquarry.sources import tables as S
from flowquarry.sources.keyed import KeyedTable

SITES_SQL = f"{S.DEVICES_SQL}, {S.HOSPITALS_SQL}, {S.USERS_SQL}"


@query(f"""WITH {S.USERS_SQL}, {S.LOGS_SQL}, newest AS (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY hospital_id ORDER BY "timestamp" DESC, id DESC) <= 50)
  SELECT u.id AS user_id, l.id AS log_id FROM users u JOIN newest l ON u.hospital_id IS NOT DISTINCT FROM l.hospital_id""")
def tenant_logs(spark, sf_dir):
    seen = R.visible_logs(S.activity_logs(spark, sf_dir), S.users(spark, sf_dir))
    return seen.select("user_id", F.col("id").alias("log_id"))


@query(f"WITH {S.LOGS_SQL} SELECT id, log_type FROM logs WHERE hospital_id IS NULL")
def system_logs(spark, sf_dir):
    return R.logs_of(S.activity_logs(spark, sf_dir), None).select("id", "log_type")


@query(f"""WITH {S.USERS_SQL}, {S.HOSPITALS_SQL} SELECT u.id AS user_id, h.id AS hospital_id FROM users u JOIN hospitals h
  ON (u.role = 'ADMIN' AND h.owner_id = u.id) OR (u.role <> 'ADMIN' AND h.id = u.hospital_id)""")
def visible_hospitals(spark, sf_dir):
    return R.visible_hospitals(S.hospitals(spark, sf_dir), S.users(spark, sf_dir))


@query(f"""WITH {SITES_SQL} SELECT DISTINCT u.id AS user_id, d.id AS device_id FROM hospitals h JOIN users u ON u.id = h.owner_id OR u.hospital_id = h.id
  JOIN devices d ON d.hospital_id = h.id WHERE h.unique_code = 'CODE-7'""")
def visible_devices(spark, sf_dir):
    return R.visible_devices(S.devices(spark, sf_dir), S.hospitals(spark, sf_dir), S.users(spark, sf_dir), "CODE-7")


@query(f"""WITH {SITES_SQL} SELECT h.id AS hospital_id, o.email AS owner_email, (SELECT count(*) FROM users m WHERE m.hospital_id = h.id) AS members
  FROM hospitals h LEFT JOIN users o ON o.id = h.owner_id""")
def tenant_roles(spark, sf_dir):
    return R.tenant_roles(S.hospitals(spark, sf_dir), S.users(spark, sf_dir))


@query(f"""WITH {SITES_SQL} SELECT h.id AS hospital_id, h.name, h.owner_id, count(d.id) AS n_devices, count(*) FILTER (d.status IN ('ATTACK', 'ISOLATED')) AS n_attacked
  FROM hospitals h LEFT JOIN devices d ON d.hospital_id = h.id GROUP BY ALL""")
def devices_per_hospital(spark, sf_dir):
    return R.devices_per_hospital(S.hospitals(spark, sf_dir), S.devices(spark, sf_dir))


@query(f"WITH {SITES_SQL} SELECT h.* FROM hospitals h WHERE EXISTS (SELECT 1 FROM devices d WHERE d.hospital_id = h.id AND d.status NOT IN ('SAFE', 'BENIGN'))")
def hospitals_under_attack(spark, sf_dir):
    return R.hospitals_under_attack(S.hospitals(spark, sf_dir), S.devices(spark, sf_dir))


@query(f"""WITH {SITES_SQL} SELECT h.owner_id, count(DISTINCT h.id) AS n_hospitals, count(d.id) AS n_devices, count(*) FILTER (d.status IN ('ATTACK', 'ISOLATED')) AS n_attacked
  FROM hospitals h LEFT JOIN devices d ON d.hospital_id = h.id GROUP BY h.owner_id""")
def tenant_overview(spark, sf_dir):
    return R.tenant_overview(S.hospitals(spark, sf_dir), S.devices(spark, sf_dir))


def _requested(spark, sf_dir):
    """supplier as requests for devices; some repeat a device a site already has."""
    s = S.table(spark, sf_dir, "supplier")
    known = F.col("s_acctbal") < 3000
    return s.select(
        (F.col("s_suppkey") + 1_000_000_000).alias("id"),
        F.when(known, F.format_string("Customer#%09d", "s_suppkey")).otherwise(F.col("s_name")).alias("name"),
        F.concat(F.lit("172.16.0."), F.col("s_suppkey") % 256).alias("ip_address"),
        F.concat(F.lit("CODE-"), F.col("s_nationkey") + F.when(F.col("s_acctbal") > 9800, 100).otherwise(0)).alias("unique_code"),
        "s_nationkey",
    )


REQUESTED_SQL = """requested AS (SELECT s_suppkey + 1000000000 AS id, CASE WHEN s_acctbal < 3000 THEN printf('Customer#%09d', s_suppkey) ELSE s_name END AS name,
    '172.16.0.' || s_suppkey % 256 AS ip_address, 'CODE-' || (s_nationkey + CASE WHEN s_acctbal > 9800 THEN 100 ELSE 0 END) AS unique_code, s_nationkey FROM supplier)"""


@query(f"""WITH {SITES_SQL}, {REQUESTED_SQL} SELECT r.id, r.name, r.s_nationkey::bigint AS hospital_id FROM requested r
  WHERE NOT EXISTS (SELECT 1 FROM devices d WHERE d.hospital_id = r.s_nationkey AND d.name = r.name)""")
def missing_devices(spark, sf_dir):
    rows = _requested(spark, sf_dir).select("id", "name", F.col("s_nationkey").cast("bigint").alias("hospital_id"))
    return R.missing(S.devices(spark, sf_dir), rows, ["hospital_id", "name"]).select("id", "name", "hospital_id")


@query(f"""WITH {SITES_SQL}, {REQUESTED_SQL} SELECT id, name, ip_address, status, last_risk_score, hospital_id FROM devices
  UNION ALL SELECT r.id, r.name, r.ip_address, 'SAFE', 0.0::double, h.id FROM requested r JOIN hospitals h USING (unique_code)
    WHERE NOT EXISTS (SELECT 1 FROM devices d WHERE d.hospital_id = h.id AND d.name = r.name)""")
def insert_device(spark, sf_dir):
    devices = S.devices(spark, sf_dir)
    return devices.unionByName(R.new_devices(_requested(spark, sf_dir), S.hospitals(spark, sf_dir), devices))


@query(f"""WITH {SITES_SQL}, dead AS (SELECT h.id FROM hospitals h JOIN users u ON u.id = h.owner_id WHERE u.role = 'ADMIN' AND u.hospital_id IS NULL)
  SELECT d.* FROM devices d WHERE d.hospital_id NOT IN (SELECT id FROM dead)""")
def cascade_delete(spark, sf_dir):
    users, hospitals, devices = (f(spark, sf_dir) for f in (S.users, S.hospitals, S.devices))
    gone_users = users.filter("role = 'ADMIN' and hospital_id is null")
    kept_hospitals = R.cascade(hospitals, gone_users, "owner_id")
    gone_hospitals = hospitals.join(kept_hospitals.select("id"), "id", "left_anti")
    return R.cascade(devices, gone_hospitals, "hospital_id").select(*devices.columns)


UPDATES_SQL = """updates AS (SELECT o_custkey AS id, CASE WHEN max(o_totalprice) > 450000 THEN 'ATTACK' WHEN max(o_totalprice) < 200000 THEN 'SAFE' END AS status,
    round(max(o_totalprice) / 1000000, 6) AS last_risk_score FROM orders GROUP BY o_custkey)"""


def _updates(spark, sf_dir):
    top = F.max("o_totalprice")
    return S.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.when(top > 450000, "ATTACK").when(top < 200000, "SAFE").alias("status"), F.round(top / 1000000, 6).alias("last_risk_score")
    )


@query(f"""WITH {SITES_SQL}, {UPDATES_SQL} SELECT d.id, d.name, d.ip_address, CASE WHEN d.status <> 'ISOLATED' THEN coalesce(u.status, d.status) ELSE d.status END AS status,
  CASE WHEN d.status <> 'ISOLATED' THEN coalesce(u.last_risk_score, d.last_risk_score) ELSE d.last_risk_score END AS last_risk_score, d.hospital_id FROM devices d LEFT JOIN updates u USING (id)""")
def apply_updates(spark, sf_dir):
    return R.apply_updates(S.devices(spark, sf_dir), _updates(spark, sf_dir), "id", ["status", "last_risk_score"], F.col("status") != "ISOLATED")


@query(f"""WITH {SITES_SQL}, hit AS (SELECT o_custkey AS id FROM orders GROUP BY 1 HAVING max(o_totalprice) > 450000)
  SELECT d.id, d.name, d.ip_address, CASE WHEN d.id IN (SELECT id FROM hit) THEN 'ATTACK' ELSE d.status END AS status, d.last_risk_score, d.hospital_id FROM devices d""")
def update_in_place(spark, sf_dir):
    """The attacked devices of a kept table; parts without one keep their files."""
    store = KeyedTable(spark, fresh_path(spark, "devices"), "id", parts=64)
    store.create(S.devices(spark, sf_dir))
    attacked = _updates(spark, sf_dir).filter("status = 'ATTACK'").select("id", "status")
    store.rewrite(attacked, lambda old: R.apply_updates(old, attacked, "id", ["status"]))
    return store.read()


def _requests(spark, sf_dir):
    """orders as requests: a user asks for a device."""
    users = S.table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    return S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device_id"), (F.col("o_orderkey") % users).alias("user_id")).distinct()


ASKED_SQL = f"""{SITES_SQL}, asked AS (SELECT DISTINCT o_custkey AS device_id, o_orderkey % (SELECT count(*) FROM supplier) AS user_id FROM orders),
  who AS (SELECT a.*, d.name AS device_name, d.hospital_id, u.role, u.hospital_id AS user_site FROM asked a JOIN devices d ON d.id = a.device_id JOIN users u ON u.id = a.user_id)"""


@query(f"""WITH {ASKED_SQL}, g AS (SELECT * FROM who WHERE role = 'TECH_STAFF' AND user_site = hospital_id)
  SELECT 'device' AS kind, id AS device_id, CASE WHEN id IN (SELECT device_id FROM g) THEN 'ISOLATED' ELSE status END AS detail FROM devices
  UNION ALL SELECT 'ISOLATION', device_id, 'Device ' || device_name || ' isolated by user ' || user_id FROM g""")
def isolate_device(spark, sf_dir):
    devices, events = R.isolate(_requests(spark, sf_dir), S.devices(spark, sf_dir), S.users(spark, sf_dir))
    return devices.select(F.lit("device").alias("kind"), F.col("id").alias("device_id"), F.col("status").alias("detail")).unionByName(
        events.select(F.col("type").alias("kind"), "device_id", F.col("message").alias("detail"))
    )


@query(f"""WITH {ASKED_SQL}, g AS (SELECT * FROM who WHERE role = 'ADMIN' OR user_site = hospital_id)
  SELECT 'device' AS kind, id AS device_id, status AS detail FROM devices WHERE id NOT IN (SELECT device_id FROM g)
  UNION ALL SELECT 'WARNING', device_id, 'Device deleted: ' || device_name FROM g""")
def delete_device(spark, sf_dir):
    devices, lines = R.delete_devices(_requests(spark, sf_dir), S.devices(spark, sf_dir), S.users(spark, sf_dir))
    return devices.select(F.lit("device").alias("kind"), F.col("id").alias("device_id"), F.col("status").alias("detail")).unionByName(
        lines.select(F.col("log_type").alias("kind"), "device_id", F.col("description").alias("detail"))
    )


ALERTS_SQL = f"""{S.PACKETS_SQL}, {SITES_SQL}, alerts AS (SELECT packet_id AS alert_id, ts, (predicted <> 'Benign' AND confidence > 0.5) AS is_attack, predicted AS attack_type, confidence AS probability,
    CASE WHEN predicted = 'DoS' THEN NULL WHEN predicted = 'Recon' THEN '' WHEN predicted = 'MQTT' THEN '192.168.0.1' ELSE ip END AS device_ip, ip AS dst_ip
  FROM (SELECT *, '10.' || (device_id // 65536) % 256 || '.' || (device_id // 256) % 256 || '.' || device_id % 256 AS ip FROM packets)),
enriched AS (SELECT a.*, d.id AS device_id, d.name AS device_name, d.hospital_id FROM alerts a LEFT JOIN devices d ON d.ip_address = CASE WHEN coalesce(device_ip, '') <> '' THEN device_ip ELSE dst_ip END)"""


def alert_stream(packets):
    """Packets as incoming alerts; some name no address, some an unknown one."""
    key, kind = F.col("device_id"), F.col("predicted")
    ip = F.concat_ws(".", F.lit("10"), F.floor(key / 65536) % 256, F.floor(key / 256) % 256, key % 256)
    return packets.select(
        F.col("packet_id").alias("alert_id"), "ts",
        ((kind != "Benign") & (F.col("confidence") > 0.5)).alias("is_attack"), kind.alias("attack_type"),
        F.col("confidence").alias("probability"),
        F.when(kind == "Recon", "").when(kind == "MQTT", "192.168.0.1").when(kind != "DoS", ip).alias("device_ip"), ip.alias("dst_ip"),
        F.lit(None).cast("bigint").alias("device_id"), F.lit(None).cast("bigint").alias("hospital_id"),
    )


def _enriched(spark, sf_dir):
    return A.enrich(alert_stream(S.packets(spark, sf_dir)), S.devices(spark, sf_dir))


@query(f"WITH {ALERTS_SQL} SELECT alert_id, is_attack::int AS is_attack, device_id, device_name, hospital_id FROM enriched")
def enrich_alerts(spark, sf_dir):
    return _enriched(spark, sf_dir).select("alert_id", F.col("is_attack").cast("int").alias("is_attack"), "device_id", "device_name", "hospital_id")


@query(f"""WITH {ALERTS_SQL} SELECT alert_id, 'KRİTİK SALDIRI TESPİTİ' AS title, coalesce(device_name, 'Device ' || device_id) || ' üzerinde ' || attack_type || ' tespit edildi! (Güven: ' || printf('%.2f', probability) || ')' AS description,
  'DANGER' AS log_type, hospital_id FROM enriched WHERE is_attack AND hospital_id IS NOT NULL""")
def alert_log(spark, sf_dir):
    return A.log_lines(_enriched(spark, sf_dir))


@query(f"""WITH {ALERTS_SQL} SELECT alert_id, u.id AS recipient FROM enriched e JOIN users u ON u.hospital_id = e.hospital_id OR (u.role = 'ADMIN' AND u.hospital_id IS NULL)
  WHERE e.is_attack AND e.hospital_id IS NOT NULL""")
def route_alerts(spark, sf_dir):
    known = _enriched(spark, sf_dir).filter("is_attack and hospital_id is not null").select("alert_id", "hospital_id")
    return A.route(known, S.users(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  fold AS (SELECT user_id, rn, ts, event_id, ts AS fired_at, true AS fired FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.rn, e.ts, e.event_id, CASE WHEN e.ts >= f.fired_at + INTERVAL 3 DAY THEN e.ts ELSE f.fired_at END, e.ts >= f.fired_at + INTERVAL 3 DAY
      FROM fold f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
  SELECT user_id, event_id, ts FROM fold WHERE fired""")
def alert_cooldown(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return cooldown(rows, "user_id", "ts", "event_id", "3 days")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  fold AS (SELECT user_id, rn, ts, event_id, ts AS fired_at, true AS fired FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.rn, e.ts, e.event_id, CASE WHEN e.ts >= f.fired_at + INTERVAL 60 MINUTE THEN e.ts ELSE f.fired_at END, e.ts >= f.fired_at + INTERVAL 60 MINUTE
      FROM fold f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
  SELECT user_id, event_id, ts FROM fold WHERE fired""")
def alert_cooldown_hour(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return cooldown(rows, "user_id", "ts", "event_id", "60 minutes")


@query("""SELECT DISTINCT p_brand, p_type FROM part t WHERE p_size > 40 AND NOT EXISTS (SELECT 1 FROM part r WHERE r.p_size <= 3 AND r.p_brand = t.p_brand AND r.p_type = t.p_type)""")
def unseen_categories(spark, sf_dir):
    part = S.table(spark, sf_dir, "part")
    return unseen(part.filter("p_size <= 3"), part.filter("p_size > 40"), ["p_brand", "p_type"])
