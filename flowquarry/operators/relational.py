"""Device, site and user relations: visibility, lookups, counts and table rewrites.

No join is hinted: Spark broadcasts a side when its measured size allows and otherwise
shuffles, splitting skewed keys. Counts combine before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.labels import status_is_attack
from flowquarry.operators.positions import top_per_group


def visible_logs(logs: DataFrame, users: DataFrame, newest: int = 50) -> DataFrame:
    """(user_id, log columns): users of a site see its ``newest`` lines, users without one
    see those without a site. Lines are cut to the newest of each site before they meet
    the users, and before their shuffle, so neither a busy site nor a large staff
    multiplies the log. A null-safe key does both cases in one equi join."""
    viewers = users.select(F.col("id").alias("user_id"), F.col("hospital_id").alias("_site"))
    recent = top_per_group(logs, ["hospital_id"], [F.col("timestamp").desc(), F.col("id").desc()], newest, "_place").drop("_place")
    return viewers.join(recent, F.col("_site").eqNullSafe(F.col("hospital_id"))).drop("_site")


def logs_of(logs: DataFrame, site: int | None) -> DataFrame:
    """One user's view, with the site known: a plain pushed-down filter."""
    return logs.filter(F.col("hospital_id").isNull() if site is None else F.col("hospital_id") == site)


def visible_hospitals(hospitals: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, hospital_id): admins see the sites they own, others their own site."""
    admin = F.col("role") == "ADMIN"
    owned = users.filter(admin).select(F.col("id").alias("user_id"), F.col("id").alias("owner_id"))
    own = users.filter(~admin & F.col("hospital_id").isNotNull()).select(F.col("id").alias("user_id"), F.col("hospital_id").alias("id"))
    by_owner = owned.join(hospitals, "owner_id").select("user_id", F.col("id").alias("hospital_id"))
    by_site = own.join(hospitals, "id").select("user_id", F.col("id").alias("hospital_id"))
    return by_owner.unionByName(by_site)


def visible_devices(devices: DataFrame, hospitals: DataFrame, users: DataFrame, code: str) -> DataFrame:
    """(user_id, device_id) for the site with ``code``: its owner and its employees only."""
    site = hospitals.filter(F.col("unique_code") == code).select(F.col("id").alias("hospital_id"), "owner_id")
    owners = site.join(users.select(F.col("id").alias("owner_id")), "owner_id").select("hospital_id", F.col("owner_id").alias("user_id"))
    staff = site.select("hospital_id").join(users.select(F.col("id").alias("user_id"), "hospital_id"), "hospital_id").select("hospital_id", "user_id")
    allowed = owners.unionByName(staff).distinct()
    return devices.select(F.col("id").alias("device_id"), "hospital_id").join(allowed, "hospital_id").select("user_id", "device_id")


def tenant_roles(hospitals: DataFrame, users: DataFrame) -> DataFrame:
    """(hospital_id, owner_email, members): both user relations of each site."""
    members = users.filter("hospital_id is not null").groupBy("hospital_id").agg(F.count("*").alias("members"))
    owners = users.select(F.col("id").alias("owner_id"), F.col("email").alias("owner_email"))
    return (
        hospitals.select(F.col("id").alias("hospital_id"), "owner_id")
        .join(owners, "owner_id", "left")
        .join(members, "hospital_id", "left")
        .select("hospital_id", "owner_email", F.coalesce("members", F.lit(0)).alias("members"))
    )


def devices_per_hospital(hospitals: DataFrame, devices: DataFrame) -> DataFrame:
    counts = devices.groupBy("hospital_id").agg(
        F.count("*").alias("n_devices"), F.count_if(status_is_attack(F.col("status"))).alias("n_attacked")
    )
    return (
        hospitals.select(F.col("id").alias("hospital_id"), "name", "owner_id")
        .join(counts, "hospital_id", "left")
        .select(
            "hospital_id", "name", "owner_id", F.coalesce("n_devices", F.lit(0)).alias("n_devices"),
            F.coalesce("n_attacked", F.lit(0)).alias("n_attacked"),
        )
    )


def hospitals_under_attack(hospitals: DataFrame, devices: DataFrame) -> DataFrame:
    attacked = devices.filter(status_is_attack(F.col("status"))).select(F.col("hospital_id").alias("id"))
    return hospitals.join(attacked, "id", "left_semi")


def tenant_overview(hospitals: DataFrame, devices: DataFrame) -> DataFrame:
    """Per owner: sites, devices, attacked devices."""
    per_site = devices_per_hospital(hospitals, devices)
    return per_site.groupBy("owner_id").agg(
        F.count("*").alias("n_hospitals"), F.sum("n_devices").alias("n_devices"), F.sum("n_attacked").alias("n_attacked")
    )


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` plus the rows whose key it does not hold yet."""
    return table.unionByName(missing(table, rows, keys))


def missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(table.select(*keys), keys, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is not among the deleted ones."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def apply_updates(table: DataFrame, updates: DataFrame, key: str, columns: list[str], allowed: Column | None = None) -> DataFrame:
    """Replace ``columns`` by the non-null new values of matching rows.

    ``updates`` holds at most one row per key; ``allowed`` may look at table columns and
    at the new values as new_<column>.
    """
    renamed = updates.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = table.join(renamed, key, "left")
    may = F.coalesce(F.col("_hit"), F.lit(False)) if allowed is None else F.coalesce(F.col("_hit") & allowed, F.lit(False))
    changed = {c: F.when(may, F.coalesce(F.col(f"new_{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changed).select(*table.columns)


def new_devices(requests: DataFrame, hospitals: DataFrame, devices: DataFrame) -> DataFrame:
    """Requested devices as rows: site from its code, SAFE, zero risk; names a site already
    has and unknown codes are left out."""
    sites = hospitals.select(F.col("unique_code"), F.col("id").alias("hospital_id"))
    rows = requests.join(sites, "unique_code").select(
        "id", "name", "ip_address", F.lit("SAFE").alias("status"), F.lit(0.0).alias("last_risk_score"), "hospital_id"
    )
    return missing(devices, rows, ["hospital_id", "name"])


def _with_actor(requests: DataFrame, devices: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (device_id, user_id) with the device's and the actor's site and role."""
    d = devices.select(F.col("id").alias("device_id"), F.col("name").alias("device_name"), F.col("hospital_id"))
    u = users.select(F.col("id").alias("user_id"), "role", F.col("hospital_id").alias("user_site"))
    return requests.join(d, "device_id").join(u, "user_id")


def isolate(requests: DataFrame, devices: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(devices, events): technical staff may isolate devices of their own site."""
    granted = _with_actor(requests, devices, users).filter(
        (F.col("role") == "TECH_STAFF") & (F.col("user_site") == F.col("hospital_id"))
    )
    updates = granted.select(F.col("device_id").alias("id")).distinct().withColumn("status", F.lit("ISOLATED"))
    events = granted.select(
        "device_id", F.lit("ISOLATION").alias("type"),
        F.concat(F.lit("Device "), "device_name", F.lit(" isolated by user "), F.col("user_id")).alias("message"), "hospital_id",
    )
    return apply_updates(devices, updates, "id", ["status"]), events


def delete_devices(requests: DataFrame, devices: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(devices, log lines): admins and users of the device's site may delete it."""
    granted = _with_actor(requests, devices, users).filter(
        (F.col("role") == "ADMIN") | (F.col("user_site") == F.col("hospital_id"))
    )
    gone = granted.select(F.col("device_id").alias("id")).distinct()
    lines = granted.select(
        "device_id", F.lit("WARNING").alias("log_type"), F.concat(F.lit("Device deleted: "), "device_name").alias("description"), "hospital_id"
    )
    return devices.join(gone, "id", "left_anti"), lines
