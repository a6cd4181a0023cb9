"""Users and their tokens as tables: lookup, rotation, the list of revoked ones. Issuing and signing are no queries and aren't here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_users(users: DataFrame, key: str, values: list) -> DataFrame:
    """Enabled users by name or id."""
    return users.where(F.col(key).isin(values) & F.col("enabled"))


def logged_in(users: DataFrame, ids: DataFrame, now) -> DataFrame:
    """users with ``last_login`` of those in ids (id) set."""
    seen = ids.select("id").distinct().withColumn("_seen", F.lit(True))
    return users.join(seen, "id", "left").withColumn("last_login", F.when(F.col("_seen"), now).otherwise(F.col("last_login"))).drop("_seen")


def rotate(tokens: DataFrame, issued: DataFrame) -> DataFrame:
    """tokens when ``issued`` ones are added: those that their users held before are revoked."""
    owners = issued.select("user_id").distinct().withColumn("_new", F.lit(True))
    old = tokens.join(owners, "user_id", "left").withColumn("revoked", F.col("revoked") | F.coalesce("_new", F.lit(False))).drop("_new")
    return old.unionByName(issued)


def blocked(asked: DataFrame, cached: DataFrame, revoked: DataFrame, now) -> DataFrame:
    """(token, blocked, source) of asked tokens (token): found in the cache, else in the table if its time isn't over.

    cached and revoked: (token, expires_at). What the table alone knows
    (source ``table``) goes into the cache until it expires.
    """
    near = cached.where(F.col("expires_at") > now).select("token", F.lit(True).alias("_near")).distinct()
    far = revoked.where(F.col("expires_at") > now).select("token", F.lit(True).alias("_far")).distinct()
    source = F.when(F.col("_near"), "cache").when(F.col("_far"), "table")
    return asked.join(near, "token", "left").join(far, "token", "left").select("token", source.isNotNull().alias("blocked"), source.alias("source"))
