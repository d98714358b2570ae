"""Row-level access control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Access levels by rank, and those each role sees.
LEVELS = ["public", "internal", "confidential", "restricted"]
ROLE_LEVELS = {"admin": LEVELS, "expert": LEVELS[:3], "developer": LEVELS[:3], "viewer": LEVELS[:2], "external": LEVELS[:1]}
RESTRICTED_SOURCES = ["hr", "security", "finance", "legal", "executive"]


def allowed_levels(roles: Column) -> Column:
    """Levels that any of the roles sees, by rank; public if none is known."""
    table = F.create_map(*[x for role, ls in ROLE_LEVELS.items() for x in (F.lit(role), F.array(*map(F.lit, ls)))])
    seen = F.flatten(F.transform(F.coalesce(roles, F.array()), lambda r: F.coalesce(F.element_at(table, r), F.array().cast("array<string>"))))
    return F.filter(F.array(*map(F.lit, LEVELS)), lambda level: F.array_contains(seen, level) | ((F.size(seen) == 0) & (level == "public")))


def is_admin(roles: Column) -> Column:
    return F.coalesce(F.array_contains(roles, "admin"), F.lit(False))


def empty(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0)) <= 0


def visible(level: Column, groups: Column, users: Column, roles: Column, own_groups: Column, name: Column) -> Column:
    """A chunk of level for a user. An empty list of groups or users allows all;
    confidential chunks are never seen by users without groups."""
    level = F.coalesce(level, F.lit("public"))
    inside = F.array_contains(allowed_levels(roles), level)
    group_ok = ~empty(own_groups) & (empty(groups) | F.coalesce(F.arrays_overlap(groups, own_groups), F.lit(False)))
    user_ok = empty(users) | F.coalesce(F.array_contains(users, name), F.lit(False))
    return is_admin(roles) | (inside & F.when(level == "confidential", group_ok).when(level == "restricted", user_ok).otherwise(True))


def document_visible(level: Column, groups: Column, users: Column, roles: Column, own_groups: Column, name: Column) -> Column:
    """As visible, but a confidential document without groups is seen by users without groups too."""
    inside = F.array_contains(allowed_levels(roles), level)
    group_ok = empty(groups) | F.coalesce(F.arrays_overlap(groups, own_groups), F.lit(False))
    user_ok = empty(users) | F.coalesce(F.array_contains(users, name), F.lit(False))
    return is_admin(roles) | (inside & F.when(level == "confidential", group_ok).when(level == "restricted", user_ok).otherwise(True))


def owner_visible(level: Column, groups: Column, users: Column, admin: Column, own_groups: Column, user_id: Column) -> Column:
    """The domain rule: public, or the user is named, or shares a group."""
    return admin | (level == "public") | F.coalesce(F.array_contains(users, user_id), F.lit(False)) | F.coalesce(F.arrays_overlap(groups, own_groups), F.lit(False))


def source_visible(source_type: Column, roles: Column) -> Column:
    """Restricted sources are for experts and admins."""
    return ~source_type.isin(RESTRICTED_SOURCES) | F.coalesce(F.array_contains(roles, "expert"), F.lit(False)) | is_admin(roles)


def pushdown(levels: list[str], groups: list[str], name: str) -> Column:
    """A predicate for a scan, one branch a level (public rows need no group)."""
    out = F.col("access_level").isin([x for x in levels if x in ("public", "internal")])
    if "confidential" in levels and groups:
        out = out | ((F.col("access_level") == "confidential") & (empty(F.col("allowed_groups")) | F.arrays_overlap("allowed_groups", F.array(*map(F.lit, groups)))))
    if "restricted" in levels:
        out = out | ((F.col("access_level") == "restricted") & (empty(F.col("allowed_users")) | F.array_contains("allowed_users", name)))
    return out


def pairs(chunks: DataFrame, users: DataFrame) -> DataFrame:
    """Which user sees which chunk: the columns of both.

    A chunk names the keys that open it (its level, a group, a user), a user
    those that they hold, and the two meet on a key. So only pairs that are in
    the result are made, some of them by several groups.
    """
    level = F.coalesce("access_level", F.lit("public"))
    named = lambda kind, xs: F.when(empty(F.col(xs)), F.array(F.lit(f"{kind}:*"))).otherwise(F.transform(xs, lambda x: F.concat(F.lit(f"{kind}:"), x)))
    opened = F.when(level == "confidential", named("group", "allowed_groups")).when(level == "restricted", named("user", "allowed_users")).otherwise(F.array(F.concat(F.lit("level:"), level)))
    keyed = chunks.select("*", F.explode(F.array_distinct(F.concat(opened, F.array(F.lit("admin"))))).alias("_key"))
    levels = allowed_levels(F.col("roles"))
    none = F.array().cast("array<string>")
    held = F.concat(
        F.transform(levels, lambda x: F.concat(F.lit("level:"), x)),
        F.when(F.array_contains(levels, "confidential") & ~empty(F.col("groups")), F.concat(F.array(F.lit("group:*")), F.transform("groups", lambda x: F.concat(F.lit("group:"), x)))).otherwise(none),
        F.when(F.array_contains(levels, "restricted"), F.array(F.lit("user:*"), F.concat(F.lit("user:"), F.col("username")))).otherwise(none),
    )
    keys = users.select("*", F.explode(F.array_distinct(F.when(is_admin(F.col("roles")), F.array(F.lit("admin"))).otherwise(F.coalesce(held, none)))).alias("_key"))
    return keyed.join(keys, "_key").drop("_key").distinct()
