"""Authorization over views, in batch: whole tables of requests against grants and assignments.

Scopes: a scope is (class, value); an assignment is bound to one value, to any value of a
class, or to everything. Classes form a tree; an index view per class gives a value's parent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlog.functions.canonical_json import canonical


@dataclass(frozen=True)
class ScopeClass:
    """A level of the hierarchy; ``index`` is a view of (key, parent) rows that leads to ``parent``."""

    name: str
    parent: str | None = None
    index: str | None = None


class ScopeClasses:
    """The registered levels; parents must exist and never lead back."""

    def __init__(self, *classes: ScopeClass):
        self.by_name = {c.name: c for c in classes}
        if len(self.by_name) != len(classes):
            raise ValueError("a scope class is registered twice")
        for c in classes:
            if c.parent is not None and (c.parent not in self.by_name or not c.index):
                raise ValueError(f"{c.name} has no parent class or no index")
            self.ancestors(c.name)

    def ancestors(self, name: str) -> list[str]:
        """Classes above, nearest first."""
        out, at = [], self.by_name[name].parent
        while at is not None:
            if at in out or at == name:
                raise ValueError(f"{name} contains itself")
            out.append(at)
            at = self.by_name[at].parent
        return out

    def relation(self, held: str, asked: str) -> str:
        return "exact" if held == asked else "ancestor" if held in self.ancestors(asked) else "none"


def _one_parent(index: DataFrame) -> DataFrame:
    """(key, parent): one parent to a key, the smallest; keys without one lead nowhere."""
    return index.where("parent is not null and parent <> ''").groupBy("key").agg(F.min("parent").alias("parent"))


def resolve_up(values: DataFrame, classes: ScopeClasses, indexes: dict[str, DataFrame], start: str) -> DataFrame:
    """(value, class, ancestor) for each of ``values`` (value) of class ``start``: itself and what contains it, one join a level."""
    at = values.select("value").distinct().select("value", F.lit(start).alias("class"), F.col("value").alias("ancestor"))
    out, name = at, start
    while (level := classes.by_name[name]).parent is not None:
        at = at.join(_one_parent(indexes[level.index]), F.col("ancestor") == F.col("key")).select("value", F.lit(level.parent).alias("class"), F.col("parent").alias("ancestor"))
        out, name = out.unionByName(at), level.parent
    return out


def expand_down(values: DataFrame, classes: ScopeClasses, indexes: dict[str, DataFrame], start: str, target: str) -> DataFrame:
    """(value, descendant): what of class ``target`` lies under each of ``values`` (value) of class ``start``; nothing if it isn't above."""
    spark = values.sparkSession
    if start not in [target, *classes.ancestors(target)]:
        return spark.createDataFrame([], "value string, descendant string")
    names = [target, *classes.ancestors(target)]
    at = values.select("value").distinct().withColumn("descendant", F.col("value"))
    for name in reversed(names[: names.index(start)]):
        children = _one_parent(indexes[classes.by_name[name].index])
        at = at.join(children, F.col("descendant") == F.col("parent")).select("value", F.col("key").alias("descendant")).distinct()
    return at


def decide(requests: DataFrame, assignments: DataFrame, grants: DataFrame, containment: DataFrame) -> DataFrame:
    """(request_id, allowed).

    requests: (request_id, user_id, role, permission, scope_class, scope_value), scope null for unscoped permissions,
    user null for callers who aren't users. assignments: (user_id, role, scope_class, scope_value, any_value, any_class).
    grants: (role, permission). containment: (class, value, ancestor_class, ancestor), each value containing itself.
    A caller needs an assignment in the role and the role's grant; for a scoped permission, one assignment must match.
    """
    granted = requests.where("user_id is not null").join(grants.select("role", "permission").distinct(), ["role", "permission"])
    held = granted.join(assignments.withColumnsRenamed({"scope_class": "a_class", "scope_value": "a_value"}), ["user_id", "role"])
    unscoped = held.where("scope_class is null").select("request_id")
    total = held.where("scope_class is not null and any_class").select("request_id")
    asked = held.where("scope_class is not null and not any_class").join(
        containment, (F.col("scope_class") == F.col("class")) & (F.col("scope_value") == F.col("value")) & (F.col("a_class") == F.col("ancestor_class"))
    )
    bound = asked.where(F.col("any_value") | (F.col("a_value") == F.col("ancestor"))).select("request_id")
    allowed = unscoped.union(total).union(bound).distinct().withColumn("allowed", F.lit(True))
    return requests.select("request_id").join(allowed, "request_id", "left").select("request_id", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def effective_permissions(assignments: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, role, permissions, scopes): what each assigned role may do and where."""
    scope = F.when(F.col("any_class"), F.lit("*")).when(F.col("any_value"), F.concat("scope_class", F.lit(":*"))).otherwise(F.concat_ws(":", "scope_class", "scope_value"))
    held = assignments.groupBy("user_id", "role").agg(F.array_sort(F.collect_set(scope)).alias("scopes"))
    granted = grants.groupBy("role").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))
    return held.join(granted, "role", "left").select("user_id", "role", F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions"), "scopes")


def narrow(view_rows: DataFrame, key: str, allowed: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Rows of a view whose key is allowed and, if given, requested."""
    out = view_rows.join(allowed.select(F.col("key").alias(key)), key, "left_semi")
    return out if requested is None else out.join(requested.select(F.col("key").alias(key)), key, "left_semi")


def seed_diff(seeded: DataFrame, held: DataFrame) -> DataFrame:
    """(role, permission, state): ``missing`` grants are to be added; ``drift`` is reported and never revoked."""
    keys = ["role", "permission"]
    missing = seeded.select(*keys).distinct().join(held.select(*keys), keys, "left_anti").withColumn("state", F.lit("missing"))
    drift = held.select(*keys).distinct().join(seeded.select(*keys), keys, "left_anti").withColumn("state", F.lit("drift"))
    return missing.unionByName(drift)


def deny_all(requests: DataFrame) -> DataFrame:
    """The policy where none is configured."""
    return requests.select("request_id", F.lit(False).alias("allowed"))


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, parent string")


def assignment_id(user_id: str, role: str, scope: dict) -> str:
    """The aggregate id of an assignment: canonical text of what it says."""
    return canonical({"user_id": user_id, "role": role, "scope": scope})


def check_seed(seed: dict, known: set[str]) -> list[str]:
    """What is wrong with a permission seed {roles, grants}: roles listed twice, grants of unknown roles or permissions."""
    roles, grants = seed.get("roles") or [], seed.get("grants") or {}
    out = [f"role {r} is listed twice" for r in sorted({r for r in roles if roles.count(r) > 1})]
    out += [f"grants for the unknown role {r}" for r in sorted(set(grants) - set(roles))]
    out += [f"unknown permission {p} for {r}" for r in sorted(grants) for p in grants[r] if p not in known]
    return out


def watch(changes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, action) for changes of assignments and grants: losing one closes a session, gaining one makes its data stale.

    changes: (event_type, user_id, role), user null for changes of a role's grants. sessions: (session_id, user_id, role).
    A change that can't be told apart closes too. Changes are summed up per role, and per role and user, before they meet sessions: two equi-joins with
    one row to a key, so many changes and sessions of one role make no pairs.
    """
    gains = F.coalesce(F.col("event_type").isin("role_assigned", "permission_granted"), F.lit(False))
    summed = changes.groupBy(F.col("user_id").alias("c_user"), F.col("role").alias("c_role")).agg(F.bool_and(gains).alias("gains"))
    of_role = F.col("role") == F.col("c_role")
    wide = sessions.join(summed.where("c_user is null"), of_role).select("session_id", "gains")
    own = sessions.join(summed.where("c_user is not null"), of_role & (F.col("user_id") == F.col("c_user"))).select("session_id", "gains")
    action = F.when(F.bool_and("gains"), "stale").otherwise("close")
    return wide.union(own).groupBy("session_id").agg(action.alias("action"))
