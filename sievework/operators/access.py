"""Who may do what in which namespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: role, namespaces, actions
ROLE_MATRIX = (
    ("super_admin", ("*",), ("chat", "upload", "admin", "delete")),
    ("advisor", ("advisory",), ("chat", "upload")),
    ("cyber", ("cybersecurity",), ("chat",)),
    ("datamanagement", ("datamanagement",), ("chat", "upload")),
    ("recruiting", ("recruiting",), ("chat", "upload")),
    ("ventures", ("ventures",), ("chat", "upload")),
)
# fixed values: role, permission names
ROLE_PERMISSIONS = (
    (
        "super_admin",
        (
            "upload_documents", "upload_persistent", "upload_ephemeral", "delete_documents", "manage_users",
            "view_documents",
        ),
    ),
    ("admin", ("upload_documents", "upload_persistent", "upload_ephemeral", "delete_documents", "view_documents")),
    ("operator", ("upload_ephemeral", "view_documents")),
    ("viewer", ("view_documents",)),
    ("client", ()),
)


def _constant_rows(spark: SparkSession, rows: list[Column]) -> DataFrame:
    """Literal rows; Spark knows how small they are and broadcasts them by itself."""
    return spark.range(1).select(F.inline(F.array(*rows)))


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def role_matrix(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(F.lit(role).alias("role"), _texts(spaces).alias("namespaces"), _texts(actions).alias("actions"))
        for role, spaces, actions in ROLE_MATRIX
    ]
    return _constant_rows(spark, rows)


def role_permissions(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(role).alias("role"), _texts(names).alias("permissions")) for role, names in ROLE_PERMISSIONS]
    return _constant_rows(spark, rows)


def authorize(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """Add decision and reason to (role, own_namespace, namespace, action). The matrix has one row per role."""
    rows = requests.join(matrix, "role", "left")
    permitted = (
        F.array_contains("namespaces", F.lit("*")) | F.array_contains("namespaces", F.col("own_namespace"))
    ) & F.array_contains("actions", F.col("action"))
    reason = (
        F.when(~F.coalesce(permitted, F.lit(False)), "no permission")
        .when(~F.col("namespace").eqNullSafe(F.col("own_namespace")), "namespace mismatch")
        .otherwise("ok")
    )
    return (
        rows.withColumn("reason", reason)
        .withColumn("decision", F.when(F.col("reason") == "ok", "allow").otherwise("deny"))
        .drop("namespaces", "actions")
    )


def with_permission(requests: DataFrame, matrix: DataFrame, action: str, out: str = "permitted") -> DataFrame:
    """Add whether the role may take the action in the caller's own namespace to (role, own_namespace)."""
    held = matrix.withColumnRenamed("namespaces", "_spaces").withColumnRenamed("actions", "_actions")
    spaces = F.array_contains("_spaces", F.lit("*")) | F.array_contains("_spaces", F.col("own_namespace"))
    allowed = F.coalesce(spaces & F.array_contains("_actions", F.lit(action)), F.lit(False))
    return requests.join(held, "role", "left").withColumn(out, allowed).drop("_spaces", "_actions")


def namespace_gate(role: Column, namespace: Column, own: Column) -> Column:
    """True when the role may read the namespace: its own, or any for the super administrator."""
    named = F.coalesce(namespace, F.lit("")) != ""
    return (F.coalesce(role, F.lit("")) == "super_admin") | (named & F.coalesce(namespace == own, F.lit(False)))


def authorize_permission(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """The variant with permission names; a request without namespace passes, a super administrator may read all."""
    rows = requests.join(permissions, "role", "left")
    held = F.coalesce(F.array_contains("permissions", F.col("permission")), F.lit(False))
    named = F.coalesce(F.col("namespace"), F.lit("")) != ""
    reason = (
        F.when(~held, "insufficient permission")
        .when(
            (F.col("role") != "super_admin") & named & ~F.col("namespace").eqNullSafe(F.col("own_namespace")),
            "namespace mismatch",
        )
        .otherwise("ok")
    )
    return (
        rows.withColumn("reason", reason)
        .withColumn("decision", F.when(F.col("reason") == "ok", "allow").otherwise("deny"))
        .drop("permissions")
    )
