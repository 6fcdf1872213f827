"""Which files a user may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allowed_files_of_user(users: DataFrame, catalog: DataFrame) -> DataFrame:
    """users (username, file_id) with the rows of their files; unknown ids drop out."""
    return users.join(catalog, users["file_id"] == catalog["id"]).drop(users["file_id"])


def apply_file_access(df: DataFrame, users: DataFrame, allowed: DataFrame, catalog: DataFrame, username: str, file_col: str = "pst_file") -> DataFrame:
    """Rows that a user may see. Admins, unknown users and users without a list see all; others only the mails of the files on
    their list. The decision is part of the plan: a one-row aggregate and a semi join, nothing is collected."""
    mine = allowed.where(F.col("username") == username).join(catalog.select(F.col("id").alias("file_id"), F.col(file_col).alias("_file")), "file_id").select("_file").distinct()
    admin = users.where((F.col("username") == username) & F.col("is_admin")).agg((F.count(F.lit(1)) > 0).alias("_admin"))
    listed = allowed.where(F.col("username") == username).agg((F.count(F.lit(1)) > 0).alias("_listed"))
    free = admin.join(listed).where("_admin or not _listed").select(F.lit(True).alias("_free"))
    seen = df.join(mine, df[file_col] == F.col("_file"), "left").join(F.broadcast(free), F.lit(True), "left")  # free has one row at most
    return seen.where("_free or _file is not null").drop("_file", "_free")
