"""A replication log and what its nodes agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that the last node may lag behind, and the step between the three.
LAG, STEP = 1000, 300


def entries(log: DataFrame) -> DataFrame:
    """idx, term, key, operation, value."""
    return log.select((F.col("seq") + 1).alias("idx"), (F.floor(F.col("seq") / 1000) + 1).cast("long").alias("term"), "key", F.when(F.col("is_tombstone"), "delete").otherwise("put").alias("operation"), "value")


def nodes(rl: DataFrame) -> DataFrame:
    """Three nodes and the last entry each holds."""
    last = rl.agg(F.max("idx")).scalar()
    held = rl.where(F.col("idx") <= last - LAG + STEP * (F.col("idx") % 3))
    return held.groupBy(F.concat(F.lit("node"), (F.col("idx") % 3 + 1).cast("string")).alias("node")).agg(F.max("idx").cast("long").alias("match_index"))


def commit_index(rl: DataFrame) -> DataFrame:
    """The entry that a majority holds: of n sorted indexes the one at n / 2, rounded down."""
    return nodes(rl).agg(F.sort_array(F.collect_list("match_index")).alias("m")).select(F.element_at("m", (F.floor(F.size("m") / 2) + 1).cast("int")).alias("commit_index"))


def election(rl: DataFrame) -> DataFrame:
    """Votes of nodes whose log is not too far behind, and whether they are a majority of all nodes."""
    need = rl.agg(F.max("idx")).scalar() - LAG
    return nodes(rl).agg(F.count_if(F.col("match_index") >= need).alias("votes"), F.count("*").alias("n")).select("votes", (F.col("votes") > F.floor(F.col("n") / 2)).alias("won"))


def commit_of_term(rl: DataFrame, committed: int = 0) -> DataFrame:
    """A leader commits what a majority holds only where that entry is of the current term; else ``committed`` stays."""
    at = rl.where(F.col("idx") == commit_index(rl).scalar()).select("idx", "term")
    now = rl.agg(F.max("term")).scalar()
    return at.select(F.col("idx").alias("majority_index"), "term", F.when(F.col("term") == now, F.col("idx")).otherwise(F.lit(committed)).cast("long").alias("commit_index"))


def peers(rl: DataFrame) -> DataFrame:
    """Each node and the others."""
    every = nodes(rl).agg(F.sort_array(F.collect_list("node")).alias("every"))
    return nodes(rl).crossJoin(F.broadcast(every)).select("node", F.array_join(F.array_except("every", F.array("node")), ",").alias("peers"))


def append_accepted(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Whether a node takes entries behind (prev_log_index, prev_log_term): only if its own log (node, idx, term) has that entry with that term."""
    own = held.select("node", F.col("idx").alias("prev_log_index"), F.col("term").alias("own_term"))
    return requests.join(own, ["node", "prev_log_index"], "left").select("node", "prev_log_index", F.coalesce(F.col("own_term") == F.col("prev_log_term"), F.lit(False)).alias("accepted"))


def log_match(rl: DataFrame) -> DataFrame:
    """Each node's last entry with its term."""
    return nodes(rl).join(rl.select(F.col("idx").alias("match_index"), F.col("term").alias("prev_log_term")), "match_index").select("node", "match_index", "prev_log_term")


def applied(rl: DataFrame) -> DataFrame:
    """The live view of the entries up to the commit index."""
    held = rl.where(F.col("idx") <= commit_index(rl).scalar())
    last = held.groupBy("key").agg(F.max_by(F.struct("operation", "value"), "idx").alias("x"))
    return last.where("x.operation = 'put'").select("key", "x.value")
