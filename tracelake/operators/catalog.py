"""File catalogs: listings, summaries, snapshot differences and paths rebuilt along parent chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.registry import attributes

MOST_DEPTH = 128


def has_extension(column: str, extension: str) -> Column:
    """The name ends with a dot and the extension, whatever the case."""
    return F.lower(F.right(F.col(column), F.lit(len(extension) + 1))) == F.lit("." + extension.lower())


def with_children_flag(directories: DataFrame, children: DataFrame, key: str, parent: str) -> DataFrame:
    """``has_children`` by a join on distinct parents."""
    parents = children.select(F.col(parent).alias(key)).distinct().withColumn("has_children", F.lit(True))
    return directories.join(parents, key, "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def snapshot_diff(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Files of a snapshot (path, sha256, size) against the live state, by path whatever the case: ``only_snapshot``, ``different`` or ``not_checkable``; equal ones are left out.

    Sizes decide without hashes where they differ.
    """
    a = snapshot.select(F.lower("path").alias("key"), F.col("path"), F.col("sha256").alias("old_sha"), F.col("size").alias("old_size"))
    b = live.select(F.lower("path").alias("key"), F.col("sha256").alias("new_sha"), F.col("size").alias("new_size"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "only_snapshot").when(F.col("old_size") != F.col("new_size"), "different").when(F.col("old_sha").isNull() | F.col("new_sha").isNull(), "not_checkable").when(F.col("old_sha") != F.col("new_sha"), "different")
    return a.join(b, "key", "left").withColumn("status", status).where("status IS NOT NULL").select("path", "status")


#: fixed values: names of the statuses, and the differing files that are told one by one
DIFFERENCES, MOST_DIFFERENCES = ("nur_im_snapshot", "inhalt_abweichend", "nicht_pruefbar"), 200_000


def snapshot_statuses(files: DataFrame) -> DataFrame:
    """Every file of every snapshot against the live state of its volume, by path whatever the case: volume, store, path, ``status`` (null for equal ones), size, ``live_size`` and ``live_record``.

    ``files`` are volume, store (null: live), path, mft_record, size and sha256, of all snapshots in one table. They are dealt once, by
    path, whatever the number of snapshots; one window gives each the live file of its path (of several the one with the smallest record).
    """
    path = Window.partitionBy("volume", F.lower("path"))
    live = F.min(F.when(F.col("store").isNull(), F.struct("mft_record", "size", "sha256"))).over(path)
    only, other, unknown = DIFFERENCES
    status = F.when(F.col("live").isNull(), only).when(F.col("size") != F.col("live.size"), other).when(F.col("sha256").isNull() | F.col("live.sha256").isNull(), unknown).when(F.col("sha256") != F.col("live.sha256"), other)
    return files.withColumn("live", live).where("store IS NOT NULL").select("volume", "store", "path", "mft_record", status.alias("status"), "size", F.col("live.size").alias("live_size"), F.col("live.mft_record").alias("live_record"))


def snapshot_summaries(statuses: DataFrame) -> DataFrame:
    """A finding a snapshot: its number, files, and how many differ in which way."""
    counts = statuses.groupBy("volume", "store").agg(F.count(F.lit(1)).alias("files"), *(F.count_if(F.col("status") == s).alias(s) for s in DIFFERENCES))
    values = attributes(nummer=F.col("store") + 1, volume_offset=F.col("volume"), dateien_im_snapshot=F.col("files"), **{s: F.col(s) for s in DIFFERENCES})
    return counts.select("volume", "store", F.lit("vss").alias("domain"), F.concat(F.lit("Schattenkopie "), (F.col("store") + 1).cast("string")).alias("name"), F.concat(F.lit("Offset "), F.col("volume").cast("string")).alias("source"), values.alias("attributes"))


def snapshot_findings(statuses: DataFrame, most: int = MOST_DIFFERENCES) -> tuple[DataFrame, DataFrame]:
    """A finding a differing file, the first ``most`` by volume, store, path and record (a sort with a limit), and one row with the number ``left_out``."""
    differing = statuses.where(F.col("status").isNotNull())
    first = differing.orderBy("volume", "store", "path", "mft_record").limit(most)
    values = attributes(
        art=F.lit("vss_datei"), status=F.col("status"), herkunft=F.concat(F.lit("VSS#"), (F.col("store") + 1).cast("string")), vss_volume_offset=F.col("volume"), mft_record=F.col("mft_record"), groesse=F.col("size"),
        live_groesse=F.col("live_size"), live_mft_record=F.col("live_record"), ntfs_metadatei=F.when(F.startswith("path", F.lit("$")), "ja"),
    )
    findings = first.select("volume", "store", F.lit("vss").alias("domain"), F.element_at(F.split("path", r"\\"), -1).alias("name"), F.col("path").alias("source"), values.alias("attributes"))
    return findings, differing.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("left_out"))


def same_source(evidence: DataFrame, case: str, evidence_id: str, sha256: str) -> DataFrame:
    """Every evidence with an earlier one of the same case and hash, linked to the first: a star, not all pairs."""
    first = evidence.where(F.col(sha256).isNotNull()).groupBy(case, sha256).agg(F.min(evidence_id).alias("first_id"))
    return evidence.join(first, [case, sha256]).where(F.col(evidence_id) > F.col("first_id")).select(F.col(evidence_id).alias("evidence_id"), "first_id")


def possibly_same(files: DataFrame) -> DataFrame:
    """Drive-letter paths and device paths with the same rest: ``a_id`` and ``b_id`` (columns file_id, volume, rest)."""
    letters = files.where(F.col("volume").rlike("^[a-z]:$")).select("rest", F.col("file_id").alias("a_id"))
    devices = files.where(F.col("volume").rlike("^harddiskvolume")).select("rest", F.col("file_id").alias("b_id"))
    return letters.join(devices, "rest").select("a_id", "b_id")


def rebuilt_paths(records: DataFrame, root: int = 5, rounds: int = MOST_DEPTH, checkpoint_every: int = 8) -> DataFrame:
    """``record`` and ``path`` from (record, sequence, name, parent, parent_sequence); null where the chain breaks.

    Chains are doubled: after round k every record knows the names of ``2**k`` ancestors and where they stop,
    so depth 128 takes 7 joins. The parent's sequence must agree at every step; cycles never reach the root
    and are unknown, as are chains of ``rounds`` steps or more.
    """
    links = records.select("record", "sequence", F.col("name").alias("path"), F.col("parent").alias("up"), F.col("parent_sequence").alias("up_sequence"), F.lit(1).alias("depth"))
    steps, n = max(1, (rounds - 1).bit_length()), 0
    state = links
    while n < steps:
        parents = state.select(F.col("record").alias("up"), F.col("sequence").alias("p_sequence"), F.col("path").alias("p_path"), F.col("up").alias("p_up"), F.col("up_sequence").alias("p_up_sequence"), F.col("depth").alias("p_depth"))
        joined = state.join(parents, "up", "left")
        at_root = F.col("up") == root
        sound = F.col("p_path").isNotNull() & (F.col("p_sequence") == F.col("up_sequence"))
        state = joined.select(
            "record", "sequence",
            F.when(at_root, F.col("path")).when(sound, F.concat("p_path", F.lit("\\"), "path")).alias("path"),
            F.when(at_root, F.col("up")).when(sound, F.col("p_up")).alias("up"),
            F.when(at_root, F.col("up_sequence")).when(sound, F.col("p_up_sequence")).alias("up_sequence"),
            F.when(at_root, F.col("depth")).otherwise(F.col("depth") + F.col("p_depth")).alias("depth"),
        )
        n += 1
        if n % checkpoint_every == 0 and records.sparkSession.sparkContext.getCheckpointDir():
            state = state.checkpoint()
    return state.select("record", F.when((F.col("up") == root) & (F.col("depth") < rounds), F.col("path")).alias("path"))


def cases_with_evidence(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every case with the number of its evidence and their ids by time of import, comma-joined; null without any."""
    order = F.array_sort(F.collect_list(F.struct("imported", "evidence_id")))
    listed = evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.array_join(F.transform(order, lambda e: e["evidence_id"].cast("string")), ",").alias("evidence"))
    return cases.join(listed, "case_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))


def registered(held: DataFrame, offered: DataFrame) -> DataFrame:
    """Evidence offered (evidence_id, sha256) as ``new``, ``known``, or a ``conflict`` with other bytes held under its id."""
    known = held.select("evidence_id", F.col("sha256").alias("_held"))
    outcome = F.when(F.col("_held").isNull(), "new").when(F.col("_held") == F.col("sha256"), "known").otherwise("conflict")
    return offered.join(known, "evidence_id", "left").select("evidence_id", outcome.alias("outcome"))
