"""Masking of secrets, effective permissions, and tamper-evident audit chains."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import jsonfn
from tracelake.functions.jsonfn import ALWAYS_SECRET, MASK

#: fixed values
GENESIS = "0" * 64
SECRET_FIELDS = ("geheimnis", "klartext", "lm_hash", "nt_hash", "schluessel", "wert")


def mask_fields(fields: Column, sensitive: Column, names: Sequence[str] = SECRET_FIELDS) -> Column:
    """Secret fields of a sensitive object, where they have a value, are masked."""
    return F.when(sensitive, F.transform_values(fields, lambda k, v: F.when(k.isin(*names) & v.isNotNull(), F.lit(MASK)).otherwise(v))).otherwise(fields)


def masked_json(value: object, secret: bool = False, always: Sequence[str] = ALWAYS_SECRET, scoped: str = "wert") -> object:
    """Nested values with secrets masked: always-secret keys anywhere, ``wert`` inside a secret scope, which its children inherit."""
    if isinstance(value, dict):
        inside = secret or value.get("sensibel") in (True, "true")
        return {k: MASK if k in always or (inside and k == scoped) else masked_json(v, inside, always, scoped) for k, v in value.items()}
    if isinstance(value, list):
        return [masked_json(v, secret, always, scoped) for v in value]
    return value


def masked_documents(rows: DataFrame, document: str, secret: str | None = None, always: Sequence[str] = ALWAYS_SECRET, scoped: str = jsonfn.SCOPED) -> DataFrame:
    """The rows with a JSON column masked at any depth; ``secret`` names a flag column that puts a whole row in the secret scope.

    A secret row whose value is no object is masked whole; text that is no JSON is null. Keys come out in order; see ``jsonfn.masked``.
    """
    return rows.withColumn(document, jsonfn.masked(F.col(document), F.col(secret) if secret else None, always, scoped)["json"])


def search_documents(rows: DataFrame, document: str, secret: str | None = None) -> DataFrame:
    """The rows with a JSON column masked and turned to its searchable text, and ``too_deep``; empty for what is no JSON, so that it is a row and matches nothing."""
    made = jsonfn.masked(F.col(document), F.col(secret) if secret else None)
    return rows.withColumn("_made", made).withColumns({document: F.coalesce("_made.text", F.lit("")), "too_deep": F.coalesce("_made.too_deep", F.lit(False))}).drop("_made")


def audit_row(user: str, action: str, case: str, time: str, searched: str | None = None, **details: object) -> str:
    """The payload of a read's audit row: canonical JSON, in which a search term stands as its SHA-256 only."""
    named = dict(details)
    if searched is not None:
        named["suche_sha256"] = hashlib.sha256(searched.encode()).hexdigest()
    return json.dumps({"benutzer": user, "aktion": action, "fall": case, "zeit": time, "details": named}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def audited(result: DataFrame, trail: str, payload: str) -> DataFrame:
    """Writes a read's audit row to the trail (a Parquet table, one small file a read) before the result is handed out; without the row there is no result."""
    spark = result.sparkSession
    spark.range(1).select(F.lit(payload).alias("payload"), F.current_timestamp().alias("written")).write.mode("append").parquet(trail)
    return result


def role_update(held: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("user_id", "role")) -> DataFrame:
    """What changes roles held into those wanted: rows with ``change`` ``revoke`` or ``grant``. Roles in both stay untouched."""
    keys = list(keys)
    gone = held.select(*keys).distinct().join(wanted.select(*keys), keys, "left_anti").withColumn("change", F.lit("revoke"))
    return gone.union(wanted.select(*keys).distinct().join(held.select(*keys), keys, "left_anti").withColumn("change", F.lit("grant")))


def optimistic_update(table: DataFrame, changes: DataFrame, key: str, values: Sequence[str], version: str = "updated_at", expected: str = "expected") -> DataFrame:
    """Every change with ``outcome``: ``updated`` where the row still has the version expected, ``conflict`` where it has another, ``missing`` where there is none; and the row's values after it."""
    now = table.select(key, F.col(version).alias("_version"), *(F.col(v).alias(f"_{v}") for v in values))
    both = changes.join(now, key, "left")
    fits = F.col("_version").eqNullSafe(F.col(expected))
    outcome = F.when(F.col("_version").isNull(), "missing").when(fits, "updated").otherwise("conflict")
    return both.select(key, outcome.alias("outcome"), *(F.when(F.col("_version").isNotNull() & fits, F.col(v)).otherwise(F.col(f"_{v}")).alias(v) for v in values))


def bookmarks_after(held: DataFrame, changes: DataFrame, keys: Sequence[str], time: str, deleted: str, values: Sequence[str]) -> DataFrame:
    """Bookmarks after upserts and soft deletes: the latest change of each key wins, a deleted one stays with its mark, a new upsert revives it; the first time stays as ``created``."""
    every = held.select(*keys, time, deleted, *values).unionByName(changes.select(*keys, time, deleted, *values))
    latest = F.max_by(F.struct(deleted, *values), F.struct(F.col(time), ~F.col(deleted)))
    return every.groupBy(*keys).agg(F.min(time).alias("created"), F.max(time).alias("changed"), latest.alias("_l")).select(*keys, "created", "changed", "_l.*")


def chain_hash(previous: Column, sequence: Column, payload: Column) -> Column:
    """SHA-256 over the previous hash, the number and the payload, a line each."""
    return F.sha2(F.encode(F.concat(previous, F.lit("\n"), sequence.cast("string"), F.lit("\n"), payload), "UTF-8"), 256)


def build_chains(events: DataFrame, chain: str, sequence: str, payload: str) -> DataFrame:
    """Hashes of each chain's events in order: chain, sequence, payload, previous_hash, hash.

    A chain is serial by nature, but no more than its last hash is carried along: rows stream, sorted, through
    the task that has their chain. Cut long histories into chains (a case, a day), which run in parallel.
    """
    kind = events.schema[chain].dataType.simpleString()
    rows = events.select(chain, F.col(sequence).cast("bigint").alias("sequence"), F.col(payload).cast("string").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, GENESIS
        for batch in batches:
            before, after = [], []
            for c, n, p in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c,) != now:
                    now, last = (c,), GENESIS
                before.append(last)
                last = hashlib.sha256(f"{last}\n{n}\n{p}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[chain, "sequence", "payload", "previous_hash", "hash"])

    return rows.repartition(chain).sortWithinPartitions(chain, "sequence").mapInArrow(run, f"`{chain}` {kind}, sequence bigint, payload string, previous_hash string, hash string")


def verify_chains(rows: DataFrame, chain: str) -> DataFrame:
    """Checks of every row at once: ``gap`` in the numbers, wrong ``predecessor``, wrong ``content`` hash."""
    w = Window.partitionBy(chain).orderBy("sequence")
    return rows.withColumns({"gap": F.col("sequence") != F.lag("sequence", 1, 0).over(w) + 1, "predecessor": F.col("previous_hash") != F.lag("hash", 1, GENESIS).over(w), "content": F.col("hash") != chain_hash(F.col("previous_hash"), F.col("sequence"), F.col("payload"))})


def head_matches(rows: DataFrame, heads: DataFrame, chain: str) -> DataFrame:
    """Whether the last row's hash and number are those kept elsewhere as the chain's head."""
    last = rows.groupBy(chain).agg(F.max_by("hash", "sequence").alias("last_hash"), F.max("sequence").alias("last_sequence"))
    return heads.join(last, chain, "left").withColumn("head_ok", F.coalesce((F.col("head_hash") == F.col("last_hash")) & (F.col("head_sequence") == F.col("last_sequence")), F.lit(False)))


def effective_permissions(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """Distinct (user_id, permission) of active users; super-administrators have all."""
    active = users.where("active")
    by_role = active.join(user_roles, "user_id").join(role_permissions, "role").select("user_id", "permission")
    every = active.where("superadmin").select("user_id").join(F.broadcast(permissions.select("permission")))
    return by_role.union(every).distinct()
