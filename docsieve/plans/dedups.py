"""Queries over deduplication: deliveries (line items) arriving at a store of orders kept in one bucket per status."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docsieve.operators import dedup as dd
from docsieve.operators.dedup import DedupConfig
from docsieve.operators.grouped import GroupReducer
from docsieve.plans.registry import query, table

ARRIVAL = ("ts", "line", "part", "supplier", "amount")

INCOMING = """inc AS (SELECT concat_ws('-', 'l', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS _id, l_orderkey AS k, l_shipdate AS ts,
    l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_extendedprice AS amount FROM lineitem),
  old AS (SELECT 'o-' || o_orderkey AS _id, o_orderkey AS k, o_orderdate AS ts, '/orders/' || o_orderstatus AS bucket, o_totalprice AS amount FROM orders),
  last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, line DESC, part DESC, supplier DESC, amount DESC) AS rn
    FROM inc) WHERE rn = 1)"""


def incoming(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", F.lit("l"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("_id"),
        F.col("l_orderkey").alias("k"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("amount"),
    )


def stored(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.concat(F.lit("o-"), "o_orderkey").alias("_id"),
        F.col("o_orderkey").alias("k"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("/orders/"), "o_orderstatus").alias("__bucket"),
    )


def _config(policy: str, **other) -> DedupConfig:
    return DedupConfig(order=ARRIVAL, policy=policy, fields=("k",), timestamp="ts", **other)


@query(
    "d1_composite_keys",
    """SELECT lang, source, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang,
         CASE WHEN source = 'src1' THEN NULL ELSE source END AS source FROM documents)
       WHERE lang IS NOT NULL OR source IS NOT NULL GROUP BY ALL""",
)
def d1_composite_keys(spark, d):
    docs = table(spark, d, "documents").select(
        F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), F.when(F.col("source") != "src1", F.col("source")).alias("source")
    )
    keys = dd.keyed(docs, ["lang", "source"]).groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    return keys.select(F.col("__key.k0").alias("lang"), F.col("__key.k1").alias("source"), "n")


@query("d2_keep_last", "SELECT md5(text) AS digest, max(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def d2_keep_last(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return dd.keep_last(docs, ["digest"], ["doc_id"])


@query(
    "d2_keep_last_many",
    f"WITH {INCOMING} SELECT _id, k, amount FROM last",
)
def d2_keep_last_many(spark, d):
    return dd.keep_last(incoming(spark, d), ["k"], ARRIVAL).select("_id", "k", "amount")


@query("d3_lookup", "SELECT 'o-' || o_orderkey AS _id, o_orderkey AS k, o_totalprice AS amount FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def d3_lookup(spark, d):
    return dd.lookup(incoming(spark, d), stored(spark, d), _config("custom")).select("_id", "k", "amount")


@query("p3_minimal_projection", "SELECT 'o-' || o_orderkey AS _id, o_orderkey AS k FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def p3_minimal_projection(spark, d):
    return dd.lookup(incoming(spark, d), stored(spark, d), _config("leave", contexts=("/orders/P",)))


@query("d4_leave", f"WITH {INCOMING} SELECT _id, k, amount FROM last WHERE k NOT IN (SELECT k FROM old WHERE bucket = '/orders/F')")
def d4_leave(spark, d):
    return dd.dedup(incoming(spark, d), stored(spark, d), _config("leave", contexts=("/orders/F",))).emit.select("_id", "k", "amount")


@query(
    "d5_update",
    f"""WITH {INCOMING} SELECT COALESCE(old._id, last._id) AS _id, last.k AS k, last.amount AS amount FROM last LEFT JOIN old ON last.k = old.k
        WHERE old.k IS NULL OR last.ts > old.ts""",
)
def d5_update(spark, d):
    return dd.dedup(incoming(spark, d), stored(spark, d), _config("update")).emit.select("_id", "k", "amount")


@query(
    "d6_overwrite",
    f"WITH {INCOMING} SELECT COALESCE(old._id, last._id) AS _id, last.k AS k, last.amount AS amount FROM last LEFT JOIN old ON last.k = old.k",
)
def d6_overwrite(spark, d):
    return dd.dedup(incoming(spark, d), stored(spark, d), _config("overwrite")).emit.select("_id", "k", "amount")


@query(
    "d16_contexts",
    f"""WITH {INCOMING}, scope AS (SELECT * FROM old WHERE bucket = '/orders/F' OR bucket LIKE '/orders/P%')
        SELECT COALESCE(scope._id, last._id) AS _id, last.k AS k FROM last LEFT JOIN scope ON last.k = scope.k
        WHERE scope.k IS NULL OR last.ts > scope.ts""",
)
def d16_contexts(spark, d):
    config = _config("update", contexts=("/orders/F", "/orders/P*"))
    return dd.dedup(incoming(spark, d), stored(spark, d), config, small_batch=True).emit.select("_id", "k")


USERS = """new AS (SELECT user_id AS k, max(ts) AS ts FROM events GROUP BY user_id),
  old AS (SELECT 'o-' || o_orderkey AS _id, o_custkey AS k, o_orderdate AS ts, '/orders/' || o_orderstatus AS bucket FROM orders),
  ranked AS (SELECT old.*, row_number() OVER (PARTITION BY old.k ORDER BY bucket, _id) AS rn FROM old JOIN new ON old.k = new.k)"""


def _user_dedup(spark, d):
    events = table(spark, d, "events").select(
        F.concat(F.lit("e-"), "event_id").alias("_id"), F.col("user_id").alias("k"), "ts", "event_id"
    )
    orders = table(spark, d, "orders").select(
        F.concat(F.lit("o-"), "o_orderkey").alias("_id"), F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("/orders/"), "o_orderstatus").alias("__bucket"),
    )
    config = DedupConfig(order=("ts", "event_id"), policy="overwrite", fields=("k",), timestamp="ts", delete_unhandled=True)
    return events, orders, config


@query("d10_surplus", f"WITH {USERS} SELECT _id FROM ranked WHERE rn > 1")
def d10_surplus(spark, d):
    return dd.dedup(*_user_dedup(spark, d)).delete


@query(
    "d10_kept",
    f"WITH {USERS} SELECT COALESCE(r._id, 'none') AS _id, new.k AS k FROM new LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON new.k = r.k WHERE r._id IS NOT NULL",
)
def d10_kept(spark, d):
    emit = dd.dedup(*_user_dedup(spark, d)).emit
    return emit.filter(F.col("_id").startswith("o-")).select("_id", "k")


@query(
    "d18_stats",
    f"""WITH {USERS}, old_count AS (SELECT k, count(*) AS c FROM old GROUP BY k), new_count AS (SELECT user_id AS k, count(*) AS c FROM events GROUP BY 1)
        SELECT count(*) AS nonduplicate_keys, count(o.k) AS duplicate_keys,
          CAST(sum(CASE WHEN o.k IS NOT NULL THEN n.c ELSE 0 END) AS BIGINT) AS duplicates_incoming,
          CAST(COALESCE(sum(o.c), 0) AS BIGINT) AS duplicates_existing, CAST(COALESCE(sum(o.c - 1), 0) AS BIGINT) AS deleted
        FROM new_count n LEFT JOIN old_count o ON n.k = o.k""",
)
def d18_stats(spark, d):
    return dd.dedup_stats(*_user_dedup(spark, d))


# user functions: the new rows' amounts are added to the stored order they belong to ---------------------------------

REDUCED = "k0 bigint, added double, new_rows bigint, old_id string, old_amount double"
MERGED = "_id string, k bigint, amount double, new_rows bigint"


class AddUp(GroupReducer):
    """One row per group: the first stored row with the amounts of all new rows added."""

    indexed = True

    def reduce(self, rows: pd.DataFrame) -> pd.DataFrame:
        old = rows["__injected"].astype(bool)
        reduced = pd.DataFrame(
            {
                "k0": rows["k0"],
                "added": rows["amount"].where(~old, 0.0),
                "new_rows": (~old).astype("int64"),
                "old_id": rows["_id"].where(old),
                "old_amount": rows["amount"].where(old),
            }
        )
        return self.merge(reduced)

    def merge(self, reduced: pd.DataFrame) -> pd.DataFrame:
        sums = reduced.groupby("k0", as_index=False, sort=False)[["added", "new_rows"]].sum()
        old = reduced.dropna(subset=["old_id"]).sort_values("old_id").drop_duplicates("k0")
        return sums.merge(old[["k0", "old_id", "old_amount"]], on="k0", how="left")

    def finish(self, reduced: pd.DataFrame) -> pd.DataFrame:
        unmatched = "new-" + reduced["k0"].astype(str)
        return pd.DataFrame(
            {
                "_id": reduced["old_id"].where(reduced["old_id"].notna(), unmatched),
                "k": reduced["k0"],
                "amount": (reduced["added"] + reduced["old_amount"].fillna(0.0)).round(2),
                "new_rows": reduced["new_rows"],
            }
        )


def _custom(spark, d, config):
    groups = dd.custom_groups(incoming(spark, d), stored(spark, d), config)
    return dd.custom_reduce(groups, AddUp, REDUCED, MERGED, columns=["_id", "amount", "__injected"])


CUSTOM = """SELECT COALESCE(o._id, 'new-' || i.k) AS _id, i.k AS k, round(i.amount + COALESCE(o.amount, 0), 2) AS amount, i.n AS new_rows
  FROM (SELECT k, sum(amount) AS amount, count(*) AS n FROM inc GROUP BY k) i"""


@query("d7_custom", f"WITH {INCOMING} {CUSTOM} JOIN old o ON i.k = o.k")
def d7_custom(spark, d):
    return _custom(spark, d, _config("custom"))


@query(
    "d8_custom_update",
    f"WITH {INCOMING} {CUSTOM} JOIN old o ON i.k = o.k JOIN last ON last.k = i.k WHERE last.ts > o.ts",
)
def d8_custom_update(spark, d):
    return _custom(spark, d, _config("custom_update"))


UNMATCHED = """SELECT last._id, last.k, round(last.amount, 2), NULL FROM last LEFT JOIN {old} o ON last.k = o.k WHERE o.k IS NULL"""


def _custom_all(spark, d, config):
    out = dd.dedup_custom(incoming(spark, d), stored(spark, d), config, AddUp, REDUCED, MERGED, columns=["_id", "amount", "__injected"])
    return out.emit.select("_id", "k", F.round("amount", 2).alias("amount"), "new_rows")


ONE_BUCKET = f"WITH {INCOMING}, old_one AS (SELECT * FROM old WHERE bucket = '/orders/F') {CUSTOM} JOIN old_one o ON i.k = o.k"


@query("d7_custom_all", f"{ONE_BUCKET} UNION ALL {UNMATCHED.format(old='old_one')}")
def d7_custom_all(spark, d):
    return _custom_all(spark, d, _config("custom", contexts=("/orders/F",)))


@query(
    "d8_custom_update_all",
    f"{ONE_BUCKET} JOIN last ON last.k = i.k WHERE last.ts > o.ts UNION ALL {UNMATCHED.format(old='old_one')}",
)
def d8_custom_update_all(spark, d):
    return _custom_all(spark, d, _config("custom_update", contexts=("/orders/F",)))


@query("d9_finalize_all", f"WITH {INCOMING} {CUSTOM} LEFT JOIN (SELECT * FROM old WHERE bucket = '/orders/F') o ON i.k = o.k")
def d9_finalize_all(spark, d):
    return _custom(spark, d, _config("custom", contexts=("/orders/F",), finalize_all=True))


# emission checks: every stored order is handled by a function that emits four rows --------------------------------------


def _emissions(spark, d):
    old = dd.keyed(stored(spark, d), ["k"])

    def row(seq, row_id, own, amount):
        return F.struct(
            F.lit(seq).alias("seq"), row_id.cast("string").alias("_id"), own.cast("bigint").alias("own"), amount.cast("double").alias("amount")
        )

    key, nothing = F.col("k"), F.lit(None)
    rows = F.array(
        row(1, F.col("_id"), key, F.col("amount")),
        row(2, F.concat(F.lit("n-"), key), key, F.col("amount")),
        row(3, nothing, -key - 1, F.col("amount")),
        row(4, F.concat(F.lit("gone-"), key), nothing, nothing),
    )
    emitted = old.select("__key", F.explode(F.when(F.col("__bucket") == "/orders/P", F.slice(rows, 3, 2)).otherwise(rows)).alias("r"))
    return emitted.select("__key", "r.*"), old.select("__key", "_id")


def _checked(spark, d, policy):
    emitted, members = _emissions(spark, d)
    return dd.check_emissions(emitted, members, F.col("own"), policy, ["seq"]), members


def _counts(checked):
    return checked.groupBy(F.col("seq").cast("bigint").alias("seq"), F.col("__action").alias("action"), F.col("__ok").alias("ok")).agg(
        F.count(F.lit(1)).alias("n")
    )


EMITTED = """WITH emitted AS (SELECT o_orderkey AS k, o_orderstatus AS status, seq FROM orders, (VALUES (1), (2), (3), (4)) v(seq)
  WHERE o_orderstatus <> 'P' OR seq >= 3)
  SELECT CAST(seq AS BIGINT) AS seq, CASE WHEN seq = 4 THEN 'delete' ELSE 'write' END AS action, {ok} AS ok, count(*) AS n FROM emitted GROUP BY ALL"""


@query("d13_lax", EMITTED.format(ok="true"))
def d13_lax(spark, d):
    return _counts(_checked(spark, d, "lax")[0])


@query("d14_strict", EMITTED.format(ok="seq <> 2"))
def d14_strict(spark, d):
    return _counts(_checked(spark, d, "strict")[0])


@query("d15_very_strict", EMITTED.format(ok="(status = 'P' AND seq = 3) OR (status <> 'P' AND seq = 1)"))
def d15_very_strict(spark, d):
    return _counts(_checked(spark, d, "very_strict")[0])


@query("d12_manual_delete", "SELECT 'gone-' || o_orderkey AS _id FROM orders")
def d12_manual_delete(spark, d):
    checked, members = _checked(spark, d, "strict")
    return dd.unhandled_ids(checked, members, delete_unhandled=False)


@query(
    "d11_unhandled",
    "SELECT 'gone-' || o_orderkey AS _id FROM orders UNION ALL SELECT 'o-' || o_orderkey FROM orders WHERE o_orderstatus = 'P'",
)
def d11_unhandled(spark, d):
    checked, members = _checked(spark, d, "strict")
    return dd.unhandled_ids(checked, members, delete_unhandled=True)


# a custom policy with emission policy and deletions: the function emits the merged order under its stored id, the same under a new id, a
# row of another key, and a row with nothing but an id; of pending orders only the last two

HANDLED = "_id string, k bigint, amount double"


class Handle(AddUp):
    def finish(self, reduced: pd.DataFrame) -> pd.DataFrame:
        total = (reduced["added"] + reduced["old_amount"].fillna(0.0)).round(2)
        key, pending = reduced["k0"], reduced["k0"] % 5 == 0
        rows = [
            pd.DataFrame({"_id": reduced["old_id"], "k": key, "amount": total})[~pending],
            pd.DataFrame({"_id": "n-" + key.astype(str), "k": key, "amount": total})[~pending],
            pd.DataFrame({"_id": None, "k": -key - 1, "amount": total}),
            pd.DataFrame({"_id": "gone-" + key.astype(str), "k": pd.array([None] * len(key), dtype="Int64"), "amount": None}, index=key.index),
        ]
        return pd.concat([part.astype({"k": "Int64", "amount": "float64"}) for part in rows])


def _handled(spark, d, **other):
    config = _config("custom", contexts=("/orders/F",), **other)
    return dd.dedup_custom(incoming(spark, d), stored(spark, d), config, Handle, REDUCED, HANDLED, columns=["_id", "amount", "__injected"])


HANDLING = f"""WITH {INCOMING}, o AS (SELECT * FROM old WHERE bucket = '/orders/F'),
  m AS (SELECT i.k, o._id AS old_id, i.k % 5 = 0 AS pending, round(i.amount + o.amount, 2) AS amount
        FROM (SELECT k, sum(amount) AS amount FROM inc GROUP BY k) i JOIN o ON i.k = o.k),
  e AS (SELECT 1 AS seq, k AS g, old_id AS _id, k, amount FROM m WHERE NOT pending UNION ALL
        SELECT 2, k, 'n-' || k, k, amount FROM m WHERE NOT pending UNION ALL SELECT 3, k, NULL, -k - 1, amount FROM m),
  through AS (SELECT last._id, last.k, round(last.amount, 2) AS amount FROM last LEFT JOIN o ON last.k = o.k WHERE o.k IS NULL)"""


def _outcome(result):
    emit = result.emit.select(F.lit("emit").alias("what"), "_id", "k", F.round("amount", 2).alias("amount"))
    return emit.unionByName(result.errors.select(F.lit("error").alias("what"), "_id", "k", F.round("amount", 2).alias("amount")))


@query(
    "d11_custom_all",
    f"{HANDLING} SELECT 'gone-' || k AS _id FROM m UNION ALL SELECT old_id FROM m WHERE pending",
)
def d11_custom_all(spark, d):
    return _handled(spark, d, delete_unhandled=True).delete


@query(
    "d14_custom_all",
    f"""{HANDLING} SELECT CASE WHEN seq = 2 THEN 'error' ELSE 'emit' END AS what, _id, k, amount FROM e
        UNION ALL SELECT 'emit', _id, k, amount FROM through""",
)
def d14_custom_all(spark, d):
    return _outcome(_handled(spark, d))


@query(
    "d15_custom_all",
    f"""{HANDLING} SELECT CASE WHEN seq = first THEN 'emit' ELSE 'error' END AS what, _id, k, amount
        FROM (SELECT *, min(seq) OVER (PARTITION BY g) AS first FROM e) UNION ALL SELECT 'error', 'gone-' || k, NULL, NULL FROM m
        UNION ALL SELECT 'emit', _id, k, amount FROM through""",
)
def d15_custom_all(spark, d):
    return _outcome(_handled(spark, d, emission="very_strict"))
