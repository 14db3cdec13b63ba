"""Queries over user functions, enrichment steps and several inputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from docsieve.operators import grouped, routing
from docsieve.operators.grouped import BatchModule, GroupReducer
from docsieve.plans.enrichment import Step, last_outputs, run_steps
from docsieve.plans.registry import query, table


class OverLimit(BatchModule):
    """Emit the rows above a limit, marked; drop the rest."""

    def setup(self, options):
        self.limit = options["limit"]

    def batch(self, rows):
        kept = rows[rows["value"] > self.limit]
        return pd.DataFrame({"event_id": kept["event_id"], "excess": (kept["value"] - self.limit).round(2)})


@query("f1_batch_module", "SELECT event_id, round(value - 100, 2) AS excess FROM events WHERE value > 100")
def f1_batch_module(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    return grouped.batch_apply(events, OverLimit, "event_id bigint, excess double", {"limit": 100.0})


class Profile(GroupReducer):
    """Rows, distinct kinds and largest value per key."""

    def reduce(self, rows):
        marks = {name: (rows["event_type"] == name).astype("int64") for name in ("click", "view")}
        return self.merge(pd.DataFrame({"k": rows["k"], "n": 1, "top": rows["value"], **marks}))

    def merge(self, reduced):
        return reduced.groupby("k", as_index=False, sort=False).agg(n=("n", "sum"), top=("top", "max"), click=("click", "sum"), view=("view", "sum"))

    def finish(self, reduced):
        return reduced[reduced["n"] > 1]


PROFILE = "k bigint, n bigint, top double, click bigint, view bigint"


@query(
    "f2_group_reducer",
    """SELECT user_id AS k, count(*) AS n, max(value) AS top, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view
       FROM events GROUP BY user_id HAVING count(*) > 1""",
)
def f2_group_reducer(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_type", "value")
    return grouped.reduce_groups(events, ["k"], Profile, PROFILE, PROFILE)


def _spread(key, frames):
    """One group streamed in batches: its smallest and largest value."""
    low, high, rows = None, None, 0
    for frame in frames:
        rows += len(frame)
        low = min(frame["value"].min(), low) if low is not None else frame["value"].min()
        high = max(frame["value"].max(), high) if high is not None else frame["value"].max()
    yield pd.DataFrame([{"user_id": key[0], "low": low, "high": high, "n": rows}])


@query("f2_streamed_groups", "SELECT user_id, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY user_id")
def f2_streamed_groups(spark, d):
    events = table(spark, d, "events").select("user_id", "value")
    return grouped.grouped_apply(events, ["user_id"], _spread, "user_id bigint, low double, high double, n bigint")


def _assign(df):
    return grouped.dynamic_groups(df, F.when(F.col("event_type") != "error", F.dayofmonth("ts").cast("bigint")))


def _profile(df, fields):
    rows = df.select(F.col(fields[0]).alias("k"), "event_type", "value")
    return grouped.reduce_groups(rows, ["k"], Profile, PROFILE, PROFILE)


@query(
    "f3_dynamic_groups",
    """SELECT day(ts)::BIGINT AS k, count(*) AS n, max(value) AS top, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view
       FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) > 1""",
)
def f3_dynamic_groups(spark, d):
    steps = [Step("assigned", _assign), Step("profiled", _profile, grouping_fields=("?",))]
    return run_steps({"events": table(spark, d, "events").select("ts", "event_type", "value")}, steps)["profiled"]


class Lines(BatchModule):
    """Emit a row for every non-empty line of a text: none, one or many per record."""

    def batch(self, rows):
        lines = rows.assign(line=rows["text"].str.split("\n")).explode("line")
        lines["line_no"] = lines.groupby("doc_id").cumcount()
        lines = lines[lines["line"] != ""]
        return pd.DataFrame({"doc_id": lines["doc_id"], "line_no": lines["line_no"], "size": lines["line"].str.len()})


@query(
    "f4_emit_many",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM l)
       SELECT doc_id, line_no, CAST(length(line) AS BIGINT) AS size FROM x WHERE line <> ''""",
)
def f4_emit_many(spark, d):
    return grouped.batch_apply(table(spark, d, "documents").select("doc_id", "text"), Lines, "doc_id bigint, line_no bigint, size bigint")


class Sorter(BatchModule):
    """Name a target for every record; records it cannot place carry an error."""

    def batch(self, rows):
        target = "/by-lang/" + rows["lang"]
        error = pd.Series(None, index=rows.index, dtype=object).where(rows["n_chars"] >= 50, "too short")
        return pd.DataFrame({"doc_id": rows["doc_id"], routing.TARGET: target, "error": error})


def _sorted(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    placed = grouped.batch_apply(docs, Sorter, f"doc_id bigint, {routing.TARGET} string, error string")
    return routing.error_channel(placed, {"function failed": F.col("error").isNull()})


@query("f6_external", "SELECT doc_id, '/by-lang/' || lang AS target FROM documents WHERE n_chars >= 50 AND lang IN ('en', 'de')")
def f6_external(spark, d):
    good, _ = _sorted(spark, d)
    return routing.emit_allowed(good, ["/by-lang/e[n]", "/by-lang/{de,it}"]).external.select("doc_id", F.col(routing.TARGET).alias("target"))


@query("f7_errored", "SELECT doc_id, 'function failed' AS reason FROM documents WHERE n_chars < 50")
def f7_errored(spark, d):
    _, bad = _sorted(spark, d)
    return bad.select("doc_id", F.col(routing.REASON).alias("reason"))


class Meet(GroupReducer):
    """Rows per input of a key."""

    def reduce(self, rows):
        return self.merge(
            pd.DataFrame({"id": rows["id"], "docs": (rows["__input"] == "docs").astype("int64"), "labels": (rows["__input"] == "labels").astype("int64"), "toxic": rows["toxic"]})
        )

    def merge(self, reduced):
        return reduced.groupby("id", as_index=False, sort=False).agg(docs=("docs", "sum"), labels=("labels", "sum"), toxic=("toxic", "max"))

    def finish(self, reduced):
        return reduced.assign(toxic=reduced["toxic"].fillna(-1).astype("int64"))


@query(
    "j3_cogroup",
    """SELECT id, CAST(sum(d) AS BIGINT) AS docs, CAST(sum(l) AS BIGINT) AS labels, CAST(COALESCE(max(toxic), -1) AS BIGINT) AS toxic FROM
       (SELECT doc_id AS id, 1 AS d, 0 AS l, NULL AS toxic FROM documents UNION ALL SELECT doc_id, 0, 1, toxic FROM labels) GROUP BY id""",
)
def j3_cogroup(spark, d):
    inputs = {
        "docs": table(spark, d, "documents").select(F.col("doc_id").alias("id")),
        "labels": table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("toxic")),
    }
    tagged = grouped.tag_inputs(inputs)
    return grouped.reduce_groups(tagged, ["id"], Meet, "id bigint, docs bigint, labels bigint, toxic double", "id bigint, docs bigint, labels bigint, toxic bigint")


STEPS = [
    Step("clean", lambda df: df.filter(F.col("value") > 0)),
    Step("big", lambda df: df.filter(F.col("value") > 100)),
    Step("errors", lambda df: df.filter(F.col("event_type") == "error"), ("clean",)),
    Step("off", lambda df: df.limit(0), ("clean",), enabled=False),
    Step("after_off", lambda df: df, ("off",)),
    Step("counted", lambda df: df.groupBy("__input", "event_type").agg(F.count(F.lit(1)).alias("n")), ("big", "errors")),
]


@query(
    "e3_steps",
    """SELECT 'big' AS input, event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY event_type
       UNION ALL SELECT 'errors', event_type, count(*) FROM events WHERE value > 0 AND event_type = 'error' GROUP BY event_type""",
)
def e3_steps(spark, d):
    outputs = last_outputs({"events": table(spark, d, "events").select("event_type", "value")}, STEPS)
    return outputs["counted"].withColumnRenamed("__input", "input")


@query("f5_mutations", "SELECT event_id, 'seen' AS event_type, value, upper(event_type) AS grp FROM events WHERE value > 50")
def f5_mutations(spark, d):
    steps = [
        Step("grouped", lambda df: grouped.dynamic_groups(df, F.upper("event_type")).filter(F.col("value") > 50)),
        Step("mutated", lambda df: df.withColumns({"grp": F.col("__group"), "event_type": F.lit("seen")}).drop("__group")),
    ]
    return run_steps({"events": table(spark, d, "events").select("event_id", "event_type", "value")}, steps)["mutated"]


class Doubled(BatchModule):
    """Doubles values; large ones are refused one by one, as by a parser that meets a bad record."""

    def batch(self, rows: pd.DataFrame) -> pd.DataFrame:
        large = rows["value"] > 250
        if large.any():
            raise ValueError(f"too large: {rows['value'][large].iloc[0]:.2f}")
        return rows[["event_id"]].assign(value=(rows["value"] * 2).round(4))


@query(
    "f7_isolated",
    """SELECT event_id, round(value * 2, 4) AS value, NULL AS message FROM events WHERE value IS NULL OR value <= 250
       UNION ALL SELECT event_id, NULL, 'ValueError: too large: ' || printf('%.2f', value) FROM events WHERE value > 250""",
)
def f7_isolated(spark, d):
    good, errors = grouped.batch_isolated(table(spark, d, "events").select("event_id", "value"), Doubled, "event_id bigint, value double")
    failed = errors.select(F.get_json_object("__row", "$.event_id").cast("bigint").alias("event_id"), F.lit(None).cast("double").alias("value"), F.col("__error").alias("message"))
    return good.withColumn("message", F.lit(None).cast("string")).unionByName(failed)
