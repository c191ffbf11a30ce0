"""Deterministic views over the test tables, which feed the registered queries.

The tables hold no images, boxes or masks, so the queries derive them by integer
arithmetic.  Every view exists twice: as a DataFrame here, and as SQL text (CTES) for the
independent check.  They are scaffolding for tests, not part of any operator.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = ("person", "Player card.", "chart", "table, frame", "information icon", "a portrait", "panel", "logo.")
STATES = ("pending", "pending_gate", "failed", "frozen", "inactive")
VERBS = ("accept", "discard", "merge", "split", "expand", "shrink", "retry", "suppress_text")
PAGE_STATE = {"signup": "pending", "view": "processing", "click": "awaiting_agent", "purchase": "validated", "error": "failed"}
RUN_STATE = {"signup": "created", "view": "prepared", "click": "running", "purchase": "finalizing", "error": "failed"}
TRACE_KIND = {"signup": "model_load_start", "view": "span", "click": "worker", "purchase": "inference_finish", "error": "model_load_finish"}


def _map(column, table: dict):
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return m[column]


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def boxes(self) -> DataFrame:
        li = self.table("lineitem")
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        li = li.withColumn("ord", F.row_number().over(order))
        size = lambda c: c.cast("int")
        return li.select(
            F.col("l_orderkey").alias("page"),
            "ord",
            size(F.col("l_partkey") % 900).alias("x"),
            size((F.col("l_suppkey") * 7) % 500).alias("y"),
            size(20 + 4 * F.floor("l_quantity")).alias("w"),
            size(10 + (F.col("l_partkey") + F.col("l_suppkey")) % 80).alias("h"),
            F.col("ord").alias("z"),
            (1 - F.col("l_discount")).alias("score"),
            _pick(F.col("l_partkey") % 8, LABELS).alias("label"),
            (F.col("l_linestatus") == "F").alias("edge"),
            F.when(F.col("l_returnflag") == "R", "sam").otherwise("detector").alias("source"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        b = self.boxes
        return b.select(
            "page",
            (F.col("page") * 100 + F.col("ord")).alias("node"),
            F.when(F.col("ord") <= 2, "parent").when(F.col("ord") % 4 == 0, "text").otherwise("child").alias("kind"),
            F.when(F.col("ord") > 2, F.col("page") * 100 + F.floor(F.col("ord") / 2)).cast("long").alias("parent"),
            _pick((F.col("x") + F.col("y")) % 5, STATES).alias("state"),
            "x", "y", "w", "h", "z", "ord", "score",
        )

    @cached_property
    def actions(self) -> DataFrame:
        n = self.nodes.filter((F.col("x") % 3) != 0)
        return n.select("page", "node", _pick(F.col("y") % 8, VERBS).alias("verb"), "score", "ord", F.array(F.col("node"), F.col("page") * 100 + 1).alias("cited"))

    @cached_property
    def cells(self) -> DataFrame:
        """One row per pixel of an 8 x 8 picture per vector."""
        e = self.table("embeddings").select(F.col("vec_id").alias("page"), "label", F.posexplode("embedding").alias("i", "v"))
        px = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 0.6) * 212))).cast("int")
        return e.select("page", "label", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), px.alias("px"), (F.col("v") > 0).alias("mask"))

    @cached_property
    def pictures(self) -> DataFrame:
        """page, other (the next vector of its label), px and other_px as arrays of 64."""
        px = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.6) * 212))).cast("int"))
        e = self.table("embeddings").select(F.col("vec_id").alias("page"), "label", px.alias("px"), F.transform("embedding", lambda v: v > 0).alias("mask"))
        nxt = Window.partitionBy("label").orderBy("page")
        return e.withColumn("other_px", F.coalesce(F.lead("px").over(nxt), F.col("px"))).withColumn("other_mask", F.coalesce(F.lead("mask").over(nxt), F.col("mask")))

    @cached_property
    def trace(self) -> DataFrame:
        e = self.table("events")
        ms = F.round(F.col("value") * 1000).cast("long")
        return e.select(
            F.col("user_id").alias("page"),
            "event_id",
            "ts",
            _map(F.col("event_type"), TRACE_KIND).alias("event"),
            F.concat(F.lit("stage"), (F.col("event_id") % 5).cast("string")).alias("stage"),
            F.concat(F.lit("model"), (F.col("event_id") % 3).cast("string")).alias("model"),
            ms.alias("duration_ms"),
            F.when(F.col("event_id") % 7 == 0, "error").otherwise("success").alias("status"),
            (F.col("event_id") % 11).alias("operation_count"),
        )

    @cached_property
    def state_log(self) -> DataFrame:
        e = self.table("events")
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return e.select(F.col("user_id").alias("page"), F.row_number().over(order).alias("seq"), _map(F.col("event_type"), PAGE_STATE).alias("state"), _map(F.col("event_type"), RUN_STATE).alias("run_state"), F.col("ts").cast("timestamp").alias("ts"), "value")

    @cached_property
    def text_items(self) -> DataFrame:
        d = self.table("documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
        n = F.length("text")
        return d.select(
            "page", F.col("ord").cast("int").alias("ord"), "text",
            ((F.col("page") * 37 + F.col("ord") * 11) % 700).cast("int").alias("x"),
            ((F.col("ord") * 24 + F.col("page") % 7) % 900).cast("int").alias("y"),
            F.least(F.lit(900), 8 * n + 4).cast("int").alias("w"),
            (16 + (F.col("page") + F.col("ord")) % 90).cast("int").alias("h"),
            (((F.col("page") * 31 + F.col("ord") * 17) % 100) / 100).alias("confidence"),
            (10 + ((F.col("page") + F.col("ord")) % 90).cast("double")).alias("font_size"),
            F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("page") * 7919 + F.col("ord") * 104729) % 16777216)), 6, "0")).alias("color"),
            ((F.col("page") + F.col("ord")) % 3 == 0).alias("bold"),
        )

    @cached_property
    def rounds(self) -> DataFrame:
        c = self.table("conversations")
        n = F.length("text")
        return c.select(
            F.col("conv_id").alias("page"), F.col("turn").alias("round"), "role",
            (n % 13).cast("double").alias("mae"), (n % 37).cast("double").alias("p95"), (n % 5).cast("double").alias("largest"),
            (n % 7).cast("double").alias("unexplained"), (n % 4).cast("long").alias("violations"), (n % 3 == 0).alias("accepted"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        d = self.table("documents").join(self.table("labels"), "doc_id")
        return d.select(
            (F.col("doc_id") % 50).alias("page"), F.col("doc_id").alias("object"), F.when(F.col("quality") == 1, "replace").otherwise("preserve").alias("decision"),
            F.when(F.col("toxic") == 1, "decorative").otherwise("full_slide_screenshot").alias("category"), (0.85 + (F.col("n_chars") % 15) / 100).alias("confidence"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        """Start tags of the raw pages, in order: a stand-in for a shape tree's objects."""
        p = self.table("pages").select(F.col("page_id").alias("page"), F.posexplode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1)).alias("ord", "tag"))
        return p


def _case(column: str, table: dict) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _choice(index: str, values) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_PX = "greatest(0, least(255, CAST(floor((CAST({v} AS DOUBLE) + 0.6) * 212) AS INTEGER)))"
#: The views for the independent check, each named as the attribute above.
CTES = {
    "boxes": f"""SELECT page, ord, x, y, w, h, ord AS z, score, label, edge, source FROM (SELECT l_orderkey AS page,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ord,
        CAST(l_partkey % 900 AS INTEGER) AS x, CAST((l_suppkey * 7) % 500 AS INTEGER) AS y, CAST(20 + 4 * floor(l_quantity) AS INTEGER) AS w,
        CAST(10 + (l_partkey + l_suppkey) % 80 AS INTEGER) AS h, 1 - l_discount AS score, {_choice("l_partkey % 8", LABELS)} AS label,
        l_linestatus = 'F' AS edge, CASE WHEN l_returnflag = 'R' THEN 'sam' ELSE 'detector' END AS source FROM lineitem)""",
    "nodes": f"""SELECT page, page * 100 + ord AS node, CASE WHEN ord <= 2 THEN 'parent' WHEN ord % 4 = 0 THEN 'text' ELSE 'child' END AS kind,
        CASE WHEN ord > 2 THEN page * 100 + ord // 2 END AS parent, {_choice("(x + y) % 5", STATES)} AS state, x, y, w, h, z, ord, score FROM boxes""",
    "actions": f"""SELECT page, node, {_choice("y % 8", VERBS)} AS verb, score, ord, [node, page * 100 + 1] AS cited FROM nodes WHERE x % 3 <> 0""",
    "cells": f"""SELECT page, label, i // 8 AS y, i % 8 AS x, {_PX.format(v="v")} AS px, v > 0 AS mask FROM
        (SELECT vec_id AS page, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""",
    "pairs": """SELECT a.page, a.y, a.x, a.px AS p, b.px AS q, a.mask AS m, b.mask AS n FROM cells a
        JOIN (SELECT vec_id AS page, coalesce(lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id), vec_id) AS other FROM embeddings) o ON a.page = o.page
        JOIN cells b ON b.page = o.other AND b.y = a.y AND b.x = a.x""",
    "trace": f"""SELECT user_id AS page, event_id, ts, {_case("event_type", TRACE_KIND)} AS event, 'stage' || CAST(event_id % 5 AS VARCHAR) AS stage,
        'model' || CAST(event_id % 3 AS VARCHAR) AS model, CAST(round(value * 1000) AS BIGINT) AS duration_ms,
        CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, event_id % 11 AS operation_count FROM events""",
    "state_log": f"""SELECT user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {_case("event_type", PAGE_STATE)} AS state,
        {_case("event_type", RUN_STATE)} AS run_state, ts, value FROM events""",
    "text_items": """SELECT page, CAST(ord AS INTEGER) AS ord, text, CAST((page * 37 + ord * 11) % 700 AS INTEGER) AS x, CAST((ord * 24 + page % 7) % 900 AS INTEGER) AS y,
        CAST(least(900, 8 * length(text) + 4) AS INTEGER) AS w, CAST(16 + (page + ord) % 90 AS INTEGER) AS h, ((page * 31 + ord * 17) % 100) / 100.0 AS confidence,
        10 + CAST((page + ord) % 90 AS DOUBLE) AS font_size, '#' || lpad(lower(to_hex((page * 7919 + ord * 104729) % 16777216)), 6, '0') AS color, (page + ord) % 3 = 0 AS bold
        FROM (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)""",
    "rounds": """SELECT conv_id AS page, turn AS round, role, CAST(n % 13 AS DOUBLE) AS mae, CAST(n % 37 AS DOUBLE) AS p95, CAST(n % 5 AS DOUBLE) AS largest,
        CAST(n % 7 AS DOUBLE) AS unexplained, CAST(n % 4 AS BIGINT) AS violations, n % 3 = 0 AS accepted FROM (SELECT *, length(text) AS n FROM conversations)""",
    "decisions": """SELECT d.doc_id % 50 AS page, d.doc_id AS object, CASE WHEN quality = 1 THEN 'replace' ELSE 'preserve' END AS decision,
        CASE WHEN toxic = 1 THEN 'decorative' ELSE 'full_slide_screenshot' END AS category, 0.85 + (n_chars % 15) / 100.0 AS confidence
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "tags": """SELECT page, ord, tag FROM (SELECT page_id AS page, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag,
        generate_subscripts(regexp_extract_all(html, '<([a-z0-9]+)', 1), 1) - 1 AS ord FROM pages)""",
}


def with_views(sql: str) -> str:
    """The query text with the views it names in front, in the order of CTES."""
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name, body in CTES.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(body)
    head = [f"{n} AS ({b})" for n, b in CTES.items() if n in need]
    sql = sql.strip()
    if sql[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ", ".join(head) + (", " if head else "") + sql[15:]
    if sql[:5].upper() == "WITH ":
        return "WITH " + ", ".join(head) + (", " if head else "") + sql[5:]
    return ("WITH " + ", ".join(head) + " " if head else "") + sql
