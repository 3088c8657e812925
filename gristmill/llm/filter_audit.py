"""Audit of filters that interact: what each would remove at each place of every order.

The orders of k filters form a trie of k! leaves. What survives a prefix depends only on which filters it holds,
so a state is a set of filters, kept once: 2^k states instead of k * k! nodes. The trie is walked depth first. A
state's survivors are persisted while the states below it are visited; each new filter is applied to them, and the
rows it really removes are counted on that edge, by part. All orders are then paths over counted edges.

Texts are read once: filters become verdicts on each row, and survivors are slim rows of verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.storage import broadcast_if_small, materialize, new_path

#: A text that so many rows share is looked up in a broadcast table: there is at most one such text in so many rows.
HOT_COPIES = 10_000
#: Names of the verdicts of ``text_filters``, in order.
FILTERS = ("A", "B", "C", "D", "E")


def text_filters(text: str) -> dict[str, Column]:
    """Failure conditions of one not-null text: A few words, B repeated words, C capitals, D signs of markup."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each row of ``docs``: whether it fails each filter, and whether a label of
    its id says so. E: its text is that of a row with a smaller id, by SHA-256. Null ids are no smaller than any,
    fail no E and have no label."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    flags = text_filters("text")
    slim = materialize(rows.select("id", "part", *(c.alias(n) for n, c in flags.items()), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "verdicts")
    shared = materialize(slim.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first")).where("copies > 1"), "shared_texts")
    # rows of a hot text never meet in one task: its first id goes to them
    hot = broadcast_if_small(shared.where(F.col("copies") > HOT_COPIES).select(F.col("digest").alias("hot"), F.col("first").alias("hot_first")), 64)
    rare = shared.where(F.col("copies") <= HOT_COPIES).select("digest", "first")
    told = slim.join(hot, F.col("digest") == F.col("hot"), "left")
    apart = F.monotonically_increasing_id().cast("string").cast("binary")  # equals no digest
    told = told.withColumn("digest", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(apart))
    told = told.join(rare, "digest", "left").withColumn("E", F.coalesce(F.col("id") > F.coalesce("hot_first", "first"), F.lit(False)))
    says = labels.groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = told.join(says, "id", "left")
    return known.select("part", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def walk(rows: DataFrame, filters: Sequence[str] = FILTERS, part: str = "part", counts: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """The counted edges (part, state, filter, reached, removed, removed_<count>...): for each set of filters already
    applied (its names sorted and joined) and each filter outside it, the rows of the part that reach it and those that
    it removes. ``rows`` has a boolean for each filter and each count; give a materialized frame. A part that no
    row of a state is left of has no edge there. Counts go to a table, not to the driver."""
    spark, seen, path = rows.sparkSession, set(), new_path(rows.sparkSession, "edges")

    def visit(state: frozenset, survivors: DataFrame) -> None:
        seen.add(state)
        open_ = [f for f in filters if f not in state]
        if not open_:
            return
        survivors = survivors.persist(StorageLevel.DISK_ONLY)
        try:
            reached = F.count("*").alias("reached")
            each = [F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("removed"), *(F.count_if(F.col(f) & F.col(c)).alias(f"removed_{c}") for c in counts)) for f in open_]
            counted = survivors.groupBy(part).agg(reached, F.array(*each).alias("edges")).withColumn("e", F.explode("edges"))
            counted.select(part, F.lit("".join(sorted(state))).alias("state"), "reached", "e.*").write.mode("append").parquet(path)
            for f in open_:
                if state | {f} not in seen:
                    visit(state | {f}, survivors.where(~F.col(f)))
        finally:
            survivors.unpersist()

    visit(frozenset(), rows)
    return spark.read.parquet(path)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part of ``docs``, each order of the filters and each step: (part, filter_order, step, filter,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), counts of rows, zeros included.

    Null parts and texts count as empty; the empty text fails A only, and E where a smaller id has it. Rows that
    repeat an id and its text fail no E for each other. Of several labels of an id one that says 1 is enough; null
    labels say nothing. An empty table of documents gives an empty result. Other columns are not read."""
    rows = materialize(verdicts(docs, labels, id_col, text_col, part_col), "audited")
    edges = materialize(walk(rows), "counted_edges")
    spark, everyone = docs.sparkSession, "".join(FILTERS)
    steps = [("".join(o), i + 1, f, "".join(sorted(o[:i])), everyone.replace(f, "")) for o in permutations(FILTERS) for i, f in enumerate(o)]
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, state string, others string"))  # 600 rows
    failed = edges.where("state = ''").select("part", "filter", F.col("removed").alias("fails"))
    alone = edges.select("part", "filter", F.col("state").alias("others"), F.col("removed").alias("alone"))
    places = failed.join(orders, "filter").join(alone, ["part", "filter", "others"], "left").join(edges, ["part", "filter", "state"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return places.select(
        "part",
        "filter_order",
        "step",
        "filter",
        (n("reached") - n("removed")).alias("kept"),
        n("removed").alias("removed"),
        (F.col("fails") - n("removed")).alias("redundant"),
        n("alone").alias("unique_fails"),
        n("removed_good").alias("good_lost"),
        n("removed_toxic").alias("toxic_lost"),
        F.sum(n("removed")).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


ORACLE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
own AS (SELECT part, len(w) < 100 AS fa, 100 * len(list_distinct(w)) < 80 * len(w) AS fb, 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS fc,
    regexp_matches(text, '[#$%&*|]') AS fd, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS fe,
    coalesce((SELECT max(quality) FROM labels l WHERE l.doc_id = worded.doc_id AND quality = 1), 0) AS good, coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = worded.doc_id AND toxic = 1), 0) AS toxic FROM worded),
masks AS (SELECT part, (CASE WHEN fa THEN 'A' ELSE '' END) || (CASE WHEN fb THEN 'B' ELSE '' END) || (CASE WHEN fc THEN 'C' ELSE '' END) || (CASE WHEN fd THEN 'D' ELSE '' END) || (CASE WHEN fe THEN 'E' ELSE '' END) AS m,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM own GROUP BY 1, 2),
perms AS (SELECT '' AS o UNION ALL SELECT o || f FROM perms, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE position(f IN o) = 0),
steps AS (SELECT o AS filter_order, i::INTEGER AS step, o[i] AS filter, o[1:i - 1] AS before FROM perms, range(1, 6) r(i) WHERE length(o) = 5),
counts AS (SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (translate(m, before || filter, '') = m), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (position(filter IN m) > 0 AND translate(m, before, '') = m), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (position(filter IN m) > 0 AND translate(m, before, '') <> m), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (m = filter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (position(filter IN m) > 0 AND translate(m, before, '') = m), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (position(filter IN m) > 0 AND translate(m, before, '') = m), 0)::BIGINT AS toxic_lost FROM masks, steps GROUP BY 1, 2, 3, 4)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counts
"""
