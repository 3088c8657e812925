"""Merkle fingerprints of documents, by DataFrame functions only.

A text's lines are its paragraphs. A paragraph is cut into leaves of at most 64 code points; a leaf is the
SHA-256 of its text, a paragraph that of its leaves, and a section that of its paragraphs: it ends after a
paragraph whose digest ends in 0, so an inserted paragraph moves no other boundary. The root is that of the
sections. The fingerprint writes the tree down with shortened digests:

    root # section:paragraphs ... # paragraph:leaves ... # leaf ...

Equal roots mean equal texts. Where roots differ, sections and then paragraphs that the other tree lacks
locate the edit (``changed_paragraphs``); the share of common leaves is the likeness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a leaf.
LEAF = 64
#: Hex digits that the fingerprint keeps of sections and paragraphs, and of leaves.
NODE_DIGITS, LEAF_DIGITS = 16, 8
#: Least and most rows of a bucket of neighbours, about: the square root of all rows in between.
BUCKET_ROWS, MOST_BUCKET_ROWS = 1024, 16_384


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def with_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` (not null) as ``to``. Works in a few projections, so
    that no list is worked out more than once."""
    leaves, pars, ends, secs = (f"__{x}_{to}" for x in ("leaves", "pars", "ends", "secs"))
    df = df.withColumn(leaves, F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LEAF}}}"), 0), _sha)))
    df = df.withColumn(pars, F.transform(leaves, lambda p: _sha(F.concat(F.size(p).cast("string"), F.lit(":"), F.array_join(p, "")))))
    df = df.withColumn(ends, F.filter(F.sequence(F.lit(1), F.size(pars)), lambda i: (i == F.size(pars)) | F.get(F.col(pars), i - 1).endswith("0")))
    start = lambda i: F.coalesce(F.get(F.col(ends), i - 1), F.lit(0)) + 1
    df = df.withColumn(secs, F.transform(ends, lambda e, i: F.concat(_sha(F.array_join(F.slice(F.col(pars), start(i), e - start(i) + 1), "")), F.lit(":"), (e - start(i) + 1).cast("string"))))
    short = lambda x, n: F.substring(x, 1, n)
    fingerprint = F.concat_ws(
        "#",
        _sha(F.array_join(secs, " ")),
        F.array_join(F.transform(secs, lambda s: F.concat(short(s, NODE_DIGITS), F.lit(":"), F.substring_index(s, ":", -1))), " "),
        F.array_join(F.zip_with(pars, leaves, lambda p, x: F.concat(short(p, NODE_DIGITS), F.lit(":"), F.size(x).cast("string"))), " "),
        F.array_join(F.transform(F.flatten(leaves), lambda x: short(x, LEAF_DIGITS)), " "),
    )
    return df.withColumn(to, fingerprint).drop(leaves, pars, ends, secs)


def likeness(a: str | Column, b: str | Column) -> Column:
    """0 to 1: twice the common distinct leaves over the leaves of both; 1 for two empty texts."""
    part = lambda c: F.array_distinct(F.split(F.substring_index(c, "#", -1), " "))
    x, y = part(a), part(b)
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def changed_paragraphs(a: str, b: str) -> Column:
    """Places (from 0) of the paragraphs of fingerprint ``a`` that ``b`` doesn't have; none if roots are equal."""
    parts = lambda c: F.split(F.split(c, "#")[2], " ")
    places = F.filter(F.transform(parts(a), lambda p, i: F.when(~F.array_contains(parts(b), p), i)), lambda i: i.isNotNull())
    return F.when(F.substring_index(a, "#", 1) == F.substring_index(b, "#", 1), F.array().cast("array<int>")).otherwise(places)


def _neighbour_buckets(docs: DataFrame) -> tuple[Column, Column, int]:
    """Bucket of a row by its id, whether the row is the first of its bucket, and the last bucket. Bounds
    are ids of the table at even shares of its rows, found by a sketch that is exact to a tenth of a bucket."""
    rows = docs.count()
    wanted = max(1, -(-rows // min(max(BUCKET_ROWS, math.isqrt(rows)), MOST_BUCKET_ROWS)))
    shares = [i / wanted for i in range(1, wanted)]
    found = docs.agg(F.percentile_approx("id", shares, max(10_000, 10 * wanted))).first()[0] if shares else []
    bounds = sorted(set(found or []))
    steps = 1 << max(0, len(bounds).bit_length() - 1)
    padded = bounds + [2**63 - 1] * (2 * steps - len(bounds))
    table = F.from_json(F.lit(str(padded)), "array<bigint>")
    powers = [1 << i for i in reversed(range(steps.bit_length()))]
    # a binary search: take a step where the bound at its end is no greater
    bucket = F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= F.col("id"), at + step).otherwise(at)) if bounds else F.lit(0)
    return bucket, (F.col("bucket") > 0) & (F.get(table, F.col("bucket") - 1) == F.col("id")), len(bounds)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (id, text, fingerprint, ...) with next_text and next_fingerprint of the row with the next id;
    after the last comes the first. Rows go to buckets of neighbouring ids; the first row of a bucket goes
    to the one before as well, so one shuffle finds all neighbours and no task gets the whole table."""
    ids = docs.select("id")
    bucket, is_first, last = _neighbour_buckets(ids)
    lowest = ids.agg(F.min("id").alias("low"), F.max(F.col("id").isNull()).alias("nulls")).first()
    very_first = F.col("id").isNull() if lowest["nulls"] else F.col("id") == F.lit(lowest["low"])
    seats = F.array_compact(
        F.array(
            F.struct(F.col("bucket"), F.lit(0).alias("copy")),
            F.when(is_first, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("copy"))),
            F.when(very_first, F.struct(F.lit(last).alias("bucket"), F.lit(2).alias("copy"))),
        )
    )
    names = docs.columns
    dealt = docs.withColumn("bucket", bucket).withColumn("seat", F.explode(seats)).select(*names, "seat.bucket", "seat.copy")
    w = Window.partitionBy("bucket").orderBy("copy", F.col("id").asc_nulls_first(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fingerprint", F.lead("fingerprint").over(w)).where("copy = 0").drop("bucket", "copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next row's text by ascending id; after the last comes the first. Null texts are empty. Rows with
    null ids come first, equal ids follow each other by their texts. A single row is its own next. An
    empty table gives an empty result. Other columns of ``docs`` are not read."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = with_next(with_fingerprint(own, "text", "fingerprint"))
    half = F.floor(F.length("text") / 2).cast("int")
    own = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    own = with_fingerprint(own, "edited", "edited_fingerprint")
    return own.select(
        F.col("id").alias(id_col),
        F.length("text").cast("long").alias("n_chars"),
        _sha(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def _sql_fingerprint(src: str, text: str, to: str, keep: str) -> str:
    return f"""
{to}1 AS (SELECT {keep}, list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,{LEAF}}}'), lambda x: sha256(x))) AS lv FROM {src}),
{to}2 AS (SELECT *, list_transform(lv, lambda p: sha256(concat(len(p), ':', array_to_string(p, '')))) AS ps FROM {to}1),
{to}3 AS (SELECT *, list_filter(range(1, len(ps) + 1), lambda i: i = len(ps) OR ps[i] LIKE '%0') AS es FROM {to}2),
{to}4 AS (SELECT *, list_transform(es, lambda e, i: concat(sha256(array_to_string(ps[CASE WHEN i = 1 THEN 1 ELSE es[i - 1] + 1 END:e], '')), ':', e - CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END)) AS ss FROM {to}3),
{to} AS (SELECT {keep}, concat(sha256(array_to_string(ss, ' ')), '#',
  array_to_string(list_transform(ss, lambda s: concat(s[1:{NODE_DIGITS}], ':', split_part(s, ':', 2))), ' '), '#',
  array_to_string(list_transform(ps, lambda p, i: concat(p[1:{NODE_DIGITS}], ':', len(lv[i]))), ' '), '#',
  array_to_string(list_transform(flatten(lv), lambda x: x[1:{LEAF_DIGITS}]), ' ')) AS {to} FROM {to}4)"""


def _sql_near(a: str, b: str) -> str:
    part = lambda c: f"list_distinct(string_split(split_part({c}, '#', 4), ' '))"
    return f"2.0::DOUBLE * len(list_intersect({part(a)}, {part(b)})) / (len({part(a)}) + len({part(b)}))"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_sql_fingerprint("d", "text", "fingerprint", "doc_id, text")},
n AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nt, coalesce(lead(fingerprint) OVER o, first_value(fingerprint) OVER o) AS nf
  FROM fingerprint WINDOW o AS (ORDER BY doc_id, text)),
e AS (SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(nt, 1, length(text) // 2) AS edited FROM n),
{_sql_fingerprint("e", "edited", "edited_fingerprint", "doc_id, text, edited, fingerprint, nf")}
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  {_sql_near("fingerprint", "edited_fingerprint")} AS near_edited, {_sql_near("fingerprint", "nf")} AS near_next
FROM edited_fingerprint
"""
