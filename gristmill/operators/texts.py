"""Text analytics of headlines and nested documents, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.expr import r6

#: The lexicon's weights by word, and the words that give a category, first match first.
LEXICON = {
    "beat": 2, "beats": 2, "surge": 2, "surges": 2, "jump": 2, "jumps": 2, "rally": 2, "rallies": 2, "gain": 1, "gains": 1, "rise": 1, "rises": 1, "upgrade": 2, "upgrades": 2, "outperform": 2, "profit": 1, "record": 1, "expansion": 1,
    "growth": 1, "wins": 1, "win": 1, "approval": 1, "bullish": 2, "strong": 1, "boost": 1, "dividend": 1, "buyback": 2, "miss": -2, "misses": -2, "fall": -1, "falls": -1, "plunge": -2, "plunges": -2, "slump": -2, "drop": -1, "drops": -1,
    "downgrade": -2, "downgrades": -2, "underperform": -2, "loss": -2, "losses": -2, "probe": -2, "fraud": -3, "penalty": -2, "fine": -1, "weak": -1, "bearish": -2, "cut": -1, "cuts": -1, "lawsuit": -2, "resign": -1, "resigns": -1, "default": -3, "selloff": -2,
}
CATEGORIES = {
    "EARNINGS": ("earnings", "results", "profit", "revenue", "quarter", "q1", "q2", "q3", "q4"),
    "RATING": ("upgrade", "downgrade", "target price", "rating", "analyst"),
    "REGULATORY": ("sebi", "rbi", "probe", "penalty", "regulator", "court", "lawsuit", "tax"),
    "CORPORATE_ACTION": ("dividend", "buyback", "split", "bonus", "merger", "acquisition", "stake"),
    "MACRO": ("inflation", "rate", "gdp", "crude", "rupee", "fed", "budget", "tariff"),
}


def lexicon_sentiment(df: DataFrame, text: str) -> DataFrame:
    """Columns sentiment (-1 to 1), label, strength, terms and category of a text."""
    lexicon = F.create_map(*(F.lit(x) for pair in LEXICON.items() for x in pair))
    tokens = F.transform(F.split(F.trim(F.col(text)), r"\s+"), lambda t: F.lower(F.regexp_replace(t, r"""^[.,:;!?()\[\]"']+|[.,:;!?()\[\]"']+$""", "")))
    hits = F.filter(tokens, lambda t: F.try_element_at(lexicon, t).isNotNull())
    df = df.withColumn("hits", hits)
    raw = F.aggregate("hits", F.lit(0), lambda a, t: a + F.try_element_at(lexicon, t))
    df = df.withColumn("raw", raw)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("raw") / 4))
    low = F.lower(F.col(text))
    category = F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)), name) for name, words in CATEGORIES.items()), F.lit("GENERAL"))
    return df.withColumns(
        {"sentiment": r6(score, 3), "label": F.when(score > 0.15, "POSITIVE").when(score < -0.15, "NEGATIVE").otherwise("NEUTRAL"), "strength": r6(F.least(F.lit(1.0), F.abs(score) + 0.1 * F.size("hits")), 3), "terms": F.array_join("hits", ","), "category": category}
    ).drop("hits", "raw")


def flatten_paths(df: DataFrame, most: int = 50) -> DataFrame:
    """(row key, path, value) of all leaves of nested columns: ``a.b[0].c``. The walk goes over the schema; arrays
    are exploded up to ``most`` entries each. ``df`` needs a column ``key``."""

    def leaves(frame: DataFrame, column: Column, path: Column, kind: T.DataType) -> list[DataFrame]:
        if isinstance(kind, T.StructType):
            out = []
            for f in kind:
                out += leaves(frame, column[f.name], F.concat(path, F.lit("." + f.name)), f.dataType)
            return out
        if isinstance(kind, T.ArrayType):
            rows = frame.select("key", path.alias("p"), F.posexplode(F.slice(column, 1, most)).alias("i", "x"))
            return leaves(rows, F.col("x"), F.concat("p", F.lit("["), F.col("i").cast("string"), F.lit("]")), kind.elementType)
        return [frame.select("key", path.alias("path"), column.cast("string").alias("value"))]

    parts = [x for f in df.schema if f.name != "key" for x in leaves(df, F.col(f.name), F.lit(f.name), f.dataType)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def search(frames: dict[str, tuple[DataFrame, str, list[str]]], needle: str) -> DataFrame:
    """(kind, id, text) of the rows of several frames whose columns hold a text, whatever the case."""
    out = None
    for kind, (df, key, columns) in frames.items():
        text = F.concat_ws(" ", *columns)
        part = df.where(F.lower(text).contains(needle.lower())).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), text.alias("text"))
        out = part if out is None else out.union(part)
    return out


def mentions(docs: DataFrame, names: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """(doc key, name) of documents that name something: words meet words in a join, instead of each text being
    searched for each name. Names are single words here."""
    words = docs.select("key", F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))).alias("w"))
    return words.join(names.select(F.lower(F.col(name)).alias("w"), name), "w").select("key", name)
