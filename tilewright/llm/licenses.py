"""Licence scan: normalised lines and whole texts against licence templates, by Dice coefficient over word bigrams.

Dice reaches d only if the smaller bigram set has at least d / (2 - d) times the
size of the larger; every template is therefore listed under the sizes it can
match, and a unit of text meets only the templates listed under its own size.

Units are the whole text (unit 0) and its lines (from 1).  Normalised: ASCII
letters lower-case, all but ASCII letters and digits as one blank.  Defined
results: null, empty and one-word units match nothing; of several templates the
highest coefficient wins, then the smallest name; repeated rows are reported once.
An empty table gives an empty one; a very long text is split into its words once, in one row; columns other than doc_id
and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.license_texts import TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DICE = 0.8


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def with_bigrams(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Kept columns, ``grams`` (hashes of the distinct word bigrams of a text) and ``n_grams``."""
    hashed = df.select(*keep, F.transform(F.split(normalised(F.col(text)), " "), lambda w: F.xxhash64(w)).alias("hashes"))
    pairs = F.zip_with(F.slice("hashes", 1, F.size("hashes") - 1), F.slice("hashes", 2, F.size("hashes")), lambda a, b: F.xxhash64(a, b))
    return hashed.select(*keep, F.array_distinct(pairs).alias("grams")).withColumn("n_grams", F.size("grams"))


def template_index(spark, templates: Sequence[tuple[str, str]], dice: float) -> DataFrame:
    """license, template (its bigrams), once for each bigram count ``n_grams`` that can reach the coefficient."""
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates])))
    made = with_bigrams(listed, "text", "license").where(F.col("n_grams") > 0)
    low, high = F.ceil(F.col("n_grams") * F.lit(dice / (2 - dice)) - 1e-9), F.floor(F.col("n_grams") * F.lit((2 - dice) / dice) + 1e-9)
    return made.select("license", F.col("grams").alias("template"), F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("n_grams"))


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """doc_id, text_hash, unit, license, dice of every unit that matches a template.

    The index is made from a parameter, a few hundred rows for the built-in texts; Spark chooses how to join it.
    """
    text = F.coalesce("text", F.lit(""))
    units = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.concat(F.array(text), F.split(text, "\n"))).alias("unit", "part"))
    sized = with_bigrams(units, "part", "doc_id", "text_hash", "unit")
    met = sized.join(template_index(docs.sparkSession, templates, dice), "n_grams")
    share = 2 * F.size(F.array_intersect("grams", "template")) / (F.size("grams") + F.size("template"))
    near = met.select("doc_id", "text_hash", "unit", "license", share.alias("dice")).where(F.col("dice") >= dice)
    best = near.groupBy("doc_id", "text_hash", "unit", "license").agg(F.max("dice").alias("dice"))
    first = F.min(F.struct((-F.col("dice")).alias("far"), "license"))
    return best.groupBy("doc_id", "text_hash", "unit").agg(first.alias("b")).select(
        "doc_id", "text_hash", "unit", F.col("b.license").alias("license"), (-F.col("b.far")).alias("dice"))


def _python_bigrams(text: str) -> list[str]:
    words = "".join(c if c in LOWER or c in "0123456789" else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def license_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> str:
    """The same rows in SQL, without the text hash: only for tables without repeated rows."""
    quoted = ", ".join(f"({i}, '{name}', '{' '.join(g.replace(' ', '_') for g in _python_bigrams(text))}')" for i, (name, text) in enumerate(templates))
    return f"""
WITH templates AS (SELECT name, string_split(grams, ' ') AS grams FROM (VALUES {quoted}) AS t(number, name, grams)),
units AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS unit, unnest(parts) AS part
  FROM (SELECT doc_id, list_concat([coalesce(text, '')], string_split(coalesce(text, ''), chr(10))) AS parts FROM documents)),
words AS (SELECT doc_id, unit, string_split(trim(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
sets AS (SELECT doc_id, unit, list_distinct([w[i] || '_' || w[i + 1] for i in range(1, len(w))]) AS grams FROM words),
scored AS (
  SELECT doc_id, unit, name, 2.0::DOUBLE * len(list_intersect(s.grams, t.grams)) / (len(s.grams) + len(t.grams)) AS dice
  FROM sets s JOIN templates t ON len(s.grams) > 0 AND len(s.grams) * (2 - {dice}) + 1e-9 >= len(t.grams) * {dice} AND len(t.grams) * (2 - {dice}) + 1e-9 >= len(s.grams) * {dice})
SELECT doc_id, unit, name AS license, dice FROM scored WHERE dice >= {dice}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, name) = 1
"""
