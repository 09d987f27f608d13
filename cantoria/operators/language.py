"""P6 trained: language by character-trigram profiles learnt from a table of labelled texts.

A profile is the log-probability of each of a language's ``TOP`` commonest trigrams of letters (word edges count as a
blank); other trigrams get the language's floor. Counting combines map-side, and a text's trigrams are added up where
the text is read. Only built-in functions are used.

Defined results: null texts and texts without a letter are unknown, and so are texts whose mean log-probability lies
below what the training texts of that language reach (``UNKNOWN`` quantile, less ``SLACK``); equal sums go to the first
language in code-point order; training rows without a language teach nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantoria.session import cut_lineage

TOP = 3000
UNKNOWN = 0.001
SLACK = 0.5


def trigrams(text: Column) -> Column:
    """Overlapping trigrams of the lower-case letters of a text, runs of other characters being one blank."""
    letters = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))
    return F.when(F.length(letters) > 2, F.regexp_extract_all(letters, F.lit("(?=(...))"), 1)).otherwise(F.array().cast("array<string>"))


def _sums(rows: DataFrame, model: DataFrame, languages: list[str], keys: list[str], text: str) -> DataFrame:
    """keys, n (trigrams), s0.. (log-probability of the text in each language)."""
    floor = model.where("gram is null").first()                    # one row
    grams = rows.select(*keys, F.explode_outer(trigrams(F.col(text))).alias("gram"))
    known = F.broadcast(model.where("gram is not null"))           # at most languages x top rows: no trigram is shuffled
    both = grams.join(known, "gram", "left")
    return both.groupBy(*keys).agg(F.count("gram").alias("n"), *[
        F.sum(F.when(F.col("gram").isNotNull(), F.coalesce(F.col(f"p{i}"), F.lit(float(floor[f"p{i}"]))))).alias(f"s{i}") for i in range(len(languages))])


def learn(rows: DataFrame, key: str, text: str, lang: str, top: int = TOP) -> tuple[DataFrame, dict[str, float]]:
    """(profiles, least mean log-probability of each language): profiles has one row a trigram, p0.. in the order of the
    languages, and one row of null trigram with the floors; at most languages x top + 1 rows."""
    labelled = rows.where(F.col(lang).isNotNull())
    counts = labelled.select(F.col(lang).alias("l"), F.explode(trigrams(F.col(text))).alias("gram")).groupBy("l", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    whole = counts.groupBy("l").agg(F.sum("n").alias("whole"))      # one row a language
    languages = sorted(r.l for r in whole.collect())
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    chance = best.join(whole, "l").select("l", "gram", F.log((F.col("n") + 0.5) / F.col("whole")).alias("p"))
    floors = whole.select("l", F.lit(None).cast("string").alias("gram"), F.log(0.5 / F.col("whole")).alias("p"))
    columns = [F.max(F.when(F.col("l") == v, F.col("p"))).alias(f"p{i}") for i, v in enumerate(languages)]
    model = cut_lineage(chance.unionByName(floors).groupBy("gram").agg(*columns))
    own = labelled.select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.col(text).alias("_t")).where(F.length("_t") > 0)
    sums = _sums(own, model, languages, ["_k", "_l"], "_t").where("n > 0")
    mean = F.coalesce(*[F.when(F.col("_l") == v, F.col(f"s{i}") / F.col("n")) for i, v in enumerate(languages)]) if languages else F.lit(0.0)
    least = sums.groupBy("_l").agg(F.percentile_approx(mean, UNKNOWN, 10000).alias("m")).collect()
    return model, {v: next((r.m for r in least if r["_l"] == v), 0.0) - SLACK for v in languages}


def detect(rows: DataFrame, model: DataFrame, least: dict[str, float], key: str, text: str, unknown: str = "desconocido") -> DataFrame:
    """key, n (trigrams), idioma, media (mean log-probability in it). The key must be unique."""
    languages = sorted(least)
    sums = _sums(rows.select(F.col(key).alias("_k"), F.col(text).alias("_t")), model, languages, ["_k"], "_t")
    each = F.array(*[F.struct((F.col(f"s{i}") / F.col("n")).alias("m"), F.lit(-i).alias("i"), F.lit(v).alias("l"), F.lit(float(least[v])).alias("low"))
                     for i, v in enumerate(languages)])
    best = sums.withColumn("_b", F.when(F.col("n") > 0, F.array_max(each)))
    return best.select(F.col("_k").alias(key), "n", F.when(F.col("_b.m") >= F.col("_b.low"), F.col("_b.l")).otherwise(F.lit(unknown)).alias("idioma"),
                       F.col("_b.m").alias("media"))
