"""Language identification: character trigrams counted by language, and texts scored by their log-likelihood.

Profiles come from labelled texts by one aggregation, which adds up inside each task first. A text's trigrams meet the profiles in a join
(the profiles are broadcast up to MOST_GRAMS rows, and shuffled beyond), and their sums are made in the task that has the text, so
that no text moves. Logarithms are kept as whole millionths, so sums do not depend on their order.

Defined results: texts without letters, null ones too, are und; a language without letters in its texts has no profile; of equally
likely languages the first by name; rows that repeat a key count as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Rows of profiles that may be broadcast, and languages at most: each is a column.
MOST_GRAMS, MOST_LANGUAGES = 1_000_000, 200
#: Letters that a text needs for its trigrams to decide; a script's share of the letters that decides alone, and what it needs to have at least.
LEAST_LETTERS, SCRIPT_SHARE, SCRIPT_LEAST, LATIN_SHARE = 40, 0.2, 0.05, 0.5
_UNIT = 1_000_000

#: Names of variants of one language.
_VARIANTS = {"zh-cn", "zh_cn", "zh-hans", "zh_hans", "zh-tw", "zh_tw", "zh-hant", "zh_hant"}
#: Letters of the scripts that decide, by language.
SCRIPTS = {"zh": "[一-鿿㐀-䶿぀-ヿ]", "ar": "[؀-ۿ]", "ru": "[Ѐ-ӿ]"}


def normal_code(code: Column) -> Column:
    """A language code in lower case, null if blank; Chinese without its variants."""
    own = F.lower(F.trim(code))
    return F.nullif(F.when(own.isin(*_VARIANTS), "zh").otherwise(own), F.lit(""))


def grams(column: Column) -> Column:
    """The trigrams of a text's letters in lower case, a space between words and at both ends. Letters beyond the 16-bit plane count as marks."""
    letters = F.regexp_replace(text.clean_for_language(F.coalesce(column, F.lit(""))), r"[\x{10000}-\x{10FFFF}]+", " ")
    padded = F.concat(F.lit(" "), F.lower(letters), F.lit(" "))
    return F.regexp_extract_all(padded, F.lit(r"(?=([^\n]{3}))"), F.lit(1))


def counted(docs: DataFrame, lang: str = "lang", column: str = "text") -> DataFrame:
    """(gram, lang, n) of labelled texts."""
    return docs.select(normal_code(F.col(lang)).alias("lang"), F.explode(grams(F.col(column))).alias("gram")).where("lang IS NOT NULL").groupBy("gram", "lang").agg(F.count("*").alias("n"))


class Profiles:
    """For each trigram the logarithm (in millionths) of its probability in each language, add-one smoothed over all different trigrams."""

    def __init__(self, counts: DataFrame):
        """counts, of counted(), is read several times: a written table, at best."""
        totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
        if len(totals) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        self.different = counts.select("gram").distinct().count()
        self.totals = {r.lang: r.n for r in totals}
        self.columns = {lang: f"lang_{k}" for k, lang in enumerate(self.totals)}
        own = [self._log(F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)), lang).alias(c) for lang, c in self.columns.items()]
        self.table = counts.groupBy("gram").agg(*own) if own else None

    def _log(self, n: Column, lang: str) -> Column:
        return F.round(F.ln((n + 1) / F.lit(self.totals[lang] + self.different).cast("double")) * _UNIT).cast("long")

    def likelihoods(self, docs: DataFrame, key: str, column: str = "text") -> DataFrame:
        """(key, grams, best, first, second) of each text: its likeliest language, and the sums of the two likeliest, in millionths."""
        rows = docs.select(F.col(key), F.explode_outer(grams(F.col(column))).alias("gram"))
        if self.table is None:
            return rows.groupBy(key).agg(F.count("gram").alias("grams")).select("*", F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("second"))
        told = F.broadcast(self.table) if self.different <= MOST_GRAMS else self.table.hint("merge")
        unseen = {lang: self._log(F.lit(0), lang) for lang in self.columns}
        sums = [F.sum(F.when(F.col("gram").isNotNull(), F.coalesce(F.col(c), unseen[lang]))).alias(c) for lang, c in self.columns.items()]
        rows = rows.join(told, "gram", "left").groupBy(key).agg(F.count("gram").alias("grams"), *sums)
        # The least of (-sum, name) is the likeliest, and of equal ones the first by name.
        order = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("cost"), F.lit(lang).alias("lang")) for lang, c in self.columns.items()]))
        rows = rows.select(key, "grams", F.when(F.col("grams") > 0, order).alias("order"))
        return rows.select(key, "grams", F.col("order")[0]["lang"].alias("best"), (-F.col("order")[0]["cost"]).alias("first"), (-F.get("order", F.lit(1))["cost"]).alias("second"))


def decided(column: Column, best: Column, hint: Column | None = None) -> Column:
    """The language of a text: its hint, else its script, else for short texts en if Latin and else und, else the likeliest that its script allows."""
    t = F.coalesce(column, F.lit(""))
    counts = {lang: F.regexp_count(t, F.lit(pattern)) for lang, pattern in SCRIPTS.items()}
    counts |= {"letters": F.regexp_count(t, F.lit(r"\p{L}")), "latin": F.regexp_count(t, F.lit("[A-Za-z]")), "clean": F.length(text.clean_for_language(t))}

    def choice(s: Column) -> Column:
        share = lambda name: s[name] / F.greatest(s["letters"], F.lit(1))
        fallback = F.when(share("latin") >= LATIN_SHARE, "en").otherwise("und")
        by_script = F.coalesce(*[F.when(share(lang) >= SCRIPT_SHARE, lang) for lang in SCRIPTS])
        foreign = [(s["best"] == lang) & (share(lang) < SCRIPT_LEAST) for lang in SCRIPTS]
        likeliest = F.when(foreign[0] | foreign[1] | foreign[2], "en").otherwise(F.coalesce(s["best"], fallback))
        return F.coalesce(by_script, F.when(s["clean"] < LEAST_LETTERS, fallback).otherwise(likeliest))

    out = text.let(choice, best=best, **counts)
    return out if hint is None else F.coalesce(normal_code(hint), out)


def identified(docs: DataFrame, profiles: Profiles, key: str, column: str = "text", hint: Column | None = None) -> DataFrame:
    """docs with inferred, and margin: how much likelier, in nats a trigram, its best language is than the second; null where there is no other."""
    told = profiles.likelihoods(docs, key, column)
    margin = F.round((F.col("first") - F.col("second")) / F.col("grams") / _UNIT, 6)
    told = told.select(F.col(key).alias("__key"), F.col("best").alias("__best"), margin.alias("margin"))
    rows = docs.join(told, docs[key].eqNullSafe(F.col("__key")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], decided(F.col(column), F.col("__best"), hint).alias("inferred"), "margin")
