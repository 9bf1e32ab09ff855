"""Quality rules: measures of a text, and how far its distributions lie from those of its language.

Two histograms of a text are compared with the references of its language by Jensen-Shannon distance (base 2, so from 0 to
1): its character classes, and its common words against all others. The references are the sums over all documents of the
language; a rare or null language has the characters of the whole corpus. Texts too short for a comparison pass it. Everything is built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._common import cut, read

#: The most common words of the languages that have a reference.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "lo"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
}
SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower and other letters", "upper-case letters", "digits", "white space", "punctuation", "symbols", "rest")
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Documents that give a language without a word list a reference of its own.
REFERENCE_DOCUMENTS = 100
#: A comparison needs so many words; a distance above the limit rejects.
CHARACTER_GUARD, CHARACTER_LIMIT = 40, 0.28
WORD_GUARD, WORD_LIMIT = 100, 0.30


def _left(text: Column, pattern: str) -> Column:
    """Code points of the text without what the pattern matches."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeated(words: Column) -> Column:
    """Words in windows of five that the text has twice or more, the first of them included."""
    coded = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # the array stands in a one-element array, so that it is made once
        twice = F.flatten(F.transform(F.array(ordered), lambda a: F.filter(a, lambda x, j: (F.get(a, j - 1)["h"] == x["h"]) | (F.get(a, j + 1)["h"] == x["h"]))))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        return F.aggregate(at, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")))["n"]

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(F.size(words) < 5, F.lit(0)).otherwise(
        F.transform(F.array(coded), lambda c: F.transform(F.array(windows(c)), count)[0])[0]
    )


#: Columns that several measures share: the words, the text without white space, and of that what isn't a letter.
SHARED = ("_words", "_dense", "_signs")


def _shared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumns({"_words": _words(text), "_dense": F.regexp_replace(text, SPACE, "")})
    return docs.withColumn("_signs", F.regexp_replace("_dense", r"\p{L}+", ""))


def with_measures(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to documents(text, ...). A null text has no words."""
    return _measures(_shared(docs)).drop(*SHARED)


def _measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    n, repeated = F.size("_words").cast("long"), F.col("n_repeat_words")
    return (
        docs.withColumn("_lines", lines)
        .withColumns({
            "n_words": n, "word_chars": F.length("_dense").cast("long"), "n_symbols": _symbols().cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_repeat_words": _repeated(F.col("_words")).cast("long"),
        })
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * F.col("n_words")))
        .drop("_lines")
    )


def _symbols() -> Column:
    return F.length("_signs") - F.length(F.translate("_signs", SYMBOLS, ""))


def _histograms(docs: DataFrame) -> DataFrame:
    """Add _chars (by class), _common (by common word of the language, then all other words) and _n to what _shared gives of documents(text, lang, ...)."""
    signs, dense = F.col("_signs"), F.col("_dense")
    docs = docs.withColumns({
        "_t": F.length(F.coalesce(F.col("text"), F.lit(""))), "_e": F.length(dense), "_g": F.length(signs), "_u": F.length(dense) - _left(dense, r"\p{Lu}+"),
        "_d": F.length(signs) - _left(signs, "[0-9]+"), "_p": F.length(signs) - _left(signs, r"""[.,;:!?'"()-]+"""), "_y": _symbols(),
    })
    rest = F.col("_g") - F.col("_d") - F.col("_p") - F.col("_y")
    chars = F.array(*[x.cast("double") for x in (F.col("_e") - F.col("_g") - F.col("_u"), F.col("_u"), F.col("_d"), F.col("_t") - F.col("_e"), F.col("_p"), F.col("_y"), rest)])

    def counts(listed: list[str]) -> Column:
        hits = F.filter("_words", lambda w: w.isin(listed))
        return F.transform(F.array(hits), lambda a: F.transform(F.array(*map(F.lit, listed)), lambda c: F.size(F.filter(a, lambda w: w == c)).cast("double")))[0]

    common = F.lit(None).cast("array<double>")
    for lang, listed in COMMON_WORDS.items():
        common = F.when(F.col("lang") == lang, counts(listed)).otherwise(common)
    docs = docs.withColumns({"_chars": chars, "_common": common, "_n": F.size("_words")})
    others = F.col("_n") - F.aggregate("_common", F.lit(0.0), lambda a, b: a + b)
    docs = docs.withColumn("_common", F.concat("_common", F.array(others.cast("double"))))
    return docs.drop("_t", "_e", "_g", "_u", "_d", "_p", "_y")


def references(docs: DataFrame) -> tuple[DataFrame, list[float | None]]:
    """Summed histograms over all documents: a table of lang, _ref_chars and _ref_common, with a row for each language that has a word list or
    REFERENCE_DOCUMENTS documents (_ref_common is null without a list), and the characters of the whole corpus for all others and for a null lang."""
    width = len(next(iter(COMMON_WORDS.values()))) + 1
    known = _histograms(_shared(docs.select("text", "lang")))
    array = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)])
    listed = F.col("lang").isin(list(COMMON_WORDS))
    sums = cut(known.groupBy("lang").agg(F.count("*").alias("n"), array("_chars", len(CLASSES)).alias("_ref_chars"), array("_common", width).alias("_ref_common")))
    whole = sums.agg(*[F.sum(F.col("_ref_chars")[i]) for i in range(len(CLASSES))]).first()
    own = sums.filter(listed | (F.col("lang").isNotNull() & (F.col("n") >= REFERENCE_DOCUMENTS)))
    return own.select("lang", "_ref_chars", F.when(listed, F.col("_ref_common")).alias("_ref_common")), list(whole)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two histograms of counts, from 0 to 1; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(F.array(total(a)), lambda t: F.transform(a, lambda x: x / t))[0]
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(share(p), share(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms))))


def _with_references(docs: DataFrame, refs: tuple[DataFrame, list[float | None]]) -> DataFrame:
    """Add _ref_chars and _ref_common to documents(lang, ...)."""
    table, whole = refs
    docs = docs.join(F.broadcast(table.withColumnRenamed("lang", "_ref_lang")), F.col("lang") == F.col("_ref_lang"), "left").drop("_ref_lang")
    return docs.withColumn("_ref_chars", F.coalesce("_ref_chars", F.array(*[F.lit(x).cast("double") for x in whole])))


def with_divergence(docs: DataFrame, refs: tuple[DataFrame, list[float | None]]) -> DataFrame:
    """Add char_distance and word_distance to documents(text, lang, ...); null where the text is under the guard, and word_distance where the language has no word list."""
    return _divergence(_shared(_with_references(docs, refs))).drop(*SHARED)


def _divergence(docs: DataFrame) -> DataFrame:
    return _histograms(docs).withColumns({
        "char_distance": F.when(F.col("_n") >= CHARACTER_GUARD, jensen_shannon(F.col("_chars"), F.col("_ref_chars"))),
        "word_distance": F.when(F.col("_n") >= WORD_GUARD, jensen_shannon(F.col("_common"), F.col("_ref_common"))),
    }).drop("_chars", "_common", "_n", "_ref_chars", "_ref_common")


def judge(docs: DataFrame) -> DataFrame:
    """documents(text, lang, ...) with measures, distances and kept. Reads docs twice: for the references, then for the verdicts.

    kept is false where base_failed, or where a distance is above its limit. A document whose lang is null or rare is compared with the
    characters of the whole corpus, and one without a word list by its characters alone; repeated rows are judged alike; an empty table gives an empty result."""
    judged = _divergence(_measures(_shared(_with_references(docs, references(docs))))).drop(*SHARED)
    far = (F.coalesce("char_distance", F.lit(0.0)) > CHARACTER_LIMIT) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_LIMIT)
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~far)
    # a filter on a verdict must not be pushed below the measures, where it would compute each of them several times
    made = [c for c in judged.columns if c not in docs.columns]
    return judged.select(*docs.columns, F.inline(F.array(F.struct(*made))))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = judge(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
