"""Operator 4: quality rules with distribution divergence.

Base rules count words, symbols, repeated lines and repeated three-word
windows. The method then compares two histograms of a document with
language references by Jensen-Shannon distance (base 2, 0 to 1):

* character classes (``CLASSES``),
* common words (``COMMON_WORDS`` and one bin for all other words).

References are summed over all documents of a ``lang``, with one added to
each count: of both histograms for the keys of the word lists, of character
classes for every other lang with at least ``MIN_DOCUMENTS`` documents and
``MIN_SHARE`` of all (a thousand langs at the most). A document's distance is
the smallest over the references of the word lists' languages and that of
its own lang. It is rejected where a distance is above the limit that holds
at its length (``WORD_LIMITS``, ``CLASS_LIMITS``); shorter texts have too few
counts to judge. Common words judge only documents of those languages and of
a null lang, character classes judge all.

Everything is a column expression. The histograms that leave a task are
one row per language and bin, so no key can become hot.

Defined cases: null or empty text: no words, ``base_failed``; null lang:
judged by the word lists' languages; a lang that has no reference is judged
by its character classes against those; no references at all (empty table,
no lang with one): base rules alone; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import NOT_SPACE, cut, let, text_or_empty, words

MIN_WORDS = 50
#: (at least so many words, largest distance), longest first.
WORD_LIMITS = ((300, 0.22), (50, 0.37))
#: (at least so many characters, largest distance).
CLASS_LIMITS = ((200, 0.32),)
#: Of the documents of a lang without a word list that gets a reference.
MIN_DOCUMENTS, MIN_SHARE = 50, 0.001

# Frequent function words by language.
COMMON_WORDS = {
    "de": "der die das und den von zu in mit sich des auf für ist im nicht dem ein eine als auch es",
    "en": "the of and to a in is that it for was on with as be by this are at from or an he",
    "es": "de la que el en y los se las del un por con no su una para es al lo como",
    "fr": "de la le et les des en un du une que pour est par dans qui avec pas sur au plus ne",
}
WORD_LIST = sorted(set(" ".join(COMMON_WORDS.values()).split()))
#: Character classes in the order they are taken out of the text; the rest
#: is a class of its own.
CLASSES = (
    ("lower", "[a-z]+"), ("space", r"[\x20\x09-\x0D]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"),
    ("symbol", "[#*$%&|<>]+"), ("mark", "[.,;:!?]+"), ("letter", r"[^\x00-\x7F]+"),
)
CLASS_NAMES = [n for n, _ in CLASSES] + ["rest"]


def char_classes(text: Column) -> list[Column]:
    """Numbers of characters by class, named c_<class>."""
    out, left = [], text
    for name, pattern in CLASSES:
        less = F.regexp_replace(left, pattern, "")
        out.append((F.length(left) - F.length(less)).cast("long").alias(f"c_{name}"))
        left = less
    return out + [F.length(left).cast("long").alias("c_rest")]


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text:
    windows are sorted with their place, equal neighbours mark places."""
    def marked(s):
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a.x == b.x, F.lit(False)))
        at = let(same, lambda e: F.zip_with(
            s, F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda p, q: F.coalesce(p, F.lit(False)) | F.coalesce(q, F.lit(False))),
            lambda a, m: F.when(m, a.i)))
        return F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(at, lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2)))))

    def counted(ws):
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(ws, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), marked))

    def windows(x):
        return F.transform(F.sequence(F.lit(1), F.size(x) - 2), lambda i: F.concat_ws(
            " ", F.element_at(x, i), F.element_at(x, i + 1), F.element_at(x, i + 2)))

    return let(w, lambda x: F.when(F.size(x) < 3, F.lit(0)).otherwise(let(windows(x), counted))).cast("long")


def common_counts(text: Column) -> Column:
    """array<struct<word, n>> of the common words of a text, then one with
    a null word for all others; absent bins are left out."""
    def runs(s):
        return let(F.array_distinct(s), lambda d: let(
            F.transform(d, lambda x: F.array_position(s, x).cast("long")), lambda at: F.zip_with(
                d, F.zip_with(at, F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s).cast("long") + 1)), lambda a, b: b - a),
                lambda x, n: F.struct(x.alias("word"), n.alias("n")))))

    def both(all_words):
        common = F.sort_array(F.filter(all_words, lambda x: x.isin(WORD_LIST)))
        return let(common, lambda s: F.concat(
            F.when(F.size(s) == 0, F.array().cast("array<struct<word:string,n:bigint>>")).otherwise(runs(s)),
            F.filter(F.array(F.struct(F.lit(None).cast("string").alias("word"), (F.size(all_words) - F.size(s)).cast("long").alias("n"))),
                     lambda x: x.n > 0)))

    return let(F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D.,]+"), ""), both)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base numbers and both histograms."""
    text = F.col("text")
    df = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_or_empty("text").alias("text"))
    df = df.select("doc_id", "lang", words(text).alias("w"), F.length(text).alias("n_chars"), *char_classes(text),
                   F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                   repeated_lines(text).alias("n_dup_lines"), common_counts(text).alias("hist"))
    return df.select("doc_id", "lang", "n_chars", *[f"c_{n}" for n in CLASS_NAMES], "n_symbols", "n_dup_lines", "hist",
                     F.size("w").cast("long").alias("n_words"),
                     (F.col("n_chars") - F.col("c_space")).cast("long").alias("word_chars"),
                     repeat_words(F.col("w")).alias("n_repeat_words"))


def references(docs: DataFrame) -> dict[str, dict[str, list[float]]]:
    """{lang: {"words": shares by WORD_LIST and rest, "classes": shares}}
    over all documents; "words" only for the languages of the word lists.
    At most one row per bin of a lang with a reference reaches the driver."""
    langs, text = sorted(COMMON_WORDS), F.col("text")
    df = docs.select(F.col("lang").cast("string").alias("lang"), text_or_empty("text").alias("text"))
    df = df.select("lang", F.when(F.col("lang").isin(langs), common_counts(text)).alias("hist"), *char_classes(text))
    bins = F.concat(
        F.coalesce(F.transform("hist", lambda x: F.struct(F.lit("w").alias("kind"), x.word.alias("bin"), x.n.alias("n"))),
                   F.array().cast("array<struct<kind:string,bin:string,n:bigint>>")),
        F.array(F.struct(F.lit("d").alias("kind"), F.lit("").alias("bin"), F.lit(1).cast("long").alias("n")),
                *[F.struct(F.lit("c").alias("kind"), F.lit(n).alias("bin"), F.col(f"c_{n}").alias("n")) for n in CLASS_NAMES]))
    sums = cut(df.select("lang", F.inline(bins)).groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")))
    documents = sums.where("kind = 'd'")
    total = documents.agg(F.sum("n")).first()[0] or 0
    enough = F.col("lang").isin(langs) | ((F.col("n") >= MIN_DOCUMENTS) & (F.col("n") >= MIN_SHARE * total))
    rows = sums.join(documents.where(F.col("lang").isNotNull() & enough).select("lang"), "lang").collect()
    out = {}
    for lang in sorted({r.lang for r in rows}):
        got = {(r.kind, r.bin): r.n for r in rows if r.lang == lang}
        out[lang] = {}
        for name, kind, bins_ in (("words", "w", [*WORD_LIST, None]), ("classes", "c", CLASS_NAMES)):
            if name == "classes" or lang in COMMON_WORDS:
                n = [got.get((kind, b), 0) + 1 for b in bins_]
                out[lang][name] = [x / sum(n) for x in n]
    return out


def divergence(hist: Column, total: Column, shares: list[float] | Column) -> Column:
    """Jensen-Shannon distance of counts (array<struct<bin, n>>, bin from 1
    on) from shares, none of which is 0."""
    q_all = shares if isinstance(shares, Column) else F.array(*[F.lit(x) for x in shares])

    def add(acc, x):
        p, q = x.n / total, F.element_at(q_all, x.bin)
        return acc + p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q)) - q

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(hist, F.lit(1.0), add) / 2))


def judge_quality(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, word_js, class_js (null without references), kept."""
    refs = references(docs) if refs is None else refs
    df = measured(docs)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    if not refs:
        null = F.lit(None).cast("double")
        return df.select(*base, failed.alias("base_failed"), null.alias("word_js"), null.alias("class_js"), (~failed).alias("kept"))
    word_list = F.array(*[F.lit(w) for w in WORD_LIST])
    df = df.select(
        *base, "lang", "n_chars",
        F.transform("hist", lambda x: F.struct(
            F.when(x.word.isNull(), F.lit(len(WORD_LIST) + 1)).otherwise(F.array_position(word_list, x.word).cast("int")).alias("bin"),
            x.n.cast("double").alias("n"))).alias("hist"),
        F.filter(F.array(*[F.struct(F.lit(k).alias("bin"), F.col(f"c_{n}").cast("double").alias("n")) for k, n in enumerate(CLASS_NAMES, 1)]),
                 lambda x: x.n > 0).alias("classes"))

    def against(hist, total, shares):
        return let(total, lambda t: divergence(hist, t, shares))

    common = {k: r for k, r in refs.items() if "words" in r}
    other = {k: r for k, r in refs.items() if "words" not in r}

    def nearest(hist, name):
        total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x.n)
        each = [against(F.col(hist), total, r[name]) for r in common.values()]
        least = F.least(*each) if len(each) > 1 else each[0] if each else F.lit(None).cast("double")
        if name == "classes" and other:
            by_lang = F.create_map(*[x for k, r in other.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in r[name]]))])
            own = let(F.element_at(by_lang, F.col("lang")), lambda q: against(F.col(hist), total, q))
            own = F.when(F.col("lang").isin(sorted(other)), own)
            least = F.least(least, own) if each else own
        return F.when(F.size(hist) > 0, least)

    df = df.select(*base, "lang", "n_chars", failed.alias("base_failed"), nearest("hist", "words").alias("word_js"), nearest("classes", "classes").alias("class_js"))

    def above(js, size, limits):
        out = F.lit(False)
        for least, most in sorted(limits):
            out = F.when(F.col(size) >= least, F.coalesce(F.col(js) > most, F.lit(False))).otherwise(out)
        return out

    known = F.col("lang").isNull() | F.col("lang").isin(sorted(common))
    unlike = (known & above("word_js", "n_words", WORD_LIMITS)) | above("class_js", "n_chars", CLASS_LIMITS)
    return df.select(*base, "base_failed", "word_js", "class_js", (~F.col("base_failed") & ~unlike).alias("kept"))
