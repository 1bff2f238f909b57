"""Quality rules by the divergence of a document's histograms from its language, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lettings.llm.common import SPACES, let, words
from lettings.session import stable

LEAST_WORDS, REPEATED_SHARE = 50, 50
LEAST_CHARS, LEAST_COMMON = 200, 100
CHAR_LIMIT, WORD_LIMIT = 0.08, 0.095
SYMBOLS = "#*$%&|<>"
# Frequent words of the languages; how frequent they are is counted in the documents.
COMMON = {
    "en": "the of and to a in is that for it as was with be by on",
    "de": "der die und den von zu das mit sich des auf für ist im dem ein",
    "fr": "de la le et les des en un une du que qui dans pour par sur",
    "es": "de la que el en y a los se del las un por con no una",
}
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")


def repeated(parts: Column) -> Column:
    """Words inside a 3-word window whose words occur twice or more.

    Texts with a repeated window sort their windows by hash, so equal ones are neighbours;
    the work is n log n in a text's words.
    """
    def windows(w: Column) -> Column:
        places = F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), lambda x, y: F.when(
            x["h"] == y["h"], F.array(x["i"], x["i"] + 1, x["i"] + 2, y["i"], y["i"] + 1, y["i"] + 2)
        ))
        return F.size(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    def counted(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, covered))

    return let(windows(parts), counted)


def measure(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Counts of the base rules and the histograms ``__chars`` and ``__common`` of each document."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, "")).cast("long")

    known = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    listed = F.coalesce(F.try_element_at(known, F.coalesce(F.col(lang), F.lit(""))), F.array().cast("array<string>"))
    every = sorted({w for v in COMMON.values() for w in v.split()})
    counted = docs.withColumns({
        "__words": words(F.col(text)), "__lines": lines, "__length": F.length(t).cast("long"),
        "word_chars": left(SPACES), "n_symbols": left(r"[^#*$%&|<>]+"), "__upper": left(r"[^\p{Lu}]+"),
        "__digit": left("[^0-9]+"), "__lower": F.length(t) - left(r"\p{Ll}+"),
    })
    low = F.filter(F.transform("__words", lambda w: F.lower(w)), lambda w: w.isin(*every))
    tagged = F.concat(F.lit("<"), F.array_join(low, "><"), F.lit(">"))

    def histogram(tags: Column) -> Column:
        def times(word: Column) -> Column:
            tag = F.concat(F.lit("<"), word, F.lit(">"))
            rest = F.octet_length(tags) - F.octet_length(F.replace(tags, tag, F.lit("")))
            return (rest / F.octet_length(tag)).cast("long")

        return F.transform(listed, times)

    rest = F.col("__length") - F.col("__lower") - F.col("__upper") - F.col("__digit") - F.col("n_symbols")
    space = F.col("__length") - F.col("word_chars")
    return counted.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated(F.col("__words")).cast("long"),
        "__chars": F.array("__lower", "__upper", "__digit", space, "n_symbols", rest - space),
        "__common": let(tagged, histogram),
    }).drop("__words", "__lines", "__length", "__upper", "__digit", "__lower")


def with_rest(counts: Column, n: Column) -> Column:
    """The counts and what is left of ``n``."""
    return F.concat(counts, F.array(n - F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance squared, in bits, of two histograms of the same bins."""
    def total(h: Column) -> Column:
        return F.aggregate(h, F.lit(0).cast("double"), lambda a, b: a + b)

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    def shares(h: Column) -> Column:
        return F.transform(F.array(F.greatest(total(h), F.lit(1.0))), lambda n: F.transform(h, lambda x: x / n))[0]

    terms = F.zip_with(shares(p), shares(q), lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the base counts, both divergences, base_failed and kept.

    The references are the summed histograms of all documents of a language: character
    classes, and the language's frequent words against all other words.  A document is
    kept if the base rules pass and neither divergence exceeds its limit; a histogram is
    compared only from ``LEAST_CHARS`` characters or ``LEAST_COMMON`` words on.

    Null and empty texts have counts 0, fail the base rules and are not kept; a null or
    unknown language is one of its own (without frequent words); repeated rows count
    separately; an empty table gives no rows; columns named as an added one are replaced.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = [F.col(c).alias(c) for c in keep if c not in added]
    given = docs.select(*own, F.col(text).alias("__text"), F.coalesce(F.col(lang), F.lit("")).alias("__lang"))
    counted = stable(measure(given, "__text", "__lang").drop("__text").withColumn(
        "__common", with_rest(F.col("__common"), F.col("n_words"))
    ))
    width = max(len(v.split()) for v in COMMON.values()) + 1

    def summed(c: str, n: int) -> Column:
        return F.array(*[F.sum(F.coalesce(F.get(F.col(c), i), F.lit(0))) for i in range(n)])

    reference = counted.groupBy("__lang").agg(
        summed("__chars", len(CLASSES)).alias("__all_chars"), summed("__common", width).alias("__all_common"),
    )
    both = counted.join(reference, "__lang")
    same_width = F.slice("__all_common", F.lit(1), F.size("__common"))
    return both.withColumns({
        "char_divergence": F.when(
            F.col("word_chars") >= LEAST_CHARS, divergence(F.col("__chars"), F.col("__all_chars"))
        ).otherwise(0.0),
        "word_divergence": F.when(
            F.col("n_words") >= LEAST_COMMON, divergence(F.col("__common"), same_width)
        ).otherwise(0.0),
        "base_failed": (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words")),
    }).withColumn(
        "kept", ~F.col("base_failed") & (F.col("char_divergence") <= CHAR_LIMIT) & (F.col("word_divergence") <= WORD_LIMIT)
    ).drop("__lang", "__chars", "__common", "__all_chars", "__all_common")


def _share(counts: str, i: str) -> str:
    return f"({counts}[{i}] / greatest(cast(list_sum({counts}) as double), 1e0))"


def _divergence(p: str, q: str) -> str:
    """SQL of ``divergence`` for two lists of counts."""
    def part(x: str, y: str) -> str:
        return f"case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0e0 end"

    a, b = _share(p, "i"), _share(q, "i")
    return f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part(a, b)} + {part(b, a)}) / 2))"


_LISTED = " ".join(f"when '{k}' then [{', '.join(repr(w) for w in v.split())}]" for k, v in COMMON.items())
ORACLE = f"""
with w as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    case lang {_LISTED} else [] end as listed from documents),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, g) as n
  from (select doc_id, i, array_to_string(w[i:i + 2], ' ') as g
    from (select doc_id, w, unnest(range(1, cast(len(w) - 1 as bigint))) as i from w where len(w) > 2))),
repeated as (
  select doc_id, count(distinct i + k) as n from (select doc_id, i, unnest([0, 1, 2]) as k from windows where n > 1) group by doc_id),
counted as (
  select doc_id, lang, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(t) as n,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(t, '\\p{{Lu}}')) as upper,
    len(regexp_extract_all(t, '[0-9]')) as digit, len(regexp_extract_all(t, '\\p{{Ll}}')) as lower,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
    list_transform(listed, lambda c: len(list_filter(w, lambda x: lower(x) = c))) as common from w),
documents_ as (
  select doc_id, lang, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    [lower, upper, digit, n - word_chars, n_symbols, word_chars - lower - upper - digit - n_symbols] as chars,
    list_append(common, n_words - coalesce(cast(list_sum(common) as bigint), 0)) as common from counted),
reference as (
  select lang, list(c order by i) as all_chars from (
    select lang, i, sum(c) as c from (select lang, unnest(chars) as c, unnest(range(1, 7)) as i from documents_) group by all) group by lang),
frequent as (
  select lang, list(c order by i) as all_common from (
    select lang, i, sum(c) as c from (
      select lang, unnest(common) as c, unnest(range(1, cast(len(common) + 1 as bigint))) as i from documents_) group by all) group by lang),
judged as (
  select d.*, coalesce(r.n, 0) as n_repeat_words,
    case when word_chars >= {LEAST_CHARS} then {_divergence('chars', 'all_chars')} else 0e0 end as char_divergence,
    case when n_words >= {LEAST_COMMON} then {_divergence('common', 'all_common')} else 0e0 end as word_divergence
  from documents_ d left join repeated r using (doc_id) join reference using (lang) join frequent using (lang))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_SHARE} * n_words as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_SHARE} * n_words)
    and char_divergence <= {CHAR_LIMIT}e0 and word_divergence <= {WORD_LIMIT}e0 as kept,
  round(char_divergence, 6) as char_divergence, round(word_divergence, 6) as word_divergence
from judged
"""
