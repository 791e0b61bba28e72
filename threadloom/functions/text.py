"""Native Column expressions for text: folding, letter tokens, bigrams, snippets, search tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The words that topic mining leaves out, by language.
ENGLISH = (
    "a about after again against all also am an and any are as at be because been before being between both but by can could did do does doing down during each few for "
    "from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once "
    "only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
)
POLISH = (
    "aby albo ale ani aż bez bo być ci co czy dla do gdy gdzie go i ich im inna inne jest jeśli już kiedy kto która które który ma mi mnie może na nad nam nas nie niż o od "
    "oraz po pod przez przy są się ta tak także tam te tego tej ten to tu tych tym tylko w we więc z za ze że"
)
SWEDISH = (
    "alla allt att av blev bli blir det detta du då en ett eller för från ha hade han har hon hur här i inte jag kan med men mot mycket när och om på samma sig sin sina som "
    "till under upp ur vad var vara vi vid vilken vilka än är även över"
)
STOPWORDS = tuple(sorted({*ENGLISH.split(), *POLISH.split(), *SWEDISH.split()}))
SNIPPET = 280


@F.pandas_udf(StringType())
def exact_fold(text: pd.Series) -> pd.Series:
    """NFKC, then full case folding, of any text."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


#: Characters that NFKC leaves alone and whose full case folding is lower case, or ss for ß: ASCII, Latin letters with a
#: diacritic of their own, and the commonest marks. A text of these is folded natively.
PLAIN = r"^[\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u012F\u0134-\u013E\u0141-\u0148\u014A-\u017E\u2010\u2013\u2014\u2018-\u201E\u2022]*$"


def fold(text: Column) -> Column:
    """NFKC and full case folding: native for texts of plain characters (nearly all), by `exact_fold` for the others alone."""
    plain = text.rlike(PLAIN)
    return F.when(plain, F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))).otherwise(exact_fold(F.when(~plain, text)))


def tokens(folded: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Runs of at least three letters that are no stopwords, in order."""
    found = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{Nl}\p{No}]{3,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stopwords))  # a hash set


def bigrams(words: Column) -> Column:
    """Neighbours joined by a space, where they differ."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.when(a != b, F.concat_ws(" ", a, b)))
    return F.filter(pairs, lambda x: x.isNotNull())


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """White space collapsed; longer than `most`: cut to one less and an ellipsis. Null: ''."""
    flat = F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.coalesce(F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat), F.lit(""))


def _accents() -> tuple[str, str]:
    """Latin letters with one diacritic, and their base letters, from Unicode's decompositions."""
    pairs = {}
    for i in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(i))
        if len(parts) == 2 and parts[0].isascii() and chr(i).lower() == chr(i):
            pairs[chr(i)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


def search_tokens(text: Column) -> Column:
    """Tokens of the full-text index: lower case, diacritics of Latin letters off, runs of letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(text), *_accents()), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Tokens of a search, folded as the index is; an error if there are none."""
    import re

    table = str.maketrans(*_accents())
    found = re.findall(r"[^\W_]+", query.lower().translate(table))
    if not found:
        raise ValueError("search_query_has_no_terms")
    return found


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_pattern(query: str) -> str:
    """Pattern for a literal substring, with '\\' as escape."""
    return "%" + query.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def stable_id(kind: str, record: Column) -> Column:
    """Id of an imported record; the prefix is a fixed value of the export format."""
    return F.concat(F.lit(f"chatgpt-{kind}-"), F.sha2(F.concat(F.lit(f"chatgpt:{kind}:"), record).cast("binary"), 256))


def topic_id(term: Column) -> Column:
    return F.concat(F.lit("topic-"), F.sha2(term.cast("binary"), 256))


def relation_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("topic-relation-"), F.sha2(F.concat(a, F.lit(":"), b).cast("binary"), 256))


def cosine(together: Column, a: Column, b: Column) -> Column:
    """Co-occurrence over the geometric mean of the two counts; 0 where that is 0."""
    return F.coalesce(F.try_divide(together.cast("double"), F.sqrt((a * b).cast("double"))), F.lit(0.0))
