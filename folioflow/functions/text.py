"""Column expressions on text. All of them run inside the JVM.

White space and word characters follow Python's ``str.split`` and ``re``: the Unicode
flag makes ``\\s`` Unicode space in Java, and four separator controls are added to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?U)"
SPACE_CHARS = r"\s\x1C-\x1F"
SPACE = f"[{SPACE_CHARS}]"
WORD_CHARS = r"\p{L}\p{N}_"

# URL pattern of the text cleaner.
URL_PATTERN = f"{UNICODE}http[^{SPACE_CHARS}]+|www[^{SPACE_CHARS}]+|https[^{SPACE_CHARS}]+"

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its "
    "itself they them their theirs themselves what which who whom this that that'll "
    "these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren "
    "aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space of any kind."""
    head_gone = F.regexp_replace(_col(c), f"{UNICODE}^{SPACE}+", "")
    return F.regexp_replace(head_gone, UNICODE + SPACE + r"+\z", "")


def words(c: Column | str) -> Column:
    """White-space separated words, no empty ones."""
    return F.filter(F.split(_col(c), f"{UNICODE}{SPACE}+"), lambda t: t != "")


def token_set(c: Column | str) -> Column:
    """Distinct lower-cased words in order of first occurrence."""
    return F.array_distinct(words(F.lower(_col(c))))


def count_tokens(c: Column | str) -> Column:
    return F.size(words(c))


def truncate_words(c: Column | str, limit: int) -> Column:
    """First ``limit`` words when there are more; else the text as it is."""
    toks = words(c)
    return F.when(F.size(toks) <= limit, _col(c)).otherwise(
        F.array_join(F.slice(toks, 1, limit), " ")
    )


def truncate_chars(c: Column | str, limit: int) -> Column:
    """Fallback truncation: four characters stand for one token."""
    return F.substring(_col(c), 1, limit * 4)


def preprocess_query(c: Column | str, max_len: int = 512) -> Column:
    return F.substring(strip(c), 1, max_len)


def preview(c: Column | str, limit: int = 100) -> Column:
    c = _col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def clean_text(c: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Drop URLs, characters that are neither word nor space, and stop words."""
    no_urls = F.regexp_replace(_col(c), URL_PATTERN, "")
    plain = F.regexp_replace(no_urls, f"{UNICODE}[^{WORD_CHARS}{SPACE_CHARS}]", "")
    stops = list(stop_words)
    kept = F.filter(words(plain), lambda t: ~F.lower(t).isin(stops))
    return F.array_join(kept, " ")


def keep_word_lengths(c: Column | str, low: int = 3, high: int = 20) -> Column:
    kept = F.filter(words(c), lambda t: F.length(t).between(low, high))
    return F.array_join(kept, " ")


def content_hash(c: Column | str) -> Column:
    return F.md5(_col(c))


def stable_doc_id(text: Column | str, source: Column | str) -> Column:
    joined = F.concat(_col(text), F.coalesce(_col(source).cast("string"), F.lit("")))
    return F.concat(F.lit("doc-"), F.md5(joined))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


_EXTENSION = r"^\.*[^.].*(\.[^.]*)$"


def file_extension(name: Column | str) -> Column:
    """Lower-case extension with its dot; leading dots belong to the stem."""
    return F.lower(F.regexp_extract(_col(name), _EXTENSION, 1))


def file_stem(name: Column | str) -> Column:
    name = _col(name)
    ext_len = F.length(F.regexp_extract(name, _EXTENSION, 1))
    return F.substring(name, F.lit(1), F.length(name) - ext_len)


def path_lob(path: Column | str) -> Column:
    """Line of business: third-last path part, unless it is raw or data."""
    parts = F.split(_col(path), "/")
    part = F.lower(F.try_element_at(parts, F.lit(-3)))
    known = (F.size(parts) >= 4) & ~part.isin("raw", "data")
    return F.when(known, part).otherwise(F.lit("general"))


def path_state(path: Column | str) -> Column:
    """State code: second-last path part if it has two characters."""
    parts = F.split(_col(path), "/")
    part = F.try_element_at(parts, F.lit(-2))
    known = (F.size(parts) >= 4) & (F.length(part) == 2)
    return F.when(known, F.upper(part)).otherwise(F.lit("all"))


def merge_maps(left: Column | str, right: Column | str) -> Column:
    """Union of two maps; the right side wins on a shared key."""
    left, right = _col(left), _col(right)
    rest = F.map_filter(left, lambda k, _v: ~F.map_contains_key(right, k))
    return F.map_concat(rest, right)


def clean_answer(c: Column | str) -> Column:
    """Drop an echoed prompt, then the stock lead phrase."""
    c = _col(c)
    echoed = c.startswith("System:") | c.startswith("Context:")
    body = F.when(
        echoed, strip(F.substring_index(c, "Assistant:", -1))
    ).otherwise(c)
    return F.when(
        body.startswith("Based on the provided context"),
        F.replace(body, F.lit("Based on the provided context, "), F.lit("")),
    ).otherwise(body)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of two sets; 0 when both are empty."""
    a, b = _col(a), _col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap_share(part: Column | str, whole: Column | str) -> Column:
    """Share of the items of ``part`` that ``whole`` holds; 0 for an empty part."""
    part, whole = _col(part), _col(whole)
    return F.when(
        F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)
    ).otherwise(F.lit(0.0))


def token_windows(toks: Column, size: int, overlap: int) -> Column:
    """Array of token windows; starts are multiples of ``size - overlap``.

    The last window is the first that reaches the end. No token, no window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap
    n = F.size(toks)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(toks, i * step + 1, F.lit(size)), " "))


def ngrams(toks: Column, n: int) -> Column:
    """All n-grams of a token array, in order, joined by a space."""
    if n == 1:
        return toks
    count = F.size(toks) - (n - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))
