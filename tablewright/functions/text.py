"""Text and record expressions; each takes and returns columns."""

from pyspark.sql import functions as F

# Fixed value: a run of characters that are not letters, digits or underscore.
NON_WORD = r"[^\p{L}\p{N}_]+"
NON_WORD_ONE = r"[^\p{L}\p{N}_]"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def joined_text(*cols):
    """Columns with a space between; NULLs are left out."""
    return F.concat_ws(" ", *[_col(c).cast("string") for c in cols])


def tokens(col):
    """Lower-case word tokens, duplicates kept, empties dropped."""
    return F.filter(F.split(F.lower(_col(col)), NON_WORD), lambda t: t != "")


def word_chars(col):
    """Only the words of a text, one space between."""
    parts = F.split(_col(col), NON_WORD_ONE)
    return F.array_join(F.filter(parts, lambda t: F.trim(t) != ""), " ")


def words(col, lower_case=True, alphanum_only=True):
    """Word list, with the case and the punctuation rule as options."""
    text = F.lower(_col(col)) if lower_case else _col(col)
    if alphanum_only:
        text = word_chars(text)
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def qgrams(col, q, lower_case=True, alphanum_only=True):
    """Character q-grams of the text padded with ``^`` and ``$``."""
    if type(q) is not int or q <= 0:
        raise ValueError("q must be a positive integer")
    text = F.lower(_col(col)) if lower_case else _col(col)
    if alphanum_only:
        text = word_chars(text)
    padded = F.concat(F.lit("^" * (q - 1)), text, F.lit("$" * (q - 1)))
    count = F.length(text) + q - 1
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(padded, i, F.lit(q)))
    return F.when(count > 0, grams).when(count == 0, F.array().cast("array<string>"))


def edit_similarity(a, b):
    """1 - edit distance / longer length; NULL when both are empty."""
    a, b = _col(a), _col(b)
    return 1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def list_jaccard(a, b):
    """Jaccard whose sizes are list lengths: duplicates weigh in the union."""
    a, b = _col(a), _col(b)
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def set_jaccard(a, b):
    """Jaccard of the two sets; NULL when both are empty."""
    a, b = _col(a), _col(b)
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def word_jaccard(a, b, lower_case=True, alphanum_only=True):
    return list_jaccard(words(a, lower_case, alphanum_only), words(b, lower_case, alphanum_only))


def qgram_jaccard(a, b, q, lower_case=True, alphanum_only=True):
    return list_jaccard(qgrams(a, q, lower_case, alphanum_only), qgrams(b, q, lower_case, alphanum_only))


def title_case(col):
    """A capital after anything that is not a letter."""
    runs = F.regexp_extract_all(_col(col), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))

    def cased(run):
        # an upper-case form may be longer than one character
        head = F.upper(F.substring(run, 1, 1))
        tail = F.concat(F.substr(head, F.lit(2)), F.substr(run, F.lit(2)))
        return F.concat(F.substring(head, 1, 1), F.lower(tail))

    return F.array_join(F.transform(runs, cased), "")


def squeeze(col):
    """Trimmed text, one space for each run of white space."""
    return F.trim(F.regexp_replace(_col(col), r"\s+", " "))


def link_label(col):
    """Link text as an upper-case key, underscores for white space."""
    return F.upper(F.replace(squeeze(col), F.lit(" "), F.lit("_")))


def absolute_link(col, base):
    """Put ``base`` before links that do not start with it."""
    base = base.rstrip("/")
    return F.when(F.startswith(_col(col), F.lit(base + "/")), _col(col)).otherwise(
        F.concat(F.lit(base), _col(col))
    )


def page_file(col):
    """Last path segment of a link."""
    path = F.regexp_replace(_col(col), r"[?#].*$", "")
    return F.element_at(F.split(path, "/"), -1)


def age_in(year, col):
    """Age of someone who was 23 in year ``col``."""
    return F.lit(year + 23) - _col(col)


def list_literal(col):
    """A cell such as ``['a', 'b', 3]`` or ``[a,b,3]`` as an array of strings."""
    inner = F.regexp_replace(_col(col), r"^\s*\[|\]\s*$", "")
    quoted = F.from_json(_col(col), "array<string>")
    bare = F.transform(F.split(inner, ","), lambda x: F.trim(x))
    return F.when(_col(col).rlike("['\"]"), quoted).otherwise(bare)
