"""Text functions as Column builders; they stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words that coordination queries leave out.
STOPWORDS = """a an and are as at be by for from has have how i in is it its of on or that the
their there these this to was what when where which who why will with""".split()


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing, with repeats; null has none."""
    return F.filter(F.split(lowered(text), "[^a-z0-9]+"), lambda x: x != "")


def query_terms(text: Column) -> Column:
    """Distinct tokens without stop words, in first-seen order."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(tokens(text), lambda x: ~F.array_contains(stop, x)))


def unicode_words(text: Column) -> Column:
    """Whole Unicode words under simple case folding: a plain term matches word-bounded where it equals one."""
    folded = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "ſ", "s")
    return F.filter(F.split(folded, r"(?U)\W+"), lambda x: x != "")


def bounded_count(text: Column, term: str) -> Column:
    """Places where a literal stands word-bounded, in either case; what unicode_words is tested against, but for a capital I with a dot, which this takes for an i and whole words don't."""
    return F.regexp_count(text, F.lit(rf"(?iU)(?<!\w)\Q{term}\E(?!\w)"))


def folded(text: Column) -> Column:
    """Text (null: empty) with the letters that fold to a-z as those."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u017f\u212a", "abcdefghijklmnopqrstuvwxyzsk")


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def title_text(title: Column, text: Column) -> Column:
    """Title and body with a space between, stripped."""
    return strip(F.concat(strip(title), F.lit(" "), strip(text)))


def node(surface: Column) -> Column:
    """Normal form of an entity: lower case, other marks as spaces, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(surface), "[^a-z0-9 ]", " "), " +", " "))


def without_disambiguator(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"(?U)\s*\([^)]*\)\s*$", ""))


def run_inside(inner: Column, outer: Column) -> Column:
    """Whether an array of tokens stands consecutively in another; an empty one doesn't."""
    pad = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(inner) > 0) & (F.instr(pad(outer), pad(inner)) > 0)


def comma_list(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def prefixed(text: Column, prefix: str | None) -> Column:
    return F.concat(F.lit(prefix), text) if prefix else text


def minted_id(number: Column, stem: str = "doc") -> Column:
    return F.format_string(f"{stem}-%06d", number)


def digest(content: Column) -> Column:
    return F.sha2(content, 256)
