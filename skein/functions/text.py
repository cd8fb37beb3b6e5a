"""Text extraction and clean-up, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches must equal the specified ones.
EMAIL = r"(?U)([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"
MENTION = r"(?U)(?<!\w)@([A-Za-z0-9_]{1,15})(?![A-Za-z0-9_])"
HASHTAG = r"(?U)(?<!\w)#([A-Za-z0-9_]{1,100})(?![A-Za-z0-9_])"
TLDS = "com|org|net|edu|gov|mil|int|info|io|co|uk|de|fr|es|it|nl|ru|eu|us|ca|au|jp|cn|in|br|me|tv|ly|app|dev|news|blog|gl|be"
URL = rf"(?i)((?:https?://|www\.)[^\s<>\"'\)\]]+|(?<![@\w.])(?:[a-z0-9-]+\.)+(?:{TLDS})\b(?:/[^\s<>\"'\)\]]*)?)"


def text_of(c: Column) -> Column:
    """The column as text: null and nan become empty."""
    s = c.cast("string")
    return F.coalesce(F.when(F.lower(s) != "nan", s), F.lit(""))


def _unique(c: Column, pattern: str, change, needs: str = "") -> Column:
    """Distinct changed matches in order; a text without ``needs``, which every match holds, isn't searched."""
    found = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), change))
    if not needs:
        return found(text_of(c))
    none = F.array().cast("array<string>")
    return F.get(F.transform(F.array(text_of(c)), lambda x: F.when(x.contains(needs), found(x)).otherwise(none)), F.lit(0))


def extract_emails(c: Column) -> Column:
    return _unique(c, EMAIL, F.lower, "@")


def extract_mentions(c: Column) -> Column:
    return _unique(c, MENTION, F.lower, "@")


def extract_hashtags(c: Column) -> Column:
    return _unique(c, HASHTAG, F.lower, "#")


def extract_urls(c: Column) -> Column:
    """Links in order, each once, with http:// put before bare ones; trailing punctuation is dropped."""
    return _unique(c, URL, lambda u: F.regexp_replace(F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("http://"), u)), r"[.,;:!?]+$", ""))


def extract_all(c: Column) -> Column:
    return F.struct(extract_emails(c).alias("emails"), extract_mentions(c).alias("mentions"), extract_hashtags(c).alias("hashtags"), extract_urls(c).alias("urls"))


def strip_nul(c: Column) -> Column:
    return F.translate(c, "\0", "")


def blank_to_null(c: Column, trim: bool = False) -> Column:
    s = trimmed(c) if trim else c
    return F.when(trimmed(s) != "", s)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_host(url: Column) -> Column:
    """Host of an address with or without scheme: no user, port or leading www., lower case; null if none."""
    rest = F.regexp_replace(trimmed(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@|:\d*$", "")), r"^www\.", "")
    return F.when(host != "", host)


# Suffixes of two labels under which names are registered.
TWO_LABEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "com.mx", "com.tr", "co.in", "co.za", "com.cn")


def registered_domain(url: Column) -> Column:
    host = normalize_host(url)
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(*TWO_LABEL), three).otherwise(two)


def clean_for_language(c: Column) -> Column:
    """Without mentions, links and emoji codes, with single spaces."""
    return trimmed(F.regexp_replace(F.regexp_replace(text_of(c), r"(?U)@\w+|https?://\S+|<emoji:[^>]*>|[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]", " "), r"(?U)\s+", " "))


def mention_to_user(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"(?U)(?<!\w)@\w+", "@user")


def stance(labels: Column, order: tuple[str, ...], default: str = "neutral") -> Column:
    """One label of a nested list of answers: the first of ``order`` that occurs anywhere in them, in any case."""
    joined = F.lower(F.array_join(F.flatten(labels), " "))
    out = F.lit(default)
    for name in reversed(order):
        out = F.when(joined.contains(name.lower()), F.lit(name)).otherwise(out)
    return out


def fill_template(template: str, values: dict[str, Column], defaults: dict[str, str] | None = None) -> Column:
    """A prompt with {name} fields taken from columns; nulls take the default or empty."""
    import string

    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(literal))
        if field is not None:
            default = (defaults or {}).get(field, "")
            parts.append(F.coalesce(values[field].cast("string"), F.lit(default)) if field in values else F.lit(default))
    return F.concat(*parts)
