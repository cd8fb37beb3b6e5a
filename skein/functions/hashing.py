"""Keyed hashes and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import normalize_host, trimmed

BITS = {"SHA256": 256, "SHA512": 512}


def keyed_hash(c: Column, pepper: str, algorithm: str = "SHA256") -> Column:
    """h2(p 01 h1(p 00 norm FF) EE) in hex; norm trims and lower-cases. Null stays null, empty stays empty."""
    if algorithm.upper() not in BITS:
        raise ValueError(f"{algorithm} is not available")
    bits, p = BITS[algorithm.upper()], pepper.encode()
    inner = F.sha2(F.concat(F.lit(p + b"\x00"), F.encode(F.lower(trimmed(c)), "UTF-8"), F.lit(b"\xff")), bits)
    return F.when(c == "", F.lit("")).otherwise(F.sha2(F.concat(F.lit(p + b"\x01"), F.unhex(inner), F.lit(b"\xee")), bits))


def bound(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it: plans grow by sums, not by products."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def replace_matches(c: Column, pattern: str, change, needs: str = "") -> Column:
    """Each match (group 1) replaced by change(match), natively: gaps and changed matches are zipped.

    A text without ``needs``, which every match holds, is left as it is, unsearched.
    """

    def replaced(x: Column) -> Column:
        # split() of a pattern with one group drops the group, so gaps and matches alternate
        found = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), change)
        done = F.array_join(F.zip_with(F.split(x, pattern, -1), found, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
        return F.when(x.contains(needs), done).otherwise(x) if needs else done

    return bound(c, replaced)


HANDLE = r"(@[\p{L}\p{N}_.]{1,64})"
MAIL = r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"
LINK = r"((?i:https?://|www\.)[^\s<>\"'\)\]]+)"


def redact(c: Column, pepper: str, algorithm: str = "SHA256") -> Column:
    """Mentions become @u_<hash of the handle>, then e-mails [EMAIL], then links URL_<host>. Dots that end a handle stay text."""

    def handle(m):
        name = F.regexp_replace(F.substring(m, 2, 100), r"\.+$", "")
        return F.when(name == "", m).otherwise(F.concat(F.lit("@u_"), keyed_hash(name, pepper, algorithm), F.regexp_extract(m, r"(\.*)$", 1)))

    out = replace_matches(c, r"(?<![A-Za-z0-9._%+\-])" + HANDLE, handle, "@")
    out = bound(out, lambda x: F.when(x.contains("@"), F.regexp_replace(x, MAIL, "[EMAIL]")).otherwise(x))
    linked = lambda x: F.lower(x).contains("http") | F.lower(x).contains("www.")
    return bound(out, lambda x: F.when(linked(x), replace_matches(x, LINK, lambda m: F.concat(F.lit("URL_"), F.coalesce(normalize_host(m), F.lit(""))))).otherwise(x))


def sanitize_entity(kind: Column, body: Column, pepper: str) -> Column:
    """An entity's body without identity, by its type."""
    mail = F.regexp_extract(F.lower(body), r"@([a-z0-9.\-]+\.[a-z]{2,})$", 1)
    return (
        F.when(kind == "HASHTAG", F.lower(F.regexp_replace(body, "^#+", "")))
        .when(kind == "USER_TAG", F.concat(F.lit("@u_"), keyed_hash(F.regexp_replace(body, "^@+", ""), pepper)))
        .when(kind == "LINK", F.concat(F.lit("dom_"), F.coalesce(normalize_host(body), F.lit(""))))
        .when(kind == "EMAIL", F.when(mail != "", mail).otherwise(F.lit("[EMAIL]")))
        .when(kind.isin("IMAGE", "VIDEO"), F.lit("media"))
        .otherwise(body)
    )
