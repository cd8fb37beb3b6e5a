"""Pseudonymisation by policy, pattern rules for personal data, and erasure."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.hashing import bound, keyed_hash, redact, replace_matches, sanitize_entity


@dataclass(frozen=True)
class Policy:
    """Columns by table to drop, hash, redact or blank; this order wins where a column is in several."""

    drop: dict[str, tuple[str, ...]] = field(default_factory=dict)
    hash: dict[str, tuple[str, ...]] = field(default_factory=dict)
    redact: dict[str, tuple[str, ...]] = field(default_factory=dict)
    blank: dict[str, tuple[str, ...]] = field(default_factory=dict)


# What is done to each column of the relational model.
DEFAULT_POLICY = Policy(
    hash={
        "accounts": ("account_id", "username", "profile_name"), "communities": ("community_id", "community_username", "community_name", "owner_account_id"), "posts": ("post_id", "account_id", "conversation_id", "community_id"),
        "entities": ("account_id", "community_id", "post_id"), "actions": ("originator_account_id", "originator_post_id", "target_account_id", "target_post_id", "originator_community_id", "target_community_id"),
        "account_enrichments": ("account_id",), "post_enrichments": ("post_id",),
    },
    redact={"accounts": ("bio",), "communities": ("bio",), "posts": ("body",)}, blank={"accounts": ("profile_image_url", "location"), "communities": ("profile_image_url",), "posts": ("location",)},
)


def pseudonymize(df: DataFrame, table: str, pepper: str, policy: Policy = DEFAULT_POLICY, algorithm: str = "SHA256", personal: dict[tuple[str, str], dict] | None = None) -> DataFrame:
    """One narrow stage: no shuffle. Blanked and dropped columns are null.

    ``personal`` gives for (table, column) what pii() does to each kind of personal data there, before the
    policy's hash or redaction.
    """
    out = []
    for c, kind in df.dtypes:
        x = F.col(c)
        actions = (personal or {}).get((table, c))
        if actions:
            x = pii(x, actions, pepper, F.col("platform") if "platform" in df.columns else None)
        if c in policy.drop.get(table, ()):
            x = F.lit(None).cast(kind)
        elif table == "entities" and c == "body":
            x = sanitize_entity(F.col("entity_type"), x, pepper)
        elif c in policy.hash.get(table, ()):
            x = keyed_hash(x, pepper, algorithm)
        elif c in policy.redact.get(table, ()):
            x = redact(x, pepper, algorithm)
        elif c in policy.blank.get(table, ()):
            x = F.lit(None).cast(kind)
        out.append(x.alias(c))
    return df.select(*out)


#: The order in which tables are done.
ORDER = ("dataset_meta", "communities", "accounts", "posts", "entities", "actions", "account_enrichments", "post_enrichments")


def run(source, target, pepper: str, policy: Policy = DEFAULT_POLICY, algorithm: str = "SHA256", personal: dict[tuple[str, str], dict] | None = None, start=None, end=None, conflict: str = "error") -> dict[str, int]:
    """All tables of one dataset, pseudonymised, into another; rows written by table.

    Both are datasets (``table(name, start, end)``, ``write(name, rows)``). conflict: ``error`` where a target
    table holds rows, ``append`` what is new by key, ``replace`` the target as a whole.
    """
    if conflict not in ("error", "append", "replace"):
        raise ValueError("conflict is error, append or replace")
    if conflict == "replace":
        target.create(replace=True)
    elif conflict == "error" and (full := [t for t in ORDER if not target.table(t).isEmpty()]):
        raise ValueError(f"{', '.join(full)} of the target hold rows")
    out = {}
    for name in ORDER:
        rows = source.table(name) if name == "dataset_meta" else source.table(name, start, end)
        before = target.table(name).count()
        target.write(name, pseudonymize(rows, name, pepper, policy, algorithm, personal))
        out[name] = target.table(name).count() - before
    return out


# Patterns of personal data, applied in this order.
PII = {
    "EMAIL": r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})", "URL": r"((?i:https?://|www\.)[^\s<>\"']+)", "IBAN": r"(\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)", "CREDIT_CARD": r"(\b(?:\d[ -]?){12,18}\d\b)",
    "IP": r"(\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b)", "PHONE": r"((?<![\w+])\+?\d[\d ().\-]{7,16}\d\b)", "MENTION": r"(?U)(?<!\w)(@\w{1,64})", "HASHTAG": r"(?U)(?<!\w)(#\w{1,139})",
}
# The same for Weibo.
WEIBO = {"HASHTAG": r"(#[^#\n]{1,139}#)", "MENTION": r"(?U)(?<!\w)(@[\w\-]{1,64})"}


def luhn(digits: Column) -> Column:
    """Whether the digits of a card number add up."""
    d = F.reverse(F.regexp_replace(digits, r"\D", ""))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


#: What a match of each kind holds for sure: texts without it aren't searched.
HOLDS = {"EMAIL": "@", "MENTION": "@", "HASHTAG": "#"}


def _replaced(c: Column, kind: str, change, platform: Column | None) -> Column:
    one = lambda m: change(m)
    if kind not in WEIBO or platform is None:
        return replace_matches(c, PII[kind], one, HOLDS.get(kind, ""))
    weibo = F.coalesce(platform == "weibo", F.lit(False))
    return bound(c, lambda x: F.when(weibo, replace_matches(x, WEIBO[kind], one, HOLDS[kind])).otherwise(replace_matches(x, PII[kind], one, HOLDS[kind])))


def pii(c: Column, actions: dict, pepper: str = "", platform: Column | None = None) -> Column:
    """Applies HASH, DROP, REPLACE:<text> or a function from Column to Column to each kind of personal data.

    Names and places need a model: an error here. On Weibo hashtags stand between two #, and mentions may
    hold hyphens.
    """
    unknown = set(actions) - set(PII)
    if unknown:
        raise ValueError(f"no pattern for {', '.join(sorted(unknown))}; give a model")
    for kind in (k for k in PII if k in actions):
        what = actions[kind]

        def change(m, kind=kind, what=what):
            if callable(what):
                new = what(m)
            elif what == "DROP":
                new = F.lit("")
            elif what == "HASH":
                new = F.concat(F.lit("@u_" if kind == "MENTION" else f"{kind}_"), keyed_hash(F.regexp_replace(m, "^[@#]|#$", ""), pepper))
            elif what.startswith("REPLACE:"):
                new = F.lit(what.removeprefix("REPLACE:"))
            else:
                raise ValueError(f"{what!r} is not HASH, DROP or REPLACE:<text>")
            return F.when(luhn(m), new).otherwise(m) if kind == "CREDIT_CARD" else new

        # a function for Spark has one parameter, so what differs by kind is bound beforehand
        c = _replaced(c, kind, change, platform)
    return c


#: Columns that a scrub leaves empty.
SCRUBBED = {"accounts": ("username", "profile_name", "bio", "location", "profile_image_url"), "posts": ("body", "location", "conversation_id", "community_id")}


def erase(tables: dict[str, DataFrame], identity: str, column: str = "username", mode: str = "SCRUB", pepper: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the person, report of counts). With a pepper the data are pseudonymised, and hashes match.

    Everything is joined with the person's account ids, so no list of them is held on the driver or in a plan.
    """
    if mode not in ("SCRUB", "DELETE"):
        raise ValueError("mode is SCRUB or DELETE")
    value = keyed_hash(F.lit(identity), pepper) if pepper else F.lit(identity)
    accounts, posts = tables["accounts"], tables["posts"]
    mine = accounts.where((F.col(column) == value) & F.col("account_id").isNotNull()).select("account_id").distinct()
    own_posts = posts.join(mine, "account_id", "left_semi").select("post_id").distinct()
    ids = lambda c: mine.select(F.col("account_id").alias(c))
    of = lambda df, c="account_id": df.join(ids(c), c, "left_semi")
    without = lambda df, c="account_id": df.join(ids(c), c, "left_anti").select(*df.columns)
    marked = lambda df, c: df.join(mine.select(F.col("account_id").alias(c), F.lit(True).alias("_hit")), c, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    out, report = dict(tables), []
    note = lambda what, df: report.append(df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n"))
    note("accounts", of(accounts))
    note("posts", of(posts))
    if "entities" in tables:
        e = tables["entities"]
        gone = e.where(F.col("post_id").isNotNull()).join(own_posts, "post_id", "left_semi").select(*e.columns)
        out["entities"] = without(e).join(own_posts, "post_id", "left_anti").select(*e.columns)
        note("entities", of(e).select(*e.columns).unionAll(without(gone)))
    if "account_enrichments" in tables:
        out["account_enrichments"] = without(tables["account_enrichments"])
        note("account_enrichments", of(tables["account_enrichments"]))
    if "post_enrichments" in tables:
        e = tables["post_enrichments"]
        out["post_enrichments"] = e.join(own_posts, "post_id", "left_anti").select(*e.columns)
        note("post_enrichments", e.join(own_posts, "post_id", "left_semi"))
    if "actions" in tables:
        a = tables["actions"]
        kept = marked(without(a, "originator_account_id"), "target_account_id")
        out["actions"] = kept.withColumn("target_account_id", F.when(~F.col("_hit"), F.col("target_account_id"))).select(*a.columns)
        note("actions", of(a, "originator_account_id"))
        note("action_targets", kept.where("_hit"))
    if "communities" in tables:
        c = tables["communities"]
        kept = marked(c, "owner_account_id")
        out["communities"] = kept.withColumn("owner_account_id", F.when(~F.col("_hit"), F.col("owner_account_id"))).select(*c.columns)
        note("community_owners", kept.where("_hit"))
    for name in ("accounts", "posts"):
        df = tables[name]
        if mode == "DELETE":
            out[name] = without(df)
            continue
        hit = F.col("_hit")
        scrub = {c: F.when(~hit, F.col(c)) for c in SCRUBBED[name] if c in df.columns}
        if not pepper:
            scrub["account_id"] = F.when(hit, F.concat(F.lit("erased_"), F.substring(F.sha2(F.concat(F.lit("erased"), "account_id"), 256), 1, 32))).otherwise(F.col("account_id"))
        out[name] = marked(df, "account_id").withColumns(scrub).select(*df.columns)
    all_counts = report[0]
    for r in report[1:]:
        all_counts = all_counts.union(r)
    return out, all_counts
