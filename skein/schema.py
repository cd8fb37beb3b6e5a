"""The canonical tables: columns, allowed values, keys, validity rules and layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and columns of the relational model.
TABLES = {
    "communities": "community_id string, community_type string, community_username string, community_name string, bio string, is_public boolean, member_count bigint, post_count bigint, profile_image_url string, owner_account_id string, platform string, created_at timestamp, retrieved_at timestamp",
    "accounts": "account_id string, username string, profile_name string, bio string, location string, post_count bigint, friend_count bigint, follower_count bigint, is_verified boolean, profile_image_url string, platform string, created_at timestamp, retrieved_at timestamp",
    "posts": "post_id string, account_id string, conversation_id string, community_id string, body string, like_count bigint, dislike_count bigint, view_count bigint, share_count bigint, comment_count bigint, quote_count bigint, bookmark_count bigint, location string, platform string, created_at timestamp, retrieved_at timestamp",
    "entities": "account_id string, community_id string, post_id string, body string, entity_type string, created_at timestamp, retrieved_at timestamp",
    "actions": "originator_account_id string, originator_post_id string, target_account_id string, target_post_id string, originator_community_id string, target_community_id string, action_type string, created_at timestamp, retrieved_at timestamp",
    "account_enrichments": "model_id string, account_id string, body string, created_at timestamp, retrieved_at timestamp",
    "post_enrichments": "model_id string, post_id string, body string, created_at timestamp, retrieved_at timestamp",
    "dataset_meta": "platform string, standardizer_name string, dataset_description string, created_at timestamp, updated_at timestamp",
}
ENTITY_TYPES = ("IMAGE", "VIDEO", "LINK", "USER_TAG", "HASHTAG", "EMAIL")
ACTION_TYPES = ("UPVOTE", "DOWNVOTE", "SHARE", "QUOTE", "UNFOLLOW", "FOLLOW", "COMMENT", "BLOCK", "LINK")
COMMUNITY_TYPES = ("GROUP", "CHANNEL")
ENUMS = {("entities", "entity_type"): ENTITY_TYPES, ("actions", "action_type"): ACTION_TYPES, ("communities", "community_type"): COMMUNITY_TYPES}
REQUIRED = {
    "communities": ("created_at",), "accounts": ("created_at",), "posts": ("post_id", "account_id", "created_at"), "entities": ("body", "entity_type", "created_at"), "actions": ("action_type", "created_at"),
    "account_enrichments": ("model_id", "account_id", "body", "created_at"), "post_enrichments": ("model_id", "post_id", "body", "created_at"), "dataset_meta": ("platform", "standardizer_name"),
}
KEYS = {
    "communities": ("community_id", "created_at"), "accounts": ("account_id", "created_at"), "posts": ("post_id", "account_id", "created_at"), "entities": ("account_id", "community_id", "post_id", "body", "entity_type", "created_at"),
    "actions": ("originator_account_id", "originator_post_id", "target_account_id", "target_post_id", "originator_community_id", "target_community_id", "action_type", "created_at"),
    "account_enrichments": ("model_id", "account_id"), "post_enrichments": ("model_id", "post_id"), "dataset_meta": ("platform",),
}
TRIMMED = ("communities", "accounts")


@dataclass(frozen=True)
class TableLayout:
    """How a table is written: a derived week or month column, further partition columns, order inside files."""

    width: str = "week"
    partition_columns: tuple[str, ...] = ()
    sort_columns: tuple[str, ...] = ("created_at",)


LAYOUTS = {
    "communities": TableLayout("month", (), ("community_id", "created_at")), "accounts": TableLayout("month", (), ("account_id", "created_at")), "posts": TableLayout("week", (), ("account_id", "created_at")),
    "entities": TableLayout("week", ("entity_type",), ("body", "created_at")), "actions": TableLayout("week", ("action_type",), ("originator_account_id", "created_at")),
}


def columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in TABLES[table].split(", ")]


def rules(table: str) -> dict[str, Column]:
    """What makes a row invalid, by name: conditions that are true for good rows."""
    out = {f"{c} is null": F.col(c).isNotNull() for c in REQUIRED[table]}
    out |= {f"{c} is not allowed": F.col(c).isNull() | F.col(c).isin(*values) for (t, c), values in ENUMS.items() if t == table}
    out |= {f"{c} is negative": F.col(c).isNull() | (F.col(c) >= 0) for c, kind in columns(table) if c.endswith("_count") and kind == "bigint"}
    if table == "entities":
        out["no post or community"] = F.col("post_id").isNotNull() | F.col("community_id").isNotNull()
    if table == "posts":
        out["account_id is blank"] = F.col("account_id").isNull() | (F.trim("account_id") != "")
    return out
