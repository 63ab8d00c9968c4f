"""Column names shared by the whole package."""

from __future__ import annotations

# Names found in the input files and in the survival data set.
SINCE = "yelping_since"
COMPLIMENTS = (
    "compliment_hot",
    "compliment_more",
    "compliment_profile",
    "compliment_cute",
    "compliment_list",
    "compliment_note",
    "compliment_plain",
    "compliment_cool",
    "compliment_funny",
    "compliment_writer",
    "compliment_photos",
)
VOTES = ("useful_per_review", "funny_per_review", "cool_per_review")
SURVIVAL_COLUMNS = (
    "user_id",
    "join_date",
    "last_post",
    "tenure_years",
    "friend_count",
    "friends_per_year",
    "total_compliments",
    "compliments_per_year",
    "total_votes_received",
    "avg_votes_per_review",
    "votes_per_year",
    "ever_elite",
    "years_elite",
    "survival_time",
    "churned",
)
RAW_FEATURES = (
    "friend_count",
    "friends_per_year",
    "total_compliments",
    "compliments_per_year",
    "total_votes_received",
    "avg_votes_per_review",
    "votes_per_year",
    "years_elite",
    "survival_time",
    "tenure_years",
)
LOG_OF = {
    "log_friend_count": "friend_count",
    "log_friends_per_year": "friends_per_year",
    "log_total_compliments": "total_compliments",
    "log_compliments_per_year": "compliments_per_year",
    "log_total_votes": "total_votes_received",
    "log_avg_votes_per_review": "avg_votes_per_review",
    "log_votes_per_year": "votes_per_year",
    "log_years_elite": "years_elite",
}
NOT_PREDICTORS = ("user_id", "survival_time", "churned", "join_date", "last_post")
SNAPSHOT_VARIABLES = (
    "friend_count",
    "log_friend_count",
    "friends_per_year",
    "log_friends_per_year",
    "total_votes_received",
    "log_total_votes",
    "avg_votes_per_review",
    "log_avg_votes_per_review",
    "votes_per_year",
    "log_votes_per_year",
    "total_compliments",
    "log_total_compliments",
    "compliments_per_year",
    "log_compliments_per_year",
    "elite_compl_int",
    "tenure_friend_int",
)


def predictors(columns: list[str]) -> list[str]:
    """All model inputs of an engineered frame, in frame order."""
    return [c for c in columns if c not in NOT_PREDICTORS]


def core_predictors(columns: list[str]) -> list[str]:
    """Model inputs that do not rest on a later snapshot of the user."""
    return [c for c in predictors(columns) if c not in SNAPSHOT_VARIABLES]
