"""Column names, constants and the feature specification every operator takes."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values, down to ROLLING_KEY_SETS: actions, weights, thresholds, missing marks, rates and
# column names are part of the result contract and must not be tuned.
ACTIONS_FIRST_STAGE = ("read_comment", "like", "click_avatar", "forward")
ACTIONS_ALL = (
    "read_comment", "like", "click_avatar", "forward", "favorite", "comment", "follow",
)
ACTION_WEIGHTS = {
    "read_comment": 4.0,
    "like": 3.0,
    "click_avatar": 2.0,
    "forward": 1.0,
    "favorite": 1.0,
    "comment": 1.0,
    "follow": 1.0,
}
TAG_THRESHOLD = 0.6
MISSING_KEYWORDS = "-1"
MISSING_TAGS = "-1"
MISSING_WEIGHTED_TAGS = "-1 1.0"
SAMPLE_SEED = 2021
RECENT_FROM_DAY = 7
SCORE_DECIMALS = 6
VECTOR_DIM = 512
# Share of the negatives kept per action: one rate, and the two rates of the phase form.
NEGATIVE_RATE = {
    "read_comment": 0.5, "like": 0.5, "click_avatar": 0.5, "forward": 0.5,
    "comment": 0.8, "follow": 0.8, "favorite": 0.8,
}
EARLY_NEGATIVE_RATE = {
    "read_comment": 0.1, "like": 0.1, "click_avatar": 0.2, "forward": 0.2,
    "comment": 0.8, "follow": 0.8, "favorite": 0.8,
}
LATE_NEGATIVE_RATE = {
    "read_comment": 1.0, "like": 1.0, "click_avatar": 0.5, "forward": 0.5,
    "comment": 0.8, "follow": 0.8, "favorite": 0.8,
}

ITEM_ID_COLUMNS = ("authorid", "bgm_song_id", "bgm_singer_id")
ITEM_TEXT_COLUMNS = (
    "description", "ocr", "asr", "description_char", "ocr_char", "asr_char",
    "manual_keyword_list", "machine_keyword_list", "manual_tag_list", "machine_tag_list",
)
ROLLING_KEY_SETS = (("userid",), ("feedid",), ("authorid",), ("userid", "authorid"))


@dataclass(frozen=True)
class FeatureSpec:
    """What the feature operators need to know about a log.

    ``last_day`` is the scoring day; the day before it is the validation day.
    A row of day ``d`` feeds the target days ``d+1 .. d+n_day``, never its own.
    """

    user: str = "userid"
    item: str = "feedid"
    author: str = "authorid"
    day: str = "date_"
    duration: str = "videoplayseconds"
    n_day: int = 5
    first_target: int = 2
    last_day: int = 15
    actions: tuple[str, ...] = ACTIONS_ALL
    rolling_actions: tuple[str, ...] = ACTIONS_FIRST_STAGE

    @property
    def validation_day(self) -> int:
        return self.last_day - 1

    def user_columns(self) -> list[str]:
        return _stat_columns("user", ("user_action_cnt", "user_feed_cnt"), self.actions)

    def item_columns(self) -> list[str]:
        return _stat_columns("feed", ("feed_expo_cnt", "feed_user_cnt"), self.actions) + [
            "feed_play_rate", "feed_stay_rate",
        ]


def _stat_columns(prefix: str, counts: tuple[str, ...], actions: tuple[str, ...]) -> list[str]:
    return (
        list(counts)
        + [f"{prefix}_{m}_avg" for m in ("play", "stay")]
        + [f"{prefix}_{a}_sum" for a in actions]
        + [f"{prefix}_{a}_avg" for a in actions]
    )
