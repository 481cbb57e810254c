"""SQL twins of the registered queries, for an independent engine.

They are written from the definitions and not from the Spark plans: windows are range
joins, ranks are window functions over the rows, quantiles and samples come from a full
sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from actionloom.queries.catalog import (
    _SLOT_IDS, _TOKEN_LISTS, CURVE_ROUNDS, FOLDS, NARROWED, NUNIQUE_PAIRS, PROFILED, ROLLING_QUERIES, SCALED, SPEC,
    TIE_SHIFT, TOKEN_SIZE, TOKEN_WINDOW,
)
from actionloom.sources.bindings import ORDERS_SPEC, PREDICTION_SCALE, VECTOR_LENGTH
from actionloom.spec import (
    ACTION_WEIGHTS, ACTIONS_ALL, ACTIONS_FIRST_STAGE, EARLY_NEGATIVE_RATE, LATE_NEGATIVE_RATE,
    NEGATIVE_RATE, RECENT_FROM_DAY, SAMPLE_SEED,
)

LAST = SPEC.last_day
ACT4, ACT7 = ACTIONS_FIRST_STAGE, ACTIONS_ALL


def _q(c: str) -> str:
    return f'"{c}"'


def _r(expr: str, name: str, decimals: int = 6) -> str:
    return f"round(cast({expr} AS double) + cast({TIE_SHIFT} AS double), {decimals}) + 0.0 AS {_q(name)}"


def _ids(c: str) -> str:
    return f"list_transform(string_split({c}, ';'), lambda x: cast(x AS int))"


def _merged(manual: str, machine: str, machine_ids: str) -> str:
    return (
        f"list_sort(list_distinct(list_transform(list_concat({_ids(manual)}, {machine_ids}), lambda x: x + 1)))"
    )


_TRUSTED = (
    "list_transform(list_filter(string_split({c}, ';'), lambda x: cast(string_split(x, ' ')[2] AS double) > 0.6),"
    " lambda x: cast(string_split(x, ' ')[1] AS int))"
)


def _window_stats(key: str, other: str, prefix: str, counts: tuple[str, str], log: str = "interactions",
                  targets: str = "targets") -> str:
    parts = [
        f"count(r.{other}) AS {counts[0]}", f"count(DISTINCT r.{other}) AS {counts[1]}",
        f"avg(r.play) AS {prefix}_play_avg", f"avg(r.stay) AS {prefix}_stay_avg",
    ]
    for a in ACT7:
        parts += [f'cast(sum(r.{_q(a)}) AS bigint) AS {prefix}_{a}_sum', f'avg(r.{_q(a)}) AS {prefix}_{a}_avg']
    return (
        f"SELECT r.{key}, d.t AS date_, {', '.join(parts)} FROM {_on_target(log, targets)} "
        f"GROUP BY r.{key}, d.t"
    )


def _on_target(log: str, targets: str) -> str:
    return f"{targets} d JOIN {log} r ON r.date_ BETWEEN d.t - {SPEC.n_day} AND d.t - 1"


def _rolling(keys: Sequence[str], log: str = "watched", targets: str = "targets") -> str:
    p = f"{'_'.join(keys)}_{SPEC.n_day}day"
    parts = [f"count(*) AS {p}_count", f"avg(r.is_finish) AS {p}_finish_rate"]
    for x in ("play_times", "play", "stay"):
        parts += [f"max(r.{x}) AS {p}_{x}_max", f"avg(r.{x}) AS {p}_{x}_mean"]
    for a in ACT4:
        parts += [f"cast(sum(r.{_q(a)}) AS bigint) AS {p}_{a}_sum", f"avg(r.{_q(a)}) AS {p}_{a}_mean"]
    cols = ", ".join(f"r.{k}" for k in keys)
    known = " AND ".join(f"r.{k} IS NOT NULL" for k in keys)
    return (
        f"SELECT {cols}, d.t AS date_, {', '.join(parts)} FROM {_on_target(log, targets)} "
        f"WHERE {known} GROUP BY {cols}, d.t"
    )


def _rolling_doubles(keys: Sequence[str]) -> tuple[list[str], list[str]]:
    p = f"{'_'.join(keys)}_{SPEC.n_day}day"
    doubles = [f"{p}_finish_rate"]
    doubles += [f"{p}_{x}_{s}" for x in ("play_times", "play", "stay") for s in ("max", "mean")]
    doubles += [f"{p}_{a}_mean" for a in ACT4]
    longs = [f"{p}_count", *[f"{p}_{a}_sum" for a in ACT4]]
    return doubles, longs


def _rolling_outputs(keys: Sequence[str], alias: str = "s") -> str:
    doubles, longs = _rolling_doubles(keys)
    return ", ".join([f"{alias}.{c}" for c in longs] + [_r(f"{alias}.{c}", c) for c in doubles])


def _prediction(a: str) -> str:
    add, mod = PREDICTION_SCALE[a]
    return f"cast((event_id * 7919 + {add}) % {mod} AS double) / {mod} AS p_{a}"


_FLAGS = {
    "read_comment": "event_type = 'view'", "comment": "event_id % 11 = 0", "like": "event_type = 'click'",
    "click_avatar": "event_type = 'signup'", "forward": "event_type = 'purchase'",
    "follow": "event_id % 13 = 0", "favorite": "event_id % 17 = 0",
}
_flag = lambda a: f"cast({_FLAGS[a]} AS int) AS {_q(a)}"

CTES: dict[str, str] = {
    "interactions": (
        "SELECT event_id, user_id AS userid, cast(json_extract_string(props, '$.k') AS bigint) AS feedid, "
        "cast(datediff('day', date '2024-01-01', ts::date) + 1 AS int) AS date_, "
        "cast(event_id % 2 AS int) + 1 AS device, "
        f"{_flag('read_comment')}, {_flag('comment')}, {_flag('like')}, "
        "value * 1000 AS play, (value + event_id % 7) * 1000 AS stay, "
        f"{_flag('click_avatar')}, {_flag('forward')}, {_flag('follow')}, {_flag('favorite')} FROM events"
    ),
    "items": (
        "SELECT p_partkey AS feedid, cast(regexp_extract(p_brand, '[0-9]+') AS bigint) AS authorid, "
        "CASE WHEN p_partkey % 31 = 0 THEN cast(0 AS double) WHEN p_partkey % 19 = 0 THEN NULL "
        "ELSE cast(p_size AS double) END AS videoplayseconds, "
        "CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 23 END AS bgm_song_id, "
        "CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 11 END AS bgm_singer_id, "
        "CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 37) || ';' || (p_partkey % 17) END AS manual_keyword_list, "
        "CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 17) || ';' || p_size END AS machine_keyword_list, "
        "CASE WHEN p_partkey % 5 <> 0 THEN cast(p_partkey % 13 AS varchar) END AS manual_tag_list, "
        "CASE WHEN p_partkey % 8 <> 0 THEN (p_partkey % 13 + 1) || ' 0.6;' || (p_size % 9) || ' 0.75;' "
        "|| (p_partkey % 7) || ' 0.2' END AS machine_tag_list FROM part"
    ),
    "targets": f"SELECT unnest(range({SPEC.first_target}, {LAST + 1})) AS t",
    "train": f"SELECT * FROM interactions WHERE date_ < {LAST}",
    "scoring": f"SELECT event_id, userid, feedid, device FROM interactions WHERE date_ = {LAST}",
    "all_rows": (
        "SELECT * FROM train UNION ALL BY NAME "
        f"SELECT *, {LAST} AS date_ FROM scoring"
    ),
    "watched": (
        "SELECT t.*, i.authorid, i.bgm_song_id, i.videoplayseconds * 1000 AS videoplayseconds, "
        "cast(coalesce(t.play >= i.videoplayseconds * 1000, false) AS int) AS is_finish, "
        "t.play / nullif(i.videoplayseconds * 1000, 0) AS play_times "
        "FROM train t LEFT JOIN items i USING (feedid)"
    ),
    "item_lists": (
        "SELECT feedid, "
        + _merged("coalesce(manual_keyword_list, '-1')", "", _ids("coalesce(machine_keyword_list, '-1')"))
        + " AS feed_keyword_list, "
        + _merged("coalesce(manual_tag_list, '-1')", "", _TRUSTED.format(c="coalesce(machine_tag_list, '-1 1.0')"))
        + " AS feed_tag_list FROM items"
    ),
    "acted": (
        "SELECT DISTINCT t.userid, t.feedid FROM train t WHERE "
        + " OR ".join(f"t.{_q(a)} <> 0" for a in ACT7)
    ),
    "user_tag_rows": (
        "SELECT DISTINCT a.userid, unnest(l.feed_tag_list) AS token FROM acted a JOIN item_lists l USING (feedid)"
    ),
    "user_keyword_rows": (
        "SELECT DISTINCT a.userid, unnest(l.feed_keyword_list) AS token FROM acted a JOIN item_lists l USING (feedid)"
    ),
    "user_lists": (
        "SELECT u.userid, coalesce(g.v, []) AS user_tag_list, coalesce(k.v, []) AS user_keyword_list "
        "FROM (SELECT DISTINCT userid FROM train) u "
        "LEFT JOIN (SELECT userid, list(token ORDER BY token) AS v FROM user_tag_rows GROUP BY userid) g USING (userid) "
        "LEFT JOIN (SELECT userid, list(token ORDER BY token) AS v FROM user_keyword_rows GROUP BY userid) k USING (userid)"
    ),
    "user_stats": _window_stats("userid", "feedid", "user", ("user_action_cnt", "user_feed_cnt")),
    "item_stats": (
        "SELECT s.*, s.feed_play_avg / 1000 / nullif(i.videoplayseconds, 0) AS feed_play_rate, "
        "s.feed_stay_avg / 1000 / nullif(i.videoplayseconds, 0) AS feed_stay_rate FROM ("
        + _window_stats("feedid", "userid", "feed", ("feed_expo_cnt", "feed_user_cnt"))
        + ") s LEFT JOIN items i USING (feedid)"
    ),
    "predictions": f"SELECT *, {', '.join(_prediction(a) for a in ACT7)} FROM interactions",
    "with_items": (
        "SELECT r.event_id, r.userid, r.feedid, i.authorid, i.videoplayseconds * 1000 AS videoplayseconds "
        "FROM all_rows r LEFT JOIN items i USING (feedid)"
    ),
    "vectors": (
        "SELECT vec_id AS feedid, list_transform(embedding, lambda x: "
        "cast(cast(round(cast(x AS double) * 1000) AS int) AS double)) AS embedding FROM embeddings"
    ),
    "order_log": (
        "SELECT o_custkey AS userid, l_partkey AS feedid, l_suppkey AS authorid, "
        "cast(datediff('day', date '1995-01-01', o_orderdate::date) + 1 AS int) AS date_, "
        "l_quantity * 1000 AS play, (l_quantity + l_linenumber) * 1000 AS stay, "
        "cast(l_returnflag = 'R' AS int) AS read_comment, cast(l_returnflag = 'A' AS int) AS \"like\", "
        "cast(l_linestatus = 'O' AS int) AS click_avatar, cast(l_linenumber = 1 AS int) AS forward, "
        "cast(l_linenumber = 2 AS int) AS favorite, cast(l_linenumber = 3 AS int) AS comment, "
        "cast(l_linenumber = 4 AS int) AS follow, l_discount AS p_like, l_tax AS p_click_avatar "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    ),
    "order_targets": f"SELECT unnest(range({ORDERS_SPEC.first_target}, {ORDERS_SPEC.last_day + 1})) AS t",
    "watched_orders": (
        "SELECT t.*, cast(coalesce(t.play >= p_size * 1000, false) AS int) AS is_finish, "
        "t.play / nullif(cast(p_size AS double) * 1000, 0) AS play_times "
        "FROM order_log t LEFT JOIN part ON p_partkey = t.feedid"
    ),
    "slim": "SELECT feedid, authorid, videoplayseconds, bgm_song_id, bgm_singer_id FROM items",
}
_NEEDS = {
    "train": ["interactions"], "scoring": ["interactions"], "all_rows": ["train", "scoring"],
    "watched": ["train", "items"], "item_lists": ["items"], "acted": ["train"],
    "user_tag_rows": ["acted", "item_lists"], "user_keyword_rows": ["acted", "item_lists"],
    "user_lists": ["train", "user_tag_rows", "user_keyword_rows"], "user_stats": ["interactions", "targets"],
    "item_stats": ["interactions", "targets", "items"], "predictions": ["interactions"],
    "with_items": ["all_rows", "items"], "slim": ["items"],
    "watched_orders": ["order_log"],
}


def _sql(needs: Sequence[str], body: str, extra: str = "") -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for n in _NEEDS.get(name, []):
            visit(n)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        visit(n)
    ctes = [f"{n} AS ({CTES[n]})" for n in ordered] + ([extra] if extra else [])
    return f"WITH {', '.join(ctes)} {body}"


_LOG_COLUMNS = (
    "event_id, userid, feedid, date_, device, read_comment, comment, \"like\", play, stay, click_avatar, "
    "forward, follow, favorite"
)
_ROW = "event_id, userid, feedid, date_"
_text = lambda c, alias=None: f"array_to_string({c}, ',') AS {alias or c}"
_list_sum = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: cast(x AS double))), 0)"


def _user_outputs(alias: str, fill: bool = False) -> str:
    f = (lambda c: f"coalesce({c}, 0)") if fill else (lambda c: c)
    longs = ["user_action_cnt", "user_feed_cnt", *[f"user_{a}_sum" for a in ACT7]]
    doubles = ["user_play_avg", "user_stay_avg", *[f"user_{a}_avg" for a in ACT7]]
    return ", ".join([f"{f(f'{alias}.{c}')} AS {c}" for c in longs] + [_r(f(f"{alias}.{c}"), c) for c in doubles])


def _item_outputs(alias: str, fill: bool = False) -> str:
    f = (lambda c: f"coalesce({c}, 0)") if fill else (lambda c: c)
    longs = ["feed_expo_cnt", "feed_user_cnt", *[f"feed_{a}_sum" for a in ACT7]]
    doubles = ["feed_play_avg", "feed_stay_avg", *[f"feed_{a}_avg" for a in ACT7], "feed_play_rate", "feed_stay_rate"]
    return ", ".join([f"{f(f'{alias}.{c}')} AS {c}" for c in longs] + [_r(f(f"{alias}.{c}"), c) for c in doubles])


def _assembled(rows: str, columns: Sequence[str], fill: bool = False) -> str:
    own = ", ".join(
        _r(f"r.{_q(c)}", c) if c in ("play", "stay") else f"r.{_q(c)}" for c in columns
    )
    if fill:
        item = (
            "cast(coalesce(i.authorid + 1, 0) AS bigint) AS authorid, "
            + _r("ln(coalesce(i.videoplayseconds, 0) + 1)", "videoplayseconds")
            + ", cast(coalesce(i.bgm_song_id + 1, 0) AS bigint) AS bgm_song_id"
            ", cast(coalesce(i.bgm_singer_id + 1, 0) AS bigint) AS bgm_singer_id"
        )
    else:
        item = f"i.authorid, {_r('i.videoplayseconds', 'videoplayseconds')}, i.bgm_song_id, i.bgm_singer_id"
    return (
        f"SELECT {own}, {item}, {_user_outputs('u', fill)}, {_item_outputs('f', fill)} FROM {rows} r "
        "LEFT JOIN slim i ON i.feedid = r.feedid "
        "LEFT JOIN user_stats u ON u.userid = r.userid AND u.date_ = r.date_ "
        "LEFT JOIN item_stats f ON f.feedid = r.feedid AND f.date_ = r.date_"
    )


_LOG = ["event_id", "userid", "feedid", "date_", "device", "read_comment", "comment", "like", "play", "stay",
        "click_avatar", "forward", "follow", "favorite"]


def _long(source: str, actions: Sequence[str], label: str, score: str) -> str:
    return " UNION ALL ".join(
        f"SELECT userid, '{a}' AS action, {label.format(a=a)} AS label, {score.format(a=a)} AS score FROM {source}"
        for a in actions
    )


def _auc_ctes(long: str) -> str:
    return (
        f"long AS ({long}), ranked AS (SELECT *, "
        "rank() OVER (PARTITION BY userid, action ORDER BY score) "
        "+ (count(*) OVER (PARTITION BY userid, action, score) - 1) / cast(2 AS double) AS rk FROM long), "
        "per_user AS (SELECT userid, action, cast(sum(label) AS bigint) AS n_pos, "
        "cast(count(*) - sum(label) AS bigint) AS n_neg, "
        "sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS won FROM ranked GROUP BY userid, action), "
        "aucs AS (SELECT userid, action, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN "
        "(won - n_pos * (n_pos + 1) / cast(2 AS double)) / (cast(n_pos AS double) * n_neg) END AS auc FROM per_user)"
    )


_PREDICTED = lambda actions: _auc_ctes(_long("predictions", actions, '"{a}"', "p_{a}"))


def _weights(actions: Sequence[str]) -> str:
    rows = ", ".join(f"('{a}', cast({ACTION_WEIGHTS[a]} AS double))" for a in actions)
    return f"weights(action, w) AS (VALUES {rows})"


def _verdict(ret: int, message: str | None, actions: Sequence[str] = ACT4) -> str:
    nothing = ", ".join(f"cast(NULL AS double) AS uauc_{a}" for a in actions)
    text = "NULL" if message is None else message
    return f"{ret} AS ret, cast({text} AS varchar) AS err_msg, cast(NULL AS double) AS score, {nothing}"


def _scored(actions: Sequence[str]) -> str:
    pairs = (
        "pairs AS (SELECT userid, feedid, "
        + ", ".join(f"max({_q(a)}) AS {_q(a)}, max(p_{a}) AS p_{a}" for a in actions)
        + " FROM predictions GROUP BY userid, feedid), "
    )
    means = "means AS (SELECT action, avg(auc) AS uauc FROM aucs GROUP BY action)"
    details = ", ".join(
        f"round(max(CASE WHEN action = '{a}' THEN uauc END), 6) AS uauc_{a}" for a in actions
    )
    extra = f"{pairs}{_auc_ctes(_long('pairs', actions, '{a}'.join(chr(34) * 2), 'p_{a}'))}, {means}, {_weights(actions)}"
    return _sql(
        ["predictions"],
        "SELECT 0 AS ret, cast(NULL AS varchar) AS err_msg, round(sum(w * uauc) / sum(w), 6) AS score, "
        f"{details} FROM means JOIN weights USING (action)",
        extra,
    )


_hash = f"md5('{SAMPLE_SEED}:' || event_id)"


def _sample(label: str, partition: str, rate: str) -> str:
    return (
        f"SELECT {_ROW}, {_q(label)} FROM train WHERE {_q(label)} = 1 UNION ALL "
        f"SELECT {_ROW}, {_q(label)} FROM (SELECT *, row_number() OVER ({partition} ORDER BY {_hash}) AS rn, "
        f"count(*) OVER ({partition}) AS n FROM train WHERE {_q(label)} = 0) WHERE rn <= round_even({rate} * n, 0)"
    )


def _profile() -> str:
    parts = []
    for c in [*PROFILED, "userid", "feedid"]:
        distinct = f"count(DISTINCT {c})" if c in ("userid", "feedid") else "cast(NULL AS bigint)"
        x = f"cast({_q(c)} AS double)"
        stats = [("avg", "mean"), ("stddev_samp", "std"), ("min", "min")]
        cols = [_r(f"{f}({x})", name, 4) for f, name in stats]
        cols += [_r(f"quantile_cont({x}, {p})", name, 4) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
        cols.append(_r(f"max({x})", "max", 4))
        parts.append(
            f"SELECT '{c}' AS \"column\", count({_q(c)}) AS \"count\", {', '.join(cols)}, {distinct} AS n_distinct "
            "FROM interactions"
        )
    return " UNION ALL ".join(parts)


def _narrow() -> str:
    fractional = {"videoplayseconds", "play"}
    parts = []
    for c in NARROWED:
        as_float = f"max(abs({c})) < 3.4028234663852886e38"
        # Fractional columns, and integers with missing values, go to a float.
        float_total = f"sum(cast(cast({c} AS real) AS double))"
        plain_total = f"sum(cast({c} AS double))"
        if c in fractional:
            dtype = f"CASE WHEN {as_float} THEN 'float' ELSE 'double' END"
            total = f"CASE WHEN {as_float} THEN {float_total} ELSE {plain_total} END"
        else:
            gaps = f"count({c}) < count(*)"
            within = lambda lo, hi: f"min({c}) > {lo} AND max({c}) < {hi}"
            dtype = (
                f"CASE WHEN {gaps} THEN CASE WHEN {as_float} THEN 'float' ELSE 'double' END "
                f"WHEN {within(-128, 127)} THEN 'tinyint' WHEN {within(-32768, 32767)} THEN 'smallint' "
                f"WHEN {within(-2147483648, 2147483647)} THEN 'int' ELSE 'bigint' END"
            )
            total = f"CASE WHEN {gaps} AND {as_float} THEN {float_total} ELSE {plain_total} END"
        parts.append(f"SELECT '{c}' AS column_name, {dtype} AS dtype, {_r(total, 'total', 2)} FROM watched")
    return " UNION ALL ".join(parts)


def _nunique(source: str) -> str:
    joins, cols = "", []
    for i, (v, g) in enumerate(NUNIQUE_PAIRS):
        name = f"{v}_in_{g}_nunique"
        joins += (
            f" LEFT JOIN (SELECT {g}, count(DISTINCT {v}) AS {name} FROM with_items WHERE {g} IS NOT NULL"
            f" GROUP BY {g}) n{i} ON n{i}.{g} = {source}.{g}"
        )
        cols.append(f"n{i}.{name}")
    return joins, ", ".join(cols)


def _counts(source: str) -> tuple[str, str]:
    joins, cols = "", []
    for k in ("userid", "feedid", "authorid"):
        joins += (
            f" LEFT JOIN (SELECT {k}, count(*) AS {k}_count FROM with_items WHERE {k} IS NOT NULL"
            f" GROUP BY {k}) c_{k} ON c_{k}.{k} = {source}.{k}"
        )
        cols.append(f"c_{k}.{k}_count")
    return joins, ", ".join(cols)


def _affinity(source: str) -> tuple[str, str]:
    joins = (
        f" LEFT JOIN (SELECT userid, authorid, count(*) AS c FROM with_items WHERE authorid IS NOT NULL"
        f" GROUP BY userid, authorid) p ON p.userid = {source}.userid AND p.authorid = {source}.authorid"
    )
    cols = (
        "p.c AS userid_authorid_count, "
        + _r("p.c / (cast(c_authorid.authorid_count AS double) + 1)", "userid_in_authorid_count_prop") + ", "
        + _r("p.c / (cast(c_userid.userid_count AS double) + 1)", "authorid_in_userid_count_prop")
    )
    return joins, cols


def _means(source: str) -> tuple[str, str]:
    joins, cols = "", []
    for k in ("userid", "authorid"):
        joins += (
            f" LEFT JOIN (SELECT {k}, avg(videoplayseconds) AS m FROM with_items WHERE {k} IS NOT NULL"
            f" GROUP BY {k}) m_{k} ON m_{k}.{k} = {source}.{k}"
        )
        cols.append(_r(f"m_{k}.m", f"videoplayseconds_in_{k}_mean"))
    return joins, ", ".join(cols)


_BASE = "w.event_id, w.userid, w.feedid, w.authorid, " + _r("w.videoplayseconds", "videoplayseconds")
_BASE_PLAIN = "w.event_id, w.userid, w.feedid, w.authorid, w.videoplayseconds"


def _summaries(alias: str, column: str, prefix: str, fill: bool, compat: bool = False) -> str:
    total, v = _list_sum(f"{alias}.{column}"), f"{alias}.{column}"
    average = f"({total}) / nullif(len({v}), 0)"
    largest = f"cast(list_max({v}) AS double)"
    whole = f"({total}) + ({average}) + {largest}" if compat else f"CASE WHEN {v} IS NULL THEN NULL ELSE {total} END"
    f = (lambda c: f"coalesce({c}, 0)") if fill else (lambda c: c)
    return ", ".join([_r(f(average), f"{prefix}_avg"), _r(f(largest), f"{prefix}_max"), _r(f(whole), f"{prefix}_sum")])


def _side_tables() -> str:
    rows = (
        "r.event_id, r.userid, r.feedid, r.date_, coalesce(i.authorid, 0) AS authorid, "
        + _r("coalesce(i.videoplayseconds, 0)", "videoplayseconds")
        + ", coalesce(i.bgm_song_id, 0) AS bgm_song_id, coalesce(i.bgm_singer_id, 0) AS bgm_singer_id"
    )
    cols = [
        _summaries("v", "embedding", "feed_embed", True), _summaries("l", "feed_tag_list", "feed_tags", True),
        _summaries("l", "feed_keyword_list", "feed_kws", True), _summaries("u", "user_tag_list", "user_tags", True),
        _summaries("u", "user_keyword_list", "user_kws", True),
    ]
    return (
        f"SELECT {rows}, {', '.join(cols)} FROM interactions r LEFT JOIN slim i ON i.feedid = r.feedid "
        "LEFT JOIN vectors v ON v.feedid = r.feedid LEFT JOIN item_lists l ON l.feedid = r.feedid "
        "LEFT JOIN user_lists u ON u.userid = r.userid"
    )


def _attach_rolling() -> tuple[str, str]:
    from actionloom.spec import ROLLING_KEY_SETS

    ctes, joins, cols = [], "", []
    for i, keys in enumerate(ROLLING_KEY_SETS):
        ctes.append(f"s{i} AS ({_rolling(keys)})")
        on = " AND ".join(f"s{i}.{k} = w.{k}" for k in keys)
        joins += f" LEFT JOIN s{i} ON {on} AND s{i}.date_ = w.date_"
        cols.append(_rolling_outputs(keys, f"s{i}"))
    body = f"SELECT w.event_id, w.userid, w.feedid, w.authorid, w.date_, {', '.join(cols)} FROM watched w{joins}"
    return ", ".join(ctes), body


def _scaled(kind: str) -> str:
    stats, cols = [], ["event_id"]
    for c in SCALED:
        if kind == "robust":
            stats += [f"quantile_cont({c}, {p}) AS {c}_{n}" for p, n in ((0.25, "a"), (0.5, "b"), (0.75, "c"))]
            width = f"{c}_c - {c}_a"
            cols.append(_r(f"({c} - {c}_b) / CASE WHEN {width} = 0 THEN 1 ELSE {width} END", c))
        else:
            stats += [f"min({c}) AS {c}_a", f"quantile_cont({c}, 0.8) AS {c}_c"]
            width = f"{c}_c - {c}_a"
            capped = f"CASE WHEN {c} IS NOT NULL THEN least({c}, {c}_c) END"
            cols.append(_r(f"({capped} - {c}_a) / CASE WHEN {width} = 0 THEN 1 ELSE {width} END", c))
    return f"SELECT {', '.join(cols)} FROM watched, (SELECT {', '.join(stats)} FROM watched)"


def _vocab() -> str:
    lists = [("feed_keyword_list", "item_lists"), ("feed_tag_list", "item_lists")]
    ids = [(c, "items") for c in ("feedid", "authorid", "bgm_song_id", "bgm_singer_id")]
    ids += [(c, "interactions") for c in ("userid", "device")]
    parts = [
        f"SELECT '{c}' AS \"column\", cast(max(x) + 1 AS bigint) AS bound, count(DISTINCT x) AS n_distinct "
        f"FROM (SELECT unnest({c}) AS x FROM {s})" for c, s in lists
    ] + [
        f"SELECT '{c}' AS \"column\", cast(max({c}) + 1 AS bigint) AS bound, count(DISTINCT {c}) AS n_distinct "
        f"FROM {s}" for c, s in ids
    ]
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    counts, count_cols = _counts("w")
    nunique, nunique_cols = _nunique("w")
    affinity, affinity_cols = _affinity("w")
    means, mean_cols = _means("w")
    rolling_ctes, rolling_body = _attach_rolling()
    n_pairs = "(SELECT count(*) FROM (SELECT DISTINCT userid, feedid FROM interactions))"
    n_extra = "(SELECT count(*) FROM (SELECT DISTINCT userid, feedid FROM interactions WHERE userid = 1))"
    unequal = f"'the result has ' || ({n_pairs} + {n_extra}) || ' rows, the label set ' || {n_pairs}"
    out = {
        "scan_interactions": _sql(["interactions"], f"SELECT {_LOG_COLUMNS} FROM interactions"),
        "scan_items": _sql(["items"], "SELECT * FROM items"),
        "profile_interactions": _sql(["interactions"], _profile()),
        "submission_format": _sql(
            ["predictions"],
            "SELECT userid, feedid, "
            + ", ".join(f"printf('%.6f', max(p_{a})) AS {_q(a)}" for a in ACT4)
            + " FROM predictions GROUP BY userid, feedid",
        ),
        "split_by_day": _sql(
            ["interactions"],
            f"SELECT {_ROW}, CASE WHEN date_ < {LAST - 1} THEN 'train' ELSE 'validation' END AS part "
            f"FROM interactions WHERE date_ <= {LAST - 1}",
        ),
        "engaged_rows": _sql(
            ["interactions"],
            f"SELECT {_ROW} FROM interactions WHERE " + " OR ".join(f"{_q(a)} <> 0" for a in ACT7),
        ),
        "union_train_scoring": _sql(["all_rows"], f"SELECT {_LOG_COLUMNS} FROM all_rows"),
        "split_by_label_presence": _sql(
            ["all_rows"],
            f"SELECT {_ROW}, read_comment, CASE WHEN read_comment IS NULL THEN 'unknown' ELSE 'known' END AS part "
            "FROM all_rows",
        ),
        "split_by_tag": _sql(
            ["train", "scoring"],
            "SELECT 'train' AS part, userid, count(*) AS n, count(play) AS n_play FROM train GROUP BY userid "
            "UNION ALL SELECT 'score', userid, count(*), 0 FROM scoring GROUP BY userid",
        ),
        "recent_days": _sql(["train"], f"SELECT {_ROW} FROM train WHERE date_ >= {RECENT_FROM_DAY}"),
        "item_keyword_list": _sql(["item_lists"], f"SELECT feedid, {_text('feed_keyword_list')} FROM item_lists"),
        "item_tag_list": _sql(["item_lists"], f"SELECT feedid, {_text('feed_tag_list')} FROM item_lists"),
        "item_token_lists": _sql(
            ["item_lists"],
            f"SELECT feedid, {_text('feed_keyword_list')}, {_text('feed_tag_list')} FROM item_lists",
        ),
        "user_token_lists": _sql(
            ["user_lists"],
            f"SELECT userid, {_text('user_tag_list')}, {_text('user_keyword_list')} FROM user_lists",
        ),
        "vocab_sizes": _sql(["item_lists", "items", "interactions"], _vocab()),
        "tag_multihot": _sql(
            ["user_lists"],
            "SELECT u.userid, string_agg(cast(cast(list_contains(u.user_tag_list, v.token) AS int) AS varchar), ' ' "
            "ORDER BY v.token) AS user_tags_encode_list FROM user_lists u, "
            "(SELECT DISTINCT unnest(user_tag_list) AS token FROM user_lists) v GROUP BY u.userid",
        ),
        "user_window_stats": _sql(
            ["user_stats"], f"SELECT s.userid, s.date_, {_user_outputs('s')} FROM user_stats s"
        ),
        "item_window_stats": _sql(
            ["item_stats"], f"SELECT s.feedid, s.date_, {_item_outputs('s')} FROM item_stats s"
        ),
        "rolling_stats_rangeframe": _sql(
            ["watched", "targets", "interactions"],
            f"SELECT s.userid, s.date_, {_rolling_outputs(['userid'])} FROM ({_rolling(['userid'])}) s "
            "SEMI JOIN watched a ON a.userid = s.userid AND a.date_ = s.date_",
        ),
        "attach_rolling": _sql(["watched", "targets"], rolling_body, rolling_ctes),
        "watch_signals": _sql(
            ["watched"],
            f"SELECT event_id, {_r('videoplayseconds', 'videoplayseconds')}, is_finish, "
            f"{_r('play_times', 'play_times')} FROM watched",
        ),
        "global_counts": _sql(["with_items"], f"SELECT {_BASE_PLAIN}, {count_cols} FROM with_items w{counts}"),
        "global_nunique": _sql(["with_items"], f"SELECT {_BASE_PLAIN}, {nunique_cols} FROM with_items w{nunique}"),
        "pair_affinity": _sql(
            ["with_items"], f"SELECT {_BASE}, {affinity_cols} FROM with_items w{counts}{affinity}"
        ),
        "global_duration_means": _sql(["with_items"], f"SELECT {_BASE}, {mean_cols} FROM with_items w{means}"),
        "global_profile": _sql(
            ["with_items"],
            f"SELECT {_BASE}, {count_cols}, {nunique_cols}, {affinity_cols}, {mean_cols} "
            f"FROM with_items w{counts}{nunique}{affinity}{means}",
        ),
        "assemble_training": _sql(["train", "slim", "user_stats", "item_stats"], _assembled("train", _LOG)),
        "assemble_scoring": _sql(
            ["scoring", "slim", "user_stats", "item_stats"],
            _assembled(
                f"(SELECT *, {LAST} AS date_ FROM scoring)", ["event_id", "userid", "feedid", "device", "date_"]
            ),
        ),
        "impute_features": _sql(["train", "slim", "user_stats", "item_stats"], _assembled("train", _LOG, True)),
        "validation_features": _sql(
            ["train", "slim", "user_stats", "item_stats"],
            _assembled(f"(SELECT * FROM interactions WHERE date_ = {LAST - 1})", _LOG, True),
        ),
        "assemble_embeddings": _sql(
            ["interactions", "slim", "vectors", "user_lists"],
            f"SELECT r.event_id, r.userid, r.feedid, r.date_, i.authorid, "
            f"{_r('i.videoplayseconds', 'videoplayseconds')}, array_to_string(list_transform(v.embedding, "
            "lambda x: cast(cast(x AS int) AS varchar)), ' ') AS embedding, "
            f"{_text('u.user_tag_list', 'user_tag_list')} FROM interactions r "
            "LEFT JOIN slim i ON i.feedid = r.feedid LEFT JOIN vectors v ON v.feedid = r.feedid "
            "LEFT JOIN user_lists u ON u.userid = r.userid",
        ),
        "assemble_side_tables": _sql(
            ["interactions", "slim", "vectors", "item_lists", "user_lists"], _side_tables()
        ),
        "parse_embedding": _sql(
            ["vectors"],
            f"SELECT feedid, {VECTOR_LENGTH} AS width, array_to_string(list_transform(embedding, "
            "lambda x: cast(cast(x AS int) AS varchar)), ' ') AS embedding FROM vectors",
        ),
        "vector_summary": f"SELECT vec_id, {_summaries('e', 'embedding', 'v', False)} FROM embeddings e",
        "vector_summary_compat": f"SELECT vec_id, {_summaries('e', 'embedding', 'v', False, True)} FROM embeddings e",
        "label_encode_numeric": _sql(
            ["with_items"],
            "SELECT event_id, "
            + ", ".join(
                f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_code" for c in ("userid", "feedid", "authorid")
            )
            + " FROM with_items",
        ),
        "label_encode_string": _sql(
            ["all_rows", "items"],
            "SELECT r.event_id, dense_rank() OVER (ORDER BY cast(r.userid AS varchar)) - 1 AS userid_code, "
            "dense_rank() OVER (ORDER BY coalesce(cast(i.bgm_song_id AS varchar), 'nan')) - 1 AS bgm_song_id_code "
            "FROM all_rows r LEFT JOIN items i USING (feedid)",
        ),
        "robust_scale": _sql(["watched"], _scaled("robust")),
        "winsor_minmax": _sql(["watched"], _scaled("winsor")),
        "narrow_types": _sql(["watched"], _narrow()),
        "class_balance": _sql(
            ["train"],
            " UNION ALL ".join(
                f"SELECT '{a}' AS action, count_if({_q(a)} = 1) AS positives, count_if({_q(a)} = 0) AS negatives, "
                f"{_r(f'avg({_q(a)})', 'positive_rate')} FROM train"
                for a in ACT7
            ),
        ),
        "neg_sample_exact": _sql(
            ["train"], _sample("like", "", f"cast({NEGATIVE_RATE['like']} AS double)")
        ),
        "neg_sample_phase": _sql(
            ["train"],
            _sample(
                "click_avatar", f"PARTITION BY date_ >= {RECENT_FROM_DAY}",
                f"CASE WHEN date_ >= {RECENT_FROM_DAY} THEN cast({LATE_NEGATIVE_RATE['click_avatar']} AS double) "
                f"ELSE cast({EARLY_NEGATIVE_RATE['click_avatar']} AS double) END",
            ),
        ),
        "neg_sample_stratified": _sql(
            ["train"],
            _sample("like", "PARTITION BY userid, date_", f"cast({NEGATIVE_RATE['like']} AS double)"),
        ),
        "kfold_assign": _sql(
            ["train"],
            f"SELECT event_id, cast(CASE WHEN rn < (n % {FOLDS}) * (n // {FOLDS} + 1) THEN rn // (n // {FOLDS} + 1) "
            f"ELSE n % {FOLDS} + (rn - (n % {FOLDS}) * (n // {FOLDS} + 1)) // (n // {FOLDS}) END AS int) AS fold "
            f"FROM (SELECT event_id, row_number() OVER (ORDER BY {_hash}) - 1 AS rn, count(*) OVER () AS n FROM train)",
        ),
        "dedup_keep_last": _sql(
            ["interactions"],
            f"SELECT {_LOG_COLUMNS} FROM interactions QUALIFY row_number() OVER "
            "(PARTITION BY userid, feedid, \"like\" ORDER BY date_ DESC, event_id DESC) = 1",
        ),
        "user_prediction_rank": _sql(
            ["predictions"],
            "SELECT event_id, userid, "
            + ", ".join(
                f"rank() OVER (PARTITION BY userid ORDER BY p_{a}) + (count(*) OVER (PARTITION BY userid, p_{a}) - 1) "
                f"/ cast(2 AS double) AS rank_{a}"
                for a in ("read_comment", "forward")
            )
            + " FROM predictions",
        ),
        "user_auc": _sql(
            ["predictions"],
            f"SELECT userid, action, n_pos, n_neg, {_r('auc', 'auc')} FROM aucs", _PREDICTED(ACT7),
        ),
        "uauc_by_action": _sql(
            ["predictions"],
            f"SELECT action, count(auc) AS users, {_r('avg(auc)', 'uauc')} FROM aucs GROUP BY action",
            _PREDICTED(ACT7),
        ),
        "uauc_unrounded": _sql(
            ["predictions"],
            f"SELECT action, count(auc) AS users, {_r('avg(auc)', 'uauc')} FROM aucs GROUP BY action",
            _PREDICTED(ACT4),
        ),
        "weighted_uauc": _sql(
            ["predictions"],
            "SELECT round(sum(w * uauc) / sum(w), 6) AS score FROM (SELECT action, avg(auc) AS uauc FROM aucs "
            "GROUP BY action) JOIN weights USING (action)",
            f"{_PREDICTED(ACT4)}, {_weights(ACT4)}",
        ),
        "weighted_uauc_incomplete": _sql(
            ["predictions"],
            "SELECT CASE WHEN count(uauc) = count(*) THEN round(sum(w * uauc) / sum(w), 6) END AS score FROM weights "
            "LEFT JOIN (SELECT action, avg(auc) AS uauc FROM aucs GROUP BY action) USING (action)",
            _auc_ctes(_long("(SELECT * FROM predictions WHERE forward = 0)", ACT4, '"{a}"', "p_{a}"))
            + f", {_weights(ACT4)}",
        ),
        "validate_sources": " UNION ALL ".join(
            f"SELECT '{name}' AS name, true AS present, '{absent}' AS missing_columns, count(*) AS row_count FROM {name}"
            for name, absent in (("events", ""), ("part", ""), ("embeddings", ""), ("lineitem", "l_finish_rate"))
        ) + " UNION ALL SELECT 'side_table', false, 'userid', 0",
        "score_submission": _scored(ACT4),
        "score_submission_all_actions": _scored(ACT7),
        "score_submission_bad_rows": _sql(["interactions"], f"SELECT {_verdict(1, unequal)}"),
        "score_submission_missing_cols": f"SELECT {_verdict(2, repr('columns missing in the result: like, forward'))}",
        "score_submission_bad_keys": f"SELECT {_verdict(3, repr('userid-feedid pairs differ from the label set'))}",
        "score_submission_bad_values": f"SELECT {_verdict(4, repr('a label or prediction is missing or not a number'))}",
        "ensemble_mean": _sql(
            ["predictions"],
            "SELECT userid, feedid, "
            + ", ".join(_r(f"(max(p_{a}) + min(p_{a}) + avg(p_{a})) / 3", a) for a in ACT4)
            + " FROM predictions GROUP BY userid, feedid",
        ),
    }
    order_users = _window_stats(
        "userid", "feedid", "user", ("user_action_cnt", "user_feed_cnt"), "order_log", "order_targets")
    order_items = _window_stats(
        "feedid", "userid", "feed", ("feed_expo_cnt", "feed_user_cnt"), "order_log", "order_targets")
    out |= {
        "orders_user_window_stats": _sql(
            ["order_log", "order_targets"], f"SELECT s.userid, s.date_, {_user_outputs('s')} FROM ({order_users}) s"
        ),
        "orders_item_window_stats": _sql(
            ["order_log", "order_targets"],
            f"SELECT s.feedid, s.date_, {_item_outputs('s')} FROM (SELECT x.*, "
            "x.feed_play_avg / 1000 / nullif(p_size, 0) AS feed_play_rate, "
            "x.feed_stay_avg / 1000 / nullif(p_size, 0) AS feed_stay_rate "
            f"FROM ({order_items}) x LEFT JOIN part ON p_partkey = x.feedid) s",
        ),
        "orders_rolling_stats_author": _sql(
            ["watched_orders", "order_targets"],
            f"SELECT s.authorid, s.date_, {_rolling_outputs(['authorid'])} "
            f"FROM ({_rolling(['authorid'], 'watched_orders', 'order_targets')}) s",
        ),
        "orders_pair_affinity": _sql(
            ["order_log"],
            "SELECT authorid, "
            + _r("sum(pair / cast(n_author + 1 AS double))", "user_share") + ", "
            + _r("sum(pair / cast(n_user + 1 AS double))", "author_share")
            + ", count(*) AS n FROM (SELECT authorid, count(*) OVER (PARTITION BY userid, authorid) AS pair, "
            "count(*) OVER (PARTITION BY userid) AS n_user, count(*) OVER (PARTITION BY authorid) AS n_author "
            "FROM order_log) GROUP BY authorid",
        ),
        "orders_user_auc": _sql(
            ["order_log"], f"SELECT userid, action, n_pos, n_neg, {_r('auc', 'auc')} FROM aucs",
            _auc_ctes(_long("order_log", ["like", "click_avatar"], '"{a}"', "p_{a}")),
        ),
    }
    for name, keys in ROLLING_QUERIES.items():
        cols = ", ".join(f"s.{k}" for k in keys)
        out[name] = _sql(
            ["watched", "targets"],
            f"SELECT {cols}, s.date_, {_rolling_outputs(keys)} FROM ({_rolling(keys)}) s",
        )
    # Built day by day or at once, the statistics are the same.
    out["incremental_user_window_stats"] = out["user_window_stats"]
    out["incremental_item_window_stats"] = out["item_window_stats"]
    out["incremental_rolling_stats_author"] = out["rolling_stats_author"]
    out["rolling_stats_as_of"] = (
        out["rolling_stats_user_author"]
        + " SEMI JOIN watched a ON a.userid = s.userid AND a.authorid = s.authorid AND a.date_ = s.date_")
    out["gbt_prefix_uauc"] = _sql(
        ["watched"],
        f"SELECT cast(t AS int) AS trees, users, true AS signal, true AS in_range FROM range(1, {CURVE_ROUNDS + 1}) r(t), ("
        "SELECT count(*) AS users FROM (SELECT userid FROM watched "
        f"WHERE date_ = {LAST - 1} GROUP BY userid HAVING min(is_finish) = 0 AND max(is_finish) = 1))")
    out["tag_multihot_sparse"] = _sql(
        ["user_lists"],
        "SELECT userid, (SELECT count(DISTINCT token) FROM (SELECT unnest(user_tag_list) AS token FROM user_lists))::INT "
        "AS width, coalesce(array_to_string(list_sort((SELECT list(code) FROM codes WHERE list_contains(user_tag_list, token))), "
        "','), '') AS indices FROM user_lists",
        "codes AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM "
        "(SELECT DISTINCT unnest(user_tag_list) AS token FROM user_lists))")
    sources = {c: "item_lists" if c.startswith("feed") else "user_lists" for c in _TOKEN_LISTS}
    met = " UNION ALL ".join(
        f"SELECT '{c}' AS list, l.{c}[i] AS a, l.{c}[j] AS b FROM {s} l, range(1, len(l.{c}) + 1) x(i), "
        f"range(i + 1, least(i + {TOKEN_WINDOW}, len(l.{c})) + 1) y(j)" for c, s in sources.items())
    out["token_ppmi"] = _sql(
        ["item_lists", "user_lists"],
        f"SELECT n.list, n.a AS token_a, n.b AS token_b, {_r('ln(n.n * w.n / (x.n * cast(y.n AS double)))', 'ppmi')} FROM pairs n "
        "JOIN totals x ON x.list = n.list AND x.a = n.a JOIN totals y ON y.list = n.list AND y.a = n.b "
        "JOIN wholes w ON w.list = n.list WHERE ln(n.n * w.n / (x.n * cast(y.n AS double))) > 0",
        f"met AS ({met}), pairs AS (SELECT list, a, b, cast(count(*) AS double) AS n FROM "
        "(SELECT list, a, b FROM met UNION ALL SELECT list, b, a FROM met) GROUP BY ALL), "
        "totals AS (SELECT list, a, sum(n) AS n FROM pairs GROUP BY ALL), wholes AS (SELECT list, sum(n) AS n FROM pairs GROUP BY ALL)")
    out["token_embeddings"] = _sql(
        ["item_lists", "user_lists"],
        f"SELECT DISTINCT list, token, {TOKEN_SIZE} AS width, true AS finite FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS list, unnest({c}) AS token FROM {s}" for c, s in sources.items()) + ")")
    out["approx_user_window_items"] = _sql(
        ["user_stats"], "SELECT userid, date_, user_feed_cnt, true AS close FROM user_stats")
    counts_of = " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS \"column\", count(DISTINCT {c}) AS ids FROM train LEFT JOIN "
        "(SELECT feedid, authorid, bgm_song_id, bgm_singer_id FROM items) USING (feedid)" for i, c in enumerate(_SLOT_IDS))
    out["id_slots"] = _sql(
        ["train", "items"],
        "SELECT \"column\", cast(coalesce(sum(ids + 1) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
        f"AS int) AS first, cast(ids AS int) AS ids FROM ({counts_of})")
    out["embedding_pca_moments"] = _sql(
        ["vectors"],
        "SELECT cast(p AS int) AS place, n, true AS centred, true AS fits, "
        + _r("whole", "whole_variance", 3)
        + ", true AS falling FROM range(32) r(p), (SELECT count(*) AS n FROM vectors), "
        "(SELECT sum(v) AS whole FROM (SELECT var_samp(x) AS v FROM (SELECT unnest(embedding) AS x, "
        "generate_subscripts(embedding, 1) AS i FROM vectors) GROUP BY i))")
    out["offline_submission_score"] = _sql(
        ["train"],
        "SELECT 0 AS ret, cast(NULL AS varchar) AS err_msg, true AS scored, count(*) AS pairs, true AS probabilities "
        f"FROM (SELECT DISTINCT userid, feedid FROM train WHERE date_ = {LAST - 1})")
    out["submission_roundtrip"] = _sql(
        ["predictions"],
        "SELECT userid, feedid, "
        + ", ".join(f"cast(printf('%.6f', max(p_{a})) AS double) AS {_q(a)}" for a in ACT4)
        + " FROM predictions GROUP BY userid, feedid")
    return out
