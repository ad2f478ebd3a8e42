"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

# Named subqueries; each query takes those that it needs, with what they need.
_CTE = {
    "actions": "select user_id as userid, event_type as clicktag, cast(epoch_us(ts) // 1000 as varchar) as clicktime, cast(regexp_extract(props, '[0-9]+') as bigint) as infoid, cast(ts as date) as day from events where event_type in ('click', 'view', 'error')",
    "registrations": "select c_custkey as resumeid, c_custkey as userid, case when c_custkey % 2 = 0 then '1701388800000' else '1705276800000' end as adddate from customer",
    "deliveries": "select user_id as userid, user_id as resumeid, cast(regexp_extract(props, '[0-9]+') as bigint) as positionid, cast(epoch_us(ts) // 1000 as varchar) as deliverytime, cast(ts as date) as date from events where event_type = 'purchase'",
    "downloads": "select user_id as resumeid, cast(regexp_extract(props, '[0-9]+') as bigint) as entuserid, cast(ts as date) as date from events where event_type = 'signup'",
    "resumes": "select c_custkey as resumeid, c_custkey % 10 as targetsalary, c_nationkey % 10 as nowsalary, c_nationkey % 7 as education, case when c_mktsegment = 'MACHINERY' then '-' when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then '0' else '1' end as gender from customer",
    "positions": "select p_partkey as positionid, cast(floor(p_partkey / 4) as bigint) as entid, p_size % 10 as salary, p_size % 7 as education, case when contains(p_name, 'hot') then 0 when contains(p_name, 'cold') then 1 else -1 end as g from part",
    "clicks": "select r.resumeid, a.day as date, a.clicktag, count(a.infoid) as clickcount from actions a join registrations r on a.userid = r.userid and a.clicktime >= r.adddate where a.day between date '2024-01-01' and date '2024-01-31' group by all",
    "sent": "select userid, resumeid, positionid, date from deliveries where date between date '2024-01-01' and date '2024-01-31'",
    "loaded": "select d.resumeid, d.date, w.downcount, d.entuserid from downloads d join (select resumeid, date, count(*) as downcount from downloads group by all) w on d.resumeid = w.resumeid and d.date = w.date where d.date between date '2024-01-01' and date '2024-01-31'",
    "daily_clicks": "select resumeid, date, cast(sum(clickcount) as bigint) as daily_count from clicks group by all",
    "daily_sent": "select resumeid, date, count(positionid) as daily_count from sent group by all",
    "daily_loaded": "select resumeid, date, downcount as daily_count from loaded",
    "delivery_matches": "select d.resumeid, d.date, d.positionid, cast(abs(r.targetsalary - p.salary) as double) as rp_salary, cast(abs(r.education - p.education) as double) as rp_education, cast(0 as double) as r_complete, cast(abs(r.targetsalary - r.nowsalary) as double) as rr_salary, {gender} as rp_gender from (select distinct resumeid, positionid, date from sent) d join resumes r using (resumeid) join positions p using (positionid)",
    "download_matches": "select d.resumeid, d.date, p.positionid, cast(abs(r.targetsalary - p.salary) as double) as rp_salary, cast(abs(r.education - p.education) as double) as rp_education, cast(0 as double) as r_complete, cast(abs(r.targetsalary - r.nowsalary) as double) as rr_salary, {gender} as rp_gender from (select distinct resumeid, entuserid, date from loaded) d join resumes r using (resumeid) join positions p on d.entuserid = p.entid",
    "delivery_stats": "select resumeid, date, {stats} from delivery_matches group by all",
    "download_stats": "select resumeid, date, {stats} from download_matches group by all",
    "period_clicks": "{period:daily_clicks:clicks}",
    "period_deliveries": "{period:daily_sent:deliveries}",
    "period_downloads": "{period:daily_loaded:downloads}",
    "series": "select coalesce(c.resumeid, d.resumeid, w.resumeid) as resumeid, coalesce(c.date, d.date, w.date) as date, {series} from period_clicks c full join period_deliveries d on c.resumeid = d.resumeid and c.date = d.date full join period_downloads w on coalesce(c.resumeid, d.resumeid) = w.resumeid and coalesce(c.date, d.date) = w.date",
    "spine": "select distinct resumeid, date from (select resumeid, date from clicks union all select resumeid, date from sent union all select resumeid, date from loaded union all select resumeid, date from series union all select resumeid, date from delivery_stats union all select resumeid, date from download_stats)",
    "merged": "select i.resumeid as resume_id, i.date, cast(coalesce(sum(c.clickcount), 0) as bigint) as click_count, count(d.positionid) as delivery_count, coalesce(max(w.downcount), 0) as download_count, {periods}, {features} from spine i left join clicks c on i.resumeid = c.resumeid and i.date = c.date left join sent d on i.resumeid = d.resumeid and i.date = d.date left join loaded w on i.resumeid = w.resumeid and i.date = w.date left join series s on i.resumeid = s.resumeid and i.date = s.date left join delivery_stats dv on i.resumeid = dv.resumeid and i.date = dv.date left join download_stats dl on i.resumeid = dl.resumeid and i.date = dl.date group by i.resumeid, i.date",
    "clean": "select i.resumeid as resume_id, i.date, cast(coalesce(c.n, 0) as bigint) as click_count, coalesce(d.n, 0) as delivery_count, coalesce(w.n, 0) as download_count, {clean_periods}, {clean_features} from spine i left join (select resumeid, date, sum(clickcount) as n from clicks group by all) c on i.resumeid = c.resumeid and i.date = c.date left join (select resumeid, date, count(*) as n from sent group by all) d on i.resumeid = d.resumeid and i.date = d.date left join (select resumeid, date, count(*) as n from loaded group by all) w on i.resumeid = w.resumeid and i.date = w.date left join series s on i.resumeid = s.resumeid and i.date = s.date left join delivery_stats dv on i.resumeid = dv.resumeid and i.date = dv.date left join download_stats dl on i.resumeid = dl.resumeid and i.date = dl.date",
    "active": "select distinct resumeid, date from (select resumeid, date from clicks group by all having count(*) >= 3 union all select resumeid, date from sent)",
    "horizon": "select distinct resumeid, cast(date - n as date) as date from active, (values (1), (2), (3)) k(n)",
    "labelled": "select m.*, case when h.resumeid is null then 0.0::double else 1.0::double end as label from merged m left join horizon h on m.resume_id = h.resumeid and m.date = h.date",
    "similar_ids": "select resume_id as resumeid from merged group by 1 having count(*) > 3 intersect select resumeid from delivery_matches intersect select resumeid from download_matches",
    "similar_rows": "select i.resumeid, i.date, {clean_features} from (select resumeid, date from delivery_stats union select resumeid, date from download_stats) i join similar_ids using (resumeid) left join delivery_stats dv on i.resumeid = dv.resumeid and i.date = dv.date left join download_stats dl on i.resumeid = dl.resumeid and i.date = dl.date",
    "raw_days": "select resumeid, date, cast(sum(c) as bigint) as c, cast(sum(d) as bigint) as d from (select resumeid, date, 1 as c, 0 as d from clicks union all select resumeid, date, 0, 1 from sent) group by all",
    "axis": "select date, cast(row_number() over (order by date) - 1 as bigint) as i from (select distinct date from raw_days)",
    "grid": "select r.resumeid, a.date, a.i, coalesce(x.c, 0) as c, coalesce(x.d, 0) as d, (coalesce(x.c, 0) >= 3 or coalesce(x.d, 0) > 0) as act, (coalesce(x.c, 0) > 0 or coalesce(x.d, 0) > 0) as x, (select count(*) from axis) as n from (select distinct resumeid from raw_days) r cross join axis a left join raw_days x on r.resumeid = x.resumeid and a.date = x.date",
    "past": "select resumeid, date, i, n, c, d, sum(c + d) over (partition by resumeid order by i rows between 4 preceding and current row) as total, {lags} as history, coalesce(max(cast(act as int)) over (partition by resumeid order by i rows between 4 preceding and current row), 0) = 1 as history_active, coalesce(max(cast(act as int)) over (partition by resumeid order by i rows between 1 following and 5 following), 0) as next5 from grid",
    "ahead": "select resumeid, date, i, n, {leads} as features, coalesce(max(cast(act as int)) over (partition by resumeid order by i rows between current row and 4 following), 0) as busy, coalesce(max(cast(act as int)) over (partition by resumeid order by i rows between 5 following and 7 following), 0) as later from grid",
    "spans": "select max(i) - min(i) as length, resumeid from grid where x group by resumeid",
    "span_hist": "select length, count(*) as n from spans group by length",
    "pairs": "select distinct r.resumeid, a.infoid as positionid, cast(a.clicktime as bigint) as time, 'C' as flag from actions a join registrations r using (userid) union all select distinct resumeid, positionid, cast(deliverytime as bigint), 'D' from deliveries",
    "weights": "select resumeid, positionid, cast(sum(case when flag = 'C' then 1 else 5 end) as bigint) as weight from pairs group by all",
    "rule": "select resume_id, date, cast(label as int) as label, case when (click_count >= 2 and delivery_count = 0) or delivery_count >= 2 then 1 else 0 end as prediction from labelled",
    "confusion": "select date, count(*) filter (label = 1 and prediction = 1) as tp, count(*) filter (label = 0 and prediction = 1) as fp, count(*) filter (label = 0 and prediction = 0) as tn, count(*) filter (label = 1 and prediction = 0) as fn from rule group by date",
    "prf": "select date, case when tp + fp > 0 then tp / (tp + fp) end as p, case when tp + fn > 0 then tp / (tp + fn) end as r from confusion",
    "near_day": "select a.resumeid, a.date, b.resumeid as neighbour, round({distance}, 8) as distance, row_number() over (partition by a.resumeid, a.date order by round({distance}, 8), b.resumeid) as rank from similar_rows a join similar_rows b on a.date = b.date and a.resumeid <> b.resumeid",
}

_MATCHES = ["rp_salary", "rp_education", "r_complete", "rr_salary", "rp_gender"]
_PLURAL = {"click": "clicks", "delivery": "deliveries", "download": "downloads"}
_STAT = {"max": "max({m})", "var": "var_pop({m})", "ave": "avg({m})"}


def _period(source: str, name: str) -> str:
    shifted = " union all ".join(f"select resumeid, cast(date - {k} as date) as date, daily_count from {source}" for k in range(3))
    return f"select resumeid, date, cast(sum(daily_count) as bigint) as sum_{name}, stddev_pop(daily_count) as std_{name}, max(daily_count) as max_{name} from ({shifted}) group by all having count(daily_count) = 3"


def _features(of: str) -> list[str]:
    return [of.format(a=a, s=s, m=m, side=side) for side, a in (("delivery", "dv"), ("download", "dl")) for s in _STAT for m in _MATCHES]


def _periods(of: str) -> str:
    zero = {"sum": "0", "std": "0", "max": "0"}
    return ", ".join(of.format(k=k, name=_PLURAL[p], z=zero[k]) + f" as period_{p}_{n}" for p in _PLURAL for n, k in (("count", "sum"), ("std", "std"), ("max", "max")))


_FEATURE_NAMES = ["click_count", "delivery_count", "download_count", *[f"period_{p}_{n}" for p in _PLURAL for n in ("count", "std", "max")], *_features("{side}_{s}_match_{m}")]
_FILL = {
    "gender": "case when r.gender = '-' then case when p.g = -1 then 0.0 else 0.2 * p.g - 0.1 end when p.g = -1 then -1.5 when r.gender = cast(p.g as varchar) then 1.0 else -1.0 end::double",
    "stats": ", ".join(f"{_STAT[s].format(m=m)} as {s}_{m}" for s in _STAT for m in _MATCHES),
    "series": ", ".join(f"coalesce({a}.{k}_{n}, 0) as {k}_{n}" for a, n in (("c", "clicks"), ("d", "deliveries"), ("w", "downloads")) for k in ("sum", "std", "max")),
    "periods": _periods("coalesce(max(s.{k}_{name}), {z})"),
    "clean_periods": _periods("coalesce(s.{k}_{name}, {z})"),
    "features": ", ".join(_features("coalesce(max({a}.{s}_{m}), 0) as {side}_{s}_match_{m}")),
    "clean_features": ", ".join(_features("coalesce({a}.{s}_{m}, 0) as {side}_{s}_match_{m}")),
    "lags": " || ',' || ".join(f"cast(coalesce(lag({x}, {4 - j}) over (partition by resumeid order by i), 0) as varchar)" for j in range(5) for x in "cd"),
    "leads": " || ',' || ".join(f"cast(coalesce(lead({x}, {j}) over (partition by resumeid order by i), 0) as varchar)" for j in range(5) for x in "cd"),
    "distance": " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _FEATURE_NAMES[12:]),
}

_base, _match, _late = (" + ".join(f"l.{c}" for c in names) for names in (_FEATURE_NAMES[:12], _FEATURE_NAMES[12:], _FEATURE_NAMES[13:]))
_FILL["sums"] = ", ".join(f"round({x}, 4) as sum_{tag}" for tag, x in (("b", _base), ("m", _match), ("bm", f"{_base} + {_match}"), ("bh", f"{_base} + p.total"), ("hm", f"{_late} + p.total"), ("bhm", f"{_base} + {_match} + p.total")))


def _body(name: str) -> str:
    text = _CTE[name]
    if text.startswith("{period:"):
        return _period(*text.strip("{}").split(":")[1:])
    for key, value in _FILL.items():
        text = text.replace("{" + key + "}", value)
    return text


def _needs(text: str) -> list[str]:
    import re

    return [n for n in _CTE if re.search(rf"\b(from|join|,|intersect select resumeid from)\s+\(*{n}\b", text)]


def _with(query: str) -> str:
    """The query after the named subqueries that it needs, in order."""
    wanted, todo = set(), _needs(query)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += _needs(_body(name))
    order: list[str] = []

    def place(name: str) -> None:
        if name not in order:
            for other in _needs(_body(name)):
                place(other)
            order.append(name)

    for name in sorted(wanted):
        place(name)
    recursive = "recursive " if query.startswith("@") else ""
    ctes = ", ".join(f"{n} as ({_body(n)})" for n in order)
    query = query.lstrip("@")
    if query.startswith(","):
        return f"with {recursive}{ctes}{query}"
    return f"with {recursive}{ctes} {query}" if ctes else query


def _rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


def _double(name: str) -> bool:
    return "_std" in name or "_match_" in name


_STATS = [f"{s}_{m}" for s in _STAT for m in _MATCHES]
_SERIES = ", ".join(f"{k}_{n}" if k != "std" else f"round({k}_{n}, 6) as {k}_{n}" for n in _PLURAL.values() for k in ("sum", "std", "max"))
_MERGED = "resume_id, date, " + ", ".join(f"round({c}, 6) as {c}" if _double(c) else c for c in _FEATURE_NAMES)
_PERIOD = "select resumeid, date, sum_{n}, round(std_{n}, 6) as std_{n}, max_{n} from period_{n}"

_QUERIES = {
    "sc1_delimited_log": "select clicktag, clicktime, userid, infoid from actions where infoid % 10 <> 0",
    "sc14_pair_log": "select resumeid, positionid, time, flag from pairs where positionid % 7 <> 0",
    "sk5_counters": "select count(*) as n_rows, count(distinct resume_id) as n_ids from labelled",
    "ag1_user_clicks_daily": "select resumeid, date, clicktag, clickcount from clicks",
    "jn1_click_after_register": "select r.resumeid, a.clicktag, a.clicktime, a.infoid from actions a join registrations r on a.userid = r.userid and a.clicktime >= r.adddate",
    "pf4_month_scope": "select userid, resumeid, positionid, date from deliveries where date between date '2024-01-10' and date '2024-01-19'",
    "pf1_user_deliveries": "select userid, resumeid, positionid, date from sent",
    "jn3_resume_downloads": "select resumeid, date, downcount, entuserid from loaded",
    "ag3_daily_clicks": "select * from daily_clicks",
    "ag4_daily_deliveries": "select * from daily_sent",
    "wn1_period_clicks": _PERIOD.format(n="clicks"),
    "wn1_period_deliveries": _PERIOD.format(n="deliveries"),
    "wn2_period_downloads": _PERIOD.format(n="downloads"),
    "jn6_time_series_full_outer": f"select resumeid, date, {_SERIES} from series",
    "jn10_delivery_match_rows": f"select resumeid, date, positionid, {_rounded(_MATCHES)} from delivery_matches",
    "jn11_download_match_rows": f"select resumeid, date, positionid, {_rounded(_MATCHES)} from download_matches",
    "ag12_delivery_match_stats": f"select resumeid, date, {_rounded(_STATS)} from delivery_stats",
    "ag12_download_match_stats": f"select resumeid, date, {_rounded(_STATS)} from download_stats",
    "sf12_code_distance": "select c_custkey, case when c_custkey < 100 then cast(abs(c_custkey - c_nationkey) as double) else 0.0::double end as distance, 0.0::double as text_distance from customer",
    "sf13_gender_weight": "select distinct r.gender, p.g as position, {gender} as weight from resumes r cross join positions p",
    "sf18_normalized": "select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double))) / sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 6) as total, 4.0::double as twice from embeddings",
    "so1_id_spine": "select * from spine",
    "ag6_feature_merge": f"select {_MERGED} from merged",
    "ag6_feature_merge_clean": f"select {_MERGED} from clean",
    "jn5_similar_resume_data": f"select resumeid, date, {_rounded(_FEATURE_NAMES[12:])} from similar_rows",
    "ag13_active_days": "select * from active",
    "wn3_label_horizon": "select * from horizon",
    "jn8_labeled_data": f"select {_MERGED}, label from labelled",
    "jn7_labeled_full_outer": "select case when a.resumeid is null then '0' else '1' end as activeness, m.resume_id, m.date, m.click_count, m.delivery_count from active a full join merged m on a.resumeid = m.resume_id and a.date = m.date + 1",
    "jn13_valid_ids": "select resume_id, date, label from labelled where resume_id in (select resume_id from labelled group by 1 having count(*) > 20)",
    "pf11_date_split": "select resume_id, date, label, 'train' as part from labelled where date <= date '2024-01-25' union all select resume_id, date, label, 'test' from labelled where date >= date '2024-01-25'",
    "ml28_id_index": "select resumeid, cast(dense_rank() over (order by resumeid) - 1 as bigint) as index from (select distinct resumeid from weights)",
    "jn2_click_triples": "select distinct r.resumeid, a.infoid as positionid, a.clicktime from actions a join registrations r using (userid)",
    "jn22_factor_owners": "select distinct resumeid, cast(50 as bigint) as rank from weights where resumeid in (select resume_id from labelled where date between date '2024-01-25' and date '2024-01-30')",
    "ag23_class_counts": "select count(*) filter (label = 1) as positives, count(*) filter (label = 0) as negatives, round(count(*) filter (label = 1) / nullif(count(*) filter (label = 0), 0), 6) as ratio from labelled",
    "pf14_feature_slices": "select l.resume_id as resumeid, l.date, {sums} from labelled l join past p on l.resume_id = p.resumeid and l.date = p.date where p.history_active",
    "jn15_history_vectors": "select resumeid, string_agg(cast(c as varchar), ',' order by i) as clicks, string_agg(cast(d as varchar), ',' order by i) as deliveries from grid group by resumeid",
    "wn4_history_features": "select resumeid, date, history, history_active from past",
    "wn6_history_training": "select resumeid, cast(i + 4 as int) as day, cast(later as double) as label, features from ahead where i < n - 12 and busy = 1",
    "wn7_history_test": "select resumeid, cast(i - (n - 12) as int) as day, cast(later as double) as label, features from ahead where i >= n - 12 and i < n - 7 and n >= 12 and busy = 1",
    "jn17_append_history": "select p.resumeid, p.date, l.label, false as made_up, p.history, l.click_count from labelled l join past p on l.resume_id = p.resumeid and l.date = p.date where p.history_active union all select resumeid, date, cast(next5 as double), true, history, 0 from past where history_active and resumeid not in (select resume_id from labelled)",
    "wn12_active_day_hist": "select length, count(*) as n from (select resumeid, count(*) filter (x) as length from grid group by resumeid) group by length",
    "wn10_activity_span": "select length, n from span_hist",
    "ag20_span_ratio": "select length, round(n / sum(n) over (), 6) as ratio from span_hist",
    "wn8_delta3_validation": "select count(*) filter (coalesce(again, 0) = 0) as gone, count(*) as total from (select x, max(cast(x as int)) over (partition by resumeid order by i rows between 5 preceding and 1 preceding) as before, max(cast(x as int)) over (partition by resumeid order by i rows between current row and 2 following) as pause, max(cast(x as int)) over (partition by resumeid order by i rows between 3 following and unbounded following) as again from grid) where not x and before = 1 and pause = 0",
    "wn9_continuous_runs": "@, looked as (select resumeid, i, x, coalesce(lead(x) over (partition by resumeid order by i), false) as then_x from grid), walk as (select distinct resumeid, cast(-1 as bigint) as i, cast(0 as bigint) as c, cast(null as bigint) as emit from looked union all select l.resumeid, l.i, case when l.x or (w.c > 0 and l.then_x) then w.c + 1 else 0 end, case when not l.x and w.c > 0 and not l.then_x then w.c end from walk w join looked l on l.resumeid = w.resumeid and l.i = w.i + 1) select emit as length, count(*) as n from walk where emit is not null group by emit",
    "wn11_power_sessions": "@, walk as (select distinct resumeid, cast(-1 as bigint) as i, cast(0 as bigint) as pw, cast(0 as bigint) as ln, cast(0 as bigint) as la, cast(0 as bigint) as fi, cast(null as bigint) as emit from grid union all select g.resumeid, g.i, case when g.x then w.pw + 1 when w.pw > 0 then w.pw - 1 else w.pw end, case when g.x then w.ln + 1 when w.pw > 0 then w.ln else 0 end, case when g.x then g.i else w.la end, case when g.x and w.ln = 0 then g.i else w.fi end, case when not g.x and w.pw = 0 and w.ln > 0 then w.la - w.fi + 1 end from walk w join grid g on g.resumeid = w.resumeid and g.i = w.i + 1) select length, count(*) as n from (select emit as length from walk where emit is not null union all select la - fi + 1 from walk where i = (select max(i) from axis) and ln > 0) group by length",
    "ag16_entities_per_day": "select date, count(distinct resumeid) as n, count(distinct positionid) as n_positions from sent group by date",
    "so5_click_delivery_pairs": "select * from pairs",
    "ag15_pair_weights": "select * from weights",
    "ml25_path_counts": ", e as (select 'r' || cast(resumeid as varchar) as a, 'p' || cast(positionid as varchar) as b, cast(weight as double) as w from weights union all select 'p' || cast(positionid as varchar), 'r' || cast(resumeid as varchar), cast(weight as double) from weights), v0 as (select distinct a as node, 1.0::double as v from e), " + ", ".join(f"v{k} as (select e.b as node, sum(e.w * v.v) as v from e join v{k - 1} v on e.a = v.node group by e.b)" for k in range(1, 9)) + " select node, round(ln(v), 6) as log_paths from v8",
    "jn24_knn_in_day": "select resumeid, date, neighbour, distance, rank from near_day where rank <= 3",
    "jn18_neighbour_features": "select k.resumeid, k.date, " + ", ".join(f"max(case when rank = {n} then m.{c} end) as n{n}_{c}" for n in (1, 2, 3) for c in ("click_count", "delivery_count")) + " from near_day k left join merged m on k.neighbour = m.resume_id and k.date = m.date where k.rank <= 3 group by k.resumeid, k.date",
    "ag21_confusion_by_date": "select * from confusion",
    "ag22_prf_by_date": "select date, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) end, 6) as f1 from prf",
    "ml26_auc_by_date": "select date, round(case when tp + fn > 0 and tn + fp > 0 then (tp / (tp + fn) + tn / (tn + fp)) / 2 end, 6) as auc from confusion",
    "ml2_oversample": "select resume_id, date, 1 - label as label, cast(k.n as int) as copy from labelled l, range(1, 1000) k(n) where k.n <= case when label = 0 then (select greatest(1, floor(count(*) filter (label = 1) / count(*) filter (label = 0))) from labelled) else 1 end",
    "ml3_class_weights": "select resume_id, date, label, round(case when label = 1 then (select count(*) filter (label = 0) / count(*) from labelled) else (select count(*) filter (label = 1) / count(*) from labelled) end, 6) as weight from labelled",
    "ml16_time_weights": "select resume_id, date, label, round(exp(-0.1 * ((select max(dayofyear(date)) from labelled) - dayofyear(date))), 6) as weight from labelled",
}
_NEAR = (
    ", u as (select vec_id, list_transform(embedding, lambda x: cast(x as double) / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * cast(y as double))))) as v from embeddings), "
    "d as (select a.vec_id as id, b.vec_id as neighbour, 2 - 2 * list_dot_product(a.v, b.v) as distance from u a cross join u b) "
    "select {columns} from (select *, row_number() over (partition by id order by distance, neighbour) as rank from d) where rank <= {k}"
)
_NEAR_COLUMNS = "id, rank, neighbour, abs(round(distance, 6)) as distance"
_QUERIES |= {
    "jn23_knn_top_m": _NEAR.format(columns=_NEAR_COLUMNS, k=100),
    "sk6_neighbour_lines": _NEAR.format(columns=_NEAR_COLUMNS, k=20),
    "sc15_factor_text": _NEAR.format(columns=_NEAR_COLUMNS, k=3),
}

# Raw lines: which rows of the tables become lines that a layout accepts, and with what texts.
_ADDED = "case when {k} % 2 = 0 then '1701388800000' else '1705276800000' end"
_RESUME_ID = "case when c_custkey % 19 = 0 then '-' else cast(c_custkey as varchar) end as resumeid, cast(c_custkey as varchar) as userid"
_GENDER = "case when c_mktsegment = 'MACHINERY' then '-' when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then '0' else '1' end as gender"
_TEXTS = lambda **columns: ", ".join(f"cast({x} as varchar) as {c}" for c, x in columns.items())
_RESUMES = f"select {_RESUME_ID}, {_TEXTS(nowposition='c_mktsegment', targetcategory='c_nationkey')}, 'p' as targetposition, {_TEXTS(targetsalary='c_custkey % 10', education='c_nationkey % 7')}, {_GENDER}, {_TEXTS(jobstate='c_custkey % 3', areaid='c_nationkey', complete='c_custkey % 100', nowsalary='c_nationkey % 10')} from customer where c_custkey % 17 <> 0 and c_custkey % 13 <> 0 and c_custkey % 11 <> 0"
_REGISTERED = f"select {_RESUME_ID}, {_ADDED.format(k='c_custkey')} as adddate from customer where c_custkey % 17 <> 0"
_POSITION = f"select case when p_partkey % 23 = 0 then '-' else cast(p_partkey as varchar) end as infoid, {_ADDED.format(k='p_partkey')} as adddate, p_brand as cate1, p_type as cate2, 'c' as cate3, p_name as title"
_SLOT = "cast(regexp_extract(props, '[0-9]+') as bigint)"
_QUERIES |= {
    "sc2_registration_log": _REGISTERED,
    "sc3_position_log": f"{_POSITION}, {_TEXTS(entid='p_partkey // 4', salary='p_size % 10', education='p_size % 7', experience='p_size')}, 'm' as trade from part where p_partkey % 9 <> 0",
    "sc4_resume_log": _RESUMES,
    "sc5_several_folders": f"{_REGISTERED} and c_custkey % 4 <> 2",
    "sc6_download_log": f"select cast({_SLOT} as varchar) as entuserid, cast({_SLOT} // 4 as varchar) as entid, cast(user_id as varchar) as resumeuserid, cast(user_id as varchar) as resumeid, strftime(ts, '%Y-%m-%d %H:%M:%S') as downtime from events where event_type = 'signup' and {_SLOT} % 8 <> 0",
    "sc7_delivery_log": f"select 'c' as cookieid, cast({_SLOT} as varchar) as infoid, cast({_SLOT} // 4 as varchar) as entuserid, cast(user_id as varchar) as resumeid, cast(user_id as varchar) as resumeuserid, cast(epoch_us(ts) // 1000 as varchar) as deliverytime, cast({_SLOT} % 5 as varchar) as slot from events where event_type = 'purchase' and {_SLOT} % 6 <> 0",
    "sc8_position_count_log": f"{_POSITION}, case when p_partkey % 3 = 0 then '1705276800000' else '1701388800000' end as postdate from part where p_partkey % 9 <> 0",
    "sc10_parquet_glob": "select resumeid, date, clicktag, clickcount from clicks where date between date '2024-01-10' and date '2024-01-19'",
    "sc11_labelled_text": "select cast(resume_id as varchar) as id, case when bad then -1 else cast(strftime(date, '%Y%m%d') as int) end as date, case when bad then 0.0 else label end as label, case when bad then '0,0,0,0' else concat_ws(',', click_count, delivery_count, download_count) end as features from (select *, resume_id % 7 = 0 or resume_id % 11 = 0 as bad from labelled)",
    "sc12_history_text": _QUERIES["jn15_history_vectors"],
    "sc13_similar_index": "select cast(resumeid as varchar) as resumeid, strftime(date, '%Y%m%d') as date, " + ", ".join(f"cast(max(case when rank = {n} then neighbour end) as varchar) as n{n}" for n in (1, 2, 3)) + " from near_day where rank <= 3 group by near_day.resumeid, near_day.date having count(*) = 3",
    "sk1_by_date": _QUERIES["ag1_user_clicks_daily"],
    "sk2_single_file": f"select c_custkey as resumeid, {_TEXTS(targetsalary='c_custkey % 10', nowsalary='c_nationkey % 10', r_education='c_nationkey % 7')}, {_GENDER}, {_TEXTS(complete='c_custkey % 100')} from customer",
    "sk3_parquet": _QUERIES["pf1_user_deliveries"],
    "sk4_lines": "select resumeid, positionid, time, flag from pairs",
    "pf2_present_resumes": f"{_RESUMES} and c_custkey % 19 <> 0",
    "pf3_present_gender": f"select c_custkey as resumeid, {_GENDER} from customer where c_mktsegment <> 'MACHINERY'",
    "pf7_digit_texts": "select c_custkey, c_custkey % 4 < 2 as digits, c_custkey % 4 = 0 as day from customer",
    "pf8_posted_when_added": "select p_partkey as infoid, case when p_partkey % 2 = 0 then date '2023-12-01' else date '2024-01-15' end as date from part where p_partkey % 9 <> 0 and p_partkey % 23 <> 0 and (p_partkey % 2 = 0) = (p_partkey % 3 <> 0)",
    "pf16_test_window": "select resume_id, date, label from labelled where date between date '2024-01-25' and date '2024-01-30'",
    "sf2_epoch_suffix": "select resumeid, positionid, deliverytime, substr(deliverytime, 10) as suffix from deliveries",
    "jn19_inner_neighbours": _QUERIES["jn18_neighbour_features"].replace("left join merged", "join merged") + " having count(*) = 3",
    "jn20_resume_dates": "select resumeid, date from grid",
    "ml1_undersample": "select l.resume_id, l.date, l.label from (select resume_id, date, 1 - label as label from labelled) l, (select least(1.0, count(*) filter (label = 0) / count(*) filter (label = 1)) as rate from labelled) r where l.label = 1 or cast('0x' || substr(md5(concat_ws('|', l.resume_id, l.date, '11')), 1, 8) as bigint) / 4294967296 < r.rate",
}


def _final(text: str) -> str:
    for key, value in _FILL.items():
        text = text.replace("{" + key + "}", value)
    return text


ORACLES = {name: _with(_final(text)).replace("with ,", "with ", 1) for name, text in _QUERIES.items()}
