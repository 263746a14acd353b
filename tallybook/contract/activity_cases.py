"""Activity log, staff, rate-limit and validity queries over the whole tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tallybook.contract.registry import case
from tallybook.operators import activity as act
from tallybook.operators.rates import match_within_validity, throttle
from tallybook.sources.ledger_io import enrich_activity

NOW = "2024-01-15 12:00:00"
RETENTION_DAY = "2024-04-10"

ENTRIES = """
entries as (
  select l.id, l.user_id, l.action, l.role, l.created_at, u.name as user_name, coalesce(u.name, 'System') as shown_name
  from logs l left join users u on u.id = l.user_id)"""


@case(
    "recent_activity",
    """select l.id, l.action, l.created_at, u.name as user_name, u.role from logs l join users u on u.id = l.user_id
order by l.created_at desc, l.id desc limit 10""",
)
def _(x):
    return act.recent_activity(x.led, 10)


@case("log_entries", "select * from entries", ENTRIES)
def _(x):
    return act.log_entries(x.led)


@case("log_roles", "select distinct role from logs where role <> ''")
def _(x):
    return act.log_roles(x.led.logs)


@case(
    "log_search",
    """select * from entries where contains(lower(user_name), '0004') or contains(lower(action), '0004')
   or contains(lower(role), '0004')""",
    ENTRIES,
)
def _(x):
    return act.search_logs(act.log_entries(x.led), "0004")


_FILTERS = {
    "logs_today": (dict(period="today"), f"created_at::date = timestamp '{NOW}'::date"),
    "logs_yesterday_view": (
        dict(period="yesterday", action="view"),
        f"created_at::date = timestamp '{NOW}'::date - 1 and action = 'view'",
    ),
    "logs_week_cashier": (
        dict(period="week", role="cashier"),
        f"created_at >= timestamp '{NOW}' - interval 7 day and role = 'cashier'",
    ),
    "logs_month_login": (
        dict(period="month", action="login"),
        f"created_at >= timestamp '{NOW}' - interval 30 day and contains(lower(action), 'login')",
    ),
    "logs_action_click": (dict(action="click"), "action = 'click'"),
}


def _filter(name: str):
    options, rule = _FILTERS[name]

    @case(name, f"select * from entries where {rule}", ENTRIES)
    def _(x):
        return act.filter_logs(act.log_entries(x.led), as_of=NOW, **options)


for _n in _FILTERS:
    _filter(_n)


@case(
    "activity_stats",
    f"""select count(*) as total_logs, count(*) filter (where created_at::date = date '2024-01-15') as today_count,
       count(*) filter (where created_at >= timestamp '{NOW}' - interval 1 hour) as recent_count,
       count(distinct user_id) as unique_users,
       count(distinct user_id) filter (where created_at::date = date '2024-01-15') as unique_users_today
from logs""",
)
def _(x):
    return act.activity_stats(x.led.logs, NOW)


@case(
    "retained_logs",
    f"select * from logs where not coalesce(created_at < timestamp '{RETENTION_DAY}' - interval 90 day, false)",
)
def _(x):
    return act.retain_logs(x.led.logs, RETENTION_DAY)[0]


@case(
    "retained_logs_deleted_count",
    f"select count(*) as deleted_count from logs where created_at < timestamp '{RETENTION_DAY}' - interval 90 day",
)
def _(x):
    return act.retain_logs(x.led.logs, RETENTION_DAY)[1]


@case("cashier_directory", "select id, name, email, is_active, created_at from users where role = 'cashier'")
def _(x):
    return act.cashier_directory(x.led.users)


@case(
    "cashier_directory_inactive_search",
    """select id, name, email, is_active, created_at from users
where role = 'cashier' and not is_active and contains(lower(concat_ws(' ', name, email)), '#00000000')""",
)
def _(x):
    return act.cashier_directory(x.led.users, "inactive", "#00000000")


@case(
    "cashier_directory_counts",
    """select count(*) as total, count(*) filter (where is_active) as active, count(*) filter (where not is_active) as inactive
from users where role = 'cashier'""",
)
def _(x):
    return act.cashier_counts(x.led.users)


@case(
    "activity_append",
    """select l.id, l.user_id, l.action, coalesce(l.role, u.role, 'unknown') as role, l.created_at
from logs l left join users u on u.id = l.user_id""",
)
def _(x):
    return enrich_activity(x.led.logs, x.led.users)


# an event is allowed exactly if it is on the chain: first event, then each time
# the first event at least one gap after the last allowed one
def _throttle_sql(gap: str) -> str:
    return f"""
, ev as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events),
walk as (
  select user_id, rn, event_id, ts, ts as last_ok, true as allowed from ev where rn = 1
  union all
  select e.user_id, e.rn, e.event_id, e.ts, case when e.ts >= w.last_ok + interval {gap} then e.ts else w.last_ok end,
         e.ts >= w.last_ok + interval {gap}
  from walk w join ev e on e.user_id = w.user_id and e.rn = w.rn + 1)
select event_id, user_id, ts, allowed from walk"""


def _throttle(name: str, gap: timedelta, text: str):
    @case(name, _throttle_sql(text), recursive=True)
    def _(x):
        events = x.raw("events").select("event_id", "user_id", "ts")
        return throttle(events, "user_id", "ts", "event_id", gap)


@case("throttle_1_hour_in_blocks", _throttle_sql("1 hour"), recursive=True)
def _(x):
    """Every key with more than five events takes the way of the hot keys."""
    events = x.raw("events").select("event_id", "user_id", "ts")
    return throttle(events, "user_id", "ts", "event_id", timedelta(hours=1), fold_rows=5, blocks=8)


_throttle("throttle_60_seconds", timedelta(seconds=60), "60 second")
_throttle("throttle_1_hour", timedelta(hours=1), "1 hour")


def issues_and_attempts(events):
    """signups issue a code, purchases try one; even ids count as resends."""
    code = (F.col("event_id") % 3).cast("string")
    rows = events.select("user_id", code.alias("code"), "ts", F.col("event_id").alias("id"), "event_type")
    issues = rows.where("event_type = 'signup'").withColumn("supersedes", F.col("id") % 2 == 0)
    return issues.drop("event_type"), rows.where("event_type = 'purchase'").drop("event_type")


@case(
    "match_within_validity",
    """, iss as (select user_id, event_id % 3 as code, ts, event_id as id, event_id % 2 = 0 as resend from events where event_type = 'signup'),
att as (select user_id, event_id % 3 as code, ts, event_id as id from events where event_type = 'purchase')
select a.user_id, a.code::varchar as code, a.ts, a.id,
       (select arg_max(i.id, (i.ts, i.id)) from iss i where i.user_id = a.user_id and i.code = a.code and i.ts <= a.ts) as issue_id,
       exists (select 1 from iss i where i.user_id = a.user_id and i.code = a.code and i.ts <= a.ts
               and a.ts < i.ts + interval 1 day
               and not exists (select 1 from iss z where z.user_id = a.user_id and z.resend and z.ts <= a.ts
                               and (z.ts, z.id) > (i.ts, i.id))) as valid
from att a""",
)
def _(x):
    issues, attempts = issues_and_attempts(x.raw("events"))
    return match_within_validity(issues, attempts, ["user_id"], "code", timedelta(days=1))


@case(
    "match_with_used_codes",
    """, iss as (select user_id, event_id % 3 as code, ts, event_id as id, event_id % 2 = 0 as resend from events where event_type = 'signup'),
use as (select user_id, ts from events where event_type = 'click' and event_id % 4 = 0),
att as (select user_id, event_id % 3 as code, ts, event_id as id from events where event_type = 'purchase')
select a.user_id, a.ts, a.id,
       exists (select 1 from iss i where i.user_id = a.user_id and i.code = a.code and i.ts <= a.ts
               and a.ts < i.ts + interval 1 day
               and not exists (select 1 from iss z where z.user_id = a.user_id and z.resend and z.ts <= a.ts
                               and (z.ts, z.id) > (i.ts, i.id))
               and not exists (select 1 from use u where u.user_id = a.user_id and u.ts < a.ts and u.ts >= i.ts)) as valid
from att a""",
)
def _(x):
    events = x.raw("events")
    issues, attempts = issues_and_attempts(events)
    uses = events.where("event_type = 'click' and event_id % 4 = 0").select("user_id", "ts")
    matched = match_within_validity(issues, attempts, ["user_id"], "code", timedelta(days=1), uses=uses)
    return matched.select("user_id", "ts", "id", "valid")
