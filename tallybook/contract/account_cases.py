"""Account reports over the whole fixture ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.contract.registry import case
from tallybook.operators import accounts as acc
from tallybook.operators import dashboard as dash
from tallybook.operators.paging import page_meta, paginate, paginate_keyset

PAY_DAY = "2000-06-15"

# every student with course columns and the payment total, by joining first
ACCOUNT = """
account as (
  select s.*, c.name as course_name, c.price as course_price, c.is_active as course_active,
         coalesce(t.paid, 0) as total_paid
  from students s
  left join courses c on c.id = s.course_id
  left join (select student_id as sid, sum(amount_paid) as paid from payments group by all) t on t.sid = s.id
)"""

FANOUT = """
fanout as (
  select s.id, any_value(c.price) as price, any_value(c.is_active) as course_active,
         coalesce(sum(p.amount_paid), 0) as paid
  from students s
  inner join courses c on c.id = s.course_id
  left join payments p on p.student_id = s.id
  where s.is_active
  group by s.id
)"""


def _breakdown_sql(scope: str) -> str:
    keep = "where course_active" if scope == "admin" else ""
    return f"""
, tagged as (select case when paid >= price then 'fully_paid' when paid > 0 then 'partially_paid' else 'unpaid' end as st
             from fanout {keep})
select k.st as payment_status, count(t.st) as students,
       round_even(count(t.st)::double / greatest((select count(*) from tagged), 1) * 100, 1) as percent
from (values ('fully_paid'), ('partially_paid'), ('unpaid')) k(st)
left join tagged t on t.st = k.st
group by k.st"""


@case("payment_status_breakdown_admin", _breakdown_sql("admin"), FANOUT)
def _(x):
    return dash.payment_status_breakdown(x.led, "admin")


@case("payment_status_breakdown_cashier", _breakdown_sql("cashier"), FANOUT)
def _(x):
    return dash.payment_status_breakdown(x.led, "cashier")


@case(
    "admin_kpis",
    """select (select count(*) from students where is_active) as total_students,
       (select count(*) from courses where is_active) as total_courses,
       (select coalesce(sum(amount_paid), 0)::double from payments) as total_payments,
       (select count(*) from users where is_active and role = 'cashier') as total_active_cashiers""",
)
def _(x):
    return dash.admin_kpis(x.led)


@case(
    "system_stats",
    f"""select (select count(*) from students where is_active) as total_students,
       (select count(*) from courses where is_active) as total_courses,
       (select count(*) from users where is_active) as total_users,
       (select count(*) from payments where payment_date >= date '{PAY_DAY}' - 30) as recent_payments,
       (select count(*) from logs) as total_logs""",
)
def _(x):
    return dash.system_stats(x.led, PAY_DAY)


_LIST = """select id, student_id, first_name, last_name, email, course_id, enrollment_date, is_active, created_at,
       course_name, course_price::double as course_price, total_paid::double as total_paid
from account"""


def _list(df):
    return df.drop("phone", "address")


@case("student_accounts", _LIST, ACCOUNT)
def _(x):
    return _list(acc.student_accounts(x.led))


@case("student_accounts_inactive", f"{_LIST} where not is_active", ACCOUNT)
def _(x):
    students = acc.filter_student_state(x.led.students, "inactive")
    return _list(acc.student_accounts(x.led.with_tables(students=students)))


@case(
    "student_search_admin",
    f"""{_LIST} where is_active
  and (contains(lower(student_id), 'urgent') or contains(lower(first_name || ' ' || last_name), 'urgent')
       or contains(lower(email), 'urgent'))""",
    ACCOUNT,
)
def _(x):
    students = acc.search_students(acc.filter_student_state(x.led.students), "Urgent", "admin")
    return _list(acc.student_accounts(x.led.with_tables(students=students)))


@case(
    "student_search_cashier",
    """select id, student_id from students
where is_active and (contains(lower(first_name), 'order11') or contains(lower(last_name), 'order11')
      or contains(lower(student_id), 'order11') or contains(lower(email), 'order11'))""",
)
def _(x):
    active = acc.filter_student_state(x.led.students)
    return acc.search_students(active, "order11", "cashier").select("id", "student_id")


@case("students_of_course", f"{_LIST} where course_id = 7 and is_active", ACCOUNT)
def _(x):
    students = acc.filter_course(acc.filter_student_state(x.led.students), 7)
    return _list(acc.student_accounts(x.led.with_tables(students=students)))


_ADMIN_RULES = {
    "paid": "course_price - total_paid = 0 and course_price > 0",
    "partial": "total_paid > 0 and course_price - total_paid > 0",
    "unpaid": "total_paid = 0",
}


def _admin_list(status: str):
    @case(f"accounts_{status}_admin_list", f"{_LIST} where is_active and ({_ADMIN_RULES[status]})", ACCOUNT)
    def _(x):
        students = acc.filter_student_state(x.led.students)
        rows = acc.student_accounts(x.led.with_tables(students=students))
        return _list(acc.filter_payment_status(rows, status, "admin_list"))


for _s in _ADMIN_RULES:
    _admin_list(_s)


@case(
    "account_badges",
    """, bal as (
  select id, course_price, total_paid,
         case when coalesce(course_price, 0) <> 0 and total_paid <> 0 then course_price - total_paid
              else coalesce(course_price, 0) end as b
  from account)
select id, course_price::double as course_price, total_paid::double as total_paid,
       case when b = 0 and coalesce(course_price, 0) <> 0 then 'Fully Paid'
            when total_paid > 0 then 'Partially Paid' else 'Unpaid' end as badge
from bal""",
    ACCOUNT,
)
def _(x):
    return acc.account_badges(x.led)


@case(
    "student_stats",
    """, g as (
  select count(*) filter (where is_active) as active_students, count(*) filter (where not is_active) as inactive_students,
         count(*) as total_students, coalesce(sum(course_price) filter (where is_active), 0) as fees,
         coalesce(sum(total_paid) filter (where is_active), 0) as got
  from account)
select active_students, inactive_students, total_students, fees::double as total_fees, got::double as total_collected,
       (fees - got)::double as outstanding_balance,
       case when fees > 0 then got::double / fees::double * 100 else 0.0::double end as collection_rate
from g""",
    ACCOUNT,
)
def _(x):
    return acc.student_stats(x.led)


_OWING = "select id, student_id, course_price, total_paid, course_price - total_paid as bal from account where is_active and course_price > total_paid"


@case(
    "pending_balances",
    f"""select id, student_id, course_price::double as course_price, total_paid::double as total_paid,
       bal::double as balance from ({_OWING})""",
    ACCOUNT,
)
def _(x):
    return acc.pending_balances(x.led)


@case(
    "pending_totals",
    f"select coalesce(sum(bal), 0)::double as total_pending_amount, count(*) as pending_count from ({_OWING})",
    ACCOUNT,
)
def _(x):
    return acc.pending_totals(x.led)


_LEDGER_WITH = (
    ACCOUNT
    + """,
ranked as (
  select student_id as sid, created_at as last_at, amount_paid as last_amount,
         row_number() over (partition by student_id order by created_at desc, id desc) as rn
  from payments),
ledger as (
  select a.id, a.student_id as sid, a.first_name || ' ' || a.last_name as name, a.course_name,
         coalesce(a.course_price, 0) as fee, a.total_paid, greatest(0, coalesce(a.course_price, 0) - a.total_paid) as bal,
         r.last_at, r.last_amount, a.created_at, a.course_id,
         case when coalesce(a.course_price, 0) = 0 then 'no_billing' when a.total_paid >= a.course_price then 'paid'
              when a.total_paid > 0 then 'partial' else 'unpaid' end as status
  from account a left join ranked r on r.sid = a.id and r.rn = 1
  where a.is_active)"""
)
_LEDGER = """select id, sid, name, course_name, fee::double as total_fee, total_paid::double as total_paid,
       bal::double as balance, last_at as latest_payment_date, last_amount::double as latest_payment_amount,
       status, created_at
from ledger"""


@case("student_ledger", _LEDGER, _LEDGER_WITH)
def _(x):
    return acc.student_ledger(x.led)


def _cashier_list(status: str):
    @case(f"student_ledger_{status}", f"{_LEDGER} where status = '{status}'", _LEDGER_WITH)
    def _(x):
        return acc.student_ledger(x.led, status=status)


for _s in ("paid", "partial", "unpaid"):
    _cashier_list(_s)


@case(
    "student_ledger_filtered",
    f"{_LEDGER} where course_id = 7 and (contains(lower(name), 'low') or contains(lower(sid), 'low'))",
    _LEDGER_WITH,
)
def _(x):
    return acc.student_ledger(x.led, term="LOW", course_id=7)


@case(
    "ledger_summary",
    """select count(*) filter (where status = 'paid') as fully_paid, count(*) filter (where status = 'partial') as partially_paid,
       count(*) filter (where status = 'unpaid') as unpaid, count(*) as total_students from ledger""",
    _LEDGER_WITH,
)
def _(x):
    return acc.ledger_summary(x.led)


_BALANCES = """select id, student_id as sid, first_name || ' ' || last_name as name, course_name as course,
       course_price::double as total_due, total_paid::double as total_paid,
       (course_price - total_paid)::double as balance, is_active
from account"""


@case("account_balances", _BALANCES, ACCOUNT)
def _(x):
    return acc.account_balances(x.led)


@case("recent_students", f"{_BALANCES} where is_active order by id desc limit 5", ACCOUNT)
def _(x):
    return acc.recent_students(x.led, 5)


@case(
    "quick_search_best_match",
    f"""{_BALANCES} where contains(lower(student_id), 'high order1')
   or contains(lower(first_name || ' ' || last_name), 'high order1') order by id desc limit 1""",
    ACCOUNT,
)
def _(x):
    return acc.quick_search(x.led, "HIGH Order1")


@case(
    "payment_form_status",
    f"""select *, case when total_paid = 0 then 'unpaid' when total_paid >= total_due then 'paid' else 'partial' end as status
from ({_BALANCES}) where is_active""",
    ACCOUNT,
)
def _(x):
    return acc.payment_form(x.led, x.led.students.select("id"))


@case(
    "billing_snapshot",
    f""", due as (
  select s.id, coalesce(any_value(c.price), 0) as due, coalesce(sum(p.amount_paid), 0) as paid
  from students s left join courses c on c.id = s.course_id
  left join payments p on p.student_id = s.id and p.created_at <= timestamp '{PAY_DAY} 00:00:00'
  where s.created_at <= timestamp '{PAY_DAY} 00:00:00'
  group by s.id)
select id as student_id, '2000-1' as billing_term, due::double as total_due, (due - paid)::double as balance,
       case when due - paid <= 0 then 'paid' when paid > 0 then 'partial' else 'unpaid' end as status,
       date '{PAY_DAY}' as billing_date
from due""",
)
def _(x):
    return acc.billing_snapshot(x.led, PAY_DAY, "2000-1")


# ---- pages -----------------------------------------------------------------

_NEWEST = "order by created_at desc, id desc"


def _student_page(page: int):
    @case(
        f"student_page_{page}",
        f"{_LIST} where is_active {_NEWEST} limit 10 offset {(page - 1) * 10}",
        ACCOUNT,
    )
    def _(x):
        return _list(acc.student_account_page(x.led, page=page))


for _p in (1, 3):
    _student_page(_p)


@case(
    "student_page_partial",
    f"{_LIST} where is_active and ({_ADMIN_RULES['partial']}) {_NEWEST} limit 10 offset 20",
    ACCOUNT,
)
def _(x):
    return _list(acc.student_account_page(x.led, page=3, status="partial"))


def _meta_sql(rows: str, page: int, size: int, least: int) -> str:
    return f"""
, n as (select count(*) as total, greatest({least}, cast(ceil(count(*) / {size}.0) as bigint)) as pages from {rows})
select {page}::bigint as page, {size}::bigint as per_page, total, pages, ({page} > 1 and total > 0) as has_prev,
       ({page} < pages and total > 0) as has_next,
       case when {page} > 1 and total > 0 then {page - 1}::bigint end as prev_num,
       case when {page} < pages and total > 0 then {page + 1}::bigint end as next_num,
       case when total > 0 then {(page - 1) * size + 1}::bigint else 0::bigint end as showing_from,
       least({page * size}, total)::bigint as showing_to
from n"""


@case("student_page_meta", _meta_sql("students where is_active", 3, 10, 1))
def _(x):
    return acc.student_account_page_meta(x.led, page=3)


@case(
    "student_page_meta_partial",
    _meta_sql(f"account where is_active and {_ADMIN_RULES['partial']}", 1, 10, 1),
    ACCOUNT,
)
def _(x):
    return acc.student_account_page_meta(x.led, page=1, status="partial")


@case("log_page_meta", _meta_sql("logs", 2, 20, 0))
def _(x):
    return page_meta(x.led.logs, 2, 20, min_pages=0)


@case(
    "student_keyset_page",
    f"""select id, student_id, created_at from students where created_at < timestamp '2000-01-01'
   or (created_at = timestamp '2000-01-01' and id < 100) {_NEWEST} limit 25""",
)
def _(x):
    after = (F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), 100)
    rows = paginate_keyset(x.led.students, [("created_at", True), ("id", True)], 25, after)
    return rows.select("id", "student_id", "created_at")


@case("log_page_2", f"select id, user_id, action, role, created_at from logs {_NEWEST} limit 10 offset 10")
def _(x):
    return paginate(x.led.logs, [F.col("created_at").desc(), F.col("id").desc()], 2, 10)
