"""Payment, course and revenue reports over the whole fixture ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.contract.account_cases import ACCOUNT, PAY_DAY
from tallybook.contract.registry import case
from tallybook.functions.text import search_rows
from tallybook.operators import courses as crs
from tallybook.operators import payments as pay
from tallybook.operators.paging import paginate
from tallybook.operators.revenue import monthly_revenue
from tallybook.sources.ledger_io import table_counts

NEWEST = "order by created_at desc, id desc"


@case(
    "ledger_row_counts",
    " union all ".join(
        f"select '{t}' as table_name, count(*) as rows from {t}"
        for t in ("users", "courses", "students", "payments", "logs")
    ),
)
def _(x):
    return table_counts(x.led)


@case(
    "payment_export",
    """select p.created_at as "Date & Time", s.first_name || ' ' || s.last_name as "Student Name", s.student_id as "Student ID",
       c.name as "Course", p.amount_paid::double as "Amount", p.payment_method as "Method",
       case when p.amount_paid >= c.price then 'paid' when p.amount_paid > 0 then 'partial' else 'unpaid' end as "Status"
from payments p join students s on s.id = p.student_id left join courses c on c.id = s.course_id""",
)
def _(x):
    return pay.export_payments(x.led)


_RAW = "select id, student_id, amount_paid::double as amount_paid, payment_method, payment_date, collected_by, notes, created_at from payments"
_QUICK = {
    "today": f"payment_date = date '{PAY_DAY}'",
    "week": f"payment_date >= date '{PAY_DAY}' - 7",
    "month": f"payment_date >= date '{PAY_DAY}' - 30",
    "cash": "payment_method = 'cash'",
}


def _quick(choice: str):
    @case(f"payments_quick_{choice}", f"{_RAW} where {_QUICK[choice]}")
    def _(x):
        return pay.filter_payments_quick(x.led.payments, choice, PAY_DAY)


for _c in _QUICK:
    _quick(_c)


@case(
    "payments_filtered",
    """select p.id, p.amount_paid::double as amount_paid, p.payment_method, p.payment_date, s.course_id
from payments p join students s on s.id = p.student_id
where p.payment_date between date '1998-01-01' and date '2000-06-15' and p.payment_method = 'bank_transfer'
  and p.amount_paid between 1000 and 50000 and s.course_id = 7""",
)
def _(x):
    rows = pay.filter_payments(
        pay.payment_lines(x.led),
        date_from="1998-01-01",
        date_to=PAY_DAY,
        method="Bank Transfer",
        min_amount=1000,
        max_amount=50000,
        course_id=7,
    )
    return rows.select("id", "amount_paid", "payment_method", "payment_date", "course_id")


@case(
    "payments_filtered_by_status",
    """, tot as (select student_id, sum(amount_paid) as paid, max(created_at) as last_at from payments group by all)
select p.id, p.amount_paid::double as amount from payments p join students s on s.id = p.student_id
join courses c on c.id = s.course_id join tot t on t.student_id = p.student_id
where p.created_at = t.last_at and t.paid >= c.price and p.payment_method = 'cash'""",
)
def _(x):
    rows = pay.payment_history(x.led).withColumnsRenamed({"method": "payment_method"})
    return pay.filter_payments(rows, status="paid", method="cash").select("id", "amount")


@case(
    "payment_row_search",
    f"""select * from ({_RAW})
where contains(lower(concat_ws(' ', payment_method, payment_date, notes)), 'cash 2000-06')""",
)
def _(x):
    return search_rows(x.led.payments, ["payment_method", "payment_date", "notes"], "CASH 2000-06")


@case(
    "collections_today",
    f"""select coalesce(sum(amount_paid), 0)::double as total_collected, count(*) as payment_count
from payments where payment_date = date '{PAY_DAY}'""",
)
def _(x):
    return pay.collections_today(x.led.payments, PAY_DAY)


@case(
    "collections_month_by_collector",
    f"""select collected_by, sum(amount_paid)::double as total_monthly_collected, count(*) as monthly_payment_count
from payments where date_trunc('month', payment_date) = date '2000-06-01' group by collected_by""",
)
def _(x):
    return pay.collections_month(x.led.payments, PAY_DAY)


@case(
    "payment_history_totals",
    f"""select count(*) as total_payments, coalesce(sum(amount_paid), 0)::double as total_amount,
       coalesce(sum(amount_paid) filter (where created_at::date = date '{PAY_DAY}'), 0)::double as todays_total,
       coalesce(sum(amount_paid) filter (where year(created_at) = 2000 and month(created_at) = 6), 0)::double as monthly_total
from payments""",
)
def _(x):
    return pay.history_totals(x.led.payments, PAY_DAY)


@case(
    "recent_payments",
    f"""select p.id, p.amount_paid::double as amount_paid, p.payment_date, p.created_at,
       s.first_name || ' ' || s.last_name as student_name, u.name as cashier_name, p.payment_method
from payments p join students s on s.id = p.student_id join users u on u.id = p.collected_by
order by p.created_at desc, p.id desc limit 5""",
)
def _(x):
    return pay.recent_payments(x.led, 5)


_STATUS = """case when p.created_at = t.last_at and t.paid >= c.price then 'paid' when t.paid > 0 then 'partial' else 'unpaid' end"""
_TOT = "tot as (select student_id, sum(amount_paid) as paid, max(created_at) as last_at from payments group by student_id)"


@case(
    "recent_payments_with_status",
    f"""select p.id, p.created_at as time, s.first_name || ' ' || s.last_name as student, p.amount_paid::double as amount,
       p.payment_method as method, {_STATUS} as status
from payments p join tot t on t.student_id = p.student_id join students s on s.id = p.student_id
join courses c on c.id = s.course_id
order by p.created_at desc, p.id desc limit 5""",
    _TOT,
)
def _(x):
    return pay.recent_payments_with_status(x.led, 5)


_HISTORY = f"""select p.id, p.created_at, s.first_name || ' ' || s.last_name as student, s.student_id as student_number,
       c.name as course, p.amount_paid::double as amount, p.payment_method as method, {_STATUS} as status, p.notes,
       u.name as collected_by
from payments p join tot t on t.student_id = p.student_id join students s on s.id = p.student_id
left join courses c on c.id = s.course_id left join users u on u.id = p.collected_by"""


@case("payment_history", _HISTORY, _TOT)
def _(x):
    return pay.payment_history(x.led)


def _history_page(page: int, size: int):
    @case(
        f"payment_history_page_{page}_of_{size}",
        f"{_HISTORY} order by p.created_at desc, p.id desc limit {size} offset {(page - 1) * size}",
        _TOT,
    )
    def _(x):
        return pay.payment_history_page(x.led, page, size)


for _p, _n in ((1, 25), (3, 25), (3, 10)):
    _history_page(_p, _n)


@case(
    "latest_payment_one",
    f"""{_RAW} qualify row_number() over (partition by student_id order by created_at desc, id desc) = 1""",
)
def _(x):
    return pay.latest_payment(x.led.payments, "one")


@case(
    "latest_payment_all_ties",
    f"""select r.* from ({_RAW}) r join (select student_id as sid, max(created_at) as top from payments group by all) m
  on m.sid = r.student_id and m.top = r.created_at""",
)
def _(x):
    return pay.latest_payment(x.led.payments, "all")


@case(
    "student_statements",
    """, listed as (
  select p.*, u.name as collector from payments p join users u on u.id = p.collected_by)
select l.student_id, s.first_name || ' ' || s.last_name as student, s.student_id as student_number, c.name as course_name,
       c.price::double as total_fee,
       row_number() over (partition by l.student_id order by l.payment_date desc, l.created_at desc, l.id desc) as line,
       l.id as payment_id, l.payment_date, l.amount_paid::double as amount_paid, l.payment_method,
       l.collector as collected_by_name,
       (c.price - sum(l.amount_paid) over (partition by l.student_id order by l.payment_date, l.created_at, l.id
                                           rows unbounded preceding))::double as balance_after,
       (sum(l.amount_paid) over (partition by l.student_id))::double as total_paid,
       (c.price - sum(l.amount_paid) over (partition by l.student_id))::double as balance
from listed l join students s on s.id = l.student_id join courses c on c.id = s.course_id""",
)
def _(x):
    return pay.student_statements(x.led)


@case(
    "payment_method_mix",
    """, b as (
  select case when lower(payment_method) = 'cash' then 'cash'
              when lower(payment_method) = 'gcash' or contains(lower(payment_method), 'maya') then 'gcash'
              when contains(lower(payment_method), 'bank') then 'bank' end as m from payments)
select k.m as method, count(b.m) as payments,
       round_even(count(b.m)::double / greatest((select count(*) from b), 1) * 100, 0)::bigint as percent
from (values ('cash'), ('gcash'), ('bank')) k(m) left join b on b.m = k.m group by k.m""",
)
def _(x):
    return pay.payment_method_mix(x.led.payments)


@case(
    "collector_activity",
    """select u.id, u.name, u.role, count(p.id) as payments, coalesce(sum(p.amount_paid), 0)::double as amount_collected,
       count(p.id) > 0 as has_payments
from users u left join payments p on p.collected_by = u.id group by u.id, u.name, u.role""",
)
def _(x):
    return pay.collector_activity(x.led)


# ---- courses ---------------------------------------------------------------


@case("active_course_options", "select id, name, price::double as price from courses where is_active")
def _(x):
    return crs.active_course_options(x.led.courses)


_CATALOG = "select id, name, price::double as price, description, is_active, created_at from courses"
_SORTS = {
    "default": "is_active desc, name, id",
    "name": "lower(name), id",
    "price": "price, id",
    "date": "created_at, id",
}


def _catalog(sort: str):
    @case(f"course_catalog_by_{sort}", f"{_CATALOG} order by {_SORTS[sort]}")
    def _(x):
        return crs.course_catalog(x.led.courses, sort).drop("updated_at")


for _c in _SORTS:
    _catalog(_c)


@case(
    "course_catalog_search",
    f"select * from ({_CATALOG}) where contains(lower(name), '#00000007')",
)
def _(x):
    return search_rows(crs.course_catalog(x.led.courses), ["name"], "#00000007").drop("updated_at")


_ENROLLED = """
enrolled as (
  select c.id, c.name, count(s.id) as n from courses c
  left join students s on s.course_id = c.id and s.is_active
  where c.is_active group by c.id, c.name)"""


@case("top_courses", "select id, name as course_name, n as enrolled_count from enrolled order by n desc, id limit 5", _ENROLLED)
def _(x):
    return crs.top_courses(x.led, 5)


@case("course_active_counts", "select id, name, n as student_count from enrolled", _ENROLLED)
def _(x):
    return crs.course_active_counts(x.led)


@case(
    "course_stats",
    """select (select sum(n)::bigint from enrolled) as total_students, (select round_even(avg(n), 1) from enrolled) as avg_students,
       (select coalesce(sum(p.amount_paid), 0)::double from payments p join students s on s.id = p.student_id
        join courses c on c.id = s.course_id where s.is_active and c.is_active) as total_revenue""",
    _ENROLLED,
)
def _(x):
    return crs.course_stats(x.led)


_ROSTER = """select course_id, course_name, id, student_id, first_name, last_name, email, course_price::double as course_price,
       total_paid::double as total_paid,
       case when total_paid >= course_price then 'Paid' when total_paid > 0 then 'Partial' else 'Unpaid' end as payment_status
from account where is_active and course_price is not null"""


@case("course_rosters", _ROSTER, ACCOUNT)
def _(x):
    return crs.course_rosters(x.led)


@case(
    "course_roster_documents",
    f""", r as (
  select *, row_number() over (partition by course_id order by last_name, first_name, id) as position from ({_ROSTER}))
select course_id, course_name, (position - 1) // 4 as part, position, id, student_id, payment_status, total_paid from r""",
    ACCOUNT,
)
def _(x):
    docs = crs.course_roster_documents(x.led, chunk=4)
    rows = docs.select("course_id", "course_name", "part", F.explode("students").alias("s"))
    return rows.select(
        "course_id", "course_name", "part", "s.position", "s.id", "s.student_id", "s.payment_status", "s.total_paid"
    )


_MONTHS = "m as (select year(payment_date) as y, month(payment_date) as mo, sum(amount_paid) as total from payments"


@case(
    "monthly_revenue_raw",
    f""", {_MONTHS} where payment_date >= date '{PAY_DAY}' - interval 12 month group by all)
select y::int as year, mo::int as month, total::double as monthly_total from m""",
)
def _(x):
    return monthly_revenue(x.led.payments, PAY_DAY, zero_fill=False)


@case(
    "monthly_revenue",
    f""", {_MONTHS} where payment_date >= date '{PAY_DAY}' - interval 12 month group by all),
spine as (select unnest(generate_series(date '1999-07-01', date '2000-06-01', interval 1 month)) as d)
select year(d)::int as year, month(d)::int as month, coalesce(total, 0)::double as monthly_total
from spine left join m on m.y = year(d) and m.mo = month(d)""",
)
def _(x):
    return monthly_revenue(x.led.payments, PAY_DAY)


@case("payment_page_by_amount", f"{_RAW} order by amount_paid desc, id limit 10 offset 10")
def _(x):
    return paginate(x.led.payments, [F.col("amount_paid").desc(), F.col("id").asc()], 2, 10)
