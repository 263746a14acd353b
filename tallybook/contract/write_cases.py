"""Guarded batch writes: whole tables as incoming batches, with faults planted by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.contract.registry import Inputs, case
from tallybook.operators.admission import admit_payments
from tallybook.operators.guards import cascade_deletes, guard_cashier_changes, guard_course_changes
from tallybook.operators.master import allocate_student_ids, upsert_master
from tallybook.operators.validation import check_new_students, check_staff, check_student_updates
from tallybook.plans.totals import zero

AS_OF = "2024-06-01 00:00:00"

# ---- new students: one application per order --------------------------------

_APPLICATION = {
    "seq": "o_orderkey",
    "student_id": "case o_orderkey % 20 when 5 then concat('NEW-', o_orderkey - 1) "
    "when 17 then concat('stu-', year(o_orderdate), '-', lpad(concat('', o_orderkey), "
    "cast(greatest(7, length(concat('', o_orderkey))) as int), '0')) else concat('NEW-', o_orderkey) end",
    "first_name": "o_orderpriority",
    "last_name": "concat('Order', o_orderkey)",
    "email": "case o_orderkey % 20 when 10 then concat('n', o_orderkey - 1, '@school.test') when 15 then 'no-at-sign' "
    "when 18 then concat('S', o_orderkey, '@SCHOOL.TEST') else concat('n', o_orderkey, '@school.test') end",
    "phone": "case when o_orderkey % 20 = 16 then null else concat('555-', o_orderkey) end",
    "address": "'1 Main St'",
    "course_id": "o_custkey",
    "enrollment_date": "cast(o_orderdate as date)",
}
_EDIT = {
    "seq": "o_orderkey",
    "id": "case when o_orderkey % 20 = 19 then -o_orderkey - 1 else o_orderkey end",
    "first_name": "case when o_orderkey % 20 = 8 then '' else 'Edited' end",
    "last_name": "concat('Order', o_orderkey)",
    "email": "case when o_orderkey % 20 = 3 then concat('s', o_orderkey + 1, '@school.test') "
    "when o_orderkey % 20 = 7 then 'broken@nowhere' when o_orderkey % 20 in (11, 12) "
    "then concat('shared', cast(floor(o_orderkey / 20) as bigint), '@school.test') "
    "else concat('s', o_orderkey, '@school.test') end",
    "course_id": "o_custkey",
    "enrollment_date": "cast(o_orderdate as date)",
}
_STAFF = {
    "seq": "s_suppkey",
    "id": "case when s_suppkey % 3 = 0 then null else s_suppkey end",
    "name": "case when s_suppkey % 11 = 4 then null else s_name end",
    "email": "case when s_suppkey % 7 = 1 then 'bad' when s_suppkey % 7 = 2 then concat('U', s_suppkey + 1, '@school.test') "
    "when s_suppkey % 3 = 0 then concat('fresh', cast(floor(s_suppkey / 6) as bigint), '@school.test') "
    "else concat('u', s_suppkey, '@school.test') end",
}


def _rows(x: Inputs, table: str, columns: dict[str, str]) -> DataFrame:
    return x.raw(table).selectExpr(*[f"{e} as {n}" for n, e in columns.items()])


def _cte(name: str, table: str, columns: dict[str, str]) -> str:
    return f"{name} as (select {', '.join(f'{e} as {n}' for n, e in columns.items())} from {table})"


_OK_MAIL = r"regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')"


@case(
    "check_new_students",
    f""", f as (
  select i.*, phone is null as missing,
         exists (select 1 from students s where lower(s.student_id) = lower(i.student_id)) as has_number,
         exists (select 1 from students s where lower(s.email) = lower(i.email)) as has_mail,
         not {_OK_MAIL} as bad, not exists (select 1 from courses c where c.id = i.course_id and c.is_active) as closed
  from inc i),
good as (select * from f where not (missing or has_number or has_mail or bad or closed)),
n as (select student_id as k, min(seq) as s from good group by all), m as (select email as k, min(seq) as s from good group by all)
select f.seq, f.student_id, f.email,
       case when missing then 'missing_field' when has_number or n.s < f.seq then 'student_id_exists'
            when has_mail or m.s < f.seq then 'email_exists' when bad then 'invalid_email'
            when closed then 'invalid_course' end as reason
from f left join n on n.k = f.student_id left join m on m.k = f.email""",
    _cte("inc", "orders", _APPLICATION),
)
def _(x):
    judged = check_new_students(_rows(x, "orders", _APPLICATION), x.led)
    return judged.select("seq", "student_id", "email", "reason")


@case(
    "check_student_updates",
    f""", f as (
  select i.*, not exists (select 1 from students s where s.id = i.id and s.is_active) as unknown, first_name = '' as missing,
         exists (select 1 from students s where lower(s.email) = lower(i.email) and s.id <> i.id) as has_mail,
         not {_OK_MAIL} as bad, not exists (select 1 from courses c where c.id = i.course_id and c.is_active) as closed
  from inc i),
claim as (select email as k, arg_min(id, seq) as owner, min(seq) as s from f
          where not (unknown or missing or has_mail or bad or closed) group by all)
select f.seq, f.id, f.email,
       case when unknown then 'not_found' when missing then 'missing_field'
            when has_mail or (c.s < f.seq and c.owner <> f.id) then 'email_exists' when bad then 'invalid_email'
            when closed then 'invalid_course' end as reason
from f left join claim c on c.k = f.email""",
    _cte("inc", "orders", _EDIT),
)
def _(x):
    judged = check_student_updates(_rows(x, "orders", _EDIT), x.led)
    return judged.select("seq", "id", "email", "reason")


@case(
    "check_staff",
    f""", f as (
  select i.*, name is null as missing, not {_OK_MAIL} as bad,
         exists (select 1 from users u where lower(u.email) = lower(i.email) and u.id is distinct from i.id) as has_mail
  from inc i),
claim as (select lower(email) as k, min(seq) as s from f where not (missing or bad or has_mail) group by all)
select f.seq, f.id, f.email,
       case when missing then 'missing_field' when bad then 'invalid_email'
            when has_mail or c.s < f.seq then 'email_exists' end as reason
from f left join claim c on c.k = lower(f.email)""",
    _cte("inc", "supplier", _STAFF),
)
def _(x):
    return check_staff(_rows(x, "supplier", _STAFF), x.led.users).select("seq", "id", "email", "reason")


# ---- payment admission ------------------------------------------------------

ADMISSION_WITH = """
inc as (
  select p.id, p.student_id, p.amount_paid as amount, c.price, s.id as known,
         row_number() over (partition by p.student_id order by p.created_at, p.id, p.amount_paid) as rn
  from payments p left join students s on s.id = p.student_id left join courses c on c.id = s.course_id),
seqd as (select *, row_number() over (partition by student_id order by rn) as k from inc where price > 0 and amount > 0),
walk as (
  select id, student_id, amount, k, case when amount <= price then price - amount else price end as open_after,
         case when amount <= price then 'accepted' else 'exceeds_balance' end as verdict
  from seqd where k = 1
  union all
  select q.id, q.student_id, q.amount, q.k, case when q.amount <= w.open_after then w.open_after - q.amount else w.open_after end,
         case when w.open_after <= 0 then 'already_paid' when q.amount <= w.open_after then 'accepted' else 'exceeds_balance' end
  from walk w join seqd q on q.student_id = w.student_id and q.k = w.k + 1),
judged as (
  select id, student_id, amount, verdict from walk
  union all
  select id, student_id, amount, case when amount <= 0 then 'invalid_amount' when known is null then 'unknown_student'
         when price is null then 'no_price' else 'already_paid' end
  from inc where not coalesce(price > 0 and amount > 0, false))"""


def no_payments(led):
    return led.with_tables(payments=led.payments.where("false"))


@case(
    "admit_payments",
    "select id, student_id, amount::double as amount_paid, verdict from judged",
    ADMISSION_WITH,
    recursive=True,
)
def _(x):
    judged = admit_payments(x.led.payments, no_payments(x.led))
    return judged.select("id", "student_id", "amount_paid", "verdict")


@case(
    "admit_payments_totals",
    "select verdict, count(*) as payments, sum(amount)::double as amount from judged group by verdict",
    ADMISSION_WITH,
    recursive=True,
)
def _(x):
    judged = admit_payments(x.led.payments, no_payments(x.led))
    return judged.groupBy("verdict").agg(
        F.count("*").alias("payments"), F.coalesce(F.sum("amount_paid"), zero()).alias("amount")
    )


# ---- guards and foreign keys ------------------------------------------------


@case(
    "guard_course_changes",
    """, n as (select course_id as cid, count(*) as everyone, count(*) filter (where is_active) as active from students group by all),
req as (select case when c.id % 10 = 9 then -c.id - 1 else c.id end as course_id, a.action
        from courses c cross join (values ('deactivate'), ('delete')) a(action)),
chk as (select r.*, c.id is null as unknown, case when action = 'delete' then coalesce(n.everyone, 0) else coalesce(n.active, 0) end as k
        from req r left join courses c on c.id = r.course_id left join n on n.cid = r.course_id)
select course_id, action, not unknown and k = 0 as allowed,
       case when unknown then 'not_found' when k > 0 and action = 'delete' then 'has_students'
            when k > 0 then 'has_active_students' end as reason, k as blocking_students
from chk""",
)
def _(x):
    target = F.when(F.col("id") % 10 == 9, -F.col("id") - 1).otherwise(F.col("id"))
    asked = F.explode(F.array(F.lit("deactivate"), F.lit("delete")))
    requests = x.led.courses.select(target.alias("course_id"), asked.alias("action"))
    return guard_course_changes(requests, x.led)


@case(
    "guard_cashier_changes",
    """, n as (select collected_by as uid, count(*) as k from payments group by all),
req as (select u.id as user_id, a.action, u.role, coalesce(n.k, 0) as k
        from users u left join n on n.uid = u.id cross join (values ('edit'), ('delete')) a(action))
select user_id, action, case action when 'delete' then k = 0 else role = 'cashier' end as allowed,
       case when action = 'delete' and k > 0 then 'has_payments'
            when action = 'edit' and role <> 'cashier' then 'not_a_cashier' end as reason,
       k as blocking_payments
from req""",
)
def _(x):
    asked = F.explode(F.array(F.lit("edit"), F.lit("delete")))
    return guard_cashier_changes(x.led.users.select(F.col("id").alias("user_id"), asked.alias("action")), x.led)


_PAY = "id, student_id, amount_paid::double as amount_paid, collected_by"


@case(
    "delete_students_cascade",
    f"""select {_PAY} from payments p
where not exists (select 1 from students s where s.id = p.student_id and not s.is_active)""",
)
def _(x):
    gone = x.led.students.where(~F.col("is_active")).select("id")
    return cascade_deletes(gone, x.led, "students").payments.select("id", "student_id", "amount_paid", "collected_by")


@case(
    "delete_courses_set_null",
    """select s.id, s.student_id, case when c.is_active then s.course_id end as course_id
from students s left join courses c on c.id = s.course_id""",
)
def _(x):
    gone = x.led.courses.where(~F.col("is_active")).select("id")
    return cascade_deletes(gone, x.led, "courses").students.select("id", "student_id", "course_id")


@case(
    "delete_courses_cascade",
    """, kept as (select s.id from students s left join courses c on c.id = s.course_id where coalesce(c.is_active, true))
select 'student' as kind, id from kept
union all
select 'payment', p.id from payments p
where p.student_id in (select id from kept) or p.student_id not in (select id from students)""",
)
def _(x):
    gone = x.led.courses.where(~F.col("is_active")).select("id")
    after = cascade_deletes(gone, x.led, "courses", "cascade")
    students = after.students.select(F.lit("student").alias("kind"), "id")
    return students.unionByName(after.payments.select(F.lit("payment").alias("kind"), "id"))


@case(
    "delete_users_set_null",
    """select 'payment' as kind, p.id, case when u.is_active then p.collected_by when u.id is null then p.collected_by end as user_id
from payments p left join users u on u.id = p.collected_by
union all
select 'log', l.id, case when u.is_active then l.user_id when u.id is null then l.user_id end
from logs l left join users u on u.id = l.user_id""",
)
def _(x):
    gone = x.led.users.where(~F.col("is_active")).select("id")
    after = cascade_deletes(gone, x.led, "users")
    paid = after.payments.select(F.lit("payment").alias("kind"), "id", F.col("collected_by").alias("user_id"))
    return paid.unionByName(after.logs.select(F.lit("log").alias("kind"), "id", "user_id"))


# ---- master data and keys ---------------------------------------------------

_CHANGES = """
select c_custkey * 2 as seq, c_custkey as id,
       case c_custkey % 6 when 1 then 'deactivate' when 2 then 'activate' when 3 then 'toggle' else 'update' end as action,
       case when c_custkey % 6 = 0 then concat('Renamed ', c_custkey) end as name,
       case when c_custkey % 6 = 0 then cast(100 + c_custkey % 1000 as decimal(12,2)) end as price
from customer
union all
select c_custkey * 2 + 1, case when c_custkey % 6 = 3 then c_custkey else -c_custkey - 1 end,
       case when c_custkey % 6 = 4 then 'insert' else 'toggle' end,
       case when c_custkey % 6 = 4 then concat('New ', c_custkey) end,
       case when c_custkey % 6 = 4 then cast(50 as decimal(12,2)) end
from customer where c_custkey % 6 in (4, 5) or c_custkey % 12 = 3"""

_NET = f""", ch as ({_CHANGES}),
per as (
  select id as k, bool_or(action = 'insert') as ins, arg_max(name, seq) filter (where name is not null) as new_name,
         arg_max(price, seq) filter (where price is not null) as new_price,
         bool_or(action = 'deactivate') as off, bool_or(action in ('activate', 'insert')) as on_, count(*) filter (where action = 'toggle') as flips
  from ch group by id),
res as (
  select coalesce(c.id, per.k) as id, c.id is not null as had, per.k is not null as touched, ins,
         coalesce(new_name, c.name) as name, coalesce(new_price, c.price) as price, c.description,
         case when off then false when on_ then true when flips % 2 = 1 then not c.is_active else c.is_active end as is_active,
         c.name as old_name, c.price as old_price, c.is_active as old_active, c.created_at
  from courses c full join per on per.k = c.id),
fin as (
  select *, case when not had and not ins then 'missing' when not had then 'inserted'
                 when touched and (name <> old_name or price <> old_price or is_active <> old_active) then 'updated'
                 when touched then 'unchanged' end as outcome
  from res)"""


def _upsert(x: Inputs, **how):
    changes = x.spark.sql(_CHANGES.replace("from customer", "from {customer}"), customer=x.raw("customer"))
    return upsert_master(x.led.courses, changes, "id", AS_OF, **how)


@case(
    "upsert_courses",
    f"""{_NET}
select id, name, price::double as price, description, is_active, coalesce(created_at, timestamp '{AS_OF}') as created_at,
       case when outcome in ('inserted', 'updated') then timestamp '{AS_OF}' end as updated_at
from fin where outcome is distinct from 'missing'""",
)
def _(x):
    return _upsert(x)[0]


@case(
    "upsert_courses_report_in_blocks",
    f"{_NET} select id, outcome from fin where touched",
)
def _(x):
    """Every key with two changes or more takes the way of the hot keys."""
    return _upsert(x, hot_rows=1, blocks=6)[1]


@case("upsert_courses_report", f"{_NET} select id, outcome from fin where touched")
def _(x):
    return _upsert(x)[1]


@case(
    "allocate_student_ids",
    """, top as (select cast(split_part(student_id, '-', 2) as int) as y, max(cast(split_part(student_id, '-', 3) as bigint)) as t
          from students group by all),
nth as (select o_orderkey as seq, cast(year(o_orderdate) as int) as year,
               row_number() over (partition by year(o_orderdate) order by o_orderkey) as n from orders)
select seq, year, concat('STU-', year, '-', case when length(concat('', t + n)) < 5
       then lpad(concat('', t + n), 5, '0') else concat('', t + n) end) as student_id
from nth join top on y = year""",
)
def _(x):
    new = x.raw("orders").select(F.col("o_orderkey").alias("seq"), F.year("o_orderdate").alias("year"))
    return allocate_student_ids(new, x.led.students)
