"""Calendar, holiday and business-day queries (C*, H*, J05, J06)."""

from pyspark.sql import functions as F

from tabforge.catalogue.registry import query, table
from tabforge.functions import calendar as cal


def _sql_nth(month: int, n: int, k: int) -> str:
    first = f"make_date(y, {month}, 1)"
    return f"{first} + ((({k} - dayofweek({first}) + 7) % 7) + {7 * (n - 1)})::int"


def _sql_fixed(month: int, day: int, saturday: int = 0, sunday: int = 0) -> str:
    d = f"make_date(y, {month}, {day})"
    return f"{d} + (case dayofweek({d}) when 6 then {saturday} when 0 then {sunday} else 0 end)::int"


def holiday_sql(years: str) -> str:
    """CTE list ending in hol(y, name, holiday); ``years`` is a query with one column y."""
    names = {
        "New Year''s Day": _sql_fixed(1, 1, sunday=1),
        "MLK Day": _sql_nth(1, 3, 1),
        "Valentine''s Day": _sql_fixed(2, 14),
        "President''s Day": _sql_nth(2, 3, 1),
        "St. Patrick''s Day": _sql_fixed(3, 17),
        "Good Friday": "easter - 2",
        "Easter": "easter",
        "Cinco de Mayo": _sql_fixed(5, 5),
        "Mother''s Day": _sql_nth(5, 2, 0),
        "Memorial Day": "make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::int",
        "Father''s Day": _sql_nth(6, 3, 0),
        "Independence Day": _sql_fixed(7, 4, -1, 1),
        "Labor Day": _sql_nth(9, 1, 1),
        "Halloween": _sql_fixed(10, 31),
        "Veteran''s Day": _sql_fixed(11, 11, sunday=1),
        "Thanksgiving": _sql_nth(11, 4, 4),
        "Christmas": _sql_fixed(12, 25, -1, 1),
    }
    rows = "\n union all ".join(f"select y, '{n}' as name, ({e})::date as holiday from easters" for n, e in names.items())
    return f"""
      ys as ({years}),
      e1 as (select y, y % 19 a, y // 100 b, y % 100 c from ys),
      e2 as (select *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 h from e1),
      e3 as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 l from e2),
      e4 as (select *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 q from e3),
      easters as (select y, make_date(y, q // 31, q % 31 + 1) as easter from e4),
      hol as ({rows})"""


ORDER_YEARS = "select distinct year(o_orderdate)::int as y from orders"
NEAR_YEARS = f"select distinct y + d as y from ({ORDER_YEARS}) cross join (values (-1), (0), (1)) t(d)"


@query("c01_dateparts", """
select o_orderkey, year(o_orderdate)::int as year, month(o_orderdate)::int as month, day(o_orderdate)::int as day,
       (isodow(o_orderdate) - 1)::int as dayofweek
from orders""")
def c01(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", *[v.alias(k) for k, v in cal.dateparts("o_orderdate").items()])


@query("c02_timeparts", """
select event_id, hour(ts)::int as hour, minute(ts)::int as minute, second(ts)::int as second from events""")
def c02(spark, sf):
    text = table(spark, sf, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("t"))
    return text.select("event_id", *[v.alias(k) for k, v in cal.timeparts("t").items()])


_BIZDAY_SQL = f"""
with {holiday_sql(ORDER_YEARS)},
days as (select distinct o_orderdate::date as d from orders),
wk as (select d, count(*) filter (where isodow(x) <= 5) as n
       from (select d, unnest(generate_series(date_trunc('month', d)::timestamp, d::timestamp, interval 1 day)) as x from days)
       group by d),
hm as (select d, count(h.holiday) as n from days left join hol h
         on h.y = year(d) and h.holiday between date_trunc('month', d)::date and d and isodow(h.holiday) <= 5 group by d),
hw as (select d, count(h.holiday) as n from days left join hol h
         on h.y = year(d) and h.holiday between d - (isodow(d) - 1)::int and d - 1 group by d)
select o_orderkey, year(o_orderdate)::int as year, month(o_orderdate)::int as month, day(o_orderdate)::int as day,
       (isodow(o_orderdate) - 1)::int as dayofweek, (wk.n - hm.n)::int as bizdaymonth,
       (case when isodow(wk.d) <= 5 then {{week}} else 0 end)::int as bizdayweek
from orders join wk on wk.d = o_orderdate::date join hm on hm.d = wk.d join hw on hw.d = wk.d"""


@query("c03_bizday", _BIZDAY_SQL.format(week="isodow(wk.d) - hw.n"))
def c03(spark, sf):
    days = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return cal.by_day(days, "o_orderdate", cal.bizday).drop("o_orderdate")


@query("c10_biz_day_week_parity", _BIZDAY_SQL.format(week="-hw.n"))
def c10(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", *[v.alias(k) for k, v in cal.bizday("o_orderdate", parity=True).items()])


@query("c04_rdate", """
select o_orderkey, (o_orderdate::date - date '0001-01-01' + 1)::int as rdate,
       ((o_orderdate::date - date '0001-01-01' + 1) % 7)::int as rdate_mod, dayofweek(o_orderdate)::int as dow
from orders""")
def c04(spark, sf):
    d = F.col("o_orderdate")
    rdate = cal.gdate_to_rdate(F.year(d), F.month(d), F.dayofmonth(d))
    return table(spark, sf, "orders").select(
        "o_orderkey", rdate.alias("rdate"), (rdate % 7).alias("rdate_mod"), cal.day_of_week(d).alias("dow"))


@query("c05_rdate_to_gdate", """
select event_id, year(d)::int as year, month(d)::int as month, day(d)::int as day, year(d)::int as gyear
from (select event_id, (ts::date - (event_id % 3650)::int) as d from events)""")
def c05(spark, sf):
    r = table(spark, sf, "events").select(
        "event_id", (cal.to_rdate("ts") - F.col("event_id") % 3650).alias("r"))
    return r.select("event_id", *[v.alias(k) for k, v in cal.rdate_to_gdate("r").items()],
                    cal.rdate_to_gyear("r").alias("gyear"))


@query("c06_day_of_week", """
select dayofweek(l_shipdate)::int as dow, count(*)::bigint as n, sum(l_quantity) as qty from lineitem group by 1""")
def c06(spark, sf):
    return table(spark, sf, "lineitem").groupBy(cal.day_of_week("l_shipdate").alias("dow")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("c07_year_days", """
select o_orderkey, dayofyear(o_orderdate)::int as doy,
       (make_date(year(o_orderdate), 12, 31) - o_orderdate::date)::int as days_left,
       (date '2000-01-01' - o_orderdate::date)::int as days_between
from orders""")
def c07(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", cal.day_of_year(d).alias("doy"), cal.days_left_in_year(d).alias("days_left"),
        cal.subtract_dates(d, F.lit("2000-01-01").cast("date")).alias("days_between"))


@query("c08_leap_year", """
select year(o_orderdate)::int as year, count(*)::bigint as n,
       (day(last_day(make_date(year(o_orderdate), 2, 1))) = 29) as is_leap
from orders group by 1, 3""")
def c08(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n")).select("year", "n", cal.leap_year("year").alias("is_leap"))


@query("c11_kdays", """
select o_orderkey,
  d - ((dayofweek(d) - 5 + 7) % 7)::int as on_before, d + ((5 - dayofweek(d) + 7) % 7)::int as on_after,
  d - 1 - ((dayofweek(d - 1) - 5 + 7) % 7)::int as before, d + 1 + ((5 - dayofweek(d + 1) + 7) % 7)::int as after,
  d + 3 - ((dayofweek(d + 3) - 5 + 7) % 7)::int as nearest
from (select o_orderkey, o_orderdate::date as d from orders)""")
def c11(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", cal.kday_on_before(d, 5).alias("on_before"), cal.kday_on_after(d, 5).alias("on_after"),
        cal.kday_before(d, 5).alias("before"), cal.kday_after(d, 5).alias("after"),
        cal.kday_nearest(d, 5).alias("nearest"))


@query("c12_nth_kday", """
select o_orderkey,
  d + ((1 - dayofweek(d) + 7) % 7)::int + 14 as third_monday, d + ((1 - dayofweek(d) + 7) % 7)::int as first_monday,
  d - ((dayofweek(d) - 1 + 7) % 7)::int as last_monday, d - ((dayofweek(d) - 1 + 7) % 7)::int - 7 as second_last_monday,
  d + 1 + ((1 - dayofweek(d + 1) + 7) % 7)::int as zeroth_monday
from (select o_orderkey, o_orderdate::date as d from orders)""")
def c12(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", cal.nth_kday(3, 1, d).alias("third_monday"), cal.first_kday(1, d).alias("first_monday"),
        cal.last_kday(1, d).alias("last_monday"), cal.nth_kday(-2, 1, d).alias("second_last_monday"),
        cal.nth_kday(0, 1, d).alias("zeroth_monday"))


@query("c13_nth_in_month", """
select o_orderkey, ((day(o_orderdate) - 1) // 7 + 1)::int as nth from orders""")
def c13(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", cal.nth_kday_of_month("o_orderdate").alias("nth"))


@query("c14_nth_bizday", f"""
with {holiday_sql(ORDER_YEARS)},
months as (select year(o_orderdate)::int as year, month(o_orderdate)::int as month, count(*)::bigint as orders
           from orders group by 1, 2),
cand as (select year, month, orders, unnest(generate_series(make_date(year, month, 1)::timestamp,
           make_date(year, month, 1) + interval 45 day, interval 1 day))::date as d from months),
biz as (select c.*, row_number() over (partition by c.year, c.month order by d) as rn from cand c
        where isodow(d) <= 5 and not exists (select 1 from hol where hol.y = c.year and hol.holiday = c.d))
select year, month, orders, max(d) filter (where rn = 3) as third, max(d) filter (where rn = 21) as twentyfirst
from biz group by 1, 2, 3""")
def c14(spark, sf):
    months = table(spark, sf, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"))
    return months.select("year", "month", "orders", cal.nth_bizday(3, "year", "month").alias("third"),
                         cal.nth_bizday(21, "year", "month").alias("twentyfirst"))


@query("c15_events", """
with y as (select distinct year(o_orderdate)::int as year from orders),
f as (select year, make_date(year, m::int, 1) as d from y cross join range(1, 13) t(m))
select year, d + ((5 - dayofweek(d) + 7) % 7)::int + 14 as event from f""")
def c15(spark, sf):
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return years.select("year", F.explode(cal.monthly_events(3, 5, "year")).alias("event"))


@query("c16_next_prev_holiday", f"""
with {holiday_sql(NEAR_YEARS)}, days as (select distinct o_orderdate::date as d from orders),
n as (select d, min(holiday) filter (where holiday > d) as next_holiday,
             max(holiday) filter (where holiday < d) as previous_holiday,
             min(holiday) filter (where holiday > d and hol.y = year(d)) as next_in_year
      from days cross join hol group by d)
select o_orderkey, next_holiday, previous_holiday,
       coalesce((next_in_year - date '0001-01-01' + 1), 0)::int as next_in_year_rdate
from orders join n on n.d = o_orderdate::date""")
def c16(spark, sf):
    def nearest(d):
        return {"next_holiday": cal.next_holiday(d), "previous_holiday": cal.previous_holiday(d),
                "next_in_year_rdate": F.coalesce(cal.to_rdate(cal.next_holiday(d, 0)), F.lit(0))}

    days = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return cal.by_day(days, "o_orderdate", nearest).drop("o_orderdate")


@query("j06_nearest_events", """
with ev as (select distinct o_orderdate::date as e from orders where o_totalprice > 450000),
days as (select distinct l_shipdate::date as d from lineitem),
n as (select d, max(e) filter (where e < d) as previous_event, min(e) filter (where e > d) as next_event
      from days cross join ev group by d)
select l_orderkey, l_linenumber, l_partkey, previous_event, next_event
from lineitem join n on n.d = l_shipdate::date""")
def j06(spark, sf):
    events = table(spark, sf, "orders").filter("o_totalprice > 450000").select("o_orderdate")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return cal.with_nearest_events(items, "l_shipdate", events, "o_orderdate").drop("l_shipdate")


@query("j05_holidays_in_month", f"""
with {holiday_sql("select distinct year(l_shipdate)::int as y from lineitem")},
days as (select l_shipdate::date as d, count(*)::bigint as lines from lineitem group by 1)
select d, lines, count(h.name)::bigint as holidays_so_far, max(case when h.holiday = d then h.name end) as holiday
from days left join hol h on h.y = year(d) and h.holiday between date_trunc('month', d)::date and d
group by d, lines""")
def j05(spark, sf):
    days = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(
        F.count(F.lit(1)).alias("lines"))
    hol = cal.holiday_table(days.select(F.year("d").alias("year")).distinct())
    d, m = days.alias("d"), hol.alias("h")
    joined = d.join(m, (F.year("d.d") == F.col("h.year")) & F.col("h.holiday").between(F.trunc("d.d", "MM"), F.col("d.d")), "left")
    return joined.groupBy("d.d", "lines").agg(
        F.count("h.name").alias("holidays_so_far"),
        F.max(F.when(F.col("h.holiday") == F.col("d.d"), F.col("h.name"))).alias("holiday"))


@query("c17_expand_dates", """
select o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + to_days((o_orderkey % 5)::int), interval 1 day))::date as d
from orders""")
def c17(spark, sf):
    end = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(cal.expand_dates("o_orderdate", end)).alias("d"))


@query("c18_subtract_valid", """
with t as (select o_orderkey, o_orderdate::date as d, case o_orderkey % 3 when 0 then '-13-01' when 1 then '-2-30' else '-7-1' end as tail
           from orders)
select o_orderkey, d - 5 as five_before, year(d) || tail as text,
       try_strptime(year(d) || tail, '%Y-%m-%d') is not null as is_date from t""")
def c18(spark, sf):
    tail = F.when(F.col("o_orderkey") % 3 == 0, "-13-01").when(F.col("o_orderkey") % 3 == 1, "-2-30").otherwise("-7-1")
    text = F.concat(F.year("o_orderdate").cast("string"), tail)
    return table(spark, sf, "orders").select(
        "o_orderkey", cal.subtract_days("o_orderdate", 5).alias("five_before"), text.alias("text"),
        cal.valid_date(text).alias("is_date"))


@query("h_holidays", f"with {holiday_sql(ORDER_YEARS)} select y as year, name, holiday from hol")
def holidays_by_year(spark, sf):
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return cal.holiday_table(years)


@query("h_orders_on_holidays", f"""
with {holiday_sql(ORDER_YEARS)}
select name as holiday, count(*)::bigint as orders from orders join hol
  on hol.y = year(o_orderdate) and hol.holiday = o_orderdate::date group by 1""")
def orders_on_holidays(spark, sf):
    named = table(spark, sf, "orders").select(cal.holiday_name("o_orderdate").alias("holiday"))
    return named.filter("holiday is not null").groupBy("holiday").agg(F.count(F.lit(1)).alias("orders"))
