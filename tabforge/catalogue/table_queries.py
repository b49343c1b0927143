"""Sources, projections, joins, aggregates, windows, sorts and set operations (S, P, J, A, W, O, U)."""

from pyspark.sql import functions as F

from tabforge.catalogue.registry import query, table
from tabforge.operators import encode, frame, sequence, variables
from tabforge.operators.scaling import normality
from tabforge.operators.variables import Lag
from tabforge.plans.scale import positions
from tabforge.sources import io

# -- sources and sinks -------------------------------------------------------------


@query("s01_csv_round_trip", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def s01(spark, sf):
    orders = table(spark, sf, "orders")
    path = io.write_frame(
        orders, io.scratch_folder(spark), fmt="csv",
        columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    return io.read_frame(spark, path, schema="o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                                             "o_totalprice double, o_orderpriority string")


@query("s02_type_overrides", """
select c_custkey::varchar as c_custkey, c_name, c_nationkey::double as c_nationkey, c_acctbal, c_mktsegment from customer""")
def s02(spark, sf):
    path = io.write_frame(table(spark, sf, "customer"), io.scratch_folder(spark), fmt="csv")
    return io.read_frame(spark, path, dtypes={"c_custkey": "str", "c_nationkey": "float64"})


@query("s13_tsv", "select p_partkey, p_name, p_brand, p_size, p_retailprice from part")
def s13(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = io.write_frame(part, io.scratch_folder(spark), sep="\t", tag="tsv", fmt="csv")
    return io.read_frame(spark, path, sep="\t", schema=part.schema)


@query("s04_load_group", """
select event_type as tag_id, event_id, user_id, value from events where event_type in ('click', 'error')""")
def s04(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("tag_id"), "event_id", "user_id", "value")
    folder = io.scratch_folder(spark)
    io.dump_frames(events, folder)
    members = events.select(F.col("tag_id").alias("member")).filter("member in ('click', 'error')").distinct()
    return io.load_frames(spark, folder, members, extension="partitions")


@query("s05_dump_group", "select event_type as tag_id, count(*)::bigint as n, min(event_id) as first from events group by 1")
def s05(spark, sf):
    folder = io.scratch_folder(spark)
    io.dump_frames(table(spark, sf, "events").withColumnRenamed("event_type", "tag_id"), folder)
    back = io.read_frame(spark, folder, fmt="parquet")
    return back.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("s06_get_data", """
select o_orderkey, o_totalprice, (dense_rank() over (order by y) - 1)::int as y
from (select o_orderkey, o_totalprice, case when o_orderkey % 9 <> 0 then o_orderstatus end as y from orders)
where y is not null""")
def s06(spark, sf):
    y = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus"))
    df = table(spark, sf, "orders").withColumn("y", y)
    return io.get_data(df, "y", ["o_totalprice"], keep=["o_orderkey"])[0]


@query("s07_snapshot", """
select case when o_orderdate <= '1999-12-31' then 'train' else 'test' end as partition, count(*)::bigint as n,
       round(sum(o_totalprice), 2) as total from orders group by 1""")
def s07(spark, sf):
    train, test = frame.split_by_date(table(spark, sf, "orders"), "o_orderdate", _boundary())
    folder = io.scratch_folder(spark)
    io.snapshot(frame.stack_partitions(train, test), folder)
    return spark.read.parquet(folder).groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _boundary():
    import datetime

    return datetime.datetime(1999, 12, 31)


@query("s08_ranked_predictions", """
select o_orderkey, o_totalprice, round(o_totalprice / 1000, 6) as pred_a, (o_totalprice > 250000)::int as pred_b from orders""")
def s08(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    scores = table(spark, sf, "orders").select(
        "o_orderkey", F.round(F.col("o_totalprice") / 1000, 6).alias("pred_a"),
        (F.col("o_totalprice") > 250000).cast("int").alias("pred_b"))
    return io.ranked_predictions(orders, scores, "o_orderkey", "pred_a")


@query("s09_submission", """
select c_custkey, (select count(*)::bigint from orders where o_custkey = c_custkey having count(*) > 0) as c_nationkey
from customer""")
def s09(spark, sf):
    sample = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    scores = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("score"))
    return io.submission(sample, scores, "score")


# -- projections and filters ----------------------------------------------------


@query("p01_projection", "select c_custkey, c_acctbal, c_mktsegment from customer")
def p01(spark, sf):
    return frame.select_features(table(spark, sf, "customer"), ["c_acctbal", "c_mktsegment"], keep=["c_custkey"])


@query("p02_drop_by_root", """
select event_id, ts, user_id, lag(event_type) over (partition by user_id order by ts, event_id) as "event_type[-1]" from events""")
def p02(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    order = [F.col("ts"), F.col("event_id")]
    lags = {"value[-1]": (F.col("value"), 1), "event_type[-1]": (F.col("event_type"), 1), "value[-2]": (F.col("value"), 2)}
    return frame.drop_by_root(sequence.lag_by(events, ["user_id"], order, lags), ["value", "unknown"]).drop("event_type")


@query("p03_drop_null_target", """
select count(*)::bigint as kept, (select count(*)::bigint from documents) as live
from documents left join labels using (doc_id) where quality is not null""")
def p03(spark, sf):
    df = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    kept = frame.drop_null_target(df, "quality").agg(F.count(F.lit(1)).alias("kept"))
    live = frame.drop_null_target(df, "quality", live=True).agg(F.count(F.lit(1)).alias("live"))
    return kept.withColumn("_one", F.lit(1)).join(live.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query("p17_unlabeled", "select doc_id, n_chars from documents where doc_id not in (select doc_id from labels)")
def p17(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return frame.unlabeled(df, "quality").select("doc_id", "n_chars")


@query("p04_align_types", "select c_custkey, c_acctbal, c_mktsegment from customer")
def p04(spark, sf):
    train = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return frame.align_types(frame.stringify(train, train.columns), train)


@query("p05_date_boundary", """
select count(*) filter (where o_orderdate <= '1999-12-31')::bigint as before,
       count(*) filter (where o_orderdate > '1999-12-31')::bigint as after from orders""")
def p05(spark, sf):
    left, right = frame.split_by_date(table(spark, sf, "orders"), "o_orderdate", _boundary())
    tagged = left.select(F.lit(1).alias("b")).unionAll(right.select(F.lit(0).alias("b")))
    return tagged.agg(F.count_if(F.col("b") == 1).alias("before"), F.count_if(F.col("b") == 0).alias("after"))


@query("p06_stringify", """
select vec_id::varchar as vec_id, case when vec_id % 3 = 0 then null else label::varchar end as label from embeddings""")
def p06(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("label"))
    return frame.stringify(df, ["vec_id", "label"])


@query("p07_drop_zero_columns", "select l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax from lineitem")
def p07(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax",
        (F.col("l_quantity") * 0).alias("zero"), F.lit(None).cast("double").alias("nothing"))
    return frame.drop_zero_columns(df, ["l_quantity", "l_tax", "zero", "nothing"])


@query("p09_variables", """
with d as (select event_id, user_id, ts, value, avg(value) over w as ma3, lag(value) over o as prev from events
  window w as (partition by user_id order by ts, event_id rows between 2 preceding and current row),
         o as (partition by user_id order by ts, event_id))
select event_id, value > prev as up, value - prev as change, (value > prev) and (value > 10) as strong,
       (value > prev) and (value > 10) as big_up from d""")
def p09(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    layers = [
        {"prev": Lag("value", 1)},
        {"up": F.col("value") > F.col("prev"), "change": F.col("value") - F.col("prev")},
        {"strong": F.col("up") & (F.col("value") > 10)},
    ]
    out = variables.apply_variables(
        events, layers, ["user_id"], [F.col("ts"), F.col("event_id")], aliases={"big_up": "strong"})
    return out.select("event_id", "up", "change", "strong", "big_up")


@query("p10_param_override", """
select l_orderkey, l_linenumber, l_partkey, l_quantity <= 20 and l_discount <= 0.05 as cheap_20_5,
       l_quantity <= 40 and l_discount <= 0.08 as cheap_40_8 from lineitem""")
def p10(spark, sf):
    functions = variables.Functions()

    @functions.column
    def cheap(quantity=20, percent=5):
        return (F.col("l_quantity") <= quantity) & (F.col("l_discount") <= percent / 100)

    out = table(spark, sf, "lineitem").withColumns(
        dict([functions.variable("cheap", 20, 5), functions.variable("cheap", 40, 8)]))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "cheap_20_5", "cheap_40_8")


@query("p15_symbols", """
with a as (select event_id, user_id, ts, value, lag(value, 1) over w as v1, lag(value, 3) over w as v3 from events
           window w as (partition by user_id order by ts, event_id)),
b as (select *, value - v1 as step from a)
select event_id, user_id, step, value - v3 as move, lag(step, 2) over (partition by user_id order by ts, event_id) as "step[2]" from b""")
def p15(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    layers = [
        {"v1": Lag("value", 1), "v3": Lag("value", 3)},
        {"step": F.col("value") - F.col("v1"), "move": F.col("value") - F.col("v3")},
        {"step[2]": Lag("step", 2)},
    ]
    out = variables.apply_variables(events, layers, ["user_id"], [F.col("ts"), F.col("event_id")])
    return out.select("event_id", "user_id", "step", "move", "`step[2]`")


@query("p16_category_filter", "select p_partkey, p_brand, p_retailprice from part where p_type = 'ECONOMY'")
def p16(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_type") == "ECONOMY").select("p_partkey", "p_brand", "p_retailprice")


@query("y01_transforms", """
select o_orderkey, year(o_orderdate)::int as o_orderdate_year, month(o_orderdate)::int as o_orderdate_month,
       day(o_orderdate)::int as o_orderdate_day, (isodow(o_orderdate) - 1)::int as o_orderdate_dayofweek from orders""")
def y01(spark, sf):
    from tabforge.functions.calendar import dateparts

    functions = variables.Functions()

    @functions.table
    def date_columns(df, column):
        return variables.transform_columns(df, column, dateparts)

    out = functions.transform(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "date_columns", "o_orderdate")
    return out.drop("o_orderdate")


@query("y02_variable_functions", """
select l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice / 1000)::bigint as bucket_1000,
       floor(l_extendedprice / 5000)::bigint as bucket_5000 from lineitem""")
def y02(spark, sf):
    functions = variables.Functions()

    @functions.column
    def bucket(width):
        return F.floor(F.col("l_extendedprice") / width)

    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[functions.variable("bucket", w)[1].alias(f"bucket_{w}") for w in (1000, 5000)])


# -- joins and sets ---------------------------------------------------------------


@query("j02_append_columns", "select c_custkey, c_mktsegment, c_acctbal * 2 as twice from customer")
def j02(spark, sf):
    customer = table(spark, sf, "customer")
    extra = customer.select("c_custkey", (F.col("c_acctbal") * 2).alias("twice"))
    return frame.append_columns(customer.select("c_custkey", "c_mktsegment"), extra, "c_custkey")


@query("j07_membership", """
select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey
where n_regionkey in (select r_regionkey from region where r_name <> 'ASIA')""")
def j07(spark, sf):
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    nation = frame.group_members(table(spark, sf, "nation"), region.filter("r_name = 'ASIA'"), "n_regionkey", inside=False)
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("u01_stack_partitions", """
select o_orderkey, o_totalprice, case when o_orderdate <= '1999-12-31' then 'train' else 'test' end as partition from orders""")
def u01(spark, sf):
    train, test = frame.split_by_date(table(spark, sf, "orders"), "o_orderdate", _boundary())
    return frame.stack_partitions(train, test).select("o_orderkey", "o_totalprice", "partition")


@query("u02_group_add", """
with g as (select distinct o_custkey as member from orders where o_orderpriority = '1-URGENT'),
n as (select distinct o_custkey as member from orders where o_totalprice > 400000)
select member, member not in (select member from g) as is_new from (select * from g union select * from n)""")
def u02(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "member")
    group = orders.filter("o_orderpriority = '1-URGENT'").select("member").distinct()
    both, new = frame.group_add(group, orders.filter("o_totalprice > 400000").select("member"))
    return both.join(new.withColumn("is_new", F.lit(True)), "member", "left").fillna(False, ["is_new"])


@query("u03_group_remove", """
select o_custkey as member from orders except select o_custkey from orders where o_orderpriority = '1-URGENT'""")
def u03(spark, sf):
    orders = table(spark, sf, "orders")
    gone = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("member"))
    return frame.group_remove(orders.select(F.col("o_custkey").alias("member")), gone)


@query("u04_subset", """
select not exists (select o_custkey from orders except select c_custkey from customer) as orders_in_customers,
       not exists (select c_custkey from customer except select o_custkey from orders) as customers_in_orders""")
def u04(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    right = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return spark.range(1).select(
        F.lit(frame.is_subset(left, right)).alias("orders_in_customers"),
        F.lit(frame.is_subset(right, left)).alias("customers_in_orders"))


# -- aggregates ----------------------------------------------------------------------


@query("a01_group_sizes", "select o_custkey, count(*)::bigint as n from orders group by 1")
def a01(spark, sf):
    return frame.count_by(table(spark, sf, "orders"), "o_custkey")


@query("a02_class_distribution", """
select case when o_orderdate <= '1999-12-31' then 'train' else 'test' end as partition, o_orderstatus, count(*)::bigint as n
from orders group by 1, 2""")
def a02(spark, sf):
    train, test = frame.split_by_date(table(spark, sf, "orders"), "o_orderdate", _boundary())
    return frame.count_by(frame.stack_partitions(train, test), "partition", "o_orderstatus")


_NULLED = """(select c_custkey, case when c_custkey % 7 <> 0 then c_acctbal end as c_acctbal,
  case when c_custkey % 5 <> 0 then c_nationkey end as c_nationkey,
  case when c_custkey % 6 <> 0 then c_mktsegment end as c_mktsegment from customer)"""


def nulled_customer(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(key % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(key % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(key % 6 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))


_COLUMNS = ("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")


@query("a03_distinct", " union all ".join(
    f"select '{c}' as \"column\", (count(distinct {c}) + max(({c} is null)::int))::bigint as n_unique from {_NULLED}" for c in _COLUMNS))
def a03(spark, sf):
    return frame.distinct_counts(nulled_customer(spark, sf), _COLUMNS)


@query("a04_target_nulls", f"select count(*) filter (where c_mktsegment is null)::bigint as nulls from {_NULLED}")
def a04(spark, sf):
    return nulled_customer(spark, sf).agg(F.count_if(F.col("c_mktsegment").isNull()).alias("nulls"))


@query("a05_crosstab", """
select l_returnflag, round(avg((l_quantity > 25)::int), 9) as p_1, round(avg((l_quantity <= 25)::int), 9) as p_0
from lineitem group by 1""")
def a05(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).cast("int").alias("y"))
    out = frame.crosstab(df, "l_returnflag", "y", [0, 1])
    return out.select("l_returnflag", F.round("p_0", 9).alias("p_0"), F.round("p_1", 9).alias("p_1"))


@query("a06_text_length", """
select 'text' as "column", min(length(text))::int as min_length, max(length(text))::int as max_length from documents
union all select 'source', min(length(source))::int, max(length(source))::int from documents""")
def a06(spark, sf):
    return frame.text_lengths(table(spark, sf, "documents"), ["text", "source"])


@query("a07_mean_by_category", """
select p_brand, round(avg(p_retailprice), 6) as mean, count(*)::bigint as n from part group by 1 having count(*) >= 1""")
def a07(spark, sf):
    out = frame.mean_by(table(spark, sf, "part"), "p_brand", "p_retailprice")
    return out.withColumn("mean", F.round("mean", 6))


@query("a08_family_order", """
select p_type, (row_number() over (order by m desc, p_type))::int as place
from (select p_type, avg(p_retailprice) as m from part group by 1)""")
def a08(spark, sf):
    means = frame.mean_by(table(spark, sf, "part"), "p_type", "p_retailprice")
    return positions(means, [], [F.desc("mean"), F.col("p_type")], "place").select("p_type", F.col("place").cast("int").alias("place"))


@query("a09_profile", " union all ".join(
    f"select '{c}' as \"column\", count(*)::bigint as rows, count(*) filter (where {c} is null)::bigint as nulls, "
    f"count(distinct {c})::bigint as n_unique, bool_or({c} is null) as has_nulls from {_NULLED}" for c in _COLUMNS))
def a09(spark, sf):
    return frame.profile(nulled_customer(spark, sf), _COLUMNS)


def ztest_sql(n: str, g1: str, b2: str) -> tuple[str, str]:
    """Skewness and kurtosis test statistics as SQL text."""
    beta = f"(3.0*({n}*{n}+27*{n}-70)*({n}+1)*({n}+3)/(({n}-2)*({n}+5)*({n}+7)*({n}+9)))"
    w2 = f"(sqrt(2*({beta}-1))-1)"
    y = f"({g1}*sqrt(({n}+1)*({n}+3)/(6.0*({n}-2))))"
    al = f"sqrt(2/({w2}-1))"
    zs = f"(1/sqrt(0.5*ln({w2}))*ln({y}/{al}+sqrt(({y}/{al})*({y}/{al})+1)))"
    e = f"(3.0*({n}-1)/({n}+1))"
    v = f"(24.0*{n}*({n}-2)*({n}-3)/(({n}+1)*({n}+1)*({n}+3)*({n}+5)))"
    x = f"(({b2}-{e})/sqrt({v}))"
    q = f"(6.0*({n}*{n}-5*{n}+2)/(({n}+7)*({n}+9))*sqrt(6.0*({n}+3)*({n}+5)/({n}*({n}-2)*({n}-3))))"
    a = f"(6+(8/{q})*(2/{q}+sqrt(1+4/({q}*{q}))))"
    d = f"(1+{x}*sqrt(2/({a}-4)))"
    zk = f"((1-2/(9*{a})-sign({d})*cbrt((1-2/{a})/abs({d})))/sqrt(2/(9*{a})))"
    return zs, zk


def _normality_sql(column: str, tab: str) -> str:
    zs, zk = ztest_sql("n", "g1", "b2")
    return f"""select '{column}' as "column", n::bigint as n, round(g1, 8) as skew, round(b2 - 3, 8) as kurtosis,
      round({zs}*{zs}+{zk}*{zk}, 4) as k2, smallest
    from (select n, m3/pow(m2, 1.5) as g1, m4/(m2*m2) as b2, smallest from (
      select count(*)::double as n, avg(pow(x-m,2)) as m2, avg(pow(x-m,3)) as m3, avg(pow(x-m,4)) as m4, min(x) as smallest
      from (select {column} as x, avg({column}) over () as m from {tab})))"""


@query("a10_normality", " union all ".join(_normality_sql(c, "lineitem") for c in ("l_extendedprice", "l_discount", "l_quantity")))
def a10(spark, sf):
    out = normality(table(spark, sf, "lineitem"), ["l_extendedprice", "l_discount", "l_quantity"])
    return out.select("column", "n", F.round("skew", 8).alias("skew"), F.round("kurtosis", 8).alias("kurtosis"),
                      F.round("k2", 4).alias("k2"), "smallest")


# -- windows, sorts -------------------------------------------------------------------


@query("w01_lags", """
select event_id, ts, user_id, event_type, lag(k, 1) over w as "k[-1]", lag(k, 2) over w as "k[-2]", lag(k, 3) over w as "k[-3]",
       value from (select *, (props->>'$.k')::bigint as k from events) window w as (partition by user_id order by ts, event_id)""")
def w01(spark, sf):
    events = _panel(spark, sf)
    return sequence.sequence_frame(events, "value", "ts", "event_id", 1, 3, ["event_type"], "user_id")


def _panel(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")


@query("w02_forecast_target", """
select event_id, ts, user_id, event_type, k, lag(k, 1) over w as "k[-1]", lag(value, 1) over w as "value[-1]", lead(value, 2) over w as value
from (select *, (props->>'$.k')::bigint as k from events) window w as (partition by user_id order by ts, event_id)""")
def w02(spark, sf):
    return sequence.sequence_frame(
        _panel(spark, sf), "value", "ts", "event_id", 3, 1, ["event_type"], "user_id", keep_current=True, lag_target=True)


@query("w03_variable_lag", """
select o_orderkey, lag(o_totalprice, 2) over (partition by o_custkey order by o_orderdate, o_orderkey) as "o_totalprice[2]" from orders""")
def w03(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = sequence.lag_by(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")],
                          {"o_totalprice[2]": (F.col("o_totalprice"), 2)})
    return out.select("o_orderkey", "`o_totalprice[2]`")


@query("w05_topk_group", """
select * from (select p_brand, p_partkey, p_retailprice,
  (row_number() over (partition by p_brand order by p_retailprice desc, p_partkey))::int as rank from part) where rank <= 3""")
def w05(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return frame.top_k_per_group(part, "p_brand", 3, F.desc("p_retailprice"), F.col("p_partkey"))


@query("w07_time_split", """
with d as (select o_orderdate, row_number() over (order by o_orderdate) - 1 as i, count(*) over () as n from orders),
b as (select max(o_orderdate) as boundary from d where i = floor((1 - 0.25) * n))
select boundary, count(*) filter (where o_orderdate <= boundary)::bigint as train,
       count(*) filter (where o_orderdate > boundary)::bigint as test from orders, b group by boundary""")
def w07(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderdate")
    boundary = frame.literal(orders, "o_orderdate", sequence.split_date(orders, "o_orderdate", 0.25))
    side = F.col("o_orderdate") <= boundary
    return orders.agg(F.count_if(side).alias("train"), F.count_if(~side).alias("test")).withColumn("boundary", boundary)


@query("w08_mode", """
select 'p_size' as "column", p_size::bigint as mode from part group by p_size
qualify row_number() over (order by count(*) desc, p_size) = 1
union all (select 'p_partkey', min(p_partkey) from part)""")
def w08(spark, sf):
    from tabforge.operators.scaling import value_counts

    counts = value_counts(table(spark, sf, "part"), ["p_size", "p_partkey"])
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))


@query("o02_sort_predictions", "select o_orderkey, o_totalprice from orders")
def o02(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("o03_top_n", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def o03(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return frame.top_n(orders, 20, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("o06_two_key_sort", "select p_brand, p_name, p_partkey from part")
def o06(spark, sf):
    return frame.contiguous_groups(table(spark, sf, "part").select("p_brand", "p_name", "p_partkey"), "p_brand", "p_name", "p_partkey")


@query("s12_fixed_one_hot", """
select o_orderkey, (o_orderstatus = 'F')::int as is_F, (o_orderstatus = 'O')::int as is_O, (o_orderstatus = 'X')::int as is_X,
       o_totalprice from orders""")
def s12(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return frame.fixed_one_hot(orders, "o_orderstatus", ["F", "O", "X"], "o_totalprice", "is_").orderBy("o_orderkey")


@query("e16_label_encoding", """
select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::int as o_orderpriority from orders""")
def e16(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encode.LabelEncoder("o_orderpriority").fit(orders).transform(orders)


@query("s03_write_columns", "select o_orderkey, o_totalprice from orders")
def s03(spark, sf):
    path = io.write_frame(table(spark, sf, "orders"), io.scratch_folder(spark), columns=["o_orderkey", "o_totalprice"], tag="part")
    return io.read_frame(spark, path, fmt="parquet")


@query("j01_features_and_target", "select c_custkey, c_acctbal, c_mktsegment as target from customer")
def j01(spark, sf):
    customer = table(spark, sf, "customer")
    x, y = customer.select("c_custkey", "c_acctbal"), customer.select("c_custkey", F.col("c_mktsegment").alias("target"))
    return frame.append_columns(x, y, "c_custkey")


@query("k02_time_split_rows", """
with d as (select o_orderdate, row_number() over (order by o_orderdate) - 1 as i, count(*) over () as n from orders)
select o_orderkey, case when o_orderdate <= (select max(o_orderdate) from d where i = floor((1 - 0.3) * n)) then 'train' else 'test' end as partition
from orders""")
def k02(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    train, test = frame.split_by_date(orders, "o_orderdate", sequence.split_date(orders, "o_orderdate", 0.3))
    return frame.stack_partitions(train, test).drop("o_orderdate")


@query("o01_panel_order", "select event_id, ts, user_id from events")
def o01(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id").orderBy("ts", "event_id")
