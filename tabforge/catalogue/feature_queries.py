"""Row statistics, imputation, scaling, scalar functions and encoders (R, I, M, E)."""

from pyspark.sql import functions as F

from tabforge.catalogue.registry import query, table
from tabforge.catalogue.table_queries import ztest_sql
from tabforge.operators import encode, frame, rowstats, scaling, variables


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- row statistics -----------------------------------------------------------------

_R_COLS = ("p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
_R_TAB = """(select p_partkey, case when p_partkey % 4 <> 0 then p_size % 10 end as p_size, p_retailprice,
  case when p_partkey % 5 <> 0 then p_brand end as p_brand, p_type from part)"""


def _nulled_part(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") % 10).alias("p_size"), "p_retailprice",
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("p_brand"), "p_type")


_NN = "(" + " + ".join(f"({c} is not null)::int" for c in _R_COLS) + ")"


@query("r01_counts", f"select p_partkey, {_NN}::int as nan_count, (5 - {_NN})::int as null_count from {_R_TAB}")
def r01(spark, sf):
    return frame.row_counts(_nulled_part(spark, sf), digits=False).select("p_partkey", "nan_count", "null_count")


@query("r02_digit_counts", "select p_partkey, " + ", ".join(
    f"(coalesce((p_partkey = {i})::int, 0) + coalesce((p_size = {i})::int, 0) + coalesce((p_retailprice = {i})::int, 0) "
    f"+ ({_NN} = {i})::int)::int as count_{i}" for i in range(10)) + f" from {_R_TAB}")
def r02(spark, sf):
    out = frame.row_counts(_nulled_part(spark, sf))
    return out.select("p_partkey", *[f"count_{i}" for i in range(10)])


_LI = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("r03_rowstats", """
with s as (select l_orderkey, l_linenumber, l_partkey, l_quantity + l_extendedprice + l_discount + l_tax as s,
  l_quantity a, l_extendedprice b, l_discount c, l_tax d from lineitem),
v as (select *, s / 4 as m, (pow(a - s/4, 2) + pow(b - s/4, 2) + pow(c - s/4, 2) + pow(d - s/4, 2)) / 4 as v from s),
z as (select avg(s) s1, stddev_pop(s) s2, avg(m) m1, stddev_pop(m) m2, avg(sqrt(v)) d1, stddev_pop(sqrt(v)) d2, avg(v) v1, stddev_pop(v) v2 from v)
select l_orderkey, l_linenumber, l_partkey, round((s - s1) / s2, 6) as sum, round((m - m1) / m2, 6) as mean,
       round((sqrt(v) - d1) / d2, 6) as std, round((v - v1) / v2, 6) as var from v, z""")
def r03(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_LI)
    out = rowstats.numpy_features(df, _LI).drop(*_LI)
    return rounded(out, ["sum", "mean", "std", "var"])


_ZS, _ZK = ztest_sql("n", "g1", "b2")
_SHAPE = f"""
with x as (select vec_id, exp(unnest(embedding)::double) as x from embeddings),
m as (select vec_id, avg(x) as m, count(*)::double as n, exp(avg(ln(x))) as g from x group by vec_id),
c as (select x.vec_id, any_value(n) n, any_value(m) m, any_value(g) g, avg(pow(x - m, 2)) m2, avg(pow(x - m, 3)) m3, avg(pow(x - m, 4)) m4
      from x join m using (vec_id) group by x.vec_id),
k as (select *, m3 / pow(m2, 1.5) as g1, m4 / (m2 * m2) as b2 from c),
s as (select vec_id, g as sp_geometric_mean, b2 - 3 as sp_kurtosis, {_ZK} as sp_kurtosis_test, {_ZS}*{_ZS} + {_ZK}*{_ZK} as sp_normal_test,
      g1 as sp_skew, {_ZS} as sp_skew_test, sqrt(m2) / m as sp_variation, m / sqrt(m2) as sp_signal_to_noise,
      sqrt(m2 / (n - 1)) as sp_standard_error_of_mean from k)"""


def _positive_embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("embedding"))


@query("r04_shape_statistics", _SHAPE + " select vec_id, " + ", ".join(f"round({c}, 7) as {c}" for c in rowstats.SHAPE_NAMES) + " from s")
def r04(spark, sf):
    out = rowstats.shape_statistics(_positive_embeddings(spark, sf), "embedding").drop("embedding")
    return rounded(out, rowstats.SHAPE_NAMES, 7)


@query("r13_scipy", _SHAPE + ", z as (select " + ", ".join(
    f"avg({c}) as a_{c}, stddev_pop({c}) as d_{c}" for c in rowstats.SHAPE_NAMES) + " from s) select vec_id, " + ", ".join(
    f"round(({c} - a_{c}) / d_{c}, 6) as {c}" for c in rowstats.SHAPE_NAMES) + " from s, z")
def r13(spark, sf):
    out = rowstats.scipy_features(_positive_embeddings(spark, sf), "embedding").drop("embedding")
    return rounded(out, rowstats.SHAPE_NAMES)


# -- imputation and scaling ------------------------------------------------------------


@query("i01_median", """
with t as (select c_custkey, case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then 'inf'::double else c_acctbal end as b from customer)
select c_custkey, round(coalesce(case when isfinite(b) then b end, (select quantile_cont(b, 0.5) from t where isfinite(b))), 6) as c_acctbal from t""")
def i01(spark, sf):
    k = F.col("c_custkey")
    b = F.when(k % 7 == 0, None).when(k % 11 == 0, float("inf")).otherwise(F.col("c_acctbal"))
    df = table(spark, sf, "customer").select("c_custkey", b.alias("c_acctbal"))
    return rounded(scaling.fit_median(df, ["c_acctbal"]).transform(df), ["c_acctbal"])


@query("i02_mode", """
with t as (select p_partkey, case when p_partkey % 5 <> 0 then p_size end as s from part)
select p_partkey, coalesce(s, (select s from t where s is not null group by s order by count(*) desc, s limit 1))::int as p_size from t""")
def i02(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"))
    return scaling.fit_mode(df, ["p_size"]).transform(df)


@query("i03_i06_fill", """
select c_custkey, coalesce(case when c_custkey % 3 <> 0 then c_nationkey end, 0)::int as c_nationkey,
       coalesce(case when c_custkey % 4 <> 0 then c_mktsegment end, 'NULLTEXT') as c_mktsegment, c_acctbal > 0 as positive from customer""")
def i03(spark, sf):
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 3 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(k % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_acctbal") > 0).alias("positive"))
    return scaling.fit_imputer(df, unsigned=["c_nationkey"], skip=["c_custkey"]).transform(df)


_SCALED = ("l_quantity", "l_extendedprice", "l_discount")


def _scale_sql(parts):
    return "select l_orderkey, l_linenumber, l_partkey, " + ", ".join(parts) + " from lineitem, z"


@query("i07_standard", "with z as (select " + ", ".join(f"avg({c}) a_{c}, stddev_pop({c}) d_{c}" for c in _SCALED) + " from lineitem) "
       + _scale_sql([f"round(({c} - a_{c}) / d_{c}, 7) as {c}" for c in _SCALED]))
def i07(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_SCALED)
    return rounded(scaling.fit_standard(df, _SCALED).transform(df), _SCALED, 7)


@query("i08_minmax", "with z as (select " + ", ".join(f"min({c}) a_{c}, max({c}) d_{c}" for c in _SCALED) + " from lineitem) "
       + _scale_sql([f"round(({c} - a_{c}) / (d_{c} - a_{c}), 7) as {c}" for c in _SCALED]))
def i08(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_SCALED)
    return rounded(scaling.fit_minmax(df, _SCALED).transform(df), _SCALED, 7)


@query("i09_zero_standard", """
with t as (select c_custkey, case when c_custkey % 7 = 0 or c_custkey % 11 = 0 then 0 else c_acctbal end as b from customer),
z as (select avg(b) a, stddev_pop(b) d from t) select c_custkey, round((b - a) / d, 7) as c_acctbal from t, z""")
def i09(spark, sf):
    k = F.col("c_custkey")
    b = F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, None).otherwise(F.col("c_acctbal"))
    df = table(spark, sf, "customer").select("c_custkey", b.alias("c_acctbal"))
    return rounded(scaling.zero_then_standard(df, ["c_acctbal"]), ["c_acctbal"], 7)


@query("l03_robust_scaler", """
with z as (select quantile_cont(o_totalprice, 0.5) m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) r from orders)
select o_orderkey, round((o_totalprice - m) / r, 7) as o_totalprice from orders, z""")
def l03(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(scaling.fit_robust(df, ["o_totalprice"]).transform(df), ["o_totalprice"], 7)


# -- scalar functions --------------------------------------------------------------------


@query("m01_log_transform", """
select p_partkey, round(ln(p_retailprice), 9) as p_retailprice_log, p_size::double - 10 as centred from part""")
def m01(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice", (F.col("p_size").cast("double") - 10).alias("centred"))
    out = scaling.fit_log(df, ["p_retailprice", "centred"]).transform(df)
    return rounded(out, ["p_retailprice_log"], 9)


@query("m02_float_factor", """
select l_orderkey, l_linenumber, l_partkey, regexp_replace(printf('%.3f', l_discount), '[^0-9]', '', 'g')::bigint as discount,
       regexp_replace(printf('%.1f', l_quantity - 25), '[^0-9]', '', 'g')::bigint as quantity from lineitem""")
def m02(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", variables.float_factor("l_discount", 3).alias("discount"),
        variables.float_factor(F.col("l_quantity") - 25, 1).alias("quantity"))


@query("m04_unit_scale", """
select s_suppkey, round((s_acctbal - min(s_acctbal) over ()) / (max(s_acctbal) over () - min(s_acctbal) over ()), 9) as score from supplier""")
def m04(spark, sf):
    out = variables.unit_scale(table(spark, sf, "supplier"), "s_acctbal", "score")
    return out.select("s_suppkey", F.round("score", 9).alias("score"))


@query("m05_v14_candles", """
with b as (select user_id, date_trunc('day', ts)::date as day, arg_min(value, (ts, event_id)) as open, max(value) as high,
  min(value) as low, arg_max(value, (ts, event_id)) as close from events group by 1, 2)
select *, round((open + close) / 2, 6) as mid, round(abs(close - open), 6) as span, close > open as up, open > close as down from b""")
def m05(spark, sf):
    first, last = F.struct("ts", "event_id"), F.struct("ts", "event_id")
    bars = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", last).alias("close"))
    return rounded(bars.withColumns(variables.candle("open", "close")), ["mid", "span"])


# -- encoders -------------------------------------------------------------------------------

_SPLIT = "o_orderdate <= '1999-12-31'"
_Y = "(o_totalprice > 250000)::int"
_TR = f"with tr as (select o_orderpriority as cat, {_Y} as y, o_orderdate, o_orderkey from orders where {_SPLIT})"
_CODES = _TR + ", codes as (select cat, row_number() over (order by cat) as code, count(*) over () as k from (select distinct cat from tr))"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", (F.col("o_totalprice") > 250000).cast("int").alias("y"))


def _train(df):
    return df.filter(F.col("o_orderdate") <= F.lit("1999-12-31").cast("timestamp_ntz"))


def _encoded(spark, sf, encoder, *names, digits=9):
    df = _orders(spark, sf)
    out = encoder.fit(_train(df)).transform(df)
    names = names or tuple(c for c in out.columns if c.startswith("o_orderpriority_"))
    doubles = {c for c, t in out.dtypes if t == "double"}
    return out.select("o_orderkey", *[F.round(n, digits).alias(n) if n in doubles else F.col(n) for n in names])


def _code_sql(exprs: dict[str, str]) -> str:
    cols = ", ".join(f"{e} as o_orderpriority_{n}" for n, e in exprs.items())
    return _CODES + f" select o_orderkey, {cols} from orders left join codes on cat = o_orderpriority"


@query("e01_ordinal", _CODES + """, st as (select cat, row_number() over (order by cat) as code from (select distinct o_orderstatus as cat from orders
  where o_orderdate <= '1999-12-31'))
select o_orderkey, coalesce(codes.code, -1)::bigint as o_orderpriority_code, coalesce(st.code, -1)::bigint as o_orderstatus_code
from orders left join codes on codes.cat = o_orderpriority left join st on st.cat = o_orderstatus""")
def e01(spark, sf):
    enc = encode.OrdinalEncoder(["o_orderpriority", "o_orderstatus"])
    return _encoded(spark, sf, enc, "o_orderpriority_code", "o_orderstatus_code")


@query("e02_onehot", _code_sql({f"is{j}": f"coalesce((code = {j})::int, 0)" for j in range(1, 6)}))
def e02(spark, sf):
    return _encoded(spark, sf, encode.OneHotEncoder(["o_orderpriority"]))


@query("e03_binary", _code_sql({"d1": "((code // 4) % 2)::int", "d2": "((code // 2) % 2)::int", "d3": "(code % 2)::int"}))
def e03(spark, sf):
    return _encoded(spark, sf, encode.BinaryEncoder(["o_orderpriority"]))


@query("e04_basen", _code_sql({"d1": "((code // 3) % 3)::int", "d2": "(code % 3)::int"}))
def e04(spark, sf):
    return _encoded(spark, sf, encode.BaseNEncoder(["o_orderpriority"], base=3))


@query("e05_hashing", "select o_orderkey, " + ", ".join(
    f"((('0x' || substr(md5(o_orderpriority), 25, 8))::bigint % 8 = {b})::int + (('0x' || substr(md5(o_orderstatus), 25, 8))::bigint % 8 = {b})::int)::int as hash_{b}"
    for b in range(8)) + " from orders")
def e05(spark, sf):
    return _encoded(spark, sf, encode.HashingEncoder(["o_orderpriority", "o_orderstatus"]), *[f"hash_{b}" for b in range(8)])


@query("e06_backdiff", _code_sql({f"c{j}": f"round((case when code <= {j} then -(k - {j}) / k::double else {j} / k::double end), 9)" for j in range(1, 5)}))
def e06(spark, sf):
    return _encoded(spark, sf, encode.BackwardDifferenceEncoder(["o_orderpriority"]))


@query("e07_helmert", _code_sql({f"c{j}": f"(case when code <= {j} then -1 when code = {j + 1} then {j} else 0 end)::double" for j in range(1, 5)}))
def e07(spark, sf):
    return _encoded(spark, sf, encode.HelmertEncoder(["o_orderpriority"]))


@query("e08_sum", _code_sql({f"c{j}": f"(case when code = {j} then 1 when code = k then -1 else 0 end)::double" for j in range(1, 5)}))
def e08(spark, sf):
    return _encoded(spark, sf, encode.SumEncoder(["o_orderpriority"]))


# Orthonormal polynomial contrasts of five levels, times their norms.
_POLY5 = {1: ((-2, -1, 0, 1, 2), 10), 2: ((2, -1, -2, -1, 2), 14), 3: ((-1, 2, 0, -2, 1), 10), 4: ((1, -4, 6, -4, 1), 70)}


@query("e09_polynomial", _code_sql({
    f"c{j}": f"round(list_extract({list(v)}, code)::double / sqrt({norm}), 9) + 0" for j, (v, norm) in _POLY5.items()}))
def e09(spark, sf):
    out = _encoded(spark, sf, encode.PolynomialEncoder(["o_orderpriority"]))
    return out.withColumns({c: F.col(c) + 0 for c in out.columns if c != "o_orderkey"})


_ST = _TR + """, st as (select cat, count(*)::double as n, sum(y)::double as s, var_samp(y) as v from tr group by cat),
pr as (select avg(y) as mean, var_samp(y) as var, sum(y)::double as total, count(*)::double as rows from tr)"""


def _target_sql(expr, default="mean"):
    return _ST + f""" select o_orderkey, round(case when st.cat is null then {default} else {expr} end, 9) as o_orderpriority_t
      from orders cross join pr left join st on st.cat = o_orderpriority"""


_LAMBDA = "(1 / (1 + exp(-(n - 20) / 10)))"


@query("e10_target", _target_sql(f"{_LAMBDA} * s / n + (1 - {_LAMBDA}) * mean"))
def e10(spark, sf):
    return _encoded(spark, sf, encode.TargetEncoder(["o_orderpriority"], "y"))


@query("e11_mestimate", _target_sql("(s + 5 * mean) / (n + 5)"))
def e11(spark, sf):
    return _encoded(spark, sf, encode.MEstimateEncoder(["o_orderpriority"], "y", m=5.0))


@query("e12_jstein", _target_sql("(1 - (v / n) / (v / n + var)) * s / n + ((v / n) / (v / n + var)) * mean"))
def e12(spark, sf):
    return _encoded(spark, sf, encode.JamesSteinEncoder(["o_orderpriority"], "y"))


@query("e13_leaveone", """
with st as (select o_orderpriority as cat, count(*)::double n, sum((o_totalprice > 250000)::int)::double s from orders group by 1)
select o_orderkey, round((s - (o_totalprice > 250000)::int) / (n - 1), 9) as o_orderpriority_t from orders join st on cat = o_orderpriority""")
def e13(spark, sf):
    out = encode.LeaveOneOutEncoder(["o_orderpriority"], "y").fit_transform(_orders(spark, sf))
    return out.select("o_orderkey", F.round("o_orderpriority_t", 9).alias("o_orderpriority_t"))


@query("e14_w06_catboost", """
select o_orderkey, round((coalesce(sum(y) over w, 0) + avg(y) over ()) / (count(y) over w + 1), 9) as o_orderpriority_t
from (select *, (o_totalprice > 250000)::int as y from orders)
window w as (partition by o_orderpriority order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding)""")
def e14(spark, sf):
    enc = encode.CatBoostEncoder(["o_orderpriority"], "y")
    out = enc.fit_transform(_orders(spark, sf), [F.col("o_orderdate"), F.col("o_orderkey")])
    return out.select("o_orderkey", F.round("o_orderpriority_t", 9).alias("o_orderpriority_t"))


@query("e15_woe", _target_sql("ln(((s + 1) / (total + 2)) / ((n - s + 1) / (rows - total + 2)))", "0"))
def e15(spark, sf):
    return _encoded(spark, sf, encode.WOEEncoder(["o_orderpriority"], "y"))


@query("j08_lookup_unseen", _ST + """ select p_partkey, round(coalesce(s / n, mean), 9) as p_type_t
  from part cross join pr left join st on st.cat = case when p_partkey % 2 = 0 then '1-URGENT' else p_type end""")
def j08(spark, sf):
    train = _train(_orders(spark, sf)).withColumnRenamed("o_orderpriority", "p_type")
    model = encode.MEstimateEncoder(["p_type"], "y", m=0.0).fit(train)
    kind = F.when(F.col("p_partkey") % 2 == 0, "1-URGENT").otherwise(F.col("p_type"))
    out = model.transform(table(spark, sf, "part").select("p_partkey", kind.alias("p_type")))
    return out.select("p_partkey", F.round("p_type_t", 9).alias("p_type_t"))


@query("e17_t02_factorize", """
select doc_id, (dense_rank() over (order by coalesce(source, 'NULLTEXT')) - 1)::bigint as source,
       (dense_rank() over (order by text) - 1)::bigint as text from documents""")
def e17(spark, sf):
    return encode.factorize(table(spark, sf, "documents").select("doc_id", "source", "text"), ["source", "text"])
