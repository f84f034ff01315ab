"""Statistics: lineitem holds scored rows (quantity = reference units, discount and tax = errors of two runs, return flag = unit)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skriva.operators import scan
from skriva.operators import stats as S
from skriva.plans.registered import query, read

_T = " ".join(f"when df >= {k} then {v}" for k, v in sorted(S.T_95.items(), reverse=True))
T_CASE = f"case when df > {max(S.T_95)} then 1.96 {_T} else {S.T_95[1]} end"


@query("select l_returnflag as unit, round(sum(l_discount*l_quantity)/sum(l_quantity), 6) as error_rate, sum(l_quantity) as ref_units, count(*) as n_files from lineitem group by 1")
def weighted_error(spark, d):
    rows = read(spark, d, "lineitem")
    rate = S.weighted_rate(F.col("l_discount"), F.col("l_quantity"))
    return rows.groupBy(F.col("l_returnflag").alias("unit")).agg(F.round(rate, 6).alias("error_rate"), F.sum("l_quantity").alias("ref_units"), F.count("*").alias("n_files"))


@query("select l_returnflag as unit, round(sum(l_extendedprice)/greatest(sum(l_quantity), 1e-9), 6) as x_realtime from lineitem group by 1")
def throughput_ratio(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("unit")).agg(F.round(S.throughput(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("x_realtime"))


@query("select l_returnflag as unit, round(avg(l_discount), 6) as mean_error, max(l_quantity) as peak, count(*) as n from lineitem group by 1")
def unit_means(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("unit")).agg(F.round(F.avg("l_discount"), 6).alias("mean_error"), F.max("l_quantity").alias("peak"), F.count("*").alias("n"))


def _runs(spark, d):
    """Two runs over the same files: (dur, unit, ref_units, error) by part and return flag."""
    rows = read(spark, d, "lineitem").withColumn("dur", F.bround(F.col("l_partkey") / 10.0).cast("bigint")).withColumnRenamed("l_returnflag", "unit")
    one = lambda ok, err: rows.where(ok).groupBy("dur", "unit").agg((F.count("*") % 4).alias("ref_units"), F.avg(err).alias("error"))
    return one(F.col("l_linenumber") <= 4, "l_discount"), one(F.col("l_linenumber") > 3, "l_tax")


RUNS = """with rows as (select cast(round_even(l_partkey/10.0, 0) as bigint) as dur, l_returnflag as unit, * from lineitem),
a as (select dur, unit, count(*) % 4 as ref_units, avg(l_discount) as error from rows where l_linenumber <= 4 group by all),
b as (select dur, unit, count(*) % 4 as ref_units, avg(l_tax) as error from rows where l_linenumber > 3 group by all)"""
#: Of the same files, with weight over 0.
PAIRS = RUNS + ", pairs as (select dur, unit, a.ref_units as weight, a.error as ea, b.error as eb from a join b using (dur, unit) where a.ref_units = b.ref_units and a.ref_units > 0)"


def _pairs(spark, d):
    return S.paired(*_runs(spark, d), ["dur", "unit"])[0].where("weight > 0")


@query(PAIRS + " select unit, count(*) as n_files, cast(sum(weight) as bigint) as ref_units, round(sum(ea*weight)/sum(weight) - sum(eb*weight)/sum(weight), 6) as diff from pairs group by unit")
def paired_diff(spark, d):
    w = F.col("weight")
    diff = S.weighted_rate(F.col("ea"), w) - S.weighted_rate(F.col("eb"), w)
    return _pairs(spark, d).groupBy("unit").agg(F.count("*").alias("n_files"), F.sum(w).cast("bigint").alias("ref_units"), F.round(diff, 6).alias("diff"))


_SOME = RUNS + ", x as (select * from a where dur % 3 > 0), y as (select * from b where dur % 5 > 0)"


@query(_SOME + " select dur, unit, 'a' as side from x anti join y using (dur, unit) union all select dur, unit, 'b' from y anti join x using (dur, unit)")
def unmatched_runs(spark, d):
    """Runs that lack every third and every fifth length."""
    a, b = _runs(spark, d)
    return S.unmatched(a.where("dur % 3 > 0"), b.where("dur % 5 > 0"), ["dur", "unit"])


@query(RUNS + " select dur, unit, a.ref_units as ref_a, b.ref_units as ref_b from a join b using (dur, unit) where a.ref_units <> b.ref_units")
def reflen_guard(spark, d):
    return S.paired(*_runs(spark, d), ["dur", "unit"])[1].select("dur", "unit", F.col("wa").alias("ref_a"), F.col("wb").alias("ref_b"))


@query(
    """select key, unit, o_orderkey from (select cast(round_even(o_totalprice/1000, 0) as bigint) as key, o_orderstatus as unit, o_orderkey,
    row_number() over (partition by cast(round_even(o_totalprice/1000, 0) as bigint), o_orderstatus order by o_orderkey) as n from orders) where n = 1"""
)
def run_dedup(spark, d):
    rows = read(spark, d, "orders").select(F.bround(F.col("o_totalprice") / 1000).cast("bigint").alias("key"), F.col("o_orderstatus").alias("unit"), "o_orderkey")
    return S.first_of_key(rows, ["key", "unit"], [F.col("o_orderkey")])


@query(
    """select p_partkey, count(*) as n, count(*) filter (l_discount < (p_size % 11)/100.0::double) as wins, list_sort(list(l_discount)) as runs
    from part join lineitem on l_partkey = p_partkey group by p_partkey"""
)
def repeat_wins(spark, d):
    base = read(spark, d, "part").select("p_partkey", ((F.col("p_size") % 11) / F.lit(100.0)).alias("base"))
    runs = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_discount")
    return base.join(runs, "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") < F.col("base")).alias("wins"), F.array_sort(F.collect_list("l_discount")).alias("runs"))


T_SQL = f"""with s as (select l_orderkey as key, count(*) as n, avg(l_discount) as mean, coalesce(stddev_samp(l_discount), 0.0) as sd from lineitem group by 1),
t as (select *, n - 1 as df from s), i as (select *, ({T_CASE}) * sd / sqrt(n) as half from t)"""


@query(T_SQL + " select key, n, round(mean, 6) as mean, round(sd, 6) as sd, round(mean - half, 6) as lo, round(mean + half, 6) as hi from i")
def t_interval(spark, d):
    got = S.t_interval(read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "key"), "key", "l_discount")
    return got.select("key", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "lo", "hi")))


@query(T_SQL + " select case when mean + half < 0.05 then 'below' when mean - half > 0.05 then 'above' else 'not resolved' end as verdict, count(*) as n from i group by 1")
def verdict(spark, d):
    got = S.t_interval(read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "key"), "key", "l_discount")
    return got.groupBy(S.verdict(F.col("lo"), F.col("hi"), 0.05).alias("verdict")).agg(F.count("*").alias("n"))


@query(
    """with w as (select l_orderkey as key, count(*) filter (l_discount < l_tax) as a, count(*) filter (l_tax < l_discount) as b from lineitem group by 1),
    k as (select *, a + b as n, least(a, b) as k from w)
    select key, a as wins_a, b as wins_b, round(case when n = 0 then 1.0 else least(1.0, 2*list_sum(list_transform(range(0, k + 1), lambda i: factorial(n::int)::double/(factorial(i::int)::double*factorial((n-i)::int)::double)))/pow(2, n)) end, 9) as p from k"""
)
def sign_test(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_discount").alias("ea"), F.col("l_tax").alias("eb"))
    w = S.wins(rows, "key")
    return w.select("key", "wins_a", "wins_b", F.round(S.sign_test_p("wins_a", "wins_b"), 9).alias("p"))


N_BOOT, N_BLOCK_BOOT = 100, 400
_BOOT = f"""{PAIRS}, f as (select *, row_number() over (partition by unit order by dur) - 1 as i, count(*) over (partition by unit) as n from pairs),
draws as (select unit, boot_id, ('0x' || substr(md5('0:' || boot_id || ':' || slot), 1, 8))::bigint % n as i from (select distinct unit, n from f) s, range({N_BOOT}) b(boot_id), lateral (select unnest(range(n)) as slot)),
boot as (select d.unit, d.boot_id, sum(ea*weight)/sum(weight) - sum(eb*weight)/sum(weight) as diff from draws d join f on f.unit = d.unit and f.i = d.i group by all)"""


@query(_BOOT + " select unit, round(quantile_cont(diff, 0.025), 6) as lo, round(quantile_cont(diff, 0.975), 6) as hi from boot group by unit")
def bootstrap_ci(spark, d):
    got = S.interval(S.bootstrap(_pairs(spark, d), "unit", ["dur"], N_BOOT), "unit")
    return got.select("unit", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_TIMES = " + ".join(f"(u >= {p!r})::int" for p in S._POISSON)


@query(
    PAIRS
    + f""", u as (select pairs.*, boot_id, (('0x' || substr(md5('0:' || boot_id || ':' || dur || ':' || unit), 1, 8))::bigint + 0.5)::double/4294967296.0::double as u from pairs, range({N_BOOT}) b(boot_id)),
    w as (select *, ({_TIMES})*weight as w from u), boot as (select unit, boot_id, sum(ea*w)/sum(w) - sum(eb*w)/sum(w) as diff from w where w > 0 group by all)
    select unit, round(quantile_cont(diff, 0.025), 6) as lo, round(quantile_cont(diff, 0.975), 6) as hi from boot group by unit"""
)
def poisson_ci(spark, d):
    got = S.interval(S.poisson_bootstrap(_pairs(spark, d), "unit", ["dur", "unit"], N_BOOT), "unit")
    return got.select("unit", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(_BOOT + " select unit, round(avg((diff > 0)::int), 6) as favour from boot group by unit")
def favour_share(spark, d):
    return S.interval(S.bootstrap(_pairs(spark, d), "unit", ["dur"], N_BOOT), "unit").select("unit", F.round("favour", 6).alias("favour"))


@query(
    f"""with e as (select event_type as key, row_number() over (partition by event_type order by event_id) - 1 as pos, (value > 50)::int as err from events),
    s as (select key, pos, sum(err) over (partition by key order by pos) as total from e), n as (select key, count(*) as n, count(*)//200 as k from e group by key),
    d as (select key, k, boot_id, ('0x' || substr(md5('0:' || boot_id || ':' || slot), 1, 8))::bigint % (n - 200) as s from n, range({N_BLOCK_BOOT}) b(boot_id), lateral (select unnest(range(k)) as slot) where n >= 400),
    r as (select d.key, boot_id, sum(x.total - coalesce(y.total, 0)) / (max(k)*200.0) as rate from d join s x on x.key = d.key and x.pos = d.s + 199 left join s y on y.key = d.key and y.pos = d.s - 1 group by all)
    select n.key, round(quantile_cont(rate, 0.025), 6) as lo, round(quantile_cont(rate, 0.975), 6) as hi from n left join r using (key) group by n.key"""
)
def block_bootstrap(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("key"), "event_id", (F.col("value") > 50).cast("int").alias("err"))
    rows = scan.number(rows, ["key"], ["event_id"], "pos")
    got = S.block_bootstrap(rows, "key", "pos", "err", N_BLOCK_BOOT)
    return got.select("key", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("select n, (factorial((2*n - 1)::int) // (factorial(n::int) * factorial((n - 1)::int)))::varchar as resamples from (select distinct l_linenumber as n from lineitem)")
def resample_count(spark, d):
    n = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    return n.select("n", S.distinct_resamples("n").alias("resamples"))


@query(
    """select l_returnflag as unit, floor(l_orderkey/7)::bigint as block, round(7/sum(l_quantity), 6) as rate from
    (select l_returnflag, l_quantity, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as l_orderkey from lineitem) group by all having count(*) = 7"""
)
def block_rate(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = scan.number(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("unit"), *order, "l_quantity"), ["unit"], order, "step")
    return S.block_rate(rows, "unit", "step", "l_quantity", 7).select("unit", "block", F.round("rate", 6).alias("rate"))


@query(
    """with r as (select p_size, l_returnflag as label, round(avg(l_discount), 6) as v from lineitem join part on p_partkey = l_partkey group by all),
    o as (select p_size, list_aggregate(list_transform(list_sort(list({'v': v, 'label': label})), lambda s: s.label), 'string_agg', ',') as ranking from r group by p_size)
    select count(distinct ranking) as orders, count(distinct ranking) = 1 as stable from o"""
)
def min_cut_sensitivity(spark, d):
    part = read(spark, d, "part").select("p_size", F.col("p_partkey").alias("l_partkey"))
    rates = read(spark, d, "lineitem").join(part, "l_partkey").groupBy("p_size", F.col("l_returnflag").alias("label")).agg(F.round(F.avg("l_discount"), 6).alias("v"))
    return S.rank_stability(rates, "p_size", "label", "v")
