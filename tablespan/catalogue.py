"""The registered queries over the sample tables, each with its SQL oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespan.engine import EngineOptions, TableEngine
from tablespan.functions.numbers import is_finite, is_whole
from tablespan.functions.text import cell_text, display, number_of, with_normalised
from tablespan.operators import filters, index, sorting, stats
from tablespan.plans import planner
from tablespan.plans.stages import stage, with_positions
from tablespan.sources import generate, tables
from tablespan.streaming.filters import filter_stream, run_to_end

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def engine(spark: SparkSession, sf_dir: str, name: str, key: str, **options: bool) -> TableEngine:
    return TableEngine(spark, EngineOptions(**options)).load(table(spark, sf_dir, name), key)


def saved_engine(spark: SparkSession, sf_dir: str, name: str, key: str, **indexes: list[str]) -> TableEngine:
    """An engine over a table that was saved with its indexes in the shared folder."""
    stage(spark.range(1))  # the shared folder is known from here on
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    tables.save(table(spark, sf_dir, name), path, key, **indexes)
    return TableEngine(spark).load_saved(path, key)


# filters


@query("""select o_orderkey, o_orderpriority, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as pos
from orders where contains(lower(o_orderpriority), 'med') and contains(cast(o_orderkey as varchar), '12')""")
def filter_sort_flagship(spark, sf_dir):
    found = engine(spark, sf_dir, "orders", "o_orderkey").filter_sort({"o_orderpriority": " Med ", "o_orderkey": "12"}, [("o_totalprice", "desc")])
    return found.with_positions(["o_orderkey", "o_orderpriority", "o_totalprice"])


flagship = filter_sort_flagship


@query("select c_custkey, c_mktsegment from customer where contains(lower(c_mktsegment), 'build')")
def filter_contains_ci(spark, sf_dir):
    return engine(spark, sf_dir, "customer", "c_custkey").filter({"c_mktsegment": "  BuIlD "}).df.select("c_custkey", "c_mktsegment")


@query("select c_custkey from customer where contains(cast(c_custkey as varchar), '12')")
def filter_int_text(spark, sf_dir):
    return engine(spark, sf_dir, "customer", "c_custkey").filter({"c_custkey": 12}).df.select("c_custkey")


@query(r"select o_orderkey, o_totalprice from orders where contains(regexp_replace(cast(o_totalprice as varchar), '[.]0$', ''), '44.0')")
def filter_double_text(spark, sf_dir):
    return engine(spark, sf_dir, "orders", "o_orderkey").filter({"o_totalprice": "44.0"}).df.select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_orderdate from orders where contains(cast(o_orderdate as varchar), '1997-0')")
def filter_timestamp_text(spark, sf_dir):
    return engine(spark, sf_dir, "orders", "o_orderkey").filter({"o_orderdate": "1997-0"}).df.select("o_orderkey", "o_orderdate")


@query("""select o_orderkey from orders where contains(lower(o_orderpriority), 'i') and contains(lower(o_orderstatus), 'f')
and contains(cast(o_custkey as varchar), '1')""")
def filter_conjunction(spark, sf_dir):
    return engine(spark, sf_dir, "orders", "o_orderkey").filter({"o_orderpriority": "I", "o_orderstatus": "f", "o_custkey": "1"}).df.select("o_orderkey")


@query("""with e as (select event_id, case event_id % 3 when 0 then '100%_x' when 1 then 'a_b' else 'a' || chr(92) || 'b%c' end as mark from events)
select event_id, needle from e, (values ('%_'), ('_'), ('%'), (chr(92))) t(needle) where contains(mark, needle)""")
def filter_literal_wildcards(spark, sf_dir):
    i = F.col("event_id") % 3
    events = table(spark, sf_dir, "events").select("event_id", F.when(i == 0, "100%_x").when(i == 1, "a_b").otherwise("a\\b%c").alias("mark"))
    found = None
    for n in ("%_", "_", "%", "\\"):
        part = filters.filter_rows(events, {"mark": n}).select("event_id", F.lit(n).alias("needle"))
        found = part if found is None else found.unionByName(part)
    return found


@query("select c_custkey from customer")
def filter_empty_is_all(spark, sf_dir):
    return engine(spark, sf_dir, "customer", "c_custkey").filter({"c_name": " \t ", "c_mktsegment": None}).df.select("c_custkey")


@query("select c_custkey, c_name from customer where contains(lower(c_name), 'no such name')")
def filter_no_match(spark, sf_dir):
    return engine(spark, sf_dir, "customer", "c_custkey").filter_sort({"c_name": "no such name"}, ["c_name"]).df.select("c_custkey", "c_name")


@query("select p_partkey, p_type from part where contains(lower(p_type), 'economy')")
def filter_single(spark, sf_dir):
    return engine(spark, sf_dir, "part", "p_partkey").filter_one("p_type", "Economy").df.select("p_partkey", "p_type")


@query("select p_partkey from part where contains(lower(p_type), 'economy') and contains(lower(p_brand), '1')")
def filter_within_base(spark, sf_dir):
    e = engine(spark, sf_dir, "part", "p_partkey")
    return e.filter({"p_brand": "1"}, base=e.filter({"p_type": "economy"}).df).df.select("p_partkey")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'red')")
def filter_refine(spark, sf_dir):
    e = engine(spark, sf_dir, "part", "p_partkey", reuse_previous=True)
    e.filter({"p_name": "re"})
    return e.filter({"p_name": "red"}).df.select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ed')")
def filter_dictionary_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return filters.filter_by_dictionary(part, index.distinct_keys(part, "p_name"), "p_name", "ED").select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'red') and contains(lower(p_type), 'promo')")
def filter_refined_keys(spark, sf_dir):
    e = saved_engine(spark, sf_dir, "part", "p_partkey", indexed=["p_name", "p_type"])
    e.filter({"p_name": "re", "p_type": "promo"})
    return e.filter({"p_name": "red", "p_type": "promo"}).df.select("p_partkey", "p_name")


@query("select p_partkey as row_id from part where contains(lower(p_brand), '3') and contains(lower(p_type), 'promo')")
def filter_postings_intersect(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return index.intersect([index.matching_rows(index.postings(part, c, "p_partkey"), n) for c, n in (("p_brand", "3"), ("p_type", "promo"))])


@query("select p_partkey as row_id from part where contains(lower(p_brand), '3') or contains(lower(p_type), 'promo')")
def filter_postings_union(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return index.union([index.matching_rows(index.postings(part, c, "p_partkey"), n) for c, n in (("p_brand", "3"), ("p_type", "promo"))])


@query("""with r as (select *, row_number() over (order by o_orderkey) - 1 as row_id, count(*) over () as n from orders),
k as (select *, least(2048, n) as k from r),
s as (select * from k where exists (select 1 from (select cast(ceil((row_id * 2 * k - n) / (2.0 * n)) as bigint) as i) t
  where i >= 0 and i < k and cast(floor((2 * i + 1) * n / (2.0 * k)) as bigint) = row_id) or k = n)
select 'o_orderpriority' as column_name, cast(sum(case when contains(lower(o_orderpriority), 'high') then 1 else 0 end) as bigint) as hits from s
union all select 'o_custkey', cast(sum(case when contains(cast(o_custkey as varchar), '7') then 1 else 0 end) as bigint) from s""")
def filter_planner_sample(spark, sf_dir):
    rows = tables.with_row_id(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return planner.sample_hits(rows, {"o_orderpriority": "high", "o_custkey": "7"}, "row_id", rows.count())


@query("select c_custkey from customer where contains(lower(c_mktsegment), 'auto')")
def filter_cached(spark, sf_dir):
    e = engine(spark, sf_dir, "customer", "c_custkey", result_cache=True)
    e.filter({"c_mktsegment": "auto"})
    return e.filter({"c_mktsegment": "AUTO "}).df.select("c_custkey")


@query("select count(*) as n_rows from lineitem where contains(lower(l_returnflag), 'r')")
def filter_count(spark, sf_dir):
    return filters.filter_rows(table(spark, sf_dir, "lineitem"), {"l_returnflag": "R"}).agg(F.count("*").alias("n_rows"))


@query("""select cast(min(l_orderkey) as bigint) as first_key, count(*) as n_rows, cast(sum(l_linenumber) as bigint) as lines from lineitem
where contains(regexp_replace(cast(l_extendedprice as varchar), '[.]0$', ''), '99') and contains(lower(l_linestatus), 'o')""")
def filter_wide_scan(spark, sf_dir):
    found = filters.filter_rows(table(spark, sf_dir, "lineitem"), {"l_extendedprice": "99", "l_linestatus": "O"})
    return found.agg(F.min("l_orderkey").alias("first_key"), F.count("*").alias("n_rows"), F.sum("l_linenumber").alias("lines"))


@query("select count(distinct lower(p_name)) as n_keys from part where contains(lower(p_name), 'a')")
def filter_matched_keys(spark, sf_dir):
    return index.matched_keys(index.postings(table(spark, sf_dir, "part"), "p_name", "p_partkey"), "a")


@query("select c_custkey, c_mktsegment from customer where contains(lower(c_mktsegment), 'house')")
def filter_ignore_unknown(spark, sf_dir):
    return engine(spark, sf_dir, "customer", "c_custkey").filter({"c_mktsegment": "house", "nowhere": "x"}, on_unknown="ignore").df.select("c_custkey", "c_mktsegment")


# sorts


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 as pos from orders")
def sort_single_asc(spark, sf_dir):
    return sorting.sorted_positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], ["o_orderkey"]).select("o_orderkey", "o_totalprice", "pos")


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as pos from orders")
def sort_single_desc(spark, sf_dir):
    return sorting.sorted_positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc")], ["o_orderkey"]).select("o_orderkey", "o_totalprice", "pos")


@query("select o_orderkey, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) - 1 as pos from orders")
def sort_multi_mixed(spark, sf_dir):
    e = engine(spark, sf_dir, "orders", "o_orderkey")
    return e.sort(["o_orderpriority", ("o_totalprice", "desc"), ("o_orderpriority", "desc")]).with_positions(["o_orderkey"])


@query("select p_partkey, row_number() over (order by lower(p_name), p_name, p_partkey) - 1 as pos from part")
def sort_string_ci(spark, sf_dir):
    return sorting.sorted_positions(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"], ["p_partkey"]).select("p_partkey", "pos")


@query("select p_partkey, row_number() over (order by p_name desc, p_partkey) - 1 as pos from part")
def sort_string_cs(spark, sf_dir):
    return sorting.sorted_positions(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [("p_name", "desc")], ["p_partkey"], case_sensitive=True).select("p_partkey", "pos")


@query("""with e as (select event_id, case when event_id % 7 = 0 then null when event_id % 11 = 0 then cast('nan' as double)
when event_id % 13 = 0 then cast('infinity' as double) else value end as v from events)
select event_id, row_number() over (order by v asc nulls last, event_id) - 1 as pos_asc,
row_number() over (order by v desc nulls first, event_id) - 1 as pos_desc from e""")
def sort_nulls_nan(spark, sf_dir):
    i = F.col("event_id")
    v = F.when(i % 7 == 0, None).when(i % 11 == 0, float("nan")).when(i % 13 == 0, float("inf")).otherwise(F.col("value"))
    events = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    up = sorting.sorted_positions(events, ["v"], ["event_id"], name="pos_asc").select("event_id", "pos_asc")
    return up.join(sorting.sorted_positions(events, [("v", "desc")], ["event_id"], name="pos_desc").select("event_id", "pos_desc"), "event_id")


@query("""select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) - 1 as pos from orders
where contains(lower(o_orderpriority), 'urgent')""")
def sort_filtered_subset(spark, sf_dir):
    return engine(spark, sf_dir, "orders", "o_orderkey").filter_sort({"o_orderpriority": "urgent"}, [("o_orderdate", "desc")]).with_positions(["o_orderkey"])


@query("select s_suppkey, row_number() over (order by s_suppkey) - 1 as pos from supplier")
def sort_default(spark, sf_dir):
    return engine(spark, sf_dir, "supplier", "s_suppkey").sort().with_positions(["s_suppkey"])


@query("select p_partkey, row_number() over (order by p_brand, p_size desc, p_partkey) - 1 as pos from part")
def sort_rank_tuple(spark, sf_dir):
    return engine(spark, sf_dir, "part", "p_partkey").sort_by_ranks(["p_brand", ("p_size", "desc")])


@query("select p_partkey, row_number() over (order by lower(p_type) desc, p_type desc, p_size, p_partkey) - 1 as pos from part")
def sort_from_saved_index(spark, sf_dir):
    e = saved_engine(spark, sf_dir, "part", "p_partkey", ordered=["p_type", "p_size"])
    ranked = e.sort([("p_type", "desc"), "p_size"], mode="precomputed")
    return ranked.with_positions(["p_partkey"])


@query("""select p_partkey, dense_rank() over (order by p_size) - 1 as rank_asc, dense_rank() over (order by p_size desc) - 1 as rank_desc from part""")
def sort_desc_via_rank(spark, sf_dir):
    return index.dense_ranks(table(spark, sf_dir, "part"), "p_size", "p_partkey")


@query("""select p_partkey, dense_rank() over (order by lower(p_type)) - 1 as rank_asc from part""")
def sort_from_dictionary(spark, sf_dir):
    return index.dense_ranks(table(spark, sf_dir, "part"), "p_type", "p_partkey", case_sensitive=False).select("p_partkey", "rank_asc")


@query("""select p_partkey, row_number() over (order by p_size, p_partkey) - 1 as pos from part where contains(lower(p_type), 'small')""")
def sort_selected_from_index(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kept = index.row_numbers(part, "p_size", "p_partkey").join(filters.filter_rows(part, {"p_type": "small"}), "p_partkey", "left_semi")
    return with_positions(kept.select("p_partkey", F.col("pos").alias("_full")), [F.col("_full")]).select("p_partkey", "pos")


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, dense_rank() over (order by l_extendedprice desc) - 1 as price_rank
from lineitem""")
def sort_wide_dense_rank(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").withColumn("_row", F.monotonically_increasing_id())
    lineitem = stage(lineitem.select("_row", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    ranks = index.dense_ranks(lineitem, "l_extendedprice", "_row").select("_row", F.col("rank_desc").alias("price_rank"))
    return lineitem.join(ranks, "_row").drop("_row")


# pages

_PAGE = """select o_orderkey, o_totalprice, pos from (select o_orderkey, o_totalprice,
row_number() over (order by o_totalprice desc, o_orderkey) - 1 as pos from orders) where pos >= {start} and pos < {end}"""


@query(_PAGE.format(start=0, end=15))
def page_top15(spark, sf_dir):
    return engine(spark, sf_dir, "orders", "o_orderkey").page(keys=[("o_totalprice", "desc")]).select("o_orderkey", "o_totalprice", "pos")


@query(_PAGE.format(start=100, end=115))
def page_offset(spark, sf_dir):
    return engine(spark, sf_dir, "orders", "o_orderkey").page(100, keys=[("o_totalprice", "desc")]).select("o_orderkey", "o_totalprice", "pos")


# index tables


@query("""select 'p_type' as column_name, key_lower, row_number() over (order by first_row) - 1 as value_id, value, first_row from
(select lower(p_type) as key_lower, arg_min(p_type, p_partkey) as value, min(p_partkey) as first_row from part group by 1)""")
def index_dictionary(spark, sf_dir):
    return index.dictionary(table(spark, sf_dir, "part"), "p_type", "p_partkey")


@query("""select 'c_mktsegment' as column_name, lower(c_mktsegment) as key_lower, count(*) as n_rows, min(c_custkey) as first_row, max(c_custkey) as last_row
from customer group by 2""")
def index_postings(spark, sf_dir):
    return index.posting_lengths(index.postings(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey"))


@query("""with r as (select count(*) as n_rows, count(distinct lower(p_name)) as a, count(distinct lower(p_type)) as b, count(distinct p_partkey) as c,
count(distinct p_size) as d from part), v as (select 'p_name' as column_name, n_rows, a as n_values, true as text from r
union all select 'p_type', n_rows, b, true from r union all select 'p_partkey', n_rows, c, false from r union all select 'p_size', n_rows, d, false from r)
select column_name, n_rows, n_values, n_values / n_rows as share,
case when n_values > 65535 then 'plain' when n_values / n_rows <= 0.2 then 'compact' when text then 'wide' else 'plain' end as choice from v""")
def index_dictionary_stats(spark, sf_dir):
    return index.dictionary_stats(table(spark, sf_dir, "part"), ["p_name", "p_type", "p_partkey", "p_size"], "p_partkey")


@query("select o_orderkey, dense_rank() over (order by o_orderdate) - 1 as rank_asc, dense_rank() over (order by o_orderdate desc) - 1 as rank_desc from orders")
def index_dense_rank(spark, sf_dir):
    return index.dense_ranks(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


@query("""select p_partkey, 'p_brand' as column_name, dense_rank() over (order by p_brand) - 1 as rank_asc, dense_rank() over (order by p_brand desc) - 1 as rank_desc from part
union all select p_partkey, 'p_retailprice', dense_rank() over (order by p_retailprice) - 1, dense_rank() over (order by p_retailprice desc) - 1 from part""")
def index_rank_columns(spark, sf_dir):
    return index.rank_columns(table(spark, sf_dir, "part"), ["p_brand", "p_retailprice"], "p_partkey")


@query("select o_orderkey, row_number() over (order by o_orderpriority, o_orderkey) - 1 as pos from orders")
def index_row_number(spark, sf_dir):
    return index.row_numbers(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query("select p_partkey, p_brand as value from part")
def index_value_decode(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    values = stage(index.dictionary(part, "p_brand", "p_partkey"))
    return index.decode(index.encode(part, "p_brand", values, "p_partkey"), values, "p_partkey")


@query("select c_custkey, c_name, c_mktsegment from customer where contains(lower(c_mktsegment), 'mach')")
def index_gather(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    ids = index.matching_rows(index.postings(customer, "c_mktsegment", "c_custkey"), "mach")
    return index.gather(customer, ids, "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


# aggregates


@query("""select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75, quantile_cont(value, 0.95) as p95 from events group by 1""")
def agg_percentile(spark, sf_dir):
    return stats.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("""select o_orderpriority, count(o_custkey) as runs, cast(sum(cast(o_custkey as double)) as double) as total,
sum(cast(o_custkey as double)) / count(o_custkey) as mean from orders group by 1""")
def agg_bench_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").cast("double").alias("v"))
    return stats.summary(orders, "v", ["o_orderpriority"])


# text and projection


@query(r"""select p_partkey, lower(p_name) as p_name_norm, regexp_replace(cast(p_retailprice as varchar), '[.]0$', '') as p_retailprice_norm from part""")
def text_normalise(spark, sf_dir):
    return with_normalised(table(spark, sf_dir, "part"), ["p_name", "p_retailprice"]).select("p_partkey", "p_name_norm", "p_retailprice_norm")


@query("""select cast(event_id as varchar) as event_id, coalesce(case when event_id % 3 = 0 then null else event_type end, '') as event_type from events""")
def project_columns(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"))
    return display(events, ["event_id", "event_type"])


@query("""select event_id, regexp_replace(cast(value as varchar), '[.]0$', '') as value_text from events""")
def text_of_numbers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", cell_text(events, "value").alias("value_text"))


@query("""with e as (select event_id, case event_id % 4 when 0 then cast(value as varchar) when 1 then 'n/a' when 2 then null else '-12' end as t from events)
select event_id, try_cast(t as double) as number, coalesce(try_cast(t as double) = floor(try_cast(t as double)), false) as whole from e""")
def text_to_number(spark, sf_dir):
    i = F.col("event_id") % 4
    text = F.when(i == 0, F.col("value").cast("string")).when(i == 1, "n/a").when(i == 3, "-12")
    events = table(spark, sf_dir, "events").select("event_id", number_of(text).alias("number"))
    return events.withColumn("whole", is_whole(F.col("number")))


@query("""with e as (select event_id, case when event_id % 5 = 0 then cast('nan' as double) when event_id % 7 = 0 then cast('-infinity' as double)
when event_id % 11 = 0 then null else value end as v from events)
select count(*) as n_rows, count(case when isfinite(v) then 1 end) as n_finite, count(case when isnan(v) then 1 end) as n_nan from e""")
def text_finite_counts(spark, sf_dir):
    i = F.col("event_id")
    v = F.when(i % 5 == 0, float("nan")).when(i % 7 == 0, float("-inf")).when(i % 11 == 0, None).otherwise(F.col("value"))
    events = table(spark, sf_dir, "events").select(v.alias("v"))
    return events.agg(F.count("*").alias("n_rows"), F.count_if(is_finite(F.col("v"))).alias("n_finite"), F.count_if(F.isnan("v")).alias("n_nan"))


# sources and sinks


@query("select c_custkey, row_number() over (order by c_name desc, c_custkey) - 1 as row_id from customer")
def source_row_ids(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return with_positions(customer, [F.desc("c_name"), F.col("c_custkey")], "row_id").select("c_custkey", "row_id")


@query("select event_id, event_type from events where contains(lower(event_type), 'c') and contains(lower(props), '9')")
def stream_filter(spark, sf_dir):
    """The same filters on a stream, written exactly once and read back."""
    stage(spark.range(1))
    path = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    run_to_end(filter_stream(stream, {"event_type": "C", "props": "9"}).select("event_id", "event_type"), f"{path}/out", f"{path}/state")
    return spark.read.schema("event_id long, event_type string").parquet(f"{path}/out")

_NAMES = [f"[{', '.join(repr(n) for n in names)}][1 + {at}]" for names, at in ((generate.FIRST_NAMES, "i % 8"), (generate.LAST_NAMES, "(i * 7) % 8"))]
_RULES = ", ".join(f"((i + 1) * {m} + {a}) % {n} as {c}" for c, (m, a, n) in generate.RULES.items())


@query(f"""select i as row_id, i + 1 as index, {_NAMES[0]} as "firstName", {_NAMES[1]} as "lastName", cast(18 + i % 82 as integer) as age, {_RULES}
from (select range as i from range(20000))""")
def generate_table(spark, sf_dir):
    return generate.fixed_table(spark, 20_000)


@query("""select i as row_id, i + 1 as index, 20000 - (i + 1) as column6, (i + 1) * 2 as column7, (i + 1) * 2 - 1 as column8, true as inside
from (select range as i from range(20000))""")
def generate_random_rules(spark, sf_dir):
    made = generate.random_table(spark, 20_000, seed=3)
    drawn = [f"column{n}" for n in (5, *range(9, 16))]
    inside = F.col("age").between(18, 99)
    for c in drawn:
        inside &= F.col(c).between(0, 20_000)
    return made.select("row_id", "index", "column6", "column7", "column8", inside.alias("inside"))


@query("select * from customer")
def io_roundtrip(spark, sf_dir):
    stage(spark.range(1))  # the shared folder is known from here on
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    tables.save(table(spark, sf_dir, "customer"), path, "c_custkey", normalise=["c_name"])
    return tables.load(spark, path)


@query("""select key_lower, count(*) as n_rows from (select lower(c_mktsegment) as key_lower from customer) group by 1""")
def io_index_roundtrip(spark, sf_dir):
    stage(spark.range(1))
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    tables.save(table(spark, sf_dir, "customer"), path, "c_custkey", indexed=["c_mktsegment"])
    saved = tables.load_index(spark, path, "postings", "c_mktsegment")
    return saved.groupBy("key_lower").agg(F.count("*").alias("n_rows"))
