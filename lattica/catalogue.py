"""The library's operators as queries over the driver's tables, each with DuckDB SQL for the same rows.

People, movies, diseases and proteins of a knowledge graph are played by customers, orders, parts and suppliers; edges
are line items or event sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica import providers
from lattica.functions import metrics, text
from lattica.operators import algorithms, graph, retrieval, tabular
from lattica.plans import rag, testsets
from lattica.plans.lineage import cut, partitions
from lattica.session import ship
from lattica.sources import readers
from lattica.streaming.ingest import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (table reader) -> DataFrame under its name, with its SQL if it has one."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: ship(spark).read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- patterns and predicates


@query("""
select o_orderkey, o_orderstatus, count(*) as hits, string_agg(p_brand, ', ' order by p_brand) as brands
from (select distinct l_orderkey, p_brand from lineitem join part on l_partkey = p_partkey where p_brand in ('Brand#1', 'Brand#5', 'Brand#12', 'Brand#17', 'Brand#23')) x
join orders on o_orderkey = l_orderkey group by all order by hits desc, o_orderkey limit 5""")
def symptom_match(t):
    wanted = t("part").where(F.col("p_brand").isin("Brand#1", "Brand#5", "Brand#12", "Brand#17", "Brand#23")).select("p_partkey", "p_brand")
    shown = t("lineitem").select("l_orderkey", "l_partkey").join(wanted, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()
    found = shown.join(t("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    counted = found.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_list("p_brand")), ", ").alias("brands"))
    return counted.orderBy(F.desc("hits"), "o_orderkey").limit(5)


@query("""select c_name, o_orderkey, l_partkey, l_quantity, l_shipdate from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where c_mktsegment = 'BUILDING' and l_returnflag = 'R'""")
def one_hop_props(t):
    c = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("a_id"), "c_name")
    e = t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    lines = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("b_id"), "l_partkey", "l_quantity", "l_shipdate")
    return graph.hop(c, e, lines).select("c_name", F.col("dst").alias("o_orderkey"), "l_partkey", "l_quantity", "l_shipdate")


@query("""select o_orderkey, strftime(o_orderdate, '%Y') as released from orders where '2000' > strftime(o_orderdate, '%Y') and strftime(o_orderdate, '%Y') > '1996'""")
def chained_range(t):
    o = t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("released"))
    return o.where((F.lit("2000") > F.col("released")) & (F.col("released") > "1996"))


@query("""select p_partkey, p_name, starts_with(lower(p_name), 'small') as small, ends_with(p_name, 'bolt') as bolt, contains(upper(p_name), 'RING') as ring from part where starts_with(lower(p_name), 'small') or ends_with(p_name, 'bolt') or contains(upper(p_name), 'RING')""")
def prefix_filters(t):
    p = t("part").select("p_partkey", "p_name", F.lower("p_name").startswith("small").alias("small"), F.col("p_name").endswith("bolt").alias("bolt"), F.upper("p_name").contains("RING").alias("ring"))
    return p.where("small or bolt or ring")


@query("""
select s_suppkey, len(brands) as n, array_to_string(brands, ',') as brands from (
    select s_suppkey, list_sort(list(distinct p_brand)) as brands from supplier join lineitem on s_suppkey = l_suppkey join part on p_partkey = l_partkey where s_nationkey in (1, 3, 5, 7) group by 1)
where list_contains(brands, 'Brand#7') and len(brands) > 1""")
def in_list_props(t):
    s = t("supplier").where(F.col("s_nationkey").isin(1, 3, 5, 7)).select("s_suppkey")
    e = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    b = s.join(e, F.col("s_suppkey") == F.col("l_suppkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    b = b.groupBy("s_suppkey").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))
    return b.where(F.array_contains("brands", "Brand#7") & (F.size("brands") > 1)).select("s_suppkey", F.size("brands").cast("long").alias("n"), F.array_join("brands", ",").alias("brands"))


@query("""
with e as (select l_suppkey as src, l_partkey as dst, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as eid from lineitem)
select a.src as p, b.src as q, count(*) as parts from e a join e b on a.dst = b.dst and a.eid <> b.eid group by 1, 2""")
def co_occurrence(t):
    return graph.co_occurrence_counts(t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))).withColumnRenamed("n", "parts")


@query("""select distinct o_custkey from orders o where o_orderstatus = 'P' and not exists (select 1 from orders x where x.o_custkey = o.o_custkey and x.o_orderstatus = 'F')""")
def wrote_not_directed(t):
    o = t("orders").select("o_custkey", "o_orderstatus")
    return o.where("o_orderstatus = 'P'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'F'"), "o_custkey", "left_anti")


_FRIENDS = "with f as (select distinct src, dst from (select user_id as src, lead(user_id) over (partition by cast(ts as date) order by event_id) as dst from events) where dst is not null and src <> dst) "


def _friends(t) -> DataFrame:
    w = Window.partitionBy(F.to_date("ts")).orderBy("event_id")
    e = t("events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    return e.where("dst is not null and src <> dst").distinct()


@query(_FRIENDS + "select dst as friend from f where src = 7")
def friends(t):
    return _friends(t).where("src = 7").select(F.col("dst").alias("friend"))


@query(_FRIENDS + "select src as person from f where dst = 7")
def friends_of(t):
    return _friends(t).where("dst = 7").select(F.col("src").alias("person"))


@query(_FRIENDS + "select b.dst as friend, count(*) as ways from f a join f b on a.dst = b.src where a.src = 7 and b.dst <> 7 group by 1")
def fof(t):
    return tabular.friends_of_friends(_friends(t), F.lit(7)).groupBy("friend").agg(F.count("*").alias("ways"))


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_acctbal > 5000")
def named_parameters(t):
    c = t("customer")
    return c.sparkSession.sql("select c_custkey, c_name from {c} where c_mktsegment = :segment and c_acctbal > :least", args={"segment": "BUILDING", "least": 5000.0}, c=c)


@query("select c_name || ' -[' || o_orderstatus || ']-> ' || o_orderkey as path from customer join orders on c_custkey = o_custkey")
def path_rows(t):
    a = t("customer").select(F.col("c_custkey").alias("a_id"), "c_name")
    e = t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderstatus").alias("type"))
    path = F.struct(F.col("c_name").alias("a"), F.col("type").alias("r"), F.col("dst").alias("b"))
    found = graph.hop(a, e, t("orders").select(F.col("o_orderkey").alias("b_id"))).select(path.alias("p"))
    return found.select(F.concat("p.a", F.lit(" -["), "p.r", F.lit("]-> "), F.col("p.b").cast("string")).alias("path"))


@query("select p_partkey, p_name from part order by p_partkey limit 50")
def first_rows(t):
    return readers.first_rows(t("part").select("p_partkey", "p_name"), 50, "p_partkey")


@query("""with c as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') as t from documents) select (len(t) / 100)::bigint as hundreds, count(*) as n from (select doc_id, len(t) - len(t) % 100 as l, t from c) where l >= 0 group by (len(t) - len(t) % 100) / 100, 1""".replace("(len(t) / 100)::bigint", "((len(t) - len(t) % 100) / 100)::bigint"))
def word_counts(t):
    n = F.size(text.words(F.col("text")))
    return t("documents").select(F.floor(n / 100).cast("long").alias("hundreds")).groupBy("hundreds").agg(F.count("*").alias("n"))


# ---- tables


@query("""
select distinct l_orderkey, l_linenumber, a.p_name as part_name, coalesce(b.p_type, 'N/A') as part_type, coalesce(s.s_name, 'N/A') as supplier_name, coalesce(r.s_name, 'N/A') as rich_name
from lineitem left join part a on a.p_partkey = l_partkey left join (select * from part where p_size > 25) b on b.p_partkey = l_partkey
left join supplier s on s.s_suppkey = l_suppkey left join (select * from supplier where s_acctbal > 5000) r on r.s_suppkey = l_suppkey
order by l_orderkey, l_linenumber, part_name, part_type, supplier_name, rich_name limit 10""")
def feature_enrich(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = tabular.enrich(rows, t("part"), "l_partkey", "p_partkey", ["p_name"], "a_")
    rows = tabular.enrich(rows, t("part").where("p_size > 25"), "l_partkey", "p_partkey", ["p_type"], "b_")
    rows = tabular.enrich(rows, t("supplier"), "l_suppkey", "s_suppkey", ["s_name"], "c_")
    rows = tabular.enrich(rows, t("supplier").where("s_acctbal > 5000"), "l_suppkey", "s_suppkey", ["s_name"], "d_")
    names = {"a_p_name": "part_name", "b_p_type": "part_type", "c_s_name": "supplier_name", "d_s_name": "rich_name"}
    rows = rows.withColumnsRenamed(names).select("l_orderkey", "l_linenumber", *names.values()).distinct().fillna("N/A", list(names.values())[1:])
    return rows.orderBy(*rows.columns).limit(10)


@query("select distinct o_orderstatus, o_orderpriority from orders")
def relation_map(t):
    return t("orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("select p_brand, p_type, count(*) as n from part where p_brand is not null and p_type is not null group by 1, 2")
def type_counts(t):
    return tabular.group_sizes(t("part"), "p_brand", "p_type")


@query("select p_type, arg_min(p_name, p_partkey) as p_name, arg_min(p_size, p_partkey) filter (p_size is not null) as p_size from part where p_type is not null group by 1")
def first_by_type(t):
    return tabular.first_by_group(t("part"), "p_type", ["p_name", "p_size"], F.col("p_partkey"))


@query("select c_mktsegment, count(*) as n from customer where c_mktsegment is not null group by 1")
def value_counts(t):
    return tabular.value_counts(t("customer"), "c_mktsegment")


# ---- mutations


def _events(t) -> DataFrame:
    return t("events").select(F.col("user_id").alias("id"), "event_type", "value", F.col("event_id").alias("ord"))


@query("select id, kind, first_value from (select user_id as id, arg_min(event_type, event_id) as kind, arg_min(value, event_id) as first_value from events where event_type <> 'signup' group by 1) where id not in (select user_id from events where event_type = 'signup') union all select user_id as id, 'signup' as kind, min(value) as first_value from events where event_type = 'signup' group by 1")
def merge_nodes(t):
    e = _events(t)
    had = e.where("event_type = 'signup'").groupBy("id").agg(F.min("value").alias("first_value")).select("id", F.lit("signup").alias("kind"), "first_value")
    new = e.where("event_type <> 'signup'").select("id", F.col("event_type").alias("kind"), F.col("value").alias("first_value"), "ord")
    return graph.merge_nodes(had, new, ["id"], "ord")


@query("select distinct user_id as src, event_type as type, event_id % 50 as dst from events")
def merge_edges(t):
    e = t("events").select(F.col("user_id").alias("src"), F.col("event_type").alias("type"), (F.col("event_id") % 50).alias("dst"))
    return graph.merge_edges(graph.merge_edges(None, e.where("src < 50")), e)


@query("""select user_id as id, arg_max(event_type, event_id) filter (event_type <> 'view') as last_kind, arg_max(value, event_id) filter (value > 20) as last_value, arg_min(value, event_id) filter (value > 20) as first_value from events group by 1""")
def merge_last_write(t):
    e = _events(t).select("id", "ord", F.when(F.col("event_type") != "view", F.col("event_type")).alias("last_kind"), F.when(F.col("value") > 20, F.col("value")).alias("last_value"))
    first = graph.first_write(e.withColumnRenamed("last_value", "first_value"), ["id"], ["first_value"], "ord")
    return graph.last_write(e, ["id"], ["last_kind", "last_value"], "ord").join(first, "id")


@query("""
with had as (select distinct user_id as id from events where event_type = 'signup'), new as (select distinct user_id as id from events where event_type = 'purchase')
select id, case when h.id is null then 'created' when n.id is not null then 'matched' else 'old' end as state, case when n.id is not null then 1 else 0 end as touched
from had h full join new n using (id)""")
def on_create_on_match(t):
    e = _events(t)
    had = e.where("event_type = 'signup'").select("id").distinct().select("id", F.lit("old").alias("state"), F.lit(0).alias("touched"))
    new = e.where("event_type = 'purchase'").select("id").distinct()
    return graph.merge_with_actions(had, new, "id", {"state": F.lit("created")}, {"state": F.lit("matched")}, {"touched": F.lit(1)})


@query("""
select node, count(*) as edges from (select page_id, trim(unnest(string_split(regexp_replace(split_part(url, '://', 2), '[/?#].*$', ''), '.')), ' ' || chr(9)) as node from pages) group by 1""")
def split_unwind_merge(t):
    host = F.regexp_replace(F.split_part("url", F.lit("://"), F.lit(2)), r"[/?#].*$", "")
    parts = t("pages").select("page_id", F.explode(F.split(host, r"\.")).alias("node")).select("page_id", text.trim_white(F.col("node")).alias("node"))
    return parts.groupBy("node").agg(F.count("*").alias("edges"))


@query("""
select page_id, regexp_replace(url, '^(.*)://', '') as rest, nullif(regexp_extract(url, '/(\\d+)', 1), '') as number, nullif(regexp_extract(url, '\\?(\\w+)=', 1), '') as option, 'page:' || nullif(regexp_extract(url, '^(https?)', 1), '') as scheme from pages""".replace("\\\\", "\\"))
def regex_enrich(t):
    u = F.col("url")
    return t("pages").select("page_id", F.regexp_replace(u, r"^(.*)://", "").alias("rest"), text.captured(u, r"/(\d+)").alias("number"), text.captured(u, r"\?(\w+)=").alias("option"), F.concat(F.lit("page:"), text.captured(u, "^(https?)")).alias("scheme"))


@query("select o_orderkey, case o_orderstatus when 'P' then 'pending' when 'F' then 'finished' end as status_name, case when starts_with(o_orderpriority, '1') then 'first' when starts_with(o_orderpriority, '2') then 'second' end as place from orders")
def case_dictionary(t):
    p = F.col("o_orderpriority")
    return t("orders").select("o_orderkey", text.coded(F.col("o_orderstatus"), {"P": "pending", "F": "finished"}).alias("status_name"), F.when(p.startswith("1"), "first").when(p.startswith("2"), "second").alias("place"))


def _people(t) -> graph.PropertyGraph:
    nodes = t("customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("Customer")).alias("labels"), F.col("c_name").alias("name"))
    return graph.PropertyGraph(nodes, t("orders").select(F.col("o_custkey").alias("src"), (-1 - F.col("o_orderkey")).alias("dst"), F.col("o_orderstatus").alias("type")))


@query("select c_custkey as id, c_name as name, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') then 'Customer|Pending' else 'Customer' end as labels from customer")
def label_semi(t):
    g = _people(t)
    marked = graph.add_label(g.nodes, g.of_type("P").select(F.col("src").alias("id")), "Pending")
    return marked.select("id", "name", F.array_join("labels", "|").alias("labels"))


@query("select o_custkey as src, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0) and o_orderstatus in ('F', 'O') group by 1")
def detach_delete(t):
    g = _people(t)
    left = g.delete(t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))
    return left.of_type("F", "O").groupBy("src").agg(F.count("*").alias("n"))


@query("select c_custkey as id from customer where not exists (select 1 from events where user_id = c_custkey)")
def unused_nodes(t):
    used = graph.add_label(_people(t).nodes, t("events").select(F.col("user_id").alias("id")), "Used")
    return used.where(~F.array_contains("labels", "Used") & F.array_contains("labels", "Customer")).select("id")


@query("select 'Customer' as src_label, o_orderstatus as type, 'Order' as dst_label from orders where o_custkey in (select c_custkey from customer) group by 2")
def schema_graph(t):
    g = _people(t)
    nodes = g.nodes.select(F.concat(F.lit("c"), "id").alias("id"), "labels").unionByName(t("orders").select(F.concat(F.lit("o"), -1 - F.col("o_orderkey")).alias("id"), F.array(F.lit("Order")).alias("labels")))
    return graph.PropertyGraph(nodes, g.edges.select(F.concat(F.lit("c"), "src").alias("src"), F.concat(F.lit("o"), "dst").alias("dst"), "type")).schema_graph()


@query("""select c_custkey as id, concat_ws(',', case when c_acctbal >= 0 then 'balance' end, 'name', case when c_nationkey % 2 = 0 then 'nation' end, 'segment') as keys from customer
union all select -1 - s_suppkey, concat_ws(',', 'name', case when s_nationkey > 3 then 'nation' end) from supplier""")
def node_keys(t):
    optional = lambda value, given: F.when(given, value.cast("string"))
    c = t("customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("Customer")).alias("labels"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), optional(F.col("c_nationkey"), F.col("c_nationkey") % 2 == 0)).alias("properties"))
    s = t("supplier").select((-1 - F.col("s_suppkey")).alias("id"), F.array(F.lit("Supplier")).alias("labels"), F.col("s_name").alias("name"), F.create_map(F.lit("nation"), optional(F.col("s_nationkey"), F.col("s_nationkey") > 3)).alias("properties"))
    g = graph.PropertyGraph(c.unionByName(s, allowMissingColumns=True), t("orders"))
    return g.node_keys("properties").select("id", F.array_join("keys", ",").alias("keys"))


@query("""with e as (select o_custkey as person, o_orderpriority as kind, min(o_orderkey) as id from orders where o_orderstatus = 'F' group by all),
n as (select o_custkey as person, o_orderpriority as kind, min(o_orderkey) as id from orders group by all)
select person, kind, coalesce(e.id, n.id) as id, e.id is null as created from n left join e using (person, kind)""")
def constraint_merge(t):
    rows = t("orders").select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    old = rows.where("o_orderstatus = 'F'").groupBy("person", "kind").agg(F.min("id").alias("id")).withColumn("created", F.lit(False))
    declared = graph.Catalogue().declare("Habit", "person", "kind", required=True)
    return declared.merge("Habit", old, rows.select("person", "kind", "id", F.lit(True).alias("created"), F.col("id").alias("o")), "o")


@query("""select key from (select unnest(['name', 'balance', 'debt', 'never']) as key, unnest([count(c_name), count(c_acctbal), count(case when c_acctbal < -1000000 then 1 end), 0]) as n from customer) where n > 0""")
def property_keys(t):
    debt = F.when(F.col("c_acctbal") < -1_000_000, F.col("c_acctbal")).alias("debt")
    nodes = t("customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("Customer")).alias("labels"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), debt, F.lit(None).cast("string").alias("never"))
    return graph.PropertyGraph(nodes, t("orders")).property_keys()


@query("select c_custkey as id, case when c_mktsegment = 'MACHINERY' then null else c_name end as name, case when c_acctbal > 5000 then 'rich' end as tier from customer")
def set_remove_property(t):
    n = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment", "c_acctbal")
    n = graph.set_property(n, "tier", F.lit("rich"), F.col("c_acctbal") > 5000)
    return graph.remove_property(n, "name", F.col("c_mktsegment") == "MACHINERY").select("id", "name", "tier")


@query("select c_custkey as id, case when n > 0 then n else -1 end as orders from (select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1)")
def write_back_counts(t):
    nodes = t("customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("orders"))
    counts = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"))
    return graph.write_back(nodes, counts, ["orders"])


@query("select 'orders' as name, count(*) = 0 as empty from orders union all select 'urgent returns', count(*) = 0 from orders where o_orderpriority = 'none of these'")
def emptiness_probe(t):
    probe = lambda name, rows: rows.limit(1).agg((F.count("*") == 0).alias("empty")).select(F.lit(name).alias("name"), "empty")
    return probe("orders", t("orders")).unionByName(probe("urgent returns", t("orders").where("o_orderpriority = 'none of these'")))


@query("select c_custkey as id from customer join orders on o_custkey = c_custkey where o_orderstatus = 'P'")
def any_endpoint(t):
    e = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return graph.connected(t("customer").select(F.col("c_custkey").alias("id")), e, "out")


@query("select c_custkey as id from customer left join (select * from orders where o_orderstatus = 'P') on o_custkey = c_custkey group by 1 having count(o_orderkey) = 0")
def no_pattern_by_count(t):
    e = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"))
    return graph.pattern_counts(t("customer").select(F.col("c_custkey").alias("id")), e).where("n = 0").select("id")


@query("select n_nationkey as id, n_name as name, 'Nation' as label from nation union all select r_regionkey, r_name, 'Region' from region")
def create_nodes(t):
    nations = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Nation").alias("label"))
    return graph.create_nodes(nations, t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("Region").alias("label")))


@query("select l_suppkey as src, l_partkey as dst, count(*) as n from lineitem where l_suppkey <> l_partkey group by 1, 2")
def simple_graph(t):
    return graph.simple(t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("select string_agg(p_brand, ',' order by p_brand) as brands, count(*) as n from (select distinct p_brand from part where p_brand is not null)")
def global_collect(t):
    return tabular.collected(t("part"), "p_brand").select(F.array_join("all", ",").alias("brands"), "n")


@query("""select * from (select c_custkey, len(s) as kinds from (select c_custkey, list(distinct o_orderpriority) filter (o_orderpriority is not null) as s from customer left join orders on o_custkey = c_custkey group by 1)
order by len(s) desc nulls first, c_custkey limit 25)""")
def order_by_size(t):
    kinds = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    rows = t("customer").select("c_custkey").join(kinds, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "s")
    return rows.orderBy(*tabular.by_size(rows, "s", descending=True), "c_custkey").limit(25).select("c_custkey", F.when(F.col("s").isNotNull(), F.size("s")).cast("long").alias("kinds"))


@query("select o_orderkey, year(o_orderdate) as year, month(o_orderdate) as month from orders")
def datetime_parts(t):
    moment = tabular.datetime_of(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T12:30:00")))
    return t("orders").select("o_orderkey", moment.alias("m")).select("o_orderkey", F.year("m").cast("long").alias("year"), F.month("m").cast("long").alias("month"))


# ---- graph queries and algorithms


@query("""
with e as (select distinct l_suppkey as s, l_partkey as p from lineitem), d as (select n_regionkey as region, s_suppkey as id, s_name as name, count(*) as k from e join supplier on s = s_suppkey join nation on s_nationkey = n_nationkey group by all),
r as (select *, row_number() over (partition by region order by k desc, name) as r from d)
select region, string_agg(name, ', ' order by r) as members from r where r <= 20 and region in (select region from d group by 1 order by count(*) desc, region limit 10) group by 1""")
def top_members(t):
    e = t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    degree = graph.undirected(e).groupBy("src").agg(F.count("*").alias("k"))
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.col("s_name").alias("name"), F.col("n_regionkey").alias("region"))
    return algorithms.top_members(s.join(degree, "src"), "region", "name", "k")


@query("""
with e as (select distinct l_partkey as a, l_suppkey as b from lineitem), u as (select 'p' || a as x, 's' || b as y from e union all select 's' || b, 'p' || a from e)
select x as id, count(*) as degree from u group by 1""")
def degree_undirected(t):
    e = t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return graph.undirected(e).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


_PAIRS = "with recursive q as (select distinct l_orderkey as o, l_partkey as p from lineitem), e as (select distinct a.p as src, b.p as dst from q a join q b on a.o = b.o and a.p < b.p) "


def _co_bought(t, members: DataFrame | None = None) -> DataFrame:
    """(src, dst): parts of one order, all of them or those among members (id), which are chosen before pairs are made."""
    q = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("p")).distinct()
    if members is not None:
        q = q.join(members, q["p"] == members["id"], "left_semi")
    return q.withColumnRenamed("p", "src").join(q.withColumnRenamed("p", "dst"), "l_orderkey").where("src < dst").select("src", "dst").distinct()


@query(_PAIRS + ", m as (select distinct l_partkey as id from lineitem where l_suppkey = 3) select src, dst from e where src in (select id from m) and dst in (select id from m)")
def disease_module(t):
    m = t("lineitem").where("l_suppkey = 3").select(F.col("l_partkey").alias("id")).distinct()
    return graph.induced(m, _co_bought(t, m))


@query(_PAIRS + ", m as (select distinct l_partkey as id from lineitem where l_suppkey = 3) select distinct m.id, e.dst as linked from m left join (select src, dst from e union all select dst, src from e) e on e.src = m.id and e.dst in (select id from m)")
def optional_module(t):
    m = t("lineitem").where("l_suppkey = 3").select(F.col("l_partkey").alias("id")).distinct()
    both = graph.undirected(graph.induced(m, _co_bought(t, m)))
    return m.join(both, m["id"] == both["src"], "left").select("id", F.col("dst").alias("linked")).distinct()


_TREE = "with e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders) "


def _tree(t) -> DataFrame:
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    e = edge(t("nation"), "r", "n_regionkey", "n", "n_nationkey").union(edge(t("customer"), "n", "c_nationkey", "c", "c_custkey")).union(edge(t("orders"), "c", "o_custkey", "o", "o_orderkey"))
    return e.withColumn("eid", F.concat_ws(">", "src", "dst"))


@query(_TREE + """select 'r1' as start, dst as finish, 1 as depth from e where src = 'r1'
union all select 'r1', b.dst, 2 from e a join e b on a.dst = b.src where a.src = 'r1'
union all select 'r1', c.dst, 3 from e a join e b on a.dst = b.src join e c on b.dst = c.src where a.src = 'r1'""")
def var_length_1_3(t):
    start = t("region").where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return graph.paths(start, _tree(t), 1, 3).select("start", "finish", "depth")


@query("with m as (select distinct o_orderkey as member, 'c' || o_custkey as category from orders), " + _TREE[5:] + """, below as (select 'r1' as id union select dst from e where src = 'r1' union select b.dst from e a join e b on a.dst = b.src where a.src = 'r1')
select distinct member from m where category in (select id from below)""")
def category_closure(t):
    members = t("orders").select(F.col("o_orderkey").alias("member"), F.concat(F.lit("c"), "o_custkey").alias("category"))
    start = t("region").where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return algorithms.in_category(start, _tree(t).where("not dst like 'o%'"), members)


_WCC = _PAIRS + """, u as (select src, dst from e union select dst, src from e), n as (select distinct src as id from u),
wcc(id, component) using key (id) as (select id, id from n union
(select u.src, min(w.component) from wcc w join u on u.dst = w.id join recurring.wcc r on r.id = u.src where w.component < r.component group by 1)) """


def _components(t) -> DataFrame:
    # an order's least part joined to its others connects what all its pairs connect, in rows that grow with its parts only
    lines = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("p"))
    q = lines.repartition(partitions(lines), "l_orderkey").distinct()
    least = q.groupBy("l_orderkey").agg(F.min("p").alias("src"))
    e = cut(least.join(q.withColumnRenamed("p", "dst"), "l_orderkey").where("src < dst").select("src", "dst"))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return algorithms.components(nodes, e)


@query(_WCC + "select id, component from wcc")
def wcc(t):
    return _components(t)


@query(_WCC + ", s as (select component, count(*) as n from wcc group by 1) select count(*) as groups, sum(n)::bigint as members, min(n) as least, max(n) as most, round(avg(n), 6) as mean, quantile_disc(n, 0.5) as p50, quantile_disc(n, 0.95) as p95, quantile_disc(n, 0.999) as p999 from s")
def wcc_distribution(t):
    return algorithms.size_distribution(_components(t), "component").withColumn("mean", F.round("mean", 6))


@query(_WCC + "select id from wcc where component = (select component from wcc group by 1 order by count(*) desc, component limit 1)")
def largest_component(t):
    return algorithms.largest_component(_components(t))


def _bought_pairs(t) -> dict:
    """Parts of one order as edges for communities, an edge once for each order, and at most how many there are."""
    lines = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("p"))
    n = lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0]
    q = lines.repartition(partitions(lines), "l_orderkey").distinct()
    pairs = q.withColumnRenamed("p", "src").join(q.withColumnRenamed("p", "dst"), "l_orderkey").where("src < dst")
    return {"edges": pairs.select("src", "dst"), "expected": n, "once": True}


@query()
def louvain(t):
    return algorithms.louvain(**_bought_pairs(t))[0].select("id", F.size("levels").alias("depth"), "community")


@query()
def leiden_communities(t):
    return algorithms.leiden(**_bought_pairs(t))[0].select("id", F.size("levels").alias("depth"), "community")


def _customer_tree(t) -> tuple[DataFrame, DataFrame]:
    """(id, text) of customers, and their (id, levels): nation, region, all."""
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    texts = c.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment", F.lit("of"), "n_name").alias("text"))
    return texts, c.select(F.col("c_custkey").alias("id"), F.array("n_nationkey", F.col("n_regionkey") + 100, F.lit(1000)).alias("levels"))


@query()
def community_report_levels(t):
    return rag.hierarchy_reports(*_customer_tree(t), providers.get("generate-offline"), 500)


@query("select n_regionkey as region, n_nationkey as nation, count(*) as members from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, n_nationkey)")
def hierarchy_counts(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    return algorithms.hierarchy_counts(c, "region", "nation")


@query("select 0::integer as level, count(distinct n_nationkey) as groups from nation union all select 1, count(distinct n_regionkey) from nation")
def hierarchy_levels(t):
    return algorithms.hierarchy_levels(t("nation").select(F.array("n_nationkey", "n_regionkey").alias("levels")))


# ---- texts


_CHUNKS = r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') as t from documents),
c as (select doc_id, t, unnest(case when len(t) > 0 then range(0, greatest(len(t) - 10 - 1, 0) + 1, 30) else [] end) as s from w) """


@query(_CHUNKS + "select doc_id, (s / 30)::integer as chunk_id, array_to_string(list_slice(t, s + 1, s + 40), ' ') as chunk from c")
def chunk_token(t):
    return text.chunk(t("documents"), "token", 40, 10)


@query(_CHUNKS + "select doc_id, (s / 30)::integer as chunk_id, array_to_string(list_slice(t, s + 1, s + 40), ' ') as chunk from c")
def chunk_udtf(t):
    """The splitter as a table function of SQL."""
    d = t("documents")
    text.register_split_function(d.sparkSession)
    return d.sparkSession.sql("select doc_id, chunk_id, chunk from {docs}, lateral split_text(text, 'token', 40, 10)", docs=d)


@query()
def headline_chunks(t):
    return text.chunk_by_headlines(t("documents")).select("doc_id", "chunk_id", "headline", F.xxhash64("chunk").alias("chunk_hash"), "tokens")


_TERMS = r"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z\x{df}-\x{ff}]{4,}')) as term from documents),
f as (select doc_id, term, count(*) as tf from w group by all), d as (select term, count(*) as df from f group by all),
x as (select doc_id, term, df, round(tf * ln((1.0 + (select count(*) from documents)) / (1.0 + df)), 6) as weight from f join d using (term)),
k as (select *, row_number() over (partition by doc_id order by weight desc, term) as rank from x) """


@query(_TERMS + "select doc_id, rank::integer as rank, term, weight from k where rank <= 5")
def keyphrases(t):
    return text.keyphrases(t("documents")).select("doc_id", "rank", "term", "weight")


def _chunk_links(t) -> tuple[DataFrame, DataFrame]:
    chunks = t("documents").select(F.col("doc_id").alias("id"), "text")
    return chunks, testsets.shared_links(chunks, text.keyphrases(chunks, 8, "id").select("id", "term"))


@query()
def linked_chunks(t):
    return _chunk_links(t)[1]


@query()
def multi_hop_questions(t):
    chunks, links = _chunk_links(t)
    rows = testsets.question_set(chunks, testsets.multi_hop_groups(links), providers.get("questions-offline", questions=3), providers.get("judge-offline"))
    return rows.withColumn("split", testsets.split_of(F.array_join("contexts", ","))).groupBy("hops", "split").agg(F.count("*").alias("n"))


@query(r"""with c as (select doc_id, text, unnest(case when length(text) > 0 then range(0, greatest(length(text) - 50 - 1, 0) + 1, 250) else [] end) as s from documents)
select doc_id, (s / 250)::integer as chunk_id, regexp_replace(substring(text, s + 1, 300), '^\s+|\s+$', '', 'g') as chunk from c where regexp_replace(substring(text, s + 1, 300), '^\s+|\s+$', '', 'g') <> ''""")
def chunk_char(t):
    return text.chunk(t("documents"), "char", 300, 50)


@query(_CHUNKS + "select doc_id || '#' || (s / 30)::integer as src, doc_id || '#' || lead((s / 30)::integer) over (partition by doc_id order by s) as dst from c qualify dst is not null")
def next_chunk(t):
    docs = t("documents").select("doc_id", "text")
    return rag.lexical_graph(docs, text.chunk(docs, "token", 40, 10)).of_type("NEXT_CHUNK").select("src", "dst")


@query()
def chunk_recursive(t):
    return text.chunk(t("documents"), "sentence", 300, 50)


@query()
def chunk_semantic(t):
    docs = t("documents").select("doc_id", "text").repartition("doc_id")  # few files may hold many texts
    return text.semantic_chunks(docs, providers.column(providers.get("embed-offline")))


@query(r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g')) as text from pages""")
def html_text(t):
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " "), r"[ \t\n\x0B\f\r]+", " ")
    return t("pages").select("page_id", F.trim(s).alias("text"))


_TRIPLETS = "with r as (select [o_custkey::varchar, case when o_orderstatus = 'P' then 'waits for' else 'has had' end, o_orderpriority] as t, o_orderkey from orders) "


def _triplets(t) -> DataFrame:
    relation = F.when(F.col("o_orderstatus") == "P", "waits for").otherwise("has had")
    whole = F.array(F.col("o_custkey").cast("string"), relation, F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.slice(whole, 1, 2)).otherwise(whole).alias("triplet"))


@query(_TRIPLETS + "select distinct t[1] as src, upper(replace(t[2], ' ', '_')) as type, t[3] as dst from r where o_orderkey % 10 <> 0")
def triplets_to_graph(t):
    return graph.triplets_to_graph(_triplets(t))[0].edges


@query("select o_orderkey, 2::integer as parts from orders where o_orderkey % 10 = 0")
def triplets_rejected(t):
    return graph.triplets_to_graph(_triplets(t))[1].select("o_orderkey", F.size("triplet").alias("parts"))


@query("""with k as (select p_partkey, min(p_partkey) over (partition by p_name, p_brand) as root from part) select distinct root as src, l_suppkey as dst from lineitem join k on l_partkey = p_partkey""")
def entity_resolution(t):
    nodes = t("part").select(F.col("p_partkey").alias("id"), F.array(F.lit("Part")).alias("labels"), "p_name", "p_brand")
    edges = t("lineitem").select(F.col("l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("SOLD_BY").alias("type"))
    g = graph.PropertyGraph(nodes.withColumn("id", F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 12, "0"))), edges.withColumn("src", F.concat(F.lit("p"), F.lpad(F.col("src").cast("string"), 12, "0"))))
    e = graph.resolve(g, ["p_name", "p_brand"]).edges
    return e.select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst"))


@query("select o_orderstatus as type, count(*) as n from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0) and o_orderstatus in ('F', 'P') and o_orderkey in (select o_orderkey from orders where o_totalprice > 200000) group by 1")
def prune_edges(t):
    c = t("customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.array(F.lit("Customer")).alias("labels"))
    o = t("orders").where("o_totalprice > 200000").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.array(F.lit("Order")).alias("labels"))
    x = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.array(F.lit("Part")).alias("labels"))
    e = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.col("o_orderstatus").alias("type"))
    g = graph.prune(graph.PropertyGraph(c.unionByName(o).unionByName(x), e), ["Customer", "Order"], ["F", "P"])
    return g.edges.groupBy("type").agg(F.count("*").alias("n"))


@query("select 'c:' || o_custkey as id, string_agg(distinct o_orderstatus, ' ' order by o_orderstatus) as description from orders group by o_custkey")
def merge_subgraph_nodes(t):
    nodes = t("orders").select(F.col("o_custkey").cast("string").alias("name"), F.lit("c").alias("kind"), F.col("o_orderstatus").alias("description"))
    edges = t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("dst"))
    return graph.merge_subgraphs(nodes, edges).nodes.select("id", "description")


@query("select o_custkey as src, o_orderstatus as type, o_orderpriority as dst, count(*) as weight from orders group by all")
def merge_subgraphs(t):
    nodes = t("orders").select(F.col("o_custkey").cast("string").alias("name"), F.lit("c").alias("kind"), F.col("o_orderstatus").alias("description"))
    edges = t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("dst"))
    return graph.merge_subgraphs(nodes, edges).edges


@query()
def transformed_graph(t):
    return rag.transformed_graph(t("benchmark").select(F.col("item_id").alias("doc_id"), "text"), providers.get("graph-offline")).edges


# a text's five parts are the options, the letter at the place of its length is right; the model says the prompt's first sentence
@query(r"""with b as (select text, greatest((length(text) + 4) // 5, 1) as n from benchmark),
p as (select text, regexp_replace(concat_ws(chr(10), text, 'A) ' || substring(text, 1, n), 'B) ' || substring(text, n + 1, n), 'C) ' || substring(text, 2 * n + 1, n), 'D) ' || substring(text, 3 * n + 1, n),
case when substring(text, 4 * n + 1) <> '' then 'E) ' || substring(text, 4 * n + 1) end, 'Answer with one letter.'), '^\s+', '') as q from b),
m as (select text, upper(case when regexp_matches(q, '(?s)[.?!]\s') then regexp_extract(q, '(?s)^(.*?[.?!])\s', 1) else q end) as a from p),
c as (select 'ABCDE'[length(text) % 5 + 1] as key, case when a[1] in ('A', 'B', 'C', 'D', 'E') then a[1] when contains(a, 'A') then 'A' when contains(a, 'B') then 'B' when contains(a, 'C') then 'C' when contains(a, 'D') then 'D' when contains(a, 'E') then 'E' else 'INVALID' end as choice from m)
select count(*) as total, sum((choice = key)::integer)::bigint as correct, 100.0::double * sum((choice = key)::integer) / count(*) as accuracy from c""")
def mcq_benchmark(t):
    n, size = F.length("text"), F.greatest(F.ceil(F.length("text") / 5), F.lit(1)).cast("int")
    part = lambda i: F.substring(F.col("text"), size * i + 1, size)
    options = F.create_map(*[x for i, k in enumerate("ABCDE") for x in (F.lit(k), part(i))])
    key = F.substring(F.lit("ABCDE"), n % 5 + 1, F.lit(1))
    samples = t("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), options.alias("options"), key.alias("correct"))
    return rag.multiple_choice_benchmark(samples, providers.get("generate-offline"), None)[1]


@query()
def knowledge_graph(t):
    docs = t("documents").select("doc_id", "text")
    return rag.knowledge_graph(docs, *map(providers.get, ("embed-offline", "propositions-offline", "triplets-offline")))[0].edges.groupBy("type").agg(F.count("*").alias("n"))


# ---- retrieval


_VECTORS = """with v as (select vec_id, label, embedding::double[] as e from embeddings), q as (select * from v where vec_id % 50 = 0),
s as (select q.vec_id as query_id, v.vec_id as item_id, q.label = v.label as same, round(list_cosine_similarity(q.e, v.e), 6) as score from q, v),
r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s) """


def _hits(t, k: int) -> DataFrame:
    v = retrieval.normalised(t("embeddings"), "vec_id", "embedding")
    return retrieval.top_k(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id"), k)


@query(_VECTORS + "select query_id, item_id, score, rank::integer as rank from r where rank <= 5")
def vector_topk(t):
    return _hits(t, 5)


@query(_VECTORS + """, h as (select query_id, item_id, score from r where rank <= 5)
select query_id, item_id, score, string_agg(x.label::varchar || ':' || x.vec_id, ',' order by x.label::varchar || ':' || x.vec_id) as related from h join embeddings x on x.vec_id in (item_id - 1, item_id + 1) group by all""")
def vector_graph_expand(t):
    v = t("embeddings").select("vec_id", "label")
    edges = v.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"), F.lit("NEXT_CHUNK").alias("type"))
    texts = v.select(F.col("vec_id").alias("id"), F.concat_ws(":", "label", "vec_id").alias("text"))
    found = retrieval.expand(_hits(t, 5).drop("rank"), edges, ["NEXT_CHUNK", "FROM_CHUNK"], texts)
    return found.select("query_id", "item_id", "score", F.array_join("related", ",").alias("related"))


@query("""with v as (select vec_id, label, embedding::double[] as e from embeddings)
select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.e, b.e), 6) as score from v a join v b on a.label = b.label and a.vec_id < b.vec_id where round(list_cosine_similarity(a.e, b.e), 6) >= 0.35""")
def near_dup_pairs(t):
    v = retrieval.normalised(t("embeddings"), "vec_id", "embedding").join(t("embeddings").select("vec_id", "label"), "vec_id")
    return retrieval.similar_pairs(v.withColumnRenamed("vec_id", "id"), 0.35, "label")


@query("""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings), p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where round(list_cosine_similarity(a.e, b.e), 6) >= 0.35),
reach(id, seen) as (select vec_id, vec_id from v union select reach.id, p.b from reach join p on p.a = reach.seen)
select id, min(seen) as representative from reach group by 1""")
def similarity_resolution(t):
    v = retrieval.normalised(t("embeddings"), "vec_id", "embedding").join(t("embeddings").select("vec_id", "label"), "vec_id")
    return retrieval.merge_similar(v.withColumnRenamed("vec_id", "id"), 0.35, "label")


@query("""with d as (select doc_id, n_chars, (doc_id * 7) % 10 as score, sum(n_chars) over (order by (doc_id * 7) % 10 desc, doc_id rows unbounded preceding) as running from documents where (doc_id * 7) % 10 > 0)
select doc_id, n_chars, running::bigint as running from d where running <= 8000""")
def budget_take(t):
    d = t("documents").select("doc_id", "n_chars", ((F.col("doc_id") * 7) % 10).alias("score")).where("score > 0")
    return retrieval.take_to_budget(d, 8000, [F.desc("score"), F.asc("doc_id")], "n_chars").select("doc_id", "n_chars", "running")


@query()
def token_batches(t):
    d = t("documents").select("doc_id", F.size(text.words(F.col("text"))).alias("tokens"))
    return retrieval.token_batches(d, 8000, "doc_id").select("doc_id", "shard", "batch")


@query(r"""with d as (select doc_id as id, unnest(string_split(regexp_replace(text, '([.?!])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1))) as point, generate_subscripts(string_split(regexp_replace(text, '([.?!])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 as pos from documents),
p as (select *, len(list_filter(regexp_split_to_array(point, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) as tokens, len(regexp_extract_all(point, '\bthe\b')) as score from d),
r as (select id, pos, score, point, sum(tokens) over (order by score desc, id, pos rows unbounded preceding) as running from p where score > 0)
select id, pos::integer as pos, score::integer as score, point, running::bigint as running from r where running <= 8000""")
def global_search(t):
    d = t("documents").select(F.col("doc_id").alias("id"), "text", F.size(text.words(F.col("text"))).alias("tokens"))
    return retrieval.global_search(d, lambda c: F.regexp_count(c, F.lit(r"\bthe\b"))).select("id", "pos", "score", "point", "running")


@query(_FRIENDS + """, u as (select src, dst from f union all select dst, src from f), c as (select distinct user_id as id, user_id % 7 as community from events),
f0 as (select 7 as id), n1 as (select dst as id, count(*) as n from u where src in (select id from f0) group by 1), f1 as (select id from n1 where id not in (select id from f0) order by n desc, id limit 5),
v1 as (select id from f0 union all select id from f1), n2 as (select dst as id, count(*) as n from u where src in (select id from f1) group by 1), f2 as (select id from n2 where id not in (select id from v1) order by n desc, id limit 5),
s as (select 0 as step, id from f0 union all select 1, id from f1 union all select 2, id from f2)
select step, 'chunk' as kind, event_type as key, count(*) as hits from s join events on user_id = s.id group by all
union all select step, 'report', 'report ' || community, count(*) from s join c using (id) group by all""")
def drift_search(t):
    events = t("events")
    community = events.select(F.col("user_id").alias("id"), (F.col("user_id") % 7).alias("community")).distinct()
    reports = community.select("community", F.concat(F.lit("report "), "community").alias("report")).distinct()
    start = events.where("user_id = 7").select(F.col("user_id").alias("id")).distinct()
    mentions = events.select(F.col("event_type").alias("chunk_id"), F.col("user_id").alias("entity"))
    return retrieval.drift_search(start, _friends(t), mentions, community, reports, 2, 5)


@query(_FRIENDS + ", u as (select src, dst from f union all select dst, src from f), near as (select 7 as id union select dst from u where src = 7) select event_type as chunk_id, count(*) as hits from events where user_id in (select id from near) group by 1")
def local_search(t):
    f = _friends(t).withColumn("eid", F.concat_ws(">", "src", "dst"))
    mentions = t("events").select(F.col("event_type").alias("chunk_id"), F.col("user_id").alias("entity"))
    return retrieval.local_search(t("events").where("user_id = 7").select(F.col("user_id").alias("id")).distinct(), f, mentions, 1)


# ---- evaluation


@query(r"""
with p as (select conv_id, turn, case turn % 4 when 0 then json_object('contexts', [text, 'b'], 'answer', text) when 1 then json_object('documents', [text]) when 2 then json_object('results', [], 'token_usage', json_object('prompt_tokens', turn)) else json_array(text) end as j, text from conversations)
select conv_id, turn, case turn % 4 when 0 then text || '|b' when 1 then text when 2 then '' else text end as contexts,
case turn % 4 when 0 then text when 1 then text when 2 then '' else text end as answer, case turn % 4 when 2 then turn else 0 end as prompt_tokens from p""")
def rag_endpoint_normalise(t):
    c, kind = t("conversations"), F.col("turn") % 4
    first = F.col("text")
    payload = (
        F.when(kind == 0, F.to_json(F.struct(F.array(first, F.lit("b")).alias("contexts"), F.col("text").alias("answer"))))
        .when(kind == 1, F.to_json(F.struct(F.array(first).alias("documents"))))
        .when(kind == 2, F.to_json(F.struct(F.array().cast("array<string>").alias("results"), F.struct(F.col("turn").alias("prompt_tokens")).alias("token_usage"))))
        .otherwise(F.to_json(F.array("text")))
    )
    r = c.select("conv_id", "turn", metrics.normalise_reply(payload).alias("r"))
    return r.select("conv_id", "turn", F.array_join("r.contexts", "|").alias("contexts"), "r.answer", "r.prompt_tokens")


@query("select conv_id, turn, case when turn % 3 = 0 then null when turn % 3 = 1 then turn::double end as score, case when turn % 3 = 0 then null else role end as reason from conversations")
def judge_parse(t):
    kind = F.col("turn") % 3
    said = F.when(kind == 1, F.col("turn").cast("string")).otherwise(F.lit("ten"))
    good = F.to_json(F.struct(F.struct(said.alias("score"), F.col("role").alias("reason")).alias("answer_correctness")))
    j = metrics.parse_judge(F.when(kind == 0, F.lit("not {json")).otherwise(good))
    return t("conversations").select("conv_id", "turn", j["answer_correctness_score"].alias("score"), j["answer_correctness_reason"].alias("reason"))


@query(_VECTORS + """, k as (select query_id, rank, same::integer as v, sum(same::integer) over (partition by query_id order by rank) / rank as p from r where rank <= 20)
select query_id, round(sum(v * p) / (sum(v) + 1e-10), 6) as precision from k group by 1""")
def context_precision(t):
    label = t("embeddings").select("vec_id", "label")
    h = _hits(t, 20).join(label.withColumnsRenamed({"vec_id": "query_id", "label": "a"}), "query_id").join(label.withColumnsRenamed({"vec_id": "item_id", "label": "b"}), "item_id")
    verdicts = F.transform(F.array_sort(F.collect_list(F.struct("rank", (F.col("a") == F.col("b")).cast("int").alias("v")))), lambda x: x["v"])
    return h.groupBy("query_id").agg(F.round(metrics.context_precision(verdicts), 6).alias("precision"))


@query("select conv_id, round(avg((length(text) % 2)::double), 6) as score from conversations where role = 'assistant' group by 1")
def faithfulness(t):
    v = t("conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.collect_list((F.length("text") % 2)).alias("v"))
    return v.select("conv_id", F.round(metrics.faithfulness(F.col("v")), 6).alias("score"))


@query(r"""
with w as (select conv_id, turn, role, list_filter(regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+'), lambda x: x <> '') as t from conversations),
p as (select a.conv_id, a.turn, a.t as x, b.t as y from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn - 1 where a.role = 'assistant' and b.role = 'user'),
c as (select conv_id, turn, coalesce(sum(least(n, m)), 0) as common from (select conv_id, turn, u, count(*) as n from (select conv_id, turn, unnest(x) as u from p) group by all) join (select conv_id, turn, u, count(*) as m from (select conv_id, turn, unnest(y) as u from p) group by all) using (conv_id, turn, u) group by 1, 2)
select conv_id, turn, round(case when len(x) = 0 or len(y) = 0 then 0 else 2.0 * coalesce(common, 0) / (len(x) + len(y)) end, 6)::double as f1 from p left join c using (conv_id, turn)""")
def answer_token_f1(t):
    c = t("conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", "text")
    b = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    return metrics.token_f1_of(a.join(b, ["conv_id", "turn"]), ["conv_id", "turn"], "text", "asked").withColumn("f1", F.round("f1", 6))


_MCQ = r"""with a as (select conv_id, turn, upper(regexp_replace(text, '^\s+|\s+$', '', 'g')) as s from conversations),
m as (select conv_id, turn, case when s[1] in ('A', 'B', 'C', 'D', 'E') then s[1] when contains(s, 'A') then 'A' when contains(s, 'B') then 'B' when contains(s, 'C') then 'C' when contains(s, 'D') then 'D' when contains(s, 'E') then 'E' else 'INVALID' end as choice from a) """


def _choices(t) -> DataFrame:
    return t("conversations").select("conv_id", "turn", metrics.mcq_choice(F.col("text")).alias("choice"))


@query(_MCQ + "select conv_id, turn, choice from m")
def mcq_parse(t):
    return _choices(t)


@query(_MCQ + "select count(*) as total, sum((choice = 'A')::integer)::bigint as correct, round(100.0 * sum((choice = 'A')::integer) / count(*), 6)::double as accuracy from m")
def mcq_accuracy(t):
    return metrics.mcq_accuracy(_choices(t).withColumn("is_correct", F.col("choice") == "A")).withColumn("accuracy", F.round("accuracy", 6))


@query("""
with r as (select case when turn % 3 <> 0 then (turn % 11)::double end as a, case when turn % 4 <> 0 then (length(text) % 11)::double end as b, length(text)::double as l, turn as p, length(text) as c from conversations)
select round(avg(coalesce(a, 0)), 6) as avg_answer_correctness, round(avg(coalesce(b, 0)), 6) as avg_context_relevance, round(avg(l), 6) as avg_latency_ms, sum(p)::bigint as total_prompt_tokens, sum(c)::bigint as total_completion_tokens, sum(p + c)::bigint as total_tokens, count(*) as num_questions from r""")
def eval_aggregate(t):
    n = F.length("text").cast("long")
    rows = t("conversations").select(
        F.when(F.col("turn") % 3 != 0, (F.col("turn") % 11).cast("double")).alias("answer_correctness_score"), F.when(F.col("turn") % 4 != 0, (n % 11).cast("double")).alias("context_relevance_score"),
        n.cast("double").alias("latency_ms"), F.col("turn").alias("prompt_tokens"), n.alias("completion_tokens"), (F.col("turn") + n).alias("total_tokens"),
    )
    s = metrics.evaluation_summary(rows)
    return s.select(*[F.round(c, 6).alias(c) if c.startswith("avg") else c for c in s.columns])


@query("select conv_id, turn, 'faithfulness' as scored, round((length(text) % 2 + 1) / 2.0, 6)::double as value, case when text is null then 'missing input' end as error from conversations")
def metric_experiment(t):
    c = t("conversations").select("conv_id", "turn", F.when(F.col("text").isNotNull(), F.array((F.length("text") % 2).cast("double"), F.lit(1.0))).alias("verdicts"))
    found = metrics.experiment(c, "faithfulness", "verdicts")
    return found.select("conv_id", "turn", F.col("experiment").alias("scored"), F.round("value", 6).alias("value"), "error")


# three questions for each chunk, about its sentences in turn
_QUESTIONS = r"""with w as (select item_id, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') as t from benchmark),
c as (select t, unnest(case when len(t) > 0 then range(0, greatest(len(t) - 50 - 1, 0) + 1, 250) else [] end) as s from w),
k as (select s // 250 as chunk_id, array_to_string(list_slice(t, s + 1, s + 300), ' ') as chunk from c),
l as (select *, list_filter(string_split(regexp_replace(chunk, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as said, unnest([0, 1, 2]) as m from k),
q as (select *, said[m % len(said) + 1] as answer from l)
select ['Global', 'Local Direct', 'One Fact'][m + 1] as question_type, 'offline' as source, 'What is said about ' || array_to_string(list_slice(string_split(answer, ' '), 1, 3), ' ') || '?' as question,
answer, 'reader 1' as persona, 'task 1' as task, chunk_id::integer as chunk_id, chunk, null::varchar as file_path from q"""


@query(_QUESTIONS)
def qa_library(t):
    return rag.question_library(t("benchmark").select(F.col("item_id").alias("doc_id"), "text"), providers.get("questions-offline", questions=3)).drop("retrieved_contexts")


@query("select question_type, source, question from (" + _QUESTIONS + ") union all select 'Human', case when item_id % 2 = 0 then 'human' else 'expert' end, text from benchmark")
def qa_union_human(t):
    b = t("benchmark")
    human = b.select(F.lit("Human").alias("question_type"), F.when(F.col("item_id") % 2 == 0, "").otherwise("expert").alias("source"), F.col("text").alias("question"))
    rows = rag.question_library(b.select(F.col("item_id").alias("doc_id"), "text"), providers.get("questions-offline", questions=3), human=human)
    return rows.select("question_type", "source", "question")


@query("""select o_custkey::varchar as subject, o_orderstatus as claim, o_orderkey as doc_id, o_orderdate::date as since, case when o_orderstatus = 'F' then o_orderdate::date end as until from orders""")
def claims(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.struct(F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderstatus").alias("claim"), day.alias("since"), F.when(F.col("o_orderstatus") == "F", day).otherwise("still open").alias("until"))
    return rag.claims(t("orders").select(F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct(F.array(said).alias("claims"))).alias("reply")))


@query("""with p as (select a.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c, string_split(lower(x.p_name), ' ') as s, string_split(lower(y.p_name), ' ') as r
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 join part x on x.p_partkey = a.vec_id join part y on y.p_partkey = b.vec_id),
f as (select vec_id, c, 2.0::double * list_sum(list_transform(list_distinct(s), lambda w: least(len(list_filter(s, lambda v: v = w)), len(list_filter(r, lambda v: v = w))))) / (len(s) + len(r)) as f1 from p)
select vec_id, round(0.75 * f1 + 0.25 * c, 6) as value from f""")
def answer_correctness(t):
    v, p = t("embeddings").select("vec_id", "embedding"), t("part").select("p_partkey", "p_name")
    pairs = v.withColumnRenamed("embedding", "a").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    named = pairs.join(p.select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("answer")), "vec_id").join(p.select((F.col("p_partkey") - 1).alias("vec_id"), F.col("p_name").alias("reference")), "vec_id")
    return named.select("vec_id", F.round(metrics.answer_correctness(F.col("answer"), F.col("reference"), F.col("a"), F.col("b")), 6).alias("value"))


@query(r"""with t as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as after from conversations)
select conv_id, turn, 'Question: ' || text || chr(10) || 'Expected: ' || role || chr(10) || 'Answer: ' || coalesce(after, '') || chr(10) || 'Contexts:' || chr(10) || case when after is null then '(no contexts retrieved)' else text || chr(10) || '---' || chr(10) || after end as prompt from t""")
def judge_prompts(t):
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t("conversations").select("conv_id", "turn", "role", "text", after.alias("after"))
    contexts = F.when(F.col("after").isNull(), F.array().cast("array<string>")).otherwise(F.array("text", "after"))
    return rows.select("conv_id", "turn", rag.judge_prompt(F.col("text"), F.col("role"), F.coalesce("after", F.lit("")), contexts).alias("prompt"))


@query(r"""with s as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as after from conversations),
x as (select conv_id, turn, after, unnest(list_filter(string_split(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '([.?!])\s+', '' || chr(1), 'g'), chr(1)), lambda w: w <> '')) as said from s where after is not null),
w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(said), '[\p{L}\p{N}_]+')) as need, regexp_extract_all(lower(after), '[\p{L}\p{N}_]+') as have from x)
select conv_id, turn, round(avg((len(need) > 0 and 2 * len(list_filter(need, lambda v: list_contains(have, v))) > len(need))::integer::double), 6) as value from w group by all""")
def judged_faithfulness(t):
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t("conversations").select("conv_id", "turn", F.col("role").alias("user_input"), F.col("text").alias("response"), F.array_compact(F.array(after)).alias("retrieved_contexts"))
    found = rag.judged_faithfulness(rows, providers.get("propositions-offline"), providers.get("verdict-offline"))
    return found.where("error is null").select("conv_id", "turn", F.round("value", 6).alias("value"))


@query()
def rag_evaluation(t):
    docs = t("benchmark").select(F.col("item_id").alias("doc_id"), "text")
    asked = rag.question_library(docs, providers.get("questions-offline", questions=2))
    chunks = text.chunk(docs, "token", 300, 50).select(F.concat_ws("#", "doc_id", "chunk_id").alias("chunk_key"), "chunk")
    answers = rag.answer_questions(asked, chunks, providers.get("embed-offline"), providers.get("generate-offline"), 3)
    return metrics.evaluation_summary(rag.evaluate(asked, answers, providers.get("judge-offline"))).withColumn("measured", F.col("avg_latency_ms") > 0).drop("avg_latency_ms")


# ---- streams


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def windowed_events(t):
    return windowed_counts(t("events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))
