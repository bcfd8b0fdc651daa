"""The registered queries of the language over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advisor
from ..session import Session
from ..sources.catalog import statistics

#: Model -> (table, primary key).
MODELS = {
    "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey"),
    "Lineitem": ("lineitem", None), "Event": ("events", "event_id"), "Document": ("documents", "doc_id"), "Label": ("labels", "doc_id"), "Conversation": ("conversations", None), "Page": ("pages", "page_id"), "Benchmark": ("benchmark", "item_id"), "Embedding": ("embeddings", "vec_id"),
}
#: (model, alias, local column, target, target column).
RELATIONS = (
    ("Region", "nations", "r_regionkey", "Nation", "n_regionkey"), ("Nation", "customers", "n_nationkey", "Customer", "c_nationkey"), ("Nation", "suppliers", "n_nationkey", "Supplier", "s_nationkey"), ("Nation", "region", "n_regionkey", "Region", "r_regionkey"),
    ("Customer", "orders", "c_custkey", "Orders", "o_custkey"), ("Customer", "nation", "c_nationkey", "Nation", "n_nationkey"), ("Orders", "lines", "o_orderkey", "Lineitem", "l_orderkey"), ("Supplier", "lines", "s_suppkey", "Lineitem", "l_suppkey"), ("Part", "lines", "p_partkey", "Lineitem", "l_partkey"), ("Document", "labels", "doc_id", "Label", "doc_id"),
)


def session(spark: SparkSession, sf_dir: str, text: str | None = None) -> Session:
    """A session with all models, or with those that a request names and those that its relations lead to."""
    words = set(re.findall(r"\w+", text)) if text is not None else None
    wanted = set(MODELS) if words is None else words & set(MODELS)
    if words is not None:
        wanted |= {"Orders", "Lineitem"} if "OrderLine" in words else set()
        wanted |= {target for _, alias, _, target, _ in RELATIONS if alias in words}
    s = Session(spark)
    for name, (table, key) in MODELS.items():
        if name in wanted:
            s.register_parquet(name, f"{sf_dir}/{table}.parquet", key)
    for model, alias, local, target, column in RELATIONS:
        if {model, target} <= wanted:
            s.catalog.relate(model, alias, local, target, column)
    if words is not None and "OrderLine" not in words:
        return s
    # A model with nulls, which no test table has: the number of an order's first line, null without lines.
    orders, lines = s.table("Orders"), s.table("Lineitem")
    first = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line"))
    open_orders = orders.join(first, orders.o_orderkey == first.l_orderkey, "left").select("o_orderkey", "o_custkey", "line")
    s.register("OrderLine", open_orders, "o_orderkey")
    return s


@dataclass
class Case:
    text: str
    sql: str
    params: dict[str, object] = field(default_factory=dict)
    #: For mutations: the table that is compared afterwards.
    table: str | None = None
    #: Schema text or relations that the case adds.
    prepare: Callable[[Session], None] | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, None if self.prepare else self.text)
        if self.prepare:
            self.prepare(s)
        df = s.query(self.text, self.params)
        return s.table(self.table) if self.table else df


NULLS = "(SELECT o_orderkey, o_custkey, line FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS line FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


def _integrity(on_delete: str, on_update: str) -> Callable[[Session], None]:
    """Nations refer to regions, customers to nations, with integrity."""

    def prepare(s: Session) -> None:
        s.catalog.relate("Nation", "in_region", "n_regionkey", "Region", "r_regionkey", integrity=True, on_delete=on_delete, on_update=on_update)
        s.catalog.relate("Customer", "in_nation", "c_nationkey", "Nation", "n_nationkey", integrity=True, on_delete=on_delete, on_update=on_update)

    return prepare


def _scope(s: Session) -> None:
    from .parser import Parser

    s.catalog.models["Orders"].scopes["large"] = Parser("|> where(o_totalprice > 200000.0)").operators()


def _tags(s: Session) -> None:
    s.define('Tag { field(id, i64, notNull, primaryKey) field(label, string, notNull, default, "new") field(weight, u8, nullable) field(seen, bool, notNull, default, false) }')


CASES = {
    "scan_project": Case("Nation { n_nationkey n_name }", "SELECT n_nationkey, n_name FROM nation"),
    "scan_all_columns": Case("Supplier {}", "SELECT * FROM supplier"),
    "pk_point": Case("Orders |> where(o_orderkey == 7) { o_orderkey o_custkey o_totalprice }", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7"),
    "pk_range": Case("Orders |> where(o_orderkey >= 100 && o_orderkey < 200) { o_orderkey o_orderstatus }", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200"),
    "pk_range_large": Case("Orders |> where(o_orderkey >= 10) { o_orderkey }", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 10"),
    "filter_logic": Case("Lineitem |> where(l_quantity > 30.0 || l_discount == 0.05 && !(l_tax > 0.04)) { l_orderkey l_linenumber l_quantity l_discount l_tax }", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem WHERE l_quantity > 30.0 OR (l_discount = 0.05 AND NOT (l_tax > 0.04))"),
    "filter_in": Case('Customer |> where(in(c_mktsegment, ["BUILDING", "AUTOMOBILE"])) { c_custkey c_mktsegment }', "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')"),
    "filter_not_in": Case('Customer |> where(!in(c_mktsegment, ["BUILDING", "AUTOMOBILE"])) { c_custkey c_mktsegment }', "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')"),
    "filter_in_null": Case("OrderLine |> where(!in(line, [2, 3])) { o_orderkey line }", f"SELECT o_orderkey, line FROM {NULLS} WHERE line NOT IN (2, 3)"),
    "null_safe_eq": Case("OrderLine |> where(line == null) { o_orderkey }", f"SELECT o_orderkey FROM {NULLS} WHERE line IS NULL"),
    "null_safe_ne": Case("OrderLine |> where(line != 1) { o_orderkey line }", f"SELECT o_orderkey, line FROM {NULLS} WHERE line IS DISTINCT FROM 1"),
    "null_predicate": Case("OrderLine |> where(line > 1 || o_orderkey < 100) { o_orderkey line }", f"SELECT o_orderkey, line FROM {NULLS} WHERE line > 1 OR o_orderkey < 100"),
    "error_drops_row": Case("OrderLine |> where(100 / (line - 1) >= 25) { o_orderkey line }", f"SELECT o_orderkey, line FROM {NULLS} WHERE CASE WHEN line IS NULL OR line = 1 THEN false ELSE 100 // (line - 1) >= 25 END"),
    "computed_arith": Case("Lineitem { l_orderkey l_linenumber net: l_extendedprice * (1.0 - l_discount) }", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::double - l_discount) AS net FROM lineitem"),
    "int_div_trunc": Case("Orders { o_orderkey h: o_orderkey / 3 g: (0 - o_orderkey) / 3 }", "SELECT o_orderkey, o_orderkey // 3 AS h, (0 - o_orderkey) // 3 AS g FROM orders"),
    "mixed_integers": Case("Nation { n_nationkey s: n_nationkey + 1 t: n_nationkey * n_regionkey }", "SELECT n_nationkey, n_nationkey::bigint + 1 AS s, n_nationkey * n_regionkey AS t FROM nation"),
    "fn_round_even": Case("Lineitem { l_orderkey l_linenumber r: round(l_quantity / 2.0) }", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2.0, 0) AS r FROM lineitem"),
    "fn_abs": Case("Customer { c_custkey a: abs(c_acctbal) }", "SELECT c_custkey, abs(c_acctbal) AS a FROM customer"),
    "fn_sqrt": Case("Part { p_partkey s: sqrt(p_retailprice) }", "SELECT p_partkey, sqrt(p_retailprice) AS s FROM part"),
    "fn_coalesce": Case("OrderLine { o_orderkey n: coalesce(line, 0) }", f"SELECT o_orderkey, coalesce(line, 0)::bigint AS n FROM {NULLS}"),
    "fn_trim_case": Case("Part { p_partkey t: trim(p_name) l: lower(p_brand) u: upper(p_type) }", "SELECT p_partkey, trim(p_name, ' ') AS t, lower(p_brand) AS l, upper(p_type) AS u FROM part"),
    "fn_length_bytes": Case("Document { doc_id n: length(text) }", "SELECT doc_id, strlen(text) AS n FROM documents"),
    "unary_minus": Case("Customer { c_custkey n: -c_acctbal k: -c_custkey }", "SELECT c_custkey, -c_acctbal AS n, -c_custkey AS k FROM customer"),
    "bare_expression": Case("1 + 2 * 3", "SELECT '7' AS payload"),
    "sort_limit_offset": Case("Orders |> sort(o_totalprice desc, o_orderkey asc) |> offset(5) |> limit(10) { o_orderkey o_totalprice }", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "limit_then_offset": Case("Orders |> sort(o_orderkey asc) |> limit(50) |> offset(20) { o_orderkey }", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 20"),
    "sort_expr": Case("Customer |> sort(c_acctbal * c_acctbal desc, c_custkey asc) |> limit(20) { c_custkey }", "SELECT c_custkey FROM customer ORDER BY c_acctbal * c_acctbal DESC, c_custkey LIMIT 20"),
    "sort_nulls_last": Case("OrderLine |> sort(line asc, o_orderkey desc) |> offset(14000) |> limit(900) { o_orderkey line }", f"SELECT o_orderkey, line FROM {NULLS} ORDER BY line ASC NULLS LAST, o_orderkey DESC LIMIT 900 OFFSET 14000"),
    "sort_nulls_first": Case("OrderLine |> sort(line desc, o_orderkey asc) |> limit(300) { o_orderkey line }", f"SELECT o_orderkey, line FROM {NULLS} ORDER BY line DESC NULLS FIRST, o_orderkey LIMIT 300"),
    "where_hoisted": Case('Orders |> sort(o_orderkey asc) |> limit(5) |> where(o_orderstatus == "F") { o_orderkey o_orderstatus }', "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 5"),
    "having_positional": Case('Orders |> sort(o_orderkey asc) |> limit(50) |> having(o_orderstatus == "F") { o_orderkey o_orderstatus }', "SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50) WHERE o_orderstatus = 'F'"),
    "scope_expanded": Case("Orders |> large |> sort(o_orderkey asc) |> limit(20) { o_orderkey }", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000.0 ORDER BY o_orderkey LIMIT 20", prepare=_scope),
    "group_count": Case("Lineitem |> group(l_returnflag, l_linestatus) { l_returnflag l_linestatus n: count() }", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "group_sum_avg_min_max": Case("Lineitem |> group(l_linenumber) { l_linenumber s: sum(l_orderkey) a: round(avg(l_orderkey) * 1000.0) lo: min(l_shipdate) hi: max(l_extendedprice) }", "SELECT l_linenumber, sum(l_orderkey)::bigint AS s, round_even(avg(l_orderkey) * 1000.0::double, 0) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1"),
    "group_having_sort": Case("Orders |> group(o_custkey) |> having(count() > 10 && min(o_totalprice) > 1000.0) |> sort(count() desc, o_custkey asc) |> limit(25) { o_custkey n: count() }", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10 AND min(o_totalprice) > 1000.0 ORDER BY 2 DESC, 1 LIMIT 25"),
    "group_null_key": Case("OrderLine |> group(line) { line n: count() }", f"SELECT line, count(*) AS n FROM {NULLS} GROUP BY 1"),
    "group_skips_nulls": Case("OrderLine |> group(o_custkey) { o_custkey s: sum(line) m: max(line) n: count() }", f"SELECT o_custkey, sum(line)::bigint AS s, max(line) AS m, count(*) AS n FROM {NULLS} GROUP BY 1"),
    "global_aggregate": Case("Lineitem { n: count() s: sum(l_linenumber) lo: min(l_quantity) hi: max(l_quantity) }", "SELECT count(*) AS n, sum(l_linenumber)::bigint AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem"),
    "distinct": Case("Customer |> unique { c_mktsegment }", "SELECT DISTINCT c_mktsegment FROM customer"),
    "nested_flat": Case("Customer { c_custkey orders { o_orderkey o_totalprice } }", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey"),
    "nested_left_empty": Case("Orders { o_orderkey lines { l_linenumber l_quantity } }", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"),
    "nested_where": Case('Customer { c_custkey orders |> where(o_orderstatus == "F" && o_totalprice > 100000.0) { o_orderkey } }', "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.0) ON o_custkey = c_custkey"),
    "nested_topk": Case("Customer { c_custkey orders |> sort(o_totalprice desc, o_orderkey asc) |> offset(1) |> limit(2) { o_orderkey o_totalprice } }", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k BETWEEN 2 AND 3) ON o_custkey = c_custkey"),
    "nested_group": Case("Customer { c_custkey orders |> group(o_orderstatus) |> having(count() > 1) |> sort(count() desc, o_orderstatus asc) |> limit(1) { o_orderstatus } }", "SELECT c_custkey, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS k FROM orders GROUP BY 1, 2 HAVING count(*) > 1) WHERE k = 1) ON o_custkey = c_custkey"),
    "nested_computed": Case("Orders { o_orderkey lines { v: l_extendedprice * l_discount } }", "SELECT o_orderkey, l_extendedprice * l_discount AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"),
    "nested_multi": Case("Nation { n_name customers |> where(c_acctbal > 9000.0) { c_custkey } suppliers { s_suppkey } }", "SELECT n_name, c_custkey, s_suppkey FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000.0) ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey"),
    "relation_chain": Case("Customer |> where(c_acctbal > 5000.0) { c_custkey nation { n_name } }", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000.0"),
    "let_semi": Case("let big = Orders |> where(o_totalprice > 200000.0) { o_custkey }\nCustomer |> where(in(c_custkey, big)) { c_custkey c_name }", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0)"),
    "let_anti": Case("let big = Orders |> where(o_totalprice > 200000.0) { o_custkey }\nCustomer |> where(!in(c_custkey, big)) { c_custkey c_name }", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000.0)"),
    "let_anti_null": Case("let l = OrderLine |> where(o_orderkey < 2000) { line }\nNation |> where(!in(n_nationkey, l)) { n_nationkey }", f"SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT line FROM {NULLS} WHERE o_orderkey < 2000)"),
    "let_in_or": Case("let big = Orders |> where(o_totalprice > 300000.0) { o_custkey }\nCustomer |> where(in(c_custkey, big) || c_acctbal < 0.0) { c_custkey }", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000.0) OR c_acctbal < 0.0"),
    "let_scalar": Case("let top = Orders |> sort(o_totalprice desc, o_orderkey asc) |> limit(1) { o_custkey }\nOrders |> where(o_custkey == top) { o_orderkey }", "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)"),
    "param_filter": Case("Orders |> where(o_totalprice > $min && o_orderstatus == $status) { o_orderkey }", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000.0 AND o_orderstatus = 'O'", {"$min": 150000.0, "$status": "O"}),
    "insert_defaults": Case('Tag |> insert(id = 1) {} Tag |> insert(id = 2, label = "x", weight = 255, seen = true) {}', "SELECT 1::bigint AS id, 'new' AS label, NULL::smallint AS weight, false AS seen UNION ALL SELECT 2, 'x', 255, true", table="Tag", prepare=_tags),
    "bulk_insert": Case('Region |> insert((r_regionkey = 100, r_name = "NORTH"), (r_regionkey = 101, r_name = "SOUTH")) {}', "SELECT * FROM region UNION ALL SELECT 100, 'NORTH' UNION ALL SELECT 101, 'SOUTH'", table="Region"),
    "update_expr": Case('Orders |> where(o_orderstatus == "F") |> update(o_totalprice = o_totalprice + 1.0) {}', "SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1.0::double ELSE o_totalprice END AS o_totalprice) FROM orders", table="Orders"),
    "update_seq": Case("Supplier |> update(s_acctbal = s_acctbal * 2.0, s_nationkey = s_nationkey + 1, s_acctbal = s_acctbal + 1.0) {}", "SELECT s_suppkey, s_name, (s_nationkey + 1)::int AS s_nationkey, s_acctbal * 2.0::double + 1.0::double AS s_acctbal FROM supplier", table="Supplier"),
    "delete_where": Case("Customer |> where(c_acctbal < 0.0) |> delete {}", "SELECT * FROM customer WHERE NOT (c_acctbal < 0.0)", table="Customer"),
    "delete_returning": Case("Part |> where(p_size == 7) |> delete { p_partkey p_name }", "SELECT p_partkey, p_name FROM part WHERE p_size = 7"),
    "fk_cascade_delete": Case("Region |> where(r_regionkey == 2) |> delete {}", "SELECT * FROM nation WHERE n_regionkey <> 2", table="Nation", prepare=_integrity("cascade", "restrict")),
    "fk_set_null": Case("Nation |> where(n_nationkey < 5) |> delete {}", "SELECT * REPLACE (CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey END AS c_nationkey) FROM customer", table="Customer", prepare=_integrity("setNull", "restrict")),
    "fk_cascade_update": Case("Region |> where(r_regionkey == 1) |> update(r_regionkey = 77) {}", "SELECT * REPLACE (CASE WHEN n_regionkey = 1 THEN 77 ELSE n_regionkey END AS n_regionkey) FROM nation", table="Nation", prepare=_integrity("restrict", "cascade")),
    "read_your_writes": Case("Orders |> where(o_orderkey < 50) |> delete {} Orders { n: count() lo: min(o_orderkey) }", "SELECT count(*) AS n, min(o_orderkey) AS lo FROM orders WHERE o_orderkey >= 50"),
    "events_filter": Case('Event |> where(event_type == "purchase" && value > 50.0) { event_id user_id value }', "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50.0"),
    "events_group": Case("Event |> group(event_type) { event_type n: count() first: min(ts) last: max(ts) u: max(user_id) }", "SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last, max(user_id) AS u FROM events GROUP BY 1"),
    "index_hint": Case("Orders.by_customer |> where(o_custkey == 7) { o_orderkey }", "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    "unaliased_call": Case("Orders |> group(o_orderstatus) { o_orderstatus count() }", "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1"),
    "current_timestamp": Case("Event |> where(ts < CurrentTimestamp) { event_id }", "SELECT event_id FROM events WHERE ts < now()::timestamp"),
    "group_sum_f64": Case("Lineitem |> group(l_returnflag) { l_returnflag s: sum(l_quantity) }", "SELECT l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY 1"),
    "group_first_seen": Case("Orders |> sort(o_orderkey asc) |> group(o_orderstatus) { o_orderstatus o_custkey }", "SELECT o_orderstatus, arg_min(o_custkey, o_orderkey) AS o_custkey FROM orders GROUP BY 1"),
    "fn_abs_i64": Case("Orders { o_orderkey a: abs(o_custkey - 100) }", "SELECT o_orderkey, abs(o_custkey - 100) AS a FROM orders"),
    "limit_expression": Case('Orders |> sort(o_orderkey asc) |> offset(coalesce(null, 2)) |> limit(length("abc")) { o_orderkey }', "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 2"),
    "limit_variable": Case("let n = 1 + 1\nOrders |> sort(o_orderkey asc) |> limit(n * $k) { o_orderkey }", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 6", {"$k": 3}),
    "limit_no_integer": Case('Nation |> sort(n_nationkey asc) |> limit("abc") |> offset(1 / 0) { n_nationkey }', "SELECT n_nationkey FROM nation"),
    "limit_huge": Case("Nation |> sort(n_nationkey asc) |> limit(3000000000) { n_nationkey }", "SELECT n_nationkey FROM nation"),
    "offset_huge": Case("Nation |> sort(n_nationkey asc) |> offset(3000000000) { n_nationkey }", "SELECT n_nationkey FROM nation WHERE false"),
    "scope_before_pipe": Case("Orders large |> sort(o_orderkey asc) |> limit(20) { o_orderkey }", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000.0 ORDER BY o_orderkey LIMIT 20", prepare=_scope),
    "insert_returning": Case('Tag |> insert((id = 1, label = "x"), (id = 2)) { id label }', "SELECT 1::bigint AS id, 'x' AS label UNION ALL SELECT 2, 'new'", prepare=_tags),
    "update_returning": Case("Supplier |> where(s_suppkey <= 3) |> update(s_acctbal = 1.0) { s_suppkey s_acctbal }", "SELECT s_suppkey, 1.0::double AS s_acctbal FROM supplier WHERE s_suppkey <= 3"),
    "fk_set_null_update": Case("Nation |> where(n_nationkey == 3) |> update(n_nationkey = 300) {}", "SELECT * REPLACE (CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS c_nationkey) FROM customer", table="Customer", prepare=_integrity("restrict", "setNull")),
    "coercion": Case('Tag |> insert((id = 7, weight = 200), (id = 8, weight = 1 + 1)) {}', "SELECT 7::bigint AS id, 'new' AS label, 200::smallint AS weight, false AS seen UNION ALL SELECT 8, 'new', 2, false", table="Tag", prepare=_tags),
    "documents_labels": Case("Document |> where(n_chars > 1000) { doc_id labels { quality toxic } }", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 1000"),
}

#: Metric records made of the events: their columns in SQL that both engines run.
RECORDS = """SELECT event_id AS ts, CASE WHEN event_id % 4 = 0 THEN 'select' WHEN event_id % 4 = 1 THEN 'update' WHEN event_id % 4 = 2 THEN 'insert' ELSE 'delete' END AS operation,
 event_id % 3 <> 0 AS has_predicate, event_id % 17 = 0 AS had_error, event_id % 5 = 0 AS spilled, CAST(user_id % 4 AS BIGINT) AS temp_bytes_written, CAST(0 AS BIGINT) AS temp_bytes_read,
 CAST(user_id % 50 AS BIGINT) AS rows_scanned, CAST(user_id % 13 AS BIGINT) AS rows_matched, CAST(event_id % 7 AS BIGINT) AS queue_depth, CAST(user_id % 5 AS BIGINT) AS workers_busy,
 CAST(event_id / 100 AS BIGINT) AS queue_timeout_total, CAST(CASE WHEN event_id % 40 = 0 THEN 90000000 ELSE 1000000 + user_id * 100 END AS BIGINT) AS total_ns FROM events"""
_GOOD = f"(SELECT * FROM ({RECORDS}) WHERE NOT had_error)".replace("event_id / 100", "event_id // 100")
_TRUST = "CASE WHEN {0} >= 30 THEN 'high' WHEN {0} >= 10 THEN 'medium' ELSE 'low' END AS confidence"
ADVICE = {
    "advisor_queue": ("queue_pressure", f"""WITH g AS (SELECT *, lag(queue_timeout_total) OVER (ORDER BY ts) AS p FROM {_GOOD}), s AS (SELECT count(*) AS samples, count(*) FILTER (workers_busy > 0 AND queue_depth >= workers_busy) AS saturated, count(*) FILTER (queue_timeout_total > p) AS edges FROM g)
 SELECT *, samples >= 20 AND (saturated * 100 >= samples * 30 OR edges >= 3) AS triggered, CASE WHEN edges >= 3 AND saturated * 100 >= samples * 50 THEN 'critical' ELSE 'warning' END AS severity, {_TRUST.format('samples')} FROM s"""),
    "advisor_spill": ("spill_ratio", f"""WITH s AS (SELECT count(*) AS samples, count(*) FILTER (spilled OR temp_bytes_written > 0 OR temp_bytes_read > 0) AS spills FROM {_GOOD})
 SELECT *, samples >= 20 AND spills * 100 >= samples * 25 AS triggered, CASE WHEN spills * 100 >= samples * 50 THEN 'critical' ELSE 'warning' END AS severity, {_TRUST.format('samples')} FROM s"""),
    "advisor_selectivity": ("low_selectivity", f"""WITH s AS (SELECT count(*) AS predicates, count(*) FILTER (rows_matched * 2 < rows_scanned) AS low, least(min(rows_matched * 1000000 // rows_scanned), 1000000)::bigint AS lowest_ppm FROM {_GOOD} WHERE has_predicate AND rows_scanned > 0 AND operation IN ('select', 'update', 'delete'))
 SELECT *, {_TRUST.format('low')} FROM s"""),
    "advisor_latency": ("latency_spikes", f"""WITH g AS (SELECT total_ns, row_number() OVER (ORDER BY total_ns) AS k, count(*) OVER () AS n FROM {_GOOD} WHERE total_ns > 0), m AS (SELECT any_value(n) AS samples, max(total_ns) AS max_ns, CASE WHEN any_value(n) % 2 = 1 THEN max(total_ns) FILTER (k = n // 2 + 1) ELSE max(total_ns) FILTER (k = n // 2) // 2 + max(total_ns) FILTER (k = n // 2 + 1) // 2 END AS median_ns FROM g),
 t AS (SELECT *, greatest(median_ns * 4, median_ns + 5000000) AS threshold_ns FROM m), s AS (SELECT t.*, (SELECT count(*) FROM g WHERE total_ns >= threshold_ns) AS spikes FROM t)
 SELECT samples, spikes, median_ns, threshold_ns, max_ns, spikes >= 3 AS triggered, CASE WHEN spikes * 100 >= samples * 20 THEN 'critical' ELSE 'warning' END AS severity, {_TRUST.format('samples')} FROM s"""),
}


def _advice(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        records = spark.sql(RECORDS.replace("event_id / 100", "event_id div 100").replace("FROM events", "FROM {events}"), events=events)
        return advisor.RULES[rule](records)

    return run


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact columns of the table statistics of a model."""
    return statistics(spark.read.parquet(f"{sf_dir}/nation.parquet")).select("column", "rows", "nulls", "least", "greatest")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with its lists as text, so that values can be compared."""
    df = session(spark, sf_dir).query("Region { r_regionkey nations |> sort(n_nationkey desc) |> limit(3) { n_nationkey n_name } }", flat=False)
    return df.select("r_regionkey", F.array_join(F.transform("nations", lambda x: F.concat_ws(":", x.n_nationkey.cast("string"), x.n_name)), ",").alias("nations"))


_TAG = 'Tag { field(id, i64, notNull, primaryKey) field(label, string, notNull) field(code, string, nullable) field(big, u64, nullable) index(by_code, [code], unique) hasMany Item }'
_ITEM = "Item { field(id, i64, notNull, primaryKey) field(tag_id, i64, nullable) reference(tag, tag_id, Tag.id, withReferentialIntegrity(onDeleteRestrict, onUpdateRestrict)) }"
_FILL = 'Tag |> insert((id = 1, label = "a", code = "x"), (id = 2, label = "b")) {} Item |> insert((id = 10, tag_id = 1)) {}'


def _ok(rows: int = 0, inserted: int = 0, updated: int = 0, deleted: int = 0, *lines: str) -> str:
    return "\n".join([f"OK returned_rows={rows} inserted_rows={inserted} updated_rows={updated} deleted_rows={deleted}", *lines])


#: Requests over two small models, one after the other in a session, with a response for each: how it starts, or what
#: error code it names.
TALKS: dict[str, list[tuple[str, str]]] = {
    "response_flat": [("Tag |> sort(id asc) { id label code }", _ok(2, 0, 0, 0, "1,a,x", "2,b,null"))],
    "response_count": [("Tag { id }", _ok(2).split("\n")[0]), ("Tag |> where(id == 9) { id }", _ok(0))],
    "response_error_line": [("Nothing { id }", "code=ModelNotFound"), ("Tag { nothing }", "code=ColumnNotFound"), ("Tag |> where(", "code=UnexpectedToken")],
    "response_payload": [('{ n: 1, l: [1, "a", null], t: true }', _ok(1, 0, 0, 0, '{"n":1,"l":[1,"a",null],"t":true}')), ("[1, 2]", _ok(1, 0, 0, 0, "[1,2]"))],
    "not_null": [("Tag |> insert(id = 5) {}", "code=NullNotAllowed"), ("Tag |> where(id == 1) |> update(label = null) {}", "code=NullNotAllowed"), ("Tag { n: count() }", _ok(1, 0, 0, 0, "2"))],
    "primary_key": [('Tag |> insert(id = 1, label = "z") {}', "code=DuplicateKey"), ('Tag |> insert((id = 5, label = "z"), (id = 5, label = "y")) {}', "code=DuplicateKey"), ("Tag |> update(id = 1) {}", "code=DuplicateKey")],
    "unique_index": [('Tag |> insert(id = 5, label = "z", code = "x") {}', "code=DuplicateKey"), ('Tag |> insert((id = 5, label = "z"), (id = 6, label = "z")) {}', _ok(0, 2))],
    "outgoing_reference": [("Item |> insert(id = 11, tag_id = 9) {}", "code=ReferentialIntegrityViolation"), ("Item |> insert(id = 11) {}", _ok(0, 1)), ("Item |> where(id == 10) |> update(tag_id = 9) {}", "code=ReferentialIntegrityViolation")],
    "restrict_actions": [("Tag |> where(id == 1) |> delete {}", "code=ReferentialIntegrityViolation"), ("Tag |> where(id == 1) |> update(id = 3) {}", "code=ReferentialIntegrityViolation"), ("Tag |> where(id == 2) |> delete {}", _ok(0, 0, 0, 1))],
    "range_errors": [('Tag |> insert(id = 5, label = "z", big = 0 - 1) {}', "code=IntegerOutOfRange"), ("Tag |> insert(id = 5, label = 1) {}", "code=TypeMismatch"), ('Tag |> insert(id = 5, label = "z", big = 18446744073709551615) { big }', _ok(1, 1, 0, 0, "18446744073709551615"))],
    "sum_u64": [('Tag |> insert((id = 5, label = "z", big = 9223372036854775800), (id = 6, label = "z", big = 7)) {}', _ok(0, 2)), ("Tag { s: sum(big) }", _ok(1, 0, 0, 0, "9223372036854775807")), ("Tag |> where(id == 6) |> update(big = 8) {}", _ok(0, 0, 1)), ("Tag { s: sum(big) }", "code=IntegerOverflow")],
    "summed_counters": [('Tag |> insert(id = 5, label = "z") {} Tag |> where(id > 1) |> update(label = "q") {} Tag |> where(id == 5) |> delete {} Tag |> sort(id asc) { id label }', _ok(2, 1, 2, 1, "1,a", "2,q"))],
    "let_expression": [("let a = 2 * 3\nlet b = a + 1\nb * 2", _ok(1, 0, 0, 0, "14"))],
    "variable_errors": [("let a = 1\nlet a = 2\na", "code=DuplicateVariable"), ("let id = 1\nTag |> where(id == 1) { label }", "code=AmbiguousIdentifier")],
    "request_rollback": [('Tag |> where(id == 2) |> delete {}\nTag |> insert(id = 1, label = "z") {}', "statement_index=1"), ("Tag { n: count() }", _ok(1, 0, 0, 0, "2"))],
    "transaction": [("BEGIN", "OK BEGIN"), ("Tag |> where(id == 2) |> delete {}", _ok(0, 0, 0, 1)), ("Tag { n: count() }", _ok(1, 0, 0, 0, "1")), ("BEGIN", "code=TransactionState"), ("ROLLBACK", "OK ROLLBACK"), ("Tag { n: count() }", _ok(1, 0, 0, 0, "2")), ("COMMIT", "code=TransactionState")],
    "inferred_relation": [("Tag |> sort(id asc) { id Item |> sort(id asc) { id } }", _ok(2, 0, 0, 0, "{id:i64,Item:[{id:i64}]}", "1,[[10]]", "2,[]"))],
    "inspect_plan": [("Tag |> where(id == 1) |> inspect { id }", _ok(1, 0, 0, 0, "1", "INSPECT plan")), ("inspect runtime --format json", '{"parallelism"')],
}


def _talk(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """(step, request, response) of each request; of a response what the talk states of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, out = Session(spark), []
        s.define(f"{_TAG} {_ITEM}")
        s.run(_FILL)
        for k, (request, stated) in enumerate(TALKS[name]):
            response = s.run(request).removesuffix("\n")
            if stated.startswith(("code=", "statement_index=")):
                found = re.search(stated.split("=")[0] + r"=\w+", response)
                response = found[0] if found and response.startswith("ERR") else response
            elif "INSPECT" in stated or stated.startswith("{\"par") or name == "response_count":
                response = response[: len(stated)]
            out.append((k, request, response))
        return spark.createDataFrame(out, "step int, request string, response string")

    return run


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session records of its requests."""
    s = session(spark, sf_dir, "Nation")
    for text in ("Nation |> where(n_nationkey > 3) { n_name }", "Nation { nothing }", "Nation |> where(n_nationkey == 1) |> delete {}"):
        s.run(text)
    return s.metrics().select("operation", "has_predicate", "had_error", (F.col("total_ns") > 0).alias("timed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: case.run for name, case in CASES.items()} | {name: _advice(rule) for name, (rule, _) in ADVICE.items()} | {"table_statistics": _stats, "nested_tree": _tree, "metric_records": _metric_records} | {name: _talk(name) for name in TALKS}
ORACLE_SQL = {name: case.sql for name, case in CASES.items()} | {name: sql for name, (_, sql) in ADVICE.items()} | {
    name: " UNION ALL ".join(f"SELECT {k} AS step, {_quoted(request)} AS request, {_quoted(stated)} AS response" for k, (request, stated) in enumerate(talk)) for name, talk in TALKS.items()
} | {
    "metric_records": "SELECT 'select' AS operation, true AS has_predicate, false AS had_error, true AS timed UNION ALL SELECT 'select', false, true, true UNION ALL SELECT 'delete', true, false, true",
    "table_statistics": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, min({c})::varchar AS least, max({c})::varchar AS greatest FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")),
    "nested_tree": "SELECT r_regionkey, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey DESC) AS nations FROM region JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS k FROM nation) ON n_regionkey = r_regionkey WHERE k <= 3 GROUP BY 1",
}
