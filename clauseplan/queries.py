"""Rule programs over the test tables, each with the SQL that gives the same rows.

A key starts with the row of the inventory that the program shows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .api import Program
from .more_queries import LINK, LINK_SQL, MORE
from .operators.lineage import checkpoint_folder
from .sources import load

MODULES = Path(__file__).parent / "modules"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass(frozen=True)
class Query:
    program: str
    sql: str | None
    predicate: str = "Out"
    limit: int | None = None
    offset: int | None = None
    pattern: str | None = None
    alias: dict[str, str] | None = None
    via: str | None = None
    folder_flag: bool = False
    modules: bool = False
    unsafe: bool = False

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        from .lang.tree import Atom, Call, walk

        flags = {}
        if self.via or self.folder_flag:
            folder = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
            load.write(spark.range(1).selectExpr("'hello files' AS value"), f"{folder}/note.txt", "text")
            flags = {"folder": folder} if self.folder_flag else {}
        program = Program(self.program, spark, roots=[MODULES] if self.modules else [], flags=flags, unsafe=self.unsafe)
        used = {n.name.removeprefix("side.") for s in program.statements for n in walk(s) if isinstance(n, Atom | Call)}
        for table in TABLES:
            name = next((a for a, t in (self.alias or {}).items() if t == table), table)
            if name not in used:
                continue
            path, kind = f"{sf_dir}/{table}.parquet", "parquet"
            if self.via:
                made = f"{folder}/{table}.{self.via}"
                load.write(load.read(spark, path, kind), made, self.via)
                path, kind = made, "json" if self.via == "array" else self.via
            if self.alias:
                program.tables[name] = program.planner.tables[name] = f"table_{name}"
                load.read(spark, path, kind).createOrReplaceTempView(f"table_{name}")
            else:
                program.load(name, path, kind)
        if self.pattern is not None:
            return program.search(self.predicate, self.pattern, self.limit, self.offset)
        return program.run(self.predicate, self.limit, self.offset)


Q: dict[str, Query] = {}


def add(name: str, program: str, sql: str | None, **more) -> None:
    Q[name] = Query(program, sql, **more)


PRICING = """
@OrderBy(Pricing, "flag", "status");
Pricing(flag:, status:, qty? += q, base? += p, disc? += p * (1 - d), n? += 1) distinct :-
  lineitem(l_returnflag: flag, l_linestatus: status, l_quantity: q, l_extendedprice: p, l_discount: d, l_shipdate: ts),
  ToString(ts) < "1998-09-03";
Out(flag:, status:, qty: Round(qty, 2), base: Round(base, 2), disc: Round(disc, 2), n:) :- Pricing(flag:, status:, qty:, base:, disc:, n:);
"""
add("entry_pricing", PRICING, """SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-03' GROUP BY ALL""")

# Scans, facts, files
add("s1_scan_project", "Out(key:, price:) :- orders(o_orderkey: key, o_totalprice: price);", "SELECT o_orderkey AS key, o_totalprice AS price FROM orders")
add("s2_facts", 'Rank(name: "ASIA", rank: 1); Rank(name: "EUROPE", rank: 2); Out(key:, rank:) :- region(r_regionkey: key, r_name: name), Rank(name:, rank:);',
    "SELECT r_regionkey AS key, rank FROM region JOIN (VALUES ('ASIA', 1), ('EUROPE', 2)) v(name, rank) ON r_name = name")
add("s9_ground_reuse", """@Ground(Spend); Spend(cust:, total? += p) distinct :- orders(o_custkey: cust, o_totalprice: p);
Out(kind: "all", n? += 1, best? Max= Round(total, 2)) distinct :- Spend(cust:, total:); Out(kind: "large", n? += 1, best? Max= Round(total, 2)) distinct :- Spend(cust:, total:), total > 1000000;""",
    """WITH s AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT 'all' AS kind, count(*)::BIGINT AS n, max(round(total, 2)) AS best FROM s
UNION ALL SELECT 'large', count(*), max(round(total, 2)) FROM s WHERE total > 1000000 HAVING count(*) > 0""")
add("s14_today", "Out(n? += 1) distinct :- Today(date:), orders(o_orderdate: d), ToString(d) < date;", "SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderdate < current_date")

# Projection, selection, binding
add("p3_constant", 'Out(key:) :- orders(o_orderkey: key, o_orderstatus: "F");', "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'")
add("p4_repeated_variable", "Out(name:) :- nation(n_nationkey: k, n_regionkey: k, n_name: name);", "SELECT n_name AS name FROM nation WHERE n_nationkey = n_regionkey")
add("p5_wildcard", "Out(name:) :- nation(n_name: name, n_nationkey: _, n_regionkey: _);", "SELECT n_name AS name FROM nation")
add("p6_unification", "Out(key:, gross:) :- orders(o_orderkey: key, o_totalprice: p), net == p * 0.5, gross == net + 1;", "SELECT o_orderkey AS key, o_totalprice * CAST(0.5 AS DOUBLE) + 1 AS gross FROM orders")
add("p8_rest_of", "Copy(..rest) :- nation(..rest); Out(n_name:, n_regionkey:) :- Copy(n_name:, n_regionkey:);", "SELECT n_name, n_regionkey FROM nation")
add("p9_range_filter", "Out(key:) :- lineitem(l_orderkey: key, l_quantity: q, l_discount: d), q >= 10, q < 20, d > 0.05;", "SELECT l_orderkey AS key FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05::DOUBLE")
add("p10_boolean", 'Out(key:, flag: q > 30 && d < 0.05 || s == "O") :- lineitem(l_orderkey: key, l_quantity: q, l_discount: d, l_linestatus: s);', "SELECT l_orderkey AS key, (l_quantity > 30 AND l_discount < 0.05::DOUBLE) OR l_linestatus = 'O' AS flag FROM lineitem")
add("p11_is_null", 'Seen(name:, x: if k > 2 then null else k) :- nation(n_name: name, n_regionkey: k); Out(name:) :- Seen(name:, x:), x is null; Out(name:) :- Seen(name:, x:), x is not null, x == 1;', "SELECT n_name AS name FROM nation WHERE n_regionkey > 2 OR n_regionkey = 1")
add("p12_constraint", "Out(key:) :- part(p_partkey: key, p_size: s), Constraint(s % 7 == 3);", "SELECT p_partkey AS key FROM part WHERE p_size % 7 = 3")
add("p13_like", 'Out(name:) :- customer(c_name: name), Like(name, "%00001%");', "SELECT c_name AS name FROM customer WHERE c_name LIKE '%00001%'")
add("p15_disjunction", 'Out(key:, why:) :- orders(o_orderkey: key, o_totalprice: p), p > 300000, why == "price" | orders(o_orderkey: key, o_orderpriority: "1-URGENT"), why == "urgent";',
    "SELECT o_orderkey AS key, 'price' AS why FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT'")
add("p16_implication_forall", "Out(cust:) distinct :- orders(o_custkey: cust), (orders(o_custkey: cust, o_totalprice: p) => p > 20000);",
    "SELECT DISTINCT o_custkey AS cust FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND NOT coalesce(p.o_totalprice > 20000, false))")
add("p18_member_rows", "Out(name:) :- nation(n_name: name, n_regionkey: k), k in [1, 2, 2];", "SELECT n_name AS name FROM nation JOIN (VALUES (1), (2), (2)) v(x) ON n_regionkey = x")
add("p19_member_test", "Out(name:, inside: (k in [1, 2])) :- nation(n_name: name, n_regionkey: k);", "SELECT n_name AS name, n_regionkey IN (1, 2) AS inside FROM nation")
add("p20_dependent_unnest", 'Out(key:, word:) :- part(p_partkey: key, p_name: name), word in Split(name, " ");', "SELECT p_partkey AS key, unnest(string_split(p_name, ' ')) AS word FROM part")
add("p21_if_else", 'Out(key:, size:) :- orders(o_orderkey: key, o_totalprice: p), size == (if p > 200000 then "large" else if p > 100000 then "medium" else "small");',
    "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size FROM orders")
add("p22_records", "Place(place: {name:, at: {region: k}}) :- nation(n_name: name, n_regionkey: k); Out(name: place.name, region: place.at.region) :- Place(place:);", "SELECT n_name AS name, n_regionkey AS region FROM nation")
add("p22_record_unification", "Place(place: {name:, region: k}) :- nation(n_name: name, n_regionkey: k); Out(a:, b:) :- Place(place:), place == {name: a, region: b};", "SELECT n_name AS a, n_regionkey AS b FROM nation")
add("p23_subscript", 'Out(key:, first: Split(name, " ")[0], third: Split(name, " ")[9]) :- part(p_partkey: key, p_name: name);', "SELECT p_partkey AS key, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[10] AS third FROM part")
add("p25_functional_call", "Net(p, d) = p * (1 - d); Out(key:, line:, net: Net(p, d)) :- lineitem(l_orderkey: key, l_linenumber: line, l_extendedprice: p, l_discount: d);", "SELECT l_orderkey AS key, l_linenumber AS line, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
add("p26_search", "Out(name:, key:) :- nation(n_name: name, n_nationkey: key);", "SELECT n_name AS name, n_nationkey AS key FROM nation WHERE regexp_matches(n_name, '1[0-3]') OR regexp_matches(n_nationkey::VARCHAR, '1[0-3]')", pattern="1[0-3]")

# Joins
add("j1_join_2way", "Out(key:, name:) :- orders(o_orderkey: key, o_custkey: c), customer(c_custkey: c, c_name: name);", "SELECT o_orderkey AS key, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
add("j2_join_3way", "Out(cust:, nation:, region:) :- customer(c_name: cust, c_nationkey: n), nation(n_nationkey: n, n_name: nation, n_regionkey: r), region(r_regionkey: r, r_name: region);",
    "SELECT c_name AS cust, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("j2_join_6way", """Sold(nation:, revenue? += p * (1 - d), n? += 1) distinct :- region(r_regionkey: r, r_name: _), nation(n_nationkey: n, n_name: nation, n_regionkey: r), customer(c_custkey: c, c_nationkey: n),
  orders(o_orderkey: o, o_custkey: c), lineitem(l_orderkey: o, l_suppkey: s, l_extendedprice: p, l_discount: d), supplier(s_suppkey: s, s_nationkey: n);
  Out(nation:, revenue: Round(revenue, 2), n:) :- Sold(nation:, revenue:, n:);""", """SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey GROUP BY 1""")
add("j3_self_join", "Out(a:, b:) :- nation(n_name: a, n_regionkey: r), nation(n_name: b, n_regionkey: r), a < b;", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_name < y.n_name")
add("j4_theta_join", "Out(a:, b:) :- supplier(s_suppkey: a, s_acctbal: x, s_nationkey: 3), supplier(s_suppkey: b, s_acctbal: y, s_nationkey: 4), x < y;",
    "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_acctbal < y.s_acctbal WHERE x.s_nationkey = 3 AND y.s_nationkey = 4")
add("j5_cross_scalar", "Mean(m? Avg= p) distinct :- orders(o_totalprice: p); Out(key:) :- orders(o_orderkey: key, o_totalprice: p), Mean(m:), p > 2 * m;", "SELECT o_orderkey AS key FROM orders WHERE o_totalprice > 2 * (SELECT avg(o_totalprice) FROM orders)")
add("j6_semi_join", "Out(cust:) :- customer(c_custkey: cust), ~(~orders(o_custkey: cust));", "SELECT c_custkey AS cust FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
add("j7_anti_join", "Out(cust:) :- customer(c_custkey: cust), ~orders(o_custkey: cust);", "SELECT c_custkey AS cust FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
add("j8_anti_condition", "Out(cust:) :- customer(c_custkey: cust), ~(orders(o_custkey: cust, o_totalprice: p), p > 200000);", "SELECT c_custkey AS cust FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
add("j8_anti_correlated", "Out(cust:) :- customer(c_custkey: cust, c_acctbal: b), ~(orders(o_custkey: cust, o_totalprice: p), p < b * 2);", "SELECT c_custkey AS cust FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal * 2)")
add("j9_negated_filter", 'Seen(name:, x: if k > 2 then null else k) :- nation(n_name: name, n_regionkey: k); Out(name:) :- Seen(name:, x:), ~(x == 1);', "SELECT n_name AS name FROM nation WHERE n_regionkey <> 1")
add("j10_outer_idiom", """Sum(key:, bought? += 1, sold? += 0) distinct :- customer(c_nationkey: key); Sum(key:, bought? += 0, sold? += 1) distinct :- supplier(s_nationkey: key), key < 20; Out(key:, bought:, sold:) :- Sum(key:, bought:, sold:);""",
    "SELECT key, sum(b)::BIGINT AS bought, sum(s)::BIGINT AS sold FROM (SELECT c_nationkey AS key, 1 AS b, 0 AS s FROM customer UNION ALL SELECT s_nationkey, 0, 1 FROM supplier WHERE s_nationkey < 20) GROUP BY 1")
add("j14_as_of", """Later(key:, at? ArgMax= e -> e) distinct :- Ask(key:, u:, t:), events(event_id: e, user_id: u), e < t; Ask(key: e, u:, t: e) :- events(event_id: e, user_id: u, event_type: "purchase"); Out(key:, at:) :- Later(key:, at:);""",
    "SELECT a.event_id AS key, max(b.event_id) AS at FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id < a.event_id WHERE a.event_type = 'purchase' GROUP BY 1")

# Aggregation
add("a1_sum", "Out(cust:, total? += p) distinct :- orders(o_custkey: cust, o_orderkey: p);", "SELECT o_custkey AS cust, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY 1")
add("a2_array_concat", "Out(key:, all? ++= [n]) distinct :- N(key:, n:); N(key: k, n: 1) :- region(r_regionkey: k);", "SELECT r_regionkey AS key, [1] AS all FROM region")
add("a3_min_max", "Out(seg:, lo? Min= b, hi? Max= b) distinct :- customer(c_mktsegment: seg, c_acctbal: b);", "SELECT c_mktsegment AS seg, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1")
add("a4_avg", "Mean(seg:, m? Avg= b) distinct :- customer(c_mktsegment: seg, c_acctbal: b); Out(seg:, m: Round(m, 4)) :- Mean(seg:, m:);", "SELECT c_mktsegment AS seg, round(avg(c_acctbal), 4) AS m FROM customer GROUP BY 1")
add("a6_count_distinct", "Out(status:, n? Count= c) distinct :- orders(o_orderstatus: status, o_custkey: c);", "SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
add("a8_list", "L(key:, xs? List= n) distinct :- nation(n_regionkey: key, n_name: n); Out(key:, xs: Sort(xs)) :- L(key:, xs:);", "SELECT n_regionkey AS key, list_sort(array_agg(n_name)) AS xs FROM nation GROUP BY 1")
add("a9_set", "Out(status:, xs? Set= p) distinct :- orders(o_orderstatus: status, o_orderpriority: p);", "SELECT o_orderstatus AS status, list_sort(array_agg(DISTINCT o_orderpriority)) AS xs FROM orders GROUP BY 1")
add("a10_ordered_array", "Out(key:, xs? Array= k -> n) distinct :- nation(n_regionkey: key, n_nationkey: k, n_name: n);", "SELECT n_regionkey AS key, array_agg(n_name ORDER BY n_nationkey) AS xs FROM nation GROUP BY 1")
add("a11_arg_max_min", "Out(key:, top? ArgMax= n -> k, low? ArgMin= n -> k) distinct :- nation(n_regionkey: key, n_nationkey: k, n_name: n);", "SELECT n_regionkey AS key, arg_max(n_name, n_nationkey) AS top, arg_min(n_name, n_nationkey) AS low FROM nation GROUP BY 1")
add("a12_arg_max_k", "Top(x) = ArgMaxK(x, 3); Out(cust:, top? Top= o -> o) distinct :- orders(o_custkey: cust, o_orderkey: o);", "SELECT o_custkey AS cust, list_slice(array_agg(o_orderkey ORDER BY o_orderkey DESC), 1, 3) AS top FROM orders GROUP BY 1")
add("a13_some_value", "Out(key:, r? SomeValue= r, one? 1= n) distinct :- nation(n_regionkey: key, n_name: n), r == key;", "SELECT n_regionkey AS key, n_regionkey AS r, min(n_name) AS one FROM nation GROUP BY 1")
add("a14_string_agg", "Out(key:, names? StringAgg= n) distinct :- nation(n_regionkey: key, n_name: n);", "SELECT n_regionkey AS key, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
add("a15_median", "Out(seg:, m? Median= b) distinct :- customer(c_mktsegment: seg, c_acctbal: b);", "SELECT c_mktsegment AS seg, median(c_acctbal) AS m FROM customer GROUP BY 1")
add("a16_logical", "Out(seg:, some? LogicalOr= (b > 9900), every? LogicalAnd= (b > -900)) distinct :- customer(c_mktsegment: seg, c_acctbal: b);", "SELECT c_mktsegment AS seg, bool_or(c_acctbal > 9900) AS some, bool_and(c_acctbal > -900) AS every FROM customer GROUP BY 1")
add("a20_combine_scalar", "Out(name:, total:) :- region(r_name: name, r_regionkey: k), total == (combine += n :- nation(n_nationkey: n));", "SELECT r_name AS name, (SELECT sum(n_nationkey)::BIGINT FROM nation) AS total FROM region")
add("a20_combine_correlated", "Out(cust:, total:) :- customer(c_custkey: cust), total == (combine Max= p :- orders(o_custkey: cust, o_totalprice: p));", "SELECT c_custkey AS cust, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS total FROM customer")
add("a20_combine_list", "Out(name:, xs: Sort(xs)) :- region(r_name: name, r_regionkey: k), xs == (combine List= n :- nation(n_name: n, n_regionkey: k));",
    "SELECT r_name AS name, (SELECT list_sort(array_agg(n_name)) FROM nation WHERE n_regionkey = r_regionkey) AS xs FROM region")
add("a20_combine_inequality", "Out(k:, n:) :- nation(n_nationkey: k), n == (combine += 1 :- nation(n_nationkey: j), j < k);", "SELECT n_nationkey AS k, (SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM nation m WHERE m.n_nationkey < n.n_nationkey) AS n FROM nation n")
add("a21_functional_total", "Total() += k :- orders(o_orderkey: k); Out(share:) :- share == Total() / 2;", "SELECT sum(o_orderkey) / 2.0::DOUBLE AS share FROM orders")
add("a22_distinct", "Out(c:, s:) distinct :- orders(o_custkey: c, o_orderstatus: s);", "SELECT DISTINCT o_custkey AS c, o_orderstatus AS s FROM orders")
add("a23_multi_body", "Out(key:, n? += 1, hi? Max= b) distinct :- customer(c_nationkey: key, c_acctbal: b); Out(key:, n? += 1, hi? Max= b) distinct :- supplier(s_nationkey: key, s_acctbal: b);",
    "SELECT key, count(*)::BIGINT AS n, max(b) AS hi FROM (SELECT c_nationkey AS key, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1")
add("a25_conditional", "Out(flag:, n? += (if q > 25 then 1 else 0)) distinct :- lineitem(l_returnflag: flag, l_quantity: q);", "SELECT l_returnflag AS flag, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS n FROM lineitem GROUP BY 1")
add("a27_constant_key", 'Out(kind: "all", n? += 1) distinct :- lineitem(l_orderkey: k);', "SELECT 'all' AS kind, count(*)::BIGINT AS n FROM lineitem")

# Windows
add("w1_cumulative", "Out(k:, run: CumulativeSum(k, [r], [k]), hi: CumulativeMax(k, [r], [k]), lo: CumulativeMin(k, [r], [k])) :- nation(n_nationkey: k, n_regionkey: r);",
    "SELECT n_nationkey AS k, (sum(n_nationkey) OVER w)::BIGINT AS run, max(n_nationkey) OVER w AS hi, min(n_nationkey) OVER w AS lo FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING)")
add("w4_window_rows", "Out(k:, run: WindowSum(k, [r], [k], 2), hi: WindowMax(k, [r], [k], 2), lo: WindowMin(k, [r], [k], 2)) :- nation(n_nationkey: k, n_regionkey: r);",
    "SELECT n_nationkey AS k, (sum(n_nationkey) OVER w)::BIGINT AS run, max(n_nationkey) OVER w AS hi, min(n_nationkey) OVER w AS lo FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS 2 PRECEDING)")
add("w7_ranking", "Out(o:, rank: RowNumber(o, [c], [o]), before: Lag(o, [c], [o], 1)) :- orders(o_orderkey: o, o_custkey: c);", "SELECT o_orderkey AS o, (row_number() OVER w)::INTEGER AS rank, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")

# Order and limits
add("o2_top_k", '@OrderBy(Out, "p", "DESC", "k"); @Limit(Out, 10); Out(k:, p:) :- orders(o_orderkey: k, o_totalprice: p);', "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10")
add("o3_inline", 'Out(k:, p:) order_by("p desc", "k") limit(7) :- orders(o_orderkey: k, o_totalprice: p);', "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 7")
add("o4_offset", '@OrderBy(Out, "k"); Out(k:) :- orders(o_orderkey: k);', "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 5 OFFSET 12", limit=5, offset=12)

# Sets
add("u1_union_all", "Out(key:) :- customer(c_nationkey: key); Out(key:) :- supplier(s_nationkey: key);", "SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("u2_union", "Out(key:) distinct :- customer(c_nationkey: key); Out(key:) distinct :- supplier(s_nationkey: key);", "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
add("u4_intersect", "A(k:) distinct :- customer(c_nationkey: k), k < 15; B(k:) distinct :- supplier(s_nationkey: k), k > 8; Out(k:) :- A(k:), B(k:);", "SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 15 INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 8")
add("u5_except", "A(k:) distinct :- customer(c_nationkey: k), k < 15; B(k:) distinct :- supplier(s_nationkey: k), k > 8; Out(k:) :- A(k:), ~B(k:);", "SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 15 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 8")
add("u6_symmetric_difference", "A(k:) distinct :- customer(c_nationkey: k), k < 15; B(k:) distinct :- supplier(s_nationkey: k), k > 8; Out(k:) :- A(k:), ~B(k:); Out(k:) :- B(k:), ~A(k:);",
    "(SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 15 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 8) UNION ALL (SELECT s_nationkey FROM supplier WHERE s_nationkey > 8 EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey < 15)")

# Recursion
add("r2_mutual", "@Recursive(Even, 12); @Recursive(Odd, 12); Even(n: 0) distinct; Even(n:) distinct :- Odd(n: m), n == m + 1; Odd(n:) distinct :- Even(n: m), n == m + 1; Out(n:) :- Even(n:);", "SELECT unnest([0, 2, 4, 6, 8, 10, 12])::INTEGER AS n")

# Parameterised predicates, flags, functions
add("m1_functor", 'Spend(cust:, total? Max= p) distinct :- Wanted(cust:), orders(o_custkey: cust, o_totalprice: p); Wanted(cust:) distinct :- customer(c_custkey: cust); Few(cust:) distinct :- customer(c_custkey: cust, c_mktsegment: "BUILDING"); FewSpend := Spend(Wanted: Few); Out(cust:, total:) :- FewSpend(cust:, total:);',
    "SELECT o_custkey AS cust, max(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
add("m2_functor_constant", "Least() = 0; Rich(cust:) :- customer(c_custkey: cust, c_acctbal: b), b > Least(); VeryRich := Rich(Least: 9000); Out(cust:) :- VeryRich(cust:);", "SELECT c_custkey AS cust FROM customer WHERE c_acctbal > 9000")
add("m6_flags", '@DefineFlag("status", "F"); @ResetFlagValue("status", "O"); Out(key:) :- orders(o_orderkey: key, o_orderstatus: s), s == FlagValue("status");', "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'O'")
add("m10_macro_relation", "Twice(x:, r:) :- r == x * 2; Out(k:, r:) :- nation(n_nationkey: k), Twice(x: k, r:);", "SELECT n_nationkey AS k, n_nationkey * 2 AS r FROM nation")

# Scalar functions
add("f_text", 'Out(k:, u: Upper(n), l: Lower(n), t: Trim("  x "), len: Length(n), sub: Substr(n, 2, 3), rep: Replace(n, "N", "x"), cat: n ++ "-" ++ n, starts: StartsWith(n, "NA")) :- nation(n_nationkey: k, n_name: n);',
    "SELECT n_nationkey AS k, upper(n_name) AS u, lower(n_name) AS l, trim('  x ') AS t, length(n_name)::INTEGER AS len, substr(n_name, 2, 3) AS sub, replace(n_name, 'N', 'x') AS rep, n_name || '-' || n_name AS cat, starts_with(n_name, 'NA') AS starts FROM nation")
add("f_split_join", 'Out(k:, parts: Split(n, " "), back: Join(Split(n, " "), "+"), none: Split("a.b", ".")) :- part(p_partkey: k, p_name: n);', "SELECT p_partkey AS k, string_split(p_name, ' ') AS parts, array_to_string(string_split(p_name, ' '), '+') AS back, ['a', 'b'] AS none FROM part")
add("f_arrays", "Out(k:, n: Size(Range(k)), xs: Range(k), cat: ArrayConcat([k], [1, 1]), u: Unique([k, 1, 1]), s: Sort([k, 2]), e: Element([k, 5], 1), o: Element([k], 3)) :- nation(n_nationkey: k);",
    "SELECT n_nationkey AS k, n_nationkey::BIGINT AS n, range(n_nationkey::BIGINT) AS xs, [n_nationkey, 1, 1] AS cat, list_sort(list_distinct([n_nationkey, 1])) AS u, list_sort([n_nationkey, 2]) AS s, 5 AS e, NULL::INTEGER AS o FROM nation")
add("f_math", "Out(k:, a: Abs(0 - k), e: Round(Exp(k / 10), 6), s: Round(Sqrt(k), 6), f: Floor(k / 4), c: Ceil(k / 4), l: Round(Log(k + 1), 6), p: k ^ 2, m: k % 7, g: Greatest(k, 5), w: Least(k, 5), d: k / 4) :- nation(n_nationkey: k);",
    "SELECT n_nationkey AS k, n_nationkey AS a, round(exp(n_nationkey / 10.0::DOUBLE), 6) AS e, round(sqrt(n_nationkey), 6) AS s, floor(n_nationkey / 4.0::DOUBLE) AS f, ceil(n_nationkey / 4.0::DOUBLE) AS c, round(ln(n_nationkey + 1), 6) AS l, pow(n_nationkey, 2) AS p, n_nationkey % 7 AS m, greatest(n_nationkey, 5) AS g, least(n_nationkey, 5) AS w, n_nationkey / 4.0::DOUBLE AS d FROM nation")
add("f_casts", 'Out(k:, i: ToInt64(k / 2), f: ToFloat64(k), s: ToString(k), t: ToString(k / 4), c: Cast(k, "string"), n: TryCast("x", "int64"), h: ToInt64("12.7")) :- nation(n_nationkey: k);',
    "SELECT n_nationkey AS k, (n_nationkey / 2.0::DOUBLE)::BIGINT AS i, n_nationkey::DOUBLE AS f, n_nationkey::VARCHAR AS s, (n_nationkey / 4.0::DOUBLE)::VARCHAR AS t, n_nationkey::VARCHAR AS c, NULL::BIGINT AS n, 13::BIGINT AS h FROM nation")
add("f_nulls", "Seen(k:, x: if k > 2 then null else k) :- nation(n_nationkey: k); Out(k:, a: Coalesce(x, -1), b: IsNull(x), c: IfNull(x, 9), d: NullIf(k, 3)) :- Seen(k:, x:);",
    "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 2 THEN -1 ELSE n_nationkey END AS a, n_nationkey > 2 AS b, CASE WHEN n_nationkey > 2 THEN 9 ELSE n_nationkey END AS c, nullif(n_nationkey, 3) AS d FROM nation")
add("f_format", 'Out(k:, s: Format("%s has %d", n, k)) :- nation(n_nationkey: k, n_name: n);', "SELECT n_nationkey AS k, printf('%s has %d', n_name, n_nationkey) AS s FROM nation")
add("f_json", 'Out(e:, k:) :- events(event_id: e, props: p), k == JsonExtractScalar(p, "$.k");', "SELECT event_id AS e, json_extract_string(props, '$.k') AS k FROM events")
add("f_division_by_zero", "Out(k:, d: (k - 1) / (k - k)) :- region(r_regionkey: k);", "SELECT r_regionkey AS k, CASE WHEN r_regionkey = 1 THEN 'nan'::DOUBLE WHEN r_regionkey > 1 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS d FROM region")
add("f_month", "Out(month:, n? += 1) distinct :- events(ts: t), month == Substr(ToString(t), 1, 7);", "SELECT strftime(ts, '%Y-%m') AS month, count(*)::BIGINT AS n FROM events GROUP BY 1")
add("f_hour", "Out(hour:, n? += 1) distinct :- events(ts: t), hour == ToInt64(Substr(ToString(t), 12, 2));", "SELECT hour(ts)::BIGINT AS hour, count(*)::BIGINT AS n FROM events GROUP BY 1")
add("f_dates", 'Out(k:, next: ToString(DateAddDay(d, 30)), gap: DateDiffDay(d, "1992-01-01")) :- orders(o_orderkey: k, o_orderdate: d);', "SELECT o_orderkey AS k, (o_orderdate::DATE + 30)::VARCHAR AS next, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS gap FROM orders")
add("f_hashes", 'Out(k:, m: ToHex(Md5(n)), s: ToHex(Sha256(n))) :- nation(n_nationkey: k, n_name: n);', "SELECT n_nationkey AS k, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
add("f_regex", 'Out(k:, hit: RegexpContains(n, "[0-9]+$"), num: RegexpExtract(n, "[0-9]+"), rep: RegexpReplace(n, "[0-9]", "#")) :- customer(c_custkey: k, c_name: n);', "SELECT c_custkey AS k, regexp_matches(c_name, '[0-9]+$') AS hit, nullif(regexp_extract(c_name, '[0-9]+'), '') AS num, regexp_replace(c_name, '[0-9]', '#', 'g') AS rep FROM customer")

# More of the inventory
add("p7_assignment", "Out(k:, y:) :- nation(n_nationkey: k), y = k + 1;", "SELECT n_nationkey AS k, n_nationkey + 1 AS y FROM nation")
add("p17_equivalence", "Out(k:) :- nation(n_nationkey: k, n_regionkey: r), (k > 10 <=> r > 2);", "SELECT n_nationkey AS k FROM nation WHERE (n_nationkey > 10) = (n_regionkey > 2)")
add("j6_bag_semi", "Out(name:) :- customer(c_custkey: c, c_name: name), orders(o_custkey: c, o_orderpriority: \"1-URGENT\");", "SELECT c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
add("j13_point_in_time", "Out(n? += 1) distinct :- orders(o_orderdate: a, o_orderkey: k), lineitem(l_orderkey: k, l_shipdate: b), Today(date:), ToString(a) <= date, ToString(b) <= date;", "SELECT count(*)::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate <= current_date AND l_shipdate <= current_date")
add("a7_exact_count", "Out(n? ExactCount= s) distinct :- lineitem(l_suppkey: s);", "SELECT count(DISTINCT l_suppkey) AS n FROM lineitem")
add("a12_arg_min_k", "Low(x) = ArgMinK(x, 2); Out(seg:, few? Low= c -> c) distinct :- customer(c_custkey: c, c_mktsegment: seg);", "SELECT c_mktsegment AS seg, list_slice(array_agg(c_custkey ORDER BY c_custkey), 1, 2) AS few FROM customer GROUP BY 1")
add("a17_product", "Out(r:, p? *= ToFloat64(k + 1)) distinct :- nation(n_regionkey: r, n_nationkey: k);", "SELECT n_regionkey AS r, product(n_nationkey + 1) AS p FROM nation GROUP BY 1")
add("a_statistics", "S(seg:, sd? StddevSamp= b, vp? VarPop= b, c? Corr= k -> b) distinct :- customer(c_custkey: k, c_mktsegment: seg, c_acctbal: b); Out(seg:, sd: Round(sd, 4), vp: Round(vp / 1000000, 4), c: Round(c, 6)) :- S(seg:, sd:, vp:, c:);",
    "SELECT c_mktsegment AS seg, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal) / 1000000, 4) AS vp, round(corr(c_acctbal, c_custkey), 6) AS c FROM customer GROUP BY 1")
add("a_bits", "Out(r:, a? BitAnd= k, o? BitOr= k, x? BitXor= k) distinct :- nation(n_regionkey: r, n_nationkey: k);", "SELECT n_regionkey AS r, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY 1")
add("w7_more", "Out(k:, d: DenseRank(k, [r], [k]), q: Ntile(k, [], [k], 5), f: FirstValue(k, [r], [k]), n: Lead(k, [r], [k], 2)) :- nation(n_nationkey: k, n_regionkey: r);",
    "SELECT n_nationkey AS k, (dense_rank() OVER w)::INTEGER AS d, (ntile(5) OVER (ORDER BY n_nationkey))::INTEGER AS q, first_value(n_nationkey) OVER w AS f, lead(n_nationkey, 2) OVER w AS n FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
add("f_more_text", 'Out(k:, a: Lpad(n, 12, "*"), b: Repeat("ab", k % 3), c: Reverse(n), d: ByteLength(n), e: Strpos(n, "N"), f: EndsWith(n, "A"), g: Ord(n)) :- nation(n_nationkey: k, n_name: n);',
    "SELECT n_nationkey AS k, lpad(n_name, 12, '*') AS a, repeat('ab', n_nationkey % 3) AS b, reverse(n_name) AS c, octet_length(encode(n_name))::INTEGER AS d, instr(n_name, 'N')::INTEGER AS e, ends_with(n_name, 'A') AS f, ascii(n_name) AS g FROM nation")
add("f_trigonometry", "Out(k:, a: Round(Sin(k), 6), b: Round(Atan2(k, 2), 6), c: Round(Tanh(k / 10), 6), d: Round(Log10(k + 1), 6), e: Trunc(k / 4), f: Sign(k - 3)) :- nation(n_nationkey: k);",
    "SELECT n_nationkey AS k, round(sin(n_nationkey), 6) AS a, round(atan2(n_nationkey, 2), 6) AS b, round(tanh(n_nationkey / 10.0::DOUBLE), 6) AS c, round(log10(n_nationkey + 1), 6) AS d, trunc(n_nationkey / 4.0::DOUBLE) AS e, sign(n_nationkey - 3)::DOUBLE AS f FROM nation")
add("f_points", "Out(k:, km: Round(StDistance(StGeogpoint(k, 10), StGeogpoint(0, 10)) / 1000, 3)) :- nation(n_nationkey: k);",
    "SELECT n_nationkey AS k, round(2 * 6371.010 * asin(sqrt(pow(cos(radians(10)), 2) * pow(sin(radians(n_nationkey) / 2), 2))), 3) AS km FROM nation")

# Times, overlaps and paths
add("f_times", "Out(e:, u: UnixDate(Date(t)), m: Substr(ToString(TimestampTrunc(t, \"MONTH\")), 1, 10)) :- events(event_id: e, ts: t);",
    "SELECT event_id AS e, date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS u, strftime(date_trunc('month', ts), '%Y-%m-%d') AS m FROM events")
add("j12_interval_overlap", """Span(kind:, lo? Min= Substr(ToString(t), 1, 19), hi? Max= Substr(ToString(t), 1, 19)) distinct :- events(event_type: kind, ts: t); Out(a:, b:) :- Span(kind: a, lo: s1, hi: e1), Span(kind: b, lo: s2, hi: e2), s1 <= e2 && s2 <= e1, a < b;""",
    "WITH s AS (SELECT event_type AS kind, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1) SELECT x.kind AS a, y.kind AS b FROM s x, s y WHERE x.lo <= y.hi AND y.lo <= x.hi AND x.kind < y.kind")
add("a20_braces", "Out(name:, best: Max{p :- orders(o_custkey: k, o_totalprice: p)}) :- customer(c_custkey: k, c_name: name);", "SELECT c_name AS name, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")
add("r1_closure_bag", LINK + "@Recursive(Out, 4); Out(a:, b:) :- Edge(a:, b:); Out(a:, b:) :- Out(a:, b: m), Edge(a: m, b:);", f"WITH RECURSIVE {LINK_SQL}, r AS (SELECT a, b, 0 AS lvl FROM edge UNION ALL SELECT r.a, edge.b, lvl + 1 FROM r JOIN edge ON r.b = edge.a WHERE lvl < 4) SELECT a, b FROM r")
add("r1_closure_distinct", LINK + "@Recursive(Out, -1); Out(a:, b:) distinct :- Edge(a:, b:); Out(a:, b:) distinct :- Out(a:, b: m), Edge(a: m, b:);", f"WITH RECURSIVE {LINK_SQL}, r AS (SELECT a, b FROM edge UNION SELECT r.a, edge.b FROM r JOIN edge ON r.b = edge.a) SELECT a, b FROM r")
add("r7_shortest_path", LINK + "@Recursive(Path, -1); Path(b:, d? Min= 0) distinct :- Edge(a: 1, b: x), b == 1; Path(b:, d? Min= e + 1) distinct :- Path(b: m, d: e), Edge(a: m, b:); Out(b:, d:) :- Path(b:, d:);",
    f"WITH RECURSIVE {LINK_SQL}, r AS (SELECT 1::BIGINT AS b, 0 AS d UNION SELECT edge.b, r.d + 1 FROM r JOIN edge ON r.b = edge.a) SELECT b, min(d) AS d FROM r GROUP BY 1")

for _name, _program, _sql, _more in MORE:
    add(_name, _program, _sql, **_more)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in Q.items() if q.sql}
