"""Constraints over orders, lineitems and customers, some of which don't hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import constraints as C
from tallyline.queries.comparison import read


def constraint_violations(spark, sf_dir):
    """Broken keys, references and checks with the number of their rows."""
    tables = {t: read(spark, sf_dir, t) for t in ("orders", "lineitem", "customer")}
    key = ("l_orderkey", "l_linenumber")
    return C.violations(tables, [
        C.Unique("orders", ("o_orderkey",)), C.Unique("lineitem", key), C.Unique("orders", ("o_custkey", "o_orderpriority")),
        C.Reference("orders", ("o_custkey",), "customer", ("c_custkey",)), C.Reference("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), C.Reference("customer", ("c_custkey",), "orders", ("o_custkey",)),
        C.Reference("lineitem", ("l_orderkey", "l_returnflag"), "orders", ("o_orderkey", "o_orderstatus")),
        C.Check("lineitem", "discount", F.col("l_discount") < 0.1, key), C.Check("lineitem", "quantity", F.col("l_quantity") >= 2, key), C.Check("customer", "balance", F.col("c_acctbal") >= 0, ("c_custkey",)),
    ])


_SQL = """select 'orders' as "table", 'unique o_orderkey' as "constraint", o_orderkey::varchar as key, count(*) as n from orders group by o_orderkey having count(*) > 1
union all select 'lineitem', 'unique l_orderkey l_linenumber', l_orderkey || '|' || l_linenumber, count(*) from lineitem group by l_orderkey, l_linenumber having count(*) > 1
union all select 'orders', 'unique o_custkey o_orderpriority', o_custkey || '|' || o_orderpriority, count(*) from orders group by o_custkey, o_orderpriority having count(*) > 1
union all select 'orders', 'o_custkey references customer', o_custkey::varchar, count(*) from orders where o_custkey not in (select c_custkey from customer) group by o_custkey
union all select 'lineitem', 'l_orderkey references orders', l_orderkey::varchar, count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) group by l_orderkey
union all select 'customer', 'c_custkey references orders', c_custkey::varchar, count(*) from customer where c_custkey not in (select o_custkey from orders) group by c_custkey
union all select 'lineitem', 'l_orderkey l_returnflag references orders', l_orderkey || '|' || l_returnflag, count(*) from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = l_returnflag) group by l_orderkey, l_returnflag
union all select 'lineitem', 'discount', l_orderkey || '|' || l_linenumber, count(*) from lineitem where not l_discount < 0.1 group by l_orderkey, l_linenumber
union all select 'lineitem', 'quantity', l_orderkey || '|' || l_linenumber, count(*) from lineitem where not l_quantity >= 2 group by l_orderkey, l_linenumber
union all select 'customer', 'balance', c_custkey::varchar, count(*) from customer where not c_acctbal >= 0 group by c_custkey"""

QUERIES = {"constraint_violations": (constraint_violations, _SQL)}
