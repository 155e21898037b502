"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .functions import atom, decision, formatted, literal_key, literal_max, literal_min, negation, propagated, sanitized, sign, tautology_atom, with_sign
from .plans import fixpoint, sat_graph, solver
from .relation import Relation, net
from .sources import Engine, table

CUT1, CUT2 = "1998-01-01", "2000-01-01"


def _orders(spark, d, *columns):
    return table(spark, d, "orders", *columns)


def _by_customer(spark, d):
    return _orders(spark, d, F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("v"))


def nation_top_dates(spark: SparkSession, d: str) -> DataFrame:
    """The three last order dates of each customer nation."""
    customers = table(spark, d, "customer", F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    dates = op.counts(op.map(op.join(_by_customer(spark, d), customers, "k"), nation="nation", order_date="v"))
    return op.top_ns(dates, "nation", "order_date", 3, exploded=True).df


def consolidate(spark, d):
    return net(table(spark, d, "lineitem", "l_partkey", "l_suppkey")).df


def concat(spark, d):
    a, b = (table(spark, d, t, F.col(c).alias("nation")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return net(op.concat(a, b)).df


def distinct(spark, d):
    return op.distinct(table(spark, d, "lineitem", "l_partkey", "l_returnflag")).df


def counts(spark, d):
    return op.counts(table(spark, d, "lineitem", "l_returnflag", "l_linestatus")).df


def map_filter(spark, d):
    lines = op.filter(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag = 'R'")
    return net(op.map(lines, bucket="l_orderkey % 100", line="l_linenumber * 2")).df


def flat_map(spark, d):
    return net(op.flat_map(table(spark, d, "part", "p_size"), "array(p_size, 2 * p_size)", x="it")).df


def flatten(spark, d):
    return net(op.flatten(table(spark, d, "part", F.split("p_name", " ").alias("words")), "words", "word")).df


def fsts(spark, d):
    return net(op.fsts(_by_customer(spark, d), "k")).df


def snds(spark, d):
    return net(op.snds(_by_customer(spark, d), "k")).df


def swaps(spark, d):
    return net(op.swaps(_by_customer(spark, d))).df


def split(spark, d):
    k, v = op.split(table(spark, d, "lineitem", F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("v")), "k")
    return net(op.concat(op.map(k, side="'k'", x="k"), op.map(v, side="'v'", x="v"))).df


def partition(spark, d):
    left, right = op.partition(table(spark, d, "events", "event_type", "user_id"), "event_type = 'click'", {"x": "user_id"}, {"x": "event_type"})
    return net(op.concat(op.map(left, side="'left'", x="cast(x AS string)"), op.map(right, side="'right'", x="x"))).df


def join(spark, d):
    lines = table(spark, d, "lineitem", F.col("l_orderkey").alias("k"), "l_returnflag")
    return net(op.map(op.join(lines, _orders(spark, d, F.col("o_orderkey").alias("k"), "o_orderpriority"), "k"), k="k", l_returnflag="l_returnflag", o_orderpriority="o_orderpriority")).df


def join_values(spark, d):
    lines = table(spark, d, "lineitem", F.col("l_orderkey").alias("k"), "l_returnflag")
    return net(op.join_values(lines, _orders(spark, d, F.col("o_orderkey").alias("k"), "o_orderpriority"), "k")).df


def semijoin_weighted(spark, d):
    """Parts by the number of lines that return them: the right side's multiplicities count."""
    returned = op.filter(table(spark, d, "lineitem", F.col("l_partkey").alias("k"), "l_returnflag"), "l_returnflag = 'R'")
    return net(op.semijoin(table(spark, d, "part", F.col("p_partkey").alias("k"), "p_brand"), op.fsts(returned, "k"), "k")).df


def antijoin(spark, d):
    returned = op.filter(table(spark, d, "lineitem", F.col("l_orderkey").alias("k"), "l_returnflag"), "l_returnflag = 'R'")
    return net(op.antijoin(_orders(spark, d, F.col("o_orderkey").alias("k"), "o_orderpriority"), op.fsts(returned, "k"), "k")).df


def cartesian_product(spark, d):
    return op.cartesian_product(table(spark, d, "region", "r_name"), table(spark, d, "nation", "n_name")).df


def _parts(spark, d, flag):
    return op.map(op.filter(table(spark, d, "lineitem", "l_partkey", "l_returnflag"), F.col("l_returnflag") == flag), k="l_partkey")


def intersection(spark, d):
    return op.intersection(_parts(spark, d, "R"), _parts(spark, d, "A")).df


def set_minus(spark, d):
    return net(op.set_minus(_parts(spark, d, "N"), _parts(spark, d, "R"))).df


def top_ns3(spark, d):
    return op.top_ns(_by_customer(spark, d), "k", "v", 3, exploded=True).df


def top_ns_array(spark, d):
    tops = op.top_ns(table(spark, d, "lineitem", F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v")), "k", "v", 3).df
    return tops.select("k", F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))).alias("v"), "n")


def random_ns(spark, d):
    return op.random_ns(_by_customer(spark, d), "k", "v", 2, 42, exploded=True).df


def maxes(spark, d):
    return op.maxes(_by_customer(spark, d), "k").df


def mins(spark, d):
    return op.mins(_by_customer(spark, d), "k").df


def global_max(spark, d):
    return op.global_max(_orders(spark, d, "o_custkey", "o_orderkey")).df


def global_min(spark, d):
    return op.global_min(_orders(spark, d, "o_custkey", "o_orderkey")).df


def save_distinct_concat(spark, d):
    saved = op.save(table(spark, d, "lineitem", "l_suppkey"))
    return net(op.concat(op.distinct(saved.get()), saved.get_())).df


def _shipped(spark, d):
    """Lines come when they ship, before two cuts, and go if they are returned, after the first."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_returnflag", F.to_date("l_shipdate").alias("day"))
    came = line.select("l_suppkey", "l_returnflag", F.lit(1).alias("n"), F.when(F.col("day") < F.lit(CUT1).cast("date"), 1).when(F.col("day") < F.lit(CUT2).cast("date"), 2).otherwise(3).alias("commit_id"))
    gone = came.where("l_returnflag = 'R' and commit_id = 1").select("l_suppkey", "l_returnflag", F.lit(-1).alias("n"), F.lit(2).alias("commit_id"))
    engine = Engine(spark)
    shipped = engine.new_input("l_suppkey long, l_returnflag string")
    shipped.load(came.unionByName(gone))
    return engine, shipped


def snapshot_diff(spark, d):
    """What the second commit changes in the number of lines of each supplier."""
    engine, shipped = _shipped(spark, d)
    out = engine.output(lambda at: op.counts(op.fsts(shipped.at(at), "l_suppkey")), shipped)
    return out.changes(1, 2).df


def snapshot(spark, d):
    engine, shipped = _shipped(spark, d)
    return engine.output(lambda at: shipped.at(at), shipped).snapshot(2).df


def event_counts(spark, d):
    return op.counts(table(spark, d, "events", "event_type", "user_id")).df


def _trade(spark, d) -> DataFrame:
    """Nations that customers' orders link to suppliers' nations, by large, well discounted lines."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity >= 50 and l_discount >= 0.09").select("l_orderkey", "l_suppkey")
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    customer = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("src"))
    supplier = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("src", "dst").agg((F.min("l_orderkey") % 7 + 1).alias("w"))


def closure(spark, d):
    return fixpoint.closure(_trade(spark, d)).df


def reachable(spark, d):
    """Nations that can be reached from nation 0, itself included, by the semi-naive loop."""
    edges = fixpoint.scratch(_trade(spark, d).select("src", "dst"), "edges")
    seed = spark.createDataFrame([(0,)], "node int")
    return fixpoint.semi_naive(seed, lambda delta: delta.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")))


def shortest_path(spark, d):
    edges = fixpoint.scratch(_trade(spark, d), "edges")
    return fixpoint.shortest_paths(edges, edges.agg(F.min("src")).first()[0]).df.select("node", "d")


def frames(spark, d):
    """Regions, of which a frame's are taken back."""
    loop = fixpoint.Loop(spark)
    loop.new_input("kept", "name string")
    names = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name"), "r_regionkey")
    loop.insert("kept", names.where("r_regionkey < 2"))
    with loop.with_frame():
        loop.insert("kept", names.where("r_regionkey >= 2"))
    loop.insert("kept", names.where("r_regionkey = 3"))
    return loop["kept"]


def _clauses(spark, d) -> DataFrame:
    """Clauses of two literals, negative and positive, from parts and suppliers' numbers."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity >= 48 and l_discount >= 0.08").select("l_orderkey", "l_linenumber", "l_suppkey")
    pair = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rule"), (-(F.col("l_suppkey") % 40 + 1)).alias("a"), ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 40 + 1).alias("b")).where("abs(a) <> b")
    return pair.select("rule", F.explode(F.array("a", "b")).alias("lit"))


def implications(spark, d):
    """All that two-literal clauses imply, directly or by way of others."""
    rules = fixpoint.scratch(_clauses(spark, d), "clauses")
    pairs = fixpoint.closure(sat_graph.base_implication(rules), "x", "y").df
    return pairs.select(F.col("src").alias("x"), F.col("dst").alias("y"))


def literal_extremes(spark, d):
    """The least and greatest literal of each rule, in literal order."""
    r = Relation.of(_clauses(spark, d))
    low, high = op.mins(r, "rule", literal_key(F.col("lit"))), op.maxes(r, "rule", literal_key(F.col("lit")))
    return op.join(op.map(low, rule="rule", low="lit"), op.map(high, rule="rule", high="lit"), "rule").df


def next_literal(spark, d):
    return sat_graph.next_literal(_clauses(spark, d))


def set_minus_pairs(spark, d):
    """(part, supplier) pairs that are sold and never returned, as often as they are sold."""
    sold, returned = (op.map(op.filter(table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag"), w), part="l_partkey", supp="l_suppkey") for w in ("l_returnflag <> 'R'", "l_returnflag = 'R'"))
    return net(op.set_minus(sold, returned)).df


def unconsolidate(spark, d):
    """A netted relation, put beside itself and netted again."""
    netted = op.unconsolidate(net(table(spark, d, "lineitem", "l_suppkey")))
    return net(op.concat(netted, netted)).df


def random_ns_properties(spark, d):
    """Of each customer's two picked dates: how many, whether they are the customer's own, and whether another run picks the same."""
    rows = _by_customer(spark, d)
    picked = op.random_ns(rows, "k", "v", 2, 42, exploded=True).df.select("k", "v")
    again = op.random_ns(rows, "k", "v", 2, 42, exploded=True).df.select("k", "v", F.lit(True).alias("again"))
    own = rows.df.select("k", "v").distinct().withColumn("own", F.lit(True))
    joined = picked.join(own, ["k", "v"], "left").join(again, ["k", "v"], "left")
    return joined.groupBy("k").agg(F.count("*").alias("picked"), F.count("own").alias("own"), F.count("again").alias("again"))


def commit_pull(spark, d):
    """What the second pull brings after two commits: suppliers' line counts that change as returned lines go."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_returnflag")
    engine = Engine(spark)
    lines = engine.new_input("l_suppkey long, l_returnflag string")
    out = engine.output(lambda at: op.counts(op.fsts(lines.at(at), "l_suppkey")), lines)
    lines.append(line.withColumn("n", F.lit(1).cast("long")))
    engine.commit()
    out.pull()
    lines.append(line.where("l_returnflag = 'R'").withColumn("n", F.lit(-1).cast("long")))
    engine.commit()
    return out.pull().df


def constant_input(spark, d):
    """Nations of two regions that are given as constants, each as often as its region is given."""
    engine = Engine(spark)
    regions = engine.constant([((0,), 1), ((3,), 2)], "r long")
    engine.commit()
    nations = table(spark, d, "nation", F.col("n_regionkey").cast("long").alias("r"), "n_name")
    return net(op.join(nations, regions.at(engine.commit_id), "r")).df


def loop_feedback(spark, d):
    """Nations reached from nation 0 by a loop that feeds on itself."""
    edges = fixpoint.scratch(_trade(spark, d).select("src", "dst"), "edges")
    loop = fixpoint.Loop(spark)
    loop.new_input("reached", "node int")
    loop.set_feedback("reached", lambda at: at["reached"].join(edges, F.col("node") == F.col("src")).select(F.col("dst").cast("int").alias("node")))
    loop.insert("reached", [(0,)])
    loop.commit()
    return loop.output(lambda at: at["reached"])


def loop_interrupt(spark, d):
    """The number of the interrupt that stops the loop: the second condition comes true, the first never does."""
    edges = fixpoint.scratch(_trade(spark, d).select("src", "dst"), "edges")
    loop = fixpoint.Loop(spark)
    loop.new_input("reached", "node int")
    loop.set_interrupt(lambda at: at["reached"].where("node < 0"))
    loop.set_interrupt(lambda at: at["reached"].groupBy().count().where("count > 3"))
    loop.set_feedback("reached", lambda at: at["reached"].join(edges, F.col("node") == F.col("src")).select(F.col("dst").cast("int").alias("node")))
    loop.insert("reached", [(0,)])
    stopped = loop.commit()
    return spark.range(1).select(F.lit(stopped).cast("long").alias("stopped"), F.lit(loop.is_empty(lambda at: at["reached"].where("node < 0"))).alias("first_is_empty"))


def loop_first_occurrences(spark, d):
    """How many steps each nation is from nation 0: the first value of a node stays."""
    edges = fixpoint.scratch(_trade(spark, d).select("src", "dst"), "edges")
    loop = fixpoint.Loop(spark)
    loop.new_first_occurrences_input("steps", "node int, d long", ["node"])
    loop.set_feedback("steps", lambda at: at["steps"].join(edges, F.col("node") == F.col("src")).select(F.col("dst").cast("int").alias("node"), (F.col("d") + 1).alias("d")))
    loop.insert("steps", [(0, 0)])
    loop.commit()
    return loop["steps"]


def loop_frameless(spark, d):
    """Regions that no frame takes back, beside those that it does."""
    loop = fixpoint.Loop(spark)
    loop.new_frameless_input("lasting", "name string")
    loop.new_input("passing", "name string")
    names = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name"))
    with loop.with_frame():
        loop.insert("lasting", names)
        loop.insert("passing", names)
    return loop["lasting"].withColumn("kind", F.lit("lasting")).unionByName(loop["passing"].withColumn("kind", F.lit("passing")))


def _signed(spark, d) -> DataFrame:
    """Clauses by order: the supplier's number, less a multiple, negative where the line is returned."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    return line.select(F.col("l_orderkey").alias("rule"), (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * (F.col("l_suppkey") % 50 + 1)).alias("lit")).distinct()


def literal_functions(spark, d):
    lit = F.col("lit")
    return _signed(spark, d).select("rule", "lit", negation(lit).alias("negated"), atom(lit).alias("atom"), sign(lit).alias("positive"), with_sign(F.col("rule"), sign(lit)).alias("signed"), literal_min(lit, -lit).alias("least"), literal_max(lit, F.lit(25).cast("long")).alias("greatest"))


def causes(spark, d):
    """The greater of two causes of each literal's atom: a propagated one comes behind a chosen one."""
    both = _signed(spark, d).select("lit", F.when(F.col("rule") % 3 == 0, decision(F.col("rule") % 5)).otherwise(propagated(F.col("rule"), F.col("rule") % 7)).alias("cause"))
    return both.groupBy("lit").agg(F.max("cause").alias("c")).select("lit", F.col("c.kind").cast("int").alias("kind"), F.col("c.rule").alias("rule"), F.col("c.level").alias("level"))


def clause_lines(spark, d):
    """Clauses in literal order as lines of a proof, and the atom by which one is a tautology."""
    rules = _signed(spark, d).groupBy("rule").agg(F.collect_list("lit").alias("lits"))
    return rules.select("rule", formatted(sanitized(F.col("lits"))).alias("line"), tautology_atom(F.col("lits")).alias("tautology"))


def equivalences(spark, d):
    """Each supplier stands for the one of half its number, so in the end for the first; negative ones for the negative."""
    pairs = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey > 1").select(F.col("s_suppkey").cast("long").alias("atom"), F.expr("cast(s_suppkey div 2 as long)").alias("lit"))
    return sat_graph.equivalence_closure(pairs)


def represented_rules(spark, d):
    """Clauses with atoms above 25 replaced by those 25 below, without tautologies."""
    pairs = spark.range(26, 51).select(F.col("id").alias("atom"), (F.col("id") - 25).alias("lit"))
    return sat_graph.represented(_signed(spark, d), pairs)[1]


def reduced_rules(spark, d):
    """Clauses that literals up to 5 don't satisfy, less what those make false."""
    return sat_graph.reduce_rules(_signed(spark, d), spark.range(1, 6).select(F.col("id").alias("lit")))[0]


def unsatisfied_rules(spark, d):
    return sat_graph.reduce_rules(_signed(spark, d), spark.range(1, 6).select(F.col("id").alias("lit")))[1]


def single_literals(spark, d):
    return sat_graph.single_literals(_signed(spark, d))


def base_implication(spark, d):
    return sat_graph.base_implication(_signed(spark, d))


def solve_instances(spark, d):
    """Random clauses of three literals, 16 instances side by side: whether each can be satisfied."""
    rules = spark.range(16 * 34).select((F.col("id") % 16).alias("instance"), F.floor(F.col("id") / 16).alias("rule"))
    lit = lambda i: (F.pmod(F.col("instance") * 131 + F.col("rule") * F.lit(37 + 12 * i) + i * i * 5, F.lit(8)) + 1) * F.when(F.pmod(F.col("rule") * F.lit(11 + 2 * i) + F.col("instance") * (i + 3), F.lit(5)) < 2, -1).otherwise(1)
    return solver.solve_all(rules.select("instance", "rule", F.explode(F.array(lit(0), lit(1), lit(2))).alias("lit"))).select("instance", "satisfiable")


QUERIES = {f.__name__: f for f in (
    nation_top_dates, consolidate, concat, distinct, counts, map_filter, flat_map, flatten, fsts, snds, swaps, split, partition, join, join_values, semijoin_weighted, antijoin, cartesian_product,
    intersection, set_minus, top_ns3, top_ns_array, random_ns, maxes, mins, global_max, global_min, save_distinct_concat, snapshot_diff, snapshot, event_counts, closure, reachable, shortest_path,
    frames, implications, literal_extremes, next_literal, solve_instances, set_minus_pairs, unconsolidate, random_ns_properties, commit_pull, constant_input, loop_feedback, loop_interrupt,
    loop_first_occurrences, loop_frameless, literal_functions, causes, clause_lines, equivalences, represented_rules, reduced_rules, unsatisfied_rules, single_literals, base_implication,
)}

_TRADE = """trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, min(l_orderkey) % 7 + 1 AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity >= 50 AND l_discount >= 0.09 GROUP BY 1, 2)"""
_PAIR = """pair AS (SELECT * FROM (SELECT l_orderkey * 10 + l_linenumber AS rule, -(l_suppkey % 40 + 1) AS a, (l_suppkey * 7 + l_orderkey) % 40 + 1 AS b
  FROM lineitem WHERE l_quantity >= 48 AND l_discount >= 0.08) WHERE abs(a) <> b)"""
_LIT = "lits AS (SELECT rule, a AS lit FROM pair UNION ALL SELECT rule, b FROM pair)"
_SHIPPED = f"""log AS (SELECT l_suppkey, l_returnflag, 1 AS n, CASE WHEN l_shipdate < DATE '{CUT1}' THEN 1 WHEN l_shipdate < DATE '{CUT2}' THEN 2 ELSE 3 END AS commit_id FROM lineitem),
  changes AS (SELECT * FROM log UNION ALL SELECT l_suppkey, l_returnflag, -1, 2 FROM log WHERE l_returnflag = 'R' AND commit_id = 1)"""
_GROUP = "count(*)::BIGINT AS n"
_SIGNED = "s AS (SELECT DISTINCT l_orderkey AS rule, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (l_suppkey % 50 + 1) AS lit FROM lineitem)"

ORACLE_SQL = {
    "nation_top_dates": """WITH d AS (SELECT DISTINCT c_nationkey AS nation, o_orderdate::DATE AS order_date FROM orders JOIN customer ON o_custkey = c_custkey)
      SELECT nation, order_date, rank::INTEGER AS rank, 1::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY order_date DESC) AS rank FROM d) WHERE rank <= 3""",
    "consolidate": f"SELECT l_partkey, l_suppkey, {_GROUP} FROM lineitem GROUP BY ALL",
    "concat": f"SELECT nation, {_GROUP} FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation",
    "distinct": "SELECT DISTINCT l_partkey, l_returnflag, 1::BIGINT AS n FROM lineitem",
    "counts": "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS count, 1::BIGINT AS n FROM lineitem GROUP BY 1, 2",
    "map_filter": f"SELECT l_orderkey % 100 AS bucket, l_linenumber * 2 AS line, {_GROUP} FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "flat_map": f"SELECT x, {_GROUP} FROM (SELECT unnest([p_size, 2 * p_size]) AS x FROM part) GROUP BY x",
    "flatten": f"SELECT word, {_GROUP} FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word",
    "fsts": f"SELECT o_custkey AS k, {_GROUP} FROM orders GROUP BY 1",
    "snds": f"SELECT o_orderdate::DATE AS v, {_GROUP} FROM orders GROUP BY 1",
    "swaps": f"SELECT o_orderdate::DATE AS k, o_custkey AS v, {_GROUP} FROM orders GROUP BY 1, 2",
    "split": f"SELECT side, x, {_GROUP} FROM (SELECT 'k' AS side, l_returnflag AS x FROM lineitem UNION ALL SELECT 'v', l_linestatus FROM lineitem) GROUP BY 1, 2",
    "partition": f"SELECT CASE WHEN event_type = 'click' THEN 'left' ELSE 'right' END AS side, CASE WHEN event_type = 'click' THEN user_id::VARCHAR ELSE event_type END AS x, {_GROUP} FROM events GROUP BY 1, 2",
    "join": f"SELECT l_orderkey AS k, l_returnflag, o_orderpriority, {_GROUP} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3",
    "join_values": f"SELECT l_returnflag, o_orderpriority, {_GROUP} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "semijoin_weighted": f"SELECT p_partkey AS k, p_brand, {_GROUP} FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "antijoin": f"SELECT o_orderkey AS k, o_orderpriority, {_GROUP} FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1, 2",
    "cartesian_product": "SELECT r_name, n_name, 1::BIGINT AS n FROM region CROSS JOIN nation",
    "intersection": """SELECT k, a.n * b.n AS n FROM (SELECT l_partkey AS k, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a
      JOIN (SELECT l_partkey AS k, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b USING (k)""",
    "set_minus": f"SELECT l_partkey AS k, {_GROUP} FROM lineitem WHERE l_returnflag = 'N' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
    "top_ns3": """SELECT k, v, rank::INTEGER AS rank, 1::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS rank
      FROM (SELECT DISTINCT o_custkey AS k, o_orderdate::DATE AS v FROM orders)) WHERE rank <= 3""",
    "top_ns_array": """SELECT k, string_agg(v::VARCHAR, ',' ORDER BY v DESC) AS v, 1::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS rank
      FROM (SELECT DISTINCT l_suppkey AS k, l_partkey AS v FROM lineitem)) WHERE rank <= 3 GROUP BY k""",
    "maxes": "SELECT o_custkey AS k, max(o_orderdate::DATE) AS v, 1::BIGINT AS n FROM orders GROUP BY 1",
    "mins": "SELECT o_custkey AS k, min(o_orderdate::DATE) AS v, 1::BIGINT AS n FROM orders GROUP BY 1",
    "global_max": "SELECT o_custkey, o_orderkey, 1::BIGINT AS n FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1",
    "global_min": "SELECT o_custkey, o_orderkey, 1::BIGINT AS n FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1",
    "save_distinct_concat": "SELECT l_suppkey, (count(*) + 1)::BIGINT AS n FROM lineitem GROUP BY 1",
    "snapshot_diff": f"""WITH {_SHIPPED}, a AS (SELECT l_suppkey, sum(n)::BIGINT AS count FROM changes WHERE commit_id <= 1 GROUP BY 1 HAVING sum(n) <> 0),
      b AS (SELECT l_suppkey, sum(n)::BIGINT AS count FROM changes WHERE commit_id <= 2 GROUP BY 1 HAVING sum(n) <> 0)
      SELECT l_suppkey, count, sum(n)::BIGINT AS n FROM (SELECT *, 1 AS n FROM b UNION ALL SELECT *, -1 FROM a) GROUP BY 1, 2 HAVING sum(n) <> 0""",
    "snapshot": f"WITH {_SHIPPED} SELECT l_suppkey, l_returnflag, sum(n)::BIGINT AS n FROM changes WHERE commit_id <= 2 GROUP BY 1, 2 HAVING sum(n) <> 0",
    "event_counts": "SELECT event_type, user_id, count(*)::BIGINT AS count, 1::BIGINT AS n FROM events GROUP BY 1, 2",
    "closure": f"WITH RECURSIVE {_TRADE}, c AS (SELECT src, dst FROM trade UNION SELECT c.src, t.dst FROM c JOIN trade t ON c.dst = t.src) SELECT src, dst, 1::BIGINT AS n FROM c",
    "reachable": f"WITH RECURSIVE {_TRADE}, c AS (SELECT 0 AS node UNION SELECT t.dst FROM c JOIN trade t ON c.node = t.src) SELECT node FROM c",
    "shortest_path": f"""WITH RECURSIVE {_TRADE}, p AS (SELECT min(src) AS node, 0::BIGINT AS d FROM trade UNION SELECT t.dst, p.d + t.w FROM p JOIN trade t ON p.node = t.src WHERE p.d + t.w <= 60)
      SELECT node, min(d)::BIGINT AS d FROM p GROUP BY node""",
    "frames": "SELECT r_name AS name FROM region WHERE r_regionkey IN (0, 1, 3)",
    "implications": f"""WITH RECURSIVE {_PAIR}, base AS (SELECT -a AS x, b AS y FROM pair UNION SELECT -b, a FROM pair),
      c AS (SELECT x, y FROM base UNION SELECT c.x, base.y FROM c JOIN base ON c.y = base.x) SELECT x, y FROM c""",
    "literal_extremes": f"""WITH {_PAIR}, {_LIT} SELECT rule, arg_min(lit, abs(lit) * 2 + (lit > 0)::INTEGER) AS low, arg_max(lit, abs(lit) * 2 + (lit > 0)::INTEGER) AS high, 1::BIGINT AS n FROM lits GROUP BY rule""",
    "next_literal": f"WITH {_PAIR}, {_LIT} SELECT lit, count(*)::BIGINT AS n FROM lits GROUP BY lit ORDER BY n DESC, abs(lit) DESC, lit DESC LIMIT 1",
    "set_minus_pairs": f"SELECT l_partkey AS part, l_suppkey AS supp, {_GROUP} FROM lineitem a WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = 'R') GROUP BY 1, 2",
    "unconsolidate": "SELECT l_suppkey, (2 * count(*))::BIGINT AS n FROM lineitem GROUP BY 1",
    "random_ns_properties": """WITH p AS (SELECT o_custkey AS k, least(2, count(DISTINCT o_orderdate::DATE))::BIGINT AS picked FROM orders GROUP BY 1) SELECT k, picked, picked AS own, picked AS again FROM p""",
    "commit_pull": """WITH a AS (SELECT l_suppkey, count(*)::BIGINT AS count FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, count(*)::BIGINT AS count FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
      SELECT l_suppkey, count, sum(n)::BIGINT AS n FROM (SELECT *, 1 AS n FROM b UNION ALL SELECT *, -1 FROM a) GROUP BY 1, 2 HAVING sum(n) <> 0""",
    "constant_input": "SELECT n_regionkey::BIGINT AS r, n_name, CASE n_regionkey WHEN 0 THEN 1 ELSE 2 END::BIGINT AS n FROM nation WHERE n_regionkey IN (0, 3)",
    "loop_feedback": f"WITH RECURSIVE {_TRADE}, c AS (SELECT 0::INTEGER AS node UNION SELECT t.dst::INTEGER FROM c JOIN trade t ON c.node = t.src) SELECT node FROM c",
    "loop_interrupt": f"WITH RECURSIVE {_TRADE}, c AS (SELECT 0 AS node UNION SELECT t.dst FROM c JOIN trade t ON c.node = t.src) SELECT CASE WHEN count(*) > 3 THEN 1 END::BIGINT AS stopped, count(*) FILTER (WHERE node < 0) = 0 AS first_is_empty FROM c",
    "loop_first_occurrences": f"""WITH RECURSIVE {_TRADE}, c AS (SELECT 0::INTEGER AS node, 0::BIGINT AS d UNION SELECT t.dst::INTEGER, c.d + 1 FROM c JOIN trade t ON c.node = t.src WHERE c.d < 25)
      SELECT node, min(d)::BIGINT AS d FROM c GROUP BY node""",
    "loop_frameless": "SELECT r_name AS name, 'lasting' AS kind FROM region",
    "literal_functions": f"""WITH {_SIGNED} SELECT rule, lit, -lit AS negated, abs(lit) AS atom, lit > 0 AS positive, CASE WHEN lit > 0 THEN rule ELSE -rule END AS signed, -abs(lit) AS least,
      CASE WHEN abs(lit) > 25 THEN lit ELSE 25 END::BIGINT AS greatest FROM s""",
    "causes": f"""WITH {_SIGNED}, c AS (SELECT lit, CASE WHEN rule % 3 = 0 THEN 0 ELSE 1 END AS kind, CASE WHEN rule % 3 = 0 THEN 0 ELSE rule END AS rule, CASE WHEN rule % 3 = 0 THEN rule % 5 ELSE rule % 7 END AS level FROM s),
      r AS (SELECT *, row_number() OVER (PARTITION BY lit ORDER BY kind DESC, rule DESC, level DESC) AS place FROM c) SELECT lit, kind::INTEGER AS kind, rule::BIGINT AS rule, level::BIGINT AS level FROM r WHERE place = 1""",
    "clause_lines": f"""WITH {_SIGNED} SELECT rule, string_agg(lit::VARCHAR, ' ' ORDER BY abs(lit), lit) || ' 0' AS line,
      (SELECT min(b.lit) FROM s b WHERE b.rule = s.rule AND b.lit > 0 AND EXISTS (SELECT 1 FROM s c WHERE c.rule = b.rule AND c.lit = -b.lit)) AS tautology FROM s GROUP BY rule""",
    "equivalences": "SELECT x, sign(x)::BIGINT AS y FROM (SELECT s_suppkey::BIGINT AS x FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT -s_suppkey::BIGINT FROM supplier WHERE s_suppkey > 1)",
    "represented_rules": f"""WITH {_SIGNED}, r AS (SELECT DISTINCT rule, CASE WHEN lit > 25 THEN lit - 25 WHEN lit < -25 THEN lit + 25 ELSE lit END AS lit FROM s)
      SELECT rule, lit FROM r WHERE rule NOT IN (SELECT a.rule FROM r a JOIN r b ON a.rule = b.rule AND a.lit = -b.lit)""",
    "reduced_rules": f"WITH {_SIGNED} SELECT rule, lit FROM s WHERE rule NOT IN (SELECT rule FROM s WHERE lit BETWEEN 1 AND 5) AND lit NOT BETWEEN -5 AND -1",
    "unsatisfied_rules": f"WITH {_SIGNED} SELECT DISTINCT rule FROM s WHERE rule NOT IN (SELECT rule FROM s WHERE lit BETWEEN 1 AND 5)",
    "single_literals": f"WITH {_SIGNED} SELECT rule, min(lit) AS lit FROM s GROUP BY rule HAVING count(*) = 1",
    "base_implication": f"WITH {_SIGNED}, t AS (SELECT rule, min(lit) AS a, max(lit) AS b FROM s GROUP BY rule HAVING count(*) = 2) SELECT DISTINCT x, y FROM (SELECT -a AS x, b AS y FROM t UNION ALL SELECT -b, a FROM t)",
}
