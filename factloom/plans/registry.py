"""Queries of the engine, and the SQL of those that SQL can express.

Bindings: `documents` are files in a language (lang) that solve a task (source); orders and line items
are functions and instructions of a dump; suppliers, customers and orders make call graphs; page
addresses are paths of a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dimensions
from ..functions import text as T
from ..operators import classify, idioms, semantics, stats
from ..sources import air

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SHARED, BASELINE = 5, "en"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- measurement and statistics -------------------------------------------------------------------

HASH, HTML = dimensions.SYNTAXES["hash"], dimensions.SYNTAXES["html"]
_SIZE = "coalesce(list_sum(list_transform({x}, lambda v: strlen(v))), 0)::bigint"
_DOCS = f"select doc_id, lang as language, source as task, {T.measure_sql('text', HASH)} as code from documents"
_MEASURED = f"m as (select doc_id, language, task, len(code)::bigint as lines, {_SIZE.format(x='code')} as bytes from ({_DOCS}))"
_SAMPLES = f"{_MEASURED}, s as (select language, task, floor(median(lines))::bigint as lines, floor(median(bytes))::bigint as bytes from m group by all)"
_PAIRS = f"""{_SAMPLES}, p as (select a.language as "left", b.language as "right", exp(avg(ln(a.lines / b.lines))) as lines, exp(avg(ln(a.bytes / b.bytes))) as bytes, count(*) as tasks
 from s a join s b on a.task = b.task and a.language < b.language where a.lines > 0 and b.lines > 0 and a.bytes > 0 and b.bytes > 0 group by 1, 2 having count(*) >= {SHARED})"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    m = T.measure(F.col("text"), HASH)
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("task"), m.alias("m")).select("doc_id", "language", "task", "m.*")


def samples(spark: SparkSession, d: str) -> DataFrame:
    return stats.median_samples(measured(spark, d))


@query(f"with {_MEASURED} select doc_id, lines, bytes from m")
def measure_documents(spark, d):
    return measured(spark, d).select("doc_id", "lines", "bytes")


@query(f"select page_id, len(code)::bigint as lines, {_SIZE.format(x='code')} as bytes from (select page_id, {T.measure_sql('html', HTML)} as code from pages)")
def measure_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.measure(F.col("html"), HTML).alias("m")).select("page_id", "m.*")


@query(f"with {_SAMPLES} select * from s")
def samples_median(spark, d):
    return samples(spark, d)


@query(f"with {_MEASURED} select language, task, sum(lines)::bigint as lines, sum(bytes)::bigint as bytes from m group by all")
def samples_sum(spark, d):
    return stats.summed_samples(measured(spark, d))


@query(f'with {_PAIRS} select "left", "right", round(lines, 6) as lines, round(bytes, 6) as bytes, tasks from p')
def pair_ratios(spark, d):
    return rounded(stats.pairs(samples(spark, d), SHARED), "lines", "bytes")


@query(
    """with s as (select n_name as language, l_partkey as task, sum(l_extendedprice) as v from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2)
select a.language as "left", b.language as "right", round(exp(avg(ln(a.v / b.v))), 6) as ratio, count(*) as tasks from s a join s b on a.task = b.task and a.language < b.language group by 1, 2 having count(*) >= 25"""
)
def pair_ratios_nations(spark, d):
    """The same operator over line items: nations by part."""
    s = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.groupBy(F.col("n_name").alias("language"), F.col("l_partkey").alias("task")).agg(F.sum("l_extendedprice").alias("lines")).withColumn("bytes", F.col("lines"))
    return rounded(stats.pairs(s, 25).select("left", "right", F.col("lines").alias("ratio"), "tasks"), "ratio")


def _index_sql() -> str:
    """The index of four languages as a second engine finds it: the normal equations, the baseline's out, by Cramer's rule."""
    names = ["de", "es", "fr"]  # besides the baseline
    sums = ", ".join(f"sum(w) filter (l = '{a}') as d_{a}, " + ", ".join(f"sum(w * ln({m})) filter (l = '{a}') as {m}_{a}" for m in ("lines", "bytes")) + "".join(f", coalesce(sum(w) filter (l = '{a}' and r = '{b}'), 0) as w_{a}_{b}" for b in names if a != b) for a in names)
    cell = lambda a, b: f"d_{a}" if a == b else f"-w_{a}_{b}"

    def det(rows: list[list[str]]) -> str:
        return "(" + " + ".join(f"({rows[0][i]}) * (({rows[1][j]}) * ({rows[2][k]}) - ({rows[1][k]}) * ({rows[2][j]}))" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))) + ")"

    whole = det([[cell(a, b) for b in names] for a in names])
    part = lambda m, x: det([[f"{m}_{a}" if b == x else cell(a, b) for b in names] for a in names])
    found = " union all ".join(f"select '{x}' as language, " + ", ".join(f"exp({part(m, x)} / {whole}) as {m}" for m in ("lines", "bytes")) + " from n" for x in names)
    both = 'select "left" as l, "right" as r, tasks::double as w, lines, bytes from p union all select "right", "left", tasks::double, 1 / lines, 1 / bytes from p'
    return f"with {_PAIRS}, both_ways as ({both}), n as (select {sums} from both_ways), x as (select '{BASELINE}' as language, 1.0 as lines, 1.0 as bytes union all {found})"


@query(f"{_index_sql()} select language, round(lines, 6) as lines, round(bytes, 6) as bytes from x")
def index_fit(spark, d):
    return rounded(stats.fit(stats.pairs(samples(spark, d), SHARED), BASELINE), "lines", "bytes")


@query(
    f"""{_index_sql()}, o as (select p."left", p."right", abs(p.bytes / (a.bytes / b.bytes) - 1) as off from p join x a on a.language = p."left" join x b on b.language = p."right")
select language, round(max(off), 6) as deviation from (select "left" as language, off from o union all select "right", off from o) group by 1"""
)
def index_deviation(spark, d):
    p = stats.pairs(samples(spark, d), SHARED)
    return rounded(stats.deviation(p, stats.fit(p, BASELINE)), "deviation")


@query(f"with {_SAMPLES} select task from s group by task having count(distinct language) = (select count(distinct language) from s)")
def balanced_panel(spark, d):
    s = samples(spark, d)
    return stats.balanced_panel(s, s.select("language").distinct())


@query(
    f"""with {_SAMPLES}, panel as (select task from s group by task having count(distinct language) = (select count(distinct language) from s)),
g as (select language, avg(ln(lines)) as l, avg(ln(bytes)) as b from s where task in (select task from panel) group by 1)
select g.language, round(exp(g.l - z.l), 6) as lines, round(exp(g.b - z.b), 6) as bytes from g, g z where z.language = '{BASELINE}'"""
)
def balanced_index(spark, d):
    s = samples(spark, d)
    return rounded(stats.balanced_index(s, s.select("language").distinct(), BASELINE), "lines", "bytes")


@query(
    f"""with {_SAMPLES}, n as (select language, count(distinct task) as n from s group by 1)
select language from n where n >= ceil((select count(distinct task) from s) / 3) or language = '{BASELINE}'"""
)
def core_languages(spark, d):
    return stats.core(samples(spark, d), BASELINE)


@query(
    f"""with {_PAIRS} select ab."left" as a, ab."right" as b, bc."right" as c, round(ab.bytes * bc.bytes, 6) as composed, round(ac.bytes, 6) as direct,
round(abs(ln(ab.bytes * bc.bytes / ac.bytes)), 6) as disagreement from p ab join p bc on ab."right" = bc."left" join p ac on ac."left" = ab."left" and ac."right" = bc."right"
order by round(abs(ln(ab.bytes * bc.bytes / ac.bytes)), 9) desc, 1, 2, 3 limit 10"""
)
def triangles_topk(spark, d):
    return rounded(stats.triangles(stats.pairs(samples(spark, d), SHARED)), "composed", "direct", "disagreement")


@query(
    f"""with {_PAIRS}, e as (select "left" as language, "right" as o, bytes from p union all select "right", "left", 1 / bytes from p union all select language, language, 1.0 from (select "left" as language from p union select "right" from p))
select language, round(max(bytes) filter (o = 'de'), 6) as de, round(max(bytes) filter (o = 'en'), 6) as en, round(max(bytes) filter (o = 'es'), 6) as es, round(max(bytes) filter (o = 'fr'), 6) as fr from e group by 1"""
)
def ratio_matrix(spark, d):
    names = ["de", "en", "es", "fr"]
    return rounded(stats.matrix(stats.pairs(samples(spark, d), SHARED), languages=names), *names)


@query(
    f"""with {_PAIRS}, n as (select distinct language from s) select a.language as "left", b.language as "right", round(case when a.language < b.language then p.bytes else 1 / p.bytes end, 6) as ratio
from n a cross join n b left join p on p."left" = least(a.language, b.language) and p."right" = greatest(a.language, b.language)"""
)
def ratio_lookup(spark, d):
    s = samples(spark, d)
    n = s.select("language").distinct()
    asked = n.select(F.col("language").alias("left")).crossJoin(n.select(F.col("language").alias("right")))
    return rounded(stats.ratio_lookup(stats.pairs(s, SHARED), asked), "ratio")


# ---- paths and languages ----------------------------------------------------------------------------

_PATH = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))


def _owners(spark: SparkSession, d: str) -> DataFrame:
    p = F.split("path", "/")
    host, deep = F.get(p, F.lit(0)), F.array_join(F.slice(p, 1, 2), "/")
    rows = _paths(spark, d)
    # Hosts below example.org have no owner of their own.
    some = rows.filter(~host.endswith(".example.org")).select(host.alias("root"))
    return some.unionByName(rows.filter(F.size(p) > 2).select(deep.alias("root"))).distinct().withColumn("id", F.concat(F.lit("pkg:"), "root"))


_OWNERS = f"""f as (select page_id, {_PATH} as path from pages),
o as (select distinct root, 'pkg:' || root as id from (select split_part(path, '/', 1) as root from f where not ends_with(split_part(path, '/', 1), '.example.org') union all select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from f where len(string_split(path, '/')) > 2))"""


@query(f"with {_OWNERS} select page_id, path, arg_max(root, len(root)) as owner_root, arg_max(id, len(root)) as id from f left join o on path = root or starts_with(path, root || '/') group by page_id, path")
def nearest_owner(spark, d):
    return idioms.nearest_owner(_paths(spark, d), "path", _owners(spark, d), "root")


@query(f"with {_OWNERS} select page_id, path from f where not exists (select 1 from o where path = root or starts_with(path, root || '/'))")
def unowned_files(spark, d):
    return idioms.nearest_owner(_paths(spark, d), "path", _owners(spark, d), "root").filter("owner_root IS NULL").select("page_id", "path")


_EXT = [(e, r[0], r[1]) for r in dimensions.LANGUAGES for e in r[2]]
_ROWS = ", ".join(f"('{e}', '{i}', '{r}')" for e, i, r in _EXT)
_EXTENSIONS = ["rs", "tsx", "H", "py", "weird", "yml"]


@query(
    f"""with k(ext, language, role) as (values {_ROWS}), f as (select page_id, {_PATH} || '.' || ['rs', 'tsx', 'H', 'py', 'weird', 'yml'][(page_id % 6 + 1)::int] as path from pages)
select page_id, path, language, role, case when language is not null then 'extension' end as evidence from f left join k on lower(regexp_extract(path, '[^/]+[.]([^./]*)$', 1)) = ext"""
)
def language_detection(spark, d):
    pick = F.get(F.array(*map(F.lit, _EXTENSIONS)), (F.col("page_id") % 6).cast("int"))
    return classify.detect_language(_paths(spark, d).withColumn("path", F.concat("path", F.lit("."), pick)))


# ---- dumps ------------------------------------------------------------------------------------------


def dump(spark: SparkSession, d: str) -> DataFrame:
    """Orders as functions, line items as a position and an instruction each, 32 orders to a file."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    key = F.col("l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    li = li.withColumn("l_linenumber", F.row_number().over(order))
    body = F.array(
        F.concat(F.lit("  %"), F.col("l_linenumber") * 2, F.lit("!= dbg_stmt("), F.col("l_partkey"), F.lit(":"), F.col("l_suppkey"), F.lit(")")),
        F.concat(F.lit("    %"), F.col("l_linenumber") * 2 + 1, F.when(F.col("l_returnflag") == "R", "!= mul(Flag(").otherwise(" = mul(Flag("), "l_returnflag", F.lit(",x), %"), F.col("l_linenumber") * 2, F.lit("!, %"), "l_suppkey", F.lit(")")),
    )
    lines = li.select(key, "l_linenumber", F.posexplode(body).alias("n", "value")).select(key, (F.col("l_linenumber") * 2 + F.col("n")).alias("at"), "value")
    heads = li.groupBy("l_orderkey").agg(F.count("*").alias("c"), F.max("l_linenumber").alias("top"))
    head = F.array(F.concat(F.lit("# Begin Function AIR: order."), key, F.lit(":")), F.concat(F.lit("# Total AIR+Liveness bytes: "), F.col("c") * 8, F.lit("B")), F.concat(F.lit("# AIR Instructions:   "), F.col("c") * 2, F.lit(" (x)")))
    tail = F.array(F.lit("  } %1!)"), F.lit("  %1! %2!"), F.lit(""), F.concat(F.lit("# End Function AIR: order."), key))
    top = heads.select(key, F.posexplode(head).alias("at", "value")).select(key, (F.col("at") - 10).alias("at"), "value")
    end = heads.select(key, "top", F.posexplode(tail).alias("n", "value")).select(key, (F.col("top") * 2 + 10 + F.col("n")).alias("at"), "value")
    every = lines.unionByName(top).unionByName(end)
    file = F.floor(key / 32).cast("string")
    return every.select(file.alias("file"), (key * 10000 + F.col("at")).cast("long").alias("line_no"), "value")


@query(
    """with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as n from lineitem) select l_orderkey as key, n * 2 + k as "index", case k when 0 then 'dbg_stmt' else 'mul' end as op, case k when 0 then l_partkey || ':' || l_suppkey else 'Flag(' || l_returnflag || ',x)' end as result_type,
case k when 0 then 0 else 2 end as n_operands, case k when 0 then true else l_returnflag = 'R' end as dead, k::int as depth,
case k when 1 then l_partkey else coalesce(lag(l_partkey) over w, 0) end as line, case k when 1 then l_suppkey else coalesce(lag(l_suppkey) over w, 0) end as "column"
from l, (values (0), (1)) t(k) window w as (partition by l_orderkey, k order by n)"""
)
def air_roundtrip_instructions(spark, d):
    c = air.classify(dump(spark, d))
    i = air.instructions(c)
    return i.select(F.floor(F.col("line_no") / 10000).alias("key"), "index", "op", "result_type", F.size("operands").alias("n_operands"), "dead", F.col("depth").cast("int").alias("depth"), "line", "column")


@query("select 'order.' || l_orderkey as mangled, (2 * count(*))::bigint as declared_instructions, (2 * count(*))::bigint as read_instructions, (8 * count(*))::bigint as air_bytes from lineitem group by l_orderkey")
def air_roundtrip_functions(spark, d):
    return air.functions(air.classify(dump(spark, d))).select("mangled", "declared_instructions", "read_instructions", "air_bytes")


@query(
    """with n as (select count(*)::bigint as i, count(distinct l_orderkey)::bigint as o from lineitem) select 'instruction' as class, 2 * i as n from n union all select 'begin', o from n union all select 'end', o from n
union all select 'header', 2 * o from n union all select 'delimiter', o from n union all select 'death', o from n union all select 'blank', o from n"""
)
def line_tally(spark, d):
    return air.tally(air.classify(dump(spark, d)))


@query("select event_id, user_id, coalesce(last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), -1) as last_signup from events")
def carry_forward_position(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, d, "events").select("event_id", "user_id", F.coalesce(last, F.lit(-1)).alias("last_signup"))


@query(
    """with o as (select conv_id, turn as id, turn * 100 as s, turn * 100 + length(text) as e from conversations), i as (select conv_id, turn, turn * 100 + 50 as s, turn * 100 + 60 as e from conversations)
select i.conv_id, i.turn, coalesce(arg_min(o.id, (o.e - o.s) * 1000 + o.id), -1) as around from i left join o on i.conv_id = o.conv_id and i.s >= o.s and i.e <= o.e group by 1, 2"""
)
def innermost_containment(spark, d):
    c = table(spark, d, "conversations")
    outer = c.select("conv_id", F.col("turn").alias("id"), (F.col("turn") * 100).alias("start"), (F.col("turn") * 100 + F.length("text")).alias("end"))
    inner = c.select("conv_id", "turn", (F.col("turn") * 100 + 50).alias("start"), (F.col("turn") * 100 + 60).alias("end"))
    return idioms.innermost(inner, outer, ["conv_id"]).select("conv_id", "turn", F.coalesce("around", F.lit(-1)).alias("around"))


# ---- observations -----------------------------------------------------------------------------------


def _span(path, line):
    return [F.concat(F.lit("src/"), path).alias("path"), line.alias("start_line"), F.lit(1).alias("start_column"), line.alias("end_line"), F.lit(9).alias("end_column")]


def call_graph(spark: SparkSession, d: str) -> semantics.Observations:
    """Customers call suppliers; each region is a unit, and the first two units share some edges."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    span = _span((F.col("o_custkey") % 7).cast("string"), F.col("o_orderkey"))
    edges = o.groupBy("o_custkey", "o_orderkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("s"), "l_suppkey"))).alias("to"))
    edges = edges.select(*span, F.concat(F.lit("c"), "o_custkey").alias("from"), "to", F.when(F.size("to") > 1, "virtual").otherwise("static").alias("dispatch"))
    units = table(spark, d, "region").select(F.col("r_name").alias("unit"), F.col("r_regionkey").alias("ordinal"), F.concat(F.lit("tool-"), F.col("r_regionkey") % 2).alias("toolchain"), *[(F.col("r_regionkey") % (i + 2) != 1).alias(q) for i, q in enumerate(semantics.QUESTIONS)])
    return {"call_edges": edges, "units": units}


_EDGES = """e as (select 'src/' || (o_custkey % 7) as path, o_orderkey as start_line, 'c' || o_custkey as "from", list_sort(list(distinct 's' || l_suppkey)) as "to" from orders join lineitem on o_orderkey = l_orderkey group by o_custkey, o_orderkey)"""


@query(f"""with {_EDGES} select path, start_line, "from", array_to_string("to", ',') as "to", case when len("to") > 1 then 'virtual' else 'static' end as dispatch from e""")
def call_edges_merge(spark, d):
    g = call_graph(spark, d)
    both = semantics.merge([g, {"call_edges": g["call_edges"].filter("start_line % 2 = 0")}])
    return both["call_edges"].select("path", "start_line", "from", F.array_join("to", ",").alias("to"), "dispatch")


@query(f"""with {_EDGES} select path[5:] as path, start_line, "from" from e where path = 'src/3' or starts_with(path, 'src/3/')""".replace("path[5:] as path", "'' as path"))
def call_edges_rebase(spark, d):
    return semantics.rebase(call_graph(spark, d), "src/3")["call_edges"].select("path", "start_line", "from")


@query("select bool_and(r_regionkey % 2 <> 1) as definitions, bool_and(r_regionkey % 3 <> 1) as \"references\", bool_and(r_regionkey % 4 <> 1) as call_edges, bool_and(r_regionkey % 5 <> 1) as types, bool_and(r_regionkey % 6 <> 1) as implements from region")
def coverage_and(spark, d):
    return semantics.coverage(call_graph(spark, d)["units"])


@query("select 'unit ' || r_name || ' was observed with tool-' || (r_regionkey % 2) || ' instead of tool-0' as message from region where r_regionkey % 2 <> 0")
def toolchain_gaps(spark, d):
    return semantics.toolchain_gaps(call_graph(spark, d)["units"])


@query(f"""with {_EDGES} select path, start_line, unnest("to") as callee from e""")
def callees(spark, d):
    edges = call_graph(spark, d)["call_edges"]
    return semantics.callees(edges, edges.select(*semantics.SPAN)).select("path", "start_line", "callee")


@query("""select 'c' || o_custkey as "from", count(distinct o_orderkey)::bigint as calls from orders join lineitem on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' group by o_custkey""")
def calls_from(spark, d):
    ids = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return semantics.calls_from(call_graph(spark, d)["call_edges"], ids).groupBy("from").agg(F.count("*").alias("calls"))


# ---- classifiers over fixed rows ----------------------------------------------------------------------

PINS = [
    ("registry", "1.2.3", "exact-semver"), ("registry", "v1.2.3-rc.1", "exact-semver"), ("registry", "1.0.0-next", "exact-semver"), ("registry", "^1.2.3", "exact-semver"), ("registry", "1.2", "exact-semver"),
    ("registry", "=1.2", "cargo-exact"), ("registry", "1.2.3", "cargo-exact"), ("registry", "= ", "cargo-exact"), ("git", "0123456789abcdef0123456789abcdef01234567", "cargo-exact"), ("git", "main", "cargo-exact"),
    ("git", None, "exact-semver"), ("local-path", None, "cargo-exact"), ("workspace", "*", "exact-semver"), ("unknown", "1.2.3", "exact-semver"),
]
USES = ["actions/checkout@v4", "a/b@0123456789abcdef0123456789abcdef01234567", "./local", "docker://alpine:3", "rust/toolchain@STABLE", "x@y@main", "a/b"]
SCRIPTS = ["build", "build:web", "web:build", "test", "test:unit", "lint", "fmt", "format:all", "typecheck", "check-types", "tests", "deploy"]
NAMES = ["My Great Action!", "--Already--slug--", "Ünïcode & Co", "a", "!!!"]
COMMANDS = ["FOO=1 BAR=2 cargo test", "env A=b npx vitest run", "sudo -E -n apt-get install x", "/usr/bin/pnpm exec eslint .", "yarn dlx tsc", "=x y", "npm exec", "bunx", "A=b", "npm run test -- --watch"]
SHAPES = ["?*const Foo", "[]u8", "[*]const u8", "[:0]const u8", "Foo", "*Bar", "?[]const T", "*align(8) const X", "u32"]
OWNERS = "# heading\n* @org/team a@b.co\n/docs/ # nobody\n!bad @x\nsrc/[a] @x\n\n*.rs not-an-owner\n\\#odd @x\nlib/ @user # tail\n"


def _values(rows: list, cols: str) -> str:
    show = lambda v: "null" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"t({cols}) as (values " + ", ".join("(" + ", ".join(map(show, r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + ")"


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


@query(
    f"""with {_values(PINS, 'source, requirement, pins')}, v as (select *, trim(coalesce(requirement, '')) as r from t) select source, requirement, pins,
case when source in ('local-path', 'workspace') then 'local' when source = 'git' and regexp_full_match(coalesce(requirement, ''), '[0-9a-fA-F]{{40}}') then 'pinned'
when source = 'registry' and pins = 'cargo-exact' and starts_with(r, '=') and trim(r[2:]) <> '' then 'pinned'
when source = 'registry' and pins = 'exact-semver' and regexp_full_match(r, 'v?[0-9]+[.][0-9]+[.][0-9]+([-+].*)?') and not regexp_matches(r, '[~<>=*xX ,|^]') then 'pinned' else 'floating' end as status from v"""
)
def dependency_pins(spark, d):
    t = _rows(spark, PINS, "source string, requirement string, pins string")
    return t.select("*", classify.pin_status(F.col("source"), F.col("requirement"), F.col("pins")).alias("status"))


@query(
    f"""with {_values(USES, 'uses')}, v as (select uses, starts_with(uses, './') or starts_with(uses, 'docker://') as l, regexp_extract(uses, '@([^@]*)$', 1) as r from t)
select uses, case when l or r = '' then uses else uses[:length(uses) - length(r) - 1] end as action, case when not l and r <> '' then r end as ref,
case when l then 'local' when regexp_full_match(r, '[0-9a-fA-F]{{40}}') then 'pinned' when lower(r) in ('stable', 'oldstable') then 'channel' else 'floating' end as status from v"""
)
def action_pins(spark, d):
    t = _rows(spark, USES, "uses string")
    return t.select("uses", classify.action_pin(F.col("uses")).alias("p")).select("uses", "p.*")


@query(
    f"""with {_values(SCRIPTS, 'name')} select name, case when name = 'build' or starts_with(name, 'build:') or ends_with(name, ':build') then 'build' else
case split_part(name, ':', 1) when 'test' then 'test' when 'lint' then 'lint' when 'format' then 'format' when 'fmt' then 'format' when 'typecheck' then 'typecheck' when 'type-check' then 'typecheck' when 'check-types' then 'typecheck' end end as kind from t"""
)
def script_kinds(spark, d):
    return _rows(spark, SCRIPTS, "name string").select("name", classify.script_kind(F.col("name")).alias("kind"))


@query(f"with {_values(NAMES, 'name')} select name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug from t")
def marketplace_slugs(spark, d):
    return _rows(spark, NAMES, "name string").select("name", T.slug(F.col("name")).alias("slug"))


@query()
def invocations(spark, d):
    t = _rows(spark, COMMANDS, "line string")
    return t.select("line", classify.normalize_invocation(F.split("line", " ")).alias("i")).select("line", "i.program", F.array_join("i.arguments", " ").alias("arguments"))


@query()
def type_shapes(spark, d):
    return _rows(spark, SHAPES, "written string").select("written", classify.type_shape(F.col("written")).alias("s")).select("written", "s.*")


@query()
def codeowners_rules(spark, d):
    rules, _ = classify.codeowners(_rows(spark, [("CODEOWNERS", OWNERS)], "path string, text string"))
    return rules.select("line_no", "pattern", F.array_join("owners", " ").alias("owners"))


@query()
def codeowners_diagnostics(spark, d):
    return classify.codeowners(_rows(spark, [("CODEOWNERS", OWNERS)], "path string, text string"))[1]


@query(f"with {_values([r[:2] + (r[5],) for r in dimensions.LANGUAGES], 'language, role, syntax')} select * from t")
def language_registry(spark, d):
    dimensions.check()
    return dimensions.languages(spark).select("language", "role", "syntax")


from . import expected, inventory_queries, recorded_queries  # noqa: E402

QUERIES.update(inventory_queries.QUERIES)
QUERIES.update(recorded_queries.QUERIES)
ORACLE_SQL.update({name: expected.sql(name) for name in expected.ROWS})
ORACLE_SQL.update(
    {
        "dump_balance": "select (2 * count(*) + 7 * count(distinct l_orderkey))::bigint as lines, (2 * count(*) + 7 * count(distinct l_orderkey))::bigint as counted, true as balanced from lineitem",
        "dump_function_ids": "select 'order.' || l_orderkey as mangled, (row_number() over (order by (l_orderkey // 32)::varchar, l_orderkey) - 1)::bigint as id from (select distinct l_orderkey from lineitem)",
        "shared_tasks": f"""with {_PAIRS}, e as (select "left" as language, "right" as o, tasks from p union all select "right", "left", tasks from p union all select language, language, count(*) from s group by 1, 2)
select language, max(tasks) filter (o = 'de') as de, max(tasks) filter (o = 'en') as en, max(tasks) filter (o = 'es') as es, max(tasks) filter (o = 'fr') as fr from e group by 1""",
    }
)
