"""The catalogue of queries over the rule engine's operators, with their DuckDB counterparts.

Every query runs over its whole tables. Expressions are in the part of the regex language on which
Java and RE2 agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveflow.engine import analyze
from sieveflow.functions import scalar as S
from sieveflow.functions.durable import spread
from sieveflow.operators import cache, graph, jsonpath, post, text, tree
from sieveflow.rules.model import JsonPathEq, JsonPathRegex, Rule, RuleSet, Scan, TextRegex, TextRegexMulti
from sieveflow.sinks import report
from sieveflow.sources import corpus, readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_table(spread(_t(spark, sf_dir, "documents"), "doc_id"), "doc_id", "text", F.col("lang"), "all rights reserved")


#: The rules that the queries over documents use.
RULES = RuleSet([
    Rule("doc.license", TextRegex(r"(?i)licensed "), "LOW", "a line of a licence"),
    Rule("doc.email", TextRegex(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"), "MEDIUM", "an address", languages=("en", "fr")),
    Rule("doc.ipv4", TextRegex(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"), "INFO", "a network address"),
    Rule("doc.token", TextRegex(r"token = .[0-9a-f]{40}"), "CRITICAL", "a token"),
    Rule("doc.shout", TextRegex(r"!! [A-Z]+!!"), "ERROR", "shouting", languages=("en",)),
])

LINES = r"""
lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS file, lang, CAST(i AS INTEGER) AS line, parts[i] AS text
  FROM (SELECT doc_id, lang, parts, unnest(generate_series(1, len(parts))) AS i
        FROM (SELECT doc_id, lang, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS parts FROM documents WHERE length(text) > 0)))
"""
HITS = (
    LINES
    + r""", hits AS (
  SELECT 'doc.license' AS rule_id, 'LOW' AS severity, 0 AS ord, * FROM lines WHERE regexp_matches(text, '(?i)licensed ')
  UNION ALL SELECT 'doc.email', 'MEDIUM', 1, * FROM lines WHERE lang IN ('en', 'fr') AND regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}')
  UNION ALL SELECT 'doc.ipv4', 'INFO', 2, * FROM lines WHERE regexp_matches(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')
  UNION ALL SELECT 'doc.token', 'CRITICAL', 3, * FROM lines WHERE regexp_matches(text, 'token = .[0-9a-f]{40}')
  UNION ALL SELECT 'doc.shout', 'ERROR', 4, * FROM lines WHERE lang = 'en' AND regexp_matches(text, '!! [A-Z]+!!')),
findings AS (
  SELECT sha256(rule_id || ':' || file || ':' || line || ':1') AS id, rule_id, severity, file, line, 1 AS "column", text AS excerpt, ord FROM hits)
"""
)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.findings_of(text.line_hits(_docs(spark, sf_dir), RULES.of(TextRegex)), RULES)


# Text


@query(f"WITH {HITS} SELECT id, rule_id, severity, file, line, \"column\", excerpt FROM findings WHERE rule_id = 'doc.license'")
def text_regex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = RuleSet(RULES.rules[:1])
    found = post.findings_of(text.line_hits(_docs(spark, sf_dir), one.of(TextRegex)), one)
    return found.select("id", "rule_id", "severity", "file", "line", "column", "excerpt")


@query(f'WITH {HITS} SELECT id, rule_id, severity, file, line, "column", excerpt FROM findings')
def text_regex_multirule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.dedup(_findings(spark, sf_dir)).select("id", "rule_id", "severity", "file", "line", "column", "excerpt")



_MANY = [f"th{a}{b}" for a in "aeinot" for b in "adehinorst"]


@query(
    r"""WITH r AS (SELECT unnest([""" + ", ".join(f"'{x}'" for x in _MANY) + r"""]) AS w), l AS (
      SELECT doc_id, unnest(generate_series(1, len(parts))) AS line, unnest(parts) AS text
      FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS parts FROM documents WHERE length(text) > 0))
    SELECT w AS rule_id, CAST(doc_id AS VARCHAR) AS file, CAST(line AS INTEGER) AS line FROM l JOIN r ON regexp_matches(text, '\b' || w || '[a-z]*(ed|ing)[ .,]')"""
)
def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty rules in one pass of an automaton over their literals."""
    rules = RuleSet([Rule(w, TextRegex(rf"\b{w}[a-z]*(ed|ing)[ .,]")) for w in _MANY])
    found = post.findings_of(text.line_hits(_docs(spark, sf_dir), rules.of(TextRegex)), rules)
    return found.select("rule_id", "file", "line")


@query(
    r"""WITH p AS (SELECT doc_id, string_split_regex(text, '[0-9]{2,}') AS g, regexp_extract_all(text, '[0-9]{2,}') AS m FROM documents WHERE regexp_matches(text, '[0-9]{2,}')),
    e AS (SELECT doc_id, g, m, unnest(generate_series(1, len(m))) AS i FROM p)
    SELECT doc_id AS id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS "start",
           CAST(length(m[i]) AS BIGINT) AS size FROM e"""
)
def match_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.spans_frame(_t(spark, sf_dir, "documents"), "doc_id", "text", "[0-9]{2,}")
    return s.select("id", F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("size"))



@query(
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{2,}') AS m, string_split_regex(text, '[0-9]{2,}') AS g FROM documents WHERE regexp_matches(text, '[0-9]{2,}')),
    e AS (SELECT doc_id, m, g, unnest(generate_series(1, len(m))) AS i FROM d),
    s AS (SELECT doc_id, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM e),
    td AS (SELECT doc_id, regexp_extract_all(text, 'token = .[0-9a-f]{40}') AS m, string_split_regex(text, 'token = .[0-9a-f]{40}') AS g FROM documents WHERE regexp_matches(text, 'token = .[0-9a-f]{40}')),
    te AS (SELECT doc_id, m, g, unnest(generate_series(1, len(m))) AS i FROM td),
    r AS (SELECT doc_id, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM te)
    SELECT doc_id AS id, CAST(a AS BIGINT) AS "start", CAST(a + n AS BIGINT) AS "end" FROM s WHERE EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND s.a >= r.a AND s.a + s.n <= r.a + r.n)"""
)
def contained_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    numbers = text.spans_frame(docs, "doc_id", "text", "[0-9]{2,}")
    ranges = text.spans_frame(docs, "doc_id", "text", "token = .[0-9a-f]{40}")
    got = text.contained(numbers, ranges)
    return got.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+\.')) AS BIGINT) AS n FROM documents")
def match_count_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[A-Z][a-z]+\.")).cast("long").alias("n"))


@query(
    rf"""WITH {LINES}, m AS (SELECT file, line, text, regexp_extract(text, '[0-9]{{4,}}') AS found FROM lines)
    SELECT file, line, CAST(strlen(substr(text, 1, strpos(text, found) - 1)) + 1 AS INTEGER) AS "column" FROM m WHERE found <> ''"""
)
def first_match_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.lines(_docs(spark, sf_dir)).withColumn("column", S.first_match_column("text", "[0-9]{4,}").cast("int"))
    return rows.where("column is not null").select(F.col("file_path").alias("file"), "line", "column")


@query(
    rf"""WITH {LINES} SELECT file, line, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM lines"""
)
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.line_offsets(corpus.lines(_docs(spark, sf_dir))).select(F.col("file_path").alias("file"), "line", F.col("byte_start").cast("long").alias("byte_start"))



# Post-processing


@query(
    rf"""WITH {HITS} SELECT id, rule_id, file, line FROM findings f
    WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.file = f.file AND l.line = f.line AND contains(l.text, 'Licensed'))"""
)
def suppression_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.from_table(_t(spark, sf_dir, "documents"), "doc_id", "text", F.col("lang"), "Licensed")
    return post.without_suppressed(_findings(spark, sf_dir), files).select("id", "rule_id", "file", "line")


@query(
    f"""WITH {HITS}, base AS (SELECT id, file, line FROM findings WHERE rule_id = 'doc.license')
    SELECT id, rule_id, file, line FROM findings f ANTI JOIN base b ON f.id = b.id AND f.file = b.file AND f.line = b.line"""
)
def baseline_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    return post.without_baseline(found, found.where("rule_id = 'doc.license'")).select("id", "rule_id", "file", "line")


@query(
    f"""WITH {HITS}, two AS (SELECT * FROM findings UNION ALL SELECT id, rule_id, severity, file, line, "column", excerpt, ord + 10 FROM findings)
    SELECT id, rule_id, CAST(ord AS INTEGER) AS ord FROM two QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord, file, line) = 1"""
)
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    return post.dedup(found.unionByName(found.withColumn("ord", F.col("ord") + 10))).select("id", "rule_id", "ord")


@query(
    f"""WITH {HITS}, r AS (SELECT max(CASE severity WHEN 'INFO' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 ELSE 5 END) AS m FROM findings)
    SELECT CAST(coalesce(m, 2) AS INTEGER) AS severity_rank, coalesce(m, 2) >= 4 AS fails_on_high FROM r"""
)
def severity_max_failon(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = post.top_severity(_findings(spark, sf_dir))
    return top.select("severity_rank", (F.col("severity_rank") >= 4).alias("fails_on_high"))


@query(f"WITH {HITS} SELECT rule_id, severity, count(*) AS findings, count(DISTINCT file) AS files FROM findings GROUP BY 1, 2")
def findings_by_rule_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.by_rule_and_severity(_findings(spark, sf_dir))


@query(f"WITH {HITS} SELECT severity, rule_id, count(*) AS findings FROM findings GROUP BY ROLLUP (severity, rule_id)")
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.rollup(_findings(spark, sf_dir))


@query(f"WITH {HITS} SELECT CASE WHEN severity IN ('INFO', 'LOW') THEN 'note' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'error' END AS level, count(*) AS n FROM findings GROUP BY 1")
def sarif_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rows(_findings(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))



# Nodes


@query(
    """SELECT CAST(event_id AS VARCHAR) AS file, 'k' AS path, json_extract(props, '$.k')::VARCHAR AS value_json FROM events
    WHERE json_extract(props, '$.k')::VARCHAR = '69'"""
)
def jsonpath_eq_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = readers.props_nodes(_t(spark, sf_dir, "events"), "event_id", "props", ["k"]).withColumn("file_type", F.lit("json"))
    hits = jsonpath.path_hits(nodes, [(0, Rule("props.k", JsonPathEq("k", "69")))])
    return hits.select("file", F.lit("k").alias("path"), F.col("excerpt").alias("value_json"))


@query(
    """SELECT event_id || '' AS file, '"' || event_type || '"' AS value_json FROM events WHERE regexp_matches(event_type, '^(c|p)')"""
)
def jsonpath_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.struct("event_type").alias("event"))).alias("doc"))
    value = F.to_json(F.array(F.get_json_object("doc", "$.event.event_type")))
    nodes = e.select(
        F.col("event_id").cast("string").alias("file_path"), F.lit("json").alias("file_type"), F.lit("json").alias("kind"), F.lit("event.event_type").alias("path"),
        value.substr(F.lit(2), F.length(value) - 2).alias("value_json"), F.lit(1).alias("line"), F.lit(1).alias("column"),
    )
    return jsonpath.path_hits(nodes, [(0, Rule("event.type", JsonPathRegex("event.*", "^(c|p)")))]).select("file", F.col("excerpt").alias("value_json"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^http.*/[^/]*1[^/]*$')")
def path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").where(S.glob_column("url", "http**/*1*")).select("page_id", "url")


@query("SELECT page_id, regexp_matches(replace(url, ':', ''), '^https?//.*$') AND NOT contains(url, '?') AND NOT contains(url, ':/x') AS matched FROM pages")
def node_path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_replace(F.replace(F.col("url"), F.lit(":"), F.lit("")), r"[^A-Za-z0-9/_.?-]", "-")
    ok = S.path_matches(p, "http*//*") & ~F.col("url").contains("?") & ~F.col("url").contains(":/x")
    return _t(spark, sf_dir, "pages").select("page_id", ok.alias("matched"))


_NAMES = {"0": ".py", "1": ".YML", "2": ".tf", "3": ".tsx", "4": "/Dockerfile", "5": ".txt", "6": "", "7": ".json"}


@query(
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'yaml' WHEN 2 THEN 'hcl' WHEN 3 THEN 'typescript'
    WHEN 4 THEN 'dockerfile' WHEN 7 THEN 'json' ELSE 'generic' END AS file_type FROM part"""
)
def type_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])[(F.col("p_partkey") % 8).cast("string")]
    return _t(spark, sf_dir, "part").select("p_partkey", corpus.detect_type(F.concat(F.lit("src/a"), F.col("p_partkey").cast("string"), ext)).alias("file_type"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(url, '^.*/[^/]*7$') THEN false WHEN regexp_matches(url, '^.*[0-9]$') THEN true ELSE false END AS excluded FROM pages"""
)
def exclude_last_match_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = [f"**{d}" for d in range(10)]
    return _t(spark, sf_dir, "pages").select("page_id", corpus.is_excluded("url", corpus.excludes([*digits, "!**/*7"], default=False)).alias("excluded"))



@query("SELECT page_id, '/virtual/' || string_split(url, '/')[-1] || '-' || substr(sha256(url), 1, 12) AS path FROM pages")
def virtual_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", S.virtual_path("url").alias("path"))


# Graphs and trees


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, -l_suppkey AS dst FROM lineitem),
    b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT min(src) AS node FROM e UNION SELECT b.dst FROM r JOIN b ON r.node = b.src)
    SELECT CAST(node AS BIGINT) AS node FROM r WHERE node IS NOT NULL"""
)
def callgraph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the part of the least key is joined to by parts and suppliers of the same line items."""
    e = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"))
    start = e.agg(F.min("src").alias("node")).where("node is not null")
    return graph.reach(graph.undirected(e), start).select("node")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, -l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R'
      UNION SELECT DISTINCT -l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'),
    clean AS (SELECT -s_suppkey AS node FROM supplier WHERE s_acctbal < 0),
    r AS (SELECT p_partkey AS node FROM part WHERE p_size = 1 UNION SELECT e.dst FROM r JOIN e ON r.node = e.src WHERE e.dst NOT IN (SELECT node FROM clean))
    SELECT CAST(node AS BIGINT) AS node FROM r"""
)
def taint_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From parts of size 1 over returned items to suppliers and over accepted ones to parts, past no supplier in debt."""
    li = _t(spark, sf_dir, "lineitem")
    part, supplier = F.col("l_partkey").cast("long"), (-F.col("l_suppkey")).cast("long")
    e = li.where("l_returnflag = 'R'").select(part.alias("src"), supplier.alias("dst")).unionByName(li.where("l_returnflag = 'A'").select(supplier.alias("src"), part.alias("dst")))
    start = _t(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").cast("long").alias("node"))
    clean = _t(spark, sf_dir, "supplier").where("s_acctbal < 0").select((-F.col("s_suppkey")).cast("long").alias("node"))
    return graph.reach(e, start, clean).select("node")


@query(
    """WITH t AS (SELECT n_nationkey AS k, n_regionkey AS up, 'nation' AS kind FROM nation),
    c AS (SELECT c_custkey, c_nationkey FROM customer)
    SELECT CAST(c_custkey AS BIGINT) AS customer FROM c JOIN t ON c_nationkey = k JOIN region ON r_regionkey = up WHERE r_name = 'ASIA'"""
)
def ancestor_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below a region in the tree region, nation, customer, by intervals."""
    r, n, c = (_t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    wide = 1 << 32
    of_nation = lambda k: k.cast("long") * wide
    place = F.col("n_regionkey").cast("long") * 100 + F.col("n_nationkey") + 1
    nations = n.select("n_nationkey", "n_regionkey", place.alias("place"))
    j = c.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # one row for each nation
    leaf = j.select(F.lit("t").alias("file_path"), (of_nation(F.col("place")) + F.col("c_custkey") + 1).alias("lo"), F.col("c_custkey").cast("long").alias("customer")).withColumn("hi", F.col("lo"))
    top = r.where("r_name = 'ASIA'").select(
        F.lit("t").alias("file_path"), of_nation(F.col("r_regionkey").cast("long") * 100).alias("lo"), (of_nation(F.col("r_regionkey").cast("long") * 100 + 100) - 1).alias("hi")
    )
    return tree.within_few(leaf, top).select("customer")  # five regions



@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS caller, CAST(-l_suppkey AS BIGINT) AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    r AS (SELECT CAST(-s_suppkey AS BIGINT) AS node FROM supplier WHERE s_nationkey = 3 UNION SELECT e.caller FROM r JOIN e ON e.callee = r.node) SELECT node FROM r"""
)
def call_return_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that "call" a supplier of a nation are marked with it."""
    j = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = j.select(F.col("o_custkey").cast("long").alias("src"), (-F.col("l_suppkey")).cast("long").alias("dst"))
    seeds = _t(spark, sf_dir, "supplier").where("s_nationkey = 3").select((-F.col("s_suppkey")).cast("long").alias("node"))
    return graph.propagate(e, seeds)


@query(
    """WITH b AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_branches FROM lineitem GROUP BY 1)
    SELECT l.l_orderkey, l_linestatus AS name, bool_and(l_quantity > 10) AND count(DISTINCT l_returnflag) = any_value(n_branches) AS sanitized,
           count(DISTINCT l_linenumber) >= 2 AS merged FROM lineitem l JOIN b ON l.l_orderkey = b.l_orderkey GROUP BY 1, 2"""
)
def branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    states = li.select("l_orderkey", F.col("l_linestatus").alias("name"), F.col("l_returnflag").alias("branch"), (F.col("l_quantity") > 10).alias("sanitized"), F.col("l_linenumber").alias("def"))
    branches = li.groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n_branches"))
    return graph.branch_merge(states, branches, ["l_orderkey"]).select("l_orderkey", "name", "sanitized", "merged")


@query(
    """WITH RECURSIVE a AS (SELECT p_partkey AS name, p_partkey // 2 AS alias_of FROM part WHERE p_partkey > 1),
    r AS (SELECT name, alias_of AS root FROM a UNION ALL SELECT r.name, a.alias_of FROM r JOIN a ON r.root = a.name)
    SELECT name, root FROM r WHERE root NOT IN (SELECT name FROM a)"""
)
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("name"), F.floor(F.col("p_partkey") / 2).cast("long").alias("alias_of"))
    return graph.resolve_aliases(a)


@query(
    """SELECT CAST(l_suppkey AS BIGINT) AS name, list_sort(list(DISTINCT l_linenumber)) AS tainted_args, bool_or(l_returnflag = 'R') AS tainted_return FROM lineitem GROUP BY 1"""
)
def function_taint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("name"), F.col("l_linenumber").alias("arg"), (F.col("l_returnflag") == "R").alias("ret"))
    return graph.function_taints(rows)


# Caches and metrics


@query(
    """WITH k AS (SELECT CAST(doc_id AS VARCHAR) AS f, sha256(text) AS h FROM documents WHERE lang = 'en'), n AS (SELECT CAST(doc_id AS VARCHAR) AS f, sha256(text) AS h FROM documents)
    SELECT f AS file, (f, h) IN (SELECT (f, h) FROM k) AS known FROM n"""
)
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cache.with_hash(_docs(spark, sf_dir)).select("file_path", "file_hash", "file_type")
    known, new = cache.split(files, files.where("file_type = 'en'").select(F.col("file_path").alias("file"), "file_hash"))
    mark = lambda df, x: df.select(F.col("file_path").alias("file"), F.lit(x).alias("known"))
    return mark(known, True).unionByName(mark(new, False))



@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveflow.streaming.stream import event_counts

    return event_counts(_t(spark, sf_dir, "events")).select("window_start", "event_type", "n")


@query(f'WITH {HITS} SELECT id, rule_id, severity, file, line, "column" FROM findings WHERE NOT contains(excerpt, \'all rights reserved\')')
def analyze_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan: prune, match, suppress, deduplicate."""
    return analyze(_docs(spark, sf_dir), RULES).select("id", "rule_id", "severity", "file", "line", "column")


# The queries over files that are made from tables register themselves.
from . import made  # noqa: E402, F401
