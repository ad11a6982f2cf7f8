"""URL filters from a tree of path templates.

A page's path is cut into segments; numbers, hexadecimal keys and very long segments become typed wildcards. Per host, the segments form a tree.
Level by level, a branch is compared with its siblings together: if neither its labelled share of bad pages (a two-proportion test) nor what
follows it (ends, wildcards) differs, it is merged with them into ``*``. A template is a way through the merged tree; it is rejected when its
share of good labels, smoothed towards the share of all, is below ``least``. Given rules go first.

Everything is Spark SQL. Comparing a branch with its pooled siblings takes one sum per parent, so no pairs of branches are made, and all
statistics are sums that combine before the shuffle. Levels go on as long as two paths share a template and one of them goes on. The statements are written so that DuckDB reads them as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.llm.common import stage

Z, SHAPE = 1.96, 0.25
WEIGHT, LEAST = 10.0, 0.5

#: Functions that the two engines spell differently.
SPARK = {
    "rest": "substring(url, instr(url, '://') + 3)", "has": "instr(url, '://') > 0", "m": "regexp_like({0}, '{1}')", "x": "regexp_extract({0}, '{1}', {2})",
    "each": "transform(slice(split(path, '/', -1), 2, size(split(path, '/', -1))), s -> {0})", "at": "get(segments, {0} - 1)", "size": "size(segments)", "bs": "\\\\",
    "join": "array_join(segments, '/')", "rest_of": "array_join(slice(segments, {0}, size(segments)), '/')", "str": "STRING",
}
DUCK = {
    "rest": "substr(url, instr(url, '://') + 3)", "has": "instr(url, '://') > 0", "m": "regexp_matches({0}, '{1}')", "x": "regexp_extract({0}, '{1}', {2})",
    "each": "list_transform(string_split(path, '/')[2:], lambda s: {0})", "at": "segments[{0}]", "size": "len(segments)", "bs": "\\",
    "join": "array_to_string(segments, '/')", "rest_of": "array_to_string(segments[{0}:], '/')", "str": "VARCHAR",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_sql(e: dict, source: str, key: str) -> str:
    """(key, host, path) of each url; both empty without ``://``."""
    host, path = e["x"].format(e["rest"], "^([^/?#]*)", 1), e["x"].format(e["rest"], "^[^/?#]*([^?#]*)", 1)
    return f"""SELECT {key}, CASE WHEN {e["has"]} THEN translate({host}, '{UPPER}', '{LOWER}') ELSE '' END AS host,
        CASE WHEN {e["has"]} THEN {path} ELSE '' END AS path FROM {source}"""


def typed_sql(e: dict, source: str, columns: str) -> str:
    """Adds ``segments``, the typed segments of the whole path, and ``typed``, all of them as one text. A literal segment that could be taken for a
    wildcard, or begins with ``~``, gets ``~`` before it."""
    b = e["bs"]
    kind = f"""CASE WHEN {e["m"].format("s", f"^[0-9]+{b}z")} THEN '<n>'
            WHEN {e["m"].format("s", f"^[0-9]+{b}.[A-Za-z]+{b}z")} THEN concat('<n>', {e["x"].format("s", f"({b}.[A-Za-z]+){b}z", 1)})
            WHEN length(s) >= 16 AND {e["m"].format("s", f"^[0-9a-fA-F-]+{b}z")} THEN '<h>' WHEN length(s) > 60 THEN '<long>'
            WHEN substr(s, 1, 1) IN ('<', '*', '~') THEN concat('~', s) ELSE s END"""
    return f"""SELECT q.*, concat({e["join"]}, '#', CAST({e["size"]} AS {e["str"]})) AS typed FROM (SELECT {columns}, {e["each"].format(kind)} AS segments FROM {source}) q"""


def branches_sql(source: str) -> str:
    """One row per (host, typed path): number of pages, good and bad labels, and the template so far."""
    return f"""SELECT host, typed, segments, CAST('' AS VARCHAR(65535)) AS template, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN good THEN 1 ELSE 0 END) AS BIGINT) AS good,
        CAST(sum(CASE WHEN NOT good THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM {source} GROUP BY host, typed, segments"""


def level_sql(e: dict, source: str, k: int) -> str:
    """``source`` with segment k put to the template, merged with its siblings where it is like them."""
    own, after = (e["at"].format(i) for i in (k, k + 1))
    node = f"""SELECT host, template, {own} AS s, sum(n) AS n, sum(good) AS g, sum(bad) AS b, sum(CASE WHEN {e["size"]} = {k} THEN n ELSE 0 END) AS e,
        sum(CASE WHEN {e["size"]} > {k} AND substr({after}, 1, 1) = '<' THEN n ELSE 0 END) AS v FROM {source} WHERE {e["size"]} >= {k} GROUP BY host, template, {own}"""
    parent = "SELECT host, template, count(*) AS kids, sum(n) AS pn, sum(g) AS pg, sum(b) AS pb, sum(e) AS pe, sum(v) AS pv FROM node GROUP BY host, template"
    p1, p2 = "(b + 1e0) / (g + b + 2e0)", "(pb - b + 1e0) / (pg - g + pb - b + 2e0)"
    p = "(pb + 2e0) / (pg + pb + 4e0)"
    z = f"abs({p1} - {p2}) <= {Z}e0 * sqrt({p} * (1e0 - {p}) * (1e0 / (g + b + 2e0) + 1e0 / (pg - g + pb - b + 2e0)))"
    shape = " AND ".join(f"abs({c} * 1e0 / n - (p{c} - {c}) * 1e0 / (pn - n)) <= {SHAPE}e0" for c in "ev")
    like = f"CASE WHEN kids > 1 AND substr(s, 1, 1) <> '<' AND s <> '' THEN {z} AND {shape} ELSE false END"
    judged = f"SELECT node.host, node.template, node.s, {like} AS merged FROM node JOIN parent ON node.host = parent.host AND node.template = parent.template"
    return f"""WITH node AS ({node}), parent AS ({parent}), judged AS ({judged})
        SELECT t.host, t.typed, t.segments, CASE WHEN {e["size"]} < {k} THEN t.template ELSE concat(t.template, '/', CASE WHEN j.merged THEN '*' ELSE {own} END) END AS template,
        t.n, t.good, t.bad FROM {source} t LEFT JOIN judged j ON t.host = j.host AND t.template = j.template AND {own} = j.s"""


def rest_sql(e: dict, source: str, k: int) -> str:
    """``source`` with the segments after k put to the template as they are: for paths without siblings from there on."""
    rest = f"CASE WHEN {e['size']} > {k} THEN concat(template, '/', {e['rest_of'].format(k + 1)}) ELSE template END"
    return f"SELECT host, typed, {rest} AS template, n, good, bad FROM {source}"


def templates_sql(source: str) -> str:
    """(host, template, good, bad, purity, verdict): the smoothed share of good labels decides."""
    prior = f"(SELECT (sum(good) + 1e0) / (sum(good) + sum(bad) + 2e0) AS prior FROM {source})"
    purity = f"(sum(good) + {WEIGHT}e0 * max(prior)) / (sum(good) + sum(bad) + {WEIGHT}e0)"
    return f"""SELECT host, template, purity, CASE WHEN purity < {LEAST}e0 THEN 'block' ELSE 'allow' END AS method
        FROM (SELECT host, template, {purity} AS purity FROM {source} CROSS JOIN {prior} GROUP BY host, template) q"""


def rule_sql(rules: list[tuple[str, str, str]], what: str) -> str:
    """The longest rule that fits, as one CASE over the rules from the longest to the shortest; ``what``: 'rule' or 'verdict'."""
    fits = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR substr(host, greatest(length(host) - {len(h)}, 1)) = '.{h}') AND substr(path, 1, {len(p)}) = '{p}' THEN '{h + p if what == 'rule' else v}'"
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r))
    )
    return fits + " END"


def judge_pages(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of ``pages`` (page_id, url).

    ``labelled``: url, good (boolean), one row per labelled page; it may repeat urls. ``rules``: (verdict, host, path), lower-case hosts.
    A null url, or one without ``://``, has empty host and path and the template ''. Repeated rows each get their verdict. Without labels every
    template keeps the prior, one half, and is allowed. Other columns are ignored. Empty pages give an empty result.
    """
    spark, none = pages.sparkSession, F.lit(None).cast("boolean")
    if any("'" in x for r in rules for x in r):
        raise ValueError("a rule holds a quote")
    both = pages.select("page_id", F.col("url").cast("string").alias("url"), none.alias("good"), F.lit(True).alias("page")).unionByName(
        labelled.select(F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.col("url").cast("string").alias("url"), "good", F.lit(False).alias("page"))
    )
    parts = spark.sql(split_sql(SPARK, "{src}", "page_id, good, page"), src=both)
    typed = spark.sql(typed_sql(SPARK, "{src}", "page_id, good, page, host, path"), src=parts)
    state, done, k = stage(spark.sql(branches_sql("{src}"), src=typed), "branches"), None, 0
    while True:
        # A path that has ended, or shares its template with no other, meets no sibling further down.
        shared = spark.sql(f"SELECT host, template FROM {{src}} WHERE {SPARK['size']} > {k} GROUP BY host, template HAVING count(*) > 1", src=state)
        on = f"size(segments) > {k}"
        going = state.where(on).join(shared, ["host", "template"], "left_semi")
        ended = spark.sql(rest_sql(SPARK, "{src}", k), src=state.where(f"NOT ({on})").unionByName(state.where(on).join(shared, ["host", "template"], "left_anti").select(state.columns)))
        done = ended if done is None else done.unionByName(ended)
        if going.isEmpty():
            break
        k += 1
        state = stage(spark.sql(level_sql(SPARK, "{src}", k), src=going.select(state.columns)), "branches")
    state = stage(done, "branches")
    judged = spark.sql(templates_sql("{src}"), src=state)
    known = spark.sql("SELECT t.host, t.typed, t.template, j.purity, j.method FROM {t} t JOIN {j} j ON t.host = j.host AND t.template = j.template", t=state, j=judged)
    return typed.where("page").drop("good").join(known, ["host", "typed"]).select(
        "page_id", "host", "path", F.expr(rule_sql(rules, "rule")).alias("rule"),
        F.coalesce(F.expr(rule_sql(rules, "verdict")), F.col("method")).alias("verdict"), "template", "purity",
    )


def oracle(rules: list[tuple[str, str, str]], labelled: str, levels: int = 12) -> str:
    """The same for DuckDB, whose text holds ``levels`` levels written out: for tables in which no two paths of a host share more segments.
    ``labelled`` selects (url, good)."""
    steps = [f"t{k} AS MATERIALIZED ({level_sql(DUCK, f't{k - 1}', k)})" for k in range(1, levels + 1)]
    return f"""WITH both_ AS (SELECT page_id, url, CAST(NULL AS BOOLEAN) AS good, true AS page FROM pages UNION ALL SELECT NULL, url, good, false FROM ({labelled}) l),
        parts AS ({split_sql(DUCK, "both_", "page_id, good, page")}), typed_ AS ({typed_sql(DUCK, "parts", "page_id, good, page, host, path")}),
        t0 AS MATERIALIZED ({branches_sql("typed_")}), {", ".join(steps)}, last AS ({rest_sql(DUCK, f"t{levels}", levels)}), verdicts AS ({templates_sql("last")}),
        known AS (SELECT t.host, t.typed, t.template, v.purity, v.method FROM last t JOIN verdicts v ON t.host = v.host AND t.template = v.template)
        SELECT page_id, host, path, {rule_sql(rules, "rule")} AS rule, coalesce({rule_sql(rules, "verdict")}, method) AS verdict, template, purity
        FROM (SELECT p.page_id, p.host, p.path, k.template, k.purity, k.method FROM typed_ p JOIN known k ON p.host = k.host AND p.typed = k.typed WHERE p.page) q"""
