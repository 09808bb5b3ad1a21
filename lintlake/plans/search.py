"""Retrieval, comparison and profile operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lintlake.functions import branch_slug, entropy, grade, hash31, heal, js_round, major, mask, normalize_path, purl, snippet_hash, value_hash
from lintlake.operators import scan
from lintlake.operators import search as S
from lintlake.plans.base import literal, query, values

CODE_SCORE = r"""10 + CASE WHEN contains(lower(content), 'password') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(content, '(?i)\bpassword\b') THEN 15 ELSE 0 END + CASE WHEN contains(lower(content), 'password') THEN 1 ELSE 0 END * 10
    + CASE WHEN contains(lower(path), 'password') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(path, '(?i)\.(test|spec|mock|stub|fixture)\.') THEN -5 ELSE 5 END
    + CASE WHEN regexp_matches(content, '(?:function|class|const|let|var|export|interface|type)\s') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(content, '^export\s') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(content, '(?:import|require)\s') THEN 5 ELSE 0 END
    - CASE WHEN regexp_matches(content, '^\s*(//|\*)') THEN 8 ELSE 0 END + CASE WHEN instr(lower(content), 'password') BETWEEN 1 AND 20 THEN 5 ELSE 0 END - 2 * (len(path) - len(replace(path, '/', ''))) + CASE WHEN len(content) < 80 THEN 3 ELSE 0 END"""


@query("t01_search_code", "code_line", f"WITH m AS (SELECT repo, path, line_no AS line, left(trim(text), 200) AS content FROM code_line WHERE contains(lower(text), 'password')) SELECT *, CAST(greatest(0, {CODE_SCORE}) AS DOUBLE) AS score FROM m ORDER BY score DESC, repo, path, line LIMIT 50")
def _(s):
    return S.search_code(s.view("code_line"), "password", 50)


@query("t02_search_paths", "code_line")
def _(s):
    return S.search_paths(s.view("code_line").select("repo", "path").distinct(), "sef1", 20)


@query("t03_search_symbols", "code_line", r"WITH f AS (SELECT DISTINCT repo, path, line_no AS line, regexp_extract(text, '(?:^|\s)(?:const|let|var)\s+(\w+)', 1) AS name FROM code_line) SELECT repo, path, line, name FROM f WHERE name <> '' AND starts_with(lower(name), 'p') ORDER BY len(name), name, repo, path, line LIMIT 20")
def _(s):
    symbols = scan.extract_symbols(s.view("code_line")).where("kind = 'variable'")
    return S.search_symbols(symbols, "p", 20).select("repo", "path", "line", "name")


KINDS = values([(c, w) for c, words in S.CATEGORY_WORDS.items() for w in words.split()], "category, word")


@query(
    "t04_search_snippets",
    "",
    f"""WITH q AS (SELECT doc_id AS query_id, lower(text) AS text, lower(source) AS framework, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS words FROM documents),
    x AS (SELECT item_id AS id, lower(text) AS text, regexp_extract(lower(text), '^\\S+', 0) AS name, lower(regexp_extract(text, '(\\w+)\\W*$', 1)) AS tag, CASE item_id % 3 WHEN 0 THEN 'auth' WHEN 1 THEN 'state' ELSE 'file' END AS category, 'web' AS framework, item_id % 9 AS uses FROM benchmark),
    k AS ({KINDS}), a AS (SELECT DISTINCT query_id, category, 8 AS kind FROM q JOIN k ON contains(q.text, k.word)),
    w AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id, unnest(words) AS word FROM q) GROUP BY ALL),
    h AS (SELECT query_id, id, sum(CASE WHEN contains(x.text, word) THEN 3 * times ELSE 0 END) + 5 * max(CAST(contains(tag, word) AS INT)) AS points FROM w, x GROUP BY ALL),
    s AS (SELECT q.query_id, x.id, CAST(coalesce(points, 0) + coalesce(kind, 0) + CASE WHEN len(words) > 0 AND contains(x.name, q.text) THEN 10 ELSE 0 END + CASE WHEN q.framework <> '' AND contains(x.framework, q.framework) THEN 5 ELSE 0 END + least(5, uses) AS BIGINT) AS score
          FROM q CROSS JOIN x LEFT JOIN h ON h.query_id = q.query_id AND h.id = x.id LEFT JOIN a ON a.query_id = q.query_id AND a.category = x.category)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS place FROM s WHERE score > 0 QUALIFY place <= 5""",
)
def _(s):
    text, item = F.col("text"), F.col("item_id")
    category = F.when(item % 3 == 0, "auth").when(item % 3 == 1, "state").otherwise("file")
    snippets = s.table("benchmark").select(item.alias("id"), F.regexp_extract(text, r"^\S+", 0).alias("name"), F.array(F.regexp_extract(text, r"(\w+)\W*$", 1)).alias("tags"), "text", category.alias("category"), F.lit("web").alias("framework"), (item % 9).alias("uses"))
    queries = s.table("documents").select(F.col("doc_id").alias("query_id"), "text", F.col("source").alias("framework"))
    return S.search_snippets(snippets, queries, 5)


@query("t06_retain", "", "WITH p AS (SELECT p_partkey AS pattern, p_size AS confidence, p_partkey % 7 + 1 AS uses, DATE '2024-01-01' + CAST(p_partkey % 60 AS INT) AS last_used FROM part) SELECT pattern, confidence, uses FROM p WHERE confidence > 10 OR last_used > DATE '2024-01-31' ORDER BY confidence * uses DESC, pattern LIMIT 500")
def _(s):
    p = s.table("part").select(F.col("p_partkey").alias("pattern"), F.col("p_size").alias("confidence"), (F.col("p_partkey") % 7 + 1).alias("uses"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 60).cast("int")).alias("last_used"))
    return S.retain(p, "2024-03-01", 500).select("pattern", "confidence", "uses")


@query("t07_extremes", "runs", "WITH m AS (SELECT repo, CAST(sum(score) AS BIGINT) AS score FROM runs GROUP BY repo) (SELECT *, 'low' AS \"end\" FROM m ORDER BY score, repo LIMIT 5) UNION ALL (SELECT *, 'high' FROM m ORDER BY score DESC, repo LIMIT 5)")
def _(s):
    return S.extremes(s.view("runs").groupBy("repo").agg(F.sum("score").alias("score")), "repo", "score", 5)


EDITED = "CASE WHEN line_no % 7 = 0 THEN 'edited ' || text ELSE text END"


def pair(s):
    a = s.view("text_line").select("path", "line_no", "text")
    b = a.withColumn("text", F.when(F.col("line_no") % 7 == 0, F.concat(F.lit("edited "), "text")).otherwise(F.col("text"))).where("line_no % 11 <> 0")
    return a, b


PAIR = f"a AS (SELECT path, line_no, text FROM text_line), b AS (SELECT path, line_no, {EDITED} AS text FROM text_line WHERE line_no % 11 <> 0), j AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.line_no, b.line_no) AS line_no, a.text AS was, b.text AS now FROM a FULL JOIN b ON a.path = b.path AND a.line_no = b.line_no)"


@query("j22_line_diff", "text_line", f"WITH {PAIR} SELECT path, line_no, 'removed' AS kind, was AS text FROM j WHERE was IS DISTINCT FROM now AND was IS NOT NULL UNION ALL SELECT path, line_no, 'added', now FROM j WHERE was IS DISTINCT FROM now AND now IS NOT NULL")
def _(s):
    return S.line_diff(*pair(s))


@query("j23_diff_context", "text_line", f"WITH {PAIR}, c AS (SELECT *, CASE WHEN was IS DISTINCT FROM now THEN 1 ELSE 0 END AS changed FROM j), n AS (SELECT *, max(changed) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM c) SELECT path, line_no, changed FROM n WHERE near = 1")
def _(s):
    return S.diff_context(*pair(s), k=2)


@query("j24_clones", "text_line", "WITH w AS (SELECT repo, path, line_no, list(lower(regexp_replace(text, '\\s+', ' ', 'g'))) OVER (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM text_line), h AS (SELECT repo, path, line_no, sha256(array_to_string(w, chr(10))) AS clone FROM w WHERE len(w) = 3), m AS (SELECT clone FROM h GROUP BY clone HAVING count(DISTINCT (repo, path)) > 1) SELECT * FROM h WHERE clone IN (SELECT clone FROM m)")
def _(s):
    return S.clones(s.view("text_line"), 3)


@query("j24_clone_ranges", "text_line", r"""WITH w AS (SELECT repo, path, line_no, list(lower(regexp_replace(text, '\s+', ' ', 'g'))) OVER v AS w, sum(len(regexp_extract_all(text, '\w+|[^\s\w]'))) OVER v AS tokens, len(regexp_extract_all(text, '\w+|[^\s\w]')) AS own FROM text_line WINDOW v AS (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    h AS (SELECT repo, path, line_no, array_to_string(w, chr(10)) AS clone, tokens, own FROM w WHERE len(w) = 3), m AS (SELECT clone, min({'repo': repo, 'path': path, 'line': line_no}) AS a FROM h GROUP BY clone HAVING count(DISTINCT (repo, path)) > 1),
    j AS (SELECT h.*, a.repo AS repo_a, a.path AS path_a, line_no - a.line AS shift FROM h JOIN m USING (clone) WHERE (repo, path) <> (a.repo, a.path)),
    k AS (SELECT *, line_no - row_number() OVER (PARTITION BY repo_a, path_a, repo, path, shift ORDER BY line_no) AS run FROM j)
    SELECT repo_a, path_a, CAST(min(line_no) - shift AS INT) AS start_a, repo, path, min(line_no) AS start, CAST(max(line_no) + 2 AS INT) AS "end", CAST(sum(own) - arg_max(own, line_no) + arg_max(tokens, line_no) AS BIGINT) AS tokens FROM k GROUP BY repo_a, path_a, repo, path, shift, run HAVING sum(own) - arg_max(own, line_no) + arg_max(tokens, line_no) >= 50""")
def _(s):
    return S.clone_ranges(s.view("text_line"), 3, 50)


FIX = "SELECT p_partkey AS pattern, p_type AS category, p_name || ' ' || p_brand AS description, p_size AS confidence FROM part"


#: Without SQL: DuckDB floors half transpositions.
@query("j25_similar_fixes", "")
def _(s):
    s.view("part").createOrReplaceTempView("part")
    patterns = s.spark.sql(FIX)
    return S.similar_fixes(patterns.where("pattern % 10 = 0").withColumnRenamed("pattern", "query_id").drop("confidence"), patterns, 0.85)


@query("j26_attribute", "findings changes commits", "WITH b AS (SELECT file % 97 AS file, CAST(commit_id % 40 + 1 AS INT) AS line, max(author) AS author FROM changes JOIN commits USING (commit_id) GROUP BY ALL) SELECT finding_id, author FROM findings JOIN b USING (file, line)")
def _(s):
    blame = s.view("changes").join(s.view("commits"), "commit_id").groupBy((F.col("file") % 97).alias("file"), (F.col("commit_id") % 40 + 1).cast("int").alias("line")).agg(F.max("author").alias("author"))
    return s.view("findings").join(blame, ["file", "line"]).select("finding_id", "author")


@query("a17_style_profile", "code_line", r"""WITH c AS (SELECT repo, CAST(sum(len(regexp_extract_all(text, '''[^'']*'''))) AS BIGINT) AS single, CAST(sum(len(regexp_extract_all(text, '"[^"]*"'))) AS BIGINT) AS double, count(*) FILTER (WHERE regexp_matches(text, ';\s*$')) AS semicolons, count(*) FILTER (WHERE trim(text) <> '') AS lines,
    CAST(sum(len(regexp_extract_all(text, '\bconst\s'))) AS BIGINT) AS consts, CAST(sum(len(regexp_extract_all(text, '\blet\s'))) AS BIGINT) AS lets, CAST(sum(len(regexp_extract_all(text, '=>'))) AS BIGINT) AS arrows, CAST(floor(avg(len(text)) + 0.5) AS BIGINT) AS mean_length FROM code_line GROUP BY repo)
    SELECT *, CASE WHEN single >= double THEN 'single' ELSE 'double' END AS quotes, CAST(floor(semicolons * 100 / lines + 0.5) AS BIGINT) AS semicolon_share FROM c""")
def _(s):
    return S.style_profile(s.view("code_line"))


@query("a18_polyglot_report", "code_line", "WITH c AS (SELECT repo, language, count(DISTINCT path) AS files FROM code_line GROUP BY ALL), r AS (SELECT *, floor(files * 1000 / sum(files) OVER (PARTITION BY repo) + 0.5) / 10 AS share FROM c) SELECT *, share >= 5 AS counts FROM r")
def _(s):
    return S.polyglot_report(s.view("code_line").select("repo", "path", "language").distinct())


@query("a19_corpus_metrics", "code_line", r"SELECT repo, count(DISTINCT path) AS files, count(*) AS lines, CAST(sum(len(regexp_extract_all(text, 'function\s|=>'))) AS BIGINT) AS functions, CAST(sum(len(regexp_extract_all(text, 'class\s'))) AS BIGINT) AS classes, CAST(sum(len(regexp_extract_all(text, '\b(?:if|for|while|case|catch)\b|\?'))) AS BIGINT) AS decisions FROM code_line GROUP BY repo")
def _(s):
    return S.corpus_metrics(s.view("code_line"))


@query("a20_shannon_entropy", "text_line", "WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM text_line), c AS (SELECT token, unnest(string_split(token, '')) AS ch FROM t WHERE token <> ''), n AS (SELECT token, ch, count(*) AS n FROM c GROUP BY ALL) SELECT token, round(-sum(n / len(token) * log2(n / len(token))), 6) + 0.0 AS entropy FROM n GROUP BY token, len(token) HAVING len(token) >= 16")
def _(s):
    tokens = s.view("text_line").select(F.explode(F.split("text", " ")).alias("token")).where(F.length("token") >= 16).distinct()
    return tokens.select("token", (F.round(entropy(F.col("token")), 6) + 0.0).alias("entropy"))


@query("p05_chunk_lines", "text_line", "SELECT repo, path, CAST((line_no - 1) // 10 AS BIGINT) AS chunk, min(line_no) AS first_line, max(line_no) AS last_line, CAST(sum(len(text) + 1) AS BIGINT) AS size FROM text_line GROUP BY ALL")
def _(s):
    return S.chunk_lines(s.view("text_line"), 10)


@query(
    "p05_chunk_files",
    "code_line",
    f"""WITH m AS (SELECT *, CAST(line_no > 1 AND regexp_matches(text, {literal(S.DECLARATION)}) AS INT) AS starts FROM code_line),
    n AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY repo, path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, sum(starts) OVER (PARTITION BY repo, path) AS parts FROM m),
    g AS (SELECT repo, path, parts > 0 AS cut, CASE WHEN parts > 0 THEN running ELSE (line_no - 1) // 10 END AS part, min(line_no) AS first_line, max(line_no) AS last_line, CAST(sum(len(text) + 1) AS BIGINT) AS size FROM n GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY first_line) AS nth FROM g),
    w AS (SELECT repo, path, nth, 0 AS chunk, size, size AS filled FROM o WHERE nth = 1
          UNION ALL SELECT o.repo, o.path, o.nth, CASE WHEN NOT o.cut OR w.filled + o.size - 1 > 300 THEN w.chunk + 1 ELSE w.chunk END, o.size, CASE WHEN NOT o.cut OR w.filled + o.size - 1 > 300 THEN o.size ELSE w.filled + o.size END
          FROM w JOIN o ON o.repo IS NOT DISTINCT FROM w.repo AND o.path = w.path AND o.nth = w.nth + 1)
    SELECT repo, path, chunk, min(first_line) AS first_line, max(last_line) AS last_line, CAST(sum(w.size) - 1 AS BIGINT) AS size FROM w JOIN o USING (repo, path, nth) GROUP BY repo, path, chunk""",
)
def _(s):
    return S.chunk_files(s.view("code_line"), most=300, each=10)


@query("w12_forward_fill", "runs", "SELECT run_id, last_value(CASE WHEN status = 'pass' THEN run_id END IGNORE NULLS) OVER (PARTITION BY repo ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS last_pass FROM runs")
def _(s):
    marked = s.view("runs").withColumn("passed", F.when(F.col("status") == "pass", F.col("run_id")))
    return S.forward_fill(marked, "passed", ["repo"], "run_id", "last_pass").select("run_id", "last_pass")


@query("f01_hashes", "", "SELECT doc_id, left(sha256(trim(text)), 16) AS snippet, left(sha256(concat_ws('|', lang, source)), 16) AS value, left(text, 3) || '***' || right(text, 2) AS masked FROM documents")
def _(s):
    return s.table("documents").select("doc_id", snippet_hash(F.col("text")).alias("snippet"), value_hash(F.col("lang"), F.col("source")).alias("value"), mask(F.col("text"), 3, 2).alias("masked"))


@query("f03_hash31", "", "SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(lang || source, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, u: ((h * 31 + u + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS hash FROM documents WHERE lang || source IS NOT NULL")
def _(s):
    return s.table("documents").select("doc_id", hash31(F.concat("lang", "source")).alias("hash")).where("hash IS NOT NULL")


@query("f05_major", "declared", "SELECT DISTINCT range_text, CAST(regexp_extract(range_text, '(\\d+)', 1) AS INT) AS major FROM declared")
def _(s):
    return s.view("declared").select("range_text", major(F.col("range_text")).alias("major")).distinct()


@query("f06_grade", "runs", "SELECT run_id, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM runs")
def _(s):
    return s.view("runs").select("run_id", grade(F.col("score"), [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F").alias("grade"))


@query("f08_purl", "", "SELECT p_partkey, 'pkg:npm/%40scope/' || replace(p_name, ' ', '-') || '@' || p_size AS purl FROM part")
def _(s):
    return s.table("part").select("p_partkey", purl("npm", F.concat(F.lit("@scope/"), F.replace("p_name", F.lit(" "), F.lit("-"))), F.col("p_size").cast("string")).alias("purl"))


@query("f09_normalize_path", "", "SELECT doc_id, 'b/' || lang || '/f' || doc_id AS path FROM documents")
def _(s):
    return s.table("documents").select("doc_id", normalize_path(F.concat(F.lit("a/../b/./x//../"), "lang", F.lit("/f"), F.col("doc_id").cast("string"))).alias("path"))


@query("f11_branch_slug", "", "SELECT p_partkey, replace(p_name, ' ', '-') || '-' || lower(replace(p_brand, '#', '-')) AS slug FROM part")
def _(s):
    return s.table("part").select("p_partkey", branch_slug(F.concat(F.lit("  "), F.initcap("p_name"), F.lit(": "), "p_brand", F.lit("!"))).alias("slug"))


@query("f13_heal", "code_line", r"SELECT repo, path, line_no, regexp_replace(regexp_replace(regexp_replace(text, '([^=!<>])==([^=])', '\1===\2', 'g'), '!=([^=])', '!==\1', 'g'), '\bvar\s+', 'let ', 'g') AS text FROM code_line")
def _(s):
    return s.view("code_line").select("repo", "path", "line_no", heal(F.col("text")).alias("text"))


@query("f07_js_round", "", "SELECT event_id, CAST(floor(value + 0.5) AS BIGINT) AS up, CAST(floor(0.5 - value) AS BIGINT) AS down FROM events")
def _(s):
    return s.table("events").select("event_id", js_round(F.col("value")).alias("up"), js_round(-F.col("value")).alias("down"))


@query("f12_jaro_winkler", "", "SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) AS similarity FROM part")
def _(s):
    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([S.jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])

    return s.table("part").select("p_partkey", F.round(similarity("p_name", "p_type"), 6).alias("similarity"))
